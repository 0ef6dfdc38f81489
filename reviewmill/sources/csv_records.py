"""CSV records whose quoted fields span lines, from files that stay splittable.

A line maps the state at its start, outside or inside a quoted field, to the state at its
end. Maps compose, so every split of a file reports the map of all its lines; an ordered
prefix over the splits' maps gives the state at each split's start. A second pass cuts
every split into records at the lines that start outside. Records that go on in the next
split are put together at the end: one or two rows per split.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FILE = "_file"
WHOLE, OPEN, HEAD = 0, 1, 2
#: Lines taken at a time, and characters of records sent at a time.
LINES, CHARACTERS = 1024, 1 << 22


def _lines(spark: SparkSession, files: list[str], separator: str, latin: bool) -> DataFrame:
    """Rows (_file, _block, _text, _from_outside, _from_inside), in the order of the file
    inside a split; the states at the line's end are 1 inside a quoted field."""
    lines = spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("_block"), "value")
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1") if latin else F.col("value")
    read = lines.select(FILE, "_block", F.regexp_replace(text, "^\\x{FEFF}", "").alias("_text"))
    sep = "\\|" if separator == "|" else separator
    other = f"[^{'' if separator == '|' else separator}{'|' if separator == '|' else ''}]"
    # a quote opens a field at its start only; inside, two quotes are one that does not close
    body = '(?:[^"]|"")*+'
    field = f'(?:"{body}"{other}*+|(?!"){other}*+)'
    rest = f"(?:{sep}{field})*+$"
    outside, inside = f"^{field}{rest}", f'^{body}"{other}*+{rest}'
    quoted = F.contains("_text", F.lit('"'))
    return read.select(
        "*", F.when(quoted, ~F.col("_text").rlike(outside)).otherwise(F.lit(False)).cast("tinyint").alias("_from_outside"),
        F.when(quoted, ~F.col("_text").rlike(inside)).otherwise(F.lit(True)).cast("tinyint").alias("_from_inside"))


def states(from_outside: np.ndarray, from_inside: np.ndarray, start: int) -> np.ndarray:
    """The state at the start of every line, and at the end of the last: the last line that
    ends alike from both states fixes it, lines after it that swap states turn it."""
    swaps = np.concatenate([[0], np.cumsum((from_outside == 1) & (from_inside == 0))])
    fixed = from_outside == from_inside
    last = np.maximum.accumulate(np.concatenate([[0], np.where(fixed, np.arange(1, len(fixed) + 1), 0)]))
    known = np.concatenate([[start], from_outside])[last]
    return (known + swaps - swaps[last]) % 2


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """((file, block), lines): some lines of a split at a time, in their order."""
    for whole in batches:
        for at in range(0, whole.num_rows, LINES):
            batch = whole.slice(at, LINES)
            files, blocks = batch.column(FILE).to_pylist(), batch.column("_block").to_numpy()
            edges = [0, *(i for i in range(1, batch.num_rows) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]),
                     batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                yield (files[a], int(blocks[a])), batch.slice(a, b - a)


def _column(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(name).to_numpy().astype(np.int64)


def split_maps(lines: DataFrame) -> DataFrame:
    """Rows (_file, _block, _from_outside, _from_inside): the map of a split's lines, composed
    piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]], pa.int64()), *[pa.array([e], pa.int8()) for e in ends]],
                names=[FILE, "_block", "_from_outside", "_from_inside"])

        key, ends = None, [0, 1]
        for now, part in _pieces(batches):
            if now != key:
                if key:
                    yield row()
                key, ends = now, [0, 1]
            a, b = _column(part, "_from_outside"), _column(part, "_from_inside")
            ends = [int(states(a, b, s)[-1]) for s in ends]
        if key:
            yield row()

    narrow = lines.select(FILE, "_block", "_from_outside", "_from_inside")
    return narrow.mapInArrow(run, f"{FILE} string, _block long, _from_outside tinyint, _from_inside tinyint")


def _start_states(maps: DataFrame) -> dict[tuple[str, int], int]:
    """The state at each split's start. One row per split comes to the driver, like the
    splits themselves when Spark plans a scan."""
    out, last, state = {}, None, 0
    for file, block, *ends in maps.orderBy(FILE, "_block").toLocalIterator():
        state = state if file == last else 0
        out[file, block] = state
        last, state = file, ends[state]
    return out


def csv_records(spark: SparkSession, files: list[str], separator: str, latin: bool) -> DataFrame:
    """Rows (_file, _record) of all records but each file's first, which is its header.

    Blank lines outside of quotes are no records. A line break inside a field stays as it
    is; a carriage return at a record's end goes. A quote that is never closed makes the
    rest of its file one record.
    """
    lines = _lines(spark, files, separator, latin)
    shared = spark.sparkContext.broadcast(_start_states(split_maps(lines)))

    def records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, str]]:
        """(split, kind, record); of a split only the record that is still open is held."""
        key, state, begun, held = None, 0, False, []

        def last() -> tuple[tuple[str, int], int, str]:
            return key, (OPEN if state else WHOLE) if begun else HEAD, "\n".join(held)

        for now, part in _pieces(batches):
            if now != key:
                if key:
                    yield last()
                key, state, begun, held = now, shared.value[now], False, []
            at = states(_column(part, "_from_outside"), _column(part, "_from_inside"), state)
            text, begin = part.column("_text").to_pylist(), np.flatnonzero(at[:-1] == 0).tolist()
            state = int(at[-1])
            held += text[:begin[0]] if begin else text
            if not begin:
                continue
            if begun or held:
                yield key, WHOLE if begun else HEAD, "\n".join(held)
            for a, b in zip(begin, begin[1:]):
                yield key, WHOLE, "\n".join(text[a:b])
            begun, held = True, text[begin[-1]:]
        if key:
            yield last()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            files, blocks, kinds, records = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(files), pa.array(blocks, pa.int64()), pa.array(kinds, pa.int8()), pa.array(records, pa.string())],
                names=[FILE, "_block", "_kind", "_record"])

        rows, size, heading = [], 0, None
        for (file, block), kind, record in records_of(batches):
            if block == 0 and heading != file:  # the header goes, and blank lines before it
                heading = file if record.strip(" \r") else heading
                continue
            rows.append((file, block, kind, record))
            size += len(record)
            if len(rows) == 4096 or size >= CHARACTERS:
                yield done()
                rows, size = [], 0
        if rows:
            yield done()

    cut = lines.mapInArrow(run, f"{FILE} string, _block long, _kind tinyint, _record string")
    whole = cut.where(F.col("_kind") == WHOLE).select(FILE, "_record")
    # the few records that splits share: a head goes on where the last open record stopped
    before = Window.partitionBy(FILE).orderBy("_block", F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    shared_rows = cut.where(F.col("_kind") != WHOLE).withColumn(
        "_begin", F.max(F.when(F.col("_kind") == OPEN, F.col("_block"))).over(before))
    pieces = F.array_sort(F.collect_list(F.struct("_block", "_record")))
    joined = shared_rows.where(F.col("_begin").isNotNull()).groupBy(FILE, "_begin").agg(
        F.array_join(F.transform(pieces, lambda p: p["_record"]), "\n").alias("_record"))
    records = whole.unionByName(joined.select(FILE, "_record"))
    clean = F.regexp_replace("_record", "\r$", "")
    return records.select(FILE, clean.alias("_record")).where(F.trim(F.col("_record")) != "")


def parsed(records: DataFrame, names: list[str], bad_row: str, options: dict[str, str]) -> DataFrame:
    """The records as text columns; `bad_row` holds those with too few or too many fields."""
    schema = ",".join(f"{n} string" for n in [*names, bad_row])
    fields: Column = F.from_csv("_record", schema, options | {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad_row})
    return records.select(FILE, fields.alias("_fields")).select(FILE, "_fields.*")
