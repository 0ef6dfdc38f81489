"""Lines that many documents share, found with two Bloom filters."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reviewmill.llm.common import bounded_broadcast, lists, materialise

MIN_CHARS, MIN_DOCS = 40, 5
#: ASCII white space, stripped at both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
#: Hashes of a segment of the filters, about; bits per expected hash, probes per hash, and
#: the most bytes of twice-seen filters that are handed to all tasks.
SEGMENT_HASHES, BITS, PROBES, MAX_BYTES = 1 << 20, 16, 4, 32 << 20
#: Tasks that share the hashes of a segment when they are probed.
SALTS = 8
#: From this share of bits on, a filter is not folded further.
FOLD_BELOW = 0.12
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def line_key(line: str) -> str:
    line = line.strip(BLANK)
    return line.lower() if line.isascii() else line.translate(ASCII_LOWER)


def document_keys(text: str | None, min_chars: int) -> set[str]:
    """The distinct keys of a text that are long enough. A key is never longer than its
    line, so short lines are passed over first."""
    keys = {line_key(x) for x in (text or "").split("\n") if len(x) >= min_chars}
    return {k for k in keys if len(k) >= min_chars}


def digest(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k.encode()) for k in keys), dtype=np.uint64, count=len(keys))


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit positions inside a segment, a power of two wide; a folded filter of fewer bits
    takes the same hash modulo its width."""
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [((first + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)]


def segment(h: np.ndarray, segments: int) -> np.ndarray:
    """The segment of a hash, some of its own bits; their number is a power of two."""
    return ((h >> np.uint64(40)) & np.uint64(segments - 1)).astype(np.int64)


class TwoFilters:
    """Bloom filters of the hashes seen once and seen twice or more."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits, dtype=bool), np.zeros(bits, dtype=bool)

    def add(self, h: np.ndarray) -> None:
        values, counts = np.unique(h, return_counts=True)
        at = probes(values, self.bits)
        seen = counts > 1
        known = np.ones(len(values), dtype=bool)
        for p in at:
            known &= self.once[p]
        for p in at:
            self.once[p] = True
            self.twice[p[known | seen]] = True

    def folded(self) -> bytes:
        """The twice-seen filter, halved while few bits are set."""
        bits = self.twice
        while len(bits) > 64 and bits.mean() < FOLD_BELOW:
            half = len(bits) // 2
            bits = bits[:half] | bits[half:]
        return np.packbits(bits, bitorder="little").tobytes()


def _hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(__h, __again): the hash of every key of a document, once for some documents
    together, and whether several of them hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in lists(batches, "__text"):
            h, n = np.unique(digest([k for t in texts for k in document_keys(t, min_chars)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)], names=["__h", "__again"])

    return docs.select("__text").mapInArrow(run, "__h long, __again boolean")


def twice_seen(hashes: DataFrame) -> tuple[DataFrame, int]:
    """The written rows (segment, bits) of the twice-seen filter, and the number of its
    segments, which follows the number of hashes.

    A segment's hashes meet in one task, which fills both filters in fixed memory.
    """
    count = hashes.count()
    segments = 64
    while segments * SEGMENT_HASHES < count:
        segments *= 2
    bits = 64
    while bits < count * BITS / segments:
        bits *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, TwoFilters] = {}
        last = None
        for batch in batches:
            parts, h = batch.column("segment").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
            again = batch.column("again").to_numpy(zero_copy_only=False)
            for s in np.unique(parts).tolist():
                mine = parts == s
                filters.setdefault(s, TwoFilters(bits)).add(np.concatenate([h[mine], h[mine & again]]))
            last = int(parts[-1]) if len(parts) else last
            for s in [s for s in filters if s != last]:  # sorted: the others are complete
                yield packed(s, filters.pop(s))
        for s, found in filters.items():
            yield packed(s, found)

    def packed(s: int, found: TwoFilters) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([found.folded()], pa.binary())],
                                          names=["segment", "bits"])

    thin = hashes.select(F.shiftrightunsigned("__h", 40).bitwiseAND(F.lit(segments - 1).cast("long")).alias("segment"),
                         F.col("__h").alias("h"), F.col("__again").alias("again"))
    return materialise(thin.repartition("segment").sortWithinPartitions("segment").mapInArrow(
        fill, "segment long, bits binary"), "line-filters"), segments


def probe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes of a segment its filter holds."""
    ok = np.ones(len(h), dtype=bool)
    for p in probes(h, len(bits) * 8):
        ok &= (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return ok


def suspected(filters: dict[int, np.ndarray], h: np.ndarray, segments: int) -> np.ndarray:
    """Which hashes may have been seen twice."""
    hit, parts = np.zeros(len(h), dtype=bool), segment(h, segments)
    for s in np.unique(parts):
        if (bits := filters.get(int(s))) is not None:
            mine = np.flatnonzero(parts == s)
            hit[mine] = probe(bits, h[mine])
    return hit


def _suspects(docs: DataFrame, filters: dict[int, bytes], segments: int, min_chars: int) -> DataFrame:
    """(__doc_id, __key): the keys of each document that other documents may hold."""
    id_type = docs.schema["__doc_id"].dataType
    arrow_type = to_arrow_type(id_type)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # at most MAX_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {s: np.frombuffer(b, dtype=np.uint8) for s, b in shared.value.items()}
        for ids, texts in lists(batches, "__doc_id", "__text"):
            found = [(i, k) for i, t in zip(ids, texts) for k in document_keys(t, min_chars)]
            hit = np.flatnonzero(suspected(known, digest([k for _, k in found]), segments))
            yield pa.RecordBatch.from_arrays(
                [pa.array([found[n][0] for n in hit], arrow_type),
                 pa.array([found[n][1] for n in hit], pa.string())], names=["__doc_id", "__key"])

    return docs.mapInArrow(run, f"__doc_id {id_type.simpleString()}, __key string")


def _suspects_by_segment(docs: DataFrame, filters: DataFrame, segments: int, min_chars: int) -> DataFrame:
    """The same where the filters are too large for every task: a segment's filter and its
    hashes meet in the same tasks, and only documents with a suspect are read again."""
    source = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "line-rows")
    id_type = docs.schema["__doc_id"].dataType
    arrow_type = to_arrow_type(id_type)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in lists(batches, "__row", "__text"):
            keys = [document_keys(t, min_chars) for t in texts]
            h = digest([k for each in keys for k in each])
            row = np.repeat(np.array(rows, dtype=np.int64), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment(h, segments)), pa.array(row % SALTS), pa.array(row), pa.array(h.view(np.int64))],
                names=["segment", "salt", "row", "h"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mine = None, None
        for batch in batches:
            parts, salts = batch.column("segment").to_numpy(), batch.column("salt").to_numpy()
            h, rows = (batch.column(c).fill_null(0).to_numpy() for c in ("h", "row"))
            data = batch.column("bits")
            filled = data.is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(filled).tolist()
            for a, b in zip([0, *edges], [*edges, len(parts)]):
                if a < b and filled[a]:  # a filter comes before its hashes
                    bits, mine = np.frombuffer(data[a].as_py(), dtype=np.uint8), (parts[a], salts[a])
                    a += 1
                of = (parts[a:b] == mine[0]) & (salts[a:b] == mine[1]) if mine else np.zeros(b - a, dtype=bool)
                found = np.flatnonzero(of)
                found = a + found[probe(bits, h[a:b][found].view(np.uint64))] if len(found) else found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[found], pa.int64()), pa.array(h[found], pa.int64())], names=["row", "h"])

    salted = filters.select("segment", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("salt"),
                            "bits")
    hashes = source.select("__row", "__text").mapInArrow(hashed, "segment long, salt long, row long, h long")
    met = hashes.unionByName(salted, allowMissingColumns=True).repartition("segment", "salt").sortWithinPartitions(
        "segment", "salt", F.col("bits").isNull())
    suspects = materialise(met.mapInArrow(probed, "row long, h long").groupBy(F.col("row").alias("__row")).agg(
        F.collect_set("h").alias("__hashes")), "line-suspect-rows")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, hashes in lists(batches, "__doc_id", "__text", "__hashes"):
            found = [(i, k) for i, t, wanted in zip(ids, texts, map(set, hashes))
                     for k in document_keys(t, min_chars) if int(digest([k]).view(np.int64)[0]) in wanted]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in found], arrow_type), pa.array([k for _, k in found], pa.string())],
                names=["__doc_id", "__key"])

    return source.join(bounded_broadcast(suspects), "__row").select("__doc_id", "__text", "__hashes").mapInArrow(
        lines, f"__doc_id {id_type.simpleString()}, __key string")


def _kept(docs: DataFrame) -> DataFrame:
    """(__doc_id, n_lines, n_dropped, kept_text) of (__doc_id, __text, __drop)."""
    id_type = docs.schema["__doc_id"].dataType
    arrow_type = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, drops in lists(batches, "__doc_id", "__text", "__drop"):
            kept, lines = [], []
            for text, drop in zip(texts, drops):
                all_lines = (text or "").split("\n")
                gone = set(drop or ())
                kept.append([x for x in all_lines if line_key(x) not in gone] if gone else all_lines)
                lines.append(len(all_lines))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow_type), pa.array(lines, pa.int64()),
                 pa.array([n - len(k) for n, k in zip(lines, kept)], pa.int64()),
                 pa.array(["\n".join(k) for k in kept], pa.string())],
                names=["__doc_id", "n_lines", "n_dropped", "kept_text"])

    return docs.mapInArrow(
        run, f"__doc_id {id_type.simpleString()}, n_lines long, n_dropped long, kept_text string")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                        max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, kept_text), one per document.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. A key
    of enough characters in enough documents loses all its lines but those in the
    document with the largest id. Null and empty texts are one empty line. Rows are
    documents: repeated rows count each, and all rows of the largest id keep the line;
    null ids are the smallest. An empty table gives no rows. Texts and lines may be of any
    length; other columns are not read.

    Only hashes of eight bytes are shuffled for all lines; a line travels only if the
    twice-seen filter suspects it, and counts are exact.
    """
    source = docs.select(F.col(id_col).alias("__doc_id"), F.col(text_col).alias("__text"))
    hashes = materialise(_hashes(source, min_chars), "line-hashes")
    filters, segments = twice_seen(hashes)
    size = filters.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    if size <= max_bytes:
        known = {r["segment"]: bytes(r["bits"]) for r in filters.collect()}  # at most max_bytes
        suspects = _suspects(source, known, segments, min_chars)
    else:
        suspects = _suspects_by_segment(source, filters, segments, min_chars)
    suspects = materialise(suspects, "line-suspects")
    repeated = suspects.groupBy("__key").agg(F.count("*").alias("__n"), F.max("__doc_id").alias("__last")).where(
        F.col("__n") >= min_docs)
    drops = suspects.join(repeated, "__key").where(~F.col("__doc_id").eqNullSafe(F.col("__last"))).select(
        F.col("__doc_id").alias("__id"), "__key").groupBy("__id").agg(F.collect_set("__key").alias("__drop"))
    return _kept(source.join(drops, F.col("__doc_id").eqNullSafe(F.col("__id")), "left").select(
        "__doc_id", "__text", "__drop")).withColumnRenamed("__doc_id", id_col)
