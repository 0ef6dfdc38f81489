"""Terms of a text looked up and weighted inside its row: no explode, no join, no shuffle.

Words are made by JVM expressions. A map-only Arrow pass then numbers all words of a batch
at once, finds pairs of neighbours in a sorted array of number pairs, and sums by text. It
needs a term table under the broadcast bound; `row_terms` gives None beyond it. There, texts
are taken in blocks: only the different terms of a block are joined with the term table, and
come back to it as a table of its own.
"""

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from reviewmill.functions.text import clean_text, tokens, without_stop_words
from reviewmill.operators.skew import fits_broadcast
from reviewmill.session import materialise

#: Words numbered at a time; bytes of text that a block should have; most rows of one, as a power of 2.
SLICE_WORDS, BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 1 << 24, 14


@dataclass(frozen=True)
class RowTerms:
    """A term table as arrays. A term is a word or a pair of words; its place is that of
    its row in `terms`, which is sorted by term unless it carries an `idx`."""

    words: pa.Array           # every word of a term, once
    single: np.ndarray        # per word: the term that it is alone, or -1
    pairs: np.ndarray         # sorted: first word * number of words + second word
    pair_term: np.ndarray     # per pair: the term
    values: dict[str, np.ndarray]  # other columns of the table, per term
    names: pa.Array | None = None  # the terms, where they are wanted

    @property
    def size(self) -> int:
        return len(self.single) and int(max(self.single.max(), self.pair_term.max(initial=-1))) + 1

    def find(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, occurrences) of known terms in lists of words, by row and term."""
        lengths = np.diff(words.offsets.to_numpy())
        row = np.repeat(np.arange(len(words)), lengths)
        number = pc.fill_null(pc.index_in(words.flatten(), value_set=self.words), -1).to_numpy().astype(np.int64)
        alone = np.where(number >= 0, self.single[number], -1) if len(self.words) else number
        known = alone >= 0
        near = (number[:-1] >= 0) & (number[1:] >= 0) & (row[:-1] == row[1:])
        key = (number[:-1] * len(self.words) + number[1:])[near]
        place = np.searchsorted(self.pairs, key)
        hit = place < len(self.pairs)
        hit[hit] = self.pairs[place[hit]] == key[hit]
        size = max(1, self.size)
        keys = np.concatenate([row[known] * size + alone[known],
                               row[:-1][near][hit] * size + self.pair_term[place[hit]]])
        keys, count = np.unique(keys, return_counts=True)
        return keys // size, keys % size, count


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """Batches in parts of a bounded number of words (one long text is a part), with them."""
    for batch in batches:
        column = batch.column("_words")
        ends, start = column.offsets.to_numpy(), 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + SLICE_WORDS, side="right")) - 1
            stop = max(start + 1, min(stop, batch.num_rows))
            words = pa.ListArray.from_arrays(pa.array(ends[start:stop + 1] - ends[start]), column.values.slice(
                int(ends[start]), int(ends[stop] - ends[start])))
            yield batch.slice(start, stop - start), words
            start = stop


def own_terms(words: pa.ListArray, among: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, term, occurrences) of all terms in lists of words, by row and term, and the
    different terms, pairs last. With among, pairs of those words only."""
    row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    number, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    near = row[:-1] == row[1:]
    if among is not None:
        member = pc.is_in(known, value_set=among).to_numpy(zero_copy_only=False)[number]
        near &= member[:-1] & member[1:]
    pairs, pair = np.unique((number[:-1] * len(known) + number[1:])[near], return_inverse=True)
    size = max(1, len(known) + len(pairs))
    keys, count = np.unique(np.concatenate([row * size + number, row[:-1][near] * size + len(known) + pair]),
                            return_counts=True)
    names = pa.concat_arrays([known, pc.binary_join_element_wise(
        known.take(pa.array(pairs // max(1, len(known)))), known.take(pa.array(pairs % max(1, len(known)))), " ")])
    return keys // size, keys % size, count, names


def term_sums(docs: DataFrame, text_col: str, stop_words: Iterable[str] = (), among: Iterable[str] | None = None
              ) -> DataFrame:
    """Rows (term, df, total): texts with the term and its occurrences. Terms are counted
    part by part of some thousand texts before they are shuffled. With among, all words, but
    pairs of those words only."""
    among = None if among is None else pa.array(list(among), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in sliced(batches):
            _, term, count, names = own_terms(words, among)
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(np.bincount(term, minlength=len(names)).astype(np.int64)),
                 pa.array(np.bincount(term, count, len(names)).astype(np.int64))], names=["term", "df", "total"])

    parts = docs.select(words_column(text_col, stop_words)).mapInArrow(run, "term string, df long, total long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def row_terms(terms: DataFrame, *columns: str, **bounds: int) -> RowTerms | None:
    """The written table (term, *columns) as arrays, or None if it is above the broadcast
    bound."""
    if not fits_broadcast(terms.select("term", *columns), **bounds):
        return None
    # a bounded table
    table = terms.select("term", *columns).toArrow().combine_chunks()
    table = table.sort_by("idx" if "idx" in columns else "term")
    return from_table(pa.chunked_array(table.column("term"), pa.string()).combine_chunks(), {
        c: table.column(c).to_numpy() for c in columns})


def from_table(names: list[str] | pa.Array, values: dict[str, np.ndarray]) -> RowTerms:
    names = names if isinstance(names, pa.Array) else pa.array(names, pa.string())
    parts = pc.split_pattern(names, " ")
    coded = parts.flatten().dictionary_encode()
    number, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    lengths = pc.list_value_length(parts).to_numpy().astype(np.int64)
    start, term = np.cumsum(lengths) - lengths, np.arange(len(names))
    single = np.full(size, -1, dtype=np.int64)
    single[number[start[lengths == 1]]] = term[lengths == 1]
    first = start[lengths == 2]
    pairs = number[first] * size + number[first + 1]
    order = np.argsort(pairs, kind="stable")
    return RowTerms(coded.dictionary, single, pairs[order], term[lengths == 2][order], values)


def of_models(table: pa.Table) -> RowTerms:
    """Terms of several models (no, term, ..) as one set of terms. The value `key` holds, by
    the sorted pair of model and term, its place among the other values."""
    names = table.column("term").cast(pa.string()).combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    found = from_table(names.dictionary, {})
    key = table.column("no").to_numpy().astype(np.int64) * max(1, len(names.dictionary)) + names.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    values = {c: table.column(c).to_numpy()[order] for c in table.column_names if c not in ("no", "term")}
    return replace(found, values=values | {"key": key[order], "terms": np.array(len(names.dictionary))})


def known_to(t: RowTerms, model: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray):
    """(row, entry, count) of terms that the row's model knows."""
    key = model[row] * max(1, int(t.values["terms"])) + term
    place = np.searchsorted(t.values["key"], key)
    hit = place < len(t.values["key"])
    hit[hit] = t.values["key"][place[hit]] == key[hit]
    return row[hit], place[hit], count[hit]


def words_column(text_col: str, stop_words: Iterable[str]) -> Column:
    return without_stop_words(tokens(clean_text(F.col(text_col))), stop_words).alias("_words")


def weights_of(row: np.ndarray, count: np.ndarray, idf: np.ndarray, rows: int, sublinear: bool
               ) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a part's terms, and the length of every row's vector."""
    w = ((1 + np.log(count)) if sublinear else count.astype(float)) * idf
    return w, np.sqrt(np.bincount(row, w * w, rows))


def map_rows(rows: DataFrame, found: RowTerms, each: Callable, schema: str) -> DataFrame:
    """`each(terms, part, row, term, count)` gives the columns that come out of a part."""
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for part, words in sliced(batches):
            columns = each(terms, part, *terms.find(words))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, schema)


def map_texts(docs: DataFrame, text_col: str, stop_words: Iterable[str], keep: Iterable[str], terms: DataFrame,
              columns: Iterable[str], each: Callable, schema: str, names: bool = False, **bounds: int) -> DataFrame:
    """`map_rows` over the columns `keep` of texts, whatever the size of the written term
    table (term, *columns). Beyond the broadcast bound the texts are written in blocks; the
    join sees a term once per block, so none is hot."""
    keep, columns, stop_words = list(keep), list(columns), tuple(stop_words)
    found = row_terms(terms, *columns, **bounds)
    if found is not None:
        found = replace(found, names=pa.array(_names(found), pa.string())) if names else found
        return map_rows(docs.select(*keep, words_column(text_col, stop_words)), found, each, schema)
    return map_blocks(docs, text_col, lambda name: words_column(name, stop_words), keep, terms, columns, each, schema, names)


def map_blocks(docs: DataFrame, text_col: str, words: Callable[[str], Column], keep: Iterable[str], terms: DataFrame,
               columns: Iterable[str], each: Callable, schema: str, names: bool = False, model: str | None = None
               ) -> DataFrame:
    """`map_rows` over texts in written blocks: the different terms of a block are joined with
    the term table, and what is found comes back to the block. `words` makes the words of a
    text column. With `model`, one of `keep`, a row's terms are those of its model (no)."""
    keep, columns, keys = list(keep), list(columns), ["term"] if model is None else ["no", "term"]
    length = docs.agg(F.avg(F.octet_length(clean_text(F.col(text_col))))).first()[0] or 1.0
    shift = int(np.clip(np.log2(BLOCK_BYTES / max(1.0, length)), 0, BLOCK_ROWS))
    rows = materialise(docs.select(*keep, F.col(text_col).alias("_text"), F.shiftright(
        F.monotonically_increasing_id(), shift).alias("_block")), "term-blocks")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in sliced(batches):
            row, term, _, found = own_terms(words)
            block, at = np.unique(part.column("_block").to_numpy(), return_inverse=True)
            number = np.zeros(part.num_rows, dtype=np.int64) if model is None else part.column("_no").to_numpy().astype(np.int64)
            models = int(number.max(initial=0)) + 1
            code = np.unique((at * models + number)[row] * max(1, len(found)) + term)
            code, term = code // max(1, len(found)), code % max(1, len(found))
            yield pa.RecordBatch.from_arrays([pa.array(block[code // models]), pa.array((code % models).astype(np.int32)),
                                              found.take(pa.array(term))], names=["_block", "no", "term"])

    number = [] if model is None else [F.col(model).alias("_no")]
    here = rows.select("_block", *number, words("_text").alias("_words")).mapInArrow(
        wanted, "_block long, no int, term string").select("_block", F.xxhash64(*keys).alias("_key"))
    # a block asks by hash: terms of an equal one come along, and are not found in its texts;
    # written, so that the shuffles of this join are gone before the texts are dealt out
    known = materialise(here.join(terms.select(*keys, *columns).withColumn("_key", F.xxhash64(*keys)), "_key").drop("_key"),
                        "block-terms")
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    layout = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kind.fields])

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        # a block that lies in two tasks asked twice: the first of equal rows is found
        if model is None:
            known = known.combine_chunks().sort_by("idx" if "idx" in columns else "term")
            name = pa.chunked_array(known.column("term"), pa.string()).combine_chunks()
            table = from_table(name, {c: known.column(c).to_numpy() for c in columns})
            table = replace(table, names=name) if names else table
        else:
            table = of_models(known.select([*keys, *columns]))
        out = []
        for part, words in sliced(texts.combine_chunks().to_batches()):
            found = table.find(words)
            if model is not None:
                found = known_to(table, part.column(model).to_numpy(), *found)
            out.append(pa.RecordBatch.from_pydict(each(table, part, *found), layout))
        return pa.Table.from_batches(out, layout)

    dealt = rows.repartition("_block").select("_block", *keep, words("_text").alias("_words"))
    return dealt.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(run, schema)


def _names(found: RowTerms) -> list[str]:
    """The terms in their order."""
    words = found.words.to_pylist()
    names = [""] * found.size
    for word, term in zip(words, found.single.tolist()):
        if term >= 0:
            names[term] = word
    for key, term in zip(found.pairs.tolist(), found.pair_term.tolist()):
        names[term] = f"{words[key // len(words)]} {words[key % len(words)]}"
    return names
