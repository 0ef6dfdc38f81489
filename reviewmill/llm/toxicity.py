"""Toxicity from the nearest labelled examples by exact TF-IDF cosine."""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reviewmill.llm.common import SLICE, lists, materialise
from reviewmill.llm.samples import id_remainder, labelled_sample, sampled_texts

#: Labelled rows that serve as examples, at most (half of each class).
SAMPLE_ROWS = 6000
#: Examples per block of the index; neighbours that vote; power of the similarity; vote
#: of no neighbour at all; score from which a text counts as toxic.
BLOCK, NEIGHBOURS, POWER, IDLE, THRESHOLD = 64, 15, 2, 0.02, 0.7
#: G statistic from which a term tells the classes apart (1 % level, one degree of freedom).
TELLING, LEAST_TEXTS = 6.63, 4
#: Share of the examples from which a term's list is kept as a dense row.
FREQUENT = 1 / 32
#: Terms are words, and beginnings of so many letters of longer words, marked with *.
BEGINNINGS = range(3, 7)
WORD = re.compile(r"[^\W\d_]+")
#: Bytes of a text with ASCII characters other than letters as spaces; the rest as it is.
ROUGH = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Rough words that a task remembers, at most; beyond it starts anew.
REMEMBERED = 500_000


def rough_words(text: bytes | None) -> Counter:
    """Stretches without ASCII characters other than letters, with their counts."""
    return Counter((text or b"").translate(ROUGH).split())


def terms_of(rough: bytes) -> list[str]:
    """Lower-cased words of a stretch, and their marked beginnings."""
    words = [rough.decode().lower()] if rough.isascii() else WORD.findall(rough.decode("utf-8", "replace").lower())
    return words + [w[:k] + "*" for w in words for k in BEGINNINGS[:max(0, len(w) - BEGINNINGS.start)]]


def term_counts(text: bytes | None) -> Counter:
    out: Counter = Counter()
    for rough, n in rough_words(text).items():
        for term in terms_of(rough):
            out[term] += n
    return out


class Terms:
    """Numbers of known terms. A stretch of letters is cut into terms once per task."""

    def __init__(self, names: list[str]):
        self.number = {t: n for n, t in enumerate(names)}
        self.count = len(names)
        self.useful: dict[bytes, list[int]] = {}
        self.seen: set[bytes] = set()

    def __reduce__(self):
        return Terms, (list(self.number),)

    def rows(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, occurrences) of all terms in the texts, sorted by text and term."""
        if len(self.seen) > REMEMBERED:
            self.useful, self.seen = {}, set()
        useful, number = self.useful, self.number
        at: list[int] = []
        counts: list[int] = []
        ends = []
        for text in texts:
            words = rough_words(text)
            for rough in words.keys() - self.seen:
                self.seen.add(rough)
                if found := [number[t] for t in terms_of(rough) if t in number]:
                    useful[rough] = found
            for rough in words.keys() & useful.keys():
                found = useful[rough]
                at += found
                counts += [words[rough]] * len(found)
            ends.append(len(at))
        row = np.repeat(np.arange(len(texts)), np.diff([0, *ends]))
        keys, place = np.unique(row * self.count + np.array(at, dtype=np.int64), return_inverse=True)
        return keys // max(1, self.count), keys % max(1, self.count), np.bincount(place, counts, len(keys))


@dataclass(frozen=True)
class ToxicityModel:
    """Examples behind a block-max inverted index, all sizes bounded by the sample.

    Postings are sorted by term, then example; each term has the places of its postings by
    block, and its largest weight per block. The lists of terms that many examples hold are
    kept as rows of a dense matrix instead, and are multiplied for all texts of a slice.
    """

    terms: Terms
    idf: np.ndarray          # per term
    ids: list
    toxic: np.ndarray        # per example
    mass: np.ndarray         # per example: labelled rows that it stands for
    example: np.ndarray      # per posting
    value: np.ndarray        # per posting: weight in the example's unit vector
    block_start: np.ndarray  # per term and block: its first posting; one more block at the end
    block_max: np.ndarray    # per term and block: the largest weight
    dense_row: np.ndarray    # per term: its row in `dense`, or -1
    dense: np.ndarray        # per frequent term and example
    slope: float = 0.0
    offset: float = 0.0

    def weigh(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        """Weights of the terms of n texts; each text's vector is of length one."""
        w = (1 + np.log(tf)) * self.idf[term]
        return w / np.sqrt(np.bincount(row, w * w, n))[row]

    def nearest(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, k: int,
                but: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of n unit vectors (text, term, weight) the k examples of highest cosine
        (above 0), ties by place, and the cosines; `but` names an example to leave out.

        Frequent terms are added up first, for all examples. What the other terms can add
        to a block is at most the sum of their largest weights in it. The blocks of the
        highest bounds are finished first; others only if their bound reaches the kth
        cosine found, so that none is missed.
        """
        often = self.dense_row[term] >= 0
        query = np.zeros((n, len(self.dense)))
        query[row[often], self.dense_row[term[often]]] = w[often]
        scores = query @ self.dense
        if but is not None:
            scores[np.arange(n), but] = -1
        reached = scores.reshape(n, -1, BLOCK).max(axis=2)
        row, term, w = row[~often], term[~often], w[~often]
        ends = np.searchsorted(row, np.arange(n + 1))
        for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
            yield self._finish(scores[i], reached[i], term[a:b], w[a:b], k, -1 if but is None else int(but[i]))

    def _finish(self, scores: np.ndarray, reached: np.ndarray, at: np.ndarray, w: np.ndarray, k: int, but: int
                ) -> tuple[np.ndarray, np.ndarray]:
        rest = w @ self.block_max[at]
        bound = reached + rest
        order = np.argsort(-bound, kind="stable")
        first, others = np.split(order, [max(2, 2 * k // BLOCK)])
        self._add(scores, at, w, first, but)
        seen = scores.reshape(-1, BLOCK)[first].ravel()
        kth = max(0.0, np.partition(seen, len(seen) - k)[-k]) if len(seen) >= k else 0.0
        self._add(scores, at, w, others[(rest[others] > 0) & (bound[others] >= kth - 1e-9)], but)
        # cosines that differ by rounding only are ties
        hit = np.flatnonzero(scores >= max(kth - 1e-11, 1e-12))
        top = hit[np.lexsort((hit, -np.round(scores[hit], 12)))[:k]]
        return top, scores[top]

    def _add(self, scores: np.ndarray, at: np.ndarray, w: np.ndarray, blocks: np.ndarray, but: int) -> None:
        """Add what the terms have in the blocks."""
        first = self.block_start[at[:, None], blocks].ravel()
        size = self.block_start[at[:, None], blocks + 1].ravel() - first
        some = np.flatnonzero(size)
        if not len(some):
            return
        first, size = first[some], size[some]
        ends = np.cumsum(size)
        places = np.repeat(first - ends + size, size) + np.arange(ends[-1])
        by_term = np.repeat(w[some // len(blocks)], size)
        scores += np.bincount(self.example[places], self.value[places] * by_term, len(scores))
        if but >= 0:
            scores[but] = -1

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine ** POWER * self.mass[near]
        return float((w * self.toxic[near]).sum() / (w.sum() + IDLE))

    def scores(self, texts: list[bytes | None]) -> Iterator[tuple[float, list]]:
        """Calibrated probabilities, and the ids of the nearest examples."""
        row, term, tf = self.terms.rows(texts)
        w = self.weigh(row, term, tf, len(texts))
        for near, cosine in self.nearest(row, term, w, len(texts), NEIGHBOURS):
            yield _sigmoid(self.slope * self.vote(near, cosine) + self.offset), [self.ids[i] for i in near[:3]]


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def g_statistic(a: Column, b: Column, n1: int, n0: int) -> Column:
    """G-test of a term in a of n1 and b of n0 examples. An empty cell adds nothing, so
    that a term of one class only is not held against."""
    n, total = n1 + n0, F.lit(0.0)
    for seen, row, column in ((a, n1, a + b), (b, n0, a + b), (n1 - a, n1, n - a - b), (n0 - b, n0, n - a - b)):
        ratio = seen.cast("double") * F.lit(float(n)) / (F.lit(float(row)) * column)
        total = total + F.when(seen > 0, 2.0 * seen * F.ln(ratio)).otherwise(0.0)
    return total


def telling_terms(examples: DataFrame, n1: int, n0: int) -> list[str]:
    """Terms of (label, terms) that tell the classes apart, in order. Bounded by the
    sample: a term stands in LEAST_TEXTS of its texts or more."""
    held = examples.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    found = held.where(F.col("a") + F.col("b") >= LEAST_TEXTS).where(
        g_statistic(F.col("a"), F.col("b"), n1, n0) >= TELLING)
    return sorted(found.select("term").toArrow().column("term").to_pylist())


def build_index(ids: list, rows: tuple[np.ndarray, np.ndarray, np.ndarray], toxic: np.ndarray, mass: np.ndarray,
                terms: Terms, idf: np.ndarray) -> ToxicityModel:
    """Order the examples by their heaviest term, so that a block holds like ones, and
    write the postings. `rows` are (example, term, occurrences), sorted."""
    row, term, tf = rows
    value = (1 + np.log(tf)) * idf[term]
    value = value / np.sqrt(np.bincount(row, value * value, len(ids)))[row]
    heavy = np.full(len(ids), -1)
    heaviest = np.lexsort((-term, value, row))  # last of each example
    heavy[row[heaviest]] = term[heaviest]
    order = sorted(range(len(ids)), key=lambda i: (heavy[i], toxic[i], ids[i]))
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    blocks = len(ids) // BLOCK + 1
    by_term = np.lexsort((place[row], term))
    example, term, value = place[row][by_term], term[by_term], value[by_term]
    often = np.flatnonzero(np.bincount(term, minlength=terms.count) > len(ids) * FREQUENT)
    dense_row = np.full(terms.count, -1)
    dense_row[often] = np.arange(len(often))
    in_dense = dense_row[term] >= 0
    dense = np.zeros((len(often), blocks * BLOCK))
    dense[dense_row[term[in_dense]], example[in_dense]] = value[in_dense]
    example, term, value = example[~in_dense], term[~in_dense], value[~in_dense]
    key = term * blocks + example // BLOCK
    start = np.searchsorted(key, np.arange(terms.count * blocks + 1))
    block_max = np.zeros(terms.count * blocks)
    np.maximum.at(block_max, key, value)
    return ToxicityModel(
        terms, idf, [ids[i] for i in order], toxic[order], mass[order], example, value,
        start[np.arange(terms.count)[:, None] * blocks + np.arange(blocks + 1)], block_max.reshape(-1, blocks),
        dense_row, dense)


def calibrate(model: ToxicityModel, ids: list, rows: tuple[np.ndarray, np.ndarray, np.ndarray]
              ) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the votes that each example gets from
    the others, weighted as the classes are in the labelled rows."""
    place = {x: n for n, x in enumerate(model.ids)}
    row, term, tf = rows
    weight = model.weigh(row, term, tf, len(ids))
    at, votes = np.array([place[i] for i in ids]), []
    for start in range(0, len(ids), SLICE):
        stop = min(start + SLICE, len(ids))
        a, b = np.searchsorted(row, [start, stop])
        votes += [model.vote(*found) for found in model.nearest(
            row[a:b] - start, term[a:b], weight[a:b], stop - start, NEIGHBOURS, at[start:stop])]
    y, m = model.toxic[at].astype(float), model.mass[at]
    x = np.array([votes, np.ones(len(votes))]).T
    # targets a little inside 0 and 1, and a small penalty, keep separable votes finite
    y = np.where(y == 1, ((m * y).sum() + 1) / ((m * y).sum() + 2), 1 / ((m * (1 - y)).sum() + 2))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
        grad = x.T @ (m * (p - y)) + 1e-3 * beta
        hessian = (x * (m * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hessian, grad), -5, 5)
    return float(beta[0]), float(beta[1])


def _document_frequency(docs: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """In how many of all documents each term stands, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value, np.zeros(shared.value.count + 1, dtype=np.int64)
        for (texts,) in lists(batches, "__data"):
            counts[-1] += len(texts)
            counts[:-1] += np.bincount(known.rows(texts)[1], minlength=known.count)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["term", "n"])

    sums = docs.select(_data()).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(terms.count + 1)
    found = sums.toArrow()  # a row per term
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out[:-1], int(out[-1])


def _data() -> Column:
    return F.col("__text").cast("binary").alias("__data")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", training=None, rows: int = SAMPLE_ROWS) -> ToxicityModel | float:
    """A model from labelled documents, or a constant score where a class is missing.

    A document with several labels is toxic if one says so. Examples are a bounded
    sample; document frequencies are those of all documents. Labels choose terms, vote and
    calibrate; the cosine is that of plain TF-IDF weights over the chosen terms. Empty
    tables and tables without a label give 0.
    """
    source = docs.select(F.col(id_col).alias("__doc_id"), F.col(text_col).alias("__text"))
    marked = labels.select(F.col(id_col).alias("__doc_id"), F.col(label_col).alias("__label")).where(
        F.col("__label").isin(0, 1))
    if training is not None:
        marked = marked.where(training)
    marked = marked.groupBy("__doc_id").agg(F.max("__label").alias("__label"))
    class_rows = {r[0]: r[1] for r in marked.groupBy("__label").count().collect()}
    sample = labelled_sample(marked, rows)
    examples = materialise(sampled_texts(source, sample.select(
        "__doc_id", F.col("__label").cast("int").alias("__label"))).select("__doc_id", "__label", _data()),
        "toxicity-examples")
    found = {r[0]: r[1] for r in examples.groupBy("__label").count().collect()}
    if len(found) < 2:
        return float(next(iter(found), 0))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ys, texts in lists(batches, "__label", "__data"):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ys, pa.int32()), pa.array([list(term_counts(t)) for t in texts], pa.list_(pa.string()))],
                names=["label", "terms"])

    terms = Terms(telling_terms(examples.mapInArrow(cut, "label int, terms array<string>"), found[1], found[0]))
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    id_type = source.schema["__doc_id"].dataType
    arrow_type = to_arrow_type(id_type)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ys, texts in lists(batches, "__doc_id", "__label", "__data"):
            row, at, tf = shared.value.rows(texts)
            ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow_type), pa.array(ys, pa.int32()),
                 pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))], names=["id", "label", "at", "tf"])

    # the sample's rows, with their counts of the chosen terms only
    table = examples.mapInArrow(number, f"id {id_type.simpleString()}, label int, at array<int>, tf array<int>"
                                ).orderBy("id").toArrow().combine_chunks()
    ids = table.column("id").to_pylist()
    toxic = table.column("label").to_numpy().astype(np.int64)
    at, tf = (pa.concat_arrays(table.column(c).chunks) for c in ("at", "tf"))
    index = (np.repeat(np.arange(len(ids)), at.value_lengths().to_numpy()),
             at.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(float))
    mass = np.array([class_rows[y] / found[y] for y in toxic.tolist()])
    held, n = _document_frequency(source, terms)
    model = build_index(ids, index, toxic, mass / mass.max(), terms, np.log((1 + n) / (1 + held)) + 1)
    slope, offset = calibrate(model, ids, index)
    return replace(model, slope=slope, offset=offset)


def _scores(model: ToxicityModel | float, texts: list[bytes | None]) -> Iterator[tuple[float, list]]:
    return ((model, []) for _ in texts) if isinstance(model, float) else model.scores(texts)


def score(docs: DataFrame, model: ToxicityModel | float, id_col: str = "doc_id",
          text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, score, predicted, evidence), one per document, without a shuffle.

    Null and empty texts and those without a telling term have no neighbour and get the
    score of a text without evidence. Repeated rows and null ids stay. Texts of any length
    are read whole; examples of equal cosine vote in the order of the index, so reruns
    agree. An empty table gives no rows; other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("__doc_id"), F.col(text_col).alias("__text"))
    id_type = source.schema["__doc_id"].dataType
    arrow_type = to_arrow_type(id_type)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in lists(batches, "__doc_id", "__data"):
            found = list(_scores(shared.value, texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow_type), pa.array([s for s, _ in found], pa.float64()),
                 pa.array([int(s >= threshold) for s, _ in found], pa.int32()),
                 pa.array([e for _, e in found], pa.list_(arrow_type))],
                names=["__doc_id", "score", "predicted", "evidence"])

    return source.select("__doc_id", _data()).mapInArrow(
        run, f"__doc_id {id_type.simpleString()}, score double, predicted int, "
             f"evidence array<{id_type.simpleString()}>").withColumnRenamed("__doc_id", id_col)


def drop_toxic(docs: DataFrame, model: ToxicityModel | float, text_col: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold. Null and
    empty texts score as texts without evidence; repeated rows and rows without an id are
    judged like any other, and an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(text_col).cast(pa.binary())
            keep = [s < threshold for start in range(0, batch.num_rows, SLICE)
                    for s, _ in _scores(shared.value, data.slice(start, SLICE).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Documents whose id's crc32 leaves 1 modulo 3; not those without an id."""
    return F.coalesce(id_remainder(F.col(id_col), 3) == 1, F.lit(False))


def train_on_documents(docs: DataFrame, labels: DataFrame) -> ToxicityModel | float:
    """A model from the labels of the documents that are not held out."""
    return train(docs, labels, training=~held_out("__doc_id"))
