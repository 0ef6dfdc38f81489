"""Language of a text from averaged hashed subword embeddings and a linear softmax."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reviewmill.llm.common import lists
from reviewmill.llm.samples import id_remainder, labelled_sample, sampled_texts

#: Labelled rows that a model is fitted on, at most (equal shares per language).
SAMPLE_ROWS = 2000
BUCKETS, WIDTH, EPOCHS, RATE, SEED = 1 << 15, 16, 8, 4.0, 5
#: Bytes of a text whose subwords are hashed in one go.
PIECE = 1 << 18
UNKNOWN = "und"
#: Accepted answers on the calibration rows are right at least so often.
TRUST = 0.99
LETTERS = bytes(i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of all 2- to 4-byte subwords of the lower-cased text, piece by piece. A
    space may only stand at an end, where it marks the border of a word."""
    data = np.frombuffer(b" " + text.lower().encode().translate(LETTERS) + b" ", dtype=np.uint8)
    for start in range(0, len(data), PIECE):
        part = data[start:start + PIECE + 3].astype(np.uint32)
        gap = part == 32
        h = (part ^ np.uint32(2166136261)) * np.uint32(16777619)
        for n in (2, 3, 4):
            stop = min(len(part) - n + 1, PIECE)
            if stop <= 0:
                break
            h = (h[:len(part) - n + 1] ^ part[n - 1:]) * np.uint32(16777619)
            inner = [gap[i:len(gap) - n + 1 + i] for i in range(1, n - 1)]
            ok = ~np.logical_or.reduce(inner) if inner else ~(gap[:-1] & gap[1:])
            found = h[:stop][ok[:stop]]
            yield ((found ^ (found >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int32)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for found in subwords(text):
        counts += np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at] / max(1, counts.sum())


@dataclass(frozen=True)
class LanguageModel:
    """Languages, the score each bucket gives them (embeddings times weights), their
    bias, the temperature of the calibrated softmax, and the least probability at which
    an answer is trusted. Its size is bounded by BUCKETS times the languages."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for found in subwords(text):
            total += self.scores.take(found, axis=0).sum(axis=0, dtype=np.float64)
            n += len(found)
        return softmax((total / max(1, n) + self.bias) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str],
        calibration: np.ndarray) -> LanguageModel:
    """Train embeddings and weights by stochastic gradient descent on the rows outside
    the calibration part; on that part set the temperature by its likelihood, then the
    least probability whose answers can be trusted."""
    random = np.random.default_rng(SEED)
    embedding = random.normal(0, 1, (BUCKETS, WIDTH))
    weight, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    train = np.flatnonzero(~calibration) if (~calibration).any() else np.arange(len(bags))
    steps, step = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in random.permutation(train):
            at, share = bags[i]
            rate = RATE * (1 - step / steps)
            hidden = share @ embedding[at]
            error = softmax(hidden @ weight + bias)
            error[labels[i]] -= 1
            embedding[at] -= rate * np.outer(share, weight @ error)
            weight -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            step += 1
    scores = embedding @ weight
    check = np.flatnonzero(calibration) if calibration.any() else train
    logits = np.array([share @ scores[at] + bias for at, share in (bags[i] for i in check)])
    truth = labels[check]
    best = min(np.geomspace(0.1, 10, 41), key=lambda t: -np.log(
        softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).sum())
    sure = softmax(logits / best)
    right, top = sure.argmax(axis=1) == truth, sure.max(axis=1)
    order = np.argsort(-top)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= TRUST
    threshold = float(top[order][np.flatnonzero(good).max()]) if good.any() else 1.0
    return LanguageModel(languages, scores.astype(np.float32), bias, float(best), threshold)


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, training, rows: int = SAMPLE_ROWS,
          ) -> LanguageModel | None:
    """A model from the labelled rows that the condition admits, or None without any."""
    source = docs.where(training).select(F.col(id_col).alias("__doc_id"), F.col(text_col).alias("__text"),
                                         F.col(lang_col).alias("__label"))
    sample = labelled_sample(source.select("__doc_id", "__label").distinct(), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, texts in lists(batches, "__check", "__label", "__text"):
            kept = [(i, y, bag(t)) for i, y, t in zip(ids, labels, texts) if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in kept], pa.bool_()), pa.array([k[1] for k in kept], pa.string()),
                 pa.array([k[2][0] for k in kept], pa.list_(pa.int32())),
                 pa.array([k[2][1] for k in kept], pa.list_(pa.float64()))],
                names=["check", "label", "at", "share"])

    part = sampled_texts(source, sample).withColumn(
        "__check", F.pmod(F.xxhash64("__doc_id", F.lit(11)), F.lit(5)) == 0)
    table = part.select("__check", "__label", "__text").mapInArrow(
        run, "check boolean, label string, at array<int>, share array<double>").toArrow()
    if not table.num_rows:
        return None
    labels = table.column("label").to_pylist()
    languages = sorted(set(labels))
    bags = [(np.asarray(a.values), np.asarray(s.values)) for a, s in zip(table.column("at"), table.column("share"))]
    order = sorted(range(len(bags)), key=lambda i: (labels[i], len(bags[i][0]), bags[i][0].tolist()[:8]))
    number = {x: n for n, x in enumerate(languages)}
    return fit([bags[i] for i in order], np.array([number[labels[i]] for i in order]), languages,
               np.array([table.column("check")[i].as_py() for i in order]))


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score, rejected), one per document, without a shuffle.

    lang_pred is the likeliest language the model has learned and score its calibrated
    probability; rejected says that it is below the trusted level. A text that is null
    or has no letter is `und` with score 0 and rejected, and so is every text if there
    was nothing to learn from. The whole text counts. Repeated rows and null ids stay.
    """
    source = docs.select(F.col(id_col).alias("__doc_id"), F.col(text_col).alias("__text"))
    id_type = source.schema["__doc_id"].dataType
    arrow_type = to_arrow_type(id_type)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for ids, texts in lists(batches, "__doc_id", "__text"):
            names, scores, rejected = [], [], []
            for text in texts:
                if model is None or not has_letter(text):
                    name, score, no = UNKNOWN, 0.0, True
                else:
                    p = model.probabilities(text)
                    name, score = model.languages[int(p.argmax())], float(p.max())
                    no = score < model.threshold
                names.append(name)
                scores.append(score)
                rejected.append(no)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow_type), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(rejected, pa.bool_())], names=["__doc_id", "lang_pred", "score", "rejected"])

    return source.mapInArrow(
        run, f"__doc_id {id_type.simpleString()}, lang_pred string, score double, rejected boolean"
    ).withColumnRenamed("__doc_id", id_col)


def held_out(id_col: str = "doc_id"):
    """Documents whose id's crc32 leaves 2 modulo 4; not those without an id."""
    return F.coalesce(id_remainder(F.col(id_col), 4) == 2, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out and predict all of them."""
    model = train(docs, "doc_id", "text", "lang", ~held_out())
    return predict(docs, model).withColumn("held_out", held_out())
