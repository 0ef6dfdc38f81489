"""Hard negatives by exact inner-product search in cover trees of norm-augmented vectors."""

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.llm.common import materialise
from reviewmill.operators.skew import top_n_per_group

#: Entries are multiplied by SCALE and floored.
SCALE = 256
#: Positives of an anchor; negatives of a positive; window of a negative's score, in
#: hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows of a tree, about; rows of a leaf, at most; children of a node, at most.
TREE, LEAF, CHILDREN = 2048, 64, 48
#: Vectors whose nearest one names the tree that a row goes to, at most; bytes of anchors
#: that one pass carries.
CENTRES, PASS_BYTES = 1024, 16 << 20
SCHEMA = "anchor long, window int, id long, score long"


# ---------------------------------------------------------------- the tree

@dataclass
class Node:
    """A centre (a row of the tree), the angle that covers all rows below it, and either
    children or the rows themselves."""

    centre: int
    angle: float
    rows: np.ndarray | None
    children: list["Node"]
    at: np.ndarray | None = None  # the children's centres


class CoverTree:
    """Rows of (ids, labels, vectors). With one more coordinate, the root of the largest
    squared norm less their own, all vectors lie on one sphere; a query gets 0 there, so
    its inner products are the cosines of angles on that sphere, times constants."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, radius: float):
        # repeated rows count once
        order = np.lexsort((ids, labels))
        ids, labels, x = ids[order], labels[order], x[order]
        again = np.zeros(len(ids), dtype=bool)
        again[1:] = (ids[1:] == ids[:-1]) & (labels[1:] == labels[:-1]) & (x[1:] == x[:-1]).all(axis=1)
        self.ids, self.labels, self.x, self.radius = ids[~again], labels[~again], x[~again], radius
        last = np.sqrt(np.maximum(radius * radius - (self.x ** 2).sum(axis=1), 0))
        self.sphere = np.hstack([self.x, last[:, None]]) / (radius or 1.0)
        rows = np.arange(len(self.ids))
        self.root = self._node(0, rows, self._angles(0, rows)) if len(rows) else None

    def _angles(self, centre: int, rows: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(self.sphere[rows] @ self.sphere[centre], -1, 1))

    def _node(self, centre: int, rows: np.ndarray, angles: np.ndarray) -> Node:
        """Children are a net of rows that lie further apart than half the node's angle,
        the furthest first; each row goes to its nearest. Where so many rows are that far
        apart that the net outgrows CHILDREN, it stays that coarse. A node's angle is
        measured on its rows, so the bounds hold in either case."""
        most = float(angles.max())
        if len(rows) <= LEAF or most <= 1e-9:
            return Node(centre, most, rows, [])
        net, nearest, owner = [centre], angles.copy(), np.zeros(len(rows), dtype=np.int64)
        while len(net) < CHILDREN:
            far = int(nearest.argmax())
            if nearest[far] <= most / 2:
                break
            to = self._angles(rows[far], rows)
            closer = to < nearest
            owner[closer], nearest[closer] = len(net), to[closer]
            net.append(int(rows[far]))
        children = [self._node(c, rows[owner == i], nearest[owner == i]) for i, c in enumerate(net)
                    if (owner == i).any()]
        return Node(centre, most, None, children, np.array([c.centre for c in children]))

    def search(self, queries: np.ndarray, low, high: np.ndarray, visit) -> None:
        """Hand every leaf that may hold a score from `low` to `high` to `visit`.

        Best first: the node of the highest bound over all queries is opened next, and its
        bounds are compared with `low()` as it is then. `visit(queries, rows, scores)` gets
        the numbers of the queries that the leaf is open for.
        """
        if self.root is None or not len(queries):
            return
        span = np.linalg.norm(queries, axis=1) * self.radius
        safe = np.where(span > 0, span, 1.0)
        count = itertools.count()

        def bounds(scores: np.ndarray, who: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
            at = np.arccos(np.clip(scores / safe[who], -1, 1))
            slack = 0.25 + 1e-7 * span[who]  # scores are whole numbers; angles near 0 lose half their digits
            return (span[who] * np.cos(np.maximum(at - angle, 0)) + slack,
                    span[who] * np.cos(np.minimum(at + angle, np.pi)) - slack)

        everyone = np.arange(len(queries))
        heap: list = []

        def offer(node: Node, who: np.ndarray, scores: np.ndarray) -> None:
            up, down = bounds(scores, who, node.angle)
            open_ = (up >= low()[who]) & (down <= high[who])
            if open_.any():
                heapq.heappush(heap, (-float(up[open_].max()), next(count), node, who[open_], up[open_]))

        offer(self.root, everyone, queries @ self.x[self.root.centre])
        while heap:
            _, _, node, who, up = heapq.heappop(heap)
            who = who[up >= low()[who]]
            if not len(who):
                continue
            if node.rows is not None:
                visit(who, node.rows, np.rint(queries[who] @ self.x[node.rows].T))
                continue
            scores = queries[who] @ self.x[node.at].T
            for i, child in enumerate(node.children):
                offer(child, who, scores[:, i])


class Best:
    """The k best (score, id) of several lists per query: higher scores first, then
    smaller ids. A pair counts once."""

    def __init__(self, lists: int, k: int, floor: np.ndarray):
        self.score = np.full((lists, k), -np.inf)
        self.id = np.full((lists, k), np.iinfo(np.int64).max)
        self.floor = floor  # a score that the kth one surely reaches

    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, which: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores (list, id), -inf where a row is no candidate of the list."""
        better = scores.max(axis=1) >= self.score[which, -1]
        better &= scores.max(axis=1) > -np.inf
        which, scores = which[better], scores[better]
        if not len(which):
            return
        k = self.score.shape[1]
        if scores.shape[1] > 4 * k and len(np.unique(ids)) == len(ids):
            # rows below the kth best of the leaf itself cannot enter
            cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
            keep = (scores >= cut[:, None]).any(axis=0)
            ids, scores = ids[keep], scores[:, keep]
        score = np.hstack([self.score[which], scores])
        each = np.hstack([self.id[which], np.broadcast_to(ids, scores.shape)])
        order = np.lexsort((each, -score), axis=1)
        score, each = np.take_along_axis(score, order, 1), np.take_along_axis(each, order, 1)
        again = np.zeros(score.shape, dtype=bool)
        again[:, 1:] = (score[:, 1:] == score[:, :-1]) & (each[:, 1:] == each[:, :-1])
        if again.any():
            score[again] = -np.inf
            order = np.argsort(-score, axis=1, kind="stable")
            score, each = np.take_along_axis(score, order, 1), np.take_along_axis(each, order, 1)
        self.score[which], self.id[which] = score[:, :k], each[:, :k]


# ---------------------------------------------------------------- searches over many trees

@dataclass
class Block:
    """Anchors of one pass; a window is a list of candidates with scores from low to high."""

    number: np.ndarray
    id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    same: bool             # candidates share the anchor's label, or have another one
    low: np.ndarray        # per anchor and window
    high: np.ndarray
    floor: np.ndarray      # per anchor and window: the kth best score of the sample
    k: int

    def candidates(self, who: np.ndarray, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The scores, -inf for rows that are no candidates."""
        equal = labels[None, :] == self.label[who][:, None]
        fit = equal & (ids[None, :] != self.id[who][:, None]) if self.same else ~equal
        return np.where(fit, scores, -np.inf)

    def collect(self, tree: CoverTree, best: Best) -> None:
        """Put the tree's rows into the lists."""
        windows = self.low.shape[1]

        def low() -> np.ndarray:
            return np.maximum(best.kth().reshape(-1, windows), self.low).min(axis=1)

        def visit(who: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
            ids = tree.ids[rows]
            scores = self.candidates(who, ids, tree.labels[rows], scores)
            for w in range(windows):
                inside = (scores >= self.low[who, w][:, None]) & (scores <= self.high[who, w][:, None])
                best.add(who * windows + w, ids, np.where(inside, scores, -np.inf))

        live = np.flatnonzero((self.low <= self.high).any(axis=1))
        if len(live) == len(self.id):
            tree.search(self.x, low, self.high.max(axis=1), visit)
        else:
            tree.search(self.x[live], lambda: low()[live], self.high[live].max(axis=1),
                        lambda who, rows, scores: visit(live[who], rows, scores))

    def best(self) -> Best:
        return Best(self.low.size, self.k, self.floor.ravel())


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows; those that are shorter get zeros."""
    if not len(column):
        return np.zeros((0, width))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _search(placed: DataFrame, block: Block, width: int, radius: float) -> DataFrame:
    """Rows (anchor, window, id, score): the lists of every task, not yet merged."""
    shared = placed.sparkSession.sparkContext.broadcast(block)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[CoverTree]:
        """The rows of a tree lie one after the other, by id."""
        held: list = []
        key, size = None, 0

        def tree() -> CoverTree:
            return CoverTree(*[np.concatenate(part) for part in zip(*held)], radius)

        for batch in batches:
            keys, ids, labels = (batch.column(c).to_numpy() for c in ("tree", "id", "label"))
            x = _matrix(batch.column("x"), width)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and (keys[a] != key or size >= 2 * TREE):
                    yield tree()
                    held, size = [], 0
                key, size = keys[a], size + b - a
                held.append((ids[a:b], labels[a:b], x[a:b]))
        if held:
            yield tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        best = b.best()
        for tree in trees(batches):
            b.collect(tree, best)
        at, place = np.nonzero(best.score >= np.maximum(best.floor, -1e300)[:, None])
        windows = b.low.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(b.number[at // windows]), pa.array((at % windows).astype(np.int32)),
             pa.array(best.id[at, place]), pa.array(best.score[at, place].astype(np.int64))],
            names=["anchor", "window", "id", "score"])

    return placed.select("tree", "id", "label", "x").mapInArrow(run, SCHEMA)


@dataclass(frozen=True)
class Sample:
    """Rows drawn by a digest of the id: their vectors are the trees' centres."""

    id: np.ndarray
    label: np.ndarray
    x: np.ndarray

    def floor(self, block: Block) -> np.ndarray:
        """Per anchor and window the kth best score of the sample, -inf without so many.
        The sample's rows are in the trees too, so the true kth score is no lower."""
        tree = CoverTree(self.id, self.label, self.x, 1.0) if len(self.id) else None
        if tree is None:
            return block.floor
        best = block.best()
        windows, step = block.low.shape[1], 1024
        for start in range(0, len(block.id), step):
            who = np.arange(start, min(start + step, len(block.id)))
            scores = block.candidates(who, tree.ids, tree.labels, np.rint(block.x[who] @ tree.x.T))
            for w in range(windows):
                inside = (scores >= block.low[who, w][:, None]) & (scores <= block.high[who, w][:, None])
                best.add(who * windows + w, tree.ids, np.where(inside, scores, -np.inf))
        return best.score[:, -1].reshape(block.low.shape)


def _place(rows: DataFrame, sample: Sample, width: int, radius: float, k: int, total: int) -> DataFrame:
    """Written rows (tree, id, label, x), those of a tree in one piece of one task.

    A row goes to the sample vector nearest to it on the sphere. Of equal vectors and
    labels only the k smallest ids of a batch can be among anyone's k best, so the others
    stop here; where a vector's neighbourhood holds more rows than a tree, a digest of the
    id deals them to several trees.
    """
    shared = rows.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sphere(x: np.ndarray) -> np.ndarray:
            last = np.sqrt(np.maximum(radius * radius - (x ** 2).sum(axis=1), 0))
            return np.hstack([x, last[:, None]])

        centres = sphere(shared.value.x)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), width)
            cell = np.concatenate([(sphere(x[i:i + 4096]) @ centres.T).argmax(axis=1)
                                   for i in range(0, len(x), 4096)])
            seen: dict = {}
            keep = np.zeros(len(x), dtype=bool)
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            for i in np.argsort(ids, kind="stable").tolist():
                key = (labels[i], x[i].tobytes())
                held = seen.setdefault(key, [])
                if len(held) < k and ids[i] not in held:
                    held.append(ids[i])
                    keep[i] = True
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell[keep].astype(np.int64)), *[batch.column(c).take(at) for c in ("id", "label", "x")]],
                names=["cell", "id", "label", "x"])

    placed = materialise(rows.select("id", "label", "x").mapInArrow(
        run, "cell long, id long, label long, x array<double>"), "negatives-placed")
    # at most CENTRES rows
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(TREE)).cast("long").alias("parts"))
    dealt = placed.join(F.broadcast(parts), "cell").select(
        (F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("tree"), "id", "label", "x")
    tasks = max(1, min(-(-total // (2 * TREE)), 100_000))
    return materialise(dealt.repartition(tasks, "tree").sortWithinPartitions("tree", "id"), "negatives-trees")


def ready(df: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """Written rows (id, label, x): vectors in whole numbers (as doubles), without rows
    that take no part."""
    vector = F.col(vector_col)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    whole = vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))
    return materialise(df.where(whole & label.isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale)).cast("double")).alias("x")),
        "negatives-rows")


def hard_negatives(df: DataFrame, anchors: Column, label: Column | None = None, id_col: str = "vec_id",
                   label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows for which `anchors` holds look for their best rows of the same label and, for
    each of them, for the best rows of another label whose score lies between `low` and
    `high` hundredths of the positive's. Scores are inner products of floored vectors;
    equal scores are ordered by smaller id. All rows are searched, exactly.

    Rows without an id, label or vector, or with an entry that is null or not finite, take
    no part. Repeated rows count once: a list holds a pair of id and score once. A row of the
    anchor's own id is no positive of it. Shorter vectors count as filled up with zeros; a positive without
    negatives gives no rows, nor does an empty table. Scores are exact while squared norms
    of the floored vectors stay below 2 ** 53. Other columns are not read.
    """
    rows = ready(df, id_col, F.col(label_col) if label is None else label, vector_col, scale)
    spark = df.sparkSession
    total, width, norm = rows.agg(
        F.count("*"), F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not total:
        return spark.createDataFrame([], result)
    width, radius = max(1, width), float(np.sqrt(norm))
    drawn = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(min(CENTRES, -(-total // 64))).toArrow()
    sample = Sample(drawn.column("id").to_numpy(), drawn.column("label").to_numpy(),
                    _matrix(drawn.column("x").combine_chunks(), width))
    k = max(positives + 1, negatives)
    placed = _place(rows, sample, width, radius, k, total)

    queries = materialise(rows.where(anchors).distinct().withColumn(
        "anchor", F.monotonically_increasing_id()), "negatives-anchors")
    passes = max(1, -(-queries.count() * (width + 8) * 8 // PASS_BYTES))

    def blocks(windows: DataFrame | None) -> Iterator[Block]:
        """A bounded number of anchors at a time; in the second search with the windows
        that their positives set."""
        for n in range(passes):
            part = queries.where(F.pmod(F.xxhash64("anchor"), F.lit(passes)) == n)
            if windows is not None:
                part = part.join(windows, "anchor")
            found = part.toArrow()
            if not found.num_rows:
                continue
            if windows is None:
                lo, hi = np.full((found.num_rows, 1), -np.inf), np.full((found.num_rows, 1), np.inf)
            else:
                scores = found.column("scores").to_pylist()
                lo = np.full((found.num_rows, positives), np.inf)
                hi = np.full((found.num_rows, positives), -np.inf)
                for i, each in enumerate(scores):
                    for positive in each:
                        place, score = positive["place"] - 1, positive["positive_score"]
                        lo[i, place], hi[i, place] = -(-low * score // 100), high * score // 100
            block = Block(found.column("anchor").to_numpy(), found.column("id").to_numpy(),
                          found.column("label").to_numpy(), _matrix(found.column("x").combine_chunks(), width),
                          windows is None, lo, hi, np.full(lo.shape, -np.inf),
                          positives if windows is None else negatives)
            block.floor = sample.floor(block)
            yield block

    def best(windows: DataFrame | None, n: int, name: str) -> DataFrame:
        """Each list's n best over all tasks. A pass's rows are written, so that one block
        at a time is on the executors."""
        parts = [materialise(_search(placed, block, width, radius), name) for block in blocks(windows)]
        union = parts[0] if parts else spark.createDataFrame([], SCHEMA)
        for part in parts[1:]:
            union = union.unionByName(part)
        return top_n_per_group(union.distinct(), ["anchor", "window"], [F.desc("score"), F.col("id")], n, F.col("id"))

    near = materialise(best(None, positives, "negatives-near").select(
        "anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.col("rank").alias("place")), "negatives-positives")
    windows = near.groupBy("anchor").agg(F.collect_list(F.struct("place", "positive_score")).alias("scores"))
    far = best(windows, negatives, "negatives-far").withColumn("place", F.col("window") + 1)
    return far.join(near, ["anchor", "place"]).join(
        queries.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def mine_embeddings(df: DataFrame) -> DataFrame:
    """Anchors are ids divisible by 50; ids divisible by 7 carry the next label, as errors
    of labelling that the search has to live with."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(df, F.col("id") % 50 == 0, label)
