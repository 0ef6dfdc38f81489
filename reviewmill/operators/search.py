"""Exact cosine top-k of a table of queries over an index table."""

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from reviewmill.functions.lexicon import NEGATIVE_TOPIC, WIDEN_PER_ROUND
from reviewmill.functions.numbers import clamp_score, percent_text
from reviewmill.functions.text import is_not_blank
from reviewmill.operators.skew import broadcast_if_small, top_n_per_group
from reviewmill.session import materialise

# Bytes of query vectors that one pass over the index holds in each task.
PASS_BYTES = 8 << 20
# Index rows that a task multiplies with them at a time.
ROWS_PER_PRODUCT = 2048
SCORE_SCALE = 1e6
# Centres of a grouped index, at most; index rows per centre, about.
MOST_GROUPS, ROWS_PER_GROUP = 1024, 4096


def cut_scores(scores: np.ndarray) -> np.ndarray:
    """Scores to six decimals. Rows are ranked by these and then by id, so the order
    does not hang on the last bits of a sum."""
    return np.floor(scores * SCORE_SCALE + 0.5) / SCORE_SCALE


def effective_filters(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Queries with `effective_filter`: the wanted sentiment, or null where there is
    none or where no indexed row has it. The index is reduced to its distinct
    sentiments in the map tasks."""
    present = index.select(F.col("sentiment").alias("effective_filter")).where(
        F.col("effective_filter").isNotNull()).distinct()
    return queries.join(present, queries["sentiment_filter"] == present["effective_filter"], "left")


def widened_k(top_k: Column, round_col: Column) -> Column:
    return top_k + F.lit(WIDEN_PER_ROUND) * round_col


@dataclass(frozen=True)
class GroupedIndex:
    """An index whose rows lie by their nearest centre, one folder per group. `groups` has
    for every group and sentiment the rows and the largest angle to the centre; the centres
    are rows of the index itself. Group -1 holds rows that are not of unit length."""

    rows: DataFrame
    groups: DataFrame
    centres: np.ndarray

    def read_share(self, groups: Iterable[int]) -> float:
        """The share of the index rows that lie in the given groups."""
        of = F.sum(F.when(F.col("group").isin(list(groups)), F.col("n")).otherwise(0))
        return (self.groups.agg(of / F.sum("n")).first()[0] or 0.0) if list(groups) else 0.0


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def group_index(index: DataFrame, path: str, most: int = MOST_GROUPS) -> GroupedIndex:
    """Write an index (id, text, sentiment, rating, embedding) by nearest centre.

    Centres are a repeatable draw of its rows, in proportion to their number up to `most`.
    Every row is assigned and every angle measured, so searches stay exact.
    """
    spark = index.sparkSession
    total = index.count()
    drawn = index.select("embedding").orderBy(F.md5(F.to_json(F.struct("embedding")).cast("binary"))).limit(
        max(1, min(most, total // ROWS_PER_GROUP, 4096))).toArrow().column("embedding").to_pylist()
    width = len(drawn[0]) if drawn else 1
    centres = np.unique(np.array(drawn, dtype=np.float64).reshape(-1, width), axis=0)
    norms = np.linalg.norm(centres, axis=1)
    centres = centres[np.abs(norms - 1) < 1e-3] / norms[np.abs(norms - 1) < 1e-3][:, None]
    shared = spark.sparkContext.broadcast(centres)
    narrow = index.schema
    names = index.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            x = _matrix(batch.column("embedding"), width)
            length = np.linalg.norm(x, axis=1)
            unit = np.abs(length - 1) < 1e-3
            if len(centres):
                scores = x @ centres.T
                group = np.where(unit, scores.argmax(axis=1), -1)
                near = scores.max(axis=1) / np.where(length > 0, length, 1)
            else:
                group, near = np.full(len(x), -1), np.zeros(len(x))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(group.astype(np.int32)), pa.array(np.arccos(np.clip(near, -1, 1)))],
                names=[*names, "group", "angle"])

    placed = index.mapInArrow(place, StructType([
        *narrow.fields, StructField("group", IntegerType()), StructField("angle", DoubleType())]))
    # a group that holds most of the rows is still written by many tasks
    placed.repartition(F.col("group"), F.pmod(F.xxhash64("embedding", "id"), F.lit(8))).write.partitionBy(
        "group").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    groups = materialise(rows.groupBy("group", "sentiment").agg(
        F.count("*").alias("n"), F.max("angle").alias("angle")), "index-groups")
    return GroupedIndex(rows.drop("angle"), groups, centres)


@dataclass(frozen=True)
class _Block:
    """Queries of one pass. `reads[q, g]`: query q reads group g; without groups, all."""

    vectors: np.ndarray
    ks: np.ndarray
    wanted: list[str | None]
    reads: np.ndarray | None = None


def _passes(queries: DataFrame) -> Iterator[pa.Table]:
    """Blocks of queries of at most about PASS_BYTES. The driver and the tasks hold the
    vectors of one block at a time."""
    columns = materialise(queries.select("query_id", "vector", "k", "effective_filter"), "queries")
    size = columns.agg(F.coalesce(F.sum(8 * F.size("vector") + 64), F.lit(0))).first()[0]
    blocks = -(-size // PASS_BYTES)
    for b in range(blocks):
        part = columns.where(F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks)) == b).toArrow()
        if part.num_rows:
            yield part.combine_chunks()


class _Best:
    """A query's k best rows so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0), []

    def add(self, scores: np.ndarray, ids: list) -> None:
        if not len(scores):
            return
        scores, ids = np.concatenate([self.scores, scores]), self.ids + ids
        if len(scores) > self.k:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            above = np.flatnonzero(scores > edge).tolist()
            ties = heapq.nsmallest(self.k - len(above), np.flatnonzero(scores == edge).tolist(),
                                   key=lambda i: (1, 0) if ids[i] is None else (0, ids[i]))
            kept = above + ties
            scores, ids = scores[kept], [ids[i] for i in kept]
        self.scores, self.ids = scores, ids


def _local_top(batch: pa.RecordBatch, block: _Block, best: list[_Best]) -> None:
    """Merge one batch of index rows into each query's best."""
    rows = _matrix(batch.column("embedding"), block.vectors.shape[1])
    ids = batch.column("id").to_pylist()
    asking = np.arange(len(best))
    if block.reads is not None:
        group = batch.column("group").to_numpy()
        if len(kinds := np.unique(group)) > 1:
            for g in kinds:
                _local_top(batch.take(pa.array(np.flatnonzero(group == g))), block, best)
            return
        asking = np.flatnonzero(block.reads[:, kinds[0]])
    scores = cut_scores(rows @ block.vectors[asking].T)
    sentiment = np.array(batch.column("sentiment").to_pylist(), dtype=object)
    masks = {w: np.flatnonzero(sentiment == w) for w in {block.wanted[q] for q in asking} if w is not None}
    for column, q in enumerate(asking.tolist()):
        s, at = scores[:, column], None
        if block.wanted[q] is not None:
            at = masks[block.wanted[q]]
            s = s[at]
        mine = best[q]
        if len(mine.scores) >= mine.k:
            enough = np.flatnonzero(s >= mine.scores.min())
        else:
            enough = np.arange(len(s))
        if len(enough) > mine.k:
            edge = np.partition(s[enough], len(enough) - mine.k)[len(enough) - mine.k]
            enough = enough[s[enough] >= edge]
        places = enough if at is None else at[enough]
        mine.add(s[enough], [ids[i] for i in places.tolist()])


def _scan(rows: DataFrame, block: _Block) -> DataFrame:
    """Rows (_query, id, score): each task's best for the block's queries."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    id_type = rows.schema["id"].dataType
    arrow_type = to_arrow_type(id_type)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = [_Best(int(k)) for k in block.ks]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_PRODUCT):
                _local_top(batch.slice(start, ROWS_PER_PRODUCT), block, best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best)), [len(b.ids) for b in best]).astype(np.int64)),
             pa.array([i for b in best for i in b.ids], arrow_type),
             pa.array(np.concatenate([b.scores for b in best]))], ["_query", "id", "score"])

    # written per scan: later ones do not run earlier ones again
    return materialise(rows.mapInArrow(search, StructType([
        StructField("_query", LongType()), StructField("id", id_type), StructField("score", DoubleType())])), "hits")


def _ranked(hits: DataFrame, keys: list[str], k: Column | int, rank: str = "rank") -> DataFrame:
    return top_n_per_group(hits, keys, [F.desc("score"), F.asc_nulls_last("id")], k, F.col("id"), rank)


def _grouped_scan(index: GroupedIndex, block: _Block) -> tuple[DataFrame, set[int]]:
    """The hits of a block, and the groups that were read for it.

    First every query reads the groups that may hold its best rows, until they have k rows
    that pass its filter. A group whose bound, the cosine of the angle between query and
    centre less the group's own, is below the kth score so found cannot hold a better row;
    the others are read in a second scan.
    """
    table = index.groups.collect()  # a row per group and sentiment
    numbers = sorted({r["group"] for r in table})
    angle = np.array([max(r["angle"] for r in table if r["group"] == g) for g in numbers])
    spans = np.linalg.norm(block.vectors, axis=1)
    bound = np.full((len(block.ks), len(numbers)), np.inf)
    for column, g in enumerate(numbers):
        if g >= 0:
            cosine = np.clip(block.vectors @ index.centres[g] / np.where(spans > 0, spans, 1), -1, 1)
            # lengths of rows are 1 within a thousandth
            bound[:, column] = spans * np.cos(np.maximum(np.arccos(cosine) - angle[column] - 1e-6, 0))
            bound[:, column] = bound[:, column] + 0.001 * np.abs(bound[:, column]) + 2e-6
    held = {w: np.array([sum(r["n"] for r in table if r["group"] == g and w in (None, r["sentiment"])) for g in numbers])
            for w in set(block.wanted)}
    first = np.zeros(bound.shape, dtype=bool)
    for q, (k, w) in enumerate(zip(block.ks, block.wanted)):
        order = np.argsort(-bound[q], kind="stable")
        enough = int(np.searchsorted(np.cumsum(held[w][order]), k)) + 1
        first[q, order[:enough]] = True

    def scan(wanted: np.ndarray) -> DataFrame | None:
        used = [g for g, any_ in zip(numbers, wanted.any(axis=0)) if any_]
        if not used:
            return None
        reads = np.zeros((len(block.ks), max(numbers) + 2), dtype=bool)  # group -1 is the last column
        reads[:, [g for g in numbers]] = wanted
        return _scan(index.rows.where(F.col("group").isin(used)).select("id", "sentiment", "embedding", "group"),
                     replace(block, reads=reads))

    hits = scan(first)
    kth = np.full(len(block.ks), -np.inf)
    for r in _ranked(hits, ["_query"], int(block.ks.max())).groupBy("_query").agg(
            F.collect_list("score").alias("s")).collect():  # k scores of each of the block's queries
        scores = sorted(r["s"], reverse=True)
        if len(scores) >= block.ks[r["_query"]]:
            kth[r["_query"]] = scores[block.ks[r["_query"]] - 1]
    usable = np.array([held[w] > 0 for w in block.wanted])
    second = ~first & usable & (bound >= kth[:, None])
    more = scan(second)
    read = {g for g, any_ in zip(numbers, (first | second).any(axis=0)) if any_}
    return (hits if more is None else hits.unionByName(more)), read


def topk(index: DataFrame | GroupedIndex, queries: DataFrame) -> DataFrame:
    """Rows (query_id, rank, id, score), the k best index rows of each query.

    `index` has id, sentiment and a unit-length embedding; `queries` has query_id,
    vector, k and sentiment_filter; ids are of any type. Every task multiplies its index
    rows with the block of query vectors and keeps k rows per query, so pairs never leave
    a task; what is shuffled is at most k rows per query and task. Queries beyond one block
    take further passes. Of a grouped index only those groups are read that can hold one of
    the k best; the result is the same.
    """
    grouped = isinstance(index, GroupedIndex)
    rows = index.rows if grouped else index
    spark, found = rows.sparkSession, None
    id_field = queries.schema["query_id"]
    for part in _passes(effective_filters(queries, index.groups if grouped else rows)):
        wanted = part.column("effective_filter").to_pylist()
        block = _Block(np.array(part.column("vector").to_pylist(), dtype=np.float64),
                       part.column("k").to_numpy().astype(np.int64), wanted)
        if grouped:
            hits, _ = _grouped_scan(index, block)
        else:
            narrow = rows.select("id", "sentiment", "embedding")
            if None not in wanted:  # reaches the scan when every query filters
                narrow = narrow.where(F.col("sentiment").isin(sorted(set(wanted))))
            hits = _scan(narrow, block)
        names = materialise(spark.createDataFrame(
            list(zip(range(part.num_rows), part.column("query_id").to_pylist(), block.ks.tolist())),
            StructType([StructField("_query", LongType()), id_field, StructField("k", LongType())])), "query-ids")
        # one row per query of the block
        ranked = _ranked(hits.join(F.broadcast(names), "_query"), ["_query", "query_id"], F.col("k")).select(
            "query_id", "rank", "id", clamp_score(F.col("score")).alias("score"))
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        return spark.createDataFrame([], StructType([
            id_field, StructField("rank", IntegerType()), rows.schema["id"], StructField("score", DoubleType())]))
    return found


def search(index: DataFrame | GroupedIndex, queries: DataFrame) -> DataFrame:
    """Hits with text, sentiment and rating. Blank queries give no rows.

    The winners are few; they pick their rows from the index in a second, narrow
    pass instead of carrying every text through the ranking.
    """
    asked = queries.where(is_not_blank(F.col("query")))
    hits = materialise(topk(index, asked), "hits")
    rows = index.rows if isinstance(index, GroupedIndex) else index
    details = rows.select(F.col("id").alias("_id"), "text", "sentiment", "rating")
    return details.join(broadcast_if_small(hits), F.col("_id").eqNullSafe(F.col("id"))).select(
        "query_id", "rank", "id", "text", "sentiment", "rating", "score")


def negative_queries(queries: DataFrame) -> DataFrame:
    """Queries for complaints: negative rows only, a default topic where none is given."""
    return queries.withColumn("query", F.when(is_not_blank(F.col("query")), F.col("query"))
                              .otherwise(F.lit(NEGATIVE_TOPIC))) \
        .withColumn("sentiment_filter", F.lit("Negative"))


def result_table(hits: DataFrame) -> DataFrame:
    """Hits with a percent match text."""
    return hits.select("query_id", "rank", "id", percent_text(F.col("score")).alias("match"),
                       F.coalesce("sentiment", F.lit("—")).alias("sentiment"), "rating", "text")
