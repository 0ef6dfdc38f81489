"""Mix sources to target weights by weighted fair queueing."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewmill.llm.common import bounded_broadcast, materialise, part_totals, partitions, word_count
from reviewmill.operators.skew import dense_index

SEED = "mix:"
#: Hex digits of the shuffle key that cut a source into sub-groups, 4096 of them.
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class MixPlan:
    """What a mix has decided: a table of sources, where each sub-group of a source
    starts, and the last (virtual finish time, source number) that still goes in."""

    sources: DataFrame
    starts: DataFrame
    repeats: int
    cut: tuple[float, int] | None


def shuffle_key(doc_id: Column) -> Column:
    """The shuffled place of a document: a digest of its id, equal in every run."""
    return F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _sources(thin: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_no, source_size, weight): weights repeat along the sources in
    code point order, null last."""
    sizes = thin.groupBy("__source").agg(F.sum("__size").alias("__source_size")).withColumn(
        "__order", F.struct(F.col("__source").isNull(), F.coalesce("__source", F.lit(""))))
    numbered = dense_index(sizes, "__order", "__source_no", lambda df: materialise(df, "mix-order"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("__source_no") % len(weights) + 1).cast("int"))
    return materialise(numbered.select("__source", "__source_no", "__source_size", weight.alias("__weight")),
                       "mix-sources")


def water_level(sources: DataFrame, budget: float, repeats: int) -> float:
    """The level at which sources filled to min(level * weight, repeats * size) hold
    the budget. Every round closes the sources that are full and shares their excess
    among the others; it ends when no further source is full."""
    cap = F.col("__source_size") * repeats
    level, closed = 0.0, -1
    while True:
        full = cap <= F.col("__weight") * level
        row = sources.agg(F.count_if(full).alias("n"), F.sum(F.when(full, cap)).alias("full"),
                          F.sum(F.when(~full, F.col("__weight"))).alias("open")).first()
        if not row["open"] or row["n"] == closed:
            return level
        closed, level = row["n"], (budget - (row["full"] or 0)) / row["open"]


def _place(rows: DataFrame, plan_sources: DataFrame, starts: DataFrame | None) -> DataFrame:
    """Add to rows with __doc_id, __source and __size their source's columns and
    __cum, the words of the source up to and with the row in shuffled order."""
    rows = rows.withColumn("__key", shuffle_key(F.col("__doc_id"))).withColumn(
        "__bucket", F.substring("__key", 1, BUCKET_DIGITS))
    table = bounded_broadcast(plan_sources.withColumnRenamed("__source", "__named"))
    rows = rows.join(table, F.col("__source").eqNullSafe(F.col("__named"))).drop("__named")
    if starts is None:
        return rows
    inside = Window.partitionBy("__source_no", "__bucket").orderBy("__key", "__doc_id", "__size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (rows.join(bounded_broadcast(starts), ["__source_no", "__bucket"])
            .withColumn("__cum", F.col("__start") + F.sum("__size").over(inside)))


def _key(turn: Column) -> Column:
    """A document's place in the queue when it is offered for the nth time, from 0."""
    finish = (turn * F.col("__source_size") + F.col("__cum")) / F.col("__weight")
    return F.struct(finish.alias("finish"), F.col("__source_no").alias("source_no"))


def plan_mix(thin: DataFrame, weights: tuple[float, ...] = (1, 2, 3), repeats: int = 3,
             budget: int | None = None) -> MixPlan:
    """Decide a mix of rows (__doc_id, __source, __size), a written table.

    Every document is offered `repeats` times; its virtual finish time is the words
    of its source up to its end divided by the source's weight. All offers are
    range-sorted by that time, and the order is cut where the words reach the budget
    (all words unless given). A source that has run out of offers leaves its share to
    the others in proportion to their weights.
    """
    spark = thin.sparkSession
    sources = _sources(thin, weights)
    if budget is None:
        budget = sources.agg(F.coalesce(F.sum("__source_size"), F.lit(0))).first()[0]
    level = water_level(sources, budget, repeats)
    sources = sources.withColumn(
        "__target", F.least(F.col("__weight") * level, (F.col("__source_size") * repeats).cast("double")))
    sums = _place(thin, sources, None).groupBy("__source_no", "__bucket").agg(F.sum("__size").alias("__sum"))
    before = Window.partitionBy("__source_no").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(sums.select("__source_no", "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(
        0)).alias("__start")), "mix-starts")
    offers = _place(thin.where(F.col("__size") > 0), sources, starts).withColumn(
        "__turn", F.explode(F.array(*[F.lit(i) for i in range(repeats)]))).select(
        _key(F.col("__turn")).alias("__offer"), "__size")
    placed = materialise(
        offers.repartitionByRange(partitions(spark), "__offer").sortWithinPartitions("__offer").withColumn(
            "__part", F.spark_partition_id()), "mix-offers")
    return MixPlan(sources, starts, repeats, _cut(placed, budget))


def _cut(placed: DataFrame, budget: int) -> tuple[float, int] | None:
    """The last offer whose words, with all before it, fit the budget."""
    last, before = None, 0
    for row in part_totals(placed, "__part", "__size", F.col("__offer")):  # a row per range partition
        if before + row["total"] > budget:
            running = F.sum("__size").over(Window.partitionBy("__part").orderBy("__offer").rowsBetween(
                Window.unboundedPreceding, Window.currentRow))
            inside = placed.where(F.col("__part") == row["__part"]).withColumn("__run", running).where(
                F.col("__run") <= budget - before).agg(F.max("__offer")).first()[0]
            last = inside or last
            break
        last, before = row["last"], before + row["total"]
    return (last["finish"], last["source_no"]) if last else None


def apply_mix(rows: DataFrame, plan: MixPlan) -> DataFrame:
    """Add times (how often the mix takes a row), taken, target and source size."""
    times = F.lit(0)
    if plan.cut:
        cut = F.struct(F.lit(plan.cut[0]).alias("finish"), F.lit(plan.cut[1]).alias("source_no"))
        for turn in range(plan.repeats):
            times = times + (_key(F.lit(turn)) <= cut).cast("int")
    return _place(rows, plan.sources, plan.starts).withColumn("__times", F.coalesce(times, F.lit(0)))


def mix_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  **options) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken, times), one per document.

    Null texts and texts without a word have size 0. A null source is a source of its
    own. Repeated rows count each for itself. An empty table gives no rows. Other
    columns are ignored.
    """
    thin = materialise(docs.select(F.col(id_col).alias("__doc_id"), F.col(source_col).alias("__source"),
                                   word_count(F.col(text_col)).alias("__size")), "mix-sizes")
    done = apply_mix(thin, plan_mix(thin, **options))
    return done.select(F.col("__doc_id").alias(id_col), F.col("__source").alias(source_col),
                       F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                       F.col("__target").alias("target"), (F.col("__size") * F.col("__times")).alias("taken"),
                       F.col("__times").alias("times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its own columns."""
    rows = docs.withColumns({"__doc_id": F.col(id_col), "__source": F.col(source_col),
                             "__size": word_count(F.col(text_col))})
    thin = materialise(rows.select("__doc_id", "__source", "__size"), "mix-sizes")
    done = apply_mix(rows, plan_mix(thin, **options))
    return done.where(F.col("__times") > 0).withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(docs.columns)
