"""Report requests from search to checked report, in at most three rounds."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from reviewmill.functions.lexicon import MAX_REFINE_ROUNDS
from reviewmill.functions.text import is_not_blank, strip
from reviewmill.operators import reports, search
from reviewmill.operators.small_clusters import cluster_groups, group_clusters, group_weights
from reviewmill.session import materialise

STEP = "array<struct<step:string,info:string>>"
LIST = f"array<{reports.CLUSTER}>"


def _retrieve(index: DataFrame, state: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The reviews of each request, with their place: (report_id, id, position, text)."""
    asked = state.select(F.col("report_id").alias("query_id"), "query", "sentiment_filter",
                         search.widened_k(F.col("top_k"), F.col("round")).alias("k"))
    queries = materialise(embed(asked).withColumnRenamed("embedding", "vector"), "report-queries")
    hits = search.search(index, queries).where(is_not_blank(F.col("text")))
    return materialise(hits.select(F.col("query_id").alias("report_id"), "id",
                                   F.col("rank").alias("position"),
                                   strip(F.col("text")).alias("text")), "report-hits")


def _cluster(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters of each request and its reviews in round-robin order."""
    weighted = materialise(group_weights(docs), "report-weights")
    labels = materialise(cluster_groups(docs, weighted), "report-labels")
    clusters = group_clusters(weighted, labels)
    listed = clusters.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("size")).alias("neg"), "cluster_id", "size", "keywords"))).alias("_c")).select(
        "report_id", F.transform("_c", lambda c: F.struct(
            c["cluster_id"].alias("cluster_id"), c["size"].alias("size"),
            c["keywords"].alias("keywords"))).cast(LIST).alias("clusters"))
    turn = F.row_number().over(Window.partitionBy("report_id", "cluster_id").orderBy("position"))
    sizes = clusters.select("report_id", "cluster_id", "size")
    placed = (
        docs.join(labels, ["report_id", "position"], "left")
        .join(sizes, ["report_id", "cluster_id"], "left")
        # without clusters the order of retrieval stays
        .withColumn("_turn", F.when(F.col("cluster_id").isNull(), F.col("position")).otherwise(turn))
    )
    # a request retrieves k reviews at most, so its list is short
    ordered = placed.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct(
        "_turn", (-F.coalesce("size", F.lit(0))).alias("neg"), "cluster_id", "position",
        "text")))["text"].alias("reviews"))
    return listed, ordered


def template_round(state: DataFrame) -> DataFrame:
    """Reports of the built-in template, for `run_reports(write=...)`."""
    return state.withColumn("report", reports.template_report(F.col("clusters"), F.col("reviews"))) \
        .drop("prompt")


def run_reports(requests: DataFrame, index: DataFrame, embed: Callable[[DataFrame], DataFrame],
                write: Callable[[DataFrame], DataFrame] = template_round) -> DataFrame:
    """Final state of every request.

    `requests` has report_id, query, domain, language, rule_corrected_count, top_k and
    sentiment_filter; `embed` adds `embedding` to a frame with `query`; `write` turns
    a frame with `prompt` into one with `report`. Each round is written once, so a
    costly writer is never called again by a recomputation, and only requests whose
    report misses a cluster go into the next round.
    """
    state = reports.normalise_queries(requests).withColumns({
        "round": F.lit(0), "missed": F.array().cast(LIST),
        "step_log": F.array(F.struct(F.lit("parse query").alias("step"), F.when(
            F.col("is_generic"), F.lit("empty topic, generic words used")).otherwise(
            F.concat(F.lit("topic: "), F.col("original_query"))).alias("info"))).cast(STEP)})
    state = state.withColumn("step_log", reports.log_step(
        F.col("step_log"), "route domain", F.concat_ws(", ", "domain", "language")))
    state = materialise(state, "report-state")
    done = None
    for round_no in range(MAX_REFINE_ROUNDS + 1):
        docs = _retrieve(index, state, embed)
        clusters, ordered = _cluster(docs)
        none = F.array().cast(LIST)
        ready = (
            state.join(clusters, "report_id", "left").join(ordered, "report_id", "left")
            .withColumn("clusters", F.coalesce("clusters", none))
            .withColumn("reviews", F.coalesce("reviews", F.array().cast("array<string>")))
        )
        notes = F.concat(reports.cluster_note(F.col("clusters")),
                         reports.retry_note(F.col("round"), F.col("missed")))
        ready = ready.withColumn("prompt", F.when(F.size("reviews") > 0, reports.prompt(
            F.col("domain"), F.col("language"), F.col("rule_corrected_count"), notes,
            F.col("reviews"))))
        written = materialise(write(ready), f"report-round{round_no}")
        checked = (
            written.withColumn("_lower", F.lower("report"))
            .withColumn("error", F.lit(None).cast("string"))
            .select("*", *reports.coverage_columns())
            .withColumn("step_log", _round_log())
            .drop("_lower", "error", "missed")
        )
        again = reports.keep_looping(F.col("is_valid"), F.col("round"))
        last = checked.where(~again) if round_no < MAX_REFINE_ROUNDS else checked
        final = last.select(*_final_columns())
        done = final if done is None else done.unionByName(final)
        if round_no == MAX_REFINE_ROUNDS:
            break
        following = checked.where(again).select(
            *[c for c in state.columns if c not in ("query", "round", "missed", "step_log")],
            reports.refined_query(F.col("original_query"), F.col("missed_clusters")).alias("query"),
            (F.col("round") + 1).alias("round"), F.col("missed_clusters").alias("missed"),
            "step_log")
        following = following.withColumn("step_log", reports.log_step(
            F.col("step_log"), "refine query", F.concat(F.lit("new query: "), F.col("query"))))
        state = materialise(following, "report-state")
        if state.isEmpty():
            break
    return done


def _round_log():
    """Step log with the retrieve, cluster, write and check steps of a round."""
    log = F.col("step_log")
    log = reports.log_step(log, "retrieve", F.concat(
        F.size("reviews").cast("string"), F.lit(" reviews for "), F.col("query")))
    summary = F.array_join(F.transform("clusters", lambda c: F.concat(
        F.lit("#"), c["cluster_id"].cast("string"), F.lit("("), c["size"].cast("string"),
        F.lit("): "), F.array_join(F.slice(c["keywords"], 1, 3), ", "))), " · ")
    log = reports.log_step(log, "cluster aspects", F.when(F.size("clusters") > 0, summary).otherwise(
        F.lit("no clusters, all reviews used as they are")))
    log = reports.log_step(log, "write report", F.concat(
        F.size("reviews").cast("string"), F.lit(" reviews")))
    return reports.log_step(log, "check report", F.concat(
        F.size("covered_clusters").cast("string"), F.lit("/"), F.size("clusters").cast("string"),
        F.lit(" clusters covered")))


def _final_columns() -> list[str]:
    return ["report_id", "original_query", "query", "round", "clusters", "reviews", "report",
            "is_valid", "coverage_pct", "covered_clusters", "missed_clusters", "step_log"]
