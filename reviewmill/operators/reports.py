"""Report requests: queries, prompts, generated texts, coverage and step log."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.functions.lexicon import (DOMAIN_ASPECTS, ERROR_MARK, GENERAL_DOMAIN, GENERIC_QUERY,
                                          MAX_REFINE_ROUNDS, NO_REVIEWS_REPORT, REFINE_SUFFIX,
                                          REPORT_SECTIONS)
from reviewmill.functions.text import clean_text, strip

CLUSTER = "struct<cluster_id:int,size:bigint,keywords:array<string>>"


def normalise_queries(requests: DataFrame) -> DataFrame:
    """Add the trimmed query, whether it was blank, and the text to search for."""
    raw = strip(clean_text(F.col("query")))
    return (
        requests.withColumn("original_query", raw)
        .withColumn("is_generic", F.col("original_query") == "")
        .withColumn("query", F.when(F.col("is_generic"), F.lit(GENERIC_QUERY))
                    .otherwise(F.col("original_query")))
    )


def aspects(domain: Column) -> Column:
    """Aspect names of a domain, those of the general one for a domain not listed."""
    names = F.array(*[F.lit(a) for a in DOMAIN_ASPECTS[GENERAL_DOMAIN]])
    for known, listed in DOMAIN_ASPECTS.items():
        names = F.when(domain == known, F.array(*[F.lit(a) for a in listed])).otherwise(names)
    return names


def coverage(reports: DataFrame, clusters: DataFrame, min_keywords: int = 1) -> DataFrame:
    """Rows (report_id, is_valid, coverage_pct, covered_clusters, missed_clusters).

    `reports` has report_id, report and optionally error; `clusters` has report_id,
    cluster_id, size, keywords. A cluster is covered when enough of its keywords
    occur in the report. Without clusters or text the report counts as covered; a
    failed report is final but covers nothing.
    """
    errors = F.col("error") if "error" in reports.columns else F.lit(None).cast("string")
    marked = reports.select("report_id", clean_text(F.col("report")).alias("report"),
                            errors.alias("error"))
    # cluster lists are short, so they are attached to their report before the test
    listed = clusters.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct(
        -F.col("size").alias("neg"), "cluster_id", "size", "keywords"))).alias("_c"))
    joined = marked.join(listed, "report_id", "left").select(
        "report_id", "report", "error", F.lower("report").alias("_lower"),
        F.transform("_c", lambda c: F.struct(c["cluster_id"].alias("cluster_id"),
                                             c["size"].alias("size"),
                                             c["keywords"].alias("keywords"))).alias("clusters"))
    return joined.select("report_id", *coverage_columns(min_keywords))


def coverage_columns(min_keywords: int = 1) -> list[Column]:
    """Coverage of a row with `report`, `_lower`, `error` and `clusters`."""
    def hits(cluster: Column) -> Column:
        return F.size(F.filter(cluster["keywords"], lambda k: F.contains("_lower", F.lower(k))))

    failed = F.col("error").isNotNull() | F.startswith("report", F.lit(ERROR_MARK))
    none = F.array().cast(f"array<{CLUSTER}>")
    nothing = failed | (F.col("report") == "") | F.coalesce(
        F.size(F.coalesce("clusters", none)) == 0, F.lit(True))
    covered = F.filter(F.coalesce("clusters", none), lambda c: hits(c) >= min_keywords)
    missed = F.filter(F.coalesce("clusters", none), lambda c: hits(c) < min_keywords)
    share = F.size(covered) / F.nullif(F.size(F.coalesce("clusters", none)), F.lit(0))
    return [
        (nothing | (F.size(missed) == 0)).alias("is_valid"),
        F.when(failed, F.lit(0.0)).when(nothing, F.lit(1.0)).otherwise(share).alias("coverage_pct"),
        F.when(nothing, F.array().cast("array<int>")).otherwise(
            F.transform(covered, lambda c: c["cluster_id"].cast("int"))).alias("covered_clusters"),
        F.when(nothing, none).otherwise(missed).alias("missed_clusters"),
    ]


def keep_looping(is_valid: Column, round_col: Column) -> Column:
    return ~F.coalesce(is_valid, F.lit(True)) & (round_col < MAX_REFINE_ROUNDS)


def refined_query(original: Column, missed: Column) -> Column:
    """The topic with two keywords of each missed cluster, or with the generic words."""
    words = F.flatten(F.transform(missed, lambda c: F.slice(c["keywords"], 1, 2)))
    with_words = F.array_join(F.concat(F.array(original), words, F.array(F.lit(REFINE_SUFFIX))), " ")
    generic = F.concat(original, F.lit(" " + GENERIC_QUERY))
    return strip(F.when(F.size(words) > 0, with_words).otherwise(generic))


def cluster_note(clusters: Column) -> Column:
    """A paragraph that lists the clusters, empty for fewer than two."""
    lines = F.transform(clusters, lambda c: F.concat(
        F.lit("  • Cluster #"), c["cluster_id"].cast("string"), F.lit(" ("),
        c["size"].cast("string"), F.lit(" reviews): "),
        F.array_join(F.slice(c["keywords"], 1, 3), ", ")))
    note = F.concat(F.lit("Themes found in these reviews, each of which the report must cover:\n"),
                    F.array_join(lines, "\n"), F.lit("\n"))
    return F.when(F.size(clusters) > 1, note).otherwise(F.lit(""))


def retry_note(round_col: Column, missed: Column) -> Column:
    first = F.transform(F.slice(missed, 1, 4), lambda c: F.concat(
        F.lit("'"), F.get(c["keywords"], F.lit(0)), F.lit("'")))
    words = F.when(F.size(first) > 0, F.array_join(first, ", ")).otherwise(F.lit("(none specified)"))
    note = F.concat(F.lit("Retry "), round_col.cast("string"), F.lit(f"/{MAX_REFINE_ROUNDS}: "),
                    F.lit("the last report left out "), words,
                    F.lit(". Cover them in all three sections.\n"))
    return F.when(round_col > 0, note).otherwise(F.lit(""))


def prompt(domain: Column, language: Column, corrected: Column, notes: Column,
           reviews: Column) -> Column:
    """Prompt text of one request. `reviews` is an array that was cut to size before."""
    foreign = F.when(language == "Indonesian", F.lit(
        "The reviews are Indonesian: read them as they are, write in English and translate "
        "what you quote.\n")).otherwise(F.lit(""))
    rules = F.when(corrected > 0, F.concat(
        F.lit("Star ratings overruled the model in "), corrected.cast("string"),
        F.lit(" predictions; the reviews below are negative by model and rating.\n"))
    ).otherwise(F.lit(""))
    listed = F.array_join(F.transform(aspects(domain), lambda a: F.concat(F.lit("  - "), a)), "\n")
    bullets = F.array_join(F.transform(
        F.filter(reviews, lambda r: strip(r) != ""), lambda r: F.concat(F.lit("- "), r)), "\n")
    return F.concat(
        F.lit("Write a business report on the complaints in these shop reviews.\n"),
        F.lit("Domain: "), F.initcap(domain), F.lit("\nLanguage: "), language, F.lit("\n"),
        foreign, rules, notes,
        F.lit("Sort the complaints by aspect, such as:\n"), listed,
        F.lit("\nName only aspects that the reviews show, and quote them briefly.\n"
              "Answer in Markdown under exactly these headings:\n"),
        F.lit("\n".join(REPORT_SECTIONS)),
        F.lit("\nwith 2-3 sentences, `###` sub-headings with bullets, and 3-5 numbered actions.\n"
              "Reviews:\n"), bullets, F.lit("\n"))


def template_report(clusters: Column, reviews: Column) -> Column:
    """A report built from clusters and reviews alone, in the three sections."""
    named = F.transform(clusters, lambda c: F.concat(
        F.lit("### "), F.initcap(F.coalesce(F.get(c["keywords"], F.lit(0)), F.lit("other"))),
        F.lit("\n- "), c["size"].cast("string"), F.lit(" reviews mention "),
        F.array_join(c["keywords"], ", ")))
    actions = F.transform(clusters, lambda c, i: F.concat(
        (i + 1).cast("string"), F.lit(". Look into "),
        F.array_join(F.slice(c["keywords"], 1, 2), " and ")))
    body = F.concat(
        F.lit(REPORT_SECTIONS[0] + "\n"), F.size(reviews).cast("string"),
        F.lit(" negative reviews in "), F.size(clusters).cast("string"), F.lit(" themes.\n"),
        F.lit(REPORT_SECTIONS[1] + "\n"), F.array_join(named, "\n"), F.lit("\n"),
        F.lit(REPORT_SECTIONS[2] + "\n"), F.array_join(actions, "\n"), F.lit("\n"))
    return F.when(F.size(reviews) > 0, body).otherwise(F.lit(NO_REVIEWS_REPORT))


def generate(prompts: DataFrame, generator_factory: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Replace `prompt` by `report`, written by a user's function. A prompt that is
    null gives the report for a request without reviews, a failure gives a marked text."""
    kept = [(n, t) for n, t in prompts.dtypes if n != "prompt"]
    schema = ", ".join([f"`{n}` {t}" for n, t in kept] + ["report string"])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = generator_factory()
        for batch in batches:
            texts = []
            for text in batch["prompt"]:
                try:
                    texts.append(NO_REVIEWS_REPORT if text is None else str(generator(text)))
                except Exception as exc:  # the report tells the failure
                    texts.append(f"{ERROR_MARK} Report failed: {exc}_")
            yield batch.drop(columns=["prompt"]).assign(report=texts)

    return prompts.mapInPandas(call, schema)


def log_step(log: Column, step: Column | str, info: Column) -> Column:
    name = F.lit(step) if isinstance(step, str) else step
    return F.array_append(log, F.struct(name.alias("step"), info.alias("info")))
