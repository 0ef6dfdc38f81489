"""Benchmark passages in documents, by a prefix-filtered set join."""

from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.llm.common import ascii_lower, bounded_broadcast, materialise

WINDOW = 13
#: A document is contaminated if one word in so many lies in a benchmark window.
SHARE = 20
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BREAK), ""), F.array().cast("array<string>"))


def _pairs(col: str) -> Column:
    """A row (a, b) per word and its follower; the last word has none."""
    return F.arrays_zip(F.col(col).alias("a"), F.slice(col, 2, F.greatest(F.size(col), F.lit(1))).alias("b"))


def _hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def item_windows(items: DataFrame, window: int, item_id: str, text_col: str) -> DataFrame:
    """(__words, __items): each distinct window once, with the items that hold it. An
    item shorter than a window, but not empty, is one window."""
    rows = items.select(F.col(item_id).alias("__item"), words(F.col(text_col)).alias("__all")).where(
        F.size("__all") > 0)
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("__all") - window, F.lit(0))))
    return rows.withColumn("__start", start).select(
        "__item", F.slice("__all", F.col("__start") + 1, window).alias("__words")).groupBy("__words").agg(
        F.collect_set("__item").alias("__items"))


def _anchors(docs_words: DataFrame, windows: DataFrame) -> DataFrame:
    """(__token, __offset, __words, __items): the rarest shingle of each window.

    Tokens are shingles of two words, ordered by how often the documents hold them. A
    window is contained as a whole, so the prefix that must be shared is its first
    token in that order. A window of one word has that word as its only token.
    """
    shingles = windows.select("__words", F.posexplode(_pairs("__words")).alias("__offset", "__pair")).where(
        F.col("__pair.b").isNotNull() | (F.size("__words") == 1)).select(
        "__words", "__offset", _hash(F.col("__pair.a"), F.col("__pair.b")).alias("__token"))
    wanted = materialise(shingles.select("__token").distinct(), "decon-tokens")
    held = docs_words.select(F.explode(_pairs("__words")).alias("__pair")).select(
        _hash(F.col("__pair.a"), F.col("__pair.b")).alias("__token"))
    counts = held.join(bounded_broadcast(wanted), "__token").groupBy("__token").agg(F.count("*").alias("__n"))
    ranked = shingles.join(counts, "__token", "left").groupBy("__words").agg(
        F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__offset").alias("offset"),
                       F.col("__token").alias("token"))).alias("__first"))
    # a window whose rarest shingle no document holds occurs nowhere
    return materialise(
        ranked.where((F.col("__first.n") > 0) | (F.size("__words") == 1)).join(windows, "__words").select(
            F.col("__first.token").alias("__token"), F.col("__first.offset").alias("__offset"), "__words",
            "__items"), "decon-anchors")


def _candidates(docs_words: DataFrame, anchors: DataFrame) -> DataFrame:
    """(__doc_id, __found): the places of each document where a window may lie."""
    n = F.size("__words").alias("__n")
    found = docs_words.select("__doc_id", n, F.posexplode(_pairs("__words")).alias("__pos", "__pair")).select(
        "__doc_id", "__n", "__pos", _hash(F.col("__pair.a"), F.col("__pair.b")).alias("__token"))
    longer = anchors.where(F.size("__words") > 1)
    if not anchors.where(F.size("__words") == 1).isEmpty():  # single words are another kind of token
        single = docs_words.select("__doc_id", n, F.posexplode("__words").alias("__pos", "__word")).select(
            "__doc_id", "__n", "__pos", F.xxhash64("__word").alias("__token"))
        ones = anchors.where(F.size("__words") == 1)
        joined = found.join(bounded_broadcast(longer), "__token").unionByName(
            single.join(bounded_broadcast(ones), "__token"))
    else:
        joined = found.join(bounded_broadcast(longer), "__token")
    start = F.col("__pos") - F.col("__offset")
    return joined.where((start >= 0) & (start + F.size("__words") <= F.col("__n"))).select(
        "__doc_id", F.struct(start.alias("start"), F.col("__words").alias("words"),
                             F.col("__items").alias("items")).alias("__place")).groupBy("__doc_id").agg(
        F.collect_set("__place").alias("__places"))


def find_benchmark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with n_words, n_hit, items and contaminated (replacing columns of
    that name).

    n_hit counts the words inside any occurrence of a window of an item; items are the
    ids of items with occurring windows. Null and empty texts have no words and are
    clean. A repeated or null id is no problem: a place that another row of the same id
    suggests is verified against the row's own text.
    """
    docs_words = docs.select(F.col(id_col).alias("__doc_id"), words(F.col(text_col)).alias("__words"))
    windows = materialise(item_windows(items, window, item_id, item_text), "decon-windows")
    places = _candidates(docs_words, _anchors(docs_words, windows)).withColumnRenamed("__doc_id", "__place_id")
    joined = docs.join(places, F.col(id_col).eqNullSafe(F.col("__place_id")), "left")

    def verify(own: Column) -> Column:
        hits = F.filter("__places", lambda p: F.slice(own, p["start"] + 1, F.size(p["words"])) == p["words"])
        return F.struct(F.size(own).alias("n_words"), F.coalesce(hits, F.array()).alias("hits"))

    # bound by a one-element array, so that a text is cut into words once
    checked = joined.withColumn("__checked", F.transform(F.array(words(F.col(text_col))), verify)[0])
    spans = F.transform("__checked.hits", lambda p: F.sequence(p["start"], p["start"] + F.size(p["words"]) - 1))
    new = {"n_words": F.col("__checked.n_words").cast("long"),
           "n_hit": F.size(F.array_distinct(F.flatten(spans))).cast("long"),
           "items": F.array_sort(F.array_distinct(F.flatten(F.transform("__checked.hits", lambda p: p["items"]))))}
    flagged = checked.withColumns(new).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))
    return flagged.select(*docs.columns, *[c for c in [*new, "contaminated"] if c not in docs.columns])


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    plain = docs.select(*[c for c in docs.columns if c not in ("n_words", "n_hit", "items", "contaminated")])
    if plain.columns == docs.columns:
        return find_benchmark(docs, items, **options).where(~F.col("contaminated")).select(docs.columns)
    kept = {c: f"__kept_{c}" for c in docs.columns if c not in plain.columns}
    renamed = docs.withColumnsRenamed(kept)
    return find_benchmark(renamed, items, **options).where(~F.col("contaminated")).select(
        renamed.columns).withColumnsRenamed({v: k for k, v in kept.items()})
