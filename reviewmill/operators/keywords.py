"""A table of keywords searched in a table of texts, every text read once."""

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reviewmill.functions.text import clean_text, strip
from reviewmill.operators.skew import fits_broadcast
from reviewmill.session import materialise

#: Texts matched at a time.
ROWS = 512


def normal_keywords(keywords: DataFrame, keyword_col: str) -> DataFrame:
    """Each keyword once, lower-cased, without white space around it; nulls are none."""
    return keywords.where(F.col(keyword_col).isNotNull()).select(
        F.lower(strip(F.col(keyword_col).cast("string"))).alias("keyword")).distinct()


def _match(rows: DataFrame, keep: Sequence[str], words: list[str]) -> DataFrame:
    """Rows (keyword, *keep) of (_lower, *keep): an automaton of all the words walks each
    text once, whatever their number."""
    automaton = ahocorasick.Automaton()
    for number, word in enumerate(words):
        if word:
            automaton.add_word(word, number)
    automaton.make_automaton()
    everywhere = [n for n, word in enumerate(words) if not word]  # a blank keyword is in every text
    shared = rows.sparkSession.sparkContext.broadcast((automaton, pa.array(words, pa.string()), everywhere))
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, names, everywhere = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found = [sorted({n for _, n in automaton.iter(t)}.union(everywhere) if len(automaton) else everywhere)
                         for t in part.column("_lower").to_pylist()]
                at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array([n for f in found for n in f], pa.int64())),
                     *[part.column(c).take(at) for c in keep]], names=["keyword", *keep])

    return rows.mapInArrow(run, StructType(
        [StructField("keyword", StringType()), *[rows.schema[c] for c in keep]]))


def match_keywords(df: DataFrame, text_col: str, keywords: DataFrame, keyword_col: str = "keyword",
                   keep: Sequence[str] = (), **bounds: int) -> DataFrame:
    """Rows (keyword, *keep), one for every keyword that a text contains, in the manner of
    the keyword filter: a literal of any case, inside words too.

    Keywords under the broadcast bound are searched in one scan; a larger table is dealt
    into blocks under the bound, and each takes one scan.
    """
    words = materialise(normal_keywords(keywords, keyword_col), "keywords")
    rows = df.select(F.lower(clean_text(F.col(text_col))).alias("_lower"), *keep)
    blocks = 1
    while blocks < 1 << 20:
        block = F.pmod(F.xxhash64("keyword"), F.lit(blocks))
        if all(fits_broadcast(words.where(block == n), **bounds) for n in range(min(blocks, 2))):
            break
        blocks *= 2
    found = None
    for n in range(blocks):
        # a block of keywords under the bound
        some = sorted(words.where(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == n).toArrow().column("keyword").to_pylist())
        part = _match(rows, keep, some)
        found = part if found is None else found.unionByName(part)
    return found
