"""Repeated substrings by prefix-free parsing: phrases, their suffix arrays, corpus order.

Two levels of phrases. Over the corpus, a text is cut where the smallest rolling hash of a
400-byte string changes. Such phrases overlap by 399 bytes, so every 400-byte string lies
in exactly one of them, and equal strings lie in phrases of an equal key. Distinct phrases
of a key form a dictionary that is small where text repeats. Inside a task, dictionaries
are parsed again with short triggers; suffix arrays of the short phrases and of the parse
combine into the order of all strings, in which equal ones are neighbours.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from reviewmill.llm.common import bounded_broadcast, lists, materialise

#: Bytes of a string that counts as repeated; bytes of a rolling hash that cuts the corpus.
LENGTH, UNIT = 400, 128
#: String starts hashed at a time.
PIECE = 1 << 17
#: Rolling hash of the parse inside a task, and one position in how many it cuts at.
TRIGGER, SPARSE = 16, 32
#: Bytes of phrases ordered at a time, about; a key with more is counted string by string.
BATCH, GROUP = 1 << 20, 2 << 20

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
BACK = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1


class Powers:
    """BASE ** i and BASE ** -i modulo 2 ** 64, as long as needed so far."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, b, dtype=np.uint64)]).cumprod(
                dtype=np.uint64) for b in (BASE, BACK))
        return cls.up[:n], cls.down[:n]

    @classmethod
    def forget(cls) -> None:
        """Give memory back: a worker waits for its next task with what it holds."""
        cls.up = cls.down = np.ones(1, dtype=np.uint64)
        pa.default_memory_pool().release_unused()


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of every string of that length, from differences of prefix sums."""
    if len(data) < length:
        return np.zeros(0, dtype=np.uint64)
    up, down = Powers.of(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down, out=sums[1:])
    out = (sums[length:] - sums[:-length]) * up[:len(data) - length + 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def phrases(data: bytes, spans: list[tuple[int, int]], length: int = LENGTH, unit: int = UNIT
            ) -> list[tuple[int, int, int, int, bool]]:
    """(text, key, first start, number of starts, may repeat itself) of every phrase of
    texts that lie at `spans` of a buffer.

    A phrase is a longest range of string starts with one key, the smallest hash of the
    strings' units. If its key occurs once in it, its strings all differ.
    """
    whole = np.frombuffer(data, dtype=np.uint8)
    width = length - unit + 1
    out: list[tuple[int, int, int, int, bool]] = []
    begin = 0
    while begin < len(spans):
        end, low = begin + 1, spans[begin][0]
        while end < len(spans) and spans[end][1] - low <= PIECE:
            end += 1
        last = spans[end - 1][1] - length  # the last start, if any
        for at in range(low, max(low, last) + 1, PIECE):
            part = whole[at:min(at + PIECE + length - 1, spans[end - 1][1])]
            hashes = rolling(part, unit)
            if len(hashes) < width:
                continue
            keys = sliding_min(hashes, width)
            mine = [(n, np.arange(max(a - at, 0), min(b - length + 1 - at, len(keys))))
                    for n, (a, b) in enumerate(spans[begin:end], begin) if b - a >= length]
            starts = np.concatenate([s for _, s in mine]) if mine else np.zeros(0, dtype=np.int64)
            if not len(starts):
                continue
            text = np.repeat([n for n, _ in mine], [len(s) for _, s in mine])
            key = keys[starts]
            cut = np.flatnonzero((key[1:] != key[:-1]) | (text[1:] != text[:-1])) + 1
            firsts = np.concatenate([[0], cut])
            sizes = np.diff(np.concatenate([firsts, [len(starts)]]))
            for t, k, a, n in zip(text[firsts].tolist(), key[firsts].tolist(), starts[firsts].tolist(),
                                  sizes.tolist()):
                again = n > width or np.count_nonzero(hashes[a:a + n + width - 1] == np.uint64(k)) > 1
                first = at + a - spans[t][0]
                if out and out[-1][0] == t and out[-1][1] == k and out[-1][2] + out[-1][3] == first:
                    out[-1] = (t, k, out[-1][2], out[-1][3] + n, True)  # goes on in the next piece
                else:
                    out.append((t, k, first, n, again))
        begin = end
    return out


# ---------------------------------------------------------------- order of all strings

def suffix_ranks(symbols: np.ndarray, stop: np.ndarray, most: int) -> np.ndarray:
    """Ranks of suffixes by their first `most` symbols, equal ones alike. `stop` is the
    place of the suffix's terminator, whose symbol is 0; nothing beyond it is compared."""
    here = np.arange(len(symbols))
    bits = max(1, int(symbols.max()).bit_length())
    span = max(1, 62 // bits)
    key = np.zeros(len(symbols), dtype=np.int64)
    for t in range(span):
        key = (key << bits) | symbols[np.minimum(here + t, stop)]
    kinds, ranks = np.unique(key, return_inverse=True)
    while span < most:
        ranks = ranks + 1
        ranks[stop == here] = 0
        key = ranks * np.int64(len(kinds) + 2) + ranks[np.minimum(here + span, stop)]
        before = len(kinds)
        kinds, ranks = np.unique(key, return_inverse=True)
        if len(kinds) == before:
            break
        span *= 2
    return ranks


def repeated_starts(texts: list[bytes], starts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its first so many strings occurs at another start too.

    The texts are parsed into phrases between triggers; distinct phrases are the
    dictionary. A string's place in the order of all is (rank of the rest of its phrase,
    rank of the parse behind it): a phrase's end is a trigger, so the rest of one phrase
    is never the beginning of another's. Neighbours of equal hash are compared bytewise.
    """
    joined = b"".join(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    cuts = rolling(data, TRIGGER)
    cuts = np.flatnonzero(cuts % np.uint64(SPARSE) == 0)
    owner = np.searchsorted(ends, cuts, side="right")
    cuts = cuts[(cuts + TRIGGER <= ends[owner]) & (cuts > begins[owner])]
    heads = np.sort(np.concatenate([begins[begins < ends], cuts]))
    owner = np.searchsorted(ends, heads, side="right")
    final = np.concatenate([owner[1:] != owner[:-1], [True]])
    tails = np.where(final, ends[owner], np.concatenate([heads[1:], [0]]) + TRIGGER)

    known: dict[bytes, int] = {}
    number = np.array([known.setdefault(joined[a:b], len(known)) for a, b in zip(heads.tolist(), tails.tolist())])
    sizes = np.array([len(p) for p in known])
    word_end = np.cumsum(sizes + 1) - 1               # places of the terminators
    word_begin = word_end - sizes
    symbols = np.zeros(int(word_end[-1]) + 1, dtype=np.int64)
    inside = np.ones(len(symbols), dtype=bool)
    inside[word_end] = False
    symbols[inside] = np.frombuffer(b"".join(known), dtype=np.uint8).astype(np.int64) + 1
    word_rank = suffix_ranks(symbols, np.repeat(word_end, sizes + 1), length)

    # the parse: a phrase's rank per occurrence, and a 0 behind each text
    place = np.arange(len(heads)) + np.concatenate([[0], np.cumsum(final)[:-1]])
    parse = np.zeros(len(heads) + int(final.sum()), dtype=np.int64)
    parse[place] = word_rank[word_begin[number]] + 1
    zeros = np.flatnonzero(parse == 0)
    stop = zeros[np.searchsorted(zeros, np.arange(len(parse)))]
    parse_rank = suffix_ranks(parse, stop, length) + 1
    parse_rank[zeros] = 0

    counts = np.array(starts)
    at = np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    of = np.searchsorted(heads, at, side="right") - 1
    first = word_rank[word_begin[number[of]] + at - heads[of]]
    second = parse_rank[place[of] + 1]
    order = np.lexsort((second, first))
    ordered = at[order]
    hashes = rolling(data, length)[ordered]
    equal = np.flatnonzero(hashes[1:] == hashes[:-1])
    strings = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else None
    same = np.zeros(len(order) + 1, dtype=bool)      # of each place: equal to the one before
    for i in range(0, len(equal), 4096):
        some = equal[i:i + 4096]
        same[some + 1] = (strings[ordered[some]] == strings[ordered[some + 1]]).all(axis=1)
    flag = np.zeros(len(order), dtype=bool)
    flag[order] = same[:-1] | same[1:]
    return np.split(flag, np.cumsum(counts)[:-1])


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of every run of marked ones."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


# ---------------------------------------------------------------- on Spark

def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _phrases(source: DataFrame, length: int, unit: int) -> DataFrame:
    """Thin rows (key, d1, d2, row, at, n, again): a digest instead of a phrase's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in lists(batches, "__row", "__data"):
            ends = np.cumsum([len(t) for t in texts]).tolist()
            spans = [(e - len(t), e) for t, e in zip(texts, ends)]
            found = phrases(b"".join(texts), spans, length, unit)
            digests = [xxhash.xxh3_128_intdigest(texts[t][a:a + n + length - 1]) for t, _, a, n, _ in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_signed(k) for _, k, _, _, _ in found], pa.int64()),
                 pa.array([_signed(d >> 64) for d in digests], pa.int64()),
                 pa.array([_signed(d & MASK) for d in digests], pa.int64()),
                 pa.array([rows[t] for t, *_ in found], pa.int64()),
                 pa.array([a for _, _, a, _, _ in found], pa.int64()),
                 pa.array([n for _, _, _, n, _ in found], pa.int64()),
                 pa.array([s for *_, s in found], pa.bool_())],
                names=["key", "d1", "d2", "row", "at", "n", "again"])
        Powers.forget()

    return source.mapInArrow(run, "key long, d1 long, d2 long, row long, at long, n long, again boolean")


def _cut_out(source: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of phrases (key, row, at, n, m), from the texts that hold one."""
    of_row = materialise(wanted.groupBy(F.col("row").alias("__row")).agg(
        F.collect_list(F.struct("key", "at", "n", "m")).alias("__wanted")), "substring-wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, lists_ in lists(batches, "__row", "__data", "__wanted", rows=64):
            for row, text, each in zip(rows, texts, lists_):
                for start in range(0, len(each), 1024):
                    part = each[start:start + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w["key"] for w in part], pa.int64()), pa.array([row] * len(part), pa.int64()),
                         pa.array([w["at"] for w in part], pa.int64()), pa.array([w["n"] for w in part], pa.int64()),
                         pa.array([w["m"] for w in part], pa.int64()),
                         pa.array([text[w["at"]:w["at"] + w["n"] + length - 1] for w in part], pa.binary())],
                        names=["key", "row", "at", "n", "m", "data"])

    return source.join(bounded_broadcast(of_row), "__row").select("__row", "__data", "__wanted").mapInArrow(
        run, "key long, row long, at long, n long, m long, data binary")


def _compare(cut: DataFrame, length: int) -> DataFrame:
    """Ranges (row, from, to) of repeated starts of phrases that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flagged() -> pa.RecordBatch:
            flags = repeated_starts([h[4] for h in held], [h[2] for h in held], length)
            found = [(row, at + a, at + b) for (row, at, _, m, _), f in zip(held, flags) if m == 1
                     for a, b in ranges(f)]
            return pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["row", "from", "to"])

        for columns in lists(batches, "key", "row", "at", "n", "m", "data"):
            for key, *entry in zip(*columns):
                if key != last and size >= BATCH:
                    yield flagged()
                    held, size = [], 0
                last, size = key, size + len(entry[-1])
                held.append(tuple(entry))
        if held:
            yield flagged()
        held.clear()
        Powers.forget()

    dealt = cut.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "row long, from long, to long")


def _count(cut: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many different phrases: string by string, by digest. A
    digest's occurrences are added up in every task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in lists(batches, "row", "at", "n", "m", "data", rows=16):
            for row, at, n, m, data in zip(*columns):
                for start in range(0, n, 1 << 16):
                    some = range(start, min(n, start + (1 << 16)))
                    digests = [xxhash.xxh3_128_intdigest(data[i:i + length]) for i in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_signed(d >> 64) for d in digests], pa.int64()),
                         pa.array([_signed(d & MASK) for d in digests], pa.int64()),
                         pa.array([row] * len(some), pa.int64()), pa.array([at + i for i in some], pa.int64()),
                         pa.array([m] * len(some), pa.int64())], names=["d1", "d2", "row", "from", "m"])

    strings = materialise(cut.mapInArrow(run, "d1 long, d2 long, row long, from long, m long"), "substring-strings")
    often = materialise(strings.groupBy("d1", "d2").agg(F.sum("m").alias("times")).where(
        F.col("times") > 1).select("d1", "d2"), "substring-often")
    return strings.where(F.col("m") == 1).join(bounded_broadcast(often), ["d1", "d2"]).select(
        "row", "from", F.col("from").alias("to"))


def repeated_ranges(source: DataFrame, length: int = LENGTH, unit: int = UNIT, group: int = GROUP) -> DataFrame:
    """Ranges (row, from, to) of starts whose string of that length also starts elsewhere.

    Only thin rows of phrases are shuffled for the whole corpus. A phrase whose key occurs
    once holds no repeated string. A phrase that occurs again as a whole is repeated at
    every start, and its bytes move once, for comparison with other phrases of its key.
    """
    thin = materialise(_phrases(source, length, unit), "substring-phrases")
    keys = materialise(thin.groupBy("key").agg(F.count("*").alias("times"), F.max("again").alias("again")).where(
        (F.col("times") > 1) | F.col("again")).select("key"), "substring-keys")
    shared = materialise(thin.join(bounded_broadcast(keys), "key"), "substring-shared")
    words = materialise(shared.groupBy("key", "d1", "d2").agg(
        F.count("*").alias("m"), F.min(F.struct("row", "at", "n")).alias("one"), F.max("again").alias("again")),
        "substring-words")
    whole = words.where(F.col("m") > 1).select("key", "d1", "d2")
    marks = shared.join(bounded_broadcast(materialise(whole, "substring-whole")), ["key", "d1", "d2"]).select(
        "row", F.col("at").alias("from"), (F.col("at") + F.col("n") - 1).alias("to"))
    size = F.sum(F.col("one.n") + length - 1)
    open_keys = materialise(words.groupBy("key").agg(
        F.count("*").alias("kinds"), F.min("m").alias("least"), F.max("again").alias("again"), size.alias("bytes")).where(
        (F.col("least") == 1) & ((F.col("kinds") > 1) | F.col("again"))).select("key", "bytes"), "substring-open")
    wanted = materialise(words.join(bounded_broadcast(open_keys), "key").select(
        "key", "bytes", "one.row", "one.at", "one.n", "m"), "substring-pieces")
    small, large = wanted.where(F.col("bytes") <= group), wanted.where(F.col("bytes") > group)
    marks = marks.unionByName(_compare(_cut_out(source, small, length), length))
    if not large.isEmpty():
        marks = marks.unionByName(_count(_cut_out(source, large, length), length))
    return marks


def merge(found: list[dict] | None, length: int) -> list[list[int]]:
    """Byte ranges [from, to) covered by strings that start in the given ranges; ranges
    that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((f["from"], f["to"] + length) for f in found or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def drop_repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                             length: int = LENGTH, unit: int = UNIT, group: int = GROUP) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept), one per document.

    Texts are UTF-8 bytes; every byte that lies in a string of `length` bytes which also
    starts anywhere else in the table, in the same text or another, is removed. Strings are
    judged on the texts as they come in. `kept` holds the other bytes in order; it may cut
    a character in two.

    Null counts as empty; empty texts and texts shorter than `length` stay whole. Texts may
    be of any length: they are hashed in pieces. Repeated rows, and rows with a null id,
    are documents of their own, so a repeated text of `length` bytes or more is removed from all
    its rows. An empty table gives no rows; other columns are not read.
    """
    source = materialise(docs.select(
        F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__data")), "substring-texts")
    marks = repeated_ranges(source.select("__row", "__data"), length, unit, group).groupBy(
        F.col("row").alias("__row")).agg(F.collect_list(F.struct("from", "to")).alias("__marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, marked in lists(batches, "__row", "__marks"):
            spans = [merge(m, length) for m in marked]
            # what stays lies between the spans; the last piece goes on to the end
            keep = [[{"at": a + 1, "n": b - a} for a, b in zip(
                [0, *(b for _, b in gone)], [*(a for a, _ in gone), (1 << 31) - 2]) if b > a] for gone in spans]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                 pa.array([len(s) for s in spans], pa.int64()),
                 pa.array(keep, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))],
                names=["__row", "n_removed", "n_spans", "__keep"])

    cuts = materialise(marks.mapInArrow(
        run, "__row long, n_removed long, n_spans long, __keep array<struct<at:int,n:int>>"), "substring-cuts")
    # texts stay in the JVM; those without a cut are not touched
    kept = F.when(F.col("__keep").isNull(), F.col("__data")).otherwise(F.expr(
        "unhex(array_join(transform(__keep, p -> hex(substring(__data, p.at, p.n))), ''))"))
    return source.join(bounded_broadcast(cuts), "__row", "left").select(
        F.col("__doc_id").alias(id_col), F.octet_length("__data").cast("long").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), kept.alias("kept"))
