"""SimHash near-duplicates, compared bit-sliced inside blocks."""

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from reviewmill.llm.common import bounded_broadcast, lists, materialise
from reviewmill.llm.components import connected_components
from reviewmill.llm.prefixes import EPSILON, least_shared, rare_prefixes

SEED = 42
#: Rows of a block that one comparison tile takes; a larger block is cut into tiles.
CHUNK = 2048
#: Rare shingles that a row carries to be compared with others.
TOKENS = 64
#: (query, 64-lane word) entries compared in one go, and bits between two clearings.
ENTRIES, STRIDE = 1 << 16, 12
#: Rows that a block of the pigeonhole tables should have on average, at most.
BLOCK_ROWS = 512
SHINGLES = 1 << 16
#: How far beyond the expected number of differing bits links are looked for: 6 standard
#: deviations above the mean for the shortest texts (at 0.8, 4 of 5 shingles: 48 + 6 * 6.2
#: of 256 bits), more for all others.
RADIUS_SLACK = 1.23


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of so many words, repeats included. A text with fewer
    words is one shingle; a text without words has none."""
    found = (text or "").encode().lower().split()
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)] if found else [], dtype=np.uint64)
    ends = list(accumulate(len(w) + 1 for w in found))
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    starts = [0, *ends]
    return np.fromiter((digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[words - 1:])),
                       dtype=np.uint64, count=len(found) - words + 1)


def _spread(h: np.ndarray, n: int) -> np.ndarray:
    """The nth derived 64-bit hash; the 0th is the hash itself."""
    if n == 0:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, bits: int) -> bytes:
    """A bit is 1 if set in over half the hashes; big-endian, zero without hashes."""
    counts = np.zeros(bits, dtype=np.int64)
    for start in range(0, len(h), SHINGLES):
        part = h[start:start + SHINGLES]
        wide = np.stack([_spread(part, i) for i in range(bits // 64)], axis=1).astype(">u8")
        counts += np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(h)).tobytes()


def min_shingles(h: np.ndarray, tables: int) -> list[int]:
    """The smallest derived hash per table: two texts share one with the probability of
    their similarity."""
    if not len(h):
        return [0] * tables
    return [int(_spread(h, 101 + i).min().view(np.int64)) for i in range(tables)]


def add_fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int,
                     tables: int = 0, sets: bool = False) -> DataFrame:
    """(__doc_id, __text, __fp, __keys): digest of the text, fingerprint, smallest shingles.
    With sets, a shingle counts once however often it is repeated, and a digest of the set
    follows the fingerprint in __fp, so that only equal sets are one node."""
    source = docs.select(F.col(id_col).alias("__doc_id"), F.xxhash64(text_col).alias("__text"),
                         F.col(text_col).alias("__body"))
    id_type = source.schema["__doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, digests, texts in lists(batches, "__doc_id", "__text", "__body"):
            hashes = [shingle_hashes(t, words) for t in texts]
            if sets:
                hashes = [np.unique(h) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow_type), pa.array(digests, pa.int64()),
                 pa.array([fingerprint(h, bits) + (xxhash.xxh3_128_digest(h.tobytes()) if sets else b"")
                           for h in hashes], pa.binary()),
                 pa.array([min_shingles(h, tables) for h in hashes], pa.list_(pa.int64()))],
                names=["__doc_id", "__text", "__fp", "__keys"])

    arrow_type = to_arrow_type(id_type)
    return source.mapInArrow(
        run, f"__doc_id {id_type.simpleString()}, __text long, __fp binary, __keys array<long>")


def band_scheme(rows: int, bits: int, radius: int) -> list[list[tuple[int, int]]]:
    """Bit ranges of the pigeonhole tables.

    The bits are cut into m pieces. Two fingerprints within the radius differ in at
    most `radius` pieces, so they agree on all others: there is a table for every choice
    of m - radius pieces. More pieces give longer keys, and m is the smallest that keeps
    blocks small, so that the number of tables follows the size of the input.
    """
    m = radius + 1
    while m < radius + 4 and rows / 2 ** (bits * (m - radius) / m) > BLOCK_ROWS:
        m += 1
    edges = [bits * i // m for i in range(m + 1)]
    return [[(edges[i], edges[i + 1]) for i in kept] for kept in combinations(range(m), m - radius)]


def band_keys(nodes: DataFrame, scheme: list[list[tuple[int, int]]]) -> DataFrame:
    """(__table, __key, __fp) of 64-bit fingerprints, one row per table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("__fp")
            values = np.frombuffer(b"".join(prints.to_pylist()), dtype=">u8").astype(np.uint64)
            for table, pieces in enumerate(scheme):
                key = np.zeros(len(values), dtype=np.uint64)
                for lo, hi in pieces:
                    key = (key << np.uint64(hi - lo)) | ((values >> np.uint64(lo)) & np.uint64((1 << hi - lo) - 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), table, dtype=np.int32)), pa.array(key.view(np.int64)), prints],
                    names=["__table", "__key", "__fp"])

    return nodes.select("__fp").mapInArrow(run, "__table int, __key long, __fp binary")


def tiles(blocks: DataFrame, *more: str) -> DataFrame:
    """Cut blocks above CHUNK rows into tiles: a row goes to the tile of every pair of
    its chunk with a chunk of the block, so that all pairs still meet once."""
    sizes = blocks.groupBy("__table", "__key").count().where(F.col("count") > CHUNK)
    chunks = F.coalesce(F.ceil(F.col("count") / CHUNK).cast("int"), F.lit(1))
    mine = F.pmod(F.xxhash64("__fp"), F.col("__n")).cast("int")
    dealt = blocks.join(sizes, ["__table", "__key"], "left").withColumn("__n", chunks).withColumn(
        "__mine", mine).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return dealt.select("__table", "__key", F.least("__mine", "__other").alias("__x"),
                        F.greatest("__mine", "__other").alias("__y"), "__mine", "__fp", *more)


def _planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes (bits, words) of fingerprints (rows, bytes): lane r of a plane is the
    bit of row r; lanes are padded to whole 64-bit words."""
    rows = -(-len(prints) // 64) * 64
    padded = np.zeros((rows, prints.shape[1]), dtype=np.uint8)
    padded[:len(prints)] = prints
    lanes = np.packbits(np.unpackbits(padded, axis=1).T, axis=1, bitorder="little")
    return np.ascontiguousarray(lanes).view(np.uint64)


ALL = np.uint64((1 << 64) - 1)


def _near(planes: np.ndarray, query_bits: np.ndarray, query: np.ndarray, word: np.ndarray, dead: np.ndarray,
          radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries (query, word) with lanes within the radius, and those lanes.

    Distances of 64 lanes are counted at once in bit-sliced counters. Three planes go
    through a carry-save adder; sum and carry are then added to the counters, which
    start so high that passing the radius overflows. An entry whose lanes are all dead
    is abandoned.
    """
    width = max(2, (radius + 1).bit_length())
    start = (1 << width) - 1 - radius
    counters = [np.full(len(query), ALL if start >> i & 1 else 0, dtype=np.uint64) for i in range(width)]

    def add(bit: np.ndarray, at: int) -> None:
        nonlocal dead
        for i in range(at, width):
            counters[i], bit = counters[i] ^ bit, counters[i] & bit
        dead = dead | bit

    bits = len(planes)
    for first in range(0, bits, STRIDE):
        last = min(first + STRIDE, bits)
        for i in range(first, last, 3):
            x = [planes[j][word] ^ query_bits[j][query] for j in range(i, min(i + 3, last))]
            if len(x) == 3:
                both = x[0] ^ x[1]
                add((x[0] & x[1]) | (x[2] & both), 1)
                add(both ^ x[2], 0)
            else:
                for one in x:
                    add(one, 0)
        alive = dead != ALL
        if not alive.all():
            query, word, dead = query[alive], word[alive], dead[alive]
            counters = [c[alive] for c in counters]
    return np.stack([query, word]), ~dead


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row number reachable from each row over links a - b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the links of a spanning forest that takes the first links first: in
    rounds, every component takes its first link that leads out of it."""
    at, label, chosen = np.arange(len(a)), np.arange(n), [np.zeros(0, dtype=np.int64)]
    while True:
        at = at[label[a[at]] != label[b[at]]]
        if not len(at):
            return np.concatenate(chosen)
        first = np.full(n, len(at))
        np.minimum.at(first, label[a[at]], np.arange(len(at)))
        np.minimum.at(first, label[b[at]], np.arange(len(at)))
        chosen.append(at[np.unique(first[first < len(at)])])
        label = _labels(n, label[a[chosen[-1]]], label[b[chosen[-1]]])[label]


def _forests(n: int, a: np.ndarray, b: np.ndarray, distance: np.ndarray, count: int) -> np.ndarray:
    """(a, b, forest) of the links of so many forests of the shortest links. Each takes
    what the earlier ones left, so that between any two parts every forest has a link as
    long as there is one."""
    order = np.argsort(distance, kind="stable")
    found = [np.zeros((3, 0), dtype=np.int64)]
    for forest in range(count):
        picked = _forest(n, a[order], b[order])
        found.append(np.stack([a[order[picked]], b[order[picked]], np.full(len(picked), forest)]))
        order = np.delete(order, picked)
    return np.concatenate(found, axis=1)


def tile_links(groups: list[tuple[np.ndarray, np.ndarray]], radius: int, forests: int = 0) -> np.ndarray:
    """(row, row, forest) that link the rows of each component, over a list of tiles:
    every row with the smallest of its component, or forests of the shortest links.

    A tile is (fingerprints, chunk number); with two chunks, only pairs across them
    are compared, as each chunk has a tile of its own.
    """
    planes, queries, words, dead, base, lane_row = [], [], [], [], 0, []
    word_base = 0
    for prints, side in groups:
        two = side.min() != side.max()
        own = np.flatnonzero(side == side.min()) if two else np.arange(len(prints))
        other = np.flatnonzero(side == side.max()) if two else own
        planes.append(_planes(prints[other]))
        n = planes[-1].shape[1]
        rows = np.full(n * 64, -1, dtype=np.int64)
        rows[:len(other)] = other
        lane_row.append(np.where(rows >= 0, rows + base, -1))
        gone = rows[None, :] < (0 if two else own[:, None] + 1)
        shut = np.packbits(np.broadcast_to(gone, (len(own), n * 64)), axis=1, bitorder="little")
        dead.append(np.ascontiguousarray(shut).view(np.uint64).ravel())
        queries.append(np.repeat(own + base, n))
        words.append(np.tile(np.arange(n) + word_base, len(own)))
        base, word_base = base + len(prints), word_base + n
    every = np.concatenate([p for p, _ in groups])
    query_bits = np.where(np.unpackbits(every, axis=1).T.astype(bool), ALL, np.uint64(0))
    query, word, gone = np.concatenate(queries), np.concatenate(words), np.concatenate(dead)
    some = gone != ALL
    (query, word), lanes = _near(np.concatenate(planes, axis=1), query_bits, query[some], word[some], gone[some],
                                 radius)
    at, lane = np.nonzero(np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    a, b = query[at], np.concatenate(lane_row)[word[at] * 64 + lane]
    if forests:
        return _forests(base, a, b, np.bitwise_count(every[a] ^ every[b]).sum(axis=1), forests)
    label = _labels(base, a, b)
    child = np.flatnonzero(label != np.arange(base))
    return np.stack([child, label[child], np.zeros_like(child)])


def near_links(tiled: DataFrame, radius: int, forests: int = 0, width: int | None = None) -> DataFrame:
    """Links (a, b, forest) of fingerprints: the rows of each tile that are near each
    other are linked as a bounded number of forests, never as all pairs. Only the first
    bytes, so many as width, are the fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            every = [p for prints, _ in groups for p in prints]
            child, root, forest = tile_links(
                [(np.frombuffer(b"".join(p), dtype=np.uint8).reshape(len(p), -1)[:, :width], np.array(s))
                 for p, s in groups], radius, forests)
            return pa.RecordBatch.from_arrays(
                [pa.array([every[i] for i in child], pa.binary()), pa.array([every[i] for i in root], pa.binary()),
                 pa.array(forest, pa.int32())], names=["a", "b", "forest"])

        groups: list[tuple[list[bytes], list[int]]] = []
        entries, key, prints, sides = 0, None, [], []
        for columns in lists(batches, "__table", "__key", "__x", "__y", "__mine", "__fp", rows=8192):
            for *where, side, fp in zip(*columns):
                if where != key:
                    if len(prints) > 1:
                        groups.append((prints, sides))
                        entries += len(prints) * -(-len(prints) // 64)
                        if entries >= ENTRIES:
                            yield flush()
                            groups, entries = [], 0
                    key, prints, sides = where, [], []
                prints.append(fp)
                sides.append(side)
        if len(prints) > 1:
            groups.append((prints, sides))
        if groups:
            yield flush()

    keys = ["__table", "__key", "__x", "__y"]
    # fingerprints are sorted too, so that ties between links fall alike in every run
    return tiled.repartition(*keys).sortWithinPartitions(*keys, "__fp").mapInArrow(run, "a binary, b binary, forest int")


def components(prints: DataFrame, links: DataFrame) -> DataFrame:
    """(__fp, __component): the smallest __doc_id among the rows of all fingerprints
    reachable by links (a, b). prints is a written table."""
    linked = connected_components(links)
    first = prints.groupBy("__fp").agg(F.min("__doc_id").alias("__first")).join(
        linked.withColumnRenamed("node", "__fp"), "__fp", "left").withColumn(
        "__root", F.coalesce("root", "__fp"))
    smallest = first.groupBy("__root").agg(F.min("__first").alias("__component"))
    return materialise(first.join(smallest, "__root").select("__fp", "__component"), "simhash-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                    radius: int = 4) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id) under 64-bit fingerprints of word shingles.

    Every pair within the radius is linked: pigeonhole tables bring it into one block.
    Equal fingerprints are one node. Null, empty and blank texts have fingerprint zero.
    Repeated rows stay rows; null ids are larger than any (a component of null ids only
    has none). An empty table gives no rows.
    """
    prints = materialise(add_fingerprints(docs, id_col, text_col, words, 64).select("__doc_id", "__fp"), "simhash")
    nodes = materialise(prints.select("__fp").distinct(), "simhash-nodes")
    blocks = band_keys(nodes, band_scheme(nodes.count(), 64, radius))
    found = components(prints, near_links(tiles(blocks), radius).select("a", "b"))
    return prints.join(found, "__fp").select(
        F.col("__doc_id").alias(id_col), F.lower(F.hex("__fp")).alias("fingerprint"),
        F.col("__component").alias("component_id"))


def radius_of(similarity: float, bits: int, slack: float = 0.0) -> int:
    """Differing bits expected at a Jaccard similarity of shingles: of two sets of one
    size that share s / (2 - s) of their union, a share acos(2 s / (1 + s)) / pi differs."""
    return int(round(np.arccos(2 * similarity / (1 + similarity)) / np.pi * bits * (1 + slack)))


def similar_links(links: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links (a, b) whose texts share at least so much of their shingles, exactly.
    texts is (__fp, __body)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, left, right in lists(batches, "a", "b", "__left", "__right", rows=64):
            keep = []
            for i, (x, y) in enumerate(zip(left, right)):
                x, y = np.unique(shingle_hashes(x, words)), np.unique(shingle_hashes(y, words))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared >= similarity * (len(x) + len(y) - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.binary()),
                                              pa.array([b[i] for i in keep], pa.binary())], names=["a", "b"])

    pairs = links.join(texts.select(F.col("__fp").alias("a"), F.col("__body").alias("__left")), "a").join(
        texts.select(F.col("__fp").alias("b"), F.col("__body").alias("__right")), "b")
    return pairs.select("a", "b", "__left", "__right").mapInArrow(run, "a binary, b binary")


def model_texts(nodes: DataFrame, keyed: DataFrame, prints: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__fp, __body) of the nodes (__fp), as a written table. One document of each gives
    its text; keyed has the digests of the texts."""
    models = prints.join(nodes.select("__fp").distinct(), "__fp", "left_semi").groupBy("__fp").agg(
        F.min(F.struct("__doc_id", "__text")).alias("__model"))
    return materialise(keyed.join(models, F.col(id_col).eqNullSafe(F.col("__model.__doc_id")) & (
        F.col("__text") == F.col("__model.__text"))).select("__fp", F.col(text_col).alias("__body")).dropDuplicates(
        ["__fp"]), "simhash-texts")


TILE = ["__table", "__key", "__x", "__y"]
TILE_SCHEMA = "__table int, __key long, __x int, __y int, __mine int, __fp binary, __root binary"


def _across(root: np.ndarray, side: np.ndarray, row: int) -> np.ndarray:
    """The rows of a tile that a row is to be compared with: of other roots, and of the
    other chunk if the tile has two."""
    return (root != root[row]) & ((side != side[row]) if side.min() != side.max() else True)


def by_tile(tiled: DataFrame, run, schema: str) -> DataFrame:
    """run(rows of one tile as lists of columns) gives rows; tiles are whole in a task."""
    names = tiled.columns
    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]
    out = [f.name for f in StructType.fromDDL(schema)]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> list[pa.RecordBatch]:
            found = run([list(c) for c in zip(*rows)])
            return [] if not found[0] else [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types)], names=out)]

        rows: list[tuple] = []
        for columns in lists(batches, *names):
            for row in zip(*columns):
                if rows and row[:4] != rows[0][:4]:
                    if len(rows) > 1:
                        yield from done()
                    rows = []
                rows.append(row)
        if len(rows) > 1:
            yield from done()

    return tiled.repartition(*TILE).sortWithinPartitions(*TILE, "__fp").mapInArrow(tasks, schema)


def open_rows(tiled: DataFrame, radius: int, width: int) -> DataFrame:
    """The rows of each tile (TILE_SCHEMA) that are near a row of another root."""
    def run(columns: list[list]) -> list[list]:
        side, root = np.array(columns[4]), np.unique(columns[6], return_inverse=True)[1]
        prints = np.frombuffer(b"".join(columns[5]), dtype=np.uint8).reshape(len(side), -1)[:, :width].copy()
        wide, chosen = prints.view(np.uint64), np.zeros(len(side), dtype=bool)
        for row in range(len(side)):
            with_ = np.flatnonzero(_across(root, side, row))
            near = with_[np.bitwise_count(wide[with_] ^ wide[row]).sum(axis=1) <= radius]
            chosen[near] = True
        at = np.flatnonzero(chosen).tolist()
        return [[c[i] for i in at] for c in columns[:7]]

    return by_tile(tiled, run, TILE_SCHEMA)


def exact_links(tiled: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) that join the rows of each tile wherever two of different roots share
    at least so much of their shingles: every such pair is compared, exactly. tiled is
    (TILE_SCHEMA, __body)."""
    def run(columns: list[list]) -> list[list]:
        side, root = np.array(columns[4]), np.unique(columns[6], return_inverse=True)[1]
        sets = [np.unique(shingle_hashes(t, words)) for t in columns[7]]
        size = np.array([len(x) for x in sets])
        number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        owner, ends = np.repeat(np.arange(len(sets)), size), np.cumsum(size)
        a, b, marked = [], [], np.zeros(len(number) + 1, dtype=bool)
        for row in range(len(sets)):
            own = number[ends[row] - size[row]:ends[row]]
            marked[own] = True
            shared = np.bincount(owner[marked[number]], minlength=len(sets))
            marked[own] = False
            hit = np.flatnonzero((shared >= similarity * (size + size[row] - shared)) & _across(root, side, row))
            a.append(np.full(len(hit), row))
            b.append(hit)
        label = _labels(len(sets), np.concatenate(a), np.concatenate(b))
        child = np.flatnonzero(label != np.arange(len(sets)))
        return [[columns[5][i] for i in child], [columns[5][i] for i in label[child]]]

    return by_tile(tiled, run, "a binary, b binary")


def sharing_rows(tiled: DataFrame, similarity: float) -> DataFrame:
    """The rows of each tile (TILE_SCHEMA) that may have the similarity with a row of another
    root: all that have it, and few others. tiled is (TILE, __mine, __fp, __root, size, last,
    tokens, more), rows of one rare shingle.

    Sizes must be near enough, and so must the number of shingles that the two prefixes
    share: beyond the prefix that ends first, a set has at most its other shingles to share.
    Of the tokens, the first TOKENS are compared; the `more` that follow may all be shared.
    A pair is taken where the first of the shared ones is the tile's key.
    """
    def run(columns: list[list]) -> list[list]:
        root = np.unique(columns[6], return_inverse=True)[1]
        if len(root) == 2 and root[0] == root[1]:
            return [[] for _ in range(7)]
        side, size, last, more = (np.array(columns[i]) for i in (4, 7, 8, 10))
        counts = [len(t) for t in columns[9]]
        owner, ends = np.repeat(np.arange(len(side)), counts), np.cumsum(counts)
        tokens = np.array([x for t in columns[9] for x in t], dtype=np.int64)
        kinds, number = np.unique(tokens, return_inverse=True)
        key = np.searchsorted(kinds, columns[1][0])
        mine, chosen = np.zeros(len(kinds) + 1, dtype=bool), np.zeros(len(side), dtype=bool)
        rest = size - least_shared(size, similarity) + 1
        for row in range(len(side)):
            own = number[ends[row] - counts[row]:ends[row]]
            mine[own] = True
            hit = mine[number]
            mine[own] = False
            met = np.bincount(owner[hit], minlength=len(side))
            first = np.full(len(side), len(kinds))
            np.minimum.at(first, owner[hit], number[hit])
            both = least_shared(size + size[row], similarity / (1 + similarity))
            need = both - np.where(last <= last[row], size - rest, size[row] - rest[row])
            near = np.minimum(size, size[row]) >= similarity * np.maximum(size, size[row]) - EPSILON
            here = (first == key) | (first == len(kinds))
            chosen |= near & here & (met + more + more[row] >= need) & _across(root, side, row)
        at = np.flatnonzero(chosen).tolist()
        return [[c[i] for i in at] for c in columns[:7]]

    return by_tile(tiled, run, TILE_SCHEMA)


def left_links(keyed: DataFrame, prints: DataFrame, joined: DataFrame, id_col: str, text_col: str, words: int,
               similarity: float) -> DataFrame:
    """Links (a, b) of all pairs of the similarity that joined (node, root) does not hold
    together, exactly: an exact join by prefixes of rare shingles, whatever was found before."""
    rows = materialise(prints.select("__doc_id", "__text", "__fp").distinct(), "simhash-rows")
    model, row = F.min(F.struct("__doc_id", "__text")).alias("__model"), F.struct("__doc_id", "__text")
    spare = materialise(rows.join(rows.groupBy("__fp").agg(model), "__fp").where(
        ~row.eqNullSafe(F.col("__model"))).select("__doc_id", F.col("__text").alias("__same")), "simhash-spare")
    # copies of a set are left out; those that slip in only meet their own kind
    single = keyed.join(bounded_broadcast(spare), F.col(id_col).eqNullSafe(F.col("__doc_id")) & (
        F.col("__text") == F.col("__same")), "left_anti")
    letters = keyed.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    found = materialise(rare_prefixes(
        single.select(F.col(text_col).alias("__body")), "__body",
        lambda text: np.unique(shingle_hashes(text, words)), similarity, letters // 6).distinct(), "simhash-prefixes")
    digest = F.expr("substring(__fp, -16, 16)")
    nodes = rows.select("__fp").distinct().join(joined.withColumnRenamed("node", "__fp"), "__fp", "left").select(
        digest.alias("digest"), "__fp", F.coalesce("root", "__fp").alias("__root"))
    listed = materialise(found.join(nodes, "digest").select(
        F.lit(0).alias("__table"), F.col("token").alias("__key"), "__fp", "__root", "rank", "size", "last"), "simhash-listed")
    mixed = listed.groupBy("__table", "__key").agg(F.min("__root").alias("l"), F.max("__root").alias("m")).where("l < m")
    tokens = listed.join(mixed, ["__table", "__key"], "left_semi").groupBy("__fp", "__root", "size", "last").agg(
        F.array_sort(F.collect_list(F.struct("rank", "__key"))).alias("__all"))
    blocks = materialise(tokens.select(
        F.lit(0).alias("__table"), F.explode(F.array_distinct("__all.__key")).alias("__key"), "__fp", "__root", "size", "last",
        F.slice("__all.__key", 1, TOKENS).alias("tokens"), F.greatest(F.size("__all") - TOKENS, F.lit(0)).alias("more")),
        "simhash-sharing")
    tiled = tiles(blocks, "__root", "size", "last", "tokens", "more").select(
        "__table", "__key", F.col("__x").cast("int").alias("__x"), F.col("__y").cast("int").alias("__y"), "__mine", "__fp",
        "__root", "size", "last", "tokens", "more")
    open_ = materialise(sharing_rows(tiled, similarity), "simhash-sharing-open")
    texts = model_texts(open_, keyed, prints, id_col, text_col)
    return materialise(exact_links(open_.join(texts, "__fp").select(*open_.columns, "__body"), words, similarity),
                       "simhash-left")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                         similarity: float = 0.8, bits: int = 256, tables: int = 6) -> DataFrame:
    """The documents with their own columns, one of each near-duplicate group: the one
    with the smallest id.

    At a similarity of 0.8 a sixth of all bits differ, which pigeonhole tables cannot
    find without comparing nearly all pairs. So blocks are the texts that share the
    smallest hash of their shingles in one of several orders (all but 0.2 ** 6 of the
    pairs of that similarity meet), and fingerprints are wide. Each block is compared
    bit-sliced within a radius with room for the spread of the estimate; the shortest
    links that hold its components together are then verified on the whole texts. Of the
    parts that are still apart, all pairs within the radius are compared on whole texts.
    What blocks or the radius have left out is found by an exact join of all texts by
    prefixes of rare shingles, of which only pairs of different groups are compared.

    Null and blank texts are copies of each other. Rows of the smallest id leave one, that
    of the smallest text digest if their texts differ; null ids come last.
    """
    keyed = docs.withColumn("__text", F.xxhash64(text_col))
    prints = materialise(add_fingerprints(docs, id_col, text_col, words, bits, tables, sets=True), "simhash")
    blocks = prints.select("__fp", F.posexplode("__keys").alias("__table", "__key")).distinct()
    radius = radius_of(similarity, bits, RADIUS_SLACK)
    links = materialise(near_links(tiles(blocks), radius, 1, bits // 8).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-links")
    texts = model_texts(links.select(F.explode(F.array("a", "b")).alias("__fp")), keyed, prints, id_col, text_col)
    joined = connected_components(materialise(similar_links(links, texts, words, similarity), "simhash-verified"))
    rooted = materialise(blocks.join(joined.withColumnRenamed("node", "__fp"), "__fp", "left").select(
        "__table", "__key", "__fp", F.coalesce("root", "__fp").alias("__root")), "simhash-rooted")
    mixed = rooted.groupBy("__table", "__key").agg(F.min("__root").alias("l"), F.max("__root").alias("m")).where("l < m")
    tiled = tiles(rooted.join(mixed, ["__table", "__key"], "left_semi"), "__root").select(
        "__table", "__key", F.col("__x").cast("int").alias("__x"), F.col("__y").cast("int").alias("__y"), "__mine",
        "__fp", "__root")
    open_ = materialise(open_rows(tiled, radius, bits // 8), "simhash-open")
    rest = exact_links(open_.join(model_texts(open_, keyed, prints, id_col, text_col), "__fp").select(
        *open_.columns, "__body"), words, similarity)
    def stars(joined: DataFrame) -> DataFrame:
        return joined.select(F.col("node").alias("a"), F.col("root").alias("b"))

    joined = connected_components(stars(joined).unionByName(materialise(rest, "simhash-exact")))
    linked = connected_components(stars(joined).unionByName(
        left_links(keyed, prints, joined, id_col, text_col, words, similarity)))
    first = F.min(F.struct(F.col("__doc_id").isNull().alias("__none"), "__doc_id", "__text")).alias("__first")
    kept = prints.join(linked.withColumnRenamed("node", "__fp"), "__fp", "left").groupBy(
        F.coalesce("root", "__fp").alias("__root")).agg(first).select(
        F.col("__first.__doc_id").alias("__kept_id"), F.col("__first.__text").alias("__kept_text"))
    rows = keyed.join(kept, F.col(id_col).eqNullSafe(F.col("__kept_id")) & (
        F.col("__text") == F.col("__kept_text")))
    nth = F.row_number().over(Window.partitionBy("__kept_id", "__kept_text").orderBy(F.lit(0)))
    return rows.withColumn("__nth", nth).where(F.col("__nth") == 1).select(docs.columns)
