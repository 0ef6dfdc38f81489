"""The training-data operators against brute force, on small fixtures with nulls, empty
and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

import corpus_pipeline
from reviewmill.llm import (components, decontamination, exact_dedup, language_id, line_dedup, mixing, prefixes,
                            sharding, simhash, token_counts, toxicity, url_filter)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = " ".join(f"wort{i}" for i in range(120))
TEXTS = [
    BASE, BASE, BASE.upper(), BASE + " more", "x " + BASE, None, "", " \t\n", "short", "Short", "a b", "a  b ",
    "ÄÖ ü é", "äö ü é", "the same line of more than forty characters here\nother", "  The same line of more than forty CHARACTERS here \t\nx",
] + [f"text {i}\nthe same line of more than forty characters here" for i in range(5)] + ["long " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["a", "b", None, "c"][i % 4], 1) for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, BASE, None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def table(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def words(text):
    return (text or "").encode().lower().split()


def test_mixing(spark, docs, none):
    got = mixing.mix_decisions(docs).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["times"]
    sizes = {s: sum(r["size"] for r in rows) for s, rows in by.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    open_, want, left = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, sum(sizes.values())
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if 3 * sizes[s] < level * open_[s]]
        want |= {s: 3 * sizes[s] for s in full} if full else {s: level * w for s, w in open_.items()}
        left -= sum(3 * sizes[s] for s in full)
        open_ = {s: w for s, w in open_.items() if s not in want}
    for s, rows in by.items():
        assert rows[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in rows) - want[s]) <= max(r["size"] for r in rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_decisions(docs).collect()))
    mixed = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert mixed[7] == {r["doc_id"]: r["times"] for r in got}[7]
    assert mixing.mix_decisions(none).count() == 0 and mixing.mix(none).columns == none.columns


def fp64(text, k=4):
    w = words(text)
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def reach(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash(docs, none):
    rows = table(docs)
    prints = [fp64(t) for _, t in rows]
    label = reach(range(len(rows)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    first = {c: min((rows[i][0] for i in label if label[i] == c and rows[i][0] is not None), default=None)
             for c in set(label.values())}
    want = sorted(str((rows[i][0], f"{prints[i]:016x}", first[label[i]])) for i in label)
    assert sorted(str(tuple(r)) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("rows,pieces", [(10, 1), (10 ** 8, 2), (10 ** 10, 3)])
def test_pigeonhole_tables_lose_no_pair(rows, pieces):
    scheme = simhash.band_scheme(rows, 64, 4)
    assert len(scheme[0]) == pieces
    random = np.random.default_rng(1)
    for _ in range(200):
        differ = random.choice(64, 4, replace=False)
        assert any(not any(lo <= d < hi for d in differ for lo, hi in kept) for kept in scheme)


@pytest.mark.parametrize("two,radius,width", [(False, 4, 8), (True, 4, 8), (False, 52, 32)])
def test_bit_sliced_comparison(two, radius, width):
    random = np.random.default_rng(3)
    centre = random.integers(0, 256, (9, width), dtype=np.uint8)
    prints = centre[random.integers(0, 9, 300)]
    for row in prints:
        for bit in random.choice(width * 8, random.integers(0, 5), replace=False):
            row[bit // 8] ^= 1 << bit % 8
    side = random.integers(0, 2, 300) if two else np.zeros(300, dtype=int)
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= radius
    if two:
        near &= side[:, None] != side[None]
    a, b = np.nonzero(near)
    want = simhash._labels(300, a, b)
    for forests in (0, 1, 3):
        x, y, forest = simhash.tile_links([(prints, side)], radius, forests)
        assert np.array_equal(simhash._labels(300, x, y), want)
        assert (forest == 0).sum() == 300 - len(set(want.tolist()))


def test_forests_keep_links_of_every_cut():
    random = np.random.default_rng(5)
    a, b = np.nonzero(np.triu(random.random((40, 40)) < 0.2, 1))
    x, y, forest = simhash._forests(40, a, b, random.integers(0, 50, len(a)), 3)
    assert len(set(zip(x.tolist(), y.tolist()))) == len(x)
    for part in (random.random((200, 40)) < random.random((200, 1))):
        across = (part[a] != part[b]).sum()
        assert (part[x] != part[y]).sum() >= min(3, across)
        assert len(set(forest[part[x] != part[y]].tolist())) == min(3, across)


def test_large_blocks_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    prints = [(0, 1, bytes([i % 2 * 255] * 7 + [i])) for i in range(40)]
    df = spark.createDataFrame(prints, "__table int, __key long, __fp binary")
    links = [(bytes(r["a"]), bytes(r["b"])) for r in simhash.near_links(simhash.tiles(df), 8).collect()]
    label = reach([p for *_, p in prints], lambda a, b: (a, b) in links)
    assert len(set(label.values())) == 2


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in (100, 101, 103)}


def test_near_duplicate_stage(docs, none):
    kept = simhash.drop_near_duplicates(docs).collect()
    rows = table(docs)
    sets = [{tuple(words(t)[i:i + 5]) for i in range(max(1, len(words(t)) - 4))} if words(t) else set() for _, t in rows]
    label = reach(range(len(rows)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    want = {min((rows[i][0] for i in label if label[i] == c and rows[i][0] is not None)) for c in label.values()}
    assert sorted(r["doc_id"] for r in kept) == sorted(want)
    assert simhash.drop_near_duplicates(none).count() == 0


def texts_frame(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)


def brute_kept(texts, similarity=0.8):
    sets = [{tuple(words(t)[i:i + 5]) for i in range(max(1, len(words(t)) - 4))} if words(t) else set() for t in texts]
    label = reach(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]))
    return sorted(set(label.values()))


def test_repeated_passages_are_near_copies(spark):
    random = np.random.default_rng(11)
    texts = []
    for t in range(6):
        body = [f"p{t}x{random.integers(10 ** 9)}" for _ in range(100)]
        texts += [" ".join(body), " ".join(body + body[:14] * 20)]
    kept = simhash.drop_near_duplicates(texts_frame(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == brute_kept(texts) == [0, 2, 4, 6, 8, 10]


def test_texts_of_one_fingerprint_are_verified(spark):
    rows = [(0, 1, bytes(32) + bytes([i] * 16)) for i in range(3)]
    tiled = simhash.tiles(spark.createDataFrame(rows, "__table int, __key long, __fp binary"))
    links = simhash.near_links(tiled, 5, 1, 32).collect()
    assert {bytes(x) for r in links for x in (r["a"], r["b"])} == {r[2] for r in rows}
    texts = [" ".join(f"t{t}w{i}" for i in range(60)) + " ." * 90 for t in range(3)] + ["a b c", "A  b c"]
    kept = simhash.drop_near_duplicates(texts_frame(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == brute_kept(texts) == [0, 1, 2, 3]


def test_a_group_keeps_one_document_whatever_its_ids(spark):
    """Near copies of one id, and near copies without any, leave one document too."""
    body = [[f"g{g}w{i}" for i in range(60)] for g in range(3)]
    texts = [(i, " ".join(body[g] + more)) for g, ids in enumerate([(7, 7, 8), (None, None, None), (None, 9, 9)])
             for i, more in zip(ids, ([], ["one"], ["two"]))] + [(7, "another text of the first id")]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], SCHEMA)
    kept = simhash.drop_near_duplicates(frame.unionByName(frame)).collect()
    assert sorted((r["doc_id"] or 0, r["text"].split()[0]) for r in kept) == [
        (0, "g1w0"), (7, "another"), (7, "g0w0"), (9, "g2w0")]


def test_every_open_pair_is_compared(spark):
    random = np.random.default_rng(12)
    texts = []
    for n in range(12):
        body = [f"v{random.integers(10 ** 9)}" for _ in range(100)]
        texts.append(" ".join([f"s{i}" for i in range(300)] + body))
    texts += [t + " " + " ".join(f"e{n}x{i}" for i in range(40)) for n, t in enumerate(texts)]
    sides = [(0, 1, 0, 0, 0, bytes([i]) * 48, bytes([i]) * 48, t) for i, t in enumerate(texts)]
    tiled = spark.createDataFrame(sides, simhash.TILE_SCHEMA + ", __body string")
    got = [(r["a"][0], r["b"][0]) for r in simhash.exact_links(tiled, 5, 0.8).collect()]
    label = reach(range(len(texts)), lambda a, b: (a, b) in got or (b, a) in got)
    assert sorted(set(label.values())) == brute_kept(texts) == list(range(12))
    assert simhash.open_rows(tiled.drop("__body"), 256, 32).count() == 24
    assert simhash.open_rows(tiled.drop("__body").where("hex(__fp) < '01'"), 256, 32).count() == 0


def test_a_pair_that_shares_no_smallest_hash_is_found(spark):
    body = [f"n42635w{i}" for i in range(19)]
    texts = [" ".join(body[:16]), " ".join(body)] + [" ".join(f"o{t}w{i}" for i in range(30)) for t in range(3)]
    one, two = (simhash.min_shingles(simhash.shingle_hashes(t, 5), 6) for t in texts[:2])
    assert not set(one) & set(two)
    kept = simhash.drop_near_duplicates(texts_frame(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == brute_kept(texts) == [0, 2, 3, 4]


def test_no_link_is_left_out_beyond_the_radius(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RADIUS_SLACK", -0.9)
    monkeypatch.setattr(simhash, "CHUNK", 3)
    monkeypatch.setattr(simhash, "TOKENS", 4)
    monkeypatch.setattr(prefixes, "BLOCK", 200)
    random = np.random.default_rng(14)
    texts = [None, "", " \t", "a b", "A  b", "a b c"]
    for t in range(12):
        body = [f"f{t // 3}w{i}" for i in range(60)] + [f"r{t}w{i}" for i in range(random.integers(0, 30))]
        texts += [" ".join(body), " ".join(body[:-random.integers(1, 12)]), " ".join(body + ["end"] * 40)]
        texts.append(" ".join(body[random.integers(1, 20):]))
    frame = texts_frame(spark, texts)
    kept = simhash.drop_near_duplicates(frame.unionByName(frame), tables=1).collect()
    assert sorted(r["doc_id"] for r in kept) == brute_kept(texts)
    empty = simhash.drop_near_duplicates(texts_frame(spark, [None, "", " "])).collect()
    assert [r["doc_id"] for r in empty] == [0]


def test_prefixes_of_similar_sets_meet(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 300)
    monkeypatch.setattr(prefixes, "SEGMENT", 200)
    random = np.random.default_rng(15)
    lists_ = [[]]
    for _ in range(120):
        base = lists_[random.integers(len(lists_))]
        old = [x for x in base if random.random() < 0.9] if random.random() < 0.7 else []
        lists_.append(old + [f"m{random.integers(3000)}" for _ in range(random.integers(0, 12))])
    lists_ = [sorted(set(x)) for x in lists_ + [["common"] + x for x in lists_]]

    def set_of(text):
        return np.unique(np.array([xxhash.xxh64_intdigest(w) for w in text.split()], dtype=np.uint64))

    texts = sorted({" ".join(x) for x in lists_})
    rows = prefixes.rare_prefixes(spark.createDataFrame([(t,) for t in texts], "t string"), "t", set_of, 0.8, 3000).collect()
    tokens = defaultdict(set)
    for r in rows:
        tokens[bytes(r["digest"])].add(r["token"])
    sets = {xxhash.xxh3_128_digest(set_of(t).tobytes()): set(t.split()) for t in texts if t}
    assert {bytes(r["digest"]): r["size"] for r in rows}.items() <= {d: len(s) for d, s in sets.items()}.items()
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(near) > 50 and all(tokens[a] & tokens[b] for a, b in near)
    assert all(r["rank"] <= 0.2 * r["size"] + 1e-9 for r in rows)


@pytest.mark.parametrize("a,b,shared", [(4, 5, 4), (12, 15, 12), (36, 45, 36), (360, 360, 320)])
def test_radius_covers_the_spread_of_the_estimate(a, b, shared):
    random = np.random.default_rng(13)
    apart = []
    for _ in range(300):
        h = np.frombuffer(random.bytes(8 * (a + b - shared)), dtype=np.uint64)
        x, y = (np.frombuffer(simhash.fingerprint(part, 256), dtype=np.uint8) for part in (h[:a], h[a - shared:]))
        apart.append(int(np.bitwise_count(x ^ y).sum()))
    assert np.mean(apart) + 6 * np.std(apart) <= simhash.radius_of(0.8, 256, simhash.RADIUS_SLACK) + 2


def test_languages(spark, none):
    kinds = {"en": "the and tion ing", "de": "der und ung keit", "fr": "le des eux ment"}
    random = np.random.default_rng(0)
    rows = [(i, " ".join(random.choice(kinds[k].split(), 12)), k, None, None)
            for i, k in enumerate(random.choice(list(kinds), 300))]
    rows += [(900, None, "en", None, None), (901, "123 !", "en", None, None), (None, "the and the", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in language_id.identify_languages(df).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {r[0] for r in held} == {i for i in range(300) if got[i]["held_out"]}
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.98
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify_languages(none).count() == 0


def test_lines(docs, none):
    rows = table(docs)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    holders = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].append(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5
                or i == max((h for h in holders[key(x)] if h is not None), default=None)]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [tuple(r) for r in line_dedup.drop_repeated_lines(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[2] for r in got) > 5
    assert line_dedup.drop_repeated_lines(none).count() == 0


def test_saturated_filters_only_suspect_more(docs, monkeypatch):
    want = sorted(map(str, line_dedup.drop_repeated_lines(docs).collect()))
    monkeypatch.setattr(line_dedup, "BITS", 0)
    assert sorted(map(str, line_dedup.drop_repeated_lines(docs).collect())) == want


def test_filters_above_the_bound_stay_where_they_are(spark, docs, none):
    want = sorted(map(str, line_dedup.drop_repeated_lines(docs).collect()))
    assert sorted(map(str, line_dedup.drop_repeated_lines(docs, max_bytes=1).collect())) == want
    assert line_dedup.drop_repeated_lines(none, max_bytes=-1).count() == 0


def test_few_lines_are_suspected_however_many_there_are(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SEGMENT_HASHES", 16)
    texts = [(i, "\n".join([f"{i} {j} a line of its own that is long enough for a key" for j in range(12)]
                           + ["a line that all documents share, longer than forty"])) for i in range(600)]
    docs = spark.createDataFrame(texts, "__doc_id long, __text string").repartition(5)
    filters, segments = line_dedup.twice_seen(line_dedup._hashes(docs, 40))
    assert segments == 512 and filters.count() <= 512
    found = line_dedup._suspects_by_segment(docs, filters, segments, 40)
    shared = found.where("__key like 'a line that all%'").count()
    assert shared == 600 and found.count() - shared < 0.05 * 600 * 12
    again = line_dedup._suspects(docs, {r[0]: bytes(r[1]) for r in filters.collect()}, segments, 40)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("primes", [exact_dedup.PRIMES, (3, 2)])
def test_exact(docs, none, primes):
    low = lambda t: (t or "").encode().lower()
    groups = defaultdict(list)
    for i, t in table(docs):
        groups[low(t)].append(i)
    first, want = set(), []
    for i, t in table(docs):
        keep = max((x for x in groups[low(t)] if x is not None), default=None)
        kept = i == keep and low(t) not in first  # one row, also of a repeated id
        first |= {low(t)} if kept else set()
        want.append((i, keep, len(groups[low(t)]), kept, hashlib.sha256(low(t)).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_duplicates(docs, primes=primes).collect()]
    assert sum(r[3] for r in got) == len(groups)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_polynomials_compose():
    data = bytes(range(256)) * 700
    for prime, base in zip(exact_dedup.PRIMES, exact_dedup.BASES):
        plain = 0
        for byte in data:
            plain = (plain * base + byte) % prime
        assert exact_dedup.polynomial(data, prime, base, exact_dedup._powers(prime, base)) == plain


def test_token_counts(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    merger = token_counts.Merger.load(path)
    random = np.random.default_rng(2)
    letters = list("abe  \n\t▁.<s>/▁éß漢😀0\r\x00")
    for text in ["", " ", "\n", "  a▁b \n c", "<s></s><unk><0x0A>", "a\n\n  b", "aaaaaaaaaaaaaaaaaaaaaaa"] + [
            "".join(random.choice(letters, random.integers(1, 40))) for _ in range(500)]:
        assert merger.count(text) == len(model.encode(text)), repr(text)
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"])
           for r in token_counts.count_tokens(docs, path).collect()}
    assert got == {(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in table(docs)}
    assert token_counts.count_tokens(none, path).count() == 0


def passages(spark):
    items = [(1, " ".join(f"B{i}" for i in range(30))), (2, "three little words"), (3, "single"), (4, None), (5, ""),
             (6, " ".join(f"b{i}" for i in range(5, 20))), (7, "Ünï, cödé! words")]
    texts = ["filler " * 5 + " ".join(f"b{i}" for i in range(4, 24)) + " tail", "Three, LITTLE words three little words",
             "a single word " + "x " * 200, None, "", "ünï cödé words", "Ünï cödé WORDS", "b1 b2 b3", "single"]
    docs = [(i, t, "kept", 5, True) for i, t in enumerate(texts)] + [(0, texts[0], "again", 5, True),
                                                                   (0, "clean", "c", 1, False), (None, texts[1], "n", 2, True)]
    return (spark.createDataFrame(docs, "doc_id long, text string, items string, n_hit long, contaminated boolean"),
            spark.createDataFrame(items, "item_id long, text string"))


def brute_contamination(text, items):
    cut = lambda t: [w for w in "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in (
        t or "").translate({i: i + 32 for i in range(65, 91)})).split(" ") if w]
    own, hit, found = cut(text), set(), set()
    for item, body in items:
        w = cut(body)
        n = min(13, len(w))
        for s in range(len(w) - n + 1) if w else ():
            for p in range(len(own) - n + 1):
                if own[p:p + n] == w[s:s + n]:
                    hit.update(range(p, p + n))
                    found.add(item)
    return len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)


def test_decontamination(spark):
    docs, items = passages(spark)
    plain = docs.select("doc_id", "text")
    got = decontamination.find_benchmark(plain, items).collect()
    want = [(r["doc_id"], *brute_contamination(r["text"], map(tuple, items.collect()))) for r in plain.collect()]
    assert sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"])) for r in got) == sorted(
        map(str, want))
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r, w in zip(docs.collect(), want) if not w[-1])
    assert decontamination.find_benchmark(plain.limit(0), items).count() == 0
    assert decontamination.find_benchmark(plain, items.limit(0)).where("n_hit > 0").count() == 0


def test_urls(spark):
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1?x", "http://www.example.com/en/", "http://b.www.example.com/en/q#z",
            "http://example.com/entry", "http://x.net/es/1", "http://net/fr/", "http://x.com", "x.com/a", None, "", "http://",
            "http://.com/", "http://com./", "ftp://q.org/://a.com/", "http://x.net/es/1"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string")

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fit = [(len(h) + len(p), h + p, v) for h, p, v in url_filter.RULES
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    got = url_filter.judge_urls(pages, url_filter.rule_table(spark))
    assert got.columns == ["page_id", "url", "rule", "host", "path", "verdict"]
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == {
        i: judge(u) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    assert url_filter.judge_urls(pages, url_filter.rule_table(spark, [])).where("verdict = 'block'").count() == 0
    for rules in ([("q.org", "/", "allow"), ("q.org", "/", "block")], [("q.org", "/", "block"), ("q.org", "/", "allow")]):
        judged = url_filter.judge_urls(pages, url_filter.rule_table(spark, rules))
        assert [r["page_id"] for r in judged.where("verdict = 'block'").collect()] == [14]


def toxic_rows(spark):
    random = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, " ".join([f"w{x}" for x in random.choice(list("abcdefgh"), 20)] + ["vile", "rotten"] * bad),
                     "en", "s", 1))
        labels.append((i, int(bad)))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (None, "so vile and rotten", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(5, None), (7777, 1)],
                                                                      "doc_id long, toxic int")


def test_toxicity(spark, none):
    docs, labels = toxic_rows(spark)
    model = toxicity.train_on_documents(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i]["predicted"] == 1) == (i % 5 == 0) for i in range(400))
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0 and got[None]["predicted"] == 1
    clean = toxicity.drop_toxic(docs, model)
    assert clean.columns == docs.columns and clean.count() == 320 + 2
    assert toxicity.train_on_documents(none, labels) == 0.0
    assert toxicity.train_on_documents(docs, labels.limit(0)) == 0.0
    assert toxicity.score(none, 0.0).count() == 0


def test_repeated_rows_do_not_fill_the_sample(spark):
    rows = [(i, f"w{i} w{i + 1}", "en" if i % 2 else "de", None, None) for i in range(40)]
    docs = spark.createDataFrame(rows[:1] * 200 + rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, rows=40)
    want = [i % 2 for i in range(40)]
    assert not isinstance(model, float)
    assert sorted(zip(model.ids, model.toxic.tolist())) == list(enumerate(want))
    source = docs.selectExpr("doc_id __doc_id", "text __text", "lang __label")
    sample = language_id.labelled_sample(source.select("__doc_id", "__label").distinct(), 40)
    got = sorted(map(tuple, language_id.sampled_texts(source, sample).select("__doc_id", "__label", "__text").collect()))
    assert got == sorted((i, y, t) for i, t, y, *_ in rows)
    taught = language_id.train(docs, "doc_id", "text", "lang", docs.doc_id.isNotNull(), rows=40)
    assert taught.languages == ["de", "en"]


def test_words_of_toxic_texts_only_are_terms(spark):
    rows = [(int(i < 288), ["common", "vile"] if i < 17 else ["common"]) for i in range(2636)]
    found = toxicity.telling_terms(spark.createDataFrame(rows, "label int, terms array<string>"), 288, 2348)
    assert found == ["vile"]
    cells = spark.createDataFrame([(17, 0), (7, 1), (4, 0)], "a long, b long")
    for a, b, g in cells.withColumn("g", toxicity.g_statistic(cells.a, cells.b, 288, 2348)).collect():
        table = [(a, 288, a + b), (b, 2348, a + b), (288 - a, 288, 2636 - a - b), (2348 - b, 2348, 2636 - a - b)]
        assert g == pytest.approx(sum(2 * n * np.log(n * 2636 / (r * c)) for n, r, c in table if n))
        assert g >= toxicity.TELLING


def index_of(texts, names, idf, toxic):
    terms = toxicity.Terms(names)
    return toxicity.build_index(list(range(len(texts))), terms.rows(texts), toxic, np.ones(len(texts)), terms, idf)


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "FREQUENT", 0.1)
    random = np.random.default_rng(8)
    n, names = 500, [a + b for a in "abcdef" for b in "qrstuvwxyz"]
    text = lambda k: " ".join(random.choice(names, k)).encode()
    texts = [text(random.integers(1, 12)) for _ in range(n)] + [b"", None, b"none of them"]
    idf = random.uniform(0.5, 3, 60)
    model = index_of(texts, names, idf, random.integers(0, 2, len(texts)))

    def unit(t):
        held = Counter((t or b"").decode().split())
        v = np.array([(1 + np.log(held[x])) * w if held[x] else 0 for x, w in zip(names, idf)])
        return v / (np.linalg.norm(v) or 1)

    dense = np.array([unit(texts[i]) for i in model.ids])
    assert 0 < len(model.dense) < 60
    asked = [text(6) for _ in range(50)] + texts[:3] + [b"", None]
    row, term, tf = model.terms.rows(asked)
    w = model.weigh(row, term, tf, len(asked))
    for but in (None, np.arange(len(asked))):
        for i, (near, cosine) in enumerate(model.nearest(row, term, w, len(asked), 15, but)):
            every = dense @ unit(asked[i])
            if but is not None:
                every[i] = 0
            assert np.allclose(cosine, [x for x in np.sort(every)[::-1][:15] if x > 1e-12])
            assert np.allclose(every[near], cosine)
            assert len(set(near.tolist())) == len(near)


def test_terms_are_words_and_beginnings():
    assert toxicity.term_counts("Über-BÖSE Wörter; 2x b\u00f6se\u2014gut_so".encode()) == Counter(
        {"über": 1, "böse": 2, "wörter": 1, "x": 1, "gut": 1, "so": 1, "übe*": 1, "bös*": 2, "wör*": 1,
         "wört*": 1, "wörte*": 1})
    assert toxicity.term_counts(None) == toxicity.term_counts(b"") == toxicity.term_counts(b"12 _ !") == Counter()


def slow_toxicity(docs, labels, n_all):
    """Scores, predictions and evidence as dense vectors, without index, blocks and memory."""
    taught = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 3 != 1}
    bags = {i: toxicity.term_counts((t or "").encode()) for i, t in docs}
    ids = sorted(taught)
    n1 = sum(taught.values())
    n0, n = len(ids) - n1, len(ids)
    g = {}
    for term in {t for i in ids for t in bags[i]}:
        a, b = (sum(term in bags[i] for i in ids if taught[i] == y) for y in (1, 0))
        cells = [(a, n1, a + b), (b, n0, a + b), (n1 - a, n1, n - a - b), (n0 - b, n0, n - a - b)]
        if a + b >= toxicity.LEAST_TEXTS:
            g[term] = sum(2 * c * np.log(c * n / (r * k)) for c, r, k in cells if c)
    names = sorted(t for t, v in g.items() if v >= toxicity.TELLING)
    idf = np.array([np.log((1 + n_all) / (1 + sum(t in bags[i] for i, _ in docs))) + 1 for t in names])

    def unit(i):
        v = np.array([1 + np.log(bags[i][t]) if bags[i][t] else 0.0 for t in names]) * idf
        return v / (np.linalg.norm(v) or 1)

    units = {i: unit(i) for i, _ in docs}
    heavy = {i: int(np.argmax(units[i])) if units[i].any() else -1 for i in ids}
    ids.sort(key=lambda i: (heavy[i], taught[i], i))
    truth = np.array([taught[i] for i in ids], dtype=float)
    matrix = np.array([units[i] for i in ids])

    def vote(i, but=None):
        cosine = matrix @ units[i]
        if but is not None:
            cosine[but] = 0
        near = [int(x) for x in np.lexsort((np.arange(n), -np.round(cosine, 12)))[:toxicity.NEIGHBOURS] if cosine[x] > 1e-12]
        w = cosine[near] ** toxicity.POWER
        return (w * truth[near]).sum() / (w.sum() + toxicity.IDLE), [ids[x] for x in near[:3]]

    x = np.array([[vote(i, but=k)[0], 1] for k, i in enumerate(ids)])
    y = np.where(truth == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        hessian = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        beta -= np.clip(np.linalg.solve(hessian, x.T @ (p - y) + 1e-3 * beta), -5, 5)
    return {i: (1 / (1 + np.exp(-beta @ [vote(i)[0], 1])), vote(i)[1]) for i, _ in docs}


def test_toxicity_against_a_slow_version(spark):
    random = np.random.default_rng(11)
    neutral, bad = [f"mild{a}{b}" for a in "abcdefgh" for b in "jklmn"], ["vile", "nastiness", "böse", "hateful"]
    rows, labels = [], {}
    for i in range(240):
        words = random.choice(neutral, random.integers(3, 25)).tolist()
        labels[i] = int(random.random() < 0.35)
        for _ in range(labels[i] * random.integers(1, 4) + int(random.random() < 0.1)):
            words.insert(int(random.integers(0, len(words))), str(random.choice(bad)))
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "unknown words only"), (503, "vile " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    want = slow_toxicity(rows, labels, len(rows))
    got = toxicity.score(docs, toxicity.train_on_documents(docs, marks)).collect()
    assert len(got) == len(rows) and len({r["predicted"] for r in got}) == 2
    for r in got:
        score, evidence = want[r["doc_id"]]
        assert r["score"] == pytest.approx(score, abs=1e-6)
        assert r["predicted"] == int(r["score"] >= toxicity.THRESHOLD)
        assert r["evidence"] == evidence


def test_sharding(docs, none):
    got = sharding.shard_plan(docs, 4).collect()
    assert len(got) == docs.count()
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    crc = {(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in table(docs)}
    assert {(r["doc_id"], r["text_crc32"], r["size"]) for r in got} == crc
    assert sharding.shard_plan(none).count() == 0
    placed = sharding.shard(docs, 4)
    assert placed.columns == [*docs.columns, "shard", "slot"] and placed.count() == docs.count()
    assert sorted((r["shard"], r["slot"]) for r in placed.collect()) == sorted((r["shard"], r["slot"]) for r in got)


def test_packing_is_even(spark):
    random = np.random.default_rng(6)
    rows = [(i, "hot" if i % 3 == 0 else "x" * int(random.integers(1, 90)), None, None, None) for i in range(8000)]
    got = sharding.shard_plan(spark.createDataFrame(rows, SCHEMA), 10).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() <= 1.06 * sizes.min()  # a group of equal texts is up to a tenth of a shard here
    groups = got.assign(text=[rows[i][1] for i in got.doc_id]).groupby("text").shard.nunique()
    assert groups.drop("hot").max() <= 2 < groups["hot"]  # the largest exceed an eighth of a shard


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.collect()
    assert rows and max(Counter(r["doc_id"] for r in rows).values()) <= 3
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(brute_contamination(r["text"], items)[-1] for r in rows[:40])


def test_texts_reach_python_in_small_batches(spark):
    from reviewmill.llm import common
    def sizes(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with common.small_batches(spark):
        written = common.materialise(spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n long"), "sizes")
    assert max(r["n"] for r in written.collect()) <= common.SLICE
    assert sum(r["n"] for r in written.collect()) == 1000
    assert spark.conf.get(name) == before
