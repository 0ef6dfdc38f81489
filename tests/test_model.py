import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from test_text import python_terms
from reviewmill.operators import evaluation, many_models, row_terms, sentiment, tfidf
from reviewmill.operators.correction import correct_by_rating, with_prediction
from reviewmill.operators.tfidf import feature_vectors, fit_terms, indexed_terms, weights
from reviewmill.plans.analysis import analyse
from reviewmill.session import materialise

GOOD = ["lovely dress fits well", "great shirt good fabric", "very good size and fit", "happy with this dress"]
BAD = ["bad fabric broke fast", "the size is wrong and bad", "poor shirt very thin", "never fits bad dress"]


def corpus():
    out = []
    for i in range(60):
        label = int(i % 3 != 0)
        words = (GOOD if label else BAD)[i % 4] + (" item" if i % 2 else " thing fit")
        out.append((i, words, label))
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(corpus(), "id int, t string, label int")


def python_tfidf(texts, min_df=2, max_df=0.95):
    counts = [Counter(python_terms(t)) for t in texts]
    df = Counter(t for c in counts for t in c)
    n = len(texts)
    vocab = sorted(t for t, k in df.items() if min_df <= k <= max_df * n)
    matrix = np.zeros((n, len(vocab)))
    for i, c in enumerate(counts):
        for j, t in enumerate(vocab):
            if c[t]:
                matrix[i, j] = (1 + math.log(c[t])) * (math.log((1 + n) / (1 + df[t])) + 1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return vocab, matrix / np.where(norms == 0, 1, norms)


def test_weights_agree_with_dense_computation(labelled):
    terms, n = fit_terms(labelled, "id", "t")
    got = {(i, t): w for i, t, w in rows(weights(labelled, "id", "t", terms))}
    vocab, matrix = python_tfidf([t for _, t, _ in corpus()])
    want = {(i, vocab[j]): matrix[i, j] for i, j in zip(*np.nonzero(matrix))}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def newton(x, y, c=1.0):
    """The minimum of C * weighted log loss + |w|^2 / 2 with a free intercept."""
    n = len(y)
    weight = np.where(y == 1, n / (2 * (y == 1).sum()), n / (2 * (y == 0).sum()))
    xb = np.hstack([x, np.ones((n, 1))])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(xb.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-xb @ w))
        gradient = c * xb.T @ (weight * (p - y)) + penalty @ w
        hessian = c * xb.T @ (xb * (weight * p * (1 - p))[:, None]) + penalty
        w -= np.linalg.solve(hessian, gradient)
    return w


def test_model_reaches_the_minimum(labelled, tmp_path, spark):
    model = sentiment.train(labelled, "id", "t")
    vocab, matrix = python_tfidf([t for _, t, _ in corpus()])
    want = newton(matrix, np.array([l for _, _, l in corpus()]))
    got = {r["term"]: r["coefficient"] for r in model.terms.collect()}
    assert sorted(got) == vocab
    assert max(abs(got[t] - want[j]) for j, t in enumerate(vocab)) < 1e-4
    assert abs(model.intercept - want[-1]) < 1e-4
    p = dict(rows(sentiment.score(labelled, "id", "t", model)))
    dense = 1 / (1 + np.exp(-(matrix @ want[:-1] + want[-1])))
    assert max(abs(p[i] - dense[i]) for i in p) < 1e-4
    model.save(str(tmp_path / "m"))
    again = sentiment.SentimentModel.load(spark, str(tmp_path / "m"))
    assert dict(rows(sentiment.score(labelled, "id", "t", again))) == p
    unknown = spark.createDataFrame([(1, "zzz qqq"), (2, None)], "id int, t string")
    lone = 1 / (1 + math.exp(-model.intercept))
    assert [round(r[1], 9) for r in rows(sentiment.score(unknown, "id", "t", model))] == [round(lone, 9)] * 2


def test_dataset_model_needs_ratings(spark):
    few = spark.createDataFrame([(i, "some text", "5") for i in range(30)], "id int, t string, stars string")
    assert sentiment.train_dataset(few, "id", "t", None, "general") is None
    assert sentiment.train_dataset(few, "id", "t", "stars", "general") is None  # one class only
    short = spark.createDataFrame([(i, "some text", str(1 + 4 * (i % 2))) for i in range(19)],
                                  "id int, t string, stars string")
    assert sentiment.train_dataset(short, "id", "t", "stars", "general") is None


def test_analyse_trains_on_ratings_and_falls_back(spark, labelled):
    base = sentiment.train(labelled, "id", "t")
    rated = spark.createDataFrame([(i, t, str(5 if l else 1)) for i, t, l in corpus()],
                                  "id int, `review text` string, stars string")
    own = analyse(rated, "id", base)
    assert own.roles["text"] == "review text" and own.roles["rating"] == "stars"
    assert own.domain == "clothing" and own.language == "English"
    assert own.model is not base and own.scorecard.first()["n_test"] + own.model.n_train == 60
    out = own.predictions
    assert {"Predicted_IND", "Predicted_Sentiment", "Confidence", "Confidence_Pct", "Rule_Corrected"} <= set(out.columns)
    assert out.count() == 60
    bad = out.where((F.col("stars") == "5") & (F.col("Predicted_IND") == 0)
                    | (F.col("stars") == "1") & (F.col("Predicted_IND") == 1))
    assert bad.count() == 0
    plain = analyse(rated.drop("stars"), "id", base)
    assert plain.model is base and plain.scorecard is None
    assert "Rule_Corrected" not in plain.predictions.columns


@pytest.mark.parametrize("bounds", [{}, {"max_rows": 5}])
def test_mixed_datasets_use_their_own_model(spark, labelled, bounds):
    base = sentiment.train(labelled, "id", "t", ["the"])
    flipped = sentiment.train(labelled.withColumn("label", 1 - F.col("label")), "id", "t")
    own = sentiment.DatasetModels(
        materialise(flipped.terms.withColumn("no", F.lit(0)), "t"),
        spark.createDataFrame([(0, "a", flipped.intercept, 60)], "no int, dataset string, intercept double, n_train long"),
        None, None)
    df = labelled.withColumn("ds", F.when(F.col("id") % 2 == 0, "a").when(F.col("id") % 5 == 0, None).otherwise("b"))
    got = {r[0]: r[1:] for r in rows(sentiment.score_datasets(df, "id", "t", "ds", own, base, **bounds))}
    assert len(got) == 60
    want_base = dict(rows(sentiment.score(labelled, "id", "t", base)))
    want_own = dict(rows(sentiment.score(labelled, "id", "t", flipped)))
    for i in got:
        model, want = ("dataset", want_own) if i % 2 == 0 else ("base", want_base)
        assert got[i][0] == model and abs(got[i][1] - want[i]) < 1e-12


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_is_in_the_row(spark, labelled):
    model = sentiment.train(labelled, "id", "t")
    docs = spark.createDataFrame(
        [(1, "lovely dress"), (1, "bad fabric"), (None, "good shirt"), (None, None), (2, "zzz")], "id int, t string")
    scored = sentiment.score(docs, "id", "t", model)
    assert "Exchange" not in plan_of(scored) and "Generate" not in plan_of(scored)
    whole = sentiment.with_score(docs, "t", model)
    assert "Exchange" not in plan_of(whole) and whole.columns == ["id", "t", "probability"]
    got = {(i, t): p for i, t, p in rows(whole)}
    assert len(got) == 5 and got[1, "lovely dress"] > 0.5 > got[1, "bad fabric"]
    joined = {(i, t): p for i, t, p in rows(sentiment.with_score(docs, "t", model, max_rows=3))}
    assert got.keys() == joined.keys() and all(abs(got[k] - joined[k]) < 1e-12 for k in got)


def test_weights_and_vectors_are_the_same_beyond_the_bound(spark, labelled):
    terms, _ = fit_terms(labelled, "id", "t")
    assert "Exchange" not in plan_of(weights(labelled, "id", "t", terms))
    near = {(i, t): w for i, t, w in rows(weights(labelled, "id", "t", terms, keep=[]))}
    far = {(i, t): w for i, t, w in rows(weights(labelled, "id", "t", terms, max_rows=3))}
    assert near.keys() == far.keys() and all(abs(near[k] - far[k]) < 1e-12 for k in near)
    indexed = indexed_terms(terms)
    blank = labelled.unionByName(spark.createDataFrame([(99, "zzz", 1), (99, None, 0)], labelled.schema))
    one, two = ({(r["id"], r["label"]): r["features"] for r in feature_vectors(
        blank, "id", "t", indexed, indexed.count(), keep=["label"], **bounds).collect()} for bounds in ({}, {"max_rows": 3}))
    assert one.keys() == two.keys() and len(one) == 62
    for k in one:
        assert one[k].indices.tolist() == two[k].indices.tolist() and one[k].size == two[k].size
        assert one[k].values == pytest.approx(two[k].values, abs=1e-12)


def test_row_lookup_agrees_with_joined_counts(spark):
    texts = [(0, "a bb cc bb cc dd"), (1, ""), (2, None), (3, "dd bb " * 400), (4, "cc dd. bb"), (4, "ee ee")]
    docs = spark.createDataFrame(texts, "id int, t string")
    names = ["bb", "bb cc", "dd bb", "ee ee", "ee", "xx yy", "cc dd"]
    found = row_terms.from_table(names, {})
    import pyarrow as pa
    words = [python_terms(t or "")[:len([w for w in python_terms(t or "") if " " not in w])] for _, t in texts]
    row, term, count = found.find(pa.array(words, pa.list_(pa.string())))
    got = {(int(r), names[t]): int(c) for r, t, c in zip(row, term, count)}
    want = {(r, t): c for r, (_, x) in enumerate(texts) for t, c in Counter(python_terms(x or "")).items() if t in names}
    assert got == want
    empty = row_terms.from_table([], {}).find(pa.array(words, pa.list_(pa.string())))
    assert [len(x) for x in empty] == [0, 0, 0]


def test_split_is_disjoint_and_stratified(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(4000)], "id int, label int")
    parts = evaluation.with_stratified_split(df, "id", "label")
    assert 700 < parts.where("is_test").count() < 900
    exact = evaluation.with_stratified_split(df, "id", "label").where("is_test").groupBy("label").count()
    assert {r[0]: r[1] for r in exact.collect()} == pytest.approx({0: 600, 1: 200}, abs=3)


def test_report_without_predictions_of_a_class(spark):
    counts = evaluation.confusion(spark.createDataFrame([(1, 1), (0, 1), (1, 1)], "label int, p int"), "label", "p")
    got = {r["class"]: r[:][1:] for r in evaluation.class_report(counts).collect()}
    assert got["Negative"] == (0.0, 0.0, 0.0, 1)
    assert got["Positive"] == pytest.approx((2 / 3, 1.0, 0.8, 2))
    assert got["accuracy"][2] == pytest.approx(2 / 3)


def test_correction_rules(spark):
    ratings = [None, "", "n/a", "nan", "4d", " 4 ", "2", "2.5", "3.9", "4"]
    df = spark.createDataFrame([(i, p, "Negative" if p == 0 else "Positive", r)
                                for i, (p, r) in enumerate((p, r) for p in (0, 1) for r in ratings)],
                               "id int, Predicted_IND int, Predicted_Sentiment string, stars string")
    got = {(r["id"] // 10, r["stars"]): (r["Predicted_IND"], r["Predicted_Sentiment"], r["Rule_Corrected"])
           for r in correct_by_rating(df, "stars").collect()}
    for rating in ratings:
        up, down = rating in (" 4 ", "4"), rating == "2"
        assert got[(0, rating)] == ((1, "Positive", True) if up else (0, "Negative", False))
        assert got[(1, rating)] == ((0, "Negative", True) if down else (1, "Positive", False))
    assert correct_by_rating(df, None) is df
    assert correct_by_rating(df.drop("Predicted_IND"), "stars").columns == df.drop("Predicted_IND").columns


def test_prediction_columns(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.87654), (3, 0.1)], "id int, p double")
    assert rows(with_prediction(df, "p").orderBy("id")) == [
        (1, 0, "Negative", 0.5, "50.0%"), (2, 1, "Positive", 0.8765, "87.7%"), (3, 0, "Negative", 0.9, "90.0%")]


def test_small_class_stays_in_the_training_part(spark):
    for ids in ((0, 1), (5, 6), (17, 29)):
        df = spark.createDataFrame([(i, "good nice" if i not in ids else "bad broke", "5" if i not in ids else "1")
                                    for i in range(32)], "id int, t string, stars string")
        model, _, card = sentiment.train_dataset(df, "id", "t", "stars", "general")
        assert model.n_train + card.first()["n_test"] == 32


def rated(n=90):
    return [(i, f"good nice {'abc'[i % 3]}{i % 7}x fine" if i % 2 else f"bad broke {'abc'[i % 3]}{i % 5}x fine",
             "5" if i % 2 or i % 11 == 0 else "1", "ab"[i // 40] if i < 80 else None) for i in range(n)]


def test_every_dataset_with_ratings_is_trained(spark):
    df = spark.createDataFrame(rated(104), "id int, t string, stars string, ds string")
    df = df.unionByName(spark.createDataFrame([(900 + i, "good", "5", "c") for i in range(30)], df.schema))
    choice = {r["ds"]: r["model"] for r in sentiment.trainable_datasets(df, "id", "t", "stars", "ds").collect()}
    assert choice == {"a": "dataset", "b": "dataset", None: "dataset", "c": "base"}
    own = sentiment.train_datasets(df, "id", "t", "stars", "ds")
    assert set(own.names) == {"a", "b", None}
    cards = {r["dataset"]: r for r in own.cards.collect()}
    for name in own.names:
        part = df.where(F.col("ds").eqNullSafe(F.lit(name)))
        single, report, card = sentiment.train_dataset(part, "id", "t", "stars", "general", max_iter=2000, tol=1e-14)
        model = own.model(name)
        assert model.n_train == single.n_train
        got = {r["term"]: (r["df"], r["idf"], r["coefficient"]) for r in model.terms.collect()}
        want = {r["term"]: (r["df"], r["idf"], r["coefficient"]) for r in single.terms.collect()}
        assert got.keys() == want.keys()
        assert all(got[t][:2] == want[t][:2] and abs(got[t][2] - want[t][2]) < 2e-6 for t in want)
        assert abs(model.intercept - single.intercept) < 2e-6
        want = card.first()
        assert (cards[name]["accuracy"], cards[name]["n_train"], cards[name]["n_test"]) == (
            want["accuracy"], want["n_train"], want["n_test"])
    base = sentiment.train(df.select("id", "t", (F.col("stars") == "5").cast("int").alias("label")), "id", "t")
    scored = sentiment.score_datasets(df, "id", "t", "ds", own, base).collect()
    assert len(scored) == 134 and {r["model"] for r in scored if r["id"] >= 900} == {"base"}


def test_waves_and_joined_terms_give_the_same_models(spark):
    df = spark.createDataFrame(rated(), "id int, t string, stars string, ds string").where("ds is not null")
    whole = sentiment.train_datasets(df, "id", "t", "stars", "ds")
    waves = sentiment.train_datasets(df, "id", "t", "stars", "ds", max_terms=3)
    table = lambda m: {(r["no"], r["term"]): r["coefficient"] for r in m.terms.collect()}
    one, two = table(whole), table(waves)
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-5 for k in one)
    training = materialise(df.selectExpr("cast(ds = 'b' as int) no", "cast(stars = '5' as int) label", "t"), "t")
    terms = sentiment._dataset_terms(training, "t", training.groupBy("no").agg(F.count("*").alias("n_train")))
    key = lambda r: (r["no"], r["label"], r["indices"], [round(v, 9) for v in r["values"]])
    near, far = (sorted(map(key, sentiment._dataset_vectors(training, "t", terms, **bounds).collect()))
                 for bounds in ({}, {"max_rows": 3}))
    assert near == far


def test_rare_class_survives_the_row_bound(spark):
    df = spark.createDataFrame(
        [(i, "bad broke" if i < 4 else f"good nice {i % 9}", "1" if i < 4 else "5", "x") for i in range(3000)],
        "id int, t string, stars string, ds string")
    own = sentiment.train_datasets(df, "id", "t", "stars", "ds", max_rows=400)
    assert own.names == ["x"]
    n = own.models.first()["n_train"] + own.cards.first()["n_test"]
    assert 300 < n < 500
    assert own.model("x").terms.where("term = 'bad broke'").count() == 1


def test_a_dataset_model_sees_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(sentiment, "_fit_draw", None)  # nothing is drawn
    n = 2_000
    df = spark.range(n).select("id", F.when(F.col("id") < 3, "rare find").otherwise("good nice").alias("t"),
                               F.when(F.col("id") % 50 == 0, "1").otherwise("5").alias("stars"), F.lit("x").alias("ds"))
    own = sentiment.train_datasets(df, "id", "t", "stars", "ds", max_iter=1)
    assert own.models.first()["n_train"] + own.cards.first()["n_test"] == n
    assert own.model("x").terms.where("term = 'rare find'").count() == 1


def test_keyed_fit_reaches_the_minimum(spark):
    random = np.random.default_rng(3)
    data, want, offset = [], [], [0]
    for no, (n, width) in enumerate([(40, 6), (25, 3), (60, 1)]):
        x = random.standard_normal((n, width)) * (random.random((n, width)) < 0.6)
        y = (x.sum(axis=1) + random.standard_normal(n) > 0.3).astype(int)
        want.append(newton(x, y))
        data += [(no + 5, int(l), [int(i) + offset[-1] for i in np.flatnonzero(v)], v[v != 0].tolist()) for v, l in zip(x, y)]
        offset.append(offset[-1] + width)
    labels = [[d[1] for d in data if d[0] == no + 5] for no in range(3)]
    weight = np.array([[len(l) / (2 * (len(l) - sum(l))), len(l) / (2 * sum(l))] for l in labels])
    wave = many_models.Wave(5, np.array(offset), weight, np.array([len(l) for l in labels]))
    vectors = spark.createDataFrame(data, "no int, label int, indices array<int>, values array<double>").repartition(3)
    w, b = many_models.fit_wave(vectors, wave)
    for no in range(3):
        assert w[offset[no]:offset[no + 1]] == pytest.approx(want[no][:-1], abs=1e-6)
        assert b[no] == pytest.approx(want[no][-1], abs=1e-6)


def test_fit_ends_where_scales_differ(spark, monkeypatch):
    """Rare and frequent features, and more rows than a loss has digits for: the fit reaches
    its minimum in a bounded number of passes."""
    random = np.random.default_rng(8)
    n, width = 20_000, 60
    share = np.geomspace(0.9, 1e-3, width)
    x = (random.random((n, width)) < share) * np.geomspace(0.1, 6, width)
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    y = (x @ random.standard_normal(width) * 3 + random.standard_normal(n) > 0.5).astype(int)
    data = [(0, int(l), np.flatnonzero(v).tolist(), v[v != 0].tolist()) for v, l in zip(x, y)]
    vectors = spark.createDataFrame(data, "no int, label int, indices array<int>, values array<double>").repartition(2)
    passes, plain = [], many_models._sums

    def counted(*args):
        passes.append(1)
        assert len(passes) < 120
        return plain(*args)

    monkeypatch.setattr(many_models, "_sums", counted)
    weight = np.array([[n / (2 * (y == 0).sum()), n / (2 * (y == 1).sum())]])
    w, b = many_models.fit_wave(vectors, many_models.Wave(0, np.array([0, width]), weight, np.array([n])))
    assert [*w, b[0]] == pytest.approx(newton(x, y).tolist(), abs=1e-4)


def test_fit_moves_numbers_per_row_in_few_passes(spark, monkeypatch):
    """Wide vectors: a pass sends one number per row, not one per term, and rows are few."""
    random = np.random.default_rng(5)
    n, width, sent = 400, 5_000, []
    x = (random.random((n, width)) < np.geomspace(0.5, 2e-3, width)) * random.random((n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = (x[:, :40].sum(axis=1) + 0.05 * random.standard_normal(n) > np.median(x[:, :40].sum(axis=1))).astype(int)
    vectors = spark.createDataFrame([(0, int(l), np.flatnonzero(v).tolist(), v[v != 0].tolist()) for v, l in zip(x, y)],
                                    "no int, label int, indices array<int>, values array<double>").repartition(2)
    plain = many_models._sums
    monkeypatch.setattr(many_models, "_sums", lambda *args: sent.append(len(args[-1])) or plain(*args))
    weight = np.array([[n / (2 * (y == 0).sum()), n / (2 * (y == 1).sum())]])
    w, b = many_models.fit_wave(vectors, many_models.Wave(0, np.array([0, width]), weight, np.array([n])))
    assert set(sent) == {n} and len(sent) < 40
    p = 1 / (1 + np.exp(-(x @ w + b[0])))
    miss = weight[0][y] * (p - y)
    assert np.linalg.norm(x.T @ miss + w) < 1e-5 and abs(miss.sum()) < 1e-6


def test_terms_of_a_part_agree_with_counter(spark):
    import pyarrow as pa
    lists = [["a", "b", "a", "b"], [], ["c"], ["b", "a", "c", "c", "c"]]
    row, term, count, names = row_terms.own_terms(pa.array(lists, pa.list_(pa.string())))
    names = names.to_pylist()
    want = {(i, t): n for i, l in enumerate(lists) for t, n in Counter(l + [f"{x} {y}" for x, y in zip(l, l[1:])]).items()}
    assert {(r, names[t]): c for r, t, c in zip(row.tolist(), term.tolist(), count.tolist())} == want
    some = row_terms.own_terms(pa.array(lists, pa.list_(pa.string())), pa.array(["a", "c"]))[3].to_pylist()
    assert sorted(some) == ["a", "a c", "b", "c", "c c"]


@pytest.mark.parametrize("most", [100, 1])
def test_most_frequent_terms_are_exact_without_all_pairs(spark, monkeypatch, most):
    """Pairs of words that are rarer than the last term are not counted."""
    random = np.random.default_rng(4)
    texts = [(i, " ".join(f"w{min(int(z), 300):03d}" for z in random.zipf(1.4, 40))) for i in range(300)] + [(300, None)]
    df, asked, plain = spark.createDataFrame(texts, "id int, t string"), [], tfidf.term_sums
    monkeypatch.setattr(tfidf, "term_sums", lambda *args: asked.append(args[3:]) or plain(*args))
    monkeypatch.setattr(tfidf, "MOST_FREQUENT", most)
    got = [(r["term"], r["df"], r["total"]) for r in tfidf.top_terms(df, "t", 301, max_features=20).collect()]
    counts = [Counter(python_terms(t or "")) for _, t in texts]
    df_of = Counter(t for c in counts for t in c)
    total = sum(counts, Counter())
    want = sorted((t for t in total if 2 <= df_of[t] <= 0.95 * 301), key=lambda t: (-total[t], t))[:20]
    assert sorted(got) == sorted((t, df_of[t], total[t]) for t in want)
    assert len(asked) == 2 and (asked[1] == (None,) if most == 1 else len(asked[1][0]) < 30)


def test_blocks_ask_for_a_term_once(spark, labelled):
    """Beyond the bound a block of texts is one row per term of the join, and every text,
    null ids and unknown terms too, keeps its own result."""
    terms, _ = fit_terms(labelled, "id", "t")
    docs = labelled.unionByName(spark.createDataFrame([(None, "zzz", 0), (None, None, 1), (7, "good fit", 1)], labelled.schema))
    model = sentiment.SentimentModel(terms.withColumn("coefficient", F.length("term") / 10), 0.1, ())
    near, far = (sorted((r["id"] or -1, r["t"] or "", round(r["probability"], 9)) for r in sentiment.with_score(
        docs, "t", model, **bounds).collect()) for bounds in ({}, {"max_rows": 3}))
    assert near == far and len(far) == 63
    plan = plan_of(sentiment.with_score(docs, "t", model, max_rows=3))
    assert "Generate" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_coefficients_stay_a_table(spark):
    """Places without an entry are zero, and places count from a given one."""
    data = [(0, i % 2, [i % 3, 4], [1.0, 0.5 + i % 2]) for i in range(12)]
    vectors = spark.createDataFrame(data, "no int, label int, indices array<int>, values array<double>").repartition(2)
    wave = many_models.Wave(0, np.array([0, 7]), np.array([[1.0, 1.0]]), np.array([12]))
    w, b = many_models.fit_wave(vectors, wave)
    table, again = many_models.fit_table(vectors, wave, 100)
    assert table.columns == ["idx", "coefficient"] and again == pytest.approx(b)
    assert dict(rows(table)) == pytest.approx({100 + i: x for i, x in enumerate(w)}) and not w[[3, 5, 6]].any()


def test_models_beyond_the_bound_look_up_terms_in_blocks(spark, labelled):
    one = sentiment.train(labelled, "id", "t")
    own = sentiment.DatasetModels(
        materialise(one.terms.withColumn("no", F.lit(0)), "t"),
        spark.createDataFrame([(0, "a", one.intercept, 60)], "no int, dataset string, intercept double, n_train long"), None, None)
    df = labelled.withColumn("ds", F.when(F.col("id") % 2 == 0, "a"))
    plan = plan_of(sentiment.score_datasets(df, "id", "t", "ds", own, one, max_rows=5))
    assert "Generate" not in plan and "FlatMapCoGroupsInArrow" in plan
