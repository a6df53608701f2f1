"""Labels, sampling, metrics."""

import random

import pytest

from argloom.operators import evaluate as E, sampling as S, text as X, training as M
from argloom.plans.train import train_detector


def test_missing_annotation_counts_as_argument(spark):
    df = spark.createDataFrame([("NoArgument",), ("Argument_for",), (None,)], "annotation STRING")
    assert [r.label for r in M.binary_label(df).collect()] == [0, 1, 1]


def test_filters(spark):
    df = spark.createDataFrame([("train", 0.9), ("val", 0.85), ("test", 0.5)], "`set` STRING, confidence DOUBLE")
    assert M.select_split(df, "val").count() == 1
    assert M.select_confident(df).count() == 2
    assert M.prune_columns(df, ["set"]).columns == ["set"]


def rows_of(spark, n, hot=0):
    data = [(i, f"r{i}") for i in range(n)] + [(-1, f"hot{i % 7}") for i in range(hot)]
    return spark.createDataFrame(data, "id INT, v STRING").repartition(6)


@pytest.mark.parametrize("n", [0, 1, 37, 500, 999, 5000])
def test_sample_has_the_exact_size_and_smallest_ranks(spark, n):
    df = rows_of(spark, 1000)
    got = sorted(r.id for r in S.sample_exactly(df, n, ["id"], 42).collect())
    ranked = df.select("id", S.seeded_rank(["id"], 42).alias("r")).orderBy("r").collect()
    assert got == sorted(r.id for r in ranked[:n])


def test_sample_with_a_third_of_rows_on_one_key(spark):
    df = rows_of(spark, 600, hot=300)
    for n in (1, 250, 450, 600, 899):
        rows = S.sample_exactly(df, n, ["id"], 42).collect()
        assert len(rows) == n
        ids = [r.id for r in rows if r.id >= 0]
        assert len(ids) == len(set(ids))


def test_balance_both_ways(spark):
    for minority in (0, 1):
        data = [(i, minority if i < 23 else 1 - minority) for i in range(200)]
        df = spark.createDataFrame(data, "id INT, label INT")
        out = S.balance_classes(df, "id")
        assert {r.label: r.n for r in S.class_counts(out).collect()} == {0: 23, 1: 23}
        assert out.join(df, ["id", "label"], "left_semi").count() == 46
        again = S.balance_classes(df.repartition(7), "id")
        assert sorted(out.collect()) == sorted(again.collect())


def test_null_labels_are_a_class_of_their_own(spark):
    data = [(i, None if i < 2 else i % 2) for i in range(12)]
    out = S.balance_classes(spark.createDataFrame(data, "id INT, label INT"), "id")
    assert {r.label: r.n for r in S.class_counts(out).collect()} == {None: 2, 0: 2, 1: 2}


def ranked(df, n, label, seed=42):
    """The rows that a sort within each class would keep, as a multiset of (label, rank)."""
    by_class = {}
    for r in df.select(label, S.seeded_rank(["id"], seed).alias("r")).collect():
        by_class.setdefault(r[label], []).append(r.r)
    return sorted((str(c), x) for c, all_ranks in by_class.items() for x in sorted(all_ranks)[:n])


@pytest.mark.parametrize("classes", [3, 500])
def test_many_classes_take_no_more_passes(spark, classes, monkeypatch):
    rng = random.Random(classes)
    rows = [(i, i % classes) for i in range(4 * classes)] + [(10**6 + i, rng.randrange(classes)) for i in range(6000)]
    df = spark.createDataFrame(rows, "id INT, label INT").repartition(5).cache()
    writes, write = [], S.materialize
    monkeypatch.setattr(S, "materialize", lambda frame, name: writes.append(name) or write(frame, name))
    out = S.balance_classes(df, "id").cache()
    smallest = min(r.n for r in S.class_counts(df).collect())
    assert {r.n for r in S.class_counts(out).collect()} == {smallest}
    assert sorted((str(r.label), r.r) for r in out.select("label", S.seeded_rank(["id"], 42).alias("r")).collect()) == ranked(df, smallest, "label")
    assert len(writes) <= 9


def test_copies_in_many_classes(spark):
    rows = [(1, c) for c in range(4) for _ in range(30 + c)] + [(2 + i, c) for c in range(4) for i in range(c)] + [(5, None)] * 40
    df = spark.createDataFrame(rows, "id INT, label INT").repartition(3)
    out = S.balance_classes(df, "id")
    assert {r.label: r.n for r in S.class_counts(out).collect()} == dict.fromkeys([0, 1, 2, 3, None], 30)
    assert sorted((str(r.label), r.r) for r in out.select("label", S.seeded_rank(["id"], 42).alias("r")).collect()) == ranked(df, 30, "label")
    assert S.balance_classes(df.limit(0), "id").count() == 0


def test_shuffle_keeps_rows(spark):
    df = rows_of(spark, 300, hot=150)
    out = S.shuffle_rows(df, "id").collect()
    assert sorted(out) == sorted(df.collect())
    assert [r.id for r in out if r.id >= 0] != sorted(r.id for r in out if r.id >= 0)


def brute_metrics(pairs, classes=None):
    labels = sorted({x for p in pairs for x in p})
    n = len(pairs)
    out = {}
    for c in labels:
        tp = sum(a == b == c for a, b in pairs)
        pred = sum(b == c for _, b in pairs)
        sup = sum(a == c for a, _ in pairs)
        p, r = tp / pred if pred else 0.0, tp / sup if sup else 0.0
        out[c] = (sup, p, r, 2 * p * r / (p + r) if p + r else 0.0)
    weighted = [sum(v[0] * v[i] for v in out.values()) / n for i in (1, 2, 3)]
    chosen = classes or labels
    macro = [sum(out.get(c, (0, 0, 0, 0))[i] for c in chosen) / len(chosen) for i in (1, 2, 3)]
    return sum(a == b for a, b in pairs) / n, weighted, macro


@pytest.mark.parametrize("seed", range(4))
def test_metrics(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.choice([0, 1, 2, 2]), rng.choice([0, 1, 2] if seed else [0, 0, 1])) for _ in range(200)]
    df = spark.createDataFrame(pairs, "label INT, prediction INT")
    accuracy, weighted, macro = brute_metrics(pairs)
    r = E.evaluate(df).first()
    assert r.accuracy == pytest.approx(accuracy)
    assert [r.precision, r.recall, r.f1] == pytest.approx(weighted)
    m = E.evaluate(df, average="macro").first()
    assert [m.precision, m.recall, m.f1] == pytest.approx(macro)
    micro = E.evaluate(df, average="micro").first()
    assert micro.f1 == pytest.approx(accuracy) == pytest.approx(r.recall)
    subset = E.evaluate(df, average="macro", classes=[1, 2]).first()
    assert subset.f1 == pytest.approx(brute_metrics(pairs, [1, 2])[2][2])


def test_metrics_by_split_and_long_form(spark):
    rows = [("val", 1, 1), ("val", 0, 1), ("test", 1, 1), ("train", 0, 0)]
    df = spark.createDataFrame(rows, "`set` STRING, label INT, prediction INT")
    wide = E.evaluate_splits(df)
    assert {r["set"]: r.accuracy for r in wide.collect()} == {"val": 0.5, "test": 1.0}
    assert E.metrics_table(wide).count() == 8


def test_best_model(spark):
    df = spark.createDataFrame([(0, 0.5, 0.9), (1, 0.7, 0.3), (2, 0.7, 0.3)], "trial INT, f1 DOUBLE, loss DOUBLE")
    assert E.best_model(df, "f1", "max").first().trial == 1
    assert E.best_model(df, "loss", "min").first().trial == 1


@pytest.mark.parametrize("kind", ["linear", "ml"])
def test_train_detector(spark, kind):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        arg = i % 4 != 0
        cue = ["because", "therefore", "so"] if arg else ["table", "chair", "lamp"]
        text = " ".join(rng.choice(cue + ["the", "of", "and"]) for _ in range(9))
        rows.append((i, text, "Argument_for" if arg else "NoArgument", ["train", "train", "val", "test"][(i // 4) % 4]))
    df = spark.createDataFrame(rows, "id INT, sentence STRING, annotation STRING, `set` STRING")
    trained = train_detector(df, "id", balance=True, kind=kind)
    metrics = {(r["set"], r.metric): r.value for r in trained.metrics.collect()}
    assert set(s for s, _ in metrics) == {"val", "test"}
    assert metrics[("test", "accuracy")] > 0.8


def test_stack_tables_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "a INT, b STRING")
    b = spark.createDataFrame([("y", 2)], "b STRING, a INT")
    c = spark.createDataFrame([(3,)], "a INT")
    assert sorted((r.a, r.b or "") for r in M.stack_tables([a, b, c]).collect()) == [(1, "x"), (2, "y"), (3, "")]


def test_words_are_counted_once_for_all_settings(spark, monkeypatch):
    """Two settings share the vocabulary and its weights; every trained model is that of a pipeline by itself."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer

    rows = [("good good old tree", 1), ("a good day", 1), ("bad old day", 0), ("bad bad bad", 0), ("", 1), (None, 0)] * 3
    train = spark.createDataFrame(rows, "sentence STRING, label INT")
    calls = []
    real = M.CountVectorizer.fit
    monkeypatch.setattr(M.CountVectorizer, "fit", lambda self, df: calls.append(1) or real(self, df))
    model, trials = M.train_classifier(train, train.limit(9), reg_params=(0.01, 0.1))
    assert len(calls) == 1 and trials.count() == 2
    stages = [CountVectorizer(inputCol="tokens", outputCol="tf"), IDF(inputCol="tf", outputCol="features"), LogisticRegression(labelCol="label", regParam=0.01, maxIter=20)]
    words = X.tokenize(train, "sentence")
    want = Pipeline(stages=stages).fit(words).transform(words).select("sentence", "probability").collect()
    alone = M.train_classifier(train, reg_params=(0.01,))[0].transform(words).select("sentence", "probability").collect()
    assert sorted((r[0] or "", round(r[1][1], 6)) for r in want) == sorted((r[0] or "", round(r[1][1], 6)) for r in alone)
    assert set(model.stages[0].vocabulary) == {"good", "old", "tree", "a", "day", "bad"}
    assert len(model.stages) == 3 and model.stages[-1].summary.totalIterations >= 1
