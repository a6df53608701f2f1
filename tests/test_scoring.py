"""Probabilities, linear models, batches, ML models."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from argloom.functions import linear as N, probability as P, text as T
from argloom.operators import scoring as C, text as X, training as M


def test_probabilities(spark):
    rows = [([1.0, 2.0, 3.0],), ([0.0, 0.0, -5.0],), ([1000.0, 999.0, -1000.0],)]
    df = spark.createDataFrame(rows, "z array<double>").withColumn("p", P.softmax(F.col("z")))
    out = df.withColumn("c", P.argmax(F.col("z"))).withColumn("pc", P.prob_of(F.col("p"), F.col("c")))
    out = out.withColumn("l", P.label_of(F.col("c"), ["a", "b", "c"])).collect()
    for (z,), r in zip(rows, out):
        e = np.exp(np.array(z) - max(z))
        assert np.allclose(r.p, e / e.sum())
        assert math.isclose(sum(r.p), 1.0)
        assert r.c == int(np.argmax(z)) and math.isclose(r.pc, max(r.p))
    assert [r.l for r in out] == ["c", "a", "a"]


@pytest.fixture(scope="module")
def sentences(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for doc in range(40):
        for sent in range(rng.randint(1, 12)):
            rows.append((doc, sent, " ".join(rng.choice(words) for _ in range(rng.randint(0, 15)))))
    # a hot word on a third of all tokens
    rows += [(99, i, "hot " * 20) for i in range(100)]
    return spark.createDataFrame(rows, "doc_id INT, sent_idx INT, text STRING").repartition(6).cache()


@pytest.fixture(scope="module")
def weights(spark):
    rng = random.Random(5)
    rows = [(f"w{i}", rng.randint(-900, 900), rng.randint(1, 50), 1) for i in range(0, 400, 2)]
    rows.append(("hot", 7, 100000, 1))
    return spark.createDataFrame(rows, "token STRING, weight BIGINT, n_pos BIGINT, n_neg BIGINT").cache()


def brute_scores(sentences, weights):
    table = {r.token: r.weight for r in weights.collect()}
    return {
        (r.doc_id, r.sent_idx): sum(table.get(w, 0) for w in r.text.split())
        for r in sentences.collect()
    }


@pytest.mark.parametrize("limit", [C.MAX_BROADCAST, 1000])
def test_margins_in_the_row(spark, sentences, weights, limit):
    model = C.LinearModel(weights, bias=5, max_broadcast=limit)
    assert (model.n_shards > 1) == (limit == 1000)
    got = C.add_margin(sentences, T.tokens(F.col("text")), model, "m")
    want = brute_scores(sentences, weights)
    assert {(r.doc_id, r.sent_idx): r.m - 5 for r in got.collect()} == want


@pytest.mark.parametrize("limit", [C.MAX_BROADCAST, 1000])
def test_nested_margins(spark, weights, limit):
    docs = [(0, ["w2 w4", "", "w2 hot"]), (1, []), (2, ["unknown words"]), (3, ["w10"] * 700)]
    df = spark.createDataFrame(docs, "id INT, s array<string>").repartition(3)
    words = F.transform("s", lambda s: T.tokens(s))
    model = C.LinearModel(weights, max_broadcast=limit)
    got = {r.id: r.m for r in C.add_nested_margins(df, words, model, "m").collect()}
    table = {r.token: r.weight for r in weights.collect()}
    for n, texts in docs:
        assert got[n] == [sum(table.get(w, 0) for w in t.split()) for t in texts]


@pytest.mark.parametrize("frequent", [1, 50, 10_000])
def test_join_scorer(spark, sentences, weights, frequent):
    words = X.tokenize(sentences, "text")
    got = C.score_linear(words, ["doc_id", "sent_idx"], weights, frequent=frequent, salts=4)
    table = {r.token for r in weights.collect()}
    rows = got.collect()
    assert {(r.doc_id, r.sent_idx): r.score for r in rows} == brute_scores(sentences, weights)
    known = {(r.doc_id, r.sent_idx): sum(w in table for w in r.text.split()) for r in sentences.collect()}
    assert all(known[(r.doc_id, r.sent_idx)] == r.n_known for r in rows)


def test_long_tail_is_never_broadcast(spark, sentences, weights, folder):
    """A small file of weights becomes a large table once it is repeated for every salt."""
    weights.write.parquet(f"{folder}/weights")
    kept = spark.read.parquet(f"{folder}/weights")
    words = X.tokenize(sentences, "text")
    plan = C.score_linear(words, ["doc_id", "sent_idx"], kept, frequent=5)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert "SortMergeJoin" in plan and not any("salt" in line for line in joins)


def test_empty_weight_table(spark, sentences, weights):
    model = C.LinearModel(weights.limit(0))
    got = C.detect_sentences(sentences, model)
    assert got.where("is_arg = 1 OR arg_prob <> 0.5").count() == 0


def test_cascade(spark, sentences, weights):
    model = C.LinearModel(weights)
    scored = C.classify_components(C.detect_sentences(sentences, model), model)
    for r in scored.collect():
        if r.is_arg:
            assert r.component == "claim" and r.component_prob > 0.5  # same weights, same sign
        else:
            assert r.component is None and r.component_prob is None
    assert C.filter_argumentative(scored).count() == scored.where("component IS NOT NULL").count()


def test_scoring_does_not_shuffle(spark, sentences, weights):
    scored = C.detect_sentences(spark.range(50).select(F.lit("w2 w4").alias("text")), C.LinearModel(weights))
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_filtered_scores_are_worked_out_once(spark, sentences, weights):
    model = C.LinearModel(weights)
    found = C.filter_argumentative(C.detect_sentences(sentences, model))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert found.where("arg_prob <= 0.5").count() == 0


def test_filters_below_scoring_reach_the_scan(spark, weights, folder):
    rows = spark.range(100).select(F.col("id"), F.lit("w2 hot").alias("text"), (F.col("id") % 3).cast("string").alias("lang"))
    rows.write.parquet(f"{folder}/t")
    found = C.detect_sentences(spark.read.parquet(f"{folder}/t"), C.LinearModel(weights)).where("lang = '1' AND is_arg = 1")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,1)" in plan.split("PushedFilters:")[1].splitlines()[0]
    assert plan.count("ArrowEvalPython") == 1 and found.count() in (0, 33)


@pytest.mark.parametrize("limit", [C.MAX_BROADCAST, 1000])
def test_both_models_in_one_pass(spark, sentences, weights, limit):
    detector = C.LinearModel(weights, bias=-400, max_broadcast=limit)
    halved = weights.select("token", (-F.col("weight") / 2).cast("bigint").alias("weight"))
    components = C.LinearModel(halved, bias=250, max_broadcast=limit)
    fused = C.classify_sentences(sentences, detector, components)
    assert fused._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    apart = C.classify_components(C.detect_sentences(sentences, detector), components)
    got = sorted(fused.collect())
    assert got == sorted(apart.select(fused.columns).collect())
    assert {r.component for r in got} == {None, "claim", "premise"}


def test_large_tables_are_scored_in_one_scan_without_writing(spark, weights, folder, monkeypatch):
    spark.range(50).select(F.col("id"), F.lit("w2 w4 hot").alias("text")).write.parquet(f"{folder}/t")
    model = C.LinearModel(weights, max_broadcast=1000)
    model.table  # written once, before any scoring

    def refuse(*_):
        raise AssertionError("scoring wrote a table")

    monkeypatch.setattr(C, "materialize", refuse)
    monkeypatch.setattr(type(spark.range(1).write), "parquet", refuse)
    scored = C.add_margin(spark.read.parquet(f"{folder}/t"), T.tokens(F.col("text")), model, "m")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
    table = {r.token: r.weight for r in weights.collect()}
    assert {r.m for r in scored.collect()} == {sum(table.get(w, 0) for w in ("w2", "w4", "hot"))}


def test_the_second_table_is_asked_for_chosen_words_only():
    import pyarrow as pa
    from argloom.functions import linear as L

    class Table:
        def __init__(self, weights):
            self.weights = dict(zip(L.word_hashes(list(weights)).tolist(), weights.values()))
            self.asked = set()

        def find(self, own):
            self.asked |= set(own.tolist())
            return np.array([self.weights.get(h, 0) for h in own.tolist()], dtype=np.int64)

    first, second = Table({"yes": 5, "no": -5}), Table({"yes": 1, "no": 7})
    lists = pa.array([["yes"], ["no", "rare"], [], ["no", "yes", "yes"]], pa.list_(pa.string()))
    a, b = L._margins(lists, (first, 0), (second, 10))
    assert a.to_pylist() == [5, -5, 0, 5] and b.to_pylist() == [11, None, None, 19]
    assert second.asked == set(L.word_hashes(["yes", "no"]).tolist())
    a, b = L._margins(lists.slice(3, 1), (first, 1), (second, 0))
    assert a.to_pylist() == [6] and b.to_pylist() == [9]


def test_attach_predictions(spark):
    left = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "id INT, k INT")
    right = spark.createDataFrame([(1, 1, "claim")], "id INT, k INT, component STRING")
    got = {(r.id, r.k): r.component for r in C.attach_predictions(left, right, ["id", "k"]).collect()}
    assert got == {(1, 0): None, (1, 1): "claim", (2, 0): None}


def test_score_batches_with_any_function(spark):
    def make():
        def predict(x):
            return np.stack([-x, x, np.zeros_like(x)], axis=1)

        return predict

    df = spark.createDataFrame([(-3.0,), (2.0,), (0.0,)], "x DOUBLE")
    rows = C.score_batches(df, ["x"], make, ["neg", "pos", "zero"], batch_size=2).collect()
    assert [r.pred for r in rows] == ["neg", "pos", "neg"]
    for r in rows:
        assert math.isclose(sum(r.probs), 1.0)


def test_log_odds(spark):
    rows = [("good good fair", 1), ("bad fair", 0)]
    df = X.tokenize(spark.createDataFrame(rows, "t STRING, label INT"), "t")
    got = {r.token: r for r in M.train_log_odds(df).collect()}
    assert set(got) == {"good", "fair", "bad"}
    assert math.isclose(got["good"].log_odds, math.log(3 / 6) - math.log(1 / 5))
    assert got["good"].weight == round(1e6 * got["good"].log_odds)
    assert math.isclose(got["bad"].log_odds, math.log(1 / 6) - math.log(2 / 5))


def test_vocabulary_has_no_gaps(spark):
    rng = random.Random(1)
    text = " ".join(f"t{min(int(rng.expovariate(0.01)), 2000)}" for _ in range(5000))
    df = X.tokenize(spark.createDataFrame([(text,)] * 3, "t STRING"), "t")
    rows = sorted(M.fit_vocabulary(df).collect(), key=lambda r: r["index"])
    assert [r["index"] for r in rows] == list(range(len(rows)))
    assert [(-r.n, r.token) for r in rows] == sorted((-r.n, r.token) for r in rows)


def test_classifier_learns_and_persists(spark, folder):
    from argloom.sources.models import load_or_train

    rng = random.Random(2)
    rows = []
    for i in range(300):
        label = i % 2
        cue = ["because", "therefore"] if label else ["table", "chair"]
        rows.append((i, " ".join(rng.choice(cue + ["the", "a", "of"]) for _ in range(8)), label))
    df = spark.createDataFrame(rows, "id INT, sentence STRING, label INT")
    train, held = df.where("id < 200"), df.where("id >= 200")
    model, trials = M.train_classifier(train, held, reg_params=(0.01, 1.0), size=1 << 12)
    assert trials.count() == 2
    scored = C.detect_sentences(held, model, "sentence")
    right = scored.where("label = is_arg").count()
    assert right > 0.8 * held.count()
    calls = []

    def fit():
        calls.append(1)
        return model

    first = load_or_train(f"{folder}/m", fit)
    again = load_or_train(f"{folder}/m", fit)
    assert calls == [1]
    a = C.detect_sentences(held, first, "sentence").select("id", "arg_prob").collect()
    b = C.detect_sentences(held, again, "sentence").select("id", "arg_prob").collect()
    assert a == b
    load_or_train(f"{folder}/m", fit, force=True)
    assert calls == [1, 1]


def test_words_are_looked_up_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(N, "MOST", 50)

    class Table:
        def __init__(self):
            self.asked = []

        def find(self, own):
            self.asked.append(len(own))
            return own % 1000

    rng = random.Random(11)
    lists = [[f"w{rng.randrange(10**6)}" for _ in range(size)] for size in [0, 3, 40, 20, 0, 130, 1, 49, 50, 0]]
    first, second = Table(), Table()
    found = N._pair(pa.array([["left", "out"], *lists], pa.list_(pa.string())).slice(1), (first, 3), (second, -2)).to_pylist()
    for words, r in zip(lists, found, strict=True):
        total = int((N.word_hashes(words) % 1000).sum()) if words else 0
        assert r["first"] == total + 3 and r["second"] == total - 2
    assert sorted(first.asked)[-1] == 130 and sorted(first.asked)[-2] <= 50  # one list of 130 words is one part
    assert N._pair(pa.array([], pa.list_(pa.string())), (first, 0), (second, 0)).to_pylist() == []


def test_large_tables_are_not_copied_to_every_worker(spark):
    table = spark.range(2_000_000).select(F.col("id").cast("string").alias("token"), F.col("id").alias("weight"))
    assert C.LinearModel(table).n_shards > 1


def test_word_hashes_of_arrow_arrays():
    """Hashed where they lie: also in slices, for any width of offsets, without a Python string per word."""
    import time

    from pandas.util import hash_array

    rng = random.Random(5)
    words = ["", "a", "aa", "a\0", "\0", "\0\0", "é" * 9, *["x" * n for n in (7, 8, 9, 16, 17, 256, 257, 100_000)]]
    words += ["".join(rng.choices("abcdefgéß日😀", k=rng.randrange(3, 9))) for _ in range(200_000)]
    words = list(dict.fromkeys(words))
    found = N.word_hashes(words)
    assert found.dtype == np.int64 and len(set(found.tolist())) == len(words)
    for same in (pa.array(words), pa.array(words, pa.large_string()), pa.array(["left", "out", *words]).slice(2), np.array(words, dtype=object)):
        assert (N.word_hashes(same) == found).all()
    assert [int(N.word_hashes([w])[0]) for w in words[:50]] == found[:50].tolist()
    assert len(N.word_hashes([])) == 0 and len(N.word_hashes(pa.array([], pa.string()))) == 0

    def seconds(work):
        times = []
        for _ in range(5):
            begun = time.perf_counter()
            work()
            times.append(time.perf_counter() - begun)
        return min(times)

    arrow = pa.array(words)
    one_by_one = seconds(lambda: hash_array(np.array(arrow.to_numpy(zero_copy_only=False), dtype=object), categorize=False))
    assert seconds(lambda: N.word_hashes(arrow)) < one_by_one
