"""Language identification, licences, the n-gram trie and top-k search."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from argloom.llm import langid, licenses, lmtrie, topk
from conftest_llm import ROWS, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


# ---- language identification


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = rows_of(langid.language_id(docs))
    true = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert set(got) == set(true)
    for key, row in got.items():
        assert row["held_out"] == (zlib.crc32(str(key).encode()) % 3 == 1)
        assert 0 <= row["score"] <= 1
    unseen = [k for k in true if got[k]["held_out"]]
    assert np.mean([got[k]["lang_pred"] == true[k] for k in unseen]) > 0.98


def test_families_and_close_languages(spark):
    texts = {
        "en": "the house and the garden with the old tree and three children there that think",
        "de": "das haus und der garten mit dem alten baum und drei kinder die dort nicht denken",
        "es": "la casa y el jardín con el árbol viejo y tres niños que piensan allí mañana",
        "pt": "a casa e o jardim com a árvore velha e três crianças que não pensam amanhã",
        "xx": "zvrk prkt mlzk trpk vlkr brzk krtp zmlk prvk tkrz mrzl kptr",
    }
    rows = [(f"{' '.join(np.random.default_rng(k).permutation(t.split()))}", lang) for lang, t in texts.items() for k in range(12)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.families == ["germanic", "romance", "xx"]
    assert sorted(model.pairs) == [("germanic", "de", "en"), ("romance", "es", "pt")]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts.values())], "doc_id int, text string")
    got = rows_of(langid.predict(df, model))
    assert [got[k]["lang_pred"] for k in range(len(texts))] == list(texts)


def test_one_language_and_none(spark):
    one = langid.fit(spark.createDataFrame([("some text here", "en")], "text string, lang string"))
    none = langid.fit(spark.createDataFrame([(None, "en"), ("text", None)], "text string, lang string"))
    df = spark.createDataFrame([(1, "more text"), (2, "12 !"), (3, None)], "doc_id int, text string")
    assert [rows_of(langid.predict(df, one))[k]["lang_pred"] for k in (1, 2, 3)] == ["en", "und", "und"]
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}


def test_training_holds_its_sample_once():
    """Beside the sample only a part of it is there as doubles, and the machine is that of the whole sample."""
    rng = np.random.default_rng(1)
    x = rng.random((120, langid.BUCKETS), dtype=np.float32) / 100
    y = np.where(np.arange(120) % 3 == 0, 1.0, -1.0).astype(np.float32)
    tracemalloc.start()
    got = langid._train_svm(x, y, steps=20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes
    wide = x.astype(np.float64)
    assert np.allclose(got[:-1] @ wide.T + got[-1], (wide @ wide.T + 1) @ _factors(wide, y, 20), rtol=1e-9)


def _factors(x, y, steps, ridge=1e-4):
    products = x @ x.T + 1
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    factors, speed = np.zeros(len(y)), np.zeros(len(y))
    step = 1 / (2 * (weight * np.diag(products)).sum() + ridge)
    for _ in range(steps):
        speed = 0.9 * speed - step * (ridge * factors - 2 * weight * y * np.maximum(0, 1 - y * (products @ factors)))
        factors = factors + speed
    return factors


def test_sample_comes_as_bytes(spark):
    """Six bytes for each bucket of a text, which sort as the numbers do."""
    row = langid._shares(spark.createDataFrame([("en", "ab ab")], "lang string, text string")).first()
    buckets, shares = np.frombuffer(row["buckets"], ">u2"), np.frombuffer(row["shares"], ">f4")
    assert len(buckets) == len(shares) and list(buckets) == sorted(set(buckets))
    assert abs(shares.sum() - 1) < 1e-6


def test_language_of_awkward_rows(awkward, nothing):
    rows = langid.language_id(awkward).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        texts = [t for i, t, _, _ in ROWS if i == r["doc_id"]]
        if not re.search(r"[^\W\d_]", texts[0] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.language_id(nothing).count() == 0


def test_prediction_does_not_depend_on_the_batch(spark, documents):
    model = langid.fit(documents)
    a = rows_of(langid.predict(documents.repartition(7), model))
    b = rows_of(langid.predict(documents.coalesce(1), model))
    assert a == b


# ---- licences


def brute_terms(text):
    found = [w for w in re.split(r"[^\w.]+|_|\.(?!\w)", text.lower()) if w]
    return found + [f"{a} {b}" for a, b in zip(found, found[1:])]


def brute_best(passage):
    n = len(licenses.TEMPLATES)
    df = Counter(t for _, notice in licenses.TEMPLATES for t in set(brute_terms(notice)))
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}
    unit = lambda v: {t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()}
    damped = lambda c: 1 + math.log(c)
    own = unit({t: damped(c) * idf.get(t, math.log(1 + n) + 1) for t, c in Counter(brute_terms(passage)).items()})
    scored = []
    for name, notice in licenses.TEMPLATES:
        template = unit({t: damped(c) * idf[t] for t, c in Counter(brute_terms(notice)).items()})
        scored.append((round(sum(x * template.get(t, 0) for t, x in own.items()), 6), name))
    return max(scored)


def test_best_template_equals_brute_force(spark):
    passages = [notice for _, notice in licenses.TEMPLATES]
    passages += ["This file is licensed under the Apache license 2.0, see below.", "license", "all rights reserved by us, 2020", "MIT licence or not"]
    df = spark.createDataFrame(list(enumerate(passages)), "row bigint, passage string")
    got = {r["row"]: (r["cosine"], r["license"]) for r in licenses.best_templates(df, licenses.TEMPLATES, 0.0).collect()}
    for k, passage in enumerate(passages):
        cosine, name = brute_best(passage)
        if cosine > 0:
            assert got[k] == (pytest.approx(cosine, abs=2e-6), name)


def test_statements_files_and_inheritance(spark):
    gpl, mit = "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License."
    rows = [
        (1, "LICENSE", gpl), (2, "a.txt", "no word about it"), (3, "x/y/z/b.txt", "nothing"), (4, "x/y/LICENSE", mit),
        (5, "x/y/c.txt", f"text\n{mit}\nmore"), (6, "x/w/d.txt", None), (7, "x/yy/e.txt", ""), (8, None, "top"),
        (9, "x/y/f.txt", "blah " * 5000 + gpl + " blah" * 5000), (9, "x/y/f.txt", "a license of some kind, unknown to all"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, path string, text string").withColumn("folder", F.lit("clash"))
    out = licenses.scan(df, F.col("path"), F.col("path").rlike("(^|/)LICENSE$"), least=0.3)
    got = sorted((r["doc_id"], r["license"], r["origin"], r["directory"]) for r in out.collect())
    assert got[:8] == [
        (1, "GPL-3.0", "file", None), (2, "GPL-3.0", "inherited", ""), (3, "MIT", "inherited", "x/y"), (4, "MIT", "file", None),
        (5, "MIT", "header", None), (6, "GPL-3.0", "inherited", ""), (7, "GPL-3.0", "inherited", ""), (8, "GPL-3.0", "inherited", ""),
    ]
    assert {g[1:3] for g in got[8:]} == {("GPL-3.0", "header"), ("MIT", "inherited")}


PROSE = (
    "when morning came all seven boats left their harbour and nobody on shore could say how long this calm weather would hold because old "
    "sailors had seen grey clouds gather behind that hill where in summer children fly kites until evening bells call them home for soup"
).split()


@pytest.mark.parametrize("around", [0, 3, 12, 120])
def test_every_template_is_found_amid_prose(spark, around):
    many = PROSE * 5
    rows = []
    for k, (name, notice) in enumerate(licenses.TEMPLATES):
        before, after = " ".join(many[k : k + around]), " ".join(many[k + 7 : k + 7 + around])
        rows += [(k, f"{before} {notice} {after}"), (100 + k, f"{before}\n# " + notice.replace(" ", "\n# ", 4) + f"\n{after}")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = rows_of(licenses.scan(df, F.lit("a/b"), F.lit(False)))
    for k, (name, _) in enumerate(licenses.TEMPLATES):
        assert got[k]["license"] == got[100 + k]["license"] == name, licenses.TEMPLATES[k]


def test_prose_about_licences_is_no_notice(spark):
    texts = [
        "she lost her driving license on the way to the station last week", "the pub has a licence to sell beer until midnight",
        "songs of that time have long been in the public domain in most countries", "license", "the council may revoke any license it has granted to a trader",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r["origin"] for r in licenses.scan(df, F.lit("a/b"), F.lit(False)).collect()} == {"none"}


def test_spdx_tags_are_taken_as_they_stand(spark):
    tag = "SPDX-License-Identifier:"
    want = {
        f"// {tag} MIT": "MIT", f"/* {tag} GPL-3.0-or-later */ int x;": "GPL-3.0", f"{tag} LGPL-3.0-only": "LGPL-3.0", f"x\n# {tag} apache-2.0.\ny": "Apache-2.0",
        f"{tag} (MIT OR Apache-2.0)": "(MIT OR Apache-2.0)", f"{tag} Zlib and more prose": "Zlib", f"{tag} GPL-2.0+\n{tag} MIT\n{tag} MIT": "GPL-2.0 AND MIT",
        f"{tag} GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0 WITH Classpath-exception-2.0", f"{tag} BSD-2-Clause\nnot Licensed under the BSD 3-Clause License": "BSD-2-Clause",
        f"{tag} NOASSERTION": None, "speak of SPDX": None,
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id int, text string")
    got = rows_of(licenses.scan(df, F.lit("a/b"), F.lit(False)))
    assert [got[k]["license"] for k in range(len(want))] == list(want.values())


def test_licences_of_awkward_rows(awkward, nothing):
    never = F.lit(None).cast("boolean")
    assert {r["origin"] for r in licenses.scan(awkward, F.col("source"), never).collect()} == {"none"}
    assert licenses.scan(awkward, F.col("source"), never).count() == len(ROWS)
    assert licenses.scan(nothing, F.col("source"), never).count() == 0


# ---- the n-gram trie


class BruteTrie:
    """Witten-Bell interpolation with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts, self.types = order, {}, {}
        for k in range(1, order + 1):
            self.counts[k] = Counter()
        for words in texts:
            padded = ["</s>"] + words
            for i in range(1, len(padded)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        self.counts[k][tuple(padded[i - k + 1 : i + 1])] += 1
        for k in range(2, order + 1):
            self.types[k] = Counter(g[:-1] for g in self.counts[k])
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])

    def p(self, gram):
        if len(gram) == 1:
            c = self.counts[1].get(gram, 0)
            return (c or self.v) / (self.n + self.v) if self.n else 1.0
        types = self.types[len(gram)].get(gram[:-1], 0)
        if not types:
            return self.p(gram[1:])
        total = self.counts[len(gram) - 1][gram[:-1]]
        return (self.counts[len(gram)][gram] + types * self.p(gram[1:])) / (total + types)

    def score(self, words):
        padded = ["</s>"] + words
        return sum(math.log10(self.p(tuple(padded[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(padded)))


def tokens(text):
    return WORD.findall((text or "").translate(LOWER)) + ["</s>"]


@pytest.mark.parametrize("order, shard", [(1, 1 << 22), (2, 3000), (3, 2000)])
def test_trie_equals_brute_force(documents, texts, monkeypatch, order, shard):
    monkeypatch.setattr(lmtrie, "SHARD", shard)
    got = rows_of(lmtrie.language_model_scores(documents, order=order))
    training = [tokens(t) for k, t in texts.items() if zlib.crc32(str(k).encode()) % 10]
    brute = BruteTrie(training, order)
    seen, n, v = brute.counts[1], brute.n, brute.v
    for key, text in texts.items():
        own, row = tokens(text), got[key]
        assert row["held_out"] == (zlib.crc32(str(key).encode()) % 10 == 0)
        assert (row["n_tokens"], row["train_tokens"]) == (len(own), n)
        assert row["n_known"] == sum((w,) in seen for w in own)
        base = sum(math.log10((seen.get((w,), 0) + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        # One byte a probability, in steps well below 12 / 255: at most half of that away, for every token.
        assert row["score"] == pytest.approx(brute.score(own), abs=0.0236 * len(own) + 1e-6)


def test_no_probability_is_cut_off():
    vocabulary = lmtrie.Level([], np.zeros(0, np.uint64), np.array([0, 10**12]), 1 << 64, 10**15)
    floor = lmtrie.Trie([vocabulary]).floor
    assert floor < -15
    exact = np.array([floor, -14.2, -12.5, -3.0, 0.0])
    assert lmtrie.restore(lmtrie.quantise(exact, floor), floor) == pytest.approx(exact, abs=-floor / 510 + 1e-9)


def test_the_rarest_ngrams_reach_the_floor_and_no_further(spark):
    texts = ["a b a c a b", "b a b c", "a a b", "once"]
    trie = lmtrie.build(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    brute = BruteTrie([tokens(t) for t in texts], 3)
    least = min(brute.p(gram) for k in (1, 2, 3) for gram in brute.counts[k])
    assert trie.floor <= math.log10(least)
    assert trie.floor == pytest.approx(math.log10(brute.p(("once",))))


def test_trie_of_awkward_rows(spark, awkward, nothing):
    for order in (1, 3):
        rows = lmtrie.language_model_scores(awkward, order=order).collect()
        assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in rows) == sorted((i or -1, len(tokens(t))) for i, t, _, _ in ROWS)
        assert all(r["score"] <= 0 for r in rows)
    assert lmtrie.language_model_scores(nothing).count() == 0
    untrained = lmtrie.score(awkward, lmtrie.build(nothing)).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and {r["base_score"] for r in untrained} == {0.0}


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c a b", "b a b c", "a a b"]
    trie = lmtrie.build(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    brute = BruteTrie([tokens(t) for t in texts], 3)
    for context in (("a",), ("</s>", "a"), ("a", "b")):
        total = sum(brute.p((*context, w)) for w in ("a", "b", "c", "</s>", "never"))
        assert total == pytest.approx(1)
    assert [level.n for level in trie.levels] == [len(brute.counts[k]) for k in (1, 2, 3)]


# ---- top-k search


def brute_top(vectors, queries, k):
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vectors}
    out = []
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale, rows, groups", [(1.0, 16, 40), (3e4, 256, 1 << 14)])
def test_top_k_equals_brute_force(spark, monkeypatch, scale, rows, groups):
    monkeypatch.setattr(topk, "GROUP_ROWS", groups)
    monkeypatch.setattr(topk, "CHUNK_QUERIES", 3)
    rng = np.random.default_rng(5)
    vectors = [(int(i), [float(x) for x in rng.normal(size=8) * scale]) for i in range(300)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(30)]  # ties
    bad = [(2000, None), (2001, [1.0, None] * 4), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, vectors[1][1])]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("score", F.lit(1))
    got = topk.top_k(df, lambda key: key % 50 == 0, k=7)
    assert sorted(map(tuple, got.collect())) == brute_top(vectors, [i for i, _ in vectors if i % 50 == 0], 7)


def test_blocks_are_left_out_but_nothing_is_lost():
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (20, 16))
    blocks = [(np.arange(50) + 50 * b, centres[b] + rng.integers(-20, 20, (50, 16))) for b in range(20)]
    queries = np.stack([m[0] for _, m in blocks])
    rows, scored = topk.search_blocks(queries, np.array([ids[0] for ids, _ in blocks]), blocks, 5)
    vectors = {int(i): v for ids, m in blocks for i, v in zip(ids, m)}
    assert scored < 0.5 * 20 * 1000
    for b, q in enumerate(queries):
        best = sorted((-int(v @ q), i) for i, v in vectors.items() if i != 50 * b)[:5]
        assert sorted((-s, i) for key, i, s in rows if key == 50 * b) == best


def test_few_ragged_repeated_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (0, [3.0, 0.0]), (2, [])], schema)
    got = sorted(map(tuple, topk.top_k(df, lambda key: key == 0).collect()))
    assert got == [(0, 1, 1, 1 << 20), (0, 2, 2, 0)]
    assert topk.top_k(spark.createDataFrame([], schema), lambda key: key == 0).count() == 0
