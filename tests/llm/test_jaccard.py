"""The Jaccard join against comparing every pair."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from argloom.llm import jaccard as J
from argloom.llm.components import components
from argloom.llm.words import buffers
from conftest_llm import ROWS, WORDS, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    found = WORD.findall((text or "").translate(LOWER))
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else ({tuple(found)} if found else set())


def brute(texts):
    """Size and smallest reachable id of every document, from all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 3 * max(len(a), len(b)) <= 4 * min(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(df, texts):
    got = {k: (r["n_shingles"], r["component_id"]) for k, r in rows_of(J.near_duplicates(df)).items()}
    assert got == brute(texts)


def test_smallest_table(documents, texts):
    check(documents, texts)


def variants(seed, n, base_words=60, edits=6):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 5000, base_words)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.integers(0, base_words, rng.integers(0, edits)):
            own[at] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(own))
    return out


def test_groups_at_the_limit_of_similarity(spark, monkeypatch):
    """Chains of near copies around 0.75, a passage that all share, and cells cut into chunks."""
    monkeypatch.setattr(J, "CELL_CHUNK", 8)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = dict(enumerate(variants(1, 40) + variants(2, 30, 40, 3) + [f"{v} {passage}" for v in variants(3, 30, 90, 14)]))
    chain = [f"c{k}" for k in range(50)]
    for k in range(12):  # each links to the next, the ends are far apart
        texts[len(texts)] = " ".join(chain)
        chain = chain[2:] + [f"d{k}", f"e{k}"]
    check(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5), texts)


def test_awkward_rows(awkward, nothing):
    plain = {i: t for i, t, _, _ in ROWS if i not in (None, 12)}
    got = J.near_duplicates(awkward)
    rows = got.collect()
    assert len(rows) == len(ROWS)
    want = brute(plain)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] in plain} == want
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert [r["component_id"] for r in rows if r["doc_id"] == 12] == [12, 12]
    assert J.near_duplicates(nothing).count() == 0


def test_repeated_id_joins_its_components(spark):
    a, b = " ".join(WORDS), " ".join(reversed(WORDS))
    df = spark.createDataFrame([(5, a), (5, b), (7, a), (9, b)], "doc_id int, text string")
    assert {(r["doc_id"], r["component_id"]) for r in J.near_duplicates(df).collect()} == {(5, 5), (7, 5), (9, 5)}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 80))
def test_bound_never_loses_a_pair(seed, n):
    texts = variants(seed, n, base_words=int(20 + seed % 50), edits=8) + ["one two", "one two three four five"]
    sets = [s for t in texts for s in J.doc_sets(*buffers(pa.array([t])))]
    totals = np.array([len(s) for s in sets])
    survived = set()
    for i, hits in J.surviving([J.count_vector(s) for s in sets], totals):
        assert len(set(hits.tolist())) == len(hits)
        survived |= {frozenset((i, int(j))) for j in hits}
    for i in range(len(sets)):
        for j in range(i):
            if J.linked(sets[i], sets[j]):
                assert frozenset((i, j)) in survived


def test_rarest_shingles_of_linked_sets_meet():
    counters = np.random.default_rng(0).integers(0, 50, 1 << 18)
    sets = [s for t in variants(4, 40) for s in J.doc_sets(*buffers(pa.array([t])))]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            if J.linked(a, b):
                first, second = (s[J.rarest(s, counters[(s >> np.uint64(46)).astype(np.int64)])] for s in (a, b))
                assert set(first.tolist()) & set(second.tolist())


@pytest.mark.parametrize("ranges", [1, 5])
def test_shared_shingles_are_counted_over_all_sets(spark, documents, ranges):
    from collections import Counter

    table = J.shared_shingles(documents.repartition(3), ranges)
    sets = {}
    for r in documents.select("text").collect():
        for own in J.doc_sets(*buffers(pa.array([r["text"]], pa.string()))):
            sets[own.tobytes()] = own
    want = Counter(int(k) for own in sets.values() for k in J._short(own))
    keys = np.array(sorted(want), dtype=np.int64)
    found = table.find(keys)
    # Equal sets of different tasks count apart, so counts may be higher, never lower.
    assert all(n >= want[k] for k, n in zip(keys.tolist(), found.tolist()) if want[k] > 1)
    assert any(want[k] > 1 for k in want) and not table.find(keys ^ 1)[~np.isin(keys ^ 1, keys)].any()
    assert J.shared_shingles(documents.limit(0), ranges).files == ()


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    groups = [set(range(41)), set(range(100, 130)), {200, 201, 202}]
    assert set(got) == set().union(*groups)
    for group in groups:
        assert len({got[k] for k in group}) == 1
    assert len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_counting_shingles_holds_a_few_arrays_only():
    """A worker stays small: packing what it holds takes at most five times the room of the hashes themselves."""
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64)) for _ in range(500)]
    held, size = list(sets), 8 * 500_000
    tracemalloc.start()
    batch = J._counted(held, J.SHARED_BITS - 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not held and peak < 5 * size
    assert batch.column(0).to_pylist() == list(range(8))
    assert sum(len(c.as_buffer()) for c in batch.column(2)) == 4 * 500_000


def test_counts_of_shingles_over_many_parts(spark, monkeypatch):
    """Parts of a range that come in many rows are merged, and no task holds two ranges."""
    monkeypatch.setattr(J, "HELD", 256)
    texts = sorted(set(variants(7, 60, 80, 5)))  # copies may count once a task
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    wanted = {}
    for own in J._sets(pa.array(texts)):
        for key in J._short(own).tolist():
            wanted[key] = wanted.get(key, 0) + 1
    table = J.shared_shingles(df, 11)
    keys = np.array(sorted(wanted), dtype=np.int64)
    counts = np.array([wanted[k] for k in keys.tolist()])
    assert np.array_equal(table.find(keys), np.where(counts > 1, counts, 0))
    assert len({f.first >> (J.SHARED_BITS - 4) for f in table.files}) == len(table.files)
