"""Fill-in-the-middle against regular expressions, and its way back."""

import re
from hashlib import sha256

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from argloom.llm import fim
from conftest_llm import ROWS, rows_of

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
TEXTS = st.lists(st.sampled_from(["a", "Zz", " ", "\n", "é", "😀", "漢", "<", "S", ">", "<P>", "1", "x" * 9]), max_size=40).map("".join)


def plain_way(key, text):
    """The contract read literally."""
    units = UNIT.findall(text)
    digest = sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(p) for p in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 10**6), st.sampled_from([1, 2, 3, 5, 64]))
def test_arranges_as_the_contract_reads(text, key, block):
    fim.BLOCK, kept = block, fim.BLOCK
    try:
        assert fim.arrange(text, 1, str(key), 90, 20) == plain_way(key, text)
    finally:
        fim.BLOCK = kept


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 7))
def test_every_unit_is_found(text, block):
    cut, at = fim.CutText(text, block), 0
    for number, unit in enumerate(UNIT.findall(text)):
        assert cut.place(number) == at
        at += len(unit)
    assert cut.place(cut.n) == len(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 4)), max_size=40))
def test_tree_equals_running_sums(blocks):
    import numpy as np

    tree = fim.FenwickTree(np.array([u for u, _ in blocks], np.int64), np.array([c for _, c in blocks], np.int64))
    homes = [(b, i) for b, (u, _) in enumerate(blocks) for i in range(u)]
    for unit, (block, inside) in enumerate(homes):
        assert tree.find(unit) == (block, inside, sum(c for _, c in blocks[:block]))
    assert tree.find(len(homes))[0] == len(blocks)


def test_awkward_rows(awkward):
    got = fim.fill_in_middle(awkward)
    got = sorted((tuple(r) for r in got.collect()), key=str)
    want = sorted(((i, *plain_way("" if i is None else i, t or "")) for i, t, _, _ in ROWS), key=str)
    assert got == want


def test_restores_every_text_and_draws_all_forms(documents):
    wide = documents.select("doc_id", F.concat(F.col("text"), F.lit("<S"), F.col("text")).alias("text"))
    both = documents.select("doc_id", "text").unionByName(wide.withColumn("doc_id", F.col("doc_id") + 1000))
    found = fim.fill_in_middle(both)
    back = found.select("doc_id", "form", fim.restored(F.col("output"), F.col("form")).alias("back"))
    assert back.join(both, "doc_id").where(~F.col("back").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    shares = {r["form"]: r["count"] for r in back.groupBy("form").count().collect()}
    assert set(shares) == {"plain", "psm", "spm"} and shares["psm"] > shares["spm"]


def test_marks_in_a_text_leave_it_plain_and_halves_of_marks_do_not(spark):
    texts = ["a <P> b", "<S>", "x<M>", "<S<M< P> >", "<<P", "S><M"] * 9
    rows = rows_of(fim.fill_in_middle(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    for key, text in enumerate(texts):
        r = rows[key]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_way(key, text)
        if key % 6 < 3:
            assert r["form"] == "plain"


def test_a_very_long_text(spark):
    text = ("word after word, and " + "y" * 5000 + " 漢字 ") * 400
    row = fim.digest(fim.fill_in_middle(spark.createDataFrame([(3, text)], "doc_id bigint, text string"))).first()
    n, form, prefix, middle, output = plain_way(3, text)
    assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"]) == (n, form, prefix, middle)
    assert row["output_sha256"] == sha256(output.encode()).hexdigest()
    assert row["restored_sha256"] == sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("share", [0, 100])
def test_shares_are_parameters(spark, share):
    df = spark.createDataFrame([(i, "some words here") for i in range(20)], "doc_id bigint, text string")
    forms = {r["form"] for r in fim.fill_in_middle(df, plain_from=100, spm_below=share).collect()}
    assert forms == {"spm" if share else "psm"}


def test_empty_table(nothing):
    assert fim.digest(fim.fill_in_middle(nothing)).collect() == []
