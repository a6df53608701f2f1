"""Conversation repair against a search through all edits."""

import re
from hashlib import sha256
from itertools import product
from zlib import crc32

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from argloom.llm import repair as R

SOUND = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANKS = "\t\n\x0b\x0c\r "


def faults(turns):
    out, seen = [], set()
    for role, text in turns:
        bare = text.strip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(turns):
    """All edits of up to a few turns: at most three insertions before each turn and at the end."""
    options = []
    for (role, text), fault in zip(turns, faults(turns)):
        own = [(2, "D", None)]
        if fault in ("", "truncated"):
            extra = 5 * (fault == "truncated")
            own += [(extra, "K", (role, text)), (extra + 1, "R", ("user", text)), (extra + 1, "R", ("assistant", text))]
        options.append(own)
    inserted = [(5 * n, "I" * n, n) for n in range(4)]
    best = None
    for edits in product(*options):
        for gaps in product(inserted, repeat=len(turns) + 1):
            cost = sum(e[0] for e in edits) + sum(g[0] for g in gaps)
            audit = gaps[0][1] + "".join(e[1] + g[1] for e, g in zip(edits, gaps[1:]))
            if best and (cost, audit) >= best[:2]:
                continue
            for fill in product(*[("user", "assistant") for _ in range(sum(g[2] for g in gaps))]):
                fill = iter(fill)
                lines = [(next(fill), "") for _ in range(gaps[0][2])]
                for e, g in zip(edits, gaps[1:]):
                    lines += ([e[2]] if e[2] else []) + [(next(fill), "") for _ in range(g[2])]
                if SOUND.fullmatch("".join(role[:1] or "-" for role, _ in lines)):
                    best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
                    break
    return best


def run(turns, chunk=R.CHUNK):
    talk, seen = R.Conversation(), set()
    R.CHUNK, kept = chunk, R.CHUNK
    try:
        for k, (role, text) in enumerate(turns):
            talk.add(k, role, text, (role, text) in seen)
            seen.add((role, text))
        return talk.result()
    finally:
        R.CHUNK = kept


TURN = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["Hi.", "Hi", " ", "Go!\n", "so, "]))


@settings(max_examples=80, deadline=None)
@given(st.lists(TURN, max_size=3), st.sampled_from([1, 2, 512]))
def test_equals_a_search_through_all_edits(turns, chunk):
    cost, audit, text = cheapest(turns)
    assert run(turns, chunk)[5:] == (cost, audit, sha256(text.encode()).hexdigest())


@settings(max_examples=60, deadline=None)
@given(st.lists(TURN, max_size=30))
def test_chunks_make_no_difference(turns):
    assert run(turns, 1) == run(turns, 4) == run(turns, 512)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([i + f for i in "sua-" for f in " t-"]), min_size=1, max_size=9))
def test_one_split_a_span_is_as_good_as_all(kinds):
    """The table with every span and every split gives the same cells."""
    n = len(kinds)
    table = {(i, i + 1): R.turn_cell(kinds[i]) for i in range(n)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell = {}
            for split in range(i + 1, i + length):
                for at, found in R.combine(table[i, split], table[split, i + length]).items():
                    R._least(cell, at, found)
            table[i, i + length] = cell
    assert table[0, n] == R.span_cell(tuple(kinds))


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        draw = crc32(name.encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def expected(rows):
    want = {}
    kept = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[2:] for r in own]
        marks = faults(turns)
        numbers = [r[1] for r in own if r[1] is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
        want[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *[marks.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs),
            *run(turns)[5:],
        )
    return want


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_whole_small_table(spark):
    talks = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    found = got(R.repair_damaged(talks))
    assert found == expected([tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()])
    assert any(v[6] for v in found.values())


def test_awkward_rows(spark):
    rows = [
        (1, None, "system", "First."), (1, 0, "user", "Ask?"), (1, 1, None, None), (1, 1, "assistant", "Yes."), (1, 9, "user", ""),
        (2, None, None, None), (2, None, "user", "Twice."), (2, None, "user", "Twice."), (2, 4, "user", "Twice."), (2, -3, "user", "Twice."),
        (None, 1, "user", "No id."), (None, 2, "assistant", "None at all."), (None, None, "tool", "a" * 100_000),
        (3, 2**62, "user", "Far."), (3, -(2**61), "assistant", "Away."),
        *[(4, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(3000)],
        *[(5, k, "user", "Again.") for k in range(2000)],
        *[(c, 0, "user", "Alone.") for c in range(100, 140)],  # some of them lose their only turn
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("_content", "_rank", "_there", "_first", "audit", "cost"):
        df = df.withColumn(name, F.lit("clash"))
    found = got(R.repair_damaged(df.repartition(5)))
    assert found == expected(rows)
    lost = [c for c in range(100, 140) if not damaged([(c, 0, "user", "Alone.")])]
    assert lost and all(found[c] == (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest()) for c in lost)


def test_repairs_are_sound_and_nothing_is_done_to_sound_ones(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hello!"), (2, 0, "assistant", "Well."), (2, 1, "user", "Cut off")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["conv_id"]: r for r in R.repair(df, df).collect()}
    assert (found[1]["audit"], found[1]["cost"]) == ("KKK", 0)
    assert found[1]["repaired_sha256"] == sha256(b"system:Be kind.\nuser:Hello?\nassistant:Hello!").hexdigest()
    assert (found[2]["audit"], found[2]["cost"]) == ("DD", 4)


def test_empty_table(spark):
    assert R.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
