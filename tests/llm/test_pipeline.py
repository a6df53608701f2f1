"""The pipeline, stage by stage, against what each stage's operator is to do."""

import base64
import re

import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from argloom.session import materialize
from test_jaccard import brute
from test_quality import brute_counts
from test_spans import base_pii
from test_tokens import check_packing

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    """Documents before the first stage and after each."""
    tables = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], FOLDER), name))
    return tables


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_all_but_the_last_stage_return_documents(staged):
    for table in staged[1:-1]:
        assert table.dtypes == staged[0].dtypes


def test_quality_stage(staged):
    before, after = texts_of(staged[0]), texts_of(staged[1])
    assert after == {k: before[k] for k in after}
    for key in set(before) - set(after):
        counts = brute_counts(before[key])
        failed = counts["n_words"] < 10 or 100 * counts["n_repeat_words"] > 20 * counts["n_words"]
        assert failed or counts["n_symbols"] > 0.05 * counts["n_words"] or len(before) - len(after) < 0.2 * len(before)
    for key in after:
        counts = brute_counts(after[key])
        assert counts["n_words"] >= 10 and 100 * counts["n_repeat_words"] <= 20 * counts["n_words"]


def test_language_stage(staged):
    before, after = texts_of(staged[1]), texts_of(staged[2])
    assert after == {k: t for k, t in before.items() if re.search(r"[^\W\d_]", t)}
    assert {r["lang"] for r in staged[2].select("lang").distinct().collect()} <= {"en", "de", "fr", "es"}


def test_one_document_of_each_group_stays(staged):
    before, after = texts_of(staged[2]), texts_of(staged[3])
    assert set(after) == {root for _, root in brute(before).values()}
    assert after == {k: before[k] for k in after}


def test_personal_data_is_gone(staged):
    before, after = texts_of(staged[3]), texts_of(staged[4])
    assert set(after) == set(before)
    for key, text in after.items():
        assert not base_pii(text)
        if not base_pii(before[key]):
            assert text == before[key] or re.search(r"<[A-Z_]+>", text)
    assert all(r["n_chars"] == len(r["text"]) for r in staged[4].collect())


def test_packing_stage(staged):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    codec = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids_of = {k: codec.encode_ordinary(t) + [2] for k, t in texts_of(staged[4]).items()}
    used = check_packing(staged[5].collect(), ids_of, 1024)
    assert used <= -(-sum(map(len, ids_of.values())) // 1024) + 3


def test_pipeline_of_an_empty_table(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), "empty")
        assert docs.count() == 0


def test_registered(spark):
    names = entry.queries()
    assert names["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 14))
