"""Queries share what is the same in all of them."""

from argloom.catalog import queries as Q
from argloom.functions import text as T
from argloom.operators import text as X


def _tables(spark, folder):
    text = "First <b>one</b>. Then another! Is it so? Yes, it is."
    docs = [(i, None if i == 3 else f"{text} Number {i} of them.") for i in (0, 1, 2, 3, 4, 4, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    marks = [(0, 0, 1), (1, 1, 0), (2, None, None), (4, 1, 1), (4, 0, 0), (None, 1, 1)]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def _sorted(df):
    return sorted(df.collect(), key=repr)


def test_documents_are_split_once(spark, folder, monkeypatch):
    """The same sentences and labelled sentences as before, repeated and null ids included, from one splitting."""
    _tables(spark, folder)
    calls = []
    real = X.nest_sentences
    monkeypatch.setattr(X, "nest_sentences", lambda *a: calls.append(a) or real(*a))
    assert _sorted(Q._split_sentences(spark, folder)) == _sorted(Q._sentences(spark, folder))
    for label in ("quality", "toxic"):
        whole = _sorted(Q._labelled(spark, folder, label))
        seen = []
        monkeypatch.setattr(Q.M, "prepare_splits", lambda df, *a, **k: seen.append(df) or df)
        Q._balanced(spark, folder, label)
        assert _sorted(seen[0]) == whole
    assert len(calls) == 1


def test_pairs_are_not_cut_into_words_again(spark, folder, monkeypatch):
    """Each sentence is cut into words before it is paired, whatever the number of its pairs."""
    _tables(spark, folder)
    args = Q._split_sentences(spark, folder).withColumnRenamed("sent_idx", "arg_idx").selectExpr("*", "arg_idx AS sent_idx")
    monkeypatch.setattr(Q, "_args", lambda *_: args)
    plan = Q.tokenize_pair(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Window", 1)
    assert T.NOT_A_WORD not in above and T.NOT_A_WORD in below


def test_probabilities_are_not_worked_out_where_only_labels_are_asked_for(spark, folder, monkeypatch):
    """Pairs are filtered and rounded before they are mirrored, and both directions come out."""
    _tables(spark, folder)
    args = Q._split_sentences(spark, folder).withColumnRenamed("sent_idx", "arg_idx").selectExpr("*", "arg_idx AS sent_idx")
    monkeypatch.setattr(Q, "_args", lambda *_: args.where("doc_id < 4"))
    found, every = Q.filter_relations(spark, folder), Q.classify_relations(spark, folder)
    assert "EXP(" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {tuple(r) for r in every.select("doc_id", "source", "target", "type").collect()}
    assert rows and rows == {(d, b, a, kind) for d, a, b, kind in rows}
    assert {tuple(r) for r in found.collect()} == {r for r in rows if r[3] not in Q.L.NULL_RELATIONS}
