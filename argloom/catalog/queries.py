"""One query per operator, over the given tables.

Stand-ins, since the tables carry no argument annotation: a document's
``quality`` label is the annotation of all its sentences, ``toxic`` is the
component class, and the split goes by the last digit of the document id.
They exercise the operators; the labels they produce mean nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from argloom.functions import probability as P, text as T
from argloom.functions.arrays import items
from argloom.operators import (
    documents as D,
    evaluate as E,
    pairs as R,
    relations as L,
    rounds as G,
    sampling as S,
    scoring as C,
    text as X,
    training as M,
)
from argloom.plans.mine import mine_sentences
from argloom.plans.preprocess import preprocess_corpus, preprocess_files
from argloom.plans.score import score_corpus
from argloom.plans.train import train_detector
from argloom.schemas import COMPONENT_LABELS, STANCE_LABELS
from argloom.session import materialize, scratch_path, spread
from argloom.sources import corpus as O, manifest as N, models as K, sinks as W
from argloom.sources.labelled import scan_labelled
from argloom.streaming.incremental import incremental_sentences

Query = Callable[[SparkSession, str], DataFrame]
KEY = ["doc_id", "sent_idx"]
WINDOW = 5
_KEPT: dict[tuple, object] = {}


def _once(build):
    """Keep a staged table or fitted model for the rest of the application."""

    @wraps(build)
    def kept(spark: SparkSession, sf: str):
        key = (spark.sparkContext.applicationId, sf, build.__name__)
        if key not in _KEPT:
            _KEPT[key] = build(spark, sf)
        return _KEPT[key]

    return kept


# --- inputs ---------------------------------------------------------------


def _table(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df.select(*cols) if cols else df)


def _documents(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return _table(spark, sf, "documents", *(cols or ("doc_id", "text")))


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    return X.split_sentences(X.clean_text(_documents(spark, sf), "text"), "doc_id", "text")


def _split() -> Column:
    digit = F.col("doc_id") % 10
    return F.when(digit < 8, "train").when(digit == 8, "val").otherwise("test")


def _annotation(label: str) -> Column:
    return F.when(F.col(label) == 0, "NoArgument").when(F.col(label).isNotNull(), "Argument")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


def _labelled(spark: SparkSession, sf: str, label: str = "quality") -> DataFrame:
    """Sentences of labelled documents with ``annotation`` and ``set``."""
    docs = _documents(spark, sf).join(_labels(spark, sf), "doc_id")
    sentences = X.split_sentences(X.clean_text(docs, "text"), ["doc_id", label], "text")
    return sentences.select(
        *KEY, F.col("text").alias("sentence"), _annotation(label).alias("annotation"),
        _split().alias("set"),
    )


@_once
def _split_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its ``sentences`` and the length of its text, split once for all that train or apply models."""
    nested = X.nest_sentences(_table(spark, sf, "documents"), "text")
    return materialize(nested.withColumn("n_text", F.length("text")).drop("text"), "sentences")


def _split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of :func:`_sentences`, from the documents that are split already."""
    return X.flatten_sentences(_split_documents(spark, sf), "doc_id")


@_once
def _labelled_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of labelled documents with all their labels."""
    docs = _split_documents(spark, sf).join(_labels(spark, sf), "doc_id")
    sentences = X.flatten_sentences(docs, ["doc_id", "quality", "toxic"])
    return materialize(sentences.select(*KEY, "quality", "toxic", "text"), "labelled")


def _balanced(spark: SparkSession, sf: str, label: str) -> DataFrame:
    labelled = _labelled_sentences(spark, sf).select(
        *KEY, F.col("text").alias("sentence"), _annotation(label).alias("annotation"), _split().alias("set")
    )
    return materialize(M.prepare_splits(labelled, KEY, balance=True), "splits")


@_once
def _argument_splits(spark: SparkSession, sf: str) -> DataFrame:
    return _balanced(spark, sf, "quality")


def _train(rows: DataFrame) -> DataFrame:
    train = M.select_split(rows, "train").select("sentence", "label")
    return M.train_log_odds(X.tokenize(train, "sentence"))


def _model_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"model-{name}")


@_once
def _detector(spark: SparkSession, sf: str) -> C.LinearModel:
    path = _model_path(spark, "detector")
    return K.load_or_train_linear(spark, path, lambda: _train(_argument_splits(spark, sf)))


@_once
def _components(spark: SparkSession, sf: str) -> C.LinearModel:
    path = _model_path(spark, "components")
    return K.load_or_train_linear(spark, path, lambda: _train(_balanced(spark, sf, "toxic")))


@_once
def _document_weights(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(_log_odds_of_documents(spark, sf), "weights")


def _log_odds_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).join(_labels(spark, sf), "doc_id")
    return M.train_log_odds(X.tokenize(X.clean_text(docs, "text"), "text"), label="quality")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return C.detect_sentences(_split_sentences(spark, sf), _detector(spark, sf))


def _numbered(scored: DataFrame) -> DataFrame:
    """Argumentative sentences, numbered, as a flat table."""
    found = C.filter_argumentative(scored).select(*KEY, "text")
    return R.arg_index(materialize(found, "arguments"), "doc_id")


def _with_components(spark: SparkSession, sf: str) -> DataFrame:
    return C.classify_sentences(_split_sentences(spark, sf), _detector(spark, sf), _components(spark, sf))


def _nested(spark: SparkSession, sf: str, keep_words: bool = False) -> DataFrame:
    docs = _split_documents(spark, sf).select("doc_id", "sentences")
    return D.score_nested(docs, _detector(spark, sf), _components(spark, sf), keep_words=keep_words)


def _mined(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    docs = _split_documents(spark, sf).select("doc_id", *cols, "sentences")
    return mine_sentences(docs, _detector(spark, sf), _components(spark, sf))


def _args(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(_scored(spark, sf))


@_once
def _corpus(spark: SparkSession, sf: str) -> str:
    """Documents as a crawl tree: a directory per language, two spellings of the content column."""
    root = scratch_path(spark, "corpus")
    docs = _documents(spark, sf, "doc_id", "lang", "text")
    for number, content in enumerate(("main_content", "plain_text")):
        part = docs.where(F.col("doc_id") % 2 == number).select(
            F.col("doc_id").alias("id"), F.col("text").alias(content),
            F.col("lang").alias("language"),
        )
        W.write_mirrored(part, root, ["language"], mode="append")
    return root


def _r(col: Column | str, name: str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, 6).alias(name)


def _joined(col: str) -> Column:
    return F.concat_ws(" ", F.col(col).cast("array<string>"))


# --- sources --------------------------------------------------------------


def scan_corpus(spark, sf):
    return O.scan_corpus(spark, _corpus(spark, sf)).select("id", "language")


def scan_glob(spark, sf):
    root = scratch_path(spark, "mixed")
    docs = _documents(spark, sf, "doc_id", "lang")
    docs.where("lang = 'en'").write.mode("append").parquet(root)
    docs.where("lang <> 'en'").write.mode("append").json(root)
    return O.scan_corpus(spark, root, glob="part-*.parquet", flat=True).select("doc_id", "lang")


def scan_partition(spark, sf):
    return O.scan_corpus(spark, _corpus(spark, sf), where="language = 'en'").select("id", "language")


def scan_labelled_query(spark, sf):
    root = scratch_path(spark, "labelled")
    rows = _labelled(spark, sf)
    orders = [["doc_id", "sentence", "annotation", "set"], ["set", "annotation", "doc_id", "sentence"]]
    for number, names in enumerate(orders):
        part = rows.where(F.col("doc_id") % 2 == number).select(names)
        part.write.mode("append").option("sep", "\t").option("header", True).option(
            "quote", ""
        ).option("escape", "").csv(root)
    read = scan_labelled(spark, root, glob="*.csv")
    return read.select(F.col("doc_id").cast("bigint"), "sentence", "annotation", "set")


def resolve_content(spark, sf):
    corpus = O.scan_corpus(spark, _corpus(spark, sf), merge_schema=True)
    return O.resolve_content(corpus).select("id", F.md5("content").alias("digest"))


def pending_inputs(spark, sf):
    docs = _documents(spark, sf, "doc_id", "lang", "text")
    done = preprocess_corpus(docs.where("lang = 'en'"), "doc_id", ["text"])
    return O.pending_inputs(docs.select("doc_id", "lang"), done, "doc_id")


def failed_inputs(spark, sf):
    root = scratch_path(spark, "damaged")
    docs = _documents(spark, sf, "doc_id", "lang", "text")
    W.write_mirrored(docs.where("lang <> 'es'"), root, ["lang"], mode="append")
    docs.where("lang = 'es'").select(F.col("doc_id").cast("string")).write.text(f"{root}/lang=es")
    report = N.inspect(spark, root, O.list_files(spark, root, "part-*"))
    return _by_folder(report.where("status = 'failed'"), root)


def _by_folder(report: DataFrame, root: str) -> DataFrame:
    """A report on files, summed up by directory; one is failed if any of its files is."""
    folder = F.substring_index("relative_path", "/", 1).alias("folder")
    files = O.relative_path(report, root).groupBy(folder)
    failed = F.bool_or(F.col("status") == "failed")
    return files.agg(
        F.sum("expected").alias("expected"), F.sum("read").alias("read"),
        F.when(failed, "failed").otherwise("done").alias("status"),
    )


def relative_path(spark, sf):
    root = _corpus(spark, sf)
    rows = O.relative_path(O.scan_corpus(spark, root, with_file=True), root)
    return rows.select("id", F.substring_index("relative_path", "/", 1).alias("folder"))


# --- sinks ----------------------------------------------------------------


def write_mirrored(spark, sf):
    root = scratch_path(spark, "mirrored")
    docs = _documents(spark, sf, "doc_id", "lang", "text")
    W.write_mirrored(preprocess_corpus(docs, ["doc_id", "lang"], ["text"]), root, ["lang"])
    return O.scan_corpus(spark, root).select(*KEY, "lang", "text")


def _exported(spark, sf):
    docs = _documents(spark, sf, "doc_id", "lang", "text", "n_chars")
    return docs.withColumn("note", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))  # null in half of them


def write_documents(spark, sf):
    root = scratch_path(spark, "documents")
    W.write_documents(_exported(spark, sf), root, "corpus", "doc_id")
    read = spark.read.schema("key STRING, body STRING").json(root)
    return read.select("key", F.md5("body").alias("digest"))


def document_key(spark, sf):
    return W.document_json(_documents(spark, sf), "corpus", "doc_id").select("key")


def index_export(spark, sf):
    root = scratch_path(spark, "index")
    W.index_export(_exported(spark, sf), root, "documents", "doc_id")
    return spark.read.text(root).select(F.md5("value").alias("digest"))


def metrics_table(spark, sf):
    root = scratch_path(spark, "metrics")
    W.write_metrics(E.metrics_table(E.evaluate_splits(_held_out(spark, sf))), root)
    return W.read_metrics(spark, root).select("set", "metric", _r("value", "value"))


def save_model(spark, sf):
    path = _model_path(spark, "kept")
    splits = _argument_splits(spark, sf)
    K.load_or_train_linear(spark, path, lambda: _train(splits))
    kept = K.load_or_train_linear(spark, path, lambda: _train(splits.limit(0)))
    return kept.weights


def run_report(spark, sf):
    root = scratch_path(spark, "reported")
    docs = _documents(spark, sf, "doc_id", "lang", "text")
    W.write_mirrored(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("main_content"), "lang"), f"{root}/in", ["lang"])
    return _by_folder(preprocess_files(spark, f"{root}/in", f"{root}/out", by=["lang"]), f"{root}/in")


# --- projections and filters ----------------------------------------------


def cast_text(spark, sf):
    docs = _documents(spark, sf, "doc_id").join(_labels(spark, sf), "doc_id", "left")
    return X.cast_text(docs, "quality").select("doc_id", "quality")


def drop_empty(spark, sf):
    docs = _documents(spark, sf, "doc_id", "lang", "text")
    empty = docs.withColumn("doc_id", -1 - F.col("doc_id")).withColumn("text", F.lit("<p>\t</p> <br>"))
    docs = docs.unionByName(empty)  # an empty document beside every real one
    return X.drop_empty(X.clean_text(docs, "text"), "text").select("doc_id", "lang")


def binary_label(spark, sf):
    docs = _documents(spark, sf, "doc_id").join(_labels(spark, sf), "doc_id", "left")
    marked = docs.select("doc_id", _annotation("quality").alias("annotation"))
    return M.binary_label(marked).select("doc_id", "label")


def select_split(spark, sf):
    return M.select_split(_labelled(spark, sf), "val").select(*KEY, "set")


def select_confident(spark, sf):
    edges = D.relation_edges(_mined(spark, sf), "doc_id").withColumnRenamed("prob", "confidence")
    return M.select_confident(edges, 0.6).select("doc_id", "source", "target", "type")


def prune_columns(spark, sf):
    rows = X.tokenize(M.binary_label(_labelled(spark, sf)), "sentence")
    kept = M.prune_columns(rows, ["tokens", "n_tokens", "label"])
    return kept.select(_joined("tokens").alias("tokens"), "n_tokens", "label")


def filter_argumentative(spark, sf):
    return C.filter_argumentative(_scored(spark, sf)).select(*KEY, "text")


def filter_linkable(spark, sf):
    return R.filter_linkable(_args(spark, sf), "doc_id").select(*KEY)


def filter_relations(spark, sf):
    found = L.filter_relations(_classified(spark, sf)).select("doc_id", "source", "target", "type")
    return R.mirror_pairs(found)


# --- text -----------------------------------------------------------------


def clean_text(spark, sf):
    return X.clean_text(_documents(spark, sf), "text")


def clean_html(spark, sf):
    return X.clean_html(_table(spark, sf, "pages", "page_id", "html"), "html")


def split_sentences(spark, sf):
    return _sentences(spark, sf)


def split_tight(spark, sf):
    """Pages are full of marks that follow a sentence at once; documents get brackets where blanks were."""
    pages = X.clean_text(_table(spark, sf, "pages", "page_id", "html"), "html")
    docs = _documents(spark, sf).select((-1 - F.col("doc_id")).alias("page_id"), F.col("text").alias("html"))
    docs = X.clean_text(docs, "html").withColumn("html", F.regexp_replace("html", r"([.!?]) ([A-M])", "$1($2"))
    return X.split_sentences(pages.unionByName(docs), "page_id", "html", tight=True)


def split_pages(spark, sf):
    pages = _table(spark, sf, "pages", "page_id", "html")
    return X.split_sentences(X.clean_text(pages, "html"), "page_id", "html")


def split_conversations(spark, sf):
    turns = _table(spark, sf, "conversations", "conv_id", "turn", "text")
    return X.split_sentences(X.clean_text(turns, "text"), ["conv_id", "turn"], "text")


def span_text(spark, sf):
    clean = X.clean_text(_documents(spark, sf), "text")
    spans = clean.select(
        "doc_id", "text", F.posexplode(T.sentence_spans(F.col("text"))).alias("sent_idx", "s")
    )
    flat = spans.select("doc_id", "text", "sent_idx", "s.start_index", "s.end_index")
    return X.span_text(flat, "text").select(*KEY, "span")


def flatten_positions(spark, sf):
    nested = X.nest_sentences(_documents(spark, sf), "text")
    return X.flatten_sentences(nested, "doc_id").select(*KEY, "text")


def tokenize_truncate(spark, sf):
    cut = X.tokenize(_sentences(spark, sf), "text", 128)
    return cut.select(*KEY, _joined("tokens").alias("tokens"), "n_tokens")


def tokenize_pair(spark, sf):
    args = _args(spark, sf).withColumn("words", T.tokens(F.col("text")))
    near = R.windowed_pairs(args, "doc_id", window=1, carry=("words",))
    pairs = X.tokenize_pair(near, "source_words", "target_words", 512)
    return pairs.select(
        "doc_id", "source", "target", "n_source", "n_target",
        F.size("source_words").alias("n_source_uncut"),
        F.size("target_words").alias("n_target_uncut"),
        _joined("source_tokens").alias("source_tokens"),
        _joined("target_tokens").alias("target_tokens"),
    )


# --- scoring --------------------------------------------------------------


def _toy_network():
    weights = np.array([[0.125, 0.0], [0.0, 0.015625], [0.0, 0.0]])
    bias = np.array([-1.0, -1.0, 0.5])

    def predict(n_tokens: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
        return np.stack([n_tokens, n_chars], axis=1).astype(np.float64) @ weights.T + bias

    return predict


def score_batches(spark, sf):
    rows = X.tokenize(_sentences(spark, sf), "text").select(
        *KEY, F.col("n_tokens").cast("double"), F.length("text").cast("double").alias("n_chars")
    )
    scored = C.score_batches(
        rows, ["n_tokens", "n_chars"], _toy_network, ["long", "wide", "plain"], 512
    )
    return scored.select(*KEY, "pred_id", "pred", _r(F.col("probs")[0], "p0"), _r(F.col("probs")[1], "p1"))


def score_linear(spark, sf):
    words = X.tokenize(_sentences(spark, sf), "text")
    return C.score_linear(words, KEY, _document_weights(spark, sf))


def score_linear_rowwise(spark, sf):
    model = C.LinearModel(_document_weights(spark, sf))
    return C.add_margin(
        _sentences(spark, sf), T.tokens(F.col("text")), model, "score"
    ).select(*KEY, "score")


def score_linear_sharded(spark, sf):
    model = C.LinearModel(_document_weights(spark, sf), max_broadcast=1 << 18)
    return C.add_margin(
        _sentences(spark, sf), T.tokens(F.col("text")), model, "score"
    ).select(*KEY, "score")


def _logits(spark, sf):
    words = X.tokenize(_sentences(spark, sf), "text")
    logits = F.array(F.col("n_tokens") / 8, F.length("text") / 64, F.lit(1.0))
    return words.select(*KEY, logits.alias("logits"))


def softmax(spark, sf):
    probs = _logits(spark, sf).withColumn("p", P.softmax(F.col("logits")))
    return probs.select(*KEY, *[_r(F.col("p")[i], f"p{i}") for i in range(3)])


def argmax(spark, sf):
    return _logits(spark, sf).select(*KEY, P.argmax(F.col("logits")).alias("class"))


def label_of(spark, sf):
    label = P.label_of(P.argmax(F.col("logits")), STANCE_LABELS)
    return _logits(spark, sf).select(*KEY, label.alias("label"))


def prob_of(spark, sf):
    probs = _logits(spark, sf).withColumn("p", P.softmax(F.col("logits")))
    return probs.select(*KEY, _r(P.prob_of(F.col("p")), "prob"))


def detect_sentences(spark, sf):
    return _scored(spark, sf).select(*KEY, "is_arg", _r("arg_prob", "arg_prob"))


def classify_components(spark, sf):
    return _with_components(spark, sf).select(
        *KEY, "is_arg", "component", _r("component_prob", "component_prob")
    )


def _classified(spark, sf):
    """Every pair once, source before target."""
    args = L.add_profile(_args(spark, sf))
    pairs = R.windowed_pairs(args, "doc_id", WINDOW, carry=L.PROFILE, ordered=False)
    return L.classify_relations(pairs)


def classify_relations(spark, sf):
    # All that is said of a pair holds both ways: worked out once, then mirrored.
    return R.mirror_pairs(_classified(spark, sf).select(
        "doc_id", "source", "target", "type", _r("prob", "prob"),
        *[_r(F.col("probs")[i], f"p{i}") for i in range(4)],
    ))


# --- pairs and assembly ---------------------------------------------------


def windowed_pairs(spark, sf):
    return R.windowed_pairs(_args(spark, sf), "doc_id", WINDOW).select(
        "doc_id", "source", "target", "source_sent", "target_sent",
        F.md5(F.concat_ws("|", "source_text", "target_text")).alias("digest"),
    )


def document_pairs(spark, sf):
    return D.document_pairs(_nested(spark, sf), ["doc_id"], WINDOW).select(
        "doc_id", "source", "target", "source_sent", "target_sent",
        F.md5(F.concat_ws("|", "source_text", "target_text")).alias("digest"),
    )


def attach_predictions(spark, sf):
    predictions = C.classify_components(
        C.filter_argumentative(_scored(spark, sf)), _components(spark, sf)
    ).select(*KEY, "component")
    return C.attach_predictions(_split_sentences(spark, sf), predictions, KEY).select(*KEY, "component")


def resolve_endpoints(spark, sf):
    return D.relation_edges(_mined(spark, sf), "doc_id").select(
        "doc_id", "source", "target", "source_sent", "target_sent"
    )


def attach_to_documents(spark, sf):
    return _mined(spark, sf, "lang", "n_text").select(
        "doc_id", "lang", "n_text",
        F.size("sentences").alias("n_sentences"), F.size("relations").alias("n_relations"),
    )


def arg_index(spark, sf):
    return _args(spark, sf).select(*KEY, "arg_idx")


def group_by_document(spark, sf):
    positions = D.argumentative_positions(F.col("sentences"))
    grouped = _nested(spark, sf).select("doc_id", positions.alias("positions"))
    return grouped.select("doc_id", _joined("positions").alias("positions"))


def assemble_sentences(spark, sf):
    flat = X.flatten_sentences(_nested(spark, sf), "doc_id")
    return flat.select(
        *KEY, "text", "start_index", "end_index",
        F.col("is_arg.pred").alias("is_arg"), _r("is_arg.prob", "arg_prob"),
        F.col("arg_component.pred").alias("component"),
        _r("arg_component.prob", "component_prob"),
    )


def assemble_relations(spark, sf):
    listed = items(_mined(spark, sf), ["doc_id"], "relations", "r", "place")
    return listed.select("doc_id", "place", "r.source", "r.target", "r.type")


def relation_edges(spark, sf):
    return D.relation_edges(_mined(spark, sf), "doc_id").select(
        "doc_id", "source", "target", "type", _r("prob", "prob"),
        *[_r(F.col("probs")[i], f"p{i}") for i in range(4)],
    )


# --- sampling, training, evaluation ---------------------------------------


def class_counts(spark, sf):
    return S.class_counts(M.binary_label(_labelled(spark, sf)))


def _balanced_documents(spark, sf, label):
    docs = _labels(spark, sf)
    return S.balance_classes(docs, "doc_id", label, seed=42).select("doc_id", label)


def balance_classes(spark, sf):
    return _balanced_documents(spark, sf, "toxic")


def balance_classes_reverse(spark, sf):
    return _balanced_documents(spark, sf, "quality")


def shuffle_rows(spark, sf):
    return S.shuffle_rows(_labels(spark, sf), "doc_id")


def stack_files(spark, sf):
    tables = [
        _table(spark, sf, "documents", "doc_id", "lang"),
        _table(spark, sf, "pages", "page_id", "url"),
        _table(spark, sf, "conversations", "conv_id", "turn", "role"),
    ]
    return M.stack_tables(tables)


def _held_out(spark, sf):
    rows = _argument_splits(spark, sf).where("`set` <> 'train'")
    scored = C.detect_sentences(rows, _detector(spark, sf), "sentence")
    return scored.withColumnRenamed("is_arg", "prediction")


def best_model(spark, sf):
    rows = _argument_splits(spark, sf).where("`set` = 'val'")
    margins = C.add_margin(rows, T.tokens(F.col("sentence")), _detector(spark, sf), "margin")
    biases = [-4_000_000, -2_000_000, 0, 2_000_000, 4_000_000]
    tried = margins.select(
        "label", "margin",
        F.posexplode(F.array(*[F.lit(b) for b in biases])).alias("trial", "bias"),
    ).withColumn("prediction", (F.col("margin") + F.col("bias") > 0).cast("int"))
    trials = E.evaluate(tried, by=["trial"])
    return E.best_model(trials, "f1", "max").select("trial", _r("f1", "f1"), _r("accuracy", "accuracy"))


def best_model_loss(spark, sf):
    """The same trials by the smallest and by the largest log loss; equal ones go to the lowest number."""
    rows = _argument_splits(spark, sf).where("`set` = 'val'")
    margins = C.add_margin(rows, T.tokens(F.col("sentence")), _detector(spark, sf), "margin")
    biases = [-4_000_000, -2_000_000, 0, 2_000_000, 4_000_000, 0]
    tried = margins.select(
        "label", "margin",
        F.posexplode(F.array(*[F.lit(b) for b in biases])).alias("trial", "bias"),
    ).withColumn("margin", F.col("margin") + F.col("bias"))
    trials = materialize(E.log_loss(tried, by=["trial"]), "trials")
    chosen = [E.best_model(trials, "loss_sum", mode).withColumn("mode", F.lit(mode)) for mode in ("min", "max")]
    return M.stack_tables(chosen).select("mode", "trial", "rows", "loss_sum", _r("loss", "loss"))


ROUNDS = {"rounds": 4, "patience": 2, "rate": 100}


def train_rounds(spark, sf):
    rows = _argument_splits(spark, sf).select("sentence", "label", F.col("set").alias("part"))
    return G.train_rounds(rows, 2, **ROUNDS).history


@_once
def _labelled_arguments(spark, sf):
    """Numbered arguments of labelled documents with the labels and their words, as such and as hashes.

    Sentences of documents without a label make no pair that has one.
    """
    marks = _labels(spark, sf).groupBy("doc_id", "quality", "toxic").agg(F.count("*").cast("int").alias("copies"))
    docs = _split_documents(spark, sf).join(_labels(spark, sf), "doc_id", "left_semi")
    args = _numbered(C.detect_sentences(X.flatten_sentences(docs, "doc_id"), _detector(spark, sf)))
    words = G.hash_words(L.add_tokens(args.join(marks, "doc_id")))
    return materialize(words.withColumnRenamed("tokens", "named").withColumnRenamed("hashes", "tokens").drop("text"), "learns")


def _labelled_pairs(spark, sf):
    """Neighbouring arguments of labelled documents; what the labels of the document make of the pair is made up.

    Labels stand with the sentences before these are paired, as part of what they are grouped by, so that pairs,
    which repeat their words, are not moved to meet them.
    """
    near = R.windowed_pairs(_labelled_arguments(spark, sf), ["doc_id", "quality", "toxic", "copies"], window=2, carry=L.LEARNS, ordered=False)
    near = near.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    label = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).otherwise(0)
    carried = [f"{side}_{name}" for side in R.SIDES for name in L.LEARNS]
    return near.select("source", "target", *carried, label.alias("label"), _split().alias("part"))


@_once
def _fitted_relations(spark, sf):
    names = G.word_names(_labelled_arguments(spark, sf), "named")
    return L.train_relations(_labelled_pairs(spark, sf), STANCE_LABELS, **ROUNDS, names=names)


def train_relations(spark, sf):
    return _fitted_relations(spark, sf)[1].history


def relate_fitted(spark, sf):
    """The fitted model, kept and read again, over whole documents."""
    path = _model_path(spark, "relations")
    K.save_relations(_fitted_relations(spark, sf)[0], path)
    related = D.relate_nested(_nested(spark, sf, keep_words=True), K.load_relations(spark, path), WINDOW)
    # A relation says the same both ways: rounded once, then mirrored. The chosen class is the most probable one.
    edges = D.relation_edges(related, "doc_id").where("source < target").select(
        "doc_id", "source", "target", "type", *[P.rounded(F.col("probs")[i]).alias(f"p{i}") for i in range(3)]
    )
    both = R.mirror_pairs(edges)
    return both.select("doc_id", "source", "target", "type", F.greatest("p0", "p1", "p2").alias("prob"), "p0", "p1", "p2")


def fit_vocabulary(spark, sf):
    train = M.select_split(_labelled(spark, sf), "train")
    return M.fit_vocabulary(X.tokenize(train, "sentence"))


def train_log_odds(spark, sf):
    return _log_odds_of_documents(spark, sf).select(
        "token", "n_pos", "n_neg", "weight", _r("log_odds", "log_odds")
    )


def prepare_splits(spark, sf):
    labelled = materialize(_labelled(spark, sf), "labelled")
    return M.prepare_splits(labelled, KEY, balance=True).select(*KEY, "label", "set")


def _metrics(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, *[_r(m, m) for m in ("accuracy", "precision", "recall", "f1")])


def evaluate_binary(spark, sf):
    return _metrics(E.evaluate(_held_out(spark, sf)))


def evaluate_f1(spark, sf):
    return _metrics(E.evaluate(_held_out(spark, sf), average="micro"))


def evaluate_f1_subset(spark, sf):
    rows = _with_components(spark, sf).join(_labels(spark, sf), "doc_id")
    label = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).otherwise(0)
    guess = F.when(F.col("is_arg") == 0, 0).when(F.col("component") == "claim", 2).otherwise(1)
    rows = rows.select(label.alias("label"), guess.alias("prediction"))
    return _metrics(E.evaluate(rows, average="macro", classes=[1, 2])).select("f1")


def evaluate_splits(spark, sf):
    return _metrics(E.evaluate_splits(_held_out(spark, sf)), "set")


@_once
def _ml_detector(spark, sf):
    splits = _argument_splits(spark, sf)
    model, _ = M.train_classifier(
        M.select_split(splits, "train"), M.select_split(splits, "val"),
        reg_params=(0.01, 0.1),
    )
    return K.load_or_train(_model_path(spark, "classifier"), lambda: model)


def train_classifier(spark, sf):
    """What does not depend on the solver: rows, labels, and that it beats guessing on its training rows."""
    rows = _argument_splits(spark, sf).where("`set` = 'train'")
    scored = C.detect_sentences(rows, _ml_detector(spark, sf), "sentence")
    hits = F.sum((F.col("label") == F.col("is_arg")).cast("bigint"))
    ones = F.sum(F.col("label").cast("bigint"))
    return scored.agg(
        F.count("*").alias("n"),
        ones.alias("n_arguments"),
        (hits > F.greatest(ones, F.count("*") - ones)).alias("beats_guessing"),
    )


# --- compositions ---------------------------------------------------------


def incremental_query(spark, sf):
    root = scratch_path(spark, "arrivals")
    src, dst, checkpoint = f"{root}/in", f"{root}/out", f"{root}/checkpoint"
    docs = _documents(spark, sf)
    for part in range(2):
        docs.where(F.col("doc_id") % 2 == part).write.mode("append").parquet(src)
        incremental_sentences(
            spark, src, dst, checkpoint, "doc_id BIGINT, text STRING", "doc_id", "text"
        )
    return spark.read.parquet(dst).select(*KEY, "text", "start_index", "end_index")


def preprocess_corpus_query(spark, sf):
    corpus = O.scan_corpus(spark, _corpus(spark, sf), merge_schema=True)
    return preprocess_corpus(corpus, ["id", "language"])


def preprocess_files_query(spark, sf):
    """Two runs over a growing tree: the second one touches only the new files."""
    root = scratch_path(spark, "growing")
    docs = _documents(spark, sf, "doc_id", "lang", "text").select(
        F.col("doc_id").alias("id"), F.col("text").alias("main_content"),
        F.col("lang").alias("language"),
    )
    for part in range(2):
        W.write_mirrored(docs.where(F.col("id") % 2 == part), f"{root}/in", ["language"], "append")
        preprocess_files(spark, f"{root}/in", f"{root}/out", by=["language"])
    return spark.read.parquet(f"{root}/out").select("id", "language", "sent_idx", "text")


def score_corpus_query(spark, sf):
    scored = score_corpus(_split_sentences(spark, sf), _detector(spark, sf))
    return scored.select(*KEY, "text", "start_index", "end_index", "is_arg", _r("arg_prob", "arg_prob"))


def argument_share(spark, sf):
    """Sentences and argumentative share of every document."""
    scored = score_corpus(_split_sentences(spark, sf), _detector(spark, sf))
    return scored.groupBy("doc_id").agg(
        F.count("*").alias("n_sentences"),
        F.sum("is_arg").alias("n_arguments"),
        F.round(F.avg("is_arg"), 6).alias("share"),
    )


def mine_arguments_query(spark, sf):
    """The whole graph of every document, summed up in its own row."""

    def total(col: str, value) -> Column:
        return F.aggregate(col, F.lit(0).cast("bigint"), lambda acc, x: acc + value(x))

    return _mined(spark, sf, "lang").select(
        "doc_id",
        "lang",
        F.size("sentences").alias("n_sentences"),
        total("sentences", lambda s: s["is_arg"]["pred"].cast("int")).alias("n_arguments"),
        total(
            "sentences",
            lambda s: F.coalesce(
                (s["arg_component"]["pred"] == COMPONENT_LABELS[1]).cast("int"), F.lit(0)
            ),
        ).alias("n_claims"),
        F.size("relations").alias("n_relations"),
        total("relations", lambda r: r["source_sent"] * 31 + r["target_sent"]).alias("fingerprint"),
        total("relations", lambda r: (r["type"] == "conflict").cast("int")).alias("n_conflicts"),
    )


def train_detector_query(spark, sf):
    trained = train_detector(_labelled(spark, sf), KEY, balance=True)
    return trained.metrics.select("set", "metric", _r("value", "value"))


QUERIES: dict[str, Query] = {
    # sources
    "scan_corpus": scan_corpus,
    "scan_glob": scan_glob,
    "scan_partition": scan_partition,
    "scan_labelled": scan_labelled_query,
    "resolve_content": resolve_content,
    "pending_inputs": pending_inputs,
    "failed_inputs": failed_inputs,
    "relative_path": relative_path,
    # sinks
    "write_mirrored": write_mirrored,
    "write_documents": write_documents,
    "document_key": document_key,
    "index_export": index_export,
    "metrics_table": metrics_table,
    "save_model": save_model,
    "run_report": run_report,
    # projections and filters
    "cast_text": cast_text,
    "drop_empty": drop_empty,
    "binary_label": binary_label,
    "select_split": select_split,
    "select_confident": select_confident,
    "prune_columns": prune_columns,
    "filter_argumentative": filter_argumentative,
    "filter_linkable": filter_linkable,
    "filter_relations": filter_relations,
    # text
    "clean_text": clean_text,
    "clean_html": clean_html,
    "split_sentences": split_sentences,
    "split_pages": split_pages,
    "split_tight": split_tight,
    "split_conversations": split_conversations,
    "span_text": span_text,
    "flatten_positions": flatten_positions,
    "tokenize_truncate": tokenize_truncate,
    "tokenize_pair": tokenize_pair,
    # scoring
    "score_batches": score_batches,
    "score_linear": score_linear,
    "score_linear_rowwise": score_linear_rowwise,
    "score_linear_sharded": score_linear_sharded,
    "softmax": softmax,
    "argmax": argmax,
    "label_of": label_of,
    "prob_of": prob_of,
    "detect_sentences": detect_sentences,
    "classify_components": classify_components,
    "classify_relations": classify_relations,
    # pairs and assembly
    "windowed_pairs": windowed_pairs,
    "document_pairs": document_pairs,
    "attach_predictions": attach_predictions,
    "resolve_endpoints": resolve_endpoints,
    "attach_to_documents": attach_to_documents,
    "arg_index": arg_index,
    "group_by_document": group_by_document,
    "assemble_sentences": assemble_sentences,
    "assemble_relations": assemble_relations,
    "relation_edges": relation_edges,
    # sampling, training, evaluation
    "class_counts": class_counts,
    "balance_classes": balance_classes,
    "balance_classes_reverse": balance_classes_reverse,
    "shuffle_rows": shuffle_rows,
    "stack_files": stack_files,
    "best_model": best_model,
    "best_model_loss": best_model_loss,
    "train_rounds": train_rounds,
    "train_relations": train_relations,
    "relate_fitted": relate_fitted,
    "fit_vocabulary": fit_vocabulary,
    "train_log_odds": train_log_odds,
    "train_classifier": train_classifier,
    "prepare_splits": prepare_splits,
    "evaluate_binary": evaluate_binary,
    "evaluate_f1": evaluate_f1,
    "evaluate_f1_subset": evaluate_f1_subset,
    "evaluate_splits": evaluate_splits,
    # compositions
    "incremental_sentences": incremental_query,
    "preprocess_corpus": preprocess_corpus_query,
    "preprocess_files": preprocess_files_query,
    "score_corpus": score_corpus_query,
    "argument_share": argument_share,
    "mine_arguments": mine_arguments_query,
    "train_detector": train_detector_query,
}
