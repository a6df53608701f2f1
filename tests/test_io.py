"""Sources, sinks, kept models, resuming and streaming."""

import json
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from argloom import session as N
from argloom.operators import text as X
from argloom.plans.preprocess import preprocess_files
from argloom.plans.score import score_files
from argloom.operators.scoring import LinearModel
from argloom.sources import corpus as O, models as K, sinks as W
from argloom.sources.labelled import scan_labelled
from argloom.sources.manifest import inspect, read_manifest, write_manifest
from argloom.streaming.incremental import incremental_sentences

DOCS = [(1, "One. Two two.", "eng"), (2, "Three is here. Four.", "deu"), (3, None, "eng")]


def documents(spark, rows=DOCS):
    return spark.createDataFrame(rows, "id INT, main_content STRING, language STRING")


def test_partition_pruning(spark, folder):
    W.write_mirrored(documents(spark), folder, ["language"])
    eng = O.scan_corpus(spark, folder, where="language = 'eng'")
    assert sorted(r.id for r in eng.collect()) == [1, 3]
    assert "PartitionFilters: [isnotnull" in eng._jdf.queryExecution().executedPlan().toString()
    assert (Path(folder) / "language=deu").is_dir()


def test_glob_and_flat(spark, folder):
    documents(spark).write.parquet(f"{folder}/deep/er")
    (Path(folder) / "deep" / "note.txt").write_text("no table")
    assert O.scan_corpus(spark, folder, flat=True).count() == 3
    with pytest.raises(AnalysisException):
        O.scan_corpus(spark, folder, glob="metadata_*.parquet", flat=True).count()


def test_content_column_per_file(spark, folder):
    documents(spark).write.mode("append").parquet(folder)
    spark.createDataFrame([(4, "Plain.")], "id INT, plain_text STRING").write.mode("append").parquet(folder)
    got = O.resolve_content(O.scan_corpus(spark, folder, merge_schema=True))
    assert {r.id: r.content for r in got.collect()} == {1: DOCS[0][1], 2: DOCS[1][1], 3: None, 4: "Plain."}
    with pytest.raises(AnalysisException):
        O.resolve_content(spark.range(1))


def test_labelled_files_with_quotes_and_other_column_order(spark, folder):
    (Path(folder) / "a.tsv").write_text(
        'sentence\tannotation\tset\nSay "hi\tNoArgument\ttrain\n"quoted" text\tArgument_for\tval\n'
    )
    (Path(folder) / "b.tsv").write_text("set\tsentence\tannotation\textra\ntest\tNo mark\t\tz\n")
    rows = {r.sentence: r for r in scan_labelled(spark, folder).collect()}
    assert set(rows) == {'Say "hi', '"quoted" text', "No mark"}
    assert rows["No mark"].annotation is None and rows["No mark"]["set"] == "test"
    assert rows["No mark"].extra == "z" and rows['Say "hi'].extra is None


def test_headers_cost_the_same_for_any_size(spark, folder, monkeypatch):
    from argloom.sources import labelled as A

    (Path(folder) / "small.tsv").write_text("sentence\tset\nOne.\ttrain\n")
    (Path(folder) / "large.tsv").write_text("sentence\tset\n" + "Many of them.\tval\n" * 200_000)
    (Path(folder) / "wide.tsv").write_text("\t".join(f"c{i}" for i in range(3000)) + "\n" + "\t".join("v" for _ in range(3000)))
    (Path(folder) / "none.tsv").write_text("")
    sizes = []

    class Watched:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read(self, n):
            data = self.file.read(n)
            sizes.append(len(data))
            return data

    class System:
        @staticmethod
        def from_uri(path):
            system, place = pa.fs.FileSystem.from_uri(path)
            return type("S", (), {"open_input_file": lambda self, p: Watched(system.open_input_file(p))})(), place

    monkeypatch.setattr(A, "FileSystem", System)
    assert A._first_line(f"{folder}/large.tsv") == b"sentence\tset" and sum(sizes) <= A.HEAD
    assert len(A._first_line(f"{folder}/wide.tsv").split(b"\t")) == 3000
    monkeypatch.undo()
    groups = A.read_headers(spark, folder, "*.tsv")
    assert [sorted(Path(p).stem for p in files) for files in groups.values()] == [["wide"], ["large", "small"]]
    assert scan_labelled(spark, folder).where("sentence IS NOT NULL").count() == 200_001
    assert A.read_headers(spark, folder, "*.csv") == {}


def test_unreadable_files_stay_visible(spark, folder):
    W.write_mirrored(documents(spark), folder, ["language"])
    (Path(folder) / "language=eng" / "broken.parquet").write_bytes(b"not parquet")
    seen = O.scan_corpus(spark, folder, skip_corrupt=True, with_file=True)
    assert seen.count() == 3
    report = inspect(spark, folder, O.list_files(spark, folder, "*.parquet"))
    failed = O.relative_path(report.where("status = 'failed'"), folder)
    assert [r.relative_path for r in failed.collect()] == ["language=eng/broken.parquet"]


def test_resume_processes_each_file_once(spark, folder):
    src, out, scored = f"{folder}/in", f"{folder}/out", f"{folder}/scored"
    W.write_mirrored(documents(spark), src, ["language"])
    preprocess_files(spark, src, out, by=["language"])
    preprocess_files(spark, src, out, by=["language"])
    assert spark.read.parquet(out).count() == 4
    more = documents(spark, [(9, "Nine. Ten ten.", "eng"), (10, "Eleven.", "a b%c")])
    W.write_mirrored(more, src, ["language"], mode="append")
    for _ in range(2):
        preprocess_files(spark, src, out, by=["language"])
    rows = spark.read.parquet(out)
    assert rows.count() == 7 and rows.where("language = 'eng'").count() == 4
    assert rows.where("language = 'a b%c'").count() == 1
    model = LinearModel(spark.createDataFrame([("two", 5)], "token STRING, weight BIGINT"))
    score_files(spark, out, scored, model, by=["language"])
    score_files(spark, out, scored, model, by=["language"])
    assert spark.read.parquet(scored).agg(F.count("*"), F.sum("is_arg")).first()[:] == (7, 1)


def test_empty_documents_keep_the_schema(spark, folder):
    documents(spark, [(3, None, "eng"), (4, "<p></p>", "eng")]).write.parquet(f"{folder}/in")
    preprocess_files(spark, f"{folder}/in", f"{folder}/out")
    got = spark.read.parquet(f"{folder}/out")
    assert got.count() == 0 and {"text", "start_index", "end_index"} <= set(got.columns)


def test_document_json(spark, folder):
    df = X.nest_sentences(documents(spark), "main_content")
    W.write_documents(df, folder, "corpus")
    rows = {r.key: json.loads(r.body) for r in spark.read.json(folder).collect()}
    assert set(rows) == {"corpus/1.json", "corpus/2.json", "corpus/3.json"}
    assert [s["text"] for s in rows["corpus/1.json"]["sentences"]] == ["One.", "Two two."]


def test_index_lines_stay_together(spark, folder):
    W.index_export(documents(spark), folder, "args")
    for file in Path(folder).glob("part-*"):
        lines = file.read_text().splitlines()
        for action, source in zip(lines[::2], lines[1::2]):
            assert json.loads(action)["index"]["_id"] == str(json.loads(source)["id"])


def test_metrics_round_trip(spark, folder):
    df = spark.createDataFrame([("val", "f1", 0.5)], "`set` STRING, metric STRING, value DOUBLE")
    W.write_metrics(df, folder)
    assert W.read_metrics(spark, folder).collect() == df.collect()


def test_weights_are_trained_once(spark, folder):
    calls = []

    def train():
        calls.append(1)
        return spark.createDataFrame([("a", len(calls))], "token STRING, weight BIGINT")

    for _ in range(2):
        model = K.load_or_train_linear(spark, f"{folder}/w", train)
        assert model.weights.first().weight == 1
    model = K.load_or_train_linear(spark, f"{folder}/w", train, force=True)
    assert model.weights.first().weight == 2 and calls == [1, 1]


def test_run_report(spark, folder):
    W.write_mirrored(documents(spark), folder, ["language"])
    report = O.run_report(O.scan_corpus(spark, folder, with_file=True))
    assert sum(r.rows for r in report.collect()) == 3


def test_stream_takes_new_files_once(spark, folder):
    src, dst, mark = f"{folder}/in", f"{folder}/out", f"{folder}/mark"
    schema = "id INT, main_content STRING, language STRING"

    def run():
        incremental_sentences(spark, src, dst, mark, schema, "id", "main_content")
        return spark.read.parquet(dst).count()

    documents(spark).write.parquet(src)
    assert run() == 4
    assert run() == 4
    documents(spark, [(9, "Nine. Ten.", "eng")]).write.mode("append").parquet(src)
    assert run() == 6


def damaged_file(path, rows=4000):
    """A parquet file of four row groups, the third of which is overwritten with zeros."""
    table = pa.table({"id": pa.array(range(rows)), "main_content": [f"Text {i}. More." for i in range(rows)]})
    pq.write_table(table, path, row_group_size=rows // 4, compression="none", use_dictionary=False)
    group = pq.ParquetFile(path).metadata.row_group(2)
    start = min(group.column(c).data_page_offset for c in range(2))
    with open(path, "r+b") as file:
        file.seek(start)
        file.write(b"\0" * 2000)


def tree(spark, folder):
    """A whole file, one without rows, one without sentences, a damaged one and one that is no parquet."""
    src = Path(folder) / "in"
    src.mkdir()
    schema = pa.schema([("id", pa.int64()), ("main_content", pa.string())])
    pq.write_table(pa.table({"id": [1, 2], "main_content": ["One. Two.", "Three."]}, schema), src / "whole.parquet")
    pq.write_table(schema.empty_table(), src / "empty.parquet")
    pq.write_table(pa.table({"id": [3], "main_content": ["<p></p>"]}, schema), src / "silent.parquet")
    damaged_file(str(src / "damaged.parquet"))
    (src / "other.parquet").write_text("no parquet at all")
    return str(src)


WANT = {
    "whole": (2, 2, "done"), "empty": (0, 0, "done"), "silent": (1, 1, "done"),
    "damaged": (4000, 3000, "failed"), "other": (None, 0, "failed"),
}


def by_name(report):
    return {Path(r.path).stem: (r.expected, r.read, r.status) for r in report.collect()}


def test_no_row_is_lost_silently(spark, folder):
    src = tree(spark, folder)
    got = by_name(preprocess_files(spark, src, f"{folder}/out"))
    damaged = got.pop("damaged")
    assert damaged[0] == 4000 and damaged[1] < 4000 and damaged[2] == "failed"
    assert got == {k: v for k, v in WANT.items() if k != "damaged"}
    out = spark.read.parquet(f"{folder}/out")
    assert sorted(r.text for r in out.collect()) == ["One.", "Three.", "Two."]
    again = by_name(preprocess_files(spark, src, f"{folder}/out"))
    assert set(again) == {"damaged", "other"}  # the failed ones are tried again, nothing else
    assert spark.read.parquet(f"{folder}/out").count() == 3
    table = pa.table({"id": [9], "main_content": ["Mended."]})
    (Path(src) / "other.parquet").unlink()
    pq.write_table(table, Path(src) / "other.parquet")
    assert by_name(preprocess_files(spark, src, f"{folder}/out"))["other"] == (1, 1, "done")
    assert spark.read.parquet(f"{folder}/out").count() == 4
    manifest = {Path(r.path).stem: r.status for r in read_manifest(spark, f"{folder}/out").collect()}
    assert manifest == {k: "failed" if k == "damaged" else "done" for k in WANT}


def test_a_run_that_broke_off_before_its_manifest(spark, folder):
    documents(spark).coalesce(1).write.parquet(f"{folder}/in")
    report = preprocess_files(spark, f"{folder}/in", f"{folder}/out")
    rows = spark.read.parquet(f"{folder}/out").count()
    write_manifest(report.withColumn("status", F.lit("started")), f"{folder}/out")
    assert preprocess_files(spark, f"{folder}/in", f"{folder}/out") is None
    assert spark.read.parquet(f"{folder}/out").count() == rows


def test_stream_goes_on_after_a_damaged_file(spark, folder):
    src = tree(spark, folder)
    incremental_sentences(spark, src, f"{folder}/out", f"{folder}/mark", "id LONG, main_content STRING", "id", "main_content")
    pq.write_table(pa.table({"id": [9], "main_content": ["Nine. Ten."]}), f"{src}/late.parquet")
    incremental_sentences(spark, src, f"{folder}/out", f"{folder}/mark", "id LONG, main_content STRING", "id", "main_content")
    texts = {r.text for r in spark.read.parquet(f"{folder}/out").where("id in (1, 2, 9)").collect()}
    assert {"One.", "Two.", "Three.", "Nine.", "Ten."} <= texts
    status = {Path(r.path).stem: r.status for r in read_manifest(spark, f"{folder}/out").collect()}
    assert status == {**{k: v[2] for k, v in WANT.items()}, "late": "done"}


@pytest.fixture()
def reads(monkeypatch):
    """The files of every read that goes beyond footers, in order."""
    from argloom.plans import files as P
    from argloom.sources import manifest as M

    calls = []

    def reading(*args):
        read = M.reading(*args)

        def counted(session, paths):
            calls.append(sorted(Path(p).stem for p in paths))
            return read(session, paths)

        return counted

    monkeypatch.setattr(P, "reading", reading)
    return calls


def test_whole_files_are_read_once(spark, folder, reads):
    rows = [(i, f"Sentence {i} of many. And more.", "eng") for i in range(500)]
    documents(spark, rows).repartition(8).write.parquet(f"{folder}/in")
    preprocess_files(spark, f"{folder}/in", f"{folder}/out")
    assert len(reads) == 1 and len(reads[0]) == 8
    assert spark.read.parquet(f"{folder}/out").count() == 1000


def test_only_files_near_damage_are_read_again(spark, folder, reads):
    documents(spark, [(i, "One.", "eng") for i in range(90)]).selectExpr("bigint(id) AS id", "main_content").repartition(30).write.parquet(f"{folder}/in")
    damaged_file(f"{folder}/in/damaged.parquet")
    report = preprocess_files(spark, f"{folder}/in", f"{folder}/out")
    assert [Path(r.path).stem for r in report.where("status = 'failed'").collect()] == ["damaged"]
    first, suspects, again = reads
    assert len(first) == 31 and "damaged" in suspects and len(suspects) <= 4 and len(again) == 30
    assert spark.read.parquet(f"{folder}/out").count() == 90


def test_the_job_reads_only_its_columns(spark, folder):
    from argloom.sources.manifest import reading

    documents(spark).withColumn("rest", F.lit("x" * 99)).write.parquet(f"{folder}/in")
    read = reading(f"{folder}/in", ["id", "main_content", "plain_text"])(spark, [f"{folder}/in"])
    schema = read._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1]
    assert "main_content" in schema and "rest" not in schema


def mended(path, rows):
    Path(path).unlink()
    pq.write_table(pa.table({"id": [r[0] for r in rows], "main_content": [r[1] for r in rows]}), path)


SCHEMA = "id LONG, main_content STRING"


def stream(spark, src, folder):
    incremental_sentences(spark, src, f"{folder}/out", f"{folder}/mark", SCHEMA, "id", "main_content")
    return sorted(r.text for r in spark.read.parquet(f"{folder}/out").collect())


def test_a_mended_file_comes_back_once(spark, folder):
    src = tree(spark, folder)
    assert stream(spark, src, folder) == ["One.", "Three.", "Two."]  # nothing of the damaged file
    assert stream(spark, src, folder) == ["One.", "Three.", "Two."]
    mended(f"{src}/damaged.parquet", [(7, "Mended. Whole.")])
    for _ in range(2):
        assert stream(spark, src, folder) == ["Mended.", "One.", "Three.", "Two.", "Whole."]
    mended(f"{src}/other.parquet", [(8, "Parquet now.")])
    assert "Parquet now." in stream(spark, src, folder)
    status = {Path(r.path).stem: r.status for r in read_manifest(spark, f"{folder}/out").collect()}
    assert set(status.values()) == {"done"}


def test_mending_again_after_a_kill_gives_equal_rows(spark, folder, monkeypatch):
    from argloom.streaming import incremental as I

    src = tree(spark, folder)
    before = stream(spark, src, folder)
    mended(f"{src}/damaged.parquet", [(7, "Mended. Whole.")])

    def killed(report, dst):
        raise RuntimeError("killed before the manifest")

    monkeypatch.setattr(I, "write_manifest", killed)
    with pytest.raises(RuntimeError):
        stream(spark, src, folder)
    monkeypatch.undo()
    mended(f"{src}/other.parquet", [(8, "Parquet now.")])  # what is behind differs from the time before
    want = sorted([*before, "Mended.", "Whole.", "Parquet now."])
    assert stream(spark, src, folder) == want == stream(spark, src, folder)


def test_a_batch_replayed_after_a_kill_gives_equal_rows(spark, folder, monkeypatch):
    from argloom.streaming import incremental as I

    src = tree(spark, folder)

    def killed(report, dst):
        raise RuntimeError("killed before the manifest")

    monkeypatch.setattr(I, "write_manifest", killed)
    with pytest.raises(Exception):
        stream(spark, src, folder)
    monkeypatch.undo()
    assert stream(spark, src, folder) == ["One.", "Three.", "Two."]


def test_counts_too_high_are_looked_into(spark, folder):
    """Rows that count twice, as after a lost executor, make a file suspect but not damaged."""
    from argloom.sources import manifest as M

    documents(spark).coalesce(1).write.parquet(f"{folder}/in")
    files = M.footers(spark, f"{folder}/in", M.as_files(O.list_files(spark, f"{folder}/in", "*.parquet")))
    read, staged = M.reading(f"{folder}/in"), spark.range(3)
    counts = Counter()
    for f in files:
        counts[M.bucket(f.source_file)] += 2 * f.expected
    rows, report = M.settle(files, counts, staged, read, lambda df: df)
    assert rows is staged and [(f.read, f.status) for f in report] == [(3, "done")]


class _Session:
    """As much of a session as the scratch folder looks at."""

    def __init__(self, master, conf):
        self.conf = conf
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"test-{master}"})


def test_scratch_is_removed(spark):
    kept = N._MADE.pop(spark.sparkContext.applicationId, [])
    table = N.materialize(spark.range(3), "here")
    path = N._MADE[spark.sparkContext.applicationId][0]
    assert table.count() == 3 and O.exists(spark, path)
    N.drop_scratch(spark)
    assert not O.exists(spark, path)
    N._MADE[spark.sparkContext.applicationId] = kept


def test_scratch_folder_follows_the_cluster(folder):
    shared = _Session("yarn", {"spark.checkpoint.dir": f"{folder}/shared/"})
    assert N.scratch_root(shared) == f"{folder}/shared"
    with pytest.raises(RuntimeError):
        N.scratch_root(_Session("yarn", {}))
    local = _Session("local[2]", {})
    assert N.scratch_root(local) == N.scratch_root(local)


def test_spread_leaves_wide_inputs_alone(spark):
    wide, narrow = spark.range(0, 100, 1, 64), spark.range(0, 100, 1, 1)
    assert N.spread(wide) is wide
    assert N.spread(narrow).rdd.getNumPartitions() > 1
