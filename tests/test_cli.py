"""The command line, end to end on a small tree."""

import json
import random
from pathlib import Path

from argloom.__main__ import main
from argloom.sources import sinks as W


def test_jobs_end_to_end(spark, folder):
    rng = random.Random(6)
    cues = {"NoArgument": ["lamp", "table"], "Argument_for": ["because", "therefore"]}
    lines = ["sentence\tannotation\tset"]
    for i in range(240):
        mark = rng.choice(list(cues))
        text = f"s{i} " + " ".join(rng.choice(cues[mark] + ["the"]) for _ in range(6))
        lines.append(f"{text}\t{mark}\t{['train', 'train', 'val', 'test'][i % 4]}")
    (Path(folder) / "tsv").mkdir()
    (Path(folder) / "tsv" / "a.tsv").write_text("\n".join(lines) + "\n")
    main(["train", "-i", f"{folder}/tsv", "-o", f"{folder}/asd", "--downsample"])
    assert W.read_metrics(spark, f"{folder}/asd/metrics").count() == 8

    docs = [(1, "We act because it rains. The lamp is here. Therefore because we act.", "eng")]
    frame = spark.createDataFrame(docs, "id INT, main_content STRING, language STRING")
    W.write_mirrored(frame, f"{folder}/in", ["language"])
    main(["preprocess", "-i", f"{folder}/in", "-o", f"{folder}/sentences", "--by", "language"])
    main(["score", "-i", f"{folder}/sentences", "-o", f"{folder}/scored", "-m", f"{folder}/asd/model"])
    scored = {r.sent_idx: r.is_arg for r in spark.read.parquet(f"{folder}/scored").collect()}
    assert scored == {0: 1, 1: 0, 2: 1}

    model = f"{folder}/asd/model"
    main(
        ["mine", "-i", f"{folder}/in", "-o", f"{folder}/mined", "--detector", model, "--components", model]
        + ["--glob", "*.parquet", "--index", "args"]
    )
    (row,) = spark.read.json(f"{folder}/mined/documents").collect()
    body = json.loads(row.body)
    assert row.key == "documents/1.json" and body["language"] == "eng"
    assert [s["is_arg"]["pred"] for s in body["sentences"]] == [True, False, True]
    assert body["sentences"][1]["arg_component"] is None
    assert {(e["source"], e["target"]) for e in body["relations"]} <= {(0, 1), (1, 0)}
    assert spark.read.text(f"{folder}/mined/index").count() == 2


def test_ml_model_scores(spark, folder):
    lines = ["sentence\tannotation\tset"]
    for i in range(120):
        mark, cue = ("Argument", "because") if i % 2 else ("NoArgument", "lamp")
        lines.append(f"s{i} {cue} the {cue}\t{mark}\t{['train', 'train', 'train', 'val', 'val', 'test', 'test'][i % 7]}")
    (Path(folder) / "tsv").mkdir()
    (Path(folder) / "tsv" / "a.tsv").write_text("\n".join(lines) + "\n")
    main(["train", "-i", f"{folder}/tsv", "-o", f"{folder}/asd", "--kind", "ml"])
    frame = spark.createDataFrame([(1, "We act because it rains. The lamp is here.")], "id INT, main_content STRING")
    frame.write.parquet(f"{folder}/in")
    main(["preprocess", "-i", f"{folder}/in", "-o", f"{folder}/sentences"])
    main(["score", "-i", f"{folder}/sentences", "-o", f"{folder}/scored", "-m", f"{folder}/asd/model"])
    assert {r.sent_idx: r.is_arg for r in spark.read.parquet(f"{folder}/scored").collect()} == {0: 1, 1: 0}
