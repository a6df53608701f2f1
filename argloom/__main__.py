"""Command line: ``python -m argloom preprocess|score|mine|train ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from argloom.operators.scoring import LinearModel
from argloom.plans.mine import mine_arguments
from argloom.plans.preprocess import preprocess_files
from argloom.plans.score import score_files
from argloom.plans.train import train_detector
from argloom.session import build_session, drop_scratch
from argloom.sources import models, sinks
from argloom.sources.corpus import scan_corpus
from argloom.sources.labelled import scan_labelled


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="argloom", description="Argument mining over parquet corpora.")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, text: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name, help=text)
        sub.add_argument("--input_dir", "-i", required=True)
        sub.add_argument("--output_dir", "-o", required=True)
        return sub

    pre = job("preprocess", "clean and split documents, only files not done before")
    pre.add_argument("--id", default="id")
    pre.add_argument("--by", nargs="*", default=[], help="partition columns to mirror")

    score = job("score", "score sentence files, only those not done before")
    score.add_argument("--model_dir", "-m", required=True)
    score.add_argument("--by", nargs="*", default=[])

    mine = job("mine", "whole argument graph of every document, as JSON documents")
    mine.add_argument("--detector", required=True)
    mine.add_argument("--components", required=True)
    mine.add_argument("--content", default="main_content")
    mine.add_argument("--id", default="id")
    mine.add_argument("--glob", default="metadata_*.parquet")
    mine.add_argument("--prefix", default="documents")
    mine.add_argument("--index", help="also write bulk-index lines for this index")
    mine.add_argument("--window", type=int, default=5)

    train = job("train", "train and test a sentence detector on labelled TSV files")
    train.add_argument("--key", nargs="+", default=["sentence"], help="columns that identify a row")
    train.add_argument("--downsample", action="store_true")
    train.add_argument("--kind", choices=["linear", "ml"], default="linear")
    return top


def show(report: DataFrame | None) -> None:
    """Print how many files were done and how many failed, and some of the failed ones."""
    if report is None:
        print("no new files")
        return
    report.groupBy("status").agg(F.count("*").alias("files"), F.sum("expected").alias("rows")).show()
    failed = report.where("status = 'failed'").select("path", "expected", "read")
    if not failed.isEmpty():
        failed.show(truncate=False)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session(f"argloom-{args.job}")
    try:
        run(spark, args)
    finally:
        drop_scratch(spark)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.job == "preprocess":
        show(preprocess_files(spark, args.input_dir, args.output_dir, args.id, args.by))
    elif args.job == "score":
        model = models.load_model(spark, args.model_dir)
        show(score_files(spark, args.input_dir, args.output_dir, model, args.by))
    elif args.job == "mine":
        detector, components = (
            LinearModel(models.load_weights(spark, path)) for path in (args.detector, args.components)
        )
        docs = scan_corpus(spark, args.input_dir, glob=args.glob)
        mined = mine_arguments(docs, args.content, detector, components, window=args.window)
        # Two outputs: write the graph once, export from there.
        mined.write.mode("overwrite").parquet(f"{args.output_dir}/graph")
        mined = spark.read.parquet(f"{args.output_dir}/graph")
        sinks.write_documents(mined, f"{args.output_dir}/documents", args.prefix, args.id)
        if args.index:
            sinks.index_export(mined, f"{args.output_dir}/index", args.index, args.id)
    else:
        labelled = scan_labelled(spark, args.input_dir)
        trained = train_detector(labelled, args.key, balance=args.downsample, kind=args.kind)
        if isinstance(trained.model, LinearModel):
            models.save_weights(trained.model.weights, f"{args.output_dir}/model")
        else:
            trained.model.write().overwrite().save(f"{args.output_dir}/model")
        sinks.write_metrics(trained.metrics, f"{args.output_dir}/metrics")
        trained.metrics.show(truncate=False)


if __name__ == "__main__":
    main()
