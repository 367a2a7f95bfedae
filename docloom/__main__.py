"""Stages as commands over shared storage: ``python -m docloom <stage> ...`` (or spark-submit).

Stages hand Parquet on; the tab-separated and line files are for exchange with other programs.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import EngineConfig, LanguageModelConfig, SplitConfig
from docloom.functions.labels import join_labels
from docloom.operators import models, profile, validate
from docloom.operators.labels import collect_vocabulary, label_frequency, unmapped_labels
from docloom.plans import stages
from docloom.session import get_spark
from docloom.sinks import (
    publish_layout,
    publish_view,
    single_files,
    write_metrics_json,
    write_text_lines,
    write_tsv_pair,
)
from docloom.sources import published_headers, scan_documents, scan_label_map, scan_pairs, scan_published


def ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    """Store documents, numbered, or tab-separated pairs as Parquet, which is splittable."""
    if args.format == "tsv":
        scan_pairs(spark, args.input).write.mode("overwrite").partitionBy("split").parquet(args.output)
        return
    scan_documents(spark, args.input, args.format, missing_ok=False).write.mode("overwrite").parquet(args.output)


def prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    """Split, filter and relabel; writes ``parquet``, ``in`` and ``expected`` under the output."""
    config = SplitConfig(args.train, args.test, args.dev, args.parts)
    documents = spark.read.parquet(args.input)
    label_map = scan_label_map(spark, args.label_map)
    if not args.lenient:
        # A report of everything that is missing beats the failure on the first such label.
        missing = unmapped_labels(documents, label_map).orderBy(F.desc("n_uses"), "raw")
        shown = [f"{r['raw']} ({r['n_uses']})" for r in missing.limit(50).collect()]
        if shown:
            more = missing.count() - len(shown)
            raise SystemExit("unmapped labels: " + ", ".join(shown) + (f" and {more} more" if more else ""))
    rows = stages.prepare(documents, label_map, config=config, strict=not args.lenient, dense=True)
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{args.output}/parquet")
    stored = spark.read.parquet(f"{args.output}/parquet")
    write_tsv_pair(stored, args.output)
    # The files themselves are read again: every line must have its partner.
    written = scan_pairs(spark, args.output)
    if written.where("text is not null and size(labels) >= 0").count() != stored.count():
        raise AssertionError("the written pairs do not hold all rows")


def rewrite(spark: SparkSession, args: argparse.Namespace) -> None:
    """Clean the texts; writes ``parquet`` and ``lm`` (one document per line)."""
    stages.rewrite(spark.read.parquet(args.input)).write.mode("overwrite").partitionBy("split").parquet(
        f"{args.output}/parquet"
    )
    stored = spark.read.parquet(f"{args.output}/parquet")
    write_text_lines(stored, "lm_text", f"{args.output}/lm")
    stages.census(stored).orderBy("split", "token").show(100, truncate=False)


def language_model(spark: SparkSession, args: argparse.Namespace) -> None:
    """Learn the vocabulary, encode and mask the corpus, score the bigram model."""
    config = LanguageModelConfig(vocab_size=args.vocab_size, min_frequency=args.min_frequency)
    corpus = spark.read.parquet(args.input)
    model = stages.learn_vocabulary(corpus, config)
    model.save(spark, args.output)
    stages.lm_examples(corpus, model, "row_idx", config).write.mode("overwrite").partitionBy("split").parquet(
        f"{args.output}/examples"
    )
    write_metrics_json(stages.lm_score(corpus), f"{args.output}/scores")


def classify(spark: SparkSession, args: argparse.Namespace) -> None:
    """Train a baseline, write the decoded predictions of dev and test and the test scores."""
    prepared = spark.read.parquet(args.input)
    model, predictions = stages.classify(prepared, args.family, EngineConfig())
    predictions.drop("text").write.mode("overwrite").partitionBy("split").parquet(f"{args.output}/predictions")
    stored = spark.read.parquet(f"{args.output}/predictions")
    write_text_lines(stored, join_labels(F.col("pred_labels")), f"{args.output}/out")
    write_metrics_json(stages.score_predictions(stored), f"{args.output}/scores")
    models.save_model(spark, model, f"{args.output}/model")


def predict(spark: SparkSession, args: argparse.Namespace) -> None:
    """Label the texts of a line file, or the given strings."""
    model = models.load_model(spark, args.model)
    if args.text:
        texts = spark.createDataFrame([(t,) for t in args.text], "text string")
    else:
        texts = spark.read.text(args.input, lineSep="\n").withColumnRenamed("value", "text")
    labelled = models.predict_multilabel(texts, model).select("text", join_labels(F.col("pred_labels")).alias("labels"))
    if args.output:
        labelled.write.mode("overwrite").json(args.output)
    else:
        for row in labelled.toLocalIterator():
            print(f"{row['text']}\t{row['labels']}")


def describe(spark: SparkSession, args: argparse.Namespace) -> None:
    """Profile of the prepared corpus: labels, lengths, words and bigrams, each as JSON."""
    rows = spark.read.parquet(args.input)
    lengths = profile.length_profile(rows).persist()

    def of_kind(kind: str) -> DataFrame:
        return lengths.where(F.col("kind") == kind).drop("kind")

    reports = {
        "corpus_count": profile.corpus_count(rows),
        "label_frequency": label_frequency(rows).orderBy(F.desc("n_uses"), "label"),
        "lengths": lengths,
        "top_common_lengths": profile.top_common_lengths(of_kind("all")),
        "top_longest_lengths": profile.top_longest_lengths(of_kind("all")),
        "top_longest_nonnumeric": profile.top_longest_lengths(of_kind("nonnumeric")),
        "top_words": profile.top_words(profile.word_frequency(rows)),
        "top_bigrams": profile.top_bigrams(profile.bigram_frequency(rows)),
    }
    for name, report in reports.items():
        report.write.mode("overwrite").json(f"{args.output}/{name}")
    lengths.unpersist()


def publish(spark: SparkSession, args: argparse.Namespace) -> None:
    """Check the rows and write the gzip-compressed layout, public and with all labels."""
    rows = spark.read.parquet(args.input)
    vocabulary = collect_vocabulary(rows)
    predictions = spark.read.parquet(args.predictions) if args.predictions else None
    if predictions is not None:
        predictions = predictions.select("split", "row_idx", F.col("pred_labels").alias("labels"))

    def check(view: DataFrame, public: bool, **options) -> None:
        problems = validate.validate_publish(view, vocabulary, public, **options).where("n_bad > 0").collect()
        if problems:
            raise SystemExit("not published: " + json.dumps({r["check_name"]: r["n_bad"] for r in problems}))

    check(publish_view(rows), True)
    for name, public in (("public", True), ("private", False)):
        path = f"{args.output}/{name}"
        publish_layout(rows, path, public=public, predictions=None if public else predictions)
        # The files as they were written are checked too, with their headers.
        check(scan_published(spark, path, public), public, headers=published_headers(spark, path))
        if args.single_files:
            single_files(spark, path, f"{args.output}/{name}-files")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="docloom")
    stages_ = parser.add_subparsers(dest="stage", required=True)

    def stage(function, needs_input: bool = True, needs_output: bool = True) -> argparse.ArgumentParser:
        sub = stages_.add_parser(function.__name__.replace("_", "-"), help=function.__doc__)
        sub.add_argument("--input", required=needs_input)
        sub.add_argument("--output", required=needs_output)
        sub.set_defaults(run=function)
        return sub

    stage(ingest).add_argument("--format", default="json", choices=("json", "jsonl", "parquet", "tsv"))
    defaults = SplitConfig()
    sub = stage(prepare)
    sub.add_argument("--label-map", required=True)
    sub.add_argument("--lenient", action="store_true", help="drop unmapped labels instead of failing")
    for name in ("train", "test", "dev"):
        sub.add_argument(f"--{name}", type=float, default=getattr(defaults, name))
    sub.add_argument("--parts", type=int, default=defaults.parts)
    stage(rewrite)
    sub = stage(language_model)
    sub.add_argument("--vocab-size", type=int, default=LanguageModelConfig.vocab_size)
    sub.add_argument("--min-frequency", type=int, default=LanguageModelConfig.min_frequency)
    stage(classify).add_argument("--family", default="logistic_regression", choices=sorted(models.FAMILIES))
    sub = stage(predict, needs_input=False, needs_output=False)
    sub.add_argument("--model", required=True)
    sub.add_argument("text", nargs="*")
    stage(describe)
    sub = stage(publish)
    sub.add_argument("--predictions", help="predictions of the classify stage, for the private copy")
    sub.add_argument("--single-files", action="store_true", help="also one file per split, for other programs")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    args.run(spark or get_spark(f"docloom {args.stage}"), args)


if __name__ == "__main__":
    main()
