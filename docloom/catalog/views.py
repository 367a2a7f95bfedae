"""The given tables seen as raw documents, a label map and label scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import SplitConfig
from docloom.functions import labels as L
from docloom.functions import text as X
from docloom.operators.labels import remap_labels
from docloom.operators.row_index import global_row_index
from docloom.operators.split import split_by_row_index
from docloom.plans import stages
from docloom.sources import scan_table

# The catalog's own labels, one of them capitalised on purpose.
CANONICAL = (
    "music cooking Gardening astronomy chess sailing weather railways "
    "pottery birds mountains theatre photography bridges languages textiles"
).split()
LABEL_MAP = {f"src{k}": CANONICAL[k % len(CANONICAL)] for k in range(20)} | {
    "en": "birds",
    "fr": "mountains",
    "de": "chess",
    "es": "music",
    "quality": "Gardening",
    "toxic": "photography",
}
VOCABULARY = sorted(label.lower() for label in CANONICAL)
# Model ids of the views below: hashed tokens fill the ordinary ids of a vocabulary of this size.
VOCAB_SIZE = 16000
N_SPECIAL = 9


# Tables of long texts and their keys.
_TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_table(spark, f"{sf_dir}/{name}.parquet", spread_by=_TEXT_KEYS.get(name))


def _content_and_date() -> list[Column]:
    doc_id = F.col("doc_id")
    content = F.when(doc_id % 50 == 7, F.lit(" \na")).otherwise(F.col("text"))
    date = F.date_format(F.date_add(F.lit("2004-01-01").cast("date"), (doc_id % 5000).cast("int")), "yyyy-MM-dd")
    return [content.alias("content"), date.alias("date")]


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, content, date)`` with near-empty documents: raw documents where labels play no part."""
    return table(spark, sf_dir, "documents").select("doc_id", *_content_and_date())


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, content, date, buckets)``: raw texts with empty label sets and untidy labels."""
    d = table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels")
    doc_id = F.col("doc_id")
    buckets = F.when(doc_id % 50 == 49, F.array().cast("array<string>")).otherwise(
        F.array_compact(
            F.array(
                F.concat(F.lit(" "), F.upper("source")),
                F.concat(F.col("lang"), F.lit("\n")),
                F.when(F.col("quality") == 1, F.lit("Quality")),
                F.when(F.col("toxic") == 1, F.lit("TOXIC ")),
            )
        )
    )
    return d.join(marks, "doc_id", "left").select("doc_id", *_content_and_date(), buckets.alias("buckets"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, date, split, text)`` of the kept documents; no text is shuffled for it."""
    return stages.flatten(raw_texts(spark, sf_dir), "doc_id")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, date, split, text, labels)`` of the kept documents."""
    return stages.prepare(raw_documents(spark, sf_dir), LABEL_MAP, key="doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``texts`` with the cleaned text."""
    return stages.rewrite(texts(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_idx, doc_id, date, labels, split)`` of the kept documents, without their texts."""
    narrow = raw_documents(spark, sf_dir).select(
        "doc_id", "date", "buckets", X.has_min_content(F.col("content")).alias("keep")
    )
    indexed = split_by_row_index(global_row_index(narrow, "doc_id"), SplitConfig())
    return remap_labels(indexed.where("keep").drop("keep"), LABEL_MAP)


def indexed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prepared`` as the writers take it, in the order of ``doc_id``."""
    return prepared(spark, sf_dir).withColumnRenamed("doc_id", "row_idx")


def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_idx, labels, truth, scores, pred)`` with made-to-measure scores around the truth."""
    base = labelled(spark, sf_dir).withColumn("truth", L.multi_hot(F.col("labels"), VOCABULARY))

    def score(hot: Column, idx: Column) -> Column:
        noise = ((F.col("row_idx") * 7919 + idx * 104729) % 2000).cast("double") / F.lit(1000.0)
        return noise - F.lit(1.4) + F.lit(1.8) * hot

    scored = base.withColumn("scores", F.transform("truth", score))
    return scored.withColumn("pred", L.threshold_scores(F.col("scores")))


def masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text the cleaner may meet: ``(origin, id, text)`` of documents, pages and conversations."""
    documents = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("id"), "text"
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("origin"), F.col("page_id").cast("string").alias("id"), F.col("html").alias("text")
    )
    talk = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("origin"), F.concat_ws("/", "conv_id", "turn").alias("id"), "text"
    )
    return documents.unionByName(pages).unionByName(talk)


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, ids)``: each token hashed into the ordinary ids."""
    tokens = X.tokenize_words(F.col("text"))

    def hashed(t: Column) -> Column:
        bits = F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long")
        return (bits % (VOCAB_SIZE - N_SPECIAL) + N_SPECIAL).cast("int")

    return table(spark, sf_dir, "documents").select("doc_id", F.transform(tokens, hashed).alias("ids"))
