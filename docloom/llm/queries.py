"""One query per operator, with production parameters, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import bound_batches
from docloom.llm.decontamination import contamination
from docloom.llm.filter_audit import filter_audit
from docloom.llm.hmm import lm_scores
from docloom.llm.line_dedup import line_dedup
from docloom.llm.mixing import mix, word_count
from docloom.llm.oracle import ORACLE_SQL
from docloom.llm.piece_encoding import round_trip
from docloom.llm.pieces import load_model
from docloom.llm.quality import sampled
from docloom.llm.secret_scan import secrets
from docloom.llm.simhash import near_duplicates
from docloom.llm.spelling import spelling_variants
from docloom.llm.token_counts import token_counts
from docloom.llm.toxicity import toxicity
from docloom.llm.winnowing import edited_fingerprints
from docloom.session import materialize

__all__ = ["ORACLE_SQL", "QUERIES"]

# The vocabulary of the two piece operators; a parameter of the environment, read by the driver alone.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_secrets(spark, sf_dir):
    """Fixed and learned secret spans of every document."""
    return secrets(_table(spark, sf_dir, "documents"))


@query
def op2_quality(spark, sf_dir):
    """The documents drawn by importance resampling; those that are missing are rejected."""
    return sampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op3_winnowing(spark, sf_dir):
    """Fingerprints of every text and of its edited text."""
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


@query
def op4_token_counts(spark, sf_dir):
    """Characters, pre-tokens and tokens of every document."""
    return token_counts(_table(spark, sf_dir, "documents"), load_model(PIECE_MODEL))


@query
def op5_piece_encoding(spark, sf_dir):
    """Ids of every document and whether they decode to the text itself.

    A space mark (U+2581) in a text decodes to a space, as the vocabulary has one sign for both.
    """
    return round_trip(_table(spark, sf_dir, "documents"), load_model(PIECE_MODEL))


@query
def op6_toxicity(spark, sf_dir):
    """Category probabilities and the toxic flag of every document."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op7_hmm_scores(spark, sf_dir):
    """Unigram and hidden Markov scores of every document."""
    return lm_scores(_table(spark, sf_dir, "documents"))


@query
def op8_line_dedup(spark, sf_dir):
    """Every document without the lines of repeated three-line windows."""
    docs = _table(spark, sf_dir, "documents")
    return line_dedup(docs.select("doc_id", "text"))


@query
def op9_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op10_decontamination(spark, sf_dir):
    """Words, hit words and items of every document."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op11_filter_audit(spark, sf_dir):
    """What each of five filters removes in every order of them, per language."""
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op12_mixing(spark, sf_dir):
    """Target of every document's source and the words that the mix takes of the document."""
    docs = _table(spark, sf_dir, "documents")
    # Sizes are all that a plan needs: texts are read once and not shuffled.
    sized = materialize(docs.select("doc_id", "source", word_count().alias("size")), "document-sizes")
    taken = F.col("copies") * F.col("size")
    return mix(sized).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


@query
def op13_spelling(spark, sf_dir):
    """Words with their near words, their more frequent form and its root."""
    return spelling_variants(_table(spark, sf_dir, "documents"))
