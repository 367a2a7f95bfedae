"""One query per operator over the whole given tables: ``name -> (spark, sf_dir) -> DataFrame``.

Arrays leave as joined strings and floats rounded, so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.catalog import views as V
from docloom.config import MASK_TOKENS, SPECIAL_TOKENS, LanguageModelConfig
from docloom.functions import encoding as E
from docloom.functions import labels as L
from docloom.functions import text as X
from docloom.operators import bpe, labels, metrics, models, profile, split, validate
from docloom.operators.row_index import global_row_index
from docloom.plans import stages
from docloom.session import scratch_path
from docloom.sinks import (
    publish_layout,
    publish_view,
    single_files,
    write_gzip,
    write_json_arrays,
    write_metrics_json,
    write_text_lines,
    write_tsv_pair,
)
from docloom.sources import scan_documents, scan_label_map, scan_published, scan_text_lines, scan_tsv
from docloom.sources import scan_pairs as scan_pairs_of
from docloom.sources.tables import stored_bytes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_SPLITS = ("train", "test", "dev")
# Vocabulary size of the learned example: specials, bytes and merges.
_BPE_SIZE = LanguageModelConfig.vocab_size
# Stored bytes of documents that go into one JSON array.
_ARRAY_BYTES = 32 << 20


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _joined(c: str | Column, sep: str = " ") -> Column:
    return F.array_join(c, sep)


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals: summation order changes the last bits."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- flagship ---------------------------------------------------------------------------------


@query
def split_label_counts(spark, sf_dir):
    """Documents and labels per split, from raw documents through split, filter and remapping."""
    rows = V.prepared(spark, sf_dir).select("split", F.explode("labels").alias("label"))
    return rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_docs"))


# --- sources and sinks ------------------------------------------------------------------------


@query
def scan_documents_query(spark, sf_dir):
    path = scratch_path(spark, "documents-json")
    V.raw_documents(spark, sf_dir).orderBy("doc_id").select("content", "date", "buckets").write.json(path)
    docs = scan_documents(spark, path, format="jsonl")
    return docs.select("row_idx", "content", "date", _joined("buckets", "|").alias("buckets"))


@query
def scan_json_array_query(spark, sf_dir):
    """Documents written as JSON arrays and read back in byte ranges."""
    path = scratch_path(spark, "documents-array")
    raw = V.raw_documents(spark, sf_dir).select("doc_id", "content", "date", "buckets")
    # A file is written by one task, so their number follows the table.
    files = max(4, -(-stored_bytes(spark, f"{sf_dir}/documents.parquet") // _ARRAY_BYTES))
    write_json_arrays(raw, path, "doc_id", files=files)
    return scan_documents(spark, path).select("row_idx", "content", "date", _joined("buckets", "|").alias("buckets"))


@query
def scan_label_map_query(spark, sf_dir):
    """The map read from a JSON object, with the number of documents using each raw label."""
    path = scratch_path(spark, "label-map")
    entries = spark.createDataFrame(list(V.LABEL_MAP.items()), "raw string, canon string")
    as_object = F.to_json(F.map_from_entries(F.collect_list(F.struct("raw", "canon"))))
    entries.agg(as_object.alias("value")).write.text(path)
    label_map = scan_label_map(spark, path)
    used = labels.label_frequency(V.raw_documents(spark, sf_dir), "buckets")
    counts = used.withColumnRenamed("label", "raw")
    return label_map.join(counts, "raw", "left").select("raw", "canon", F.coalesce("n_uses", F.lit(0)).alias("n_uses"))


def _read_pair(spark, path, splits=_SPLITS):
    """The written pair read back, paired by position inside each split."""
    frames = []
    for name in splits:
        texts = scan_tsv(spark, f"{path}/in/split={name}")
        expected = scan_tsv(spark, f"{path}/expected/split={name}", ("labels",))
        frames.append(texts.join(expected, "row_idx", "full_outer").withColumn("split", F.lit(name)))
    return profile.union_splits(*frames)


@query
def scan_tsv_query(spark, sf_dir):
    path = scratch_path(spark, "tsv")
    write_tsv_pair(V.indexed_texts(spark, sf_dir), path)
    frames = [scan_tsv(spark, f"{path}/in/split={s}").withColumn("split", F.lit(s)) for s in _SPLITS]
    return profile.union_splits(*frames)


@query
def write_tsv_pair_query(spark, sf_dir):
    path = scratch_path(spark, "tsv-pair")
    write_tsv_pair(V.indexed_texts(spark, sf_dir), path)
    return _read_pair(spark, path)


@query
def write_gzip_query(spark, sf_dir):
    path = scratch_path(spark, "tsv-gzip")
    write_gzip(V.indexed_texts(spark, sf_dir), path)
    return _read_pair(spark, path)


def _corpus_lines(spark, sf_dir, name):
    path = scratch_path(spark, name)
    rows = V.indexed_texts(spark, sf_dir).select("split", "row_idx", X.clean_text(F.col("text")).alias("lm_text"))
    write_text_lines(rows, "lm_text", path)
    return path


@query
def scan_text_lines_query(spark, sf_dir):
    path = _corpus_lines(spark, sf_dir, "lines")
    return scan_text_lines(spark, {s: f"{path}/split={s}" for s in _SPLITS})


@query
def write_text_lines_query(spark, sf_dir):
    """Predicted label lines as written for the held-out splits."""
    path = scratch_path(spark, "predictions")
    rows = V.label_vectors(spark, sf_dir)
    decoded = rows.withColumn("line", _joined(L.decode_labels(F.col("pred"), V.VOCABULARY)))
    write_text_lines(decoded.where("split in ('dev', 'test')"), "line", path)
    return scan_text_lines(spark, {s: f"{path}/split={s}" for s in ("dev", "test")})


@query
def write_metrics_json_query(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    scores = metrics.evaluate_multilabel(V.label_vectors(spark, sf_dir))
    write_metrics_json(_rounded(scores), path)
    return spark.read.schema(scores.schema).json(path)


@query
def publish_layout_query(spark, sf_dir):
    """The public layout read back: rows with their labels, withheld for the test folder."""
    path = scratch_path(spark, "published")
    publish_layout(V.indexed_texts(spark, sf_dir), path, public=True)
    return scan_published(spark, path)


@query
def scan_pairs(spark, sf_dir):
    """The pairs of the private layout, put into one file per split and read as stage input."""
    path, files = scratch_path(spark, "private"), scratch_path(spark, "files")
    publish_layout(V.indexed_texts(spark, sf_dir), path, public=False)
    single_files(spark, path, files)
    return scan_pairs_of(spark, files).withColumn("labels", _joined("labels"))


# --- splitting --------------------------------------------------------------------------------


@query
def global_row_index_query(spark, sf_dir):
    """Position of each document in (date, doc_id) order."""
    return global_row_index(V.raw_texts(spark, sf_dir).select("date", "doc_id"), ["date", "doc_id"])


@query
def block_split_query(spark, sf_dir):
    return split.block_split(V.raw_texts(spark, sf_dir).select("doc_id"), "doc_id")


@query
def split_sizes_query(spark, sf_dir):
    return split.split_sizes(split.block_split(V.raw_texts(spark, sf_dir).select("doc_id"), "doc_id"))


@query
def size_capped_subset_query(spark, sf_dir):
    """The 100-document training subset."""
    train = V.prepared(spark, sf_dir).where("split = 'train'")
    return split.size_capped_subset(train, 100, "doc_id").select("doc_id", "text", _joined("labels").alias("labels"))


# --- projections, filters, validation ---------------------------------------------------------


@query
def project_text(spark, sf_dir):
    return V.texts(spark, sf_dir).select(F.col("text").cast("string").alias("text"))


@query
def drop_text(spark, sf_dir):
    encoded = V.texts(spark, sf_dir).withColumn("n_tokens", F.size(X.tokenize_words(F.col("text"))))
    return encoded.drop("text")


@query
def assert_row_parity(spark, sf_dir):
    rows = V.labelled(spark, sf_dir)
    raw = global_row_index(V.raw_texts(spark, sf_dir).select("doc_id"), "doc_id")
    return validate.row_parity(split.split_by_row_index(raw), rows)


@query
def validate_publish(spark, sf_dir):
    """Counts over a view with one kind of fault planted in every seventh, eleventh, ... row."""
    view = publish_view(V.indexed_texts(spark, sf_dir))
    row = F.col("row_idx")
    faulty = view.withColumns(
        {
            "split": F.when(row % 7 == 0, F.lit("holdout")).otherwise(F.col("split")),
            "text": F.when(row % 11 == 0, F.lit(None)).when(row % 13 == 0, F.lit("a\tb")).otherwise(F.col("text")),
            "date": F.when(row % 17 == 0, F.lit("a\nb")).otherwise(F.col("date")),
            "labels": F.when(row % 19 == 0, F.lit("law unheard_of"))
            .when(row % 23 == 0, F.lit(None))
            .when(row % 29 == 0, F.lit("law\r"))
            .otherwise(F.col("labels")),
        }
    )
    return validate.validate_publish(faulty, V.VOCABULARY)


@query
def newline_to_space(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", X.newline_to_space(F.col("text")).alias("text"))


@query
def min_content_filter(spark, sf_dir):
    return V.raw_texts(spark, sf_dir).where(X.has_min_content(F.col("content"))).select("doc_id", "content")


@query
def strip_cr(spark, sf_dir):
    """Line ends of every text turned into CR LF, then stripped of the CR."""
    texts = V.masked_texts(spark, sf_dir)
    return texts.select("origin", "id", X.strip_cr(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("text"))


# --- labels -----------------------------------------------------------------------------------


@query
def remap_labels(spark, sf_dir):
    raw = V.raw_documents(spark, sf_dir).select("doc_id", "buckets")
    return labels.remap_labels(raw, V.LABEL_MAP).select("doc_id", _joined("labels").alias("labels"))


@query
def remap_labels_by_join(spark, sf_dir):
    """The same through the join used for maps too large for a literal."""
    raw = V.raw_documents(spark, sf_dir).select("doc_id", "buckets")
    entries = spark.createDataFrame(list(V.LABEL_MAP.items()), "raw string, canon string")
    folded = labels.folded_label_map(entries)
    out = labels.remap_labels_by_join(raw, folded, "buckets", "labels", "doc_id")
    return out.select("doc_id", _joined("labels").alias("labels"))


@query
def unmapped_labels(spark, sf_dir):
    """Labels a map without the source names would lack."""
    partial = [(r, c) for r, c in V.LABEL_MAP.items() if not r.startswith("src")]
    label_map = spark.createDataFrame(partial, "raw string, canon string")
    return labels.unmapped_labels(V.raw_documents(spark, sf_dir), label_map)


@query
def align_text_labels(spark, sf_dir):
    texts = V.texts(spark, sf_dir).select("split", "doc_id", "text")
    marks = V.labelled(spark, sf_dir).select("split", "doc_id", _joined("labels").alias("labels"))
    return labels.align(texts, marks, ("split", "doc_id"))


@query
def encode_label_ids(spark, sf_dir):
    ids = L.encode_label_ids(F.col("labels"), V.VOCABULARY)
    return V.labelled(spark, sf_dir).select("row_idx", _joined(ids.cast("array<string>")).alias("label_ids"))


@query
def union_splits(spark, sf_dir):
    rows = V.prepared(spark, sf_dir).select("split", "doc_id", "text", _joined("labels").alias("labels"))
    return profile.union_splits(*[rows.where(F.col("split") == s).drop("split") for s in ("dev", "test", "train")])


@query
def fold_label(spark, sf_dir):
    raw = V.raw_documents(spark, sf_dir).select("doc_id", F.posexplode("buckets").alias("pos", "raw"))
    return raw.select("doc_id", "pos", "raw", L.fold_label(F.col("raw")).alias("label"))


@query
def split_labels(spark, sf_dir):
    lines = V.labelled(spark, sf_dir).select("row_idx", L.join_labels(F.col("labels")).alias("line"))
    parts = L.split_labels(F.col("line"))
    return lines.select("row_idx", F.size(parts).alias("n_labels"), F.explode_outer(parts).alias("label"))


@query
def join_labels(spark, sf_dir):
    return V.labelled(spark, sf_dir).select("row_idx", L.join_labels(F.col("labels")).alias("line"))


@query
def dedupe_labels(spark, sf_dir):
    """Canonical labels kept as a multiset, then made a set."""
    raw = V.raw_documents(spark, sf_dir)
    table = {k: v.lower() for k, v in V.LABEL_MAP.items()}
    canon = F.transform("buckets", lambda b: F.element_at(L.map_literal(table), L.fold_label(b)))
    unique = L.dedupe_labels(canon)
    return raw.select(
        "doc_id", F.size(canon).alias("n_before"), F.size(unique).alias("n_after"), _joined(unique).alias("labels")
    )


@query
def multi_hot(spark, sf_dir):
    hot = L.multi_hot(F.col("labels"), V.VOCABULARY)
    return V.labelled(spark, sf_dir).select("row_idx", _joined(hot.cast("array<string>"), "").alias("hot"))


@query
def decode_labels(spark, sf_dir):
    decoded = L.decode_labels(F.col("pred"), V.VOCABULARY)
    return V.label_vectors(spark, sf_dir).select("row_idx", _joined(decoded).alias("labels"))


@query
def threshold_scores(spark, sf_dir):
    hot = L.threshold_scores(F.col("scores"), 0.5)
    return V.label_vectors(spark, sf_dir).select("row_idx", _joined(hot.cast("array<string>"), "").alias("hot"))


@query
def distinct_labels(spark, sf_dir):
    return labels.distinct_labels(V.labelled(spark, sf_dir))


@query
def label_frequency(spark, sf_dir):
    return labels.label_frequency(V.labelled(spark, sf_dir))


@query
def label_index(spark, sf_dir):
    return labels.label_index(labels.distinct_labels(V.labelled(spark, sf_dir)))


# --- tokens and profile -----------------------------------------------------------------------


def _tokens(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", X.tokenize_words(F.col("text")).alias("tokens"))


@query
def tokenize_words(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", F.size("tokens").alias("n_tokens"), _joined("tokens").alias("tokens"))


@query
def is_numeric_token(spark, sf_dir):
    found = F.filter("tokens", X.is_numeric_token)
    return _tokens(spark, sf_dir).select("doc_id", F.size(found).alias("n_numeric"), _joined(found).alias("tokens"))


@query
def is_alnum_token(spark, sf_dir):
    found = F.filter("tokens", X.is_alnum_token)
    return _tokens(spark, sf_dir).select("doc_id", F.size(found).alias("n_alnum"), _joined(found).alias("tokens"))


@query
def stopword_filter(spark, sf_dir):
    kept = X.stopword_filter(F.col("tokens"))
    return _tokens(spark, sf_dir).select("doc_id", F.size(kept).alias("n_kept"), _joined(kept).alias("tokens"))


@query
def corpus_count(spark, sf_dir):
    return profile.corpus_count(V.texts(spark, sf_dir))


@query
def token_length_hist(spark, sf_dir):
    return profile.token_length_hist(V.texts(spark, sf_dir))


@query
def token_length_hist_nonnumeric(spark, sf_dir):
    return profile.token_length_hist_nonnumeric(V.texts(spark, sf_dir))


@query
def length_profile(spark, sf_dir):
    return profile.length_profile(V.texts(spark, sf_dir))


@query
def word_frequency(spark, sf_dir):
    return profile.word_frequency(V.texts(spark, sf_dir))


@query
def bigram_frequency(spark, sf_dir):
    return profile.bigram_frequency(V.texts(spark, sf_dir))


@query
def top_common_lengths(spark, sf_dir):
    return profile.top_common_lengths(profile.token_length_hist(V.texts(spark, sf_dir)))


@query
def top_longest_lengths(spark, sf_dir):
    return profile.top_longest_lengths(profile.token_length_hist(V.texts(spark, sf_dir)))


@query
def top_longest_nonnumeric(spark, sf_dir):
    return profile.top_longest_lengths(profile.token_length_hist_nonnumeric(V.texts(spark, sf_dir)))


@query
def top_words(spark, sf_dir):
    return profile.frequent_words(V.texts(spark, sf_dir))


@query
def top_bigrams(spark, sf_dir):
    return profile.frequent_bigrams(V.texts(spark, sf_dir))


@query
def preview(spark, sf_dir):
    rows = V.texts(spark, sf_dir).select("doc_id", "split", "date", "text")
    return profile.preview(rows, "doc_id")


# --- cleaner ----------------------------------------------------------------------------------


def _cleaned(spark, sf_dir, step):
    return V.masked_texts(spark, sf_dir).select("origin", "id", step(F.col("text")).alias("text"))


@query
def fix_unicode(spark, sf_dir):
    return _cleaned(spark, sf_dir, X.fix_unicode)


@query
def no_line_breaks(spark, sf_dir):
    return _cleaned(spark, sf_dir, X.no_line_breaks)


@query
def mask_urls(spark, sf_dir):
    return _cleaned(spark, sf_dir, X.mask_urls)


@query
def mask_emails(spark, sf_dir):
    return _cleaned(spark, sf_dir, X.mask_emails)


@query
def mask_dates(spark, sf_dir):
    return _cleaned(spark, sf_dir, X.mask_dates)


@query
def mask_numbers(spark, sf_dir):
    return _cleaned(spark, sf_dir, X.mask_numbers)


@query
def mask_digits(spark, sf_dir):
    return _cleaned(spark, sf_dir, X.mask_digits)


@query
def clean_text(spark, sf_dir):
    return _cleaned(spark, sf_dir, X.clean_text)


@query
def special_token_census(spark, sf_dir):
    return profile.special_token_census(V.corpus(spark, sf_dir), MASK_TOKENS)


# --- encoding ---------------------------------------------------------------------------------


def _fixed_ids(spark, sf_dir):
    wrapped = E.add_boundaries(F.col("ids"), SPECIAL_TOKENS.index("<s>"), SPECIAL_TOKENS.index("</s>"), 512)
    return V.token_ids(spark, sf_dir).select("doc_id", wrapped.alias("ids"))


@query
def truncate_pad(spark, sf_dir):
    ids = E.pad_ids(F.col("ids"), 512, SPECIAL_TOKENS.index("<pad>"))
    mask = E.attention_mask(F.col("ids"), 512)
    return _fixed_ids(spark, sf_dir).select(
        "doc_id",
        _joined(ids.cast("array<string>")).alias("input_ids"),
        _joined(mask.cast("array<string>"), "").alias("attention_mask"),
    )


@query
def mlm_mask(spark, sf_dir):
    ids = E.pad_ids(F.col("ids"), 512, SPECIAL_TOKENS.index("<pad>"))
    masked = E.mlm_mask(
        F.col("ids"),
        F.col("doc_id"),
        mask_id=SPECIAL_TOKENS.index("<mask>"),
        vocab_size=V.VOCAB_SIZE,
        special_count=V.N_SPECIAL,
    )
    rows = _fixed_ids(spark, sf_dir).select("doc_id", ids.alias("ids")).select("doc_id", masked.alias("m"))
    return rows.select(
        "doc_id",
        _joined(F.col("m.input_id").cast("array<string>")).alias("input_ids"),
        _joined(F.col("m.label").cast("array<string>")).alias("labels"),
    )


def _train_words(spark, sf_dir):
    return bpe.bpe_word_counts(V.corpus(spark, sf_dir).where("split = 'train'"))


@query
def bpe_word_counts(spark, sf_dir):
    return _train_words(spark, sf_dir)


@query
def bpe_pair_counts(spark, sf_dir):
    """The first round: pairs of bytes."""
    pairs = bpe.bpe_pair_counts(bpe.symbol_table(_train_words(spark, sf_dir), V.N_SPECIAL))
    left, right = (bpe.symbol_id_of(F.substring("pair", i, 1)) for i in (1, 2))
    return pairs.select(left.alias("left_id"), right.alias("right_id"), "n_uses")


_MODELS: dict[tuple[str, str], bpe.BytePairModel] = {}


def _vocabulary(spark, sf_dir):
    """The vocabulary learned on train, once per application and tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS[key] = bpe.bpe_learn(_train_words(spark, sf_dir), _BPE_SIZE)
    return _MODELS[key]


@query
def bpe_learn(spark, sf_dir):
    return _vocabulary(spark, sf_dir).merge_table(spark)


@query
def bpe_encode(spark, sf_dir):
    """All documents under the vocabulary learned on train: the ids, counted, and decoded again."""
    rows = V.corpus(spark, sf_dir)
    model = _vocabulary(spark, sf_dir)
    encoded = bpe.bpe_encode(rows.select("doc_id", "split", "lm_text"), model)
    whole = F.size("ids") >= F.size(bpe.model_words(F.col("lm_text"), model.special_tokens))
    return encoded.select("doc_id", "split", bpe.bpe_decode(F.col("ids"), model).alias("text"), whole.alias("an_id_a_word"))


@query
def lm_examples(spark, sf_dir):
    """Masked training rows on byte-pair ids: lengths, and whether every label is unset or the id below the mask."""
    model = _vocabulary(spark, sf_dir)
    rows = stages.lm_examples(V.corpus(spark, sf_dir), model, "doc_id")
    plain = bpe.encode_examples(V.corpus(spark, sf_dir).select("doc_id", "lm_text"), model)
    ids = plain.select("doc_id", F.col("input_ids").alias("plain_ids"))
    cells = F.arrays_zip("labels", "input_ids", "plain_ids", "attention_mask")
    rule = F.forall(
        cells,
        lambda c: F.when(c["labels"] == -100, c["input_ids"] == c["plain_ids"]).otherwise(
            (c["labels"] == c["plain_ids"]) & (c["attention_mask"] == 1)
        ),
    )
    return rows.join(ids, "doc_id").select(
        "doc_id",
        "split",
        *[F.size(c).alias(f"n_{c}") for c in ("input_ids", "attention_mask", "labels")],
        (F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x) >= 2).alias("has_boundaries"),
        rule.alias("labels_follow_the_rule"),
    )


@query
def classifier_examples(spark, sf_dir):
    """Encoded texts with their label vectors: lengths, and the vector over the labels in use."""
    rows = stages.classifier_examples(V.prepared(spark, sf_dir), _vocabulary(spark, sf_dir), "doc_id")
    return rows.select(
        "doc_id",
        "split",
        *[F.size(c).alias(f"n_{c}") for c in ("input_ids", "attention_mask")],
        _joined(F.col("labels").cast("array<string>"), "").alias("labels"),
    )


@query
def ngram_lm_perplexity(spark, sf_dir):
    return _rounded(stages.lm_score(V.corpus(spark, sf_dir)))


@query
def kneser_ney_perplexity(spark, sf_dir):
    """The same test split under a model with back-off to continuation counts."""
    return _rounded(stages.lm_score(V.corpus(spark, sf_dir), smoothing="kneser_ney"))


# --- metrics ----------------------------------------------------------------------------------


@query
def label_confusion(spark, sf_dir):
    return metrics.label_confusion(V.label_vectors(spark, sf_dir))


@query
def weighted_prf(spark, sf_dir):
    return _rounded(metrics.weighted_prf(metrics.label_confusion(V.label_vectors(spark, sf_dir))))


@query
def subset_accuracy(spark, sf_dir):
    return _rounded(metrics.subset_accuracy(V.label_vectors(spark, sf_dir)))


@query
def multilabel_loss(spark, sf_dir):
    return _rounded(metrics.multilabel_loss(V.label_vectors(spark, sf_dir)))


def _label_sets(spark, sf_dir):
    out = L.decode_labels(F.col("pred"), V.VOCABULARY)
    return V.label_vectors(spark, sf_dir).select(F.col("labels").alias("expected"), out.alias("out"))


@query
def micro_fbeta(spark, sf_dir):
    return _rounded(metrics.micro_fbeta(_label_sets(spark, sf_dir)))


@query
def line_accuracy(spark, sf_dir):
    return _rounded(metrics.line_accuracy(_label_sets(spark, sf_dir)))


@query
def evaluate_multilabel(spark, sf_dir):
    return _rounded(metrics.evaluate_multilabel(V.label_vectors(spark, sf_dir)))


@query
def perplexity(spark, sf_dir):
    """From the mean loss of each document."""
    cells = F.zip_with("scores", "truth", metrics.binary_cross_entropy)
    loss = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / F.size(cells)
    return _rounded(metrics.perplexity(V.label_vectors(spark, sf_dir).select(loss.alias("loss"))))


# --- models -----------------------------------------------------------------------------------


@query
def train_multilabel(spark, sf_dir):
    """Scores on the test split of a baseline fitted on train."""
    _, predictions = stages.classify(V.prepared(spark, sf_dir), "logistic_regression", parallelism=8)
    return _rounded(stages.score_predictions(predictions))


@query
def train_multilabel_joint(spark, sf_dir):
    """The same scores with all labels in one fit."""
    _, predictions = stages.classify(V.prepared(spark, sf_dir), models.JOINT)
    return _rounded(stages.score_predictions(predictions))


@query
def predict_multilabel(spark, sf_dir):
    """Labels for the held-out texts of the benchmark table."""
    prepared = V.prepared(spark, sf_dir).where("split = 'train'")
    model = models.train_multilabel(prepared, V.VOCABULARY, "naive_bayes", parallelism=8)
    texts = V.table(spark, sf_dir, "benchmark").select("item_id", "text")
    predicted = models.predict_multilabel(texts, model)
    return predicted.select("item_id", _joined("pred_labels").alias("labels"))


# Query names are operator names; the suffix only keeps some of them apart from the imports above.
QUERIES = {name.removesuffix("_query"): function for name, function in QUERIES.items()}
