"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Of two words the shorter (of equal lengths either) contributes two disjoint chunks, its halves, with their
places; the other contributes positional grams. One edit touches one half only, so the other half is found
whole in the longer word, at its own place or shifted by one. A gram can only join a chunk of its length
within one place of its own, so only those grams are made: four rows a word in all. Candidates meet by an equal
join on length, place and chunk and are verified by edit distance.

A chunk that many words share would compare all of them. There the halves are divided again: the edit lies in
one half of the touched half, the rest of the word is an exact key together with the chunk. So a large group
falls apart by ever longer keys, until the touched part is a single code point and the group is bounded by the
alphabet. Nothing is capped, and a key joins ``CHUNKS`` chunks at most with its grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import lower_ascii
from docloom.session import materialize

MIN_LENGTH = 5
MIN_COUNT = 3
# One occurrence in so many loses a code point.
NOISE = 97
# A form is so many times as frequent as its variant.
RATIO = 2
# A key with more chunks, or with more grams, is divided again.
CHUNKS = 32
GRAMS = 2_048
_SALTS = 16
_RUN = r"[A-Za-zÀ-ÿ]+"


def noisy_words(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """``word``, one row per run of letters, of which one in ``noise`` has lost a code point."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_RUN), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", lower_ascii(F.col("run")).alias("run"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    hashed = runs.select("run", F.crc32(F.encode(name, "UTF-8")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, noise: int = NOISE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough."""
    counted = noisy_words(docs, noise).where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def _key(word: Column) -> Column:
    """What must be equal: length and touched part of the chunk word, and the chunks around that part."""
    around = [F.substring(word, F.lit(1), F.col("start")), F.substring(word, F.col("stop") + F.col("shift") + 1, F.char_length(word))]
    return F.xxhash64("size", "start", "stop", *around)


def _divided(rows: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Each row twice: with the first and with the second half of its touched part."""
    middle = F.floor((start + stop) / 2).cast("int")
    halves = F.array(F.struct(start.alias("start"), middle.alias("stop")), F.struct(middle.alias("start"), stop.alias("stop")))
    split = rows.withColumn("_half", F.explode(halves)).drop("start", "stop").select("*", "_half.start", "_half.stop").drop("_half")
    return split.withColumn("key", _key(F.col("word")))


def near_pairs(words: DataFrame, chunks: int = CHUNKS, grams: int = GRAMS) -> DataFrame:
    """``(a, a_n, b, b_n)``: every pair of distinct words of ``words (word, n)`` exactly one edit apart, once."""
    own = words.select("word", "n", F.char_length("word").alias("size"), F.lit(0).alias("shift"))
    longer = own.select("word", "n", (F.col("size") - 1).alias("size"), F.lit(1).alias("shift")).where("size > 0")
    whole = own.unionByName(longer)
    # A word of one code point has one part only, and so does a part that cannot be divided.
    rows = _divided(whole, F.lit(0), F.col("size")).where("start < stop")
    found = None
    while True:
        rows = materialize(rows, "chunk-rows")
        keys = rows.groupBy("key").agg(
            F.count_if(F.col("shift") == 0).alias("n_chunks"),
            F.count_if(F.col("shift") == 1).alias("n_grams"),
            F.max(F.col("stop") - F.col("start")).alias("width"),
        )
        crowded = (F.col("width") > 1) & (F.col("n_chunks") > 0) & ((F.col("n_chunks") > chunks) | (F.col("n_grams") > grams))
        # Rows of a crowded key are many: salts spread them.
        salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
        dense = materialize(keys.where(crowded).select("key", salts.alias("salt")), "crowded-keys")
        more = bool(dense.limit(1).count())
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(_SALTS)).cast("int"))
        calm = salted.join(dense, ["key", "salt"], "left_anti") if more else rows
        chunk = calm.where("shift = 0").select(F.col("word").alias("a"), F.col("n").alias("a_n"), "key")
        gram = calm.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("key").alias("b_key"), "shift")
        ordered = (F.col("shift") == 1) | (F.col("a") < F.col("b"))
        near = F.levenshtein("a", "b", 1) == 1
        met = chunk.join(gram, (F.col("key") == F.col("b_key")) & ordered & near).select("a", "a_n", "b", "b_n")
        met = materialize(met, "near-words")
        found = met if found is None else found.unionByName(met)
        if not more:
            # An edit at the border of two parts leaves both chunks whole: the pair is met twice.
            return found.distinct()
        rows = _divided(salted.join(dense, ["key", "salt"], "left_semi").drop("key", "salt"), F.col("start"), F.col("stop"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: from each word of ``forms (word, form)``, one row each, along the forms to the last.

    Pointers double every round. Counts at least double along a chain, so it is short.
    """
    links = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "word-roots")
    while True:
        above = links.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        stepped = links.join(above, F.col("root") == F.col("_word")).select("word", F.col("_root").alias("root"), (F.col("root") != F.col("_root")).alias("moved"))
        stepped = materialize(stepped, "word-roots")
        links = stepped.select("word", "root")
        if not stepped.where("moved").limit(1).count():
            return links


def spelling_forms(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every row of ``words (word, n)``, whose words are distinct.

    A word's form is its near word of largest n, of equal ones the smallest in code-point order, if that n is
    at least ``ratio`` times the word's; the root is the last of the chain of forms.
    """
    pairs = materialize(near_pairs(words), "near-pairs")
    there = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("of")).alias("near"))
    back = pairs.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("of")).alias("near"))
    best = there.unionByName(back).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    chosen = -F.col("near.less") >= F.lit(ratio) * F.col("n")
    told = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("near.of")).alias("form"),
        F.when(chosen, -F.col("near.less")).alias("form_n"),
    )
    told = materialize(told, "word-forms")
    return told.join(roots(told), "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, noise: int = NOISE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: float = RATIO) -> DataFrame:
    """Words of ``docs (doc_id, text)`` with their forms: see ``spelling_forms``.

    Null and empty texts have no words; a null doc_id counts as the empty string in the hash. Very long texts
    and words count whole, repeated rows count each, ties go by code points, other columns are ignored, and an
    empty table gives no rows.
    """
    words = materialize(vocabulary(docs.select("doc_id", "text"), noise, min_length, min_count), "vocabulary")
    return spelling_forms(words, ratio)
