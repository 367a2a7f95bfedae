"""Document fingerprints by winnowing, in DataFrame operations only.

Every run of GRAM characters is hashed, and of each WINDOW neighbouring hashes the smallest is kept, the
rightmost of equals, with its position. Two texts that share GRAM + WINDOW - 1 characters share a hash.

A text is cut into segments that overlap by one window, so the arrays held at a time are small however long
the text is. A hash and its place are one number, which makes the smallest of a window a plain minimum; minima
of 2, 4, 8, ... neighbours follow from each other. What an edited text keeps of its sources is taken from
their fingerprints, and only the windows across the seam are hashed anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import stable_sample

GRAM = 16
# A power of two.
WINDOW = 64
SEGMENT = 4096
# Low bits of a packed number: the place inside a segment, counted from the end so that the rightmost is least.
_PLACE_BITS = 13
_LAST_PLACE = (1 << _PLACE_BITS) - 1
_REACH = GRAM + WINDOW - 1
# Buckets of neighbouring documents: characters in one, how many at most, and sampled keys for each bound.
_BUCKET_CHARS = 4_000_000
_MAX_BUCKETS = 50_000
_SAMPLE_PER_BUCKET = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: inside array functions nothing else shares it."""
    return F.get(F.transform(F.array(value), body), 0)


def _packed(grams: Column) -> Column:
    """Hash in the high bits, place in the low bits."""
    return F.transform(
        grams,
        lambda g, i: F.xxhash64(g).bitwiseAND(F.lit(~_LAST_PLACE)).bitwiseOR((F.lit(_LAST_PLACE) - i).cast("long")),
    )


def _minima(packed: Column) -> Column:
    """The smallest number of every window, in order of the windows."""

    def with_later(by: int) -> Callable[[Column], Column]:
        def least(p: Column) -> Column:
            later = F.slice(p, by + 1, F.greatest(F.size(p) - by, F.lit(0)))
            return F.zip_with(p, later, lambda a, b: F.least(a, b))

        return least

    width = 1
    while width < WINDOW:
        packed = let(packed, with_later(width))
        width *= 2
    return packed


def _grams(text: Column) -> Column:
    """Every run of GRAM characters: a look-ahead takes the run, the dot after it moves on by one character."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1))


def _segment_picks(part: Column, offset: Column) -> Column:
    """Picks of the windows that lie in ``part``, as ``(pos, hash)`` with ``offset`` added."""
    minima = let(_minima(_packed(_grams(part))), lambda m: F.slice(m, 1, F.greatest(F.size(m) - (WINDOW - 1), F.lit(0))))
    return let(F.array_distinct(minima), lambda least: let(offset, lambda by: _unpacked(least, by)))


def _unpacked(packed: Column, offset: Column) -> Column:
    return F.transform(
        packed,
        lambda x: F.struct(
            (offset + (F.lit(_LAST_PLACE) - x.bitwiseAND(F.lit(_LAST_PLACE)))).cast("int").alias("pos"),
            F.shiftright(x, _PLACE_BITS).alias("hash"),
        ),
    )


def _once(own: Column) -> Column:
    """Picks in order of position, where equal ones are neighbours, each once."""
    return let(own, lambda a: F.filter(a, lambda x, i: (i == 0) | (x["pos"] != F.get(a, i - 1)["pos"])))


def _short_picks(text: Column) -> Column:
    """The one pick of a text that holds no whole window: the least hash, or the text's own if it holds no gram."""
    own = F.xxhash64(text).bitwiseAND(F.lit(~_LAST_PLACE)).bitwiseOR(F.lit(_LAST_PLACE).cast("long"))
    return _unpacked(F.array(F.coalesce(F.array_min(_packed(_grams(text))), own)), F.lit(0))


def picks(text: Column) -> Column:
    """The fingerprint as an array of ``(pos, hash)`` in order of position; ``pos`` counts code points from 0."""
    segments = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))

    def of(s: Column, i: Column) -> Column:
        beyond = F.substring(F.coalesce(F.get(s, i + 1), F.lit("")), 1, _REACH - 1)
        return _segment_picks(F.concat(F.get(s, i), beyond), i * SEGMENT)

    long = let(segments, lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda i: of(s, i))))
    return F.when(F.char_length(text) >= _REACH, _once(long)).otherwise(_short_picks(text))


def _until(own: Column, length: Column) -> Column:
    """The picks of the first ``length`` characters of a text with the picks ``own``.

    A pick is first made by the window in which it becomes the least: as it enters if it is at most the pick
    before it, else once that one has left. It belongs to the shorter text if that window still lies in it.
    """
    last_window = length - _REACH

    def first_window(x: Column, i: Column) -> Column:
        before = F.get(own, i - 1)
        entered = F.greatest(x["pos"] - (WINDOW - 1), F.lit(0))
        return F.when(i == 0, F.lit(0)).when(x["hash"] <= before["hash"], entered).otherwise(before["pos"] + 1)

    return F.filter(own, lambda x, i: first_window(x, i) <= last_window)


def _pick(pos: Column, hash_: Column) -> Column:
    return F.struct(pos.alias("pos"), hash_.alias("hash"))


def _moved(own: Column, by: Column) -> Column:
    return F.transform(own, lambda x: F.struct((x["pos"] + by).cast("int").alias("pos"), x["hash"].alias("hash")))


def hashes(own: Column) -> Column:
    return F.array_distinct(F.transform(own, lambda x: x["hash"]))


def as_string(own: Column) -> Column:
    """``hash:position`` of every pick, the hash in hexadecimal."""
    mask = F.lit((1 << (64 - _PLACE_BITS)) - 1)
    return F.array_join(
        F.transform(own, lambda x: F.concat_ws(":", F.lower(F.hex(x["hash"].bitwiseAND(mask))), x["pos"].cast("string"))), ","
    )


def likeness(left: Column, right: Column) -> Column:
    """Shared hashes among all hashes of two fingerprints, 0 to 1."""
    shared = F.size(F.array_intersect(left, right)).cast("double")
    return shared / (F.size(left) + F.size(right) - shared)


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` do not exceed ``value``, by a search in two steps."""

    def constant(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= value))

    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    before = F.greatest(upto(constant(bounds[::step])) - 1, F.lit(0)) * step
    return before + upto(F.slice(constant(bounds), before + 1, F.lit(step)))


def _bounds(keys: DataFrame, n_buckets: int) -> list[int]:
    """Existing keys that divide all keys into about ``n_buckets`` runs of like length."""
    sample = stable_sample(keys, _SAMPLE_PER_BUCKET * n_buckets, "falling").where("falling is not null").collect()
    return sorted({r["falling"] for r in sorted(sample)[:: max(1, len(sample) // n_buckets)]})


def _with_next(docs: DataFrame) -> DataFrame:
    """``docs (absent, falling, kh, body, n_chars, hashes, places)`` with ``next_*`` columns of the next document.

    Runs of the order become buckets; a bucket's first documents are copied behind the one before it, and the
    very first behind the last bucket, so that each document finds its next one in its own bucket. Texts are
    shuffled once, to their bucket.
    """
    order = ["absent", "falling", "kh"]
    keys = docs.select(*order, "n_chars")
    totals = keys.agg(F.sum("n_chars").alias("chars"), F.min(F.struct(*order)).alias("first")).first()
    if totals["first"] is None:
        totals = {"chars": 0, "first": {"absent": False, "falling": 0, "kh": 0}}
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = min(_MAX_BUCKETS, max(2 * partitions, totals["chars"] // _BUCKET_CHARS))
    bounds = _bounds(keys.select("falling"), n_buckets)
    last = len(bounds)
    bucket = F.when(F.col("absent"), F.lit(last)).otherwise(_bucket(F.col("falling"), bounds))
    heads = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    leads = (F.col("bucket") > 0) & F.coalesce(F.col("falling") == F.get(heads, F.col("bucket") - 1), F.lit(False))
    first = F.lit(True)
    for name in order:
        first = first & F.col(name).eqNullSafe(F.lit(totals["first"][name]))

    def place(at: Column, copy: bool) -> Column:
        return F.struct(at.cast("int").alias("bucket"), F.lit(copy).alias("copy"))

    places = F.array_compact(
        F.array(
            place(F.col("bucket"), False),
            F.when(leads, place(F.col("bucket") - 1, True)),
            F.when(first, place(F.lit(last), True)),
        )
    )
    wide = ["body", "n_chars", "hashes", "places"]
    dealt = docs.withColumn("bucket", bucket).withColumn("at", F.explode(places)).select(*order, *wide, "at.bucket", "at.copy")
    same = Window.partitionBy("bucket", "copy", *order)
    times = F.count(F.lit(1)).over(same)
    nth = F.row_number().over(same.orderBy("bucket"))
    once = dealt.repartition("bucket").withColumn("times", times).withColumn("nth", nth).where("nth = 1")
    in_order = Window.partitionBy("bucket").orderBy("copy", *order)
    following = once.select("*", *[F.lead(c).over(in_order).alias(f"next_{c}") for c in wide])
    return following.where("not copy").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, picks, fingerprint)`` of whole texts; a null text counts as empty."""
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    found = given.select("doc_id", F.char_length("body").cast("long").alias("n_chars"), picks(F.col("body")).alias("picks"))
    return found.withColumn("fingerprint", as_string(F.col("picks")))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document by descending doc_id; after the last comes the first. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty; an empty text has the fingerprint of its one empty gram. A null doc_id comes after
    all others. Rows of one doc_id follow each other by a hash of their text; rows that repeat doc_id and text
    are one document and get the same result each. A single document is its own next one. Other columns are
    ignored.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        F.col("doc_id").isNull().alias("absent"),
        # Rises as doc_id falls, without overflow.
        F.bitwise_not("doc_id").alias("falling"),
        F.xxhash64(body).alias("kh"),
        body.alias("body"),
        F.char_length(body).alias("n_chars"),
        picks(body).alias("picks"),
    )
    # Two plain arrays take a third of the bytes of an array of structs when they are shuffled.
    narrow = found.select("absent", "falling", "kh", "body", "n_chars", F.col("picks.hash").alias("hashes"), F.col("picks.pos").alias("places"))
    both = _with_next(narrow).select(
        F.bitwise_not("falling").alias("doc_id"),
        "body",
        "n_chars",
        F.zip_with("places", "hashes", _pick).alias("picks"),
        F.zip_with("next_places", "next_hashes", _pick).alias("next_picks"),
        "next_body",
        (F.col("n_chars") - F.floor(F.col("n_chars") / 2).cast("int")).alias("n_kept"),
        F.least(F.floor(F.col("n_chars") / 2).cast("int"), F.col("next_n_chars")).alias("n_head"),
    )
    edited = both.select(
        "doc_id",
        "n_chars",
        "picks",
        "next_picks",
        "n_kept",
        "n_head",
        F.substring(F.col("body"), F.lit(1), F.col("n_kept")).alias("kept"),
        F.substring(F.col("next_body"), F.lit(1), F.col("n_head")).alias("head"),
    )
    side = _REACH - 1
    tail = F.substring(F.col("kept"), F.greatest(F.col("n_kept") - side, F.lit(0)) + 1, F.lit(side))
    seam = F.concat(tail, F.substring(F.col("head"), F.lit(1), F.lit(side)))
    across = F.when((F.col("n_kept") > 0) & (F.col("n_head") > 0), _segment_picks(seam, F.greatest(F.col("n_kept") - side, F.lit(0))))
    # Later windows never pick earlier places, so the three parts are in order.
    stitched = _once(
        F.concat(
            _until(F.col("picks"), F.col("n_kept")),
            F.coalesce(across, F.array().cast("array<struct<pos:int,hash:bigint>>")),
            _moved(_until(F.col("next_picks"), F.col("n_head")), F.col("n_kept")),
        )
    )
    text = F.concat("kept", "head")
    whole = F.when(F.col("n_kept") + F.col("n_head") >= _REACH, stitched).otherwise(_short_picks(text))
    done = edited.select("doc_id", "n_chars", F.sha2(text, 256).alias("edited_sha256"), "picks", "next_picks", whole.alias("edited_picks"))
    return done.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        as_string(F.col("picks")).alias("fingerprint"),
        as_string(F.col("edited_picks")).alias("edited_fingerprint"),
        likeness(hashes(F.col("picks")), hashes(F.col("edited_picks"))).alias("near_edited"),
        likeness(hashes(F.col("picks")), hashes(F.col("next_picks"))).alias("near_next"),
    )
