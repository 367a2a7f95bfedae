"""The queries of the catalog in DuckDB SQL over the same tables, written apart from the Spark code."""

from __future__ import annotations

from docloom.catalog.views import LABEL_MAP, VOCABULARY
from docloom.functions.patterns import STOP_WORDS

# The patterns again, in the dialect of a regex engine without look-around.
TOKEN = r"(?:https?://[^\s]+)|(?:[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.\p{L}+)|(?:\p{N}+(?:[.,]\p{N}+)*)|(?:\p{L}+(?:[''’-]\p{L}+)*)|[^\s\p{L}\p{N}]"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
MASKS = {
    "no_line_breaks": (r"[\r\n]+", " "),
    "mask_urls": (r"(?:https?://|www\.)[^\s<>\"]+", "<url>"),
    "mask_emails": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    "mask_dates": (
        r"\b(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2} (?:" + MONTHS + r") \d{4})\b",
        "<date>",
    ),
    "mask_numbers": (r"\b\d+(?:[.,]\d+)*\b", "<number>"),
    "mask_digits": (r"\d+", "<number>"),
}
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

_MAP_ROWS = ", ".join(f"('{raw}', '{canon.lower()}')" for raw, canon in LABEL_MAP.items())
_VOCABULARY = "[" + ", ".join(f"'{v}'" for v in VOCABULARY) + "]"
_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"


def _sub(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def _clean(text: str) -> str:
    out = f"nfc_normalize({text})"
    for pattern, by in MASKS.values():
        out = _sub(out, pattern, by)
    return _sub(out, " {2,}", " ")


def _with(*names: str) -> str:
    """WITH clause of the named views and the ones they build on."""
    needed: list[str] = []

    def add(name: str) -> None:
        for before in _VIEWS[name][0]:
            add(before)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n][1]})" for n in needed) + "\n"


_BLOCK = "round_even((SELECT count(*) FROM documents)::DOUBLE * ({}::DOUBLE / 3), 0)::BIGINT"
# name -> (views it uses, body)
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "label_map": ((), f"SELECT * FROM (VALUES {_MAP_ROWS}) m(raw, canon)"),
    "vocab": ((), f"SELECT unnest({_VOCABULARY}) AS label, generate_subscripts({_VOCABULARY}, 1) - 1 AS idx"),
    "raw_docs": (
        (),
        r"""SELECT d.doc_id,
          CASE WHEN d.doc_id % 50 = 7 THEN ' ' || chr(10) || 'a' ELSE d.text END AS content,
          strftime(DATE '2004-01-01' + (d.doc_id % 5000)::INT, '%Y-%m-%d') AS date,
          CASE WHEN d.doc_id % 50 = 49 THEN []::VARCHAR[] ELSE list_filter([
            ' ' || upper(d.source), d.lang || chr(10),
            CASE WHEN l.quality = 1 THEN 'Quality' END, CASE WHEN l.toxic = 1 THEN 'TOXIC ' END
          ], lambda x: x IS NOT NULL) END AS buckets
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "sizes": (
        (),
        f"SELECT {_BLOCK.format(0.7)} AS tr, {_BLOCK.format(0.2)} AS te, {_BLOCK.format(0.1)} AS de",
    ),
    "placed": (
        ("raw_docs", "sizes"),
        """SELECT r.*, CASE
            WHEN r.row_idx // (tr + te + de) >= 3 THEN 'train'
            WHEN r.row_idx % (tr + te + de) < tr THEN 'train'
            WHEN r.row_idx % (tr + te + de) < tr + te THEN 'test' ELSE 'dev' END AS split
        FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM raw_docs) r, sizes""",
    ),
    "kept": (
        ("placed",),
        """SELECT *, replace(content, chr(10), ' ') AS text FROM placed
        WHERE length(replace(replace(content, chr(10), ''), ' ', '')) >= 3""",
    ),
    "raw_labels": (
        ("raw_docs",),
        r"""SELECT doc_id, raw, pos, lower(regexp_replace(raw, '^\s+|\s+$', '', 'g')) AS folded
        FROM (SELECT doc_id, unnest(buckets) AS raw, generate_subscripts(buckets, 1) - 1 AS pos FROM raw_docs)""",
    ),
    "doc_labels": (
        ("raw_labels", "label_map"),
        "SELECT DISTINCT r.doc_id, m.canon AS label FROM raw_labels r JOIN label_map m ON r.folded = m.raw",
    ),
    "label_lines": (
        ("raw_docs", "doc_labels"),
        """SELECT r.doc_id, coalesce(string_agg(d.label, ' ' ORDER BY d.label), '') AS labels
        FROM raw_docs r LEFT JOIN doc_labels d ON r.doc_id = d.doc_id GROUP BY r.doc_id""",
    ),
    "prepared": (
        ("kept", "label_lines"),
        """SELECT k.doc_id, k.row_idx, k.split, k.text, k.date, l.labels,
          row_number() OVER (PARTITION BY k.split ORDER BY k.row_idx) - 1 AS line_no
        FROM kept k JOIN label_lines l ON k.doc_id = l.doc_id""",
    ),
    "cells": (
        ("prepared", "vocab", "doc_labels"),
        """SELECT c.*, (score >= 0.5::DOUBLE)::INT AS pred FROM (
          SELECT p.row_idx, p.split, p.line_no, v.label, v.idx,
            (d.label IS NOT NULL)::INT AS truth,
            ((p.row_idx * 7919 + v.idx * 104729) % 2000)::DOUBLE / 1000.0::DOUBLE
              - 1.4::DOUBLE + 1.8::DOUBLE * (d.label IS NOT NULL)::INT AS score
          FROM prepared p CROSS JOIN vocab v
          LEFT JOIN doc_labels d ON d.doc_id = p.doc_id AND d.label = v.label) c""",
    ),
    "confusion": (
        ("cells",),
        """SELECT idx, sum(truth * pred)::BIGINT AS tp, sum((1 - truth) * pred)::BIGINT AS fp,
          sum(truth * (1 - pred))::BIGINT AS fn, sum(truth)::BIGINT AS support FROM cells GROUP BY idx""",
    ),
    "prf": (
        ("confusion",),
        """SELECT sum(support * CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END) / sum(support) AS precision,
          sum(support * CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END) / sum(support) AS recall,
          sum(support * CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END)
            / sum(support) AS f1 FROM confusion""",
    ),
    "row_match": (("cells",), "SELECT row_idx, min((truth = pred)::INT) AS ok FROM cells GROUP BY row_idx"),
    "bce": (
        ("cells",),
        "SELECT row_idx, greatest(score, 0) - score * truth + ln(1 + exp(-abs(score))) AS loss FROM cells",
    ),
    "doc_tokens": ((), f"SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS tokens FROM documents"),
    "prep_tokens": (("kept",), f"SELECT doc_id, split, regexp_extract_all(text, '{TOKEN}') AS tokens FROM kept"),
    "lengths": (
        ("prep_tokens",),
        r"""SELECT doc_id, len(tokens) AS n_all,
          len(list_filter(tokens, lambda t: NOT regexp_full_match(t, '\p{N}+'))) AS n_nonnumeric FROM prep_tokens""",
    ),
    "words": (
        ("prep_tokens",),
        rf"""SELECT doc_id, pos, word FROM (
          SELECT doc_id, lower(unnest(tokens)) AS word, generate_subscripts(tokens, 1) AS pos FROM prep_tokens)
        WHERE regexp_full_match(word, '[\p{{L}}\p{{N}}]+') AND NOT list_contains({_STOP}, word)""",
    ),
    "word_counts": (("words",), "SELECT word, count(*) AS n_uses FROM words GROUP BY word"),
    "bigram_counts": (
        ("words",),
        """SELECT bigram, count(*) AS n_uses FROM (
          SELECT word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS bigram FROM words)
        WHERE bigram IS NOT NULL GROUP BY bigram""",
    ),
    "all_texts": (
        (),
        """SELECT 'documents' AS origin, doc_id::VARCHAR AS id, text FROM documents
        UNION ALL SELECT 'pages', page_id::VARCHAR, html FROM pages
        UNION ALL SELECT 'conversations', conv_id::VARCHAR || '/' || turn::VARCHAR, text FROM conversations""",
    ),
    "lm": (("kept",), f"SELECT doc_id, row_idx, split, {_clean('text')} AS lm_text FROM kept"),
    # Runs of whitespace before a visible character are cut before their last character, which stands
    # for the look-ahead of the pre-tokenizer.
    "bpe_uses": (
        ("lm",),
        rf"""SELECT unnest(regexp_extract_all(piece,
            '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+')) AS word
        FROM (SELECT unnest(string_split(regexp_replace(lm_text || chr(10),
            '([{SPACE}]+)([{SPACE}][^{SPACE}])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS piece
          FROM lm WHERE split = 'train')""",
    ),
    "bpe_words": (("bpe_uses",), "SELECT word, count(*) AS n_uses FROM bpe_uses GROUP BY word"),
    # Printable bytes come first, in byte order, then the others.
    "bytes": (
        (),
        """SELECT b, 9 + row_number() OVER (ORDER BY NOT (b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174), b) - 1 AS id
        FROM range(256) t(b)""",
    ),
    "ids": (
        ("doc_tokens",),
        """SELECT doc_id, list_transform(tokens, lambda t:
          ('0x' || substr(md5(t), 1, 8))::BIGINT % 15991 + 9) AS ids FROM doc_tokens""",
    ),
    "framed": (("ids",), "SELECT doc_id, list_concat([4], ids[1:510], [6]) AS ids FROM ids"),
    "padded": (
        ("framed",),
        "SELECT doc_id, len(ids) AS n, list_concat(ids, list_transform(range(512 - len(ids)), lambda x: 5)) AS ids FROM framed",
    ),
    "grams": (
        ("lm",),
        rf"""SELECT split, unnest(t[1:len(t) - 1]) AS prev, unnest(t[2:len(t)]) AS next FROM (
          SELECT split, list_concat(['<s>'], regexp_extract_all(lm_text, '{TOKEN}'), ['</s>']) AS t FROM lm)""",
    ),
}

ORACLE_SQL: dict[str, str] = {}


def _add(name: str, views: tuple[str, ...], body: str) -> None:
    ORACLE_SQL[name] = (_with(*views) if views else "") + body


_add(
    "split_label_counts",
    ("kept", "doc_labels"),
    "SELECT split, label, count(*) AS n_docs FROM kept JOIN doc_labels USING (doc_id) GROUP BY split, label",
)
for _name in ("scan_documents", "scan_json_array"):
    _add(
        _name,
        ("placed",),
        "SELECT row_idx, content, date, array_to_string(buckets, '|') AS buckets FROM placed",
    )
ORACLE_SQL["scan_label_map"] = (
    _with("raw_labels")
    + ", full_map AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{raw}', '{canon}')" for raw, canon in LABEL_MAP.items())
    + """) m(raw, canon))
SELECT m.raw, m.canon, count(r.doc_id) AS n_uses FROM full_map m LEFT JOIN raw_labels r ON r.folded = m.raw
GROUP BY m.raw, m.canon"""
)
_LINES = "SELECT line_no AS row_idx, split, text, date, labels FROM prepared"
_add("scan_tsv", ("prepared",), "SELECT line_no AS row_idx, split, text, date FROM prepared")
_add("write_tsv_pair", ("prepared",), _LINES)
_add("write_gzip", ("prepared",), _LINES)
_add(
    "scan_text_lines",
    ("prepared",),
    f"SELECT line_no AS row_idx, split, {_clean('text')} AS value FROM prepared",
)
_DECODED = "coalesce(string_agg(label, ' ' ORDER BY idx) FILTER (WHERE pred = 1), '')"
_add(
    "write_text_lines",
    ("cells",),
    f"SELECT line_no AS row_idx, split, {_DECODED} AS value FROM cells WHERE split <> 'train' GROUP BY line_no, split",
)
_EVALUATION = """SELECT round(f1, 6) AS f1, round((SELECT avg(ok) FROM row_match), 6) AS accuracy,
  round(precision, 6) AS precision, round(recall, 6) AS recall,
  round((SELECT avg(loss) FROM bce), 6) AS loss FROM prf"""
_add("write_metrics_json", ("prf", "row_match", "bce"), _EVALUATION)
_add("evaluate_multilabel", ("prf", "row_match", "bce"), _EVALUATION)
_add(
    "publish_layout",
    ("prepared",),
    """SELECT line_no AS row_idx, CASE split WHEN 'test' THEN 'test-A' WHEN 'dev' THEN 'dev-0' ELSE 'train' END AS split,
      replace(text, chr(13), '') AS text, date, CASE WHEN split <> 'test' THEN labels END AS labels FROM prepared""",
)
_add(
    "global_row_index",
    ("raw_docs",),
    "SELECT row_number() OVER (ORDER BY date, doc_id) - 1 AS row_idx, date, doc_id FROM raw_docs",
)
_add("block_split", ("placed",), "SELECT doc_id, split FROM placed")
_add("split_sizes", ("placed",), "SELECT split, count(*) AS n_rows FROM placed GROUP BY split")
_add(
    "size_capped_subset",
    ("prepared",),
    """SELECT doc_id, text, labels FROM prepared WHERE split = 'train'
    ORDER BY md5('42:' || doc_id), doc_id LIMIT 100""",
)
_add("project_text", ("kept",), "SELECT text FROM kept")
_add("drop_text", ("kept",), f"SELECT doc_id, date, split, len(regexp_extract_all(text, '{TOKEN}'))::INT AS n_tokens FROM kept")
_add(
    "scan_pairs",
    ("prepared",),
    "SELECT line_no AS row_idx, replace(text, chr(13), '') AS text, date, labels, split FROM prepared",
)
_add(
    "assert_row_parity",
    ("placed", "kept"),
    """SELECT p.split, count(*) AS n_in, count(k.doc_id) AS n_expected, count(*) - count(k.doc_id) AS only_in,
      0::BIGINT AS only_expected FROM placed p LEFT JOIN kept k ON p.doc_id = k.doc_id GROUP BY p.split""",
)
_add(
    "validate_publish",
    ("prepared", "vocab"),
    r""", base AS (SELECT doc_id AS key, split, replace(text, chr(13), '') AS text, date,
      CASE WHEN split <> 'test' THEN labels END AS labels FROM prepared),
    view AS (SELECT CASE WHEN key % 7 = 0 THEN 'holdout' ELSE split END AS split,
      CASE WHEN key % 11 = 0 THEN NULL WHEN key % 13 = 0 THEN 'a' || chr(9) || 'b' ELSE text END AS text,
      CASE WHEN key % 17 = 0 THEN 'a' || chr(10) || 'b' ELSE date END AS date,
      CASE WHEN key % 19 = 0 THEN 'law unheard_of' WHEN key % 23 = 0 THEN NULL WHEN key % 29 = 0 THEN 'law' || chr(13)
        ELSE labels END AS labels, key
      FROM base)
    SELECT 'unknown_split' AS check_name, count(*) FILTER (WHERE split NOT IN ('train', 'dev', 'test')) AS n_bad FROM view
    UNION ALL SELECT 'missing_text', count(*) FILTER (WHERE text IS NULL) FROM view
    UNION ALL SELECT 'text_breaks_line', count(*) FILTER (WHERE regexp_matches(text, '[\t\n\r]')) FROM view
    UNION ALL SELECT 'date_breaks_line', count(*) FILTER (WHERE regexp_matches(date, '[\t\n\r]')) FROM view
    UNION ALL SELECT 'labels_break_line', count(*) FILTER (WHERE regexp_matches(labels, '[\t\n\r]')) FROM view
    UNION ALL SELECT 'missing_labels', count(*) FILTER (WHERE labels IS NULL AND split <> 'test') FROM view
    UNION ALL SELECT 'leaked_labels', count(*) FILTER (WHERE labels IS NOT NULL AND split = 'test') FROM view
    UNION ALL SELECT 'label_outside_vocabulary', count(DISTINCT key) FROM (SELECT key, unnest(string_split(labels, ' ')) AS label
      FROM view) WHERE label <> '' AND label NOT IN (SELECT label FROM vocab)
    UNION ALL SELECT 'header_arity', 0""",
)
_add("newline_to_space", (), "SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents")
_add("min_content_filter", ("kept",), "SELECT doc_id, content FROM kept")
_add("strip_cr", ("all_texts",), "SELECT origin, id, replace(text, chr(13), '') AS text FROM all_texts")
_add("remap_labels", ("label_lines",), "SELECT doc_id, labels FROM label_lines")
_add("remap_labels_by_join", ("label_lines",), "SELECT doc_id, labels FROM label_lines")
_add(
    "unmapped_labels",
    ("raw_labels",),
    """SELECT folded AS raw, count(*) AS n_uses FROM raw_labels
    WHERE folded NOT IN ('en', 'fr', 'de', 'es', 'quality', 'toxic') GROUP BY folded""",
)
_add("align_text_labels", ("prepared",), "SELECT split, doc_id, text, labels FROM prepared")
_add(
    "encode_label_ids",
    ("prepared", "doc_labels", "vocab"),
    """SELECT p.row_idx, coalesce(string_agg(v.idx::VARCHAR, ' ' ORDER BY v.idx), '') AS label_ids FROM prepared p
    LEFT JOIN doc_labels d ON p.doc_id = d.doc_id LEFT JOIN vocab v ON v.label = d.label GROUP BY p.row_idx""",
)
_add(
    "union_splits",
    ("prepared",),
    " UNION ALL ".join(f"SELECT doc_id, text, labels FROM prepared WHERE split = '{s}'" for s in ("dev", "test", "train")),
)
_add("fold_label", ("raw_labels",), "SELECT doc_id, pos::INT AS pos, raw, folded AS label FROM raw_labels")
_add(
    "split_labels",
    ("prepared",),
    """SELECT row_idx, CASE WHEN labels = '' THEN 0 ELSE len(string_split(labels, ' ')) END::INT AS n_labels,
      unnest(CASE WHEN labels = '' THEN [NULL] ELSE string_split(labels, ' ') END) AS label FROM prepared""",
)
_add("join_labels", ("prepared",), "SELECT row_idx, labels AS line FROM prepared")
_add(
    "dedupe_labels",
    ("raw_docs", "raw_labels", "label_lines"),
    """SELECT r.doc_id, len(r.buckets)::INT AS n_before,
      CASE WHEN l.labels = '' THEN 0 ELSE len(string_split(l.labels, ' ')) END::INT AS n_after, l.labels
    FROM raw_docs r JOIN label_lines l ON r.doc_id = l.doc_id""",
)
_add("multi_hot", ("cells",), "SELECT row_idx, string_agg(truth::VARCHAR, '' ORDER BY idx) AS hot FROM cells GROUP BY row_idx")
_add("decode_labels", ("cells",), f"SELECT row_idx, {_DECODED} AS labels FROM cells GROUP BY row_idx")
_add("threshold_scores", ("cells",), "SELECT row_idx, string_agg(pred::VARCHAR, '' ORDER BY idx) AS hot FROM cells GROUP BY row_idx")
_KEPT_LABELS = "FROM kept JOIN doc_labels USING (doc_id)"
_add("distinct_labels", ("kept", "doc_labels"), f"SELECT DISTINCT label {_KEPT_LABELS}")
_add("label_frequency", ("kept", "doc_labels"), f"SELECT label, count(*) AS n_uses {_KEPT_LABELS} GROUP BY label")
_add(
    "label_index",
    ("kept", "doc_labels"),
    f"SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS idx FROM (SELECT DISTINCT label {_KEPT_LABELS})",
)


def _token_list(count: str, tokens: str) -> str:
    return f"SELECT doc_id, len({tokens})::INT AS {count}, array_to_string({tokens}, ' ') AS tokens FROM doc_tokens"


_add("tokenize_words", ("doc_tokens",), _token_list("n_tokens", "tokens"))
_add("is_numeric_token", ("doc_tokens",), _token_list("n_numeric", r"list_filter(tokens, lambda t: regexp_full_match(t, '\p{N}+'))"))
_add("is_alnum_token", ("doc_tokens",), _token_list("n_alnum", r"list_filter(tokens, lambda t: regexp_full_match(t, '[\p{L}\p{N}]+'))"))
_add(
    "stopword_filter",
    ("doc_tokens",),
    _token_list("n_kept", f"list_filter(list_transform(tokens, lambda t: lower(t)), lambda t: NOT list_contains({_STOP}, t))"),
)
_add("corpus_count", ("kept",), "SELECT count(*) AS n_docs FROM kept")
_HIST = "SELECT {}::INT AS n_tokens, count(*) AS n_docs FROM lengths GROUP BY 1"
_add("token_length_hist", ("lengths",), _HIST.format("n_all"))
_add("token_length_hist_nonnumeric", ("lengths",), _HIST.format("n_nonnumeric"))
_add(
    "length_profile",
    ("lengths",),
    """SELECT 'all' AS kind, n_all::INT AS n_tokens, count(*) AS n_docs FROM lengths GROUP BY 2
    UNION ALL SELECT 'nonnumeric', n_nonnumeric::INT, count(*) FROM lengths GROUP BY 2""",
)
_add("word_frequency", ("word_counts",), "SELECT word, n_uses FROM word_counts")
_add("bigram_frequency", ("bigram_counts",), "SELECT bigram, n_uses FROM bigram_counts")
_add("top_common_lengths", ("lengths",), _HIST.format("n_all") + " ORDER BY n_docs DESC, n_tokens LIMIT 10")
_add("top_longest_lengths", ("lengths",), _HIST.format("n_all") + " ORDER BY n_tokens DESC LIMIT 10")
_add("top_longest_nonnumeric", ("lengths",), _HIST.format("n_nonnumeric") + " ORDER BY n_tokens DESC LIMIT 10")
_add("top_words", ("word_counts",), "SELECT word, n_uses FROM word_counts ORDER BY n_uses DESC, word LIMIT 20")
_add("top_bigrams", ("bigram_counts",), "SELECT bigram, n_uses FROM bigram_counts ORDER BY n_uses DESC, bigram LIMIT 20")
_add("preview", ("kept",), "SELECT doc_id, split, date, text FROM kept ORDER BY row_idx LIMIT 5")

_add("fix_unicode", ("all_texts",), "SELECT origin, id, nfc_normalize(text) AS text FROM all_texts")
for _name, (_pattern, _by) in MASKS.items():
    _add(_name, ("all_texts",), f"SELECT origin, id, {_sub('text', _pattern, _by)} AS text FROM all_texts")
_add("bpe_encode", ("lm",), "SELECT doc_id, split, lm_text AS text, true AS an_id_a_word FROM lm")
_add(
    "lm_examples",
    ("lm",),
    """SELECT doc_id, split, 512 AS n_input_ids, 512 AS n_attention_mask, 512 AS n_labels, true AS has_boundaries,
      true AS labels_follow_the_rule FROM lm""",
)
_add(
    "classifier_examples",
    ("prepared", "kept", "doc_labels"),
    """SELECT p.doc_id, p.split, 512 AS n_input_ids, 512 AS n_attention_mask,
      string_agg((d.label IS NOT NULL)::INT::VARCHAR, '' ORDER BY v.label) AS labels
    FROM prepared p CROSS JOIN (SELECT DISTINCT label FROM kept JOIN doc_labels USING (doc_id)) v
    LEFT JOIN doc_labels d ON d.doc_id = p.doc_id AND d.label = v.label GROUP BY p.doc_id, p.split""",
)
_add("clean_text", ("all_texts",), f"SELECT origin, id, {_clean('text')} AS text FROM all_texts")
_CENSUS = "len(regexp_extract_all(lm_text, '{0}'))"
_add(
    "special_token_census",
    ("lm",),
    " UNION ALL ".join(
        f"SELECT split, '{t}' AS token, sum({_CENSUS.format(t)})::BIGINT AS n_uses FROM lm GROUP BY split"
        for t in ("<url>", "<email>", "<number>", "<date>")
    ),
)

_add(
    "truncate_pad",
    ("padded",),
    """SELECT doc_id, array_to_string(ids, ' ') AS input_ids,
      repeat('1', n::INT) || repeat('0', (512 - n)::INT) AS attention_mask FROM padded""",
)
_HASH = "('0x' || substr(md5('42{kind}:' || doc_id || ':' || pos), 1, 8))::BIGINT"
_add(
    "mlm_mask",
    ("padded",),
    f""", slots AS (SELECT doc_id, unnest(ids) AS id, unnest(range(512)) AS pos FROM padded),
    drawn AS (SELECT *, id >= 9 AND {_HASH.format(kind="")} / 4294967296.0::DOUBLE < 0.15::DOUBLE AS chosen,
      {_HASH.format(kind="a")} / 4294967296.0::DOUBLE AS act, {_HASH.format(kind="r")} % 15991 + 9 AS other FROM slots)
    SELECT doc_id,
      string_agg(CASE WHEN NOT chosen OR act >= 0.9::DOUBLE THEN id WHEN act < 0.8::DOUBLE THEN 8 ELSE other END::VARCHAR, ' ' ORDER BY pos) AS input_ids,
      string_agg(CASE WHEN chosen THEN id ELSE -100 END::VARCHAR, ' ' ORDER BY pos) AS labels
    FROM drawn GROUP BY doc_id""",
)
_add("bpe_word_counts", ("bpe_words",), "SELECT word, n_uses FROM bpe_words")
_add(
    "bpe_pair_counts",
    ("bpe_words", "bytes"),
    """, hexed AS (SELECT hex(encode(word)) AS h, n_uses FROM bpe_words),
    places AS (SELECT h, n_uses, unnest(range(0, len(h) // 2 - 1)) AS i FROM hexed),
    byte_pairs AS (SELECT ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT AS l, ('0x' || substr(h, (2 * i + 3)::INT, 2))::INT AS r,
      n_uses FROM places)
    SELECT a.id::INT AS left_id, z.id::INT AS right_id, sum(n_uses)::BIGINT AS n_uses FROM byte_pairs
    JOIN bytes a ON a.b = l JOIN bytes z ON z.b = r GROUP BY 1, 2 HAVING sum(n_uses) >= 2""",
)
_add(
    "ngram_lm_perplexity",
    ("grams",),
    """, seen AS (SELECT prev, next, count(*) AS c FROM grams WHERE split = 'train' GROUP BY ALL),
    context AS (SELECT prev, sum(c) AS c FROM seen GROUP BY prev),
    loss AS (SELECT avg(ln(coalesce(t.c, 0) + (SELECT count(DISTINCT next) + 1 FROM seen)) - ln(coalesce(s.c, 0) + 1)) AS l
      FROM grams g LEFT JOIN seen s ON s.prev = g.prev AND s.next = g.next LEFT JOIN context t ON t.prev = g.prev
      WHERE g.split = 'test')
    SELECT round(exp(l), 6) AS perplexity, round(l, 6) AS eval_loss FROM loss""",
)
_add(
    "kneser_ney_perplexity",
    ("grams",),
    """, seen AS (SELECT prev, next, count(*)::DOUBLE AS c FROM grams WHERE split = 'train' GROUP BY ALL),
    times AS (SELECT count(*) FILTER (c = 1)::DOUBLE AS n1, count(*) FILTER (c = 2)::DOUBLE AS n2, count(*) FILTER (c = 3)::DOUBLE AS n3,
      count(*) FILTER (c = 4)::DOUBLE AS n4, count(*)::DOUBLE AS types FROM seen),
    simple AS (SELECT *, coalesce(n1 / nullif(n1 + 2 * n2, 0), 0) AS y FROM times),
    discounts AS (SELECT types, CASE WHEN n1 > 0 THEN least(greatest(1 - 2 * y * n2 / n1, 0), 1) ELSE y END AS d1,
      CASE WHEN n2 > 0 THEN least(greatest(2 - 3 * y * n3 / n2, 0), 2) ELSE y END AS d2,
      CASE WHEN n3 > 0 THEN least(greatest(3 - 4 * y * n4 / n3, 0), 3) ELSE y END AS d3 FROM simple),
    follows AS (SELECT next, count(*)::DOUBLE AS t FROM seen GROUP BY next),
    lower_order AS (SELECT coalesce(count(*) FILTER (t = 1)::DOUBLE / nullif(count(*) FILTER (t = 1) + 2 * count(*) FILTER (t = 2), 0), 0) AS d,
      count(*)::DOUBLE AS words FROM follows),
    context AS (SELECT prev, sum(c) AS n, (any_value(d1) * count(*) FILTER (c = 1) + any_value(d2) * count(*) FILTER (c = 2)
      + any_value(d3) * count(*) FILTER (c > 2)) / sum(c) AS kept FROM seen CROSS JOIN discounts GROUP BY prev),
    p AS (SELECT coalesce((s.c - CASE WHEN s.c = 1 THEN d1 WHEN s.c = 2 THEN d2 ELSE d3 END) / x.n, 0)
        + coalesce(x.kept, 1) * (coalesce(f.t - o.d, 0) / types + o.d * o.words / types / (o.words + 1)) AS p
      FROM grams g CROSS JOIN discounts CROSS JOIN lower_order o
      LEFT JOIN seen s ON s.prev = g.prev AND s.next = g.next LEFT JOIN context x ON x.prev = g.prev
      LEFT JOIN follows f ON f.next = g.next WHERE g.split = 'test')
    SELECT round(exp(-avg(ln(p))), 6) AS perplexity, round(-avg(ln(p)), 6) AS eval_loss FROM p""",
)
_add("label_confusion", ("confusion",), "SELECT idx::INT AS idx, tp, fp, fn, support FROM confusion")
_add("weighted_prf", ("prf",), "SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf")
_add("subset_accuracy", ("row_match",), "SELECT round(avg(ok), 6) AS accuracy FROM row_match")
_add("line_accuracy", ("row_match",), "SELECT round(avg(ok), 6) AS accuracy FROM row_match")
_add("multilabel_loss", ("bce",), "SELECT round(avg(loss), 6) AS loss FROM bce")
_add(
    "micro_fbeta",
    ("confusion",),
    """SELECT round(2.0::DOUBLE * sum(tp) / (sum(support) + sum(tp) + sum(fp)), 6) AS f1,
      round(5.0::DOUBLE * sum(tp) / (4 * sum(support) + sum(tp) + sum(fp)), 6) AS f2 FROM confusion""",
)
_add(
    "perplexity",
    ("bce",),
    """SELECT round(exp(avg(l)), 6) AS perplexity, round(avg(l), 6) AS eval_loss
    FROM (SELECT row_idx, avg(loss) AS l FROM bce GROUP BY row_idx)""",
)
