"""The registered queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from testsieve.sources.tables import load

from . import (
    arrow_sequences, decontamination, html_region, language, licences, merkle_manifest, multiset_fingerprints, near_duplicates, packing, piece_encoding,
    prefix_trie, secret_spans, site_quality,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_html_region")
def op1(spark, sf_dir):
    pages = load(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_region.extract(pages, html_region.fit(pages))


@query("op2_piece_encoding")
def op2(spark, sf_dir):
    return piece_encoding.round_trip(load(spark, sf_dir, "documents", "doc_id", "text"), _tokenizer("piece_bpe_32k.model"))


@query("op3_language")
def op3(spark, sf_dir):
    parts = language.fit(language.training_rows(load(spark, sf_dir, "documents", "doc_id", "text", "lang")))
    return language.identify(load(spark, sf_dir, "documents", "doc_id", "text"), parts)


@query("op4_licences")
def op4(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return licences.scan(docs, licences.fit(docs))


@query("op5_decontamination", sql=f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS span,
              unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda p: array_to_string(w[p:p + least(len(w), 13) - 1], ' '))) AS g
       FROM i WHERE len(w) > 0),
spans AS (SELECT DISTINCT span FROM iw),
dw AS (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS p FROM d CROSS JOIN spans WHERE len(w) >= span),
hits AS (SELECT doc_id, p, dw.span, item_id FROM dw JOIN iw ON iw.span = dw.span AND iw.g = array_to_string(dw.w[p:p + dw.span - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + span)) AS place FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN found USING (doc_id)
""")
def op5(spark, sf_dir):
    return decontamination.decontaminate(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op6_secret_spans")
def op6(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return secret_spans.find_secrets(docs, secret_spans.fit(docs))


@query("op7_arrow_sequences")
def op7(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return arrow_sequences.read_documents(arrow_sequences.write_sequences(docs, _tokenizer("word_bpe_49k.json")))


@query("op8_multiset_fingerprints")
def op8(spark, sf_dir):
    return multiset_fingerprints.edited_fingerprints(load(spark, sf_dir, "documents", "doc_id", "text"))


@query("op9_near_duplicates", sql=f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.m),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id
""")
def op9(spark, sf_dir):
    return near_duplicates.near_duplicates(load(spark, sf_dir, "documents", "doc_id", "text")).drop("n_links")


@query("op10_site_quality")
def op10(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "source")
    labels = load(spark, sf_dir, "labels", "doc_id", "quality")
    placed = site_quality.sites(docs, load(spark, sf_dir, "pages", "page_id", "url"))
    return site_quality.score(placed, labels, site_quality.fit(docs, labels))


@query("op11_bounded_packing")
def op11(spark, sf_dir):
    return packing.pack(load(spark, sf_dir, "documents", "doc_id", "text"), _tokenizer("word_bpe_49k.json"))


# crc32 of a decimal's characters: eight shifts a byte
def _crc32(number: str) -> str:
    bit = "lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"lambda c, d: list_reduce(list_prepend(xor(c, d), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {bit})"
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {byte}), 4294967295)"


@query("op12_prefix_trie", sql=f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[:32] AS g FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS k FROM t),
c AS (SELECT DISTINCT conv_id, {_crc32('conv_id')} % 4 AS h, conv_id - conv_id % 20 AS base FROM t),
r AS (SELECT c.conv_id, k, g, role, text FROM c JOIN o ON o.conv_id = c.base AND k <= h
      UNION ALL SELECT c.conv_id, h + k, g, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND k > h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, g, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM r),
p AS (SELECT conv_id, d, w, string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d) AS g FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT g, d, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n FROM p GROUP BY g, d),
e AS (SELECT g, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
      FROM (SELECT conv_id, arg_max(g, d) AS g FROM p GROUP BY conv_id) GROUP BY g),
k AS (SELECT g[:32 * (d - 1)] AS g, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (g)),
b AS (SELECT g[:32 * a] AS g, sum((n - 1) * w) AS saved, count(*) FILTER (WHERE kids = 0) AS leaves
      FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY ALL)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(m.n AS BIGINT) AS n_convs, CAST(m.kids AS BIGINT) AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM m JOIN b USING (g) LEFT JOIN e USING (g) LEFT JOIN n u ON m.d > 0 AND u.g = m.g[:32 * (m.d - 1)] AND u.d = m.d - 1
""")
def op12(spark, sf_dir):
    return prefix_trie.prefix_trie(load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_BEFORE = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))


@query("op13_merkle_manifest", sql=f"""
WITH RECURSIVE d AS (SELECT doc_id, source, row_number() OVER () AS r, sha256({_BEFORE} || {_FIELD.format('text')}) AS leaf,
           CASE WHEN {_crc32('doc_id')} % 2 = 0 THEN sha256({_BEFORE} || {_FIELD.format("replace(text, chr(10), '')")}) END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM d),
s AS (SELECT source, 0 AS v, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM l
      UNION ALL SELECT source, v + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM s WHERE n > 1 GROUP BY source, v, i // 3),
u AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY CASE WHEN source IS NULL THEN 0 ELSE 1 END, encode(source)) - 1 AS i FROM s WHERE n = 1),
t AS (SELECT 0 AS v, i, subroot AS h, count(*) OVER () AS n FROM u
      UNION ALL SELECT v + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY v, i // 3),
p AS (SELECT l.r, s.v, (l.i // CAST(3 ** s.v AS BIGINT)) AS own, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i < l.i // CAST(3 ** s.v AS BIGINT)), '') AS a,
             coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i > l.i // CAST(3 ** s.v AS BIGINT)), '') AS b
      FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source AND s.n > 1 AND s.i // 3 = l.i // CAST(3 ** (s.v + 1) AS BIGINT) GROUP BY ALL
      UNION ALL
      SELECT l.r, 1000 + t.v, (u.i // CAST(3 ** t.v AS BIGINT)) AS own, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i < u.i // CAST(3 ** t.v AS BIGINT)), ''),
             coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i > u.i // CAST(3 ** t.v AS BIGINT)), '')
      FROM l JOIN u ON u.source IS NOT DISTINCT FROM l.source JOIN t ON t.n > 1 AND t.i // 3 = u.i // CAST(3 ** (t.v + 1) AS BIGINT) GROUP BY ALL),
q AS (SELECT r, string_agg(a || b, '' ORDER BY v) AS proof, list({{'a': a, 'b': b}} ORDER BY v) AS steps FROM p GROUP BY r),
f AS (SELECT l.doc_id, l.source, l.leaf, sha256(coalesce(proof, '')) AS proof_sha256, 1 AS k, coalesce(len(steps), 0) AS m, steps, coalesce(changed, leaf) AS h FROM l LEFT JOIN q USING (r)
      UNION ALL SELECT doc_id, source, leaf, proof_sha256, k + 1, m, steps, sha256(steps[k].a || h || steps[k].b) FROM f WHERE k <= m)
SELECT f.doc_id, f.leaf, u.subroot, t.h AS root, f.proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM f JOIN u ON u.source IS NOT DISTINCT FROM f.source JOIN t ON t.n = 1 WHERE f.k = f.m + 1
""")
def op13(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", *merkle_manifest.FIELDS)
    return merkle_manifest.proofs(merkle_manifest.build(docs))
