"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, html_text, language_id, license_scan, media, minhash_dedup, mixing, pii, toxicity
from .common import table


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.held_out("doc_id", 3, 1)
    found = language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer_path(), with_ids=False)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = f"filter(pii, x -> x.kind in ({', '.join(repr(k) for k in pii.BASE)}))"
    counts = [F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(F.expr(pii.joined(base)), 256).alias("base_sha256"), F.expr(pii.joined("pii")).alias("spans"), F.expr("cast(size(pii) as bigint)").alias("n_spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    positions = F.array_join(F.transform("positions", lambda t: F.round(t * 1_000_000).cast("long").cast("string")), ",")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.size("positions").alias("copies"), positions.alias("positions_ppm"))


def op7_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.classes(table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.regexp_count("licence_sentences", F.lit("[0-9]+")).cast("long").alias("n_sentences"), "licence_sentences", F.array_join("licences", ",").alias("licences"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language_id.held_out("doc_id", 5, 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    found = toxicity.score(docs, toxicity.learn(docs, labels))
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
        F.expr("array_join(transform(toxic_passages, x -> concat(x.first, ':', x.last)), ',')").alias("passages"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_byte_bpe, op3_media_columns, op4_html_extraction, op5_pii, op6_mixing,
        op7_product_quantisation, op8_minhash_hamming, op9_license_scan, op10_toxicity,
    )
}

#: DuckDB SQL for the rows of op8: exact Jaccard links among all documents, then the least id reachable.
_OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
  HAVING 100 * count(*) >= 85 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))
), reach AS (SELECT a AS id, a AS seen FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.seen = l.a
), low AS (SELECT id, min(seen) AS seen FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.seen, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low.seen, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.id = d.doc_id
"""

#: Exact cosines of all pairs.
_OP7 = r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (SELECT a AS id, b AS seen FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.seen = l.a
), low AS (SELECT id, min(seen) AS seen FROM reach GROUP BY 1), n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(seen, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(seen, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.id = vec_id LEFT JOIN n ON n.id = vec_id
"""

#: The water level of the targets is the greatest of the levels at which the first k sources by cap over weight are full.
_OP6 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), o AS (SELECT *, coalesce(sum(source_size * 3) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s WINDOW w AS (ORDER BY source_size * 3.0 / weight, source NULLS LAST)
), level AS (SELECT max(CAST((SELECT sum(source_size) FROM s) - full_ AS DOUBLE) / rest) AS level FROM o
), t AS (SELECT source, source_size, weight, least(CAST(source_size * 3 AS DOUBLE), weight * level) AS target FROM s, level
), c AS (SELECT d.*, t.source_size, t.weight, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS middle FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT doc_id, size, source_size, target, h, pass, CASE WHEN target > 0 AND (middle + pass * source_size) / target < 1 THEN (middle + pass * source_size) / target END AS share, (weight - 2) * 0.5 AS slope FROM c, (SELECT unnest([0, 1, 2]) AS pass)
), p AS (SELECT *, CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope / 2) * (1 - slope / 2) + 2 * slope * share) - (1 - slope / 2)) / slope END AS t FROM e
), k AS (SELECT * REPLACE (CASE WHEN size = 0 THEN coalesce(t, 1.0) ELSE t END AS t) FROM p WHERE size > 0 OR pass = 0)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, count(*) FILTER (t < 1) * any_value(size) AS taken, CAST(count(*) FILTER (t < 1 OR size = 0) AS INT) AS copies,
  coalesce(string_agg(CAST(CAST(round(t * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY pass) FILTER (t < 1 OR size = 0), '') AS positions_ppm
FROM k GROUP BY doc_id, h
"""

#: The base kinds and secrets by their plain patterns; the synthetic tables hold no span of the other added kinds.
_OP5 = r"""
WITH k(o, kind, p) AS (VALUES (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), (3, 'card', '[0-9]([\x20-]?[0-9])+'), (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'), (5, 'secret', '@secret@')
), m AS (SELECT doc_id, o, kind, regexp_extract_all(text, p) AS ms, regexp_split_to_array(text, p) AS ps FROM documents, k WHERE text IS NOT NULL
), u AS (SELECT doc_id, o, kind, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, generate_subscripts(ms, 1) AS i FROM m WHERE len(ms) > 0
), s AS (SELECT *, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id, o ORDER BY i) - length(m) AS BIGINT) AS f, regexp_replace(m, '[^0-9]', '', 'g') AS d, CASE WHEN kind = 'secret' THEN regexp_extract(m, '@value@') ELSE m END AS x FROM u
), v AS (SELECT * FROM s WHERE CASE kind WHEN 'email' THEN true WHEN 'secret' THEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 3) AS INT) > 255)) = 0
  WHEN 'phone' THEN length(d) BETWEEN 9 AND 15 ELSE length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INT) WHEN d[i] < '5' THEN 2 * CAST(d[i] AS INT) ELSE 2 * CAST(d[i] AS INT) - 9 END)) % 10 = 0 END
), g AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || f || ':' || (f + length(m)), ',' ORDER BY o, f) FILTER (o < 5) AS base,
  string_agg(kind || ':' || (f + length(m) - length(x)) || ':' || (f + length(m)), ',' ORDER BY o, f) AS spans, count(*) AS n FROM v GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0) AS n_spans FROM documents LEFT JOIN g USING (doc_id)
""".replace("@secret@", pii.PATTERNS["secret"].replace("'", "''")).replace("@value@", pii.SECRET_VALUE)


def _op9() -> str:
    """The same cuts, identifiers and rules; look-behind is said by marking the cuts first."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    table_ = "MAP {" + ", ".join(f"{quote(k)}: ':{v}:'" for k, v in license_scan.SENTENCES.items()) + "}"
    ids = "array_to_string(list_transform({cut}, lambda s: coalesce({table}[regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), {lead}, {under})], '')), '')"
    more = {"table": table_, "lead": quote(license_scan.LEAD), "under": quote(license_scan.UNDER)}
    by_line = ids.format(cut=r"string_split(regexp_replace(regexp_replace(t, '([.!?;:])[\x20\t]+', '\1' || chr(1), 'g'), '\s*\n\s*', chr(1), 'g'), chr(1))", **more)
    wrapped = ids.format(cut=r"string_split(regexp_replace(regexp_replace(t, '([.!?;:])\s+', '\1' || chr(1), 'g'), '\s*\n\s*\n\s*', chr(1), 'g'), chr(1))", **more)
    rules = ", ".join(f"({i}, {quote(n)}, {quote(p)})" for i, (n, p) in enumerate(license_scan.RULES, 1))
    return f"""
WITH RECURSIVE rules(o, licence, p) AS (VALUES {rules}), d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^[\\x20\\t]*(?://+|#+|\\*+|/\\*+|--+)[\\x20\\t]*', '', 'g'), {quote(license_scan.VERSION)}, {quote(license_scan.VERSION_JOINED[1])}, 'g') AS t FROM documents WHERE regexp_matches(text, {quote(license_scan.HINT)})
), i AS (SELECT doc_id, {by_line} AS a, {wrapped} AS b FROM d
), j AS (SELECT doc_id, 0 AS pass, a AS ids FROM i WHERE a <> '' UNION ALL SELECT doc_id, 1, b FROM i WHERE b <> ''
), step AS (SELECT doc_id, pass, ids AS whole, ids, 0 AS o, NULL::VARCHAR AS licence, NULL::INT AS first FROM j
  UNION ALL SELECT s.doc_id, s.pass, s.whole, regexp_replace(s.ids, r.p, '-', 'g'), r.o, CASE WHEN regexp_matches(s.ids, r.p) THEN r.licence END, CASE WHEN regexp_matches(s.ids, r.p) THEN strpos(s.whole, regexp_extract(s.whole, r.p)) END FROM step s JOIN rules r ON r.o = s.o + 1
), n AS (SELECT doc_id, licence, min(pass * 1000000 + first) AS pos, arg_min(licence, pass * 1000000 + first) AS l FROM step WHERE licence IS NOT NULL GROUP BY 1, 2
), l AS (SELECT doc_id, string_agg(licence, ',' ORDER BY pos, licence) AS licences FROM n GROUP BY 1
), r AS (SELECT doc_id, CASE WHEN length(b) > length(a) THEN b ELSE a END AS ids FROM i)
SELECT documents.doc_id, CAST(coalesce(length(ids) - length(replace(ids, ':', '')), 0) // 2 AS BIGINT) AS n_sentences, coalesce(ids, '') AS licence_sentences, coalesce(licences, '') AS licences
FROM documents LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
"""


ORACLES: dict[str, str] = {"op5_pii": _OP5, "op6_mixing": _OP6, "op7_product_quantisation": _OP7, "op8_minhash_hamming": _OP8, "op9_license_scan": _op9()}
