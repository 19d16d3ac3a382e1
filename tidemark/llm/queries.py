"""One query for each text operator, over whole tables, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold_of, scratch, table
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.filter_audit import audit_filters
from tidemark.llm.fingerprints import as_text, fingerprint_documents, likeness
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.pii import KINDS, find_personal_data
from tidemark.llm.quality import fit_quality, score_quality
from tidemark.llm.ranked_search import ranked_search
from tidemark.llm.sharding import shard_documents
from tidemark.llm.toxicity import fit_toxicity, score_toxicity
from tidemark.llm.url_filter import RULES, filter_urls
from tidemark.llm.warc import page_records, read_warc, write_warc


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), fold_of(F.col("doc_id"), 3) == 1
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), fold_of(F.col("doc_id"), 4) == 2
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.regexp_count("exact", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return out.select("doc_id", *counts, F.sha2(F.col("exact").cast("binary"), 256).alias("base_sha256"), "spans")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.col("n_words").cast("long"), "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = {"n_chars": F.col("n_chars"), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256)}
    out = fingerprint_documents(table(spark, sf_dir, "documents"), keep=keep)
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return page_records(read_warc(spark, path))


QUERIES = {f.__name__: f for f in (op1_quality, op2_toxicity, op3_near_dedup, op4_pii, op5_packing, op6_line_dedup, op7_url_filter, op8_sharding, op9_decontamination, op10_fingerprints, op11_ranked_search, op12_filter_audit, op13_warc)}

#: The words of a text as these operators see them, in RE2.
WORDS_9 = r"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
WORDS_11 = r"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')"
LINE_KEY = "translate(trim({x}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REST = "CASE WHEN contains(coalesce({u}, ''), '://') THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"
RULE_ROWS = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in RULES)
FORM = (
    "CASE WHEN h = '' THEN NULL ELSE h || regexp_replace(p, '/$', '') || CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END END"
)
PARTS = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS p, list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_full_match(x, '(utm_[^=]*|ref|fbclid|gclid)(=.*)?')) AS qs"

ORACLE: dict[str, str] = {
    "op3_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS g FROM d),
 n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
 c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * both_have >= 85 * (nx.k + ny.k - both_have)),
 e AS (SELECT x AS src, y AS dst FROM l UNION ALL SELECT y, x FROM l),
 r(node, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.reach),
 m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(k, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN m ON m.node = doc_id LEFT JOIN n USING (doc_id)""",
    "op7_url_filter": f"""
WITH RECURSIVE b AS (SELECT page_id, html, {REST.format(u='url')} AS rest FROM pages),
 f AS (SELECT page_id, html, {PARTS} FROM b),
 g AS (SELECT page_id, html, h AS host, p AS path, {FORM} AS form FROM f),
 t AS (SELECT form, regexp_extract(unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\\b[^>]*\\b(?:canonical|refresh)\\b[^>]*>')), '(?i)(?:href\\s*=\\s*["'']?|url\\s*=\\s*[''"]?)([^"''>\\s]+)', 1) AS target FROM g WHERE form IS NOT NULL),
 tf AS (SELECT form, {PARTS} FROM (SELECT form, {REST.format(u='target')} AS rest FROM t)),
 e1 AS (SELECT DISTINCT form AS src, {FORM} AS dst FROM tf),
 e AS (SELECT src, dst FROM e1 WHERE dst IS NOT NULL UNION SELECT dst, src FROM e1 WHERE dst IS NOT NULL),
 r(node, reach) AS (SELECT form, form FROM (SELECT DISTINCT form FROM g WHERE form IS NOT NULL) UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.reach),
 c AS (SELECT node, min(reach) AS alias FROM r GROUP BY 1),
 rules(verdict, rh, rp) AS (VALUES {RULE_ROWS}),
 w AS (SELECT page_id, verdict, rh || rp AS rule FROM (SELECT page_id, verdict, rh, rp, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS n FROM g JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) WHERE n = 1),
 said AS (SELECT alias, bool_or(verdict = 'allow') AS allow FROM g JOIN w USING (page_id) JOIN c ON c.node = g.form GROUP BY 1)
SELECT g.page_id, host, path, w.rule, coalesce(w.verdict, CASE WHEN NOT coalesce(said.allow, true) THEN 'block' ELSE 'allow' END) AS verdict
FROM g LEFT JOIN w USING (page_id) LEFT JOIN c ON c.node = g.form LEFT JOIN said ON said.alias = c.alias""",
    "op6_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
 l AS (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS pos FROM d),
 k AS (SELECT doc_id, x, pos, {LINE_KEY.format(x='x')} AS key FROM l),
 o AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
 j AS (SELECT k.*, o.key IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o ON o.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
 sha256(coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
    "op9_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS_9.format(t='text')} AS w FROM documents),
 b AS (SELECT item_id, {WORDS_9.format(t='text')} AS w FROM benchmark),
 s AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS span
       FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS r(i) WHERE len(w) > 0),
 sizes AS (SELECT DISTINCT n FROM s),
 g AS (SELECT doc_id, i AS pos, n, array_to_string(w[i:i + n - 1], ' ') AS span FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
 h AS (SELECT g.doc_id, g.pos, g.n, s.item_id FROM g JOIN s ON s.n = g.n AND s.span = g.span),
 c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(pos, pos + n)) AS r(p) GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_ranked_search": f"""
WITH d AS (SELECT doc_id, {WORDS_11.format(t='text')} AS w FROM documents),
 g AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
 p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
 weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
 q AS (SELECT item_id, term, count(*) AS rep FROM (SELECT item_id, unnest({WORDS_11.format(t='text')}) AS term FROM benchmark) GROUP BY ALL),
 s AS (SELECT item_id, doc_id, CAST(sum(rep * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total)))) AS BIGINT) AS score
       FROM q JOIN p USING (term) JOIN weights USING (term), g GROUP BY ALL)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0) WHERE place <= 10""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 m AS (SELECT doc_id, part, CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INTEGER)
       + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(min(doc_id) OVER (PARTITION BY t) < doc_id AS INTEGER) AS mask FROM d),
 l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
 c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
 f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
 o AS (SELECT [a, b, c, d, e] AS fs FROM (SELECT a.name AS a, b.name AS b, c.name AS c, d.name AS d, e.name AS e FROM f a, f b, f c, f d, f e) WHERE len(list_distinct([a, b, c, d, e])) = 5),
 s AS (SELECT array_to_string(fs, '') AS filter_order, step, f.bit, f.name, CAST((SELECT coalesce(sum(x.bit), 0) FROM f x WHERE list_position(fs, x.name) < step) AS INTEGER) AS before
       FROM o, range(1, 6) AS r(step), f WHERE f.name = fs[step]),
 r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, name,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN bad ELSE 0 END) AS toxic_lost
       FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, name) AS BIGINT) AS shapley FROM r""",
    "op13_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
 f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f""",
}
