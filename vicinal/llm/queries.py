"""The queries ``opN_<name>`` of these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, html_text, knn_join, line_dedup, mixing, ngram_join, packing, quality, toxicity, url_filter
from .common import crc_of_id, table

URL_RULES: tuple[url_filter.Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Sites from which a line is boilerplate.
MIN_SITES = 10


def tokenizer_path(name: str) -> str:
    """Of a public tokenizer file, which is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup_lines(documents, MIN_SITES).select("doc_id", "text", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labelled outcome is the label of its id: bad when of low quality or toxic."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad")


def training_labels(spark: SparkSession, sf_dir: str, folds: int, held_out: int) -> DataFrame:
    """Labels of the documents outside the held-out fold."""
    return table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull() & (crc_of_id() % folds != held_out))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(documents, training_labels(spark, sf_dir, 5, 0))
    return scored.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", "predicted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(documents, training_labels(spark, sf_dir, 4, 2))
    return scored.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_fingerprints": op2_fingerprints,
    "op3_pack": op3_pack,
    "op4_main_text": op4_main_text,
    "op5_line_dedup": op5_line_dedup,
    "op6_top_k": op6_top_k,
    "op7_ngram_join": op7_ngram_join,
    "op8_url_filter": op8_url_filter,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
total AS (SELECT ceil(sqrt(count(*) / 50.0::DOUBLE))::BIGINT AS b FROM sized),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM per_source),
turned AS (
  SELECT *, row_number() OVER o AS turn,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM weighed WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
firsts AS (
  SELECT turn AS f_turn, remaining AS f_remaining, weights AS f_weights FROM turned
  WHERE NOT (3 * source_size::DOUBLE * weights::DOUBLE <= weight::DOUBLE * remaining::DOUBLE) ORDER BY turn LIMIT 1),
shares AS (
  SELECT source, source_size,
    CASE WHEN f_turn IS NULL OR turn < f_turn THEN (3 * source_size)::DOUBLE
         ELSE (weight * f_remaining)::BIGINT::DOUBLE / f_weights::DOUBLE END AS target,
    ('0x' || substr(md5('17:' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM turned LEFT JOIN firsts ON true),
placed AS (
  SELECT sized.*, length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)) AS band,
    coalesce((((doc_id % 1000003 + 1000003) % 1000003) * 7919) % greatest(b, 1), 0) AS bucket
  FROM sized, total),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY band, bucket, size, doc_id NULLS FIRST) AS rank FROM placed)
SELECT r.doc_id, r.size, s.source_size, s.target,
  CASE WHEN r.size > 0 THEN least(floor(rank * (target / source_size) + u) - floor((rank - 1) * (target / source_size) + u), 3)::BIGINT * r.size ELSE 0 END::BIGINT AS taken,
  CASE WHEN r.size > 0 THEN least(floor(rank * (target / source_size) + u) - floor((rank - 1) * (target / source_size) + u), 3)::BIGINT ELSE 0 END::BIGINT AS copies
FROM ranked r JOIN shares s ON r.source IS NOT DISTINCT FROM s.source
""",
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, source, text AS whole, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
common AS (
  SELECT trim(line, ' ' || chr(9) || chr(13)) AS key, min(doc_id) AS first FROM lines
  WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
marked AS (
  SELECT l.*, c.key IS NOT NULL AND l.doc_id IS DISTINCT FROM c.first AS goes
  FROM lines l LEFT JOIN common c ON trim(line, ' ' || chr(9) || chr(13)) = c.key)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT goes), '') AS text,
  count(*)::BIGINT AS n_lines, count(*) FILTER (goes)::BIGINT AS n_removed
FROM marked GROUP BY doc_id
""",
    "op6_top_k": r"""
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM whole q JOIN whole v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.x) = len(v.x)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op7_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common o JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * o.n >= 85 * (x.n + y.n - o.n)),
reached AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(r.least, w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least FROM reached GROUP BY 1) r USING (doc_id)
""",
    "op8_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule FROM parts),
seen AS (SELECT host, (quality = 0 OR toxic = 1) AS bad FROM parts LEFT JOIN labels ON page_id = doc_id),
hosts AS (
  SELECT host, array_to_string(string_split(regexp_replace(host, ':[0-9]*$', ''), '.')[-2:], '.') AS domain,
    string_split(regexp_replace(host, ':[0-9]*$', ''), '.')[-1] AS suffix, count(bad) AS n, count(*) FILTER (bad) AS b FROM seen GROUP BY host),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(b)::BIGINT AS b FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(b)::BIGINT AS b FROM domains GROUP BY suffix),
moments AS (
  SELECT level, count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS nn, sum(b)::DOUBLE AS b, sum(b * b / n::DOUBLE) AS bb
  FROM (SELECT 1 AS level, n, b FROM hosts UNION ALL SELECT 2, n, b FROM domains UNION ALL SELECT 3, n, b FROM suffixes) WHERE n > 0 GROUP BY level),
variances AS (SELECT level, k, n, (bb - b * b / n) / (k - 1) AS between_, (b - bb) / (n - k) AS within_, (n - nn / n) / (k - 1) AS typical FROM moments WHERE k >= 2 AND n > k),
rhos AS (SELECT level, CASE WHEN between_ + (typical - 1) * within_ > 0 THEN (between_ - within_) / (between_ + (typical - 1) * within_) ELSE 0 END AS rho FROM variances),
k AS (
  SELECT coalesce(max(s) FILTER (level = 1), 200.0) AS k1, coalesce(max(s) FILTER (level = 2), 200.0) AS k2, coalesce(max(s) FILTER (level = 3), 200.0) AS k3
  FROM (SELECT level, CASE WHEN rho <= 0 THEN 200.0::DOUBLE ELSE least(200.0::DOUBLE, greatest(2.0::DOUBLE, 1 / rho - 1)) END AS s FROM rhos)),
m3 AS (SELECT suffix, (b + k3 * (SELECT (sum(b) + 1)::DOUBLE / (sum(n) + 2)::DOUBLE FROM suffixes)) / (n + k3) AS m FROM suffixes, k),
m2 AS (SELECT domain, (b + k2 * m) / (n + k2) AS m FROM domains JOIN m3 USING (suffix), k),
m1 AS (SELECT host, n, b, (b + k1 * m) / (n + k1) AS m, k1 FROM hosts JOIN m2 USING (domain), k),
known AS (SELECT host, n, b, m - 1.645 * sqrt(m * (1 - m) / (n + k1 + 1)) > 0.5 AS bad_host FROM m1)
SELECT page_id, r.host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bad_host THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(n, 0)::BIGINT AS n_labelled, coalesce(b, 0)::BIGINT AS n_bad
FROM ruled r LEFT JOIN known ON r.host = known.host
""",
}
