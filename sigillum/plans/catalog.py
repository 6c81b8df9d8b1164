"""The jobs as queries over the shared test tables, each with its SQL.

Those tables hold no manifest, so the queries derive one from whole tables in
the same query. Where a row's number decides something, it decides which fault
is planted in its entry; every row is digested, joined and reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import digest, sha256
from ..operators.audit import audit, audit_summary
from ..operators.crosscheck import crosscheck
from ..sources.manifest import entries, parse_manifest

# Stated, so that no file is opened to find them out.
SCHEMAS = {
    "pages": "page_id bigint, url string, html string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# --- manifest scan -----------------------------------------------------------


def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page listed properly, twice, and once in each way that is not an entry."""
    hashed = digest(_table(spark, sf_dir, "pages"), "html").select("digest", "url")
    lines = """explode(array(
        concat(digest, '  ', url),
        concat(digest, '  ', url),
        concat(digest, ' ', url),
        concat(digest, ' *', url),
        concat(upper(digest), '  ', url),
        concat(digest, '  '),
        concat(' ', digest, '  ', url),
        concat(digest, '0  ', url),
        url,
        '  '
    ))"""
    return parse_manifest(hashed.select(F.expr(lines).alias("value")))


MANIFEST_SCAN_SQL = r"""
WITH hashed AS (SELECT sha256(html) AS digest, url FROM pages),
lines AS (
  SELECT unnest([
    digest || '  ' || url,
    digest || '  ' || url,
    digest || ' ' || url,
    digest || ' *' || url,
    upper(digest) || '  ' || url,
    digest || '  ',
    ' ' || digest || '  ' || url,
    digest || '0  ' || url,
    url,
    '  ']) AS line
  FROM hashed
)
SELECT CASE WHEN regexp_matches(line, '^[0-9a-f]{64}  .+$')
            THEN regexp_extract(line, '^([0-9a-f]{64})  (.+)$', 1) END AS digest,
       CASE WHEN regexp_matches(line, '^[0-9a-f]{64}  .+$')
            THEN regexp_extract(line, '^([0-9a-f]{64})  (.+)$', 2) END AS file_name,
       line,
       NOT regexp_matches(line, '^[0-9a-f]{64}  .+$') AS is_malformed
FROM lines
WHERE trim(line) <> ''
"""


def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(manifest_scan(spark, sf_dir))


MANIFEST_ENTRIES_SQL = f"""
SELECT DISTINCT digest, file_name FROM ({MANIFEST_SCAN_SQL}) AS scanned WHERE NOT is_malformed
"""


# --- artifact digest ---------------------------------------------------------


def artifact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(_table(spark, sf_dir, "pages"), "html").select("page_id", "digest")


ARTIFACT_DIGEST_SQL = "SELECT page_id, sha256(html) AS digest FROM pages"


def document_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(_table(spark, sf_dir, "documents"), "text").select("doc_id", "digest")


DOCUMENT_DIGEST_SQL = "SELECT doc_id, sha256(text) AS digest FROM documents"


# --- integrity audit ---------------------------------------------------------


def _seeded_manifest(pages: DataFrame) -> DataFrame:
    """Entries for `pages` with every kind of fault, from one scan of the table."""
    content = F.expr("CASE WHEN page_id % 10 = 3 THEN concat(html, 'x') ELSE html END")
    planted = """explode(array(
        CASE WHEN page_id % 10 <> 7 THEN
            struct(page_id, CASE WHEN page_id % 50 <> 8 THEN digest END AS digest) END,
        CASE WHEN page_id % 10 = 5 THEN struct(page_id + 1000000 AS page_id, digest) END,
        CASE WHEN page_id % 50 = 1 THEN struct(page_id, sha2(url, 256) AS digest) END,
        CASE WHEN page_id % 50 = 2 THEN struct(page_id, digest) END
    ))"""
    return (
        pages.select("page_id", "url", sha256(content).alias("digest"))
        .select(F.expr(planted).alias("entry"))
        .where("entry IS NOT NULL")
        .select("entry.page_id", "entry.digest")
    )


def integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    content = F.expr("CASE WHEN page_id % 50 <> 4 THEN html END")
    artifacts = pages.select("page_id", sha256(content).alias("digest"))
    return audit(_seeded_manifest(pages), artifacts, "page_id")


INTEGRITY_AUDIT_SQL = """
WITH manifest AS (
  SELECT page_id,
         CASE WHEN page_id % 50 <> 8
              THEN sha256(CASE WHEN page_id % 10 = 3 THEN html || 'x' ELSE html END) END AS digest
  FROM pages WHERE page_id % 10 <> 7
  UNION ALL
  SELECT page_id + 1000000, sha256(html) FROM pages WHERE page_id % 10 = 5
  UNION ALL
  SELECT page_id, sha256(url) FROM pages WHERE page_id % 50 = 1
  UNION ALL
  SELECT page_id, sha256(html) FROM pages WHERE page_id % 50 = 2
),
listed AS (
  SELECT page_id, min(digest) AS expected, count(DISTINCT digest) > 1 AS is_conflict
  FROM manifest GROUP BY page_id
),
artifacts AS (
  SELECT page_id, CASE WHEN page_id % 50 = 4 THEN NULL ELSE sha256(html) END AS actual
  FROM pages
)
SELECT coalesce(l.page_id, a.page_id) AS page_id, l.expected, a.actual,
       CASE WHEN l.page_id IS NULL THEN 'UNLISTED'
            WHEN l.expected IS NULL THEN 'NO_DIGEST'
            WHEN l.is_conflict THEN 'CONFLICT'
            WHEN a.actual IS NULL THEN 'MISSING'
            WHEN a.actual = l.expected THEN 'OK'
            ELSE 'MISMATCH' END AS status
FROM listed l FULL OUTER JOIN artifacts a ON l.page_id = a.page_id
"""


def integrity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_summary(integrity_audit(spark, sf_dir))


INTEGRITY_SUMMARY_SQL = f"""
SELECT status, count(*) AS n FROM ({INTEGRITY_AUDIT_SQL}) AS audited GROUP BY status
"""


def repeated_key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many artifacts under each key: documents against one digest per source."""
    hashed = digest(_table(spark, sf_dir, "documents"), "text").select("source", "digest")
    manifest = hashed.groupBy("source").agg(F.min("digest").alias("digest"))
    return audit(manifest, hashed, "source")


REPEATED_KEY_AUDIT_SQL = """
WITH artifacts AS (SELECT source, sha256(text) AS actual FROM documents),
listed AS (SELECT source, min(actual) AS expected FROM artifacts GROUP BY source)
SELECT a.source, l.expected, a.actual,
       CASE WHEN l.source IS NULL THEN 'UNLISTED'
            WHEN l.expected IS NULL THEN 'NO_DIGEST'
            WHEN a.actual IS NULL THEN 'MISSING'
            WHEN a.actual = l.expected THEN 'OK'
            ELSE 'MISMATCH' END AS status
FROM artifacts a LEFT JOIN listed l ON l.source = a.source
"""


# --- published digests -------------------------------------------------------


def published_digest_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages publishing their own digest, listed under two names, and a foreign one."""
    pages = _table(spark, sf_dir, "pages")
    hashed = digest(pages, "html")

    inserted = """concat(
        html, '<code>', digest, '</code>',
        CASE WHEN page_id % 4 = 0 THEN concat('<code>', sha2(url, 256), '</code>') ELSE '' END
    )"""
    published = hashed.select("page_id", F.expr(inserted).alias("html"))
    entry = """explode(array(
        struct(digest, url AS file_name),
        struct(digest, concat('page-', page_id) AS file_name)
    )) AS entry"""
    manifest = hashed.select(F.expr(entry)).select("entry.digest", "entry.file_name")
    return crosscheck(published, manifest, "page_id")


PUBLISHED_DIGEST_CROSSCHECK_SQL = r"""
WITH published AS (
  SELECT page_id,
         unnest(regexp_extract_all(
           html || '<code>' || sha256(html) || '</code>' ||
           CASE WHEN page_id % 4 = 0 THEN '<code>' || sha256(url) || '</code>' ELSE '' END,
           '\b([0-9a-f]{64})\b', 1)) AS published
  FROM pages
),
manifest AS (
  SELECT sha256(html) AS digest, url AS file_name FROM pages
  UNION ALL
  SELECT sha256(html), 'page-' || page_id FROM pages
),
names AS (SELECT digest, min(file_name) AS file_name FROM manifest GROUP BY digest)
SELECT p.page_id, p.published, n.file_name, n.digest IS NOT NULL AS in_manifest
FROM published p LEFT JOIN names n ON n.digest = p.published
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "manifest_scan": manifest_scan,
    "manifest_entries": manifest_entries,
    "artifact_digest": artifact_digest,
    "document_digest": document_digest,
    "integrity_audit": integrity_audit,
    "integrity_summary": integrity_summary,
    "repeated_key_audit": repeated_key_audit,
    "published_digest_crosscheck": published_digest_crosscheck,
}

ORACLE_SQL: dict[str, str] = {
    "manifest_scan": MANIFEST_SCAN_SQL,
    "manifest_entries": MANIFEST_ENTRIES_SQL,
    "artifact_digest": ARTIFACT_DIGEST_SQL,
    "document_digest": DOCUMENT_DIGEST_SQL,
    "integrity_audit": INTEGRITY_AUDIT_SQL,
    "integrity_summary": INTEGRITY_SUMMARY_SQL,
    "repeated_key_audit": REPEATED_KEY_AUDIT_SQL,
    "published_digest_crosscheck": PUBLISHED_DIGEST_CROSSCHECK_SQL,
}
