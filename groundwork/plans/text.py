"""Queries over text columns: normalisation, fingerprints, duplicates, cleaning, chunks, numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from groundwork.functions import names, redact, text, urls
from groundwork.operators import chunks, dedup, numbers
from groundwork.plans.derive import raw, table
from groundwork.sources.raw import manual, split_good


def p1_normalize(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.normalize_text(x).alias("norm"), text.normalize_optional(x).isNull().alias("blank"))


_NORM = r"trim(regexp_replace(regexp_replace(coalesce({0}, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g'))"
_NORM_TEXT = _NORM.format("text")
_HASH = f"sha256(lang || chr(31) || chr(31) || chr(31) || chr(31) || {_NORM_TEXT})"


def p3_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(text.fold_for_matching(F.col("text")).cast("binary"), 256).alias("folded_sha256"))


def k1_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select("doc_id", F.col("lang").alias("source"), F.when(F.col("doc_id") % 3 == 0, F.lit("https://a.example/x")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" id "), "doc_id")).alias("source_id"), F.col("text").alias("raw_text"))
    return dedup.fingerprinted(r).select("doc_id", "source_id", "content_hash", "content_hash_version", "discriminating", "needs_manual_review", "error_type")


def k2_corpus_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Which documents repeat an earlier document of the same source."""
    out = dedup.within_batch(dedup.fingerprinted(raw(spark, d)))
    return out.select(F.col("seq").alias("doc_id"), F.when(F.col("kept"), "new").otherwise("duplicate").alias("outcome"), "duplicate_of", "deduplicated_by")


def k2_event_identity(spark: SparkSession, d: str) -> DataFrame:
    """First events of each (type, user), in order of time and id."""
    e = table(spark, d, "events")
    first = e.groupBy("event_type", "user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"), F.count("*").alias("n"))
    return first


def k2_against_stored(spark: SparkSession, d: str) -> DataFrame:
    """Odd documents against the even ones, which count as stored; every fourth of those is completed."""
    rows = dedup.fingerprinted(raw(spark, d))
    stored = rows.filter("seq % 2 = 0").select(F.col("seq").cast("string").alias("id"), "source", "source_id", "content_hash", "content_hash_version", F.timestamp_seconds("seq").alias("created_at"), F.when(F.col("seq") % 4 == 0, "completed").otherwise("failed").alias("status"), F.when(F.col("seq") % 4 == 0, F.lit("a")).alias("current_analysis_id"))
    return dedup.against_stored(rows.filter("seq % 2 = 1"), stored).select(F.col("seq").alias("doc_id"), "outcome", "matched_id", "matched_by")


def d13_migration(spark: SparkSession, d: str) -> DataFrame:
    """Documents as contents of the old version; every second has an id that was derived from the old fingerprint."""
    c = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("source"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("hash:"), F.lpad(F.col("doc_id").cast("string"), 16, "0"))).otherwise(F.col("doc_id").cast("string")).alias("source_id"), *(F.lit(None).cast("string").alias(x) for x in ("title", "author", "description")), F.col("text").alias("raw_text"), F.lit("old").alias("content_hash"), F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1).alias("content_hash_version"), F.timestamp_seconds("doc_id").alias("created_at"))
    plan, _ = dedup.migrate_hashes(c)
    return plan.select("id", "new_source_id", "new_hash", "moves", "conflict")


def a12_migration_report(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("source"), F.concat(F.lit("hash:"), F.lpad(F.col("doc_id").cast("string"), 16, "0")).alias("source_id"), *(F.lit(None).cast("string").alias(x) for x in ("title", "author", "description")), F.col("text").alias("raw_text"), F.lit("old").alias("content_hash"), F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1).alias("content_hash_version"), F.timestamp_seconds("doc_id").alias("created_at"))
    return dedup.migrate_hashes(c)[1]


def s1_strict_source(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, " ").otherwise("web").alias("source"), F.col("page_id").cast("string").alias("source_id"), F.col("url").alias("source_url"), F.when(F.col("page_id") % 7 == 0, "film").otherwise("article").alias("media_type"))
    good, bad = split_good(p)
    return good.select("page_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("page_id", "reason"))


def s2_manual(spark: SparkSession, d: str) -> DataFrame:
    m = manual(table(spark, d, "conversations").select(F.when(F.col("turn") == 0, F.lit(" ")).otherwise(F.col("text")).alias("raw_text"), F.col("role").alias("author")))
    return m.groupBy("source", "source_id", "source_url", "author", "media_type", "is_empty").agg(F.count("*").alias("n"))


def p12_clean(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", text.clean_source_text(F.concat(F.col("text"), F.lit("\r\nend\n\n\n\nend\n end"))).alias("c"))
    return c.select("doc_id", "c.text", "c.newline_normalized", "c.duplicate_lines_removed", "c.blank_lines_collapsed")


def _budgeted(spark: SparkSession, d: str, raw_text: Column) -> DataFrame:
    r = table(spark, d, "documents").select("doc_id", raw_text.alias("raw_text"), F.col("text").alias("transcript"), F.when(F.col("doc_id") % 2 == 0, F.reverse("text")).alias("ocr_text"))
    return chunks.prepare(r, 3000, 500, 3200).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "transcript_chars", "ocr_chars", "transcript_truncated", "ocr_truncated", "total_truncated")


def p13_budget(spark: SparkSession, d: str) -> DataFrame:
    """Over 50 code points of raw text, as its SQL has them; p13_budget_whole takes whole texts."""
    return _budgeted(spark, d, F.substring("text", 1, 50))


def p13_budget_whole(spark: SparkSession, d: str) -> DataFrame:
    return _budgeted(spark, d, F.col("text"))


def a11_cleaning_totals(spark: SparkSession, d: str) -> DataFrame:
    p = chunks.prepare(table(spark, d, "documents").select("doc_id", F.col("text").alias("raw_text")))
    return p.agg(F.count("*").alias("n"), F.sum("duplicate_lines_removed").alias("duplicate_lines"), F.sum("blank_lines_collapsed").alias("blank_lines"), F.count_if("total_truncated").alias("n_truncated"), F.sum("raw_chars").alias("chars"))


def w6_adjacent_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    before = F.lag("line").over(W.partitionBy("doc_id").orderBy("at"))
    return lines.withColumn("same", (F.trim("line") != "") & (F.trim("line") == F.trim(before))).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("same").alias("n_repeated"))


def p16_sentences(spark: SparkSession, d: str) -> DataFrame:
    told = lambda ss: F.struct(F.size(text.without_blanks(ss)).cast("long").alias("n_sentences"), (F.array_join(ss, "") == F.col("text")).alias("lossless"))
    # Inlined, so that a struct with two fields isn't made once for each of them.
    return table(spark, d, "documents").select("doc_id", F.inline(F.array(text.let(text.split_sentences(F.col("text")), told))))


def k3_chunks(spark: SparkSession, d: str) -> DataFrame:
    p = chunks.prepare(table(spark, d, "documents").select("doc_id", F.col("text").alias("raw_text")))
    return chunks.chunk_table(p, "doc_id", 2000)


def g2_numbers(spark: SparkSession, d: str) -> DataFrame:
    return numbers.extract_numbers(table(spark, d, "documents"), ["doc_id"], "text").withColumn("value", F.col("value").cast("double"))


def g2_arabic(spark: SparkSession, d: str) -> DataFrame:
    return numbers.arabic_numbers(table(spark, d, "documents"), ["doc_id"], "text").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("value").cast("double").alias("largest"))


def p8_url_verdict(spark: SparkSession, d: str) -> DataFrame:
    u = F.when(F.col("page_id") % 11 == 0, F.regexp_replace("url", "^https?", "ftp")).when(F.col("page_id") % 13 == 0, F.lit("no url")).otherwise(F.col("url"))
    p = table(spark, d, "pages").select("page_id", u.alias("url"))
    v = urls.url_verdict(F.col("url"), ("example.com", "example.net"))
    parts = urls.url_parts(F.col("url"))
    return p.select("page_id", v.alias("verdict"), F.when(v.isNull(), parts["host"]).alias("host"), F.when(v.isNull(), parts["path"]).alias("path"), F.when(v.isNull(), urls.normalized_url(F.col("url"))).alias("normalized"))


def p9_allow_list(spark: SparkSession, d: str) -> DataFrame:
    """Hosts against a table of allowed ones, by an equi join of their suffixes."""
    p = table(spark, d, "pages").select("page_id", urls.url_parts(F.col("url"))["host"].alias("host"))
    listed = table(spark, d, "region").select(F.when(F.col("r_regionkey") == 0, "example.com").when(F.col("r_regionkey") == 1, "Example.NET.").otherwise(F.col("r_name")).alias("host"))
    return urls.allowed_by_table(p, "host", listed).select("page_id", "host", "allowed")


def p10_first_url(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", urls.first_url(F.concat(F.lit("见 "), F.col("url"), F.lit("。）后面"))).alias("found"), urls.first_url(F.substring("html", 1, 20)).alias("none"))


def p10_first_url_whole(spark: SparkSession, d: str) -> DataFrame:
    """The first URL in each page's whole html."""
    return table(spark, d, "pages").select("page_id", urls.first_url(F.col("html")).alias("found"))


def p11_platform_id(spark: SparkSession, d: str) -> DataFrame:
    u = F.concat(F.lit("https://"), F.when(F.col("page_id") % 3 == 0, "www.douyin.com").when(F.col("page_id") % 3 == 1, "fakedouyin.com").otherwise("iesdouyin.com"), F.when(F.col("page_id") % 2 == 0, "/video/").otherwise("/x?a=1&modal_id="), (F.col("page_id") + 99900).cast("string"))
    p = table(spark, d, "pages").select("page_id", u.alias("u"))
    return p.select("page_id", urls.platform_id(F.col("u")).alias("platform_id"), urls.platform_of(urls.url_parts(F.col("u"))["host"]).alias("platform"), urls.canonical_url(F.col("u")).alias("canonical"))


def _named(spark: SparkSession, d: str, title: Column) -> DataFrame:
    t = F.when(F.col("doc_id") % 10 == 0, F.lit(" ..:?")).when(F.col("doc_id") % 10 == 1, F.lit("con.txt")).otherwise(F.concat(F.lit(' a/b: "'), title))
    return table(spark, d, "documents").select("doc_id", names.file_name(t, F.concat(F.lit("id-000-"), F.col("doc_id").cast("string"))).alias("name"))


def p19_file_names(spark: SparkSession, d: str) -> DataFrame:
    """Over 100 code points of text, as its SQL has them; p19_file_names_whole takes whole texts."""
    return _named(spark, d, F.substring("text", 1, 100))


def p19_file_names_whole(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d, F.col("text"))


def p20_fences(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("x "), F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int")), F.lit(" y ` \n "))
    return table(spark, d, "documents").select("doc_id", names.fenced(body).alias("block"))


def p21_redact(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[\"']", "").alias("text"))
    return redact.redact_credentials(r, ["text"]).select("doc_id", "redaction_hits", F.length("text").alias("n_chars"))


def p22_mask_columns(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("user_text"), F.col("text").alias("api_key_hint"), F.lit("plain").alias("content_id"))
    return redact.mask_columns(r, show_content=True)


def p24_times(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts")
    return e.select("event_id", names.utc_text(F.col("ts")).alias("written"), (names.utc_time(names.utc_text(F.col("ts"))) <= names.cutoff(F.expr("TIMESTAMP '2024-01-15 00:00:00'"), 900)).alias("stale"))


def p26_paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("a/../../b"), "page_id")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/abs"), "page_id")).when(F.col("page_id") % 4 == 2, F.concat(F.lit("a/b/../c"), "page_id")).otherwise("~x").alias("path"))
    return p.select("page_id", names.path_inside(F.col("path")).alias("inside"))


QUERIES = {f.__name__: f for f in (p1_normalize, p3_fold, k1_fingerprints, k2_corpus_dedup, k2_event_identity, k2_against_stored, d13_migration, a12_migration_report, s1_strict_source, s2_manual, p12_clean, p13_budget, p13_budget_whole, a11_cleaning_totals, w6_adjacent_lines, p16_sentences, k3_chunks, g2_numbers, g2_arabic, p8_url_verdict, p9_allow_list, p10_first_url, p10_first_url_whole, p11_platform_id, p19_file_names, p19_file_names_whole, p20_fences, p21_redact, p22_mask_columns, p24_times, p26_paths)}

_CLEAN = r"""
l AS (SELECT doc_id, string_split(replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM {src}),
j AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, ls FROM l),
k AS (SELECT doc_id, i, CASE WHEN trim(line, chr(9) || chr(32)) = '' THEN '' ELSE line END AS line,
  trim(line, chr(9) || chr(32)) = '' AND i > 2 AND trim(coalesce(ls[i - 1], 'x'), chr(9) || chr(32)) = '' AND trim(coalesce(ls[i - 2], 'x'), chr(9) || chr(32)) = '' AS blank,
  trim(line, chr(9) || chr(32)) <> '' AND i > 1 AND trim(coalesce(ls[i - 1], ''), chr(9) || chr(32)) = trim(line, chr(9) || chr(32)) AS twice FROM j),
cleaned AS (SELECT doc_id, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT blank AND NOT twice), ''), chr(10)) AS text, count(*) FILTER (WHERE twice) AS dup, count(*) FILTER (WHERE blank) AS blk FROM k GROUP BY doc_id)"""

ORACLE_SQL = {
    "p1_normalize": f"SELECT doc_id, {_NORM_TEXT} AS norm, {_NORM_TEXT} = '' AS blank FROM documents",
    "p3_fold": "SELECT doc_id, sha256(replace(lower(text), 'ß', 'ss')) AS folded_sha256 FROM documents",
    "k1_fingerprints": f"SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'id ' || doc_id ELSE 'hash:' || left({_HASH}, 16) END AS source_id, {_HASH} AS content_hash, 2 AS content_hash_version, {_NORM_TEXT} <> '' AS discriminating, doc_id % 3 <> 1 AS needs_manual_review, CASE WHEN doc_id % 3 <> 1 THEN 'SOURCE_ID_RESOLUTION_FAILED' END AS error_type FROM documents",
    "k2_corpus_dedup": f"WITH h AS (SELECT doc_id, CASE WHEN {_NORM_TEXT} = '' THEN doc_id ELSE min(doc_id) OVER (PARTITION BY lang, {_NORM_TEXT}) END AS f FROM documents) SELECT doc_id, CASE WHEN f = doc_id THEN 'new' ELSE 'duplicate' END AS outcome, CASE WHEN f <> doc_id THEN f END AS duplicate_of, CASE WHEN f <> doc_id THEN 'content_hash' END AS deduplicated_by FROM h",
    "k2_event_identity": "SELECT event_type, user_id, arg_min(event_id, (ts, event_id)) AS first_id, count(*) AS n FROM events GROUP BY event_type, user_id",
    "k2_against_stored": f"""WITH h AS (SELECT doc_id, lang, {_HASH} AS hash FROM documents), s AS (SELECT lang, hash, doc_id, doc_id % 4 = 0 AS done, row_number() OVER (PARTITION BY lang, hash ORDER BY (doc_id % 4 = 0) DESC, doc_id) AS n FROM h WHERE doc_id % 2 = 0)
SELECT h.doc_id, CASE WHEN s.doc_id IS NULL THEN 'new' WHEN done THEN 'duplicate' ELSE 'reuse' END AS outcome, CAST(s.doc_id AS VARCHAR) AS matched_id, CASE WHEN s.doc_id IS NOT NULL THEN 'content_hash' END AS matched_by FROM h LEFT JOIN s ON s.lang = h.lang AND s.hash = h.hash AND s.n = 1 WHERE h.doc_id % 2 = 1""",
    "d13_migration": f"""WITH c AS (SELECT doc_id, lang, {_HASH} AS h, CASE WHEN doc_id % 2 = 0 THEN 'hash:' || lpad(CAST(doc_id AS VARCHAR), 16, '0') ELSE CAST(doc_id AS VARCHAR) END AS sid FROM documents),
p AS (SELECT *, CASE WHEN sid LIKE 'hash:%' THEN 'hash:' || left(h, 16) ELSE sid END AS nid FROM c WHERE doc_id % 5 <> 0),
q AS (SELECT *, nid <> sid AS moves, CASE WHEN nid <> sid THEN row_number() OVER (PARTITION BY lang, nid, nid <> sid ORDER BY doc_id) END AS n FROM p)
SELECT CAST(q.doc_id AS VARCHAR) AS id, nid AS new_source_id, h AS new_hash, moves, coalesce(moves AND (n > 1 OR EXISTS (SELECT 1 FROM c WHERE c.lang = q.lang AND c.sid = q.nid AND c.doc_id <> q.doc_id)), false) AS conflict FROM q""",
    "a12_migration_report": f"""WITH p AS (SELECT doc_id, row_number() OVER (PARTITION BY lang, left({_HASH}, 16) ORDER BY doc_id) AS n FROM documents WHERE doc_id % 5 <> 0)
SELECT (SELECT count(*) FROM documents) AS scanned, (SELECT count(*) FROM documents WHERE doc_id % 5 = 0) AS up_to_date, count(*) AS planned, count(*) FILTER (WHERE n > 1) AS conflicts, count(*) FILTER (WHERE n = 1) AS ids_moved FROM p""",
    "s1_strict_source": "SELECT page_id, nullif(concat_ws(';', CASE WHEN page_id % 5 = 0 THEN 'blank:source' END, CASE WHEN page_id % 7 = 0 THEN 'enum:media_type' END), '') AS reason FROM pages",
    "s2_manual": "SELECT 'manual' AS source, '' AS source_id, '' AS source_url, role AS author, 'text' AS media_type, turn = 0 OR trim(text) = '' AS is_empty, count(*) AS n FROM conversations GROUP BY role, 6",
    "p12_clean": "WITH " + _CLEAN.format(text="text || chr(13) || chr(10) || 'end' || chr(10) || chr(10) || chr(10) || chr(10) || 'end' || chr(10) || ' end'", src="documents") + " SELECT doc_id, text, true AS newline_normalized, dup AS duplicate_lines_removed, blk AS blank_lines_collapsed FROM cleaned",
    "p13_budget": "WITH parts AS (SELECT doc_id, concat_ws(chr(10), nullif(left(text, 50), ''), nullif(left(text, 3000), ''), CASE WHEN doc_id % 2 = 0 THEN nullif(left(reverse(text), 500), '') END) AS text FROM documents), " + _CLEAN.format(text="text", src="parts") + " SELECT c.doc_id, sha256(left(c.text, 3200)) AS text_sha256, length(d.text) AS transcript_chars, CASE WHEN c.doc_id % 2 = 0 THEN length(d.text) ELSE 0 END AS ocr_chars, length(d.text) > 3000 AS transcript_truncated, c.doc_id % 2 = 0 AND length(d.text) > 500 AS ocr_truncated, length(c.text) > 3200 AS total_truncated FROM cleaned c JOIN documents d USING (doc_id)",
    "a11_cleaning_totals": "WITH " + _CLEAN.format(text="text", src="documents") + " SELECT count(*) AS n, CAST(sum(dup) AS BIGINT) AS duplicate_lines, CAST(sum(blk) AS BIGINT) AS blank_lines, count(*) FILTER (WHERE length(c.text) > 24000) AS n_truncated, CAST(sum(length(d.text)) AS BIGINT) AS chars FROM cleaned c JOIN documents d USING (doc_id)",
    "w6_adjacent_lines": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM l) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE trim(line) <> '' AND trim(line) = trim(before)) AS n_repeated FROM b GROUP BY doc_id",
    "g2_arabic": "WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(\\.[0-9]+)?')) AS v FROM documents) SELECT doc_id, count(*) AS n, max(CAST(TRY_CAST(v AS DECIMAL(38,10)) AS DOUBLE)) AS largest FROM n GROUP BY doc_id",
    "p8_url_verdict": r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN regexp_replace(url, '^https?', 'ftp') WHEN page_id % 13 = 0 THEN 'no url' ELSE url END AS u FROM pages),
q AS (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s, lower(regexp_extract(u, '^[A-Za-z]+://([^/?#:]*)', 1)) AS h, regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '\?([^#]*)', 1) AS qs FROM p),
v AS (SELECT *, CASE WHEN s = '' THEN 'INVALID_URL' WHEN s NOT IN ('http', 'https') THEN 'UNSUPPORTED_URL_SCHEME' WHEN h = '' THEN 'INVALID_URL' WHEN NOT (h IN ('example.com', 'example.net') OR h LIKE '%.example.com' OR h LIKE '%.example.net') THEN 'DOMAIN_NOT_ALLOWED' END AS verdict FROM q)
SELECT page_id, verdict, CASE WHEN verdict IS NULL THEN h END AS host, CASE WHEN verdict IS NULL THEN path END AS path, CASE WHEN verdict IS NULL THEN s || '://' || h || path || CASE WHEN qs <> '' THEN '?' || qs ELSE '' END END AS normalized FROM v""",
    "p9_allow_list": "SELECT page_id, h AS host, h IN ('example.com', 'example.net') OR h LIKE '%.example.com' OR h LIKE '%.example.net' AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS h FROM pages)",
    "p10_first_url": r"SELECT page_id, nullif(regexp_replace(regexp_extract('见 ' || url || '。）后面', 'https?://[A-Za-z0-9._~:/?#\[\]@!$&''()*+,;=%-]+'), '[.,;''\x22)\]]+$', ''), '') AS found, CAST(NULL AS VARCHAR) AS none FROM pages",
    "p10_first_url_whole": r"SELECT page_id, nullif(regexp_replace(regexp_extract(html, 'https?://[A-Za-z0-9._~:/?#\[\]@!$&''()*+,;=%-]+'), '[.,;''\x22)\]]+$', ''), '') AS found FROM pages",
    "p11_platform_id": "SELECT page_id, CASE WHEN page_id + 99900 >= 100000 THEN CAST(page_id + 99900 AS VARCHAR) END AS platform_id, CASE WHEN page_id % 3 <> 1 THEN 'douyin' END AS platform, CASE WHEN page_id % 3 <> 1 AND page_id + 99900 >= 100000 THEN 'https://www.douyin.com/video/' || (page_id + 99900) END AS canonical FROM pages",
    "p19_file_names": r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN ' ..:?' WHEN doc_id % 10 = 1 THEN 'con.txt' ELSE ' a/b: "' || left(text, 100) END AS t FROM documents),
a AS (SELECT doc_id, trim(trim(trim(regexp_replace(regexp_replace(t, '[\\/:*?"<>|\x00-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g')), '.')) AS t FROM t),
b AS (SELECT doc_id, trim(trim(trim(left(t, 80)), '.')) AS t FROM a), c AS (SELECT doc_id, CASE WHEN t <> '' THEN t ELSE left('id-000-' || doc_id, 8) END AS t FROM b)
SELECT doc_id, CASE WHEN upper(split_part(t, '.', 1)) = 'CON' THEN '_' || t ELSE t END AS name FROM c""",
    "p20_fences": "SELECT doc_id, repeat('`', greatest(3, doc_id % 6 + 1)) || 'text' || chr(10) || 'x ' || repeat('`', doc_id % 6) || ' y `' || chr(10) || repeat('`', greatest(3, doc_id % 6 + 1)) AS block FROM documents",
    "p24_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS written, date_trunc('second', ts) <= TIMESTAMP '2024-01-14 23:45:00' AS stale FROM events",
    "p26_paths": "SELECT page_id, page_id % 4 = 2 AS inside FROM pages",
}
ORACLE_SQL["p13_budget_whole"] = ORACLE_SQL["p13_budget"].replace("nullif(left(text, 50), '')", "nullif(text, '')")
ORACLE_SQL["p19_file_names_whole"] = ORACLE_SQL["p19_file_names"].replace("left(text, 100)", "text")
