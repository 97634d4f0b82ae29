"""Queries over the seven tables: reads, writes as new table versions, entities and merges, grounding, redirects, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators import entities as ent
from groundwork.operators import grounding, numbers, redirects, warehouse
from groundwork.plans import derive
from groundwork.plans.derive import ALIASES_SQL, ANALYSES_SQL, CLAIMS_SQL, CONTENTS_SQL, LINKS_SQL, SOURCES_SQL, table
from groundwork.sources.pages import page_verdict


def as_of() -> Column:
    return F.lit("2024-01-01 00:20:00").cast("timestamp")


def f1_by_status(spark: SparkSession, d: str) -> DataFrame:
    return derive.contents(spark, d).filter("status = 'completed' and source = 'en'").select("id", "source", "status")


def f2_stale(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.stale(derive.contents(spark, d), as_of()).select("id", "created_at")


def a1_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return derive.contents(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def a2_analyses_per_content(spark: SparkSession, d: str) -> DataFrame:
    return derive.analyses(spark, d).groupBy("content_id").agg(F.count("*").alias("n"))


def j1_identity(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an odd id, and ten more ids, against the stored even ones: those that are new."""
    c = derive.contents(spark, d)
    asked = c.select("source", F.when(F.col("doc_id") % 3 == 0, F.col("source_id")).otherwise((F.col("doc_id") + 1).cast("string")).alias("source_id"))
    return asked.join(c.filter("doc_id % 2 = 0").select("source", "source_id"), ["source", "source_id"], "left_anti")


def j10_current_analysis(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.current_analyses(derive.contents(spark, d), derive.analyses(spark, d)).select("id", "current_analysis_id", "analysis_summary")


def j11_listing(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.listing(derive.contents(spark, d), derive.analyses(spark, d), limit=150, offset=10).select("id", "source", "status", "n_analyses")


def j11_listing_all(spark: SparkSession, d: str) -> DataFrame:
    """Every content with its number of analyses: the listing without a page."""
    counts = derive.analyses(spark, d).groupBy("content_id").agg(F.count("*").alias("n"))
    c = derive.contents(spark, d)
    return c.join(counts, c["id"] == counts["content_id"], "left").select("id", "status", F.coalesce("n", F.lit(0)).alias("n_analyses"))


def l1_order_page(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(200).select("o_orderkey", "o_orderstatus")


def j14_reprocess(spark: SparkSession, d: str) -> DataFrame:
    c = derive.contents(spark, d).withColumn("media_type", F.when(F.col("doc_id") % 4 == 0, "film").otherwise("video")).withColumn("source_url", F.lit(None).cast("string"))
    ids = table(spark, d, "labels").select((F.col("doc_id") * 3).cast("string").alias("id"))
    raw, missing = warehouse.raw_again(c, ids)
    return raw.select("id", "media_type", F.lit(True).alias("stored")).unionByName(missing.select("id", F.lit(None).cast("string").alias("media_type"), F.lit(False).alias("stored")))


def d1_insert(spark: SparkSession, d: str) -> DataFrame:
    c = derive.contents(spark, d)
    rows = c.select("id", "source", (F.col("doc_id") * 2).cast("string").alias("source_id"), "raw_text", "status", "created_at", "current_analysis_id", "doc_id")
    return warehouse.insert_new(c.filter("doc_id % 2 = 0"), rows).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("n_ids"))


def d3_status(spark: SparkSession, d: str) -> DataFrame:
    c = derive.contents(spark, d).withColumns({"error_type": F.when(F.col("status") == "failed", "X"), "error_message": F.lit("m"), "processed_at": F.col("created_at")})
    changes = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, "failed").otherwise("processing").alias("status"), F.lit("BAD").alias("error_type"), F.lit("why").alias("error_message"))
    return warehouse.set_status(c, changes, as_of()).select("id", "status", "error_type", "error_message", "processed_at")


def d4_reset(spark: SparkSession, d: str) -> DataFrame:
    c = derive.contents(spark, d).withColumns({"error_type": F.lit("X"), "error_message": F.lit("m"), "processed_at": F.col("created_at")})
    return warehouse.reset_to_pending(c, warehouse.stale(c, as_of())).groupBy("status").agg(F.count("*").alias("n"), F.count("error_type").alias("n_errors"))


def s9_append_analyses(spark: SparkSession, d: str) -> DataFrame:
    """The later half of the conversations' turns is appended to the earlier half; the run is repeated and adds nothing."""
    c = derive.contents(spark, d)
    a = derive.analyses(spark, d).join(c.select(F.col("id").alias("content_id")), "content_id", "left_semi").select("id", "content_id", "summary", "created_at", "turn")
    old, new = a.filter("turn < 3"), a.filter("turn >= 2")
    moved, every = warehouse.append_analyses(c.withColumn("current_analysis_id", F.lit(None).cast("string")), old, new)
    counts = every.groupBy("content_id").agg(F.count("*").alias("n"))
    return moved.join(counts, moved["id"] == counts["content_id"], "left").select("id", "current_analysis_id", F.coalesce("n", F.lit(0)).alias("n_analyses"))


def d9_upsert_links(spark: SparkSession, d: str) -> DataFrame:
    """Line items as links of orders and part types, in order; the last discount of a link wins."""
    l = table(spark, d, "lineitem")
    old = l.filter("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("content_id"), F.col("l_returnflag").alias("topic_id")).agg(F.max("l_discount").alias("confidence"))
    new = l.filter("l_linenumber > 1").select(F.col("l_suppkey").alias("content_id"), F.col("l_returnflag").alias("topic_id"), F.when(F.col("l_linenumber") < 5, F.col("l_discount")).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return warehouse.upsert_links(old, new, ["content_id", "topic_id"])


def d7_topics(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    known = p.filter("p_partkey % 7 = 0").select(warehouse.stable_id("topic", F.col("p_type")).alias("id"), F.col("p_type").alias("name")).distinct()
    links, every = ent.resolve_or_create_topics(p.select(F.col("p_partkey").alias("content_id"), F.concat(F.lit("  "), F.regexp_replace("p_type", " ", "  ")).alias("name")), known)
    counts = links.groupBy("topic_id").agg(F.count("*").alias("n"))
    return every.join(counts, every["id"] == counts["topic_id"]).select("id", "name", "n")


def j3_resolve(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    names = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("n_name")).when(F.col("c_custkey") % 3 == 1, F.lower("n_name")).otherwise(F.initcap("n_name")).alias("name"))
    return ent.resolve(names, derive.entities(spark, d), derive.third_party_aliases(spark, d)).select("c_custkey", "name", "entity_id", "matched_by")


def d6_resolve_or_create(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    names = c.select(F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.col("c_mktsegment")).alias("name"), F.when(F.col("c_custkey") % 2 == 0, "place").otherwise("segment").alias("entity_type"))
    _, every = ent.resolve_or_create(names, derive.entities(spark, d), derive.third_party_aliases(spark, d))
    return every.select("id", "canonical_name", "entity_type")


def j4_alias_index(spark: SparkSession, d: str) -> DataFrame:
    i = ent.alias_index(derive.entities(spark, d), derive.third_party_aliases(spark, d))
    return i.select("entity_id", "canonical_name", F.array_join("aliases", "|").alias("aliases"), F.col("n_aliases").cast("long").alias("n_aliases"))


def j5_canonical(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    names = c.select(F.col("c_mktsegment").alias("content_id"), F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 2 == 0, F.initcap("n_name")).otherwise(F.concat(F.lit("x"), "n_nationkey")).alias("name"))
    return ent.canonical_names(names, ent.surface_index(derive.entities(spark, d), derive.third_party_aliases(spark, d)))


def d8_add_aliases(spark: SparkSession, d: str) -> DataFrame:
    verdicts, _ = ent.add_aliases(derive.third_party_aliases(spark, d).filter("id like 't%'"), derive.alias_requests(spark, d))
    return verdicts


def d10_merge_plan(spark: SparkSession, d: str) -> DataFrame:
    p = ent.merge_plan(derive.merge_requests(spark, d), derive.entities(spark, d), derive.third_party_aliases(spark, d), derive.entity_links(spark, d))
    joined = lambda c: F.array_join(c, "|").alias(c)
    return p.select("seq", "error", joined("to_move"), joined("owned"), joined("conflicts"), "links_to_move", "links_to_drop", "blocked")


def d11_apply_merges(spark: SparkSession, d: str) -> DataFrame:
    """The entities that are left after all merges, with their aliases and numbers of links."""
    e, a, l = ent.apply_merges(derive.merge_requests(spark, d), derive.entities(spark, d), derive.third_party_aliases(spark, d), derive.entity_links(spark, d))
    i = ent.alias_index(e, a)
    n = l.groupBy("entity_id").agg(F.count("*").alias("n_links"))
    return i.join(n, "entity_id", "left").select("entity_id", "canonical_name", F.array_join("aliases", "|").alias("aliases"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def j9_linked(spark: SparkSession, d: str) -> DataFrame:
    out = ent.linked_names(derive.entity_links(spark, d), derive.entities(spark, d), derive.third_party_aliases(spark, d))
    return out.select("content_id", F.array_join(F.transform("entities", lambda e: e["canonical_name"]), "|").alias("names"))


def w2_core_claims(spark: SparkSession, d: str) -> DataFrame:
    return grounding.core_claims(derive.claims(spark, d)).select("content_id", "ord", "rank", "confidence")


def _grounded(spark: SparkSession, d: str) -> DataFrame:
    c, s = derive.claims(spark, d), derive.sources(spark, d)
    # Three frequent names as every content's entities; the second has an alias that occurs in texts.
    e = s.select("content_id", F.posexplode(F.array(F.lit("the"), F.lit("Mary"), F.lit("und")))).select("content_id", F.col("pos").alias("ord"), F.col("col").alias("name"))
    a = spark.createDataFrame([("Mary", "THER"), ("Mary", "nd")], "canonical string, alias string")
    return grounding.ground(c, s, e, a)


def k10_grounding(spark: SparkSession, d: str) -> DataFrame:
    g = _grounded(spark, d)
    return g.select("content_id", "ord", F.array_join("rules", ",").alias("rules"), "path", F.array_join("entities", ",").alias("entities"), F.array_join("ungrounded_entities", ",").alias("ungrounded_entities"), "needs_verification")


def a3_rules_fired(spark: SparkSession, d: str) -> DataFrame:
    return grounding.rules_fired(_grounded(spark, d))


def a4_grounding_report(spark: SparkSession, d: str) -> DataFrame:
    r = grounding.report(_grounded(spark, d), derive.sources(spark, d))
    return r.select("content_id", "n_claims", "n_unverified", "n_verified", "source_chars", F.sha2(F.array_join("unverified_claims", "\n").cast("binary"), 256).alias("unverified_sha256"))


def j8_ungrounded_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Line items' quantities as claims about their order; the other suppliers' quantities as sources; every fourth is rough."""
    l = table(spark, d, "lineitem")
    token = lambda rows: rows.select(F.col("l_orderkey").alias("content_id"), F.col("l_linenumber").alias("claim_ord"), F.lit(0).alias("ord"), F.col("l_quantity").cast("string").alias("raw"), F.col("l_quantity").cast("decimal(38,10)").alias("value"), F.lit("plain").alias("kind"), (F.col("l_suppkey") % 4 == 0).alias("fuzzy"))
    return numbers.ungrounded(token(l.filter("l_linenumber % 2 = 1")), token(l.filter("l_linenumber % 2 = 0")), "content_id", ["claim_ord"]).select("content_id", "claim_ord", F.col("value").cast("double").alias("value"))


def s4_page_verdicts(spark: SparkSession, d: str) -> DataFrame:
    html = F.when(F.col("page_id") % 9 == 0, F.concat("html", F.lit("CAPTCHA"))).when(F.col("page_id") % 9 == 1, F.concat("html", F.lit("请先登录"))).otherwise(F.col("html"))
    return table(spark, d, "pages").groupBy(page_verdict(html).alias("verdict")).agg(F.count("*").alias("n"))


def j13_redirects(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://example.com/p/"), "page_id").alias("url"))
    ends = F.when(F.col("page_id") % 7 == 1, 401).when(F.col("page_id") % 7 == 2, 403).when(F.col("page_id") % 7 == 3, 500).otherwise(200)
    to = F.when(F.col("page_id") % 11 == 0, "https://other.org/x").when(F.col("page_id") % 13 == 0, "/login").otherwise(F.concat(F.lit("/p/"), F.floor(F.col("page_id") / 2).cast("string")))
    hops = p.select("url", F.when(F.col("page_id") % 3 == 0, ends).otherwise(302).alias("status_code"), F.when(F.col("page_id") % 3 != 0, to).alias("location"))
    return redirects.resolve_redirects(p.select(F.col("page_id").alias("id"), "url"), hops, allowed=("example.com",)).select(F.col("id").alias("page_id"), "final_url", "hops", "error_type")


QUERIES = {f.__name__: f for f in (f1_by_status, f2_stale, a1_status_counts, a2_analyses_per_content, j1_identity, j10_current_analysis, j11_listing, j11_listing_all, l1_order_page, j14_reprocess, d1_insert, d3_status, d4_reset, s9_append_analyses, d9_upsert_links, d7_topics, j3_resolve, d6_resolve_or_create, j4_alias_index, j5_canonical, d8_add_aliases, d10_merge_plan, d11_apply_merges, j9_linked, w2_core_claims, k10_grounding, a3_rules_fired, a4_grounding_report, j8_ungrounded_numbers, s4_page_verdicts, j13_redirects)}

_GROUND = f"""{SOURCES_SQL}, {CLAIMS_SQL},
g AS (SELECT c.*, replace(lower(c.text), 'ß', 'ss') AS said, replace(lower(s.text), 'ß', 'ss') AS src, length(s.text) AS source_chars, s.content_id IS NOT NULL AS sourced FROM claims c LEFT JOIN sources s USING (content_id)),
h AS (SELECT *, sourced AND contains(said, 'the') AS e0, sourced AND (contains(said, 'mary') OR contains(said, 'ther') OR contains(said, 'nd')) AS e1, sourced AND contains(said, 'und') AS e2,
 contains(src, 'the') AS s0, contains(src, 'mary') OR contains(src, 'ther') OR contains(src, 'nd') AS s1, contains(src, 'und') AS s2, regexp_extract_all(said, '[0-9]+(\\.[0-9]+)?[ ]*%?') AS nums, regexp_extract_all(coalesce(src, ''), '[0-9]+(\\.[0-9]+)?[ ]*%?') AS snums FROM g),
m AS (SELECT *, list_transform(list_filter(nums, lambda x: contains(x, '%') OR CAST(rtrim(x, '% ') AS DECIMAL(38,10)) >= 10), lambda x: struct_pack(v := CAST(rtrim(x, '% ') AS DECIMAL(38,10)), k := contains(x, '%'))) AS kn,
 list_transform(list_filter(snums, lambda x: contains(x, '%') OR CAST(rtrim(x, '% ') AS DECIMAL(38,10)) >= 10), lambda x: struct_pack(v := CAST(rtrim(x, '% ') AS DECIMAL(38,10)), k := contains(x, '%'))) AS sn FROM h),
r AS (SELECT *, (e0 OR e1 OR e2) AS hits, len(kn) > 0 AS hasnum, quality = 1 AS ev FROM m),
q AS (SELECT *, concat_ws(',', CASE WHEN NOT coalesce(ev, false) THEN 'R1' END, CASE WHEN hits AND NOT (e0 AND s0 OR e1 AND s1 OR e2 AND s2) THEN 'R2.1' END, CASE WHEN len(list_filter(kn, lambda x: NOT list_contains(sn, x))) > 0 THEN 'R2.2' END) AS rules FROM r)"""

ORACLE_SQL = {
    "f1_by_status": f"WITH {CONTENTS_SQL} SELECT id, source, status FROM contents WHERE status = 'completed' AND source = 'en'",
    "f2_stale": f"WITH {CONTENTS_SQL} SELECT id, created_at FROM contents WHERE status = 'processing' AND created_at <= TIMESTAMP '2024-01-01 00:05:00'",
    "a1_status_counts": f"WITH {CONTENTS_SQL} SELECT status, count(*) AS n FROM contents GROUP BY status",
    "a2_analyses_per_content": "SELECT CAST(conv_id AS VARCHAR) AS content_id, count(*) AS n FROM conversations GROUP BY 1",
    "j1_identity": f"WITH {CONTENTS_SQL}, a AS (SELECT source, CASE WHEN doc_id % 3 = 0 THEN source_id ELSE CAST(doc_id + 1 AS VARCHAR) END AS source_id FROM contents) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM contents c WHERE c.doc_id % 2 = 0 AND c.source = a.source AND c.source_id = a.source_id)",
    "j10_current_analysis": f"WITH {CONTENTS_SQL}, {ANALYSES_SQL} SELECT c.id, current_analysis_id, a.summary AS analysis_summary FROM contents c LEFT JOIN analyses a ON a.id = current_analysis_id",
    "j11_listing": f"WITH {CONTENTS_SQL}, {ANALYSES_SQL} SELECT id, source, status, (SELECT count(*) FROM analyses a WHERE a.content_id = p.id) AS n_analyses FROM (SELECT * FROM contents ORDER BY created_at DESC, id LIMIT 150 OFFSET 10) p",
    "j11_listing_all": f"WITH {CONTENTS_SQL}, {ANALYSES_SQL}, n AS (SELECT content_id, count(*) AS n FROM analyses GROUP BY 1) SELECT id, status, coalesce(n, 0) AS n_analyses FROM contents LEFT JOIN n ON content_id = id",
    "l1_order_page": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200 OFFSET 100",
    "j14_reprocess": "SELECT CAST(l.doc_id * 3 AS VARCHAR) AS id, CASE WHEN d.doc_id IS NULL THEN NULL WHEN d.doc_id % 4 = 0 THEN 'text' ELSE 'video' END AS media_type, d.doc_id IS NOT NULL AS stored FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id * 3",
    "d1_insert": "WITH e AS (SELECT lang, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id % 2 = 0), n AS (SELECT lang, CAST(doc_id * 2 AS VARCHAR) AS s FROM documents d WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.lang = d.lang AND e.s = CAST(d.doc_id * 2 AS VARCHAR))) SELECT lang AS source, count(*) AS n, count(DISTINCT s) AS n_ids FROM (SELECT * FROM e UNION ALL SELECT * FROM n) GROUP BY lang",
    "d3_status": f"""WITH {CONTENTS_SQL} SELECT c.id, CASE WHEN l.doc_id IS NULL THEN c.status WHEN toxic = 1 THEN 'failed' ELSE 'processing' END AS status, CASE WHEN l.doc_id IS NULL THEN CASE WHEN c.status = 'failed' THEN 'X' END WHEN toxic = 1 THEN 'BAD' END AS error_type,
CASE WHEN l.doc_id IS NULL THEN 'm' WHEN toxic = 1 THEN 'why' END AS error_message, CASE WHEN l.doc_id IS NULL THEN created_at WHEN toxic = 1 THEN TIMESTAMP '2024-01-01 00:20:00' END AS processed_at FROM contents c LEFT JOIN labels l ON l.doc_id = c.doc_id""",
    "d4_reset": f"WITH {CONTENTS_SQL}, s AS (SELECT *, status = 'processing' AND created_at <= TIMESTAMP '2024-01-01 00:05:00' AS r FROM contents) SELECT CASE WHEN r THEN 'pending' ELSE status END AS status, count(*) AS n, count(*) FILTER (WHERE NOT r) AS n_errors FROM s GROUP BY 1",
    "s9_append_analyses": "SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN max(turn) >= 2 THEN d.doc_id || ':' || max(turn) END AS current_analysis_id, count(turn) AS n_analyses FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id GROUP BY d.doc_id",
    "d9_upsert_links": "WITH b AS (SELECT l_suppkey AS content_id, l_returnflag AS topic_id, max(l_discount) AS confidence, -1 AS seq FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2 UNION ALL SELECT l_suppkey, l_returnflag, CASE WHEN l_linenumber < 5 THEN l_discount END, l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_linenumber > 1) SELECT content_id, topic_id, confidence FROM b QUALIFY row_number() OVER (PARTITION BY content_id, topic_id ORDER BY seq DESC) = 1",
    "d7_topics": "SELECT left(sha256('topic' || chr(31) || p_type), 32) AS id, p_type AS name, count(*) AS n FROM part GROUP BY p_type",
    "j3_resolve": f"""WITH {ALIASES_SQL}, n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN n_name WHEN c_custkey % 3 = 1 THEN lower(n_name) ELSE array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, name, coalesce(e.id, a.entity_id) AS entity_id, CASE WHEN e.id IS NOT NULL THEN 'canonical' WHEN a.entity_id IS NOT NULL THEN 'alias' ELSE 'new' END AS matched_by FROM n LEFT JOIN entities e ON e.canonical_name = name LEFT JOIN aliases a ON a.alias = name""",
    "d6_resolve_or_create": "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS canonical_name, 'place' AS entity_type FROM nation UNION ALL SELECT left(sha256('entity' || chr(31) || s), 32), s, 'other' FROM (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_custkey % 2 = 1)",
    "j4_alias_index": f"WITH {ALIASES_SQL} SELECT id AS entity_id, canonical_name, coalesce(string_agg(alias, '|' ORDER BY alias), '') AS aliases, count(alias) AS n_aliases FROM entities LEFT JOIN aliases ON entity_id = id GROUP BY id, canonical_name",
    "j5_canonical": f"""WITH {ALIASES_SQL}, f AS (SELECT lower(canonical_name) AS folded, canonical_name, '' AS alias FROM entities UNION ALL SELECT lower(alias), canonical_name, alias FROM aliases JOIN entities ON id = entity_id), i AS (SELECT folded, min(canonical_name) AS canonical_name FROM f GROUP BY folded),
n AS (SELECT c_mktsegment AS content_id, c_custkey AS ord, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE 'x' || n_nationkey END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT content_id, coalesce(canonical_name, name) AS canonical, min(ord) AS ord FROM n LEFT JOIN i ON folded = lower(name) GROUP BY 1, 2""",
    "d8_add_aliases": """WITH h AS (SELECT CAST(n_nationkey + 2 AS VARCHAR) AS held_by, n_name AS alias FROM nation WHERE n_nationkey % 4 = 0),
q AS (SELECT CAST(n_nationkey AS BIGINT) AS seq, CAST(n_nationkey AS VARCHAR) AS entity_id, lower(n_name) AS alias FROM nation UNION ALL SELECT n_nationkey + 1000, CAST(n_nationkey AS VARCHAR), r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT q.*, h.held_by, first_value(entity_id) OVER w AS fid, min(seq) OVER (PARTITION BY q.alias) AS fseq FROM q LEFT JOIN h USING (alias) WINDOW w AS (PARTITION BY q.alias ORDER BY seq))
SELECT seq, entity_id, alias, CASE WHEN coalesce(held_by, fid) <> entity_id THEN 'conflict' WHEN held_by IS NULL AND seq = fseq THEN 'new' ELSE 'own' END AS verdict, CASE WHEN coalesce(held_by, fid) <> entity_id THEN coalesce(held_by, fid) END AS owner_id FROM f""",
    "d10_merge_plan": f"""WITH {ALIASES_SQL}, {LINKS_SQL}, r AS (SELECT CAST(n_nationkey AS BIGINT) AS seq, CAST(n_nationkey AS VARCHAR) AS s, CAST(n_nationkey + 1 AS VARCHAR) AS t, e.canonical_name AS tn, n_name AS sn FROM nation LEFT JOIN entities e ON e.id = CAST(n_nationkey + 1 AS VARCHAR) WHERE n_nationkey % 2 = 0),
f AS (SELECT seq, s, t, tn, sn AS surface FROM r WHERE tn IS NOT NULL UNION SELECT seq, s, t, tn, alias FROM r JOIN aliases ON entity_id = s WHERE tn IS NOT NULL),
o AS (SELECT f.*, CASE WHEN surface = tn OR a.entity_id = t THEN 'owned' WHEN a.entity_id IS NULL OR a.entity_id = s THEN 'to_move' ELSE 'conflict' END AS label FROM f LEFT JOIN aliases a ON a.alias = surface),
p AS (SELECT seq, coalesce(string_agg(surface, '|' ORDER BY surface) FILTER (WHERE label = 'to_move'), '') AS to_move, coalesce(string_agg(surface, '|' ORDER BY surface) FILTER (WHERE label = 'owned'), '') AS owned, coalesce(string_agg(surface, '|' ORDER BY surface) FILTER (WHERE label = 'conflict'), '') AS conflicts FROM o GROUP BY seq),
k AS (SELECT seq, count(*) FILTER (WHERE b.content_id IS NULL) AS m, count(b.content_id) AS dr FROM r JOIN links a ON a.entity_id = s LEFT JOIN links b ON b.content_id = a.content_id AND b.entity_id = t WHERE tn IS NOT NULL GROUP BY seq)
SELECT r.seq, CASE WHEN tn IS NULL THEN 'MISSING' END AS error, to_move, owned, conflicts, CASE WHEN tn IS NOT NULL THEN coalesce(m, 0) END AS links_to_move, CASE WHEN tn IS NOT NULL THEN coalesce(dr, 0) END AS links_to_drop, coalesce(conflicts <> '', false) AS blocked FROM r LEFT JOIN p USING (seq) LEFT JOIN k USING (seq)""",
    "j9_linked": f"WITH {LINKS_SQL} SELECT content_id, string_agg(n_name, '|' ORDER BY n_name) AS names FROM links JOIN nation ON CAST(n_nationkey AS VARCHAR) = entity_id GROUP BY content_id",
    "w2_core_claims": f"WITH {CLAIMS_SQL} SELECT content_id, CAST(ord AS INTEGER) AS ord, CAST(row_number() OVER (PARTITION BY content_id ORDER BY confidence DESC, ord) AS INTEGER) AS rank, CAST(confidence AS DOUBLE) AS confidence FROM claims QUALIFY rank <= 5",
    "k10_grounding": f"WITH {_GROUND} SELECT content_id, ord, rules, CASE WHEN NOT hits AND NOT hasnum THEN 'semantic' ELSE 'structured' END AS path, concat_ws(',', CASE WHEN e0 THEN 'the' END, CASE WHEN e1 THEN 'Mary' END, CASE WHEN e2 THEN 'und' END) AS entities, concat_ws(',', CASE WHEN e0 AND NOT s0 THEN 'the' END, CASE WHEN e1 AND NOT s1 THEN 'Mary' END, CASE WHEN e2 AND NOT s2 THEN 'und' END) AS ungrounded_entities, rules <> '' AS needs_verification FROM q",
    "a3_rules_fired": f"WITH {_GROUND} SELECT rule, count(*) AS n FROM (SELECT unnest(string_split(rules, ',')) AS rule FROM q WHERE rules <> '') GROUP BY rule",
    "a4_grounding_report": f"WITH {_GROUND} SELECT content_id, count(*) AS n_claims, count(*) FILTER (WHERE rules <> '') AS n_unverified, count(*) FILTER (WHERE rules = '') AS n_verified, max(source_chars) AS source_chars, sha256(coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (WHERE rules <> ''), '')) AS unverified_sha256 FROM q GROUP BY content_id",
    "j8_ungrounded_numbers": "WITH t AS (SELECT l_orderkey AS o, l_linenumber AS n, l_quantity AS v, l_suppkey % 4 = 0 AS f FROM lineitem) SELECT o AS content_id, n AS claim_ord, v AS value FROM t c WHERE n % 2 = 1 AND NOT EXISTS (SELECT 1 FROM t s WHERE s.o = c.o AND s.n % 2 = 0 AND (s.v = c.v OR ((s.f OR c.f) AND abs(c.v - s.v) * 100 <= abs(c.v) * 15 AND (c.v <> 0 OR s.v = 0))))",
    "s4_page_verdicts": "SELECT CASE WHEN page_id % 9 = 0 THEN 'REQUEST_BLOCKED' WHEN page_id % 9 = 1 THEN 'COOKIE_REQUIRED' END AS verdict, count(*) AS n FROM pages GROUP BY 1",
    "j13_redirects": """WITH RECURSIVE h AS (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 302 WHEN page_id % 7 = 1 THEN 401 WHEN page_id % 7 = 2 THEN 403 WHEN page_id % 7 = 3 THEN 500 ELSE 200 END AS st FROM pages),
w AS (SELECT page_id AS id, page_id AS cur, 0 AS hops, CAST(NULL AS VARCHAR) AS err, false AS fin FROM pages UNION ALL
SELECT w.id, CASE WHEN st = 302 AND hops < 5 AND cur % 11 <> 0 AND cur % 13 <> 0 THEN cur // 2 ELSE cur END, CASE WHEN st = 302 AND hops < 5 AND cur % 11 <> 0 AND cur % 13 <> 0 THEN hops + 1 ELSE hops END,
CASE WHEN st = 302 AND hops >= 5 THEN 'SHORT_LINK_RESOLUTION_FAILED' WHEN st = 302 AND cur % 11 = 0 THEN 'SHORT_LINK_RESOLUTION_FAILED' WHEN st = 302 AND cur % 13 = 0 THEN 'COOKIE_REQUIRED' WHEN st = 401 THEN 'COOKIE_REQUIRED' WHEN st = 403 THEN 'REQUEST_BLOCKED' WHEN st = 500 THEN 'SHORT_LINK_RESOLUTION_FAILED' END,
NOT (st = 302 AND hops < 5 AND cur % 11 <> 0 AND cur % 13 <> 0) FROM w JOIN h ON h.page_id = w.cur WHERE NOT fin)
SELECT id AS page_id, CASE WHEN err IS NULL THEN 'https://example.com/p/' || cur END AS final_url, hops, err AS error_type FROM w WHERE fin""",
}
