"""Queries over notes and the notes that stand already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators import notes
from groundwork.plans.derive import table


def _crowded(spark: SparkSession, d: str) -> DataFrame:
    """A note for each document: five file names, and content ids of which few differ in their first 6, 12 and 32 characters."""
    i = F.col("doc_id")
    part = lambda n, size: F.lpad((i % n).cast("string"), size, "0")
    rows = table(spark, d, "documents").select(i.alias("doc_id"), F.concat(part(7, 6), part(14, 6), part(28, 20), i.cast("string")).alias("content_id"), F.col("lang").alias("source"), i.cast("string").alias("source_id"), F.concat(F.lit("Note "), i % 5).alias("title"), F.lpad(i.cast("string"), 9, "0").alias("created_at"), F.col("text").alias("raw_text"))
    return notes.render_notes(rows)


def _standing(spark: SparkSession, d: str) -> DataFrame:
    """Notes that stand already: of a document in this run, of one that is gone, of nobody, and at paths with suffixes."""
    i = F.col("doc_id")
    own = table(spark, d, "documents").filter("doc_id in (30, 41, 17)").select(
        F.when(i == 30, "Notes/Processed/Note 0.md").when(i == 41, "Notes/Processed/Note 1-000006.md").otherwise("Notes/Processed/Note 2-000003-000003000003.md").alias("path"), F.col("lang").alias("source"), i.cast("string").alias("source_id"), F.lit(False).alias("foreign")
    )
    other = [("Note 1", "gone", "x", False), ("Note 3", None, None, True), ("Note 4-000001", "gone", "y", False), ("Note 2-000001-3", None, None, True), ("Note 2-000001-5", "gone", "z", False)]
    return own.unionByName(spark.createDataFrame([(f"Notes/Processed/{n}.md", *r) for n, *r in other], "path string, source string, source_id string, foreign boolean"))


def j16_note_conflicts(spark: SparkSession, d: str) -> DataFrame:
    placed = notes.assign_paths(_crowded(spark, d), _standing(spark, d))
    return placed.select(F.col("source_id").alias("doc_id"), "path", "path_error")


_LEVEL = """t{k} AS (SELECT n.*, s.owner, stem || {suffix} || '.md' AS p FROM {src} n LEFT JOIN {held} s ON s.path = stem || {suffix} || '.md'),
g{k} AS (SELECT *, coalesce(owner, first_value(me) OVER (PARTITION BY p ORDER BY doc_id)) = me AS gets FROM t{k}),
h{k} AS (SELECT path, owner FROM {held} UNION SELECT p, me FROM g{k} WHERE gets),
r{k} AS (SELECT doc_id, cid, me, stem FROM g{k} WHERE NOT gets)"""

_LEVELS = ",\n".join(_LEVEL.format(k=k, suffix="''" if n == 0 else f"'-' || left(cid, {n})", src="n" if k == 0 else f"r{k - 1}", held="stored" if k == 0 else f"h{k - 1}") for k, n in enumerate((0, 6, 12, 32)))

QUERIES = {f.__name__: f for f in (j16_note_conflicts,)}

ORACLE_SQL = {
    "j16_note_conflicts": f"""WITH n AS (SELECT doc_id, lpad(CAST(doc_id % 7 AS VARCHAR), 6, '0') || lpad(CAST(doc_id % 14 AS VARCHAR), 6, '0') || lpad(CAST(doc_id % 28 AS VARCHAR), 20, '0') || doc_id AS cid, lang || chr(31) || doc_id AS me, 'Notes/Processed/Note ' || doc_id % 5 AS stem FROM documents),
stored AS (SELECT 'Notes/Processed/' || CASE doc_id WHEN 30 THEN 'Note 0' WHEN 41 THEN 'Note 1-000006' ELSE 'Note 2-000003-000003000003' END || '.md' AS path, lang || chr(31) || doc_id AS owner FROM documents WHERE doc_id IN (30, 41, 17)
  UNION ALL SELECT 'Notes/Processed/' || unnest(['Note 1', 'Note 3', 'Note 4-000001', 'Note 2-000001-3', 'Note 2-000001-5']) || '.md', 'another'),
{_LEVELS},
left_over AS (SELECT *, stem || '-' || left(cid, 6) || '-' AS prefix, row_number() OVER (PARTITION BY stem, left(cid, 6) ORDER BY doc_id) AS place FROM r3),
free AS (SELECT prefix, k, row_number() OVER (PARTITION BY prefix ORDER BY k) AS place FROM (SELECT DISTINCT prefix FROM left_over), (SELECT unnest(range(2, 100)) AS k) WHERE prefix || k || '.md' NOT IN (SELECT path FROM h3)),
placed AS (SELECT doc_id, p FROM g0 WHERE gets UNION ALL SELECT doc_id, p FROM g1 WHERE gets UNION ALL SELECT doc_id, p FROM g2 WHERE gets UNION ALL SELECT doc_id, p FROM g3 WHERE gets
  UNION ALL SELECT doc_id, prefix || k || '.md' FROM left_over JOIN free USING (prefix, place))
SELECT CAST(doc_id AS VARCHAR) AS doc_id, p AS path, CASE WHEN p IS NULL THEN 'MARKDOWN_WRITE_FAILED' END AS path_error FROM n LEFT JOIN placed USING (doc_id)""",
}
