"""Query of the periodic runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.common import table
from groundwork.llm.periodic import periodic_runs


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by the checksum of the id, the words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    some = docs.select("doc_id", "text", h.alias("h"), g.alias("g")).withColumn(
        "w", F.when(F.col("h") % 10 == 0, F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    )
    n = F.nullif(F.size("w"), F.lit(0))
    tail = n - F.col("a")  # words from a on
    some = some.withColumn("a", (F.col("g") % n).cast("int"))
    some = some.withColumn("p", (1 + F.floor(tail / (3 + F.col("g") % 8))).cast("int"))
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(tail / F.col("p")).cast("int"))), F.lit(1), tail)
    edited = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return some.select("doc_id", F.coalesce(edited, "text").alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))

    def digest(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        digest(lines).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


#: All pairs of equal words of a text; Spark's checksum is written out, bit by bit. A stretch whose smallest period is smaller
#: lies in one of that period, as it is at least four periods long.
_OP12 = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents),
crc AS (SELECT doc_id, s, 0 AS step, CAST(4294967295 AS BIGINT) AS c FROM ids
        UNION ALL
        SELECT doc_id, s, step + 1,
               CASE WHEN step % 9 = 0 THEN xor(c, CAST(unicode(substr(s, step // 9 + 1, 1)) AS BIGINT))
                    WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END
        FROM crc WHERE step < 9 * length(s)),
hash AS (SELECT doc_id, xor(c, CAST(4294967295 AS BIGINT)) AS h FROM crc WHERE step = 9 * length(s)),
split AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
cut AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split LEFT JOIN hash USING (doc_id)),
word AS (SELECT r, i, w[1 + CASE WHEN i < coalesce(a, n) THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] AS x
         FROM (SELECT *, unnest(range(0, n)) AS i FROM cut)),
lag AS (SELECT v.r, v.i, v.i - u.i AS q FROM word v JOIN word u ON v.r = u.r AND v.x = u.x AND u.i < v.i),
island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM lag),
stretch AS (SELECT r, q, min(i) - q AS s, count(*) + q AS n FROM island GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT r, s, n, q FROM stretch b WHERE NOT EXISTS (SELECT 1 FROM stretch o WHERE o.r = b.r AND o.q < b.q AND o.s <= b.s AND o.s + o.n >= b.s + b.n)),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
                  list({'n': n, 's': -s, 'q': -q} ORDER BY n DESC, s, q)[1] AS best FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + n)) AS i FROM run),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(-best.s AS BIGINT) AS start, CAST(best.n AS BIGINT) AS length, CAST(-best.q AS BIGINT) AS period,
       CAST(1000 * best.n // -best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM split LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""

QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLE_SQL = {"op12_periodic_runs": _OP12}
