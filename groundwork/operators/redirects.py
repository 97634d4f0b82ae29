"""Redirect chains over a table of crawl hops (url, status_code, location)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions.urls import ALLOWED_HOSTS, canonical_url, host_allowed, is_login, platform_id, platform_of, url_parts, url_verdict
from groundwork.operators.lineage import checkpointed

# Answers that send on to another place.
REDIRECTS = (301, 302, 303, 307, 308)


def resolve_redirects(starts: DataFrame, hops: DataFrame, max_redirects: int = 5, allowed: tuple[str, ...] = ALLOWED_HOSTS) -> DataFrame:
    """starts (id, url) with final_url, hops, error_type, and platform, platform_id and canonical_url of the final URL.

    Each round joins the open chains with the hops on the URL: at most max_redirects + 1 equi joins, whatever the number
    of chains. Every target must be allowed; a login page, 401, 403 or 429, other answers from 400 on, a redirect without
    a location, too many of them, and a URL that was never crawled are errors of their own.
    """
    table = hops.groupBy(F.col("url").alias("at")).agg(F.min(F.struct("status_code", "location")).alias("h")).select("at", "h.status_code", "h.location")
    no_text = F.lit(None).cast("string")
    open_ = starts.select("id", "url", F.col("url").alias("at"), F.lit(0).alias("hops"), url_verdict(F.col("url"), allowed).alias("error_type"))
    done = open_.filter("error_type is not null").select("id", "url", no_text.alias("final_url"), "hops", "error_type")
    open_ = open_.filter("error_type is null").drop("error_type")
    for _ in range(max_redirects + 1):
        met = open_.join(table, "at", "left")
        sent = F.col("status_code").isin(*REDIRECTS)
        goes = sent & (F.coalesce("location", F.lit("")) != "")
        root = F.regexp_extract("at", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
        scheme = F.regexp_extract("at", r"^[A-Za-z][A-Za-z0-9+.\-]*:", 0)
        folder = F.regexp_replace(F.regexp_replace("at", r"[?#].*$", ""), r"[^/]*$", "")
        target = F.when(F.col("location").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.col("location")).when(F.col("location").startswith("//"), F.concat(scheme, "location")).when(F.col("location").startswith("/"), F.concat(root, "location")).otherwise(F.concat(folder, "location"))
        met = met.withColumn("target", F.when(goes, target))
        error = (
            F.when(F.col("status_code").isNull(), "SHORT_LINK_RESOLUTION_FAILED")
            .when(sent & ~goes, "SHORT_LINK_RESOLUTION_FAILED")
            .when(goes & (F.col("hops") + 1 > max_redirects), "SHORT_LINK_RESOLUTION_FAILED")
            .when(goes & is_login(F.col("target")), "COOKIE_REQUIRED")
            .when(goes & ~host_allowed(url_parts(F.col("target"))["host"], allowed), "SHORT_LINK_RESOLUTION_FAILED")
            .when(goes, no_text)
            .when(F.col("status_code") == 401, "COOKIE_REQUIRED")
            .when(F.col("status_code").isin(403, 429), "REQUEST_BLOCKED")
            .when(F.col("status_code") >= 400, "SHORT_LINK_RESOLUTION_FAILED")
            .when(is_login(F.col("at")), "COOKIE_REQUIRED")
        )
        met = checkpointed(met.withColumn("error_type", error).withColumn("goes", goes))
        ended = met.filter("error_type is not null or not goes")
        done = done.unionByName(ended.select("id", "url", F.when(F.col("error_type").isNull(), F.col("at")).alias("final_url"), "hops", "error_type"))
        open_ = met.filter("error_type is null and goes").select("id", "url", F.col("target").alias("at"), (F.col("hops") + 1).alias("hops"))
    final = F.col("final_url")
    return done.withColumns({"platform": platform_of(url_parts(final)["host"]), "platform_id": F.when(platform_of(url_parts(final)["host"]).isNotNull(), platform_id(final)), "canonical_url": canonical_url(final)})
