"""Column expressions over URLs: verdicts, allow-lists, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hosts that are allowed by default; their subdomains are too.
ALLOWED_HOSTS = ("douyin.com", "iesdouyin.com", "bilibili.com", "b23.tv", "youtube.com", "youtu.be", "x.com", "twitter.com", "github.com", "xiaohongshu.com", "xhslink.com", "mp.weixin.qq.com")
# Forms of the platform's content id, in the order in which they are tried.
PLATFORM_IDS = (r"/(?:video|note|slides|share/video|share/note)/(\d{6,})", r"[?&]modal_id=(\d{6,})", r"[?&]aweme_id=(\d{6,})", r"^(\d{6,})$")
PLATFORM_HOSTS = ("douyin.com", "iesdouyin.com")
LOGIN_HOSTS = ("passport.douyin.com", "sso.douyin.com")
LOGIN_PATHS = ("/login", "/passport", "/verify")
# Characters that a URL inside running text can have, and marks that end a sentence rather than a URL.
_URL_IN_TEXT = r"https?://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"
_TAIL = "[.,;'\"、。，、；！？…）)】」』》]+$"

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def url_parts(url: Column) -> Column:
    """struct(scheme, authority, host, path, query); host lower-cased, without user and port."""
    u = F.trim(F.coalesce(url, F.lit("")))
    part = lambda n: F.regexp_extract(u, _PARTS, n)
    named = F.regexp_replace(part(2), "^.*@", "")
    host = F.lower(F.when(named.startswith("["), F.regexp_extract(named, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(named, "^([^:]*)", 1)))
    return F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("authority"), host.alias("host"), part(3).alias("path"), part(4).alias("query"))


def host_suffixes(host: Column) -> Column:
    """The host and all its parent domains, longest first, for an equi join with a list of allowed hosts."""
    labels = F.split(F.regexp_replace(F.lower(F.trim(host)), r"\.+$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_allowed(host: Column, allowed: tuple[str, ...] = ALLOWED_HOSTS) -> Column:
    return F.arrays_overlap(host_suffixes(host), F.array(*(F.lit(h.strip().lower().rstrip(".")) for h in allowed)))


def url_verdict(url: Column, allowed: tuple[str, ...] = ALLOWED_HOSTS) -> Column:
    """Null for a good URL, else the reason: the scheme is judged before the host."""
    p = url_parts(url)
    return (
        F.when(p["scheme"] == "", "INVALID_URL")
        .when(~p["scheme"].isin("http", "https"), "UNSUPPORTED_URL_SCHEME")
        .when((p["authority"] == "") | (p["host"] == ""), "INVALID_URL")
        .when(~host_allowed(p["host"], allowed), "DOMAIN_NOT_ALLOWED")
    )


def normalized_url(url: Column) -> Column:
    p = url_parts(url)
    return F.concat(p["scheme"], F.lit("://"), p["host"], p["path"], F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit("")))


def first_url(text: Column) -> Column:
    """The first URL in running text without the marks after it; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), _URL_IN_TEXT, 0), _TAIL, ""), F.lit(""))


def platform_id(url: Column) -> Column:
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.coalesce(*(F.nullif(F.regexp_extract(u, p, 1), F.lit("")) for p in PLATFORM_IDS))


def platform_of(host: Column) -> Column:
    return F.when(host_allowed(host, PLATFORM_HOSTS), F.lit("douyin"))


def canonical_url(url: Column) -> Column:
    return F.when(platform_of(url_parts(url)["host"]).isNotNull() & platform_id(url).isNotNull(), F.concat(F.lit("https://www.douyin.com/video/"), platform_id(url)))


def is_login(url: Column) -> Column:
    p = url_parts(url)
    path = F.lower(p["path"])
    found = host_allowed(p["host"], LOGIN_HOSTS)
    for mark in LOGIN_PATHS:
        found = found | F.contains(path, F.lit(mark))
    return found


def allowed_by_table(urls: DataFrame, host_col: str, allowed: DataFrame) -> DataFrame:
    """urls with a column `allowed`, by equi joins of host suffixes with a table (host) of any size."""
    listed = allowed.select(F.regexp_replace(F.lower(F.trim("host")), r"\.+$", "").alias("__suffix")).distinct()
    hosts = urls.select(F.col(host_col).alias("__host")).distinct().withColumn("__suffix", F.explode(host_suffixes(F.col("__host"))))
    good = hosts.join(listed, "__suffix", "left_semi").select("__host").distinct().withColumn("allowed", F.lit(True))
    return urls.join(good, urls[host_col] == good["__host"], "left").drop("__host").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
