"""Raw content from crawled pages: what a page is, and the content inside its embedded JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.text import one_line
from groundwork.operators.repair import balanced_json

# Marks of pages that ask for a check or a login.
BLOCK_MARKS = ("验证后继续", "请完成验证", "captcha", "slider-verify")
LOGIN_MARKS = ("登录后查看", "请先登录", "passport.douyin.com")
TITLE_LIMIT = 80

CONTENT = "aweme_id string, title string, author string, author_id string, description string, media_type string, cover_url string"


def page_verdict(html: Column) -> Column:
    """REQUEST_BLOCKED, COOKIE_REQUIRED or null."""
    low = F.lower(F.coalesce(html, F.lit("")))
    has = lambda marks: F.greatest(*(F.contains(low, F.lit(m)) for m in marks))
    return F.when(has(BLOCK_MARKS), "REQUEST_BLOCKED").when(has(LOGIN_MARKS), "COOKIE_REQUIRED")


def _first_node(root):
    """Depth first, the first object with both an id and a description."""
    todo = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            if "aweme_id" in node and "desc" in node:
                return node
            todo += reversed(list(node.values()))
        elif isinstance(node, list):
            todo += reversed(node)
    return None


def _embedded(html: str):
    marked = html.find('id="RENDER_DATA"')
    if marked >= 0 and (start := html.find(">", marked)) >= 0:
        body = html[start + 1 : max(start + 1, html.find("</script>", start))]
        for text in (unquote(body), body):
            try:
                return json.loads(text)
            except ValueError:
                continue
    if (marked := html.find("_ROUTER_DATA")) >= 0 and (block := balanced_json(html[marked:])):
        try:
            return json.loads(block)
        except ValueError:
            return None
    return None


def _content(node: dict) -> tuple:
    author = node.get("author") if isinstance(node.get("author"), dict) else {}
    said = str(node.get("desc") or "")
    covers = ((node.get("video") or {}).get("cover") or {}).get("url_list") if isinstance(node.get("video"), dict) else None
    return (
        str(node.get("aweme_id")),
        " ".join(said.split())[:TITLE_LIMIT],
        author.get("nickname"),
        str(author.get("uid") or author.get("sec_uid") or "") or None,
        said,
        "image" if node.get("images") else "video",
        covers[0] if covers else None,
    )


def from_pages(pages: DataFrame) -> DataFrame:
    """pages (aweme_id, url, detail_json, html) as raw content with cover_url and miss_reason.

    The detail answer is read by JSON functions; only pages that it leaves open go to Python, which searches the page's
    embedded JSON. A page without content has null fields and the reason.
    """
    d = lambda path: F.get_json_object("detail_json", "$." + path)
    good = (d("status_code") == "0") & d("aweme_detail.aweme_id").isNotNull()
    said = F.coalesce(d("aweme_detail.desc"), F.lit(""))
    images = d("aweme_detail.images")
    found = F.struct(
        d("aweme_detail.aweme_id").alias("aweme_id"),
        F.substring(one_line(said), 1, TITLE_LIMIT).alias("title"),
        d("aweme_detail.author.nickname").alias("author"),
        F.coalesce(F.nullif(d("aweme_detail.author.uid"), F.lit("")), F.nullif(d("aweme_detail.author.sec_uid"), F.lit(""))).alias("author_id"),
        said.alias("description"),
        F.when(F.coalesce(images, F.lit("[]")).isin("[]", "null"), "video").otherwise("image").alias("media_type"),
        d("aweme_detail.video.cover.url_list[0]").alias("cover_url"),
    )
    rows = pages.withColumn("__found", F.when(good, found))
    settled = rows.filter("__found is not null").select("aweme_id", "url", F.col("__found").alias("c"), F.lit(None).cast("string").alias("miss_reason"))

    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for key, url, html, verdict in batch.itertuples(index=False, name=None):
                node = _first_node(_embedded(html or ""))
                content = _content(node) if node else (None,) * 7
                got.append((key, url, *content, None if node else verdict or "CONTENT_NOT_FOUND"))
            yield pd.DataFrame(got, columns=["page_key", "url", "aweme_id", "title", "author", "author_id", "description", "media_type", "cover_url", "miss_reason"], dtype=object)

    open_ = rows.filter("__found is null").select(F.col("aweme_id").cast("string").alias("page_key"), "url", "html", page_verdict(F.col("html")).alias("verdict"))
    searched = open_.mapInPandas(search, f"page_key string, url string, {CONTENT}, miss_reason string")
    searched = searched.select(F.col("page_key").alias("aweme_id"), "url", F.when(F.col("aweme_id").isNotNull(), F.struct("aweme_id", "title", "author", "author_id", "description", "media_type", "cover_url")).alias("c"), "miss_reason")
    out = settled.withColumn("aweme_id", F.col("aweme_id").cast("string")).unionByName(searched)
    return out.select(
        "aweme_id",
        F.lit("douyin").alias("source"),
        F.col("c.aweme_id").alias("source_id"),
        F.coalesce("url", F.lit("")).alias("source_url"),
        F.col("c.title").alias("title"),
        F.col("c.author").alias("author"),
        F.col("c.author_id").alias("author_id"),
        F.col("c.description").alias("description"),
        F.col("c.media_type").alias("media_type"),
        F.col("c.description").alias("raw_text"),
        F.col("c.cover_url").alias("cover_url"),
        "miss_reason",
    )
