"""Markdown notes of analysed contents: rendering, paths and conflicts, and the index of notes that exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundwork.functions.names import fenced, file_name, path_inside
from groundwork.functions.text import let, one_line
from groundwork.operators.analyses import EVIDENCE
from groundwork.operators.lineage import checkpointed, small_methods, stored
from groundwork.sources.note_files import standing_notes, write_note_files

# The sections and the front matter's keys, in their order, and the words of a note.
SECTIONS = ("摘要", "核心观点", "事实", "作者观点", "推论", "预测", "未验证信息", "值得进一步研究", "相关实体", "相关知识", "原始内容", "Transcript", "OCR")
KEYS = ("title", "source", "source_id", "source_url", "author", "media_type", "analysis_type", "topics", "tags", "created_at", "processed_at", "model", "prompt_version", "confidence", "needs_verification", "needs_manual_review", "content_hash_version")
NOTHING, UNTITLED = "（无）", "未命名"
FOLDERS = {"inbox": "Inbox", "processed": "Processed", "failed": "Failed"}
ROOT = "Notes"
#: Characters of the content id that a taken file name gets, and the largest number after them.
SUFFIXES, LAST_NUMBER = (6, 12, 32), 99

# YAML 1.1's rules for a scalar that can't be plain in a block, in a form that Java and RE2 share: indicators, spaces at the ends;
# and the forms of its other types (null, booleans, integers, floats, timestamps, merge and value marks).
NOT_PLAIN = r"""^[#,\[\]{}&*!|>'"%@` ]|^[?-](?: |$)|^---|^\.\.\.|:(?: |$)| #| $"""
OTHER_TYPE = (
    r"^(?:~|null|Null|NULL|yes|Yes|YES|no|No|NO|true|True|TRUE|false|False|FALSE|on|On|ON|off|Off|OFF|<<|="
    r"|[-+]?0b[01_]+|[-+]?0[0-7_]+|[-+]?(?:0|[1-9][0-9_]*)|[-+]?0x[0-9a-fA-F_]+|[-+]?[1-9][0-9_]*(?::[0-5]?[0-9])+"
    r"|[-+]?[0-9][0-9_]*\.[0-9_]*(?:[eE][-+][0-9]+)?|[-+]?\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?|[-+]?[0-9][0-9_]*(?::[0-5]?[0-9])+\.[0-9_]*|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[Tt]|[ \t]+)[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]*)?(?:[ \t]*(?:Z|[-+][0-9]{1,2}(?::[0-9]{2})?))?)$"
)
UNPRINTED = r"[\x00-\x1f\x7f-\x9f\x{2028}\x{2029}\x{feff}\x{fffe}\x{ffff}\x{10ffff}]"
#: Of those, the ones that JSON leaves as they are.
UNPRINTED_BY_JSON = "".join(map(chr, (*range(0x7F, 0xA0), 0x2028, 0x2029, 0xFEFF, 0xFFFE, 0xFFFF)))

CLAIM_TYPE = f"array<struct<text:string,type:string,author_position:string,time_horizon:string,based_on_claims:array<string>,evidence:array<{EVIDENCE}>,confidence:double,needs_verification:boolean>>"


def _list(xs: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(xs, F.array().cast(kind))


def _lines(xs: Column) -> Column:
    return let(xs, lambda made: F.when(F.size(made) > 0, F.array_join(made, "\n")).otherwise(NOTHING))


def _claim(c: Column) -> Column:
    based = F.array_join(F.filter(F.transform(_list(c["based_on_claims"]), one_line), lambda x: x != ""), "；")
    shown = F.filter(_list(c["evidence"], f"array<{EVIDENCE}>"), lambda e: e["type"] != "none")
    proof = F.transform(shown, lambda e: F.concat(F.lit("  - 证据（"), e["type"], F.lit("）："), one_line(e["description"]), F.when(F.coalesce(e["source_url"], F.lit("")) != "", F.concat(F.lit(" — "), e["source_url"])).otherwise("")))
    said = lambda x: F.coalesce(x, F.lit("")) != ""
    head = F.array_compact(
        F.array(
            F.concat(F.lit("- "), c["line"]),
            F.when(said(c["author_position"]), F.concat(F.lit("  - 作者立场："), one_line(c["author_position"]))),
            F.when(said(c["time_horizon"]), F.concat(F.lit("  - 时间范围："), one_line(c["time_horizon"]))),
            F.when(based != "", F.concat(F.lit("  - 基于："), based)),
        )
    )
    tail = F.array(F.concat(F.lit("  - 置信度："), F.format_string("%.2f", c["confidence"])), F.concat(F.lit("  - 状态："), F.when(c["needs_verification"], "需验证").otherwise("已验证")))
    return F.array_join(F.concat(head, proof, tail), "\n")


def _claims(claims: Column, kind: str) -> Column:
    own = F.transform(F.filter(claims, lambda c: c["type"] == kind), _claim)
    return let(own, lambda made: F.when(F.size(made) > 0, F.array_join(made, "\n\n")).otherwise(NOTHING))


def _core(claims: Column, top: int) -> Column:
    ranked = F.array_sort(F.transform(claims, lambda c, i: F.struct((-c["confidence"]).alias("x"), i.alias("i"), c["line"].alias("line"), c["type"].alias("type"))))
    return _lines(F.transform(F.slice(ranked, 1, top), lambda r: F.concat(F.lit("- "), r["line"], F.lit("（"), r["type"], F.lit("）"))))


def _not_plain(x: Column) -> Column:
    """NOT_PLAIN for a printable text: the marks at its start are tried there, not at every character."""
    starts = F.substring(x, 1, 4).rlike(r"""^[#,\[\]{}&*!|>'"%@` ]|^[?-](?: |$)|^---|^\.\.\.""")
    return starts | F.contains(x, F.lit(": ")) | F.endswith(x, F.lit(":")) | F.contains(x, F.lit(" #")) | F.endswith(x, F.lit(" "))


def scalar(x: Column) -> Column:
    """A YAML scalar in block style: plain where it can be, else in single quotes, else, with characters that YAML doesn't print or that
    break lines, in double quotes on one line, as JSON writes it. Long values are never folded."""
    plain = ~_not_plain(x) & ~x.rlike(OTHER_TYPE)
    json = F.to_json(F.array(x))
    left = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(f"\\u{ord(c):04x}").alias("code")) for c in UNPRINTED_BY_JSON))
    escaped = F.aggregate(left, F.substring(json, F.lit(2), F.length(json) - 2), lambda text, u: F.replace(text, u["c"], u["code"]))
    quoted = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(x == "", "''").when(x.rlike(UNPRINTED), escaped).when(plain, x).otherwise(quoted)


def _yaml_list(xs: Column) -> Column:
    return F.when(F.size(xs) == 0, " []").otherwise(F.concat(F.lit("\n"), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), scalar(x))), "\n")))


def with_columns_for_notes(rows: DataFrame) -> DataFrame:
    """Adds what rendering expects and rows lack, as nulls."""
    kinds = {"title": "string", "analysis_title": "string", "summary": "string", "analysis_type": "string", "claims": CLAIM_TYPE, "questions": "array<string>", "model_topics": "array<string>", "topics": "array<string>", "entities": "array<struct<canonical_name:string,aliases:array<string>>>", "overall_confidence": "double", "source": "string", "source_id": "string", "source_url": "string", "author": "string", "media_type": "string", "created_at": "string", "processed_at": "string", "model": "string", "prompt_version": "string", "needs_manual_review": "boolean", "content_hash_version": "int", "raw_text": "string", "transcript": "string", "ocr_text": "string", "error_type": "string", "error_message": "string"}
    return rows.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in rows.columns}).withColumn("claims", F.col("claims").cast(CLAIM_TYPE) if "claims" in rows.columns else F.lit(None).cast(CLAIM_TYPE))


def render_notes(rows: DataFrame, kind: str = "processed", top: int = 5) -> DataFrame:
    """(content_id, source, source_id, created_at, kind, file_name, markdown), one row for each content.

    Notes of kind "failed" get a section with the error at their start and ask for review. Claims come in their order.
    """
    small_methods(rows.sparkSession)
    rows = with_columns_for_notes(rows)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    # Columns of their own are made once: claims with their text on one line, topics, the title.
    rows = rows.withColumn("__claims", F.transform(_list(F.col("claims"), CLAIM_TYPE), lambda c: c.withField("line", one_line(c["text"]))))
    claims = F.col("__claims")
    clean = lambda xs: F.array_distinct(F.filter(F.transform(_list(xs), one_line), lambda x: x != ""))
    rows = rows.withColumn("__topics", F.when(F.size(_list(F.col("topics"))) > 0, clean(F.col("topics"))).otherwise(clean(F.col("model_topics"))))
    line = lambda c, other: let(one_line(F.col(c)), lambda x: F.when(x != "", x).otherwise(other))
    rows = rows.withColumn("__title", line("analysis_title", line("title", F.lit(UNTITLED))))
    title = F.col("__title")
    tags = F.array_distinct(F.filter(F.concat(F.array(one_line(F.col("analysis_type"))), "__topics"), lambda x: x != ""))
    unsure = F.filter(claims, lambda c: c["needs_verification"])
    flagged = F.transform(unsure, lambda c: c["line"])
    bullet = lambda xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit("- "), x))
    failed = kind == "failed"
    values = {
        "title": scalar(title), **{k: scalar(text(k)) for k in ("source", "source_id", "source_url", "author", "media_type", "analysis_type")},
        "created_at": scalar(text("created_at").cast("string")), "processed_at": scalar(text("processed_at").cast("string")), "model": scalar(text("model")), "prompt_version": scalar(text("prompt_version")),
        "confidence": F.round(F.coalesce("overall_confidence", F.lit(0.0)), 4).cast("string"), "needs_verification": (F.size(unsure) > 0).cast("string"),
        "needs_manual_review": F.lit("true") if failed else F.coalesce("needs_manual_review", F.lit(False)).cast("string"), "content_hash_version": F.coalesce("content_hash_version", F.lit(1)).cast("string"),
    }
    lists = {"topics": F.col("__topics"), "tags": tags}
    front = F.concat_ws("\n", F.lit("---"), *(F.concat(F.lit(f"{k}:"), _yaml_list(lists[k])) if k in lists else F.concat(F.lit(f"{k}: "), values[k]) for k in KEYS), F.lit("---"))
    extras = lambda e: F.array_join(F.filter(F.transform(_list(e["aliases"]), one_line), lambda x: x != ""), "、")
    linked = F.transform(_list(F.col("entities"), "array<struct<canonical_name:string,aliases:array<string>>>"), lambda e: F.concat(F.lit("- [["), e["canonical_name"], F.lit("]]"), F.when(extras(e) != "", F.concat(F.lit("（"), extras(e), F.lit("）"))).otherwise("")))
    original = lambda c: F.when(text(c) != "", fenced(F.col(c))).otherwise(NOTHING)
    bodies = [
        line("summary", F.lit(NOTHING)),
        _core(claims, top),
        *(_claims(claims, k) for k in ("fact", "opinion", "inference", "prediction")),
        _lines(bullet(flagged)),
        _lines(bullet(F.transform(_list(F.col("questions")), one_line))),
        _lines(linked),
        _lines(F.transform("__topics", lambda t: F.concat(F.lit("- [["), t, F.lit("]]")))),
        original("raw_text"), original("transcript"), original("ocr_text"),
    ]
    parts = [F.concat(F.lit("# "), title)]
    if failed:
        parts.append(F.concat(F.lit("## 错误信息\n\n- "), text("error_type"), F.lit("\n- "), one_line(F.col("error_message"))))
    parts += [F.concat(F.lit(f"## {name}\n\n"), body) for name, body in zip(SECTIONS, bodies)]
    # The last section never ends in a line's end: it is a fence, or says that there is nothing.
    markdown = F.concat(front, F.lit("\n\n"), F.concat_ws("\n\n", *parts), F.lit("\n"))
    return rows.select(F.col("content_id").cast("string").alias("content_id"), "source", "source_id", "created_at", F.lit(kind).alias("kind"), file_name(F.col("title"), F.col("content_id").cast("string")).alias("file_name"), markdown.alias("markdown"))


def existing_index(notes: DataFrame) -> DataFrame:
    """(path, source, source_id, foreign): what the front matter of existing notes (path, markdown) says; without a block a note is foreign."""
    block = F.regexp_extract("markdown", r"(?s)\A\s*---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    value = lambda k: F.regexp_extract(block, rf"(?m)^{k}:[ \t]*(.*?)[ \t]*$", 1)
    bare = lambda x: F.when(x.rlike("^'.*'$"), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit("''"), F.lit("'"))).when(x.rlike('^".*"$'), F.coalesce(F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0)), x.substr(F.lit(2), F.length(x) - 2))).otherwise(x)
    source, source_id = bare(value("source")), bare(value("source_id"))
    return notes.select("path", F.nullif(source, F.lit("")).alias("source"), F.nullif(source_id, F.lit("")).alias("source_id"), ((source == "") | (source_id == "")).alias("foreign"))


def assign_paths(notes: DataFrame, existing: DataFrame, root: str = ROOT) -> DataFrame:
    """notes with path and path_error, in order of (created_at, content_id). A path that another identity holds, on disk or earlier
    in the batch, gets the first 6, 12 or 32 characters of the content id; a note of the same identity keeps its path. Notes
    that still have none get the first 6 characters and the next number from 2 to 99 that no note has, else an error.

    Each of the four suffixes is one join with the paths that are held and one aggregate for the first of a path, over the notes
    still open; the numbers come from their rank among the notes of a stem and a list of the numbers that are free.
    """
    key, order = F.concat_ws("\x1f", "source", "source_id"), F.struct("created_at", "content_id")
    taken = existing.select("path", F.when(~F.col("foreign"), key).otherwise(F.lit("\x1f")).alias("owner"))
    folder = F.create_map(*(F.lit(x) for k, v in FOLDERS.items() for x in (k, f"{root}/{v}/")))
    open_ = notes.select("content_id", "created_at", key.alias("me"), F.concat(folder[F.col("kind")], F.col("file_name")).alias("stem"))
    bare_id = F.regexp_replace("content_id", "-", "")
    done = []
    for suffix in (F.lit(""), *(F.concat(F.lit("-"), F.substring(bare_id, 1, n)) for n in SUFFIXES)):
        held = open_.withColumn("path", F.concat("stem", suffix, F.lit(".md"))).join(taken, "path", "left")
        first = held.filter("owner is null").groupBy("path").agg(F.min_by("me", order).alias("first"))
        told = checkpointed(held.join(first, "path", "left").withColumn("gets", F.coalesce("owner", "first") == F.col("me")))
        done.append(told.filter("gets").select("content_id", "path"))
        taken = taken.unionByName(told.filter("gets and owner is null").select("path", F.col("me").alias("owner")).distinct())
        open_ = told.filter("not gets").select("content_id", "created_at", "me", "stem")
        if open_.isEmpty():
            break
    else:
        short = F.coalesce(F.nullif(F.substring(bare_id, 1, SUFFIXES[0]), F.lit("")), F.lit("dup"))
        left = open_.withColumn("prefix", F.concat("stem", F.lit("-"), short, F.lit("-")))
        numbers = F.sequence(F.lit(2), F.lit(LAST_NUMBER))
        named = left.select("prefix").distinct().select("prefix", F.explode(numbers).alias("n")).withColumn("path", F.concat("prefix", "n", F.lit(".md")))
        used = named.join(taken.select("path").distinct(), "path").groupBy("prefix").agg(F.collect_set("n").alias("used"))
        place = F.row_number().over(W.partitionBy("prefix").orderBy("created_at", "content_id"))
        ranked = left.withColumn("place", place).filter(F.col("place") < LAST_NUMBER).join(used, "prefix", "left")
        free = F.array_except(numbers, F.coalesce("used", F.array().cast("array<int>")))
        number = F.get(free, F.col("place") - 1)
        done.append(ranked.filter(number.isNotNull()).select("content_id", F.concat("prefix", number, F.lit(".md")).alias("path")))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    named = every.select(F.col("content_id").alias("__id"), "path")
    out = notes.join(named, notes["content_id"] == named["__id"], "left").drop("__id")
    return out.withColumn("path_error", F.when(F.col("path").isNull(), "MARKDOWN_WRITE_FAILED").when(~path_inside(F.col("path")), "PATH_ESCAPE"))


def write_status(notes: DataFrame, existing_notes: DataFrame, policy: str = "overwrite") -> DataFrame:
    """notes with status created, updated or skipped, and their size in bytes."""
    old = existing_notes.select("path", F.lit(True).alias("__old"))
    status = F.when(F.col("__old").isNull(), "created").otherwise(F.lit("skipped" if policy == "keep_existing" else "updated"))
    return notes.join(old, "path", "left").withColumns({"status": status, "n_bytes": F.octet_length("markdown")}).drop("__old")


def write_notes(notes: DataFrame, root: str, policy: str = "overwrite") -> DataFrame:
    """Writes the notes that have a path as files below root; (content_id, path, status, n_bytes) of each of them: created, updated or
    skipped. The policy says what becomes of notes that stand already. Nothing is written if the job fails."""
    placed = notes.filter("path_error is null")
    status = stored(write_status(placed, standing_notes(notes.sparkSession, root).select("path"), policy).select("content_id", "path", "status", "n_bytes"))
    write_note_files(placed, root, policy)
    return status
