"""Column expressions for file names, code fences, paths and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwork.functions.text import WHITE, ZERO_WIDTH, let, trim_all

MAX_NAME = 80
#: Characters of a title that mostly give its name.
HEAD = 1000
# Names that Windows keeps for devices.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
_ILLEGAL = r"""[\\/:*?"<>|\x00-\x1f\x7f]"""


def _bare(x: Column) -> Column:
    return trim_all(F.regexp_replace(trim_all(x), r"^\.+|\.+$", ""))


def file_name(title: Column, content_id: Column) -> Column:
    """A title as a safe file name of at most 80 code points; without one the id's first 8, then "untitled". No NFKC."""
    legal = lambda x: F.regexp_replace(F.regexp_replace(x, f"[{ZERO_WIDTH}]", ""), _ILLEGAL, "")
    line = lambda x: _bare(F.regexp_replace(legal(x), r"(?U)\s+", " "))
    # What the start of a title gives is the start of what all of it gives, if it is as long as a name can be; else all is looked at.
    whole = let(F.coalesce(title, F.lit("")), lambda x: let(line(F.substring(x, 1, HEAD)), lambda head: F.when((F.length(head) >= MAX_NAME) | (F.length(x) <= HEAD), head).otherwise(line(x))))
    spare = F.regexp_replace(trim_all(F.substring(trim_all(F.regexp_replace(F.coalesce(content_id, F.lit("")), _ILLEGAL, "")), 1, 8)), r"^\.+|\.+$", "")
    name = let(_bare(F.substring(whole, 1, MAX_NAME)), lambda cut: F.when(cut != "", cut).when(spare != "", spare).otherwise(F.lit("untitled")))
    return let(name, lambda n: F.when(F.upper(F.substring_index(n, ".", 1)).isin(*RESERVED), F.concat(F.lit("_"), n)).otherwise(n))


def fenced(text: Column) -> Column:
    """The text in a code fence longer than its longest run of back-ticks."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    longest = F.when(F.contains(text, F.lit("`")), F.array_max(runs)).otherwise(0)
    marks = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    # No pattern goes over the characters: the end alone tells whether there is anything to take off.
    bare = F.when(F.substring(text, -1, 1).rlike(r"(?U)\s"), F.rtrim(text, F.lit(WHITE))).otherwise(text)
    return let(marks, lambda fence: F.concat(fence, F.lit("text\n"), bare, F.lit("\n"), fence))


def path_inside(path: Column) -> Column:
    """Whether a relative path never leaves its folder: no root, no home, no prefix with more ".." than names."""
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda a, part: F.struct(
            (a["now"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)).alias("now"),
            F.least(a["low"], a["now"] + F.when(part == "..", -1).otherwise(0)).alias("low"),
        ),
        lambda a: a["low"],
    )
    return path.isNotNull() & (path != "") & ~path.startswith("/") & ~path.startswith("~") & (depth >= 0)


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def cutoff(as_of: Column, seconds: int) -> Column:
    return as_of - F.make_dt_interval(secs=F.lit(max(0, seconds)))
