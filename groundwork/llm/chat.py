"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into turn-aligned windows: with a budget of B tokens, H of them for history,
and a system turn of s tokens, a turn whose last token is the n-th of the conversation is new in step (n - 1) // (B - H - s).
A step is a window, but that a turn of more than H tokens that reaches over from the step before has one to itself (odd
numbers). Every window starts with the system turn (a first turn of role "system"), repeats the turns before its new ones
as far as they fit into H tokens and the budget, and then holds its new turns. The loss mask covers the texts of new
assistant turns only, so each target counts once. Only a window whose one new turn is longer than B - s exceeds the budget.

Turns are ordered by turn, role and text; a null role or text is empty; repeated rows are turns of their own. Control
strings inside roles and texts are escaped by one more backslash between "<" and "|", and a role's line ends by \\n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_PLACES = "array<struct<window:bigint,row:struct<at:int,shown:string,skip:int,size:int,target:boolean,repeated:boolean,tokens:bigint>>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    lines = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(F.replace(lines, F.lit("\\\\"), F.lit("\\")))


def token_count(text: Column) -> Column:
    """Runs of letters or digits, and other visible characters one by one."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def format_chats(turns: DataFrame, budget: int = 512, history: int = 128, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, window, text, n_repeated, n_tokens, loss): loss is an array of (first, end) code points of text; the first n_repeated turns of a window are repeated."""
    t = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("said"))
    order = W.partitionBy("conv").orderBy("turn", "role", "said")
    sofar = order.rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("at", F.row_number().over(order)).withColumn("tokens", (token_count(F.col("said")) + 4).cast("long"))  # 4 for the marks of a turn
    t = t.withColumn("first", (F.col("at") == 1) & (F.col("role") == "system"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("said"))
    t = t.select("conv", "turn", "role", "said", "at", "tokens", "first", F.concat(head, body, F.lit(END + "\n")).alias("shown"), F.length(head).alias("skip"), F.length(body).alias("size"), (F.col("role") == "assistant").alias("target"))
    t = t.withColumn("upto", F.sum(F.when(F.col("first"), 0).otherwise(F.col("tokens"))).over(sofar)).withColumn("held", F.coalesce(F.max(F.when(F.col("first"), F.col("tokens"))).over(sofar), F.lit(0)))
    step = F.greatest(F.lit(budget - history) - F.col("held"), F.lit(1)).cast("long")
    k = F.floor((F.col("upto") - 1) / step)
    over = (F.col("upto") - F.col("tokens") < k * step) & (F.col("tokens") > history)
    t = t.withColumn("window", F.when(F.col("first"), 0).otherwise(2 * k - over.cast("int")).cast("long"))
    # All of a conversation's turns are in one partition from here on: the first turn of each window, what room the window
    # has for history, and for each turn the windows that start within `history` tokens after its first token.
    before = F.lag(F.when(~F.col("first"), F.col("window"))).over(order)
    t = t.withColumn("starts", ~F.col("first") & F.coalesce(before != F.col("window"), F.lit(True)))
    shown = F.struct("at", "shown", "skip", "size", F.lit(False).alias("target"), F.lit(True).alias("repeated"), "tokens")
    t = t.withColumn("system", F.when(F.col("starts") & (F.col("window") > 0), F.max(F.when(F.col("first"), shown)).over(sofar)))
    t = t.drop("turn", "role", "said").withColumn("new", F.sum(F.when(F.col("first"), 0).otherwise(F.col("tokens"))).over(W.partitionBy("conv", "window")))
    begun = F.when(F.col("starts"), F.struct("window", (F.col("upto") - F.col("tokens")).alias("before"), F.least(F.lit(history), budget - F.col("held") - F.col("new")).alias("room")))
    t = t.withColumn("from", F.when(~F.col("first"), F.col("upto") - F.col("tokens")).otherwise(F.lit(-1).cast("long")))
    t = t.withColumn("later", F.collect_list(begun).over(W.partitionBy("conv").orderBy("from").rangeBetween(0, history)))
    told = F.filter("later", lambda w: ~F.col("first") & (w["window"] > F.col("window")) & (w["before"] - F.col("from") <= w["room"]))
    own = F.struct("at", "shown", "skip", "size", "target", F.lit(False).alias("repeated"), "tokens")
    places = F.concat(F.array(F.struct("window", own.alias("row"))), F.transform(told, lambda w: F.struct(w["window"].alias("window"), shown.alias("row"))), F.when(F.col("system").isNotNull(), F.array(F.struct("window", F.col("system").alias("row")))).otherwise(F.array().cast(_PLACES)))
    every = t.select("conv", F.explode(places).alias("p")).select("conv", "p.window", "p.row.*")
    windows = every.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("at", "shown", "skip", "size", "target", "repeated"))).alias("turns"), F.sum("tokens").alias("n_tokens"))
    # Places of the targets, by the lengths of what stands before them.
    empty = F.array().cast("array<struct<first:bigint,end:bigint>>")
    loss = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["shown"])).alias("at"),
            F.when(x["target"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["skip"]).alias("first"), (a["at"] + x["skip"] + x["size"]).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return windows.select(
        F.col("conv").alias(conv_col),
        "window",
        F.array_join(F.transform("turns", lambda x: x["shown"]), "").alias("text"),
        F.size(F.filter("turns", lambda x: x["repeated"])).alias("n_repeated"),
        "n_tokens",
        loss.alias("loss"),
    )


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, roles, texts, targets, n_chars) of each conversation, from the windows alone: every turn once, in order."""
    # Every turn is START, role, a line's end, text, END; neither of the marks stands inside one.
    turns = F.transform(F.split("text", END.replace("|", r"\|") + "\n"), lambda p: F.struct(F.substring_index(p, "\n", 1).alias("head"), p.alias("whole")))
    new = F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.size(turns) - 1 - F.col("n_repeated"), F.lit(0)))  # the last part is empty
    said = lambda p: F.substr(p["whole"], F.length(p["head"]) + 2)
    each = windows.select(
        F.col(conv_col).alias("conv"),
        F.struct(
            "window",
            F.transform(new, lambda p: unescape_role(F.substr(p["head"], F.lit(len(START) + 1)))).alias("roles"),
            F.transform(new, lambda p: unescape(said(p))).alias("texts"),
            F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["first"].cast("int") + 1, (s["end"] - s["first"]).cast("int")))).alias("targets"),
        ).alias("w"),
        F.length("text").cast("long").alias("n"),
    )
    whole = each.groupBy("conv").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("n").alias("n_chars"))
    flat = lambda name: F.flatten(F.transform("ws", lambda w: w[name])).alias(name)
    return whole.select(F.col("conv").alias(conv_col), flat("roles"), flat("texts"), flat("targets"), "n_chars")
