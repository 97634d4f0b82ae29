"""Document fingerprints by spot signatures, with DataFrame functions alone.

A spot signature is a run of common words (the anchor) and the chain of the next content words after it, other common
words skipped. A document's fingerprint is the sorted set of its signatures' 32-bit hashes; a text without any signature has
one for its whole normalised text. Likeness is the Jaccard coefficient of two such sets; where
a least likeness is asked for, sizes alone rule most pairs out.

similar_pairs() and linked_classes() partition the sets by size: a set meets only sets of its own and the next size class, and in them only
those with which it shares one of its rarest signatures (as many as a pair at the threshold can't all miss). Equal sets
are one class, so copies are never paired with each other.

Null and empty texts have an empty fingerprint; two empty fingerprints have likeness 1. Very long texts are taken whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundwork.llm.common import stored

#: Shuffle partitions of with_next at most; beyond them a partition holds more, which its sort spills.
MOST_PARTS = 100_000

# Common words of English, French, German and Spanish, by first letter.
ANCHORS = """
a al als an and are as at au auf aus be bei by con da das de del dem den der des die di do du e ein eine einer el en er es est et
for from für il im in is ist it je kann la las le les lo los mit ne nicht no nous of on or os ou para pas por pour qu que qui
se sich sie sind son sont su sur that the there this to un una und une von vous was we with y you zu zum
""".split()


def _one_of(words: list[str]) -> str:
    """A pattern for one of the words, by first letter, so that most are never tried."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in sorted(by.items())) + ")"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def signatures(text: Column, chain: int = 2) -> Column:
    """The sorted distinct hashes of a text's spot signatures."""
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    # Common words are glued to the content word after them, so the array of what stands between spaces is the content
    # words, each with its anchors; a chain takes the following ones without theirs.
    glued = F.trim(F.regexp_replace(flat, f"(?<= )({_one_of(ANCHORS)}) ", "$1_"))

    def spots(ws: Column) -> Column:
        bare = lambda w: F.nullif(F.substring_index(w, "_", -1), F.lit(""))  # noqa: E731  common words at the end have no content word
        chained = lambda w, i: F.when(F.contains(w, F.lit("_")) & ~F.endswith(w, F.lit("_")), F.hash(w, *(bare(F.get(ws, i + k)) for k in range(1, chain))))
        return F.array_compact(F.transform(ws, chained))

    def or_whole(glued: Column) -> Column:
        whole = F.when(glued == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(glued)))
        return _let(_let(F.split(glued, " "), spots), lambda found: F.when(F.size(found) > 0, F.sort_array(F.array_distinct(found))).otherwise(whole))

    return _let(glued, or_whole)


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard coefficient of two sets; 0 without comparing them if their sizes alone keep it below least."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(large == 0, 1.0).when(small < least * large, 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprint(signatures: Column) -> Column:
    return F.array_join(signatures.cast("array<string>"), " ")


def with_next(rows: DataFrame, order_col: str, carried: list[str], derived: dict[str, Column] | None = None, parts: int | None = None, cells: int = 256, part_bytes: int = 32 << 20) -> DataFrame:
    """Each row with the carried columns of the next row in descending order, as next_*; the first row follows the last.

    order_col is a number. Rows that share one follow each other by their carried columns, smallest first. derived columns
    are computed once for each row, after the rows are dealt out, and carried too. Rows without an order have no next row.

    Rows are dealt by ranges of the order column: at most `cells` ranges between approximate quantiles, each cut evenly
    until there is one for every part_bytes of the carried columns (MOST_PARTS at most), or `parts` of them. A range also gets a copy of the
    first row of the next range that has rows, so one window over ranges is enough and nothing but a row for each range is
    put in order as a whole.
    """
    derived = derived or {}
    order = F.col(order_col)
    known = rows.filter(order.isNotNull())
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in carried if dict(rows.dtypes)[c] == "string"), F.lit(16))
    facts = known.agg(F.percentile_approx(order_col, [i / cells for i in range(1, cells)], 10_000).alias("cuts"), F.sum(size).alias("bytes")).first()
    parts = parts or min(MOST_PARTS, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((facts["bytes"] or 0) / part_bytes)))
    cuts = sorted(set(facts["cuts"] or []))  # at most `cells` numbers
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    cell = F.size(F.filter(bounds, lambda c: c <= order))
    share = max(1, math.ceil(parts / (len(cuts) + 1)))
    low, high = F.get(bounds, F.col("cell") - 1), F.get(bounds, F.col("cell"))
    sub = F.coalesce(F.least(F.floor((order - low) / (high - low) * share), F.lit(share - 1)), F.lit(0)).cast("int")
    dealt = known.withColumn("cell", cell).withColumn("sub", sub)
    heads = dealt.select("cell", "sub", order_col).groupBy("cell", "sub").agg(F.max(order_col).alias(order_col))  # one row a range
    before = W.orderBy(F.desc("cell"), F.desc("sub"))
    first = heads.agg(F.min_by(F.struct("cell", "sub"), order_col).alias("end"))
    moved = heads.withColumn("to", F.lag(F.struct("cell", "sub")).over(before)).crossJoin(F.broadcast(first)).select(order_col, F.coalesce("to", "end").alias("to"))
    head_rows = known.join(F.broadcast(moved) if parts <= 100_000 else moved, order_col).groupBy(order_col, "to").agg(F.min(F.struct(*carried)).alias("row"))
    head_rows = head_rows.select(order_col, *(F.col(f"row.{c}").alias(c) for c in carried), F.col("to.cell").alias("cell"), F.col("to.sub").alias("sub"), F.lit(False).alias("real"))
    both = dealt.withColumn("real", F.lit(True)).unionByName(head_rows, allowMissingColumns=True).repartition(parts, "cell", "sub").withColumns(derived)
    after = W.partitionBy("cell", "sub").orderBy(F.desc("real"), F.desc(order_col), *carried)
    both = both.withColumns({f"next_{c}": F.lead(c).over(after) for c in (*carried, *derived)})
    kinds = dict(both.dtypes)
    lost = rows.filter(order.isNull()).withColumns({**derived, **{f"next_{c}": F.lit(None).cast(kinds[f"next_{c}"]) for c in (*carried, *derived)}})
    return both.filter("real").drop("cell", "sub", "real").unionByName(lost)


def similar_pairs(docs: DataFrame, likeness: float = 0.8, chain: int = 2, hot: int = 500, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, likeness) of class representatives, a < b; members (id, representative) of all documents.

    The rows of a signature that more than `hot` sets hold are split over tasks. Ids are taken to be unique. Texts without a
    signature are in neither. Sets, classes, the signatures' counts and the rarest signatures are written once, so that texts are read once and
    joins on a hot signature or class have sides that Spark can split."""
    # A column of one row's generator: the filter would make all signatures once more below a plain projection.
    sets = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.array(signatures(F.col(f"`{text_col}`"), chain))).alias("sigs")).filter("size(sigs) > 0")
    keyed = stored(sets.withColumn("key", F.sha2(fingerprint(F.col("sigs")).cast("binary"), 256)))
    classes = keyed.groupBy("key").agg(F.min("id").alias("rep"))
    members = keyed.select("id", "key").join(classes, "key").select("id", F.col("rep").alias("representative"))
    firsts = keyed.groupBy("key").agg(F.min_by(F.struct("id", "sigs"), "id").alias("first"))
    reps = stored(firsts.select("first.id", "first.sigs", F.size("first.sigs").alias("n")))
    each = reps.select("id", "n", F.explode("sigs").alias("sig"))
    rare = each.join(stored(each.groupBy("sig").agg(F.count("*").alias("df"))), "sig").withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("df", "sig")))
    prefix = stored(rare.filter(F.col("rank") <= F.col("n") - F.ceil(F.lit(likeness) * F.col("n")) + 1))  # both sides of the join
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(likeness) or 1.0))
    shares = F.ceil(F.col("df") / hot).cast("int")
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "sig", F.pmod(F.xxhash64("id"), shares).cast("int").alias("share"), F.explode(F.array(size_class, size_class + 1)).alias("size_class"))
    right = prefix.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "sig", size_class.alias("size_class"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    near = left.join(right, ["size_class", "sig", "share"]).filter((F.col("a") != F.col("b")) & (F.least("n_a", "n_b") >= likeness * F.greatest("n_a", "n_b")))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    full = near.join(reps.select(F.col("id").alias("a"), F.col("sigs").alias("sigs_a")), "a").join(reps.select(F.col("id").alias("b"), F.col("sigs").alias("sigs_b")), "b")
    pairs = full.select("a", "b", jaccard(F.col("sigs_a"), F.col("sigs_b"), likeness).alias("likeness")).filter(F.col("likeness") >= likeness)
    return pairs, members


def linked_classes(docs: DataFrame, likeness: float = 0.8, chain: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, representative, n_links, closest) of every document: the smallest id with its fingerprint, with how many other
    fingerprints it has a likeness of at least `likeness`, and the largest of those (null without one).

    Null and empty texts, and null ids, have no links and stand for themselves; an id with several texts has the smallest of their
    representatives. One row for each row. Links are counted where they are verified; none is dropped."""
    pairs, members = similar_pairs(docs, likeness, chain, id_col=id_col, text_col=text_col)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("representative"), "likeness")
    links = ends.groupBy("representative").agg(F.count("*").alias("n_links"), F.max("likeness").alias("closest"))
    ids = docs.select(F.col(f"`{id_col}`").alias("id"))
    named = ids.join(members.groupBy("id").agg(F.min("representative").alias("representative")), "id", "left").withColumn("representative", F.coalesce("representative", "id"))
    return named.join(links, "representative", "left").select("id", "representative", F.coalesce("n_links", F.lit(0)).alias("n_links"), "closest")
