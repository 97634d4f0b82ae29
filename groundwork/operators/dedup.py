"""Fingerprints and duplicates: within an arriving batch, against stored contents, and after a change of the fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundwork.functions.text import HASH_FIELDS, HASH_VERSION, content_hash, hash_payload, normalize_text, resolve_source_id
from groundwork.operators.lineage import checkpointed, small_batches


def fingerprinted(raw: DataFrame) -> DataFrame:
    """raw with content_hash, content_hash_version, discriminating, and source_id resolved; fields that raw lacks count as empty."""
    small_batches(raw.sparkSession)
    field = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    norm = raw.withColumns({f"__{c}": normalize_text(field(c)) for c in (*HASH_FIELDS, "source_id")})
    norm = norm.withColumn("content_hash", content_hash(hash_payload(*(F.col(f"__{c}") for c in HASH_FIELDS)))).withColumn("content_hash_version", F.lit(HASH_VERSION))
    says = F.lit(False)
    for c in HASH_FIELDS[1:]:
        says = says | (F.col(f"__{c}") != "")
    source_id, review, error = resolve_source_id(F.col("__source_id"), F.col("content_hash"))
    out = norm.withColumns({"discriminating": says, "raw_source_id": field("source_id"), "source_id": source_id, "needs_manual_review": review, "error_type": error})
    return out.drop(*(f"__{c}" for c in (*HASH_FIELDS, "source_id")))


def _leaders(open_: DataFrame) -> DataFrame:
    """The undecided rows (seq, k1, k2) that are first by both of their keys; a null k2 is no key."""
    by_id = open_.groupBy("k1").agg(F.min("seq").alias("seq"), F.min_by("k2", "seq").alias("k2"))
    by_hash = open_.filter("k2 is not null").groupBy("k2").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("leads"))
    return by_id.join(by_hash, "seq", "left").filter("k2 is null or leads").select("seq", "k1", "k2")


def _chained(open_: DataFrame) -> DataFrame:
    """The leaders, and all rows whose fate follows from them along chains: rows with a single undecided row before them, by one
    of their keys or by both, are kept if that one isn't. Chains are contracted by pointer jumping: each step doubles how far
    a row sees along its chain, and flips its parity as often, so steps follow the logarithm of the longest chain."""

    def two(key: str, rank: str, before: str) -> DataFrame:  # the two first rows of a key are all that counts
        order = W.partitionBy(key).orderBy("seq")
        return open_.filter(f"{key} is not null").withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= 2).withColumn(before, F.lag("seq").over(order))

    one, other = two("k1", "r1", "b1"), two("k2", "r2", "b2").select("seq", "r2", "b2")
    both = one.join(other, "seq", "left").filter("k2 is null or r2 is not null").na.fill(1, ["r2"])
    single = F.col("b1").isNull() | F.col("b2").isNull() | (F.col("b1") == F.col("b2"))
    # to: the row that this one hangs on, null for a leader; flips: whether its fate is the opposite of that one's
    links = checkpointed(both.filter(single).select("seq", "k1", "k2", F.coalesce("b1", "b2").alias("to")).withColumn("flips", F.col("to").isNotNull()))
    while True:
        far = links.select(F.col("seq").alias("to"), F.col("to").alias("__to"), F.col("flips").alias("__flips"), F.lit(True).alias("__known"))
        seen = links.join(far, "to", "left")  # a row that hangs on one that isn't here waits for it
        jumps = F.col("__to").isNotNull()
        jumped = seen.select("seq", "k1", "k2", F.when(jumps, F.col("__to")).otherwise(F.col("to")).alias("to"), F.when(jumps, F.col("flips") != F.col("__flips")).otherwise(F.col("flips")).alias("flips"), jumps.alias("moved"), (F.col("to").isNull() | (F.col("__known") & F.col("__to").isNull())).alias("ended"))
        jumped = checkpointed(jumped)
        if jumped.filter("moved").isEmpty():
            return jumped.filter("ended and not flips").select("seq", "k1", "k2")
        links = jumped.select("seq", "k1", "k2", "to", "flips")


def within_batch(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """rows with `kept` and, for those that are not kept, `duplicate_of` (the seq of a kept row) and `deduplicated_by`.

    A row is kept if no earlier kept row has its (source, source_id) or, if it is discriminating, its (source,
    content_hash, version). In rounds: rows that are first among the undecided by both keys are kept, undecided rows that
    share a key with a kept row are dropped. Most batches end there. Of what is left, a round also decides whole chains
    of rows that each hang on the one before, in a number of steps that grows with the logarithm of their length; only rows with
    several undecided rows before them wait for the next round. Each round's state is a written table of keys, not of rows.
    First rows are found by aggregates and by windows that Spark limits before it shuffles; rows of a hot key only meet the
    kept ones, of which a key has one, in joins whose sides are both shuffled as they are and can be split.
    """
    keys = rows.select(F.col(seq).alias("seq"), F.sha2(F.concat_ws("\x1f", "source", "source_id"), 256).alias("k1"), F.when(F.col("discriminating"), F.sha2(F.concat_ws("\x1f", "source", "content_hash", F.col("content_hash_version").cast("string")), 256)).alias("k2"))
    open_ = keys = checkpointed(keys)
    kept = None
    while True:
        firsts = checkpointed(_leaders(open_) if kept is None else _chained(open_))
        kept = firsts if kept is None else kept.unionByName(firsts)
        rest = open_.join(firsts.select("k1"), "k1", "left_anti").join(firsts.filter("k2 is not null").select("k2"), "k2", "left_anti")
        open_ = checkpointed(rest.select("seq", "k1", "k2"))
        if open_.isEmpty():
            break
    by_id = kept.select("k1", F.col("seq").alias("same_id"))
    by_hash = kept.filter("k2 is not null").select("k2", F.col("seq").alias("same_hash"))
    told = keys.join(by_id, "k1", "left").join(by_hash, "k2", "left").withColumn("kept", F.coalesce(F.col("same_id") == F.col("seq"), F.lit(False)))
    # A kept row is alone with its identity; a dropped one first asks for an earlier row of its identity, then of its hash.
    earlier_id = F.when(F.col("same_id") < F.col("seq"), F.col("same_id"))
    told = told.select(
        F.col("seq").alias("__seq"),
        "kept",
        F.when(~F.col("kept"), F.coalesce(earlier_id, "same_hash")).alias("duplicate_of"),
        F.when(~F.col("kept"), F.when(earlier_id.isNotNull(), "source_id").otherwise("content_hash")).alias("deduplicated_by"),
    )
    return rows.join(told, rows[seq] == told["__seq"]).drop("__seq")


def against_stored(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """rows with outcome (new, reuse, duplicate), matched_id and deduplicated_by against the stored contents.

    The same (source, source_id) first; else, for a discriminating row, the same (source, content_hash, version): of
    several the completed one with an analysis, else the earliest. Only a completed match with an analysis is a duplicate;
    any other match is the row to use again.
    """
    done = (F.col("status") == "completed") & F.col("current_analysis_id").isNotNull()
    stored = contents.select("id", "source", "source_id", "content_hash", "content_hash_version", "created_at", done.alias("done"))
    by_id = stored.select("source", "source_id", F.col("id").alias("id_1"), F.col("done").alias("done_1"))
    best = stored.groupBy("source", "content_hash", "content_hash_version").agg(F.min_by(F.struct("id", "done"), F.struct(~F.col("done"), "created_at", "id")).alias("best"))
    by_hash = best.select("source", "content_hash", "content_hash_version", F.col("best.id").alias("id_2"), F.col("best.done").alias("done_2"), F.lit(True).alias("discriminating"))
    out = rows.join(by_id, ["source", "source_id"], "left").join(by_hash, ["source", "content_hash", "content_hash_version", "discriminating"], "left")
    match, finished = F.coalesce("id_1", "id_2"), F.when(F.col("id_1").isNotNull(), F.col("done_1")).otherwise(F.col("done_2"))
    outcome = F.when(match.isNull(), "new").when(finished, "duplicate").otherwise("reuse")
    by = F.when(F.col("id_1").isNotNull(), "source_id").when(F.col("id_2").isNotNull(), "content_hash")
    return out.withColumns({"matched_id": match, "outcome": outcome, "matched_by": by}).drop("id_1", "id_2", "done_1", "done_2")


def migrate_hashes(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, report) of the move to the current fingerprint version; nothing is written.

    plan: rows of another version with new_hash, new_source_id and conflict. Only ids that were derived from the
    fingerprint change; such an id is in conflict if another row holds it or an earlier row of the plan has claimed it.
    """
    small_batches(contents.sparkSession)
    old = contents.filter(F.col("content_hash_version") != HASH_VERSION)
    norm = old.withColumn("new_hash", content_hash(hash_payload(*(normalize_text(F.col(c)) for c in HASH_FIELDS))))
    derived = F.col("source_id").startswith("hash:")
    plan = norm.withColumn("new_source_id", F.when(derived, F.concat(F.lit("hash:"), F.substring("new_hash", 1, 16))).otherwise(F.col("source_id")))
    moved = plan.withColumn("moves", F.col("new_source_id") != F.col("source_id"))
    owners = contents.select("source", F.col("source_id").alias("new_source_id"), F.col("id").alias("owner"))
    claim = F.row_number().over(W.partitionBy("source", "new_source_id").orderBy("created_at", "id"))
    claims = moved.filter("moves").select("id", claim.alias("claim"))
    judged = moved.join(owners, ["source", "new_source_id"], "left").join(claims, "id", "left")
    judged = judged.withColumn("conflict", F.coalesce(F.col("moves") & ((F.col("owner").isNotNull() & (F.col("owner") != F.col("id"))) | (F.col("claim") > 1)), F.lit(False)))
    plan = judged.select("id", "source", "source_id", "new_source_id", F.col("content_hash").alias("old_hash"), "new_hash", "moves", "conflict")
    facts = plan.agg(F.count("*").alias("planned"), F.count_if("conflict").alias("conflicts"), F.count_if(F.col("moves") & ~F.col("conflict")).alias("ids_moved"))
    scanned = contents.agg(F.count("*").alias("scanned"), F.count_if(F.col("content_hash_version") == HASH_VERSION).alias("up_to_date"))
    return plan, scanned.crossJoin(facts)
