"""Checking claims against their sources by rules on evidence, entities and numbers.

claims(content_id, ord, text, type, evidence array<struct<type, description>>, ...), sources(content_id, text),
entities(content_id, ord, name), aliases(canonical, alias). All joins keep content_id as an equi key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundwork.functions.text import fold_for_matching
from groundwork.operators.lineage import stored
from groundwork.operators.numbers import extract_numbers, is_key, ungrounded

# What each rule says.
RULES = {
    "R1": "没有任何非 none 证据",
    "R2.1": "claim 中出现的实体在源文本里全部找不到",
    "R2.2": "claim 中的关键数字在源文本里找不到对应值",
    "R2.3": "概括性断言缺少可追溯的来源支撑",
}
GROUNDED = "证据与来源可追溯"
NO_ENTITY, NO_NUMBER = "未命中实体：", "未命中数字："


def surface_forms(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(content_id, ord, name, alias, folded): an entity's own name and its aliases, blank ones left out."""
    own = entities.select("content_id", "ord", "name", F.col("name").alias("alias"))
    other = entities.join(aliases.select(F.col("canonical").alias("name"), "alias"), "name").select("content_id", "ord", "name", "alias")
    forms = own.unionByName(other).distinct().filter(F.trim("alias") != "")
    return forms.withColumn("folded", fold_for_matching(F.col("alias")))


def _forms_by_content(forms: DataFrame) -> DataFrame:
    """(content_id, forms): a content's surface forms as one array, so that its texts are joined once and not once a form."""
    return forms.groupBy("content_id").agg(F.collect_list(F.struct("ord", "name", "alias", "folded")).alias("forms"))


def _within(text: Column) -> Column:
    return F.filter("forms", lambda f: F.contains(text, f["folded"]))


def entity_hits(claims: DataFrame, forms: DataFrame) -> DataFrame:
    """(content_id, claim_ord, ord, name, matched_alias): the entities that a claim names, by their longest alias in it."""
    folded = claims.select("content_id", F.col("ord").alias("claim_ord"), fold_for_matching(F.col("text")).alias("said"))
    near = folded.join(_forms_by_content(forms), "content_id").select("content_id", "claim_ord", F.explode(_within(F.col("said"))).alias("form")).select("content_id", "claim_ord", "form.*")
    best = F.min_by("alias", F.struct(-F.length("alias"), "alias"))  # of equally long ones the first in order
    return near.groupBy("content_id", "claim_ord", "ord", "name").agg(best.alias("matched_alias"))


def ground(claims: DataFrame, sources: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """claims with rules, needs_verification, path, entities, ungrounded_entities, numbers, ungrounded_numbers and detail."""
    forms = surface_forms(entities, aliases)
    hits = entity_hits(claims, forms)
    folded = sources.select("content_id", fold_for_matching(F.col("text")).alias("source"))
    found = folded.join(_forms_by_content(forms), "content_id").select("content_id", F.explode(F.array_distinct(_within(F.col("source"))["ord"])).alias("ord")).distinct().withColumn("in_source", F.lit(True))
    by_entity = hits.join(found, ["content_id", "ord"], "left").withColumn("in_source", F.coalesce("in_source", F.lit(False)))
    in_order = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "name")))), lambda x: x["name"])
    named = by_entity.groupBy("content_id", F.col("claim_ord").alias("ord")).agg(in_order(F.lit(True)).alias("entities"), in_order(~F.col("in_source")).alias("ungrounded_entities"), F.bool_or("in_source").alias("any_entity"))

    claim_numbers = extract_numbers(claims.select("content_id", F.col("ord").alias("claim_ord"), "text"), ["content_id", "claim_ord"], "text")
    claim_numbers = stored(claim_numbers.filter(is_key(F.col("value"), F.col("kind"), F.col("scale"))))  # read twice: texts go to Python once
    source_numbers = extract_numbers(sources, ["content_id"], "text").filter(is_key(F.col("value"), F.col("kind"), F.col("scale")))
    missing = ungrounded(claim_numbers, source_numbers, "content_id", ["claim_ord"]).select("content_id", "claim_ord", "ord", F.lit(True).alias("missing"))
    said = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "raw")))), lambda x: x["raw"])
    counted = claim_numbers.join(missing, ["content_id", "claim_ord", "ord"], "left").groupBy("content_id", F.col("claim_ord").alias("ord")).agg(said(F.lit(True)).alias("numbers"), said(F.col("missing")).alias("ungrounded_numbers"))

    none = F.array().cast("array<string>")
    out = claims.join(named, ["content_id", "ord"], "left").join(counted, ["content_id", "ord"], "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("entities", "ungrounded_entities", "numbers", "ungrounded_numbers")})
    evidence = F.coalesce("evidence", F.array().cast(dict(claims.dtypes)["evidence"]))
    has_evidence = F.exists(evidence, lambda e: e["type"] != "none")
    supported = F.exists(evidence, lambda e: (e["type"] != "none") & (F.trim(F.coalesce(e["description"], F.lit(""))) != ""))
    semantic = (F.size("entities") == 0) & (F.size("numbers") == 0)
    rules = F.array_compact(
        F.array(
            F.when(~has_evidence, "R1"),
            F.when((F.size("entities") > 0) & ~F.coalesce("any_entity", F.lit(False)), "R2.1"),
            F.when(F.size("ungrounded_numbers") > 0, "R2.2"),
            F.when(semantic & has_evidence & ~supported, "R2.3"),
        )
    )
    out = out.withColumns({"rules": rules, "path": F.when(semantic, "semantic").otherwise("structured")}).drop("any_entity")
    texts = F.create_map(*(F.lit(x) for pair in RULES.items() for x in pair))
    extras = F.array_join(
        F.array_compact(F.array(F.when(F.size("ungrounded_entities") > 0, F.concat(F.lit(NO_ENTITY), F.array_join("ungrounded_entities", ", "))), F.when(F.size("ungrounded_numbers") > 0, F.concat(F.lit(NO_NUMBER), F.array_join("ungrounded_numbers", ", "))))), "；"
    )
    reasons = F.array_join(F.transform("rules", lambda r: texts[r]), "；")
    detail = F.when(F.size("rules") == 0, GROUNDED).otherwise(F.concat(reasons, F.when(extras != "", F.concat(F.lit("（"), extras, F.lit("）"))).otherwise("")))
    return out.withColumns({"needs_verification": F.size("rules") > 0, "detail": detail})


def report(grounded: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each content: claims, those that need verification, their texts in order, and the source's length."""
    flagged = F.transform(F.array_sort(F.collect_list(F.when(F.col("needs_verification"), F.struct("ord", "text")))), lambda x: x["text"])
    sums = grounded.groupBy("content_id").agg(F.count("*").alias("n_claims"), F.count_if("needs_verification").alias("n_unverified"), flagged.alias("unverified_claims"))
    length = sources.select("content_id", F.length("text").alias("source_chars"))
    return sums.withColumn("n_verified", F.col("n_claims") - F.col("n_unverified")).join(length, "content_id", "left")


def rules_fired(grounded: DataFrame) -> DataFrame:
    return grounded.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def core_claims(claims: DataFrame, top: int = 5) -> DataFrame:
    """The claims of highest confidence of each content, ties by order."""
    n = F.row_number().over(W.partitionBy("content_id").orderBy(F.desc("confidence"), "ord"))
    return claims.withColumn("rank", n).filter(F.col("rank") <= top)
