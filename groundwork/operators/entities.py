"""Entities, aliases, topics, their links to contents, and merges with conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions.text import fold_for_matching, one_line
from groundwork.operators.lineage import checkpointed
from groundwork.operators.warehouse import stable_id, upsert_links


def alias_index(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, canonical_name, aliases array, n_aliases): every entity, aliases in order."""
    grouped = aliases.groupBy("entity_id").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    out = entities.join(grouped, entities["id"] == grouped["entity_id"], "left")
    held = F.coalesce("aliases", F.array().cast("array<string>"))
    return out.select(F.col("id").alias("entity_id"), "canonical_name", held.alias("aliases"), F.size(held).alias("n_aliases"))


def surface_index(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(folded, canonical_name): folded surface forms; of several canonicals the first in (canonical, alias) order."""
    own = entities.select("canonical_name", F.lit("").alias("alias"), F.col("canonical_name").alias("surface"))
    other = aliases.join(entities.select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id").select("canonical_name", "alias", F.col("alias").alias("surface"))
    forms = own.unionByName(other).withColumn("folded", fold_for_matching(F.col("surface")))
    return forms.groupBy("folded").agg(F.min_by("canonical_name", F.struct("canonical_name", "alias")).alias("canonical_name"))


def canonical_names(names: DataFrame, index: DataFrame, key: str = "content_id") -> DataFrame:
    """names (key, ord, name) with `canonical`; unknown names stay; distinct by canonical within a key, first place kept."""
    folded = names.withColumn("folded", fold_for_matching(F.col("name")))
    found = folded.join(index, "folded", "left").withColumn("canonical", F.coalesce("canonical_name", "name"))
    return found.groupBy(key, "canonical").agg(F.min("ord").alias("ord"))


def resolve(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """names with entity_id and matched_by: the canonical name exactly, else an alias exactly, else null and "new"."""
    by_name = entities.select(F.col("canonical_name").alias("name"), F.col("id").alias("__id_1"))
    by_alias = aliases.select(F.col("alias").alias("name"), F.col("entity_id").alias("__id_2"))
    out = names.join(by_name, "name", "left").join(by_alias, "name", "left")
    return out.withColumns({"entity_id": F.coalesce("__id_1", "__id_2"), "matched_by": F.when(F.col("__id_1").isNotNull(), "canonical").when(F.col("__id_2").isNotNull(), "alias").otherwise("new")}).drop("__id_1", "__id_2")


def resolve_or_create(names: DataFrame, entities: DataFrame, aliases: DataFrame, types: tuple[str, ...] = ("person", "company", "place", "concept", "product", "organization", "other")) -> tuple[DataFrame, DataFrame]:
    """(resolved, entities): names (…, ord, name, entity_type) with an entity_id each, and the entities with the new ones. The first place of a new name gives its type."""
    clean = names.withColumn("name", one_line(F.col("name"))).filter("name <> ''")
    found = resolve(clean, entities, aliases)
    kind = F.when(F.col("entity_type").isin(*types), F.col("entity_type")).otherwise("other")
    new = found.filter("entity_id is null").groupBy("name").agg(F.min_by(kind, "ord").alias("entity_type"))
    new = new.select(stable_id("entity", F.col("name")).alias("id"), F.col("name").alias("canonical_name"), "entity_type", F.lit(None).cast("string").alias("description"))
    return found.withColumn("entity_id", F.coalesce("entity_id", stable_id("entity", F.col("name")))), entities.unionByName(new)


def resolve_or_create_topics(names: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    clean = names.withColumn("name", one_line(F.col("name"))).filter("name <> ''")
    new = clean.select("name").distinct().join(topics, "name", "left_anti").select(stable_id("topic", F.col("name")).alias("id"), "name")
    every = topics.select("id", "name").unionByName(new)
    return clean.join(every.select(F.col("id").alias("topic_id"), "name"), "name"), every


def add_aliases(aliases: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, aliases): requests (seq, entity_id, alias) judged new, own or conflict (with owner_id); the first request for a free alias gets it."""
    clean = requests.withColumn("alias", one_line(F.col("alias"))).filter("alias <> ''")
    first = clean.groupBy("alias").agg(F.min_by("entity_id", "seq").alias("first_id"), F.min("seq").alias("first_seq"))
    held = aliases.select("alias", F.col("entity_id").alias("held_by"))
    both = clean.join(held, "alias", "left").join(first, "alias")
    owner = F.coalesce("held_by", "first_id")
    verdict = F.when(owner != F.col("entity_id"), "conflict").when(F.col("held_by").isNull() & (F.col("seq") == F.col("first_seq")), "new").otherwise("own")
    verdicts = both.select("seq", "entity_id", "alias", verdict.alias("verdict"), F.when(owner != F.col("entity_id"), owner).alias("owner_id"))
    added = verdicts.filter("verdict = 'new'").select(stable_id("alias", F.col("alias")).alias("id"), "entity_id", "alias")
    return verdicts, aliases.select("id", "entity_id", "alias").unionByName(added)


def merge_plan(requests: DataFrame, entities: DataFrame, aliases: DataFrame, links: DataFrame) -> DataFrame:
    """requests (seq, source_id, target_id, delete_source) with an error, or the sorted surface forms to move, already owned
    and in conflict, the numbers of links to move and to drop, and blocked: a conflict where the source was to be deleted."""
    names = entities.select("id", "canonical_name")
    r = requests.join(names.select(F.col("id").alias("source_id"), F.col("canonical_name").alias("source_name")), "source_id", "left").join(names.select(F.col("id").alias("target_id"), F.col("canonical_name").alias("target_name")), "target_id", "left")
    blank = (F.coalesce(F.trim("source_id"), F.lit("")) == "") | (F.coalesce(F.trim("target_id"), F.lit("")) == "")
    error = F.when(blank, "BLANK").when(F.col("source_id") == F.col("target_id"), "SELF").when(F.col("source_name").isNull() | F.col("target_name").isNull(), "MISSING")
    r = r.withColumn("error", error)
    good = r.filter("error is null")
    forms = good.select("seq", "source_id", "target_id", "target_name", F.col("source_name").alias("surface")).unionByName(good.join(aliases.select(F.col("entity_id").alias("source_id"), F.col("alias").alias("surface")), "source_id").select("seq", "source_id", "target_id", "target_name", "surface"))
    owned = forms.distinct().join(aliases.select(F.col("alias").alias("surface"), F.col("entity_id").alias("owner")), "surface", "left")
    label = F.when((F.col("surface") == F.col("target_name")) | (F.col("owner") == F.col("target_id")), "owned").when(F.col("owner").isNull() | (F.col("owner") == F.col("source_id")), "to_move").otherwise("conflict")
    pick = lambda k: F.array_sort(F.collect_list(F.when(label == k, F.col("surface"))))
    by_form = owned.groupBy("seq").agg(pick("to_move").alias("to_move"), pick("owned").alias("owned"), pick("conflict").alias("conflicts"))
    of_target = links.select("content_id", F.col("entity_id").alias("target_id"), F.lit(True).alias("both"))
    by_link = good.select("seq", "source_id", "target_id").join(links.select("content_id", F.col("entity_id").alias("source_id")), "source_id").join(of_target, ["content_id", "target_id"], "left").groupBy("seq").agg(F.count_if(F.col("both").isNull()).alias("links_to_move"), F.count_if("both").alias("links_to_drop"))
    out = r.join(by_form, "seq", "left").join(by_link, "seq", "left")
    zero = lambda c: F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).alias(c)
    out = out.select("seq", "source_id", "target_id", "delete_source", "error", "to_move", "owned", "conflicts", zero("links_to_move"), zero("links_to_drop"))
    return out.withColumn("blocked", F.coalesce((F.size("conflicts") > 0) & F.col("delete_source"), F.lit(False)))


def _waiting(todo: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(seq) of the requests that must wait. A request changes its source and its source's surface forms and adds to its
    target; it waits if an earlier one changes what it uses, or uses what it changes."""
    uses = lambda rows, kind, c, changes: rows.select("seq", F.concat(F.lit(kind), F.col(c)).alias("thing"), F.lit(changes).alias("changes"))
    named = todo.join(entities.select(F.col("id").alias("source_id"), "canonical_name"), "source_id")
    called = todo.join(aliases.select(F.col("entity_id").alias("source_id"), "alias"), "source_id")
    every = uses(todo, "e", "source_id", True).unionByName(uses(todo, "e", "target_id", False)).unionByName(uses(named, "f", "canonical_name", True)).unionByName(uses(called, "f", "alias", True))
    firsts = every.groupBy("thing").agg(F.min("seq").alias("used"), F.max("seq").alias("last"), F.min(F.when(F.col("changes"), F.col("seq"))).alias("changed"))
    shared = checkpointed(firsts.filter("changed is not null and used < last").drop("last"))
    return every.join(shared, "thing").filter(F.col("seq") > F.when(F.col("changes"), F.col("used")).otherwise(F.col("changed"))).select("seq").distinct()


def _chains(todo: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(seq, entity_id, target_id, hops): the requests of chains that come out the same whether they are applied one by one or at
    once, with the entity at their chain's end and how far from it their source is.

    In such a chain each entity is the source of one request and the target of one at most, each request comes before the
    next one along the chain, sources are deleted, and nobody but the source or its target holds the source's name. Ends are
    found by pointer jumping over requests: each step doubles how far a request sees.
    """
    known = entities.select("id", "canonical_name")
    r = todo.join(known.select(F.col("id").alias("source_id"), "canonical_name"), "source_id").join(known.select(F.col("id").alias("target_id")), "target_id").filter("source_id <> target_id")
    held = aliases.select(F.col("alias").alias("canonical_name"), F.col("entity_id").alias("holder"))
    r = checkpointed(r.join(held, "canonical_name", "left").select("seq", "source_id", "target_id", (F.coalesce("delete_source", F.lit(False)) & (F.col("holder").isNull() | (F.col("holder") == F.col("source_id")) | (F.col("holder") == F.col("target_id")))).alias("plain")))
    out = r.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n_out"), F.min("seq").alias("next"))
    into = r.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n_in"), F.max("seq").alias("last"))
    ends = checkpointed(out.join(into, "id", "full").withColumn("odd", F.coalesce((F.col("n_out") > 1) | (F.col("n_in") > 1) | (F.col("next") < F.col("last")), F.lit(False))).select("id", "next", "odd"))
    at = lambda c: ends.select(F.col("id").alias(c), F.col("next").alias(f"{c}_next"), F.col("odd").alias(f"{c}_odd"))
    both = r.join(at("source_id"), "source_id").join(at("target_id"), "target_id")
    links = checkpointed(both.select("seq", F.when(~F.col("target_id_odd"), F.col("target_id_next")).alias("to"), F.lit(1).cast("long").alias("hops"), (F.col("plain") & ~F.col("source_id_odd") & ~F.col("target_id_odd")).alias("plain"), F.col("seq").alias("end")))
    while True:
        far = links.select(F.col("seq").alias("to"), F.col("to").alias("__to"), F.col("hops").alias("__hops"), F.col("end").alias("__end"))
        jumped = links.join(far, "to", "left")
        links = checkpointed(jumped.select("seq", F.col("__to").alias("to"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops"), "plain", F.coalesce("__end", "end").alias("end")))
        if links.filter("to is not null").isEmpty():
            break
    good = links.groupBy("end").agg(F.min("plain").alias("all_plain")).filter("all_plain").select("end")
    chosen = links.join(good, "end").join(r.select(F.col("seq").alias("end"), F.col("target_id")), "end")
    return checkpointed(chosen.join(r.select("seq", F.col("source_id").alias("entity_id")), "seq").select("seq", "entity_id", "target_id", "hops"))


def _contracted(chains: DataFrame, entities: DataFrame, aliases: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after all chains: one rewrite of each. The link nearest to a chain's end gives the confidence."""
    to = chains.select("entity_id", "target_id", "hops")
    names = entities.select("id", "canonical_name")
    own = to.join(names, to["entity_id"] == names["id"]).select("target_id", F.col("canonical_name").alias("alias"))
    forms = own.unionByName(aliases.join(to, "entity_id").select("target_id", "alias"))
    rest = aliases.join(to.select("entity_id"), "entity_id", "left_anti").select("id", "entity_id", "alias")
    forms = forms.join(names.select(F.col("id").alias("target_id"), F.col("canonical_name").alias("target_name")), "target_id").filter("alias <> target_name")
    gained = forms.join(rest.select("alias"), "alias", "left_anti").select(stable_id("alias", F.col("alias")).alias("id"), F.col("target_id").alias("entity_id"), "alias").dropDuplicates(["alias"])
    turned = links.join(to, "entity_id", "left").select("content_id", F.coalesce("target_id", "entity_id").alias("entity_id"), "confidence", F.coalesce("hops", F.lit(0)).alias("hops"))
    kept = entities.join(to.select(F.col("entity_id").alias("id")), "id", "left_anti").select(*entities.columns)
    return checkpointed(kept), checkpointed(rest.unionByName(gained)), checkpointed(turned.groupBy("content_id", "entity_id").agg(F.min_by("confidence", "hops").alias("confidence")))


def apply_merges(requests: DataFrame, entities: DataFrame, aliases: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, aliases, links) after all requests, in order of seq; dry_run requests write nothing.

    A request waits for earlier ones that take away its source or target, or that share its source or one of its source's
    surface forms; any number of sources go into one target at once. A round rewrites the tables from its plan, as one
    distributed job. If requests are left, rounds 2, 4, 8, ... also contract whole chains of requests, so
    that rounds don't follow a chain's length; only requests in conflict with each other, inside what they
    connect, go one after another. A request that names an entity that is gone by then is an error and does nothing.
    """
    todo = checkpointed(requests.filter(~F.coalesce("dry_run", F.lit(False))).select("seq", "source_id", "target_id", "delete_source"))
    rounds = 0
    while not todo.isEmpty():
        rounds += 1
        if rounds > 1 and rounds & (rounds - 1) == 0:  # in rounds 2, 4, 8, ...: where there is none, looking for chains costs little
            chains = _chains(todo, entities, aliases)
            if not chains.isEmpty():
                entities, aliases, links = _contracted(chains, entities, aliases, links)
                todo = checkpointed(todo.join(chains.select("seq"), "seq", "left_anti"))
                continue
        later = _waiting(todo, entities, aliases)
        now = checkpointed(todo.join(later, "seq", "left_anti"))
        plan = checkpointed(merge_plan(now, entities, aliases, links).filter("error is null"))
        done = plan.filter("not blocked")
        moves = plan.select(F.col("source_id").alias("entity_id"), "target_id", "delete_source", "blocked", F.explode(F.concat("to_move", "owned")).alias("alias"))
        targets = entities.select(F.col("id").alias("target_id"), F.col("canonical_name").alias("target_name"))
        moved = moves.join(targets, "target_id").filter("alias <> target_name")
        rest = aliases.join(moves.select("alias", "entity_id").distinct(), ["alias", "entity_id"], "left_anti").select("id", "entity_id", "alias")
        gained = moved.join(rest.select("alias"), "alias", "left_anti").select(stable_id("alias", F.col("alias")).alias("id"), F.col("target_id").alias("entity_id"), "alias").dropDuplicates(["alias"])
        aliases = checkpointed(rest.unionByName(gained))
        to = plan.select(F.col("source_id").alias("entity_id"), "target_id", "seq")
        turned = links.join(to, "entity_id", "left").select("content_id", F.coalesce("target_id", "entity_id").alias("entity_id"), "confidence", F.struct(F.col("target_id").isNotNull(), "seq").alias("moved"))
        links = checkpointed(turned.groupBy("content_id", "entity_id").agg(F.min_by("confidence", "moved").alias("confidence")))
        gone = done.filter("delete_source and size(conflicts) = 0").select(F.col("source_id").alias("id"))
        entities = checkpointed(entities.join(gone, "id", "left_anti").select(*entities.columns))
        todo = checkpointed(todo.join(now.select("seq"), "seq", "left_anti"))
    return entities, aliases, links


def merge_requests_by_name(requests: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """requests (seq, source_name, target_name, …) with source_id and target_id resolved; null where a name is unknown."""
    a = resolve(requests.withColumn("name", one_line(F.col("source_name"))), entities, aliases).withColumnRenamed("entity_id", "source_id").drop("matched_by", "name")
    return resolve(a.withColumn("name", one_line(F.col("target_name"))), entities, aliases).withColumnRenamed("entity_id", "target_id").drop("matched_by", "name")


def linked_names(links: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(content_id, entities): an ordered array of (canonical_name, aliases) for each content."""
    index = alias_index(entities, aliases)
    named = links.join(index, "entity_id")
    return named.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("canonical_name", "aliases"))).alias("entities"))


def linked_topics(links: DataFrame, topics: DataFrame) -> DataFrame:
    named = links.join(topics.select(F.col("id").alias("topic_id"), "name"), "topic_id")
    return named.groupBy("content_id").agg(F.array_sort(F.collect_list("name")).alias("topics"))


def link_contents(analysis_entities: DataFrame, analysis_topics: DataFrame, entities: DataFrame, aliases: DataFrame, topics: DataFrame, content_entities: DataFrame, content_topics: DataFrame) -> dict[str, DataFrame]:
    """New versions of the five tables after linking the names of analyses: (content_id, ord, name, entity_type) and (content_id, ord, name)."""
    order = F.concat_ws("\x1f", F.col("content_id").cast("string"), F.lpad(F.col("ord").cast("string"), 9, "0"))
    found, new_entities = resolve_or_create(analysis_entities.withColumn("ord", order), entities, aliases)
    nothing = F.lit(None).cast("double")
    links = found.select("content_id", "entity_id").distinct().select("content_id", "entity_id", nothing.alias("confidence"), F.lit(1).alias("seq"))
    named, new_topics = resolve_or_create_topics(analysis_topics, topics)
    topic_links = named.select("content_id", "topic_id").distinct().select("content_id", "topic_id", nothing.alias("confidence"), F.lit(1).alias("seq"))
    # A surface form that differs from the name it was resolved to becomes an alias of it.
    names = new_entities.select(F.col("id").alias("entity_id"), "canonical_name")
    spoken = found.join(names, "entity_id").filter("name <> canonical_name").select(F.col("ord").alias("seq"), "entity_id", F.col("name").alias("alias"))
    _, new_aliases = add_aliases(aliases, spoken)
    return {
        "entities": new_entities,
        "entity_aliases": new_aliases,
        "topics": new_topics,
        "content_entities": upsert_links(content_entities, links, ["content_id", "entity_id"]),
        "content_topics": upsert_links(content_topics, topic_links, ["content_id", "topic_id"]),
    }


def merge_candidates(entities: DataFrame) -> DataFrame:
    """(folded, names): names that only case or width keeps apart."""
    folded = entities.withColumn("folded", fold_for_matching(F.col("canonical_name")))
    return folded.groupBy("folded").agg(F.array_sort(F.collect_set("canonical_name")).alias("names")).filter("size(names) > 1")


