"""Cleaning of extraction records: canonical names, resolved endpoints, duplicates, review flags.

A record's entities, relations and events are arrays of its own row, so cleaning is a projection: it never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora import ontology, schemas
from tempora.functions.arrays import first_by, let, safe
from tempora.functions.lookup import at
from tempora.functions.text import alias_key, event_id, flag, fold, location_flags, norm_name, slug_unicode

#: Alias tables up to this size become a literal map; larger ones have to be joined with `resolve_names`.
MOST_ALIASES = 50_000


def alias_map(aliases: DataFrame) -> Column:
    """alias_key -> struct(name, type) of an alias table (alias, canonical_name, canonical_type), whose size is checked."""
    rows = aliases.limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases: use resolve_names")
    entries = [F.struct(F.lit(r["alias"]), F.struct(F.lit(r["canonical_name"]).alias("name"), F.lit(r["canonical_type"]).cast("string").alias("type"))) for r in rows]
    return F.map_from_entries(F.array(*entries)) if entries else F.create_map().cast("map<string,struct<name:string,type:string>>")


def canonical(plain: Column, kind: Column, aliases: Column) -> Column:
    """struct(name, type) of a name (of norm_name): without "the " for nation states, then by alias; an alias's type counts if the ontology has it."""
    plain = F.when((kind == "NationState") & F.lower(plain).startswith("the "), F.substring(plain, 5, 1 << 30)).otherwise(plain)

    def named(x: Column) -> Column:
        known = F.when(x["alias"]["type"].isin(*ontology.ENTITY_TYPES), x["alias"]["type"]).otherwise(kind)
        return F.struct(F.coalesce(x["alias"]["name"], x["plain"]).alias("name"), F.when(x["alias"].isNull(), kind).otherwise(known).alias("type"))

    return let(let(plain, lambda p: F.struct(p.alias("plain"), at(aliases, alias_key(p)).alias("alias"))), named)


def resolve_names(rows: DataFrame, name: str, aliases: DataFrame, out: str = "canonical_name") -> DataFrame:
    """`rows` with the canonical name of the column `name`, by a join with an alias table of any size."""
    table = aliases.select(F.col("alias").alias("_alias"), F.col("canonical_name").alias("_canonical"))
    joined = rows.join(table, alias_key(name) == F.col("_alias"), "left")
    return joined.withColumn(out, F.coalesce("_canonical", norm_name(name))).drop("_alias", "_canonical")


def resolved(plain: Column, index: Column, aliases: Column) -> Column:
    """The name of the record's entity that `plain` (of norm_name) stands for, directly or by its alias; else null."""
    return let(fold(plain), lambda key: F.coalesce(at(index, key)["name"], at(index, fold(at(aliases, F.replace(key, F.lit("."), F.lit("")))["name"]))["name"]))


def _quoted(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def clean_relations(relations: Column, index: Column, aliases: Column) -> tuple[Column, Column]:
    """(relations with resolved endpoints, first of equal ones; flags of the dropped)."""
    both = cleaned_relations(relations, index, aliases)
    return both["kept"], both["flags"]


def cleaned_relations(relations: Column, index: Column, aliases: Column) -> Column:
    """struct(kept, flags) of clean_relations, of which each name is cleaned and looked up once."""
    said = F.transform(safe(relations), lambda r: F.struct(norm_name(r["source"]).alias("source"), norm_name(r["target"]).alias("target"), r["type"].alias("type"), norm_name(r["evidence"]).alias("evidence")))
    said = F.filter(said, lambda r: (r["source"] != "") & (r["target"] != "") & (r["evidence"] != "") & r["type"].isin(*ontology.RELATION_TYPES))
    seen = F.transform(said, lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), r["type"].alias("type"), r["evidence"].alias("evidence"), resolved(r["source"], index, aliases).alias("s"), resolved(r["target"], index, aliases).alias("t")))
    missing = lambda r: r["s"].isNull() | r["t"].isNull()
    reason = lambda r: F.when(missing(r), flag("relation_missing_entity", _quoted("Relation '", r["type"], "' dropped because source '", r["source"], "' or target '", r["target"], "' was missing after canonicalization."))).when(r["s"] == r["t"], flag("self_loop_relation", _quoted("Relation '", r["type"], "' dropped because source and target both resolve to '", r["s"], "'.")))
    whole = lambda r: F.struct(r["s"].alias("source"), r["t"].alias("target"), r["type"].alias("type"), r["evidence"].alias("evidence"))
    kept = lambda seen: F.transform(F.filter(seen, lambda r: r["s"].isNotNull() & r["t"].isNotNull() & (r["s"] != r["t"])), whole)
    return let(seen, lambda seen: F.struct(first_by(kept(seen), relation_identity).alias("kept"), F.array_compact(F.transform(seen, reason)).alias("flags")))


def relation_identity(r: Column) -> Column:
    return F.struct(fold(r["source"]), fold(r["target"]), r["type"], r["evidence"])


def event_identity(e: Column) -> Column:
    """Type, date, location, evidence and relations in order; participants don't count."""
    return F.struct(e["event_type"], e["event_date"], fold(e["location"]), e["evidence"], F.transform(e["relations"], relation_identity))


def _event(e: Column, position: Column, article: Column, index: Column, aliases: Column) -> Column:
    """struct(event, flags, whole) of a raw event; what is looked up is looked up once."""
    people = F.transform(safe(e["participants"]), lambda p: F.struct(norm_name(p["name"]).alias("said"), p["role"].alias("role")))
    people = F.filter(people, lambda p: (p["said"] != "") & p["role"].isin(*ontology.ROLES))
    people = F.transform(people, lambda p: F.struct(p["said"].alias("said"), resolved(p["said"], index, aliases).alias("name"), p["role"].alias("role")))
    named = let(norm_name(e["location"]), lambda said: F.struct(said.alias("said"), resolved(said, index, aliases).alias("place")))
    seen = F.struct(people.alias("people"), named.alias("location"), cleaned_relations(e["relations"], index, aliases).alias("links"))

    def known(x: Column) -> Column:
        found = F.transform(F.filter(x["people"], lambda p: p["name"].isNotNull()), lambda p: F.struct(p["name"].alias("name"), at(index, fold(p["name"]))["type"].alias("type"), p["role"].alias("role")))
        return let(first_by(found, lambda p: F.struct(fold(p["name"]), p["role"])), lambda found: _whole_event(e, position, article, x, found))

    return let(seen, known)


def _whole_event(e: Column, position: Column, article: Column, seen: Column, found: Column) -> Column:
    """The same of an event whose participants (`found`), location and relations have been resolved (`seen`)."""
    kind = e["event_type"]
    known = e["date_precision"].isin(*ontology.DATE_PRECISIONS) & e["date_precision"].isNotNull()
    location, place, relations = seen["location"]["said"], seen["location"]["place"], seen["links"]["kept"]
    lost = F.transform(F.filter(seen["people"], lambda p: p["name"].isNull()), lambda p: flag("event_participant_missing_entity", _quoted("Event '", kind, "' participant '", p["said"], "' was not found after canonicalization.")))
    whole = (F.size(found) > 0) & (F.size(relations) > 0)
    flags = F.concat(
        F.array_compact(F.array(
            F.when(~known, flag("event_date_precision_invalid", _quoted("Event '", kind, "' used invalid date precision '", F.coalesce(e["date_precision"], F.lit("None")), "'."))),
            F.when((location != "") & place.isNull(), flag("event_location_missing_entity", _quoted("Event '", kind, "' location '", location, "' was not found after canonicalization."))),
        )),
        lost, seen["links"]["flags"],
        F.array_compact(F.array(F.when(~whole, flag("event_incomplete", _quoted("Event '", kind, "' dropped because participants or relations were missing after canonicalization."))))),
    )
    own_id = let(norm_name(e["event_id"]), lambda said: F.when(said != "", said).otherwise(event_id(norm_name(article), position, kind, slug_unicode)))
    own_flags = let(F.filter(safe(e["review_flags"]), lambda f: f["code"].isNotNull() & f["message"].isNotNull()), lambda own: F.when(F.size(own) > 0, own))
    event = F.struct(
        own_id.alias("event_id"), kind.alias("event_type"), norm_name(e["event_date"]).alias("event_date"),
        F.when(known, e["date_precision"]).otherwise(F.lit("unknown")).alias("date_precision"), F.when(location != "", F.coalesce(place, location)).otherwise(location).alias("location"),
        found.alias("participants"), relations.alias("relations"), norm_name(e["summary"]).alias("summary"), norm_name(e["evidence"]).alias("evidence"),
        F.least(F.greatest(e["confidence"], F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.coalesce(F.nullif(norm_name(e["review_status"]), F.lit("")), F.lit("unreviewed")).alias("review_status"),
        own_flags.alias("review_flags"), e["location_geocode"].alias("location_geocode"),
    )
    return F.struct(event.alias("event"), flags.alias("flags"), whole.alias("whole"))


def clean_records(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """`records` (article_id, entities, relations, events, ...) cleaned, with postprocess_review_flags."""
    table = alias_map(aliases)
    raw = F.transform(F.filter(safe("entities"), lambda x: x["type"].isin(*ontology.ENTITY_TYPES)), lambda x: F.struct(norm_name(x["name"]).alias("said"), x.alias("x")))
    raw = F.filter(raw, lambda x: x["said"] != "")
    items = F.transform(raw, lambda x: F.struct(x["said"].alias("said"), canonical(x["said"], x["x"]["type"], table).alias("c")))
    found = records.withColumn("_aliases", table).withColumn("_items", F.transform(items, lambda x: F.struct(x["said"].alias("said"), x["c"]["name"].alias("name"), x["c"]["type"].alias("type"), fold(x["c"]["name"]).alias("key"))))
    first = first_by(F.col("_items"), lambda x: x["key"])
    found = found.withColumn("_first", first).withColumn("_index", F.map_from_arrays(F.transform("_first", lambda x: x["key"]), F.col("_first")))
    index, known = F.col("_index"), F.col("_aliases")
    conflicts = F.array_compact(F.transform("_items", lambda x: F.when(at(index, x["key"])["type"] != x["type"], flag("entity_type_conflict", _quoted("Entity '", x["name"], "' appeared with multiple types: ", at(index, x["key"])["type"], " and ", x["type"], ".")))))
    relation_flags = F.col("_links.flags")
    events = F.transform(safe("events"), lambda e, i: F.struct(e.alias("raw"), i.alias("i")))
    events = F.filter(events, lambda x: x["raw"]["event_type"].isin(*ontology.EVENT_TYPES))
    found = found.withColumn("_links", cleaned_relations(F.col("relations"), index, known)).withColumn("_relations", F.col("_links.kept")).withColumn("_events", F.transform(events, lambda x: _event(x["raw"], x["i"], F.col("article_id"), index, known)))
    whole = F.transform(F.filter("_events", lambda x: x["whole"]), lambda x: x["event"])
    found = found.withColumn("_kept", first_by(whole, event_identity))

    def entity(x: Column) -> Column:
        some = lambda array: let(array, lambda a: F.when(F.size(a) > 0, a))
        said = F.array_distinct(F.transform(F.filter("_items", lambda y: (y["key"] == x["key"]) & (y["said"] != x["name"])), lambda y: y["said"]))
        flags = F.when(x["type"] == "StrategicLocation", location_flags(x["name"]))
        none = [F.lit(None).cast("double").alias(c) for c in ("latitude", "longitude", "current_latitude", "current_longitude", "suggested_latitude", "suggested_longitude")]
        return F.struct(
            x["name"].alias("name"), x["type"].alias("type"), some(said).alias("aliases"), some(flags).alias("review_flags"), *none,
            F.lit(None).cast("string").alias("geocode_source"), F.lit(None).cast("string").alias("geocode_display_name"),
        )

    found = found.withColumn("_entities", F.transform("_first", entity))
    place_flags = F.flatten(F.transform("_entities", lambda x: safe(x["review_flags"])))
    event_flags = F.flatten(F.transform("_events", lambda x: x["flags"]))
    merged = first_by(F.concat(F.col("_relations"), F.flatten(F.transform("_kept", lambda e: e["relations"]))), relation_identity)
    out = found.withColumns({
        "postprocess_review_flags": F.array_distinct(F.concat(conflicts, relation_flags, event_flags, place_flags)).cast(schemas.FLAGS),
        "entities": F.col("_entities").cast(f"array<{schemas.ENTITY}>"), "events": F.col("_kept").cast(f"array<{schemas.EVENT}>"), "relations": merged.cast(f"array<{schemas.RELATION}>"),
    })
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def backfill(records: DataFrame, articles: DataFrame, columns: tuple[str, ...] = ("title", "source", "published_at", "url")) -> DataFrame:
    """Null or empty columns of `records` from the article with their id; of articles with one id the last (by rec_ord) counts, value by value."""
    last = F.col("rec_ord") if "rec_ord" in articles.columns else F.lit(0)
    meta = articles.where("article_id IS NOT NULL").groupBy("article_id").agg(F.max_by(F.struct(*columns), last).alias("_meta"))
    joined = records.join(meta, "article_id", "left")
    return joined.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("_meta")[c], F.col(c)) for c in columns}).drop("_meta")
