"""Locations: distinct names, lookup by precedence, review tables, and attaching coordinates to records."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tempora import ontology, schemas
from tempora.functions.arrays import safe
from tempora.functions.coords import geocode_flags, preferred
from tempora.functions.lookup import at, with_lookup
from tempora.functions.text import fold, norm

_RECORD = [c.split()[0] for c in schemas.GEOCODE_RECORD.split(", ")]


def unique_locations(records: DataFrame) -> DataFrame:
    """key, name, ord: locations of strategic entities and events; of names that fold alike the first (a record's entities come before its events)."""
    entities = records.select("rec_ord", F.lit(0).alias("part"), F.posexplode(safe("entities")).alias("i", "x")).where("x.type = 'StrategicLocation' AND x.name IS NOT NULL")
    events = records.select("rec_ord", F.lit(1).alias("part"), F.posexplode(safe("events")).alias("i", "x")).where("x.location <> ''")
    rows = entities.select("rec_ord", "part", "i", F.col("x.name").alias("name")).unionByName(events.select("rec_ord", "part", "i", F.col("x.location").alias("name")))
    ord_ = F.struct("rec_ord", "part", "i")
    return rows.groupBy(fold("name").alias("key")).agg(F.min_by("name", ord_).alias("name"), F.min(ord_).alias("ord"))


def _missing(query: Column, notes: str) -> Column:
    return F.struct(query.alias("query"), *[F.lit(None).cast(t).alias(c) for c, t in (("latitude", "double"), ("longitude", "double"), ("display_name", "string"))], F.lit("missing").alias("source"), *[F.lit(None).cast(t).alias(c) for c, t in (("osm_type", "string"), ("osm_category", "string"), ("osm_addresstype", "string"), ("raw_importance", "double"))], F.lit(notes).alias("notes"))


def geocode(locations: DataFrame, overrides: DataFrame, cache: DataFrame, remote: Callable[[Iterable[str]], list[dict]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(geocoded locations, new cache). Overrides go before the cache, the cache before `remote`; whole records win, not columns.

    `remote` gets the distinct names that nothing else knows, on the driver, since its rate limit is global; what it
    returns (failures too) enters the cache. Without it, such names are missing.
    """
    spark = locations.sparkSession
    as_record = F.struct(*_RECORD)
    over = overrides.select(norm("query").alias("query_key"), as_record.alias("o"))
    held = cache.select("query_key", as_record.alias("c"))
    asked = locations.withColumn("query_key", norm("name"))
    found = asked.join(over, "query_key", "left").join(held, "query_key", "left").withColumn("g", F.coalesce("o", "c"))
    if remote is not None:
        names = [r["name"] for r in found.where("g IS NULL").groupBy("query_key").agg(F.min_by("name", "ord").alias("name")).collect()]
        fetched = spark.createDataFrame([[r.get(c) for c in _RECORD] for r in remote(names)], schemas.GEOCODE_RECORD)
        fetched = fetched.select(norm("query").alias("query_key"), as_record.alias("r"))
        found = found.join(F.broadcast(fetched) if len(names) < 100_000 else fetched, "query_key", "left").withColumn("g", F.coalesce("g", "r")).drop("r")
        cache = cache.unionByName(fetched.select("query_key", "r.*"))
    g = F.coalesce("g", _missing(F.col("name"), "Remote geocoding disabled."))
    flat = found.select("key", "ord", "name", g.alias("g")).select(
        "key", "ord", "name", "g.latitude", "g.longitude", "g.display_name", F.col("g.source").alias("geocode_source"), "g.osm_type", "g.osm_category", "g.osm_addresstype", "g.raw_importance", "g.notes"
    )
    return flat.withColumn("review_flags", geocode_flags("name", "latitude", "longitude", "geocode_source", "osm_addresstype", "raw_importance")), cache


def suggestions(review: DataFrame) -> DataFrame:
    """Reviewers' coordinates by (location, article, summary); rows without any are ignored, of equal keys the last counts (its place in line is the first's)."""
    key = F.struct(norm("location_name").alias("location"), norm("article_id").alias("article"), norm("event_summary").alias("summary"))
    rows = review.where("suggested_latitude IS NOT NULL OR suggested_longitude IS NOT NULL")
    pair = F.struct(F.col("suggested_latitude").alias("latitude"), F.col("suggested_longitude").alias("longitude"))
    return rows.groupBy(key.alias("k")).agg(F.max_by(pair, "rec_ord").alias("pair"), F.min("rec_ord").alias("rec_ord")).select("k.*", "pair.latitude", "pair.longitude", "rec_ord")


def suggestions_by_location(found: DataFrame) -> DataFrame:
    """The first whole suggestion of each location."""
    whole = found.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    return whole.groupBy("location").agg(F.min_by(F.struct("latitude", "longitude"), "rec_ord").alias("p")).select("location", "p.*")


def attach(records: DataFrame, geocoded: DataFrame, found: DataFrame) -> DataFrame:
    """`records` (with rec_ord) with coordinates, suggestions and flags on strategic entities and located events.

    An event takes the suggestion of its own key, even one with a single coordinate, before its location's.
    """
    places = F.concat(F.transform(safe("entities"), lambda x: F.when(x["type"] == "StrategicLocation", fold(x["name"]))), F.transform(safe("events"), lambda e: fold(F.nullif(e["location"], F.lit("")))))
    value = F.struct("latitude", "longitude", "display_name", "geocode_source", "review_flags")
    out = with_lookup(records, ["rec_ord"], places, geocoded.select("key", value.alias("value")), "_geo")
    by_place = suggestions_by_location(found)
    out = with_lookup(out, ["rec_ord"], places, by_place.select(F.col("location").alias("key"), F.struct("latitude", "longitude").alias("value")), "_near")
    exact = lambda e: F.concat_ws("\x1f", norm(e["location"]), norm(F.col("article_id")), norm(e["summary"]))
    table = found.select(F.concat_ws("\x1f", "location", "article", "summary").alias("key"), F.struct("latitude", "longitude").alias("value"))
    out = with_lookup(out, ["rec_ord"], F.transform(safe("events"), exact), table, "_own")

    def coordinates(geo: Column, hint: Column) -> Column:
        best = preferred(geo["latitude"], geo["longitude"], hint["latitude"], hint["longitude"])
        return F.struct(
            best["latitude"].alias("latitude"), best["longitude"].alias("longitude"), geo["latitude"].alias("current_latitude"), geo["longitude"].alias("current_longitude"),
            hint["latitude"].alias("suggested_latitude"), hint["longitude"].alias("suggested_longitude"), geo["geocode_source"].alias("geocode_source"), geo["display_name"].alias("geocode_display_name"),
        )

    def flags(own: Column, geo: Column) -> Column:
        # only flags that were there before keep one of the geocode's out
        more = F.filter(safe(geo["review_flags"]), lambda f: ~F.exists(safe(own), lambda g: (g["code"] == f["code"]) & (g["message"] == f["message"])))
        return F.when(F.size(more) > 0, F.concat(safe(own), more)).otherwise(own)

    def entity(x: Column) -> Column:
        key = fold(x["name"])
        geo = F.when(x["type"] == "StrategicLocation", at("_geo", key))
        got = coordinates(geo, at("_near", key))
        old = F.struct(*[x[c].alias(c) for c in ("latitude", "longitude", "current_latitude", "current_longitude", "suggested_latitude", "suggested_longitude", "geocode_source", "geocode_display_name")])
        c = F.when(geo.isNotNull(), got).otherwise(old)
        return F.struct(x["name"].alias("name"), x["type"].alias("type"), x["aliases"].alias("aliases"), F.when(geo.isNotNull(), flags(x["review_flags"], geo)).otherwise(x["review_flags"]).alias("review_flags"), *[c[n].alias(n) for n in ("latitude", "longitude", "current_latitude", "current_longitude", "suggested_latitude", "suggested_longitude", "geocode_source", "geocode_display_name")])

    def event(e: Column) -> Column:
        key = fold(F.nullif(e["location"], F.lit("")))
        geo = at("_geo", key)
        hint = F.coalesce(at("_own", exact(e)), at("_near", key))
        changed = e.withField("location_geocode", coordinates(geo, hint)).withField("review_flags", flags(e["review_flags"], geo))
        return F.when(geo.isNotNull(), changed).otherwise(e)

    out = out.withColumns({"entities": F.transform(safe("entities"), entity), "events": F.transform(safe("events"), event)})
    return out.drop("_geo", "_near", "_own")


def review_rows(geocoded: DataFrame) -> DataFrame:
    """A row for each flag of each location, for the location review table."""
    rows = geocoded.select("ord", "name", "latitude", "longitude", "display_name", "geocode_source", F.posexplode("review_flags").alias("i", "f"))
    return rows.select("ord", "i", *schemas.LOCATION_REVIEW_COLUMNS[:5], F.col("f.code").alias("review_code"), F.col("f.message").alias("review_message"))


def geocode_review_rows(events: DataFrame, found: DataFrame) -> DataFrame:
    """The geocode review table: the first event of each (location, article, summary) with current and earlier suggested coordinates.

    `events` has rec_ord and event_pos.
    """
    key = F.struct(norm("location").alias("location"), norm("article_id").alias("article"), norm("summary").alias("summary"))
    first = events.where("location <> ''").groupBy(key.alias("k")).agg(F.min_by(F.struct("location", "article_id", "summary", "source_url", "location_geocode", "rec_ord", "event_pos"), F.struct("rec_ord", "event_pos")).alias("e"))
    rows = first.select("e.*", F.col("k.location").alias("kl"), F.col("k.article").alias("ka"), F.col("k.summary").alias("ks"))
    hints = found.select(F.col("location").alias("hl"), F.col("article").alias("ha"), F.col("summary").alias("hs"), "latitude", "longitude")
    joined = rows.join(hints, (F.col("kl") == F.col("hl")) & (F.col("ka") == F.col("ha")) & (F.col("ks") == F.col("hs")), "left")
    g = F.col("location_geocode")
    return joined.select(
        F.col("rec_ord"), F.col("event_pos"), F.col("location").alias("location_name"), F.coalesce("article_id", F.lit("")).alias("article_id"), F.coalesce("summary", F.lit("")).alias("event_summary"),
        F.coalesce("source_url", F.lit("")).alias("source_url"), F.coalesce(g["current_latitude"], g["latitude"]).alias("current_latitude"), F.coalesce(g["current_longitude"], g["longitude"]).alias("current_longitude"),
        F.col("latitude").alias("suggested_latitude"), F.col("longitude").alias("suggested_longitude"),
    )


def flatten_events(records: DataFrame) -> DataFrame:
    """A row for each event with its article's columns, rec_ord and event_pos."""
    rows = records.select("rec_ord", F.posexplode(safe("events")).alias("event_pos", "e"), "article_id", "title", "source", F.coalesce(F.nullif("url", F.lit("")), F.col("source_url")).alias("source_url"), "published_at", "model", "prompt_version", "extracted_at")
    return rows.select("rec_ord", "event_pos", "e.*", "article_id", "title", "source", "source_url", "published_at", "model", "prompt_version", "extracted_at")


def summary(records: DataFrame, events: DataFrame, geocoded: DataFrame) -> DataFrame:
    """kind, label, count: records, events, entities, relations and events by type (`unknown` if missing), locations and their flags."""
    total = lambda df, kind: df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("label"), "count")
    by = lambda df, kind, column: df.groupBy(F.coalesce(column, F.lit("unknown")).alias("label")).count().select(F.lit(kind).alias("kind"), "label", "count")
    parts = [
        total(records, "cleaned_record_count"), total(events, "cleaned_event_count"),
        by(records.select(F.explode(safe("entities")).alias("x")), "entity_type_counts", "x.type"), by(records.select(F.explode(safe("relations")).alias("x")), "relation_type_counts", "x.type"),
        by(events, "event_type_counts", "event_type"), total(geocoded, "geocoded_location_count"), total(geocoded.select(F.explode("review_flags")), "location_review_flag_count"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _by_type(prefix: str, types: tuple[str, ...], count) -> dict[str, Column]:
    """Counts of each type, of items without one, and of items of any other type; `count` counts the items for which a condition holds."""
    each = {f"{prefix}:{t}": count(lambda x, t=t: x == t) for t in types}
    return each | {f"{prefix}:unknown": count(lambda x: x.isNull()), f"{prefix}:*": count(lambda x: ~x.isin(*types))}


def observed_summary(records: DataFrame, events: DataFrame, geocoded: DataFrame) -> tuple[tuple[DataFrame, DataFrame, DataFrame], Callable[[], dict | None]]:
    """The three tables, to be written once each, and what then gives the counts of summary() as {kind or kind:label: count}, without another job.

    The counts are taken while the tables are written. Types outside the ontology can't be named beforehand: if there
    are any, None is given, and summary() has to be run. Writers must not run a table twice (as range partitioning does).
    """
    inside = lambda items: lambda holds: F.coalesce(F.sum(F.size(F.filter(safe(items), lambda x: holds(x["type"])))), F.lit(0))
    metrics = [
        {"cleaned_record_count": F.count(F.lit(1))} | _by_type("entity_type_counts", ontology.ENTITY_TYPES, inside("entities")) | _by_type("relation_type_counts", ontology.RELATION_TYPES, inside("relations")),
        {"cleaned_event_count": F.count(F.lit(1))} | _by_type("event_type_counts", ontology.EVENT_TYPES, lambda holds: F.count_if(holds(F.col("event_type")))),
        {"geocoded_location_count": F.count(F.lit(1)), "location_review_flag_count": F.coalesce(F.sum(F.size(safe("review_flags"))), F.lit(0))},
    ]
    seen = [Observation() for _ in metrics]
    tables = tuple(table.observe(o, *[c.alias(name) for name, c in found.items()]) for table, o, found in zip((records, events, geocoded), seen, metrics))

    def counts() -> dict | None:
        got = {name: n for o in seen for name, n in o.get.items()}
        if any(n for name, n in got.items() if name.endswith(":*")):
            return None
        return {name: n for name, n in got.items() if n or ":" not in name}

    return tables, counts
