"""The temporal knowledge graph: nodes, edges, events and their counts, from cleaned records.

All group by keys with partial aggregation on the map side. Order matters (the first mention names a node), so rows
carry rec_ord (a record's place in the input) and an item's place in its array; "first" is min_by of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.arrays import first_by, ordered, safe
from tempora.functions.coords import reviewed
from tempora.functions.dates import event_date, iso_date
from tempora.functions.lookup import at, with_lookup
from tempora.functions.text import edge_id, event_id, fold, node_id
from tempora.tables import checked, ranked, spool

#: What a node has from the first mention that states it.
STATED = ["latitude", "longitude", "geocode_source", "geocode_display_name"]


def mentions(records: DataFrame) -> DataFrame:
    """A row for each entity with a name and a type, with its folded name as key."""
    rows = records.select("rec_ord", "article_id", iso_date("published_at").alias("day"), F.posexplode(safe("entities")).alias("i", "x"))
    return rows.where("x.name IS NOT NULL AND x.type IS NOT NULL").select("rec_ord", "i", "article_id", "day", "x.*", fold("x.name").alias("key"))


def registry(found: DataFrame) -> DataFrame:
    """key, id, name, type, born: the node of each folded name, by its first mention."""
    ord_ = F.struct("rec_ord", "i")
    first = found.groupBy("key").agg(F.min_by(F.struct("name", "type"), ord_).alias("x"), F.min(ord_).alias("born"))
    return first.select("key", node_id("x.name", "x.type").alias("id"), "x.name", "x.type", "born")


def merge_flags(flags: Column) -> Column:
    """Distinct flags by code and message, in order, of an array of struct<ord, v: array of flags>."""
    return first_by(F.filter(F.flatten(ordered(flags)), lambda f: f["code"].isNotNull() & f["message"].isNotNull()), lambda f: f)


def relation_rows(records: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, skipped) relations. An endpoint has to be an entity of the same or an earlier record."""
    rows = records.select("rec_ord", "article_id", iso_date("published_at").alias("day"), "title", F.col("source").alias("source_publication"), F.posexplode(safe("relations")).alias("i", "r"))
    rows = rows.withColumns({"s_key": fold("r.source"), "t_key": fold("r.target")})
    known = names.select("key", "id", F.col("born.rec_ord").alias("since"))
    s = known.select(F.col("key").alias("s_key"), F.col("id").alias("source_id"), F.col("since").alias("s_since"))
    t = known.select(F.col("key").alias("t_key"), F.col("id").alias("target_id"), F.col("since").alias("t_since"))
    rows = rows.join(s, "s_key", "left").join(t, "t_key", "left")
    whole = F.expr("r.source <> '' AND r.target <> '' AND r.type <> '' AND r.evidence <> ''")
    ok = F.coalesce(whole & (F.col("s_since") <= F.col("rec_ord")) & (F.col("t_since") <= F.col("rec_ord")), F.lit(False))
    kept = rows.where(ok).select("rec_ord", "i", "article_id", "day", "title", "source_publication", "source_id", "target_id", F.col("r.type").alias("type"), F.col("r.evidence").alias("evidence"))
    kept = kept.withColumn("edge_id", edge_id("source_id", "target_id", "type"))
    return kept, rows.where(~ok).select("rec_ord", "i", "r.*")


def edges_of(relations: DataFrame) -> DataFrame:
    """Edges by source, type and target: weight counts relations, repeated ones too."""
    evidence = F.struct("article_id", F.col("day").alias("published_at"), "title", "source_publication", "evidence")
    grouped = relations.groupBy(F.col("edge_id").alias("id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type")
    out = grouped.agg(
        F.count(F.lit(1)).alias("weight"), F.array_sort(F.collect_set("article_id")).alias("article_ids"), F.array_sort(F.collect_set("day")).alias("dates"),
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.collect_list(F.struct(F.struct("rec_ord", "i").alias("ord"), evidence.alias("v"))).alias("e"),
    )
    return out.select("id", "source", "target", "type", "weight", "article_ids", F.size("article_ids").cast("long").alias("article_count"), "dates", "first_seen", "last_seen", ordered(F.col("e")).alias("evidences"))


def edge_counts(relations: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges without lists: weight counts relations, repeated ones too; counted by article first, so that no article is kept.

    `parts` are partitions for the count by article, which hardly shrinks the rows: its tasks are as small as these.
    """
    if parts:
        relations = relations.select("edge_id", "source_id", "target_id", "type", "article_id", "day").repartition(parts, "edge_id", "article_id")
    edge = [F.col("edge_id").alias("id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type"]
    per_article = relations.groupBy(*edge, "article_id").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("low"), F.max("day").alias("high"))
    return per_article.groupBy("id", "source", "target", "type").agg(F.sum("n").alias("weight"), F.count("article_id").alias("article_count"), F.min("low").alias("first_seen"), F.max("high").alias("last_seen"))


def edge_days(relations: DataFrame) -> DataFrame:
    """id, type, day, weight: an edge's relations by day; undated ones are left out."""
    return relations.where("day IS NOT NULL").groupBy(F.col("edge_id").alias("id"), "type", "day").agg(F.count(F.lit(1)).alias("weight"))


def edge_evidence(relations: DataFrame) -> DataFrame:
    """A row for each relation: id of its edge, its place there (from 1, in order of record and place in the record), and where it is from.

    An edge's evidence is never gathered in a row or a task: an edge of very many relations lies in many sorted ranges.
    """
    rows = relations.select(F.col("edge_id").alias("id"), "rec_ord", "i", "article_id", F.col("day").alias("published_at"), "title", "source_publication", "evidence")
    return ranked(rows, ["id"], ["rec_ord", "i"])


def ends_of(relations: DataFrame) -> DataFrame:
    """rec_ord, edge_id, id: a row for each end of a relation, one for a loop."""
    return relations.select("rec_ord", "edge_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"))


def relation_counts(ends: DataFrame) -> DataFrame:
    """id, relation_count: edges of each node, each once."""
    return ends.select("id", "edge_id").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("relation_count"))


def _firsts() -> list[Column]:
    """First non-null of each stated column on its own; an order of null is never the least."""
    return [F.min(F.when(F.col(c).isNotNull(), F.struct("rec_ord", "i", F.col(c).alias("v"))))["v"].alias(c) for c in STATED]


def nodes_of(found: DataFrame, names: DataFrame, relations: DataFrame, on_collision: str = "merge") -> DataFrame:
    """Nodes by id.

    Two names may slug to one id. `merge` makes one node of both, named by the first. `reset` lets a name that comes
    later take the id over: what was gathered before is lost, and edges keep pointing at the id.
    """
    ids = names.groupBy("id").agg(F.min_by("name", "born").alias("first_name"), F.max_by("name", "born").alias("last_name"), F.min_by("type", "born").alias("type"), F.max("born").alias("reborn"))
    pick = "last_name" if on_collision == "reset" else "first_name"
    ids = ids.select("id", F.col(pick).alias("name"), "type", "reborn")
    ord_ = F.struct("rec_ord", "i")
    rows = found.drop("name", "type").join(names.select("key", "id"), "key").join(ids, "id")
    if on_collision == "reset":
        rows = rows.where(ord_ >= F.col("reborn"))
    out = rows.groupBy("id", "name", "type").agg(
        *_firsts(), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(safe("aliases"), lambda a: (a != "")))))).alias("aliases"),
        F.array_sort(F.collect_set("article_id")).alias("article_ids"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"),
        F.collect_list(F.when(F.size(safe("review_flags")) > 0, F.struct(ord_.alias("ord"), F.col("review_flags").alias("v")))).alias("flags"),
    )
    ends = ends_of(relations)
    if on_collision == "reset":
        ends = ends.join(ids.select("id", "reborn"), "id").where(F.col("rec_ord") >= F.col("reborn.rec_ord"))
    out = out.join(relation_counts(ends).withColumnRenamed("relation_count", "n"), "id", "left")
    return out.select(
        "id", "name", "type", *STATED, F.filter("aliases", lambda a: a != F.col("name")).alias("aliases"), "article_ids", F.size("article_ids").cast("long").alias("article_count"),
        F.coalesce("n", F.lit(0)).cast("long").alias("relation_count"), "first_seen", "last_seen", merge_flags(F.col("flags")).alias("review_flags"),
    )


def node_counts(found: DataFrame, names: DataFrame, relations: DataFrame, parts: int | None = None) -> DataFrame:
    """Nodes of nodes_of (merged) without lists: articles are counted as distinct rows, so that no node's articles are gathered in a row."""
    ids = names.groupBy("id").agg(F.min_by("name", "born").alias("name"), F.min_by("type", "born").alias("type"))
    seen = article_counts(found.select("key", "article_id", "day").join(names.select("key", "id"), "key"), "id", parts)
    counts = relation_counts(ends_of(relations))
    return ids.join(seen, "id").join(counts, "id", "left").select("id", "name", "type", "article_count", F.coalesce("relation_count", F.lit(0)).cast("long").alias("relation_count"), "first_seen", "last_seen")


def node_tables(found: DataFrame, names: DataFrame, relations: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, articles): nodes of nodes_of (merged) but for their articles, which are rows of id and article_id, each once.

    However many mentions a node has, they are not gathered in a row: only its distinct aliases and flags are. `parts`
    as in edge_counts.
    """
    names = spool(names, "node-names")
    ids = names.groupBy("id").agg(F.min_by("name", "born").alias("name"), F.min_by("type", "born").alias("type"))
    rows = found.drop("name", "type").join(checked(names.select("key", "id")), "key")
    once = spool(_once(rows, "id", parts), "node-articles")
    places = rows.where(" OR ".join(f"{c} IS NOT NULL" for c in STATED)).groupBy("id").agg(*_firsts())
    aliases = rows.select("id", F.explode("aliases").alias("a")).where("a <> ''").groupBy("id").agg(F.array_sort(F.collect_set("a")).alias("aliases"))
    flags = rows.select("id", F.struct("rec_ord", "i", "review_flags").alias("ord"), F.posexplode("review_flags").alias("at", "v")).where("v.code IS NOT NULL AND v.message IS NOT NULL")
    flags = flags.groupBy("id", "v").agg(F.min(F.struct("ord", "at")).alias("ord")).groupBy("id").agg(ordered(F.collect_list(F.struct("ord", "v"))).alias("review_flags"))
    out = ids.join(_counted(once, "id"), "id").join(relation_counts(ends_of(relations)), "id", "left")
    for more in (places, aliases, flags):
        out = out.join(more, "id", "left")
    nodes = out.select(
        "id", "name", "type", *STATED, F.filter(safe("aliases"), lambda a: a != F.col("name")).alias("aliases"), "article_count",
        F.coalesce("relation_count", F.lit(0)).cast("long").alias("relation_count"), "first_seen", "last_seen", safe("review_flags").alias("review_flags"),
    )
    return nodes, once.where("article_id IS NOT NULL").select("id", "article_id")


def article_counts(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """`key`, article_count, first_seen, last_seen of rows (key, article_id, day); `parts` as in edge_counts."""
    return _counted(_once(rows, key, parts), key)


def _once(rows: DataFrame, key: str, parts: int | None) -> DataFrame:
    """Each article of a key once, with its first and last day."""
    rows = rows.select(key, "article_id", "day")
    if parts:
        rows = rows.repartition(parts, key, "article_id")
    return rows.groupBy(key, "article_id").agg(F.min("day").alias("low"), F.max("day").alias("high"))


def _counted(once: DataFrame, key: str) -> DataFrame:
    return once.groupBy(key).agg(F.count("article_id").alias("article_count"), F.min("low").alias("first_seen"), F.max("high").alias("last_seen"))


def graph(records: DataFrame, on_collision: str = "merge") -> dict[str, DataFrame]:
    """nodes, edges, accepted and skipped relations, and metadata of cleaned records (with rec_ord)."""
    found = mentions(records)
    names = registry(found)
    relations, skipped = relation_rows(records, names)
    nodes = nodes_of(found, names, relations, on_collision)
    edges = edges_of(relations)
    return {"nodes": nodes, "edges": edges, "relations": relations, "skipped": skipped, "metadata": graph_metadata(nodes, edges, skipped)}


def graph_metadata(nodes: DataFrame, edges: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: nodes by type are distinct nodes, edges by type are relations; the timeline has dates of accepted relations."""
    by = lambda df, value: df.groupBy("type").agg(value.alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("m"))
    node_types, edge_types = by(nodes, F.count(F.lit(1))), by(edges, F.sum("weight"))
    days = edges.select(F.explode("dates").alias("day")).agg(F.array_sort(F.collect_set("day")).alias("available_dates"), F.min("day").alias("min_date"), F.max("day").alias("max_date"))
    one = nodes.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edge_count")))  # rows of one each
    one = one.crossJoin(node_types.withColumnRenamed("m", "node_type_counts")).crossJoin(edge_types.withColumnRenamed("m", "edge_type_counts"))
    one = one.crossJoin(days.select(F.struct("available_dates", "min_date", "max_date").alias("timeline")))
    return one.crossJoin(skipped.agg(F.count(F.lit(1)).alias("skipped_relations")))


def validation_status(event: Column, source_url: Column, latitude: Column, longitude: Column) -> Column:
    """What an event lacks first, judged on the raw event."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    none = lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
    return (
        F.when(empty(event["evidence"]), "missing_evidence")
        .when(none(event["participants"]), "missing_participants")
        .when(none(event["relations"]), "missing_relations")
        .when(empty(source_url), "missing_source_url")
        .when(~empty(event["location"]) & (latitude.isNull() | longitude.isNull()), "missing_geocode")
        .when(~none(event["review_flags"]), "needs_review")
        .otherwise("schema_validated")
    )


def events_payload(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each event with node ids, coordinates by precedence, and status; sort by (coalesce(event_date, ''), id)."""
    e, g = F.col("e"), F.col("e.location_geocode")
    rows = records.select(
        "rec_ord", "article_id", iso_date("published_at").alias("published_at"), "title", F.col("source").alias("source_publication"),
        F.coalesce(F.nullif("url", F.lit("")), F.col("source_url")).alias("source_url"), "model", "prompt_version", F.posexplode(safe("events")).alias("event_pos", "e"),
    ).where("e.event_type <> ''")
    names = F.concat(
        F.array(fold(F.nullif(e["location"], F.lit("")))), F.transform(safe(e["participants"]), lambda p: fold(p["name"])),
        F.transform(safe(e["relations"]), lambda r: fold(r["source"])), F.transform(safe(e["relations"]), lambda r: fold(r["target"])),
    )
    value = F.struct("id", "latitude", "longitude", "geocode_source", "geocode_display_name")
    table = nodes.groupBy(fold("name").alias("key")).agg(F.max_by(value, "id").alias("value"))
    rows = with_lookup(rows, ["rec_ord", "event_pos"], names, table, "nodes")
    place = at("nodes", fold(F.nullif(e["location"], F.lit(""))))
    latitude, longitude = F.coalesce(reviewed(g)["latitude"], place["latitude"]), F.coalesce(reviewed(g)["longitude"], place["longitude"])
    people = F.transform(F.filter(safe(e["participants"]), lambda p: p["name"] != ""), lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"), p["role"].alias("role"), at("nodes", fold(p["name"]))["id"].alias("node_id")))
    links = F.transform(F.filter(safe(e["relations"]), lambda r: r["source"].isNotNull() & r["target"].isNotNull()), lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), at("nodes", fold(r["source"]))["id"].alias("source_id"), at("nodes", fold(r["target"]))["id"].alias("target_id"), r["type"].alias("type"), r["evidence"].alias("evidence")))
    ident = F.coalesce(F.nullif(e["event_id"], F.lit("")), event_id("article_id", "event_pos", e["event_type"]))
    return rows.select(
        ident.alias("id"), ident.alias("event_id"), e["event_type"].alias("event_type"), F.coalesce(event_date(e["event_date"]), F.col("published_at")).alias("event_date"), e["date_precision"].alias("date_precision"),
        F.coalesce(e["location"], F.lit("")).alias("location"), place["id"].alias("location_node_id"), latitude.alias("latitude"), longitude.alias("longitude"),
        *[g[c].alias(c) for c in ("current_latitude", "current_longitude", "suggested_latitude", "suggested_longitude")],
        F.coalesce(g["geocode_source"], place["geocode_source"]).alias("location_geocode_source"), F.coalesce(g["geocode_display_name"], place["geocode_display_name"]).alias("location_geocode_display_name"),
        people.alias("participants"), links.alias("relations"), e["summary"].alias("summary"), e["evidence"].alias("evidence"), e["confidence"].alias("confidence"), e["review_status"].alias("review_status"),
        safe(e["review_flags"]).alias("review_flags"), validation_status(e, F.col("source_url"), latitude, longitude).alias("validation_status"),
        "article_id", "published_at", "title", "source_publication", "source_url", "model", "prompt_version",
    )


def event_metadata(events: DataFrame) -> DataFrame:
    """One row: events by type, and the timeline of their dates, whose precision may differ."""
    types = events.groupBy("event_type").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "count")))).alias("event_type_counts"))
    days = events.agg(F.count(F.lit(1)).alias("event_count"), F.struct(F.array_sort(F.collect_set("event_date")).alias("available_dates"), F.min("event_date").alias("min_date"), F.max("event_date").alias("max_date")).alias("timeline"))
    return days.crossJoin(types)  # rows of one each
