"""Interactive views: cut-offs by date and flags, timelines, map places, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.arrays import safe
from tempora.functions.coords import offset
from tempora.tables import spool

# Centroids of nation states by node id; ids are in lower case, so an id with a capital never matches.
CENTROIDS = {
    "NationState:iran": (32.4279, 53.688),
    "NationState:united-states": (38.9072, -77.0369),
    "NationState:israel": (31.0461, 34.8516),
    "NationState:pakistan": (30.3753, 69.3451),
    "NationState:lebanon": (33.8547, 35.8623),
    "NationState:iraq": (33.2232, 43.6793),
    "NationState:china": (35.8617, 104.1954),
    "NationState:united-kingdom": (55.3781, -3.436),
    "NationState:united-arab-emirates": (23.4241, 53.8478),
    "NationState:saudi-arabia": (23.8859, 45.0792),
    "NationState:sri-lanka": (7.2945434, 80.5820067),
    "NationState:north-korea": (39.0291092, 125.6597108),
    "NationState:afghanistan": (33.9391, 67.7100),
    "NationState:thailand": (13.7245449, 100.4682977),
    "NationState:italy": (41.9099533, 12.3711893),
    "NationState:turkey": (38.9637, 35.2433),
    "NationState:bahrain": (25.9304, 50.6378),
    "NationState:syria": (34.8021, 38.9968),
    "NationState:russia": (55.5799533, 36.7259057),
    "NationState:qatar": (25.3548, 51.1839),
    "NationState:jordan": (30.5852, 36.2384),
    "NationState:Ukraine": (50.4014325, 30.2030549),
}
PASSES = 3


def events_at(events: DataFrame, cutoff: str | None = None, event_type: str = "all", least_confidence: float = 0.0, flagged: bool = False) -> DataFrame:
    """Visible events: undated ones always, a missing confidence is 0; sort by date descending, then id."""
    out = events
    if cutoff:
        out = out.where(F.col("event_date").isNull() | (F.col("event_date") == "") | (F.col("event_date") <= cutoff))
    if event_type != "all":
        out = out.where(F.col("event_type") == event_type)
    out = out.where(F.coalesce("confidence", F.lit(0.0)) >= least_confidence)
    return out.where(F.size(safe("review_flags")) > 0) if flagged else out


def graph_at(nodes: DataFrame, edges: DataFrame, cutoff: str | None = None, flagged: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that are visible: an undated node is, an undated edge isn't once there is a cut-off; both ends of an edge must be."""
    seen = nodes
    if cutoff:
        seen = seen.where(F.col("first_seen").isNull() | (F.col("first_seen") <= cutoff))
        edges = edges.where(F.col("first_seen") <= cutoff)
    if flagged:
        seen = seen.where(F.size(safe("review_flags")) > 0)
    ids = seen.select("id")
    edges = edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    return seen, edges


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their ends' names and coordinates (map_latitude, map_longitude before latitude, longitude)."""
    lat = F.coalesce("map_latitude", "latitude") if "map_latitude" in nodes.columns else F.col("latitude")
    lon = F.coalesce("map_longitude", "longitude") if "map_longitude" in nodes.columns else F.col("longitude")
    place = F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("latitude"), lon.alias("longitude")))
    ends = nodes.select("id", "name", place.alias("coords"))
    for end in ("source", "target"):
        edges = edges.join(ends.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"), F.col("coords").alias(f"{end}_coords")), end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end))
    return edges


def timeline(*datasets: DataFrame) -> DataFrame:
    """Distinct days of all (each with a column day), in order."""
    out = datasets[0].select("day")
    for more in datasets[1:]:
        out = out.union(more.select("day"))
    return out.where("day IS NOT NULL").distinct().orderBy("day")


def ticks(days: Column) -> Column:
    """At most 8 days of an array: all, or the first, the last and five between."""
    last = F.size(days) - 1
    between = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.floor(i * last / 6 + F.lit(0.5)).cast("int"))
    chosen = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), last), between)))
    return F.when(F.size(days) <= 8, days).otherwise(F.transform(chosen, lambda i: F.get(days, i)))


def type_ranking(events: DataFrame) -> DataFrame:
    """Event types by count, most first."""
    return events.groupBy("event_type").count().orderBy(F.desc("count"), "event_type")


def visible_counts(nodes: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    mapped = F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    flagged = F.count_if(F.size(safe("review_flags")) > 0)
    counts = events.agg(F.count(F.lit(1)).alias("events"), mapped.alias("mapped_events"), flagged.alias("flagged_events"))
    return counts.crossJoin(nodes.agg(F.count(F.lit(1)).alias("nodes"))).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # rows of one each


def _jumped(pointers: DataFrame, *carried: str) -> DataFrame:
    """`pointers` (id, ptr, ..) with `ptr` at the end of its chain: each step a row jumps to where its target points, so steps are the logarithm of the longest chain.

    `carried` are columns of a row, numbers that are added up along the chain, flags that must all hold. A chain ends
    at an id that is no row. Chains have no rings.
    """
    while True:
        ahead = pointers.select(F.col("id").alias("_at"), F.col("ptr").alias("_to"), *[F.col(c).alias(f"_{c}") for c in carried])
        kinds = dict(pointers.dtypes)
        both = {c: F.when(F.col("_at").isNull(), F.col(c)).otherwise((F.col(c) & F.col(f"_{c}")) if kinds[c] == "boolean" else F.col(c) + F.col(f"_{c}")) for c in carried}
        stepped = pointers.join(ahead, F.col("ptr") == F.col("_at"), "left")
        moved = spool(stepped.select("id", F.coalesce("_to", "ptr").alias("ptr"), *[v.alias(c) for c, v in both.items()], F.col("_at").isNotNull().alias("_moved")), "jump")
        pointers = moved.drop("_moved")
        if not moved.where("_moved").head(1):
            return pointers


def _reached(neighbours: DataFrame, bare: DataFrame, placed: DataFrame) -> DataFrame:
    """id of the bare nodes that a pass places: neighbours of a placed node, or of a smaller node that the pass places.

    Each undecided node points to one smaller neighbour that may be placed. If the chain ends at a placed node, all of
    it is placed; if it ends at one that can't be, those with no other neighbour to hope for can't be, either. The rest
    tries again without the neighbours that can't be: more than one round is needed only where chains meet.
    """
    seeds = neighbours.join(bare, "id", "left_semi").join(placed.select(F.col("id").alias("other")), "other", "left_semi").select("id").distinct()
    down = spool(neighbours.where("other < id").join(bare, "id", "left_semi").join(bare.select(F.col("id").alias("other")), "other", "left_semi").select("id", "other").distinct(), "down")
    decided = spool(bare.join(seeds.withColumn("_seed", F.lit(True)), "id", "left").join(down.select("id").distinct().withColumn("_down", F.lit(True)), "id", "left").where("_seed OR _down IS NULL").select("id", F.col("_seed").isNotNull().alias("placed")), "decided")
    while True:
        hopes = down.join(decided.select("id"), "id", "left_anti").join(decided.where("NOT placed").select(F.col("id").alias("other")), "other", "left_anti")
        chosen = hopes.groupBy("id").agg(F.min("other").alias("ptr"), (F.count(F.lit(1)) == 1).alias("sure"))
        left = spool(bare.join(decided.select("id"), "id", "left_anti").join(chosen, "id", "left"), "undecided")
        if not left.head(1):
            return decided.where("placed").select("id")
        ends = _jumped(left.where("ptr IS NOT NULL"), "sure").join(decided.select(F.col("id").alias("ptr"), "placed"), "ptr", "left")
        # a chain that ends at an undecided node ends at one without hope
        found = ends.select("id", F.coalesce("placed", F.lit(False)).alias("placed"), "sure").where("placed OR sure").select("id", "placed")
        decided = spool(decided.unionByName(left.where("ptr IS NULL").select("id", F.lit(False).alias("placed"))).unionByName(found), "decided")


def map_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with a place on the map: their own, a centroid, or near the first placed neighbour, in PASSES passes.

    A pass visits nodes in order of id, and a node sees the neighbours placed before it in the same pass; its first
    visible one in order of edges is its anchor. Anchors form a forest; a node's place is that of its root and the sum
    of the offsets on the way, which pointer jumping adds up in a number of joins that is the logarithm of its depth.
    """
    spark = nodes.sparkSession
    centroid = spark.createDataFrame([(k, *v) for k, v in CENTROIDS.items()], "id string, c_lat double, c_lon double")
    own = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    bare = F.col("latitude").isNull() & F.col("longitude").isNull()
    out = nodes.join(F.broadcast(centroid), "id", "left")
    central = bare & F.col("c_lat").isNotNull()
    out = out.withColumns({
        "map_latitude": F.when(central, F.col("c_lat")).otherwise(F.col("latitude")), "map_longitude": F.when(central, F.col("c_lon")).otherwise(F.col("longitude")),
        "map_position_source": F.when(own, "geocoded").when(central, "centroid"),
    }).drop("c_lat", "c_lon")
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), F.col("id").alias("edge")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("other"), F.col("id").alias("edge")))
    both = spool(both.where("id <> other").distinct(), "neighbours")
    for _ in range(PASSES):
        out = spool(out, "map-nodes")
        whole = F.col("map_latitude").isNotNull() & F.col("map_longitude").isNotNull()
        if not out.where(~whole).head(1):  # the neighbours are not joined with nothing
            break
        known = out.where(whole).select("id", F.col("map_latitude").alias("lat"), F.col("map_longitude").alias("lon"))
        reached = spool(_reached(both, out.where(~whole).select("id"), known.select("id")), "reached")
        if not reached.head(1):
            break
        visible = known.select(F.col("id").alias("other"), F.lit(True).alias("at_start")).unionByName(reached.select(F.col("id").alias("other"), F.lit(False).alias("at_start")))
        anchors = both.join(reached, "id", "left_semi").join(visible, "other").where("at_start OR other < id")
        anchors = anchors.groupBy("id").agg(F.min_by("other", F.struct("edge", "other")).alias("ptr"))
        steps = spool(anchors.select("id", "ptr", offset("id")["latitude"].alias("d_lat"), offset("id")["longitude"].alias("d_lon")), "anchors")
        found = _jumped(steps, "d_lat", "d_lon").join(known.withColumnRenamed("id", "ptr"), "ptr").select("id", (F.col("lat") + F.col("d_lat")).alias("lat"), (F.col("lon") + F.col("d_lon")).alias("lon"))
        out = out.join(found, "id", "left").withColumns({
            "map_latitude": F.coalesce("lat", "map_latitude"), "map_longitude": F.coalesce("lon", "map_longitude"), "map_position_source": F.when(F.col("lat").isNotNull(), "derived").otherwise(F.col("map_position_source")),
        }).drop("lat", "lon")
    return out


def event_type_label(kind: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(kind, F.lit("Event")), "Event$", " Event")


def confidence_label(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%")), F.lit("N/A"))


def confidence_level(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNull(), "Unknown confidence").when(x >= 0.8, "High confidence").when(x >= 0.55, "Medium confidence").otherwise("Low confidence")


def confidence_tone(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNull(), "warn").when(x >= 0.8, "good").when(x >= 0.55, "warn").otherwise("bad")


# What each validation status means.
STATUS_DETAILS = {
    "schema_validated": "Schema, evidence, and provenance present",
    "needs_review": "Review flags are attached",
    "missing_evidence": "Supporting quote is missing",
    "missing_participants": "Participant roles are missing",
    "missing_relations": "Compatibility relations are missing",
    "missing_source_url": "Article URL is missing",
    "missing_geocode": "Located event has no coordinates",
}


def status_detail(status: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATUS_DETAILS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(status) if isinstance(status, str) else status), F.lit("Validation status unknown"))


def status_label(status: Column | str) -> Column:
    """Each word with a capital, the rest of it as it is."""
    words = F.split(F.coalesce(status, F.lit("unknown")), "_")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def geocode_label(location: Column, source: Column, display: Column, latitude: Column, longitude: Column) -> Column:
    """struct(value, detail, tone) of where an event's place comes from."""
    say = lambda value, detail, tone: F.struct(value.alias("value"), detail.alias("detail"), tone.alias("tone"))
    placed = latitude.isNotNull() & longitude.isNotNull()
    named = F.coalesce(source, F.lit("")) != ""
    return (
        F.when(F.coalesce(location, F.lit("")) == "", say(F.lit("Not applicable"), F.lit("No event location"), F.lit("good")))
        .when(named, say(source, F.coalesce(display, location), F.when(placed, F.lit("good")).otherwise(F.lit("warn"))))
        .when(placed, say(F.lit("Coordinates only"), location, F.lit("warn")))
        .otherwise(say(F.lit("Missing"), location, F.lit("bad")))
    )


def participants_label(participants: Column | str) -> Column:
    people = safe(participants)
    said = F.array_join(F.transform(F.slice(people, 1, 3), lambda p: F.concat(p["name"], F.lit(" ("), p["role"], F.lit(")"))), " / ")
    return F.when(F.size(people) == 0, "No participants").otherwise(said)


def trust_signals(events: DataFrame) -> DataFrame:
    """Events with the signals an inspector shows: status, detail, confidence, place, flags, evidence, provenance."""
    return events.withColumn("trust", F.struct(
        status_label("validation_status").alias("status"), status_detail("validation_status").alias("status_detail"), confidence_label("confidence").alias("confidence"), confidence_level("confidence").alias("confidence_level"),
        confidence_tone("confidence").alias("confidence_tone"), geocode_label(F.col("location"), F.col("location_geocode_source"), F.col("location_geocode_display_name"), F.col("latitude"), F.col("longitude")).alias("place"),
        F.size(safe("review_flags")).alias("flags"), (F.coalesce("evidence", F.lit("")) != "").alias("has_evidence"), (F.coalesce("source_url", F.lit("")) != "").alias("has_source"),
    ))


def node_style(nodes: DataFrame) -> DataFrame:
    """Sizes that the pictures draw nodes with."""
    return nodes.withColumn("radius", 26 + F.least(3 * F.col("article_count"), F.lit(18)))


def edge_style(edges: DataFrame) -> DataFrame:
    return edges.withColumn("width", 1.5 + F.least("weight", F.lit(6)))


# fixed values: colours and strokes of the pictures
RELATION_COLOURS = {"ATTACKED": "#d9472f", "THREATENED": "#ff8f1f", "NEGOTIATED_WITH": "#1f9d7a", "SUPPORTED": "#5f52d9", "SANCTIONED": "#232946", "BLOCKADED": "#b9165f"}
EVENT_COLOURS = {"AttackEvent": "#d9472f", "ThreatEvent": "#ff8f1f", "NegotiationEvent": "#1f9d7a", "SupportEvent": "#5f52d9", "SanctionEvent": "#232946", "BlockadeEvent": "#b9165f"}
TYPE_COLOURS = {"NationState": "#1d3557", "NonStateActor": "#6d597a", "PoliticalLeader": "#d4a373", "StrategicLocation": "#2a9d8f", "MilitaryAsset": "#c1121f"}
DASHES = {"THREATENED": "8 8", "NEGOTIATED_WITH": "4 10", "SUPPORTED": "2 8", "SANCTIONED": "12 6", "BLOCKADED": "14 10 4 10"}
STROKES = {"ATTACKED": 3.5, "THREATENED": 3.0, "NEGOTIATED_WITH": 3.0, "SUPPORTED": 3.0, "SANCTIONED": 3.0, "BLOCKADED": 4.0}
OTHER_NODE, OTHER_EDGE, OTHER_STROKE = "#333", "#444", 3.0
POSITIONS = {"geocoded": "geocoded", "centroid": "country centroid", "derived": "derived from connected node"}


def _by(values: dict, key: str, other) -> Column:
    """The value of a small table for the column `key`, else `other`."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.coalesce(key, F.lit(""))), F.lit(other))


def map_node_style(nodes: DataFrame) -> DataFrame:
    """Nodes that have a place, with the circle and the words that a map shows for them.

    Nodes whose place is derived are small and pale, those with review flags are large.
    """
    derived, flagged = F.col("map_position_source").eqNullSafe("derived"), F.size(safe("review_flags")) > 0
    circle = F.struct(
        F.when(derived, 6).when(flagged, 10).otherwise(7).alias("radius"), F.when(derived, 1.0).otherwise(1.5).alias("stroke"), F.when(derived, 0.58).otherwise(0.88).alias("opacity"),
        _by(TYPE_COLOURS, "type", OTHER_NODE).alias("fill"), _by(POSITIONS, "map_position_source", "unknown").alias("position"),
    )
    return nodes.where("map_latitude IS NOT NULL AND map_longitude IS NOT NULL").withColumn("circle", circle)


def map_edge_style(edges: DataFrame, selected: str | None = None) -> DataFrame:
    """Edges with the line that a map draws; the one with the id `selected` is wider and stronger."""
    chosen = F.col("id").eqNullSafe(F.lit(selected)) if selected is not None else F.lit(False)
    stroke = _by(STROKES, "type", OTHER_STROKE) + F.when(chosen, 2.0).otherwise(0.0)
    line = F.struct(_by(RELATION_COLOURS, "type", OTHER_EDGE).alias("colour"), stroke.alias("stroke"), F.when(chosen, 0.95).otherwise(0.72).alias("opacity"), _by(DASHES, "type", None).alias("dashes"))
    return edges.withColumn("line", line)
