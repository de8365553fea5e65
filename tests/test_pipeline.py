"""Records to graph: cleaning, geocoding, nodes, edges, events, views."""

import pytest
from pyspark.sql import functions as F

from tempora import schemas
from tempora.operators import clean, geocode, graph, views
from tempora.plans.pipelines import extractions_to_graph
from tempora.sources import readers
from tests.records import entity, event, frame, person, relation

US, IRAN = entity("United States", "NationState"), entity("Iran", "NationState")
STRAIT = entity("Strait of Hormuz", "StrategicLocation")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def two_articles(spark):
    a1 = {"article_id": "a1", "title": "t1", "published_at": "2026-04-10T23:30:00-05:00", "entities": [US, IRAN, STRAIT], "relations": [relation("United States", "Iran", "THREATENED"), relation("Iran", "Strait of Hormuz", "BLOCKADED")]}
    a2 = {"article_id": "a2", "title": "t2", "published_at": "2026-04-12", "entities": [US, IRAN], "relations": [relation("united states", "Iran", "THREATENED", "again")]}
    return frame(spark, [a1, a2])


def test_repeated_relation_gains_weight(spark):
    g = graph.graph(two_articles(spark))
    nodes = {r["id"]: r for r in g["nodes"].collect()}
    edges = {r["id"]: r for r in g["edges"].collect()}
    assert len(nodes) == 3 and len(edges) == 2
    threat = edges["NationState:united-states|THREATENED|NationState:iran"]
    assert (threat["weight"], threat["article_count"], threat["dates"]) == (2, 2, ["2026-04-10", "2026-04-12"])
    assert [e["article_id"] for e in threat["evidences"]] == ["a1", "a2"]
    assert nodes["StrategicLocation:strait-of-hormuz"]["relation_count"] == 1 and nodes["NationState:iran"]["relation_count"] == 2
    meta = g["metadata"].first()
    assert meta["edge_type_counts"] == {"THREATENED": 2, "BLOCKADED": 1} and meta["node_type_counts"] == {"NationState": 2, "StrategicLocation": 1}
    assert (meta["timeline"]["min_date"], meta["timeline"]["max_date"], meta["skipped_relations"]) == ("2026-04-10", "2026-04-12", 0)


def test_relation_before_its_entity_is_skipped(spark):
    first = {"article_id": "a1", "entities": [US], "relations": [relation("United States", "Iran", "ATTACKED")]}
    second = {"article_id": "a2", "entities": [IRAN], "relations": []}
    assert graph.graph(frame(spark, [first, second]))["skipped"].count() == 1
    assert graph.graph(frame(spark, [second, first]))["skipped"].count() == 0


def test_colliding_names(spark):
    a = {"article_id": "a1", "entities": [entity("Al-Aqsa", "StrategicLocation", aliases=["x"]), US], "relations": [relation("United States", "Al-Aqsa", "ATTACKED")]}
    b = {"article_id": "a2", "entities": [entity("Al Aqsa", "StrategicLocation", aliases=["y"])], "relations": []}
    merged = {r["id"]: r for r in graph.graph(frame(spark, [a, b]))["nodes"].collect()}["StrategicLocation:al-aqsa"]
    assert (merged["name"], merged["aliases"], merged["article_count"], merged["relation_count"]) == ("Al-Aqsa", ["x", "y"], 2, 1)
    reset = {r["id"]: r for r in graph.graph(frame(spark, [a, b]), "reset")["nodes"].collect()}["StrategicLocation:al-aqsa"]
    assert (reset["name"], reset["aliases"], reset["article_count"], reset["relation_count"]) == ("Al Aqsa", ["y"], 1, 0)


def test_aliases_and_flags(spark):
    record = {
        "article_id": "a1", "entities": [entity("US", "NationState"), entity("the Iran", "NationState"), entity("Iranian ports", "StrategicLocation"), entity("U.S.", "NonStateActor")],
        "relations": [relation("U.S.", "Iran", "ATTACKED"), relation("US", "u.s.", "ATTACKED"), relation("US", "France", "ATTACKED")],
        "events": [event("BlockadeEvent", location="Iranian ports", participants=[person("US", "NationState", "initiator"), person("Iranian ports", "StrategicLocation", "affected_location"), person("Nobody", "NationState", "target")], relations=[relation("US", "Iranian ports", "BLOCKADED")], confidence=7, date_precision="hour"), event(participants=[])],
    }
    done = clean.clean_records(frame(spark, [record]), readers.aliases(spark)).first()
    assert [(e["name"], e["aliases"]) for e in done["entities"]] == [("United States", ["US", "U.S."]), ("Iran", ["the Iran"]), ("Iranian ports", None)]
    assert [(r["source"], r["target"], r["type"]) for r in done["relations"]] == [("United States", "Iran", "ATTACKED"), ("United States", "Iranian ports", "BLOCKADED")]
    e = done["events"][0]
    assert len(done["events"]) == 1 and e["event_id"] == "event:a1:001:blockadeevent" and e["confidence"] == 1.0 and e["date_precision"] == "unknown"
    assert [p["name"] for p in e["participants"]] == ["United States", "Iranian ports"]
    codes = [f["code"] for f in done["postprocess_review_flags"]]
    assert codes == ["self_loop_relation", "relation_missing_entity", "event_date_precision_invalid", "event_participant_missing_entity", "event_incomplete", "generic_location_name", "adjectival_location_name"]


def test_empty_and_null_records(spark):
    done = clean.clean_records(frame(spark, [{"article_id": None}, {"article_id": "x", "entities": [], "events": [], "relations": []}]), readers.aliases(spark))
    assert [(r["entities"], r["events"], r["relations"], r["postprocess_review_flags"]) for r in done.collect()] == [([], [], [], [])] * 2
    assert graph.graph(done)["nodes"].count() == 0
    assert clean.clean_records(frame(spark, [{"article_id": "x"}]).limit(0), readers.aliases(spark)).count() == 0


def geocodes(spark, *places):
    return spark.createDataFrame([(*p, None, None, None, None, None) for p in places], "query string, latitude double, longitude double, display_name string, source string, osm_type string, osm_category string, osm_addresstype string, raw_importance double, notes string")


def test_geocode_precedence_and_suggestions(spark):
    e = event("BlockadeEvent", location="Strait of Hormuz", participants=[person("Iran", "NationState", "initiator")], relations=[relation("Iran", "Strait of Hormuz", "BLOCKADED")], summary="Iran closes it")
    records = frame(spark, [{"article_id": "a1", "url": "u", "published_at": "2026-04-10", "entities": [IRAN, STRAIT], "relations": [], "events": [e]}])
    override = geocodes(spark, ("strait of  hormuz", 26.0, 56.0, "Hormuz", "override"))
    cache = geocodes(spark, ("STRAIT OF HORMUZ", 1.0, 1.0, "cached", "nominatim")).withColumn("query_key", F.lit("strait of hormuz"))
    review = spark.createDataFrame([(0, "Strait of Hormuz", "a1", "Iran  closes it", 26.5, 56.5)], "rec_ord long, location_name string, article_id string, event_summary string, suggested_latitude double, suggested_longitude double")
    out = extractions_to_graph(records, readers.aliases(spark), override, cache, review)
    assert rows(out["locations"], "name", "geocode_source", "latitude") == [("Strait of Hormuz", "override", 26.0)]
    row = out["payload"].first()
    assert (row["latitude"], row["current_latitude"], row["suggested_latitude"], row["location_node_id"], row["validation_status"]) == (26.5, 26.0, 26.5, "StrategicLocation:strait-of-hormuz", "schema_validated")
    assert row["participants"][0]["node_id"] == "NationState:iran" and row["relations"][0]["target_id"] == "StrategicLocation:strait-of-hormuz"
    assert rows(out["geocode_review"], "location_name", "current_latitude", "suggested_latitude") == [("Strait of Hormuz", 26.0, 26.5)]
    missing, _ = geocode.geocode(geocode.unique_locations(records), override.limit(0), cache.limit(0))
    assert rows(missing, "geocode_source", "notes") == [("missing", "Remote geocoding disabled.")]
    asked = []

    def remote(names):
        asked.extend(names)
        return [{"query": n, "latitude": None, "longitude": None, "display_name": None, "source": "missing", "notes": "Nominatim rate limit exceeded after retries."} for n in names]

    found, kept = geocode.geocode(geocode.unique_locations(records), override.limit(0), cache.limit(0).select("query_key", *override.columns), remote)
    assert asked == ["Strait of Hormuz"] and kept.count() == 1 and found.first()["notes"].startswith("Nominatim rate limit")
    # one coordinate of an event's own key hides the location's suggestion
    half = spark.createDataFrame([(0, "Strait of Hormuz", "a1", "Iran closes it", 9.0, None), (1, "Strait of Hormuz", "zz", "", 7.0, 7.0)], review.schema)
    attached = geocode.attach(records, out["locations"], geocode.suggestions(half)).first()
    assert attached["events"][0]["location_geocode"]["latitude"] == 26.0 and attached["entities"][1]["latitude"] == 7.0


def test_backfill_keeps_what_is_there(spark):
    records = frame(spark, [{"article_id": "a1", "title": "", "url": "own"}, {"article_id": None, "title": "x"}])
    articles = frame(spark, [{"article_id": "a1", "title": "old", "url": "u1"}, {"article_id": "a1", "title": "new", "url": "u2"}], schemas.ARTICLE)
    got = {r["rec_ord"]: (r["title"], r["url"]) for r in clean.backfill(records, articles).collect()}
    assert got == {0: ("new", "own"), 1: ("x", None)}


def test_views(spark):
    g = graph.graph(two_articles(spark))
    nodes, edges = views.graph_at(g["nodes"], g["edges"], "2026-04-11")
    assert nodes.count() == 3 and edges.count() == 2
    undated = g["edges"].withColumn("first_seen", F.lit(None).cast("string"))
    assert views.graph_at(g["nodes"], undated, "2026-04-11")[1].count() == 0 and views.graph_at(g["nodes"], undated)[1].count() == 2
    named = views.named_edges(g["edges"], g["nodes"]).where("type = 'BLOCKADED'").first()
    assert (named["source_name"], named["target_name"], named["source_coords"]) == ("Iran", "Strait of Hormuz", None)


def test_map_places_spread_in_order_of_id(spark):
    nodes = spark.createDataFrame([("NationState:iran", None, None), ("a", None, None), ("b", None, None), ("c", 1.0, 2.0), ("z", None, None)], "id string, latitude double, longitude double")
    edges = spark.createDataFrame([("e1", "a", "c"), ("e2", "b", "a"), ("e3", "z", "q")], "id string, source string, target string")
    got = {r["id"]: r for r in views.map_nodes(nodes, edges).collect()}
    assert got["NationState:iran"]["map_position_source"] == "centroid" and got["c"]["map_position_source"] == "geocoded"
    assert got["a"]["map_position_source"] == got["b"]["map_position_source"] == "derived" and got["z"]["map_position_source"] is None
    o = spark.range(1).select(F.lit("x")).count() and got["b"]["map_latitude"] - got["a"]["map_latitude"]
    assert 0 <= abs(o) <= 3


def test_graph_without_dates_or_ids(spark):
    g = graph.graph(frame(spark, [{"entities": [US, IRAN], "relations": [relation("United States", "Iran", "ATTACKED")], "published_at": "bad"}]))
    e = g["edges"].first()
    assert (e["dates"], e["article_ids"], e["first_seen"]) == ([], [], None)


@pytest.mark.parametrize("cutoff", [None, "2026-04-10"])
def test_events_at(spark, cutoff):
    rows_ = spark.createDataFrame([("1", None, "A", None), ("2", "2026-04", "A", 0.5), ("3", "2026-04-11", "B", 0.9)], "id string, event_date string, event_type string, confidence double").withColumn("review_flags", F.array().cast(schemas.FLAGS))
    got = {r["id"] for r in views.events_at(rows_, cutoff).collect()}
    assert got == ({"1", "2", "3"} if cutoff is None else {"1", "2"})
