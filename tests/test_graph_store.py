"""Edge evidence in rows, places of rows among their key, and the store that is read by id."""

import json

import pytest
from pyspark.sql import functions as F

from tempora import cli, schemas, tables
from tempora.operators import graph
from tempora.plans import catalogue, pipelines
from tempora.sources import graph_store
from tempora.tables import ranked
from tests.records import entity, event, frame, person, relation


def test_places_run_over_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 7 == 0).alias("k"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("x"), F.col("id")).repartition(9)
    got = {}
    for r in ranked(rows, ["k"], ["x", "id"]).collect():
        got.setdefault(r["k"], []).append((r["place"], r["x"], r["id"]))
    for places in got.values():
        places.sort()
        assert [p for p, _, _ in places] == list(range(1, len(places) + 1)) and [p[1:] for p in places] == sorted(p[1:] for p in places)
    assert ranked(rows.limit(0), ["k"], ["x"]).count() == 0


def relations(spark, n):
    """All of one edge but a few."""
    edge = F.when(F.col("id") % 100_000 == 7, "small").otherwise("hot")
    none = F.lit(None).cast("string")
    return spark.range(n).select(
        edge.alias("edge_id"), F.lit("NationState:a").alias("source_id"), F.lit("NationState:b").alias("target_id"), F.lit("ATTACKED").alias("type"), (F.col("id") * 7919 % n).alias("rec_ord"), F.lit(0).alias("i"),
        F.concat(F.lit("a"), F.col("id") % 5000).alias("article_id"), F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")).alias("day"), none.alias("title"), none.alias("source_publication"), F.lit("q").alias("evidence"),
    )


def test_an_edge_of_a_million_relations(spark):
    n = 1_000_000
    found = graph.edge_evidence(relations(spark, n))
    assert "collect_list" not in found._jdf.queryExecution().toString()
    whole = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"), F.count_distinct("place").alias("places"))
    assert {r["id"]: (r["n"], r["last"], r["places"]) for r in whole.collect()} == {"hot": (n - 10,) * 3, "small": (10,) * 3}
    # in order of record; no task has all rows of the edge
    assert found.where("id = 'hot' AND place IN (1, 2)").orderBy("place").select("rec_ord").collect()[0][0] == 0
    parts = found.where("id = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 0.9 * n
    edge = graph.edge_counts(relations(spark, n)).where("id = 'hot'").first()
    assert (edge["weight"], edge["article_count"], edge["first_seen"], edge["last_seen"]) == (n - 10, 5000, "2024-01-01", "2024-01-28")


def test_evidence_rows_are_those_of_the_nested_edge(spark):
    records = frame(spark, [
        {"article_id": "a2", "published_at": "2026-04-12", "entities": [entity("A", "NationState"), entity("B", "NationState")], "relations": [relation("A", "B", "ATTACKED", "x"), relation("B", "A", "ATTACKED", "y"), relation("A", "B", "ATTACKED", "z")]},
        {"article_id": None, "published_at": "bad", "entities": [], "relations": [relation("A", "B", "ATTACKED", "w")]},
    ])
    made = graph.graph(records)
    nested = {(r["id"], k): (e["article_id"], e["published_at"], e["evidence"]) for r in made["edges"].collect() for k, e in enumerate(r["evidences"], 1)}
    assert {(r["id"], r["place"]): (r["article_id"], r["published_at"], r["evidence"]) for r in graph.edge_evidence(made["relations"]).collect()} == nested
    columns = ["id", "source", "target", "type", "weight", "article_count", "first_seen", "last_seen"]
    assert sorted(map(tuple, graph.edge_counts(made["relations"]).select(columns).collect())) == sorted(map(tuple, made["edges"].select(columns).collect()))
    assert sorted((r["id"], r["day"]) for r in graph.edge_days(made["relations"]).collect()) == sorted((r["id"], d) for r in made["edges"].collect() for d in r["dates"])


def scanned(df):
    """Files and rows that the scan of `df` has read."""
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return rows, *(leaf.metrics().apply(m).value() for m in ("numFiles", "numOutputRows"))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    records = [
        {"article_id": f"a{k}", "title": f"t{k}", "url": "u", "published_at": f"2026-04-{k % 28 + 1:02d}", "entities": [entity("Iran", "NationState"), entity(f"Place {k % 40}", "StrategicLocation")], "relations": [relation("Iran", f"Place {k % 40}", "BLOCKADED", f"q{k}")],
         "events": [event("BlockadeEvent", event_id=f"e{k}", participants=[person("Iran", "NationState", "initiator")], relations=[relation("Iran", f"Place {k % 40}", "BLOCKADED")])]}
        for k in range(200)
    ]
    made = pipelines.records_to_graph(frame(spark, records, schemas.EXTRACTION))
    graph_store.write_graph(made["nodes"], made["relations"], made["payload"], path, buckets=16)
    return path


def test_an_edge_is_one_file(spark, store):
    ident = "NationState:iran|BLOCKADED|StrategicLocation:place-7"
    rows, files, read = scanned(graph_store.find(spark, store, "evidence", ident))
    assert [r["place"] for r in sorted(rows, key=lambda r: r["place"])] == [1, 2, 3, 4, 5] and files == 1 and read < 200
    shown = graph_store.inspect_edge(spark, store, ident).orderBy("place").collect()
    assert [(r["evidence"], r["weight"], r["source_name"], r["target_name"]) for r in shown] == [(f"q{k}", 5, "Iran", "Place 7") for k in range(7, 200, 40)]
    assert graph_store.inspect_edge(spark, store, "no such edge").count() == 0


def test_an_event_is_one_file(spark, store):
    rows, files, _ = scanned(graph_store.find(spark, store, "events", "e11"))
    assert len(rows) == 1 and files == 1
    seen = graph_store.inspect_event(spark, store, "e11").first()
    assert seen["trust"]["status"] == "Schema Validated" and seen["article_id"] == "a11"
    assert graph_store.inspect_event(spark, store, "e999").count() == 0


def test_a_hot_id_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(100_000).select(F.when(F.col("id") < 99_000, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.col("id").alias("place"))
    graph_store.write(rows, f"{tmp_path}/t", ["place"], 8, file_rows=10_000)
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.count() == 100_000
    assert back.where("id = 'hot'").select(F.input_file_name()).distinct().count() > 3


def test_commands(spark, tmp_path):
    records = {"article_id": "a", "published_at": "2026-04-10", "entities": [entity("A", "NationState"), entity("B", "NationState")], "relations": [relation("A", "B", "ATTACKED")], "events": [event(event_id="e1")]}
    (tmp_path / "records.jsonl").write_text(json.dumps(records) + "\n")
    cli.main(["aggregate", "--records", f"{tmp_path}/records.jsonl", "--output", f"{tmp_path}/graph", "--store", f"{tmp_path}/store"], spark)
    cli.main(["inspect", "--store", f"{tmp_path}/store", "--edge", "NationState:a|ATTACKED|NationState:b", "--output", f"{tmp_path}/edge"], spark)
    cli.main(["inspect", "--store", f"{tmp_path}/store", "--event", "e1", "--output", f"{tmp_path}/event"], spark)
    assert spark.read.json(f"{tmp_path}/edge").first()["source_name"] == "A" and spark.read.json(f"{tmp_path}/event").first()["id"] == "e1"


def test_timeline_query_gathers_no_array(spark, small):
    plan = catalogue.QUERIES["edge_evidence_timeline"](spark, small)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


def test_counted_nodes_are_the_nodes_without_lists(spark):
    """Articles are counted in as many partitions as asked for; two names of one id are one node."""
    from tempora.operators import graph

    rows = [{"article_id": f"a{k % 7}", "published_at": f"2026-04-{k % 5 + 10}", "entities": [entity(x, "NationState") for x in ("A", "a!", f"N {k % 3}")], "relations": [relation("A", f"N {k % 3}", "ATTACKED")]} for k in range(20)]
    found = graph.mentions(frame(spark, rows, schemas.EXTRACTION))
    names = graph.registry(found)
    relations = graph.relation_rows(frame(spark, rows, schemas.EXTRACTION), names)[0]
    columns = ["id", "name", "type", "article_count", "relation_count", "first_seen", "last_seen"]
    want = sorted(map(tuple, graph.nodes_of(found, names, relations).select(columns).collect()))
    assert sorted(map(tuple, graph.node_counts(found, names, relations, 9).select(columns).collect())) == want and len(want) == 4
    assert sorted(map(tuple, graph.edge_counts(relations, 9).collect())) == sorted(map(tuple, graph.edge_counts(relations).collect()))


def test_nodes_and_their_articles_are_the_nested_nodes(spark, monkeypatch):
    """Two names of one id, aliases and flags that repeat, places of the first mention that has them, and no article; names that are broadcast or not."""
    flag = lambda k: {"code": f"c{k}", "message": "m"}
    rows = [
        {"article_id": None if k == 5 else f"a{k % 7}", "published_at": "bad" if k == 3 else f"2026-04-{k % 5 + 10}", "relations": [relation("A", f"N {k % 3}", "ATTACKED"), relation("A", "A", "SUPPORTED")],
         "entities": [entity("A", "NationState", aliases=["A", "", None, f"b{k % 4}"]), entity("a!", "NationState", latitude=1.0 + k if k > 2 else None, geocode_source=f"g{k}" if k > 4 else None, review_flags=[flag(9 - k % 4), None, {"code": None, "message": "x"}, flag(k % 2)]), entity(f"N {k % 3}", "NationState"), entity("N 0", "NationState", review_flags=[])]}
        for k in range(20)
    ] + [{"article_id": None, "published_at": None, "entities": [entity("Lonely", "MilitaryAsset", longitude=2.0)], "relations": []}]
    records = frame(spark, rows, schemas.EXTRACTION)
    found = graph.mentions(records)
    names = graph.registry(found)
    accepted = graph.relation_rows(records, names)[0]
    nested = graph.nodes_of(found, names, accepted)
    for parts, broadcast in ((None, 100_000), (9, 0)):
        monkeypatch.setattr(tables, "BROADCAST_ROWS", broadcast)
        nodes, articles = graph.node_tables(found, names, accepted, parts)
        assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, nested.drop("article_ids").select(nodes.columns).collect())) and nodes.count() == 5
        assert sorted(map(tuple, articles.collect())) == sorted((r["id"], a) for r in nested.collect() for a in r["article_ids"])
    a = nodes.where("id = 'NationState:a'").first()
    assert a["aliases"] == ["b0", "b1", "b2", "b3"] and a["latitude"] == 4.0 and a["geocode_source"] == "g5" and [f["code"] for f in a["review_flags"]] == ["c9", "c0", "c8", "c1", "c7", "c6"]
    plans = [x._jdf.queryExecution().toString() for x in (nodes, articles)]
    assert not any(f"collect_{kind}(article_id" in plan for plan in plans for kind in ("set", "list"))


def test_a_store_has_articles_as_rows(spark, store):
    """Of nodes that list them, too."""
    assert "article_ids" not in spark.read.parquet(f"{store}/nodes").columns
    assert graph_store.find(spark, store, "nodes", "NationState:iran").first()["article_count"] == 200
    assert sorted(r["article_id"] for r in graph_store.find(spark, store, "articles", "NationState:iran").collect()) == sorted(f"a{k}" for k in range(200))
    assert spark.read.parquet(f"{store}/articles").count() == 400


def test_edge_inspector_gathers_no_articles(spark, small, monkeypatch):
    """The rows that the query's store is made of: no row of a node has its articles, none of which is lost."""
    kept = {}
    monkeypatch.setattr(graph_store, "write", lambda rows, path, order, *more, f=graph_store.write: (kept.update({path.rsplit("/", 1)[1]: rows}), f(rows, path, order, *more)))
    assert catalogue.QUERIES["edge_inspector"](spark, small).count() > 0
    plan = kept["nodes"]._jdf.queryExecution().toString()
    assert "article_ids" not in kept["nodes"].columns and "collect_set(article_id" not in plan
    found = catalogue.entity_view(spark, small)
    assert kept["articles"].count() == found.select("key", "article_id").distinct().count() == kept["nodes"].agg(F.sum("article_count")).first()[0]
