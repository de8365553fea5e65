"""The queries that exercise the operators over the driver's tables, each with SQL that gives the same rows.

Views: R, relations between nations of customers and suppliers, an order being an article; E, entities of orders; EV,
events of users as articles with nested events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora import schemas
from tempora.functions import arrays, coords, dates, text
from tempora.operators import adjudicate, assignment, candidates, clean, diffs, errors, geocode, graph, matching, relations, scoring, views
from tempora.plans import extract
from tempora.shipping import shipped
from tempora.tables import ROW, numbered, parts, ranked, spool

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Fixed values of the views.
EVENT_OF = {"error": "AttackEvent", "click": "ThreatEvent", "view": "NegotiationEvent", "purchase": "SupportEvent", "signup": "SanctionEvent"}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = shipped(f)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


def _parts(spark: SparkSession, d: str) -> int:
    """Partitions for the order lines, whose number files tell."""
    return parts(spark, table(spark, d, "lineitem").count())


R_SQL = """
R AS (
  SELECT l_orderkey AS rec_ord, l_linenumber AS i, 'order:' || CAST(l_orderkey AS VARCHAR) AS article_id, strftime(o_orderdate, '%Y-%m-%d') AS day, cn.n_name AS source, sn.n_name AS target,
         CASE l_returnflag WHEN 'A' THEN 'ATTACKED' WHEN 'N' THEN 'NEGOTIATED_WITH' ELSE 'SUPPORTED' END AS type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey),
N AS (SELECT *, 'NationState:' || regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g') AS s, 'NationState:' || regexp_replace(lower(target), '[^a-z0-9]+', '-', 'g') AS t FROM R WHERE source <> target)
"""


def relation_view(spark: SparkSession, d: str) -> DataFrame:
    """R: each order line relates its customer's nation to its supplier's; loops are dropped."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")  # 25 rows
    customers = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("source"))
    suppliers = table(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("target"))
    orders = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "source")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    n = _parts(spark, d)
    rows = lines.repartition(n, "l_orderkey").join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).where("source <> target")
    kind = F.when(F.col("l_returnflag") == "A", "ATTACKED").when(F.col("l_returnflag") == "N", "NEGOTIATED_WITH").otherwise("SUPPORTED")
    return rows.select(F.col("l_orderkey").alias("rec_ord"), F.col("l_linenumber").alias("i"), F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("article_id"), _day("o_orderdate").alias("day"), "source", "target", kind.alias("type"))


def accepted(rows: DataFrame) -> DataFrame:
    """R in the form that edges are made of."""
    s, t = text.node_id("source", F.lit("NationState")), text.node_id("target", F.lit("NationState"))
    rows = rows.select("rec_ord", "i", "article_id", "day", F.lit(None).cast("string").alias("title"), F.lit("orders").alias("source_publication"), s.alias("source_id"), t.alias("target_id"), "type", F.lit("line").alias("evidence"))
    return rows.withColumn("edge_id", text.edge_id("source_id", "target_id", "type"))


@query(f"WITH {R_SQL} SELECT s || '|' || type || '|' || t AS id, s AS source, t AS target, type, count(*) AS weight, count(DISTINCT article_id) AS article_count, min(day) AS first_seen, max(day) AS last_seen FROM N GROUP BY s, t, type")
def edge_weights(spark, d):
    """Edges with weight, articles and first and last day."""
    return graph.edge_counts(accepted(relation_view(spark, d)), _parts(spark, d))


@query(f"""WITH {R_SQL} SELECT s || '|' || type || '|' || t AS id, row_number() OVER e AS place, rec_ord, article_id, day, count(*) OVER (PARTITION BY s, type, t) AS weight,
min(day) OVER (PARTITION BY s, type, t) AS first_seen, max(day) OVER (PARTITION BY s, type, t) AS last_seen FROM N WINDOW e AS (PARTITION BY s, type, t ORDER BY rec_ord, i)""")
def edge_evidence_timeline(spark, d):
    """Every relation with its place in its edge, beside the edge's counts."""
    rows = accepted(relation_view(spark, d))
    edges = spool(graph.edge_counts(rows, _parts(spark, d)), "edges").select("id", "weight", "first_seen", "last_seen")
    return graph.edge_evidence(rows).join(edges, "id").select("id", "place", "rec_ord", "article_id", F.col("published_at").alias("day"), "weight", "first_seen", "last_seen")


@query(f"WITH {R_SQL} SELECT s || '|' || type || '|' || t AS id, type, day, count(*) AS weight FROM N GROUP BY s, type, t, day")
def edge_days(spark, d):
    return graph.edge_days(accepted(relation_view(spark, d)))


E_SQL = """
E AS (
  SELECT o_orderkey AS rec_ord, 0 AS i, 'order:' || CAST(o_orderkey AS VARCHAR) AS article_id, strftime(o_orderdate, '%Y-%m-%d') AS day, n_name AS name, 'NationState' AS type
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT l_orderkey, l_linenumber, 'order:' || CAST(l_orderkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), s_name, 'NonStateActor'
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)
"""


def entity_view(spark: SparkSession, d: str) -> DataFrame:
    """E in the form of graph.mentions."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    customers = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", _day("o_orderdate").alias("day"))
    nations = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("rec_ord"), F.lit(0).alias("i"), "day", F.col("n_name").alias("name"), F.lit("NationState").alias("type"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(table(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = _parts(spark, d)
    actors = lines.repartition(n, "l_orderkey").join(orders.select("o_orderkey", "day").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("rec_ord"), F.col("l_linenumber").alias("i"), "day", F.col("s_name").alias("name"), F.lit("NonStateActor").alias("type"))
    rows = nations.unionByName(actors)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("latitude", "double"), ("longitude", "double"), ("geocode_source", "string"), ("geocode_display_name", "string"), ("aliases", "array<string>"), ("review_flags", schemas.FLAGS))]
    return rows.select("rec_ord", "i", F.concat(F.lit("order:"), F.col("rec_ord").cast("string")).alias("article_id"), "day", "name", "type", *none, text.fold("name").alias("key"))


_SLUG = "trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"WITH {E_SQL} SELECT type || ':' || {_SLUG} AS id, name, type, min(day) AS first_seen, max(day) AS last_seen, count(DISTINCT article_id) AS article_count FROM E GROUP BY name, type")
def node_registry(spark, d):
    found = entity_view(spark, d)
    names = graph.registry(found)
    seen = graph.article_counts(found, "key", _parts(spark, d))
    return names.join(seen, "key").select("id", "name", "type", "first_seen", "last_seen", "article_count")


@query(f"WITH {R_SQL}, X AS (SELECT s AS id, s || type || t AS e FROM N UNION ALL SELECT t, s || type || t FROM N) SELECT id, count(DISTINCT e) AS relation_count FROM X GROUP BY id")
def node_relation_counts(spark, d):
    return graph.relation_counts(graph.ends_of(accepted(relation_view(spark, d))))


@query(f"WITH {R_SQL} SELECT type, count(*) AS relations, count(DISTINCT s || t) AS edges, min(day) AS min_date, max(day) AS max_date, count(DISTINCT day) AS days FROM N GROUP BY type")
def graph_metadata(spark, d):
    """Relations, edges and timeline by type, of edges and their days."""
    rows = accepted(relation_view(spark, d))
    edges = graph.edge_counts(rows, _parts(spark, d)).groupBy("type").agg(F.sum("weight").alias("relations"), F.count(F.lit(1)).alias("edges"), F.min("first_seen").alias("min_date"), F.max("last_seen").alias("max_date"))
    days = graph.edge_days(rows).select("type", "day").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("days"))
    return edges.join(days, "type")


@query(f"""WITH {R_SQL}, {E_SQL}, B AS (SELECT name, min(rec_ord) AS born FROM E WHERE type = 'NationState' GROUP BY name)
SELECT R.type, count(*) AS skipped FROM R LEFT JOIN B bs ON R.source = bs.name LEFT JOIN B bt ON R.target = bt.name
WHERE NOT coalesce(bs.born <= R.rec_ord AND bt.born <= R.rec_ord, false) AND R.source <> R.target GROUP BY R.type""")
def skipped_relations(spark, d):
    """Relations with an end that no earlier record names."""
    nested = relation_view(spark, d).groupBy("rec_ord", "article_id", "day").agg(F.array_sort(F.collect_list(F.struct("i", "source", "target", "type"))).alias("r"))
    link = F.transform("r", lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), r["type"].alias("type"), F.lit("line").alias("evidence")))
    records = nested.select("rec_ord", "article_id", F.col("day").alias("published_at"), F.lit(None).cast("string").alias("title"), F.lit("orders").alias("source"), link.alias("relations"))
    names = graph.registry(entity_view(spark, d).where("type = 'NationState'"))
    return graph.relation_rows(records, names)[1].groupBy("type").agg(F.count(F.lit(1)).alias("skipped"))


@query(f"""WITH {R_SQL}, G AS (SELECT s, t, type, count(*) AS weight, min(day) AS first_seen FROM N GROUP BY s, t, type),
V AS (SELECT id FROM (SELECT s AS id, min(day) AS f FROM N GROUP BY s UNION ALL SELECT t, min(day) FROM N GROUP BY t) GROUP BY id HAVING min(f) <= '1995-03-01')
SELECT s || '|' || type || '|' || t AS id, weight, first_seen FROM G WHERE first_seen <= '1995-03-01' AND s IN (SELECT id FROM V) AND t IN (SELECT id FROM V)""")
def graph_at_cutoff(spark, d):
    rows = accepted(relation_view(spark, d))
    edges = rows.groupBy(F.col("edge_id").alias("id"), F.col("source_id").alias("source"), F.col("target_id").alias("target")).agg(F.count(F.lit(1)).alias("weight"), F.min("day").alias("first_seen"))
    nodes = rows.select(F.explode(F.array("source_id", "target_id")).alias("id"), "day").groupBy("id").agg(F.min("day").alias("first_seen"))
    return views.graph_at(nodes.withColumn("review_flags", F.array().cast(schemas.FLAGS)), edges, "1995-03-01")[1].select("id", "weight", "first_seen")


EV_SQL = """
EV AS (
  SELECT event_id, user_id, 'user:' || CAST(user_id AS VARCHAR) AS article_id,
    CASE event_type WHEN 'error' THEN 'AttackEvent' WHEN 'click' THEN 'ThreatEvent' WHEN 'view' THEN 'NegotiationEvent' WHEN 'purchase' THEN 'SupportEvent' ELSE 'SanctionEvent' END AS event_type,
    strftime(ts, '%Y-%m-%d') AS event_date, 'place ' || json_extract_string(props, '$.k') AS location, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value, props,
    least(greatest(value / 100.0, 0.0), 1.0) AS confidence, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos
  FROM events)
"""


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    """EV: rows of events with the columns of a nested event in `e`."""
    rows = table(spark, d, "events")
    kind = F.create_map(*[F.lit(x) for p in EVENT_OF.items() for x in p])[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("int")
    place, actor = F.concat(F.lit("place "), k.cast("string")), F.concat(F.lit("actor "), (k % 7).cast("string"))
    people = F.array(F.struct(actor.alias("name"), F.lit("NonStateActor").alias("type"), F.lit("initiator").alias("role")), F.struct(place.alias("name"), F.lit("StrategicLocation").alias("type"), F.lit("target").alias("role")))
    link = F.array(F.struct(actor.alias("source"), place.alias("target"), F.lit("ATTACKED").alias("type"), F.col("props").alias("evidence")))
    e = F.struct(
        F.col("event_id").cast("string").alias("event_id"), kind.alias("event_type"), _day("ts").alias("event_date"), F.lit("day").alias("date_precision"), place.alias("location"), people.alias("participants"), link.alias("relations"),
        F.lit(None).cast("string").alias("summary"), F.col("props").alias("evidence"), F.least(F.greatest(F.col("value") / 100.0, F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.lit(None).cast("string").alias("review_status"),
        F.lit(None).cast(schemas.FLAGS).alias("review_flags"), F.lit(None).cast(schemas.GEOCODE).alias("location_geocode"),
    ).cast(schemas.EVENT)
    return rows.select("event_id", "user_id", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("article_id"), k.alias("k"), "value", "props", e.alias("e"))


def event_records(rows: DataFrame) -> DataFrame:
    """Users as records with their events in order of id."""
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    nested = rows.groupBy("user_id", "article_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "e"))).alias("x"))
    return nested.select(
        F.col("user_id").alias("rec_ord"), "article_id", F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("title"), F.lit("events").alias("source"), none("string", "published_at"), none("string", "url"), none("string", "source_url"),
        none("string", "model"), none("string", "prompt_version"), none("string", "extracted_at"), none(f"array<{schemas.ENTITY}>", "entities"), none(f"array<{schemas.RELATION}>", "relations"), F.transform("x", lambda x: x["e"]).alias("events"), none(schemas.FLAGS, "postprocess_review_flags"),
    )


@query(f"WITH {EV_SQL} SELECT CAST(event_id AS VARCHAR) AS event_id, article_id, pos AS event_pos, event_type, event_date, location, props AS evidence, confidence FROM EV")
def events_flatten(spark, d):
    flat = geocode.flatten_events(event_records(event_rows(spark, d)))
    return flat.select("event_id", "article_id", F.col("event_pos").cast("long").alias("event_pos"), "event_type", "event_date", "location", "evidence", "confidence")


@query(f"WITH {EV_SQL} SELECT CAST(event_id AS VARCHAR) AS id, event_date, confidence FROM EV WHERE event_date <= '2024-01-10' AND event_type = 'AttackEvent' AND confidence >= 0.3")
def events_at_cutoff(spark, d):
    rows = event_rows(spark, d).select(F.col("e.event_id").alias("id"), "e.event_date", "e.event_type", "e.confidence", "e.review_flags")
    return views.events_at(rows, "2024-01-10", "AttackEvent", 0.3).select("id", "event_date", "confidence")


@query(f"WITH {EV_SQL} SELECT event_type, count(*) AS count FROM EV GROUP BY event_type")
def event_type_counts(spark, d):
    return views.type_ranking(event_rows(spark, d).select("e.event_type"))


@query(f"""WITH {EV_SQL} SELECT CASE WHEN k % 5 = 0 THEN 'missing_evidence' WHEN k % 5 = 1 THEN 'missing_participants' WHEN k % 5 = 2 THEN 'missing_source_url' WHEN k % 5 = 3 THEN 'missing_geocode' ELSE 'schema_validated' END AS status, count(*) AS n FROM EV GROUP BY 1""")
def event_validation_status(spark, d):
    k, e = F.col("k") % 5, F.col("e")
    changed = F.when(k == 0, e.withField("evidence", F.lit(""))).when(k == 1, e.withField("participants", F.array().cast(f"array<{schemas.PARTICIPANT}>"))).otherwise(e)
    status = graph.validation_status(changed, F.when(k == 2, F.lit("")).otherwise("http://x"), F.when(k == 4, F.lit(1.0)), F.when(k == 4, F.lit(2.0)))
    return event_rows(spark, d).select(status.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV_SQL} SELECT article_id, event_type, event_date, location, CAST(min(event_id) AS VARCHAR) AS event_id FROM EV GROUP BY article_id, event_type, event_date, location, props")
def event_dedupe_first(spark, d):
    """The first event of each identity in a user's record."""
    records = event_records(event_rows(spark, d))
    kept = records.select("article_id", F.explode(arrays.first_by(F.col("events"), clean.event_identity)).alias("e"))
    return kept.select("article_id", "e.event_type", "e.event_date", "e.location", "e.event_id")


@query(f"""WITH {EV_SQL}, D AS (SELECT DISTINCT event_date AS day FROM EV), P AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM D)
SELECT day FROM P WHERE n <= 8 OR i IN (0, n - 1) OR i IN (SELECT CAST(floor(x * (n - 1) / 6.0 + 0.5) AS BIGINT) FROM range(1, 6) t(x))""")
def timeline_ticks(spark, d):
    days = views.timeline(event_rows(spark, d).select(F.col("e.event_date").alias("day")))
    return days.agg(F.array_sort(F.collect_list("day")).alias("days")).select(F.explode(views.ticks(F.col("days"))).alias("day"))


@query("""SELECT c_custkey, CASE WHEN n_name = 'UNITED STATES' THEN 'United States' WHEN n_name = 'UNITED KINGDOM' THEN 'United Kingdom' WHEN n_name = 'CHINA' THEN 'People''s Republic' ELSE n_name END AS canonical_name
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def alias_canonicalise(spark, d):
    names = spark.createDataFrame([("united states", "United States", None), ("united kingdom", "United Kingdom", None), ("china", "People's Republic", None)], "alias string, canonical_name string, canonical_type string")
    nation = table(spark, d, "nation")
    rows = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("  '"), F.col("n_name"), F.lit("' ")).alias("said"))
    return clean.resolve_names(rows, "said", names).select("c_custkey", "canonical_name")


@query(f"""WITH {R_SQL}, F AS (SELECT rec_ord, source, target, type, row_number() OVER (PARTITION BY rec_ord, source, target, type ORDER BY i) AS n FROM R)
SELECT type, count(*) FILTER (WHERE source <> target AND n = 1) AS kept, (SELECT count(*) FROM R r2 WHERE r2.type = F.type AND r2.source = r2.target) AS loops FROM F GROUP BY type""")
def endpoint_resolution(spark, d):
    """Relations of an order cleaned against its own entities: resolved, without loops and repeats."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    customers = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("source"))
    suppliers = table(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("target"))
    orders = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "source")
    kind = F.when(F.col("l_returnflag") == "A", "ATTACKED").when(F.col("l_returnflag") == "N", "NEGOTIATED_WITH").otherwise("SUPPORTED")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", kind.alias("type")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    link = F.struct(F.col("l_linenumber").alias("i"), "source", "target", "type", F.lit("line").alias("evidence"))
    nested = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(link)).alias("r"))
    named = F.array_distinct(F.flatten(F.transform("r", lambda r: F.array(r["source"], r["target"]))))
    index = F.map_from_entries(F.transform(named, lambda n: F.struct(text.fold(n), F.struct(n.alias("name"), F.lit("NationState").alias("type")))))
    nested = nested.withColumn("index", index).withColumn("known", F.create_map().cast("map<string,struct<name:string,type:string>>"))
    done = nested.select(clean.cleaned_relations(F.col("r"), F.col("index"), F.col("known")).alias("x"), F.filter("r", lambda r: r["source"] == r["target"]).alias("loops"))
    # orders are told apart by their flags behind the explode, so that no filter computes them again
    done = done.select("x.kept", F.when(F.size("loops") == F.size("x.flags"), F.col("loops")).alias("loops"))
    sides = done.select(F.explode(F.when(F.col("loops").isNotNull(), F.concat(F.transform("kept", lambda r: F.struct(r["type"].alias("type"), F.lit(1).alias("k"), F.lit(0).alias("l"))), F.transform("loops", lambda r: F.struct(r["type"].alias("type"), F.lit(0).alias("k"), F.lit(1).alias("l")))))).alias("x"))
    return sides.groupBy("x.type").agg(F.sum("x.k").alias("kept"), F.sum("x.l").alias("loops"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(url, '') WHEN doc_id % 3 = 1 THEN coalesce(url, '-') ELSE 'own' END AS url FROM (SELECT doc_id, max(url) AS url FROM documents LEFT JOIN pages ON doc_id = page_id GROUP BY doc_id)")
def metadata_backfill(spark, d):
    docs = table(spark, d, "documents").select("doc_id").distinct()
    own = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 2, "own")
    records = docs.select(F.col("doc_id").cast("string").alias("article_id"), "doc_id", own.alias("url"))
    articles = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("article_id"), "url", F.col("page_id").alias("rec_ord"))
    filled = clean.backfill(records, articles, ("url",))
    return filled.select("doc_id", F.coalesce("url", F.when(F.col("doc_id") % 3 == 1, "-").otherwise("")).alias("url"))


@query("""SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'override' WHEN n_nationkey % 4 = 1 THEN 'nominatim' ELSE 'missing' END AS geocode_source,
CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey + 0.5 WHEN n_nationkey % 4 = 1 THEN n_nationkey + 0.25 END AS latitude,
CASE WHEN n_nationkey % 4 = 0 THEN '' WHEN n_nationkey % 4 = 1 THEN 'low_importance_match' ELSE 'missing_coordinates' END AS flags FROM nation""")
def geocode_precedence(spark, d):
    nation = table(spark, d, "nation")
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    place = lambda shift, source, rank: [F.col("n_name").alias("query"), (F.col("n_nationkey") + shift).cast("double").alias("latitude"), F.lit(1.0).alias("longitude"), F.col("n_name").alias("display_name"), F.lit(source).alias("source"), none("string", "osm_type"), none("string", "osm_category"), none("string", "osm_addresstype"), F.lit(rank).cast("double").alias("raw_importance"), none("string", "notes")]
    overrides = nation.where("n_nationkey % 4 = 0").select(*place(0.5, "override", None))
    cache = nation.where("n_nationkey % 4 IN (0, 1)").select(text.norm("n_name").alias("query_key"), *place(0.25, "nominatim", 0.001))
    asked = nation.select(text.fold("n_name").alias("key"), F.col("n_name").alias("name"), F.struct(F.col("n_nationkey").cast("long").alias("rec_ord"), F.lit(0).alias("part"), F.lit(0).alias("i")).alias("ord"))
    found, _ = geocode.geocode(asked, overrides, cache)
    return found.select("name", "geocode_source", "latitude", F.array_join(F.transform("review_flags", lambda f: f["code"]), ",").alias("flags"))


@query(f"WITH {EV_SQL} SELECT lower(location) AS key, arg_min(location, user_id * 1000000 + pos) AS name FROM EV GROUP BY 1")
def unique_locations(spark, d):
    return geocode.unique_locations(event_records(event_rows(spark, d))).select("key", "name")


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '(^|\s)(port|ports|base|bases|airspace|waters)(\s|$)') OR regexp_matches(lower(p_name), '(port|ports|base|bases|airspace|waters)$') THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches(lower(p_name), '^(iranian |israeli |american |british |pakistani |chinese )') THEN 1 ELSE 0 END AS flags FROM part""")
def location_flags(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(text.location_flags("p_name")).alias("flags"))


@query(f"""WITH {EV_SQL}, X AS (SELECT lower(location) AS l, article_id AS a, location, row_number() OVER (PARTITION BY lower(location), article_id ORDER BY user_id, pos) AS n, k FROM EV)
SELECT location AS location_name, a AS article_id, CASE WHEN k % 10 = 0 AND a = 'user:1' THEN 1.5 END AS suggested_latitude FROM X WHERE n = 1""")
def geocode_review_rows(spark, d):
    rows = event_rows(spark, d)
    flat = geocode.flatten_events(event_records(rows))
    review = rows.where("article_id = 'user:1' AND k % 10 = 0").select(F.col("e.location").alias("location_name"), "article_id", F.lit("").alias("event_summary"), F.lit(1.5).alias("suggested_latitude"), F.lit(2.5).alias("suggested_longitude"), F.col("event_id").alias("rec_ord"))
    return geocode.geocode_review_rows(flat, geocode.suggestions(review)).select("location_name", "article_id", "suggested_latitude")


@query(r"""SELECT page_id, nullif(regexp_extract(html, '<html[^>]+lang="([^"]+)"', 1), '') AS language, len(regexp_split_to_array(trim(html), '[ \t\n\r]+')) AS word_count FROM pages""")
def page_ingest(spark, d):
    from tempora.sources import pages

    return table(spark, d, "pages").select("page_id", pages.language("html").alias("language"), F.size(F.split(F.trim("html"), r"[ \t\n\r]+")).cast("long").alias("word_count"))


#: Words of the shingle by which a passage finds the texts that may hold it.
PASSAGE_WORDS = 5


def passages(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's passages; null ones are in no text."""
    return table(spark, d, "benchmark").where("text IS NOT NULL").select("item_id", F.col("text").alias("passage"))


def quoting(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Rows of `docs` with each row of `quotes` whose `quote` is in their `body`, for any number of quotes.

    Where a text holds a quote, all words of the quote but the first and the last are words of the text. A quote is found
    by a hash of its first PASSAGE_WORDS inner words, or of its longest if there are fewer, and then looked up in the text;
    quotes of one or two words have no inner word and are compared with every text.
    """
    docs, quotes = numbered(docs, "texts").withColumnRenamed(ROW, "doc_row"), numbered(quotes, "quotes").withColumnRenamed(ROW, "quote_row")
    n = F.size("words")
    inner = F.slice("words", 2, F.greatest(n - 2, F.lit(0)))
    kind = F.when(n >= PASSAGE_WORDS + 2, PASSAGE_WORDS).when(n >= 3, 1).otherwise(0)
    longest = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    shingle = F.when(n >= PASSAGE_WORDS + 2, F.array_join(F.slice("words", 2, PASSAGE_WORDS), " ")).otherwise(longest)
    split = quotes.withColumn("words", F.split("quote", " "))
    keyed = spool(split.select("quote_row", kind.alias("kind"), F.xxhash64(kind, shingle).alias("key")), "quote-keys")
    kinds = {r["kind"] for r in keyed.select("kind").distinct().collect()}  # three at most

    words = docs.select("doc_row", F.split("body", " ").alias("words"))
    found = {
        PASSAGE_WORDS: F.transform(F.sequence(F.lit(1), n - PASSAGE_WORDS + 1), lambda i: F.xxhash64(F.lit(PASSAGE_WORDS), F.array_join(F.slice("words", i, PASSAGE_WORDS), " "))),
        1: F.transform("words", lambda x: F.xxhash64(F.lit(1), x)),
    }
    rows = docs.join(quotes.join(keyed.where("kind = 0"), "quote_row", "left_semi"), F.contains("body", "quote"))
    for k in sorted(kinds - {0}):
        keys = words.where(n >= k).select("doc_row", F.explode(F.array_distinct(found[k])).alias("key"))
        pairs = keys.join(keyed.where(F.col("kind") == k), "key").select("doc_row", "quote_row")
        rows = rows.unionByName(docs.join(pairs, "doc_row").join(quotes, "quote_row").where(F.contains("body", "quote")).select(*rows.columns))
    return rows.drop("doc_row", "quote_row")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(regexp_replace(d.text, '[ \\t\\n\\r]+', ' ', 'g'), regexp_replace(trim(b.text), '[ \\t\\n\\r]+', ' ', 'g'))".replace("\\\\", "\\"))
def evidence_exact(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.norm_space("text").alias("body"))
    quotes = passages(spark, d).withColumn("quote", text.norm_space("passage"))
    return quoting(docs, quotes).select("doc_id", "item_id")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(regexp_replace(d.text, '[ \\t\\n\\r]+', ' ', 'g')), lower(regexp_replace(trim(b.text), '[ \\t\\n\\r]+', ' ', 'g')))".replace("\\\\", "\\"))
def evidence_casefold(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.norm("text").alias("body"))
    return quoting(docs, passages(spark, d).withColumn("quote", text.norm("passage"))).select("doc_id", "item_id")


@query("""WITH x AS (SELECT doc_id, item_id, regexp_replace(trim(d.text), '[ \\t\\n\\r]+', ' ', 'g') AS b, regexp_replace(trim(bm.text), '[ \\t\\n\\r]+', ' ', 'g') AS q FROM documents d JOIN benchmark bm
ON contains(regexp_replace(d.text, '[ \\t\\n\\r]+', ' ', 'g'), regexp_replace(trim(bm.text), '[ \\t\\n\\r]+', ' ', 'g'))), y AS (SELECT *, strpos(replace(lower(b), 'ß', 'ss'), replace(lower(q), 'ß', 'ss')) AS p FROM x)
SELECT doc_id, item_id, trim(substr(b, greatest(p - 40, 1), p + length(q) + 40 - greatest(p - 40, 1))) AS context FROM y""".replace("\\\\", "\\"))
def nearby_context(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", text.norm_space("text").alias("body"))
    found = quoting(docs, passages(spark, d).withColumn("quote", text.norm_space("passage")))
    return found.select("doc_id", "item_id", text.nearby("text", "passage", 40).alias("context"))


@query("SELECT doc_id, replace(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'))), 'ß', 'ss') AS body FROM documents".replace("\\\\", "\\"))
def normalise_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.norm("text").alias("body"))


@query("SELECT p_partkey, 'MilitaryAsset:' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS id, 'event:' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || ':' || printf('%03d', p_size + 1) || ':attackevent' AS event_id FROM part")
def slug_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", text.node_id("p_name", F.lit("MilitaryAsset")).alias("id"), text.event_id("p_name", "p_size", F.lit("AttackEvent")).alias("event_id"))


_PRF_SQL = """
K AS (SELECT l.doc_id, d.lang AS label, CAST(l.quality AS INTEGER) AS g, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
C AS (SELECT label, count(*) FILTER (WHERE g = 1 AND p = 1) AS tp, count(*) FILTER (WHERE g = 0 AND p = 1) AS fp, count(*) FILTER (WHERE g = 1 AND p = 0) AS fn FROM K GROUP BY GROUPING SETS ((), (label)))
"""


def _label_keys(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"), "n_chars")
    rows = table(spark, d, "labels").join(docs, "doc_id").withColumn("key", F.col("doc_id"))
    return rows.where("quality = 1").select("key", "label"), rows.where("n_chars > 1500").select("key", "label")


@query(f"WITH {_PRF_SQL}, P AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM C) SELECT coalesce(label, '*') AS label, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 9) AS f1 FROM P WHERE label IS NULL OR tp + fp + fn > 0")
def prf_micro_by_label(spark, d):
    gold, pred = _label_keys(spark, d)
    found = scoring.metric_block(gold, pred, "quality")
    return found.select(F.coalesce("label", F.lit("*")).alias("label"), "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_PRF_SQL} SELECT doc_id AS key, CASE WHEN g = 1 THEN 'missing' ELSE 'extra' END AS side FROM K WHERE g <> p")
def key_set_diff(spark, d):
    gold, pred = (rows.select("key", F.lit(0).alias("i")) for rows in _label_keys(spark, d))
    return diffs.item_diff(gold, pred, ["key"], "i").select("key", "side")


_SIM_SQL = """
S AS (
  SELECT g.user_id, g.article_id, g.gi, p.pi, 0.30 * CASE WHEN g.event_type = p.event_type THEN 1.0 ELSE 0.0 END + 0.18 * CASE WHEN g.event_date = p.event_date THEN 1.0 ELSE 0.0 END + 0.12 * CASE WHEN g.k = p.k THEN 1.0 ELSE 0.0 END
    + 0.20 * CASE WHEN g.k = p.k THEN 1.0 WHEN g.k % 7 = p.k % 7 THEN 1.0 / 3 ELSE 0.0 END + 0.20 * CASE WHEN g.k = p.k THEN 1.0 ELSE 0.0 END AS similarity
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS gi FROM EV WHERE event_id % 2 = 0) g
  JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pi FROM EV WHERE event_id % 2 = 1) p ON g.user_id = p.user_id)
"""


def matched_users(spark, d, threshold: float = matching.THRESHOLD) -> DataFrame:
    """Users' even events as gold, odd ones as predictions, matched."""
    rows = event_rows(spark, d)
    gold, pred = event_records(rows.where("event_id % 2 = 0")), event_records(rows.where("event_id % 2 = 1"))
    return matching.match_articles(matching.paired_records(gold, pred), threshold)


def matched_events(spark, d) -> tuple[DataFrame, DataFrame]:
    """The same events in rows (pair, i, f) and (pair, j, f), each with its place among the user's."""
    rows = event_rows(spark, d)
    side = lambda odd, place: ranked(rows.where(F.col("event_id") % 2 == odd).select(F.col("user_id").alias("pair"), "event_id", matching.features(F.col("e")).alias("f")), ["pair"], ["event_id"]).select("pair", (F.col("place") - 1).cast("int").alias(place), "f")
    return side(0, "i"), side(1, "j")


def _told(found: DataFrame) -> DataFrame:
    return found.select(F.concat(F.lit("user:"), F.col("pair").cast("string")).alias("article_id"), F.col("i").alias("gold_index"), F.col("j").alias("pred_index"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {EV_SQL}, {_SIM_SQL} SELECT article_id, CAST(gi AS INTEGER) AS gold_index, CAST(pi AS INTEGER) AS pred_index, CAST(round(similarity, 6) AS DOUBLE) AS similarity FROM S WHERE similarity >= 0.45")
def event_similarity_pairs(spark, d):
    """Pairs by keys of features that they share."""
    return _told(assignment.similar_events(*matched_events(spark, d)))


# each step lets every user's next gold event choose
_GREEDY_SQL = f"""WITH RECURSIVE {EV_SQL}, {_SIM_SQL},
C AS MATERIALIZED (SELECT user_id, gi, pi, similarity FROM S WHERE similarity >= 0.45),
T AS (
  SELECT DISTINCT user_id, CAST(-1 AS BIGINT) AS gi, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pi, CAST(NULL AS DOUBLE) AS similarity FROM C
  UNION ALL
  SELECT user_id, gi, CASE WHEN pi IS NULL THEN used ELSE list_append(used, pi) END, pi, similarity FROM (
    SELECT T.user_id, T.gi + 1 AS gi, any_value(T.used) AS used, arg_min(C.pi, C.pi - 1000000 * C.similarity) FILTER (WHERE C.pi IS NOT NULL AND NOT list_contains(T.used, C.pi)) AS pi,
      max(C.similarity) FILTER (WHERE C.pi IS NOT NULL AND NOT list_contains(T.used, C.pi)) AS similarity
    FROM T LEFT JOIN C ON T.user_id = C.user_id AND C.gi = T.gi + 1 WHERE T.gi < (SELECT max(gi) FROM C) GROUP BY T.user_id, T.gi))
SELECT 'user:' || CAST(user_id AS VARCHAR) AS article_id, CAST(gi AS INTEGER) AS gold_index, CAST(pi AS INTEGER) AS pred_index, CAST(round(similarity, 6) AS DOUBLE) AS similarity FROM T WHERE pi IS NOT NULL"""


@query(_GREEDY_SQL)
def event_greedy_match(spark, d):
    return _told(assignment.match(*matched_events(spark, d)))


@query(_GREEDY_SQL)
def event_greedy_rounds(spark, d):
    """The same by rounds of proposals only, as for articles of very many events."""
    return _told(assignment.match(*matched_events(spark, d), most_pairs=0))


_MATCHED_SQL = f"""M AS (SELECT CAST(article_id[6:] AS BIGINT) AS user_id, gold_index AS gi, pred_index AS pi FROM ({_GREEDY_SQL})),
GE AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS gi FROM EV WHERE event_id % 2 = 0),
PE AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pi FROM EV WHERE event_id % 2 = 1 AND user_id IN (SELECT user_id FROM EV WHERE event_id % 2 = 0))"""


@query(f"""WITH {EV_SQL}, {_MATCHED_SQL}, R AS ({_GREEDY_SQL}),
X AS (SELECT g.event_type = p.event_type AS t, g.event_date = p.event_date AS d, g.k = p.k AS l, g.props = p.props AS e FROM M JOIN GE g ON M.user_id = g.user_id AND M.gi = g.gi JOIN PE p ON M.user_id = p.user_id AND M.pi = p.pi)
SELECT count(*) AS matched_event_count, round(avg(CAST(t AS INTEGER)), 9) AS event_type_accuracy, round(avg(CAST(d AS INTEGER)), 9) AS event_date_accuracy, CAST(1.0 AS DOUBLE) AS date_precision_accuracy, round(avg(CAST(l AS INTEGER)), 9) AS location_accuracy,
round(avg(CAST(e AS INTEGER)), 9) AS evidence_exact_match_rate, round(avg(CAST(e AS INTEGER)), 9) AS evidence_fuzzy_match_rate, (SELECT round(avg(similarity), 5) FROM R) AS mean_match_similarity FROM X""")
def matched_field_metrics(spark, d):
    found = scoring.field_metrics(scoring.matched_pairs(matched_users(spark, d)))
    return found.select(*[F.round(c, 5 if c.startswith("mean") else 9).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@query(f"""WITH {EV_SQL}, {_MATCHED_SQL},
X AS (SELECT 'missed_event' AS error_type FROM GE ANTI JOIN M USING (user_id, gi) UNION ALL SELECT 'extra_event' FROM PE ANTI JOIN M USING (user_id, pi)
  UNION ALL SELECT 'matched_event_field_mismatch' FROM M JOIN GE g ON M.user_id = g.user_id AND M.gi = g.gi JOIN PE p ON M.user_id = p.user_id AND M.pi = p.pi
  WHERE g.event_type <> p.event_type OR g.event_date <> p.event_date OR g.k <> p.k OR g.props <> p.props)
SELECT error_type, count(*) AS count FROM X GROUP BY error_type""")
def error_type_counts(spark, d):
    rows = event_rows(spark, d)
    matched = errors.matched_articles(event_records(rows.where("event_id % 2 = 0")), event_records(rows.where("event_id % 2 = 1")))
    return errors.error_counts(errors.event_errors(matched))


@query(f"""WITH {EV_SQL}, {_MATCHED_SQL},
X AS (SELECT M.user_id, count(*) AS matched, CAST(sum(CASE WHEN g.k % 7 <> p.k % 7 THEN 2 ELSE 0 END + CASE WHEN g.k <> p.k THEN 2 ELSE 0 END) AS BIGINT) AS people, count(*) FILTER (WHERE g.k <> p.k) AS moved
  FROM M JOIN GE g ON M.user_id = g.user_id AND M.gi = g.gi JOIN PE p ON M.user_id = p.user_id AND M.pi = p.pi GROUP BY M.user_id),
Y AS (SELECT user_id, coalesce(any_value(matched), 0) AS matched, coalesce(any_value(people), 0) AS people, coalesce(any_value(moved), 0) AS moved, count(*) AS golds, (SELECT count(*) FROM PE WHERE PE.user_id = GE.user_id) AS preds FROM GE LEFT JOIN X USING (user_id) GROUP BY user_id)
SELECT 'user:' || user_id AS article_id, CAST(golds - matched AS INTEGER) AS missed_events, CAST(preds - matched AS INTEGER) AS extra_events, people AS participant_errors, golds + preds - matched + moved AS geocoding_errors
FROM Y ORDER BY golds + preds - 2 * matched + people DESC, geocoding_errors DESC, user_id LIMIT 10""")
def worst_articles_top10(spark, d):
    """The articles with most errors; the limit is the feature."""
    rows = event_rows(spark, d)
    tables = errors.analyse(event_records(rows.where("event_id % 2 = 0")), event_records(rows.where("event_id % 2 = 1")))
    return errors.worst_articles(tables["articles"]).select("article_id", "missed_events", "extra_events", "participant_errors", "geocoding_errors")


_DECISIONS = ("gold_correct", "merge_needed", "hybrid_better", "both_correct", "both_wrong", "uncertain")


@query(f"""WITH {EV_SQL}, X AS (SELECT CASE k % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'missed_gold' ELSE 'extra_hybrid' END AS status, CASE event_id % 6 WHEN 0 THEN 'gold_correct' WHEN 1 THEN 'merge_needed' WHEN 2 THEN 'hybrid_better' WHEN 3 THEN 'both_correct' WHEN 4 THEN 'both_wrong' ELSE 'uncertain' END AS decision FROM EV),
Y AS (SELECT *, CASE WHEN decision IN ('both_wrong', 'uncertain') THEN 'dropped' WHEN status = 'matched' THEN CASE WHEN decision IN ('gold_correct', 'merge_needed') THEN 'gold' ELSE 'hybrid' END
WHEN status = 'missed_gold' THEN CASE WHEN decision = 'hybrid_better' THEN 'dropped' ELSE 'gold' END ELSE CASE WHEN decision = 'gold_correct' THEN 'dropped' ELSE 'hybrid' END END AS source FROM X)
SELECT status, source, count(*) AS n FROM Y GROUP BY status, source""")
def adjudicate_rules(spark, d):
    rows = event_rows(spark, d).select(F.get(F.array(*map(F.lit, adjudicate.RULES)), (F.col("k") % 3)).alias("status"), F.get(F.array(*map(F.lit, _DECISIONS)), (F.col("event_id") % 6).cast("int")).alias("decision"))
    return rows.withColumn("source", adjudicate.rule_of(F.col("status"), F.col("decision"))).groupBy("status", "source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV_SQL} SELECT article_id, 'needs_human_review' AS annotation_status, count(*) AS events FROM EV GROUP BY article_id")
def candidate_projection(spark, d):
    return candidates.candidates(event_records(event_rows(spark, d))).select("article_id", "annotation_status", F.size("events").cast("long").alias("events"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_predictions(spark, d):
    ids = lambda name: table(spark, d, name).select(F.col("doc_id").alias("article_id")).distinct().withColumn("rec_ord", F.col("article_id"))
    return scoring.missing_articles(ids("documents"), ids("labels")).select(F.col("article_id").alias("doc_id"))


@query()
def representative_selection(spark, d):
    """A bounded selection by nature; tested against a plain loop."""
    return candidates.representative(event_records(event_rows(spark, d)), 5)


def _conversation_events(spark, d):
    role = F.when(F.col("role") == "user", "initiator").when(F.col("role") == "assistant", "target").otherwise("affected_location")
    person = F.struct(F.concat("role", F.lit(" "), (F.col("turn") % 3).cast("string")).alias("name"), F.lit("NonStateActor").alias("type"), role.alias("role"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", person.alias("p")))).alias("x"))
    return rows.select("conv_id", relations.normal_participants(F.transform("x", lambda x: x["p"])).alias("people"))


def _pairs_sql(target: str) -> str:
    return f"""WITH p AS (SELECT DISTINCT conv_id, role || ' ' || CAST(turn % 3 AS VARCHAR) AS name, CASE role WHEN 'user' THEN 'initiator' WHEN 'assistant' THEN 'target' ELSE 'affected_location' END AS r FROM conversations),
h AS (SELECT conv_id, count(*) FILTER (WHERE r = 'target') AS targets FROM p GROUP BY conv_id)
SELECT a.conv_id, a.name AS source, b.name AS target, 'ATTACKED' AS type FROM p a JOIN p b ON a.conv_id = b.conv_id JOIN h ON a.conv_id = h.conv_id WHERE a.r = 'initiator' AND ({target}) AND a.name <> b.name"""


@query(_pairs_sql("b.r = CASE WHEN h.targets > 0 THEN 'target' ELSE 'affected_location' END"))
def role_pairs_priority(spark, d):
    rows = _conversation_events(spark, d).select("conv_id", F.explode(relations.built_relations(F.lit("AttackEvent"), F.col("people"), F.lit("x"))).alias("r"))
    return rows.select("conv_id", "r.source", "r.target", "r.type")


@query(_pairs_sql("b.r IN ('target', 'affected_location')"))
def role_pairs_union(spark, d):
    rows = _conversation_events(spark, d).select("conv_id", F.explode(relations.built_relations(F.lit("AttackEvent"), F.col("people"), F.lit("x"), union=True)).alias("r"))
    return rows.select("conv_id", "r.source", "r.target", "r.type")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def code_fence_json(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" Done.")))
    return table(spark, d, "events").select("event_id", F.get_json_object(text.json_object(raw), "$.k").cast("int").alias("k"))


def _articles(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("rec_ord"), F.col("doc_id").alias("article_id"))


def _labelled(spark, d, condition: str) -> DataFrame:
    return table(spark, d, "labels").where(condition).select(F.col("doc_id").alias("article_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_anti_join(spark, d):
    return extract.selected(_articles(spark, d), done=_labelled(spark, d, "quality = 1")).select(F.col("article_id").alias("doc_id"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY doc_id LIMIT 20")
def id_filter_limit(spark, d):
    """The first 20 of the articles asked for; the limit is the feature."""
    return extract.selected(_articles(spark, d), _labelled(spark, d, "toxic = 1"), 20).select(F.col("article_id").alias("doc_id"))


@query(f"WITH {EV_SQL} SELECT 'event_type_counts' AS kind, event_type AS label, count(*) AS count FROM EV GROUP BY event_type UNION ALL SELECT 'cleaned_record_count', NULL, count(DISTINCT user_id) FROM EV UNION ALL SELECT 'cleaned_event_count', NULL, count(*) FROM EV")
def postprocess_summary(spark, d):
    records = event_records(event_rows(spark, d))
    flat = geocode.flatten_events(records)
    nowhere = spark.createDataFrame([], f"review_flags {schemas.FLAGS}")
    return geocode.summary(records, flat, nowhere).where("kind NOT LIKE '%location%'")


@query("""WITH s AS (SELECT 'NationState:' || lower(replace(n_name, '_', '-')) AS id FROM nation), h AS (SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(id, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: (a * 31 + c) & 4294967295) AS h FROM s),
q AS (SELECT id, (h % 360) * pi() / 180 AS angle, CAST(floor((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) / 256.0) AS BIGINT) AS f FROM h)
SELECT id, round(sin(angle) * (1.8 + (f % 120) / 100.0), 9) AS lat, round(cos(angle) * (1.8 + (f % 120) / 100.0), 9) AS lon FROM q""")
def deterministic_offset(spark, d):
    o = coords.offset(text.node_id("n_name", F.lit("NationState")))
    return table(spark, d, "nation").select(text.node_id("n_name", F.lit("NationState")).alias("id"), F.round(o["latitude"], 9).alias("lat"), F.round(o["longitude"], 9).alias("lon"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def date_normalise(spark, d):
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))
    return table(spark, d, "orders").select("o_orderkey", dates.iso_date(iso).alias("day"), dates.event_date(F.date_format("o_orderdate", " yyyy-MM ")).alias("month"))


@query(f"WITH {EV_SQL} SELECT CAST(event_id AS VARCHAR) AS id, CAST(floor(confidence * 100 + 0.5) AS BIGINT)::VARCHAR || '%' AS label, CASE WHEN confidence >= 0.8 THEN 'High confidence' WHEN confidence >= 0.55 THEN 'Medium confidence' ELSE 'Low confidence' END AS level, replace(event_type, 'Event', ' Event') AS kind FROM EV")
def confidence_labels(spark, d):
    e = F.col("e")
    return event_rows(spark, d).select(e["event_id"].alias("id"), views.confidence_label(e["confidence"]).alias("label"), views.confidence_level(e["confidence"]).alias("level"), views.event_type_label(e["event_type"]).alias("kind"))


@query("""WITH w AS (SELECT a.doc_id AS a, b.doc_id AS b, list_distinct(string_split(replace(lower(trim(regexp_replace(a.text, '[ \\t\\n\\r]+', ' ', 'g'))), 'ß', 'ss'), ' ')) AS x, list_distinct(string_split(replace(lower(trim(regexp_replace(b.text, '[ \\t\\n\\r]+', ' ', 'g'))), 'ß', 'ss'), ' ')) AS y
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) AS jaccard FROM w""".replace("\\\\", "\\"))
def word_jaccard(spark, d):
    """Word similarity of each document and the next, as evidence is compared."""
    docs = table(spark, d, "documents").select("doc_id", F.array_distinct(F.split(text.norm("text"), " ")).alias("x"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b"), F.col("x").alias("y"))
    return docs.join(other, "doc_id").select(F.col("doc_id").alias("a"), "b", F.round(arrays.jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


@query("SELECT user_id AS source, event_type AS type, count(*) AS weight, strftime(min(ts), '%Y-%m-%d') AS first_seen FROM events GROUP BY user_id, event_type")
def stream_edge_counts(spark, d):
    """The streaming edge counts, over what is in the folder now."""
    import uuid

    from tempora.streaming import edges
    from tempora.tables import shared_dir

    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    rows = rows.select("event_id", "ts", F.col("user_id").alias("source"), F.col("event_type").alias("type"), F.lit("site").alias("target"))
    found = edges.run(edges.edge_counts(rows), f"{shared_dir(spark)}/edge-counts-{uuid.uuid4().hex}")
    return found.select("source", "type", "weight", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"))


@query(f"""WITH {R_SQL}, {E_SQL}, B AS (SELECT name, min(rec_ord) AS born FROM E WHERE type = 'NationState' GROUP BY name)
SELECT s || '|' || N.type || '|' || t AS id, count(*) AS weight, min(day) AS first_seen FROM N JOIN B bs ON source = bs.name JOIN B bt ON target = bt.name WHERE bs.born <= rec_ord AND bt.born <= rec_ord GROUP BY s, N.type, t""")
def stream_relations(spark, d):
    """Relations as a stream of several batches, accepted when an earlier record has named both ends."""
    import uuid

    from tempora.streaming import links
    from tempora.tables import shared_dir

    none, path = F.lit(None).cast("string"), f"{shared_dir(spark)}/links-{uuid.uuid4().hex}"
    files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = entity_view(spark, d).where("type = 'NationState'").select("rec_ord", "i", F.lit(True).alias("mention"), "name", none.alias("source"), none.alias("target"), F.col("type").alias("kind"), "article_id", "day")
    said = relation_view(spark, d).select("rec_ord", "i", F.lit(False).alias("mention"), none.alias("name"), "source", "target", F.col("type").alias("kind"), "article_id", "day")
    named.unionByName(said).select(F.col("rec_ord").cast("long").alias("rec_ord"), F.col("i").cast("int").alias("i"), "mention", "name", "source", "target", "kind", "article_id", "day").repartitionByRange(files, "rec_ord").write.parquet(f"{path}/rows")
    found = links.accepted(spark, f"{path}/rows", path, files_per_trigger=-(-files // 2))
    return found.groupBy(F.col("edge_id").alias("id")).agg(F.count(F.lit(1)).alias("weight"), F.min("day").alias("first_seen"))


from tempora.plans import record_queries  # noqa: E402, F401  (registers its queries here)
