"""Adjudication: review decisions pick gold or predicted events and make new gold records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora import ontology, schemas
from tempora.functions.arrays import first_by, ordered, safe
from tempora.functions.lookup import at
from tempora.functions.text import norm
from tempora.operators.clean import relation_identity
from tempora.operators.matching import paired_records

#: What each decision takes, by status: matched, missed_gold, extra_hybrid.
RULES = {
    "matched": {"gold_correct": "gold", "merge_needed": "gold", "hybrid_better": "hybrid", "both_correct": "hybrid", "both_wrong": "dropped", "uncertain": "dropped"},
    "missed_gold": {"gold_correct": "gold", "merge_needed": "gold", "hybrid_better": "dropped", "both_correct": "gold", "both_wrong": "dropped", "uncertain": "dropped"},
    "extra_hybrid": {"gold_correct": "dropped", "merge_needed": "hybrid", "hybrid_better": "hybrid", "both_correct": "hybrid", "both_wrong": "dropped", "uncertain": "dropped"},
}
NOTES = ("Adjudicated from the reviewed workbook.", "Review decisions were applied by rule; see the adjudication summary.")
REQUIRED = ("article_id", "status", "gold_index", "hybrid_index", "review_decision")


def rule_of(status: Column, decision: Column) -> Column:
    """gold, hybrid or dropped; null if there is no such rule."""
    table = F.create_map(*[F.lit(x) for s, row in RULES.items() for d, v in row.items() for x in (f"{s}:{d}", v)])
    return F.try_element_at(table, F.concat_ws(":", status, decision))


def check_review(rows: DataFrame) -> None:
    """Raises ValueError for an empty table, missing columns, blank or unknown decisions (the first 20 row numbers)."""
    missing = sorted(set(REQUIRED) - set(rows.columns))
    if missing:
        raise ValueError(f"review table lacks columns: {', '.join(missing)}")
    said = F.trim(F.coalesce("review_decision", F.lit("")))
    known = list(RULES["matched"])
    c = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(said == "").alias("blank"), F.count_if(rule_of(F.trim("status"), said).isNull()).alias("bad")).first()
    if not c["n"]:
        raise ValueError("review table has no rows")
    if c["blank"]:
        at_rows = [r["rec_ord"] for r in rows.where(said == "").orderBy("rec_ord").limit(20).collect()]
        raise ValueError(f"review rows without a decision: {at_rows}")
    if c["bad"]:
        odd = sorted({r["d"] for r in rows.where(rule_of(F.trim("status"), said).isNull()).select(F.concat_ws(":", "status", said).alias("d")).distinct().limit(20).collect()})
        raise ValueError(f"unknown status or decision: {', '.join(odd)} (decisions are {', '.join(known)})")


def parse_index(x: Column | str) -> Column:
    """Whole number of a cell that may hold text or a float."""
    return F.nullif(F.trim(F.col(x).cast("string") if isinstance(x, str) else x.cast("string")), F.lit("")).try_cast("double").cast("int")


def project_event(e: Column) -> Column:
    """An event with whole participants and relations, and defaults."""
    people = F.filter(safe(e["participants"]), lambda p: (p["name"] != "") & (p["type"] != "") & (p["role"] != ""))
    links = F.filter(safe(e["relations"]), lambda r: (r["source"] != "") & (r["target"] != "") & (r["type"] != ""))
    return F.struct(
        F.lit(None).cast("string").alias("event_id"), e["event_type"].alias("event_type"), e["event_date"].alias("event_date"), e["date_precision"].alias("date_precision"), F.coalesce(e["location"], F.lit("")).alias("location"),
        people.alias("participants"), links.alias("relations"), e["summary"].alias("summary"), e["evidence"].alias("evidence"), F.coalesce(e["confidence"], F.lit(1.0)).alias("confidence"),
        F.lit(None).cast("string").alias("review_status"), F.lit(None).cast(schemas.FLAGS).alias("review_flags"), e["location_geocode"].alias("location_geocode"),
    )


def known_entities(g: Column, p: Column) -> Column:
    """array of struct(key, type, entity) of both records: entities, then each event's participants and location; gold first."""
    item = "array<struct<key:string,type:string,entity:struct<name:string,type:string,aliases:array<string>>>>"

    def one(name, kind, aliases):
        return F.struct(norm(name).alias("key"), kind.alias("type"), F.struct(name.alias("name"), kind.alias("type"), aliases.alias("aliases")).alias("entity"))

    none = F.array().cast("array<string>")

    def of(r):
        entities = F.transform(F.filter(safe(r["entities"]), lambda x: x["name"].isNotNull() & x["type"].isin(*ontology.ENTITY_TYPES)), lambda x: one(x["name"], x["type"], F.coalesce(x["aliases"], none)))
        events = F.transform(safe(r["events"]), lambda e: F.concat(
            F.transform(F.filter(safe(e["participants"]), lambda q: (q["name"] != "") & (q["type"] != "") & (q["role"] != "")), lambda q: one(q["name"], q["type"], none)),
            F.when(F.coalesce(e["location"], F.lit("")) != "", F.array(one(e["location"], F.lit("StrategicLocation"), none))).otherwise(F.array().cast(item)),
        ))
        return F.concat(entities.cast(item), F.flatten(events).cast(item))

    return F.concat(of(g), of(p))


def entities_of(events: Column, known: Column) -> Column:
    """Entities that the events name, in order of first mention, as the records know them."""
    by_key = F.map_from_entries(F.transform(first_by(known, lambda x: x["key"]), lambda x: F.struct(x["key"], x["type"])))
    type_of = lambda name, said: F.when(said.isin(*ontology.ENTITY_TYPES), said).otherwise(at(by_key, norm(name)))
    ask = lambda name, said: F.struct(name.alias("name"), type_of(name, said).alias("type"))
    none = F.lit(None).cast("string")
    asked = F.flatten(F.transform(events, lambda e: F.concat(
        F.transform(e["participants"], lambda q: ask(q["name"], q["type"])),
        F.filter(F.array(ask(e["location"], F.coalesce(at(by_key, norm(e["location"])), F.lit("StrategicLocation")))), lambda x: x["name"] != ""),
        F.flatten(F.transform(e["relations"], lambda r: F.array(ask(r["source"], none), ask(r["target"], none)))),
    )))
    named = F.filter(asked, lambda x: (x["name"] != "") & x["type"].isin(*ontology.ENTITY_TYPES))
    named = first_by(named, lambda x: F.struct(norm(x["name"]), x["type"]))
    plain = lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), F.array().cast("array<string>").alias("aliases"))
    template = lambda x: F.get(F.filter(known, lambda k: (k["key"] == norm(x["name"])) & (k["type"] == x["type"])), 0)["entity"]
    return F.transform(named, lambda x: F.coalesce(template(x), plain(x)))


def adjudicate(review: DataFrame, gold: DataFrame, predictions: DataFrame) -> dict[str, DataFrame]:
    """records (new gold), and counts (kind, label, count) of sources, decisions and statuses with decisions.

    Raises if a decision asks for an event that the article doesn't have.
    """
    check_review(review)
    cells = review.select(F.col("article_id").cast("string").alias("article_id"), "rec_ord", F.trim("status").alias("status"), F.trim("review_decision").alias("decision"), parse_index("gold_index").alias("gold_index"), parse_index("hybrid_index").alias("hybrid_index"))
    cells = cells.withColumn("source", rule_of(F.col("status"), F.col("decision")))
    by_article = cells.groupBy("article_id").agg(F.collect_list(F.struct(F.col("rec_ord").alias("ord"), F.struct("source", "gold_index", "hybrid_index").alias("v"))).alias("rows"))
    pairs = paired_records(gold, predictions).join(by_article, F.col("g.article_id") == by_article["article_id"], "left").drop("article_id")

    def pick(x):
        index = F.when(x["source"] == "gold", x["gold_index"]).otherwise(x["hybrid_index"])
        event = F.when(x["source"] == "gold", F.get(safe("g.events"), index)).otherwise(F.get(safe("p.events"), index))
        return F.coalesce(event, F.raise_error(F.concat(F.lit("no such event for article "), F.col("g.article_id"))).cast(schemas.EVENT))

    chosen = F.transform(F.filter(ordered(safe(F.col("rows"))), lambda x: x["source"] != "dropped"), lambda x: project_event(pick(x)))
    out = pairs.withColumn("events", chosen.cast(f"array<{schemas.EVENT}>")).withColumn("known", known_entities(F.col("g"), F.col("p")))
    first = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    links = first_by(F.flatten(F.transform("events", lambda e: e["relations"])), relation_identity)
    records = out.select(
        F.col("g.rec_ord").alias("rec_ord"), F.col("g.article_id").alias("article_id"), first("g.title", "p.title").alias("title"), first("g.source", "p.source").alias("source"), first("g.source_url", "p.source_url", "p.url").alias("source_url"),
        first("g.published_at", "p.published_at").alias("published_at"), F.lit("gold").alias("annotation_status"), F.concat(safe("g.annotation_notes"), F.array(*map(F.lit, NOTES))).alias("annotation_notes"),
        entities_of(F.col("events"), F.col("known")).alias("entities"), links.alias("relations"), "events",
    )
    used = cells.join(gold.select("article_id").distinct(), "article_id", "left_semi")
    parts = [used.groupBy(label.alias("label")).count().select(F.lit(kind).alias("kind"), "label", "count") for kind, label in (("source", F.col("source")), ("decision", F.col("decision")), ("status_decision", F.concat_ws(":", "status", "decision")))]
    return {"records": records, "counts": parts[0].unionByName(parts[1]).unionByName(parts[2])}
