"""Error analysis of predictions against gold: six tables of errors and a summary by article.

Matching is done once; each table is a projection of the matched articles, whose events are arrays of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.arrays import last_by, let, safe
from tempora.functions.text import fuzzy_match, norm, norm_date, number
from tempora.operators import matching as m
from tempora.tables import spool

_text = lambda c: F.coalesce(c.cast("string"), F.lit(""))


def only_in(left: Column, right: Column, key) -> Column:
    """Elements of `left` whose key `right` lacks, the last of equal keys, in order of their keys."""
    keyed = F.transform(safe(left), lambda x: F.struct(key(x).alias("ord"), x.alias("v")))
    own = let(m.keys(right, key), lambda known: F.filter(keyed, lambda x: x["ord"].isNotNull() & ~F.array_contains(known, x["ord"])))
    return F.transform(F.array_sort(last_by(own, lambda x: x["ord"])), lambda x: x["v"])


def mismatches(gold: Column, pred: Column) -> Column:
    """Names of the fields in which a matched pair differs."""
    evidence = F.when(fuzzy_match(gold["evidence"], pred["evidence"]), "evidence_fuzzy_match").otherwise("evidence_mismatch")
    return F.array_compact(F.array(
        F.when(~gold["event_type"].eqNullSafe(pred["event_type"]), "event_type"), F.when(norm_date(gold["event_date"]) != norm_date(pred["event_date"]), "event_date"),
        F.when(~gold["date_precision"].eqNullSafe(pred["date_precision"]), "date_precision"), F.when(norm(gold["location"]) != norm(pred["location"]), "location"),
        F.when(norm(gold["evidence"]) != norm(pred["evidence"]), evidence),
    ))


def unmatched(matched: DataFrame) -> DataFrame:
    """`matched` with missed and extra: struct(index, event) of gold and predicted events without a partner."""
    gone = lambda side: F.transform("matches", lambda x: x[side])
    rest = lambda events, side: F.filter(F.transform(safe(events), lambda e, i: F.struct(i.alias("index"), e.alias("event"))), lambda x: ~F.array_contains(gone(side), x["index"]))
    return matched.withColumn("missed", rest("g.events", "gold_index")).withColumn("extra", rest("p.events", "pred_index"))


def matched_articles(gold: DataFrame, predictions: DataFrame, threshold: float = m.THRESHOLD, scores: bool = False) -> DataFrame:
    """Matched articles with their unmatched events, kept as a table, since several tables follow from it; with `scores`, those of all pairs of events, too."""
    matched = m.match_articles(m.paired_records(gold, predictions), threshold)
    return spool(unmatched(spool(matched if scores else matched.drop("scores"), "matches")), "matched")


def pair_structs() -> Column:
    """The matches with both events."""
    return F.transform("matches", lambda x: F.struct(x["gold_index"].alias("gold_index"), x["pred_index"].alias("pred_index"), x["similarity"].alias("similarity"), F.get("g.events", x["gold_index"]).alias("gold"), F.get("p.events", x["pred_index"]).alias("pred")))


def coordinates_of(e: Column) -> Column:
    """struct(latitude, longitude) of an event's geocode."""
    return F.struct(e["location_geocode"]["latitude"].alias("latitude"), e["location_geocode"]["longitude"].alias("longitude"))


def has_coordinates(e: Column) -> Column:
    c = coordinates_of(e)
    return c["latitude"].isNotNull() & c["longitude"].isNotNull()


def coordinates_label(e: Column) -> Column:
    c = coordinates_of(e)
    return F.when(has_coordinates(e), F.concat(c["latitude"].cast("string"), F.lit(", "), c["longitude"].cast("string"))).otherwise("")


def _rows(matched: DataFrame, items: Column) -> DataFrame:
    return matched.select(F.col("g.rec_ord").alias("rec_ord"), F.col("g.article_id").alias("article_id"), _text(F.col("g.title")).alias("title"), F.posexplode(items).alias("i", "x"))


def item_errors(matched: DataFrame, items: str, key, noun: str) -> DataFrame:
    """missing_* then extra_* rows of entities or relations, in order of key."""
    gold, pred = F.col(f"g.{items}"), F.col(f"p.{items}")
    parts = []
    for turn, (a, b, prefix, notes) in enumerate(((gold, pred, "missing", f"Gold {noun} was not present in prediction."), (pred, gold, "extra", f"Prediction {noun} was not present in gold."))):
        rows = _rows(matched, only_in(a, b, key)).withColumns({"turn": F.lit(turn), "error_type": F.lit(f"{prefix}_{noun}"), "notes": F.lit(notes)})
        parts.append(rows)
    out = parts[0].unionByName(parts[1])
    fields = ["name", "type"] if noun == "entity" else ["source", "target", "type", "evidence"]
    return out.select("rec_ord", "turn", "i", "article_id", "title", "error_type", *[F.col(f"x.{f}").alias(f) for f in fields], "notes")


def event_errors(matched: DataFrame) -> DataFrame:
    """missed, extra, and matched events that differ."""
    nothing = F.lit(None)
    cell = lambda e, f: _text(e[f])

    def table(turn, rows, kind, gi, pi, sim, g, p, details):
        fields = [F.lit("") if e is None else cell(e, f) for f in ("event_type", "event_date", "location", "summary", "evidence") for e in (g, p)]
        names = [f"{side}_{f}" for f in ("event_type", "event_date", "location", "summary", "evidence") for side in ("gold", "pred")]
        return rows.select("rec_ord", F.lit(turn).alias("turn"), "i", "article_id", "title", F.lit(kind).alias("error_type"), gi.cast("int").alias("gold_index"), pi.cast("int").alias("pred_index"), sim.alias("similarity"), *[c.alias(n) for c, n in zip(fields, names)], details.alias("issue_details"))

    x = F.col("x")
    missed = table(0, _rows(matched, F.col("missed")), "missed_event", x["index"], nothing, F.lit(""), x["event"], None, F.lit("Gold event had no matching prediction."))
    extra = table(1, _rows(matched, F.col("extra")), "extra_event", nothing, x["index"], F.lit(""), None, x["event"], F.lit("Prediction event had no matching gold event."))
    pairs = _rows(matched, pair_structs()).withColumn("issues", mismatches(x["gold"], x["pred"])).where(F.size("issues") > 0)
    differ = table(2, pairs, "matched_event_field_mismatch", x["gold_index"], x["pred_index"], number(x["similarity"]), x["gold"], x["pred"], F.array_join("issues", "; "))
    return missed.unionByName(extra).unionByName(differ)


def same_entity(item: Column, others: Column) -> Column:
    """The last of `others` with the item's name and type, whatever its role."""
    return F.element_at(F.filter(safe(others), lambda o: (norm(o["name"]) == norm(item["name"])) & o["type"].eqNullSafe(item["type"])), -1)


def participant_errors(matched: DataFrame) -> DataFrame:
    """Missing participants or roles of matched pairs, then extra ones unless gold has them in another role."""
    x = F.col("x")
    rows = _rows(matched, pair_structs()).withColumnRenamed("i", "pair")
    other = lambda item, others: F.when(F.exists(safe(others), lambda o: (norm(o["name"]) == norm(item["name"])) & o["type"].eqNullSafe(item["type"])), same_entity(item, others))
    base = ["rec_ord", "pair", "article_id", "title", x["gold_index"].alias("gold_index"), x["pred_index"].alias("pred_index"), x["gold"]["event_type"].alias("event_type")]
    lost = rows.select(*base, F.posexplode(only_in(x["gold"]["participants"], x["pred"]["participants"], m.participant_key)).alias("i", "item"), x["pred"]["participants"].alias("others"))
    lost = lost.withColumn("same", other(F.col("item"), F.col("others"))).select(*[c if isinstance(c, str) else F.col(n) for c, n in zip(base, ["rec_ord", "pair", "article_id", "title", "gold_index", "pred_index", "event_type"])], F.lit(0).alias("turn"), "i", F.when(F.col("same").isNull(), "missing_participant").otherwise("role_mismatch").alias("error_type"), F.col("item").alias("gold_participant"), F.col("same").alias("pred_participant"))
    more = rows.select(*base, F.posexplode(only_in(x["pred"]["participants"], x["gold"]["participants"], m.participant_key)).alias("i", "item"), x["gold"]["participants"].alias("others"))
    more = more.where(other(F.col("item"), F.col("others")).isNull()).select("rec_ord", "pair", "article_id", "title", "gold_index", "pred_index", "event_type", F.lit(1).alias("turn"), "i", F.lit("extra_participant").alias("error_type"), F.lit(None).cast("struct<name:string,type:string,role:string>").alias("gold_participant"), F.col("item").alias("pred_participant"))
    out = lost.unionByName(more)
    side = lambda s: [F.coalesce(F.col(f"{s}_participant.{f}"), F.lit("")).alias(f"{s}_{f}") for f in ("name", "type", "role")]
    return out.select("rec_ord", "pair", "turn", "i", "article_id", "title", "error_type", "gold_index", "pred_index", "event_type", *side("gold"), *side("pred"))


def event_relation_errors(matched: DataFrame) -> DataFrame:
    """Relations of matched pairs that one side lacks."""
    x = F.col("x")
    rows = _rows(matched, pair_structs()).withColumnRenamed("i", "pair")
    parts = []
    for turn, (a, b, kind) in enumerate((("gold", "pred", "missing_event_relation"), ("pred", "gold", "extra_event_relation"))):
        found = rows.select("rec_ord", "pair", F.lit(turn).alias("turn"), "article_id", "title", F.lit(kind).alias("error_type"), x["gold_index"].alias("gold_index"), x["pred_index"].alias("pred_index"), F.posexplode(only_in(x[a]["relations"], x[b]["relations"], m.relation_key)).alias("i", "r"))
        parts.append(found.select("rec_ord", "pair", "turn", "i", "article_id", "title", "error_type", "gold_index", "pred_index", "r.source", "r.target", "r.type"))
    return parts[0].unionByName(parts[1])


def geocoding_errors(matched: DataFrame) -> DataFrame:
    """Locations lost, changed or without coordinates."""
    x = F.col("x")
    blank = F.lit("")

    def table(turn, rows, kind, g, p):
        cell = lambda e, f: blank if e is None else _text(e[f])
        label = lambda e: blank if e is None else coordinates_label(e)
        return rows.select("rec_ord", F.lit(turn).alias("turn"), "i", "article_id", "title", kind.alias("error_type"), cell(g, "event_type").alias("gold_event_type"), cell(p, "event_type").alias("pred_event_type"), cell(g, "location").alias("gold_location"), cell(p, "location").alias("pred_location"), label(g).alias("gold_coordinates"), label(p).alias("pred_coordinates"), cell(g, "summary").alias("gold_summary"), cell(p, "summary").alias("pred_summary"))

    g, p = x["gold"], x["pred"]
    gl, pl = _text(g["location"]), _text(p["location"])
    kinds = F.array_compact(F.array(
        F.when((gl != "") & (pl == ""), "missing_predicted_location"), F.when((gl != "") & (pl != "") & (norm(gl) != norm(pl)), "location_mismatch"),
        F.when((pl != "") & ~has_coordinates(p), "predicted_location_missing_coordinates"),
    ))
    pairs = _rows(matched, pair_structs()).withColumn("kind", F.explode(kinds))
    missed = _rows(matched, F.col("missed")).where(_text(x["event"]["location"]) != "")
    extra = _rows(matched, F.col("extra")).where((_text(x["event"]["location"]) != "") & ~has_coordinates(x["event"]))
    out = table(0, pairs, F.col("kind"), g, p).unionByName(table(1, missed, F.lit("missed_located_event"), x["event"], None))
    return out.unionByName(table(2, extra, F.lit("extra_located_event_missing_coordinates"), None, x["event"]))


def analyse(gold: DataFrame, predictions: DataFrame, threshold: float = m.THRESHOLD) -> dict[str, DataFrame]:
    """entities, relations, events, participants, event_relations, geocoding, articles (the summary)."""
    matched = matched_articles(gold, predictions, threshold)
    tables = {
        "entities": item_errors(matched, "entities", m.entity_key, "entity"), "relations": item_errors(matched, "relations", m.relation_key, "relation"), "events": event_errors(matched),
        "participants": participant_errors(matched), "event_relations": event_relation_errors(matched), "geocoding": geocoding_errors(matched),
    }
    out = matched.select(F.col("g.rec_ord").alias("rec_ord"), F.col("g.article_id").alias("article_id"), _text(F.col("g.title")).alias("title"), F.size(safe("g.events")).alias("gold_events"), F.size(safe("p.events")).alias("pred_events"), F.size("matches").alias("matched_events"), F.size("missed").alias("missed_events"), F.size("extra").alias("extra_events"))
    for name, column in (("entities", "entity_errors"), ("relations", "relation_errors"), ("participants", "participant_errors"), ("event_relations", "event_relation_errors"), ("geocoding", "geocoding_errors")):
        counts = tables[name].groupBy("article_id").agg(F.count(F.lit(1)).alias(column))
        out = out.join(counts, "article_id", "left").withColumn(column, F.coalesce(column, F.lit(0)))
    return tables | {"articles": out}


def error_counts(table: DataFrame, limit: int | None = None) -> DataFrame:
    """Errors by type, most first, of equal counts the type seen first."""
    ord_ = F.struct(*[c for c in ("rec_ord", "pair", "turn", "i") if c in table.columns])
    out = table.groupBy("error_type").agg(F.count(F.lit(1)).alias("count"), F.min(ord_).alias("first")).orderBy(F.desc("count"), "first").drop("first")
    return out.limit(limit) if limit else out


def worst_articles(articles: DataFrame, limit: int = 10) -> DataFrame:
    """Articles with most event and participant errors, then geocoding errors, then in input order."""
    worst = F.col("missed_events") + F.col("extra_events") + F.col("participant_errors")
    return articles.orderBy(worst.desc(), F.desc("geocoding_errors"), "rec_ord").limit(limit)
