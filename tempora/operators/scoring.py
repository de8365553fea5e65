"""Scores of predictions against gold: precision, recall and F1 by label, field accuracies, coverage of coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.arrays import safe
from tempora.functions.text import fuzzy_match, norm, norm_date
from tempora.operators import matching as m


def check_gold(gold: DataFrame, allow_draft: bool = False) -> None:
    """Raises ValueError if there are no rows, rows whose status isn't `gold`, or rows without an article id."""
    status = F.coalesce("annotation_status", F.lit("")) != "gold"
    c = gold.agg(F.count(F.lit(1)).alias("n"), F.count_if(status).alias("draft"), F.count_if(F.coalesce("article_id", F.lit("")) == "").alias("nameless")).first()
    if not c["n"]:
        raise ValueError("gold has no rows")
    if c["draft"] and not allow_draft:
        ids = [r["article_id"] for r in gold.where(status).select("article_id").orderBy("rec_ord").limit(20).collect()]
        raise ValueError(f"{c['draft']} gold rows are not final: {', '.join(map(str, ids))}")
    if c["nameless"]:
        raise ValueError(f"{c['nameless']} gold rows have no article id")


def prf(counts: DataFrame) -> DataFrame:
    """`counts` (.., tp, fp, fn) with precision, recall and f1; a zero denominator gives 0."""
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    out = counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / both))


def metric_block(gold: DataFrame, pred: DataFrame, metric: str) -> DataFrame:
    """metric, label (null: all), tp, fp, fn, precision, recall, f1 of key sets (key, label); blank labels count in the total only.

    One aggregation by key finds where a key occurs, another counts by label.
    """
    sides = gold.select("key", "label", F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select("key", "label", F.lit(0).alias("g"), F.lit(1).alias("p")))
    where = sides.groupBy("key", "label").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    tp, fp, fn = F.count_if(F.expr("g = 1 AND p = 1")), F.count_if(F.expr("g = 0 AND p = 1")), F.count_if(F.expr("g = 1 AND p = 0"))
    total = where.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).withColumn("label", F.lit(None).cast("string"))
    by_label = where.where("label <> ''").groupBy("label").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return prf(total.unionByName(by_label)).select(F.lit(metric).alias("metric"), "label", "precision", "recall", "f1", "tp", "fp", "fn")


def _flat(pairs: DataFrame, side: str, items: str, key, label: str) -> DataFrame:
    rows = pairs.select(F.col("g.article_id").alias("article_id"), F.explode(m.keys(F.col(f"{side}.{items}"), key)).alias("k"))
    return rows.where("article_id IS NOT NULL").select(F.struct("article_id", "k").alias("key"), F.col(f"k.{label}").alias("label"))


def _nested(pairs: DataFrame, side: str, items: str, key, label: str) -> DataFrame:
    rows = pairs.select(F.col("g.article_id").alias("article_id"), F.explode(safe(f"{side}.events")).alias("e"))
    rows = rows.select("article_id", m.event_anchor(F.col("e")).alias("anchor"), F.explode(m.keys(F.col(f"e.{items}"), key)).alias("k"))
    return rows.where("article_id IS NOT NULL").select(F.struct("article_id", "anchor", "k").alias("key"), F.col(f"k.{label}").alias("label"))


def matched_pairs(matched: DataFrame) -> DataFrame:
    """A row for each matched pair: article_id, title, gold_index, pred_index, similarity, gold_event, pred_event."""
    rows = matched.select(F.col("g.rec_ord").alias("rec_ord"), F.col("g.article_id").alias("article_id"), F.col("g.title").alias("title"), "g", "p", F.explode("matches").alias("m"))
    return rows.select("rec_ord", "article_id", "title", "m.gold_index", "m.pred_index", "m.similarity", F.get("g.events", F.col("m.gold_index")).alias("gold_event"), F.get("p.events", F.col("m.pred_index")).alias("pred_event"))


def same(gold: Column, pred: Column) -> dict[str, Column]:
    """Which fields of a matched pair agree."""
    return {
        "event_type": gold["event_type"].eqNullSafe(pred["event_type"]), "event_date": norm_date(gold["event_date"]) == norm_date(pred["event_date"]), "date_precision": gold["date_precision"].eqNullSafe(pred["date_precision"]),
        "location": norm(gold["location"]) == norm(pred["location"]), "evidence_exact": norm(gold["evidence"]) == norm(pred["evidence"]), "evidence_fuzzy": fuzzy_match(gold["evidence"], pred["evidence"]),
    }


def field_metrics(pairs: DataFrame) -> DataFrame:
    """One row: accuracies of matched pairs' fields, null without a pair."""
    share = lambda c: F.avg(c.cast("double"))
    s = same(F.col("gold_event"), F.col("pred_event"))
    return pairs.agg(
        F.count(F.lit(1)).alias("matched_event_count"), share(s["event_type"]).alias("event_type_accuracy"), share(s["event_date"]).alias("event_date_accuracy"), share(s["date_precision"]).alias("date_precision_accuracy"),
        share(s["location"]).alias("location_accuracy"), share(s["evidence_exact"]).alias("evidence_exact_match_rate"), share(s["evidence_fuzzy"]).alias("evidence_fuzzy_match_rate"), F.avg("similarity").alias("mean_match_similarity"),
    )


def geocode_metrics(pairs: DataFrame) -> DataFrame:
    """One row: located predicted events and how many have coordinates."""
    e = F.col("e")
    rows = pairs.select(F.explode(safe("p.events")).alias("e")).where("e.location <> ''")
    placed = F.count_if(e["location_geocode"]["latitude"].isNotNull() & e["location_geocode"]["longitude"].isNotNull())
    out = rows.agg(F.count(F.lit(1)).alias("located_event_count"), placed.alias("located_event_with_coordinates_count"))
    return out.withColumn("located_event_coordinate_rate", F.try_divide("located_event_with_coordinates_count", "located_event_count"))


def missing_articles(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """rec_ord, article_id of gold rows whose article has no prediction; one without an id has none."""
    return gold.select("rec_ord", "article_id").join(predictions.select("article_id").distinct(), "article_id", "left_anti").select("rec_ord", "article_id")


def score(gold: DataFrame, predictions: DataFrame, allow_draft: bool = False) -> dict[str, DataFrame]:
    """metrics (long form), fields, geocoding, counts and missing of predictions against gold (both with rec_ord)."""
    check_gold(gold, allow_draft)
    pairs = m.match_articles(m.paired_records(gold, predictions))
    blocks = [
        metric_block(_flat(pairs, "g", "entities", m.entity_key, "type"), _flat(pairs, "p", "entities", m.entity_key, "type"), "entities"),
        metric_block(_flat(pairs, "g", "relations", m.relation_key, "type"), _flat(pairs, "p", "relations", m.relation_key, "type"), "relations"),
        metric_block(_flat(pairs, "g", "events", m.event_exact_key, "event_type"), _flat(pairs, "p", "events", m.event_exact_key, "event_type"), "events_exact"),
        metric_block(_nested(pairs, "g", "participants", m.participant_key, "role"), _nested(pairs, "p", "participants", m.participant_key, "role"), "participants"),
        metric_block(_nested(pairs, "g", "relations", m.relation_key, "type"), _nested(pairs, "p", "relations", m.relation_key, "type"), "event_relations"),
    ]
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    counts = pairs.agg(
        F.count(F.lit(1)).alias("gold_article_count"), F.coalesce(F.sum(size(safe("g.events"))), F.lit(0)).alias("gold_event_count"), F.count_if(F.col("p").isNotNull()).alias("article_count_in_scope"),
        F.coalesce(F.sum(size(safe("p.events"))), F.lit(0)).alias("event_count_in_scope"), F.count_if(F.col("p").isNull()).alias("missing_article_count"), F.coalesce(F.sum(F.size("matches")), F.lit(0)).alias("matched"),
    )
    soft = counts.select(F.lit(None).cast("string").alias("label"), F.col("matched").alias("tp"), F.greatest(F.col("event_count_in_scope") - F.col("matched"), F.lit(0)).alias("fp"), F.greatest(F.col("gold_event_count") - F.col("matched"), F.lit(0)).alias("fn"))
    metrics = prf(soft).select(F.lit("events_soft").alias("metric"), "label", "precision", "recall", "f1", "tp", "fp", "fn")
    for block in blocks:
        metrics = metrics.unionByName(block)
    return {"metrics": metrics, "fields": field_metrics(matched_pairs(pairs)), "geocoding": geocode_metrics(pairs), "counts": counts.drop("matched"), "missing": missing_articles(gold, predictions)}
