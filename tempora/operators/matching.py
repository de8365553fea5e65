"""Keys, similarity and greedy one-to-one matching of gold and predicted events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.arrays import let, safe, set_jaccard
from tempora.functions.text import norm, norm_date

THRESHOLD = 0.45
#: More than sums of weights are rounded by.
_SLACK = 1e-9


def entity_key(x: Column) -> Column:
    """struct(name, type), null if one is missing."""
    return F.when((norm(x["name"]) != "") & (F.coalesce(x["type"], F.lit("")) != ""), F.struct(norm(x["name"]).alias("name"), x["type"].alias("type")))


def relation_key(x: Column) -> Column:
    """struct(source, target, type); the evidence doesn't count."""
    ok = (norm(x["source"]) != "") & (norm(x["target"]) != "") & (F.coalesce(x["type"], F.lit("")) != "")
    return F.when(ok, F.struct(norm(x["source"]).alias("source"), norm(x["target"]).alias("target"), x["type"].alias("type")))


def participant_key(x: Column) -> Column:
    """struct(name, type, role)."""
    return F.when((norm(x["name"]) != "") & x["type"].isNotNull() & x["role"].isNotNull(), F.struct(norm(x["name"]).alias("name"), x["type"].alias("type"), x["role"].alias("role")))


def keys(items: Column, key) -> Column:
    """Non-null keys of an array, repeated ones too."""
    return F.filter(F.transform(safe(items), key), lambda k: k.isNotNull())


def event_anchor(e: Column) -> Column:
    return F.struct(e["event_type"].alias("event_type"), norm_date(e["event_date"]).alias("event_date"), norm(e["location"]).alias("location"))


def event_exact_key(e: Column) -> Column:
    """Everything but texts and confidence; participants and relations as sorted lists."""
    key = F.struct(
        e["event_type"].alias("event_type"), norm_date(e["event_date"]).alias("event_date"), e["date_precision"].alias("date_precision"), norm(e["location"]).alias("location"),
        F.array_sort(keys(e["participants"], participant_key)).alias("participants"), F.array_sort(keys(e["relations"], relation_key)).alias("relations"),
    )
    return F.when(F.coalesce(e["event_type"], F.lit("")) != "", key)


def features(e: Column) -> Column:
    """What similarity compares, computed once for each event."""
    return F.struct(
        e["event_type"].alias("event_type"), norm_date(e["event_date"]).alias("event_date"), norm(e["location"]).alias("location"),
        F.array_distinct(keys(e["participants"], participant_key)).alias("participants"), F.array_distinct(keys(e["relations"], relation_key)).alias("relations"),
    )


def similarity(a: Column, b: Column, threshold: float | None = None) -> Column:
    """Of two events' features; the terms are summed in this order, since thresholds are inclusive.

    With a threshold, 0 for events that cannot reach it whatever their participants and relations, which aren't compared.
    """
    one = lambda same: F.when(same, F.lit(1.0)).otherwise(F.lit(0.0))
    out = F.lit(0.30) * one(a["event_type"].eqNullSafe(b["event_type"])) + F.lit(0.18) * one(a["event_date"] == b["event_date"])
    out = out + F.lit(0.12) * one(a["location"] == b["location"])
    whole = out + F.lit(0.20) * set_jaccard(a["participants"], b["participants"]) + F.lit(0.20) * set_jaccard(a["relations"], b["relations"])
    return whole if threshold is None else F.when(out >= threshold - 0.40 - _SLACK, whole).otherwise(F.lit(0.0))


def greedy(scores: Column, threshold: float = THRESHOLD) -> Column:
    """array of struct(gold_index, pred_index, similarity) from scores[gold][pred].

    Gold events in order take the most similar unused prediction, the first of equal ones, if it reaches the threshold
    (and is above 0).
    """
    row = "struct<gold_index:int,pred_index:int,similarity:double>"

    def step(acc, x):
        options = F.transform(x["s"], lambda s, j: F.struct((-s).alias("less"), j.alias("j")))
        near = F.filter(options, lambda o: (-o["less"] >= threshold) & (-o["less"] > 0.0))
        free = let(F.transform(acc, lambda m: m["pred_index"]), lambda used: F.filter(near, lambda o: ~F.array_contains(used, o["j"])))
        add = lambda best: F.concat(acc, F.array(F.struct(x["i"].alias("gold_index"), best["j"].alias("pred_index"), (-best["less"]).alias("similarity")).cast(row)))
        return let(F.array_min(free), lambda best: F.when(best.isNull(), acc).otherwise(add(best)))

    indexed = F.transform(scores, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    return F.aggregate(indexed, F.array().cast(f"array<{row}>"), step)


def paired_records(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold rows (all their columns in a struct `g`) with the last prediction of the same article (`p`, null if there is none)."""
    g = gold.select(F.struct("*").alias("g"))
    last = predictions.where("article_id IS NOT NULL").groupBy("article_id").agg(F.max_by(F.struct(*predictions.columns), "rec_ord").alias("p"))
    return g.join(last, F.col("g.article_id") == last["article_id"], "left").drop("article_id")


def match_articles(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`pairs` with scores (array by gold of arrays by prediction) and matches; an article's events are arrays of one row.

    Matches don't follow from `scores` but from those that matter to the threshold, so a plan that reads only matches
    doesn't compute the others.
    """
    both = F.struct(F.transform(safe("g.events"), features).alias("g"), F.transform(safe("p.events"), features).alias("p"))
    scores = lambda least: let(both, lambda s: F.transform(s["g"], lambda a: F.transform(s["p"], lambda b: similarity(a, b, least))))
    return pairs.select("g", "p", scores(None).alias("scores"), greedy(scores(threshold), threshold).alias("matches"))
