"""Greedy one-to-one matching of gold and predicted events over rows, for articles of any number of events.

Gold events in order take the most similar unused prediction, the first of equal ones. Since every prediction prefers
the earlier gold event, this is the stable matching of gold events that propose in order of similarity to predictions
that keep the earliest proposer, and stable matchings can be found in any order of proposals: in rounds.

Events with equal features are a class; similarities are computed of classes. Pairs of classes come from equal keys: a
threshold can only be reached by pairs that share one of a few sets of features, and each such set is a key. In a round
all free gold events of a class propose at once, the first one to the class's best open prediction, the second to the
next, and so on: a prediction that the first one is sent to would refuse all later ones. A class of n equal events alone
needs one round, not n. Rounds go on while anybody proposes; what is kept can only get earlier, so they end. Their number is
that of the longest chain of displaced events: some ten where few events compete for a prediction, but hundreds for an
article of thousands of events of few kinds, whose classes displace each other one by one.

Articles with few pairs of events are matched inside a row, by `matching.greedy`; their arrays are bounded by MOST_PAIRS.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions.arrays import safe
from tempora.operators.matching import THRESHOLD, features, greedy, similarity
from tempora import tables
from tempora.tables import ranked

#: Pairs of events of an article that is matched inside a row.
MOST_PAIRS = 10_000
#: What equal features add to a similarity at most, as in matching.similarity.
WEIGHTS = {"event_type": 0.30, "event_date": 0.18, "location": 0.12, "participants": 0.20, "relations": 0.20}
_SLACK = 1e-9


def spool(df: DataFrame, name: str) -> DataFrame:
    """A spooled table that joins by a shuffle: files of equal features compress so well that Spark would broadcast millions of rows."""
    return tables.spool(df, name).hint("merge")


def key_sets(threshold: float) -> list[tuple[str, ...]]:
    """The smallest sets of features one of which two events must share to reach the threshold; an empty set if none need be."""
    found: list[tuple[str, ...]] = []
    for n in range(len(WEIGHTS) + 1):
        for names in itertools.combinations(WEIGHTS, n):
            if sum(WEIGHTS[x] for x in names) >= threshold - _SLACK and not any(set(f) <= set(names) for f in found):
                found.append(names)
    return found


def last_events(gold: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (pair, i, f) of gold records and (pair, j, f) of the last prediction of their article; a pair is a gold record's rec_ord."""
    rows = gold.select(F.col("rec_ord").alias("pair"), F.posexplode(safe("events")).alias("i", "e")).select("pair", "i", features(F.col("e")).alias("f"))
    last = predictions.where("article_id IS NOT NULL").groupBy("article_id").agg(F.max("rec_ord").alias("rec_ord"))
    asked = gold.select("article_id", F.col("rec_ord").alias("pair")).join(last, "article_id").select("pair", "rec_ord")
    found = predictions.select("rec_ord", F.posexplode(safe("events")).alias("j", "e")).join(asked, "rec_ord")
    return rows, found.select("pair", "j", features(F.col("e")).alias("f"))


def _classes(rows: DataFrame, place: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the class of their features, classes with their features); a class is named by its first place."""
    sorted_ = F.struct(*[F.array_sort(F.col(f"f.{c}")).alias(c) if c in ("participants", "relations") else F.col(f"f.{c}") for c in WEIGHTS])
    keyed = spool(rows.select("pair", place, sorted_.alias("f")).withColumn("key", F.to_json("f", {"ignoreNullFields": "false"})), "event-features")
    classes = spool(keyed.groupBy("pair", "key").agg(F.first("f").alias("f"), F.min(place).alias("class")), "event-classes")
    return spool(keyed.select("pair", place, "key").join(classes.select("pair", "key", "class"), ["pair", "key"]).select("pair", place, "class"), "classed-events"), classes


def _keys(classes: DataFrame, threshold: float) -> DataFrame:
    """A row for each key of a class."""
    each = []
    for n, names in enumerate(key_sets(threshold)):
        values = [[F.col(f"f.{c}")] if c not in ("participants", "relations") else [] for c in names]
        many = [c for c in names if c in ("participants", "relations")]
        one = classes.select("pair", "class", *[v[0].alias(c) for c, v in zip(names, values) if v], *[F.col(f"f.{c}").alias(f"all_{c}") for c in many])
        for c in many:
            one = one.select("*", F.explode_outer(f"all_{c}").alias(c)).drop(f"all_{c}")  # empty ones equal each other
        each.append(one.select("pair", "class", F.xxhash64(F.lit(n), *names).alias("key")))  # two classes of one hash are compared, too
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.hint("merge")


def similar_classes(gold: DataFrame, predicted: DataFrame, threshold: float) -> DataFrame:
    """pair, g, p, similarity of classes (pair, class, f) of one pair that reach the threshold."""
    left, right = _keys(gold, threshold).withColumnRenamed("class", "g"), _keys(predicted, threshold).withColumnRenamed("class", "p")
    pairs = left.join(right, ["pair", "key"]).select("pair", "g", "p").distinct()
    both = pairs.join(gold.select("pair", F.col("class").alias("g"), F.col("f").alias("a")), ["pair", "g"]).join(predicted.select("pair", F.col("class").alias("p"), F.col("f").alias("b")), ["pair", "p"])
    scored = both.select("pair", "g", "p", similarity(F.col("a"), F.col("b")).alias("similarity"))
    return spool(scored.where((F.col("similarity") >= threshold) & (F.col("similarity") > 0.0)), "similar-classes")


def similar_events(gold: DataFrame, predicted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pair, i, j, similarity of all events (pair, i, f) and (pair, j, f) of one pair that reach the threshold."""
    (g, g_classes), (p, p_classes) = _classes(gold, "i"), _classes(predicted, "j")
    found = similar_classes(g_classes, p_classes, threshold)
    return found.join(g.withColumnRenamed("class", "g"), ["pair", "g"]).join(p.withColumnRenamed("class", "p"), ["pair", "p"]).select("pair", "i", "j", "similarity")


def deferred(gold: DataFrame, predicted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pair, i, j, similarity of the matched events of (pair, i, f) and (pair, j, f), in rounds over rows."""
    spark = gold.sparkSession
    (g, g_classes), (p, p_classes) = _classes(gold, "i"), _classes(predicted, "j")
    found = similar_classes(g_classes, p_classes, threshold)
    options = found.join(p.withColumnRenamed("class", "p"), ["pair", "p"]).select("pair", "g", (-F.col("similarity")).alias("less"), "j")
    options = spool(options, "options")
    seekers = spool(g.withColumnRenamed("class", "g").join(options.select("pair", "g").distinct(), ["pair", "g"], "left_semi"), "seekers")
    kept = spark.createDataFrame([], f"pair {dict(g.dtypes)['pair']}, j {dict(p.dtypes)['j']}, i {dict(g.dtypes)['i']}, less double")
    while True:
        free = spool(seekers.join(kept.select("pair", "i"), ["pair", "i"], "left_anti"), "free")
        first = free.groupBy("pair", "g").agg(F.min("i").alias("first"))
        held = kept.select("pair", "j", F.col("i").alias("holder"))
        # a prediction that an event earlier than all free ones of the class holds is closed to the class
        is_open = F.col("holder").isNull() | (F.col("holder") > F.col("first"))
        open_ = options.join(first, ["pair", "g"]).join(held, ["pair", "j"], "left").where(is_open).select("pair", "g", "less", "j", "holder")
        turns = ranked(open_, ["pair", "g"], ["less", "j"]).join(ranked(free, ["pair", "g"], ["i"]), ["pair", "g", "place"])
        asked = spool(turns.where(F.col("holder").isNull() | (F.col("holder") > F.col("i"))).select("pair", "j", "i", "less"), "proposals")
        if not asked.head(1):
            break
        best = kept.unionByName(asked).groupBy("pair", "j").agg(F.min(F.struct("i", "less")).alias("x"))
        kept = spool(best.select("pair", "j", "x.i", "x.less"), "kept")
    return kept.select("pair", "i", "j", (-F.col("less")).alias("similarity"))


def _inside_rows(gold: DataFrame, predicted: DataFrame, threshold: float) -> DataFrame:
    listed = lambda rows, place, name: rows.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), "f"))).alias(name))
    both = listed(gold, "i", "g").join(listed(predicted, "j", "p"), "pair")
    scores = F.transform("g", lambda a: F.transform("p", lambda b: similarity(a["f"], b["f"], threshold)))
    matched = both.select("pair", "g", "p", scores.alias("scores")).select("pair", "g", "p", F.explode(greedy(F.col("scores"), threshold)).alias("m"))
    return matched.select("pair", F.get("g", F.col("m.gold_index"))["at"].alias("i"), F.get("p", F.col("m.pred_index"))["at"].alias("j"), "m.similarity")


def match(gold: DataFrame, predicted: DataFrame, threshold: float = THRESHOLD, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """pair, i, j, similarity of the greedy matching of events (pair, i, f) and (pair, j, f); f as of matching.features.

    Pairs with at most `most_pairs` pairs of events are matched inside a row, the others by deferred(); the result is
    the same.
    """
    gold, predicted = spool(gold, "gold-events"), spool(predicted, "predicted-events")
    sizes = gold.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).join(predicted.groupBy("pair").agg(F.count(F.lit(1)).alias("m")), "pair")
    sizes = spool(sizes.select("pair", (F.col("n") * F.col("m") > most_pairs).alias("large")), "sizes")
    part = lambda rows, large: rows.join(sizes.where(F.col("large") == large).select("pair"), "pair", "left_semi")
    small = _inside_rows(part(gold, False), part(predicted, False), threshold)
    if not sizes.where("large").head(1):
        return small
    return small.unionByName(deferred(part(gold, True), part(predicted, True), threshold))
