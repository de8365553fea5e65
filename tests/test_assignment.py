"""Matching over rows against the plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from tempora import schemas
from tempora.operators import assignment, matching
from tests.records import event, frame, person, relation
from tests.test_evaluation import plain_greedy

EVENT = "struct<event_type:string,event_date:string,location:string,participants:array<struct<name:string,type:string,role:string>>,relations:array<struct<source:string,target:string,type:string>>>"


def plain_similarity(a, b):
    jac = lambda x, y: 1.0 if not set(x) | set(y) else len(set(x) & set(y)) / len(set(x) | set(y))
    one = lambda k: 1.0 if a[k] == b[k] and (a[k] is not None or k == "event_type") else 0.0
    out = 0.30 * one("event_type") + 0.18 * one("event_date") + 0.12 * one("location")
    return out + 0.20 * jac(a["participants"], b["participants"]) + 0.20 * jac(a["relations"], b["relations"])


def some(rng, n, wide):
    person_ = lambda: (f"p{rng.randrange(wide)}", "t", "r")
    return [
        {"event_type": rng.choice(["A", "B", None]), "event_date": rng.choice(["d1", "d2", None]), "location": f"l{rng.randrange(wide)}", "participants": list(dict.fromkeys(person_() for _ in range(rng.randrange(3)))),
         "relations": list(dict.fromkeys((f"s{rng.randrange(wide)}", "t", "k") for _ in range(rng.randrange(2))))}
        for _ in range(n)
    ]


def rows(spark, articles, place):
    return spark.createDataFrame([(pair, k, e) for pair, events in articles.items() for k, e in enumerate(events)], f"pair long, {place} int, f {EVENT}")


@pytest.mark.parametrize("threshold", [0.45, 0.2, 0.75])
def test_rounds_are_the_plain_loop(spark, threshold):
    rng = random.Random(8)
    gold, pred = {k: some(rng, rng.randrange(12), 3) for k in range(12)}, {k: some(rng, rng.randrange(12), 3) for k in range(1, 13)}
    gold[20], pred[20] = [gold[1][0] if gold[1] else some(rng, 1, 1)[0]] * 9, some(rng, 5, 1) * 3
    want = sorted((k, i, j, round(s, 9)) for k in gold for i, j, s in plain_greedy([[plain_similarity(a, b) for b in pred.get(k, [])] for a in gold[k]], threshold))
    got = assignment.match(rows(spark, gold, "i"), rows(spark, pred, "j"), threshold, most_pairs=20)
    assert sorted((r["pair"], r["i"], r["j"], round(r["similarity"], 9)) for r in got.collect()) == want and len(want) > 5
    pairs = sorted((k, i, j) for k in gold for i, a in enumerate(gold[k]) for j, b in enumerate(pred.get(k, [])) if plain_similarity(a, b) >= threshold)
    found = assignment.similar_events(rows(spark, gold, "i"), rows(spark, pred, "j"), threshold)
    assert sorted((r["pair"], r["i"], r["j"]) for r in found.collect()) == pairs


def test_no_events(spark):
    none = {0: []}
    assert assignment.match(rows(spark, none, "i"), rows(spark, {0: some(random.Random(1), 3, 1)}, "j"), most_pairs=0).count() == 0


def test_key_sets_cover_every_similar_pair():
    for threshold in (0.0, 0.1, 0.3, 0.45, 0.6, 1.0):
        sets = assignment.key_sets(threshold)
        assert sets and all(sum(assignment.WEIGHTS[x] for x in s) >= threshold - 1e-9 for s in sets)
    assert assignment.key_sets(0.0) == [()] and ("event_type", "event_date") in assignment.key_sets(0.45)


def test_an_article_of_50000_events(spark):
    """25,000 gold events and as many predictions of one article; those of one type and day compete."""
    n, rng = 25_000, random.Random(2)
    kind = lambda: (f"t{rng.randrange(5)}", f"d{rng.randrange(1000)}", rng.randrange(300))
    shape = lambda k: {"event_type": k[0], "event_date": k[1], "location": f"l{k[2]}", "participants": [], "relations": []}
    gold, pred = [kind() for _ in range(n)], [kind() for _ in range(n)]
    days, used, want = {}, set(), []
    for j, b in enumerate(pred):
        days.setdefault(b[:2], []).append((j, b))
    for i, a in enumerate(gold):
        best = min(((-plain_similarity(shape(a), shape(b)), j) for j, b in days.get(a[:2], []) if j not in used), default=None)
        if best:
            used.add(best[1])
            want.append((i, best[1]))
    # two events without participants and relations share 0.40, so type and day are needed
    got = assignment.match(rows(spark, {1: [shape(k) for k in gold]}, "i"), rows(spark, {1: [shape(k) for k in pred]}, "j"), 0.88 - 1e-6)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want and len(want) > 15_000


def test_events_of_records(spark):
    """The last prediction of an article counts; gold records of one article are matched apart."""
    a = event(location="Tehran", participants=[person("X", "NationState", "target")], relations=[relation("X", "Y", "ATTACKED")])
    gold = frame(spark, [{"article_id": "a", "events": [a, event("ThreatEvent")]}, {"article_id": "a", "events": [a]}, {"article_id": None, "events": [a]}], schemas.GOLD)
    pred = frame(spark, [{"article_id": "a", "events": []}, {"article_id": "a", "events": [event("ThreatEvent"), a]}, {"article_id": None, "events": [a]}])
    flat = assignment.match(*assignment.last_events(gold, pred))
    nested = matching.match_articles(matching.paired_records(gold, pred)).select(F.col("g.rec_ord").alias("pair"), F.explode("matches").alias("m"))
    assert sorted((r["pair"], r["i"], r["j"]) for r in flat.collect()) == sorted((r["pair"], r["m"]["gold_index"], r["m"]["pred_index"]) for r in nested.collect()) == [(0, 0, 1), (0, 1, 0), (1, 0, 1)]


def test_no_table_of_events_is_broadcast(spark):
    """Files of equal features are far smaller than their rows, so their size doesn't tell what fits the driver."""
    who = F.array(F.struct(F.lit("actor").alias("name"), F.lit("NonStateActor").alias("type"), F.lit("target").alias("role")))
    e = F.struct(F.lit("AttackEvent").alias("event_type"), F.lit("2026-01-01").alias("event_date"), F.lit("place").alias("location"), who.alias("participants"), F.array().cast("array<struct<source:string,target:string,type:string>>").alias("relations"))
    side = lambda place: spark.range(400).select((F.col("id") % 100).alias("pair"), (F.col("id") / 100).cast("int").alias(place), e.alias("f"))
    found = assignment.similar_events(side("i"), side("j"))
    assert found.count() == 1600
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    classes = side("i").withColumnRenamed("i", "class")
    pairs = assignment._keys(classes, 0.45).join(assignment._keys(classes, 0.45), ["pair", "key"])
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
