"""Differences over rows against the array differences of the error tables."""

import random

from pyspark.sql import functions as F

from tempora import schemas
from tempora.functions.text import norm
from tempora.operators import diffs, errors
from tests.records import event, frame, person


def test_role_diff_is_that_of_the_error_table(spark):
    """Pairs of events with repeated names, roles, blanks and nulls."""
    rng = random.Random(9)
    some = lambda: [person(rng.choice(["A", "a ", "B", "", None]), rng.choice(["NationState", "NationState", None]), rng.choice(["target", "initiator", "mediator", None])) for _ in range(rng.randrange(6))]
    rows = [{"article_id": f"a{k}", "annotation_status": "gold", "events": [event(participants=some())]} for k in range(40)]
    others = [{"article_id": f"a{k}", "events": [event(participants=some())]} for k in range(40)]
    gold, pred = frame(spark, rows, schemas.GOLD), frame(spark, others)
    table = errors.participant_errors(errors.matched_articles(gold, pred, 0.1))
    want = sorted((r["article_id"], r["error_type"], (r["gold_name"] or r["pred_name"]).strip().lower(), r["gold_type"] or r["pred_type"], r["gold_role"], r["pred_role"]) for r in table.collect())
    flat = lambda df: df.select("article_id", F.posexplode("events.participants").alias("k", "people")).select("article_id", F.posexplode("people").alias("i", "p")).select("article_id", "i", norm("p.name").alias("name"), "p.type", "p.role")
    got = diffs.role_diff(flat(gold), flat(pred), ["article_id"], "i")
    assert sorted((r["article_id"], r["error_type"], r["name"], r["type"], r["gold_role"] or "", r["pred_role"] or "") for r in got.collect()) == want
    assert {k for _, k, *_ in want} == {"missing_participant", "role_mismatch", "extra_participant"}


def test_item_diff_keeps_the_last_of_equal_keys(spark):
    gold = spark.createDataFrame([(1, "x", 0, "first"), (1, "x", 1, "last"), (1, "both", 2, "g"), (2, "x", 0, "other"), (2, None, 1, "null")], "rec long, key string, i int, said string")
    pred = spark.createDataFrame([("p", 0, "both", 1), ("more", 5, "new", 2), ("less", 4, "new", 2)], "said string, i int, key string, rec long")
    got = sorted((r["rec"], r["key"] or "", r["side"], r["item"]["said"]) for r in diffs.item_diff(gold, pred, ["rec", "key"], "i").collect())
    assert got == [(1, "x", "missing", "last"), (2, "", "missing", "null"), (2, "new", "extra", "more"), (2, "x", "missing", "other")]
    assert diffs.item_diff(gold.limit(0), pred.limit(0), ["rec", "key"], "i").count() == 0
