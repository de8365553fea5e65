"""Nested records from short descriptions."""

import json

from tempora import schemas


def entity(name, kind, **more):
    return {"name": name, "type": kind, **more}


def relation(source, target, kind, evidence="quote"):
    return {"source": source, "target": target, "type": kind, "evidence": evidence}


def person(name, kind, role):
    return {"name": name, "type": kind, "role": role}


def event(kind="AttackEvent", **more):
    base = {"event_id": "", "event_type": kind, "event_date": "2026-04-10", "date_precision": "day", "location": "", "participants": [], "relations": [], "summary": "s", "evidence": "quote", "confidence": 0.9}
    return base | more


def frame(spark, rows, schema=schemas.EXTRACTION):
    from pyspark.sql import functions as F

    lines = [(i, json.dumps(r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(lines, "rec_ord long, line string").select("rec_ord", F.from_json("line", schema).alias("x")).select("rec_ord", "x.*")
