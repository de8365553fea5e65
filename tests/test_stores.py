"""The cache by key, and the cover of event types against the plain loop."""

import json
import random

import pytest

from tempora import cli, schemas
from tempora.operators import candidates
from tempora.sources import cache_store
from tests.records import event, frame


def lookups(spark, *rows):
    return spark.createDataFrame([(k, k, lat, None if lat is None else 1.0, None, source, None, None, None, None, note) for k, lat, source, note in rows], f"query_key string, {schemas.GEOCODE_RECORD}")


def folders(path):
    return {p.name: sorted((f.name, f.stat().st_mtime_ns) for f in p.glob("*.parquet")) for p in (path / "rows").glob("bucket=*")}


def test_one_new_name_rewrites_one_folder(spark, tmp_path):
    path = tmp_path / "cache"
    assert cache_store.read(spark, str(path)).count() == 0
    names = [f"place {k}" for k in range(100)]
    assert cache_store.upsert(lookups(spark, *[(n, 1.0, "nominatim", None) for n in names]), str(path), buckets=8) == 8
    before = folders(path)
    assert len(before) == 8
    # a failed lookup is kept, too
    assert cache_store.upsert(lookups(spark, ("new", None, "missing", "no result")), str(path)) == 1
    after = folders(path)
    assert sum(before[b] != after[b] for b in before) == 1
    assert cache_store.upsert(lookups(spark, ("place 7", 9.0, "nominatim", "again"), ("place 7", 9.0, "nominatim", "again")), str(path)) == 1
    got = {r["query_key"]: (r["latitude"], r["source"], r["notes"]) for r in cache_store.read(spark, str(path)).collect()}
    assert got == {n: (1.0, "nominatim", None) for n in names} | {"new": (None, "missing", "no result"), "place 7": (9.0, "nominatim", "again")}


def test_empty_updates(spark, tmp_path):
    path = f"{tmp_path}/cache"
    assert cache_store.upsert(lookups(spark, ("x", 1.0, "s", None)).limit(0), path) == 0
    assert cache_store.exists(spark, path) and cache_store.read(spark, path).count() == 0
    assert cache_store.upsert(lookups(spark, ("x", 1.0, "s", None)), path) == 1 and cache_store.read(spark, path).count() == 1


def test_command_reads_a_store(spark, tmp_path):
    """The cache may be a store; it is left as it is if nothing was asked."""
    cache_store.upsert(lookups(spark, ("strait", 26.0, "nominatim", None)), f"{tmp_path}/cache")
    (tmp_path / "in.jsonl").write_text('{"article_id": "a", "entities": [{"name": "Strait", "type": "StrategicLocation"}], "relations": [], "events": []}\n')
    cli.main(["postprocess", "--extractions", f"{tmp_path}/in.jsonl", "--output", f"{tmp_path}/out", "--overrides", f"{tmp_path}/none.csv", "--cache", f"{tmp_path}/cache", "--offline"], spark)
    assert spark.read.json(f"{tmp_path}/out/geocoded_locations").first()["latitude"] == 26.0


def plain_cover(records, limit):
    left, seen, out = {i: r for i, r in enumerate(records) if r["events"]}, set(), []
    while left and len(out) < limit:
        key = lambda i: (-len({e["event_type"] for e in left[i]["events"]} - seen), -any(e["location"] for e in left[i]["events"]), -bool(left[i]["postprocess_review_flags"]), -len(left[i]["events"]), i)
        best = min(left, key=key)
        seen |= {e["event_type"] for e in left.pop(best)["events"]}
        out.append(best)
    return out


@pytest.mark.parametrize("limit", [1, 4, 60])
def test_cover_is_the_plain_loop(spark, limit):
    rng = random.Random(3)
    kinds = ["AttackEvent", "ThreatEvent", "SupportEvent", "SanctionEvent"]
    records = [{"article_id": f"a{k}", "events": [event(rng.choice(kinds), location=rng.choice(["", "", "x"])) for _ in range(rng.randrange(5))], "postprocess_review_flags": rng.choice([[], [{"code": "c", "message": "m"}]])} for k in range(50)]
    want = plain_cover(records, limit)
    for most in (candidates.MOST_CLASSES, 0):
        if most or limit < 10:
            assert [r["rec_ord"] for r in candidates.representative(frame(spark, records), limit, most).orderBy("pick").collect()] == want


def test_summary_is_counted_while_tables_are_written(spark, tmp_path):
    """The counts of summary(), and no job after the three writes."""
    from tempora.operators import geocode
    from tests.records import entity, relation

    records = [{"article_id": f"a{k}", "entities": [entity("A", "NationState"), entity("B", None)], "relations": [relation("A", "B", "ATTACKED")] * k, "events": [event(), event("ThreatEvent"), event(None)][:k]} for k in range(4)]
    found = frame(spark, records).cache()
    flat = geocode.flatten_events(found)
    places = spark.createDataFrame([("x", [("c", "m"), ("d", "m")]), ("y", None)], f"name string, review_flags {schemas.FLAGS}")
    want = {r["kind"] + (f":{r['label']}" if r["label"] else ""): r["count"] for r in geocode.summary(found, flat, places).collect()}
    spark.sparkContext.setJobGroup("summary", "summary")
    tables, counts = geocode.observed_summary(found, flat, places)
    for table in tables:
        table.write.format("noop").mode("overwrite").save()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("summary"))
    assert counts() == want and len(spark.sparkContext.statusTracker().getJobIdsForGroup("summary")) == jobs <= 3
    spark.sparkContext.setJobGroup("", "")
    tables, counts = geocode.observed_summary(frame(spark, [{"article_id": "a", "entities": [entity("A", "Star")]}]), flat, places)
    for table in tables:
        table.write.format("noop").mode("overwrite").save()
    assert counts() is None  # a type that can't be named beforehand
    assert want["relation_type_counts:ATTACKED"] == 6


def test_review_and_adjudicate_commands(spark, tmp_path):
    """The case review as JSON, the review table written back with the summary, an error table without rows as an empty file."""
    from tempora.sources import readers, sinks
    from tests.records import person, relation

    a = event(participants=[person("A", "NationState", "target")], relations=[relation("A", "B", "ATTACKED")])
    row = json.dumps({"article_id": "a", "title": "t", "annotation_status": "gold", "entities": [], "relations": [], "events": [a]})
    (tmp_path / "rows.jsonl").write_text(row + "\n")
    both = ["--gold", f"{tmp_path}/rows.jsonl", "--predictions", f"{tmp_path}/rows.jsonl"]
    (tmp_path / "review").mkdir()
    cli.main(["review", *both, "--output", f"{tmp_path}/review"], spark)
    shown = spark.read.json(f"{tmp_path}/review/case_review_json").first()
    assert shown["article_id"] == "a" and len(shown["matched_events"]) == 1
    book = readers.csv(spark, f"{tmp_path}/review/case_review", schemas.REVIEW_COLUMNS).toPandas()
    book["review_decision"] = "both_correct"
    book.drop(columns="rec_ord").to_csv(tmp_path / "book.csv", index=False)
    cli.main(["adjudicate", "--workbook", f"{tmp_path}/book.csv", *both, "--output", f"{tmp_path}/new", "--synced", f"{tmp_path}/synced"], spark)
    back = readers.csv(spark, f"{tmp_path}/synced", schemas.REVIEW_COLUMNS).collect()
    assert [(r["article_id"], r["review_decision"]) for r in back] == [("a", "both_correct")]
    assert json.loads((tmp_path / "new.summary.json").read_text())["source:hybrid"] == 1
    sinks.error_csv(spark.createDataFrame([], "rec_ord long, b string, a string"), f"{tmp_path}/none")
    assert "".join(p.read_text() for p in (tmp_path / "none").glob("part-*")) == ""
