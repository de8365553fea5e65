"""Streamed relations against the batch plan, with restarts."""

import random

from pyspark.sql import functions as F

from tempora import schemas
from tempora.operators import graph
from tempora.streaming import links
from tests.records import entity, frame, relation


def records(n):
    rng = random.Random(4)
    names = [f"Name {k}" for k in range(30)]
    return [{"article_id": f"a{k}", "published_at": "2026-04-10", "entities": [entity(x, "NationState") for x in rng.sample(names, 2)], "relations": [relation(rng.choice(names), rng.choice(names).upper(), "ATTACKED") for _ in range(3)]} for k in range(n)]


def rows_of(found):
    day = F.lit("2026-04-10")
    none = F.lit(None).cast("string")
    mentions = found.select("rec_ord", F.posexplode("entities").alias("i", "x"), "article_id").select("rec_ord", "i", F.lit(True).alias("mention"), F.col("x.name").alias("name"), none.alias("source"), none.alias("target"), F.col("x.type").alias("kind"), "article_id", day.alias("day"))
    said = found.select("rec_ord", F.posexplode("relations").alias("i", "x"), "article_id").select("rec_ord", "i", F.lit(False).alias("mention"), none.alias("name"), "x.source", "x.target", F.col("x.type").alias("kind"), "article_id", day.alias("day"))
    return mentions.unionByName(said)


def keys(df):
    return sorted(tuple(r) for r in df.select("rec_ord", "i", "edge_id").collect())


def test_stream_is_the_batch_plan_after_restarts(spark, tmp_path, monkeypatch):
    """Files come in three lots; the second run is broken off in the middle of a batch that has been written."""
    found = frame(spark, records(60), schemas.EXTRACTION)
    rows, path, out = rows_of(found).repartition(1).cache(), f"{tmp_path}/in", f"{tmp_path}/out"
    lot = lambda low, high: rows.where((F.col("rec_ord") >= low) & (F.col("rec_ord") < high)).write.mode("append").parquet(path)
    batch = lambda n: keys(graph.relation_rows(found.where(F.col("rec_ord") < n), graph.registry(graph.mentions(found.where(F.col("rec_ord") < n))))[0])

    lot(0, 20)
    assert keys(links.accepted(spark, path, out)) == batch(20)
    lot(20, 40)
    write, broken = links._write, []

    def fails(df, where, progress):
        """After the first query the output of a batch is there, its commit is not."""
        write(df, where, progress)
        if not broken:
            broken.append(where)
            last = sorted((tmp_path / "out" / "progress-sources" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
            last.unlink()
            (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
            raise RuntimeError("lost")

    monkeypatch.setattr(links, "_write", fails)
    try:
        links.accepted(spark, path, out)
    except RuntimeError:
        pass
    assert broken
    assert keys(links.accepted(spark, path, out)) == batch(40)
    lot(40, 60)
    assert keys(links.accepted(spark, path, out)) == batch(60) and len(batch(60)) > 60


def test_a_late_mention_frees_what_waits(spark, tmp_path):
    """The record that names an end comes after the one that relates it."""
    found = frame(spark, [{"article_id": "a", "entities": [entity("A", "NationState"), entity("B", "NationState")], "relations": []}, {"article_id": "b", "entities": [], "relations": [relation("A", "B", "ATTACKED"), relation("A", "C", "ATTACKED")]}])
    rows, path, out = rows_of(found), f"{tmp_path}/in", f"{tmp_path}/out"
    rows.where("rec_ord = 1").write.parquet(path)
    assert links.accepted(spark, path, out).count() == 0
    rows.where("rec_ord = 0").write.mode("append").parquet(path)
    got = links.accepted(spark, path, out).collect()
    assert [(r["rec_ord"], r["edge_id"]) for r in got] == [(1, "NationState:a|ATTACKED|NationState:b")]


def test_relations_of_few_names_pass_no_python_worker(spark, tmp_path, monkeypatch):
    """Names that almost all relations share are no state of one task: batches are joins, without rows in Python."""
    found = frame(spark, [{"article_id": "a", "entities": [entity("A", "NationState"), entity("B", "NationState")], "relations": [relation("A", "B", "ATTACKED")] * 3}])
    rows_of(found).write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "transformWithState", None)
    assert links.accepted(spark, f"{tmp_path}/in", f"{tmp_path}/out").count() == 3
