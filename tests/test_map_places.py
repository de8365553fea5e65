"""Places on the map against the plain walk, and the number of joins that deep chains take."""

import math
import random

import pytest

from tempora.operators import views


def plain_offset(seed):
    h = 0
    for c in seed:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    shifted = (h - (1 << 32) if h >= 1 << 31 else h) >> 8
    radius = 1.8 + math.fmod(shifted, 120) / 100
    return math.sin(h % 360 / 180 * math.pi) * radius, math.cos(h % 360 / 180 * math.pi) * radius


def plain_places(nodes, edges):
    places = {i: (lat, lon) for i, lat, lon in nodes if lat is not None}
    for _ in range(views.PASSES):
        for i in sorted(i for i, _, _ in nodes if i not in places):
            ends = [t if s == i else s for _, s, t in sorted(edges) if i in (s, t) and s != t]
            anchor = next((e for e in ends if e in places), None)
            if anchor is not None:
                places[i] = tuple(a + b for a, b in zip(places[anchor], plain_offset(i)))
    return places


def frames(spark, nodes, edges):
    return spark.createDataFrame(nodes, "id string, latitude double, longitude double"), spark.createDataFrame(edges, "id string, source string, target string")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k:02d}" for k in range(40)]
    nodes = [(i, *((1.5, 2.5) if rng.random() < 0.1 else (None, None))) for i in names]
    edges = [(f"e{k:03d}", rng.choice(names), rng.choice(names)) for k in range(45)]
    got = {r["id"]: (r["map_latitude"], r["map_longitude"]) for r in views.map_nodes(*frames(spark, nodes, edges)).collect() if r["map_latitude"] is not None}
    want = plain_places(nodes, edges)
    assert got.keys() == want.keys() and all(math.dist(got[i], want[i]) < 1e-9 for i in want) and len(want) > 20


def counted(monkeypatch):
    steps, head = [], views.spool
    monkeypatch.setattr(views, "spool", lambda df, name: (steps.append(name), head(df, name))[1])
    return steps


def test_a_chain_of_10000_nodes(spark, monkeypatch):
    """Placed at one end: one pass, and each walk along the chain takes at most 15 joins."""
    n = 10_000
    nodes = [(f"n{k:05d}", *((0.0, 0.0) if not k else (None, None))) for k in range(n)]
    edges = [(f"e{k:05d}", f"n{k:05d}", f"n{k + 1:05d}") for k in range(n - 1)]
    steps = counted(monkeypatch)
    got = {r["id"]: r["map_latitude"] for r in views.map_nodes(*frames(spark, nodes, edges)).collect()}
    lat = 0.0
    for k in range(1, n):
        lat += plain_offset(f"n{k:05d}")[0]
        assert abs(got[f"n{k:05d}"] - lat) < 1e-6
    assert steps.count("jump") <= 30 and steps.count("undecided") <= 3


def test_a_chain_without_a_place(spark, monkeypatch):
    """Nodes below the placed one are out of a pass's sight: decided at once, not one by one; each pass places one."""
    nodes = [(f"n{k:03d}", *((0.0, 0.0) if k == 199 else (None, None))) for k in range(200)]
    edges = [(f"e{k:03d}", f"n{k:03d}", f"n{k + 1:03d}") for k in range(199)]
    steps = counted(monkeypatch)
    got = {r["id"] for r in views.map_nodes(*frames(spark, nodes, edges)).collect() if r["map_latitude"] is not None}
    assert got == plain_places(nodes, edges).keys() == {"n196", "n197", "n198", "n199"}
    assert steps.count("undecided") <= 2 * views.PASSES


def test_no_pass_follows_when_all_nodes_are_placed(spark, monkeypatch):
    """The passes after the one that places the last node would join all neighbours with nothing."""
    passes, reached = [], views._reached
    monkeypatch.setattr(views, "_reached", lambda *a: passes.append(1) or reached(*a))
    nodes = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, None)], "id string, latitude double, longitude double")
    edges = spark.createDataFrame([("e", "a", "b")], "id string, source string, target string")
    assert views.map_nodes(nodes, edges).where("map_latitude IS NULL").count() == 0 and len(passes) == 1
