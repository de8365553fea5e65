import random

import pytest
from pyspark.sql import functions as F

from tempora.functions import arrays, coords, dates, text
from tempora.operators import views


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "expected"),
    [
        (lambda: text.norm_space(F.lit(" a  b\x1c c\n")), "a b c"),
        (lambda: text.norm_space(F.lit(None).cast("string")), ""),
        (lambda: text.fold(F.lit("Straße ΣΟΦΟς")), "strasse σοφοσ"),
        (lambda: text.norm_name(F.lit(' "U.S.  Navy\' ')), "U.S. Navy"),
        (lambda: text.alias_key(F.lit(" U.S. ")), "us"),
        (lambda: text.slug(F.lit("The Strait of Hormuz!")), "the-strait-of-hormuz"),
        (lambda: text.slug(F.lit("Ελλάδα")), ""),
        (lambda: text.slug_unicode(F.lit("São Tomé & Co.")), "são-tomé-co"),
        (lambda: text.node_id(F.lit("United States"), F.lit("NationState")), "NationState:united-states"),
        (lambda: text.event_id(F.lit("a 1"), F.lit(1000), F.lit("AttackEvent")), "event:a-1:1001:attackevent"),
        (lambda: text.evidence_exists(F.lit("He said\n so."), F.lit("said so")), True),
        (lambda: text.evidence_exists(F.lit("He said so."), F.lit("Said so")), False),
        (lambda: text.quote_exists(F.lit("He said so."), F.lit("SAID so")), True),
        (lambda: text.nearby(F.lit("one two three four five"), F.lit("THREE"), 4), "two three fou"),
        (lambda: text.nearby(F.lit("one"), F.lit("x"), 4), ""),
        (lambda: text.fuzzy_match(F.lit("a b c d e"), F.lit("a b c d f")), False),
        (lambda: text.fuzzy_match(F.lit("a b c d e f g h i"), F.lit("a b c d e f g h j")), True),
        (lambda: text.fuzzy_match(F.lit(""), F.lit("")), False),
        (lambda: text.number(F.lit(0.8125)), "0.812"),
        (lambda: text.number(F.lit(1234.5)), "1234.500"),
        (lambda: text.optional_number(F.lit(None).cast("double")), "N/A"),
        (lambda: text.escape_cell(F.lit("a|b\\c\nd")), "a\\|b\\\\c d"),
        (lambda: text.clean_text(F.lit(" a &amp;  b ")), "a & b"),
        (lambda: text.json_object(F.lit('```json\n{"a": 1}\n```')), '{"a": 1}'),
        (lambda: text.json_object(F.lit('Sure: {"a": 1} ok')), '{"a": 1}'),
        (lambda: text.json_object(F.lit("no")), None),
        (lambda: text.file_name(F.lit(None).cast("string"), F.lit("x")), "undated__x.html"),
        (lambda: text.safe_file_name(F.lit("a/b c")), "a-b-c"),
        (lambda: text.title_of_file(F.lit("What now_ - BBC News.html")), "What now?"),
        (lambda: dates.iso_date(F.lit("2026-04-10T23:30:00-05:00")), "2026-04-10"),
        (lambda: dates.iso_date(F.lit("20260410")), "2026-04-10"),
        (lambda: dates.iso_date(F.lit("2026-02-30")), None),
        (lambda: dates.iso_date(F.lit("soon")), None),
        (lambda: dates.event_date(F.lit(" 2026-03 ")), "2026-03"),
        (lambda: dates.checked_event_date(F.lit(""), F.lit("day"), F.lit("2026-04-10T01:00:00Z")), "2026-04-10"),
        (lambda: dates.checked_event_date(F.lit(""), F.lit("unknown"), F.lit("2026-04-10")), ""),
        (lambda: dates.checked_event_date(F.lit("2026"), F.lit("day"), F.lit("2026-04-10")), None),
        (lambda: dates.checked_event_date(F.lit("2026-04-01"), F.lit("article_date"), F.lit("2026-04-10")), "2026-04-01"),
        (lambda: dates.checked_event_date(F.lit(" N/A "), F.lit("unknown"), F.lit("2026-04-10")), ""),
        (lambda: dates.checked_event_date(F.lit("2026"), F.lit("unknown"), F.lit("2026-04-10")), None),
        (lambda: dates.checked_event_date(F.lit(None).cast("string"), F.lit("month"), F.lit("2026-04-10 odd")), "2026-04-10"),
        (lambda: dates.epoch_ms_iso(F.lit(1775779200123)), "2026-04-10T00:00:00.123000+00:00"),
        (lambda: dates.epoch_ms_iso(F.lit(1775779200000)), "2026-04-10T00:00:00+00:00"),
        (lambda: coords.safe_float(F.lit("x")), None),
        (lambda: coords.safe_float(F.lit(" 1.5 ")), 1.5),
        (lambda: arrays.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), 1.0),
        (lambda: arrays.jaccard(F.array(F.lit("a")), F.array().cast("array<string>")), 0.0),
        (lambda: arrays.first_by(F.array(*map(F.lit, ("b", "B", "a"))), F.lower), ["b", "a"]),
        (lambda: arrays.last_by(F.array(*map(F.lit, ("b", "B", "a"))), F.lower), ["B", "a"]),
        (lambda: views.confidence_label(F.lit(0.125)), "13%"),
        (lambda: views.confidence_level(F.lit(0.55)), "Medium confidence"),
        (lambda: views.status_label(F.lit("needs_review")), "Needs Review"),
        (lambda: views.status_detail(F.lit("other")), "Validation status unknown"),
        (lambda: views.event_type_label(F.lit("AttackEvent")), "Attack Event"),
    ],
)
def test_expression(spark, make, expected):
    assert value(spark, make()) == expected


def test_location_flags(spark):
    codes = lambda name: [f["code"] for f in value(spark, text.location_flags(F.lit(name)))]
    assert codes("Iranian ports") == ["generic_location_name", "adjectival_location_name"]
    assert codes("Heathrow Airport") == ["generic_location_name"]
    assert codes("Portland") == []


def test_geocode_flags(spark):
    flags = lambda *a: [f["message"] for f in value(spark, coords.geocode_flags(*[F.lit(x) if x is not None else F.lit(None).cast("double") for x in a]))]
    assert flags("X", None, 1.0, "missing", "", 0.5) == ["No coordinates found for 'X'."]
    assert flags("X", 1.0, 1.0, "nominatim", "state", 0.00125)[1].endswith("(0.0013); review manually.") or flags("X", 1.0, 1.0, "nominatim", "state", 0.00125)[1].endswith("(0.0012); review manually.")


def test_offset_matches_a_plain_loop(spark):
    import math

    for seed in ("NationState:iran", "x", "NonStateActor:some-long-name-with-many-letters", "é \U0001f680 x"):
        h, units = 0, seed.encode("utf-16-be")
        for k in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[k : k + 2], "big")) & 0xFFFFFFFF
        signed = h - (1 << 32) if h >= 1 << 31 else h
        angle, radius = (h % 360) * math.pi / 180, 1.8 + math.fmod(signed >> 8, 120) / 100
        o = value(spark, coords.offset(F.lit(seed)))
        assert (o["latitude"], o["longitude"]) == pytest.approx((math.sin(angle) * radius, math.cos(angle) * radius))


def test_ticks(spark):
    days = [f"2026-01-{i:02d}" for i in range(1, 21)]
    got = value(spark, views.ticks(F.array(*map(F.lit, days))))
    index = sorted({0, 19, *(math_round(i * 19 / 6) for i in range(1, 6))})
    assert got == [days[i] for i in index]
    assert value(spark, views.ticks(F.array(*map(F.lit, days[:8])))) == days[:8]


def math_round(x):
    return int(x + 0.5)


def test_names_without_anything_to_clean_are_kept(spark):
    """The short way of norm_name gives what all of its steps give."""
    rng = random.Random(3)
    names = ["".join(rng.choice(" ab\"'\t\n\u00a0\u2028\x1c\u3000.é") for _ in range(rng.randint(0, 6))) for _ in range(3000)] + [None]
    rows = spark.createDataFrame([(x,) for x in names], "x string")
    steps = text.norm_space(F.regexp_replace(text.strip("x"), "^[\"']+|[\"']+$", ""))
    assert rows.where(~text.norm_name("x").eqNullSafe(steps)).count() == 0


def test_relations_are_cleaned_by_one_expression(spark):
    """Kept relations and flags come from names that are looked up once: the plan has each lookup of an end once."""
    from tempora.operators import clean

    rows = spark.sql("SELECT array(named_struct('source', 'A', 'target', ' b ', 'type', 'ATTACKED', 'evidence', 'x'), named_struct('source', 'a', 'target', 'C', 'type', 'ATTACKED', 'evidence', 'x')) AS r, map('a', named_struct('name', 'A'), 'b', named_struct('name', 'B')) AS index, CAST(map() AS map<string, struct<name: string>>) AS known FROM range(1)")
    done = rows.repartition(1).select(clean.cleaned_relations(F.col("r"), F.col("index"), F.col("known")).alias("x")).select("x.kept", "x.flags")
    row = done.first()
    assert [(r["source"], r["target"]) for r in row["kept"]] == [("A", "B")] and [f["code"] for f in row["flags"]] == ["relation_missing_entity"]
    assert done._jdf.queryExecution().optimizedPlan().toString().count("try_element_at") <= 12
