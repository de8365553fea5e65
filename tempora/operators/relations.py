"""Relations that follow from an event's participants and roles, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora import ontology, schemas
from tempora.functions.arrays import cross, first_by, first_nonempty, pairs_before, safe
from tempora.functions.lookup import at
from tempora.functions.text import fold, norm_space

_NO_PAIR = f"array<struct<a:{schemas.PARTICIPANT},b:{schemas.PARTICIPANT}>>"


def normal_participants(participants: Column | str) -> Column:
    """Whole participants of the ontology, the first of each name and role."""
    people = F.transform(safe(participants), lambda p: F.struct(norm_space(p["name"]).alias("name"), p["type"].alias("type"), p["role"].alias("role")))
    people = F.filter(people, lambda p: (p["name"] != "") & p["type"].isin(*ontology.ENTITY_TYPES) & p["role"].isin(*ontology.ROLES))
    return first_by(people, lambda p: F.struct(fold(p["name"]), p["role"]))


def repaired_roles(kind: Column, participants: Column) -> Column:
    """Roles that an event type has another name for."""

    def role(p: Column) -> Column:
        return (
            F.when((kind == "SupportEvent") & (p["role"] == "initiator"), "supporter")
            .when((kind == "SanctionEvent") & (p["role"] == "initiator"), "sanctioning_actor")
            .when((kind == "NegotiationEvent") & p["role"].isin("initiator", "target"), "participant")
            .otherwise(p["role"])
        )

    return first_by(F.transform(participants, lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"), role(p).alias("role"))), lambda p: F.struct(fold(p["name"]), p["role"]))


def with_location(participants: Column, location: Column, known_types: Column | None = None) -> Column:
    """The location as an affected one, unless it takes part under any role; its type as known (a map by folded name)."""
    kind = F.lit("StrategicLocation") if known_types is None else F.coalesce(at(known_types, fold(location)), F.lit("StrategicLocation"))
    there = F.exists(participants, lambda p: fold(p["name"]) == fold(location)) | (F.coalesce(location, F.lit("")) == "")
    added = F.array(F.struct(location.alias("name"), kind.alias("type"), F.lit("affected_location").alias("role")))
    return F.when(there, participants).otherwise(F.concat(participants, added))


def known_types(entities: Column | str) -> Column:
    """Types by folded name, the first of each."""
    rows = F.transform(F.filter(safe(entities), lambda x: (norm_space(x["name"]) != "") & x["type"].isin(*ontology.ENTITY_TYPES)), lambda x: F.struct(fold(norm_space(x["name"])).alias("k"), x["type"].alias("v")))
    return F.map_from_entries(first_by(rows, lambda r: r["k"]))


def _has_role(role: str):
    return lambda p: p["role"] == role


def role_pairs(kind: Column, participants: Column, union: bool = False) -> Column:
    """array of struct(a, b): who does what to whom.

    Targets are of the first role in order of preference that anyone has; with `union`, of all of them in this order.
    Negotiations pair their participants with those after them, else initiators with targets or participants.
    """

    def of(*roles: str) -> Column:
        return F.flatten(F.array(*[F.filter(participants, _has_role(r)) for r in roles]))

    out = None
    table = ontology.UNION_ROLES if union else ontology.DIRECTED_ROLES
    for name, (source, targets) in table.items():
        aims = of(*targets) if union else first_nonempty(*[of(t) for t in targets])
        pairs = cross(of(source), aims).cast(_NO_PAIR)
        out = F.when(kind == name, pairs) if out is None else out.when(kind == name, pairs)
    sides = pairs_before(of("participant")).cast(_NO_PAIR)
    rest = of("target", "participant") if union else first_nonempty(of("target"), of("participant"))
    fallback = cross(of("initiator"), rest).cast(_NO_PAIR)
    return out.when(kind == "NegotiationEvent", F.when(F.size(sides) > 0, sides).otherwise(fallback)).otherwise(F.array().cast(_NO_PAIR))


def built_relations(kind: Column, participants: Column, evidence: Column, union: bool = False) -> Column:
    """Relations of role pairs, without loops and repeats."""
    relation = F.try_element_at(F.create_map(*[F.lit(x) for pair in ontology.RELATION_OF_EVENT.items() for x in pair]), kind)
    pairs = F.filter(role_pairs(kind, participants, union), lambda p: fold(p["a"]["name"]) != fold(p["b"]["name"]))
    pairs = first_by(pairs, lambda p: F.struct(fold(p["a"]["name"]), fold(p["b"]["name"])))
    return F.transform(pairs, lambda p: F.struct(p["a"]["name"].alias("source"), p["b"]["name"].alias("target"), relation.alias("type"), evidence.alias("evidence")))


def event_changed(before: Column, after: Column) -> Column:
    """Whether any compared field differs."""
    fields = ("event_type", "event_date", "date_precision", "location", "participants", "summary", "confidence", "relations")
    out = F.lit(False)
    for f in fields:
        out = out | ~before[f].eqNullSafe(after[f])
    return out


def rebuilt_event(e: Column, entities: Column) -> Column:
    """The event with normal participants, repaired roles, its location taking part, and relations rebuilt; null if nothing can be built."""
    kind, evidence, location = e["event_type"], norm_space(e["evidence"]), norm_space(e["location"])
    people = with_location(repaired_roles(kind, normal_participants(e["participants"])), location, known_types(entities))
    links = built_relations(kind, people, evidence)
    made = (
        e.withField("participants", people).withField("relations", links).withField("evidence", evidence).withField("location", location).withField("event_date", norm_space(e["event_date"]))
        .withField("summary", norm_space(e["summary"])).withField("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(e["confidence"], F.lit(0.0)))))
    )
    return F.when(kind.isin(*ontology.EVENT_TYPES) & (evidence != "") & (F.size(people) > 0) & (F.size(links) > 0), made)
