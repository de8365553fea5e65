"""Annotation candidates, packets and final gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora import schemas
from tempora.functions.arrays import safe
from tempora.operators.adjudicate import project_event
from tempora.tables import spool

DRAFT_NOTES = ("This row is generated from model output and is not gold yet.", "Delete incorrect items, add missing items, correct labels/dates/locations/evidence, then set annotation_status to 'gold'.")
FAILED_NOTE = "This article failed extraction. Add gold entities/events manually if it should be in the benchmark."
PROMOTED_NOTE = "Promoted from model review without a human pass."


def has_missing_geocode() -> Column:
    """A located event lacks coordinates."""
    return F.exists(safe("events"), lambda e: (F.coalesce(e["location"], F.lit("")) != "") & (e["location_geocode"]["latitude"].isNull() | e["location_geocode"]["longitude"].isNull()))


def has_review_flags() -> Column:
    some = lambda a: F.size(safe(a)) > 0
    return some(F.col("postprocess_review_flags")) | F.exists(safe("entities"), lambda x: some(x["review_flags"])) | F.exists(safe("events"), lambda e: some(e["review_flags"]))


#: Classes of records up to which a cover is chosen among the best records of each class; the ontology's six types make at most 256.
MOST_CLASSES = 4096


def _cover(rows: DataFrame, limit: int) -> list[int]:
    """The greedy cover of rows (rec_ord, types, bare, flagged, n) from one aggregation.

    Records with the same event types, bare and flagged alike, differ only in their number of events and their place,
    so that no more than the best `limit` of a class are ever picked. These are few and are covered on the driver.
    """
    best = Window.partitionBy("types", "bare", "flagged").orderBy(F.desc("n"), "rec_ord")
    top = rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).collect()
    classes: dict[tuple, list] = {}
    for r in sorted(top, key=lambda r: r["place"]):
        classes.setdefault((tuple(r["types"]), r["bare"], r["flagged"]), []).append((-r["n"], r["rec_ord"]))
    covered: set[str] = set()
    chosen: list[int] = []
    while classes and len(chosen) < limit:
        # of a class the first one left comes first
        kind = min(classes, key=lambda k: (-len(set(k[0]) - covered), -k[1], -k[2], *classes[k][0]))
        chosen.append(classes[kind].pop(0)[1])
        covered.update(kind[0])
        if not classes[kind]:
            del classes[kind]
    return chosen


def _cover_by_rounds(rows: DataFrame, limit: int) -> list[int]:
    """The same, a top-1 query for each pick, for any number of classes."""
    covered: list[str] = []
    chosen: list[int] = []
    while len(chosen) < limit:
        seen = F.array(*map(F.lit, covered)).cast("array<string>")
        left = rows.where(~F.col("rec_ord").isin(chosen)) if chosen else rows
        top = left.orderBy(F.size(F.array_except("types", seen)).desc(), F.desc("bare"), F.desc("flagged"), F.desc("n"), "rec_ord").limit(1).collect()
        if not top:
            break
        chosen.append(top[0]["rec_ord"])
        covered = sorted({*covered, *top[0]["types"]})
    return chosen


def representative(records: DataFrame, limit: int, most_classes: int = MOST_CLASSES) -> DataFrame:
    """rec_ord and pick (1, 2, ..) of at most `limit` records by greedy cover of event types.

    Each pick has most new event types, then missing geocodes, flags, and events, then comes first.
    """
    types = F.array_sort(F.array_distinct(F.filter(F.transform(safe("events"), lambda e: e["event_type"]), lambda t: t.isNotNull())))
    rows = spool(records.where(F.size(safe("events")) > 0).select("rec_ord", types.alias("types"), has_missing_geocode().cast("int").alias("bare"), has_review_flags().cast("int").alias("flagged"), F.size("events").alias("n")), "candidates")
    few = rows.select("types", "bare", "flagged").distinct().limit(most_classes + 1).count() <= most_classes
    chosen = _cover(rows, limit) if few else _cover_by_rounds(rows, limit)
    return records.sparkSession.createDataFrame([(x, i + 1) for i, x in enumerate(chosen)], "rec_ord long, pick int")


def candidates(records: DataFrame) -> DataFrame:
    """Draft gold rows of predictions."""
    entity = lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), F.coalesce(x["aliases"], F.array().cast("array<string>")).alias("aliases"))
    links = F.filter(safe("relations"), lambda r: (r["source"] != "") & (r["target"] != "") & (r["type"] != ""))
    return records.select(
        "rec_ord", "article_id", "title", "source", F.coalesce(F.nullif("url", F.lit("")), F.col("source_url")).alias("source_url"), "published_at", F.lit("needs_human_review").alias("annotation_status"),
        F.array(*map(F.lit, DRAFT_NOTES)).alias("annotation_notes"), F.transform(F.filter(safe("entities"), lambda x: (x["name"] != "") & (x["type"] != "")), entity).alias("entities"), links.alias("relations"),
        F.transform(safe("events"), project_event).alias("events"),
    )


def failure_candidates(failures: DataFrame) -> DataFrame:
    """Draft gold rows of articles that failed."""
    none = lambda t: F.lit(None).cast(t)
    notes = F.array(F.lit(FAILED_NOTE), F.concat(F.lit("Extraction failure: "), F.coalesce("error", F.lit("None"))))
    empty = F.array()
    return failures.select(
        "rec_ord", "article_id", "title", none("string").alias("source"), none("string").alias("source_url"), none("string").alias("published_at"), F.lit("needs_human_review").alias("annotation_status"), notes.alias("annotation_notes"),
        empty.cast("array<struct<name:string,type:string,aliases:array<string>>>").alias("entities"), empty.cast(f"array<{schemas.RELATION}>").alias("relations"), empty.cast(f"array<{schemas.EVENT}>").alias("events"),
    )


def generate(records: DataFrame, limit: int, article_ids: list[str] | None = None, failures: DataFrame | None = None) -> DataFrame:
    """Draft rows (column `pick` is their order): of all ids in the order asked, or of at most `limit` representative records; then of failures that have no row yet, each once.

    Failures fill up to the limit, but one is always taken; with ids, all are.
    """
    if article_ids:
        wanted = records.sparkSession.createDataFrame(list(enumerate(article_ids)), "pick int, article_id string")
        last = records.groupBy("article_id").agg(F.max("rec_ord").alias("rec_ord"))
        picks = wanted.join(last, "article_id").select("rec_ord", "pick")
    else:
        picks = representative(records, limit)
    out = candidates(records).join(picks, "rec_ord")
    if failures is not None:
        n = picks.count()
        once = failures.where("article_id IS NOT NULL").groupBy("article_id").agg(F.min_by(F.struct("rec_ord", "title", "error"), "rec_ord").alias("x")).select("article_id", "x.*")
        left = once.join(out.select("article_id"), "article_id", "left_anti")
        more = failure_candidates(left if article_ids else left.orderBy("rec_ord").limit(max(1, limit - n)))
        out = out.unionByName(more.withColumn("pick", (F.col("rec_ord") + n + 1).cast("int")))
    return out


def packets(drafts: DataFrame, articles: DataFrame) -> DataFrame:
    """Drafts with their article (the last of its id): what an annotator gets. The draft's own title, source, url and date come first; drafts without an id go."""
    last = articles.where("article_id IS NOT NULL").groupBy("article_id").agg(F.max_by(F.struct("title", "source", "url", "published_at", "text"), "rec_ord").alias("a"))
    joined = drafts.where("article_id IS NOT NULL").join(last, "article_id", "left")
    first = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    return joined.select("rec_ord", "article_id", first("title", "a.title").alias("title"), first("source", "a.source").alias("source"), first("source_url", "a.url").alias("source_url"), first("published_at", "a.published_at").alias("published_at"), F.coalesce("a.text", F.lit("")).alias("text"), F.struct(*[c for c in drafts.columns if c not in ("rec_ord", "pick")]).alias("draft"))


def finalize(rows: DataFrame, promote_reviewed: bool = False) -> DataFrame:
    """Rows whose status is gold; with `promote_reviewed` also model-reviewed ones, with a note. Raises if none is left."""
    reviewed = F.col("annotation_status") == "model_reviewed"
    kept = rows.where((F.col("annotation_status") == "gold") | (reviewed if promote_reviewed else F.lit(False)))
    kept = kept.withColumns({"annotation_notes": F.when(reviewed, F.concat(safe("annotation_notes"), F.array(F.lit(PROMOTED_NOTE)))).otherwise(F.col("annotation_notes")), "annotation_status": F.lit("gold")})
    if not kept.head(1):
        raise ValueError("no row is final")
    return kept
