"""End-to-end plans: extractions to graph, and predictions to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.operators import clean, errors, geocode, graph, scoring
from tempora.tables import spool


def extractions_to_graph(records: DataFrame, aliases: DataFrame, overrides: DataFrame, cache: DataFrame, review: DataFrame | None = None, articles: DataFrame | None = None, remote=None, on_collision: str = "merge") -> dict[str, DataFrame]:
    """records (cleaned, geocoded), events (flat), locations, cache, review tables, graph, events payload and their metadata."""
    if articles is not None:
        records = clean.backfill(records, articles)
    cleaned = spool(clean.clean_records(records, aliases), "clean")
    locations, cache = geocode.geocode(geocode.unique_locations(cleaned), overrides, cache, remote)
    locations = spool(locations, "locations")
    spark: SparkSession = records.sparkSession
    if review is None:
        review = spark.createDataFrame([], "location_name string, article_id string, event_summary string, source_url string, current_latitude double, current_longitude double, suggested_latitude double, suggested_longitude double, rec_ord long")
    hints = geocode.suggestions(review)
    done = spool(geocode.attach(cleaned, locations, hints), "geocoded")
    flat = geocode.flatten_events(done)
    return records_to_graph(done, on_collision) | {
        "records": done, "events": flat, "locations": locations, "cache": cache, "location_review": geocode.review_rows(locations), "geocode_review": geocode.geocode_review_rows(flat, hints),
        "summary": geocode.summary(done, flat, locations),
    }


def records_to_graph(records: DataFrame, on_collision: str = "merge") -> dict[str, DataFrame]:
    """The graph of records that are cleaned and geocoded already, events payload and metadata."""
    made = graph.graph(records, on_collision)
    nodes = spool(made["nodes"], "nodes")
    payload = graph.events_payload(records, nodes)
    return made | {"nodes": nodes, "payload": payload, "event_metadata": graph.event_metadata(payload)}


def evaluate(gold: DataFrame, predictions: DataFrame, allow_draft: bool = False) -> dict[str, dict[str, DataFrame]]:
    """Scores and error tables."""
    return {"score": scoring.score(gold, predictions, allow_draft), "errors": errors.analyse(gold, predictions)}
