"""python -m tempora.cli COMMAND: thin wrappers of the plans over files."""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from tempora import schemas


def _postprocess(spark, a) -> dict:
    from tempora.operators import geocode
    from tempora.plans.pipelines import extractions_to_graph
    from tempora.sources import cache_store, clients, readers, sinks

    records = readers.jsonl(spark, a.extractions, schemas.EXTRACTION)
    articles = readers.jsonl(spark, a.articles, schemas.ARTICLE) if a.articles else None
    review = readers.geocode_review(spark, a.review) if a.review else None
    kept = cache_store.exists(spark, a.cache)
    held = cache_store.read(spark, a.cache) if kept else readers.geocode_cache(spark, a.cache)
    remote = None if a.offline else clients.Nominatim(a.agent)
    out = extractions_to_graph(records, readers.aliases(spark, a.aliases), readers.geocode_overrides(spark, a.overrides), held, review, articles, remote, a.on_collision)
    (records, events, locations), counts = geocode.observed_summary(out["records"], out["events"], out["locations"])
    sinks.jsonl(records, f"{a.output}/article_extractions_clean", ["rec_ord"], one_file=True)
    sinks.jsonl(events, f"{a.output}/events_clean", ["rec_ord", "event_pos"], one_file=True)
    sinks.jsonl(locations.select("name", "latitude", "longitude", "display_name", "geocode_source", "osm_type", "osm_category", "osm_addresstype", "raw_importance", "notes", "review_flags"), f"{a.output}/geocoded_locations", ["name"], one_file=True)
    sinks.csv(out["location_review"], f"{a.output}/location_review", schemas.LOCATION_REVIEW_COLUMNS, ["ord", "i"])
    sinks.csv(out["geocode_review"], f"{a.output}/geocode_review", schemas.GEOCODE_REVIEW_COLUMNS, ["rec_ord", "event_pos"])
    sinks.graph_files(out, out["payload"], f"{a.output}/graph")
    if remote is not None:  # a store gets what is new, a file becomes a store beside the output
        new = out["cache"].join(held.select("query_key"), "query_key", "left_anti") if kept else out["cache"]
        cache_store.upsert(new, a.cache if kept else f"{a.output}/geocode_cache")
    found = counts()
    if found is None:
        found = {r["kind"] + (f":{r['label']}" if r["label"] else ""): r["count"] for r in out["summary"].collect()}
    Path(a.output, "summary.json").write_text(json.dumps(found, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    return found


def _ingest(spark, a) -> dict:
    from tempora.sources import pages

    found = (pages.parse_pages(pages.stored(spark, a.pages)) if a.stored else pages.ingest(spark, a.pages)).cache()
    found.where("article IS NOT NULL").select("article.*").write.mode("overwrite").option("ignoreNullFields", False).json(a.output)
    return {f"{r['kind']}:{r['label']}" if r["label"] else r["kind"]: r["count"] for r in pages.ingest_counts(found).collect()}


def _crawl(spark, a) -> dict:
    from tempora.sources import clients, pages, sinks

    pause, timeout = a.delay, a.timeout
    listings: list[tuple[str, str]] = []
    promos = pages.crawl(spark, a.topic, clients.page_fetcher(pause, timeout), a.since, a.until, a.max_pages or None, listings).cache()
    manifest = pages.download(promos, f"{a.output}/pages", lambda: clients.page_fetcher(pause, timeout), a.overwrite).cache()
    sinks.jsonl(manifest.drop("error"), f"{a.output}/crawl_manifest", ["page_number", "filename"], one_file=True)
    failed = spark.createDataFrame(listings, "url string, error string").unionByName(manifest.where("status = 'failed'").select("url", "error"))
    sinks.jsonl(failed, f"{a.output}/crawl_failures", ["url"], one_file=True)
    counts = pages.crawl_counts(promos).first().asDict() | pages.download_counts(manifest).first().asDict() | {"failed_listings": len(listings)}
    Path(a.output, "crawl_summary.json").write_text(json.dumps({"topic": a.topic, "since": a.since, "until": a.until} | counts, indent=2) + "\n", encoding="utf-8")
    return counts


def _aggregate(spark, a) -> dict:
    from tempora.plans.pipelines import records_to_graph
    from tempora.sources import graph_store, readers, sinks

    out = records_to_graph(readers.jsonl(spark, a.records, schemas.EXTRACTION), a.on_collision)
    sinks.graph_files(out, out["payload"], a.output)
    if a.store:
        graph_store.write_graph(out["nodes"], out["relations"], out["payload"], a.store)
    if a.node_link:
        sinks.node_link(out["nodes"], out["edges"]).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{a.output}/node_link")
    counts = out["metadata"].select("node_count", "edge_count", "skipped_relations").first().asDict()
    return counts | out["event_metadata"].select("event_count").first().asDict()


def _inspect(spark, a) -> dict:
    from tempora.sources import graph_store

    found = graph_store.inspect_edge(spark, a.store, a.edge) if a.edge else graph_store.inspect_event(spark, a.store, a.event)
    found.write.mode("overwrite").option("ignoreNullFields", False).json(a.output)
    return {"rows": spark.read.text(a.output).count()}


def _packets(spark, a) -> dict:
    from tempora.operators import candidates
    from tempora.plans import reports
    from tempora.sources import readers, sinks

    found = candidates.packets(readers.jsonl(spark, a.candidates, schemas.GOLD), readers.jsonl(spark, a.articles, schemas.ARTICLE)).cache()
    sinks.jsonl(found, f"{a.output}/packets", ["rec_ord"], one_file=True)
    for row in found.toLocalIterator():  # one Markdown file for each article that humans annotate
        Path(a.output, f"{reports.safe_name(row['article_id'])}.packet.md").write_text(reports.packet(row), encoding="utf-8")
    return {"packets": found.count()}


def _model_review(spark, a) -> dict:
    from tempora.plans import model_review, reports
    from tempora.sources import clients, readers

    packets = readers.jsonl(spark, a.packets, model_review.PACKET)
    done = None if a.overwrite else readers.done_ids(spark, f"{a.output}/records")
    key, url, model, timeout = clients.api_key(a.key_name, a.key_file), a.url, clients.model_name(a.model), a.timeout
    post = lambda *x, **more: clients.post_json(*x, **more | {"timeout": timeout})
    found = model_review.review(packets, lambda: clients.annotator(url, key, model, model_review.GOLD_SCHEMA, model_review.INSTRUCTIONS, post), done, a.limit).cache()
    found.where("status = 'ok'").select("record").write.mode("overwrite" if a.overwrite else "append").text(f"{a.output}/records")
    for row in found.where("status = 'ok'").toLocalIterator():  # a checklist for each article that humans check
        Path(a.output, f"{reports.safe_name(row['article_id'])}.review.md").write_text(reports.review_checklist(row["article_id"], json.dumps(json.loads(row["record"]), indent=2, ensure_ascii=False), "records"), encoding="utf-8")
    return {r["status"]: r["count"] for r in found.groupBy("status").count().collect()}


def _extract(spark, a) -> dict:
    from tempora.plans.extract import extract
    from tempora.sources import clients, readers, sinks

    articles = readers.jsonl(spark, a.articles, schemas.ARTICLE)
    wanted = readers.article_ids(spark, a.ids) if a.ids else None
    candidates = None
    if a.candidates:
        from pyspark.sql import functions as F

        lines = readers.with_order(spark.read.text(a.candidates))
        candidates = lines.select("rec_ord", F.get_json_object("value", "$.article_id").alias("article_id"), F.col("value").alias("record"))
    base, url = a.model, a.url
    done = readers.done_ids(spark, f"{a.output}/records") if a.resume else None
    found = extract(articles, lambda: clients.LocalChat(url), base, a.method, candidates, done=done, wanted=wanted, limit=a.limit, retries=a.retries, verify=not a.skip_verifier).cache()
    sinks.outcomes(found, a.output)
    return {r["status"]: r["count"] for r in found.groupBy("status").count().collect()}


def _score(spark, a) -> dict:
    from tempora.operators import scoring
    from tempora.plans import reports
    from tempora.sources import readers

    score = scoring.score(readers.jsonl(spark, a.gold, schemas.GOLD, strict=True), readers.jsonl(spark, a.predictions, schemas.EXTRACTION, strict=True), a.allow_draft_gold)
    Path(a.output).write_text(reports.score_report(score), encoding="utf-8")
    if a.log:
        reports.append_log(a.log, reports.log_row(reports.collected(score), datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M"), a.label, a.notes))
    return {"report": a.output}


def _errors(spark, a) -> dict:
    from tempora.operators import errors
    from tempora.plans import reports
    from tempora.sources import readers, sinks

    tables = errors.analyse(readers.jsonl(spark, a.gold, schemas.GOLD), readers.jsonl(spark, a.predictions, schemas.EXTRACTION))
    for name, rows in tables.items():
        sinks.error_csv(rows, f"{a.output}/{name}")
    Path(a.output, "errors.md").write_text(reports.error_report(tables), encoding="utf-8")
    return {"tables": len(tables)}


def _review(spark, a) -> dict:
    from tempora.operators import review
    from tempora.plans import reports
    from tempora.sources import readers, sinks

    articles = readers.jsonl(spark, a.articles, schemas.ARTICLE) if a.articles else None
    reviews = review.article_reviews(review.with_articles(readers.jsonl(spark, a.gold, schemas.GOLD), readers.jsonl(spark, a.predictions, schemas.EXTRACTION), articles, a.threshold)).cache()
    sinks.csv(review.workbook(reviews), f"{a.output}/case_review", schemas.REVIEW_COLUMNS, ["rec_ord", "turn", "i"])
    sinks.jsonl(reviews.select(*[c for c in reviews.columns if c not in ("g", "p", "a")]), f"{a.output}/case_review_json", ["rec_ord"], one_file=True)
    for row in reviews.toLocalIterator():  # one Markdown file for each annotated article
        Path(a.output, f"{reports.safe_name(row['article_id'])}.md").write_text(reports.article_review(row), encoding="utf-8")
    totals = review.summary(reviews).first().asDict()
    Path(a.output, "index.md").write_text(reports.index(totals, reviews.select("article_id", "counts", "rec_ord").orderBy("rec_ord").toLocalIterator()), encoding="utf-8")
    return totals


def _adjudicate(spark, a) -> dict:
    from tempora.operators import adjudicate
    from tempora.sources import readers, sinks, workbook

    book = readers.csv(spark, a.workbook, schemas.REVIEW_COLUMNS) if a.workbook.endswith(".csv") else workbook.read(spark, a.workbook)
    out = adjudicate.adjudicate(book, readers.jsonl(spark, a.gold, schemas.GOLD), readers.jsonl(spark, a.predictions, schemas.EXTRACTION))
    sinks.jsonl(out["records"], a.output, ["rec_ord"], one_file=True)
    if a.synced:
        sinks.csv(book, a.synced, [c for c in book.columns if not c.startswith("rec_")], ["rec_ord"])
    counts = {f"{r['kind']}:{r['label']}": r["count"] for r in out["counts"].orderBy("kind", "label").collect()}
    Path(f"{a.output}.summary.json").write_text(json.dumps(counts, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    return counts


def _candidates(spark, a) -> dict:
    from tempora.operators import candidates
    from tempora.sources import readers, sinks

    ids = [r["article_id"] for r in readers.article_ids(spark, a.ids).orderBy("ord").collect()] if a.ids else None
    failures = readers.jsonl(spark, a.failures, schemas.FAILURE) if a.failures else None
    drafts = candidates.generate(readers.jsonl(spark, a.predictions, schemas.EXTRACTION), a.limit, ids, failures)
    sinks.jsonl(drafts.drop("rec_ord"), a.output, ["pick"], one_file=True)
    return {"candidates": drafts.count()}


def _finalize(spark, a) -> dict:
    from tempora.operators import candidates
    from tempora.sources import readers, sinks

    done = candidates.finalize(readers.jsonl(spark, a.reviewed, schemas.GOLD), a.promote_reviewed)
    sinks.jsonl(done, a.output, ["rec_ord"], one_file=True)
    return {"gold": done.count()}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tempora", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, run, *required, **options):
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for option in required:
            sub.add_argument(f"--{option}", required=True)
        for option, default in options.items():
            flag = f"--{option.replace('_', '-')}"
            sub.add_argument(flag, action="store_true") if default is False else sub.add_argument(flag, default=default, type=type(default) if default is not None else str)

    command("crawl", _crawl, "topic", "output", since=None, until=None, delay=0.5, timeout=30.0, max_pages=0, overwrite=False)
    command("ingest", _ingest, "pages", "output", stored=False)
    command("extract", _extract, "articles", "output", "model", method="oneshot", url="http://127.0.0.1:11434", ids=None, candidates=None, limit=0, retries=2, skip_verifier=False, resume=False)
    command("postprocess", _postprocess, "extractions", "output", "overrides", "cache", aliases=None, articles=None, review=None, agent="tempora", offline=False, on_collision="merge")
    command("aggregate", _aggregate, "records", "output", on_collision="merge", node_link=False, store=None)
    command("inspect", _inspect, "store", "output", edge=None, event=None)
    command("score", _score, "gold", "predictions", "output", allow_draft_gold=False, log=None, label="", notes="")
    command("errors", _errors, "gold", "predictions", "output")
    command("review", _review, "gold", "predictions", "output", articles=None, threshold=0.45)
    command("adjudicate", _adjudicate, "workbook", "gold", "predictions", "output", synced=None)
    command("candidates", _candidates, "predictions", "output", limit=10, ids=None, failures=None)
    command("packets", _packets, "candidates", "articles", "output")
    command("model-review", _model_review, "packets", "output", "url", "model", key_name="API_KEY", key_file=None, limit=0, timeout=240.0, overwrite=False)
    command("finalize", _finalize, "reviewed", "output", promote_reviewed=False)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    asked = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("tempora").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(json.dumps(asked.run(spark, asked), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
