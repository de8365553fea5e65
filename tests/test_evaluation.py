"""Scores, errors, review, adjudication, candidates."""

import pytest
from pyspark.sql import functions as F

from tempora import schemas
from tempora.operators import adjudicate, candidates, errors, matching, review, scoring
from tempora.plans import reports
from tests.records import entity, event, frame, person, relation

US, IRAN = entity("United States", "NationState"), entity("Iran", "NationState")


def attack(**more):
    return event(location="Tehran", participants=[person("United States", "NationState", "initiator"), person("Iran", "NationState", "target")], relations=[relation("United States", "Iran", "ATTACKED")], **more)


def gold_row(events, **more):
    return {"article_id": "a1", "title": "T", "annotation_status": "gold", "entities": [US, IRAN], "relations": [relation("United States", "Iran", "ATTACKED")], "events": events} | more


def both(spark, gold, pred):
    return frame(spark, gold, schemas.GOLD), frame(spark, pred)


def metrics(score):
    return {(r["metric"], r["label"]): r for r in score["metrics"].collect()}


def test_perfect_prediction(spark):
    gold, pred = both(spark, [gold_row([attack()])], [gold_row([attack()])])
    score = scoring.score(gold, pred)
    m = metrics(score)
    assert all(m[n, None]["f1"] == 1.0 for n in reports.METRICS)
    assert m["entities", "NationState"]["tp"] == 2 and m["participants", "initiator"]["tp"] == 1
    assert score["fields"].first()["evidence_exact_match_rate"] == 1.0
    text = reports.score_report(score)
    assert "| entities | 1.000 | 1.000 | 1.000 | 2 | 0 | 0 |" in text
    assert reports.log_row(reports.collected(score), "now", "x|y").startswith("| now | x\\|y | 1 | 1 | 1 | 1.000 |")


def test_missing_prediction_and_draft_gold(spark):
    gold, pred = both(spark, [gold_row([attack()])], [gold_row([attack()], article_id="other")])
    score = scoring.score(gold, pred)
    assert [r["article_id"] for r in score["missing"].collect()] == ["a1"]
    assert metrics(score)["entities", None]["recall"] == 0.0 and score["fields"].first()["event_type_accuracy"] is None
    with pytest.raises(ValueError, match="not final"):
        scoring.score(frame(spark, [gold_row([], annotation_status="needs_human_review")], schemas.GOLD), pred)
    with pytest.raises(ValueError, match="no rows"):
        scoring.score(gold.limit(0), pred)


def test_last_prediction_of_an_article_counts(spark):
    gold, pred = both(spark, [gold_row([attack()])], [gold_row([]), gold_row([attack()])])
    assert metrics(scoring.score(gold, pred))["events_soft", None]["tp"] == 1


def plain_greedy(scores, t):
    used, out = set(), []
    for i, row in enumerate(scores):
        best, top = None, 0.0
        for j, s in enumerate(row):
            if j not in used and s > top:
                best, top = j, s
        if best is not None and top >= t:
            used.add(best)
            out.append((i, best, top))
    return out


@pytest.mark.parametrize("scores", [[[0.5, 0.5], [0.9, 0.5]], [[0.449999, 0.45]], [[0.9], [0.9]], [[0.0]], [], [[0.6, 0.7, 0.7], [0.7, 0.9, 0.1], [0.5, 0.5, 0.5]]])
def test_greedy_is_the_plain_loop(spark, scores):
    df = spark.createDataFrame([(scores,)], "s array<array<double>>").select(matching.greedy(F.col("s")).alias("m"))
    assert [tuple(x) for x in df.first()["m"]] == plain_greedy(scores, 0.45)


def test_error_tables(spark):
    pred = attack(date_precision="month", evidence="other words")
    pred = pred | {"location": "Isfahan", "participants": [person("United States", "NationState", "mediator"), person("Iran", "NationState", "target")]}
    gold, predictions = both(spark, [gold_row([attack(), event("ThreatEvent", location="Berlin", event_date="2020")])], [gold_row([pred, event("SanctionEvent", event_date="1999", location="Rome")], entities=[US])])
    tables = errors.analyse(gold, predictions)
    kinds = {n: [r["error_type"] for r in t.collect()] for n, t in tables.items() if n != "articles"}
    assert kinds["entities"] == ["missing_entity"] and kinds["relations"] == []
    assert sorted(kinds["events"]) == ["extra_event", "matched_event_field_mismatch", "missed_event"]
    assert kinds["participants"] == ["role_mismatch"] and kinds["event_relations"] == []
    assert sorted(kinds["geocoding"]) == ["extra_located_event_missing_coordinates", "location_mismatch", "missed_located_event", "predicted_location_missing_coordinates"]
    row = tables["articles"].first()
    assert (row["matched_events"], row["missed_events"], row["extra_events"], row["entity_errors"], row["geocoding_errors"]) == (1, 1, 1, 1, 4)
    assert "Error analysis" in reports.error_report(tables)
    details = tables["events"].where("error_type LIKE 'matched%'").first()["issue_details"]
    assert details == "date_precision; location; evidence_mismatch"


def test_case_review_and_workbook(spark):
    gold, pred = both(spark, [gold_row([attack(), event("ThreatEvent", event_date="2020")])], [gold_row([attack(date_precision="month"), event("SanctionEvent", event_date="1999", location="x")])])
    articles = frame(spark, [{"article_id": "a1", "text": "Before the quote came after."}], schemas.ARTICLE)
    reviews = review.article_reviews(review.with_articles(gold, pred, articles))
    r = reviews.first()
    assert tuple(r["counts"]) == (2, 2, 1, 1, 1)
    assert r["matched_events"][0]["field_mismatches"] == ["date_precision"] and r["matched_events"][0]["gold_event"]["source_context"] == "Before the quote came after."
    book = review.workbook(reviews).orderBy("rec_ord", "turn", "i").collect()
    assert [x["status"] for x in book] == ["matched", "missed_gold", "extra_hybrid"] and [x["hybrid_index"] for x in book] == [0, None, 1]
    assert "Matched 0 / 0" in reports.article_review(r)
    assert review.summary(reviews).first()["matched_events"] == 1


def test_article_review_tells_roles_and_relations(spark):
    other = attack() | {"participants": [person("United States", "NationState", "target")], "relations": []}
    gold, pred = both(spark, [gold_row([attack()])], [gold_row([other])])
    r = review.article_reviews(review.with_articles(gold, pred, None, 0.1)).first()
    shown = reports.article_review(r)
    assert "- role of United States: initiator in gold, target in the prediction" in shown and "- relations missing: United States -> Iran (ATTACKED)" in shown
    metrics = {("events_soft", None): {"f1": 0.5}}
    assert "events soft F1: 0.500" in reports.index({"article_count": 1}, [r], metrics) and "- [ ] " in reports.review_checklist("a", "{}", "records")


def test_adjudication(spark):
    g = [attack(summary="g0"), attack(summary="g1"), attack(summary="g2")]
    p = [attack(summary="p0"), attack(summary="p1")]
    gold, pred = both(spark, [gold_row(g)], [gold_row(p)])
    book = spark.createDataFrame([(0, "a1", "matched", "0", "0.0", "both_correct"), (1, "a1", "matched", "2", "1", "both_wrong"), (2, "a1", "missed_gold", "1", None, "gold_correct"), (3, "a1", "extra_hybrid", None, "1", "hybrid_better")], "rec_ord long, article_id string, status string, gold_index string, hybrid_index string, review_decision string")
    out = adjudicate.adjudicate(book, gold, pred)
    record = out["records"].first()
    assert [e["summary"] for e in record["events"]] == ["p0", "g1", "p1"]
    assert [e["name"] for e in record["entities"]] == ["United States", "Iran", "Tehran"] and len(record["relations"]) == 1
    counts = {(r["kind"], r["label"]): r["count"] for r in out["counts"].collect()}
    assert (counts["source", "hybrid"], counts["source", "gold"], counts["source", "dropped"]) == (2, 1, 1)
    with pytest.raises(ValueError, match="without a decision"):
        adjudicate.adjudicate(book.withColumn("review_decision", F.lit("")), gold, pred)
    with pytest.raises(Exception, match="no such event"):
        adjudicate.adjudicate(book.withColumn("gold_index", F.lit("9")), gold, pred)["records"].collect()


def test_candidates(spark):
    a = {"article_id": "a", "events": [event(), event("ThreatEvent")]}
    b = {"article_id": "b", "events": [event("SanctionEvent")] * 3}
    c = {"article_id": "c", "events": [event()]}
    d = {"article_id": "d", "events": []}
    records = frame(spark, [c, a, b, d])
    picks = {r["pick"]: r["rec_ord"] for r in candidates.representative(records, 3).collect()}
    assert picks == {1: 1, 2: 2, 3: 0}
    drafts = candidates.generate(records, 5, ["b", "a"])
    assert [r["article_id"] for r in drafts.orderBy("pick").collect()] == ["b", "a"]
    failures = frame(spark, [{"article_id": "f", "title": "t", "error": "boom"}], schemas.FAILURE)
    assert candidates.generate(records, 3, None, failures).count() == 4
    some = frame(spark, [{"article_id": x, "error": "boom"} for x in ("a", "f", "f", None, "g")], schemas.FAILURE)
    assert [r["article_id"] for r in candidates.generate(records, 1, ["b", "a"], some).orderBy("pick").collect()] == ["b", "a", "f", "g"]
    rows = frame(spark, [gold_row([]), gold_row([], annotation_status="model_reviewed")], schemas.GOLD)
    assert candidates.finalize(rows).count() == 1 and candidates.finalize(rows, True).count() == 2
    articles = frame(spark, [{"article_id": "a", "text": "body"}], schemas.ARTICLE)
    assert candidates.packets(candidates.candidates(records), articles).where("article_id = 'a'").first()["text"] == "body"


@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.4, 0.45, 0.48, 0.9, 1.0])
def test_matches_without_hopeless_scores(spark, threshold):
    """Pairs that cannot reach the threshold aren't compared whole; the matches are those of all scores, and tables of errors keep none."""
    nobody = {"participants": [], "relations": []}
    far = attack() | nobody | {"location": "Paris", "event_date": "2020-01-01", "event_type": "SupportEvent"}
    lone = attack() | {"event_date": "2021-02-03", "relations": []}
    gold, pred = both(spark, [gold_row([attack(), far, lone, attack() | {"location": "Paris"}])], [gold_row([far, lone, attack(), attack() | nobody | {"location": "Rome"}])])
    pairs = matching.match_articles(matching.paired_records(gold, pred), threshold).first()
    assert [tuple(x) for x in pairs["matches"]] == plain_greedy(pairs["scores"], threshold)
    limited = matching.match_articles(matching.paired_records(gold, pred), threshold).select("matches").first()
    assert limited["matches"] == pairs["matches"]
    kept = errors.matched_articles(gold, pred, threshold)
    assert "scores" not in kept.columns and kept.first()["matches"] == pairs["matches"]
