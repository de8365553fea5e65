"""Markdown: tables and reports of results that are small by nature (scores, counts, one article's review)."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from tempora.plans.model_review import INSTRUCTIONS

LOG_COLUMNS = ("Timestamp", "Label", "Gold articles", "Gold events", "Pred events", "Entity F1", "Relation F1", "Exact F1", "Soft F1", "Participant F1", "Event-rel F1", "Type acc", "Date acc", "Evidence exact", "Evidence fuzzy", "Geocode rate", "Notes")
METRICS = ("entities", "relations", "events_exact", "events_soft", "participants", "event_relations")


def rate(x) -> str:
    return f"{x:.3f}" if isinstance(x, (int, float)) and x == x else "N/A"


def cell(x) -> str:
    return "" if x is None else str(x).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def table(headers, rows) -> str:
    rows = list(rows)
    if not rows:
        return "None."
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(headers), line(["---"] * len(headers)), *[line([cell(x) for x in r]) for r in rows]])


def item_label(item: dict) -> str:
    if {"name", "type"} <= item.keys():
        return f"{item['name']} ({', '.join(filter(None, (item['type'], item.get('role'))))})"
    return f"{item.get('source')} -> {item.get('target')} ({item.get('type')})"


def items_label(items) -> str:
    return "; ".join(item_label(x.asDict() if hasattr(x, "asDict") else x) for x in items or []) or "none"


def collected(score: dict[str, DataFrame]) -> dict:
    """The small tables of a score on the driver."""
    out = {k: score[k].first().asDict() for k in ("fields", "geocoding", "counts")}
    out["metrics"] = {(r["metric"], r["label"]): r.asDict() for r in score["metrics"].collect()}
    out["missing"] = [r["article_id"] for r in score["missing"].orderBy("rec_ord").collect()]
    return out


def score_report(score: dict[str, DataFrame]) -> str:
    r = collected(score)
    c, f, g = r["counts"], r["fields"], r["geocoding"]
    rows = [[n, *[rate(r["metrics"][n, None][k]) for k in ("precision", "recall", "f1")], *[r["metrics"][n, None][k] for k in ("tp", "fp", "fn")]] for n in METRICS]
    labels = [[m, lab, rate(v["precision"]), rate(v["recall"]), rate(v["f1"])] for (m, lab), v in sorted(r["metrics"].items(), key=lambda x: (x[0][0], x[0][1] or "")) if lab]
    parts = [
        "# Evaluation report", "## Scope", "\n".join(f"- {k.replace('_', ' ')}: {v}" for k, v in c.items()), "## Core metrics", table(("Metric", "Precision", "Recall", "F1", "TP", "FP", "FN"), rows),
        "## By label", table(("Metric", "Label", "Precision", "Recall", "F1"), labels), "## Matched event fields", "\n".join(f"- {k.replace('_', ' ')}: {v if k == 'matched_event_count' else rate(v)}" for k, v in f.items()),
        "## Geocoding", "\n".join(f"- {k.replace('_', ' ')}: {rate(v) if k.endswith('rate') else v}" for k, v in g.items()),
    ]
    if r["missing"]:
        parts += ["## Missing predictions", "\n".join(f"- `{x}`" for x in r["missing"])]
    return "\n\n".join(parts) + "\n"


def error_report(tables: dict[str, DataFrame]) -> str:
    from tempora.operators.errors import error_counts, worst_articles

    parts = ["# Error analysis"]
    for name in ("entities", "relations", "events", "participants", "event_relations", "geocoding"):
        parts += [f"## {name.replace('_', ' ')}", table(("Error", "Count"), [(x["error_type"], x["count"]) for x in error_counts(tables[name], 8).collect()])]
    worst = worst_articles(tables["articles"]).collect()
    columns = ("article_id", "missed_events", "extra_events", "participant_errors", "geocoding_errors")
    return "\n\n".join([*parts, "## Articles with most errors", table(columns, [[x[k] for k in columns] for x in worst])]) + "\n"


COUNTED, COUNT_COLUMNS = ("Gold", "Prediction", "Matched", "Missed", "Extra"), ("gold_events", "prediction_events", "matched_events", "missed_gold_events", "extra_prediction_events")
#: What a reviewer may decide.
DECISIONS = ("gold_correct", "hybrid_better", "merge_needed", "both_wrong", "uncertain")


def differences(name: str, diff) -> list[str]:
    return [f"- {name} {k}: {items_label(diff[k])}" for k in ("missing", "extra")]


def role_lines(pairs) -> list[str]:
    """Participants that both sides name in different roles."""
    return [f"- role of {p['gold']['name']}: {p['gold']['role']} in gold, {p['prediction']['role']} in the prediction" for p in pairs or []]


def safe_name(article_id) -> str:
    return "".join(c if c.isalnum() or c in "._-" else "-" for c in article_id or "article")


def index(summary: dict, articles, metrics: dict | None = None) -> str:
    """The page that lists reviewed articles (article_id, counts), totals, and F1 of `metrics` if given."""
    parts = ["# Case review", f"Decisions go to the review table: {', '.join(DECISIONS)}.", "## Totals", "\n".join(f"- {k.replace('_', ' ')}: {v}" for k, v in summary.items())]
    if metrics:
        parts += ["## Scores", "\n".join(f"- {n.replace('_', ' ')} F1: {rate(metrics[n, None]['f1'])}" for n in METRICS if (n, None) in metrics)]
    rows = [[f"[{x['article_id']}]({safe_name(x['article_id'])}.md)", *[x["counts"][c] for c in COUNT_COLUMNS]] for x in articles]
    return "\n\n".join([*parts, "## Articles", table(("Article", *COUNTED), rows)]) + "\n"


def review_checklist(article_id: str, record: str, file: str) -> str:
    """What a human checks of a model-reviewed record (JSON text)."""
    checks = ("the article supports every event", "every evidence is an exact quote", "weak events are gone", "no major event is missing", "types, roles, dates and locations are right", f"`annotation_status` in `{file}` is set to `gold`")
    return f"# Review of {article_id}\n\n" + "\n".join(f"- [ ] {x}" for x in checks) + f"\n\n```json\n{record}\n```\n"


def article_review(row) -> str:
    """One article of a case review."""
    parts = [f"# {row['title'] or row['article_id']}", "\n".join(f"- {k}: {row[c]}" for k, c in (("source", "source_url"), ("published", "published_at")) if row[c])]
    parts += ["## Counts", table(COUNTED, [[row["counts"][c] for c in COUNT_COLUMNS]])]
    for x in row["matched_events"]:
        g, p = x["gold_event"], x["prediction_event"]
        fields = [(f, g[f], p[f]) for f in ("event_type", "event_date", "date_precision", "location", "summary", "evidence")]
        parts += [f"## Matched {x['gold_index']} / {x['prediction_index']} ({rate(x['match_similarity'])})", f"Differs in: {', '.join(x['field_mismatches']) or 'nothing'}", table(("Field", "Gold", "Prediction"), fields)]
        parts.append("\n".join([*differences("participants", x["participant_diff"]), *role_lines(x["participant_diff"]["role_mismatches"]), *differences("relations", x["relation_diff"])]))
    for title, items, side, score in (("Missed", row["missed_gold_events"], "gold", "best_prediction_similarity"), ("Extra", row["extra_prediction_events"], "prediction", "best_gold_similarity")):
        for x in items:
            e = x[f"{side}_event"]
            parts += [f"## {title} {x[f'{side}_index']} (best {rate(x[score])})", table(("Field", "Value"), [(f, e[f]) for f in ("event_type", "event_date", "location", "summary", "evidence", "source_context")])]
    for title, kind in (("Entities", "entity_diff"), ("Relations", "relation_diff")):
        parts += [f"## {title}", "\n".join(differences(title.lower(), row[kind]))]
    return "\n\n".join(parts) + "\n"


def log_row(score: dict, timestamp: str, label: str, notes: str = "") -> str:
    """A row of the evaluation log from collected scores."""
    f1 = [rate(score["metrics"][n, None]["f1"]) for n in METRICS]
    fields = [rate(score["fields"].get(k)) for k in ("event_type_accuracy", "event_date_accuracy", "evidence_exact_match_rate", "evidence_fuzzy_match_rate")]
    c = score["counts"]
    values = [timestamp, label, c["gold_article_count"], c["gold_event_count"], c["event_count_in_scope"], *f1, *fields, rate(score["geocoding"].get("located_event_coordinate_rate")), notes]
    return "| " + " | ".join(str(v).replace("|", "\\|").replace("\n", " ") for v in values) + " |\n"


def append_log(path: str, row: str) -> None:
    """Appends the row; a new file gets the header first."""
    at = Path(path)
    head = "# Evaluation log\n\n| " + " | ".join(LOG_COLUMNS) + " |\n| " + " | ".join(["---"] * len(LOG_COLUMNS)) + " |\n"
    text = at.read_text(encoding="utf-8") if at.exists() else head
    at.write_text(text + ("" if text.endswith("\n") else "\n") + row, encoding="utf-8")


def packet(row) -> str:
    """What an annotator reads of one article."""
    draft = json.dumps(row["draft"].asDict(recursive=True), indent=2, ensure_ascii=False)
    return f"# {row['title'] or row['article_id']}\n\n{INSTRUCTIONS}\n\n- id: {row['article_id']}\n- url: {row['source_url'] or ''}\n- published: {row['published_at'] or ''}\n\n## Article\n\n{row['text'] or ''}\n\n## Draft\n\n```json\n{draft}\n```\n"
