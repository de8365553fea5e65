"""Case review: matched, missed and extra events side by side, with context from the article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora import schemas
from tempora.functions.arrays import safe
from tempora.functions.text import nearby
from tempora.operators import matching as m
from tempora.operators.errors import matched_articles, mismatches, only_in, pair_structs, same_entity

#: Characters of context on both sides of a quote.
CONTEXT = 220


def _first(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def with_articles(gold: DataFrame, predictions: DataFrame, articles: DataFrame | None = None, threshold: float = m.THRESHOLD) -> DataFrame:
    """Matched articles with the column `a`, the article itself."""
    matched = matched_articles(gold, predictions, threshold, scores=True)
    if articles is None:
        articles = gold.sparkSession.createDataFrame([], f"{schemas.ARTICLE}, rec_ord long")
    last = articles.where("article_id IS NOT NULL").groupBy("article_id").agg(F.max_by(F.struct(*articles.columns), "rec_ord").alias("a"))
    return matched.join(last, F.col("g.article_id") == last["article_id"], "left").drop("article_id")


def participant_diff(gold: Column, pred: Column) -> Column:
    """struct(missing, extra, role_mismatches) of two events' participants."""
    has = lambda item, others: F.exists(safe(others), lambda o: (m.norm(o["name"]) == m.norm(item["name"])) & o["type"].eqNullSafe(item["type"]))
    lost, more = only_in(gold["participants"], pred["participants"], m.participant_key), only_in(pred["participants"], gold["participants"], m.participant_key)
    return F.struct(
        F.filter(lost, lambda x: ~has(x, pred["participants"])).alias("missing"), F.filter(more, lambda x: ~has(x, gold["participants"])).alias("extra"),
        F.transform(F.filter(lost, lambda x: has(x, pred["participants"])), lambda x: F.struct(x.alias("gold"), same_entity(x, pred["participants"]).alias("prediction"))).alias("role_mismatches"),
    )


def item_diff(gold: Column, pred: Column, key) -> Column:
    """struct(missing, extra) of two arrays, the last of equal keys."""
    return F.struct(only_in(gold, pred, key).alias("missing"), only_in(pred, gold, key).alias("extra"))


def article_reviews(matched: DataFrame) -> DataFrame:
    """A row for each article with its matched, missed and extra events, contexts, and differences of entities and relations."""
    text = F.col("a.text")
    shown = lambda e: e.withField("source_context", nearby(text, e["evidence"], CONTEXT))

    def pair(x: Column) -> Column:
        people, links = participant_diff(x["gold"], x["pred"]), item_diff(x["gold"]["relations"], x["pred"]["relations"], m.relation_key)
        differ = F.concat(mismatches(x["gold"], x["pred"]), F.array_compact(F.array(
            F.when((F.size(people["missing"]) > 0) | (F.size(people["extra"]) > 0) | (F.size(people["role_mismatches"]) > 0), "participants"), F.when((F.size(links["missing"]) > 0) | (F.size(links["extra"]) > 0), "event_relations"),
        )))
        return F.struct(
            x["gold_index"].alias("gold_index"), x["pred_index"].alias("prediction_index"), F.bround(x["similarity"], 3).alias("match_similarity"), differ.alias("field_mismatches"), shown(x["gold"]).alias("gold_event"),
            shown(x["pred"]).alias("prediction_event"), people.alias("participant_diff"), links.alias("relation_diff"), F.lit("").alias("review_decision"), F.lit("").alias("review_notes"),
        )

    best_row = lambda i: F.coalesce(F.array_max(F.get("scores", i)), F.lit(0.0))
    best_column = lambda j: F.coalesce(F.array_max(F.transform("scores", lambda s: F.get(s, j))), F.lit(0.0))
    missed = F.transform("missed", lambda x: F.struct(x["index"].alias("gold_index"), F.bround(best_row(x["index"]), 3).alias("best_prediction_similarity"), shown(x["event"]).alias("gold_event")))
    extra = F.transform("extra", lambda x: F.struct(x["index"].alias("prediction_index"), F.bround(best_column(x["index"]), 3).alias("best_gold_similarity"), shown(x["event"]).alias("prediction_event")))
    g, p, a = F.col("g"), F.col("p"), F.col("a")
    return matched.select(
        g["rec_ord"].alias("rec_ord"), g["article_id"].alias("article_id"), F.coalesce(_first(g["title"], p["title"], a["title"]), F.lit("")).alias("title"), _first(g["source"], p["source"], a["source"]).alias("source"),
        F.coalesce(_first(g["source_url"], p["source_url"], p["url"], a["url"]), F.lit("")).alias("source_url"), _first(g["published_at"], p["published_at"], a["published_at"]).alias("published_at"),
        F.struct(F.size(safe("g.events")).alias("gold_events"), F.size(safe("p.events")).alias("prediction_events"), F.size("matches").alias("matched_events"), F.size("missed").alias("missed_gold_events"), F.size("extra").alias("extra_prediction_events")).alias("counts"),
        F.transform(pair_structs(), pair).alias("matched_events"), missed.alias("missed_gold_events"), extra.alias("extra_prediction_events"),
        item_diff(g["entities"], p["entities"], m.entity_key).alias("entity_diff"), item_diff(g["relations"], p["relations"], m.relation_key).alias("relation_diff"),
    )


def summary(reviews: DataFrame) -> DataFrame:
    """One row of totals."""
    names = ("gold_events", "prediction_events", "matched_events", "missed_gold_events", "extra_prediction_events")
    return reviews.agg(F.count(F.lit(1)).alias("article_count"), *[F.coalesce(F.sum(f"counts.{n}"), F.lit(0)).alias(n) for n in names])


def workbook(reviews: DataFrame) -> DataFrame:
    """The review table: an article's matched, then missed, then extra events; sort by (rec_ord, turn, i)."""
    x = F.col("x")
    cell = lambda e, f: F.coalesce(e[f], F.lit("")) if e is not None else F.lit("")

    def rows(turn, items, status, gi, hi, similarity, differ, g, h):
        fields = [(f"{side}_{f}", cell(e, f)) for f in ("event_type", "event_date", "location", "summary", "evidence") for side, e in (("gold", g), ("hybrid", h))]
        named = {"status": F.lit(status), "gold_index": gi.cast("int"), "hybrid_index": hi.cast("int"), "match_similarity": similarity, "field_mismatches": differ, **dict(fields), "review_decision": F.lit(""), "review_notes": F.lit("")}
        return reviews.select("rec_ord", "article_id", "title", F.posexplode(items).alias("i", "x")).select("rec_ord", F.lit(turn).alias("turn"), "i", *[F.col(c) if c in ("article_id", "title") else named[c].alias(c) for c in schemas.REVIEW_COLUMNS])

    none = F.lit(None)
    matched = rows(0, "matched_events", "matched", x["gold_index"], x["prediction_index"], x["match_similarity"], F.array_join(x["field_mismatches"], ", "), x["gold_event"], x["prediction_event"])
    missed = rows(1, "missed_gold_events", "missed_gold", x["gold_index"], none, x["best_prediction_similarity"], F.lit("unmatched_gold"), x["gold_event"], None)
    extra = rows(2, "extra_prediction_events", "extra_hybrid", none, x["prediction_index"], x["best_gold_similarity"], F.lit("unmatched_hybrid"), None, x["prediction_event"])
    return matched.unionByName(missed).unionByName(extra)
