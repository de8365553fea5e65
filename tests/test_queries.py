"""Registered queries against their SQL on the smallest tables, and the others against plain loops."""

import duckdb
import pytest

import __spark_entry__ as entry
from tempora.plans import catalogue


def canonical(df):
    df = df[sorted(df.columns)]
    rows = [tuple("<null>" if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df.itertuples(index=False)]
    return list(df.columns), sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert canonical(catalogue.QUERIES[name](spark, small).toPandas()) == canonical(con.sql(catalogue.ORACLE_SQL[name]).df())


def test_entry(spark, small):
    assert entry.entry(spark).columns[0] == "id" and set(entry.oracle_sql()) <= set(entry.queries())


def test_greedy_query_is_the_plain_loop(spark, small):
    rows = catalogue.matched_users(spark, small).selectExpr("g.article_id AS a", "scores", "matches").collect()
    from tests.test_evaluation import plain_greedy

    for r in rows:
        assert [(m["gold_index"], m["pred_index"]) for m in r["matches"]] == [(i, j) for i, j, _ in plain_greedy(r["scores"], 0.45)]


def test_any_number_of_passages(spark, tmp_path):
    """More passages than are broadcast, some repeated, short, empty or null, found wherever they begin in a word."""
    bodies = [" ".join(f"d{i}w{k}" for k in range(12)) for i in range(20)] + ["Concat sat on mats", "a b", "", None]
    quotes = [" ".join(f"x{i}w{k}" for k in range(8)) for i in range(20_050)] + [bodies[3], bodies[3], bodies[4][2:-1], "d5w3 d5w4 d5w5", "cat sat on mat", "w1 d6", "b", "", None, "d7w1 d7w3 d7w2"]
    docs = [(None if i == 3 else i // 2, t) for i, t in enumerate(bodies)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted((d or -1, i) for d, t in docs for i, q in enumerate(quotes) if t is not None and q is not None and q in t)
    got = sorted((r["doc_id"] or -1, r["item_id"]) for r in catalogue.QUERIES["evidence_exact"](spark, str(tmp_path)).collect())
    assert got == want and len(got) > 20
    assert catalogue.QUERIES["nearby_context"](spark, str(tmp_path)).count() == len(want)
