"""Registration of the corpus queries, and their SQL on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from tempora.llm import queries
from tests.test_queries import canonical


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact dedup", "near dedup", "mix", "pack"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in "documents embeddings conversations benchmark labels".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert canonical(queries.QUERIES[name](spark, small).toPandas()) == canonical(con.sql(queries.ORACLE_SQL[name]).df())


def test_pipeline_stages_against_brute_force(spark, small):
    """Each stage on what the one before kept."""
    from tests.llm.test_texts import norm, plain_components, plain_fill

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())

    kept = stages["language"](spark, docs, small)
    said = {r["doc_id"] for r in docs.select("doc_id", "text").collect() if any(c.isalpha() for c in r["text"] or "")}
    assert kept.columns == columns and {i for i, _ in texts(kept)} <= said and kept.where("lang IS NULL").count() == 0

    one = stages["exact dedup"](spark, kept, small)
    groups = {}
    for i, t in texts(kept):
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    assert one.columns == columns and {i for i, _ in texts(one)} == {min(g)[1] for g in groups.values()}

    near = stages["near dedup"](spark, one, small)
    assert near.columns == columns and {i for i, _ in texts(near)} == {c for _, _, c in plain_components(texts(one), 5, 80)}

    mixed = stages["mix"](spark, near, small)
    rows = [(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in near.collect()]
    sizes, times = {}, {}
    for _, source, n in rows:
        sizes[source] = sizes.get(source, 0) + n
    for i, _ in texts(mixed):
        times[i] = times.get(i, 0) + 1
    taken = {s: sum(n * times.get(i, 0) for i, q, n in rows if q == s) for s in sizes}
    assert mixed.columns == columns and max(times.values()) <= 3
    for source, target in plain_fill(sizes).items():
        assert abs(taken[source] - target) <= max(n for _, q, n in rows if q == source)

    packed = stages["pack"](spark, mixed, small).collect()
    import public_tokenizers

    from tempora.llm.packing import Encoder

    encode = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in packed) == sum(len(encode(t or "")) // 4 + 1 for _, t in texts(mixed))
