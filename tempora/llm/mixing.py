"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source has a target number of words, which its documents share by length: a document's expected number of copies
grows with a power of its length, up to a cap. Whole copies of that number are allocated first, as certain ones; the
fractions are inclusion odds, different for documents of different length. The rest of the target, in words, is the fixed
size of a Pareto order sample: documents are ranked by random odds divided by inclusion odds, and the ranking is followed
until the size is reached.

The ranking of a source isn't sorted in one task. Ranks are cut into buckets of about BUCKET_DOCS documents; sums per
bucket find the one bucket of each source in which the size is reached. Only that bucket is walked in rank order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import ROW, columns_of, numbered, spool
from tempora.shipping import shipped

#: The weights that sources get in turn.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its size.
MOST_TIMES = 3
#: Expected copies of a document grow with this power of its length (of the power of two below it).
SIZE_POWER = 0.25
#: Documents that a bucket of ranks has on average.
BUCKET_DOCS = 2048
#: Up to so many rows of the plan (a source's documents of like length) it is broadcast; beyond, it is joined by a shuffle.
BROADCAST_PLAN = 100_000
#: Up to so many rows of boundary buckets (two numbers each) are broadcast to the documents; beyond, they are joined by a shuffle.
BROADCAST_EDGE = 2_000_000
#: Times that the boundary bucket is walked for documents that still fit.
WALKS = 4


def word_count(text: Column) -> Column:
    """Number of maximal runs of other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(parts: DataFrame, group: list[str], total: Column, cap: Column, weight: Column, tie: list[str]) -> DataFrame:
    """Adds share to `parts`: min(cap, level * weight) with one level for all parts of a group, so that shares add up to `total` (all caps, if these are less).

    This is where resharing the excess by weight ends. Parts in order of cap / weight: those that reach their cap are a
    prefix, so the level follows from running sums. Weights are positive.
    """
    by_cap = Window.partitionBy(*group).orderBy(cap / weight, *tie)
    before, onward, every = (by_cap.rowsBetween(a, b) for a, b in ((Window.unboundedPreceding, -1), (Window.currentRow, Window.unboundedFollowing), (Window.unboundedPreceding, Window.unboundedFollowing)))
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum(weight).over(onward)
    filled = parts.withColumn("_level", level).withColumn("_open", F.when(cap > F.col("_level") * weight, F.col("_level")))
    # the first part that stays below its cap has the level of all
    return filled.withColumn("share", F.least(cap.cast("double"), F.coalesce(F.first("_open", ignorenulls=True).over(every) * weight, cap.cast("double")))).drop("_level", "_open")


def water_fill(sources: DataFrame, weights=WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """Adds source_rank, weight and target to (source, source_size, n_docs): sources share all sizes by weight, each at most `most` times its size."""
    ranked = sources.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("all_sizes", F.sum("source_size").over(Window.partitionBy()))
    filled = fill(ranked, [], F.col("all_sizes"), F.lit(most) * F.col("source_size"), F.col("weight"), ["source_rank"])
    return filled.select("source", "source_size", "n_docs", "source_rank", "weight", F.col("share").alias("target"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """doc_id, source, size and klass (the power of two below the size) of every row, and `more` columns."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *more)
    return rows.withColumn("klass", F.length(F.bin("size")) - 1)


def drawn(rows: DataFrame, plan: DataFrame, few: bool, seed: int) -> DataFrame:
    """Rows of `rows` that have words, with what `plan` says of their source and class, and their rank_key and bucket.

    Each row is looked at by itself: whoever reads the documents again gets the same ranks.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    inclusion = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("odds")))
    found = rows.where("size > 0").join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("klass") == F.col("of_klass")))
    found = found.withColumn("rank_key", (u / (1 - u)) / (inclusion / (1 - inclusion)))
    # ranks from 0 to infinity as numbers from 0 to 1; near the end of the sample, at about a half, buckets are never denser than on average
    return found.withColumn("bucket", F.floor(F.col("rank_key") / (1 + F.col("rank_key")) * F.col("buckets"))).drop("of_source", "of_klass", "odds", "buckets")


def planned(sizes: DataFrame, seed: int, weights, most: int, size_power: float) -> tuple[DataFrame, DataFrame, bool]:
    """(plan, sources, few) for kept `sizes`: a row of whole copies, odds, last whole bucket, boundary bucket and room for each source and class; whether there are few enough to broadcast."""
    sources = spool(water_fill(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, most), "sources")
    classes = sizes.where("size > 0").groupBy(F.col("source").alias("of_source"), F.col("klass").alias("of_klass")).agg(F.sum("size").alias("words"))
    classes = classes.join(sources, F.col("of_source").eqNullSafe(F.col("source")))
    shared = fill(classes, ["source_rank"], F.col("target"), F.lit(most) * F.col("words"), F.pow(F.lit(2.0), F.col("of_klass") * F.lit(size_power)) * F.col("words"), ["of_klass"])
    times = F.col("share") / F.col("words")
    shared = shared.select("of_source", "of_klass", "source_rank", "target", "words", F.floor(times).alias("whole"), (times - F.floor(times)).alias("odds"), F.ceil(F.col("n_docs") / BUCKET_DOCS).alias("buckets"))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source_rank")))
    plan = spool(shared.withColumn("rest", rest).drop("words", "target"), "mix-plan")
    few = plan.count() <= BROADCAST_PLAN

    run = Window.partitionBy("source_rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = drawn(sizes, plan, few, seed).groupBy("source_rank", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    sums = sums.withColumn("upto", F.sum("words").over(run))
    begin = F.col("upto") - F.col("words")
    inside, edge = F.col("upto") <= F.col("rest"), (begin < F.col("rest")) & (F.col("upto") > F.col("rest"))
    ends = sums.groupBy(F.col("source_rank").alias("of_rank")).agg(F.max(F.when(inside, F.col("bucket"))).alias("last_whole"), F.max(F.when(edge, F.col("bucket"))).alias("edge_bucket"), F.max(F.when(edge, F.col("rest") - begin)).alias("room"))
    plan = spool(plan.drop("rest").join(ends, F.col("source_rank") == F.col("of_rank")).drop("of_rank"), "mix-ends")
    return plan, sources, few


def at_edge() -> Column:
    """Whether a drawn row lies in its source's boundary bucket."""
    return F.coalesce(F.col("bucket") == F.col("edge_bucket"), F.lit(False))


def plain_copies() -> Column:
    """Copies of a drawn row outside of boundary buckets."""
    return F.col("whole") + F.coalesce(F.col("bucket") <= F.col("last_whole"), F.lit(False)).cast("long")


def walked(edge: DataFrame, key: list[str]) -> DataFrame:
    """Rows of boundary buckets with `extra`: documents in rank order as far as they fit, then those after one that doesn't."""
    walk = Window.partitionBy("source_rank").orderBy("rank_key", "doc_id", "size", *key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = walk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = edge.withColumn("extra", F.lit(0).cast("long"))
    for _ in range(WALKS):
        fits = (F.col("extra") == 0) & (F.col("size") <= F.col("room"))
        edge = edge.withColumn("_upto", F.sum(F.when(fits, F.col("size")).otherwise(F.lit(0))).over(walk))
        edge = edge.withColumn("_took", fits & (F.col("_upto") <= F.col("room")))
        edge = edge.withColumn("room", F.col("room") - F.sum(F.when(F.col("_took"), F.col("size")).otherwise(F.lit(0))).over(whole)).withColumn("extra", F.when(F.col("_took"), F.lit(1)).otherwise(F.col("extra")).cast("long"))
    # one more document if it overshoots by less than what else would be missing
    spare = (F.col("extra") == 0) & (F.col("size") < 2 * F.col("room"))
    first = F.row_number().over(Window.partitionBy("source_rank").orderBy(F.when(spare, F.col("size")).asc_nulls_last(), "rank_key", "doc_id", *key))
    return edge.withColumn("_first", first).withColumn("extra", F.when(spare & (F.col("_first") == 1), F.lit(1)).otherwise(F.col("extra")).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights=WEIGHTS, most: int = MOST_TIMES, size_power: float = SIZE_POWER) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for every row of `docs`.

    Null texts and texts without words have size 0 and take 0 words. A null source is a source of its own, the last in
    order. The same ids and texts give the same mix in every run; rows that repeat an id are separate rows, those that
    repeat the size, too, have the same rank. Other columns are ignored whatever their names; an empty table gives an
    empty result.

    Expected copies of a document are at most `most` and in proportion to 2 ** (size_power * floor(log2(size))) below that. A document that
    is too large for what is left is passed over and the ranking is followed further, so a source misses its target by
    less than its boundary bucket's smallest document that isn't taken, or by the few words that WALKS walks leave.
    """
    sizes = spool(sized(docs, id_col, text_col, source_col), "sizes")
    plan, sources, few = planned(sizes, seed, weights, most, size_power)
    ranked = drawn(sizes, plan, few, seed)
    plain = ranked.where(~at_edge()).withColumn("copies", plain_copies())
    edge = walked(ranked.where(at_edge()), []).withColumn("copies", F.col("whole") + F.col("extra"))
    none = sizes.where("size = 0").withColumn("copies", F.lit(0).cast("long"))
    out = ["doc_id", "source", "size", "copies"]
    mixed = plain.select(*out).unionByName(edge.select(*out)).unionByName(none.select(*out))
    told = sources.select(F.col("source").alias("of_source"), "source_size", "target")
    mixed = mixed.join(F.broadcast(told) if few else told, F.col("source").eqNullSafe(F.col("of_source")))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("copies").cast("long").alias("copies"))


def repeat_by_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights=WEIGHTS, most: int = MOST_TIMES, size_power: float = SIZE_POWER) -> DataFrame:
    """`docs` with each row as often as the mix takes it (not at all, or up to `most` times); null and repeated ids are rows as others, other columns may have any name.

    Texts aren't shuffled: a row's copies follow from the plan, but for rows of the boundary buckets (about BUCKET_DOCS
    of each source), whose numbers and copies are joined.
    """
    rows = numbered(docs, "mix-rows")
    row = F.col(ROW).alias("row")
    sizes = spool(sized(rows, id_col, text_col, source_col, row), "sizes")
    plan, _, few = planned(sizes, seed, weights, most, size_power)
    edge = walked(drawn(sizes, plan, few, seed).where(at_edge()), ["row"])
    edge = spool(edge.select(F.col("row").alias("of_row"), (F.col("whole") + F.col("extra")).alias("edge_copies")), "mix-edge")
    few_edges = edge.count() <= BROADCAST_EDGE

    whole = sized(rows, id_col, text_col, source_col, row, F.struct(*columns_of(docs)).alias("document"))
    ranked = drawn(whole, plan, few, seed).join(F.broadcast(edge) if few_edges else edge, F.col("row") == F.col("of_row"), "left")
    copies = ranked.select("document", F.coalesce("edge_copies", plain_copies()).cast("int").alias("copies")).where("copies > 0")
    return copies.select("document", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("document.*")


@shipped
def op8_pareto_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")
