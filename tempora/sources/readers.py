"""Readers of the datasets. Every row gets rec_ord, its place in the input: files by path, lines by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora import ontology, schemas
from tempora.functions.coords import safe_float
from tempora.functions.text import alias_key, norm, norm_name


def with_order(rows: DataFrame) -> DataFrame:
    """`rows` read from files with rec_ord from 0: counts per split give each split its start, rows are numbered inside.

    The one window without a partition runs over the table of splits, not over rows.
    """
    placed = rows.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()})
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy("_file", "_block").orderBy("_row")
    numbered = placed.withColumn("_i", F.row_number().over(inside))
    return numbered.join(starts.drop("_n"), ["_file", "_block"]).withColumn("rec_ord", F.col("_start") + F.col("_i") - 1).drop("_file", "_block", "_row", "_i", "_start")


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped. A line that isn't JSON fails; with `strict` so does one that isn't an object, and the error names its number."""
    lines = with_order(spark.read.text(path)).where(F.trim("value") != "")
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    bad = F.col("v").isNull()
    if strict:
        bad = bad | ~F.ltrim("value").startswith("{")
    said = F.concat(F.lit(f"invalid JSON line in {path}: "), (F.col("rec_ord") + 1).cast("string"))
    checked = F.when(bad, F.raise_error(said).cast("string")).otherwise(F.col("value"))
    return parsed.select("rec_ord", F.from_json(checked, schema).alias("x")).select("rec_ord", "x.*")


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, quoted cells may span lines; columns that the file lacks are null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns], "_metadata")
    return with_order(have).drop("_metadata")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def aliases(spark: SparkSession, path: str | None = None) -> DataFrame:
    """alias (as key), canonical_name, canonical_type: the built-in ones, replaced by those of the file, of which the last counts."""
    built_in = spark.createDataFrame([(i - len(ontology.BUILTIN_ALIASES), *row) for i, row in enumerate(ontology.BUILTIN_ALIASES)], "rec_ord long, alias string, canonical_name string, canonical_type string")
    rows = built_in
    if path and _exists(spark, path):
        rows = built_in.unionByName(csv(spark, path, ["alias", "canonical_name", "canonical_type"]).select("rec_ord", "alias", "canonical_name", "canonical_type"))
    keyed = rows.select("rec_ord", alias_key("alias").alias("alias"), norm_name("canonical_name").alias("canonical_name"), F.nullif(norm_name("canonical_type"), F.lit("")).alias("canonical_type"))
    kept = keyed.where("alias <> '' AND canonical_name <> ''")
    return kept.groupBy("alias").agg(F.max_by(F.struct("canonical_name", "canonical_type"), "rec_ord").alias("x")).select("alias", "x.*")


def geocode_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Overrides as geocode records; bad numbers are null, the name stands in for a missing display name."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schemas.GEOCODE_RECORD)
    rows = csv(spark, path, ["query", "latitude", "longitude", "display_name", "source", "notes"]).where(F.coalesce("query", F.lit("")) != "")
    filled = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    none = lambda t: F.lit(None).cast(t)
    rows = rows.select(
        "rec_ord", "query", safe_float("latitude").alias("latitude"), safe_float("longitude").alias("longitude"), filled("display_name", F.col("query")).alias("display_name"), filled("source", F.lit("override")).alias("source"),
        none("string").alias("osm_type"), none("string").alias("osm_category"), none("string").alias("osm_addresstype"), none("double").alias("raw_importance"), F.nullif("notes", F.lit("")).alias("notes"),
    )
    columns = [c.split()[0] for c in schemas.GEOCODE_RECORD.split(", ")]
    return rows.groupBy(norm("query").alias("k")).agg(F.max_by(F.struct(*columns), "rec_ord").alias("x")).select("x.*")


def geocode_cache(spark: SparkSession, path: str) -> DataFrame:
    """query_key and record of a cache file: one JSON object by normalised query."""
    record = "struct<" + schemas.GEOCODE_RECORD.replace(" ", ":").replace(",:", ",") + ">"
    if not _exists(spark, path):
        return spark.createDataFrame([], f"query_key string, {schemas.GEOCODE_RECORD}")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{record}>")).alias("query_key", "x")).where("x IS NOT NULL").select("query_key", "x.*")


def geocode_review(spark: SparkSession, path: str) -> DataFrame:
    """The geocode review table with numbers as numbers."""
    rows = csv(spark, path, schemas.GEOCODE_REVIEW_COLUMNS)
    numbers = [c for c in schemas.GEOCODE_REVIEW_COLUMNS if c.endswith("itude")]
    return rows.withColumns({c: safe_float(c) for c in numbers})


def article_ids(spark: SparkSession, path: str) -> DataFrame:
    """article_id and ord of a file, each id once at its first place: a JSON array of ids or objects, JSON lines, or one id a line (mixed with JSON lines)."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    array = F.transform(F.from_json("t", "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.article_id"), F.when(~x.startswith("{"), x)))
    line = lambda x: F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.article_id"), F.raise_error(F.lit(f"missing article_id in {path}")).cast("string"))).otherwise(x)
    lines = F.transform(F.filter(F.transform(F.split("t", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), line)
    found = whole.select(F.posexplode(F.when(F.col("t").startswith("["), array).otherwise(lines)).alias("ord", "article_id"))
    return found.where("article_id IS NOT NULL").groupBy("article_id").agg(F.min("ord").alias("ord"))


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """article_id of the records that an earlier run left at `path` (none if there is no such folder); a torn line names none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "article_id string")
    return spark.read.text(path).select(F.get_json_object("value", "$.article_id").alias("article_id")).where("article_id IS NOT NULL")


def json_files(spark: SparkSession, path: str, pattern: str, schema: str, limit: int | None = None) -> DataFrame:
    """A row for each JSON file, in order of file name."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("filename"), F.from_json("value", schema).alias("x"))
    rows = files.orderBy("filename")
    return (rows.limit(limit) if limit else rows).select("filename", "x.*")
