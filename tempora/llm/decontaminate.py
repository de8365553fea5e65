"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

The index holds a posting (term, row, place) for every word of the documents that some benchmark item has, too. It is
divided by documents: each task writes the postings of its own rows, sorted by term, so that no posting is shuffled to
build it and a lookup of some terms reads only their stretches of each shard.

Items are cut into windows of words. A window's terms are ordered from the rarest one, by their counts in the index. The
postings of its rarest term, moved by the term's offset, are the places where it might begin; they are intersected with
the moved postings of its next rarest terms. What is left after RANKS terms is compared word by word with the document,
which makes the result exact. Windows with a term that no document has are given up at once. Only texts of rows that a
bitmap of hashed row numbers may hold are moved for that; the bitmap has a bound of its own, whatever the number of rows.

Tables of terms and windows are as large as the benchmark. They are written first, so that Catalyst knows their size and
broadcasts them only below its limit; beyond it the joins are shuffled, and AQE divides terms with very many postings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import ROW, numbered, spool
from tempora.shipping import shipped

#: Words of a window.
WINDOW = 10
#: Lists that are intersected before places are compared word by word.
RANKS = 3

#: Bits of the bitmap for each row in it, and at most (32 MB); a fuller one lets more rows through, but loses none.
BITS, MOST_BITS = 16, 1 << 28

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case: digits, letters and all that is not ASCII; none of a null."""
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.coalesce(F.array_remove(F.split(lower, _BETWEEN), ""), F.array().cast("array<string>"))


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """wid, words, ids of the different windows of all items: `size` words in a row, or all words of a shorter item.

    `ids` are the ids of the items that have the window, each once, a null id as one. Items without words have none.
    """
    runs = items.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    starts = runs.select("id", "all", F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - size, F.lit(0)))).alias("at"))
    cut = starts.select("id", F.slice("all", F.col("at") + 1, size).alias("words"))
    # collect_set leaves nulls out
    found = cut.groupBy("words").agg(F.array_distinct(F.transform(F.collect_list(F.struct("id")), lambda x: x["id"])).alias("ids"))
    return spool(found.select(F.monotonically_increasing_id().alias("wid"), "words", "ids"), "windows")


def build_index(rows: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """The postings (term, row, place) of `terms` (term, word) in `rows` with a column ROW; places count from 0."""
    words = rows.select(F.col(ROW).alias("row"), F.posexplode(words_of(F.col(text_col))).alias("place", "word"))
    return spool(words.join(terms, "word").select("term", "row", "place").sortWithinPartitions("term", "row", "place"), "postings")


def _terms(windows: DataFrame) -> DataFrame:
    words = windows.select(F.explode("words").alias("word")).distinct()
    return spool(words.select(F.monotonically_increasing_id().alias("term"), "word"), "terms")


def _rarest_first(windows: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """wid, ranked (array of term and offset, the rarest first) of the windows all of whose terms are in the index."""
    counts = spool(index.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term"), "term-counts")
    placed = windows.select("wid", F.size("words").alias("size"), F.posexplode("words").alias("offset", "word"))
    ranked = placed.join(counts, "word").groupBy("wid", "size").agg(F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("ranked"))  # a window's words
    return spool(ranked.where(F.size("ranked") == F.col("size")).select("wid", "ranked"), "ranked-windows")


def _places(index: DataFrame, ranked: DataFrame, ranks: int) -> DataFrame:
    """wid, row, start: where the moved postings of a window's `ranks` rarest terms meet."""
    first = F.col("ranked")[0]
    lists = ranked.select("wid", "ranked", first["term"].alias("term"), first["offset"].alias("offset"))
    found = index.join(lists, "term").select("wid", "row", (F.col("place") - F.col("offset")).alias("start"), "ranked").where("start >= 0")
    for k in range(1, ranks):
        found = spool(found, "places")
        # windows of fewer words have no further list
        nth = F.get("ranked", F.lit(k))
        asked = found.select("wid", "row", "start", "ranked", nth["term"].alias("term"), (F.col("start") + nth["offset"]).alias("place"))
        used = ranked.select(F.get("ranked", F.lit(k))["term"].alias("term")).where("term IS NOT NULL").distinct()
        lists = index.join(spool(used, "list-terms"), "term", "left_semi")
        met = asked.where("term IS NOT NULL").join(lists, ["row", "term", "place"], "left_semi").select("wid", "row", "start", "ranked")
        found = met.unionByName(asked.where("term IS NULL").select("wid", "row", "start", "ranked"))
    return found.select("wid", "row", "start")


def _perhaps(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` without most of those whose number isn't in `found` (row): a bitmap of hashes is broadcast, at most MOST_BITS."""
    bits = 1 << 15  # of one piece of the bitmap
    n = found.count()
    while bits < min(MOST_BITS, BITS * n):
        bits *= 2
    place = lambda row: F.pmod(F.xxhash64(row), F.lit(bits))
    pieces = found.select(place("row").alias("at")).groupBy(F.shiftright("at", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND((1 << 15) - 1)).alias("bitmap"))
    at = place(F.col(ROW))
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright(at, 3).bitwiseAND((1 << 12) - 1).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1
    return rows.join(F.broadcast(pieces), F.shiftright(at, 15) == F.col("piece")).where(set_).drop("piece", "bitmap")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, ranks: int = RANKS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of `docs`.

    A word is hit if it lies in any occurrence of a window of any item (see windows_of); an item counts if one of its
    windows occurs, items of one id as one. `items_sha256` is of the ids in order of their strings, comma-joined, a null
    id as an empty string; of no item, that of the empty string. A null or empty text has no words. Rows that repeat an
    id are rows of their own. Other columns are ignored; without documents the result is empty, without items nothing
    is hit. Documents are whole: a text of any length is one row, and so are the places found in it.
    """
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "decontaminate-rows")
    windows = windows_of(items, item_id, item_text, size)
    terms = _terms(windows)
    index = build_index(rows, terms)
    places = _places(index, _rarest_first(windows, terms, index), ranks)
    starts = places.groupBy("row", "wid").agg(F.sort_array(F.collect_list("start")).alias("starts"))  # of one document
    asked = spool(starts.join(windows, "wid").groupBy("row").agg(F.collect_list(F.struct("words", "ids", "starts")).alias("asked")), "places-of-rows")
    texts = _perhaps(rows, asked.select("row")).join(asked.withColumnRenamed("row", ROW), ROW)

    def compared(words: Column) -> Column:
        """The windows of a row with the places at which its words are those of the window."""
        held = F.transform("asked", lambda w: F.struct(w["ids"].alias("ids"), F.size(w["words"]).alias("size"), F.filter(w["starts"], lambda s: F.slice(words, s + 1, F.size(w["words"])) == w["words"]).alias("starts")))
        return F.filter(held, lambda w: F.size(w["starts"]) > 0)

    seen = texts.select(ROW, _let(words_of(F.col("text")), compared).alias("hits"))
    spans = F.array_sort(F.flatten(F.transform("hits", lambda h: F.transform(h["starts"], lambda s: F.struct(s.alias("at"), (s + h["size"]).alias("end"))))))
    covered = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["at"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")))
    told = seen.select(ROW, covered["n"].alias("n_hit"), F.array_distinct(F.flatten(F.transform("hits", lambda h: h["ids"]))).alias("ids"))
    names = F.array_join(F.array_sort(F.transform("ids", lambda i: F.coalesce(i.cast("string"), F.lit("")))), ",")
    told = spool(told.select(ROW, "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256")), "hits")
    sizes = rows.select(ROW, "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return sizes.join(told, ROW, "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def proximity(docs: DataFrame, items: DataFrame, span: int, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """doc_id, item_id, place: documents that have all different words of a window within `span` words, in any order.

    `place` is the first word of the first such stretch that begins with one of them. The postings of a window's rarest
    term are its anchors; those without the other terms' postings less than `span` words away are dropped, and of what
    is left the stretches are tried. An anchor gathers less than 2 * span places. Null texts, ids and empty tables as
    in contamination(); rows that repeat an id give one row each.
    """
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "proximity-rows")
    windows = windows_of(items, item_id, item_text, size)
    terms = _terms(windows)
    index = build_index(rows, terms)
    ranked = _rarest_first(windows, terms, index).select("wid", F.array_distinct(F.transform("ranked", lambda t: t["term"])).alias("all"))
    anchors = index.join(ranked.select("wid", "all", F.col("all")[0].alias("term")), "term").select("wid", "row", "all", F.col("place").alias("anchor"))
    block = lambda c: F.floor(c / F.lit(span))
    # a place less than `span` words away lies in the anchor's block or one beside it
    asked = anchors.select("*", F.explode(F.sequence(block(F.col("anchor")) - 1, block(F.col("anchor")) + 1)).alias("block")).select("*", F.explode("all").alias("term"))
    near = asked.join(index.withColumn("block", block(F.col("place"))), ["row", "term", "block"]).where(F.abs(F.col("place") - F.col("anchor")) < span)
    held = near.groupBy("wid", "row", "anchor").agg(F.first(F.size("all")).alias("n"), F.collect_list(F.struct("place", "term")).alias("held")).where(F.size("held") >= F.col("n"))
    whole = lambda s: F.size(F.array_distinct(F.transform(F.filter("held", lambda h: (h["place"] >= s) & (h["place"] < s + span)), lambda h: h["term"]))) == F.col("n")
    starts = held.select("wid", "row", F.array_min(F.filter(F.transform("held", lambda h: h["place"]), whole)).alias("place")).where("place IS NOT NULL")
    found = starts.join(windows.select("wid", F.explode("ids").alias("item_id")), "wid").groupBy("row", "item_id").agg(F.min("place").alias("place"))
    return found.join(rows.select(F.col(ROW).alias("row"), "doc_id"), "row").select("doc_id", "item_id", F.col("place").cast("long").alias("place"))


@shipped
def op11_positional_index(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
place AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hit AS (
  SELECT r, i, win.n, item_id FROM (
    SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM place, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)) x JOIN win ON x.n = win.n AND x.s = win.s),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
