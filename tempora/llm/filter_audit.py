"""How quality filters interact: counts by what each row fails, for every order of applying the filters.

Four filters look at one text. The fifth removes a text that a row of smaller id has, too, and is settled by a
fingerprint-routed RDD. Each task keeps a chain of (whole text, smallest id) for every xxhash of the texts that it
reads; rows above the smallest id are settled there, so that a text with very many copies is sent once by a task, with
its smallest id. These go to the partition of their fingerprint, which holds the chains of all tasks (texts whose
fingerprints collide are told apart by their whole text) and settles the rest.

What a row fails is a mask of five bits. Masks are counted by `combineByKey` as a vector for each part, of which all
orders follow: the vectors, not the rows, meet.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import shuffle_partitions, spool
from tempora.shipping import shipped

#: The filters, in the order of the mask's bits.
FILTERS = "ABCDE"
#: Bytes of text that a task holds in chains before it sends them on, and that a partition of fingerprints should hold.
HELD_BYTES, ROUTED_BYTES = 16 << 20, 24 << 20

_COUNTS, _LETTERS = 3, bytes(range(0x41, 0x5B))
_MARKS = re.compile(r"[#$%&*|]")
_COPY = 1 << FILTERS.index("E")
_AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: str) -> int:
    """The bits of filters A to D that `text` fails."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes: ASCII white space only
    short = len(words) < 100
    repeated = 100 * len(set(words)) < 80 * len(words)
    loud = 100 * (len(data) - len(data.translate(None, _LETTERS))) > 10 * len(text)
    return short | repeated << 1 | loud << 2 | bool(_MARKS.search(text)) << 3


def routed(rows: Iterable, held_bytes: int = HELD_BYTES) -> Iterator[tuple]:
    """(key, record) of a task's rows (id, text, part).

    A record of two, (id, {(part, mask): rows}), is settled; its key only spreads it. One of three, (text, smallest id,
    {(part, mask): rows}), meets the chains of other tasks under the text's fingerprint.
    """
    chains: dict[int, list] = {}
    held = 0

    def flush() -> Iterator[tuple]:
        for key, chain in chains.items():
            for text, least, masks in chain:
                yield key, (text, least, masks)
        chains.clear()

    for i, text, part in rows:
        text = text or ""
        kind = (part or "", failures(text))
        if i is None:  # not above any id, nor below one
            yield xxhash.xxh64_intdigest(f"{kind}"), (None, {kind: 1})
            continue
        key = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
        chain = chains.setdefault(key, [])
        found = next((c for c in chain if c[0] == text), None)
        if found is None:
            chain.append([text, i, {kind: 1}])
            held += len(text)
            if held > held_bytes:
                yield from flush()
                held = 0
        elif i == found[1]:
            found[2][kind] = found[2].get(kind, 0) + 1
        elif i > found[1]:
            yield xxhash.xxh64_intdigest(str(i)), (i, {(kind[0], kind[1] | _COPY): 1})
        else:
            yield xxhash.xxh64_intdigest(str(found[1])), (found[1], {(p, m | _COPY): n for (p, m), n in found[2].items()})
            found[1:] = [i, {kind: 1}]
    yield from flush()


def settled(records: Iterable[tuple]) -> Iterator[tuple]:
    """(id, part, mask, rows) of all records of a partition of fingerprints."""
    chains: dict[int, list] = {}
    for key, record in records:
        if len(record) == 2:
            i, masks = record
            yield from ((i, p, m, n) for (p, m), n in masks.items())
            continue
        text, least, masks = record
        chain = chains.setdefault(key, [])
        found = next((c for c in chain if c[0] == text), None)
        if found is None:
            chain.append([text, least, masks])
            continue
        copies = None
        if least > found[1]:
            copies = (least, masks)
        elif least < found[1]:
            copies = (found[1], found[2])
            found[1:] = [least, masks]
        else:
            for kind, n in masks.items():
                found[2][kind] = found[2].get(kind, 0) + n
        if copies:
            yield from ((copies[0], p, m | _COPY, n) for (p, m), n in copies[1].items())
    for chain in chains.values():
        for _, least, masks in chain:
            yield from ((least, p, m, n) for (p, m), n in masks.items())


def _counted(mask: int, rows: int, good: bool, toxic: bool) -> np.ndarray:
    vector = np.zeros((1 << len(FILTERS), _COUNTS), dtype=np.int64)
    vector[mask] = rows, rows * good, rows * toxic
    return vector


def _add(vector: np.ndarray, row: tuple) -> np.ndarray:
    mask, rows, good, toxic = row
    vector[mask] += rows, rows * good, rows * toxic
    return vector


def orders(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """The rows of one part for all orders and steps, zeros included, from the counts of its masks."""
    masks = np.arange(1 << len(FILTERS))
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    fails = {f: (masks & b) > 0 for f, b in bit.items()}
    many = np.array([max(1, int(m).bit_count()) for m in masks])
    total = np.prod(np.arange(1, len(FILTERS) + 1))
    # of the filters that a row fails, each comes first in as many orders
    shapley = {f: int((vector[:, 0] * (total // many))[fails[f]].sum()) for f in FILTERS}
    for order in itertools.permutations(FILTERS):
        gone = np.zeros(len(masks), dtype=bool)
        for step, f in enumerate(order, 1):
            here = fails[f] & ~gone
            redundant = int(vector[fails[f] & gone, 0].sum())
            gone = gone | fails[f]
            removed, good, toxic = (int(x) for x in vector[here].sum(axis=0))
            yield part, "".join(order), step, int(vector[~gone, 0].sum()), removed, redundant, int(vector[bit[f], 0]), good, toxic, shapley[f]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", partitions: int | None = None) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row per part, order and step.

    Null texts count as empty, null parts as the empty string. A row is a copy if its text is that of a row of smaller
    id, so rows that repeat the smallest id are none; rows without an id are never copies and nobody's original. A
    document is good (toxic) if any row of `labels` with its id says so; one without labels is neither. Other columns
    are ignored. Without documents there are no parts and no rows. A task holds at most HELD_BYTES of texts (and one
    text) at a time, a partition of fingerprints its share of the different texts; `partitions` is by default such
    that a share is ROUTED_BYTES.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(part_col).cast("string").alias("part"))
    if partitions is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        partitions = max(shuffle_partitions(spark), -(-size // ROUTED_BYTES))
    apart = rows.rdd.mapPartitions(routed).partitionBy(partitions, lambda key: key).mapPartitions(settled)
    found = spool(spark.createDataFrame(apart, "id long, part string, mask int, n long", verifySchema=False), "failed-filters")
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    told = found.join(flags, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False)))
    vectors = told.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda r: _counted(*r), _add, lambda a, b: a + b, shuffle_partitions(spark))
    return spark.createDataFrame(vectors.flatMap(lambda kv: orders(*kv)), _AUDIT, verifySchema=False)


@shipped
def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All documents with their labels."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM t LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic, list_sum(list_transform(fails, lambda x: CAST(x AS INTEGER))) AS many FROM f GROUP BY part, fails),
s AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM s a, s b, s c, s d, s e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
g AS (SELECT o, i AS step, o[i] AS f, o[1 : i - 1] AS before FROM o, s),
x AS (
  SELECT part, o, step, f, n, good, toxic, many, fails[f] AS here, len(list_filter(before, lambda k: fails[k])) > 0 AS gone FROM g, m)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (here AND NOT gone), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (here AND gone), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (here AND many = 1), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (here AND NOT gone), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * (120 // greatest(many, 1))) FILTER (here), 0) AS BIGINT) AS shapley
FROM x GROUP BY part, o, step
"""
