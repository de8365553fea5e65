"""N-gram Jaccard join by grouped prefixes.

A text's set is its distinct word shingles, as 64-bit hashes; texts with equal sets are one class. All sets are sorted in
one order, rare shingles first, and a set's prefix is so long that two sets similar enough share a shingle of their
prefixes.

Most sets share too few shingles with any other to have a link at all. These go first: each set sends the shingles of
smallest hash, somewhat more than a prefix in hash order, and stays open only if enough of them are in another set. Only
of the open sets every shingle is counted, exactly, and their prefixes are in order of these counts. Shingles that no
other open set has take places in the prefix but aren't sent on.

Sets with the same prefix (of shingles that others have, too) and the same size form a group. Groups that share a prefix
shingle meet, and pairs of groups are filtered by size and by the places of the shared shingle: it has to stand so early
in both that enough others can follow. Only pairs of groups that pass are expanded to their members, which are verified
on whole sets.

What is asked for is which classes links connect, so pairs are verified in rounds: first a group's members with one of
them, then each group with the group that it shares most prefix shingles with; then, as long as a round finds links
enough, with a few hubs from other components, other ones each time. What is connected is joined after each round, and
only pairs across what isn't connected yet go on, all of them in the last round. No link between different components
can be missed, and a cluster of many near copies doesn't become all its pairs.

Before two sets are compared their parity bitmaps are: each shingle flips one bit, so bits that differ are a lower bound
of the shingles that only one of the two has. Pairs with too many of them can't link and aren't verified.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import ROW, columns_of, frugal, numbered, planned_bytes, release, shuffle_partitions, small_batches, spool
from tempora.llm.components import components
from tempora.llm.shingles import sets_of
from tempora.shipping import shipped
from tempora.tables import BROADCAST_ROWS

#: Input bytes whose sent shingles one bucket holds, about.
BUCKET_BYTES = 16 << 20
#: Shingles that a task gathers before it deals them out: in the first pass, and of open sets.
FLUSH, OPEN_FLUSH = 1_000_000, 400_000
#: Up to so many ids are broadcast to pick their texts; beyond, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Rounds in which groups meet hubs, at most, before the round of all pairs; hubs of a shingle after the first round.
STAR_ROUNDS, HUBS = 8, 8
#: The rounds of hubs end when fewer than one in so many verified pairs is a link.
LEAST_YIELD = 10
#: Longs of a set's parity bitmap.
BITMAP_LONGS = 16
#: Stands for any class where a shingle is known to be in several sets.
SEVERAL = -1

_SCANNED = "kind int, bucket int, doc_id long, text_key long, n int, cls long, data binary"


def least_shared(n: int, percent: int) -> int:
    """Shingles of a set of n that a set with the similarity shares at least."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of n of which sets with the similarity share one."""
    return n - least_shared(n, percent) + 1


def depth(n: int, percent: int) -> int:
    """So many shared shingles the first pass asks for: the prefix is longer by as many."""
    return max(1, (n - least_shared(n, percent)) // 2)


def _least_depth(n: str, percent: int) -> Column:
    """The depth of the smallest set that may be similar to one of n: of the shared shingles of smallest hash at least so many are in both prefixes."""
    return F.expr(f"greatest(1, (({percent}L * {n} + 99) div 100 - ({percent}L * (({percent}L * {n} + 99) div 100) + 99) div 100) div 2)")


def bitmap(found: np.ndarray) -> list[int]:
    """The parity bitmap of a set's 64-bit hashes, as longs."""
    parity = np.bincount((found & np.uint64(64 * BITMAP_LONGS - 1)).astype(np.int64), minlength=64 * BITMAP_LONGS) & 1
    return np.packbits(parity.astype(np.uint8)).view("<i8").tolist()


def may_link(percent: int, n: str = "n", m: str = "m", x: str = "bits", y: str = "other_bits") -> Column:
    """Whether sets of sizes n and m with bitmaps x and y may be similar enough: of similar ones so many shingles at most are in one set only."""
    apart = " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(BITMAP_LONGS))
    return F.expr(f"{100 + percent}L * ({apart}) <= {100 - percent}L * ({n} + {m})")


def class_of(found: np.ndarray) -> int:
    """The class of a set, by 64 bits of a hash of all its shingles."""
    cls = int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)
    return cls if cls != SEVERAL else cls - 1


def _dealt(where: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, rows, columns one behind another as bytes), rows by `where`. Of each column all first bytes come first, then all second ones: where they are alike, the shuffle's compression makes them small."""
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[b] : cuts[b + 1]]
        yield b, len(at), b"".join(np.ascontiguousarray(c[at]).view(np.uint8).reshape(len(at), -1).T.tobytes() for c in columns)


def _undealt(pieces: pd.Series, *types: str) -> list[np.ndarray]:
    width = sum(np.dtype(t).itemsize for t in types)
    out: list[list[np.ndarray]] = [[] for _ in types]
    for data in pieces:
        n, at = len(data) // width, 0
        for k, t in enumerate(types):
            size = n * np.dtype(t).itemsize
            planes = np.frombuffer(data, dtype=np.uint8, count=size, offset=at).reshape(-1, n)
            out[k].append(np.ascontiguousarray(planes.T).view(t).reshape(n))
            at += size
    return [np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in zip(out, types)]


def _begins(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where one of the keys changes."""
    new = np.ones(len(sorted_keys[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for key in sorted_keys:
            new[1:] |= key[1:] != key[:-1]
    return new


def _part(classes: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(classes, buckets).astype(np.int64)


def _scanned(texts: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """Rows of kind 0, one for each text; of kind 1, sent shingles (32 bits of them, class) by bucket; of kind 2, shared shingles counted by class."""
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int32()), ("cls", pa.int64()), ("data", pa.binary())])

    def packed(kind: int, pieces: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        rows = [(kind, b, None, None, n, None, data) for b, n, data in pieces]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def deal(prefixes: list[np.ndarray], classes: list[int]) -> Iterator[pa.RecordBatch]:
        names = np.array(classes, dtype=np.int64)
        tokens = np.concatenate(prefixes)
        of = np.repeat(np.arange(len(names)), [len(x) for x in prefixes])
        order = np.argsort(tokens, kind="stable")
        tokens, of = tokens[order], of[order]
        new = _begins(tokens)
        sizes = np.diff(np.concatenate((np.flatnonzero(new), [len(new)])))
        shared = np.repeat(sizes > 1, sizes)
        have = np.bincount(of[shared], minlength=len(names))
        some = np.flatnonzero(have)
        yield from packed(2, _dealt(_part(names[some], buckets), buckets, names[some], have[some].astype("<u4")))
        sent = ~shared | new  # of a shingle that several sets of this task have, one row
        tokens, cls = tokens[sent], np.where(shared[sent], SEVERAL, names[of[sent]])
        yield from packed(1, _dealt((tokens % np.uint64(buckets)).astype(np.int64), buckets, (tokens >> np.uint64(32)).astype("<u4"), cls.astype("<i8")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes: list[np.ndarray] = []
        classes: dict[int, None] = {}
        held = 0
        for batch in batches:
            sizes, names = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for row, found in sets_of(batch.column(2), k):
                n = len(found)
                if not n:
                    continue
                sizes[row], names[row] = n, class_of(found)
                if int(names[row]) not in classes:
                    classes[int(names[row])] = None
                    prefixes.append(found[: min(n, prefix_length(n, percent) - 1 + depth(n, percent))].copy())
                    held += len(prefixes[-1])
            nothing = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int32)), nothing, batch.column(0), batch.column(1), pa.array(sizes), pa.array(names), pa.nulls(batch.num_rows, pa.binary())], schema=schema)
            if held >= FLUSH:
                yield from deal(prefixes, list(classes))
                prefixes, classes, held = [], {}, 0
        if prefixes:
            yield from deal(prefixes, list(classes))

    return texts.select("doc_id", "text_key", "text").mapInArrow(frugal(run), _SCANNED)


def _open_classes(scanned: DataFrame, classes: DataFrame, percent: int, buckets: int) -> DataFrame:
    """The classes of which enough of the sent shingles are in another set, too."""

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        tokens, cls = _undealt(part["data"], "<u4", "<i8")
        order = np.lexsort((cls, tokens))
        tokens, cls = tokens[order], cls[order]
        once = _begins(tokens, cls)
        tokens, cls = tokens[once], cls[once]
        sizes = np.diff(np.concatenate((np.flatnonzero(_begins(tokens)), [len(tokens)])))
        names, have = np.unique(cls[np.repeat(sizes > 1, sizes) & (cls != SEVERAL)], return_counts=True)
        return pd.DataFrame([(b, data) for b, _, data in _dealt(_part(names, buckets), buckets, names, have.astype("<u4"))], columns=["bucket", "data"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        cls, have = _undealt(part["data"], "<i8", "<u4")
        names, of = np.unique(cls, return_inverse=True)
        return pd.DataFrame({"name": names, "have": np.bincount(of, weights=have, minlength=len(names)).astype(np.int64)})

    met = scanned.where("kind = 1").select("bucket", "data").groupBy("bucket").applyInPandas(meet, "bucket int, data binary")
    have = met.unionByName(scanned.where("kind = 2").select("bucket", "data")).groupBy("bucket").applyInPandas(add, "name long, have long")
    return classes.join(have, F.col("cls") == F.col("name")).where(F.col("have") >= _least_depth("n", percent)).select("cls", "text_key")


def _candidates(texts: DataFrame, chosen: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """cls, n, before, grp, tokens, bits, members: the open sets of which enough shingles are in another open set, each once.

    `tokens` are the shingles of the prefix that others have, in order; `before` so many that no other has stand before
    them; `bits` is the parity bitmap and `members` the whole set.
    """
    few = chosen.count() <= BROADCAST_IDS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, sets = TaskContext.get().partitionId() << 32, 0, {}

        def flushed() -> pa.RecordBatch:
            row = (number, np.array(list(sets), dtype="<i8").tobytes(), np.array([len(x) for x in sets.values()], dtype="<i4").tobytes(), b"".join(x.tobytes() for x in sets.values()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["flush", "classes", "sizes", "tokens"])

        for batch in batches:
            for _, found in sets_of(batch.column(0), k):
                name = class_of(found)
                if name not in sets:
                    sets[name] = found.copy()
                    held += len(found)
                if held >= OPEN_FLUSH:
                    yield flushed()
                    number, held, sets = number + 1, 0, {}
        if sets:
            yield flushed()

    picked = texts.join(F.broadcast(chosen) if few else chosen, "text_key", "left_semi").select("text")
    flushes = spool(picked.mapInArrow(frugal(gather), "flush long, classes binary, sizes binary, tokens binary"), "open-sets", "none")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for flush, data in zip(batch["flush"], batch["tokens"]):
                tokens, counts = np.unique(np.frombuffer(data, dtype="<u8"), return_counts=True)
                pieces = _dealt((tokens % np.uint64(buckets)).astype(np.int64), buckets, tokens, counts.astype("<u4"))
                yield pd.DataFrame([(b, flush, piece) for b, _, piece in pieces], columns=["bucket", "flush", "data"])

    def tally(part: pd.DataFrame) -> pd.DataFrame:
        """For each piece its shingles that several sets have, with their counts over all."""
        tokens, counts = _undealt(part["data"], "<u8", "<u4")
        distinct, of = np.unique(tokens, return_inverse=True)
        total = np.bincount(of, weights=counts, minlength=len(distinct)).astype("<u4")[of]
        rows, at = [], 0
        for flush, data in zip(part["flush"], part["data"]):
            n = len(data) // 12
            several = total[at : at + n] > 1
            rows += [(flush, piece) for _, _, piece in _dealt(np.zeros(int(several.sum()), np.int64), 1, tokens[at : at + n][several], total[at : at + n][several])]
            at += n
        return pd.DataFrame(rows, columns=["flush", "data"])

    def order(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        rows = []
        known, counts = _undealt(replies["data"], "<u8", "<u4")
        by_token = np.argsort(known, kind="stable")
        known, counts = known[by_token], counts[by_token]
        for flush, classes, sizes, tokens in zip(own["flush"], own["classes"], own["sizes"], own["tokens"]):
            every, at = np.frombuffer(tokens, dtype="<u8"), 0
            place = np.minimum(np.searchsorted(known, every), max(0, len(known) - 1))
            df = np.where(known[place] == every, counts[place], 1) if len(known) else np.ones(len(every), np.uint32)
            for cls, n in zip(np.frombuffer(classes, dtype="<i8").tolist(), np.frombuffer(sizes, dtype="<i4").tolist()):
                found, often = every[at : at + n], df[at : at + n]
                at += n
                several = often > 1
                before = n - int(several.sum())
                if before > n - least_shared(n, percent):
                    continue  # too few shingles are left for a link
                mine = found[several]
                prefix = mine[np.lexsort((mine, often[several]))[: prefix_length(n, percent) - before]]
                group = hashlib.blake2b(n.to_bytes(8, "little") + before.to_bytes(8, "little") + prefix.tobytes(), digest_size=8).digest()
                rows.append((flush, cls, n, before, int.from_bytes(group, "little", signed=True), prefix.view(np.int64), bitmap(found), found.tobytes()))
        return pd.DataFrame(rows, columns=["flush", "cls", "n", "before", "grp", "tokens", "bits", "members"])

    pieces = flushes.select("flush", "tokens").mapInPandas(frugal(count), "bucket int, flush long, data binary")
    replies = pieces.groupBy("bucket").applyInPandas(tally, "flush long, data binary")
    ordered = flushes.groupBy("flush").cogroup(replies.groupBy("flush")).applyInPandas(order, "flush long, cls long, n int, before int, grp long, tokens array<long>, bits array<long>, members binary")
    ordered = spool(ordered, "candidates", "none")
    # rows of one id and text may be in several flushes
    again = ordered.groupBy("cls").agg(F.min("flush").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    if again.head(1):
        ordered = spool(ordered.join(again.select(F.col("cls").alias("of"), "first"), F.col("cls") == F.col("of"), "left").where("first IS NULL OR flush = first"), "candidates", "none")
    return ordered.select("cls", "n", "before", "grp", "tokens", "bits", "members")


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough. Sets of b travel once for each pair, sets of a once."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                both = np.concatenate((a, b))
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    keep.append(row)
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    small = F.broadcast if pairs.count() <= BROADCAST_IDS else lambda x: x
    left = sets.join(small(pairs.select("a").distinct()), F.col("cls") == F.col("a")).select("a", F.col("members").alias("x"))
    right = sets.join(small(pairs), F.col("cls") == F.col("b")).select("a", "b", F.col("members").alias("y"))
    return right.join(left, "a").select("a", "b", "x", "y").mapInArrow(frugal(similar), "a long, b long")


def _links(candidates: DataFrame, percent: int) -> DataFrame | None:
    """node, component: what links between the candidates connect."""
    spark = candidates.sparkSession
    # sets of n and m need this overlap
    need = lambda n, m: f"(({percent}L * ({n} + {m}) + {100 + percent - 1}) div {100 + percent})"
    # a group's sets share at most what comes after its prefix's own shingles
    sets, members = candidates.select("cls", "members"), candidates.select("cls", "grp", "n", "bits", F.expr(f"before + {need('n', 'n')} <= n").alias("inside"))
    first = candidates.select("grp", "n", "before", "tokens").dropDuplicates(["grp"])
    runs = first.select("grp", "n", "before", F.posexplode("tokens").alias("pos", "token")).select("token", "grp", "n", (F.col("before") + F.col("pos")).alias("place"))
    met = runs.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    runs = spool(runs.join(met, "token"), "runs", "none")
    members = spool(members, "members", "none")

    # the first shingle that two sets share has to leave room for their overlap in both
    fits = F.expr(f"100L * least(n, m) >= {percent}L * greatest(n, m) AND place + {need('n', 'm')} <= n AND other_place + {need('n', 'm')} <= m")
    apart = F.expr("NOT (low = high AND low = other_low AND low = other_high)")
    # a shuffle of few rows starts as many tasks as one of many
    near = lambda rows, by: F.broadcast(rows) if by.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows
    place, tested, last = None, None, False
    for turn in range(STAR_ROUNDS + 2):
        last = last or turn > STAR_ROUNDS
        slots = 1 if turn < 2 else HUBS
        slot = lambda component: F.pmod(F.xxhash64(F.lit(-turn), component), F.lit(slots))  # noqa: B023, E731
        placed = members.withColumn("at", F.col("cls"))
        if place is not None:
            placed = members.join(near(place, place), F.col("cls") == F.col("node"), "left").select("cls", "grp", "n", "bits", "inside", F.coalesce("component", "cls").alias("at"))
        one = F.min(F.struct(F.xxhash64(F.lit(turn), "cls").alias("h"), F.col("cls").alias("hub"), F.col("at").alias("hub_at"), F.col("n").alias("m"), F.col("bits").alias("other_bits")))
        state = placed.groupBy("grp").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.max("inside").alias("inside"), one.alias("one")).select("grp", "low", "high", "inside", "one.hub", "one.hub_at", "one.m", "one.other_bits")
        state = spool(state, "groups", "none")
        open_runs = runs.join(near(state.select("grp", "low", "high"), state), "grp")
        mixed = open_runs.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("token")
        open_runs = open_runs.join(mixed, "token")
        unsettled = state.where("low < high AND inside").select("grp")
        if not last:  # inside groups, each member with a hub of each slot
            within = placed.join(unsettled, "grp")
            hubs = within.groupBy("grp", slot("at").alias("slot")).agg(one.alias("x")).select("grp", "x.hub", "x.hub_at", "x.m", "x.other_bits")
            pairs = within.join(hubs, "grp").where((F.col("at") != F.col("hub_at")) & may_link(percent)).select(F.col("hub").alias("a"), F.col("cls").alias("b"))
        if turn and not last:
            # a shingle's hub: the group with fewest rarer shingles, which is nearest to what a cluster shares; in even rounds any
            lead = F.col("place") if turn % 2 else F.expr(f"place + {need('n', 'n')} > n").cast("int")
            rank = F.struct(lead.alias("lead"), F.xxhash64(F.lit(turn), "grp").alias("h"), F.col("grp").alias("other"), F.col("n").alias("m"), F.col("place").alias("other_place"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
            # slots by component, so that a large one doesn't take all hubs
            hubs = open_runs.groupBy("token", slot("low").alias("slot")).agg(F.min(rank).alias("x")).select("token", "slot", "x.*")
            shared = open_runs.join(hubs, "token").where((F.col("grp") != F.col("other")) & apart & fits).groupBy("grp", "slot", "other").agg(F.count(F.lit(1)).alias("c"))
            chosen = shared.groupBy("grp", "slot").agg(F.max(F.struct("c", "other")).alias("x")).select("grp", F.col("x.other").alias("other"))
            hub = state.select(F.col("grp").alias("other"), "hub", "hub_at", "m", "other_bits")
            across = placed.join(chosen, "grp").join(hub, "other").where((F.col("at") != F.col("hub_at")) & may_link(percent))
            pairs = pairs.unionByName(across.select(F.col("hub").alias("a"), F.col("cls").alias("b")))
        elif last:
            other = open_runs.select("token", F.col("grp").alias("other"), F.col("n").alias("m"), F.col("place").alias("other_place"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
            grouped = open_runs.join(other, "token").where((F.col("grp") < F.col("other")) & apart & fits).select("grp", "other").distinct()
            grouped = grouped.unionByName(unsettled.select("grp", F.col("grp").alias("other")))
            others = placed.select(F.col("grp").alias("other"), F.col("cls").alias("hub"), F.col("at").alias("hub_at"), F.col("n").alias("m"), F.col("bits").alias("other_bits"))
            pairs = placed.join(grouped, "grp").join(others, "other").where((F.col("at") != F.col("hub_at")) & may_link(percent)).select(F.col("hub").alias("a"), F.col("cls").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = spool(pairs, "pairs", "none")
        verified = pairs.count()
        found = 0
        if verified:
            tested = pairs if tested is None else tested.unionByName(pairs)
            links = spool(_verified(sets, pairs, percent), "links", "none")
            found = links.count()
        if found:  # what was connected before counts as edges to its component
            before = links if place is None else links.unionByName(place.select(F.col("node").alias("a"), F.col("component").alias("b")))
            place = spool(components(before), "components", "none")
        release(spark)
        if last:
            break
        last = turn > 1 and LEAST_YIELD * found < max(1, verified)
    return place


def classes_and_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for every row of `docs`.

    ASCII letters are lower-cased; words are runs of other than ASCII white space. Null texts and texts without words
    have no shingle and no link: class and component are their own id. Texts of fewer words than a shingle have one
    shingle of all of them. Rows are told apart by id and text, so rows of one id and different texts are each compared,
    and class and component are the smallest id of theirs; they are null if only rows without an id are in them. Other
    columns are ignored; an empty table gives an empty result. Shingles and sets are compared by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("text_key"), text.alias("text"))
    buckets = max(shuffle_partitions(docs.sparkSession), math.ceil(planned_bytes(texts) / BUCKET_BYTES))
    scanned = spool(_scanned(texts, words, percent, buckets), "sets", "none")
    rows = scanned.where("kind = 0").select("doc_id", "text_key", "n", "cls")
    filled = rows.where("n > 0")
    classes = spool(filled.groupBy("cls").agg(F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.min("doc_id").alias("class_id")), "classes", "none")
    chosen = spool(_open_classes(scanned, classes, percent, buckets), "open", "none")
    candidates = _candidates(texts, chosen, words, percent, buckets)
    release(docs.sparkSession)
    place = _links(candidates, percent)

    named = classes.select("cls", "class_id", F.col("cls").alias("component"))
    if place is not None:
        named = classes.join(place, F.col("cls") == F.col("node"), "left").select("cls", "class_id", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "component").select(F.col("cls").alias("name"), "class_id", "component_id")
    linked = filled.join(named, F.col("cls") == F.col("name")).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class_id", "component_id")
    empty = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of `docs`, with all its columns: the one with the smallest id, null ids last.

    Rows are compared as rows, so that null ids are compared too and rows of one id and different texts stay apart.
    """
    rows = numbered(docs, "near-rows")
    found = classes_and_components(rows, ROW, text_col, words, percent).select(F.col("doc_id").alias(ROW), "component_id")
    rank = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(ROW).alias(ROW))
    kept = rows.select(ROW, id_col).join(found, ROW).groupBy("component_id").agg(F.min(rank).alias("best")).select(F.col(f"best.{ROW}").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(*columns_of(docs))


@shipped
def op10_grouped_prefix(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return classes_and_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
  FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(doc_id, other) AS (
  SELECT a, b FROM l
  UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, least(s.doc_id, min(r.other)) AS component_id
FROM s LEFT JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(s.sh)
"""
