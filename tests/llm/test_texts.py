"""Operators on documents against brute force, on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tempora.llm import common, components, exact_dedup, language, mixing, ngram_join, packing, shingles, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, parts=3):
    """Documents with columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA).repartition(parts)
    return df.withColumns({"norm": F.lit("x"), "hash": F.lit(1), "kept": F.lit(False), "token": F.lit(2), "size": F.lit(3), "bucket": F.lit(4)})


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def texts():
    base = words(1, 120)
    out = [" ".join(base), " ".join([*base[:60], "odd", *base[60:]]), " ".join(base) + " end", "\n".join(base), " ".join(words(2, 300)), "a b", "A B", "a b c d", "", None, "  \t\n", "one", "éé ü\x0b x", "ab c", "abc", "a  bc"]
    for k in range(12):  # near copies in a chain
        copy = list(base)
        for j in range(k):
            copy[j * 9] = f"new{k}{j}"
        out.append(" ".join(copy))
    return out


def rows(repeat=True):
    found = [(i, t, None if i % 5 == 0 else f"s{i % 3}") for i, t in enumerate(texts())]
    return found + ([found[0], found[8], (None, "a b", "s1")] if repeat else [])


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_groups(spark):
    data = rows()
    got = exact_dedup.exact_groups(table(spark, data), partitions=2).collect()
    groups = {}
    for i, t, _ in data:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    assert len(got) == len(data) and sum(r["kept"] for r in got) == len(groups)
    for r in got:
        group = next(g for n, g in groups.items() if hashlib.sha256(n.encode()).hexdigest() == r["text_sha256"])
        assert r["keep_id"] == min(group)[3] and r["group_size"] == len(group) and r["doc_id"] in [x[3] for x in group]


@pytest.mark.parametrize("copies", [40])
def test_hot_copies_are_salted(spark, copies):
    data = [(i, "same  text" if i % 2 else "same text", "s") for i in range(copies)] + [(100 + i, f"text {i}", "s") for i in range(20)] + [(1, "same  text", "s")]
    got = {}
    for partitions, hot_rows in ((2, 1), (4, 5), (8, 1000), (200, 1000)):
        rows_ = exact_dedup.exact_groups(table(spark, data), partitions=partitions, hot_rows=hot_rows).collect()
        hot = [r for r in rows_ if r["group_size"] > 1]
        assert len(hot) == copies + 1 and {r["keep_id"] for r in hot} == {1} and sum(r["kept"] for r in hot) == 1
        got[partitions] = sorted(map(str, rows_))
    assert len(set(map(tuple, got.values()))) == 1


def test_drop_copies_keeps_columns(spark):
    df = table(spark, rows(repeat=False))
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and kept.count() == len({norm(t) for _, t, _ in rows(repeat=False)})


def plain_fill(sizes, most=3, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        capped.update(over)


def test_mix(spark):
    data = [(i, " ".join(words(i, 1 + i % 17)) if i % 11 else None, (None, "a", "b", "c", "d")[i % 5] if i % 3 else "a") for i in range(400)]
    got = mixing.mix(table(spark, data)).collect()
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target, taken = plain_fill(sizes), {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and r["taken"] == r["copies"] * r["size"] and r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len(got) == len(data) and all(abs(taken[s] - target[s]) <= 8 for s in target)
    again = mixing.mix(table(spark, data, 5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
    copies = mixing.repeat_by_mix(table(spark, data).where("doc_id IS NOT NULL"))
    assert copies.count() == sum(r["copies"] for r in got)


def test_mix_walks_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 16)
    data = [(i, " ".join(["w"] * (1 + i % 9)), "ab"[i % 2]) for i in range(600)]
    got = mixing.mix(table(spark, data)).collect()
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 5


TOKENIZER = pytest.importorskip("public_tokenizers")


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder(TOKENIZER.path("byte_bpe_50k.json"), TOKENIZER.path("byte_bpe_50k.tiktoken"))
    for t in ["", "a", " a", "a  b", "a b ", "it's\n 12 %%% çeé", "x <|endoftext|> y", "tab\t b", " ".join(words(3, 50)), "l'été  où", "a \n b"]:
        ids = e.tokenizer.encode(t, add_special_tokens=False).ids
        assert e(t) == b"".join(i.to_bytes(4, "little") for i in ids), t


def test_packing(spark):
    data = [*rows(), (77, " ".join(words(5, 6000)), "s")]
    got = packing.pack(table(spark, data), TOKENIZER.path("byte_bpe_50k.json")).collect()
    e = packing.Encoder(TOKENIZER.path("byte_bpe_50k.json"))
    sequences, docs = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sum(r["length"] for r in got) == sum(len(e(t or "")) // 4 + 1 for _, t, _ in data)
    ids = e(data[-1][1]) + (1).to_bytes(4, "little")
    for r in docs[77]:
        assert r["doc_tokens"] == len(ids) // 4 and r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])


def test_tasks_of_packing_leave_no_words(spark):
    """Python workers wait for tasks of other stages: they no longer hold the words of the texts that they have packed."""
    path = TOKENIZER.path("byte_bpe_50k.json")
    assert packing.pack(table(spark, rows()), path).count()

    def held(batches):
        for batch in batches:
            found = packing._encoders.get(path)
            batch["n"] = -1 if found is None else len(found.words)
            yield batch[["n"]]

    assert spark.range(0, 64, 1, 16).mapInPandas(held, "n long").agg(F.max("n")).first()[0] == 0


def test_texts_are_packed_in_bounded_pieces(spark, monkeypatch):
    """However many texts a batch brings, few of them at a time are Python's strings; what a task gives on is small, and all ids are in it."""
    import pyarrow as pa

    data = [(0, k, False, None if k % 50 == 7 else " ".join(words(k, 900)) if k else "long " * 600_000) for k in range(1000)]
    taken, pieces = [], []
    frame = type(table(spark, []))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, take=frame.mapInArrow: taken.append(f) or take(self, f, schema))
    monkeypatch.setattr(packing, "slices", lambda batch, at, cut=packing.slices: (pieces.append(x) or x for x in cut(batch, at)))
    path = TOKENIZER.path("byte_bpe_50k.json")
    packing.pack(table(spark, []), path)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*data)], names=["group", "doc_id", "no_id", "text"])
    got = list(taken[0](iter([batch, batch.slice(0, 0)])))
    assert len(pieces) > 2 and all(x.num_rows == 1 or sum(len(t or "") for t in x.column(3).to_pylist()) <= 2_000_000 for x in pieces)
    assert len(got) > 2 and all(x.nbytes < 2 * packing.BATCH_BYTES for x in got)
    found = [r for x in got for r in x.to_pylist()]
    e = packing.Encoder(path)
    for k in (0, 1, 7, 999):
        ids = e(data[k][3] or "") + packing.END_ID.to_bytes(4, "little")
        own = [r for r in found if r["doc_id"] == k]
        assert [r["start"] for r in own] == list(range(0, len(ids) // 4, packing.CAPACITY))
        assert all(r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in own)
    assert len({r["doc_id"] for r in found}) == 1000


def test_python_workers_get_small_batches(spark, monkeypatch):
    """Batches are bounded by bytes, unless the session has its own bound; what a task has freed is given back at its start and its end, also where it isn't read to its end."""
    name, large = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    most = lambda: large.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    spark.conf.unset(name)
    try:
        common.small_batches(spark)
        assert most() < 2 * common.ARROW_BYTES
        spark.conf.set(name, "12000000")
        common.small_batches(spark)
        assert spark.conf.get(name) == "12000000"
    finally:
        spark.conf.unset(name)
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.frugal(lambda xs: (x + 1 for x in xs))(iter([1, 2]))) == [2, 3] and len(calls) == 2
    some = common.frugal(lambda xs: (x + 1 for x in xs))(iter([1, 2]))
    assert next(some) == 2
    some.close()
    assert len(calls) == 4


def test_languages_are_labelled_in_bounded_pieces(spark, monkeypatch):
    """However many texts a batch brings, few of them at a time are Python's strings; all rows and columns come out, in order."""
    import pyarrow as pa

    data = [(k, None if k % 50 == 7 else " ".join(words(k, 900)) if k else "long " * 600_000, k % 3) for k in range(1000)]
    docs, taken = spark.createDataFrame([], "doc_id long, text string, text_key int"), []
    frame = type(docs)
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, take=frame.mapInArrow: taken.append(f) or take(self, f, schema))
    model = language.fitted(*({x: c[k] for x, c in (("en", language.counts_of(["long w"])), ("de", language.counts_of(["kurz"])))} for k in (0, 1)))
    language.labelled(docs, model, "text", "found", "share")
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*data)], names=["c0", "c1", "c2"])
    got = list(taken[0](iter([batch, batch.slice(0, 0)])))
    sizes = [(b.num_rows, sum(len(x or "") for x in b.column(1).to_pylist())) for b in got]
    assert len(got) > 2 and all(size <= 2_000_000 or n == 1 for n, size in sizes)
    found = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert [r[:3] for r in found] == data
    assert [r[3:] for r in found if r[1] is None] == [("und", 0.0)] * 20 and all(r[3] == "en" for r in found if r[1])


def test_equal_rows_spread_over_groups(spark, tmp_path):
    """Rows of one id and text, which compress to nearly nothing, are packed in as many groups as their bytes need, the same in a rerun."""
    text = " ".join(words(9, 200))
    docs = spark.range(0, 3000, 1, 4).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    size, step = len(text.encode()) + packing.ROW_BYTES, 64 << 10
    got = packing.pack(docs, TOKENIZER.path("byte_bpe_50k.json"), group_bytes=step).collect()
    ids = len(packing.Encoder(TOKENIZER.path("byte_bpe_50k.json"))(text)) // 4 + 1
    assert sum(r["length"] for r in got) == 3000 * ids and sum(r["start"] == 0 for r in got) == 3000
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"] >> 32, []).append(r["length"])
    groups = -(-3000 * size // step)
    assert len(filled) == groups and max(map(sum, filled.values())) < 3 * 3000 * ids / groups
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        again = packing.pack(docs, TOKENIZER.path("byte_bpe_50k.json"), group_bytes=step).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_packing_pads_little_and_balances_cost(spark):
    """One group: no more sequences than its ids need, and costs of full ones nearer to each other than when packed in order of ids."""
    data = [(i, " ".join(words(i, 20 + (i * 37) % 700)), "s") for i in range(500)]
    got = packing.pack(table(spark, data), TOKENIZER.path("byte_bpe_50k.json"), TOKENIZER.path("byte_bpe_50k.tiktoken")).collect()
    used, cost = {}, {}
    for r in got:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
        if r["length"] < packing.CAPACITY:
            cost[r["sequence_id"]] = cost.get(r["sequence_id"], 0) + packing.LINEAR * r["length"] + packing.QUADRATIC * r["length"] ** 2
    assert len(used) == -(-sum(used.values()) // packing.CAPACITY)
    # by chance alone, in the order of ids, costs differ more
    naive, fill, total = [], 0, 0.0
    for n in sorted((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0):
        if fill + n[1] > packing.CAPACITY:
            naive.append(total)
            fill, total = 0, 0.0
        fill, total = fill + n[1], total + packing.LINEAR * n[1] + packing.QUADRATIC * n[1] ** 2
    spread = lambda x: max(x) - min(x)
    full = [c for k, c in cost.items() if used[k] == packing.CAPACITY]
    assert spread(full) < spread(naive)


def test_packing_of_nothing(spark):
    docs = table(spark, [(1, "a", "s")])
    assert packing.pack(docs.limit(0), TOKENIZER.path("byte_bpe_50k.json")).count() == 0
    odd = spark.createDataFrame([(None, None, 1), (None, "a b", 2), (3, None, 3)], "doc_id long, text string, `group` int")
    got = packing.pack(odd, TOKENIZER.path("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in got) == [(False, 1), (True, 1), (True, 3)]


@pytest.mark.parametrize("seed", range(20))
def test_assign_wastes_less_than_a_sequence(seed):
    r = random.Random(seed)
    lengths = sorted((r.randrange(1, 65) for _ in range(r.randrange(1, 200))), reverse=True)
    out = packing.assign(lengths, 64)
    assert len(out) == -(-sum(lengths) // 64) and all(sum(x[2] for x in s) <= 64 for s in out)
    for k, n in enumerate(lengths):
        parts = sorted((s, n_) for q in out for i, s, n_ in q if i == k)
        assert [s for s, _ in parts] == [sum(x[1] for x in parts[:j]) for j in range(len(parts))] and sum(x[1] for x in parts) == n


def plain_removed(data, width=50):
    texts_ = [((t or "").encode(), i) for i, t in data if i is not None]
    first = {}
    for b, i in texts_:
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            first[w] = min(first.get(w, i), i)
    out = {}
    for b, i in texts_:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.setdefault(i, []).append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(x for v in out.values() for x in v)


def test_substrings(spark):
    data = [(i, t) for i, t, _ in rows()] + [(40, "ab" * 200), (41, "x" + "ab" * 90 + "y"), (42, "ab" * 24), (43, "é" * 60), (44, "-" + "é" * 40), (45, " ".join(words(1, 70)) + "!")]
    df = spark.createDataFrame([(i, t) for i, t in data], "doc_id long, text string").withColumns({"part": F.lit(1), "kind": F.lit("x")}).repartition(3)
    got = sorted(tuple(r) for r in substrings.remove_repeated(df).where("doc_id IS NOT NULL").collect())
    assert got == plain_removed(data)
    assert substrings.remove_repeated(df.limit(0)).count() == 0
    kept = substrings.kept_texts(df.where("doc_id IN (0, 3)")).collect()
    assert {r["doc_id"] for r in kept} == {0, 3}


@pytest.mark.parametrize("chunk", [60, 128])
def test_substrings_in_small_pieces(spark, monkeypatch, chunk):
    data = [(1, " ".join(words(7, 60))), (2, " ".join(words(7, 50)) + " " + " ".join(words(8, 20))), (3, "z" * 500), (4, "z" * 300)]
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    runs = substrings.runs_of
    import numpy as np

    found = []
    for i, t in data:  # pieces that overlap give the same windows
        b = np.frombuffer(t.encode(), np.uint8)
        whole = runs(b, np.array([len(b)]))
        pieces = [runs(b[at : at + chunk + 49], np.array([len(b[at : at + chunk + 49])])) for at in range(0, len(b), chunk)]
        found.append((sum(whole[3]), sum(sum(p[3]) for p in pieces)))
    assert all(a == b for a, b in found)


def test_repeated_ids_are_pieces_of_one_document(spark):
    shared, other = "".join(words(1, 20)), "".join(words(2, 40))
    data = [(1, shared, "s"), (2, "x" + shared, "s"), (2, other, "s"), (2, other, "s"), (3, other + "yz", "s"), (4, "tail " * 12, "s")]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in substrings.remove_repeated(table(spark, data)).collect())
    size = len(shared), len(other)
    assert got == sorted([(1, size[0], 0), (2, size[0] + 1, size[0]), (2, size[1], 0), (2, size[1], 0), (3, size[1] + 2, size[1]), (4, 60, 0)])


@pytest.mark.parametrize("seed", range(5))
def test_assign_cuts_only_what_fits_nowhere(seed):
    r = random.Random(seed)
    lengths = sorted((r.randrange(1, 2049) for _ in range(900)), reverse=True)
    room = {}
    placed = {}
    for k, sequence in enumerate(packing.assign(lengths)):
        room[k] = packing.CAPACITY
        for item, start, length in sequence:
            placed.setdefault(item, []).append((start, k, length))
    for item, length in enumerate(lengths):
        if len(placed[item]) > 1:
            assert max(room.values()) < length
        for _, k, taken in placed[item]:
            room[k] -= taken


def test_results_do_not_follow_partitions(spark):
    data = rows(repeat=False) + [(300 + i, " ".join(words(i, 30 + i % 50)), "ab"[i % 2]) for i in range(120)]
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), {"pack": set(), "mix": set(), "exact": set()}
    try:
        for n in (2, 8, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            seen["pack"].add(tuple(sorted(map(str, packing.pack(table(spark, data), TOKENIZER.path("byte_bpe_50k.json")).collect()))))
            seen["mix"].add(tuple(sorted(map(str, mixing.mix(table(spark, data)).collect()))))
            seen["exact"].add(tuple(sorted(map(str, exact_dedup.exact_groups(table(spark, data)).collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(len(x) == 1 for x in seen.values())


def test_mix_odds_grow_with_length(spark):
    data = [(i, " ".join(["w"] * (2 if i % 2 else 64)), "a" if i < 300 else "b") for i in range(600)]
    copies = {}
    for r in mixing.mix(table(spark, data)).collect():
        copies.setdefault((r["source"], r["size"]), []).append(r["copies"])
    for source in "ab":
        short, long = (sum(copies[source, n]) / len(copies[source, n]) for n in (2, 64))
        assert short < long or short == long == 3


def test_sets_that_share_a_passage_make_no_pairs(spark, monkeypatch):
    """Texts of one long passage and words of their own aren't similar enough, and no pair of them is verified."""
    passage = " ".join(words(1, 400))
    data = [(i, passage + " " + " ".join(f"own{i}x{j}" for j in range(60)), "s") for i in range(300)]
    asked = []
    known = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda sets, pairs, percent: asked.append(pairs.count()) or known(sets, pairs, percent))
    got = ngram_join.classes_and_components(table(spark, data), words=5, percent=80).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got) and sum(asked) == 0


def plain_components(data, k, percent):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [(i, grams(t)) for i, t in data]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, monkeypatch, k, percent):
    monkeypatch.setattr(ngram_join, "FLUSH", 40)
    monkeypatch.setattr(ngram_join, "OPEN_FLUSH", 30)
    data = rows(repeat=False) + [(60 + j, " ".join([*words(9, 100), *words(100 + j, j)]), "s") for j in range(14)]
    got = ngram_join.classes_and_components(table(spark, data), words=k, percent=percent).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == plain_components([(i, t) for i, t, _ in data], k, percent)
    kept = ngram_join.drop_near_copies(table(spark, data), words=k, percent=percent)
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in plain_components([(i, t) for i, t, _ in data], k, percent)}


def test_near_copies_that_seldom_link(spark, monkeypatch):
    """800 texts that differ in one word each link only where these words are near one another; hubs connect them with a few pairs a text."""
    base = [f"w{k}" for k in range(100)]
    data = [(i, " ".join([*base[: 37 * i % 100], f"own{i}", *base[37 * i % 100 + 1 :]]), "s") for i in range(800)]
    asked = []
    known = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda sets, pairs, percent: asked.append(pairs.count()) or known(sets, pairs, percent))
    got = ngram_join.classes_and_components(table(spark, data), words=4, percent=85).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, 0) for i in range(800)} and sum(asked) <= 20 * 800


def test_bitmaps_keep_all_links():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(r.integers(0, 2**63, int(r.integers(1, 400)), dtype=np.uint64))
        b = np.unique(np.concatenate((a[: int(r.integers(0, len(a) + 1))], r.integers(0, 2**63, int(r.integers(0, 60)), dtype=np.uint64))))
        if len(b):
            differ = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(ngram_join.bitmap(a), ngram_join.bitmap(b)))
            assert differ <= len(np.setxor1d(a, b))


def test_hubs_that_find_nothing_leave_all_pairs(spark, monkeypatch):
    """Links are the same when no round of hubs is run, and when there are many."""
    data = rows(repeat=False) + [(60 + j, " ".join([*words(9, 100)[:j], f"z{j}", *words(9, 100)[j + 1 :]]), "s") for j in range(0, 90, 3)]
    want = plain_components([(i, t) for i, t, _ in data], 4, 85)
    for least in (0, 10**9):
        monkeypatch.setattr(ngram_join, "LEAST_YIELD", least)
        monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 3 if least == 0 else 8)
        got = ngram_join.classes_and_components(table(spark, data), words=4, percent=85).collect()
        assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == want


def test_ngram_join_of_nothing(spark):
    assert ngram_join.classes_and_components(table(spark, rows()).limit(0)).count() == 0
    odd = ngram_join.classes_and_components(table(spark, [(1, None, "s"), (None, "a b c d e", "s"), (3, "a b c d e", "s"), (3, "a b c d e", "s")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in odd) == [(-1, 3), (1, 1), (3, 3), (3, 3)]


def test_shingle_hashes_tell_sets_apart():
    import pyarrow as pa

    sample = ["a b c d", "a b c e", "b a c d", "a b c d a b c d", "A b C d", "ab c d", "", " \x0b", "é b c d"]
    for k in (2, 4):
        found = dict(shingles.sets_of(pa.array(sample), k))
        plain = [{tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (t.encode().lower().split() for t in sample)]
        for i, a in enumerate(plain):
            for j, b in enumerate(plain):
                assert len(a & b) == len(set(found[i].tolist()) & set(found[j].tolist())), (i, j)


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 4), (4, 5), (9, 8), (7, 7)], [(i, (i * 7) % 50) for i in range(50)], []])
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            m = min(parent[a], parent[b])
            parent[a] = parent[b] = m
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r["node"], r["component"]) for r in got.collect()} == set(parent.items())


def test_language(spark):
    import numpy as np

    syllables = {"aa": "la le ri ta", "bb": "sch ung ver ei", "cc": "ов ть на по"}
    make = lambda lang, seed, n: " ".join("".join(random.Random(seed * 1000 + i).choices(syllables[lang].split(), k=3)) for i in range(n))
    data = [(i, make(lang, i, 30), lang) for i in range(90) for lang in [("aa", "bb", "cc")[i % 3]]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.learn(df.where("doc_id < 60"))
    assert model.languages == ["aa", "bb", "cc"]
    test = df.where("doc_id >= 60").select("doc_id", "text", F.lit("zz").alias("lang")).union(spark.createDataFrame([(200, None, "x"), (201, "", "x"), (202, "12 !!", "x"), (203, make("aa", 7, 20) + " " + make("cc", 8, 40), "x"), (None, make("bb", 9, 9), "x"), (204, "漢字", "x")], df.schema))
    got = {r["doc_id"]: r for r in language.identify(test, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in data if i >= 60) and got[None]["lang_pred"] == "bb"
    assert [got[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3 and got[203]["lang_pred"] == "cc" and 0 < got[203]["score"] < 1 and got[204]["lang_pred"] in model.languages
    parts = language.spans(test.where("doc_id = 203"), model).orderBy("start").collect()
    assert [p["lang"] for p in parts] == ["aa", "cc"] and parts[0]["start"] == 0
    nothing = language.identify(test, language.learn(df.limit(0)))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    # the walk is the best path
    r = np.random.default_rng(0)
    for _ in range(30):
        n, k = int(r.integers(1, 7)), int(r.integers(1, 4))
        s = r.normal(size=(n, k)).astype(np.float32)
        labels = language.viterbi(s, np.array([n]), 0.7)
        import itertools

        worth = lambda p: sum(float(s[t, x]) for t, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert worth(labels.tolist()) == pytest.approx(max(worth(p) for p in itertools.product(range(k), repeat=n)), abs=1e-4)
    both = language.viterbi(np.vstack([s, s]), np.array([len(s), 0, len(s)]), 0.7)
    assert both[: len(s)].tolist() == both[len(s) :].tolist()


def test_stages_tell_rows_apart(spark):
    """Null and repeated ids in every stage: rows are lost or kept by their texts only."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    one, two, three = (" ".join(words(k, 60)) for k in (11, 12, 13))
    data = [(1, one, "a"), (1, one, "a"), (1, two, "a"), (None, three, "a"), (None, three + " end", "a"), (2, one + " ", "a"), (3, "12 34", "a"), (3, two + " x", "a")]
    docs = table(spark, data)
    seen = lambda df: sorted((r["doc_id"] or 0, r["text"]) for r in df.collect())
    assert seen(stages["language"](spark, docs, "")) == sorted((i or 0, t) for i, t, _ in data if t != "12 34")
    assert seen(stages["exact dedup"](spark, docs, "")) == sorted([(2, one + " "), (1, two), (0, three), (0, three + " end"), (3, "12 34"), (3, two + " x")])
    near = stages["near dedup"](spark, docs, "")
    assert near.columns == docs.columns and [i for i, _ in seen(near)] == [0, 1, 1, 3] and (3, "12 34") in seen(near)
    again = exact_dedup.drop_copies(table(spark, [(None, "same text", "a")] * 50 + [(7, "same text", "a")] * 3 + [(8, f"t{k}", "a") for k in range(9)]))
    assert len(seen(again)) == 10 and seen(again)[0] == (7, "same text")
    mixed = stages["mix"](spark, table(spark, [(None, f"{k} a b", "a") for k in range(20)] + [(5, f"{k} " * (k + 1), "b") for k in range(20)]), "")
    taken = {}
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    want = plain_fill({"a": 60, "b": 210})
    assert all(abs(taken[s] - want[s]) <= 20 for s in want)
    assert stages["pack"](spark, docs, "").agg(F.sum("length")).first()[0] == sum(len(packing.Encoder(TOKENIZER.path("byte_bpe_50k.json"))(t)) // 4 + 1 for _, t, _ in data)


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    docs = table(spark, [(k, " ".join(words(20 + k, 60)), "ab"[k % 2]) for k in range(8)])
    docs = docs.withColumn("a.b", F.lit(1)).withColumn("back`tick", F.lit("x")).withColumn("size", F.lit(None).cast("int")).withColumn("document", F.lit(2.0))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns and got.count(), name
        assert {(r["a.b"], r["back`tick"], r["size"], r["document"]) for r in got.collect()} == {(1, "x", None, 2.0)}, name
    assert dict(corpus_pipeline.STAGES)["pack"](spark, docs, "").count()


def test_viterbi_of_two_halves():
    """Two neighbouring runs of other languages pay one change; a third language isn't taken for both."""
    import numpy as np

    scores = np.array([[0, -6, -2.5]] * 4 + [[-6, 0, -2.5]] * 4, dtype=np.float32)
    assert language.viterbi(scores, np.array([8]), 12.0).tolist() == [0] * 4 + [1] * 4


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    df = spark.createDataFrame([(k, "some text", f"l{k}", "s", 0) for k in range(3)], SCHEMA)
    with pytest.raises(ValueError):
        language.learn(df)
    assert len(language.learn(df.where("doc_id < 2")).languages) == 2


def test_few_edges_are_one_partition(spark, monkeypatch):
    """Few edges of a session with many partitions take one task a step, and the shuffled form gives the same."""
    spool, files = components.spool, []

    def counted(*args):
        out = spool(*args)
        files.append(len([f for f in out.inputFiles() if "part-" in f]))
        return out

    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 60), (70, 70), (None, 1)], "a long, b long").repartition(5)
    want = {i: 0 for i in range(21)} | {40: 40, 50: 40, 60: 40, 70: 70}
    monkeypatch.setattr(components, "spool", counted)
    assert {r["node"]: r["component"] for r in components.components(edges).collect()} == want
    assert len(files) > 2 and set(files[1:]) == {1}
    monkeypatch.setattr(components, "BROADCAST_ROWS", 3)
    assert {r["node"]: r["component"] for r in components.components(edges).collect()} == want
