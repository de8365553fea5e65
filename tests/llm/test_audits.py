"""Decontamination, the filter audit and vector codes against plain loops, with odd rows."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from tempora.llm import decontaminate, filter_audit, vector_codes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_contamination(docs, items, size=10):
    windows = {}
    for i, text in items:
        words = plain_words(text)
        for k in range(max(1, len(words) - size + 1)) if words else ():
            windows.setdefault(tuple(words[k : k + size]), set()).add(i)
    out = []
    for i, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for window, ids in windows.items():
            for k in range(len(words) - len(window) + 1):
                if tuple(words[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found |= ids
        names = ",".join(sorted("" if x is None else str(x) for x in found))
        out.append((i, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


PHRASE = "the cat sat on the mat and saw the old dog again today"
ITEMS = [(2, PHRASE), (2, "other words of item two"), (10, PHRASE.upper() + "!"), (None, "ÉTÉ été ünder"), (3, ""), (4, None), (5, "--- ... "), (6, "a a a"), (7, "rare"), (7, "rare")]
DOCS = [
    (1, "So " + PHRASE.replace(" ", ", ") + " it said"), (1, PHRASE[:40]), (None, "ÉTÉ Été ünder"), (2, "ÉTÉ été Ünder and ÉTÉ été ünder"), (3, None), (4, ""), (5, " ."),
    (6, "a a a a a b a a"), (7, "Rare rare"), (8, "very rarely"), (9, " ".join([PHRASE] * 700) + " rare"), (10, "on the mat and saw the old dog again today"), (11, "saw the old dog again today the cat sat on the mat and"),
]


@pytest.mark.parametrize("ranks", [1, 3])
def test_contamination(spark, ranks):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id long, text string, `a.b` string, row long")
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, wid int")
    assert in_order(decontaminate.contamination(docs, items, ranks=ranks).collect()) == in_order(plain_contamination(DOCS, ITEMS))


def test_contamination_of_random_texts(spark):
    """Few words, so that windows overlap, repeat and share their rarest terms."""
    rng = random.Random(5)
    texts = lambda n, most: [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, most)))) for i in range(n)]
    docs, items = texts(60, 80), texts(25, 14)
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), size=4)
    assert in_order(got.collect()) == in_order(plain_contamination(docs, items, 4))


def test_contamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert in_order(decontaminate.contamination(docs, items.limit(0)).collect()) == in_order(plain_contamination(DOCS, []))


def test_bitmap_loses_no_row(spark):
    rows, found = spark.range(5000).withColumnRenamed("id", decontaminate.ROW), spark.range(0, 5000, 97).withColumnRenamed("id", "row")
    left = {r[0] for r in decontaminate._perhaps(rows, found).collect()}
    assert set(range(0, 5000, 97)) <= left and len(left) < 500
    assert decontaminate._perhaps(rows, found.limit(0)).count() == 0


def test_proximity(spark):
    rng, span = random.Random(6), 6
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for i in range(50)] + [(90, None), (91, "A b, C")]
    items = [(0, "a b c"), (1, "h g a b"), (2, "a a"), (3, "c z"), (4, None), (5, "b a d c f e")]
    want = []
    for i, text in docs:
        words = plain_words(text)
        for j, item in items:
            asked = plain_words(item)
            cuts = [set(asked[k : k + 4]) for k in range(max(1, len(asked) - 3))] if asked else []
            starts = [s for s in range(len(words)) for c in cuts if words[s] in c and c <= set(words[s : s + span])]
            if starts:
                want.append((i, j, min(starts)))
    got = decontaminate.proximity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), span, size=4)
    assert in_order(got.collect()) == in_order(want) and len(want) > 40


def plain_audit(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    rows = []
    for i, text, part in docs:
        text = text or ""
        w = words(text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": copy}
        rows.append((part or "", fails, i is not None and i in good, i is not None and i in toxic))
    first = {}
    for p in {r[0] for r in rows}:
        for f in "ABCDE":
            first[p, f] = sum(next((g for g in o if r[1][g]), None) == f for r in rows if r[0] == p for o in itertools.permutations("ABCDE"))
    out = []
    for p in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                own = [r for r in rows if r[0] == p]
                left = [r for r in own if not any(r[1][g] for g in order[: step - 1])]
                gone = [r for r in left if r[1][f]]
                out.append((p, "".join(order), step, len(left) - len(gone), len(gone), sum(r[1][f] for r in own) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), first[p, f]))
    return out


def audited():
    long = " ".join(f"w{k}" for k in range(120))
    texts = [long, long + " #", "A" + long, "LOUD TEXT", "", None, "one two", "x " * 150, " ".join(["w"] * 200), long.upper(), "é" * 50, "a\x1cb"]
    rng = random.Random(3)
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return docs, labels


def test_audit(spark):
    docs, labels = audited()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, quality int").repartition(7)
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert in_order(got.collect()) == in_order(plain_audit(docs, labels))


def test_audit_of_empty_tables(spark):
    docs, labels = audited()
    frame, flags = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame.limit(0), flags).count() == 0
    assert in_order(filter_audit.audit(frame, flags.limit(0)).collect()) == in_order(plain_audit(docs, []))


@pytest.mark.parametrize("held", [1, 200, 1 << 20])
def test_chains_of_colliding_fingerprints(monkeypatch, held):
    """All texts with one fingerprint, chains sent on at once or late, rows in any order: whole texts tell."""
    monkeypatch.setattr(filter_audit.xxhash, "xxh64_intdigest", lambda data: 7)
    rng = random.Random(1)
    rows = [(i, rng.choice(["p", "q", "r"]), "en") for i in range(40)]
    rng.shuffle(rows)
    tasks = [list(filter_audit.routed(rows[k::3], held)) for k in range(3)]
    found = sorted((i, m >> 4) for i, _, m, n in filter_audit.settled(itertools.chain(*tasks)) for _ in range(n))
    assert found == sorted((i, int(any(j < i and t == u for j, u, _ in rows))) for i, t, _ in rows)


def test_a_hot_text_is_sent_once_by_a_task():
    sent = [r for _, r in filter_audit.routed((i, "same text", "en") for i in range(10_000)) if len(r) == 3]
    assert len(sent) == 1 and sent[0][1] == 0


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Of rows (id, vector, label) of one length."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[k * size : (k + 1) * size]) for k in range(parts)]
    first = [cut(v) for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    books = [[f[k] for f in first] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda k, p: min((far(p, e), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        for k in range(parts):
            members = {}
            for _, v, _ in kept:
                p = cut(v)[k]
                members.setdefault(near(k, p)[1], []).append(p)
            for j, group in members.items():
                books[k][j] = tuple(sum(x) // len(group) for x in zip(*group))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, label, [near(k, p) for k, p in enumerate(cut(v))]) for i, v, label in kept]
    total = {}
    for _, label, codes in found:
        total[label] = total.get(label, 0) + sum(d for d, _ in codes)
    return [(i, "".join(f"{j:02x}" for _, j in codes), sum(d for d, _ in codes), total[label], digest) for i, label, codes in found]


def vectors(seed, n, values):
    rng = random.Random(seed)
    return [(i, [rng.choice(values) for _ in range(32)], rng.choice([None, 0, 1])) for i in range(n)]


@pytest.mark.parametrize("values", [[0.0, 1 / 256, -1 / 256, 2 / 256], [0.1, -0.3, 0.7, -0.9, 0.2], [1e6, -3e7, 0.5, 2e30]])
def test_codes(spark, values):
    """Ties, few different parts, integers beyond 64 bits' squares, and rows that are left out."""
    rows = vectors(4, 150, values) + [(200, None, 1), (201, [None] * 32, 1), (202, [float("nan")] * 32, None), (203, [float("inf")] * 32, 0), (3, [values[0]] * 32, 5), (None, [values[1]] * 32, 5)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(6)
    want = [(i, c, min(e, (1 << 63) - 1), min(t, (1 << 63) - 1), h) for i, c, e, t, h in plain_codes(rows)]
    got = [tuple(r) for r in vector_codes.compress(frame).collect()]
    if max(values) > 1e20:  # single errors are held at the largest number
        assert in_order(r[:3] + r[4:] for r in got) == in_order(r[:3] + r[4:] for r in want)
    else:
        assert in_order(got) == in_order(want)


def test_codes_of_few_or_no_rows(spark):
    rows = vectors(1, 5, [0.25, 0.5])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert in_order(vector_codes.compress(frame).collect()) == in_order(plain_codes(rows))
    assert vector_codes.compress(frame.limit(0)).count() == 0


def test_codes_of_other_lengths(spark):
    """Each length has codebooks of its own; lengths that 16 doesn't divide and empty vectors work."""
    a, b = vectors(2, 20, [0.25, 0.5, 1.0]), [(100 + i, [float(i % 3)] * 5, None) for i in range(9)] + [(300, [], None)]
    got = vector_codes.compress(spark.createDataFrame(a + b, "vec_id long, embedding array<float>, label int").drop("label"), label_col=None)
    rows = {r["vec_id"]: r for r in got.collect()}
    alone = {r[0]: r for r in plain_codes([(i, v, None) for i, v, _ in a])}
    assert len(rows) == 30 and all(rows[i]["code"] == r[1] and rows[i]["codebooks_sha256"] == r[4] for i, r in alone.items())
    assert rows[300]["code"] == "00" * 16 and rows[300]["error"] == 0 and rows[100]["error"] == 0
    assert len({r["label_error"] for r in rows.values()}) == 1


def test_tree_keeps_lower_indexes():
    rng = np.random.default_rng(0)
    for _ in range(50):
        book, x = rng.integers(-2, 3, (64, 3)), rng.integers(-3, 4, (40, 3))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        codes, errors = vector_codes.lookup([vector_codes.Tree(book)], [0, 3], x)
        assert (codes[:, 0] == d.argmin(axis=1)).all() and (errors == d.min(axis=1)).all()
