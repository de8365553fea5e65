"""Operators on pages, conversations and vectors."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import chat, html_text, topk, warc


@pytest.mark.parametrize("text", ["", "plain", "\\### Assistant: </turn> ok", "a\\", "####", "<\\/turn></turn>", "\n### user: x</turn>\n", "\\\\</turn>"])
@pytest.mark.parametrize("role", ["user", "assis:tant", "", "a\\:### b</turn>\n"])
def test_turns_round_trip(text, role):
    formatted, start, end = chat.render_turn(role, text)
    assert list(chat.parse_turns(formatted * 2)) == [(role, text)] * 2 and chat.unescape(formatted[start:end]) == text


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", None), (None, 0, "user", "n"), (1, 1, "assistant", "b"), (3, None, None, "x</turn>")]
    logs = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string").withColumns({"kind": F.lit("message"), "message_id": F.lit(None).cast("string"), "position": F.lit(9), "formatted": F.lit("")})
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.reconstruct(logs))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == digest([("user", "a"), ("assistant", "b"), ("assistant", "b")]) and got[1]["loss_chars"] == 2
    assert got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1 and got[3]["turns_sha256"] == digest([("", "x</turn>")])
    assert chat.read_back(chat.render(chat.reconstruct(logs.limit(0)))).count() == 0


def test_events_fold_into_messages(spark):
    rows = [
        (1, 0, "message", "m0", "user", "hi"), (1, 1, "delta", "m1", "assistant", "He"), (1, 2, "delta", "m1", None, "llo"), (1, 3, "edit", "m0", None, "hey"),
        (1, 4, "regenerate", "m1", None, None), (1, 5, "delta", "m1", None, "Good "), (1, 6, "delta", "m1", None, "day"), (1, 7, "message", None, "user", "bye"),
    ]
    random.Random(1).shuffle(rows)
    logs = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message_id string, role string, text string").repartition(3)
    got = [(r["role"], r["text"]) for r in chat.reconstruct(logs).orderBy("position").collect()]
    assert got == [("user", "hey"), ("assistant", "Good day"), ("user", "bye")]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("x"), "host": F.lit("y"), "part": F.lit(1)}).repartition(2)


def test_archives_round_trip(spark):
    rows = [(3, "u", "same"), (1, "u 1\r\n", "same"), (2, None, None), (5, "u", ""), (7, "u", "é" * 1000), (1, "u", "same"), (None, "u", "same"), (9, "u", "9")]
    read = warc.read_archives(warc.write_archives(pages(spark, rows), segment_bytes=300)).collect()
    assert len(read) == len(rows) and all(r["kind"] == "record" for r in read)
    by = {(r["page_id"], r["payload_digest"]): r for r in read}
    for i, _, html in rows:
        data = (html or "").encode()
        r = by[i, base64.b32encode(hashlib.sha1(data).digest()).decode()]
        assert r["payload_bytes"] == len(data)
        first = min(x for x, _, h in rows if (h or "") == (html or "") and x is not None)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i in (first, None) else ("revisit", first))
        if r["record_type"] == "response":
            assert r["payload"] == data
    assert warc.read_archives(warc.write_archives(pages(spark, rows).limit(0))).count() == 0
    large = warc.read_archives(warc.write_archives(pages(spark, rows), least_payload=5)).where("record_type = 'revisit'")
    assert large.count() == 0


def test_salvage_goes_on_after_damage():
    members = [warc.compress(warc.build_record(i, "u", bytes([65 + i]) * (50 + i))) for i in range(5)]
    whole = b"".join(members)
    assert [k for k, *_ in warc.salvage(whole)] == ["record"] * 5
    damaged = bytearray(whole)
    at = len(members[0]) + len(members[1]) // 2
    damaged[at : at + 4] = b"\0\0\0\0"
    out = list(warc.salvage(bytes(damaged)))
    assert [k for k, *_ in out] == ["record", "gap", "record", "record", "record"] and (out[1][3], out[1][4]) == (len(members[0]), len(members[0]) + len(members[1]))
    out = list(warc.salvage(b"junk" + whole[:-7]))
    assert [k for k, *_ in out] == ["gap", *["record"] * 5, "gap"] and out[0][2] == b"junk" and out[5][3] == out[5][4] == out[6][3]
    plain = [warc.build_record(i, "u", b"x" * i) for i in range(3)]
    bad = plain[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    out = list(warc.salvage(plain[0] + bad + plain[2]))
    assert [k for k, *_ in out] == ["record", "gap", "record"]
    wrong = plain[2].replace(b"\r\n\r\nxx", b"\r\n\r\nxy")
    assert [k for k, *_ in warc.salvage(wrong + members[0] + plain[0])] == ["gap", "record", "record"]
    records = [warc.build_record(i, "u", bytes([65 + i]) * (50 + i)) for i in range(4)]
    hurt = records[1].replace(b"BBB", b"BxB", 1)
    one = warc.compress(records[0] + hurt + b"".join(records[2:]))
    out = list(warc.salvage(one))  # several records in a member, one of them damaged before it was compressed
    assert [k for k, *_ in out] == ["record"] * 3 + ["inner gap"] and out[3][2] == hurt and {x[3:] for x in out} == {(0, len(one))}
    long = [warc.build_record(i, "u", random.Random(i).randbytes(3000)) for i in range(4)]
    member = warc.compress(b"".join(long))
    assert [k for k, *_ in warc.salvage(member[:-6])] == ["record"] * 4 + ["gap"]  # its checksum is cut off
    out = list(warc.salvage(member[: len(member) // 2] + members[0]))
    assert [k for k, *_ in out] == ["record", "gap", "record"] and [warc.record_id(i) for i in (0, 0)] == [x[1]["warc-record-id"] for x in out if x[1]]
    assert list(warc.salvage(b"")) == [] and zlib.decompress(members[0], 31).startswith(b"WARC/1.1")


PAGE = """<!DOCTYPE html><html class="has-sidebar"><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="layout sidebar"><article class=post><h1>One &amp;  two</h1><p><b>First<br>line<p>Second &lt;b&gt; &eacute;<aside>Related</aside><form><p>Mail</form>
<p>a < b<!-- gone > --> c</p><div class="ad">Buy</div><section id="comments"><article class="comment"><p>Nice</p></article></section></article></div><aside>Side</aside><footer>&copy; x</footer>"""


def test_article_blocks():
    blocks = html_text.blocks_of(PAGE)
    assert [t for k, t in blocks if k == html_text.CONTENT] == ["One & two", "First line", "Second <b> é", "a < b c"]
    assert html_text.blocks_of("") == [] and html_text.blocks_of("<script>x") == [] and html_text.blocks_of("just text") == [(html_text.CANDIDATE, "just text")]


def test_hostile_pages_are_read_once():
    """Times of pages without ends of tags, quotes and elements grow with their size."""
    import time

    n = 20_000
    for page in ("<a " * n, '<a ">" ' * n, "<video>" * n, "<div>" * n + "</p>" * n, "<b>" + "<div>" * n + "</i>" * n, "<" * n, "<b><article>" + "<div>" * n + "</b>" * n, "</video " * n):
        begun = time.perf_counter()
        html_text.blocks_of(page + "one<p>two")
        assert time.perf_counter() - begun < 5, page[:20]
    texts = lambda page: [t for _, t in html_text.blocks_of(page)]
    for name in ("video", "object", "select"):
        assert texts(f"<article><p>one</p><{name}><p>two</p></article>") == ["one", "two"]
    assert texts("<p>one <a href='x>y'>link</a> <a title=\"it's\">two</a>") == ["one link two"]
    assert texts('<p>a <b class="x>y</b> c') == ["a y c"] and texts("a <b") == ["a <b"] and texts("a <b <!-- c") == ["a <b"]



def test_host_suffix_array(spark):
    shared = "<div>Read more about our terms of service here</div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{shared}<p>{i} is unique text {i * i}</p></body>") for i in range(6)]
    rows += [(20, "http://other/x", f"<body>{shared}</body>"), (21, None, None), (22, "http://h.example/a", PAGE), (23, "odd", "<p></p>"), (0, *rows[0][1:])]
    got = {}
    for r in html_text.extract(pages(spark, rows)).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert all(got[i][0]["text"] == f"{i} is unique text {i * i}" for i in range(6)) and len(got[0]) == 2
    assert got[20][0]["text"] == "Read more about our terms of service here" and got[21][0]["text"] == "" and got[23][0]["n_chars"] == 0
    assert got[22][0]["text"].startswith("One & two\nFirst line")
    assert html_text.extract(pages(spark, rows).limit(0)).count() == 0


def test_names_that_mark_boilerplate():
    marked = {x: html_text._marked(f' class="{x}"') for x in ("share-price", "promotionRace", "discussion", "ad", "share-links", "comment-list", "shareButtons", "story", "main-nav", "story share", "cookie_notice top")}
    assert marked == {"share-price": 2, "promotionRace": 2, "discussion": 2, "ad": 3, "share-links": 3, "comment-list": 3, "shareButtons": 3, "story": 0, "main-nav": 1, "story share": 3, "cookie_notice top": 3}
    blocks = html_text.blocks_of('<article><p>Intro</p><div class="share-price"><p>Up <b>two</b></p></div><section class="discussion"><header>Views</header></section><div class="ad">Buy</div><p>End</p></article>')
    assert blocks == [(0, "Intro"), (3, "Up two"), (3, "Views"), (2, "Buy"), (0, "End")]


def test_doubtful_blocks_go_where_pages_share_them(spark):
    """In articles, what a name alone doesn't tell the suffix array does: shared blocks go, own ones stay, and content is never cut."""
    notice, quote = "tell your friends and family about this story today", " ".join(f"q{k}" for k in range(40))
    own = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(5)]
    html = lambda i: f'<body><article><p>{own[i]}</p><p>{quote}</p><div class="share-this-story">{notice}</div><div class="share-price">{i} rose {i * i} points in the day {own[i]}</div></article><p>outside</p></body>'
    rows = [(i, f"http://h.example/{i}", html(i)) for i in range(5)] + [(9, "http://single.example/9", html(1))]
    want = {i: f"{own[i]}\n{quote}\n{i} rose {i * i} points in the day {own[i]}" for i in range(5)}
    want[9] = f"{own[1]}\n{quote}\n{notice}\n1 rose 1 points in the day {own[1]}"  # no other page of its host
    for size in (2, 1000):
        assert {r["page_id"]: r["text"] for r in html_text.extract(pages(spark, rows), size).collect()} == want
    page = html_text.blocks_of(html(2))
    assert html_text.main_text(page, np.zeros(len(html_text._words(page)), dtype=bool)) != want[2]  # it is the marks that decide


def test_groups_of_a_host_do_not_decide(spark):
    """Three of 60 pages share a block; groups of five pages seldom hold more than one of them."""
    notice = "<div>all rights are kept by the owners of this site</div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{notice if i % 20 == 0 else ''}<p>{' '.join(f'w{i}x{k}' for k in range(12))}</p></body>") for i in range(60)]
    want = {i: " ".join(f"w{i}x{k}" for k in range(12)) for i in range(60)}
    for size in (5, 1000):
        assert {r["page_id"]: r["text"] for r in html_text.extract(pages(spark, rows), size).collect()} == want


def test_near_copies_and_quotes_keep_their_text(spark):
    """Near copies of an article are whole; a quoted sentence stays in blocks of other words; a shared block goes."""
    article = [f"a{k}" for k in range(300)]
    dated = [" ".join([*article[:150], f"day{i}", *article[150:]]) for i in range(4)]
    quote, notice = " ".join(f"q{k}" for k in range(10)), "all rights are kept by the owners of this site"
    quoting = [" ".join(f"p{i}x{k}" for k in range(40)) + f" {quote} " + " ".join(f"p{i}y{k}" for k in range(40)) for i in range(5)]
    rows = [(i, f"http://h.example/{i}", f"<body><p>{t}</p></body>") for i, t in enumerate(dated)]
    rows += [(10 + i, f"http://h.example/{10 + i}", f"<body><p>{t}</p><div>{notice}</div></body>") for i, t in enumerate(quoting)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages(spark, rows), 4).collect()}
    assert got == dict(enumerate(dated)) | {10 + i: t for i, t in enumerate(quoting)}


def test_long_shared_runs_leave_a_block(spark):
    notice = " ".join(f"n{k}" for k in range(40))
    rows = [(i, f"http://h.example/{i}", f"<body>{' '.join(f'w{i}x{k}' for k in range(60))} {notice}</body>") for i in range(4)]
    assert {r["text"] for r in html_text.extract(pages(spark, rows)).collect()} == {" ".join(f"w{i}x{k}" for k in range(60)) for i in range(4)}


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    import numpy as np

    r = random.Random(seed)
    tokens = np.array([r.randrange(3) for _ in range(r.randrange(0, 60))])
    order, _ = html_text.suffix_array(tokens)
    assert order.tolist() == sorted(range(len(tokens)), key=lambda i: tokens[i:].tolist())
    streams = [[str(r.randrange(3)) for _ in range(12)] for _ in range(6)]
    masks = html_text.shared_tokens(streams, 5, 2)
    distinct = {tuple(s) for s in streams}
    for s, mask in zip(streams, masks):
        want = [False] * len(s)
        for i in range(len(s) - 4):
            if sum(any(d[j : j + 5] == tuple(s[i : i + 5]) for j in range(len(d) - 4)) for d in distinct) >= 2:
                want[i : i + 5] = [True] * 5
        assert mask.tolist() == want


def test_top_k(spark, monkeypatch):
    import math

    monkeypatch.setattr(topk, "INDEX_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(200 + i, [0.5] * 8) for i in range(40)]
    rows += [(300, None), (301, [float("nan")] * 8), (302, [None, 1.0]), (303, [float("inf")] * 8), (320, [1.0, 2.0]), (321, [2.0, 1.0]), (322, []), (340, []), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"r": F.lit(1), "dim": F.lit(2), "block": F.lit(3)}).repartition(4)
    got = sorted(tuple(x) for x in topk.top_k(df, 7, "vec_id % 20 = 0").collect())
    import numpy as np

    usable = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in usable if i % 20 == 0}):
        v = next(x for i, x in usable if i == q)
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))[:7]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), 7, "true").count() == 0


def test_turns_go_through_the_fold(spark, small, monkeypatch):
    whole = sorted(map(tuple, chat.op5_event_sourced(spark, small).collect()))
    monkeypatch.setattr(chat, "fold", lambda events: ("", str(len(list(events)))))
    assert sorted(map(tuple, chat.op5_event_sourced(spark, small).collect())) != whole


def test_top_k_leaves_rows_without_an_id_out(spark):
    rows = [(None, [1.0, 1.0]), (0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [0.25, 0.0]), (None, None)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 5, "vec_id % 20 = 0").collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 20), (0, 2, 21), (20, 1, 0), (20, 2, 21)]


def test_members_are_inflated_in_linear_time():
    """Four times the members take about four times as long, and all of them are found."""
    import gzip
    import time

    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 2000\r\n\r\n" + bytes(range(250)) * 8 + b"\r\n\r\n"
    member = gzip.compress(record, 0)
    took = {}
    for n in (1000, 4000):
        best = []
        for _ in range(2):
            begun = time.perf_counter()
            found = [kind for kind, *_ in warc.salvage(member * n)]
            best.append(time.perf_counter() - begun)
            assert found == ["record"] * n
        took[n] = min(best)
    assert took[4000] < 8 * took[1000]
