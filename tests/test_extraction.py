"""Validation, relation building, extraction with fake clients, readers."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tempora import schemas
from tempora.operators import relations
from tempora.operators.validate import Validator, parse_output, validated
from tempora.plans import extract
from tempora.sources import pages, readers, sinks, workbook
from tests.records import frame, person

ARTICLE = {"article_id": "a1", "title": "t", "source": "s", "published_at": "2026-04-10T10:00:00Z", "url": "u", "text": "Israel struck Iran near Tehran. Iran threatened Israel."}
ENTITIES = [{"name": "Israel", "type": "NationState"}, {"name": "Iran", "type": "NationState"}, {"name": "Tehran", "type": "StrategicLocation"}]


def payload(**event):
    e = {"event_type": "AttackEvent", "event_date": "", "date_precision": "day", "location": "Tehran", "participants": [person("Israel", "NationState", "initiator"), person("Iran", "NationState", "target")], "relations": [{"source": "Israel", "target": "Iran", "type": "ATTACKED", "evidence": "Israel struck Iran"}], "summary": "s", "evidence": "Israel struck Iran", "confidence": 0.9}
    return {"entities": ENTITIES, "relations": [], "events": [e | event]}


def test_valid_payload():
    v = Validator(ARTICLE)
    out = v.check(payload())
    assert not v.errors and out["events"][0]["event_date"] == "2026-04-10" and len(out["relations"]) == 1
    assert out["events"][0]["event_id"] == "event:a1:001:attackevent:israel-struck-iran"


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"event_type": "X"}, "events[0].event_type must be one of"), ({"event_date": "2026"}, "events[0].event_date must be a date-like string"), ({"confidence": True}, "events[0].confidence must be a number"),
        ({"evidence": "ISRAEL struck Iran"}, "events[0].evidence must be an exact quote"), ({"location": "Rome"}, "references missing entity 'Rome'"), ({"participants": []}, "must contain at least one valid participant"),
        ({"relations": [{"source": "Israel", "target": "Iran", "type": "PRESSURED", "evidence": "x"}]}, "relations[0].type must be one of"), ({"odd": 1}, "has unsupported keys: odd."), ({"participants": [person("Iran", "NonStateActor", "target")]}, "must match entity type 'NationState'"),
    ],
)
def test_strict_rejects(change, message):
    v = Validator(ARTICLE)
    assert v.check(payload(**change)) is None and any(message in e for e in v.errors)


def test_partial_keeps_the_rest():
    v = Validator(ARTICLE, partial=True)
    p = payload(relations=[{"source": "Israel", "target": "Iran", "type": "ATTACKED", "evidence": "no quote"}, {"source": "Israel", "target": "Iran", "type": "ATTACKED", "evidence": "Israel struck Iran"}])
    p["relations"] = [{"source": "Iran", "target": "Israel", "type": "THREATENED", "evidence": "paraphrase"}]
    out = v.check(p)
    assert len(out["events"]) == 1 and len(out["relations"]) == 1 and len(v.dropped) == 1


def test_validated_table(spark):
    rows = spark.createDataFrame([("a1", ARTICLE["text"], "2026-04-10", "```json\n" + json.dumps(payload()) + "\n```"), ("a2", "x", None, "nope"), ("a3", "x", None, None)], "article_id string, text string, published_at string, raw string")
    got = {r["article_id"]: r for r in validated(rows).collect()}
    assert got["a1"]["errors"] == [] and json.loads(got["a1"]["payload"])["entities"] == ENTITIES
    assert got["a2"]["payload"] is None and got["a2"]["errors"][0].startswith("Model returned invalid JSON") and got["a3"]["payload"] is None


def test_parse_output():
    assert parse_output('x {"a": {"b": 1}} y') == {"a": {"b": 1}}


@pytest.mark.parametrize("kind", ["AttackEvent", "ThreatEvent", "BlockadeEvent", "SupportEvent", "SanctionEvent", "NegotiationEvent", "Other"])
@pytest.mark.parametrize("union", [False, True])
def test_relations_by_rule_agree(spark, kind, union):
    people = [person("A", "NationState", "initiator"), person("B", "NationState", "target"), person("C", "NationState", "participant"), person("a", "NationState", "target"), person("D", "StrategicLocation", "affected_location"), person("E", "NationState", "supporter"), person("F", "NationState", "sanctioning_actor"), person("G", "NationState", "participant"), person("H", "MilitaryAsset", "military_asset")]
    df = spark.createDataFrame([(kind, people)], f"kind string, people array<{schemas.PARTICIPANT}>")
    got = df.select(relations.built_relations(F.col("kind"), F.col("people"), F.lit("q"), union).alias("r")).first()["r"]
    assert [x.asDict() for x in got] == extract.linked(kind, people, "q", union)
    repaired = df.select(relations.repaired_roles(F.col("kind"), F.col("people")).alias("p")).first()["p"]
    assert [x.asDict() for x in repaired] == extract.repaired(kind, people)


def test_location_takes_part_once(spark):
    df = spark.createDataFrame([([person("tehran", "StrategicLocation", "target")],)], f"p array<{schemas.PARTICIPANT}>")
    assert len(df.select(relations.with_location(F.col("p"), F.lit("Tehran")).alias("p")).first()["p"]) == 1
    assert df.select(relations.with_location(F.col("p"), F.lit("Natanz")).alias("p")).first()["p"][1]["role"] == "affected_location"


class Fake:
    def __init__(self, replies):
        self.replies = list(replies)

    def chat(self, **request):
        return {"message": {"content": self.replies.pop(0)}}


def session(*replies):
    return extract.Session(Fake([r if isinstance(r, str) else json.dumps(r) for r in replies]), "m")


def test_oneshot_repairs_then_salvages():
    record, _ = extract.extract_oneshot(session("no json", payload()), ARTICLE)
    assert "validation_status" not in record and len(record["events"]) == 1
    bad = payload()
    bad["relations"] = [{"source": "Iran", "target": "Israel", "type": "THREATENED", "evidence": "paraphrase"}]
    record, _ = extract.extract_oneshot(session(bad, bad, bad), ARTICLE)
    assert record["validation_status"] == "partial" and len(record["validation_warnings"]) == 1
    with pytest.raises(extract.ExtractionError):
        extract.extract_oneshot(session("x", "y", "z"), ARTICLE)


def test_staged_run():
    candidates = {"event_candidates": [{"evidence": "israel struck Iran", "event_type_hint": "Odd"}, {"evidence": "Israel struck Iran", "event_type_hint": "AttackEvent"}, {"evidence": "not there"}]}
    kind = {"keep": True, "event_type": "AttackEvent", "event_date": "2026-04-10", "date_precision": "day", "location": "Tehran", "summary": "s", "confidence": 0.8}
    people = {"participants": [person("Israel", "NationState", "initiator"), person("Iran", "NationState", "target")]}
    record, notes = extract.extract_staged(session(candidates, {"keep": False, "drop_reason": "r"}, kind, people, kind | people), ARTICLE)
    assert notes["candidate_count"] == 2 and notes["dropped"][0]["stage"] == "classification" and len(record["events"]) == 1
    assert {(r["source"], r["target"]) for r in record["relations"]} == {("Israel", "Iran"), ("Israel", "Tehran")}


def test_hybrid_without_verifier():
    candidate = {"events": [payload()["events"][0] | {"event_id": "e", "event_date": "2026-04-10"}, {"event_type": "AttackEvent", "evidence": "x", "participants": []}], "entities": ENTITIES, "model": "old"}
    record, notes = extract.extract_hybrid(session(), ARTICLE, candidate, verify=False)
    assert len(record["events"]) == 1 and notes["dropped_count"] == 1 and record["candidate_model"] == "old"
    assert [p["name"] for p in record["events"][0]["participants"]] == ["Israel", "Iran", "Tehran"]


def make_client():
    return Fake([json.dumps(payload())] * 50)


def test_extract_table(spark):
    articles = frame(spark, [ARTICLE, ARTICLE | {"article_id": "a2"}, ARTICLE | {"article_id": "a3", "text": "nothing"}], schemas.ARTICLE)
    reply = json.dumps(payload())

    class Local:
        def chat(self, **request):
            return {"message": {"content": reply}}

    done = spark.createDataFrame([("a2",)], "article_id string")
    out = {r["article_id"]: r for r in extract.extract(articles, lambda: Local(), "m", done=done).collect()}
    assert set(out) == {"a1", "a3"} and out["a1"]["status"] == "ok" and out["a3"]["status"] == "failed"
    hybrid = extract.extract(articles, lambda: Local(), "m", "hybrid", candidates=spark.createDataFrame([], "article_id string, record string, rec_ord long"))
    assert {r["error"] for r in hybrid.collect()} == {"No candidate record for the article."}


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"article_id": "x", "entities": [{"name": "n", "type": 3}]}\n\n{"article_id": "y", "entities": null}\n')
    got = readers.jsonl(spark, path, schemas.EXTRACTION).orderBy("rec_ord").collect()
    assert [r["article_id"] for r in got] == ["x", "y"]
    bad = write(tmp_path / "b.jsonl", '{"a": 1}\n[1]\n')
    assert readers.jsonl(spark, bad, "a int").count() == 2
    with pytest.raises(Exception, match="invalid JSON line .*: 2"):
        readers.jsonl(spark, bad, "a int", strict=True).collect()


def test_reference_tables(spark, tmp_path):
    aliases = write(tmp_path / "a.csv", "alias,canonical_name,canonical_type\nU.S.,America,\nHolland,Netherlands,NationState\nHolland,The Netherlands,NationState\n,x,y\n")
    got = {r["alias"]: (r["canonical_name"], r["canonical_type"]) for r in readers.aliases(spark, aliases).collect()}
    assert got["us"] == ("America", None) and got["holland"] == ("The Netherlands", "NationState") and got["uk"][0] == "United Kingdom"
    over = write(tmp_path / "o.csv", "query,latitude,longitude,display_name,source,notes\nBerlin,52.5,bad,,,\n")
    row = readers.geocode_overrides(spark, over).first()
    assert (row["latitude"], row["longitude"], row["display_name"], row["source"]) == (52.5, None, "Berlin", "override")
    assert readers.geocode_overrides(spark, str(tmp_path / "none.csv")).count() == 0
    cache = write(tmp_path / "c.json", json.dumps({"berlin": {"query": "Berlin", "latitude": 1.0, "longitude": 2.0}, "bad": None}))
    assert [r["query_key"] for r in readers.geocode_cache(spark, cache).collect()] == ["berlin"]


@pytest.mark.parametrize("content", ['["a", {"article_id": "b"}, 3]', '{"article_id": "a"}\n{"article_id": "b"}\n', "a\n\nb\n", 'a\n{"article_id": "b"}\n'])
def test_article_ids(spark, tmp_path, content):
    got = {r["article_id"] for r in readers.article_ids(spark, write(tmp_path / "ids", content)).collect()}
    assert {"a", "b"} <= got


def test_article_ids_keep_their_order(spark, tmp_path):
    ids = readers.article_ids(spark, write(tmp_path / "ids", "c\na\nb\na\n")).orderBy("ord")
    assert [r["article_id"] for r in ids.collect()] == ["c", "a", "b"]


def test_done_ids(spark, tmp_path):
    (tmp_path / "records").mkdir()
    write(tmp_path / "records/part-0", '{"article_id": "a", "events": []}\n{"title": "x"}\n{"article_id": "b", "ev')
    assert [r["article_id"] for r in readers.done_ids(spark, str(tmp_path / "records")).collect()] == ["a"]
    assert readers.done_ids(spark, str(tmp_path / "none")).count() == 0


def test_prompts_say_roles_and_rules():
    asked = extract.prompt("task", "extraction", {"article_id": "a", "text": "body"}, text=True)[1]["content"]
    assert "Roles and relations:" in asked and "How the reply is checked:" in asked and "body" in asked
    for kind, roles in extract.ontology.PROMPT_ROLES.items():
        assert f"- {kind} has {', '.join(roles)}; {extract.ontology.RELATION_OF_EVENT[kind]} runs " in asked
    assert "from initiator to the first of affected_location, target that is filled" in asked
    assert "Roles and relations" in extract.prompt("t", "participants", {})[1]["content"] and "reply is checked" not in extract.prompt("t", "classification", {})[1]["content"]


def page(payloads, extra=""):
    data = json.dumps(json.dumps({"data": payloads}))[1:-1]
    return f'<html lang="en"><script>window.__INITIAL_DATA__="{data}";</script>{extra}</html>'


def test_article_page(spark, tmp_path):
    block = lambda kind, *inner: {"type": kind, "model": {"blocks": list(inner)}}
    para = lambda t: {"type": "paragraph", "model": {"text": t}}
    content = {"model": {"blocks": [block("text", para("One &amp; two"), para("Sign up for more")), block("image", block("caption", para("hidden"))), block("text", para("One & two"), para("Three"))]}}
    meta = {"seoHeadline": "H", "firstPublished": 1775779200000, "locators": {"canonicalUrl": "https://x/news/articles/abc1"}, "section": {"name": "World"}}
    html = page({"article?id=1": {"data": {"metadata": meta, "content": content}}}, '<script type="application/ld+json">{"author": {"name": "Ann"}}</script>')
    write(tmp_path / "a.html", html)
    write(tmp_path / "b.html", "<html></html>")
    out = {r["filename"]: r for r in pages.ingest(spark, str(tmp_path)).collect()}
    a = out["a.html"]["article"]
    assert (a["article_id"], a["text"], a["authors"], a["published_at"], a["word_count"], a["language"]) == ("abc1", "One & two\n\nThree", ["Ann"], "2026-04-10T00:00:00+00:00", 4, "en")
    assert out["b.html"]["error"] == "Missing initial data script"
    counts = {(r["kind"], r["label"]): r["count"] for r in pages.ingest_counts(pages.ingest(spark, str(tmp_path))).collect()}
    assert counts["article_count", None] == 1 and counts["section", "World"] == 1


def test_crawl(spark):
    def listing(number, *items):
        return page({"simple-promo-grid?p": {"data": {"page": {"index": number, "total": 3}, "promos": [dict(zip(("url", "type", "lastPublished"), i)) for i in items]}}})

    site = {1: listing(1, ("/news/articles/a1", "article", "2026-04-10T00:00:00Z"), ("/news/live/x", "live", "2026-04-10T00:00:00Z")), 2: listing(2, ("/news/articles/a1", "article", "2026-04-10T00:00:00Z"), ("/news/articles/a2", "article", None)), 3: listing(3)}
    fetched = []

    def fetch(url):
        number = int(url.partition("page=")[2] or 1)
        fetched.append(number)
        return site[number]

    promos = pages.crawl(spark, "https://x/topic", fetch, since="2026-04-01", most_pages=2)
    assert fetched == [1, 2] and promos.count() == 3
    assert [r["filename"] for r in promos.where("wanted").collect()] == ["2026-04-10__a1.html"]
    assert tuple(pages.crawl_counts(promos).first()) == (3, 1, 1, 1)


def test_crawl_is_strict_about_days_and_soft_about_listings(spark):
    def listing(total, *stamps):
        return page({"simple-promo-grid?p": {"data": {"page": {"index": 1, "total": total}, "promos": [{"url": f"/news/articles/a{k}", "type": "article", "lastPublished": x} for k, x in enumerate(stamps)]}}})

    def fetch(url):
        if "page=2" in url:
            raise OSError("gone")
        return listing(3, "2026-04-10T23:00:00-05:00", "2026-04-11T00:00:00Z")

    failures = []
    promos = pages.crawl(spark, "https://x/topic", fetch, since="2026-04-01", until="2026-04-10", failures=failures)
    assert [r["article_id"] for r in promos.where("wanted").collect()] == ["a0"] and promos.count() == 2
    assert [(("page=2" in u), e) for u, e in failures] == [(True, "gone")]
    with pytest.raises(OSError):
        pages.crawl(spark, "https://x/topic", fetch)
    for day in ("2026-4-1", "soon", "2026-02-30"):
        with pytest.raises(ValueError):
            pages.crawl(spark, "https://x/topic", fetch, since=day)
    for stamp in ("yesterday", "2026-02-30T00:00:00Z", "10 April 2026"):
        with pytest.raises(Exception, match="Invalid time stamp"):
            pages.crawl(spark, "https://x/topic", lambda url: listing(1, stamp), until="2026-12-31").collect()
    nothing = []
    assert pages.crawl(spark, "https://x/topic", lambda url: "no page", failures=nothing).count() == 0 and len(nothing) == 1


def test_download(spark, tmp_path):
    store = str(tmp_path / "pages")
    promos = spark.createDataFrame([("h", f"u{k}", "article", "2026-04-10", 1, f"a{k}", f"f{k}.html", k < 3) for k in range(4)], "headline string, url string, type string, published_at string, page_number int, article_id string, filename string, wanted boolean")

    def maker(bad, text):
        def fetch(url):
            if url == bad:
                raise RuntimeError("gone")
            return f"{text} {url}"

        return lambda: fetch

    told = lambda m: {r["filename"]: (r["status"], r["error"]) for r in m.collect()}
    first = pages.download(promos, store, maker("u1", "old"))
    assert told(first) == {"f0.html": ("downloaded", None), "f1.html": ("failed", "gone"), "f2.html": ("downloaded", None)}
    assert tuple(pages.download_counts(first).first()) == (2, 0, 1)
    again = pages.download(promos, store, maker("", "new"))
    assert told(again) == {"f0.html": ("exists", None), "f1.html": ("downloaded", None), "f2.html": ("exists", None)}
    pages.download(promos.where("article_id = 'a0'"), store, maker("", "newer"), overwrite=True)
    assert {r["filename"]: r["page"] for r in pages.stored(spark, store).collect()} == {"f0.html": "newer u0", "f1.html": "new u1", "f2.html": "old u2"}
    assert {r["error"] for r in pages.parse_pages(pages.stored(spark, store)).collect()} == {"Missing initial data script"}


def test_workbook(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "r.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Article ID</t></si><si><r><t>Gold </t></r><r><t>Index</t></r></si><si><t>a1</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>3.0</v></c></row><row><c r="B3"><v>9</v></c></row><row><c r="A4" t="inlineStr"><is><t>a2</t></is></c></row></sheetData></worksheet>')
    got = workbook.read(spark, str(tmp_path / "r.xlsx")).orderBy("rec_ord").collect()
    assert [(r["article_id"], r["gold_index"]) for r in got] == [("a1", "3"), ("a2", None)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", None), (0, "a", 'x "y"\nz')], "rec_ord long, article_id string, error string")
    sinks.jsonl(rows, str(tmp_path / "j"), ["rec_ord"], one_file=True)
    assert [json.loads(x) for f in sorted((tmp_path / "j").glob("part*")) for x in f.read_text().splitlines()] == [{"article_id": "a", "error": 'x "y"\nz'}, {"article_id": "b", "error": None}]
    sinks.csv(rows, str(tmp_path / "c"), ["article_id", "error"], ["rec_ord"])
    back = readers.csv(spark, str(tmp_path / "c"), ["article_id", "error", "other"]).orderBy("rec_ord").collect()
    assert [(r["article_id"], r["error"], r["other"]) for r in back] == [("a", 'x "y"\nz', None), ("b", None, None)]
    cache = spark.createDataFrame([("q", "Q", 1.0)], "query_key string, query string, latitude double")
    sinks.geocode_cache(cache, str(tmp_path / "cache"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "cache").glob("part*"))) == {"q": {"query": "Q", "latitude": 1.0}}
