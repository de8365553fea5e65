"""Main text of web pages: structure first, a suffix array per host for what structure doesn't tell.

Each page is parsed into text blocks. Blocks in an article (or main) element are content; blocks in menus, headers,
footers, sidebars, notices, adverts, forms and reader comments are boilerplate; what else a page has is a candidate. A
block of an article whose class, id or role names boilerplate beside words of its own ("share-price") is doubtful. The
candidates, the doubtful blocks and the boilerplate of a host's pages, as word tokens one page behind another, go into a
suffix array; runs of tokens that several dissimilar pages share mark tokens. A page with an article is its content
blocks and those doubtful ones that aren't marked almost wholly. Any other page is its candidates without the blocks
that are marked almost wholly and without long marked runs; what only near copies of a page share, and phrases or
sentences in blocks of their own words, stay.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import shuffle_partitions, spool
from tempora.llm.ngram_join import classes_and_components
from tempora.shipping import shipped

#: A run of at least so many tokens is shared if so many dissimilar pages of a host hold it.
LEAST_TOKENS, LEAST_PAGES = 6, 3
#: Shared runs are boilerplate where they cover at least this share of a block, or so many tokens of it in a row.
BLOCK_SHARE, LONG_TOKENS = 0.8, 32
#: Pages whose articles, or candidates where there is none, have this similarity in shingles of so many words are near copies: they count as one page.
NEAR_PERCENT, NEAR_WORDS = 80, 5
#: Pages of a host that are searched together, about.
GROUP_PAGES = 1000
#: Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea select title".split())
#: Of these, elements that reach to the end of the page if nothing ends them.
TEXT_RAW = frozenset("script style textarea title iframe".split())
HARD_SKIP = frozenset("nav footer aside form button head menu dialog fieldset".split())
MAIN = frozenset(("article", "main"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words in class, id and role that mark boilerplate; of the soft ones an article inside is still content.
HARD_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus discussion replies respond cookie cookies consent gdpr notice banner newsletter subscribe signup popup modal related recommended share sharing social breadcrumb breadcrumbs pagination widget navigation complementary contentinfo search".split())
SOFT_WORDS = frozenset("sidebar menu nav navbar footer header masthead topbar toolbar login".split())
#: Words that say what kind of box a name stands for, not what is in it: beside a hard word they don't make a name doubtful.
BOX_WORDS = frozenset("area bar block body bottom box btn button buttons card col column container content entry footer form grid group header holder icon icons inner inline item items js label left link links list main mobile module outer overlay panel right row section slot small large space text thread title top unit wrap wrapper zone".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*))", re.S)
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_MARK = re.compile(r"[>\"']")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: Words of a name; a capital letter behind a small one begins another.
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_HIDDEN = re.compile(r"\shidden(?=[\s=/]|\Z)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

CONTENT, CANDIDATE, BOILERPLATE, DOUBTFUL = 0, 1, 2, 3
#: What class, id and role say of an element.
PLAIN, SOFT, UNSURE, HARD = 0, 1, 2, 3


def _marked(attributes: str) -> int:
    """What class, id and role say: HARD if some name is of hard words and words for boxes, UNSURE if it has other words
    too ("share-price") or is the one word "discussion", SOFT for soft words, else PLAIN. Hidden elements are HARD."""
    found = PLAIN
    if "=" in attributes:
        for m in _MARKS.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").split():
                parts = [x.lower() for x in _WORD.findall(name)]
                if not HARD_WORDS.isdisjoint(parts):
                    if parts != ["discussion"] and all(x in HARD_WORDS or x in SOFT_WORDS or x in BOX_WORDS for x in parts):
                        return HARD
                    found = UNSURE
                elif found == PLAIN and not SOFT_WORDS.isdisjoint(parts):
                    found = SOFT
        if _HIDDEN.search(attributes):
            return HARD
    elif _HIDDEN.search(" " + attributes):
        return HARD
    return found


class TagEnds:
    """Where the tags of a page end: at the first `>` outside quotes, else at the first. A page is scanned once, however many of its tags have no end."""

    def __init__(self, html: str) -> None:
        self.html, self.places, self.ends = html, None, None

    def after(self, at: int) -> int:
        """The place behind the end of a tag of which `at` is in no quotes; some `>` follows it."""
        if self.places is None:
            m = _QUOTED.match(self.html, at)
            if m:
                return m.end()
            self._scan()
        k = bisect.bisect_left(self.places, at)
        end = self.ends[k] if k < len(self.places) else -1
        return (end if end >= 0 else self.html.index(">", at)) + 1

    def _scan(self) -> None:
        """For each mark of the page: the `>` that ends a tag in which the mark is the first of those left, or -1."""
        self.places = [m.start() for m in _MARK.finditer(self.html)]
        self.ends = [-1] * len(self.places)
        later = {'"': -1, "'": -1}  # the next quote of its kind
        for k in range(len(self.places) - 1, -1, -1):
            mark = self.html[self.places[k]]
            if mark == ">":
                self.ends[k] = self.places[k]
            else:
                if 0 <= later[mark] < len(self.places) - 1:
                    self.ends[k] = self.ends[later[mark] + 1]
                later[mark] = k


def blocks_of(html: str) -> list[tuple[int, str]]:
    """(kind, text) of a page's non-empty text blocks in page order; white space in them is one space, references are decoded."""
    out: list[tuple[int, str]] = []
    pieces: list[str] = []
    # open elements: name, kind inside it, whether a later article resets the kind
    stack: list[tuple[str, int, bool]] = []
    places: dict[str, list[int]] = {}  # of each name in the stack
    endless: set[str] = set()  # raw elements of which no end tag follows
    ends_of, last_end = TagEnds(html), html.rfind(">")
    kind, soft = CANDIDATE, True

    def pop(to: int) -> None:
        nonlocal kind, soft
        while len(stack) > to:
            places[stack.pop()[0]].pop()
        kind, soft = stack[-1][1:] if stack else (CANDIDATE, True)

    def close() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append((kind, text))

    at, length = 0, len(html)
    while at < length:
        lt = html.find("<", at)
        if lt < 0:
            pieces.append(html[at:])
            break
        if lt > at:
            pieces.append(html[at:lt])
        if lt > last_end:  # no tag ends any more: text, up to a comment
            comment = html.find("<!--", lt)
            pieces.append(html[lt:comment] if comment >= 0 else html[lt:])
            break
        m = _TAG.match(html, lt)
        if m is None:  # no tag: text
            pieces.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        at = ends_of.after(m.end())
        ends, attributes = bool(m[1]), html[m.end() : at - 1]
        if name == "br":
            pieces.append("\n")
            continue
        if ends:
            if name in BLOCK:
                close()
            opened = places.get(name)
            # an inline end tag doesn't reach out of an article
            if opened and (name in BLOCK or all(not places.get(x) or places[x][-1] <= opened[-1] for x in MAIN)):
                pop(opened[-1])
            continue
        if name in RAW:
            if not attributes.endswith("/") or name in ("script", "style"):
                end = _RAW_END[name].search(html, at) if at < last_end and name not in endless else None
                if end:
                    at = end.end()
                elif name in TEXT_RAW:
                    at = length
                else:  # an element that nothing ends is only its tag
                    endless.add(name)
            pieces.append(" ")
            continue
        if name in BLOCK:
            close()
            while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "a", "u", "font", "small"):  # end tags left out
                pop(len(stack) - 1)
        if name in VOID or attributes.endswith("/"):
            continue
        marked = PLAIN if name in ("html", "body") else _marked(attributes)
        if name in MAIN and marked < HARD:
            if kind == CANDIDATE or kind == BOILERPLATE and soft:
                kind, soft = CONTENT, True
        elif name in HARD_SKIP or marked == HARD:
            kind, soft = BOILERPLATE, False
        elif marked == UNSURE and kind == CONTENT:
            kind = DOUBTFUL
        elif (name == "header" or marked == SOFT) and kind == CANDIDATE:
            kind = BOILERPLATE
        places.setdefault(name, []).append(len(stack))
        stack.append((name, kind, soft))
    close()
    return out


def suffix_array(tokens: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and each suffix's rank, by prefix doubling; with `depth`, in order of their first tokens (at least `depth`)."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64).reshape(n)
    step = 1
    order = np.argsort(rank, kind="stable")
    while step < (depth or n) and n and rank.max() < n - 1:
        second = np.full(n, -1, dtype=np.int64)
        second[: n - step] = rank[step:] if step < n else second[: n - step]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        step *= 2
    return order, rank


def numbered_runs(streams: list[tuple[int, ...]], words: int, least_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Streams of word numbers below `words` one behind another, each followed by a number of its own; each stream's first
    place; and by place its stream and the number of its run of `least_tokens` tokens (equal runs have equal numbers)."""
    lengths = np.array([len(x) for x in streams])
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    tokens = np.empty(int(ends[-1]), dtype=np.int64)
    for ids, start in zip(streams, starts):
        tokens[start : start + len(ids)] = ids
    tokens[ends - 1] = words + np.arange(len(streams))
    width = 1
    while width < least_tokens:
        width *= 2
    # runs of exactly least_tokens: two overlapping runs of half the doubled width tell them apart
    half = width // 2 if width > 1 else 1
    _, rank = suffix_array(tokens, half)
    shift = least_tokens - half
    second = np.full(len(tokens), -1, dtype=np.int64)
    second[: len(tokens) - shift] = rank[shift:]
    run_of = np.unique(rank * (len(tokens) + 1) + second + 1, return_inverse=True)[1].reshape(len(tokens))
    return tokens, starts, np.repeat(np.arange(len(streams)), lengths + 1), run_of


def _covered(begins: np.ndarray, least_tokens: int) -> np.ndarray:
    """By place, whether one of the runs that begin at the marked places covers it."""
    hits = np.zeros(len(begins) + least_tokens, dtype=np.int64)
    at = np.flatnonzero(begins)
    np.add.at(hits, at, 1)
    np.add.at(hits, at + least_tokens, -1)
    return np.cumsum(hits)[: len(begins)] > 0


def _streams(pages: list[list[str]]) -> tuple[dict[str, int], dict[tuple[int, ...], int], list[tuple[int, ...]]]:
    """Numbers of words, numbers of distinct streams, and each page's stream of word numbers."""
    vocabulary: dict[str, int] = {}
    streams: dict[tuple[int, ...], int] = {}
    own: list[tuple[int, ...]] = []
    for page in pages:
        ids = tuple(vocabulary.setdefault(x, len(vocabulary)) for x in page)
        own.append(ids)
        streams.setdefault(ids, len(streams))
    return vocabulary, streams, own


def shared_tokens(pages: list[list[str]], least_tokens: int = LEAST_TOKENS, least_pages: int = LEAST_PAGES) -> list[np.ndarray]:
    """For each page a mask of the tokens that are covered by a run of `least_tokens` tokens which `least_pages` distinct pages share.

    Pages with equal streams count as one page.
    """
    vocabulary, streams, own = _streams(pages)
    if not streams:
        return []
    tokens, starts, page_of, run_of = numbered_runs(list(streams), len(vocabulary), least_tokens)
    pairs = np.unique(run_of * len(streams) + page_of) // len(streams)
    covered = _covered((np.bincount(pairs, minlength=len(tokens)) >= least_pages)[run_of], least_tokens)
    return [covered[starts[streams[ids]] : starts[streams[ids]] + len(ids)] for ids in own]


def _hashed(words: Iterable[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in words], dtype=np.uint64)


def _run_hashes(hashes: np.ndarray, least_tokens: int) -> np.ndarray:
    """By place a 64-bit hash of the run that begins there, from hashes of its words; 0 where less than a run is left."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    n = len(hashes) - least_tokens + 1
    if n > 0:
        mixed = np.zeros(n, dtype=np.uint64)
        for k in range(least_tokens):
            mixed = (mixed ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        out[:n] = mixed
    return out.view(np.int64)


def sharers_of_runs(pages: list[list[str]], classes: list[int], wanted: list[bool], least_tokens: int = LEAST_TOKENS, least_pages: int = LEAST_PAGES) -> tuple[list[int], list[list[int]], list[bool]]:
    """Hash of each run, up to `least_pages` distinct classes of pages that hold it, and whether a wanted page holds it."""
    vocabulary, streams, own = _streams(pages)
    if not streams:
        return [], [], []
    tokens, starts, page_of, run_of = numbered_runs(list(streams), len(vocabulary), least_tokens)
    few: list[set[int]] = [set() for _ in streams]
    asked = np.zeros(len(streams), dtype=bool)
    for ids, c, w in zip(own, classes, wanted):
        few[streams[ids]].add(c)
        asked[streams[ids]] |= w
    # a stream that many classes have tells as much with the smallest of them
    named = [sorted(x)[:least_pages] for x in few]
    lengths = np.array([len(x) for x in streams])
    whole = np.arange(len(tokens)) - starts[page_of] <= (lengths - least_tokens)[page_of]
    runs, first = np.unique(run_of[whole], return_index=True)
    hashes = _run_hashes(np.concatenate((_hashed(vocabulary), np.zeros(len(streams), np.uint64)))[tokens], least_tokens)[whole][first]
    pairs = np.unique(np.searchsorted(runs, run_of[whole]) * len(streams) + page_of[whole])
    held: list[list[int]] = [[] for _ in runs]
    wants = np.zeros(len(runs), dtype=bool)
    for run, stream in zip((pairs // len(streams)).tolist(), (pairs % len(streams)).tolist()):
        wants[run] |= asked[stream]
        if len(held[run]) < least_pages:
            held[run] = sorted({*held[run], *named[stream]})[:least_pages]
    return hashes.tolist(), held, wants.tolist()


def masks_of(pages: list[list[str]], shared: np.ndarray, least_tokens: int = LEAST_TOKENS) -> list[np.ndarray]:
    """For each page a mask of the tokens that runs with these hashes cover."""
    number: dict[str, int] = {}
    places = [np.array([number.setdefault(x, len(number)) for x in page], dtype=np.int64) for page in pages]
    hashes = _hashed(number)
    out = []
    for at in places:
        begins = np.isin(_run_hashes(hashes[at], least_tokens), shared)
        begins[max(0, len(at) - least_tokens + 1) :] = False
        out.append(_covered(begins, least_tokens))
    return out


def _kept(words: list[str], covered: np.ndarray) -> list[str]:
    """The words of a block without its boilerplate: all of it if nearly all is covered, else the long covered runs."""
    if covered.sum() >= BLOCK_SHARE * len(words):
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    gone = np.zeros(len(words), dtype=bool)
    for begin, end in zip(edges[::2], edges[1::2]):
        if end - begin >= LONG_TOKENS:
            gone[begin:end] = True
    return [word for word, lost in zip(words, gone) if not lost]


def main_text(page: list[tuple[int, str]], mask: np.ndarray) -> str:
    """Text of an open page from its blocks and the mask of the words of those that aren't content.

    With an article: content blocks, and doubtful blocks that aren't covered almost wholly. Else: what is left of candidates.
    """
    article = has_article(page)
    at, runs = 0, []
    for kind, text in page:
        if kind == CONTENT:
            runs.append(text)
            continue
        words = text.split(" ")
        covered = mask[at : at + len(words)]
        at += len(words)
        if kind == DOUBTFUL:
            if covered.sum() < BLOCK_SHARE * len(words):
                runs.append(text)
        elif kind == CANDIDATE and not article:
            unique = _kept(words, covered)
            if unique:
                runs.append(" ".join(unique))
    # a page whose every block other pages share (a mirror, say) keeps them
    return "\n".join(runs or [text for kind, text in page if kind == (DOUBTFUL if article else CANDIDATE)])


def has_article(page: list[tuple[int, str]]) -> bool:
    return any(kind in (CONTENT, DOUBTFUL) for kind, _ in page)


def is_open(page: list[tuple[int, str]]) -> bool:
    """Whether the suffix array has to decide: doubtful blocks, or candidates without an article."""
    kinds = {kind for kind, _ in page}
    return DOUBTFUL in kinds or CANDIDATE in kinds and CONTENT not in kinds


def _words(page: list[tuple[int, str]]) -> list[str]:
    return [word for kind, text in page if kind != CONTENT for word in text.split(" ")]


def extract(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html).

    A null html has an empty text. A page with an article without doubtful blocks is done when it is parsed. The blocks
    that aren't content are dealt by host, and those of a large host by row into groups of about `group_pages` pages: a
    group's suffix array finds its runs, and the pages that hold a run are counted over all groups of the host, so groups
    bound memory and don't decide. Near copies among the pages that aren't done, and equal pages that are, count as one
    page. Null and odd urls share an empty host name. Repeated rows give equal rows; other columns are ignored; an empty
    table gives an empty result. A page is parsed in one piece.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"), host.alias("host"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [blocks_of(x) if x else [] for x in batch["html"]]
            batch["text"] = ["\n".join(text for kind, text in page if kind == CONTENT) for page in found]
            batch["open"] = [is_open(page) for page in found]
            # what near copies are told by: the article, or all candidates
            batch["own"] = ["\n".join(text for kind, text in page if kind in ((CONTENT, DOUBTFUL) if has_article(page) else (CANDIDATE,))) if is_open(page) else "" for page in found]
            batch["blocks"] = [json.dumps([x for x in page if x[0] != CONTENT or is_open(page)], ensure_ascii=False) for page in found]
            yield batch[["host", "page_id", "url", "text", "open", "own", "blocks"]]

    parsed = rows.mapInPandas(parse, "host string, page_id long, url string, text string, open boolean, own string, blocks string")
    parsed = spool(parsed.withColumn("row", F.monotonically_increasing_id()), "parsed-pages")
    out = ["page_id", "url", "text", F.length("text").cast("long").alias("n_chars")]
    done = parsed.where("NOT open").select(*out)
    if not parsed.where("open").head(1):
        return done

    # hosts that need several groups: fewer than 8 * partitions, since each has more than 1/(8 * partitions) of all pages
    least = max(group_pages, parsed.count() // (8 * shuffle_partitions(pages.sparkSession)))
    large = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("host", F.ceil(F.col("n") / group_pages).alias("parts"))
    dealt = parsed.join(F.broadcast(spool(large, "large-hosts")), "host", "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))))
    near = classes_and_components(parsed.where("open"), "row", "own", NEAR_WORDS, NEAR_PERCENT).select(F.col("doc_id").alias("row"), F.xxhash64(F.lit("near"), "component_id").alias("near"))
    dealt = dealt.join(near, "row", "left").withColumn("class", F.coalesce("near", F.xxhash64("text", "blocks")))

    def sharers(key, group: pd.DataFrame) -> pd.DataFrame:
        words = [_words(json.loads(x)) for x in group["blocks"]]
        runs, classes, wanted = sharers_of_runs(words, group["class"].tolist(), group["open"].tolist())
        return pd.DataFrame({"host": key[0], "part": key[1], "run": runs, "classes": pd.Series(classes, dtype=object), "wanted": wanted})

    def choose(key, group: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        found = [json.loads(x) for x in group["blocks"]]
        masks = masks_of([_words(page) for page in found], shared["run"].to_numpy(dtype=np.int64))
        return pd.DataFrame({"page_id": group["page_id"], "url": group["url"], "text": [main_text(*x) for x in zip(found, masks)]})

    counted = dealt.select("host", "part", "class", "open", "blocks").groupBy("host", "part").applyInPandas(sharers, "host string, part long, run long, classes array<long>, wanted boolean")
    counted = spool(counted, "runs")
    # each group tells at most LEAST_PAGES classes of a run; distinct ones are counted as rows, none are gathered
    told = counted.select("host", "run", "wanted", F.explode("classes").alias("class")).groupBy("host", "run", "class").agg(F.max("wanted").alias("w"))
    shared = told.groupBy("host", "run").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w")).where(F.col("w") & (F.col("n") >= LEAST_PAGES)).select("host", "run")
    back = counted.where("wanted").select("host", "part", "run").join(shared, ["host", "run"])
    chosen = dealt.where("open").select("host", "part", "page_id", "url", "blocks").groupBy("host", "part").cogroup(back.groupBy("host", "part"))
    return done.unionByName(chosen.applyInPandas(choose, "page_id long, url string, text string").select(*out))


@shipped
def op1_host_suffix_array(spark, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
