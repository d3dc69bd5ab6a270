"""Main text of web pages: page structure, and a suffix array of each host over all blocks of all its pages.

A page's blocks are read in order with the region they stand in. Where the page marks its article (``article``,
``main`` or the matching roles), its blocks are the text, less the chrome inside it. Elsewhere every block outside
the chrome is left open, and in an article what stands in an element with a word of chrome in its name. Then the host
decides: the token streams of its pages are concatenated, their suffixes sorted, and substrings of ``least`` tokens or
more are boilerplate if ``pages`` distinct pages have them outside articles or in open blocks, unless ``pages``
different articles have them as plain text: that is a passage that articles share, and may be quoted anywhere. Open
blocks lose all tokens of boilerplate; plain blocks of an article stay. A token lies in such a substring exactly if it
lies in one of just ``least`` tokens, so the suffixes need no order beyond that depth.

The suffix arrays are built per batch of pages, where equal prefixes fall together, and merged by a grouping over
(host, prefix), so a host with a third of all pages is many small arrays; a batch gives ``pages`` rows of a prefix at
most, as more cannot change whether so many pages have it. Of articles' suffixes only those go into the shuffle whose
prefix may be boilerplate, by a bitmap of fixed size; the exact prefixes are joined after it. Pages are parsed twice,
in time linear in their length, and written once.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_schema, discard, in_chunks, materialize
from millrace.llm.hashing import Runs

#: HTML elements by their role here.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
CHROME = frozenset("nav header footer aside form script style noscript template iframe button select textarea svg canvas dialog menu head title object audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(("article", "main"))
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words of class and id names, and roles, that mark chrome.
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner adsbygoogle sponsor sponsored promo promotion teaser teasers comment comments disqus reply replies sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent notice gdpr newsletter subscribe subscription signup login share sharing social related recommended widget popup modal toolbar pagination pager".split()
)
#: Words that may stand beside those in a name, as in "site-footer" or "cookie-bar"; others ("no-sidebar") clear it.
NEUTRAL = frozenset(
    "area articles bar body bottom box block button buttons card cards container form global grid icon icons inner item items left links list main outer page panel posts primary right row secondary "
    "section site slot stories thread top unit wrap wrapper zone".split()
)
#: Of a section's id only these count, and a heading's id not at all, for ids there are often made from titles.
COMMENT_NAMES = frozenset("comment comments disqus reply replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

#: Fixed value: bits of the bitmap that thins articles' suffixes, 8 MB; where more prefixes are shared, more rows are shuffled.
_BITS = 1 << 26

# outside quotes a tag does not go beyond the start of another, so no stretch is tried from more than three starts
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/><\"']*+)((?:[^<>\"']|<(?![a-zA-Z/!?])|\"[^\"]*\"|'[^']*')*+(?=>)|[^<>]*+(?=>))>", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for found in _ATTRIBUTE.finditer(text):
        out.setdefault(found[1].lower(), (found[2] or found[3] or found[4] or "").lower())
    return out


def _is_named(name: str, held: dict[str, str]) -> bool:
    """Whether a class or the id is a name of chrome: all its words mark chrome or are neutral, and one does mark it."""
    for kind in ("class", "id"):
        marking = CHROME_NAMES
        if kind == "id" and (name in HEADINGS or name == "section"):
            marking = COMMENT_NAMES if name == "section" else frozenset()
        for one in _SPACE.split(held.get(kind, "")):
            parts = _WORDS.findall(one)
            if parts and not marking.isdisjoint(parts) and all(p in CHROME_NAMES or p in NEUTRAL for p in parts):
                return True
    return False


def _chrome(name: str, held: dict[str, str]) -> int:
    """2 for chrome, 1 for what may also wrap an article (chrome by a class or id name, and forms), 0 for neither."""
    if name in CHROME:
        return 1 if name == "form" else 2
    if not held or name in ("html", "body", "article", "main"):
        return 0
    role = held.get("role")
    if "hidden" in held or held.get("aria-hidden") == "true" or role in CHROME_ROLES and role != "form":
        return 2
    return 1 if role == "form" or _is_named(name, held) else 0


def _in_doubt(name: str, held: dict[str, str]) -> bool:
    """Whether a word of chrome stands in a class or the id, whatever is beside it; ids of headings and sections are titles."""
    kinds = ("class",) if name in HEADINGS or name == "section" else ("class", "id")
    return any(not CHROME_NAMES.isdisjoint(_WORDS.findall(held.get(kind, ""))) for kind in kinds)


def blocks(page: str) -> tuple[list[str], bool]:
    """Candidate blocks in page order and whether an article is marked; then the blocks are its own."""
    return regions(page)[:2]


def regions(page: str) -> tuple[list[str], bool, list[str], list[bool]]:
    """``blocks``, the blocks beside them (chrome, and what stands outside the marked article), and which blocks are open.

    A main part, or an article that bears no name of chrome itself, outweighs a wrapper that is chrome by its name only,
    unless another part is marked outside such wrappers (then it is a teaser or a comment). Articles within an article
    are its comments, and go unless they hold more than the rest of it.
    A page whose marked parts are empty counts as unmarked, and one whose chrome takes all is read without such names.
    """
    made = _regions(page, 1)
    return made if made[0] else _regions(page, 2)


def _regions(page: str, least: int) -> tuple[list[str], bool, list[str], list[bool]]:
    """``regions`` where chrome is what ``_chrome`` gives ``least`` or more.

    White space within a block is one space; inline tags join their text, all others part blocks. Unclosed
    elements end with what holds them, and a stray end tag is passed over.
    """
    out: list[tuple[str, int, bool, bool]] = []  # text, in a container (-1: in chrome), in an article's article, in doubt
    parts: list[str] = []
    passed: list[str] = []  # parts in chrome
    stack: list[tuple[str, int, int, bool, bool]] = []  # name, in chrome, in a container (1: one in a wrapper named as chrome), in an article's article, in doubt
    places: dict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by name
    outer: list[int] = []  # those of elements that are not inline
    chrome, inside, nested, doubt = 0, 0, False, False
    at, last = 0, page.rfind(">")

    def end_block() -> None:
        for held, where in ((parts, inside), (passed, -1)):
            if held:
                text = " ".join(htmllib.unescape("".join(held)).split())
                if text:
                    out.append((text, where, nested, doubt))
                held.clear()

    def close(depth: int) -> None:
        nonlocal chrome, inside, nested, doubt
        while len(stack) > depth:
            name = stack.pop()[0]
            places[name].pop()
            if name not in INLINE:
                outer.pop()
        chrome, inside, nested, doubt = stack[-1][1:] if stack else (0, 0, False, False)

    while at < len(page):
        # where no tag can end, each "<" would be tried to the end of the page
        found = _TAG.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        text = page[at : found.start() if found else len(page)]
        if text:
            (passed if chrome else parts).append(text)
        if not found:
            break
        at, name = found.end(), (found[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            end_block()
        if found[1]:
            # a stray end tag is passed over, and an inline element never closes the blocks opened within it
            if places[name] and not (name in INLINE and outer and outer[-1] > places[name][-1]):
                close(places[name][-1])
            continue
        if name in VOID:
            continue
        if name in RAW:
            if found[3].rstrip().endswith("/") and name not in ("script", "style"):
                continue
            ended = _RAW_END[name].search(page, at)
            at = ended.end() if ended else len(page)
            continue
        if found[3].rstrip().endswith("/") and name in ("svg", "path", "circle", "rect"):
            continue
        if name in CLOSES_P and places["p"] and outer[-1] == places["p"][-1]:
            close(outer[-1])
        held = _attributes(found[3]) if found[3] else {}
        own = _chrome(name, held)
        main = name == "main" or held.get("role") == "main"
        contained = main or name in CONTAINERS
        if contained and not main and (chrome or inside) and (chrome and inside or least < 2 and _is_named(name, held)):
            contained, own = False, max(own, 1)
        if contained and chrome < 2 and own < 2:
            nested = nested or name == "article" and bool(places["article"])
            chrome, inside = 0, inside or (1 if chrome else 2)
        else:
            chrome = max(chrome, own if own >= least else 0)
        places[name].append(len(stack))
        if name not in INLINE:
            outer.append(len(stack))
            doubt = not contained and (doubt or bool(held) and _in_doubt(name, held))
        stack.append((name, chrome, inside, nested, doubt))
    end_block()
    level = max(0, max((one[1] for one in out), default=0))
    flat = sum(len(one[0]) if one[2] else -len(one[0]) for one in out if one[1] == level) <= 0
    main, rest = [], []
    for one in out:
        (rest if one[1] != level or flat and one[2] else main).append(one)
    return [one[0] for one in main], level > 0, [one[0] for one in rest], [not level or one[3] for one in main]


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` tokens, and each one's rank; equal ranks share that prefix.

    By doubling: ranks of pairs of ranks, from single tokens up; a suffix's end sorts before any token.
    """
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    width = 1
    while width < depth:
        step = min(width, depth - width)
        behind = np.zeros(len(rank), dtype=np.int64)
        behind[: max(0, len(rank) - step)] = rank[step:]
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + behind, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        width += step
    return np.argsort(rank, kind="stable"), rank


def _parsed(batches: Iterator[pa.RecordBatch], html: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[list[str], bool, list[str], list[bool]]]]]:
    """Batches of bounded text size with the regions of their pages; ``html`` is the column's place."""
    for batch in batches:
        texts = batch.column(html).to_pylist()
        for a, b in in_chunks(texts):
            yield batch.slice(a, b - a), [regions(x or "") for x in texts[a:b]]


def _tokens(held: list[str]) -> list[bytes]:
    return " ".join(held).encode().split()


def _open_stretches(main: list[str], is_open: list[bool]) -> list[list[str]]:
    return [[text for text, _ in held] for which, held in groupby(zip(main, is_open), key=lambda one: one[1]) if which]


def outside_runs(pages: DataFrame, least: int, most: int) -> DataFrame:
    """(host, prefix) of the runs of ``least`` tokens that ``most`` pages of a host have outside articles or in open blocks.

    ``pages``: host, page (a long), html.
    """
    schema = "host string, prefix long, page long"
    arrow = arrow_schema(pages.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, made in _parsed(batches, 2):
            hosts, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (hosts[i], ids[i]))
            streams = [(i, _tokens(held)) for i in order for held in (made[i][2], *_open_stretches(made[i][0], made[i][3]))]
            runs = Runs([words for _, words in streams])
            place, _ = runs.starts(least)
            if not len(place):
                continue
            suffixes, rank = suffix_array(runs.words, least)
            valid = np.zeros(len(runs.words), dtype=bool)
            valid[place] = True
            suffixes = suffixes[valid[suffixes]]
            stream = np.searchsorted(runs.first, suffixes, side="right") - 1
            row = np.array([i for i, _ in streams])[stream]
            host, page = np.unique(np.array(hosts, dtype=object), return_inverse=True)[1][row], np.array(ids)[row]
            # suffixes of one prefix and host stand together, by page: the first ``most`` pages of each count
            head = np.ones(len(suffixes), dtype=bool)
            head[1:] = (rank[suffixes[1:]] != rank[suffixes[:-1]]) | (host[1:] != host[:-1])
            other = head.copy()
            other[1:] |= page[1:] != page[:-1]
            nth = np.cumsum(other)
            kept = other & (nth - np.maximum.accumulate(np.where(head, nth, 0)) < most)
            prefix = runs.grams(least)[suffixes[kept]].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[kept])), pa.array(prefix), pa.array(page[kept])], schema=arrow)

    # one deal for both groupings; a prefix has few rows of each batch
    found = pages.mapInArrow(run, schema).repartition("host", "prefix").distinct()
    return found.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most).select("host", "prefix")


def prefix_bits(prefixes: DataFrame) -> np.ndarray:
    """Bitmap of ``_BITS`` bits of all values of ``prefix``, two bits each."""
    first, second = (F.expr(f"{x} & {_BITS - 1}") for x in ("prefix", "shiftrightunsigned(prefix, 32)"))
    at = prefixes.select(F.explode(F.array(first, second)).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).collect()
    bits = np.zeros(_BITS >> 6, dtype=np.int64)
    bits[[r.word for r in rows]] = [r.bits for r in rows]
    return bits.view(np.uint64)


def _may_be(bits: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Whether each prefix may be one of the bitmap's; none of those is missed."""
    out = np.ones(len(prefix), dtype=bool)
    for at in (prefix & np.uint64(_BITS - 1), (prefix >> np.uint64(32)) & np.uint64(_BITS - 1)):
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return out


def _with_hits(pages: DataFrame, bits: np.ndarray, least: int) -> DataFrame:
    """Parsed pages with the runs that may be boilerplate and lie whole in open or whole in plain blocks; ``pages``: page_id, url, host, html."""
    schema = "page_id long, url string, host string, blocks array<string>, hits array<struct<start: int, prefix: long, open: boolean>>"
    arrow = arrow_schema(pages.sparkSession, schema)
    held_bits, some = pages.sparkSession.sparkContext.broadcast(bits), bool(bits.any())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, made in _parsed(batches, 3):
            page = start = np.zeros(0, dtype=np.int64)
            prefix, is_open = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
            if some:
                runs = Runs([_tokens(main) for main, _, _, _ in made])
                place, page = runs.starts(least)
                prefix = runs.grams(least)[place]
                open_words = np.concatenate([[0], np.cumsum([which for main, _, _, flags in made for text, which in zip(main, flags) for _ in range(len(text.encode().split()))])]).astype(np.int64)
                n_open = open_words[place + least] - open_words[place]
                kept = _may_be(held_bits.value, prefix) & ((n_open == 0) | (n_open == least))
                page, prefix, is_open = page[kept], prefix[kept], n_open[kept] > 0
                start = place[kept] - runs.first[page]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(page, minlength=len(made)))]).astype(np.int32)
            hit = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(prefix.view(np.int64)), pa.array(is_open)], fields=list(arrow.field(4).type.value_type))
            hits = pa.ListArray.from_arrays(pa.array(offsets), hit, type=arrow.field(4).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([main for main, _, _, _ in made], arrow.field(3).type), hits], schema=arrow)

    return pages.mapInArrow(run, schema)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 12, distinct_pages: int = 3) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars, n_removed (tokens taken as the host's boilerplate).

    Null or empty html gives an empty text. Rows with a null page_id or url are extracted like others; a null url is
    a host of its own, and null ids count as one page. Repeated rows each give a row.
    """
    plain = F.array_join("blocks", " ")
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    given = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    shared = materialize(outside_runs(given.select("host", F.coalesce("page_id", F.lit(-1)).alias("page"), "html"), least, distinct_pages), "outside-runs")
    read = materialize(_with_hits(given, prefix_bits(shared), least), "page-blocks")
    some_open = F.exists("hits", lambda x: x["open"])
    done = read.where(~some_open).select("page_id", "url", plain.alias("text"), F.lit(0).cast("long").alias("n_removed"))
    keyed = read.where("size(hits) > 0").withColumn("row", F.xxhash64("page_id", "url", "hits", plain))
    hits = keyed.select("host", "row", F.xxhash64(plain).alias("article"), F.inline("hits")).join(shared, ["host", "prefix"], "left_semi")
    hits = materialize(hits, "repeat-hits")
    passages = hits.where("not open").select("host", "prefix", "article").distinct().groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= distinct_pages)
    gone = hits.where("open").join(passages, ["host", "prefix"], "left_anti")
    repeats = materialize(gone.groupBy("row").agg(F.collect_set("start").alias("starts")), "repeat-starts")
    discard(shared, hits)

    schema = "page_id long, url string, text string, n_removed long"
    arrow = arrow_schema(pages.sparkSession, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for held, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = _tokens(held)
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for s in starts or ():
                    gone[s] += 1
                    gone[s + least] -= 1
                covered = np.cumsum(gone[: len(words)]) > 0
                texts.append(" ".join(held) if not covered.any() else b" ".join(w for w, g in zip(words, covered) if not g).decode())
                removed.append(int(covered.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], schema=arrow)

    rest = keyed.where(some_open).join(repeats, "row", "left").select("page_id", "url", "blocks", "starts").mapInArrow(cut, schema)
    both = done.unionByName(rest)
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_removed")
