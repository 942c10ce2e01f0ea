"""Main text of web pages: a host's suffix array over all its pages, and tags as evidence.

A page is read once, as a stream of tags and text. Text in menus, sidebars, notices, adverts, forms, reader comments and the like, by tag, role, class or id, is furniture. Text inside <article>, <main> or an element named as one is the article. All else is in doubt: whole pages without an article element, and parts of an article whose names are used for furniture and for parts of articles alike (header, banner, related, ...).

The token streams of all pages of a host, articles too, make its suffix array (suffix.py), which is sorted by tokens: neighbours of distinct pages that have at least LONG tokens in common are shared text. Runs in doubt that distinct pages share in doubt or outside an article are boilerplate and are removed; the unique runs are kept. A named part of fewer tokens is one run. What the array finds in an article is checked against the tags: shared runs there are reprints and stay, and n_shared counts them on each row.

Defined cases: null html is empty text; an empty table gives no rows. Pages without host (null or odd url) share the host ''. Repeated rows (same page_id and html) are one page to the suffix array, and each gets its row; rows that share a page_id and differ are different pages. White space is what Unicode takes for it. Script, style and other raw elements that never close run to the end of the page; an unclosed menu or the like ends where the article begins. A page of any length is read whole, in time that grows with its length. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import map_batches, parallelism, table
from quillon.llm.suffix import FIXED, LOOSE, NAMED, pack_streams, shared_runs, unpack_streams

#: Tokens of a run that counts as long.
LONG = 8

# What HTML elements, roles and usual names of classes mean.
RAW = frozenset("script style title textarea iframe noscript template svg math object select xmp noframes".split())
FURNITURE_TAGS = frozenset("nav footer aside form button menu dialog head".split())
FURNITURE_NAMES = frozenset(
    """ad ads advert adverts advertisement adsense aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer header login masthead menu
    modal nav navbar navigation newsletter notice notices pager pagination popup promo recommended related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split()
)
#: Of these, names that parts of an article have as well.
DOUBTFUL_NAMES = frozenset("header banner masthead related recommended".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
ARTICLE_TAGS = frozenset(["article", "main"])
ARTICLE_NAMES = frozenset("article articlebody post postbody entry story content maincontent".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_OPEN = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)|<[!?/][^>]*+>", re.S)
_PLAIN = re.compile(r"[^>\"']*+")
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_raw_end = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


def _kind(tag: str, attributes: str, in_article: bool) -> str:
    """'furniture', 'article', 'doubt' or '' for an opening tag."""
    names: set[str] = set()
    role = ""
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                for word in value.split():
                    names.update(p.lower() for p in _NAME.findall(word))
                    names.add(re.sub("[^a-z]", "", word.lower()))
            elif key == "role":
                role = value.lower()
            elif key == "hidden" or key == "style" and _HIDDEN.search(value.lower()):
                return "furniture"
    if tag in FURNITURE_TAGS or role in FURNITURE_ROLES:
        return "furniture"
    if tag not in ("body", "html") and (named := names & FURNITURE_NAMES):
        if not in_article or named - DOUBTFUL_NAMES:
            return "furniture"
        return "" if tag in INLINE else "doubt"
    if tag == "header" and not in_article:
        return "furniture"
    if tag in ARTICLE_TAGS or role in ("main", "article") or names & ARTICLE_NAMES and tag in ("div", "section", "td"):
        return "article"
    return ""


def _tag_end(page: str, at: int, last: int, dead: set[int]) -> int:
    """Where the > of a tag is whose name ends at `at`: the first outside quotes, or the first at all if quotes leave none before last. dead: quotes that are known to lead to none; each is followed once a page."""
    i, path = at, []
    while (i := _PLAIN.match(page, i, last).end()) < last and page[i] != ">":
        close = page.find(page[i], i + 1, last) if i not in dead else -1
        path.append(i)
        if close < 0:
            i = last
            break
        i = close + 1
    if i < last:
        return i
    dead.update(path)
    return page.find(">", at)


def read(page: str) -> tuple[str | None, list[tuple[int, str]], str]:
    """(the article's text, or None where no element is one; its parts in doubt by their first token; the other text). White space is one space, blocks are joined by one."""
    article: list[tuple[str, bool]] = []
    rest: list[str] = []
    seen = False
    skip, skip_depth = "", 0
    inside, depth = "", 0
    doubt, doubt_depth = "", 0
    at, n, last = 0, len(page), page.rfind(">") + 1
    dead: set[int] = set()

    def put(text: str) -> None:
        article.append((text, bool(doubt))) if inside else rest.append(text)

    while at < n:
        m = _OPEN.search(page, at, last)
        text = page[at : m.start()] if m else page[at:].partition("<!--")[0]
        if text and not skip:
            put(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            continue
        tag, closing = m[2].lower(), bool(m[1])
        end = _tag_end(page, at, last, dead)
        attributes, at = page[at:end], end + 1
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                close = _raw_end[tag].search(page, at)
                at = close.end() if close else n
            continue
        if tag not in INLINE:
            put(" ")
        if tag in VOID:
            continue
        if closing:
            if skip:
                if tag == skip:
                    skip_depth -= 1
                    if not skip_depth:
                        skip = ""
            elif doubt and tag == doubt:
                doubt_depth -= 1
                if not doubt_depth:
                    doubt = ""
            elif inside and tag == inside:
                depth -= 1
                if not depth:
                    inside = doubt = ""
            continue
        if skip and (seen or tag not in ARTICLE_TAGS):
            skip_depth += tag == skip
            continue
        kind = _kind(tag, attributes, bool(inside))
        if kind == "furniture":
            if not skip:
                skip, skip_depth = tag, 1
        elif kind == "article" and not inside:
            skip, seen, inside, depth = "", True, tag, 1
        elif kind == "doubt" and not doubt:
            doubt, doubt_depth = tag, 1
        elif tag == doubt:
            doubt_depth += 1
        elif tag == inside:
            depth += 1
    other = " ".join("".join(rest).split())
    if not seen:
        return None, [], other
    tokens: list[str] = []
    parts = []
    for in_doubt, pieces in groupby(article, lambda p: p[1]):
        own = "".join(t for t, _ in pieces).split()
        if in_doubt and own:
            parts.append((len(tokens), " ".join(own)))
        tokens += own
    return " ".join(tokens), parts, other


def repeated_tokens(streams: list[list[str]], long: int = LONG) -> list[np.ndarray]:
    """A flag for each token of each page: it lies in a run of at least `long` tokens that another page has too. Suffixes of all streams are sorted by doubling. What the dealt array gives for a host's loose streams, on one machine."""
    size = np.array([len(s) for s in streams])
    page = np.repeat(np.arange(len(streams)), size + 1)
    ids: dict[str, int] = {}
    flat = np.array([x for i, s in enumerate(streams) for x in (*(ids.setdefault(w, len(ids)) for w in s), -1 - i)], np.int64)  # each page ends in a token of its own
    n = len(flat)
    rank = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < long:
        step = min(depth, long - depth)
        after = np.full(n, -1, np.int64)
        after[: max(n - step, 0)] = rank[step:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        depth += step
    order = np.argsort(rank, kind="stable")
    edge = np.flatnonzero(np.append(True, rank[order][1:] != rank[order][:-1]))
    p = page[order]
    shared = np.minimum.reduceat(p, edge) != np.maximum.reduceat(p, edge)
    start = order[np.repeat(shared, np.diff(np.append(edge, n)))]
    cover = np.zeros(n + long + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + long, -1)
    hit = np.cumsum(cover)[:n] > 0
    first = np.cumsum(size + 1) - (size + 1)
    return [hit[a : a + k] for a, k in zip(first, size, strict=True)]


def streams(page: str) -> list[tuple[int, int, str]]:
    """A page's token streams for the suffix array, as (place of the first token in the text, kind, tokens): the article between its parts in doubt, these parts, and as evidence (place -1) what lies outside. Without an article all is in doubt."""
    article, parts, other = read(page)
    if article is None:
        return [(0, LOOSE, other)]
    out, at = [(-1, LOOSE, other)], 0
    tokens = article.split(" ") if parts else []
    for begin, part in parts:
        out += [(at, FIXED, " ".join(tokens[at:begin])), (begin, NAMED, part)]
        at = begin + part.count(" ") + 1
    return [*out, (at, FIXED, " ".join(tokens[at:]) if parts else article)]


def _decided(text: str, runs: list[dict] | None) -> tuple[str, int]:
    """(text without what the suffix array removes, tokens of it that other pages share)."""
    if not runs:
        return text, 0
    tokens = text.split(" ")
    shared, gone = np.zeros(len(tokens) + 1, np.int64), np.zeros(len(tokens) + 1, np.int64)
    for r in runs:
        for cover in (shared, gone) if r["gone"] else (shared,):
            cover[r["at"]] += 1
            cover[r["at"] + r["size"]] -= 1
    shared, gone = np.cumsum(shared)[:-1] > 0, np.cumsum(gone)[:-1] > 0
    return " ".join(w for w, g in zip(tokens, gone.tolist(), strict=True) if not g), int((shared & ~gone).sum())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every row; n_shared: tokens of the text in runs of LONG that another page of the host has as well."""
    host = F.xxhash64(F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")))
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    pages = pages.withColumn("host", host).withColumn("page", F.xxhash64("host", F.coalesce("page_id", F.lit(0)), F.col("page_id").isNull(), "html"))  # rows of one host, id and html are one page

    def parse(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [[s for s in streams(t) if s[2]] if t else [] for t in b.column(4).to_pylist()]
        at, kind = (pa.array([[s[k] for s in f] for f in found], pa.list_(pa.int32())) for k in (0, 1))
        return pa.RecordBatch.from_arrays([*b.columns[:4], at, kind, pa.array([pack_streams(f) for f in found], pa.binary())], ["page_id", "url", "host", "page", "at", "kind", "packed"])

    def decide(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*(b.column(c).to_pylist() for c in ("at", "packed", "runs")), strict=True)
        text, shared = zip(*(_decided(" ".join(s for s, a in zip(unpack_streams(p), at, strict=True) if a >= 0), r) for at, p, r in rows), strict=True)
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(shared, pa.int64())], ["page_id", "url", "text", "n_chars", "n_shared"])

    parsed = map_batches(pages.select("page_id", "url", "host", "page", "html"), parse, "page_id long, url string, host long, page long, at array<int>, kind array<int>, packed binary")
    parsed = parsed.repartition(parallelism(pages.sparkSession), "page")  # one shuffle, which keys, pieces and the last join read
    runs = shared_runs(parsed, LONG).groupBy("page").agg(F.collect_list(F.struct("at", "size", "gone")).alias("runs"))  # no more than the page's tokens
    return map_batches(parsed.join(runs.hint("merge"), "page", "left"), decide, "page_id long, url string, text string, n_chars long, n_shared long")


def op3_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
