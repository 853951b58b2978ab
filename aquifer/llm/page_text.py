"""Main text of web pages by deducing each host's template.

A page is a sequence of tokens: tags and text runs, each with the path of elements around it. Over the pages of a
host, tokens with the same occurrence vector (how often they occur on which page) form an equivalence class. A
class is part of the template if it is frequent (on `least_pages` pages or more, and on a share of `support` of the
host's pages that hold tokens; a share of `layout` is enough for a class with tags, which tell a layout of its own from
a passage that many articles quote), large (two tokens or more) and, on the page at hand, ordered (its tokens follow each other in one order, once or in
rounds) and nested (each of its rounds lies in one gap of the classes found before, or encloses whole ones). What
lies between the template's tokens are the slots; a run of text that is itself a template token is no content. Slots
that belong to a menu, header, footer, sidebar, notice, advert, form, script, style or reader comments, told from
the path, go; the others are the text, from the article or main element where the page has one.

Vectors are compared as 64-bit sums over pages, so that a host's pages are never gathered: tasks add up what they read,
and one line a (host, token) is shuffled. Pages on smaller hosts have no template but their paths.

Safe side: where template runs make up more than `most_common` of an article's text (copies of one article on a host),
only those on nearly all of the host's pages (a share of `ALWAYS`) go, and none if these are too many as well.

Edge cases: a null or empty html gives empty text and does not count as a page of its host; a null url is a host of its own; repeated rows count as pages each
and are extracted each; broken markup is read on: an end tag closes what is open inside, one without a start is skipped,
an unclosed element ends with its parent, script, style, title, textarea and iframe with the page; a drawing or list of options
ends where a block starts that it can't hold, other replaced content where a block starts and no end tag follows; an
empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquifer.llm.common import as_bytes, freeze, map_batches, mix64

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>", re.S)
NAMES = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[a-z]+")

#: Elements without content, whose content is not markup, whose content is not shown as text, those of them that hold no
#: blocks, and elements that end a block of text (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())
UNSEEN = frozenset("noscript template svg math canvas object select option optgroup datalist".split())
NO_BLOCKS = frozenset("svg math select option optgroup datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead title tr ul video audio".split())
#: An element that ends an open one of the same kind (or an open paragraph) when it starts.
ENDS = {"option": {"option"}, "optgroup": {"option", "optgroup"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements, and words in class, id and role, that mark other parts of a page than the article.
ASIDE = frozenset("nav footer aside form menu dialog button label fieldset".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars aside nav "
    "navbar navigation menu menus breadcrumb breadcrumbs footer foot comment comments commentlist disqus discussion replies "
    "respond share sharing social related recommended widget widgets toolbar login search pagination pager "
    "complementary contentinfo form skip".split())
HEADS = frozenset("header masthead topbar".split())  # not inside the article
MAIN = frozenset("article main".split())
ALWAYS = 0.9  # share of a host's pages


def host_of(url: str | None) -> str:
    got = re.match(r"\s*(?:[a-zA-Z][\w+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return got.group(1).lower() if got else ""


class Run:
    """A token of a page: a tag, or a text run with what is needed to judge it."""

    __slots__ = ("key", "text", "ends_block", "article", "other", "link")

    def __init__(self, key: int, text: str | None, ends_block: bool, article: bool, other: bool, link: bool):
        self.key, self.text, self.ends_block = key, text, ends_block
        self.article, self.other, self.link = article, other, link


def marks_of(tag: str, attributes: str) -> tuple[frozenset, str]:
    """Words of class, id and role; and the class, for the path."""
    words, cls = set(), ""
    for name, a, b, c in NAMES.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                words.add("skip")
        elif name in ("hidden", "aria-hidden"):
            if value != "false":
                words.add("skip")
        else:
            words.update(PARTS.findall(value))
            if name == "class":
                cls = value
    return frozenset(words), cls


def read_page(page: str) -> list[Run]:
    """The page's tokens in order."""
    out: list[Run] = []
    # of each open element: tag, path, is it in the article, in another part, in a link
    stack: list[tuple[str, str, bool, bool, bool]] = [("", "", False, False, False)]
    at, n = 0, len(page)
    last_ends: dict[str, int] = {}

    def closes(tag: str) -> bool:
        """Is there an end tag of this kind further on?"""
        if tag not in last_ends:
            last_ends[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
        return last_ends[tag] >= at

    def text(raw: str) -> None:
        _, path, article, other, link = stack[-1]
        value = html.unescape(raw)
        plain = " ".join(value.split())
        key = xxhash.xxh3_64_intdigest(f"{path}\0{plain}") if plain else 0
        out.append(Run(key, value, False, article, other, link))

    def tag_run(sign: str, tag: str) -> None:
        _, path, article, other, link = stack[-1]
        out.append(Run(xxhash.xxh3_64_intdigest(f"{path}\1{sign}{tag}"), None, tag in BLOCK, article, other, link))

    while at < n:
        m = MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        if m.group(1) or m.group(4):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    tag_run("/", tag)
                    break
            else:
                if tag in ("p", "br"):
                    tag_run("/", tag)
            continue
        if tag in RAW:
            tag_run("", tag)
            if not (m.group(3) or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in BLOCK and stack[-1][3] and tag not in ("option", "legend", "hr", "br"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "foreignobject":  # part of a drawing that holds blocks
                    break
                if stack[k][0] in NO_BLOCKS or stack[k][0] in UNSEEN and not closes(stack[k][0]):
                    del stack[k:]
        ended = ENDS.get(tag, set()) | ({"p"} if tag in BLOCK and tag != "br" else set())
        if ended:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ended:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK or stack[k][0] in UNSEEN:
                    break
        _, path, article, other, link = stack[-1]
        words, cls = marks_of(tag, m.group(3) or "")
        inside = article or ((tag in MAIN or "main" in words and tag in ("div", "section")) and not other)
        if tag not in ("html", "body", "main"):
            own = words & MARKS if tag != "article" else words & {"comment", "comments", "related", "ad", "ads"}
            other = other or tag in ASIDE or tag in UNSEEN or bool(own) or (not inside and (tag == "header" or bool(words & HEADS)))
        if tag in VOID or tag in UNSEEN and (m.group(3) or "").rstrip().endswith("/"):
            tag_run("", tag)
            continue
        stack.append((tag, f"{path}/{tag}.{cls}" if cls else f"{path}/{tag}", inside, other, link or tag == "a"))
        tag_run("", tag)
    return out


def tallies(pages: list[str], hosts: list[str]) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(host, token, pages, vector, places, is it a tag) summed over these pages; token 0 counts the host's pages that
    hold tokens."""
    sums: dict[tuple[str, int], list[int]] = {}
    for page, host in zip(pages, hosts):
        number = np.uint64(xxhash.xxh3_64_intdigest(page))
        places: dict[int, list[int]] = {}
        tags: set[int] = set()
        for k, run in enumerate(read_page(page)):
            if run.key:
                places.setdefault(run.key, []).append(k)
                if run.text is None:
                    tags.add(run.key)
        if not places:
            continue
        keys = [0, *places]
        counts = np.array([1, *map(len, places.values())], np.uint64)
        with np.errstate(over="ignore"):
            vector = mix64(number + counts * np.uint64(0x9E3779B97F4A7C15)).tolist()
        for key, v, first in zip(keys, vector, [0, *(p[0] for p in places.values())]):
            got = sums.setdefault((host, key), [0, 0, 0, int(key in tags)])
            got[0] += 1
            got[1] = (got[1] + v) % 2**64
            got[2] += first
    for (host, key), (n, vector, place, tag) in sums.items():
        yield host, key, n, vector, place, tag


def templates(pages: DataFrame, least_pages: int, support: float = 0.5, layout: float = 0.2) -> DataFrame:
    """(host, template): the frequent, large classes of each host as arrays of token, class, mean place and the share
    of the host's pages that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.decode("utf-8", "replace") for t in as_bytes(b, "html")]
            got = list(tallies(texts, [host_of(u) for u in b.column("url").to_pylist()]))
            host, key, n, vector, place, tag = zip(*got) if got else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(n, pa.int64()),
                 pa.array(np.array(vector, np.uint64).view(np.int64)), pa.array(place, pa.int64()),
                 pa.array(tag, pa.int32())],
                names=["host", "token", "pages", "vector", "places", "tag"])

    # the sum of vectors may leave 64 bits: add the two halves and put them together again
    half = 1 << 32
    low, high = F.sum(F.col("vector").bitwiseAND(half - 1)), F.sum(F.shiftrightunsigned("vector", 32))
    totals = map_batches(pages.select("url", "html"), run,
                         "host string, token long, pages long, vector long, places long, tag int").groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), low.alias("low"), high.alias("high"), F.sum("places").alias("places"), F.max("tag").alias("tag"))
    totals = freeze(totals.where(F.col("pages") >= least_pages), "page-tokens")
    sizes = totals.where("token = 0").select("host", F.col("pages").alias("all"))
    common = totals.where("token <> 0").join(sizes, "host").where(F.col("pages") >= min(layout, support) * F.col("all")).withColumn(
        "class", F.xxhash64("low", "high"))
    large = common.groupBy("host", "class").agg(
        F.count(F.lit(1)).alias("size"), F.max("tag").alias("tag"), F.min(F.col("pages") / F.col("all")).alias("share"))
    large = large.where((F.col("size") >= 2) & ((F.col("tag") == 1) | (F.col("share") >= support))).select("host", "class")
    # a host's template has at most as many tokens as its mean page has, divided by the least share
    return (common.join(large, ["host", "class"]).groupBy("host").agg(F.collect_list(F.struct(
        "token", "class", (F.col("places") / F.col("pages")).alias("place"),
        (F.col("pages") / F.col("all")).alias("share"))).alias("template")))


def template_tokens(runs: list[Run], template: list[tuple]) -> set[int]:
    """Tokens of the classes that are ordered and nested on this page."""
    places: dict[int, list[int]] = {}
    for k, run in enumerate(runs):
        if run.key:
            places.setdefault(run.key, []).append(k)
    classes: dict[int, list[tuple[float, int]]] = {}
    for token, cls, place, *_ in template:
        if token in places:
            classes.setdefault(cls, []).append((place, token))
    spans: list[tuple[list[int], set[int]]] = []
    for members in classes.values():
        tokens = [t for _, t in sorted(members)]
        rounds = len(places[tokens[0]])
        order = sorted((p, t) for t in tokens for p in places[t])
        if len(tokens) < 2 or any(len(places[t]) != rounds for t in tokens):
            continue
        first = [t for _, t in order[:len(tokens)]]
        if len(set(first)) == len(tokens) and all(t == first[k % len(tokens)] for k, (_, t) in enumerate(order)):
            spans.append(([p for p, _ in order], set(tokens)))
    spans.sort(key=lambda s: (len(s[0]) != len(s[1]), -len(s[0])))  # classes that occur once a page come first
    good: set[int] = set()
    seen: list[list[int]] = []
    for order, tokens in spans:
        once = len(order) == len(tokens)
        size = len(tokens)
        nested = once or all(
            len(set(np.searchsorted(outer, order[k:k + size]).tolist())) == 1
            for outer in seen for k in range(0, len(order), size))
        if nested:
            good |= tokens
            if once:
                seen.append(order)
    return good


def main_text(page: str, template: list[tuple[int, int, float, float]] | None, most_common: float) -> str:
    runs = read_page(page)
    has_article = any(r.article and not r.other and r.text and r.text.strip() for r in runs)
    wanted = [r.text is not None and not r.other and (r.article or not has_article) for r in runs]
    if template:
        fixed = template_tokens(runs, template)
        always = {token for token, *_, share in template if share >= ALWAYS}
        whole = sum(len(r.text.strip()) for w, r in zip(wanted, runs) if w)
        for drop in (fixed, fixed & always):
            common = [w and r.key in drop for w, r in zip(wanted, runs)]
            if sum(len(r.text.strip()) for c, r in zip(common, runs) if c) <= most_common * whole:
                wanted = [w and not c for w, c in zip(wanted, common)]
                break
    blocks: list[str] = []
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        value = " ".join("".join(parts).split())
        if value and (has_article or linked * 2 <= len(value)):  # without an article, a block of links is a menu
            blocks.append(value)
        parts.clear()
        linked = 0

    for r, w in zip(runs, wanted):
        if r.text is None:
            if r.ends_block:
                close()
        elif w:
            parts.append(r.text)
            linked += len(r.text.strip()) if r.link else 0
    close()
    return " ".join(blocks)


def with_template(pages: DataFrame, found: DataFrame, most_tokens: int = 1_000_000, salts: int = 32) -> DataFrame:
    """Pages with their host's template. Templates of up to `most_tokens` tokens in all (about 40 MB) are sent to the
    pages, which stay where they are; more are joined by host and salt, so that a large host's pages spread."""
    found = freeze(found, "page-templates")
    tokens = found.agg(F.sum(F.size("template"))).first()[0] or 0
    if tokens <= most_tokens:
        return pages.join(F.broadcast(found), "host", "left")
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("html", "url"), F.lit(salts)).cast("int")).join(
        salted, ["host", "salt"], "left")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html", least_pages: int = 4,
            most_common: float = 0.2, support: float = 0.5, layout: float = 0.2) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(markup).alias("html"))
    found = templates(rows, least_pages, support, layout)
    # the same host name as host_of, for the join
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][\w+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    joined = with_template(rows.withColumn("host", host), found).select("page_id", "url", "html", "template")
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            column = b.column("template")
            for k, page in enumerate(as_bytes(b, "html")):
                got = column[k].as_py()
                template = got and [(t["token"] % 2**64, t["class"], t["place"], t["share"]) for t in got]
                texts.append(main_text(page.decode("utf-8", "replace"), template, most_common))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(joined, run, f"page_id {kind}, url string, text string, n_chars long")
