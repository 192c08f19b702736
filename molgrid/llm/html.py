"""Main text of web pages by consensus of each host's pages.

Each page's containers are scored by the running text that stands right in them; the page's score is shared out as
votes on generalised tag-class paths (digits are taken out of class names), the votes of a host are summed in Spark,
and every page is then read again along its host's winning path; where that lies in an article, the article is read. A page without that path is read along its own best
one. The winners are one short row for each host: they are broadcast while they are few, beyond that both sides are
salted, so that a host with a third of all pages is spread over many tasks.

Text of a block: character references decoded, white space one space, trimmed. Blocks in page order are joined by an
empty line. `br` and table cells are white space, inline tags are nothing.

Defined cases: null or empty html gives an empty text; a null url votes with the other pages that have none; pages
that repeat are extracted alike; a page without any running text gives the text of its best container, or none; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molgrid.llm.common import materialize

#: Tags by what they do, and the names that mark what is not the article.
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "figcaption", "tr", "caption", "summary", "address"}
CONTAINERS = {"body", "main", "article", "section", "div", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "figure", "details", "center", "td", "th"}
DROPPED = {"nav", "footer", "aside", "form", "header", "head", "noscript", "template", "iframe", "object", "button", "select", "svg", "math", "canvas", "audio", "video", "dialog", "menu", "fieldset"}
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
BLANK = {"br", "td", "th", "hr"}
VOTERS = {"body", "main", "article"}
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|sidebar|side-?bar|footer|masthead|topbar|site-?header|page-?header|header"
    r"|ad|ads|advert|adverts|advertisement|sponsor|sponsored|banner|promo|cookie|cookies|consent|notice|notices|alert"
    r"|comment|comments|reply|replies|disqus|share|sharing|social|related|recommended|subscribe|newsletter|signup|login"
    r"|breadcrumb|breadcrumbs|popup|modal|overlay|widget|pagination|pager|toolbar|search)s?(?:\d*$|[\s_-])"
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: Those of which an open one ends where a new one, or a new block, begins.
SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"\d+")


@dataclass
class Page:
    """containers: (parent, path, votes); blocks: (container, text, letters in links)."""

    containers: list[tuple[int, str, bool]] = field(default_factory=lambda: [(-1, "", True)])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)} if source.strip() else {}


def _unwanted(tag: str, own: dict[str, str], inside_article: bool) -> bool:
    if tag in DROPPED:
        return not (tag == "header" and inside_article)
    if not own:
        return False
    if own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden") == "true":
        return True
    if "display:none" in own.get("style", "").replace(" ", "").lower():
        return True
    names = f"{own.get('class', '')} {own.get('id', '')}".lower()
    return tag not in ("body", "html", "article", "main") and bool(UNWANTED.search(names))


def parse(html: str) -> Page:
    page = Page()
    # the open elements: tag, container, whether its text is dropped
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]
    buffer: list[str] = []
    links = in_link = 0

    def flush() -> None:
        nonlocal links
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                page.blocks.append((stack[-1][1], text, links))
            buffer.clear()
        links = 0

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                flush()
                del stack[k:]
                return

    at, articles = 0, 0
    while True:
        m = _TAG.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text and not stack[-1][2]:
            text = unescape(text) if "&" in text else text
            buffer.append(text)
            if in_link:
                links += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not m[1]:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else len(html)
            continue
        if tag == "a":
            in_link = 0 if m[1] else 1
            continue
        if tag in BLANK and not stack[-1][2]:
            buffer.append(" ")
        if tag not in BLOCKS and tag not in CONTAINERS and tag not in DROPPED:
            continue
        in_link = 0
        if m[1]:
            if tag == "article":
                articles = max(0, articles - 1)
            close(tag)
            continue
        if tag in ("td", "th"):
            continue  # cells of a row are one block
        own = _attributes(m[3])
        if stack[-1][0] == "p" or (tag in SELF_CLOSING and stack[-1][0] == tag):
            flush()
            stack.pop()
        flush()
        dropped = stack[-1][2] or _unwanted(tag, own, articles > 0)
        inside = stack[-1][1]
        if tag in CONTAINERS:
            articles += tag in ("article", "main")
            names = sorted({_DIGITS.sub("", c) for c in f"{own.get('class', '')}".split()} - {""})
            votes = tag in VOTERS or (tag in ("div", "section") and bool(names or own.get("id")))
            if votes:
                step = ".".join([tag, *names]) + (f"#{_DIGITS.sub('', own['id'])}" if own.get("id") else "")
                page.containers.append((inside, f"{page.containers[inside][1]}>{step}", True))
                inside = len(page.containers) - 1
        if not m[3].rstrip().endswith("/"):
            stack.append((tag, inside, dropped))
    flush()
    return page


def votes(page: Page) -> dict[str, int]:
    """Thousandths of the page's score by path; a block counts for its container, and half for the one around it."""
    score: dict[str, float] = defaultdict(float)
    for inside, text, links in page.blocks:
        own = max(0, len(text) - 2 * links)
        for k, share in ((inside, 1.0), (page.containers[inside][0], 0.5)):
            if k >= 0:
                path = page.containers[k][1]
                score[path] += own * share * (1.5 if path.rpartition(">")[2].split(".")[0] in ("article", "main") else 1)
    total = sum(score.values())
    return {k: round(1000 * v / total) for k, v in score.items() if 1000 * v >= total} if total else {}


def _around(parts: list[tuple[int, str, bool]], k: int) -> int:
    """The nearest article or main that holds container k, or is it; k itself where there is none."""
    at = k
    while at >= 0:
        if re.split(r"[.#]", parts[at][1].rpartition(">")[2], maxsplit=1)[0] in ("article", "main"):
            return at
        at = parts[at][0]
    return k


def text_of(page: Page, path: str | None) -> str:
    """The blocks inside the containers of the path, or of the page's best path where it has none.

    A container inside an article, or else inside main, stands for all of it: its title, lead and other sections too.
    """
    parts = page.containers
    inside = [False] * len(parts)
    paths = {p[1] for p in parts}
    if path not in paths:
        own = votes(page)
        path = min(own, key=lambda k: (-own[k], k)) if own else ""
    roots = {_around(parts, k) for k, p in enumerate(parts) if p[1] == path}
    for k, (parent, _, _) in enumerate(parts):
        inside[k] = k in roots or (parent >= 0 and inside[parent])
    return "\n\n".join(text for k, text, _ in page.blocks if inside[k])


def _host() -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the winner of each host's votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[tuple[str, str], int] = defaultdict(int)
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if html:
                    for path, n in votes(parse(html)).items():
                        total[host, path] += n
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(total.values()), pa.int64())],
                names=["host", "path", "votes"],
            )

    cast = pages.select(_host().alias("host"), "html").mapInArrow(run, "host string, path string, votes long")
    summed = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path"))


def extract(pages: DataFrame, broadcast_hosts: int = 200_000, salts: int = 64) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages`."""
    winners = materialize(host_paths(pages), "html-paths")
    rows = pages.select("page_id", "url", "html", _host().alias("host"))
    if winners.count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [text_of(parse(h), p) if h else "" for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = dict(pages.dtypes)
    return joined.select("page_id", "url", "html", "path").mapInArrow(
        run, f"page_id {kinds['page_id']}, url string, text string, n_chars long"
    )
