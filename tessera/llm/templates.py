"""Main text of pages: a site's template is what recurs on its pages.

Every page is parsed into elements. Each element that shows text has a slot (the names and classes of the elements around it, digits left out) and a hash of its
subtree (names and text). Spark counts subtrees by host and slot. What counts is the number of different articles beside which a subtree stands, so
that copies of a page count once and do not make a template of their own text. Then, of a host with MIN_PAGES different articles or more,

* a subtree goes that stands beside SHARE of them or more;
* a slot goes, with all that it holds, if THERE of the host's articles have it and SHARE of what it holds is met again beside other articles: menus and
  adverts of a few kinds. Inside an article that holds for boxes and lists only, as paragraphs of near copies are met again too.

Elements go too by what they are (menus, headers, footers, sidebars, forms, scripts, styles) or say in class, id or role (NOISE), because a host of few pages shows no
template, and readers' comments do not recur. The text is that of <article> (else <main>, else <body>); nothing goes that holds a whole article.

Each host's templates are one row: SHARE and THERE bound their number by that of a page's elements, whatever the number of pages. They are broadcast if their counted size
allows, else pages are joined to them by host and salt, as one host may have most pages. Pages are read twice and never shuffled in the first case.

Null and empty html gives an empty text, as do pages without any. White space is what Unicode says. Unclosed, misplaced and broken tags, comments and
references are read as browsers do, roughly; nothing raises. A null url is host ''. Repeated rows are extracted each; they count once. Empty tables give no rows.
Other columns do no harm.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, lean, table
from tessera.llm.url_filter import host_and_path

MIN_PAGES, SHARE, THERE = 8, 0.8, 0.1
#: Hashes of all templates that are broadcast at most; else pages are joined to them, by so many salts.
MOST, SALTS = 1_000_000, 16

# The markup language's own names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
UNSEEN = RAW | frozenset("head template svg math object canvas audio video select option button datalist map".split())
CHROME = frozenset("nav header footer aside form dialog menu fieldset".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "thead": {"tr", "td", "th", "tbody"},
    "tfoot": {"tr", "td", "th", "tbody", "thead"}, "option": {"option"}, "body": {"head"},
}
#: What closes may lie no further up than these.
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "p": {"td", "th", "button", "table"}}
BOXES = frozenset("div section ul ol dl table figure span a".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Words of classes, ids and roles that say that an element is not the article.
NOISE = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adslot adunit adbox banner banners sponsor sponsored sponsors promo promos promotion promoted
    menu menus menubar nav navs navbar navigation breadcrumb breadcrumbs pagination pager toc sidebar sidebars sidenav rail aside complementary footer footers contentinfo header headers masthead topbar
    cookie cookies consent gdpr notice notices alert alerts alertdialog popup popups modal overlay toast dialog disclaimer paywall newsletter subscribe subscription signup login search searchbox
    share shares sharing social related recommended recommendations trending widget widgets toolbar skip comment comments commentlist commenter respond disqus replies responses discussion reactions""".split()
)
#: Of these, none inside an article: there they are its own.
OUTER = frozenset(("header", "headers", "banner", "masthead"))
#: A class that begins so speaks of something else.
_ABOUT = re.compile(r"(?:has|with|without|no|is|js)[-_]", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|/[^>]*>)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass
class Page:
    """Elements in their order, each after the one around it (up). runs: (element, text), in page order; None: a border of blocks."""

    names: list[str] = field(default_factory=lambda: [""])
    up: list[int] = field(default_factory=lambda: [-1])
    said: list[dict[str, str] | None] = field(default_factory=lambda: [None])
    runs: list[tuple[int, str | None]] = field(default_factory=list)


def _said(attributes: str) -> dict[str, str] | None:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else None
    return found or None


def parse(html: str) -> Page:
    page, stack, open_ = Page(), [0], {}
    at, size = 0, len(html)

    def text(piece: str) -> None:
        if piece:
            page.runs.append((stack[-1], html_.unescape(piece) if "&" in piece else piece))

    def pop() -> None:
        name = page.names[stack.pop()]
        open_[name] -= 1
        if name not in INLINE:
            page.runs.append((stack[-1], None))

    def close(names: set[str] | frozenset, fences: set[str]) -> None:
        """Closes the nearest open element of these names and what is open inside it, unless a fence is nearer."""
        if not any(open_.get(n) for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            name = page.names[stack[k]]
            if name in names:
                while len(stack) > k:
                    pop()
                return
            if name in fences:
                return

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        m = _TAG.match(html, lt)
        if not m:  # a sign of its own
            end = html.find("<", lt + 1)
            text(html[at : end if end > 0 else size])
            at = end if end > 0 else size
            continue
        text(html[at:lt])
        at = m.end()
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            if name == "br":
                page.runs.append((stack[-1], None))
            elif name in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if page.names[stack[k]] == name:
                        while len(stack) > k:
                            pop()
                        break
                    if page.names[stack[k]] not in INLINE:
                        break
            elif name not in ("html", "body"):
                close({name} if name not in HEADINGS else HEADINGS, set() if name in ("table", "article", "main", "section", "div") else FENCES.get(name, {"table"}))
            continue
        if name in VOID:
            if name not in INLINE:
                page.runs.append((stack[-1], None))
            continue
        if name not in INLINE:
            close({"p"}, FENCES["p"])
            if name in CLOSED_BY:
                for n in CLOSED_BY[name]:
                    close({n}, FENCES.get(name, set()))
            elif name in HEADINGS:
                close(HEADINGS, {"div", "section", "article", "main", "td"})
            page.runs.append((stack[-1], None))
        page.names.append(name)
        page.up.append(stack[-1])
        page.said.append(_said(attributes))
        stack.append(len(page.names) - 1)
        open_[name] = open_.get(name, 0) + 1
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = end.start() if end else size
    return page


def _speaks(said: dict[str, str] | None) -> set[str]:
    if not said:
        return set()
    words = set()
    for key in ("class", "id", "role"):
        for token in said.get(key, "").split():
            if not _ABOUT.match(token):
                words.update(w.lower() for w in _WORDS.findall(token))
    return words


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


class Read:
    """A parsed page: what is its article, and what its elements hold."""

    def __init__(self, html: str | None):
        page = self.page = parse(html or "")
        n = len(page.names)
        spoken = [_speaks(s) for s in page.said]
        inside = [False] * n  # inside an article
        is_main = [name == "main" or bool(s and (s.get("role") or "").lower() == "main") for name, s in zip(page.names, page.said, strict=True)]
        is_article = [name == "article" or bool(s and (s.get("itemprop") or "").lower() == "articlebody") for name, s in zip(page.names, page.said, strict=True)]
        noise = [False] * n
        for i in range(1, n):
            up = page.up[i]
            inside[i] = inside[up] or is_article[up]
            name = page.names[i]
            words = spoken[i] & NOISE
            if inside[i] or is_article[i]:
                words -= OUTER
            noise[i] = name in UNSEEN or (name in CHROME and not (name == "header" and inside[i])) or bool(words)
        # what holds a whole article is no noise: wrappers, forms around a page
        holds = [False] * n
        for i in range(n - 1, 0, -1):
            own = is_main[i] or (is_article[i] and not noise[i] and not inside[i])
            if own or holds[i]:
                holds[page.up[i]] = True
        gone = [False] * n
        for i in range(1, n):
            kept = page.names[i] not in UNSEEN and (holds[i] or is_main[i] or page.names[i] in ("html", "body"))
            gone[i] = gone[page.up[i]] or (noise[i] and not kept)
        self.gone = gone
        articles = [i for i in range(n) if is_article[i] and not gone[i] and not inside[i]]
        self.scope = self._scope(articles, is_main, is_article, inside)
        self.holds, self.inside = holds, inside

    def _scope(self, articles: list[int], is_main: list[bool], is_article: list[bool], inside: list[bool]) -> list[bool]:
        """Whether each element is in the article."""
        page, n = self.page, len(self.page.names)
        roots = set(articles) or {i for i in range(n) if is_main[i] and not self.gone[i]}
        if not roots:
            return [True] * n
        scope, in_main, owner = [False] * n, [False] * n, [-1] * n
        own_text = set()
        for i in range(1, n):
            up = page.up[i]
            scope[i] = scope[up] or i in roots
            in_main[i] = in_main[up] or is_main[up]
            owner[i] = i if is_article[i] else owner[up]
            if page.names[i] == "p" and owner[i] in roots:
                own_text.add(owner[i])
        if articles:
            # an article inside one that has paragraphs of its own is a reader's comment
            for i in range(1, n):
                if scope[i] and is_article[i] and inside[i] and page.names[i] == "article":
                    above = owner[page.up[i]]
                    scope[i] = not (above in own_text)
                elif scope[i] and i not in roots and not scope[page.up[i]]:
                    scope[i] = False
            if not any(page.names[i] == "h1" and scope[i] for i in range(n)):  # a title above the article, beside it in <main>
                for i in range(1, n):
                    scope[i] = scope[i] or (in_main[i] and (page.names[i] == "h1" or scope[page.up[i]]) and not is_main[i])
        return scope

    def text(self, dead: list[bool] | None = None) -> str:
        """Of what is in the article, without dead elements."""
        gone, scope, out = dead or self.gone, self.scope, []
        for i, piece in self.page.runs:
            out.append(" " if piece is None else piece if scope[i] and not gone[i] else "")
        return " ".join("".join(out).split())

    def subtrees(self) -> tuple[list[int], list[int], list[int]]:
        """(element, slot, hash of slot and subtree) of elements that show text and are counted: blocks, and inline elements beside blocks; none holds an article."""
        page = self.page
        n = len(page.names)
        parts: list[list] = [[] for _ in range(n)]
        for i, piece in page.runs:
            if piece is not None and (piece := " ".join(piece.split())):
                parts[i].append(piece)
        slots = [0] * n
        for i in range(1, n):
            said = page.said[i] or {}
            slots[i] = _hash(slots[page.up[i]], page.names[i], re.sub(r"\d+", "", said.get("class", "")))
        full = [0] * n
        out = []
        for i in range(n - 1, 0, -1):
            if not parts[i] or page.names[i] in UNSEEN:
                continue
            full[i] = _hash(page.names[i], *parts[i])
            parts[page.up[i]].append(full[i])  # children come last first, the same way on each page
            up = page.names[page.up[i]]
            block = page.names[i] not in INLINE
            if not self.holds[i] and page.names[i] not in ("html", "body", "main", "article") and (block or up in ("div", "section", "body", "article", "main", "td")):
                out.append(i)
        out.reverse()
        return out, [slots[i] for i in out], [_hash(slots[i], full[i]) for i in out]


# --- Spark


def counted(pages: DataFrame) -> DataFrame:
    """(host, slot, subtree, n): beside how many different articles each subtree stands; slot 0: how many the host has. pages: (host, html)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for host, html in zip(*batch.columns, strict=True):
                page = Read(html.as_py())
                _, slots, trees = page.subtrees()
                found = {(0, 0), *zip(slots, trees, strict=True)}
                article = _hash(page.text())
                for column, values in zip(columns, ([host.as_py()] * len(found), [article] * len(found), [s for s, _ in found], [t for _, t in found]), strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["host", "article", "slot", "subtree"])

    rows = pages.select("host", "html").mapInArrow(lean(read), "host string, article long, slot long, subtree long").distinct()
    return rows.groupBy("host", "slot", "subtree").agg(F.count("*").alias("n"))


def templates(counts: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, there: float = THERE) -> DataFrame:
    """(host, subtrees, slots) that go, one row per host that has any."""
    hosts = counts.where("slot = 0").select("host", F.col("n").alias("articles")).where(F.col("articles") >= min_pages)
    rows = counts.where("slot <> 0").groupBy("host", "slot").agg(
        F.sum("n").alias("there"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again"),
    )
    slots = rows.join(hosts, "host").where((F.col("there") >= F.greatest(F.lit(min_pages), there * F.col("articles"))) & (F.col("again") >= share * F.col("there")))
    slots = slots.select("host", F.lit(None).cast("long").alias("subtree"), F.col("slot"))
    trees = counts.where((F.col("slot") != 0) & (F.col("n") >= min_pages)).join(hosts, "host").where(F.col("n") >= share * F.col("articles"))
    trees = trees.select("host", "subtree", F.lit(None).cast("long").alias("slot"))
    return trees.unionByName(slots).groupBy("host").agg(F.collect_set("subtree").alias("subtrees"), F.collect_set("slot").alias("slots"))


def without(page: Read, subtrees: set[int], slots: set[int]) -> str:
    """The article's text without what recurs."""
    if not subtrees and not slots:
        return page.text()
    dead, up = list(page.gone), page.page.up
    own = set()
    for i, slot, tree in zip(*page.subtrees(), strict=True):
        if tree in subtrees or (slot in slots and (page.page.names[i] in BOXES or not page.inside[i])):
            own.add(i)
    for i in range(1, len(dead)):
        dead[i] = dead[i] or dead[up[i]] or i in own
    return page.text(dead)


def extract(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """(columns of keep.., text): the main text of every row of pages."""
    rows = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce(host_and_path(F.col(url))[0], F.lit("")).alias("host"), F.col(html).alias("html"))
    found = cut(templates(cut(counted(rows))))
    size = found.agg(F.coalesce(F.sum(F.size("subtrees") + F.size("slots") + 8), F.lit(0))).first()[0]
    if size <= MOST:
        rows = rows.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if re.fullmatch(r"k\d+", f.name))
    width = len(keep)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, set(), set())
        for batch in batches:
            texts = []
            for h, trees, slots in zip(*batch.columns[width:], strict=True):
                if trees is not known[0]:
                    known = trees, set(trees.as_py() or ()), set(slots.as_py() or ())
                texts.append(without(Read(h.as_py()), *known[1:]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string())], [*(f"k{i}" for i in range(width)), "text"])

    out = rows.select(*(f"k{i}" for i in range(width)), "html", "subtrees", "slots").mapInArrow(lean(read), f"{kinds}{', ' if kinds else ''}text string")
    return out.toDF(*keep, "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=("page_id", "url")).withColumn("n_chars", F.char_length("text").cast("long"))


#: Right for the markup of the test tables, where each page has one <article> of headings and paragraphs.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '(?i)<(/?(p|h[1-6]|div|li|ul|br))[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&#x27;', '''') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{2028}\x{2029}\x{3000}]+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""
