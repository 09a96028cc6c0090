"""Main text of web pages by site template removal.

Every page is read into its elements.  Every subtree is hashed, and Spark counts on how many different pages
of its host each hash occurs; subtrees that recur on many pages of their host are the site's template and are
deleted, whatever their names.  What differs from page to page can't recur, so menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments that are named so by their element,
role or a whole class word or id are left out too.  What is left inside the page's articles (its body, if it
has none) is its main text.  Paragraphs of an article are its text, however often they recur.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A subtree is template if it is on at least so many different pages of the host, and this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.1

# Names and class words that mark what is not main text, and HTML's element kinds.
LEFT_OUT = frozenset("nav header footer aside form script style noscript template head title button select option iframe svg dialog menu object canvas".split())
LEFT_OUT_WORDS = frozenset(
    """ad ads advert adverts advertisement ad-banner ad-box ad-container ad-slot sponsor sponsored promo banner
    sidebar side-bar sidebar-left sidebar-right menu main-menu nav navbar navigation main-nav site-nav breadcrumb breadcrumbs
    cookie cookies cookie-banner cookie-notice cookie-consent consent notice notices site-notice
    comment comments comment-list comments-area reader-comments user-comments disqus newsletter subscribe share social
    social-share share-buttons related related-posts popup modal footer page-footer site-footer header page-header site-header masthead widget""".split()
)
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|iframe|template|svg"
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split()) | INLINE
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NO_PARAGRAPH = LEFT_OUT | frozenset("div section article main td th li body blockquote".split())
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</(?P=raw)\s*>|.*)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
MARK = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _left_out(name: str, rest: str) -> bool:
    """Whether the element is left out by its name, role, id or a whole word of its class."""
    if name in LEFT_OUT:
        return True
    if rest and name not in ("html", "body"):
        for kind, *values in MARK.findall(rest):
            words = set("".join(values).lower().split())
            if name in MAIN:  # an article may have a menu or sidebar; only a reader comment is none
                words &= COMMENTS
            if words & (LEFT_OUT_ROLES if kind.lower() == "role" else LEFT_OUT_WORDS):
                return True
    return False


COMMENTS = frozenset(("comment", "comments"))


class _Open:
    __slots__ = ("name", "out", "main", "silent", "number", "parts")

    def __init__(self, name: str, out: bool, main: bool, silent: bool, number: int):
        self.name, self.out, self.main, self.silent, self.number, self.parts = name, out, main, silent, number, []


class Page:
    """Blocks of text (text, number of the element around it, whether in an article), the parent of each
    element, and (if asked) the hashes of elements that may be template."""

    def __init__(self, html: str, hashes: bool):
        self.blocks: list[tuple[str, int, bool]] = []
        self.parents = [0]
        self.hashes: dict[int, int] = {}
        self.has_main = False
        self._protected: set[int] = set()
        self._read(html, hashes)
        if self.has_main:
            self.hashes = {e: h for e, h in self.hashes.items() if e not in self._protected}

    def _read(self, html: str, hashes: bool) -> None:
        import xxhash

        stack, text, held = [_Open("", False, False, False, 0)], [], Counter()

        def flush() -> None:
            words = " ".join("".join(text).split())
            text.clear()
            if words:
                self.blocks.append((words, stack[-1].number, stack[-1].main))

        def close() -> None:
            e = stack.pop()
            held[e.name] -= 1
            if hashes:
                digest = xxhash.xxh64_intdigest("\0".join((e.name, *e.parts)))
                stack[-1].parts.append(f"{digest:x}")
                self.hashes[e.number] = digest - (1 << 64) if digest >> 63 else digest
                if e.main and (e.name in PARAGRAPHS or e.name in MAIN):
                    self._protected.add(e.number)

        def close_upto(names: frozenset | set, stops: frozenset | set) -> None:
            """Closes the innermost open element of these names, unless a stop comes before it."""
            if not any(held[n] > 0 for n in names):
                return
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in names:
                    while len(stack) > k:
                        close()
                    return
                if stack[k].name in stops:
                    return

        def say(raw: str) -> None:
            if raw:
                top = stack[-1]
                if hashes and not raw.isspace():
                    top.parts.append(" ".join(raw.split()))
                if not top.out and not top.silent:
                    text.append(unescape(raw) if "&" in raw else raw)

        at = 0
        for m in TOKEN.finditer(html):
            if m.start() > at:
                say(html[at : m.start()])
            at = m.end()
            name = m["name"]
            if not name:
                continue
            name = name.lower()
            if name not in INLINE:
                flush()
            elif name == "br" and text:
                text.append(" ")
            if m["end"]:
                close_upto({name}, frozenset())
                continue
            if name in VOID:
                continue
            if name not in INLINE:
                if name in CLOSES_ITSELF:
                    close_upto(CLOSES_ITSELF[name], STOPS[name])
                else:  # a block ends an open paragraph
                    close_upto({"p"}, NO_PARAGRAPH)
            top = stack[-1]
            own_header = name == "header" and top.main  # of an article's own header the headings stay
            out = top.out or not own_header and _left_out(name, m["rest"])
            silent = own_header or top.silent and name not in HEADINGS
            main = not out and (top.main or name in MAIN)
            self.has_main |= main
            self.parents.append(top.number)
            held[name] += 1
            stack.append(_Open(name, out, main, silent, len(self.parents) - 1))
            if m["rest"].endswith("/") and name in ("svg", "path"):
                close()
        if at < len(html):
            say(html[at:])
        flush()
        while len(stack) > 1:
            close()

    def text(self, template: set[int]) -> str:
        """The main text without the subtrees whose hashes are given."""
        gone = [False] * len(self.parents)
        if template:
            for e in range(1, len(gone)):  # parents come first
                gone[e] = gone[self.parents[e]] or self.hashes.get(e) in template
        return "\n".join([words for words, e, main in self.blocks if (main or not self.has_main) and not gone[e]])


def host(url: Column) -> Column:
    """The host of an address in lower case; empty if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _subtrees(html: Column) -> Column:
    """Hashes of a page's subtrees that may be template, each once."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([sorted(set(Page(v.as_py() or "", True).hashes.values())) for v in pages], pa.list_(pa.int64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<long>")(html)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, subtree) of the subtrees that recur on many different pages of their host.

    Copies of a page count once.  Counts are combined before each shuffle, so a host with a third of all
    pages is no task's burden.
    """
    content = pages.select(host(F.col("url")).alias("host"), "html").withColumn("page", F.xxhash64("host", "html"))
    seen = content.withColumn("subtree", F.explode(_subtrees(F.col("html")))).groupBy("host", "subtree").agg(F.count_distinct("page").alias("n"))
    hosts = content.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    often = seen.where(F.col("n") >= min_pages)
    return often.join(hosts, "host").where(F.col("n") >= F.col("pages") * min_share).select("host", "subtree")


def _main_text(html: Column, gone: Column) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, removed in batches:
            out = []
            for v, r in zip(pages, removed):
                drop = set(r.as_py() or ())
                out.append(Page(v.as_py() or "", bool(drop)).text(drop))
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(html, gone)


def extract(pages: DataFrame, out_col: str = "text", **params) -> DataFrame:
    """Adds ``out_col``: the page's main text, blocks joined by line ends; empty if there is none.

    pages has url and html.  Null html counts as empty; pages without a host share the empty host.  Repeated
    rows are kept and treated alike.  Other columns pass through, save one named like the output.
    """
    spark = pages.sparkSession
    common.bound_batches(spark)
    path = common.fresh_path(spark, "templates")
    templates(pages, **params).write.parquet(f"{path}/subtrees")
    site = spark.read.parquet(f"{path}/subtrees")
    # A host has at most (subtrees of a page) / min_share template subtrees, however many pages.
    site.groupBy("host").agg(F.sort_array(F.collect_set("subtree")).alias("template_")).write.parquet(f"{path}/hosts")
    sets = spark.read.parquet(f"{path}/hosts")
    plain = common.without(pages, out_col, "template_", "host_")
    joined = plain.withColumn("host_", host(F.col("url"))).join(sets.withColumnRenamed("host", "host_"), "host_", "left")
    return joined.withColumn(out_col, _main_text(F.col("html"), F.col("template_"))).select(*plain.columns, out_col)


def op9_html(spark, sf_dir: str) -> DataFrame:
    found = extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
