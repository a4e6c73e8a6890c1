"""The main body of pages (problem 3): a tree of blocks over the page's lines, visibility rules, and a rendering that keeps layout.

The tree builder reads markup where there is some, closing elements whose end tags are implied (a paragraph by the next block, a
list item by the next one, cells by rows), and implies elements from the layout where there is none, as in pages stored as plain
lines: nav, notice, aside, footer, and in the main body sections with headings, paragraphs, lists with items, tables with rows and
cells. Visibility rules hide the elements that belong to the site. What is left is rendered with a blank line between blocks, one
line an item, and the cells of a table in aligned columns.

What the site's own lines look like is counted over all pages: whole lines, parts between separators, and lead-ins before a colon,
with figures and the publisher's name masked. Counted are different stories (pages told apart by their longest line), so copies
of a story don't make its lines furniture. The counts stay distributed and are joined back to the pages line by line; nothing of
them is collected or broadcast.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.session import spread, stage, table

#: A pattern of fewer words than ``LONG`` is furniture on this share of all pages or of one site's, a longer one on ``STORIES`` pages.
SHARE, SITE_SHARE, STORIES, LONG = 0.0015, 0.03, 3, 6
#: Words of a menu label, at most, and of a lead-in.
LABEL, LEAD = 3, 6
#: Parts into which the rows of one pattern are spread when the counts are joined back.
SALTS = 16
_PARTS = re.compile(r"\s*(?:[|·•>/]|\s[-–—]\s)\s*")
_LEAD = re.compile(r"^([^:]{2,}?)\s?:\s+(\S.*)$")
_FIGURES = re.compile(r"\d+")
_BULLET = re.compile(r"^\s*(?:[-*•·–▪‣]\s+|\d{1,3}[.)]\s+)")
_RANKED = re.compile(r"^\s*\d{1,2}\s+(?=\w)")
_STOP = re.compile(r"[.!?…][\"»”’')\]]*\s*$")
_INNER = re.compile(r"[.!?][\"»”’')]*\s+[\"«“‘¿¡(]*\w")
_CELLS = re.compile(r"^[^.!?]{1,60}:\s*[\d.,]+\b[^.!?]*$|\t|\S {3,}\S")
_CELL_ENDS = re.compile(r"\t+| {3,}|\s*\|\s*|(?<=:)\s+(?=\d)")

SITE_BLOCKS = ("nav", "notice", "aside", "footer")
# Elements without content, elements that are not shown or hold the site's own text, and blocks that end a paragraph.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_UNSEEN = frozenset("nav footer aside script style noscript template form button select svg iframe dialog menu head title".split())
_BLOCK_TAGS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_TAG = re.compile(r"<!--|-->|<(/?)([A-Za-z][\w-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
_HIDING = re.compile(r"(?i)\bhidden\b|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true|role\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|dialog|alert)")


@dataclass
class Node:
    """An element of the tree; a leaf holds the text of one line."""

    kind: str
    line: int = -1
    text: str = ""
    children: list[Node] = field(default_factory=list)

    def lines(self) -> Iterator[int]:
        if self.line >= 0:
            yield self.line
        for c in self.children:
            yield from c.lines()


def pattern(line: str, publisher: str | None) -> str:
    """A line without what changes from page to page: figures and the publisher's name."""
    if publisher:
        line = line.replace(publisher, "\x01")
    return _FIGURES.sub("9", line).strip().lower()


def _is_label(shape: str) -> bool:
    return shape.count(" ") < LABEL and not _STOP.search(shape)


def _counted(shape: str) -> list[tuple[str, str]]:
    """What is counted of a line: (kind, pattern)."""
    out = [("line", shape)]
    parts = list(dict.fromkeys(p for p in _PARTS.split(shape) if p))
    if len(parts) > 1:
        out += [("part", p) for p in parts]
    lead = _LEAD.match(shape)
    if lead and lead[1].count(" ") < LEAD:
        out.append(("lead", lead[1]))
    return out


def _asked(shape: str) -> list[tuple[str, str]]:
    """What else the tree builder asks of a line: labels that stand beside each other without separators."""
    if _STOP.search(shape) or _INNER.search(shape):
        return []
    out = []
    for part in _PARTS.split(shape):
        words = part.split()
        out += [(k, " ".join(words[i : i + n])) for n in range(1, LABEL + 1) for i in range(len(words) - n + 1) for k in ("line", "part")]
    return out


def _key(kind: str, shape: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind} {shape}") - (1 << 63)


class Known:
    """The furniture that a page may hold, as keys of patterns."""

    def __init__(self, keys=()):
        self.keys = frozenset(keys)

    def has(self, kind: str, shape: str) -> bool:
        return bool(self.keys) and _key(kind, shape) in self.keys

    def label(self, shape: str) -> bool:
        return bool(shape) and _is_label(shape) and (self.has("line", shape) or self.has("part", shape))

    def menu(self, shape: str) -> bool:
        """Nothing but labels, with or without separators; the last step of a path may be the page's own."""
        parts = [p for p in _PARTS.split(shape) if p]
        if len(parts) > 1:
            known = sum(self.label(p) or self.has("part", p) or self._joined(p) for p in parts)
            return known * 2 > len(parts) or (">" in shape and known > 0)
        return bool(parts) and self._joined(parts[0])

    def _joined(self, text: str) -> bool:
        words = text.split()
        at = 0
        while at < len(words):
            step = next((n for n in range(LABEL, 0, -1) if at + n <= len(words) and self.label(" ".join(words[at : at + n]))), 0)
            if not step:
                return False
            at += step
        return bool(words)


class _Markup:
    """The open elements while lines are read; gives the visible text of each line, its element, and whether it was all hidden."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool]] = []

    def _pop_to(self, names: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                del self.open[i:]
                return
            if self.open[i][0] in within:
                return

    def _start(self, name: str, rest: str) -> None:
        if name in _BLOCK_TAGS:
            self._pop_to(("p",), ("td", "th", "li", "div", "article", "section", "main", "body"))
        if name == "li":
            self._pop_to(("li",), ("ul", "ol", "menu"))
        elif name in ("td", "th"):
            self._pop_to(("td", "th"), ("tr", "table"))
        elif name == "tr":
            self._pop_to(("tr",), ("table",))
        elif name in ("dt", "dd"):
            self._pop_to(("dt", "dd"), ("dl",))
        if name not in _VOID and not rest.rstrip().endswith("/"):
            unseen = name in _UNSEEN or bool(_HIDING.search(rest)) or bool(self.open and self.open[-1][1])
            self.open.append((name, unseen))

    def read(self, line: str) -> tuple[str, str, bool]:
        """Visible text (cells divided by tabs), innermost block element at its start, and whether the line shows nothing."""
        out, element, at = [], "", 0
        for m in [*_TAG.finditer(line), None]:
            piece = line[at : m.start()] if m else line[at:]
            if piece.strip() and not (self.open and self.open[-1][1]):
                element = element or next((n for n, _ in reversed(self.open) if n in _BLOCK_TAGS or n in ("li", "td", "th", "dt", "dd")), "")
                out.append(piece)
            if m is None:
                break
            at = m.end()
            if m[0] == "<!--":
                self.open.append(("!", True))
            elif m[0] == "-->":
                self._pop_to(("!",))
            elif m[1]:
                self._pop_to((m[2].lower(),))
            else:
                name = m[2].lower()
                if name in ("td", "th") and out:
                    out.append("\t")
                self._start(name, m[3])
        text = html.unescape("".join(out)).strip()
        return text, element, not text


def _kind(text: str, shape: str, element: str, known: Known, before: str, last: bool, near_end: bool, story: bool) -> str:
    """The element that a line calls for."""
    words = len(text.split())
    stops = bool(_STOP.search(text))
    lead = _LEAD.match(text)
    if known.label(shape) or known.menu(shape):
        return "footer" if story and near_end else "nav"
    if known.has("line", shape):
        return "notice"
    if element:
        return "li" if element in ("li", "dt", "dd") else "tr" if element in ("td", "th", "tr", "table") else "heading" if re.fullmatch("h[1-6]", element) else "p"
    if lead and lead[1].count(" ") < LEAD and not stops and not _INNER.search(text) and known.has("lead", _LEAD.match(shape)[1] if _LEAD.match(shape) else ""):
        return "aside"
    if words >= 6 and not stops and not _INNER.search(text) and not _BULLET.match(text) and (before in SITE_BLOCKS or _RANKED.match(text) or not last):
        return "aside"  # a headline of another story
    if _BULLET.match(text):
        return "li"
    if _CELLS.search(text) and words < 12:
        return "tr"
    return "heading" if words <= 5 and not stops else "p"


def build_tree(lines: list[str], publisher: str | None, known: Known) -> Node:
    """The page as a tree. Blank lines are in no element; lines of markup alone are hidden."""
    marked = any("<" in x and _TAG.search(x) for x in lines)
    markup = _Markup()
    filled = [i for i, x in enumerate(lines) if x.strip()]
    last = filled[-1] if filled else -1
    body, main = Node("body"), Node("main")
    body.children.append(main)
    section = main
    before, story = "", False
    for i in filled:
        text, element, unseen = markup.read(lines[i]) if marked else (lines[i].strip(), "", False)
        kind = "hidden" if unseen else _kind(text, pattern(text, publisher), element, known, before, i == last, i > last - 4, story)
        leaf = Node(kind, i, text)
        if kind in SITE_BLOCKS or kind == "hidden":
            if kind == before and main.children and section.children and section.children[-1].kind == kind:
                section.children[-1].children.append(leaf)
            else:
                section.children.append(Node(kind, children=[leaf]))
        elif kind == "heading":
            section = Node("section", children=[leaf])
            main.children.append(section)
        elif kind in ("li", "tr"):
            outer = "ul" if kind == "li" else "table"
            if kind == "tr":
                leaf.children = [Node("td", text=c) for c in _CELL_ENDS.split(text) if c]
            if not (section.children and section.children[-1].kind == outer and before == kind):
                section.children.append(Node(outer))
            section.children[-1].children.append(leaf)
        else:
            section.children.append(leaf)
        story = story or kind in ("p", "heading")
        before = kind
    # a heading right over other stories' headlines is theirs
    for s in main.children:
        if s.kind == "section" and len(s.children) > 1 and s.children[1].kind == "aside":
            s.children[0].kind = "aside"
    return body


def _hidden(node: Node) -> bool:
    return node.kind in SITE_BLOCKS or node.kind == "hidden"


def _walk_hidden(node: Node, within: bool = False) -> Iterator[int]:
    within = within or _hidden(node)
    if node.line >= 0 and within:
        yield node.line
    for c in node.children:
        yield from _walk_hidden(c, within)


def hidden_lines(text: str, publisher: str | None, known: Known) -> list[int]:
    """Numbers of the lines that the visibility rules hide."""
    return sorted(_walk_hidden(build_tree(text.split("\n"), publisher, known)))


def _table_text(rows: list[Node]) -> str:
    cells = [[c.text.strip() for c in r.children] or [r.text] for r in rows]
    wide = [max((len(r[j]) for r in cells if len(r) > j), default=0) for j in range(max(map(len, cells)))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in cells)


def _blocks(node: Node) -> Iterator[str]:
    for c in node.children:
        if _hidden(c):
            continue
        if c.kind == "table":
            yield _table_text(c.children)
        elif c.kind == "ul":
            yield "\n".join(x.text for x in c.children)
        elif c.line >= 0:
            yield c.text
        else:
            yield from _blocks(c)


def render(text: str, publisher: str | None, known: Known) -> str:
    """All visible text: a blank line between blocks, one line an item, cells in aligned columns."""
    return "\n\n".join(_blocks(build_tree(text.split("\n"), publisher, known)))


def _pages(pages: DataFrame) -> DataFrame:
    kept = pages.where("text is not null and text != ''").select("page", "site", "publisher", "text")
    return stage(spread(kept).withColumn("row", F.monotonically_increasing_id()), "pages")


def _line_keys(pages: DataFrame) -> DataFrame:
    """(row, site, story, key, counted, lead, words, stops): the patterns of all lines, each once a page and kind."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for row, site, publisher, text in zip(*(b.column(c).to_pylist() for c in ("row", "site", "publisher", "text"))):
                lines = [x for x in text.split("\n") if x.strip()]
                if any("<" in x and _TAG.search(x) for x in lines):
                    markup = _Markup()
                    lines = [t for t, _, _ in map(markup.read, lines) if t]
                story = xxhash.xxh64_intdigest(max(lines, key=len, default="")) - (1 << 63)
                seen: dict[int, tuple] = {}
                for shape in {pattern(x, publisher) for x in lines}:
                    stops = bool(_STOP.search(shape))
                    for counted, found in ((True, _counted(shape)), (False, _asked(shape))):
                        for kind, p in found:
                            k = _key(kind, p)
                            if k not in seen or (counted and not seen[k][0]):
                                seen[k] = (counted, kind == "lead", p.count(" ") + 1, stops)
                out += [(row, site, story, k, *v) for k, v in seen.items()]
            cols = list(zip(*out)) if out else [()] * 8
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["row", "site", "story", "key", "counted", "lead", "words", "stops"])

    return pages.mapInArrow(keys, "row long, site string, story long, key long, counted boolean, lead boolean, words int, stops boolean")


def furniture(keys: DataFrame, pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(key, site): patterns that are furniture, on all sites (null) or on one."""
    one = keys.where("counted").groupBy("key", "site", "story").agg(
        F.count("*").alias("n"), F.sum(F.col("stops").cast("int")).alias("stopped"), F.first("lead").alias("lead"), F.first("words").alias("words")
    )
    one = stage(one, "patterns")
    # a story's lead-ins stand in sentences, other stories' headlines don't end
    headed = ~F.col("lead") | (F.col("stopped") * 3 < F.col("n"))
    facts = [F.sum("n").alias("n"), F.sum("stopped").alias("stopped"), F.first("lead").alias("lead"), F.first("words").alias("words")]
    told = one.groupBy("key", "story").agg(*facts).groupBy("key").agg(*facts, F.count("*").alias("stories"))
    total = pages.agg(F.count("*").alias("total"))
    often = (F.col("words") >= LONG) | (F.col("n") >= F.col("total") * share)
    everywhere = told.join(F.broadcast(total)).where((F.col("stories") >= STORIES) & headed & often).select("key", F.lit(None).cast("string").alias("site"))
    sizes = pages.groupBy("site").agg(F.count("*").alias("total"))
    local = one.groupBy("key", "site").agg(*facts, F.count("*").alias("stories")).where((F.col("stories") >= STORIES) & headed)
    local = local.join(sizes, "site").where(F.col("n") >= F.col("total") * SITE_SHARE).select("key", "site")
    return everywhere.unionByName(local.join(everywhere, "key", "left_anti"))


def _with_known(pages: DataFrame, share: float) -> DataFrame:
    """The pages with the keys of the furniture among their own patterns; one key's rows are spread over ``SALTS`` parts."""
    keys = stage(_line_keys(pages), "line_keys")
    known = furniture(keys, pages, share).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = keys.select("row", F.col("site").alias("at"), "key", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    hits = asked.join(known, ["key", "salt"]).where("site is null or site = at").groupBy("row").agg(F.collect_set("key").alias("known"))  # keys of one page
    return pages.join(hits, "row", "left")


def site_lines(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(page, line_no) of all lines that belong to the site.

    pages: page (key), site, publisher, text; other columns are ignored. Null and empty texts and blank lines give no row; a
    repeated page gives its rows again; pages without a site count as one site of no name only in the counts over all pages.
    Lines are split at newlines and numbered from 0.
    """

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, numbers = [], []
            for i, (text, publisher, keys) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "publisher", "known")))):
                at = hidden_lines(text, publisher, Known(keys or ()))
                rows += [i] * len(at)
                numbers += at
            yield pa.RecordBatch.from_arrays([b.column("page").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32())], names=["page", "line_no"])

    known = _with_known(_pages(pages), share).select("page", "publisher", "text", "known")
    return known.mapInArrow(hide, f"page {dict(known.dtypes)['page']}, line_no int")


def main_text(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(page, main): the rendered story of every page with a text; a page of furniture only has an empty one."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [render(t, p, Known(k or ())) for t, p, k in zip(*(b.column(c).to_pylist() for c in ("text", "publisher", "known")))]
            yield pa.RecordBatch.from_arrays([b.column("page"), pa.array(out, pa.string())], names=["page", "main"])

    known = _with_known(_pages(pages), share).select("page", "publisher", "text", "known")
    return known.mapInArrow(show, f"page {dict(known.dtypes)['page']}, main string")


def context_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.col("metadata")
    return table(spark, sf_dir, "cleaned_items").select(
        F.col("item_id").alias("page"), F.coalesce(meta["feed"], meta["publisher"]).alias("site"), meta["publisher"].alias("publisher"), F.col("context").alias("text")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines(context_pages(spark, sf_dir)).withColumnRenamed("page", "item_id")


def p3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(context_pages(spark, sf_dir)).withColumnRenamed("page", "item_id")


QUERIES = {"p3_found": p3_found, "p3_main_text": p3_main_text}
