"""HTML pages as a table of nodes, and what is selected from it by containment of intervals.

A node has its place in document order (``pre``) and that of its last descendant (``last``), so
one node holds another if its interval does. Pages are cut into nodes where they lie; all
selections are DataFrame plans over the node table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workers import ship

NODES = "page_id long, pre int, last int, depth int, parent int, tag string, ident string, class string, href string, text string"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content is no markup: left out, or text up to the end tag.
SKIPPED, PLAIN = frozenset(("script", "style", "template", "noscript")), frozenset(("title", "textarea"))
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A start tag ends open elements of the first set, unless one of the second is nearer.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **{t: ({"thead", "tbody", "tfoot"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
    **{t: ({"p"}, {"table", "td", "th", "button"}) for t in BLOCKS},
}
#: An end tag of another element does not reach beyond these.
WALLS = {"td", "th", "table"}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_SPACE = re.compile(r"\s+")


def _tag_end(page: str, at: int, quotes: dict[str, int]) -> int:
    """Where the tag that begins at ``at`` ends; ``>`` in closed quotes does not end it. ``quotes`` remembers from where a quote never comes again."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return len(page)
        opened = min((i for q in "\"'" if (i := page.find(q, at, end)) >= 0 and i < quotes.get(q, len(page))), default=-1)
        if opened < 0:
            return end
        closed = page.find(page[opened], opened + 1)
        if closed < 0:
            quotes[page[opened]] = opened
        else:
            at = closed + 1


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) in order; kind is start, end or text. Comments, declarations and what ``SKIPPED`` holds are left out."""
    at, quotes = 0, {}
    while at < len(page):
        less = page.find("<", at)
        if less < 0:
            less = len(page)
        if less > at:
            yield "text", page[at:less], ""
            at = less
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
        elif named := _NAME.match(page, at + 1):
            end = _tag_end(page, named.end(), quotes)
            name = named[0].lower()
            yield "start", name, page[named.end() : end]
            at = end + 1
            if name in SKIPPED or name in PLAIN:
                closing = re.compile(f"</{name}[\\s/>]", re.IGNORECASE).search(page, at)
                stop = closing.start() if closing else len(page)
                if name in PLAIN and stop > at:
                    yield "text", page[at:stop], ""
                yield "end", name, ""
                end = page.find(">", stop)
                at = len(page) if end < 0 else end + 1
        elif page.startswith("</", at) and (named := _NAME.match(page, at + 2)):
            end = page.find(">", named.end())
            yield "end", named[0].lower(), ""
            at = len(page) if end < 0 else end + 1
        elif page.startswith("</", at):
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
        else:
            yield "text", "<", ""
            at += 1


def nodes_of(page: str) -> list[list]:
    """[pre, last, depth, parent, tag, ident, class, href, text] of each element and each text that is not blank."""
    out: list[list] = []
    open_: list[int] = []

    def close(count: int) -> None:
        for _ in range(count):
            out[open_.pop()][1] = len(out) - 1

    def nearest(wanted: set[str], walls: set[str]) -> int:
        """How many open elements end with the nearest of ``wanted``; 0 if a wall is nearer, or none is open."""
        for back, k in enumerate(reversed(open_), 1):
            if out[k][4] in wanted:
                return back
            if out[k][4] in walls:
                return 0
        return 0

    held = ""
    for kind, name, rest in [*pieces(page), ("end", "", "")]:
        if kind == "text":
            held += name
            continue
        if held:
            text = _SPACE.sub(" ", html.unescape(held)).strip()
            if text:
                out.append([len(out), len(out), len(open_), open_[-1] if open_ else None, "#text", None, None, None, text])
            held = ""
        if kind == "start":
            if name in ENDS:
                close(nearest(*ENDS[name]))
            found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in reversed(_ATTRIBUTE.findall(rest))}
            out.append([len(out), len(out), len(open_), open_[-1] if open_ else None, name, found.get("id"), found.get("class"), found.get("href"), None])
            if name not in VOID and not rest.endswith("/"):
                open_.append(len(out) - 1)
        elif name:
            close(nearest({name}, set() if name in WALLS or name in ("tr", "thead", "tbody", "tfoot") else WALLS))
    close(len(open_))
    return out


def nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The node table of all pages. A null page has no nodes; tags that are never closed end by the rules of ``ENDS`` and with their parent.

    Pages are dealt out by id first, as one file may hold all of them. Every reading of the
    table parses the pages: write it out if it is read more than once.
    """
    ship(pages.sparkSession)
    kinds = [pa.int64(), *[pa.int32()] * 4, *[pa.string()] * 5]
    names = [c.split()[0] for c in NODES.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page_id, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if rows := nodes_of(page or ""):
                    yield pa.RecordBatch.from_arrays([pa.array([page_id] * len(rows), kinds[0]), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds[1:], strict=True))], names=names)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).repartition("page_id").mapInArrow(run, NODES)


def has_class(name: str) -> Column:
    return F.array_contains(F.split(F.coalesce("class", F.lit("")), "\\s+"), name)


def enclosing(inner: DataFrame, outer: DataFrame, name: str) -> DataFrame:
    """``inner`` with the ``pre`` of the nearest node of ``outer`` that holds it, null if none does.

    Opening and closing places of ``outer`` are counted along each page, which gives its nodes
    and ``inner`` their level; of one level the intervals are disjoint, so the last one before
    a node holds it. Two windows, and no pair is tried.
    """
    inner = inner.select("*", F.lit(None).cast("int").alias("opens"))
    marks = outer.select("page_id", F.explode(F.array(F.struct(F.col("pre").alias("at"), F.lit(1).alias("step"), F.col("pre").alias("opens")), F.struct(F.col("last").alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("int").alias("opens")))).alias("x")).select("page_id", "x.*")
    # At one place, a node is asked about before it opens itself, and closes after all that begins there.
    asked = inner.select("page_id", F.col("pre").alias("at"), F.lit(0).alias("step"), F.lit(None).cast("int").alias("opens"), F.struct(*[c for c in inner.columns if c != "opens"]).alias("row"))
    all_ = marks.withColumn("row", F.lit(None).cast(asked.schema["row"].dataType)).unionByName(asked)
    turn = F.when(F.col("step") == 0, 0).otherwise(F.col("step") * -1 + 2)
    order = Window.partitionBy("page_id").orderBy("at", turn)
    level = all_.withColumn("level", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = level.where("step >= 0").withColumn(name, F.last("opens", ignorenulls=True).over(Window.partitionBy("page_id", "level").orderBy("at", turn).rowsBetween(Window.unboundedPreceding, 0)))
    return held.where("row is not null").select("row.*", F.when(F.col("level") > 0, F.col(name)).alias(name))


def with_text(nodes_: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` with the texts that it is the nearest of its kind to hold, joined by spaces; without any, empty."""
    texts = enclosing(nodes_.where("tag = '#text'").select("page_id", "pre", "last", "text"), chosen, "at")
    joined = texts.where("at is not null").groupBy("page_id", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), " ").alias("words"))
    out = chosen.drop("text").join(joined.withColumnsRenamed({"page_id": "p", "at": "q"}), (F.col("page_id") == F.col("p")) & (F.col("pre") == F.col("q")), "left")
    return out.withColumn("text", F.coalesce("words", F.lit(""))).drop("p", "q", "words")


def _numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("pre")).cast("long"))


def links(nodes_: DataFrame) -> DataFrame:
    """page_id, place, href, text of every link."""
    return _numbered(with_text(nodes_, nodes_.where("tag = 'a' and href is not null")), ["page_id"], "place").select("page_id", "place", "href", "text")


def items(nodes_: DataFrame) -> DataFrame:
    """page_id, list (its place in the page), place in the list and text of every list item; without a list around it, list 0."""
    lists = _numbered(nodes_.where("tag in ('ul', 'ol')"), ["page_id"], "number").select("page_id", "pre", "last", "number")
    x = enclosing(with_text(nodes_, nodes_.where("tag = 'li'")), lists, "at")
    x = x.join(lists.select(F.col("page_id").alias("p"), F.col("pre").alias("q"), "number"), (F.col("page_id") == F.col("p")) & (F.col("at") == F.col("q")), "left")
    x = x.withColumn("list", F.coalesce("number", F.lit(0)))
    return _numbered(x, ["page_id", "list"], "place").select("page_id", "list", "place", "text")


def blocks(nodes_: DataFrame, tags: tuple[str, ...] = ("h1", "h2", "h3", "h4", "h5", "h6", "p")) -> DataFrame:
    """page_id, place, tag, text of headings and paragraphs that have text."""
    x = with_text(nodes_, nodes_.where(F.col("tag").isin(*tags))).where("text <> ''")
    return _numbered(x, ["page_id"], "place").select("page_id", "place", "tag", "text")


def cells(nodes_: DataFrame, table: Column | None = None, row: Column | None = None, cell: Column | None = None) -> DataFrame:
    """page_id, table, row, place, text of every cell of every row.

    Tables, rows and cells are given by conditions on a node: elements of HTML tables by
    default, or classes, as grids of ``div`` have them. A cell belongs to its nearest row, a
    row to its nearest table (0 if there is none), and text to its nearest cell.
    """
    table = F.col("tag") == "table" if table is None else table
    row = F.col("tag") == "tr" if row is None else row
    cell = F.col("tag").isin("td", "th") if cell is None else cell
    tables = _numbered(nodes_.where(table), ["page_id"], "number").select("page_id", "pre", "last", "number")
    rows = enclosing(nodes_.where(row).select("page_id", "pre", "last"), tables, "in_table")
    rows = rows.join(tables.select(F.col("page_id").alias("p"), F.col("pre").alias("q"), "number"), (F.col("page_id") == F.col("p")) & (F.col("in_table") == F.col("q")), "left")
    rows = _numbered(rows.withColumn("table", F.coalesce("number", F.lit(0))), ["page_id", "table"], "row").select("page_id", "pre", "last", "table", "row")
    found = enclosing(with_text(nodes_, nodes_.where(cell)), rows, "in_row").where("in_row is not null")
    found = found.join(rows.select(F.col("page_id").alias("p"), F.col("pre").alias("q"), "table", "row"), (F.col("page_id") == F.col("p")) & (F.col("in_row") == F.col("q")))
    return _numbered(found, ["page_id", "table", "row"], "place").select("page_id", "table", "row", "place", "text")


def labelled_pairs(cells_: DataFrame) -> DataFrame:
    """page_id, label, home, away of rows of exactly three cells with a label in the middle; the first of a label counts."""
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("text")))
    rows = cells_.groupBy("page_id", "table", "row").agg(F.count("*").alias("n"), at(1).alias("home"), at(2).alias("label"), at(3).alias("away")).where("n = 3 and label <> ''")
    return rows.groupBy("page_id", "label").agg(F.min_by(F.struct("home", "away"), F.struct("table", "row")).alias("x")).select("page_id", "label", "x.home", "x.away")


def rated_names(cells_: DataFrame, name_at: int = 2, rating_at: int = 3) -> DataFrame:
    """page_id, name, rating of rows with a name and a whole number above 0, written with commas or without; the last of a name counts."""
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("text")))
    rows = cells_.groupBy("page_id", "table", "row").agg(at(name_at).alias("name"), F.replace(at(rating_at), F.lit(","), F.lit("")).alias("digits"))
    rows = rows.withColumn("rating", F.when(F.col("digits").rlike("^[+]?[0-9]+$"), F.expr("try_cast(digits as int)"))).where("name <> '' and rating > 0")
    return rows.groupBy("page_id", "name").agg(F.max_by("rating", F.struct("table", "row")).alias("rating"))
