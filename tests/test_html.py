"""Nodes and selections against the standard library's parser, and broken pages by hand."""

from html.parser import HTMLParser

import pytest
from matchforge.operators import html
from matchforge.plans import model_queries


def made(spark, *pages):
    return html.nodes(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").repartition(2))


class Plain(HTMLParser):
    """Headings and paragraphs in order; a paragraph ends with the next block, what it holds goes to the innermost."""

    def __init__(self):
        super().__init__()
        self.blocks, self.open, self.skip = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("p", "h1", "article", "footer", "nav", "div", "ul"):
            if "p" in [t for t, _ in self.open]:
                while self.open.pop()[0] != "p":
                    pass
            if tag in ("p", "h1"):
                self.blocks.append([tag, ""])
            self.open.append((tag, len(self.blocks) - 1 if tag in ("p", "h1") else None))
        elif tag not in ("br", "meta"):
            self.open.append((tag, None))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip -= 1
        elif tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        at = next((k for _, k in reversed(self.open) if k is not None), None)
        if not self.skip and at is not None:
            self.blocks[at][1] += " " + data


def test_all_pages_equal_the_plain_parser(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {}
    for r in model_queries.html_blocks(spark, sf).orderBy("page_id", "place").collect():
        got.setdefault(r["page_id"], []).append((r["tag"], r["text"]))
    for page in pages:
        p = Plain()
        p.feed(page["html"])
        p.close()
        assert got[page["page_id"]] == [(t, " ".join(x.split())) for t, x in p.blocks if x.strip()]


def test_tags_that_are_never_closed(spark):
    nodes = made(spark, "<ul><li>one<li>two <b>bold<li>three</ul>after<p>x<p>y<div>z", "<table><tr><td>1<td>2<tr><td>3</table>", "<p>a</div>b</p>c", "<a href='x>y'>q</a><br/>tail", "< 5 <3 </ > <!-- <p>no --> <?x?><!doctype html>", "<i <b>odd", None, "")
    got = {}
    for r in nodes.orderBy("page_id", "pre").collect():
        got.setdefault(r["page_id"], []).append((r["tag"], r["parent"], r["last"], r["text"]))
    texts = lambda k: [t for *_, t in got[k] if t]
    assert texts(0) == ["one", "two", "bold", "three", "after", "x", "y", "z"]
    parent = {t: got[0][p][0] if p is not None else None for _, p, _, t in got[0] if t}
    assert parent == {"one": "li", "two": "li", "bold": "b", "three": "li", "after": None, "x": "p", "y": "p", "z": "div"}
    assert [t for t, *_ in got[1]] == ["table", "tr", "td", "#text", "td", "#text", "tr", "td", "#text"]
    assert texts(2) == ["a", "b", "c"]
    assert texts(3) == ["q", "tail"] and texts(4) == ["< 5 <3"] and 6 not in got and 7 not in got
    assert nodes.where("page_id = 3 and tag = 'a'").first()["href"] == "x>y"


def test_scripts_titles_and_entities(spark):
    nodes = made(spark, "<title>a &lt;b&gt; &amp; c</title><script>var t='<p>no</p>'</script><STYLE>p{}</STYLE><h1>x &nbsp; y</h1><script>never closed <p>no")
    assert [r["text"] for r in nodes.where("tag = '#text'").orderBy("pre").collect()] == ["a <b> & c", "x y"]
    assert nodes.where("tag = 'p'").count() == 0


def test_cells_of_nested_tables(spark):
    page = "<table><tr><th>a</th><td>b<table><tr><td>in 1</td><td>in 2</td></tr></table>after</td></tr><tr><td>c</table><div>x</div>"
    got = [tuple(r)[1:] for r in html.cells(made(spark, page)).orderBy("table", "row", "place").collect()]
    assert got == [(1, 1, 1, "a"), (1, 1, 2, "b after"), (1, 2, 1, "c"), (2, 1, 1, "in 1"), (2, 1, 2, "in 2")]


def test_pairs_and_ratings_out_of_divs(spark):
    row = lambda *cells: '<div class="row x">' + "".join(f'<div class="cell">{c}</div>' for c in cells) + "</div>"
    page = row("55%", "<b>Ball</b> possession", "45%") + row("1", "Shots") + row("3", "Shots", "4") + row("9", "Shots", "9") + row("", "", "1")
    cells = html.cells(made(spark, page), row=html.has_class("row"), cell=html.has_class("cell"))
    assert sorted(tuple(r)[1:] for r in html.labelled_pairs(cells).collect()) == [("Ball possession", "55%", "45%"), ("Shots", "3", "4")]
    grid = row("1", "Spain", "2,150", "x") + row("2", "Chile", "n/a") + row("3", "", "1900") + row("4", "Peru") + row("5", "Spain", "2160") + row("6", "Fiji", "-5")
    rated = html.rated_names(html.cells(made(spark, grid), row=html.has_class("row"), cell=html.has_class("cell")))
    assert [tuple(r)[1:] for r in rated.collect()] == [("Spain", 2160)]


def test_enclosing_takes_the_nearest(spark):
    nodes = made(spark, "<div id=1><div id=2><p>a</p></div><p>b</p></div><p>c</p>")
    got = html.enclosing(nodes.where("tag = '#text'").select("page_id", "pre", "last", "text"), nodes.where("tag = 'div'"), "box")
    at = {r["pre"]: r["ident"] for r in nodes.where("tag = 'div'").collect()}
    assert {r["text"]: at.get(r["box"]) for r in got.collect()} == {"a": "2", "b": "1", "c": None}


@pytest.mark.parametrize("page", ["<" * 3000, "<a href=\"" * 3000, "<p>" * 3000, "<div>" * 2000 + "x", "&" * 3000 + "<b", "<script>" * 100])
def test_hostile_pages_end(spark, page):
    assert made(spark, page).count() >= 0


def test_pages_are_dealt_out_and_parsed_once(spark, sf):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [page_id" in plan(html.nodes(spark.read.parquet(f"{sf}/pages.parquet")))
    for query in (model_queries.html_items, model_queries.html_links, model_queries.html_blocks):
        assert "MapInArrow" not in plan(query(spark, sf))  # reads written nodes
