"""Operator 11 on made pages: rules, odd URLs and what the tree decides."""

import duckdb
import pytest

from matchforge.llm import oracle, queries, url_templates

ODD = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.org", "http://Example.ORG/es/x", "http://a.example.org/es/1#f", "http://example.org/en/1?x=/y", "http://example.org/en/2",
    "http://myexample.org/es/1", "http://a.com/de", "http://a.com/de/", "http://com/fr/9", "http://xcom/fr/9", "x://h?q", "http://h#f://g/p", "http://ÄB.net/Ünï/1", "http://a.net//x//", "http://a.net/" + "d/" * 30,
    "http://a.net/" + "y" * 50_000, "http://org", "http://u:p@a.org:80/es/", "http://a.net/a\nb/c", "http://a.net/={n}/x", "/://a/b",
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, n int").repartition(3)


def by_sql(urls):
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(urls)))
    return sorted(con.sql(oracle.op11_sql(queries.URL_RULES)).fetchall())


def run(spark, urls):
    got = url_templates.judge(pages(spark, urls), queries.URL_RULES)
    return sorted(tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict", "template")) for r in got.collect())


def test_odd(spark):
    got = run(spark, [*ODD, *ODD[5:9]])
    assert got == by_sql([*ODD, *ODD[5:9]])
    seen = {r[0]: r for r in got}
    assert seen[0][1:5] == ("", "", None, "allow") and seen[2][1:3] == ("", "") and seen[4][1:4] == ("example.org", "", None)
    assert [seen[i][3:5] for i in (5, 6, 7, 8, 9)] == [("example.org/es/", "block"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("org/", "allow")]
    assert seen[10][3] is None and seen[11][3] == "com/de/" and seen[12][3] == "com/fr/" and seen[13][3] is None
    assert seen[14][1:3] == ("h", "") and seen[16][1:3] == ("Äb.net", "/Ünï/1")


def test_tree(spark):
    urls = [f"http://spam.com/de/{i}" for i in range(60)] + [f"http://spam.com/x/{i}" for i in range(40)] + [f"http://good.com/fr/{i}" for i in range(60)] + [f"http://good.com/x/{i}" for i in range(40)]
    urls += [f"http://m.net/{k}/{i}.html" for k in ("a", "b") for i in range(30)] + [f"http://m.net/user{i}/home" for i in range(50)]
    got = run(spark, urls)
    assert got == by_sql(urls)
    seen = {(r[1], r[5], r[4]) for r in got}
    assert ("spam.com", "=x/{n}", "block") in seen and ("good.com", "=x/{n}", "allow") in seen
    assert {("m.net", "=a/{n}.html", "allow"), ("m.net", "user{n}/=home", "allow")} <= seen


def test_branches_merge(spark):
    """Two small blocked branches that end alike share their evidence; one that differs stays apart."""
    rows = [("h", f"/{k}/{i}", ["" + k, str(i)], 1, int(k in "abc"), int(k in "ab")) for k in "abcd" for i in range(20)]
    paths = spark.createDataFrame(rows, "host string, path string, segs array<string>, n long, labelled long, blocked long")
    made = url_templates.generalised(paths, 8, 5, 0.05)
    got = {r["nodes"][0]: r for r in url_templates.tree(made, 10.0, 0.05, 0.5).collect()}
    assert sorted(got) == ["=a", "=b", "=c", "=d"] and got["=a"]["share"] == got["=b"]["share"] > 0.9 > 0.3 > got["=c"]["share"]
    assert got["=a"]["verdict"] == "block" and got["=c"]["verdict"] == "allow"


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("copies", [3])
def test_repeated_rows(spark, copies):
    urls = ["http://a.com/fr/1", None]
    df = pages(spark, urls)
    assert url_templates.judge(df.unionAll(df).unionAll(df), queries.URL_RULES).count() == copies * len(urls)
