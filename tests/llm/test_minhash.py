"""Operator 1 against all pairs of the small table, and on chains and odd rows."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm import minhash, queries
from matchforge.llm.common import durable


def brute(rows, width, percent):
    """{row: (set size, least id reached)} by comparing all pairs."""
    sets = []
    for _, t in rows:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[top(i)] = min(x for x in (least.get(top(i)), doc_id) if x is not None) if doc_id is not None or least.get(top(i)) is not None else None
    return [(rows[i][0], len(sets[i]), least[top(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def check(docs, width, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = minhash.near_duplicates(docs, width, percent).collect()
    order = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=order) == sorted(brute(rows, width, percent), key=order)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, 3, 85)
    assert queries.op1_minmax_near_dedup(spark, sf).columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]


def test_odd(odd_documents, no_documents):
    check(odd_documents, 3, 85)
    assert minhash.near_duplicates(no_documents).count() == 0


def test_edited_copies_chain_and_share_a_passage(spark):
    """A group whose members are near some others only, and one very common passage."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(220):
        ws = list(base)
        for at in rng.choice(120, rng.integers(0, 7), replace=False):
            ws[at] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(ws)))
    rows += [(1000 + i, " ".join([*base[:60], *(f"own{i}x{k}" for k in range(60))])) for i in range(60)]
    rows += [(2000 + i, " ".join(f"c{k}" for k in range(i * 4, i * 4 + 120))) for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")), 3, 85)


def test_links_that_are_stars_cost_one_look(spark):
    """The driver keeps something of each stage and task, so stars take no rounds, and labels are written once a round."""
    edges = lambda rows: spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in rows], "a binary, b binary")
    links, more = durable(edges([(1, 5), (6, 1), (6, 1), (9, 2), (3, 3)])), durable(edges([(5, 9), (20, 21)]))
    known = spark.sparkContext.statusTracker()

    def jobs(name, f):
        spark.sparkContext.setJobGroup(name, name)
        try:
            return {r["fp"][0]: r["root"][0] for r in f.collect()} if isinstance(f, DataFrame) else f(), len(known.getJobIdsForGroup(name))
        finally:
            spark.sparkContext._jsc.clearJobGroup()

    first, n = jobs("stars", lambda: minhash._relabel(None, links))
    assert n <= 6
    assert jobs("rows", first)[0] == {5: 1, 6: 1, 9: 2}
    second, n = jobs("more stars", lambda: minhash._relabel(first, more))
    assert n <= 14
    assert jobs("more rows", second)[0] == {5: 1, 6: 1, 9: 1, 2: 1, 21: 20}


def test_components_of_any_shape_in_several_rounds(spark):
    """Chains, rings, hubs and random links against union and find, all at once and link by link."""
    rng = np.random.default_rng(11)
    pairs = [(i, i + 1) for i in range(40)] + [(50 + i, 50 + (i + 7) % 20) for i in range(20)] + [(100, 101 + i) for i in range(30)] + [(200 + int(a), 200 + int(b)) for a, b in rng.integers(0, 50, (30, 2))]
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    want = {x: top(x) for x in up if top(x) != x}
    table = lambda rows: durable(spark.createDataFrame([tuple(map(int, r)) for r in rows], "a long, b long"))
    assert {r["a"]: r["b"] for r in minhash.components(table(pairs)).collect()} == want
    labels, rng_order = None, rng.permutation(len(pairs))
    for part in np.array_split(np.array(pairs)[rng_order], 3):
        labels = minhash._relabel(labels, table(part))
    rows = labels.collect()
    assert len(rows) == len(want) and {r["fp"]: r["root"] for r in rows} == want


def test_rows_of_open_buckets_carry_open_buckets_alone(spark):
    """A bucket that is closed can't be where two components met, so its key isn't carried into the last rounds."""
    rest = spark.createDataFrame([("x", "r", 4, 40, 9), ("x", "r", 1, 10, 9), ("x", "r", 30, 70, 9), ("y", "y", 30, 70, 9)], "fp string, root string, band int, bucket long, members int")
    known = spark.createDataFrame([("x", 5), ("y", 6), ("z", 7)], "fp string, n int")
    got = {(r["fp"], r["bucket"]): (r["root"], r["n"], r["members"], r["before"]) for r in minhash.opened(rest, known).collect()}
    assert got == {("x", 10): ("r", 5, 9, []), ("x", 40): ("r", 5, 9, [10]), ("x", 70): ("r", 5, 9, [10, 40]), ("y", 70): ("y", 6, 9, [])}


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 1200).astype(np.uint64)
    a, b = np.unique(x[:1000]), np.unique(x[200:])
    m = minhash.MinMax(400, 1)
    keys, _ = m.keys([a, b])
    assert abs((keys[0] == keys[1]).mean() - 800 / 1200) < 0.08
    long = rng.integers(0, 1 << 63, 3 * minhash.BLOCK + 7).astype(np.uint64)
    alone, _ = m.keys([long])
    with_others, _ = m.keys([a, long, b])
    assert (with_others[1] == alone[0]).all()
