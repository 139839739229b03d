"""Operator 3: k-d tree sharding by distributed weighted medians."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, release

#: Bins of one histogram of one node; what the driver gets in a pass is bins times nodes.
BINS = 2048
#: A cut may be off by this part of the node's bytes.
SLACK = 1 / 1024


def ranks(df: DataFrame, name: str, parts: int = 32) -> DataFrame:
    """(value, rank) of each distinct value of a text column, by its bytes from 0 on.

    Values are dealt out by ranges and written, so a value's rank is its place in its range and
    the values in the ranges before.
    """
    values = df.select(F.col(name).alias("value")).where("value is not null").distinct()
    dealt = durable(values.repartitionByRange(parts, "value").withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select(F.col("range"), (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("range").orderBy("value")) - 1
    return dealt.withColumn("place", place).join(before, "range").select("value", (F.col("before") + F.col("place")).alias("rank"))


def with_numbers(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """``rows`` with each metadata column as an ordered long under its new name: numbers as they are, whole texts by rank; null is -1."""
    kinds = dict(rows.dtypes)
    for name, new in names.items():
        if kinds[name] == "string":
            found = durable(ranks(rows, name))
            rows = rows.join(found, rows[name] == found["value"], "left").drop("value").withColumn(new, F.coalesce("rank", F.lit(-1)).cast("long")).drop("rank")
        else:
            rows = rows.withColumn(new, F.coalesce(F.col(name).cast("long"), F.lit(-1)))
    return rows.drop(*names)


def _cut_lines(node: Column, cuts: dict) -> Column:
    """The node each row is in after ``cuts``: {node: (keys, bounds, left, right)}."""
    out = node
    for n, (keys, bounds, left, right) in cuts.items():
        below = F.lit(False)
        for key, bound in reversed(list(zip(keys, bounds, strict=True))):
            below = (F.col(key) < bound) | ((F.col(key) == bound) & below)
        out = F.when(node == n, F.when(below, left).otherwise(right)).otherwise(out)
    return out


def _medians(rows: DataFrame, open_: dict[int, dict]) -> dict:
    """Cuts of the open nodes: bounds such that rows below hold about ``want`` bytes.

    All nodes are searched in the same passes. A pass sums bytes over equal bins of the range
    still possible; the values in the bin that holds the wanted weight become the next range.
    When that is one value, the next key (a hash) tells its rows apart.
    """
    cuts = {}
    search = {n: {"keys": [x["dim"], "tie", "tie2"], "fixed": [], "lo": x["lo"], "hi": x["hi"], "before": 0} | x for n, x in open_.items()}
    while search:
        bins = []
        for n, s in search.items():
            name = s["keys"][len(s["fixed"])]
            key = F.col(name)
            s["step"] = max(1, -(-(s["hi"] - s["lo"] + 1) // BINS))
            here = (F.col("node") == n) & key.between(s["lo"], s["hi"])
            for k, v in zip(s["keys"], s["fixed"], strict=False):
                here &= F.col(k) == v
            bins.append(F.when(here, F.struct(F.expr(f"int(({name} - {s['lo']}L) div {s['step']}L)").alias("at"), key.alias("key"))))
        got = rows.withColumn("bin", F.coalesce(*bins)).where("bin is not null").groupBy("node", "bin.at").agg(F.sum("size").alias("w"), F.min("bin.key").alias("lo"), F.max("bin.key").alias("hi")).collect()
        for n, s in list(search.items()):
            before = s["before"]
            hist = sorted((r["lo"], r["hi"], r["w"]) for r in got if r["node"] == n)
            for at, hi, w in hist:
                if before + w >= s["want"] or at == hist[-1][0]:
                    break
                before += w
            done = w <= s["bytes"] * SLACK or abs(before - s["want"]) <= s["bytes"] * SLACK / 2
            last = len(s["fixed"]) == len(s["keys"]) - 1
            if done or (last and at == hi):
                up = (before + w - s["want"]) < (s["want"] - before)
                bound = hi + 1 if up else at
                bounds = [*s["fixed"], bound]
                cuts[n] = (s["keys"][: len(bounds)], bounds, s["left"], s["right"])
                del search[n]
            elif at == hi:
                s |= {"fixed": [*s["fixed"], at], "lo": 0, "hi": 2**62 - 1, "before": before}
            else:
                s |= {"lo": at, "hi": hi, "before": before}
    return cuts


def kd_shards(docs: DataFrame, shards: int, dimensions: tuple[str, ...] = ("n_chars", "lang", "source", "doc_id"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    A node that is to become k shards is cut along the metadata dimension whose range in the
    node is the widest part of its range in the table, where the bytes below are floor(k/2)/k
    of the node's; leaves hold total / shards bytes each, within ``SLACK`` and a document.
    Rows with one value on the cut are told apart by hashes of text and id, so a value that
    a third of the rows share does not make a heavy shard. The driver sees histograms of at
    most ``BINS`` bins for each node, never rows.

    Size is the text's UTF-8 bytes plus 1; null text has size 1 and the CRC of no bytes, and a
    text of any length counts whole. Text metadata are compared whole, by bytes. Null metadata sort first. Repeated rows
    are placed as often as they come, each with a slot of its own; they may part only where a cut falls
    among them. slot numbers a shard's rows from 0. Columns other than the id, the text and the
    dimensions are not read, and names that clash with the operator's own do no harm. An
    empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    dims = [f"d{i}" for i in range(len(dimensions))]
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 2).alias("tie"), F.shiftrightunsigned(F.xxhash64(F.lit("id"), F.col(id_col), text), 2).alias("tie2"), *(F.col(c).alias(f"m_{d}") for c, d in zip(dimensions, dims, strict=True)))
    rows = durable(with_numbers(rows, {f"m_{d}": d for d in dims}).withColumn("node", F.lit(0)))
    ranges = [F.min(d).alias(f"lo_{d}") for d in dims] + [F.max(d).alias(f"hi_{d}") for d in dims]
    todo, leaves, total = {0: shards}, {}, None
    n_rows = 0
    while todo:
        stats = {r["node"]: r for r in rows.where(F.col("node").isin(list(todo))).groupBy("node").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), *ranges).collect()}
        if total is None:
            total = stats.get(0)
            n_rows = total["rows"] if total else 0
        cut, follow = {}, {}
        for n, k in todo.items():
            if k == 1 or n not in stats:
                leaves[n] = k
                continue
            s = stats[n]
            dim = max(dims, key=lambda d: ((s[f"hi_{d}"] - s[f"lo_{d}"]) / max(1, total[f"hi_{d}"] - total[f"lo_{d}"]), d == dims[0]))
            cut[n] = {"dim": dim, "lo": s[f"lo_{dim}"], "hi": s[f"hi_{dim}"], "bytes": s["bytes"], "want": s["bytes"] * (k // 2) / k, "left": 2 * n + 1, "right": 2 * n + 2}
            follow |= {2 * n + 1: k // 2, 2 * n + 2: k - k // 2}
        if cut:
            # Written anew for each level: a node's number stays a column, not an expression that doubles.
            old, rows = rows, durable(rows.withColumn("node", _cut_lines(F.col("node"), _medians(rows, cut))))
            release(old)
        todo = follow
    # Leaves by position in the tree, left to right.
    path = lambda n: [] if n == 0 else [*path((n - 1) // 2), (n - 1) % 2]
    number = {n: i for i, n in enumerate(sorted(leaves, key=path))}
    shard = reduce(lambda c, n: c.when(F.col("node") == n, number[n]), list(number)[1:], F.when(F.col("node") == list(number)[0], number[list(number)[0]])).cast("int")
    parts = max(32, math.ceil(n_rows / shards / 20_000))
    placed = rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.pmod("tie2", F.lit(parts)).cast("int").alias("part"), "tie2")
    placed = placed.withColumn("within", F.row_number().over(Window.partitionBy("shard", "part").orderBy("tie2", "doc_id")) - 1)
    counts = rows.groupBy(shard.alias("shard"), F.pmod("tie2", F.lit(parts)).cast("int").alias("part")).agg(F.count("*").alias("n"))
    first = durable(counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first")))
    return placed.join(first, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("within")).cast("long").alias("slot"))
