"""Operator 5: mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable

#: Bits of the hash that each histogram round resolves; together the whole hash.
ROUNDS = (12, 16, 16, 16)
BITS = sum(ROUNDS)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: Column, seed: int) -> Column:
    """60 bits of the id's MD5: a fixed order of documents, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, BITS // 4), 16, 10).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds w: ``weights`` in turn to sources by code point, null last. A row per source, so one task."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    return sources.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))


def fill_targets(sources: DataFrame, budget: Column, most: float) -> DataFrame:
    """Adds target: the budget shared by w, no source above ``most`` times its size, what is
    above shared again by w among the others.

    With sources by cap / w, the capped ones come first; the level is where they end.
    """
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    x = sources.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    x = x.withColumn("budget", budget).withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    free = F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level"))
    x = x.withColumn("free", F.first(free, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return x.withColumn("target", F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("free") * F.col("w")))).drop("level", "free", "budget", "cap")


def mixing_plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Narrow rows (doc_id, source, size, hash), and for each source (of, source_size, target, passes, edge).

    Each source's words are summed by hash bucket. The budget is spent on whole passes over
    the source, then on the documents whose hash is under a threshold, so a larger budget
    takes a superset. The threshold lies in one bucket; only that bucket is summed again at
    finer buckets, until the whole hash is used. Documents are then filtered by comparing
    hashes: nothing is sorted but the at most 65,536 buckets of a source.
    """
    rows = durable(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).withColumn("hash", id_hash(F.col("doc_id"), seed)))
    sources = durable(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    total = sources.agg(F.sum("source_size").alias("total"))
    budget = F.lit(float(total.first()["total"] or 0) * share)
    plan = fill_targets(cyclic_weights(sources, weights), budget, most)
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    plan = durable(plan.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))

    state = plan.select(F.col("source").alias("at"), "rest", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("before"))
    used, inside = 0, rows
    for bits in ROUNDS:
        prefix = F.shiftright("hash", BITS - used) if used else F.lit(0)
        used += bits
        found = inside.join(state, F.col("source").eqNullSafe(F.col("at")) & (prefix == F.col("bucket")))
        if used > bits:
            found = inside = durable(found.select("source", "size", "hash", "at", "rest", "before"))
            inside = found.select("source", "size", "hash")
        sums = found.groupBy("at", "rest", "before", F.shiftright("hash", BITS - used).alias("bucket")).agg(F.sum("size").alias("here"))
        order = Window.partitionBy("at", "rest", "before").orderBy("bucket")
        sums = sums.withColumn("upto", F.col("before") + F.sum("here").over(order)).where(F.col("upto") > F.col("rest"))
        state = durable(sums.groupBy("at", "rest").agg(F.min("bucket").alias("bucket"), F.min_by("upto", "bucket").alias("upto"), F.min_by("here", "bucket").alias("here")).select("at", "rest", "bucket", (F.col("upto") - F.col("here")).alias("before"), "here"))
    edge = state.select("at", (F.col("bucket") + (F.col("rest") - F.col("before") >= F.col("here") / 2).cast("long")).alias("edge"))
    # A source without a boundary has its whole rest taken: target = passes * size, rest 0.
    final = plan.join(edge, F.col("source").eqNullSafe(F.col("at")), "left").select(F.col("source").alias("of"), "source_size", "target", "passes", F.coalesce("edge", F.lit(0)).alias("edge"))
    return rows, durable(final)


def _copies(most: int, hash_: Column) -> Column:
    return (F.col("passes") + ((hash_ < F.col("edge")) & (F.col("passes") < most)).cast("int")).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies.

    ``copies``: how often the document is taken, at most ``most``; taken = size * copies. The
    last document goes in if at least half of it fits, so a source misses its target by at
    most half a document. Null text has size 0; null is a source like any other; rows with
    equal ids share a hash and so their fate. The words of a text of any length are all counted. Columns
    other than the id, the text and the source are not read. An empty table gives an empty result.
    """
    rows, plan = mixing_plan(docs, weights, share, most, seed, id_col, text_col, source_col)
    copies = _copies(most, F.col("hash"))
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"))


def take_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as ``mix`` takes it."""
    _, plan = mixing_plan(docs, weights, share, most, seed, id_col, text_col, source_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("__source"), id_hash(F.col(id_col), seed).alias("__hash"))
    out = rows.join(plan, F.col("__source").eqNullSafe(F.col("of"))).withColumn("copies", _copies(most, F.col("__hash"))).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
