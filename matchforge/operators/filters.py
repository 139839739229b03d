"""Filter documents to columns, and a cascade of sources that asks each only for what is still missing."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A list longer than this is joined instead of written into the filter.
LONGEST_LIST = 200

OPERATORS = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
    "in": lambda c, v: c.isin(list(v)),
    "is": lambda c, v: c.isNull() if v is None else c.eqNullSafe(F.lit(v)),
}


def condition(document: dict[str, Any]) -> Column:
    """A filter document as one condition.

    ``{"or": [...]}``, ``{"and": [...]}`` and ``{"not": {...}}`` nest; a key that is a column
    holds operators, of which all must hold: ``{"day": {"gte": a, "lt": b}}``. ``not_`` before
    an operator negates it. As in SQL a comparison with null is unknown, so rows whose column
    is null pass neither ``in`` nor ``not_in``; ``is`` never is unknown. An empty ``or`` lets
    nothing pass, an empty ``and`` all.
    """
    out = F.lit(True)
    for name, what in document.items():
        if name in ("or", "and"):
            part = F.lit(name == "and")
            for d in what:
                part = part | condition(d) if name == "or" else part & condition(d)
        elif name == "not":
            part = ~condition(what)
        else:
            part = F.lit(True)
            for op, value in what.items():
                found = OPERATORS[op.removeprefix("not_")](F.col(name), value)
                part = part & (~found if op.startswith("not_") else found)
        out = out & part
    return out


def matching(rows: DataFrame, document: dict[str, Any]) -> DataFrame:
    """Rows that pass. Long lists at the top of the document become a semi join (``in``) or an anti join (``not_in``); the rest reaches the scan as a filter."""
    rest, joined = {}, []
    for name, what in document.items():
        if isinstance(what, dict) and name != "not":
            for op in ("in", "not_in"):
                if op in what and len(what[op]) > LONGEST_LIST:
                    joined.append((name, op, [v for v in what[op] if v is not None]))
                    what = {k: v for k, v in what.items() if k != op}
        rest[name] = what
    out = rows.where(condition(rest))
    for name, op, values in joined:
        kind = rows.schema[name].dataType
        listed = rows.sparkSession.createDataFrame([(v,) for v in values], f"listed {kind.simpleString()}").distinct()
        out = out.join(F.broadcast(listed), F.col(name) == F.col("listed"), "left_semi" if op == "in" else "left_anti")
        if op == "not_in":
            out = out.where(F.col(name).isNotNull())
    return out


def page(rows: DataFrame, order: list[tuple[str, bool]], size: int, after: dict[str, Any] | None = None) -> DataFrame:
    """The next ``size`` rows in ``order`` ((column, descending) pairs whose values are never null and together unique) behind the row ``after``.

    The place is a condition on the columns, so a late page reads no more than the first, and
    Spark takes each task's first rows before any meet.
    """
    behind = F.lit(False)
    if after is not None:
        for name, down in reversed(order):
            c, v = F.col(name), after[name]
            behind = (c < v if down else c > v) | ((c == v) & behind)
        rows = rows.where(behind)
    return rows.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in order)).limit(size)


def first_that_covers(sources: list[tuple[str, DataFrame]], wanted: DataFrame, key: str) -> DataFrame:
    """Rows of the first source that has any for a key, for each wanted key, with the source's name.

    What a source lacks is found out by a run over its keys, and the next is asked for that only: a
    short list of keys is a filter that reaches its scan, a long one a semi join. Without gaps
    later sources are not read. ``wanted`` has the column ``key``; null is no key.
    """
    missing = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    out = None
    for number, (name, rows) in enumerate(sources):
        listed = [r[0] for r in missing.limit(LONGEST_LIST + 1).collect()]
        if not listed:
            break
        asked = rows.where(F.col(key).isin(listed)) if len(listed) <= LONGEST_LIST else rows.join(missing, key, "left_semi")
        found = asked.withColumn("source", F.lit(name))
        out = found if out is None else out.unionByName(found)
        if number + 1 < len(sources):
            missing = missing.join(asked.select(key).distinct(), key, "left_anti")
            if len(listed) <= LONGEST_LIST:
                kind = missing.schema
                missing = rows.sparkSession.createDataFrame(missing.collect(), kind)
    return sources[0][1].withColumn("source", F.lit(None).cast("string")).where("false") if out is None else out
