"""One match from many sources: groups of rows that evidence ties together, unless facts forbid it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b): ids that links connect, however indirectly, have the least of them as root.

    Each round an id with a lesser neighbour goes to the least of them, and on to where that one
    goes. Links between ids that went to one place are gone, the others link these places, so a
    round has only what is still apart, and groups that are whole cost nothing more. At the end
    the rounds' moves are followed from the last to the first.
    """
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    left = checkpointed(_ordered(links))
    rounds = []
    while left.take(1):
        moves = _followed(left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root")))
        rounds.append(moves)
        at = lambda c: moves.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        moved = left.join(at("a"), "a", "left").join(at("b"), "b").select(F.coalesce("a_root", "a").alias("a"), F.col("b_root").alias("b"))
        left = checkpointed(_ordered(moved))
    if not rounds:
        return ids.select("id", F.col("id").alias("root"))
    roots = rounds.pop()
    while rounds:
        last = roots.select(F.col("id").alias("root"), F.col("root").alias("end"))
        earlier = rounds.pop().join(last, "root", "left").select("id", F.coalesce("end", "root").alias("root"))
        # Ids of a later round that moved there for the first time.
        roots = checkpointed(earlier.unionByName(roots))
    return ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links of two ids, the lesser first."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _followed(moves: DataFrame) -> DataFrame:
    """(id, root) with each move followed to its end; the way left halves each time."""
    now = checkpointed(moves)
    while True:
        onward = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = checkpointed(now.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not after.where("moved").take(1):
            return now
        now = after.drop("moved")


def _stars(rows: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """(a, b): each row and the least id that shares a piece of evidence with it. A null in a key makes it no evidence."""
    out = None
    for cols in kinds.values():
        keys = [f"key_{k}" for k in range(len(cols))]
        x = rows.where(_known(cols)).select("id", *(F.col(c).alias(k) for c, k in zip(cols, keys, strict=True)))
        hubs = x.groupBy(*keys).agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
        x = x.join(hubs, keys).where("id <> a").select("a", F.col("id").alias("b"))
        out = x if out is None else out.unionByName(x)
    return out


def _known(cols: list[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def groups(rows: DataFrame, kinds: dict[str, list[str]], facts: list[str]) -> DataFrame:
    """(id, root, evidence, refused): the groups of rows with a column ``id``, of which no two facts contradict.

    ``kinds``: columns that must be equal, by kind of evidence, the strongest first. All kinds
    tie rows at first. Where a group has two values of a fact, its weakest kind falls and its
    rows are grouped again by the others; where the strongest alone still contradicts, the
    merge is refused and each row stands for itself. ``evidence`` is the number of kinds that
    the group stands on, 0 for a refused one.
    """
    rows = checkpointed(rows.where("id is not null").dropDuplicates(["id"]).select("id", *sorted({c for cols in kinds.values() for c in cols}), *(F.col(c).cast("string").alias(f"fact_{c}") for c in facts)))
    names, left, done = list(kinds), rows, []
    for n in range(len(names), 0, -1):
        stars = _stars(left, {k: kinds[k] for k in names[:n]})
        # Stars of one kind share no row: their hubs are the roots.
        roots = components(stars) if n > 1 else stars.select(F.col("b").alias("id"), F.col("a").alias("root"))
        grouped = left.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        torn = grouped.groupBy("root").agg(*((F.min(f"fact_{c}") != F.max(f"fact_{c}")).alias(c) for c in facts))
        torn = torn.select("root", F.coalesce(F.greatest(*(F.coalesce(F.col(c), F.lit(False)) for c in facts), F.lit(False)), F.lit(False)).alias("torn"))
        judged = checkpointed(grouped.join(torn, "root"))
        done.append(judged.where("not torn").select("id", "root", F.lit(n).alias("evidence"), F.lit(False).alias("refused")))
        left = judged.where("torn").drop("root", "torn")
    done.append(left.select("id", F.col("id").alias("root"), F.lit(0).alias("evidence"), F.lit(True).alias("refused")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def reconciled(rows: DataFrame, grouped: DataFrame, rank: str, observed: list[str]) -> DataFrame:
    """root, rows, canonical, superseded, gaps, refused of each group: the row of least (rank, id) stands, and keeps its own values.

    ``gaps`` lists the observed columns that the canonical row lacks and another one has, in
    their order. A row without a rank comes from an unknown source: its group has no canonical
    row. Lists hold a group's ids, not its rows.
    """
    x = rows.dropDuplicates(["id"]).join(grouped, "id")
    order = F.struct(F.coalesce(F.col(rank), F.lit(1 << 30)), F.col("id"))
    flags = [F.min_by(F.col(c).isNotNull(), order).alias(f"own_{c}") for c in observed] + [F.max(F.col(c).isNotNull()).alias(f"any_{c}") for c in observed]
    y = x.groupBy("root").agg(F.count("*").alias("rows"), F.min_by("id", order).alias("first"), F.max(F.col(rank).isNull()).alias("unknown"), F.array_sort(F.collect_list("id")).alias("ids"), F.max("refused").alias("refused"), *flags)
    gaps = F.filter(F.array(*(F.when(F.col(f"any_{c}") & ~F.col(f"own_{c}"), F.lit(c)) for c in observed)), lambda c: c.isNotNull())
    named = ~F.col("unknown")
    return y.select("root", "rows", F.when(named, F.col("first")).alias("canonical"), F.when(named, F.array_remove("ids", F.col("first"))).alias("superseded"), F.when(named, gaps).alias("gaps"), "refused")
