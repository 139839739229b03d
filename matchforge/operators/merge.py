"""Merges and reconciliation: write-once and latest prices, source ranks, diffs, audits, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("home_price", "draw_price", "away_price")


def valid_prices() -> Column:
    return (F.col("home_price") > 1) & (F.col("draw_price") > 1) & (F.col("away_price") > 1)


def open_and_close(quotes: DataFrame) -> DataFrame:
    """match_id, bookmaker, opening and closing prices: the first and the last complete quote. One pass, combined before the shuffle."""
    at = F.struct("captured", "seq")
    quote = F.struct(*PRICES)
    x = quotes.where(valid_prices()).groupBy("match_id", "bookmaker").agg(F.min_by(quote, at).alias("o"), F.max_by(quote, at).alias("c"), F.count("*").alias("n_quotes"))
    return x.select("match_id", "bookmaker", "n_quotes", *(F.col(f"{k}.{p}").alias(f"{v}_{p}") for k, v in (("o", "open"), ("c", "close")) for p in PRICES))


def best_prices(quotes: DataFrame) -> DataFrame:
    """match_id and the best price of each outcome, of whichever bookmaker; the name is the best home price's."""
    name = F.max_by("bookmaker", F.struct("home_price", (-F.ascii("bookmaker")).alias("first")))
    return quotes.where(valid_prices()).groupBy("match_id").agg(*(F.max(p).alias(p) for p in PRICES), name.alias("bookmaker"))


def by_source_rank(rows: DataFrame, key: str, source: str, rank: dict[str, int], arrival: list[str], value: str) -> DataFrame:
    """key, value, source of the best ranked source. Of equal ranks the first to arrive stays; null values take no part."""
    number = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), F.col(source)), F.lit(99))
    order = F.struct(number.alias("rank"), *arrival)
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(F.struct(value, source), order).alias("x")).select(key, "x.*")


def fill_nulls(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``target`` with null columns filled from the source's row of the same key; nothing known is overwritten."""
    s = source.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in columns))
    x = target.join(s, F.col(key) == F.col("__key"), "left")
    return x.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop("__key", *(f"__{c}" for c in columns))


def backfill(stored: DataFrame, computed: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Stored rows whose nulls, and nothing else, are filled from what was computed anew; ``filled`` names the columns, ``status`` is filled, complete or incomplete."""
    x = stored.select(key, *cols).join(computed.select(F.col(key).alias("k_"), *(F.col(c).alias(f"new_{c}") for c in cols)), F.col(key) == F.col("k_"), "left")
    gained = [F.when(F.col(c).isNull() & F.col(f"new_{c}").isNotNull(), F.lit(c)) for c in cols]
    left = [F.coalesce(c, f"new_{c}").isNull() for c in cols]
    x = x.withColumns({"filled": F.array_join(F.filter(F.array(*gained), lambda c: c.isNotNull()), ","), "open_": F.exists(F.array(*left), lambda c: c)})
    status = F.when(F.col("open_"), "incomplete").when(F.col("filled") != "", "filled").otherwise("complete")
    return x.select(key, *(F.coalesce(c, f"new_{c}").alias(c) for c in cols), "filled", status.alias("status"))


def first_of_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in this order; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def diff(live: DataFrame, stored: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """status, field, n: rows matched, missing on either side, and for each field how many matched rows differ."""
    a = live.select(*key, F.lit(True).alias("in_live"), *(F.col(f).alias(f"l_{f}") for f in fields))
    b = stored.select(*key, F.lit(True).alias("in_stored"), *(F.col(f).alias(f"s_{f}") for f in fields))
    x = a.join(b, key, "full")
    status = F.when(F.col("in_live").isNull(), "only_stored").when(F.col("in_stored").isNull(), "only_live").otherwise("matched")
    differs = [F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"s_{f}")) & F.col("in_live") & F.col("in_stored"), F.lit(f)) for f in fields]
    x = x.select(status.alias("status"), F.filter(F.array(F.lit("*"), *differs), lambda f: f.isNotNull()).alias("fields"))
    return x.select("status", F.explode("fields").alias("field")).groupBy("status", "field").agg(F.count("*").alias("n"))


def audited_join(left: DataFrame, right: DataFrame, key: list[str], left_id: str, check: list[str]) -> DataFrame:
    """left_id, outcome: no_match, ambiguous, mismatch (``check`` columns differ) or filled. Right keys are counted first, so a hot key does not multiply rows."""
    first = F.min(F.struct(*check))
    r = right.groupBy(*key).agg(F.count("*").alias("__n"), first.alias("__x"))
    x = left.join(r, key, "left")
    same = F.lit(True)
    for c in check:
        same &= F.col(c).eqNullSafe(F.col(f"__x.{c}"))
    return x.select(left_id, F.when(F.col("__n").isNull(), "no_match").when(F.col("__n") > 1, "ambiguous").when(~same, "mismatch").otherwise("filled").alias("outcome"))


def alias_candidates(matches: DataFrame) -> DataFrame:
    """one, two, evidence: names that met the same opponent on one day with one score, and never each other.

    Names of a bucket (day, league, opponent, score) are gathered as a set, so copies of a row
    cost nothing; pairs are built within the few names of a bucket.
    """
    sides = matches.select("day", "league", F.explode(F.array(F.struct(F.lit("h").alias("side"), F.col("home").alias("name"), F.col("away").alias("other")), F.struct(F.lit("a").alias("side"), F.col("away").alias("name"), F.col("home").alias("other")))).alias("x"), "home_goals", "away_goals").select("day", "league", "x.*", "home_goals", "away_goals")
    names = sides.groupBy("day", "league", "side", "other", "home_goals", "away_goals").agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") > 1)
    pairs = names.select(F.explode("names").alias("one"), "names").select("one", F.explode("names").alias("two")).where("one < two").groupBy("one", "two").agg(F.count("*").alias("evidence"))
    met = matches.select(F.least("home", "away").alias("one"), F.greatest("home", "away").alias("two")).distinct()
    return pairs.join(met, ["one", "two"], "left_anti")


def conflicts(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """key, copies, n_conflicts: keys with several rows, and the fields on which known values disagree. Rows are marked, not merged."""
    differ = [(F.min(f) != F.max(f)).cast("int").alias(f"__{f}") for f in fields]
    x = rows.groupBy(*key).agg(F.count("*").alias("copies"), *differ).where("copies > 1")
    return x.select(*key, "copies", sum((F.coalesce(F.col(f"__{f}"), F.lit(0)) for f in fields), F.lit(0)).alias("n_conflicts"))


def validate(rows: DataFrame, rules: dict[str, Column], key: list[str], order: list[str]) -> DataFrame:
    """reason, n: each row's first broken rule, ``duplicate`` for valid rows after a key's first, or ``valid``."""
    reason = F.coalesce(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))
    x = rows.withColumn("reason", reason)
    place = F.row_number().over(Window.partitionBy(*key, F.col("reason").isNull()).orderBy(*order))
    return x.withColumn("reason", F.coalesce("reason", F.when(place > 1, "duplicate").otherwise("valid"))).groupBy("reason").agg(F.count("*").alias("n"))


def drift(before: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """status (new, resolved), n of keys on one side only."""
    b, n = before.select(*key).distinct(), now.select(*key).distinct()
    new = n.join(b, key, "left_anti").select(F.lit("new").alias("status"))
    gone = b.join(n, key, "left_anti").select(F.lit("resolved").alias("status"))
    return new.unionAll(gone).groupBy("status").agg(F.count("*").alias("n"))
