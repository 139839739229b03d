"""Football concepts read from the driver's tables: matches, team rows, price quotes, provider calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each order. A least struct combines before the shuffle; a window would sort every line."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(order).alias("x")).select("l_orderkey", "x.*")


#: Stand-ins for what providers count in a match, as SQL over the order's first line. Most are unknown (null) for some matches.
STATS = {
    "home_fouls": "case when l_partkey % 8 = 0 then null else l_suppkey % 17 + 5 end",
    "away_fouls": "case when l_partkey % 9 = 0 then null else l_partkey % 14 + 6 end",
    "home_corners": "case when l_suppkey % 5 = 0 then null else l_partkey % 12 end",
    "away_corners": "case when l_partkey % 10 = 0 then null else l_suppkey % 11 end",
    "home_cards": "case when l_partkey % 4 = 3 then null else l_partkey % 5 end",
    "away_cards": "case when l_suppkey % 4 = 3 then null else l_suppkey % 3 end",
    "home_on_target": "case when l_partkey % 7 = 0 then null else l_partkey % 15 % 6 end",
    "away_on_target": "case when l_partkey % 6 = 0 then null else l_partkey % 11 % 5 end",
    "home_xg_actual": "case when l_partkey % 6 = 5 then null else l_partkey % 30 / cast(10 as double) end",
    "away_xg_actual": "case when l_suppkey % 7 = 3 then null else l_suppkey % 25 / cast(10 as double) end",
    "home_possession": "35 + l_partkey % 31",
    "away_possession": "65 - l_partkey % 31",
}


def matches(spark: SparkSession, sf_dir: str, clubs: bool = False, split: int = 0, stats: bool = False) -> DataFrame:
    """match_id, day, league, home, away, home_goals, away_goals, result, home_shots, away_shots (both may be null).

    Teams are nations, of which all meet; or clubs, numbered by customer (home) and supplier
    (away); or, with ``split``, so many teams of each nation. ``stats`` adds the columns of STATS.
    """
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    home = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("hk"), F.col("n_name").alias("home"), F.col("r_name").alias("league"))
    away = nation.select(F.col("n_nationkey").alias("ak"), F.col("n_name").alias("away"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("hk")).join(home, "hk")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("ak")).join(away, "ak")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    x = orders.join(first_lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    if clubs:
        x = x.withColumns({"home": F.concat(F.lit("club "), "c_custkey"), "away": F.concat(F.lit("club "), "s_suppkey")})
    if split:
        x = x.withColumns({"home": F.concat_ws(" ", "home", F.col("c_custkey") % split), "away": F.concat_ws(" ", "away", F.col("s_suppkey") % split)})
    x = x.where("home <> away")
    hg, ag = F.expr("cast(floor(l_quantity) as bigint) % 5"), F.expr("cast(floor(l_extendedprice) as bigint) % 4")
    more = [F.expr(e).alias(c) for c, e in STATS.items()] if stats else []
    x = x.select(F.col("o_orderkey").alias("match_id"), F.to_date("o_orderdate").alias("day"), "league", "home", "away", hg.alias("home_goals"), ag.alias("away_goals"), F.expr("case when l_partkey % 7 = 0 then null else l_partkey % 15 end").alias("home_shots"), F.expr("case when l_partkey % 6 = 0 then null else l_partkey % 11 end").alias("away_shots"), *more)
    return x.withColumn("result", F.expr("case when home_goals > away_goals then 'H' when home_goals < away_goals then 'A' else 'D' end"))


def team_matches(matches_: DataFrame, *stats: str) -> DataFrame:
    """Two rows of a match, one for each side: team, opponent, is_home, gf, ga, outcome W/D/L, shots and the side's ``stats``."""
    def side(own: str, other: str, home: bool):
        more = [F.col(f"{own}_{c}").alias(c) for c in stats]
        return F.struct(F.col(own).alias("team"), F.col(other).alias("opponent"), F.lit(home).alias("is_home"), F.col(f"{own}_goals").alias("gf"), F.col(f"{other}_goals").alias("ga"), F.col(f"{own}_shots").alias("shots"), *more)

    x = matches_.select("match_id", "day", "league", F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("s")).select("match_id", "day", "league", "s.*")
    return x.withColumn("outcome", F.expr("case when gf > ga then 'W' when gf < ga then 'L' else 'D' end"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price quotes of a match: bookmaker, captured, seq, and three prices of which some are not above 1."""
    x = table(spark, sf_dir, "lineitem")
    seq = "struct(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"
    return x.select(F.col("l_orderkey").alias("match_id"), F.col("l_returnflag").alias("bookmaker"), F.col("l_shipdate").alias("captured"), F.expr(seq).alias("seq"), F.expr("1.0D + l_quantity / 20.0D").alias("home_price"), F.expr("2.0D + l_discount * 20.0D").alias("draw_price"), F.expr("0.9D + l_tax * 50.0D").alias("away_price"))


def provider_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, provider, called_at, success, latency_ms (null for some), reason of a failure."""
    x = table(spark, sf_dir, "events")
    return x.select("event_id", F.col("event_type").alias("provider"), F.col("ts").alias("called_at"), F.expr("event_id % 9 <> 0").alias("success"), F.expr("case when event_id % 5 = 0 then null else value * 10.0D end").alias("latency_ms"), F.expr("case when event_id % 9 <> 0 then null when event_id % 27 = 0 then 'quota' when event_id % 18 = 0 then 'timeout' when event_id % 45 = 0 then 'server' else 'parse' end").alias("reason"))
