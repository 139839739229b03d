"""Registered queries of the football operators. Each rounds its doubles to six places as the last step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import evaluate, features, health, merge, pricing
from ..sources import bridge

ALIASES = {"united states": "usa", "united kingdom": "gbr"}
GRID = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)


def places(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*(F.round(c, n).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def _matches(spark, sf_dir):
    return bridge.matches(spark, sf_dir)


def _teams(spark, sf_dir):
    return bridge.team_matches(_matches(spark, sf_dir))


def _predicted(spark, sf_dir):
    return pricing.predicted(_matches(spark, sf_dir))


def _closing(spark, sf_dir):
    # Dealt by match, as the predictions are: one shuffle of the lines instead of a sort before it and a second shuffle for the join.
    x = merge.open_and_close(bridge.quotes(spark, sf_dir).repartition("match_id"))
    return x.select("match_id", "bookmaker", *(F.col(f"close_{p}").alias(p) for p in merge.PRICES))


def league_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(evaluate.report(_predicted(spark, sf_dir)))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(_matches(spark, sf_dir))


def team_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(features.form(_teams(spark, sf_dir)))


def team_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(features.rolling_shots(_teams(spark, sf_dir)))


def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(features.head_to_head(_matches(spark, sf_dir)))


def rest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(features.rest_days(_teams(spark, sf_dir)))


def final_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(features.standings(_teams(spark, sf_dir)))


def standings_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(features.standings_as_of(_teams(spark, sf_dir)))


def elo_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(features.elo(_matches(spark, sf_dir)))


def latest_elo(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir)
    return features.latest_elo(m, features.elo(m))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(_predicted(spark, sf_dir))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(evaluate.calibration(_predicted(spark, sf_dir)))


def temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(evaluate.temperatures(_predicted(spark, sf_dir), GRID))


def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _predicted(spark, sf_dir).withColumn("flat", F.lit(1.0) / 3)
    return places(pricing.blend(x, ("flat", "flat", "flat"), F.col("match_id") % 200).select("match_id", "b_home", "b_draw", "b_away"), 4)


def open_and_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(merge.open_and_close(bridge.quotes(spark, sf_dir)))


def best_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(merge.best_prices(bridge.quotes(spark, sf_dir)))


def value_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.value_bets(_predicted(spark, sf_dir), _closing(spark, sf_dir)).select("match_id", "bookmaker", "selection", F.round("price", 4).alias("price"), "edge", "rating", "stake")


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(pricing.settle(pricing.value_bets(_predicted(spark, sf_dir), _closing(spark, sf_dir))), 4)


def source_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bridge.table(spark, sf_dir, "lineitem").withColumn("value", F.expr("case when l_partkey % 4 = 0 then null else l_quantity end"))
    return merge.by_source_rank(x, "l_orderkey", "l_returnflag", {"R": 1, "A": 2, "N": 3}, ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "value")


def fill_missing_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir)
    other = m.select("match_id", F.expr("home_goals + 5").alias("home_shots"), F.expr("case when match_id % 2 = 0 then away_goals + 3 end").alias("away_shots"))
    return places(merge.fill_nulls(m.select("match_id", "home_shots", "away_shots"), other, "match_id", ["home_shots", "away_shots"]))


def natural_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(merge.first_of_key(_matches(spark, sf_dir).select("home", "away", "league", "day", "match_id", "home_goals", "away_goals"), ["home", "away", "league", "day"], ["match_id"]))


def equivalence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir).select("match_id", "league", "home_goals", "away_shots")
    stored = m.select(F.expr("case when match_id % 11 = 0 then -match_id else match_id end").alias("match_id"), "league", F.expr("case when match_id % 7 = 0 then home_goals + 1 else home_goals end").alias("home_goals"), F.expr("case when match_id % 5 = 0 then null else away_shots end").alias("away_shots"))
    return places(merge.diff(m, stored, ["match_id"], ["league", "home_goals", "away_shots"]))


def audited_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir)
    left = m.select("match_id", "day", "home", "away", "home_goals")
    # Every match is on both sides; the right one has some on another day and some with another score.
    right = m.select(F.expr("case when match_id % 4 = 3 then date_add(day, 100000) else day end").alias("day"), "home", "away", F.expr("case when match_id % 13 = 0 then home_goals + 1 else home_goals end").alias("home_goals"))
    return merge.audited_join(left, right, ["day", "home", "away"], "match_id", ["home_goals"]).groupBy("outcome").agg(F.count("*").alias("n"))


def alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(merge.alias_candidates(bridge.matches(spark, sf_dir, split=7)))


def club_alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(merge.alias_candidates(bridge.matches(spark, sf_dir, clubs=True)))


def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(merge.conflicts(_matches(spark, sf_dir), ["home", "away", "day"], ["home_goals", "away_goals", "home_shots"]))


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"no_price": F.expr("home_price is not null"), "price_not_above_1": merge.valid_prices(), "late": F.expr("captured < timestamp '2023-01-01'")}
    q = bridge.quotes(spark, sf_dir)
    return merge.validate(q, rules, ["match_id", "bookmaker"], ["captured", "seq"])


def key_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir)
    renamed = lambda n: m.select(F.expr(f"case when match_id % {n} = 0 then -match_id else match_id end").alias("match_id"))
    return merge.drift(renamed(5), renamed(7), ["match_id"])


def provider_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(health.windows(bridge.provider_calls(spark, sf_dir)))


def provider_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.error_breakdown(bridge.provider_calls(spark, sf_dir))


def provider_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(health.rolled_up(health.daily(bridge.provider_calls(spark, sf_dir))))


def provider_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(health.scores(health.windows(bridge.provider_calls(spark, sf_dir), (168,))))


def provider_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(health.burn_down(health.windows(bridge.provider_calls(spark, sf_dir)), 1000))


def divergence_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _predicted(spark, sf_dir).withColumn("gap", F.round(F.col("home_xg") - F.col("away_xg"), 4))
    return places(evaluate.spread(x, "league", "gap", 0.5))


def degraded_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _matches(spark, sf_dir)
    return evaluate.leading_run(x, "home", [F.desc("day"), F.desc("match_id")], F.col("result") != "A")


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _matches(spark, sf_dir).withColumn("goals", (F.col("home_goals") + F.col("away_goals")).cast("double"))
    return places(evaluate.trend(x, "home", [F.col("day"), F.col("match_id")], "goals"))


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(evaluate.walk_forward(_matches(spark, sf_dir), ["match_id"]).groupBy("segment").agg(F.count("*").alias("n"), F.min("day").alias("since"), F.max("day").alias("until")))


def keys_and_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir)
    key = text.match_key(F.col("home"), F.col("away"), F.col("day"))
    y = features.season(F.col("day"))
    return places(m.select("match_id", key.alias("match_key"), text.fixture_id("hist", key).alias("fixture"), y.alias("season"), F.concat_ws("-", y, y + 1).alias("season_label"), text.alias_of(F.col("home"), ALIASES).alias("home_name")))


def parsed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bridge.table(spark, sf_dir, "part")
    raw = x.select("p_partkey", F.concat(F.col("p_size"), F.lit("/50 ("), F.col("p_size") * 2, F.lit("%)")).alias("composite"), F.concat(F.col("p_size"), F.lit("% ")).alias("share"), F.concat(F.lit("7 "), F.col("p_size"), F.lit("'")).alias("spaced"), F.col("p_name").alias("label"))
    return places(raw.select("p_partkey", text.leading_number(F.col("composite")).alias("leading"), text.percent(F.col("share")).alias("share"), text.digits(F.col("spaced")).alias("digits"), text.slug(F.col("label")).alias("slug")))


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bridge.table(spark, sf_dir, "pages")
    title = F.nullif(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit(""))
    return places(p.select("page_id", title.alias("title"), F.regexp_count("html", F.lit("<a ")).alias("links"), F.regexp_count("html", F.lit("<li")).alias("items")))


QUERIES = (league_report, matches, team_form, team_shots, head_to_head, rest_days, final_standings, standings_as_of, elo_replay, latest_elo, predictions, calibration, temperature, blended, open_and_close, best_prices, value_bets, portfolio, source_rank, fill_missing_shots, natural_key_dedupe, equivalence_diff, audited_backfill, alias_candidates, club_alias_candidates, identity_conflicts, validation, key_drift, provider_windows, provider_errors, provider_rollup, provider_choice, provider_quota, divergence_spread, degraded_run, trend, walk_forward, keys_and_seasons, parsed_statistics, latest_per_key, page_titles)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
