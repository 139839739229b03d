"""Registered queries of profiles, engine comparison and small rules, with their SQL written apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import features, health, pricing, profiles
from ..sources import bridge
from ..streaming.health import windowed_health
from . import oracle
from .queries import _matches, _predicted, _teams, places

STATS = ("fouls", "corners", "cards", "on_target", "xg_actual", "possession")


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.team_matches(bridge.matches(spark, sf_dir, stats=True), *STATS)


def team_discipline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(features.rolling_known(_sides(spark, sf_dir), ["fouls", "corners", "cards"]))


def dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home less away of the rolling corners, cards, fouls and shots; null where either is unknown."""
    m = bridge.matches(spark, sf_dir, stats=True)
    names = ["corners", "cards", "fouls", "shots"]
    known = features.rolling_known(bridge.team_matches(m, *STATS), names)
    side = lambda s: known.select("match_id", F.col("team").alias(s), *(F.col(f"avg_{c}").alias(f"{s}_{c}") for c in names))
    x = m.select("match_id", "home", "away").join(side("home"), ["match_id", "home"]).join(side("away"), ["match_id", "away"])
    return places(x.select("match_id", *((F.col(f"home_{c}") - F.col(f"away_{c}")).alias(f"{c}_dominance") for c in names)))


def team_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' ratings before each match from form, shots on target and ELO."""
    m = bridge.matches(spark, sf_dir, stats=True)
    sides = bridge.team_matches(m, *STATS)
    e = features.elo(m)
    before = m.select("match_id", "home", "away").join(e, "match_id").select("match_id", F.explode(F.array(*(F.struct(F.col(s).alias("team"), F.col(f"{s}_elo").alias("elo")) for s in ("home", "away")))).alias("x")).select("match_id", "x.*")
    x = features.form(sides).join(features.rolling_known(sides, ["on_target"]), ["match_id", "team"]).join(before, ["match_id", "team"])
    attack, defence = pricing.full_rating(F.col("avg_for"), F.col("avg_against"), F.col("avg_on_target"), F.col("elo"))
    return places(x.select("match_id", "team", "elo", "form_score", attack.alias("attack"), defence.alias("defence")), 4)


def missing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{s}_{c}" for s in ("home", "away") for c in ("fouls", "corners", "cards", "xg_actual")]
    x = bridge.matches(spark, sf_dir, stats=True).select("match_id", profiles.missing_columns(names).alias("missing"))
    return places(x.select("match_id", F.array_join("missing", ",").alias("missing"), F.size("missing").alias("n_missing")))


def missing_by_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by league: all, with both shot counts, with one missing, from the last season on."""
    m = _matches(spark, sf_dir)
    known = F.col("home_shots").isNotNull() & F.col("away_shots").isNotNull()
    last = m.agg(text.season_start(F.max("day")).alias("since"))  # one row
    return m.join(F.broadcast(last)).groupBy("league").agg(F.count("*").alias("n"), F.count_if(known).alias("complete"), F.count_if(~known).alias("incomplete"), F.count_if(F.col("day") >= F.col("since")).alias("this_season"))


def recency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights as of the table's last day."""
    m = _matches(spark, sf_dir)
    x = m.join(F.broadcast(m.agg(F.max("day").alias("today"))))  # one row
    return places(x.select("match_id", profiles.recency_weight(F.col("day"), F.col("today")).alias("weight")))


def recent_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(features.recent(_teams(spark, sf_dir), ["team", "league"], 5, 365).select("team", "league", "place", "match_id", "gf", "ga", "outcome"))


def recent_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(features.recent(_teams(spark, sf_dir).where("shots is not null"), ["team", "league"], 5).select("team", "league", "place", "match_id", "shots"))


def form_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = features.recent(_teams(spark, sf_dir), ["team"], 10).groupBy("team").agg(F.collect_list("outcome").alias("outcomes"))
    return x.select("team", profiles.form_record(F.col("outcomes")).alias("record"))


def team_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(profiles.team_dna(features.recent(_sides(spark, sf_dir), ["team"], 10)))


def league_finishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(_sides(spark, sf_dir).groupBy("league").agg(*profiles.finishing()))


def stat_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(profiles.stat_means(_sides(spark, sf_dir), ["team"], list(STATS)))


def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = features.form(_teams(spark, sf_dir))
    source = F.expr("case match_id % 4 when 0 then 'elo-only' when 1 then '' else 'history' end")
    return x.select("match_id", "team", profiles.data_quality(source, F.col("n_form")).alias("quality"))


def _engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predicted(spark, sf_dir)
    own = [F.col(c) for c in ("p_home", "p_draw", "p_away")]
    flat, third = F.lit(1.0) / 3, F.col("match_id") % 3
    bold = [(F.col(c) * F.col(c)) for c in ("p_home", "p_draw", "p_away")]
    total = bold[0] + bold[1] + bold[2]
    return profiles.engine_rows(p, {"rules": (F.lit(True), *own), "bold": (third > 0, *(b / total for b in bold)), "flat": ((third == 2) | (F.col("match_id") % 6 == 0), flat, flat, flat)}, ["match_id", "league", "result"])


def engine_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.evaluate import metrics

    return places(_engines(spark, sf_dir).groupBy("engine").agg(*metrics()))


def combined_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("engine") == "rules", 2.0).when(F.col("engine") == "bold", 0.5).otherwise(1.0)
    return places(profiles.combined(_engines(spark, sf_dir), "match_id", weight))


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(profiles.consensus(_engines(spark, sf_dir), "match_id"))


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(profiles.reliability(_predicted(spark, sf_dir)))


def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(profiles.calibration_error(profiles.reliability(_predicted(spark, sf_dir))))


def xg_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predicted(spark, sf_dir).select("match_id", "home_xg", "away_xg")
    x = bridge.matches(spark, sf_dir, stats=True).join(p, "match_id")
    sides = x.select("league", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_xg").alias("predicted"), F.col(f"{s}_xg_actual").alias("actual")) for s in ("home", "away")))).alias("x")).select("league", "x.*")
    return places(profiles.side_errors(sides, 50))


def live_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live metrics by league; in Europe every second match is called as good as certain."""
    sure = (F.col("league") == "EUROPE") & (F.col("match_id") % 2 == 0)
    x = _predicted(spark, sf_dir).withColumns({c: F.when(sure, p).otherwise(F.col(c)) for c, p in (("p_home", 0.96), ("p_draw", 0.02), ("p_away", 0.02))})
    return places(profiles.live_health(x, ["league"], 0.6))


def kept_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _matches(spark, sf_dir).select(F.when(F.col("match_id") % 50 != 0, features.season(F.col("day"))).alias("season"))
    return places(profiles.kept_seasons(x, 3))


def dominant_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = bridge.provider_calls(spark, sf_dir).where("not success")
    days = calls.groupBy("provider", F.to_date("called_at").alias("day"), "reason").agg(F.count("*").alias("n")).groupBy("provider", "day").agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("causes"))
    return profiles.dominant_cause(days, "provider", "causes")


def latest_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each provider's last call and last success, and the best quota left among its three keys in per cent."""
    x = bridge.provider_calls(spark, sf_dir).withColumn("key", F.col("event_id") % 3)
    used = x.groupBy("provider", "key").agg(F.max("called_at").alias("last"), F.max(F.when(F.col("success"), F.col("called_at"))).alias("ok"), (F.count("*") / 20.0).alias("pct"))
    return places(used.groupBy("provider").agg(F.max("last").alias("last_call"), F.max("ok").alias("last_success"), F.max(100.0 - F.col("pct")).alias("quota_left")))


def shadow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which the best provider of the day would replace the standing one, and whether it did better."""
    d = health.daily(bridge.provider_calls(spark, sf_dir)).withColumn("rate", 1 - F.col("errors") / F.col("calls"))
    best = d.groupBy("day").agg(F.max_by("provider", F.struct(F.round("rate", 9).alias("r"), "provider")).alias("recommended"), F.max("rate").alias("best"), F.max(F.when(F.col("provider") == "click", F.col("rate"))).alias("own"), F.count("*").alias("n"))
    named = F.when(F.col("n") > 3, F.col("recommended"))
    changed = F.coalesce(named != "click", F.lit(False))
    return best.agg(F.count("*").alias("total"), F.count_if(~changed & named.isNotNull()).alias("identical"), F.count_if(changed).alias("different"), F.count_if(named.isNull()).alias("unavailable"), F.count_if(changed & (F.col("best") > F.col("own"))).alias("better"))


def provider_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(windowed_health(bridge.provider_calls(spark, sf_dir)))


#: What a page may have, and how it is seen.
PARTS = {"items": "<li", "english": 'lang="en"', "marks": "%%%", "company": ".com &middot;", "ended": "</html>"}


def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bridge.table(spark, sf_dir, "pages")
    return p.select("page_id", *profiles.coverage({k: F.col("html").contains(v) for k, v in PARTS.items()}))


def absence_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bridge.table(spark, sf_dir, "customer")
    position = F.element_at(F.array(*map(F.lit, ("GK", "def", "MID", "fwd", "?"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return places(c.select("c_custkey", profiles.absence_impact(F.greatest(F.floor(F.col("c_acctbal") * 10_000), F.lit(0)), position, (F.col("c_custkey") % 4 + 1) / 4.0).alias("impact")), 4)


def running_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import _closing

    p = _predicted(spark, sf_dir)
    bets = pricing.value_bets(p.withColumn("result", F.when(F.col("match_id") % 20 != 0, F.col("result"))), _closing(spark, sf_dir)).join(p.select("match_id", "day"), "match_id")
    return places(profiles.cumulative_profit(bets, "bookmaker", "day"))


def lenient_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bridge.table(spark, sf_dir, "part")
    raw = F.expr("case p_partkey % 5 when 0 then concat(' ', p_size, '.7 ') when 1 then 'NaN' when 2 then concat(p_size, 'x') when 3 then null else cast(-p_size as string) end")
    return places(x.select("p_partkey", text.whole_number(raw).alias("number"), text.plain_text(raw).alias("text")))


def season_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("match_id", text.season_start(F.col("day")).alias("since"), text.season_start(F.col("day"), 5).alias("cutoff"))


def fixture_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.element_at(F.array(*map(F.lit, [*text.SOURCES, "other_"])), (F.col("match_id") % 8 + 1).cast("int"))
    x = _matches(spark, sf_dir).select(text.source_of(F.concat(prefix, F.col("match_id").cast("string"))).alias("source"))
    return x.groupBy("source").agg(F.count("*").alias("n"))


def parsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bridge.table(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_name", F.element_at(F.array(*map(F.lit, ("Winger", "Attacking midfielder", "Keeper"))), (F.col("p_partkey") % 3 + 1).cast("int")))
    both = x.select("p_partkey", text.name_and_position(name).alias("x"), text.incident_minute(F.concat("p_size", F.lit("+6'"))).alias("minute"), text.without_note(F.concat(F.col("p_brand"), F.lit(text.NOTE), F.lit(": x"))).alias("team"))
    return places(both.select("p_partkey", F.col("x.name").alias("name"), F.col("x.position").alias("position"), "minute", "team"))


QUERIES = (team_discipline, dominance, team_ratings, missing_features, missing_by_league, recency_weights, recent_results, recent_shots, form_records, team_dna, league_finishing, stat_means, data_quality, engine_metrics, combined_engines, consensus, reliability, calibration_error, xg_errors, live_health, kept_seasons, dominant_cause, latest_calls, shadow_counts, provider_hours, page_coverage, absence_impacts, running_profit, lenient_values, season_dates, fixture_sources, parsed_labels)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


SIDES = "sm AS (SELECT m.*, " + ", ".join(f"{e} AS {c}" for c, e in bridge.STATS.items()) + " FROM m JOIN fl ON l_orderkey = match_id),\nsd AS (" + " UNION ALL ".join(
    f"SELECT match_id, day, league, {own} AS team, {own}_goals AS gf, {other}_goals AS ga, {own}_shots AS shots, " + ", ".join(f"CAST({own}_{c} AS DOUBLE) AS {c}" for c in STATS) + " FROM sm"
    for own, other in (("home", "away"), ("away", "home"))
) + ")"
KNOWN = """
kv AS (SELECT match_id, team, day, stat, value FROM (SELECT match_id, team, day, unnest([struct_pack(stat := 'fouls', value := fouls), struct_pack(stat := 'corners', value := corners), struct_pack(stat := 'cards', value := cards), struct_pack(stat := 'shots', value := CAST(shots AS DOUBLE)), struct_pack(stat := 'on_target', value := on_target)], recursive := true) FROM sd)),
ko AS (SELECT *, row_number() OVER (PARTITION BY team, stat ORDER BY day, match_id) AS k FROM kv), kn AS (SELECT *, row_number() OVER (PARTITION BY team, stat ORDER BY k) AS j FROM ko WHERE value IS NOT NULL),
kc AS (SELECT match_id, team, stat, count(value) OVER (PARTITION BY team, stat ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM ko),
ka AS (SELECT kc.match_id, kc.team, kc.stat, avg(kn.value) AS v FROM kc LEFT JOIN kn ON kn.team = kc.team AND kn.stat = kc.stat AND kn.j BETWEEN kc.n - 9 AND kc.n GROUP BY 1, 2, 3)
"""
FINISHING = """round(sum(CASE WHEN xg_actual IS NOT NULL THEN gf END) / nullif(sum(xg_actual), 0), 6) AS goals_per_xg, count(xg_actual) AS goals_per_xg_n,
    round(sum(CASE WHEN on_target IS NOT NULL THEN gf END) / nullif(sum(on_target), 0), 6) AS goals_per_shot, round(avg(corners), 6) AS avg_corners"""
ENGINES = """
en AS (SELECT match_id, league, result, 'rules' AS engine, p_home, p_draw, p_away FROM p
  UNION ALL SELECT match_id, league, result, 'bold', p_home * p_home / (p_home * p_home + p_draw * p_draw + p_away * p_away), p_draw * p_draw / (p_home * p_home + p_draw * p_draw + p_away * p_away), p_away * p_away / (p_home * p_home + p_draw * p_draw + p_away * p_away) FROM p WHERE match_id % 3 > 0
  UNION ALL SELECT match_id, league, result, 'flat', 1.0::DOUBLE / 3, 1.0::DOUBLE / 3, 1.0::DOUBLE / 3 FROM p WHERE match_id % 3 = 2 OR match_id % 6 = 0),
ef AS (SELECT *, CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'H' WHEN p_draw >= p_away THEN 'D' ELSE 'A' END AS top FROM en)
"""
RELIABLE = """
rb AS (SELECT CASE WHEN c < 0.4 THEN 0 WHEN c < 0.5 THEN 1 WHEN c < 0.6 THEN 2 WHEN c < 0.7 THEN 3 ELSE 4 END AS bin, c, hit FROM (SELECT greatest(p_home, p_draw, p_away) AS c, ((CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'H' WHEN p_draw >= p_away THEN 'D' ELSE 'A' END) = result)::INT::DOUBLE AS hit FROM p)),
rl AS (SELECT CAST(b.range AS BIGINT) AS bin, count(c) AS n, round(avg(c), 3) AS confidence, round(avg(hit), 3) AS accuracy FROM range(5) b LEFT JOIN rb ON rb.bin = b.range GROUP BY 1)
"""


def oracle_sql() -> dict[str, str]:
    o = oracle
    with_, m, pred = o._with, o.MATCHES, (o.MATCHES, o.FORM, o.H2H, o.PREDICTED)
    known = lambda *names: ", ".join(f"round(max(CASE WHEN stat = '{c}' THEN v END), 6) AS avg_{c}" for c in names)
    res = o.RES
    recursive = lambda *parts: with_(*parts).replace("WITH", "WITH RECURSIVE", 1)
    brier = "pow(p_home - (result = 'H')::INT, 2) + pow(p_draw - (result = 'D')::INT, 2) + pow(p_away - (result = 'A')::INT, 2)"
    return {
        "team_discipline": with_(m, SIDES, KNOWN) + f"SELECT match_id, team, {known('fouls', 'corners', 'cards')} FROM ka GROUP BY match_id, team",
        "dominance": with_(m, SIDES, KNOWN) + ", w AS (SELECT match_id, team, " + ", ".join(f"max(CASE WHEN stat = '{c}' THEN v END) AS {c}" for c in ("corners", "cards", "fouls", "shots")) + " FROM ka GROUP BY 1, 2) SELECT m.match_id, " + ", ".join(f"round(h.{c} - a.{c}, 6) AS {c}_dominance" for c in ("corners", "cards", "fouls", "shots")) + " FROM m JOIN w h ON h.match_id = m.match_id AND h.team = home JOIN w a ON a.match_id = m.match_id AND a.team = away",
        "team_ratings": recursive(m, o.FORM, o.ELO, SIDES, KNOWN) + """, eb AS (SELECT match_id, home AS team, round(hb) AS elo FROM z JOIN m USING (match_id) UNION ALL SELECT match_id, away, round(ab) FROM z JOIN m USING (match_id)),
            v AS (SELECT f.*, elo, (SELECT v FROM ka WHERE ka.match_id = f.match_id AND ka.team = f.team AND stat = 'on_target') AS sot, 0.55::DOUBLE + 1.1::DOUBLE * (1 / (1 + exp(-((elo - 1500) / 400)))) AS eo, 1.8::DOUBLE - 1.2::DOUBLE * (1 / (1 + exp(-((elo - 1500) / 400)))) AS ed FROM f JOIN eb USING (match_id, team)),
            u AS (SELECT *, least(least(avg_for / 2, 1.0::DOUBLE) * 1.5::DOUBLE * 0.45::DOUBLE + least(coalesce(sot, avg_for * 0.45::DOUBLE) / 6, 1.0::DOUBLE) * 1.5::DOUBLE * 0.3::DOUBLE + 0.25::DOUBLE * 0.25::DOUBLE + avg_for * 0.2::DOUBLE, 3.5::DOUBLE) AS own FROM v),
            y AS (SELECT *, CASE WHEN n_form > 0 THEN 0.65::DOUBLE * own + 0.35::DOUBLE * eo ELSE eo * 1.25::DOUBLE END AS att, CASE WHEN n_form > 0 THEN 0.65::DOUBLE * least(avg_against, 2.5::DOUBLE) + 0.35::DOUBLE * ed ELSE ed END AS def FROM u)
            SELECT match_id, team, elo, round(form_score, 4) AS form_score, least(CAST(round(CAST(CAST(att AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE), 3.5) AS attack, least(CAST(round(CAST(CAST(def AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE), 2.5) AS defence FROM y""",
        "missing_features": with_(m, SIDES) + ", v AS (SELECT match_id, list_filter([" + ", ".join(f"CASE WHEN {s}_{c} IS NULL THEN '{s}_{c}' END" for s in ("home", "away") for c in ("fouls", "corners", "cards", "xg_actual")) + "], lambda c: c IS NOT NULL) AS x FROM sm) SELECT match_id, coalesce(array_to_string(x, ','), '') AS missing, CAST(len(x) AS BIGINT) AS n_missing FROM v",
        "missing_by_league": with_(m) + "SELECT league, count(*) AS n, count(*) FILTER (home_shots IS NOT NULL AND away_shots IS NOT NULL) AS complete, count(*) FILTER (home_shots IS NULL OR away_shots IS NULL) AS incomplete, count(*) FILTER (day >= (SELECT make_date(year(max(day) - INTERVAL 6 MONTH), 7, 1) FROM m)) AS this_season FROM m GROUP BY league",
        "recency_weights": with_(m) + ", td AS (SELECT max(day) AS today FROM m) SELECT match_id, round(CASE WHEN day < today THEN pow(0.5::DOUBLE, (today - day) / 365.0::DOUBLE) ELSE 1.0::DOUBLE END, 6) AS weight FROM m, td",
        "recent_results": with_(m) + "SELECT team, league, place, match_id, gf, ga, outcome FROM (SELECT *, row_number() OVER (PARTITION BY team, league ORDER BY day DESC, match_id DESC) AS place FROM t WHERE day >= (SELECT max(day) FROM m) - INTERVAL 365 DAY) WHERE place <= 5",
        "recent_shots": with_(m) + "SELECT team, league, place, match_id, shots FROM (SELECT *, row_number() OVER (PARTITION BY team, league ORDER BY day DESC, match_id DESC) AS place FROM t WHERE shots IS NOT NULL) WHERE place <= 5",
        "form_records": with_(m) + """, v AS (SELECT team, count(*) FILTER (outcome = 'W') AS w, count(*) FILTER (outcome = 'D') AS d, count(*) FILTER (outcome = 'L') AS l FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY day DESC, match_id DESC) AS k FROM t) WHERE k <= 10 GROUP BY team)
            SELECT team, concat_ws('-', CASE WHEN w > 0 THEN w || 'W' END, CASE WHEN d > 0 THEN d || 'D' END, CASE WHEN l > 0 THEN l || 'L' END) AS record FROM v""",
        "team_dna": with_(m, SIDES) + f"SELECT team, count(*) AS sampled, round(avg(xg_actual), 6) AS avg_xg, round(avg(possession), 6) AS avg_possession, round(avg(cards), 6) AS avg_cards, round(avg(gf), 6) AS avg_goals_for, round(avg(ga), 6) AS avg_goals_against, {FINISHING} FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY day DESC, match_id DESC) AS k FROM sd) WHERE k <= 10 GROUP BY team",
        "league_finishing": with_(m, SIDES) + f"SELECT league, {FINISHING} FROM sd GROUP BY league",
        "stat_means": with_(m, SIDES) + " UNION ALL ".join(f"SELECT team, '{c}' AS stat_key, round(avg({c}), 6) AS mean, count({c}) AS n FROM sd GROUP BY team HAVING count({c}) > 0" for c in STATS),
        "data_quality": with_(m, o.FORM) + "SELECT match_id, team, CASE WHEN match_id % 4 = 0 THEN 'elo' WHEN match_id % 4 = 1 THEN 'neutral' WHEN n_form >= 3 THEN 'live' ELSE 'partial' END AS quality FROM f",
        "engine_metrics": with_(*pred, ENGINES) + f"SELECT engine, count(*) AS n, round(avg((top = result)::INT::DOUBLE), 6) AS accuracy, round(avg(-ln(least(greatest({res}, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE))), 6) AS log_loss, round(avg({brier}), 6) AS brier FROM ef GROUP BY engine",
        "combined_engines": with_(*pred, ENGINES) + """, w AS (SELECT *, CASE engine WHEN 'rules' THEN 2.0::DOUBLE WHEN 'bold' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM en), s AS (SELECT match_id, sum(p_home * w) / sum(w) AS h, sum(p_draw * w) / sum(w) AS d, sum(p_away * w) / sum(w) AS a FROM w GROUP BY match_id)
            SELECT match_id, round(h / (h + d + a), 6) AS p_home, round(d / (h + d + a), 6) AS p_draw, round(a / (h + d + a), 6) AS p_away FROM s""",
        "consensus": with_(*pred, ENGINES) + """, two AS (SELECT a.match_id, abs(a.p_home - b.p_home) + abs(a.p_draw - b.p_draw) + abs(a.p_away - b.p_away) AS l1, a.top <> b.top AS apart FROM ef a JOIN ef b ON a.match_id = b.match_id AND a.engine < b.engine WHERE a.match_id IN (SELECT match_id FROM ef GROUP BY 1 HAVING count(*) = 2))
            SELECT match_id, round(greatest(0, 1 - l1 / 2), 6) AS agreement, round(l1, 6) AS divergence, apart::INT::DOUBLE AS distance FROM two""",
        "reliability": with_(*pred, RELIABLE) + "SELECT * FROM rl",
        "calibration_error": with_(*pred, RELIABLE) + "SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 4) AS ece FROM rl",
        "xg_errors": with_(*pred, SIDES) + """, s AS (SELECT m.league, 'home' AS side, home_xg AS x, home_xg_actual AS y FROM sm m JOIN p USING (match_id) UNION ALL SELECT m.league, 'away', away_xg, away_xg_actual FROM sm m JOIN p USING (match_id)),
            ge AS (SELECT side, league, count(*) AS n, avg(abs(x - y)) AS mae, avg(x - y) AS bias, sqrt(avg((x - y) * (x - y))) AS rmse, corr(x, y) AS corr FROM s WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY GROUPING SETS ((), (side), (league)))
            SELECT side, league, n, round(mae, 6) AS mae, round(bias, 6) AS bias, round(rmse, 6) AS rmse, CASE WHEN n >= 3 THEN round(corr, 6) END AS corr FROM ge WHERE league IS NULL OR n >= 50""",
        "live_health": with_(*pred) + f""", ps AS (SELECT * REPLACE (CASE WHEN league = 'EUROPE' AND match_id % 2 = 0 THEN 0.96::DOUBLE ELSE p_home END AS p_home, CASE WHEN league = 'EUROPE' AND match_id % 2 = 0 THEN 0.02::DOUBLE ELSE p_draw END AS p_draw, CASE WHEN league = 'EUROPE' AND match_id % 2 = 0 THEN 0.02::DOUBLE ELSE p_away END AS p_away) FROM p) SELECT league, count(*) AS n, round(avg({brier}), 6) AS brier, round(avg(-ln(greatest({res}, 1e-12::DOUBLE))), 6) AS log_loss, round(avg(((CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'H' WHEN p_draw >= p_away THEN 'D' ELSE 'A' END) = result)::INT::DOUBLE), 6) AS accuracy,
            round(stddev_pop(greatest(p_home, p_draw, p_away)), 6) AS spread, stddev_pop(greatest(p_home, p_draw, p_away)) > 0.2 AS unstable, avg({brier}) > 0.66 AS worse FROM ps GROUP BY league""",
        "kept_seasons": with_(m) + ", s AS (SELECT CASE WHEN match_id % 50 <> 0 THEN CAST(year(day - INTERVAL 6 MONTH) AS BIGINT) END AS season, count(*) AS n FROM m GROUP BY 1) SELECT season, n, CASE WHEN season IS NULL THEN 'unknown' WHEN row_number() OVER (ORDER BY season DESC NULLS LAST) <= 3 THEN 'keep' ELSE 'candidate' END AS status FROM s",
        "dominant_cause": with_(o.CALLS) + "SELECT provider, reason AS cause, n AS total FROM (SELECT provider, reason, count(*) AS n, row_number() OVER (PARTITION BY provider ORDER BY count(*) DESC, reason) AS k FROM c WHERE NOT success GROUP BY 1, 2) WHERE k = 1",
        "latest_calls": with_(o.CALLS) + ", k AS (SELECT provider, event_id % 3 AS key, 100 - count(*) / 20.0::DOUBLE AS free FROM c GROUP BY 1, 2) SELECT provider, max(called_at) AS last_call, max(CASE WHEN success THEN called_at END) AS last_success, round((SELECT max(free) FROM k WHERE k.provider = c.provider), 6) AS quota_left FROM c GROUP BY provider",
        "shadow_counts": with_(o.CALLS) + """, d AS (SELECT CAST(called_at AS DATE) AS day, provider, 1 - count(*) FILTER (NOT success) / count(*)::DOUBLE AS rate FROM c GROUP BY 1, 2),
            b AS (SELECT day, first(provider ORDER BY round(rate, 9) DESC, provider DESC) AS rec, max(rate) AS best, max(CASE WHEN provider = 'click' THEN rate END) AS own, count(*) AS n FROM d GROUP BY day),
            x AS (SELECT *, CASE WHEN n > 3 THEN rec END AS named FROM b)
            SELECT count(*) AS total, count(*) FILTER (named = 'click') AS identical, count(*) FILTER (named <> 'click') AS different, count(*) FILTER (named IS NULL) AS unavailable, count(*) FILTER (named <> 'click' AND best > own) AS better FROM x""",
        "provider_hours": with_(o.CALLS) + "SELECT date_trunc('hour', called_at) AS since, provider, count(*) AS calls, count(*) FILTER (NOT success) AS errors, round(avg(latency_ms), 6) AS latency_ms FROM c GROUP BY 1, 2",
        "page_coverage": "WITH v AS (SELECT page_id, " + ", ".join(f"contains(html, '{v}') AS {k}" for k, v in PARTS.items()) + f" FROM pages) SELECT *, round(100.0::DOUBLE * ({' + '.join(f'{k}::INT' for k in PARTS)}) / 5, 2) AS coverage FROM v",
        "absence_impacts": """WITH v AS (SELECT c_custkey, greatest(greatest(floor(c_acctbal * 10000), 0), 100000) AS value, [1.5::DOUBLE, 1.0::DOUBLE, 0.8::DOUBLE, 1.2::DOUBLE, 0.8::DOUBLE][c_custkey % 5 + 1] AS w, (c_custkey % 4 + 1) / 4.0::DOUBLE AS sure FROM customer)
            SELECT c_custkey, -round(least(log10(value + 1) / log10(150000001.0::DOUBLE) * w * sure * 0.25::DOUBLE, 0.18::DOUBLE), 4) AS impact FROM v""",
        "running_profit": with_(*pred, o.QUOTES, o.BETS) + """, s AS (SELECT bookmaker, p.day, count(*) AS bets, count(*) FILTER (p.match_id % 20 = 0) AS pending, coalesce(sum(CASE WHEN p.match_id % 20 = 0 THEN NULL WHEN selection = bets.result THEN stake * (price - 1) ELSE -stake END), 0) AS profit FROM bets JOIN p USING (match_id) GROUP BY 1, 2)
            SELECT bookmaker, day, bets, pending, round(profit, 6) AS profit, round(sum(profit) OVER (PARTITION BY bookmaker ORDER BY day), 6) AS running FROM s""",
        "lenient_values": """SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 4 THEN -p_size END AS BIGINT) AS number, CASE p_partkey % 5 WHEN 0 THEN p_size || '.7' WHEN 1 THEN 'NaN' WHEN 2 THEN p_size || 'x' WHEN 3 THEN '' ELSE CAST(-p_size AS VARCHAR) END AS text FROM part""",
        "season_dates": with_(m) + "SELECT match_id, make_date(year(day - INTERVAL 6 MONTH), 7, 1) AS since, make_date(year(day - INTERVAL 6 MONTH) - 5, 7, 1) AS cutoff FROM m",
        "fixture_sources": with_(m) + "SELECT ['football_data', 'espn', 'odds_api', 'kaggle_historical', 'flashscore', 'tsdb', 'openfootball'][match_id % 8 + 1] AS source, count(*) AS n FROM m GROUP BY 1",
        "parsed_labels": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_name || ' Keeper' ELSE p_name END AS name, ['Winger', 'Attacking midfielder', NULL][p_partkey % 3 + 1] AS position, CAST(p_size AS BIGINT) AS minute, p_brand AS team FROM part",
    }
