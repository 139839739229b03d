"""Registered queries of cascades, kept tables, rank tests and CSV rows, with their SQL written apart."""

from __future__ import annotations

from collections.abc import Callable
from math import exp, factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import features, gates, lookups, profiles
from ..operators import recalibration as replay
from ..sources import bridge, csv_files
from . import oracle
from .profile_queries import ENGINES, SIDES, _engines, _sides
from .queries import _matches, _predicted, _teams, places

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
PHRASES = ("Doubtful", "out for a month", "", "questionable", "back in two weeks", "banned")


def _pick(values, column: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(column) % len(values) + 1).cast("int"))


def odds_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of each match: the newest whole triple of two bookmakers, closing before opening, else the third's newest."""
    q = bridge.quotes(spark, sf_dir).withColumns({"close_home": F.expr("if(seq.l_linenumber % 2 = 0, null, home_price)"), "close_draw": F.expr("if(seq.l_partkey % 5 = 0, 0, draw_price)"), "open_away": F.expr("if(seq.l_suppkey % 6 = 0, null, away_price)"), "none": F.lit(None).cast("double")})
    pairs = [("close_home", "home_price"), ("close_draw", "none"), ("none", "open_away")]
    first = lookups.newest_triple(q.where("bookmaker <> 'N'"), "match_id", pairs, [F.col("captured"), F.col("seq")], ["bookmaker"])
    other = lookups.newest_triple(q.where("bookmaker = 'N'"), "match_id", pairs, [F.col("captured"), F.col("seq")], ["bookmaker"])
    m = _matches(spark, sf_dir).select("match_id")
    return places(lookups.cascade(m, [("history", first, ["match_id"]), ("fallback", other, ["match_id"])], ["home", "draw", "away", "bookmaker"]))


def meeting_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record of each pairing from the first source with three meetings: the quarter's, the year's, the home side's."""
    m = _matches(spark, sf_dir).withColumns({"year": F.year("day").cast("long"), "quarter": F.quarter("day").cast("long")})
    record = (F.count("*").alias("n"), F.count_if(F.col("result") == "H").alias("wins"), F.avg("home_goals").alias("goals"))
    by = lambda *keys: (m.groupBy(*keys).agg(*record).where("n >= 3"), list(keys))
    levels = [("quarter", *by("year", "quarter", "home", "away")), ("year", *by("year", "home", "away")), ("home", *by("home"))]
    return places(lookups.cascade(m.select("year", "quarter", "home", "away").distinct(), levels, ["n", "wins", "goals"]))


def form_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five outcomes of each team in its latest league and month."""
    t = _teams(spark, sf_dir).withColumn("month", F.date_format("day", "yyyy-MM"))
    return lookups.latest_context(t, "team", ["month", "league"], [F.desc("day"), F.desc("match_id")], "outcome", 5)


def recent_side_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the known corners, cards and shots on target over each team's last ten matches in a league with corners known."""
    x = features.recent(_sides(spark, sf_dir).where("corners is not null"), ["team", "league"], 10)
    return places(x.groupBy("team", "league").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("corners", "cards", "on_target"))))


def recent_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each team's last eight matches since a day, outside the leagues left out."""
    t = _teams(spark, sf_dir).where("league not in ('ASIA', 'AFRICA') and day >= date '1995-01-01'")
    return features.recent(t, ["team"], 8).select("team", "match_id", "gf", "ga", F.col("place").cast("long").alias("place"))


def player_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rating and number of rated players by position; positions come from the player's last roster row."""
    x = bridge.table(spark, sf_dir, "lineitem")
    players = x.select("l_orderkey", F.col("l_partkey").alias("player"), F.expr("if(l_suppkey % 4 = 0, null, 5 + l_quantity / 10.0D)").alias("rating"))
    roster = x.select(F.expr("if(l_partkey % 7 = 0, -1 - l_partkey, l_partkey)").alias("player"), F.struct("l_shipdate", "l_orderkey", *LINE).alias("seq"), F.col("l_linestatus").alias("position"))
    got = lookups.with_roster(players, roster, ["player"], ["seq"], ["position"])
    return places(got.groupBy("position").agg(F.avg("rating").alias("rating"), F.count("rating").alias("n"), F.count("*").alias("players")))


def melted_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bridge.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.struct(*LINE).alias("seq"), F.expr("if(l_partkey % 3 = 0, null, l_quantity)").alias("shots"), F.expr("if(l_partkey % 4 = 0, null, l_partkey % 9)").alias("passes"))
    return lookups.melt(x, ["l_orderkey", "l_suppkey"], ["shots", "passes"], ["seq"])


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of clubs as stored before 1998 against a batch of all later matches and some earlier ones again; the batch's last row of a key wins."""
    m = bridge.matches(spark, sf_dir, clubs=True).select("home", "away", "day", "match_id", "home_goals")
    old = m.where("day < date '1998-01-01'")
    stored = old.groupBy("home", "away").agg(F.max_by(F.struct("day", "match_id", "home_goals"), F.struct("day", "match_id")).alias("x")).select("home", "away", "x.*")
    return lookups.snapshot(stored, m.where("day >= date '1998-01-01' or match_id % 5 = 0"), ["home", "away"], ["day", "match_id"])


def lineup_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bridge.table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("if(l_suppkey % 2 = 0, 'home', 'away')").alias("side"), F.expr("if(l_partkey % 5 = 0, null, concat('4-', l_partkey % 4))").alias("shape"), F.struct(*LINE).alias("seq"))
    return lookups.merge_sides(x, "l_orderkey", "side", "shape", ["seq"])


def retained_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls kept and deleted by a retention of nine days, of each provider."""
    old = F.col("called_at") < F.expr("timestamp '2024-01-20' - interval 9 days")
    return bridge.provider_calls(spark, sf_dir).groupBy("provider").agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("deleted"))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by table and year of the tables a snapshot or a cleanup would take."""
    parts = [bridge.table(spark, sf_dir, t).select(F.lit(t).alias("name"), F.year(c).alias("season")) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))]
    return places(parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("name", "season").agg(F.count("*").alias("n")))


def bet_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = bridge.quotes(spark, sf_dir).withColumn("mark", F.expr("case seq.l_linenumber % 3 when 0 then 'W' when 1 then 'L' else '' end"))
    pnl = F.when(F.col("mark") == "W", F.col("home_price") * 10 - 10).when(F.col("mark") == "L", -10.0).otherwise(0.0)
    return places(q.groupBy("bookmaker", "mark").agg(F.count("*").alias("n"), F.sum(pnl).alias("pnl")), 4)


def _absences(spark, sf_dir):
    x = bridge.table(spark, sf_dir, "lineitem").withColumns({"value": F.expr("l_partkey % 40 * 1000000"), "text": _pick(PHRASES, "l_partkey"), "kind": F.expr("if(l_suppkey % 9 = 0, 'Suspended', 'injured')"), "position": _pick(("GK", "def", "MID", "fwd", "?"), "l_suppkey"), "player": F.concat(F.lit("p"), F.col("l_partkey"), F.lit("-"), F.col("l_linenumber"))})
    return x.withColumn("impact", profiles.absence_impact(F.col("value"), F.col("position"), lookups.certainty(F.col("text"), F.col("kind"))))


def absence_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(lookups.absence_report(_absences(spark, sf_dir), ["l_orderkey"], "player", "value", "impact"))


def absence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _absences(spark, sf_dir)
    return places(x.groupBy(lookups.impact_label(F.col("value")).alias("label"), lookups.certainty(F.col("text"), F.col("kind")).alias("certainty")).agg(F.count("*").alias("n")))


def penalised_xg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected goals of the home side after the absences listed for its match."""
    p = _predicted(spark, sf_dir).select("match_id", "home_xg")
    r = lookups.absence_report(_absences(spark, sf_dir), ["l_orderkey"], "player", "value", "impact").select(F.col("l_orderkey").alias("match_id"), F.expr("if(match_id % 4 = 0, 0, penalty)").alias("penalty"))
    return places(p.join(r, "match_id").select("match_id", lookups.penalised(F.col("home_xg"), F.col("penalty")).alias("home_xg")), 4)


def _differences(spark, sf_dir):
    x = _predicted(spark, sf_dir).select("match_id", "league", "home_xg").join(_matches(spark, sf_dir).select("match_id", "home_goals"), "match_id")
    square = lambda c: (c - F.col("home_goals")) * (c - F.col("home_goals"))
    return x.withColumn("d", F.round(square(F.col("home_xg")) - square(F.lit(1.4)), 2))


def signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted home goals' squared error against that of a flat 1.4, by league."""
    return places(lookups.signed_ranks(_differences(spark, sf_dir), "league", "d"), 5)


def median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether predictions surer than their league's median have another Brier score."""
    p = _predicted(spark, sf_dir)
    own = [F.col(c) for c in ("p_home", "p_draw", "p_away")]
    x = p.select("match_id", "league", F.round(F.greatest(*own), 3).alias("top"), scoring.brier(F.col("result"), *own).alias("brier"))
    return places(lookups.median_split(x, "league", "match_id", "top", "brier", 30), 5)


def experiment_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another engine against the rules' on the same matches, by league: three paired metrics and the decision.

    In Europe it leans to what came, in Asia it says the same, and elsewhere it gives a fifth of
    the home side's chance to the away side.
    """
    own = [F.col(c) for c in ("p_home", "p_draw", "p_away")]
    result = F.col("result")
    worse = [own[0] * 0.8, own[1], own[2] + own[0] * 0.2]
    better = [0.7 * p + F.when(result == r, 0.3).otherwise(0.0) for p, r in zip(own, "HDA", strict=True)]
    new = [F.when(F.col("league") == "EUROPE", b).when(F.col("league") != "ASIA", w).otherwise(o) for o, w, b in zip(own, worse, better, strict=True)]
    measures = {
        "brier": lambda e: scoring.brier(result, *e),
        "loss": lambda e: -F.ln(F.greatest(scoring.of_result(result, *e), F.lit(1e-10))),
        "misses": lambda e: (scoring.likeliest(*e) != result).cast("double"),
    }
    p = _predicted(spark, sf_dir)
    tests = gates.paired_tests(p, "league", "match_id", {name: of(new) - of(own) for name, of in measures.items()})
    value = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    x = tests.groupBy("league").agg(*(value(n, c).alias(a) for n in measures for c, a in (("delta", n), ("better", f"{n}_better"))))
    status = lookups.experiment_status(F.col("brier"), F.col("brier_better"), F.col("loss"), F.col("loss_better"), -F.col("misses"), F.col("misses_better"))
    return places(x.withColumn("status", status), 5)


def decision_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the recommended provider did better than the current one: confirmed, contradicted, unknown, and the share confirmed."""
    c = bridge.provider_calls(spark, sf_dir)
    health = c.groupBy("provider").agg(F.avg(F.col("success").cast("double")).alias("rate"))
    rows = c.select("event_id", F.col("provider").alias("current"), F.expr("element_at(array('click', 'view', 'error', 'nobody'), int(event_id % 4 + 1))").alias("recommended")).where("current <> recommended")
    x = lookups.verdict(rows, health, "provider", "rate", "current", "recommended")
    x = x.groupBy("recommended").agg(F.count("*").alias("total"), F.count_if("validated").alias("confirmed"), F.count_if(~F.col("validated")).alias("contradicted"), F.count_if(F.col("validated").isNull()).alias("unknown"))
    return places(x.withColumn("rate", F.col("confirmed") / F.nullif(F.col("confirmed") + F.col("contradicted"), F.lit(0))))


def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bridge.provider_calls(spark, sf_dir)
    status = F.expr("element_at(array(429, 403, 503, 404, null), int(event_id % 5 + 1))")
    raised = F.expr("case when event_id % 11 = 0 then 'timeout' when event_id % 13 = 0 then 'refused' end")
    return c.groupBy("provider", lookups.failure_class(status, raised).alias("reason")).agg(F.count("*").alias("n"))


def _csv(spark, sf_dir):
    m = _matches(spark, sf_dir)
    line = F.to_csv(F.struct(F.expr("if(match_id % 15 = 0, 'soon', date_format(day, 'dd/MM/yyyy'))").alias("a"), F.concat(F.lit(" "), F.initcap("home")).alias("b"), F.initcap("away").alias("c"), F.expr("if(match_id % 10 = 0, 'x', string(home_goals))").alias("d"), F.col("away_goals").cast("string").alias("e"), F.expr("if(match_id % 2 = 0, 'Home', 'Away')").alias("f")))
    return m.select("match_id", line.alias("line"))


def csv_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each CSV line's match, or why it is none; later lines of a match are duplicates."""
    x = csv_files.matches(_csv(spark, sf_dir), "line", ["date", "home", "away", "hg", "ag", "location"], "dd/MM/yyyy", F.to_date(F.lit("1996-07-01")), "match_id")
    return places(x.select("match_id", "day", "home", "away", "home_goals", "away_goals", "result", "reason"))


def csv_home_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One match of the two team rows that a file holds: those of the home side, by reason."""
    x = csv_files.matches(_csv(spark, sf_dir), "line", ["date", "home", "away", "hg", "ag", "location"], "dd/MM/yyyy", None, "match_id", F.col("location") == "Home")
    return x.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("fixture").alias("fixtures"))


def rating_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating rows that fall on one team and day, as true duplicates or as different names made one."""
    t = _teams(spark, sf_dir).select(F.expr("if(match_id % 3 = 0, concat(team, ' FC'), team)").alias("raw"), "day").withColumn("team", F.regexp_replace("raw", " FC$", ""))
    return lookups.name_collisions(t, ["team", "day"], "raw")


def order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each nation's matches lie in order of their days, and of days that follow the numbers in part."""
    m = _matches(spark, sf_dir).select("home", "match_id", F.expr("case league when 'ASIA' then date_add(date '1990-01-01', int(match_id)) when 'EUROPE' then date_sub(date '1990-01-01', int(match_id)) when 'AFRICA' then null else day end").alias("day"))
    return lookups.order_state(m, "home", "match_id", "day", 1000)


def complete_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with every statistic known whose two sides, in this order, met in another such match."""
    m = bridge.matches(spark, sf_dir, stats=True)
    whole = m.where(" and ".join(f"{c} is not null" for c in bridge.STATS)).select("match_id", "home", "away")
    return lookups.also_held(whole, ["home", "away"], "match_id").select("match_id")


def finishing_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many matches since a day have a result, shots on target and expected goals, by league in one pass."""
    m = bridge.matches(spark, sf_dir, stats=True).where("day >= date '1994-01-01'")
    both = lambda c: F.count_if(F.col(f"home_{c}").isNotNull() & F.col(f"away_{c}").isNotNull())
    return m.groupBy("league").agg(F.count("home_goals").alias("played"), both("on_target").alias("on_target"), both("xg_actual").alias("xg"))


def teams_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each team of a window of days once, with its least known id."""
    m = _matches(spark, sf_dir).where("day between date '1996-01-01' and date '1996-03-31'")
    sides = m.select(F.inline(F.array(*(F.struct(F.col(s).alias("team"), F.expr(f"if(match_id % {n} = 0, null, match_id * 10 + {n})").alias("id")) for s, n in (("home", 3), ("away", 4))))))
    return sides.where("id is not null").groupBy("team").agg(F.min("id").alias("id"))


def engine_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each engine's Brier score by league on the matches that it has and on those that all engines have."""
    e = _engines(spark, sf_dir)
    x = e.withColumn("brier", scoring.brier(F.col("result"), F.col("p_home"), F.col("p_draw"), F.col("p_away")))
    return places(lookups.subsets(x, ["league"], "match_id", "engine", ["rules", "bold", "flat"], "brier"))


def provider_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers with enough good calls that serve a kind of data and are mapped in a league."""
    c = bridge.provider_calls(spark, sf_dir)
    available = c.groupBy("provider").agg(F.avg(F.col("success").cast("double")).alias("rate")).where("rate > 0.885").select("provider")
    capable = c.select("provider", F.expr("if(event_id % 2 = 0, 'odds', concat('stats of ', provider))").alias("kind")).distinct()
    mapped = c.select("provider", F.expr("element_at(array('A', 'B', 'C'), int(event_id % 3 + 1))").alias("league"), F.expr("if(event_id % 3 = length(provider) % 3, 'unavailable', 'available')").alias("state")).distinct()
    return lookups.fit_providers(available, capable, mapped)


def recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of each league after all its matches. Without SQL: a test replays it by a plain loop."""
    return places(replay.latest_weights(_recalibrated(spark, sf_dir)))


def learning_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each league has learned, and from how many matches."""
    return replay.learning_stats(_recalibrated(spark, sf_dir))


def _recalibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir)
    x = _predicted(spark, sf_dir).select("match_id", "league", "day", "home_xg", "away_xg").join(m.select("match_id", "home_goals", "away_goals"), "match_id")
    # Each match has one prediction, so the matches alone tell the last day. One row.
    x = x.join(F.broadcast(m.agg(F.max("day").alias("today"))))
    x = x.withColumn("recency", profiles.recency_weight(F.col("day"), F.col("today"))).drop("today")
    return replay.recalibrate(x)


QUERIES = (odds_cascade, meeting_cascade, form_context, recent_side_means, recent_elsewhere, player_ratings, melted_statistics, latest_snapshot, lineup_sides, retained_calls, table_counts, bet_ledger, absence_reports, absence_bands, penalised_xg, signed_ranks, median_split, experiment_status, decision_checks, failure_classes, csv_matches, csv_home_rows, rating_collisions, order_states, complete_pairs, finishing_readiness, teams_with_ids, engine_subsets, provider_fit, recalibration, learning_stats)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


SEQ = ", ".join(LINE)
BACK = ", ".join(f"{c} DESC" for c in LINE)
ABSENT = """ab0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 40 * 1000000 AS value, CASE WHEN l_suppkey % 9 = 0 THEN 1.0::DOUBLE ELSE [0.5, 0.95, 0.8, 0.4, 0.95, 1.0][l_partkey % 6 + 1]::DOUBLE END AS certainty, [1.5, 1.0, 0.8, 1.2, 0.8][l_suppkey % 5 + 1]::DOUBLE AS weight FROM lineitem),
ab AS (SELECT *, 'p' || l_partkey || '-' || l_linenumber AS player, -round(least(log10(greatest(value, 100000) + 1) / log10(150000001.0::DOUBLE) * weight * certainty * 0.25::DOUBLE, 0.18::DOUBLE), 4) AS impact FROM ab0),
ar AS (SELECT l_orderkey, count(*) AS n, round(greatest(sum(impact), -0.3::DOUBLE), 4) AS penalty, bool_or(value >= 20000000) AS has_key, array_to_string(list_slice(list(player ORDER BY impact, player), 1, 3), ', ') AS worst FROM ab GROUP BY 1)"""
DIFF = "df AS (SELECT p.match_id, p.league, round((home_xg - home_goals) * (home_xg - home_goals) - (1.4::DOUBLE - home_goals) * (1.4::DOUBLE - home_goals), 2) AS d FROM p JOIN m ON m.match_id = p.match_id)"
POISSON = " + ".join(f"CASE WHEN u >= {sum(exp(-1) / factorial(j) for j in range(k + 1))!r}::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for k in range(12))
DRAWN = "('0x' || substr(md5('1|' || range || '|' || cell), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u"
CELL = "floor(('0x' || substr(md5('1|' || match_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 512)::BIGINT"
# The 2.5 % and 97.5 % places of so many sorted replicates.
REPLICATES, LOW, HIGH = 2000, 51, 1951
BRIER = " + ".join("pow({0}_" + s + f" - (result = '{r}')::INT, 2)" for s, r in (("home", "H"), ("draw", "D"), ("away", "A")))
LINES = """cl AS (SELECT match_id, CASE WHEN match_id % 15 <> 0 THEN day END AS day, home, away, CASE WHEN match_id % 10 <> 0 THEN home_goals END AS home_goals, away_goals, match_id % 2 = 0 AS at_home FROM m)"""


def _newest(name: str, where: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT match_id, hp AS home, dp AS draw, ap AS away, bookmaker, row_number() OVER (PARTITION BY match_id ORDER BY captured DESC, {BACK}) AS k FROM
        (SELECT *, home_price AS hp, CASE WHEN l_partkey % 5 <> 0 THEN nullif(draw_price, 0) END AS dp, CASE WHEN l_suppkey % 6 <> 0 THEN nullif(away_price, 0) END AS ap FROM q) WHERE dp IS NOT NULL AND ap IS NOT NULL AND {where}) WHERE k = 1)"""


def oracle_sql() -> dict[str, str]:
    o = oracle
    with_, m, pred = o._with, o.MATCHES, (o.MATCHES, o.FORM, o.H2H, o.PREDICTED)
    record = "count(*) AS n, count(*) FILTER (result = 'H') AS wins, avg(home_goals) AS goals"
    reason = lambda cut: f"CASE WHEN day IS NULL THEN 'invalid_date' {cut} WHEN home_goals IS NULL THEN 'missing_score' END"
    return {
        "odds_cascade": with_(m, o.QUOTES, _newest("n1", "bookmaker <> 'N'"), _newest("n2", "bookmaker = 'N'")) + """SELECT m.match_id, CASE WHEN n1.match_id IS NOT NULL THEN 'history' WHEN n2.match_id IS NOT NULL THEN 'fallback' END AS source, round(coalesce(n1.home, n2.home), 6) AS home, round(coalesce(n1.draw, n2.draw), 6) AS draw, round(coalesce(n1.away, n2.away), 6) AS away, coalesce(n1.bookmaker, n2.bookmaker) AS bookmaker
            FROM m LEFT JOIN n1 ON n1.match_id = m.match_id LEFT JOIN n2 ON n2.match_id = m.match_id""",
        "meeting_cascade": with_(m) + f""", mq AS (SELECT *, year(day) AS year, quarter(day) AS quarter FROM m), a AS (SELECT year, quarter, home, away, {record} FROM mq GROUP BY ALL), b AS (SELECT year, home, away, {record} FROM mq GROUP BY ALL HAVING count(*) >= 3), c AS (SELECT home, {record} FROM m GROUP BY ALL HAVING count(*) >= 3)
            SELECT a.year, a.quarter, a.home, a.away, CASE WHEN a.n >= 3 THEN 'quarter' WHEN b.n IS NOT NULL THEN 'year' WHEN c.n IS NOT NULL THEN 'home' END AS source, CASE WHEN a.n >= 3 THEN a.n ELSE coalesce(b.n, c.n) END AS n, CASE WHEN a.n >= 3 THEN a.wins ELSE coalesce(b.wins, c.wins) END AS wins, round(CASE WHEN a.n >= 3 THEN a.goals ELSE coalesce(b.goals, c.goals) END, 6) AS goals
            FROM a LEFT JOIN b ON b.year = a.year AND b.home = a.home AND b.away = a.away LEFT JOIN c ON c.home = a.home""",
        "form_context": with_(m) + ", c AS (SELECT *, strftime(day, '%Y-%m') AS month FROM t), x AS (SELECT *, dense_rank() OVER (PARTITION BY team ORDER BY month DESC, league DESC) AS g, row_number() OVER (PARTITION BY team, month, league ORDER BY day DESC, match_id DESC) AS k FROM c) SELECT team, string_agg(outcome, '' ORDER BY k DESC) AS outcomes, count(*) AS n FROM x WHERE g = 1 AND k <= 5 GROUP BY team",
        "recent_side_means": with_(m, SIDES) + ", x AS (SELECT *, row_number() OVER (PARTITION BY team, league ORDER BY day DESC, match_id DESC) AS k FROM sd WHERE corners IS NOT NULL) SELECT team, league, count(*) AS n, round(avg(corners), 6) AS corners, round(avg(cards), 6) AS cards, round(avg(on_target), 6) AS on_target FROM x WHERE k <= 10 GROUP BY team, league",
        "recent_elsewhere": with_(m) + "SELECT team, match_id, gf, ga, place FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY day DESC, match_id DESC) AS place FROM t WHERE league NOT IN ('ASIA', 'AFRICA') AND day >= DATE '1995-01-01') WHERE place <= 8",
        "player_ratings": f"""WITH r AS (SELECT l_partkey, l_linestatus AS position FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, {BACK}) AS k FROM lineitem) WHERE k = 1 AND l_partkey % 7 <> 0)
            SELECT position, round(avg(CASE WHEN l_suppkey % 4 <> 0 THEN 5 + l_quantity / 10.0::DOUBLE END), 6) AS rating, count(*) FILTER (l_suppkey % 4 <> 0) AS n, count(*) AS players FROM lineitem l LEFT JOIN r ON r.l_partkey = l.l_partkey GROUP BY position""",
        "melted_statistics": " UNION ALL ".join(f"SELECT l_orderkey, l_suppkey, '{k}' AS stat_key, v::DOUBLE AS value FROM (SELECT l_orderkey, l_suppkey, {e} AS v, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {BACK}) AS k FROM lineitem WHERE l_partkey % {n} <> 0) WHERE k = 1" for k, e, n in (("shots", "l_quantity", 3), ("passes", "l_partkey % 9", 4))),
        "latest_snapshot": "WITH " + m.split("m0 AS")[0].rstrip().rstrip(",") + """, cl AS (SELECT 'club ' || o_custkey AS home, 'club ' || l_suppkey AS away, CAST(o_orderdate AS DATE) AS day, o_orderkey AS match_id, CAST(floor(l_quantity) AS BIGINT) % 5 AS home_goals FROM orders JOIN fl ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey),
            x AS (SELECT *, false AS new FROM cl WHERE day < DATE '1998-01-01' UNION ALL SELECT *, true FROM cl WHERE day >= DATE '1998-01-01' OR match_id % 5 = 0)
            SELECT home, away, day, match_id, home_goals, CASE WHEN NOT new THEN 'kept' WHEN every THEN 'inserted' ELSE 'replaced' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY home, away ORDER BY new DESC, day DESC, match_id DESC) AS k, bool_and(new) OVER (PARTITION BY home, away) AS every FROM x) WHERE k = 1""",
        "lineup_sides": f"""WITH x AS (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'home' ELSE 'away' END AS side, '4-' || l_partkey % 4 AS shape FROM lineitem), y AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, side ORDER BY {BACK}) AS k FROM x WHERE l_partkey % 5 <> 0)
            SELECT o.l_orderkey, max(y.shape) FILTER (y.side = 'home') AS home, max(y.shape) FILTER (y.side = 'away') AS away FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN y ON y.l_orderkey = o.l_orderkey AND y.k = 1 GROUP BY 1""",
        "retained_calls": with_(o.CALLS) + "SELECT provider, count(*) FILTER (called_at >= TIMESTAMP '2024-01-11') AS kept, count(*) FILTER (called_at < TIMESTAMP '2024-01-11') AS deleted FROM c GROUP BY provider",
        "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, year({c}) AS season, count(*) AS n FROM {t} GROUP BY 2" for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))),
        "bet_ledger": with_(o.QUOTES) + ", x AS (SELECT *, ['W', 'L', ''][l_linenumber % 3 + 1] AS mark FROM q) SELECT bookmaker, mark, count(*) AS n, round(sum(CASE mark WHEN 'W' THEN home_price * 10 - 10 WHEN 'L' THEN -10 ELSE 0 END), 4) AS pnl FROM x GROUP BY ALL",
        "absence_reports": with_(ABSENT) + "SELECT * FROM ar",
        "absence_bands": with_(ABSENT) + "SELECT CASE WHEN value >= 20000000 THEN 'key' WHEN value >= 5000000 THEN 'starter' ELSE 'rotation' END AS label, certainty, count(*) AS n FROM ab GROUP BY ALL",
        "penalised_xg": with_(*pred, ABSENT) + "SELECT match_id, round(CASE WHEN match_id % 4 = 0 OR penalty >= 0 THEN home_xg::DECIMAL(12, 4) ELSE greatest(home_xg::DECIMAL(12, 4) * (1 + penalty::DECIMAL(12, 4)), 0.2) END, 4)::DOUBLE AS home_xg FROM p JOIN ar ON l_orderkey = match_id",
        "signed_ranks": with_(*pred, DIFF) + """, rk AS (SELECT *, rank() OVER (PARTITION BY league ORDER BY abs(d)) + (count(*) OVER (PARTITION BY league, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY league, abs(d))::DOUBLE AS c FROM df WHERE d <> 0),
            s AS (SELECT league, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, sum(c * c - 1) AS ties FROM rk GROUP BY 1), a AS (SELECT league, avg(d) AS delta FROM df GROUP BY 1),
            z AS (SELECT a.league, n, delta, w, (w - n * (n + 1) / 4.0::DOUBLE) / nullif(sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48), 0) AS z FROM a LEFT JOIN s ON s.league = a.league), y AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM z),
            v AS (SELECT *, coalesce(t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-z * z / 2), 1) AS p FROM y)
            SELECT league, coalesce(n, 0) AS n, round(delta, 5) AS delta, round(w, 5) AS w, round(z, 5) AS z, round(p, 5) AS p_value, p < 0.05 AND delta < 0 AS better FROM v""",
        "median_split": with_(*pred) + f""", tp AS (SELECT match_id, league, round(greatest(p_home, p_draw, p_away), 3) AS v, {BRIER.format("p")} AS s FROM p), nn AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY v) AS k, count(*) OVER (PARTITION BY league) AS n FROM tp),
            md AS (SELECT league, n, v AS median FROM nn WHERE k = n // 2 + 1), ha AS (SELECT tp.*, md.n, median, v >= median AS up FROM tp JOIN md ON md.league = tp.league), cs AS (SELECT league, up, {CELL} AS cell, max(n) AS n, max(median) AS median, count(*) AS c, sum(s) AS s FROM ha GROUP BY ALL), rp AS (SELECT *, {DRAWN} FROM cs, range({REPLICATES})), w AS (SELECT *, {POISSON} AS w FROM rp),
            bt AS (SELECT league, range, max(n) AS n, max(median) AS median, sum(c) FILTER (up) AS n_up, sum(s) FILTER (NOT up) / sum(c) FILTER (NOT up) - sum(s) FILTER (up) / sum(c) FILTER (up) AS delta, sum(w * s) FILTER (NOT up) / nullif(sum(w * c) FILTER (NOT up), 0) - sum(w * s) FILTER (up) / nullif(sum(w * c) FILTER (up), 0) AS boot FROM w GROUP BY 1, 2),
            f2 AS (SELECT league, max(n) AS n, max(median) AS median, max(delta) AS delta, list_sort(list(boot)) AS b, max(n_up) AS n_up FROM bt GROUP BY 1)
            SELECT league, n, round(median, 5) AS median, round(delta, 5) AS delta, round(b[{LOW}], 5) AS low, round(b[{HIGH}], 5) AS high, CASE WHEN n < 30 OR n_up < 2 OR n - n_up < 2 THEN 'insufficient_data' WHEN b[{LOW}] > 0 OR b[{HIGH}] < 0 THEN 'surface_worthy' ELSE 'rejected' END AS verdict FROM f2""",
        "experiment_status": with_(*pred) + f""", e AS (SELECT *, CASE WHEN league = 'EUROPE' THEN 0.7::DOUBLE * p_home + CASE result WHEN 'H' THEN 0.3::DOUBLE ELSE 0 END WHEN league <> 'ASIA' THEN p_home * 0.8::DOUBLE ELSE p_home END AS b_home,
              CASE WHEN league = 'EUROPE' THEN 0.7::DOUBLE * p_draw + CASE result WHEN 'D' THEN 0.3::DOUBLE ELSE 0 END ELSE p_draw END AS b_draw,
              CASE WHEN league = 'EUROPE' THEN 0.7::DOUBLE * p_away + CASE result WHEN 'A' THEN 0.3::DOUBLE ELSE 0 END WHEN league <> 'ASIA' THEN p_away + p_home * 0.2::DOUBLE ELSE p_away END AS b_away FROM p), top AS (SELECT *, CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'H' WHEN p_draw >= p_away THEN 'D' ELSE 'A' END AS tp, CASE WHEN b_home >= b_draw AND b_home >= b_away THEN 'H' WHEN b_draw >= b_away THEN 'D' ELSE 'A' END AS tb FROM e),
            d AS (SELECT match_id, league, ({BRIER.format("b")}) - ({BRIER.format("p")}) AS br, ln(greatest(CASE result WHEN 'H' THEN p_home WHEN 'D' THEN p_draw ELSE p_away END, 1e-10)) - ln(greatest(CASE result WHEN 'H' THEN b_home WHEN 'D' THEN b_draw ELSE b_away END, 1e-10)) AS ll, ((tb <> result)::INT - (tp <> result)::INT)::DOUBLE AS ms FROM top),
            cs AS (SELECT league, {CELL} AS cell, count(*) AS n, sum(br) AS br, sum(ll) AS ll, sum(ms) AS ms FROM d GROUP BY ALL), rp AS (SELECT *, {DRAWN} FROM cs, range({REPLICATES})), w AS (SELECT *, {POISSON} AS w FROM rp),
            s AS (SELECT league, range, sum(br) / sum(n) AS br, sum(ll) / sum(n) AS ll, sum(ms) / sum(n) AS ms, sum(w * br) / nullif(sum(w * n), 0) AS bb, sum(w * ll) / nullif(sum(w * n), 0) AS lb, sum(w * ms) / nullif(sum(w * n), 0) AS mb FROM w GROUP BY 1, 2),
            f2 AS (SELECT league, max(br) AS brier, max(ll) AS loss, max(ms) AS misses, list_sort(list(bb))[{HIGH}] < 0 AS brier_better, list_sort(list(lb))[{HIGH}] < 0 AS loss_better, list_sort(list(mb))[{HIGH}] < 0 AS misses_better FROM s GROUP BY 1)
            SELECT league, round(brier, 5) AS brier, brier_better, round(loss, 5) AS loss, loss_better, round(misses, 5) AS misses, misses_better,
              CASE WHEN brier_better AND loss_better AND misses_better THEN 'candidate_for_promotion' WHEN brier > 0 AND loss > 0 AND NOT brier_better AND NOT loss_better AND misses > 0 THEN 'rejected' ELSE 'monitoring' END AS status FROM f2""",
        "decision_checks": with_(o.CALLS) + """, h AS (SELECT provider, avg(success::INT) AS rate FROM c GROUP BY 1), r AS (SELECT provider AS cur, ['click', 'view', 'error', 'nobody'][event_id % 4 + 1] AS recommended FROM c),
            v AS (SELECT recommended, b.rate > a.rate AS ok FROM r LEFT JOIN h a ON a.provider = cur LEFT JOIN h b ON b.provider = recommended WHERE cur <> recommended)
            SELECT recommended, count(*) AS total, count(*) FILTER (ok) AS confirmed, count(*) FILTER (NOT ok) AS contradicted, count(*) FILTER (ok IS NULL) AS unknown, round(count(*) FILTER (ok) / nullif(count(ok), 0)::DOUBLE, 6) AS rate FROM v GROUP BY 1""",
        "failure_classes": with_(o.CALLS) + "SELECT provider, CASE WHEN event_id % 11 = 0 THEN 'timeout' WHEN event_id % 13 = 0 THEN 'network' ELSE ['quota', 'forbidden', 'upstream_5xx', 'other_error', NULL][event_id % 5 + 1] END AS reason, count(*) AS n FROM c GROUP BY ALL",
        "csv_matches": with_(m, LINES) + f""", x AS (SELECT *, {reason("WHEN day < DATE '1996-07-01' THEN 'before_cutoff'")} AS why FROM cl), y AS (SELECT *, row_number() OVER (PARTITION BY why, home, away, day ORDER BY match_id) AS k FROM x)
            SELECT match_id, day, home, away, home_goals, away_goals, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' WHEN home_goals = away_goals THEN 'D' END AS result, coalesce(why, CASE WHEN k > 1 THEN 'duplicate' ELSE 'valid' END) AS reason FROM y""",
        "csv_home_rows": with_(m, LINES) + f""", x AS (SELECT *, CASE WHEN NOT at_home THEN 'left_out' ELSE {reason("")} END AS why FROM cl), y AS (SELECT *, row_number() OVER (PARTITION BY why, home, away, day ORDER BY match_id) AS k FROM x)
            SELECT coalesce(why, CASE WHEN k > 1 THEN 'duplicate' ELSE 'valid' END) AS reason, count(*) AS n, count(DISTINCT CASE WHEN day IS NOT NULL THEN (home, away, day) END) AS fixtures FROM y GROUP BY 1""",
        "rating_collisions": with_(m) + "SELECT team, day, count(*) AS n, count(DISTINCT match_id % 3 = 0) AS names, CASE WHEN count(DISTINCT match_id % 3 = 0) > 1 THEN 'collision' ELSE 'duplicate' END AS kind FROM t GROUP BY team, day HAVING count(*) > 1",
        "order_states": with_(m) + """, x AS (SELECT home, match_id, CASE league WHEN 'ASIA' THEN DATE '1990-01-01' + match_id::INT WHEN 'EUROPE' THEN DATE '1990-01-01' - match_id::INT WHEN 'AFRICA' THEN NULL ELSE day END AS day FROM m), y AS (SELECT *, lag(day) OVER (PARTITION BY home ORDER BY match_id) AS b FROM x WHERE day IS NOT NULL),
            z AS (SELECT home, count(*) FILTER (day > b) AS up, count(*) FILTER (day < b) AS down FROM y GROUP BY 1)
            SELECT n.home, CASE WHEN up IS NULL THEN 'unknown' WHEN up = 0 THEN 'descending' WHEN down = 0 THEN 'ascending' ELSE 'unsorted' END AS state FROM (SELECT DISTINCT home FROM x) n LEFT JOIN z ON z.home = n.home""",
        "complete_pairs": with_(m, SIDES) + ", w AS (SELECT * FROM sm WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in bridge.STATS) + ") SELECT match_id FROM w WHERE EXISTS (SELECT 1 FROM w o WHERE o.home = w.home AND o.away = w.away AND o.match_id <> w.match_id)",
        "finishing_readiness": with_(m, SIDES) + "SELECT league, count(home_goals) AS played, count(*) FILTER (home_on_target IS NOT NULL AND away_on_target IS NOT NULL) AS on_target, count(*) FILTER (home_xg_actual IS NOT NULL AND away_xg_actual IS NOT NULL) AS xg FROM sm WHERE day >= DATE '1994-01-01' GROUP BY league",
        "teams_with_ids": with_(m) + "SELECT team, min(id) AS id FROM (SELECT home AS team, match_id * 10 + 3 AS id FROM m WHERE match_id % 3 <> 0 AND day BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' UNION ALL SELECT away, match_id * 10 + 4 FROM m WHERE match_id % 4 <> 0 AND day BETWEEN DATE '1996-01-01' AND DATE '1996-03-31') GROUP BY team",
        "engine_subsets": with_(*pred, ENGINES) + f""", b AS (SELECT match_id, league, engine, {BRIER.format("p")} AS s, count(*) OVER (PARTITION BY match_id) = 3 AS shared FROM en)
            SELECT league, {", ".join(f"count(*) FILTER (engine = '{n}') AS {n}_n, round(avg(s) FILTER (engine = '{n}'), 6) AS {n}, round(avg(s) FILTER (engine = '{n}' AND shared), 6) AS {n}_common" for n in ("rules", "bold", "flat"))}, count(DISTINCT match_id) FILTER (shared) AS common_n FROM b GROUP BY league""",
        "provider_fit": with_(o.CALLS) + """, av AS (SELECT provider FROM c GROUP BY 1 HAVING avg(success::INT) > 0.885), ca AS (SELECT DISTINCT provider, CASE WHEN event_id % 2 = 0 THEN 'odds' ELSE 'stats of ' || provider END AS kind FROM c), ma AS (SELECT DISTINCT provider, ['A', 'B', 'C'][event_id % 3 + 1] AS league FROM c WHERE event_id % 3 <> length(provider) % 3)
            SELECT league, kind, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers FROM ma JOIN ca USING (provider) WHERE provider IN (SELECT provider FROM av) GROUP BY ALL""",
    }
