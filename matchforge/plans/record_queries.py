"""Registered queries of records, gates and trials, with their SQL written apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import gates, health, pricing, records
from ..sources import bridge
from . import oracle
from .queries import _matches, _predicted, _teams, places

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
SUFFIX = " fc$"


def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir)
    doc = F.to_json(F.expr("""named_struct('status', if(match_id % 10 = 0, 'SCHEDULED', 'FINISHED'), 'homeTeam', named_struct('name', home), 'awayTeam', named_struct('name', away), 'score', named_struct(
        'duration', if(match_id % 7 = 0, 'PENALTY_SHOOTOUT', 'REGULAR'), 'fullTime', named_struct('home', home_goals + if(match_id % 7 = 0, 3, 0), 'away', away_goals), 'regularTime', if(match_id % 14 = 0, null, named_struct('home', home_goals, 'away', away_goals))))"""))
    return places(records.finished(m.select("match_id", doc.alias("doc")), "doc"))


def loose_json_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir)
    doc = F.expr("""concat('{"team1": ', if(match_id % 2 = 0, concat('{"name": "', home, '"}'), concat('"', home, '"')), ', "team2": {"name": "', away, '"}, "date": "', day, 'T20:00"', if(match_id % 5 = 0, '', concat(', "score": {"ft": [', home_goals, ',', away_goals, ']}')), '}')""")
    return places(records.loose_match(m.select("match_id", "league", doc.alias("doc")), "doc", "open", F.col("league"), F.lit("2021-22")))


def mapped_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir)
    doc = F.to_json(F.expr("named_struct('teams', array(named_struct('name', home, 'shots', home_shots), named_struct('name', away, 'shots', away_shots)), 'info', named_struct('league', league))"))
    got = records.by_map(doc, {"league": "info.league", "first": "teams[0].name", "lost": "info.city.name", "nested": {"second": "teams[1].name"}, "sides": ("teams", {"shots": "shots"})})
    return m.select("match_id", got.alias("x")).select("match_id", "x.league", "x.first", "x.lost", "x.nested.second", F.array_join("x.sides.shots", ",", "?").alias("shots"))


def bookmaker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir)
    wide = m.select("match_id", F.sha2(F.concat_ws(",", "match_id", "home_goals", "away_goals"), 256).alias("row_hash"), F.expr("string(1 + home_goals / 2)").alias("ah"), F.lit("3.0").alias("ad"), F.expr("string(1 + away_goals / 2)").alias("aa"), F.expr("if(match_id % 4 = 0, 'n/a', '2.1')").alias("bh"), F.expr("string(1 + away_goals)").alias("bd"), F.lit("2.9").alias("ba"))
    return places(records.price_rows(wide, ["match_id", "row_hash"], {"a": ("ah", "ad", "aa"), "b": ("bh", "bd", "ba")}))


def best_outcome_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = bridge.quotes(spark, sf_dir)
    named = lambda n, c: F.struct(F.lit(n).alias("name"), F.lit(None).cast("double").alias("point"), F.col(c).alias("price"))
    total = F.struct(F.lit("Over").alias("name"), (F.col("seq.l_linenumber") % 3 + 1.5).alias("point"), F.col("draw_price").alias("price"))
    markets = F.array(F.struct(F.lit("h2h").alias("key"), F.array(named("home", "home_price"), named("away", "away_price")).alias("outcomes")), F.struct(F.lit("totals").alias("key"), F.array(total).alias("outcomes")))
    events = q.select("match_id", F.array(F.struct(F.col("bookmaker").alias("title"), markets.alias("markets"))).alias("bookmakers"))
    return places(records.best_outcomes(events, "match_id"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bridge.table(spark, sf_dir, "pages")
    html = F.regexp_replace("html", '<a href="/([^"]*)"', '<a href="/match/$1/?a=1&amp;mid=$1"')
    return places(records.links(p.select("page_id", html.alias("html")), "page_id", "html", "/match/", "mid", "https://pages.example"))


def canonical_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored matches under trimmed lower-case names and a day, some of them unplayed or elsewhere, against a batch of all matches."""
    m = _matches(spark, sf_dir)
    first = m.groupBy("home", "away", "day").agg(F.min(F.struct("match_id", "home_goals", "home_shots")).alias("x")).select("home", "away", "day", "x.*")
    key = lambda day: records.natural_key(F.concat(F.lit(" "), F.col("home")), F.col("away"), day)
    stored = first.select(*key(F.expr("if(match_id % 6 = 0, date_add(day, 50000), day)")), F.expr("if(match_id % 4 = 0, null, home_goals)").alias("goals"), F.expr("if(match_id % 5 = 0, null, home_shots)").alias("shots"))
    batch = m.select(*key(F.col("day")), "match_id", F.expr("home_goals + if(match_id % 9 = 0, 1, 0)").alias("goals"), F.col("home_shots").alias("shots"))
    return places(records.canonical_upsert(stored, batch, ["k_home", "k_away", "k_day"], ["match_id"], ["goals"], ["shots"]))


def field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bridge.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", *LINE, "element_at(array('freelf', 'espn', 'apifootball', 'fd', 'oddsapi', 'tsdb'), int(l_suppkey % 6 + 1)) as provider", "if(l_partkey % 3 = 0, null, l_partkey % 50) as league", "if(l_partkey % 4 = 0, null, l_suppkey % 40) as venue", "if(l_partkey % 5 = 0, null, l_shipdate) as kickoff", "if(l_suppkey % 6 = 0, l_partkey, null) as freelf_id", "if(l_partkey % 2 = 0, null, l_returnflag) as status")
    # The rank of each provider for a field, the first wins.
    ranks = {"league": {**dict.fromkeys(("freelf", "espn", "apifootball", "oddsapi", "tsdb"), 1), "fd": 2}, "venue": {"freelf": 1, "espn": 2, "apifootball": 3, "fd": 4}, "kickoff": {"apifootball": 1, "espn": 2, "fd": 3, "freelf": 4, "oddsapi": 5, "tsdb": 6}}
    return records.merge_fields(x, ["l_orderkey"], "provider", LINE, ranks, ["freelf_id"], "status")


def written_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir).select("match_id", "home", "away", "league", "day", "home_goals", "away_goals")
    stored = m.withColumns({c: F.expr(f"if(match_id % 3 = 0, {c}, null)") for c in ("home_goals", "away_goals")})
    results = m.withColumn("day", F.expr("if(match_id % 4 = 0, date_add(day, 50000), day)"))
    # Results that no stored match has, by key or by id.
    results = results.withColumns({"match_id": F.expr("if(home_goals = 4, -match_id, match_id)"), "day": F.expr("if(home_goals = 4, date_add(day, 100000), day)")})
    return places(records.write_results(stored, results, ["home", "away", "league", "day"], "match_id", ["home_goals", "away_goals"]))


def unseen_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir).select("match_id", "home", "away", "day", "result")
    return records.unseen(m, m.where("result = 'D'"), ["home", "away", "day"], ["match_id"])


def _renamed(spark, sf_dir):
    return _matches(spark, sf_dir).withColumn("home", F.expr("if(match_id % 3 = 0, concat(home, ' fc'), home)"))


def _canon(c):
    return F.regexp_replace(c, SUFFIX, "")


def vocabulary_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.vocabulary(_renamed(spark, sf_dir), "match_id", ("home", "away"), "day", _canon)


def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.plan_renames(_renamed(spark, sf_dir), "match_id", ("home", "away"), "day", _canon)


def pooled_finishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(records.pooled(_teams(spark, sf_dir), "league", ["EUROPE", "ASIA"], ("gf", "shots")))


def _evaluations(spark, sf_dir):
    d = health.daily(bridge.provider_calls(spark, sf_dir)).withColumns({"matched": F.expr("if(day(day) % 3 = 0, calls - errors, calls)"), "accepted": F.expr("if(day(day) % 2 = 0, errors, 0)"), "ids": F.expr("if(day(day) % 5 = 0, errors, 0)"), "planned": F.expr("if(day(day) = 13, 0, calls)")})
    # One provider has no differences, one only accepted ones, and one too few calls to tell.
    d = d.withColumns({"matched": F.expr("if(provider in ('click', 'view'), calls, matched)"), "open": F.expr("if(provider = 'click', 0, errors)"), "accepted": F.expr("case provider when 'click' then 0 when 'view' then errors else accepted end"), "ids": F.expr("if(provider in ('click', 'view'), 0, ids)"), "seen": F.expr("if(provider = 'signup', 2, calls)")})
    score, state = gates.equivalence(F.col("seen"), F.col("planned"), F.col("matched"), F.col("open"), F.col("accepted"), F.col("ids"), 5)
    return d.withColumns({"score": score, "state": state})


def equivalence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(_evaluations(spark, sf_dir).select("provider", "day", "score", "state"))


def migration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evaluations(spark, sf_dir).withColumns({"entity": F.expr("if(day(day) % 2 = 0, 'even', 'odd')"), "parts": F.expr("map('one', if(provider = 'view', 0, matched div 2), 'two', matched - matched div 2)")})
    return places(gates.gate_verdict(gates.gate_status(e, ["provider", "entity"], ["day"], "state", "matched", "parts"), 50, 20))


#: Provider, its days, and the least share of equal choices: enough of them, too few days, too low a share, none at all.
READY = (("click", "true", 0.9), ("view", "day(day) % 7 = 0", 0.9), ("error", "true", 0.99), ("nobody", "true", 0.9))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bridge.provider_calls(spark, sf_dir).select(F.to_date("called_at").alias("day"), F.expr("if(event_id % 17 = 0, '', provider)").alias("named"), (F.col("event_id") % 20 == 3).alias("changed"))
    # Each provider by itself, on the days of the month that its name's length leaves it.
    x = x.withColumn("provider", F.col("named"))
    rows = [gates.readiness(x.where((F.col("provider") == p) & F.expr(days)).drop("provider"), "day", "named", "changed", 14, 300, rate).withColumn("provider", F.lit(p)) for p, days, rate in READY]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return places(out)


def stale_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bridge.provider_calls(spark, sf_dir)
    status = F.element_at(F.array(*map(F.lit, ("pending", "approved", "applied"))), (F.col("event_id") % 3 + 1).cast("int"))
    new = gates.timed_out(status, F.col("called_at") + F.expr("interval 7 days"), F.expr("timestamp '2024-01-20'"))
    return x.select(status.alias("was"), new.alias("status")).groupBy("was", "status").agg(F.count("*").alias("n"))


def kickoff_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bridge.provider_calls(spark, sf_dir)
    inside, beyond = gates.within_window(F.expr("if(event_id % 11 = 0, null, called_at)"), F.expr("timestamp '2024-01-10'"), 7, 12)
    return x.select("event_id", inside.alias("inside"), beyond.alias("beyond"))


def week_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a week in chosen leagues, and for each league whether it has any."""
    m = _matches(spark, sf_dir).where("league in ('EUROPE', 'ASIA', 'AFRICA') and day between date '1998-05-11' and date '1998-05-17'")
    return m.groupBy("league").agg(F.count("*").alias("n"), F.min("day").alias("since"), F.max("day").alias("until"))


def special_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, both-score and double-chance bets whose edge is 5 % or more."""
    p = _predicted(spark, sf_dir).select("match_id", "p_home", "p_draw", "p_away", "home_xg", "away_xg", (F.col("home_xg") + F.col("away_xg")).alias("g"))
    under, both = F.exp(-F.col("g")) * (1 + F.col("g") + F.col("g") * F.col("g") / 2), (1 - F.exp(-F.col("home_xg"))) * (1 - F.exp(-F.col("away_xg")))
    odds = {"over 2.5": (1 - under, 1.6), "under 2.5": (under, 1.9), "both": (both, 1.8), "not both": (1 - both, 2.0), "1X": (F.col("p_home") + F.col("p_draw"), 1.3), "X2": (F.col("p_draw") + F.col("p_away"), 1.7)}
    x = p.select("match_id", F.inline(F.array(*(F.struct(F.lit(k).alias("market"), q.alias("p"), (F.col("match_id") % 7 / 10 + o - 0.6).alias("price")) for k, (q, o) in odds.items())))).where("price > 1")
    raw = (F.col("p") * F.col("price") - 1) * 100
    return x.where(F.round(raw, 9) >= 5).select("match_id", "market", F.round(F.col("p") * 100, 1).alias("percent"), F.round(raw, 2).alias("edge"), scoring.band(F.round(raw, 9)).alias("rating"))


def paired_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error of the predicted home goals less that of a flat 1.4, by league."""
    x = pricing.expected(_matches(spark, sf_dir), keep=("home_goals",))
    square = lambda c: (c - F.col("home_goals")) * (c - F.col("home_goals"))
    return places(gates.paired_tests(x, "league", "match_id", {"square": square(F.col("home_xg")) - square(F.lit(1.4))}, cells=None).drop("name"))


QUERIES = (json_results, loose_json_matches, mapped_json, bookmaker_rows, best_outcome_prices, page_links, canonical_upsert, field_merge, written_results, unseen_matches, vocabulary_drift, rename_plan, pooled_finishing, equivalence_scores, migration_gate, readiness, stale_decisions, kickoff_windows, week_matches, special_bets, paired_trials)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


RENAMED = """n AS (SELECT match_id, CASE WHEN match_id % 3 = 0 THEN home || ' fc' ELSE home END AS home, away, day, home AS canon FROM m), hit AS (SELECT canon, away, day FROM n GROUP BY ALL HAVING count(*) > 1),
v AS (SELECT canon, home AS raw FROM n UNION ALL SELECT away, away FROM n)"""
EVALUATED = """
d0 AS (SELECT provider, CAST(called_at AS DATE) AS day, count(*) AS calls, count(*) FILTER (NOT success) AS errors FROM c GROUP BY 1, 2),
d1 AS (SELECT *, provider IN ('click', 'view') AS fine, CASE WHEN provider = 'signup' THEN 2 ELSE calls END AS seen, CASE WHEN day(day) % 3 = 0 AND NOT fine THEN calls - errors ELSE calls END AS matched, CASE WHEN fine OR day(day) % 2 = 0 THEN 0 ELSE errors END AS open,
       CASE WHEN day(day) % 5 = 0 AND NOT fine THEN errors ELSE 0 END AS ids, CASE WHEN provider = 'click' THEN 0 WHEN provider = 'view' OR day(day) % 2 = 0 THEN errors ELSE 0 END AS accepted FROM d0),
d2 AS (SELECT *, least(matched / greatest(seen, calls, 1), greatest(1 - open / greatest(matched, 1), 0), greatest(1 - ids / greatest(matched, 1), 0))::DOUBLE AS s FROM d1),
e AS (SELECT provider, day, matched, CASE WHEN seen >= 5 AND day(day) <> 13 THEN s END AS score, CASE WHEN seen < 5 THEN 'insufficient_data' WHEN day(day) = 13 THEN 'broken' WHEN s < 1 THEN 'red' WHEN accepted > 0 THEN 'yellow' ELSE 'green' END AS state FROM d2)
"""


def oracle_sql() -> dict[str, str]:
    o = oracle
    with_, m, pred = o._with, o.MATCHES, (o.MATCHES, o.FORM, o.H2H, o.PREDICTED)
    line = ", ".join(LINE)
    firsts = lambda c, rank: f"(SELECT l_orderkey, {c} AS v, provider AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY {rank}, {line}) AS k FROM p WHERE {c} IS NOT NULL)"
    poisson = " + ".join(f"CASE WHEN u >= {sum(gates.math.exp(-1) / gates.math.factorial(j) for j in range(k + 1))!r}::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for k in range(12))
    return {
        "json_results": with_(m) + "SELECT match_id, home, away, home_goals, away_goals, result FROM m WHERE match_id % 10 <> 0 AND match_id % 14 <> 0",
        "loose_json_matches": with_(m) + """SELECT match_id, league, home, away, home_goals, away_goals, result, strftime(day, '%Y-%m-%d') AS kickoff,
            left(regexp_replace('open_' || replace(lower(league), ' ', '_') || '_2021-22_' || replace(lower(home), ' ', '_') || '_vs_' || replace(lower(away), ' ', '_') || '_' || strftime(day, '%Y-%m-%d'), '[^a-z0-9_]', '', 'g'), 120) AS fixture FROM m WHERE match_id % 5 <> 0""",
        "mapped_json": with_(m) + "SELECT match_id, league, home AS first, NULL::VARCHAR AS lost, away AS second, coalesce(home_shots::VARCHAR, '?') || ',' || coalesce(away_shots::VARCHAR, '?') AS shots FROM m",
        "bookmaker_rows": with_(m) + """SELECT match_id, sha256(match_id || ',' || home_goals || ',' || away_goals) AS row_hash, 'a' AS bookmaker, 1 + home_goals / 2.0::DOUBLE AS home_price, 3.0::DOUBLE AS draw_price, 1 + away_goals / 2.0::DOUBLE AS away_price FROM m WHERE home_goals > 0 AND away_goals > 0
            UNION ALL SELECT match_id, sha256(match_id || ',' || home_goals || ',' || away_goals), 'b', 2.1, 1 + away_goals, 2.9 FROM m WHERE match_id % 4 <> 0 AND away_goals > 0""",
        "best_outcome_prices": with_(o.QUOTES) + """, v AS (SELECT match_id, 'h2h' AS market, 'home' AS name, home_price AS price, bookmaker AS title FROM q UNION ALL SELECT match_id, 'h2h', 'away', away_price, bookmaker FROM q UNION ALL SELECT match_id, 'totals', 'Over', draw_price, bookmaker FROM q WHERE l_linenumber % 3 = 1)
            SELECT match_id, market, name, round(price, 6) AS price, title FROM (SELECT *, row_number() OVER (PARTITION BY match_id, market, name ORDER BY price DESC, title DESC) AS k FROM v) WHERE k = 1""",
        "page_links": r"""WITH v AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS x, generate_subscripts(regexp_extract_all(html, '<a href="/([^"]*)"', 1), 1) - 1 AS place FROM pages)
            SELECT page_id, place, 'https://pages.example/match/' || x AS base, x AS value FROM (SELECT *, row_number() OVER (PARTITION BY page_id, x ORDER BY place) AS k FROM v) WHERE k = 1 AND x <> ''""",
        "canonical_upsert": with_(m) + """, ds AS (SELECT *, row_number() OVER (PARTITION BY home, away, day ORDER BY match_id) AS k FROM m),
            st AS (SELECT lower(home) AS k_home, lower(away) AS k_away, strftime(CASE WHEN match_id % 6 = 0 THEN day + 50000 ELSE day END, '%Y-%m-%d') AS k_day, CASE WHEN match_id % 4 <> 0 THEN home_goals END AS goals, CASE WHEN match_id % 5 <> 0 THEN home_shots END AS shots, 1 AS s FROM ds WHERE k = 1),
            ba AS (SELECT lower(home) AS k_home, lower(away) AS k_away, strftime(day, '%Y-%m-%d') AS k_day, home_goals + (match_id % 9 = 0)::INT AS ng, home_shots AS ns, match_id FROM m),
            fa AS (SELECT *, coalesce(goals, first_value(ng) OVER (PARTITION BY k_home, k_away, k_day ORDER BY match_id NULLS LAST)) AS fact FROM st FULL JOIN ba USING (k_home, k_away, k_day))
            SELECT k_home, k_away, k_day, any_value(fact) AS goals, coalesce(any_value(shots), first(ns ORDER BY match_id) FILTER (ns IS NOT NULL AND ng = fact)) AS shots, count(*) FILTER (ng <> fact) AS conflicts,
              CASE WHEN bool_and(s IS NULL) THEN 'inserted' WHEN bool_and(match_id IS NULL) THEN 'untouched' WHEN bool_and(ng <> fact) THEN 'hard_conflict'
                   WHEN bool_and(goals IS NULL) OR (bool_and(shots IS NULL) AND bool_or(ns IS NOT NULL AND ng = fact)) THEN 'updated' ELSE 'unchanged' END AS action FROM fa GROUP BY k_home, k_away, k_day""",
        "field_merge": f"""WITH p AS (SELECT *, ['freelf', 'espn', 'apifootball', 'fd', 'oddsapi', 'tsdb'][l_suppkey % 6 + 1] AS provider, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 50 END AS league, CASE WHEN l_partkey % 4 <> 0 THEN l_suppkey % 40 END AS venue, CASE WHEN l_partkey % 5 <> 0 THEN l_shipdate END AS kickoff, CASE WHEN l_suppkey % 6 = 0 THEN l_partkey END AS freelf_id, CASE WHEN l_partkey % 2 <> 0 THEN l_returnflag END AS status FROM lineitem),
            a AS (SELECT l_orderkey, string_agg(DISTINCT provider, ',' ORDER BY provider) AS sources, count(*) AS merges FROM p GROUP BY 1)
            SELECT a.*, l.v AS league, l.b AS league_from, w.v AS venue, w.b AS venue_from, t.v AS kickoff, t.b AS kickoff_from, f.v AS freelf_id, s.v AS status FROM a
            LEFT JOIN {firsts("league", "CASE provider WHEN 'fd' THEN 2 ELSE 1 END")} l ON l.l_orderkey = a.l_orderkey AND l.k = 1
            LEFT JOIN {firsts("venue", "CASE provider WHEN 'freelf' THEN 1 WHEN 'espn' THEN 2 WHEN 'apifootball' THEN 3 WHEN 'fd' THEN 4 ELSE 5 END")} w ON w.l_orderkey = a.l_orderkey AND w.k = 1
            LEFT JOIN {firsts("kickoff", "CASE provider WHEN 'apifootball' THEN 1 WHEN 'espn' THEN 2 WHEN 'fd' THEN 3 WHEN 'freelf' THEN 4 WHEN 'oddsapi' THEN 5 ELSE 6 END")} t ON t.l_orderkey = a.l_orderkey AND t.k = 1
            LEFT JOIN {firsts("freelf_id", "1")} f ON f.l_orderkey = a.l_orderkey AND f.k = 1
            LEFT JOIN (SELECT l_orderkey, status AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, status DESC) AS k FROM p WHERE status IS NOT NULL) s ON s.l_orderkey = a.l_orderkey AND s.k = 1""",
        "written_results": with_(m) + """, r AS (SELECT match_id, home, away, league, CASE WHEN match_id % 4 = 0 THEN day + 50000 ELSE day END AS day, home_goals, away_goals FROM m WHERE home_goals <> 4), -- the others match nothing
            
            b AS (SELECT home, away, league, day, min({'h': home_goals, 'a': away_goals}) AS x FROM r GROUP BY ALL)
            SELECT m.match_id, m.home, m.away, m.league, m.day, CASE WHEN m.match_id % 3 = 0 THEN m.home_goals WHEN x IS NOT NULL THEN x.h ELSE r.home_goals END AS home_goals, CASE WHEN m.match_id % 3 = 0 THEN m.away_goals WHEN x IS NOT NULL THEN x.a ELSE r.away_goals END AS away_goals,
              CASE WHEN m.match_id % 3 = 0 THEN 'had one' WHEN x IS NOT NULL THEN 'key' WHEN r.match_id IS NOT NULL THEN 'id' END AS found_by
            FROM m LEFT JOIN b ON b.home = m.home AND b.away = m.away AND b.league = m.league AND b.day = m.day LEFT JOIN r ON r.match_id = m.match_id""",
        "unseen_matches": with_(m) + "SELECT home, away, day, min(match_id) AS match_id, first(result ORDER BY match_id) AS result FROM m WHERE (home, away, day) NOT IN (SELECT (home, away, day) FROM m WHERE result = 'D') GROUP BY home, away, day",
        "vocabulary_drift": with_(m, RENAMED) + "SELECT count(DISTINCT raw) AS names, count(DISTINCT raw) FILTER (raw <> canon) AS renamed, count(*) FILTER (raw <> canon) AS appearances, count(DISTINCT canon) AS identities, (SELECT count(*) FROM (SELECT canon FROM v GROUP BY 1 HAVING count(DISTINCT raw) > 1)) AS broken, (SELECT count(*) FROM n) AS n_rows, (SELECT count(*) FROM n WHERE home <> canon) AS touched, (SELECT count(*) FROM hit) AS collisions FROM v",
        "rename_plan": with_(m, RENAMED) + "SELECT match_id, canon AS home, away FROM n WHERE home <> canon AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.canon = n.canon AND hit.away = n.away AND hit.day = n.day)",
        "pooled_finishing": with_(m) + ", s AS (SELECT unnest(['all', CASE WHEN league IN ('EUROPE', 'ASIA') THEN 'inside' ELSE 'outside' END, league]) AS scope, gf, shots FROM t WHERE shots IS NOT NULL) SELECT scope, round(sum(gf) / nullif(sum(shots), 0), 6) AS ratio, count(*) AS n FROM s GROUP BY scope",
        "equivalence_scores": with_(o.CALLS, EVALUATED) + "SELECT provider, day, round(score, 6) AS score, state FROM e",
        "migration_gate": with_(o.CALLS, EVALUATED) + """, g AS (SELECT *, CASE WHEN day(day) % 2 = 0 THEN 'even' ELSE 'odd' END AS entity FROM e),
            s AS (SELECT provider, entity, CAST(coalesce(sum(matched) FILTER (state IN ('red', 'yellow', 'green')), 0) AS BIGINT) AS total_matched, count(*) FILTER (state IN ('red', 'yellow', 'green')) AS eligible, CAST(sum(CASE WHEN provider = 'view' THEN 0 ELSE matched // 2 END) FILTER (state IN ('red', 'yellow', 'green')) AS BIGINT) AS least_provider, first(state ORDER BY day DESC) FILTER (state <> 'insufficient_data') AS health FROM g GROUP BY ALL),
            w AS (SELECT *, CASE WHEN health IS NULL THEN 0.0::DOUBLE ELSE least(total_matched / 50.0::DOUBLE, 1.0::DOUBLE, coalesce(least(least_provider / 20.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE)) END AS conf FROM s WHERE health IS NOT NULL OR eligible > 0)
            SELECT provider, entity, total_matched, eligible, health, least_provider, round(conf, 6) AS confidence, CASE WHEN health IS NULL THEN 'GRAY' WHEN health IN ('red', 'broken') THEN 'FAIL' WHEN conf >= 1 THEN 'PASS' ELSE 'GRAY' END AS verdict FROM w""",
        "readiness": with_(o.CALLS) + """, w(provider, share) AS (VALUES ('click', 0.9::DOUBLE), ('view', 0.9), ('error', 0.99), ('nobody', 0.9)),
            v AS (SELECT w.provider, any_value(share) AS share, count(DISTINCT CAST(called_at AS DATE)) AS days, count(event_id) AS total, count(*) FILTER (event_id % 20 <> 3) AS identical, count(*) FILTER (event_id % 20 = 3) AS different, 0::BIGINT AS unavailable
                  FROM w LEFT JOIN c ON c.provider = w.provider AND event_id % 17 <> 0 AND (w.provider <> 'view' OR day(called_at) % 7 = 0) GROUP BY w.provider)
            SELECT provider, days, total, CASE WHEN total > 0 THEN identical ELSE 0 END AS identical, different, unavailable, round(identical / nullif(total, 0), 6) AS rate, CASE WHEN total = 0 THEN 'no data' WHEN days < 14 OR total < 300 THEN 'sample too small' WHEN identical / total >= share THEN 'ready in part' ELSE 'rate too low' END AS verdict FROM v""",
        "stale_decisions": with_(o.CALLS) + ", v AS (SELECT ['pending', 'approved', 'applied'][event_id % 3 + 1] AS was, called_at + INTERVAL 7 DAY < TIMESTAMP '2024-01-20' AS late FROM c) SELECT was, CASE WHEN late AND was = 'pending' THEN 'expired' WHEN late AND was = 'approved' THEN 'orphaned' ELSE was END AS status, count(*) AS n FROM v GROUP BY 1, 2",
        "kickoff_windows": with_(o.CALLS) + "SELECT event_id, event_id % 11 <> 0 AND called_at BETWEEN TIMESTAMP '2024-01-09 12:00:00' AND TIMESTAMP '2024-01-17 12:00:00' AS inside, event_id % 11 <> 0 AND called_at > TIMESTAMP '2024-01-17 12:00:00' AS beyond FROM c",
        "week_matches": with_(m) + "SELECT league, count(*) AS n, min(day) AS since, max(day) AS until FROM m WHERE league IN ('EUROPE', 'ASIA', 'AFRICA') AND day >= DATE '1998-05-11' AND day < DATE '1998-05-18' GROUP BY league",
        "special_bets": with_(*pred) + """, gg AS (SELECT *, home_xg + away_xg AS g, (1 - exp(-home_xg)) * (1 - exp(-away_xg)) AS bt FROM p), y AS (SELECT *, exp(-g) * (1 + g + g * g / 2) AS un FROM gg),
            k2 AS (SELECT match_id, unnest([{'market': 'over 2.5', 'p': 1 - un, 'o': 1.6::DOUBLE}, {'market': 'under 2.5', 'p': un, 'o': 1.9}, {'market': 'both', 'p': bt, 'o': 1.8}, {'market': 'not both', 'p': 1 - bt, 'o': 2.0}, {'market': '1X', 'p': p_home + p_draw, 'o': 1.3}, {'market': 'X2', 'p': p_draw + p_away, 'o': 1.7}], recursive := true) FROM y),
            ed AS (SELECT match_id, market, p, (p * (match_id % 7 / 10.0::DOUBLE + o - 0.6::DOUBLE) - 1) * 100 AS raw, match_id % 7 / 10.0::DOUBLE + o - 0.6::DOUBLE AS price FROM k2)
            SELECT match_id, market, round(p * 100, 1) AS percent, round(raw, 2) AS edge, CASE WHEN round(raw, 9) >= 25 THEN 'elite' WHEN round(raw, 9) >= 15 THEN 'high' WHEN round(raw, 9) >= 8 THEN 'medium' ELSE 'low' END AS rating FROM ed WHERE price > 1 AND round(raw, 9) >= 5""",
        "paired_trials": with_(*pred) + f""", df AS (SELECT p.match_id, p.league, (home_xg - home_goals) * (home_xg - home_goals) - (1.4::DOUBLE - home_goals) * (1.4::DOUBLE - home_goals) AS d FROM p JOIN m ON m.match_id = p.match_id),
            cs AS (SELECT league, 1 AS n, d, ('0x' || substr(md5('1|' || match_id), 1, 8))::BIGINT & 2147483647 AS one, ('0x' || substr(md5('1|' || match_id), 9, 8))::BIGINT & 2147483647 AS two FROM df),
            z1 AS (SELECT league, n, d, two, range AS rep, (xor(one, (range * 1103515245) & 2147483647) * 1540483477) & 2147483647 AS z FROM cs, range(2000)),
            z2 AS (SELECT * REPLACE ((xor(xor(z, z >> 15), two) * 1274126177) & 2147483647 AS z) FROM z1), z3 AS (SELECT * REPLACE ((xor(z, z >> 13) * 2027808485) & 2147483647 AS z) FROM z2),
            rp AS (SELECT league, n, d, rep, xor(z, z >> 16) / 2147483648.0::DOUBLE AS u FROM z3), w AS (SELECT *, {poisson} AS w FROM rp),
            s AS (SELECT league, rep, sum(n) AS n, sum(d) / sum(n) AS mean, sum(w * d) / nullif(sum(w * n), 0) AS boot, sum(CASE WHEN u < 0.5 THEN d ELSE -d END) / sum(n) AS flip FROM w GROUP BY 1, 2),
            f2 AS (SELECT league, CAST(max(n) AS BIGINT) AS n, max(mean) AS delta, list_sort(list(boot)) AS b, avg((flip <= mean)::INT::DOUBLE) AS p_value FROM s GROUP BY league)
            SELECT league, n, round(delta, 6) AS delta, round(b[51], 6) AS low, round(b[1951], 6) AS high, round(p_value, 6) AS p_value, b[1951] < 0 AS better, p_value < 0.05 AS better_by_flips FROM f2""",
    }
