"""Registered queries of fitted models, HTML nodes, state machines, champions, identities, explanations, streams' tables and filters, with their SQL written apart."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import champions, evaluate, explain, features, filters, health, html, identity, machines, merge, payloads, pricing, walk_forward
from ..sources import bridge, csv_files
from ..streaming import late, periods, running
from ..workers import checkpointed, scratch
from . import oracle
from .queries import _matches, _predicted, _teams, places

MODEL = ["home_form", "away_form", "home_for", "away_for", "home_against", "away_against", "home_shots_avg", "away_shots_avg", "modifier", "home_rest", "away_rest"]


def _training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, day, result, segment and the features known before each match, null where there are none."""
    # The matches are planned once: each side goes through the team's windows with what the match carries, and both meet again in one grouping.
    # ``modifier`` is also what rest_days calls its own.
    carried = ("day", "home", "away", "result", "of_meetings")
    x = features.with_meetings(_matches(spark, sf_dir)).withColumn("of_meetings", F.when(F.col("meetings") > 0, F.col("modifier")))
    side = lambda own, other, home: F.struct(F.col(own).alias("team"), F.lit(home).alias("is_home"), F.col(f"{own}_goals").alias("gf"), F.col(f"{other}_goals").alias("ga"), F.col(f"{own}_shots").alias("shots"))
    x = x.select("match_id", *carried, F.inline(F.array(side("home", "away", True), side("away", "home", False))))
    x = x.withColumn("outcome", F.when(F.col("gf") > F.col("ga"), "W").when(F.col("gf") < F.col("ga"), "L").otherwise("D"))
    keep = (*carried, "is_home")
    x = features.form(x, keep=(*keep, "shots")).withColumn("form", F.when(F.col("n_form") > 0, F.col("form_score")))
    seen = ("form", "avg_for", "avg_against")
    x = features.rest_days(features.rolling_shots(x, keep=(*keep, *seen)), (*keep, *seen, "avg_shots"))
    named = {"form": "form", "avg_for": "for", "avg_against": "against", "avg_shots": "shots_avg", "rest_days": "rest"}
    of = lambda s, home: [F.max(F.when(F.col("is_home") == home, F.col(c))).alias(f"{s}_{n}") for c, n in named.items()]
    x = x.repartition("match_id").groupBy("match_id", *carried).agg(*of("home", True), *of("away", False))
    # Written before the days are counted, which would work everything out again.
    return evaluate.walk_forward(checkpointed(x.withColumnRenamed("of_meetings", "modifier")), ["match_id"])


def walk_forward_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's model judged on what came after it, and the temperature that fits all of them."""
    rows = checkpointed(_training_rows(spark, sf_dir))
    models = walk_forward.fit(rows, MODEL)
    predicted = checkpointed(walk_forward.predict(rows.select("segment", "result", *MODEL), models, MODEL).drop(*MODEL))
    t = walk_forward.fit_temperature(predicted)
    return places(walk_forward.judged(predicted, models).withColumn("temperature", F.lit(t).cast("double")), 4)


def walk_forward_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(walk_forward.baseline(evaluate.walk_forward(_matches(spark, sf_dir), ["match_id"])))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written out once: each selection is a join of several readings, and every one of them would parse all pages again."""
    return checkpointed(html.nodes(bridge.table(spark, sf_dir, "pages")))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(_nodes(spark, sf_dir))


def html_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.items(_nodes(spark, sf_dir))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and paragraphs of every page, those whose tags are never closed too."""
    return html.blocks(_nodes(spark, sf_dir))


STATES = list(machines.CHALLENGER)


def challenger_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of each user's events read as steps of a challenger."""
    e = bridge.table(spark, sf_dir, "events")
    target = F.element_at(F.array(*map(F.lit, [*STATES, "?"])), (F.col("event_id") % 7 + 1).cast("int"))
    return machines.replay(e.withColumn("target", target), machines.CHALLENGER, "CREATED", "user_id", "ts", "event_id", "target")


def _champion_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir).where("match_id % 37 = 0")
    return m.select(F.col("league").alias("scope"), F.col("day").cast("timestamp").alias("at"), F.col("match_id").alias("seq"), F.expr("if(match_id % 111 = 0, 'rollback', 'promote')").alias("kind"), F.concat(F.lit("run "), F.col("match_id") % 5).alias("run"))


def champion_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = champions.periods(_champion_log(spark, sf_dir))
    return p.select("scope", "run", F.to_date("since").alias("since"), F.to_date("until").alias("until"), "predecessor", "began")


def champion_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule-based probabilities against those of the champion of each match's day, which trusts a third each the more, the higher its number."""
    rows = champions.as_of(_predicted(spark, sf_dir), champions.periods(_champion_log(spark, sf_dir)), "league", "day").where("champion is not null")
    w = F.substring("champion", 5, 9).cast("double") / 10
    rows = rows.withColumns({f"c_{k}": (1 - w) * F.col(f"p_{k}") + w / 3 for k in ("home", "draw", "away")})
    return places(champions.compare(rows, ["champion"], ("p_home", "p_draw", "p_away"), ("c_home", "c_draw", "c_away")), 4)


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each match as three sources saw it: the second under its provider's number, the third with the names only; some contradict."""
    m = _matches(spark, sf_dir)
    of = lambda id_, home, ref, goals, shots, rank: F.struct(F.expr(id_).alias("id"), F.expr(home).alias("home"), "away", "day", F.expr(ref).alias("ref"), F.expr(goals).alias("goals"), F.expr(shots).alias("home_shots"), F.expr(rank).alias("rank"))
    one = of("match_id * 3", "home", "match_id % 997", "home_goals", "home_shots", "1")
    two = of("match_id * 3 + 1", "home || ' fc'", "match_id % 997", "if(match_id % 13 = 0, home_goals + 1, home_goals)", "away_shots", "2")
    three = of("match_id * 3 + 2", "home", "cast(null as bigint)", "if(match_id % 7 = 0, null, if(match_id % 11 = 0, home_goals + 2, home_goals))", "match_id % 6", "if(match_id % 50 = 0, null, 3)")
    return m.select(F.inline(F.array(one, two, three)))


def identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources tied by names and day, and by day, away side and a provider's number."""
    rows = checkpointed(_sightings(spark, sf_dir))
    grouped = identity.groups(rows, {"names": ["home", "away", "day"], "number": ["away", "day", "ref"]}, ["goals"])
    x = identity.reconciled(rows, grouped, "rank", ["goals", "home_shots"])
    return x.select("root", "rows", F.col("canonical").cast("string").alias("canonical"), F.array_join(F.transform("superseded", lambda i: i.cast("string")), ",").alias("superseded"), F.array_join("gaps", ",").alias("gaps"), "refused")


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The home side's probability by factor; absences take 8 % of the home side's goals in some matches."""
    m = _matches(spark, sf_dir)
    attack, defence = pricing.team_rating(F.col("avg_for"), F.col("avg_against"))
    sides = features.form(bridge.team_matches(m)).select("match_id", "team", attack.alias("att"), defence.alias("def"), F.col("form_score").alias("form"))
    of = lambda s: sides.select("match_id", F.col("team").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("att", "def", "form")))
    x = m.select("match_id", "home", "away").join(of("home"), ["match_id", "home"]).join(of("away"), ["match_id", "away"]).join(features.head_to_head(m).select("match_id", "meetings", "modifier"), "match_id")
    strong = lambda c, by: F.round(F.col(c) * (1 + F.col("match_id") % 3 * by), 4)
    x = x.withColumns({"home_elo_att": strong("home_att", 0.05), "home_elo_def": strong("home_def", -0.05), "away_elo_att": F.lit(None).cast("double"), "away_elo_def": F.lit(None).cast("double")})
    home = scoring.expected_goals(F.col("home_elo_att"), F.col("away_def"), F.col("home_form"), 1.12, F.col("modifier"), F.col("meetings"), 1)
    x = x.withColumns({"home_xg": F.when(F.col("match_id") % 4 == 0, F.round(F.round(home * 0.92, 10), 4)), "away_xg": F.lit(None).cast("double")})
    return places(explain.waterfall(x))


def provider_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = running.running_table(bridge.provider_calls(spark, sf_dir))
    return places(x.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_call", "last_success", "last_failure")}))


def volume_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.trigger_table(_matches(spark, sf_dir), 50)


def _kickoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select(F.col("match_id").alias("fixture_id"), "home", "away", (F.col("day").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 15, match_id % 60)")).alias("kickoff"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results from zero to nine days after the kickoff; every fourth is reported again a day later with another score."""
    k = _kickoffs(spark, sf_dir).select("home", "away", "kickoff", F.col("fixture_id").alias("n"))
    first = k.select("home", "away", "kickoff", (F.col("n") % 4).alias("home_goals"), F.expr("if(n % 29 = 0, null, n % 3)").alias("away_goals"), (F.col("kickoff") + F.expr("make_interval(0, 0, 0, n % 10, 2)")).alias("reported_at"), "n")
    again = first.where("n % 4 = 0").withColumns({"home_goals": F.col("home_goals") + 1, "reported_at": F.col("reported_at") + F.expr("interval 1 day")})
    return first.unionByName(again).drop("n")


def late_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures with their result in time, by day: how many, and the goals they brought."""
    x = late.matched(_kickoffs(spark, sf_dir), _results(spark, sf_dir))
    per_day = x.groupBy(F.to_date("kickoff").alias("day")).agg(F.count("*").alias("matched"), F.sum(F.col("home_goals") + F.col("away_goals")).alias("goals"))
    return places(per_day.join(late.late_counts(_results(spark, sf_dir)), "day", "full").select("day", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("goals", F.lit(0)).alias("goals"), F.coalesce("late", F.lit(0)).alias("late")))


def _engine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two engines on the same matches; the second says nothing about some."""
    x = _predicted(spark, sf_dir)
    second = lambda k: F.when(F.col("match_id") % 6 != 0, 0.7 * F.col(f"p_{k}") + 0.1)
    return x.select("day", "result", *(F.col(f"p_{k}").alias(f"rule_{k}") for k in ("home", "draw", "away")), *(second(k).alias(f"mixed_{k}") for k in ("home", "draw", "away")))


def period_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(periods.reports(_engine_rows(spark, sf_dir)), 4)


#: One document for each probe of the reference: by league, by side, missing results, recent and priced matches and the like.
DOCUMENTS = {
    "one_league": {"league": {"eq": "EUROPE"}},
    "either_side": {"or": [{"home": {"eq": "NATION_7"}}, {"away": {"eq": "NATION_7"}}]},
    "pair": {"or": [{"and": [{"home": {"eq": "NATION_7"}}, {"away": {"eq": "NATION_18"}}]}, {"and": [{"home": {"eq": "NATION_18"}}, {"away": {"eq": "NATION_7"}}]}]},
    "without_shots": {"or": [{"home_shots": {"is": None}}, {"away_shots": {"is": None}}]},
    "with_shots": {"home_shots": {"not_is": None}, "away_shots": {"not_is": None}},
    "few_shots": {"home_shots": {"not_in": [3, 4, 5]}},
    "some_shots": {"home_shots": {"in": [3, None, 5]}},
    "unlike": {"not": {"home_shots": {"gt": 5}}},
    "window": {"day": {"gte": "1996-01-01", "lt": "1997-01-01"}, "result": {"neq": "D"}},
    "named": {"home": {"ilike": "nation_1%"}, "away": {"not_like": "%2"}},
    "nothing": {"or": []},
    "listed": {"match_id": {"in": list(range(0, 3000, 7))}, "league": {"not_in": ["ASIA", "AFRICA"]}},
    "unlisted": {"home_shots": {"not_in": [*range(4), *range(20, 300)]}},
}


def filter_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that each of the documents lets pass."""
    m = _matches(spark, sf_dir)
    out = None
    for name, document in DOCUMENTS.items():
        x = filters.matching(m, document).agg(F.count("*").alias("n"), F.sum("match_id").alias("ids")).select(F.lit(name).alias("name"), "n", F.coalesce("ids", F.lit(0)).alias("ids"))
        out = x if out is None else out.unionByName(x)
    return out


def shadow_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations that were only watched: all, by provider, by day, and what told for the changed ones."""
    x = bridge.provider_calls(spark, sf_dir).select(F.to_date("called_at").alias("day"), F.expr("if(event_id % 17 = 0, '', provider)").alias("recommended"), (F.col("event_id") % 20 == 3).alias("changed"), F.expr("map('speed', event_id % 7 / 10D, 'cost', if(event_id % 3 = 0, null, event_id % 5 / 10D))").alias("deltas"))
    return places(health.shadow_report(x))


FEATURES = ["home_form", "away_form", "home_for", "modifier"]


def feature_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features replayed over all matches, into rows that lack some and hold others of another run, which stay."""
    m = _matches(spark, sf_dir)
    f = features.form(bridge.team_matches(m))
    of = lambda s: f.select("match_id", F.col("team").alias(s), F.col("form_score").alias(f"{s}_form"), F.col("avg_for").alias(f"{s}_for"))
    new = features.with_meetings(m).select("match_id", "home", "away", "modifier").join(of("home"), ["match_id", "home"]).join(of("away"), ["match_id", "away"])
    kept = lambda c, n: F.when(F.col("match_id") % n != 0, F.col(c) + F.when(F.col("match_id") % 4 == 1, 1.0).otherwise(0.0)).alias(c)
    stored = new.select("match_id", *(kept(c, n) for c, n in zip(FEATURES, (2, 3, 5, 7), strict=True)))
    return places(merge.backfill(stored, new, "match_id", FEATURES))


def training_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 known results before a match, the newest first."""
    m = _matches(spark, sf_dir).where(filters.condition({"result": {"in": ["H", "D", "A"]}})).select("match_id", "day", "league", "home", "away", "result")
    return filters.page(m, [("day", True), ("match_id", True)], 500, {"day": date(1998, 6, 30), "match_id": 0})


def league_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each league from the first of three sources that has the league."""
    m = _matches(spark, sf_dir)
    sources = [("database", m.where("league in ('ASIA', 'EUROPE') and match_id % 3 = 0")), ("provider", m.where("league <> 'AFRICA' and match_id % 2 = 0")), ("archive", m)]
    x = filters.first_that_covers(sources, bridge.table(spark, sf_dir, "region").select(F.col("r_name").alias("league")), "league")
    return x.groupBy("league", "source").agg(F.count("*").alias("n"), F.min("day").alias("since"))


def _csv_folder(spark: SparkSession, sf_dir: str) -> str:
    """The matches as CSV files in the shared folder, a folder a league; one league's files name no sides."""
    m = _matches(spark, sf_dir)
    path = scratch(spark)
    x = m.select(F.col("league").alias("part"), F.col("day").alias("Date"), F.col("home").alias("HomeTeam"), F.concat(F.lit('say "'), "away", F.lit('", x')).alias("AwayTeam"), F.when(F.col("match_id") % 9 != 0, F.col("home_goals")).alias("FTHome"), (F.col("away_goals") + 0.5).alias("OddHome"), F.expr("if(match_id % 2 = 0, string(match_id), 'n' || match_id)").alias("Code"))
    x.where("part <> 'ASIA'").write.partitionBy("part").option("header", True).option("escape", '"').csv(f"{path}/a")
    x.where("part = 'ASIA'").select("part", "Date", F.col("HomeTeam").alias("Club"), F.col("FTHome").alias("Elo")).write.partitionBy("part").option("header", True).csv(f"{path}/b")
    return path


def csv_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of each league hold."""
    x = csv_files.inspect(spark, _csv_folder(spark, sf_dir))
    league = F.url_decode(F.regexp_extract("path", "part=([^/]*)", 1)).alias("league")
    return x.groupBy(league, "kind", F.array_join("columns", ",").alias("columns"), F.array_join("missing", ",").alias("missing")).agg(F.sum("n_rows").alias("n"))


def csv_column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each column in each league's files, from all their cells."""
    x = csv_files.types(spark, _csv_folder(spark, sf_dir))
    league = F.url_decode(F.regexp_extract("path", "part=([^/]*)", 1)).alias("league")
    return x.groupBy(league, "place", "column", "kind").agg(F.sum("n").alias("n"), F.sum("n_unknown").alias("n_unknown")).withColumn("place", F.col("place").cast("long"))


NAMES = {f"nation_{k}": f"Nation {k}" for k in range(25)}


def team_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as sources write them, and some that no alias knows."""
    m = _matches(spark, sf_dir)
    raw = F.expr("""case match_id % 8 when 0 then concat(' ', home, ' ') when 1 then replace(home, 'NATION', 'Nátion') when 2 then concat(home, ' (ESP)') when 3 then concat(lower(home), ' Football Club') when 4 then concat('FC ', home)
                    when 5 then concat('afc ', home, ' SK') when 6 then concat(home, ' (Spain)') else concat('real ', home) end""")
    return m.select("match_id", raw.alias("raw"), text.team_name(raw, NAMES).alias("name"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's matches as five providers would send them, some fields under another name or missing. The matches are grouped once."""
    m = _matches(spark, sf_dir).withColumn("at", F.expr("concat(string(day), 'T', lpad(string(match_id % 24), 2, '0'), ':30:00')"))
    shapes = {
        "fd": ("matches", "named_struct('id', r.match_id, 'competition', named_struct('name', r.league), 'homeTeam', named_struct('name', r.home), 'awayTeam', named_struct('name', if(r.match_id % 17 = 0, '', r.away)), 'utcDate', r.at || 'Z', 'status', if(r.match_id % 3 = 0, 'SCHEDULED', 'FINISHED'), 'score', named_struct('fullTime', named_struct('home', r.home_goals, 'away', r.away_goals)))"),
        "espn": ("events", "named_struct('id', string(r.match_id), 'season', named_struct('slug', r.league), 'date', r.at || 'Z', 'status', named_struct('type', named_struct('state', if(r.match_id % 4 = 0, 'in', 'post'))), 'competitions', array(named_struct('competitors', array(named_struct('team', named_struct('displayName', r.home), 'score', string(r.home_goals)), named_struct('team', named_struct('displayName', r.away), 'score', if(r.match_id % 5 = 0, 'x', string(r.away_goals)))))))"),
        "tsdb": ("events", "named_struct('idEvent', r.match_id, 'strLeague', r.league, 'strHomeTeam', r.home, 'strAwayTeam', r.away, 'strTimestamp', if(r.match_id % 6 = 0, null, r.at), 'dateEvent', if(r.match_id % 12 = 0, 'soon', string(r.day)), 'strStatus', 'Match Finished', 'intHomeScore', r.home_goals, 'intAwayScore', r.away_goals)"),
        "freelf": ("data", "named_struct('eventId', r.match_id, 'leagueId', r.league, 'homeTeam', named_struct('name', r.home), 'awayTeam', named_struct('name', r.away), 'startTimestamp', unix_timestamp(to_timestamp(r.at)), 'status', named_struct('type', if(r.match_id % 7 = 0, 'inprogress', 'finished')), 'homeScore', named_struct('current', r.home_goals), 'awayScore', named_struct('current', r.away_goals))"),
        "oddsapi": ("events", "named_struct('id', string(r.match_id), 'sport_key', r.league, 'home_team', r.home, 'away_team', r.away, 'commence_time', r.at || 'Z', 'completed', r.match_id % 8 <> 0, 'scores', array(named_struct('name', r.away, 'score', string(r.away_goals)), named_struct('name', r.home, 'score', string(r.home_goals))))"),
    }
    rows = m.groupBy("day").agg(F.collect_list(F.struct("match_id", "day", "at", "league", "home", "away", "home_goals", "away_goals")).alias("rows"))
    each = (F.expr(f"named_struct('provider', '{name}', 'doc', to_json(named_struct('{items}', transform(rows, r -> {event}))))") for name, (items, event) in shapes.items())
    return rows.select(F.inline(F.array(*each)))


def provider_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures out of five providers' payloads in one shape."""
    x = payloads.fixtures(_payloads(spark, sf_dir), "doc", "provider")
    return x.withColumn("kickoff", F.date_format("kickoff", "yyyy-MM-dd HH:mm"))


def provider_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of leagues and seasons out of payloads, whose names differ from season to season."""
    t = features.standings(_teams(spark, sf_dir))
    old = F.expr("named_struct('position', rank, 'team', named_struct('name', team), 'played', played, 'points', points, 'goalsFor', goals_for, 'goalsAgainst', goals_for - goal_difference, 'form', 'W,D-L')")
    new = F.expr("named_struct('rank', rank, 'team', named_struct('name', team), 'matches', string(played), 'points', string(points), 'goals_for', goals_for, 'goals_against', goals_for - goal_difference)")
    docs = t.groupBy("league", "season").agg(F.to_json(F.struct(F.collect_list(old).alias("standing"))).alias("a"), F.to_json(F.struct(F.collect_list(new).alias("response"))).alias("b")).select("league", "season", F.when(F.col("season") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("doc"))
    return places(payloads.standings(docs, "doc", ["league", "season"]).select("league", "season", "position", "team", "played", "points", "for_mean", "against_mean", "form"))


def provider_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each pair, seen from the first by name, out of payloads of all their matches."""
    m = _matches(spark, sf_dir)
    e = F.expr("named_struct('homeTeam', named_struct('name', home), 'awayTeam', named_struct('name', away), 'homeScore', if(match_id % 10 = 0, null, named_struct('current', home_goals)), 'awayScore', named_struct('current', string(away_goals)))")
    docs = m.groupBy(F.least("home", "away").alias("one"), F.greatest("home", "away").alias("two")).agg(F.to_json(F.struct(F.collect_list(e).alias("matches"))).alias("doc"))
    return payloads.meetings(docs, "doc", ["one", "two"], "one", "two")


QUERIES = (walk_forward_fit, walk_forward_baseline, html_links, html_items, html_blocks, challenger_states, champion_periods, champion_comparison, identity_groups, explained, provider_running, volume_triggers, late_results, period_reports, filter_documents, league_cascade, feature_backfill, training_page, shadow_report, csv_inspection, csv_column_types, team_names, provider_fixtures, provider_standings, provider_meetings)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def _links_sql(item: bool) -> str:
    """Links stand only in lists on these pages, and nothing nests."""
    found = "regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1) AS hrefs, regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) AS texts"
    text = "trim(regexp_replace(replace(replace(replace(replace(texts[i], '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text"
    cols = "page_id, 1::BIGINT AS list, i AS place" if item else "page_id, i AS place, hrefs[i] AS href"
    return f"SELECT {cols}, {text} FROM (SELECT page_id, hrefs, texts, unnest(range(1, len(texts) + 1)) AS i FROM (SELECT page_id, {found} FROM pages))"


def _states_sql() -> str:
    moves = ", ".join(f"('{a}', '{b}')" for a, to in machines.CHALLENGER.items() for b in to)
    names = ", ".join(f"'{s}'" for s in [*STATES, "?"])
    return f"""
WITH RECURSIVE moves(a, b) AS (VALUES {moves}),
e AS (SELECT user_id, ts, event_id, [{names}][event_id % 7 + 1] AS target, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, 0::BIGINT AS k, 'CREATED' AS state, 0::BIGINT AS refused, NULL::TIMESTAMP AS refused_at, NULL::BIGINT AS refused_tie, NULL::VARCHAR AS refused_from FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT r.user_id, e.k, CASE WHEN m.b IS NULL THEN r.state ELSE e.target END, r.refused + CASE WHEN m.b IS NULL THEN 1 ELSE 0 END,
         CASE WHEN r.refused = 0 AND m.b IS NULL THEN e.ts ELSE r.refused_at END, CASE WHEN r.refused = 0 AND m.b IS NULL THEN e.event_id ELSE r.refused_tie END, CASE WHEN r.refused = 0 AND m.b IS NULL THEN r.state ELSE r.refused_from END
  FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1 LEFT JOIN moves m ON m.a = r.state AND m.b = e.target)
SELECT CAST(user_id AS VARCHAR) AS entity, k AS steps, refused, state, refused_at, refused_tie, refused_from FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1"""


LOG = """
lg AS (SELECT league AS scope, day, match_id AS seq, CASE WHEN match_id % 111 = 0 THEN 'rollback' ELSE 'promote' END AS kind, 'run ' || match_id % 5 AS run, row_number() OVER (PARTITION BY league ORDER BY day, match_id) AS k FROM m WHERE match_id % 37 = 0),
cr AS (SELECT scope, 0::BIGINT AS k, NULL::VARCHAR AS one, NULL::VARCHAR AS two, NULL::VARCHAR AS began, NULL::DATE AS since, false AS moved FROM (SELECT DISTINCT scope FROM lg)
  UNION ALL
  SELECT l.scope, l.k, CASE WHEN l.kind = 'promote' THEN l.run WHEN c.two IS NOT NULL THEN c.two ELSE c.one END, CASE WHEN l.kind = 'promote' THEN c.one WHEN c.two IS NOT NULL THEN c.one ELSE c.two END,
         l.kind, l.day, l.kind = 'promote' OR c.two IS NOT NULL FROM cr c JOIN lg l ON l.scope = c.scope AND l.k = c.k + 1),
cp AS (SELECT scope, one AS run, since, lead(since) OVER (PARTITION BY scope ORDER BY k) AS until, two AS predecessor, began, k FROM cr WHERE moved)
"""
SIGHTINGS = """
s AS (SELECT match_id * 3 AS id, home, away, day, match_id % 997 AS ref, home_goals AS goals, home_shots, 1 AS rank FROM m
  UNION ALL SELECT match_id * 3 + 1, home || ' fc', away, day, match_id % 997, CASE WHEN match_id % 13 = 0 THEN home_goals + 1 ELSE home_goals END, away_shots, 2 FROM m
  UNION ALL SELECT match_id * 3 + 2, home, away, day, NULL, CASE WHEN match_id % 7 = 0 THEN NULL WHEN match_id % 11 = 0 THEN home_goals + 2 ELSE home_goals END, match_id % 6, CASE WHEN match_id % 50 = 0 THEN NULL ELSE 3 END FROM m)
"""


def _identity_sql(base: str) -> str:
    """Two kinds tie three sources: least ids are handed on along both until nothing changes."""
    return base.replace("WITH", "WITH RECURSIVE", 1) + f""", {SIGHTINGS},
ev AS (SELECT id, 'n' AS kind, home || '|' || away || '|' || day AS v FROM s UNION ALL SELECT id, 'r', away || '|' || day || '|' || ref FROM s WHERE ref IS NOT NULL),
ed AS (SELECT DISTINCT x.id AS a, y.id AS b FROM ev x JOIN ev y ON x.kind = y.kind AND x.v = y.v),
re AS (SELECT a, a AS b FROM ed UNION SELECT r.a, e.b FROM re r JOIN ed e ON e.a = r.b),
g1 AS (SELECT a AS id, min(b) AS root FROM re GROUP BY a),
t1 AS (SELECT root, count(DISTINCT goals) > 1 AS torn FROM s JOIN g1 USING (id) GROUP BY root),
l2 AS (SELECT s.* FROM s JOIN g1 USING (id) JOIN t1 USING (root) WHERE torn),
g2 AS (SELECT id, min(id) OVER (PARTITION BY home, away, day) AS root FROM l2),
t2 AS (SELECT root, count(DISTINCT goals) > 1 AS torn FROM s JOIN g2 USING (id) GROUP BY root),
g AS (SELECT id, root, false AS refused FROM g1 JOIN t1 USING (root) WHERE NOT torn
      UNION ALL SELECT id, CASE WHEN torn THEN id ELSE root END, torn FROM g2 JOIN t2 USING (root)),
j AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY coalesce(rank, 1 << 30), id) AS o, bool_or(rank IS NULL) OVER (PARTITION BY root) AS unknown FROM s JOIN g USING (id))
SELECT root, count(*) AS rows, CASE WHEN any_value(unknown) THEN NULL ELSE CAST(max(CASE WHEN o = 1 THEN id END) AS VARCHAR) END AS canonical,
       CASE WHEN any_value(unknown) THEN NULL ELSE coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (o > 1), '') END AS superseded,
       CASE WHEN any_value(unknown) THEN NULL ELSE concat_ws(',', CASE WHEN bool_or(goals IS NOT NULL) AND NOT bool_or(o = 1 AND goals IS NOT NULL) THEN 'goals' END, CASE WHEN bool_or(home_shots IS NOT NULL) AND NOT bool_or(o = 1 AND home_shots IS NOT NULL) THEN 'home_shots' END) END AS gaps,
       any_value(refused) AS refused FROM j GROUP BY root"""


EXPLAINED = """
z AS (SELECT m.match_id, g.meetings, g.modifier, a.form_score AS hf, b.form_score AS af, a.att AS ha, a.def AS hd, b.att AS aa, b.def AS ad,
        round(a.att * (1 + m.match_id % 3 * 0.05::DOUBLE), 4) AS hae, round(a.def * (1 + m.match_id % 3 * (-0.05::DOUBLE)), 4) AS hde
      FROM m JOIN g USING (match_id) JOIN r a ON a.match_id = m.match_id AND a.team = m.home JOIN r b ON b.match_id = m.match_id AND b.team = m.away),
y AS (SELECT *, ha * (0.6::DOUBLE + ad / 2.5::DOUBLE * 0.8::DOUBLE) * 1.35::DOUBLE AS h0, aa * (0.6::DOUBLE + hd / 2.5::DOUBLE * 0.8::DOUBLE) * 1.35::DOUBLE AS a0,
        hae * (0.6::DOUBLE + ad / 2.5::DOUBLE * 0.8::DOUBLE) * 1.35::DOUBLE AS h1, aa * (0.6::DOUBLE + hde / 2.5::DOUBLE * 0.8::DOUBLE) * 1.35::DOUBLE AS a1,
        0.6::DOUBLE * (0.8::DOUBLE + hf * 0.4::DOUBLE) + 0.4::DOUBLE AS fh, 0.6::DOUBLE * (0.8::DOUBLE + af * 0.4::DOUBLE) + 0.4::DOUBLE AS fa,
        CASE WHEN meetings >= 2 THEN 1 + modifier ELSE 1 END AS mh, CASE WHEN meetings >= 2 THEN 1 - modifier ELSE 1 END AS ma FROM z),
w AS (SELECT match_id, [h0, h1, h1 * fh, h1 * fh * 1.12::DOUBLE, h1 * fh * 1.12::DOUBLE * mh] AS hs, [a0, a1, a1 * fa, a1 * fa * 0.92::DOUBLE, a1 * fa * 0.92::DOUBLE * ma] AS bs FROM y),
st AS (SELECT match_id, i - 1 AS step, CASE WHEN i <= 2 THEN hs[i] ELSE hs[least(i, 5)] END AS h, bs[least(i, 5)] AS a, i FROM (SELECT *, unnest(range(1, 7)) AS i FROM w)),
sx AS (SELECT match_id, step, round(CAST(greatest(h, 0.2::DOUBLE) AS DECIMAL(18, 10)), 4)::DOUBLE AS h0, round(CAST(greatest(a, 0.2::DOUBLE) AS DECIMAL(18, 10)), 4)::DOUBLE AS a FROM st),
sy AS (SELECT match_id, step, CASE WHEN step = 5 AND match_id % 4 = 0 THEN round(CAST(h0 * 0.92::DOUBLE AS DECIMAL(18, 10)), 4)::DOUBLE ELSE h0 END AS h, a FROM sx),
sp AS (SELECT match_id, step, sum(CASE WHEN i.n > j.n THEN exp(-h) * pow(h, i.n) / i.nf * exp(-a) * pow(a, j.n) / j.nf ELSE 0 END) AS p FROM sy, k i, k j GROUP BY match_id, step)
SELECT match_id, step, ['statistics', 'elo', 'form', 'venue', 'meetings', 'absences'][step + 1] AS factor, round(p, 4) AS p_home, round((p - coalesce(lag(p) OVER (PARTITION BY match_id ORDER BY step), 0)) * 100, 2) AS points FROM sp"""

PERIODS = """
er AS (SELECT day, result, p_home AS rh, p_draw AS rd, p_away AS ra, CASE WHEN match_id % 6 <> 0 THEN 0.7::DOUBLE * p_home + 0.1::DOUBLE END AS mh, CASE WHEN match_id % 6 <> 0 THEN 0.7::DOUBLE * p_draw + 0.1::DOUBLE END AS md, CASE WHEN match_id % 6 <> 0 THEN 0.7::DOUBLE * p_away + 0.1::DOUBLE END AS ma FROM p),
days AS (SELECT DISTINCT d.day + CAST(o AS INTEGER) AS period_end FROM er d, range(0, 7) t(o)),
pe AS (SELECT 'daily' AS cadence, period_end, period_end AS first FROM days UNION ALL SELECT 'weekly', period_end, period_end - 6 FROM days)
SELECT cadence, period_end, count(*) AS n, count(mh) AS n_common, count(mh) AS mixed_n, round(avg(CASE WHEN mh IS NULL THEN NULL WHEN (CASE WHEN mh >= md AND mh >= ma THEN 'H' WHEN md >= ma THEN 'D' ELSE 'A' END) = result THEN 1.0::DOUBLE ELSE 0 END), 4) AS mixed_accuracy,
       round(avg(-ln(CASE result WHEN 'H' THEN mh WHEN 'D' THEN md ELSE ma END)), 4) AS mixed_log_loss,
       round(avg(pow(mh - CASE WHEN result = 'H' THEN 1 ELSE 0 END, 2) + pow(md - CASE WHEN result = 'D' THEN 1 ELSE 0 END, 2) + pow(ma - CASE WHEN result = 'A' THEN 1 ELSE 0 END, 2)), 4) AS mixed_brier,
       count(rh) AS rule_n, round(avg(CASE WHEN (CASE WHEN rh >= rd AND rh >= ra THEN 'H' WHEN rd >= ra THEN 'D' ELSE 'A' END) = result THEN 1.0::DOUBLE ELSE 0 END), 4) AS rule_accuracy,
       round(avg(-ln(CASE result WHEN 'H' THEN rh WHEN 'D' THEN rd ELSE ra END)), 4) AS rule_log_loss,
       round(avg(pow(rh - CASE WHEN result = 'H' THEN 1 ELSE 0 END, 2) + pow(rd - CASE WHEN result = 'D' THEN 1 ELSE 0 END, 2) + pow(ra - CASE WHEN result = 'A' THEN 1 ELSE 0 END, 2)), 4) AS rule_brier
FROM pe JOIN er ON er.day BETWEEN pe.first AND pe.period_end WHERE period_end <= (SELECT max(day) FROM er) - 1 AND period_end >= (SELECT min(day) FROM er) GROUP BY cadence, period_end"""


def _value(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"


def _where(document: dict) -> str:
    symbols = {"eq": "=", "neq": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "like": "LIKE", "ilike": "ILIKE"}
    parts = ["true"]
    for name, what in document.items():
        if name in ("or", "and"):
            parts.append("(" + (f" {name.upper()} ".join(map(_where, what)) or ("false" if name == "or" else "true")) + ")")
        elif name == "not":
            parts.append(f"NOT ({_where(what)})")
        else:
            for op, v in what.items():
                bare = op.removeprefix("not_")
                test = f"{name} IN ({', '.join(map(_value, v))})" if bare == "in" else f"{name} IS {_value(v)}" if bare == "is" else f"{name} {symbols[bare]} {_value(v)}"
                parts.append(f"NOT ({test})" if op.startswith("not_") else test)
    return "(" + " AND ".join(parts) + ")"


def oracle_sql() -> dict[str, str]:
    base = "WITH " + oracle.MATCHES
    predicted = f"{base}, {oracle.FORM}, {oracle.H2H}, {oracle.PREDICTED}"
    calls = "WITH " + oracle.CALLS
    segments = ", v AS (SELECT result, (row_number() OVER (ORDER BY day, match_id) * 6 - 1) // (SELECT count(*) FROM m) AS segment FROM m), fo AS (SELECT unnest(range(1, 6)) AS fold), tr AS (SELECT fold, count(*) AS trained_on, avg((result = 'H')::INT) AS ph, avg((result = 'D')::INT) AS pd, avg((result = 'A')::INT) AS pa FROM fo JOIN v ON segment < fold GROUP BY fold)"
    loss = "avg(-ln(CASE result WHEN 'H' THEN ph WHEN 'D' THEN pd ELSE pa END)) AS log_loss, avg(pow(ph - (result = 'H')::INT, 2) + pow(pd - (result = 'D')::INT, 2) + pow(pa - (result = 'A')::INT, 2)) AS brier"
    # Which side's probabilities are judged, and how.
    def judged(c: str) -> str:
        hit = f"avg(((CASE WHEN {c}_home >= {c}_draw AND {c}_home >= {c}_away THEN 'H' WHEN {c}_draw >= {c}_away THEN 'D' ELSE 'A' END) = result)::INT)"
        ll = f"avg(-ln(CASE result WHEN 'H' THEN {c}_home WHEN 'D' THEN {c}_draw ELSE {c}_away END))"
        br = f"avg(pow({c}_home - (result = 'H')::INT, 2) + pow({c}_draw - (result = 'D')::INT, 2) + pow({c}_away - (result = 'A')::INT, 2))"
        return hit, ll, br

    metrics = ", ".join(f"{e} AS {side}_{n}" for side, c in (("challenger", "p"), ("champion", "c")) for n, e in zip(("accuracy", "log_loss", "brier"), judged(c), strict=True))
    champion = predicted.replace("WITH", "WITH RECURSIVE", 1) + f""", {LOG},
        cd AS (SELECT scope, run, since, until FROM cp WHERE until IS NULL OR until > since),
        pc AS (SELECT p.*, run AS champion, CAST(substr(run, 5) AS DOUBLE) / 10 AS w FROM p JOIN cd ON scope = league AND day >= since AND (until IS NULL OR day < until)),
        pd AS (SELECT *, (1 - w) * p_home + w / 3 AS c_home, (1 - w) * p_draw + w / 3 AS c_draw, (1 - w) * p_away + w / 3 AS c_away FROM pc),
        pm AS (SELECT champion, count(*) AS n, {metrics} FROM pd GROUP BY champion)
        SELECT champion, n, {", ".join(f"round({s}_{k}, 4) AS {s}_{k}" for s in ("challenger", "champion") for k in ("accuracy", "log_loss", "brier"))}, round(challenger_accuracy - champion_accuracy, 4) AS accuracy_delta, round(challenger_log_loss - champion_log_loss, 4) AS log_loss_delta, round(challenger_brier - champion_brier, 4) AS brier_delta,
               round(challenger_accuracy - champion_accuracy, 4) > 0 AND round(challenger_log_loss - champion_log_loss, 4) < 0 AND round(challenger_brier - champion_brier, 4) < 0 AS better FROM pm"""
    late_sql = """, ko AS (SELECT match_id AS n, home, away, CAST(day AS TIMESTAMP) + to_hours(15) + to_minutes(match_id % 60) AS kickoff FROM m),
        r1 AS (SELECT n, home, away, kickoff, n % 4 AS hg, CASE WHEN n % 29 = 0 THEN NULL ELSE n % 3 END AS ag, kickoff + to_days(CAST(n % 10 AS INTEGER)) + to_hours(2) AS seen FROM ko),
        rs AS (SELECT * FROM r1 UNION ALL SELECT n, home, away, kickoff, hg + 1, ag, seen + to_days(1) FROM r1 WHERE n % 4 = 0),
        ok AS (SELECT home, away, kickoff, arg_min(hg + ag, (seen, hg, ag)) AS goals FROM rs WHERE ag IS NOT NULL AND seen <= kickoff + to_days(7) GROUP BY home, away, kickoff),
        md AS (SELECT CAST(ko.kickoff AS DATE) AS day, count(*) AS matched, sum(goals) AS goals FROM ko JOIN ok USING (home, away, kickoff) GROUP BY 1),
        ld AS (SELECT CAST(kickoff AS DATE) AS day, count(*) AS late FROM rs WHERE seen > kickoff + to_days(7) GROUP BY 1)
        SELECT day, coalesce(matched, 0) AS matched, CAST(coalesce(goals, 0) AS BIGINT) AS goals, coalesce(late, 0) AS late FROM md FULL JOIN ld USING (day)"""
    return {
        "walk_forward_baseline": f"{base}{segments} SELECT fold, any_value(trained_on) AS trained_on, count(*) AS n, {loss} FROM tr JOIN v ON segment = fold GROUP BY fold",
        "html_links": _links_sql(False),
        "html_items": _links_sql(True),
        "challenger_states": _states_sql(),
        "champion_periods": base.replace("WITH", "WITH RECURSIVE", 1) + f", {LOG} SELECT scope, run, since, until, predecessor, began FROM cp",
        "champion_comparison": champion,
        "identity_groups": _identity_sql(base),
        "explained": f"{predicted}, {EXPLAINED}",
        "provider_running": calls + """, gd AS (SELECT provider, max((called_at, event_id)) FILTER (success) AS won FROM c GROUP BY provider)
            SELECT provider, count(*) AS calls, count(*) FILTER (NOT success) AS errors, avg(coalesce(latency_ms, 0)) AS latency_ms, count(*) FILTER (NOT success AND (won IS NULL OR (called_at, event_id) > won)) AS consecutive_failures,
                   max(called_at) AS last_call, max(called_at) FILTER (success) AS last_success, max(called_at) FILTER (NOT success) AS last_failure FROM c JOIN gd USING (provider) GROUP BY provider""",
        "volume_triggers": base + ", v AS (SELECT league, match_id, day, row_number() OVER (PARTITION BY league ORDER BY day, match_id) AS k FROM m) SELECT league, k // 50 AS number, match_id, day FROM v WHERE k % 50 = 0",
        "late_results": base + late_sql,
        "period_reports": f"{predicted}, {PERIODS}",
        "filter_documents": base + " " + " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n, CAST(coalesce(sum(match_id), 0) AS BIGINT) AS ids FROM m WHERE {_where(d)}" for name, d in DOCUMENTS.items()),
        "shadow_report": calls + """, r AS (SELECT CAST(called_at AS DATE) AS day, CASE WHEN event_id % 17 <> 0 THEN provider END AS rec, event_id % 20 = 3 AS ch, event_id FROM c),
            u AS (SELECT 'all' AS section, '' AS name, * EXCLUDE (day, event_id) FROM r UNION ALL SELECT 'provider', rec, rec, ch FROM r WHERE rec IS NOT NULL UNION ALL SELECT 'day', day::VARCHAR, rec, ch FROM r),
            p AS (SELECT 'speed' AS name, event_id % 7 / 10.0::DOUBLE AS d FROM r WHERE ch UNION ALL SELECT 'cost', CASE WHEN event_id % 3 <> 0 THEN event_id % 5 / 10.0::DOUBLE END FROM r WHERE ch)
            SELECT section, name, count(*) AS total, count(*) FILTER (NOT ch AND rec IS NOT NULL) AS identical, count(*) FILTER (ch) AS different, count(*) FILTER (rec IS NULL) AS unavailable, round(count(*) / (SELECT count(*) FROM r)::DOUBLE, 6) AS share, NULL::DOUBLE AS delta FROM u GROUP BY section, name
            UNION ALL SELECT 'component', name, count(d), 0, count(d), 0, NULL, round(avg(d), 6) FROM p GROUP BY name""",
        "feature_backfill": f"{base}, {oracle.FORM}, {oracle.H2H}" + """, nf AS (SELECT m.match_id, a.form_score AS f1, b.form_score AS f2, a.avg_for AS f3, g.modifier AS f4, CASE WHEN m.match_id % 4 = 1 THEN 1.0::DOUBLE ELSE 0 END AS x FROM m JOIN g USING (match_id) JOIN f a ON a.match_id = m.match_id AND a.team = m.home JOIN f b ON b.match_id = m.match_id AND b.team = m.away),
            s AS (SELECT *, CASE WHEN match_id % 2 <> 0 THEN f1 + x END AS s1, CASE WHEN match_id % 3 <> 0 THEN f2 + x END AS s2, CASE WHEN match_id % 5 <> 0 THEN f3 + x END AS s3, CASE WHEN match_id % 7 <> 0 THEN f4 + x END AS s4 FROM nf),
            w AS (SELECT match_id, coalesce(s1, f1) AS home_form, coalesce(s2, f2) AS away_form, coalesce(s3, f3) AS home_for, coalesce(s4, f4) AS modifier,
                   concat_ws(',', CASE WHEN s1 IS NULL AND f1 IS NOT NULL THEN 'home_form' END, CASE WHEN s2 IS NULL AND f2 IS NOT NULL THEN 'away_form' END, CASE WHEN s3 IS NULL AND f3 IS NOT NULL THEN 'home_for' END, CASE WHEN s4 IS NULL AND f4 IS NOT NULL THEN 'modifier' END) AS filled FROM s)
            SELECT *, CASE WHEN home_form IS NULL OR away_form IS NULL OR home_for IS NULL OR modifier IS NULL THEN 'incomplete' WHEN filled <> '' THEN 'filled' ELSE 'complete' END AS status FROM w""",
        "training_page": base + " SELECT match_id, day, league, home, away, result FROM m WHERE day < DATE '1998-06-30' OR (day = DATE '1998-06-30' AND match_id < 0) ORDER BY day DESC, match_id DESC LIMIT 500",
        "csv_inspection": base + """ SELECT league, CASE WHEN league = 'ASIA' THEN 'elo_snapshot' ELSE 'matches' END AS kind, CASE WHEN league = 'ASIA' THEN 'Date,Club,Elo' ELSE 'Date,HomeTeam,AwayTeam,FTHome,OddHome,Code' END AS columns,
            CASE WHEN league = 'ASIA' THEN 'home_team,away_team' ELSE '' END AS missing, count(*) AS n FROM m GROUP BY league""",
        "csv_column_types": base + """, l AS (SELECT league, count(*) AS n, count(*) FILTER (match_id % 9 = 0) AS u FROM m GROUP BY league),
            k AS (SELECT * FROM (VALUES (1, 'Date', 'day', 0), (2, 'HomeTeam', 'text', 0), (3, 'AwayTeam', 'text', 0), (4, 'FTHome', 'whole', 1), (5, 'OddHome', 'number', 0), (6, 'Code', 'text', 0)) AS t(place, "column", kind, gap))
            SELECT league, CAST(place AS BIGINT) AS place, "column", kind, n, gap * u AS n_unknown FROM l, k WHERE league <> 'ASIA'
            UNION ALL SELECT league, CAST(place AS BIGINT), "column", kind, n, gap * u FROM l, (VALUES (1, 'Date', 'day', 0), (2, 'Club', 'text', 0), (3, 'Elo', 'whole', 1)) AS t(place, "column", kind, gap) WHERE league = 'ASIA'""",
        "team_names": base + """, r AS (SELECT match_id, home, CASE match_id % 8 WHEN 0 THEN ' ' || home || ' ' WHEN 1 THEN replace(home, 'NATION', 'Nátion') WHEN 2 THEN home || ' (ESP)' WHEN 3 THEN lower(home) || ' Football Club' WHEN 4 THEN 'FC ' || home WHEN 5 THEN 'afc ' || home || ' SK' WHEN 6 THEN home || ' (Spain)' ELSE 'real ' || home END AS raw FROM m)
            SELECT match_id, raw, CASE WHEN match_id % 8 < 6 THEN 'Nation ' || substr(home, 8) ELSE raw END AS name FROM r""",
        "provider_fixtures": base + """, f AS (SELECT *, home_goals AS h, away_goals AS a, strftime(day, '%Y-%m-%d') || ' ' || lpad((match_id % 24)::VARCHAR, 2, '0') || ':30' AS ko FROM m),
            u AS (SELECT 'fd' AS provider, 'fd_' AS prefix, match_id, league, home, away, ko AS kickoff, CASE WHEN match_id % 3 = 0 THEN 'scheduled' ELSE 'finished' END AS status, match_id % 3 <> 0 AS done, h, a FROM f WHERE match_id % 17 <> 0
              UNION ALL SELECT 'espn', 'espn_', match_id, league, home, away, ko, CASE WHEN match_id % 4 = 0 THEN 'in' ELSE 'post' END, match_id % 4 <> 0, h, CASE WHEN match_id % 5 <> 0 THEN a END FROM f
              UNION ALL SELECT 'tsdb', 'tsdb_', match_id, league, home, away, CASE WHEN match_id % 6 = 0 THEN strftime(day, '%Y-%m-%d') || ' 00:00' ELSE ko END, 'match finished', true, h, a FROM f WHERE match_id % 12 <> 0
              UNION ALL SELECT 'freelf', 'freelf_', match_id, league, home, away, ko, CASE WHEN match_id % 7 = 0 THEN 'inprogress' ELSE 'finished' END, match_id % 7 <> 0, h, a FROM f
              UNION ALL SELECT 'oddsapi', 'oa_', match_id, league, home, away, ko, (match_id % 8 <> 0)::VARCHAR, match_id % 8 <> 0, h, a FROM f)
            SELECT provider, prefix || match_id AS fixture, match_id::VARCHAR AS external_id, league, home, away, kickoff, status, CASE WHEN done THEN h END AS home_goals, CASE WHEN done THEN a END AS away_goals,
                   CASE WHEN NOT done THEN NULL WHEN h > a THEN 'H' WHEN h < a THEN 'A' WHEN h = a THEN 'D' END AS result FROM u""",
        "provider_standings": base + """, s AS (SELECT league, CAST(year(day - INTERVAL 6 MONTH) AS BIGINT) AS season, team, count(*) AS played, sum(CASE outcome WHEN 'W' THEN 3 WHEN 'D' THEN 1 ELSE 0 END) AS points, sum(gf - ga) AS gd, sum(gf) AS gf, sum(ga) AS ga FROM t GROUP BY ALL)
            SELECT league, season, row_number() OVER (PARTITION BY league, season ORDER BY points DESC, gd DESC, gf DESC, team) AS position, team, played, CAST(points AS BIGINT) AS points, round(gf / played, 6) AS for_mean, round(ga / played, 6) AS against_mean, CASE WHEN season % 2 = 0 THEN 'WDL' ELSE '' END AS form FROM s""",
        "provider_meetings": base + """, v AS (SELECT least(home, away) AS one, greatest(home, away) AS two, CASE WHEN match_id % 10 <> 0 THEN CASE WHEN home < away THEN home_goals - away_goals ELSE away_goals - home_goals END END AS gap FROM m)
            SELECT one, two, count(gap) AS n, count(*) FILTER (gap > 0) AS home_wins, count(*) FILTER (gap = 0) AS draws, count(*) FILTER (gap < 0) AS away_wins FROM v GROUP BY one, two""",
        "league_cascade": base + """ SELECT league, CASE WHEN league IN ('ASIA', 'EUROPE') THEN 'database' WHEN league <> 'AFRICA' THEN 'provider' ELSE 'archive' END AS source, count(*) AS n, min(day) AS since
            FROM m WHERE CASE WHEN league IN ('ASIA', 'EUROPE') THEN match_id % 3 = 0 WHEN league <> 'AFRICA' THEN match_id % 2 = 0 ELSE true END GROUP BY league""",
    }
