"""Providers' payloads to one shape: fixtures, standings and meetings, each provider as a declarative map."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: The shape of a fixture.
FIXTURE = ("provider", "fixture", "external_id", "league", "home", "away", "kickoff", "status", "home_goals", "away_goals", "result")


@dataclass
class FixtureMap:
    """Where a provider's document has what: JSON paths, of which the first known counts.

    ``items``: paths of the list of events in a document. ``kickoff`` is ISO text, or seconds
    since 1970 with ``epoch``. ``finished``: states in which a score counts as the result; only
    then are goals taken. ``scores_by_name``: paths of a list of name and score pairs, where sides are told by
    their names.
    """

    prefix: str
    items: tuple[str, ...]
    id: tuple[str, ...]
    league: tuple[str, ...]
    home: tuple[str, ...]
    away: tuple[str, ...]
    kickoff: tuple[str, ...]
    status: tuple[str, ...] = ()
    goals: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())
    finished: tuple[str, ...] = ()
    epoch: bool = False
    scores_by_name: str | None = None
    leagues: dict[str, str] = field(default_factory=dict)


# Field names of the providers' payloads.
FIXTURES = {
    "fd": FixtureMap("fd", ("matches",), ("id",), ("competition.name",), ("homeTeam.name",), ("awayTeam.name",), ("utcDate",), ("status",), (("score.fullTime.home",), ("score.fullTime.away",)), ("finished",)),
    "espn": FixtureMap("espn", ("events",), ("id",), ("season.slug",), ("competitions[0].competitors[0].team.displayName",), ("competitions[0].competitors[1].team.displayName",), ("date",), ("status.type.state",), (("competitions[0].competitors[0].score",), ("competitions[0].competitors[1].score",)), ("post",)),
    "tsdb": FixtureMap("tsdb", ("events",), ("idEvent",), ("strLeague",), ("strHomeTeam",), ("strAwayTeam",), ("strTimestamp", "dateEvent"), ("strStatus",), (("intHomeScore",), ("intAwayScore",)), ("match finished", "ft")),
    "freelf": FixtureMap("freelf", ("response", "matches", "events", "data"), ("id", "eventId"), ("parentLeagueId", "leagueId"), ("homeTeam.name",), ("awayTeam.name",), ("startTimestamp",), ("status.type",), (("homeScore.current",), ("awayScore.current",)), ("finished",), epoch=True),
    "oddsapi": FixtureMap("oa", ("events",), ("id",), ("sport_key",), ("home_team",), ("away_team",), ("commence_time",), ("completed",), finished=("true",), scores_by_name="scores"),
}


def _top(path: str) -> str:
    """The name at the top of a JSON path."""
    return path.split(".")[0].split("[")[0]


def _first(doc: Column, paths: tuple[str, ...]) -> Column:
    return _first_filled([F.get_json_object(doc, f"$.{p}") for p in paths])


def _first_filled(texts: list[Column]) -> Column:
    """The first that is neither null nor blank, trimmed; each is worked out once."""
    return F.get(F.filter(F.array(*map(F.trim, texts)), lambda s: s != ""), 0) if texts else F.lit(None).cast("string")


def fixtures(docs: DataFrame, doc: str, provider: str, maps: dict[str, FixtureMap] = FIXTURES) -> DataFrame:
    """FIXTURE rows of every event in every document of the providers in ``maps``; rows of other providers are left out.

    An event without both names, or without a kickoff that can be read, is none. Status is in lower case; a result needs
    both goals and a finished state. Times are in UTC.
    """
    name = F.col(provider)

    def own(of) -> Column:
        """What ``of`` makes of the row's own provider's map."""
        chain = F
        for key, m in maps.items():
            chain = chain.when(name == key, of(m))
        return chain

    lists = own(lambda m: F.coalesce(*(F.from_json(F.get_json_object(doc, f"$.{p}"), "array<string>") for p in m.items)))
    # An outer explode has no filter, for which Spark would parse the lists again; an event that is null has no names.
    x = docs.where(name.isin(*maps)).select(name.alias("provider"), F.explode_outer(lists).alias("event"))
    # One pass over an event takes out all names at its top; what lies deeper is read out of these short parts.
    tops = sorted({_top(p) for m in maps.values() for p in (*m.id, *m.league, *m.home, *m.away, *m.kickoff, *m.status, *m.goals[0], *m.goals[1], *([m.scores_by_name] if m.scores_by_name else []))})
    x = x.select("provider", F.json_tuple("event", *tops).alias(*(f"top{k}" for k in range(len(tops)))))
    name = F.col("provider")

    def part(path: str) -> Column:
        top = _top(path)
        column = F.col(f"top{tops.index(top)}")
        return F.get_json_object(column, f"${path[len(top):]}") if len(path) > len(top) else column

    def first(paths: tuple[str, ...]) -> Column:
        return _first_filled([part(p) for p in paths])

    def goals(m: FixtureMap, k: int) -> Column:
        if not m.scores_by_name:
            return first(m.goals[k])
        pairs = F.from_json(part(m.scores_by_name), "array<struct<name:string,score:string>>")
        return F.get(F.transform(F.filter(pairs, lambda s: F.trim(s["name"]) == first((m.home, m.away)[k])), lambda s: s["score"]), 0)

    def league(m: FixtureMap) -> Column:
        found = first(m.league)
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in m.leagues.items() for v in kv]), found), found) if m.leagues else found

    raw = {"external_id": own(lambda m: first(m.id)), "league": own(league), "home": own(lambda m: first(m.home)), "away": own(lambda m: first(m.away)), "raw": own(lambda m: first(m.kickoff)), "status": F.lower(own(lambda m: first(m.status))), "h": own(lambda m: goals(m, 0)), "a": own(lambda m: goals(m, 1))}
    # Out of a list of one, so that each field is read once and not again by all that asks for it.
    x = x.select("provider", F.inline(F.array(F.struct(*(c.alias(k) for k, c in raw.items()))))).where("home is not null and away is not null")
    at = own(lambda m: F.timestamp_seconds(F.col("raw").try_cast("long")) if m.epoch else F.when(F.col("raw").rlike("[0-9]"), F.try_to_timestamp(F.regexp_replace("raw", "Z$", "+00:00"))))
    done = own(lambda m: F.col("status").isin(*m.finished))
    home, away = (F.when(done, text.whole_number(F.col(g))).cast("long") for g in "ha")
    fixture = own(lambda m: F.concat(F.lit(f"{m.prefix}_"), "external_id"))
    typed = F.struct("provider", fixture.alias("fixture"), "external_id", "league", "home", "away", at.alias("kickoff"), "status", home.alias("home_goals"), away.alias("away_goals"))
    x = x.select(F.inline(F.array(typed))).where("kickoff is not null")
    result = F.when(F.col("home_goals") > F.col("away_goals"), "H").when(F.col("home_goals") < F.col("away_goals"), "A").when(F.col("home_goals") == F.col("away_goals"), "D")
    return x.withColumn("result", result).select(*FIXTURE)


def standings(docs: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """keys, position, team, played, wins, draws, losses, points, for_mean, against_mean, form of each entry of a document's table.

    Names differ between providers: the first that an entry has counts. Means are goals a match, of
    which there is one at least; form is its letters without separators. An entry without a team is left out.
    """
    lists = F.coalesce(*(F.from_json(F.get_json_object(doc, f"$.{p}"), "array<string>") for p in ("standing", "response", "standings[0].table")))
    x = docs.select(*keys, F.explode(lists).alias("e"))
    e = F.col("e")
    number = lambda *paths: F.coalesce(text.whole_number(_first(e, paths)), F.lit(0)).cast("long")
    played = F.greatest(number("played", "matches", "playedGames"), F.lit(1))
    x = x.select(*keys, number("position", "rank").alias("position"), _first(e, ("team.name",)).alias("team"), played.alias("played"), number("wins", "won").alias("wins"), number("draws", "draw").alias("draws"), number("losses", "lost").alias("losses"), number("points").alias("points"), number("goalsFor", "goals_for").alias("gf"), number("goalsAgainst", "goals_against").alias("ga"), F.regexp_replace(F.coalesce(_first(e, ("form",)), F.lit("")), "[^WDL]", "").alias("form"))
    return x.where("team is not null").select(*keys, "position", "team", "played", "wins", "draws", "losses", "points", (F.col("gf") / F.col("played")).alias("for_mean"), (F.col("ga") / F.col("played")).alias("against_mean"), "form")


def meetings(docs: DataFrame, doc: str, keys: list[str], home: str, away: str) -> DataFrame:
    """keys, n, home_wins, draws, away_wins of the finished meetings in a document, seen from ``home``, whoever was at home then.

    A meeting of other teams, or one without both scores, is left out.
    """
    lists = F.from_json(F.get_json_object(doc, "$.matches"), "array<string>")
    x = docs.select(*keys, F.col(home).alias("own_"), F.col(away).alias("other_"), F.explode_outer(lists).alias("e"))
    e = F.col("e")
    x = x.select(*keys, "own_", "other_", _first(e, ("homeTeam.name",)).alias("h"), _first(e, ("awayTeam.name",)).alias("a"), text.whole_number(_first(e, ("homeScore.current",))).alias("hs"), text.whole_number(_first(e, ("awayScore.current",))).alias("as_"))
    straight = (F.col("h") == F.col("own_")) & (F.col("a") == F.col("other_"))
    turned = (F.col("h") == F.col("other_")) & (F.col("a") == F.col("own_"))
    gap = F.when(straight, F.col("hs") - F.col("as_")).when(turned, F.col("as_") - F.col("hs"))
    return x.withColumn("gap", gap).groupBy(*keys).agg(F.count("gap").alias("n"), F.count_if(F.col("gap") > 0).alias("home_wins"), F.count_if(F.col("gap") == 0).alias("draws"), F.count_if(F.col("gap") < 0).alias("away_wins"))
