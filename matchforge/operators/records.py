"""Records of many providers: JSON and wide rows to records, merges into stored records, probes and renames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAYED = "status string, homeTeam struct<name:string>, awayTeam struct<name:string>, score struct<duration:string, fullTime:struct<home:int,away:int>, regularTime:struct<home:int,away:int>>"


def outcome(home: Column, away: Column) -> Column:
    return F.when(home > away, "H").when(home < away, "A").otherwise("D")


def finished(raw: DataFrame, doc: str) -> DataFrame:
    """Played matches of JSON documents. Where penalties decided, regular time's score counts; without one the match goes."""
    x = raw.withColumn("d", F.from_json(doc, PLAYED)).where("d.status = 'FINISHED'")
    score = F.when(F.col("d.score.duration") == "PENALTY_SHOOTOUT", F.col("d.score.regularTime")).otherwise(F.col("d.score.fullTime"))
    x = x.withColumn("s", score).where("s.home is not null and s.away is not null")
    return x.select(*(c for c in raw.columns if c != doc), F.col("d.homeTeam.name").alias("home"), F.col("d.awayTeam.name").alias("away"), F.col("s.home").alias("home_goals"), F.col("s.away").alias("away_goals"), outcome(F.col("s.home"), F.col("s.away")).alias("result"))


def loose_match(raw: DataFrame, doc: str, source: str, league: Column, season: Column) -> DataFrame:
    """Matches of JSON whose teams are objects or plain strings, with a final score; fixture is a slug of at most 120 characters."""
    def team(k: str) -> Column:
        whole = F.get_json_object(doc, f"$.{k}")
        return F.nullif(F.when(whole.startswith("{"), F.get_json_object(doc, f"$.{k}.name")).otherwise(whole), F.lit(""))

    goals = [F.get_json_object(doc, f"$.score.ft[{i}]").try_cast("int") for i in (0, 1)]
    x = raw.select(*(c for c in raw.columns if c != doc), league.alias("league_"), season.alias("season_"), team("team1").alias("home"), team("team2").alias("away"), goals[0].alias("home_goals"), goals[1].alias("away_goals"), F.substring(F.get_json_object(doc, "$.date"), 1, 10).alias("kickoff"))
    low = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    slug = F.concat(F.lit(f"{source}_"), low(F.col("league_")), F.lit("_"), "season_", F.lit("_"), low(F.col("home")), F.lit("_vs_"), low(F.col("away")), F.lit("_"), F.coalesce("kickoff", F.lit("")))
    x = x.where("home is not null and away is not null and home_goals is not null and away_goals is not null")
    return x.withColumn("fixture", F.substring(F.regexp_replace(slug, "[^a-z0-9_]", ""), 1, 120)).withColumn("result", outcome(F.col("home_goals"), F.col("away_goals"))).drop("league_", "season_")


def by_map(doc: Column, fields: dict) -> Column:
    """A struct from JSON as a map of paths says: a path, a nested map, or ``(list path, item map)`` for an array of structs. What a document lacks is null."""
    def one(v) -> Column:
        if isinstance(v, str):
            return F.get_json_object(doc, f"$.{v}")
        if isinstance(v, dict):
            return by_map(doc, v)
        items = F.from_json(F.get_json_object(doc, f"$.{v[0]}"), "array<string>")
        return F.transform(items, lambda item: by_map(item, v[1]))

    return F.struct(*(one(v).alias(k) for k, v in fields.items()))


def price_rows(wide: DataFrame, keys: list[str], bookmakers: dict[str, tuple[str, str, str]]) -> DataFrame:
    """One row of a match and bookmaker from a column for each price; only triples whose prices are all above 1."""
    each = [F.struct(F.lit(b).alias("bookmaker"), *(F.col(c).try_cast("double").alias(p) for c, p in zip(cols, ("home_price", "draw_price", "away_price"), strict=True))) for b, cols in bookmakers.items()]
    return wide.select(*keys, F.inline(F.array(*each))).where("home_price > 1 and draw_price > 1 and away_price > 1")


def best_outcomes(events: DataFrame, key: str, line: float = 2.5) -> DataFrame:
    """The best price of each outcome of each event and the bookmaker that gives it (of equals the last by name). Totals count at ``line`` alone.

    events: key, bookmakers array<struct<title, markets array<struct<key, outcomes array<struct<name, point, price>>>>>>.
    """
    x = events.select(key, F.explode("bookmakers").alias("b")).select(key, "b.title", F.explode("b.markets").alias("m")).select(key, "title", F.col("m.key").alias("market"), F.inline("m.outcomes"))
    x = x.where((F.col("market") != "totals") | (F.col("point") == line))
    return x.groupBy(key, "market", "name").agg(F.max(F.struct("price", "title")).alias("x")).select(key, "market", "name", "x.price", "x.title")


def links(pages: DataFrame, key: str, html: str, part: str, parameter: str, host: str) -> DataFrame:
    """key, place, base, value: anchors to addresses with ``part`` and their query parameter. Of equal bases the first stays, empty parameters go."""
    x = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit('<a [^>]*?href="([^"]*)"'), 1)).alias("place", "href")).withColumn("href", F.replace("href", F.lit("&amp;"), F.lit("&"))).where(F.col("href").contains(part))
    whole = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(host), "href"))
    query = F.concat(F.lit("&"), F.regexp_extract("href", r"\?(.*)", 1))
    x = x.select(key, "place", F.rtrim(F.substring_index(whole, "?", 1), F.lit("/")).alias("base"), F.regexp_extract(query, f"&{parameter}=([^&]*)", 1).alias("value")).where("value <> ''")
    return x.groupBy(key, "base").agg(F.min(F.struct("place", "value")).alias("x")).select(key, "x.place", "base", "x.value")


def natural_key(home: Column, away: Column, day: Column) -> list[Column]:
    return [F.lower(F.trim(home)).alias("k_home"), F.lower(F.trim(away)).alias("k_away"), F.substring(day.cast("string"), 1, 10).alias("k_day")]


def canonical_upsert(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[str], facts: list[str], others: list[str]) -> DataFrame:
    """Keys, facts, others, action and conflicts of each key after the batch's rows were taken one after another, in ``order``.

    A row whose fact contradicts what is known by then is refused as a whole and counted in ``conflicts``; others fill
    nulls and overwrite nothing. The action is ``inserted``, ``untouched`` (not in the batch), ``hard_conflict`` (all rows
    refused), ``updated`` or ``unchanged``. ``stored`` has one row a key. Rows of one content count as one, as a
    repetition is taken or refused as the first was; so a key is a list of its different contents, however often they come.
    """
    cols = facts + others
    content = batch.groupBy(*keys, *cols).agg(F.min(F.struct(*order)).alias("at"), F.count("*").alias("n"))
    lists = content.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", F.struct(*cols).alias("v"), "n"))).alias("rows"))
    x = stored.select(*keys, F.struct(*cols).alias("held"), F.lit(True).alias("is_stored")).join(lists, keys, "full")
    kinds = {c: stored.schema[c].dataType for c in cols}
    known = F.struct(*(F.col(f"held.{c}").cast(kinds[c]).alias(c) for c in cols))
    start = F.struct(known.alias("v"), F.lit(0).cast("long").alias("refused"), F.lit(0).cast("long").alias("taken"))

    def take(now: Column, row: Column) -> Column:
        clash = reduce(lambda a, b: a | b, (F.coalesce(now["v"][c] != row["v"][c], F.lit(False)) for c in facts))
        merged = F.struct(*(F.when(clash, now["v"][c]).otherwise(F.coalesce(now["v"][c], row["v"][c])).cast(kinds[c]).alias(c) for c in cols))
        return F.struct(merged.alias("v"), (now["refused"] + F.when(clash, row["n"]).otherwise(0)).alias("refused"), (now["taken"] + F.when(clash, 0).otherwise(row["n"])).alias("taken"))

    x = x.withColumn("end", F.aggregate(F.coalesce("rows", F.array()), start, take))
    filled = reduce(lambda a, b: a | b, (F.col(f"held.{c}").isNull() & F.col(f"end.v.{c}").isNotNull() for c in cols))
    action = F.when(F.col("is_stored").isNull(), "inserted").when(F.col("rows").isNull(), "untouched").when(F.col("end.taken") == 0, "hard_conflict").when(filled, "updated").otherwise("unchanged")
    return x.select(*keys, *(F.col(f"end.v.{c}").alias(c) for c in cols), action.alias("action"), F.col("end.refused").alias("conflicts"))


def merge_fields(rows: DataFrame, key: list[str], provider: str, order: list[str], ranks: dict[str, dict[str, int]], owned: list[str], status: str) -> DataFrame:
    """One row a key: of each ranked field the value of the best provider and its name (``field_from``), of owned fields the first known value, the last known status, the providers and the number of merges.

    All columns are aggregates that combine before the one shuffle. Providers without a rank come last; of one rank the first in ``order`` stays.
    """
    def ranked(c: str, rank: dict[str, int]) -> Column:
        place = reduce(lambda e, kv: e.when(F.col(provider) == kv[0], kv[1]), rank.items(), F).otherwise(max(rank.values()) + 1)
        return F.min(F.when(F.col(c).isNotNull(), F.struct(place.alias("rank"), *order, F.col(c).alias("value"), F.col(provider).alias("by")))).alias(f"x_{c}")

    x = rows.groupBy(*key).agg(
        *(ranked(c, r) for c, r in ranks.items()),
        *(F.min(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("value"))))["value"].alias(c) for c in owned),
        F.max(F.when(F.col(status).isNotNull(), F.struct(*order, F.col(status).alias("value"))))["value"].alias(status),
        F.array_join(F.sort_array(F.collect_set(provider)), ",").alias("sources"), F.count("*").alias("merges"),
    )
    return x.select(*key, *(f(c) for c in ranks for f in (lambda c: F.col(f"x_{c}.value").alias(c), lambda c: F.col(f"x_{c}.by").alias(f"{c}_from"))), *owned, status, "sources", "merges")


def write_results(stored: DataFrame, results: DataFrame, natural: list[str], id_: str, cols: list[str]) -> DataFrame:
    """Stored rows without a result take it from the row of their natural key, else from the row of their id; ``found_by`` says which. Both sides of ``results`` are made unique first."""
    new = lambda k, tag: results.groupBy(*k).agg(F.min(F.struct(*cols)).alias(tag))
    x = stored.join(new(natural, "by_key"), natural, "left").join(new([id_], "by_id"), id_, "left")
    known = F.col(cols[0]).isNotNull()
    found = F.when(known, "had one").when(F.col("by_key").isNotNull(), "key").when(F.col("by_id").isNotNull(), "id")
    return x.withColumn("found_by", found).select(id_, *natural, *(F.when(known, F.col(c)).otherwise(F.coalesce(F.col(f"by_key.{c}"), F.col(f"by_id.{c}"))).alias(c) for c in cols), "found_by")


def unseen(batch: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the batch whose key is not stored, of each key the first in ``order``."""
    cols = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min(F.struct(*order, F.struct(*cols).alias("rest"))).alias("x")).select(*keys, "x.rest.*")
    return first.join(stored.select(*keys), keys, "left_anti")


def vocabulary(rows: DataFrame, id_: str, sides: tuple[str, str], day: str, canon) -> DataFrame:
    """One row of counts of what a renaming would do: names, names and appearances that change, rows touched, identities with several names, keys that collide after it."""
    names = rows.select(id_, F.explode(F.array(*map(F.col, sides))).alias("raw")).where("raw <> ''").withColumn("canon", canon(F.col("raw")))
    per = names.groupBy("canon", "raw").agg(F.count("*").alias("n")).groupBy("canon").agg(F.count("*").alias("names"), F.count_if(F.col("raw") != F.col("canon")).alias("renamed"), F.coalesce(F.sum(F.when(F.col("raw") != F.col("canon"), F.col("n"))), F.lit(0)).alias("appearances"))
    total = per.agg(F.sum("names").alias("names"), F.sum("renamed").alias("renamed"), F.sum("appearances").alias("appearances"), F.count("*").alias("identities"), F.count_if(F.col("names") > 1).alias("broken"))
    touched = rows.agg(F.count("*").alias("n_rows"), F.count_if(reduce(lambda a, b: a | b, (F.coalesce(canon(F.col(s)) != F.col(s), F.lit(False)) for s in sides))).alias("touched"))
    hits = _collisions(rows, sides, day, canon).agg(F.count("*").alias("collisions"))
    return total.join(F.broadcast(touched)).join(F.broadcast(hits))


def _collisions(rows: DataFrame, sides: tuple[str, str], day: str, canon) -> DataFrame:
    return rows.groupBy(*(canon(F.col(s)).alias(f"c_{s}") for s in sides), F.col(day).alias("c_day")).agg(F.count("*").alias("n")).where("n > 1").drop("n")


def plan_renames(rows: DataFrame, id_: str, sides: tuple[str, str], day: str, canon) -> DataFrame:
    """Rows to rename and their new names, without rows whose new key another row has too."""
    x = rows.select(id_, F.col(day).alias("c_day"), *(canon(F.col(s)).alias(f"c_{s}") for s in sides), *sides).where(" or ".join(f"c_{s} <> {s}" for s in sides))
    keys = [*(f"c_{s}" for s in sides), "c_day"]
    return x.join(_collisions(rows, sides, day, canon), keys, "left_anti").select(id_, *(F.col(f"c_{s}").alias(s) for s in sides))


def pooled(rows: DataFrame, group: str, chosen: list[str], parts: tuple[str, str]) -> DataFrame:
    """The ratio of two sums over rows that know both: of all rows, inside and outside the chosen groups, and of each group. One pass, four scopes a row."""
    top, bottom = parts
    inside = F.when(F.col(group).isin(*chosen), "inside").otherwise("outside")
    x = rows.where(F.col(top).isNotNull() & F.col(bottom).isNotNull()).groupBy(group).agg(F.sum(top).alias("top"), F.sum(bottom).alias("bottom"), F.count("*").alias("n"))
    x = x.select(F.explode(F.array(F.lit("all"), inside, F.col(group))).alias("scope"), "top", "bottom", "n")
    return x.groupBy("scope").agg((F.sum("top") / F.nullif(F.sum("bottom"), F.lit(0))).alias("ratio"), F.sum("n").alias("n"))
