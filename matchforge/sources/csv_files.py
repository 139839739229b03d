"""CSV files: what a folder's files hold, and matches out of their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

# Names under which files carry a field; the first three fields make a file one of matches.
REQUIRED = {
    "date": ["date", "match_date", "matchdate", "kickoff", "utc_date"],
    "home_team": ["home_team", "hometeam", "home", "team_home"],
    "away_team": ["away_team", "awayteam", "away", "team_away"],
}
KNOWN = {
    "home_goals": ["fthome", "ft_home", "home_goals", "homegoals"],
    "away_goals": ["ftaway", "ft_away", "away_goals", "awaygoals"],
    "odds_home": ["oddhome", "odd_home", "odds_home", "home_odds"],
    "odds_draw": ["odddraw", "odd_draw", "odds_draw", "draw_odds"],
    "odds_away": ["oddaway", "odd_away", "odds_away", "away_odds"],
    "home_elo": ["homeelo", "home_elo", "elo_home"],
    "away_elo": ["awayelo", "away_elo", "elo_away"],
}


def _among(columns: Column, aliases: list[str]) -> Column:
    """The first alias that is among the lower-case columns."""
    return F.coalesce(*(F.when(F.array_contains(columns, a), F.lit(a)) for a in aliases))


def inspect(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, n_rows, columns, missing, known, kind of every ``*.csv`` below a folder, however deep.

    Lines are counted as text, so a line break inside quotes counts as a row and a blank line as none; the header
    is the line at a file's start. kind is matches, elo_snapshot or unknown. A file without any text is not listed.
    """
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "path"), ("file_size", "bytes"), ("file_block_start", "at"))]
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder).select(*meta, F.monotonically_increasing_id().alias("k"), "value").where("value <> ''")
    x = lines.groupBy("path", "bytes").agg((F.count("*") - 1).alias("n_rows"), F.min_by("value", F.struct("at", "k")).alias("header"))
    x = x.withColumn("columns", F.transform(F.split("header", ","), lambda c: F.trim(F.regexp_replace(c, '^\ufeff|"', "")))).withColumn("low", F.transform("columns", F.lower))
    missing = F.filter(F.array(*(F.when(_among(F.col("low"), a).isNull(), F.lit(f)) for f, a in REQUIRED.items())), lambda f: f.isNotNull())
    known = F.map_filter(F.create_map(*(c for f, a in KNOWN.items() for c in (F.lit(f), _among(F.col("low"), a)))), lambda _, a: a.isNotNull())
    elo = F.array_contains("low", "elo") & _among(F.col("low"), ["club", "team"]).isNotNull() & _among(F.col("low"), ["date", "snapshot_date"]).isNotNull()
    kind = F.when(F.size("missing") == 0, "matches").when(elo, "elo_snapshot").otherwise("unknown")
    return x.withColumns({"missing": missing, "known": known}).select("path", "bytes", "n_rows", "columns", "missing", "known", kind.alias("kind"))


#: Kinds of a cell, the narrowest first; what fits none is text. Blank cells and these words are unknown.
_UNKNOWN = ("", "na", "n/a", "nan", "null", "none")
_CELL = r'(?:^|,)("(?:[^"]++|"")*+"|[^,]*+)'


def cell_kind(cell: Column) -> Column:
    """unknown, whole, number, day or text."""
    bare = F.trim(F.regexp_replace(cell, '^"|"$', ""))
    kind = F.when(F.lower(bare).isin(*_UNKNOWN), "unknown").when(bare.rlike("^[+-]?[0-9]{1,18}$"), "whole").when(bare.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), "number")
    return kind.when(bare.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(bare).isNotNull(), "day").otherwise("text")


def merged_kind(counts: dict[str, Column]) -> Column:
    """The least kind that holds all cells of a column: whole numbers are numbers, all is text, and unknown cells fit each."""
    known = counts["whole"] + counts["number"] + counts["day"] + counts["text"]
    return F.when(known == 0, "unknown").when(counts["whole"] == known, "whole").when(counts["whole"] + counts["number"] == known, "number").when(counts["day"] == known, "day").otherwise("text")


def types(spark: SparkSession, folder: str) -> DataFrame:
    """path, place, column, kind, n, n_unknown of every column of every ``*.csv`` below a folder, from all its cells in one pass.

    Counts of kinds are added up over a file's lines, wherever they are read, and the header's
    own cells are taken off again, as only the whole file tells which line is first. Cells may
    be quoted; a line break inside quotes counts as a new line. A line's cells beyond the
    header are not counted, and those that it lacks count as unknown.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"), "value").where("value <> ''")
    split = lambda c: F.regexp_extract_all(F.regexp_replace(c, "^\ufeff", ""), F.lit(_CELL), F.lit(1))
    heads = lines.groupBy("path").agg((F.count("*") - 1).alias("n"), F.min_by("value", F.struct("at", "k")).alias("header"))
    heads = heads.select("path", "n", F.posexplode(split(F.col("header"))).alias("place", "column"))
    cells = lines.select("path", F.posexplode(split(F.col("value"))).alias("place", "cell")).groupBy("path", "place", cell_kind(F.col("cell")).alias("kind")).agg(F.count("*").alias("c"))
    kinds = ("whole", "number", "day", "text")
    wide = cells.groupBy("path", "place").agg(*(F.sum(F.when(F.col("kind") == k, F.col("c")).otherwise(0)).alias(k) for k in kinds))
    x = heads.join(wide, ["path", "place"], "left").withColumns({k: F.coalesce(k, F.lit(0)) - (cell_kind(F.col("column")) == k).cast("int") for k in kinds})
    counts = {k: F.col(k) for k in kinds}
    name = F.trim(F.regexp_replace("column", '^"|"$', ""))
    return x.select("path", (F.col("place") + 1).alias("place"), name.alias("column"), merged_kind(counts).alias("kind"), "n", (F.col("n") - sum(counts.values(), F.lit(0))).alias("n_unknown"))


def matches(lines: DataFrame, line: str, columns: list[str], day_format: str, cutoff: Column | None, order: str, take: Column | None = None) -> DataFrame:
    """The lines' own columns with day, home, away, home_goals, away_goals, result, fixture and reason.

    ``columns`` name a line's fields; date, home, away, hg and ag are read, all as text first. reason is left_out
    (not ``take``), invalid_date, before_cutoff, missing_team_name, missing_score, duplicate (a later line of a
    fixture, by ``order``) or valid; nothing is dropped. Names are trimmed and in upper case.
    """
    x = lines.withColumn("r_", F.from_csv(line, ", ".join(f"{c} string" for c in columns))).select(*lines.columns, *(f"r_.{c}" for c in columns))
    name = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    x = x.withColumns({"day": F.try_to_timestamp("date", F.lit(day_format)).cast("date"), "home": name("home"), "away": name("away"), "home_goals": text.whole_number(F.col("hg")), "away_goals": text.whole_number(F.col("ag"))})
    h, a = F.col("home_goals"), F.col("away_goals")
    x = x.withColumn("result", F.when(h > a, "H").when(h < a, "A").when(h == a, "D")).withColumn("fixture", text.fixture_id("csv", text.match_key(F.col("home"), F.col("away"), F.when(F.col("home").isNotNull() & F.col("away").isNotNull(), F.col("day")))))
    x = x.withColumn("fixture", F.when(F.col("day").isNotNull(), F.col("fixture")))
    early = F.col("day") < cutoff if cutoff is not None else F.lit(False)
    left_out = ~F.coalesce(take, F.lit(False)) if take is not None else F.lit(False)
    reason = F.when(left_out, "left_out").when(F.col("day").isNull(), "invalid_date").when(early, "before_cutoff").when(F.col("home").isNull() | F.col("away").isNull(), "missing_team_name").when(h.isNull() | a.isNull(), "missing_score")
    x = x.withColumn("reason", reason)
    place = F.row_number().over(Window.partitionBy("reason", "fixture").orderBy(order))
    return x.withColumn("reason", F.coalesce("reason", F.when(place > 1, "duplicate").otherwise("valid")))
