"""Parsing of scraped values and names as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that Unicode decomposes into one letter and marks, what they are without, and the marks themselves.
_SPLIT = {c: unicodedata.normalize("NFD", c) for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)])}
MARKS = "".join(map(chr, range(0x300, 0x370)))
MARKED = "".join(c for c, d in _SPLIT.items() if len(d) > 1 and all(map(unicodedata.combining, d[1:])))
PLAIN = "".join(_SPLIT[c][0] for c in MARKED)


def unmarked(x: Column) -> Column:
    """Letters without their marks, composed or not."""
    return F.translate(x, MARKED + MARKS, PLAIN)


def alias_of(name: Column, aliases: dict[str, str]) -> Column:
    """The alias of the name, else of the name without marks, else the trimmed name."""
    held = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    key = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(held, key), F.try_element_at(held, unmarked(key)), F.trim(name))


# What a club's name may end or begin with, and a country in brackets.
SUFFIXES = (" football club", " sc", " sv", " ac", " bc", " afc", " fk", " sk", " bk", " if", " hk", " gd")
PREFIXES = ("fc ", "cf ", "ac ", "sc ", "fk ", "sk ", "afc ")
COUNTRY = r"\s*\([A-Z]{2,4}\)$"


def team_name(name: Column, aliases: dict[str, str]) -> Column:
    """The canonical name by five tries, each only a key to look up: as it is, without marks, without a country in
    brackets, without one suffix, and without one prefix besides. A name that none of them finds stays as it is, trimmed."""
    held = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    plain = unmarked(F.trim(name))
    low = F.lower(plain)
    # A name has one last word and one first, so at most one of the suffixes and one of the prefixes fits.
    bare = F.trim(F.regexp_replace(low, f"({'|'.join(SUFFIXES)})$", ""))
    short = F.trim(F.regexp_replace(bare, f"^({'|'.join(PREFIXES)})", ""))
    country = F.when(plain.rlike(COUNTRY), F.lower(F.trim(F.regexp_replace(plain, COUNTRY, ""))))
    found = F.coalesce(*(F.try_element_at(held, k) for k in (F.lower(F.trim(name)), low, country, short)))
    return F.when(name == "", name).otherwise(F.coalesce(found, F.trim(name)))


def match_key(home: Column, away: Column, day: Column) -> Column:
    return F.concat_ws("||", F.lower(home), F.lower(away), F.substring(day.cast("string"), 1, 10))


def fixture_id(source: str, key: Column) -> Column:
    return F.concat(F.lit(f"{source}_"), F.substring(F.sha2(key, 256), 1, 16))


def percent(x: Column) -> Column:
    return F.rtrim(F.trim(x), F.lit("%")).try_cast("double")


def leading_number(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"^\s*(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "").try_cast("int")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def whole_number(x: Column) -> Column:
    """An integer read through a double, cut towards 0; null for what is no number."""
    s = F.trim(x.cast("string"))
    # Without a digit there is no integer; casting such a text would throw and catch in every row.
    d = F.when(s.rlike("[0-9]"), s.try_cast("double"))
    return F.when(~F.isnan(d), d.try_cast("int"))


def plain_text(x: Column) -> Column:
    return F.coalesce(F.trim(x.cast("string")), F.lit(""))


def season_start(day: Column, back: int = 0) -> Column:
    """The first of July that begins the season of a day, or of so many seasons before."""
    return F.make_date(F.year(F.add_months(day, -6)) - back, F.lit(7), F.lit(1))


# Prefixes of fixture ids and the sources they name.
SOURCES = {"fd_": "football_data", "espn_": "espn", "odds_": "odds_api", "kaggle_": "kaggle_historical", "flashscore_": "flashscore", "tsdb_": "tsdb", "openfootball_": "openfootball"}
# Positions that may follow a player's name, and the note after a team's.
POSITION_NAMES = ("Goalkeeper", "Defender", "Centre back", "Fullback", "Wingback", "Winger", "Midfielder", "Attacking midfielder", "Forward", "Striker")
NOTE = "Advancing to next round"


def source_of(fixture: Column) -> Column:
    """The source that a fixture id's prefix names, else null."""
    return F.coalesce(*(F.when(fixture.startswith(prefix), F.lit(name)) for prefix, name in SOURCES.items()))


def incident_minute(x: Column) -> Column:
    """The regular minute of 45+6' and the like."""
    return F.nullif(F.regexp_extract(F.trim(x), r"^(\d+)", 1), F.lit("")).try_cast("int")


def name_and_position(x: Column) -> Column:
    """(name, position): a position at the end is cut off, the longest that fits."""
    one = "|".join(sorted(POSITION_NAMES, key=len, reverse=True))
    pattern = f"^(?:(.*) )?({one})$"
    found = F.regexp_extract(x, pattern, 2)
    return F.when(found == "", F.struct(x.alias("name"), F.lit(None).cast("string").alias("position"))).otherwise(F.struct(F.trim(F.regexp_extract(x, pattern, 1)).alias("name"), found.alias("position")))


def without_note(x: Column) -> Column:
    return F.trim(F.substring_index(x, NOTE, 1))
