"""Operator 2: conversations rebuilt from quotations, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, release

#: A quoted line: its marks, each with white space around it. No group is repeated, so a run of any length is matched in a loop.
MARKS = r"^[ \t]*>[> \t]*"
#: Characters cut from the ends of texts.
BLANK = " \t\n\x0b\x0c\r"
#: Turns of one passage are searched in runs of so many.
RUN = 1_024


def normal(passage: Column) -> Column:
    """A passage as it is compared: ASCII lower case, single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(passage, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))


def text_lines(text: Column) -> Column:
    """The lines of a text as (level, body): how many marks a line has, and what follows them."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")))


def passages(lines: Column) -> Column:
    """Runs of non-blank lines of one level, as (level, body). A blank line or another level ends a run.

    Runs are cut out by the places where they begin and end, so each line is copied once
    however long a run is.
    """

    def runs(xs: Column) -> Column:
        level = F.transform(xs, lambda x: F.when(F.rtrim(x["body"], F.lit(BLANK)) == "", F.lit(-1)).otherwise(x["level"]))
        return F.transform(F.array(level), lambda kinds: cut(xs, kinds))[0]

    def cut(xs: Column, kinds: Column) -> Column:
        last = F.size(xs) - 1
        places = F.sequence(F.lit(0), last)
        begins = F.filter(places, lambda i: (kinds[i] >= 0) & ((i == 0) | (kinds[F.greatest(i - 1, F.lit(0))] != kinds[i])))
        ends = F.filter(places, lambda i: (kinds[i] >= 0) & ((i == last) | (kinds[F.least(i + 1, last)] != kinds[i])))
        return F.transform(F.arrays_zip(begins.alias("a"), ends.alias("z")), lambda r: F.struct(kinds[r["a"]].alias("level"), F.array_join(F.transform(F.slice(xs, r["a"] + 1, r["z"] - r["a"] + 1), lambda x: x["body"]), "\n").alias("body")))

    # The one-element array gives the lines a name inside the lambda, so they are computed once.
    return F.transform(F.array(lines), runs)[0]


def parse(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, own_text, quote_levels and the passages found as (level, hash)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), text.alias("text"))
    # Texts without a mark are one level: their runs are found by splitting at blank lines.
    marked = F.expr(r"regexp_like(text, '(?md)^[ \\t]*>')")
    plain = F.transform(F.filter(F.split("text", r"\n[\x20\x09-\x0D]*\n"), lambda x: normal(x) != ""), lambda x: F.struct(F.lit(0).alias("level"), x.alias("body")))
    rows = rows.withColumn("marked", marked).withColumn("lines", F.when(F.col("marked"), text_lines(F.col("text"))))
    found = F.when(F.col("marked"), passages(F.col("lines"))).otherwise(plain)
    own = F.when(F.col("marked"), F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")).otherwise(F.col("text"))
    own = F.rtrim(F.regexp_replace(own, r"^[\x20\x09-\x0D]*\n", ""), F.lit(BLANK))
    hashed = F.transform(found, lambda p: F.struct(p["level"].alias("level"), F.unhex(F.md5(normal(p["body"]))).alias("hash")))
    return rows.select("conv_id", "turn", "role", "text", own.alias("own_text"), F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).cast("int").alias("quote_levels"), hashed.alias("passages"))


def link(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, hash, level, origin): each quoted passage with the latest earlier turn of its conversation that wrote it.

    Written and quoted passages are put in one order of turns. A passage's turns are cut into
    runs: inside a run a window finds the latest writer, and what a run hands on is one row,
    so a passage that is everywhere is searched by many tasks.
    """
    each = parsed.where("turn is not null").select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", F.col("p.hash").alias("hash"), F.col("p.level").alias("level"))
    wrote = each.where("level = 0").select("conv_id", "hash", "turn").distinct()
    quoted = each.where("level > 0").groupBy("conv_id", "hash", "turn").agg(F.min("level").alias("level"))
    # Only passages that someone quotes are of interest.
    wrote = wrote.join(quoted.select(F.col("conv_id").alias("c"), F.col("hash").alias("h")).distinct(), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h")), "left_semi")
    both = durable(wrote.withColumn("level", F.lit(0)).unionByName(quoted).withColumn("run", F.floor(F.col("turn") / RUN)))
    author = F.when(F.col("level") == 0, F.col("turn"))
    runs = both.groupBy("conv_id", "hash", "run").agg(F.max(author).alias("last"))
    before = Window.partitionBy("conv_id", "hash").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("carried", F.max("last").over(before)).select(F.col("conv_id").alias("c"), F.col("hash").alias("h"), F.col("run").alias("r"), "carried")
    inside = Window.partitionBy("conv_id", "hash", "run").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    here = both.withColumn("here", F.max(author).over(inside)).where("level > 0")
    out = here.join(runs, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h")) & (F.col("run") == F.col("r")), "left")
    found = durable(out.select("conv_id", "turn", "hash", "level", F.coalesce("here", "carried").alias("origin")))
    release(both)
    return found


def roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root) of the messages that reply to another: pointers are doubled until none moves."""
    now = durable(parents.select("conv_id", "turn", F.col("parent").alias("root")))
    while True:
        up = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root").alias("further"))
        after = durable(now.join(up, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("root") == F.col("t")), "left").select("conv_id", "turn", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        release(now)
        now = after.drop("moved")
        if not after.where("moved").take(1):
            return now


def rebuild(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, own_text, quote_levels, n_quotes, n_linked, parent_turn, root_turn, position.

    Lines that begin with > marks are quotations, as deep as they have marks. Runs of lines
    of one depth are passages; they are normalised, hashed to 128 bits and joined to the
    latest earlier message of the conversation that wrote the passage itself. A message
    replies to the latest message of the shallowest depth at which it quotes one
    (parent_turn). own_text is the message without its quotes. position orders a conversation
    by replies: messages follow the message their chain of replies begins with (root_turn), in
    turn order. A message that quotes nothing begins a chain, so a chat without quotes keeps
    its order.

    n_quotes counts distinct quoted passages, n_linked those whose writer was found. Null
    text counts as empty. Null is a conversation like any other. A null turn can neither
    quote nor be quoted and comes last. Rows that repeat a turn share parent and root, and
    are ordered by role and text. A turn may come more than once, and then all its passages
    are its own. Lines, runs of marks or of blanks and quoted passages may be of any length.
    Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    parsed = durable(parse(messages, conv_col, turn_col, role_col, text_col))
    links = link(parsed)
    turns = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("origin").alias("n_linked"), F.min(F.when(F.col("origin").isNotNull(), F.struct("level", (-F.col("origin")).alias("o")))).alias("best"))
    turns = turns.select("conv_id", "turn", "n_quotes", "n_linked", (-F.col("best.o")).alias("parent"))
    parents = durable(turns)
    root = roots(parents.where("parent is not null"))
    info = parents.join(root.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "root"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left")
    info = info.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "n_quotes", "n_linked", "parent", "root")
    rows = parsed.drop("passages").join(info, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left").drop("c", "t")
    rows = rows.withColumn("root", F.coalesce("root", "turn"))
    # Ranks within a conversation of any length: rows are dealt by range, and each part is numbered after those before it.
    first, turn = F.col("root").asc_nulls_last(), F.col("turn").asc_nulls_last()
    order = [first, turn, F.col("role"), F.xxhash64("text")]
    parts = max(8, int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = durable(rows.repartitionByRange(parts, F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()))
    release(parsed, links, parents, root)
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("ahead", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce("ahead", F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1
    out = dealt.withColumn("within", within).join(counts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return out.select("conv_id", "turn", "role", "own_text", "quote_levels", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"), (F.col("ahead") + F.col("within")).cast("long").alias("position"))
