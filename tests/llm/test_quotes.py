"""Operator 2 against a plain search through each conversation."""

import random
import re
import time

from matchforge.llm import queries, quotes

MARKS = re.compile(r"[ \t]*(?:>[ \t]*)+")


def normal(x):
    return " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), x).split())


def parse(text):
    runs, own, deepest, last = [], [], 0, None
    for line in (text or "").split("\n"):
        marks = MARKS.match(line)
        level, body = (marks[0].count(">"), line[marks.end() :]) if marks else (0, line)
        deepest = max(deepest, level)
        if level == 0:
            own.append(body)
        if not normal(body):
            last = None
        elif last == level:
            runs[-1][1] += "\n" + body
        else:
            runs.append([level, body])
            last = level
    return {(lv, normal(b)) for lv, b in runs}, "\n".join(own).rstrip(" \t\n\r\x0b\x0c"), deepest


def brute(rows):
    """{(conv, turn): (n_quotes, n_linked, parent, root)}; turns are unique here."""
    out = {}
    for conv in {r[0] for r in rows}:
        said = sorted((r[1], parse(r[3])[0]) for r in rows if r[0] == conv)
        parent = {}
        for t, runs in said:
            quoted = {h: min(lv for lv, x in runs if x == h and lv) for lv, h in runs if lv}
            found = {h: max((u for u, other in said if u < t and (0, h) in other), default=None) for h in quoted}
            best = min(((quoted[h], -u) for h, u in found.items() if u is not None), default=None)
            parent[t] = -best[1] if best else None
            root = t
            while parent[root] is not None:
                root = parent[root]
            out[conv, t] = (len(quoted), sum(u is not None for u in found.values()), parent[t], root)
    return out


def check(spark, rows):
    got = quotes.rebuild(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = brute(rows)
    assert {(r["conv_id"], r["turn"]): (r["n_quotes"], r["n_linked"], r["parent_turn"], r["root_turn"]) for r in got} == want
    text = {(r[0], r[1]): r[3] for r in rows}
    for r in got:
        _, own, deepest = parse(text[r["conv_id"], r["turn"]])
        assert r["quote_levels"] == deepest and r["own_text"].strip() == own.strip()
    for conv in {r[0] for r in rows}:
        mine = sorted((r["position"], r["root_turn"], r["turn"]) for r in got if r["conv_id"] == conv)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_random_threads(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(rng.randint(1, 25)):
            lines = []
            if texts and rng.random() < 0.7:
                lines += ["> " + x for x in rng.choice(texts).split("\n")]
            if texts and rng.random() < 0.2:
                lines += [">  > Common line"]
            if rng.random() < 0.2:
                lines += ["", "common   LINE"]
            lines += [f"own {conv} {turn}" if rng.random() < 0.8 else "thanks", ""][: rng.randint(1, 2)]
            texts.append("\n".join(lines))
            rows.append((conv, turn * 700, "user", texts[-1]))
    check(spark, rows)


def test_one_hot_conversation_and_passage(spark):
    rows = [(1, k, "user", "hello\n" + (f"> hello\nreply {k}" if k % 3 else f"\ntopic {k}")) for k in range(2500)]
    rows += [(k, 0, "user", "hello") for k in range(2, 40)]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.rebuild(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[1, k]["parent_turn"] == (k - 1 if k % 3 else None) for k in range(2500))
    assert sorted(r["position"] for (c, _), r in got.items() if c == 1) == list(range(2500))


def test_odd(spark):
    rows = [(None, 0, "u", "q"), (None, 1, "u", "> q"), (1, None, None, "> Fine"), (1, 0, "u", None), (1, 0, "u", None), (1, 1, "u", ""), (1, 2, None, ">" * 40 + " deep\n" + "long " * 20_000)]
    got = quotes.rebuild(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 7
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[None, 1]["parent_turn"] == 0 and by[1, None]["root_turn"] is None and by[1, None]["position"] == 4
    assert by[1, 2]["quote_levels"] == 40 and by[1, 2]["n_linked"] == 0
    assert quotes.rebuild(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_runs_take_no_more_than_their_length(spark):
    """50,000 marks on a line, 100,000 blanks inside and around a text, 20,000 quoted lines, a mark after a carriage return."""
    said = "\n".join(f"line {k}" for k in range(20_000))
    texts = [said, "\n".join("> " + x for x in said.split("\n")), ">" * 50_000 + " deep", "a" + " " * 100_000 + "b\n" + " " * 100_000, "\n" * 50_000 + "x" + " \n" * 50_000 + "y", "one\r> two"]
    spark.range(1).count()
    began = time.time()
    got = quotes.rebuild(spark.createDataFrame([(1, k, "u", t, 0) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string, level int")).collect()
    assert time.time() - began < 60
    by = {r["turn"]: r for r in got}
    assert by[1]["parent_turn"] == 0 and by[1]["n_linked"] == 1 and by[2]["quote_levels"] == 50_000
    assert by[3]["own_text"] == "a" + " " * 100_000 + "b" and by[4]["own_text"] == "x" + " \n" * 50_000 + "y" and by[5]["quote_levels"] == 0


def test_chats_without_quotes_keep_their_order(spark, sf):
    got = queries.op2_quotation_linking(spark, sf).collect()
    source = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert len(got) == len(source)
    assert all(r["parent_turn"] is None and r["root_turn"] == r["turn"] and r["n_quotes"] == 0 for r in got)
    text = {(r["conv_id"], r["turn"]): r["text"] for r in source}
    assert all(r["own_text"].strip() == text[r["conv_id"], r["turn"]].strip() for r in got)
