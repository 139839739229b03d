"""The same queries in SQL, written apart from the DataFrame code, for DuckDB on the same tables."""

from __future__ import annotations

MATCHES = """
fl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1),
m0 AS (SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS day, r_name AS league, hn.n_name AS home, an.n_name AS away,
         CAST(floor(l_quantity) AS BIGINT) % 5 AS home_goals, CAST(floor(l_extendedprice) AS BIGINT) % 4 AS away_goals,
         CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey % 15 END AS home_shots, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_partkey % 11 END AS away_shots
       FROM orders JOIN fl ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation hn ON hn.n_nationkey = c_nationkey
       JOIN region ON r_regionkey = hn.n_regionkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation an ON an.n_nationkey = s_nationkey WHERE hn.n_name <> an.n_name),
m AS (SELECT *, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS result FROM m0),
t0 AS (SELECT match_id, day, league, home AS team, away AS opponent, true AS is_home, home_goals AS gf, away_goals AS ga, home_shots AS shots FROM m
       UNION ALL SELECT match_id, day, league, away, home, false, away_goals, home_goals, away_shots FROM m),
t AS (SELECT *, CASE WHEN gf > ga THEN 'W' WHEN gf < ga THEN 'L' ELSE 'D' END AS outcome FROM t0)
"""
FORM = """
f0 AS (SELECT match_id, team, day, row_number() OVER w AS k, CASE outcome WHEN 'W' THEN 1.0::DOUBLE WHEN 'L' THEN 0.0::DOUBLE ELSE 0.4::DOUBLE END AS v, gf, ga FROM t WINDOW w AS (PARTITION BY team ORDER BY day, match_id)),
f AS (SELECT a.match_id, a.team, count(b.k) AS n_form,
        CASE WHEN count(b.k) = 0 THEN 0.0::DOUBLE ELSE round(sum(b.v * pow(2.0::DOUBLE, b.k - greatest(a.k - 10, 1))) / (pow(2.0::DOUBLE, count(b.k)) - 1), 4) END AS form_score,
        avg(b.gf) AS avg_for, avg(b.ga) AS avg_against
      FROM f0 a LEFT JOIN f0 b ON b.team = a.team AND b.k BETWEEN a.k - 10 AND a.k - 1 GROUP BY a.match_id, a.team, a.k)
"""
H2H = """
h0 AS (SELECT *, least(home, away) AS one, greatest(home, away) AS two, CASE result WHEN 'H' THEN home WHEN 'A' THEN away END AS winner FROM m),
h AS (SELECT match_id, count(*) OVER w AS meetings,
        coalesce(sum(CASE WHEN winner = one THEN 1 ELSE 0 END) OVER w, 0) AS w1, coalesce(sum(CASE WHEN winner = two THEN 1 ELSE 0 END) OVER w, 0) AS w2, home = one AS straight
      FROM h0 WINDOW w AS (PARTITION BY one, two ORDER BY day, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
hh AS (SELECT match_id, meetings, CASE WHEN straight THEN w1 ELSE w2 END AS home_wins, CASE WHEN straight THEN w2 ELSE w1 END AS away_wins FROM h),
g AS (SELECT *, CASE WHEN meetings > 0 THEN 0.15::DOUBLE * (home_wins - away_wins) / meetings ELSE 0.0::DOUBLE END AS modifier FROM hh)
"""
PREDICTED = """
r AS (SELECT match_id, team, form_score,
        round(coalesce(least(least(avg_for / 2.0::DOUBLE, 1.0::DOUBLE) * 1.5::DOUBLE * 0.6::DOUBLE + avg_for * 0.2::DOUBLE, 2.5::DOUBLE), 1.0::DOUBLE), 4) AS att,
        round(coalesce(least(avg_against, 2.5::DOUBLE), 1.0::DOUBLE), 4) AS def FROM f),
x0 AS (SELECT m.match_id, m.league, m.day, m.result, g.meetings, g.modifier,
         a.att * (0.6::DOUBLE + b.def / 2.5::DOUBLE * 0.8::DOUBLE) * 1.35::DOUBLE * (0.6::DOUBLE * (0.8::DOUBLE + a.form_score * 0.4::DOUBLE) + 0.4::DOUBLE) * 1.12::DOUBLE AS xh,
         b.att * (0.6::DOUBLE + a.def / 2.5::DOUBLE * 0.8::DOUBLE) * 1.35::DOUBLE * (0.6::DOUBLE * (0.8::DOUBLE + b.form_score * 0.4::DOUBLE) + 0.4::DOUBLE) * 0.92::DOUBLE AS xa
       FROM m JOIN g USING (match_id) JOIN r a ON a.match_id = m.match_id AND a.team = m.home JOIN r b ON b.match_id = m.match_id AND b.team = m.away),
x AS (SELECT match_id, league, day, result, round(greatest(CASE WHEN meetings >= 2 THEN xh * (1 + modifier) ELSE xh END, 0.2::DOUBLE), 4) AS home_xg,
        round(greatest(CASE WHEN meetings >= 2 THEN xa * (1 - modifier) ELSE xa END, 0.2::DOUBLE), 4) AS away_xg FROM x0),
k AS (SELECT range AS n, CAST(factorial(CAST(range AS INTEGER)) AS DOUBLE) AS nf FROM range(9)),
p AS (SELECT match_id, any_value(league) AS league, any_value(day) AS day, any_value(result) AS result, any_value(home_xg) AS home_xg, any_value(away_xg) AS away_xg,
        sum(CASE WHEN i.n > j.n THEN q ELSE 0 END) AS p_home, sum(CASE WHEN i.n = j.n THEN q ELSE 0 END) AS p_draw, sum(CASE WHEN i.n < j.n THEN q ELSE 0 END) AS p_away
      FROM (SELECT x.*, i, j, exp(-home_xg) * pow(home_xg, i.n) / i.nf * exp(-away_xg) * pow(away_xg, j.n) / j.nf AS q FROM x, k i, k j) GROUP BY match_id)
"""
QUOTES = """
q AS (SELECT l_orderkey AS match_id, l_returnflag AS bookmaker, l_shipdate AS captured, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
        1.0::DOUBLE + l_quantity / 20.0::DOUBLE AS home_price, 2.0::DOUBLE + l_discount * 20.0::DOUBLE AS draw_price, 0.9::DOUBLE + l_tax * 50.0::DOUBLE AS away_price FROM lineitem),
qv AS (SELECT * FROM q WHERE home_price > 1 AND draw_price > 1 AND away_price > 1),
qn AS (SELECT *, row_number() OVER (PARTITION BY match_id, bookmaker ORDER BY captured, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS a,
         row_number() OVER (PARTITION BY match_id, bookmaker ORDER BY captured DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS z FROM qv),
oc AS (SELECT match_id, bookmaker, count(*) AS n_quotes, max(CASE WHEN a = 1 THEN home_price END) AS open_home_price, max(CASE WHEN a = 1 THEN draw_price END) AS open_draw_price, max(CASE WHEN a = 1 THEN away_price END) AS open_away_price,
         max(CASE WHEN z = 1 THEN home_price END) AS close_home_price, max(CASE WHEN z = 1 THEN draw_price END) AS close_draw_price, max(CASE WHEN z = 1 THEN away_price END) AS close_away_price FROM qn GROUP BY match_id, bookmaker)
"""
BETS = """
b0 AS (SELECT p.match_id, p.result, p_home, p_draw, p_away, close_home_price AS hp, close_draw_price AS dp, close_away_price AS ap, 1 / close_home_price + 1 / close_draw_price + 1 / close_away_price AS total, bookmaker FROM p JOIN oc USING (match_id)),
b1 AS (SELECT match_id, bookmaker, result, 'H' AS selection, hp AS price, p_home AS pr, 1 / hp / total AS fair FROM b0 UNION ALL SELECT match_id, bookmaker, result, 'D', dp, p_draw, 1 / dp / total FROM b0 UNION ALL SELECT match_id, bookmaker, result, 'A', ap, p_away, 1 / ap / total FROM b0),
b2 AS (SELECT *, round((pr - fair) / fair * 100, 2) AS edge FROM b1),
bets AS (SELECT *, CASE WHEN edge >= 25 THEN 'elite' WHEN edge >= 15 THEN 'high' WHEN edge >= 8 THEN 'medium' ELSE 'low' END AS rating,
           CASE WHEN pr > 0 THEN round(10.0::DOUBLE * greatest(((price - 1) * pr - (1 - pr)) / (price - 1), 0.0::DOUBLE) * 0.25::DOUBLE, 2) ELSE 0.0::DOUBLE END AS stake FROM b2 WHERE edge >= 5)
"""
CALLS = """
c AS (SELECT event_id, event_type AS provider, ts AS called_at, event_id % 9 <> 0 AS success, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 10.0::DOUBLE END AS latency_ms,
        CASE WHEN event_id % 9 <> 0 THEN NULL WHEN event_id % 27 = 0 THEN 'quota' WHEN event_id % 18 = 0 THEN 'timeout' WHEN event_id % 45 = 0 THEN 'server' ELSE 'parse' END AS reason FROM events),
cw AS (SELECT provider, hours, count(*) AS calls, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS errors, avg(CASE WHEN success THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS success_rate, avg(latency_ms) AS latency_ms
       FROM (SELECT *, (SELECT max(called_at) FROM c) AS e FROM c), (VALUES (24), (168)) AS w(hours) WHERE epoch(e) - epoch(called_at) < hours * 3600 GROUP BY provider, hours)
"""
ELO = """
em AS (SELECT match_id, row_number() OVER (ORDER BY day, match_id) AS k, home, away, home_goals AS hg, away_goals AS ag FROM m),
tn AS (SELECT team, row_number() OVER (ORDER BY team) AS i FROM (SELECT home AS team FROM m UNION SELECT away FROM m)),
e AS (SELECT k, match_id, h.i AS h, a.i AS a, hg, ag FROM em JOIN tn h ON h.team = home JOIN tn a ON a.team = away),
z AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS match_id, 0.0::DOUBLE AS hb, 0.0::DOUBLE AS ab, 0.0::DOUBLE AS ha, 0.0::DOUBLE AS aa, list_transform(range(1, (SELECT count(*) FROM tn) + 1), lambda x: 1500.0::DOUBLE) AS r, list_transform(range(1, (SELECT count(*) FROM tn) + 1), lambda x: 0) AS c
  UNION ALL
  SELECT k, match_id, hb, ab, hn, an, list_transform(r, lambda x, i: CASE i WHEN h THEN hn WHEN a THEN an ELSE x END), list_transform(c, lambda x, i: CASE WHEN i = h OR i = a THEN x + 1 ELSE x END)
  FROM (SELECT *, hb + CASE WHEN c[h] < 10 THEN 40 ELSE 32 END * mult * (s - ex) AS hn, ab - CASE WHEN c[a] < 10 THEN 40 ELSE 32 END * mult * (s - ex) AS an
    FROM (SELECT *, 1 / (1 + pow(10.0::DOUBLE, -(hb + 50.0::DOUBLE - ab) / 400)) AS ex, CASE WHEN hg > ag THEN 1.0::DOUBLE WHEN hg < ag THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS s,
            CASE WHEN hg = ag THEN 1.0::DOUBLE ELSE ln(abs(hg - ag) + 1) * (4.4::DOUBLE / (0.0005::DOUBLE * CASE WHEN hg > ag THEN hb + 50.0::DOUBLE - ab ELSE ab - 50.0::DOUBLE - hb END + 4.4::DOUBLE)) END AS mult
      FROM (SELECT e.k, e.match_id, e.h, e.a, e.hg, e.ag, z.r, z.c, z.r[e.h] AS hb, z.r[e.a] AS ab FROM z JOIN e ON e.k = z.k + 1))))
"""
RES = "CASE result WHEN 'H' THEN p_home WHEN 'D' THEN p_draw ELSE p_away END"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n"


def oracle_sql() -> dict[str, str]:
    base, pred = _with(MATCHES), _with(MATCHES, FORM, H2H, PREDICTED)
    metric = f"""count(*) AS n, round(avg(CASE WHEN (CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'H' WHEN p_draw >= p_away THEN 'D' ELSE 'A' END) = result THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy,
        round(avg(-ln(least(greatest({RES}, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE))), 6) AS log_loss,
        round(avg(pow(p_home - (result = 'H')::INT, 2) + pow(p_draw - (result = 'D')::INT, 2) + pow(p_away - (result = 'A')::INT, 2)), 6) AS brier"""
    out = {
        "league_report": pred + f"SELECT league, {metric} FROM p GROUP BY league UNION ALL SELECT NULL, {metric} FROM p",
        "matches": base + "SELECT * FROM m",
        "team_form": _with(MATCHES, FORM) + "SELECT match_id, team, n_form, round(form_score, 6) AS form_score, round(avg_for, 6) AS avg_for, round(avg_against, 6) AS avg_against FROM f",
        "team_shots": base + """, s AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY day, match_id) AS k FROM t),
            kn AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY k) AS j FROM s WHERE shots IS NOT NULL),
            c AS (SELECT s.match_id, s.team, (SELECT count(*) FROM kn WHERE kn.team = s.team AND kn.k < s.k) AS n FROM s)
            SELECT c.match_id, c.team, round(avg(kn.shots), 6) AS avg_shots FROM c LEFT JOIN kn ON kn.team = c.team AND kn.j BETWEEN c.n - 9 AND c.n GROUP BY c.match_id, c.team""",
        "head_to_head": _with(MATCHES, H2H) + "SELECT match_id, meetings, CAST(home_wins AS BIGINT) AS home_wins, CAST(away_wins AS BIGINT) AS away_wins, round(modifier, 6) AS modifier FROM g",
        "rest_days": base + ", d AS (SELECT match_id, team, date_diff('day', lag(day) OVER (PARTITION BY team ORDER BY day, match_id), day) AS rest_days FROM t) SELECT match_id, team, CAST(rest_days AS BIGINT) AS rest_days, CASE WHEN rest_days < 4 THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS modifier FROM d",
        "final_standings": base + """, s AS (SELECT league, CAST(year(day - INTERVAL 6 MONTH) AS BIGINT) AS season, team, count(*) AS played, CAST(sum(CASE outcome WHEN 'W' THEN 3 WHEN 'D' THEN 1 ELSE 0 END) AS BIGINT) AS points,
            CAST(sum(gf - ga) AS BIGINT) AS goal_difference, CAST(sum(gf) AS BIGINT) AS goals_for FROM t GROUP BY 1, 2, 3)
            SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY points DESC, goal_difference DESC, goals_for DESC, team) AS rank FROM s""",
        "standings_as_of": base + """, s AS (SELECT *, year(day - INTERVAL 6 MONTH) AS season, row_number() OVER (ORDER BY day, match_id) AS k FROM t),
            o AS (SELECT match_id, min(k) AS k FROM s GROUP BY match_id), u AS (SELECT s.* EXCLUDE (k), o.k FROM s JOIN o USING (match_id)),
            run AS (SELECT league, season, team, k, sum(CASE outcome WHEN 'W' THEN 3 WHEN 'D' THEN 1 ELSE 0 END) OVER w AS p, sum(gf - ga) OVER w AS gd, sum(gf) OVER w AS g, first_value(k) OVER w AS seen FROM u WINDOW w AS (PARTITION BY league, season, team ORDER BY k)),
            pairs AS (SELECT a.match_id, a.k, b.team, a.league, a.season FROM (SELECT DISTINCT match_id, k, league, season FROM u) a JOIN (SELECT DISTINCT league, season, team FROM u) b USING (league, season)),
            st AS (SELECT pairs.match_id, pairs.team, run.p, run.gd, run.g, run.seen FROM pairs ASOF JOIN run ON run.league = pairs.league AND run.season = pairs.season AND run.team = pairs.team AND run.k < pairs.k),
            ra AS (SELECT match_id, team, row_number() OVER (PARTITION BY match_id ORDER BY p DESC, gd DESC, g DESC, seen, team) AS rank FROM st)
            SELECT t.match_id, t.team, ra.rank FROM t LEFT JOIN ra USING (match_id, team)""",
        "elo_replay": _with(MATCHES, ELO).replace("WITH", "WITH RECURSIVE", 1) + "SELECT match_id, league, round(hb) AS home_elo, round(ab) AS away_elo, round(ha) AS home_elo_after, round(aa) AS away_elo_after FROM z JOIN m USING (match_id)",
        "latest_elo": _with(MATCHES, ELO).replace("WITH", "WITH RECURSIVE", 1) + ", s AS (SELECT home AS team, k, ha AS elo FROM z JOIN m USING (match_id) UNION ALL SELECT away, k, aa FROM z JOIN m USING (match_id)) SELECT team, round(max_by(elo, k)) AS elo FROM s GROUP BY team",
        "predictions": pred + "SELECT match_id, league, day, result, round(home_xg, 6) AS home_xg, round(away_xg, 6) AS away_xg, round(p_home, 6) AS p_home, round(p_draw, 6) AS p_draw, round(p_away, 6) AS p_away FROM p",
        "calibration": pred + """, e AS (SELECT 'H' AS class, p_home AS pr, (result = 'H')::INT::DOUBLE AS hit FROM p UNION ALL SELECT 'D', p_draw, (result = 'D')::INT::DOUBLE FROM p UNION ALL SELECT 'A', p_away, (result = 'A')::INT::DOUBLE FROM p),
            bn AS (SELECT class, least(greatest(CAST(floor(pr * 10) AS BIGINT), 0), 9) AS bin, count(*) AS n, avg(pr) AS mean_p, avg(hit) AS rate FROM e GROUP BY 1, 2)
            SELECT class, bin, coalesce(n, 0) AS n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM (SELECT DISTINCT class FROM e) JOIN (SELECT range AS bin FROM range(10)) ON true LEFT JOIN bn USING (class, bin)""",
        "temperature": pred + f"""SELECT temperature, round(avg(ln(exp(ln(greatest(p_home, 1e-10::DOUBLE)) / temperature) + exp(ln(greatest(p_draw, 1e-10::DOUBLE)) / temperature) + exp(ln(greatest(p_away, 1e-10::DOUBLE)) / temperature)) - ln(greatest({RES}, 1e-10::DOUBLE)) / temperature), 6) AS log_loss
            FROM p, (SELECT unnest([0.5::DOUBLE, 0.75::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE]) AS temperature) GROUP BY temperature""",
        "blended": pred + """, w AS (SELECT *, 0.35::DOUBLE * least((match_id % 200) / 150.0::DOUBLE, 1.0::DOUBLE) AS w FROM p), v AS (SELECT match_id, (1 - w) * p_home + w / 3 AS a, (1 - w) * p_draw + w / 3 AS b, (1 - w) * p_away + w / 3 AS c FROM w)
            SELECT match_id, round(a / (a + b + c), 4) AS b_home, round(b / (a + b + c), 4) AS b_draw, round(c / (a + b + c), 4) AS b_away FROM v""",
        "open_and_close": _with(QUOTES) + "SELECT match_id, bookmaker, n_quotes, " + ", ".join(f"round({k}_{s}_price, 6) AS {k}_{s}_price" for k in ("open", "close") for s in ("home", "draw", "away")) + " FROM oc",
        "best_prices": _with(QUOTES) + "SELECT match_id, round(max(home_price), 6) AS home_price, round(max(draw_price), 6) AS draw_price, round(max(away_price), 6) AS away_price, first(bookmaker ORDER BY home_price DESC, bookmaker) AS bookmaker FROM qv GROUP BY match_id",
        "value_bets": _with(MATCHES, FORM, H2H, PREDICTED, QUOTES, BETS) + "SELECT match_id, bookmaker, selection, round(price, 4) AS price, edge, rating, stake FROM bets",
        "portfolio": _with(MATCHES, FORM, H2H, PREDICTED, QUOTES, BETS) + """, s AS (SELECT selection, count(*) AS bets, CAST(sum((selection = result)::INT) AS BIGINT) AS won, sum(stake) AS staked, sum(CASE WHEN selection = result THEN stake * (price - 1) ELSE -stake END) AS profit FROM bets GROUP BY selection)
            SELECT selection, bets, won, round(staked, 4) AS staked, round(profit, 4) AS profit, round(profit / staked * 100, 4) AS roi FROM s""",
        "source_rank": """SELECT l_orderkey, value, l_returnflag FROM (SELECT l_orderkey, l_quantity AS value, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 WHEN 'N' THEN 3 ELSE 99 END, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k
            FROM lineitem WHERE l_partkey % 4 <> 0) WHERE k = 1""",
        "fill_missing_shots": base + "SELECT match_id, coalesce(home_shots, home_goals + 5) AS home_shots, coalesce(away_shots, CASE WHEN match_id % 2 = 0 THEN away_goals + 3 END) AS away_shots FROM m",
        "natural_key_dedupe": base + "SELECT home, away, league, day, match_id, home_goals, away_goals FROM (SELECT *, row_number() OVER (PARTITION BY home, away, league, day ORDER BY match_id) AS k FROM m) WHERE k = 1",
        "equivalence_diff": base + """, st AS (SELECT CASE WHEN match_id % 11 = 0 THEN -match_id ELSE match_id END AS match_id, league, CASE WHEN match_id % 7 = 0 THEN home_goals + 1 ELSE home_goals END AS home_goals, CASE WHEN match_id % 5 = 0 THEN NULL ELSE away_shots END AS away_shots FROM m),
            j AS (SELECT a.match_id AS ia, b.match_id AS ib, a.league <> b.league AS d1, a.home_goals <> b.home_goals AS d2, a.away_shots IS DISTINCT FROM b.away_shots AS d3 FROM m a FULL JOIN st b ON a.match_id = b.match_id),
            s AS (SELECT *, CASE WHEN ia IS NULL THEN 'only_stored' WHEN ib IS NULL THEN 'only_live' ELSE 'matched' END AS status FROM j)
            SELECT status, '*' AS field, count(*) AS n FROM s GROUP BY status UNION ALL SELECT status, 'home_goals', count(*) FROM s WHERE status = 'matched' AND d2 GROUP BY status
            UNION ALL SELECT status, 'league', count(*) FROM s WHERE status = 'matched' AND d1 GROUP BY status UNION ALL SELECT status, 'away_shots', count(*) FROM s WHERE status = 'matched' AND d3 GROUP BY status""",
        "audited_backfill": base + """, r AS (SELECT CASE WHEN match_id % 4 <> 3 THEN day END AS day, home, away, CASE WHEN match_id % 13 = 0 THEN home_goals + 1 ELSE home_goals END AS g FROM m),
            j AS (SELECT l.match_id, count(r.g) AS n, max(CASE WHEN r.g = l.home_goals THEN 1 ELSE 0 END) AS same FROM m l LEFT JOIN r ON r.day = l.day AND r.home = l.home AND r.away = l.away GROUP BY l.match_id)
            SELECT CASE WHEN n = 0 THEN 'no_match' WHEN n > 1 THEN 'ambiguous' WHEN same = 0 THEN 'mismatch' ELSE 'filled' END AS outcome, count(*) AS n FROM j GROUP BY 1""",
        "alias_candidates": _with(MATCHES.replace("hn.n_name AS home, an.n_name AS away", "hn.n_name || ' ' || c_custkey % 7 AS home, an.n_name || ' ' || s_suppkey % 7 AS away").replace("hn.n_name <> an.n_name", "(hn.n_name <> an.n_name OR c_custkey % 7 <> s_suppkey % 7)")) + """, s AS (SELECT DISTINCT day, league, 'h' AS side, home AS name, away AS other, home_goals, away_goals FROM m UNION SELECT DISTINCT day, league, 'a', away, home, home_goals, away_goals FROM m),
            c AS (SELECT a.name AS one, b.name AS two, count(*) AS evidence FROM s a JOIN s b USING (day, league, side, other, home_goals, away_goals) WHERE a.name < b.name GROUP BY 1, 2)
            SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE least(home, away) = one AND greatest(home, away) = two)""",
        "identity_conflicts": base + """SELECT home, away, day, count(*) AS copies, CAST(coalesce((count(DISTINCT home_goals) > 1)::INT, 0) + coalesce((count(DISTINCT away_goals) > 1)::INT, 0) + coalesce((count(DISTINCT home_shots) > 1)::INT, 0) AS BIGINT) AS n_conflicts FROM m GROUP BY home, away, day HAVING count(*) > 1""",
        "validation": _with(QUOTES) + """, r AS (SELECT *, CASE WHEN home_price IS NULL THEN 'no_price' WHEN NOT (home_price > 1 AND draw_price > 1 AND away_price > 1) THEN 'price_not_above_1' WHEN NOT captured < TIMESTAMP '2023-01-01' THEN 'late' END AS reason FROM q),
            v AS (SELECT reason, row_number() OVER (PARTITION BY match_id, bookmaker, reason IS NULL ORDER BY captured) AS k FROM r) SELECT coalesce(reason, CASE WHEN k > 1 THEN 'duplicate' ELSE 'valid' END) AS reason, count(*) AS n FROM v GROUP BY 1""",
        "key_drift": base + """, b AS (SELECT DISTINCT CASE WHEN match_id % 5 = 0 THEN -match_id ELSE match_id END AS k FROM m), n AS (SELECT DISTINCT CASE WHEN match_id % 7 = 0 THEN -match_id ELSE match_id END AS k FROM m)
            SELECT 'new' AS status, count(*) AS n FROM (SELECT k FROM n EXCEPT SELECT k FROM b) UNION ALL SELECT 'resolved', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM n)""",
        "provider_windows": _with(CALLS) + "SELECT provider, CAST(hours AS BIGINT) AS hours, calls, errors, round(success_rate, 6) AS success_rate, round(latency_ms, 6) AS latency_ms FROM cw",
        "provider_errors": _with(CALLS) + "SELECT provider, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in ("quota", "timeout", "parse")) + ", count(*) FILTER (reason = 'server') AS other FROM c GROUP BY provider",
        "provider_rollup": _with(CALLS) + """, d AS (SELECT provider, CAST(called_at AS DATE) AS day, count(*) AS calls, count(*) FILTER (NOT success) AS errors, avg(latency_ms) AS l FROM c GROUP BY 1, 2)
            SELECT provider, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(errors) AS BIGINT) AS errors, max(errors) AS worst_day, round(sum(l * calls) / sum(CASE WHEN l IS NOT NULL THEN calls END), 6) AS latency_ms FROM d GROUP BY provider""",
        "provider_choice": _with(CALLS) + """, s AS (SELECT provider, 0.5::DOUBLE * success_rate + 0.3::DOUBLE * coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - latency_ms / 2000.0::DOUBLE)), 0.5::DOUBLE) + 0.2::DOUBLE * (1 - calls / (SELECT sum(calls) FROM cw WHERE hours = 168)::DOUBLE) AS score FROM cw WHERE hours = 168)
            SELECT provider, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, provider) AS place FROM s""",
        "provider_quota": _with(CALLS) + 'SELECT provider, CAST(hours AS BIGINT) AS hours, greatest(1000 - calls, 0) AS "left", round(greatest(1000 - calls, 0) / (calls / hours::DOUBLE), 6) AS hours_left FROM cw',
        "divergence_spread": pred + """, v AS (SELECT league, abs(round(home_xg - away_xg, 4)) AS v, row_number() OVER (PARTITION BY league ORDER BY abs(round(home_xg - away_xg, 4)), match_id) - 1 AS k, count(*) OVER (PARTITION BY league) AS n FROM p)
            SELECT league, count(*) AS n, count(*) FILTER (v = 0) AS n_zero, count(*) FILTER (v > 0 AND v <= 0.5) AS n_small, count(*) FILTER (v > 0.5) AS n_material, round(max(v), 6) AS most, round(avg(v), 6) AS mean,
            round(max(CASE WHEN k = floor(n / 2) THEN v END), 6) AS median, round(max(CASE WHEN k = floor(n * 0.95::DOUBLE) THEN v END), 6) AS p95 FROM v GROUP BY league""",
        "degraded_run": base + ", v AS (SELECT home, result <> 'A' AS ok, row_number() OVER (PARTITION BY home ORDER BY day DESC, match_id DESC) AS k FROM m) SELECT home, coalesce(min(CASE WHEN NOT ok THEN k END) - 1, count(*)) AS run FROM v GROUP BY home",
        "trend": base + """, v AS (SELECT home, CAST(home_goals + away_goals AS DOUBLE) AS g, row_number() OVER (PARTITION BY home ORDER BY day, match_id) AS k, count(*) OVER (PARTITION BY home) AS n FROM m), e AS (SELECT home, avg(CASE WHEN k <= floor(n / 2) THEN g END) AS early, avg(CASE WHEN k > floor(n / 2) THEN g END) AS late FROM v GROUP BY home)
            SELECT home, round(early, 6) AS early, round(late, 6) AS late, late > early AS worse FROM e""",
        "walk_forward": base + ", v AS (SELECT day, (row_number() OVER (ORDER BY day, match_id) * 6 - 1) // (SELECT count(*) FROM m) AS segment FROM m) SELECT segment, count(*) AS n, min(day) AS since, max(day) AS until FROM v GROUP BY segment",
        "keys_and_seasons": base + """, v AS (SELECT *, lower(home) || '||' || lower(away) || '||' || CAST(day AS VARCHAR) AS match_key, CAST(year(day - INTERVAL 6 MONTH) AS BIGINT) AS season FROM m)
            SELECT match_id, match_key, 'hist_' || substr(sha256(match_key), 1, 16) AS fixture, season, season || '-' || (season + 1) AS season_label, CASE lower(trim(home)) WHEN 'united states' THEN 'usa' WHEN 'united kingdom' THEN 'gbr' ELSE trim(home) END AS home_name FROM v""",
        "parsed_statistics": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS leading, CAST(p_size AS DOUBLE) AS share, CAST('7' || p_size AS BIGINT) AS digits, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part",
        "latest_per_key": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
        "page_titles": "SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<li')) AS BIGINT) AS items FROM pages",
    }
    return out
