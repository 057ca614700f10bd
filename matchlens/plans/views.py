"""The derived entities of ``sources.tables`` again, as SQL for the checks.

``check_sql(body, ...)`` puts the named views, and those they need, in front
of a query. Written separately from the DataFrame code on purpose.
"""

import re

VIEWS = {}

VIEWS["g0"] = """
SELECT o_orderkey AS k, c_nationkey AS hk, CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS INTEGER) AS ak,
       CAST(o_orderdate AS TIMESTAMP) AS day_ts, o_orderstatus AS st,
       CAST(round(o_totalprice * 100) AS BIGINT) AS p,
       CAST(floor(o_totalprice * 100 / 161) AS BIGINT) AS q
FROM orders JOIN customer ON o_custkey = c_custkey"""

VIEWS["games"] = """
SELECT k AS game_id,
       CASE k % 3 WHEN 0 THEN 'MLB' WHEN 1 THEN 'NFL' ELSE 'NBA' END AS sport,
       CAST(day_ts AS DATE) AS game_date,
       day_ts + to_hours(CAST(12 + k % 12 AS INTEGER)) AS start_ts,
       h.n_name AS home_team, a.n_name AS away_team,
       CASE st WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Scheduled' ELSE 'In Progress' END AS status_state,
       CASE st WHEN 'F' THEN 'historical' ELSE 'schedule' END AS data_type,
       CASE k % 3 WHEN 0 THEN 3.0::DOUBLE + (p % 40)::DOUBLE / 10 WHEN 1 THEN 17.0::DOUBLE + (p % 140)::DOUBLE / 10
            ELSE 105.0::DOUBLE + (p % 160)::DOUBLE / 10 END AS pred_home,
       CASE k % 3 WHEN 0 THEN 3.0::DOUBLE + (q % 40)::DOUBLE / 10 WHEN 1 THEN 17.0::DOUBLE + (q % 140)::DOUBLE / 10
            ELSE 105.0::DOUBLE + (q % 160)::DOUBLE / 10 END AS pred_away,
       CAST(CASE WHEN k % 2 = 0 THEN -(110 + k * 37 % 190) ELSE 95 + k * 37 % 190 END AS DOUBLE) AS ml_home,
       CAST(CASE WHEN k % 2 = 0 THEN 95 + k * 37 % 190 ELSE -(110 + k * 37 % 190) END AS DOUBLE) AS ml_away,
       CASE WHEN k % 17 = 0 THEN NULL
            WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN -1.5::DOUBLE ELSE 1.5::DOUBLE END
            ELSE (k * 13 % 29 - 14)::DOUBLE / 2 END AS spread_home_line,
       CASE k % 3 WHEN 0 THEN 8.5::DOUBLE WHEN 1 THEN 44.5::DOUBLE ELSE 221.0::DOUBLE END AS total_line,
       CASE WHEN st = 'F' THEN p % 40 + CASE WHEN p % 40 = q % 40 THEN 1 ELSE 0 END END AS home_final,
       CASE WHEN st = 'F' THEN q % 40 END AS away_final
FROM g0 JOIN nation h ON hk = h.n_nationkey JOIN nation a ON ak = a.n_nationkey"""

# Parameters once more, column order MLB, NFL, NBA.
VIEWS["params"] = """
SELECT * FROM (VALUES
 ('MLB', 3.8::DOUBLE, 0.45::DOUBLE, 0.0028::DOUBLE, 0.22::DOUBLE, 0.32::DOUBLE,
  0.5::DOUBLE, 1.1::DOUBLE, 2.8::DOUBLE, 0.1::DOUBLE, 0.28::DOUBLE, 0.68::DOUBLE,
  0.0028::DOUBLE, 0.0075::DOUBLE, 0.017::DOUBLE, 0.0028::DOUBLE, 0.0075::DOUBLE, 0.017::DOUBLE,
  0.35::DOUBLE, 0.6::DOUBLE, 0.006::DOUBLE, 0.6::DOUBLE, -330::DOUBLE, 1.4::DOUBLE,
  0.008::DOUBLE, 0.0035::DOUBLE, -1e9::DOUBLE),
 ('NFL', 13, 0.7, 0.0032, 0.34, 0.4, 0.6, 1.2, 3.5, 0.28, 0.7, 1.2, 0.0032, 0.008, 0.021,
  0.003, 0.009, 0.02, 0.8, 3.0, 0.007, 0.7, -240, 2.0, 0.014, 0.007, 0.002),
 ('NBA', 12, 1.0, 0.0045, 0.42, 0.48, 1.0, 2.0, 3.8, 0.35, 0.85, 1.35, 0.0055, 0.014, 0.028,
  0.0055, 0.014, 0.028, 1.5, 2.0, 0.01, 0.8, -200, 2.3, 0.018, 0.009, 0.003)
) t(psport, sigma, dz_e, dz_ev, z_any, z_mh, d1, d2, d3, z1, z2, z3, v1, v2, v3, g1, g2, g3,
    near, sw, sw_ev, sw_e, plim, pe, kh, km, kl)"""

VIEWS["e1"] = """
SELECT *, pred_home - pred_away AS margin, (pred_home - pred_away) / sigma AS x,
       CASE WHEN ml_home > 0 THEN 100.0::DOUBLE / (ml_home + 100) ELSE -ml_home / (-ml_home + 100) END AS rh,
       CASE WHEN ml_away > 0 THEN 100.0::DOUBLE / (ml_away + 100) ELSE -ml_away / (-ml_away + 100) END AS ra,
       CASE WHEN ml_home > 0 THEN ml_home / 100 ELSE 100.0::DOUBLE / abs(ml_home) END AS bh,
       CASE WHEN ml_away > 0 THEN ml_away / 100 ELSE 100.0::DOUBLE / abs(ml_away) END AS ba
FROM {games} JOIN params ON sport = psport"""

VIEWS["e2"] = """
SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + abs(x) * 0.2316419::DOUBLE) AS t FROM e1"""

VIEWS["e3"] = """
SELECT *, 1.0::DOUBLE - exp(-x * x / 2.0::DOUBLE) * 0.3989423::DOUBLE *
       (((((1.330274429::DOUBLE * t + (-1.821255978)::DOUBLE) * t + 1.781477937::DOUBLE) * t
         + (-0.356563782)::DOUBLE) * t + 0.31938153::DOUBLE) * t) AS up FROM e2"""

VIEWS["e4"] = """
SELECT *, greatest(0.01::DOUBLE, least(0.99::DOUBLE, CASE WHEN x < 0 THEN 1.0::DOUBLE - up ELSE up END)) AS mh,
       rh / (rh + ra) AS kh_mkt, ra / (rh + ra) AS ka_mkt,
       coalesce(abs(margin + spread_home_line), 1e300::DOUBLE) AS delta FROM e3"""

VIEWS["e5"] = """
SELECT *, mh * bh - (1.0::DOUBLE - mh) AS evh,
       (1.0::DOUBLE - mh) * ba - (1.0::DOUBLE - (1.0::DOUBLE - mh)) AS eva,
       (mh - kh_mkt) * 100 AS eh, ((1.0::DOUBLE - mh) - ka_mkt) * 100 AS ea FROM e4"""

VIEWS["e6"] = """
SELECT *, evh > eva OR (evh = eva AND abs(eh) >= abs(ea)) AS hb FROM e5"""

VIEWS["e7"] = """
SELECT *, CASE WHEN hb THEN 'HOME' ELSE 'AWAY' END AS side,
       CASE WHEN hb THEN eh ELSE ea END AS edge_pct,
       abs(CASE WHEN hb THEN eh ELSE ea END) AS e,
       CASE WHEN hb THEN mh ELSE 1.0::DOUBLE - mh END AS model_prob,
       CASE WHEN hb THEN kh_mkt ELSE ka_mkt END AS market_prob,
       CASE WHEN hb THEN evh ELSE eva END AS ev,
       CASE WHEN hb THEN bh ELSE ba END AS pay,
       CASE WHEN hb THEN ml_home ELSE ml_away END AS price,
       abs(x) AS z, abs(x) * 0.75::DOUBLE + exp(x * x * (-0.5)::DOUBLE) * 0.25::DOUBLE AS zt,
       CASE sport WHEN 'MLB' THEN CASE WHEN abs(x) < 0.16::DOUBLE THEN 1.03::DOUBLE WHEN abs(x) < 0.28::DOUBLE THEN 1.01::DOUBLE ELSE 1 END
                  WHEN 'NFL' THEN CASE WHEN abs(x) < 0.24::DOUBLE THEN 1.15::DOUBLE WHEN abs(x) < 0.36::DOUBLE THEN 1.07::DOUBLE ELSE 1 END
                  ELSE CASE WHEN abs(x) < 0.25::DOUBLE THEN 1.25::DOUBLE WHEN abs(x) < 0.4::DOUBLE THEN 1.12::DOUBLE ELSE 1 END END AS tg
FROM e6"""

VIEWS["e8"] = """
SELECT *, (pay * model_prob - (1.0::DOUBLE - model_prob)) / pay AS kelly,
  CASE WHEN e < dz_e OR ev < dz_ev THEN 0
       WHEN ev >= 0.028::DOUBLE AND e >= 1.3::DOUBLE AND zt >= z_mh THEN 3
       WHEN ev >= 0.009::DOUBLE AND e >= 0.7::DOUBLE AND zt >= z_mh THEN 2
       WHEN ev >= 0.0033::DOUBLE AND e >= 0.42::DOUBLE THEN 1 ELSE 0 END AS t_ev,
  CASE WHEN e < dz_e OR ev < dz_ev THEN 0
       WHEN e >= d3 * tg AND z >= z3 * tg AND ev >= v3 * tg AND zt >= z_mh THEN 3
       WHEN zt >= z_mh AND ((e >= d2 * tg AND z >= z2 * tg) OR (e >= d2 * tg AND ev >= v2 * tg) OR (z >= z2 * tg AND ev >= v2 * tg)) THEN 2
       WHEN (e >= d1 * tg AND z >= z1 * tg) OR (e >= d1 * tg AND ev >= v1 * tg) OR (z >= z1 * tg AND ev >= v1 * tg) THEN 1
       ELSE 0 END AS t_dz
FROM e7 WHERE ev > 0 AND zt >= z_any"""

VIEWS["e9"] = """
SELECT *, CASE WHEN s3 = 1 AND ev < g1 THEN 0 ELSE s3 END AS t1 FROM (
  SELECT *, CASE WHEN s2 = 2 AND ev < g2 THEN 1 ELSE s2 END AS s3 FROM (
    SELECT *, CASE WHEN greatest(t_ev, t_dz) = 3 AND ev < g3 THEN 2 ELSE greatest(t_ev, t_dz) END AS s2 FROM e8))"""

VIEWS["e10"] = """
SELECT *, CASE WHEN t1 = 0 OR delta <= near * 0.33::DOUBLE THEN 0
               WHEN delta > near THEN t1 WHEN t1 = 3 THEN 2 WHEN sport = 'MLB' THEN 1 ELSE 0 END AS t2 FROM e9"""

VIEWS["e11"] = """
SELECT *, CASE WHEN t2 = 0 OR spread_home_line IS NULL OR ev < sw_ev OR e < sw_e OR zt < z_any OR delta < sw THEN t2
               WHEN t2 = 1 THEN 2
               WHEN ev >= v3 AND e >= d3 * 0.95::DOUBLE AND zt >= z_mh THEN 3 ELSE 2 END AS t3 FROM e10"""

VIEWS["e12"] = """
SELECT *, CASE WHEN t3 = 0 OR NOT (price < plim AND e < pe) THEN t3
               WHEN t3 = 1 AND sport <> 'MLB' THEN 0 ELSE greatest(t3 - 1, 1) END AS t4 FROM e11"""

VIEWS["e13"] = """
SELECT *, CASE WHEN (t4 = 3 AND kelly < kh) OR (t4 = 2 AND kelly < km) OR (t4 = 1 AND kelly < kl) THEN t4 - 1 ELSE t4 END AS t5
FROM e12"""

VIEWS["edges"] = """
SELECT * FROM (
  SELECT *, CASE WHEN t5 = 0 AND ev >= v1 * 0.95::DOUBLE AND e >= d1 * 0.95::DOUBLE AND zt >= z_any * 0.9::DOUBLE
                      AND delta > near * 0.6::DOUBLE THEN 1 ELSE t5 END AS t6 FROM e13) WHERE t6 > 0"""

VIEWS["tiered"] = """
SELECT game_id, side, edge_pct, model_prob, market_prob, z, ev, kelly,
       CASE t6 WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MED' ELSE 'LOW' END AS tier FROM edges"""

_ml = """'{"home":' || CAST(CAST(ml_home AS BIGINT) AS VARCHAR) || ',"away":"' || CAST(CAST(ml_away AS BIGINT) AS VARCHAR) || '"}'"""
_key = "CASE game_id % 3 WHEN 0 THEN 'price' WHEN 1 THEN 'odds' ELSE 'american' END"
_line = "CAST(coalesce(spread_home_line, 0.5::DOUBLE) AS VARCHAR)"
_sp = f"""'{{"home":{{"line":' || {_line} || ',"' || {_key} || '":-110}},"away":{{"line":' || {_line} || ',"' || {_key} || '":-105}}}}'"""
_tt = """CASE WHEN game_id % 2 = 0 THEN '{"line":' ELSE '{"over":' END || CAST(total_line AS VARCHAR) || '}'"""


def _encoded(single: str) -> str:
    double = f"""'"' || replace({single}, '"', chr(92) || '"') || '"'"""
    return (
        f"CASE game_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'not json' WHEN 2 THEN {single} ELSE {double} END"
    )


VIEWS["raw_games"] = f"""
SELECT *, CASE WHEN game_id % 7 = 0 THEN CAST(CAST(ml_home AS BIGINT) AS VARCHAR) END AS own_home,
       CASE WHEN game_id % 14 = 0 THEN CAST(CAST(ml_away AS BIGINT) AS VARCHAR) END AS own_away,
       {_encoded(_ml)} AS ml_json, {_encoded(_sp)} AS sp_json, {_encoded(_tt)} AS tt_json,
       game_id % 6 <> 5 AS has_map
FROM games"""

# Unreadable text becomes NULL; text inside text is unwrapped once.
VIEWS["raw_parsed"] = """
SELECT *, CASE WHEN json_valid(a) THEN a END AS ml, CASE WHEN json_valid(b) THEN b END AS sp,
       CASE WHEN json_valid(c) THEN c END AS tt
FROM (SELECT *, CASE WHEN ml_json LIKE '"%' THEN json_extract_string(ml_json, '$') ELSE ml_json END AS a,
             CASE WHEN sp_json LIKE '"%' THEN json_extract_string(sp_json, '$') ELSE sp_json END AS b,
             CASE WHEN tt_json LIKE '"%' THEN json_extract_string(tt_json, '$') ELSE tt_json END AS c
      FROM raw_games)"""

VIEWS["box"] = """
SELECT l_orderkey AS game_id, l_suppkey AS player_id, l_linenumber % 2 = 1 AS is_home,
       CAST(l_linenumber AS BIGINT) AS period, n AS minutes,
       2 * (n // 2 - n // 6) + 3 * (n // 6) + n // 5 AS points, n // 2 AS fg_made, n + l_linenumber AS fg_attempted,
       n // 6 AS three_made, n // 3 AS three_attempted, n // 5 AS ft_made, n // 4 + 1 AS ft_attempted,
       n % 9 AS assists, n % 4 AS steals, n % 3 AS blocks, CAST(l_linenumber AS BIGINT) AS oreb, n % 7 AS dreb,
       n % 5 AS tov, n + l_linenumber AS yards, CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END AS turnovers,
       n % 4 AS third_att, (n % 4) // 2 AS third_made, CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS red_zone_trips,
       CASE WHEN n % 10 = 0 THEN 1 ELSE 0 END AS red_zone_scores, n * 4 + 60 AS possession_sec
FROM (SELECT *, CAST(l_quantity AS BIGINT) AS n FROM lineitem)"""

VIEWS["injuries"] = """
SELECT event_id AS id, 'Player ' || user_id AS player,
       CASE WHEN event_id % 11 = 0 THEN '  ' WHEN event_id % 4 = 0 THEN ' ' || n_name || ' '
            WHEN event_id % 4 = 1 THEN lower(n_name) ELSE n_name END AS team_display_name,
       ['Out', 'Doubtful', 'Questionable', 'Probable', 'Day-to-Day'][event_id % 5 + 1] AS status,
       CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'knee' ELSE '' END AS injury_type,
       ['MLB', 'NFL', 'NBA'][(event_id // 5) % 3 + 1] AS league,
       CAST(DATE '1998-06-01' + CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS DATE) AS report_date,
       event_type AS detail
FROM events JOIN nation ON user_id % 25 = n_nationkey"""

VIEWS["quotes"] = """
SELECT user_id * 7 + event_id % 7 AS game_id, ts AS quote_ts, event_id AS quote_id,
       CAST(CASE WHEN event_id % 2 = 0 THEN -(110 + w) ELSE 95 + w END AS DOUBLE) AS ml_home,
       CAST(CASE WHEN event_id % 2 = 0 THEN 95 + w ELSE -(110 + w) END AS DOUBLE) AS ml_away
FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) % 190 AS w FROM events)"""

VIEWS["replayed"] = """
SELECT * REPLACE (TIMESTAMP '2024-01-01' + to_days(CAST(game_id % 30 AS INTEGER))
                  + to_hours(CAST(12 + game_id % 12 AS INTEGER)) AS start_ts) FROM games"""

VIEWS["probes"] = """
SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'fail' WHEN 'click' THEN 'fail'
       WHEN 'signup' THEN 'abort' ELSE 'ok' END AS outcome, event_id % 3 <> 0 AS soft_online FROM events"""

VIEWS["weather"] = """
SELECT n_name AS home_team, CAST(n_nationkey * 2 + 40 AS BIGINT) AS temperature,
       CASE WHEN n_nationkey % 6 <> 5 THEN CAST(n_nationkey % 13 AS BIGINT) END AS wind_speed,
       CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey * 15 AS BIGINT) END AS wind_angle,
       CASE WHEN n_nationkey % 5 <> 4 THEN 'City ' || n_nationkey END AS city,
       n_nationkey % 4 = 0 AS is_indoor
FROM nation WHERE n_nationkey % 9 <> 8"""

# One row per team and finished game, with its season.
VIEWS["team_games"] = """
SELECT game_id, sport, game_date, start_ts, team, opponent, is_home, pf, pa, pf - pa AS margin,
       CASE WHEN pf > pa THEN 'W' WHEN pf < pa THEN 'L' ELSE 'T' END AS result,
       CAST(CASE WHEN sport = 'MLB' OR month(game_date) > 10 OR (month(game_date) = 10 AND day(game_date) >= 22)
            THEN year(game_date) ELSE year(game_date) - 1 END AS INTEGER) AS season
FROM (SELECT game_id, sport, game_date, start_ts, home_team AS team, away_team AS opponent, TRUE AS is_home,
             home_final AS pf, away_final AS pa FROM games WHERE home_final IS NOT NULL
      UNION ALL
      SELECT game_id, sport, game_date, start_ts, away_team, home_team, FALSE, away_final, home_final
      FROM games WHERE home_final IS NOT NULL)"""


def check_sql(body: str, games: str = "games", **extra: str) -> str:
    """``body`` with every view it mentions in a WITH clause.

    ``games`` names the view the edge steps read from.
    """
    known = {**VIEWS, **extra}
    known["e1"] = VIEWS["e1"].replace("{games}", games)
    needed = []

    def visit(text):
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in known and word not in needed and re.search(rf"(FROM|JOIN|,)\s+{word}\b", text):
                visit(known[word])
                if word not in needed:
                    needed.append(word)

    visit(body)
    if not needed:
        return body
    views = ",\n".join(f"{name} AS ({known[name]})" for name in needed)
    return f"WITH {views}\n{body}"


def fixed(x: str, digits: int) -> str:
    """SQL text of ``x`` with fixed decimals, exact ties away from zero."""
    ties = {0: 2, 1: 4, 2: 8}[digits]  # a tie is an odd multiple of 1/ties
    nudge = 10.0 ** -(digits + 1)
    tie = f"({x}) * {ties} = floor(({x}) * {ties}) AND CAST(abs(({x}) * {ties}) AS BIGINT) % 2 = 1"
    return f"printf('%.{digits}f', CASE WHEN {tie} THEN ({x}) + sign({x}) * {nudge}::DOUBLE ELSE ({x}) END)"
