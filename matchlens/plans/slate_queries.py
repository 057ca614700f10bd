"""Reconciled games and the slate of each day."""

from pyspark.sql import functions as F

from matchlens.functions import odds, texts, times
from matchlens.operators import asof, edge, joins, reconcile, slate
from matchlens.plans.views import check_sql, fixed
from matchlens.sources import tables
from matchlens.stages import observed

QUERIES, CHECKS = {}, {}

AS_OF = "1998-06-15 18:00:00"  # UTC
AT = f"TIMESTAMP '{AS_OF}'"
OVER = "start_ts + INTERVAL 210 MINUTE"
LIVE = f"({AT} >= start_ts AND {AT} < {OVER})"
FINAL = "(status_state = 'Final' OR (home_final IS NOT NULL AND away_final IS NOT NULL))"
STALE = (
    f"(CAST(start_ts AS DATE) = CAST({AT} AS DATE) AND ({AT} >= {OVER} OR "
    "(data_type = 'historical' AND home_final IS NOT NULL AND away_final IS NOT NULL)))"
)
KEPT = f"(game_date < CAST({AT} AS DATE) OR {AT} < {OVER})"


def odds_reconcile(spark, sf_dir):
    df = reconcile.derive_odds(tables.raw_games(spark, sf_dir))
    return df.select(
        "game_id", F.col("ml_home_text").alias("ml_home"), F.col("ml_away_text").alias("ml_away"), "spread_line",
        "spread_home_price", "spread_away_price", "total_line",
        slate.has_market("ml_home_text", "ml_away_text", "spread_line").alias("has_market"),
    )


QUERIES["odds_reconcile"] = odds_reconcile
_PRICE = "coalesce(json_extract_string(sp, '$.{s}.price'), json_extract_string(sp, '$.{s}.odds'), json_extract_string(sp, '$.{s}.american'))"
ODDS_SQL = f"""
SELECT *, (ml_home IS NOT NULL AND ml_away IS NOT NULL) OR spread_line IS NOT NULL AS has_market FROM (
SELECT game_id,
  coalesce(own_home, json_extract_string(ml, '$.home'), CASE WHEN has_map THEN CAST(CAST(ml_home AS BIGINT) AS VARCHAR) END) AS ml_home,
  coalesce(own_away, json_extract_string(ml, '$.away'), CASE WHEN has_map THEN CAST(CAST(ml_away AS BIGINT) AS VARCHAR) END) AS ml_away,
  coalesce(CASE WHEN game_id % 3 = 1 THEN spread_home_line END, CAST(json_extract_string(sp, '$.home.line') AS DOUBLE)) AS spread_line,
  {_PRICE.format(s='home')} AS spread_home_price, {_PRICE.format(s='away')} AS spread_away_price,
  coalesce(CASE WHEN game_id % 4 = 1 THEN total_line END, CAST(json_extract_string(tt, '$.line') AS DOUBLE),
           CAST(json_extract_string(tt, '$.over') AS DOUBLE)) AS total_line
FROM raw_parsed)"""
CHECKS["odds_reconcile"] = check_sql(ODDS_SQL)


def pred_scores(spark, sf_dir):
    df = reconcile.pred_scores(tables.raw_games(spark, sf_dir))
    return df.select("game_id", "sport", "pred_home", "pred_away", slate.has_prediction().alias("has_prediction"))


QUERIES["pred_scores"] = pred_scores
PRED_SQL = f"""
SELECT game_id, sport, pred_home, pred_away,
       pred_home IS NOT NULL AND pred_away IS NOT NULL AND NOT fin AS has_prediction FROM (
SELECT game_id, sport,
  CASE WHEN game_id // 3 % 3 < 2 OR sport = 'NBA' THEN pred_home END AS pred_home,
  CASE WHEN game_id // 3 % 3 < 2 THEN pred_away END AS pred_away, {FINAL} AS fin FROM games)"""
CHECKS["pred_scores"] = check_sql(PRED_SQL)


def slate_edges(spark, sf_dir):
    """The whole way: raw rows, reconciled, gated, scored and labelled."""
    scored = edge.score_raw(tables.raw_games(spark, sf_dir))
    return scored.select(
        "game_id", "sport", "ml_home_text", "spread_line", "pred_home", "side", "tier",
        F.round("edge_pct", 6).alias("edge_pct"),
        F.coalesce(odds.edge_badge(F.col("tier"), F.col("side")), F.lit("No Edge")).alias("badge"),
    )


QUERIES["slate_edges"] = slate_edges
CHECKS["slate_edges"] = check_sql(
    """
SELECT o.game_id, p.sport, o.ml_home AS ml_home_text, o.spread_line, p.pred_home, t.side, t.tier,
       round(t.edge_pct, 6) AS edge_pct,
       CASE WHEN t.tier IS NULL THEN 'No Edge' ELSE 'Edge: ' || CASE tier WHEN 'HIGH' THEN 'High' WHEN 'MED' THEN 'Medium' ELSE 'Low' END
         || ' (' || CASE side WHEN 'HOME' THEN 'Home' ELSE 'Away' END || ')' END AS badge
FROM odds0 o JOIN pred0 p ON o.game_id = p.game_id LEFT JOIN tiered t ON t.game_id = o.game_id""",
    games="reconciled",
    odds0=ODDS_SQL,
    pred0=PRED_SQL,
    reconciled="""
SELECT o.game_id, p.sport, p.pred_home, p.pred_away, CAST(o.ml_home AS DOUBLE) AS ml_home,
       CAST(o.ml_away AS DOUBLE) AS ml_away, o.spread_line AS spread_home_line
FROM odds0 o JOIN pred0 p ON o.game_id = p.game_id
WHERE p.has_prediction AND o.ml_home IS NOT NULL AND o.ml_away IS NOT NULL""",
)


def slate_status(spark, sf_dir):
    return tables.games(spark, sf_dir).select(
        "game_id",
        slate.is_final().alias("is_final"),
        slate.is_in_progress(AS_OF).alias("in_progress"),
        slate.needs_suffix().alias("needs_suffix"),
        slate.has_prediction().alias("has_prediction"),
        slate.has_market().alias("has_market"),
        slate.card_state(AS_OF).alias("card_state"),
        slate.slate_rank(AS_OF).alias("slate_rank"),
    )


QUERIES["slate_status"] = slate_status
CHECKS["slate_status"] = check_sql(f"""
SELECT game_id, {FINAL} AS is_final, {LIVE} AS in_progress, status_state = 'In Progress' AS needs_suffix,
       NOT {FINAL} AS has_prediction, TRUE AS has_market,
       CASE WHEN {FINAL} THEN 'final' WHEN {LIVE} THEN 'in_progress' ELSE 'prediction' END AS card_state,
       CAST(CASE WHEN {LIVE} THEN 1 WHEN {FINAL} THEN 2 ELSE 0 END AS INTEGER) AS slate_rank FROM games""")


def slate_order(spark, sf_dir):
    games = tables.games(spark, sf_dir).select(
        "game_id", "sport", "game_date", "start_ts", "status_state", "data_type", "home_final", "away_final"
    )
    ordered = slate.slate_order(games, AS_OF)
    return ordered.select("sport", "game_date", "position", "game_id", "slate_rank")


QUERIES["slate_order"] = slate_order
CHECKS["slate_order"] = check_sql(f"""
SELECT sport, game_date, row_number() OVER (PARTITION BY sport, game_date ORDER BY slate_rank, start_ts, game_id) AS position,
       game_id, slate_rank
FROM (SELECT *, CAST(CASE WHEN {LIVE} THEN 1 WHEN {FINAL} THEN 2 ELSE 0 END AS INTEGER) AS slate_rank FROM games WHERE NOT {STALE})""")


def first_upcoming(spark, sf_dir):
    """Games arrive in an order that is not the order of their ids."""
    arrived = tables.games(spark, sf_dir).withColumn("position", F.col("game_id") * 31 % 1009)
    return slate.first_upcoming(arrived, AS_OF, position="position")


QUERIES["first_upcoming"] = first_upcoming
CHECKS["first_upcoming"] = check_sql(f"""
SELECT sport, game_date, arg_min(game_id, struct_pack(a := game_id * 31 % 1009, b := game_id)) AS first_game_id FROM games
WHERE NOT {STALE} AND NOT {LIVE} AND NOT {FINAL} GROUP BY sport, game_date""")


def stale_filter(spark, sf_dir):
    return slate.visible(tables.games(spark, sf_dir), AS_OF).select("game_id", "sport", "game_date")


QUERIES["stale_filter"] = stale_filter
CHECKS["stale_filter"] = check_sql(f"SELECT game_id, sport, game_date FROM games WHERE NOT {STALE}")


def unexpired(spark, sf_dir):
    return slate.unexpired(tables.games(spark, sf_dir), AS_OF).select("game_id", "sport", "game_date")


QUERIES["unexpired"] = unexpired
CHECKS["unexpired"] = check_sql(f"SELECT game_id, sport, game_date FROM games WHERE {KEPT}")


def et_time(spark, sf_dir):
    df = reconcile.with_game_time_et(tables.games(spark, sf_dir), "scheduled_time", "start_ts")
    shown = times.format_time(F.col("start_ts"), F.col("game_date").cast("string"))
    suffix = F.when(slate.needs_suffix(), F.concat(F.lit(" ("), F.col("status_state"), F.lit(")"))).otherwise("")
    return df.select(
        "game_id",
        "game_time_et",
        times.eastern_date(F.col("start_ts")).alias("eastern_date"),
        F.concat(shown, suffix).alias("time_line"),
        times.display_date(F.col("game_date")).alias("display_date"),
    )


QUERIES["et_time"] = et_time
_ET = "((start_ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"
CHECKS["et_time"] = check_sql(f"""
SELECT game_id, strftime({_ET}, '%-I:%M %p') AS game_time_et, CAST({_ET} AS DATE) AS eastern_date,
       strftime(start_ts, '%-I:%M %p') || CASE WHEN status_state = 'In Progress' THEN ' (In Progress)' ELSE '' END AS time_line,
       strftime(game_date, '%B %-d') AS display_date
FROM games""")


def default_season(spark, sf_dir):
    season = times.default_season(F.col("sport"), F.col("game_date"))
    return tables.games(spark, sf_dir).select(
        "game_id", "sport", season.alias("season"), times.season_label(F.col("sport"), season).alias("label")
    )


QUERIES["default_season"] = default_season
_SEASON = (
    "CAST(CASE WHEN sport = 'MLB' OR strftime(game_date, '%m%d') >= '1022' THEN year(game_date) "
    "ELSE year(game_date) - 1 END AS INTEGER)"
)
_LABEL = "CASE WHEN sport = 'NBA' THEN season || '-' || right(CAST(season + 1 AS VARCHAR), 2) ELSE CAST(season AS VARCHAR) END"
CHECKS["default_season"] = check_sql(f"""
SELECT game_id, sport, season, {_LABEL} AS label FROM (SELECT game_id, sport, {_SEASON} AS season FROM games)""")


def season_options(spark, sf_dir):
    """The five seasons offered on every day that has games."""
    days = tables.games(spark, sf_dir).select("sport", "game_date").distinct()
    latest = times.default_season(F.col("sport"), F.col("game_date"))
    options = days.select("sport", "game_date", F.explode(F.sequence(latest, latest - 4, F.lit(-1))).alias("season"))
    return options.withColumn("label", times.season_label(F.col("sport"), F.col("season")))


QUERIES["season_options"] = season_options
CHECKS["season_options"] = check_sql(f"""
SELECT sport, game_date, season, {_LABEL} AS label FROM (
  SELECT sport, game_date, CAST({_SEASON} - b AS INTEGER) AS season
  FROM (SELECT DISTINCT sport, game_date FROM games), (VALUES (0), (1), (2), (3), (4)) s(b))""")


def slate_flags(spark, sf_dir):
    return slate.slate_flags(tables.games(spark, sf_dir), AS_OF)


QUERIES["slate_flags"] = slate_flags
_FLAGS = f"""
SELECT sport, game_date, count(*) AS raw_count, count(*) FILTER ({KEPT}) AS kept_count,
       count(*) FILTER (NOT {STALE}) AS visible_count FROM games GROUP BY sport, game_date"""
_FLAGGED = f"""
SELECT sport, game_date, raw_count, kept_count, visible_count, FALSE AS none_scheduled,
       kept_count = 0 AS all_filtered, game_date < CAST({AT} AS DATE) AS is_past FROM flags0"""
CHECKS["slate_flags"] = check_sql("SELECT * FROM flags", flags0=_FLAGS, flags=_FLAGGED)


def slate_state(spark, sf_dir):
    state = slate.slate_state(slate.slate_flags(tables.games(spark, sf_dir), AS_OF))
    return state.select("sport", "game_date", "state", "message")


QUERIES["slate_state"] = slate_state
CHECKS["slate_state"] = check_sql("""
SELECT sport, game_date, CASE WHEN visible_count = 0 THEN 'concluded' ELSE 'list' END AS state,
       CASE WHEN visible_count = 0 THEN 'All ' || lbl || ' have concluded.' ELSE lbl END AS message
FROM (SELECT *, sport || ' games for ' || strftime(game_date, '%B %-d') AS lbl FROM flags0)""", flags0=_FLAGS)  # fmt: skip


def slate_calendar(spark, sf_dir):
    """Slates of every league on all days with games and on as many later days without."""
    games = tables.games(spark, sf_dir)
    days = games.select(F.explode(F.array("game_date", F.date_add("game_date", 3000))).alias("game_date")).distinct()
    asked = days.withColumn("sport", F.explode(F.array(*map(F.lit, ("MLB", "NFL", "NBA")))))
    state = slate.slate_state(slate.slate_flags(games, AS_OF, asked=asked))
    return state.select("sport", "game_date", "raw_count", "none_scheduled", "all_filtered", "state", "message")


QUERIES["slate_calendar"] = slate_calendar
CHECKS["slate_calendar"] = check_sql("""
SELECT sport, game_date, n AS raw_count, n = 0 AS none_scheduled, n > 0 AND kept_count = 0 AS all_filtered,
       CASE WHEN n = 0 THEN 'fallback' WHEN visible_count = 0 THEN 'concluded' ELSE 'list' END AS state,
       CASE WHEN n = 0 THEN 'No ' || lbl WHEN visible_count = 0 THEN 'All ' || lbl || ' have concluded.' ELSE lbl END AS message
FROM (SELECT s.sport, d.game_date, coalesce(f.raw_count, 0) AS n, kept_count, visible_count,
             s.sport || ' games for ' || strftime(d.game_date, '%B %-d') AS lbl
      FROM (SELECT DISTINCT game_date FROM games UNION SELECT DISTINCT game_date + 3000 FROM games) d
      CROSS JOIN (VALUES ('MLB'), ('NFL'), ('NBA')) s(sport)
      LEFT JOIN flags0 f ON f.sport = s.sport AND f.game_date = d.game_date)""", flags0=_FLAGS)  # fmt: skip


def next_game_date(spark, sf_dir):
    return slate.next_game_date(tables.games(spark, sf_dir))


QUERIES["next_game_date"] = next_game_date
CHECKS["next_game_date"] = check_sql("""
SELECT a.sport, a.game_date, min(b.game_date) AS next_date
FROM (SELECT DISTINCT sport, game_date FROM games) a
LEFT JOIN (SELECT DISTINCT sport, game_date FROM games) b
  ON a.sport = b.sport AND b.game_date > a.game_date AND b.game_date <= a.game_date + 7
GROUP BY a.sport, a.game_date""")


def game_header(spark, sf_dir):
    """Some games lack their start, their total or one side of the prediction."""
    k = F.col("game_id")
    g = tables.games(spark, sf_dir).withColumns(
        {
            "start_ts": F.when(k % 13 != 0, F.col("start_ts")),
            "total_line": F.when(k % 11 != 0, F.col("total_line")),
            "pred_away": F.when(k % 19 != 0, F.col("pred_away")),
        }
    )
    return slate.headers(observed(g, "headers", "home_final IS NOT NULL"))


QUERIES["game_header"] = game_header
_NUM = "CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
CHECKS["game_header"] = check_sql(f"""
SELECT game_id, away_team || ' @ ' || home_team AS title,
       CAST(game_date AS VARCHAR) || ' / '
         || CASE WHEN game_id % 13 = 0 THEN CAST(game_date AS VARCHAR) ELSE strftime(start_ts, '%-I:%M %p') END AS at,
       CASE WHEN spread_home_line IS NOT NULL OR game_id % 11 <> 0 THEN
         'Spread ' || coalesce({_NUM.format(x='spread_home_line')}, 'N/A') || ', Total '
         || CASE WHEN game_id % 11 = 0 THEN 'N/A' ELSE {_NUM.format(x='total_line')} END END AS lines,
       CASE WHEN home_final IS NOT NULL THEN away_final || ' – ' || home_final WHEN game_id % 19 = 0 THEN '—'
            ELSE {fixed('pred_away', 1)} || ' – ' || {fixed('pred_home', 1)} END AS score
FROM games""")


def odds_line(spark, sf_dir):
    return tables.games(spark, sf_dir).select(
        "game_id",
        odds.odds_line(
            F.col("sport"), F.col("ml_home"), F.col("ml_away"), F.col("spread_home_line"), F.col("total_line")
        ).alias("line"),
    )


QUERIES["odds_line"] = odds_line
_ODD = (
    "CASE WHEN {x} IS NULL OR {x} = 0 THEN 'N/A' ELSE CASE WHEN {x} > 0 THEN '+' ELSE '' END || ("
    + _NUM
    + ") END"
)
CHECKS["odds_line"] = check_sql(f"""
SELECT game_id, 'ML: ' || {_ODD.format(x='ml_home')} || ' / ' || {_ODD.format(x='ml_away')}
   || CASE WHEN sport = 'MLB' THEN '' ELSE ' | ' || {_ODD.format(x='spread_home_line')} END
   || ' | O/U: ' || {_NUM.format(x='total_line')} AS line FROM games""")


def league_union(spark, sf_dir):
    """The three leagues' own row types in one slate."""
    raw = reconcile.pred_scores(tables.raw_games(spark, sf_dir))
    own = {"NBA": "predHome", "NFL": "predicted_home_score", "MLB": "predicted_home_runs"}
    parts = [
        raw.filter(F.col("sport") == s).select("game_id", "sport", "pred_home", F.col(c).cast("double").alias(c))
        for s, c in own.items()
    ]
    return reconcile.league_union(*parts)


QUERIES["league_union"] = league_union
CHECKS["league_union"] = check_sql("""
SELECT game_id, sport, CASE WHEN game_id // 3 % 3 < 2 OR sport = 'NBA' THEN pred_home END AS pred_home,
       CASE WHEN sport = 'NBA' AND game_id // 3 % 3 = 1 THEN pred_home END AS "predHome",
       CASE WHEN sport = 'NFL' AND game_id // 3 % 3 = 0 THEN pred_home END AS predicted_home_score,
       CASE WHEN sport = 'MLB' AND game_id // 3 % 3 = 0 THEN pred_home END AS predicted_home_runs FROM games""")


def weather_labels(spark, sf_dir):
    df = joins.with_weather(tables.games(spark, sf_dir), tables.weather(spark, sf_dir))
    reading = [F.col("temperature").cast("string"), F.coalesce(F.col("wind_speed").cast("string"), F.lit(""))]
    badge = texts.weather_label(F.col("indoor"), *reading).alias("badge")
    return joins.weather_detail(df.withColumn("badge", badge)).select(
        "game_id", "indoor", "badge", "city", "stadium", "temperature", "feels_like", "wind", "wind_angle"
    )


QUERIES["weather_labels"] = weather_labels
CHECKS["weather_labels"] = check_sql("""
SELECT game_id, indoor, CASE WHEN indoor THEN 'Indoor' WHEN temperature IS NULL THEN 'N/A'
            ELSE temperature || '°F / ' || coalesce(CAST(wind_speed AS VARCHAR), '') || 'mph' END AS badge,
       coalesce(city, '—') AS city, 'Indoor Venue' AS stadium, coalesce(CAST(temperature AS VARCHAR), '–') || '°F' AS temperature,
       '–°F' AS feels_like,
       coalesce(wind_speed, 0) || ' mph' AS wind, coalesce(wind_angle, 0) AS wind_angle
FROM (SELECT g.game_id, g.sport = 'NBA' OR coalesce(w.is_indoor, FALSE) AS indoor, w.temperature, w.wind_speed, w.wind_angle, w.city
      FROM games g LEFT JOIN weather w ON g.home_team = w.home_team AND g.sport <> 'NBA')""")


def pitcher_lines(spark, sf_dir):
    """The pitcher of each game; some hands are unknown and some names blank."""
    g = tables.games(spark, sf_dir)
    k = F.col("game_id")
    name = F.when(k % 4 == 3, " ").otherwise(F.concat(F.lit("Pitcher "), (k % 97).cast("string")))
    hand = F.when(k % 3 == 0, F.when(k % 2 == 0, "L").otherwise("R"))
    hand = F.when(k % 5 != 0, hand)
    return g.select("game_id", texts.pitcher_line(F.col("sport"), name, hand).alias("pitcher"))


QUERIES["pitcher_lines"] = pitcher_lines
CHECKS["pitcher_lines"] = check_sql("""
SELECT game_id, CASE WHEN sport = 'MLB' AND game_id % 4 <> 3 THEN 'Pitcher ' || game_id % 97 ||
   CASE WHEN game_id % 5 <> 0 THEN CASE WHEN game_id % 2 = 0 THEN ' (L)' ELSE ' (R)' END ELSE '' END END AS pitcher FROM games""")


def odds_asof(spark, sf_dir):
    games = tables.replayed_starts(tables.games(spark, sf_dir))
    last = joins.quotes_before_start(tables.quotes(spark, sf_dir), games)
    return last.select("game_id", "quote_id", "ml_home", "ml_away", "quotes_seen")


QUERIES["odds_asof"] = odds_asof
CHECKS["odds_asof"] = check_sql("""
SELECT g.game_id, quote_id, l.ml_home, l.ml_away, quotes_seen FROM games g LEFT JOIN (
  SELECT q.*, row_number() OVER (PARTITION BY q.game_id ORDER BY quote_ts DESC, quote_id DESC) AS rn,
         count(*) OVER (PARTITION BY q.game_id) AS quotes_seen
  FROM quotes q JOIN replayed r ON q.game_id = r.game_id WHERE quote_ts < r.start_ts) l
ON g.game_id = l.game_id AND l.rn = 1""")


def odds_asof_merge(spark, sf_dir):
    """The same by one sort of quotes and starts together."""
    games = tables.replayed_starts(tables.games(spark, sf_dir)).select("game_id", "start_ts")
    last = asof.last_before(tables.quotes(spark, sf_dir), games)
    return last.select("game_id", "quote_id", "ml_home", "ml_away", "quotes_seen")


QUERIES["odds_asof_merge"] = odds_asof_merge
CHECKS["odds_asof_merge"] = CHECKS["odds_asof"]


def features_explode(spark, sf_dir):
    return reconcile.feature_rows(tables.part_features(spark, sf_dir))


QUERIES["features_explode"] = features_explode
CHECKS["features_explode"] = """
SELECT p_partkey AS game_id, 'size' AS key, CAST(p_size AS DOUBLE) AS val FROM part
UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part"""
