"""Injury reports."""

from pyspark.sql import functions as F

from matchlens.functions.texts import injury_line
from matchlens.functions.times import display_date
from matchlens.operators import injuries as ops
from matchlens.operators import slate
from matchlens.plans.slate_queries import _FLAGGED, _FLAGS, AS_OF
from matchlens.plans.views import check_sql
from matchlens.sources import tables

QUERIES, CHECKS = {}, {}

PLAYING = """
SELECT i.*, trim(team_display_name) AS team FROM injuries i WHERE trim(team_display_name) <> '' AND EXISTS (
  SELECT 1 FROM games g WHERE g.sport = i.league AND g.game_date = i.report_date
   AND lower(trim(i.team_display_name)) IN (lower(trim(g.home_team)), lower(trim(g.away_team))))"""
BY_TEAM = """
SELECT league, report_date, team, count(*) AS injuries, count(*) FILTER (status = 'Out') AS "out"
FROM playing GROUP BY league, report_date, team"""
VIEWS = {"playing": PLAYING, "by_team": BY_TEAM, "flags0": _FLAGS, "flags": _FLAGGED}


def inputs(spark, sf_dir):
    return tables.injuries(spark, sf_dir), tables.games(spark, sf_dir)


def injuries_semi(spark, sf_dir):
    return ops.injuries_of_playing(*inputs(spark, sf_dir)).select("id", "league", "report_date", "team", "status")


QUERIES["injuries_semi"] = injuries_semi
CHECKS["injuries_semi"] = check_sql("SELECT id, league, report_date, team, status FROM playing", **VIEWS)


def injuries_by_team(spark, sf_dir):
    return ops.injuries_by_team(*inputs(spark, sf_dir))


QUERIES["injuries_by_team"] = injuries_by_team
CHECKS["injuries_by_team"] = check_sql("SELECT * FROM by_team", **VIEWS)


def injury_team_order(spark, sf_dir):
    return ops.listed_teams(ops.injuries_by_team(*inputs(spark, sf_dir)))


QUERIES["injury_team_order"] = injury_team_order
CHECKS["injury_team_order"] = check_sql("""
SELECT *, CAST(row_number() OVER (PARTITION BY league, report_date ORDER BY team) AS INTEGER) AS position FROM by_team""", **VIEWS)


def injuries_by_game(spark, sf_dir):
    hurt, games = inputs(spark, sf_dir)
    # Texts are made once for each report, not for each of its games.
    told = hurt.select(
        "league", "report_date", "team_display_name", "id", "status",
        injury_line(F.col("player"), F.col("injury_type"), F.col("team_display_name")).alias("line"),
        display_date(F.col("report_date")).alias("reported"),
    )
    return ops.injuries_of_games(told, games).select("game_id", "id", "team_display_name", "status", "line", "reported")


QUERIES["injuries_by_game"] = injuries_by_game
CHECKS["injuries_by_game"] = check_sql("""
SELECT game_id, id, team_display_name, status,
       player || CASE WHEN injury_type <> '' THEN ' (' || injury_type || ')' ELSE '' END || ' — ' || team_display_name AS line,
       strftime(report_date, '%B %-d') AS reported
FROM games g JOIN injuries i ON g.sport = i.league AND g.game_date = i.report_date
 AND i.team_display_name IN (g.home_team, g.away_team)""")


def injury_panel(spark, sf_dir):
    hurt, games = inputs(spark, sf_dir)
    state = ops.report_state(slate.slate_flags(games, AS_OF), ops.injuries_by_team(hurt, games))
    return state.select("sport", "game_date", "teams_hurt", "injury_state")


QUERIES["injury_panel"] = injury_panel
CHECKS["injury_panel"] = check_sql("""
SELECT f.sport, f.game_date, coalesce(n, 0) AS teams_hurt,
       CASE WHEN is_past THEN 'completed' WHEN all_filtered THEN 'no_remaining_games'
            WHEN coalesce(n, 0) = 0 THEN 'none_reported' ELSE 'list' END AS injury_state
FROM flags f LEFT JOIN (SELECT league, report_date, count(*) AS n FROM by_team GROUP BY league, report_date) t
  ON f.sport = t.league AND f.game_date = t.report_date""", **VIEWS)  # fmt: skip
