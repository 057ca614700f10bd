"""Row types of the league datasets. Unlisted keys are kept in ``extra`` maps."""

# Odds and predictions come under several keys, predictions as numbers or text.
GAMES = """
game_id STRING, sport STRING, game_date DATE, scheduled_time STRING, scheduled_time_utc STRING,
gameTimeUTC STRING, game_time_utc STRING, tipoff STRING,
homeTeam STRING, awayTeam STRING, home_team STRING, away_team STRING, homeTeamName STRING, awayTeamName STRING,
statusState STRING, dataType STRING,
homePitcher STRING, awayPitcher STRING, homePitcherHand STRING, awayPitcherHand STRING,
moneylineHome STRING, moneylineAway STRING, moneyline MAP<STRING, STRING>,
moneyline_clean STRING, moneylineClean STRING, spread_clean STRING, spreadClean STRING,
total_clean STRING, totalClean STRING, spreadLine DOUBLE, totalLine DOUBLE, spread DOUBLE, total DOUBLE,
predictionHome STRING, predictionAway STRING, predHome STRING, predAway STRING,
predicted_home_runs STRING, predicted_away_runs STRING, predictedHomeRuns STRING, predictedAwayRuns STRING,
predicted_home_score STRING, predicted_away_score STRING, predictedHomeScore STRING, predictedAwayScore STRING,
home_final_score DOUBLE, away_final_score DOUBLE,
venueLocation STRUCT<latitude: DOUBLE, longitude: DOUBLE>, extra MAP<STRING, STRING>"""

TEAM_STATS = """
team_id STRING, team_name STRING, sport STRING, season INT, wins_all_percentage DOUBLE, current_form STRING,
points_for_avg_all DOUBLE, points_against_avg_all DOUBLE, runs_for_avg_all DOUBLE, runs_against_avg_all DOUBLE,
extra MAP<STRING, STRING>"""

PLAYER_STATS = """
player_id STRING, player_name STRING, team_name STRING, sport STRING, season INT, games_played DOUBLE,
minutes DOUBLE, points DOUBLE, rebounds DOUBLE, assists DOUBLE, steals DOUBLE, blocks DOUBLE,
fg_made DOUBLE, fg_attempted DOUBLE, three_made DOUBLE, three_attempted DOUBLE, ft_made DOUBLE, ft_attempted DOUBLE,
three_pct DOUBLE, ft_pct DOUBLE, extra MAP<STRING, STRING>"""

ADV_MLB = """
team_id STRING, team_name STRING, season INT, win_pct DOUBLE, pythagorean_win_pct DOUBLE, run_differential DOUBLE,
run_differential_avg DOUBLE, luck_factor DOUBLE, games_played DOUBLE, extra MAP<STRING, STRING>"""

ADV_NBA = """
team_name STRING, season INT, pace DOUBLE, off_rtg DOUBLE, def_rtg DOUBLE, efg_pct DOUBLE, tov_pct DOUBLE,
oreb_pct DOUBLE, games_played DOUBLE, extra MAP<STRING, STRING>"""

ADV_NFL = """
team_name STRING, season INT, games_played DOUBLE, srs DOUBLE, sos DOUBLE, point_differential DOUBLE,
turnover_differential DOUBLE, pythagorean_wins DOUBLE, luck DOUBLE, extra MAP<STRING, STRING>"""

NFL_SUMMARY = """
team_id STRING, team_name STRING, season STRING, srs_lite DOUBLE, sos DOUBLE, sos_rank INT, win_pct DOUBLE,
pythagorean_win_pct DOUBLE, avg_third_down_pct DOUBLE, avg_red_zone_pct DOUBLE, avg_yards_per_drive DOUBLE,
avg_turnovers_per_game DOUBLE, avg_time_of_possession STRING"""

INJURIES = """
id STRING, player STRING, team_display_name STRING, status STRING, detail STRING, updated STRING,
injury_type STRING, league STRING, report_date DATE"""

WEATHER = """
sport STRING, home_team STRING, temperature DOUBLE, feels_like DOUBLE, humidity DOUBLE, windSpeed DOUBLE,
windDirection STRING, description STRING, icon STRING, city STRING, stadium STRING, ballparkWindText STRING,
ballparkWindAngle DOUBLE, isIndoor BOOLEAN"""

SNAPSHOTS = """
game_id STRING, sport STRING, game_date DATE, message STRING,
headline_stats ARRAY<STRUCT<label: STRING, value: STRING>>,
bar_chart_data ARRAY<STRUCT<category: STRING, Home: DOUBLE, Away: DOUBLE>>,
radar_chart_data ARRAY<STRUCT<metric: STRING, home_raw: DOUBLE, away_raw: DOUBLE, home_idx: DOUBLE, away_idx: DOUBLE>>,
key_metrics_data ARRAY<STRUCT<category: STRING, Home: DOUBLE, Away: DOUBLE>>,
pie_chart_data ARRAY<STRUCT<category: STRING, value: DOUBLE, color: STRING,
  title: STRING, data: ARRAY<STRUCT<category: STRING, value: DOUBLE, color: STRING>>>>,
is_historical BOOLEAN, stage STRING"""

FEATURES = "game_id STRING, features MAP<STRING, DOUBLE>, data STRUCT<features: MAP<STRING, DOUBLE>>"

QUOTES = "game_id STRING, quote_id LONG, quote_ts TIMESTAMP_NTZ, ml_home DOUBLE, ml_away DOUBLE"

TABLES = {
    "schedule": GAMES, "historical": GAMES, "live": GAMES, "team_stats": TEAM_STATS,
    "player_stats": PLAYER_STATS, "adv_mlb": ADV_MLB, "adv_nba": ADV_NBA, "adv_nfl": ADV_NFL,
    "nfl_summary": NFL_SUMMARY, "injuries": INJURIES, "weather": WEATHER, "snapshots": SNAPSHOTS,
    "features": FEATURES, "odds": QUOTES,
}
