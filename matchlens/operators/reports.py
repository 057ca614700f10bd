"""Team, player and advanced tables: which exist, how they sort, how cells print.

Every kind sorts differently, and the differences are kept. Where the original
order of equal rows was arbitrary, the row's id decides.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlens.functions.numbers import DASH, format_cell
from matchlens.skew import positions
from matchlens.stages import observed

# Label and key of each report's columns.
HEADERS = {
    ("MLB", "teams"): {
        "Team": "team_name", "Win %": "wins_all_percentage", "Runs For": "runs_for_avg_all",
        "Runs Vs": "runs_against_avg_all", "Streak": "current_form",
    },
    ("NBA", "teams"): {
        "Team": "team_name", "Win %": "wins_all_percentage", "Off Pts": "points_for_avg_all",
        "Def Pts": "points_against_avg_all", "Streak": "current_form",
    },
    ("NFL", "teams"): {
        "Team": "teamName", "Win %": "winPct", "Yds / Drive": "avgYardsPerDrive",
        "Red Zone %": "avgRedZonePct", "TOP": "avgTimeOfPossession", "TOs / Game": "avgTurnoversPerGame",
    },
    ("NBA", "players"): {
        "Player": "player_name", "Team": "team_name", "Pts": "points", "Reb": "rebounds", "Ast": "assists",
        "3P%": "three_pct", "FT%": "ft_pct", "Min": "minutes", "GP": "games_played",
    },
    ("NBA", "advanced"): {
        "Team": "team_name", "Pace": "pace", "OffRtg": "off_rtg", "DefRtg": "def_rtg", "eFG%": "efg_pct",
        "TOV%": "tov_pct", "ORB%": "oreb_pct", "GP": "games_played",
    },
    ("MLB", "advanced"): {
        "Team": "team_name", "Win %": "win_pct", "Pyth W%": "pythag_win_pct", "Run Diff": "run_differential",
        "Run Diff Avg": "run_differential_avg", "Luck": "luck_factor", "GP": "gp",
    },
    ("NFL", "advanced"): {
        "Team": "team_name", "Pythag W %": "pythagorean_win_pct", "3rd %": "avg_third_down_pct",
        "SRS": "srs", "SoS": "sos",
    },
}

# Other names a report column may arrive under.
ALIASES = {"pythag_win_pct": "pythagorean_win_pct", "gp": "games_played"}


@dataclass(frozen=True)
class Sort:
    key: str | None
    direction: str = "desc"

    def toggled(self, key: str) -> "Sort":
        """A new key starts ascending; the same key flips."""
        if key == self.key:
            return Sort(key, "desc" if self.direction == "asc" else "asc")
        return Sort(key, "asc")


# What each report is sorted by when it opens.
DEFAULT_SORT = {
    ("MLB", "teams"): Sort("wins_all_percentage"),
    ("NBA", "teams"): Sort("wins_all_percentage"),
    ("NFL", "teams"): Sort("srs"),
    ("NBA", "players"): Sort(None),
    ("NBA", "advanced"): Sort("off_rtg"),
    ("MLB", "advanced"): Sort("run_differential"),
    ("NFL", "advanced"): Sort("srs"),
}

# After switching tabs, rather than leagues, the football table opens on another key.
NFL_TAB_SORT = Sort("winPct")


def headers(league: str, kind: str) -> dict[str, str]:
    """Columns of a report; leagues without that report raise ``KeyError``."""
    return HEADERS[league, kind]


def source_name(league: str, kind: str) -> str:
    """Dataset behind a report; football team tables read the summary."""
    headers(league, kind)
    if kind == "teams":
        return "nfl_summary" if league == "NFL" else "team_stats"
    return "player_stats" if kind == "players" else f"adv_{league.lower()}"


def season_allowed(league: str, season: Column, default: Column) -> Column:
    """Other leagues than baseball have no future seasons."""
    return F.lit(True) if league == "MLB" else season <= default


def search_players(df: DataFrame, term: str | None) -> DataFrame:
    """Case-insensitive contains on the player name; an empty term keeps all."""
    return df.filter(F.lower("player_name").contains(term.lower())) if term else df


def _kind(df: DataFrame, name: str) -> str:
    found = df.schema[name].dataType
    if isinstance(found, T.StringType):
        return "text"
    return "whole" if isinstance(found, T.IntegralType) else "number"


def _is_text(df: DataFrame, name: str) -> bool:
    return _kind(df, name) == "text"


def sort_order(df: DataFrame, kind: str, sort: Sort, name: str, row_id: str, league: str = "") -> list[Column]:
    """Sort columns of a report.

    * teams: NULL first in both directions, ties by team name in the same direction
    * players, advanced: NULL below every value
    * advanced text sorts by code unit, other text by the Unicode collation;
      only football breaks ties by name
    """
    up = sort.direction == "asc"
    binary = kind == "advanced" and league != "NFL"
    spelled = lambda c: F.col(c) if binary or not _is_text(df, c) else F.collate(F.col(c), "UNICODE")
    order = []
    if sort.key is not None:
        key = spelled(sort.key)
        low_first = key.asc_nulls_first()
        order.append(low_first if up else key.desc_nulls_first() if kind == "teams" else key.desc_nulls_last())
        if kind == "teams" or (kind == "advanced" and league == "NFL"):
            order.append(spelled(name).asc() if up else spelled(name).desc())
    return [*order, F.col(row_id).asc()]


def ranked(
    df: DataFrame, kind: str, sort: Sort, group: list[str], name="team_name", row_id="team_name", league=""
) -> DataFrame:
    """``position`` of each row in its report.

    A league-season has a few dozen teams, so team tables rank in a plain
    window; players can be many and are ranked by a global sort.
    """
    order = sort_order(df, kind, sort, name, row_id, league)
    if kind == "players":
        return positions(df, group, order)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("position", rank.cast("long"))


def printed(df: DataFrame, league: str, kind: str, carry: list[str]) -> DataFrame:
    """The report's columns as text, under their keys, next to ``carry``."""
    df = observed(df, "report_rows", "true")
    cells = []
    for key in headers(league, kind).values():
        names = [n for n in (key, ALIASES.get(key)) if n in df.columns]
        if not names:  # a column the rows do not have prints as missing
            cells.append(F.lit(DASH).alias(key))
            continue
        value = F.coalesce(*[F.col(n) for n in names])
        cells.append(format_cell(value, key, _kind(df, names[0])).alias(key))
    return df.select(*carry, *cells)


def empty_message(df: DataFrame, kind: str, term: str | None = None) -> DataFrame:
    """One row: whether the report is empty and what it then says."""
    # Fixed values.
    text = {
        "teams": "No team stats for this season.",
        "advanced": "No advanced stats for this season.",
        "players": f"No results for “{term}”" if term else "No data.",
    }[kind]
    empty = F.count("*") == 0
    return df.agg(empty.alias("is_empty"), F.when(empty, text).alias("message"))
