"""Status, filtering and ordering of a day's games.

Two staleness rules and two precedence orders exist side by side on purpose:
``is_stale`` looks only at today's games, ``is_unexpired`` at any; the slate
puts live games before finished ones, the card shows finished first.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions.numbers import number_text
from matchlens.functions.odds import predicted_score
from matchlens.functions.times import clock, display_date, game_length, instant, local_date
from matchlens.skew import positions

# Parts of a status that mean the game is over, or not worth a suffix.
FINAL_WORDS = ("final", "ended", "ft", "post-game", "postgame", "completed")
PLAIN_WORDS = ("final", "sched", "pre")

PREVIEW_DAYS = 7


def _mentions(status: Column, words) -> Column:
    return F.coalesce(F.lower(status).rlike("|".join(words)), F.lit(False))


def has_finals() -> Column:
    return F.col("home_final").isNotNull() & F.col("away_final").isNotNull()


def is_final() -> Column:
    return _mentions(F.col("status_state"), FINAL_WORDS) | has_finals()


def start_or_date() -> Column:
    """Start time, or midnight UTC of the game date."""
    return F.coalesce("start_ts", F.col("game_date").cast("timestamp_ntz"))


def is_in_progress(as_of) -> Column:
    start, now = start_or_date(), instant(as_of)
    live = (now >= start) & (now < start + game_length())
    return F.coalesce(live, F.lit(False))


def is_stale(as_of, tz: str = "UTC") -> Column:
    start, now = F.col("start_ts"), instant(as_of)
    over = now >= start + game_length()
    recorded = (F.col("data_type") == "historical") & has_finals()
    today = local_date(start, tz) == local_date(now, tz)
    return F.coalesce(today & (over | recorded), F.lit(False))


def is_past(as_of, tz: str = "UTC") -> Column:
    return F.col("game_date") < local_date(instant(as_of), tz)


def is_unexpired(as_of, tz: str = "UTC") -> Column:
    running = instant(as_of) < F.col("start_ts") + game_length()
    return is_past(as_of, tz) | F.coalesce(running, F.lit(True))


def needs_suffix() -> Column:
    status = F.col("status_state")
    return status.isNotNull() & ~_mentions(status, PLAIN_WORDS)


def has_prediction() -> Column:
    return F.col("pred_home").isNotNull() & F.col("pred_away").isNotNull() & ~is_final()


def has_market(ml_home="ml_home", ml_away="ml_away", spread="spread_home_line") -> Column:
    both = F.col(ml_home).isNotNull() & F.col(ml_away).isNotNull()
    return both | F.col(spread).isNotNull()


def visible(games: DataFrame, as_of, tz: str = "UTC") -> DataFrame:
    return games.filter(~is_stale(as_of, tz))


def unexpired(games: DataFrame, as_of, tz: str = "UTC") -> DataFrame:
    return games.filter(is_unexpired(as_of, tz))


def card_state(as_of) -> Column:
    return (
        F.when(is_final(), "final")
        .when(is_in_progress(as_of), "in_progress")
        .when(has_prediction(), "prediction")
        .otherwise("actions")
    )


def slate_rank(as_of) -> Column:
    """0 upcoming, 1 live, 2 finished or without any time."""
    live = is_in_progress(as_of)
    return (
        F.when(start_or_date().isNull(), 2).when(live, 1).when(is_final(), 2).otherwise(0)
    )


def slate_order(games: DataFrame, as_of, tz: str = "UTC") -> DataFrame:
    """Visible games with their place in the slate of their sport and day."""
    ranked = visible(games, as_of, tz).withColumns(
        {"slate_rank": slate_rank(as_of), "_start": start_or_date()}
    )
    order = ["slate_rank", F.asc_nulls_last("_start"), "game_id"]
    return positions(ranked, ["sport", "game_date"], order).drop("_start")


def first_upcoming(games: DataFrame, as_of, tz: str = "UTC", position: str = "game_id") -> DataFrame:
    """First game by input order (not slate order) that is neither live nor over.

    ``position`` is the column that holds the input order; the id decides ties.
    """
    coming = start_or_date().isNotNull() & ~is_in_progress(as_of) & ~is_final()
    return (
        visible(games, as_of, tz).filter(coming)
        .groupBy("sport", "game_date").agg(F.min_by("game_id", F.struct(position, "game_id")).alias("first_game_id"))
    )


def slate_flags(games: DataFrame, as_of, tz: str = "UTC", asked: DataFrame | None = None) -> DataFrame:
    """Counts and messages per slate.

    ``asked`` lists the slates (``sport``, ``game_date``) to answer for, also
    those without games; without it every slate that has games is listed.
    """
    keys = ["sport", "game_date"]
    counts = games.groupBy(*keys).agg(
        F.count("*").alias("raw_count"),
        F.count_if(is_unexpired(as_of, tz)).alias("kept_count"),
        F.count_if(~is_stale(as_of, tz)).alias("visible_count"),
    )
    if asked is not None:
        counts = asked.select(*keys).distinct().join(counts, keys, "left")
        counts = counts.fillna(0, ["raw_count", "kept_count", "visible_count"])
    return counts.withColumns(
        {
            "none_scheduled": F.col("raw_count") == 0,
            "all_filtered": (F.col("raw_count") > 0) & (F.col("kept_count") == 0),
            "is_past": is_past(as_of, tz),
        }
    )


def slate_state(flags: DataFrame) -> DataFrame:
    label = F.concat(F.col("sport"), F.lit(" games for "), display_date(F.col("game_date")))
    return flags.withColumns(
        {
            "state": F.when(F.col("raw_count") == 0, "fallback")
            .when(F.col("visible_count") == 0, "concluded")
            .otherwise("list"),
            "message": F.when(F.col("raw_count") == 0, F.concat(F.lit("No "), label))
            .when(F.col("visible_count") == 0, F.concat(F.lit("All "), label, F.lit(" have concluded.")))
            .otherwise(label),
        }
    )


def next_game_date(games: DataFrame) -> DataFrame:
    """For each sport's day with games, the next such day if it is within a week.

    The window runs over distinct days, so its groups are bounded by the calendar.
    """
    days = games.select("sport", "game_date").distinct()
    following = F.lead("game_date").over(Window.partitionBy("sport").orderBy("game_date"))
    near = F.date_diff(F.col("next_date"), F.col("game_date")) <= PREVIEW_DAYS
    return days.withColumn("next_date", following).withColumn(
        "next_date", F.when(near, F.col("next_date"))
    )


def next_date_after(games: DataFrame, sport: str, day) -> DataFrame:
    """The same search for one day: NULL if the next week is empty."""
    start = F.lit(day).cast("date")
    within = F.col("game_date").between(F.date_add(start, 1), F.date_add(start, PREVIEW_DAYS))
    return games.filter((F.col("sport") == sport) & within).agg(F.min("game_date").alias("next_date"))


def game_by_id(games: DataFrame, game_id) -> DataFrame:
    return games.filter(F.col("game_id") == game_id).limit(1)


def headers(games: DataFrame, tz: str = "UTC") -> DataFrame:
    """Title, time, market and score at the head of each game's page.

    The date stands in for an unknown start. The market is NULL if neither
    spread nor total is known. A prediction is shown if it has both sides.
    """
    known = lambda *names: [F.col(c).isNotNull() for c in names]
    shown = lambda c: F.coalesce(number_text(F.col(c)), F.lit("N/A"))
    whole = lambda c: F.col(c).cast("long").cast("string")
    day = F.col("game_date").cast("string")
    spread, total = known("spread_home_line", "total_line")
    home, away = known("pred_home", "pred_away")
    final = F.concat(whole("away_final"), F.lit(" – "), whole("home_final"))
    return games.select(
        "game_id",
        F.concat_ws(" @ ", "away_team", "home_team").alias("title"),
        F.concat(day, F.lit(" / "), F.coalesce(clock(F.col("start_ts"), tz), day)).alias("at"),
        F.when(
            spread | total,
            F.concat(F.lit("Spread "), shown("spread_home_line"), F.lit(", Total "), shown("total_line")),
        ).alias("lines"),
        F.when(has_finals(), final)
        .when(home & away, predicted_score(F.col("pred_away"), F.col("pred_home")))
        .otherwise("—").alias("score"),
    )
