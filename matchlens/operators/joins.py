"""Lookups that attach other datasets to games and teams."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.functions.numbers import number_text, to_num
from matchlens.functions.texts import canonical
from matchlens.operators.reconcile import first_of
from matchlens.skew import salted_join

# Column names the ratings may arrive under, best first.
SRS_KEYS = ("srs", "srs_rating", "srs_lite", "srsLite")
SOS_KEYS = ("sos", "sos_rating", "strength_of_schedule")


def rating(df: DataFrame, names) -> Column:
    return to_num(first_of(df, *names).cast("string"))


def _team(df: DataFrame) -> Column:
    return canonical(first_of(df, "team_name", "teamName"))


def _lookup(sources: list[tuple[DataFrame, int]], names, out: str) -> DataFrame:
    """Rating per season and team; the last row of the best source wins, even if NULL."""
    rows = [
        df.select(
            F.col("season"), _team(df).alias("team_key"), rating(df, names).alias("value"),
            F.struct(F.lit(rank).alias("rank"), F.col("pos")).alias("at"),
        )
        for df, rank in sources
    ]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return every.groupBy("season", "team_key").agg(F.max_by("value", "at").alias(out))


def _filler(flat: DataFrame, names, out: str) -> DataFrame:
    """First non-null rating per season and team of the flat summary rows."""
    value = rating(flat, names)
    known = flat.select("season", _team(flat).alias("team_key"), value.alias("v"), "pos")
    return (
        known.filter(F.col("v").isNotNull())
        .groupBy("season", "team_key").agg(F.min_by("v", "pos").alias(out))
    )


def merge_nfl_advanced(
    advanced: DataFrame,
    wrapped_srs: list[DataFrame] = (),
    wrapped_sos: list[DataFrame] = (),
    summary: DataFrame | None = None,
) -> DataFrame:
    """Advanced rows with SRS and SoS completed from the lookups.

    A row's own value wins, then the wrapped lookups (later ones overwrite
    earlier ones, also with NULL), then the flat summary fills what is missing.
    Every input carries ``season`` and its input position ``pos``.
    """
    out = advanced.withColumn("team_key", _team(advanced))
    merged = {"srs": [rating(advanced, SRS_KEYS)], "sos": [rating(advanced, SOS_KEYS)]}
    for name, frames, keys in (("srs", wrapped_srs, SRS_KEYS), ("sos", wrapped_sos, SOS_KEYS)):
        if frames:
            found = _lookup([(df, i) for i, df in enumerate(frames)], keys, f"_{name}")
            out = out.join(found, ["season", "team_key"], "left")
            merged[name].append(F.col(f"_{name}"))
        if summary is not None:
            fill = _filler(summary, keys, f"_fill_{name}")
            out = out.join(fill, ["season", "team_key"], "left")
            merged[name].append(F.col(f"_fill_{name}"))
    out = out.withColumns({name: F.coalesce(*chain) for name, chain in merged.items()})
    return out.drop("team_key", "_srs", "_sos", "_fill_srs", "_fill_sos")


def explode_wrapper(payload: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One nested ``{advanced, srs, sos}`` row per season as three flat frames."""

    def part(name):
        return payload.select("season", F.posexplode(name).alias("pos", "row")).select(
            "season", "pos", "row.*"
        )

    return part("advanced"), part("srs"), part("sos")


def with_weather(games: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather at the home team; basketball is played indoors and looks none up."""
    keys = [c for c in ("sport", "home_team") if c in weather.columns]
    readings = weather.select(
        *[F.col(c).alias(f"_{c}") for c in keys], *[c for c in weather.columns if c not in keys]
    )
    match = F.col("sport") != "NBA"
    for c in keys:
        match = match & (F.col(c) == F.col(f"_{c}"))
    indoor = (F.col("sport") == "NBA") | F.coalesce("is_indoor", F.lit(False))
    return games.join(readings, match, "left").withColumn("indoor", indoor).drop(*[f"_{c}" for c in keys])


def weather_detail(df: DataFrame) -> DataFrame:
    """Display text of a reading, with stand-ins for whatever is missing."""
    kinds = dict(df.dtypes)

    def text(name, fallback):
        shown = first_of(df, name)
        shown = number_text(shown) if kinds.get(name) == "double" else shown.cast("string")
        return F.coalesce(shown, F.lit(fallback))

    unit = lambda name, mark, fallback="–": F.concat(text(name, fallback), F.lit(mark))
    return df.withColumns(
        {
            "city": text("city", "—"),
            "stadium": text("stadium", "Indoor Venue"),
            "temperature": unit("temperature", "°F"),
            "feels_like": unit("feels_like", "°F"),
            "humidity": unit("humidity", "%"),
            "wind": unit("wind_speed", " mph", "0"),
            "wind_angle": F.coalesce(first_of(df, "wind_angle"), F.lit(0)),
        }
    )


def with_snapshot(games: DataFrame, snapshots: DataFrame) -> DataFrame:
    return games.join(snapshots, ["sport", "game_id"], "left")


def quotes_before_start(quotes: DataFrame, games: DataFrame) -> DataFrame:
    """Games with the last quote taken before their start, NULL without one.

    The quote side may be concentrated on one game, so the match is salted and
    then reduced to one quote per game with map-side aggregation.
    """
    starts = games.select("game_id", "start_ts")
    payload = [c for c in quotes.columns if c not in ("game_id", "quote_ts", "quote_id")]
    valid = salted_join(quotes, starts, ["game_id"], spread=["quote_id"]).filter("quote_ts < start_ts")
    last = valid.groupBy("game_id").agg(
        F.max(F.struct("quote_ts", "quote_id", *payload)).alias("_q"), F.count("*").alias("quotes_seen")
    )
    last = last.select("game_id", "_q.*", "quotes_seen")
    own = [c for c in games.columns if c not in payload]
    return games.select(*own).join(last, "game_id", "left")
