"""Per-game snapshot arrays and how their charts read them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions.numbers import grouped, to_fixed

# Chart colours in order, and the category of an empty chart.
PALETTE = ("#4ade80", "#60a5fa", "#fbbf24", "#f87171", "#a78bfa", "#facc15")
PLACEHOLDER = "Pregame Distribution N/A"


def percentile_index(table: DataFrame, metrics: list[str], group: list[str]) -> DataFrame:
    """0-100 index of each metric within its league and season.

    One row per team, so a group has a few dozen rows.
    """
    index = lambda m: F.percent_rank().over(Window.partitionBy(*group).orderBy(F.col(m))) * 100
    return table.withColumns({f"{m}_idx": index(m) for m in metrics})


def period_bars(lines: DataFrame, periods: int) -> DataFrame:
    """``bar_chart_data`` per game: points of both sides in each period.

    Fixed slots instead of a collected list, so the sums combine on the map side.
    The last slot takes all later periods too.
    """
    at = lambda p, home: (F.least("period", F.lit(periods)) == p) & (F.col("is_home") if home else ~F.col("is_home"))
    points = lambda p, home: F.sum(F.when(at(p, home), F.col("points")))
    sums = {(p, home): points(p, home).alias(f"p{p}_{home}") for p in range(1, periods + 1) for home in (True, False)}
    wide = lines.groupBy("game_id").agg(*sums.values())
    bar = lambda p: F.struct(
        F.lit(f"Q{p}").alias("category"),
        F.col(f"p{p}_True").cast("double").alias("Home"),
        F.col(f"p{p}_False").cast("double").alias("Away"),
    )
    played = lambda x: x["Home"].isNotNull() | x["Away"].isNotNull()
    bars = F.filter(F.array(*[bar(p) for p in range(1, periods + 1)]), played)
    return wide.select("game_id", bars.alias("bar_chart_data"))


def side_metrics(games: DataFrame, table: DataFrame, metrics: list[str]) -> DataFrame:
    """Both teams' season metrics and indexes as ``radar`` and ``key_metrics`` arrays."""
    keep = [*metrics, *[f"{m}_idx" for m in metrics]]
    side = lambda s: table.select(
        "sport", "season", F.col("team").alias(f"{s}_team"), F.struct(*keep).alias(f"_{s}")
    )
    both = games.join(side("home"), ["sport", "season", "home_team"], "left").join(
        side("away"), ["sport", "season", "away_team"], "left"
    )
    radar = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"_home.{m}").alias("home_raw"), F.col(f"_away.{m}").alias("away_raw"),
                F.col(f"_home.{m}_idx").alias("home_idx"), F.col(f"_away.{m}_idx").alias("away_idx"),
            )
            for m in metrics
        ]
    )
    bars = F.array(
        *[
            F.struct(
                F.lit(m).alias("category"),
                F.col(f"_home.{m}").alias("Home"), F.col(f"_away.{m}").alias("Away"),
            )
            for m in metrics
        ]
    )
    known = F.col("_home").isNotNull() & F.col("_away").isNotNull()
    return both.withColumns(
        {
            "radar_chart_data": F.when(known, radar),
            "key_metrics_data": F.when(known, bars),
        }
    ).drop("_home", "_away")


def headline(label: str, value: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"))


def headline_value(x: Column) -> Column:
    return grouped(x)


def is_exhibition() -> Column:
    return F.col("message").isNotNull()


def section_flags(df: DataFrame) -> DataFrame:
    """Which sections a snapshot has and what they are called."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    regular = ~is_exhibition()
    baseball = F.col("sport") == "MLB"
    first_pie = F.try_element_at("pie_chart_data", F.lit(1))
    multi_bar = F.exists("bar_chart_data", lambda b: b["Home"].isNotNull() & b["Away"].isNotNull())
    return df.withColumns(
        {
            "is_exhibition": is_exhibition(),
            "has_pie": regular & some("pie_chart_data"),
            "has_key_metrics": regular & some("key_metrics_data"),
            "is_multi_pie": regular & F.coalesce(first_pie["data"].isNotNull(), F.lit(False)),
            "is_multi_series": regular & F.coalesce(multi_bar, F.lit(False)),
            "bar_title": F.when(baseball, "Scoring Averages").otherwise("Quarter Scoring"),
            "pie_title": F.when(baseball, "Avg Runs Vs LHP / RHP").otherwise("Scoring Distribution"),
        }
    )


def coloured(slices: Column) -> Column:
    """Slices with their own colour or the palette's; a lone placeholder gives NULL."""
    palette = F.array(*map(F.lit, PALETTE))
    own = lambda x, i: F.struct(
        x["category"].alias("category"),
        x["value"].alias("value"),
        F.coalesce(
            F.nullif(x["color"], F.lit("")), F.element_at(palette, (i % len(PALETTE) + 1).cast("int"))
        ).alias("color"),
    )
    first = F.try_element_at(slices, F.lit(1))
    placeholder = (F.size(slices) == 1) & (first["category"] == PLACEHOLDER)
    return F.when(~F.coalesce(placeholder, F.lit(False)), F.transform(slices, own))


def radar_tooltip(side: str, raw: Column, index: Column) -> Column:
    return F.concat(F.lit(f"{side} • "), raw, F.lit(" (idx "), to_fixed(index, 1), F.lit(")"))


def offence_axis(x: Column) -> Column:
    return F.when(x >= 0.5, to_fixed(x * 100, 0)).otherwise(to_fixed(x, 1))


def offence_tooltip(metric: Column, x: Column) -> Column:
    shown = to_fixed(x * 100, 1)
    return F.when(metric == "OffRtg", shown).otherwise(F.concat(shown, F.lit("%")))


def bar_label(x: Column) -> Column:
    return to_fixed(x, 1)


def pie_label(sport: Column, name: Column, value: Column) -> Column:
    """Baseball and football names already carry the value."""
    return F.when(sport == "NBA", F.concat(name, F.lit(": "), grouped(value))).otherwise(name)


def period_averages(lines: DataFrame, games: DataFrame, periods: list[int]) -> DataFrame:
    """Average points per period of each team.

    Later periods count together as overtime, over the games that had any.
    """
    overtime = max(periods) + 1
    period = F.least("period", F.lit(overtime)).alias("period")
    by_side = lines.groupBy("game_id", "is_home", period).agg(F.sum("points").alias("points"))
    names = games.select("game_id", "sport", "home_team", "away_team")
    team = F.when(F.col("is_home"), F.col("home_team")).otherwise(F.col("away_team"))
    return (
        by_side.join(names, "game_id")
        .groupBy("sport", team.alias("team"))
        .pivot("period", [*periods, overtime])
        .agg(F.avg("points"))
        .select(
            "sport", "team", *[F.col(str(p)).alias(f"q{p}_avg") for p in periods],
            F.col(str(overtime)).alias("overtime_avg"),
        )
    )


def runs_by_hand(rows: DataFrame) -> DataFrame:
    """Average runs of each team against left- and right-handed opposing pitchers."""
    against = lambda hand: F.avg(F.when(F.col("opposing_hand") == hand, F.col("pf")))
    return rows.groupBy("season", "team").agg(
        against("L").alias("runs_vs_lhp"), against("R").alias("runs_vs_rhp")
    )


def assemble(games, bars, metrics, headlines: Column, pie: Column, message: Column) -> DataFrame:
    """One snapshot per game; exhibition games carry only a message."""
    regular = F.col("message").isNull()
    only = lambda c: F.when(regular, c)
    return (
        games.join(metrics, "game_id", "left")
        .join(bars, "game_id", "left")
        .withColumn("message", message)
        .select(
            "game_id", "sport", "game_date", "message",
            only(headlines).alias("headline_stats"),
            only(F.col("bar_chart_data")).alias("bar_chart_data"),
            only(F.col("radar_chart_data")).alias("radar_chart_data"),
            only(F.col("key_metrics_data")).alias("key_metrics_data"),
            only(pie).alias("pie_chart_data"),
            (F.col("data_type") == "historical").alias("is_historical"),
            F.when(F.col("data_type") == "historical", "postgame").otherwise("pregame").alias("stage"),
        )
    )


def section_rows(df: DataFrame) -> DataFrame:
    """Every array element as ``(game_id, section, pos, label, home, away)``, in one pass."""
    none = F.lit(None).cast("double")

    def part(name, section, label, home, away):
        row = lambda x, i: F.struct(
            F.lit(section).alias("section"), i.alias("pos"), label(x).alias("label"),
            home(x).alias("home"), away(x).alias("away"),
        )
        return F.coalesce(F.transform(name, row), F.array())

    field = lambda name: lambda x: x[name]
    parts = [
        part("bar_chart_data", "bar", field("category"), field("Home"), field("Away")),
        part("radar_chart_data", "radar", field("metric"), field("home_idx"), field("away_idx")),
        part("key_metrics_data", "key", field("category"), field("Home"), field("Away")),
        part("headline_stats", "headline", lambda x: F.concat_ws(" ", x["label"], x["value"]), lambda x: none, lambda x: none),
        part("pie_chart_data", "pie", field("category"), field("value"), lambda x: none),
    ]
    return df.select("game_id", F.inline(F.concat(*parts)))
