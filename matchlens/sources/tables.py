"""League entities derived from the star-schema tables.

The tables carry no sports data, so every entity is a fixed arithmetic
function of their rows: an order is a game, a nation a team, a line item a
box-score line, an event a quote, an injury report or a probe. The work of
every query therefore grows with the tables.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.stages import observed

TEAMS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(x: Column, n: int) -> Column:
    return F.floor(x / n)


def _by_sport(mlb, nfl, nba) -> Column:
    m = F.col("k") % 3
    return F.when(m == 0, mlb).when(m == 1, nfl).otherwise(nba)


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def _days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: schedule, prices, spread, predictions and final scores."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("day_ts"),
        F.col("o_orderstatus").alias("status"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("p"),
        F.floor(F.col("o_totalprice") * 100 / 161).cast("long").alias("q"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation")
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("home_team"))
    away = nation.select(F.col("n_nationkey").alias("away_key"), F.col("n_name").alias("away_team"))

    k, p, q = F.col("k"), F.col("p"), F.col("q")
    swing = F.pmod(k * 37, F.lit(190))
    favourite, underdog = -(swing + 110), swing + 95
    even = k % 2 == 0
    spread = (F.pmod(k * 13, F.lit(29)) - 14).cast("double") / 2
    played = F.col("status") == "F"
    home_pts, away_pts = F.pmod(p, F.lit(40)), F.pmod(q, F.lit(40))

    def score(x):
        tenth = lambda base, span: F.lit(float(base)) + F.pmod(x, F.lit(span)).cast("double") / 10
        return _by_sport(tenth(3, 40), tenth(17, 140), tenth(105, 160))

    return (
        orders.join(customers, "c_custkey")
        .join(home, "c_nationkey")
        .withColumn("away_key", ((F.col("c_nationkey") + 1 + k % 24) % TEAMS).cast("int"))
        .join(away, "away_key")
        .select(
            k.alias("game_id"),
            _by_sport(F.lit("MLB"), F.lit("NFL"), F.lit("NBA")).alias("sport"),
            F.to_date("day_ts").alias("game_date"),
            (F.col("day_ts") + _hours(k % 12 + 12)).alias("start_ts"),
            "home_team",
            "away_team",
            F.when(played, "Final")
            .when(F.col("status") == "O", "Scheduled")
            .otherwise("In Progress")
            .alias("status_state"),
            F.when(played, "historical").otherwise("schedule").alias("data_type"),
            score(p).alias("pred_home"),
            score(q).alias("pred_away"),
            F.when(even, favourite).otherwise(underdog).cast("double").alias("ml_home"),
            F.when(even, underdog).otherwise(favourite).cast("double").alias("ml_away"),
            F.when(k % 17 == 0, None)
            .otherwise(_by_sport(F.when(even, -1.5).otherwise(1.5), spread, spread))
            .alias("spread_home_line"),
            _by_sport(F.lit(8.5), F.lit(44.5), F.lit(221.0)).alias("total_line"),
            F.when(played, home_pts + (home_pts == away_pts).cast("long")).alias("home_final"),
            F.when(played, away_pts).alias("away_final"),
        )
    )


def raw_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games as they arrive: odds and predictions under several keys and encodings."""
    g = games(spark, sf_dir)
    k = F.col("game_id")
    ml_home, ml_away = F.col("ml_home").cast("long"), F.col("ml_away").cast("long")
    price = lambda x: x.cast("string")

    def encoded(single):
        double = F.concat(F.lit('"'), F.replace(single, F.lit('"'), F.lit('\\"')), F.lit('"'))
        return (
            F.when(k % 5 == 0, None)
            .when(k % 5 == 1, "not json")
            .when(k % 5 == 2, single)
            .otherwise(double)
        )

    ml_json = F.concat(
        F.lit('{"home":'), price(ml_home), F.lit(',"away":"'), price(ml_away), F.lit('"}')
    )
    line = F.coalesce(F.col("spread_home_line"), F.lit(0.5)).cast("string")
    side = lambda name, value, odds: F.concat(
        F.lit(f'"{name}":{{"line":'), value, F.lit(',"'),
        F.when(k % 3 == 0, "price").when(k % 3 == 1, "odds").otherwise("american"),
        F.lit(f'":{odds}}}'),
    )
    spread_json = F.concat(F.lit("{"), side("home", line, -110), F.lit(","), side("away", line, -105), F.lit("}"))
    total_json = F.concat(
        F.when(k % 2 == 0, '{"line":').otherwise('{"over":'), F.col("total_line").cast("string"), F.lit("}")
    )
    # Texts are built once and encoded in the next step.
    g = observed(g.withColumns({"_ml": ml_json, "_sp": spread_json, "_tt": total_json}), "raw_games", "_ml IS NOT NULL")
    ml_json, spread_json, total_json = F.col("_ml"), F.col("_sp"), F.col("_tt")
    explicit = k % 7 == 0
    tail = _div(k, 3) % 3
    keyed = lambda n, x: F.when(tail == n, x.cast("string"))
    sport = F.col("sport")
    only = lambda name, x: F.when(sport == name, x)
    return g.select(
        "game_id", "sport", "game_date", "start_ts", "home_team", "away_team", "status_state", "data_type",
        F.when(explicit, price(ml_home)).alias("moneylineHome"),
        F.when(explicit & (k % 2 == 0), price(ml_away)).alias("moneylineAway"),
        F.when(k % 4 < 2, encoded(ml_json)).alias("moneyline_clean"),
        F.when(k % 4 >= 2, encoded(ml_json)).alias("moneylineClean"),
        F.when(
            k % 6 != 5,
            F.create_map("home_team", price(ml_home), "away_team", price(ml_away)),
        ).alias("moneyline"),
        F.when(k % 3 == 1, F.col("spread_home_line")).alias("spreadLine"),
        encoded(spread_json).alias("spread_clean"),
        F.when(k % 4 == 1, F.col("total_line")).alias("totalLine"),
        encoded(total_json).alias("total_clean"),
        only("NBA", keyed(0, F.col("pred_home"))).alias("predictionHome"),
        only("NBA", keyed(0, F.col("pred_away"))).alias("predictionAway"),
        only("NBA", keyed(1, F.col("pred_home"))).alias("predHome"),
        only("NBA", keyed(1, F.col("pred_away"))).alias("predAway"),
        F.coalesce(
            only("NFL", keyed(0, F.col("pred_home"))), only("NBA", keyed(2, F.col("pred_home")))
        ).alias("predicted_home_score"),
        F.coalesce(
            only("NFL", keyed(0, F.col("pred_away"))), only("NBA", keyed(2, F.lit("N/A")))
        ).alias("predicted_away_score"),
        only("NFL", keyed(1, F.col("pred_home"))).alias("predictedHomeScore"),
        only("NFL", keyed(1, F.col("pred_away"))).alias("predictedAwayScore"),
        only("MLB", keyed(0, F.col("pred_home"))).alias("predicted_home_runs"),
        only("MLB", keyed(0, F.col("pred_away"))).alias("predicted_away_runs"),
        only("MLB", keyed(1, F.col("pred_home"))).alias("predictedHomeRuns"),
        only("MLB", keyed(1, F.col("pred_away"))).alias("predictedAwayRuns"),
        "home_final", "away_final",
    )


def nation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("n"), F.col("n_name").alias("team")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def injuries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per event, dated in June 1998; names come in uneven spelling."""
    e = F.col("event_id")
    name = F.col("team")
    spelled = (
        F.when(e % 11 == 0, "  ")
        .when(e % 4 == 0, F.concat(F.lit(" "), name, F.lit(" ")))
        .when(e % 4 == 1, F.lower(name))
        .otherwise(name)
    )
    return (
        events(spark, sf_dir)
        .withColumn("n", F.col("user_id") % TEAMS)
        .join(nation_names(spark, sf_dir), "n")
        .select(
            e.alias("id"),
            F.concat(F.lit("Player "), F.col("user_id")).alias("player"),
            spelled.alias("team_display_name"),
            F.element_at(
                F.array(*map(F.lit, ["Out", "Doubtful", "Questionable", "Probable", "Day-to-Day"])),
                (e % 5 + 1).cast("int"),
            ).alias("status"),
            F.when(e % 3 == 0, None).when(e % 3 == 1, "knee").otherwise("").alias("injury_type"),
            F.element_at(
                F.array(*map(F.lit, ["MLB", "NFL", "NBA"])), (F.floor(e / 5) % 3 + 1).cast("int")
            ).alias("league"),
            (F.lit("1998-06-01").cast("date") + F.date_diff(F.to_date("ts"), F.lit("2024-01-01"))).alias(
                "report_date"
            ),
            F.col("event_type").alias("detail"),
        )
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One odds quote per event."""
    e = F.col("event_id")
    v = F.floor(F.col("value") * 100).cast("long") % 190
    even = e % 2 == 0
    return events(spark, sf_dir).select(
        (F.col("user_id") * 7 + e % 7).alias("game_id"),
        F.col("ts").alias("quote_ts"),
        e.alias("quote_id"),
        F.when(even, -(v + 110)).otherwise(v + 95).cast("double").alias("ml_home"),
        F.when(even, v + 95).otherwise(-(v + 110)).cast("double").alias("ml_away"),
    )


def replayed_starts(games_df: DataFrame) -> DataFrame:
    """Games moved into the month the quotes were taken in."""
    k = F.col("game_id")
    start = F.lit("2024-01-01").cast("timestamp_ntz") + _days(k % 30) + _hours(k % 12 + 12)
    return games_df.withColumn("start_ts", start)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        "user_id",
        "ts",
        "event_id",
        F.when(kind == "error", "fail").when(kind == "signup", "abort").when(kind == "click", "fail")
        .otherwise("ok").alias("outcome"),
        (F.col("event_id") % 3 != 0).alias("soft_online"),
    )


def box_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box-score or drive line per line item."""
    q, ln = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    made, threes, free = _div(q, 2), _div(q, 6), _div(q, 5)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game_id"),
        F.col("l_suppkey").alias("player_id"),
        (ln % 2 == 1).alias("is_home"),
        ln.alias("period"),
        q.alias("minutes"),
        ((made - threes) * 2 + threes * 3 + free).alias("points"),
        made.alias("fg_made"),
        (q + ln).alias("fg_attempted"),
        threes.alias("three_made"),
        _div(q, 3).alias("three_attempted"),
        free.alias("ft_made"),
        (_div(q, 4) + 1).alias("ft_attempted"),
        (q % 9).alias("assists"),
        (q % 4).alias("steals"),
        (q % 3).alias("blocks"),
        ln.alias("oreb"),
        (q % 7).alias("dreb"),
        (q % 5).alias("tov"),
        (q + ln).alias("yards"),
        (q % 7 == 0).cast("long").alias("turnovers"),
        (q % 4).alias("third_att"),
        F.floor((q % 4) / 2).alias("third_made"),
        (q % 5 == 0).cast("long").alias("red_zone_trips"),
        (q % 10 == 0).cast("long").alias("red_zone_scores"),
        (q * 4 + 60).alias("possession_sec"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per home team; a few have none."""
    n = F.col("n")
    return nation_names(spark, sf_dir).filter(n % 9 != 8).select(
        F.col("team").alias("home_team"),
        (n * 2 + 40).alias("temperature"),
        F.when(n % 6 != 5, n % 13).alias("wind_speed"),
        F.when(n % 3 != 0, n * 15).alias("wind_angle"),
        F.when(n % 5 != 4, F.concat(F.lit("City "), n)).alias("city"),
        (n % 4 == 0).alias("is_indoor"),
    )


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature map per part, in either of the two places it may sit."""
    p = table(spark, sf_dir, "part")
    m = F.create_map(
        F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice")
    )
    top = F.col("p_partkey") % 3 == 0
    return p.select(
        F.col("p_partkey").alias("game_id"),
        F.when(top, m).alias("features"),
        F.struct(F.when(~top, m).alias("features")).alias("data"),
    )
