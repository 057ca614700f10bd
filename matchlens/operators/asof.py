"""The last quote before each start as a merge, without joining quotes to games.

Quotes and starts stand in one table sorted by game and time. The sort cuts that
order into even blocks, also through a game that holds most of the quotes; a
running maximum carries the place of the last quote forward, across the borders
of blocks by one number for each. A game then fetches the one row at its place.
Quotes are never repeated, compared by their payload or gathered by game.
"""

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.skew import sorted_blocks


def last_before(
    quotes: DataFrame, games: DataFrame, key: str = "game_id", at: str = "quote_ts", by: str = "quote_id", start: str = "start_ts"
) -> DataFrame:
    """``games`` with the columns of the last quote strictly before their start, and ``quotes_seen``.

    Of quotes at one moment the one with the greatest ``by`` counts. Games without
    a start, or without a quote before it, have NULL in all of them; quotes without
    a key, a time or a game are passed over. Payloads may be of any type, maps too.
    Columns of ``games`` that quotes also have give way; each row of ``games`` stays once.
    """
    payload = [c for c in quotes.columns if c != key]
    own = [c for c in games.columns if c not in payload]
    # At one moment the start comes before the quote.
    starts = games.select(
        F.col(key).alias("_key"), F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(quotes.schema[by].dataType).alias("_by"),
        F.struct(*own).alias("_game"), F.lit(None).cast(quotes.select(F.struct(*payload)).schema[0].dataType).alias("_quote"),
    )
    rows = quotes.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("_key"), F.col(at).cast(games.schema[start].dataType).alias("_at"), F.lit(1).alias("_kind"),
        F.col(by).alias("_by"), F.lit(None).cast(starts.schema["_game"].dataType).alias("_game"), F.struct(*payload).alias("_quote"),
    )
    # Starts that are not known stand before all quotes.
    ordered = sorted_blocks(rows.unionByName(starts), ["_key", F.col("_at").asc_nulls_first(), "_kind", "_by"])
    quoted = F.col("_kind") == 1
    marked = ordered.rows.withColumns({"_one": quoted.cast("long"), "_seat": F.when(quoted, F.col("_pos"))})
    merged = replace(ordered, rows=marked).running(["_key"], _seen=("sum", "_one"), _place=("max", "_seat"))
    # Games without a quote get places of their own that no quote has, as one NULL would bring them all to one task.
    found = merged.filter("_kind = 0").select(
        "_game", F.coalesce("_place", -1 - F.col("_pos")).alias("_place"), F.when(F.col("_place").isNotNull(), F.col("_seen")).alias("quotes_seen")
    )
    places = ordered.rows.filter(quoted).select(F.col("_pos").alias("_place"), "_quote")
    return found.join(places, "_place", "left").select("_game.*", "_quote.*", "quotes_seen")
