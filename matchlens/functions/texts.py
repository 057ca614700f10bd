"""Name, JSON and label expressions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(name: Column) -> Column:
    """Lookup key of a team name: no white space, lower case; NULL is empty."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", ""))


def team_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def snake_to_camel(key: str) -> str:
    return re.sub(r"_([a-z])", lambda m: m.group(1).upper(), key)


def camel_keys(entries: Column) -> Column:
    """Camel-case the keys of a map column."""

    def one(key, _):
        words = F.split(key, "_(?=[a-z])")
        tail = F.transform(
            F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))),
        )
        return F.concat(words[0], F.array_join(tail, ""))

    return F.transform_keys(entries, one)


def parse_loose(text: Column) -> Column:
    """JSON text, possibly encoded twice, as a VARIANT; NULL if unreadable."""
    once = F.try_parse_json(text)
    inner = F.try_parse_json(F.try_variant_get(once, "$", "string"))
    return F.when(F.schema_of_variant(once) == "STRING", inner).otherwise(once)


def pick(doc: Column, *paths: str, kind: str = "string") -> Column:
    """First non-null value of the given paths of a parsed document."""
    return F.coalesce(*[F.try_variant_get(doc, p, kind) for p in paths])


def pitcher_line(sport: Column, name: Column, hand: Column) -> Column:
    label = F.concat(name, F.when(hand != "", F.concat(F.lit(" ("), hand, F.lit(")"))).otherwise(""))
    return F.when((sport == "MLB") & (F.trim(name) != ""), label)


def weather_label(indoor, temperature, wind) -> Column:
    """Indoor wins over the reading, which wins over ``N/A``."""
    reading = F.concat(temperature, F.lit("°F / "), wind, F.lit("mph"))
    return F.when(indoor, "Indoor").when(temperature.isNotNull(), reading).otherwise("N/A")


def injury_line(player, injury_type, team) -> Column:
    kind = F.when(injury_type != "", F.concat(F.lit(" ("), injury_type, F.lit(")")))
    return F.concat(player, F.coalesce(kind, F.lit("")), F.lit(" — "), team)
