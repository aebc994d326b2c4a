"""Rules of the published catalogue and of single roads: flags, keys, display formats, speeds from tags and registers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How busy a road class is, 0 to 1, and what holds for the others.
CLASS_BUSY = {
    "motorway": 1.0, "motorway_link": 1.0, "trunk": 0.95, "trunk_link": 0.95, "primary": 0.8, "primary_link": 0.8, "secondary": 0.55, "secondary_link": 0.55,
    "tertiary": 0.35, "tertiary_link": 0.35, "unclassified": 0.22, "road": 0.3, "residential": 0.45, "living_street": 0.55,
}
OTHER_BUSY = 0.3
# Limits of the mapped Estonian speed zones, and the greatest limit.
ZONE_SPEEDS = {"EE:rural": 90, "EE:urban": 50}
MOST_SPEED = 130


def class_busyness(highway: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CLASS_BUSY.items() for x in pair])
    return F.coalesce(F.element_at(table, highway), F.lit(OTHER_BUSY))


def advisory_speed(register: Column, sign: Column, mapped: Column) -> tuple[Column, Column]:
    """The advisory speed and its source: register before sign before map; 0 and null are none."""
    given = {"register": register, "sign": sign, "map": mapped}
    set_ = [F.when(c > 0, F.struct(c.cast("int").alias("speed"), F.lit(k).alias("source"))) for k, c in given.items()]
    best = F.coalesce(*set_)
    return F.coalesce(best["speed"], F.lit(0)), F.coalesce(best["source"], F.lit("none"))


def route_flags(out_and_back: Column, km: Column, reach_min: Column, least_km: float, most_km: float, near_min: float) -> Column:
    return F.array_compact(F.array(
        F.when(out_and_back, "out_and_back"), F.when(~km.between(least_km, most_km), "length_outside_ideal"),
        F.when(reach_min.isNull(), "home_unreachable").when(reach_min > near_min, "far_from_home"),
    ))


def route_key(country: Column, catalogue: Column, ident: Column) -> Column:
    """The home country's keys have no prefix."""
    return F.concat(F.when(country == "nl", "").otherwise(F.concat(country, F.lit(":"))), catalogue, F.lit(":"), ident)


def belongs_to(key: Column, country: Column) -> Column:
    return F.when(country == "nl", key.rlike("^(circuit|linked|sprint):")).otherwise(key.startswith(F.concat(country, F.lit(":"))))


def shown_km(km: Column) -> Column:
    """One decimal; from ten kilometres on only if it is not zero."""
    tenth = F.format_string("%.1f", F.round(km, 1))
    return F.concat(F.when(km < 10, tenth).otherwise(F.regexp_replace(tenth, r"\.0$", "")), F.lit(" km"))


def shown_share(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def shown_count(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))


def shown_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "d MMMM yyyy"), F.lit("unknown date"))


def mapped_speeds(tags: Column, forward: Column, backward: Column) -> tuple[Column, Column]:
    """Limits in both directions from tags; a direction that is closed has the other's limit.

    Plain numbers up to MOST_SPEED count, or a zone; an explicit limit that is neither is 0 and no zone replaces it.
    """
    zones = F.create_map(*[F.lit(x) for pair in ZONE_SPEEDS.items() for x in pair])

    def value(text: Column) -> Column:
        number = F.when(text.rlike(r"^\d{1,3}$"), text.cast("int"))
        return F.coalesce(F.when(number.between(1, MOST_SPEED), number), F.element_at(zones, text), F.lit(0))

    zone = F.coalesce(F.nullif(tags["maxspeed:type"], F.lit("")), tags["source:maxspeed"])
    base = F.when(tags["maxspeed"].isNotNull(), value(tags["maxspeed"])).otherwise(F.coalesce(F.element_at(zones, zone), F.lit(0)))
    ahead, back = (F.when(F.coalesce(tags[f"maxspeed:{d}"], F.lit("")) != "", value(tags[f"maxspeed:{d}"])).otherwise(base) for d in ("forward", "backward"))
    return F.when(forward, ahead).otherwise(back), F.when(backward, back).otherwise(ahead)


def register_speeds(ahead: Column, back: Column, plates: list[Column]) -> Column:
    """Both directions' limits of a register row; null if a plate restricts them or one is no whole number up to MOST_SPEED."""
    plain = [p.isNull() | p.isin("", "0") for p in plates]
    whole = [(v == F.floor(v)) & v.between(1, MOST_SPEED) for v in (ahead, back)]
    ok = F.lit(True)
    for condition in plain + whole:
        ok = ok & F.coalesce(condition, F.lit(False))
    return F.when(ok, F.struct(ahead.cast("int").alias("forward"), back.cast("int").alias("backward")))
