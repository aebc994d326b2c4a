"""Scalar rules of the road model, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..country import Country

# Road classes, in the order of their codes from 1.
HIGHWAYS = (
    "living_street", "motorway", "motorway_link", "primary", "primary_link", "residential", "road", "secondary",
    "secondary_link", "tertiary", "tertiary_link", "trunk", "trunk_link", "unclassified",
)
# Surface codes.
SURFACES = {
    "asphalt": 1, "chipseal": 1, "tarred": 1, "concrete": 2, "concrete:lanes": 2, "concrete:plates": 2, "paved": 3,
    "metal": 3, "wood": 3, "paving_stones": 4, "bricks": 4, "brick": 4, "sett": 5, "cobblestone": 5,
    "unhewn_cobblestone": 5, "pebblestone": 6, "compacted": 6, "fine_gravel": 6, "gravel": 6, "ground": 6, "dirt": 6,
    "earth": 6, "grass": 6, "mud": 6, "sand": 6, "woodchips": 6, "unpaved": 6,
}
# Smoothness codes.
SMOOTHNESS = {"excellent": 1, "good": 2, "intermediate": 3, "bad": 4, "very_bad": 5, "horrible": 6, "very_horrible": 7, "impassable": 8}
# Legal speeds by class where nothing else is known.
CLASS_SPEED = {
    "motorway": 100, "motorway_link": 80, "trunk": 100, "trunk_link": 80, "primary": 80, "primary_link": 60,
    "secondary": 80, "secondary_link": 60, "tertiary": 60, "tertiary_link": 50, "unclassified": 60, "road": 50,
    "residential": 30, "living_street": 15,
}
# Named speeds.
NAMED_SPEED = {"walk": 15, "NL:walk": 15, "NL:urban": 50, "NL:rural": 80, "NL:motorway": 100, "NL:trunk": 100, "NL:zone30": 30, "NL:zone60": 60}
# Flag bits.
BRIDGE, TUNNEL, MOTORWAY, LINK, ROUNDABOUT = 1, 2, 4, 8, 16
# Restrictions that close a road to through traffic.
CLOSED = ("no", "private", "agricultural", "forestry", "destination")
# Fixed value: standard gravity.
GRAVITY = 9.80665


def lookup(value: Column, table: dict, default: object = 0) -> Column:
    """The table's entry, folded into a literal map."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[value], F.lit(default))


def highway_code(value: Column) -> Column:
    return lookup(value, {name: i + 1 for i, name in enumerate(HIGHWAYS)})


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def parse_speed(value: Column) -> Column:
    """Speed text to km/h; 0 is unknown. Miles are rounded half to even, and only 1 to 140 counts."""
    text = F.trim(value)
    zone = F.regexp_extract(text, r"^NL:zone([0-9]+)$", 1)
    number = F.regexp_extract(text, r"^\s*([0-9]+)", 1).try_cast("int")
    miles = F.regexp_extract(text, r"(?i)^\s*[0-9]+\s*(mph)", 1) != ""
    kmh = F.when(miles, F.bround(number * 1.60934, 0)).otherwise(number).cast("int")
    named = F.create_map(*[F.lit(x) for pair in NAMED_SPEED.items() for x in pair])[text]
    return F.coalesce(named, F.when(zone != "", zone.cast("int")), F.when(kmh.between(1, 140), kmh), F.lit(0))


def legal_speed(official: Column, tagged: Column, highway: Column) -> Column:
    """The official speed, else the tagged one, else the class's: struct of speed and source (2, 1, 3)."""
    default = lookup(highway, CLASS_SPEED, 50)
    return F.struct(
        F.when(official > 0, official).when(tagged > 0, tagged).otherwise(default).alias("legal_speed"),
        F.when(official > 0, 2).when(tagged > 0, 1).otherwise(3).alias("speed_source"),
    )


def first_positive(*values: Column) -> Column:
    """The first value above 0, else 0 (precedences of advisory speeds)."""
    return F.coalesce(*[F.when(v > 0, v) for v in values], F.lit(0))


def normalise_name(name: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]", "")


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and the letters that are left without the marks, by Unicode's decomposition."""
    bare = {c: "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])}
    changed = {c: b for c, b in bare.items() if len(b) == 1 and b != c}
    return "".join(changed), "".join(changed.values())


def road_key(name: Column) -> Column:
    """Arrow for a dash between places, no accents, lower case, no blank ends."""
    bare = F.translate(F.regexp_replace(F.regexp_replace(name, "—", "→"), r"\p{M}", ""), *_accents())
    return F.trim(F.lower(bare))


def time_window_limit(limit: Column, begin: Column, end: Column, otherwise: Column, hour: Column) -> Column:
    """The limit inside [begin, end), which may pass midnight, and the alternative outside; 0 if there is none."""
    base = F.coalesce(F.trim(limit).try_cast("int"), F.lit(0))
    inside = F.when(begin == end, True).when(begin < end, (hour >= begin) & (hour < end)).otherwise((hour >= begin) | (hour < end))
    return F.when(begin.isNull() | end.isNull() | otherwise.isNull() | inside, base).otherwise(otherwise.cast("int"))


def reliability(value: Column) -> Column:
    """Text such as 50% as a share; .75 where it says nothing."""
    share = F.rtrim(F.trim(value), F.lit("%")).try_cast("double") / 100
    return F.when(share.isNotNull(), clip01(share)).otherwise(0.75)  # clip01 takes no null


def direction_code(value: Column) -> Column:
    return F.when(value == "H", 1).when(value == "T", -1).otherwise(0)


def piecewise(points: list, value: Column) -> Column:
    """Linear between the anchors, flat outside; the anchors are literals."""
    out = F.when(value <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(value <= x1, F.lit(float(y0)) + (value - x0) * (float(y1 - y0) / (x1 - x0)))
    return out.otherwise(F.when(value.isNull(), None).otherwise(float(points[-1][1])))


def straight_score(anchor: dict, share: Column) -> Column:
    lo, hi, below, above, peak = (float(anchor[k]) for k in ("ideal_min", "ideal_max", "below", "above", "peak"))
    return (
        F.when(share < lo, below + (peak - below) * share / max(lo, 1e-9))
        .when(share > hi, peak - (peak - above) * clip01((share - hi) / max(1 - hi, 1e-9)))
        .otherwise(peak)
    )


def surface_score(rubric: dict, surface: Column, smooth: Column, bumps: Column, calm: Column, width: Column, cameras: Column) -> Column:
    base, pen = rubric["surface_base"], rubric["low_car_penalties"]
    names = {1: "asphalt", 2: "concrete", 3: "paved", 4: "paving_stones", 5: "sett", 6: "unpaved"}
    score = lookup(surface, {k: float(base[v]) for k, v in names.items()}, float(base["default"]))
    factors = [
        F.when(smooth == 3, 0.85).when(smooth >= 4, 0.6).otherwise(1.0),
        F.pow(F.lit(float(pen["speed_bump_each"])), F.least(bumps, F.lit(12))),
        F.when(calm, float(pen["table_each"])).otherwise(1.0),
        F.when((width > 0) & (width < 3), float(pen["very_narrow_below_3m"])).when((width >= 3) & (width < 4), float(pen["narrow_below_4m"])).otherwise(1.0),
        F.pow(F.lit(float(pen["camera_each"])), F.least(cameras, F.lit(6))),
    ]
    return clip01(reduce(lambda a, b: a * b, factors, score))


def exclusion_reasons(surface: Column, flags: Column, bumps: Column, length_m: Column, highway: Column, busyness: Column, legal: Column) -> Column:
    """Every reason why an edge is no part of a stretch; none: an empty array."""
    km = F.greatest(length_m / 1000, F.lit(1e-4))
    return F.array_compact(F.array(
        F.when(surface == 6, "loose"), F.when(surface == 5, "sett"), F.when(flags.bitwiseAND(MOTORWAY) > 0, "motorway"),
        F.when(bumps / km > 3, "bumps"), F.when(highway.isin("residential", "living_street") & (busyness > 0.45), "built_up"), F.when(legal <= 30, "slow"),
    ))


def corner_speed(radius: Column, lateral: float = 0.45) -> Column:
    return F.sqrt(F.greatest(F.lit(lateral * GRAVITY) * radius, F.lit(0.0))) * 3.6


def flag_bits(tags: Column, highway: Column) -> Column:
    yes = lambda key: F.coalesce(~tags[key].isin("no"), F.lit(False))
    bit = lambda condition, n: F.when(condition, n).otherwise(0)
    return (
        bit(yes("bridge"), BRIDGE) + bit(yes("tunnel"), TUNNEL) + bit(highway.isin("motorway", "trunk", "motorway_link", "trunk_link"), MOTORWAY)
        + bit(highway.endswith("_link"), LINK) + bit(F.coalesce(tags["junction"].isin("roundabout", "circular"), F.lit(False)), ROUNDABOUT)
    )


def width_m(value: Column) -> Column:
    return F.coalesce(F.split(F.trim(value), r"\s+")[0].try_cast("double"), F.lit(0.0))


def lane_count(value: Column) -> Column:
    return F.least(F.coalesce(value.try_cast("int"), F.lit(0)), F.lit(255))


def is_drivable(tags: Column, windows: Column) -> Column:
    """Public, paved roads for cars that are open in some window."""
    vehicle = F.coalesce(tags["motorcar"], tags["motor_vehicle"], tags["vehicle"], F.lit(""))
    access = F.coalesce(tags["access"], F.lit(""))
    blocked = access.isin(*CLOSED, "customers") & ~vehicle.isin("yes", "permissive", "designated")
    loose = F.coalesce(tags["surface"], F.lit("")).isin(*[k for k, v in SURFACES.items() if v == 6])
    rough = F.coalesce(tags["smoothness"], F.lit("")).isin("very_bad", "horrible", "very_horrible", "impassable")
    of_class = F.coalesce(tags["highway"], F.lit("")).isin(*HIGHWAYS)
    return of_class & (F.coalesce(tags["area"], F.lit("")) != "yes") & ~vehicle.isin(*CLOSED) & ~blocked & ~loose & ~rough & (windows != 0)


def oneway_directions(tags: Column, highway: Column) -> Column:
    """struct(forward, backward): whether each direction may be driven."""
    round_ = F.coalesce(tags["junction"].isin("roundabout", "circular"), F.lit(False)) | highway.isin("motorway", "motorway_link")
    way = F.coalesce(tags["oneway:motor_vehicle"], tags["oneway"], F.when(round_, "yes"), F.lit(""))
    back, ahead = way.isin("-1", "reverse"), way.isin("yes", "true", "1")
    no_back = F.coalesce(tags["motor_vehicle:backward"] == "no", F.lit(False))
    no_ahead = F.coalesce(tags["motor_vehicle:forward"] == "no", F.lit(False))
    forward = F.when(back, False).when(ahead | no_back, True).otherwise(~no_ahead)
    return F.struct(forward.alias("forward"), F.when(back, True).when(ahead | no_back, False).otherwise(True).alias("backward"))


def population_score(population: Column) -> Column:
    low, high = 50.0, 30000.0
    return clip01((F.log10(F.greatest(population, F.lit(1.0))) - F.log10(F.lit(low))) / (F.log10(F.lit(high)) - F.log10(F.lit(low))))


def busyness(parts: dict[str, Column], weights: dict[str, float], country: Country) -> Column:
    """Weighted sum of the parts; a country without population data leaves it out and shares its weight."""
    used = {k: w for k, w in weights.items() if country.has_population or k != "population"}
    total = 1.0 if country.has_population else sum(used.values())
    return clip01(reduce(lambda a, b: a + b, [F.lit(w / total) * parts[k] for k, w in used.items()]))


def travel_seconds(length_m: Column, legal: Column, cruise: float = 0.85) -> Column:
    return length_m / F.greatest(legal / 3.6 * cruise, F.lit(2.0))


def routing_cost(length_m: Column, fun: Column, lam: float = 3.0, gamma: float = 2.0) -> Column:
    return length_m * F.pow(1 + lam * (1 - fun), F.lit(gamma))


def wrap180(angle: Column) -> Column:
    return F.abs(F.pmod(angle + 180, F.lit(360)) - 180)


def bearing(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() would take a null place for the other end of the earth
    return 2 * 6371.0 * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def chord_deviation_km(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a chord in a local metric (lon, lat; 111.195 km to a degree)."""
    k = 111.195
    scale = F.cos(F.radians((ay + by) / 2)) * k
    dx, dy = (bx - ax) * scale, (by - ay) * k
    qx, qy = (px - ax) * scale, (py - ay) * k
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (qx * dx + qy * dy) / length2))).otherwise(0.0)
    return F.hypot(qx - t * dx, qy - t * dy)


def boxes_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether boxes (west, south, east, north) meet."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def allowed_map_url(url: Column) -> Column:
    """Only https links to the map service's own hosts and path."""
    host, scheme, path = F.parse_url(url, F.lit("HOST")), F.parse_url(url, F.lit("PROTOCOL")), F.parse_url(url, F.lit("PATH"))
    return F.coalesce((scheme == "https") & host.isin("www.google.com", "google.com", "maps.google.com") & path.startswith("/maps"), F.lit(False))


def mask_labels(mask: Column, labels: tuple[str, ...]) -> Column:
    """Labels of the set bits, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << i) > 0, F.lit(x)) for i, x in enumerate(labels)])))


#: The register's surface codes of paved and of unpaved roads; all others say nothing certain.
REGISTER_PAVED = ("10", "12", "13", "14", "15", "16", "21", "22", "24", "27")
REGISTER_UNPAVED = ("31", "32", "41", "61")


def register_surface(code: Column) -> Column:
    """paved, unpaved or unknown by the register's surface code."""
    text = F.trim(code.cast("string"))
    return F.when(text.isin(*REGISTER_PAVED), "paved").when(text.isin(*REGISTER_UNPAVED), "unpaved").otherwise("unknown")


def collapse_repeats(values: Column) -> Column:
    """Without elements equal to the one before."""
    return F.filter(values, lambda x, i: (i == 0) | ~x.eqNullSafe(F.element_at(values, F.greatest(i, F.lit(1)))))


def ride_name(roads: Column, loop: Column) -> Column:
    return F.concat(F.array_join(collapse_repeats(roads), " → "), F.when(loop, " Loop").otherwise(" Ride"))


def traits(head_per_km: Column, flow: Column, engaged_per_km: Column, scenery: Column, quiet: Column, surface: Column) -> Column:
    return F.array_compact(F.array(
        F.when((head_per_km >= 70) & (flow >= 0.5), "flowing"), F.when(engaged_per_km >= 1.5, "technical"),
        F.when(scenery >= 0.7, "scenic"), F.when(quiet >= 0.7, "quiet"), F.when(surface >= 0.8, "smooth"),
    ))


def why(sweet: Column, head: Column, quiet: Column, climb: Column, scenery: Column, fallback: str = "A spirited circuit with a good rhythm") -> Column:
    """Up to three sentences for what passes its threshold, else the fallback."""
    said = F.array_compact(F.array(
        F.when(sweet >= 6, F.format_string("%d sweet-spot corners (30-150 m radius)", sweet)),
        F.when(head >= 120, F.format_string("Properly twisty: %d deg of turning per km", F.bround(head, 0).cast("int"))),
        F.when(quiet >= 70, "Modelled as usually quiet (static estimate, not live traffic)"),
        F.when(climb >= 150, F.format_string("+%d m of modelled climbing", climb)),
        F.when(scenery >= 70, "Forest, heath or dune scenery most of the way"),
    ))
    return F.when(F.size(said) == 0, F.array(F.lit(fallback))).otherwise(F.slice(said, 1, 3))


def content_id(ids: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the ids, packed as little-endian 64-bit numbers."""
    little = lambda x: F.concat(*[F.substring(F.lpad(F.hex(x), 16, "0"), i, 2) for i in range(15, 0, -2)])
    packed = F.unhex(F.array_join(F.transform(ids, little), ""))
    return F.substring(F.sha2(packed, 256), 1, 16)
