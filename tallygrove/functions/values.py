"""Reading values: strict numbers and dates, rounding, periods, folded text, coordinates. Column expressions throughout."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
EARTH_KM, EARTH_AREA_M = 6371.0088, 6371008.8  # fixed values: mean radius for distances and for areas
LINEAR, CYCLIC = ("hour", "day", "week", "week_sunday", "month"), {"weekday": 7, "month_of_year": 12}


def number(text: Column) -> Column:
    """A finite double from text or a number; blank, other text, NaN and infinity are null. A column of numbers isn't read as text: its
    type is known when the plan is made, which leaves one of the two ways."""
    t = F.trim(text.cast("string"))
    kind = F.typeof(text)
    x = F.when(kind.isin("double", "float", "int", "bigint", "smallint", "tinyint") | kind.startswith("decimal"), text.try_cast("double")).otherwise(F.when(t.rlike(NUMBER), t.try_cast("double")))
    return F.when(F.abs(x) < float("inf"), x)


def day(text: Column) -> Column:
    """A date from ``YYYY-MM-DD`` that the calendar has; else null."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date"))


def minute(text: Column) -> Column:
    """A timestamp without zone from ``YYYY-MM-DD[T ]HH:MM[:SS]``; else null."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?$"), F.translate(t, "T", " ").try_cast("timestamp_ntz"))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded, halves towards plus infinity."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


@cache
def _compatible_pairs() -> tuple[str, str]:
    """Characters of the basic plane whose compatibility form is one other character (wide letters, styled digits and so on), and those forms."""
    pairs = [(chr(c), n) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def compatible(c: Column) -> Column:
    """Text with compatibility characters as plain ones, in the JVM; characters that stand for several, and marks that combine, stay."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, *_compatible_pairs())).otherwise(c)


def folded(c: Column) -> Column:
    """Text for a tolerant comparison: compatibility characters as plain ones, lower case, runs of anything but letters and digits as
    one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(compatible(c.cast("string"))), r"[^\p{L}\p{N}]+", " "))


#: Forms of a written date: the pattern of its parts and their order.
DATE_FORMS = {"month/day": (r"^(\d{1,2})/(\d{1,2})$", "md"), "day/month": (r"^(\d{1,2})/(\d{1,2})$", "dm"), "month/day/year": (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "mdy"), "day/month/year": (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "dmy"), "year-month-day": (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "ymd")}


def written_datetime(date: Column, form: str, year: int | None = None, time: Column | None = None, clock: str = "24-hour") -> Column:
    """A timestamp without zone from a date in a declared form (the year given where the form has none) and a time on a declared clock;
    null where either can't be read as declared. A two-digit year isn't read."""
    pattern, order = DATE_FORMS[form]
    d = F.trim(date.cast("string"))
    part = {k: F.regexp_extract(d, pattern, i + 1).try_cast("int") for i, k in enumerate(order)}
    y = part.get("y", F.lit(year).cast("int"))
    whole = F.format_string("%04d-%02d-%02d", y, part["m"], part["d"])
    at = F.when(d.rlike(pattern) & y.isNotNull(), whole)
    if time is None:
        return at.try_cast("timestamp_ntz")
    t = F.trim(time.cast("string"))
    # hour, colon, two digits of minutes and, on a clock of twelve hours, the half of the day with or without points
    half_day = "" if clock == "24-hour" else r"[ \t]*(?i:(a|p)[.]?[ \t]*m[.]?)"
    written = rf"\A([0-9]|[0-9][0-9]):([0-9][0-9]){half_day}\z"
    hour, minutes = (F.regexp_extract(t, written, i) for i in (1, 2))
    half = F.regexp_extract(t, written, 3) if half_day else F.lit("")
    hour, minutes = hour.try_cast("int"), minutes.try_cast("int")
    fits = t.rlike(written) & (minutes <= 59) & (hour.between(1, 12) if clock == "12-hour" else hour <= 23)
    if clock == "12-hour":
        hour = hour % 12 + F.when(F.lower(half) == "p", 12).otherwise(0)
    return F.when(fits, F.concat(at, F.format_string(" %02d:%02d:00", hour, minutes))).try_cast("timestamp_ntz")


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north of the great circle from the first place to the second, 0 to below 360."""
    p, q, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(turn) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(turn))), F.lit(360.0))


def period(date: Column, unit: str) -> Column:
    """The period of a date or timestamp: its first day or hour, or 1 to 7 (Monday first), or 1 to 12."""
    if unit == "hour":
        return F.date_trunc("hour", date).cast("timestamp_ntz")
    if unit == "day":
        return date.cast("date")
    if unit in ("week", "month"):
        return F.trunc(date.cast("date"), unit)
    if unit == "week_sunday":
        d = date.cast("date")
        return F.date_sub(d, F.dayofweek(d) - 1)
    if unit == "weekday":
        return F.weekday(date) + 1
    if unit == "month_of_year":
        return F.month(date)
    raise ValueError(f"no such period: {unit}")


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two strings, 0 to 1, with the common-prefix bonus above 0.7."""
    if a == b:
        return 1.0 if a else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, hits = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                hits.append(c)
                break
    if not hits:
        return 0.0
    swapped = sum(x != y for x, y in zip(hits, (c for c, f in zip(b, free, strict=True) if not f), strict=True)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _similarities(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def name_similarity(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity in Arrow batches."""
    _similarities.__annotations__ = {"pairs": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(_similarities, "double")(a, b)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def coordinate(text: Column) -> Column:
    """Decimal degrees, or degrees, minutes and seconds with a hemisphere letter; else null."""
    t = F.upper(F.trim(text.cast("string")))
    plain = number(F.regexp_replace(t, "[NSEW°]", ""))
    part = lambda i: F.coalesce(F.regexp_extract(t, r"^(\d+)[°\s]+(\d+)['′\s]+([\d.]+)?[\"″\s]*[NSEW]?$", i).try_cast("double"), F.lit(0.0))
    dms = F.when(t.rlike(r"^\d+[°\s]+\d+['′\s]+([\d.]+)?[\"″\s]*[NSEW]?$"), part(1) + part(2) / 60 + part(3) / 3600)
    return F.coalesce(plain, dms) * F.when(t.rlike("[SW]$"), F.lit(-1.0)).otherwise(F.lit(1.0))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


# WGS84 and the third-order Krueger series of its transverse Mercator projection
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres (false northing in the south)."""
    k = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    d = F.radians(lon - (zone * 6 - 183))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * _RADIUS * east, F.when(lat < 0, F.lit(1e7)).otherwise(F.lit(0.0)) + 0.9996 * _RADIUS * north


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude of UTM metres."""
    xi = (north - F.when(south, F.lit(1e7)).otherwise(F.lit(0.0))) / (0.9996 * _RADIUS)
    eta = (east - 500000) / (0.9996 * _RADIUS)
    x, e = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(e), F.cos(x))), F.degrees(lat)
