"""Column expressions for heights, distance fields, names, tags, angles and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grey levels of the lowest and highest building, their heights in metres, metres a floor.
GREY_LOW, GREY_HIGH, METRES_LOW, METRES_HIGH, FLOOR = 100, 255, 4.0, 100.0, 3.0
#: Fixed values of feature conversion: metres of a building without tags, of a level, of a foot.
DEFAULT_HEIGHT, LEVEL, FOOT = 7.0, 3.0, 0.3048


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def grey_to_metres(grey: Column) -> Column:
    share = (grey - GREY_LOW) / float(GREY_HIGH - GREY_LOW)
    return METRES_LOW + clamp(share, 0.0, 1.0) * (METRES_HIGH - METRES_LOW)


def metres_to_grey(metres: Column) -> Column:
    """Half to even, as numpy rounds."""
    share = (metres - METRES_LOW) / (METRES_HIGH - METRES_LOW)
    return F.rint(GREY_LOW + clamp(share, 0.0, 1.0) * (GREY_HIGH - GREY_LOW)).cast("int")


def sdf_to_byte(distance: Column, reach: float = 8.0) -> Column:
    """A signed distance in pixels as a byte; inside is 128 and above."""
    return clamp(F.rint(128.0 + distance / reach * 127.0), 0.0, 255.0).cast("int")


def sdf_to_quarter(distance: Column, reach: float = 31.0) -> Column:
    return F.rint(clamp(distance, -reach, reach) * 4.0).cast("int")


def byte_to_field(byte: Column) -> Column:
    return byte / 127.5 - 1.0


def field_to_byte(field: Column) -> Column:
    return clamp(F.rint((field + 1.0) * 127.5), 0.0, 255.0).cast("int")


def signed_byte(byte: Column) -> Column:
    """A byte read as signed."""
    return F.when(byte > 127, byte - 256).otherwise(byte)


def angle_difference(a: Column, b: Column, period: Column) -> Column:
    """a - b taken to the nearest turn, half to even."""
    d = a - b
    return d - F.rint(d / period) * period


#: Fixed patterns: how tile files are named, and the first number of a text.
TILE_NAME = r"(?i)^(.+)_([0-9]+)[.]png$"
NUMBER = r"[-+]?[0-9]*[.]?[0-9]+"


def tile_city(name: Column) -> Column:
    found = F.regexp_extract(name, TILE_NAME, 1)
    return F.when(found != "", found)


def tile_index(name: Column) -> Column:
    return F.regexp_extract(name, TILE_NAME, 2).try_cast("int")


def first_number(text: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(text, ",", "."), NUMBER, 0).try_cast("double")


def _tag_metres(text: Column) -> Column:
    n = first_number(text)
    feet = F.contains(text, F.lit("ft")) | F.contains(text, F.lit("'"))
    metres = F.when(feet, n * FOOT).otherwise(n)
    return F.when(metres > 0, metres)


def parse_height(height: Column, levels: Column, other: Column | None = None) -> Column:
    """Metres of a building from its tags: a height above zero (or the other height tag's), feet if marked, else
    levels, else the default."""
    floors = first_number(levels)
    found = [_tag_metres(height), *([] if other is None else [_tag_metres(other)])]
    return F.coalesce(*found, F.when(floors > 0, floors * LEVEL), F.lit(DEFAULT_HEIGHT))


def slug(text: Column) -> Column:
    """Letters, digits, dots, dashes and underscores; other runs become one dash, none at the ends."""
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), F.lit("-"))


def names_agree(a: Column, b: Column, letters: int = 5) -> Column:
    """Whether one name holds the first letters of the other, spaces, dashes and case aside."""
    x, y = [F.regexp_replace(F.lower(n), "[ _-]", "") for n in (a, b)]
    return F.contains(x, F.left(y, F.lit(letters))) | F.contains(y, F.left(x, F.lit(letters)))


def stub_index(parameters_json: Column, n: int) -> Column:
    """A number from 0 to n - 1 that depends on the parameters only."""
    return (F.conv(F.substring(F.md5(parameters_json), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def metres_per_degree(latitude: Column) -> tuple[Column, Column]:
    """Of latitude and of longitude."""
    return F.lit(111320.0), 111320.0 * F.cos(F.radians(latitude))


def sunset_angle(latitude: Column, declination: Column) -> Column:
    """Hour angle of sunset in radians; 0 in polar night, pi under the midnight sun."""
    x = -F.tan(F.radians(latitude)) * F.tan(F.radians(declination))
    return F.when(x >= 1, 0.0).when(x <= -1, math.pi).otherwise(F.acos(clamp(x, -1.0, 1.0)))


def day_length(latitude: Column, declination: Column) -> Column:
    return 2 * sunset_angle(latitude, declination) * 12 / math.pi


def hann(i: Column, n: int) -> Column:
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / (n - 1))
