"""Web Mercator tiles, distances and directions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
EQUATOR_M_PER_PX = 156543.03392
EAST_M, NORTH_M = 111_320.0, 110_540.0
#: Names of the eight directions, clockwise from north.
COMPASS = ("north", "north-east", "east", "south-east", "south", "south-west", "west", "north-west")


def lon_to_tx(lon: Column, z: Column | int) -> Column:
    return (lon + 180.0) / 360.0 * F.pow(F.lit(2.0), F.lit(z) if isinstance(z, int) else z)


def lat_to_ty(lat: Column, z: Column | int) -> Column:
    a = F.radians(lat)
    return (1.0 - F.ln(F.tan(a) + 1.0 / F.cos(a)) / F.pi()) / 2.0 * F.pow(F.lit(2.0), F.lit(z) if isinstance(z, int) else z)


def tx_to_lon(tx: Column, z: int) -> Column:
    return tx / float(2**z) * 360.0 - 180.0


def ty_to_lat(ty: Column, z: int) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1.0 - ty * 2.0 / float(2**z)))))


def lonlat_to_pixel(lon: Column, lat: Column, z: int, tile_px: int = 256) -> Column:
    return F.struct((lon_to_tx(lon, z) * tile_px).alias("px"), (lat_to_ty(lat, z) * tile_px).alias("py"))


def pixel_to_lonlat(px: Column, py: Column, z: int, tile_px: int = 256) -> Column:
    return F.struct(tx_to_lon(px / tile_px, z).alias("lon"), ty_to_lat(py / tile_px, z).alias("lat"))


def metres_per_pixel(lat: Column, z: int, tile_px: int = 256) -> Column:
    return F.cos(F.radians(lat)) * (EQUATOR_M_PER_PX / 2**z * 256 / tile_px)


def tile_bounds(x: Column, y: Column, z: int) -> Column:
    return F.struct(
        ty_to_lat(y, z).alias("north"), ty_to_lat(y + 1, z).alias("south"), tx_to_lon(x, z).alias("west"), tx_to_lon(x + 1, z).alias("east")
    )


def tile_centre(x: Column, y: Column, z: int) -> Column:
    return F.struct(ty_to_lat(y + 0.5, z).alias("lat"), tx_to_lon(x + 0.5, z).alias("lon"))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres; the sine's argument is kept within [0, 1]."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2.0), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2.0 * EARTH_M) * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def polyline_length_m(points: Column) -> Column:
    """Metres along an array of ``(lon, lat)`` structs; fewer than two give 0."""
    steps = F.zip_with(
        F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))),
        lambda a, b: haversine_m(a["lon"], a["lat"], b["lon"], b["lat"]),
    )
    return F.when(F.size(points) < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x))


def local_xy(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """Metres east and north of ``(lon0, lat0)``."""
    return F.struct(((lon - lon0) * EAST_M * F.cos(F.radians(lat0))).alias("x"), ((lat - lat0) * NORTH_M).alias("y"))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2((lon2 - lon1) * F.cos(F.radians(lat1)), lat2 - lat1)), F.lit(360.0))


def compass(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    sector = F.floor((bearing(lon1, lat1, lon2, lat2) + 22.5) / 45.0).cast("int") % 8
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), sector + 1)


def grid_cell(lon: Column, lat: Column, box: dict, rows: int, cols: int | None = None) -> Column:
    """Row-major cell of a point in a box, clamped to the edge cells."""
    cols = cols or rows
    col = ((lon - box["west"]) / ((box["east"] - box["west"]) / cols)).cast("int")
    row = ((lat - box["south"]) / ((box["north"] - box["south"]) / rows)).cast("int")
    inside = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    return inside(row, rows) * cols + inside(col, cols)


def parse_box(text: Column) -> Column:
    """'north,south,east,west' as a struct; bad numbers are null."""
    part = F.split(text, ",")
    return F.struct(*[F.try_element_at(part, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(("north", "south", "east", "west"))])


def ring(lon: Column, lat: Column, radius_m: float, steps: int = 64) -> Column:
    """A closed circle of ``steps + 1`` points."""
    turn = lambda k: k * (2.0 * 3.141592653589793 / steps)
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda k: F.struct(
            (lon + F.cos(turn(k)) * radius_m / EAST_M / F.cos(F.radians(lat))).alias("lon"), (lat + F.sin(turn(k)) * radius_m / NORTH_M).alias("lat")
        ),
    )


def tile_range(box: dict, z: int) -> tuple[int, int, int, int]:
    """First and last tile columns and rows that cover a box."""
    import math

    tx = lambda lon: math.floor((lon + 180.0) / 360.0 * 2**z)
    ty = lambda lat: math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 2**z)
    return tx(box["west"]), tx(box["east"]), ty(box["north"]), ty(box["south"])
