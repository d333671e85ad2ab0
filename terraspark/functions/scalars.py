"""Column functions of the map algebra. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 4294967295


def clip(v: Column, lo, hi) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def rint(v: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.rint(v)


def truncate(v: Column) -> Column:
    """Toward zero."""
    return v.cast("int")


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def linspace(a: Column, b: Column, steps: Column, i: Column) -> Column:
    """The i-th of ``steps`` + 1 points from a to b."""
    return a + (b - a) * i / steps


def rescale(v: Column, s0: float, s1: float, d0: float, d1: float) -> Column:
    """From one range to another, kept inside it."""
    lo, hi = min(d0, d1), max(d0, d1)
    return clip(d0 + (v - s0) * ((d1 - d0) / (s1 - s0)), lo, hi)


def smoothstep(lo: float, hi: float, v: Column) -> Column:
    t = clip((v - lo) / (hi - lo), 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def scale_byte(v: Column, factor: Column) -> Column:
    return clip(F.rint(v * clip(factor, 0.0, 1.0)), 0.0, 255.0).cast("int")


def mul32(a: Column, constant: int) -> Column:
    """a * constant modulo 2**32 without leaving BIGINT."""
    low = a.bitwiseAND(65535) * F.lit(constant)
    high = (F.shiftright(a, 16) * F.lit(constant)).bitwiseAND(65535)
    return (low.bitwiseAND(MASK) + F.shiftleft(high, 16)).bitwiseAND(MASK)


def cell_hash(x: Column, z: Column) -> Column:
    """A 32-bit hash of a world cell, 0 to 2**32 - 1."""
    # fixed values of the hash: two factors for the axes, two for mixing
    n = mul32(x.cast("long").bitwiseAND(MASK), 0x9E3779B1).bitwiseXOR(mul32(z.cast("long").bitwiseAND(MASK), 0x85EBCA77))
    n = n.bitwiseXOR(F.shiftright(n, 16))
    n = mul32(n, 0x7FEB352D)
    n = n.bitwiseXOR(F.shiftright(n, 15))
    n = mul32(n, 0x846CA68B)
    return n.bitwiseXOR(F.shiftright(n, 16))


def roll(x: Column, z: Column, salt: int = 0) -> Column:
    """A number in [0, 1) for a cell."""
    return cell_hash(x + salt * 8191, z) / 4294967296.0


def tile_key(x: Column, z: Column) -> Column:
    return F.shiftleft(x.cast("long"), 32).bitwiseOR(z.cast("long").bitwiseAND(MASK))


def tile_x(key: Column) -> Column:
    return F.shiftright(key, 32).cast("int")


def tile_z(key: Column) -> Column:
    low = key.bitwiseAND(MASK)
    return F.when(low >= 2147483648, low - 4294967296).otherwise(low).cast("int")


def flat_row(pixel: Column, cols: int) -> Column:
    return F.floor(pixel / cols).cast("int")


def flat_col(pixel: Column, cols: int) -> Column:
    return F.pmod(pixel, F.lit(cols)).cast("int")


def month_position(year_fraction: Column) -> Column:
    """Position between month middles, in [0, 12): cyclic."""
    return F.pmod(year_fraction * 12 - 0.5, F.lit(12.0))


def month_blend(months: Column, position: Column) -> Column:
    """Between the month before and after a position; December meets January."""
    i = F.floor(position).cast("int")
    t = position - i
    return F.get(months, i) * (1 - t) + F.get(months, F.pmod(i + 1, F.lit(12))) * t


def annual_mean(tenths: Column) -> Column:
    return F.aggregate(tenths, F.lit(0.0), lambda a, v: a + v) / 120.0


def warmest(tenths: Column) -> Column:
    return F.array_max(tenths) * 0.1


def wetness(p: Column, pet: Column) -> Column:
    return F.least(p / (p + F.greatest(pet, F.lit(1.0))), F.least(F.lit(1.0), p / 200.0))


def rain_factor(p: Column) -> Column:
    return p / (p + 800.0)


def world_y(encoded: Column, height: int) -> Column:
    """A byte height stretched over a world of ``height`` blocks."""
    return F.floor((encoded.cast("long") * (height - 1) + 127) / 255).cast("int")


def terrain_temperature(annual: Column, lapse: Column, y: Column, ref_y: Column, height: int) -> Column:
    return annual + lapse * (y * 255.0 / (height - 1) - ref_y)


def cyclic_distance(a: float, b: Column, period: float) -> Column:
    """b - a on a circle, in [-period/2, period/2)."""
    return F.pmod(b - a + period / 2, F.lit(period)) - period / 2


def instant_temperature(monthly: Column, lapse: Column, y: Column, ref_y: Column, hour: Column, rain: Column, height: int, yearly_noise: Column, daily_noise: Column) -> Column:
    """Monthly value with altitude, time of day and noise; the noise is an input."""
    day = smoothstep(0.0, 1.0, F.abs(cyclic_distance(4.0, hour, 24.0) / 12.0)) - 0.5
    return monthly + lapse * (255.0 * y / (height - 1) - ref_y) + day * (18.0 - 13.0 * rain) + 3.0 * yearly_noise + daily_noise


def snow_rate(temperature: Column, rain: Column) -> Column:
    """Hourly change of snow: melts when warm or dry above freezing, else falls with the rain."""
    return F.when((temperature > 1.5) | ((rain < 0.05) & (temperature > 0)), -temperature / 15.0).otherwise(rain / 3.0)


def pack_climate(temperature_byte: Column, wet: Column) -> Column:
    return F.shiftleft(temperature_byte.cast("int"), 16).bitwiseOR(F.shiftleft(F.rint(wet * 255).cast("int"), 8))


def pack_colour(temperature_byte: Column, rain_byte: Column, season: Column, frosted: Column) -> Column:
    """Bytes of temperature, rain and season index in one word, with a flag bit on top of them."""
    word = temperature_byte.cast("int").bitwiseOR(F.shiftleft(rain_byte.cast("int"), 8)).bitwiseOR(F.shiftleft(season.cast("int"), 16))
    return word.bitwiseOR(F.when(frosted, F.lit(1 << 24)).otherwise(0))


def unpack_bits(word: Column, shift: int, bits: int) -> Column:
    return F.shiftright(word, shift).bitwiseAND((1 << bits) - 1)


def river_width(flow: Column, px: float, narrow: float = 3.0, wide: float = 5.4, reference: float = 8.0) -> Column:
    """Width in metres from discharge; missing or non-positive discharge has the least width."""
    w = F.least(F.lit(wide * px), narrow * px + px * F.sqrt(flow / reference))
    return F.when(flow.isNull() | F.isnan(flow) | (flow <= 0), F.lit(narrow * px)).otherwise(w)


def bathymetry(e: Column, deepest: Column, sea: int = 60, low: int = 50, step: float = -100.0, mid: int = 55, piecewise: bool = True) -> Column:
    """Ocean depth below zero to a byte, linear or with a knee at ``step`` metres; land gives 0."""
    if not 1 <= low < sea < 255 or piecewise and not low <= mid <= sea:
        raise ValueError("depth levels must ascend: 1 <= low <= mid <= sea < 255")
    if piecewise:
        shallow = mid + (e - step) / (0.0 - step) * (sea - mid)
        deep = F.when(F.abs(step - deepest) < 1e-9, F.lit(float(low))).otherwise(low + (e - deepest) / (step - deepest) * (mid - low))
        y = F.when(e > step, shallow).otherwise(deep)
    else:
        y = (e + F.abs(deepest)) / F.abs(deepest) * (sea - low) + low
    return F.when(e < 0, truncate(clip(y, 0.0, 255.0))).otherwise(0)


def terrain_byte(e: Column, peak: Column, sea: int = 60) -> Column:
    """Metres to a height byte: float product, halves to even; null or nodata gives 0."""
    scale = F.when(peak > 0, (255.0 - sea) / peak).otherwise(0.0).cast("float")
    y = clip(sea + F.rint((e.cast("float") * scale).cast("double")), 1.0, 255.0).cast("int")
    return F.when(e.isNull() | (e <= -32768) | F.isnan(e.cast("double")), 0).otherwise(y)


def bake_height(height: Column, land: Column) -> Column:
    return F.when(land > 0, F.greatest(height, F.lit(1))).otherwise(0)


def bake_bathymetry(bathy: Column, land: Column, sea: int = 60, low: int = 50) -> Column:
    return F.when((land == 0) & (bathy > 0), clip(bathy, low, sea)).otherwise(sea)


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    d = c.cast("double")
    return c.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))


def saline(klass: Column, name: Column, names: list[str]) -> Column:
    """Lakes of the alkaline class, and those of a list of names."""
    return F.coalesce((klass == "Alkaline Lake") | name.isin(names), klass == "Alkaline Lake", F.lit(False))


def first_suitable(options: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first option whose condition holds and that has a value."""
    return F.coalesce(*(F.when(ok, value) for ok, value in options), otherwise)


def rain_override(rain: Column, annual: Column, inside: Column) -> tuple[Column, Column]:
    """The rain that the weather sees inside the map, and what is put back after it."""
    return F.when(inside & annual.isNotNull(), rain_factor(annual)).otherwise(rain), rain


def region_centre(region: Column, size: int = 512) -> Column:
    return region * size + size // 2
