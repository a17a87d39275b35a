"""Pixel arithmetic on 8-bit channels as Column functions; integer steps round as 8-bit compositing does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def idiv(a, b) -> Column:
    """Division that truncates toward zero; null by zero."""
    b = _c(b)
    q = _c(a) / F.when(b != 0, b)
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("int")


def mul_un8(a, b) -> Column:
    """a * b / 255, rounded to nearest."""
    t = _c(a) * _c(b) + 128
    return F.shiftright(F.shiftright(t, 8) + t, 8)


def div_un8(a, b) -> Column:
    """a * 255 / b, rounded."""
    return idiv(_c(a) * 255 + F.shiftright(_c(b), 1), b)


def clamp(x, low=0, high=255) -> Column:
    return F.greatest(_c(low), F.least(_c(high), _c(x)))


def pack_rgba(r="r", g="g", b="b", a="a") -> Column:
    """BIGINT with red in the low byte and alpha in the high one."""
    r, g, b, a = (_c(x).cast("long") for x in (r, g, b, a))
    return r.bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(F.shiftleft(b, 16)).bitwiseOR(F.shiftleft(a, 24))


def unpack_rgba(c="c") -> list[Column]:
    return [F.shiftright(_c(c), s).bitwiseAND(F.lit(255)).cast("int").alias(n) for n, s in (("r", 0), ("g", 8), ("b", 16), ("a", 24))]


def pack_graya(v="v", a="a") -> Column:
    return _c(v).cast("long").bitwiseOR(F.shiftleft(_c(a).cast("long"), 8))


#: A tile's flags and the mask of its index.
TILE_X, TILE_Y, TILE_D, TILE_INDEX = 0x80000000, 0x40000000, 0x20000000, 0x1FFFFFFF


def pack_tile(index, x, y, d) -> Column:
    flag = lambda c, v: F.when(_c(c), F.lit(v)).otherwise(F.lit(0)).cast("long")
    return _c(index).cast("long").bitwiseAND(F.lit(TILE_INDEX)).bitwiseOR(flag(x, TILE_X)).bitwiseOR(flag(y, TILE_Y)).bitwiseOR(flag(d, TILE_D))


def luma(r="r", g="g", b="b") -> Column:
    return idiv(_c(r) * 2126 + _c(g) * 7152 + _c(b) * 722, 10000)


def scale_bits(x, bits: int) -> Column:
    """A value of 3, 5 or 6 bits spread over 8."""
    x = _c(x)
    if bits == 3:
        return F.shiftleft(x, 5).bitwiseOR(F.shiftleft(x, 2)).bitwiseOR(F.shiftright(x, 1))
    return F.shiftleft(x, 8 - bits).bitwiseOR(F.shiftright(x, 2 * bits - 8))


def linear(x) -> Column:
    """An sRGB channel as linear light, 0 to 1."""
    v = _c(x).cast("double") / 255
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def oklab(r="r", g="g", b="b") -> list[Column]:
    r, g, b = linear(r), linear(g), linear(b)
    # fixed values: the two matrices that define the colour space
    l, m, s = (F.cbrt(p * r + q * g + t * b) for p, q, t in ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005)))
    return [p * l + q * m + t * s for p, q, t in ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))]


def xyz(r="r", g="g", b="b") -> list[Column]:
    """CIE XYZ (D65), scaled so that white has Y = 100."""
    r, g, b = (linear(c) * 100 for c in (r, g, b))
    return [r * p + g * q + b * t for p, q, t in ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))]


def cielab(r="r", g="g", b="b") -> list[Column]:
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    x, y, z = (f(v / w) for v, w in zip(xyz(r, g, b), (95.047, 100.0, 108.883), strict=True))
    return [116 * y - 16, 500 * (x - y), 200 * (y - z)]


def hsv_max(r="r", g="g", b="b") -> Column:
    return F.greatest(_c(r), _c(g), _c(b))


def hsl_mid(r="r", g="g", b="b") -> Column:
    return idiv(F.greatest(_c(r), _c(g), _c(b)) + F.least(_c(r), _c(g), _c(b)), 2)


def hue_value_saturation(r="r", g="g", b="b") -> list[Column]:
    """Hue in degrees (0 for gray), value and saturation in 0..1."""
    r, g, b = (_c(c).cast("double") / 255 for c in (r, g, b))
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    d = F.when(most != least, most - least)
    hue = F.when(most == r, (g - b) / d).when(most == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    return [F.coalesce(F.when(hue < 0, hue + 360).otherwise(hue), F.lit(0.0)), most, F.when(most > 0, (most - least) / most).otherwise(0.0)]
