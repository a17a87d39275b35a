"""The blend modes of layered sprites as Column functions of a backdrop and a source channel.

Separable modes map (b, s) to a channel; ``blend_rgba`` then composes with alpha, the source's scaled by the opacity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spritespark.functions.color import _c, div_un8, idiv, mul_un8


def _screen(b: Column, s: Column) -> Column:
    return b + s - mul_un8(b, s)


def _hard(b: Column, s: Column) -> Column:
    return F.when(s < 128, mul_un8(b, s * 2)).otherwise(_screen(b, s * 2 - 255))


def _dodge(b: Column, s: Column) -> Column:
    return F.when(b == 0, 0).when(b >= 255 - s, 255).otherwise(div_un8(b, F.when(s < 255, 255 - s)))


def _burn(b: Column, s: Column) -> Column:
    return F.when(b == 255, 255).when(255 - b >= s, 0).otherwise(255 - div_un8(255 - b, F.when(s > 0, s)))


def _divide(b: Column, s: Column) -> Column:
    return F.when(b == 0, 0).when(b >= s, 255).otherwise(div_un8(b, F.when(s > 0, s)))


def _soft(b: Column, s: Column) -> Column:
    x, y = b / F.lit(255.0), s / F.lit(255.0)
    d = F.when(x <= 0.25, ((16 * x - 12) * x + 4) * x).otherwise(F.sqrt(x))
    out = F.when(y <= 0.5, x - (1 - 2 * y) * x * (1 - x)).otherwise(x + (2 * y - 1) * (d - x))
    return F.floor(out * 255 + 0.5).cast("int")


SEPARABLE: dict[str, Callable[[Column, Column], Column]] = {
    "normal": lambda b, s: s,
    "multiply": mul_un8,
    "screen": _screen,
    "overlay": lambda b, s: _hard(s, b),
    "darken": lambda b, s: F.least(b, s),
    "lighten": lambda b, s: F.greatest(b, s),
    "color_dodge": _dodge,
    "color_burn": _burn,
    "hard_light": _hard,
    "soft_light": _soft,
    "difference": lambda b, s: F.abs(b - s),
    "exclusion": lambda b, s: b + s - 2 * mul_un8(b, s),
    "addition": lambda b, s: F.least(b + s, F.lit(255)),
    "subtract": lambda b, s: F.greatest(b - s, F.lit(0)),
    "divide": _divide,
}
#: The modes that work on all channels at once.
HSL = ("hue", "saturation", "color", "luminosity")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value being computed once: without it, the nested colour formulas would repeat their inputs many times."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def _each(c: Column) -> tuple[Column, Column, Column]:
    return c["r"], c["g"], c["b"]


def _lum(c: Column) -> Column:
    return 0.3 * c["r"] + 0.59 * c["g"] + 0.11 * c["b"]


def _sat(c: Column) -> Column:
    return F.greatest(*_each(c)) - F.least(*_each(c))


def _clip(c: Column) -> Column:
    """Channels drawn toward the luminosity until all lie in 0..1."""

    def low(c: Column) -> Column:
        l, n = _lum(c), F.least(*_each(c))
        return _rgb(*(F.when(n < 0, l + (v - l) * l / F.when(l != n, l - n)).otherwise(v) for v in _each(c)))

    def high(c: Column) -> Column:
        l, x = _lum(c), F.greatest(*_each(c))
        return _rgb(*(F.when(x > 1, l + (v - l) * (1 - l) / F.when(x != l, x - l)).otherwise(v) for v in _each(c)))

    return let(let(c, low), high)


def _set_lum(c: Column, to: Column) -> Column:
    return _clip(let(F.struct(c.alias("c"), (to - _lum(c)).alias("d")), lambda s: _rgb(*(v + s["d"] for v in _each(s["c"])))))


def _set_sat(c: Column, to: Column) -> Column:
    span = _sat(c)
    return _rgb(*(F.when(span > 0, (v - F.least(*_each(c))) * to / F.when(span > 0, span)).otherwise(0.0) for v in _each(c)))


def hsl_mode(mode: str, backdrop: list, source: list) -> list[Column]:
    """hue, saturation, color or luminosity: channels of 0 to 255."""
    both = F.struct(_rgb(*(_c(x) / F.lit(255.0) for x in backdrop)).alias("b"), _rgb(*(_c(x) / F.lit(255.0) for x in source)).alias("s"))
    made = {
        "hue": lambda v: let(F.struct(_set_sat(v["s"], _sat(v["b"])).alias("c"), v["b"].alias("b")), lambda w: _set_lum(w["c"], _lum(w["b"]))),
        "saturation": lambda v: let(F.struct(_set_sat(v["b"], _sat(v["s"])).alias("c"), v["b"].alias("b")), lambda w: _set_lum(w["c"], _lum(w["b"]))),
        "color": lambda v: _set_lum(v["s"], _lum(v["b"])),
        "luminosity": lambda v: _set_lum(v["b"], _lum(v["s"])),
    }[mode]
    out = let(both, made)
    return [F.floor(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) + 1e-9).cast("int") for v in _each(out)]


def over(backdrop: list, source: list, opacity=255) -> list[Column]:
    """The source over the backdrop: both r, g, b, a; opacity 0 to 255."""
    (br, bg, bb, ba), (sr, sg, sb, sa) = ([_c(x) for x in c] for c in (backdrop, source))
    sa = mul_un8(sa, opacity)
    ra = sa + ba - mul_un8(ba, sa)
    mix = [b + idiv((s - b) * sa, F.when(ra > 0, ra)) for b, s in ((br, sr), (bg, sg), (bb, sb))]
    out = [F.when(ba == 0, s).when(sa == 0, b).otherwise(m) for b, s, m in zip((br, bg, bb), (sr, sg, sb), mix, strict=True)]
    return [*out, F.when(ba == 0, sa).when(sa == 0, ba).otherwise(ra)]


def blend_rgba(mode: str, backdrop: list, source: list, opacity=255) -> list[Column]:
    """The source blended into the backdrop, then composed over it; where the backdrop is transparent, the source itself."""
    b, s = [_c(x) for x in backdrop], [_c(x) for x in source]
    mixed = hsl_mode(mode, b[:3], s[:3]) if mode not in SEPARABLE else [SEPARABLE[mode](x, y) for x, y in zip(b[:3], s[:3], strict=True)]
    return over(b, [*(F.when(b[3] == 0, y).otherwise(m) for y, m in zip(s[:3], mixed, strict=True)), s[3]], opacity)


def destination_over(backdrop: list, source: list, opacity=255) -> list[Column]:
    """The source behind the backdrop."""
    s = [_c(x) for x in source]
    return over([*s[:3], mul_un8(s[3], opacity)], backdrop)
