"""Colour spaces: to RGB in Python for the interpreter, and as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.sources.syntax import Fault, Name, Stream

# Lab to sRGB.
_XYZ_TO_RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
_WHITE = (0.9505, 1.0, 1.089)


@dataclass
class Space:
    """n components, the initial ones, and their way to (r, g, b) in 0..1."""

    family: str
    n: int
    initial: tuple
    to_rgb: Callable[[list[float]], tuple]

    def rgb(self, components: list[float]) -> tuple:
        given = [float(c) for c in components[: self.n]] if self.n else components
        return self.to_rgb(given + [0.0] * (self.n - len(given)))


def _cmyk(c: list[float]) -> tuple:
    return tuple((1 - v) * (1 - c[3]) for v in c[:3])


GRAY = Space("DeviceGray", 1, (0.0,), lambda c: (c[0],) * 3)
RGB = Space("DeviceRGB", 3, (0.0, 0.0, 0.0), lambda c: tuple(c[:3]))
CMYK = Space("DeviceCMYK", 4, (0.0, 0.0, 0.0, 1.0), _cmyk)
_BY_NAME = {"DeviceGray": GRAY, "G": GRAY, "CalGray": GRAY, "DeviceRGB": RGB, "RGB": RGB, "CalRGB": RGB, "DeviceCMYK": CMYK, "CMYK": CMYK}
_BY_SIZE = {1: GRAY, 3: RGB, 4: CMYK}


def _unit(v: float) -> float:
    return min(max(v, 0.0), 1.0)


def lab_to_rgb(lightness: float, a: float, b: float, white=_WHITE) -> tuple:
    m = (lightness + 16) / 116
    bend = lambda t: t**3 if t >= 6 / 29 else 108 / 841 * (t - 4 / 29)
    x, y, z = white[0] * bend(m + a / 500), white[1] * bend(m), white[2] * bend(m - b / 200)
    linear = [p * x + q * y + r * z for p, q, r in _XYZ_TO_RGB]
    return tuple(_unit(12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055) for v in linear)


def space_of(document, value, depth: int = 0) -> Space:
    """A space from its name or array; DeviceGray for what isn't known."""
    value = document.resolve(value)
    if isinstance(value, Name):
        return Space("Pattern", 0, (), lambda c: (0.0, 0.0, 0.0)) if value == "Pattern" else _BY_NAME.get(value, GRAY)
    if not isinstance(value, list) or not value or depth > 8:
        return GRAY
    family, rest = document.resolve(value[0]), value[1:]
    if family in _BY_NAME:
        return _BY_NAME[family]
    inner = lambda v: space_of(document, v, depth + 1)
    if family == "Lab":
        white = [document.number(x) or 0.0 for x in document.array(document.dictionary(rest[0] if rest else None).get("WhitePoint"))]
        return Space("Lab", 3, (0.0, 0.0, 0.0), lambda c: lab_to_rgb(*c[:3], white=white if len(white) == 3 else _WHITE))
    if family == "ICCBased":
        entries = document.dictionary(rest[0] if rest else None)
        size = int(document.number(entries.get("N")) or 3)
        base = inner(entries["Alternate"]) if "Alternate" in entries else _BY_SIZE.get(size, GRAY)
        return Space("ICCBased", size, base.initial, base.rgb)
    if family in ("Indexed", "I") and len(rest) >= 3:
        base, top, table = inner(rest[0]), int(document.number(rest[1]) or 0), document.resolve(rest[2])
        try:
            data = document.decoded(table) if isinstance(table, Stream) else table if isinstance(table, bytes) else b""
        except Fault:
            data = b""

        def look(c):
            i = min(max(int(c[0] + 0.5), 0), top) * base.n
            return base.rgb([v / 255 for v in data[i : i + base.n]])

        return Space("Indexed", 1, (0.0,), look)
    if family in ("Separation", "DeviceN") and len(rest) >= 3:
        from sheaf.functions.numeric import function_of

        names = document.resolve(rest[0])
        base, n = inner(rest[1]), len(names) if isinstance(names, list) else 1
        try:
            tint = function_of(document, rest[2])
        except Fault:
            return Space(str(family), n, (1.0,) * n, lambda c: (0.0, 0.0, 0.0))
        return Space(str(family), n, (1.0,) * n, lambda c: base.rgb(tint(c)))
    if family == "Pattern":
        base = inner(rest[0]) if rest else None
        return Space("Pattern", base.n if base else 0, (), lambda c: base.rgb(c) if base else (0.0, 0.0, 0.0))
    return GRAY


def gray_of(rgb: tuple) -> float:
    return 0.3 * rgb[0] + 0.59 * rgb[1] + 0.11 * rgb[2]


def shading_color(document, value, t: float) -> tuple:
    """The colour at t of a shading of one parameter: t is clipped to the domain, then goes through the function."""
    from sheaf.functions.numeric import clip, function_of

    entries = document.dictionary(value)
    domain = [document.number(v) or 0.0 for v in document.array(entries.get("Domain"))] or [0.0, 1.0]
    if "Function" not in entries:
        raise Fault("unsupportedFeature", "a shading without a function")
    return space_of(document, entries.get("ColorSpace")).rgb(function_of(document, entries["Function"])([clip(t, *domain[:2])]))


def pattern_of(document, value) -> dict:
    """Kind, box, steps, matrix and paint type of a tiling pattern, or the shading's type."""
    entries = document.dictionary(value)
    matrix = [document.number(v) for v in document.array(entries.get("Matrix"))]
    out = {"matrix": tuple(matrix) if len(matrix) == 6 and None not in matrix else (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)}
    kind = document.resolve(entries.get("PatternType"))
    if kind == 1:
        return out | {"kind": "tiling", "box": document.rectangle(entries.get("BBox")), "x_step": document.number(entries.get("XStep")) or 0.0, "y_step": document.number(entries.get("YStep")) or 0.0, "paint": document.resolve(entries.get("PaintType"))}
    if kind == 2:
        return out | {"kind": "shading", "type": document.resolve(document.dictionary(entries.get("Shading")).get("ShadingType"))}
    raise Fault("unsupportedFeature", f"pattern type {kind}")


# -- on columns ---------------------------------------------------------------------------------------


def gray_rgb(g: Column) -> Column:
    return F.struct(g.alias("r"), g.alias("g"), g.alias("b"))


def cmyk_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.struct(((1 - c) * (1 - k)).alias("r"), ((1 - m) * (1 - k)).alias("g"), ((1 - y) * (1 - k)).alias("b"))


def rgb_gray(r: Column, g: Column, b: Column) -> Column:
    return 0.3 * r + 0.59 * g + 0.11 * b


def lab_rgb(lightness: Column, a: Column, b: Column) -> Column:
    m = (lightness + 16) / 116
    bend = lambda t: F.when(t >= 6 / 29, t * t * t).otherwise((t - 4 / 29) * (108 / 841))
    x, y, z = bend(m + a / 500) * _WHITE[0], bend(m) * _WHITE[1], bend(m - b / 200) * _WHITE[2]
    curve = lambda v: F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)
    linear = [x * p + y * q + z * r for p, q, r in _XYZ_TO_RGB]
    return F.struct(*(F.least(F.greatest(curve(v), F.lit(0.0)), F.lit(1.0)).alias(n) for v, n in zip(linear, "rgb", strict=True)))


def indexed_rgb(index: Column, table: Column, top: int) -> Column:
    """Of a table of 3-byte colours as binary."""
    i = F.least(F.greatest(F.floor(index + 0.5), F.lit(0)), F.lit(top))
    byte = lambda k: F.conv(F.hex(F.substring(table, (i * 3 + k + 1).cast("int"), F.lit(1))), 16, 10).cast("double") / 255
    return F.struct(*(byte(k).alias(n) for k, n in enumerate("rgb")))
