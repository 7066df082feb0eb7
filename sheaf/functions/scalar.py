"""Scalar functions as Column expressions: strings and bytes, geometry, text advance, names, flags. No Python at run time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.crypto import PERMISSION_BITS
from sheaf.functions.fonts import BASE_ENCODINGS, GLYPH_NAMES, base_unicode

# -- strings and bytes --------------------------------------------------------------------------------


def index_of(data: Column, needle: Column) -> Column:
    """0 for an empty needle, null if there is none."""
    return F.nullif(F.position(needle, data) - 1, F.lit(-1))


def contains(data: Column, needle: Column) -> Column:
    return F.position(needle, data) > 0


def occurrences(data: Column, needle: Column) -> Column:
    """Of matches that don't overlap; 0 for an empty needle."""
    return F.when(F.length(needle) == 0, 0).otherwise((F.length(data) - F.length(F.replace(data, needle, F.lit("")))) / F.length(needle)).cast("int")


def search_count(text: Column, needle: Column, ignore_case: bool = False) -> Column:
    return occurrences(F.lower(text), F.lower(needle)) if ignore_case else occurrences(text, needle)


def parse_number(word: Column) -> Column:
    """struct<kind, int, real>: sign, digits and one dot; integers beyond 64 bits are real; null for anything else."""
    whole, real = word.rlike(r"^[+-]?\d+$"), word.rlike(r"^[+-]?(\d+\.\d*|\.\d+)$")
    as_int, as_real = word.try_cast("bigint"), word.try_cast("double")
    return F.when(whole & as_int.isNotNull(), F.struct(F.lit("integer").alias("kind"), as_int.alias("int"), F.lit(None).cast("double").alias("real"))).when(whole | real, F.struct(F.lit("real").alias("kind"), F.lit(None).cast("bigint").alias("int"), as_real.alias("real")))


def format_real(x: Column) -> Column:
    """Whole numbers as n.0, else six decimals without the last zeros; never an exponent."""
    fixed = F.regexp_replace(F.format_string("%.6f", x), "0+$", "")
    return F.when((x == F.rint(x)) & (F.abs(x) < 1e15), F.concat(x.cast("bigint").cast("string"), F.lit(".0"))).otherwise(F.when(fixed.endswith("."), F.concat(fixed, F.lit("0"))).otherwise(fixed))


def hex_string(data: Column) -> Column:
    return F.concat(F.lit("<"), F.hex(data), F.lit(">"))


def text_string(text: Column) -> Column:
    """Text as the bytes of a string: UTF-16BE after its mark."""
    return F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))


def string_text(data: Column) -> Column:
    """Bytes of a string as text: UTF-16BE after a mark (an odd last byte dropped), else Latin-1."""
    body = F.substring(data, F.lit(3), F.length(data) - 2 - (F.length(data) % 2))
    return F.when(F.hex(F.substring(data, 1, 2)) == "FEFF", F.decode(body, "UTF-16BE")).otherwise(F.decode(data, "ISO-8859-1"))


def is_white(text: Column) -> Column:
    return text.rlike(r"(?U)^\s+$")


def byte_class(byte: Column) -> Column:
    """white, delimiter or regular, of a byte as a number."""
    return F.when(byte.isin(0, 9, 10, 12, 13, 32), "white").when(byte.isin(*map(ord, "()<>[]{}/%")), "delimiter").otherwise("regular")


def default_appearance(text: Column) -> Column:
    """struct<font, size, r, g, b> of /DA: the last Tf (0 is 12), g and rg count."""
    number = r"([+-]?(?:\d+\.?\d*|\.\d+))"
    font = F.nullif(F.regexp_extract(text, rf"/([^\s/]+)\s+{number}\s+Tf", 1), F.lit(""))
    size = F.coalesce(F.nullif(F.regexp_extract(text, rf"/[^\s/]+\s+{number}\s+Tf", 1), F.lit("")).cast("double"), F.lit(12.0))
    gray = F.nullif(F.regexp_extract(text, rf"{number}\s+g(?:\s|$)", 1), F.lit("")).cast("double")
    triple = rf"{number}\s+{number}\s+{number}\s+rg(?:\s|$)"
    rgb = [F.nullif(F.regexp_extract(text, triple, i), F.lit("")).cast("double") for i in (1, 2, 3)]
    return F.struct(F.coalesce(font, F.lit("Helv")).alias("font"), F.when(size == 0, 12.0).otherwise(size).alias("size"), *(F.coalesce(c, gray, F.lit(0.0)).alias(n) for c, n in zip(rgb, "rgb", strict=True)))


# -- geometry -----------------------------------------------------------------------------------------

_SIX = ("a", "b", "c", "d", "e", "f")


def matrix(a, b, c, d, e, f) -> Column:
    return F.struct(*(F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.cast("double").alias(n) for v, n in zip((a, b, c, d, e, f), _SIX, strict=True)))


def concatenate(m: Column, n: Column) -> Column:
    """m first, then n."""
    return F.struct(
        (m["a"] * n["a"] + m["b"] * n["c"]).alias("a"), (m["a"] * n["b"] + m["b"] * n["d"]).alias("b"),
        (m["c"] * n["a"] + m["d"] * n["c"]).alias("c"), (m["c"] * n["b"] + m["d"] * n["d"]).alias("d"),
        (m["e"] * n["a"] + m["f"] * n["c"] + n["e"]).alias("e"), (m["e"] * n["b"] + m["f"] * n["d"] + n["f"]).alias("f"),
    )


def transform(m: Column, x: Column, y: Column, vector: bool = False) -> Column:
    """A point; or a vector, which isn't moved."""
    e, f = (F.lit(0.0), F.lit(0.0)) if vector else (m["e"], m["f"])
    return F.struct((m["a"] * x + m["c"] * y + e).alias("x"), (m["b"] * x + m["d"] * y + f).alias("y"))


def matrix_of(values: Column) -> Column:
    """Of an array of just six numbers, else null."""
    return F.when((F.size(values) == 6) & ~F.exists(values, lambda v: v.isNull()), F.struct(*(F.get(values, i).alias(n) for i, n in enumerate(_SIX))))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners in order."""
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def crop_within(crop: Column, media: Column) -> Column:
    """The crop box cut to the media box; this itself where nothing is left or there is no crop box."""
    cut = F.struct(F.greatest(crop["x0"], media["x0"]).alias("x0"), F.greatest(crop["y0"], media["y0"]).alias("y0"), F.least(crop["x1"], media["x1"]).alias("x1"), F.least(crop["y1"], media["y1"]).alias("y1"))
    return F.when(crop.isNull() | (cut["x1"] <= cut["x0"]) | (cut["y1"] <= cut["y0"]), media).otherwise(cut)


def rotation(degrees: Column) -> Column:
    """0 to 270 in quarter turns; 0 for what isn't one."""
    turned = F.pmod(degrees, F.lit(360))
    return F.when(turned % 90 == 0, turned).otherwise(0)


def render_size(width: Column, height: Column, rotate: Column, scale: float) -> Column:
    side = rotate.isin(90, 270)
    w, h = F.when(side, height).otherwise(width), F.when(side, width).otherwise(height)
    pixels = lambda v: F.greatest(F.lit(1), F.rint(v * scale)).cast("int")
    return F.struct(pixels(w).alias("width"), pixels(h).alias("height"))


def glyph_advance(width: Column, size: Column, char_gap: Column, word_gap: Column, scale: Column, is_space: Column) -> Column:
    return (width * size + char_gap + F.when(is_space, word_gap).otherwise(0.0)) * scale


def adjustment_advance(amount: Column, size: Column, scale: Column) -> Column:
    return -amount / 1000 * size * scale


def within(x: Column, y: Column, box: Column) -> Column:
    """Edges count."""
    return x.between(box["x0"], box["x1"]) & y.between(box["y0"], box["y1"])


def overlap(a: Column, b: Column) -> Column:
    """Touching counts."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


# -- fonts --------------------------------------------------------------------------------------------


def glyph_name_text(name: Column) -> Column:
    """The fixed names, single letters and digits, and uniXXXX of one character; suffixes dropped first."""
    bare = F.regexp_extract(name, r"^([^.]*)", 1)
    table = F.create_map(*(F.lit(x) for pair in GLYPH_NAMES.items() for x in pair))
    hexed = F.regexp_extract(bare, r"^u(?:ni)?([0-9A-Fa-f]{4})$", 1)
    return F.when(name == ".notdef", "").when(F.element_at(table, bare).isNotNull(), F.element_at(table, bare)).when(bare.rlike("^[A-Za-z0-9]$"), bare).when(hexed != "", F.decode(F.unhex(hexed), "UTF-16BE")).otherwise("")


def code_text(code: Column, encoding: str) -> Column:
    """A code's character in a base encoding, from a table made when planning; null where there is none."""
    if encoding not in BASE_ENCODINGS:
        raise ValueError(encoding)
    known = [(c, t) for c in range(256) if (t := base_unicode(encoding, c))]
    return F.element_at(F.create_map(*(F.lit(x) for pair in known for x in pair)), code)


def width_of(code: Column, first: int, widths: list[float], missing: float = 0.0) -> Column:
    table = F.array(*map(F.lit, map(float, widths)))
    return F.when(code.between(first, first + len(widths) - 1), F.get(table, code - first)).otherwise(F.lit(float(missing))) / 1000


# -- flags and keys -----------------------------------------------------------------------------------


def has_flag(value: Column, bit: int) -> Column:
    return value.bitwiseAND(F.lit(1 << (bit - 1))) != 0


def grants(value: Column) -> Column:
    """The permissions in /P, as an array of names in order of their bits."""
    return F.filter(F.array(*(F.when(has_flag(value, bit), F.lit(name)) for name, bit in PERMISSION_BITS.items())), lambda v: v.isNotNull())


def flags_value(flags: Column, table: dict[str, int]) -> Column:
    """An array of names to their bits' sum; a name twice counts once."""
    return reduce(lambda a, b: a + b, [F.when(F.array_contains(flags, name), F.lit(1 << (bit - 1))).otherwise(0) for name, bit in table.items()])


def object_key(key: Column, number: Column, generation: Column, aes: bool = False, length: int = 16) -> Column:
    """md5 of key, number and generation, low bytes first, and the salt of AES."""
    low = lambda v, n: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n))))
    parts = [key, low(number.cast("long"), 3), low(generation.cast("long"), 2)] + ([F.unhex(F.lit("73416C54"))] if aes else [])
    return F.substring(F.unhex(F.md5(F.concat(*parts))), 1, length)


def aes_cbc(data: Column, key: Column, iv: Column | None = None) -> Column:
    """CBC with PKCS#7 and the vector first, by Spark's own function."""
    return F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), iv) if iv is not None else F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"))


def aes_uncbc(data: Column, key: Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("CBC"), F.lit("PKCS"))
