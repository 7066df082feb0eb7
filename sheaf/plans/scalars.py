"""Queries of the scalar functions and codecs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sheaf.functions import codecs, colour, crypto, images, numeric, scalar
from sheaf.plans.registry import query
from sheaf.session import spread

_WORDS = "array(cast(cast(l_quantity as int) as string), concat('-', cast(cast(l_extendedprice as int) as string), '.25'), '1e5', '99999999999999999999', '.5', '+7', '-', '4.')"


@query("src14_parse_number", r"""
    WITH w AS (SELECT l_orderkey, l_linenumber, unnest([CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR), '-' || CAST(CAST(trunc(l_extendedprice) AS INT) AS VARCHAR) || '.25', '1e5', '99999999999999999999', '.5', '+7', '-', '4.']) AS word FROM lineitem),
    k AS (SELECT *, CASE WHEN regexp_full_match(word, '[+-]?\d+') AND TRY_CAST(word AS BIGINT) IS NOT NULL THEN 'integer' WHEN regexp_full_match(word, '[+-]?(\d+|\d+\.\d*|\.\d+)') THEN 'real' END AS kind FROM w)
    SELECT l_orderkey, l_linenumber, word, kind, CASE WHEN kind = 'integer' THEN TRY_CAST(word AS BIGINT) END AS int_value, CASE WHEN kind = 'real' THEN CAST(word AS DOUBLE) END AS real_value FROM k""")
def _parse_number(t):
    words = t("lineitem").select("l_orderkey", "l_linenumber", F.explode(F.expr(_WORDS)).alias("word"))
    n = scalar.parse_number(F.col("word"))
    return words.select("*", n["kind"].alias("kind"), n["int"].alias("int_value"), n["real"].alias("real_value"))


@query("src16_hex_string", "SELECT p_partkey, p_name || CASE WHEN length(p_name) % 2 = 0 THEN '' ELSE 'P' END AS text FROM part")
def _hex_string(t):
    # Blanks are passed over and an odd last digit is filled up with 0: 5 and 0 make P.
    digits = F.concat_ws(" ", F.hex(F.encode("p_name", "UTF-8")), F.when(F.length("p_name") % 2 == 1, F.lit("5")).otherwise(F.lit("")))
    return t("part").select("p_partkey", F.decode(codecs.hex_decoded(F.concat(digits, F.lit(">00"))), "UTF-8").alias("text"))


@query("src28_default_appearance", "SELECT p_partkey, 'F' || p_size AS font, CAST(CASE WHEN p_size % 5 = 0 THEN 12.0 ELSE p_size / 2.0 END AS DOUBLE) AS size, CAST(CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS r, CAST(CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS g, CAST(CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS b FROM part")
def _default_appearance(t):
    size = F.when(F.col("p_size") % 5 == 0, F.lit("0")).otherwise((F.col("p_size") / 2).cast("string"))
    text = F.concat(F.lit("/F"), F.col("p_size").cast("string"), F.lit(" "), size, F.lit(" Tf "), F.when(F.col("p_size") % 2 == 0, F.lit("0.5 g")).otherwise(F.lit("0.25 0 1 rg")))
    a = scalar.default_appearance(text)
    return t("part").select("p_partkey", *(a[c].alias(c) for c in ("font", "size", "r", "g", "b")))


@query("prj04_dictionary", """
    WITH last AS (SELECT o_custkey, o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS v, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS r FROM orders)
    SELECT o_custkey, o_orderpriority, v FROM last WHERE r = 1 AND v IS NOT NULL""")
def _dictionary(t):
    from sheaf.operators.relational import dictionary

    pairs = t("orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v"))
    return dictionary(pairs, ["o_custkey"], "o_orderpriority", "v", "o_orderkey")


@query("prj18_permissions", """
    SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey & 4 <> 0 THEN 'print' END, CASE WHEN o_orderkey & 8 <> 0 THEN 'modify' END, CASE WHEN o_orderkey & 16 <> 0 THEN 'copy' END, CASE WHEN o_orderkey & 32 <> 0 THEN 'annotate' END,
        CASE WHEN o_orderkey & 256 <> 0 THEN 'fill_forms' END, CASE WHEN o_orderkey & 512 <> 0 THEN 'accessibility' END, CASE WHEN o_orderkey & 1024 <> 0 THEN 'assemble' END, CASE WHEN o_orderkey & 2048 <> 0 THEN 'print_high' END], lambda x: x IS NOT NULL), ',') AS granted FROM orders""")
def _permissions(t):
    return t("orders").select("o_orderkey", F.array_join(scalar.grants(F.col("o_orderkey")), ",").alias("granted"))


@query("ag11_permission_or", "SELECT o_custkey, CAST(bit_or(CAST(o_orderkey & 4095 AS INTEGER)) AS INTEGER) AS flags FROM orders GROUP BY o_custkey")
def _permission_or(t):
    return t("orders").groupBy("o_custkey").agg(F.bit_or(F.col("o_orderkey").bitwiseAND(F.lit(4095)).cast("int")).alias("flags"))


# -- bytes and strings --------------------------------------------------------------------------------


@query("fn12_index_of", "SELECT doc_id, CASE WHEN strpos(text, 'tion') > 0 THEN CAST(strpos(text, 'tion') - 1 AS INTEGER) END AS place FROM documents")
def _index_of(t):
    return t("documents").select("doc_id", scalar.index_of(F.col("text"), F.lit("tion")).alias("place"))


@query("fn13_contains", "SELECT page_id, strpos(html, '<article>') > 0 AS found, strpos(html, CAST(page_id % 10 AS VARCHAR) || 'a') > 0 AS own FROM pages")
def _contains(t):
    own = F.concat((F.col("page_id") % 10).cast("string"), F.lit("a"))
    return t("pages").select("page_id", scalar.contains(F.col("html"), F.lit("<article>")).alias("found"), scalar.contains(F.col("html"), own).alias("own"))


@query("fn14_occurrences", "SELECT doc_id, CAST((length(text) - length(replace(text, 'an', ''))) / 2 AS INTEGER) AS n FROM documents")
def _occurrences(t):
    return t("documents").select("doc_id", scalar.occurrences(F.col("text"), F.lit("an")).alias("n"))


@query("fn15_text_string", "SELECT p_partkey, 'FEFF' || upper(string_agg(format('{:04x}', ascii(c)), '' ORDER BY i)) AS bytes FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS c, generate_subscripts(string_split(p_name, ''), 1) AS i FROM part) GROUP BY p_partkey")
def _text_string(t):
    return t("part").select("p_partkey", F.hex(scalar.text_string(F.col("p_name"))).alias("bytes"))


@query("fn16_string_text", "SELECT doc_id, text, lang AS latin FROM documents")
def _string_text(t):
    return t("documents").select("doc_id", scalar.string_text(scalar.text_string(F.col("text"))).alias("text"), scalar.string_text(F.encode("lang", "UTF-8")).alias("latin"))


@query("fn17_search_count", "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS INTEGER) AS n FROM documents")
def _search_count(t):
    return t("documents").select("doc_id", scalar.search_count(F.col("text"), F.lit("The"), True).alias("n"))


@query("fn18_is_white", r"SELECT event_id, regexp_full_match(CASE WHEN event_type = 'click' THEN ' ' || chr(9) ELSE event_type END, '\s+') AS white FROM events")
def _is_white(t):
    return t("events").select("event_id", scalar.is_white(F.when(F.col("event_type") == "click", F.lit(" \t")).otherwise(F.col("event_type"))).alias("white"))


@query("fn19_byte_class", "SELECT DISTINCT CAST(l_partkey % 256 AS INTEGER) AS byte, CASE WHEN l_partkey % 256 IN (0, 9, 10, 12, 13, 32) THEN 'white' WHEN chr(CAST(l_partkey % 256 AS INTEGER)) IN ('(', ')', '<', '>', '[', ']', '{', '}', '/', '%') THEN 'delimiter' ELSE 'regular' END AS class FROM lineitem")
def _byte_class(t):
    byte = (F.col("l_partkey") % 256).cast("int")
    return t("lineitem").select(byte.alias("byte"), scalar.byte_class(byte).alias("class")).distinct()


@query("fn20_hex", "SELECT o_orderkey, lower(hex(o_orderpriority)) AS hexed, o_orderpriority AS back FROM orders")
def _hex(t):
    hexed = F.lower(F.hex(F.encode("o_orderpriority", "UTF-8")))
    return t("orders").select("o_orderkey", hexed.alias("hexed"), F.decode(F.unhex(hexed), "UTF-8").alias("back"))


@query("fn21_format_real", """
    WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount / 8 AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST(CAST(a AS BIGINT) AS VARCHAR) || '.0' AS whole, CASE WHEN b = 0 THEN '0.0' ELSE rtrim(printf('%.6f', b), '0') END AS part FROM v""")
def _format_real(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", scalar.format_real(F.col("l_quantity")).alias("whole"), scalar.format_real(F.col("l_discount") / 8).alias("part"))


def _round_trip(name, filters):
    @query(name, "SELECT doc_id, text FROM documents")
    def run(t):
        packed = codecs.encoded(F.encode("text", "UTF-8"), filters)["bytes"]
        return spread(t("documents")).select("doc_id", packed.alias("packed")).select("doc_id", F.decode(codecs.decoded(F.col("packed"), filters)["bytes"], "UTF-8").alias("text"))

    return run


_round_trip("fn01_ascii_hex", [("AHx", {})])
_round_trip("fn02_ascii85", [("ASCII85Decode", {})])
_round_trip("fn03_run_length", [("RL", {})])
_round_trip("fn04_lzw", [("LZWDecode", {})])
_round_trip("fn04_lzw_late", [("LZWDecode", {"EarlyChange": 0})])
_round_trip("fn05_flate", [("FlateDecode", {})])
_round_trip("fn08_pipeline", [("ASCII85Decode", {}), ("LZWDecode", {}), ("FlateDecode", {})])


@query("fn01_ascii_hex_native", "SELECT doc_id, hex(text) || '>' AS packed, text FROM documents")
def _native_hex(t):
    packed = codecs.hex_encoded(F.encode("text", "UTF-8"))
    return t("documents").select("doc_id", packed.alias("packed"), F.decode(codecs.hex_decoded(packed), "UTF-8").alias("text"))


def _predictor(name, parms):
    @query(name, "SELECT doc_id, repeat(md5(text), 5) AS payload FROM documents")
    def run(t):
        payload = F.repeat(F.md5(F.encode("text", "UTF-8")), 5)
        filters = [("FlateDecode", parms)]
        packed = t("documents").select("doc_id", codecs.encoded(F.encode(payload, "UTF-8"), filters)["bytes"].alias("packed"))
        return packed.select("doc_id", F.decode(codecs.decoded(F.col("packed"), filters)["bytes"], "UTF-8").alias("payload"))

    return run


_predictor("fn06_tiff_predictor", {"Predictor": 2, "Colors": 4, "Columns": 8})
_predictor("fn07_png_predictor", {"Predictor": 12, "Columns": 16})
_predictor("fn07_png_predictor_bits", {"Predictor": 15, "Colors": 2, "BitsPerComponent": 4, "Columns": 20})


@query("fn07_malformed", "SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'filter' END AS error, CASE WHEN doc_id % 2 = 0 THEN text END AS text FROM documents")
def _malformed(t):
    """Bytes that are no such stream are a code in their row; others are decoded."""
    data = F.encode("text", "UTF-8")
    out = codecs.decoded(F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit(b"no"), data)).otherwise(codecs.encoded(data, [("FlateDecode", {})])["bytes"]), [("FlateDecode", {})])
    return t("documents").select("doc_id", out["error"].alias("error"), F.decode(out["bytes"], "UTF-8").alias("text"))


@query("fn09_filter_kind", """
    SELECT p_partkey, name, CASE name WHEN 'AHx' THEN 'ASCIIHexDecode' WHEN 'A85' THEN 'ASCII85Decode' WHEN 'LZW' THEN 'LZWDecode' WHEN 'Fl' THEN 'FlateDecode' WHEN 'RL' THEN 'RunLengthDecode' WHEN 'DCT' THEN 'DCTDecode' WHEN 'CCF' THEN 'CCITTFaxDecode' WHEN 'JPXDecode' THEN 'JPXDecode' END AS kind
    FROM (SELECT p_partkey, unnest(['AHx', 'A85', 'LZW', 'Fl', 'RL', 'DCT', 'CCF', 'JPXDecode', 'None']) AS name FROM part)""")
def _filter_kind(t):
    names = F.array(*map(F.lit, ["AHx", "A85", "LZW", "Fl", "RL", "DCT", "CCF", "JPXDecode", "None"]))
    return t("part").select("p_partkey", F.explode(names).alias("name")).select("*", codecs.filter_kind(F.col("name")).alias("kind"))


@query("fn11_unsupported", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'unsupportedFeature' END AS error, CASE WHEN p_size % 2 = 1 THEN p_name END AS text FROM part")
def _unsupported(t):
    """An unknown codec is a code in the row; in the same table other rows are decoded."""
    name = F.encode("p_name", "UTF-8")
    unknown, known = codecs.decoded(name, [("Crypt9", {})]), codecs.decoded(codecs.encoded(name, [("AHx", {})])["bytes"], [("AHx", {})])
    even = F.col("p_size") % 2 == 0
    return t("part").select("p_partkey", F.when(even, unknown["error"]).otherwise(known["error"]).alias("error"), F.when(~even, F.decode(known["bytes"], "UTF-8")).alias("text"))


# -- geometry -----------------------------------------------------------------------------------------

_M = "struct(l_quantity as a, l_discount as b, l_tax as c, 2D as d, 10D as e, -5D as f)"


def _lines(t, *columns):
    return t("lineitem").select("l_orderkey", "l_linenumber", *columns)


def _rounded(struct, names, digits=6):
    return [F.round(struct[n], digits).alias(n) for n in names]


@query("fn22_concatenate", "SELECT l_orderkey, l_linenumber, round(l_quantity * 2.0 + l_discount * 0.5, 6) AS a, round(l_quantity * 0.25 + l_discount * 3.0, 6) AS b, round(l_tax * 2.0 + 2.0 * 0.5, 6) AS c, round(l_tax * 0.25 + 2.0 * 3.0, 6) AS d, round(10.0 * 2.0 + (-5.0) * 0.5 + 7.0, 6)::DOUBLE AS e, round(10.0 * 0.25 + (-5.0) * 3.0 + 8.0, 6)::DOUBLE AS f FROM lineitem")
def _concatenate(t):
    m = scalar.concatenate(F.expr(_M), scalar.matrix(2.0, 0.25, 0.5, 3.0, 7.0, 8.0))
    return _lines(t, *_rounded(m, "abcdef"))


@query("fn23_transform", "SELECT l_orderkey, l_linenumber, round(l_quantity * 3.0 + l_tax * l_extendedprice + 10.0, 4) AS x, round(l_discount * 3.0 + 2.0 * l_extendedprice - 5.0, 4) AS y, round(l_quantity * 3.0 + l_tax * l_extendedprice, 4) AS vx, round(l_discount * 3.0 + 2.0 * l_extendedprice, 4) AS vy FROM lineitem")
def _transform(t):
    p, v = (scalar.transform(F.expr(_M), F.lit(3.0), F.col("l_extendedprice"), vector) for vector in (False, True))
    return _lines(t, *_rounded(p, "xy", 4), F.round(v["x"], 4).alias("vx"), F.round(v["y"], 4).alias("vy"))


@query("fn24_matrix_of", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS f FROM part")
def _matrix_of(t):
    six = F.array(*map(F.lit, [1.0, 0.0, 0.0, 1.0, 5.0]), F.col("p_retailprice"))
    return t("part").select("p_partkey", scalar.matrix_of(F.when(F.col("p_size") % 2 == 0, six).otherwise(F.slice(six, 1, 5)))["f"].alias("f"))


@query("fn25_rectangle", "SELECT l_orderkey, l_linenumber, least(l_quantity, l_tax * 500) AS x0, least(l_discount * 100, 3.0) AS y0, greatest(l_quantity, l_tax * 500) AS x1, greatest(l_discount * 100, 3.0) AS y1, round(abs(l_quantity - l_tax * 500), 6) AS width FROM lineitem")
def _rectangle(t):
    r = scalar.rectangle(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 500, F.lit(3.0))
    return _lines(t, *(r[c].alias(c) for c in ("x0", "y0", "x1", "y1")), F.round(r["x1"] - r["x0"], 6).alias("width"))


@query("prj05_crop_box", """
    WITH b AS (SELECT l_orderkey, l_linenumber, greatest(l_quantity, 10.0) AS x0, greatest(l_discount * 100, 2.0) AS y0, least(l_quantity + 20, 60.0) AS x1, least(l_discount * 100 + l_tax * 100, 8.0) AS y1 FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN x1 <= x0 OR y1 <= y0 THEN 10.0 ELSE x0 END AS x0, CASE WHEN x1 <= x0 OR y1 <= y0 THEN 2.0 ELSE y0 END AS y0, CASE WHEN x1 <= x0 OR y1 <= y0 THEN 60.0 ELSE x1 END AS x1, CASE WHEN x1 <= x0 OR y1 <= y0 THEN 8.0 ELSE y1 END AS y1 FROM b""")
def _crop_box(t):
    crop = scalar.rectangle(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_quantity") + 20, F.col("l_discount") * 100 + F.col("l_tax") * 100)
    box = scalar.crop_within(crop, scalar.rectangle(F.lit(10.0), F.lit(2.0), F.lit(60.0), F.lit(8.0)))
    return _lines(t, *(box[c].alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("fn27_rotation", "WITH r AS (SELECT o_orderkey, CAST((((o_orderkey - 7000) * 45) % 360 + 360) % 360 AS BIGINT) AS d FROM orders) SELECT o_orderkey, CASE WHEN d % 90 = 0 THEN d ELSE 0 END AS rotate FROM r")
def _rotation(t):
    return t("orders").select("o_orderkey", scalar.rotation((F.col("o_orderkey") - 7000) * 45).alias("rotate"))


@query("fn28_text_advance", "SELECT l_orderkey, l_linenumber, round((0.5 * l_quantity + l_discount + CASE WHEN l_linenumber = 2 THEN l_tax ELSE 0.0 END) * 0.9, 6) AS advance, CAST(l_linenumber * -0.125 * l_quantity * 0.5 AS DOUBLE) AS adjusted FROM lineitem")
def _text_advance(t):
    a = scalar.glyph_advance(F.lit(0.5), F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.lit(0.9), F.col("l_linenumber") == 2)
    return _lines(t, F.round(a, 6).alias("advance"), scalar.adjustment_advance(F.col("l_linenumber") * 125, F.col("l_quantity"), F.lit(0.5)).alias("adjusted"))


@query("fn77_render_size", "WITH s AS (SELECT p_partkey, p_retailprice AS w, p_size * 10.0 AS h, p_size % 4 * 90 AS r FROM part) SELECT p_partkey, CAST(greatest(1, round_even((CASE WHEN r IN (90, 270) THEN h ELSE w END) * 1.5, 0)) AS INTEGER) AS width, CAST(greatest(1, round_even((CASE WHEN r IN (90, 270) THEN w ELSE h END) * 1.5, 0)) AS INTEGER) AS height FROM s")
def _render_size(t):
    s = scalar.render_size(F.col("p_retailprice"), F.col("p_size") * 10.0, F.col("p_size") % 4 * 90, 1.5)
    return t("part").select("p_partkey", s["width"].alias("width"), s["height"].alias("height"))


# -- functions ----------------------------------------------------------------------------------------


@query("fn29_interpolate", "SELECT l_orderkey, l_linenumber, round(-1.0 + (least(greatest(l_quantity, 5.0), 40.0) - 5.0) * 3.0 / 35.0, 9) AS y FROM lineitem")
def _interpolate(t):
    return _lines(t, F.round(numeric.interpolate_column(numeric.clip_column(F.col("l_quantity"), 5, 40), 5, 40, -1, 2), 9).alias("y"))


@query("fn30_exponential", "SELECT l_orderkey, l_linenumber, round(0.25 + pow(least(greatest(l_discount * 12, 0.0), 1.0), 1.8) * 0.75, 9) AS y0, round(1.0 - pow(least(greatest(l_discount * 12, 0.0), 1.0), 1.8), 9) AS y1 FROM lineitem")
def _exponential(t):
    y = numeric.exponential_column(F.col("l_discount") * 12, [0.25, 1.0], [1.0], 1.8)
    return _lines(t, F.round(y[0], 9).alias("y0"), F.round(y[1], 9).alias("y1"))


@query("fn31_stitching", "WITH v AS (SELECT l_orderkey, l_linenumber, least(greatest(l_quantity / 50, 0.0), 1.0) AS x FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN x < 0.3 THEN x / 0.3 ELSE pow(1.0 - (x - 0.3) / 0.7, 2) * -2.0 + 3.0 END, 9) AS y FROM v")
def _stitching(t):
    parts = [lambda x: numeric.exponential_column(x, [0.0], [1.0], 1), lambda x: numeric.exponential_column(x, [3.0], [1.0], 2)]
    y = numeric.stitching_column(F.col("l_quantity") / 50, parts, [0.3], [0.0, 1.0, 1.0, 0.0], (0.0, 1.0))[0]
    return _lines(t, F.round(y, 9).alias("y"))


@query("fn32_sampled", "WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 * 2 AS e FROM lineitem) SELECT l_orderkey, l_linenumber, round((CASE WHEN e < 1 THEN 10.0 + e * 190.0 ELSE 200.0 + (e - 1) * -150.0 END) / 255.0, 9) AS y FROM v")
def _sampled(t):
    y = numeric.sampled_column(F.col("l_quantity") / 50, [10.0, 200.0, 50.0], 8, (0.0, 1.0), (0.0, 1.0))
    return _lines(t, F.round(y, 9).alias("y"))


_PROGRAM = b"{ dup 25 gt { 50 exch sub } { 2 mul } ifelse 3 1 roll add sqrt mul dup 0 lt { neg } if }"


def _calculated(name, program, y):
    @query(name, f"WITH v AS (SELECT l_orderkey, l_linenumber, l_discount * 100 AS a, l_tax * 100 AS b, l_quantity AS c FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(greatest({y}, 0.0), 500.0), 6) AS y FROM v")
    def run(t):
        inputs = [F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_quantity")]
        return _lines(t, F.round(numeric.calculator_column(numeric.parse_program(program), inputs, [0.0, 100.0] * 3, [0.0, 500.0])[0], 6).alias("y"))

    return run


_calculated("fn35_calculator_compiled", _PROGRAM, "(CASE WHEN c > 25 THEN 50 - c ELSE c * 2 END) * sqrt(a + b)")
#: A user's own program, which becomes an expression like any other.
_calculated("ud03_calculator", b"{ dup mul exch dup mul add sqrt exch 10 div floor add }", "sqrt(b * b + c * c) + floor(a / 10)")


# -- colour -------------------------------------------------------------------------------------------


@query("fn36_gray", "SELECT l_orderkey, l_linenumber, l_discount AS r, l_discount AS g, l_discount AS b FROM lineitem")
def _gray(t):
    c = colour.gray_rgb(F.col("l_discount"))
    return _lines(t, *(c[n].alias(n) for n in "rgb"))


@query("fn38_cmyk", "SELECT l_orderkey, l_linenumber, round((1 - l_discount) * (1 - l_tax), 9) AS r, round((1 - l_tax) * (1 - l_tax), 9) AS g, round((1 - l_quantity / 50) * (1 - l_tax), 9) AS b FROM lineitem")
def _cmyk(t):
    return _lines(t, *_rounded(colour.cmyk_rgb(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.col("l_tax")), "rgb", 9))


@query("fn39_lab", """
    WITH v AS (SELECT l_orderkey, l_linenumber, (l_quantity * 2 + 16) / 116 AS m, l_discount * 1000 - 50 AS a, l_tax * 1000 - 40 AS b FROM lineitem),
    f AS (SELECT *, m + a / 500 AS fx, m - b / 200 AS fz FROM v),
    x AS (SELECT *, 0.9505 * CASE WHEN fx >= 6.0/29 THEN fx*fx*fx ELSE (fx - 4.0/29) * (108.0/841) END AS xx, CASE WHEN m >= 6.0/29 THEN m*m*m ELSE (m - 4.0/29) * (108.0/841) END AS yy, 1.089 * CASE WHEN fz >= 6.0/29 THEN fz*fz*fz ELSE (fz - 4.0/29) * (108.0/841) END AS zz FROM f),
    l AS (SELECT *, 3.2406*xx - 1.5372*yy - 0.4986*zz AS lr, -0.9689*xx + 1.8758*yy + 0.0415*zz AS lg, 0.0557*xx - 0.2040*yy + 1.0570*zz AS lb FROM x)
    SELECT l_orderkey, l_linenumber, round(least(greatest(CASE WHEN lr <= 0.0031308 THEN lr*12.92 ELSE pow(greatest(lr, 0), 1/2.4)*1.055 - 0.055 END, 0.0), 1.0), 6) AS r, round(least(greatest(CASE WHEN lg <= 0.0031308 THEN lg*12.92 ELSE pow(greatest(lg, 0), 1/2.4)*1.055 - 0.055 END, 0.0), 1.0), 6) AS g,
        round(least(greatest(CASE WHEN lb <= 0.0031308 THEN lb*12.92 ELSE pow(greatest(lb, 0), 1/2.4)*1.055 - 0.055 END, 0.0), 1.0), 6) AS b FROM l""")
def _lab(t):
    return _lines(t, *_rounded(colour.lab_rgb(F.col("l_quantity") * 2, F.col("l_discount") * 1000 - 50, F.col("l_tax") * 1000 - 40), "rgb"))


@query("fn41_indexed", "WITH v AS (SELECT l_orderkey, l_linenumber, CAST(least(l_linenumber, 3) AS INTEGER) AS i FROM lineitem) SELECT l_orderkey, l_linenumber, round([255, 0, 16, 32][i + 1] / 255.0, 9) AS r, round([0, 255, 17, 33][i + 1] / 255.0, 9) AS g, round([0, 0, 18, 34][i + 1] / 255.0, 9) AS b FROM v")
def _indexed(t):
    table = F.unhex(F.lit("FF000000FF00101112202122"))
    return _lines(t, *_rounded(colour.indexed_rgb(F.col("l_linenumber").cast("double"), table, 3), "rgb", 9))


@query("fn42_separation", "SELECT l_orderkey, l_linenumber, round(1 - l_discount * 10, 9) AS r, round(1 - l_discount * 10 * 0.5, 9) AS g, 1.0::DOUBLE AS b FROM lineitem WHERE l_discount <= 0.1")
def _separation(t):
    c = numeric.exponential_column(F.col("l_discount") * 10, [0.0, 0.0, 0.0, 0.0], [1.0, 0.5, 0.0, 0.0], 1)
    return t("lineitem").where("l_discount <= 0.1").select("l_orderkey", "l_linenumber", *_rounded(colour.cmyk_rgb(*c), "rgb", 9))


@query("fn45_device_gray", "SELECT l_orderkey, l_linenumber, round(0.3 * l_discount + 0.59 * l_tax + 0.11 * l_quantity / 50, 9) AS gray FROM lineitem")
def _device_gray(t):
    return _lines(t, F.round(colour.rgb_gray(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50), 9).alias("gray"))


@query("fn46_shading", "WITH v AS (SELECT l_orderkey, l_linenumber, (least(greatest(l_quantity, 10.0), 40.0) - 10.0) / 30.0 AS x FROM lineitem) SELECT l_orderkey, l_linenumber, round(x, 9) AS r, round(1 - x, 9) AS g, 0.5::DOUBLE AS b FROM v")
def _shading(t):
    x = numeric.interpolate_column(numeric.clip_column(F.col("l_quantity"), 10, 40), 10, 40, 0, 1)
    y = numeric.exponential_column(x, [0.0, 1.0, 0.5], [1.0, 0.0, 0.5], 1)
    return _lines(t, *(F.round(c, 9).alias(n) for c, n in zip(y, "rgb", strict=True)))


@query("fn48_annotation_colour", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size / 50.0 WHEN 1 THEN 0.25 ELSE (1 - 0.5) * (1 - p_size / 100.0) END AS r FROM part")
def _annotation_colour(t):
    size = F.col("p_size")
    cmyk = colour.cmyk_rgb(F.lit(0.5), F.lit(0.0), F.lit(0.0), size / 100.0)
    return t("part").select("p_partkey", F.when(size % 3 == 0, colour.gray_rgb(size / 50.0)["r"]).when(size % 3 == 1, F.lit(0.25)).otherwise(cmyk["r"]).alias("r"))


# -- fonts --------------------------------------------------------------------------------------------


@query("fn51_width", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 10 AND 39 THEN (CAST(l_quantity AS INTEGER) - 10) * 10 / 1000.0 ELSE 0.25 END AS width FROM lineitem")
def _width(t):
    return _lines(t, scalar.width_of(F.col("l_quantity").cast("int"), 10, [10.0 * i for i in range(30)], 250.0).alias("width"))


@query("fn53_base_encoding", "SELECT DISTINCT CAST(l_partkey % 256 AS INTEGER) AS code, CASE WHEN l_partkey % 256 BETWEEN 32 AND 126 OR l_partkey % 256 >= 160 THEN chr(CAST(l_partkey % 256 AS INTEGER)) WHEN l_partkey % 256 = 128 THEN '€' WHEN l_partkey % 256 BETWEEN 129 AND 159 THEN '*' END AS text FROM lineitem")
def _base_encoding(t):
    code = (F.col("l_partkey") % 256).cast("int")
    text = scalar.code_text(code, "WinAnsiEncoding")
    # The middle of the high range is checked by the tests; here it only counts as one.
    return t("lineitem").select(code.alias("code"), F.when(code.between(129, 159), "*").otherwise(text).alias("text")).distinct()


@query("fn55_glyph_names", "SELECT p_partkey, name, CASE name WHEN 'uni20AC' THEN '€' WHEN 'a.sc' THEN 'a' WHEN 'eacute' THEN 'é' WHEN 'seven' THEN '7' WHEN 'B' THEN 'B' WHEN 'u00E9' THEN 'é' ELSE '' END AS text FROM (SELECT p_partkey, unnest(['uni20AC', 'a.sc', 'seven', 'B', 'u00E9', '.notdef', 'nosuchname']) AS name FROM part)")
def _glyph_names(t):
    names = F.array(*map(F.lit, ["uni20AC", "a.sc", "seven", "B", "u00E9", ".notdef", "nosuchname"]))
    return t("part").select("p_partkey", F.explode(names).alias("name")).select("*", scalar.glyph_name_text(F.col("name")).alias("text"))


# -- crypto -------------------------------------------------------------------------------------------


@query("fn58_digests", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def _digests(t):
    data = F.encode("text", "UTF-8")
    return t("documents").select("doc_id", F.md5(data).alias("md5"), F.sha2(data, 256).alias("sha256"))


@query("fn59_rc4", "SELECT p_partkey, p_name FROM part")
def _rc4(t):
    @F.pandas_udf("binary")
    def cipher(data: pd.Series) -> pd.Series:
        return data.map(lambda d: crypto.rc4(b"a key", bytes(d)))

    return t("part").select("p_partkey", F.decode(cipher(cipher(F.encode("p_name", "UTF-8"))), "UTF-8").alias("p_name"))


@query("fn60_aes_cbc", "SELECT p_partkey, p_name, CAST(16 + (strlen(p_name) // 16 + 1) * 16 AS INTEGER) AS sealed FROM part")
def _aes_cbc(t):
    # Random vectors: only the length of what is sealed, and what is opened again, are the same in each run.
    sealed = t("part").select("p_partkey", scalar.aes_cbc(F.encode("p_name", "UTF-8"), F.lit(b"sixteen byte key")).alias("s"))
    return sealed.select("p_partkey", F.decode(scalar.aes_uncbc(F.col("s"), F.lit(b"sixteen byte key")), "UTF-8").alias("p_name"), F.length("s").alias("sealed"))


@query("fn65_object_key", "SELECT p_partkey, substr(md5(from_hex('0102030405' || lpad(to_hex(p_partkey % 256), 2, '0') || lpad(to_hex(p_partkey // 256 % 256), 2, '0') || lpad(to_hex(p_partkey // 65536 % 256), 2, '0') || '0000')), 1, 20) AS key FROM part")
def _object_key(t):
    key = scalar.object_key(F.unhex(F.lit("0102030405")), F.col("p_partkey"), F.lit(0), length=10)
    return t("part").select("p_partkey", F.lower(F.hex(key)).alias("key"))


# -- images -------------------------------------------------------------------------------------------


@query("fn69_image_decode", "SELECT doc_id, CAST(bit_count(CAST(encode(md5(text)) AS BIT)) AS INTEGER) AS white FROM documents")
def _image_decode(t):
    @F.pandas_udf("int")
    def white(data: pd.Series) -> pd.Series:
        from sheaf.sources.document import Document
        from sheaf.sources.syntax import Name, Stream

        document = Document()
        entries = {"Width": 64, "Height": 4, "BitsPerComponent": 1, "ColorSpace": Name("DeviceGray")}
        return data.map(lambda d: int((images.decode(document, Stream(entries, bytes(d))).pixels[..., 0] == 255).sum()))

    return t("documents").select("doc_id", white(F.encode(F.md5(F.encode("text", "UTF-8")), "UTF-8")).alias("white"))
