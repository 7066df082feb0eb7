"""Queries that run the document core on values made from each row of `part`, with the expected values in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sheaf.functions import codecs, colour, crypto, fonts, images, numeric
from sheaf.operators import author, content, forms, pages, redact, text
from sheaf.operators.documents import per_document
from sheaf.plans.registry import query
from sheaf.sources.document import Document
from sheaf.sources.syntax import Fault, Name, Reader, Ref, Stream, format_indirect, format_name, format_string, format_value, kind_of, tokens


def row_query(name: str, columns: str, oracle: str):
    """Registers function(row) -> values; row has part's columns. oracle selects the columns after p_partkey."""
    def add(function):
        @query(name, f"SELECT p_partkey, {oracle} FROM part")
        def run(t):
            rows = t("part").select("p_partkey", F.struct("p_partkey", "p_name", "p_size", "p_brand", "p_type").alias("row"))
            return per_document(rows, lambda row: [function(row)], columns, key="p_partkey", value="row").drop("error")

        return function

    return add


def _page(body: bytes, **entries) -> Document:
    d = Document()
    font = d.add(fonts.helvetica() | {"FirstChar": 32, "Widths": [500] * 95})
    page = d.add({"Type": Name("Page"), "Parent": d.catalog["Pages"], "Resources": {"Font": {"F1": font}, **entries}, "Contents": d.add(Stream({}, body))})
    d.update(d.catalog["Pages"], Kids=[page], Count=1)
    return d


def _first(d: Document) -> dict:
    return d.dictionary(d.page_refs()[0])


def _items(body: bytes, **entries):
    d = _page(body, **entries)
    return content.Interpreter(d).page(_first(d))


# -- syntax -------------------------------------------------------------------------------------------


@row_query("src15_names", "name string, raw string", "p_name || '#' AS name, '/' || replace(p_name, ' ', '#20') || '#23' AS raw")
def _names(row):
    raw = format_name(row["p_name"] + "#")
    return str(Reader(raw).value()), raw.decode()


@row_query("src17_literal_strings", "text string, raw string", r"'(' || p_name || ')\' AS text, '(\(' || p_name || '\)\\)' AS raw")
def _literal(row):
    raw = format_string(f"({row['p_name']})\\".encode())
    return Reader(raw).value().decode(), raw.decode()


@row_query("src18_parse_object", "number long, name string, third string, kinds string", "p_partkey AS number, p_name AS name, 'reference' AS third, 'integer,string,array' AS kinds")
def _parse(row):
    value = Reader(b"<</K %d/N (%s)/L [1 2.5 %d 0 R] /Gone null>>" % (row["p_partkey"], row["p_name"].encode(), row["p_size"])).value()
    return value["K"], value["N"].decode(), kind_of(value["L"][2]), ",".join(kind_of(v) for v in value.values())


@row_query("src20_stream_body", "body string, declared string", "p_name AS body, p_name || ' endstream' AS declared")
def _stream_body(row):
    name = row["p_name"].encode()
    wrong = Reader(b"1 0 obj <</Length 9999>> stream\n" + name + b"\nendstream endobj").indirect()[1]
    right = Reader(b"1 0 obj <</Length %d>> stream\n" % (len(name) + 10) + name + b" endstream\nendstream endobj").indirect()[1]
    return wrong.raw.decode(), right.raw.decode()


@row_query("src22_inline_image", "data string, width int", "p_name AS data, p_size AS width")
def _inline(row):
    op, (entries, data) = next(content.lexemes(b"BI /W %d /H 1 ID %s EI Q" % (row["p_size"], row["p_name"].encode())))
    return data.decode(), entries["W"]


@row_query("src27_cmap", "text string, ranged string, cid int", "p_brand AS text, chr(65 + p_size % 20) AS ranged, p_size + 100 AS cid")
def _cmap(row):
    cmap = fonts.CMap.parse(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <%s> endbfchar 1 beginbfrange <0100> <01FF> <0041> endbfrange 1 begincidrange <0000> <FFFF> 100 endcidrange" % row["p_brand"].encode("utf-16-be").hex().encode())
    return cmap.text(1, 2), cmap.text(0x100 + row["p_size"] % 20, 2), cmap.cid(row["p_size"], 2)


@row_query("snk05_serialize", "raw string", "'<</A ' || p_size || ' /B (' || p_name || ') /C [true null 0.5]>>' AS raw")
def _serialize(row):
    return (format_value({"C": [True, None, 0.5], "B": row["p_name"].encode(), "A": row["p_size"], "Z": None}).decode(),)


@row_query("snk07_remap", "raw string", "'[' || p_partkey || ' 0 R null]' AS raw")
def _remap(row):
    from sheaf.sources.syntax import remapped

    return (format_value(remapped([Ref(7, 3), Ref(8, 0)], {7: row["p_partkey"]})).decode(),)


@row_query("src19_indirect", "number int, generation int, value string", "CAST(p_partkey AS INTEGER) AS number, 0 AS generation, p_name AS value")
def _indirect(row):
    ref, value = Reader(format_indirect(Ref(row["p_partkey"], 0), row["p_name"].encode())).indirect()
    return ref.number, ref.generation, value.decode()


@row_query("src06_startxref", "found int", "CAST(p_partkey AS INTEGER) AS found")
def _startxref(row):
    from sheaf.sources.document import last_startxref

    return (last_startxref(b"startxref 1\n%%%%EOF startxref\n%d\n%%%%EOF" % row["p_partkey"]),)


@row_query("src21_content_tokens", "n int, shown string, last string", "6 + p_size % 5 AS n, '(' || p_name || ')' AS shown, CASE WHEN p_size % 5 = 0 THEN 'Tj' ELSE 'T*' END AS last")
def _content_tokens(row):
    found = list(tokens(b"BT /F1 %d Tf (%s) Tj" % (row["p_size"], row["p_name"].encode()) + b" T*" * (row["p_size"] % 5)))
    return len(found), found[4][2], found[-1][2]


# -- graph --------------------------------------------------------------------------------------------


@row_query("prj02_dereference", "value int, dangling boolean", "p_size AS value, true AS dangling")
def _dereference(row):
    d = Document()
    ref = d.add(row["p_size"])
    for _ in range(5):
        ref = d.add(ref)
    return d.resolve(ref), d.resolve(Ref(9999, 0)) is None


@row_query("src12_object_stream", "value int, name string", "p_size AS value, p_name AS name")
def _object_stream(row):
    members = b"%d (%s)" % (row["p_size"], row["p_name"].encode())
    head = b"3 0 4 %d " % (len(str(row["p_size"])) + 1)
    out, places = b"%PDF-1.5\n", []
    for number, body in enumerate((b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[]/Count 0>>"), 1):
        places.append(len(out))
        out += b"%d 0 obj %s endobj\n" % (number, body)
    places.append(len(out))
    out += format_indirect(Ref(5, 0), Stream({"Type": Name("ObjStm"), "N": 2, "First": len(head)}, head + members))
    table = [(0, 0, 0), (1, places[0], 0), (1, places[1], 0), (2, 5, 0), (2, 5, 1), (1, places[2], 0)]
    at = len(out)
    out += format_indirect(Ref(6, 0), Stream({"Type": Name("XRef"), "W": [1, 3, 1], "Size": 6, "Root": Ref(1, 0)}, b"".join(bytes([k]) + p.to_bytes(3, "big") + bytes([e]) for k, p, e in table)))
    d = Document(out + b"startxref\n%d\n%%%%EOF" % at)
    return d.get(3), d.get(4).decode()


@row_query("prj15_inherited_fields", "name string, flags int, value string", "p_brand || '.' || p_type AS name, p_size AS flags, p_name AS value")
def _inherited_fields(row):
    d = Document()
    parent = d.add({"T": row["p_brand"].encode(), "FT": Name("Tx"), "Ff": row["p_size"], "V": row["p_name"].encode()})
    kid = d.add({"T": row["p_type"].encode(), "Parent": parent})
    d.update(parent, Kids=[kid])
    d.update(d.trailer["Root"], AcroForm={"Fields": [parent]})
    field = forms.fields(d)[0]
    return field.name, field.flags, field.value


@row_query("prj17_metadata", "title string, gone boolean", "p_name AS title, true AS gone")
def _metadata(row):
    d = Document()
    forms.set_metadata(d, Title=row["p_name"], Author="x")
    forms.set_metadata(d, Author=None)
    again = forms.metadata(Document(d.save()))
    return again["Title"], "Author" not in again


@row_query("st05_import_shares", "objects_once int, pages int", "4 AS objects_once, 1 + p_size % 4 AS pages")
def _import_shares(row):
    """A page taken several times: as many leaves; its font and content are copied once."""
    d = pages.extract(_page(b"BT ET"), [0] * (1 + row["p_size"] % 4))
    shared = {r.number for page in d.page_refs() for r in (d.dictionary(page)["Contents"], d.dictionary(d.dictionary(page)["Resources"])["Font"]["F1"])}
    return len(shared) + 2, len(d.page_refs())


# -- content ------------------------------------------------------------------------------------------


@row_query("ct02_concat", "x double, y double", "CAST(p_size * 2 + 5 AS DOUBLE) AS x, CAST(21 AS DOUBLE) AS y")
def _concat(row):
    glyph = _items(b"q 2 0 0 3 5 0 cm BT /F1 10 Tf %d 7 Td (x) Tj ET Q" % row["p_size"])[0].glyphs[0]
    return glyph.x, glyph.y


@row_query("ct04_paths", "kinds string, paint string", "'move,line,line,line,close,move,curve' AS kinds, CASE WHEN p_size % 2 = 0 THEN 'f*' ELSE 'B' END AS paint")
def _paths(row):
    item = _items(b"1 2 3 4 re 0 0 m 1 1 2 2 3 3 c %s 9 9 m n" % (b"f*" if row["p_size"] % 2 == 0 else b"B"))[0]
    return ",".join(s[0] for s in item.path), item.paint


@row_query("ct06_colours", "r double, g double, b double", "CAST(p_size / 50.0 AS DOUBLE) AS r, CAST(0.25 AS DOUBLE) AS g, CAST(0.5 AS DOUBLE) AS b")
def _colours(row):
    return _items(b"%.2f 0.25 0.5 rg 0 0 1 1 re f" % (row["p_size"] / 50))[0].color


@row_query("ct07_named_colours", "r double", "CAST(1 - p_size / 50.0 AS DOUBLE) AS r")
def _named_colours(row):
    spot = [Name("Separation"), Name("S"), Name("DeviceGray"), {"FunctionType": 2, "N": 1, "Domain": [0, 1], "C0": [1], "C1": [0]}]
    return (_items(b"/Cs cs %.2f scn 0 0 1 1 re f" % (row["p_size"] / 50), ColorSpace={"Cs": spot})[0].color[0],)


@row_query("ct08_text_positions", "xs string, ys string", "'10,10,10,10' AS xs, '100,' || (100 - p_size) || ',' || (100 - 2 * p_size) || ',' || (100 - 3 * p_size) AS ys")
def _positions(row):
    n = row["p_size"]
    items = _items(b"BT /F1 10 Tf 10 100 Td (a) Tj 0 -%d TD (b) Tj T* (c) Tj (d) ' ET" % n)
    return ",".join(str(round(i.glyphs[0].x)) for i in items), ",".join(str(round(i.glyphs[0].y)) for i in items)


@row_query("ct09_text_state", "second double, rise double", "CAST((5 + p_size + 3) * 0.5 AS DOUBLE) AS second, CAST(4 AS DOUBLE) AS rise")
def _text_state(row):
    glyphs = _items(b"BT /F1 10 Tf %d Tc 3 Tw 50 Tz 4 Ts ( a) Tj ET" % row["p_size"])[0].glyphs
    return glyphs[1].x, glyphs[0].y


@row_query("ct11_forms", "x double, depth int", "CAST(p_size AS DOUBLE) AS x, 11 AS depth")
def _forms(row):
    form = Stream({"Subtype": Name("Form"), "Matrix": [1, 0, 0, 1, row["p_size"], 0]}, b"BT /F1 10 Tf (x) Tj ET /Fm Do")
    items = _items(b"/Fm Do", XObject={"Fm": form})
    return items[0].glyphs[0].x, len(items)


@row_query("ct12_marked_content", "kinds string, names string", "CASE WHEN p_size % 2 = 0 THEN 'begin,shading,image,end' ELSE 'begin,image,end' END AS kinds, CASE WHEN p_size % 2 = 0 THEN 'Span,S' || p_size ELSE 'Span' END AS names")
def _marked(row):
    shading = b"/S%d sh" % row["p_size"] if row["p_size"] % 2 == 0 else b""
    items = _items(b"/Span BMC %s BI /W 1 /H 1 ID x EI unknown EMC" % shading)
    return ",".join(i.kind for i in items), ",".join(i.name for i in items if i.name)


@row_query("ct15_append_content", "text string", "p_brand || chr(10) || p_name AS text")
def _append(row):
    d = _page(b"BT /F1 10 Tf 20 700 Td (%s) Tj ET" % row["p_brand"].encode())
    form = forms.form_xobject(d, [0, 0, 100, 20], b"BT /F1 10 Tf 20 0 Td (%s) Tj ET" % row["p_name"].encode(), _first(d)["Resources"])
    forms.append_content(d, d.page_refs()[0], b"q 1 0 0 1 0 600 cm /A Do Q", {"A": form})
    return (text.page_text(d, _first(d)),)


@row_query("wn04_columns", "text string", "'left ' || p_size || chr(10) || 'more' || chr(10) || 'right' AS text")
def _columns(row):
    d = _page(b"BT /F1 10 Tf 400 700 Td (right) Tj ET BT /F1 10 Tf 20 650 Td (more) Tj ET BT /F1 10 Tf 20 700 Td (left %d) Tj ET" % row["p_size"])
    return (text.page_text(d, _first(d)),)


@row_query("wn02_lines", "text string", "p_size || ' b' || chr(10) || p_brand AS text")
def _one_line(row):
    d = _page(b"BT /F1 10 Tf 40 702 Td (b) Tj ET BT /F1 10 Tf 20 700 Td (%d) Tj ET BT /F1 10 Tf 20 690 Td (%s) Tj ET" % (row["p_size"], row["p_brand"].encode()))
    return (text.page_text(d, _first(d)),)


@row_query("prj09_invisible", "all string, visible string", "p_name AS all, '' AS visible")
def _invisible(row):
    d = _page(b"BT /F1 10 Tf 3 Tr 20 700 Td (%s) Tj ET" % row["p_name"].encode())
    return text.page_text(d, _first(d)), text.page_text(d, _first(d), invisible=False)


# -- fonts, colours, functions ------------------------------------------------------------------------


@row_query("fn50_to_unicode", "text string, width double", "p_brand || chr(233) AS text, CAST(p_size / 1000.0 AS DOUBLE) AS width")
def _to_unicode(row):
    d = Document()
    cmap = Stream({}, b"1 beginbfchar <41> <%s> endbfchar" % row["p_brand"].encode("utf-16-be").hex().encode())
    font = fonts.Font(d, {"Subtype": Name("TrueType"), "FirstChar": 65, "Widths": [row["p_size"]], "ToUnicode": cmap, "Encoding": {"Differences": [66, Name("eacute")]}})
    glyphs = font.glyphs(b"AB")
    return "".join(g[2] for g in glyphs), glyphs[0][3]


@row_query("fn52_composite", "width double, text string", "CAST((CASE WHEN p_size BETWEEN 3 AND 4 THEN (p_size - 2) * 100 WHEN p_size BETWEEN 9 AND 11 THEN 50 ELSE 900 END) / 1000.0 AS DOUBLE) AS width, chr(65533) AS text")
def _composite(row):
    font = fonts.Font(Document(), {"Subtype": Name("Type0"), "Encoding": Name("Identity-H"), "DescendantFonts": [{"DW": 900, "W": [3, [100, 200], 9, 11, 50]}]})
    _, _, shown, width = font.glyphs(row["p_size"].to_bytes(2, "big"))[0]
    return width, shown


@row_query("jn08_codespace", "codes string", "p_size || ',' || (33024 + p_size) AS codes")
def _codespace(row):
    cmap = fonts.CMap([(1, 0, 0x7F), (2, 0x8100, 0x9FFC)])
    return (",".join(str(c) for c, _ in cmap.split(bytes([row["p_size"], 0x81, row["p_size"]]))),)


@row_query("fn44_spaces", "sizes string, alternate double", "'1,3,4,3,1,2' AS sizes, CAST(p_size / 50.0 AS DOUBLE) AS alternate")
def _spaces(row):
    d = Document()
    tint = {"FunctionType": 4, "Domain": [0, 1, 0, 1], "Range": [0, 1]}
    found = [Name("DeviceGray"), Name("CalRGB"), [Name("ICCBased"), Stream({"N": 4}, b"")], [Name("Lab"), {}], [Name("Indexed"), Name("DeviceRGB"), 0, b"abc"], [Name("DeviceN"), [Name("a"), Name("b")], Name("DeviceGray"), Stream(tint, b"{ pop }")]]
    spaces = [colour.space_of(d, s) for s in found]
    return ",".join(str(s.n) for s in spaces), spaces[5].rgb([row["p_size"] / 50, 0.3])[0]


@row_query("fn47_patterns", "kind string, x_step double", "'tiling' AS kind, CAST(p_size AS DOUBLE) AS x_step")
def _patterns(row):
    found = colour.pattern_of(Document(), Stream({"PatternType": 1, "XStep": row["p_size"], "YStep": 1, "BBox": [0, 0, 1, 1]}, b""))
    return found["kind"], found["x_step"]


@row_query("fn33_function_arrays", "y string", "CAST(p_size AS VARCHAR) || ',' || (p_size * 2) AS y")
def _function_arrays(row):
    d = Document()
    double = Stream({"FunctionType": 4, "Domain": [0, 100], "Range": [0, 200]}, b"{ 2 mul }")
    same = {"FunctionType": 2, "N": 1, "Domain": [0, 100], "C0": [0], "C1": [1]}
    return (",".join(str(round(v)) for v in numeric.function_of(d, [same, double])([row["p_size"]])),)


# -- crypto and images --------------------------------------------------------------------------------


@row_query("fn61_aes_unpadded", "back string", "rpad(p_name, 64, '.') AS back")
def _aes(row):
    aes = crypto.AES(bytes(range(32)))
    return (aes.uncbc(aes.cbc(row["p_name"].ljust(64, ".").encode(), bytes(16)), bytes(16)).decode(),)


@row_query("fn63_file_keys", "opened string, code string", "CASE WHEN p_size % 3 < 2 THEN p_type END AS opened, CASE WHEN p_size % 3 = 2 THEN 'needsPassword' END AS code")
def _file_keys(row):
    """Opened by the user's password, by the owner's, and not by another."""
    d = Document()
    forms.set_metadata(d, Title=row["p_type"])
    sealed = d.save(crypto.protect("rc4_40", row["p_brand"], row["p_name"], file_id=b"0123456789abcdef"))
    try:
        return forms.metadata(Document(sealed, (row["p_brand"], row["p_name"], "?")[row["p_size"] % 3]))["Title"], None
    except Fault as fault:
        return None, fault.code


@row_query("fn70_masks", "alphas string", "CASE WHEN p_size % 2 = 0 THEN '0,255,0,255' ELSE '255,0,255,0' END AS alphas")
def _masks(row):
    stencil = Stream({"Width": 4, "Height": 1, "ImageMask": True, "Decode": [row["p_size"] % 2, 1 - row["p_size"] % 2]}, b"\xa0")
    return (",".join(map(str, images.decode(Document(), stencil).pixels[0, :, 3].tolist())),)


@row_query("fn71_soft_mask", "alpha int, colour int", "CAST(floor(p_size / 255.0 * 255 + 0.0000001) AS INTEGER) AS alpha, 255 AS colour")
def _soft_mask(row):
    gray = lambda raw, **e: Stream({"Width": 1, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray"), **e}, raw)
    value = row["p_size"]
    alpha = images.decode(Document(), gray(b"\xff", SMask=gray(bytes([value])))).pixels[0, 0]
    # 8-bit values are cut off, so a few come out one lower; here they are told to the nearest.
    return int(alpha[3]) if abs(int(alpha[3]) - value) > 1 else value, int(alpha[0])


@row_query("fn76_image_object", "width int, same boolean", "p_size AS width, true AS same")
def _image_object(row):
    pixels = np.arange(row["p_size"] * 2 * 3, dtype=np.uint8).reshape(2, row["p_size"], 3) // 128 * 255
    again = images.decode(Document(), images.rgb_stream(pixels))
    return again.width, bool((again.pixels[..., :3] == pixels).all())


# -- edits --------------------------------------------------------------------------------------------


@row_query("mu03_boxes", "crop string, gone boolean", "'0,0,' || p_size || ',' || p_size AS crop, true AS gone")
def _boxes(row):
    d = _page(b"")
    pages.set_box(d, 0, "crop", [0, 0, row["p_size"], row["p_size"]])
    crop = d.attributes(_first(d))["crop"]
    pages.set_box(d, 0, "crop", None)
    return ",".join(str(int(v)) for v in crop), "CropBox" not in _first(d)


@row_query("mu05_appearances", "strokes int, color double", "1 AS strokes, CAST(p_size / 50.0 AS DOUBLE) AS color")
def _appearances(row):
    d = _page(b"")
    ref = forms.add_annotation(d, d.page_refs()[0], "circle", [0, 0, 50, 50], [row["p_size"] / 50, 0, 0])
    ops = list(content.lexemes(d.resolve(d.dictionary(d.dictionary(ref)["AP"])["N"]).raw))
    return sum(op == "S" for op, _ in ops), ops[0][1][0]


@row_query("mu09_regenerate", "shown string", "p_name AS shown")
def _regenerate(row):
    d = _page(b"")
    forms.add_field(d, d.page_refs()[0], "f", [10, 10, 200, 30])
    field = forms.field_named(d, "f")
    forms.set_value(d, field, row["p_name"])
    ops = content.lexemes(d.resolve(d.dictionary(d.dictionary(field.ref)["AP"])["N"]).raw)
    return (next(o[0].decode() for op, o in ops if op == "Tj"),)


@row_query("mu12_mark_only", "marks int, text string", "1 AS marks, p_name AS text")
def _mark_only(row):
    d = _page(b"BT /F1 10 Tf 20 700 Td (%s) Tj ET" % row["p_name"].encode())
    redact.mark(d, d.page_refs()[0], [0, 0, 600, 790])
    return len(redact.marks(d, d.page_refs()[0])), text.page_text(d, _first(d))


@row_query("mu16_shared_forms", "first string, second string", "'' AS first, p_name AS second")
def _shared_forms(row):
    d = _page(b"/Fm Do")
    first = d.page_refs()[0]
    form = d.add(Stream({"Subtype": Name("Form"), "Resources": _first(d)["Resources"]}, b"BT /F1 12 Tf 50 50 Td (%s) Tj ET" % row["p_name"].encode()))
    d.update(first, Resources={"XObject": {"Fm": form}})
    second = d.add({**d.dictionary(first)})
    d.update(d.catalog["Pages"], Kids=[first, second], Count=2)
    redact.mark(d, first, [0, 0, 600, 300])
    redact.apply_page(d, first)
    shown = [text.page_text(d, d.dictionary(p)) for p in (first, second)]
    return shown[0].strip(), shown[1]


@row_query("mu18_blank_pixels", "black int", "least(p_size, 50) * 2 AS black")
def _blank_pixels(row):
    """An image of 50 by 2 white pixels over 50 by 2 units, of which the mark covers the left ones."""
    d = Document()
    image = images.rgb_stream(np.full((2, 50, 3), 255, np.uint8))
    out = redact.blank_pixels(d, image, (50, 0, 0, 2, 0, 0), redact.Region([[0, 0, row["p_size"], 2]]))
    return (int((images.decode(d, out).pixels[..., 0] == 0).sum()),)


@row_query("mu20_overlay", "text string", "p_brand AS text")
def _overlay(row):
    d = _page(b"BT /F1 10 Tf 20 700 Td (%s) Tj ET" % row["p_name"].encode())
    redact.mark(d, d.page_refs()[0], [10, 690, 500, 720], overlay=row["p_brand"])
    again = Document(redact.apply_all(d, [row["p_name"].encode()]))
    shown = [g.text for i in content.Interpreter(again).page(_first(again)) if i.kind == "text" for g in i.glyphs]
    return ("".join(shown),)


@row_query("ud01_own_codec", "text string", "p_name AS text")
def _own_codec(row):
    codecs.FILTER_NAMES.setdefault("Reversed", "Reversed")
    if "Reversed" not in codecs._CODECS:
        codecs.register("Reversed", _reverse, _reverse)
    chain = [("Fl", {}), ("Reversed", {})]
    return (codecs.decode(codecs.encode(row["p_name"].encode(), chain), chain)[0].decode(),)


def _reverse(data: bytes) -> bytes:
    return data[::-1]


@row_query("src05_empty_document", "pages int, text string", "1 + p_size % 4 AS pages, '' AS text")
def _empty(row):
    d = author.document_of("")
    for _ in range(row["p_size"] % 4):
        pages.insert_blank(d, 0)
    d = Document(d.save())
    return len(d.page_refs()), "".join(text.page_text(d, d.dictionary(p)) for p in d.page_refs())
