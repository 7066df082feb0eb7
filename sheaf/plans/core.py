"""More queries of the document core over part's rows: opening, navigation, font and image details, edits."""

from __future__ import annotations

import numpy as np

from sheaf.functions import codecs, colour, crypto, fonts, images, jpeg, numeric
from sheaf.operators import author, content, forms, pages, redact, render, text
from sheaf.plans.rows import _first, _items, _page, row_query
from sheaf.sources.document import Document, classic_section, rebuild_xref, stream_section
from sheaf.sources.syntax import Fault, Name, Ref, Stream, format_indirect, kind_of


def _code(action) -> str | None:
    try:
        action()
    except Fault as fault:
        return fault.code
    return None


# -- opening ------------------------------------------------------------------------------------------


@row_query("src02_open", "text string", "p_name AS text")
def _open(row):
    d = Document(author.document_of(row["p_name"]).save())
    return (text.page_text(d, _first(d)),)


@row_query("src03_open_with_password", "text string, wrong string", "p_name AS text, 'needsPassword' AS wrong")
def _open_with_password(row):
    sealed = author.document_of(row["p_name"]).save(crypto.protect("rc4_40", row["p_brand"], "owner"))
    d = Document(sealed, row["p_brand"])
    return text.page_text(d, _first(d)), _code(lambda: Document(sealed, "no"))


@row_query("src04_open_allowing_encrypted", "leaves int, readable boolean, title string", "1 + p_size % 3 AS leaves, false AS readable, p_name AS title")
def _open_allowing_encrypted(row):
    """The graph can be walked without the key; what is enciphered stays so."""
    d = pages.extract(_page(b""), [0] * (1 + row["p_size"] % 3))
    forms.set_metadata(d, Title=row["p_name"])
    sealed = d.save(crypto.protect("rc4_128", "u", "o"))
    d = Document(sealed, allow_encrypted=True)
    return len(d.page_refs()), forms.metadata(d).get("Title") == row["p_name"], forms.metadata(Document(sealed, "u"))["Title"]


@row_query("src08_xref_stream", "place int, kind int, generation int", "CAST(p_partkey AS INTEGER) AS place, 1 AS kind, p_size AS generation")
def _xref_stream(row):
    """A field of no width for the type means 1; an index that begins at 5."""
    body = row["p_partkey"].to_bytes(4, "big") + bytes([row["p_size"]])
    raw = format_indirect(Ref(9, 0), Stream({"Type": Name("XRef"), "W": [0, 4, 1], "Index": [5, 1], "Size": 6}, body))
    entry = stream_section(raw, 0)[0][5]
    return entry.place, entry.kind, entry.extra


@row_query("src11_last_trailer", "root int, size int", "CAST(p_partkey + 1 AS INTEGER) AS root, CAST(p_partkey + 2 AS INTEGER) AS size")
def _last_trailer(row):
    n = row["p_partkey"] + 1
    _, trailer = rebuild_xref(b"%d 0 obj <<>> endobj trailer <</Root 999 0 R>> trailer <</Root %d 0 R>> trailer <</broken" % (n, n))
    return trailer["Root"].number, trailer["Size"]


@row_query("src07_classic_section", "first int, kinds string", "CAST(p_partkey AS INTEGER) AS first, '1,0' AS kinds")
def _classic_section(row):
    entries, _ = classic_section(b"xref\n%d 2\n0000000015 00000 n \n0000000000 00001 f \ntrailer <<>>" % row["p_partkey"], 0)
    return min(entries), ",".join(str(e.kind) for _, e in sorted(entries.items()))


@row_query("src23_page_content", "joined string, strict string", "'q' || chr(10) || p_size || ' w' AS joined, 'filter' AS strict")
def _page_content(row):
    """A broken stream is passed over, unless strict."""
    d = _page(b"")
    page = {**_first(d), "Contents": [d.add(Stream({}, b"q")), d.add(Stream({"Filter": Name("FlateDecode")}, b"broken")), d.add(Stream({}, b"%d w" % row["p_size"]))]}
    return d.content(page).decode(), _code(lambda: d.content(page, tolerant=False))


@row_query("src25_page_at", "text string, missing string", "p_name AS text, 'range' AS missing")
def _page_at(row):
    d = author.document_of("word " * 1400 + row["p_name"].replace(" ", "_"))
    return text.page_text(d, d.dictionary(d.page_refs()[1])).split()[-1].replace("_", " "), _code(lambda: pages.remove(d, 99))


@row_query("src26_declared_count", "declared int, leaves int", "p_size AS declared, 1 AS leaves")
def _declared_count(row):
    d = _page(b"")
    d.update(d.catalog["Pages"], Count=row["p_size"])
    return d.page_count(), len(d.page_refs())


@row_query("src29_parse_program", "depth int, broken string", "1 + p_size % 4 AS depth, CASE WHEN p_size % 2 = 0 THEN 'function' END AS broken")
def _parse_program(row):
    body = b"1"
    for _ in range(row["p_size"] % 4):
        body = b"dup 0 gt { %s } if" % body
    depth = lambda p: 1 + max([0, *(depth(x) for x in p if isinstance(x, list))])
    return depth(numeric.parse_program(b"{ %s }" % body)), _code(lambda: numeric.parse_program(b"{ %s" % body + b" }" * (row["p_size"] % 2)))


# -- saving -------------------------------------------------------------------------------------------


@row_query("snk01_save_modes", "turned int, turned_incrementally int, prefix boolean, refused string", "p_size % 3 * 90 + 90 AS turned, p_size % 3 * 90 + 90 AS turned_incrementally, true AS prefix, CASE WHEN p_size % 2 = 0 THEN 'residue' END AS refused")
def _save_modes(row):
    d = Document(author.document_of(row["p_name"]).save())
    pages.rotate(d, 0, row["p_size"] % 3 * 90 + 90)
    turned = [x.attributes(_first(x))["rotate"] for x in (Document(b) for b in (d.save(), d.save_incremental()))]
    banned = row["p_name"].encode() if row["p_size"] % 2 == 0 else b"not in it"
    return *turned, d.save_incremental().startswith(d.data), _code(lambda: d.save_sanitized([banned]))


@row_query("snk06_tokens", "name string, real string, text string", "'/a#2Fb' AS name, p_size || '.5' AS real, '(' || p_name || ')' AS text")
def _token_format(row):
    from sheaf.sources.syntax import format_name, format_real, format_string

    return format_name("a/b").decode(), format_real(row["p_size"] + 0.5), format_string(row["p_name"].encode()).decode()


# -- navigation ---------------------------------------------------------------------------------------


@row_query("prj03_typed_accessors", "kinds string, as_number double, as_dictionary int", "'integer,string,name,stream' AS kinds, CAST(p_size AS DOUBLE) AS as_number, 1 AS as_dictionary")
def _typed_accessors(row):
    """An accessor of another type gives nothing; that of dictionaries also takes streams."""
    d = Document()
    stream = Stream({"K": 1}, b"")
    values = [row["p_size"], b"1", Name("n"), stream]
    assert d.number(b"1") is None and d.number(True) is None and d.array(stream) == []
    return ",".join(kind_of(v) for v in values), d.number(values[0]), len(d.dictionary(stream))


@row_query("prj07_decoded_data", "data string, codec string", "p_name AS data, 'unsupportedFeature' AS codec")
def _decoded_data(row):
    d, chain = Document(), [("AHx", {}), ("Fl", {})]
    stream = Stream({"Filter": d.add([Name("AHx"), Name("Fl")])}, codecs.encode(row["p_name"].encode(), chain))
    return d.decoded(stream).decode(), _code(lambda: d.decoded(Stream({"Filter": Name("DCTDecode")}, b"")))


@row_query("prj10_annotation_list", "n int, last string", "1 + p_size % 3 AS n, ['Text', 'Square', 'Circle'][1 + p_size % 3] AS last")
def _annotation_list(row):
    d = _page(b"")
    for kind in ("text", "square", "circle")[: 1 + row["p_size"] % 3]:
        forms.add_annotation(d, d.page_refs()[0], kind, [0, 0, row["p_size"], 9])
    found = forms.annotation_refs(d, d.page_refs()[0])
    return len(found), str(d.dictionary(found[-1])["Subtype"])


@row_query("prj12_terminal_fields", "names string", "p_brand || '.b,' || p_brand || '.' || p_name || ',' || p_type AS names")
def _terminal_fields(row):
    d = Document()
    kids = [d.add({"T": t}) for t in (b"b", row["p_name"].encode())]
    top = [d.add({"T": row["p_brand"].encode(), "Kids": kids}), d.add({"T": row["p_type"].encode(), "FT": Name("Tx")})]
    d.update(d.trailer["Root"], AcroForm={"Fields": top})
    return (",".join(f.name for f in forms.fields(d)),)


@row_query("prj13_field_named", "value string, missing boolean", "p_name AS value, true AS missing")
def _field_named(row):
    d = _page(b"")
    forms.add_field(d, d.page_refs()[0], row["p_brand"], [0, 0, 9, 9], value=row["p_name"])
    return forms.field_named(d, row["p_brand"]).value, forms.field_named(d, "none") is None


@row_query("prj16_widgets", "own int, kids int", "1 AS own, 1 + p_size % 4 AS kids")
def _widgets(row):
    d = _page(b"")
    forms.add_field(d, d.page_refs()[0], "own", [0, 0, 9, 9])
    kids = [d.add({"Subtype": Name("Widget")}) for _ in range(1 + row["p_size"] % 4)]
    form = d.catalog["AcroForm"]
    d.update(form, Fields=[*d.array(d.dictionary(form)["Fields"]), d.add({"T": b"kids", "FT": Name("Btn"), "Kids": kids})])
    return tuple(len(f.widgets) for f in forms.fields(d))


@row_query("prj19_catalog", "kind string, root int, lang string", "'Catalog' AS kind, CAST(3 + p_size % 3 AS INTEGER) AS root, p_name AS lang")
def _catalog(row):
    d = Document()
    root = d.add({"Type": Name("Catalog"), "Pages": d.catalog["Pages"], "Lang": row["p_name"].encode()})
    for _ in range(row["p_size"] % 3):
        root = d.add({**d.dictionary(root)})
    d.trailer["Root"] = root
    return str(d.catalog["Type"]), d.trailer["Root"].number, d.catalog["Lang"].decode()


# -- functions, colours, fonts ------------------------------------------------------------------------


@row_query("fn10_filter_chain", "chain string", "'Fl:' || (10 + p_size % 6) || ',AHx:1' || CASE WHEN p_size % 2 = 0 THEN ',RL:1' ELSE '' END AS chain")
def _filter_chain(row):
    names = [Name("Fl"), Name("AHx"), *[Name("RL")] * (1 - row["p_size"] % 2)]
    found = codecs.chain_of({"Filter": names, "DecodeParms": [{"Predictor": 10 + row["p_size"] % 6}, None]})
    return (",".join(f"{n}:{p.get('Predictor', 1)}" for n, p in found),)


@row_query("fn34_parse_functions", "two double, zero double, four double, unknown string", "round(CAST(p_size / 50.0 AS DOUBLE), 6) AS two, round(CAST(p_size / 50.0 AS DOUBLE), 6) AS zero, round(CAST(least(1, p_size / 25.0) AS DOUBLE), 6) AS four, 'unsupportedFeature' AS unknown")
def _parse_functions(row):
    d, x = Document(), row["p_size"] / 50
    two = {"FunctionType": 2, "N": 1, "Domain": [0, 1]}
    zero = Stream({"FunctionType": 0, "Domain": [0, 1], "Range": [0, 1], "Size": [2], "BitsPerSample": 8}, b"\x00\xff")
    four = Stream({"FunctionType": 4, "Domain": [0, 1], "Range": [0, 1]}, b"{ 2 mul }")
    return *(round(numeric.function_of(d, f)([x])[0], 6) for f in (two, zero, four)), _code(lambda: numeric.function_of(d, {"FunctionType": 1}))


@row_query("fn37_rgb", "r double", "CAST(p_size / 50.0 AS DOUBLE) AS r")
def _rgb(row):
    return (colour.space_of(Document(), [Name("CalRGB"), {"Gamma": [2, 2, 2]}]).rgb([row["p_size"] / 50, 0, 1])[0],)


@row_query("fn40_icc", "n int, r double", "[1, 3, 4, 1][1 + p_size % 4] AS n, round(CAST(CASE WHEN p_size % 4 = 2 THEN (1 - p_size / 50.0) * (1 - p_size / 50.0) ELSE p_size / 50.0 END AS DOUBLE), 6) AS r")
def _icc(row):
    """By the alternate space, else by the number of components; the profile isn't read."""
    n, more = ((1, {}), (3, {}), (4, {}), (1, {"Alternate": Name("DeviceGray")}))[row["p_size"] % 4]
    space = colour.space_of(Document(), [Name("ICCBased"), Stream({"N": n, **more}, b"profile")])
    return space.n, round(space.rgb([row["p_size"] / 50] * n)[0], 6)


@row_query("fn43_pattern_space", "based double, bare double", "CAST(p_size / 50.0 AS DOUBLE) AS based, CAST(0 AS DOUBLE) AS bare")
def _pattern_space(row):
    d = Document()
    return colour.space_of(d, [Name("Pattern"), Name("DeviceGray")]).rgb([row["p_size"] / 50])[0], colour.space_of(d, Name("Pattern")).rgb([1])[0]


@row_query("fn49_codes", "simple int, composite int", "length(p_name) AS simple, (length(p_name) + 1) // 2 AS composite")
def _codes(row):
    d, data = Document(), row["p_name"].encode()
    return len(fonts.Font(d, {"Subtype": Name("Type1")}).glyphs(data)), len(fonts.Font(d, {"Subtype": Name("Type0")}).glyphs(data))


@row_query("fn54_differences", "text string", "['é', '7', '&'][1 + p_size % 3] || chr(66) || '7' AS text")
def _differences(row):
    first = Name(("eacute", "seven", "ampersand")[row["p_size"] % 3])
    font = fonts.Font(Document(), {"Subtype": Name("Type1"), "Encoding": {"Differences": [65, first, 67, Name("seven")]}})
    return ("".join(g[2] for g in font.glyphs(b"ABC")),)


@row_query("fn56_cmap_order", "single int, first int, none int", "7 AS single, 100 + p_size AS first, 0 AS none")
def _cmap_order(row):
    """Single codes before ranges, the first range before later ones."""
    cmap = fonts.CMap([(2, 0, 0xFFFF)], {(2, 300): 7}, [(2, 0, 255, 100), (2, 0, 300, 500)])
    return cmap.cid(300, 2), cmap.cid(row["p_size"], 2), cmap.cid(999, 2)


@row_query("fn57_helvetica", "base string, encoding string, text string", "'Helvetica' AS base, 'WinAnsiEncoding' AS encoding, p_name || 'é' AS text")
def _helvetica(row):
    font = fonts.helvetica()
    shown = fonts.Font(Document(), font).glyphs((row["p_name"] + "é").encode("cp1252"))
    return str(font["BaseFont"]), str(font["Encoding"]), "".join(g[2] for g in shown)


# -- crypto -------------------------------------------------------------------------------------------


@row_query("fn62_encryption_entries", "version string, other string", "['1.2', '2.3', '4.4', '5.6'][1 + p_size % 4] AS version, CASE WHEN p_size % 2 = 0 THEN 'unsupportedFeature' ELSE 'crypto' END AS other")
def _encryption_entries(row):
    made = crypto.protect(("rc4_40", "rc4_128", "aes128", "aes256")[row["p_size"] % 4], row["p_brand"], "o").entries
    changed = (b"/Filter /Standard", b"/Filter /Elsewhere") if row["p_size"] % 2 == 0 else (b"/R 2", b"/R /Two")
    sealed = Document().save(crypto.protect("rc4_40", "u", "o")).replace(*changed)
    return f"{made['V']}.{made['R']}", _code(lambda: Document(sealed, "u"))


@row_query("fn64_hash_r6", "size int, same boolean, salted boolean", "32 AS size, p_size % 3 = 0 AS same, p_size % 2 = 0 AS salted")
def _hash_r6(row):
    """Equal for equal passwords and salts only."""
    found = crypto.hash_r6(b"p%d" % (row["p_size"] % 3), b"saltsalt")
    return len(found), found == crypto.hash_r6(b"p0", b"saltsalt"), crypto.hash_r6(row["p_name"].encode(), b"salt%d" % (row["p_size"] % 2)) == crypto.hash_r6(row["p_name"].encode(), b"salt0")


@row_query("fn67_object_cipher", "text string, raw string, differs boolean", "p_name AS text, p_brand AS raw, true AS differs")
def _object_cipher(row):
    """Strings and bodies each under the object's own key."""
    security = crypto.protect("aes128", "u", "o")
    value = Stream({"T": row["p_name"].encode()}, row["p_brand"].encode())
    sealed = security.encrypt(Ref(5, 0), value)
    back = security.decrypt(Ref(5, 0), sealed)
    return back.entries["T"].decode(), back.raw.decode(), crypto.object_key(security.key, Ref(5, 0), True) != crypto.object_key(security.key, Ref(6, 0), True)


@row_query("ud02_cipher_hook", "text string", "p_name AS text")
def _cipher_hook(row):
    """A document takes any object with decrypt and encrypt."""
    class Shift:
        def decrypt(self, ref, value):
            return bytes((b - 1) & 255 for b in value) if isinstance(value, bytes) else value

    d = Document(Document().save())
    data = format_indirect(Ref(50, 0), bytes((b + 1) & 255 for b in row["p_name"].encode()))
    d.entries[50] = d.entries[1]._replace(place=len(d.data))
    d.data, d.security = d.data + data, Shift()
    return (d.get(50).decode(),)


# -- images -------------------------------------------------------------------------------------------


def _image(raw: bytes, **entries) -> Stream:
    return Stream({"Width": 2, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray"), **entries}, raw)


@row_query("fn72_colour_key", "alphas string", "CASE WHEN p_size BETWEEN 10 AND 20 THEN '0,255' ELSE '255,255' END AS alphas")
def _colour_key(row):
    pixels = images.decode(Document(), _image(bytes([row["p_size"], 99]), Mask=[10, 20])).pixels
    return (",".join(map(str, pixels[0, :, 3].tolist())),)


@row_query("fn73_samples", "values string", "(p_size // 16) || ',' || (p_size % 16) || ',0' AS values")
def _samples(row):
    """High bits first, rows begin at a byte, zero beyond the data."""
    found = images.samples(bytes([row["p_size"]]), 3, 1, 1, 4)
    return (",".join(str(int(v)) for v in found.ravel()),)


@row_query("fn74_pixels", "size int, first string", "4 * (1 + p_size % 3) AS size, CASE WHEN p_size % 2 = 0 THEN 'ff' ELSE '00' END AS first")
def _pixels(row):
    raster = images.decode(Document(), _image((b"\xff", b"\x00")[row["p_size"] % 2] * 3, Width=1 + row["p_size"] % 3))
    return len(raster.tobytes()), raster.tobytes()[:1].hex()


@row_query("fn75_dct_images", "size string, gray int, code string", "CASE WHEN p_size % 3 < 2 THEN (p_size + 1) || 'x9' END AS size, CASE WHEN p_size % 3 < 2 THEN p_size * 5 END AS gray, CASE WHEN p_size % 3 = 2 THEN 'unsupportedFeature' END AS code")
def _dct_images(row):
    """Baseline images of one gray, or of three equal colours, to within a step; JPX isn't read."""
    n = (1, 3, 0)[row["p_size"] % 3]
    if not n:
        return None, None, _code(lambda: images.decode(Document(), _image(b"ab", Filter=Name("JPXDecode"))))
    raw = jpeg.encode(np.full((9, row["p_size"] + 1, n), row["p_size"] * 5, np.uint8))
    entries = {"Filter": Name("DCTDecode"), "ColorSpace": Name("DeviceGray" if n == 1 else "DeviceRGB"), "BitsPerComponent": 8, "Width": 1, "Height": 1}
    raster = images.decode(Document(), Stream(entries, raw))
    near = np.abs(raster.pixels[..., :3].astype(int) - row["p_size"] * 5).max() <= 1
    return f"{raster.width}x{raster.height}", row["p_size"] * 5 if near else -1, None


# -- content ------------------------------------------------------------------------------------------


@row_query("ct01_state_stack", "xs string", "'0,' || p_size || ',0' AS xs")
def _state_stack(row):
    """An unmatched Q is ignored."""
    items = _items(b"Q BT /F1 9 Tf (a) Tj ET q 1 0 0 1 %d 0 cm BT (b) Tj ET Q BT (c) Tj ET Q" % row["p_size"])
    return (",".join(str(round(i.glyphs[0].x)) for i in items),)


@row_query("ct03_line_width", "widths string", "(p_size + 1) || ',' || p_size AS widths")
def _line_width(row):
    """A width holds until the state that it belongs to ends."""
    items = _items(b"%d w /G0 gs q %d w 0 0 m 1 1 l S Q 0 0 m 1 1 l S" % (row["p_size"], row["p_size"] + 1))
    return (",".join(str(int(i.line_width)) for i in items),)


@row_query("ct05_painting", "paint string, rule string", "['f', 'F', 'f*', 'S', 's', 'B', 'B*', 'b', 'b*', NULL][1 + p_size % 10] AS paint, ['nonzero', 'nonzero', 'evenodd', '', '', 'nonzero', 'evenodd', 'nonzero', 'evenodd', NULL][1 + p_size % 10] AS rule")
def _painting(row):
    op = (b"f", b"F", b"f*", b"S", b"s", b"B", b"B*", b"b", b"b*", b"n")[row["p_size"] % 10]
    items = _items(b"0 0 m %d 1 l %s 0 0 m W n" % (row["p_size"], op))
    return (items[0].paint, items[0].name) if items else (None, None)


# -- edits --------------------------------------------------------------------------------------------


@row_query("mu07_appearance_states", "states string, shown string", "'Off,S' || p_size AS states, CASE WHEN p_size % 2 = 0 THEN 'S' || p_size ELSE 'Off' END AS shown")
def _appearance_states(row):
    d, state = _page(b""), f"S{row['p_size']}"
    ref = forms.add_field(d, d.page_refs()[0], row["p_brand"], [0, 0, 9, 9], "Btn", states=(state,))
    if row["p_size"] % 2 == 0:
        forms.set_value(d, forms.field_named(d, row["p_brand"]), state)
    entries = d.dictionary(ref)
    return ",".join(sorted(d.dictionary(d.dictionary(entries["AP"])["N"]))), str(entries["AS"])


@row_query("mu11_need_appearances", "value boolean", "CASE WHEN p_size % 2 = 0 THEN true END AS value")
def _need_appearances(row):
    d = _page(b"")
    forms.add_field(d, d.page_refs()[0], row["p_brand"], [0, 0, 9, 9])
    if row["p_size"] % 2 == 0:
        forms.need_appearances(d)
    return (d.dictionary(d.catalog["AcroForm"]).get("NeedAppearances"),)


@row_query("mu14_read_marks", "quads int, rect int, x1 double", "1 + p_size % 3 AS quads, 1 AS rect, CAST(p_size AS DOUBLE) AS x1")
def _read_marks(row):
    d = _page(b"")
    page, n = d.page_refs()[0], float(row["p_size"])
    many = redact.mark(d, page, [0, 0, n, n], quads=[[i, n, i + n, n, i, 0, i + n, 0] for i in range(1 + row["p_size"] % 3)])
    one = d.add({"Subtype": Name("Redact"), "Rect": [0, 0, n, n], "QuadPoints": [1, 2, 3]})
    return len(redact.region_of(d, many).boxes), len(redact.region_of(d, one).boxes), redact.region_of(d, one).boxes[0][2]


@row_query("mu15_excision", "text string, kept string", "'' AS text, p_brand AS kept")
def _excision(row):
    d = _page(b"BT /F1 10 Tf 20 700 Td (%s) Tj ET BT /F1 10 Tf 20 100 Td (%s) Tj ET 15 695 m 500 695 l S" % (row["p_name"].encode(), row["p_brand"].encode()))
    redact.mark(d, d.page_refs()[0], [10, 690, 500, 720])
    removed = redact.apply_page(d, d.page_refs()[0])
    assert "".join(removed).replace(" ", "") == row["p_name"].replace(" ", "")
    shown = text.page_text(d, _first(d))
    return "".join(c for c in shown if c in row["p_name"] and c not in row["p_brand"]), "".join(w for w in shown.split() if w == row["p_brand"])


@row_query("mu17_operands_verbatim", "again string", "'BI /W 2 /H 1 ID ' || p_name || chr(10) || 'EI' AS again")
def _operands_verbatim(row):
    op, operands = next(content.lexemes(b"BI /W 2 /H 1 ID %s EI " % row["p_name"].encode()))
    return (content.operation_bytes(op, operands).decode(),)


@row_query("fn26_crop_in_media", "crop string", "'0,0,' || least(p_size, 30) || ',' || 9 AS crop")
def _crop_in_media(row):
    d = _page(b"")
    d.update(d.page_refs()[0], MediaBox=[0, 0, 30, 9], CropBox=[row["p_size"], 50, -5, -5])
    return (",".join(str(int(v)) for v in d.attributes(_first(d))["crop"]),)


@row_query("ag04_occurrences", "n int", "CAST((length(p_name) - length(replace(p_name, 'e', ''))) AS INTEGER) AS n")
def _occurrences(row):
    d = _page(b"BT /F1 10 Tf 20 700 Td (%s) Tj ET" % row["p_name"].encode())
    return (len(text.search(text.page_blocks(d, _first(d)), "e")),)
