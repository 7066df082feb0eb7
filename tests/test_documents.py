import pytest

from sheaf.functions import colour, crypto, fonts, images, numeric
from sheaf.functions.fonts import CMap
from sheaf.operators import author, content, forms, pages, redact, render, text
from sheaf.sources.document import Document
from sheaf.sources.syntax import Fault, Name, Ref, Stream


def one_page(body: bytes, **resources) -> Document:
    d = Document()
    font = d.add(fonts.helvetica() | {"FirstChar": 32, "Widths": [500] * 95})
    page = d.add({"Type": Name("Page"), "Parent": d.catalog["Pages"], "Resources": {"Font": {"F1": font}, **resources}, "Contents": d.add(Stream({}, body))})
    d.update(d.catalog["Pages"], Kids=[page], Count=1)
    return d


def reopened(d: Document) -> Document:
    return Document(d.save())


def text_of(d: Document, i: int = 0, **options) -> str:
    return text.page_text(d, d.dictionary(d.page_refs()[i]), **options)


@pytest.mark.parametrize(("body", "expected"), [
    (b"BT /F1 12 Tf 100 700 Td (Hello World) Tj ET", "Hello World"),
    (b"BT /F1 12 Tf 14 TL 100 700 Td (one) Tj T* (two) Tj ET", "one\ntwo"),
    (b"BT /F1 12 Tf 14 TL 100 700 Td (A1) Tj T* (A2) Tj ET BT /F1 12 Tf 400 700 Td (B1) Tj ET", "A1\nA2\nB1"),
    (b"BT /F1 12 Tf 100 700 Td [(a) -1000 (b) 100 (c)] TJ ET", "a bc"),
    (b"q 2 0 0 2 0 0 cm Q Q BT /F9 12 Tf 10 10 Td (gone) Tj ET", ""),
])
def test_extraction(body, expected):
    assert text_of(reopened(one_page(body))) == expected


def test_invisible_text():
    d = one_page(b"BT /F1 12 Tf 3 Tr 10 10 Td (x) Tj ET")
    assert text_of(d) == "x" and text_of(d, invisible=False) == ""


def test_inherited_resources():
    d = author.document_of("word")
    assert text_of(d) == "word" and text_of(d, own_resources=True) == ""


def test_search():
    d = one_page(b"BT /F1 12 Tf 100 700 Td (ana banana) Tj ET")
    blocks = text.page_blocks(d, d.dictionary(d.page_refs()[0]))
    assert [m[:2] for m in text.search(blocks, "ana")] == [(0, 3), (5, 8)] and len(text.search(blocks, "ANA", True)) == 2 and text.search(blocks, "") == []
    assert text.search(blocks, "ana")[0][2] == pytest.approx((100, 700, 118, 712))


def test_forms_and_paths():
    form = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "Matrix": [1, 0, 0, 1, 50, 0]}, b"BT /F1 10 Tf 0 0 Td (in) Tj ET /Fm Do")
    d = one_page(b"0 1 0 rg 10 10 20 20 re f 1 0 0 RG 0 0 m 5 5 l S /Fm Do BI /W 1 /H 1 /BPC 8 /CS /G ID \xff EI /Sh sh", XObject={"Fm": form})
    items = content.Interpreter(d).page(d.dictionary(d.page_refs()[0]))
    assert [i.kind for i in items].count("text") == content.FORM_DEPTH - 1 and items[0].color == (0, 1, 0) and len(items[0].path) == 5 and items[1].stroke == (1, 0, 0)
    assert {"image", "shading"} <= {i.kind for i in items}
    assert items[2].glyphs[0].x == 50


def test_generator_checks_balance():
    g = content.Generator().emit("save_state").emit("set_font", Name("F1"), 12.0)
    with pytest.raises(Fault):
        g.bytes()
    assert g.emit("restore_state").bytes() == b"q\n/F1 12 Tf\nQ"


def test_fonts():
    d = Document()
    font = fonts.Font(d, {"Subtype": Name("TrueType"), "FirstChar": 65, "Widths": [700], "Encoding": {"Differences": [66, Name("eacute"), Name("uni20AC")]}})
    assert [(t, w) for _, _, t, w in font.glyphs(b"ABC\x80")] == [("A", 0.7), ("é", 0.0), ("€", 0.0), ("€", 0.0)]
    cmap = CMap.parse(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0041> <0058> endbfchar 2 beginbfrange <0050> <0052> <0061> <0060> <0061> [<0031> <0032>] endbfrange 1 begincidrange <0000> <00FF> 7 endcidrange")
    assert cmap.split(b"\x00\x41\x00\x51") == [(0x41, 2), (0x51, 2)] and [cmap.text(c, 2) for c in (0x41, 0x51, 0x61, 0x99)] == ["X", "b", "2", None] and cmap.cid(5, 2) == 12
    composite = fonts.Font(d, {"Subtype": Name("Type0"), "Encoding": Name("Identity-H"), "DescendantFonts": [{"DW": 900, "W": [3, [100, 200], 9, 11, 50]}]})
    assert [(t, w) for _, _, t, w in composite.glyphs(b"\x00\x03\x00\x0a\x00\x63")] == [(fonts.UNKNOWN, 0.1), (fonts.UNKNOWN, 0.05), (fonts.UNKNOWN, 0.9)]
    assert fonts.base_unicode("StandardEncoding", 0x27) == "’" and fonts.base_unicode("WinAnsiEncoding", 0x85) == "…" and fonts.base_unicode("MacRomanEncoding", 0x8E) == "é" and fonts.base_unicode("WinAnsiEncoding", 0x81) is None


def test_functions():
    assert numeric.exponential([0.0], [1.0, 0.5, 0.0], 1)([0.5]) == [0.5, 0.25, 0.0]
    assert numeric.run_program(numeric.parse_program(b"{ dup mul }"), [7.0]) == [49.0]
    run = lambda source, *x: numeric.run_program(numeric.parse_program(source), list(x))
    assert run(b"{ 0 div }", 5.0) == [0.0] and run(b"{ -1 sqrt }") == [0.0] and run(b"{ 1 1 and }") == [False] and run(b"{ 3 not }") == [True]
    assert run(b"{ 3 1 roll }", 1.0, 2.0, 3.0) == [3.0, 1.0, 2.0] and run(b"{ 2 copy add }", 1.0, 2.0) == [1.0, 2.0, 3.0] and run(b"{ 1 index }", 4.0, 5.0) == [4.0, 5.0, 4.0]
    assert run(b"{ 2 gt { 10 } { 20 } ifelse }", 3.0) == [10.0] and run(b"{ 0 1 atan }") == [0.0] and run(b"{ -1 0 atan }") == [270.0] and run(b"{ 3 2 bitshift }") == [12.0]
    grid = numeric.sampled(numeric.unpack_bits(bytes([0, 255, 255, 0]), 8, 4), [2, 2], 8, [0, 1, 0, 1], [0, 1])
    assert grid([0.5, 0.5]) == [0.5] and grid([1.0, 0.0]) == [1.0]
    d = Document()
    stitched = numeric.function_of(d, {"FunctionType": 3, "Domain": [0, 1], "Bounds": [0.5], "Encode": [0, 1, 1, 0], "Functions": [{"FunctionType": 2, "N": 1, "Domain": [0, 1]}, {"FunctionType": 2, "N": 1, "Domain": [0, 1]}]})
    assert stitched([0.25]) == [0.5] and stitched([0.5]) == [1.0] and stitched([1.0]) == [0.0]
    with pytest.raises(Fault):
        numeric.function_of(d, {"FunctionType": 9})


def test_colours():
    d = Document()
    assert colour.CMYK.rgb([1, 0, 0, 0]) == (0, 1, 1) and colour.gray_of((1, 1, 1)) == pytest.approx(1)
    assert colour.lab_to_rgb(100, 0, 0) == pytest.approx((1, 1, 1), abs=2e-3) and colour.lab_to_rgb(0, 0, 0) == pytest.approx((0, 0, 0), abs=1e-6)
    indexed = colour.space_of(d, [Name("Indexed"), Name("DeviceRGB"), 1, bytes([255, 0, 0, 0, 0, 255])])
    assert indexed.rgb([0.6]) == (0, 0, 1) and indexed.rgb([9]) == (0, 0, 1)
    tint = colour.space_of(d, [Name("Separation"), Name("Spot"), Name("DeviceCMYK"), {"FunctionType": 2, "N": 1, "Domain": [0, 1], "C0": [0, 0, 0, 0], "C1": [0, 1, 1, 0]}])
    assert tint.rgb([1]) == (1, 0, 0) and colour.space_of(d, [Name("ICCBased"), Stream({"N": 4}, b"")]).n == 4
    shading = {"ShadingType": 2, "ColorSpace": Name("DeviceGray"), "Function": {"FunctionType": 2, "N": 1, "Domain": [0, 1]}}
    assert colour.shading_color(d, shading, 7) == (1, 1, 1)
    assert colour.pattern_of(d, {"PatternType": 1, "XStep": 5})["x_step"] == 5


def test_images():
    d = Document()
    image = lambda raw, **e: images.decode(d, Stream({"Width": 4, "Height": 1, "BitsPerComponent": 1, "ColorSpace": Name("DeviceGray"), **e}, raw)).pixels[0]
    assert image(b"\xa0")[:, 0].tolist() == [255, 0, 255, 0] and image(b"\xa0", Decode=[1, 0])[:, 0].tolist() == [0, 255, 0, 255]
    assert image(b"\x1b", BitsPerComponent=2)[:, 0].tolist() == [0, 85, 170, 255]
    assert image(b"\xa0", ImageMask=True)[:, 3].tolist() == [0, 255, 0, 255]
    assert image(b"\xa0", Mask=[1, 1])[:, 3].tolist() == [0, 255, 0, 255]
    soft = Stream({"Width": 2, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}, b"\x00\xff")
    assert image(b"\xa0", SMask=soft)[:, 3].tolist() == [0, 0, 255, 255]
    with pytest.raises(Fault):
        image(b"", Filter=Name("DCTDecode"))
    assert images.render_size(612, 792, 90, 0.5) == (396, 306)


def test_crypto_vectors():
    aes = crypto.AES(bytes(range(16)))
    sealed = aes.block(bytes.fromhex("00112233445566778899aabbccddeeff"))
    assert sealed.hex() == "69c4e0d86a7b0430d8cdb78070b4c55a" and aes.unblock(sealed).hex() == "00112233445566778899aabbccddeeff"
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert crypto.aes_open(bytes(16), crypto.aes_seal(bytes(16), b"x" * 16, bytes(16))) == b"x" * 16
    assert crypto.permission_value([]) == -3904


def test_both_ciphers_agree(monkeypatch):
    data, key = bytes(range(96)), bytes(range(32))
    native = crypto.AES(key).cbc(data, bytes(16))
    monkeypatch.setattr(crypto, "_native", lambda: None)
    assert crypto.AES(key).cbc(data, bytes(16)) == native and crypto.AES(key).uncbc(native, bytes(16)) == data


@pytest.mark.parametrize("method", ["rc4_40", "rc4_128", "aes128", "aes256"])
def test_encryption(method):
    d = author.document_of("some words", "A title")
    sealed = d.save(crypto.protect(method, "open sesame", "the owner"))
    assert b"A title" not in sealed
    for password in ("open sesame", "the owner"):
        again = Document(sealed, password)
        assert text_of(again) == "some words" and forms.metadata(again) == {"Title": "A title"}
    with pytest.raises(Fault) as caught:
        Document(sealed, "wrong")
    assert caught.value.code == "needsPassword"
    again = Document(sealed, "the owner")
    pages.rotate(again, 0, 90)
    later = Document(again.save_incremental(), "open sesame")
    assert later.attributes(later.dictionary(later.page_refs()[0]))["rotate"] == 90 and text_of(later) == "some words"


def test_pages():
    d = reopened(author.document_of("one " * 2000))
    assert len(d.page_refs()) == 2
    out = reopened(pages.extract(d, [1, 0, 1, 7]))
    assert len(out.page_refs()) == out.page_count() == 3 and text_of(out, 0) == text_of(out, 2) == text_of(d, 1)
    pages.reorder(out, [1, 0, 2])
    assert text_of(out, 0) == text_of(d, 0)
    pages.remove(out, 0)
    pages.insert_blank(out, 99)
    pages.rotate(out, 0, -90)
    pages.set_box(out, 0, "crop", [0, 0, 50, 50])
    out = reopened(out)
    assert [out.attributes(out.dictionary(r))["rotate"] for r in out.page_refs()] == [270, 0, 0] and out.attributes(out.dictionary(out.page_refs()[0]))["crop"] == [0, 0, 50, 50]
    for bad in (lambda: pages.reorder(out, [0, 0, 1]), lambda: pages.remove(out, 9), lambda: pages.rotate(out, 0, 45)):
        with pytest.raises(Fault):
            bad()


def test_crop_box_survives_import():
    d = author.document_of("x")
    d.update(d.catalog["Pages"], CropBox=[0, 0, 100, 100])
    out = reopened(pages.extract(reopened(d), [0]))
    assert out.attributes(out.dictionary(out.page_refs()[0]))["crop"] == [0, 0, 100, 100]


def test_forms():
    d = author.document_of("a b c")
    page = d.page_refs()[0]
    forms.add_field(d, page, "name", [100, 600, 300, 620], value="Bob")
    forms.add_field(d, page, "agree", [100, 560, 120, 580], "Btn", states=("Yes",))
    parent = d.add({"T": b"top", "FT": Name("Tx"), "Ff": 2})
    kid = d.add({"T": b"sub", "Parent": parent, "V": b"deep"})
    d.update(parent, Kids=[kid])
    form = d.catalog["AcroForm"]
    d.update(form, Fields=[*d.array(d.dictionary(form)["Fields"]), parent])
    d = reopened(d)
    assert [(f.name, f.kind, f.flags, f.value) for f in forms.fields(d)] == [("name", "Tx", 0, "Bob"), ("agree", "Btn", 0, "Off"), ("top.sub", "Tx", 2, "deep")]
    forms.set_value(d, forms.field_named(d, "agree"), "Yes")
    forms.set_value(d, forms.field_named(d, "name"), "Alice")
    forms.flatten(d)
    d = reopened(d)
    assert forms.fields(d) == [] and "Alice" in text_of(d) and forms.annotation_refs(d, d.page_refs()[0]) == []
    assert forms.Appearance.parse(b"/F 0 Tf 1 0 0 rg") == forms.Appearance("F", 12.0, (1.0, 0.0, 0.0))


def test_annotations():
    d = author.document_of("x")
    page = d.page_refs()[0]
    made = {k: forms.add_annotation(d, page, k, [10, 10, 50, 30], [1, 0, 0], points=[10, 10, 50, 30], strokes=[[10, 10, 20, 20]]) for k in forms.SUBTYPES}
    drawn = {k for k, r in made.items() if "AP" in d.dictionary(r)}
    assert drawn == {*forms.MARKUP, "square", "circle", "line", "ink", "free_text"}
    assert d.dictionary(made["square"])["F"] == 4 and len(redact.marks(d, page)) == 1
    forms.remove_annotation(d, page, made["ink"])
    assert len(forms.annotation_refs(reopened(d), reopened(d).page_refs()[0])) == len(made) - 1


BODY = b"BT /F1 24 Tf 100 700 Td (SECRET) Tj ET BT /F1 24 Tf 100 100 Td (PUBLIC) Tj ET 300 700 40 10 re f 0 650 m 500 760 l S q 120 0 0 40 60 695 cm /Im Do Q"


def redaction_page() -> Document:
    image = Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 2, "Height": 2, "BitsPerComponent": 8, "ColorSpace": Name("DeviceRGB")}, b"\xff" * 12)
    d = one_page(BODY, XObject={"Im": image})
    forms.set_metadata(d, Title="the SECRET title", Author="somebody")
    return d


def test_redaction():
    d = redaction_page()
    redact.mark(d, d.page_refs()[0], [40, 680, 400, 760], overlay="gone")
    out = redact.apply_all(d, [b"SECRET"])
    again = Document(out)
    items = content.Interpreter(again).page(again.dictionary(again.page_refs()[0]))
    assert "SECRET" not in text_of(again) and "PUBLIC" in text_of(again) and forms.metadata(again) == {"Author": "somebody"} and redact.marks(again, again.page_refs()[0]) == []
    image = next(i.image for i in items if i.kind == "image")
    assert not images.decode(again, image).pixels[..., :3].any()
    assert sum(i.kind == "path" for i in items) == 1  # the mark's own fill


def test_redaction_leaves_shared_forms():
    d = one_page(b"/Fm Do")
    form = d.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "Resources": d.dictionary(d.page_refs()[0])["Resources"]}, b"BT /F1 12 Tf 50 50 Td (SHARED) Tj ET"))
    first = d.page_refs()[0]
    d.update(first, Resources={"XObject": {"Fm": form}})
    second = d.add({**d.dictionary(first)})
    d.update(d.catalog["Pages"], Kids=[first, second], Count=2)
    redact.mark(d, first, [0, 0, 300, 300])
    redact.apply_page(d, first)
    assert "SHARED" not in text_of(d, 0) and text_of(d, 1) == "SHARED"


def test_redaction_fails_closed():
    d = one_page(b"BT /F9 12 Tf 50 50 Td (x) Tj ET")
    redact.mark(d, d.page_refs()[0], [0, 0, 300, 300])
    with pytest.raises(Fault):
        redact.apply_all(d)
    d = one_page(b"BT (open")
    redact.mark(d, d.page_refs()[0], [0, 0, 300, 300])
    with pytest.raises(Fault):
        redact.apply_all(d)


def test_cyclic_tree():
    d = author.document_of("x")
    root = d.catalog["Pages"]
    d.update(root, Kids=[root, *d.array(d.dictionary(root)["Kids"]), 5])
    assert len(d.page_refs()) == 1 and isinstance(root, Ref)


def test_search_ignoring_case_by_characters():
    def found(shown, needle):
        chars = [text.Char(c, float(i), 0.0, 1.0, 1.0) for i, c in enumerate(shown)]
        return [(a, b, t) for a, b, _, t in text.search([[[chars]]], needle, True)]

    assert found("HELLO\u0130hello", "hello") == [(0, 5, "HELLO"), (6, 11, "hello")]
    assert found("x\u0130y", "i\u0307y") == [(1, 3, "\u0130y")] and found("abc", "") == []


def pixels(body: bytes, media=(0, 0, 40, 30), scale=1.0, background=(1.0, 1.0, 1.0), **more):
    d = one_page(body, **more.pop("resources", {}))
    d.update(d.page_refs()[0], MediaBox=list(media), **more)
    return render.render(d, d.dictionary(d.page_refs()[0]), scale, background=background).pixels


def test_render_fills():
    import numpy as np

    p = pixels(b"1 0 0 rg 10 5 20 10 re f")
    assert p.shape == (30, 40, 4) and (p[15:25, 10:30] == [255, 0, 0, 255]).all() and (p == 255).all(axis=-1).sum() == 1200 - 200
    half = pixels(b"0 g 10 5 20.5 10 re f")[20, 30]
    assert abs(int(half[0]) - 128) <= 1
    ring = b"0 0 30 30 re 10 10 10 10 re "
    odd, whole = pixels(ring + b"f*", (0, 0, 30, 30)), pixels(ring + b"f", (0, 0, 30, 30))
    assert (odd[15, 15] == 255).all() and (whole[15, 15, :3] == 0).all() and (odd[5, 5, :3] == 0).all()
    disc = pixels(b"0 g 20 10 m 20 15.5 15.5 20 10 20 c 4.5 20 0 15.5 0 10 c 0 4.5 4.5 0 10 0 c 15.5 0 20 4.5 20 10 c f", (0, 0, 20, 20))
    assert abs((255 - disc[..., 0].astype(float)).sum() / 255 - np.pi * 100) < 3
    assert pixels(b"", background=None).max() == 0 and pixels(b"0 g 0 0 1e30 1 re f 0 0 m nan 1 l 5 5 l f").shape == (30, 40, 4)


def test_render_strokes_clips_and_turns():
    line = pixels(b"0 0 1 RG 4 w 0 15 m 40 15 l S")
    assert (line[13:17, 1:39, :3] == [0, 0, 255]).all() and (line[:12] == 255).all()
    box = pixels(b"2 w 10 10 10 10 re S")
    assert 76 < (255 - box[..., 0].astype(float)).sum() / 255 < 81
    clipped = pixels(b"q 0 0 10 30 re W n 5 0 20 30 re W n 0 g 0 0 40 30 re f Q 1 0 0 rg 30 0 5 30 re f")
    assert (clipped[:, 5:10, :3] == 0).all() and (clipped[:, :5] == 255).all() and (clipped[:, 10:30] == 255).all() and (clipped[:, 30:35, 0] == 255).all()
    for turn, place in ((0, (29, 0)), (90, (0, 0)), (180, (0, 39)), (270, (39, 29))):
        p = pixels(b"0 g 0 0 1 1 re f", Rotate=turn)
        assert p.shape[:2] == ((30, 40) if turn % 180 == 0 else (40, 30)) and (p[place][:3] == 0).all() and (p[..., 0] == 0).sum() == 1


def test_render_images_and_text():
    import numpy as np

    raw = np.array([[[255, 0, 0], [0, 255, 0]], [[0, 0, 255], [9, 9, 9]]], np.uint8)
    p = pixels(b"q 20 0 0 10 10 5 cm /I Do Q", resources={"XObject": {"I": images.rgb_stream(raw)}})
    assert (p[15, 10, :3] == [255, 0, 0]).all() and (p[15, 29, :3] == [0, 255, 0]).all() and (p[24, 10, :3] == [0, 0, 255]).all() and (p[24, 29, :3] == 9).all()
    stencil = pixels(b"0 1 0 rg q 8 0 0 1 0 0 cm BI /W 8 /H 1 /IM true ID \x0f EI Q")
    assert (stencil[29, :4, :3] == [0, 255, 0]).all() and (stencil[29, 4:8] == 255).all()
    broken = pixels(b"q 20 0 0 10 10 5 cm /I Do Q", resources={"XObject": {"I": Stream({"Subtype": Name("Image"), "Width": 1, "Height": 1, "Filter": Name("JPXDecode")}, b"")}})
    assert (broken[20, 15, :3] == 128).all()
    shown = pixels(b"BT /F1 10 Tf 5 10 Td (A A) Tj ET")
    assert (shown[16:19, 6:9, 0] == 0).all() and (shown[:, 11:14] == 255).all() and (pixels(b"BT 3 Tr /F1 10 Tf 5 10 Td (A A) Tj ET") == 255).all()


def test_redaction_flattens_to_a_picture():
    d = one_page(b"BT /F1 12 Tf 100 700 Td (SECRET) Tj ET BT /F1 12 Tf 100 600 Td (public) Tj ET")
    forms.add_annotation(d, d.page_refs()[0], "square", [0, 0, 50, 50])
    redact.mark(d, d.page_refs()[0], [90, 695, 200, 715])
    again = Document(redact.apply_all(d, [b"SECRET", b"public"], flatten_dpi=36))
    page = again.dictionary(again.page_refs()[0])
    items = content.Interpreter(again).page(page)
    assert [i.kind for i in items] == ["image"] and text.page_text(again, page) == "" and forms.annotation_refs(again, again.page_refs()[0]) == []
    raster = images.decode(again, items[0].image)
    assert (raster.width, raster.height) == (306, 396) and (raster.pixels[42, 60, :3] == 0).all() and raster.pixels[92:96, 50:70, 0].min() < 128


def test_rendering_is_bounded():
    d = one_page(b"")
    d.update(d.page_refs()[0], MediaBox=[0, 0, 1e6, 1e6])
    with pytest.raises(Fault):
        render.render(d, d.dictionary(d.page_refs()[0]))


def test_plain_pages_are_read_run_by_run(monkeypatch):
    """Authored pages need no glyphs; whatever is read run by run reads as it does glyph by glyph."""
    import random

    pick, plain = random.Random(5), 0
    for _ in range(400):
        ops = [f"BT /F1 {pick.choice([10, 12, 0, -8])} Tf"]
        for _ in range(pick.randint(0, 6)):
            ops.append(pick.choice(["(lorem  ip) Tj", "(\\344(x) \\\\) Tj", "( ) Tj", "[(a) -300 (b)] TJ", "3 Tr", "30 Tc", "-3 Tw", "50 Tz", "q 2 0 0 2 0 0 cm", "Q (x) '", "1 0.2 0 1 9 9 Tm"]))
            ops.append(f"{pick.choice([0, 0, 0, 40, 300])} {pick.choice([-14, -14, -3, 0, 20])} Td")
        d = Document()
        font = d.add(fonts.helvetica() | {"FirstChar": 32, "Widths": [pick.choice([500, 500, 900]) for _ in range(224)]})
        page = d.add({"Type": Name("Page"), "Parent": d.catalog["Pages"], "Resources": {"Font": {"F1": font}}, "Contents": d.add(Stream({}, "\n".join(ops).encode()))})
        for invisible in (True, False):
            found = text._plain_text(d, d.dictionary(page), invisible=invisible)
            plain += found is not None
            assert found in (None, text.assembled(text.page_blocks(d, d.dictionary(page), invisible=invisible))[0]), ops
    assert plain > 50
    monkeypatch.setattr(text, "page_blocks", None)
    d = Document(author.document_of("some words, (and) \\more \xe4 " * 300).save())
    assert [text.page_text(d, d.dictionary(r)) for r in d.page_refs()] == author.expected_text("some words, (and) \\more \xe4 " * 300)


@pytest.mark.parametrize("method", ["rc4_128", "aes128", "aes256"])
def test_sealing_and_reading_take_no_plain_cipher(monkeypatch, method):
    """The library's ciphers give the same bytes; a document is sealed and read without the plain ones and without glyphs."""
    if crypto._native() is None or not hasattr(crypto._native(), "RC4_set_key"):
        pytest.skip("no library")
    for n in (0, 1, 15, 16, 300, 5000):
        assert crypto.rc4(b"a key" * (n % 3 + 1), bytes(n)) == crypto.plain_rc4(b"a key" * (n % 3 + 1), bytes(n))
    monkeypatch.setattr(crypto, "plain_rc4", None)
    monkeypatch.setattr(text, "page_blocks", None)
    d = Document(author.document_of("some words " * 900, compress=True).save(crypto.protect(method, "u", "o")), "o")
    assert [text.page_text(d, d.dictionary(r)) for r in d.page_refs()] == author.expected_text("some words " * 900)


def test_matches_of_plain_pages_need_no_glyphs(monkeypatch):
    """The same places as by the search over all glyphs."""
    d = Document(author.document_of("an action, (stations) \xe4 rationtion " * 200).save())
    pages_found = [d.dictionary(r) for r in d.page_refs()]
    want = [[text.search(text.page_blocks(d, p), needle) for p in pages_found] for needle in ("tion", "(sta", "\xe4", "none")]
    assert len(want[0][0]) > 100 and want[2][0] and not want[3][0]
    monkeypatch.setattr(text, "page_blocks", None)
    assert want == [[text.page_matches(d, p, needle) for p in pages_found] for needle in ("tion", "(sta", "\xe4", "none")]
