import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.functions import codecs as C
from sheaf.sources.syntax import Fault, Name

PATTERN = bytes((i * 31 + i // 7) & 255 for i in range(6000)) + b"\xab" * 50
CHAINS = [[("AHx", {})], [("A85", {})], [("RL", {})], [("LZW", {})], [("LZW", {"EarlyChange": 0})], [("Fl", {})], [("A85", {}), ("LZW", {}), ("Fl", {})]]


@pytest.mark.parametrize("chain", CHAINS)
@pytest.mark.parametrize("payload", [b"", b"a", b"\x00" * 9, PATTERN])
def test_round_trip(chain, payload):
    assert C.decode(C.encode(payload, chain), chain) == (payload, None)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip_of_any_bytes(payload):
    for chain in CHAINS:
        assert C.decode(C.encode(payload, chain), chain)[0] == payload


def test_known_answers():
    assert C.hex_decode(b"48656C6C6F>ignored") == b"Hello"
    assert C.hex_decode(b"4A5>") == b"JP"
    assert C.hex_encode(b"\x00\xff") == b"00FF>"
    assert C.ascii85_decode(b"87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert C.ascii85_decode(b"zz~>") == bytes(8)
    assert C.run_length_decode(bytes([254, 65, 1, 66, 67, 128, 9])) == b"AAABC"
    assert C.flate_decode(C.flate_encode(PATTERN)[:-40]) and C.flate_decode(b"") == b""


@pytest.mark.parametrize(("chain", "data", "code"), [([("AHx", {})], b"4G>", "filter"), ([("A85", {})], b"a~>", "filter"), ([("A85", {})], b"ab z~>", "filter"), ([("Fl", {})], b"no", "filter"), ([("LZW", {})], b"\xff\x00\x00", "filter"), ([("Nope", {})], b"", "unsupportedFeature"), ([("DCT", {}), ("Fl", {})], b"", "filter"), ([("Fl", {"Predictor": 12, "Columns": 7})], C.flate_encode(b"abc"), "filter")])
def test_malformed(chain, data, code):
    with pytest.raises(Fault) as caught:
        C.decode(data, chain)
    assert caught.value.code == code


@pytest.mark.parametrize(("predictor", "colors", "bits", "columns"), [(2, 3, 8, 4), (12, 1, 1, 16), (12, 1, 2, 8), (12, 1, 4, 4), (15, 3, 8, 5), (10, 1, 16, 3)])
def test_predictors(predictor, colors, bits, columns):
    row = (colors * bits * columns + 7) // 8
    data = bytes(i * 37 & 255 for i in range(row * 9))
    parms = {"Predictor": predictor, "Colors": colors, "BitsPerComponent": bits, "Columns": columns}
    assert C.predictor_decode(C.predictor_encode(data, parms), parms) == data


def test_png_row_tags():
    assert C.predictor_decode(bytes([0, 10, 20, 30, 1, 1, 1, 1, 2, 1, 1, 1, 3, 4, 4, 4, 4, 1, 1, 1]), {"Predictor": 15, "Columns": 3}) == bytes([10, 20, 30, 1, 2, 3, 2, 3, 4, 5, 8, 10, 6, 9, 11])


def test_image_codec_is_passed_on():
    assert C.decode(C.hex_encode(b"jpeg"), [("AHx", {}), ("DCT", {})]) == (b"jpeg", "DCTDecode")
    assert C.chain_of({"F": [Name("AHx"), Name("Fl")], "DP": [None, {"Predictor": 2}]}) == [("AHx", {}), ("Fl", {"Predictor": 2})]


def test_dct_round_trips():
    import numpy as np

    from sheaf.functions import jpeg
    from sheaf.sources.syntax import Fault

    rng = np.random.default_rng(1)
    for n in (1, 3):
        for height, width, interval in ((8, 8, 0), (17, 9, 1), (64, 50, 3), (1, 1, 0)):
            smooth = np.linspace(0, 255, height * width).reshape(height, width, 1) + rng.normal(0, 20, (height, width, n))
            pixels = smooth.clip(0, 255).astype(np.uint8)
            again = jpeg.decode(jpeg.encode(pixels, 1, interval), 1 << 20)
            assert again.shape == pixels.shape and np.abs(again.astype(int) - pixels).max() <= 2
    whole = jpeg.encode(rng.integers(0, 255, (40, 40, 3)).astype(np.uint8), 8)
    for data in [whole[:k] for k in range(0, len(whole), 97)] + [bytes(b ^ (rng.random() < 0.01) * 255 for b in whole) for _ in range(60)]:
        try:
            assert jpeg.decode(data, 1 << 20).dtype == np.uint8
        except Fault as fault:
            assert fault.code in ("image", "unsupportedFeature")
    with pytest.raises(Fault):
        jpeg.decode(whole, 100)


@pytest.mark.parametrize("kind", [1, 10])
def test_dct_against_another_library(spark, kind):
    """Images that Java writes (subsampled colours, its own codes) come out as Java reads them; kind: RGB or gray."""
    import numpy as np

    from sheaf.functions import jpeg

    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(45, 31, kind)
    for y in range(31):
        for x in range(45):
            image.setRGB(x, y, (x * 5) << 16 | (y * 8) << 8 | (x + y) * 3)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    raster = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(out.toByteArray())).getRaster()
    found = jpeg.decode(data, 1 << 20)
    want = np.array([[[raster.getSample(x, y, k) for k in range(found.shape[2])] for x in range(0, 45, 4)] for y in range(0, 31, 3)])
    far = np.abs(found[::3, ::4].astype(int) - want)
    # Colours of fewer samples are repeated here, and smoothed there.
    assert found.shape == (31, 45, 3 if kind == 1 else 1) and np.median(far) <= (3 if kind == 1 else 1) and far.max() <= (24 if kind == 1 else 1)
