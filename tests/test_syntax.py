import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.sources.document import Document, load_xref, runs
from sheaf.sources.syntax import Fault, Name, Reader, Ref, Stream, Token, format_real, format_value, parse_number, string_of, text_of, tokens


def read(data):
    return Reader(data).value()


def test_values():
    assert read(b"<</A 1 0 R /B [1 -2.5 (a\\)b\\101\\\nc(d)) <4a5>] /C null /D <</E true>>>>") == {"A": Ref(1, 0), "B": [1, -2.5, b"a)bAc(d)", b"JP"], "D": {"E": True}}
    assert read(b"/a#20b") == "a b" and isinstance(read(b"/a"), Name) and read(b"/x#zz") == "x#zz"
    assert read(b"% note\n 7") == 7 and read(b"(a\r\nb\rc)") == b"a\nb\nc"
    assert read(b"<</K 1 /K 2>>") == {"K": 2} and read(b"<</K 1 /K null>>") == {}


def test_numbers():
    assert parse_number(b"007") == 7 and parse_number(b"-.5") == -0.5 and parse_number(b"4.") == 4.0
    assert parse_number(b"1e5") is None and parse_number(b"--1") is None and parse_number(b"") is None
    assert isinstance(parse_number(b"99999999999999999999"), float)
    assert format_real(3.0) == "3.0" and format_real(0.25) == "0.25" and format_real(-1e-9) in ("-0.0", "0.0")


@pytest.mark.parametrize("data", [b"", b"<4g>", b"(open", b"[1 2", b"<</A", b"<<1 2>>"])
def test_broken_values(data):
    with pytest.raises(Fault):
        read(data)


_leaf = st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.binary(max_size=20) | st.text(st.characters(min_codepoint=1, max_codepoint=255), min_size=1, max_size=8).map(Name) | st.builds(Ref, st.integers(1, 99), st.integers(0, 3))
_value = st.recursive(_leaf, lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text("abcXYZ /#(", min_size=1, max_size=5).map(Name), inner.filter(lambda v: v is not None), max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(_value)
def test_written_values_read_back(value):
    assert read(format_value(value) + b" ") == value


def test_strings():
    assert text_of(string_of("é😀")) == "é😀" and text_of(b"\xe9") == "é" and text_of(b"\xfe\xff\x00a\x00") == "a"


def test_tokens():
    assert [k for _, k, _ in tokens(b"1 2.5 /N (s) [ << >> BT (open")] == ["integer", "real", "name", "string", "delimiter", "delimiter", "delimiter", "keyword", "error"]


def classic(body: bytes, trailer: bytes = b"/Root 1 0 R") -> bytes:
    out, places = b"%PDF-1.4\n", []
    for part in body.split(b"|"):
        places.append(len(out))
        out += b"%d 0 obj\n" % len(places) + part + b"\nendobj\n"
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + table + b"trailer\n<</Size %d %s>>\nstartxref\n%d\n%%%%EOF" % (len(places) + 1, trailer, len(out))


MINIMAL = classic(b"<</Type/Catalog/Pages 2 0 R>>|<</Type/Pages/Kids[3 0 R]/Count 1/Rotate 90>>|<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/CropBox[10 10 9999 100]>>")


def test_classic_file():
    d = Document(MINIMAL)
    assert not d.repaired and d.page_count() == 1 and d.numbers() == [1, 2, 3]
    a = d.attributes(d.dictionary(d.page_refs()[0]))
    assert a["rotate"] == 90 and a["crop"] == [10.0, 10.0, 612.0, 100.0]
    assert d.get(99) is None and d.resolve(Ref(2, 7))["Count"] == 1


def object_stream_file() -> bytes:
    """Objects 3 and 4 in an object stream, entries in a cross-reference stream."""
    out, places = b"%PDF-1.5\n", {}
    inner = b"3 0 4 46 <</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]>>       <</Value 42>>"
    first = 9
    inner = b"3 0 4 %d " % 60
    first = len(inner)
    members = b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]>>".ljust(60) + b"<</Value 42>>"
    for number, body in ((1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[3 0 R]/Count 1>>"), (5, b"<</Type/ObjStm/N 2/First %d/Length %d>>\nstream\n%s\nendstream" % (first, first + len(members), inner + members))):
        places[number] = len(out)
        out += b"%d 0 obj\n" % number + body + b"\nendobj\n"
    at = len(out)
    rows = [(0, 0, 0), (1, places[1], 0), (1, places[2], 0), (2, 5, 0), (2, 5, 1), (1, places[5], 0), (1, at, 0)]
    data = b"".join(bytes([a]) + b.to_bytes(2, "big") + c.to_bytes(2, "big") for a, b, c in rows)
    out += b"6 0 obj\n<</Type/XRef/Size 7/W[1 2 2]/Index[0 7]/Root 1 0 R/Length %d>>\nstream\n%s\nendstream\nendobj\n" % (len(data), data)
    return out + b"startxref\n%d\n%%%%EOF" % at


def test_object_stream():
    d = Document(object_stream_file())
    assert not d.repaired and d.get(4) == {"Value": 42} and len(d.page_refs()) == 1


def test_incremental_generations():
    data = MINIMAL
    for turn in (0, 180):
        d = Document(data)
        d.update(d.page_refs()[0], Rotate=turn)
        newer = d.save_incremental()
        assert newer.startswith(data)
        data = newer
    d = Document(data)
    assert d.attributes(d.dictionary(d.page_refs()[0]))["rotate"] == 180 and load_xref(data)[1]["Root"] == Ref(1, 0)


@pytest.mark.parametrize("broken", [b"junk" * 9 + MINIMAL, MINIMAL.replace(b"startxref", b"startxxxx"), MINIMAL[:-60], MINIMAL.replace(b"/Root 1 0 R", b"/Info 1 0 R")])
def test_recovery(broken):
    d = Document(broken)
    assert len(d.page_refs()) == 1


def test_stream_length():
    body = b"<</Type/Catalog/Pages 2 0 R>>|<</Type/Pages/Kids[]/Count 0>>|<</Length 4 0 R>>\nstream\na endstream b\nendstream|13"
    assert Document(classic(body)).get(3).raw == b"a endstream b"
    assert Document(classic(body.replace(b"4 0 R", b"999"))).get(3).raw == b"a "


def test_fuzz_repairs_or_faults():
    rng = random.Random(0xC0FFEE)
    cases = [rng.randbytes(n) for n in (0, 1, 8, 64, 512, 4096, 16384) for _ in range(30)]
    for _ in range(200):
        data = bytearray(rng.choice((MINIMAL, object_stream_file())))
        for _ in range(rng.randrange(1, 12)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        cases.append(bytes(data[: rng.randrange(len(data))]) if rng.random() < 0.4 else bytes(data))
    for data in cases:
        if data:
            try:
                d = Document(data)
                for ref in d.page_refs():
                    d.attributes(d.dictionary(ref))
                for number in d.numbers():
                    d.get(number)
                d.page_count(), d.save()
            except Fault:
                pass


def test_mutated_encrypted_documents_fault():
    """Values of another type, numbers out of range and changed bytes: a document opens or faults, and nothing else."""
    import re

    from sheaf.functions import crypto
    from sheaf.operators import author, text

    rng = random.Random(0xBADF00D)
    bases = [author.document_of("hello world " * 9, "T", packed).save(crypto.protect(method, "u", "o")) for method in ("rc4_40", "rc4_128", "aes128", "aes256") for packed in (False, True)]
    others = [b"/X", b"(s)", b"[1 2]", b"<<>>", b"null", b"true", b"-1", b"99999999999", b"1.5", b"9 0 R", b"<</A 1>>"]
    opened = 0
    for _ in range(400):
        data = bytearray(rng.choice(bases))
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.6:
                value = rng.choice(list(re.finditer(rb"/[A-Za-z]+ (\S+)", data)))
                data[value.start(1) : value.end(1)] = rng.choice(others)
            else:
                data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            d = Document(bytes(data), "u")
            for ref in d.page_refs():
                text.page_text(d, d.dictionary(ref))
            for number in d.numbers():
                d.get(number)
            opened += 1
        except Fault:
            pass
    assert opened > 20


def test_runs_and_garbage():
    assert runs([5, 1, 2, 3, 9]) == [(1, 3), (5, 1), (9, 1)]
    d = Document(MINIMAL)
    d.add(Stream({}, b"nobody leads here"))
    assert Document(d.save()).numbers() == [1, 2, 3]
    with pytest.raises(Fault):
        d.save_sanitized([b"Catalog"])
    assert Token(b"x") != b"x"


def test_bytes_that_an_encoding_holds_by_chance_are_no_residue():
    from sheaf.functions import crypto
    from sheaf.operators.author import document_of

    d = document_of("some words of a text " * 20, compress=True)
    packed = next(v.raw for v in d.edits.values() if isinstance(v, Stream))
    chance = packed[20:26]  # in the encoded bytes only
    saved = d.save_sanitized([chance])
    again = Document(saved)
    assert chance not in saved and again.content(again.dictionary(again.page_refs()[0])) == d.content(d.dictionary(d.page_refs()[0]))
    sealed = Document(d.save_sanitized([chance], crypto.protect("aes128", "u", "o")), "u")
    assert sealed.content(sealed.dictionary(sealed.page_refs()[0])) == d.content(d.dictionary(d.page_refs()[0]))
    for left in (b"words", b"Catalog", b"00000"):
        with pytest.raises(Fault):
            d.save_sanitized([left])
