"""Byte codecs of PDF streams, each with its inverse; bounded output, one Fault type."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.sources.syntax import Fault, Name

#: The most that a decoder puts out for one stream: guards against bombs.
MAX_OUTPUT = 512 << 20

# Filter names and their short forms.
FILTER_NAMES = {
    "ASCIIHexDecode": "ASCIIHexDecode", "AHx": "ASCIIHexDecode",
    "ASCII85Decode": "ASCII85Decode", "A85": "ASCII85Decode",
    "LZWDecode": "LZWDecode", "LZW": "LZWDecode",
    "FlateDecode": "FlateDecode", "Fl": "FlateDecode",
    "RunLengthDecode": "RunLengthDecode", "RL": "RunLengthDecode",
    "CCITTFaxDecode": "CCITTFaxDecode", "CCF": "CCITTFaxDecode",
    "DCTDecode": "DCTDecode", "DCT": "DCTDecode",
    "JBIG2Decode": "JBIG2Decode",
    "JPXDecode": "JPXDecode",
}
IMAGE_CODECS = frozenset({"CCITTFaxDecode", "DCTDecode", "JBIG2Decode", "JPXDecode"})
_BLANK = b"\x00\t\n\x0c\r "


def hex_decode(data: bytes) -> bytes:
    body = data.split(b">", 1)[0].translate(None, _BLANK)
    try:
        return bytes.fromhex((body + b"0" * (len(body) % 2)).decode("latin-1"))
    except ValueError:
        raise Fault("filter", "not a hexadecimal digit") from None


def hex_encode(data: bytes) -> bytes:
    return data.hex().upper().encode() + b">"


def ascii85_decode(data: bytes) -> bytes:
    """z stands for four zeros between groups; ~> ends; a last group of one character is an error; sums wrap at 2**32."""
    out, group = bytearray(), []
    for c in data.split(b"~", 1)[0].translate(None, _BLANK):
        if c == 0x7A:
            if group:
                raise Fault("filter", "z within a group")
            out += bytes(4)
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += _base85(group).to_bytes(4, "big")
                group = []
        else:
            raise Fault("filter", "not a base-85 digit")
    if len(group) == 1:
        raise Fault("filter", "a last group of one digit")
    if group:
        n = len(group) - 1
        out += _base85(group + [84] * (5 - len(group))).to_bytes(4, "big")[:n]
    return bytes(out)


def _base85(digits: list[int]) -> int:
    value = 0
    for d in digits:
        value = value * 85 + d
    return value & 0xFFFFFFFF


def ascii85_encode(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 4):
        part = data[i : i + 4]
        value = int.from_bytes(part.ljust(4, b"\0"), "big")
        if value == 0 and len(part) == 4:
            out += b"z"
            continue
        digits = [value // 85**k % 85 + 0x21 for k in (4, 3, 2, 1, 0)]
        out += bytes(digits[: len(part) + 1])
    return bytes(out) + b"~>"


def run_length_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and (n := data[at]) != 128:
        if n < 128:
            if at + 2 + n > len(data):
                raise Fault("filter", "a run is cut short")
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if at + 1 >= len(data):
                raise Fault("filter", "a run is cut short")
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        _bounded(len(out))
    return bytes(out)


def run_length_encode(data: bytes) -> bytes:
    """Literal runs only, and the end mark."""
    return b"".join(bytes([len(p) - 1]) + p for i in range(0, len(data), 128) if (p := data[i : i + 128])) + b"\x80"


def lzw_decode(data: bytes, early: bool = True) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    out, total = [], 0
    table: list[bytes] = []
    held = bits = at = 0
    width, before = 9, None

    def fresh():
        return [bytes([i]) for i in range(256)] + [b"", b""]

    table = fresh()
    while True:
        while bits < width:
            if at >= len(data):
                return b"".join(out)
            held = held << 8 | data[at]
            at += 1
            bits += 8
        bits -= width
        code = held >> bits & (1 << width) - 1
        held &= (1 << bits) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, before = fresh(), 9, None
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before is not None:
            entry = before + before[:1]
        else:
            raise Fault("filter", "an LZW code that isn't in the table")
        out.append(entry)
        total += len(entry)
        _bounded(total)
        if before is not None and len(table) < 4096:
            table.append(before + entry[:1])
        before = entry
        size = len(table) + bool(early)
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9


def lzw_encode(data: bytes, early: bool = True) -> bytes:
    held = bits = 0
    out = bytearray()
    table: dict[bytes, int] = {}
    width = 9

    def put(code: int):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    put(256)
    table = {bytes([i]): i for i in range(256)}
    size, word = 258, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        # The reader's table lags one entry behind.
        seen = size - 1 + bool(early)
        width = 12 if seen >= 2048 else 11 if seen >= 1024 else 10 if seen >= 512 else 9
        if size >= 4095:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word])
        seen = size + bool(early)
        width = 12 if seen >= 2048 else 11 if seen >= 1024 else 10 if seen >= 512 else 9
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def flate_decode(data: bytes) -> bytes:
    """Of a stream that is cut short, what there is; of an empty one, nothing."""
    if not data:
        return b""
    inflater = zlib.decompressobj()
    try:
        out = inflater.decompress(data, MAX_OUTPUT)
    except zlib.error as error:
        raise Fault("filter", f"not a zlib stream ({error})") from None
    if inflater.unconsumed_tail:
        raise Fault("limit", "a stream inflates beyond the bound")
    return out


def flate_encode(data: bytes) -> bytes:
    return zlib.compress(data) if data else b""


def flate_variants(data: bytes) -> Iterator[tuple[list[Name], bytes]]:
    """Filters and bytes of the same data encoded in different ways; the last is in hexadecimal digits."""
    for level in range(9, 0, -1):
        for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_HUFFMAN_ONLY, zlib.Z_FIXED):
            packer = zlib.compressobj(level, strategy=strategy)
            yield [Name("FlateDecode")], packer.compress(data) + packer.flush()
    yield [Name("ASCIIHexDecode"), Name("FlateDecode")], hex_encode(zlib.compress(data))


def _bounded(size: int) -> None:
    if size > MAX_OUTPUT:
        raise Fault("limit", "a stream decodes beyond the bound")


def _rows(data: bytes, parms: dict) -> tuple[int, int]:
    """Bytes of a pixel (at least 1) and of a row."""
    colors, bits, columns = (int(parms.get(k, d)) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if min(colors, bits, columns) < 1:
        raise Fault("filter", "a predictor with empty rows")
    return max(1, colors * bits // 8), (colors * bits * columns + 7) // 8


def predictor_decode(data: bytes, parms: dict) -> bytes:
    kind = int(parms.get("Predictor", 1))
    if kind == 1:
        return data
    pixel, row = _rows(data, parms)
    if kind == 2:
        if int(parms.get("BitsPerComponent", 8)) != 8:
            raise Fault("unsupportedFeature", "the TIFF predictor for other than 8 bits")
        if len(data) % row:
            raise Fault("filter", "a partial row")
        colors = int(parms.get("Colors", 1))
        return np.cumsum(np.frombuffer(data, np.uint8).reshape(-1, row // colors, colors), axis=1, dtype=np.uint8).tobytes()
    if not 10 <= kind <= 15:
        raise Fault("unsupportedFeature", f"predictor {kind}")
    if len(data) % (row + 1):
        raise Fault("filter", "a partial row")
    above, out = np.zeros(row, np.uint8), []
    for line in np.frombuffer(data, np.uint8).reshape(-1, row + 1):
        tag, now = int(line[0]), line[1:].copy()
        if tag == 1:
            pad = -row % pixel
            now = np.cumsum(np.pad(now, (0, pad)).reshape(-1, pixel), axis=0, dtype=np.uint8).ravel()[:row]
        elif tag == 2:
            now += above
        elif tag in (3, 4):
            values, up = now.tolist(), above.tolist()
            for i in range(row):
                left = values[i - pixel] if i >= pixel else 0
                corner = up[i - pixel] if i >= pixel else 0
                values[i] = values[i] + ((left + up[i]) // 2 if tag == 3 else _paeth(left, up[i], corner)) & 255
            now = np.array(values, np.uint8)
        elif tag:
            raise Fault("filter", f"row tag {tag}")
        out.append(now)
        above = now
    return np.concatenate(out).tobytes() if out else b""


def _paeth(left: int, up: int, corner: int) -> int:
    guess = left + up - corner
    return min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]


def predictor_encode(data: bytes, parms: dict) -> bytes:
    """Rows of PNG predictors are all written as differences to the row above."""
    kind = int(parms.get("Predictor", 1))
    if kind == 1:
        return data
    _, row = _rows(data, parms)
    if len(data) % row:
        raise Fault("filter", "a partial row")
    rows = np.frombuffer(data, np.uint8).reshape(-1, row)
    if kind == 2:
        if int(parms.get("BitsPerComponent", 8)) != 8:
            raise Fault("unsupportedFeature", "the TIFF predictor for other than 8 bits")
        colors = int(parms.get("Colors", 1))
        return np.diff(rows.reshape(len(rows), -1, colors), axis=1, prepend=np.zeros((len(rows), 1, colors), np.uint8)).astype(np.uint8).tobytes()
    if not 10 <= kind <= 15:
        raise Fault("unsupportedFeature", f"predictor {kind}")
    up = rows - np.concatenate([np.zeros((1, row), np.uint8), rows[:-1]]) if len(rows) else rows
    return np.concatenate([np.full((len(rows), 1), 2, np.uint8), up], axis=1).tobytes()


def decode(data: bytes, filters: list[tuple[str, dict]]) -> tuple[bytes, str | None]:
    """Through a chain in order. An image codec must be last: then its bytes as they are, and its name."""
    for i, (name, parms) in enumerate(filters):
        kind = FILTER_NAMES.get(name)
        if kind is None:
            raise Fault("unsupportedFeature", f"filter {name}")
        if kind in IMAGE_CODECS:
            if i != len(filters) - 1:
                raise Fault("filter", f"{kind} before other filters")
            return data, kind
        if kind == "FlateDecode":
            data = predictor_decode(flate_decode(data), parms)
        elif kind == "LZWDecode":
            data = predictor_decode(lzw_decode(data, bool(parms.get("EarlyChange", 1))), parms)
        else:
            data = _CODECS[kind][0](data)
    return data, None


def encode(data: bytes, filters: list[tuple[str, dict]]) -> bytes:
    """The inverse of decode, filter by filter from the last one."""
    for name, parms in reversed(filters):
        kind = FILTER_NAMES.get(name)
        if kind == "FlateDecode":
            data = flate_encode(predictor_encode(data, parms))
        elif kind == "LZWDecode":
            data = lzw_encode(predictor_encode(data, parms), bool(parms.get("EarlyChange", 1)))
        elif kind in _CODECS:
            data = _CODECS[kind][1](data)
        else:
            raise Fault("unsupportedFeature", f"no encoder for {name}")
    return data


def chain_of(entries: dict) -> list[tuple[str, dict]]:
    """Names and parameters from /Filter or /F and /DecodeParms or /DP, by position."""
    names, parms = entries.get("Filter", entries.get("F")), entries.get("DecodeParms", entries.get("DP"))
    names = names if isinstance(names, list) else [] if names is None else [names]
    parms = parms if isinstance(parms, list) else [parms]
    if not all(isinstance(n, Name) for n in names):
        raise Fault("syntax", "a filter is not a name")
    return [(str(n), p if isinstance(p := parms[i] if i < len(parms) else None, dict) else {}) for i, n in enumerate(names)]


# -- on columns ---------------------------------------------------------------------------------------

#: Codecs without parameters: decoder and encoder.
_CODECS = {"ASCIIHexDecode": (hex_decode, hex_encode), "ASCII85Decode": (ascii85_decode, ascii85_encode), "RunLengthDecode": (run_length_decode, run_length_encode)}


def register(name: str, decoder, encoder) -> None:
    """Adds a codec under a name of its own, in this process: in a UDF, call it there."""
    FILTER_NAMES[name] = name
    _CODECS[name] = (decoder, encoder)


def _apply(function, column: Column) -> Column:
    @F.pandas_udf("struct<bytes:binary,error:string>")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                rows.append((None if v is None else function(bytes(v)), None))
            except Fault as fault:
                rows.append((None, fault.code))
        return pd.DataFrame(rows, columns=["bytes", "error"])

    return run(column)


def decoded(column: Column, filters: list[tuple[str, dict]]) -> Column:
    """struct<bytes, error>: a broken value gives an error code, never a failed job."""
    return _apply(lambda data: decode(data, filters)[0], column)


def encoded(column: Column, filters: list[tuple[str, dict]]) -> Column:
    return _apply(lambda data: encode(data, filters), column)


def hex_encoded(column: Column) -> Column:
    """ASCIIHex without Python."""
    return F.concat(F.hex(column), F.lit(">"))


def hex_decoded(column: Column) -> Column:
    """ASCIIHex without Python: null on a digit that isn't one."""
    body = F.regexp_replace(F.regexp_extract(column, r"^([^>]*)", 1), r"[\x00\t\n\f\r ]", "")
    return F.unhex(F.when(F.length(body) % 2 == 1, F.concat(body, F.lit("0"))).otherwise(body))


def filter_kind(column: Column) -> Column:
    """The full name of a filter; null for an unknown one."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in FILTER_NAMES.items() for x in pair)), column)
