"""Baseline DCT images: sequential Huffman coding of 8-bit samples, any subsampling and restart intervals; and a plain writer.

Progressive, arithmetic, lossless and 12-bit ones are `unsupportedFeature`. Codes are read one by one, as each begins where
the one before ends; all blocks are then transformed at once.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass

import numpy as np

from sheaf.sources.syntax import Fault

#: Places of a block in the order that they are stored: diagonals, up and down in turn.
ORDER = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
#: Rows: the cosine waves of a block's side, so that a side is WAVES.T @ coefficients.
WAVES = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
_END = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]", re.S)
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


@dataclass
class Component:
    name: int
    across: int
    down: int
    quantizer: int
    blocks: np.ndarray | None = None  # (rows, columns, 64)


def _code_table(lengths: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits ahead, length << 8 | symbol of the code that they begin with; 0 where there is none."""
    table, code, at = [0] * 65536, 0, 0
    for n, count in enumerate(lengths, 1):
        for symbol in symbols[at : at + count]:
            first = code << (16 - n)
            if first >= 65536:
                raise Fault("image", "too many codes")
            table[first : first + (1 << (16 - n))] = [n << 8 | symbol] * (1 << (16 - n))
            code += 1
        at += count
        code <<= 1
    return table


def decode(data: bytes, most_pixels: int) -> np.ndarray:
    """(height, width, components), uint8: gray, RGB or CMYK as stored."""
    quantizers: dict[int, np.ndarray] = {}
    codes: dict[int, list[int]] = {}
    parts: list[Component] = []
    width = height = interval = 0
    adobe, at = None, data.find(b"\xff\xd8") + 2
    if at < 2:
        raise Fault("image", "no start of a DCT image")
    while (at := data.find(b"\xff", at)) >= 0 and at + 3 < len(data):
        marker = data[at + 1]
        if marker in (0xFF, 0x00, 0x01) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + max(size, 2)
        try:
            if marker == 0xDB:
                while body:
                    wide, name = body[0] >> 4, body[0] & 15
                    values = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8)
                    quantizers[name], body = values[:64].astype(np.int64), body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    count = sum(body[1:17])
                    codes[body[0]], body = _code_table(body[1:17], body[17 : 17 + count]), body[17 + count :]
            elif marker in (0xC0, 0xC1):
                bits, height, width, n = struct.unpack(">BHHB", body[:6])
                if bits != 8:
                    raise Fault("unsupportedFeature", f"{bits} bits")
                if not 0 < width * height <= most_pixels or n not in (1, 3, 4):
                    raise Fault("image", "no size")
                parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if not all(0 < c.across <= 4 and 0 < c.down <= 4 for c in parts):
                    raise Fault("image", "no sampling")
                most_x, most_y = max(c.across for c in parts), max(c.down for c in parts)
                wide, high = -(-width // (8 * most_x)), -(-height // (8 * most_y))
                for c in parts:
                    c.blocks = np.zeros((high * c.down, wide * c.across, 64), np.int32)
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise Fault("unsupportedFeature", "this kind of DCT image")
            elif marker == 0xDD:
                interval = int.from_bytes(body[:2], "big")
            elif marker == 0xEE and body[:5] == b"Adobe":
                adobe = body[11]
            elif marker == 0xDA:
                end = _END.search(data, at)
                stop = end.start() if end else len(data)
                _scan(body, data[at:stop], parts, codes, interval, (width, height))
                at = stop
        except (IndexError, KeyError, StopIteration, struct.error, ValueError) as error:
            if isinstance(error, Fault):
                raise
            raise Fault("image", "a broken DCT image") from error
    if not parts:
        raise Fault("image", "no frame")
    planes = []
    for c in parts:
        if c.quantizer not in quantizers or len(quantizers[c.quantizer]) < 64:
            raise Fault("image", "no quantizer")
        rows, columns, _ = c.blocks.shape
        waves = np.zeros((rows, columns, 64))
        waves[..., ORDER] = c.blocks * quantizers[c.quantizer]
        shown = np.einsum("ux,rcuv,vy->rxcy", WAVES, waves.reshape(rows, columns, 8, 8), WAVES, optimize=True).reshape(rows * 8, columns * 8) + 128
        ys, xs = np.arange(height) * c.down // most_y, np.arange(width) * c.across // most_x
        planes.append(shown[ys][:, xs])
    out = np.stack(planes, axis=-1)
    if adobe in (1, 2) or adobe is None and len(parts) == 3 and bytes(c.name for c in parts) != b"RGB":
        y, b, r = np.clip(out[..., 0], 0, 255), out[..., 1] - 128, out[..., 2] - 128
        rgb = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=-1)
        out = np.concatenate([255 - rgb, out[..., 3:]], axis=-1) if len(parts) == 4 else rgb
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def _scan(head: bytes, data: bytes, parts: list[Component], codes: dict, interval: int, size: tuple[int, int]) -> None:
    """The codes of a scan into its components' blocks. What is missing at the end stays zero."""
    found = []
    for i in range(head[0]):
        name, tables = head[1 + 2 * i], head[2 + 2 * i]
        found.append((next(c for c in parts if c.name == name), codes[tables >> 4], codes[0x10 | tables & 15]))
    if not found:
        return
    if len(found) == 1:  # its own blocks only, row by row
        c = found[0][0]
        most_x, most_y = max(p.across for p in parts), max(p.down for p in parts)
        across = -(-(-(-size[0] * c.across // most_x)) // 8)
        down = -(-(-(-size[1] * c.down // most_y)) // 8)
        units = [[(0, y, x)] for y in range(down) for x in range(across)]
    else:
        c = found[0][0]
        rows, columns = c.blocks.shape[0] // c.down, c.blocks.shape[1] // c.across
        units = ([(k, row * c.down + y, column * c.across + x) for k, (c, _, _) in enumerate(found) for y in range(c.down) for x in range(c.across)] for row in range(rows) for column in range(columns))
    units = iter(units)
    for segment in _RESTART.split(data) if interval else [data]:
        bits, at = segment.replace(b"\xff\x00", b"\xff") + bytes(8), 0
        last, end = [0] * len(found), 8 * (len(bits) - 8)
        for done, unit in enumerate(units, 1):
            for k, y, x in unit:
                if at >= end:
                    break
                c, direct, other = found[k]
                block, at, last[k] = _block(bits, at, direct, other, last[k])
                for place, value in block:
                    c.blocks[y, x, place] = value
            if done == interval or at >= end and interval == 0:
                break


def _block(bits: bytes, at: int, direct: list[int], other: list[int], last: int):
    """The non-zero coefficients of a block, the bit after it, and its first coefficient."""
    out, place = [], 0
    while place < 64:
        byte = at >> 3
        ahead = (bits[byte] << 16 | bits[byte + 1] << 8 | bits[byte + 2]) >> 8 - (at & 7) & 0xFFFF if byte + 2 < len(bits) else 0
        code = (other if place else direct)[ahead]
        if not code:
            raise Fault("image", "no such code")
        at += code >> 8
        run, size = (code & 255) >> 4, code & 15
        if place and not size:
            if run != 15:
                break
            place += 16
            continue
        value = 0
        if size:
            byte = at >> 3
            value = int.from_bytes(bits[byte : byte + 4].ljust(4, b"\0"), "big") >> 32 - (at & 7) - size & (1 << size) - 1
            at += size
            if value < 1 << size - 1:
                value -= (1 << size) - 1
        if place:
            place += run
            if place < 64:
                out.append((place, value))
        else:
            last += value
            out.append((0, last))
        place += 1
    return out, at, last


def encode(pixels: np.ndarray, step: int = 1, interval: int = 0) -> bytes:
    """(height, width, 1 or 3) as a baseline image without subsampling; all coefficients in steps of step, all codes of one length."""
    height, width, n = pixels.shape
    values = pixels.astype(float)
    if n == 3:
        r, g, b = values[..., 0], values[..., 1], values[..., 2]
        values = np.stack([0.299 * r + 0.587 * g + 0.114 * b, -0.168736 * r - 0.331264 * g + 0.5 * b + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128], axis=-1)
    rows, columns = -(-height // 8), -(-width // 8)
    padded = np.pad(values, ((0, rows * 8 - height), (0, columns * 8 - width), (0, 0)), mode="edge") - 128
    waves = np.einsum("ux,rxcyk,vy->rckuv", WAVES, padded.reshape(rows, 8, columns, 8, n), WAVES, optimize=True)
    blocks = np.round(waves.reshape(rows * columns, n, 64)[..., ORDER] / step).astype(int)
    symbols = [0, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    place = {s: i for i, s in enumerate(symbols)}

    def magnitude(v: int) -> str:
        size = abs(v).bit_length()
        return format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    out, text, last = [], "", [0] * n

    def packed(text: str) -> bytes:
        text += "1" * (-len(text) % 8)
        return int(text or "0", 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")

    for i, unit in enumerate(blocks.tolist()):
        if interval and i and i % interval == 0:
            out += [packed(text), bytes([0xFF, 0xD0 + (i // interval - 1) % 8])]
            text, last = "", [0] * n
        for k, block in enumerate(unit):
            moved, last[k] = magnitude(block[0] - last[k]), block[0]
            parts, run = [format(len(moved), "04b") + moved], 0
            for v in block[1:]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    parts.append(format(place[0xF0], "08b"))
                    run -= 16
                shown = magnitude(v)
                parts.append(format(place[run << 4 | len(shown)], "08b") + shown)
                run = 0
            text += "".join(parts) + (format(place[0], "08b") if run else "")
    out.append(packed(text))
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    frame = struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(n))
    direct = b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
    other = b"\x10" + bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)
    scan = bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + b"\x00\x3f\x00"
    restart = segment(0xDD, interval.to_bytes(2, "big")) if interval else b""
    return b"\xff\xd8" + segment(0xDB, b"\x00" + bytes([step] * 64)) + segment(0xC0, frame) + segment(0xC4, direct) + segment(0xC4, other) + restart + segment(0xDA, scan) + b"".join(out) + b"\xff\xd9"
