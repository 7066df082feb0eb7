"""Fonts: codes of a string, their text and widths; encodings, glyph names and character maps."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from sheaf.sources.syntax import Fault, Name, Reader, Stream, Token

UNKNOWN = "�"

# -- encodings ----------------------------------------------------------------------------------------

# The part of the MacRoman high range that is supported.
MAC_HIGH = {
    0x80: "Ä", 0x8E: "é", 0x8F: "è", 0x9A: "ö", 0x9F: "ü", 0xA5: "•", 0xAA: "™", 0xC7: "«", 0xC8: "»",
    0xC9: "…", 0xD0: "–", 0xD1: "—", 0xD2: "“", 0xD3: "”", 0xD4: "‘", 0xD5: "’",
}
BASE_ENCODINGS = ("StandardEncoding", "WinAnsiEncoding", "MacRomanEncoding", "PDFDocEncoding")


def base_unicode(encoding: str, code: int) -> str | None:
    """A code's character: ASCII in all (Standard has curved quotes), then by encoding."""
    if 0x20 <= code <= 0x7E:
        return {0x27: "’", 0x60: "‘"}.get(code, chr(code)) if encoding == "StandardEncoding" else chr(code)
    if encoding == "MacRomanEncoding":
        return MAC_HIGH.get(code)
    if 0xA0 <= code <= 0xFF:
        return chr(code)
    if encoding != "StandardEncoding" and 0x80 <= code <= 0x9F:
        return bytes([code]).decode("cp1252", "ignore") or None
    return None


# Glyph names that aren't built by a rule.
GLYPH_NAMES = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`",
    "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "quoteright": "’", "quoteleft": "‘", "bullet": "•", "endash": "–", "emdash": "—", "quotedblleft": "“", "quotedblright": "”",
    "quotesinglbase": "‚", "quotedblbase": "„", "ellipsis": "…", "dagger": "†", "daggerdbl": "‡", "trademark": "™",
    "copyright": "©", "registered": "®", "degree": "°", "plusminus": "±", "periodcentered": "·", "nbspace": " ",
    "euro": "€", "sterling": "£", "cent": "¢", "yen": "¥", "section": "§", "paragraph": "¶", "germandbls": "ß",
    "fi": "ﬁ", "fl": "ﬂ", "florin": "ƒ",
}
# Accents in the names of accented Latin letters.
_ACCENTS = {"dieresis": "̈", "acute": "́", "grave": "̀", "cedilla": "̧", "tilde": "̃", "circumflex": "̂"}


def glyph_unicode(name: str) -> str:
    """A glyph name's characters: by table, letter and accent, uniXXXX, uXXXX to uXXXXXX, or without its suffix."""
    if not name or name == ".notdef":
        return ""
    if name in GLYPH_NAMES:
        return GLYPH_NAMES[name]
    if len(name) == 1:
        return name if name.isascii() and name.isalnum() else ""
    if (mark := _ACCENTS.get(name[1:])) and name[0].isascii() and name[0].isalpha():
        whole = unicodedata.normalize("NFC", name[0] + mark)
        if len(whole) == 1:
            return whole
    if re.fullmatch(r"uni(?:[0-9A-Fa-f]{4})+", name):
        values = [int(name[i : i + 4], 16) for i in range(3, len(name), 4)]
        return "" if any(0xD800 <= v < 0xE000 for v in values) else "".join(map(chr, values))
    if re.fullmatch(r"u[0-9A-Fa-f]{4,6}", name) and not (0xD800 <= (v := int(name[1:], 16)) < 0xE000) and v < 0x110000:
        return chr(v)
    return glyph_unicode(name.split(".", 1)[0]) if "." in name else ""


# -- character maps -----------------------------------------------------------------------------------


@dataclass
class CMap:
    """Code spaces, and codes to identifiers or text: single ones before ranges, the first range counting."""

    spaces: list[tuple[int, int, int]] = field(default_factory=list)  # bytes, low, high
    cids: dict[tuple[int, int], int] = field(default_factory=dict)
    cid_ranges: list[tuple[int, int, int, int]] = field(default_factory=list)  # bytes, low, high, first
    texts: dict[tuple[int, int], str] = field(default_factory=dict)
    text_ranges: list[tuple[int, int, int, str]] = field(default_factory=list)
    is_identity: bool = False

    @classmethod
    def identity(cls) -> CMap:
        return cls([(2, 0, 0xFFFF)], is_identity=True)

    @classmethod
    def parse(cls, data: bytes) -> CMap:
        out, held, reader = cls(), [], Reader(data, content=True)
        while not reader.done():
            try:
                value = reader.value()
            except Fault:
                break
            if not isinstance(value, Token):
                held.append(value)
                continue
            word = value.word
            if word == b"usecmap" and held and isinstance(held[-1], Name) and held[-1].startswith("Identity"):
                out.spaces.append((2, 0, 0xFFFF))
                out.is_identity = True
            elif word.startswith(b"begin"):
                pass
            elif word == b"endcodespacerange":
                out.spaces += [(len(a), _int(a), _int(b)) for a, b in _groups(held, 2) if isinstance(a, bytes) and isinstance(b, bytes)]
            elif word == b"endcidchar":
                out.cids.update(((len(a), _int(a)), n) for a, n in _groups(held, 2) if isinstance(a, bytes) and type(n) is int)
            elif word == b"endcidrange":
                out.cid_ranges += [(len(a), _int(a), _int(b), n) for a, b, n in _groups(held, 3) if isinstance(a, bytes) and isinstance(b, bytes) and type(n) is int]
            elif word == b"endbfchar":
                out.texts.update(((len(a), _int(a)), _utf16(b)) for a, b in _groups(held, 2) if isinstance(a, bytes) and isinstance(b, bytes))
            elif word == b"endbfrange":
                for a, b, to in _groups(held, 3):
                    if not isinstance(a, bytes) or not isinstance(b, bytes):
                        continue
                    if isinstance(to, list):
                        out.texts.update(((len(a), _int(a) + i), _utf16(t)) for i, t in enumerate(to) if isinstance(t, bytes) and _int(a) + i <= _int(b))
                    elif isinstance(to, bytes):
                        out.text_ranges.append((len(a), _int(a), _int(b), _utf16(to)))
            if word.startswith((b"begin", b"end")) or word in (b"usecmap", b"def"):
                held = []
        return out

    def split(self, data: bytes) -> list[tuple[int, int]]:
        """(code, bytes) in order: by the first code space that fits, else as long as the first one says."""
        if not self.spaces:
            return [(b, 1) for b in data]
        out, at = [], 0
        while at < len(data):
            for n, low, high in self.spaces:
                code = data[at : at + n]
                if len(code) == n and all(a <= c <= b for a, c, b in zip(low.to_bytes(n, "big"), code, high.to_bytes(n, "big"), strict=True)):
                    break
            else:
                n = self.spaces[0][0]
            code = data[at : at + n]
            out.append((_int(code), n))
            at += n
        return out

    def cid(self, code: int, size: int) -> int:
        if (size, code) in self.cids:
            return self.cids[size, code]
        for n, low, high, first in self.cid_ranges:
            if n == size and low <= code <= high:
                return first + code - low
        return code if self.is_identity else 0

    def text(self, code: int, size: int) -> str | None:
        if (size, code) in self.texts:
            return self.texts[size, code]
        for n, low, high, first in self.text_ranges:
            if n == size and low <= code <= high and first:
                last = ord(first[-1]) + code - low
                return first[:-1] + (chr(last) if last < 0x110000 and not 0xD800 <= last < 0xE000 else UNKNOWN)
        return None


def _int(data: bytes) -> int:
    return int.from_bytes(data, "big")


def _utf16(data: bytes) -> str:
    return data[: len(data) // 2 * 2].decode("utf-16-be", "replace") if len(data) > 1 else data.decode("latin-1")


def _groups(values: list, n: int):
    return zip(*[iter(values)] * n, strict=False)


# -- fonts --------------------------------------------------------------------------------------------


def _character(base: str, differences: dict[int, str], code: int) -> str:
    if code in differences:
        return glyph_unicode(differences[code]) or UNKNOWN
    return base_unicode(base, code) or UNKNOWN


@lru_cache(256)
def _characters(base: str, differences: tuple) -> str | None:
    """The character of each byte, where every one has just one."""
    texts = [_character(base, dict(differences), code) for code in range(256)]
    return "".join(texts) if all(len(t) == 1 for t in texts) else None


class Font:
    """A font resource: simple ones have a byte for each code, composite ones a character map."""

    def __init__(self, document, entries: dict):
        d = document
        self.composite = entries.get("Subtype") == "Type0"
        stream = d.resolve(entries.get("ToUnicode"))
        self.to_unicode = None
        if isinstance(stream, Stream):
            try:
                self.to_unicode = CMap.parse(d.decoded(stream))
            except Fault:
                pass
        self.cache: dict[int, tuple[str, float]] = {}
        if self.composite:
            encoding = d.resolve(entries.get("Encoding"))
            try:
                self.cmap = CMap.parse(d.decoded(encoding)) if isinstance(encoding, Stream) else CMap.identity()
            except Fault:
                self.cmap = CMap.identity()
            kids = d.array(entries.get("DescendantFonts"))
            below = d.dictionary(kids[0]) if kids else {}
            default = d.number(below.get("DW"))
            self.default = 1000.0 if default is None else default
            self.cid_widths = self._cid_widths(d, d.array(below.get("W")))
            return
        encoding = d.resolve(entries.get("Encoding"))
        base = encoding if isinstance(encoding, Name) else d.dictionary(encoding).get("BaseEncoding")
        self.base = base if base in BASE_ENCODINGS else "WinAnsiEncoding" if entries.get("Subtype") == "TrueType" else "StandardEncoding"
        self.differences: dict[int, str] = {}
        code = 0
        for item in d.array(d.dictionary(encoding).get("Differences")) if not isinstance(encoding, Name) else []:
            item = d.resolve(item)
            if type(item) is int:
                code = item
            elif isinstance(item, Name):
                self.differences[code] = item
                code += 1
        self.first = int(d.number(entries.get("FirstChar")) or 0)
        self.widths = [float(w) if type(w) in (int, float) else d.number(w) or 0.0 for w in d.array(entries.get("Widths"))]
        self.default = d.number(d.dictionary(entries.get("FontDescriptor")).get("MissingWidth")) or 0.0

    @staticmethod
    def _cid_widths(d, items: list) -> dict[int, float]:
        out, i = {}, 0
        while i < len(items):
            first, nxt = d.number(items[i]), d.resolve(items[i + 1]) if i + 1 < len(items) else None
            if first is None:
                break
            if isinstance(nxt, list):
                out.update((int(first) + k, d.number(w) or 0.0) for k, w in enumerate(nxt))
                i += 2
            else:
                last, width = d.number(nxt), d.number(items[i + 2]) if i + 2 < len(items) else None
                if last is None or width is None or last - first > 0xFFFF:
                    break
                out.update((c, width) for c in range(int(first), int(last) + 1))
                i += 3
        return out

    def glyphs(self, data: bytes) -> list[tuple[int, int, str, float]]:
        """(code, bytes, text, width in text space) of each code."""
        if not self.composite and self.to_unicode is None:
            out = []
            for code in data:
                found = self.cache.get(code)
                if found is None:
                    found = self.cache[code] = (self._simple(code), self._width(code, 1))
                out.append((code, 1, *found))
            return out
        codes = self.cmap.split(data) if self.composite else [(b, 1) for b in data]
        return [(code, n, self.text(code, n), self._width(code, n)) for code, n in codes]

    @cached_property
    def single(self) -> tuple[str, list[float]] | None:
        """The character and the width of each byte, where every one has just one."""
        if self.composite or self.to_unicode is not None:
            return None
        characters = _characters(self.base, tuple(self.differences.items()))
        return None if characters is None else (characters, [self._width(code, 1) for code in range(256)])

    def text(self, code: int, size: int) -> str:
        if self.to_unicode is not None and (found := self.to_unicode.text(code, size)) is not None:
            return found
        return UNKNOWN if self.composite else self._simple(code)

    def _simple(self, code: int) -> str:
        return _character(self.base, self.differences, code)

    def _width(self, code: int, size: int) -> float:
        if self.composite:
            return self.cid_widths.get(self.cmap.cid(code, size), self.default) / 1000
        i = code - self.first
        return (self.widths[i] if 0 <= i < len(self.widths) else self.default) / 1000


def helvetica() -> dict:
    return {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}
