"""PDF syntax: the values of an object graph, their reader and their writer.

Values are Python's own (None, bool, int, float, bytes for strings, list, dict) and Name, Ref and Stream. A dict key set to
null is absent, the last of equal keys counts, and a last null removes the key.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

MAX_NESTING = 256


class Fault(ValueError):
    """What is wrong with a document, as a code that goes into a row's error column."""

    def __init__(self, code: str, message: str, offset: int = -1):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.offset = code, message, offset

    def __reduce__(self):
        return Fault, (self.code, self.message, self.offset)


def code_of(error: Exception) -> str:
    """The code that goes into a row for what went wrong with its document: never a failed job."""
    return error.code if isinstance(error, Fault) else "limit" if isinstance(error, (RecursionError, MemoryError)) else "internal"


class Name(str):
    """A name; each character is a byte. Never equal to a string, as strings are bytes."""

    __slots__ = ()

    def __repr__(self):
        return f"/{str(self)}"


class Ref(NamedTuple):
    number: int
    generation: int


class Stream:
    """A dictionary and its encoded bytes."""

    __slots__ = ("entries", "raw")

    def __init__(self, entries: dict, raw: bytes):
        self.entries, self.raw = entries, raw

    def __eq__(self, other):
        return isinstance(other, Stream) and (self.entries, self.raw) == (other.entries, other.raw)

    def __repr__(self):
        return f"Stream({self.entries!r}, {len(self.raw)} bytes)"


class Token(NamedTuple):
    """A word that is no value: an operator, or a keyword such as obj."""

    word: bytes


# -- reading ------------------------------------------------------------------------------------------

_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_REFERENCE = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_NAME_ESCAPE = re.compile(rb"#([0-9A-Fa-f]{2})")
_PLAIN_STRING = re.compile(rb"[^()\\\r]*")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_OCTAL = re.compile(rb"[0-7]{1,3}")
# What most strings and arrays are: escapes of parentheses and of three digits only; numbers only.
_SIMPLE_STRING = re.compile(rb"\(((?:[^()\\\r]++|\\[()\\]|\\[0-3][0-7]{2})*+)\)")
_SIMPLE_ESCAPE = re.compile(rb"\\([()\\]|[0-7]{3})")
_UNESCAPED = {b"(": b"(", b")": b")", b"\\": b"\\"} | {b"%03o" % b: bytes([b]) for b in range(256)}
_NUMBERS = re.compile(rb"\[([0-9+\-.\t\n\x0c\r ]*)\]")
_WORDS = {b"true": True, b"false": False, b"null": None}


def parse_number(word: bytes) -> int | float | None:
    """Sign, digits, one dot, no exponent; an integer beyond 64 bits is a real. None if it is no number."""
    if not _NUMBER.match(word):
        return None
    if b"." in word:
        return float(word)
    value = int(word)
    return value if -(1 << 63) <= value < 1 << 63 else float(value)


_number = lru_cache(1 << 12)(parse_number)


def _unescaped(m: re.Match) -> bytes:
    return _UNESCAPED[m[1]]


class Reader:
    """Reads values at a position. content: no references, as in content streams."""

    def __init__(self, data: bytes, at: int = 0, content: bool = False):
        self.data, self.at, self.content = data, at, content

    def skip(self) -> int:
        self.at = _SKIP.match(self.data, self.at).end()
        return self.at

    def done(self) -> bool:
        return self.skip() >= len(self.data)

    def value(self, depth: int = 0):
        """The next value or Token; Fault at the end of the data or on a broken one."""
        data, at = self.data, self.skip()
        if at >= len(data):
            raise Fault("syntax", "the data end", at)
        if depth > MAX_NESTING:
            raise Fault("limit", "nested too deep", at)
        c = data[at]
        if c == 0x2F:
            return self._name()
        if c == 0x28:
            return self._literal()
        if c == 0x3C:
            return self._dictionary(depth) if data[at + 1 : at + 2] == b"<" else self._hex()
        if c == 0x5B:
            return self._array(depth)
        if c in b")]}{>":
            self.at = at + (2 if data[at : at + 2] == b">>" else 1)
            return Token(data[at : self.at])
        if not self.content and 0x30 <= c <= 0x39 and (m := _REFERENCE.match(data, at)):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        end = _REGULAR.match(data, at).end()
        word = data[at:end]
        self.at = max(end, at + 1)
        if word in _WORDS:
            return _WORDS[word]
        number = _number(word)
        return Token(word) if number is None else number

    def _name(self) -> Name:
        end = _REGULAR.match(self.data, self.at + 1).end()
        word = self.data[self.at + 1 : end]
        self.at = end
        if b"#" in word:
            word = _NAME_ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), word)
        return Name(word.decode("latin-1"))

    def _hex(self) -> bytes:
        end = self.data.find(b">", self.at)
        if end < 0:
            raise Fault("syntax", "a hexadecimal string doesn't end", self.at)
        digits = bytes(b for b in self.data[self.at + 1 : end] if b not in b"\x00\t\n\x0c\r ")
        start, self.at = self.at, end + 1
        try:
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("latin-1"))
        except ValueError:
            raise Fault("syntax", "not a hexadecimal digit", start) from None

    def _literal(self) -> bytes:
        if simple := _SIMPLE_STRING.match(self.data, self.at):
            self.at = simple.end()
            return _SIMPLE_ESCAPE.sub(_unescaped, simple[1]) if b"\\" in simple[1] else simple[1]
        data, start, at, depth, out = self.data, self.at, self.at + 1, 1, []
        while True:
            plain = _PLAIN_STRING.match(data, at)
            out.append(plain[0])
            at = plain.end()
            if at >= len(data):
                raise Fault("syntax", "a string doesn't end", start)
            c = data[at : at + 1]
            at += 1
            if c == b"(":
                depth += 1
                out.append(c)
            elif c == b")":
                depth -= 1
                if not depth:
                    self.at = at
                    return b"".join(out)
                out.append(c)
            elif c == b"\r":  # any line end is a line feed
                at += data[at : at + 1] == b"\n"
                out.append(b"\n")
            elif octal := _OCTAL.match(data, at):
                out.append(bytes([int(octal[0], 8) & 255]))
                at = octal.end()
            else:
                nxt = data[at : at + 1]
                at += 1
                if nxt == b"\r":
                    at += data[at : at + 1] == b"\n"
                elif nxt != b"\n":
                    out.append(_ESCAPES.get(nxt, nxt))

    def _array(self, depth: int) -> list:
        if simple := _NUMBERS.match(self.data, self.at):
            numbers = [_number(word) for word in simple[1].split()]
            if None not in numbers and (depth < MAX_NESTING or not numbers):
                self.at = simple.end()
                return numbers
        start, self.at, out = self.at, self.at + 1, []
        while True:
            if self.done():
                raise Fault("syntax", "an array doesn't end", start)
            if self.data[self.at] == 0x5D:
                self.at += 1
                return out
            value = self.value(depth + 1)
            if isinstance(value, Token):
                raise Fault("syntax", f"{value.word!r} in an array", start)
            out.append(value)

    def _dictionary(self, depth: int) -> dict:
        start, self.at, out = self.at, self.at + 2, {}
        while True:
            if self.done():
                raise Fault("syntax", "a dictionary doesn't end", start)
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            key = self.value(depth + 1)
            if not isinstance(key, Name):
                raise Fault("syntax", "a key is not a name", start)
            value = self.value(depth + 1)
            if isinstance(value, Token):
                raise Fault("syntax", f"{value.word!r} in a dictionary", start)
            out.pop(key, None)
            if value is not None:
                out[key] = value

    # -- indirect objects ------------------------------------------------------------------------------

    def word(self, expected: bytes) -> bool:
        """Whether the word comes next; passes it if so."""
        at = self.skip()
        if self.data.startswith(expected, at):
            self.at = at + len(expected)
            return True
        return False

    def indirect(self, length_of=None) -> tuple[Ref, object]:
        """`N G obj` value `endobj`. length_of resolves an indirect /Length."""
        number, generation = self.value(), self.value()
        if type(number) is not int or type(generation) is not int or not self.word(b"obj"):
            raise Fault("syntax", "no object here", self.at)
        value = self.value()
        if isinstance(value, Token):
            value = None if value.word == b"endobj" else self._bad(value)
        if isinstance(value, dict) and self.word(b"stream"):
            value = Stream(value, self._body(value, length_of))
            self.word(b"endstream")
        self.word(b"endobj")
        return Ref(number, generation), value

    def _bad(self, token: Token):
        raise Fault("syntax", f"{token.word!r} is no value", self.at)

    def _body(self, entries: dict, length_of) -> bytes:
        """The declared length is used only if endstream follows; else the body ends before the next endstream."""
        data = self.data
        if data.startswith(b"\r\n", self.at):
            self.at += 2
        elif data[self.at : self.at + 1] in (b"\n", b"\r"):
            self.at += 1
        length = entries.get("Length")
        if isinstance(length, Ref):
            length = length_of(length) if length_of else None
        if type(length) is int and 0 <= length <= len(data) - self.at:
            end = self.at + length
            if data.startswith(b"endstream", _SKIP.match(data, end).end() if data[end : end + 1] != b"%" else end):
                body, self.at = data[self.at : end], end
                return body
        end = data.find(b"endstream", self.at)
        if end < 0:
            raise Fault("syntax", "a stream doesn't end", self.at)
        body, self.at = data[self.at : end], end
        return body[:-2] if body.endswith(b"\r\n") else body[:-1] if body.endswith((b"\n", b"\r")) else body


def tokens(data: bytes):
    """(offset, kind, text) of each token; stops with an `error` row at what can't be read."""
    reader = Reader(data, content=True)
    kinds = {int: "integer", float: "real", Name: "name", bytes: "string", bool: "keyword", type(None): "keyword", Token: "keyword"}
    while not reader.done():
        at, opens = reader.at, data[reader.at : reader.at + 2]
        if opens[:1] in b"[]{}" or opens == b"<<":
            reader.at = at + (2 if opens == b"<<" else 1)
            yield at, "delimiter", data[at : reader.at].decode("latin-1")
            continue
        try:
            value = reader.value()
        except Fault as fault:
            yield at, "error", fault.message
            return
        yield at, "delimiter" if value == Token(b">>") else kinds[type(value)], data[at : reader.at].decode("latin-1")


# -- writing ------------------------------------------------------------------------------------------

_NAME_SAFE = frozenset(b for b in range(0x21, 0x7F) if b not in b"#()<>[]{}/%")
_STRING_SAFE = frozenset(b for b in range(0x20, 0x7F) if b not in b"()\\")
_STRING_UNSAFE = re.compile(rb"[^ -'*-\[\]-~]")
_STRING_TABLE = [bytes([b]) if b in _STRING_SAFE else b"\\" + bytes([b]) if b in b"()\\" else b"\\%03o" % b for b in range(256)]


def format_real(x: float) -> str:
    """Never with an exponent, always with a dot: whole numbers as n.0, else six decimals less the last zeros."""
    if x == round(x) and abs(x) < 1e15:
        return f"{int(x)}.0"
    text = f"{x:.6f}".rstrip("0")
    return text + "0" if text.endswith(".") else text


@lru_cache(1 << 12)
def format_name(name: str) -> bytes:
    return b"/" + b"".join(bytes([b]) if b in _NAME_SAFE else b"#%02X" % b for b in name.encode("latin-1"))


def format_string(data: bytes) -> bytes:
    return b"(" + _STRING_UNSAFE.sub(lambda m: _STRING_TABLE[m[0][0]], data) + b")"


def format_value(value) -> bytes:
    """Canonical syntax: keys in byte order, strings as literals. Of a Stream, its dictionary with the true length."""
    if type(value) is int:
        return b"%d" % value
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Name):
        return format_name(value)
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return format_real(value).encode()
    if isinstance(value, (bytes, bytearray)):
        return format_string(bytes(value))
    if isinstance(value, list):
        return b"[" + b" ".join(map(format_value, value)) + b"]"
    if isinstance(value, Stream):
        return format_value(value.entries | {"Length": len(value.raw)})
    if isinstance(value, dict):
        return b"<<" + b" ".join(format_name(k) + b" " + format_value(v) for k, v in sorted(value.items()) if v is not None) + b">>"
    raise TypeError(f"no PDF value: {type(value)}")


def format_indirect(ref: Ref, value) -> bytes:
    body = format_value(value)
    if isinstance(value, Stream):
        body += b"\nstream\n" + value.raw + b"\nendstream"
    return b"%d %d obj\n" % ref + body + b"\nendobj\n"


# -- strings ------------------------------------------------------------------------------------------


def text_of(data: bytes) -> str:
    """UTF-16BE after a byte order mark (an odd last byte is dropped), else Latin-1."""
    if data[:2] == b"\xfe\xff":
        return data[2 : 2 + (len(data) - 2) // 2 * 2].decode("utf-16-be", "replace")
    return data.decode("latin-1")


def string_of(text: str) -> bytes:
    return b"\xfe\xff" + text.encode("utf-16-be")


def kind_of(value) -> str:
    kinds = {type(None): "null", bool: "boolean", int: "integer", float: "real", bytes: "string", Name: "name", list: "array", dict: "dictionary", Ref: "reference", Stream: "stream"}
    return kinds[type(value)]


#: Kinds that hold no reference.
_ATOMS = frozenset([type(None), bool, int, float, bytes, Name])


def references(value) -> list[Ref]:
    """All references within a value, repeats included; keys in byte order."""
    if isinstance(value, Ref):
        return [value]
    if isinstance(value, list):
        return [r for v in value if type(v) not in _ATOMS for r in references(v)]
    if isinstance(value, Stream):
        value = value.entries
    if isinstance(value, dict):
        return [r for _, v in sorted(value.items()) if type(v) not in _ATOMS for r in references(v)]
    return []


def remapped(value, names: dict[int, int]):
    """The value with references renumbered, generation 0; unknown ones become null."""
    if isinstance(value, Ref):
        return Ref(names[value.number], 0) if value.number in names else None
    if isinstance(value, list):
        return [v if type(v) in _ATOMS else remapped(v, names) for v in value]
    if isinstance(value, Stream):
        return Stream(remapped(value.entries, names), value.raw)
    if isinstance(value, dict):
        return {k: new for k, v in value.items() if (new := remapped(v, names)) is not None}
    return value
