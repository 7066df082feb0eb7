"""Content streams: a page's operators to display items, and the other way."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from functools import lru_cache, reduce
from itertools import accumulate
from operator import add
from typing import NamedTuple

from sheaf.functions import colour, fonts
from sheaf.sources.syntax import Fault, Name, Reader, Stream, Token, format_name, format_real, format_string, format_value, parse_number

FORM_DEPTH = 12
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m, n):
    """m first, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def apply(m, x, y):
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


_number = lru_cache(1 << 12)(parse_number)
# What most of a content stream is: numbers, strings without escapes, operators.
_LEXEME = re.compile(rb"[\x00\t\n\x0c\r ]*(?:([+-]?(?:\d+\.?\d*|\.\d+))(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])|\(([^()\\\r]*)\)|([A-Za-z'\"*][^\x00\t\n\x0c\r ()<>\[\]{}/%]*))")
_VALUES = frozenset([b"true", b"false", b"null", b"BI"])


def lexemes(data: bytes, strict: bool = False):
    """(operator, operands) in order; an inline image as (`BI`, [entries, bytes]). Ends at what can't be read, or if strict raises."""
    reader, operands = Reader(data, content=True), []
    while True:
        while m := _LEXEME.match(data, reader.at):
            kind = m.lastindex
            if kind == 3:
                if m[3] in _VALUES:
                    break
                reader.at = m.end()
                yield m[3].decode("latin-1"), operands
                operands = []
            else:
                reader.at = m.end()
                operands.append(_number(m[1]) if kind == 1 else m[2])
        if reader.done():
            return
        try:
            value = reader.value()
        except Fault:
            if strict:
                raise
            return
        if not isinstance(value, Token):
            operands.append(value)
            continue
        if value.word == b"BI":
            try:
                yield "BI", _inline_image(reader)
            except Fault:
                if strict:
                    raise
                return
        else:
            yield value.word.decode("latin-1"), operands
        operands = []


def _inline_image(reader: Reader) -> list:
    entries: dict = {}
    while True:
        key = reader.value()
        if key == Token(b"ID"):
            break
        if not isinstance(key, Name):
            raise Fault("syntax", "a broken inline image", reader.at)
        value = reader.value()
        if isinstance(value, Token):
            raise Fault("syntax", "a broken inline image", reader.at)
        entries[key] = value
    start, data, blank = reader.at + 1, reader.data, b"\x00\t\n\x0c\r "
    at = start
    while (at := data.find(b"EI", at)) >= 0:
        if (at == start or data[at - 1] in blank) and (at + 2 >= len(data) or data[at + 2] in blank):
            reader.at = at + 2
            return [entries, data[start : max(start, at - 1)]]
        at += 2
    raise Fault("syntax", "an inline image doesn't end", start)


@dataclass
class State:
    ctm: tuple = IDENTITY
    line_width: float = 1.0
    fill: tuple = (0.0, 0.0, 0.0)
    stroke: tuple = (0.0, 0.0, 0.0)
    fill_space: object = None
    stroke_space: object = None
    font: fonts.Font | None = None
    font_size: float = 0.0
    char_gap: float = 0.0
    word_gap: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0
    tm: tuple = IDENTITY
    line: tuple = IDENTITY
    clip: tuple = ()

    def next_line(self, x: float, y: float) -> None:
        self.line = times((1.0, 0.0, 0.0, 1.0, x, y), self.line)
        self.tm = self.line


@dataclass(slots=True)
class Glyph:
    code: int
    text: str
    x: float
    y: float
    end_x: float
    end_y: float
    advance: float
    size: int


@dataclass
class Item:
    """kind: text, path, image, shading, begin, end. What else it has depends on the kind."""

    kind: str
    ctm: tuple = IDENTITY
    glyphs: list | None = None
    font_size: float = 0.0
    mode: int = 0
    color: tuple = (0.0, 0.0, 0.0)
    stroke: tuple | None = None
    path: list | None = None
    paint: str = ""
    name: str | None = None
    image: object = None
    line_width: float = 1.0
    clip: tuple = ()  # of (steps, rule), all in force


class Interpreter:
    """Runs one page. own_resources: look for resources in the page itself only, not in its ancestors."""

    def __init__(self, document, own_resources: bool = False):
        self.document, self.own, self.items = document, own_resources, []
        self.fonts: dict[int, fonts.Font] = {}

    def page(self, page: dict) -> list[Item]:
        resources = self.document.dictionary(page.get("Resources")) if self.own else self.document.attributes(page)["resources"]
        self.run(self.document.content(page), resources, State(), 0)
        return self.items

    def resource(self, resources: dict, category: str, name: str):
        return self.document.resolve(self.document.dictionary(resources.get(category)).get(name))

    def font(self, resources: dict, name: str) -> fonts.Font | None:
        entries = self.resource(resources, "Font", name)
        if not isinstance(entries, dict):
            return None
        if id(entries) not in self.fonts:
            self.fonts[id(entries)] = fonts.Font(self.document, entries)
        return self.fonts[id(entries)]

    def space(self, operand, resources: dict):
        named = self.resource(resources, "ColorSpace", operand) if isinstance(operand, Name) else None
        return colour.space_of(self.document, operand if named is None else named)

    def show(self, s: State, data: bytes) -> None:
        """A run of glyphs; without a font nothing is shown and nothing moves."""
        if s.font is None:
            return
        a, b, c, d, e, f = s.tm
        m = times(s.tm, s.ctm)
        x, y = m[2] * s.rise + m[4], m[3] * s.rise + m[5]
        size, gap, word_gap, scale, moved, glyphs = s.font_size, s.char_gap, s.word_gap, s.scale, 0.0, []
        for code, n, text, width in s.font.glyphs(data):
            # Along the run only the origin moves, by the advance in the direction of the matrix.
            here, reach = moved, width * size * scale
            moved += reach + (gap + word_gap if code == 32 and n == 1 else gap) * scale
            at, end = (x + here * m[0], y + here * m[1]), here + reach
            glyphs.append(Glyph(code, text, at[0], at[1], x + end * m[0], y + end * m[1], width, n))
        s.tm = (a, b, c, d, e + moved * a, f + moved * b)
        if glyphs:
            self.items.append(Item("text", s.ctm, glyphs, s.font_size, s.mode, s.fill, clip=s.clip))

    def run(self, content: bytes, resources: dict, s: State, depth: int) -> None:
        if depth >= FORM_DEPTH:
            return
        stack: list[State] = []
        path: list = []
        clips = ""  # the rule of a clip that the next painting operator brings into force
        for op, operands in lexemes(content):
            n = [float(o) if isinstance(o, (int, float)) and not isinstance(o, bool) else 0.0 for o in operands]
            if op in _SHOW:
                if op == '"':
                    if len(operands) < 3:
                        continue
                    s.word_gap, s.char_gap = n[0], n[1]
                if op in "'\"":
                    s.next_line(0, -s.leading)
                if op == "TJ":
                    for part in operands[-1] if operands and isinstance(operands[-1], list) else []:
                        if isinstance(part, bytes):
                            self.show(s, part)
                        elif isinstance(part, (int, float)):
                            move = -part / 1000 * s.font_size * s.scale
                            s.tm = times((1.0, 0.0, 0.0, 1.0, move, 0.0), s.tm)
                elif operands and isinstance(operands[-1], bytes):
                    self.show(s, operands[-1])
            elif op == "q":
                stack.append(replace(s))
            elif op == "Q":
                s = stack.pop() if stack else s
            elif op in PATH_STEPS:
                if op not in PAINT_OPERATORS:
                    path = PATH_STEPS[op](path, n, s.ctm)
                    continue
                within = ((tuple(path), clips),) if clips and path else ()
                path, clips = self.paint(op, path, s), ""
                s.clip += within
            elif op in ("W", "W*"):
                clips = "evenodd" if op == "W*" else "nonzero"
            elif op in TEXT_STATE:
                TEXT_STATE[op](s, n, operands)
            elif op == "Tf":
                if len(operands) >= 2 and isinstance(operands[-2], Name):
                    s.font_size, s.font = n[-1], self.font(resources, operands[-2])
            elif op in _COLOUR:
                side, space = _COLOUR[op]
                setattr(s, f"{side}_space", space)
                setattr(s, side, space.rgb(n))
            elif op in ("cs", "CS"):
                setattr(s, "fill_space" if op == "cs" else "stroke_space", self.space(operands[-1] if operands else None, resources))
            elif op in ("sc", "scn", "SC", "SCN"):
                side = "fill" if op[0] == "s" else "stroke"
                setattr(s, side, (getattr(s, f"{side}_space") or colour.GRAY).rgb(n))
            elif op == "Do":
                if operands and isinstance(operands[-1], Name):
                    self.invoke(operands[-1], resources, s, depth)
            elif op == "BI":
                self.items.append(Item("image", s.ctm, color=s.fill, image=Stream(operands[0], operands[1]), clip=s.clip))
            elif op == "sh":
                if operands and isinstance(operands[-1], Name):
                    self.items.append(Item("shading", s.ctm, name=operands[-1]))
            elif op in ("BMC", "BDC"):
                self.items.append(Item("begin", name=operands[0] if operands and isinstance(operands[0], Name) else ""))
            elif op == "EMC":
                self.items.append(Item("end"))

    def paint(self, op: str, path: list, s: State) -> list:
        if op in ("s", "b", "b*"):
            path.append(("close",))
        if op != "n" and path:
            rule = ("evenodd" if op.endswith("*") else "nonzero") if op not in ("S", "s") else ""
            self.items.append(Item("path", s.ctm, path=path, paint=op, color=s.fill if rule else (), stroke=s.stroke if op in ("S", "s", "B", "B*", "b", "b*") else None, name=rule, line_width=s.line_width, clip=s.clip))
        return []

    def invoke(self, name: str, resources: dict, s: State, depth: int) -> None:
        target = self.resource(resources, "XObject", name)
        if not isinstance(target, Stream):
            return
        if target.entries.get("Subtype") == "Image":
            self.items.append(Item("image", s.ctm, color=s.fill, name=name, image=target, clip=s.clip))
        elif target.entries.get("Subtype") == "Form":
            matrix = [self.document.number(x) for x in self.document.array(target.entries.get("Matrix"))]
            inner = replace(s)
            if len(matrix) == 6 and None not in matrix:
                inner.ctm = times(tuple(matrix), s.ctm)
            own = self.document.resolve(target.entries.get("Resources"))
            try:
                self.run(self.document.decoded(target), own if isinstance(own, dict) else resources, inner, depth + 1)
            except Fault:
                return


class Intricate(Exception):
    """What Runs leaves to the Interpreter."""


class Run(NamedTuple):
    """A level run of glyphs from the left: where it begins and its last glyph begins, the same along the run, how far it moves, a step for each code."""

    x: float
    y: float
    last_x: float
    scale: float
    here: float
    moved: float
    steps: list[float]


class Level:
    """Where runs lie, without their glyphs: for those that are level, go to the right, and have a character for each byte."""

    def __init__(self):
        self.steps: dict[tuple, list[float] | None] = {}

    def run(self, s: State, data: bytes) -> Run | None:
        table = s.font.single if s.font is not None and data else None
        m = times(s.tm, s.ctm)
        if table is None or m[1] != 0 or not m[0] > 0:
            return None
        key = (id(s.font), s.font_size, s.char_gap, s.word_gap, s.scale)
        if key not in self.steps:
            steps = [w * s.font_size * s.scale + (s.char_gap + s.word_gap if code == 32 else s.char_gap) * s.scale for code, w in enumerate(table[1])]
            self.steps[key] = steps if min(steps) >= 0 and s.font_size >= 0 and s.scale >= 0 and min(table[1]) >= 0 else None
        if (steps := self.steps[key]) is None:
            return None
        x, y = m[2] * s.rise + m[4], m[3] * s.rise + m[5]
        here = reduce(add, map(steps.__getitem__, data[:-1]), 0.0)  # one by one, as glyphs move
        return Run(x, y, x + here * m[0], m[0], here, here + steps[data[-1]], steps)

    @staticmethod
    def move(s: State, run: Run) -> None:
        a, b, c, d, e, f = s.tm
        s.tm = (a, b, c, d, e + run.moved * a, f + run.moved * b)


class Text(NamedTuple):
    """A run's text, where it begins, where its last character ends, its size; and what its places follow from."""

    text: str
    x: float
    y: float
    end_x: float
    size: float
    last_width: float
    scale: float
    data: bytes
    steps: list[float]

    def places(self) -> list[float]:
        """Where each character begins."""
        return [self.x + here * self.scale for here in accumulate(map(self.steps.__getitem__, self.data[:-1]), initial=0.0)]


class Runs(Interpreter):
    """The texts of a page run by run; Intricate where one has to be taken glyph by glyph."""

    def __init__(self, document, own_resources: bool = False, invisible: bool = True):
        super().__init__(document, own_resources)
        self.invisible, self.texts, self.level = invisible, [], Level()

    def show(self, s: State, data: bytes) -> None:
        if s.font is None or not data:
            return
        if (run := self.level.run(s, data)) is None:
            raise Intricate
        self.level.move(s, run)
        if s.mode != 3 or self.invisible:
            characters, widths = s.font.single
            width = widths[data[-1]] * s.font_size
            self.texts.append(Text(data.decode("latin-1").translate(characters), run.x, run.y, run.last_x + width, s.font_size, width, run.scale, data, run.steps))


def _append(make):
    def add(path, n, ctm):
        made = make(path, n, ctm)
        return path + made if made else path

    return add


def _rectangle(path, n, ctm):
    if len(n) < 4:
        return []
    x, y, w, h = n[:4]
    corners = [apply(ctm, *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    return [("move", corners[0]), *(("line", c) for c in corners[1:]), ("close",)]


def _last(path):
    return next((step[-1] for step in reversed(path) if len(step) > 1), (0.0, 0.0))


PAINT_OPERATORS = frozenset(["f", "F", "f*", "S", "s", "B", "B*", "b", "b*", "n"])
PATH_STEPS = {
    "m": _append(lambda p, n, m: [("move", apply(m, *n[:2]))] if len(n) > 1 else []),
    "l": _append(lambda p, n, m: [("line", apply(m, *n[:2]))] if len(n) > 1 else []),
    "c": _append(lambda p, n, m: [("curve", apply(m, *n[:2]), apply(m, *n[2:4]), apply(m, *n[4:6]))] if len(n) > 5 else []),
    "v": _append(lambda p, n, m: [("curve", _last(p), apply(m, *n[:2]), apply(m, *n[2:4]))] if len(n) > 3 else []),
    "y": _append(lambda p, n, m: [("curve", apply(m, *n[:2]), apply(m, *n[2:4]), apply(m, *n[2:4]))] if len(n) > 3 else []),
    "re": _append(_rectangle),
    "h": _append(lambda p, n, m: [("close",)]),
    **dict.fromkeys(PAINT_OPERATORS),
}
_SHOW = frozenset(["Tj", "TJ", "'", '"'])


def _begin(s, n, o):
    s.tm = s.line = IDENTITY


def _move_leading(s, n, o):
    if len(n) > 1:
        s.leading = -n[1]
        s.next_line(n[0], n[1])


def _matrix(s, n, o):
    if len(o) == 6:
        s.tm = s.line = tuple(n)


def _concat(s, n, o):
    if len(o) == 6:
        s.ctm = times(tuple(n), s.ctm)


TEXT_STATE = {
    "BT": _begin,
    "ET": lambda s, n, o: None,
    "Td": lambda s, n, o: s.next_line(n[0], n[1]) if len(n) > 1 else None,
    "TD": _move_leading,
    "Tm": _matrix,
    "T*": lambda s, n, o: s.next_line(0, -s.leading),
    "Tc": lambda s, n, o: setattr(s, "char_gap", n[0] if n else 0.0),
    "Tw": lambda s, n, o: setattr(s, "word_gap", n[0] if n else 0.0),
    "Tz": lambda s, n, o: setattr(s, "scale", (n[0] if n else 100.0) / 100),
    "TL": lambda s, n, o: setattr(s, "leading", n[0] if n else 0.0),
    "Ts": lambda s, n, o: setattr(s, "rise", n[0] if n else 0.0),
    "Tr": lambda s, n, o: setattr(s, "mode", int(n[0]) if n else 0),
    "cm": _concat,
    "w": lambda s, n, o: setattr(s, "line_width", n[0]) if n else None,
}
_COLOUR = {
    "g": ("fill", colour.GRAY), "G": ("stroke", colour.GRAY), "rg": ("fill", colour.RGB), "RG": ("stroke", colour.RGB), "k": ("fill", colour.CMYK), "K": ("stroke", colour.CMYK),
}


# -- generating ---------------------------------------------------------------------------------------

# The operator of each emitter.
EMITTERS = {
    "save_state": "q", "restore_state": "Q", "concat": "cm", "set_line_width": "w", "move_to": "m", "line_to": "l", "curve_to": "c", "rect": "re",
    "close_path": "h", "fill": "f", "stroke": "S", "fill_stroke": "B", "end_path": "n", "set_fill_rgb": "rg", "set_fill_gray": "g", "set_fill_cmyk": "k",
    "set_stroke_rgb": "RG", "set_stroke_gray": "G", "set_stroke_cmyk": "K", "invoke_xobject": "Do", "set_ext_gstate": "gs", "begin_text": "BT", "end_text": "ET",
    "set_font": "Tf", "set_text_matrix": "Tm", "next_line": "Td", "set_leading": "TL", "set_char_spacing": "Tc", "set_word_spacing": "Tw",
    "show_text": "Tj", "show_text_adjusted": "TJ", "begin_marked_content": "BMC", "end_marked_content": "EMC",
}
_BALANCE = {"q": ("q", 1), "Q": ("q", -1), "BT": ("BT", 1), "ET": ("BT", -1), "BMC": ("BMC", 1), "EMC": ("BMC", -1)}


class Generator:
    """Writes operators: generator.emit("set_font", Name("F1"), 12). bytes() checks that all pairs are closed."""

    def __init__(self):
        self.lines: list[bytes] = []
        self.open: dict[str, int] = {}

    def emit(self, emitter: str, *operands) -> Generator:
        op = EMITTERS[emitter]
        if op in _BALANCE:
            pair, step = _BALANCE[op]
            self.open[pair] = self.open.get(pair, 0) + step
            if self.open[pair] < 0:
                raise Fault("content", f"{op} closes nothing")
        self.lines.append(b" ".join([*map(operand_bytes, operands), op.encode()]))
        return self

    def bytes(self) -> bytes:
        if any(self.open.values()):
            raise Fault("content", "an operator isn't closed")
        return b"\n".join(self.lines)


def operand_bytes(value) -> bytes:
    """An operand; whole reals as integers."""
    if isinstance(value, float):
        return b"%d" % value if value == math.floor(value) and abs(value) < 1e15 else format_real(value).encode()
    if isinstance(value, list):
        return b"[" + b" ".join(map(operand_bytes, value)) + b"]"
    return format_name(value) if isinstance(value, Name) else format_string(value) if isinstance(value, bytes) else format_value(value)


def operation_bytes(op: str, operands: list) -> bytes:
    """An operator of lexemes() written again."""
    if op == "BI":
        body = b" ".join(format_name(k) + b" " + operand_bytes(v) for k, v in operands[0].items())
        return b"BI " + body + b" ID " + operands[1] + b"\nEI"
    return b" ".join([*map(operand_bytes, operands), op.encode("latin-1")])
