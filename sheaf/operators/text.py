"""Reading order: glyphs to characters, lines, columns and words, and the search over them."""

from __future__ import annotations

from dataclasses import dataclass

from sheaf.operators.content import Interpreter, Intricate, Item, Runs

# Fixed values, in font sizes: same line, gap between fragments, gap between words.
LINE, FRAGMENT, WORD = 0.5, 2.0, 0.25
# Within these, what rounding does to a place is far below a gap.
FAR, NEAR = 1e9, 1e-3


@dataclass(slots=True)
class Char:
    text: str
    x: float
    y: float
    width: float
    size: float

    @property
    def box(self):
        return self.x, self.y, self.x + self.width, self.y + self.size


def chars_of(items: list[Item], invisible: bool = True) -> list[Char]:
    """Each glyph with text, as wide as to the next one of its run; the last by its advance. Mode 3 is invisible."""
    out = []
    for item in items:
        if item.kind != "text" or (item.mode == 3 and not invisible):
            continue
        glyphs, size = item.glyphs, item.font_size
        for g, after in zip(glyphs, [*glyphs[1:], None], strict=True):
            if g.text:
                width = g.advance * size if after is None else after.x - g.x if after.y == g.y and after.x >= g.x else ((after.x - g.x) ** 2 + (after.y - g.y) ** 2) ** 0.5
                out.append(Char(g.text, g.x, g.y, width, size))
    return out


def lines_of(chars: list[Char]) -> list[list[Char]]:
    """From the top; a character joins the line whose first one it lies level with. Within lines from the left."""
    lines: list[list[Char]] = []
    for c in sorted(chars, key=lambda c: -c.y):
        if lines and abs(lines[-1][0].y - c.y) <= LINE * max(c.size, 1):
            lines[-1].append(c)
        else:
            lines.append([c])
    return [sorted(line, key=lambda c: c.x) for line in lines]


def fragments_of(line: list[Char]) -> list[list[Char]]:
    """Split at wide gaps."""
    out = [[line[0]]]
    for before, c in zip(line, line[1:], strict=False):
        if c.x - (before.x + before.width) > FRAGMENT * max(c.size, 1):
            out.append([])
        out[-1].append(c)
    return out


def columns_of(fragments: list[list[Char]]) -> list[list[list[Char]]]:
    """From the left, each fragment goes to the first column whose range it overlaps, and widens it."""
    columns: list[list] = []
    spans = [(min(c.x for c in f), max(c.x + c.width for c in f), f) for f in fragments]
    for low, high, fragment in sorted(spans, key=lambda s: s[0]):
        for column in columns:
            if low <= column[1] and high >= column[0]:
                column[0], column[1] = min(column[0], low), max(column[1], high)
                column[2].append(fragment)
                break
        else:
            columns.append([low, high, [fragment]])
    return [sorted(c[2], key=lambda f: -f[0].y) for c in sorted(columns, key=lambda c: c[0])]


def words_of(line: list[Char]) -> list[list[Char]]:
    """White space parts words and is dropped; so does a gap."""
    out: list[list[Char]] = []
    before = None
    for c in line:
        if c.text.isspace():
            before = None
            continue
        if before is None or c.x - (before.x + before.width) > WORD * max(c.size, 1):
            out.append([])
        out[-1].append(c)
        before = c
    return out


def union_box(boxes) -> tuple[float, float, float, float]:
    boxes = list(boxes)
    if not boxes:
        return 0.0, 0.0, 0.0, 0.0
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def blocks_of(chars: list[Char]) -> list[list[list[list[Char]]]]:
    """Columns of lines of words of characters."""
    fragments = [f for line in lines_of(chars) for f in fragments_of(line)]
    return [[words for line in column if (words := words_of(line))] for column in columns_of(fragments)]


def assembled(blocks) -> tuple[str, list[Char | None]]:
    """The text, words parted by blanks and lines by line feeds, and the character behind each of its code points."""
    text, behind = [], []
    for line in (line for block in blocks for line in block):
        if text:
            text.append("\n")
            behind.append(None)
        for i, word in enumerate(line):
            if i:
                text.append(" ")
                behind.append(None)
            for c in word:
                text.append(c.text)
                behind += [c] * len(c.text)
    return "".join(text), behind


def page_blocks(document, page: dict, own_resources: bool = False, invisible: bool = True):
    return blocks_of(chars_of(Interpreter(document, own_resources).page(page), invisible))


def page_text(document, page: dict, **options) -> str:
    plain = _plain_text(document, page, **options)
    return assembled(page_blocks(document, page, **options))[0] if plain is None else plain


def _plain_runs(document, page: dict, own_resources: bool = False, invisible: bool = True) -> list | None:
    """The runs from the top, where each is a line of its own and all are one column; else None.

    A run's characters touch, so only white space parts its words.
    """
    machine = Runs(document, own_resources, invisible)
    try:
        machine.page(page)
    except Intricate:
        return None
    runs = sorted(machine.texts, key=lambda r: -r.y)
    for r in runs:
        if not (abs(r.x) < FAR and abs(r.y) < FAR and abs(r.end_x) < FAR):
            return None
    for above, r in zip(runs, runs[1:], strict=False):
        if abs(above.y - r.y) <= LINE * max(r.size, 1):
            return None
    return runs if not runs or max(r.x for r in runs) + NEAR < min(r.end_x for r in runs) else None


def _plain_text(document, page: dict, own_resources: bool = False, invisible: bool = True) -> str | None:
    """What page_blocks() gives, put together, of plain runs; else None."""
    runs = _plain_runs(document, page, own_resources, invisible)
    return None if runs is None else "\n".join(line for r in runs if (line := " ".join(r.text.split())))


def page_matches(document, page: dict, needle: str, ignore_case: bool = False) -> list[tuple[int, int, tuple, str]]:
    """search() over a page. A needle without white space lies within a line, so that of plain runs only the lines that have it are laid out."""
    runs = _plain_runs(document, page) if needle and not ignore_case and not any(c.isspace() for c in needle) else None
    if runs is None:
        return search(page_blocks(document, page), needle, ignore_case)
    out, offset = [], 0
    for r in runs:
        line = " ".join(r.text.split())
        if (at := line.find(needle)) >= 0:
            behind: list[int] = []  # the character of the run behind each one of the line
            for i, c in enumerate(r.text):
                if not c.isspace():
                    behind += [i] if not behind or behind[-1] == i - 1 else [-1, i]
            places = r.places()
            ends = [x + (after - x) for x, after in zip(places, places[1:], strict=False)]
            ends.append(places[-1] + r.last_width)
            while at >= 0:
                end = at + len(needle)
                boxes = [(places[i], r.y, ends[i], r.y + r.size) for i in behind[at:end]]
                out.append((offset + at, offset + end, union_box(boxes), needle))
                at = line.find(needle, end)
        offset += len(line) + 1 if line else 0
    return out


def search(blocks, needle: str, ignore_case: bool = False) -> list[tuple[int, int, tuple, str]]:
    """(start, end, box, text) of matches that don't overlap; those over separators only are passed over.

    Case is ignored character by character, as some change their length: a match covers all characters that it touches.
    """
    text, behind = assembled(blocks)
    fold = (lambda s: [c.lower() for c in s]) if ignore_case else list
    parts = fold(text)
    within, sought = "".join(parts), "".join(fold(needle))
    origin = range(len(text)) if len(within) == len(text) else [i for i, part in enumerate(parts) for _ in part]
    out, at = [], 0
    while sought and (at := within.find(sought, at)) >= 0:
        start, end = origin[at], origin[at + len(sought) - 1] + 1
        if found := [c for c in behind[start:end] if c is not None]:
            out.append((start, end, union_box(c.box for c in found), text[start:end]))
        at += len(sought)
    return out
