"""Documents made from text: fixed pitch, fixed lines, so that what is read back is known beforehand."""

from __future__ import annotations

import re

from sheaf.functions import fonts
from sheaf.operators.content import Generator
from sheaf.sources.document import Document
from sheaf.sources.syntax import Name, Ref, Stream

WIDTH, LINES, SIZE, LEADING = 96, 52, 10.0, 14.0
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]+")


def wrapped(text: str, width: int = WIDTH) -> list[str]:
    """Words put into lines of at most width characters; a longer word has a line of its own."""
    lines: list[str] = []
    used = width + 1
    for word in _CONTROL.sub(" ", text).split():
        if used + 1 + len(word) <= width:
            lines[-1] += " " + word
            used += 1 + len(word)
        else:
            lines.append(word)
            used = len(word)
    return lines


def body_font() -> dict:
    """Half an em for each code from 32 to 255."""
    return fonts.helvetica() | {"FirstChar": 32, "LastChar": 255, "Widths": [500] * 224}


def page_of_lines(document: Document, lines: list[str], font: Ref, media: list[float] | None = None) -> Ref:
    g = Generator().emit("begin_text").emit("set_font", Name("F1"), SIZE).emit("set_leading", LEADING).emit("next_line", 36.0, 750.0)
    for line in lines:
        g.emit("show_text", line.encode("cp1252", "replace")).emit("next_line", 0.0, -LEADING)
    body = g.emit("end_text").bytes()
    entries = {"Type": Name("Page"), "Parent": document.catalog["Pages"], "Contents": document.add(Stream({}, body))}
    return document.add(entries | ({"MediaBox": media} if media else {}))


def document_of(text: str | None, title: str | None = None, compress: bool = False) -> Document:
    """Pages of LINES lines under one root that holds the font and the box for all; no words, one empty page."""
    from sheaf.functions import codecs
    from sheaf.operators import forms

    document, lines = Document(), wrapped(text or "")
    font = document.add(body_font())
    pages = [page_of_lines(document, lines[i : i + LINES], font) for i in range(0, max(len(lines), 1), LINES)]
    document.update(document.catalog["Pages"], Kids=pages, Count=len(pages), MediaBox=[0, 0, 612, 792], Resources={"Font": {"F1": font}})
    if compress:
        for page in pages:
            ref = document.dictionary(page)["Contents"]
            document.set(ref, Stream({"Filter": Name("FlateDecode")}, codecs.flate_encode(document.get(ref.number).raw)))
    if title is not None:
        forms.set_metadata(document, Title=title)
    return document


def expected_text(text: str | None) -> list[str]:
    """What each page reads back as."""
    lines = wrapped(text or "")
    return ["\n".join(lines[i : i + LINES]) for i in range(0, max(len(lines), 1), LINES)]
