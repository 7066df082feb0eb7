"""Redaction: marks, and their removal of glyphs, paths, image pixels, recoverable text, then the save that checks.

Fails closed: a stream or font that can't be read on a page with marks is a Fault, not a page left as it was.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from sheaf.functions import fonts, images
from sheaf.operators import forms
from sheaf.operators.content import FORM_DEPTH, PAINT_OPERATORS, PATH_STEPS, TEXT_STATE, Generator, Interpreter, Level, State, apply, lexemes, operand_bytes, operation_bytes, times
from sheaf.sources.document import Document
from sheaf.sources.syntax import Fault, Name, Ref, Stream, text_of

class Region:
    """The boxes of a mark's quadrilaterals; their edges count."""

    def __init__(self, quads: list[list[float]]):
        self.boxes = [(min(q[::2]), min(q[1::2]), max(q[::2]), max(q[1::2])) for q in quads if len(q) >= 4]

    def holds(self, x: float, y: float) -> bool:
        return any(a <= x <= c and b <= y <= d for a, b, c, d in self.boxes)

    def near(self, box) -> Region:
        """The part of the region that touches a box."""
        out = Region([])
        out.boxes = [r for r in self.boxes if r[0] <= box[2] and box[0] <= r[2] and r[1] <= box[3] and box[1] <= r[3]]
        return out

    def touches(self, box) -> bool:
        return any(a <= box[2] and box[0] <= c and b <= box[3] and box[1] <= d for a, b, c, d in self.boxes)

    @property
    def bounds(self):
        return (min(b[0] for b in self.boxes), min(b[1] for b in self.boxes), max(b[2] for b in self.boxes), max(b[3] for b in self.boxes)) if self.boxes else (0.0,) * 4


def mark(document: Document, page: Ref, rect: list[float], fill=(0.0,), overlay: str | None = None, quads=None) -> Ref:
    """Only a mark; nothing is removed yet."""
    more = {"fill": fill} | ({"overlay": overlay} if overlay else {}) | ({"quads": quads} if quads else {})
    return forms.add_annotation(document, page, "redact", rect, **more)


def marks(document: Document, page: Ref) -> list[Ref]:
    return [r for r in forms.annotation_refs(document, page) if document.dictionary(r).get("Subtype") == "Redact"]


def region_of(document: Document, annotation: Ref) -> Region:
    """Of the quadrilaterals if there is a whole one, else of the rectangle."""
    entries = document.dictionary(annotation)
    points = [document.number(v) or 0.0 for v in document.array(entries.get("QuadPoints"))]
    if len(points) >= 8:
        return Region([points[i : i + 8] for i in range(0, len(points) - 7, 8)])
    rect = document.rectangle(entries.get("Rect"))
    return Region([rect] if rect else [])


class Excisor:
    """Writes a page's content anew without what lies in a region; forms that change are copied, so other pages keep theirs."""

    def __init__(self, document: Document, region: Region, crossing: bool = True):
        self.document, self.region, self.crossing = document, region, crossing
        self.removed: list[str] = []
        self.machine, self.level = Interpreter(document), Level()

    def page(self, page: Ref) -> None:
        d, entries = self.document, self.document.dictionary(page)
        body, resources, changed = self.run(d.content(entries, tolerant=False), d.attributes(entries)["resources"], State(), 0)
        if changed:
            d.update(page, Contents=d.add(Stream({}, body)), Resources=resources)

    def run(self, content: bytes, resources: dict, s: State, depth: int) -> tuple[bytes, dict, bool]:
        if depth >= FORM_DEPTH:
            raise Fault("limit", "forms nested too deep to redact")
        out, stack, changed = [], [], False
        path, held = [], []
        resources = dict(resources)
        m = self.machine
        for op, operands in lexemes(content, strict=True):
            if op in PATH_STEPS and op not in PAINT_OPERATORS:
                n = [float(v) if isinstance(v, (int, float)) else 0.0 for v in operands]
                path = PATH_STEPS[op](path, n, s.ctm)
                held.append((op, operands))
                continue
            if op in ("W", "W*"):
                held.append((op, operands))
                continue
            if op in PAINT_OPERATORS:
                clips = any(o in ("W", "W*") for o, _ in held)
                if op != "n" and not clips and self._hit(path):
                    changed = True
                else:
                    out += [operation_bytes(*h) for h in held] + [operation_bytes(op, operands)]
                path, held = [], []
                continue
            if op in ("Tj", "TJ", "'", '"'):
                body, cut = self._text(op, operands, s)
                out.append(body)
                changed |= cut
                continue
            if op == "q":
                stack.append(replace(s))
            elif op == "Q":
                s = stack.pop() if stack else s
            elif op == "BI":
                box = _unit_box(s.ctm)
                if self.region.touches(box):
                    changed = True
                    continue
            elif op == "Do" and operands and isinstance(operands[-1], Name):
                name = self._draw(operands[-1], resources, s, depth)
                if name != operands[-1]:
                    changed, operands = True, [Name(name)] if name else []
                    if not name:
                        continue
            else:
                self._state(op, operands, s, resources)
            out.append(operation_bytes(op, operands))
        out += [operation_bytes(*h) for h in held]
        return b"\n".join(out), resources, changed

    def _state(self, op, operands, s, resources):
        n = [float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else 0.0 for v in operands]
        if op in TEXT_STATE:
            TEXT_STATE[op](s, n, operands)
        elif op == "Tf" and len(operands) >= 2 and isinstance(operands[-2], Name):
            s.font_size, s.font = n[-1], self.machine.font(resources, operands[-2])

    def _hit(self, path: list) -> bool:
        """A vertex or control point inside; and unless told otherwise, an edge's box over the region."""
        points = [p for step in path for p in step[1:]]
        if any(self.region.holds(*p) for p in points):
            return True
        if not self.crossing or not points:
            return False
        lines = zip(points, points[1:], strict=False)
        return any(_crosses(a, b, box) for a, b in lines for box in self.region.boxes)

    def _text(self, op: str, operands: list, s: State) -> tuple[bytes, bool]:
        """Glyphs that begin or end inside go; the space that they took stays."""
        lead = []
        if op == '"' and len(operands) >= 3:
            s.word_gap, s.char_gap = float(operands[0]), float(operands[1])
            lead += [operation_bytes("Tw", [operands[0]]), operation_bytes("Tc", [operands[1]])]
        if op in "'\"":
            s.next_line(0, -s.leading)
            lead.append(b"T*")
        parts = operands[-1] if operands and isinstance(operands[-1], list) else operands[-1:]
        out: list = []
        cut = False
        for part in parts:
            if isinstance(part, (int, float)):
                s.tm = times((1.0, 0.0, 0.0, 1.0, -part / 1000 * s.font_size * s.scale, 0.0), s.tm)
                out.append(part)
                continue
            if not isinstance(part, bytes):
                continue
            if s.font is None:
                raise Fault("redaction", "text in a font that can't be read")
            if (run := self.level.run(s, part)) is not None:
                # No glyph ends further on than the widest would at the last one's place.
                end = run.x + (run.here + max(s.font.single[1]) * s.font_size * s.scale) * run.scale
                if not self.region.near((run.x, run.y, end, run.y)).boxes:
                    self.level.move(s, run)
                    out.append(part)
                    continue
            start = len(self.machine.items)
            self.machine.show(s, part)
            glyphs = self.machine.items[start].glyphs if len(self.machine.items) > start else []
            del self.machine.items[start:]
            at, kept = 0, bytearray()
            ends = [(g.x, g.y) for g in glyphs] + [(g.end_x, g.end_y) for g in glyphs]
            near = self.region.near((min(p[0] for p in ends), min(p[1] for p in ends), max(p[0] for p in ends), max(p[1] for p in ends))) if ends else self.region
            if not near.boxes:
                out.append(part)
                continue
            for g in glyphs:
                raw = part[at : at + g.size]
                at += g.size
                if near.holds(g.x, g.y) or near.holds(g.end_x, g.end_y):
                    cut = True
                    self.removed.append(g.text)
                    if kept:
                        out.append(bytes(kept))
                        kept = bytearray()
                    gap = g.advance * 1000 + ((s.char_gap + (s.word_gap if g.code == 32 and g.size == 1 else 0)) * 1000 / s.font_size if s.font_size else 0)
                    out.append(-gap)
                else:
                    kept += raw
            if kept:
                out.append(bytes(kept))
        if not cut:
            return operation_bytes(op, operands), False
        return b"\n".join([*lead, operand_bytes(out) + b" TJ"]), True

    def _draw(self, name: str, resources: dict, s: State, depth: int) -> str | None:
        """The name to draw instead: the same, one of a changed copy, or none."""
        d, target = self.document, self.machine.resource(resources, "XObject", name)
        if not isinstance(target, Stream):
            return name
        if target.entries.get("Subtype") == "Image":
            if not self.region.touches(_unit_box(s.ctm)):
                return name
            fresh = blank_pixels(d, target, s.ctm, self.region)
        elif target.entries.get("Subtype") == "Form":
            matrix = [d.number(v) for v in d.array(target.entries.get("Matrix"))]
            inner = replace(s)
            if len(matrix) == 6 and None not in matrix:
                inner.ctm = times(tuple(matrix), s.ctm)
            own = d.resolve(target.entries.get("Resources"))
            body, used, changed = self.run(d.decoded(target), own if isinstance(own, dict) else resources, inner, depth + 1)
            if not changed:
                return name
            entries = {k: v for k, v in target.entries.items() if k not in ("Filter", "DecodeParms", "Length")}
            fresh = Stream(entries | {"Resources": used}, body)
        else:
            return name
        new = f"Redacted{len(d.edits)}"
        resources["XObject"] = {**d.dictionary(resources.get("XObject")), new: d.add(fresh)}
        return new


def _unit_box(ctm):
    corners = [apply(ctm, x, y) for x in (0, 1) for y in (0, 1)]
    return min(c[0] for c in corners), min(c[1] for c in corners), max(c[0] for c in corners), max(c[1] for c in corners)


def _crosses(a, b, box) -> bool:
    """Whether a line meets a box: the part of it within both strips isn't empty."""
    low, high = 0.0, 1.0
    for i in (0, 1):
        d = b[i] - a[i]
        if d == 0:
            if not box[i] <= a[i] <= box[i + 2]:
                return False
            continue
        t = sorted(((box[i] - a[i]) / d, (box[i + 2] - a[i]) / d))
        low, high = max(low, t[0]), min(high, t[1])
    return low <= high


def blank_pixels(document: Document, image: Stream, ctm, region: Region) -> Stream:
    """The image with those pixels black whose centres lie in the region."""
    raster = images.decode(document, image)
    x, y = np.meshgrid((np.arange(raster.width) + 0.5) / raster.width, 1 - (np.arange(raster.height) + 0.5) / raster.height)
    px, py = ctm[0] * x + ctm[2] * y + ctm[4], ctm[1] * x + ctm[3] * y + ctm[5]
    inside = np.zeros(px.shape, bool)
    for a, b, c, d in region.boxes:
        inside |= (px >= a) & (px <= c) & (py >= b) & (py <= d)
    pixels = raster.pixels.copy()
    pixels[inside] = 0
    return images.rgb_stream(pixels)


def scrub(document: Document, removed: list[str]) -> None:
    """Clears alternative texts, metadata streams and information entries that hold any of the removed texts."""
    needles = [t for t in removed if len(t.strip()) > 2]
    holds = lambda text: any(n in text for n in needles)
    for number in document.numbers():
        value = document.get(number)
        entries = value.entries if isinstance(value, Stream) else value
        if not isinstance(entries, dict):
            continue
        drop = {k: None for k in ("ActualText", "Alt", "E") if isinstance(v := document.resolve(entries.get(k)), bytes) and holds(text_of(v))}
        if drop:
            document.update(Ref(number, 0), **drop)
        if isinstance(value, Stream) and entries.get("Type") == "Metadata":
            try:
                data = document.decoded(value)
            except Fault:
                data = b""
            if not data or holds(data.decode("utf-8", "replace")):
                document.set(Ref(number, 0), Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, b""))
    info = {k: None for k, v in forms.metadata(document).items() if holds(v)}
    if info:
        forms.set_metadata(document, **info)


def apply_page(document: Document, page: Ref, crossing: bool = True) -> list[str]:
    """Carries out a page's marks; the removed text, fragment by fragment."""
    found = marks(document, page)
    if not found:
        return []
    region = Region([])
    for ref in found:
        region.boxes += region_of(document, ref).boxes
    excisor = Excisor(document, region, crossing)
    excisor.page(page)
    fragments = ["".join(excisor.removed)] + "".join(excisor.removed).split()
    scrub(document, fragments)
    body, drawn = [], {}
    for ref in found:
        rect, form = _cover(document, ref)
        if form is not None:
            name = f"Mark{ref.number}"
            drawn[name] = form
            body.append(b"q 1 0 0 1 " + operand_bytes(rect[0]) + b" " + operand_bytes(rect[1]) + b" cm /" + name.encode() + b" Do Q")
    if body:
        forms.append_content(document, page, b"\n".join(body), drawn)
    gone = set(found)
    document.update(page, Annots=[r for r in forms.annotation_refs(document, page) if r not in gone])
    for ref in found:
        document.delete(ref)
    return excisor.removed


def _cover(document: Document, annotation: Ref):
    """The rectangle, and the mark's own form or one of its fill and overlay text; no form if there is nothing to draw."""
    entries = document.dictionary(annotation)
    rect = document.rectangle(entries.get("Rect"))
    if not rect:
        return None, None
    if isinstance(document.resolve(entries.get("RO")), Stream) and isinstance(entries["RO"], Ref):
        return rect, entries["RO"]
    g, resources = Generator(), {}
    fill = [document.number(v) or 0.0 for v in document.array(entries.get("IC"))]
    if fill:
        g.emit("set_fill_rgb", *forms.color_rgb(fill)).emit("rect", 0.0, 0.0, rect[2] - rect[0], rect[3] - rect[1]).emit("fill")
    overlay = document.resolve(entries.get("OverlayText"))
    if isinstance(overlay, bytes):
        resources = {"Font": {"Helv": fonts.helvetica()}}
        g.emit("begin_text").emit("set_font", Name("Helv"), 10).emit("set_fill_gray", 1.0 if fill else 0.0).emit("next_line", 2.0, 2.0).emit("show_text", text_of(overlay).encode("cp1252", "replace")).emit("end_text")
    return rect, forms.form_xobject(document, rect, g.bytes(), resources) if fill or isinstance(overlay, bytes) else None


def apply_all(document: Document, forbidden: list[bytes] = (), encryption=None, crossing: bool = True, flatten_dpi: float | None = None) -> bytes:
    """All pages, then the save that fails if any forbidden bytes are left.

    With flatten_dpi each page then becomes a picture of itself, made after the removal: nothing on it can be selected.
    """
    for page in document.page_refs():
        apply_page(document, page, crossing)
        if flatten_dpi is not None:
            from sheaf.operators import render

            render.flatten(document, page, flatten_dpi)
    return document.save_sanitized(list(forbidden), encryption)


def unshared(document: Document) -> set[int]:
    """Numbers of objects that nothing leads to."""
    return set(document.numbers()) - document.reachable()
