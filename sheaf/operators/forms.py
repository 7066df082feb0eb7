"""Annotations and form fields of a document."""

from __future__ import annotations

import re
from dataclasses import dataclass

from sheaf.functions import fonts
from sheaf.operators.content import Generator
from sheaf.sources.document import TREE_DEPTH, Document
from sheaf.sources.syntax import Fault, Name, Reader, Ref, Stream, Token, string_of, text_of

# An ellipse's control points; annotation flags (bit n is 1 << (n - 1)); field flags.
KAPPA = 0.5522847498
ANNOTATION_FLAGS = {"invisible": 1, "hidden": 2, "print": 3, "no_zoom": 4, "no_rotate": 5, "no_view": 6, "read_only": 7, "locked": 8}
FIELD_FLAGS = {"read_only": 1, "required": 2, "no_export": 3, "multiline": 13, "password": 14, "radio": 16, "pushbutton": 17, "combo": 18}
MARKUP = {"highlight": "Highlight", "underline": "Underline", "squiggly": "Squiggly", "strikeout": "StrikeOut"}
SUBTYPES = {"text": "Text", "link": "Link", **MARKUP, "square": "Square", "circle": "Circle", "line": "Line", "ink": "Ink", "free_text": "FreeText", "stamp": "Stamp", "redact": "Redact"}


def flag_value(names, table: dict) -> int:
    return sum(1 << (table[n] - 1) for n in set(names))


def color_rgb(c: list[float]) -> tuple:
    """An annotation's colour of one, three or four numbers."""
    if len(c) == 1:
        return (c[0],) * 3
    if len(c) == 4:
        return tuple((1 - v) * (1 - c[3]) for v in c[:3])
    return tuple(c[:3])


# -- default appearance -------------------------------------------------------------------------------


@dataclass
class Appearance:
    """A font's name, its size (12 for 0) and colour, from the operators Tf, g and rg."""

    font: str = "Helv"
    size: float = 12.0
    color: tuple = (0.0, 0.0, 0.0)

    @classmethod
    def parse(cls, data: bytes) -> Appearance:
        out, held, reader = cls(), [], Reader(data, content=True)
        while not reader.done():
            try:
                value = reader.value()
            except Fault:
                break
            if not isinstance(value, Token):
                held.append(value)
                continue
            n = [float(v) for v in held if isinstance(v, (int, float)) and not isinstance(v, bool)]
            if value.word == b"Tf" and len(held) >= 2 and isinstance(held[-2], Name):
                out.font, out.size = str(held[-2]), (n[-1] if n else 0.0) or 12.0
            elif value.word == b"g" and n:
                out.color = (n[-1],) * 3
            elif value.word == b"rg" and len(n) >= 3:
                out.color = tuple(n[-3:])
            held = []
        return out


# -- annotations --------------------------------------------------------------------------------------


def annotation_refs(document: Document, page: Ref) -> list[Ref]:
    return [r for r in document.array(document.dictionary(page).get("Annots")) if isinstance(r, Ref)]


def add_annotation(document: Document, page: Ref, kind: str, rect: list[float], color: list[float] | None = None, contents: str | None = None, flags=("print",), border: float = 1.0, **more) -> Ref:
    """A dictionary, and a drawn appearance for markup, square, circle, line, ink and free text.

    more: quads (lists of 8), points (line: 4 numbers), strokes (ink: lists), uri (link), name (stamp, text), fill, overlay (redact).
    """
    entries = {"Type": Name("Annot"), "Subtype": Name(SUBTYPES[kind]), "Rect": [float(v) for v in rect], "F": flag_value(flags, ANNOTATION_FLAGS), "P": page}
    if contents is not None:
        entries["Contents"] = string_of(contents)
    if color is not None:
        entries["C"] = [float(v) for v in color]
    quads = more.get("quads") or ([_quad(rect)] if kind in MARKUP or kind == "redact" else None)
    if quads:
        entries["QuadPoints"] = [float(v) for q in quads for v in q]
    if kind == "line":
        entries["L"] = [float(v) for v in more.get("points", rect)]
    if kind == "ink":
        entries["InkList"] = [[float(v) for v in s] for s in more.get("strokes", [])]
    if kind == "link" and "uri" in more:
        entries["A"] = {"S": Name("URI"), "URI": more["uri"].encode("latin-1", "replace")}
    if kind in ("stamp", "text") and "name" in more:
        entries["Name"] = Name(more["name"])
    if kind == "free_text":
        entries["DA"] = b"/Helv 12 Tf 0 g"
    if kind == "redact":
        if "fill" in more:
            entries["IC"] = [float(v) for v in more["fill"]]
        if "overlay" in more:
            entries["OverlayText"] = string_of(more["overlay"])
    if (body := _draw(kind, rect, color_rgb(color or [0.0]), border, contents or "", quads or [], entries)) is not None:
        resources = {"Font": {"Helv": fonts.helvetica()}} if kind == "free_text" else {}
        entries["AP"] = {"N": form_xobject(document, rect, body, resources)}
    ref = document.add(entries)
    document.update(page, Annots=[*document.array(document.dictionary(page).get("Annots")), ref])
    return ref


def _quad(r) -> list[float]:
    return [r[0], r[3], r[2], r[3], r[0], r[1], r[2], r[1]]


def form_xobject(document: Document, rect, body: bytes, resources: dict) -> Ref:
    w, h = abs(rect[2] - rect[0]), abs(rect[3] - rect[1])
    return document.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0.0, 0.0, float(w), float(h)], "Resources": resources}, body))


def _draw(kind, rect, rgb, border, contents, quads, entries) -> bytes | None:
    """In the annotation's own corner as origin."""
    g, x0, y0, w, h = Generator(), rect[0], rect[1], rect[2] - rect[0], rect[3] - rect[1]
    at = lambda x, y: (float(x - x0), float(y - y0))
    if kind == "highlight":
        g.emit("set_fill_rgb", *rgb)
        for q in quads:
            xs, ys = q[::2], q[1::2]
            g.emit("rect", *at(min(xs), min(ys)), float(max(xs) - min(xs)), float(max(ys) - min(ys))).emit("fill")
    elif kind in MARKUP:
        g.emit("set_stroke_rgb", *rgb).emit("set_line_width", float(border))
        for q in quads:
            xs, ys = q[::2], q[1::2]
            y = (min(ys) + max(ys)) / 2 if kind == "strikeout" else min(ys) + border
            g.emit("move_to", *at(min(xs), y)).emit("line_to", *at(max(xs), y)).emit("stroke")
    elif kind == "square":
        g.emit("set_stroke_rgb", *rgb).emit("set_line_width", float(border)).emit("rect", border / 2, border / 2, float(w - border), float(h - border)).emit("stroke")
    elif kind == "circle":
        g.emit("set_stroke_rgb", *rgb).emit("set_line_width", float(border))
        ellipse(g, w / 2, h / 2, (w - border) / 2, (h - border) / 2)
        g.emit("stroke")
    elif kind in ("line", "ink"):
        g.emit("set_stroke_rgb", *rgb).emit("set_line_width", float(border))
        for stroke in [entries["L"]] if kind == "line" else entries["InkList"]:
            for i, p in enumerate(zip(stroke[::2], stroke[1::2], strict=False)):
                g.emit("line_to" if i else "move_to", *at(*p))
            g.emit("stroke")
    elif kind == "free_text":
        g.emit("begin_text").emit("set_font", Name("Helv"), 12).emit("set_fill_rgb", *rgb).emit("next_line", 2.0, float(h - 14)).emit("show_text", contents.encode("cp1252", "replace")).emit("end_text")
    else:
        return None
    return g.bytes()


def ellipse(g: Generator, cx: float, cy: float, rx: float, ry: float) -> None:
    k, j = rx * KAPPA, ry * KAPPA
    g.emit("move_to", cx + rx, cy)
    g.emit("curve_to", cx + rx, cy + j, cx + k, cy + ry, cx, cy + ry)
    g.emit("curve_to", cx - k, cy + ry, cx - rx, cy + j, cx - rx, cy)
    g.emit("curve_to", cx - rx, cy - j, cx - k, cy - ry, cx, cy - ry)
    g.emit("curve_to", cx + k, cy - ry, cx + rx, cy - j, cx + rx, cy).emit("close_path")


def remove_annotation(document: Document, page: Ref, annotation: Ref) -> None:
    document.update(page, Annots=[r for r in document.array(document.dictionary(page).get("Annots")) if r != annotation])
    document.delete(annotation)


# -- fields -------------------------------------------------------------------------------------------


@dataclass
class Field:
    """A terminal field: dotted name, type (Tx, Btn, Ch, Sig), flags and value, the last three inherited."""

    ref: Ref
    name: str
    kind: str | None
    flags: int
    value: str | list | None
    widgets: list[Ref]


def fields(document: Document) -> list[Field]:
    """Terminal ones in order: a node whose kids have names of their own is not terminal."""
    out: list[Field] = []

    def walk(ref: Ref, path: list[str], depth: int, seen: frozenset):
        node = document.dictionary(ref)
        if depth > TREE_DEPTH or ref.number in seen or not node:
            return
        own = document.resolve(node.get("T"))
        path = [*path, text_of(own)] if isinstance(own, bytes) else path
        kids = [k for k in document.array(node.get("Kids")) if isinstance(k, Ref)]
        below = [k for k in kids if "T" in document.dictionary(k)]
        if below:
            for kid in below:
                walk(kid, path, depth + 1, seen | {ref.number})
            return
        flags = document.resolve(document.inherited(node, "Ff"))
        widgets = [ref] if node.get("Subtype") == "Widget" else kids or [ref]
        kind = document.inherited(node, "FT")
        out.append(Field(ref, ".".join(path), str(kind) if isinstance(kind, Name) else None, flags if type(flags) is int else 0, _plain(document, document.inherited(node, "V")), widgets))

    for ref in document.array(document.dictionary(document.catalog.get("AcroForm")).get("Fields")):
        if isinstance(ref, Ref):
            walk(ref, [], 0, frozenset())
    return out


def _plain(document: Document, value):
    value = document.resolve(value)
    if isinstance(value, bytes):
        return text_of(value)
    if isinstance(value, list):
        return [_plain(document, v) for v in value]
    return str(value) if isinstance(value, Name) else None


def field_named(document: Document, name: str) -> Field | None:
    return next((f for f in fields(document) if f.name == name), None)


def add_field(document: Document, page: Ref, name: str, rect: list[float], kind: str = "Tx", value: str = "", states: tuple = ()) -> Ref:
    """A field and its widget in one; a button of states has an appearance for each and one for Off."""
    entries = {"Type": Name("Annot"), "Subtype": Name("Widget"), "FT": Name(kind), "T": string_of(name), "Rect": [float(v) for v in rect], "P": page, "DA": b"/Helv 12 Tf 0 g"}
    if kind == "Btn":
        entries |= {"AP": {"N": {s: form_xobject(document, rect, b"", {}) for s in (*states, "Off")}}, "AS": Name("Off"), "V": Name("Off")}
    else:
        entries["V"] = string_of(value)
    ref = document.add(entries)
    document.update(page, Annots=[*document.array(document.dictionary(page).get("Annots")), ref])
    form = document.catalog.get("AcroForm")
    if not isinstance(form, Ref):
        form = document.add(dict(document.dictionary(form)))
        document.update(document.trailer["Root"], AcroForm=form)
    document.update(form, Fields=[*document.array(document.dictionary(form).get("Fields")), ref])
    if kind != "Btn":
        regenerate(document, ref, ref)
    return ref


def set_value(document: Document, field: Field, value: str | list[str], draw: bool = True) -> None:
    """Text and choices as strings; a button's state as a name, shown by the widgets that have it."""
    if field.kind == "Btn":
        document.update(field.ref, V=Name(value))
        for widget in field.widgets:
            states = document.dictionary(document.dictionary(document.dictionary(widget).get("AP")).get("N"))
            document.update(widget, AS=Name(value) if value in states else Name("Off"))
        return
    many = [value] if isinstance(value, str) else value
    document.update(field.ref, V=string_of(many[0]) if len(many) == 1 else [string_of(v) for v in many])
    if draw:
        for widget in field.widgets:
            regenerate(document, field.ref, widget)


def regenerate(document: Document, field: Ref, widget: Ref) -> None:
    """Draws the value of a text or choice field into its widget's appearance."""
    node = document.dictionary(field)
    value = _plain(document, document.inherited(node, "V"))
    shown = ", ".join(v for v in value if v) if isinstance(value, list) else value or ""
    default = document.inherited(document.dictionary(widget), "DA") or document.resolve(document.dictionary(document.catalog.get("AcroForm")).get("DA"))
    look = Appearance.parse(default if isinstance(default, bytes) else b"")
    rect = document.rectangle(document.dictionary(widget).get("Rect")) or [0.0, 0.0, 0.0, 0.0]
    g = Generator().emit("begin_marked_content", Name("Tx")).emit("save_state").emit("begin_text").emit("set_font", Name(look.font), look.size).emit("set_fill_rgb", *look.color)
    g.emit("next_line", 2.0, max(2.0, (rect[3] - rect[1] - look.size) / 2 + 2)).emit("show_text", shown.encode("cp1252", "replace")).emit("end_text").emit("restore_state").emit("end_marked_content")
    font = fonts.helvetica() | {"FirstChar": 32, "Widths": [500] * 224}
    document.update(widget, AP={"N": form_xobject(document, rect, g.bytes(), {"Font": {look.font: font}})})


def need_appearances(document: Document, value: bool = True) -> None:
    form = document.catalog.get("AcroForm")
    if isinstance(form, Ref):
        document.update(form, NeedAppearances=value)


def append_content(document: Document, page: Ref, body: bytes, xobjects: dict[str, Ref]) -> None:
    """A stream after the page's own, and names for what it draws."""
    entries = document.dictionary(page)
    old = document.resolve(entries.get("Contents"))
    parts = list(old) if isinstance(old, list) else [entries["Contents"]] if isinstance(old, Stream) else []
    resources = dict(document.attributes(entries)["resources"])
    resources["XObject"] = {**document.dictionary(resources.get("XObject")), **xobjects}
    opened, closed = document.add(Stream({}, b"q")), document.add(Stream({}, b"Q\n" + body))
    document.update(page, Contents=[opened, *parts, closed], Resources=resources)


def page_of_widget(document: Document, widget: Ref) -> Ref | None:
    """As it says itself, else the page that lists it."""
    named = document.dictionary(widget).get("P")
    leaves = document.page_refs()
    if named in leaves:
        return named
    return next((p for p in leaves if widget in annotation_refs(document, p)), None)


def flatten(document: Document, only: str | None = None) -> None:
    """Draws fields into their pages and drops them, nested ones too; all without a name given."""
    for field in fields(document):
        if only is not None and field.name != only:
            continue
        for widget in field.widgets:
            page, entries = page_of_widget(document, widget), document.dictionary(widget)
            normal = document.dictionary(entries.get("AP")).get("N")
            if isinstance(document.resolve(normal), dict):
                normal = document.dictionary(normal).get(str(document.resolve(entries.get("AS"))))
            rect = document.rectangle(entries.get("Rect"))
            if page and rect and isinstance(document.resolve(normal), Stream) and isinstance(normal, Ref):
                name = f"Flat{widget.number}"
                append_content(document, page, f"q 1 0 0 1 {_plain_number(rect[0])} {_plain_number(rect[1])} cm /{name} Do Q".encode(), {name: normal})
            if page:
                remove_annotation(document, page, widget)
        _drop_field(document, field.ref)


def _plain_number(v: float) -> str:
    return re.sub(r"\.?0+$", "", f"{v:.6f}")


def _drop_field(document: Document, ref: Ref) -> None:
    parent = document.dictionary(ref).get("Parent")
    if isinstance(parent, Ref) and ref in document.array(document.dictionary(parent).get("Kids")):
        rest = [k for k in document.array(document.dictionary(parent)["Kids"]) if k != ref]
        document.update(parent, Kids=rest)
        if not rest:
            _drop_field(document, parent)
    form = document.catalog.get("AcroForm")
    rest = [r for r in document.array(document.dictionary(form).get("Fields")) if r != ref]
    if isinstance(form, Ref):
        document.update(form, Fields=rest)
    else:
        document.update(document.trailer["Root"], AcroForm={**document.dictionary(form), "Fields": rest})
    document.delete(ref)


# -- metadata -----------------------------------------------------------------------------------------

INFO_KEYS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")


def metadata(document: Document) -> dict[str, str]:
    info = document.dictionary(document.trailer.get("Info"))
    return {k: text_of(v) for k in INFO_KEYS if isinstance(v := document.resolve(info.get(k)), bytes)}


def set_metadata(document: Document, **values: str | None) -> None:
    if not isinstance(document.trailer.get("Info"), Ref):
        document.trailer["Info"] = document.add({})
    document.update(document.trailer["Info"], **{k: None if v is None else string_of(v) for k, v in values.items()})
