"""Pages to pixels, in numpy: filled and stroked paths, clips and sampled images; and pages replaced by their own picture.

Outlines of glyphs aren't read: a glyph that shows is drawn as a box of its width and half its height, so that lines and
words can be told but not read. Shadings and patterns aren't drawn; an image that can't be decoded is a grey box.
"""

from __future__ import annotations

import math

import numpy as np

from sheaf.functions import images
from sheaf.operators.content import Generator, Interpreter, apply, times
from sheaf.sources.document import Document
from sheaf.sources.syntax import Fault, Name, Ref, Stream

#: Lines of a pixel row that coverage is taken on, and straight parts of a curve.
FINE, PARTS = 4, 12
#: The name of a page's picture among its resources.
PICTURE = "Picture"


class Canvas:
    """RGBA pixels that shapes in user space are blended into; to_device leads from user space to pixels, rows from the top."""

    def __init__(self, width: int, height: int, to_device: tuple, background: tuple | None):
        if width * height > images.MAX_PIXELS:
            raise Fault("limit", "too many pixels")
        self.pixels = np.zeros((height, width, 4))
        if background is not None:
            self.pixels[...] = (*background, 1.0)
        self.to_device = to_device
        self.clips: dict[tuple, np.ndarray] = {}

    def fill(self, shapes: list, rule: str, rgb: tuple, clip: tuple = ()) -> None:
        """shapes: polygons in user space."""
        found = self._coverage([[apply(self.to_device, *p) for p in shape] for shape in shapes], rule)
        if found is not None:
            self._blend(*found, np.array(rgb), clip)

    def _blend(self, top: int, left: int, cover: np.ndarray, rgb: np.ndarray, clip: tuple) -> None:
        h, w = cover.shape
        part = self.pixels[top : top + h, left : left + w]
        if clip:
            cover = cover * self._clip(clip)[top : top + h, left : left + w]
        under = part[..., 3] * (1 - cover)
        alpha = cover + under
        part[..., :3] = np.where(alpha[..., None] > 0, (rgb * cover[..., None] + part[..., :3] * under[..., None]) / np.maximum(alpha, 1e-9)[..., None], 0)
        part[..., 3] = alpha

    def _clip(self, clip: tuple) -> np.ndarray:
        """The product of the coverages of all clips in force; the last one asked for is kept."""
        if clip not in self.clips:
            whole = np.ones(self.pixels.shape[:2])
            for path, rule in clip:
                mask = np.zeros_like(whole)
                found = self._coverage([[apply(self.to_device, *p) for p in shape] for shape in polygons(path)], rule)
                if found is not None:
                    top, left, cover = found
                    mask[top : top + cover.shape[0], left : left + cover.shape[1]] = cover
                whole *= mask
            self.clips = {clip: whole}
        return self.clips[clip]

    def _coverage(self, shapes: list, rule: str):
        """(first row, first column, share of each pixel that is inside) of polygons in pixels; None beyond the canvas."""
        shapes = [np.array(s, float) for s in shapes if len(s) > 1]
        if not shapes or not all(np.isfinite(s).all() for s in shapes):
            return None
        height, width = self.pixels.shape[:2]
        low, high = np.min([s.min(axis=0) for s in shapes], axis=0), np.max([s.max(axis=0) for s in shapes], axis=0)
        left, top = (max(0, math.floor(v)) for v in np.minimum(low, 1e9))
        right, bottom = min(width, math.ceil(min(high[0], 1e9))), min(height, math.ceil(min(high[1], 1e9)))
        if left >= right or top >= bottom:
            return None
        columns, rows = np.arange(left, right), np.arange(top, bottom)
        inside = lambda cells, a, b: np.clip(np.minimum(b, cells + 1) - np.maximum(a, cells), 0, 1)
        if len(shapes) == 1 and len(shapes[0]) == 4 and _upright(shapes[0]):
            return top, left, np.outer(inside(rows, low[1], high[1]), inside(columns, low[0], high[0]))
        begin, end = np.concatenate(shapes), np.concatenate([np.roll(s, -1, axis=0) for s in shapes])
        cover = np.zeros((len(rows), len(columns)))
        for i in range(len(rows) * FINE):
            y = top + (i + 0.5) / FINE
            crossing = (begin[:, 1] <= y) != (end[:, 1] <= y)
            if not crossing.any():
                continue
            a, b = begin[crossing], end[crossing]
            x = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
            order = np.argsort(x, kind="stable")
            x, turns = x[order], np.cumsum(np.where(b[:, 1] > a[:, 1], 1, -1)[order])
            within = turns % 2 != 0 if rule == "evenodd" else turns != 0
            for k in np.flatnonzero(within[:-1]).tolist():
                cover[i // FINE] += inside(columns, x[k], x[k + 1]) / FINE
        return top, left, np.minimum(cover, 1)

    def image(self, raster: images.Raster, ctm: tuple, rgb: tuple | None, clip: tuple) -> None:
        """A raster on the unit square of ctm, the nearest sample for each pixel; rgb: the colour of a stencil."""
        a, b, c, d, e, f = times(ctm, self.to_device)
        scale = a * d - b * c
        corners = np.array([apply((a, b, c, d, e, f), *p) for p in ((0, 0), (1, 0), (1, 1), (0, 1))])
        if abs(scale) < 1e-9 or not np.isfinite(corners).all():
            return
        height, width = self.pixels.shape[:2]
        left, top = (int(max(0, v)) for v in np.floor(np.clip(corners.min(axis=0) + 1e-6, 0, 1e9)))
        right, bottom = (int(min(m, v)) for m, v in zip((width, height), np.ceil(np.clip(corners.max(axis=0) - 1e-6, 0, 1e9)), strict=True))
        if left >= right or top >= bottom:
            return
        x, y = np.meshgrid(np.arange(left, right) + 0.5 - e, np.arange(top, bottom) + 0.5 - f)
        u, v = (d * x - c * y) / scale, (a * y - b * x) / scale
        there = (u >= 0) & (u < 1) & (v >= 0) & (v < 1)
        column = np.clip((u * raster.width).astype(int), 0, raster.width - 1)
        row = np.clip(((1 - v) * raster.height).astype(int), 0, raster.height - 1)
        shown = raster.pixels[row, column] / 255.0
        self._blend(top, left, shown[..., 3] * there, shown[..., :3] if rgb is None else np.array(rgb), clip)


def _upright(shape: np.ndarray) -> bool:
    """Whether four corners are those of a rectangle along the axes."""
    away = np.abs(np.roll(shape, -1, axis=0) - shape) > 1e-9
    return bool((away.sum(axis=1) <= 1).all() and (away[0] == away[2]).all() and (away[1] == away[3]).all())


def polygons(path) -> list[list[tuple]]:
    """The subpaths of a path's steps as corners, curves in straight parts."""
    out: list[list[tuple]] = []
    for kind, *points in path:
        if kind == "move":
            out.append([points[0]])
        elif kind == "line" and out:
            out[-1].append(points[0])
        elif kind == "curve" and out:
            p, q, r, s = out[-1][-1], *points
            for i in range(1, PARTS + 1):
                t = i / PARTS
                w = ((1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3)
                out[-1].append(tuple(sum(k * z[axis] for k, z in zip(w, (p, q, r, s), strict=True)) for axis in (0, 1)))
        elif kind == "close" and out and len(out[-1]) > 1:
            out.append([out[-1][0]])
    return [shape for shape in out if len(shape) > 1]


def stroked(path, width: float) -> list[list[tuple]]:
    """A rectangle for each straight part of a path, and an octagon where two of them meet, all with the same sense of turning."""
    out, half = [], width / 2
    closes = [i for i, step in enumerate(path) if step[0] == "close"]
    for shape in polygons(path):
        ring = shape + [shape[0]] if closes else shape
        for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
            long = math.hypot(x1 - x0, y1 - y0)
            if long > 0:
                dx, dy = (y0 - y1) / long * half, (x1 - x0) / long * half
                out.append([(x0 + dx, y0 + dy), (x1 + dx, y1 + dy), (x1 - dx, y1 - dy), (x0 - dx, y0 - dy)])
        joints = ring[:-1] if closes else ring[1:-1]
        out += [[(x + half * math.cos(k * math.pi / 4), y - half * math.sin(k * math.pi / 4)) for k in range(8)] for x, y in joints]
    return out


def render(document: Document, page: dict, scale: float = 1.0, box: str = "crop", background: tuple | None = (1.0, 1.0, 1.0), rotate: bool = True) -> images.Raster:
    """A page's crop or media box at scale pixels a unit (dpi / 72), turned as the page says. Without a background it is transparent."""
    a = document.attributes(page)
    x0, y0, x1, y1 = a[box]
    turn = a["rotate"] if rotate else 0
    width, height = images.render_size(x1 - x0, y1 - y0, turn, scale)
    w, h = (x1 - x0) * scale, (y1 - y0) * scale
    upright = (scale, 0.0, 0.0, -scale, -x0 * scale, y1 * scale)
    turned = {0: (1, 0, 0, 1, 0, 0), 90: (0, 1, -1, 0, h, 0), 180: (-1, 0, 0, -1, w, h), 270: (0, -1, 1, 0, 0, w)}[turn]
    canvas = Canvas(width, height, times(upright, turned), background)
    for item in Interpreter(document).page(page):
        _draw(document, canvas, item, scale)
    return images.Raster(width, height, np.round(np.clip(canvas.pixels, 0, 1) * 255).astype(np.uint8))


def _draw(document: Document, canvas: Canvas, item, scale: float) -> None:
    if item.kind == "path":
        if item.name:
            canvas.fill(polygons(item.path), item.name, item.color, item.clip)
        if item.stroke is not None:
            across = math.sqrt(abs(item.ctm[0] * item.ctm[3] - item.ctm[1] * item.ctm[2]))
            for shape in [stroked(item.path, max(item.line_width * across, 1 / scale))]:
                canvas.fill(shape, "nonzero", item.stroke, item.clip)
    elif item.kind == "text" and item.mode != 3:
        for g in item.glyphs:
            long = math.hypot(g.end_x - g.x, g.end_y - g.y)
            if g.text.strip() and g.advance > 0 and long > 0:
                dx, dy, em = (g.end_x - g.x) / long, (g.end_y - g.y) / long, long / g.advance
                at = lambda along, up, g=g, dx=dx, dy=dy: (g.x + dx * along - dy * up, g.y + dy * along + dx * up)
                canvas.fill([[at(0.1 * long, 0), at(0.9 * long, 0), at(0.9 * long, em / 2), at(0.1 * long, em / 2)]], "nonzero", item.color, item.clip)
    elif item.kind == "image" and isinstance(item.image, Stream):
        try:
            stencil = document.resolve(item.image.entries.get("ImageMask", item.image.entries.get("IM"))) is True
            canvas.image(images.decode(document, item.image), item.ctm, item.color if stencil else None, item.clip)
        except Fault:
            canvas.fill([[apply(item.ctm, *p) for p in ((0, 0), (1, 0), (1, 1), (0, 1))]], "nonzero", (0.5, 0.5, 0.5), item.clip)


def flatten(document: Document, page: Ref, dpi: float = 150.0) -> None:
    """A page's content replaced by one picture of its media box: no text, path, image, annotation or structure of it is left.

    The page's rotation stays an entry, as the picture is taken upright.
    """
    entries = document.dictionary(page)
    if not entries:
        return
    x0, y0, x1, y1 = document.attributes(entries)["media"]
    raster = render(document, entries, dpi / 72, "media", rotate=False)
    picture = document.add(images.rgb_stream(raster.pixels))
    body = Generator().emit("save_state").emit("concat", float(x1 - x0), 0.0, 0.0, float(y1 - y0), float(x0), float(y0)).emit("invoke_xobject", Name(PICTURE)).emit("restore_state")
    document.update(page, Contents=document.add(Stream({}, body.bytes())), Resources={"XObject": {PICTURE: picture}}, Annots=None, StructParents=None)
