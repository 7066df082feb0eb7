"""Sampled images to RGBA, row by row from the top."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sheaf.functions import codecs, colour, jpeg
from sheaf.functions.numeric import unpack_bits
from sheaf.sources.syntax import Fault, Name, Stream

#: The largest image that is decoded.
MAX_PIXELS = 1 << 26
# Short keys of inline images.
SHORT_KEYS = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "IM": "ImageMask", "F": "Filter", "DP": "DecodeParms", "I": "Interpolate"}
_BY_COMPONENTS = {1: Name("DeviceGray"), 3: Name("DeviceRGB"), 4: Name("DeviceCMYK")}


@dataclass
class Raster:
    width: int
    height: int
    pixels: np.ndarray  # (height, width, 4), uint8

    def tobytes(self) -> bytes:
        return self.pixels.tobytes()


def samples(data: bytes, width: int, height: int, components: int, bits: int) -> np.ndarray:
    """(height, width, components): rows begin at a byte, and what lies beyond the data is zero."""
    row = (width * components * bits + 7) // 8
    data = data[: row * height].ljust(row * height, b"\0")
    if bits == 8:
        return np.frombuffer(data, np.uint8).reshape(height, row)[:, : width * components].reshape(height, width, components).astype(np.float64)
    rows = [unpack_bits(data[i * row : (i + 1) * row], bits, width * components) for i in range(height)]
    return np.stack(rows).reshape(height, width, components)


def decode(document, stream: Stream) -> Raster:
    """8 bits a channel, cut off not rounded. A DCT image has its own size. Faults for codecs that nothing here reads."""
    e = {SHORT_KEYS.get(k, k): v for k, v in stream.entries.items()}
    width, height = (int(document.number(e.get(k)) or 0) for k in ("Width", "Height"))
    if width < 1 or height < 1 or width * height > MAX_PIXELS:
        raise Fault("image", "no size")
    data, codec = codecs.decode(stream.raw, document.chain(e))
    shown = None
    if codec == "DCTDecode":
        shown = jpeg.decode(data, MAX_PIXELS)
        height, width = shown.shape[:2]
    elif codec:
        raise Fault("unsupportedFeature", codec)
    mapping = [document.number(v) or 0.0 for v in document.array(e.get("Decode"))]
    out = np.full((height, width, 4), 255, np.uint8)
    if document.resolve(e.get("ImageMask")) is True and shown is None:
        bit = samples(data, width, height, 1, 1)[..., 0]
        out[..., :3] = 0
        out[..., 3] = np.where(bit == (1 if mapping[:1] == [1.0] else 0), 255, 0)
        return Raster(width, height, out)
    space = colour.space_of(document, e.get("ColorSpace") if shown is None or "ColorSpace" in e else _BY_COMPONENTS[shown.shape[2]])
    bits = int(document.number(e.get("BitsPerComponent")) or 8) if shown is None else 8
    if bits not in (1, 2, 4, 8, 16):
        raise Fault("image", f"{bits} bits a component")
    n = max(space.n, 1)
    if shown is not None and shown.shape[2] != n:
        raise Fault("image", f"{shown.shape[2]} components for a space of {n}")
    raw = samples(data, width, height, n, bits) if shown is None else shown.astype(np.float64)
    top = 2.0**bits - 1
    if len(mapping) < 2 * n:
        mapping = [0.0, top] if space.family == "Indexed" else [0.0, 1.0] * n if space.family != "Lab" else [0.0, 100.0, -100.0, 100.0, -100.0, 100.0]
    low, high = np.array(mapping[0 : 2 * n : 2]), np.array(mapping[1 : 2 * n : 2])
    values = low + raw * (high - low) / top
    flat = values.reshape(-1, n)
    if space.family == "DeviceGray":
        rgb = np.repeat(flat, 3, axis=1)
    elif space.family == "DeviceRGB":
        rgb = flat
    elif space.family == "DeviceCMYK":
        rgb = (1 - flat[:, :3]) * (1 - flat[:, 3:])
    else:  # each distinct colour once
        distinct, place = np.unique(flat, axis=0, return_inverse=True)
        rgb = np.array([space.rgb(v) for v in distinct.tolist()])[place.ravel()]
    out[..., :3] = (np.clip(rgb, 0, 1) * 255).astype(np.uint8).reshape(height, width, 3)
    mask = document.resolve(e.get("Mask"))
    if isinstance(mask, list) and len(mask) >= 2 * n:
        limits = np.array([document.number(v) or 0.0 for v in mask[: 2 * n]]).reshape(n, 2)
        out[..., 3] = np.where(((raw >= limits[:, 0]) & (raw <= limits[:, 1])).all(axis=-1), 0, 255)
    soft = document.resolve(e.get("SMask"))
    if isinstance(soft, Stream):
        try:
            alpha = decode(document, soft)
            rows, columns = np.arange(height) * alpha.height // height, np.arange(width) * alpha.width // width
            out[..., 3] = alpha.pixels[rows][:, columns, 0]
        except Fault:
            pass
    return Raster(width, height, out)


def rgb_stream(pixels: np.ndarray) -> Stream:
    """(height, width, 3 or more) as an image object of 8 bits, deflated."""
    height, width = pixels.shape[:2]
    raw = codecs.flate_encode(np.ascontiguousarray(pixels[..., :3]).tobytes())
    return Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8, "Filter": Name("FlateDecode")}, raw)


def render_size(width: float, height: float, rotate: int, scale: float) -> tuple[int, int]:
    """Pixels of a rendered page; sides change places at 90 and 270 degrees."""
    w, h = (height, width) if rotate in (90, 270) else (width, height)
    return max(1, round(w * scale)), max(1, round(h * scale))
