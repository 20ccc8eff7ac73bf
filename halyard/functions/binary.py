"""Image bytes: what a container is, and the same image without its metadata.

Sniffing is a column expression. Stripping edits bytes, which needs Python: one Arrow batch at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sniffed(data: Column) -> Column:
    """jpeg, png, gif, bmp, tiff, webp, avif, heic or unknown, by the first 12 bytes."""
    head = F.hex(F.substring(data, 1, 12))
    brand = F.substring(head, 17, 8)
    text = lambda s: s.encode().hex().upper()
    box = F.substring(head, 9, 8) == text("ftyp")
    return (
        F.when(data.isNull() | (F.octet_length(data) < 12), "unknown")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("89504E47"), "png")
        .when(head.startswith(text("GIF8")), "gif")
        .when(head.startswith(text("BM")), "bmp")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when(head.startswith(text("RIFF")) & (brand == text("WEBP")), "webp")
        .when(box & brand.isin(text("avif"), text("avis")), "avif")
        .when(box & brand.isin(*map(text, ("heic", "heix", "mif1", "hevc", "msf1"))), "heic")
        .otherwise("unknown")
    )


def can_strip(data: Column) -> Column:
    return sniffed(data).isin("jpeg", "png", "webp")


class Malformed(ValueError):
    """The bytes break off or a part overruns them."""


# Fixed values of the formats: parts that hold metadata.
JPEG_METADATA = (0xE1, 0xED, 0xEE, 0xFE)
PNG_METADATA = (b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME")
WEBP_METADATA = (b"EXIF", b"XMP ")
PNG_START = b"\x89PNG\r\n\x1a\n"


def jpeg_parts(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, bytes) of each segment; the scan is one part with all that follows it."""
    at = 2
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise Malformed
        while data[at + 1] == 0xFF and at + 2 < len(data):
            at += 1
        marker = data[at + 1]
        if marker == 0xDA:
            yield marker, data[at:]
            return
        if marker == 0xD9:
            yield marker, b"\xff\xd9"
            return
        if at + 4 > len(data):
            raise Malformed
        (size,) = struct.unpack_from(">H", data, at + 2)
        if size < 2 or at + 2 + size > len(data):
            raise Malformed
        yield marker, data[at : at + 2 + size]
        at += 2 + size


def png_parts(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(PNG_START)
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            raise Malformed
        yield kind, data[at : at + 12 + size]
        if kind == b"IEND":
            return
        at += 12 + size


def webp_parts(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 12
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        end = at + 8 + size + size % 2
        if end > len(data):
            raise Malformed
        yield kind, data[at:end]
        at = end


def strip_jpeg(data: bytes) -> bytes:
    return b"\xff\xd8" + b"".join(part for marker, part in jpeg_parts(data) if marker not in JPEG_METADATA)


def strip_png(data: bytes) -> bytes:
    if not data.startswith(PNG_START):
        raise Malformed
    return PNG_START + b"".join(part for kind, part in png_parts(data) if kind not in PNG_METADATA)


def strip_webp(data: bytes) -> bytes:
    if len(data) < 16:
        raise Malformed
    kept, changed = [], False
    for kind, part in webp_parts(data):
        if kind in WEBP_METADATA:
            changed = True
            continue
        if kind == b"VP8X" and len(part) > 8 and part[8] & 0x0C:  # it says which metadata follow
            part, changed = part[:8] + bytes([part[8] & 0xF3]) + part[9:], True
        kept.append(part)
    if not changed:
        return data
    body = b"WEBP" + b"".join(kept)
    return b"RIFF" + struct.pack("<I", len(body)) + body


STRIPPERS = {"jpeg": strip_jpeg, "png": strip_png, "webp": strip_webp}


def stripped_bytes(kind: str, data: bytes) -> bytes:
    """Malformed images come back as they are: nothing is ever damaged."""
    try:
        return STRIPPERS[kind](data)
    except (Malformed, struct.error, IndexError):
        return data


@F.pandas_udf(T.BinaryType())
def _strip(kind: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([stripped_bytes(k, bytes(d)) if k in STRIPPERS and d is not None else None for k, d in zip(kind, data, strict=True)], dtype="object")


def stripped(data: Column) -> Column:
    """(bytes, ext) without metadata; null where the container cannot be edited without loss."""
    kind = sniffed(data)
    ext = F.when(kind == "jpeg", "jpg").otherwise(kind)
    return F.when(kind.isin(*STRIPPERS), F.struct(_strip(kind, data).alias("bytes"), ext.alias("ext")))


def png_of(rows: list[bytes], width: int, channels: int) -> bytes:
    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, len(rows), 8, 6 if channels == 4 else 2, 0, 0, 0)
    return PNG_START + part(b"IHDR", head) + part(b"IDAT", zlib.compress(b"".join(b"\x00" + r for r in rows), 6)) + part(b"IEND", b"")


def turned_png(rgba: bytes, width: int, height: int, turns: int, flip_h: bool, flip_v: bool, rect: tuple[float, float, float, float]) -> bytes | None:
    """Raw RGBA turned clockwise by quarters, flipped, cropped to fractions (left, top, w, h), as PNG; without alpha if all is
    opaque. None if bytes are missing."""
    import numpy as np

    if len(rgba) < width * height * 4 or width <= 0 or height <= 0:
        return None
    image = np.frombuffer(rgba, np.uint8, width * height * 4).reshape(height, width, 4)
    if (image[:, :, 3] == 255).all():
        image = image[:, :, :3]
    image = np.rot90(image, -(turns % 4))
    if flip_h:
        image = image[:, ::-1]
    if flip_v:
        image = image[::-1]
    high, wide = image.shape[:2]
    half_up = lambda v: int(np.floor(abs(v) + 0.5) * (1 if v >= 0 else -1))
    x, y = min(max(half_up(rect[0] * wide), 0), wide - 1), min(max(half_up(rect[1] * high), 0), high - 1)
    w, h = min(max(half_up(rect[2] * wide), 1), wide - x), min(max(half_up(rect[3] * high), 1), high - y)
    image = np.ascontiguousarray(image[y : y + h, x : x + w])
    return png_of([row.tobytes() for row in image], w, image.shape[2])


@F.pandas_udf(T.BinaryType())
def transformed(rgba: pd.Series, width: pd.Series, height: pd.Series, turns: pd.Series, flip_h: pd.Series, flip_v: pd.Series, left: pd.Series, top: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    rows = zip(rgba, width, height, turns, flip_h, flip_v, left, top, w, h, strict=True)
    return pd.Series([None if d is None else turned_png(bytes(d), int(a), int(b), int(t), bool(fh), bool(fv), (x, y, cw, ch)) for d, a, b, t, fh, fv, x, y, cw, ch in rows], dtype="object")


@F.pandas_udf(T.BinaryType())
def png_pixels(png: pd.Series) -> pd.Series:
    """The pixel rows of PNGs as ``png_of`` writes them, one after another; null for rows that are filtered."""

    def pixels(data: bytes | None) -> bytes | None:
        if data is None:
            return None
        parts = list(png_parts(bytes(data)))
        wide, high, _, colour = struct.unpack_from(">IIBB", bytes(data), 16)
        raw, step = zlib.decompress(b"".join(part[8:-4] for kind, part in parts if kind == b"IDAT")), 1 + wide * (4 if colour == 6 else 3)
        rows = [raw[k * step : (k + 1) * step] for k in range(high)]
        return None if any(row[0] for row in rows) else b"".join(row[1:] for row in rows)

    return pd.Series([pixels(x) for x in png], dtype="object")


def png_has_alpha(data: bytes) -> bool:
    """Whether a PNG's colour type has alpha, or a transparent colour is named; True where that cannot be read."""
    try:
        (colour,) = struct.unpack_from(">B", data, 25)
        return colour in (4, 6) or any(kind == b"tRNS" for kind, _ in png_parts(data))
    except (Malformed, struct.error, IndexError):
        return True


def webp_has_alpha(data: bytes) -> bool:
    try:
        for kind, part in webp_parts(data):
            if kind == b"ALPH" or (kind == b"VP8X" and part[8] & 0x10) or (kind == b"VP8L" and part[12] & 0x10):
                return True
        return False
    except (Malformed, struct.error, IndexError):
        return True


def gif_has_alpha(data: bytes) -> bool:
    """Whether the first frame names a transparent colour; True where the blocks break off before a frame."""
    try:
        flags = data[10]
        at = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
        while data[at] == 0x21:  # extensions
            if data[at + 1] == 0xF9 and data[at + 3] & 1:
                return True
            at += 2
            while data[at]:
                at += 1 + data[at]
            at += 1
        return data[at] != 0x2C
    except IndexError:
        return True


def bmp_has_alpha(data: bytes) -> bool:
    """Only 32 bits a pixel have room for alpha."""
    try:
        return struct.unpack_from("<H", data, 28)[0] == 32
    except struct.error:
        return True


def tiff_has_alpha(data: bytes) -> bool:
    """Whether a pixel has a sample more than its colours, by the first directory; True where that cannot be read."""
    try:
        order = "<" if data[:2] == b"II" else ">"
        (at,) = struct.unpack_from(order + "I", data, 4)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, _ = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            (tags[tag],) = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, at + 10 + 12 * k)
        colours = {0: 1, 1: 1, 2: 3, 3: 1, 5: 4, 6: 3}.get(tags[262], 3)
        return tags.get(277, 1) > colours
    except (struct.error, KeyError):
        return True


ALPHA = {"png": png_has_alpha, "webp": webp_has_alpha, "gif": gif_has_alpha, "bmp": bmp_has_alpha, "tiff": tiff_has_alpha}


@F.pandas_udf(T.BooleanType())
def _alpha(kind: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([k in ALPHA and d is not None and ALPHA[k](bytes(d)) for k, d in zip(kind, data, strict=True)])


def has_alpha(data: Column) -> Column:
    """False for jpeg, heic, avif and unknown; for the rest read from the headers, True where they cannot be read."""
    kind = sniffed(data)
    return F.when(kind.isin(*ALPHA), _alpha(kind, data)).otherwise(F.lit(False))


def metadata_summary(tags: Column) -> Column:
    """Flags and number of a map of EXIF tags."""
    names = F.coalesce(F.map_keys(tags), F.array().cast("array<string>"))
    any_ = lambda test: F.exists(names, test)
    return F.struct(any_(lambda n: n.startswith("GPS")).alias("has_gps"), any_(lambda n: n.contains("DateTime")).alias("has_date"), any_(lambda n: n.isin("Image Make", "Image Model")).alias("has_camera"), F.size(names).alias("tags"))
