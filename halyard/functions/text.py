"""Text columns: names, families, labels."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(name: Column) -> Column:
    """What follows the last point; empty without one or at its end."""
    return F.coalesce(F.regexp_extract(name, r"(?s)\.([^.]+)\z", 1), F.lit(""))


def family(mime: Column, name: Column) -> Column:
    """jpeg, png, heif, avif, webp or other, by the MIME type and the extension, the first rule that fits."""
    m, n = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    ends = lambda *names: reduce(or_, (n.endswith("." + x) for x in names))  # noqa: E731  as extension() says, without a pattern
    out = F.when(m.contains("jpeg") | m.contains("jpg") | ends("jpeg", "jpg"), "jpeg")
    out = out.when(m.contains("png") | ends("png", "jpng"), "png")
    out = out.when(m.contains("hei") | ends("heic", "heif"), "heif")
    return out.when(m.contains("avif") | ends("avif"), "avif").when(m.contains("webp") | ends("webp"), "webp").otherwise("other")


def output_name(title: Column, ext: Column, suffix: Column, now_ms: Column) -> Column:
    """A file name for a result: the title's base, a suffix if any, a new extension; a stamped name for an empty base."""
    base = F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"(?s)^.*/", "")
    base = F.regexp_replace(base, r"(?s)^(.+)\.[^.]*\z", "$1")
    base = F.when(base == "", F.concat(F.lit("IMG_"), now_ms.cast("string"))).otherwise(base)
    return F.concat(base, F.when(suffix == "", F.lit("")).otherwise(F.concat(F.lit("_"), suffix)), F.lit("."), ext)


def copy_name(title: Column, kind: Column, now_ms: Column) -> Column:
    own = extension(title)
    return output_name(title, F.when(own != "", own).when(kind == 2, "mp4").otherwise("jpg"), F.lit("copy"), now_ms)


def format_label(name: Column) -> Column:
    return F.nullif(F.upper(extension(name)), F.lit(""))


def mime_label(mime: Column) -> Column:
    """HEIC, AVIF, WebP, PNG, JPEG where the type says so, else what follows its slash in capitals, else null."""
    m = F.lower(mime)
    out = F.when(m.isNull() | (m == ""), F.lit(None))
    for word, label in (("hei", "HEIC"), ("avif", "AVIF"), ("webp", "WebP"), ("png", "PNG"), ("jpeg", "JPEG"), ("jpg", "JPEG")):
        out = out.when(m.contains(word), F.lit(label))
    return out.when(m.contains("/"), F.upper(F.regexp_extract(m, r"(?s)\A[^/]*/(.*)\z", 1)))


def _fixed(x: Column, digits: int) -> Column:
    """A number with some decimals; null stays null, of which a format would make text."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x.cast("double")))


def bytes_text(size: Column, mb_digits: int = 1) -> Column:
    """1 B, 1.0 KB, 1.0 MB (or two digits), 1.00 GB."""
    s = size.cast("double")
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, F.concat(_fixed(s / 1024, 1), F.lit(" KB"))).when(size < 1 << 30, F.concat(_fixed(s / (1 << 20), mb_digits), F.lit(" MB"))).otherwise(F.concat(_fixed(s / (1 << 30), 2), F.lit(" GB")))


def bytes_badge(size: Column) -> Column:
    """The short form of a thumbnail: 1B, 1KB, 1.5MB below ten, 12MB, 1.0GB."""
    s = size.cast("double")
    mb = s / (1 << 20)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit("B"))).when(size < 1 << 20, F.concat(F.round(s / 1024).cast("long").cast("string"), F.lit("KB"))).when(size < 1 << 30, F.concat(F.when(mb < 10, _fixed(mb, 1)).otherwise(F.round(mb).cast("long").cast("string")), F.lit("MB"))).otherwise(F.concat(_fixed(s / (1 << 30), 1), F.lit("GB")))


def trimmed_decimal(x: Column) -> Column:
    return F.regexp_replace(_fixed(x, 1), r"\.0$", "")


def camera_line(make: Column, model: Column) -> Column:
    return F.nullif(F.concat_ws(" ", F.nullif(F.trim(make), F.lit("")), F.nullif(F.trim(model), F.lit(""))), F.lit(""))


def exposure_line(aperture: Column, shutter: Column, focal: Column, separator: str = " · ") -> Column:
    parts = F.filter(F.array(aperture, shutter, focal), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(parts) > 0, F.array_join(parts, separator))


def format_name(target: Column, has_heic: Column, has_heif: Column) -> Column:
    """The name shown for a target; HEIC is called HEIF where only that can be written."""
    heic = F.when(~has_heic & has_heif, "HEIF").otherwise("HEIC")
    return F.when(target == "heic", heic).when(target == "webp", "WebP").when(target == "auto", "Auto").otherwise(F.upper(target))


def target_extension(target: Column) -> Column:
    return F.when(target.isin("avif", "heic", "webp", "png"), target).otherwise("jpg")


def badge_count(n: Column) -> Column:
    return F.when(n > 99, "99+").otherwise(n.cast("string"))


def route_id(id_: Column) -> Column:
    """An id as one part of a path."""
    return F.replace(F.url_encode(id_), F.lit("+"), F.lit("%20"))


def encode_ids(ids: Column) -> Column:
    return F.coalesce(F.to_json(ids), F.lit("[]"))


def decode_ids(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def fourcc_label(code: Column) -> Column:
    """A codec's common name; unknown codes as they are."""
    raw = F.trim(code)
    c = F.lower(raw)
    out = F.when(c.isin("hvc1", "hev1"), "HEVC (H.265)").when(c.isin("avc1", "avc3"), "H.264").when(c == "av01", "AV1")
    return out.when(c == "vp09", "VP9").when(c == "mp4v", "MPEG-4").when(c == "jpeg", "Motion JPEG").otherwise(raw)
