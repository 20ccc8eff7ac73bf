from __future__ import annotations

import struct
import zlib

from pyspark.sql import functions as F

from halyard.functions import binary as B
from halyard.functions import numbers as N
from halyard.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text(spark):
    v = lambda c: value(spark, c)
    assert v(X.extension(F.lit("a.b.JPG"))) == "JPG" and v(X.extension(F.lit("a."))) == "" and v(X.extension(F.lit("a"))) == ""
    assert v(X.family(F.lit(None), F.lit("x.jpng"))) == "png" and v(X.family(F.lit("image/HEIF"), F.lit(None))) == "heif"
    assert v(X.output_name(F.lit(" d/IMG.1.heic "), F.lit("avif"), F.lit("clean"), F.lit(9))) == "IMG.1_clean.avif"
    assert v(X.output_name(F.lit(""), F.lit("jpg"), F.lit(""), F.lit(9))) == "IMG_9.jpg"
    assert v(X.output_name(F.lit(".hidden"), F.lit("jpg"), F.lit(""), F.lit(9))) == ".hidden.jpg"
    assert v(X.copy_name(F.lit("clip"), F.lit(2), F.lit(1))) == "clip_copy.mp4"
    assert [v(X.bytes_text(F.lit(n))) for n in (5, 1536, 5 << 20, 3 << 29)] == ["5 B", "1.5 KB", "5.0 MB", "1.50 GB"]
    assert [v(X.bytes_badge(F.lit(n))) for n in (5, 1536, 3 << 19, 20 << 20)] == ["5B", "2KB", "1.5MB", "20MB"]
    unknown = F.lit(None).cast("long")
    assert [v(f(unknown)) for f in (X.bytes_text, X.bytes_badge, X.trimmed_decimal)] == [None] * 3 and v(X.bytes_text(F.lit(0))) == "0 B"
    assert v(X.trimmed_decimal(F.lit(2.0))) == "2" and v(X.trimmed_decimal(F.lit(2.25))) == "2.3"
    assert v(X.camera_line(F.lit("Make"), F.lit(None))) == "Make" and v(X.camera_line(F.lit(""), F.lit(None))) is None
    assert v(X.exposure_line(F.lit("f/2"), F.lit(None).cast("string"), F.lit("5 mm"))) == "f/2 · 5 mm"
    assert v(X.route_id(F.lit("a/b c"))) == "a%2Fb%20c" and v(X.badge_count(F.lit(120))) == "99+"
    assert v(X.decode_ids(X.encode_ids(F.array(F.lit("a"), F.lit('b,"'))))) == ["a", 'b,"'] and v(X.decode_ids(F.lit("["))) in ([], None)
    assert v(X.mime_label(F.lit("image/x-raw"))) == "X-RAW" and v(X.mime_label(F.lit(None))) is None
    assert v(X.fourcc_label(F.lit("HVC1"))) == "HEVC (H.265)" and v(X.fourcc_label(F.lit("abcd"))) == "abcd"
    assert v(X.format_name(F.lit("heic"), F.lit(False), F.lit(True))) == "HEIF" and v(X.target_extension(F.lit("auto"))) == "jpg"


def test_numbers(spark):
    v = lambda c: value(spark, c)
    L = F.lit
    assert v(N.bits_per_pixel(L(100), L(0))) == 0.0 and v(N.pixels(L(100_000), L(100_000))) == 10**10
    assert v(N.saved_percent(L(100), L(150))) == -50 and v(N.saved_percent(L(0), L(5))) == 0
    assert v(N.savings_fraction(L(100), L(500))) == -1.0 and v(N.progress_percent(L(1.7))) == 100
    assert tuple(v(N.avif_quantizers(L(80)))) == (11, 23) and tuple(v(N.crop_rect(L(10), L(10), L(0.96), L(0.0), L(0.5), L(0.0)))) == (9, 0, 1, 1)
    assert v(N.encode_cap(L(9000), L(10)))["max_height"] == 8192 and v(N.encode_cap(L(8192), L(10)))["max_width"] is None
    assert v(N.aspect_ratio(L("original"), L(4), L(2), L(1))) == 0.5 and v(N.aspect_ratio(L("16:9"), L(1), L(1), L(0))) == 16 / 9 and v(N.aspect_ratio(L("free"), L(1), L(1), L(0))) is None
    assert v(N.elapsed_text(L(2450))) == "2.4s" and v(N.elapsed_text(L(64_000))) == "1m 04s"
    assert v(N.minutes_text(L(65))) == "1:05" and v(N.clock_text(L(9))) == "9s"
    unknown = L(None).cast("long")
    assert [v(f(unknown)) for f in (N.elapsed_text, N.minutes_text, N.clock_text)] == [None] * 3
    assert v(N.frame_count(L(1000.0), every=L(2))) == 64 and v(N.frame_count(L(0.5), fps=L(30))) == 15 and v(N.frame_count(L(3))) == 1
    assert v(N.keyframes(L(7.0))) == [2, 4, 6] and v(N.keyframes(L(1.0))) == []
    assert v(N.separation_text(L(100), L(50))) == "~2:00 min" and v(N.trims_nothing(L(0.1), L(9.9), L(10.0))) is True
    assert v(N.device_tier(L(8), L(6))) == "high" and v(N.has_place(L(0.0), L(1.0))) is False and v(N.has_place(L(None).cast("double"), L(1.0))) is False
    assert v(N.bitrate_text(L(12_500_000), L(10))) == "10 Mbps" and v(N.bitrate_text(L(1_250_000), L(10))) == "1.0 Mbps"
    r = v(N.unturned_rect(L(0.1), L(0.2), L(0.3), L(0.4), L(2), L(False), L(False)))
    assert [round(x, 6) for x in r] == [0.6, 0.4, 0.3, 0.4]


def jpeg(*segments: bytes) -> bytes:
    return b"\xff\xd8" + b"".join(segments) + b"\xff\xda\x00\x04ab" + b"scan\xff\xd9"


def segment(marker: int, data: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def riff(*parts: bytes) -> bytes:
    body = b"WEBP" + b"".join(parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def part(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack("<I", len(data)) + data + b"\x00" * (len(data) % 2)


def test_sniff(spark):
    pad = b"\x00" * 12
    cases = {b"\xff\xd8\xff" + pad: "jpeg", b"\x89PNG" + pad: "png", b"GIF8" + pad: "gif", b"BM" + pad: "bmp", b"II*\x00" + pad: "tiff", b"MM\x00*" + pad: "tiff", b"RIFF\x00\x00\x00\x00WEBP": "webp", b"\x00\x00\x00\x18ftypavif": "avif", b"\x00\x00\x00\x18ftypmif1": "heic", b"\x00\x00\x00\x18ftypisom": "unknown", b"\xff\xd8\xff": "unknown", b"": "unknown"}
    df = spark.createDataFrame(list(cases.items()), "data binary, kind string")
    assert df.filter(B.sniffed(F.col("data")) != F.col("kind")).count() == 0
    assert value(spark, B.sniffed(F.lit(None).cast("binary"))) == "unknown"


def test_strip(spark):
    icc = segment(0xE2, b"profile")
    photo = jpeg(segment(0xE0, b"JFIF"), segment(0xE1, b"Exif"), icc, segment(0xFE, b"note"))
    png = B.PNG_START + chunk(b"IHDR", b"\x00" * 13) + chunk(b"tEXt", b"x") + chunk(b"IDAT", b"y") + chunk(b"IEND", b"") + b"trailing"
    webp = riff(part(b"VP8X", b"\x1c" + b"\x00" * 9), part(b"VP8 ", b"abc"), part(b"EXIF", b"gps"), part(b"XMP ", b"x"))
    rows = spark.createDataFrame([(bytearray(b),) for b in (photo, png, webp, photo[:9] + b"\x00" * 6, b"GIF89a" + b"\x00" * 9)], "data binary")
    out = [r.s for r in rows.select(B.stripped(F.col("data")).alias("s")).collect()]
    assert bytes(out[0].bytes) == jpeg(segment(0xE0, b"JFIF"), icc) and out[0].ext == "jpg"
    assert bytes(out[1].bytes) == B.PNG_START + chunk(b"IHDR", b"\x00" * 13) + chunk(b"IDAT", b"y") + chunk(b"IEND", b"")
    assert bytes(out[2].bytes) == riff(part(b"VP8X", b"\x10" + b"\x00" * 9), part(b"VP8 ", b"abc"))
    assert bytes(out[3].bytes) == photo[:9] + b"\x00" * 6 and out[4] is None
    assert B.strip_webp(riff(part(b"VP8 ", b"abc"))) == riff(part(b"VP8 ", b"abc"))


def test_alpha_by_headers():
    from halyard.queries import IMAGES

    for kind, alpha, head, tail in IMAGES:
        if kind in ("gif", "bmp", "tiff", "png"):
            assert B.ALPHA[kind](head + tail) is alpha
            assert B.ALPHA[kind](head[:9]) is True  # what cannot be read may have alpha
    big_endian = b"MM\x00*" + struct.pack(">IH", 8, 2) + struct.pack(">HHIHH", 262, 3, 1, 1, 0) + struct.pack(">HHIHH", 277, 3, 1, 2, 0)
    assert B.tiff_has_alpha(big_endian) and not B.tiff_has_alpha(big_endian[:-4] + struct.pack(">HH", 1, 0))


def test_turn(spark):
    pixels = bytes(v for k in range(6) for v in (k, 0, 0, 255))  # 3 wide, 2 high
    png = B.turned_png(pixels, 3, 2, 1, False, False, (0, 0, 1, 1))
    raw = zlib.decompress(next(p for k, p in B.png_parts(png) if k == b"IDAT")[8:-4])
    assert struct.unpack(">II", png[16:24]) == (2, 3) and [raw[r * 7 + 1 + 3 * c] for r in range(3) for c in range(2)] == [3, 0, 4, 1, 5, 2]
    assert B.turned_png(b"", 3, 2, 0, False, False, (0, 0, 1, 1)) is None
    assert not B.png_has_alpha(png) and B.png_has_alpha(b"")
    tags = F.create_map(F.lit("GPS GPSLatitude"), F.lit("1"), F.lit("Image Make"), F.lit("m"))
    assert tuple(value(spark, B.metadata_summary(tags))) == (True, False, True, 2)
    assert tuple(value(spark, B.metadata_summary(F.lit(None).cast("map<string,string>")))) == (False, False, False, 0)
