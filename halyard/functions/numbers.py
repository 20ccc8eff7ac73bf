"""Numbers and times as columns. ``as_of`` is always given, so a plan gives the same rows whenever it runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def clamp(x: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(x, low), high)


def pixels(width: Column, height: Column) -> Column:
    return width.cast("long") * height.cast("long")


def bits_per_pixel(size: Column, px: Column) -> Column:
    return F.when(px > 0, size.cast("double") * 8 / px).otherwise(0.0)


def megapixels(width: Column, height: Column) -> Column:
    return pixels(width, height) / F.lit(1e6)


def bitrate_text(size: Column, seconds: Column) -> Column:
    mbps = F.when(seconds > 0, size.cast("double") * 8 / seconds / 1e6)
    return F.when(mbps >= 10, F.format_string("%.0f Mbps", mbps)).otherwise(F.when(mbps.isNotNull(), F.format_string("%.1f Mbps", mbps)))


def savings_fraction(original: Column, result: Column) -> Column:
    return F.when(original > 0, clamp((original - result) / original.cast("double"), -1.0, 1.0)).otherwise(0.0)


def saved_percent(original: Column, expected: Column) -> Column:
    """May be negative; 0 without an original."""
    return F.when(original > 0, F.round((1 - expected / original.cast("double")) * 100)).otherwise(0).cast("long")


def progress_percent(progress: Column) -> Column:
    return F.round(clamp(progress * 100, 0.0, 100.0)).cast("int")


def aspect_ratio(choice: Column, width: Column, height: Column, quarter_turns: Column) -> Column:
    """free: null; original: the image's, swapped on odd turns; else like 4:3."""
    own = F.when((width > 0) & (height > 0), F.when(F.pmod(quarter_turns, F.lit(2)) == 1, height / width).otherwise(width / height))
    left, right = F.split_part(choice, F.lit(":"), F.lit(1)).try_cast("double"), F.split_part(choice, F.lit(":"), F.lit(2)).try_cast("double")
    return F.when(choice == "free", F.lit(None)).when(choice == "original", own).otherwise(F.when(right > 0, left / right))


def encode_cap(width: Column, height: Column, edge: int = 8192) -> Column:
    """(width, height) bounds: both the edge if the longer side exceeds it, else none."""
    bound = F.when(F.greatest(width, height) > edge, F.lit(edge))
    return F.struct(bound.alias("max_width"), bound.alias("max_height"))


def crop_rect(width: Column, height: Column, left: Column, top: Column, w: Column, h: Column) -> Column:
    """Fractions of an image as whole pixels inside it, at least one each way."""
    x = clamp(F.round(left * width), F.lit(0), width - 1).cast("int")
    y = clamp(F.round(top * height), F.lit(0), height - 1).cast("int")
    return F.struct(x.alias("x"), y.alias("y"), clamp(F.round(w * width), F.lit(1), width - x).cast("int").alias("w"), clamp(F.round(h * height), F.lit(1), height - y).cast("int").alias("h"))


def unturned_rect(left: Column, top: Column, w: Column, h: Column, quarter_turns: Column, flip_h: Column, flip_v: Column) -> Column:
    """A rectangle of the shown image, in fractions, as one of the stored image: flips undone, then turns."""
    x = F.when(flip_h, 1 - left - w).otherwise(left)
    y = F.when(flip_v, 1 - top - h).otherwise(top)
    turn = F.pmod(quarter_turns, F.lit(4))
    out = lambda a, b, c, d: F.struct(a.alias("left"), b.alias("top"), c.alias("w"), d.alias("h"))
    return F.when(turn == 1, out(y, 1 - x - w, h, w)).when(turn == 2, out(1 - x - w, 1 - y - h, w, h)).when(turn == 3, out(1 - y - h, x, h, w)).otherwise(out(x, y, w, h))


def avif_quantizers(quality: Column) -> Column:
    most = clamp(F.round(63 - quality / 2.0), 12, 55).cast("int")
    return F.struct(clamp(most - 12, F.lit(0), most).cast("int").alias("min_q"), most.alias("max_q"))


def hardware_rate(quality: Column) -> Column:
    """Target bits per pixel and constant quality of a hardware encoder."""
    q = clamp(quality, 0, 100)
    constant = clamp((63 - q * 0.53).cast("int"), 10, 63)
    return F.struct((0.6 + q / 100.0 * 3.4).alias("bpp"), constant.alias("constant_quality"))


def has_place(latitude: Column, longitude: Column) -> Column:
    return F.coalesce((latitude != 0) & (longitude != 0), F.lit(False))


def device_tier(cores: Column, memory_gb: Column) -> Column:
    return F.when((cores >= 8) & (memory_gb >= 6), "high").when((cores >= 4) & (memory_gb >= 3), "mid").otherwise("low")


def video_frames(fps: Column, seconds: Column) -> Column:
    return F.round(fps * seconds).cast("long")


def image_facts(bit_depth: Column, has_alpha: Column, is_hdr: Column, colour_model: Column) -> Column:
    return F.struct(F.coalesce(bit_depth, F.lit(8)).alias("bit_depth"), F.coalesce(has_alpha, F.lit(False)).alias("has_alpha"), F.coalesce(is_hdr, F.lit(False)).alias("is_hdr"), colour_model.alias("colour_model"))


def seconds_time(seconds: Column) -> Column:
    """Epoch seconds as a time; 0 is unknown."""
    return F.timestamp_seconds(F.nullif(seconds, F.lit(0)))


def retention_cutoff(as_of: Column, days: int) -> Column:
    return F.unix_millis(as_of) - F.lit(days * DAY_MS)


def days_remaining(deleted_at_ms: Column, as_of: Column, days: int) -> Column:
    left = deleted_at_ms + F.lit(days * DAY_MS) - F.unix_millis(as_of)
    return clamp(F.floor(left / DAY_MS), 0, days).cast("int")


def relative_time(when: Column, as_of: Column) -> Column:
    """(unit, count): just now, minutes, hours or days ago, truncated."""
    s = F.unix_millis(as_of) - F.unix_millis(when)
    unit = F.when(s < 60_000, "now").when(s < 3_600_000, "minutes").when(s < DAY_MS, "hours").otherwise("days")
    count = F.when(s < 60_000, F.lit(0)).when(s < 3_600_000, F.floor(s / 60_000)).when(s < DAY_MS, F.floor(s / 3_600_000)).otherwise(F.floor(s / DAY_MS))
    return F.struct(unit.alias("unit"), count.cast("long").alias("count"))


def elapsed_ms(started: Column, ended: Column) -> Column:
    return F.unix_millis(ended) - F.unix_millis(started)


def elapsed_text(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.when(s.isNull(), None).when(s < 60, F.format_string("%d.%ds", s, F.floor((ms % 1000) / 100))).otherwise(F.format_string("%dm %02ds", F.floor(s / 60), s % 60))


def minutes_text(seconds: Column) -> Column:
    return F.when(seconds.isNotNull(), F.format_string("%d:%02d", F.floor(seconds / 60), F.floor(seconds % 60)))


def clock_text(seconds: Column) -> Column:
    return F.when(seconds < 60, F.format_string("%ds", F.floor(seconds))).otherwise(minutes_text(seconds))


def frame_count(duration: Column, every: Column | None = None, fps: Column | None = None) -> Column:
    """Frames to take of a clip: one each so many seconds, or so many a second, 1 to 64; one if neither is given."""
    if every is None and fps is None:
        return F.lit(1)
    return clamp(F.floor(duration / every if every is not None else duration * fps), 1, 64).cast("int")


def animation_bytes(px: Column, fps: Column, duration: Column, target: Column) -> Column:
    factor = F.when(target == "avif", 0.35).when(target == "webp", 0.55).otherwise(1.4)
    return F.round(px * fps * clamp(duration, 0.1, 60.0) * 0.0005 * factor).cast("long")


def trims_nothing(start: Column, end: Column, duration: Column) -> Column:
    return (start < 0.2) & (duration - end < 0.2)


def keyframes(duration: Column, every: int = 2) -> Column:
    n = F.floor(duration / every)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: k * every)).otherwise(F.array().cast("array<bigint>"))


def separation_text(seconds: Column, strength: Column) -> Column:
    total = F.round(seconds * (0.4 + strength / 100.0 * 1.6)).cast("long")
    return F.concat(F.lit("~"), minutes_text(total), F.lit(" min"))
