"""Table schemas and the closed sets of values they use."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 2

# Kinds of asset, estimate families and tiers, states.
OTHER, IMAGE, VIDEO, AUDIO = 0, 1, 2, 3
FAMILIES = ("jpeg", "heif", "avif", "webp", "png", "other")
TARGETS = ("auto", "avif", "heic", "webp", "jpeg", "png")
QUALITIES = {"lightning": 50, "balanced": 80, "highest": 95}
TASK_STATES = ("pending", "running", "completed", "cancelled", "failed")
PENDING, COMMITTED = 0, 1
RETENTION_DAYS = 14
MIB = 1 << 20


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


ASSETS = _struct(
    ("id", T.StringType(), False),
    ("type", T.IntegerType(), False),
    ("created_date", T.LongType(), False),
    ("modified_date", T.LongType(), False),
    ("width", T.IntegerType(), False),
    ("height", T.IntegerType(), False),
    ("duration_ms", T.LongType(), False),
    ("size_bytes", T.LongType(), True),
    ("title", T.StringType(), True),
    ("mime_type", T.StringType(), True),
)

TRASH = _struct(
    ("id", T.StringType(), False),
    ("original_asset_id", T.StringType(), False),
    ("filename", T.StringType(), False),
    ("created_date_ms", T.LongType(), False),
    ("modified_date_ms", T.LongType(), False),
    ("latitude", T.DoubleType(), True),
    ("longitude", T.DoubleType(), True),
    ("is_favorite", T.BooleanType(), False),
    ("was_in_smart_album", T.BooleanType(), False),
    ("user_album_ids", T.StringType(), False),
    ("mime_type", T.StringType(), True),
    ("asset_type", T.IntegerType(), False),
    ("width", T.IntegerType(), False),
    ("height", T.IntegerType(), False),
    ("original_bytes", T.LongType(), False),
    ("new_bytes", T.LongType(), False),
    ("backup_path", T.StringType(), False),
    ("new_asset_id", T.StringType(), True),
    ("state", T.IntegerType(), False),
    ("deleted_at_ms", T.LongType(), False),
)

#: What a column holds where a new row does not say; null for the rest.
ASSET_DEFAULTS = {"created_date": 0, "modified_date": 0, "width": 0, "height": 0, "duration_ms": 0}
TRASH_DEFAULTS = {"filename": "", "created_date_ms": 0, "modified_date_ms": 0, "is_favorite": False, "was_in_smart_album": False, "user_album_ids": "[]", "asset_type": 1, "width": 0, "height": 0, "original_bytes": 0, "new_bytes": 0, "backup_path": "", "state": 0, "deleted_at_ms": 0}
