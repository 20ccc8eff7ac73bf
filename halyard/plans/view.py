"""From view choices to plans: parameters, predicates, orders, pages, selections."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.schema import IMAGE, MIB, VIDEO
from halyard.scratch import numbered

# Size buckets (lower, upper) and the needles of a format.
BUCKETS = {"any": (None, None), "small": (None, MIB), "medium": (MIB, 10 * MIB), "large": (10 * MIB, None)}
NEEDLES = {"jpeg": ("jpeg", "jpg"), "mov": ("mov", "quicktime")}
SORTS = {"newest": ("created_date", False), "oldest": ("created_date", True), "largest": ("size_bytes", False), "smallest": ("size_bytes", True)}
TYPES = {"all": None, "photos": IMAGE, "videos": VIDEO}


@dataclass(frozen=True)
class View:
    """What a user chose: kind, order, size bucket, format."""

    kind: str = "all"
    sort: str = "newest"
    size: str = "any"
    format: str | None = None

    @property
    def any_active(self) -> bool:
        return self.sort != "newest" or self.size != "any" or self.format is not None

    @property
    def needs_sizes(self) -> bool:
        return self.size != "any" or self.sort in ("largest", "smallest")


def flags(sort: Column, size: Column, format: Column) -> Column:
    """(active, needs_sizes) of stored choices, as ``View`` has them; an absent format is null."""
    return F.struct(((sort != "newest") | (size != "any") | format.isNotNull()).alias("active"), ((size != "any") | sort.isin("largest", "smallest")).alias("needs_sizes"))


@dataclass(frozen=True)
class Parameters:
    """What the index is asked: all parts are optional but the order."""

    type: int | None = None
    least: int | None = None
    below: int | None = None
    needles: tuple[str, ...] = ()
    order: str = "created_date"
    ascending: bool = False


def planned(view: View) -> Parameters:
    least, below = BUCKETS[view.size]
    order, ascending = SORTS[view.sort]
    needles = NEEDLES.get(view.format, (view.format,)) if view.format else ()
    return Parameters(TYPES[view.kind], least, below, needles, order, ascending)


def has_format(needles: tuple[str, ...]) -> Column:
    mime, title = F.lower(F.coalesce("mime_type", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    return reduce(or_, (mime.contains(n) | title.endswith("." + n) for n in needles))


def predicate(p: Parameters) -> Column | None:
    """The supplied parts joined by AND, or None. An unknown size meets no bound; a size of 0 is below any upper one."""
    parts = []
    if p.type is not None:
        parts.append(F.col("type") == p.type)
    if p.least is not None:
        parts.append(F.col("size_bytes") >= p.least)
    if p.below is not None:
        parts.append(F.col("size_bytes") < p.below)
    if p.needles:
        parts.append(has_format(p.needles))
    return reduce(and_, parts) if parts else None


def matching(assets: DataFrame, p: Parameters) -> DataFrame:
    test = predicate(p)
    return assets if test is None else assets.filter(test)


def order_of(p: Parameters) -> list[Column]:
    """Unknown sizes are the smallest; ties by id, ascending."""
    c = F.col(p.order)
    return [c.asc_nulls_first() if p.ascending else c.desc_nulls_last(), F.col("id").asc()]


def entries(assets: DataFrame, p: Parameters) -> DataFrame:
    return matching(assets, p).orderBy(*order_of(p))


def page(assets: DataFrame, p: Parameters, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the order: a distributed top-k, not a full sort."""
    return entries(assets, p).offset(offset).limit(limit)


def count(assets: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    return matching(assets, p).agg(F.count(F.lit(1)).alias("n"))


def matching_ids(assets: DataFrame, p: Parameters) -> DataFrame:
    return matching(assets, p).select("id")


def all_ids(assets: DataFrame) -> DataFrame:
    return assets.select("id").distinct()


def known_sizes(assets: DataFrame, ids: DataFrame) -> DataFrame:
    return assets.filter(F.col("size_bytes") > 0).join(ids, "id", "left_semi").select("id", "size_bytes")


def facts(assets: DataFrame, ids: DataFrame) -> DataFrame:
    return assets.filter(F.col("size_bytes") > 0).join(ids, "id", "left_semi").select("id", "size_bytes", "width", "height")


def estimate_facts(assets: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    sized = assets.filter(F.col("size_bytes") > 0)
    return (sized if ids is None else sized.join(ids, "id", "left_semi")).select("id", "width", "height", "size_bytes", "mime_type", "title")


def ids_missing_size(assets: DataFrame, limit: int = 200) -> DataFrame:
    """The first ``limit`` ids without a size; by id, so that the choice is stable."""
    return assets.filter(F.col("size_bytes").isNull()).select("id").orderBy("id").limit(limit)


def first_missing(view: DataFrame, p: Parameters, limit: int = 300) -> DataFrame:
    """The first rows of a view's order without a size: what a screen resolves first."""
    return matching(view, p).filter(F.col("size_bytes").isNull()).orderBy(*order_of(p)).limit(limit)


def spine(assets: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """The columns a list shows: the indexed size, else a freshly resolved one, else null; whole seconds; a time or null."""
    size = F.when(F.col("size_bytes") > 0, F.col("size_bytes"))
    if fresh is not None:
        assets = assets.join(fresh.select("id", F.col("size_bytes").alias("__fresh")), "id", "left")
        size = F.coalesce(size, F.when(F.col("__fresh") > 0, F.col("__fresh")))
    return assets.select("id", "type", size.alias("size_bytes"), F.round(F.col("duration_ms") / 1000).cast("long").alias("seconds"), F.timestamp_seconds(F.nullif("created_date", F.lit(0))).alias("created"))


def in_bucket_or_unknown(view: View) -> Column:
    """The client's bucket, which keeps unknown sizes."""
    p = planned(replace(view, kind="all", format=None))
    test = predicate(p)
    return F.lit(True) if test is None else F.col("size_bytes").isNull() | test


def client_format(view: View) -> Column:
    """The client's formats: as the index's, but a title never ends in .quicktime."""
    if view.format is None:
        return F.lit(True)
    mime, title = F.lower(F.coalesce("mime_type", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    needles = NEEDLES.get(view.format, (view.format,))
    return reduce(or_, [mime.contains(n) for n in needles] + [title.endswith("." + n) for n in needles if n != "quicktime"])


def client_view(loaded: DataFrame, view: View, position: str = "position") -> DataFrame:
    """A loaded list filtered and ordered as the client does: size orders take unknown as 0, date orders keep the
    source's order, either way round."""
    rows = loaded.filter(in_bucket_or_unknown(view) & client_format(view))
    size = F.coalesce("size_bytes", F.lit(0))
    order = {"largest": [size.desc(), F.col(position)], "smallest": [size.asc(), F.col(position)], "oldest": [F.col(position).desc()], "newest": [F.col(position)]}
    return rows.orderBy(*order[view.sort])


def positions(assets: DataFrame, p: Parameters) -> DataFrame:
    """The view's rows with their place from 0."""
    return numbered(matching(assets, p), order_of(p))


def type_lock(placed: DataFrame, selection: DataFrame) -> DataFrame:
    """One row: the type of the first selected entry in view order; null for none."""
    return placed.join(selection, "id", "left_semi").agg(F.min_by("type", "position").alias("type"))


def select_all(assets: DataFrame, view: View, locked: int | None = None) -> DataFrame:
    """Ids of what select-all takes: one type, the lock's if any, else videos or images as the view shows."""
    kind = locked if locked is not None else VIDEO if view.kind == "videos" else IMAGE
    return matching_ids(assets, replace(planned(view), type=kind))


def select_run(placed: DataFrame, base: DataFrame, anchor: int, to: int) -> DataFrame:
    """A selection after a drag from place ``anchor`` to ``to``: the base and the run's entries of the anchor's type."""
    kind = placed.filter(F.col("position") == anchor).select(F.col("type").alias("__type"))
    run = placed.filter(F.col("position").between(min(anchor, to), max(anchor, to))).join(F.broadcast(kind), F.col("type") == F.col("__type"), "left_semi")
    return base.select("id").union(run.select("id")).distinct()


def named(albums: DataFrame, query: str) -> DataFrame:
    """Albums whose name holds the query, whatever the case; all for an empty one."""
    q = query.strip().lower()
    return albums if not q else albums.filter(F.lower("name").contains(q))


def next_page(loaded: DataFrame, assets: DataFrame, p: Parameters, start: int, size: int = 100) -> DataFrame:
    return loaded.unionByName(page(assets, p, start, size))


def album_strip(albums: DataFrame, shown: int = 5) -> DataFrame:
    """The first albums but the one of everything, in order, each with how many follow unseen."""
    own = albums.filter(~F.col("is_all"))
    more = own.agg(F.greatest(F.count(F.lit(1)) - shown, F.lit(0)).alias("more"))
    return own.orderBy("position").limit(shown).crossJoin(F.broadcast(more))


def shared(placed: DataFrame, selection: DataFrame, most: int = 12) -> DataFrame:
    return placed.join(selection, "id", "left_semi").orderBy("position").limit(most)


def moved(items: DataFrame, old: int, new: int) -> DataFrame:
    """A list with the item at ``old`` at ``new``: only positions change."""
    at = F.col("position")
    place = F.when(at == old, F.lit(new)).when((at > old) & (at <= new), at - 1).when((at < old) & (at >= new), at + 1).otherwise(at)
    return items.withColumn("position", place.cast(items.schema["position"].dataType))
