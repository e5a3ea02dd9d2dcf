"""Half-open intervals [start, limit): overlap join, existence, hull, union.

Overlap predicates alone plan as a nested loop.  Here each interval gets a level
by its length (widths grow by ``RATIO``), so that it touches at most two buckets
of its own level and of every coarser one; two intervals meet once, at the
coarser of their levels, in the bucket that holds the later start.  That is an
equi-join on (level, bucket) whatever the lengths, and duplicates stay.
Empty intervals (start >= limit) overlap nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATIO = 8
#: Levels of buckets; the longest are of 2^60 and more for a width of 64.
LEVELS = 19


def intersects(start: Column, limit: Column, other_start: Column, other_limit: Column) -> Column:
    return (limit > other_start) & (other_limit > start)


def intersection(start: Column, limit: Column, other_start: Column, other_limit: Column) -> Column:
    """struct<start, limit>; empty where the two don't meet."""
    return F.struct(F.greatest(start, other_start).alias("start"), F.least(limit, other_limit).alias("limit"))


def is_empty(start: Column, limit: Column) -> Column:
    return start >= limit


def span(start: Column, limit: Column, other_start: Column, other_limit: Column) -> Column:
    """Hull of two intervals; an empty one doesn't count."""
    own, other = F.struct(start.alias("start"), limit.alias("limit")), F.struct(other_start.alias("start"), other_limit.alias("limit"))
    hull = F.struct(F.least(start, other_start).alias("start"), F.greatest(limit, other_limit).alias("limit"))
    return F.when(is_empty(other_start, other_limit), own).when(is_empty(start, limit), other).otherwise(hull)


def _own_level(start: str, limit: str, width: int) -> Column:
    length = F.col(limit) - F.col(start)
    own = F.lit(0)
    for k in range(1, LEVELS):
        own = F.when(length > min(width * RATIO ** (k - 1), 1 << 62), F.lit(k)).otherwise(own)
    return own


def _used_levels(df: DataFrame) -> list[int]:
    """The levels that occur in ``_own``; one aggregated row."""
    bits = df.agg(F.bit_or(F.pow(F.lit(2), F.col("_own")).cast("int"))).first()[0] or 0
    return [k for k in range(LEVELS) if bits >> k & 1]


def _placed(df: DataFrame, start: str, limit: str, width: int, levels: Column, first: str) -> DataFrame:
    """A row for each of ``levels`` and bucket there that an interval touches."""
    df = df.withColumn("_level", F.explode(levels))
    size = F.element_at(F.array(*(F.lit(min(width * RATIO**k, 1 << 62)).cast("long") for k in range(LEVELS))), F.col("_level") + 1)
    begin, end = F.floor(F.col(start) / size), F.floor((F.col(limit) - 1) / size)
    return df.withColumn("_bucket", F.explode(F.sequence(begin, end))).withColumn(first, begin).drop("_own")


def overlap_join(a: DataFrame, b: DataFrame, a_start: str, a_limit: str, b_start: str, b_limit: str, width: int = 64) -> DataFrame:
    """All pairs of rows whose intervals meet, once each; column names of a and b have to differ."""
    x = a.where(F.col(a_start) < F.col(a_limit)).withColumn("_own", _own_level(a_start, a_limit, width))
    y = b.where(F.col(b_start) < F.col(b_limit)).withColumn("_own", _own_level(b_start, b_limit, width))
    of_x, of_y = _used_levels(x), _used_levels(y)
    own = F.array("_own")

    def up(levels: list[int], strictly: bool) -> Column:
        every = F.array(*map(F.lit, levels)).cast("array<int>")
        return F.filter(every, lambda k: k > F.col("_own") if strictly else k >= F.col("_own"))

    met = None
    for xs, ys in ((own, up(of_x, False)), (up(of_y, True), own)):  # a's level is the coarser, or b's
        left = _placed(x, a_start, a_limit, width, xs, "_first_a")
        right = _placed(y, b_start, b_limit, width, ys, "_first_b")
        both = left.join(right, ["_level", "_bucket"]).where(
            (F.col("_bucket") == F.greatest("_first_a", "_first_b")) & intersects(F.col(a_start), F.col(a_limit), F.col(b_start), F.col(b_limit))
        )
        both = both.select(*a.columns, *b.columns)
        met = both if met is None else met.unionByName(both)
    return met


#: Ranges of starts in which the intervals of one large key, or of all without keys, are compacted.
RANGES = 256
#: Rows that a task of a compaction sorts, on average; a key with more is cut into ranges.
ROWS = 1 << 18


def compact(df: DataFrame, start: str, limit: str, keys: list[str] | None = None) -> DataFrame:
    """keys, start, limit of the union's maximal intervals; touching ones merge.

    Rows are counted first, so that the number of tasks grows with them and a task
    sorts about ``ROWS``, however well shuffled rows compress.  Without keys, and in
    keys with more rows than that, starts are cut into ranges.
    """
    rows = df.where(F.col(start) < F.col(limit)).select(*(keys or []), F.col(start).alias("start"), F.col(limit).alias("limit"))
    if not keys:
        return _ranged(rows.withColumn("_key", F.lit(0)), _tasks(rows.count())).drop("_key")
    # A struct is equal to another with nulls in the same places.
    named = rows.select(F.struct(*keys).alias("_key"), "start", "limit")
    sizes = named.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    tasks = _tasks(total or 0)
    if (most or 0) <= ROWS:
        return _islands(rows.repartition(tasks, *keys), keys)
    large = F.broadcast(sizes.where(F.col("n") > ROWS).select("_key"))  # fewer than one in ROWS rows
    small = _islands(named.join(large, "_key", "left_anti").repartition(tasks, "_key"), ["_key"])
    return small.unionByName(_ranged(named.join(large, "_key", "left_semi"), tasks)).select("_key.*", "start", "limit")


def _tasks(rows: int) -> int:
    return max(1, -(-rows // ROWS))


def _ranged(rows: DataFrame, tasks: int) -> DataFrame:
    """_key, start, limit of the islands of few large keys.

    Starts are cut into ranges of about equal numbers of rows.  Each range gets the
    greatest limit before it, so that its islands are known on their own, and islands
    are numbered through by counts of ranges; only one row a range meets in one place.
    """
    # At most RANGES numbers for each of few keys.
    cuts = rows.groupBy("_key").agg(F.array_distinct(F.percentile_approx("start", [k / RANGES for k in range(1, RANGES)], 1 << 12)).alias("_cuts"))
    placed = rows.join(F.broadcast(cuts), "_key").withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col("start")))).drop("_cuts")
    placed = placed.repartition(tasks, "_key", "_range")
    place = ["_key", "_range"]
    upto = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    before = placed.groupBy(*place).agg(F.max("limit").alias("_most")).select(*place, F.max("_most").over(upto).alias("_carry"))
    order = Window.partitionBy(*place).orderBy("start", "limit")
    reach = F.greatest(F.max("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    marked = placed.join(F.broadcast(before), place).withColumn("_new", (F.col("start") > F.coalesce(reach, F.col("start") - 1)).cast("long"))
    numbered = marked.withColumn("_own", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    made = marked.groupBy(*place).agg(F.sum("_new").alias("_n")).select(*place, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    islands = numbered.join(F.broadcast(made), place).groupBy("_key", (F.col("_base") + F.col("_own")).alias("_island"))
    return islands.agg(F.min("start").alias("start"), F.max("limit").alias("limit")).drop("_island")


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "limit")
    reach = F.max("limit").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    marked = rows.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("limit").alias("limit")).drop("_island")


def covered_length(df: DataFrame, start: str, limit: str, keys: list[str] | None = None) -> DataFrame:
    """keys, covered: length of the union of intervals."""
    return compact(df, start, limit, keys).groupBy(*(keys or [])).agg(F.coalesce(F.sum(F.col("limit") - F.col("start")), F.lit(0)).alias("covered"))


def overlap_totals(a: DataFrame, b: DataFrame, a_start: str, a_limit: str, b_start: str, b_limit: str) -> DataFrame:
    """Rows of a that meet intervals of b, with ``pairs``, their number, and ``shared``, the summed length of the intersections.

    These are the aggregates of :func:`overlap_join` by rows of a, without its pairs:
    an interval meets those that start before its limit less those that end up to its
    start, and shares the area below b's depth between its ends.  Both are running
    totals over the ends of all intervals in order, in ranges of about equal numbers
    of ends, of which one row each meets in one place.  Names ``_...`` are taken.
    """
    x = a.where(F.col(a_start) < F.col(a_limit))
    y = b.where(F.col(b_start) < F.col(b_limit))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = y.select(F.col(b_start).alias("_at"), one.alias("_s"), none.alias("_l")).unionByName(y.select(F.col(b_limit).alias("_at"), none.alias("_s"), one.alias("_l")))
    asked = x.select(F.col(a_start).alias("_at")).union(x.select(F.col(a_limit).alias("_at")))
    # One row a place, so that many equal ends are added up before the shuffle.
    places = ends.unionByName(asked.select("_at", none.alias("_s"), none.alias("_l"))).groupBy("_at").agg(F.sum("_s").alias("_s"), F.sum("_l").alias("_l"))
    cuts = asked.agg(F.array_distinct(F.percentile_approx("_at", [k / RANGES for k in range(1, RANGES)], 1 << 12)).alias("_cuts"))
    ranged = places.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col("_at")))).drop("_cuts")
    order = Window.partitionBy("_range").orderBy("_at")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(F.col("_s") - F.col("_l")).over(upto), none)
    step = F.coalesce(F.col("_at") - F.lag("_at").over(order), none)
    local = ranged.withColumn("_begun", F.coalesce(F.sum("_s").over(upto), none)).withColumn("_ended", F.sum("_l").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.withColumn("_depth", depth).withColumn("_step", step).withColumn("_area", F.sum(F.col("_depth") * F.col("_step")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # What a range adds to the next ones; at most RANGES rows.
    whole = local.groupBy("_range").agg(F.sum("_s").alias("_ts"), F.sum("_l").alias("_tl"), F.max_by("_area", "_at").alias("_ta"), F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    ranges = Window.orderBy("_range")
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("_bs", F.coalesce(F.sum("_ts").over(before), none)).withColumn("_bl", F.coalesce(F.sum("_tl").over(before), none))
    open_ = F.col("_bs") - F.col("_bl")
    gap = F.coalesce(F.col("_from") - F.lag("_to").over(ranges), none) * open_
    whole = whole.withColumn("_gap", gap).withColumn("_inside", F.col("_ta") + open_ * (F.col("_to") - F.col("_from")))
    whole = whole.withColumn("_ba", F.sum("_gap").over(ranges.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("_inside").over(before), none))
    totals = local.join(F.broadcast(whole.select("_range", "_bs", "_bl", "_ba", "_from")), "_range").select(
        "_at",
        (F.col("_bs") + F.col("_begun")).alias("_begun"),
        (F.col("_bl") + F.col("_ended")).alias("_ended"),
        (F.col("_ba") + F.col("_area") + open_ * (F.col("_at") - F.col("_from"))).alias("_area"),
    )
    first = totals.select(F.col("_at").alias(a_start), F.col("_ended").alias("_out"), F.col("_area").alias("_area_from"))
    last = totals.select(F.col("_at").alias(a_limit), F.col("_begun").alias("_in"), F.col("_area").alias("_area_to"))
    met = x.join(first, a_start).join(last, a_limit).withColumn("pairs", F.col("_in") - F.col("_out")).where("pairs > 0")
    return met.select(*a.columns, "pairs", (F.col("_area_to") - F.col("_area_from")).alias("shared"))


def exists(a: DataFrame, b: DataFrame, a_start: str, a_limit: str, b_start: str, b_limit: str, id_column: str, width: int = 64) -> DataFrame:
    """Rows of a that meet any interval of b; b is reduced to its union first."""
    union = compact(b, b_start, b_limit).select(F.col("start").alias("_s"), F.col("limit").alias("_l"))
    hit = overlap_join(a.select(id_column, a_start, a_limit), union, a_start, a_limit, "_s", "_l", width).select(id_column).distinct()
    return a.join(hit, id_column, "left_semi")


def hull(df: DataFrame, start: str, limit: str, keys: list[str] | None = None) -> DataFrame:
    """keys, start, limit: least start and greatest limit of the intervals that aren't empty."""
    rows = df.where(F.col(start) < F.col(limit))
    return rows.groupBy(*(keys or [])).agg(F.min(start).alias("start"), F.max(limit).alias("limit"))
