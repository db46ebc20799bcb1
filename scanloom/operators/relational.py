"""Relational forms of the capture operators: each takes and gives DataFrames, whatever the columns are called.

What is summed across partitions is summed as whole micrometres, so results don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICRO = 1_000_000
KEY_OFFSET, KEY_BITS = 1 << 20, 21


def micro(x: Column) -> Column:
    """Metres as whole micrometres."""
    return F.round(x * MICRO).cast("long")


def cell(x: Column, size: float, origin: float = 0.0) -> Column:
    """Floor division, exact for negative values."""
    return F.floor((x - F.lit(origin)) / F.lit(float(size))).cast("long")


def pack_key(ix: Column, iy: Column, iz: Column) -> Column:
    """Three 21-bit indexes in one long, in the order of x, y, z."""
    part = lambda c: (c + F.lit(KEY_OFFSET)).cast("long")
    return F.shiftleft(part(ix), 2 * KEY_BITS).bitwiseOR(F.shiftleft(part(iy), KEY_BITS)).bitwiseOR(part(iz))


def unpack_key(key: Column) -> tuple[Column, Column, Column]:
    mask = (1 << KEY_BITS) - 1
    part = lambda shift: F.shiftright(key, shift).bitwiseAND(F.lit(mask)) - F.lit(KEY_OFFSET)
    return part(2 * KEY_BITS), part(KEY_BITS), part(0)


# -- voxels and rasters ------------------------------------------------------------------------------------------


def frame_voxels(points: DataFrame, frame: str, xyz: tuple[str, str, str], size: float, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each frame and voxel: number of points and sums in micrometres."""
    x, y, z = (F.col(c) for c in xyz)
    keyed = points.withColumn("voxel", pack_key(cell(x, size), cell(y, size), cell(z, size)))
    sums = [F.sum(micro(c)).alias(f"s{n}") for n, c in zip("xyz", (x, y, z), strict=True)]
    return keyed.groupBy(*by, frame, "voxel").agg(F.count("*").alias("n"), *sums)


def fuse_voxels(partial: DataFrame, least_frames: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of frames merged: as one row stands for a frame and voxel, their number is the number of distinct frames."""
    whole = partial.groupBy(*by, "voxel").agg(
        F.sum("n").alias("n_points"), F.count("*").alias("n_frames"), *[F.sum(f"s{c}").alias(f"s{c}") for c in "xyz"]
    )
    centre = [F.round(F.col(f"s{c}") / F.col("n_points") / MICRO, 6).alias(c) for c in "xyz"]
    return whole.where(F.col("n_frames") >= least_frames).select(*by, "voxel", "n_points", "n_frames", *centre)


def height_raster(points: DataFrame, key: list[str], height: Column, floor_tolerance: float, bin_size: float, bins: int) -> DataFrame:
    """For each cell the number of floor points and the set of height bins above the floor as a bitmap."""
    on_floor = F.abs(height) < floor_tolerance
    bit = F.floor(height / bin_size).cast("int")
    raised = ~on_floor & (height > 0) & (bit < bins)
    return points.groupBy(*key).agg(
        F.count_if(on_floor).alias("floor"),
        F.coalesce(F.bit_or(F.when(raised, F.call_function("shiftleft", F.lit(1).cast("long"), bit))), F.lit(0).cast("long")).alias("heights"),
    )


def band_share(bits: Column, mask: int) -> Column:
    """The share of the mask's bins that are set."""
    return F.bit_count(bits.bitwiseAND(F.lit(mask))) / F.lit(float(bin(mask).count("1")))


def line_cells(cells: DataFrame, row: str, at: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The length of the run of consecutive cells that each cell lies in."""
    within = Window.partitionBy(*by, row).orderBy(at)
    islands = cells.withColumn("island", F.col(at) - F.row_number().over(within))
    return islands.withColumn("run", F.count("*").over(Window.partitionBy(*by, row, "island"))).drop("island")


def gaps_between(rows: DataFrame, by: list[str], at: str, low: float, high: float) -> DataFrame:
    """Consecutive rows whose distance lies in [low, high]."""
    following = F.lead(at).over(Window.partitionBy(*by).orderBy(at))
    return rows.withColumn("to", following).withColumn("gap", F.col("to") - F.col(at)).where(F.col("gap").between(low, high))


def adjacent_labels(cells: DataFrame, x: str, y: str, label: str) -> DataFrame:
    """Pairs of different labels that meet between 4-neighbours, and at how many places."""
    found = []
    for dx, dy in ((1, 0), (0, 1)):
        other = cells.select((F.col(x) - dx).alias(x), (F.col(y) - dy).alias(y), F.col(label).alias("_other"))
        found.append(cells.select(x, y, label).join(other, [x, y]).where(F.col(label) != F.col("_other")))
    met = found[0].unionByName(found[1])
    return met.groupBy(F.least(label, "_other").alias("a"), F.greatest(label, "_other").alias("b")).agg(F.count("*").alias("cells"))


def owner(rows: DataFrame, by: list[str], label: str, least_share: float) -> DataFrame:
    """The most frequent label of each group, if it has a large enough share; the lower label of equals."""
    counts = rows.groupBy(*by, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.max_by(F.struct(label, "n"), F.struct(F.col("n"), -F.col(label))).alias("best"), F.sum("n").alias("total"))
    return best.select(*by, F.col(f"best.{label}").alias(label), F.col("best.n").alias("n"), "total").where(F.col("n") >= least_share * F.col("total"))


def saturating_count(rows: DataFrame, key: list[str], n: Column | None = None, most: int = 65_535) -> DataFrame:
    return rows.groupBy(*key).agg(F.least(F.sum(n) if n is not None else F.count("*"), F.lit(most)).cast("long").alias("rays"))


# -- histograms ----------------------------------------------------------------------------------------------------


def histogram(rows: DataFrame, value: Column, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.select(*by, cell(value, size).alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def smoothed(bins: DataFrame, reach: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums over bins up to ``reach`` away; bins that are missing count as empty."""
    around = Window.partitionBy(*by).orderBy("bin").rangeBetween(-reach, reach)
    return bins.withColumn("s", F.sum("n").over(around))


def smoothed_circular(bins: DataFrame, period: int, reach: int, by: tuple[str, ...] = ()) -> DataFrame:
    wrapped = reduce(DataFrame.unionByName, [bins.withColumn("bin", F.col("bin") + k * period) for k in (-1, 0, 1)])
    return smoothed(wrapped, reach, by).where(F.col("bin").between(0, period - 1))


def peak(bins: DataFrame, by: tuple[str, ...] = (), of: str = "s") -> DataFrame:
    """The highest bin, the first of equals."""
    return bins.groupBy(*by).agg(F.max_by("bin", F.struct(F.col(of), -F.col("bin"))).alias("bin"), F.max(of).alias(of))


def local_maxima(bins: DataFrame, by: tuple[str, ...] = (), of: str = "s") -> DataFrame:
    """Bins not below the one before and above the one after; neighbours that are missing are empty."""
    order = Window.partitionBy(*by).orderBy("bin")
    before = F.when(F.lag("bin").over(order) == F.col("bin") - 1, F.lag(of).over(order)).otherwise(0)
    after = F.when(F.lead("bin").over(order) == F.col("bin") + 1, F.lead(of).over(order)).otherwise(0)
    return bins.withColumns({"_before": before, "_after": after}).where((F.col("_before") <= F.col(of)) & (F.col("_after") < F.col(of))).drop("_before", "_after")


def dense_bins(bins: DataFrame, low: int, high: int) -> DataFrame:
    """One row for each bin from ``low`` to ``high``, empty ones included."""
    every = bins.sparkSession.range(low, high + 1).select(F.col("id").alias("bin"))
    return every.join(bins, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def weighted_peaks(bins: DataFrame, reach: int, least: float, by: tuple[str, ...] = ()) -> DataFrame:
    """1-2-1 smoothing of dense bins, then the bins that are highest within ``reach``, the lower of equals."""
    order = Window.partitionBy(*by).orderBy("bin")
    near = lambda f: F.coalesce(f("n").over(order), F.lit(0))
    smooth = bins.withColumn("s", (near(F.lag) + 2 * F.col("n") + near(F.lead)) / 4.0)
    best = F.max(F.struct(F.col("s"), -F.col("bin"))).over(order.rowsBetween(-reach, reach))
    return smooth.withColumn("_best", best).where((F.col("s") >= least) & (-F.col("_best").getField("col2") == F.col("bin"))).drop("_best")


# -- order statistics ----------------------------------------------------------------------------------------------


def order_statistics(rows: DataFrame, by: list[str], x: str, at: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each name the element of a group's sorted values at an index that follows from their number.

    Equal values are counted first, next to where they lie; running sums over the sorted counts, which spill, then say whose turn it is.
    """
    counts = rows.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_k"))
    order = Window.partitionBy(*by).orderBy(x)
    ranked = counts.withColumns({"_to": F.sum("_k").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_k").over(Window.partitionBy(*by))})
    hit = lambda i: (F.col("_to") - F.col("_k") <= i) & (i < F.col("_to"))
    return ranked.groupBy(*by).agg(*[F.max(F.when(hit(index(F.col("_n"))), F.col(x))).alias(name) for name, index in at.items()])


def index_percentile(p: float) -> Callable[[Column], Column]:
    """The index floor(p (n - 1)): one of the values, not an interpolation."""
    return lambda n: F.floor(F.lit(p) * (n - 1))


def upper_median(n: Column) -> Column:
    """The index n div 2."""
    return F.floor(n / 2)


# -- sequences -------------------------------------------------------------------------------------------------------


def step_lengths(rows: DataFrame, by: list[str], order: list[str], distance) -> DataFrame:
    """The sum of distances between consecutive rows; ``distance`` gets a function from a column's name to its value before."""
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_d", distance(lambda c: F.lag(c).over(window))).groupBy(*by).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"))


def crossings(rows: DataFrame, by: list[str], order: list[str], side: Column) -> DataFrame:
    """Rows at which the sign of ``side`` flips against the row before; zeros carry no sign and are passed over."""
    window = Window.partitionBy(*by).orderBy(*order)
    signed = rows.withColumn("_sign", F.signum(side)).where(F.col("_sign") != 0)
    return signed.withColumn("_last", F.lag("_sign").over(window)).where(F.col("_last") == -F.col("_sign")).drop("_sign", "_last")


RANGES = 256


def in_ranges(rows: DataFrame, at: str, parts: int = RANGES) -> DataFrame:
    """``rows`` with ``_range``, the number of the equal part of the whole span that ``at`` lies in, so that a long group is sorted in many tasks."""
    place = F.col(at).cast("timestamp").cast("double") if "date" in (kind := dict(rows.dtypes)[at]) or "timestamp" in kind else F.col(at).cast("double")
    span = rows.select(place.alias("p")).agg(F.min("p").alias("low"), F.max("p").alias("high")).first()
    width = (span["high"] - span["low"]) / parts if span["low"] is not None else 0.0
    number = F.least(F.floor((place - F.lit(span["low"])) / F.lit(width)), F.lit(parts - 1)).cast("int") if width > 0 else F.lit(0)
    return rows.withColumn("_range", number)


def carried(refs: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """For each group and range the last value of the ranges before (``_before``) and the first of those after (``_after``), from the ranges' extremes."""
    ends = refs.groupBy(*by, "_range").agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    order = Window.partitionBy(*by).orderBy("_range")
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each group and range at most
    return ends.select(*by, "_range", F.max("_high").over(back).alias("_before"), F.min("_low").over(ahead).alias("_after"))


def known(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def tagged(left: DataFrame, right: DataFrame, at: str, values: list[str], by: tuple[str, ...]) -> DataFrame:
    """Both sides under each other: the left rows, and for each right row its time and values as ``_r``; with their ranges and what these inherit."""
    picked = F.struct(F.col(at), *[F.col(c) for c in values])
    kind = right.select(picked.alias("p")).schema["p"].dataType
    columns = left.columns
    mine = left.select(*columns, F.lit(None).cast(kind).alias("_r"))
    refs = right.select(*[F.col(c) if c in (at, *by) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns], picked.alias("_r"))
    both = in_ranges(mine.unionByName(refs), at)
    # every group has every of its ranges here, so that those without right rows inherit too
    inherited = carried(both, "_r", by)
    return both.join(inherited, [*by, "_range"])


def forward_asof(left: DataFrame, right: DataFrame, at: str, values: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """For each left row the first right row at or after it, or the last of all where there is none after.

    Both sides are sorted together once, by group and range of time; what comes after a range is known from the ranges' first
    rows. Among right rows at one time the smallest values win. Left rows without a time or a group match nothing.
    """
    names = [f"r_{c}" for c in [at, *values]]
    placed = known(at, *by)
    both = tagged(left.where(placed), right.where(placed), at, values, by)
    here = Window.partitionBy(*by, "_range").orderBy(F.desc(at), F.col("_r").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = right.where(placed).groupBy(*by).agg(F.max(F.struct(F.col(at), *[F.col(c) for c in values])).alias("_last"))
    found = both.withColumn("_m", F.coalesce(F.min("_r").over(here), F.col("_after"))).where(F.col("_r").isNull())
    found = found.join(last, list(by), "left") if by else found.join(last, how="left")
    found = found.withColumn("_m", F.coalesce("_m", "_last"))
    matched = found.select(*left.columns, *[F.col(f"_m.{c}").alias(n) for c, n in zip([at, *values], names, strict=True)])
    return matched.union(left.where(~placed).select(*left.columns, *[F.lit(None).cast(matched.schema[n].dataType).alias(n) for n in names]))


def merged_intervals(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of a group as one."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col(start) <= reached, 0).otherwise(1))
    numbered = marked.withColumn("_id", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_id").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_id")


def intervals_without(spans: DataFrame, cuts: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """What the cuts leave of each group's span: a sweep with the running maximum of ends."""
    inside = cuts.join(spans.select(*by, F.col(start).alias("_a"), F.col(end).alias("_b")), by)
    clipped = inside.select(*by, F.greatest(start, "_a").alias(start), F.least(end, "_b").alias(end)).where(F.col(start) < F.col(end))
    edges = clipped.unionByName(spans.select(*by, F.col(end).alias(start), F.col(end).alias(end)))
    order = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    swept = edges.withColumn("_reached", F.max(end).over(order)).join(spans.select(*by, F.col(start).alias("_a")), by)
    return swept.select(*by, F.coalesce(F.greatest("_reached", "_a"), "_a").alias("from"), F.col(start).alias("to")).where(F.col("from") < F.col("to"))


def interpolated(samples: DataFrame, knots: DataFrame, at: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Linear between knots, constant beyond them; samples and knots are sorted together, by group and range of time.

    Samples without a time or a group, or of a group without knots, have no value; of knots at one time any may count.
    """
    columns, placed = samples.columns, known(at, *by)
    both = tagged(samples.where(placed), knots.where(placed).select(*by, at, F.col(value).cast("double").alias("_v")), at, ["_v"], by)
    ranged = [*by, "_range"]
    upto = Window.partitionBy(*ranged).orderBy(F.col(at), F.col("_r").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*ranged).orderBy(F.desc(at), F.col("_r").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    ends = both.withColumns({"_a": F.coalesce(F.max("_r").over(upto), "_before"), "_b": F.coalesce(F.min("_r").over(after), "_after")}).where(F.col("_r").isNull())
    low, high = F.col("_a").getField(at), F.col("_b").getField(at)
    ratio = (F.col(at) - low) / F.nullif(high - low, F.lit(0.0))
    between = F.col("_a._v") + (F.col("_b._v") - F.col("_a._v")) * ratio
    result = F.when(F.col("_a").isNull(), F.col("_b._v")).when(F.col("_b").isNull() | (low == high), F.col("_a._v")).otherwise(between)
    return ends.select(*columns, result.alias(value)).union(samples.where(~placed).select(*columns, F.lit(None).cast("double").alias(value)))


# -- spatial joins -----------------------------------------------------------------------------------------------------


def range_join(points: DataFrame, boxes: DataFrame, x: str, y: str, box: tuple[str, str, str, str], size: float) -> DataFrame:
    """Points in boxes [x0, x1] x [y0, y1]: boxes are filed under the cells that they touch, then an equi-join and the exact test."""
    x0, x1, y0, y1 = box
    cells = lambda a, b: F.explode(F.sequence(cell(F.col(a), size), cell(F.col(b), size)))
    filed = boxes.where((F.col(x0) <= F.col(x1)) & (F.col(y0) <= F.col(y1))).withColumn("_cx", cells(x0, x1)).withColumn("_cy", cells(y0, y1))
    placed = points.withColumns({"_cx": cell(F.col(x), size), "_cy": cell(F.col(y), size)})
    return placed.join(filed, ["_cx", "_cy"]).where(F.col(x).between(F.col(x0), F.col(x1)) & F.col(y).between(F.col(y0), F.col(y1))).drop("_cx", "_cy")


def nearest(points: DataFrame, sites: DataFrame, key: list[str], x: str, site: str, at: str, most: float, by: tuple[str, ...] = ()) -> DataFrame:
    """For each point the site at the smallest distance under ``most``, the lowest of equals; sites filed by cell of that size."""
    filed = sites.select(*by, F.col(site), F.col(at), F.explode(F.sequence(cell(F.col(at), most) - 1, cell(F.col(at), most) + 1)).alias("_c"))
    placed = points.withColumn("_c", cell(F.col(x), most))
    found = placed.join(filed, [*by, "_c"]).withColumn("distance", F.abs(F.col(x) - F.col(at))).where(F.col("distance") < most)
    return found.groupBy(*key).agg(F.min(F.struct("distance", site)).alias("_m")).select(*key, F.col(f"_m.{site}").alias(site), F.col("_m.distance").alias("distance"))


def in_polygons(points: DataFrame, edges: DataFrame, key: list[str], x: str, y: str, size: float = 5.0) -> DataFrame:
    """Even-odd rule with ``edges(polygon, x0, y0, x1, y1)``: a row for each point and polygon around it.

    Polygons are filed under the cells of ``size`` that their boxes touch, so a point meets the edges of those near it only.
    """
    box = edges.groupBy("polygon").agg(*[f(g(a, b)).alias(n) for n, f, g, a, b in (("_x0", F.min, F.least, "x0", "x1"), ("_x1", F.max, F.greatest, "x0", "x1"), ("_y0", F.min, F.least, "y0", "y1"), ("_y1", F.max, F.greatest, "y0", "y1"))])
    own = list(dict.fromkeys([*key, x, y]))
    near = range_join(points.select(*own), box, x, y, ("_x0", "_x1", "_y0", "_y1"), size).select(*own, "polygon")
    straddles = (F.col("y0") > F.col(y)) != (F.col("y1") > F.col(y))
    cut = (F.col("x1") - F.col("x0")) * (F.col(y) - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")
    hit = near.join(edges.where("y0 <> y1"), "polygon").where(straddles & (F.col(x) < cut))
    return hit.groupBy(*key, "polygon").agg(F.count("*").alias("_n")).where("_n % 2 = 1").drop("_n")


def polygon_edges(corners: DataFrame, by: list[str], i: str, x: str, y: str) -> DataFrame:
    """Each corner with the next one; the last with the first."""
    order = Window.partitionBy(*by).orderBy(i)
    first = lambda c: F.first(c).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return corners.select(*by, F.col(i), F.col(x).alias("x0"), F.col(y).alias("y0"), F.coalesce(F.lead(x).over(order), first(x)).alias("x1"), F.coalesce(F.lead(y).over(order), first(y)).alias("y1"))


def polygon_areas(edges: DataFrame, by: list[str]) -> DataFrame:
    """Signed area (positive counter-clockwise) and centroid; a polygon without area has its first corner as the centroid."""
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    sums = edges.groupBy(*by).agg(F.sum(cross).alias("c"), F.sum((F.col("x0") + F.col("x1")) * cross).alias("sx"), F.sum((F.col("y0") + F.col("y1")) * cross).alias("sy"), F.min(F.struct("i", "x0", "y0")).alias("f"))
    at = lambda s, f: F.when(F.col("c") == 0, F.col(f"f.{f}")).otherwise(F.col(s) / (3 * F.col("c")))
    return sums.select(*by, (F.col("c") / 2).alias("area"), at("sx", "x0").alias("cx"), at("sy", "y0").alias("cy"))


def set_iou(a: DataFrame, b: DataFrame, key: list[str], cell_: list[str]) -> DataFrame:
    """Intersection over union of the cell sets of each pair of groups that share a cell."""
    one = a.select(*[F.col(k).alias(f"a_{k}") for k in key], *cell_).distinct()
    two = b.select(*[F.col(k).alias(f"b_{k}") for k in key], *cell_).distinct()
    left, right = [f"a_{k}" for k in key], [f"b_{k}" for k in key]
    both = one.join(two, cell_).groupBy(*left, *right).agg(F.count("*").alias("both"))
    sizes = both.join(one.groupBy(*left).agg(F.count("*").alias("na")), left).join(two.groupBy(*right).agg(F.count("*").alias("nb")), right)
    return sizes.withColumn("iou", F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))


# -- fits and calibration ----------------------------------------------------------------------------------------------


def plane_fit(points: DataFrame, x: str, z: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """y = A x + B z + C by least squares from sums about the mean, solved in closed form."""
    m = points.groupBy(*by).agg(*[F.avg(c).alias(f"_{n}") for n, c in (("mx", x), ("mz", z), ("my", y))])
    joined = points.join(F.broadcast(m), list(by)) if by else points.crossJoin(F.broadcast(m))
    dx, dz, dy = F.col(x) - F.col("_mx"), F.col(z) - F.col("_mz"), F.col(y) - F.col("_my")
    s = joined.groupBy(*by, "_mx", "_mz", "_my").agg(F.count("*").alias("n"), *[F.sum(e).alias(n) for n, e in (("xx", dx * dx), ("xz", dx * dz), ("zz", dz * dz), ("xy", dx * dy), ("zy", dz * dy))])
    det = F.nullif(F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz"), F.lit(0.0))
    a = (F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / det
    b = (F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / det
    return s.withColumns({"a": a, "b": b}).select(*by, "a", "b", (F.col("_my") - F.col("a") * F.col("_mx") - F.col("b") * F.col("_mz")).alias("c"), "n")


def yaw_fit(pairs: DataFrame, ax: str, ay: str, bx: str, by_: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The rotation and shift that take points a to points b best, from sums alone."""
    s = pairs.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{n}") for n, c in (("ax", ax), ("ay", ay), ("bx", bx), ("by", by_))], F.sum(F.col(ax) * F.col(bx) + F.col(ay) * F.col(by_)).alias("d"), F.sum(F.col(ax) * F.col(by_) - F.col(ay) * F.col(bx)).alias("e"))
    cos_part = F.col("d") - F.col("n") * (F.col("m_ax") * F.col("m_bx") + F.col("m_ay") * F.col("m_by"))
    sin_part = F.col("e") - F.col("n") * (F.col("m_ax") * F.col("m_by") - F.col("m_ay") * F.col("m_bx"))
    yaw = F.atan2(sin_part, cos_part)
    return s.withColumn("yaw", yaw).select(*by, "yaw", (F.col("m_bx") - (F.cos("yaw") * F.col("m_ax") - F.sin("yaw") * F.col("m_ay"))).alias("dx"), (F.col("m_by") - (F.sin("yaw") * F.col("m_ax") + F.cos("yaw") * F.col("m_ay"))).alias("dy"))


Z90 = 1.6449


def needed_tau(difference: Column, sigma_a: Column, sigma_b: Column) -> Column:
    """The extra spread that a pair's difference asks for beyond what its sigmas say."""
    rest = F.pow(difference / Z90, F.lit(2.0)) - sigma_a * sigma_a - sigma_b * sigma_b
    return F.sqrt(F.greatest(rest, F.lit(0.0)) / 2.0)


def conformal_tau(pairs: DataFrame, need: str, level: float = 0.9, by: tuple[str, ...] = ()) -> DataFrame:
    """The conformal quantile of the needs, and its leave-one-out coverage.

    Without pair i the quantile is the order statistic of rank ceil(level (n - 1)) of the others: the next one in the whole
    order if i's own rank is at most that. So one sorted pass does for all i.
    """
    order = Window.partitionBy(*by).orderBy(need)
    every = Window.partitionBy(*by)
    ranked = pairs.withColumns({"_rank": F.row_number().over(order), "_n": F.count("*").over(every)})
    k = F.ceil(F.lit(level) * F.col("_n"))
    without = F.ceil(F.lit(level) * (F.col("_n") - 1))
    marked = ranked.withColumns({"_tau": F.max(F.when(F.col("_rank") == k, F.col(need))).over(every), "_at": F.max(F.when(F.col("_rank") == without, F.col(need))).over(every), "_next": F.max(F.when(F.col("_rank") == without + 1, F.col(need))).over(every), "_without": without})
    quantile = F.when(F.col("_rank") <= F.col("_without"), F.col("_next")).otherwise(F.col("_at"))
    covered = F.coalesce((F.col(need) <= quantile).cast("int"), F.lit(0))
    return marked.groupBy(*by).agg(F.max("_tau").alias("tau"), F.count("*").alias("pairs"), F.avg(covered.cast("double")).alias("loo_coverage"))
