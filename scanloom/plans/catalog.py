"""The queries over the driver's tables, by name, and the SQL that each must equal.

Each query applies a capture operator of ``operators`` to a whole table that has the shape it needs: line items stand for points,
suppliers for frames, users for trajectories, and so on.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graph, reconstruction
from ..operators import relational as R

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


# -- voxels and rasters ------------------------------------------------------------------------------------------

POINTS = "SELECT l_suppkey AS frame, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem"
VOXELS = f"""
WITH p AS ({POINTS}), v AS (
  SELECT ((floor(x / 5)::BIGINT + 1048576) << 42) | ((floor(y / 5)::BIGINT + 1048576) << 21) | (floor(z / 5)::BIGINT + 1048576) AS voxel,
         frame, round(x * 1000000)::BIGINT AS ux, round(y * 1000000)::BIGINT AS uy, round(z * 1000000)::BIGINT AS uz FROM p
)
SELECT voxel, count(*)::BIGINT AS n_points, count(DISTINCT frame)::BIGINT AS n_frames,
       round(sum(ux)::DOUBLE / count(*) / 1000000, 6) AS x, round(sum(uy)::DOUBLE / count(*) / 1000000, 6) AS y, round(sum(uz)::DOUBLE / count(*) / 1000000, 6) AS z
FROM v GROUP BY voxel HAVING count(DISTINCT frame) >= 2
"""


def points(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("frame"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


@query(VOXELS)
def voxel_fusion(spark, sf_dir):
    return R.fuse_voxels(R.frame_voxels(points(spark, sf_dir), "frame", ("x", "y", "z"), 5.0))


@query(f"""
WITH p AS ({POINTS})
SELECT frame, ((floor(x / 5)::BIGINT + 1048576) << 42) | ((floor(y / 5)::BIGINT + 1048576) << 21) | (floor(z / 5)::BIGINT + 1048576) AS voxel,
       count(*)::BIGINT AS n, sum(round(x * 1000000)::BIGINT)::BIGINT AS sx, sum(round(y * 1000000)::BIGINT)::BIGINT AS sy, sum(round(z * 1000000)::BIGINT)::BIGINT AS sz
FROM p GROUP BY ALL
""")
def frame_partial(spark, sf_dir):
    return R.frame_voxels(points(spark, sf_dir), "frame", ("x", "y", "z"), 5.0)


@query(f"""
WITH p AS ({POINTS}), k AS (SELECT DISTINCT floor(x / 5)::BIGINT AS ix, floor(y / 5)::BIGINT AS iy, -floor(z / 5)::BIGINT AS iz FROM p)
SELECT ((ix + 1048576) << 42) | ((iy + 1048576) << 21) | (iz + 1048576) AS voxel, ix, iy, iz FROM k
""")
def voxel_key_round_trip(spark, sf_dir):
    p = points(spark, sf_dir)
    key = p.select(R.pack_key(R.cell(F.col("x"), 5.0), R.cell(F.col("y"), 5.0), -R.cell(F.col("z"), 5.0)).alias("voxel")).distinct()
    x, y, z = R.unpack_key(F.col("voxel"))
    return key.select("voxel", x.alias("ix"), y.alias("iy"), z.alias("iz"))


@query("""
SELECT l_orderkey, l_linenumber, round((l_quantity - 25) * l_discount / 50, 6) AS x, round((l_tax - 0.04) * l_discount / 50, 6) AS y, round(l_discount, 6) AS z
FROM lineitem WHERE l_linenumber >= 2 AND l_discount BETWEEN 0.02 AND 0.08
""")
def backproject_filter(spark, sf_dir):
    """Depth is the discount, confidence the line number, and the pixel quantity and tax."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    seen = l.where(G.valid_depth(F.col("l_discount"), F.col("l_linenumber"), 0.02, 0.08, 2))
    x, y, z = G.back_project(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), F.lit(50.0), F.lit(50.0), F.lit(25.0), F.lit(0.04))
    return seen.select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


@query("SELECT event_id, user_id, value FROM events WHERE event_id % 5 = 0")
def stride_sample(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_id") % 5 == 0).select("event_id", "user_id", "value")


@query("""
SELECT l_orderkey, l_linenumber, round(cos(0.3::DOUBLE) * l_quantity - sin(0.3::DOUBLE) * l_tax, 6) AS px, round(-sin(0.3::DOUBLE) * l_quantity - cos(0.3::DOUBLE) * l_tax, 6) AS py,
       round(l_discount - (0.004::DOUBLE * l_quantity - 0.002::DOUBLE * l_tax - 1.45::DOUBLE), 6) AS height FROM lineitem
""")
def plan_frame_transform(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    px, py = G.to_plan(F.col("l_quantity"), F.col("l_tax"), 0.3)
    height = G.floor_height(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), 0.004, -0.002, -1.45)
    return l.select("l_orderkey", "l_linenumber", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"), F.round(height, 6).alias("height"))


@query("""
WITH p AS (SELECT l_suppkey, l_linenumber, l_quantity / 16 AS h FROM lineitem), c AS (
  SELECT l_suppkey, l_linenumber, count(*) FILTER (WHERE abs(h) < 0.1)::BIGINT AS floor,
         coalesce(bit_or(CASE WHEN abs(h) >= 0.1 AND h > 0 AND floor(h / 0.05) < 62 THEN (1::BIGINT << floor(h / 0.05)::INT) END), 0)::BIGINT AS heights
  FROM p GROUP BY ALL
)
SELECT l_suppkey, l_linenumber, floor, heights, bit_count(heights & 1099511627744)::BIGINT AS wall_bins,
       bit_count(heights & 1099511627744) / 35.0::DOUBLE >= 0.2 AS wall FROM c
""")
def height_bitmap(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", (F.col("l_quantity") / 16).alias("h"))
    cells = R.height_raster(rows, ["l_suppkey", "l_linenumber"], F.col("h"), 0.1, 0.05, 62)
    return cells.select("*", F.bit_count(F.col("heights").bitwiseAND(F.lit(G.WALL_MASK))).cast("long").alias("wall_bins"), (R.band_share(F.col("heights"), G.WALL_MASK) >= 0.2).alias("wall"))


# -- histograms ----------------------------------------------------------------------------------------------------


@query("""
WITH b AS (SELECT event_type, floor(value / 2)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT event_type, bin, sum(n) OVER (PARTITION BY event_type ORDER BY bin RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS s FROM b)
SELECT event_type, bin, s FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY s DESC, bin) AS r FROM s) WHERE r = 1
""")
def histogram_peak(spark, sf_dir):
    bins = R.histogram(table(spark, sf_dir, "events"), F.col("value"), 2.0, ("event_type",))
    return R.peak(R.smoothed(bins, 1, ("event_type",)), ("event_type",))


@query("""
WITH m AS (SELECT l_linenumber, avg(l_quantity) mx, avg(l_discount) mz, avg(l_extendedprice) my FROM lineitem GROUP BY 1), s AS (
  SELECT l_linenumber, mx, mz, my, count(*) n, sum((l_quantity-mx)*(l_quantity-mx)) xx, sum((l_quantity-mx)*(l_discount-mz)) xz, sum((l_discount-mz)*(l_discount-mz)) zz,
         sum((l_quantity-mx)*(l_extendedprice-my)) xy, sum((l_discount-mz)*(l_extendedprice-my)) zy
  FROM lineitem JOIN m USING (l_linenumber) GROUP BY ALL
), f AS (SELECT *, (xy*zz - zy*xz)/(xx*zz - xz*xz) a, (zy*xx - xy*xz)/(xx*zz - xz*xz) b FROM s)
SELECT l_linenumber, round(a, 3) AS a, round(b, 2) AS b, round(my - a*mx - b*mz, 2) AS c, n::BIGINT AS n FROM f
""")
def plane_fit(spark, sf_dir):
    f = R.plane_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", ("l_linenumber",))
    return f.select("l_linenumber", F.round("a", 3).alias("a"), F.round("b", 2).alias("b"), F.round("c", 2).alias("c"), "n")


@query("""
WITH a AS (SELECT floor(((atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE) / (pi() / 2)) - floor(atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE) / (pi() / 2))) * 90)::BIGINT AS bin FROM embeddings),
h AS (SELECT bin, count(*) AS n FROM a GROUP BY bin), w AS (SELECT bin + 90 * k AS bin, n FROM h, (VALUES (-1), (0), (1)) v(k)),
s AS (SELECT bin, n, sum(n) OVER (ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM w)
SELECT bin, n::BIGINT AS n, s::BIGINT AS s FROM s WHERE bin BETWEEN 0 AND 89
""")
def angle_histogram_circular(spark, sf_dir):
    angle = F.atan2(F.col("embedding")[1].cast("double"), F.col("embedding")[0].cast("double")) / F.lit(math.pi / 2)
    bins = R.histogram(table(spark, sf_dir, "embeddings"), (angle - F.floor(angle)) * 90, 1.0)
    return R.smoothed_circular(bins, 90, 2).select("bin", "n", "s")


@query("""
WITH c AS (SELECT range AS k FROM range(-20, 21)), b AS (
  SELECT k, floor((l_quantity * cos(k * 0.01::DOUBLE) + l_discount * 100 * sin(k * 0.01::DOUBLE)) / 0.5)::BIGINT AS bin, count(*) AS n FROM lineitem, c GROUP BY ALL
), s AS (SELECT k, sum(n * n) AS s FROM b GROUP BY k)
SELECT k::BIGINT AS k, s::BIGINT AS s FROM (SELECT *, row_number() OVER (ORDER BY s DESC, k) r FROM s) WHERE r = 1
""")
def candidate_sharpness(spark, sf_dir):
    """The angle of a bounded list that makes the histogram sharpest; rows are first counted by distinct point."""
    distinct = table(spark, sf_dir, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count("*").alias("w"))
    tried = distinct.withColumn("k", F.explode(F.sequence(F.lit(-20), F.lit(20))))
    angle = F.col("k") * F.lit(0.01)
    bins = tried.groupBy("k", R.cell(F.col("l_quantity") * F.cos(angle) + F.col("l_discount") * 100 * F.sin(angle), 0.5).alias("bin")).agg(F.sum("w").alias("n"))
    return bins.groupBy("k").agg(F.sum(F.col("n") * F.col("n")).alias("s")).agg(F.max_by(F.struct("k", "s"), F.struct(F.col("s"), -F.col("k"))).alias("m")).select(F.col("m.k").cast("long").alias("k"), F.col("m.s").alias("s"))


@query("""
WITH b AS (SELECT o_orderpriority, floor(o_totalprice / 5000)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY ALL),
s AS (SELECT o_orderpriority, bin, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY bin RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM b),
p AS (SELECT o_orderpriority, bin FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY s DESC, bin) r FROM s) WHERE r = 1),
q AS (SELECT o.o_orderpriority, p.bin, o.o_totalprice AS v FROM orders o JOIN p USING (o_orderpriority) WHERE abs(o.o_totalprice - (p.bin + 0.5::DOUBLE) * 5000) <= 7500)
SELECT o_orderpriority, bin, round(avg(v), 3) AS mean, round(stddev_pop(v), 3) AS spread, count(*)::BIGINT AS support, count(DISTINCT floor(v / 100))::BIGINT AS covered FROM q GROUP BY ALL
""")
def face_layer_mean_std(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").alias("v"))
    top = R.peak(R.smoothed(R.histogram(rows, F.col("v"), 5000.0, ("o_orderpriority",)), 1, ("o_orderpriority",)), ("o_orderpriority",)).drop("s")
    near = rows.join(F.broadcast(top), "o_orderpriority").where(F.abs(F.col("v") - (F.col("bin") + 0.5) * 5000) <= 7500)
    return near.groupBy("o_orderpriority", "bin").agg(F.round(F.avg("v"), 3).alias("mean"), F.round(F.stddev_pop("v"), 3).alias("spread"), F.count("*").alias("support"), F.count_distinct(F.floor(F.col("v") / 100)).alias("covered"))


@query("""
WITH b AS (SELECT p_brand, floor(p_retailprice / 20)::BIGINT AS bin, count(*) AS n FROM part GROUP BY ALL),
s AS (SELECT p_brand, bin, n, sum(n) OVER (PARTITION BY p_brand ORDER BY bin RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS s FROM b),
l AS (SELECT *, CASE WHEN lag(bin) OVER w = bin - 1 THEN lag(s) OVER w ELSE 0 END AS before, CASE WHEN lead(bin) OVER w = bin + 1 THEN lead(s) OVER w ELSE 0 END AS after FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY bin)),
m AS (SELECT p_brand, max(s) AS most FROM s GROUP BY 1)
SELECT p_brand, bin, s FROM l JOIN m USING (p_brand) WHERE before <= s AND after < s AND s >= 0.1::DOUBLE * most
""")
def room_ceiling_levels(spark, sf_dir):
    bins = R.smoothed(R.histogram(table(spark, sf_dir, "part"), F.col("p_retailprice"), 20.0, ("p_brand",)), 1, ("p_brand",))
    high = R.local_maxima(bins, ("p_brand",)).withColumn("most", F.lit(0).cast("long"))
    most = bins.groupBy("p_brand").agg(F.max("s").alias("most"))
    return high.drop("most").join(most, "p_brand").where(F.col("s") >= 0.1 * F.col("most")).select("p_brand", "bin", "s")


@query("""
WITH d AS (SELECT range AS bin FROM range(1, 51)), h AS (SELECT d.bin, count(p.p_size)::BIGINT AS n FROM d LEFT JOIN part p ON p.p_size = d.bin GROUP BY d.bin),
s AS (SELECT bin, n, (coalesce(lag(n) OVER (ORDER BY bin), 0) + 2 * n + coalesce(lead(n) OVER (ORDER BY bin), 0)) / 4.0::DOUBLE AS s FROM h),
m AS (SELECT *, max(s) OVER (ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top, max(s) OVER (ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS earlier FROM s)
SELECT bin::BIGINT AS bin, n, s FROM m WHERE s = top AND (earlier IS NULL OR earlier < s)
""")
def line_peaks_nms(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return R.weighted_peaks(R.dense_bins(counts, 1, 50), 3, 0.0).select("bin", "n", "s")


@query("""
WITH c AS (SELECT l_returnflag, l_linestatus, (l_suppkey % 5)::BIGINT AS label, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, label, n::BIGINT AS n, total::BIGINT AS total FROM (
  SELECT *, sum(n) OVER (PARTITION BY l_returnflag, l_linestatus) AS total, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY n DESC, label) r FROM c
) WHERE r = 1 AND n >= 0.2::DOUBLE * total
""")
def rect_owner_argmax(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 5).alias("label"))
    return R.owner(rows, ["l_returnflag", "l_linestatus"], "label", 0.2)


@query("""
SELECT user_id, (floor(value / 10)::BIGINT + i)::BIGINT AS cell, least(count(*), 40)::BIGINT AS rays
FROM (SELECT user_id, value, unnest(range(0, 1 + event_id % 4)) AS i FROM events) GROUP BY ALL
""")
def saturating_ray_count(spark, sf_dir):
    rays = table(spark, sf_dir, "events").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 4)))
    return R.saturating_count(rays.select("user_id", (R.cell(F.col("value"), 10.0) + F.col("i")).alias("cell")), ["user_id", "cell"], most=40)


@query("""
WITH e AS (SELECT user_id % 20 AS landmark, floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 86400000000.0::DOUBLE)::BIGINT AS chunk, round(value * 1000000)::BIGINT AS um FROM events),
o AS (SELECT landmark, chunk, count(*) AS n, sum(um) AS s_um FROM e GROUP BY ALL HAVING count(*) >= 12)
SELECT landmark, chunk, n::BIGINT AS n, s_um::BIGINT AS s_um FROM o QUALIFY count(*) OVER (PARTITION BY landmark) >= 2
""")
def drift_chunk_obs(spark, sf_dir):
    return drift_observations(table(spark, sf_dir, "events"))


def drift_observations(events: DataFrame) -> DataFrame:
    first = events.agg(F.min(seconds("ts")).alias("t0"))
    rows = events.crossJoin(F.broadcast(first)).select((F.col("user_id") % 20).alias("landmark"), R.cell((seconds("ts") - F.col("t0")) / 1e6, 86400.0).alias("chunk"), R.micro(F.col("value")).alias("um"))
    seen = rows.groupBy("landmark", "chunk").agg(F.count("*").alias("n"), F.sum("um").alias("s_um")).where("n >= 12")
    return seen.withColumn("chunks", F.count("*").over(Window.partitionBy("landmark"))).where("chunks >= 2").drop("chunks")


@query("""
WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1)
SELECT e.event_type, round(sqrt(sum((1 + e.user_id % 3) * (e.value - m.m) * (e.value - m.m)) / sum(1 + e.user_id % 3)), 5) AS rms FROM events e JOIN m USING (event_type) GROUP BY 1
""")
def weighted_rms_scatter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    joined = events.join(F.broadcast(events.groupBy("event_type").agg(F.avg("value").alias("m"))), "event_type")
    return joined.groupBy("event_type").agg(F.round(G.weighted_rms(F.col("value") - F.col("m"), 1 + F.col("user_id") % 3), 5).alias("rms"))


# -- order statistics and sequences ----------------------------------------------------------------------------------


@query("""
SELECT event_type, list_sort(list(value))[1 + floor(0.3::DOUBLE * (count(*) - 1))::INT] AS p30, list_sort(list(value))[1 + (count(*) // 2)::INT] AS upper_median FROM events GROUP BY 1
""")
def index_percentile(spark, sf_dir):
    return R.order_statistics(table(spark, sf_dir, "events"), ["event_type"], "value", {"p30": R.index_percentile(0.3), "upper_median": R.upper_median})


@query("""
SELECT user_id, list_sort(list(value))[1 + floor(0.1::DOUBLE * (count(*) - 1))::INT] AS low, list_sort(list(value))[1 + floor(0.9::DOUBLE * (count(*) - 1))::INT] AS high FROM events GROUP BY 1
""")
def extent_10_90(spark, sf_dir):
    return R.order_statistics(table(spark, sf_dir, "events"), ["user_id"], "value", {"low": R.index_percentile(0.1), "high": R.index_percentile(0.9)})


@query("""
SELECT user_id, round(coalesce(sum(d), 0), 4) AS length FROM (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events) GROUP BY 1
""")
def path_length(spark, sf_dir):
    found = R.step_lengths(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], lambda before: F.abs(F.col("value") - before("value")))
    return found.select("user_id", F.round("length", 4).alias("length"))


@query("""
WITH c AS (SELECT DISTINCT user_id % 10 AS y, floor(value)::BIGINT AS x FROM events), i AS (SELECT y, x, x - row_number() OVER (PARTITION BY y ORDER BY x) AS g FROM c)
SELECT y, x, count(*) OVER (PARTITION BY y, g)::BIGINT AS run FROM i
""")
def run_lengths(spark, sf_dir):
    cells = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("y"), R.cell(F.col("value"), 1.0).alias("x")).distinct()
    return R.line_cells(cells, "y", "x")


@query("""
SELECT * FROM (SELECT user_id, value AS x, lead(value) OVER (PARTITION BY user_id ORDER BY value) AS "to", lead(value) OVER (PARTITION BY user_id ORDER BY value) - value AS gap FROM events) WHERE gap BETWEEN 5 AND 20
""")
def gap_detect(spark, sf_dir):
    return R.gaps_between(table(spark, sf_dir, "events").select("user_id", F.col("value").alias("x")), ["user_id"], "x", 5.0, 20.0)


@query("""
WITH s AS (SELECT event_id, user_id, ts, sign(value - 50) AS s FROM events WHERE value <> 50)
SELECT user_id, event_id FROM s QUALIFY lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) = -s
""")
def trajectory_crossing(spark, sf_dir):
    return R.crossings(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") - 50).select("user_id", "event_id")


@query("""
WITH k AS (SELECT event_type, (epoch_us(ts) // 86400000000)::BIGINT * 86400 AS t, sum(round(value * 10000)::BIGINT)::DOUBLE / count(*) / 10000 AS v FROM events GROUP BY ALL),
s AS (SELECT event_id, event_type, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events),
a AS (SELECT s.*, k.t AS t0, k.v AS v0 FROM s ASOF LEFT JOIN k ON s.event_type = k.event_type AND s.t >= k.t),
b AS (SELECT a.*, k.t AS t1, k.v AS v1 FROM a ASOF LEFT JOIN k ON a.event_type = k.event_type AND a.t <= k.t)
SELECT event_id, floor(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) END * 10000 + 0.5::DOUBLE) / 10000 AS v FROM b
""")
def time_interpolation(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    knots = events.groupBy("event_type", (R.cell(seconds("ts"), 86400e6) * 86400).cast("double").alias("t")).agg((F.sum(F.round(F.col("value") * 10000).cast("long")) / F.count("*") / 10000).alias("v"))
    samples = events.select("event_id", "event_type", (seconds("ts") / 1e6).alias("t"))
    return R.interpolated(samples, knots, "t", "v", ("event_type",)).select("event_id", (F.floor(F.col("v") * 10000 + 0.5) / 10000).alias("v"))


@query("""
WITH r AS (SELECT o_custkey % 7 AS k, o_orderdate AS t, min(o_orderkey) AS id FROM orders GROUP BY ALL),
l AS (SELECT o_orderkey, o_custkey % 7 AS k, o_orderdate + INTERVAL 36 HOUR AS t FROM orders),
f AS (SELECT l.o_orderkey, l.k, r.t AS rt, r.id FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t <= r.t),
z AS (SELECT k, max(t) AS t, arg_max(id, t) AS id FROM r GROUP BY k)
SELECT f.o_orderkey, coalesce(f.rt, z.t) AS r_t, coalesce(f.id, z.id) AS r_id FROM f JOIN z USING (k)
""")
def asof_forward(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    keyed = orders.withColumn("k", F.col("o_custkey") % 7)
    refs = keyed.groupBy("k", F.col("o_orderdate").alias("t")).agg(F.min("o_orderkey").alias("id"))
    left = keyed.select("o_orderkey", "k", F.expr("o_orderdate + INTERVAL 36 HOURS").alias("t"))
    return R.forward_asof(left, refs, "t", ["id"], ("k",)).select("o_orderkey", "r_t", "r_id")


@query("""
WITH i AS (SELECT user_id, value AS a, value + 1 + event_id % 3 AS b FROM events),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS id FROM m)
SELECT user_id, min(a) AS a, max(b) AS b, count(*)::BIGINT AS n FROM g GROUP BY user_id, id
""")
def session_merge(spark, sf_dir):
    spans = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("a"), (F.col("value") + 1 + F.col("event_id") % 3).alias("b"))
    return R.merged_intervals(spans, ["user_id"], "a", "b")


@query("""
WITH c AS (SELECT user_id, greatest(value, 0) AS a, least(value + 0.5::DOUBLE, 100) AS b FROM events WHERE greatest(value, 0) < least(value + 0.5::DOUBLE, 100)),
e AS (SELECT * FROM c UNION ALL SELECT DISTINCT user_id, 100.0::DOUBLE, 100.0::DOUBLE FROM events),
s AS (SELECT user_id, a, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM e)
SELECT user_id, coalesce(reached, 0) AS "from", a AS "to" FROM s WHERE coalesce(reached, 0) < a
""")
def interval_subtract(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    spans = events.select("user_id").distinct().select("user_id", F.lit(0.0).alias("a"), F.lit(100.0).alias("b"))
    return R.intervals_without(spans, events.select("user_id", F.col("value").alias("a"), (F.col("value") + 0.5).alias("b")), ["user_id"], "a", "b")


# -- spatial joins -----------------------------------------------------------------------------------------------------

BOXES = "SELECT p_partkey AS box, p_size::DOUBLE AS x0, p_size + 1.5::DOUBLE AS x1, (p_partkey % 10) / 100.0::DOUBLE AS y0, (p_partkey % 10) / 100.0::DOUBLE + 0.015 AS y1 FROM part"


@query(f"""
WITH b AS ({BOXES}) SELECT b.box, count(*)::BIGINT AS n, sum(round(l_quantity * 1000000)::BIGINT)::BIGINT AS s_um
FROM lineitem JOIN b ON l_quantity BETWEEN x0 AND x1 AND l_discount BETWEEN y0 AND y1 GROUP BY 1
""")
def cell_range_join(spark, sf_dir):
    """Points at one place and boxes of one shape are counted first; each meets the other once."""
    y0 = (F.col("p_partkey") % 10) / F.lit(100.0)
    boxes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("box"), F.col("p_size").cast("double").alias("x0"), (F.col("p_size") + 1.5).alias("x1"), y0.alias("y0"), (y0 + 0.015).alias("y1"))
    shapes = boxes.select("x0", "x1", "y0", "y1").distinct().withColumns({"cy0": F.col("y0") * 100 - 0.5, "cy1": F.col("y1") * 100 + 0.5})
    places = table(spark, sf_dir, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count("*").alias("n"), F.sum(R.micro(F.col("l_quantity"))).alias("s_um"))
    scaled = places.withColumn("d", F.col("l_discount") * 100)
    hit = R.range_join(scaled, shapes, "l_quantity", "d", ("x0", "x1", "cy0", "cy1"), 2.0).where(F.col("l_discount").between(F.col("y0"), F.col("y1")))
    found = hit.groupBy("x0", "x1", "y0", "y1").agg(F.sum("n").alias("n"), F.sum("s_um").alias("s_um"))
    return boxes.join(found, ["x0", "x1", "y0", "y1"]).select("box", "n", "s_um")


@query("""
WITH c AS (SELECT p.p_partkey, s.s_suppkey, abs(p.p_retailprice - s.s_acctbal) AS distance FROM part p JOIN supplier s ON abs(p.p_retailprice - s.s_acctbal) < 25)
SELECT p_partkey, s_suppkey, distance FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY distance, s_suppkey) = 1
""")
def nearest_wall(spark, sf_dir):
    return R.nearest(table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier"), ["p_partkey"], "p_retailprice", "s_suppkey", "s_acctbal", 25.0)


POLYGONS = {1: [(2.0, 0.0), (30.0, 0.0), (30.0, 5.0), (15.0, 5.0), (15.0, 9.0), (2.0, 9.0)], 2: [(20.0, 2.5), (45.0, 1.5), (40.0, 8.5)], 3: [(5.0, 5.0), (5.0, 5.0), (5.0, 5.0)]}
CORNERS = ", ".join(f"({p}, {i}, {x}::DOUBLE, {y}::DOUBLE)" for p, c in POLYGONS.items() for i, (x, y) in enumerate(c))
EDGES_SQL = f"""c(polygon, i, x, y) AS (VALUES {CORNERS}),
e AS (SELECT polygon, i, x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM c WINDOW w AS (PARTITION BY polygon ORDER BY i))"""


def polygon_table(spark: SparkSession) -> DataFrame:
    rows = [(p, i, x, y) for p, c in POLYGONS.items() for i, (x, y) in enumerate(c)]
    return R.polygon_edges(spark.createDataFrame(rows, "polygon int, i int, x double, y double"), ["polygon"], "i", "x", "y")


@query(f"""
WITH {EDGES_SQL}
SELECT l_orderkey, l_linenumber, polygon FROM lineitem JOIN e ON (y0 > l_discount * 100) <> (y1 > l_discount * 100) AND l_quantity < (x1 - x0) * (l_discount * 100 - y0) / (y1 - y0) + x0
GROUP BY ALL HAVING count(*) % 2 = 1
""")
def point_in_polygon(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return R.in_polygons(rows, polygon_table(spark), ["l_orderkey", "l_linenumber"], "x", "y")


@query(f"""
WITH {EDGES_SQL}, s AS (SELECT polygon, sum(x0*y1 - x1*y0) AS c, sum((x0+x1)*(x0*y1 - x1*y0)) AS sx, sum((y0+y1)*(x0*y1 - x1*y0)) AS sy, arg_min(x0, i) AS fx, arg_min(y0, i) AS fy FROM e GROUP BY 1)
SELECT polygon, round(c / 2, 6) AS area, round(CASE WHEN c = 0 THEN fx ELSE sx / (3 * c) END, 6) AS cx, round(CASE WHEN c = 0 THEN fy ELSE sy / (3 * c) END, 6) AS cy FROM s
""")
def polygon_area_centroid(spark, sf_dir):
    found = R.polygon_areas(polygon_table(spark), ["polygon"])
    return found.select("polygon", *[F.round(c, 6).alias(c) for c in ("area", "cx", "cy")])


@query("""
WITH c AS (SELECT floor(l_quantity / 5)::BIGINT AS x, floor(l_discount * 100)::BIGINT AS y, ((max(l_suppkey) + count(*)) % 4)::BIGINT AS label FROM lineitem GROUP BY 1, 2),
m AS (SELECT a.label AS p, b.label AS q FROM c a JOIN c b ON (a.x + 1 = b.x AND a.y = b.y) OR (a.x = b.x AND a.y + 1 = b.y) WHERE a.label <> b.label)
SELECT least(p, q) AS a, greatest(p, q) AS b, count(*)::BIGINT AS cells FROM m GROUP BY 1, 2
""")
def cell_adjacency(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy(R.cell(F.col("l_quantity"), 5.0).alias("x"), F.floor(F.col("l_discount") * 100).alias("y")).agg(((F.max("l_suppkey") + F.count("*")) % 4).alias("label"))
    return R.adjacent_labels(cells, "x", "y", "label")


IOU = """
WITH c AS (SELECT DISTINCT l_suppkey % 40 AS room, l_partkey % 50 AS cell, l_linenumber % 2 AS side FROM lineitem),
a AS (SELECT room AS a_room, cell FROM c WHERE side = 0), b AS (SELECT room AS b_room, cell FROM c WHERE side = 1),
j AS (SELECT a_room, b_room, count(*) AS "both" FROM a JOIN b USING (cell) GROUP BY ALL),
na AS (SELECT a_room, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT b_room, count(*) AS nb FROM b GROUP BY 1)
SELECT a_room, b_room, "both"::BIGINT AS "both", na::BIGINT AS na, nb::BIGINT AS nb, "both" / (na + nb - "both")::DOUBLE AS iou FROM j JOIN na USING (a_room) JOIN nb USING (b_room)
"""


def room_overlaps(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("room"), (F.col("l_partkey") % 50).alias("cell"), (F.col("l_linenumber") % 2).alias("side")).distinct()
    return R.set_iou(cells.where("side = 0"), cells.where("side = 1"), ["room"], ["cell"])


@query(IOU)
def iou_sets(spark, sf_dir):
    return room_overlaps(spark, sf_dir).select("a_room", "b_room", "both", "na", "nb", "iou")


@query(f"SELECT a_room, b_room, iou FROM ({IOU}) WHERE iou >= 0.3::DOUBLE")
def room_pair_candidates(spark, sf_dir):
    return room_overlaps(spark, sf_dir).where(F.col("iou") >= 0.3).select("a_room", "b_room", "iou")


@query()
def greedy_match(spark, sf_dir):
    """One-to-one by falling overlap; sequential by nature, so tests compare it with a plain loop."""
    from ..operators import matching

    return matching.greedy_pairs(room_overlaps(spark, sf_dir).withColumn("plan", F.lit(1)).where(F.col("iou") >= 0.3).select("plan", F.col("a_room").alias("a"), F.col("b_room").alias("b"), F.col("iou").alias("score")), ["plan"])


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def unmatched_rooms(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.join(table(spark, sf_dir, "orders").where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


@query("""
WITH c AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), s AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0)
SELECT 'union' AS op, k FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM c INTERSECT SELECT k FROM s)
UNION ALL SELECT 'except', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT 'all', k FROM (SELECT k FROM c UNION ALL SELECT k FROM s)
""")
def setops_union_intersect_except(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    said = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return said(c.union(s).distinct(), "union").union(said(c.intersect(s), "intersect")).union(said(c.subtract(s), "except")).union(said(c.union(s), "all"))


# -- damage, rules, calibration ----------------------------------------------------------------------------------------


@query("""
SELECT user_id, event_type, count(*)::BIGINT AS views, max(value) AS score FROM events WHERE value >= 20
GROUP BY ALL HAVING max(value) >= 35 AND count(DISTINCT date_trunc('day', ts)) >= 2
""")
def hysteresis_regions(spark, sf_dir):
    kept = table(spark, sf_dir, "events").where("value >= 20")
    seen = kept.groupBy("user_id", "event_type").agg(F.count("*").alias("views"), F.max("value").alias("score"), F.count_distinct(F.date_trunc("day", "ts")).alias("days"))
    return seen.where("score >= 35 AND days >= 2").drop("days")


@query("""
WITH d AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS s FROM embeddings)
SELECT vec_id FROM d a WHERE label < 5 AND NOT EXISTS (SELECT 1 FROM d b WHERE b.label >= 5 AND abs(a.x - b.x) < 0.01::DOUBLE AND abs(a.y - b.y) < 0.01::DOUBLE AND b.s >= 0.8::DOUBLE * a.s)
""")
def distractor_antijoin(spark, sf_dir):
    """Theta anti-join through cells of the distance, so that it's an equi-join with a rest."""
    e = F.col("embedding")
    d = table(spark, sf_dir, "embeddings").select("vec_id", "label", e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), e[2].cast("double").alias("s"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    b = d.where("label >= 5").select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("s").alias("bs"), R.cell(F.col("x"), 0.01).alias("cx"), R.cell(F.col("y"), 0.01).alias("cy"))
    near = b.withColumn("cx", F.explode(F.transform(around, lambda k: k + F.col("cx")))).withColumn("cy", F.explode(F.transform(around, lambda k: k + F.col("cy"))))
    a = d.where("label < 5").withColumns({"cx": R.cell(F.col("x"), 0.01), "cy": R.cell(F.col("y"), 0.01)})
    hit = (F.abs(F.col("x") - F.col("bx")) < 0.01) & (F.abs(F.col("y") - F.col("by")) < 0.01) & (F.col("bs") >= 0.8 * F.col("s"))
    return a.join(near, (a["cx"] == near["cx"]) & (a["cy"] == near["cy"]) & hit, "left_anti").select("vec_id")


@query("""
SELECT d.doc_id, CASE WHEN l.toxic = 1 AND d.lang = 'en' THEN 'R-WET-CEIL-01' WHEN l.quality = 0 AND d.n_chars < 1000 THEN 'R-WALL-BASE-01'
  WHEN d.source = 'src1' AND EXISTS (SELECT 1 FROM benchmark b WHERE abs(d.doc_id % 50 - b.item_id % 50) < 3) THEN 'R-CRACK-DIAG-01' END AS rule
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def rules_case(spark, sf_dir):
    """The first rule that holds, one for each region; the theta condition goes through the distinct keys it can meet."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    near = table(spark, sf_dir, "benchmark").select(F.explode(F.sequence(F.col("item_id") % 50 - 2, F.col("item_id") % 50 + 2)).alias("k")).distinct().withColumn("near", F.lit(True))
    joined = d.withColumn("k", F.col("doc_id") % 50).join(F.broadcast(near), "k", "left")
    rule = F.when((F.col("toxic") == 1) & (F.col("lang") == "en"), "R-WET-CEIL-01").when((F.col("quality") == 0) & (F.col("n_chars") < 1000), "R-WALL-BASE-01").when((F.col("source") == "src1") & F.col("near"), "R-CRACK-DIAG-01")
    return joined.select("doc_id", rule.alias("rule"))


SCOPES = {"click": ("Replace finish", "m2"), "view": ("Seal crack", "m"), "purchase": ("Treat surface", "m2")}


@query("SELECT event_id, coalesce(action, 'Inspect') AS action, coalesce(unit, 'each') AS unit FROM events LEFT JOIN (VALUES ('click', 'Replace finish', 'm2'), ('view', 'Seal crack', 'm'), ('purchase', 'Treat surface', 'm2')) s(event_type, action, unit) USING (event_type)")
def scope_lookup(spark, sf_dir):
    dim = spark.createDataFrame([(k, *v) for k, v in SCOPES.items()], "event_type string, action string, unit string")
    return table(spark, sf_dir, "events").join(F.broadcast(dim), "event_type", "left").select("event_id", F.coalesce("action", F.lit("Inspect")).alias("action"), F.coalesce("unit", F.lit("each")).alias("unit"))


@query("""
WITH s AS (SELECT l_suppkey, avg(l_quantity) AS v, sqrt(var_pop(l_quantity) / count(*) + 0.005::DOUBLE * 0.005::DOUBLE) AS sigma FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(v, 3) AS value, round(v - 1.6449::DOUBLE * sigma, 3) AS low, round(v + 1.6449::DOUBLE * sigma, 3) AS high FROM s
""")
def interval_propagation(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("v"), G.face_sigma(F.stddev_pop("l_quantity"), F.count("*"), 0.005).alias("sigma"))
    low, high = G.interval(F.col("v"), F.col("sigma"))
    return s.select("l_suppkey", F.round("v", 3).alias("value"), F.round(low, 3).alias("low"), F.round(high, 3).alias("high"))


PAIRS = "SELECT o_orderpriority, o_orderkey, round(sqrt(greatest(((o_totalprice - 150000) / 10000 / 1.6449::DOUBLE) * ((o_totalprice - 150000) / 10000 / 1.6449::DOUBLE) - 0.5::DOUBLE, 0) / 2), 6) AS need FROM orders"


def need_pairs(spark, sf_dir):
    need = R.needed_tau((F.col("o_totalprice") - 150000) / 10000, F.lit(0.5), F.lit(0.5))
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.round(need, 6).alias("need"))


@query(f"""
WITH p AS ({PAIRS}), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY need) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM p)
SELECT o_orderpriority, max(need) FILTER (WHERE r = ceil(0.9::DOUBLE * n)) AS tau, max(n)::BIGINT AS pairs FROM r GROUP BY 1
""")
def conformal_tau(spark, sf_dir):
    return R.conformal_tau(need_pairs(spark, sf_dir), "need", 0.9, ("o_orderpriority",)).drop("loo_coverage")


@query(f"""
WITH p AS ({PAIRS}), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY need) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM p),
k AS (SELECT *, ceil(0.9::DOUBLE * (n - 1))::BIGINT AS k FROM r),
q AS (SELECT o_orderpriority, max(need) FILTER (WHERE r = k) AS own, max(need) FILTER (WHERE r = k + 1) AS next FROM k GROUP BY 1)
SELECT o_orderpriority, round(avg((need <= CASE WHEN r <= k THEN next ELSE own END)::INT::DOUBLE), 6) AS loo_coverage FROM k JOIN q USING (o_orderpriority) GROUP BY 1
""")
def loo_coverage(spark, sf_dir):
    """Without one pair the quantile is a neighbour in the whole order; a test compares it with leaving each out in turn."""
    found = R.conformal_tau(need_pairs(spark, sf_dir), "need", 0.9, ("o_orderpriority",))
    return found.select("o_orderpriority", F.round("loo_coverage", 6).alias("loo_coverage"))


@query("""
WITH d AS (SELECT o_orderstatus, (o_totalprice - 150000) / 1000 AS d, (o_totalprice - 150000) / 150000 AS rel FROM orders)
SELECT o_orderstatus, count(*)::BIGINT AS pairs, count(*) FILTER (WHERE abs(d) <= 10 OR abs(rel) <= 0.05::DOUBLE)::BIGINT AS passed, list_sort(list(abs(d)))[1 + (count(*) // 2)::INT] AS median FROM d GROUP BY 1
""")
def gate_summary(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderstatus", ((F.col("o_totalprice") - 150000) / 1000).alias("d"), ((F.col("o_totalprice") - 150000) / 150000).alias("rel"))
    median = R.order_statistics(d.select("o_orderstatus", F.abs("d").alias("d")), ["o_orderstatus"], "d", {"median": R.upper_median})
    return d.groupBy("o_orderstatus").agg(F.count("*").alias("pairs"), F.count_if((F.abs("d") <= 10) | (F.abs("rel") <= 0.05)).alias("passed")).join(median, "o_orderstatus")


# -- graphs ------------------------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey + 1 + c_nationkey % 2 AS b FROM customer WHERE (c_custkey * 7 + c_nationkey) % 13 <> 0),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, m) AS (SELECT a, a FROM both_ways UNION SELECT r.node, w.b FROM r JOIN both_ways w ON r.m = w.a)
SELECT node, min(m) AS component FROM r GROUP BY node HAVING count(*) > 1
""")
def label_components(spark, sf_dir):
    """Chains of customers, each linked with the next or the one after, cut here and there."""
    joint = (F.col("c_custkey") * 7 + F.col("c_nationkey")) % 13 != 0
    edges = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + F.when(joint, 1 + F.col("c_nationkey") % 2).otherwise(0)).alias("b"))
    found = graph.connected_components(edges)
    return found.union(found.select(F.col("component").alias("node"), "component")).distinct()


NATION_EDGES = "SELECT n_nationkey::BIGINT AS a, ((n_nationkey * 3 + 1) % 25)::BIGINT AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 10) % 25 FROM nation WHERE n_regionkey < 2"


@query(f"""
WITH RECURSIVE e AS ({NATION_EDGES}), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
g(node, distance) AS (SELECT 0::BIGINT, 0 UNION SELECT w.b, g.distance + 1 FROM g JOIN w ON g.node = w.a WHERE g.distance < 25)
SELECT node, 0::BIGINT AS label, min(distance)::INT AS distance FROM g GROUP BY node
""")
def grow_seeds_bfs(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("long")
    edges = n.select(k.alias("a"), ((k * 3 + 1) % 25).alias("b")).union(n.where("n_regionkey < 2").select(k, (k + 10) % 25))
    return graph.grow_from_seeds(edges, spark.createDataFrame([(0, 0)], "node long, label long")).select("node", "label", "distance")


@query()
def mst_links(spark, sf_dir):
    """Rooms are nations, weights the customers and suppliers that two of a region share; tests compare with a plain loop."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("w"))
    rooms = n.join(c, "n_nationkey")
    other = rooms.select(F.col("n_nationkey").alias("b"), "n_regionkey", F.col("w").alias("wb"))
    pairs = rooms.join(other, "n_regionkey").where("n_nationkey < b").select("n_regionkey", F.col("n_nationkey").alias("a"), "b", (F.col("w") * F.col("wb") % 97).alias("weight"))
    return graph.spanning_forest(pairs, ["n_regionkey"])


@query("""
WITH s AS (SELECT label, count(*) n, avg(embedding[1]::DOUBLE) ax, avg(embedding[2]::DOUBLE) ay, avg(embedding[3]::DOUBLE) bx, avg(embedding[4]::DOUBLE) by_,
  sum(embedding[1]::DOUBLE * embedding[3]::DOUBLE + embedding[2]::DOUBLE * embedding[4]::DOUBLE) d, sum(embedding[1]::DOUBLE * embedding[4]::DOUBLE - embedding[2]::DOUBLE * embedding[3]::DOUBLE) e FROM embeddings GROUP BY 1),
y AS (SELECT *, atan2(e - n * (ax * by_ - ay * bx), d - n * (ax * bx + ay * by_)) AS yaw FROM s)
SELECT label, round(yaw, 5) AS yaw, round(bx - (cos(yaw) * ax - sin(yaw) * ay), 5) AS dx, round(by_ - (sin(yaw) * ax + cos(yaw) * ay), 5) AS dy FROM y
""")
def yaw_fit(spark, sf_dir):
    e = F.col("embedding")
    pairs = table(spark, sf_dir, "embeddings").select("label", *[e[i].cast("double").alias(n) for i, n in enumerate(("ax", "ay", "bx", "by"))])
    return R.yaw_fit(pairs, "ax", "ay", "bx", "by", ("label",)).select("label", *[F.round(c, 5).alias(c) for c in ("yaw", "dx", "dy")])


# -- scalar geometry ---------------------------------------------------------------------------------------------------


@query("""
WITH q AS (SELECT vec_id, embedding[1]::DOUBLE a, embedding[2]::DOUBLE b, embedding[3]::DOUBLE c, embedding[4]::DOUBLE d FROM embeddings),
u AS (SELECT vec_id, a/n AS x, b/n AS y, c/n AS z, d/n AS w FROM (SELECT *, sqrt(a*a+b*b+c*c+d*d) AS n FROM q))
SELECT vec_id, round(1-2*(y*y+z*z), 6) AS r00, round(2*(x*y-z*w), 6) AS r01, round(2*(x*z+y*w), 6) AS r02, round(2*(x*y+z*w), 6) AS r10, round(1-2*(x*x+z*z), 6) AS r11,
       round(2*(y*z-x*w), 6) AS r12, round(2*(x*z-y*w), 6) AS r20, round(2*(y*z+x*w), 6) AS r21, round(1-2*(x*x+y*y), 6) AS r22 FROM u
""")
def quaternion_matrix(spark, sf_dir):
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    r = G.quaternion_matrix(*e)
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(r[3 * i + j], 6).alias(f"r{i}{j}") for i in range(3) for j in range(3)])


@query("""
SELECT p_partkey, round(p_retailprice * (256 / 1920.0::DOUBLE), 6) AS fx, round((p_size + 0.5::DOUBLE) * (256 / 1920.0::DOUBLE) - 0.5::DOUBLE, 6) AS cx FROM part
""")
def intrinsics_rescale(spark, sf_dir):
    fx, cx = G.rescaled(F.col("p_retailprice"), F.col("p_size"), 1920, 256)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(fx, 6).alias("fx"), F.round(cx, 6).alias("cx"))


@query("""
WITH l AS (SELECT vec_id, embedding[1]::DOUBLE a, embedding[2]::DOUBLE b, embedding[3]::DOUBLE c, embedding[4]::DOUBLE d, embedding[5]::DOUBLE e, embedding[6]::DOUBLE f FROM embeddings)
SELECT vec_id, CASE WHEN abs(a*d - b*c) >= 1e-9::DOUBLE THEN round((e*d - b*f) / (a*d - b*c), 4) END AS x, CASE WHEN abs(a*d - b*c) >= 1e-9::DOUBLE THEN round((a*f - e*c) / (a*d - b*c), 4) END AS y FROM l
""")
def line_intersections(spark, sf_dir):
    a, b, c, d, e, f = (F.col("embedding")[i].cast("double") for i in range(6))
    x, y = G.line_intersection(a, b, e, c, d, f)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("""
SELECT vec_id, round(x, 6) AS nx, round(y, 6) AS ny FROM (
  SELECT vec_id, CASE WHEN off THEN cos(t) ELSE cos(round_even(t / (pi()/2), 0) * (pi()/2)) END AS x, CASE WHEN off THEN sin(t) ELSE sin(round_even(t / (pi()/2), 0) * (pi()/2)) END AS y
  FROM (SELECT vec_id, t, abs(t - round_even(t / (pi()/2), 0) * (pi()/2)) > 15 * pi() / 180 AS off FROM (SELECT vec_id, atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE) AS t FROM embeddings)))
""")
def snapped_normals(spark, sf_dir):
    t = F.atan2(F.col("embedding")[1].cast("double"), F.col("embedding")[0].cast("double"))
    s = G.snapped_angle(t, 15.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.cos(s), 6).alias("nx"), F.round(F.sin(s), 6).alias("ny"))


@query("SELECT event_type, event_id // 2 AS pair, arg_max(event_id, value) AS kept FROM events GROUP BY ALL")
def best_of_pair(spark, sf_dir):
    """Of each two consecutive frames the sharper one, the first of equals; a frame without a value is never kept."""
    sharpness = F.when(F.col("value").isNotNull(), F.struct("value", F.bitwise_not("event_id")))
    return table(spark, sf_dir, "events").groupBy("event_type", F.expr("event_id div 2").alias("pair")).agg(F.max_by("event_id", sharpness).alias("kept"))


@query("""
SELECT user_id, max(value) FILTER (WHERE value < 50 AND value >= 20) AS left_jamb, min(value) FILTER (WHERE value >= 50 AND value <= 80) AS right_jamb FROM events GROUP BY 1
HAVING min(value) FILTER (WHERE value >= 50 AND value <= 80) - max(value) FILTER (WHERE value < 50 AND value >= 20) >= 4
""")
def jamb_search(spark, sf_dir):
    left, right = F.max(F.when(F.col("value").between(20, 50) & (F.col("value") < 50), F.col("value"))), F.min(F.when(F.col("value").between(50, 80), F.col("value")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(left.alias("left_jamb"), right.alias("right_jamb")).where("right_jamb - left_jamb >= 4")


@query("""
SELECT event_id, CASE WHEN value >= quantile_cont(value, 0.6) OVER (PARTITION BY user_id) THEN 2 WHEN value >= quantile_cont(value, 0.3) OVER (PARTITION BY user_id) THEN 1 ELSE 0 END::INT AS confidence FROM events
""")
def quantile_bands(spark, sf_dir):
    """Confidence bands by the quantiles of each frame, interpolated."""
    events = table(spark, sf_dir, "events")
    q = events.groupBy("user_id").agg(F.percentile("value", F.array(F.lit(0.3), F.lit(0.6))).alias("q"))
    band = F.when(F.col("value") >= F.col("q")[1], 2).when(F.col("value") >= F.col("q")[0], 1).otherwise(0)
    return events.join(q, "user_id").select("event_id", band.alias("confidence"))


@query("""
SELECT user_id, floor(value / 100 * 6)::BIGINT AS sector, max(event_id) AS event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, floor(value / 100 * 6) ORDER BY value DESC, event_id DESC) r FROM events) WHERE r = 1 GROUP BY ALL
""")
def best_per_sector(spark, sf_dir):
    sector = F.floor(F.col("value") / 100 * 6)
    return table(spark, sf_dir, "events").groupBy("user_id", sector.alias("sector")).agg(F.max_by("event_id", F.struct("value", "event_id")).alias("event_id"))


@query("""
SELECT label, rot FROM (SELECT label, rot, row_number() OVER (PARTITION BY label ORDER BY v DESC, rot) r FROM (
  SELECT label, rot, round(sum(ln(1 + abs(embedding[rot + 1]::DOUBLE))), 6) AS v FROM embeddings, (VALUES (0), (1), (2), (3)) t(rot) GROUP BY ALL)) WHERE r = 1
""")
def orientation_vote(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 4)).alias("rot", "v"))
    votes = rows.groupBy("label", "rot").agg(F.round(F.sum(F.log1p(F.abs(F.col("v").cast("double")))), 6).alias("v"))
    return votes.groupBy("label").agg(F.max_by("rot", F.struct(F.col("v"), -F.col("rot"))).alias("rot"))


# -- documents and files -------------------------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props))::INT AS n_keys FROM events")
def json_roundtrip(spark, sf_dir):
    parsed = F.from_json("props", "map<string,string>")
    again = F.from_json(F.to_json(parsed), "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.map_values(again)[0].alias("first_value"), F.size(again).alias("n_keys"))


@query("""
SELECT event_id, coalesce(CASE WHEN try_cast(raw AS DOUBLE) > 0 THEN try_cast(raw AS DOUBLE) END, 1600.0) AS fx FROM (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN (value - 50)::VARCHAR ELSE value::VARCHAR END AS raw FROM events)
""")
def csv_header_fallback(spark, sf_dir):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, "").when(k == 1, "n/a").when(k == 2, (F.col("value") - 50).cast("string")).otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", G.positive_or(raw, F.lit(1600.0)).alias("fx"))


@query("SELECT user_id, epoch_us(time_bucket(INTERVAL 4 HOUR, ts)) AS start_us, count(*)::BIGINT AS n, sum(round(value * 1000000)::BIGINT)::BIGINT AS s_um FROM events GROUP BY ALL")
def streaming_chunk(spark, sf_dir):
    """Extension: the tumbling chunks of the trajectory, over a file stream run to its end."""
    from ..streaming import chunks

    return chunks.run_to_end(spark, f"{sf_dir}/events.parquet").select("user_id", "start_us", "n", "s_um")


@query("""
WITH m AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS id FROM m)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*)::BIGINT AS n FROM g GROUP BY user_id, id
""")
def streaming_session(spark, sf_dir):
    """Extension: sessions of a user, closed by two hours without an event."""
    from ..streaming import chunks

    return chunks.sessions(table(spark, sf_dir, "events"), "2 hours").select("user_id", "start_us", "n")


# -- around model outputs --------------------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT l_returnflag, l_suppkey, quantile_cont(l_extendedprice / l_quantity, 0.5) AS m FROM lineitem GROUP BY ALL),
s AS (SELECT l_returnflag, quantile_cont(m, 0.5) AS scale, count(*) AS frames FROM e GROUP BY 1),
d AS (SELECT l_returnflag, quantile_cont(abs(m - scale), 0.5) * 1.4826::DOUBLE AS spread FROM e JOIN s USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, round(scale, 4) AS scale, frames::BIGINT AS frames, round(spread, 4) AS spread, round(sqrt((spread / scale) * (spread / scale) + 0.06::DOUBLE * 0.06::DOUBLE), 5) AS rel_sigma FROM s JOIN d USING (l_returnflag)
""")
def metric_ratio(spark, sf_dir):
    ratios = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("ratio"))
    found = reconstruction.metric_scale(ratios, ["l_returnflag"], "l_suppkey", "ratio")
    return found.select("l_returnflag", F.round("scale", 4).alias("scale"), "frames", F.round("spread", 4).alias("spread"), F.round("rel_sigma", 5).alias("rel_sigma"))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
m AS (SELECT a.l_suppkey AS pa, b.l_suppkey AS pb, count(*) AS inliers FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT pa, pb, inliers, a.s_nationkey AS ra, b.s_nationkey AS rb FROM m JOIN supplier a ON a.s_suppkey = pa JOIN supplier b ON b.s_suppkey = pb WHERE a.s_nationkey <> b.s_nationkey),
o AS (SELECT least(ra, rb) AS room_a, greatest(ra, rb) AS room_b, CASE WHEN ra < rb THEN pa ELSE pb END AS photo_a, CASE WHEN ra < rb THEN pb ELSE pa END AS photo_b, inliers FROM r)
SELECT room_a, room_b, photo_a, photo_b, inliers::BIGINT AS inliers FROM o QUALIFY row_number() OVER (PARTITION BY room_a, room_b ORDER BY inliers DESC, photo_a DESC, photo_b DESC) = 1
""")
def photo_room_links(spark, sf_dir):
    """Photos are suppliers, rooms nations, and two photos share an inlier for each order that has both."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("photo_a")).distinct()
    pairs = l.join(l.withColumnRenamed("photo_a", "photo_b"), "l_orderkey").where("photo_a < photo_b").groupBy("photo_a", "photo_b").agg(F.count("*").alias("inliers"))
    s = table(spark, sf_dir, "supplier")
    for side in "ab":
        pairs = pairs.join(s.select(F.col("s_suppkey").alias(f"photo_{side}"), F.col("s_nationkey").alias(f"room_{side}")), f"photo_{side}")
    return reconstruction.best_links(pairs, least=3)


@query(f"""
WITH {EDGES_SQL}, p AS (SELECT DISTINCT l_quantity AS x, l_discount * 100 AS y FROM lineitem),
i AS (SELECT x, y, polygon FROM p JOIN e ON (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 GROUP BY ALL HAVING count(*) % 2 = 1),
d AS (SELECT i.x, i.y, polygon, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy, (x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) AS q FROM i JOIN e USING (polygon)),
t AS (SELECT *, CASE WHEN q = 0 THEN 0 ELSE greatest(0, least(1, ((x - x0) * dx + (y - y0) * dy) / q)) END AS t FROM d)
SELECT x, y, polygon, round(min(sqrt((x0 + t*dx - x)*(x0 + t*dx - x) + (y0 + t*dy - y)*(y0 + t*dy - y))), 6) AS distance FROM t GROUP BY ALL
HAVING min(sqrt((x0 + t*dx - x)*(x0 + t*dx - x) + (y0 + t*dy - y)*(y0 + t*dy - y))) >= 1.25
""")
def inside_with_margin(spark, sf_dir):
    places = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y")).distinct()
    return reconstruction.inside_with_margin(places, polygon_table(spark), ["x", "y"], "x", "y", 1.25).withColumn("distance", F.round("distance", 6))


@query("""
WITH w AS (SELECT o_custkey AS room, o_orderkey AS i, (o_totalprice % 1000) / 100000 AS delta, (o_totalprice % 700) / 10000 AS off, o_orderstatus <> 'F' AS measured FROM orders),
n AS (SELECT *, coalesce(lag(measured) OVER o, last_value(measured) OVER (PARTITION BY room ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b,
  coalesce(lead(measured) OVER o, first_value(measured) OVER o) AS a FROM w WINDOW o AS (PARTITION BY room ORDER BY i))
SELECT CASE WHEN a AND b THEN 'both ends measured' WHEN a OR b THEN 'one end measured' ELSE 'no end measured' END AS ends, count(*)::BIGINT AS pairs, count(*) FILTER (WHERE abs(delta) <= 0.01::DOUBLE)::BIGINT AS passed,
  list_sort(list(abs(delta)))[1 + (count(*) // 2)::INT] AS median, list_sort(list(abs(off)))[1 + (count(*) // 2)::INT] AS median_offset FROM n GROUP BY 1
""")
def repeat_decomposition(spark, sf_dir):
    walls = table(spark, sf_dir, "orders").select(F.lit(1).alias("pair"), F.col("o_custkey").alias("room"), F.col("o_orderkey").alias("i"), (F.col("o_totalprice") % 1000 / 100000).alias("delta"), (F.col("o_totalprice") % 700 / 10000).alias("offset_mismatch"), (F.col("o_orderstatus") != "F").alias("measured"))
    return reconstruction.decomposition(walls)


@query("SELECT event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 3")
def top_detections(spark, sf_dir):
    """The best few of each class."""
    order = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(order)).where("r <= 3").select("event_id", "event_type", "value")


@query("""
SELECT p_partkey, greatest(round_even(p_size * (518.0::DOUBLE / greatest(p_size, p_retailprice)) / 14, 0) * 14, 14)::INT AS w, greatest(round_even(p_retailprice * (518.0::DOUBLE / greatest(p_size, p_retailprice)) / 14, 0) * 14, 14)::INT AS h FROM part
""")
def model_input_size(spark, sf_dir):
    w, h = reconstruction.model_size(F.col("p_size"), F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("w"), h.alias("h"))


@query("""
SELECT label, CASE WHEN abs(x) <= abs(y) AND y <= 0 THEN 0 WHEN abs(x) <= abs(y) THEN 2 WHEN x > 0 THEN 3 ELSE 1 END::INT AS turns FROM (
  SELECT label, list_sort(list(embedding[4]::DOUBLE))[1 + (count(*) // 2)::INT] AS x, list_sort(list(embedding[5]::DOUBLE))[1 + (count(*) // 2)::INT] AS y FROM embeddings GROUP BY 1)
""")
def upright_rotation(spark, sf_dir):
    return reconstruction.upright_turns(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("r")), ["label"])


@query("""
SELECT vec_id, CASE label % 4 WHEN 1 THEN [y0, 10 - x1, y1, 10 - x0] WHEN 2 THEN [20 - x1, 10 - y1, 20 - x0, 10 - y0] WHEN 3 THEN [20 - y1, x0, 20 - y0, x1] ELSE [x0, y0, x1, y1] END::VARCHAR AS box
FROM (SELECT vec_id, label, vec_id % 7 AS x0, vec_id % 5 AS y0, vec_id % 7 + 3 AS x1, vec_id % 5 + 2 AS y1 FROM embeddings)
""")
def box_unrotate(spark, sf_dir):
    v = F.col("vec_id")
    box = F.array(v % 7, v % 5, v % 7 + 3, v % 5 + 2)
    turned = G.unrotated_box(box, F.col("label"), F.lit(20).cast("long"), F.lit(10).cast("long"))
    return table(spark, sf_dir, "embeddings").select("vec_id", turned.cast("string").alias("box"))


@query()
def spaced_events(spark, sf_dir):
    """Greedy exclusion in time, the best first; sequential by nature."""
    from ..operators import matching

    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (seconds("ts") / 1e6).alias("t"), "value")
    return matching.spaced_rows(rows, ["user_id"], "t", "value", 86400.0)


@query()
def trajectory_error(spark, sf_dir):
    """Similarity fits per label; tests recover a known similarity."""
    from ..operators import compare

    e = F.col("embedding")
    pairs = table(spark, sf_dir, "embeddings").select("label", *[e[i].cast("double").alias(n) for i, n in enumerate(("ax", "ay", "az", "bx", "by_", "bz"))])
    return compare.trajectory_errors(pairs, ["label"])
