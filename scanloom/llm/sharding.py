"""Extendible hashing into shards of bounded bytes; DataFrame functions only.

A document's hash is the first 60 bits of the MD5 of its key. A shard is a prefix of the hash's bits. The
directory starts with one bucket; only buckets over the byte limit split on their next bit. All splits of
up to 16 bits are decided at once from the byte sums of 65,536 cells, a table of fixed size whatever the
input; only cells that are still over the limit look at the next 16 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

HASH_BITS = 60
STEP_BITS = 16


def key_hash(key: F.Column) -> F.Column:
    """60 bits as a long. Null keys hash like the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix_bits(hash_: F.Column, depth: F.Column) -> F.Column:
    """The first ``depth`` bits as text; the empty text for depth 0."""
    return F.substring(F.lpad(F.conv(hash_.cast("string"), 10, 2), HASH_BITS, "0"), F.lit(1), depth)


def split_buckets(cells: DataFrame, done: int, limit: int) -> DataFrame:
    """``cells(parent, cell, bytes, one)`` to ``(parent, cell, depth)``: the depth in bits at which each cell's bucket fits.

    ``parent`` is the prefix of ``done`` bits that was over the limit. Depth is -1 where even the cell is over, and -2 if it is
    all of ``one`` hash, which no further bit splits.
    """
    more = min(STEP_BITS, HASH_BITS - done)
    first = 0 if not done else 1
    levels = cells.withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(more)))).withColumn(
        "prefix", F.expr(f"shiftright(cell, cast({more} - level as int))")
    )
    fitting = levels.groupBy("parent", "level", "prefix").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit)
    over = F.when(F.max("one"), -2).otherwise(-1)
    return (
        levels.drop("bytes")
        .join(fitting, ["parent", "level", "prefix"], "left")
        .groupBy("parent", "cell")
        .agg(F.coalesce(F.min(F.when(F.col("bytes").isNotNull(), F.col("level"))) + done, over).alias("depth"))
    )


def shard(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (bits as text), ``shard_depth``, ``shard_part`` and ``n_bytes``; columns of these names are replaced.

    Null texts have 0 bytes. Rows that share a key share all bits; where they alone are over the limit, all bits are the shard's and it
    is cut into parts of at most ``limit`` bytes by running sum (a single row over the limit is a part of its own, numbered
    from -1 down). An empty table gives an empty result.
    """
    if limit <= 0:
        raise ValueError("the byte limit must be positive")
    own = [c for c in docs.columns if c not in ("shard", "shard_depth", "shard_part", "n_bytes")]
    size = F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long")
    # the input's columns travel as one, so that none of them can clash
    pending = docs.select(F.struct(*[docs[c] for c in own]).alias("row"), size.alias("n_bytes"), key_hash(docs[key]).alias("hash"), F.spark_partition_id().alias("task"))
    resolved, done = [], 0
    while True:
        more = min(STEP_BITS, HASH_BITS - done)
        placed = pending.withColumns({
            "parent": F.shiftright("hash", HASH_BITS - done) if done else F.lit(0).cast("long"),
            "cell": F.shiftright("hash", HASH_BITS - done - more).bitwiseAND((1 << more) - 1),
        })
        cells = placed.groupBy("parent", "cell").agg(F.sum("n_bytes").alias("bytes"), (F.min("hash") == F.max("hash")).alias("one"))
        # a row for each cell that documents are in: kept, so that later rounds don't work it out again
        directory = saved(split_buckets(cells, done, limit), "directory")
        joined = placed.join(directory, ["parent", "cell"]).drop("parent", "cell")
        states = {r["s"] for r in directory.select(F.least("depth", F.lit(0)).alias("s")).distinct().collect()}  # three values at most
        resolved.append(joined.where("depth >= 0").withColumn("part", F.lit(0).cast("long")))
        done += more
        if -2 in states:
            # written, so that each row's task is one and the same for both of its uses
            resolved.append(parts(saved(joined.where("depth = -2"), "oversized"), limit))
        if -1 not in states:
            break
        pending = joined.where("depth = -1").drop("depth")
    out = resolved[0]
    for x in resolved[1:]:
        out = out.unionByName(x)
    return out.select(*[F.col(f"row.`{c}`") for c in own], prefix_bits(F.col("hash"), F.col("depth")).alias("shard"), F.col("depth").cast("int").alias("shard_depth"), F.col("part").alias("shard_part"), "n_bytes")


def parts(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of one hash each, cut by running bytes: a part begins at every half of the limit and holds rows of
    at most half the limit, so it ends within the limit; larger rows are a part each, numbered from -1 down.

    Sums run within each input task's rows, and from the sums of tasks on, so that a key with very many rows isn't one task's work.
    """
    half = max(1, limit // 2)
    marked = rows.withColumn("large", F.col("n_bytes") > half)
    group = ["hash", "large", "task"]
    tasks = marked.groupBy(*group).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
    earlier = Window.partitionBy("hash", "large").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select(*group, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "n")])
    order = Window.partitionBy(*group).orderBy("n_bytes")
    before = F.col("bytes_before") + F.coalesce(F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.when(F.col("large"), -(F.col("n_before") + F.row_number().over(order))).otherwise(F.floor(before / half))
    return marked.join(offsets, group).withColumns({"depth": F.lit(HASH_BITS), "part": part.cast("long")}).select(*rows.columns, "part")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; rows of a shard meet in one task, which its byte limit bounds."""
    sharded.repartition("shard", "shard_part").write.partitionBy("shard", "shard_part").parquet(path)


#: The byte limit of the query op9_sharding.
SHARD_BYTES = 160 << 10


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs, SHARD_BYTES).select("doc_id", "shard", "shard_depth", "shard_part", "n_bytes")


#: Keys of ``documents`` are distinct, so a shard over the limit is one document, which is over half of it.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), levels AS (
  SELECT d.level::INT AS level, (s.h >> (60 - d.level)::BIGINT) AS prefix, sum(s.n_bytes) AS bytes
  FROM sized s, range(0, 61) d(level) GROUP BY ALL
), fit AS (
  SELECT s.doc_id, min(l.level) AS depth
  FROM sized s JOIN levels l ON l.prefix = (s.h >> (60 - l.level)::BIGINT) AND l.bytes <= {SHARD_BYTES}
  GROUP BY ALL
)
SELECT doc_id, substr(right(repeat('0', 60) || ltrim(h::BIT::VARCHAR, '0'), 60), 1, coalesce(depth, 60)) AS shard,
       coalesce(depth, 60)::INT AS shard_depth, CASE WHEN depth IS NULL THEN -1 ELSE 0 END::BIGINT AS shard_part, n_bytes
FROM sized LEFT JOIN fit USING (doc_id)
"""
