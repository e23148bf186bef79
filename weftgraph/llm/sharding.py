"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every document hashes to one of CELLS points of a ring, every shard to several
(its virtual nodes). A point belongs to the next virtual node clockwise; where
that shard is full, the point goes on clockwise to the first shard with room.
Points are placed in a fixed order (most bytes first, then by number), so the
result depends on nothing but the documents. Capacity is the mean times
(1 + slack); a point that no shard has room for goes to the emptiest one, so no
shard exceeds the capacity by more than one point. As the slack is all that can
stay free, shards are bounded from below too. A document moves only if its home
shard is full, and one more shard moves little but what it takes itself: of
points of like size about 2% of the bytes change between old shards.

Documents are pre-aggregated to points before anything is placed, so the placing
works on a table of CELLS rows however many documents there are. Everything is
DataFrame functions; the walk round the ring is one SQL aggregate().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS = 40
REPLICAS = 128
CELLS = 1 << 14
SLACK = 1 / 1024


def cell_of(doc_id: Column, text_crc32: Column, cells: int = CELLS) -> Column:
    """The point of a document; rows without doc_id are told apart by their text."""
    return F.pmod(F.xxhash64(doc_id, F.when(doc_id.isNull(), text_crc32)), F.lit(cells)).cast("int")


def ring(spark: SparkSession, shards: int = SHARDS, replicas: int = REPLICAS, cells: int = CELLS) -> DataFrame:
    """(cell, pref): for each point of the ring all shards in clockwise order of their first virtual node."""
    shard, replica = F.floor(F.col("id") / replicas).cast("int"), F.col("id") % replicas
    # a node's place depends on its shard and replica alone, so that one more shard leaves all others where they are
    nodes = spark.range(0, shards * replicas, 1, 1).select(F.pmod(F.xxhash64(F.lit("node"), shard, replica), F.lit(cells)).cast("int").alias("pos"), shard.alias("shard"), "id")
    whole = nodes.agg(F.array_sort(F.collect_list(F.struct("pos", "id", "shard"))).alias("r")).select(F.col("r.pos").alias("pos"), F.col("r.shard").alias("shard"))
    at = whole.select("pos", "shard", F.posexplode("pos").alias("i", "p"))
    pref = F.array_distinct(F.concat(F.slice("shard", F.col("i") + 1, F.size("shard")), F.slice("shard", F.lit(1), F.col("i"))))
    last = F.element_at("pos", -1)
    before = F.when(F.col("i") > 0, F.get("pos", F.col("i") - 1)).otherwise(F.lit(-1))
    own = F.when(F.col("p") > before, F.sequence(before + 1, "p")).otherwise(F.array().cast("array<int>"))
    wrapped = F.when((F.col("i") == 0) & (last < cells - 1), F.sequence(last + 1, F.lit(cells - 1))).otherwise(F.array().cast("array<int>"))
    return at.select(F.explode(F.concat(own, wrapped)).alias("cell"), pref.alias("pref"))


def place(sizes: DataFrame, shards: int = SHARDS, replicas: int = REPLICAS, cells: int = CELLS, slack: float = SLACK) -> DataFrame:
    """(cell, shard, home, n_rows) from (cell, n_bytes, n_rows); at most `cells` rows each.

    A point that fits nowhere goes to the shard with the fewest bytes, so none
    is dropped.
    """
    points = sizes.join(F.broadcast(ring(sizes.sparkSession, shards, replicas, cells)), "cell")
    whole = points.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n_bytes")).alias("less"), "cell", "pref", "n_rows"))).alias("points"),
        F.ceil(F.sum("n_bytes") * F.lit(1 + slack) / shards).cast("long").alias("cap"),
    )
    walk = f"""
        aggregate(points,
          named_struct('loads', transform(sequence(1, {shards}), x -> 0L), 'placed', cast(array() as array<int>)),
          (acc, x) -> element_at(transform(
            array(coalesce(get(filter(x.pref, s -> get(acc.loads, s) - x.less <= cap), 0),
                           cast(array_position(acc.loads, array_min(acc.loads)) - 1 as int))),
            to -> named_struct('loads', transform(acc.loads, (v, i) -> if(i = to, v - x.less, v)),
                               'placed', concat(acc.placed, array(to)))), 1),
          acc -> acc.placed)"""
    placed = whole.select("points", F.expr(walk).alias("placed"))
    each = placed.select(F.explode(F.arrays_zip("points", "placed")).alias("x"))
    return each.select("x.points.cell", F.col("x.placed").alias("shard"), F.get("x.points.pref", F.lit(0)).alias("home"), "x.points.n_rows")


def shard(docs: DataFrame, shards: int = SHARDS, replicas: int = REPLICAS, cells: int = CELLS, slack: float = SLACK) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard.

    law is `bytes`. size counts UTF-8 bytes plus 16; a null text has none and
    the crc of an empty one. slot numbers a shard's rows from 0 by point, then
    doc_id, crc and size. Rows with one doc_id share a point and are numbered by
    one task, as do rows without one that have equal texts; so doc_id should be
    a key. A text of any length is measured whole. An empty table gives no rows.
    Other columns, whatever their names, are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("cell", cell_of(F.col("doc_id"), F.col("text_crc32"), cells))
    sizes = rows.groupBy("cell").agg(F.sum("size").alias("n_bytes"), F.count("*").alias("n_rows"))
    placed = place(sizes, shards, replicas, cells, slack)
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("first", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
    # `cells` rows at most, so small at any size of the input
    out = rows.join(F.broadcast(placed.select("cell", "shard", "home", "first")), "cell")
    within = F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + within - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("home").alias("home_shard"))
