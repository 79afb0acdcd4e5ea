"""Shards of near equal bytes by fixed virtual slots.

A record's slot is a hash of its id, one of SLOTS, and never changes. Bytes are summed by slot, and a map says which shard
each slot is in. Maps are versioned: one is never changed, but edited into the next version, which moves as few slots as
even shards need; stored maps lie beside one another in a folder. A map has SLOTS rows, whatever the data, so it may be
broadcast. All of this is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plazaflow.llm.common import cut

SHARDS = 16
#: Hexadecimal digits of the id's hash that make the slot, and that make a cell of it, in which rows are numbered.
SLOT_DIGITS, CELL_DIGITS = 3, 4
SLOTS = 16**SLOT_DIGITS
#: Rows alike in all columns that one task numbers.
CHUNK = 10_000


def cell_of(doc_id: Column) -> Column:
    """The id's cell; a slot has 16 of them. A null id has that of an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, CELL_DIGITS), 16, 10).cast("int")


def slot_of(doc_id: Column) -> Column:
    """The id's virtual slot."""
    return F.shiftright(cell_of(doc_id), 4 * (CELL_DIGITS - SLOT_DIGITS))


def size_of(text: Column) -> Column:
    """Bytes of a record: those of its text (null: none) and one more."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def slot_bytes(docs: DataFrame) -> DataFrame:
    """(slot, bytes, rows) of each slot that has records."""
    return docs.groupBy(slot_of(F.col("doc_id")).alias("slot")).agg(F.sum(size_of(F.col("text"))).alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(spark: SparkSession, shards: int = SHARDS) -> DataFrame:
    """(version, slot, shard) before anything is known of the data: slots dealt out in turn."""
    return spark.range(SLOTS).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("slot"), (F.col("id") % shards).cast("int").alias("shard"))


def _weighed(plan: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """Slots of a map with their bytes, and whether they are free: a shard keeps its slots, largest first, up to the even share of
    all bytes, and at least the largest; empty slots stay where they are."""
    known = plan.join(sizes.select("slot", "bytes"), "slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    largest = Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "slot")
    share = F.ceil(F.sum("bytes").over(Window.partitionBy()) / shards)  # SLOTS rows
    known = known.withColumns({"_upto": F.sum("bytes").over(largest.rowsBetween(Window.unboundedPreceding, 0)), "_nth": F.row_number().over(largest), "_share": share})
    return known.withColumn("free", (F.col("_upto") > F.col("_share")) & (F.col("_nth") > 1) & (F.col("bytes") > 0)).drop("_upto", "_nth", "_share")


def rebalanced(plan: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The map's next version, with shards of near equal bytes: slots beyond a shard's even share go, largest first, each to
    the shard with the least bytes by then (of equal ones the first). No other slot moves."""
    known = _weighed(plan, sizes, shards)
    loads = F.array(*(F.coalesce(F.sum(F.when(~F.col("free") & (F.col("shard") == k), F.col("bytes"))), F.lit(0)) for k in range(shards)))
    queue = F.array_sort(F.collect_list(F.when(F.col("free"), F.struct((-F.col("bytes")).alias("less"), "slot"))))
    one = known.agg(loads.alias("loads"), queue.alias("queue"))
    start = F.struct(F.col("loads"), F.array().cast("array<struct<slot:int,shard:int>>").alias("moved"))

    def deal(done: Column, item: Column) -> Column:
        least = F.array_position(done["loads"], F.array_min(done["loads"])).cast("int") - 1
        grown = F.transform(done["loads"], lambda load, k: F.when(k == least, load - item["less"]).otherwise(load))
        return F.struct(grown.alias("loads"), F.array_append(done["moved"], F.struct(item["slot"].alias("slot"), least.alias("shard"))).alias("moved"))

    moved = one.select(F.inline(F.aggregate("queue", start, deal)["moved"])).select(F.col("slot"), F.col("shard").alias("_to"))
    return plan.join(moved, "slot", "left").select((F.col("version") + 1).alias("version"), "slot", F.coalesce("_to", "shard").alias("shard"))


def grown(plan: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The map's next version with one shard more, numbered `shards`: it takes what others hold beyond the share that is
    even then. Nothing moves but into it."""
    known = _weighed(plan, sizes, shards + 1)
    return known.select((F.col("version") + 1).alias("version"), "slot", F.when(F.col("free"), F.lit(shards)).otherwise(F.col("shard")).alias("shard"))


def store(plan: DataFrame, folder: str) -> None:
    """Writes a map beside the other versions; one that is there already is never written over."""
    version = plan.agg(F.max("version")).first()[0]
    plan.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")


def load(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored map, the newest if no version is asked for."""
    plans = spark.read.parquet(folder)
    version = version or plans.agg(F.max("version")).first()[0]
    return plans.where(F.col("version") == version).select("version", "slot", "shard")


def assigned(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs with their shard (a column of that name is replaced): a map of SLOTS rows is broadcast, and no row is moved."""
    to = plan.select(F.col("slot").alias("_slot_of_map"), F.col("shard").alias("_shard_of_map"))
    kept = docs.drop("shard")
    return kept.join(F.broadcast(to), slot_of(F.col("doc_id")) == F.col("_slot_of_map")).drop("_slot_of_map").withColumnRenamed("_shard_of_map", "shard")


def write_shards(docs: DataFrame, plan: DataFrame, path: str) -> None:
    """docs as Parquet, a folder for each shard, by whoever read them: nothing is shuffled."""
    assigned(docs, plan).write.partitionBy("shard").parquet(path)


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, bytes, copies) of rows that differ in these, written: texts are read once."""
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return cut(docs.select("doc_id", size_of(F.col("text")).alias("size"), crc.alias("text_crc32")).groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")))


def numbered(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """A row for each copy of records(): doc_id, size, text_crc32, shard, and slot, the row's place within its shard, from 0.

    Places follow cells, and within a cell id, size and checksum. Cells are numbered apart and begin where the shard's
    earlier ones end, so a task holds 1/65,536 of the rows, not a shard. Rows alike in all columns came as one with their number; more
    than CHUNK of them are dealt out to many tasks before they are written out.
    """
    cells = assigned(rows.withColumn("_cell", cell_of(F.col("doc_id"))), plan)
    sizes = cells.groupBy("shard", "_cell").agg(F.sum("copies").alias("_n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(earlier(Window.partitionBy("shard").orderBy("_cell"))), F.lit(0)).alias("_start"))
    own = F.coalesce(F.sum("copies").over(earlier(Window.partitionBy("_cell").orderBy("doc_id", "size", "text_crc32"))), F.lit(0))
    placed = cells.withColumn("_own", own).join(F.broadcast(starts), F.col("_cell") == F.col("_c"))  # 65,536 cells at most
    placed = placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_own")).alias("_from"), "copies")
    few = placed.where(F.col("copies") <= CHUNK).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long")))
    many = placed.where(F.col("copies") > CHUNK).withColumn("_a", chunk).repartition("doc_id", "_a")
    many = many.withColumn("_k", F.explode(F.sequence("_a", F.least(F.col("_a") + CHUNK, "copies") - 1))).drop("_a")
    return few.unionByName(many).select("doc_id", "size", "text_crc32", "shard", (F.col("_from") + F.col("_k")).alias("slot"))


def report(docs: DataFrame, folder: str, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row: the law is `bytes`, so no shard is grown.

    Stores the first map in the folder, then its edit by the bytes of these rows, and reads that. Null texts have size 1 and
    checksum 0; null ids share a slot; repeated rows are rows of their own in one shard; other columns are ignored.
    """
    rows = records(docs)
    sizes = rows.groupBy(slot_of(F.col("doc_id")).alias("slot")).agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"))
    spark = docs.sparkSession
    store(first_map(spark, shards), folder)
    store(rebalanced(load(spark, folder), sizes, shards), folder)
    placed = numbered(rows, load(spark, folder))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
