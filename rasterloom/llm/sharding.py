"""Shards of near equal size by sampled splitters, with DataFrame operations only.

Records are ordered by a hash of their text. A sample in which a record's chance grows with its size gives quantiles
of that order; they cut it into many ranges of about equal bytes. Ranges that turn out overfull are subdivided.
Inside each range running sums place every record in the whole order, and eighths of the total are the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterloom.session import stored

SAMPLE = 8192  # expected size of the sample, whatever the input
RANGES_PER_SHARD = 32
CELLS = 4096  # cells of the hash space, by which records find their range
OVERFULL = 2.0
TOGETHER = 0.005  # a group moves as one if that moves less than this part of a shard


def _cell(key: Column) -> Column:
    return F.shiftright(key, 52) + CELLS // 2


def shards(docs: DataFrame, count: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row: ``doc_id``, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``bytes``: shards hold near equal sizes, each within half a record (or ``TOGETHER`` of a shard) of its
    part of the total at either end. Rows of equal text stay in one shard unless the cut between two shards falls into a group too
    large to move. ``slot`` numbers a shard's rows from 0 in the order of ranges. A null text counts as empty, a null
    id is a row like any other; repeated rows are placed each. ``grown_shard`` is null, as the law asks.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    records = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("key"),
    ).withColumn("sub", F.xxhash64("doc_id", "size", "text_crc32"))
    records = stored(records)  # 40 bytes a row; the texts are read once
    total = records.agg(F.sum("size")).first()[0] or 0

    # a record is drawn with probability size x SAMPLE / total; larger ones count as often as they would be drawn
    step = max(1.0, total / SAMPLE)
    chance = F.pmod(F.xxhash64("sub", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    drawn = records.where(chance < F.col("size") / step).select("key", F.greatest(F.lit(1), (F.col("size") / step).cast("long")).alias("w"))
    # as a percentile is made of numbers, the sample is cut at the quantiles of its own running weight
    parts = count * RANGES_PER_SHARD
    running = F.sum("w").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    weight = drawn.agg(F.sum("w")).first()[0] or 0
    marks = drawn.withColumn("at", F.coalesce(running, F.lit(0))).where(
        F.floor(F.col("at") * parts / max(weight, 1)) < F.floor((F.col("at") + F.col("w")) * parts / max(weight, 1))
    )
    cuts = sorted({r["key"] for r in marks.select("key").distinct().collect()})  # fewer than ``parts`` + 1
    # a key drawn for two quantiles or more would fill ranges alone, so every cut also ends a range after itself
    edges = sorted({-(1 << 63), *cuts, *(c + 1 for c in cuts if c < (1 << 63) - 1)})
    bounds = [(i, low, (edges[i + 1] if i + 1 < len(edges) else None)) for i, low in enumerate(edges)]
    table = spark.createDataFrame(bounds, "range int, low long, high long")
    top = F.coalesce(F.col("high") - 1, F.lit((1 << 63) - 1))
    table = table.withColumn("cell", F.explode(F.sequence(_cell(F.col("low")), _cell(top))))  # at most CELLS + 4 * parts rows
    ranged = records.withColumn("cell", _cell(F.col("key"))).join(
        F.broadcast(table),
        ["cell"],
    ).where((F.col("key") >= F.col("low")) & (F.col("high").isNull() | (F.col("key") < F.col("high"))))

    # overfull ranges: those of a single key are cut by the records' own hashes, others evenly between their ends
    held = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))
    room = max(1.0, total / parts)
    pieces = F.when(F.col("bytes") > OVERFULL * room, F.ceil(F.col("bytes") / room)).otherwise(1).cast("long")
    held = held.select("range", pieces.alias("pieces"))
    single = F.col("high") == F.col("low") + 1
    within = (F.col("key") / 2 - F.col("low") / 2) / F.greatest(F.lit(1.0), F.coalesce(F.col("high"), F.lit((1 << 63) - 1)) / 2 - F.col("low") / 2)
    sub = F.when(single, F.pmod("sub", "pieces")).otherwise(F.least(F.floor(within * F.col("pieces")), F.col("pieces") - 1))
    split = ranged.join(F.broadcast(held), "range").withColumn("piece", F.coalesce(sub, F.lit(0)).cast("long"))
    split = split.select("doc_id", "size", "text_crc32", "key", "sub", "range", "piece")

    # rows and bytes before each range, from one row per range
    sums = split.groupBy("range", "piece").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    order = Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        "range",
        "piece",
        F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("bytes_before"),
    )
    placed = split.join(F.broadcast(before), ["range", "piece"])

    own = Window.partitionBy("range", "piece").orderBy("key", "sub", "doc_id", "size", "text_crc32")
    group = Window.partitionBy("range", "piece", "key")
    placed = (
        placed.withColumn("end", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("row", F.row_number().over(own))
        .withColumn("group_end", F.max("end").over(group))
        .withColumn("group_start", F.min(F.col("end") - F.col("size")).over(group))
    )
    share = max(1.0, total / count)
    middle = F.when(
        F.col("group_end") - F.col("group_start") <= TOGETHER * share, (F.col("group_start") + F.col("group_end")) / 2
    ).otherwise(F.col("end") - F.col("size") / 2)
    place = placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.floor((F.col("bytes_before") + middle) / share), F.lit(count - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("row") - 1).alias("place"),
        "range",
        "piece",
    )
    # the order runs through the shards one after another, so a shard's first place is the rows of those before it
    firsts = place.groupBy("shard").agg(F.min("place").alias("first"))
    return place.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
