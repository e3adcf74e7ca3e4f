"""Joining pixel-sized tables with tables that hold one row per key.

The small side is broadcast only after its bytes have been measured. Beyond the bound the keys that hold
a large share of the big side (at most ``HOT_SHARE`` of them, by arithmetic) keep the broadcast, and the
rest are joined by shuffle, where no key is heavier than 1/HOT_SHARE of the rows.

Measuring needs the small side computed: :func:`lookup_join` settles it while the plan is built, unless the caller
hands over a :class:`Settled` table, which serves any number of joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rasterloom.session import settle

BROADCAST_BYTES = 128 * 1024 * 1024
HOT_SHARE = 1000


def row_bytes(column: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in a row."""
    if isinstance(kind, T.StructType):
        return sum((row_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.ArrayType):
        inner = F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + row_bytes(x, kind.elementType))
        return F.coalesce(inner, F.lit(0)) + F.lit(24)
    if isinstance(kind, T.MapType):
        return row_bytes(F.map_keys(column), T.ArrayType(kind.keyType)) + row_bytes(F.map_values(column), T.ArrayType(kind.valueType))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return (F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(16)).cast("long")
    return F.lit(16 if isinstance(kind, T.DecimalType) else 8).cast("long")


@dataclass(frozen=True)
class Settled:
    """A table that is already computed, and the bytes it takes; None if that is more than the bound it was measured for."""

    table: DataFrame
    size: int | None

    def select(self, *columns: str) -> Settled:
        return Settled(self.table.select(*columns), self.size)


def _measured(table: DataFrame, limit: int) -> int | None:
    """Bytes of a computed table; reads at most as many rows as could fit."""
    each = row_bytes(F.struct(*table.columns), table.schema)
    found = table.limit(limit // 16 + 1).agg(F.sum(each)).first()[0] or 0
    return found if found <= limit else None


def settled(df: DataFrame) -> Settled:
    """Compute a table once, for any number of joins. This runs a job now."""
    table = settle(df)
    return Settled(table, _measured(table, BROADCAST_BYTES))


def fits_broadcast(computed: DataFrame, row_bytes: int | None = None, limit: int | None = None) -> bool:
    """Whether an already computed table stays below the bound: by its measured bytes, or rows of a known size."""
    limit = BROADCAST_BYTES if limit is None else limit
    if row_bytes is None:
        return _measured(computed, limit) is not None
    rows = limit // row_bytes
    return computed.limit(rows + 1).count() <= rows


def lookup_join(
    big: DataFrame,
    per_key: DataFrame | Settled,
    keys: list[str],
    how: str = "left",
    weight: str | None = None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Join ``big`` with ``per_key``, which must hold each key once.

    ``weight`` names a column of ``per_key`` with the number of big rows per key, which saves counting
    them; it is dropped from the result.
    """
    known = per_key if isinstance(per_key, Settled) else settled(per_key)
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    dim = known.table
    wanted = dim.drop(weight) if weight else dim
    if known.size is not None and known.size <= limit:
        return big.join(F.broadcast(wanted), keys, how)

    # keys of the big side that per_key lacks may be heavy too, so a left join counts the big side itself
    if weight and how == "inner":
        weights = dim.select(*keys, F.col(weight).alias("rows"))
    else:
        weights = settle(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")))
    total = weights.agg(F.sum("rows")).first()[0] or 0
    hot = settle(weights.where(F.col("rows") * HOT_SHARE >= total).where(F.col("rows") > 0).select(*keys))
    hot_dim = settle(wanted.join(F.broadcast(hot), keys, "left_semi"))
    heavy = big.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(hot_dim), keys, how)
    light = big.join(F.broadcast(hot), keys, "left_anti")
    if how == "left":  # rows without a key meet nothing and need not be gathered
        empty = [F.col(c).isNull() for c in keys]
        nothing = empty[0]
        for e in empty[1:]:
            nothing = nothing | e
        lone = light.where(nothing).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.schema.fields if f.name not in keys])
        heavy = heavy.unionByName(lone)
        light = light.where(~nothing)
    return heavy.unionByName(light.join(wanted.hint("merge"), keys, how))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], salts: int = 64) -> DataFrame:
    """Inner equi-join by shuffle where one key may hold a large share of ``big``.

    The rows of ``big`` are counted per key first. Keys that hold at least 1/HOT_SHARE of them, so at most HOT_SHARE keys,
    are dealt out over sub-keys by a hash of the ``spread`` columns, ``salts`` at most and as many as their rows fill;
    rows of ``small`` are repeated for the sub-keys of such keys only.
    """
    weights = settle_hot(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), salts)
    salted = big.join(F.broadcast(weights), keys, "left")
    salted = salted.withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int")))
    copies = small.join(F.broadcast(weights), keys, "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)).cast("int") - 1)))
    return salted.drop("_parts").join(copies.drop("_parts").hint("merge"), [*keys, "_salt"]).drop("_salt")


def settle_hot(counts: DataFrame, most: int) -> DataFrame:
    """Of (keys, _rows) the keys with at least 1/HOT_SHARE of all rows, and into how many ``_parts`` each is dealt.

    A part holds about 1/HOT_SHARE of the rows, or more if a key would have over ``most`` parts.
    """
    counts = settle(counts)
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    parts = F.least(F.lit(most), F.ceil(F.col("_rows") * HOT_SHARE / F.lit(max(total, 1)))).cast("long")
    return settle(counts.where(F.col("_rows") * HOT_SHARE >= total).select(*[c for c in counts.columns if c != "_rows"], parts.alias("_parts")))
