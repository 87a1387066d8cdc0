"""Row-balanced split points: for one whole table, or for many keys of which a few hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut, partitions_for
from .running import located, running_total

#: A key is heavy from this share of the loci on, or from half a partition's share on, if that is less.
HEAVY_SHARE, LEAST_SHARE = 0.02, 1e-4
TILE_BITS = 12


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """Keys that may hold at least `share` of the rows, by a mergeable frequent-items sketch of about 1/share counters."""
    found = df.select(F.col(f"`{key}`").alias("k")).where("k IS NOT NULL").stat.freqItems(["k"], share).first()
    return sorted(found[0]) if found and found[0] else []


def keyed_split_points(rows: DataFrame, key: str, position: str, requests: DataFrame, request_id: str, intervals: str, *, heavy_share: float | None = None, tile_bits: int = TILE_BITS, most_broadcast: int = 100_000) -> DataFrame:
    """For each request (id, key, j = intervals) the positions that split the key's rows into j equal shares.

    Gives request_id bigint, k int, the key, position: for k = 1 to j-1 the position of row floor(k*n/j)+1 of the key's
    n rows in order of position. A request whose positions don't increase strictly gives nothing.

    Rows are first counted by (key, position), with partial counts before the exchange. Heavy keys, found by sketch, are
    cut into tiles of 2^tile_bits positions: tile totals tell in which tile each wanted row lies, these tiles are
    broadcast against the heavy keys' loci (by shuffle if there are more than `most_broadcast`), and the row is found
    inside its tile. The remaining keys are shuffled by key and swept in order. Both ways are exact; the union is whole.

    Defined results: rows with a null key or position count nothing; requests with a null field, fewer than two
    intervals or a key without rows give nothing; repeated requests count once; other columns are ignored.
    """
    loci = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{position}`").alias("pos")).where("key IS NOT NULL AND pos IS NOT NULL")
    loci = cut(loci.groupBy("key", "pos").agg(F.count("*").alias("n")))
    wanted = requests.select(F.col(f"`{request_id}`").cast("bigint").alias("id"), F.col(f"`{key}`").alias("key"), F.col(f"`{intervals}`").cast("bigint").alias("j"))
    wanted = wanted.where("id IS NOT NULL AND key IS NOT NULL AND j >= 2").distinct()
    share = heavy_share or max(LEAST_SHARE, min(HEAVY_SHARE, 1 / (2 * partitions_for(rows.sparkSession))))
    heavy = heavy_keys(loci, "key", share)
    is_heavy = F.col("key").isin(heavy) if heavy else F.lit(False)

    def targets(totals: DataFrame) -> DataFrame:
        each = wanted.join(totals, "key").withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("j") - 1)))
        return each.select("key", "id", "j", "k", F.expr("(k * total) div j + 1").alias("rank"))

    def placed(df: DataFrame, by: list[str], order: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("at", F.sum("n").over(w) - F.col("n") + 1)

    light = loci.where(~is_heavy)
    found = located(placed(light, ["key"], "pos"), targets(light.groupBy("key").agg(F.sum("n").alias("total"))), ["key"], "at", "rank", ["pos"])
    if heavy:
        dense = loci.where(is_heavy).withColumn("tile", F.shiftright(F.col("pos").cast("bigint"), tile_bits))
        tiles = cut(placed(dense.groupBy("key", "tile").agg(F.sum("n").alias("n")), ["key"], "tile"))
        totals = tiles.groupBy("key").agg(F.sum("n").alias("total"))
        aimed = located(tiles.withColumn("base", F.col("at")), targets(totals), ["key"], "at", "rank", ["tile", "base"])
        aimed = cut(aimed.select("key", "tile", "id", "j", "k", (F.col("rank") - F.col("base") + 1).alias("rank")))
        there = dense.join(broadcast_if_small(aimed.select("key", "tile").distinct(), most_broadcast), ["key", "tile"])
        inside = located(placed(there, ["key", "tile"], "pos"), aimed, ["key", "tile"], "at", "rank", ["pos"])
        found = found.select("key", "id", "j", "k", "pos").unionByName(inside.select("key", "id", "j", "k", "pos"))
    request = Window.partitionBy("id", "key", "j")
    grows = F.coalesce(F.col("pos") > F.lag("pos").over(request.orderBy("k")), F.lit(True))
    out = found.withColumn("grows", grows).withColumn("grows", F.min("grows").over(request)).where("grows")
    return out.select(F.col("id").alias(request_id), F.col("k").cast("int").alias("k"), F.col("key").alias(key), F.col("pos").alias(position))


class UnbalancedError(ValueError):
    """The rows cannot be cut into so many intervals."""


def row_balanced(rows: DataFrame, ordering: list[str], intervals: int) -> DataFrame:
    """The loci (columns `ordering`) of rows floor(k*n/j)+1, k = 1 to j-1, of the whole table in order, with k.

    Loci are counted, then sorted by a full distributed sort; nothing is collected but the j-1 result rows' check.
    Raises UnbalancedError for an empty table, fewer than two intervals or loci that don't increase strictly.
    """
    if intervals < 2:
        raise UnbalancedError(f"{intervals} intervals: at least 2 are needed")
    loci = rows.groupBy(*ordering).agg(F.count("*").alias("__n"))
    placed = running_total(loci, [], list(ordering), "__n", name="__end", total="__all")
    k = F.explode(F.sequence(F.ceil((F.col("__end") - F.col("__n")) * intervals / F.col("__all")).cast("bigint") - 1, F.floor(F.col("__end") * intervals / F.col("__all")).cast("bigint") + 1))
    hit = placed.select(*ordering, "__n", "__end", "__all", k.alias("k")).where(f"k BETWEEN 1 AND {intervals - 1}")
    rank = F.expr(f"(k * __all) div {intervals} + 1")
    hit = cut(hit.where((rank > F.col("__end") - F.col("__n")) & (rank <= F.col("__end"))).select(F.col("k").cast("int").alias("k"), *ordering))
    found = hit.agg(F.count("*").alias("n"), F.count_distinct(*ordering).alias("loci")).first()
    if found.n == 0:
        raise UnbalancedError("the table has no rows")
    if found.loci < intervals - 1:
        raise UnbalancedError(f"the rows cannot be balanced into {intervals} intervals")
    return hit
