"""Mixing sources to target weights, in an order that keeps every prefix close to the targets."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import running_total
from ..session import cut

#: Slots of the cycle that repeats, and tokens of a block: fixed sizes, whatever the length of the mix.
SLOTS, BLOCK_TOKENS = 1000, 1000
#: Items of each size class (power of two) that are looked at, by source, to make up what is missing at a quota's end.
SPARE = 8
MOST_SOURCES = 500


def apportion(shares: list[float], slots: int) -> list[int]:
    """Whole slots for each share, in all `slots`, by largest remainder."""
    exact = np.array(shares) / sum(shares) * slots
    whole = np.floor(exact).astype(int)
    for i in np.argsort(whole - exact, kind="stable")[: slots - whole.sum()]:
        whole[i] += 1
    return whole.tolist()


def pfair(quota: list[int], slots: int) -> list[tuple[int, int, int]]:
    """A schedule (source, block, slot) of `slots` slots in which source s has quota[s] blocks, in all `slots`.

    Block b (from 0) of a source of weight w = quota/slots is released at floor(b/w) and due at ceil((b+1)/w). Each
    slot goes to the released block that is due first; of equal deadlines, to the one whose next block is released
    before it is due, then to the source of more weight. Every block then runs inside its window, so at any time each
    source is less than one block from its weight's due part.
    """
    waiting = [(0, s, 0) for s, q in enumerate(quota) if q]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, b = heapq.heappop(waiting)
            q = quota[s]
            due = -(-(b + 1) * slots // q)
            overlaps = (b + 1) * slots // q < due
            heapq.heappush(ready, (due, not overlaps, -q, s, b))
        if not ready:
            continue
        *_, s, b = heapq.heappop(ready)
        out.append((s, b, slot))
        if b + 1 < quota[s]:
            heapq.heappush(waiting, ((b + 1) * slots // quota[s], s, b + 1))
    return out


def made_up(lack: int, spare: list[tuple[int, int]]) -> list[int]:
    """Places of the spare items (tokens, place) that make up `lack` without passing it: the largest that fits, again and again."""
    out = []
    for n, place in sorted(spare, key=lambda x: (-x[0], x[1])):
        if n <= lack:
            out.append(place)
            lack -= n
    return out


@dataclass(frozen=True)
class Mix:
    """rows: the mix (source, the item's columns, repeat_no from 0, n_tokens, slot, place). shares: the report."""

    rows: DataFrame
    shares: DataFrame


def mixed(items: DataFrame, item: list[str], source: str, tokens: str, targets: DataFrame, *, share: str = "target_share", most: str = "max_repeats", total_tokens: int | None = None, slots: int = SLOTS, block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> Mix:
    """Mix the items of the sources in `targets` so that each source has its share of all tokens.

    Without `total_tokens` the mix is the largest in which every source that has tokens reaches its share without an
    item occurring more than its `most` times; with it, a source that runs out gives what it has. Each source's items
    come in random order (by hash), again in the same order on a further pass; the last pass ends where the quota does.
    What the item at the boundary leaves missing, less than that item, is made up from later items: SPARE of each size
    class, the largest that fits first. What is still missing then stands in the report (`missing_tokens`). A source
    without items has nothing to give; the other sources keep their proportions to one another.

    Order of the mix: a source's stream is cut into blocks of `block_tokens` tokens (to within the rounding of its weight,
    so that every source ends with the mix), and blocks of all sources are interleaved by Pfair scheduling over a cycle of
    `slots` slots. The cycle is computed once, for the weights alone, and repeats as often as the mix is long: `slot` is
    the cycle's number times its length, and the slot within. `place` is the token of its source's stream at which the
    item begins, so ordering by (slot, source, place) gives the mix. An item goes with the block that its middle falls
    into: a prefix of the mix is off a target by less than a block and half the longest item. Running token counts come
    from a distributed sort, so a source of any size spreads over many tasks.

    The report: source, target_share, max_repeats, available_tokens, quota_tokens, mixed_tokens, missing_tokens (of the
    quota), mixed_items, passes, actual_share.

    Defined results: items whose source is null or no target, and items without tokens, take no part; a null or
    non-positive share or `most` gives a source nothing; of repeated target rows of one source the largest counts;
    no items, or no targets, give no rows (the report still has each target).
    """
    spark = items.sparkSession
    wanted = targets.where(F.col(f"`{source}`").isNotNull()).groupBy(F.col(f"`{source}`").cast("string").alias("source")).agg(F.max(F.struct(F.coalesce(F.col(f"`{share}`"), F.lit(0.0)).cast("double").alias("share"), F.coalesce(F.col(f"`{most}`"), F.lit(0)).cast("bigint").alias("most"))).alias("x"))
    wanted = sorted(wanted.select("source", "x.*").limit(MOST_SOURCES + 1).collect())
    if len(wanted) > min(MOST_SOURCES, slots):
        raise ValueError("more target sources than slots, or than are allowed")
    names = [f"i{k}" for k in range(len(item))]
    rows = items.select(F.col(f"`{source}`").cast("string").alias("source"), *(F.col(f"`{c}`").alias(n) for c, n in zip(item, names)), F.col(f"`{tokens}`").cast("bigint").alias("tokens")).where("source IS NOT NULL AND tokens > 0")
    # Counting tokens costs far more than a write, and the sort below reads its input twice.
    rows = cut(rows.where(F.col("source").isin([w.source for w in wanted])).withColumn("__h", F.xxhash64(F.lit(seed), *names)))
    run = cut(running_total(rows, ["source"], ["__h", *names], "tokens", name="upto", total="have").drop("__h"))
    # One row a target source.
    have = {r.source: r.n for r in run.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    live = [w for w in wanted if have.get(w.source) and w.share > 0 and w.most > 0]
    if total_tokens is None:
        total_tokens = int(min((w.most * have[w.source] / w.share for w in live), default=0))
    quota = {w.source: min(int(w.share * total_tokens), w.most * have[w.source]) for w in live}
    given = sum(quota.values())
    counts = [max(1, c) for c in apportion([quota[w.source] for w in live], slots)] if given else []
    cycle = sum(counts)
    cycles = max(1, -(-given // (max(1, cycle) * block_tokens)))
    timetable = spark.createDataFrame([(live[s].source, b, t) for s, b, t in (pfair(counts, cycle) if given else [])], "source string, block bigint, slot bigint")
    plan = [(w.source, quota[w.source] // have[w.source], quota[w.source] % have[w.source], c, quota[w.source] / (c * cycles)) for w, c in zip(live, counts) if quota[w.source]]
    known = F.broadcast(spark.createDataFrame(plan, "source string, full bigint, rest bigint, blocks bigint, block_tokens double"))
    run = run.join(known, "source")

    # Whole passes first; then a part pass of the items up to the rest of the quota, and items that make up what is missing.
    rest = {x[0]: x[2] for x in plan}
    used = {x.source: x.n for x in run.where("upto <= rest").groupBy("source").agg(F.max("upto").alias("n")).collect()}
    lack = {k: n - used.get(k, 0) for k, n in rest.items() if n > used.get(k, 0)}
    later = run.join(F.broadcast(spark.createDataFrame(list(lack.items()), "source string, lack bigint")), "source").where("upto - tokens >= rest - lack AND tokens <= lack")
    first = F.row_number().over(Window.partitionBy("source", F.floor(F.log2("tokens"))).orderBy("upto"))
    # At most SPARE rows a source and power of two.
    spare: dict[str, list] = {}
    for x in later.withColumn("nth", first).where(f"nth <= {SPARE}").select("source", "tokens", "upto").collect() if lack else ():
        spare.setdefault(x.source, []).append((x.tokens, x.upto))
    extra = []
    for k, found in spare.items():
        at, tokens_of = rest[k] - lack[k], {p: n for n, p in found}
        for place in made_up(lack[k], found):
            at += tokens_of[place]
            extra.append((k, place, at))
    filling = F.broadcast(spark.createDataFrame(extra, "source string, upto bigint, upto_then bigint"))
    run = run.join(filling, ["source", "upto"], "left")
    last = F.when(F.col("upto") <= F.col("rest"), F.struct(F.col("full").alias("repeat_no"), F.col("upto").alias("upto"))).when(F.col("upto_then").isNotNull(), F.struct(F.col("full").alias("repeat_no"), F.col("upto_then").alias("upto")))
    whole = F.transform(F.when(F.col("full") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).otherwise(F.expr("cast(array() as array<bigint>)")), lambda n: F.struct(n.alias("repeat_no"), F.col("upto").alias("upto")))
    taken = run.withColumn("t", F.explode(F.filter(F.concat(whole, F.array(last)), lambda x: x.isNotNull())))
    taken = taken.select("source", *names, "tokens", F.col("t.repeat_no").alias("repeat_no"), (F.col("t.repeat_no") * F.col("have") + F.col("t.upto") - F.col("tokens")).alias("place"), "blocks", "block_tokens")
    middle = F.col("place") + F.col("tokens") / 2
    nth = F.least(F.floor(middle / F.col("block_tokens")).cast("bigint"), F.col("blocks") * cycles - 1)
    taken = taken.withColumn("nth", nth).withColumn("block", F.expr("nth % blocks"))
    final = taken.join(F.broadcast(timetable), ["source", "block"]).withColumn("slot", F.expr(f"nth div blocks * {cycle}L + slot"))
    mix = final.select(F.col("source").alias(source), *(F.col(n).alias(c) for n, c in zip(names, item)), F.col("repeat_no"), F.col("tokens").alias("n_tokens"), "slot", "place")

    got = mix.groupBy(F.col(source).alias("source")).agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("mixed_items"), (F.max("repeat_no") + 1).alias("passes"))
    all_targets = spark.createDataFrame([(w.source, w.share, w.most, have.get(w.source, 0), quota.get(w.source, 0)) for w in wanted], "source string, target_share double, max_repeats bigint, available_tokens bigint, quota_tokens bigint")
    zero = F.lit(0).cast("bigint")
    report = all_targets.join(got, "source", "left").select("source", "target_share", "max_repeats", "available_tokens", "quota_tokens", *(F.coalesce(c, zero).alias(c) for c in ("mixed_tokens", "mixed_items", "passes")))
    # One row a target source, at most MOST_SOURCES in all.
    all_tokens = F.sum("mixed_tokens").over(Window.partitionBy())
    report = report.withColumn("missing_tokens", F.col("quota_tokens") - F.col("mixed_tokens")).withColumn("actual_share", F.when(all_tokens > 0, F.col("mixed_tokens") / all_tokens).otherwise(0.0))
    return Mix(mix, report)
