"""Declared row orderings, their check against a plan, and their check against rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Components an ordering may declare, in their order. Fixed values.
COMPONENTS = ("locus", "alleles", "s")
REPRESENTATIONS = {"contig-position": ("contig", "position"), "packed": ("locus",)}


class OrderingAssertionFailed(ValueError):
    """A frame isn't in the order that was claimed for it."""


def representation(columns: list[str]) -> str:
    """Which of the two ways columns hold a locus."""
    has = {"packed": "locus" in columns, "contig-position": "contig" in columns}
    if sum(has.values()) != 1:
        raise ValueError(f"exactly one of the columns locus and contig is needed, among {sorted(columns)}")
    found = next(k for k, v in has.items() if v)
    if found == "contig-position" and "position" not in columns:
        raise ValueError("a contig column needs a position column")
    return found


@dataclass(frozen=True)
class RowOrdering:
    """An ordering such as `locus`, `locus,alleles` or `locus,s`; independent of how loci are stored."""

    components: tuple[str, ...]

    @classmethod
    def parse(cls, text: str) -> RowOrdering:
        parts = tuple(x.strip() for x in text.split(","))
        if unknown := [p for p in parts if p not in COMPONENTS]:
            raise ValueError(f"unknown ordering component: {', '.join(unknown)}")
        if len(set(parts)) != len(parts) or parts[:1] != ("locus",):
            raise ValueError(f"an ordering begins with locus and names each component once: {text!r}")
        return cls(parts)

    def __str__(self) -> str:
        return ",".join(self.components)

    def starts_with(self, other: RowOrdering) -> bool:
        return self.components[: len(other.components)] == other.components

    def columns(self, stored: list[str]) -> list[str]:
        """The stored columns that this ordering sorts by; all of them must exist."""
        locus = REPRESENTATIONS[representation(stored)]
        out = [c for p in self.components for c in (locus if p == "locus" else (p,))]
        if missing := [c for c in out if c not in stored]:
            raise ValueError(f"the ordering {self} needs the columns {', '.join(missing)}")
        return out

    def keys(self, stored: list[str]) -> list[Column]:
        return ascending(self.columns(stored))


def ascending(columns: list[str]) -> list[Column]:
    """Ascending, nulls last."""
    return [F.col(f"`{c}`").asc_nulls_last() for c in columns]


@dataclass(frozen=True)
class OrderedFrame:
    """Deferred rows, the columns they are ordered by, and how they shall be laid out in files."""

    df: DataFrame
    ordering: tuple[str, ...]
    layout: str = "single-file"
    points: tuple = ()

    def limit(self, n: int) -> OrderedFrame:
        """The first n rows: a top-k over the sort, never a sort of everything."""
        return OrderedFrame(self.df.limit(n), self.ordering, self.layout, self.points)


#: Operators of the optimized plan that keep the order of their only input. Fixed values.
KEEPING = ("Project", "Filter", "GlobalLimit", "LocalLimit", "SubqueryAlias", "Offset")


def held(frame: DataFrame, ordering: list[str], scope: str = "one-partition") -> DataFrame:
    """`frame`, if its plan shows that it is ordered by `ordering`; else OrderingAssertionFailed, before anything runs.

    Scope `one-partition` asks for a global sort, `each-partition` also takes a sort inside partitions. Only operators
    that keep order may lie above the sort, and its keys must begin with the ordering, ascending and nulls last.
    """
    if scope not in ("one-partition", "each-partition"):
        raise ValueError(f"unknown scope: {scope}")
    if not ordering:
        raise ValueError("an ordering assertion needs at least one column")
    node = frame._jdf.queryExecution().optimizedPlan()
    names = {a.exprId().toString(): a.name() for a in _seq(node.output())}
    wanted = list(ordering)
    while node.nodeName() in KEEPING:
        if node.nodeName() == "Project":
            # A renamed key is followed to the column it renames.
            for e in _seq(node.projectList()):
                if e.nodeName() == "Alias" and e.child().nodeName() == "AttributeReference":
                    old = e.child()
                    if e.name() in wanted:
                        names[old.exprId().toString()] = e.name()
        node = node.children().head()
    if node.nodeName() != "Sort":
        raise OrderingAssertionFailed(f"the plan is not ordered by {', '.join(ordering)}: {node.nodeName()} keeps no order")
    if scope == "one-partition" and not getattr(node, "global")():
        raise OrderingAssertionFailed("the plan is ordered inside each partition only")
    keys = []
    for o in _seq(node.order()):
        child = o.child()
        name = names.get(child.exprId().toString(), child.name()) if child.nodeName() == "AttributeReference" else child.toString()
        if not re.search(r"ASC NULLS LAST$", o.sql()):
            name = f"{name} ({o.sql().rsplit('`', 1)[-1].strip() or 'other'})"
        keys.append(name)
    if keys[: len(wanted)] != wanted:
        raise OrderingAssertionFailed(f"the plan is ordered by {', '.join(keys)}, not by {', '.join(wanted)}")
    return frame


def _seq(seq) -> list:
    return [seq.apply(i) for i in range(seq.length())]


def order_violations(df: DataFrame, ordering: list[str], *, strict: bool = False) -> DataFrame:
    """Rows (partition, row_in_partition from 0) that come before the row ahead of them, as the partitions lie now.

    Compares neighbours inside each partition, and the first row of a partition with the last of the one before it.
    `strict` also reports equal neighbours. Nulls count as last. Rows are written once to the shared folder, so that the
    numbers hold for the comparison.
    """
    cols = [F.col(f"`{c}`") for c in ordering]
    # Nulls last: a flag before each value makes the struct comparison agree.
    key = F.struct(*(x for i, c in enumerate(cols) for x in (c.isNull().alias(f"n{i}"), c.alias(f"v{i}"))))
    rid = F.monotonically_increasing_id()
    rows = cut(df.select(key.alias("k"), rid.alias("r"))).withColumn("p", F.shiftright("r", 33)).withColumn("i", F.col("r").bitwiseAND(F.lit((1 << 33) - 1)))
    tile = F.shiftright("i", 16)
    inside = rows.withColumn("t", tile)
    w = Window.partitionBy("p", "t").orderBy("r")
    near = inside.withColumn("before", F.lag("k").over(w))
    # The first row of a tile faces the last of the tile before it, and so do partitions; one row each meets here.
    ends = inside.groupBy("p", "t").agg(F.min_by("k", "r").alias("head"), F.min("r").alias("first"), F.max_by("k", "r").alias("tail"))
    tiles = ends.withColumn("before", F.lag("tail").over(Window.partitionBy("p").orderBy("t")))
    parts = ends.groupBy("p").agg(F.min_by("head", "first").alias("head"), F.min("first").alias("first"), F.max_by("tail", "first").alias("tail"))
    # As many rows as the frame has partitions.
    parts = parts.withColumn("before", F.lag("tail").over(Window.orderBy("p")))
    edge = tiles.select("first", "before", "head").unionByName(parts.select("first", "before", "head"))
    bad = (lambda b, k: b >= k) if strict else (lambda b, k: b > k)
    a = near.where(F.col("before").isNotNull() & bad(F.col("before"), F.col("k"))).select("r")
    b = edge.where(F.col("before").isNotNull() & bad(F.col("before"), F.col("head"))).select(F.col("first").alias("r"))
    both = a.unionByName(b)
    return both.select(F.shiftright("r", 33).alias("partition"), F.col("r").bitwiseAND(F.lit((1 << 33) - 1)).alias("row_in_partition"))


def verify_order(df: DataFrame, ordering: list[str], *, strict: bool = False) -> None:
    """Raise OrderingAssertionFailed with the first row that is out of order, if one is."""
    first = order_violations(df, ordering, strict=strict).orderBy("partition", "row_in_partition").limit(1).collect()
    if first:
        raise OrderingAssertionFailed(f"row {first[0][1]} of partition {first[0][0]} is out of order")
