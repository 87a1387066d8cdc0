"""Loci as Columns: contig ordinals, packing, interval predicates.

A locus is a contig ordinal (0 to 2^31-1) and a position (0 to 2^31-1). Contigs are written `chr%02d` and read as
`chr<digits>`, padded or not. A name without such an ordinal has a null ordinal; nothing here raises on bad data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX = 2**31 - 1
#: Most ordinals that are looked for by the ends of names.
MOST_ENDS = 64


def contig_ordinal(contig: Column) -> Column:
    """Ordinal (int) of a contig name, or null where the name has none or a number beyond an int.

    Plain string functions, which cost a fraction of a regular expression a row: nothing but `chr` may be left once the
    digits are taken out, and it must come first.
    """
    named = contig.startswith("chr") & (F.translate(contig, "0123456789", "") == "chr")
    return F.when(named, F.substring(contig, 4, INT_MAX).try_cast("int"))


def named_contig(contig: Column, ordinals: range) -> Column:
    """Whether a contig name, padded or not, has one of the ordinals.

    The exact test is no filter that a file can use, so one that it can stands before it: how such names begin and end.
    """
    ends = reduce(or_, (contig.endswith(str(o)) for o in ordinals)) if len(ordinals) <= MOST_ENDS else F.lit(True)
    return contig.startswith("chr") & ends & contig_ordinal(contig).between(ordinals.start, ordinals.stop - 1)


def contig_name(ordinal: Column) -> Column:
    """`chr%02d`, null for null; format_string costs far more a row and spells a null out."""
    return F.concat(F.lit("chr"), F.when(ordinal.between(0, 9), F.lit("0")).otherwise(F.lit("")), ordinal.cast("string"))


def pack(ordinal: Column, position: Column) -> Column:
    """ordinal * 2^32 + position as a bigint."""
    return F.shiftleft(ordinal.cast("bigint"), 32).bitwiseOR(position.cast("bigint"))


def packed_ordinal(locus: Column) -> Column:
    return F.shiftright(locus, 32).cast("int")


def packed_position(locus: Column) -> Column:
    return locus.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")).cast("int")


@dataclass(frozen=True, order=True)
class Locus:
    """A locus on the driver, ordered by ordinal, then position."""

    ordinal: int
    position: int

    def __post_init__(self) -> None:
        if not 0 <= self.ordinal <= INT_MAX or not 0 <= self.position <= INT_MAX:
            raise ValueError(f"locus out of range: {self.ordinal}:{self.position}")

    @classmethod
    def parse(cls, text: str) -> Locus:
        contig, sep, position = text.strip().partition(":")
        contig = contig.removeprefix("chr")
        if not sep or not (contig.isascii() and contig.isdigit() and position.isascii() and position.isdigit()):
            raise ValueError(f"not a locus: {text!r}")
        return cls(int(contig), int(position))

    @classmethod
    def unpack(cls, packed: int) -> Locus:
        if packed < 0 or packed & 0xFFFFFFFF > INT_MAX:
            raise ValueError(f"not a packed locus: {packed}")
        return cls(packed >> 32, packed & 0xFFFFFFFF)

    @property
    def contig(self) -> str:
        return f"chr{self.ordinal:02d}"

    @property
    def packed(self) -> int:
        return self.ordinal << 32 | self.position

    def __str__(self) -> str:
        return f"{self.ordinal}:{self.position}"


class SplitPoints(tuple):
    """Strictly increasing loci; k points cut the loci into k+1 half-open intervals."""

    def __new__(cls, loci=()):
        loci = tuple(loci)
        if any(a >= b for a, b in zip(loci, loci[1:])):
            raise ValueError("split points must increase strictly")
        return super().__new__(cls, loci)

    @classmethod
    def parse(cls, text: str) -> SplitPoints:
        if not text.strip():
            raise ValueError("no split points given")
        return cls(Locus.parse(x) for x in text.split(","))

    def __str__(self) -> str:
        return ",".join(map(str, self))

    def intervals(self) -> list[LocusInterval]:
        bounds = [None, *self, None]
        return [LocusInterval(a, b) for a, b in zip(bounds, bounds[1:])]


@dataclass(frozen=True)
class LocusInterval:
    """Half-open stretch of loci; None is unbounded."""

    low: Locus | None = None
    high: Locus | None = None

    def contains(self, locus: Locus) -> bool:
        return (self.low is None or locus >= self.low) and (self.high is None or locus < self.high)

    def predicate(self, packed: Column | None = None, contig: Column | None = None, position: Column | None = None) -> Column:
        """True for rows of this interval, in a form that Parquet filters can use.

        Contigs compare as text in their two-digit spelling, as the files hold them.
        """
        parts = []
        if packed is not None:
            if self.low is not None:
                parts.append(packed >= self.low.packed)
            if self.high is not None:
                parts.append(packed < self.high.packed)
            return reduce(and_, parts) if parts else F.lit(True)
        if self.low is not None:
            parts.append((contig > self.low.contig) | ((contig == self.low.contig) & (position >= self.low.position)))
        if self.high is not None:
            parts.append((contig < self.high.contig) | ((contig == self.high.contig) & (position < self.high.position)))
        return reduce(and_, parts) if parts else F.lit(True)


def interval_index(points: SplitPoints, packed: Column | None = None, contig: Column | None = None, position: Column | None = None) -> Column:
    """Index (int) of the interval of `points` that a row falls into."""
    index = F.lit(len(points))
    for i in reversed(range(len(points))):
        below = LocusInterval(None, points[i]).predicate(packed, contig, position)
        index = F.when(below, F.lit(i)).otherwise(index)
    return index.cast("int")
