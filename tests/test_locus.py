import pytest
from pyspark.sql import functions as F

from lociweave.functions.locus import Locus, LocusInterval, SplitPoints, contig_name, contig_ordinal, interval_index, pack, packed_ordinal, packed_position


def test_ordinals(spark):
    names = ["chr1", "chr01", "chr001", "chr22", "chrX", "chr", "1", "chr1 ", "CHR1", None, "chr2147483647", "chr2147483648", "chr99999999999", "chr0", "chr00", "chr-1", "xchr1"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    got = [r[0] for r in df.select(contig_ordinal(F.col("c"))).collect()]
    assert got == [1, 1, 1, 22, None, None, None, None, None, None, 2147483647, None, None, 0, 0, None, None]
    assert spark.range(1).select(contig_name(F.lit(7)), contig_name(F.lit(123))).first()[:] == ("chr07", "chr123")


def test_packing_round_trip(spark):
    loci = [Locus(0, 0), Locus(1, 1), Locus(22, 2**31 - 1), Locus(2**31 - 1, 5)]
    df = spark.createDataFrame([(x.ordinal, x.position) for x in loci], "o int, p int").withColumn("l", pack(F.col("o"), F.col("p")))
    for x, r in zip(loci, df.select("l", packed_ordinal(F.col("l")), packed_position(F.col("l"))).collect()):
        assert r[:] == (x.packed, x.ordinal, x.position) and Locus.unpack(x.packed) == x


@pytest.mark.parametrize("text", ["", "1", "1:", ":1", "a:1", "1:-1", "1:2:3", "chrX:1"])
def test_bad_loci(text):
    with pytest.raises(ValueError):
        Locus.parse(text)


def test_split_points():
    p = SplitPoints.parse("1:3, chr01:6,2:1")
    assert str(p) == "1:3,1:6,2:1" and len(p.intervals()) == 4 and SplitPoints([]).intervals() == [LocusInterval()]
    for bad in ("1:3,1:3", "2:1,1:1", " "):
        with pytest.raises(ValueError):
            SplitPoints.parse(bad)
    for bad in (-1, 2**31):
        with pytest.raises(ValueError):
            Locus.unpack(bad)


def test_interval_predicates_agree(spark):
    loci = [Locus(o, p) for o in (1, 2, 3) for p in (1, 5, 9)]
    df = spark.createDataFrame([(x.contig, x.position, x.packed) for x in loci], "contig string, position int, locus bigint")
    bounds = [None, Locus(1, 5), Locus(2, 1), Locus(2, 6), Locus(9, 9)]
    for low in bounds:
        for high in bounds:
            i = LocusInterval(low, high)
            want = [x.packed for x in loci if i.contains(x)]
            for how in ({"packed": F.col("locus")}, {"contig": F.col("contig"), "position": F.col("position")}):
                assert sorted(r.locus for r in df.where(i.predicate(**how)).collect()) == want
    points = SplitPoints([Locus(1, 5), Locus(2, 6)])
    for how in ({"packed": F.col("locus")}, {"contig": F.col("contig"), "position": F.col("position")}):
        got = {r.locus: r.i for r in df.select("locus", interval_index(points, **how).alias("i")).collect()}
        assert all(points.intervals()[got[x.packed]].contains(x) for x in loci)


def test_predicate_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("'chr01' AS contig", "int(id) AS position", "id AS other").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(LocusInterval(Locus(1, 3)).predicate(contig=F.col("contig"), position=F.col("position"))).select("position")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(GreaterThan(contig,chr01)" in plan and "other" not in plan.split("ReadSchema")[1]


def test_named_contigs_reach_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from lociweave.functions.locus import named_contig

    names = ["chr3", "chr03", "chr003", "chr13", "chr30", "chr", "x3", "chr3a", None, "chr12", "chr99999999999"]
    spark.createDataFrame([(n,) for n in names], "contig string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = lambda r: sorted(x.contig for x in df.where(named_contig(F.col("contig"), r)).collect())
    assert got(range(3, 4)) == ["chr003", "chr03", "chr3"] and got(range(12, 14)) == ["chr12", "chr13"] and len(got(range(0, 1000))) == 6
    plan = df.where(named_contig(F.col("contig"), range(3, 4)))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(contig,chr)" in plan and "StringEndsWith(contig,3)" in plan
