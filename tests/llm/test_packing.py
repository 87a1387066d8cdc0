import os

import numpy as np
import pytest

from lociweave.llm.packing import pack, packed
from lociweave.llm.tokens import VOCABULARY, counted, with_tokens


def test_pack_respects_every_limit_and_fills():
    r = np.random.default_rng(2)
    sizes = np.stack([r.integers(1, 60, 3000), np.ones(3000, int), r.integers(0, 40, 3000)], axis=1)
    limits = np.array([100, 6, 80])
    got = pack(sizes, limits)
    totals = np.zeros((got.max() + 1, 3), int)
    np.add.at(totals, got, sizes)
    assert (totals <= limits).all()
    least = np.ceil(sizes.sum(axis=0) / limits).max()
    assert got.max() + 1 <= 1.05 * least


def test_pack_is_deterministic_and_takes_few_items():
    one = np.array([[5, 1, 4]])
    assert pack(one, np.array([10, 4, 10])).tolist() == [0]
    assert pack(np.repeat(one, 5, axis=0), np.array([10, 4, 10])).tolist() == [0, 0, 1, 1, 2]


def test_pack_refuses_what_never_fits():
    with pytest.raises(ValueError):
        pack(np.array([[11, 1, 1]]), np.array([10, 4, 10]))


def check(rows, cap, most):
    by = {}
    for r in rows:
        if r.container is not None:
            by.setdefault(r.container, []).append(r)
    for c in by.values():
        assert sum(x.n_tokens for x in c) <= cap and len(c) <= most
    return by


@pytest.mark.parametrize("block", [40, 10_000])
def test_items_are_split_only_beyond_the_capacity(spark, block):
    data = [(i, 1 + (i * 37) % 50) for i in range(300)] + [(900, 64), (901, 65), (902, 1000), (903, 0), (904, None), (905, 7), (905, 7)]
    df = spark.createDataFrame([(i, n, "x") for i, n in data], "id bigint, n bigint, container string").repartition(4)
    packs = spark.createDataFrame([("p", 64), ("q", 8192), ("p", 64), ("z", None), ("y", 0)], "pack_name string, capacity_tokens int")
    got = packed(df, ["id"], "n", packs, block_items=block).collect()
    for name, cap in (("p", 64), ("q", 8192)):
        rows = [r for r in got if r.pack_name == name]
        by = check(rows, cap, max(4, cap // 16))
        pieces = {}
        for r in rows:
            pieces.setdefault(r.id, []).append((r.first_token, r.n_tokens))
        assert set(pieces) == {i for i, _ in data}
        for i, n in dict(data).items():
            p = sorted(pieces[i])
            if i == 905:
                assert p == [(0, 7), (0, 7)]
            else:
                assert [a for a, _ in p] == list(range(0, max(n or 0, 1), cap)) and sum(x for _, x in p) == (n or 0)
        assert all(r.container is None for r in rows if r.id in (903, 904))
        assert by
    assert {r.pack_name for r in got} == {"p", "q"}


@pytest.mark.parametrize("parts", [1, 7])
def test_the_loss_limit_holds_and_partitions_change_nothing(spark, parts):
    r = np.random.default_rng(5)
    data = [(int(i), int(n), int(x)) for i, (n, x) in enumerate(zip(r.integers(1, 90, 600), r.integers(0, 70, 600)))] + [(900, 30, 80), (901, 250, 240), (902, 20, None), (902, 20, None)]
    df = spark.createDataFrame(data, "id bigint, n bigint, lost bigint").repartition(parts)
    packs = spark.createDataFrame([("p", 100)], "pack_name string, capacity_tokens int")
    got = packed(df, ["id"], "n", packs, loss_tokens="lost", loss_share=0.5, block_items=200).collect()
    by = check(got, 100, 6)
    for c in by.values():
        assert len(c) == 1 or sum(x.loss_tokens for x in c) <= 50
    assert any(len(c) > 1 and sum(x.loss_tokens for x in c) > 40 for c in by.values())
    of = {}
    for x in got:
        of[x.id] = of.get(x.id, 0) + x.loss_tokens
    assert all(of[i] == (x or 0) for i, _, x in data if i != 902) and sum(x.id == 902 for x in got) == 2
    once = packed(df.coalesce(1), ["id"], "n", packs, loss_tokens="lost", loss_share=0.5, block_items=200).collect()
    key = lambda x: (x.id, x.piece, x.container)
    assert sorted(map(key, got)) == sorted(map(key, once))


def test_one_group_of_copies_spreads_over_blocks(spark):
    df = spark.createDataFrame([(1, 9)] * 4000, "id bigint, n bigint").repartition(4)
    got = packed(df, ["id"], "n", spark.createDataFrame([("p", 256)], "pack_name string, capacity_tokens int"), block_items=500).collect()
    assert len(got) == 4000
    by = check(got, 256, 16)
    assert len(by) <= 4000 // 16 + 8 + 8


def test_empty(spark):
    packs = spark.createDataFrame([("p", 64)], "pack_name string, capacity_tokens int")
    assert packed(spark.createDataFrame([], "id bigint, n bigint"), ["id"], "n", packs).count() == 0
    assert packed(spark.createDataFrame([(1, 5)], "id bigint, n bigint"), ["id"], "n", packs.where("false")).count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_tokens_of_whole_texts(spark):
    long = "the quick brown fox " * 60_000
    texts = ["", None, "Hello, world!", "<|endoftext|>", long, "Привет"]
    n = counted(texts, VOCABULARY)
    assert n[:2] == [0, 0] and n[2] == 4 and n[3] > 1 and n[4] >= 4 * 60_000
    assert counted(texts, VOCABULARY.replace(".tiktoken", ".json")) == n
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, n_tokens string")
    got = {x.id: x.n_tokens for x in with_tokens(df, "text", keep=["id"]).collect()}
    assert [got[i] for i in range(6)] == n
