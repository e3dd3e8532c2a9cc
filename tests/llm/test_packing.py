import random

import numpy as np
import pytest

from tessella.llm import packing as pk
from tessella.llm.queries import TOKENIZER


def used(patterns):
    out = {}
    for sizes, times in patterns:
        for s in sizes:
            out[s] = out.get(s, 0) + times
    return out


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_up_the_histogram(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([50, 200, 2048])
    h = {rnd.randrange(1, capacity): rnd.randrange(1, 2000 if seed else 3) for _ in range(120)}
    p = pk.plan(h, capacity)
    assert used(p) == h and all(sum(s) <= capacity and t > 0 for s, t in p)
    boxes, lower = sum(t for _, t in p), -(-sum(s * n for s, n in h.items()) // capacity)
    assert boxes <= lower * 1.25 + 60


def test_large_histogram_is_filled_well():
    rng = np.random.default_rng(0)
    sizes, n = np.unique(np.clip(rng.lognormal(6, 0.8, 200000).astype(int), 1, 2047), return_counts=True)
    h = dict(zip(sizes.tolist(), n.tolist()))
    p = pk.plan(h, 2048)
    assert used(p) == h
    assert sum(s * n for s, n in h.items()) / (2048 * sum(t for _, t in p)) > 0.99


def test_nnls_against_exact_solution():
    table = np.array([[5, 5, 0, 0], [7, 3, 0, 0], [10, 0, 0, 0]])
    h = np.zeros(11)
    h[[5, 7, 3, 10]] = 20, 4, 4, 3
    assert pk.nnls(table, h, 2000) == pytest.approx([10, 4, 3], abs=1e-2)
    assert len(pk.nnls(np.zeros((0, 4), int), h)) == 0


def test_frame(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([17, 17, 17, 40, 99, 100, 250, rnd.randrange(1, 100)])) for i in range(700)] + [(5000, 0), (5001, 0), (1, 17), (1, 17), (None, 30)]
    df = spark.createDataFrame(rows, "k int, tokens long").withColumn("copy", pk.F.lit("x")).withColumn("offset", pk.F.lit(1))
    out = pk.pack(df, "k", 100).toPandas()
    assert out.groupby("container").tokens.sum().max() <= 100
    assert out.tokens.sum() == sum(n for _, n in rows)
    for _, g in out[out.tokens > 0].groupby("container"):
        g = g.sort_values("offset")
        assert (g.offset.iloc[1:].to_numpy() >= (g.offset + g.tokens).iloc[:-1].to_numpy()).all()
    whole = out[~out.k.isin([i for i, n in rows if n > 100])]
    assert (whole.start == 0).all() and not out.duplicated(["k", "copy", "piece_no", "tokens", "start", "container", "offset"]).any()
    assert out.container.nunique() <= -(-out.tokens.sum() // 100) * 1.1 + 3
    assert pk.pack(df.limit(0), "k", 100).count() == 0
    again = pk.pack(df.repartition(7), "k", 100).toPandas()
    key = ["k", "copy", "piece_no", "tokens"]
    assert out.sort_values(key).reset_index(drop=True).drop(columns=["container", "offset"]).equals(again.sort_values(key).reset_index(drop=True).drop(columns=["container", "offset"]))


def test_tokens(spark):
    df = spark.createDataFrame([(1, "公司公告 abc"), (2, None), (3, ""), (4, "长" * 20000)], "k int, t string")
    got = {r.k: r.tokens for r in pk.token_counts(df, "k", "t", TOKENIZER).collect()}
    assert got[2] == got[3] == 0 and 0 < got[1] < 20 and got[4] > 1000
