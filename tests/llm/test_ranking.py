import random

import numpy as np
import pandas as pd

from tessella.llm import ranking

M = ["faiss", "bm25", "rerank"]


def brute(rows, average):
    df = pd.DataFrame(rows, columns=["query_id", "modal", "id", "score_raw"])
    df = df[df.modal.isin(M) & df.id.notna() & df.query_id.notna()]
    df = df.groupby(["query_id", "modal", "id"], as_index=False).score_raw.max()
    out = {}
    for q, g in df.groupby("query_id"):
        ids = sorted(g.id.unique())
        v = np.zeros((len(ids), 3))
        for k, m in enumerate(M):
            s = g[g.modal == m].set_index("id").score_raw.reindex(ids)
            v[:, k] = (1 - (s.rank(ascending=False, method="average") - 0.5) / max(1, s.notna().sum())).fillna(0)
        low = np.sort(v, axis=1).round(9)
        key = [(-round(v[i].mean(), 9) if average else 0, *(-low[i]), ids[i]) for i in range(len(ids))]
        out[q] = [ids[i] for i in sorted(range(len(ids)), key=lambda i: key[i])]
    return out


def data(seed=1):
    rnd = random.Random(seed)
    rows = [(q, m, f"d{i}", rnd.choice([None, float("nan"), rnd.choice([1.0, 2.0, 3.0]), rnd.expovariate(1) * 10**q])) for q in range(4) for m in [*M, "other"] for i in range(25) if rnd.random() < 0.8]
    return rows + rows[:40] + [(None, "faiss", "x", 1.0), (1, "faiss", None, 2.0)]


def test_against_brute_force(spark):
    rows = data()
    df = spark.createDataFrame([(*r, "extra", 5) for r in rows], "query_id int, modal string, id string, score_raw double, position string, candidates int")
    for order in ("leximin", "average"):
        want = brute([(q, m, i, None if s is None or s != s else s) for q, m, i, s in rows], order == "average")
        for hot in (ranking.HOT_ROWS, 3):  # the split of hot groups must not change ranks
            got = ranking.rank_candidates(df, "query_id", "id", "modal", "score_raw", M, 6, order, hot).toPandas()
            assert {q: g.sort_values("position").id.tolist() for q, g in got.groupby("query_id")} == {q: v[:6] for q, v in want.items()}


def test_weak_scores_are_not_masked(spark):
    rows = [(1, "faiss", "strong", 9.0), (1, "bm25", "strong", 900.0), (1, "faiss", "even", 5.0), (1, "bm25", "even", 500.0), (1, "rerank", "even", 0.2), (1, "rerank", "weak", 0.1)]
    got = ranking.rank_candidates(spark.createDataFrame(rows, "query_id int, modal string, id string, score_raw double"), "query_id", "id", "modal", "score_raw", M, 3).toPandas()
    assert got.sort_values("position").id.iloc[0] == "even"


def test_one_score_shared_by_a_third_of_a_hot_group(spark):
    rnd = random.Random(4)
    rows = [(1, m, f"d{i:04}", 5.0 if i % 3 == 0 else rnd.random() * 10) for m in M for i in range(900)] + [(2, "faiss", "x", 1.0)]
    df = spark.createDataFrame(rows, "query_id int, modal string, id string, score_raw double")
    want = brute(rows, True)
    got = ranking.rank_candidates(df, "query_id", "id", "modal", "score_raw", M, 900, "average", 100).toPandas()
    assert {q: g.sort_values("position").id.tolist() for q, g in got.groupby("query_id")} == want


def test_empty(spark):
    df = spark.createDataFrame([], "query_id int, modal string, id string, score_raw double")
    assert ranking.rank_candidates(df, "query_id", "id", "modal", "score_raw", M, 5).count() == 0
