import random
import unicodedata

import numpy as np

from tessella.llm import leakage as lk
from tessella.llm.codepoints import exact, fold, fold_all


def norm(t):
    return "".join(c for c in unicodedata.normalize("NFKC", t or "").lower() if c.isalnum())


def brute(docs, items, run=lk.RUN):
    held = {(i, x[k : k + run]) for i, *fields in items for f in fields for x in [norm(f)] for k in range(len(x) - run + 1)}
    return {(d, i) for d, t in docs for x in [norm(t)] for i, piece in held if piece in x}


def corpus(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(chr(rnd.randrange(0x4E00, 0x4E40)) for _ in range(rnd.randrange(2, 9)))
    text = lambda n: "，".join(word() for _ in range(n)) + "。"
    items = [(i, text(30), text(40)) for i in range(12)] + [(50, "Ａｂｃ ﬁne " * 20, None), (51, "短", "")]
    docs = [(k, text(rnd.randrange(1, 60))) for k in range(40)]
    for k in range(40, 90):
        i, q, a = rnd.choice(items[:12])
        src = rnd.choice([q, a])
        raw = norm(src)
        n = rnd.choice([36, 38, 39, 40, 41, 45, 70])
        s = rnd.randrange(0, len(raw) - n)
        piece = rnd.choice([" ", "\n", "·", ""]).join(raw[s : s + n])
        docs.append((k, text(rnd.randrange(0, 30)) + piece + text(rnd.randrange(0, 20))))
    return docs + [(200, "abc fine " * 8), (201, None), (202, ""), (203, items[0][1]), (203, items[0][1]), (204, text(3000) + items[1][2] + text(3000))], items


def test_against_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, question string, answer string")
    for block in (lk.BLOCK_CHARS, 1500):  # passages in one block or in several
        got = [(r.doc_id, r.item_id) for r in lk.find_leaks(d, "doc_id", "text", i, "item_id", ["question", "answer"], block_chars=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert lk.find_leaks(d.limit(0), "doc_id", "text", i, "item_id", ["question"]).count() == 0
    assert lk.find_leaks(d, "doc_id", "text", i.limit(0), "item_id", ["question"]).count() == 0


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    index = lk.Index([0], [fold("窗口" * 30)], lk.WINDOW, 3)
    index.fp = base
    index.of = index.at = np.arange(300)
    index.tables = []
    for b in range(index.blocks):
        v = index.block(base, b)
        order = np.argsort(v, kind="stable")
        index.tables.append((order.astype(np.int32), np.searchsorted(v[order], np.arange((1 << index.width) + 1)).astype(np.int64)))
    probe = base.copy()
    for k in range(300):
        for bit in rng.choice(64, rng.integers(0, 6), replace=False):
            probe[k] ^= np.uint64(1) << np.uint64(bit)
    who, win = index.near(probe)
    distance = np.bitwise_count(probe[:, None] ^ base[None, :])
    assert set(zip(who.tolist(), win.tolist())) == set(zip(*map(lambda x: x.tolist(), np.nonzero(distance <= 3))))


def test_similar_windows_have_near_fingerprints():
    a = fold("由福兰机构出具的天杉报告列明一五七八三处瑕疵由广荷机构出具的成河报告")
    f = lk.fingerprints(a, np.array([0, 1]), lk.WINDOW)
    assert np.bitwise_count(f[0] ^ f[1]) < 20 and lk.weighted_similarity(a[:24].tobytes(), a[:24].tobytes()) == 1


def test_folding_equals_the_exact_way():
    texts = ["Ａ１，ﬁ½Ⅷ㎡ ΣΑΣ Å é ｶﾞ ﾊﾟ", "中文，Ｑ＆Ａ", None, "", "한글 가 İı", "😀𠮷𝐀ß"]
    for t in texts:
        assert fold(t).tolist() == (exact(t).tolist() if t else [])
    a, bounds = fold_all(texts)
    assert [a[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:])] == [fold(t).tolist() for t in texts]


def test_short_text_that_nfkc_lengthens(spark):
    """Three signs of 15 letters each are a run of 45."""
    docs = spark.createDataFrame([(1, "\ufdfa" * 3), (2, "\ufdfa" * 2), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, unicodedata.normalize("NFKC", "\ufdfa" * 3), None)], "item_id long, question string, answer string")
    got = lk.find_leaks(docs, "doc_id", "text", items, "item_id", ["question", "answer"])
    assert [tuple(r) for r in got.collect()] == [(1, 7)]


def test_whole_passages_with_edits_against_brute_force(spark):
    rnd = random.Random(8)
    han = [chr(0x4E00 + rnd.randrange(900)) for _ in range(400)]
    items = [(k, "".join(rnd.choice(han) for _ in range(rnd.randrange(60, 120))), None) for k in range(8)]

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            t[rnd.randrange(len(t))] = rnd.choice(["", "改", "一，二"])
        return "".join(t)

    texts = [(0, None), (1, ""), (2, items[0][1][:50])]
    for d in range(3, 40):
        k = rnd.randrange(8)
        texts.append((d, "".join(rnd.choice(han) for _ in range(rnd.randrange(80))) + edited(items[k][1], rnd.randrange(4)) + "".join(rnd.choice(han) for _ in range(rnd.randrange(80)))))
    folded = {i: lk.fold(q) for i, q, _ in items}

    def brute(t, p):
        return max((lk.weighted_similarity(t[s : s + len(p)].tobytes(), p.tobytes()) for s in range(max(1, len(t) - len(p) + 1))), default=0)

    want = {}
    for d, t in texts:
        for i, p in folded.items():
            s = brute(lk.fold(t), p)
            if s >= 0.8:
                want[d, i] = s
    corpus = spark.createDataFrame([(d, t, "x") for d, t in texts] * 2, "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id): r.similarity for r in lk.find_near(corpus, "doc_id", "text", spark.createDataFrame(items, "item_id long, question string, answer string"), "item_id", ["question", "answer"]).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) > 20
    assert all(s <= want[k] + 1e-9 for k, s in got.items())
    none = lk.find_near(corpus, "doc_id", "text", spark.createDataFrame([], "item_id long, question string, answer string"), "item_id", ["question", "answer"])
    assert none.count() == 0


def test_blocks_of_passages_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(lk, "PASS_BLOCKS", 2)
    rnd = random.Random(9)
    items = [(k, "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(60)), None) for k in range(20)]
    corpus = spark.createDataFrame([(k, "前" + q[:45] + "后") for k, q, _ in items], "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, question string, answer string")
    got = {(r.doc_id, r.item_id) for r in lk.find_leaks(corpus, "doc_id", "text", frame, "item_id", ["question", "answer"], block_chars=400).collect()}
    assert got == {(k, k) for k in range(20)}
