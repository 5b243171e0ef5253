"""The language model keeps every cell (context, word) of the training texts, however many there are."""

import zlib
from collections import Counter

import numpy as np
from meshwright.llm import hpylm
from pyspark.sql import functions as F


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def test_rare_words_have_cells_of_their_own(spark):
    ids = [i for i in range(6000) if not held_out(i)]
    rows = [(i, f"a{i}zz b{i}zz a{i}zz b{i}zz") for i in ids]  # all words end alike
    some = [i for i in range(10_000, 10_400) if held_out(i)]
    for k, i in enumerate(some):
        a, b = ids[k // 2 * 7], ids[k // 2 * 7 + k % 2 * 3]  # a pair of the training texts, then a mixed one
        rows.append((i, f"a{a}zz b{b}zz"))
    got = {r["doc_id"]: r["score"] for r in hpylm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = list(zip(some[::2], some[1::2], strict=False))
    assert len(pairs) > 30 and all(got[a] - got[b] > 0.3 for a, b in pairs)


def test_cells_of_ranges_are_all_and_sum_to_one(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 60) % 300) for _ in range(150)]
    want = Counter()
    for t in texts:
        w = [" ", *t.split(), " "]
        want.update(zip(w, w[1:], strict=False))
    model = hpylm.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("train", F.lit(True)))
    words = sorted({w for pair in want for w in pair})
    h = np.array([hpylm.WordHashes()[w.encode()] for w in words], np.uint64)
    number = dict(zip(words, np.searchsorted(model.of("hashes", "<u8"), h).tolist(), strict=True))
    keys, gain = (np.concatenate(x) for x in zip(*(model.range_gains(p) for p in range(model.ranges)), strict=True))
    assert sorted(keys.tolist()) == sorted(number[u] << 32 | number[w] for u, w in want) and (gain > 0).all()
    base, weight = 10 ** model.of("log_base", "<f8"), 10 ** model.of("log_weight", "<f8")
    unknown = np.mean([model.base(np.zeros(1), np.zeros(1), k)[0] for k in model.kept])
    p = weight[:, None] * base[None, :]
    p[keys >> 32, keys & hpylm.LOW] *= 10**gain
    assert np.allclose(p.sum(1) + weight * unknown, 1)


def test_frequent_cells_only_save_travel(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the cat {i % 7} the cat sat {i}") for i in range(200)], "doc_id long, text string")
    ask = lambda: {r["doc_id"]: round(r["score"], 9) for r in hpylm.score(docs).collect()}
    sent = ask()
    monkeypatch.setattr(hpylm, "FREQUENT", 1)  # none is sent to all workers
    assert ask() == sent
