"""Operators 1, 2, 4 and 8 against their definitions."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from calibrant.llm import op1_topk as op1
from calibrant.llm import op2_shards as op2
from calibrant.llm import op4_simhash as op4
from calibrant.llm import op8_bpe as op8
from calibrant.llm.common import Scratch

SCHEMA = "doc_id long, text string, shard int, fp string, ids string"
FILE = public_tokenizers.path("byte_bpe_50k.json")


def texts(seed: int) -> list[tuple]:
    r = random.Random(seed)
    word = ["Wörd%d" % i for i in range(500)]
    docs: list = [" ".join(r.choices(word, k=r.randrange(1, 300))) for _ in range(40)]
    for d in list(docs[:20]):
        w = d.split()
        for _ in range(4):
            w[r.randrange(len(w))] = "edit"
            docs.append(" ".join(w))
    docs += [docs[0]] * 5 + [None, "", " \t\n", "a", "A b", "a B c", "a b c d", "z" * 3000, "can't  we'll\n\n  <|endoftext|> x<|endoftext|>", "　 a b ١٢ 日本語テキスト 🙂🙂", "aaaa aaaaaa aaaaaaa"]
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(docs)]
    return [*rows, rows[3], rows[3], (None, docs[4], None, None, None), (None, None, None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash(spark, seed):
    rows = texts(seed)
    got = op4.digest(op4.near_duplicates(spark.createDataFrame(rows, SCHEMA), Scratch(spark))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, op4.brute_force([x[:2] for x in rows])))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_components_of_planted_fingerprints(spark, radius):
    r = random.Random(radius)
    fps = {r.getrandbits(64) for _ in range(200)}
    for f in list(fps):
        for _ in range(3):
            for b in r.sample(range(64), r.randrange(1, 5)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if bin(x ^ y).count("1") <= radius:
                root[find(x)] = find(y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {x["fp"]: x["root"] for x in op4.components(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), Scratch(spark), radius).collect()}
    want: dict = {}
    for f in fps:
        want.setdefault(find(f), set()).add(signed(f))
    have: dict = {}
    for f in fps:
        have.setdefault(got.get(signed(f), signed(f)), set()).add(signed(f))
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_bpe(spark):
    rows = texts(1)
    got = op8.digest(op8.bpe_round_trip(spark.createDataFrame(rows, SCHEMA), FILE)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, op8.by_library([x[:2] for x in rows], FILE)))


@pytest.mark.parametrize("scale_norms", [False, True])
def test_top_k(spark, scale_norms):
    r = np.random.default_rng(1)
    v = r.normal(size=(600, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    if scale_norms:
        v *= r.lognormal(0, 1, 600)[:, None].astype(np.float32)
    v[100:140] = v[7]
    rows = [(i, [float(x) for x in v[i]], 1, 2) for i in range(600)]
    rows += [(900, None, 1, 1), (950, [], 1, 1), (1000, [float("nan")] * 16, 1, 1), (1001, [None] * 16, 1, 1), (None, rows[0][1], 1, 1), (1050, [0.0] * 16, 0, 0), rows[3]]
    got = op1.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, rank int"), "vec_id % 50 = 0", Scratch(spark), bucket_rows=100).collect()
    m = np.floor(256.0 * v.astype(np.float64)).astype(np.int64)
    ids = [*range(600), 1050, 3]  # a repeated row is a candidate of its own
    m = np.vstack([m, np.zeros((1, 16), np.int64), m[3:4]])
    want = []
    for k, q in enumerate(ids):
        if q % 50 == 0:
            s = sorted((-int(m[k] @ m[c]), ids[c]) for c in range(len(ids)) if ids[c] != q)[:5]
            want += [(q, i + 1, c, -x) for i, (x, c) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert op1.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), "true", Scratch(spark)).count() == 0


def test_shards(spark):
    rows = texts(3)
    df = spark.createDataFrame(rows, SCHEMA).drop("shard").repartition(5)
    out = op2.shard_documents(df, Scratch(spark)).collect()
    assert sorted((x["size"], x["text_crc32"], str(x["doc_id"])) for x in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), str(i)) for i, t, *_ in rows)
    per: dict = {}
    for x in out:
        per.setdefault(x["shard"], []).append(x["slot"])
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in per.values())
    assert op2.shard_documents(df.limit(0), Scratch(spark)).count() == 0


def test_matrix_is_exact_and_uniform():
    sizes, blocks = np.array([3, 0, 5, 4]), np.array([4, 4, 4])
    first = []
    for seed in range(3000):
        m = np.stack([op2.matrix_row(sizes, blocks, p, seed) for p in range(4)])
        assert (m.sum(axis=0) == blocks).all() and (m.sum(axis=1) == sizes).all()
        first.append(m[0, 0])
    # hypergeometric: mean 3 * 4/12, variance 3 * 1/3 * 2/3 * 9/11
    assert abs(np.mean(first) - 1) < 0.06 and abs(np.var(first) - 6 / 11) < 0.06
    assert abs(op2.hypergeometric(np.random.default_rng(1), 10**11, 10**11, 10**11) - 5 * 10**10) < 10**7
