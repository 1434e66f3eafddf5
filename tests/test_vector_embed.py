import math

import numpy as np
from pyspark.sql import functions as F

from siftspark.functions import embed, image, vector as V
from siftspark.sources.seed import painted, png, solid


def one(spark, expr, a, b=None):
    return spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(expr.alias("x")).first().x


def test_vector_functions(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, V.dot(a, b), [1.0, 2.0], [3.0, 4.0]) == 11
    assert one(spark, V.dot(a, b), [1.0, 2.0, 9.0], [3.0, 4.0]) == 11
    assert one(spark, V.l2(a, b), [0.0, 0.0], [3.0, 4.0]) == 5
    assert one(spark, V.similarity(a, b, "l2"), [0.0, 0.0], [3.0, 4.0]) == 1 / 6
    assert one(spark, V.normalize(a), [3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, V.normalize(a), [0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, V.valid(a, 2), [1.0, float("nan")]) is False
    padded = one(spark, V.pad_or_trim(a, 8), [1.0, 2.0, 2.0])
    assert abs(sum(x * x for x in padded) - 1) < 1e-9 and abs(padded[3] / padded[0] - 0.15) < 1e-9
    assert one(spark, V.pad_or_trim(a, 3), []) == [1.0, 0.0, 0.0]


def slow_fnv(b):
    h = embed.FNV_OFFSET
    for x in b:
        h = (h ^ x) * embed.FNV_PRIME % 2**64
    return h


def test_fnv():
    words = [b"", b"t:v", "中文".encode(), b"a" * 300]
    assert embed.fnv1a64(words).tolist() == [slow_fnv(w) for w in words]
    assert slow_fnv(b"t:v") == 6218288119399144087


def test_embedding_by_hand():
    def slow(s, dim):
        acc = [0.0] * dim
        from siftspark.functions.text import tokenize_text

        feats = [("t:" + t, 1.0) for t, _, _ in tokenize_text(s)] + [("g:" + s[i : i + 3], 0.4) for i in range(len(s) - 2)] + ([("raw:" + s, 1.2)] if len(s) < 3 else [])
        for f, w in feats:
            v = slow_fnv(f.encode())
            sign = -1 if v & 1 else 1
            i, j = v % dim, (v >> 17) % dim
            acc[i] += sign * w
            if i != j:
                acc[j] += sign * w * 0.35
        n = math.sqrt(sum(x * x for x in acc))
        return [x / n for x in acc]

    for s in ("Vector search 向量检索", "ab", "ééé"):
        assert np.allclose(embed.embed_texts([s], 64)[0], slow(s, 64))
    assert embed.embed_texts(["", None], 8)[:, 0].tolist() == [1.0, 1.0]


def test_related_texts_are_nearer(spark):
    df = spark.createDataFrame([("vector index search",), ("vector index recall",), ("红烧牛肉面",)], "s string")
    a, b, c = [np.array(r.v) for r in df.select(embed.hash_embed(F.col("s"), 1024).alias("v")).collect()]
    assert a @ b > a @ c and abs(a @ a - 1) < 1e-5
    spans = df.limit(1).select(embed.embed_sentences(F.lit("One. Two!"), 16).alias("s")).first().s
    assert [(s.start, s.end) for s in spans] == [(0, 4), (4, 9)]


def test_own_embedder(spark):
    e = embed.FunctionEmbedder(lambda texts: [[len(t), 1.0] for t in texts], 4, "own")
    v = spark.createDataFrame([("abc",)], "s string").select(e.embed(F.col("s")).alias("v")).first().v
    assert len(v) == 4 and abs(sum(x * x for x in v) - 1) < 1e-5


def test_image_descriptors():
    red, blue = (image.describe(solid(c) / 255.0) for c in ((220, 20, 20), (20, 40, 220)))
    assert len(red["patches"]) == 9 and red["vector"] @ red["vector"] > 0.999
    assert red["vector"] @ blue["vector"] < 0.98
    assert image.color_histogram(solid((255, 0, 0)) / 255.0).max() == 1
    e = image.edge_directions(painted("stripes")[..., 1] / 255.0)
    assert e[0] + e[7] == 1.0  # rising edges at angle 0, falling ones at pi
    assert image.perceptual_hash(np.ones((64, 64)))[:63].max() < 1e-9
    d = image._dct(32)
    assert np.allclose(d @ d.T, np.eye(32))
    assert png(solid((1, 2, 3)))[:8] == b"\x89PNG\r\n\x1a\n"
