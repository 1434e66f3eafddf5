import collections
import random
import unicodedata as U

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftspark.llm import bpe, lookalike, mixing

DOCS = "doc_id bigint, text string, source string, ids string, form string, look string"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, source, "clash", "clash", "clash") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_public_tokenizer(spark, reference):
    r = random.Random(1)
    letters = list("ab'srtvelm d  \n\t12.,!é中文　 '’😀Жß한")
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|> x", "it's we'll I'VE 're", "'s's", "", None, "a'", "   ", "\n\n x", "x \n", "a" * 50_000, "中" * 9000, " " * 3000 + "x", "'" * 50]
    got = {x.doc_id: x.ids for x in bpe.encode(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == reference.encode(t or "", add_special_tokens=False).ids, t[:60] if t else t
    back = {x.doc_id: x.text for x in bpe.decode(bpe.encode(docs(spark, texts))).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    n = {x.doc_id: x.n_tokens for x in bpe.count_tokens(docs(spark, texts)).collect()}
    assert n == {i: len(x) for i, x in got.items()}


def test_empty_table_and_repeats(spark):
    assert bpe.encode(docs(spark, [])).count() == 0
    df = docs(spark, ["same"])
    assert bpe.encode(df.unionAll(df)).count() == 2


def test_offsets(spark):
    texts = ["héllo wörld 中文", "", None, "a  b's", "😀😀"]
    for r in bpe.token_table(docs(spark, texts)).collect():
        raw, at = (texts[r.doc_id] or "").encode(), [0, *r.ends]
        assert len(r.ids) == len(r.ends) and at[-1] == len(raw)
        own = bpe.encode_batch(pa.array([texts[r.doc_id]]))[0]
        assert own.tolist() == r.ids and [bpe._bytes_of(np.array([i]), bpe.VOCABULARY)[0].tobytes() for i in r.ids] == [raw[a:b] for a, b in zip(at, at[1:])]
    assert bpe.token_table(docs(spark, [])).count() == 0


def test_the_scan_equals_one_state_at_a_time():
    r = np.random.default_rng(4)
    letters = np.array([ord(c) for c in "ab'srtvelm d  \n12.,é中"], np.uint32)
    for n in (1, 63, 64, 65, 5000):
        cp, first = r.choice(letters, n), r.random(n) < 0.02
        first[0] = True
        after, starts = bpe.automaton()
        state, want = bpe.NONE, []
        for x in bpe.symbols(cp, first):
            want.append(bool(starts[x, state]))
            state = after[x, state]
        assert bpe.boundaries(cp, first).tolist() == want


def test_ids_that_are_no_whole_text(spark):
    ids = bpe.encode_batch(pa.array(["😀"]))[0].tolist()
    df = spark.createDataFrame([(1, ids[:1]), (2, ids), (3, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(df).collect()}
    assert got[2] == "😀" and got[3] == "" and got[1] != "😀"


def test_sliced_arrays():
    whole = pa.array(["zero", "one two", None, "three's"])
    ids, upto = bpe.encode_batch(whole.slice(1, 3))
    alone, _ = bpe.encode_batch(pa.array(["one two"]))
    assert ids[upto[0] : upto[1]].tolist() == alone.tolist() and upto[1] == upto[2]


def plain_form(s):
    out = []
    for c in U.normalize("NFKD", "".join(lookalike.LOOK_ALIKE.get(c, c) for c in s)):
        out.append(lookalike.LOOK_ALIKE.get(c, "-" if c in lookalike.HYPHENS else " " if U.category(c) == "Zs" else "" if U.category(c) == "Cf" else c))
    return U.normalize("NFC", "".join(out))


def test_forms_against_a_plain_version(spark):
    r = random.Random(2)
    letters = "aeé éööＡａﬁ​ ‑-­авкяАΟονKKﾊﾞガ가각q̣̇ \n中豈😀ͅ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 12))) for _ in range(3000)] + ["", None, "é" * 20_000, "́a", "a" + "̧́" * 50]
    got = {x.doc_id: x.form for x in lookalike.canonical(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else plain_form(t))
    again, _ = lookalike.canonical_batch([x or "" for x in got.values()])
    assert again == [x or "" for x in got.values()]
    assert lookalike.canonical(docs(spark, [])).count() == 0


def test_look_pairs_and_classes(spark):
    base = "The quick brown fox jumps over it"
    texts = [base, base.replace("o", "\u043e"), base, base.replace(" ", "\u00a0").replace("T", "\uff34"), base.lower(), "short", "sh\u043ert", None, "", base + "!", "Th\u00e9 quick brown fox jumps over it", "The\u0301 quick brown fox jumps over it"]
    got = {(r.doc_a, r.doc_b) for r in lookalike.look_pairs(docs(spark, texts)).collect()}
    assert got == {(0, 1), (0, 3), (1, 2), (1, 3), (2, 3), (10, 11)}
    cls = {r.doc_id: (r.class_id, r.variants, r.records) for r in lookalike.look_classes(docs(spark, texts)).collect()}
    assert cls[2] == (0, 3, 4) and cls[5] == cls[6] == (5, 2, 2) and cls[7] == cls[8] == (7, 1, 2)
    assert lookalike.look_pairs(docs(spark, [])).count() == 0


def test_quotas():
    q = mixing.quotas({"a": 100, "b": 1000, "gone": 0}, {"a": (0.5, 3), "b": (0.25, 1), "gone": (0.25, 2)})
    assert q["a"]["quota"] == 300 and q["b"]["quota"] == 150 and q["a"]["passes"] == 3 and q["a"]["rest"] == 0
    assert mixing.quotas({"a": 10}, {"b": (1.0, 1)}) == {}
    assert mixing.quotas({"a": 100, "b": 100}, {"a": (0.5, 1), "b": (0.5, 9)}, total=1000)["a"]["quota"] == 100


def test_deal_is_exact_and_fair():
    blocks = [700, 200, 100]
    out = mixing.deal(blocks, 7, 1)
    assert (np.concatenate([mixing.deal(blocks, 7, 1, a, z) for a, z in ((0, 2), (2, 3), (3, 7))]) == out).all()
    assert out.sum(axis=0).tolist() == blocks and out.sum(axis=1).max() - out.sum(axis=1).min() <= 1
    mean = np.mean([mixing.deal([30, 10], 4, s) for s in range(400)], axis=0)
    assert np.allclose(mean[:, 0], 7.5, atol=0.3)


def test_mixture(spark):
    r = random.Random(3)
    rows = [(i, " ".join("word" for _ in range(r.randint(1, 30))), s, "x", "x", "x") for i, s in enumerate(["big"] * 900 + ["mid"] * 200 + ["small"] * 60 + [None] * 5 + ["loose"] * 5)]
    rows += [(5000, None, "small", "x", "x", "x"), (5001, "", "mid", "x", "x", "x")]
    df = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets, block_docs=8, shard_docs=128, ranges=8).cache()
    per = collections.defaultdict(collections.Counter)
    for x in mixed.collect():
        per[x.source][x.doc_id] += 1
    assert set(per) == {"big", "mid", "small"} and max(per["big"].values()) == 1 and max(per["mid"].values()) <= 2 and max(per["small"].values()) <= 3
    report = {x.source: x for x in mixing.mixture_report(mixed, targets).collect()}
    assert report["absent"].uses == 0 and sum(x.share for x in report.values()) == pytest.approx(1, abs=1e-5)
    for s, t in (("big", 4 / 9), ("mid", 3 / 9), ("small", 2 / 9)):
        assert abs(report[s].share - t) < 0.01
    places = mixed.groupBy("shard").agg(F.count("*").alias("n"), F.max("position").alias("m"), F.countDistinct("position").alias("d")).collect()
    assert all(p.n == p.d == p.m + 1 for p in places) and len(places) > 2
    again = {tuple(x) for x in mixing.mix(df, targets, block_docs=8, shard_docs=128, ranges=32).collect()}
    assert again == {tuple(x) for x in mixed.collect()}  # neither a new run nor other ranges change it
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0
