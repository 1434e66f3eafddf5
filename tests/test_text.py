import random

import pyarrow as pa
from pyspark.sql import functions as F

from siftspark.functions import text

SAMPLES = ["", "Go语言向量检索 Vector Search", "the vector 的 检索", "以图搜图", "a_b Élan K9", "一个人和我们", "한국 カナ𠀀x", None, "word " * 3000, "我们" * 2000]


def test_terms_and_positions_agree(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    for r in df.select("s", text.terms(F.col("s")).alias("a"), text.tokenize(F.col("s")).alias("b")).collect():
        if r.s is None:
            assert r.a is None and r.b is None
            continue
        assert r.a == [t.term for t in r.b]
        raw = r.s.encode()
        assert all(raw[t.start : t.end].decode().lower() == t.term for t in r.b)


def test_known_terms():
    words = [t for t, _, _ in text.tokenize_text("Go语言向量 the Vector")]
    assert words == ["go", "语", "语言", "言", "言向", "向", "向量", "量", "vector"]
    assert len(text.STOPWORDS) == 56


def test_chunks(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("ab 中") for _ in range(n))) for i, n in enumerate([0, 1, 480, 481, 880, 881, 2000])] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {}
    for c in text.chunk_table(df, "doc_id", "text").collect():
        got.setdefault(c.doc_id, []).append((c.chunk_index, c.content, c.char_offset))
    assert 99 not in got
    for i, s in rows[:-1]:
        want, at = [], 0
        while True:
            want.append(s[at : at + 480])
            if at + 480 >= len(s):
                break
            at += 400
        parts = sorted(got[i])
        assert [c for _, c, _ in parts] == want
        assert [o for _, _, o in parts] == [sum(len(w.encode()) for w in want[:k]) for k in range(len(want))]


def test_sentences(spark):
    df = spark.createDataFrame([("你好。世界！Go.",), ("a..b\n/c",), ("",), (None,)], "s string")
    got = [r.x for r in df.select(text.sentences(F.col("s")).alias("x")).collect()]
    assert [s.text for s in got[0]] == ["你好。", "世界！", "Go."]
    assert [(s.start, s.end) for s in got[0]] == text.split_sentences("你好。世界！Go.")
    assert [s.text for s in got[1]] == ["a.", ".", "b\n", "/c"]
    assert got[2] == [] and got[3] is None


def test_small_functions(spark):
    df = spark.createDataFrame([(" a, ,b ", "x" * 121, ["t", "u"]), (None, " y ", [])], "csv string, s string, tags array<string>")
    rows = df.select(text.parse_tags(F.col("csv")).alias("p"), text.answer_excerpt(F.col("s")).alias("e"), text.first_tag(F.col("tags")).alias("f"), text.joined_tags(F.col("tags")).alias("j")).collect()
    assert (rows[0].p, rows[0].e, rows[0].f, rows[0].j) == (["a", "b"], "x" * 120 + "…", "t", "t u")
    assert (rows[1].p, rows[1].e, rows[1].f, rows[1].j) == ([], "y", "", "")


def test_sentences_take_one_pass(spark):
    """A text of 20,000 sentences; before, each sentence split the whole text anew (28.8 s for the 1,000 documents at 0.01)."""
    import time

    n = 20_000
    df = spark.createDataFrame([(1, "é。" * n + "tail"), (2, None), (3, "\n")], "id int, s string")
    rows = df.select("id", text.sentences(F.col("s")).alias("x"))
    began = time.time()
    got = {r["id"]: r["x"] for r in rows.collect()}
    assert time.time() - began < 60
    assert len(got[1]) == n + 1 and got[1][n - 1] == (5 * n - 5, 5 * n, "é。") and got[1][n] == (5 * n, 5 * n + 4, "tail")
    assert got[2] is None and [tuple(s) for s in got[3]] == [(0, 1, "\n")]


def test_tokens_of_a_batch_are_bounded():
    """3,000 Chinese texts of one batch; as Python objects at once, the tokens of 10,000 took 2,109 MB."""
    import tracemalloc

    texts = [None, ""] + ["中文分词检索系统" * 60] * 3000
    tracemalloc.start()
    got = list(text.token_arrays(iter([pa.array(texts)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, got)) == len(texts) and peak < 150_000_000
    assert got[0][0].as_py() is None and got[0][1].as_py() == []
    assert [(t["term"], t["start"], t["end"]) for t in got[0][2].as_py()] == text.tokenize_text(texts[2])
