import random

import pytest

from siftspark.errors import BAD_FILTER, EngineError, is_code
from siftspark.operators import filters

ROWS = [
    (1, "text", "handbook", ["RAG ", "zh"], {"tag": "rag"}, None, "memory log", "doc-1", "kb://a", 0.03),
    (2, "image", "gallery", [], {"tag": ""}, "A red cup", None, None, None, 0.01),
    (3, "text", "notes", None, None, None, None, "doc-2", "kb://b", None),
]
SCHEMA = "id bigint, modality string, collection string, tags array<string>, scalar map<string,string>, caption string, content string, doc_id string, source_ref string, rrf double"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.mark.parametrize(
    "text,want",
    [
        ("", {1, 2, 3}), ("tag == 'rag'", {1}), ('tags != "rag"', {1, 2}), ("tag > 'r'", {1}), ("caption == 'a red cup'", {2}), ("caption > 'memory'", {1}),
        ("MODALITY == ' Image '", {2}), ("collection == 'notes' || collection == 'gallery'", {2, 3}), ("doc_id > 'doc'", {1, 3}), ("source_ref == 'kb://b'", {3}),
        ("score > 0.02", {1}), ("score <= 0.01", {2}), ("score > '0.02'", {1, 2}), ("score != 0", {1, 2}), ("modality=='text' and (tag=='zh' or collection=='notes')", {1, 3}),
        ("modality == 'text' or modality == 'image' and tag == 'none'", {1, 3}), ("caption > 5", set()),
    ],
)
def test_filters(df, text, want):
    assert {r.id for r in df.where(filters.filter_column(text)).collect()} == want


@pytest.mark.parametrize("text", ["price > 3", "tag", "tag ==", "tag == 'x", "tag == x", "(tag == 'x'", "tag == 'x' y", "== 'x'", "tag == 'a' and", "tag = 'a'"])
def test_refused(text):
    with pytest.raises(EngineError) as e:
        filters.parse(text)
    assert is_code(e.value, BAD_FILTER)


def test_random_expressions_parse_as_python(df):
    r = random.Random(4)
    rows = {i: (m, c) for i, m, c, *_ in ROWS}

    def make(depth):
        if depth == 0 or r.random() < 0.3:
            f, v = r.choice([("modality", r.choice(["text", "image"])), ("collection", r.choice(["handbook", "notes", "gallery"]))])
            op = r.choice(["==", "!="])
            return f"{f} {op} '{v}'", lambda row: (row[0 if f == "modality" else 1] == v) == (op == "==")
        (a, fa), (b, fb) = make(depth - 1), make(depth - 1)
        if r.random() < 0.5:
            return f"({a}) {r.choice(['&&', 'AND', 'and'])} ({b})", lambda row: fa(row) and fb(row)
        return f"({a}) {r.choice(['||', 'or'])} ({b})", lambda row: fa(row) or fb(row)

    for _ in range(12):
        text, f = make(3)
        assert {x.id for x in df.where(filters.filter_column(text)).collect()} == {i for i, row in rows.items() if f(row)}


def test_each_request_its_own_filter(spark, df):
    asks = spark.createDataFrame([(1, "tag == 'rag'"), (2, "nonsense"), (3, "")], "qid int, filter string")
    got = df.crossJoin(asks).where(filters.per_request(["tag == 'rag'", "nonsense", ""])).select("qid", "id").collect()
    assert sorted((r.qid, r.id) for r in got) == [(1, 1), (3, 1), (3, 2), (3, 3)]
