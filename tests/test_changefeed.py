import json
import random

from siftspark.operators.changefeed import apply_changes, final_state, parse_changes

SCHEMA = "seq bigint, log_file string, rec_type tinyint, ts bigint, payload binary, id string, gone int, m string"


def log(spark, rows):
    return spark.createDataFrame([(s, "f", k, t, p if p is None or isinstance(p, bytes) else p.encode(), "clash", 7, "x") for s, k, t, p in rows], SCHEMA)


def brute(rows):
    changes = {}
    for seq, kind, ts, p in rows:
        if kind in (1, 2) and p:
            changes[kind, ts, p] = min(seq, changes.get((kind, ts, p), seq))
    out = []
    for (kind, ts, p), seq in changes.items():
        try:
            x = json.loads(p)
        except ValueError:
            continue
        if kind == 1 and not isinstance(x, dict):
            continue
        out.append((ts, kind == 2, seq, int(x["id"] if isinstance(x, dict) else x), kind == 1 and x.get("deleted") is not True))
    state = {}
    for _, _, seq, i, stays in sorted(out):
        state[i] = seq
        if not stays:
            del state[i]
    return state


def got(df):
    rows = [(r.id, r.seq) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return dict(rows)


def random_rows(n, seed):
    r = random.Random(seed)
    rows = []
    for s in range(1, n):
        i = 1 if r.random() < 0.3 else r.randint(2, 20)
        kind = r.choice([1, 1, 1, 2])
        body = {"id": r.choice([i, str(i)]), "content": r.choice("abc"), "scalar": {"id": 99, "deleted": True}}
        if r.random() < 0.2:
            body["deleted"] = r.choice([True, False])
        p = json.dumps(body) if kind == 1 else json.dumps(r.choice([i, str(i), {"id": i}]))
        rows.append((s, kind, r.randint(1, n // 3), p[:-3] if kind == 1 and r.random() < 0.1 else p))
    return rows + [(s + n, k, t, p) for s, k, t, p in r.sample(rows, n // 4)]


def test_random_logs_against_a_fold(spark):
    rows = random_rows(400, 1)
    assert got(apply_changes(log(spark, rows))) == brute(rows)


def test_hot_id_in_chunks(spark):
    rows = random_rows(300, 2)
    assert got(apply_changes(log(spark, rows), rows_per_chunk=20)) == brute(rows)


def test_order_at_equal_time(spark):
    rows = [(1, 2, 5, "7"), (2, 1, 5, '{"id":7}'), (3, 1, 5, '{"id":8}'), (4, 1, 5, '{"id":8,"x":1}')]
    assert got(apply_changes(log(spark, rows))) == {8: 4}


def test_what_is_no_change(spark):
    rows = [(1, 1, 1, None), (2, 1, 1, b""), (3, 1, 1, '{"id":1,"content":"cut'), (4, 3, 1, '{"id":2}'), (5, 1, 1, "3"), (6, 1, 1, '{"id":"x"}'), (7, 1, 1, b'{"id":4,"content":"\xe4\xb8'), (8, 1, None, '{"id":5}'), (9, 1, 1, '[{"id":6}]')]
    assert got(apply_changes(log(spark, rows))) == {5: 8}
    assert apply_changes(log(spark, [])).count() == 0


def test_base_is_kept_or_replaced(spark):
    base = spark.createDataFrame([(1, -1), (2, -2), (3, -3), (None, -4)], "id bigint, seq bigint")
    rows = [(1, 1, 1, '{"id":2}'), (2, 2, 1, "3")]
    assert got(apply_changes(log(spark, rows), base)) == {1: -1, 2: 1}


def test_escaped_keys_and_long_payload(spark):
    rows = [(1, 1, 1, '{"\\u0069d": "12", "content": "' + "x" * 200_000 + '"}')]
    assert [(r.id, r.gone) for r in parse_changes(log(spark, rows)).collect()] == [(12, False)]
    assert len(final_state(log(spark, rows)).first().content) == 200_000


def test_state_has_every_field_of_the_payload(spark):
    body = {
        "id": 5, "scalar": {"title": "chunk", "id": "9", "n": 3, "o": {"a": 1}}, "created_at": "2025-01-01T00:00:00Z", "char_offset": 7,
        "terms": [{"term": "x", "start": 0, "end": 1}], "mime": "image/png", "width": 40, "height": "x", "patches": [{"box": [0, 1]}],
    }
    rows = [(1, 1, 1, json.dumps(body)), (2, 1, 1, '{"id": 6, "content": "c", "scalar": "none"}'), (3, 1, 1, '{"id": 7, "tags": ["t"]}')]
    out = {r.id: r for r in final_state(log(spark, rows)).collect()}
    r = out[5]
    assert r.scalar == {"title": "chunk", "id": "9", "n": "3", "o": '{"a":1}'} and r.created_at == body["created_at"]
    assert (r.char_offset, r.mime, r.width, r.height, r.terms[0].term, r.terms[0].end) == (7, "image/png", 40, None, "x", 1)
    assert json.loads(r.patches[0]) == {"box": [0, 1]}
    assert (out[6].content, out[6].scalar) == ("c", None) and (out[7].tags, out[7].scalar) == (["t"], None)
