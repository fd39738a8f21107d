"""Nested JSON against a plain recursive reading."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from sightline.operators.nested import child_table, flatten_json, nested_rows

LONE = frozenset({"errors", "path"})


def brute(text):
    def reject(_):
        raise ValueError

    def load(s):
        return json.loads(s, parse_constant=reject)

    def value(v):
        if isinstance(v, str) and v.strip(" \t\n\r")[:1] in ("{", "["):
            try:
                w = load(v)
            except ValueError:
                return v
            return w if isinstance(w, (dict, list)) else v
        return v

    out = []

    def go(v, path, case, element, lone):
        v = value(v)
        if isinstance(v, dict):
            if element or lone:
                path = path if element else path + "[0]"
                out.append((path, case))
                case = path
            for k, x in v.items():
                go(x, f"{path}.{k}" if path else k, case, False, k in LONE)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                go(x, f"{path}[{i}]", case, True, False)

    try:
        go(load(text), "", "", False, False)
    except (ValueError, RecursionError):
        return []
    return out


def found(texts):
    got = nested_rows([t.encode() for t in texts], range(len(texts)), LONE)
    by = {i: [] for i in range(len(texts))}
    for r, n, p in zip(got["row"].tolist(), got["node"].to_pylist(), got["parent"].to_pylist()):
        by[r].append((n, p))
    return [sorted(v) for v in by.values()]


FIXED = [
    '{"a": [{"b": [{}, null, {"c": [[{}], [1, {}]]}]}]}', "[[{}], {}]", '{"errors": {"path": {"x": 1}}}', '{"errors": "{\\"path\\": [{}]}"}', '"[{\\"a\\": 1}]"', '{"a": "{broken"}', '{"a": [{}', "{}{}", "", " ", "nul", '{"a" 1}', '{"a": 1,}', "[1 2]",
    '{"a": "\\ud83d\\ude00", "b": [{"\\u0061": [{}]}]}', '{"a": [{}], "a": [{}, {}]}', '{"a": "x\\\\", "b": [{}]}', '{"a": "\\\\\\"[{}]"}', '{"a": "\t"}', '{"a": "\\q"}', "[01]", "[1e5, -0.5, {}]", "[NaN, {}]", "[{}]]", "]", "[}", '{"k": [{"z": "  [ {} ] "}]}', '["{}", "[]", ["{\\"q\\":[{}]}"]]', '{"": [{}]}', '{"a": 1 "b": 2}', '[,{}]', '{"a":}', '{:1}', '"', '"\\"', '{"a": "\\u12"}',
]


def test_fixed_cases():
    assert found(FIXED) == [sorted(brute(t)) for t in FIXED]
    for t in FIXED:  # what stands around a text changes nothing
        assert found([t]) == [sorted(brute(t))]


names = st.sampled_from(["a", "b", "errors", "path", 'q"x', "ü", ""])
values = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=5), st.sampled_from(['{"a":[{}]}', "[{}]", "{"])), lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(names, x, max_size=4)), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(values, st.booleans(), st.integers(0, 3)), min_size=1, max_size=6))
def test_against_plain_reading(docs):
    texts = []
    for v, indent, damage in docs:
        t = json.dumps(v, ensure_ascii=bool(damage % 2), indent=1 if indent else None)
        texts.append(t[: len(t) * 2 // 3] if damage == 3 else t)
    assert found(texts) == [sorted(brute(t)) for t in texts]


def test_deep_and_long():
    deep = "[" * 3000 + "{}" + "]" * 3000
    assert len(found([deep])[0]) == 1
    long = json.dumps({"a": [{"i": i, "s": "x" * 50} for i in range(20000)]})
    assert len(found([long])[0]) == 20000


def test_operator(spark):
    rows = [(1, '{"n": [{"x": 1, "node": 7}, {"x": 2}]}', "z"), (1, '{"n": [{"x": 1, "node": 7}, {"x": 2}]}', "z"), (None, '[{"x": 3}]', None), (2, None, None), (3, "", None), (4, "[1", None)]
    df = spark.createDataFrame(rows, "log_seq long, j string, node string")
    out = flatten_json(df, "log_seq", "j", with_record=True)
    assert sorted((r.log_seq or 0, r.node, r.parent) for r in out.collect()) == [(0, "[0]", "")] + [(1, "n[0]", "")] * 2 + [(1, "n[1]", "")] * 2
    child = child_table(out, "n[]", T.StructType([T.StructField("x", T.IntegerType()), T.StructField("node", T.IntegerType())]))
    assert child.columns == ["log_seq", "node", "parent", "x", "f_node"]
    assert sorted((r.x, r.f_node) for r in child.collect()) == sorted([(1, 7), (2, None)] * 2, key=lambda t: (t[0], t[1] or 0))
    assert flatten_json(df.limit(0), "log_seq", "j").count() == 0
