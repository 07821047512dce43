import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.functions import filters as flt
from tessera.functions import vector as V
from tessera.functions.filters import Fields, Filter, compile_filter, where


def pair(spark, f, a, b=None):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    return df.select(f(F.col("a"), F.col("b")) if b is not None else f(F.col("a"))).first()[0]


@pytest.mark.parametrize(
    "f,a,b,want",
    [
        (V.dot, list(range(1, 4)), list(range(4, 7)), 32),
        (V.euclidean, [0, 0], [3, 4], 5),
        (V.euclidean, [0], [3, 4], 0),
        (V.cosine, [1, 2], [1, 2], 1),
        (V.cosine, [1, 0], [0, 1], 0),
        (V.cosine, [1, 0], [-1, 0], -1),
        (V.cosine, [1], [1, 2], 0),
        (V.cosine, [], [], 0),
        (V.cosine, [0, 0], [1, 2], 0),
        (V.cosine, [math.inf, 0], [1, 2], 0),
        (V.dot, [math.nan], [1], 0),
    ],
)
def test_pairs(spark, f, a, b, want):
    assert math.isclose(pair(spark, f, [float(x) for x in a], [float(x) for x in b]), want, abs_tol=1e-9)


def test_single(spark):
    assert pair(spark, V.magnitude, [3.0, 4.0]) == 5 and pair(spark, V.magnitude, []) == 0
    assert np.allclose(pair(spark, V.normalize, [3.0, 4.0]), [0.6, 0.8])
    assert pair(spark, V.normalize, [0.0, 0.0]) == [0, 0] and pair(spark, V.normalize, []) == []
    assert pair(spark, V.is_finite, [1.0]) and not pair(spark, V.is_finite, [math.inf])
    assert np.allclose(V.unit(np.array([[3, 4], [0, 0], [math.nan, 1]])), [[0.6, 0.8], [0, 0], [0, 0]])
    assert pair(spark, lambda v: V.cosine_to(v, [1, 1]), [2.0, 2.0]) == pytest.approx(1)
    assert pair(spark, lambda v: V.cosine_to(v, [0, 0]), [2.0, 2.0]) == 0


VALUES = ['{"f": 1}', '{"f": 2.5}', '{"f": 1e2}', '{"f": "12"}', '{"f": "abc"}', '{"f": true}', '{"f": null}', "{}", '{"f": [1, "a"]}', '{"f": {"b": 1, "a": 2}}', '{"f": -7}', '{"other": 1}']
ABSENT = object()


def plain(node, row):
    """The meaning of a filter, on decoded JSON."""
    if node.op in ("and", "or"):
        return (all if node.op == "and" else any)(plain(p, row) for p in node.parts)
    if node.op == "not":
        return not plain(node.parts[0], row)
    v = row.get(node.field, ABSENT)
    kind = lambda x: float if isinstance(x, float) else type(x)
    same = lambda w: v is not ABSENT and kind(v) is kind(w) and v == w
    number = isinstance(v, int | float) and not isinstance(v, bool)
    match node.op:
        case "equals" | "notEquals":
            return same(node.value) == (node.op == "equals")
        case "in" | "notIn":
            return any(map(same, node.value)) == (node.op == "in")
        case "greaterThan":
            return number and v > node.value
        case "lessThan":
            return number and v < node.value
        case "greaterThanOrEqual":
            return number and v >= node.value
        case "lessThanOrEqual":
            return number and v <= node.value
        case "contains":
            return isinstance(v, str) and node.value in v
        case "startsWith":
            return isinstance(v, str) and v.startswith(node.value)
        case "endsWith":
            return isinstance(v, str) and v.endswith(node.value)
        case "exists" | "notExists":
            return (v is not ABSENT and v is not None) == (node.op == "exists")


LITERALS = [1, 2.5, 100.0, "12", "abc", True, None, [1, "a"], {"a": 2, "b": 1}, -7]
NODES = (
    [where("f", op, v) for op in ("equals", "notEquals") for v in LITERALS]
    + [where("f", op, v) for op in flt.COMPARISONS for v in (1, 2.5, -7, 100)]
    + [where("f", op, v) for op in ("in", "notIn") for v in ([], [1, "abc"], [True, None, 2.5])]
    + [where("f", op, v) for op in flt.STRINGS for v in ("1", "abc", "c", "")]
    + [where("f", op) for op in ("exists", "notExists")]
)
NODES += [flt.all_of(), flt.any_of(), *(~n for n in NODES[:6])]
NODES += [a & b for a, b in itertools.islice(itertools.combinations(NODES, 2), 0, 200, 29)] + [a | ~b for a, b in itertools.islice(itertools.combinations(NODES, 2), 0, 200, 31)]


def test_every_operator_on_every_value(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, j string").withColumn("custom", F.parse_json("j"))
    fields = Fields({})
    got = df.select("i", *[compile_filter(n, fields).alias(f"c{k}") for k, n in enumerate(NODES)]).orderBy("i").collect()
    for i, v in enumerate(VALUES):
        for k, n in enumerate(NODES):
            assert got[i][f"c{k}"] is plain(n, json.loads(v)), (v, n)


def test_fixed_fields_reach_the_scan(spark, sf, capsys):
    df = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("doc_id", "document_id")
    out = df.where(compile_filter([where("source", "equals", "src1"), where("source", "startsWith", "s")])).select("document_id")
    out.explain()
    plan = capsys.readouterr().out
    assert "EqualTo(source,src1)" in plan or "PushedFilters" in plan and out.count() > 0


def test_names_are_quoted(spark):
    df = spark.createDataFrame([('{"a.b\'c": 1}',)], "j string").withColumn("custom", F.parse_json("j"))
    assert df.where(compile_filter(where("a.b'c", "equals", 1))).count() == 1


def test_json_round_trip():
    for n in NODES:
        assert Filter.from_json(json.loads(json.dumps(n.to_json()))).to_json() == n.to_json()


@pytest.mark.parametrize("node", [{}, None, {"operator": "like", "field": "a", "value": 1}, {"operator": "equals", "field": "a"}, {"operator": "equals", "value": 1}, {"operator": "greaterThan", "field": "a", "value": "1"}, {"operator": "in", "field": "a", "value": 3}, {"operator": "not", "filters": []}, {"operator": "contains", "field": "a", "value": 1}])
def test_ill_formed_filters_raise(node):
    with pytest.raises(ValueError):
        Filter.from_json(node)
