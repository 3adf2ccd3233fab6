import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.functions.scalar import order_bits
from gaugeframe.operators.order_statistics import selected_quantiles, top_means


def test_bits_are_those_of_the_double(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 1 / 3]
    values += [2.0 ** e * s for e in range(-1074, 1024, 13) for s in (1, -1)]
    values += [v for e in range(-300, 300, 7) for v in (np.nextafter(2.0 ** e, 0), np.nextafter(2.0 ** e, np.inf))]
    values += [v for v in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)) if v == v]
    values = [float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_bits(F.col("v")).alias("bits"))
    for r in df.collect():
        size = struct.unpack("q", struct.pack("d", abs(r["v"])))[0]
        assert r["bits"] == (-size if r["v"] < 0 else size), r
    odd = spark.createDataFrame([(float("nan"),), (None,)], "v double").select(order_bits(F.col("v"))).collect()
    assert [r[0] for r in odd] == [2 ** 63 - 1, None]


def groups():
    rng = random.Random(4)
    data = {"wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-12, 12) for _ in range(401)], "tied": [3.0] * 150 + [rng.random() for _ in range(50)],
            "single": [-7.5], None: [float(i % 10) for i in range(57)], "close": [1 + i * 2.0 ** -52 for i in range(90)]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("tied", None), ("empty", None)]
    rng.shuffle(rows)
    return data, rows


def test_quantiles_equal_numpy(spark):
    data, rows = groups()
    df = spark.createDataFrame(rows, "k string, v double")
    points = {"q0": 0.0, "q05": .05, "q50": .5, "q98": .98, "q100": 1.0, "low": .5}
    out = {r["k"]: r for r in selected_quantiles(df, ["k"], "v", points, lower=["low"]).collect()}
    assert set(out) == set(data)
    for k, vs in data.items():
        assert out[k]["n"] == len(vs)
        for name, q in points.items():
            method = "lower" if name == "low" else "linear"
            assert out[k][name] == pytest.approx(np.quantile(vs, q, method=method), rel=1e-15, abs=1e-300), (k, name)
    whole = selected_quantiles(df, [], "v", {"m": .5}).first()
    assert whole["m"] == np.median([v for _, v in rows if v is not None])
    assert selected_quantiles(df.limit(0), ["k"], "v", {"m": .5}).count() == 0


def test_top_means_equal_sorted_lists(spark):
    data, rows = groups()
    df = spark.createDataFrame(rows, "k string, v double")
    for fraction in (.01, .2, 1.0):
        out = {r["k"]: r for r in top_means(df, ["k"], "v", fraction).collect()}
        for k, vs in data.items():
            count = max(1, int(len(vs) * fraction))
            assert (out[k]["n"], out[k]["top_k"]) == (len(vs), count)
            assert out[k]["mean"] == pytest.approx(np.mean(sorted(vs)[-count:]), rel=1e-9)
    assert top_means(df, [], "v", .01).count() == 1 and top_means(df.limit(0), ["k"], "v", .01).count() == 0


def test_plan_neither_sorts_rows_nor_numbers_them(spark):
    df = spark.createDataFrame(groups()[1], "k string, v double")
    plan = selected_quantiles(df, ["k"], "v", {"m": .5})._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort [" not in plan
