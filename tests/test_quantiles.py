import math
import random

from playlens.operators.quantiles import exact_quantiles

SHARES = {"least": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "most": 1.0}


def test_against_sorting(spark):
    rng, rows = random.Random(4), []
    for i in range(4000):
        g = "hot" if i % 3 else rng.choice(["a", None, "b"])
        x = rng.choice([rng.random(), rng.gauss(0, 1) * 10 ** rng.randint(-9, 9), float(rng.randint(0, 3)), None, float("nan")])
        rows.append((g, i % 2, x, None if g == "b" else float(i)))
    df = spark.createDataFrame(rows, "g string, h int, x double, y double").repartition(5)
    for bins in (32, 1024):
        got = {(r.g, r.h): r for r in exact_quantiles(df, ["g", "h"], ["x", "y"], SHARES, bins).collect()}
        assert len(got) == len({(r[0], r[1]) for r in rows})
        for (g, h), r in got.items():
            for name, at in (("x", 2), ("y", 3)):
                own = sorted(v[at] for v in rows if (v[0], v[1]) == (g, h) and v[at] is not None and not math.isnan(v[at]))
                for k, p in SHARES.items():
                    assert r[f"{name}_{k}"] == (own[max(math.ceil(p * len(own)), 1) - 1] if own else None)


def test_nothing_and_extremes(spark):
    df = spark.createDataFrame([("a", -1.7e308), ("a", 1.7e308), ("a", 0.0), ("c", None)], "g string, x double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], ["x"], SHARES).collect()}
    assert (got["a"].x_least, got["a"].x_p50, got["a"].x_most, got["c"].x_p50) == (-1.7e308, 0.0, 1.7e308, None)
    assert exact_quantiles(df.where("false"), ["g"], ["x"], SHARES).count() == 0
