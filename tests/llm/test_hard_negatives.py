import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayscope.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, row string, q string, rank string"


def anchor():
    return F.coalesce(F.col("vec_id") % 5 == 0, F.lit(False))



def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "r", "q", "1") for i, v, l in rows], SCHEMA)


def brute(rows, n_positive=5, n_negative=3):
    rows = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], l)
        for i, v, l in rows
        if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    rows = [(i, q, l) for i, q, l in rows if sum(x * x for x in q) < 2**55]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for at, (i, q, label) in enumerate(rows):
        if i is None or i % 5:
            continue
        scored = [(sum(a * b for a, b in zip(q, p)), j, l) for k, (j, p, l) in enumerate(rows) if k != at and len(p) == len(q)]
        for s, j, _ in sorted((x for x in scored if x[2] == label), key=order)[:n_positive]:
            fits = [x for x in scored if x[2] != label and 50 * s <= 100 * x[0] <= 95 * s]
            for rank, x in enumerate(sorted(fits, key=order)[:n_negative], 1):
                out.append((i, j, rank, x[1], s, x[0]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(n, dims, seed, centres=6):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(centres, dims))
    for i in range(n):
        v = middle[rnd.integers(centres)] + rnd.normal(size=dims) * rnd.choice([0.05, 0.5, 2])
        yield i, [float(x) for x in v], int(rnd.integers(4))


@pytest.mark.parametrize("dims", [1, 3, 16, 50, 64])
def test_against_brute_force(spark, dims):
    rows = list(vectors(700, dims, dims))
    df = table(spark, rows)
    expected = brute(rows)
    assert expected and got(h.mine(df, anchor())) == expected
    assert got(h.mine(df, anchor(), anchor_block=40, row_block=150)) == expected


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [*vectors(60, 4, 1), *list(vectors(30, 4, 2))]  # ids repeat
    rows += [(None, v, l) for _, v, l in vectors(20, 4, 3)]
    rows += [(100, None, 1), (105, [1.0, None, 2.0, 3.0], 1), (110, [1.0, nan, 0.0, 0.0], 1), (115, [inf, 0.0, 0.0, 0.0], 2)]
    rows += [(120, [1.0, 2.0, 3.0, 4.0], None), (125, [], 1), (126, [], 1), (127, [], 2), (130, [1.0, 2.0], 1), (131, [2.0, 1.0], 1), (132, [1.0, 1.0], 3)]
    rows += [(140, [1e30, 0.0, 0.0, 0.0], 1), (145, [3e5, 1.0, -3e5, 2e5], 1), (146, [3e5, 2.0, -3e5, 1e5], 1), (147, [2e5, 2.0, -3e5, 1e5], 2)]
    rows += [(150, [1.0, 1.0, 1.0, 1.0], 0)] * 12 + [(151, [0.7, 1.0, 1.0, 0.9], 1)] * 9  # ties
    df = table(spark, rows)
    assert got(h.mine(df, anchor(), anchor_block=7, row_block=30)) == brute(rows)
    assert h.mine(df.limit(0), anchor()).count() == 0
    assert h.mine(df, F.lit(False)).count() == 0


def test_bounds_hold(spark):
    """No score leaves its bounds, and short segments bound at least as tightly as long ones."""
    rows = h.summarised(table(spark, vectors(200, 37, 9)), "vec_id", "label", "embedding", anchor()).toArrow()
    side = h._Side(rows, np.arange(len(rows)), np.zeros(len(rows), int), 37)
    exact, widths = side.q @ side.q.T, []
    for means, spread in side.levels:
        middle, reach = means @ means.T, spread @ spread.T
        assert (exact <= middle + reach).all() and (exact >= middle - reach).all()
        widths.append(reach)
    assert (widths[1] <= widths[0] * (1 + 1e-9)).all() and widths[1].mean() < widths[0].mean()
