"""op11 against the plain method, on small tables with odd vectors, ties, repeats and clashing names."""

import hashlib
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from trackforge.llm import yinyang


def brute(rows, k, rounds, dim):
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    at = [e for _, e in sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}"), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        own = [min(range(len(at)), key=lambda j: (far(e, at[j]), j)) for _, e in kept]
        if step < rounds:
            for j in range(len(at)):
                if mine := [e for (_, e), o in zip(kept, own, strict=True) if o == j]:
                    at[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    d = [far(e, at[o]) for (_, e), o in zip(kept, own, strict=True)]
    cut = lambda v: v if v < 1 << 63 else None
    of = lambda j: sum(x for x, o in zip(d, own, strict=True) if o == j)
    return sorted(str((i, o, cut(x), cut(of(o)), cut(sum(d)), sha(",".join(map(str, at[o]))))) for (i, _), o, x in zip(kept, own, d, strict=True))


@pytest.mark.parametrize("k, groups, block, scale", [(8, None, 50, 1), (12, 4, 7, 1), (5, 1, 1000, 1e12), (300, 30, 64, 1), (3, 2, 9, 1e-3)])
def test_same_as_all_against_all(spark, monkeypatch, k, groups, block, scale):
    monkeypatch.setattr(yinyang, "BLOCK", block)
    rng = random.Random(k)
    hubs = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(9)]
    rows = [(i, [scale * (h + rng.gauss(0, 0.15)) for h in rng.choice(hubs)]) for i in range(260)]
    rows += [(i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(4)]) for i in range(300, 340)]  # ties
    rows += [(400, None), (401, []), (402, [1.0, 2.0, 3.0]), (403, [1.0, None, 0.0, 0.0]), (404, [math.nan, 0.0, 0.0, 0.0]), (405, [math.inf, 0.0, 0.0, 0.0]), (406, [0.0] * 4), (None, [0.1] * 4), (7, rows[7][1]), (8, [0.3] * 4)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("cluster", "id", "e", "own", "block")})
    got = sorted(str(tuple(r)) for r in yinyang.cluster(d.repartition(3), k, rounds=6, dim=4, groups=groups).collect())
    assert got == brute(rows, k, 6, 4)


def test_no_rounds_empty_and_huge(spark):
    rows = [(1, [1e308, -1.0]), (2, [1e300, 5.0]), (3, [0.0, 0.1]), (4, [2.0**53, 3.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rounds in (0, 3):
        assert sorted(str(tuple(r)) for r in yinyang.cluster(d, 2, rounds=rounds, dim=2).collect()) == brute(rows, 2, rounds, 2)
    none = yinyang.cluster(d.limit(0), 2, dim=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_filters_spare_work(spark):
    rng = random.Random(2)
    x = yinyang.np.array([[1000 * (i % 5) + rng.randint(-9, 9), rng.randint(-9, 9)] for i in range(500)])
    g = yinyang.grouped([[1000 * i, 0] for i in range(5)], 3)
    b = yinyang.Bounds(x, g)
    before = {"own": b.own.astype("int32").tobytes(), "upper": b.upper.tobytes(), "lower": b.lower.tobytes()}
    seen = []
    old, yinyang._squares = yinyang._squares, lambda x, c: seen.append(len(x)) or old(x, c)
    try:
        after = yinyang.Bounds(x, yinyang.Groups([[c[0] + 3, 1] for c in g.at], g.group), before, [4.0] * 5)
    finally:
        yinyang._squares = old
    assert sum(seen) == 0 and (after.own == b.own).all()
