import random

import numpy as np
import pytest

from waymesh.operators import profile


def plain(values, weights, k):
    """Least squared deviation by trying every start of the last class."""
    v, w = np.asarray(values, float), np.asarray(weights, float)
    v0 = v - v.mean()
    sw, sx, sxx = (np.concatenate(([0], np.cumsum(a))) for a in (w, w * v0, w * v0 * v0))
    spread = lambda a, b: (sxx[b] - sxx[a]) - (sx[b] - sx[a]) ** 2 / (sw[b] - sw[a])
    best = [(spread(0, j), [v[j - 1]]) for j in range(1, len(v) + 1)]
    for m in range(1, k):
        now = [(np.inf, [])] * len(v)
        costs = np.array([b[0] for b in best])
        for j in range(m, len(v)):
            starts = np.arange(1, j + 1)
            total = costs[starts - 1] + spread(starts, j + 1)
            s = int(starts[total.argmin()])
            now[j] = (total.min(), best[s - 1][1] + [v[j]])
        best = now
    return [float(x) for x in best[-1][1]]


@pytest.mark.parametrize("step", [1 << 20, 7])
def test_search_matches_trying_every_start(monkeypatch, step):
    monkeypatch.setattr(profile, "STEP", step)
    rng = random.Random(1)
    for n in (1, 2, 3, 5, 8, 40, 300):
        values = sorted({round(rng.choice([rng.gauss(0, 1), rng.gauss(50, 9), rng.expovariate(0.01)]), 3) for _ in range(n)})
        weights = [rng.randint(1, 30) for _ in values]
        for k in (1, 2, 3, 5, 9):
            assert profile.natural_breaks(values, weights, k) == plain(values, weights, min(k, len(values))), (n, k)


def test_many_distinct_values_are_exact(spark):
    rng = random.Random(2)
    values = [rng.randint(0, 10**6) / 100 for _ in range(6000)] + [40_000.25, 41_000.5, 90_000.75, 95_000.0]  # tails of under 1/2000 of the rows
    count = {v: values.count(v) for v in set(values)}
    assert len(count) > 5000
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    keys = sorted(count)
    for scheme in ("natural_breaks", "fisher_jenks"):
        assert profile.class_breaks(df, "v", scheme, 5) == plain(keys, [count[x] for x in keys], 5)
