"""Hard negatives against all pairs, with exact integers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

pytest.importorskip("ledgerlake.llm")

from ledgerlake.llm import hard_negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
FORM = "vec_id long, embedding array<double>, label int, row int, x int, block int, at int, score int"


def plain(rows):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = [math.floor(256 * c) for c in v]
        kept.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, x))
    out = []
    for n, (i, label, x) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(max(hard_negatives.LEAST, min(hard_negatives.MOST, sum(a * b for a, b in zip(x, y)))), j, g) for m, (j, g, y) in enumerate(kept) if m != n]  # noqa: B905  the shorter one ends it
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps][:5]
            out += [(i, p, k, j, ps, s) for k, (s, j, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], FORM).repartition(parts)


def cases(seed=1, n=700, dim=6, grid=4):
    """Coarse components, so that many scores are equal."""
    r = random.Random(seed)
    rows = [(i, [r.randint(-grid, grid) / 7 for _ in range(dim)], r.randint(0, 9)) for i in range(n)]
    odd = [(None, [0.5] * dim, 3), (700, None, 1), (800, [0.1] * dim, None), (900, [0.1, None, 0.2], 2), (1000, [float("nan")] * dim, 2), (1001, [float("inf")] * dim, 2), (1100, [], 2), (1200, [0.3] * 2, 4), (1300, [0.3] * 9, 4), (-100, [0.4] * dim, 5)]
    twice = [(100, [0.25] * dim, 1), (100, [0.25] * dim, 1), (3, [0.25] * dim, 2), (3, [0.25] * dim, 2)]
    return rows + odd + twice


@pytest.mark.parametrize(("rows_", "bytes_"), [(hard_negatives.ROWS, hard_negatives.BYTES), (3, hard_negatives.BYTES), (64, 100)])
def test_negatives_equal_all_pairs_at_any_block_size(spark, rows_, bytes_):
    rows = cases()
    assert got(hard_negatives.mine(table(spark, rows), rows_, bytes_)) == plain(rows)


def test_large_values_stay_exact(spark):
    r = random.Random(4)
    rows = [(i * 25, [r.choice([1.0, 3.0, 1e6, 3e7 + 1 / 256, -2e6]) for _ in range(4)], i % 3) for i in range(60)] + [(100, [1e300, 1.0], 1), (200, [1e308, 1.0], 1)]
    rows += [(300, [4e8] * 4, 1), (301, [4e8] * 4, 1), (302, [4e8] * 4, 2)]
    rows = [x for x in rows if not x[1] or max(x[1]) < 1e307]  # 256 times that isn't finite
    assert got(hard_negatives.mine(table(spark, rows))) == plain(rows)


def test_nothing(spark):
    assert got(hard_negatives.mine(table(spark, []))) == []
    assert got(hard_negatives.mine(table(spark, [(100, [1.0], 1), (5, [1.0], 1)]))) == []


def test_best_takes_the_first_of_equals():
    s = np.array([[5, 7, 7, 7, 1], [1, 1, 1, 1, 1]])
    fits = np.array([[True] * 5, [False, True, True, False, False]])
    for scale in (1, 1 << 60):
        r, c = hard_negatives.best(s * scale if scale == 1 else np.clip(s, 0, 7) * (1 << 59), fits, 2)
        assert sorted(zip(r.tolist(), c.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 1), (1, 2)]
