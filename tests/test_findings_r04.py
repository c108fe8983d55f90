"""What the fourth round of findings found."""

from fractions import Fraction

from nebulark.operators import stacking

#: Once 1, 50, 7, 9 and 45 are gone, 43 is exactly 1.5 deviations from the mean of the others.
ON_LIMIT = [1, 7, 9, 13, 14, 14, 14, 14, 15, 15, 16, 19, 22, 23, 26, 27, 28, 29, 31, 32, 33, 34, 34, 35, 38, 38, 39, 41, 41, 42, 43, 45, 50]


def clipped(values, passes=5):
    """Count and mean of what stays within 1.5 deviations, in fractions; and whether a sample was on the limit."""
    left, tied = sorted(map(Fraction, values)), False
    for k in range(passes):
        n, centre = len(left), left[len(left) // 2] if k == 0 else sum(left) / len(left)
        square = (sorted(abs(v - centre) for v in left)[n // 2] * Fraction("1.4826")) ** 2 if k == 0 else sum((v - centre) ** 2 for v in left) / (n - 1)
        limit = Fraction(9, 4) * square
        tied |= k > 0 and any((v - centre) ** 2 == limit for v in left)
        left = [v for v in left if (v - centre) ** 2 <= limit]
        if len(left) == n:
            break
    return len(left), round(float(sum(left) / len(left)), 6), tied


def test_samples_on_the_limit_stay(spark):
    groups = {1: ON_LIMIT, 2: [v + 1_000_000 for v in ON_LIMIT], 3: [51 - v for v in ON_LIMIT], 4: [v / 4 for v in ON_LIMIT], 5: [*ON_LIMIT, 900]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    got = {r.pixel: (r.n - r.rejected, round(r.result, 6)) for r in stacking.sigma_clip(spark.createDataFrame(rows, "pixel int, v double"), ["pixel"], 1.5, 1.5).collect()}
    want = {k: clipped(vs) for k, vs in groups.items()}
    assert all(want[k][2] for k in (1, 2, 3, 4)) and got == {k: w[:2] for k, w in want.items()}
