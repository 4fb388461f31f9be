import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from skarn.operators import intervals

SCHEMA = "topic_key string, valid_from bigint, valid_until bigint, entity string, start string, slice int"


def brute(rows):
    periods, gaps, by = [], [], {}
    for k, a, z in rows:
        if k is not None and a is not None and (z is None or z > a):
            by.setdefault(k, []).append((a, float("inf") if z is None else z))
    for k, v in by.items():
        v.sort()
        start, stop = v[0]
        for a, z in v[1:]:
            if a > stop:
                periods.append((k, start, stop))
                gaps.append((k, stop, a))
                start, stop = a, z
            else:
                stop = max(stop, z)
        periods.append((k, start, None if stop == float("inf") else stop))
    return sorted(periods, key=repr), sorted(gaps, key=repr)


def run(spark, rows, partitions="5"):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    df = spark.createDataFrame([(*r, "clash", "clash", 7) for r in rows], SCHEMA).repartition(3)
    c = intervals.cover(df, "topic_key", "valid_from", "valid_until")
    out = tuple(sorted((tuple(r) for r in x.collect()), key=repr) for x in (c.periods, c.gaps))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return out


@pytest.mark.parametrize("seed,keys", [(1, 1), (2, 3), (3, 40)])
def test_cover_like_brute_force(spark, seed, keys):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(400):
        a = int(rng.integers(0, 3000))
        rows.append((f"k{rng.integers(keys)}", a, None if rng.random() < 0.01 else a + int(rng.integers(-3, 12))))
    rows += rows[:20] + [(None, 1, 2), ("k0", None, 5), ("", 1, 4), ("", 4, 6), ("", 9, 10)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_null_rows(spark):
    assert run(spark, []) == ([], [])
    assert run(spark, [(None, None, None), ("a", 5, 5), ("a", 5, 4)]) == ([], [])


def test_long_interval_over_many_slices(spark):
    rows = [("hot", i * 10, i * 10 + 5) for i in range(300)] + [("hot", 100, 2500)]
    assert run(spark, rows, "9") == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30), st.integers(1, 9)), max_size=40))
def test_merge_sorted(rows):
    rows = sorted(rows)
    code, a = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    z = np.array([r[1] + r[2] for r in rows], np.int64)
    got = list(zip(*(x.tolist() for x in intervals.merge_sorted(code, a, z)))) if rows else []
    want, _ = brute([(c, s, s + w) for c, s, w in rows])
    assert sorted(got, key=repr) == want
