"""Property test: the exact profile equals a brute-force computation on
random small tables (ints, doubles incl. NaN and -0.0, strings incl. long
and non-ASCII values, NULLs everywhere)."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakelens.operators.profile import profile

ints = st.one_of(st.none(), st.integers(min_value=-(2 ** 63), max_value=2 ** 63 - 1))
dbls = st.one_of(st.none(), st.sampled_from([0.0, -0.0, float("nan"), 1.5, -2.25, 1e300]),
                 st.floats(allow_nan=False, allow_infinity=False, width=64))
strs = st.one_of(st.none(), st.text(max_size=5), st.text(min_size=40, max_size=60),
                 st.sampled_from(["", "a", "é", "日本"]))
rows = st.lists(st.tuples(ints, dbls, strs), min_size=0, max_size=25)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def _brute(values):
    vals = [v for v in values if v is not None]
    distinct = len({_norm(v) for v in vals})
    return len(values) - len(vals), distinct


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows)
def test_exact_profile_matches_brute_force(spark, data):
    df = spark.createDataFrame(data, "i bigint, d double, s string")
    got = {r.column_name: r for r in profile(df, "t", distinct="exact").collect()}
    for idx, name in enumerate(("i", "d", "s")):
        col = [r[idx] for r in data]
        nulls, distinct = _brute(col)
        r = got[name]
        assert r.row_count == len(data) and r.null_count == nulls and r.distinct_count == distinct, name
        vals = [v for v in col if v is not None]
        if name == "i":
            assert (r.min_int, r.max_int) == ((min(vals), max(vals)) if vals else (None, None))
        if name == "s":
            assert (r.min_str, r.max_str) == ((min(vals, key=lambda x: x.encode()),
                                               max(vals, key=lambda x: x.encode())) if vals else (None, None))
            assert r.max_len == (max(len(v) for v in vals) if vals else None)
        if name == "d" and vals:
            finite = [v for v in vals if not math.isnan(v)]
            if finite:
                assert r.min_num == min(finite)
            if any(math.isnan(v) for v in vals):
                assert math.isnan(r.max_num)  # NaN sorts last in Spark
            else:
                assert r.max_num == max(finite)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-10 ** 12, 10 ** 12), st.text(max_size=8)), min_size=1, max_size=40,
                unique_by=str),
       st.integers(0, 10 ** 6), st.floats(0, 100))
def test_hash_sample_matches_md5_rule(spark, keys, seed, percent):
    import hashlib

    from lakelens.operators.sampling import hash_sample
    df = spark.createDataFrame([(str(k),) for k in keys], "k string")
    got = {r.k for r in hash_sample(df, percent, "k", seed).collect()}
    want = {str(k) for k in keys
            if int(hashlib.md5(f"{seed}|v{k}".encode()).hexdigest()[:13], 16) / 16 ** 13 < percent / 100}
    assert got == want


def test_null_keys_and_small_percentages(spark):
    from lakelens.operators.sampling import hash_sample
    df = spark.createDataFrame([(None, "x"), ("x", None), ("", "x"), (None, None)], "a string, b string")
    from lakelens.functions.hashing import hash_fraction
    from pyspark.sql import functions as F
    assert df.select(hash_fraction(1, F.col("a"), F.col("b")).alias("h")).distinct().count() == 4
    assert 5 <= hash_sample(spark.range(2_000_000), 0.001, "id").count() <= 40
