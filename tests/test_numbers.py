from __future__ import annotations

import random

import duckdb

from quillspark.functions.numbers import rounded
from quillspark.operators.disambiguation import aggregates


def test_rounded_equals_sql(spark):
    """Ties of the decimal text that are none of the scaled double, as in wsum_aggregates' 8.1885225."""
    rng = random.Random(3)
    values = [8.1885225, 4.0688175, -8.1885225, 0.0, 0.5, 1e300, 123456789012.1234565, float("inf"), None]
    values += [(rng.randint(0, 10**9) + 0.5) / 1e6 * rng.choice([1, -1]) for _ in range(500)] + [rng.uniform(-50, 50) for _ in range(100)]
    got = [r.r for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(rounded("x", 6).alias("r")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchall()[0][0] for x in values]


def test_means_do_not_depend_on_the_order_of_rows(spark):
    rows = [("a", 1, 0.1), ("b", 2, 0.7), ("c", 3, 0.2), ("d", 4, 1e16), ("e", 5, -1e16)]
    want = (((0.1 + 0.7) + 0.2) + 1e16 - 1e16) / 5  # Python's sum() would compensate
    for _ in range(3):
        random.shuffle(rows)
        df = spark.createDataFrame([("s", *r) for r in rows], "s string, mention string, en_id int, v double").coalesce(1)
        assert aggregates(df, ["v"], ["s"]).first().v_avg == want
