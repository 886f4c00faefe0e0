"""Identifier functions against plain Python."""

import random

from pyspark.sql import functions as F

from assaylake.functions import ids


def size(n):
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        if n < 1024 ** (power + 1) or unit == "TiB":
            return f"{n / 1024**power:.1f} {unit}"


def test_byte_sizes_are_rounded_as_doubles_are_written(spark):
    draw = random.Random(3)
    given = {m * 1024**power // 8 for power in (1, 2, 3, 4) for m in (9, 10, 14, 26, 30, 8191)}  # among them halves of a digit
    given |= {draw.randrange(1024, 1 << bits) for bits in range(11, 64) for _ in range(40)} | {1280, 1024**2 - 1, 1024**4 - 1, 2**63 - 1}
    got = spark.createDataFrame([(n,) for n in given], "n bigint").select("n", ids.byte_size(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == {n: size(n) for n in given}
    assert size(1280) == "1.2 KiB"
    assert [r.s for r in spark.createDataFrame([(0,), (1023,)], "n bigint").select(ids.byte_size(F.col("n")).alias("s")).collect()] == ["0 B", "1023 B"]


def test_a_missing_size_is_missing(spark):
    assert spark.createDataFrame([(None,)], "n bigint").select(ids.byte_size(F.col("n")).alias("s")).first().s is None
