"""Names of sets' bits are looked up in constant tables, not searched bit by bit."""

import random

from pyspark.sql import functions as F

from causeway.functions import bits


def test_names_of_set_bits(spark):
    rng = random.Random(5)
    every = [(b, f"n{b}, \"{b}'\\") for b in range(150)]
    shuffled = rng.sample(every, 150)
    values = [0, (1 << 192) - 1, *(1 << b for b in range(0, 150, 7)), *(rng.getrandbits(192) for _ in range(20))]
    rows = [tuple(bits.signed(x >> 64 * i & (1 << 64) - 1) for i in range(3)) for x in values]
    df = spark.createDataFrame(rows, "s0 long, s1 long, s2 long")
    for names in (every, every[3:9], every[60:70], every[::3], shuffled, every[:1], []):
        got = df.select(bits.members(bits.words("s", 3), names).alias("m"))
        assert [r["m"] for r in got.collect()] == [[s for b, s in names if x >> b & 1] for x in values]
    plan = df.select(bits.members(bits.words("s", 3), every).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "from_json" not in plan.lower()
