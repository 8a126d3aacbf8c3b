"""Adoption with state: repeated, late and out-of-order records over several runs of one stream."""

import pytest

from graphloom.streaming import adoption

SCHEMA = "null_id long, ok boolean, at long, v double"


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, adoption.PROVIDER)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_late_repeated_and_out_of_order_records(spark, tmp_path, store):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    batches = [
        # of key 1 the earlier record is adopted; the failed one of 2 leaves it open; ids that can't be
        [(1, True, 5, 0.5), (1, True, 4, 0.4), (1, True, None, None), (2, False, 1, 0.1), (None, True, 1, 0.0), (-1, True, 1, 0.0), (9, True, 1, 0.0)],
        # a late record of 1, a repeated one, the good one of 2, a record without a check
        [(1, True, 1, 0.1), (1, True, 4, 0.4), (2, True, 3, 0.3), (3, None, 1, 1.0)],
        [(2, True, 2, 0.2), (3, True, 1, 1.0), (3, True, 1, 1.0)],
    ]
    for rows in [*batches, None]:
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        adoption.adopt(spark.readStream.schema(SCHEMA).parquet(source), out, checkpoint, 9, ["at", "v"]).awaitTermination(120)
    got = sorted(map(repr, (tuple(r) for r in spark.read.parquet(out).select("null_id", "at", "v", "verdict").collect())))
    expected = [
        (1, None, None, "adopt"), (1, 4, 0.4, "skip"), (1, 5, 0.5, "skip"), (2, 1, 0.1, "reject"), (None, 1, 0.0, "bad_id"), (-1, 1, 0.0, "bad_id"), (9, 1, 0.0, "bad_id"),
        (1, 1, 0.1, "skip"), (1, 4, 0.4, "skip"), (2, 3, 0.3, "adopt"), (3, 1, 1.0, "reject"),
        (2, 2, 0.2, "skip"), (3, 1, 1.0, "adopt"), (3, 1, 1.0, "skip"),
    ]
    assert got == sorted(map(repr, expected))
