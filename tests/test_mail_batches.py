import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigil.functions import mail as M


@pytest.fixture
def arrow(spark):
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    kept = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.unset(k)
    yield spark
    for k, v in kept.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _together(rows):
    """How many messages a worker is given at once, at most."""

    @F.arrow_udf("int")
    def together(texts: pa.Array) -> pa.Array:
        return pa.array([len(texts)] * len(texts), pa.int32())

    return M.parsed(rows).select("body", together("raw").alias("n")).agg(F.max("n"), F.count("*"), F.sum(F.length("body"))).first()


def test_a_worker_holds_few_long_messages(arrow):
    rows = arrow.range(0, 40, 1, 1).select(F.concat(F.lit("Subject: a\n\n"), F.repeat(F.lit("x"), 500_000)).alias("raw"))
    n, total, length = _together(rows)
    assert (total, length) == (40, 40 * 500_000)
    assert n <= 10


def test_a_worker_holds_some_hundred_short_messages(arrow):
    rows = arrow.range(0, 3000, 1, 1).select(F.concat(F.lit("Subject: a\n\n"), F.col("id").cast("string")).alias("raw"))
    n, total, _ = _together(rows)
    assert total == 3000 and n <= 500
    assert M.parsed(rows.limit(0)).collect() == []
