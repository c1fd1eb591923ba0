"""Values that the console shows, digit by digit."""

from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T


@pytest.mark.parametrize("unit", [1000, 60000])
def test_tenths(spark, unit):
    """Like toFixed(1), the nearest to the exact value of the quotient, upwards if two are as near."""
    got = spark.range(unit, 40 * unit, 50).select("id", T.tenths(F.col("id"), unit).alias("t")).collect()
    assert [r.t for r in got] == [str(Decimal(r.id / unit).quantize(Decimal("0.1"), ROUND_HALF_UP)) for r in got]
