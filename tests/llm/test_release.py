"""Memory given back between stages."""

from heron.llm import common


def test_release(spark):
    free = spark._jvm.java.lang.Runtime.getRuntime()
    common.release(spark)
    assert free.totalMemory() > 0 and spark.range(3).count() == 3
