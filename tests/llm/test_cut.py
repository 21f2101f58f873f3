"""A table that is cut leaves nothing of earlier rounds in the driver."""

from pluvion.llm.common import cut


def test_cut_lets_go_of_the_drivers_garbage(spark):
    jvm = spark._jvm
    held = jvm.java.util.ArrayList()
    ref = jvm.java.lang.ref.WeakReference(held)
    del held
    assert cut(spark.range(5)).count() == 5
    assert ref.get() is None
