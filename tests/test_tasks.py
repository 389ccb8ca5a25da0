"""What one task reads of a shuffle."""

from cairn.plans.views import table
from cairn.session import TASK_SIZES

SF = "/root/testdata/sf0.001"


def test_tasks_are_bounded_unless_the_session_says_otherwise(spark):
    before = {name: spark.conf.get(name, None) for name in TASK_SIZES}
    try:
        for name in TASK_SIZES:
            spark.conf.unset(name)
        table(spark, SF, "orders")
        assert {name: spark.conf.get(name, None) for name in TASK_SIZES} == TASK_SIZES
        advisory = next(iter(TASK_SIZES))
        spark.conf.set(advisory, "5m")
        table(spark, SF, "orders")
        assert spark.conf.get(advisory) == "5m"
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
