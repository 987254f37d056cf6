"""Small graphs under many shuffle partitions."""

import pytest

from framelake.llm import simhash
from framelake.llm.components import LEAST_TASKS, components


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_small_graphs_take_few_tasks(spark, many_partitions):
    """A path and a star: each step runs in few tasks, and so does what comes out."""
    pairs = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 50)]
    out = components(spark.createDataFrame(pairs, "a long, b long"))
    assert out.rdd.getNumPartitions() <= 2 * LEAST_TASKS
    assert {r["node"]: r["component"] for r in out.collect()} == {i: 0 for i in range(51)} | {i: 1000 for i in range(1000, 1050)}


def test_hubs_are_least(spark):
    """The members of a large posting are linked to the least one, so that the same input always gives the same links."""
    fps = [1 << b for b in range(32)] + [0, 3, 5, 9]
    found = simhash.links(spark.createDataFrame([(f,) for f in reversed(fps)], "fp long").repartition(7)).collect()
    assert len(found) > 32 and all(r["a"] < r["b"] for r in found)
