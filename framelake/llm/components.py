"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is an aggregation with map-side partial minima and an equi-join, so that neither a
component nor the list of links ever has to fit in one task or in the driver. The minima are
written before they are joined: both sides of the join are then plain exchanges, and Spark splits
the part that the hub of a large component fills. Steps run in tasks of so many links as are worth
one: in a small graph the number of shuffle partitions would cost more than the work.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import cut

#: Links that are worth a task, and the tasks that there are at least.
TASK_LINKS, LEAST_TASKS = 100_000, 8


def _is_star_forest(e: DataFrame, tasks: int) -> bool:
    """Whether each source has one link and no root is a source."""
    ends = e.select(F.col("u").alias("k"), F.lit(1).alias("s"), F.lit(0).alias("r")).unionAll(e.select(F.col("v").alias("k"), F.lit(0).alias("s"), F.lit(1).alias("r")))
    bad = ends.groupBy("k").agg(F.sum("s").alias("s"), F.max("r").alias("r")).filter((F.col("s") > 1) | ((F.col("s") == 1) & (F.col("r") == 1)))
    return bad.coalesce(tasks).isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of a link; component is the least node that can be reached.

    edges: two columns of one orderable type without nulls; repeated links, both directions and
    loops are allowed. No links give no rows.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    tasks = max(LEAST_TASKS, math.ceil(e.count() / TASK_LINKS))
    e = e.coalesce(tasks)
    for _ in range(max_rounds):
        if _is_star_forest(e, tasks):
            break
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.coalesce(tasks))
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))
    else:
        raise RuntimeError("components: not converged")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().coalesce(tasks))
