"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """``v`` and ``root``, the smallest vertex of its component, for every vertex of ``links``
    (columns ``a``, ``b``, same type). Self links make a vertex a component of its own.

    Every vertex hooks to its smallest neighbour, chains of hooks are shortened until they
    end at roots, and the links between roots are next: each round at least halves the roots
    of a component. Vertices with many links are pre-aggregated where they are read.
    """
    links = staged(links.select("a", "b").distinct(), "links")
    found = None
    while True:
        both = links.union(links.select("b", "a")).toDF("v", "u")
        hooks = both.groupBy("v").agg(F.min(F.least("u", "v")).alias("root"))
        hooks = staged(hooks, "hooks")
        while True:
            up = hooks.select(F.col("v").alias("root"), F.col("root").alias("top"))
            jumped = staged(hooks.join(up, "root").select("v", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "jumps")
            moved = not jumped.filter("moved").isEmpty()
            hooks = jumped.select("v", "root")
            if not moved:
                break
        if found is None:
            found = hooks
        else:
            onward = hooks.select(F.col("v").alias("root"), F.col("root").alias("top"))
            found = staged(
                found.join(onward, "root", "left").select("v", F.coalesce("top", "root").alias("root")), "roots"
            )
        a = hooks.select(F.col("v").alias("a"), F.col("root").alias("ra"))
        b = hooks.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        links = links.join(a, "a").join(b, "b").filter("ra <> rb")
        links = staged(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        if links.isEmpty():
            return found
