"""Diverse selection under quotas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How often a source may be taken in the first pass and in all.
FIRST_PASS, IN_ALL = 2, 3


def balanced(group: pd.DataFrame, categories: list[str], target: int, most_local: int, source_caps: dict[str, int]) -> pd.DataFrame:
    """One item of each category in turn, then the best of the rest, under source and local quotas.

    group: id, category, source, is_local, is_central, scope_score, priority_score, published_at.
    """
    rows = group.sort_values(["priority_score", "published_at", "id"], ascending=[False, False, True], kind="stable")
    category, source, is_local = (rows[c].tolist() for c in ("category", "source", "is_local"))
    taken: list[int] = []
    used: dict[str, int] = {}
    local = 0

    def take(positions, limit: int, once: bool) -> None:
        nonlocal local
        for at in positions:
            if len(taken) >= target:
                return
            own = source[at]
            count = used.get(own, 0)
            if count >= min(limit, source_caps.get(own, limit)) or (is_local[at] and local >= most_local) or at in taken:
                continue
            taken.append(at)
            used[own] = count + 1
            local += bool(is_local[at])
            if once:
                return

    for name in categories:
        take([i for i, c in enumerate(category) if c == name], FIRST_PASS, True)
    take(range(len(rows)), IN_ALL, False)
    chosen = rows.iloc[taken].sort_values(["is_central", "scope_score", "priority_score", "id"], ascending=[False, False, False, True], kind="stable").head(target)
    return chosen.assign(rank=range(1, len(chosen) + 1))


def select_balanced(
    items: DataFrame, by: list[str], categories: list[str], target: int = 10, most_local: int = 1, source_caps: dict[str, int] | None = None
) -> DataFrame:
    """balanced() for each group of `by`.

    A source is taken at most IN_ALL times and every reason to pass an item over holds for what follows it from the same
    source and category, so only the first IN_ALL items of each category and source can be chosen: the rest is left out
    before the groups are formed, which bounds them by categories times sources. Local items are cut the same way.
    """
    order = [F.desc("priority_score"), F.desc("published_at"), F.asc("id")]
    rank = F.row_number().over(Window.partitionBy(*by, "category", "source", "is_local").orderBy(*order))
    few = items.withColumn("_rank", rank).where(F.col("_rank") <= IN_ALL).drop("_rank")
    columns = [*by, "id", "category", "source", "is_local", "is_central", "scope_score", "priority_score", "published_at"]
    few = few.select(*columns)
    caps = source_caps or {}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in few.schema.fields) + ", rank bigint"
    return few.groupBy(*by).applyInPandas(lambda group: balanced(group, categories, target, most_local, caps)[[*columns, "rank"]], schema)
