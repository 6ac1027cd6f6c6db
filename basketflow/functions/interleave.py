"""Team draft interleaving: greedy work in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def team_draft_one(a, b, coins, k: int = 20) -> tuple[list[int], list[int]]:
    """Items and teams (1: a, -1: b): the team with fewer picks goes next, the coin of the place decides ties.

    A team takes its best item that is not in the list yet; one with none left passes; -1 (team 0) pads.
    """
    items, teams, seen = [], [], set()
    left = [[x for x in lst if x >= 0] for lst in (a, b)]
    at, picks = [0, 0], [0, 0]
    while len(items) < k:
        for side in (0, 1):
            while at[side] < len(left[side]) and left[side][at[side]] in seen:
                at[side] += 1
        open_ = [at[s] < len(left[s]) for s in (0, 1)]
        if not any(open_):
            break
        side = (0 if coins[len(items)] else 1) if picks[0] == picks[1] else int(picks[0] > picks[1])
        if not open_[side]:
            side = 1 - side
        items.append(left[side][at[side]])
        seen.add(items[-1])
        picks[side] += 1
        teams.append(1 - 2 * side)
    pad = k - len(items)
    return items + [-1] * pad, teams + [0] * pad


def team_draft(rows: DataFrame, a: str, b: str, k: int = 20, seed: int = 0) -> DataFrame:
    """Adds items and team; the coins of a session are bits of a seeded hash."""

    @F.pandas_udf("items array<long>, team array<int>")
    def draft(x: pd.Series, y: pd.Series, bits: pd.Series) -> pd.DataFrame:
        out = [team_draft_one(p, q, [(int(h, 16) >> i) & 1 for i in range(k)], k) for p, q, h in zip(x, y, bits, strict=True)]
        return pd.DataFrame({"items": [o[0] for o in out], "team": [o[1] for o in out]})

    bits = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("session").cast("string")), 256)
    return rows.withColumn("d", draft(a, b, bits)).select("*", "d.items", "d.team").drop("d")


