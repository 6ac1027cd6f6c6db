"""The replay of a test on recorded sessions: what each design would have measured, by day and share of treated sessions.

Users and days are vectors as in the bootstrap; one aggregation gives their matrices by day (and
arm), a few numbers from which the driver reads every figure.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.functions import experiment as E
from basketflow.functions.bootstrap import Test


def test_of(shares: tuple[float, ...], x: tuple[str, ...]) -> Test:
    return Test(tuple(f"t{j}" for j in range(len(shares))), tuple(f"i{j}" for j in range(len(shares))), x)


def panel(sessions: DataFrame, shown: DataFrame, covariates: DataFrame, shares: tuple[float, ...], days: int, x: tuple[str, ...]) -> DataFrame:
    """(user_id, day, columns of test_of): cumulated by day, users from their first day on.

    sessions: (session, user_id, day, hit, hit_t, credit, credit_aa); shown: (session, share) of treated sessions; a user
    without covariates has zeros.
    """
    own = shown.groupBy("session").agg(F.max(F.lit(1)).alias("any"), F.collect_set("share").alias("in"))
    rows = sessions.join(own, "session", "left")
    there = lambda q: F.coalesce(F.array_contains("in", float(q)), F.lit(False))
    cols = {"c": F.col("hit"), "a": F.col("credit_aa")}
    cols |= {f"t{j}": F.when(there(q), F.col("hit_t")).otherwise(F.col("hit")) for j, q in enumerate(shares)}
    cols |= {f"i{j}": F.when(there(q), F.col("credit")).otherwise(F.col("credit_aa")) for j, q in enumerate(shares)}
    grid = E.panel(rows.select("user_id", "day", *(v.cast("long").alias(k) for k, v in cols.items())), days, tuple(cols)).where("active = 1").drop("active")
    return grid.join(covariates.select("user_id", *x), "user_id", "left").fillna(0.0, list(x))


def matrices(rows: DataFrame, test: Test, *by: str) -> dict[tuple, np.ndarray]:
    """The summed outer products of the vectors of each group; a few groups."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in test.columns)]
    d = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d)]
    out = {}
    for r in rows.groupBy(*by).agg(*sums).collect():
        m = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        out[tuple(r[k] for k in by)] = m
    return out


def truths(by_day: dict[tuple, np.ndarray], test: Test, shares: tuple[float, ...]) -> list[dict]:
    """Of each day and share, over all users active by then: true effect and preference, and what a test would have for errors."""
    out = []
    for (day,), m in sorted(by_day.items()):
        control, var = test.ratio(m, test.control)
        pull = test.pull(m, test.control)[1]
        x = list(test.x)
        spread = m[np.ix_(x, x)] - np.outer(m[0, x], m[0, x]) / m[0, 0]
        left = pull.copy()
        left[x] -= np.linalg.pinv(spread, hermitian=True) @ (m[x] @ pull)
        reduction = 1 - test.variance(m, left) / var if var > 0 else 0.0
        se, (aa, aa_var) = math.sqrt(4 * var), test.ratio(m, test.itself)  # two arms of half the users each
        for q, t, i in zip(shares, test.treatments, test.credits, strict=True):
            (rt, _), (pref, pref_var) = test.ratio(m, t), test.ratio(m, i)
            out.append({
                "day": day, "share": q, "users": int(m[0, 0]), "sessions": int(m[0, 1]), "control": float(control), "effect": float(rt - control), "se": se, "reduction": float(reduction),
                "cuped_se": se * math.sqrt(max(0.0, 1 - reduction)), "preference": float(pref), "preference_se": math.sqrt(max(0.0, pref_var)), "aa": float(aa), "aa_se": math.sqrt(max(0.0, aa_var)),
            })
    return out


def powers(row: dict) -> dict[str, float]:
    """Power of the three designs for a row of truths."""
    pairs = {"ab": ("effect", "se"), "ab_cuped": ("effect", "cuped_se"), "interleaving": ("preference", "preference_se")}
    return {k: E.power(row[e], row[s]) if row[s] > 0 else 0.0 for k, (e, s) in pairs.items()}


def first_day(power: list[float], target: float = E.POWER) -> int | None:
    """Days until a test's power first reaches target; None if it does not."""
    return next((d + 1 for d, p in enumerate(power) if p >= target), None)


def tested(effect: float, se: float) -> dict[str, float | None]:
    """An estimate with its error, 95 % interval and p-value; all but the effect are None where there is no error."""
    if not se > 0:
        return {"effect": effect, "se": None, "lo": None, "hi": None, "p": None}
    reach = E.z_alpha() * se
    return {"effect": effect, "se": se, "lo": effect - reach, "hi": effect + reach, "p": E.p_value(effect, se)}


def sensitivity(rows: list[dict]) -> list[dict]:
    """By share: days to 80 % power of each design, users needed for the week's effect, and how many times as many an A/B test needs."""
    out = []
    for q in sorted({r["share"] for r in rows}, reverse=True):
        week = sorted((r for r in rows if r["share"] == q), key=lambda r: r["day"])
        last, by = week[-1], [powers(r) for r in week]
        need = lambda effect, se, last=last: E.users_needed(effect, se * se * last["users"]) if effect else None
        ab, cuped, il = need(last["effect"], last["se"]), need(last["effect"], last["cuped_se"]), need(last["preference"], last["preference_se"])
        times = lambda a, b: a / b if a and b else None
        out.append({
            "share": q, **{f"days_{k}": first_day([p[k] for p in by]) for k in ("ab", "ab_cuped", "interleaving")}, "users_ab": ab, "users_ab_cuped": cuped, "users_interleaving": il,
            "ab_over_interleaving": times(ab, il), "ab_over_cuped": times(ab, cuped),
        })
    return out


def simulated(rows: DataFrame) -> DataFrame:
    """(day, treatment, shares of replicates that reject) of bootstrap rows: the tests' power and, for aa, their error."""
    z = E.z_alpha()
    rejects = lambda e, s: F.avg((F.abs(F.try_divide(e, s)) > z).cast("double"))
    pairs = {"ab": ("ab", "ab_se"), "ab_cuped": ("cuped", "cuped_se"), "interleaving": ("il", "il_se"), "aa": ("aa", "aa_se"), "aa_naive": ("aa", "aa_se_naive"), "aa_cuped": ("aa_cuped", "aa_cuped_se"), "aa_interleaving": ("aa_il", "aa_il_se")}
    measured = {"reduction_measured": 1 - F.try_divide(F.var_pop("aa_cuped"), F.var_pop("aa")), "mean_ab": F.avg("ab"), "mean_cuped": F.avg("cuped")}
    clean = rows.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))
    return clean.groupBy("day", "treatment").agg(*(rejects(F.col(e), F.col(s)).alias(k) for k, (e, s) in pairs.items()), *(v.alias(k) for k, v in measured.items()))
