"""The bootstrap of a whole test: every estimate of every day from Poisson weights of the users.

A user and day is one vector: 1, sessions, hits on the control's list, hits on each treatment's,
interleaving credits of each treatment and of the control against itself, covariates. An arm is
the weighted sum of the vectors' outer products, so every estimate is a quadratic form of that
matrix: a ratio's variance is one of the vector that gives each user's pull, an adjusted one's has
the slopes in the places of the covariates. Weights come from hashes of user, replicate and arm.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Cumulated probabilities of a Poisson count with mean 1/2.
STEPS = np.cumsum([np.exp(-0.5) * 0.5**i / np.prod(range(1, i + 1)) for i in range(14)])
BLOCK = 50
ESTIMATES = ("ab", "ab_se", "ab_se_naive", "cuped", "cuped_se", "il", "il_se", "aa", "aa_se", "aa_se_naive", "aa_cuped", "aa_cuped_se", "aa_il", "aa_il_se")


def weights(users: np.ndarray, replicate: int, arm: int, seed: int = 0) -> np.ndarray:
    """Poisson(1/2) weights of user numbers in one arm of one replicate; they depend on nothing else."""
    with np.errstate(over="ignore"):
        h = users.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + 2 * replicate + arm) * 0xBF58476D1CE4E5B9 % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return np.searchsorted(STEPS, (h >> np.uint64(11)).astype(float) / (1 << 53), "right")


class Test:
    """Names of the vector's places, and the estimates of (treated, control) matrices."""

    def __init__(self, treatments: tuple[str, ...], credits: tuple[str, ...], x: tuple[str, ...], control: str = "c", itself: str = "a"):
        self.columns = ("sessions", control, *treatments, *credits, itself, *x)
        self.place = {k: i + 1 for i, k in enumerate(self.columns)}
        self.treatments, self.credits, self.x, self.control, self.itself = treatments, credits, tuple(self.place[k] for k in x), control, itself

    def pull(self, m: np.ndarray, y: str) -> tuple[np.ndarray, np.ndarray]:
        """Of matrices m[..., i, j]: the ratio of y, and the vectors that give each user's pull on it."""
        n, r = self.place["sessions"], m[..., 0, self.place[y]] / m[..., 0, self.place["sessions"]]
        v = np.zeros(m.shape[:-1])
        v[..., self.place[y]] = 1
        v[..., n] = -r
        return r, v * (m[..., 0, 0] / m[..., 0, n])[..., None]

    @staticmethod
    def variance(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Of the mean of v over the weighted users."""
        n = m[..., 0, 0]
        first = np.einsum("...i,...i->...", m[..., 0, :], v)
        return (np.einsum("...i,...ij,...j->...", v, m, v) - first * first / n) / (n * (n - 1))

    def ratio(self, m: np.ndarray, y: str) -> tuple[np.ndarray, np.ndarray]:
        r, v = self.pull(m, y)
        return r, self.variance(m, v)

    def difference(self, t: np.ndarray, c: np.ndarray, y: str) -> dict[str, np.ndarray]:
        """Effect of y in t against the control in c: plain, with the naive error, and adjusted for covariates."""
        (rt, vt), (rc, vc) = self.pull(t, y), self.pull(c, self.control)
        out = {"": rt - rc, "_se": np.sqrt(self.variance(t, vt) + self.variance(c, vc))}
        sessions = self.place["sessions"]
        out["_se_naive"] = np.sqrt(rt * (1 - rt) / t[..., 0, sessions] + rc * (1 - rc) / c[..., 0, sessions])
        x, both = list(self.x), t + c
        mean = both[..., 0, x] / both[..., 0, 0, None]
        spread = both[..., x, :][..., x] - both[..., 0, 0, None, None] * mean[..., :, None] * mean[..., None, :]
        shared = np.einsum("...ij,...j->...i", t[..., x, :], vt) + np.einsum("...ij,...j->...i", c[..., x, :], vc)
        slope = np.einsum("...ij,...j->...i", np.linalg.pinv(spread, hermitian=True), shared)
        for v in (vt, vc):
            v[..., x] -= slope
        gap = t[..., 0, x] / t[..., 0, 0, None] - c[..., 0, x] / c[..., 0, 0, None]
        out["cuped"], out["cuped_se"] = rt - rc - (slope * gap).sum(-1), np.sqrt(self.variance(t, vt) + self.variance(c, vc))
        return out

    def estimates(self, t: np.ndarray, c: np.ndarray) -> list[dict[str, np.ndarray]]:
        """ESTIMATES of each treatment; the aa ones have both arms on the control, and for interleaving its credits, turned round in c."""
        itself, swapped = self.difference(t, c, self.control), (t + c).copy()
        a, n = self.place[self.itself], self.place["sessions"]
        for i in (0, n):
            swapped[..., i, a] = swapped[..., a, i] = t[..., i, a] - c[..., i, a]
        pref, var = self.ratio(swapped, self.itself)
        fixed = {"aa": itself[""], "aa_se": itself["_se"], "aa_se_naive": itself["_se_naive"], "aa_cuped": itself["cuped"], "aa_cuped_se": itself["cuped_se"], "aa_il": pref, "aa_il_se": np.sqrt(var)}
        out = []
        for y, credit in zip(self.treatments, self.credits, strict=True):
            d, (il, il_var) = self.difference(t, c, y), self.ratio(t + c, credit)
            out.append({"ab": d[""], "ab_se": d["_se"], "ab_se_naive": d["_se_naive"], "cuped": d["cuped"], "cuped_se": d["cuped_se"], "il": il, "il_se": np.sqrt(il_var), **fixed})
        return out


def simulate(panel: DataFrame, test: Test, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, day, treatment, ESTIMATES) from rows (user_id, day, test.columns) of the users active by each day.

    Batches multiply their weights with their products; a replicate's parts, one for each batch and day, are added and
    estimated together.
    """
    d = len(test.columns) + 1
    upper = np.triu_indices(d)

    def run(batches):
        for pdf in batches:
            for day, rows in pdf.groupby("day"):
                v = np.column_stack([np.ones(len(rows)), rows[list(test.columns)].to_numpy(float)])
                products, users = v[:, upper[0]] * v[:, upper[1]], rows["user_id"].to_numpy()
                for lo in range(0, replicates, BLOCK):
                    r = range(lo, min(replicates, lo + BLOCK))
                    for arm in (0, 1):
                        w = np.stack([weights(users, i, arm, seed) for i in r]).astype(float)
                        yield pd.DataFrame({"replicate": list(r), "day": day, "arm": arm, "sums": list(w @ products)})

    def estimated(pdf: pd.DataFrame) -> pd.DataFrame:
        days, out = np.sort(pdf["day"].unique()), []
        m = np.zeros((2, len(days), d, d))
        for (day, arm), rows in pdf.groupby(["day", "arm"]):
            m[arm, np.searchsorted(days, day)][upper] = np.sum(rows["sums"].tolist(), axis=0)
        m = m + np.triu(m, 1).swapaxes(-1, -2)
        with np.errstate(divide="ignore", invalid="ignore"):
            for name, got in zip(test.treatments, test.estimates(m[1], m[0]), strict=True):
                out.append(pd.DataFrame({"replicate": pdf["replicate"].iloc[0], "day": days, "treatment": name, **{k: got[k] for k in ESTIMATES}}))
        return pd.concat(out)

    parts = panel.select("user_id", "day", *test.columns).mapInPandas(run, "replicate int, day int, arm int, sums array<double>")
    return parts.groupBy("replicate").applyInPandas(estimated, "replicate int, day int, treatment string, " + ", ".join(f"{k} double" for k in ESTIMATES))
