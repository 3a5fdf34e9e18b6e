"""Ordered folds and small solvers: what windows can't express, one group at a time.

Each group is one clip, photo or set of marks; its rows come sorted inside the group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def despiked(df: DataFrame, by: str, t: str, value: str, limit: float, passes: int = 2) -> DataFrame:
    """Single samples off the line of their neighbours by more than ``limit`` (and by 1.6 of
    the neighbours' own gap) move onto it; each repair counts for the next sample."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(t, kind="stable")
        v, at = group[value].to_numpy(float).copy(), group[t].to_numpy(float)
        for _ in range(passes):
            for i in range(1, len(v) - 1):
                span = at[i + 1] - at[i - 1]
                line = v[i - 1] + (v[i + 1] - v[i - 1]) * ((at[i] - at[i - 1]) / span if span > 0 else 0.5)
                if abs(v[i] - line) > max(limit, 1.6 * abs(v[i + 1] - v[i - 1])):
                    v[i] = line
        return group.assign(**{value: v})

    return df.groupBy(by).applyInPandas(fold, df.schema)


def spaced(df: DataFrame, by: str, x: str, y: str, strength: str, least: float) -> DataFrame:
    """Greedy suppression: strongest first, none within ``least`` of one already kept."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([strength, x, y], ascending=[False, True, True], kind="stable")
        kept: list[int] = []
        p = group[[x, y]].to_numpy(float)
        for i in range(len(p)):
            if all(np.hypot(*(p[i] - p[j])) >= least for j in kept):
                kept.append(i)
        return group.iloc[kept]

    return df.groupBy(by).applyInPandas(fold, df.schema)


def homographies(df: DataFrame, by: str, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
    """Least-squares homography of each group of four or more marks, and its error."""

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        p, q = group[list(src)].to_numpy(float), group[list(dst)].to_numpy(float)
        if len(p) < 4:
            return pd.DataFrame({by: key, "h": [None], "rms": [None]})
        one, zero = np.ones(len(p)), np.zeros((len(p), 3))
        full = np.c_[p, one]
        a = np.r_[np.c_[full, zero, -q[:, :1] * p], np.c_[zero, full, -q[:, 1:] * p]]
        h = np.append(np.linalg.lstsq(a, np.r_[q[:, 0], q[:, 1]], rcond=None)[0], 1.0)
        w = full @ h.reshape(3, 3).T
        rms = float(np.sqrt(np.mean(np.sum((w[:, :2] / w[:, 2:] - q) ** 2, axis=1))))
        return pd.DataFrame({by: key, "h": [h.tolist()], "rms": [rms]})

    kind = df.schema[by].dataType.simpleString()
    return df.groupBy(by).applyInPandas(fit, f"{by} {kind}, h array<double>, rms double")


def thinned_by_gap(df: DataFrame, by: str, t: str, gap: float) -> DataFrame:
    """Greedy spacing: a sample stays when it is ``gap`` after the last that stayed."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(t, kind="stable")
        last, kept = -np.inf, []
        for v in group[t].to_numpy(float):
            kept.append(v - last >= gap)
            last = v if kept[-1] else last
        return group[kept]

    return df.groupBy(by).applyInPandas(fold, df.schema)
