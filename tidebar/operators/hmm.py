"""A Gaussian hidden Markov model with three states over daily returns, fitted and read causally."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.operators.bars import in_order


class GaussianHmm:
    def __init__(self, states: int = 3, rounds: int = 50, tolerance: float = 1e-4):
        self.k, self.rounds, self.tolerance = states, rounds, tolerance

    def _density(self, x: np.ndarray) -> np.ndarray:
        return np.exp(-((x[:, None] - self.mean) ** 2) / (2 * self.var)) / np.sqrt(2 * np.pi * self.var) + 1e-300

    def filtered(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the states given what is known so far, and the scale of each step."""
        b, out, scale = self._density(x), np.empty((len(x), self.k)), np.empty(len(x))
        prior = self.start
        for t in range(len(x)):
            p = prior * b[t]
            scale[t] = p.sum()
            out[t] = p / scale[t]
            prior = out[t] @ self.move
        return out, scale

    def fit(self, x: np.ndarray) -> GaussianHmm:
        edges = np.quantile(x, np.linspace(0, 1, self.k + 1)[1:-1])
        part = np.searchsorted(edges, x)
        floor = max(x.var() * 1e-3, 1e-12)
        self.mean = np.array([x[part == j].mean() if (part == j).any() else x.mean() for j in range(self.k)])
        self.var = np.array([max(x[part == j].var(), floor) if (part == j).any() else x.var() + floor for j in range(self.k)])
        self.start, self.move = np.full(self.k, 1 / self.k), np.full((self.k, self.k), 0.1 / (self.k - 1))
        np.fill_diagonal(self.move, 0.9)
        before = -np.inf
        for _ in range(self.rounds):
            alpha, scale = self.filtered(x)
            b, beta = self._density(x), np.ones((len(x), self.k))
            for t in range(len(x) - 2, -1, -1):
                beta[t] = self.move @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
            gamma = alpha * beta
            gamma /= gamma.sum(axis=1, keepdims=True)
            pairs = np.einsum("ti,ij,tj->ij", alpha[:-1], self.move, b[1:] * beta[1:] / scale[1:, None])
            self.start, self.move = gamma[0], pairs / pairs.sum(axis=1, keepdims=True)
            weight = gamma.sum(axis=0)
            self.mean = gamma.T @ x / weight
            self.var = np.maximum((gamma * (x[:, None] - self.mean) ** 2).sum(axis=0) / weight, floor)
            likelihood = np.log(scale).sum()
            if abs(likelihood - before) < self.tolerance:
                break
            before = likelihood
        order = np.argsort(self.var)  # state 0 is the calmest
        self.mean, self.var, self.start, self.move = self.mean[order], self.var[order], self.start[order], self.move[np.ix_(order, order)]
        return self


def regimes(daily: DataFrame, least: int = 252, span: int = 365, every: int = 180, read: int = 60, delay: int = 2) -> DataFrame:
    """Per series and day the probabilities of three volatility states, from fits on the days before; the result of a day is shown `delay` days on."""
    r = daily.withColumn("r", F.log(F.col("close") / F.lag("close").over(in_order()))).select("series_id", "ts", "bar_idx", "r")

    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx").reset_index(drop=True)
        x = pdf["r"].fillna(0.0).to_numpy()
        probs, model, fitted = np.full((len(x), 3), np.nan), None, -every
        for t in range(least, len(x)):
            if t - fitted >= every:
                model, fitted = GaussianHmm().fit(x[max(1, t - span) : t]), t
            probs[t] = model.filtered(x[max(1, t - read + 1) : t + 1])[0][-1]
        shown = np.vstack([np.full((min(delay, len(x)), 3), np.nan), probs[: max(0, len(x) - delay)]])
        return pd.DataFrame({"series_id": pdf["series_id"], "ts": pdf["ts"], "p_calm": shown[:, 0], "p_normal": shown[:, 1], "p_wild": shown[:, 2]})

    return r.groupBy("series_id").applyInPandas(over, "series_id string, ts timestamp_ntz, p_calm double, p_normal double, p_wild double")
