"""Sweeps of clustered levels by a plain loop, as operators.sweeps must give them."""

from collections import deque
from itertools import groupby

from tidebar.operators.machines import NAN, valid


class Sweeps:
    """Clusters of at least two swing levels of the last bars (this one left out) are liquidity. A wick through the nearest cluster beyond the close waits
    for a close back inside within m bars. Order: distances, confirmation, new breach, ages."""

    def __init__(self, tolerance: float = 0.10, lookback: int = 50, m: int = 2, validity: int = 6):
        self.tolerance, self.m, self.validity, self.now = tolerance, m, validity, -1
        self.levels = {s: deque(maxlen=lookback) for s in ("bsl", "ssl")}
        self.waiting: dict[str, tuple[float, int, float] | None] = {"bsl": None, "ssl": None}
        self.last: dict[str, int | None] = {"bsl": None, "ssl": None}

    def outputs(self) -> list[str]:
        return [x for s in ("bsl", "ssl") for x in (f"sweep_{s}_fired", f"sweep_{s}_age", f"sweep_{s}_pen_atr", f"unswept_{s}_atr")]

    def _clusters(self, levels: list[float], near: float) -> list[float]:
        """Means of chains in which each level is near the one before it."""
        ordered = sorted(levels)
        chain = [0]
        for a, b in zip(ordered, ordered[1:], strict=False):
            chain.append(chain[-1] + (b - a > near))
        groups = [[p for _, p in g] for _, g in groupby(zip(chain, ordered, strict=False), key=lambda x: x[0])]
        return [sum(g) / len(g) for g in groups if len(g) >= 2]

    def step(self, bar) -> dict:  # noqa: ANN001
        self.now += 1
        ok = valid(bar.atr)
        atr = bar.atr if ok else 1e-9
        out = dict.fromkeys(self.outputs(), NAN)
        for s, sign in (("bsl", 1), ("ssl", -1)):
            beyond = [p for p in self._clusters([p for p in self.levels[s] if p is not None], self.tolerance * atr) if (p - bar.close) * sign > 0]
            nearest = min(beyond, key=lambda p: (p - bar.close) * sign) if beyond else None  # noqa: B023
            if nearest is not None and ok:
                out[f"unswept_{s}_atr"] = abs(nearest - bar.close) / atr
            out[f"sweep_{s}_fired"] = 0.0
            if self.waiting[s]:
                level, at, depth = self.waiting[s]
                if self.now - at > self.m:
                    self.waiting[s] = None
                elif (level - bar.close) * sign > 0:
                    out[f"sweep_{s}_fired"], out[f"sweep_{s}_pen_atr"] = 1.0, depth
                    self.last[s], self.waiting[s] = self.now, None
            tip = bar.high if sign > 0 else bar.low
            if nearest is not None and self.waiting[s] is None and (tip - nearest) * sign > 0:
                self.waiting[s] = (nearest, self.now, abs(tip - nearest) / atr if ok else 0.0)
            if self.last[s] is not None and self.now - self.last[s] <= self.validity:
                out[f"sweep_{s}_age"] = float(self.now - self.last[s])
        self.levels["bsl"].append(bar.last_high if bar.swing_high else None)
        self.levels["ssl"].append(bar.last_low if bar.swing_low else None)
        return out
