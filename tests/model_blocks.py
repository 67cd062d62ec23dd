"""Anchored order blocks by a plain loop, as operators.zones must give them."""

import math
from collections import deque

from tidebar.operators.machines import NAN, Zone, unit, valid

BLOCK_WEIGHTS = (0.45, 0.35, 0.20)
BLOCK_GAP, BLOCK_TESTED, BLOCK_AGE = 1.25, 0.85, 200


class AnchoredBlocks:
    """At a break: the last displacement (this bar included), then the last candle of the other colour before it, make a zone. It is fresh until half of
    it is penetrated, and gone when it was tested and a bar closes beyond it, or when it is too old. A zone is updated on the bar that makes it."""

    SHOWN = 3

    def __init__(self, disp_search: int = 30, anchor_search: int = 20, cap: int = 200, half: float = 0.5):
        self.disp_search, self.anchor_search, self.cap, self.half = disp_search, anchor_search, cap, half
        self.now, self.past = -1, deque(maxlen=disp_search + anchor_search + 3)
        self.zones: dict[bool, list[Zone]] = {True: [], False: []}

    def outputs(self) -> list[str]:
        out = []
        for s in ("bull", "bear"):
            out += [f"ob_{s}_count", f"ob_{s}_nearest_atr"]
            out += [f"ob_{s}_{k}_{c}" for k in range(1, self.SHOWN + 1) for c in ("state", "age", "top", "bot", "mid", "width_atr", "in_zone", "penetration", "dist_top_atr", "dist_bot_atr", "strength", "bars_to_bos", "has_fvg")]
        return out

    def _made(self, bull: bool) -> Zone | None:
        bars = list(self.past)
        sign = 1 if bull else -1

        def displaced(b) -> bool:  # noqa: ANN001
            spread = max(b.high - b.low, 1e-9)
            place = (b.close - b.low) / spread
            return valid(b.atr) and (b.close - b.open) * sign > 0 and abs(b.close - b.open) >= 1.5 * b.atr and (place >= 0.75 if bull else place <= 0.25)

        last = len(bars) - 1
        at = next((j for j in range(last, max(-1, last - self.disp_search), -1) if displaced(bars[j])), None)
        if at is None:
            return None
        anchor = next((j for j in range(at - 1, max(-1, at - self.anchor_search), -1) if (bars[j].open - bars[j].close) * sign > 0), None)
        if anchor is None:
            return None
        a, b = bars[anchor], bars[at]
        top, bot = (max(a.open, a.close), a.low) if bull else (a.high, min(a.open, a.close))
        gap = at >= 2 and (b.low > bars[at - 2].high if bull else b.high < bars[at - 2].low)
        return Zone(top, bot, self.now, bull, abs(b.close - b.open) / b.atr, last - at, gap)

    def _score(self, z: Zone, bar, age: int) -> float:  # noqa: ANN001
        width = (z.top - z.bot) / bar.atr if valid(bar.atr) else 0.0
        base = sum(w * unit(x) for w, x in zip(BLOCK_WEIGHTS, ((z.strength - 1) / 2, 1 - z.wait / 12, width), strict=True))
        return base * (BLOCK_GAP if z.gap else 1.0) * (BLOCK_TESTED if z.tested else 1.0) * math.exp(-age / BLOCK_AGE)

    def step(self, bar) -> dict:  # noqa: ANN001
        self.now += 1
        self.past.append(bar)
        if bar.bos:
            z = self._made(bar.bos > 0)
            if z:
                self.zones[z.bull].append(z)
        out = dict.fromkeys(self.outputs(), NAN)
        for bull, s in ((True, "bull"), (False, "bear")):
            left = []
            for z in self.zones[bull]:
                z.tested = z.tested or z.depth(bar, bull) >= self.half
                beyond = bar.close < z.bot if bull else bar.close > z.top
                if not (z.tested and beyond) and self.now - z.born + 1 <= self.cap:
                    left.append(z)
            self.zones[bull] = left
            out[f"ob_{s}_count"] = float(len(left))
            far = lambda z: abs(bar.close - z.mid) / bar.atr if valid(bar.atr) else 0.0  # noqa: B023, E731
            if left and valid(bar.atr):
                out[f"ob_{s}_nearest_atr"] = min(map(far, left))
            best = sorted(left, key=lambda z: (-self._score(z, bar, self.now - z.born + 1), far(z)))  # noqa: B023
            for k, z in enumerate(best[: self.SHOWN], 1):
                shown = {"state": 2.0 if z.tested else 1.0, "age": min(self.now - z.born + 1, self.cap) / self.cap, "top": z.top, "bot": z.bot, "mid": z.mid, "width_atr": (z.top - z.bot) / bar.atr if valid(bar.atr) else NAN, "in_zone": float(z.overlaps(bar)), "penetration": z.depth(bar, bull), "dist_top_atr": (z.top - bar.close) / bar.atr if valid(bar.atr) else NAN, "dist_bot_atr": (bar.close - z.bot) / bar.atr if valid(bar.atr) else NAN, "strength": z.strength, "bars_to_bos": float(z.wait), "has_fvg": float(z.gap)}
                out.update({f"ob_{s}_{k}_{c}": v for c, v in shown.items()})
        return out
