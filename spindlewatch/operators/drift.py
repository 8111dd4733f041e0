"""Drift detection over ordered streams, one fold per key.

A detector restarts after every detection, so its state depends on all rows before: rows are sorted inside the partition of their key
and folded batch by batch. Memory holds one Arrow batch and one detector, however long a stream is. A single global stream should be
aggregated to days first.
"""
from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewatch.functions.ordered import running
from spindlewatch.session import cut_lineage


class Detector:
    """``update(x)`` returns (estimation, warning, change). Subclasses hold their state in plain attributes (it is pickled)."""

    DEFAULTS: dict = {}

    def __init__(self, **params):
        unknown = set(params) - set(self.DEFAULTS)
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        for name, value in {**self.DEFAULTS, **params}.items():
            setattr(self, name, value)
        self.changed = False
        self.restart()

    def restart(self):
        self.n, self.mean = 0, 0.0

    def update(self, x: float) -> tuple[float, bool, bool]:
        if self.changed:
            self.restart()
        est, warning, self.changed = self.step(x)
        return est, warning, self.changed

    def see(self, x):
        self.n += 1
        self.mean += (x - self.mean) / self.n


class DDM(Detector):
    # Defaults of every detector below.
    DEFAULTS = {"min_n": 30, "warning": 2.0, "drift": 3.0}

    def restart(self):
        super().restart()
        self.best_p = self.best_s = math.inf

    def step(self, x):
        self.see(x)
        p, s = self.mean, math.sqrt(max(0.0, self.mean * (1 - self.mean)) / self.n)
        if self.n + 1 < self.min_n:
            return p, False, False
        if p + s <= self.best_p + self.best_s:
            self.best_p, self.best_s = p, s
        change = self.n + 1 > self.min_n and p + s > self.best_p + self.drift * self.best_s
        return p, not change and p + s > self.best_p + self.warning * self.best_s, change


class EDDM(Detector):
    DEFAULTS = {"min_n": 30, "min_errors": 30, "warning": 0.95, "drift": 0.90}

    def restart(self):
        super().restart()
        self.rows, self.last, self.spread, self.peak = 0, 0, 0.0, 0.0
        self.warn = getattr(self, "warn", False)

    def step(self, x):
        self.rows += 1
        change = False
        if x == 1.0:
            gap, before = self.rows - self.last, self.mean
            self.last = self.rows
            self.see(gap)
            self.spread += (gap - self.mean) * (gap - before)
            level = self.mean + 2 * math.sqrt(self.spread / self.n)
            self.warn = False
            if level > self.peak:
                if self.rows + 1 > self.min_n:
                    self.peak = level
            elif self.rows + 1 > self.min_n and self.n > self.min_errors and self.peak > 0:
                change = level / self.peak < self.drift
                self.warn = not change and level / self.peak < self.warning
        return self.mean, self.warn, change


class PageHinkley(Detector):
    DEFAULTS = {"min_n": 30, "delta": 0.005, "threshold": 50.0, "alpha": 1 - 0.0001}

    def restart(self):
        super().restart()
        self.total = 0.0

    def accumulate(self, x):
        return self.alpha * self.total + (x - self.mean - self.delta)

    def step(self, x):
        self.see(x)
        self.total = self.accumulate(x)
        return self.mean, False, self.n + 1 >= self.min_n and self.total > self.threshold


class Cusum(PageHinkley):
    DEFAULTS = {"min_n": 30, "delta": 0.005, "threshold": 50.0}

    def accumulate(self, x):
        return max(0.0, self.total + x - self.mean - self.delta)


class GeometricMovingAverage(PageHinkley):
    DEFAULTS = {"min_n": 30, "threshold": 1.0, "alpha": 0.99}

    def accumulate(self, x):
        return self.alpha * self.total + (1.0 - self.alpha) * (x - self.mean)


class EwmaChart(Detector):
    DEFAULTS = {"min_n": 30, "lam": 0.2}

    def restart(self):
        super().restart()
        self.total = self.z = 0.0

    def step(self, x):
        self.n += 1
        self.total += x
        p, lam = self.total / self.n, self.lam
        self.z += lam * (x - self.z)
        s = math.sqrt(max(0.0, p * (1 - p) * lam * (1 - (1 - lam) ** (2 * self.n)) / (2 - lam)))
        # Control limit polynomial for one false alarm in a hundred
        limit = (3.97 - 6.56 * p + 48.73 * p**3 - 330.13 * p**5 + 848.18 * p**7) * s
        if self.n + 1 < self.min_n:
            return p, False, False
        change = self.n + 1 > self.min_n and self.z > p + limit
        return p, not change and self.z > p + 0.5 * limit, change


class Stepd(Detector):
    DEFAULTS = {"window": 30, "drift": 0.003, "warning": 0.05}

    def restart(self):
        super().restart()
        self.recent, self.old_n, self.old_errors = deque(), 0, 0.0

    def step(self, x):
        self.recent.append(x)
        if len(self.recent) > self.window:
            self.old_errors += self.recent.popleft()
            self.old_n += 1
        new_n, new_errors = len(self.recent), sum(self.recent)
        est = (self.old_errors + new_errors) / (self.old_n + new_n)
        if self.old_n < self.window:
            return est, False, False
        inv, p = 1 / self.old_n + 1 / new_n, 1 - est
        if p in (0.0, 1.0):
            return est, False, False
        stat = (abs(self.old_errors / self.old_n - new_errors / new_n) - inv / 2) / math.sqrt(p * (1 - p) * inv)
        tail = math.erfc(abs(stat) / math.sqrt(2))
        return est, self.drift <= tail < self.warning, tail < self.drift


class HddmA(Detector):
    DEFAULTS = {"drift": 0.001, "warning": 0.005, "two_sided": True}

    def restart(self):
        self.n, self.c, self.low, self.high = 0, 0.0, None, None

    @staticmethod
    def _apart(cut, n, conf):
        return math.sqrt((n - cut) / (2 * cut * n) * math.log(2 / conf))

    def step(self, x):
        self.n, self.c = self.n + 1, self.c + x
        n, mean = self.n, self.c / self.n
        width = lambda k: math.sqrt(math.log(1 / self.drift) / (2 * k))
        self.low, self.high = self.low or (n, self.c), self.high or (n, self.c)
        if self.low[1] / self.low[0] + width(self.low[0]) >= mean + width(n):
            self.low = (n, self.c)
        if self.high[1] / self.high[0] - width(self.high[0]) <= mean - width(n):
            self.high = (n, self.c)
        rise = mean - self.low[1] / self.low[0]
        grown = lambda conf: self.low[0] < n and rise >= self._apart(self.low[0], n, conf)
        change = grown(self.drift)
        warning = not change and grown(self.warning)
        k, c = self.high
        if not change and self.two_sided and k < n and c / k - mean >= self._apart(k, n, self.drift):
            self.restart()  # a falling mean starts over without an alarm
        return mean, warning, change


class HddmW(Detector):
    DEFAULTS = {"drift": 0.001, "warning": 0.005, "lam": 0.05, "two_sided": False}

    def restart(self):
        self.total = None
        self.up, self.down = [None, None, math.inf], [None, None, -math.inf]

    def _blend(self, state, x):
        if state is None:
            return (x, 1.0)
        lam = self.lam
        return (lam * x + (1 - lam) * state[0], lam**2 + (1 - lam) ** 2 * state[1])

    def _track(self, side, x, sign):
        edge = self.total[0] + sign * math.sqrt(self.total[1] * math.log(1 / self.drift) / 2)
        if sign * edge < sign * side[2]:
            side[0], side[1], side[2] = self.total, None, edge
        else:
            side[1] = self._blend(side[1], x)

    @staticmethod
    def _above(low, high, conf):
        return low is not None and high is not None and high[0] - low[0] > math.sqrt((low[1] + high[1]) * math.log(1 / conf) / 2)

    def step(self, x):
        self.total = self._blend(self.total, x)
        self._track(self.up, x, 1.0)
        self._track(self.down, x, -1.0)
        est, change = self.total[0], self._above(self.up[0], self.up[1], self.drift)
        warning = not change and self._above(self.up[0], self.up[1], self.warning)
        if not change and self.two_sided and self._above(self.down[1], self.down[0], self.drift):
            self.restart()
        return est, warning, change


class RDDM(Detector):
    DEFAULTS = {"min_n": 129, "warning": 1.773, "drift": 2.258, "max_concept": 40000, "min_stable": 7000, "warn_limit": 1400}

    def __init__(self, **params):
        self.stored, self.since_warning, self.rebuild, self.forget = deque(), None, False, False
        super().__init__(**params)

    def restart(self):
        super().restart()
        self.best_p = self.best_s = math.inf

    def _level(self):
        return self.mean, math.sqrt(max(0.0, self.mean * (1 - self.mean)) / self.n)

    def update(self, x):
        if self.rebuild:
            # start again from the stored predictions: since the warning after a drift, else the stable tail
            if self.since_warning is not None:
                while len(self.stored) > self.since_warning:
                    self.stored.popleft()
            best = (math.inf, math.inf) if self.forget else (self.best_p, self.best_s)
            self.restart()
            self.best_p, self.best_s = best
            for v in self.stored:
                self.see(v)
                p, s = self._level()
                if self.forget and self.n > self.min_n and p + s < self.best_p + self.best_s:
                    self.best_p, self.best_s = p, s
            self.since_warning, self.rebuild, self.forget = None, False, False
        est, warning, self.changed = self.step(x)
        return est, warning, self.changed

    def step(self, x):
        self.stored.append(x)
        if len(self.stored) > self.min_stable:
            self.stored.popleft()
        if self.since_warning is not None:
            self.since_warning += 1
        self.see(x)
        p, s = self._level()
        if self.n < self.min_n:
            return p, False, False
        if p + s < self.best_p + self.best_s:
            self.best_p, self.best_s = p, s
        if p + s > self.best_p + self.drift * self.best_s:
            if self.since_warning is None:
                self.stored = deque([x])
            self.rebuild = self.forget = True
            return p, False, True
        warning = p + s > self.best_p + self.warning * self.best_s
        if not warning:
            self.since_warning = None
            self.rebuild = self.n + 1 > self.max_concept
        elif self.since_warning is None:
            self.since_warning = 1
        elif self.since_warning > self.warn_limit:
            self.stored, self.since_warning = deque([x]), None
            self.rebuild = self.forget = True
            return p, False, True
        return p, warning, False


class Adwin(Detector):
    """Adaptive window over an exponential histogram: at most five buckets per size, cuts checked every 32 values."""

    DEFAULTS = {"delta": 0.002, "every": 32, "buckets": 5, "min_window": 10, "min_part": 5}

    def restart(self):
        if not hasattr(self, "levels"):
            self.levels, self.t, self.width, self.total, self.var = [[]], 0, 0, 0.0, 0.0

    def _add(self, x):
        if self.width:
            self.var += self.width * (x - self.total / self.width) ** 2 / (self.width + 1)
        self.width, self.total = self.width + 1, self.total + x
        self.levels[0].append((x, 0.0))
        for i, level in enumerate(self.levels):
            if len(level) <= self.buckets:
                break
            (s1, v1), (s2, v2) = level[0], level[1]
            del level[:2]
            size = 2**i
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append((s1 + s2, v1 + v2 + (s1 - s2) ** 2 / (2 * size)))

    def _drop_oldest(self):
        s, v = self.levels[-1].pop(0)
        size = 2 ** (len(self.levels) - 1)
        self.width, self.total = self.width - size, self.total - s
        if self.width:
            self.var -= v + size * self.width * (s / size - self.total / self.width) ** 2 / (size + self.width)
        while len(self.levels) > 1 and not self.levels[-1]:
            self.levels.pop()

    def _cut(self):
        n0, s0 = 0, 0.0
        spread = math.log(2 * math.log(self.width) / self.delta)
        for i in range(len(self.levels) - 1, -1, -1):
            for s, _ in self.levels[i]:
                n0, s0 = n0 + 2**i, s0 + s
                n1 = self.width - n0
                if n0 <= self.min_part + 1 or n1 <= self.min_part + 1:
                    continue
                m = 1 / (n0 - self.min_part + 1) + 1 / (n1 - self.min_part + 1)
                eps = math.sqrt(2 * m * max(self.var, 0.0) / self.width * spread) + 2 / 3 * spread * m
                if abs(s0 / n0 - (self.total - s0) / n1) > eps:
                    return True
        return False

    def step(self, x):
        before = self.total / self.width if self.width else 0.0
        self.t += 1
        self._add(x)
        cut = False
        while self.t % self.every == 0 and self.width > self.min_window and self._cut():
            self._drop_oldest()
            cut = True
        est = self.total / self.width
        return est, False, cut and est > before


class Ensemble(Detector):
    """Several detectors on one stream; ``vote`` asks for all, any or most of them since the last combined detection."""

    DEFAULTS = {"methods": ("ddm", "eddm", "cusum"), "vote": "majority"}

    def restart(self):
        if not hasattr(self, "members"):
            self.members = [METHODS[m]() for m in self.methods]
        self.hit = [False] * len(self.members)

    def step(self, x):
        results = [m.update(x) for m in self.members]
        self.hit = [h or r[2] for h, r in zip(self.hit, results)]
        k = sum(self.hit)
        change = {"all": k == len(self.hit), "any": k > 0, "majority": k > len(self.hit) / 2}[self.vote]
        return results[0][0], any(r[1] for r in results), change


METHODS = {
    "ddm": DDM, "eddm": EDDM, "page_hinkley": PageHinkley, "cusum": Cusum, "gma": GeometricMovingAverage, "ewma": EwmaChart,
    "stepd": Stepd, "hddm_a": HddmA, "hddm_w": HddmW, "rddm": RDDM, "adwin": Adwin, "ensemble": Ensemble,
}


def detect_drift(df: DataFrame, keys: list[str], order: str, value: str, method: str = "ddm", **params) -> DataFrame:
    """Adds ``estimation``, ``warning`` and ``change`` per row of every key's stream."""
    make = METHODS[method]
    base = df.select(*keys, order, F.col(value).cast("double").alias(value))
    ordered = base.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, detector = None, None
        for batch in batches:
            out = []
            for row in zip(*[batch[k] for k in keys], batch[value]):
                if row[:-1] != current:
                    current, detector = row[:-1], make(**params)
                out.append(detector.update(row[-1]))
            flags = pd.DataFrame(out, columns=["estimation", "warning", "change"], index=batch.index)
            yield pd.concat([batch, flags], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    return ordered.mapInPandas(fold, f"{schema}, estimation double, warning boolean, change boolean")


def segments(detected: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Numbers the stretches between detections: a model per stretch is the drift-triggered retrain."""
    stored = cut_lineage(detected)  # the fold is read several times below
    return running(stored, order, {"segment": F.col("change").cast("bigint")}, within=list(keys), exclusive=True)
