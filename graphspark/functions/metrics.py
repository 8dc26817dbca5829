"""Performance figures of a run."""

from __future__ import annotations

import time
from collections import defaultdict
from contextlib import contextmanager
from dataclasses import dataclass, field


def mteps(edges: int, seconds: float, iterations: int = 1) -> float:
    """Million traversed edges a second; algorithms of a fixed number of iterations traverse all of them in each."""
    return edges * iterations / (seconds * 1e6)


@dataclass
class PerformanceStats:
    """Seconds and edges of rounds, and seconds by kind of work; scatter and gather have their own."""

    rounds: list[tuple[int, float]] = field(default_factory=list)
    shares: dict[str, float] = field(default_factory=lambda: defaultdict(float))

    @contextmanager
    def round(self, edges: int, iterations: int = 1):
        began = time.perf_counter()
        yield
        self.rounds.append((edges * iterations, time.perf_counter() - began))

    @contextmanager
    def timed(self, kind: str):
        began = time.perf_counter()
        yield
        self.shares[kind] += time.perf_counter() - began

    def report(self, bytes_per_edge: int = 8) -> dict[str, float]:
        rates = [mteps(e, s) for e, s in self.rounds] or [0.0]
        total = sum(self.shares.values()) or 1.0
        return {
            "min_mteps": min(rates), "avg_mteps": sum(rates) / len(rates), "max_mteps": max(rates), "bandwidth_gb_s": sum(rates) / len(rates) * bytes_per_edge / 1e3,
        } | {f"{k}_percent": 100 * s / total for k, s in self.shares.items()}
