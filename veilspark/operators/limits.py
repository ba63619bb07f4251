"""A token bucket for each principal."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from threading import Lock

from ..errors import Cause, PolicyRejection


#: Principals remembered before those with full buckets are forgotten.
MOST_PRINCIPALS = 10_000


@dataclass
class RateLimiter:
    """``per_minute`` statements, ``burst`` at once; off where ``per_minute`` is 0."""

    per_minute: int
    burst: int
    clock: Callable[[], float] = time.monotonic
    left: dict[str, tuple[float, float]] = field(default_factory=dict)
    lock: Lock = field(default_factory=Lock)

    def take(self, principal: str) -> None:
        if not self.per_minute:
            return
        with self.lock:
            now = self.clock()
            if len(self.left) > MOST_PRINCIPALS:  # whoever has a full bucket again is as good as new
                whole = 60 * self.burst / self.per_minute
                self.left = {p: (n, t) for p, (n, t) in self.left.items() if now - t < whole}
            tokens, then = self.left.get(principal, (float(self.burst), now))
            tokens = min(float(self.burst), tokens + (now - then) * self.per_minute / 60)
            if tokens < 1:
                self.left[principal] = (tokens, now)
                raise PolicyRejection(Cause.RATE_LIMITED, "too many statements; try again later")
            self.left[principal] = (tokens - 1, now)
