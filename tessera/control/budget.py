"""Meters of tokens, dollars and execution time."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

VCPU_HOUR_DOLLARS = 0.05


@dataclass
class Budget:
    """Thread-safe meters of one task; its limits scale with the task's level."""

    dollars: float = 1.0
    tokens: int = 2_000_000
    level: int = 1
    rate: float = VCPU_HOUR_DOLLARS
    spent: float = 0.0
    used: int = 0
    executions: int = 0
    seconds: float = 0.0
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def record(self, tokens: int, dollars: float) -> None:
        with self._lock:
            self.used, self.spent = self.used + tokens, self.spent + dollars

    def record_execution(self, seconds: float, vcpus: float = 1.0) -> float:
        """Charge executed time; gives the charge."""
        cost = max(0.0, seconds) * vcpus * self.rate / 3600
        with self._lock:
            self.executions, self.seconds, self.spent = self.executions + 1, self.seconds + max(0.0, seconds), self.spent + cost
        return cost

    @property
    def remaining_dollars(self) -> float:
        return max(0.0, 1 - self.spent / (self.dollars * self.level))

    @property
    def remaining_tokens(self) -> float:
        return max(0.0, 1 - self.used / (self.tokens * self.level))

    @property
    def exhausted(self) -> bool:
        return self.remaining_dollars <= 0 or self.remaining_tokens <= 0


def task_level(value: object) -> int:
    """1, 2 or 3 from a level or an M-prefixed motif; anything else is 1."""
    text = str(value if value is not None else 0).lstrip("Mm")
    return int(text) if text in ("1", "2", "3") else 1
