"""Alarms of a capture that has fallen silent or runs out of disk, once an episode."""

from __future__ import annotations

from dataclasses import dataclass, field

from tidemill.functions.clock import SECOND


@dataclass
class Watchdog:
    """check() is called from a timer or a query listener with the time, each connection's last row, and the free bytes.

    A connection is silent if its last row (or the start, if it has sent none) is more than `stall` ago. An alarm is given when an
    episode begins and once more when it is over, however often check() is called in between.
    """

    connections: tuple[int, ...]
    started: int
    stall: int = 30 * SECOND
    least_free: int = 5 << 30
    _open: set = field(default_factory=set)

    def check(self, now: int, last_seen: dict[int, int], free: int) -> list[tuple[str, int | None, int]]:
        """(alarm, connection, since) for what has begun or ended since the last call."""
        state = {("silent", c): now - last_seen.get(c, self.started) > self.stall for c in self.connections}
        state["all_silent", None] = bool(self.connections) and all(state.values())
        state["disk", None] = free < self.least_free
        out = []
        for (name, c), bad in state.items():
            since = last_seen.get(c, self.started) if c is not None else max([last_seen.get(k, self.started) for k in self.connections], default=self.started) if name == "all_silent" else now
            if bad and (name, c) not in self._open:
                self._open.add((name, c))
                out.append((name, c, since))
            elif not bad and (name, c) in self._open:
                self._open.discard((name, c))
                out.append((f"{name}_over", c, now))
        return out
