"""A circuit breaker as a machine whose effect over a range of calls is a small map, whatever state it enters with."""

from __future__ import annotations

from dataclasses import dataclass

#: (kind, count, since): closed after count failures, open since the last failure (ms), or half open after count probes.
State = tuple[int, int, int]
CLOSED, OPEN, HALF_OPEN = range(3)
#: As an exit: it stays open since whenever it was.
STAYS = (OPEN, 0, -(1 << 62))


@dataclass(frozen=True)
class Breaker:
    """Opens at `threshold` failures in a row, lets a call through cooldown_ms after the last one, closes after `probes`
    successes and opens again at any failure before."""

    threshold: int
    cooldown_ms: int
    probes: int

    NAMES = ("CLOSED", "OPEN", "HALF_OPEN")
    START = (CLOSED, 0, 0)

    def step(self, state: State, ms: int, ok: bool) -> State:
        """The state after a call."""
        kind, count, since = state
        if kind == OPEN:
            if ms - since < self.cooldown_ms:
                return state if ok else (OPEN, 0, ms)
            kind, count = HALF_OPEN, 0
        if not ok:
            return (OPEN, 0, ms) if kind == HALF_OPEN or count + 1 >= self.threshold else (CLOSED, count + 1, 0)
        if kind == CLOSED or count + 1 >= self.probes:
            return (CLOSED, 0, 0)
        return (HALF_OPEN, count + 1, 0)

    def entries(self) -> list[State]:
        """The states that can be told without a time."""
        return [(CLOSED, n, 0) for n in range(self.threshold)] + [(HALF_OPEN, n, 0) for n in range(self.probes)]

    def map_of(self, ms: list[int], ok: list[bool]) -> tuple[list[int], list[State]]:
        """What calls do to any state: limits on `since`, ascending, and exits, of entries() first, then of a breaker that
        is open since at most limits[0], limits[1], ..., then of one open since later.

        Up to the first failure all calls succeed, so a breaker that enters open either has had its probes by then, and
        counts that failure as its first, or is open since that failure.
        """
        states = self.entries()
        first = ok.index(False) if False in ok else len(ok)
        late: list[State] = []
        for i, (t, o) in enumerate(zip(ms, ok, strict=True)):
            if i == first:
                late = [(CLOSED, 0, 0), (OPEN, 0, t - self.cooldown_ms)]  # the second probes at this very call, and fails
            moved: dict[State, State] = {}
            states = [moved[s] if s in moved else moved.setdefault(s, self.step(s, t, o)) for s in states]
            late = [moved[s] if s in moved else moved.setdefault(s, self.step(s, t, o)) for s in late]
        if late:
            limits = [ms[first - self.probes] - self.cooldown_ms] if first >= self.probes else []
            return limits, [*states, *(late if limits else late[1:])]
        limits, exits = [], []
        for k in range(min(self.probes, len(ms)), 0, -1):
            limits.append(ms[len(ms) - k] - self.cooldown_ms)
            exits.append((CLOSED, 0, 0) if k == self.probes else (HALF_OPEN, k, 0))
        return limits, [*states, *exits, STAYS]

    def through(self, state: State, limits: list[int], exits: list[State]) -> State:
        """The exit of a map of map_of() for a state."""
        known = self.entries()
        if state[0] != OPEN:
            return exits[known.index((state[0], state[1], 0))]
        k = next((i for i, limit in enumerate(limits) if state[2] <= limit), len(limits))
        out = exits[len(known) + k]
        return state if out == STAYS else out
