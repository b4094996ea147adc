"""Cheapest edits that make a sequence of turns a legal conversation: bidirectional Dijkstra over the edit lattice.

A node (i, q) stands for i turns done and the grammar of roles ``(s?(ua)+)?`` in state
q.  Edges keep, rerole or delete turn i, or insert a turn in front of it; each has
one letter, so a path spells its audit.  Which role an inserted or reroled turn gets
follows from the state.
"""

from __future__ import annotations

from heapq import heappop, heappush

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: State after a role's initial, by state.
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: States in which a conversation may end.
ENDS = (EMPTY, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}


def given(state: int) -> str:
    """Initial of the one role that a turn inserted or reroled in this state can get."""
    return "a" if state == USER else "u"


def _onward(i: int, state: int, initials: str, faults: list[int]):
    """Edges out of a node: (letter, cost, i, state)."""
    if i < len(initials):
        if faults[i] not in (BLANK, DUPLICATE):
            extra = 1 if faults[i] == TRUNCATED else 0
            kept = AFTER[state].get(initials[i])
            if kept is not None:
                yield "K", KEEP + extra, i + 1, kept
            yield "R", REROLE + extra, i + 1, AFTER[state][given(state)]
        yield "D", DELETE, i + 1, state
    yield "I", INSERT, i, AFTER[state][given(state)]


_BEFORE = {state: [q for q in range(STATES) if AFTER[q][given(q)] == state] for state in range(STATES)}


def _backward(i: int, state: int, initials: str, faults: list[int]):
    """Edges into a node: (letter, cost, i, state)."""
    if i:
        if faults[i - 1] not in (BLANK, DUPLICATE):
            extra = 1 if faults[i - 1] == TRUNCATED else 0
            for q in range(STATES):
                if AFTER[q].get(initials[i - 1]) == state:
                    yield "K", KEEP + extra, i - 1, q
            for q in _BEFORE[state]:
                yield "R", REROLE + extra, i - 1, q
        yield "D", DELETE, i - 1, state
    for q in _BEFORE[state]:
        yield "I", INSERT, i, q


class _Side:
    """One of the two searches.

    Keys are (cost, turns done in its direction, state): edges that cost nothing
    do a turn, so a node is settled after all nodes before it on a cheapest
    path, and its least audit is final then.
    """

    def __init__(self, nodes: list[tuple[int, int]], ahead: bool, turns: int):
        self.ahead, self.turns = ahead, turns
        self.heap: list[tuple] = []
        self.found: dict[tuple[int, int], tuple[int, str]] = {}
        self.settled: set[tuple[int, int]] = set()
        for node in nodes:
            self._offer(node, 0, "")

    def _offer(self, node: tuple[int, int], cost: int, audit: str) -> None:
        known = self.found.get(node)
        if known is None or (cost, audit) < known:
            self.found[node] = cost, audit
            if known is None or cost < known[0]:
                heappush(self.heap, (cost, node[0] if self.ahead else self.turns - node[0], node[1]))

    def top(self) -> int | None:
        while self.heap:
            cost, done, state = self.heap[0]
            if (done if self.ahead else self.turns - done, state) not in self.settled:
                return cost
            heappop(self.heap)
        return None

    def step(self, initials: str, faults: list[int]) -> tuple[int, int]:
        """Settle the nearest node; call after :meth:`top`."""
        _, done, state = heappop(self.heap)
        node = done if self.ahead else self.turns - done, state
        self.settled.add(node)
        cost, audit = self.found[node]
        for letter, more, i, q in (_onward if self.ahead else _backward)(*node, initials, faults):
            self._offer((i, q), cost + more, audit + letter if self.ahead else letter + audit)
        return node


def cheapest(initials: str, faults: list[int], start: int = EMPTY, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Cost and ASCII-least audit of the cheapest edits from a state to one of the end states.

    The two searches go on until no path across can be as cheap as the best
    one, so all crossings of equal cost are there.  Among paths to one node
    of equal cost no audit begins another, as more letters would be more
    inserts; so least audits put together are least.
    """
    turns = len(initials)
    fore, back = _Side([(0, start)], True, turns), _Side([(turns, q) for q in ends], False, turns)
    best = None
    while True:
        a, b = fore.top(), back.top()
        if a is None or b is None or (best is not None and a + b > best):
            break
        side, other = (fore, back) if a <= b else (back, fore)
        node = side.step(initials, faults)
        if node in other.found:
            total = side.found[node][0] + other.found[node][0]
            best = total if best is None else min(best, total)
    crossings = []
    for node in fore.settled:
        cost, audit = fore.found[node]
        if node in back.settled or node[0] == turns and node[1] in ends:
            crossings.append((cost + back.found[node][0], audit + back.found[node][1]))
        for letter, more, i, q in _onward(*node, initials, faults):
            if (i, q) in back.settled:
                rest = back.found[i, q]
                crossings.append((cost + more + rest[0], audit + letter + rest[1]))
    return min(crossings, default=None)
