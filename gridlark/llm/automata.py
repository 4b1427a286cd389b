"""Probabilistic automata learned by state merging (ALERGIA): a prefix tree whose compatible states are merged."""

from __future__ import annotations

import math
from collections import Counter, deque

#: Symbols kept as they are at the start of a token, where credential formats carry fixed letters.
LITERAL = 4
#: Share of a step's probability that comes from its symbol's frequency in all tokens, whatever the state; and the
#: frequency given to symbols never seen.
BACK_OFF, UNSEEN = 0.05, 1e-4


#: Classes of the characters behind: digits, letters up to f and from g, small and capital; others are themselves.
_CLASSES = bytes(128 + (0 if chr(c).isdigit() else 1 if chr(c) in "abcdef" else 2 if chr(c).islower() else 3 if chr(c) in "ABCDEF" else 4 if chr(c).isupper() else c) if c < 128 else 255 for c in range(256))
#: The step for a symbol that a state has never seen.
OTHER = -1


def symbols(token: str) -> bytes:
    """The token's symbols: its first LITERAL characters themselves, then character classes."""
    raw = token.encode("ascii", "replace")
    return raw[:LITERAL] + raw[LITERAL:].translate(_CLASSES)


class Automaton:
    """Transitions and stop probabilities; a token's likelihood is the product along its only path."""

    def __init__(self, steps: list[dict[int, tuple[int, float]]], stop: list[float], base: dict[int, float]):
        self.steps, self.stop, self.base = steps, stop, base

    def log_likelihood(self, token: str) -> float:
        state, total, steps = 0, 0.0, self.steps
        for s in symbols(token):
            step = steps[state].get(s)
            if step is None:
                step = steps[state].get(OTHER)
                total += self.base.get(s, self.base[OTHER])
                if step is None:
                    continue
            state = step[0]
            total += step[1]
        return total + self.stop[state]


def learn(tokens: list[str], alpha: float = 0.05, least: int = 4) -> Automaton:
    """ALERGIA over `tokens`: red states are final, each blue one is merged into the first red state that the
    Hoeffding bound at `alpha` cannot tell from it, or else turns red. States seen under `least` times always merge
    (there is no evidence that they differ)."""
    kids: list[dict[int, int]] = [{}]
    through: list[dict[int, int]] = [{}]
    ends, seen = [0], [0]
    for token in tokens:
        at = 0
        seen[0] += 1
        for s in symbols(token):
            to = kids[at].get(s)
            if to is None:
                to = len(kids)
                kids[at][s] = to
                kids.append({})
                through.append({})
                ends.append(0)
                seen.append(0)
            through[at][s] = through[at].get(s, 0) + 1
            seen[to] += 1
            at = to
        ends[at] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(x: int, n: int, y: int, m: int) -> bool:
        return n >= least and m >= least and abs(x / n - y / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            if seen[p] < least or seen[q] < least:
                continue
            if differ(ends[p], seen[p], ends[q], seen[q]):
                return False
            for s in kids[p].keys() | kids[q].keys():
                if differ(through[p].get(s, 0), seen[p], through[q].get(s, 0), seen[q]):
                    return False
                if s in kids[p] and s in kids[q]:
                    todo.append((kids[p][s], kids[q][s]))
        return True

    def fold(a: int, b: int) -> None:
        """Adds the tree below b to the states reached from a."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            ends[p] += ends[q]
            seen[p] += seen[q]
            for s, n in through[q].items():
                through[p][s] = through[p].get(s, 0) + n
            for s, to in kids[q].items():
                if s in kids[p]:
                    todo.append((kids[p][s], to))
                else:
                    kids[p][s] = to

    red, done, blue, queued, known = [0], {0}, deque(), set(), Counter()

    def queue(states: list[int]) -> None:
        for r in states:
            for x in sorted(kids[r]):
                if (r, x) not in queued:
                    queued.add((r, x))
                    blue.append((r, x))

    queue(red)
    while blue:
        parent, s = blue.popleft()
        state = kids[parent].get(s)
        if state is None or state in done:
            continue
        into = next((r for r in red if compatible(r, state)), None)
        if into is None:
            red.append(state)
            done.add(state)
            queue([state])
        else:
            kids[parent][s] = into
            fold(into, state)
            queue([r for r in red if len(kids[r]) > known[r]])
            known.update((r, len(kids[r])) for r in red)
    number = {r: i for i, r in enumerate(red)}
    often = Counter(s for token in tokens for s in symbols(token))
    base = {s: BACK_OFF * max(n / often.total(), UNSEEN) for s, n in often.items()} | {OTHER: BACK_OFF * UNSEEN}
    steps, stop = [], []
    for r in red:
        total = seen[r] + 1.0
        row = {s: (number[to], math.log((1 - BACK_OFF) * max(through[r].get(s, 0), 1) / total + base[s])) for s, to in kids[r].items() if to in number}
        if row:
            most = max(row, key=lambda s: (row[s][1], s))
            row[OTHER] = (row[most][0], 0.0)
        steps.append(row)
        stop.append(math.log((ends[r] + 0.01) / total))
    return Automaton(steps, stop, {s: math.log(x) for s, x in base.items()})
