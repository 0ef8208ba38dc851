"""Regular expressions over bytes as minimal deterministic automata in transition arrays.

Syntax: literals, ``\\``-escapes, ``[...]`` classes with ranges, groups, ``|``, ``? + *`` and ``{n}``.
"""

from __future__ import annotations

import numpy as np

DEAD, DIGITS = 0, frozenset(b"0123456789")


class Builder:
    """An automaton with empty moves, built from patterns by recursive descent."""

    def __init__(self, fold: bool = False):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.fold = fold

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        self.text, self.at = pattern.encode("ascii"), 0
        part = self.union()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at:]!r} in {pattern!r}")
        return part

    def peek(self) -> int:
        return self.text[self.at] if self.at < len(self.text) else -1

    def take(self) -> int:
        self.at += 1
        return self.text[self.at - 1]

    def union(self) -> tuple[int, int]:
        first, last = self.state(), self.state()
        while True:
            a, b = self.sequence()
            self.empty[first].append(a)
            self.empty[b].append(last)
            if self.peek() != ord("|"):
                return first, last
            self.take()

    def sequence(self) -> tuple[int, int]:
        first = last = self.state()
        while self.peek() not in (-1, ord("|"), ord(")")):
            a, b = self.repeated()
            self.empty[last].append(a)
            last = b
        return first, last

    def repeated(self) -> tuple[int, int]:
        begin = self.at
        a, b = self.atom()
        after = self.peek()
        if after == ord("{"):
            until = self.text.index(b"}", self.at)
            times, atom = int(self.text[self.at + 1:until]), (begin, self.at)
            first = last = self.state()
            for _ in range(times):
                self.at = atom[0]
                a, b = self.atom()
                self.empty[last].append(a)
                last = b
            self.at = until + 1
            return first, last
        if after != -1 and after in b"?*+":
            self.take()
            first, last = self.state(), self.state()
            self.empty[first].append(a)
            self.empty[b].append(last)
            if after != ord("+"):
                self.empty[first].append(last)
            if after != ord("?"):
                self.empty[b].append(a)
            return first, last
        return a, b

    def atom(self) -> tuple[int, int]:
        c = self.take()
        if c == ord("("):
            part = self.union()
            self.take()
            return part
        if c == ord("["):
            accepted: set[int] = set()
            while self.peek() != ord("]"):
                low = self.take()
                low = self.take() if low == ord("\\") else low
                if self.peek() == ord("-") and self.text[self.at + 1] != ord("]"):
                    self.take()
                    accepted |= set(range(low, self.take() + 1))
                else:
                    accepted.add(low)
            self.take()
        else:
            accepted = {self.take() if c == ord("\\") else c}
        if self.fold:
            accepted |= {x for y in list(accepted) for x in bytes([y]).lower() + bytes([y]).upper()}
        first, last = self.state(), self.state()
        self.moves[first].append((frozenset(accepted), last))
        return first, last

    def closure(self, states) -> frozenset[int]:
        found, left = set(states), list(states)
        while left:
            for x in self.empty[left.pop()]:
                if x not in found:
                    found.add(x)
                    left.append(x)
        return frozenset(found)


def determinise(nfa: Builder, start: int, accepting: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction: (next state by state and byte, what the state accepts); state 0 is dead, 1 the start.

    ``accepting`` has a bit for each accepting state's pattern; a state of the result has the bits of all it accepts.
    """
    classes: dict[tuple, int] = {}
    kinds = list({accepted for moves in nfa.moves for accepted, _ in moves})
    of_byte = np.array([classes.setdefault(tuple(b in k for k in kinds), len(classes)) for b in range(256)])
    sample = [int(np.flatnonzero(of_byte == c)[0]) for c in range(len(classes))]
    names: dict[frozenset[int], int] = {frozenset(): 0}
    first = nfa.closure([start])
    names[first] = 1
    left, rows, final = [first], {0: [0] * len(sample)}, {0: 0}
    while left:
        subset = left.pop()
        me = names[subset]
        final[me] = 0
        for s in subset:
            final[me] |= accepting.get(s, 0)
        row = []
        for byte in sample:
            target = nfa.closure({to for s in subset for accepted, to in nfa.moves[s] if byte in accepted})
            if target not in names:
                names[target] = len(names)
                left.append(target)
            row.append(names[target])
        rows[me] = row
    n = len(names)
    return np.array([rows[k] for k in range(n)])[:, of_byte], np.array([final[k] for k in range(n)])


def minimise(moves: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Merge states that no input tells apart: (moves, final, start)."""
    columns = np.unique(moves, axis=1)
    label, n = np.unique(final, return_inverse=True)[1], 0
    while label.max() + 1 != n:
        n = label.max() + 1
        label = np.unique(np.column_stack([label, label[columns]]), axis=0, return_inverse=True)[1].ravel()
    keep = np.unique(label, return_index=True)[1]
    return label[moves[keep]], final[keep], int(label[1])


def linked_rows(moves: np.ndarray, final: np.ndarray, start: int) -> list:
    """Transition arrays whose entries are the next state's array itself, and whose last entry is what the state accepts."""
    rows: list[list] = [[] for _ in moves]
    for row, targets, bits in zip(rows, moves.tolist(), final.tolist(), strict=True):
        row.extend(rows[t] for t in targets)
        row.append(bits)
    return rows[start]


class Anchored:
    """Longest match of one pattern from a given place."""

    def __init__(self, pattern: str, fold: bool):
        nfa = Builder(fold)
        first, last = nfa.add(pattern)
        moves, final, start = minimise(*determinise(nfa, first, {last: 1}))
        self.moves, self.final, self.start = moves.tolist(), final.tolist(), start
        dead = [k for k, row in enumerate(self.moves) if not self.final[k] and set(row) == {k}]
        self.dead = dead[0] if dead else -1
        self.first_bytes = bytes(b for b in range(256) if self.moves[start][b] != self.dead)

    def ends(self, data: bytes, at: int) -> list[int]:
        """Every place where a match that starts at ``at`` may end."""
        state, found = self.start, []
        for k in range(at, len(data)):
            state = self.moves[state][data[k]]
            if state == self.dead:
                break
            if self.final[state]:
                found.append(k + 1)
        return found


#: Patterns of one combined automaton: a bit of a 64-bit number for each.
MOST_PATTERNS = 62


def combined_scan(patterns: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray, int]:
    """One automaton for all (pattern, fold letter case), for reading a text from its end to its start.

    After the byte at a place it accepts, as bits, just the patterns that match from that place on.
    So one pass gives all starts, and no start has to be tried in vain.
    """
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"{len(patterns)} patterns; {MOST_PATTERNS} fit one automaton")
    nfa = Builder()
    parts = []
    for pattern, fold in patterns:
        nfa.fold = fold
        parts.append(nfa.add(pattern))
    back = Builder()
    for _ in nfa.empty:
        back.state()
    for state, (empty, moves) in enumerate(zip(nfa.empty, nfa.moves, strict=True)):
        for to in empty:
            back.empty[to].append(state)
        for accepted, to in moves:
            back.moves[to].append((accepted, state))
    root = back.state()
    back.moves[root].append((frozenset(range(256)), root))
    back.empty[root] += [last for _, last in parts]
    return minimise(*determinise(back, root, {first: 1 << k for k, (first, _) in enumerate(parts)}))
