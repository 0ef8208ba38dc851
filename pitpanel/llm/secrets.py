"""Secret scans by one combined deterministic automaton.

All rules are compiled by subset construction and minimisation into one transition array. Every text
is read once, a byte at a time from its end, for all rules together: states carry the rules that match from the
place reached, so the pass gives every start of every rule. From a start, the rule's own minimal automaton
finds where the longest match ends; it is run only where there is one, and next behind it, so that the work
grows with the text whatever it holds. Spans are leftmost and longest, not overlapping within a kind.

A rule is a head and a run of body characters after it, with a least length of the run. Runs
that are too short are dropped and not tried again from a later place.

Defined results: a null text counts as empty (no spans); spans are in code points with the end
left out; equal starts are ordered by rule; repeated rows and null ids stay, a row each;
columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from pitpanel.llm.automaton import Anchored, combined_scan, linked_rows
from pitpanel.llm.common import map_rows


@dataclass(frozen=True)
class Rule:
    kind: str
    head: str
    body: str
    least: int
    fold: bool = False


#: Formats of credentials (fixed values).
BASE_RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?", "[A-Za-z0-9+/_.=\\-]", 6, fold=True),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
)
MORE_RULES = (
    Rule("forge", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9\\-]", 10),
    Rule("cloud", "AIza", "[A-Za-z0-9_\\-]", 35),
    Rule("jwt", "eyJ[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.", "[A-Za-z0-9_\\-]", 10),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY", "\\-", 5),
)


def scanned(rule: Rule) -> str:
    """What the combined automaton looks for. Counters of several rules would multiply its states,
    so a run after a head is found by its first character and its length is checked with the spans."""
    return f"{rule.head}{rule.body}" + ("" if rule.head else f"{{{rule.least}}}")


class Scanner:
    """Built in the task from transition arrays made once on the driver."""

    def __init__(self, scan: tuple[np.ndarray, np.ndarray, int], rules: tuple[Rule, ...]):
        self.start = linked_rows(*scan)
        self.rules = [(r, Anchored(f"{r.head}{r.body}+", r.fold), Anchored(r.head, r.fold) if r.head else None,
                       frozenset(Anchored(r.body, r.fold).first_bytes)) for r in rules]

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(place counted from the end, bits of the rules that match from there on), last place first."""
        row, found = self.start, []
        for behind, byte in enumerate(reversed(data), 1):
            row = row[byte]
            if row[256]:
                found.append((behind, row[256]))
        return found

    def holds(self, data: bytes) -> bool:
        return bool(self.starts(data))

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes."""
        found, free = [], [0] * len(self.rules)
        for behind, bits in reversed(self.starts(data)):
            at = len(data) - behind
            while bits:
                number = (bits & -bits).bit_length() - 1
                bits &= bits - 1
                if at < free[number]:
                    continue
                rule, whole, head, body = self.rules[number]
                free[number] = end = whole.ends(data, at)[-1]
                run = end  # where the unbroken body characters before the end begin
                while run > at and data[run - 1] in body:
                    run -= 1
                begin = at if head is None else min((b for b in head.ends(data, at) if run <= b < end), default=end)
                if end - begin >= rule.least:
                    found.append((at, number, end))
        return sorted(found)


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte places to code point places."""
    if not spans or data.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), number, int(before[b])) for a, number, b in spans]


def find_secrets(docs: DataFrame, *, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, n_base: int = len(BASE_RULES),
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a count ``n_<kind>`` for each of the first ``n_base`` rules, base_sha256, spans)."""
    scan = combined_scan([(scanned(r), r.fold) for r in rules])
    kinds = [r.kind for r in rules]
    id_kind = docs.schema[id_col].dataType.simpleString()

    def start():
        scanner = Scanner(scan, rules)

        def line(spans):
            return ",".join(f"{kinds[number]}:{a}:{b}" for a, number, b in spans)

        def step(columns):
            ids, texts = columns
            counts, hashes, all_spans = [[] for _ in range(n_base)], [], []
            for text in texts:
                data = (text or "").encode("utf-8")
                spans = code_points(data, scanner.spans(data))
                base = [s for s in spans if s[1] < n_base]
                for k, values in enumerate(counts):
                    values.append(sum(s[1] == k for s in base))
                hashes.append(hashlib.sha256(line(base).encode()).hexdigest())
                all_spans.append(line(spans))
            return [ids, *counts, hashes, all_spans]

        return step

    columns = ", ".join(f"n_{kind} bigint" for kind in kinds[:n_base])
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {id_kind}, {columns}, base_sha256 string, spans string", start)
