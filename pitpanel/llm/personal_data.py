"""Personal data by a skip-chain conditional random field.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. The field then works
on all *mentions* of a text: base matches and anything else that has an ``@``, a written-out
``at`` or at least seven digits. Its parts:

* node potentials: a linear model of a mention's shape (lengths, separators, check digit) and the
  word before it. Plus sign and dotted domain, by which the base patterns decide, are left out,
  so that the model learns what such mentions look like in general. Base matches are clamped;
* chain potentials between neighbouring mentions (label pairs counted in the sample);
* skip potentials, which favour equal labels, between distant mentions with the same text after
  normalising, the same last digits or the same name before the ``@``. A group of equal
  mentions shares a variable, with an edge to each, so edges grow with the text, not its square;
  it is clamped to the commonest label of the group's base matches, if it has any.

Loopy sum-product message passing, until messages stay, gives each mention's label probabilities; a mention that
overlaps no base match is added if a kind has at least ``threshold``. So a number that stands
once with and once without its plus sign is found both times.

Node and chain potentials are fitted on at most ``max_sample`` texts with base matches as labels
(lowest content hash first, at most ``max_sample_chars`` characters each); only mention features
come to the driver.

Defined results: a null text counts as empty; spans are in code points, the end left out;
repeated rows and null ids stay, a row each; columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match never starts inside a run of digits that failed, so runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NUMBER = re.compile(r"[+(]?[0-9]++(?:[\x20().-]{1,2}[0-9]++)*+")
WRITTEN_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9.-]++", re.I)
WRITTEN_END = re.compile(r"at[\])]", re.I)
TOKEN_END = re.compile(r"\S*")
#: Words that tell what follows (fixed values).
CUES = (frozenset("mail email e-mail contact write".split()), frozenset("ip host server address node".split()),
        frozenset("card visa mastercard credit debit iban account".split()),
        frozenset("phone tel telephone call mobile fax cell".split()))
LENGTHS = (7, 8, 9, 10, 11, 12, 13, 16, 17, 20)
FEATURES = 13 + len(LENGTHS)
#: Messages that change by less have settled.
SETTLED = 1e-4


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str):
    """Matches of the e-mail pattern, found from each ``@`` outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), ordered."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255
                                                                         for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    label: int  # 0: none, else kind number + 1
    base: bool


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[Mention]:
    """Base matches and looser finds that overlap none of them, in text order."""
    out, taken = [Mention(a, b, kind + 1, True) for a, kind, b in base], [(a, b) for a, _, b in base]
    loose = []
    if "@" in text:
        at, before = text.find("@"), 0
        while at >= 0:  # the whole token around it, each token once
            left = text[before:at]
            a = at if not left or left[-1].isspace() else at - len(left.rsplit(None, 1)[-1])
            b = before = TOKEN_END.match(text, at + 1).end()
            while b > at + 1 and text[b - 1] in ".,;:!?)]>\"'":
                b -= 1
            loose.append((a, b))
            at = text.find("@", before)
    if WRITTEN_END.search(text):
        loose += [m.span() for m in WRITTEN_AT.finditer(text)]
    if DIGIT.search(text):
        loose += [m.span() for m in NUMBER.finditer(text) if len(DIGIT.findall(m[0])) >= 7]
    loose.sort()
    k, reach = 0, 0
    for a, b in loose:
        if a < reach:
            continue
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            out.append(Mention(a, b, 0, False))
            reach = b
    return sorted(out, key=lambda m: (m.start, m.label, m.end))


def features(text: str, m: Mention) -> list[float]:
    part = text[m.start:m.end]
    digits, before = len(DIGIT.findall(part)), text[max(0, m.start - 24):m.start].split()
    cue = before[-1].strip(":.,#(").lower() if before else ""
    groups = [len(g) for g in re.findall("[0-9]+", part)]
    named = "@" in part or "at]" in part.lower() or "at)" in part.lower()
    quad = not named and part.count(".") == 3 and len(groups) == 4 and max(groups) <= 3
    size = [0.0] * len(LENGTHS)
    if not named:
        for k, low in enumerate(LENGTHS):
            if digits >= low and (k + 1 == len(LENGTHS) or digits < LENGTHS[k + 1]):
                size[k] = 1.0
    checked = not named and 12 <= digits <= 19 and luhn("".join(DIGIT.findall(part)))
    return [1.0, float(named), float(quad), float(checked), float(not named and "(" in part), float(not named and "-" in part),
            float(not named and " " in part), float(bool(groups) and set(groups) == {4}), min(len(groups), 8) / 8,
            *(float(cue in words) for words in CUES), *size]


def skip_keys(text: str, m: Mention) -> list[str]:
    part = re.sub(r"\s?[\[(]at[\])]\s?", "@", text[m.start:m.end].lower())
    if "@" in part:
        return [f"m{part}", f"n{part.partition('@')[0]}"]
    digits = "".join(DIGIT.findall(part))
    return [f"d{digits}", f"e{digits[-8:]}"]


def skip_groups(text: str, found: list[Mention]) -> list[tuple[int, ...]]:
    """Numbers of the mentions that share a key, once where two keys give the same."""
    groups: dict[str, list[int]] = {}
    for k, m in enumerate(found):
        for key in skip_keys(text, m):
            groups.setdefault(key, []).append(k)
    return sorted({tuple(g) for g in groups.values() if len(g) > 1})


def propagate(node: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int) -> np.ndarray:
    """Label probabilities by loopy message passing, of ``rounds`` at most; ``node`` and ``pair`` are log potentials."""
    if not len(edges):
        belief = node
    else:
        a = np.concatenate([edges[:, 0], edges[:, 1]])
        b = np.concatenate([edges[:, 1], edges[:, 0]])
        psi = np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))
        back = np.concatenate([np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))])
        message = np.zeros((len(a), node.shape[1]))
        for _ in range(rounds):
            belief = node.copy()
            np.add.at(belief, b, message)
            out = belief[a] - message[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ei,eij->ej", out, psi) + 1e-30)
            old, message = message, 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
            if np.abs(message - old).max() < SETTLED:
                break
        belief = node.copy()
        np.add.at(belief, b, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, log
    agree: float = 2.5
    clamp: float = 12.0
    rounds: int = 500
    threshold: float = 0.5

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base spans, all spans) as (start, kind number, end)."""
        base = base_spans(text)
        found = mentions(text, base)
        if len(found) == len(base):
            return base, base
        node = np.array([features(text, m) for m in found]) @ self.weights
        for k, m in enumerate(found):
            if m.base:
                node[k] = 0.0
                node[k, m.label] = self.clamp
        chain = [(k, k + 1) for k in range(len(found) - 1)]
        groups = skip_groups(text, found)
        shared = np.zeros((len(groups), node.shape[1]))
        for k, group in enumerate(groups):
            known = Counter(found[j].label for j in group if found[j].base)
            if known:
                shared[k, min(known, key=lambda label: (-known[label], label))] = self.clamp * len(group)  # no message is stronger
        node = np.concatenate([node, shared])
        skips = [(j, len(found) + k) for k, group in enumerate(groups) for j in group]
        pair = np.concatenate([np.repeat(self.chain[None], len(chain), 0),
                               np.repeat(self.agree * np.eye(len(KINDS) + 1)[None], len(skips), 0)])
        p = propagate(node, np.array(chain + skips).reshape(-1, 2), pair, self.rounds)
        added = [(m.start, int(p[k, 1:].argmax()), m.end) for k, m in enumerate(found)
                 if not m.base and p[k, 1:].max() >= self.threshold]
        return base, sorted(base + added)


def fit(docs: DataFrame, *, text_col: str = "text", max_sample: int = 2000, max_sample_chars: int = 20_000,
        steps: int = 200, rate: float = 0.1, ridge: float = 0.01) -> Field:
    """Node and chain potentials from base matches in a bounded sample of texts with mentions. Eager."""
    texts = docs.select(text_col, F.xxhash64(text_col).alias("_hash")).filter(
        F.col(text_col).rlike("@|[0-9]{2}") & (F.length(text_col) <= max_sample_chars))
    chosen = texts.select("_hash").distinct().orderBy("_hash").limit(max_sample)  # hashes only; a bounded list
    texts = texts.join(F.broadcast(chosen), "_hash").dropDuplicates(["_hash"])

    def start():
        def step(columns):
            rows, labels = [], []
            for text in columns[1]:
                found = mentions(text, base_spans(text))
                rows.append(np.array([features(text, m) for m in found], np.float32).tobytes())
                labels.append(bytes(m.label for m in found))
            return [columns[0], rows, labels]

        return step

    n = len(KINDS) + 1
    x, y, pairs = [np.zeros((0, FEATURES))], [], np.ones((n, n))
    rows = map_rows(texts, ["_hash", text_col], "hash bigint, x binary, labels binary", start).collect()
    for row in sorted(rows, key=lambda row: row["hash"]):
        labels = list(row["labels"])
        x.append(np.frombuffer(row["x"], np.float32).reshape(-1, FEATURES).astype(float))
        y += labels
        for a, b in zip(labels, labels[1:], strict=False):
            pairs[a, b] += 1
    x, target = np.vstack(x), np.eye(n)[np.array(y, int)]
    w, m, v = np.zeros((FEATURES, n)), 0.0, 0.0
    w[0, 0] = 2.0  # nothing known: no label
    for k in range(1, steps + 1 if len(x) else 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = x.T @ (target - p / p.sum(axis=1, keepdims=True)) / len(x) - ridge * w / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    share = pairs.sum(axis=0, keepdims=True) * pairs.sum(axis=1, keepdims=True) / pairs.sum()
    return Field(w, np.clip(0.5 * np.log(pairs / share), -1.0, 1.0))


def find_personal_data(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone of the base patterns, base_sha256, spans)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def line(spans):
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def start():
        def step(columns):
            out = [[] for _ in range(len(KINDS) + 2)]
            for text in columns[1]:
                base, spans = field.spans(text or "")
                counts = [sum(s[1] == k for s in base) for k in range(len(KINDS))]
                row = (*counts, hashlib.sha256(line(base).encode()).hexdigest(), line(spans))
                for values, value in zip(out, row, strict=True):
                    values.append(value)
            return [columns[0], *out]

        return step

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, {counts}, base_sha256 string, spans string", start)
