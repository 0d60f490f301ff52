"""Secret scan with one combined deterministic automaton.

All rule regexes are compiled together: Thompson construction, subset construction, minimisation, then
flat transition arrays over byte classes. The combined automaton reads every text once, from its last
byte to its first, for the reversed rules; an accepting state after byte i says which rules have a match
that starts at i. A match's end is found by the rule's own anchored automaton, run over the match alone.
Taking starts from left to right and the longest end for each gives the leftmost non-overlapping matches.

Defined results: a null text counts as empty; empty texts have no spans; null ids stay; repeated rows are each scanned; of
kinds that start at one place the one listed first comes first; a very long text takes a few bytes a byte, and a few more for each
span; an empty table gives no rows; columns besides doc_id and text, whatever their names, are ignored. Offsets are code points,
ends exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Rule(NamedTuple):
    kind: str
    pattern: str
    least: int  # characters that a match needs, or its last run if tail
    tail: bool = False


#: The kinds of the contract, in its order. Runs below 16 cannot become a span, so hex counts to 16 in the automaton;
#: an assignment too short to report still consumes its text, so its length is tested after matching.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 12, tail=True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16}[0-9a-f]*", 16),
)
#: Kinds that the automaton adds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.=~-]+", 27),
)
RULES = BASE_RULES + MORE_RULES


class _Parser:
    """Byte regexes: literals, \\xHH, classes, groups, (?i:...), |, ?, *, +, {m}, {m,}, {m,n}. A tree of tuples."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        node = self._either(False)
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return node

    def _peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def _either(self, fold: bool):
        options = [self._sequence(fold)]
        while self._peek() == "|":
            self.i += 1
            options.append(self._sequence(fold))
        return options[0] if len(options) == 1 else ("or", options)

    def _sequence(self, fold: bool):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeat(self._atom(fold)))
        return ("seq", parts)

    def _repeat(self, node):
        while (c := self._peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return node

    def _code(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def _atom(self, fold: bool):
        if self._peek() == "(":
            self.i += 1
            if self.p.startswith("?i:", self.i):
                self.i, fold = self.i + 3, True
            node = self._either(fold)
            if self._peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.i += 1
            return node
        if self._peek() == "[":
            self.i += 1
            codes: set[int] = set()
            while self._peek() != "]":
                low = self._code()
                if self._peek() == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    codes |= set(range(low, self._code() + 1))
                else:
                    codes.add(low)
            self.i += 1
        else:
            codes = {self._code()}
        if fold:
            codes |= {ord(chr(x).swapcase()) for x in codes if chr(x).isalpha()}
        return ("set", frozenset(codes))


def _reversed(node):
    if node[0] == "seq":
        return ("seq", [_reversed(x) for x in reversed(node[1])])
    if node[0] == "or":
        return ("or", [_reversed(x) for x in node[1]])
    if node[0] == "rep":
        return ("rep", _reversed(node[1]), *node[2:])
    return node


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []  # moves without a byte
        self.move: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.move.append(None)
        return len(self.free) - 1

    def add(self, node, at: int) -> int:
        """Build node from state at; its end state."""
        if node[0] == "set":
            end = self.state()
            self.move[at] = (node[1], end)
            return end
        if node[0] == "seq":
            for x in node[1]:
                at = self.add(x, self._fresh(at))
            return at
        if node[0] == "or":
            end = self.state()
            for x in node[1]:
                self.free[self.add(x, self._fresh(at))].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            at = self.add(inner, self._fresh(at))
        if high is None:
            hub = self._fresh(at)
            self.free[self.add(inner, self._fresh(hub))].append(hub)
            return hub
        ends = [at]
        for _ in range(high - low):
            at = self.add(inner, self._fresh(at))
            ends.append(at)
        end = self.state()
        for x in ends:
            self.free[x].append(end)
        return end

    def _fresh(self, at: int) -> int:
        new = self.state()
        self.free[at].append(new)
        return new

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for y in self.free[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return frozenset(seen)


class Automaton(NamedTuple):
    classes: bytes  # byte -> class
    nxt: list[int]  # nxt[state + class]; states are multiples of the number of classes
    start: int
    accept: int  # states from here on accept
    dead: int  # a state that nothing leaves, -1 if none
    masks: dict[int, int]  # accepting state -> bits of rules


def compile_rules(trees: list, anchored: bool) -> Automaton:
    """Subset construction over byte classes, then minimisation by partition refinement."""
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for k, tree in enumerate(trees):
        first = nfa.state()
        nfa.free[root].append(first)
        ends[nfa.add(tree, first)] = 1 << k
    sets = sorted({m[0] for m in nfa.move if m}, key=sorted)
    shape: dict[tuple, int] = {}
    classes = bytes(shape.setdefault(tuple(b in s for s in sets), len(shape)) for b in range(256))
    n = len(shape)
    sample = {c: b for b, c in reversed(list(enumerate(classes)))}
    start = nfa.closure([root])
    known, rows, masks, todo = {start: 0}, [], [], [start]
    while todo:
        have = todo.pop(0)
        masks.append(sum({ends[x] for x in have if x in ends}))
        row = []
        for c in range(n):
            to = {m[1] for x in have if (m := nfa.move[x]) and sample[c] in m[0]}
            new = nfa.closure(to) if anchored else nfa.closure(to) | start
            if new not in known:
                known[new] = len(known)
                todo.append(new)
            row.append(known[new])
        rows.append(row)
    table = np.array(rows, dtype=np.int64)
    _, part = np.unique(np.array(masks), return_inverse=True)
    while True:
        _, new = np.unique(np.column_stack([part[:, None], part[table]]), axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == part.max():
            break
        part = new
    mask_of: dict[int, int] = {int(p): m for p, m in zip(part, masks, strict=True)}
    order = sorted(mask_of, key=lambda p: (mask_of[p] > 0, p))
    place = {p: i for i, p in enumerate(order)}
    nxt = [0] * (n * len(order))
    for state, row in enumerate(rows):
        at = place[int(part[state])] * n
        nxt[at : at + n] = [place[int(part[x])] * n for x in row]
    dead = next((place[p] * n for p in order if not mask_of[p] and set(nxt[place[p] * n : place[p] * n + n]) == {place[p] * n}), -1)
    plain = sum(1 for p in order if not mask_of[p])
    return Automaton(classes, nxt, place[int(part[0])] * n, plain * n, dead, {place[p] * n: m for p, m in mask_of.items() if m})


@lru_cache(maxsize=8)
def automata(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Automaton]]:
    trees = [_Parser(r.pattern).parse() for r in rules]
    return compile_rules([_reversed(t) for t in trees], anchored=False), [compile_rules([t], anchored=True) for t in trees]


def _ends(data: bytes, at: int, rule: Automaton) -> tuple[int, int]:
    """First and last position at which the rule accepts from at."""
    s, first, last, classes, nxt = rule.start, -1, -1, rule.classes, rule.nxt
    for i in range(at, len(data)):
        s = nxt[s + classes[data[i]]]
        if s >= rule.accept:
            first, last = (i + 1 if first < 0 else first), i + 1
        elif s == rule.dead:
            break
    return first, last


def scan(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """Spans (start, number of the rule, end) in code points, by start and then by rule."""
    if not text:
        return []
    whole, each = automata(rules)
    data = text.encode("utf-8", "surrogatepass")
    nxt, accept, s, hits = whole.nxt, whole.accept, whole.start, []
    bytes_left = iter(data.translate(whole.classes)[::-1])
    for c in bytes_left:
        s = nxt[s + c]
        if s >= accept:
            at, mask = bytes_left.__length_hint__(), whole.masks[s]
            if hits and hits[-1][0] == at + 1 and hits[-1][2] == mask:
                hits[-1][0] = at  # one entry for neighbouring starts of the same rules, as in a long run of hex digits
            else:
                hits.append([at, at, mask])
    if not hits:
        return []
    found, free = [], [0] * len(rules)
    for first_start, last_start, mask in reversed(hits):
        for k, rule in enumerate(rules):
            at = max(first_start, free[k])
            while mask >> k & 1 and at <= last_start:
                first, end = _ends(data, at, each[k])
                free[k] = end
                if end - (first - 1 if rule.tail else at) >= rule.least:
                    found.append((at, k, end))
                at = end
    found.sort()
    if not data.isascii():
        place, last, chars = {}, 0, 0
        for b in sorted({x for a, _, e in found for x in (a, e)}):
            chars, last = chars + len(data[last:b].decode("utf-8", "surrogatepass")), b
            place[b] = chars
        found = [(place[a], k, place[e]) for a, k, e in found]
    return found


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_more long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts by base kind, the digest of the base spans, and all spans.

    rules begins with the three base rules; any further rule only adds spans. A narrow map: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in batch.column("text"):
                spans = scan(text.as_py(), rules)
                for k in range(3):
                    out[k].append(sum(x[1] == k for x in spans))
                out[3].append(sum(x[1] > 2 for x in spans))
                named = [(k, f"{rules[k].kind}:{a}:{e}") for a, k, e in spans]
                out[4].append(hashlib.sha256(",".join(x for k, x in named if k < 3).encode()).hexdigest())
                out[5].append(",".join(x for _, x in named))
            counts = [pa.array(x, pa.int64()) for x in out[:4]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *counts, pa.array(out[4], pa.string()), pa.array(out[5], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_more", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
