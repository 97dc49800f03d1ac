"""Secret scans with one deterministic automaton for all rules.

Rule patterns are parsed to a nondeterministic automaton over byte classes, made
deterministic by subset construction, minimised by partition refinement, and laid
out as transition arrays.  A text is then read once, byte by byte, for all rules
together; the few places where a rule ends are located by the rule's own reversed
and anchored automata, which come from the same construction."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from spanveil.llm.common import rows_of

# --- patterns: parse trees are ("set", frozenset), ("cat", [..]), ("alt", [..]), ("rep", node, least, most)

ESCAPES = {"n": 10, "t": 9, "r": 13}


def parse(pattern: str):
    """Literals, ``.``-free classes, groups, ``|``, ``? * + {m,n}`` and ``(?i:...)``, over ASCII."""
    at = 0

    def peek() -> str:
        return pattern[at] if at < len(pattern) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return pattern[at - 1]

    def escape() -> int:
        c = take()
        if c == "x":
            return int(take() + take(), 16)
        return ESCAPES.get(c, ord(c))

    def both(codes: set[int], fold: bool) -> frozenset:
        return frozenset(codes | {ord(f(chr(c))) for c in codes for f in (str.lower, str.upper) if chr(c).isalpha()} if fold else codes)

    def klass(fold: bool):
        codes: set[int] = set()
        inverse = peek() == "^" and bool(take())
        while peek() != "]":
            low = escape() if (c := take()) == "\\" else ord(c)
            if peek() == "-" and pattern[at + 1] != "]":
                take()
                high = escape() if (c := take()) == "\\" else ord(c)
                codes.update(range(low, high + 1))
            else:
                codes.add(low)
        take()
        return ("set", both(set(range(256)) - codes if inverse else codes, fold))

    def atom(fold: bool):
        c = take()
        if c == "(":
            own = fold
            if pattern.startswith("?i:", at):
                own = bool([take() for _ in range(3)])
            elif pattern.startswith("?:", at):
                take(), take()
            node = alternatives(own)
            take()
            return node
        if c == "[":
            return klass(fold)
        return ("set", both({escape() if c == "\\" else ord(c)}, fold))

    def sequence(fold: bool):
        parts = []
        while peek() not in ("", "|", ")"):
            node = atom(fold)
            while peek() and peek() in "?*+{":
                c = take()
                if c == "{":
                    inside = ""
                    while peek() != "}":
                        inside += take()
                    take()
                    low, _, high = inside.partition(",")
                    node = ("rep", node, int(low), int(high) if high else (None if "," in inside else int(low)))
                else:
                    node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
            parts.append(node)
        return ("cat", parts)

    def alternatives(fold: bool):
        options = [sequence(fold)]
        while peek() == "|":
            take()
            options.append(sequence(fold))
        return options[0] if len(options) == 1 else ("alt", options)

    return alternatives(False)


def reverse(node):
    if node[0] == "cat":
        return ("cat", [reverse(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [reverse(x) for x in node[1]])
    if node[0] == "rep":
        return ("rep", reverse(node[1]), *node[2:])
    return node


class Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []  # moves without a byte
        self.on: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append([])
        return len(self.free) - 1

    def add(self, node, start: int) -> int:
        """Build ``node`` from ``start``; its end."""
        kind = node[0]
        if kind == "set":
            self.on[start].append((node[1], end := self.state()))
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                self.free[start].append(first := self.state())
                self.free[self.add(part, first)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            self.free[start].append(loop := self.state())
            self.free[self.add(inner, loop)].append(loop)
            return loop
        ends = [start]
        for _ in range(high - low):
            ends.append(start := self.add(inner, start))
        end = self.state()
        for x in ends:
            self.free[x].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``classes``: byte -> class. ``rows[state][class]``: next row (a list, itself a
    row); the last entry of a row is the set of rules that end there, as bits."""

    classes: bytes
    first: list
    states: int


def determinise(nfa: Nfa, start: int, ends: dict[int, int], anywhere: bool) -> Automaton:
    """Subset construction over byte classes, then minimisation.  ends: state -> rule bit."""
    sets = {s for moves in nfa.on for s, _ in moves}
    kinds: dict[tuple, int] = {}
    classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    sample = {c: b for b, c in enumerate(classes)}
    first = nfa.closure([start])
    number, todo, moves = {first: 0}, [first], []
    while todo:
        here = todo.pop(0)
        row = []
        for c in range(len(kinds)):
            step = {t for s in here for on, t in nfa.on[s] if sample[c] in on} | ({start} if anywhere else set())
            there = nfa.closure(step)
            if there not in number:
                number[there] = len(number)
                todo.append(there)
            row.append(number[there])
        moves.append(row)
    marks = [sum({1 << ends[s] for s in states if s in ends}) for states in number]
    block = [sorted(set(marks)).index(m) for m in marks]
    while True:  # states stay together while their blocks and their moves' blocks agree
        seen: dict[tuple, int] = {}
        finer = [seen.setdefault((block[i], *[block[t] for t in row]), len(seen)) for i, row in enumerate(moves)]
        if len(seen) == len(set(block)):
            break
        block = finer
    size = len(set(finer))
    rows = [[] for _ in range(size)]
    for i, row in enumerate(moves):
        if not rows[finer[i]]:
            rows[finer[i]].extend([rows[finer[t]] for t in row] + [marks[i]])
    return Automaton(classes, rows[finer[0]], size)


def one(node, anywhere: bool = False) -> Automaton:
    nfa = Nfa()
    start = nfa.state()
    return determinise(nfa, start, {nfa.add(node, start): 0}, anywhere)


def shortest(node):
    """``node`` without the open end of its last repetition: it ends wherever a match
    first can.  The one pass needs no more, and the automaton stays small."""
    if node[0] == "cat" and node[1]:
        return ("cat", [*node[1][:-1], shortest(node[1][-1])])
    if node[0] == "rep" and node[3] is None and node[2] > 0:
        return ("rep", node[1], node[2], node[2])
    return node


@dataclass(frozen=True)
class Rule:
    """A match is ``head`` and then ``pattern``.  ``least``: shortest match that counts, in
    bytes, head not included."""

    kind: str
    pattern: str
    least: int = 0
    head: str = ""


#: The base rules, as the query's contract gives them, in its order,
#: then further kinds.  A match that is too short is dropped, but the text in it is spent.
RULES = (
    Rule("assign", r"[A-Za-z0-9+/_.=\-]+", 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", least=40),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", least=20),
    Rule("google", r"AIza[A-Za-z0-9_\-]+", least=39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", least=24),
)
BASE = ("assign", "access", "hex")


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        trees = [("cat", [parse(r.head), parse(r.pattern)]) for r in rules]
        short = [shortest(t) for t in trees]
        nfa = Nfa()
        start, ends = nfa.state(), {}
        for i, tree in enumerate(short):
            nfa.free[start].append(own := nfa.state())
            ends[nfa.add(tree, own)] = i
        self.all = determinise(nfa, start, ends, anywhere=True)
        self.back = [one(reverse(t)) for t in short]
        self.ahead = [one(t) for t in trees]
        self.heads = [one(parse(r.head)) for r in rules]

    @staticmethod
    def longest(auto: Automaton, data: bytes, places: range) -> int:
        """How many of the places the longest match takes; -1: none."""
        row, taken = auto.first, 0 if auto.first[-1] else -1
        for n, at in enumerate(places, 1):
            before, row = row, row[auto.classes[data[at]]]
            if row[-1]:
                taken = n
            elif row is before and all(x is row for x in row[:-1]):
                break  # nothing leads on from here
        return taken

    def ends(self, data: bytes) -> dict[int, list[int]]:
        """Rule -> where it ends, from the one pass over the bytes."""
        found: dict[int, list[int]] = defaultdict(list)
        row = self.all.first
        for at, c in enumerate(data.translate(self.all.classes)):
            row = row[c]
            if row[-1]:
                for i in range(len(self.rules)):
                    if row[-1] >> i & 1:
                        found[i].append(at + 1)
        return found

    def locate(self, data: bytes, i: int, ends: list[int]) -> Iterator[tuple[int, int]]:
        """Leftmost non-overlapping longest matches of one rule, in bytes."""
        spent = 0
        for end in ends:
            if end <= spent:
                continue
            back = self.longest(self.back[i], data, range(end - 1, spent - 1, -1))
            if back > 0:
                start = end - back
                spent = start + self.longest(self.ahead[i], data, range(start, len(data)))
                yield start, spent

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points, by start, then as rules are listed."""
        data = (text or "").encode("utf-8", "surrogatepass")
        found = []
        for i, ends in self.ends(data).items():
            for start, stop in self.locate(data, i, ends):
                if stop - start - self.longest(self.heads[i], data, range(start, stop)) >= self.rules[i].least:
                    found.append((start, i, stop))
        out, at, points = [], 0, 0
        for start, i, stop in sorted(found):  # all rules are ASCII inside
            points, at = points + len(data[at:start].decode("utf-8", "surrogatepass")), start
            out.append((points, points + stop - start, self.rules[i].kind))
        return out


@cache
def scanner() -> Scanner:
    return Scanner()


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, counts of the base kinds, SHA-256 of the base
    spans and all spans.  Null or empty texts have none; nothing is shuffled."""

    def part(batches):
        scan = scanner()
        for batch in rows_of(batches):
            found = [scan.spans(t.as_py()) for t in batch.column("text")]
            base = [[x for x in f if x[2] in BASE] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64())]
                + [pa.array([sum(x[2] == k for x in f) for f in base], pa.int64()) for k in BASE]
                + [pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base]), pa.array([joined(f) for f in found], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(part, SCHEMA)
