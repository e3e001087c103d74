"""Secret scans with one combined deterministic automaton over UTF-8 bytes.

The rules' regexes become one automaton by subset construction and minimisation. A single
pass over the bytes of a text, one table look-up each, tells where a rule's match ends
first; a small automaton of that rule's reversed pattern gives its leftmost start, one of
the pattern itself its longest end. Rules do not hide one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost, longest and apart; one whose counted part is shorter than ``least`` is dropped.

    Counted is the whole match, or with ``value`` only what follows the separator. Lengths
    are checked after matching, not written as {n,} into the pattern: counters of several
    rules multiply in a combined automaton, and a match that fails still uses up its bytes.
    """

    kind: str
    pattern: str
    least: int = 0
    value: bool = False


VALUE = "A-Za-z0-9+/_.=-"
KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
#: The one counter is for hex, whose every letter a to f would otherwise be a match; its runs are maximal, so nothing else changes.
BASE = (
    Rule("assign", "(" + KEYWORDS + ")[\"']? *[:=] *[\"']?[" + VALUE + "]+", 6, value=True),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge", "gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 40),
)
RULES = BASE + MORE

# --- patterns: a tree of ("set", bytes), ("cat", [..]), ("alt", [..]), ("rep", node, least, most or None)


def parse(pattern: str):
    """A small regex dialect over ASCII: literals, [sets], (groups), |, and ? * + {m,n}."""
    pos = 0

    def alt():
        nonlocal pos
        parts = [cat()]
        while pos < len(pattern) and pattern[pos] == "|":
            pos += 1
            parts.append(cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def cat():
        parts = []
        while pos < len(pattern) and pattern[pos] not in "|)":
            parts.append(repeated(atom()))
        return ("cat", parts)

    def repeated(node):
        nonlocal pos
        while pos < len(pattern) and pattern[pos] in "?*+{":
            c = pattern[pos]
            if c == "{":
                end = pattern.index("}", pos)
                low, _, high = pattern[pos + 1 : end].partition(",")
                bounds = (int(low), (int(high) if high else None) if "," in pattern[pos:end] else int(low))
                pos = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
                pos += 1
            node = ("rep", node, *bounds)
        return node

    def atom():
        nonlocal pos
        c = pattern[pos]
        pos += 1
        if c == "(":
            node = alt()
            pos += 1
            return node
        if c == "[":
            end = pattern.index("]", pos)
            body, chars, i = pattern[pos:end], set(), 0
            while i < len(body):
                if i + 2 < len(body) and body[i + 1] == "-":
                    chars.update(range(ord(body[i]), ord(body[i + 2]) + 1))
                    i += 3
                else:
                    chars.add(ord(body[i]))
                    i += 1
            pos = end + 1
            return ("set", frozenset(chars))
        return ("set", frozenset([ord(c)]))

    return alt()


def reverse(node):
    """The pattern of the reversed matches."""
    kind = node[0]
    if kind == "cat":
        return ("cat", [reverse(x) for x in reversed(node[1])])
    if kind == "alt":
        return ("alt", [reverse(x) for x in node[1]])
    if kind == "rep":
        return ("rep", reverse(node[1]), *node[2:])
    return node


@dataclass
class Nfa:
    """Thompson's construction: byte-set edges, empty edges, and the rule that each final state accepts."""

    edges: list = field(default_factory=list)
    empty: list = field(default_factory=list)
    final: dict = field(default_factory=dict)

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, node, start: int) -> int:
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.edges[start].append((node[1], end))
            return end
        if kind == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                s = self.state()
                self.empty[start].append(s)
                self.empty[self.add(x, s)].append(end)
            return end
        _, x, low, high = node
        for _ in range(low):
            start = self.add(x, start)
        if high is None:
            hub, end = self.state(), self.state()
            self.empty[start].append(hub)
            self.empty[self.add(x, hub)].append(hub)
            self.empty[hub].append(end)
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.add(x, start)
            self.empty[start].append(end)
        return end


@dataclass(frozen=True)
class Dfa:
    """``table[256 * state + byte]`` is 256 times the next state; accept[state] is the set of rules. State 0 starts; -1 leads nowhere."""

    table: list
    accept: list

    def longest(self, data: bytes, at: int, end: int, step: int = 1) -> int:
        """The furthest boundary of a match that begins at boundary ``at`` and goes ``step``, or -1."""
        s, best, table = 0, -1, self.table
        while at != end:
            s = table[s + (data[at] if step > 0 else data[at - 1])]
            if s < 0:
                break
            at += step
            if self.accept[s >> 8]:
                best = at
        return best


def determinise(patterns: list, anywhere: bool) -> Dfa:
    """Subset construction, then Moore's minimisation. ``anywhere``: a match may begin at any byte."""
    nfa = Nfa()
    root = nfa.state()
    for i, p in enumerate(patterns):
        s = nfa.state()
        nfa.empty[root].append(s)
        nfa.final[nfa.add(p, s)] = i

    def closure(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    start = closure([root])
    number, order, rows = {start: 0}, [start], []
    for states in order:
        moves: dict[int, set] = {}
        for s in states:
            for chars, t in nfa.edges[s]:
                for c in chars:
                    moves.setdefault(c, set()).add(t)
        row, cache = [0 if anywhere else -1] * 256, {}
        for c, targets in moves.items():
            key = frozenset(targets)
            if key not in cache:
                nxt = closure(targets) | (start if anywhere else frozenset())
                if nxt not in number:
                    number[nxt] = len(order)
                    order.append(nxt)
                cache[key] = number[nxt]
            row[c] = cache[key]
        rows.append(row)
    accept = [frozenset(nfa.final[s] for s in states if s in nfa.final) for states in order]
    block = {a: i for i, a in enumerate(dict.fromkeys(accept))}
    part = [block[a] for a in accept]
    while True:
        signs: dict = {}
        new = [signs.setdefault((part[i], *(part[t] if t >= 0 else -1 for t in row)), len(signs)) for i, row in enumerate(rows)]
        if len(signs) == len(set(part)):
            break
        part = new
    first = {p: i for i, p in reversed(list(enumerate(part)))}
    names = {p: k for k, p in enumerate(sorted(first, key=lambda p: first[p]))}
    table, kept = [], []
    for p in sorted(names, key=names.get):
        i = first[p]
        table += [names[part[t]] << 8 if t >= 0 else -1 for t in rows[i]]
        kept.append(accept[i])
    return Dfa(table, kept)


class Scanner:
    """The rules' combined automaton, and for each rule its own forward and reversed ones."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        trees = [parse(r.pattern) for r in rules]
        self.rules = rules
        search = determinise(trees, anywhere=True)
        # states that accept are numbered last, so that one comparison tells them apart
        n = len(search.accept)
        order = sorted(range(n), key=lambda s: bool(search.accept[s]))
        at = {s: k for k, s in enumerate(order)}
        self.accept = [sorted(search.accept[s]) for s in order]
        self.table = [at[t >> 8] << 8 for s in order for t in search.table[s << 8 : (s + 1) << 8]]
        self.start = at[0] << 8
        self.first_final = next((k for k, a in enumerate(self.accept) if a), n) << 8
        self.forward = [determinise([t], anywhere=False) for t in trees]
        self.backward = [determinise([reverse(t)], anywhere=False) for t in trees]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted; the leftmost longest matches of each rule, apart from one another."""
        table, s, final = self.table, self.start, self.first_final
        hits = []
        for i, b in enumerate(data):
            s = table[s + b]
            if s >= final:
                hits.append((i + 1, s))
        if not hits:
            return []
        done, out = [0] * len(self.rules), []
        for end, s in hits:
            for r in self.accept[s >> 8]:
                if end <= done[r]:
                    continue
                start = self.backward[r].longest(data, end, done[r], -1)
                if start < 0:
                    continue
                stop = self.forward[r].longest(data, start, len(data))
                done[r] = stop
                out.append((start, r, stop))
        return sorted(out)




def assigned_length(match: bytes) -> int:
    """Characters of the value in a match of the form key, separator, value: what follows the separator and an optional quote."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    rest = match[at:].lstrip(b" ")
    return len(rest[1:] if rest[:1] in (b'"', b"'") else rest)


def scan_text(scanner: Scanner, text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points by start, then in the order of the rules."""
    data = (text or "").encode()
    found = []
    for start, r, end in scanner.spans(data):
        rule = scanner.rules[r]
        if (assigned_length(data[start:end]) if rule.value else end - start) < rule.least:
            continue
        found.append((start, end, rule.kind))
    if found and len(data) != len(text):
        at = {}
        marks = sorted({x for a, b, _ in found for x in (a, b)})
        chars = last = 0
        for m in marks:
            chars += len(data[last:m].decode())
            at[m] = chars
            last = m
        found = [(at[a], at[b], k) for a, b, k in found]
    return found


SCAN_DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
SCAN = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: counts of the base kinds, a digest of their spans, and all spans.

    A null or empty text has no spans. Ids may be null or repeated; other columns are not
    read. Narrow: no shuffle; a text is scanned once however long it is.
    """
    scanner = Scanner(rules)
    base = [r.kind for r in BASE]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[] for _ in base], [], []
            for text in batch.column(1):
                found = scan_text(scanner, text.as_py())
                for kind, c in zip(base, counts, strict=True):
                    c.append(sum(k == kind for _, _, k in found))
                digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in found if k in base).encode()).hexdigest())
                spans.append(",".join(f"{k}:{a}:{b}" for a, b, k in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], schema=SCAN)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(scan, SCAN_DDL)
