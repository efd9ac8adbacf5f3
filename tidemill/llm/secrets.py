"""Secret scanning with one deterministic automaton for all rules.

Rules are regular expressions over bytes, in two parts: a prefix and a body of a least
length. ``compile_rules`` turns "anything, then prefix, then the least body" of every
rule into one non-deterministic automaton, makes it deterministic by subset construction
and minimal by partition refinement, and lays it out as a transition array. A batch of
texts passes through the array once, all blocks of it side by side; every block starts
in the first state and is set right where the block before ended in another.

Only texts in which some rule was accepted are looked at again: there each accepted
rule's own automata give the leftmost spans, longest and not overlapping, and spans
whose body is too short are dropped (they still use up their text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import releasing, require, table, with_columns
from tidemill.llm._text import passes, utf8

BLOCK = 1024


class Rule(NamedTuple):
    kind: str
    prefix: str
    body: str
    least: int
    any_case: bool = False


#: The base rules, in the order of their kinds, and further ones.
BASE = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=\-]", 6, True),
    Rule("access", r"AKIA", r"[A-Z0-9]", 16),
    Rule("hex", r"", r"[0-9a-f]", 24),
)
MORE = (
    Rule("github", r"gh[opsu]_", r"[A-Za-z0-9]", 36),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ", r"[A-Za-z0-9_.\-]", 16),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY", r"-", 5),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9\-]", 10),
)


# Regular expressions: literals, \xHH and escapes, classes, groups, |, ?, *, + and {m,n}.


class _Nfa:
    def __init__(self) -> None:
        self.arcs: list[list[tuple[frozenset[int] | None, int]]] = []

    def state(self) -> int:
        self.arcs.append([])
        return len(self.arcs) - 1


class _Parser:
    def __init__(self, pattern: str, any_case: bool):
        self.text, self.at, self.any_case = pattern.encode("latin-1"), 0, any_case

    def peek(self) -> bytes:
        return self.text[self.at : self.at + 1]

    def take(self) -> bytes:
        self.at += 1
        return self.text[self.at - 1 : self.at]

    def either(self):
        options = [self.sequence()]
        while self.peek() == b"|":
            self.take()
            options.append(self.sequence())
        return ("or", options)

    def sequence(self):
        parts = []
        while self.peek() not in (b"", b"|", b")"):
            parts.append(self.repeat())
        return ("and", parts)

    def repeat(self):
        node = self.atom()
        while self.peek() in (b"?", b"*", b"+", b"{"):
            sign = self.take()
            if sign == b"{":
                end = self.text.index(b"}", self.at)
                low, _, high = self.text[self.at : end].partition(b",")
                self.at = end + 1
                node = ("times", node, int(low), int(high or low))
            else:
                node = ("times", node, int(sign == b"+"), 1 if sign == b"?" else None)
        return node

    def byte(self) -> int:
        c = self.take()
        if c != b"\\":
            return c[0]
        c = self.take()
        if c == b"x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return c[0]

    def atom(self):
        if self.peek() == b"(":
            self.take()
            node = self.either()
            self.take()
            return node
        found = set()
        if self.peek() == b"[":
            self.take()
            while self.peek() != b"]":
                low = high = self.byte()
                if self.peek() == b"-" and self.text[self.at + 1 : self.at + 2] != b"]":
                    self.take()
                    high = self.byte()
                found.update(range(low, high + 1))
            self.take()
        else:
            found.add(self.byte())
        if self.any_case:
            found |= {c ^ 32 for c in found if 65 <= c <= 90 or 97 <= c <= 122}
        return ("set", frozenset(found))


def _build(nfa: _Nfa, node, start: int) -> int:
    """Add ``node`` from state ``start`` on; its last state."""
    kind = node[0]
    if kind == "set":
        end = nfa.state()
        nfa.arcs[start].append((node[1], end))
        return end
    if kind == "and":
        for part in node[1]:
            start = _build(nfa, part, start)
        return start
    if kind == "or":
        end = nfa.state()
        for part in node[1]:
            nfa.arcs[_build(nfa, part, start)].append((None, end))
        return end
    _, part, low, high = node
    for _ in range(low):
        start = _build(nfa, part, start)
    if high is None:
        loop, end = nfa.state(), nfa.state()
        nfa.arcs[start].append((None, loop))
        nfa.arcs[_build(nfa, part, loop)].append((None, loop))
        nfa.arcs[loop].append((None, end))
        return end
    end = nfa.state()
    for _ in range(high - low):
        nfa.arcs[start].append((None, end))
        start = _build(nfa, part, start)
    nfa.arcs[start].append((None, end))
    return end


def _parse(pattern: str, any_case: bool):
    return _Parser(pattern, any_case).either()


class Dfa(NamedTuple):
    """``to[state * n_classes + classes[byte]]``; ``accepts[state]``: bits of the rules; state 0 is first."""

    to: np.ndarray
    classes: np.ndarray
    n_classes: int
    accepts: np.ndarray
    dead: int


def _classes(nfa: _Nfa) -> tuple[np.ndarray, list[int]]:
    """Classes of bytes that no arc tells apart, and one byte of each."""
    sets = sorted({s for arcs in nfa.arcs for s, _ in arcs if s is not None}, key=sorted)
    keys: dict[tuple[bool, ...], int] = {}
    classes = np.array([keys.setdefault(tuple(b in s for s in sets), len(keys)) for b in range(256)], np.int64)
    return classes, [int(np.flatnonzero(classes == k)[0]) for k in range(len(keys))]


def determine(nfa: _Nfa, starts: list[int], finals: dict[int, int]) -> Dfa:
    """Subset construction, then minimisation by refining the partition of states."""
    classes, samples = _classes(nfa)

    def closure(states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s, to in nfa.arcs[todo.pop()]:
                if s is None and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    first = closure(frozenset(starts))
    number, order, rows = {first: 0}, [first], []
    for now in order:
        row = []
        for b in samples:
            to = closure(frozenset(t for s in now for arc, t in nfa.arcs[s] if arc is not None and b in arc))
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    bits = np.zeros(len(order), np.int64)
    for states, i in number.items():
        for s in states:
            bits[i] |= finals.get(s, 0)
    to = np.array(rows, np.int64)
    _, block = np.unique(bits, return_inverse=True)
    while True:
        signature = np.column_stack([block, block[to]])
        _, finer = np.unique(signature, axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    # the first state gets number 0
    names = np.full(block.max() + 1, -1)
    names[block[0]] = 0
    rest = [b for b in range(len(names)) if b != block[0]]
    names[rest] = np.arange(1, len(names))
    block = names[block]
    some = np.zeros(len(names), np.int64)
    some[block] = np.arange(len(block))
    to, bits = block[to[some]], bits[some]
    stuck = [s for s in range(len(to)) if not bits[s] and (to[s] == s).all()]
    return Dfa(to.reshape(-1).astype(np.int64), classes, len(samples), bits, stuck[0] if stuck else -1)


class Scanner:
    """All rules in one automaton, and for each rule those of its prefix and its body."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        nfa = _Nfa()
        root = nfa.state()
        nfa.arcs[root].append((frozenset(range(256)), root))
        finals = {}
        for i, rule in enumerate(rules):
            end = _build(nfa, _parse(rule.prefix, rule.any_case), root)
            # a prefix and one more byte call for a closer look; without a prefix, the whole least body does
            trigger = 1 if rule.prefix else rule.least
            end = _build(nfa, ("times", _parse(rule.body, rule.any_case), trigger, trigger), end)
            finals[end] = 1 << i
        self.all = determine(nfa, [root], finals)
        self.prefix, self.body, self.begin = [], [], []
        for rule in rules:
            nfa = _Nfa()
            start = nfa.state()
            end = _build(nfa, _parse(rule.prefix, rule.any_case), start)
            self.prefix.append(determine(nfa, [start], {end: 1}))
            body = np.zeros(256, bool)
            body[list(_parse(rule.body, rule.any_case)[1][0][1][0][1])] = True
            self.body.append(body)
            p = self.prefix[-1]
            leads = p.to[p.classes] != p.dead if p.dead >= 0 else np.ones(256, bool)
            self.begin.append(leads | (body if p.accepts[0] else False))
        k = self.all.n_classes
        # one gather a byte: entries hold the next state's row, in a table over all 256 bytes
        self.table = (self.all.to.reshape(-1, k)[:, self.all.classes] * 256).astype(np.int32).reshape(-1)
        self.accepting = self.all.accepts != 0

    def accepted(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of the rules that accept anywhere in each row, after one pass over the bytes."""
        sizes = np.diff(offsets)
        blocks = -(-sizes // BLOCK)
        row = np.repeat(np.arange(len(sizes)), blocks)
        bits = np.zeros(len(sizes), np.int64)
        if not len(row):
            return bits
        nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = offsets[row] + nth * BLOCK
        size = np.minimum(offsets[row + 1] - begin, BLOCK)
        order = np.argsort(-size, kind="stable")
        row, begin, size, nth = row[order], begin[order], size[order], nth[order]
        trace = np.zeros((int(size[0]), len(row)), np.int32)
        state = np.zeros(len(row), np.int32)
        at = begin.copy()
        live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")
        for t, n in enumerate(live.tolist()):
            state = self.table[state[:n] + buf[at[:n]]]
            trace[t, :n] = state
            at += 1
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        last = trace[size - 1, np.arange(len(row))]
        # blocks whose predecessor ended elsewhere than in the first state, from left to right
        table, text = self.table, buf
        entry = np.zeros(len(row), np.int64)
        later = np.flatnonzero(nth > 0)
        for i in later[np.argsort(order[later], kind="stable")].tolist():
            entered = int(last[back[order[i] - 1]])
            if entered:
                entry[i] = entered
                s, a, n = entered, int(begin[i]), int(size[i])
                for t in range(n):
                    s = int(table[s + int(text[a + t])])
                    if trace[t, i] == s:
                        break
                    trace[t, i] = s
                else:
                    last[i] = s
        flags = self.accepting[trace >> 8]
        t, i = np.nonzero(flags)
        np.bitwise_or.at(bits, row[i], self.all.accepts[trace[t, i] >> 8])
        return bits

    def spans(self, data: bytes, bits: int) -> list[tuple[int, int, int]]:
        """Start, rule and end of each span in one text, in bytes, for the rules in ``bits``."""
        buf = np.frombuffer(data, np.uint8)
        out = []
        for r, rule in enumerate(self.rules):
            if not bits >> r & 1:
                continue
            inside = self.body[r][buf]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            run_end = edges[1::2]
            longest = _Longest(self.prefix[r], data)
            used = 0
            for start in np.flatnonzero(self.begin[r][buf]).tolist():
                if start < used:
                    continue
                at = longest(start)
                if at < 0 or at >= len(data) or not inside[at]:
                    continue
                end = int(run_end[np.searchsorted(run_end, at, "right")])
                used = end
                if end - at >= rule.least:
                    out.append((start, r, end))
        return sorted(out)


class _Longest:
    """Ends of the longest prefixes in one text, from any starts, in time linear in the text.

    Runs from different starts that meet in a state go on alike: at every ``STEP``-th byte
    the states are remembered with the end that was reached, so no stretch is walked twice
    in the same state. Starts are given from left to right.
    """

    STEP = 32

    def __init__(self, dfa: Dfa, data: bytes):
        self.rows = dfa.to.reshape(-1, dfa.n_classes)[:, dfa.classes].tolist()
        self.accepts, self.dead, self.data = dfa.accepts.tolist(), dfa.dead, data
        self.known: dict[tuple[int, int], int] = {}

    def __call__(self, start: int) -> int:
        rows, accepts, data, known = self.rows, self.accepts, self.data, self.known
        state, end, at = 0, start if self.accepts[0] else -1, start
        passed: list[tuple[int, int]] = []
        while at < len(data):
            state = rows[state][data[at]]
            at += 1
            if state == self.dead:
                break
            if accepts[state]:
                end = at
            if not at % self.STEP:
                met = known.get((at, state))
                if met is not None:
                    end = max(end, met)
                    break
                passed.append((at, state))
        for key in passed:
            known[key] = end if end >= key[0] else -1
        return end


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find_secrets(docs: DataFrame, more: tuple[Rule, ...] = MORE, column: str = "secrets") -> DataFrame:
    """``docs`` with ``column``: array of kind, start, end (code points, end exclusive) of each span.

    Null texts count as empty and have none. Rows are never grouped, so repeated rows
    give repeated results; an empty table gives no rows. A column of that name is
    replaced. Spans come by start, then by the rules' order; kinds may overlap. Texts of
    any length are scanned in time linear in them.
    """
    require(docs, ("text",))
    rules = BASE + more
    kept = docs.drop(column).withColumn("text", F.col("text").cast("string"))
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, data, found in _found(batch.column("text"), rules):
                if not data.isascii():
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                    found = [(int(points[a]), k, int(points[b])) for a, k, b in found]
                out[row] = [{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, spans_type)], names=[*batch.schema.names, column])

    return kept.mapInArrow(releasing(scan), with_columns(kept, f"`{column}` array<struct<kind:string,start:bigint,end:bigint>>"))


def _found(texts: pa.Array, rules: tuple[Rule, ...]) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]]]]:
    """Row, bytes and spans (start, rule, end, in bytes) of the texts in which some rule was accepted."""
    automaton = scanner(rules)
    buf, offsets = utf8(texts)
    for i, j in passes(offsets):
        bits = automaton.accepted(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for r in np.flatnonzero(bits).tolist():
            data = buf[offsets[i + r] : offsets[i + r + 1]].tobytes()
            if spans := automaton.spans(data, int(bits[r])):
                yield i + r, data, spans


def redact(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """``docs`` in its own columns, each secret replaced by ``<kind>``; n_chars, if there, counted anew.

    Null and empty texts and those without a secret stay as they are, repeated rows are
    rows of their own, an empty table stays empty. No other column is touched, whatever
    its name.
    """
    require(docs, ("text",))
    rules = BASE + more
    rows = docs.withColumn("text", F.col("text").cast("string"))

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = batch.schema.get_field_index("text"), None
            for row, data, spans in _found(batch.column(at), rules):
                texts = texts if texts is not None else batch.column(at).to_pylist()
                parts, last = [], 0
                for start, rule, end in spans:
                    # spans of several kinds may overlap: what an earlier span has taken is not taken again
                    if end > last:
                        parts += [data[last : max(start, last)], b"<", rules[rule].kind.encode(), b">"]
                        last = end
                texts[row] = b"".join([*parts, data[last:]]).decode("utf-8")
            columns = batch.columns if texts is None else [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    clean = rows.mapInArrow(releasing(replace), rows.schema)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in BASE]))
    kinds = F.transform("secrets", lambda s: s["kind"])
    counted = [F.size(F.array_remove(kinds, r.kind)) for r in BASE]
    counted = [(F.size("secrets") - left).cast("long").alias(f"n_{r.kind}") for left, r in zip(counted, BASE, strict=True)]
    return found.select("doc_id", *counted, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """Counts and digest of the base kinds by the regular expressions themselves."""
    import re

    text = text or ""
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    spans = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    rank = {"assign": 0, "access": 1, "hex": 2}
    spans.sort(key=lambda s: (s[1], rank[s[0]]))
    digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    return (*(sum(k == x for k, _, _ in spans) for x in rank), digest)
