"""Secret scans: fixed patterns label credentials, automata learnt from these score all other candidates.

Labelled credentials and a background of other tokens are read as strings of symbols: the first characters as they
are, for issuers' prefixes, the others by class. The states of a kind's automaton are what a string's last symbols are
(its last character and place at the beginning, its last three classes behind), so the automaton of all strings is a
table of counts whose size depends on the symbols alone, and Spark counts it over every distinct string of the table.
States are merged where their continuations are statistically compatible (Hoeffding bound). A candidate's score is the
mean over its symbols of the log likelihood under the best kind less that under the background.

The background must not hold credentials that nobody labelled, however many leak. It consists of ordinary tokens, too
short to be a credential, and of those long tokens that the kinds explain no better than an automaton of ordinary tokens
does. The threshold is set on background tokens that no automaton has seen, so it depends neither on how many
credentials there are nor on the other texts' scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, ship

#: Fixed values of the contract: kinds, their patterns and the least length of a match (of group 2 for assign).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
#: The kind of the spans that the method adds.
LEARNT = "learnt"
#: Candidates: runs of credential characters of this length. The gain over the background rejects plain words and numbers.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Characters of a string, and classes of those behind the first PREFIX: digits, a-f, other lower-case, upper-case, the others as they are.
LETTERS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_.=-"
PREFIX, CLASSES = 4, 10
#: Confidence of the Hoeffding test.
ALPHA = 0.05
#: Probabilities are mixed with this share of an even one over so many symbols, so that nothing is impossible.
MIX, SYMBOLS = 0.1, 32
#: Least gain over the background, in nats a symbol.
LEAST_GAIN = 0.75
BACKGROUND, ORDINARY = "background", "ordinary"
#: Tokens of the background: long ones, and ordinary ones, which are shorter.
TOKEN, LONG = re.compile(r"[A-Za-z0-9+/_.=-]{6,}"), 12
#: The share of unseen background tokens that may score above the threshold.
FALSE_ALARMS = 0.005
#: Gains are counted in steps of this many nats when the threshold is set.
STEP = 1e-4
#: Distinct strings that a task keeps before it hands them on.
HELD = 200_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind; matches that are too short are dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, string) of the candidates that overlap no base span; dots and dashes at the end don't count."""
    i = 0
    for m in CANDIDATE.finditer(text):
        s = m[0].rstrip(".=-/_")
        start, end = m.start(), m.start() + len(s)
        while i < len(base) and base[i][2] <= start:
            i += 1
        if len(s) >= 16 and not any(b[0] < end and b[2] > start for b in base[i : i + 8]):
            yield start, end, s


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """By byte: the character's number, and its class."""
    char, kind = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for i, c in enumerate(LETTERS):
        char[ord(c)] = i
        kind[ord(c)] = 0 if c.isdigit() else 1 if c in "abcdef" else 2 if c.islower() else 3 if c.isupper() else 4 + i - LETTERS.index("+")
    return char, kind


_CHAR, _CLASS = _codes()
#: States: none read; the last of one to PREFIX characters; the last one, two and three classes behind them. Symbols: characters, and the end.
END = len(LETTERS)
_BEHIND = 1 + PREFIX * END
STATES, WIDTH = _BEHIND + CLASSES + CLASSES**2 + CLASSES**3, END + 1
#: Steps that are looked at together, which bounds memory for long strings; symbols that a state depends on.
PIECE, BEFORE = 1 << 18, 3


def cells(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of ASCII strings that are not empty, one after another and PIECE steps at a time: state * WIDTH + symbol of each step, the end's included; and which string it belongs to."""
    sizes = np.array([len(s) for s in strings], np.int64) + 1
    begin = np.cumsum(sizes) - sizes
    raw = np.frombuffer(("\0" * BEFORE + "\0".join(strings) + "\0").encode("ascii", "replace"), np.uint8)
    for lo in range(0, len(raw) - BEFORE, PIECE):
        read = raw[lo : lo + PIECE + BEFORE]
        back = lambda codes, n: codes[read[BEFORE - n : len(read) - n]]  # noqa: B023, E731
        step = np.arange(lo, lo + len(read) - BEFORE)
        owner = np.searchsorted(begin, step, "right") - 1
        at = step - begin[owner]
        one, two, three = (back(_CLASS, n) for n in (1, 2, 3))
        state = np.select(
            [at == 0, at <= PREFIX, at == PREFIX + 1, at == PREFIX + 2],
            [0, 1 + (at - 1) * END + back(_CHAR, 1), _BEHIND + one, _BEHIND + CLASSES + two * CLASSES + one],
            _BEHIND + CLASSES + CLASSES**2 + (three * CLASSES + two) * CLASSES + one,
        )
        symbol = np.where(read[BEFORE:] == 0, END, np.where(at < PREFIX, back(_CHAR, 0), back(_CLASS, 0)))
        yield state * WIDTH + symbol, owner


def tallied(strings: list[str]) -> np.ndarray:
    """How often each state meets each symbol."""
    return sum((np.bincount(at, minlength=STATES * WIDTH) for at, _ in cells(strings)), np.zeros(STATES * WIDTH, np.int64))


def _following() -> np.ndarray:
    """By state and symbol: the next state."""
    out = np.zeros((STATES, WIDTH), np.int64)
    for x in range(END):
        for i in range(PREFIX):
            out[0 if i == 0 else slice(1 + (i - 1) * END, 1 + i * END), x] = 1 + i * END + x
    two, three = _BEHIND + CLASSES, _BEHIND + CLASSES + CLASSES**2
    for x in range(CLASSES):
        out[_BEHIND - END : _BEHIND, x] = _BEHIND + x
        out[_BEHIND:two, x] = two + np.arange(CLASSES) * CLASSES + x
        out[two:three, x] = three + np.arange(CLASSES**2) * CLASSES + x
        out[three:, x] = three + np.arange(CLASSES**3) % CLASSES**2 * CLASSES + x
    return out


class Automaton:
    """A probabilistic automaton: by state and symbol, the log of the symbol's smoothed probability among the state and those merged with it."""

    def __init__(self, counts: np.ndarray):
        self.logs = np.log((1 - MIX) * self._merged(counts.reshape(STATES, WIDTH).astype(np.float64)) + MIX / SYMBOLS)
        self.logs[:, END] = 0.0

    @staticmethod
    def _differ(share: np.ndarray, n: np.ndarray, p: int, others: np.ndarray) -> np.ndarray:
        """Which of the others have an ending or next symbol that tells them apart from p."""
        bound = (1 / np.sqrt(n[p]) + 1 / np.sqrt(n[others])) * math.sqrt(0.5 * math.log(2 / ALPHA))
        return (np.abs(share[others] - share[p]) > bound[:, None]).any(axis=1)

    @classmethod
    def _merged(cls, counts: np.ndarray) -> np.ndarray:
        """Shares of symbols in merged states. The states of a length, and all behind the prefix, go by how many strings pass; each merges into the first settled one that neither it nor what follows tells apart, or settles. States that nothing passes take the first one's shares."""
        n, out, following = counts.sum(axis=1), np.zeros_like(counts), _following()
        share = counts / np.maximum(n, 1)[:, None]
        for first, last in [(0, 1), *((1 + i * END, 1 + (i + 1) * END) for i in range(PREFIX - 1)), (_BEHIND - END, STATES)]:
            order = first + np.argsort(-n[first:last], kind="stable")
            settled: list[int] = []
            block = {}
            for p in order[n[order] > 0].tolist():
                near = np.array(settled, np.int64)
                same = near[~cls._differ(share, n, p, near)] if settled else near
                block[p] = next((q for q in same.tolist() if cls._alike(share, n, following, p, q)), p)
                if block[p] == p:
                    settled.append(p)
            if not settled:
                continue
            total = np.zeros_like(counts)
            for p, q in block.items():
                total[q] += counts[p]
            total /= np.maximum(total.sum(axis=1), 1)[:, None]
            for p in order.tolist():
                out[p] = total[block.get(p, settled[0])]
        return out

    @classmethod
    def _alike(cls, share: np.ndarray, n: np.ndarray, following: np.ndarray, p: int, q: int) -> bool:
        """Whether nothing after p and q tells them apart; after the same three classes both are in one state."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            for x in np.flatnonzero((share[p, :END] > 0) & (share[q, :END] > 0)).tolist():
                a, b = int(following[p, x]), int(following[q, x])
                if a != b and n[a] and n[b]:
                    if cls._differ(share, n, a, np.array([b]))[0]:
                        return False
                    todo.append((a, b))
        return True


def infer(strings: list[str]) -> Automaton:
    """The automaton of some strings, the same for any order of them."""
    return Automaton(tallied(strings))


class Model:
    """An automaton for each kind that has labelled credentials, one for the background, and the threshold."""

    def __init__(self, kinds: dict[str, Automaton], background: Automaton | None, threshold: float):
        self.kinds, self.background, self.threshold = kinds, background, threshold
        plain = background.logs if background else np.full((STATES, WIDTH), -math.log(16)) * (np.arange(WIDTH) < END)
        self.tables = [(a.logs - plain).ravel() for a in kinds.values()]

    def gains(self, strings: list[str]) -> np.ndarray:
        """Nats a symbol by which the best kind explains each string better than the background; minus infinity if there is none."""
        if not self.kinds or not strings:
            return np.full(len(strings), -np.inf)
        total = np.zeros((len(self.tables), len(strings)))
        for at, owner in cells(strings):
            for i, t in enumerate(self.tables):
                total[i] += np.bincount(owner, t[at], len(strings))
        return total.max(axis=0) / np.array([len(s) for s in strings])

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, kind, end) of all spans; kind 3 is what the automata add."""
        if not text:
            return []
        base = base_spans(text)
        more = list(candidates(text, base)) if self.kinds else []
        return sorted(base + [(a, 3, b) for (a, b, _), gain in zip(more, self.gains([s for *_, s in more]), strict=True) if gain >= self.threshold])


def labelled(docs: DataFrame) -> DataFrame:
    """(kind, string, half): all distinct strings of each kind over all texts, each in one of two halves by its hash. Background and ordinary strings are tokens outside the base spans."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, set[str]] = {k: set() for k in (*KINDS, BACKGROUND, ORDINARY)}

        def rows() -> Iterator[pa.RecordBatch]:
            for k, strings in found.items():
                if strings:
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(strings), pa.string()), pa.array(list(strings), pa.string())], ["kind", "string"])
                    strings.clear()

        for b in batches:
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                base = base_spans(text)
                for start, kind, end in base:
                    found[KINDS[kind]].add(ASSIGN.match(text, start, end)[2] if kind == 0 else text[start:end])
                spans = iter(base)
                near = next(spans, None)
                for m in TOKEN.finditer(text):
                    while near and near[2] <= m.start():
                        near = next(spans, None)
                    if not (near and near[0] < m.end()):
                        found[BACKGROUND if m.end() - m.start() >= LONG else ORDINARY].add(m[0])
            if sum(map(len, found.values())) > HELD:
                yield from rows()
        yield from rows()

    each = docs.select("text").mapInArrow(run, "kind string, string string").distinct()
    return cut(each.withColumn("half", F.pmod(F.xxhash64("string"), F.lit(2)).cast("int")), "credentials")


def counted(strings: DataFrame, plain: Model | None = None) -> dict[tuple[str, int], np.ndarray]:
    """By kind and half: how often each state meets each symbol over all strings, or over those that the model `plain` gives no gain. What is collected depends on the symbols, not on the strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for key, some in _by_kind(batches, plain):
            n = tallied(some)
            sums[key] = sums[key] + n if key in sums else n
        for (kind, half), n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array([half] * len(at), pa.int32()), pa.array(at), pa.array(n[at])], ["kind", "half", "cell", "n"])

    out: dict[tuple[str, int], np.ndarray] = {}
    for kind, half, cell, n in strings.mapInArrow(run, "kind string, half int, cell long, n long").groupBy("kind", "half", "cell").agg(F.sum("n").alias("n")).collect():
        out.setdefault((kind, half), np.zeros(STATES * WIDTH, np.int64))[cell] = n
    return out


def _by_kind(batches: Iterable[pa.RecordBatch], plain: Model | None) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """((kind, half), strings) of batches of labelled; of long background tokens only those that the model gives no gain."""
    for b in batches:
        groups: dict[tuple[str, int], list[str]] = {}
        for kind, s, half in zip(*(c.to_pylist() for c in b.columns), strict=True):
            groups.setdefault((kind, half), []).append(s)
        for (kind, half), some in groups.items():
            if plain and kind == BACKGROUND:
                some = [s for s, gain in zip(some, plain.gains(some).tolist(), strict=True) if gain < LEAST_GAIN]
            if some:
                yield (kind, half), some


def threshold(strings: DataFrame, plain: Model, model: Model) -> float:
    """The least gain that only FALSE_ALARMS of all plain strings exceed, LEAST_GAIN at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in _by_kind(batches, plain):
            gains = model.gains(some)
            step, n = np.unique(np.floor(np.maximum(gains, LEAST_GAIN) / STEP).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n)], ["step", "n"])

    steps = sorted(strings.mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect(), reverse=True)
    allowed = FALSE_ALARMS * sum(r["n"] for r in steps)
    for r in steps:
        allowed -= r["n"]
        if allowed < 0:
            return max(LEAST_GAIN, (r["step"] + 1) * STEP)
    return LEAST_GAIN


def fit(docs: DataFrame) -> Model:
    """Automata of all credentials that the base patterns label, and of the background without what they explain.

    Long background tokens that the kinds explain better than ordinary tokens do, by LEAST_GAIN, are taken for credentials
    and left out; of what remains one half makes the background's automaton and the other sets the threshold.
    """
    strings = labelled(docs)
    long = F.col("kind") == BACKGROUND
    n = counted(strings.where(~long))
    of = lambda *keys: sum((n[k] for k in keys if k in n), np.zeros(STATES * WIDTH, np.int64))
    known = {k: of((k, 0), (k, 1)) for k in sorted(KINDS)}
    kinds = {k: Automaton(c) for k, c in known.items() if c.any()}
    if not kinds:
        return Model({}, None, LEAST_GAIN)
    ordinary = of((ORDINARY, 0), (ORDINARY, 1))
    first = Model(kinds, Automaton(ordinary) if ordinary.any() else None, LEAST_GAIN)
    n |= counted(strings.where(long & (F.col("half") == 0)), first)
    plain = of((ORDINARY, 0), (BACKGROUND, 0))
    model = Model(kinds, Automaton(plain) if plain.any() else None, LEAST_GAIN)
    model.threshold = threshold(strings.where(F.col("kind").isin(BACKGROUND, ORDINARY) & (F.col("half") == 1)), first, model)
    return model


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: (doc_id, found array<struct<start, kind, end>>), code points, ends exclusive.

    Null and empty texts have no spans; an empty table gives no rows; a table without credentials adds none to the base.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"start": s, "kind": k, "end": e} for s, k, e in shared.value.spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, found array<struct<start: long, kind: int, end: long>>")
