"""Secrets by fixed patterns and a linear-chain conditional random field.

Every token of letters, digits and ``+/_=-`` is tagged begin, inside or outside from its shape, its neighbours and features of the
whole file; Viterbi chooses the tags. Other characters than blanks, full stops and colons can only be outside, which splits the
chain into runs; a run in which no token can gain by any tag is outside throughout and needs no decoding, which is exact. The
weights are fitted to a bounded sample of runs of the whole table, weighted by how often they occur and labelled by the fixed
patterns.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import nsmallest
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.flat import slices
from boxtrail.llm.pii import SPANS, log_sum, span_batch
from boxtrail.session import materialize, ship_package

KINDS = ("assign", "access", "hex", "secret")  # the last one: spans that only the model finds
TAGS = ("B", "I", "O")
SAMPLE_RUNS, EPOCHS, RATE, SHRINK = 800, 10, 0.3, 1e-3
LEAST_GAIN = 2.0
WORDS = ("password", "passwd", "secret", "token", "api_?key")

_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_ASSIGN = re.compile(rf"""({"|".join(map(_either, WORDS))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as dropping the shorter ones
_HINTS = ("passw", "secret", "token", "api")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+|[^\sA-Za-z0-9+/_=-]")
_WORD = re.compile(r"[A-Za-z0-9+/_=-]+")
_DIGITS = re.compile(r"[0-9a-fA-F]+")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]++(?:[\x20.:]++[A-Za-z0-9+/_=-]++)*+")
MOST_TOKENS = 20  # of a run in the sample; longer ones are cut into several
_PART = re.compile(_RUN.pattern.replace("*+", f"{{0,{MOST_TOKENS - 1}}}+"))
CUES = ("pass", "secret", "token", "key", "auth", "bearer", "cred")
STARTS = ("AKIA", "ghp_", "eyJh", "xoxb")
MARKS = ("=", ":", '"', "'", ";", *CUES)
_MARKED = re.compile(rf"""[=:"';]|{"|".join(CUES)}""", re.IGNORECASE)
NEAR = 8  # more than a mark is long
LEFT = 24  # characters before a token that its features read


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; an assignment's span is the whole match."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def variety(token: str) -> float:
    """Bits per character."""
    return entropy(tuple(map(token.count, dict.fromkeys(token))))


@lru_cache(1 << 14)
def entropy(counts: tuple[int, ...]) -> float:
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts)


def file_size(text: str) -> str:
    return "file short" if len(text) < 500 else "file long"


def described(text: str, a: int, b: int, size: str) -> list[tuple[int, int, list[str]]]:
    """The tokens between two places as (start, end, features)."""
    return [(*m.span(), features(text, *m.span(), size)) for m in _WORD.finditer(text, a, b)]


def runs(text: str) -> Iterator[list[tuple[int, int, list[str]]]]:
    """Runs of adjacent tokens, short and long, as (start, end, features); what stands between runs can only be outside."""
    size = file_size(text)
    for m in _RUN.finditer(text):
        yield described(text, *m.span(), size)


def measures(token: str) -> tuple[str, int, int, int, int, str]:
    """Kind, length, digits, capitals, variety and known start of a token, in steps."""
    n = len(token)
    digits, upper = (0, 0) if token.isalpha() and token.islower() else (sum(c.isdigit() for c in token), sum(c.isupper() for c in token))
    kind = "hex" if _DIGITS.fullmatch(token) else "alnum" if token.isalnum() else "mixed"
    return kind, min(n // 4, 12), round(4 * digits / n), round(4 * upper / n), round(2 * variety(token)), token[:4] if token[:4] in STARTS else "-"


def shape(token: str) -> list[str]:
    """Features of the token alone."""
    return measured(*measures(token))


def measured(kind: str, length: int, digits: int, upper: int, bits: int, starts: str) -> list[str]:
    return ["bias", f"kind {kind}", f"length {length}", f"digits {digits}", f"upper {upper}", f"bits {bits}", f"starts {starts}"]


short_shape = lru_cache(1 << 15)(shape)


def features(text: str, a: int, b: int, size: str) -> list[str]:
    return [*(short_shape if b - a <= 64 else shape)(text[a:b]), *placed(*around(text, a, b), size)]


def around(text: str, a: int, b: int) -> tuple[str, bool, bool, str]:
    """What stands before a token, whether it is assigned, whether a cue word is near, and what comes after it."""
    left = [x.lower() for x in _TOKEN.findall(text[max(0, a - LEFT) : a])][-3:]
    return (
        (left[-1] if len(left[-1]) == 1 else "word") if left else "none",
        any(x in ("=", ":") or x.endswith("=") for x in left[-2:]),
        any(h in w for w in left for h in CUES),
        following(text[b : b + 1]),
    )


def following(right: str) -> str:
    return right if right in ('"', "'", ".", ",", ";") else "space" if right.isspace() or not right else "other"


def marks(text: str) -> list[int]:
    """Where marks of an assignment, quotes and cue words begin, in order; of marks that overlap perhaps the first alone."""
    low = text.lower()
    if len(low) != len(text):  # a letter that lower case makes longer moves the places
        return [m.start() for m in _MARKED.finditer(text)]
    out = []
    for mark in MARKS:
        at = low.find(mark)
        while at >= 0:
            out.append(at)
            at = low.find(mark, at + 1)
    return sorted(out)


def placed(before: str, assigned: bool, cue: bool, after: str, size: str) -> list[str]:
    """Features of a token's place."""
    return [f"before {before}", f"assigned {assigned}", f"cue {cue}", f"after {after}", size]


class ChainModel:
    """Emission weights by (tag, feature) and transition weights by (tag, tag); outside starts and ends every run."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.weights = weights or {}
        self._reach: dict[bool, dict[str, float]] = {}
        self._own: dict[str, tuple[float, float]] = {}
        self._small: dict[tuple, tuple[float, float]] = {}

    def _sums(self, found: list[str]) -> tuple[float, float]:
        get = self.weights.get
        return sum(get(("B", x), 0.0) for x in found), sum(get(("I", x), 0.0) for x in found)

    def own(self, token: str) -> tuple[float, float]:
        """What the token alone adds to the emission of begin and inside."""
        known = self._own.get(token)
        if known is None:
            known = self._sum(measured, measures(token))
            if len(token) <= 64:
                if len(self._own) >= 1 << 16:
                    self._own.clear()
                self._own[token] = known
        return known

    def _sum(self, made, key: tuple) -> tuple[float, float]:
        """``_sums`` of the features made from a key of small values."""
        found = self._small.get(key)
        if found is None:
            if len(self._small) >= 1 << 16:
                self._small.clear()
            found = self._small[key] = self._sums(made(*key))
        return found

    def emissions(self, text: str, start: int, end: int, size: str, plain: bool) -> Iterator[tuple[int, int, float, float]]:
        """(start, end, begin, inside) of the tokens between two places: the emissions of these tags; outside has none."""
        last = None
        for m in _WORD.finditer(text, start, end):
            a, b = m.span()
            if plain and last is not None and a - last[1] < LEFT - 1:
                # Without marks only blanks and full stops stand between two tokens, and no cue is near.
                before = "." if "." in text[last[1] : a] else text[last[0]].lower() if last[1] - last[0] == 1 else "word"
                place = (before, False, False, following(text[b : b + 1]), size)
            else:
                place = (*around(text, a, b), size)
            (x, y), (u, v) = self.own(m[0]), self._sum(placed, place)
            yield a, b, x + u, y + v
            last = a, b

    def quiet(self, tokens: list[str], plain: bool) -> bool:
        """Whether outside throughout is the one best tagging of a run of these tokens, whatever stands around them.

        A token that is not outside takes part in two steps. When even its best emission and the best steps lose against outside,
        for every token, any other tagging loses. ``plain``: no mark of an assignment, no quote and no cue word stands near.
        """
        reach = self._reach.get(plain) or self._reach.setdefault(plain, self._most(plain))
        begin, inside = -reach["B"], -reach["I"]
        for token in tokens:
            own = self.own(token)
            if not (own[0] < begin and own[1] < inside):
                return False
        return True

    def _most(self, plain: bool) -> dict[str, float]:
        """Per tag the most that a token's surroundings, the file and its two steps can add to its emission."""
        steps = [self.step(s, t) for s in TAGS for t in TAGS if (s, t) != ("O", "I")]
        gain = 2 * max(0.0, max(steps) - self.step("O", "O")) + 1e-9
        out = {}
        for t in ("B", "I"):
            best: dict[str, float] = defaultdict(float)  # a feature that was never seen weighs nothing
            for (tag, x), w in self.weights.items():
                group, _, value = x.partition(" ")
                if tag != t or group not in ("before", "assigned", "cue", "after", "file"):
                    continue
                if plain and (value == "True" or group in ("before", "after") and value in ("=", ":", '"', "'", ";")):
                    continue
                best[group] = w if plain and value == "False" else max(best[group], w)
            out[t] = sum(best.values()) + gain
        return out

    def tables(self, run: list[tuple[int, int, list[str]]]) -> list[dict[str, float]]:
        get = self.weights.get
        return [{t: sum(get((t, x), 0.0) for x in found) if t != "O" else 0.0 for t in TAGS} for _, _, found in run]

    def step(self, a: str, b: str) -> float:
        return -1e9 if a == "O" and b == "I" else self.weights.get(("step", a + b), 0.0)

    def decode(self, run: list[tuple[int, int, list[str]]]) -> list[tuple[int, int, float]]:
        """Viterbi spans (start, end, mean gain over outside)."""
        return self.best([(a, b, *self._sums(found)) for a, b, found in run])

    def best(self, run: list[tuple[int, int, float, float]]) -> list[tuple[int, int, float]]:
        """``decode`` from the emissions: (start, end, begin, inside) of each token."""
        if not self.weights:
            return []
        (bb, bi, bo), (ib, ii, io), (ob, oi, oo) = ([self.step(s, t) for t in TAGS] for s in TAGS)
        b, i, o = -math.inf, -math.inf, 0.0
        back = []
        for _, _, begin, inside in run:
            hb, nb, x, y = "B", b + bb + begin, i + ib + begin, o + ob + begin
            if x > nb:
                hb, nb = "I", x
            if y > nb:
                hb, nb = "O", y
            hi, ni, x, y = "B", b + bi + inside, i + ii + inside, o + oi + inside
            if x > ni:
                hi, ni = "I", x
            if y > ni:
                hi, ni = "O", y
            ho, no, x, y = "B", b + bo, i + io, o + oo
            if x > no:
                ho, no = "I", x
            if y > no:
                ho, no = "O", y
            b, i, o = nb, ni, no
            back.append((hb, hi, ho))
        tag, top = "B", b + bo
        if i + io > top:
            tag, top = "I", i + io
        if o + oo > top:
            tag = "O"
        tags = []
        for how in reversed(back):
            tags.append(tag)
            tag = how[TAGS.index(tag)]
        tags.reverse()
        out: list[list] = []
        for (start, end, begin, inside), t in zip(run, tags, strict=True):
            if t == "B":
                out.append([start, end, [begin]])
            elif t == "I":
                out[-1][1] = end
                out[-1][2].append(inside)
        return [(start, end, sum(g) / len(g)) for start, end, g in out]

    def fit(self, data: list[list[tuple[list[str], str]]], counts: list[float] | None = None) -> ChainModel:
        """Maximum likelihood by adaptive gradient steps over runs of (features, tag), each as often as its count says."""
        weights: dict[tuple[str, str], float] = defaultdict(float)
        squares: dict[tuple[str, str], float] = defaultdict(float)
        self.weights = weights
        for _ in range(EPOCHS):
            for run, times in zip(data, counts or [1.0] * len(data), strict=True):
                emit = self.tables([(0, 0, found) for found, _ in run])
                n = len(run)
                fwd = [{"O": 0.0}]
                for row in emit:
                    fwd.append({t: log_sum([v + self.step(s, t) + row[t] for s, v in fwd[-1].items()]) for t in TAGS})
                bwd = [{t: self.step(t, "O") for t in TAGS}]
                for k in range(n - 1, 0, -1):
                    bwd.append({s: log_sum([self.step(s, t) + emit[k][t] + bwd[-1][t] for t in TAGS]) for s in TAGS})
                bwd.reverse()
                total = log_sum([fwd[n][t] + bwd[n - 1][t] for t in TAGS])
                grad: dict[tuple[str, str], float] = defaultdict(float)
                before = "O"
                for k, (found, gold) in enumerate(run):
                    for t in ("B", "I"):
                        g = (gold == t) - math.exp(fwd[k + 1][t] + bwd[k][t] - total)
                        for x in found:
                            grad[t, x] += g
                    grad["step", before + gold] += 1
                    for s, v in fwd[k].items():
                        for t in TAGS:
                            grad["step", s + t] -= math.exp(v + self.step(s, t) + emit[k][t] + bwd[k][t] - total)
                    before = gold
                grad["step", before + "O"] += 1
                for t in TAGS:
                    grad["step", t + "O"] -= math.exp(fwd[n][t] + bwd[n - 1][t] - total)
                for x, g in grad.items():
                    g = times * g - SHRINK * weights[x]
                    squares[x] += g * g
                    weights[x] += RATE * g / math.sqrt(squares[x] + 1e-8)
        return ChainModel(dict(weights))


def labelled_run(run: list[tuple[int, int, list[str]]], base: list[tuple[str, int, int]]) -> list[tuple[list[str], str]]:
    """Tags of a run: the first token that ends inside a fixed span begins it, later ones go on."""
    out, inside = [], None
    for a, b, found in run:
        span = next(((x, y) for _, x, y in base if x < b <= y or x <= a < y), None)
        out.append((found, "O" if span is None else "I" if span == inside else "B"))
        inside = span
    return out


def sample_runs(documents: DataFrame, text: str, limit: int) -> list[tuple[list[tuple[list[str], str]], int]]:
    """At most ``limit`` distinct labelled runs, cut to ``MOST_TOKENS`` tokens, and how often each occurs in the whole table.

    Runs that hold a secret and runs that hold none share the places. Those with a secret are drawn in hash order of their
    distinct labelled rows, the others in hash order of their distinct texts, so repeats add to a run's count and take no place.
    A task keeps the ``limit`` first of the others, whose counts are whole, and describes only those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others: Counter[tuple[int, str, int, int, str]] = Counter()
        for batch in batches:
            for part in slices(batch, 0):
                seen: Counter[str] = Counter()
                fresh: Counter[tuple[str, int, int, str]] = Counter()
                for t in part.column(0).to_pylist():
                    t = t or ""
                    base, size = base_spans(t), file_size(t)
                    for m in _PART.finditer(t):
                        a, b = m.span()
                        if base and any(x < b and a < y for _, x, y in base):
                            row = labelled_run(described(t, a, b, size), base)
                            if any(g != "O" for _, g in row):
                                seen[json.dumps(row)] += 1
                                continue
                        start = max(0, a - LEFT)
                        fresh[t[start : b + 1], a - start, b - start, size] += 1
                others.update({(crc32(repr(k).encode()), *k): n for k, n in fresh.items()})
                if len(others) > limit:
                    others = Counter(dict(nsmallest(limit, others.items(), key=lambda x: x[0])))
                yield sample_batch([(True, row, 0, n) for row, n in seen.items()])
        rows = [(False, json.dumps(labelled_run(described(*k), [])), h, n) for (h, *k), n in others.items()]
        yield sample_batch(rows)

    found = documents.select(documents[text].alias("text")).mapInArrow(run, "secret boolean, run string, h long, n long")
    found = materialize(found.groupBy("secret", "run", "h").agg(F.sum("n").alias("n")))
    secret = found.where("secret").orderBy(F.xxhash64("run"), "run").limit(limit).collect()
    plain: Counter[str] = Counter()
    for r in found.where("not secret").orderBy("h", "run").limit(limit).collect():
        plain[r["run"]] += r["n"]
    sides = [[(r["run"], r["n"]) for r in secret], list(plain.items())]
    places = [min(len(side), max(limit // 2, limit - len(other))) for side, other in (sides, sides[::-1])]
    return [([(f, g) for f, g in json.loads(row)], n) for side, k in zip(sides, places, strict=True) for row, n in side[:k]]


def sample_batch(rows: list[tuple[bool, str, int, int]]) -> pa.RecordBatch:
    kinds = {"secret": pa.bool_(), "run": pa.string(), "h": pa.int64(), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def train(documents: DataFrame, text: str = "text", limit: int = SAMPLE_RUNS) -> ChainModel:
    """Fit on a sample bounded by ``limit``; an empty table gives a model that adds nothing.

    Counts are taken in proportion to their mean among the runs with or without a secret, so ordinary words do not drown secrets.
    """
    ship_package(documents.sparkSession)
    sample = sample_runs(documents, text, limit)
    secret = [any(g != "O" for _, g in run) for run, _ in sample]
    mean = {side: sum(n for (_, n), x in zip(sample, secret, strict=True) if x == side) / max(1, secret.count(side)) for side in (True, False)}
    order = sorted(range(len(sample)), key=lambda k: crc32(json.dumps(sample[k][0]).encode()))
    return ChainModel().fit([sample[k][0] for k in order], [sample[k][1] / mean[secret[k]] for k in order])


def all_spans(text: str, model: ChainModel, least_gain: float = LEAST_GAIN) -> list[tuple[str, int, int, bool]]:
    """Fixed-pattern spans and the model's further ones (kind ``secret``), by start, then kind as listed."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    size, marked = file_size(text), marks(text) if model.weights else []
    for m in _RUN.finditer(text) if model.weights else ():
        start, end = m.span()
        near = bisect_left(marked, start - LEFT - NEAR) if marked else 0
        plain = near == len(marked) or marked[near] > end + NEAR
        if model.quiet(_WORD.findall(m[0]), plain):
            continue
        for a, b, gain in model.best(list(model.emissions(text, start, end, size, plain))):
            if gain >= least_gain and all(b <= x or a >= y for _, x, y in base):
                out.append(("secret", a, b, False))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(documents: DataFrame, model: ChainModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key and ``spans`` (kind, start, end in code points, base), by start, then kind.

    Null and empty texts have no spans; repeated rows give repeated rows; other columns are not read.
    """
    ship_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield span_batch(part.column("key"), [all_spans(t or "", model) for t in part.column("text").to_pylist()])

    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("key", key)
