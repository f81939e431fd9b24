"""Personal data by fixed patterns and a semi-Markov conditional random field.

Text with a digit or an at sign is cut into islands (runs of such words) and each island into pieces. A candidate segment is a
run of at most ``LONGEST`` pieces; its score comes from features of the whole span: shape, digit count, check sum, octets,
boundaries, cue word. Dynamic programming over bounded segments chooses boundaries and types together. Pieces outside islands
cannot belong to a segment, so decoding islands alone is exact.

The weights are fitted to a bounded sample of islands, drawn by hash order and labelled by the fixed patterns.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.flat import slices
from boxtrail.session import ship_package

KINDS = ("email", "ip", "card", "phone")
LONGEST = 20
SAMPLE_ISLANDS, EPOCHS, RATE, SHRINK = 800, 8, 0.3, 1e-3
LEAST_GAIN = 2.0
CUES = ("phone", "tel", "call", "fax", "mobile", "email", "mail", "contact", "card", "visa", "ip", "host", "server")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does, as all of the run must stand before the dot: linear in long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]+")
_PIECE = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_SHAPE_DIGITS, _SHAPE_LETTERS = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[\s:=]*\Z")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The pattern's matches, found from each at sign: its local part reaches back to the last match or foreign character."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            last = match.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start, in code points."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def islands(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, cue): maximal runs of words with a digit or an at sign, and the cue word before them."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        a, b = m.start(), m.end()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if start >= 0 and a - end <= 1:
            end = b
            continue
        if start >= 0:
            yield start, end, cue(text, start)
        start, end = a, b
    if start >= 0:
        yield start, end, cue(text, start)


def cue(text: str, at: int) -> str:
    m = _WORD_BEFORE.search(text[max(0, at - 24) : at])
    return m[1].lower() if m and m[1].lower() in CUES else ""


def candidates(text: str, before: str) -> tuple[list[tuple[int, int]], list[list[tuple[int, list[str]]]]]:
    """Pieces of an island, and per end piece the (start piece, features) of all segments that could be personal data.

    A segment holds an at sign or at least seven digits; others score minus infinity.
    """
    pieces = [m.span() for m in _PIECE.finditer(text)]
    digits, signs = [0], [0]
    for a, b in pieces:
        digits.append(digits[-1] + (b - a if "0" <= text[a] <= "9" else 0))
        signs.append(signs[-1] + (text[a] == "@"))
    ends: list[list[tuple[int, list[str]]]] = []
    for j in range(1, len(pieces) + 1):
        own = []
        for i in range(j - 1, max(-1, j - 1 - LONGEST), -1):
            if digits[j] - digits[i] >= 7 or signs[j] > signs[i] or (digits[j] - digits[i] >= 4 and text.count(".", pieces[i][0], pieces[j - 1][1]) >= 3):
                own.append((i, features(text, pieces[i][0], pieces[j - 1][1], digits[j] - digits[i], before if i == 0 else "")))
        ends.append(own)
    return pieces, ends


def features(text: str, a: int, b: int, n_digits: int, before: str) -> list[str]:
    span = text[a:b]
    shape = _SHAPE_LETTERS.sub("a", _SHAPE_DIGITS.sub("9", span))
    out = ["bias", f"shape {shape}" if len(shape) <= 24 else "shape long", f"digits {min(n_digits, 20)}", f"cue {before}"]
    out.append("left " + edge(text, a - 1))
    out.append("right " + edge(text, b))
    if 13 <= n_digits <= 19 and "9" in shape and not _SHAPE_LETTERS.search(span):
        out.append(f"check {luhn(''.join(_DIGIT.findall(span)))}")
    if shape == "9.9.9.9":
        out.append(f"octets {all(len(p) <= 3 and int(p) <= 255 for p in span.split('.'))}")
    if "@" in span:
        m = _DOMAIN.search(span)
        out.append(f"mail {bool(m) and m.end() == len(span) and bool(_LOCAL_END.match(span[: m.start()]))}")
    if span[0] in "+(":
        out.append(f"opens {span[0]}")
    return out


def edge(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "none"
    c = text[at]
    return "space" if c.isspace() else "word" if c.isalnum() or c in "@_" else c if c in ".-+()" else "mark"


class SegmentModel:
    """Weights by (kind, feature); a feature that was never seen weighs nothing."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.weights = weights or {}

    def score(self, kind: str, found: list[str]) -> float:
        get = self.weights.get
        return sum(get((kind, x), 0.0) for x in found)

    def decode(self, text: str, before: str = "") -> list[tuple[str, int, int, float]]:
        """Best segmentation as (kind, start, end, gain over leaving the span out)."""
        if not self.weights:
            return []
        pieces, ends = candidates(text, before)
        best, back = [0.0], []
        for j, own in enumerate(ends, 1):
            top, how = best[j - 1], None
            for i, found in own:
                for kind in KINDS:
                    s = self.score(kind, found)
                    if best[i] + s > top:
                        top, how = best[i] + s, (i, kind, s)
            best.append(top)
            back.append(how)
        out, j = [], len(pieces)
        while j:
            how = back[j - 1]
            if how is None:
                j -= 1
            else:
                out.append((how[1], pieces[how[0]][0], pieces[j - 1][1], how[2]))
                j = how[0]
        return out[::-1]

    def fit(self, islands_: list[tuple[str, str]]) -> SegmentModel:
        """Maximum likelihood by adaptive gradient steps; gold segments are the fixed patterns' spans."""
        weights: dict[tuple[str, str], float] = defaultdict(float)
        squares: dict[tuple[str, str], float] = defaultdict(float)
        data = []
        for text, before in islands_:
            pieces, ends = candidates(text, before)
            if len(pieces) > 200:
                continue  # fitted on short islands; decoding has no such bound
            start, end = {a: k for k, (a, _) in enumerate(pieces)}, {b: k + 1 for k, (_, b) in enumerate(pieces)}
            gold, used = {}, []
            for kind, a, b in base_spans(text):
                if a in start and b in end and all(b <= c or a >= d for c, d in used):
                    gold[start[a], end[b]] = kind
                    used.append((a, b))
            data.append((ends, gold))
        for _ in range(EPOCHS):
            for ends, gold in data:
                n = len(ends)
                scores = [[(i, k, sum(weights[k, x] for x in found), found) for i, found in own for k in KINDS] for own in ends]
                fwd = [0.0]
                for j in range(n):
                    fwd.append(log_sum([fwd[j], *(fwd[i] + s for i, _, s, _ in scores[j])]))
                out_of = [[] for _ in range(n)]
                for j in range(n):
                    for i, _, s, _ in scores[j]:
                        out_of[i].append((j + 1, s))
                bwd = [0.0] * (n + 1)
                for i in range(n - 1, -1, -1):
                    bwd[i] = log_sum([bwd[i + 1], *(s + bwd[j] for j, s in out_of[i])])
                grad: dict[tuple[str, str], float] = defaultdict(float)
                for j in range(n):
                    for i, k, s, found in scores[j]:
                        g = (gold.get((i, j + 1)) == k) - math.exp(fwd[i] + s + bwd[j + 1] - fwd[n])
                        if abs(g) > 1e-6:
                            for x in found:
                                grad[k, x] += g
                for x, g in grad.items():
                    g -= SHRINK * weights[x]
                    squares[x] += g * g
                    weights[x] += RATE * g / math.sqrt(squares[x] + 1e-8)
        return SegmentModel(dict(weights))


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def sample_islands(documents: DataFrame, text: str, limit: int) -> list[tuple[str, str]]:
    """At most ``limit`` islands of at most 400 characters from the whole table, in hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                rows = [(t[a:b], before) for t in part.column(0).to_pylist() if t for a, b, before in islands(t) if b - a <= 400]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["island", "cue"])

    found = documents.select(documents[text].alias("text")).mapInArrow(run, "island string, cue string")
    return [(r[0], r[1]) for r in found.orderBy(F.xxhash64("island", "cue"), "island", "cue").limit(limit).collect()]


def train(documents: DataFrame, text: str = "text", limit: int = SAMPLE_ISLANDS) -> SegmentModel:
    """Fit on a sample bounded by ``limit``; an empty table gives a model that adds nothing."""
    ship_package(documents.sparkSession)
    return SegmentModel().fit(sample_islands(documents, text, limit))


def all_spans(text: str, model: SegmentModel, least_gain: float = LEAST_GAIN) -> list[tuple[str, int, int, bool]]:
    """Fixed-pattern spans and the model's further ones, by kind as listed, then start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    out = [(*s, True) for s in base]
    for a, b, before in islands(text):
        for kind, x, y, gain in model.decode(text[a:b], before):
            if gain >= least_gain and all(a + y <= c or a + x >= d for c, d in taken if c < b and d > a):
                out.append((kind, a + x, a + y, False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def mask_text(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """Each run of overlapping spans becomes the name of the kind that starts first."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_pii(documents: DataFrame, model: SegmentModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key and ``spans`` (kind, start, end in code points, base), by kind as listed, then start.

    Null and empty texts have no spans; repeated rows give repeated rows; other columns are not read.
    """
    ship_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield span_batch(part.column("key"), [all_spans(t or "", model) for t in part.column("text").to_pylist()])

    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("key", key)


def span_batch(keys: pa.Array, spans: list[list[tuple]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    rows = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in one] for one in spans]
    return pa.RecordBatch.from_arrays([keys, pa.array(rows, kind)], names=["key", "spans"])
