"""Personal data by fixed patterns and a linear-chain CRF (operator 5).

Patterns find emails, IP addresses, card and phone numbers. A conditional
random field over word-shape features, trained by gradient ascent on a small
labelled table, reads the words around every digit or at sign and adds spans
that no pattern found: obfuscated emails, local phone numbers, social security
numbers. Viterbi decodes all chains of a batch of texts together in numpy.
What the field marks must still count as such an item (digits, checksum); a span that
overlaps one of a pattern's is not added.

A chain of more than ``STRETCH`` words, as in a text of numbers, is decoded in stretches that share ``OVERLAP`` words
with their neighbours; a span belongs to the stretch in whose own words it starts. Stretches are
decoded ``TOGETHER`` words at a time, so that memory does not grow with the text.

A null text counts as empty; an empty one has no spans. Repeated rows give
repeated results. An empty table gives no rows. Columns other than the id and
the text are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chains import viterbi
from .common import BoundedCache, on_executors, slices, table, text_of
from .pii_examples import labelled

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn")
Span = tuple[str, int, int]

# The patterns' meaning is fixed; these forms find the same matches in time proportional to the text.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUE = re.compile(r"[0-9@+]")
_DOT = re.compile(r"(?<!\S)[(\[]?dot[)\]]?(?!\S)|[(\[](?:at|dot)[)\]]", re.I)
_SPELLED = re.compile(r"\S+\s+[(\[]?at[)\]]?\s+\S+(?:\s+[(\[]?dot[)\]]?\s+\S+)*\s+[(\[]?dot[)\]]?\s+(?:com|org|net|edu|gov|info|io|[a-z]{2})", re.I)
_LABEL, _DOTS, _TOP = r"[^\s()\[\].]+", r"(?:\s*[(\[]dot[)\]]\s*|\s+dot\s+)", r"(?:com|org|net|edu|gov|info|io|[a-z]{2})"
_MIXED = rf"{_LABEL}(?:(?:{_DOTS}|\.){_LABEL})*"
#: With brackets instead of spaces, or stops of which some are spelled.
_BRACKETED = re.compile(rf"[^\s()\[\]]+(?:\s*[(\[]at[)\]]\s*{_MIXED}(?:{_DOTS}|\.)|\s+at\s+{_MIXED}{_DOTS}){_TOP}", re.I)
_WORD = re.compile(r"\S+")
_DIGITS = re.compile(r"[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]+")
#: Words on either side of a cue that the field reads too.
REACH = 4
STRETCH, OVERLAP, TOGETHER = 1024, 32, 16_384


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return _NO_DIGITS.sub("", text)


def emails(text: str) -> list[Span]:
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind as listed and then by start."""
    out = emails(text) if "@" in text else []
    if _DIGITS.search(text):
        # A number too long for int() is over 255 in any case.
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        # 19 digits and as many marks between them are 37 characters.
        out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() <= 37 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


Stretch = tuple[list[tuple[int, int]], int, int]


def windows(text: str) -> Iterator[Stretch]:
    """Stretches (words as (start, end), the first of its own words, the end of these) of the chains around cues.

    A chain has each word with a digit, an at or plus sign, that is a spelled dot in any case or holds a bracketed at or dot, and ``REACH`` words on either side.
    """
    low = text.lower() if len(text) < 1 << 16 else text
    spelled = len(text) >= 1 << 16 or "dot" in low or "(at)" in low or "[at]" in low
    ahead = {_CUE: -1, **({_DOT: -1} if spelled else {})}

    def cue_from(at: int) -> int:
        """Where the next cue from ``at`` on is; the end of the text if there is none."""
        for pattern, known in ahead.items():
            if known < at:
                m = pattern.search(text, at)
                ahead[pattern] = m.start() if m else len(text)
        return min(ahead.values())

    done, cue = 0, cue_from(0)
    while cue < len(text):
        start, words = cue, 0
        # To the left: REACH words before the word that holds the cue.
        while start > done and words <= REACH:
            while start > done and not text[start - 1].isspace():
                start -= 1
            words += 1
            if words <= REACH:
                while start > done and text[start - 1].isspace():
                    start -= 1
        chain, lead, left, any_cue = [], 0, REACH, False
        for m in _WORD.finditer(text, start):
            if cue < m.start():
                cue = cue_from(m.start())
            if cue < m.end():
                left, any_cue = REACH, True
                cue = cue_from(m.end())
            elif any_cue:
                left -= 1
                if left < 0:
                    break
            chain.append(m.span())
            done = m.end()
            if len(chain) == lead + STRETCH + OVERLAP:
                yield chain, lead, lead + STRETCH
                chain, lead = chain[lead + STRETCH - OVERLAP :], OVERLAP
        if len(chain) > lead:
            yield chain, lead, len(chain)
        if not chain:
            break


#: Words that tell something about their neighbours.
CUE_WORDS = frozenset("phone tel mobile fax call dial text reach contact mail email e-mail write address at dot (at) (dot) [at] [dot] ssn social security card visa pay number no server host ip connect from version chapter page section figure room year in license isbn".split())


def shape(word: str) -> str:
    """Digits as d with the run's length, letters as x, other characters as they are."""
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", word[:40], re.S):
        c = m[0][0]
        out.append(f"d{min(len(m[0]), 9)}" if "0" <= c <= "9" else "x" if c.isalpha() else c)
    return "".join(out[:12])


def own_features(word: str) -> tuple[str, ...]:
    bare = word.strip(".,;:!?\"'")
    digits = len(digits_of(word[:64]))
    low = bare.lower()
    return (
        "s:" + shape(bare),
        "n:" + str(min(digits, 17)),
        "w:" + (low if low in CUE_WORDS else "-"),
        "k:" + ("d" if digits == len(bare) > 0 else "m" if digits else "@" if "@" in bare else "p" if not bare else "x"),
        "p:" + "".join(c for c in "+@.-():/" if c in bare[:64]),
    )


#: The features of the places before and after a chain.
EDGE = ("s:^", "n:^", "w:^", "k:^", "p:^")


def features(words: list[str]) -> list[tuple[str, ...]]:
    own = [own_features(w) for w in words]
    padded = [*[EDGE] * 3, *own, *[EDGE] * 3]
    out = []
    for k, f in enumerate(own):
        b3, b2, b, _, a, a2, a3 = padded[k : k + 7]
        out.append((*f, *("-1" + x for x in b[:4]), *("+1" + x for x in a[:4]), "-2" + b2[2], "-2" + b2[3], "+2" + a2[2], "+2" + a2[3], "-3" + b3[2], "+3" + a3[2]))
    return out


STATES = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def _allowed() -> np.ndarray:
    ok = np.ones((len(STATES), len(STATES)), bool)
    for i, a in enumerate(STATES):
        for j, b in enumerate(STATES):
            ok[i, j] = b[0] != "I" or a != "O" and a[2:] == b[2:]
    return ok


#: The places around a word at which its own features count, and which of them.
PLACES = ((0, "", (0, 1, 2, 3, 4)), (1, "-1", (0, 1, 2, 3)), (-1, "+1", (0, 1, 2, 3)), (2, "-2", (2, 3)), (-2, "+2", (2, 3)), (3, "-3", (2,)), (-3, "+3", (2,)))


@dataclass
class ChainField:
    """A linear-chain CRF: weights of features by state, of neighbouring states, and of first states."""

    index: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray
    cache: BoundedCache | None = field(default=None, repr=False)

    def ids(self, words: list[str]) -> np.ndarray:
        unknown = len(self.index)
        return np.array([[self.index.get(x, unknown) for x in f] for f in features(words)])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": None}

    def shares(self, own: tuple[str, ...]) -> np.ndarray:
        """(places, states): what a word of these own features adds to the scores at each of ``PLACES``."""
        unknown = len(self.index)
        return np.stack([self.weights[[self.index.get(sign + own[k], unknown) for k in which]].sum(0) for _, sign, which in PLACES])

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores (word, state). A word's shares depend on its own features alone, so that they are kept by word and by features."""
        if self.cache is None:
            by_features = BoundedCache(self.shares, limit=20_000)
            self.cache = BoundedCache(lambda w: by_features[own_features(w)], limit=100_000, longest=32)
        edge = self.shares(EDGE)
        n, cache = len(words), self.cache
        parts = np.stack([edge] * 3 + [cache[w] for w in words] + [edge] * 3)
        return sum(parts[3 - at : 3 - at + n, k] for k, (at, _, _) in enumerate(PLACES))

    def decode(self, chains: list[list[str]]) -> list[np.ndarray]:
        """The likeliest states of each chain."""
        return viterbi([self.emissions(c) for c in chains], self.first, self.steps)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(rows: list[tuple[str, list[Span]]], rounds: int = 150, rate: float = 0.1, ridge: float = 0.02) -> ChainField:
    """Weights that maximise the regularised likelihood of the labelled rows' windows, by Adam on exact gradients."""
    chains, tags = [], []
    for text, words, spans in ((text, w[0], spans) for text, spans in rows for w in windows(text)):
        inside = [next((s for s in spans if s[1] < e and b < s[2]), None) for b, e in words]
        chains.append([text[b:e] for b, e in words])
        tags.append([STATES.index("O" if s is None else ("I-" if k and inside[k - 1] == s else "B-") + s[0]) for k, s in enumerate(inside)])
    index = {x: k for k, x in enumerate(sorted({x for c in chains for f in features(c) for x in f}))}
    s, n, t = len(STATES), len(chains), max(map(len, chains))
    model = ChainField(index, np.zeros((len(index) + 1, s)), np.zeros((s, s)), np.zeros(s))
    slots = len(features(["a"])[0])
    ids, gold, mask = np.full((n, t, slots), len(index)), np.zeros((n, t), int), np.zeros((n, t), bool)
    for k, c in enumerate(chains):
        ids[k, : len(c)], gold[k, : len(c)], mask[k, : len(c)] = model.ids(c), tags[k], True
    no_step = np.where(_allowed(), 0, -1e4)
    no_first = np.array([-1e4 if x[0] == "I" else 0 for x in STATES])
    one = np.eye(s)[gold] * mask[:, :, None]
    both = mask[:, 1:] & mask[:, :-1]
    true_steps = np.einsum("nta,ntb->ab", one[:, :-1] * both[:, :, None], one[:, 1:] * both[:, :, None])
    values = [model.weights, model.steps, model.first]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    for r in range(1, rounds + 1):
        emit = model.weights[ids].sum(2)
        steps, first = model.steps + no_step, model.first + no_first
        alpha, beta = np.zeros((n, t, s)), np.zeros((n, t, s))
        alpha[:, 0] = first + emit[:, 0]
        for j in range(1, t):
            new = _log_sum(alpha[:, j - 1, :, None] + steps, 1) + emit[:, j]
            alpha[:, j] = np.where(mask[:, j, None], new, alpha[:, j - 1])
        for j in range(t - 2, -1, -1):
            new = _log_sum(steps[None] + (emit[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where(mask[:, j + 1, None], new, 0)
        total = _log_sum(alpha[:, -1], 1)
        share = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + steps + (emit + beta)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        slope_w = np.zeros_like(model.weights)
        np.add.at(slope_w, ids, (one - share)[:, :, None, :])
        slope_w[-1] = 0
        slopes = [slope_w, true_steps - pair.sum((0, 1)), (one - share)[:, 0].sum(0)]
        for v, (m1, m2), g in zip(values, moments, slopes, strict=True):
            g = g - ridge * v
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.999
            m2 += 0.001 * g * g
            v += rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.999**r)) + 1e-8)
    return ChainField(index, model.weights.astype(np.float32), (model.steps + no_step).astype(np.float32), (model.first + no_first).astype(np.float32))


def plausible(kind: str, text: str) -> bool:
    """Whether marked words can be such an item at all."""
    d = digits_of(text)
    if kind == "email":
        return "@" in text or _SPELLED.fullmatch(text) is not None or _BRACKETED.fullmatch(text) is not None
    if kind == "ip":
        m = _IP.search(text)
        return bool(m) and all(len(p) <= 3 and int(p) <= 255 for p in m[0].split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 7 <= len(d) <= 15 and not re.search(r"[A-Za-z_/:$]", text)
    return len(d) == 9 and re.fullmatch(r"[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4}", text) is not None


def together(stretches: Iterable[tuple[int, Stretch]]) -> Iterator[list[tuple[int, Stretch]]]:
    """Runs of about ``TOGETHER`` words."""
    out, words = [], 0
    for k, stretch in stretches:
        out.append((k, stretch))
        words += len(stretch[0])
        if words >= TOGETHER:
            yield out
            out, words = [], 0
    if out:
        yield out


def marked(text: str, stretch: Stretch, path: np.ndarray) -> Iterator[Span]:
    """The plausible spans that a decoded stretch marks and that start in its own words."""
    words, first, end_of_own = stretch
    j = first
    # A span that began before the stretch's own words belongs to the stretch before.
    while first and j < len(path) and STATES[path[j]][:1] == "I":
        j += 1
    while j < end_of_own:
        if not path[j]:
            j += 1
            continue
        i, kind = j, STATES[path[j]][2:]
        j += 1
        while j < len(path) and STATES[path[j]] == f"I-{kind}":
            j += 1
        start, end = words[i][0], words[j - 1][1]
        while start < end and text[start] in "\"'<[{,.;:!?":
            start += 1
        while start < end and text[end - 1] in "\"'>]},.;:!?$%&*#":
            end -= 1
        if start < end and plausible(kind, text[start:end]):
            yield kind, start, end


def found(texts: list[str], model: ChainField) -> list[tuple[list[Span], list[Span]]]:
    """(the patterns' spans, the field's further spans) of each text."""
    base = [base_spans(t) for t in texts]
    more: list[list[Span]] = [[] for _ in texts]
    for run in together((k, w) for k, t in enumerate(texts) for w in windows(t)):
        paths = model.decode([[texts[k][b:e] for b, e in w[0]] for k, w in run])
        for (k, w), path in zip(run, paths, strict=True):
            if path.any():
                more[k] += marked(texts[k], w, path)
    return [(b, apart(b, m)) for b, m in zip(base, more, strict=True)]


def apart(base: list[Span], more: list[Span]) -> list[Span]:
    """Those of ``more``, which come by start, that overlap none of ``base``."""
    if not more or not base:
        return more
    starts = sorted((b, e) for _, b, e in base)
    # The furthest end of all spans up to each.
    ends = np.maximum.accumulate([e for _, e in starts])
    at = np.searchsorted([b for b, _ in starts], [e for _, _, e in more], side="left")
    return [m for m, k in zip(more, at.tolist(), strict=True) if k == 0 or ends[k - 1] <= m[1]]


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _listed(spans: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": b, "end": e} for k, b, e in s] for s in spans], _SPANS)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): the patterns' spans and those that the field adds."""
    model = train(labelled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                both = found(part.column(1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), _listed([b for b, _ in both]), _listed([m for _, m in both])], ["doc_id", "base", "added"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return on_executors(rows).mapInArrow(run, SCHEMA).withColumnRenamed("doc_id", id_col)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; null texts stay null."""
    model = train(labelled())
    schema = docs.schema
    at = schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(at).to_pylist()
                spans = found([t or "" for t in texts], model)
                new = [t and redact(t, b + m) for t, (b, m) in zip(texts, spans, strict=True)]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return on_executors(docs).mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by kind as listed in ``KINDS`` and then by start, comma-joined."""
    keyed = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("b"), s["end"].alias("e"), s["kind"].alias("kind"))
    return F.array_join(F.transform(F.array_sort(F.transform(spans, keyed)), lambda s: F.concat_ws(":", s["kind"], s["b"].cast("string"), s["e"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data in each document."""
    spans = find_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
