"""Toxicity: a linear-chain CRF over tokens, whose marginals score documents and mark spans (operator 11).

A chain is a sentence: the words up to one that ends with ``.``, ``!``, ``?``
or an ellipsis, at most ``CHAIN`` of them. States are harmless and toxic. A
word's score depends on itself, its form without disguise (digits and signs
for letters), its first four to seven letters, and the words beside it. Forward-backward
gives each word's probability of being toxic. The document's score is a
logistic function of the highest probability and of the sum of all that are
not small; runs of words of ``MARKED`` or more are the offending spans, in
code points, ends exclusive.

Labelled tokens come from labelled documents, as these name no places: a word
is toxic in a toxic document if it, or its first letters, tell toxic documents
from others: nearly all documents with it are toxic, and so many that chance
is ruled out for all words tested together (a log likelihood ratio). Tokens of
other documents are harmless, these words included. Toxic documents without
any such word name no tokens and don't train the field. The field is trained
on exact gradients.

Training rows: labels 0 and 1 of documents whose crc32(doc_id as text) mod 5
is not 0, at most ``FIT_ROWS`` of them, those with the smallest hashes of
their ids; of equal texts one teaches. With no training rows, one class only,
or no word that tells them apart, the score is the smoothed share of label 1
everywhere and nothing is marked. No label, language, source or id is an input
of a score.

A null text counts as empty; an empty one has no spans and the score of a text
without toxic words. A text is read in pieces of at least ``PIECE`` characters
that end between words, so that memory does not grow with it. Repeated rows
give equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chains import marginals
from .common import materialise, on_executors, slices, smallest_hashes, table, text_of

THRESHOLD, MARKED, SMALL = 0.5, 0.5, 0.1
#: Labelled documents, forms that may tell toxic documents (the most frequent in these), and chains of either kind (with a toxic word and without) that train.
FIT_ROWS, CANDIDATES, CHAINS = 12_000, 50_000, 3_000
#: Of the documents with a telling form this share is toxic, in at least so many; and by how much its log likelihood ratio exceeds that of the number of forms tested.
PRECISION, LEAST, MARGIN = 0.8, 3, 3.0
#: Lengths of the first letters that count.
PREFIXES = (4, 5, 6, 7)
CHAIN, PIECE, TOGETHER = 64, 1 << 18, 100_000
#: Words whose scores a Python worker keeps.
KEPT = 200_000
SEED = 17

_SPACE, _WORD = re.compile(r"\s"), re.compile(r"\S+")
_MARKS = "\"'`“”‘’«»()[]{}<>.,;:!?…*_~-–—/\\|"
_ENDS = (".", "!", "?", "…")
_DISGUISE = str.maketrans("013457$@!|", "oieastsail")


def bare(word: str) -> str:
    return word.strip(_MARKS).lower()


def undisguised(word: str) -> str:
    """Letters only, digits and signs that stand for letters replaced, as in 1d10t or s.c.u.m."""
    return word if word.isalpha() else "".join(c for c in word.translate(_DISGUISE) if c.isalpha())


def kind_of(word: str) -> str:
    return "-" if not word else "x" if word.isalpha() else "d" if word.isdigit() else "m"


def own_features(word: str) -> tuple[str, ...]:
    """A word's features at its own place, and the one that its neighbours see (the first)."""
    w = bare(word)[:40]
    q = undisguised(w)
    return ("w:" + w, "q:" + q, *(f"{k}:{q[:k] if len(q) >= k else ''}" for k in PREFIXES), "c:" + kind_of(w))


def forms(word: str) -> list[str]:
    """What may tell a toxic word: the word (with ``=``) and its first letters."""
    w = bare(word)[:40]
    return ["=" + w, *(w[:k] for k in PREFIXES if len(w) >= k)] if w else []


#: What a word beside a chain's end sees there.
EDGE = "w:^"


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """(offset, piece) of a text, cut between words."""
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + PIECE)
        end = m.start() if m else len(text)
        yield at, text[at:end]
        at = end


def chain_starts(ends: np.ndarray, firsts: Iterable[int]) -> np.ndarray:
    """Where chains start among words in a row: at ``firsts``, after words that end a sentence, and after each ``CHAIN`` words."""
    starts = np.zeros(len(ends), bool)
    starts[list(firsts)] = True
    starts[1:] |= ends[:-1]
    place = np.arange(len(ends))
    since = place - np.maximum.accumulate(np.where(starts, place, 0))
    return np.flatnonzero(starts | (since % CHAIN == 0))


def sentences(text: str) -> Iterator[list[str]]:
    """The words of each chain of a text."""
    for _, piece in pieces(text):
        words = piece.split()
        if words:
            cuts = chain_starts(np.array([w.endswith(_ENDS) for w in words]), [0]).tolist()
            for b, e in zip(cuts, [*cuts[1:], len(words)], strict=True):
                yield words[b:e]


@dataclass
class TokenField:
    """A linear-chain CRF of two states: weights of features for state 1, of first states and of moves."""

    index: dict[str, int]
    weights: np.ndarray
    first: np.ndarray
    steps: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False)
    shares: np.ndarray | None = field(default=None, repr=False)
    tables: dict[str, dict[str, float]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "shares": None, "tables": {}}

    def weight(self, feature: str) -> float:
        k = self.index.get(feature)
        return 0.0 if k is None else float(self.weights[k])

    def by_kind(self) -> dict[str, dict[str, float]]:
        """Weights by the kind of feature (what stands before the colon) and its value."""
        if not self.tables:
            for x, k in self.index.items():
                kind, _, value = x.partition(":")
                self.tables.setdefault(kind, {})[value] = float(self.weights[k])
        return self.tables

    def share(self, words: list[str]) -> list[tuple[float, float, float, float]]:
        """What each word adds at its own place, to the word after it and to the one before it, and whether it ends a sentence."""
        tables = self.by_kind()
        get = {kind: tables.get(kind, {}).get for kind in ("w", "q", "c", "-1w", "+1w", *map(str, PREFIXES))}
        own, skeleton, kinds, after, before = (get[k] for k in ("w", "q", "c", "-1w", "+1w"))
        first_letters = [(k, get[str(k)]) for k in PREFIXES]
        bias, out = self.weight("bias"), []
        for word in words:
            w = word.strip(_MARKS).lower()[:40]
            plain = w.isalpha()
            q = w if plain else undisguised(w)
            total = bias + own(w, 0.0) + skeleton(q, 0.0) + kinds("x" if plain else kind_of(w), 0.0)
            for k, of in first_letters:
                total += of(q[:k] if len(q) >= k else "", 0.0)
            out.append((total, after(w, 0.0), before(w, 0.0), float(word.endswith(_ENDS))))
        return out

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of ``shares`` for words; those of new words are added."""
        if self.shares is None or len(self.known) > KEPT:
            self.known, self.shares = {}, np.empty((0, 4))
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.shares = np.concatenate([self.shares, self.share(new)])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def toxic(self, words: list[str], firsts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(each word's probability, where chains start) of words in a row, whose texts start at ``firsts``."""
        at = self.rows(words)
        own, after, before, ends = self.shares[at].T
        starts = chain_starts(ends > 0, firsts)
        lasts = np.append(starts[1:], len(words)) - 1
        left, right = np.roll(after, 1), np.roll(before, -1)
        left[starts], right[lasts] = self.weight("-1" + EDGE), self.weight("+1" + EDGE)
        p, _, _ = marginals(own + left + right, starts, self.first, self.steps)
        return p, starts


def features(words: list[str]) -> list[tuple[str, ...]]:
    """The features of each word of a chain."""
    own = [own_features(w) for w in words]
    beside = [EDGE, *(f[0] for f in own), EDGE]
    return [(*f, "-1" + beside[k], "+1" + beside[k + 2], "bias") for k, f in enumerate(own)]


def log_likelihood(model: TokenField, ids: np.ndarray, tags: np.ndarray, starts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood, and its slopes by weights, first states and moves) of tagged chains; ``ids`` of unknown features are the last weight."""
    emit = model.weights[ids].sum(1)
    p, moves, logs = marginals(emit, starts, model.first, model.steps)
    inside = np.ones(len(tags), bool)
    inside[starts] = False
    at = np.flatnonzero(inside)
    truth = np.zeros((2, 2))
    np.add.at(truth, (tags[at - 1], tags[at]), 1)
    value = (emit * tags).sum() + model.first[tags[starts]].sum() + (truth * model.steps).sum() - logs.sum()
    slope = np.bincount(ids.ravel(), np.repeat(tags - p, ids.shape[1]), len(model.weights))
    first = np.array([(tags[starts] == s).sum() for s in (0, 1)]) - np.array([(1 - p[starts]).sum(), p[starts].sum()])
    return value, slope, first, truth - moves.sum(0)


def train(chains: list[tuple[list[str], list[int]]], rounds: int = 80, rate: float = 0.1, ridge: float = 0.5) -> TokenField:
    """Weights that maximise the regularised likelihood of tagged chains, by Adam on exact gradients."""
    found = [features(words) for words, _ in chains]
    counts = Counter(x for chain in found for f in chain for x in f)
    index = {x: k for k, x in enumerate(sorted(x for x, n in counts.items() if n > 1))}
    ids = np.array([[index.get(x, len(index)) for x in f] for chain in found for f in chain])
    tags = np.array([t for _, ts in chains for t in ts])
    starts = np.cumsum([0, *(len(ts) for _, ts in chains[:-1])])
    model = TokenField(index, np.zeros(len(index) + 1), np.zeros(2), np.zeros((2, 2)))
    values = [model.weights, model.first, model.steps]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    for r in range(1, rounds + 1):
        slopes = log_likelihood(model, ids, tags, starts)[1:]
        slopes[0][-1] = 0
        for v, (m1, m2), g in zip(values, moments, slopes, strict=True):
            g = g - ridge * v
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            v += rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.999**r)) + 1e-8)
    return model


def evidence_for(toxic: int, n: int, share: float) -> float:
    """Log likelihood ratio of ``toxic`` of ``n`` documents against the overall ``share``."""
    clean = n - toxic
    return toxic * math.log(toxic / n / share) + (clean * math.log(clean / n / (1 - share)) if clean else 0.0)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """(key, y, t): texts of at most ``fit_rows`` labels outside the held-out fifth; of equal texts with one label one, with a key of its own."""
    marks = materialise(
        labels.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).alias("label")).where(F.col("key").isNotNull() & ~held_out("key") & F.col("label").isin(0, 1))
        .groupBy("key").agg(F.max("label").cast("int").alias("y"))
    )
    marks = smallest_hashes(marks, "key", marks.count(), fit_rows, SEED)
    texts = docs.select(F.col(id_col).cast("long").alias("key"), text_of(text_col).alias("t"))
    # Bounded by fit_rows, so that the texts need no shuffle but that of the picked ones.
    return materialise(texts.join(F.broadcast(marks), "key").groupBy(F.xxhash64("t").alias("h"), "y").agg(F.min_by("t", "key").alias("t")).select(F.xxhash64("h", "y").alias("key"), "y", "t"))


def toxic_forms(texts: DataFrame, n: int, ones: int) -> list[str]:
    """Forms of words that tell the toxic ones of a bounded table of ``n`` labelled texts, ``ones`` of them toxic."""

    def found(rows: DataFrame, among: frozenset[str] | None) -> DataFrame:
        """(form, n): in how many texts each form is."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 256):
                    counts = Counter(f for t in part.column(0).to_pylist() for f in {f for w in set(t.split()) for f in forms(w)} if among is None or f in among)
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["form", "n"])

        return on_executors(rows.select("t")).mapInArrow(run, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))

    toxic = found(texts.where("y = 1"), None)
    tested = toxic.count()
    likely = {r["form"]: r["n"] for r in toxic.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "form").limit(CANDIDATES).collect()}
    clean = {r["form"]: r["n"] for r in found(texts.where("y = 0"), frozenset(likely)).collect()}
    out = []
    for form, t in likely.items():
        both = t + clean.get(form, 0)
        if t >= PRECISION * both and evidence_for(t, both, ones / n) >= math.log(tested) + MARGIN:
            out.append(form)
    return sorted(out)


def tagged_chains(texts: DataFrame, telling: list[str], chains: int = CHAINS) -> list[tuple[list[str], list[int]]]:
    """Chains with tags from labelled texts: at most ``chains`` with a word of ``telling`` form and as many without, those of the smallest hashes.

    A toxic text with none of these forms names no toxic token, so that it is left out.
    """
    told = frozenset(telling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                out: list[tuple[int, int, bool, list[str], list[int]]] = []
                for key, y, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    found = [(s, [not told.isdisjoint(forms(w)) for w in s]) for s in sentences(t)]
                    if not y or any(any(m) for _, m in found):
                        out += [(key, k, any(m), s, [int(y and x) for x in m]) for k, (s, m) in enumerate(found)]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                types = pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "k", "toxic", "words", "tags"])

    h = F.xxhash64("key", "k", F.lit(SEED))
    rows = on_executors(texts).mapInArrow(run, "key long, k int, toxic boolean, words array<string>, tags array<int>")
    out = []
    for kind in (True, False):
        out += [(r["words"], r["tags"]) for r in rows.where(F.col("toxic") == kind).orderBy(h, "key", "k").limit(chains).collect()]
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
TAGGED = "words long, top double, mass double, spans array<struct<start:long,end:long,probability:double>>"


@dataclass
class Summary:
    """What the words of a text add up to."""

    words: int = 0
    top: float = 0.0
    mass: float = 0.0
    spans: list[dict] = field(default_factory=list)

    def add(self, offset: int, piece: str, p: np.ndarray, new_chain: np.ndarray) -> None:
        self.words += len(p)
        self.top = max(self.top, float(p.max()))
        self.mass += float(p[p >= SMALL].sum())
        hits = np.flatnonzero(p >= MARKED)
        if len(hits):
            places = [m.span() for m in _WORD.finditer(piece)]
            runs = np.split(hits, np.flatnonzero((np.diff(hits) > 1) | new_chain[hits[1:]]) + 1)
            for run in runs:
                start, end = places[run[0]][0], places[run[-1]][1]
                while start < end and piece[start] in _MARKS:
                    start += 1
                while start < end and piece[end - 1] in _MARKS:
                    end -= 1
                self.spans.append({"start": offset + start, "end": offset + end, "probability": float(p[run].max())})


def tagged(texts: list[str], model: TokenField | None) -> list[Summary]:
    """A summary of each text, about ``TOGETHER`` words at a time."""
    out = [Summary() for _ in texts]
    held: list[tuple[int, int, str, list[str]]] = []

    def flush() -> None:
        words = [w for *_, ws in held for w in ws]
        firsts = np.cumsum([0, *(len(ws) for *_, ws in held[:-1])]).tolist()
        p, starts = model.toxic(words, firsts)
        new = np.zeros(len(words), bool)
        new[starts] = True
        for b, (k, offset, piece, ws) in zip(firsts, held, strict=True):
            out[k].add(offset, piece, p[b : b + len(ws)], new[b : b + len(ws)])
        held.clear()

    waiting = 0
    for k, text in enumerate(texts):
        for offset, piece in pieces(text):
            words = piece.split()
            if not words:
                continue
            if model is None:
                out[k].words += len(words)
                continue
            held.append((k, offset, piece, words))
            waiting += len(words)
            if waiting >= TOGETHER:
                flush()
                waiting = 0
    if held:
        flush()
    return out


def tag(docs: DataFrame, model: TokenField | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words, top, mass, spans): word count, highest probability, sum of those of ``SMALL`` or more, and the offending spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = tagged(part.column(1).to_pylist(), model)
                columns = [pa.array([s.words for s in found], pa.int64()), pa.array([s.top for s in found]), pa.array([s.mass for s in found]), pa.array([s.spans for s in found], SPANS)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "words", "top", "mass", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return on_executors(rows).mapInArrow(run, "doc_id long, " + TAGGED).withColumnRenamed("doc_id", id_col)


@dataclass
class ToxicityModel:
    """The field over tokens, or none, and the logistic function over a document's highest probability and sum."""

    tokens: TokenField | None
    weights: tuple[float, float]
    intercept: float

    def score(self) -> Column:
        logit = F.lit(self.intercept)
        for w, x in zip(self.weights, evidence(), strict=True):
            logit = logit + F.lit(w) * x
        return 1.0 / (1.0 + F.exp(-logit))


def evidence() -> tuple[Column, Column]:
    """The highest probability as bounded odds, and the damped sum."""
    top = F.greatest(F.least(F.col("top"), F.lit(1 - 1e-4)), F.lit(1e-4))
    return F.log(top / (1.0 - top)), F.log1p("mass")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """A model from the labelled documents outside the held-out fifth."""
    texts = training_texts(docs, labels, id_col, text_col, label_col, fit_rows)
    n, ones = texts.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = ToxicityModel(None, (0.0, 0.0), math.log((ones + 0.5) / (n - ones + 0.5)))
    if not 0 < ones < n:
        return prior
    telling = toxic_forms(texts, n, ones)
    if not telling:
        return prior
    tokens = train(tagged_chains(texts, telling))
    found = tag(texts, tokens, "key", "t").join(texts.select("key", "y"), "key")
    rows = materialise(found.select(array_to_vector(F.array(*evidence())).alias("x"), F.col("y").cast("double").alias("y")))
    fitted = LogisticRegression(featuresCol="x", labelCol="y", regParam=0.001, maxIter=60).fit(rows)
    return ToxicityModel(tokens, tuple(map(float, fitted.coefficients.toArray())), float(fitted.intercept))


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, words, spans) of each document."""
    found = tag(docs, model.tokens, id_col, text_col).withColumn("score", model.score())
    return found.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "words", "spans")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and offending spans (start:end, comma-joined) of all documents, by a field learned from their labels."""
    docs = table(spark, sf_dir, "documents")
    found = score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "held_out", "score", "predicted", "words", F.size("spans").cast("long").alias("n_spans"), places.alias("spans"))
