"""N-gram Jaccard join by MinHash banding (operator 8).

Words are runs of 0-9, a-z and non-ASCII characters after A-Z is lowered; a
document's n-grams are its runs of five words, or all its words if it has
fewer. Documents link if the Jaccard similarity of their n-gram sets is 0.8 or
more. Texts with the same n-grams are one class from the start. Band and row
counts follow from the target recall at the threshold; classes that meet on a
band hash become candidates; every candidate pair is verified on the full
n-gram sets (64-bit hashes of the n-grams).

Candidates are compared within the connected components of the band
collisions. Small components are dealt out together; a large one is cut into
blocks of bounded size, and each pair of blocks is one unit of work. A unit
returns one row for each of its classes, not its pairs.

The n-grams of candidates are read from the texts a second time. Which texts these are is told by
a table of bits of fixed size, broadcast to that reading, so that only candidates' n-grams are shuffled, not texts.

A null text counts as empty. Documents without words link with nothing. An
empty table gives no rows. Repeated rows count as further copies. Rows without an id link and are linked like any other;
their class is the smallest id that links reach, and null where they reach none. Columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import component_labels, join_often, materialise, on_executors, slices, table, text_of, with_least

N_WORDS, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.999, 128
#: A block holds about so many n-grams and classes; a larger component is cut into several.
BLOCK_NGRAMS, BLOCK_CLASSES = 1_500_000, 512
#: Components of one block are dealt out in units of about so many n-grams.
UNIT_NGRAMS = 250_000
#: Words of 64 bits in the table that tells candidates to the second reading: 67 million bits, whatever the number of documents.
BIT_WORDS = 1 << 20
#: Up to so many ids (16 bytes each) are broadcast to the table that they are taken out of.
BROADCAST_IDS = 500_000
WRAP = 1 << 64


def bands_for(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows in a band with which pairs at the threshold meet with ``recall``."""
    best = None
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)))
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no band count reaches the recall within max_hashes")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.zeros(256, np.uint64)
_values = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_word = [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]
_BYTE[_word] = _values[[b + 32 if 65 <= b < 91 else b for b in _word]]


class Powers:
    """Powers of ``base`` and of its inverse, modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, WRAP), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.array([1, *[b] * self.n], np.uint64)) for b in (self.base, self.inverse))
        return self.up, self.down


_powers = Powers(BASE)


def ngrams(texts: list[str], n: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): n-gram hashes of all texts in a row; text k has those from starts[k] to starts[k + 1]."""
    raw = np.frombuffer("\n".join(texts).encode("utf-8", "replace") + b"\n", np.uint8)
    ends_of_text = np.cumsum([len(t.encode("utf-8", "replace")) + 1 for t in texts])
    value = _BYTE[raw]
    inside = value != 0
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A word's hash is its part of a running sum, moved to the origin; the sum begins anew for each stretch, so that powers stay few.
    up, down = _powers.upto(1 << 16)
    place = np.arange(len(raw)) & 0xFFFF
    total = np.concatenate([[np.uint64(0)], np.cumsum(value * up[place], dtype=np.uint64)])
    words = (total[end] - total[start]) * down[place[start]] if len(start) else np.empty(0, np.uint64)
    crossing = np.flatnonzero((start >> 16) != ((end - 1) >> 16))
    for k in crossing.tolist():
        v = value[start[k] : end[k]]
        p, _ = _powers.upto(len(v))
        words[k] = np.sum(v * p[: len(v)], dtype=np.uint64)
    up, down = _powers.upto(1 << 16)
    words = _mix(words)
    first = np.searchsorted(start, ends_of_text)
    counts = np.diff(np.concatenate([[0], first]))
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(grams)])
    out = np.empty(starts[-1], np.uint64)
    if len(words) >= n:
        whole = np.zeros(len(words) - n + 1, np.uint64)
        for j in range(n):
            whole = whole * np.uint64(BASE) + words[j : len(words) - n + 1 + j]
        long = np.flatnonzero(counts >= n)
        at = np.repeat((first - counts)[long] - np.concatenate([[0], np.cumsum(grams[long])[:-1]]), grams[long]) + np.arange(grams[long].sum())
        out[np.repeat(starts[:-1][long] - np.concatenate([[0], np.cumsum(grams[long])[:-1]]), grams[long]) + np.arange(grams[long].sum())] = whole[at]
    for k in np.flatnonzero((counts > 0) & (counts < n)).tolist():
        h = int(counts[k])
        for w in words[first[k] - counts[k] : first[k]].tolist():
            h = (h * BASE + w) % WRAP
        out[starts[k]] = h
    return _mix(out), starts


def _class_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each text's n-grams with their counts; texts without n-grams get 0."""
    if not len(hashes):
        return np.zeros(len(starts) - 1, np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return np.where(np.diff(starts) > 0, _mix(total[starts[1:]] - total[starts[:-1]] + np.diff(starts).astype(np.uint64)), 0)


def band_hashes(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int, chunk: int = 1 << 15) -> np.ndarray:
    """(texts, bands) hashes of the bands of each text's MinHash signature; texts without n-grams get noise."""
    n = len(starts) - 1
    factors = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    sig = np.full((bands * rows, n), WRAP - 1, np.uint64)
    for at in range(0, len(hashes), chunk):
        part = hashes[at : at + chunk]
        lo, hi = np.searchsorted(starts, at, side="right") - 1, np.searchsorted(starts, at + len(part), side="left")
        texts = np.flatnonzero(np.diff(starts[lo : hi + 1])) + lo
        cuts = np.maximum(starts[texts] - at, 0)
        for k, a in enumerate(factors):
            sig[k, texts] = np.minimum(sig[k, texts], np.minimum.reduceat(part * a, cuts))
    out = np.empty((n, bands), np.uint64)
    for b in range(bands):
        h = np.full(n, b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            h = _mix(h * np.uint64(BASE) + sig[k])
        out[:, b] = h
    return out


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, t): ``key`` is a hash of id and text, the same in every reading."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return texts.select("doc_id", F.xxhash64("doc_id", "t").alias("key"), "t")


def signatures(docs: DataFrame, bands: int, rows: int, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, node, grams, bands): row key, class key, n-gram count and band hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, starts = ngrams(part.column(2).to_pylist(), n)
                found = band_hashes(h, starts, bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, bands, dtype=np.int32), found.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_class_keys(h, starts).view(np.int64)), pa.array(np.diff(starts)), lists], ["doc_id", "key", "node", "grams", "bands"])

    return on_executors(keyed_texts(docs, id_col, text_col)).mapInArrow(run, "doc_id long, key long, node long, grams long, bands array<long>")


def bit_of(key: str) -> tuple[Column, Column]:
    """(word, bit) of a key in the table of bits."""
    h = F.xxhash64(key, F.lit(29))
    return F.pmod(h, F.lit(BIT_WORDS)), F.shiftright(h, 32).bitwiseAND(F.lit(63)).cast("int")


def bit_table(keys: DataFrame, key: str = "key") -> DataFrame:
    """(word, bits): at most ``BIT_WORDS`` rows that have each key's bit set."""
    word, bit = bit_of(key)
    return keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))


def gram_sets(docs: DataFrame, bits: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(key, node, set): the sorted distinct n-gram hashes of the texts whose key's bit is set, and of few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                h, starts = ngrams(part.column(1).to_pylist(), n)
                sets = [np.unique(h[starts[k] : starts[k + 1]]).tobytes() for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_class_keys(h, starts).view(np.int64)), pa.array(sets, pa.binary())], ["key", "node", "set"])

    word, bit = bit_of("key")
    texts = keyed_texts(docs, id_col, text_col).withColumns({"word": word, "bit": bit})
    # At most BIT_WORDS rows of 16 bytes.
    picked = texts.join(F.broadcast(bits), "word").where(F.expr("(shiftrightunsigned(bits, bit) & 1L) = 1L")).select("key", "t")
    return on_executors(picked).mapInArrow(run, "key long, node long, set binary")


def compare(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links within one component's block (side 0) or between two blocks (sides 0 and 1).

    Returns for each class with a link: the copies that its links reach, and the smallest
    class reachable here.
    """
    node, copies, side = rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["side"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in rows["set"]]
    size = np.array([len(s) for s in sets], np.int64)
    n = len(sets)
    both = np.zeros((n, n), np.float32)
    if n <= 6:
        for i in range(n):
            for j in range(i + 1, n):
                if min(size[i], size[j]) >= threshold * max(size[i], size[j]) - 1e-9:
                    both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(n), size)
        shared = count[gram] > 1
        gram, of = gram[shared], of[shared]
        order = np.argsort(gram, kind="stable")
        gram, of = gram[order], of[order]
        column = np.cumsum(np.diff(gram, prepend=gram[:1]) != 0) if len(gram) else gram
        width = 2048
        cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + width + 1, width))
        for lo, hi in pairwise(cuts.tolist()):
            if hi > lo:
                ones = np.zeros((n, width), np.float32)
                ones[of[lo:hi], column[lo:hi] % width] = 1
                both += ones @ ones.T
    union = size[:, None] + size[None, :] - both
    linked = (both >= threshold * union - 1e-6) & (both > 0)
    np.fill_diagonal(linked, False)
    if side.any():
        linked &= side[:, None] != side[None, :]
    some = linked.any(1)
    root = np.where(some, node, np.iinfo(np.int64).max)
    while some.any():
        low = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1))
        if (low == root).all():
            break
        root = low
    return pd.DataFrame({"node": node[some], "links": (linked @ copies.astype(np.float64)).astype(np.int64)[some], "root": root[some]})


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root, whole): links of each class in each unit of work; whole if its component is one unit."""

    def units(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable")
        found = [compare(g, threshold) for _, g in rows.groupby("component", sort=False) if len(g) > 1]
        found = [f.assign(whole=rows["whole"].iloc[0]) for f in found if len(f)]
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"node": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64"), "whole": pd.Series(dtype="bool")})

    sized = members.groupBy("component").agg(F.sum(F.octet_length("set") / 8).alias("grams"), F.count("*").alias("n")).withColumn(
        "blocks", F.greatest(F.ceil(F.col("grams") / BLOCK_NGRAMS), F.ceil(F.col("n") / BLOCK_CLASSES)).cast("int")
    )
    total = sized.where("blocks = 1").agg(F.sum("grams")).first()[0] or 0
    groups = max(1, math.ceil(total / UNIT_NGRAMS))
    placed = join_often(members, sized.select("component", "blocks", "n"), ["component"], "n", members.count())
    small = placed.where("blocks = 1").select(
        F.pmod(F.xxhash64("component"), F.lit(groups)).alias("unit"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), F.lit(True).alias("whole"), "component", "node", "copies", "set"
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    large = (
        placed.where("blocks > 1").withColumn("own", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.col("component").alias("unit"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), F.lit(False).alias("whole"), "component", "node", "copies", "set")
    )
    return on_executors(small.unionByName(large)).groupBy("whole", "unit", "x", "y").applyInPandas(units, "node long, links long, root long, whole boolean")


def linked_rows(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, class_id, n_links, first_key, in_class) for each row.

    ``first_key``: the row key of the class's first row, that of the smallest id (rows without an id come last) and then of the smallest key;
    ``in_class``: the class's rows. Both are null for rows without words.
    """
    bands, rows = bands_for(threshold, recall)
    sigs = materialise(signatures(docs, bands, rows, n, id_col, text_col))
    # Of a class the row with the smallest id is read again; one without an id only where no row has one.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    classes = materialise(sigs.where("grams > 0").groupBy("node").agg(first, F.count("*").alias("copies"), F.any_value("bands").alias("bands")).select("node", "first.doc_id", "first.key", "copies", "bands"))
    band = classes.select(F.explode("bands").alias("u"), F.col("node").alias("v"))
    n_classes = classes.count()
    edges = with_least(band, n_classes * bands, 2).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    labels = materialise(component_labels(edges))
    wanted = materialise(classes.select("node", "key", "copies").join(labels, "node"))
    sets = gram_sets(docs, bit_table(wanted), n, id_col, text_col)
    # Equal rows of one id, or of none, share a key; one of them is enough, and the others go before the shuffle.
    members = sets.groupBy("node", "key").agg(F.any_value("set").alias("set")).join(wanted, ["node", "key"]).select("node", "component", "copies", "set")
    found = materialise(verified(materialise(members), threshold))
    # A component of one unit is settled there; the others' roots are joined across units.
    across = found.where(~F.col("whole"))
    joined = component_labels(across.select(F.col("node").alias("a"), F.col("root").alias("b"))) if across.head(1) else None
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if joined is not None:
        links = links.join(joined, "node", "left").select("node", "links", F.coalesce("component", "root").alias("root"))
    whole = materialise(classes.select("node", "doc_id", "key", "copies").join(links, "node", "left").select("node", "doc_id", "key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")))
    names = whole.groupBy("root").agg(first, F.sum("copies").alias("in_class"), F.count("*").alias("k")).select("root", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("first_key"), "in_class", "k")
    named = materialise(join_often(whole.select("root", "node", "links", "copies"), names, ["root"], "k", n_classes).select("node", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "first_key", "in_class", "copies"))
    rows_of = join_often(sigs.where("grams > 0").select("doc_id", "key", "node"), named, ["node"], "copies", sigs.count())
    wordless = sigs.where("grams = 0").select("doc_id", "key", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("first_key"), F.lit(None).cast("long").alias("in_class"))
    return rows_of.select(*wordless.columns).unionByName(wordless).withColumn("class_id", F.coalesce("class_id", "doc_id"))


def join_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links): the smallest id reachable by links, and the other documents linked directly."""
    found = linked_rows(docs, threshold, recall, n, id_col, text_col)
    return found.select(F.col("doc_id").alias(id_col), "class_id", "n_links")


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each class of ``linked_rows``; equal rows of one id become one. Rows without words or id stay."""
    rows = found.where("in_class > 1 or in_class is null and doc_id is not null").groupBy("key").agg(F.any_value(F.col("key") != F.col("first_key")).alias("goes"), F.count("*").alias("n"))
    rows = materialise(rows.where("goes or n > 1"))
    gone, twice = rows.where("goes").select("key"), rows.where("not coalesce(goes, false)").select("key")
    few = gone.count() <= BROADCAST_IDS
    key = F.xxhash64(F.col(id_col).cast("long"), text_of(text_col))
    marked = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row"))
    kept = marked.join(F.broadcast(gone) if few else gone, "key", "left_anti")
    if twice.head(1):
        kept = kept.join(twice, "key", "left_anti").unionByName(kept.join(twice, "key", "left_semi").dropDuplicates(["key"]))
    return kept.select("row.*")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's near-duplicate class and its number of links."""
    return join_documents(table(spark, sf_dir, "documents"))


def oracle(threshold: float = THRESHOLD, n: int = N_WORDS) -> str:
    """The same result from every pair of documents that share an n-gram."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') as w from documents),
g as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - {n - 1}, 1) + 1), lambda i: array_to_string(w[i : i + {n - 1}], ' '))) as g from w where len(w) > 0),
z as (select doc_id, count(*) as n from g group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from g as a join g as b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join z as x on x.doc_id = a join z as y on y.doc_id = b where shared >= {threshold} * (x.n + y.n - shared) - 1e-9),
r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as class_id from r group by a), k as (select a, count(*) as n from l group by a)
select doc_id, class_id, coalesce(k.n, 0) as n_links from documents join c on c.a = doc_id left join k on k.a = doc_id"""
