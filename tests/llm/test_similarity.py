from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import additive_quantiser, common, embedding_dups, licenses, ngram_join
from driftwell.llm.vectors import distances

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    """(class by row, links by row) of (id, text) rows."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / len(sets[i] | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), d), d)
    return [least[find(k)] for k in range(len(rows))], links


def near_copies(seed=1, words=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(words)) for _ in range(12)]
    rows = []
    for k, b in enumerate(base):
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = b.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"z{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "One, two!"), (len(rows) + 3, "one TWO"), (len(rows) + 4, rows[0][1]), (len(rows) + 5, "é ñ")]
    return rows


@pytest.mark.parametrize("small_blocks", [False, True])
def test_join_equals_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 3)
        monkeypatch.setattr(ngram_join, "BIT_WORDS", 2)
    rows = near_copies()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), recall=0.99999).collect()}
    classes, links = brute(rows)
    assert got == {d: (c, n) for (d, _), c, n in zip(rows, classes, links, strict=True)}


def test_ngram_hashes_tell_ngrams_apart():
    texts = ["", "a", "A b c d e f", "a b c d e", "b a", "x" * 70_000 + " a b c d e f", "é è ç, ñ ü ß"]
    h, starts = ngram_join.ngrams(texts)
    seen = {}
    for k, t in enumerate(texts):
        assert set(np.unique(h[starts[k] : starts[k + 1]]).tolist()) and len(set(h[starts[k] : starts[k + 1]].tolist())) == len(grams(t)) or not grams(t)
        for x, g in zip(h[starts[k] : starts[k + 1]].tolist(), [g for g in ordered(t)], strict=True):
            assert seen.setdefault(x, g) == g


def ordered(t):
    w = WORD.findall(t.lower())
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_band_choice_reaches_recall():
    b, r = ngram_join.bands_for(0.8, 0.999)
    assert b * r <= 128 and 1 - (1 - 0.8**r) ** b >= 0.999
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.01, 0.9999999, 4)


def test_awkward_rows(docs):
    got = ngram_join.join_documents(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[4]["n_links"] == 2 and by[5]["class_id"] == 4 and by[1]["n_links"] == 0
    kept = ngram_join.keep_one(docs, ngram_join.linked_rows(docs))
    assert kept.columns == docs.columns and sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 8, 9]
    assert ngram_join.join_documents(docs.limit(0)).count() == 0
    assert ngram_join.keep_one(docs.limit(0), ngram_join.linked_rows(docs.limit(0))).count() == 0


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_keep_one_drops_equal_rows_of_one_id(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", broadcast)
    df = spark.createDataFrame([(7, "a b c d e f")] * 3 + [(8, "q r s t u v"), (9, ""), (9, None), (9, "q")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(df, ngram_join.linked_rows(df)).collect()) == [7, 8, 9, 9]


def test_rows_without_id_link(spark):
    text = " ".join(f"w{k}" for k in range(60))
    near = text + " z"
    rows = [(None, text), (7, near), (None, "p q r s t u"), (None, "P q r, s t u"), (3, "solo words that nobody else has here"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in ngram_join.join_documents(df).collect()))
    assert got == [(0, 0, 0), (0, 0, 1), (0, 0, 1), (0, 7, 1), (3, 3, 0), (7, 7, 1)]
    kept = sorted((r["doc_id"] or 0, (r["text"] or "").lower()[:5]) for r in ngram_join.keep_one(df, ngram_join.linked_rows(df)).collect())
    assert kept == [(0, ""), (0, "p q r"), (3, "solo "), (7, "w0 w1")]


def test_bits_tell_all_candidates(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    bits = ngram_join.bit_table(keys)
    word, bit = ngram_join.bit_of("key")
    found = keys.unionByName(spark.range(2000, 4000).select(F.xxhash64("id").alias("key"))).withColumns({"word": word, "bit": bit}).join(bits, "word").where(F.expr("(shiftrightunsigned(bits, bit) & 1L) = 1L"))
    assert 2000 <= found.count() < 2010 and found.join(keys, "key").count() == 2000


def test_hubs_take_another_way(spark):
    rows = [(1, k) for k in range(2, 2500)] + [(5, 9), (5, 7), (6, 6)]
    got = {(r["u"], r["m"]) for r in common.with_least(spark.createDataFrame(rows, "u long, v long"), len(rows)).collect()}
    assert got == {(1, 2), (5, 7), (6, 6)}
    assert common.with_least(spark.createDataFrame(rows, "u long, v long"), len(rows), 2).where("u = 6").count() == 0
    star = [(10_000 + k, 10_000) for k in range(1, 1500)] + [(10_000 + k, 10_001 + k) for k in range(20)] + [(20_000, k) for k in range(3000, 4400)]
    parts = {r["node"]: r["component"] for r in common.component_labels(spark.createDataFrame(star, "a long, b long")).collect()}
    assert set(parts.values()) == {10_000, 3000} and len(parts) == 1500 + 1401


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (None, 1), (7, 8), (8, 6), (20, 3)] + [(k, k + 1) for k in range(100, 140)]
    got = {r["node"]: r["component"] for r in common.component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 20: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6} | {k: 100 for k in range(100, 141)}
    assert got == want
    assert common.component_labels(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def clusters(seed=0, n=160, dim=24):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(10, dim))
    x = np.concatenate([rng.normal(size=(n // 2, dim)), centre[rng.integers(0, 10, n // 2)] + rng.normal(scale=0.22, size=(n // 2, dim))])
    x[3] = x[5]
    return x.astype(np.float32)


def as_rows(x):
    odd = [None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [float("inf"), 1.0], [1.0, 2.0], [2.0, 4.0]]
    return [(k, [float(v) for v in r], k % 3) for k, r in enumerate(x)] + [(1000 + k, v, 0) for k, v in enumerate(odd)]


def links_of(x):
    u = embedding_dups.normalised(x.astype(float))
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(link, label[None, :], len(x)).min(1))
    return link, label


@pytest.mark.parametrize("block, cell", [(None, 4096), (37, 4096), (16, 20), (4096, 8)])
def test_embedding_links_equal_brute_force(spark, block, cell):
    x = clusters()
    clash = spark.createDataFrame(as_rows(x), VECTORS).withColumns({"node": F.lit("a"), "v": F.lit(1), "size": F.lit(0), "x": F.lit(1), "copies": F.lit(2), "row": F.lit(3)})
    got = {r["vec_id"]: r for r in embedding_dups.near_duplicates(clash, block=block, cell=cell, always=cell < 100).collect()}
    link, label = links_of(x)
    assert 0 < link.sum() < link.size / 2
    for k in range(len(x)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (link[k].sum(), label[k], label[k] == k)
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(1000, 1006)) and got[1007]["component_id"] == 1006


def test_cells_keep_every_link_and_leave_others_out(spark):
    rng = np.random.default_rng(3)
    centre = embedding_dups.normalised(rng.normal(size=(12, 16)))
    x = np.repeat(centre, 40, 0) + rng.normal(scale=0.03, size=(480, 16))
    u = embedding_dups.normalised(x)
    near = u @ centre.T
    own = near.argmax(1)
    radius = np.append(np.arccos([near[own == c, c].min() if (own == c).any() else 1 for c in range(12)]), 0)
    cells = embedding_dups.Cells(centre, np.arange(13), np.ones(13, int), radius, 0.95)
    home, open_to = cells.reach(u)
    link, _ = links_of(x)
    for i, j in zip(*np.nonzero(link), strict=True):
        assert open_to[i, home[j]] and open_to[j, home[i]]
    assert open_to.mean() < 0.5
    got = embedding_dups.near_duplicates(spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>"), block=16, cell=40, always=True).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(link.sum(1).tolist()))


def test_repeated_ids_and_extreme_scales(spark):
    rows = [(1, [1e200, 0.0]), (1, [0.0, 1e-200]), (2, [3.0, 0.0]), (3, [0.0, 5.0]), (3, [0.0, 5.0]), (None, [1.0, 0.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dups.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1)]


def test_quantisation_bounds_hold():
    u = embedding_dups.normalised(clusters(2).astype(float))
    q, scale, lost = embedding_dups.quantised(u)
    near = embedding_dups.products(q, q) * scale[:, None] * scale[None, :]
    bound = lost[:, None] + lost[None, :] + 3 * lost[:, None] * lost[None, :]
    assert (np.abs(near - u @ u.T) <= bound + 1e-6).all()


def nearest(x, q, k=10):
    d = distances(x.astype(float), x[q].astype(float))
    d[q] = np.inf
    return d, np.lexsort((np.arange(len(x)), d))[:k]


@pytest.mark.parametrize("block, depth", [(None, None), (50, 25)])
def test_search_recall_and_order(spark, monkeypatch, block, depth):
    x = clusters(4, 400)
    monkeypatch.setattr(additive_quantiser, "WORDS", 32)
    clash = spark.createDataFrame(as_rows(x), VECTORS).withColumns({c: F.lit("clash") for c in ("row", "v", "size", "codes", "norm", "square", "block", "part")})
    got = additive_quantiser.search(clash, F.col("vec_id") % 20 == 0, depth=depth, block=block).collect()
    hits = 0
    for q in range(0, len(x), 20):
        d, want = nearest(x, q)
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(d[r["vec_id"]], abs=1e-12) for r in mine) and [r["score"] for r in mine] == sorted(r["score"] for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(want.tolist()))
    assert hits >= 0.9 * 10 * len(range(0, len(x), 20))
    assert not [r for r in got if r["query_id"] in (1000,)]
    assert additive_quantiser.search(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("dim", [128, 256])
def test_recall_of_vectors_without_clusters_and_of_huge_ones(spark, dim):
    """One vector of 3e38 among others, and dimensions in which 12 books don't suffice."""
    rng = np.random.default_rng(dim)
    n = 9000
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[17] *= np.float32(1e37)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = additive_quantiser.search(df, F.col("vec_id") % 200 == 0).toPandas()
    hits = sum(len(set(got[got["query_id"] == q]["vec_id"]) & set(nearest(x, q)[1].tolist())) for q in range(0, n, 200))
    assert hits >= 0.9 * 10 * len(range(0, n, 200))


def test_scores_keep_their_order_at_any_scale():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(600, 8))
    for scale in (1.0, 1e-300, 1e300, np.exp(rng.uniform(-300, 300, (600, 1)))):
        x = u * scale
        books = additive_quantiser.fit(x, books=12, words=64)
        codes, square = books.encode(additive_quantiser.normalised(x))
        score = additive_quantiser.scores(books.dots(additive_quantiser.normalised(x[:5]), codes), square, additive_quantiser.norms(x), additive_quantiser.norms(x[:5]))
        assert not np.isnan(score).any()
        for q in range(5):
            true = distances(x, x[q])
            assert set(np.argsort(true, kind="stable")[1:6]) <= set(np.argsort(score[q], kind="stable")[:60]) or len(np.unique(true)) < 300


def test_ties_and_common_vectors(spark):
    rows = [(k, [1.0, 2.0]) for k in range(1000)] + [(5000 + k, [float(k), 1.0]) for k in range(30)] + [(200, [9.0, 9.0])]
    got = additive_quantiser.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 700, depth=20, block=300).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(k + 1, k, 0.0) for k in range(10)]
    twice = additive_quantiser.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 200).collect()
    # The smallest in byte order asks: that of nines.
    assert [r["vec_id"] for r in sorted(twice, key=lambda r: r["rank"])][:3] == [5009, 5008, 5010] and len(twice) == 10


def test_op2_columns(spark):
    df = additive_quantiser.op2_neighbours(spark, "/root/testdata/sf0.001")
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    x, ids, got = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy(), df.toPandas()
    hits = total = 0
    for k in np.flatnonzero(ids % 100 == 0):
        d = distances(x, x[k])
        d[ids == ids[k]] = np.inf
        mine = got[got["query_id"] == ids[k]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and ids[k] not in mine["vec_id"].tolist()
        hits, total = hits + len(set(mine["vec_id"]) & set(ids[np.lexsort((ids, d))[:10]])), total + 10
    assert hits >= 0.9 * total


def test_beam_search_is_no_worse_than_greedy():
    x = embedding_dups.normalised(clusters(5, 300).astype(float))
    books = additive_quantiser.fit(x, books=4, words=16)
    flat = books.words

    def error(beam):
        codes, norms = books.encode(x, beam)
        rec = flat[np.arange(4)[None, :], codes].sum(1)
        assert np.allclose((rec * rec).sum(1), norms, rtol=1e-3)
        return ((x - rec) ** 2).sum()

    assert error(8) <= error(1) * 1.001


def largest_task(spark, df, column):
    """The most rows of any partition, and all rows."""
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(column).alias("n")).collect()]
    return max(sizes), sum(sizes)


def test_hot_keys_are_spread(spark):
    """A third of the rows with one key, in joins with what belongs to the key: no partition holds them all."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(0, 30_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("c"), "id")
        told = rows.groupBy("c").agg(F.min("id").alias("least"), F.count("*").alias("k"))
        joined = common.join_often(rows, told, ["c"], "k", 30_000)
        most, n = largest_task(spark, joined, "id")
        assert n == 30_000 and most < 8_000 and not joined.where("c = 7 and least <> 0 or c <> 7 and least <> id").count()
        docs = spark.range(0, 30_000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit(None).cast("long")).otherwise(F.col("id")).alias("doc_id"), F.lit(5).cast("long").alias("h"), "id")
        found = docs.groupBy("doc_id", "h").agg(F.array(F.lit("mit")).alias("more"), F.lit(1.0).alias("containment"), F.count("*").alias("matches")).where("doc_id is null or doc_id < 5")
        joined = licenses.with_found(docs, found)
        most, n = largest_task(spark, joined, "id")
        assert n == 30_000 and most < 15_000 and joined.where("containment = 1.0").count() == 10_000 + 3
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_many_equal_rows_of_one_id(spark):
    """10,000 equal rows of one id, and 10,000 of none, are one document's copies; a near copy links to them all."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone"
    docs = spark.range(20_000).select(F.when(F.col("id") < 10_000, 3).alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(9, text + " more")], "doc_id long, text string"))
    got = {tuple(r) for r in ngram_join.join_documents(docs).collect()}
    assert got == {(3, 3, 20_000), (None, 3, 20_000), (9, 3, 20_000)}


def test_few_vectors_are_compared_exactly():
    rng = np.random.default_rng(8)
    assert additive_quantiser.fit(rng.normal(size=(900, 32)), books=2, rounds=2).depth >= 900
