from __future__ import annotations

import random
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from driftwell.llm import bpe, packing, token_counts

SF = "/root/testdata/sf0.001"
PIECES = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "▁", "0123", "'ll", "'s", "日本", "🙂", "́", "​", "\x1c", "\x85", "　", "<|endoftext|>", "<s>", "!!", "?.", "X" * 300, "Σς", "İ"]


def texts(n=1500, seed=7):
    rng = random.Random(seed)
    return ["", " ", "\n", "  ", " " * 3000, "ab" * 3000, *("".join(rng.choice(PIECES) for _ in range(rng.randint(1, 60))) for _ in range(n))]


def test_encoding_equals_library_and_round_trips():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, own, ts = Tokenizer.from_file(path), bpe.ByteBpe(path), texts()
    for t, e in zip(ts, lib.encode_batch(ts, add_special_tokens=False), strict=True):
        ids = own.encode(t)
        assert list(array("I", ids)) == e.ids
        assert own.decode(ids).decode() == lib.decode(e.ids, skip_special_tokens=False) == t


def test_short_and_long_words_merge_alike():
    own, rng = bpe.ByteBpe(P.path("byte_bpe_50k.json")), random.Random(2)
    for _ in range(300):
        w = bytes(rng.choice(b"aeinorst the") for _ in range(rng.randint(1, 90)))
        assert own.short(w) == own.long(w)


def test_counts_equal_library():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib, own, ts = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PieceCounter(path), texts(seed=8)
    assert [own.count(t) for t in ts] == [len(x) for x in lib.encode(ts, num_threads=1)]


def test_word_ids_equal_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib, own, ts = Tokenizer.from_file(path), packing.WordIds(path), texts(seed=9)
    assert own.encode(ts) == [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(ts, add_special_tokens=False)]


def test_word_ids_of_latin_texts_equal_library():
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(11)
    parts = ["The", "ÉCOLE", "straße", "x", "'s", "'LL", ".", ",", ". ", ", ", "..", "_", "3", "²", "¼", "µ", "º", "\xa0", "\x85", "\xad", " ", "\n", "!", "$", "I'm", "·", "ÿ", "×"]
    ts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(6000)]
    lib, own = Tokenizer.from_file(path), packing.WordIds(path)
    assert own.encode(ts) == [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(ts, add_special_tokens=False)]


def test_word_ids_of_special_strings_in_any_case_equal_library():
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(12)
    parts = ["<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext|>", "<|StartOfText|>", "<|startoftext|>", "<|", "|>", "The", "É", "a", ". ", ", ", " ", "\n"]
    ts = ["a <|ENDOFTEXT|> b", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(2000))]
    lib, own = Tokenizer.from_file(path), packing.WordIds(path)
    assert own.encode(ts) == [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(ts, add_special_tokens=False)]


def test_awkward_rows(docs):
    n = docs.count()
    for df in (bpe.encode_texts(docs, P.path("byte_bpe_50k.json")), token_counts.count_tokens(docs, P.path("piece_bpe_32k.model"))):
        assert df.count() == n
    c = {r["doc_id"]: r for r in token_counts.count_tokens(docs, P.path("piece_bpe_32k.model")).collect()}
    assert (c[1]["n_tokens"], c[1]["n_bytes"], c[2]["n_tokens"]) == (0, 0, 0) and c[6]["over_limit"]
    assert bpe.decode_ids(bpe.encode_texts(docs, P.path("byte_bpe_50k.json")), P.path("byte_bpe_50k.json")).where("doc_id = 4").first()["text"].startswith("One two")
    assert bpe.encode_texts(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity, cell", [(64, 50), (4096, 100_000), (100, 64)])
def test_packing(spark, capacity, cell):
    rng = random.Random(capacity)
    rows = [(k, 0, 0, rng.randint(1, capacity), 0) for k in range(400)] + [(1, 0, 0, capacity // 2, 0)] * 40
    df = spark.createDataFrame(rows, packing.PIECE)
    out = packing.pack(df, capacity, cell_pieces=cell).collect()
    assert sorted(tuple(r[:5]) for r in out) == sorted(rows)
    n, bound = check_packing(out, capacity), packing.lower_bound(np.array([r[3] for r in rows]), capacity)
    assert bound <= n <= bound * 1.04 + 1 and {r["bound"] for r in out} == {bound}


def test_packing_keeps_large_ids_beside_missing_ones(spark):
    big = 9007199254740993
    rows = [(None, 0, 0, 10, 5), (None, 0, 0, 10, 5), *((big + k, 0, 0, 1 + k, k) for k in range(8)), (-5, 0, 0, 3, 1)]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECE), 16).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in out) == sorted((r[0] or 0, r[3]) for r in rows)
    assert sum(r["doc_id"] is None for r in out) == 2
    check_packing(out, 16)


@pytest.mark.parametrize("sizes, bins", [([6, 5, 5, 4, 3, 3, 2, 2, 2], 4), ([9, 9, 9], 3), ([4, 4, 4, 4], 2), ([], 0)])
def test_packing_is_optimal_where_the_bound_is_met(spark, sizes, bins):
    rows = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], packing.PIECE)
    out = packing.pack(rows, 10, cell_pieces=3).collect()
    assert check_packing(out, 10) == bins and all(r["bound"] <= bins for r in out)


def test_op9_query_equals_library(spark):
    """Every contract column of the registered query, document by document, from the library's own ids."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    lib.no_truncation(), lib.no_padding()
    rows = packing.op9_packing(spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(by) == set(docs)
    for d, text in docs.items():
        ids = [*lib.encode(text, add_special_tokens=False).ids, 1]
        want = [(k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[d]) == want
    n = check_packing(rows, 4096)
    bound = {r["bound"] for r in rows}
    assert len(bound) == 1 and min(bound) <= n <= 1.01 * min(bound) + 1


def test_op4_and_op10_queries_equal_libraries(spark):
    import hashlib

    import sentencepiece
    from tokenizers import Tokenizer

    lib, pieces = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    lib.no_truncation(), lib.no_padding()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in bpe.op4_bpe(spark, SF).collect()}
    counts = {r["doc_id"]: r for r in token_counts.op10_token_counts(spark, SF).collect()}
    assert set(got) == set(counts) == set(docs)
    for d, text in docs.items():
        ids = lib.encode(text, add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        n = len(pieces.encode(text))
        assert (counts[d]["n_bytes"], counts[d]["n_tokens"], counts[d]["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_lower_bound_never_exceeds_the_optimum():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.integers(1, 33, rng.integers(1, 40))
        bins, offsets, fill = packing.best_fit_decreasing(x, 32)
        x[:3] = 16
        bins, offsets, fill = packing.best_fit_decreasing(x, 32)
        assert packing.lower_bound(x, 32) <= len(fill) and fill.max() <= 32 and fill.sum() == x.sum()
    assert packing.lower_bound(np.array([17] * 5), 32) == 5 and packing.lower_bound(np.array([], int), 32) == 0


def test_pieces(docs):
    path = P.path("word_bpe_49k.json")
    rows = packing.cut_pieces(docs, path).collect()
    own = packing.WordIds(path)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in rows:
        ids = own.encode([texts[r["doc_id"]]])[0] + (1).to_bytes(4, "little")
        part = ids[4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert r["start"] == 4096 * r["piece"] and r["length"] <= 4096 and zlib.crc32(part) == r["ids_crc32"]
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1
    assert packing.pack_documents(docs, path).count() == len(rows) and packing.pack_documents(docs.limit(0), path).count() == 0
    assert packing.cut_pieces(docs.where(F.col("doc_id") == 6), path).count() > 5
