from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from driftwell.llm import merkle

FIELDS = "doc_id long, source string, lang string, n_chars int, text string, tree string, idx int, h string"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row: tuple, text: str | None) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """(the node that remains, each leaf's siblings before and after it, level by level)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for way, k in zip(ways, at, strict=True):
            run = runs[k // 8]
            way.append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
        at, nodes = [k // 8 for k in at], [h("".join(r)) for r in runs]
    return nodes[0], ways


def expected(rows: list[tuple]) -> list[tuple]:
    """One by one: (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    key = lambda r: (r[2] is not None, (r[2] or "").encode())
    order = lambda r: (*key(r), r[0] is not None, r[0] or 0, leaf(r, r[4]))
    trees = [list(g) for _, g in groupby(sorted(rows, key=order), key)]
    below = [climb([leaf(r, r[4]) for r in t]) for t in trees]
    root, upper = climb([x for x, _ in below])
    out = []
    for t, (subroot, ways), end in zip(trees, below, upper, strict=True):
        for r, way in zip(t, ways, strict=True):
            lower = r[4] and r[4].translate(str.maketrans(merkle.UPPER, merkle.LOWER))
            fold = leaf(r, lower if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4])
            for before, after in way + end:
                fold = h(before + fold + after)
            out.append((r[0], leaf(r, r[4]), subroot, root, h("".join(b + a for b, a in way + end)), fold, fold == root))
    return sorted(out, key=str)


def rows_of(n: int, langs: int = 3) -> list[tuple]:
    return [(k if k % 11 else k + 1, None if k % 5 == 0 else f"src{k % 3}", None if k % 7 == 0 else "äb"[: k % 2 + 1] + str(k * k % langs), None if k % 4 == 0 else k, None if k % 13 == 0 else "" if k % 6 == 0 else f"Text {k} É") for k in range(n)]


@pytest.mark.parametrize("rows", [
    rows_of(1), rows_of(2), rows_of(9, 1), rows_of(200), rows_of(150, 70),
    [(1, "s", "en", 1, "A")] * 65 + [(None, None, "en", None, None)] * 9 + [(2, "s", "en", 1, "Ab" * 50_000), (3, "s", "", 1, "A"), (3, "s", "", 1, "B")],
])
def test_manifest_equals_one_by_one(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], FIELDS)
    got = sorted((tuple(r) for r in merkle.audit(docs.repartition(3)).collect()), key=str)
    assert got == expected(rows)


def test_empty_table_and_tampering(spark):
    docs = spark.createDataFrame([(*r, "", 0, "") for r in rows_of(80)], FIELDS)
    assert merkle.audit(docs.limit(0)).count() == 0
    found = {r["doc_id"]: r for r in merkle.audit(docs.where("text like 'Text%' and doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert all(r["verified"] == (zlib.crc32(str(k).encode()) % 3 != 0) for k, r in found.items()) and len({r["root"] for r in found.values()}) == 1


def test_positions_of_a_tree_over_many_ranges(spark):
    """One tree of equal rows is dealt over several tasks, and its places are gapless."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 20_000, 1, 8).select(F.lit("t").alias("tree"), F.lit(1).alias("id"))
        got = merkle.placed(rows, "tree", ["id"])
        assert got.agg(F.min("idx"), F.max("idx"), F.countDistinct("idx"), F.max("n")).first()[:] == (0, 19_999, 20_000, 20_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = [tuple(r) for r in merkle.op12_merkle(spark, sf).collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(got) == sorted(con.execute(merkle.oracle()).fetchall())
