"""Merkle manifest of a dataset by sibling-shift self-joins (operator 12).

Each row is a leaf: the digest of its fields, each ``-`` if null, else its
UTF-8 byte count, a colon and the value. The leaves of one tree (here: of one
language) ascend by id. At every level the nodes are joined with themselves
on computed sibling indices: the row of slot zero in each run of ``FAN`` asks
for the nodes at its own index plus each slot offset, and emits the run's
parent. What remains of a tree is its subroot; the subroots, in the order of
their trees' names, are the leaves of the last tree, whose remaining node is
the root. A run is shorter at a tree's end, down to one node, which is
digested like any other; a tree of one leaf has that leaf as its subroot.

Positions come from ranges of (tree, id, leaf) over many partitions, so that
no task holds a tree, whatever share of the rows it has. The siblings on each
leaf's way to the root are passed down from level to level; a node has at most
``FAN`` children, so that these joins have no hot keys.

A null tree name comes before all others; a null id comes before all others
of its tree; rows of equal id ascend by their leaf, and equal rows stand side
by side, each a leaf of its own. Null and empty texts differ (``-`` and
``0:``). A row without an id is never tampered with. An empty table gives no
rows. Columns other than the five fields are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: The nodes of a run.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a digest.
WIDTH = 32


def digest(data: Column) -> Column:
    """SHA-256 of a string or binary column, as bytes."""
    return F.unhex(F.sha2(data, 256))


def as_text(digests: Column) -> Column:
    """Bytes of one or more digests as lowercase hex."""
    return F.lower(F.hex(digests))


def stated(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(F.concat(*map(stated, fields)))


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place from 0 within the tree, and ``n``, the tree's rows.

    Ranges lie over many partitions; each is counted, and the counts before it are added. The place in the input
    comes last in the order, so that equal rows, too, lie in several ranges.
    """
    keys = [tree, *order, "_input"]
    ranged = materialise(
        rows.withColumn("_input", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33))
    )
    counts = ranged.groupBy(tree, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_k"))
    # One row for each range and tree: at most as many as partitions plus trees.
    whole = Window.partitionBy(tree)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(tree, "_range", (F.coalesce(F.sum("_k").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_k").over(whole).alias("n"))
    joined = ranged.join(offsets, [tree, "_range"])
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "n")


def parents(nodes: DataFrame) -> DataFrame:
    """(tree, idx, n, run, h) of the next level: ``run`` is the children's digests in a row, ``h`` the digest of their hex text.

    The self-join: slot-zero rows ask for each index of their run, an equijoin finds the nodes there.
    """
    offsets = F.sequence(F.lit(0).cast("long"), F.least(F.lit(FAN).cast("long"), F.col("n") - F.col("idx")) - 1)
    asks = nodes.where(f"n > 1 and idx % {FAN} = 0").select("tree", "idx", "n", F.explode(offsets).alias("slot")).withColumn("sibling", F.col("idx") + F.col("slot"))
    runs = asks.join(nodes.select("tree", F.col("idx").alias("sibling"), "h"), ["tree", "sibling"]).groupBy("tree", "idx").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("slot", "h"))).alias("nodes")
    )
    run = F.aggregate("nodes", F.lit(b""), lambda all_before, x: F.concat(all_before, x["h"]))
    made = runs.select("tree", F.expr(f"idx div {FAN}").alias("idx"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), run.alias("run"))
    return made.withColumn("h", digest(as_text(F.col("run"))))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The levels of all trees, from the leaves (tree, idx, n, h) up to where each has one node."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    out = [leaves.select("tree", "idx", "n", F.lit(None).cast("binary").alias("run"), "h")]
    while most > 1:
        out.append(materialise(parents(out[-1])))
        most = -(-most // FAN)
    return out


def last_nodes(nodes: list[DataFrame]) -> DataFrame:
    """(tree, level, h) of the node that remains of each tree."""
    return reduce(DataFrame.unionByName, [x.where("n = 1").select("tree", F.lit(k).alias("level"), "h") for k, x in enumerate(nodes)])


def ways(nodes: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, idx, path and what else ``tops`` has) of each leaf: the siblings before and after it and each node above it, level by level.

    ``tops``: (tree, level, path, ...) for the node that remains of each tree; ``path`` leads on from there.
    """
    more = [c for c in tops.columns if c not in ("tree", "level", "path")]
    above = None
    for k in range(len(nodes) - 1, -1, -1):
        own = nodes[k].where("n = 1").join(tops.where(F.col("level") == k).drop("level"), "tree").select("tree", "idx", "run", "path", *more)
        if above is not None:
            up = above.select("tree", F.col("idx").alias("parent"), F.col("run").alias("family"), "path", *more)
            slot = F.expr(f"cast(idx % {FAN} as int)")
            step = F.struct(F.substring("family", F.lit(1), slot * WIDTH).alias("before"), F.substring("family", slot * WIDTH + WIDTH + 1, F.lit(FAN * WIDTH)).alias("after"))
            below = nodes[k].where("n > 1").withColumn("parent", F.expr(f"idx div {FAN}")).join(up, ["tree", "parent"])
            own = own.unionByName(below.select("tree", "idx", "run", F.concat(F.array(step), "path").alias("path"), *more))
        above = own
    return above.drop("run")


def folded(node: Column, path: Column) -> Column:
    """The root that a node (hex text) and the siblings on its way give."""
    return F.aggregate(path, node, lambda h, s: F.sha2(F.concat(as_text(s["before"]), h, as_text(s["after"])), 256))


def siblings(path: Column) -> Column:
    """The digests of all siblings on a way, level by level, left to right, as hex text."""
    return as_text(F.aggregate(path, F.lit(b""), lambda all_before, s: F.concat(all_before, s["before"], s["after"])))


NO_PATH = "cast(array() as array<struct<before:binary,after:binary>>)"


def manifest(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows``, which have their leaf's digest in ``h``, with ``path`` to the root, ``subroot`` and ``root`` (bytes)."""
    # Names that sort as asked for: null first, then by their bytes.
    named = rows.withColumn("tree", F.when(F.col(tree).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(tree))))
    leaves = materialise(placed(named, "tree", [*order, "h"]))
    nodes = levels(leaves)
    subroots = materialise(placed(last_nodes(nodes).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "level", "h"), "tree", ["name"]))
    upper = levels(subroots)
    top = last_nodes(upper).select("tree", "level", F.expr(NO_PATH).alias("path"), F.col("h").alias("root"))
    tops = subroots.select("idx", F.col("name").alias("tree"), "level", F.col("h").alias("subroot")).join(ways(upper, top).select("idx", "path", "root"), "idx").drop("idx")
    return leaves.join(ways(nodes, materialise(tops)), ["tree", "idx"]).drop("tree", "idx", "n")


def tampered(id_col: str) -> Column:
    """Whether 3 divides the checksum of the decimal id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 0, F.lit(False))


def audit(docs: DataFrame, tree: str = "lang", id_col: str = "doc_id", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest, and which rows still prove it after tampering.

    Tampering lower-cases A to Z in the texts of ``tampered`` rows; the siblings stay as they were.
    """
    changed = F.translate(text_col, UPPER, LOWER)
    again = leaf([changed if c == text_col else F.col(c) for c in fields])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(tree).alias("name"), leaf([F.col(c) for c in fields]).alias("h"), F.when(tampered(id_col), again).alias("changed"))
    whole = manifest(rows, "name", ["doc_id"])
    out = whole.select(
        F.col("doc_id").alias(id_col), as_text(F.col("h")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"), as_text(F.col("root")).alias("root"),
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(as_text(F.coalesce("changed", "h")), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether it still proves the root after tampering."""
    return audit(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same from recursive aggregates; the checksum is worked out bit by bit."""
    stated_sql = " || ".join(f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')" for c in FIELDS)
    changed_sql = stated_sql.replace("text::varchar", f"translate(text, '{UPPER}', '{LOWER}')")
    shift = "lambda c, k: xor(c >> 1, if(c & 1 = 1, 3988292384::bigint, 0::bigint))"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint), lambda c, b: list_reduce(range(8), {shift}, xor(c, b)), 4294967295::bigint), 4294967295::bigint)"
    slot, up, fewer = f"x.idx % {FAN}", f"x.idx // {FAN}", f"(x.n + {FAN - 1}) // {FAN}"
    before, after = f"array_to_string(hs[1 : {slot}], '')", f"array_to_string(hs[{slot} + 2 : {FAN}], '')"
    climb = f"select r, x.k + 1, x.tree, {up}, {fewer}, sha256({before} || acc || {after}), proof || {before} || {after}"
    grow = f"select k + 1, tree, {up}, {fewer}, sha256(string_agg(h, '' order by idx))"
    return f"""
with recursive d as (select row_number() over () as r, doc_id, coalesce('1' || lang, '0') as tree, sha256({stated_sql}) as h, case when {crc} % 3 = 0 then sha256({changed_sql}) end as changed from documents),
z as (select *, row_number() over (partition by tree order by doc_id nulls first, h, r) - 1 as idx, count(*) over (partition by tree) as n from d),
lv(k, tree, idx, n, h) as (select 0, tree, idx, n, h from z union all {grow} from lv as x where n > 1 group by k, tree, n, {up}),
sub as (select tree, h, row_number() over (order by tree) - 1 as idx, count(*) over () as n from lv where n = 1),
tv(k, tree, idx, n, h) as (select 0, '', idx, n, h from sub union all {grow} from tv as x where n > 1 group by k, tree, n, {up}),
fam as (select k, tree, {up} as p, list(h order by idx) as hs from lv as x where n > 1 group by all),
tfam as (select k, tree, {up} as p, list(h order by idx) as hs from tv as x where n > 1 group by all),
f(r, k, tree, idx, n, acc, proof) as (select r, 0, tree, idx, n, coalesce(changed, h), '' from z
  union all {climb} from f as x join fam on fam.k = x.k and fam.tree = x.tree and p = {up} where n > 1),
g(r, k, tree, idx, n, acc, proof) as (select r, 0, '', sub.idx, sub.n, acc, proof from f join sub using (tree) where f.n = 1
  union all {climb} from g as x join tfam on tfam.k = x.k and p = {up} where n > 1)
select doc_id, z.h as leaf, sub.h as subroot, tv.h as root, sha256(proof) as proof_sha256, acc as folded_root, acc = tv.h as verified
from z join sub using (tree) join g using (r) join tv on tv.n = 1 where g.n = 1"""
