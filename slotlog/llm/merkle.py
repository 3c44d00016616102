"""Merkle dataset manifest (13): sibling-shift self-joins.

Every row is a leaf, every value of the group column a tree of its own, and the roots of these trees are the leaves of one
last tree. The nodes of a level are numbered from 0 in their tree. To find what stands beside a node, each node is offered at
the computed places of its siblings (place XOR 1 for binary trees, else the other slots of its run), and one equijoin on
(tree, place) brings them together. The rows in slot zero then hold a whole run and emit its parent. A level
has a ``fanout``-th of the rows of the one below, so all levels together cost little more than the first one. Texts are
only read for their digest and never move; places are spread evenly, however large one tree is.

Proofs go the other way: a node's path is its own siblings and then its parent's path, joined level by level from
the top, so a long path moves once per parent and not once per leaf.

Defined results: a null in any field counts as ``-`` in the digest, a null group is a tree of its own and comes first; rows
with equal ids lie beside each other by digest, rows with a null id first; a group of one row has its leaf as root; an empty table has no
rows; other columns are ignored. A null id is never tampered with.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotlog.session import cut_lineage

FANOUT = 8
#: Rows of one range when leaves are put in order.
RANGE_ROWS = 1_000_000
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(c: Column) -> Column:
    """A value with its length in bytes before it, so that no two lists of fields give the same text."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def as_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def lower_ascii(text: Column) -> Column:
    return F.when(text.rlike("[A-Z]"), F.translate(text, CAPITALS, CAPITALS.lower())).otherwise(text)


def leaves(docs: DataFrame, fields: Sequence[str], id_col: str, group_col: str, text_col: str, remainder: int) -> DataFrame:
    """tree, doc_id, digest and, where text is tampered with, the digest it then has.

    ``remainder`` divides the crc32 of the id of a row that is tampered with.
    """
    c = {n: docs[n].cast("long") if n == id_col else docs[n] for n in fields}
    same = F.concat(*[field(c[n]) for n in fields])
    other = F.concat(*[field(lower_ascii(c[n]) if n == text_col else c[n]) for n in fields])
    picked = F.crc32(docs[id_col].cast("long").cast("string")) % remainder == 0
    # Spark orders text by bytes; the sign before a name keeps null apart from the empty name and first.
    tree = F.when(docs[group_col].isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), docs[group_col].cast("string")))
    return docs.select(tree.alias("tree"), docs[id_col].cast("long").alias("doc_id"), digest(same).alias("digest"),
                       F.when(picked, digest(other)).alias("changed"))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with ``tree``) plus ``place`` (0-based in the tree by ``order``) and ``n`` (rows of the tree).

    Rows are put in order by ranges and get their place from one count per range and tree, so no tree has to fit a task.
    Rows that are equal in everything are told apart by their place in the stored table.
    """
    spark = rows.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / RANGE_ROWS))
    by = ["tree", *order, "row"]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(shards, *by).sortWithinPartitions(*by)
    ranged = cut_lineage(ranged.drop("row").withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    ranged = ranged.withColumn("shard", F.shiftright("at", 33))
    parts = ranged.groupBy("tree", "shard").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    w = Window.partitionBy("tree")
    parts = parts.select("tree", "shard", "first", F.sum("size").over(w).alias("n"),
                         (F.sum("size").over(w.orderBy("shard")) - F.col("size")).alias("before"))
    joined = ranged.join(parts, ["tree", "shard"])
    return joined.select(*rows.columns, (F.col("before") + F.col("at") - F.col("first")).alias("place"), "n")


def with_siblings(nodes: DataFrame, fanout: int, carry: Sequence[str] = ()) -> DataFrame:
    """``nodes`` (tree, place, n, digest) with the digests ``left`` and ``right`` of each in its run, one after the other."""
    place, slot = F.col("place"), F.pmod(F.col("place"), F.lit(fanout))
    if fanout == 2:
        places = [place.bitwiseXOR(F.lit(1).cast("long"))]
    else:
        places = [place - slot + F.pmod(slot + k, F.lit(fanout)) for k in range(1, fanout)]
    offered = nodes.select("tree", F.explode(F.array(*places)).alias("place"), "n", slot.alias("from"), F.col("digest").alias("sibling"))
    offered = offered.filter("place < n").drop("n")
    found = nodes.join(offered, ["tree", "place"], "left").groupBy("tree", "place").agg(
        *[F.first(c).alias(c) for c in ("n", "digest", *carry)],
        *[F.max(F.when(F.col("from") == k, F.col("sibling"))).alias(f"slot_{k}") for k in range(fanout)])
    none = F.lit(b"")
    return found.select(
        "tree", "place", "n", "digest", *carry,
        F.concat(*[F.when(slot > k, F.col(f"slot_{k}")).otherwise(none) for k in range(fanout - 1)]).alias("left"),
        F.concat(*[F.when(slot < k, F.coalesce(f"slot_{k}", none)).otherwise(none) for k in range(1, fanout)]).alias("right"))


def parents(level: DataFrame, fanout: int) -> DataFrame:
    """One node from each row in slot zero, which has its whole run beside it."""
    return level.filter(F.pmod("place", F.lit(fanout)) == 0).select(
        "tree", F.floor(F.col("place") / fanout).cast("long").alias("place"), F.ceil(F.col("n") / fanout).cast("long").alias("n"),
        digest(as_hex(F.concat("digest", "right"))).alias("digest"))


def build(nodes: DataFrame, fanout: int, carry: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The levels below the roots, each stored with its siblings, and one root for each tree (tree, digest)."""
    size = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = [], [nodes.filter("n = 1").select("tree", "digest")]
    while size > 1:
        levels.append(cut_lineage(with_siblings(nodes.filter("n > 1"), fanout, () if levels else carry), "merkle-level"))
        nodes = parents(levels[-1], fanout)
        roots.append(nodes.filter("n = 1").select("tree", "digest"))
        size = math.ceil(size / fanout)
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, cut_lineage(out, "merkle-roots")


def with_paths(nodes: DataFrame, levels: list[DataFrame], fanout: int, carry: Sequence[str] = ()) -> DataFrame:
    """tree, digest, the carried columns and ``path`` of the lowest level: the siblings of each node on the way to the root."""
    step = F.array(F.struct("left", "right"))
    lone = nodes.filter("n = 1").select("tree", "digest", *carry, F.slice(F.array(F.struct(F.lit(b"").alias("left"), F.lit(b"").alias("right"))), 1, 0).alias("path"))
    if not levels:
        return lone
    above = levels[-1].select("tree", "place", step.alias("path"), *(["digest", *carry] if len(levels) == 1 else []))
    for i in range(len(levels) - 2, -1, -1):
        up = above.select("tree", F.col("place").alias("up"), F.col("path").alias("above"))
        level = levels[i].withColumn("up", F.floor(F.col("place") / fanout).cast("long")).join(up, ["tree", "up"], "left")
        above = level.select("tree", "place", F.when(F.col("above").isNull(), step).otherwise(F.concat(step, F.col("above"))).alias("path"),
                             *(["digest", *carry] if i == 0 else []))
    return above.select("tree", "digest", *carry, "path").unionByName(lone)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf (hex) and the siblings on its way give."""
    return F.aggregate(path, start, lambda below, s: F.sha2(F.concat(as_hex(s["left"]), below, as_hex(s["right"])), 256))


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id",
             group_col: str = "lang", text_col: str = "text", fanout: int = FANOUT, remainder: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row.

    ``folded_root`` is the root from the siblings and the leaf, of tampered text where ``remainder`` divides the id's crc32.
    """
    carry = ("doc_id", "changed")
    nodes = numbered(cut_lineage(leaves(docs, fields, id_col, group_col, text_col, remainder), "merkle-leaves"), ["doc_id", "digest"])
    levels, subroots = build(nodes, fanout, carry)
    tops = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "digest"), ["member"])
    top_levels, roots = build(tops, fanout, ("member",))
    root = roots.first()
    upper = with_paths(tops, top_levels, fanout, ("member",)).select(
        F.col("member").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("upper"))
    rows = with_paths(nodes, levels, fanout, carry).join(upper, "tree").withColumn("path", F.concat("path", "upper"))
    root_hex = F.lit(root.digest.hex() if root else None).cast("string")
    rows = rows.select("doc_id", as_hex(F.col("digest")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), root_hex.alias("root"),
                       F.sha2(F.array_join(F.transform("path", lambda s: as_hex(F.concat(s["left"], s["right"]))), ""), 256).alias("proof_sha256"),
                       fold(as_hex(F.coalesce("changed", "digest")), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_field(c: str) -> str:
    return f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || cast({c} as varchar) end"


def _sql_levels(prefix: str, below: str, depth: int) -> str:
    """Levels 0 to ``depth`` of the trees in ``below`` (tree, i, n, d), each with left and right siblings."""
    out = []
    for k in range(depth + 1):
        nodes = below if k == 0 else (
            f"(select tree, i // 8 as i, (n + 7) // 8 as n, case when n = 1 then min(d) else sha256(string_agg(d, '' order by i)) end as d "
            f"from {prefix}{k - 1} group by tree, i // 8, n)")
        run = "partition by tree, i // 8 order by i rows between"
        out.append(f"""{prefix}{k} as (select tree, i, n, d,
          coalesce(string_agg(d, '') over ({run} unbounded preceding and 1 preceding), '') as l,
          coalesce(string_agg(d, '') over ({run} 1 following and unbounded following), '') as r from {nodes} x)""")
    return ",\n".join(out)


def _sql_fold(prefix: str, name: str, source: str, depth: int) -> str:
    """``source`` (tree, i, acc, proof and more) taken up ``depth`` levels."""
    out = []
    for k in range(depth):
        before = source if k == 0 else f"{name}{k - 1}"
        out.append(f"""{name}{k} as (select a.* replace (a.i // 8 as i, case when b.n = 1 then acc else sha256(b.l || acc || b.r) end as acc,
            proof || b.l || b.r as proof) from {before} a join {prefix}{k} b on a.tree = b.tree and a.i = b.i)""")
    return ",\n".join(out)


def oracle(depth: int = 8, top_depth: int = 3) -> str:
    """The same rows in DuckDB for up to 8 ** depth rows in a language and 8 ** top_depth languages; crc32 bit by bit."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    low = f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda d, s: xor(d >> 1, (d & 1) * 3988292384))"
    crc = (f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint)), "
           f"lambda c, b: {bits}), 4294967295::bigint)")
    return f"""
    with leaves as (select doc_id, coalesce('+' || lang, '') as tree, sha256({" || ".join(_sql_field(c) for c in fields)}) as d,
        sha256({" || ".join(_sql_field(low if c == "text" else c) for c in fields)}) as other,
        coalesce({crc} % 3 = 0, false) as picked from documents),
      placed as (select *, row_number() over (partition by tree order by doc_id nulls first, d) - 1 as i, count(*) over (partition by tree) as n from leaves),
      {_sql_levels("t", "placed", depth)},
      tops as (select '' as tree, tree as member, d, row_number() over (order by tree) - 1 as i, count(*) over () as n from t{depth}),
      {_sql_levels("u", "tops", top_depth)},
      start as (select doc_id, tree, i, d as leaf, case when picked then other else d end as acc, '' as proof from placed),
      {_sql_fold("t", "f", "start", depth)},
      lifted as (select f.doc_id, f.leaf, f.acc, f.proof, '' as tree, tops.i, tops.d as subroot from f{depth - 1} f join tops on f.tree = tops.member),
      {_sql_fold("u", "g", "lifted", top_depth)}
    select doc_id, leaf, subroot, u.d as root, sha256(proof) as proof_sha256, acc as folded_root, acc = u.d as verified
    from g{top_depth - 1} g join u{top_depth} u using (tree)"""
