"""A Merkle manifest of a table: leaves by row, a tree for each group, and a tree over the groups' roots.

H is the lowercase hex SHA-256 of its inputs one after another, digests as hex text. A row's leaf is H of its
fields. In a group, leaves ascend by order; while more than one node remains, every `fanout` consecutive ones (the
last run may have fewer, even one) become their H. What remains is the group's subroot; the subroots, ordered by
group (null first, UTF-8 bytewise), are reduced alike and give the root.

Superblock reduction: bucket i of a group holds its nodes i * fanout**LEVELS and on; applyInPandas collapses the
LEVELS lower levels of each bucket to one node, and the bucket roots are reduced in the same way until one is left.
Proofs run the other way: a bucket gets the proof of its own root and puts its lower siblings before it. So a task
holds fanout**LEVELS digests, whatever the size of a group, and the number of rounds is a logarithm of it.

Positions are counted without bringing a group to one task: rows are dealt by range of (group, order), numbered
within their partition, and the rows that earlier partitions have of the same group are added.

Defined results: a null field counts as `-`, any other as its UTF-8 byte count, `:` and its value; a null group is a
group of its own; null orders come first; rows of equal order are placed by leaf, so wholly equal rows may
swap places and proofs; an empty table has no rows and no root; other columns play no part.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Levels that one applyInPandas call collapses, and children of a node.
LEVELS, FANOUT = 10, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64


def leaf_digest(*fields: Column) -> Column:
    """H of the fields: `-` for null, else UTF-8 byte count, `:` and value (integers decimal)."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def depth(n: int, fanout: int = FANOUT) -> int:
    """Levels between n nodes and their root."""
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


def collapse(digests: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each level, the given ones first."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return out


def lower_proofs(nodes: list[list[str]], above: str, fanout: int) -> list[str]:
    """Siblings of each node of nodes[0], level by level, followed by `above`, the proof of the only node of nodes[-1]."""
    proofs = [above]
    for level in reversed(nodes[:-1]):
        own = []
        for at in range(0, len(level), fanout):
            run = level[at : at + fanout]
            own += ["".join(run[:i] + run[i + 1 :]) + proofs[at // fanout] for i in range(len(run))]
        proofs = own
    return proofs


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with idx (position in its group, from 0) and n (rows of the group)."""
    # The last key parts wholly equal rows, so that no range grows with their number.
    rows = stored(rows, "rows").withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    keys = [F.col(group), *(F.col(c).asc_nulls_first() for c in order), F.col("tie")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    dealt = stored(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "dealt")
    counts = dealt.groupBy("part", group).agg(F.count("*").alias("c"), F.min("at").alias("first"))
    own = Window.partitionBy(group)
    counts = counts.select("part", group, "first", (F.sum("c").over(own.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(own).alias("n"))
    out = dealt.join(counts, ["part", group])
    return out.withColumn("idx", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


def _bucketed(nodes: DataFrame, width: int) -> DataFrame:
    return nodes.withColumn("bucket", F.call_function("div", F.col("idx"), F.lit(width).cast("long")))


def trees(nodes: DataFrame, group: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """`nodes` (group without nulls, idx, n, digest and others) with `subroot`, the root of its group, and `proof`."""
    width, rounds = fanout**levels, []
    most = nodes.agg(F.max("n")).first()[0] or 0
    current = nodes
    kind = nodes.schema[group].dataType.simpleString()

    def roots(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["n"].iloc[0])
        digests = frame.sort_values("idx")["digest"].tolist()
        top = collapse(digests, min(levels, depth(n, fanout)), fanout)[-1][0]
        return pd.DataFrame({group: [key[0]], "idx": [key[1]], "n": [-(-n // width)], "digest": [top]})

    while True:
        rounds.append(current)
        above = _bucketed(current, width).groupBy(group, "bucket").applyInPandas(roots, f"{group} {kind}, idx bigint, n bigint, digest string")
        current = stored(above, "roots")
        if most <= width:
            break
        most = -(-most // width)
    proofs = current.select(group, F.col("idx").alias("bucket"), F.col("digest").alias("subroot"), F.lit("").alias("above"))
    for below in reversed(rounds):
        schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in below.schema)}, subroot string, proof string"

        def proved(frame: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("idx").drop(columns="bucket")
            tiers = collapse(frame["digest"].tolist(), min(levels, depth(int(frame["n"].iloc[0]), fanout)), fanout)
            return frame.assign(subroot=upper["subroot"].iloc[0], proof=lower_proofs(tiers, upper["above"].iloc[0], fanout))

        own = _bucketed(below, width).groupBy(group, "bucket").cogroup(proofs.groupBy(group, "bucket")).applyInPandas(proved, schema)
        if below is not rounds[0]:
            proofs = stored(own.select(group, F.col("idx").alias("bucket"), "subroot", F.col("proof").alias("above")), "proofs")
    return own


def manifest(rows: DataFrame, group: str, order: str, leaf: str = "leaf", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """`rows` with idx, n, subroot and proof in the group's tree, and top_idx, top_n, root and top_proof in the tree over groups."""
    others = [c for c in rows.columns if c not in (group, leaf)]
    # A key without nulls that sorts as the group does, null first.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    nodes = numbered(rows.select(key.alias("group_key"), F.col(leaf).alias("digest"), *others), "group_key", [order, "digest"])
    own = stored(trees(stored(nodes, "leaves"), "group_key", fanout, levels), "proved")
    subroots = own.where("idx = 0").select("group_key", F.col("subroot").alias("digest"), F.lit("").alias("whole"))
    top = trees(stored(numbered(subroots, "whole", ["group_key"]), "subroots"), "whole", fanout, levels)
    top = top.select("group_key", F.col("idx").alias("top_idx"), F.col("n").alias("top_n"), F.col("subroot").alias("root"), F.col("proof").alias("top_proof"))
    kind = rows.schema[group].dataType.simpleString()
    back = F.when(F.col("group_key") != "", F.expr("substring(group_key, 2)")).cast(kind).alias(group)
    # Few groups: Spark broadcasts `top` by its measured size. Many: none of them is hot, or AQE splits it.
    return own.join(stored(top, "tops"), "group_key").select(back, F.col("digest").alias(leaf), *others, "idx", "n", "subroot", "proof", "top_idx", "top_n", "root", "top_proof")


def folded(node: Column, idx: Column, n: Column, proof: Column, fanout: int = FANOUT) -> Column:
    """The root that `node`, at position idx of n, and its siblings give."""
    f, step = F.lit(fanout).cast("long"), F.lit(_HEX).cast("long")
    div = lambda a, b: F.call_function("div", a, b)
    start = F.struct(node.alias("node"), idx.cast("long").alias("p"), n.cast("long").alias("w"), F.lit(1).cast("long").alias("at"))
    # One item a level: 64 halvings cover any long; levels past the root leave the node as it is.
    levels = F.array_repeat(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double")) + F.lit(1)).cast("int"))

    def up(acc: Column, _: Column) -> Column:
        before = acc["p"] % f
        size = F.least(f, acc["w"] - acc["p"] + before)
        left = F.substr(proof, acc["at"].cast("int"), (before * step).cast("int"))
        right = F.substr(proof, (acc["at"] + before * step).cast("int"), ((size - 1 - before) * step).cast("int"))
        more = acc["w"] > 1
        return F.struct(
            F.when(more, F.sha2(F.concat(left, acc["node"], right), 256)).otherwise(acc["node"]).alias("node"),
            div(acc["p"], f).alias("p"),
            div(acc["w"] + f - 1, f).alias("w"),
            F.when(more, acc["at"] + (size - 1) * step).otherwise(acc["at"]).alias("at"),
        )

    return F.aggregate(levels, start, up, lambda acc: acc["node"])
