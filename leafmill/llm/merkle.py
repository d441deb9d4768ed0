"""Merkle manifest of a table: a digest per row, a root per group of rows, a root of all, and a proof for each row.

Rows of a group stand in order; every `fan` consecutive digests become the digest of their parent, level by
level, until one remains: the group's root. The groups' roots, in order, make the root of all in the same way.

Bottom up: a row's place in its group comes from one sort by range. Each range counts its rows of each group, the
running sum of those counts (a row per group and range) tells where a range begins in the group, so a group that holds most rows is
never in one task. All groups climb in lockstep, and every level is a written table whose rows are runs of at most `fan` children.
Top down: a proof is pushed from parents to children. A child joins its parent, and puts its own siblings before
the proof that the parent has; the lowest join moves each run's proof once, not each row's. Keys of all these joins have at most
`fan` rows, so nothing is skewed.

Contract for odd input: a null field is written as `-`, an empty one as `0:`; a null group is a group of its own, the
first; in a group null keys come first and rows with the same key stand in the order of their digests, so rows that
repeat have leaves of their own beside each other; a group of one row has that row's leaf as its root; an empty table gives no rows; columns that are not
asked for are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

FAN = 3
#: One step of a proof: what stands before a node in its run, and what stands after it.
STEP = "struct<left: binary, right: binary>"


def field(name: str) -> Column:
    """A value with its length in bytes, so that no two rows are written alike."""
    text = F.col(name).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*values), 256))


def digits(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows, written in order, with part and seq; and by group and part its first seq, how many rows of the group stand in parts before, and how many
    the group has in all."""
    parts = storage.partitions_for(rows)
    dealt = rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    dealt = storage.materialize(dealt.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), name)
    held = dealt.groupBy(*group, "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    every = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.sum("n").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return dealt, held.select(*group, "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(every).alias("size"))


def _climb(nodes: DataFrame, largest: int, fan: int, name: str) -> list[DataFrame]:
    """Levels above nodes (g, pos, size, digest): runs of children with their own digest, place and the number of nodes of their level in the group."""
    levels, at = [], nodes
    while largest > 1:
        runs = at.filter("size > 1").groupBy("g", F.floor(F.col("pos") / fan).alias("pos"))
        runs = runs.agg(F.first("size").alias("was"), F.array_sort(F.collect_list(F.struct("pos", "digest")))["digest"].alias("children"))
        digest = leaf(*[F.coalesce(digits(F.get("children", F.lit(i))), F.lit("")) for i in range(fan)])
        at = storage.materialize(runs.select("g", "pos", F.ceil(F.col("was") / fan).alias("size"), "children", digest.alias("digest")), f"{name}_level")
        levels.append(at)
        largest = -(-largest // fan)
    return levels


def _step(place: Column, children: Column, fan: int) -> Column:
    """The siblings of the child at that place of its run."""
    joined = lambda test: F.aggregate(F.filter(children, lambda x, i: test(i)), F.lit(b""), lambda a, x: F.concat(a, x))
    return F.struct(joined(lambda i: i < place).alias("left"), joined(lambda i: i > place).alias("right"))


def _inherit(nodes: DataFrame, parents: DataFrame, fan: int) -> DataFrame:
    """nodes (g, pos, ...) with the proof and subroot that they get from their parents (g, pos, children, proof, subroot)."""
    up = parents.select("g", F.col("pos").alias("above"), F.col("children").alias("run"), F.col("proof").alias("rest"), "subroot")
    met = nodes.withColumn("above", F.floor(F.col("pos") / fan)).join(up, ["g", "above"])
    return met.withColumn("proof", F.concat(F.array(_step(F.pmod("pos", F.lit(fan)), F.col("run"), fan)), "rest")).drop("above", "run", "rest")


def _push(base: DataFrame, levels: list[DataFrame], tops: DataFrame, fan: int, name: str) -> DataFrame:
    """base (g, pos, size, ...) with proof and subroot, pushed down from the tops (g, proof, subroot) through the levels."""
    above = None
    for k in range(len(levels), -1, -1):
        level = levels[k - 1] if k else base
        own = level.filter("size = 1").join(tops, "g")
        found = own if above is None else _inherit(level.filter("size > 1"), above, fan).unionByName(own)
        if not k:
            return found
        above = storage.materialize(found, f"{name}_proofs")
    raise AssertionError


def manifest(leaves: DataFrame, group: str, key: str, digest: str, fan: int = FAN, carried: tuple[str, ...] = ()) -> tuple[DataFrame, str | None]:
    """A row per row of leaves: key, leaf, subroot, proof (from the leaf to the root, an array of left and right siblings) and the carried columns; and
    the root in hexadecimal digits. leaves: a table that is cheap to read, with a digest of 32 bytes a row."""
    own = [F.col(c).alias(f"carried{i}") for i, c in enumerate(carried)]
    rows = leaves.select(F.col(group).alias("grp"), F.col(key).alias("key"), F.col(digest).alias("digest"), *own)
    dealt, spots = _ranked(rows, ["grp"], ["key", "digest"], "merkle_leaves")
    spots = storage.materialize(spots, "merkle_spots")
    groups, ranks = _ranked(spots.groupBy("grp").agg(F.max("size").alias("n")), [], ["grp"], "merkle_groups")
    numbered = groups.join(ranks.select("part", "first", "before"), "part").select("grp", (F.col("seq") - F.col("first") + F.col("before")).alias("g"))
    numbered = storage.materialize(numbered, "merkle_numbers")
    most = spots.agg(F.max("size").alias("size"), F.countDistinct("grp").alias("some"), F.max(F.col("grp").isNull().cast("int")).alias("none")).first()
    if most.size is None:
        return dealt.select("key", F.col("digest").alias("leaf"), F.lit(None).cast("binary").alias("subroot"), F.array().cast(f"array<{STEP}>").alias("proof"), *[F.col(f"carried{i}").alias(c) for i, c in enumerate(carried)]), None
    n_groups = most.some + most.none
    where = spots.join(numbered.withColumnRenamed("grp", "of"), F.col("grp").eqNullSafe(F.col("of"))).select(F.col("grp").alias("of"), F.col("part").alias("in_part"), "first", "before", "size", "g")
    placed = dealt.join(where, F.col("grp").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")))
    base = storage.materialize(placed.select("g", (F.col("seq") - F.col("first") + F.col("before")).alias("pos"), "size", "digest", "key", *[f"carried{i}" for i in range(len(carried))]), "merkle_base")
    levels = _climb(base.select("g", "pos", "size", "digest"), most.size, fan, "merkle")
    tops = reduce(DataFrame.unionByName, [x.filter("size = 1").select("g", "digest") for x in [base, *levels]])
    crowns = storage.materialize(tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(n_groups).cast("long").alias("size"), "digest"), "merkle_tops")
    upper = _climb(crowns, n_groups, fan, "merkle_upper")
    root = (upper[-1] if upper else crowns).select(digits(F.col("digest")).alias("root")).first().root
    end = crowns.sparkSession.range(1).select(F.col("id").alias("g"), F.array().cast(f"array<{STEP}>").alias("proof"), F.lit(b"").alias("subroot"))
    of_group = _push(crowns, upper, end, fan, "merkle_upper").select(F.col("pos").alias("g"), "proof", F.col("digest").alias("subroot"))
    found = _push(base, levels, storage.materialize(of_group, "merkle_group_proofs"), fan, "merkle")
    return found.select("key", F.col("digest").alias("leaf"), "subroot", "proof", *[F.col(f"carried{i}").alias(c) for i, c in enumerate(carried)]), root


def proof_text(proof: Column) -> Column:
    """All siblings of a proof in hexadecimal digits, from the leaf up, left to right."""
    return digits(F.aggregate(proof, F.lit(b""), lambda a, p: F.concat(a, p["left"], p["right"])))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf (32 bytes) and a proof lead to, in hexadecimal digits."""
    return F.aggregate(proof, digits(start), lambda a, p: F.sha2(F.concat(digits(p["left"]), a, digits(p["right"])), 256))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def audit(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """The manifest of docs, and what becomes of each row's check where the text of the tampered rows is the changed one: doc_id, leaf,
    subroot, root, proof_sha256, folded_root, verified."""
    fields = [field(c) for c in FIELDS]
    moved = F.when(changed.isNull(), "-").otherwise(F.concat(F.octet_length(changed).cast("string"), F.lit(":"), changed))
    both = docs.select("doc_id", "source", leaf(*fields).alias("digest"), F.when(F.coalesce(tampered, F.lit(False)), leaf(*fields[:-1], moved)).alias("moved"))
    leaves = storage.materialize(both, "merkle_digests")
    rows, root = manifest(leaves, "source", "doc_id", "digest", carried=("moved",))
    out = rows.select(F.col("key").alias("doc_id"), digits(F.col("leaf")).alias("leaf"), digits(F.col("subroot")).alias("subroot"), F.lit(root).cast("string").alias("root"), F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), folded(F.coalesce("moved", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
