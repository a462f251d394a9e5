"""Merkle manifest of a table, and a proof for each of its rows, by a recursive query that climbs the stored levels.

A row is a leaf: the hash of doc_id, source, lang, n_chars and text, each `-` if null, else its UTF-8 byte count, `:`
and its value. The leaves of a source, by doc_id, form a tree in which each FANOUT consecutive nodes become their hash, level by
level, until one node is left, the subroot. The subroots, by source, form a tree of the same kind; its root is the
manifest. All digests are hashed as lower-case hex text; they are stored as bytes.

Levels are built bottom up, one aggregation each. Every node but the root is stored as a row with its parent, the digests of its
run on its left and on its right. `climb` then is one recursive query: it starts with the leaves, and each step joins a
node's row, hashes its siblings around what it has folded so far, appends them as a row of the proof, and goes on to the
parent. Rows of nodes that many leaves pass are salted: there is a copy for each LEAVES_PER_COPY leaves below, so that no
join key holds more rows than that. The proof's rows are put together by leaf at the end.

Defined cases: null fields are `-` (an empty text is `0:`); a null doc_id comes first in its source and is never tampered with; rows with
equal doc_id are ordered by digest; repeated rows are leaves of their own with equal digests, so all give the same rows; a null source is a
source of its own, before all others; a run may have a single node, which is hashed all the same; a lone leaf is its subroot, and a lone subroot the root, with the
hash of nothing as proof; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.ordering import row_numbers
from ..sources.scratch import keep
from .common import attach, settle

FANOUT = 3
#: Leaves that climb through one copy of a node's row.
LEAVES_PER_COPY = 10_000
#: Rows of a level that a task writes at least; a level has about a third of the rows of the one below.
ROWS_PER_TASK = 50_000
#: The tree over the subroots.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts: Column) -> Column:
    """SHA-256 of the digests' hex text, as bytes; null parts are left out. A part may hold several digests."""
    return F.unhex(F.sha2(F.concat(*[F.lower(F.hex(F.coalesce(p, F.lit(b"")))) for p in parts]), 256))


def leaf(fields: list[Column]) -> Column:
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def height(n: Column) -> Column:
    """Levels above n leaves until one node is left."""
    return F.size(F.filter(F.array(*[F.lit(FANOUT ** k) for k in range(38)]), lambda power: power < n))


def leaves(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, doc_id, digest, tampered, tree, pos, height), key distinct, tampered null where the leaf is as it was; and
    trees (tree, n). Trees number the sources in order, pos the leaves of each."""
    fields = [F.col(f"`{c}`") for c in FIELDS]
    broken = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("source"),
        leaf(fields).alias("digest"), F.when(broken, leaf([*fields[:-1], F.replace("text", F.lit("\n"), F.lit(""))])).alias("tampered"))
    order = ["named", "source", F.col("doc_id").asc_nulls_first(), "digest"]
    # keys rise with the order, without gaps inside a part
    parted = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id())
                    .withColumn("part", F.spark_partition_id()))
    spans = settle(parted.groupBy("named", "source", "part").agg(F.min("key").alias("first"), F.count("*").alias("n")))
    sources = spans.groupBy("named", "source").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    trees = settle(row_numbers(sources, ["first"], out="tree").select("named", "source", (F.col("tree") - 1).alias("tree"), F.col("n").alias("total"), "parts"))
    n_spans = spans.count()
    before = Window.partitionBy("named", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = attach(spans, trees, ["named", "source"], n_spans, "parts").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    facts = settle(placed.select("named", "source", "part", "n", "tree", height(F.col("total")).alias("height"), (F.col("before") - F.col("first")).alias("shift")))
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    numbered = attach(parted, facts, ["named", "source", "part"], total).select(
        "key", "doc_id", "digest", "tampered", "tree", (F.col("key") + F.col("shift")).alias("pos"), "height")
    return numbered, trees.select("tree", F.col("total").alias("n"))


def runs(level: DataFrame) -> DataFrame:
    """(tree, height, up, leaves, children): FANOUT consecutive nodes at most, each with all its columns, by pos; up is the parent's pos."""
    child = F.struct("pos", *[c for c in level.columns if c not in ("tree", "height", "pos")])
    return level.groupBy("tree", "height", F.floor(F.col("pos") / FANOUT).cast("long").alias("up")).agg(
        F.sum("leaves").alias("leaves"), F.array_sort(F.collect_list(child)).alias("children"))


def siblings(k: int) -> tuple[Column, Column]:
    """The digests on the left and on the right of the child at index k."""
    of = lambda i: F.coalesce(F.get("children", F.lit(i))["digest"], F.lit(b""))
    many = lambda ks: F.concat(*[of(i) for i in ks]) if ks else F.lit(b"")
    return many(range(k)), many(range(k + 1, FANOUT))


def linked(made: DataFrame, level: int, columns: list[str]) -> DataFrame:
    """A row for each child of the runs of a level: its place, left, right, where its parent is, how many leaves that has,
    and the parent's digest where it is a subroot. `columns` are more columns of the child."""
    kids = F.array(*[F.struct(F.get("children", F.lit(k)).alias("child"), *[c.alias(n) for n, c in zip(("left", "right"), siblings(k))]) for k in range(FANOUT)])
    over = (F.col("tree") != TOP) & (F.col("height") == level + 1)  # the parent is the subroot, a leaf of the tree on top
    return made.select("*", F.explode(kids).alias("kid")).where("kid.child is not null").select(
        "tree", F.lit(level).alias("level"), "kid.child.pos", "kid.left", "kid.right", "kid.child.leaves", *[f"kid.child.{c}" for c in columns],
        F.when(over, F.lit(TOP).cast("long")).otherwise(F.col("tree")).alias("up_tree"), F.when(over, F.lit(0)).otherwise(F.lit(level + 1)).alias("up_level"),
        F.when(over, F.col("tree")).otherwise(F.col("up")).alias("up_pos"), F.col("leaves").alias("up_leaves"), F.when(over, F.col("digest")).alias("subroot"))


def build(level: DataFrame, levels: int, n: int, carried: list[str]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Nodes with their links, level by level, and the rows (tree, digest, leaves) of trees that end at each level. `level` has
    tree, pos, height, digest, leaves and the columns `carried`, which only the rows of the lowest level keep."""
    nodes, ends = [], []
    for k in range(levels):
        done = level.where(F.col("height") == k)
        ends.append(done)
        made = runs(level.where(F.col("height") > k)).withColumn("digest", hashed(*[F.get("children", F.lit(i))["digest"] for i in range(FANOUT)]))
        n = -(-n // FANOUT)
        made = settle(made.coalesce(-(-n // ROWS_PER_TASK)) if k else made)
        nodes.append(linked(made, k, carried if k == 0 else []))
        level = made.select("tree", F.col("up").alias("pos"), "height", "digest", "leaves")
    return nodes, [*ends, level]


CLIMB = """
    WITH RECURSIVE climb(key, step, tree, level, pos, copy, folded, siblings, subroot) AS (
        SELECT key, 0, up_tree, up_level, up_pos, pmod(xxhash64(key), cast(ceil(up_leaves / {per}) AS BIGINT)),
               unhex(sha2(concat(lower(hex(left)), lower(hex(coalesce(tampered, digest))), lower(hex(right))), 256)), concat(left, right), subroot
        FROM {base}
        UNION ALL
        SELECT c.key, c.step + 1, n.up_tree, n.up_level, n.up_pos, pmod(xxhash64(c.key), cast(ceil(n.up_leaves / {per}) AS BIGINT)),
               unhex(sha2(concat(lower(hex(n.left)), lower(hex(c.folded)), lower(hex(n.right))), 256)), concat(n.left, n.right), n.subroot
        FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.level = n.level AND c.pos = n.pos AND c.copy = n.copy)
    SELECT key, step, folded, siblings, subroot FROM climb LIMIT ALL"""


def climb(spark: SparkSession, base: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each leaf of `base` and step up to the root: key, step, folded, siblings, subroot (where the step ends at it)."""
    copies = F.ceil(F.col("leaves") / LEAVES_PER_COPY).cast("long")
    # a table of its own, since every step of the recursion reads it: its plan is a scan
    copied, _ = keep(nodes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy")).drop("leaves"), "merkle")
    return spark.sql(CLIMB.format(per=LEAVES_PER_COPY, base="{base}", nodes="{nodes}"), base=base, nodes=copied)


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, a row for each document."""
    spark = documents.sparkSession
    rows, trees = leaves(documents)
    n_trees, most, n = trees.agg(F.count("*"), F.coalesce(F.max(height(F.col("n"))), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not n:
        return spark.createDataFrame([], schema)
    own = ["key", "doc_id", "digest", "tampered"]
    level = rows.withColumn("leaves", F.lit(1).cast("long"))
    lone = settle(level.where("height = 0"))  # a source with one row: its leaf is a leaf of the tree on top
    nodes, ends = build(level, most, n, own)
    subroots = _union([e.select("tree", "digest", "leaves") for e in (lone, *ends[1:])])
    levels = next(k for k in range(38) if FANOUT ** k >= n_trees)
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(levels).alias("height"), "digest", "leaves")
    top_nodes, top_ends = build(settle(top), levels, n_trees, [])
    root = bytes(top_ends[-1].select("digest").first()[0])

    # a lone leaf is a leaf of the tree on top
    start = ["key", "doc_id", "digest", "tampered", "left", "right", "up_tree", "up_level", "up_pos", "up_leaves", "subroot"]
    if top_nodes:
        lone = lone.select(*own, F.col("tree").alias("pos"), F.col("digest").alias("subroot")).join(
            top_nodes[0].select("pos", "left", "right", "up_tree", "up_level", "up_pos", "up_leaves"), "pos").select(*start)
        base = _union([x.select(*start) for x in nodes[:1]] + [lone])
    elif nodes:
        base = nodes[0].select(*start)
    else:  # one row in all
        base = None
    none, blank = F.lit(b""), F.lit(None).cast("binary")
    if base is None:
        known = lone
        path = lone.select("key", F.lit(0).alias("step"), F.coalesce("tampered", "digest").alias("folded"), none.alias("siblings"), F.col("digest").alias("subroot"))
    else:
        linking = ["tree", "level", "pos", "leaves", "left", "right", "up_tree", "up_level", "up_pos", "up_leaves", "subroot"]
        above = [x.select(*linking) for x in (*nodes[1:], *top_nodes)] or [nodes[0].select(*linking).where("false")]
        base, _ = keep(base, "merkle")
        known = base
        path = climb(spark, base, _union(above))
    known = known.select("key", F.lit(-1).alias("step"), blank.alias("folded"), none.alias("siblings"), blank.alias("subroot"), "doc_id", "digest")
    path = path.select("key", "step", "folded", "siblings", "subroot", F.lit(None).cast("long").alias("doc_id"), blank.alias("digest"))
    proof = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "siblings"))), lambda x: F.lower(F.hex(x["siblings"]))), "")
    hexed = lambda c: F.lower(F.hex(c))
    told = known.unionByName(path).groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("digest").alias("leaf"), F.max("subroot").alias("subroot"),
        F.sha2(proof, 256).alias("proof_sha256"), F.max_by("folded", "step").alias("folded"))
    return told.select("doc_id", hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), F.lit(root.hex()).alias("root"), "proof_sha256",
                       hexed("folded").alias("folded_root"), (hexed("folded") == F.lit(root.hex())).alias("verified"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
