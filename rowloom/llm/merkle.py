"""Merkle manifest of a corpus: a digest for each row, source and the whole, with proofs.

The tree has three children a node. A *group* (a source; or all sources, for the
tree above them) is cut into blocks of ``3 ** LEVELS`` consecutive nodes. Inside a
block, nodes stay on the row of their first leaf: the node ``i`` of level ``k`` is on
the row at ``i * 3 ** k``. So its siblings are on rows at fixed offsets, which are lag
and lead columns, masked by the slot of the node in its run and by the length of
that run; the row of the first child then hashes the parent. One exchange and one
sort serve all levels of a block, the tops of the blocks are the next step's
nodes, and a hot source is only more blocks.

Rows are numbered by a range sort whose tasks write their rows with their place;
only one line per task and group is summed. Texts are hashed where they are read and not moved.

Defined results: a null column is the field ``-``; a null ``doc_id`` comes first and is
never tampered with. Rows that share source and doc_id ascend by leaf digest, equal
rows are leaves of their own. An empty text is ``0:``. Very long texts are hashed
whole. Other columns are ignored, whatever their names. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import key_column, write_table

ARITY = 3
# Levels that one step builds; a block is 3 ** 6 = 729 rows.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value that cannot be mistaken for its neighbours: its length in bytes, then itself."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``leaf`` and ``seen``: the leaf of the row as it is and as it is found later."""

    def leaf(text: Column) -> Column:
        return digest(*(field(text if name == "text" else F.col(name)) for name in FIELDS))

    own = leaf(F.col("text"))
    return docs.select("doc_id", "source", own.alias("leaf"), (own if tampered_text is None else leaf(tampered_text)).alias("seen"))


def without_newlines_if_even() -> Column:
    """The text of a row whose id has an even CRC-32, without its newlines; null for other rows."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


# --- places ------------------------------------------------------------------


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Add ``pos``, the 0-based place in ``order`` within the group, and ``n``, the rows of the group.

    Equal rows are told apart by the task and line they are read at.
    """
    name = f"merkle-{group}"
    sorted_ = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(group), *(F.col(c).asc_nulls_first() for c in order), F.col("_tie")]
    sorted_ = sorted_.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    kept = write_table(sorted_.withColumn("_place", F.monotonically_increasing_id()), name)
    kept = kept.withColumn("_task", F.shiftright("_place", 33))
    runs = kept.groupBy(group, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    whole = Window.partitionBy(group).orderBy("_task")
    earlier = F.coalesce(F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = runs.select(group, "_task", (earlier - F.col("_first")).alias("_shift"), total.alias("n"))
    return kept.join(starts, [group, "_task"]).select(
        *rows.columns, (F.col("_shift") + F.col("_place")).alias("pos"), F.col("n").cast("bigint").alias("n")
    )


# --- levels --------------------------------------------------------------------


def _div(value: Column, size: int) -> Column:
    return F.call_function("div", value, F.lit(size).cast("bigint"))


def climb(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The next ``levels`` levels over ``nodes``: ``group``, ``pos``, ``n`` and ``node``.

    Adds ``top``, the node that the first row of each block ends with, and ``path``: for
    each level that the group still has, the digests left and right of the
    row's ancestor in its run. A group of one node has no level left.
    """
    block = _div(F.col("pos"), ARITY**levels).alias("block")
    rows = nodes.select("*", block).withColumn("_at", F.col("node"))
    run = Window.partitionBy("group", "block").orderBy("pos")
    for level in range(levels):
        step = ARITY**level
        index = _div(F.col("pos"), step)
        slot = F.col("_slot")
        # Nodes of the level, of its run, and whether this row holds one of them.
        count = _div(F.col("n") + (step - 1), step)
        rows = rows.withColumns(
            {
                "_slot": (index % ARITY).cast("int"),
                "_run": F.least(F.lit(ARITY).cast("bigint"), count - (index - index % ARITY)).cast("int"),
                "_held": (F.col("pos") % step == 0) & (count > 1),
            }
        )

        def beside(offset: int, at: Column = F.col("_at"), step: int = step) -> Column:
            """The node so many places to the right, where the run has one; else nothing."""
            there = slot + offset
            node = F.lag(at, -offset * step).over(run) if offset < 0 else F.lead(at, offset * step).over(run)
            return F.when((there >= 0) & (there < F.col("_run")), node).otherwise(F.lit(""))

        around = {offset: beside(offset) for offset in (*range(1 - ARITY, 0), *range(1, ARITY))}
        rows = rows.withColumns({f"_b{offset}": node for offset, node in around.items()})
        left = F.concat(*(F.col(f"_b{offset}") for offset in range(1 - ARITY, 0)))
        right = F.concat(*(F.col(f"_b{offset}") for offset in range(1, ARITY)))
        rows = rows.withColumns(
            {
                f"_p{level}": F.when(F.col("_held"), F.struct(left.alias("left"), right.alias("right"))),
                "_at": F.when(
                    F.col("_held") & (slot == 0), digest(F.col("_at"), right)
                ).otherwise(F.col("_at")),
            }
        ).drop(*(f"_b{offset}" for offset in around), "_slot", "_run", "_held")
    # The last row before or at this one that holds a node of a level is the first row of its ancestor.
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paths = [f"_p{level}" for level in range(levels)]
    rows = rows.withColumns({name: F.last(name, ignorenulls=True).over(so_far) for name in paths})
    return rows.withColumn("path", F.array_compact(F.array(*paths))).withColumnRenamed("_at", "top").drop(*paths)


def tree(nodes: DataFrame, name: str, levels: int = LEVELS) -> DataFrame:
    """Whole trees: ``nodes`` (``group``, ``pos``, ``n``, ``node``) with ``path`` up to the top, and ``top``.

    Each step is written; there are as many as powers of a block in the largest group.
    """
    block = ARITY**levels
    steps = [write_table(climb(nodes, levels), f"{name}-0")]
    while (steps[-1].agg(F.max("n")).first()[0] or 0) > block:
        tops = steps[-1].filter(F.col("pos") % block == 0)
        above = tops.select(
            "group", F.col("block").alias("pos"), _div(F.col("n") + (block - 1), block).alias("n"), F.col("top").alias("node")
        )
        steps.append(write_table(climb(above, levels), f"{name}-{len(steps)}"))
    result = steps.pop()
    # In the last step each group is one block: its first row has the top.
    tops = result.filter(F.col("pos") == 0).select("group", F.col("top").alias("_top"))
    result = result.join(tops, "group").drop("top", "block").withColumnRenamed("_top", "top")
    while steps:
        above = result.select("group", F.col("pos").alias("block"), F.col("path").alias("_above"), F.col("top").alias("_top"))
        below = steps.pop().drop("top").join(above, ["group", "block"])
        result = below.withColumns({"path": F.concat("path", "_above"), "top": F.col("_top")}).drop("_above", "_top", "block")
    return result


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``rows`` (see ``leaves``) with ``subroot``, ``root`` and ``path``, the proof of each leaf.

    ``path`` has one (left, right) pair of digests a level, first through the
    source's tree, then through the tree of sources: hashing left, node, right level by
    level gives the root.
    """
    written = write_table(rows.withColumn("group", key_column(F.col("source"))), "merkle-leaves")
    in_source = placed(written, "group", "doc_id", "leaf")
    in_source = tree(in_source.withColumnRenamed("leaf", "node"), "merkle-source", levels)
    # The first row of each source stands for it; "null" is no prefix "=", so nulls are told apart.
    sources = in_source.filter(F.col("pos") == 0).select(
        F.lit("all").alias("group"), F.col("group").alias("source_key"), "source", F.col("top").alias("node")
    )
    over = tree(placed(write_table(sources, "merkle-subroots"), "group", "source"), "merkle-root", levels)
    over = over.select(
        F.col("source_key").alias("group"), F.col("path").alias("_over"), F.col("node").alias("subroot"), F.col("top").alias("root")
    )
    return in_source.join(over, "group").select(
        "doc_id", "source", F.col("node").alias("leaf"), "seen", "subroot", "root", F.concat("path", "_over").alias("path")
    )


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf up, left to right."""
    return digest(F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a proof."""
    return F.aggregate(path, leaf, lambda node, level: digest(level["left"], node, level["right"]))


def verify(rows: DataFrame) -> DataFrame:
    """Per row of ``manifest``: its digests and whether the row as it is found still gives the root."""
    found = folded(F.col("seen"), F.col("path"))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        siblings_digest(F.col("path")).alias("proof_sha256"),
        found.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def audit(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``docs``, and the check of a copy in which the newlines of every second row are gone."""
    tampered = F.coalesce(without_newlines_if_even(), F.col("text"))
    return verify(manifest(leaves(docs, tampered), levels))
