"""Tasks that split into four: ids that hold the place in the tree, and sums per subtree.

The key of a root is 1; a child's key is its parent's with two more bits for
its quadrant. A task's id is the root's id and the key together, so parent,
depth and all ancestors follow from the id alone and no task needs a lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_BITS = 30  # fourteen splits and the leading 1
LARGEST_ROOT = (1 << KEY_BITS) - 2


def _one() -> Column:
    return F.lit(1).cast("bigint")


def root_of(task_id: Column) -> Column:
    """Id of the task that the tree began with."""
    return F.when(task_id <= LARGEST_ROOT, task_id).otherwise(F.shiftright(task_id, KEY_BITS) - 1).cast("bigint")


def key_of(task_id: Column) -> Column:
    return F.when(task_id <= LARGEST_ROOT, _one()).otherwise(task_id.bitwiseAND(F.lit((1 << KEY_BITS) - 1).cast("bigint")))


def id_of(root: Column, key: Column) -> Column:
    below = F.shiftleft(root.cast("bigint") + 1, KEY_BITS).bitwiseOR(key.cast("bigint"))
    return F.when(key == 1, root.cast("bigint")).otherwise(below)


def child_id(task_id: Column, quadrant: Column) -> Column:
    """Id of the child in a quadrant (0 to 3); a tree of more than fourteen splits or too large a root fails."""
    key = F.shiftleft(key_of(task_id), 2).bitwiseOR(quadrant.cast("bigint"))
    fits = (key < (1 << KEY_BITS)) & (root_of(task_id) >= 0) & (root_of(task_id) <= LARGEST_ROOT)
    return F.when(fits, id_of(root_of(task_id), key)).otherwise(F.raise_error(F.lit("no id for a child of this task")).cast("bigint"))


def parent_id(task_id: Column) -> Column:
    """Null for a root."""
    key = key_of(task_id)
    return F.when(key > 1, id_of(root_of(task_id), F.shiftright(key, 2)))


def splits_above(task_id: Column) -> Column:
    """How many splits lead from the root to the task."""
    return (F.length(F.bin(key_of(task_id))) / 2).cast("int")


def ancestors(task_id: Column) -> Column:
    """Ids from the task itself up to its root."""
    root, key = root_of(task_id), key_of(task_id)
    return F.transform(
        F.sequence(F.lit(0), splits_above(task_id)),
        lambda i: id_of(root, F.floor(key / F.pow(F.lit(4.0), i.cast("double"))).cast("bigint")),
    )


def subtree_totals(tasks: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Per task of any tree: id, root_id, parent_id, splits, tasks and the ``measures`` summed over its subtree.

    ``tasks`` has an ``id`` per row. Each row counts for itself and each of its
    at most fourteen ancestors; one aggregate, combined before the shuffle.
    Ancestors that have no row of their own get one. Rows without an id are
    left out.
    """
    known = tasks.where(F.col("id").isNotNull()).select(
        F.explode(ancestors(F.col("id"))).alias("node"), *[value.alias(name) for name, value in measures.items()]
    )
    sums = known.groupBy("node").agg(F.count(F.lit(1)).alias("tasks"), *[F.sum(name).alias(name) for name in measures])
    node = F.col("node")
    return sums.select(
        node.alias("id"), root_of(node).alias("root_id"), parent_id(node).alias("parent_id"),
        splits_above(node).alias("splits"), "tasks", *measures,
    )
