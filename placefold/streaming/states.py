"""Micro-batches folded into mergeable states in shared storage.

Each micro-batch writes its own digest under its batch id, so its cost grows
with the batch, not with the table, and a replayed batch overwrites itself.
Readers combine the digests; compaction replaces older ones by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..workspace import child_dirs, path_exists, remove_dir

Fold = Callable[[DataFrame], DataFrame]


def prepare(empty: DataFrame, root: str) -> None:
    """Say what the states look like, so that they can be read before the first batch."""
    if not path_exists(empty.sparkSession, f"{root}/schema/_SUCCESS"):
        empty.limit(0).write.mode("overwrite").parquet(f"{root}/schema")


def write_batch(states: DataFrame, root: str, batch_id: int) -> None:
    states.write.mode("overwrite").parquet(f"{root}/batches/{batch_id}")


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n) for n in child_dirs(spark, folder) if n.isdigit())


def _finished(spark: SparkSession, folder: str) -> bool:
    return path_exists(spark, f"{folder}/_SUCCESS")


def state_paths(spark: SparkSession, root: str, before: int | None = None) -> tuple[list[str], int]:
    """Folders that make up the current state, and the last batch they cover.

    Only batches behind the newest finished base are looked at, so the cost
    follows what was written since. ``before`` leaves out that batch and later ones.
    """
    known = lambda n: before is None or n < before
    bases = (n for n in reversed(_numbers(spark, f"{root}/base")) if known(n))
    base = next((n for n in bases if _finished(spark, f"{root}/base/{n}")), -1)
    later = [n for n in _numbers(spark, f"{root}/batches") if n > base and known(n)]
    later = [n for n in later if _finished(spark, f"{root}/batches/{n}")]
    paths = [f"{root}/base/{base}"] if base >= 0 else []
    return paths + [f"{root}/batches/{n}" for n in later], max([base, *later])


def read_states(
    spark: SparkSession, root: str, combine: Fold, empty: DataFrame | None = None, before: int | None = None
) -> DataFrame:
    """The combined state; no rows where no batch is finished yet.

    What the rows look like then says ``empty``, or the folder that ``prepare`` wrote.
    """
    paths, _ = state_paths(spark, root, before)
    if not paths and empty is not None:
        return combine(empty)
    return combine(spark.read.parquet(*(paths or [f"{root}/schema"])))


def compact(spark: SparkSession, root: str, combine: Fold) -> int:
    """Fold everything so far into one base; returns the batch it covers."""
    paths, upto = state_paths(spark, root)
    if len(paths) > 1:
        combine(spark.read.parquet(*paths)).write.mode("overwrite").parquet(f"{root}/base/{upto}")
    return upto


def retain(spark: SparkSession, root: str, bases: int = 2) -> None:
    """Delete batches that a base covers, and all but the newest ``bases`` bases.

    Readers that have listed an older base meanwhile keep theirs while it is
    one of the newest; nothing is deleted before a finished base covers it.
    """
    done = [n for n in _numbers(spark, f"{root}/base") if _finished(spark, f"{root}/base/{n}")]
    kept = done[-bases:]
    for n in done[:-bases]:
        remove_dir(spark, f"{root}/base/{n}")
    for n in _numbers(spark, f"{root}/batches"):
        if kept and n <= kept[0]:
            remove_dir(spark, f"{root}/batches/{n}")
