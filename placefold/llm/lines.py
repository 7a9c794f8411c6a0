"""Line dedup by overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, PACKED, ROW, TEXT, keyed, packed, unpacked

WIDTH = 3
SEEN = r"[^\x20\x09-\x0D]"


def later_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_i, _r, starts): sorted first lines of the windows that occurred before.

    Each window is a 128-bit hash of three lines. The first place of a window
    is a minimum, combined before the shuffle, so a window that a third of all
    documents share is a few rows per task; the join that follows has one row
    per repeated window on one side and can be split on the other.
    """
    lines = F.split(F.coalesce(TEXT, F.lit("")), "\n")
    parted = keyed(docs, id_col, text_col).select(ID, ROW, lines.alias("_lines"))
    n = F.greatest(F.size("_lines") - (WIDTH - 1), F.lit(0))
    shifted = [F.slice("_lines", k + 1, n).alias(f"l{k}") for k in range(WIDTH)]
    each = parted.select(ID, ROW, F.posexplode(F.arrays_zip(*shifted)).alias("_pos", "w"))
    own = [F.col("w")[f"l{k}"] for k in range(WIDTH)]
    windows = each.where(F.concat(*own).rlike(SEEN)).select(
        F.struct(ID, ROW, "_pos").alias("at"), F.xxhash64(*own).alias("ka"), F.xxhash64(F.lit(WIDTH), *own).alias("kb")
    )
    repeated = (
        windows.groupBy("ka", "kb").agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .where("first != last").select("ka", "kb", "first")
    )
    later = windows.join(repeated, ["ka", "kb"]).where("at != first").select("at.*")
    return later.groupBy(F.col(ID).alias("_i"), F.col(ROW).alias("_r")).agg(F.array_sort(F.collect_set("_pos")).alias("starts"))


def _with_kept(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Packed rows of ``docs`` with _lines and _kept, the lines outside all later windows.

    Covered positions merge by looking at neighbours: what stays between two
    starts is what lies behind the end of the first window.
    """
    rows = packed(docs, id_col, text_col, without=(text_col,))
    lines = F.split(F.coalesce(TEXT, F.lit("")), "\n")
    # The lines are the text; one copy of it is shuffled.
    split = rows.select(PACKED, ID, ROW, F.col(TEXT).isNull().alias("_null"), lines.alias("_lines"))
    marks = later_windows(docs, id_col, text_col)
    joined = split.join(marks.hint("shuffle_hash"), F.col(ID).eqNullSafe(F.col("_i")) & (F.col(ROW) == F.col("_r")), "left")
    borders = F.arrays_zip(
        F.concat(F.array(F.lit(-WIDTH)), "starts").alias("a"), F.concat("starts", F.array(F.size("_lines"))).alias("b")
    )
    between = F.transform(
        borders, lambda g: F.slice("_lines", g["a"] + WIDTH + 1, F.greatest(g["b"] - g["a"] - WIDTH, F.lit(0)))
    )
    kept = F.when(F.col("starts").isNull(), F.col("_lines")).otherwise(F.flatten(between))
    return joined.withColumn("_kept", kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, n_lines, n_removed, kept (its text without repeats).

    Lines are what ``\\n`` separates, compared as they are. Three consecutive
    lines, one of them not blank, are a window. The first window with given
    lines, in the order of id (null first), text hash and position, stays; of
    every later one all lines go, also where another window covers them too.
    A line that goes is equal to an earlier line, so every line that the
    corpus has stays somewhere. Texts of fewer than three lines, null and empty
    ones lose nothing (null is read as empty, with one line). Rows that agree
    in id and text are one document and get the same result.
    """
    return _with_kept(docs.select(id_col, text_col), id_col, text_col).select(
        F.col(ID).alias(id_col),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_removed"),
        F.array_join("_kept", "\n").alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with shortened texts; other columns stay, untouched texts too (null stays null).

    A document goes if it had a non-blank line and none is left.
    """
    done = _with_kept(docs, id_col, text_col)
    kept = F.array_join("_kept", "\n")
    left = done.where(F.col("starts").isNull() | kept.rlike(SEEN))
    text = F.when(~F.col("_null"), kept).alias(text_col)
    return left.select(*(text if c == text_col else unpacked(docs, c) for c in docs.columns))


SQL = r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), w AS (
  SELECT doc_id, p, lines[p] AS a, lines[p + 1] AS b, lines[p + 2] AS c
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS p FROM l)
), later AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k
    FROM w WHERE regexp_matches(a || b || c, '[^\x20\x09-\x0D]')
  ) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, p + d AS p FROM later, (VALUES (0), (1), (2)) AS t(d)
), each AS (
  SELECT doc_id, lines[p] AS line, p FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS p FROM l)
)
SELECT e.doc_id,
       count(*) AS n_lines,
       count(g.p) AS n_removed,
       sha256(coalesce(string_agg(e.line, chr(10) ORDER BY e.p) FILTER (WHERE g.p IS NULL), '')) AS kept_sha256
FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p
GROUP BY e.doc_id
"""
