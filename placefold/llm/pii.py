"""Personal data: fixed kinds, and identifiers found by bootstrapped contexts.

DataFrame functions only. Java's regular expressions find the spans; their
patterns are those of the contract, written so that no text can make them
backtrack far: a run of characters is entered at its beginning or where the
last match ended, and is not given back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ID, ROW, TEXT, keyed, written

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
_TOKEN = "token"
MARK, OTHER = "", ""

_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    _TOKEN: r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+",
}
# The last two words of what lies before a token, or its only one; entered at word starts, never given back.
_LAST_WORDS = r"(?<![^\x20\x09-\x0D])((?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++)?[^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$"
HIDDEN = "#"


@dataclass(frozen=True)
class ContextRule:
    """A context is trusted if its share of known instances, rated in ``rounds``
    rounds, reaches ``min_score`` and it holds ``min_seeds`` different known
    entities; a token it then adds has ``min_digits`` digits or more."""

    rounds: int = 2
    min_score: float = 0.7
    min_seeds: int = 4
    min_digits: int = 3


def _luhn(match: Column) -> Column:
    digits = F.split(F.reverse(F.translate(match, " -", "")), "")
    worth = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")),
    )
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    ip = F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    return (
        F.when(kind == "ip", ip)
        .when(kind == "card", F.when(digits.between(13, 19), _luhn(match)).otherwise(False))
        .when(kind == "phone", digits.between(9, 15))
        .otherwise(True)
    )


def _pieces(kind: str, guard: Column) -> Column:
    """What lies between and inside the matches, in turn: (kind, idx, len, s).

    The mark around matches is replaced in the text first; no kind holds it.
    """
    marked = F.regexp_replace(F.translate(TEXT, MARK, OTHER), _PATTERNS[kind], f"{MARK}$0{MARK}")
    piece = lambda x, i: F.struct(
        F.lit(kind).alias("kind"),
        i.alias("idx"),
        F.length(x).alias("len"),
        F.when(i % 2 == 1, x).otherwise(F.regexp_extract(x, _LAST_WORDS, 1) if kind == _TOKEN else F.lit("")).alias("s"),
    )
    empty = F.array().cast("array<struct<kind:string,idx:int,len:int,s:string>>")
    return F.when(guard, F.transform(F.split(marked, MARK, -1), piece)).otherwise(empty)


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _row, kind, start, end, s, left, seed): valid spans and tokens with a digit.

    Positions are running sums over the pieces of one document. ``left`` are
    the two words before a token, another token among them as ``#``. seed says
    that a token overlaps a span of a fixed kind.
    """
    texts = keyed(docs, id_col, text_col)
    digit = F.col(TEXT).rlike("[0-9]")
    guards = {
        "email": F.instr(TEXT, "@") > 0,
        "ip": F.col(TEXT).rlike(r"[0-9]\.[0-9]"),
        "card": F.col(TEXT).rlike(r"[0-9][\x20-]?[0-9]"),
        "phone": F.instr(TEXT, "+") > 0,
        _TOKEN: digit,
    }
    # Only texts with an @, a + or a digit are looked at.
    some = texts.where(guards["email"] | guards["phone"] | digit)
    each = some.select(ID, ROW, F.explode(F.concat(*(_pieces(k, g) for k, g in guards.items()))).alias("p"))
    pieces = each.select(ID, ROW, "p.*").repartition(ID, ROW).dropDuplicates([ID, ROW, "kind", "idx"])
    in_kind = Window.partitionBy(ID, ROW, "kind").orderBy("idx")
    start = F.coalesce(F.sum("len").over(in_kind.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Token and gap take turns: before a token lie a gap, a token, a gap, a token.
    gap = lambda back: F.filter(
        F.split(F.lower(F.coalesce(F.lag("s", back).over(in_kind), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > 0
    )
    token = lambda least: F.when(F.col("idx") >= least, F.array(F.lit(HIDDEN))).otherwise(F.array().cast("array<string>"))
    before = F.concat(token(5), gap(3), token(3), gap(1))
    placed = pieces.select("*", start.alias("start"), F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), F.lit(2)).alias("left")).where("idx % 2 = 1")
    valid = placed.where(_valid(F.col("kind"), F.col("s"))).select(
        ID, ROW, "kind", "start", (F.col("start") + F.col("len")).alias("end"), "s", "left"
    )
    in_doc = Window.partitionBy(ID, ROW).orderBy("start")
    fixed = F.col("kind") != _TOKEN
    before = F.max(F.when(fixed, F.col("end"))).over(in_doc.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # Read backwards, so that the frame only ever grows.
    back = Window.partitionBy(ID, ROW).orderBy(F.desc("start"))
    after = F.min(F.when(fixed, F.col("start"))).over(back.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    seed = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    return written(valid.withColumn("seed", seed), "spans")


def _tokens(spans: DataFrame) -> DataFrame:
    """Tokens with their pattern (the two words before) and instance (a hash of the value)."""
    value = F.regexp_replace("s", r"[.,;:!?)\]}\"']+$", "")
    return (
        spans.where(F.col("kind") == _TOKEN)
        .where(F.size("left") >= 2)
        .select(
            ID, ROW, "start", (F.col("start") + F.length(value)).alias("end"), "seed",
            F.array_join("left", " ").alias("pattern"),
            F.xxhash64(F.lower(value)).alias("instance"),
            F.length(F.regexp_replace(value, "[^0-9]", "")).alias("digits"),
        )
    )


def trusted_contexts(tokens: DataFrame, rule: ContextRule) -> DataFrame:
    """Patterns that lead to known entities, rated on the graph of patterns and instances.

    A pattern is worth the mean of its instances (with one more that is worth
    nothing), an instance that is no seed the mean of its patterns. Each pair
    counts once however often it occurs, so copies lend no weight.
    """
    pairs = tokens.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    known = pairs.groupBy("instance").agg(F.max("seed").alias("known"))
    graph = written(
        pairs.select("pattern", "instance").join(known, "instance").withColumn("worth", F.col("known").cast("double")), "graph"
    )
    rated = lambda: graph.groupBy("pattern").agg(
        (F.sum("worth") / (F.count(F.lit(1)) + 1)).alias("score"), F.sum(F.col("known").cast("int")).alias("seeds")
    )
    for _ in range(rule.rounds):
        # A pattern without any worth lends none and need not be joined.
        some = rated().where("score > 0").select("pattern", "score")
        lent = graph.join(some, "pattern", "left").groupBy("instance").agg(
            F.avg(F.coalesce("score", F.lit(0.0))).alias("lent")
        )
        graph = written(
            graph.drop("worth").join(lent, "instance")
            .select("pattern", "instance", "known", F.when(F.col("known"), 1.0).otherwise(F.col("lent")).alias("worth")),
            "graph",
        )
    return rated().where((F.col("score") >= rule.min_score) & (F.col("seeds") >= rule.min_seeds)).select("pattern")


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: ContextRule = ContextRule()
) -> DataFrame:
    """Per document: ``id_col`` and spans, array of (kind, start, end).

    Kinds, in their order: email, ip (parts up to 255), card (13 to 19 digits,
    Luhn), phone (9 to 15 digits), and context: tokens with digits that no
    other kind overlaps, after two words that the corpus uses before known
    entities. Spans are sorted by kind and start, count code points and exclude
    the end. Null and empty texts have no spans; rows that agree in id and text
    get the same spans; other columns are not read.
    """
    spans = _spans(docs, id_col, text_col)
    tokens = _tokens(spans)
    added = (
        tokens.where(~F.col("seed") & (F.col("digits") >= rule.min_digits))
        .join(trusted_contexts(tokens, rule), "pattern")
        .select(ID, ROW, F.lit(CONTEXT).alias("kind"), "start", "end")
    )
    fixed = spans.where(F.col("kind") != _TOKEN).select(ID, ROW, "kind", "start", "end")
    order = F.array_position(F.array(*map(F.lit, (*KINDS, CONTEXT))), F.col("kind"))
    listed = (
        fixed.unionByName(added)
        .groupBy(F.col(ID).alias("_i"), F.col(ROW).alias("_r"))
        .agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "start", "end", "kind"))).alias("spans"))
    )
    rows = keyed(docs, id_col, text_col).select(ID, ROW)
    span = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    joined = rows.join(listed, rows[ID].eqNullSafe(F.col("_i")) & (rows[ROW] == F.col("_r")), "left")
    return joined.select(F.col(ID).alias(id_col), F.coalesce(F.transform("spans", span), none).alias("spans"))
