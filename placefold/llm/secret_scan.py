"""Secret scans: fixed patterns, and values in credential contexts that are costly to guess."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, id_type, keyed, text_slices, written

BASE_KINDS = ("assign", "access", "hex")
GUESS = "guess"

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more, found whole
_CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|bearer|credentials?|"
    r"(?:api|access|auth|private|secret)[_-]?key)"
    r"[\"']?\s{0,4}(?:=>|:=|[:=]|\bis\b:?)\s{0,4}[\"']?([^\s\"',;<>()\[\]{}]{6,})",
    re.A | re.I,
)
_HINTS = ("pass", "pwd", "pin", "secret", "token", "bearer", "credential", "key")

# The commonest password words, by falling frequency.
COMMON_WORDS = (
    "password love dragon monkey master admin welcome login shadow sunshine princess football "
    "baseball superman batman michael jordan hunter killer charlie jessica jennifer daniel thomas "
    "robert george andrew summer winter spring autumn flower cheese pepper ginger cookie coffee "
    "orange purple yellow silver golden diamond secret letmein trustno iloveyou starwars computer "
    "internet server root test guest user system access token key pass changeme default example "
    "hello world freedom whatever ninja mustang harley ranger soccer hockey tigger buster joshua "
    "matthew amanda ashley nicole hannah samantha london paris berlin boston dallas phoenix eagle "
    "tiger lion wolf bear horse snoopy mickey banana apple chocolate family friend happy angel "
    "heaven jesus money business office google amazon january february march april june july august "
    "september october november december monday friday the and for you this that with from your"
).split()

# Rows of a keyboard.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
LEET = str.maketrans("@4301!|5$7", "aaeoiiisst")

_DATE = re.compile(
    r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d|(?:19|20)\d\d)"
)
DATE_LENGTHS = (4, 6, 7, 8, 9, 10)
LEAST_PART = 3  # characters of a run or a walk
LONGEST_BLOCK = 32
FIRST_LOOK = 512
DATE_BITS = math.log2(366 * 120)
REACH = 40  # of a longer run, walk or repeat, only ends so near to either of its ends can be cheapest


def _neighbours() -> dict[str, set[str]]:
    """Keys that touch; each row is set half a key right of the one above."""
    at = {c: (r, i + r * 0.5) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}
    return {
        c: {d for d, (s, y) in at.items() if d != c and abs(s - r) <= 1 and abs(y - x) <= 1}
        for c, (r, x) in at.items()
    }


@dataclass(frozen=True)
class GuessRule:
    """A value is a secret if guessing it costs ``min_bits`` or more.

    ``words`` are known words, cheapest first. Without a list the commonest
    password words come first and then the corpus's own, at most ``learned`` of
    ``LEARNED_LETTERS`` letters, by how often it has them.
    """

    min_bits: float = 40.0
    words: tuple[str, ...] | None = None
    learned: int = 50_000


LEARNED_LETTERS = (3, 20)


def learn_words(docs: DataFrame, text_col: str = "text", most: int = 50_000) -> tuple[str, ...]:
    """The ``most`` frequent words of all texts at most, by falling frequency.

    Counted by Spark over whole texts. The cut is made at a frequency, found
    from a histogram of some hundred classes, so that only words above it
    reach the driver; words of the class that would exceed the bound stay out.
    """
    low, high = LEARNED_LETTERS
    words = F.explode(F.split(F.lower(F.col(text_col).cast("string")), "[^a-z]+")).alias("word")
    counts = docs.select(words).where(F.length("word").between(low, high)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    known = written(counts.where("n > 2"), "words").withColumn("class", F.floor(8 * F.log2("n")).cast("int"))
    sizes = {r["class"]: r["m"] for r in known.groupBy("class").agg(F.count(F.lit(1)).alias("m")).collect()}
    least, total = None, 0
    for c in sorted(sizes, reverse=True):
        total += sizes[c]
        if total > most:
            break
        least = c
    if least is None:
        return ()
    rows = known.where(F.col("class") >= least).select("word", "n").collect()
    return tuple(r.word for r in sorted(rows, key=lambda r: (-r.n, r.word)))


def _ends(first: int, last: int, step: int = 1) -> list[int]:
    """Ends of parts from ``first`` to ``last``; of very many only those near either end."""
    every = range(first, last + 1, step)
    return list(every) if len(every) <= 2 * REACH else [*every[:REACH], *every[-REACH:]]


class GuessCost:
    """Bits needed to guess a value: the cheapest way to cut it into parts.

    Parts are listed words (any case, usual digit swaps), dates, runs of one
    character, blocks that are repeated, keyboard walks, and brute-force spans,
    which cost the size of the value's alphabet per character. Each part costs
    one bit to begin; a run, a walk and the number of repeats cost the logarithm
    of their length more, a repeated block what it costs itself. Parts may
    begin and end anywhere. Of a run, walk or repeat with more than 80 possible
    ends only the 40 nearest to either end are tried: what is left over has to
    be covered by other parts, and any of these costs more than it saves.
    """

    def __init__(self, words: tuple[str, ...] = COMMON_WORDS) -> None:
        self.rank = {w: i for i, w in reversed(list(enumerate(dict.fromkeys(words), 2)))}
        self.longest = max(map(len, self.rank), default=0)
        self.touch = _neighbours()
        self.blocks: dict[str, float] = {}

    def word_cost(self, part: str) -> float:
        """Without the bit to begin; infinite if it is no listed word."""
        low = part.lower()
        if len(low) != len(part):  # some letters grow when lowered
            low = part
        plain = low.translate(LEET)
        costs = [
            math.log2(self.rank[form]) + (part != form) + (form != low) for form in {low, plain} if form in self.rank
        ]
        return min(costs, default=math.inf)

    @staticmethod
    def char_cost(value: str) -> float:
        size = (
            10 * any("0" <= c <= "9" for c in value)
            + 26 * any("a" <= c <= "z" for c in value)
            + 26 * any("A" <= c <= "Z" for c in value)
            + 33 * any(c.isascii() and not c.isalnum() for c in value)
            + 100 * (not value.isascii())
        )
        return math.log2(size)

    @staticmethod
    def walk_cost(length: int, turns: int) -> float:
        return math.log2(47) + math.log2(length) + 2.0 + 2.0 * min(turns, length // 3 + 1)

    def block_cost(self, block: str) -> float:
        if block not in self.blocks:
            if len(self.blocks) > 10_000:
                self.blocks.clear()
            self.blocks[block] = self(block)
        return self.blocks[block]

    def __call__(self, value: str, limit: float = math.inf) -> float:
        """The least cost, or ``limit`` if that is less."""
        char = self.char_cost(value) if value else 0.0
        # Most long values are random: no cut of their beginning stays below the limit.
        if len(value) > FIRST_LOOK and limit < math.inf:
            _, furthest = self._least(value[:FIRST_LOOK], char, limit)
            if furthest < FIRST_LOOK - REACH:
                return limit
        return min(self._least(value, char, limit)[0], limit)

    def _least(self, value: str, char: float, limit: float) -> tuple[float, int]:
        """Least cost of the value, and the last place that some cut reaches below the limit."""
        n = len(value)
        keys = value.lower().translate(SHIFTED)
        if len(keys) != n:
            keys = value.translate(SHIFTED)
        # Where the run, the walk and the repeats of blocks that begin at i end; turns of walks up to i.
        run, walk, turns = [n] * n, [n] * n, [0] * n
        for i in range(n - 2, -1, -1):
            run[i] = run[i + 1] if value[i] == value[i + 1] else i + 1
            walk[i] = walk[i + 1] if keys[i + 1] in self.touch.get(keys[i], ()) else i + 1
        for i in range(2, n):
            turns[i] = turns[i - 1] + (ord(keys[i]) - ord(keys[i - 1]) != ord(keys[i - 1]) - ord(keys[i - 2]))
        repeats = {}
        for b in range(2, min(LONGEST_BLOCK, n // 2) + 1):
            far = [n - b] * (n - b + 1)  # up to where characters equal those a block on
            for i in range(n - b - 1, -1, -1):
                far[i] = far[i + 1] if value[i] == value[i + b] else i
            repeats[b] = far
        best = [0.0] + [math.inf] * n  # of value[:i], ending a part
        brute = math.inf  # of value[:i], inside a brute-force span
        furthest = 0

        def reach(j: int, cost: float) -> None:
            nonlocal furthest
            if cost < best[j]:
                best[j] = cost
                if cost < limit:
                    furthest = max(furthest, j)

        for i in range(n):
            if i > furthest:
                break
            here = best[i] + 1.0
            brute = min(brute, here) + char
            reach(i + 1, brute)
            if here >= limit:
                continue
            for j in range(i + 1, min(n, i + self.longest) + 1):
                cost = self.word_cost(value[i:j])
                if cost < math.inf:
                    reach(j, here + cost)
            if value[i].isdigit():
                for j in (i + k for k in DATE_LENGTHS if i + k <= n):
                    if _DATE.fullmatch(value, i, j):
                        reach(j, here + DATE_BITS)
            for j in _ends(i + LEAST_PART, run[i]):
                reach(j, here + char + math.log2(j - i))
            for j in _ends(i + LEAST_PART, walk[i]):
                reach(j, here + self.walk_cost(j - i, turns[j - 1] - turns[i + 1]))
            for b, far in repeats.items():
                if i <= n - 2 * b and far[i] - i >= b:
                    own = self.block_cost(value[i : i + b])
                    for j in _ends(i + 2 * b, i + (far[i] - i) // b * b + b, b):
                        reach(j, here + own + math.log2((j - i) // b))
        return best[n], furthest


def find_secrets(text: str, cost: GuessCost, min_bits: float) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start; added spans overlap no base span."""
    found = []
    lowered = text.lower()
    hinted = any(h in lowered for h in _HINTS)
    if hinted or not text.isascii():  # lower() may change what surrounds other letters
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if hinted:
        taken = list(found)
        for m in _CONTEXT.finditer(text):
            a, b = m.span(1)
            if any(a < e and s < b for _, s, e in taken):
                continue
            if cost(m[1].rstrip(".!?:"), min_bits) >= min_bits:
                found.append((GUESS, a, b))
    order = {k: i for i, k in enumerate((*BASE_KINDS, GUESS))}
    return sorted(found, key=lambda f: (f[1], order[f[0]]))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: GuessRule = GuessRule()
) -> DataFrame:
    """Secret spans of each document: ``id_col``, spans array of (kind, start, end).

    Kinds: assign, access and hex by fixed patterns; guess for a value in a
    credential context (after "password is", "auth_key =" ...) that no fixed
    pattern covers and whose cheapest segmentation costs ``rule.min_bits``.
    Offsets count code points, ends are exclusive, order is by start. Null and
    empty texts have no spans; repeated rows are scanned one by one, alike;
    other columns are not read. Where no words are given, one count over whole
    texts learns them first; the scan itself is one pass without a shuffle.
    """
    words = rule.words
    if words is None:
        words = (*COMMON_WORDS, *learn_words(docs, text_col, rule.learned))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        cost = GuessCost(words)
        for part, texts in text_slices(batches):
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t, cost, rule.min_bits)]
                for t in texts
            ]
            ids = part.column(part.schema.get_field_index(ID))
            yield pa.record_batch([ids, pa.array(spans, span)], names=[ID, "spans"])

    kind = id_type(docs, id_col)
    read = keyed(docs, id_col, text_col).select(ID, TEXT)
    found = read.mapInArrow(scan, f"{ID} {kind}, spans array<struct<kind:string,start:long,end:long>>")
    return found.select(F.col(ID).alias(id_col), "spans")
