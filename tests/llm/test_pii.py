"""Personal data, against the patterns as the contract states them."""

import collections
import hashlib
import re

from placefold.llm import pii
from placefold.llm.queries import QUERIES


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def plain(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def spans(row):
    return [(s.kind, s.start, s.end) for s in row.spans]


HARD = [
    "a@b.c_d@e.f x@y.z.w. @a.b a@@b.c a@b a@b..c é1.x@y-z.co 🙂🙂 q@r.st", "a@b.c-d@e.f .%+-@-.- me@x.y,you@x.y",
    "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.400 0001.002.03.4 1.2.3 v1.2.3.4x 00000000000000000000001.1.1.1 256.1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111112 4111111111111 1 2 3", "4111 1111 1111 1111-1",
    "+1 (988) 555-2485 ++49 30 1234567 +1 +12 +1 2 +1(2)3(4)5(6)7(8)9(0)1 +1 555 ( +123456789012345678", "+1 (988) 555-2485-",
    "a@b.cd  +1 (988) 555-2485", "über +1 (988) 555-2485 ñ 10.0.0.1",
    "1" * 20_000, "a" * 20_000, "a@" + "b." * 20_000, "1." * 20_000, "1 " * 20_000, "+1" + " " * 20_000, "a@b.c " * 3000,
]


def test_fixed_kinds_against_plain_patterns(frame):
    rows = [*enumerate(HARD), (3, HARD[3]), (3, HARD[3]), (3, HARD[4]), (None, HARD[0]), (90, None), (91, "")]
    got = pii.find_personal_data(frame(rows).repartition(4)).collect()
    want = collections.Counter((i, tuple(plain(t or ""))) for i, t in rows)
    assert collections.Counter((r.doc_id, tuple(s for s in spans(r) if s[0] != "context")) for r in got) == want


def test_query_against_plain_patterns(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op9_personal_data"][0](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        kinds = collections.Counter(k for k, _, _ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.KINDS)
        assert r.spans.startswith(joined)


def test_contexts_of_known_entities_find_unknown_ones(frame):
    rows = [(i, f"Please write to ann{i}@mail.example at once.") for i in range(8)]
    rows += [(20, "Please write to bob7731(at)mail.example now"), (21, "chapter 12345 and write 12345 lines")]
    rows += [(30 + i, f"as shown in figure 10{i}.") for i in range(9)] + [(50, "it was shown in figure 7@x.example")]
    got = {r.doc_id: [s for s in spans(r) if s[0] == "context"] for r in pii.find_personal_data(frame(rows)).collect()}
    text = rows[8][1]
    assert got.pop(20) == [("context", text.index("bob"), text.index(" now"))]
    assert not any(got.values())


def test_empty_and_odd_tables(frame, odd):
    assert pii.find_personal_data(frame([])).count() == 0
    assert pii.find_personal_data(odd).count() == odd.count()


def test_no_python_in_the_plan(frame):
    plan = pii.find_personal_data(frame([(1, "x@y.zz")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas"))


def test_many_tokens_in_one_document(frame):
    """The time for a document grows with its tokens, not with their square."""
    import time

    def seconds(rows):
        begin = time.perf_counter()
        pii.find_personal_data(frame(rows)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    many = [(i, f"number n{i}") for i in range(60_000)]
    seconds(many[:100])
    spread = seconds(many)
    assert seconds([(1, " ".join(f"n{i} and number" for i in range(60_000)))]) < 2 * spread + 2


def test_words_before_a_token(frame):
    """The last two words whatever lies between; other tokens are hidden; whole words, however long."""
    long = "w" * 300
    texts = [
        f"{long} {long}  \n x1", "one 22", "33", "44 55", "44 55 66", "call me 7 or 8 now 9", "a b c1 d e2 f g3", "7 call 8", f"x {long}\ty9",
    ]
    found = pii._spans(frame(list(enumerate(texts))), "doc_id", "text").where("kind = 'token'").collect()
    got = {(r._id, r.s): r.left for r in found}

    def plain(text):
        words = re.split(r"[\x20\x09-\x0D]+", text.lower())
        for i, w in enumerate(words):
            if re.search("[0-9]", w):
                yield w, ["#" if re.search("[0-9]", x) else x for x in words[max(0, i - 2) : i]]

    assert got == {(i, w): left for i, t in enumerate(texts) for w, left in plain(t)}


def test_scores_against_a_plain_loop(spark):
    """Patterns and instances rate each other in rounds."""
    import random

    rng = random.Random(6)
    rows = []
    for _ in range(900):
        p = rng.randrange(25)
        i = rng.randrange(40) if rng.random() < 0.5 else p * 10 + rng.randrange(6)
        rows.append((f"p{p}", i, i % 3 != 0 if p % 2 else i % 5 == 0))
    tokens = spark.createDataFrame(rows, "pattern string, instance long, seed boolean")
    for rule in (pii.ContextRule(min_score=0.4, min_seeds=2), pii.ContextRule(rounds=0, min_score=0.3), pii.ContextRule(rounds=4, min_score=0.5)):
        pairs = {(p, i) for p, i, _ in rows}
        known = {i: any(s for _, j, s in rows if j == i) for _, i, _ in rows}
        worth = {i: float(known[i]) for i in known}
        of_pattern = collections.defaultdict(list)
        of_instance = collections.defaultdict(list)
        for p, i in pairs:
            of_pattern[p].append(i)
            of_instance[i].append(p)
        score = lambda: {p: sum(worth[i] for i in own) / (len(own) + 1) for p, own in of_pattern.items()}
        for _ in range(rule.rounds):
            now = score()
            worth = {i: 1.0 if known[i] else sum(now[p] for p in ps) / len(ps) for i, ps in of_instance.items()}
        want = {p for p, s in score().items() if s >= rule.min_score and sum(known[i] for i in of_pattern[p]) >= rule.min_seeds}
        assert {r.pattern for r in pii.trusted_contexts(tokens, rule).collect()} == want and want
