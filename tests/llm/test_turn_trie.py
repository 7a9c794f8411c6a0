"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from placefold.llm import turn_trie
from placefold.llm.queries import QUERIES, op11_turn_trie, rebuilt

COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]
SCHEMA = "conv_id long, turn long, role string, text string"


def digest(turn):
    return hashlib.md5(f"{len(turn[0].encode())}:{turn[0]}:{turn[1]}".encode()).hexdigest()


def by_conversation(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            pair = (role or "", text or "")
            own[conv].append((turn is not None, turn or 0, digest(pair), pair))
    return {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(first, [])[:h] + turns[h:]
    return out


def plain_trie(conversations):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in conversations.items():
        path = tuple(turns)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = own + sum(saved[k] for k in children[node])
    return sorted(
        (
            min(members[p]), len(p), min(members[p[:-1]]) if p else -1, len(members[p]), len(children[p]), leaves[p],
            saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p in members
    )


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def random_rows(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 6 * n), n):
        for turn in range(rng.choice([1, 2, 3, 5, 9, 12, 40]) if rng.random() < 0.9 else 60):
            word = rng.choice("aab") if rng.random() < 0.8 else "é" * rng.randint(0, 3)
            rows.append((c, turn, rng.choice(["user", "user", None, ""]), rng.choice([word, word, None])))
    rows += [(5000 + c, t, "user", "same") for c in range(200) for t in range(30)]  # copies, longer than the dealt turns
    rows += [(9000, t % 3, "r", str(t)) for t in range(9)] + [(9001, None, "x", "y"), (9001, 0, "x", "z")]
    rows += [(9002, 1, "x", "twice")] * 3 + [(None, 1, "x", "nobody's")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [1, 7, 300, 100_000])
def test_trie_against_dictionary(spark, shard_turns):
    rows = random_rows(shard_turns)
    turns = spark.createDataFrame([(*r, 1, "q") for r in rows], SCHEMA + ", path int, n string")
    got = turn_trie.trie_nodes(turn_trie.turn_sequences(turns), shard_turns)
    assert rows_of(got) == plain_trie(by_conversation(rows))


def test_rebuilt_conversations(spark):
    rows = random_rows(99, 120)
    own = by_conversation(rows)
    turns = spark.createDataFrame(rows, SCHEMA)
    got = turn_trie.trie_nodes(rebuilt(turn_trie.turn_sequences(turns)), 50)
    assert any(not t for t in rebuild(own).values())  # turnless ones are members of the root
    assert rows_of(got) == plain_trie(rebuild(own))


def test_query_against_dictionary(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op11_turn_trie(spark, sf_dir)) == plain_trie(rebuild(by_conversation(rows)))
    assert "op11_turn_trie" in QUERIES


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows_of(turn_trie.conversation_trie(empty)) == []
    assert rows_of(turn_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []


def test_median_order_balances_siblings():
    tree = turn_trie.TernaryTree()
    order = list(turn_trie.medians(1000))
    assert sorted(order) == list(range(1000))
    for i in order:
        tree.insert([i], [1], i)
    deepest, level = 0, [tree.down[0]]
    while level:
        deepest += 1
        level = [s for node in level for s in (tree.lower[node], tree.higher[node]) if s]
    assert deepest <= 10


def test_deep_conversation_needs_no_recursion(spark):
    rows = [(c, t, "u", str(t if t < 2999 else (t, c))) for c in (1, 2) for t in range(3000)]
    got = rows_of(turn_trie.trie_nodes(turn_trie.turn_sequences(spark.createDataFrame(rows, SCHEMA)), 10))
    assert got == plain_trie(by_conversation(rows))
