"""The conversation trie against plain dictionaries, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from metalith.llm import trie

DDL = "conv_id long, turn long, role string, text string, n int, part string, depth string, k1 string, turn_hash string"


def table(spark, rows):
    """Conversations with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, 1, "p", "d", "k", "h") for r in rows], DDL)


def fp(turn):
    return hashlib.sha256(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).hexdigest()


def plain(rows, rebuild=True):
    """The contract, node by node."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(t, key=lambda x: (*x[:2], fp(x[2])))] for c, t in own.items()}
    path = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))  # the sign of the remainder is that of c, as in SQL
        path[c] = (own.get(base, [])[:h] + turns[h:]) if rebuild else turns
    members, kids, ends = defaultdict(set), defaultdict(set), defaultdict(list)
    for c, turns in path.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[k] for k in kids[node])
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, m in members.items()
    )


def got(spark, rows, tmp_path):
    table(spark, rows).repartition(3).write.parquet(f"file://{tmp_path}/conversations.parquet")
    return sorted(tuple(r) for r in trie.op11_prefix_trie(spark, str(tmp_path)).collect())


def talk(rng, words, n):
    return [(rng.choice(("user", "bot", None)), rng.choice(words)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_trie_equals_plain_dictionaries(spark, tmp_path, seed):
    """Copies, shared openings, one long thread, null roles, texts and turns, ties of turn, repeated rows, negative ids."""
    rng = random.Random(seed)
    words = ("hi", "hé\U0001f600", "", None, "a longer line")
    opening, thread, rows = talk(rng, words, 6), talk(rng, words, 40), []
    for c in (*range(-7, 60), 10**12, 10**12 + 3):
        turns = rng.choice((lambda: opening + talk(rng, words, rng.randint(0, 5)), lambda: talk(rng, words, rng.randint(1, 10)), lambda: thread[: rng.choice((3, 39, 40))]))()
        rows += [(c, i if i else rng.choice((0, None)), *t) for i, t in enumerate(turns)]
    rows += [(3, 1, "user", "tie"), (3, 1, "bot", "tie"), (3, 1, "bot", "tie"), (None, 0, "user", "nobody"), (4, None, None, None)]
    assert got(spark, rows, tmp_path) == plain(rows)


def test_rounds_end_at_the_deepest_branching(spark, monkeypatch):
    """Copies of one long conversation are complete at once below their last branching."""
    tables, put = [], trie.Scratch.put
    monkeypatch.setattr(trie.Scratch, "put", lambda self, df, name: tables.append(name) or put(self, df, name))
    thread = [("user", f"t{i}") for i in range(60)]
    rows = [(c, i, *t) for c in range(6) for i, t in enumerate(thread)] + [(9, i, *t) for i, t in enumerate([*thread[:30], ("bot", "other")])]
    turns = trie.ordered(table(spark, rows)).withColumn("part", trie.F.lit(0))
    nodes, ends = trie.prefix_trie(turns, turns.where("n = 1"))
    out = sorted((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in nodes.collect())
    assert out == sorted(r[:7] for r in plain(rows, rebuild=False))
    assert sum(t.startswith("round") for t in tables) <= 32  # 31 nodes above the branching, none of the 60 below
    assert sorted((r["conv_id"], r["depth"]) for r in ends.collect()) == [(c, 60) for c in range(6)] + [(9, 31)]


def test_digest_runs_over_many_texts(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 7)
    ids = [*range(-30, 300), 10**15]
    ends = spark.createDataFrame([(1, 2, 3, i) for i in ids] + [(1, 2, 4, 5)], "k1 long, k2 long, depth long, conv_id long")
    out = {r["depth"]: r["ends_sha256"] for r in trie.id_digests(ends).collect()}
    assert out == {3: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 4: hashlib.sha256(b"5").hexdigest()}


def test_odd_tables(spark, tmp_path):
    assert got(spark, [], tmp_path / "a") == []
    assert got(spark, [(None, 1, "user", "x")], tmp_path / "b") == []
    turnless = [(6, 0, "user", "gone")]  # h of 6 takes its only turn, and there is no conversation 5
    assert zlib.crc32(b"6") % 9 >= 1
    assert got(spark, turnless, tmp_path / "c") == plain(turnless) == [(6, 0, None, 1, 0, 1, 0, hashlib.sha256(b"6").hexdigest())]
    long = [(1, 0, "user", "x" * 2_000_000), (2, 0, "user", "x" * 2_000_000)]
    assert got(spark, long, tmp_path / "d") == plain(long)
