"""The prefix trie against a plain dictionary of tuples."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from sparktally.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, part long, i long"


def table(spark, rows):
    """conversations with columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def brute(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    seq = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c in seq:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(seq.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + seq[c][h:])
    members = collections.defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * words(p)
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows):
    got = prefix_trie.prefix_trie(table(spark, rows)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute(rows))


def made(seed):
    rng = random.Random(seed)
    say = ["", "a b", "a  b", "c", "d e f", "x" * 5000, None, "日本 語"]
    rows = []
    for c in range(90):
        n = rng.choice([1, 1, 2, 3, 5, 9])
        rows += [(c, t, rng.choice(["user", "system", None]), rng.choice(say[:4])) for t in range(n)]
    for c in range(200, 240):  # a hot group of copies, and one conversation far longer than others
        rows += [(c, t, "user", "a b") for t in range(4)]
    rows += [(260, t, "user", f"turn {t % 3}") for t in range(300)] + [(261, t, "user", f"turn {t % 3}") for t in range(290)]
    rows += [(-7, 0, "user", "a b"), (-40, 3, "user", "c"), (-41, None, None, None), (None, 1, "user", "lost"), (5, 0, "user", "a b"), (5, 0, "user", "a b"), (5, None, "user", "first")]
    rows += [(10**15 + k, k % 2, "user", rng.choice(say)) for k in range(20)]
    return rows


def test_against_brute_force(spark):
    check(spark, made(1))


@pytest.mark.parametrize("block", [8, 64])
def test_prefix_sums_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", 5)
    df = spark.range(1000).selectExpr("id as at", "id % 7 as v", "id % 3 as w").repartition(5)
    total, want = [0, 0], {}
    for i in range(1000):
        total = [total[0] + i % 7, total[1] + i % 3]
        want[i] = tuple(total)
    assert {r["at"]: (r.sum_v, r.sum_w) for r in prefix_trie.prefix_sums(df, "at", "v", "w").collect()} == want


def test_one_conversation_over_many_ranges(spark):
    rows = [(20, t // 2, "user", f"same {t % 5}") for t in range(700)] + [(21, 0, "user", "same 0")]
    check(spark, rows)


def test_equal_rows_over_many_ranges(spark):
    check(spark, [(3, None, "user", "again")] * 400 + [(23, 1, "user", "again")] * 3)


def test_small_tables(spark):
    assert prefix_trie.prefix_trie(table(spark, [])).collect() == []
    check(spark, [(7, None, None, None)])
    check(spark, [(c, 0, "user", "only") for c in range(21, 40)])  # all turnless where h > 0 and no base
