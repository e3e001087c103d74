"""The source audit against sums over every term and pair."""

import collections
import random
import re

from sparktally.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, v string, a string, kept long"


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 9, "y", "z", 4) for i, r in enumerate(rows)], SCHEMA).repartition(3)


def brute(rows, least):
    found = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {f[0] for f in found}:
        mine = [f for f in found if f[0] == lang]
        df = collections.Counter(w for f in mine for w in set(f[2]))
        kept = [w for w, d in df.items() if d >= least]
        counts = {s: collections.Counter(w for f in mine if f[1] == s for w in f[2]) for s in {f[1] for f in mine}}
        every = sum(counts.values(), collections.Counter())

        def p(c, kept=kept):
            n = sum(c[w] for w in kept) + 2 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 2) // n for w in kept}

        f = lambda x, y: (x - y) ** 2 // (x + y)
        ps, q = {s: p(c) for s, c in counts.items()}, p(every)
        for s, mine_p in ps.items():
            pairs = [(t, sum(f(mine_p[w], ps[t][w]) for w in kept)) for t in ps if t != s]
            top = [(w, f(mine_p[w], q[w])) for w in kept if counts[s][w] and mine_p[w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", top, 10)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(ranked)]
    return out


def check(spark, rows, least=3):
    got = divergence.audit(table(spark, rows), min_docs=least).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute(rows, least))
    assert [f.dataType.simpleString() for f in divergence.audit(table(spark, rows)).schema] == ["string"] * 4 + ["bigint", "int"]


def made():
    rng = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "délta", "É", "日本", "a1b", "x_y", "don't", "ﬁn", "😀"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "hot", "hot", "hot", None, ""])) for _ in range(250)]
    rows += [(None, "en", "silent"), ("", "xx", "s1"), ("123 !?", "xx", "s2"), ("alone", "yy", "only"), ("long " * 50_000, "en", "s1")] + [("same text twice", "en", "s2")] * 3
    return rows


def test_against_brute_force(spark):
    check(spark, made())


def test_counts_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    check(spark, made()[:60])


def test_small_tables(spark):
    assert divergence.audit(table(spark, [])).collect() == []
    check(spark, [(None, None, None)])
    check(spark, [("one two", "en", "a"), (None, "en", "b")])


def test_scaled_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(divergence.scaled(F.lit(10**14), F.lit(3 * 10**15), F.lit(10**9)).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**14 + 2) // (3 * 10**15 + 2 * 10**9)
