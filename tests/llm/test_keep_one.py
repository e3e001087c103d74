"""One document of each near-dedup group, whatever the ids are."""

import random

from sparktally.llm import simhash


def test_null_and_repeated_ids(spark):
    rng = random.Random(31)
    a, b, c, d, e = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(5))
    # distinct texts without ids; one id with two texts; a copy with an id of one without; repeated rows
    rows = [(None, a, "s"), (None, b, "s"), (None, b, "s"), (None, None, "s"), (1, c, "s"), (1, d, "s"), (2, d, "s"), (None, d, "s"), (9, e, "s"), (9, e, "s"), (9, e, None), (10, e, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = simhash.keep_one(docs).collect()
    assert docs.columns == ["doc_id", "text", "source"]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, a), (None, b), (None, None), (1, c), (1, d), (9, e)], key=str)
