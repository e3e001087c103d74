"""The license scan against every rule tried at every word, without keywords."""

import random
import re
from re import _parser as parser

from sparktally.llm import licenses
from sparktally.llm.license_rules import CONFIDENCE, GENERIC, REACH, rules

RULES = rules()


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text):
    ws = words(text)
    found = []
    for i in range(len(ws)):
        rest = " ".join(ws[i:])
        for r in RULES:
            if m := re.match(f"(?:{r.pattern})(?= |$)", rest):
                found.append((i, i + len(m[0].split(" ")), r))
    over = lambda e, d: e[0] <= d[0] and e[1] >= d[1] and (e[2].priority, e[0] - e[1], e[2].order) < (d[2].priority, d[0] - d[1], d[2].order)
    kept = [d for d in found if not any(over(e, d) for e in found)]
    base = [d for d in found if d[2].base]
    label = lambda ds: sorted({d[2].label for d in ds})
    starts = [d[0] for d in base]
    score = max([CONFIDENCE[d[2].priority] for d in kept], default=0.0)
    return len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(label(base)), ",".join(label(base + kept)), score, sorted((a, b, r.label) for a, b, r in kept)


def sample(tree, rng):
    """A text that matches a parsed pattern."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "NOT_LITERAL":
            out += "q"
        elif name == "IN":
            k, v = arg[0]
            out += "q" if str(k) == "NEGATE" else chr(v if str(k) == "LITERAL" else rng.randint(*v))
        elif name == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif name == "SUBPATTERN":
            out += sample(arg[-1], rng)
        else:  # repeats
            low, high, inner = arg
            out += "".join(sample(inner, rng) for _ in range(rng.randint(low, min(high, low + 2))))
    return out


def made():
    rng = random.Random(9)
    texts = [sample(parser.parse(r.pattern), rng) for r in RULES for _ in range(2)]
    spice = ["All rights reserved.", "CC BY", "cc by cc by", "general public license", "(C) Copyright 2020", "mit", "Licensed under the", "version 3", "wörter", "日本", "\n", "v2.0", "GNU", "--"]
    mixed = [" ".join(rng.choice(spice + texts) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    ends = ["reserved all rights", "rights reserved", "by", "cc", "the mit", "all rights", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3."]
    return [t.replace(" ", rng.choice([" ", "-", ", "])) for t in texts] + mixed + ends + [None, "", " .,! ", "cc by " * 3000, "ordinary " * 20000 + "all rights reserved"]


def test_every_rule_is_sound():
    rng = random.Random(3)
    assert len(RULES) >= 300 and [r.order for r in RULES] == list(range(len(RULES)))
    for r in RULES:
        for _ in range(5):
            ws = sample(parser.parse(r.pattern), rng).strip().split(" ")
            assert re.match(f"(?:{r.pattern})(?= |$)", " ".join(ws)), r
            assert ws[r.lead] == r.keyword and set(r.needs) <= set(ws) and len(ws) <= REACH, (r, ws)
    assert len({(r.pattern, r.label) for r in RULES if r.priority != GENERIC}) == len([r for r in RULES if r.priority != GENERIC])


def test_against_brute_force(spark):
    texts = made()
    docs = spark.createDataFrame([(i, t, "x", 1, True) for i, t in enumerate(texts)], "doc_id long, text string, label string, start int, base boolean").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, sorted(map(tuple, r.detections))) for r in licenses.scan_licenses(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if t is None or len(t) < 15_000:
            assert got[i] == brute(t), t
    assert got[len(texts) - 2][:6] == (6000, 3000, 0, 5998, "cc-by", "cc-by")
    assert got[len(texts) - 1][:6] == (20003, 1, 20000, 20000, "reserved", "reserved")


def test_rows_stay_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "CC BY"), (1, "CC BY"), (1, "CC BY"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_base, r.labels) for r in licenses.scan_licenses(docs).collect()) == [(-1, 0, ""), (-1, 1, "cc-by"), (1, 1, "cc-by"), (1, 1, "cc-by")]
    assert licenses.scan_licenses(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = licenses.scan_licenses(spark.range(1).selectExpr("id as doc_id", "'x' as text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
