"""The training-data operators against brute force, on small tables with every odd case."""

import collections
import hashlib
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from sparktally.llm import exact_dedup, language_id, lines, media, mixing, repeats, secrets, sentence_pieces, simhash, surrogates, vocabulary
from sparktally.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, fp long, rid string"


def table(spark, rows):
    """documents with columns whose names clash with inner ones."""
    full = [(i, t, lang, src, None if t is None else len(t), "x", 7, "y") for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.randint(5, 120)) for _ in range(40)]
    passage = words(rng, 120)
    out = [(i, t, "en", "s1") for i, t in enumerate(base)]
    out += [(50 + i, base[i] if i % 2 else "  " + base[i].replace(" ", "\n\t"), "en", "s2") for i in range(6)]
    out += [(70 + i, words(rng, 30) + " " + passage + " " + words(rng, 30), "de", "s2") for i in range(5)]
    for i in range(8):  # near copies
        w = base[7].split()
        w[rng.randrange(len(w))] = "changed"
        out.append((90 + i, " ".join(w), "fr", None))
    out += [(120, None, None, None), (121, "", "en", "s1"), (122, " \n ", "en", "s3"), (123, "äöü ▁ 日本 😀 ſ", None, "s3"), (None, base[3], "en", "s1"), (None, None, None, None), (0, base[0], "en", "s1"), (0, base[0], "en", "s1"), (124, words(rng, 6000), "en", "s1"), (125, "ab" * 700, "en", "s4"), (126, "one two", "en", "s4")]
    return out


def text_of(t):
    return t or ""


def test_exact_groups(spark, rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", text_of(t))
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    for budget in (1 << 20, 300):  # the small one makes every bucket spill and recurse
        got = exact_dedup.exact_groups(table(spark, rows), table_bytes=budget).collect()
        assert len(got) == len(rows)
        want = collections.Counter()
        for t, ids in groups.items():
            known = [i for i in ids if i is not None]
            for i in ids:
                want[(i, min(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_grace_spills_repeatedly():
    rng = random.Random(1)
    contents = [bytes([rng.randrange(256) for _ in range(50)]) for _ in range(300)]
    recs = [(k, False, k, k, 1, contents[k % 300]) for k in range(900)]
    out = [r for b in exact_dedup.grace(iter(recs), 0, 2000) for r in b.to_pylist()]
    assert {r["rep_key"]: (r["keep_id"], r["group_size"]) for r in out} == {k: (k % 300, 3) for k in range(900)}


@pytest.mark.parametrize("weighted", [False, True])
def test_mixing(spark, rows, weighted):
    docs = table(spark, rows).withColumn("w", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    sizes, plan = mixing.mix(docs, weight_col="w" if weighted else None)
    got = mixing.with_copies(sizes, plan).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", text_of(t)))
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while open_:  # deal, cap, deal the excess again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.copies <= 2 and r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s in order:
        assert abs(taken[s] - target[s]) <= largest[s] * 1.5 + 1e-6
    again = mixing.with_copies(*mixing.mix(docs, weight_col="w" if weighted else None)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mixed_documents(table(spark, rows))
    assert mixed.columns == table(spark, rows).columns


BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
LEAST = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}


def base_spans(t):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in p.finditer(t) if LEAST[kind](m)]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_secrets(spark):
    rng = random.Random(2)
    toks = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", '"', "'", " ", "abcdef", "0123456789abcdef01234567", "AKIA", "ABCDEFGH12345678", "é", "x", "-", "\n", "==", "a", "f0", "日"]
    texts = ["".join(rng.choice(toks) for _ in range(rng.randint(1, 14))) for _ in range(1500)] + [None, "", "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "eyJ" + "a" * 30 + ".eyJ" + "b" * 30 + "." + "c" * 30, "x" * 200_000 + " token=abcdefg"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    more = set()
    for r in secrets.scan_secrets(docs).collect():
        spans = r.spans.split(",") if r.spans else []
        want = base_spans(text_of(texts[r.doc_id]))
        base = [s for s in spans if s.split(":")[0] in BASE]
        assert base == want
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in want) for k in BASE)
        more |= {s.split(":")[0] for s in spans} - set(BASE)
    assert more == {"private_key", "forge", "jwt"}


def test_language_id(spark):
    rng = random.Random(3)
    sets = {"aa": ["the", "and", "ing", "tion"], "bb": ["der", "sch", "ung", "keit"], "cc": ["que", "eau", "les", "ment"]}
    rows = []
    for i in range(240):
        lang = sorted(sets)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(sets[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40))), lang))
    rows += [(1000, None, "aa"), (1001, "12 34 !!", "aa"), (1002, "", None), (1003, "Thetion " * 20_000, None), (1005, "\u00bd \u00b2", None), (1006, "\u2167", None), (1007, "\u0301 7", None), (None, "keitung der", None), (1004, "a" * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = language_id.held_out()
    model = language_id.fit(docs.where(~held))
    got = language_id.with_language(docs.withColumn("held", held), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 1000:
            assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    sure = [r for r in got if r.held and r.doc_id < 1000]
    assert len(sure) > 30 and sum(r.lang_pred == r.lang for r in sure) >= 0.97 * len(sure)
    by = {r.doc_id: r for r in got}
    # numerals, letters of number forms and marks alone are no letters
    assert {by[k].lang_pred for k in (1005, 1006, 1007)} == {"und"} and {by[k].score for k in (1005, 1006, 1007)} == {0.0}
    assert [by[k].lang_pred for k in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "aa", "bb"]
    assert language_id.fit(docs.where("false")).languages == []
    assert {r.lang_pred for r in language_id.with_language(docs, language_id.fit(docs.where("false"))).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = ["a", "b", "ab", "ba", "aba", vocabulary.MARK, vocabulary.MARK + "a"]
    rng = np.random.default_rng(0)
    probs = np.vstack([rng.random((len(pieces), 2)), np.zeros((1, 2))])
    table = dict(zip(pieces, probs))
    unknown = np.full(2, language_id.UNKNOWN)

    def brute(w):
        if not w:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, len(w) + 1):
            p = table.get(w[:n], unknown if n == 1 else None)
            if p is not None:
                out = out + p * brute(w[n:])
        return out

    lattice = language_id.Lattice(pieces)
    tries = [vocabulary.MARK + w for w in ("a", "ab", "abab", "bab", "xab", "aabba")]
    assert np.allclose(np.exp(language_id.forward(lattice, probs, tries)), [brute(w) for w in tries])


def unigram_model(vocab):
    """The public model's bytes with our scores and the unigram type: SentencePiece's own Viterbi then gives the pieces to match."""
    import struct

    data = open(vocabulary.MODEL_PATH, "rb").read()
    scores = sentence_pieces.zipf_scores(vocab)

    def varint(x):
        out = b""
        while True:
            x, b = x >> 7, x & 127
            out += bytes([b | (128 if x else 0)])
            if not x:
                return out

    def fields(buf):
        at = 0
        while at < len(buf):
            tag = shift = 0
            while True:
                b = buf[at]
                tag |= (b & 127) << shift
                at, shift = at + 1, shift + 7
                if b < 128:
                    break
            if tag & 7 == 2:
                n = shift = 0
                while True:
                    b = buf[at]
                    n |= (b & 127) << shift
                    at, shift = at + 1, shift + 7
                    if b < 128:
                        break
                yield tag >> 3, 2, buf[at : at + n]
                at += n
            elif tag & 7 == 5:
                yield tag >> 3, 5, buf[at : at + 4]
                at += 4
            elif tag & 7 == 1:
                yield tag >> 3, 1, buf[at : at + 8]
                at += 8
            else:
                n = shift = 0
                while True:
                    b = buf[at]
                    n |= (b & 127) << shift
                    at, shift = at + 1, shift + 7
                    if b < 128:
                        break
                yield tag >> 3, 0, n

    def put(k, kind, v):
        head = varint(k << 3 | kind)
        return head + (varint(v) if kind == 0 else varint(len(v)) + v if kind == 2 else v)

    out = b""
    for k, kind, v in fields(data):
        if k == 1:
            piece = {f: x for f, _, x in fields(v)}
            text = piece[1].decode()
            score = scores.get(text, (0.0, 0))[0]
            v = put(1, 2, piece[1]) + put(2, 5, struct.pack("<f", score)) + (put(3, 0, piece[3]) if 3 in piece else b"")
        elif k == 2:
            v = b"".join(put(f, t, 1 if f == 3 else x) for f, t, x in fields(v) if f != 3) + put(3, 0, 1)
        out += put(k, kind, v)
    return out


def test_pieces_match_sentencepiece(spark, rows):
    import sentencepiece

    vocab = vocabulary.load()
    stock = sentencepiece.SentencePieceProcessor(model_proto=unigram_model(vocab))
    enc = sentence_pieces.Encoder(vocab)
    texts = [t for _, t, *_ in rows if t and "▁" not in t] + ["Hello  world,\n this is   a test é 日本 😀", " lead", "trail "]
    score = lambda ids: sum(enc.scores[vocab.texts[i]][0] for i in ids if vocab.texts[i] in enc.scores)
    for t, ids in zip(texts, enc.encode(texts)):
        want = stock.encode(t)
        # equal, or a tie of two best ways
        assert list(ids) == want or abs(score(ids) - score(want)) < 1e-3
        assert stock.decode([int(i) for i in ids]) == t


def test_encode_documents(spark, rows):
    got = sentence_pieces.encode_documents(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    want = collections.Counter((i, hashlib.sha256(text_of(t).encode()).hexdigest()) for i, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in got) == want
    back = sentence_pieces.decode_pieces(spark.createDataFrame([(r.doc_id, r.pieces) for r in got] + [(5, None)], "doc_id long, pieces array<int>")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == collections.Counter([(i, text_of(t)) for i, t, *_ in rows] + [(5, None)])


PII = [
    (1, "mail ann.lee9@mail5.example.com or +1 (743) 555-3824, again 743-555-3824."),
    (2, "card 4465758382889437 and 4465 7583 8288 9437 ip 152.143.123.131 ssn 123-45-6789"),
    (3, "Mr. John Smith met Mrs. Anna Smith; Mr. Smith left. ANN.LEE9@MAIL5.EXAMPLE.COM"),
    (4, "clean text 12 34, version 1.2.3, 2024-01-01"),
    (5, None),
    (6, ""),
    (7, "Госпожа Иванова и Господин Пётр Иванов"),
    (None, "ip 10.0.0.1"),
    (1, "mail ann.lee9@mail5.example.com or +1 (743) 555-3824, again 743-555-3824."),
]


def test_surrogates(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in PII], "doc_id long, text string, kind string")
    rows = surrogates.with_surrogates(docs, "key").collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(PII) and rows[0].kind == "k"
    assert {got[4].text, got[5].text, got[6].text} == {PII[3][1], None, ""}
    t1, t2, t3 = got[1].text, got[2].text, got[3].text
    mail = re.search(r"[a-z]+\.[a-z]+\d@[a-z]+\d\.[a-z]+\.com", t1)[0]
    assert mail != "ann.lee9@mail5.example.com" and mail.upper() in t3
    a, b = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4}), again (\d{3}-\d{3}-\d{4})", t1), None
    b = "-".join(a.groups()[:3])
    assert b == a[4] != "743-555-3824"
    card = re.search(r"card (\d{16}) and (\d{4} \d{4} \d{4} \d{4}) ip", t2)
    assert card[1] == card[2].replace(" ", "") != "4465758382889437"
    luhn = lambda s: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10
    assert luhn(card[1]) == luhn("4465758382889437") and re.search(r"ssn \d{3}-\d{2}-\d{4}$", t2)
    he, she, last = re.match(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+); Mr\. (\w+) left", t3).group(1, 3, 2)
    assert t3.count(last) == 3 and he.endswith("r") and she.endswith("na") and "Smith" not in t3
    assert re.fullmatch(r"Госпожа [А-Яа-яё]+ и Господин [А-Яа-яё]+ [А-Яа-яё]+", got[7].text) and "Иванов" not in got[7].text
    assert got[None].text.startswith("ip 10.") and got[1].n_entities == 3 and got[2].kinds == "card,ip,ssn"
    other = {r.doc_id: r.text for r in surrogates.with_surrogates(docs, "other").collect()}
    assert other[1] != t1


def test_surrogates_stay_distinct(spark):
    # 150 numbers of three digits leave few surrogates: clashes must be drawn again
    parts = spark.createDataFrame([("ssn", f"{i:03d}") for i in range(150)], "kind string, canon string")
    rows = surrogates.resolved(parts, "k").collect()
    assert len(rows) == 150 == len({r.sur for r in rows}) and not {r.sur for r in rows} & {r.canon for r in rows}


def test_repeats(spark, rows):
    W = 400
    rng = random.Random(9)
    long = words(rng, 400)
    data = [(i, t) for i, t, *_ in rows] + [(200 + k, words(rng, 20) + long[a:b] + words(rng, 20)) for k, (a, b) in enumerate([(0, 399), (0, 400), (100, 501), (90, 700), (500, 901), (0, 1500)])]
    data += [(300, words(rng, 60) + "z" * 900 + words(rng, 60)), (301, "q" * 400), (302, "q" * 400), (303, "ä" * 300), (304, "ä" * 250 + "b")]
    count = collections.Counter()
    blobs = [(i, text_of(t).encode()) for i, t in data]
    for _, b in blobs:
        count.update(b[x : x + W] for x in range(len(b) - W + 1))
    want = collections.Counter()
    for i, b in blobs:
        mark = bytearray(len(b))
        for x in range(len(b) - W + 1):
            if count[b[x : x + W]] > 1:
                mark[x : x + W] = b"\1" * W
        kept = bytes(c for c, m in zip(b, mark) if not m)
        want[(i, len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore"))] += 1
    docs = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, rid string")
    assert collections.Counter(map(tuple, repeats.repeated_bytes(docs).collect())) == want


def test_sampler_stretches(monkeypatch):
    rng = random.Random(4)
    b = words(rng, 900).encode()
    monkeypatch.setattr(repeats, "STRETCH", 1000)
    runs = list(repeats.Sampler().representatives(b))
    assert [x for _, x1, x2 in runs for x in range(x1, x2 + 1)] == list(range(len(b) - 399))
    assert all(x2 <= at <= x1 + 300 for at, x1, x2 in runs)


def line_groups(texts):
    """Brute force over all pairs of lines with a letter or digit: edit similarity 0.8 alone."""
    norm = lambda s: re.sub(r"[\W_]+", " ", s.lower()).strip()

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    every = sorted({norm(line) for _, t in texts for line in (t or "").split("\n")} - {""})
    up = list(range(len(every)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    letters = [collections.Counter(x) for x in every]
    for i in range(len(every)):
        for j in range(i):
            n = max(len(every[i]), len(every[j]))
            most = int(0.2 * n + 1e-9)
            # letters that one has and the other has not take an edit each, at least
            apart = max((letters[i] - letters[j]).total(), (letters[j] - letters[i]).total())
            if apart <= most and edits(every[i], every[j]) <= most:
                up[top(i)] = top(j)
    return norm, {x: top(i) for i, x in enumerate(every)}


def test_lines(spark):
    rng = random.Random(6)
    long = [words(rng, rng.randint(60, 120)) for _ in range(6)]
    texts = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(long).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(len(w))] = words(rng, 1)
            parts.append(rng.choice([" ".join(w), " ".join(w).upper() + "!!", words(rng, 9), "short one"]))
        texts.append((i, "\n".join(parts)))
    texts += [(100, None), (101, ""), (102, "\n\n"), (None, long[0]), (3, texts[3][1]), (103, words(rng, 300)), (104, words(rng, 300))]
    norm, group = line_groups(texts)
    place, want = {}, {}
    order = sorted({(i is None, i or 0, t) for i, t in texts if t is not None})
    for no, i, t in order:
        for pos, line in enumerate(t.split("\n")):
            g = group.get(norm(line))
            if g is not None:
                place.setdefault(g, (no, i, t, pos))
    for i, t in texts:
        key = (i is None, i or 0, t)
        want[i, t] = None if t is None else "\n".join(line for pos, line in enumerate(t.split("\n")) if group.get(norm(line)) is None or place[group[norm(line)]] == (*key, pos))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, norm string, pos int")
    got = lines.dedup_lines(docs).collect()
    assert len(got) == len(texts)
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((i, want[i, t]) for i, t in texts)
    assert all(r.norm == "x" for r in got) and sum(r.n_dropped for r in got) > 20


def test_media(spark, rows):
    got = media.document_media(table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t, *_ in rows:
        b = text_of(t).encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        m = f"P5\n64 {len(p) // 64}\n255\n".encode() + p
        want[(i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got) == want
    assert len({r.feature for r in got if r.n_bytes}) > 30


def test_interleave(spark):
    html = "<title>T</title><p>one <b>two</b></p><script>no</script><figure><img src='sha256:" + "a" * 64 + "'><figcaption>cap <i>x</i></figcaption></figure>tail &amp; end<img src=u alt=v><p>broken <figure><figcaption>c"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = {r.doc_id: r["items"] for r in media.interleave(pages).collect()}
    assert got[2] == [] and got[3] == []
    seq = [(x.position, x.kind, (x.text or x.ref).strip()[:8], x.caption) for x in got[1]]
    assert seq == [(0, "text", "T", None), (1, "text", "one two", None), (2, "media", "sha256:a", "cap x"), (3, "text", "tail & e", None), (4, "media", "u", "v"), (5, "text", "broken", None)]
    store = spark.createDataFrame([("a" * 64, 5)], "digest string, payload_bytes long")
    out = {(r.doc_id, r.position): (r.caption, r.payload_bytes) for r in media.resolve(media.interleave(pages), store).collect()}
    assert out == {(1, 2): ("cap x", 5), (1, 4): ("v", None)}
    whole = {r.doc_id: r["items"] for r in media.sequences(media.interleave(pages), store).collect()}
    assert whole[2] == [] and whole[3] == []
    assert [(x.position, x.kind, x.caption, x.found and x.found.payload_bytes) for x in whole[1]] == [(a, b, d, 5 if a == 2 else None) for a, b, _, d in seq]


def brute_components(fps):
    up = {f: f for f in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    fs = sorted(up)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 2:
                up[top(a)] = top(b)
    return {f: top(f) for f in fs}


@pytest.mark.parametrize("crowded", [24, 2])
def test_simhash(spark, rows, crowded, monkeypatch):
    def fp(t):
        w = text_of(t).encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))

    monkeypatch.setattr(simhash.links, "__defaults__", (2, crowded))
    prints = [(i, fp(t)) for i, t, *_ in rows]
    tops = brute_components([f for _, f in prints])
    least = collections.defaultdict(list)
    for i, f in prints:
        least[tops[f]].append(i)
    want = collections.Counter((i, f"{f:016x}", min((x for x in least[tops[f]] if x is not None), default=None)) for i, f in prints)
    assert collections.Counter(map(tuple, simhash.near_groups(table(spark, rows)).collect())) == want


@pytest.mark.parametrize("crowded", [1000, 4])
def test_links_of_dense_clusters(spark, crowded):
    rng = random.Random(11)
    fps = set()
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.4:
                x ^= 1 << rng.randrange(64)
    fps |= {rng.getrandbits(64) for _ in range(50)} | {0, 3, 2**64 - 1}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(df, crowded=crowded)).collect()}
    want = brute_components(fps)
    same = collections.defaultdict(set)
    for f in fps:
        same[want[f]].add(roots.get(signed(f), signed(f)))
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_components(spark):
    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + rng.randrange(30), 200 + rng.randrange(30)) for _ in range(25)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up if x in got} and all(x in got for e in edges for x in e if e[0] != e[1])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(docs).count() == 0
    assert mixing.with_copies(*mixing.mix(docs)).count() == 0
    assert secrets.scan_secrets(docs).count() == 0
    assert sentence_pieces.encode_documents(docs).count() == 0
    assert surrogates.with_surrogates(docs, "k").count() == 0
    assert repeats.repeated_bytes(docs).count() == 0
    assert lines.dedup_lines(docs).count() == 0
    assert media.document_media(docs).count() == 0
    assert simhash.near_groups(docs).count() == 0
    assert language_id.with_language(docs, language_id.fit(docs)).count() == 0
