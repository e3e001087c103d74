"""PII: detected entities get keyed surrogates of their own type, with DataFrame functions only.

A surrogate is a function of a secret key and the entity's canonical form, so an entity has
the same one wherever and however it is written (coreference), and it keeps the form it was
written in: digits where digits were, separators, letter case, script, the gender that a
title tells. All distinct entities of the corpus are checked together: two of them never
share a surrogate and no surrogate is an entity that occurs (distinctness).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
OTHER = ("Dr", "Prof")
TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + OTHER, key=len, reverse=True)) + ")"
NAME_WORD = r"\p{Lu}[\p{L}\p{M}'’-]+"
PATTERNS = {
    # labels are taken for good: going back over each of thousands would overflow the stack
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9.-]*\.[A-Za-z]{2})[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "name": rf"(?<![\p{{L}}\p{{M}}]){TITLE}\.? {NAME_WORD}(?: {NAME_WORD})?",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Syllables of made-up names by script; male and female ones end differently.
SYLLABLES = {
    "latin": (("ba", "be", "bo", "da", "de", "di", "fa", "fe", "ga", "ha", "jo", "ka", "la", "le", "li", "lo", "ma", "mi", "mo", "na", "ne", "no", "pa", "pe", "ra", "re", "ri", "ro", "sa", "se", "ta", "te", "ti", "to", "va", "vi"), "r", "na", "ll"),
    "cyrillic": (("ба", "ве", "го", "да", "ди", "за", "ка", "ко", "ла", "ле", "ма", "ми", "на", "не", "ни", "по", "ра", "ре", "ро", "са", "се", "та", "ти", "то"), "н", "на", "в"),
    "greek": (("βα", "γε", "δα", "δι", "ζω", "θε", "κα", "κο", "λα", "λε", "μα", "με", "μι", "να", "νε", "πα", "πο", "ρα", "ρε", "σα", "στε", "τα", "τι", "φω"), "ς", "να", "κης"),
}
#: After so many draws surrogates get longer, or, numbers, letters: forms of which few exist never run out.
ROOMIER = 4


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def kind_of(raw: Column) -> Column:
    """Which pattern an entity came from."""
    return (
        F.when(raw.contains("@"), "email")
        .when(raw.rlike(f"^{OCTET}(\\.{OCTET}){{3}}$"), "ip")
        .when(F.length(_digits(raw)) == 16, "card")
        .when(raw.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(raw.rlike("^[+(0-9]"), "phone")
        .otherwise("name")
    )


def _gender(raw: Column) -> Column:
    title = F.regexp_extract(raw, rf"^({TITLE})", 1)
    return F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")


def full_name(raw: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(raw, rf"^{TITLE}\.? ", "")


def _country(raw: Column) -> Column:
    """The country code of a phone; none stands for 1."""
    code = F.regexp_extract(raw, r"^\+([0-9]{1,3})[ .-]?(?:\(|[0-9]{3}[ .-])", 1)
    return F.when(code.isin("", "1"), "").otherwise(F.concat(F.lit("+"), code))


def parts_of(kind: Column, raw: Column, gender: Column) -> Column:
    """The canonical parts of an entity as array<struct<kind, canon>>: one, or given and family name."""
    one = lambda canon, of=kind: F.array(F.struct(of.alias("kind"), canon.alias("canon")))
    words = F.split(full_name(raw), " ")
    family = F.struct(F.lit("family").alias("kind"), F.lower(F.element_at(words, -1)).alias("canon"))
    given = F.struct(F.concat(F.lit("given_"), gender).alias("kind"), F.lower(F.element_at(words, 1)).alias("canon"))
    return (
        F.when(kind == "email", one(F.lower(raw)))
        .when(kind == "ip", one(raw))
        .when(kind == "phone", one(F.right(_digits(raw), F.lit(10)), F.concat(kind, _country(raw))))
        .when(kind.isin("card", "ssn"), one(_digits(raw)))
        .when(F.size(words) > 1, F.array(given, family))
        .otherwise(F.array(family))
    )


def _draw(key: str, kind: Column, canon: Column, attempt: Column, i) -> Column:
    """A repeatable 32-bit number for place ``i`` of a surrogate; not to be guessed without the key."""
    said = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"), F.lit(str(i)) if isinstance(i, int) else i.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("long")


def luhn_sum(digits: Column) -> Column:
    """Sum modulo 10 of card digits, every second one from the right doubled."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, b: a + b) % 10


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical form of the surrogate."""
    draw = lambda i: _draw(key, kind, canon, attempt, i)
    joined = lambda parts: F.array_join(parts, "")
    places = F.sequence(F.lit(1), F.length(canon))
    roomier = F.floor(attempt / ROOMIER).cast("int")
    letter = lambda i: F.chr(97 + draw(i) % 26)
    extra = lambda n: F.when(n > 0, joined(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: letter(i + 100_000)))).otherwise("")

    def email_char(i: Column) -> Column:
        c = F.substring(canon, i, F.lit(1))
        kept = i > F.length(canon) - F.length(F.substring_index(canon, ".", -1))
        return F.when(kept, c).when(c.rlike("[a-z]"), F.chr(97 + draw(i) % 26)).when(c.rlike("[0-9]"), (draw(i) % 10).cast("string")).otherwise(c)

    digit = lambda i: F.when((i > F.length(canon) - roomier) & (draw(i) % 36 > 9), letter(i + 100_000)).otherwise((draw(i) % 10).cast("string"))
    digits = joined(F.transform(places, lambda i: F.when(i == 1, (2 + draw(i) % 8).cast("string")).otherwise(digit(i))))
    body = F.concat(F.substring(canon, 1, 1), joined(F.transform(F.sequence(F.lit(2), F.lit(15)), lambda i: (draw(i) % 10).cast("string"))))
    # the last digit keeps the number as valid, or as far from valid, as it was
    card = F.concat(body, ((luhn_sum(canon) - luhn_sum(F.concat(body, F.lit("0"))) + 10) % 10).cast("string"))
    first = F.when(canon.startswith("10."), F.lit("10")).otherwise((11 + draw(1) % 112).cast("string"))
    # beyond 255 there is room that no real address takes
    octet = lambda i: F.when(roomier > 0, 256 + draw(i) % 744).otherwise(draw(i) % 256).cast("string")
    ip = F.concat_ws(".", first, octet(2), octet(3), (1 + draw(4) % 254).cast("string"))

    def named(script: str) -> Column:
        syllables, male, female, family = SYLLABLES[script]
        pool = F.array(*map(F.lit, syllables))
        stem = joined(F.transform(F.sequence(F.lit(1), 4 + roomier), lambda i: F.element_at(pool, (draw(i) % len(syllables) + 1).cast("int"))))
        return F.concat(stem, F.when(kind == "given_m", male).when(kind == "given_f", female).when(kind == "family", family).otherwise(""))

    name = F.when(canon.rlike(r"\p{IsCyrillic}"), named("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), named("greek")).otherwise(named("latin"))
    email = F.concat(extra(roomier), joined(F.transform(places, email_char)))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind.startswith("phone") | (kind == "ssn"), digits).otherwise(name)


def resolved(parts: DataFrame, key: str) -> DataFrame:
    """(kind, canon, sur) for distinct ``parts(kind, canon)``; draws again until no surrogate clashes.

    A clash is a surrogate given to two entities of a kind (the earlier one keeps it) or one
    that is itself an entity of the corpus. Draws get more room the more there were (ROOMIER),
    so forms of which few exist, or all occur, end as well.
    """
    drawn = lambda df: df.withColumn("sur", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")))
    real = parts.select("kind", F.col("canon").alias("sur"), F.lit(True).alias("real"))
    m = materialise(drawn(parts.withColumn("attempt", F.lit(0))), "surrogates")
    order = Window.partitionBy("kind", "sur").orderBy("attempt", "canon")
    while True:
        told = m.withColumn("rn", F.row_number().over(order)).join(real, ["kind", "sur"], "left")
        told = told.select("kind", "canon", "attempt", "sur", ((F.col("rn") > 1) | F.col("real").isNotNull()).alias("clash"))
        if not told.where("clash").limit(1).count():
            return m.select("kind", "canon", "sur")
        again = drawn(told.where("clash").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")))
        m = materialise(told.where("not clash").select("kind", "canon", "attempt", "sur").unionByName(again), "surrogates")


def _cased(like: Column, word: Column) -> Column:
    return F.when((F.length(like) > 1) & (like == F.upper(like)), F.upper(word)).otherwise(F.initcap(word))


def rendered(kind: Column, raw: Column, first: Column, last: Column) -> Column:
    """The surrogate written as the entity was."""
    n = F.when(kind == "phone", 10).when(kind == "ssn", 9).otherwise(16)
    total = F.length(_digits(raw))

    def place(i: Column) -> Column:
        c = F.substring(raw, i, F.lit(1))
        at = F.length(_digits(F.substring(raw, F.lit(1), i))) - total + n
        return F.when(c.rlike("[0-9]") & (at >= 1), F.substring(first, at, F.lit(1))).otherwise(c)

    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), place), "")
    title = F.regexp_extract(raw, rf"^({TITLE}\.? )", 1)
    words = F.split(F.regexp_replace(raw, rf"^{TITLE}\.? ", ""), " ")
    one = F.concat(title, _cased(F.element_at(words, -1), last))
    two = F.concat(title, _cased(F.element_at(words, 1), first), F.lit(" "), _cased(F.element_at(words, -1), last))
    return (
        F.when(kind == "email", F.when(raw == F.upper(raw), F.upper(first)).otherwise(first))
        .when(kind == "ip", first)
        .when(kind == "name", F.when(F.size(words) > 1, two).otherwise(one))
        .otherwise(numbers)
    )


def with_surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every entity in ``text_col`` replaced, and n_entities and kinds (distinct, sorted) added.

    A name that a title introduced is also replaced where it stands without one in the same
    text, its family name alone as well; such mentions are not counted. Texts without entities
    come back as they are, null and empty ones included. Rows repeated with one id and text are
    changed alike; null ids are no trouble; an empty table comes back empty. Columns of
    ``docs`` named n_entities or kinds give way to the added ones.
    """
    cols = [c for c in docs.columns if c.lower() not in ("n_entities", "kinds")]
    text = F.col(text_col)
    # the one pass of the patterns over the corpus
    here = docs.select(F.col(id_col).alias("gid"), F.xxhash64(text).alias("gth"), F.posexplode(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).alias("pos", "raw"))
    here = materialise(here.distinct().withColumn("kind", kind_of(F.col("raw"))), "entities")
    # any title of a full name tells the gender wherever it stands
    said = here.where("kind = 'name'").select(F.lower(full_name(F.col("raw"))).alias("who"), _gender(F.col("raw")).alias("g"))
    said = said.groupBy("who").agg(F.max((F.col("g") == "m").cast("int")).alias("m"), F.max((F.col("g") == "f").cast("int")).alias("f"))
    said = said.select("who", F.when(F.col("m") == F.col("f"), "n").when(F.col("m") == 1, "m").otherwise("f").alias("gender"))
    here = here.withColumn("who", F.when(F.col("kind") == "name", F.lower(full_name(F.col("raw"))))).join(said, "who", "left")
    here = materialise(here.withColumn("parts", parts_of(F.col("kind"), F.col("raw"), F.col("gender"))).drop("who", "gender"), "entityparts")
    parts = materialise(here.select(F.explode("parts").alias("p")).select("p.kind", "p.canon").distinct(), "parts")
    names = resolved(parts, key).withColumnRenamed("kind", "pkind")
    each = here.select("gid", "gth", "pos", "raw", "kind", F.posexplode("parts").alias("no", "p")).select("gid", "gth", "pos", "raw", "kind", "no", F.col("p.kind").alias("pkind"), F.col("p.canon").alias("canon"))
    each = each.join(names, ["pkind", "canon"])
    whole = each.groupBy("gid", "gth", "pos", "raw", "kind").agg(F.min_by("sur", "no").alias("first"), F.max_by("sur", "no").alias("last"))
    new = rendered(F.col("kind"), F.col("raw"), F.col("first"), F.col("last"))
    whole = whole.select("gid", "gth", F.struct("pos", new.alias("new"), "kind", "raw").alias("e"))
    per_text = materialise(whole.groupBy("gid", "gth").agg(F.array_sort(F.collect_list("e")).alias("list")), "replacements")
    size = per_text.agg(F.coalesce(F.sum(F.size("list") + 1), F.lit(0))).first()[0]
    d = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    d = d.join(F.broadcast(per_text) if size <= BROADCAST_ROWS else per_text, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    # names and their surrogates without titles: full ones before family names
    named = F.filter("list", lambda e: e["kind"] == "name")
    fulls = F.transform(named, lambda e: F.struct(full_name(e["raw"]).alias("old"), full_name(e["new"]).alias("new")))
    last = lambda c: F.substring_index(c, " ", -1)
    families = F.transform(fulls, lambda e: F.struct(last(e["old"]).alias("old"), last(e["new"]).alias("new")))
    bare = F.array_distinct(F.concat(F.filter(fulls, lambda e: e["old"].contains(" ")), families))

    def untitled(gap: Column, names: Column) -> Column:
        word = lambda e: F.concat(F.lit(r"(?<![\p{L}\p{M}])\Q"), e["old"], F.lit(r"\E(?![\p{L}\p{M}])"))
        return F.aggregate(names, gap, lambda t, e: F.when(F.contains(t, e["old"]), F.regexp_replace(t, word(e), e["new"])).otherwise(t))

    gaps = F.split("text", ENTITY, -1)
    # the outer array binds the names, which a lambda would compute anew for each gap
    pieces = F.transform(F.array(F.struct(bare.alias("names"), gaps.alias("gaps"))), lambda b: F.transform(b["gaps"], lambda gap, i: F.concat(untitled(gap, b["names"]), F.coalesce(F.get(F.col("list.new"), i), F.lit("")))))[0]
    field = F.col("row").getField
    out = [F.when(F.col("list").isNull(), field(c)).otherwise(F.array_join(pieces, "")).alias(c) if c == text_col else field(c).alias(c) for c in cols]
    kinds = F.array_join(F.array_sort(F.array_distinct("list.kind")), ",")
    return d.select(*out, F.coalesce(F.size("list"), F.lit(0)).cast("long").alias("n_entities"), F.coalesce(kinds, F.lit("")).alias("kinds"))
