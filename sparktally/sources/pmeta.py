"""Declared schemas: a small grammar of attributes, read to and written from StructType with metadata.

One attribute to a line, ``name : values``: a list of categories, or ``numeric`` with an
optional ``, ?``. Qualifiers in colons come before the name: ``:class:``, ``:width=N:`` for
fixed-width columns, ``:index=A-B:`` for a run of numbered attributes. ``::`` starts a
comment and ``:libsvm:N`` declares N numeric attributes and sparse rows.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

NUMERIC = {"numeric", "real", "integer", "continuous", "float", "int"}
QUALIFIER = re.compile(r":\s*(class|width=\d+|index=\d+-\d+)\s*:")


class SchemaError(ValueError):
    """The declaration breaks the grammar."""


def _field(name: str, role: str, domain: list[str] | None, missing: bool, width: int | None) -> T.StructField:
    meta = {"role": role, "missing": missing}
    if domain is not None:
        meta["domain"] = domain
    if width:
        meta["width"] = width
    return T.StructField(name, T.StringType() if domain is not None else T.DoubleType(), True, meta)


def parse_pmeta(text: str) -> T.StructType:
    """The declared fields in order; roles, domains, widths and missing flags in their metadata.

    Raises SchemaError for two classes or none, a repeated category, a numeric class, or a
    line that is no declaration.
    """
    fields, sparse = [], False
    for n, line in enumerate(text.splitlines(), 1):
        line = re.split(r"::", line, maxsplit=1)[0] if not line.lstrip().startswith(":") or line.lstrip().startswith("::") else line
        line = line.strip()
        if not line:
            continue
        if m := re.match(r":libsvm:\s*(\d+)$", line):
            fields += [_field(f"a_{i}", "predictor", None, False, None) for i in range(1, int(m[1]) + 1)]
            sparse = True
            continue
        quals, at = [], 0
        while m := QUALIFIER.match(line, at):
            quals.append(m[1])
            at = m.end()
            while at < len(line) and line[at] == " ":
                at += 1
        name, colon, values = line[at:].partition(":")
        name = name.strip()
        if not colon or not name:
            raise SchemaError(f"line {n} declares nothing")
        is_class = quals.count("class")
        if is_class > 1:
            raise SchemaError(f"line {n} names its class twice")
        values = [v.strip() for v in values.split(",") if v.strip()]
        numeric = bool(values) and values[0].lower() in NUMERIC
        if numeric and values[1:] not in ([], ["?"]):
            raise SchemaError(f"line {n} lists values after a numeric type")
        if not numeric and len({v.lower() for v in values}) < len(values):
            raise SchemaError(f"line {n} repeats a value")
        width = next((int(q[6:]) for q in quals if q.startswith("width=")), None)
        role = "class" if is_class or (name.lower() == "class" and not quals) else "predictor"
        if role == "class" and numeric:
            raise SchemaError(f"line {n} has a numeric class")
        run = next((q[6:] for q in quals if q.startswith("index=")), None)
        names = [f"{name}_{i}" for i in range(int(run.split("-")[0]), int(run.split("-")[1]) + 1)] if run else [name]
        fields += [_field(x, role, None if numeric else values, "?" in values, width) for x in names]
    classes = [f.name for f in fields if f.metadata["role"] == "class"]
    if len(classes) != 1:
        raise SchemaError("no class is declared" if not classes else f"several classes: {', '.join(classes)}")
    if sparse:
        fields = [T.StructField(f.name, f.dataType, True, f.metadata | {"sparse": True}) for f in fields]
    return T.StructType(fields)


def format_pmeta(schema: T.StructType) -> str:
    """Back to text: categorical predictors, then numeric ones, then the class."""

    def rank(f: T.StructField) -> int:
        return 2 if f.metadata.get("role") == "class" else 0 if "domain" in f.metadata else 1

    out = []
    for f in sorted(schema.fields, key=rank):
        mark = ":class: " if rank(f) == 2 else ""
        values = ", ".join(f.metadata["domain"]) if "domain" in f.metadata else "numeric" + (", ?" if f.metadata.get("missing") else "")
        out.append(f"{mark}{f.name} : {values}")
    return "\n".join(out) + "\n"


def class_field(schema: T.StructType) -> T.StructField:
    return next(f for f in schema.fields if f.metadata.get("role") == "class")
