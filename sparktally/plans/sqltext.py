"""Builders of the SQL twins: cubes, information measures and network scores as plain SQL."""

from __future__ import annotations

from itertools import combinations


def with_inst(body: str, *ctes: str) -> str:
    """WITH inst AS (body), more CTEs."""
    return "WITH " + ", ".join([f"inst AS ({body})", *ctes])


def hash_sql(seed: int | str, key: str = "id") -> str:
    """The portable hash; ``seed`` is a number, or an SQL expression of a string."""
    s = f"'{seed}:'" if isinstance(seed, int) else f"{seed} || ':'"
    return f"CAST('0x' || substr(md5({s} || {key}), 1, 13) AS BIGINT)"


def cube_sql(atts: list[str], k: int, src: str = "inst", extra: str = "") -> str:
    """All k-subsets of the attributes, grouped one by one."""
    parts = []
    for s in combinations(atts, k):
        cols = ", ".join(f"'{a}' AS a{i}, {a} AS v{i}" for i, a in enumerate(s, 1))
        parts.append(f"SELECT {extra}{cols}, y, count(*) AS n FROM {src} GROUP BY {extra}{', '.join(s)}, y")
    return "\nUNION ALL ".join(parts)


def info_sql(src: str, by: list[str], x: list[str], y: list[str], z: tuple[str, ...] = (), name: str = "value") -> str:
    """I(x; y | z) within by groups of a table with n."""
    cols = [*by, *x, *y, *z]
    over = lambda c: f"sum(n) OVER (PARTITION BY {', '.join(c)})" if c else "sum(n) OVER ()"
    b = ", ".join(by)
    inner = f"SELECT {', '.join(cols)}, sum(n) AS n FROM {src} GROUP BY {', '.join(cols)}"
    mid = f"SELECT {b + ', ' if b else ''}n, {over(by)} AS tot, {over(by + list(z))} AS nz, {over(by + x + list(z))} AS nx, {over(by + y + list(z))} AS ny FROM ({inner})"
    return f"SELECT {b + ', ' if b else ''}sum(n / tot * log2(n * nz / (nx * ny))) AS {name} FROM ({mid})" + (f" GROUP BY {b}" if b else "")


def entropy_sql(src: str, by: list[str], x: list[str], name: str = "value") -> str:
    b, cols = ", ".join(by), ", ".join(by + x)
    over = f"sum(n) OVER (PARTITION BY {b})" if b else "sum(n) OVER ()"
    return f"SELECT {b + ', ' if b else ''}sum(-n / tot * log2(n / tot)) AS {name} FROM (SELECT *, {over} AS tot FROM (SELECT {cols}, sum(n) AS n FROM {src} GROUP BY {cols}))" + (f" GROUP BY {b}" if b else "")


def network_sql(atts: list[str], parents: dict[str, list[str]], inst: str = "inst", train: str = "inst", m: float = 1.0) -> str:
    """(atts..., y, class, p): posterior of the distinct (tuple, y) cells under a Bayesian network with m-estimates."""
    f = [f"cells AS (SELECT {', '.join(atts)}, y, count(*) AS n FROM {inst} GROUP BY ALL)", f"cls AS (SELECT y AS class, count(*) AS ny FROM {train} GROUP BY y)", "tot AS (SELECT sum(ny) AS nn, count(*) AS k FROM cls)"]
    joins, terms = "", [f"ln((ny + {m}::DOUBLE / tot.k) / (nn + {m}))"]
    for a in atts:
        ps = parents.get(a, [])
        keys = [a, *ps]
        f.append(f"k_{a} AS (SELECT count(DISTINCT {a}) AS k FROM {train})")
        f.append(f"f_{a} AS (SELECT {', '.join(keys)}, y, count(*) AS n FROM {train} GROUP BY ALL)")
        joins += f" CROSS JOIN k_{a} LEFT JOIN f_{a} ON f_{a}.y = class AND " + " AND ".join(f"f_{a}.{x} = cells.{x}" for x in keys)
        over = "ny"
        if ps:
            f.append(f"g_{a} AS (SELECT {', '.join(ps)}, y, count(*) AS n FROM {train} GROUP BY ALL)")
            joins += f" LEFT JOIN g_{a} ON g_{a}.y = class AND " + " AND ".join(f"g_{a}.{x} = cells.{x}" for x in ps)
            over = f"coalesce(g_{a}.n, 0)"
        terms.append(f"ln((coalesce(f_{a}.n, 0) + {m}::DOUBLE / k_{a}.k) / ({over} + {m}))")
    cells = ", ".join(f"cells.{a}" for a in atts)
    f.append(f"lp AS (SELECT {cells}, cells.y, cells.n, class, {' + '.join(terms)} AS lp FROM cells CROSS JOIN cls CROSS JOIN tot{joins})")
    key = ", ".join(atts + ["y"])
    f.append(f"post AS (SELECT {key}, n, class, exp(lp - max(lp) OVER w) / sum(exp(lp - mx)) OVER w AS p FROM (SELECT *, max(lp) OVER (PARTITION BY {key}) AS mx FROM lp) WINDOW w AS (PARTITION BY {key}))")
    return ", ".join(f)


def ande_sql(atts: list[str], n: int, inst: str = "inst", m: float = 1.0, weights: str | None = None, selected: list[str] | None = None, children: list[str] | None = None) -> str:
    """CTEs ending in post(atts..., y, n, class, p): averaged n-dependence estimators; every cell of ``inst`` has seen parents."""
    place = {a: i for i, a in enumerate(atts)}
    key = lambda s: sorted(s, key=place.get)
    f = [f"cells AS (SELECT {', '.join(atts)}, y, count(*) AS n FROM {inst} GROUP BY ALL)", f"cls AS (SELECT y AS class, count(*) AS ny FROM {inst} GROUP BY y)", "tot AS (SELECT sum(ny) AS nn, count(*) AS k FROM cls)"]
    f += [f"k_{a} AS (SELECT count(DISTINCT {a}) AS k FROM {inst})" for a in atts]
    parents = [frozenset(s) for s in combinations([a for a in atts if not selected or a in selected], n)]
    kids = [a for a in atts if not children or a in children]
    need = set(parents) | {p | {c} for p in parents for c in kids}
    joins = "".join(f" CROSS JOIN k_{a}" for a in atts)
    for s in sorted(need, key=lambda s: (len(s), key(s))):
        t = "c_" + "_".join(key(s))
        f.append(f"{t} AS (SELECT {', '.join(key(s))}, y, count(*) AS n FROM {inst} GROUP BY ALL)")
        joins += f" LEFT JOIN {t} ON {t}.y = class AND " + " AND ".join(f"{t}.{x} = cells.{x}" for x in s)
    cols = ", ".join(f"cells.{a}" for a in atts)
    one = []
    for i, p in enumerate(parents):
        t = "c_" + "_".join(key(p))
        ks = " * ".join(f"k_{a}.k" for a in key(p))
        terms = [f"ln((coalesce({t}.n, 0) + {m}::DOUBLE / (tot.k * {ks})) / (nn + {m}))"]
        for c in kids:
            if c not in p:
                u = "c_" + "_".join(key(p | {c}))
                terms.append(f"ln((coalesce({u}.n, 0) + {m}::DOUBLE / k_{c}.k) / (coalesce({t}.n, 0) + {m}))")
        one.append(f"{' + '.join(terms)} AS s{i}")
    f.append(f"lp AS (SELECT {cols}, cells.y, cells.n, class, {', '.join(one)} FROM cells CROSS JOIN cls CROSS JOIN tot{joins})")
    top = f"greatest({', '.join(f's{i}' for i in range(len(parents)))})" if len(parents) > 1 else "s0"
    k = ", ".join(atts + ["y"])
    w = lambda i, p: f"{weights[p]} * " if weights else ""
    total = " + ".join(f"{w(i, p)}exp(s{i} - mx)" for i, p in enumerate(parents))
    f.append(f"summed AS (SELECT *, {total} AS v FROM (SELECT *, max({top}) OVER (PARTITION BY {k}) AS mx FROM lp))")
    f.append(f"post AS (SELECT {k}, n, class, v / sum(v) OVER (PARTITION BY {k}) AS p FROM summed)")
    return ", ".join(f)


POSTERIOR = "SELECT {key}, class, round(p, 6) AS p FROM post"
#: Losses of a post table.
LOSSES = """SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(CASE WHEN pred <> y THEN n ELSE 0 END) / sum(n), 6) AS zero_one,
  round(sqrt(sum(n * (1 - py) ** 2) / sum(n)), 6) AS rmse, round(sqrt(sum(n * sq) / (sum(n) * max(k))), 6) AS rmse_all, round(sum(n * -log2(py)) / sum(n), 6) AS logloss
FROM (SELECT {key}, y, max(n) AS n, arg_max(class, (round(p, 9), -ord(class))) AS pred, max(CASE WHEN class = y THEN p END) AS py,
  sum((CASE WHEN class = y THEN 1.0 ELSE 0.0 END - p) ** 2) AS sq, count(*) AS k FROM post GROUP BY {key}, y)"""
