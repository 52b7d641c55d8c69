"""Exact ``approx_percentile`` for grouped statements: the least value whose rank is at least p * n, in two bounded passes.

The first pass keeps a sketch for each group. Groups of up to ``SMALL`` rows are exact by it. Of the others, of which there
is one in ``SMALL`` rows at most, the sketch gives bounds around the rank, ``MARGIN`` of the group's rows to each side; the
second pass counts what lies below and the values between, and takes the one at the rank. The statement's other aggregates
are computed apart, without the sketches, and joined by group.

Works on the tokens of the statement. A call inside an expression, with FILTER or OVER or p not a literal, GROUP BY with ordinals or
grouping sets, ORDER BY or LIMIT in the same SELECT, and rows that differ from scan to scan are left to the sketch alone.
"""

from __future__ import annotations

import re

from .dialect import _arguments, _blank, _close, _next, _text, _word, tokens

#: Ranks of the sketch are off by 1 / ACCURACY of the rows or twice that; below half of ACCURACY rows it keeps all.
ACCURACY, SMALL, MARGIN = 100_000, 40_000, 0.0001
_CLAUSES = ("FROM", "WHERE", "GROUP", "HAVING")
_REFUSED = {"ORDER", "LIMIT", "OFFSET", "FETCH", "WINDOW", "QUALIFY", "LATERAL", "CLUSTER", "DISTRIBUTE", "SORT"}
_VARYING = {"LIMIT", "OFFSET", "FETCH", "TABLESAMPLE", "RAND", "RANDN", "RANDOM", "UUID", "SHUFFLE", "MONOTONICALLY_INCREASING_ID"}


def exact_percentiles(sql: str) -> str:
    ts = tokens(sql)
    if not any(t.lower() == "approx_percentile" for t in ts):
        return sql
    for i in reversed([i for i, t in enumerate(ts) if t.upper() == "SELECT"]):
        end = _end(ts, i)
        if (made := _rewritten(ts[i + 1 : end])) is not None:
            ts[i:end] = tokens(made)
    return "".join(ts)


def _end(ts: list[str], i: int) -> int:
    """Where the SELECT at ``i`` ends: at a parenthesis that closes around it, a set operation, or the statement's end."""
    depth = 0
    for j in range(i, len(ts)):
        depth += (ts[j] in "([") - (ts[j] in ")]")
        if depth < 0 or depth == 0 and ts[j].upper() in ("UNION", "INTERSECT", "EXCEPT", ";"):
            return j
    return len(ts)


def _parts(ts: list[str]) -> dict[str, list[str]] | None:
    """The items and clauses of a SELECT; None if it has others than these."""
    out, at, depth = {"ITEMS": []}, "ITEMS", 0
    for t in ts:
        depth += (t in "([") - (t in ")]")
        word = t.upper() if depth == 0 else ""
        if word in _REFUSED:
            return None
        if word in _CLAUSES and word not in out and not (word == "FROM" and at != "ITEMS"):
            at, out[word] = word, []
        else:
            out[at].append(t)
    return out


def _item(ts: list[str]) -> tuple[str, str] | None:
    """Expression and name of an item of the list; None if it has no plain name."""
    words = [t for t in ts if not _blank(t)]
    if len(words) > 2 and words[-2].upper() == "AS":
        k = max(i for i, t in enumerate(ts) if t.upper() == "AS")
        return _text(ts[:k]), words[-1]
    return ("".join(words), words[-1]) if re.fullmatch(r"(\w+\.)?[A-Za-z_]\w*", "".join(words)) else None


def _call(expression: str) -> tuple[str, str] | None:
    """Argument and p of a call of approx_percentile and nothing else."""
    ts = tokens(expression)
    j = _next(ts, 1)
    if ts[0].lower() != "approx_percentile" or j >= len(ts) or ts[j] != "(" or _close(ts, j) != len(ts) - 1:
        return None
    args = [_text(a) for a in _arguments(ts[j + 1 : -1])] + ["0.5"]
    return (args[0], args[1]) if len(args) in (2, 3) and re.fullmatch(r"\d+|\d*\.\d+", args[1]) and float(args[1]) <= 1 and "SELECT" not in map(str.upper, tokens(args[0])) else None


def _table(x: str, p: str, rows: str, keys: list[str]) -> str:
    """One row per group: g_1, g_2 ... and v_, the percentile."""
    names = [f"g_{i}" for i in range(len(keys))]
    listed = "".join(f"{n}, " for n in names)
    of = lambda a: "".join(f"{a}.{n}, " for n in names)
    same = lambda a, b: " AND ".join(f"{a}.{n} <=> {b}.{n}" for n in names) or "true"
    grouped = f" GROUP BY {', '.join(names)}" if names else ""
    source = f"(SELECT {''.join(f'{k} AS {n}, ' for k, n in zip(keys, names))}{x} AS x_ {rows})"
    low, high = max(float(p) - MARGIN, 0), min(float(p) + MARGIN, 1)
    sketch = f"(SELECT {listed}count(x_) AS n_, percentile_approx(x_, array({low:.8f}D, {float(p):.8f}D, {high:.8f}D), {ACCURACY}) AS r_ FROM {source} AS t_{grouped})"
    large = f"(SELECT {listed}n_, r_[0] AS low_, r_[2] AS high_ FROM {sketch} AS s_ WHERE n_ > {SMALL})"
    sided = f"(SELECT /*+ BROADCAST(l_) */ {of('t_')}n_, CASE WHEN x_ < low_ THEN 0 WHEN x_ <= high_ THEN 1 WHEN x_ > high_ THEN 2 ELSE 3 END AS side_, CASE WHEN x_ >= low_ AND x_ <= high_ THEN x_ END AS y_ FROM {source} AS t_ JOIN {large} AS l_ ON {same('t_', 'l_')})"
    counted = f"(SELECT {listed}n_, side_, y_, count(*) AS c_ FROM {sided} AS d_ GROUP BY {listed}n_, side_, y_)"
    ranked = f"(SELECT {listed}n_, side_, y_, sum(c_) OVER ({f'PARTITION BY {", ".join(names)} ' if names else ''}ORDER BY side_, y_) AS upto_ FROM {counted} AS c_)"
    found = f"(SELECT {listed}min(y_) AS y_ FROM {ranked} AS k_ WHERE side_ = 1 AND upto_ >= greatest(ceil({p} * n_), 1){grouped})"
    # n_ is read so that both uses of the sketch are one and the same plan, which runs once.
    return f"(SELECT {of('s_')}CASE WHEN s_.n_ > 0 THEN coalesce(f_.y_, s_.r_[1]) END AS v_ FROM {sketch} AS s_ LEFT JOIN {found} AS f_ ON {same('s_', 'f_')})"


def _rewritten(ts: list[str]) -> str | None:
    parts = _parts(ts)
    if parts is None or "FROM" not in parts or _word(parts["ITEMS"], 0) in ("DISTINCT", "ALL") or _VARYING & {t.upper() for t in ts}:
        return None
    items = [_item(a) for a in _arguments(parts["ITEMS"])]
    by = parts.get("GROUP", [])
    keys = [_text(k) for k in _arguments(by[_next(by, 0) + 1 :])]
    if None in items or any(re.fullmatch(r"\d+|(?i:all)", k) or re.search(r"(?i)\b(rollup|cube|sets)\b", k) for k in keys):
        return None
    calls = [_call(e) for e, _ in items]
    others = [t.lower() for (e, _), c in zip(items, calls) if c is None for t in tokens(e)] + [t.lower() for t in parts.get("HAVING", [])]
    if not any(calls) or "approx_percentile" in others:
        return None
    clause = lambda name: f"{name} {_text(parts[name])}" if name in parts else ""
    rows = f"{clause('FROM')} {clause('WHERE')}".strip()
    kept = [f"{e} AS c_{i}" for i, (e, _) in enumerate(items) if calls[i] is None] + [f"{k} AS g_{i}" for i, k in enumerate(keys)]
    kept = kept if any(c is None for c in calls) or keys else ["count(*) AS c_"]
    rest = f"(SELECT {', '.join(kept)} {rows} {clause('GROUP')} {clause('HAVING')})"
    tables = list(dict.fromkeys(c for c in calls if c))
    joins = "".join(f" JOIN {_table(x, p, rows, keys)} AS p_{n} ON " + (" AND ".join(f"o_.g_{i} <=> p_{n}.g_{i}" for i in range(len(keys))) or "true") for n, (x, p) in enumerate(tables))
    outputs = ", ".join(f"CAST(p_{tables.index(c)}.v_ AS DOUBLE) AS {name}" if c else f"o_.c_{i} AS {name}" for i, ((_, name), c) in enumerate(zip(items, calls)))
    return f"SELECT {outputs} FROM {rest} AS o_{joins}"
