"""The k-means of ``operators.lloyd`` as DuckDB SQL: farthest-point start and Lloyd
steps as recursive CTEs over lists of centres, written from the method's
description and independent of the Spark code."""

from __future__ import annotations

BIG = "1000000"


def dist(cols: list[str], c: str, row: str = "x") -> str:
    return " + ".join(f"({row}.{v} - {c}[{j + 1}]) * ({row}.{v} - {c}[{j + 1}])" for j, v in enumerate(cols))


def _dists(cols: list[str], centres: str, row: str = "x") -> str:
    return f"list_transform({centres}, lambda c: {dist(cols, 'c', row)})"


def fit_ctes(p: str, train: str, cols: list[str], ks: list[int], steps: int, test: str | None = None) -> list[str]:
    """CTEs on ``train`` (columns g, id and the features; ``test`` alike, scored instead).

    ``{p}_models``: g, k, n, sse, centres (list of lists, in millionths), fill.  ``{p}_x``:
    g, id and the filled whole features."""
    whole = ", ".join(f"round({c}::DOUBLE * {BIG}) AS {c}" for c in cols)
    fills = ", ".join(f"coalesce(round(sum(round({c}::DOUBLE * {BIG})::HUGEINT)::DOUBLE / count({c})), 0) AS {c}" for c in cols)
    filled = ", ".join(f"coalesce(r.{c}, f.{c}) AS {c}" for c in cols)
    row = "[" + ", ".join(f"x.{c}" for c in cols) + "]"
    mean = "[" + ", ".join(f"f.{c}" for c in cols) + "]"
    kmax = max(ks)
    kl = "(VALUES " + ", ".join(f"({k})" for k in ks) + ") kk(k)"
    sums = ", ".join(f"sum(x.{c}::HUGEINT)::DOUBLE / count(*)" for c in cols)

    def rows(name, src):
        return f"""{name} AS (
  SELECT r.g, r.id, {filled} FROM (SELECT g, id, {whole} FROM {src}) r JOIN {p}_f f ON f.g IS NOT DISTINCT FROM r.g)"""
    scored = f"{p}_x" if test is None else f"{p}_t"
    ctes = [
        f"{p}_f AS (SELECT g, count(*) AS n, {fills} FROM {train} GROUP BY g)",
        rows(f"{p}_x", train),
        f"""{p}_seq(g, t, seq) AS (
  SELECT g, 1, [m.v] FROM (
    SELECT x.g, min({{'d': {dist(cols, 'm.c')}, 'v': {row}}}) AS m FROM {p}_x x
    JOIN (SELECT g, {mean} AS c FROM {p}_f f) m ON m.g IS NOT DISTINCT FROM x.g GROUP BY x.g) s
  UNION ALL
  SELECT g, t + 1, CASE WHEN m.d < 0 THEN list_append(seq, m.v) ELSE seq END FROM (
    SELECT s.g, s.t, s.seq, min({{'d': -list_min({_dists(cols, 's.seq')}), 'v': {row}}}) AS m
    FROM {p}_seq s JOIN {p}_x x ON x.g IS NOT DISTINCT FROM s.g WHERE s.t < {kmax} GROUP BY s.g, s.t, s.seq) u)""",
        f"""{p}_it(step, g, k, centres) AS (
  SELECT 0, s.g, kk.k, list_slice(s.seq, 1, kk.k) FROM {p}_seq s, {kl} WHERE s.t = {kmax}
  UNION ALL
  SELECT step + 1, g, k, list_transform(range(1, len(centres) + 1), lambda i:
      coalesce(list_extract(list_filter(found, lambda e: e.j = i), 1).c, list_extract(centres, i))) FROM (
    SELECT step, g, k, centres, list({{'j': j, 'c': c}}) AS found FROM (
      SELECT step, g, k, centres, j, [{', '.join(f'c{i}' for i in range(len(cols)))}] AS c FROM (
        SELECT x.step, x.g, x.k, x.centres, x.j, {', '.join(f'sum(x.{c}::HUGEINT)::DOUBLE / count(*) AS c{i}' for i, c in enumerate(cols))}
        FROM (SELECT i.step, i.g, i.k, i.centres, {', '.join(f'x.{c}' for c in cols)},
                list_position({_dists(cols, 'i.centres')}, list_min({_dists(cols, 'i.centres')})) AS j
              FROM {p}_it i JOIN {p}_x x ON x.g IS NOT DISTINCT FROM i.g WHERE i.step < {steps}) x
        GROUP BY x.step, x.g, x.k, x.centres, x.j) a) b
    GROUP BY step, g, k, centres) w)"""]
    if test is not None:
        ctes.append(rows(f"{p}_t", test))
    ctes.append(f"""{p}_models AS (
  SELECT i.g, i.k, f.n, coalesce(s.sse, 0) AS sse, i.centres, {mean} AS fill
  FROM {p}_it i JOIN {p}_f f ON f.g IS NOT DISTINCT FROM i.g
  LEFT JOIN (SELECT i.g, i.k, sum(round(list_min({_dists(cols, 'i.centres')}) * 0.001)::HUGEINT)::DOUBLE / 1e9 AS sse
             FROM {p}_it i JOIN {scored} x ON x.g IS NOT DISTINCT FROM i.g WHERE i.step = {steps} GROUP BY i.g, i.k) s
    ON s.g IS NOT DISTINCT FROM i.g AND s.k = i.k
  WHERE i.step = {steps})""")
    return ctes


def grow_ctes(p: str, n_cols: int) -> list[str]:
    """``{p}_best``: per g the model of the last k before the drop is too small."""
    cutoff = f"least(0.02 + 10.0::DOUBLE / n + {2.5 / n_cols ** 2!r}, 0.8)"
    return [f"""{p}_drop AS (
  SELECT *, CASE WHEN k = 1 THEN 1 WHEN lag(sse) OVER w = 0 THEN 0
              WHEN (lag(sse) OVER w - sse) / lag(sse) OVER w >= {cutoff} THEN 1 ELSE 0 END AS grows
  FROM {p}_models WINDOW w AS (PARTITION BY g ORDER BY k))""",
            f"""{p}_kept AS (
  SELECT *, min(grows) OVER (PARTITION BY g ORDER BY k) AS good FROM {p}_drop)""",
            f"""{p}_best AS (
  SELECT g, k, n, sse, centres, fill FROM (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY k DESC) AS rn FROM {p}_kept WHERE good = 1) t WHERE rn = 1)"""]


def label_ctes(p: str, models: str, cols: list[str], units: str = "c[{j}]") -> list[str]:
    """``{p}_cen``: g, Cluster, c (by falling F+M+T+S-R; ``units`` gives a feature in
    input units) and ``{p}_lab``: g, id, Cluster."""
    score = " + ".join(f"({units.format(j=j + 1, c=c)}) * ({-1.0 if c.lower().startswith('recency') else 1.0})"
                       for j, c in enumerate(cols))
    return [f"""{p}_cen AS (
  SELECT g, CAST(row_number() OVER (PARTITION BY g ORDER BY {score} DESC, i) AS INTEGER) AS Cluster, c FROM (
    SELECT g, unnest(centres) AS c, unnest(range(1, len(centres) + 1)) AS i FROM {models}) t)""",
            f"""{p}_lab AS (
  SELECT g, id, Cluster FROM (
    SELECT x.g, x.id, n.Cluster, row_number() OVER (PARTITION BY x.g, x.id ORDER BY {dist(cols, 'n.c')}, n.Cluster) AS rn
    FROM {p}_x x JOIN {p}_cen n ON n.g IS NOT DISTINCT FROM x.g) t WHERE rn = 1)"""]
