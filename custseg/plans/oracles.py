"""DuckDB SQL equivalents of the registered queries.

The tables ``orders customer events`` are views over the same Parquet files.
The CTEs below restate FIXTURES.md (the mapping of the reference's warehouse
relations onto those tables) and the reference's extracts in SQL, written
independently of the Spark code.
"""

from __future__ import annotations

import math

from custseg.plans.kmeans_sql import dist, fit_ctes, grow_ctes, label_ctes

ORDERS_AS_OF = "DATE '2001-08-01'"
READER_AS_OF = "DATE '2024-01-30'"


def _key(col: str) -> str:
    return f"CAST(year({col}) * 10000 + month({col}) * 100 + day({col}) AS INTEGER)"


FIXTURES = f"""
order_fact AS (
  SELECT CAST(o_custkey AS BIGINT) AS Customer_Key,
         {_key('o_orderdate')} AS DateOrdered_Key,
         CAST(o_totalprice AS DECIMAL(18,2)) AS "5_DB2",
         CASE WHEN o_orderstatus = 'F' THEN {_key('o_orderdate')} ELSE -1 END AS DateCancelled_Key,
         CAST(o_orderdate AS DATE) AS Date
  FROM orders),
premium_active AS (
  SELECT CAST(c_custkey AS BIGINT) AS Customer_Key,
         CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS IsActive
  FROM customer WHERE c_custkey % 3 <> 0),
premium_subscribed AS (
  SELECT CAST(c_custkey AS BIGINT) AS Customer_Key FROM customer WHERE c_custkey % 3 <> 0),
reader_fact AS (
  SELECT CAST(user_id AS BIGINT) AS Customer_Key,
         {_key('ts')} AS Date_Key,
         CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS Streaming_Key,
         CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS IsBucketRead_Key,
         1 AS Premium_Key,
         CAST(ts AS DATE) AS Date
  FROM events),
cltv_input AS (
  SELECT CAST(c_custkey AS BIGINT) AS Customer_Key,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'BTC' ELSE c_mktsegment END AS Segment
  FROM customer),
churn_data AS (
  SELECT CAST(c_custkey AS BIGINT) AS Customer_Key, c_mktsegment AS RFM_cluster FROM customer)"""


def orders_cte(name: str, years: int, active: bool = True) -> str:
    act = "AND p.IsActive = 1" if active else ""
    extra = "" if active else ", p.IsActive"
    return f"""
{name} AS (
  SELECT f.DateOrdered_Key, f.Customer_Key, f."5_DB2"{extra}
  FROM order_fact f JOIN premium_active p ON p.Customer_Key = f.Customer_Key
  WHERE f.Customer_Key <> -1 {act} AND f.DateCancelled_Key = -1
    AND f.Date >= {ORDERS_AS_OF} - {365 * years})"""


NON_PREMIUM = f"""
orders_np AS (
  SELECT f.DateOrdered_Key, f.Customer_Key, f."5_DB2", CAST(NULL AS INTEGER) AS IsActive
  FROM order_fact f LEFT JOIN premium_active p ON p.Customer_Key = f.Customer_Key
  WHERE f.Customer_Key <> -1 AND f.DateCancelled_Key = -1
    AND f.Date >= {ORDERS_AS_OF} - 365 AND p.Customer_Key IS NULL)"""

STREAMING = f"""
streaming AS (
  SELECT DISTINCT s.Customer_Key, CAST(COALESCE(t.n, 0) AS BIGINT) AS n
  FROM premium_subscribed s LEFT JOIN (
    SELECT Customer_Key, count(Customer_Key) AS n FROM reader_fact
    WHERE Streaming_Key = 1 AND IsBucketRead_Key = 1 AND Premium_Key = 1
      AND Date >= {READER_AS_OF} - 365
    GROUP BY Customer_Key) t ON s.Customer_Key = t.Customer_Key)"""


def lines_cte(name: str, src: str) -> str:
    return f"""
{name} AS (
  SELECT Customer_Key,
         CAST(try_strptime(CAST(DateOrdered_Key AS VARCHAR), '%Y%m%d') AS DATE) AS Date,
         "5_DB2" AS DB2
  FROM {src})"""


def features_cte(name: str, lines: str) -> str:
    """RFMT with the reference date = max(Date) of ``lines``; R's NA rules."""
    return f"""
{name} AS (
  SELECT l.Customer_Key,
         CAST(r.last_date - CASE WHEN count(l.Date) < count(*) THEN NULL ELSE max(l.Date) END AS INTEGER) AS RecencyDays,
         CAST(count(*) AS BIGINT) AS Frequency,
         CAST(CASE WHEN count(l.DB2) < count(*) THEN NULL ELSE sum(l.DB2) END AS DOUBLE) AS Monetary,
         CAST(r.last_date - CASE WHEN count(l.Date) < count(*) THEN NULL ELSE min(l.Date) END AS INTEGER) AS Tenure
  FROM {lines} l,
       (SELECT CASE WHEN count(Date) < count(*) THEN NULL ELSE max(Date) END AS last_date FROM {lines}) r
  GROUP BY l.Customer_Key, r.last_date)"""


def quartiles_cte(name: str, feats: str, metrics=("RecencyDays", "Frequency", "Monetary", "Tenure")) -> str:
    spec = {
        "RecencyDays": "NTILE(4) OVER (ORDER BY RecencyDays DESC, Customer_Key) AS R_Quantile",
        "Frequency": "NTILE(4) OVER (ORDER BY Frequency, Customer_Key) AS F_Quantile",
        "Monetary": "NTILE(4) OVER (ORDER BY Monetary, Customer_Key) AS M_Quantile",
        "Tenure": "NTILE(4) OVER (ORDER BY Tenure, Customer_Key) AS T_Quantile",
        "Streaming": "NTILE(4) OVER (ORDER BY Streaming, Customer_Key) AS S_Quantile",
    }
    cols = ",\n         ".join(f"CAST({spec[m].split(' AS ')[0]} AS INTEGER) AS {spec[m].split(' AS ')[1]}"
                               for m in metrics)
    return f"""
{name} AS (
  SELECT *,
         {cols}
  FROM {feats})"""


def tiers_cte(name: str, q: str) -> str:
    return f"""
{name} AS (
  SELECT *,
         CASE WHEN Score > 12 THEN 'Gold' WHEN Score > 8 THEN 'Silver' WHEN Score > 0 THEN 'Bronze' END AS Customer_Segment,
         CAST(CASE WHEN Score > 12 THEN 1 WHEN Score > 8 THEN 2 WHEN Score > 0 THEN 3 END AS INTEGER) AS Segment_Order
  FROM (SELECT *,
               CAST(R_Quantile AS VARCHAR) || CAST(F_Quantile AS VARCHAR) || CAST(M_Quantile AS VARCHAR) || CAST(T_Quantile AS VARCHAR) AS RFM_Segment,
               CAST(R_Quantile + F_Quantile + M_Quantile + T_Quantile AS INTEGER) AS Score
        FROM {q}) s)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


TIERS_3Y = with_(FIXTURES, orders_cte("o3", 3), lines_cte("l3", "o3"),
                 features_cte("f3", "l3"), quartiles_cte("q3", "f3"), tiers_cte("t3", "q3"))


def oracle_sql() -> dict[str, str]:
    return all_oracles()


# =====================================================================
# Everything below extends the first slice to every O key of SURVEY §2.
# =====================================================================
BTC = "btc AS (SELECT DISTINCT Customer_Key FROM cltv_input WHERE Segment = 'BTC')"
SEGS = "segs AS (SELECT DISTINCT Customer_Key, Segment FROM cltv_input)"

BASE = [FIXTURES, orders_cte("o3", 3), orders_cte("o1", 1), lines_cte("l3", "o3"),
        lines_cte("l1", "o1"), features_cte("f3", "l3"), quartiles_cte("q3", "f3"),
        tiers_cte("t3", "q3"), STREAMING, BTC, SEGS]

RFMT_COLS = ["RecencyDays", "Frequency", "Monetary", "Tenure"]
RFMTS_COLS = RFMT_COLS + ["Streaming"]

COHORT = [
    "lc AS (SELECT * FROM l1 WHERE Customer_Key IN (SELECT Customer_Key FROM btc))",
    features_cte("fc", "lc"),
    """rfmts_c AS (
  SELECT fc.*, s.n AS Streaming FROM fc
  JOIN (SELECT * FROM streaming WHERE Customer_Key IN (SELECT Customer_Key FROM btc)) s
    ON s.Customer_Key = fc.Customer_Key)""",
]
ALL_REF = [
    features_cte("f1", "l1"),
    """rfmts_a AS (
  SELECT f1.*, s.n AS Streaming FROM f1
  JOIN btc b ON b.Customer_Key = f1.Customer_Key
  JOIN streaming s ON s.Customer_Key = f1.Customer_Key)""",
    """rfmts_seg AS (
  SELECT f1.*, s.n AS Streaming, g.Segment FROM f1
  JOIN streaming s ON s.Customer_Key = f1.Customer_Key
  JOIN segs g ON g.Customer_Key = f1.Customer_Key
  WHERE g.Segment IS NOT NULL)""",
]


def W(*extra: str) -> str:
    return with_(*BASE, *COHORT, *ALL_REF, *extra)


def r6(x: str) -> str:
    return f"round({x}, 6)"


# ------------------------------------------------------------ Yeo-Johnson
def yj(x: str, lam: str) -> str:
    return (f"(CASE WHEN {lam} IS NULL THEN {x} "
            f"WHEN {x} >= 0 THEN (CASE WHEN abs({lam}) < 0.001 THEN ln(1 + {x}) "
            f"ELSE (pow({x} + 1, {lam}) - 1) / {lam} END) "
            f"ELSE (CASE WHEN abs({lam} - 2) < 0.001 THEN -ln(1 - {x}) "
            f"ELSE -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END) END)")


LAM = "(CAST(c AS DOUBLE) / CAST(1000 AS DOUBLE))"


def long_cte(name: str, src: str, cols: list[str], ids: list[str]) -> str:
    idl = ", ".join(ids)
    parts = [f"SELECT {idl}, '{c}' AS metric, CAST({c} AS DOUBLE) AS x FROM {src} WHERE {c} IS NOT NULL"
             for c in cols]
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def lambda_ctes(p: str, long: str, keys: list[str]) -> list[str]:
    k = ", ".join(keys)
    on = " AND ".join(f"l.{c} = b.{c}" for c in keys)
    lk = ", ".join(f"l.{c}" for c in keys)
    ctes = [f"""{p}_st AS (
  SELECT {k}, count(*) AS n, count(DISTINCT x) AS nd, sum(sign(x) * ln(1 + abs(x))) AS const
  FROM {long} GROUP BY {k})""",
            f"""{p}_e0 AS (
  SELECT {k}, c, var_pop(y) AS v, avg(y) AS mu FROM (
    SELECT {lk}, g.c, {yj('l.x', '(CAST(g.c AS DOUBLE) / CAST(1000 AS DOUBLE))')} AS y
    FROM {long} l, (SELECT range AS c FROM range(-5000, 5001, 100)) g) t
  GROUP BY {k}, c)"""]

    def best(level: int) -> str:
        ek = ", ".join(f"e.{c}" for c in keys)
        son = " AND ".join(f"e.{c} = s.{c}" for c in keys)
        return f"""{p}_b{level} AS (
  SELECT {k}, c, ll FROM (
    SELECT {ek}, e.c, -0.5 * s.n * ln(e.v) + ({LAM.replace('c', 'e.c')} - 1) * s.const AS ll,
           row_number() OVER (PARTITION BY {ek} ORDER BY -0.5 * s.n * ln(e.v) + ({LAM.replace('c', 'e.c')} - 1) * s.const DESC, e.c ASC) AS rn
    FROM {p}_e{level} e JOIN {p}_st s ON {son}
    WHERE e.v > 1e-12 * e.mu * e.mu AND e.v > 0) t WHERE rn = 1)"""

    ctes.append(best(0))
    for level, step in ((1, 10), (2, 1)):
        ctes.append(f"""{p}_e{level} AS (
  SELECT {k}, c, var_pop(y) AS v, avg(y) AS mu FROM (
    SELECT {lk}, b.c + r.d * {step} AS c,
           {yj('l.x', f'(CAST(b.c + r.d * {step} AS DOUBLE) / CAST(1000 AS DOUBLE))')} AS y
    FROM {long} l JOIN {p}_b{level - 1} b ON {on}, range(-10, 11) r(d)
    WHERE b.c + r.d * {step} BETWEEN -5000 AND 5000) t
  GROUP BY {k}, c)""")
        ctes.append(best(level))
    sb = " AND ".join(f"s.{c} = b.{c}" for c in keys)
    sk = ", ".join(f"s.{c}" for c in keys)
    ctes.append(f"""{p}_lam AS (
  SELECT {sk}, CASE WHEN s.nd < 5 OR b.c IS NULL
                      OR abs({LAM.replace('c', 'b.c')} + 5) <= 0.001
                      OR abs({LAM.replace('c', 'b.c')} - 5) <= 0.001
                    THEN NULL ELSE {LAM.replace('c', 'b.c')} END AS lambda,
         b.ll AS loglik, s.n, s.nd AS n_distinct
  FROM {p}_st s LEFT JOIN {p}_b2 b ON {sb})""")
    return ctes


def normalise_ctes(p: str, long: str, keys: list[str], ids: list[str], cols: list[str],
                   power: bool = True) -> list[str]:
    """Fit λ (optional), mean, SD on ``long``; result ``{p}_z`` wide by ids."""
    ctes = lambda_ctes(p, long, keys) if power else [
        f"{p}_lam AS (SELECT DISTINCT {', '.join(keys)}, CAST(NULL AS DOUBLE) AS lambda FROM {long})"]
    on = " AND ".join(f"l.{c} = m.{c}" for c in keys)
    lk = ", ".join(f"l.{c}" for c in keys)
    k = ", ".join(keys)
    idl = ", ".join(f"l.{c}" for c in ids if c not in keys)
    idsel = (idl + ", ") if idl else ""
    ctes.append(f"""{p}_y AS (
  SELECT {idsel}{lk}, {yj('l.x', 'm.lambda')} AS y
  FROM {long} l JOIN {p}_lam m ON {on})""")
    ctes.append(f"""{p}_ms AS (SELECT {k}, avg(y) AS mean, stddev_samp(y) AS sd FROM {p}_y GROUP BY {k})""")
    ctes.append(f"""{p}_zl AS (
  SELECT y.*, CASE WHEN m.sd IS NULL OR m.sd = 0 THEN 0.0 ELSE (y.y - m.mean) / m.sd END AS z
  FROM {p}_y y JOIN {p}_ms m ON {' AND '.join(f'y.{c} = m.{c}' for c in keys)})""")
    gk = [c for c in ids]
    ctes.append(f"""{p}_z AS (
  SELECT {', '.join(gk)}, {', '.join(f"max(CASE WHEN metric = '{c}' THEN z END) AS {c}" for c in cols)}
  FROM {p}_zl GROUP BY {', '.join(gk)})""")
    return ctes


NORM_TIERS = [long_cte("lt", "t3", RFMT_COLS, ["Customer_Key", "Customer_Segment", "Segment_Order"]),
              *normalise_ctes("nt", "lt", ["metric"], ["Customer_Key", "Customer_Segment", "Segment_Order"],
                              RFMT_COLS)]
NORM_RFMTS = [long_cte("lr", "rfmts_c", RFMTS_COLS, ["Customer_Key"]),
              *normalise_ctes("nr", "lr", ["metric"], ["Customer_Key"], RFMTS_COLS)]
STD_RFMTS = [long_cte("ls", "rfmts_c", RFMTS_COLS, ["Customer_Key"]),
             *normalise_ctes("ns", "ls", ["metric"], ["Customer_Key"], RFMTS_COLS, power=False)]
NORM_SEG = [long_cte("lg", "rfmts_seg", RFMTS_COLS, ["Customer_Key", "Segment"]),
            *normalise_ctes("ng", "lg", ["Segment", "metric"], ["Customer_Key", "Segment"], RFMTS_COLS)]


def rounded(src: str, ids: list[str], cols: list[str]) -> str:
    return f"SELECT {', '.join(ids)}, {', '.join(f'{r6(c)} AS {c}' for c in cols)} FROM {src}"


def morder(c: str) -> str:
    return (f"CAST(CASE {c} WHEN 'RecencyDays' THEN 1 WHEN 'Frequency' THEN 2 WHEN 'logFrequency' THEN 2 "
            f"WHEN 'Monetary' THEN 3 WHEN 'logMonetary' THEN 3 WHEN 'Tenure' THEN 4 WHEN 'Streaming' THEN 5 END AS INTEGER)")


def kde_sql(src: str, group: str, points: int = 512) -> str:
    """Linear binning on the places, then the Gaussian kernel over the weights."""
    return f"""
kr AS (SELECT name, min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / {points - 1} AS step FROM {src} GROUP BY name),
kw AS (
  SELECT name, {group}, i, sum(w) AS w FROM (
    SELECT v.name, v.{group}, unnest([floor(a), floor(a) + 1]) AS i, unnest([1 - (a - floor(a)), a - floor(a)]) AS w
    FROM (SELECT s.name, s.{group}, CASE WHEN r.step > 0 THEN least((s.value - r.lo) / r.step, {points - 1}) ELSE 0 END AS a
          FROM {src} s JOIN kr r ON r.name = s.name) v) u WHERE w > 0 GROUP BY name, {group}, i),
ks0 AS (
  SELECT name, {group}, count(*) AS n, stddev_samp(value) AS sd, min(value) AS low,
         (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34 AS iqr FROM {src} GROUP BY name, {group}),
kb AS (
  SELECT name, {group}, n, 0.9 * CASE WHEN least(sd, iqr) > 0 THEN least(sd, iqr) WHEN sd > 0 THEN sd
                                      WHEN abs(low) > 0 THEN abs(low) ELSE 1 END * pow(n, -0.2) AS h FROM ks0 WHERE n > 1),
kp AS (
  SELECT b.name, b.{group}, r.lo, r.step, b.n, b.h, p.p
  FROM kb b JOIN kr r ON r.name = b.name, range({points}) p(p) WHERE r.step > 0 OR p.p = 0)
SELECT k.name, {morder('k.name')} AS metric_order, k.{group}, CAST(k.p AS INTEGER) AS point, round(k.lo + k.p * k.step, 6) AS x,
       round(k.h, 6) AS bandwidth, k.n,
       round(sum(w.w * exp(-0.5 * pow((k.p - w.i) * k.step / k.h, 2))) / (k.n * k.h * sqrt(2 * pi())), 6) AS density
FROM kp k JOIN kw w ON w.name = k.name AND w.{group} IS NOT DISTINCT FROM k.{group}
GROUP BY k.name, k.{group}, k.p, k.lo, k.step, k.n, k.h"""


def hist_sql(src: str, group: str, bins: int = 30) -> str:
    w = f"((r.hi - r.lo) / {bins})"
    return f"""
hrng AS (SELECT name, min(value) AS lo, max(value) AS hi FROM {src} GROUP BY name),
hcnt AS (SELECT name, {group}, count(*) AS nn FROM {src} GROUP BY name, {group}),
hb AS (
  SELECT v.name, v.{group}, r.lo, r.hi,
         CAST(CASE WHEN {w} = 0 THEN 0 ELSE least(floor((v.value - r.lo) / {w} + 1e-9), {bins - 1}) END AS INTEGER) AS bin
  FROM {src} v JOIN hrng r ON r.name = v.name)
SELECT hb.name, {morder('hb.name')} AS metric_order, hb.{group}, hb.bin,
       round(hb.lo + hb.bin * ((hb.hi - hb.lo) / {bins}), 6) AS bin_lo,
       round(hb.lo + (hb.bin + 1) * ((hb.hi - hb.lo) / {bins}), 6) AS bin_hi,
       count(*) AS n,
       round(CASE WHEN (hb.hi - hb.lo) / {bins} > 0 THEN count(*) / (c.nn * ((hb.hi - hb.lo) / {bins})) END, 6) AS density
FROM hb JOIN hcnt c ON c.name = hb.name AND c.{group} IS NOT DISTINCT FROM hb.{group}
GROUP BY hb.name, hb.{group}, hb.bin, hb.lo, hb.hi, c.nn"""


LOG_LONG = """lf AS (
  SELECT Customer_Key, Customer_Segment, name, """ + morder("name") + """ AS metric_order, round(value, 6) AS value FROM (
    SELECT Customer_Key, Customer_Segment, 'RecencyDays' AS name, CASE WHEN RecencyDays > 0 THEN ln(RecencyDays) END AS value FROM t3 WHERE Monetary >= 0
    UNION ALL SELECT Customer_Key, Customer_Segment, 'logFrequency', CASE WHEN Frequency > 0 THEN ln(Frequency) END FROM t3 WHERE Monetary >= 0
    UNION ALL SELECT Customer_Key, Customer_Segment, 'logMonetary', ln(1 + Monetary) FROM t3 WHERE Monetary >= 0
    UNION ALL SELECT Customer_Key, Customer_Segment, 'Tenure', CAST(Tenure AS DOUBLE) FROM t3 WHERE Monetary >= 0) u
  WHERE value IS NOT NULL)"""

NORM_LONG = """dn AS (SELECT Customer_Key, Customer_Segment, name, value FROM (
  SELECT Customer_Key, Customer_Segment, 'RecencyDays' AS name, RecencyDays AS value FROM nt_z WHERE Monetary BETWEEN -3 AND 3
  UNION ALL SELECT Customer_Key, Customer_Segment, 'Frequency', Frequency FROM nt_z WHERE Monetary BETWEEN -3 AND 3
  UNION ALL SELECT Customer_Key, Customer_Segment, 'Monetary', Monetary FROM nt_z WHERE Monetary BETWEEN -3 AND 3
  UNION ALL SELECT Customer_Key, Customer_Segment, 'Tenure', Tenure FROM nt_z WHERE Monetary BETWEEN -3 AND 3) u
  WHERE value IS NOT NULL)"""

MORDER = ("CAST(CASE metric WHEN 'RecencyDays' THEN 1 WHEN 'Recency' THEN 1 WHEN 'Frequency' THEN 2 "
          "WHEN 'Monetary' THEN 3 WHEN 'Tenure' THEN 4 WHEN 'Streaming' THEN 5 END AS INTEGER)")


def profile_sql(src: str, group: str, cols: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT {group}, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM {src}"
                               for c in cols)
    return f"""SELECT {group}, metric, {MORDER} AS metric_order, round(avg(value), 6) AS value
FROM ({parts}) u GROUP BY {group}, metric"""


CENTRES = """cen AS (
  SELECT Segment_Order AS id, avg(RecencyDays) AS cr, avg(Frequency) AS cf, avg(Monetary) AS cm, avg(Tenure) AS ct
  FROM nt_z GROUP BY Segment_Order),
asg AS (
  SELECT Customer_Key, RecencyDays, Frequency, Monetary, Tenure, id AS Cluster, d FROM (
    SELECT z.*, c.id,
           (z.RecencyDays - c.cr) * (z.RecencyDays - c.cr) + (z.Frequency - c.cf) * (z.Frequency - c.cf)
           + (z.Monetary - c.cm) * (z.Monetary - c.cm) + (z.Tenure - c.ct) * (z.Tenure - c.ct) AS d,
           row_number() OVER (PARTITION BY z.Customer_Key ORDER BY
             (z.RecencyDays - c.cr) * (z.RecencyDays - c.cr) + (z.Frequency - c.cf) * (z.Frequency - c.cf)
             + (z.Monetary - c.cm) * (z.Monetary - c.cm) + (z.Tenure - c.ct) * (z.Tenure - c.ct), c.id) AS rn
    FROM nt_z z, cen c) t WHERE rn = 1)"""


def box_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT Cluster, '{c}' AS metric, {c} AS value FROM asg" for c in RFMT_COLS)
    return f"""
bl AS (SELECT * FROM ({parts}) u WHERE value BETWEEN -5.0 AND 5.0),
bq AS (SELECT Cluster, metric, count(*) AS n, quantile_cont(value, 0.25) AS q1,
              quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
       FROM bl GROUP BY Cluster, metric)
SELECT q.Cluster, q.metric, {morder('q.metric')} AS metric_order, q.n, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3,
       round(min(CASE WHEN b.value >= q.q1 - 1.5 * (q.q3 - q.q1) THEN b.value END), 6) AS lower,
       round(max(CASE WHEN b.value <= q.q3 + 1.5 * (q.q3 - q.q1) THEN b.value END), 6) AS upper
FROM bl b JOIN bq q ON q.Cluster = b.Cluster AND q.metric = b.metric
GROUP BY q.Cluster, q.metric, q.n, q.q1, q.median, q.q3"""


def sketch_ctes(name: str, src: str, keys: str, value: str, probs: list[float], accuracy: float = 0.01) -> str:
    """Quantiles ``q0, q1, …`` per ``keys`` from counts on a logarithmic scale."""
    step = math.log1p(2 * accuracy / (1 - accuracy))
    here = [f"CAST(floor((total - 1) * CAST({p} AS DOUBLE)) AS BIGINT) + 1" for p in probs]
    return f"""
{name}_s AS (
  SELECT {keys}, CAST(sign(x) AS INTEGER) AS side, CAST(CASE WHEN x = 0 THEN 0
         ELSE ceil(ln(abs(CASE WHEN x = 0 THEN 1 ELSE x END)) / CAST({step!r} AS DOUBLE) - 1e-9) END AS INTEGER) AS slot, count(*) AS w
  FROM (SELECT {keys}, CAST({value} AS DOUBLE) AS x FROM {src}) t WHERE x IS NOT NULL GROUP BY {keys}, side, slot),
{name}_u AS (
  SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY side, side * slot) AS upto, sum(w) OVER (PARTITION BY {keys}) AS total,
         side * CAST({2 / (math.exp(step) + 1)!r} AS DOUBLE) * exp(slot * CAST({step!r} AS DOUBLE)) AS mid FROM {name}_s),
{name} AS (
  SELECT {keys}, CAST(total AS BIGINT) AS n, {", ".join(
        f"max(CASE WHEN upto >= {r} AND upto - w < {r} THEN mid END) AS q{j}" for j, r in enumerate(here))}
  FROM {name}_u GROUP BY {keys}, total)"""


def _order_value_sql() -> str:
    probs = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    return W("ov AS (SELECT g.Segment, o.\"5_DB2\" AS v FROM o1 o JOIN segs g ON g.Customer_Key = o.Customer_Key)",
             sketch_ctes("oq", "ov", "Segment", "v", probs)) + "\nSELECT Segment, n, " + ", ".join(
        f"round(q{j}, 6) AS p{round(100 * p):02d}" for j, p in enumerate(probs)) + " FROM oq"


def _tier_box_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT Customer_Segment, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM t3" for c in RFMT_COLS)
    return W(f"tl AS (SELECT * FROM ({parts}) u WHERE value IS NOT NULL)",
             sketch_ctes("tq", "tl", "Customer_Segment, metric", "value", [0.25, 0.5, 0.75])) + f"""
SELECT q.Customer_Segment, q.metric, {morder('q.metric')} AS metric_order, q.n, round(q0, 6) AS q1, round(q.q1, 6) AS median, round(q2, 6) AS q3,
       round(min(CASE WHEN b.value >= q0 - 1.5 * (q2 - q0) THEN b.value END), 6) AS lower,
       round(max(CASE WHEN b.value <= q2 + 1.5 * (q2 - q0) THEN b.value END), 6) AS upper
FROM tl b JOIN tq q ON q.Customer_Segment = b.Customer_Segment AND q.metric = b.metric
GROUP BY q.Customer_Segment, q.metric, q.n, q0, q.q1, q2"""


def _quartile_sql(metric: str, out: str, desc: bool = False) -> str:
    order = f"{metric} DESC, Customer_Key" if desc else f"{metric}, Customer_Key"
    return W() + f"\nSELECT Customer_Key, {metric}, CAST(NTILE(4) OVER (ORDER BY {order}) AS INTEGER) AS {out} FROM f3"


def _rfmts_scores_sql() -> str:
    q = quartiles_cte("qs", "rfmts_c", RFMTS_COLS)
    return W(q) + """
SELECT *, CASE WHEN Score > 14 THEN 'Gold' WHEN Score > 9 THEN 'Silver' WHEN Score > 0 THEN 'Bronze' END AS Customer_Segment,
       CAST(CASE WHEN Score > 14 THEN 1 WHEN Score > 9 THEN 2 WHEN Score > 0 THEN 3 END AS INTEGER) AS Segment_Order
FROM (SELECT *, CAST(R_Quantile AS VARCHAR) || CAST(F_Quantile AS VARCHAR) || CAST(M_Quantile AS VARCHAR)
                 || CAST(T_Quantile AS VARCHAR) || CAST(S_Quantile AS VARCHAR) AS RFM_Segment,
             CAST(R_Quantile + F_Quantile + M_Quantile + T_Quantile + S_Quantile AS INTEGER) AS Score
      FROM qs) s"""


def _relative_importance_sql() -> str:
    g = """g AS (SELECT Customer_Segment, Segment_Order, avg(RecencyDays) AS r, avg(Frequency) AS f,
                 avg(Monetary) AS m, avg(Tenure) AS t FROM t3 GROUP BY Customer_Segment, Segment_Order),
p AS (SELECT avg(RecencyDays) AS r, avg(Frequency) AS f, avg(Monetary) AS m, avg(Tenure) AS t FROM t3)"""
    parts = []
    for name, col, pos in (("Recency", "r", 1), ("Frequency", "f", 2), ("Monetary", "m", 3), ("Tenure", "t", 4)):
        v = f"(g.{col} / p.{col} - 1)"
        parts.append(f"SELECT g.Customer_Segment, g.Segment_Order, '{name}' AS metric, {pos} AS metric_order, "
                     f"round({v}, 6) AS value, round({v}, 2) AS label FROM g, p")
    return W(g) + "\n" + "\nUNION ALL ".join(parts)


def _feature_ranges_sql() -> str:
    parts = [f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, "
             f"{morder(repr(c))} AS metric_order FROM rfmts_c" for c in ["Customer_Key", *RFMTS_COLS]]
    return W() + "\n" + "\nUNION ALL ".join(parts)


def _legacy_sql() -> str:
    ctes = """lb AS (SELECT Customer_Key, Customer_Segment, ln(1 + RecencyDays) AS r, ln(1 + Frequency) AS f,
                  ln(1 + CASE WHEN Monetary >= 0 THEN Monetary END) AS m, ln(1 + Tenure) AS t FROM t3),
lm AS (SELECT avg(r) AS r, avg(f) AS f, avg(m) AS m, avg(t) AS t FROM lb),
lr AS (SELECT lb.Customer_Key, lb.Customer_Segment, round_even(lb.r - lm.r, 1) AS r, round_even(lb.f - lm.f, 1) AS f,
              round_even(lb.m - lm.m, 1) AS m, round_even(lb.t - lm.t, 1) AS t FROM lb, lm),
ls AS (SELECT avg(r) AS ar, stddev_samp(r) AS sr, avg(f) AS af, stddev_samp(f) AS sf,
              avg(m) AS am, stddev_samp(m) AS sm, avg(t) AS a_t, stddev_samp(t) AS st FROM lr)"""
    return W(ctes) + """
SELECT Customer_Key, Customer_Segment, round((r - ar) / sr, 6) AS RecencyDays, round((f - af) / sf, 6) AS Frequency,
       round((m - am) / sm, 6) AS Monetary, round((t - a_t) / st, 6) AS Tenure FROM lr, ls"""


def _cohort_features_sql() -> str:
    ctes = [orders_cte("oa", 1, active=False), NON_PREMIUM, lines_cte("la", "oa"), lines_cte("ln", "orders_np"),
            features_cte("fa", "la"), features_cte("fn", "ln")]
    body = []
    for name, f in (("premium", "fa"), ("non_premium", "fn")):
        body.append(f"SELECT '{name}' AS cohort, f.Customer_Key, f.RecencyDays, f.Frequency, f.Monetary, g.Segment "
                    f"FROM {f} f JOIN segs g ON g.Customer_Key = f.Customer_Key WHERE g.Segment = 'BTC'")
    return W(*ctes) + "\n" + "\nUNION ALL ".join(body)


def R(*ctes: str) -> str:
    """``W`` with recursive CTEs."""
    return W(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def _auto(p: str, src: str, cols: list[str]) -> list[str]:
    return [*fit_ctes(p, src, cols, list(range(1, 11)), 10), *grow_ctes(p, len(cols)), *label_ctes(p, f"{p}_best", cols)]


def _source(name: str, table: str, cols: list[str], g: str = "''") -> str:
    return f"{name} AS (SELECT {g} AS g, Customer_Key AS id, {', '.join(cols)} FROM {table})"


AUTO = [*NORM_RFMTS, _source("ka_src", "nr_z", RFMTS_COLS), *_auto("ka", "ka_src", RFMTS_COLS)]
FIXED = [*NORM_RFMTS,
         "kst AS (SELECT " + ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_sd" for c in RFMTS_COLS) + " FROM nr_z)",
         "kf_src AS (SELECT '' AS g, Customer_Key AS id, " + ", ".join(
             f"CASE WHEN {c}_sd = 0 THEN 0.0 ELSE ({c} - {c}_mean) / {c}_sd END AS {c}" for c in RFMTS_COLS) + " FROM nr_z, kst)",
         *fit_ctes("kf", "kf_src", RFMTS_COLS, [7], 10),
         *label_ctes("kf", "kf_models", RFMTS_COLS,
                     "c[{j}] * (SELECT {c}_sd FROM kst) + (SELECT {c}_mean FROM kst) * 1000000")]
SEGMENTS = [*NORM_SEG, _source("ks_src", "ng_z", RFMTS_COLS, "Segment"), *_auto("ks", "ks_src", RFMTS_COLS),
            "ks_out AS (SELECT z.Segment, z.Customer_Key, l.Cluster, "
            + ", ".join(f"round(z.{c}, 6) AS {c}" for c in RFMTS_COLS)
            + " FROM ng_z z JOIN ks_lab l ON l.id = z.Customer_Key AND l.g = z.Segment)"]


def _normal(p: str, src: str, cols: list[str], keys: list[str] = (), ids: list[str] = ("Customer_Key",)) -> list[str]:
    return [long_cte(f"{p}l", src, cols, [*ids, *keys]),
            *normalise_ctes(p, f"{p}l", [*keys, "metric"], [*ids, *keys], cols)]


BEST = [*_normal("nb", "rfmts_a", RFMTS_COLS), _source("kb_src", "nb_z", RFMTS_COLS), *_auto("kb", "kb_src", RFMTS_COLS),
        "best AS (SELECT a.* FROM rfmts_a a JOIN kb_lab l ON l.id = a.Customer_Key WHERE l.Cluster = 1)"]


def _labelled(lab: str, z: str, extra: str = "") -> str:
    return ("\nSELECT z.Customer_Key, " + ", ".join(f"round(z.{c}, 6) AS {c}" for c in RFMTS_COLS)
            + f", l.Cluster{extra} FROM {z} z JOIN {lab} l ON l.id = z.Customer_Key")


def _centroids(cen: str, cols: list[str], unit: str = "c[{j}] / 1000000", keep: str = "") -> str:
    parts = [f"SELECT {keep}Cluster, '{c}' AS metric, {MORDER.replace('metric', repr(c))} AS metric_order, "
             f"round({unit.format(j=j + 1, c=c)} + 1e-9, 6) AS value FROM {cen}" for j, c in enumerate(cols)]
    return "\n" + "\nUNION ALL ".join(parts)


def _box(src: str, group: str, cols: list[str], limits: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT {group} AS grp, '{c}' AS metric, {c} AS value FROM {src}" for c in cols)
    return f"""
, bl AS (SELECT * FROM ({parts}) u WHERE value IS NOT NULL {limits}),
bq AS (SELECT grp, metric, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
              quantile_cont(value, 0.75) AS q3 FROM bl GROUP BY grp, metric)
SELECT q.grp AS {{group}}, q.metric, {morder('q.metric')} AS metric_order, q.n, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3,
       round(min(CASE WHEN b.value >= q.q1 - 1.5 * (q.q3 - q.q1) THEN b.value END), 6) AS lower,
       round(max(CASE WHEN b.value <= q.q3 + 1.5 * (q.q3 - q.q1) THEN b.value END), 6) AS upper
FROM bl b JOIN bq q ON q.grp = b.grp AND q.metric = b.metric
GROUP BY q.grp, q.metric, q.n, q.q1, q.median, q.q3"""


def kmeans_oracles() -> dict[str, str]:
    rfm = ["RecencyDays", "Frequency", "Monetary"]
    cohort = _cohort_features_sql()
    cohort_ctes, cohort_body = cohort.split("\nSELECT 'premium'", 1)
    cohort_ctes = cohort_ctes.replace("WITH ", "WITH RECURSIVE ", 1) + ",\ncohf AS (SELECT 'premium'" + cohort_body + "),\n"
    folds = "range(5) fo(f)"
    fold_src = "SELECT f AS g, Customer_Key AS id, " + ", ".join(RFMTS_COLS) + f" FROM nr_z, {folds} WHERE Customer_Key % 5 "
    units = "c[{j}] / 1000000 * (SELECT {c}_sd FROM kst) + (SELECT {c}_mean FROM kst)"
    sizes = "\nSELECT Cluster, count(*) AS n FROM {}_lab GROUP BY Cluster"
    other = ("rf AS (SELECT Customer_Key, " + ", ".join(RFMTS_COLS) + " FROM rfmts_seg WHERE Segment <> 'BTC')")
    return {
        "kmeans_auto_k": R(*AUTO) + _labelled("ka_lab", "nr_z"),
        "score_customers": R(*AUTO) + _labelled("ka_lab", "nr_z"),
        "model_roundtrip_scores": R(*AUTO) + "\nSELECT id AS Customer_Key, Cluster, Cluster AS Cluster_loaded FROM ka_lab",
        "cluster_sizes": R(*AUTO) + sizes.format("ka"),
        "cluster_profile": R(*AUTO) + _centroids("ka_cen", RFMTS_COLS),
        "auto_k_curve": R(*AUTO) + "\nSELECT CAST(m.k AS INTEGER) AS k, m.sse FROM ka_models m, ka_best b "
                                   "WHERE m.k <= least(b.k + 1, 10, b.n)",
        "kmeans_fixed_k": R(*FIXED) + _labelled("kf_lab", "nr_z"),
        "fixed_k_sizes": R(*FIXED) + sizes.format("kf"),
        "fixed_k_profile": R(*FIXED) + _centroids("kf_cen", RFMTS_COLS, units),
        "fixed_k_box_stats": R(*FIXED, "fb AS (SELECT l.Cluster, z.* FROM nr_z z JOIN kf_lab l ON l.id = z.Customer_Key)")
        + _box("fb", "Cluster", RFMTS_COLS).format(group="Cluster"),
        "export_roundtrip": R(*FIXED) + f"\nSELECT id AS Customer_Key, Cluster, {ORDERS_AS_OF} AS as_of FROM kf_lab",
        "scree_curve": R(*NORM_RFMTS, f"kc_src AS ({fold_src} <> f)", f"kc_out AS ({fold_src} = f)",
                         *fit_ctes("kc", "kc_src", RFMTS_COLS, list(range(1, 17)), 25, "kc_out"))
        + "\nSELECT CAST(k AS INTEGER) AS k, sum(round(sse * 1e9)::HUGEINT)::DOUBLE / 1e9 AS wss FROM kc_models GROUP BY k",
        "segment_clusters": R(*SEGMENTS) + "\nSELECT * FROM ks_out",
        "segment_profiles": R(*SEGMENTS) + "\n" + profile_sql("ks_out", "Segment, Cluster", RFMTS_COLS),
        "segment_box_stats": R(*SEGMENTS, "sb AS (SELECT Segment || '/' || CAST(Cluster AS VARCHAR) AS Grp, * FROM ks_out)")
        + _box("sb", "Grp", RFMTS_COLS, "AND value BETWEEN -5.0 AND 5.0").format(group='"Group"'),
        "cohort_comparison": cohort_ctes + ",\n".join([
            *_normal("nc", "cohf", rfm, ["cohort"]), _source("kh_src", "nc_z", rfm, "cohort"), *_auto("kh", "kh_src", rfm)])
        + _centroids("kh_cen", rfm, keep="g AS cohort, "),
        "best_cluster_members": R(*BEST) + "\nSELECT * FROM best",
        "nested_clusters": R(*BEST, *_normal("n2", "best", RFMTS_COLS), _source("k2_src", "n2_z", RFMTS_COLS),
                             *_auto("k2", "k2_src", RFMTS_COLS)) + _labelled("k2_lab", "n2_z"),
        "score_refit": R(*AUTO, other, *_normal("nx", "rf", RFMTS_COLS), "rx AS (SELECT Customer_Key, "
                         + ", ".join(f"coalesce(round({c} * 1000000), f.{c}_fill) AS {c}" for c in RFMTS_COLS)
                         + " FROM nx_z, (SELECT " + ", ".join(f"fill[{j + 1}] AS {c}_fill" for j, c in enumerate(RFMTS_COLS))
                         + " FROM ka_best) f)", "rl AS (SELECT id, Cluster FROM (SELECT x.Customer_Key AS id, n.Cluster, "
                         "row_number() OVER (PARTITION BY x.Customer_Key ORDER BY " + dist(RFMTS_COLS, "n.c")
                         + ", n.Cluster) AS rn FROM rx x, ka_cen n) t WHERE rn = 1)") + _labelled("rl", "nx_z"),
    }


def all_oracles() -> dict[str, str]:
    n_t = W(*NORM_TIERS)
    return kmeans_oracles() | {
        "source_orders": W() + "\nSELECT * FROM order_fact",
        "orders_active_premium_3y": W() + "\nSELECT * FROM o3",
        "orders_active_premium_1y": W() + "\nSELECT * FROM o1",
        "orders_premium_any": W(orders_cte("oa", 1, active=False)) + "\nSELECT * FROM oa",
        "orders_non_premium": W(NON_PREMIUM) + "\nSELECT * FROM orders_np",
        "streaming_counts": W() + "\nSELECT * FROM streaming",
        "segment_lookup": W() + "\nSELECT * FROM segs",
        "segment_lookup_one": W() + "\nSELECT DISTINCT Customer_Key, Segment FROM cltv_input WHERE Segment = 'BTC'",
        "cluster_label_counts": W() + "\nSELECT RFM_cluster, count(*) AS n FROM churn_data GROUP BY RFM_cluster",
        "snapshot_roundtrip": n_t + "\n" + rounded("nt_z", ["Customer_Key", "Customer_Segment", "Segment_Order"], RFMT_COLS),
        "order_lines": W() + "\nSELECT * FROM l1",
        "reference_date": W() + "\nSELECT CASE WHEN count(Date) < count(*) THEN NULL ELSE max(Date) END AS last_date FROM l1",
        "recency": W() + "\nSELECT Customer_Key, RecencyDays FROM f3",
        "frequency": W() + "\nSELECT Customer_Key, Frequency FROM f3",
        "monetary": W() + "\nSELECT Customer_Key, Monetary FROM f3",
        "tenure": W() + "\nSELECT Customer_Key, Tenure FROM f3",
        "rfmt_features": W() + "\nSELECT * FROM f3",
        "rolling_features": W() + "\nSELECT * FROM f1",
        "rfmts_features": W() + "\nSELECT * FROM rfmts_c",
        "rfmts_features_all": W() + "\nSELECT * FROM rfmts_a",
        "rfmts_features_by_segment": W() + "\nSELECT * FROM rfmts_seg",
        "cohort_bloom_semi_join": W() + "\nSELECT * FROM l1 WHERE Customer_Key IN (SELECT Customer_Key FROM btc)",
        "rfmts_features_bucketed": W() + "\nSELECT * FROM rfmts_c",
        "order_value_quantiles": _order_value_sql(),
        "tier_box_sketch": _tier_box_sql(),
        "cohort_semi_join": W() + "\nSELECT * FROM l1 WHERE Customer_Key IN (SELECT Customer_Key FROM btc)",
        "cohort_features": _cohort_features_sql(),
        "r_quartile": _quartile_sql("RecencyDays", "R_Quantile", desc=True),
        "f_quartile": _quartile_sql("Frequency", "F_Quantile"),
        "m_quartile": _quartile_sql("Monetary", "M_Quantile"),
        "t_quartile": _quartile_sql("Tenure", "T_Quantile"),
        "rfm_scores": W() + "\nSELECT Customer_Key, R_Quantile, F_Quantile, M_Quantile, T_Quantile, RFM_Segment, Score FROM t3",
        "customer_tiers": W() + "\nSELECT * FROM t3",
        "rfmts_scores": _rfmts_scores_sql(),
        "monetary_quartile_stats": W() + "\nSELECT M_Quantile, round(avg(Monetary), 6) AS mean_value, min(Monetary) AS min_value FROM t3 GROUP BY M_Quantile",
        "segment_code_sizes": W() + "\nSELECT RFM_Segment, count(*) AS n FROM t3 GROUP BY RFM_Segment",
        "tier_summary": W() + """
SELECT Customer_Segment, Segment_Order, round(avg(RecencyDays), 6) AS R_mean, round(avg(Frequency), 6) AS F_mean,
       round(avg(Monetary), 6) AS M_mean, round(avg(Tenure), 6) AS T_mean
FROM t3 GROUP BY Customer_Segment, Segment_Order""",
        "tier_counts": W() + "\nSELECT Customer_Segment, Segment_Order, count(*) AS n FROM t3 GROUP BY Customer_Segment, Segment_Order",
        "relative_importance": _relative_importance_sql(),
        "feature_ranges": _feature_ranges_sql(),
        "log_features_long": W(LOG_LONG) + "\nSELECT * FROM lf",
        "density_by_tier": W(LOG_LONG) + ",\n" + hist_sql("lf", "Customer_Segment").lstrip(),
        "kde_by_tier": W(LOG_LONG) + ",\n" + kde_sql("lf", "Customer_Segment").lstrip(),
        "kde_normalised": n_t + ",\n" + NORM_LONG + "," + kde_sql("dn", "Customer_Segment").lstrip(),
        "legacy_normalise": _legacy_sql(),
        "yeo_johnson_lambda": W(long_cte("lr", "rfmts_c", RFMTS_COLS, ["Customer_Key"]),
                                *lambda_ctes("nr", "lr", ["metric"]))
        + "\nSELECT metric, \"lambda\", round(loglik, 4) AS loglik, n, n_distinct FROM nr_lam",
        "yeo_johnson_by_segment": W(long_cte("lg", "rfmts_seg", RFMTS_COLS, ["Customer_Key", "Segment"]),
                                    *lambda_ctes("ng", "lg", ["Segment", "metric"]))
        + "\nSELECT Segment, metric, \"lambda\", round(loglik, 4) AS loglik, n, n_distinct FROM ng_lam",
        "yeo_johnson_apply": W(*NORM_RFMTS) + "\nSELECT Customer_Key, " + ", ".join(
            f"round(max(CASE WHEN metric = '{c}' THEN y END), 6) AS {c}" for c in RFMTS_COLS)
        + " FROM nr_y GROUP BY Customer_Key",
        "standardise": W(*STD_RFMTS) + "\n" + rounded("ns_z", ["Customer_Key"], RFMTS_COLS),
        "normalised_features": W(*NORM_RFMTS) + "\n" + rounded("nr_z", ["Customer_Key"], RFMTS_COLS),
        "normalised_tiers": n_t + "\n" + rounded("nt_z", ["Customer_Key", "Customer_Segment", "Segment_Order"], RFMT_COLS),
        "normalised_by_segment": W(*NORM_SEG) + "\n" + rounded("ng_z", ["Customer_Key", "Segment"], RFMTS_COLS),
        "tier_profile": n_t + "\n" + profile_sql("nt_z", "Customer_Segment", RFMT_COLS),
        "tier_profile_wide": n_t + ",\ntp AS (" + profile_sql("nt_z", "Customer_Segment", RFMT_COLS) + ")\n"
        + "SELECT Customer_Segment, " + ", ".join(f"max(CASE WHEN metric = '{c}' THEN value END) AS {c}" for c in RFMT_COLS)
        + " FROM tp GROUP BY Customer_Segment",
        "clip_outliers": n_t + "\n" + rounded("nt_z", ["Customer_Key", "Customer_Segment", "Segment_Order"], RFMT_COLS)
        + " WHERE Monetary BETWEEN -3 AND 3",
        "density_normalised": n_t + ",\n" + NORM_LONG + "," + hist_sql("dn", "Customer_Segment").lstrip(),
        "assign_nearest_centroid": n_t + ",\n" + CENTRES + "\nSELECT Customer_Key, Cluster FROM asg",
        "within_sse": n_t + ",\n" + CENTRES + "\nSELECT Cluster, count(*) AS n, round(sum(d), 6) AS sse FROM asg GROUP BY Cluster",
        "cluster_means": n_t + ",\n" + CENTRES + "\n" + profile_sql("asg", "Cluster", RFMT_COLS),
        "cluster_box_stats": n_t + ",\n" + CENTRES + "," + box_sql(),
    }
