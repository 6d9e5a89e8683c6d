"""Connectivity queries over the event panel."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from touchline.operators import panel as pn
from touchline.plans.registry.common import rounded
from touchline.sources.derived import BIN_HOURS, panel

WINDOW, K, F_MIN, ROUNDS = 4, 3, 1.0, 99
ALPHA_PC = 0.6  # loose, so that the noise of the test tables leaves edges to compare
ZPC = NormalDist().inv_cdf(1 - ALPHA_PC / 2)


def _groups(df):
    return df.select("subject").distinct().withColumn("grp", (F.col("subject") % 2).cast("int"))


def _corr(spark, sf_dir):
    return pn.pair_corr(panel(spark, sf_dir))


def contrast(spark, sf_dir):
    r = _corr(spark, sf_dir)
    return pn.edge_contrast(r, _groups(panel(spark, sf_dir)))


def permuted(spark, sf_dir):
    return rounded(pn.permute(_corr(spark, sf_dir), _groups(panel(spark, sf_dir)), ROUNDS))


def agreement(spark, sf_dir):
    p = panel(spark, sf_dir)
    lagged = pn.granger1(p).filter(F.col("f") > F_MIN)
    scores = pn.pair_direction(p)
    turned = F.col("score") < 0
    directed = scores.select(
        "subject", F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"),
        F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"),
    )
    return rounded(pn.edge_agreement(lagged, directed))


QUERIES = {
    "pair_corr": lambda s, d: rounded(_corr(s, d)),
    "sliding_corr": lambda s, d: rounded(pn.sliding_corr(panel(s, d), WINDOW)),
    "granger1": lambda s, d: rounded(pn.granger1(panel(s, d))),
    "pair_direction": lambda s, d: rounded(pn.pair_direction(panel(s, d))),
    "pc_skeleton": lambda s, d: rounded(pn.pc_skeleton(_corr(s, d), ALPHA_PC)),
    "edge_contrast": lambda s, d: rounded(contrast(s, d)),
    "top_regions": lambda s, d: rounded(pn.top_regions(contrast(s, d), K)),
    "split_half": lambda s, d: rounded(pn.split_half(panel(s, d))),
    "permute": permuted,
    "edge_agreement": agreement,
}

_P = f"""WITH panel AS (
  SELECT user_id AS subject, event_type AS region,
    CAST(floor((date_diff('day', DATE '2024-01-01', CAST(ts AS date)) * 24 + hour(ts)) / {BIN_HOURS}) AS bigint) AS t, avg(value) AS x
  FROM events GROUP BY 1, 2, 3),
z AS (SELECT subject, region, t, (x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w > 0 THEN stddev_pop(x) OVER w ELSE 1 END AS x FROM panel WINDOW w AS (PARTITION BY subject, region)),
r AS (SELECT a.subject, a.region AS src, b.region AS dst, count(*) AS n, nullif(corr(a.x, b.x), 'nan') AS r
  FROM panel a JOIN panel b ON a.subject = b.subject AND a.t = b.t AND a.region < b.region GROUP BY 1, 2, 3)"""

_GRANGER = """
g3 AS (SELECT y.subject, s.region AS src, y.region AS dst, count(*) AS n, corr(y.x, l.x) AS a, corr(y.x, s.x) AS b, corr(l.x, s.x) AS c
  FROM panel y JOIN panel l ON l.subject = y.subject AND l.region = y.region AND l.t = y.t - 1
  JOIN panel s ON s.subject = y.subject AND s.t = y.t - 1 AND s.region <> y.region GROUP BY 1, 2, 3),
granger AS (SELECT subject, src, dst, n, (fu - a * a) / ((1 - fu) / (n - 3)) AS f
  FROM (SELECT *, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS fu FROM g3) WHERE n > 3)"""

_DIRECTION = """
direction AS (SELECT a.subject, a.region AS src, b.region AS dst, count(*) AS n,
    nullif(corr(a.x, b.x), 'nan') * avg(a.x * tanh(b.x) - tanh(a.x) * b.x) AS score
  FROM z a JOIN z b ON a.subject = b.subject AND a.t = b.t AND a.region < b.region GROUP BY 1, 2, 3)"""

_CONTRAST = """
contrast AS (SELECT src, dst, n1, n0, mean1, mean0, (mean1 - mean0) / sqrt(v1 / n1 + v0 / n0) AS t FROM (
  SELECT src, dst, count(r) FILTER (subject % 2 = 1) AS n1, count(r) FILTER (subject % 2 = 0) AS n0,
    avg(r) FILTER (subject % 2 = 1) AS mean1, avg(r) FILTER (subject % 2 = 0) AS mean0,
    var_samp(r) FILTER (subject % 2 = 1) AS v1, var_samp(r) FILTER (subject % 2 = 0) AS v0 FROM r GROUP BY 1, 2)
  WHERE n1 > 1 AND n0 > 1)"""


def _draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 15) AS bigint)"


def _group(name: str, join: str) -> str:
    return f"""{name} AS (SELECT r.src, r.dst, k.round, count(*) AS n, avg(r.r) AS m, var_samp(r.r) AS v
        FROM r CROSS JOIN k {join} WHERE r.r IS NOT NULL GROUP BY 1, 2, 3)"""


ORACLE = {
    "split_half": f"""{_P}, h AS (SELECT *, {_draw("subject", "t", "0")} % 2 AS half FROM panel),
      c AS (SELECT a.subject, a.region AS src, b.region AS dst, a.half, nullif(corr(a.x, b.x), 'nan') AS r FROM h a JOIN h b
        ON a.subject = b.subject AND a.half = b.half AND a.t = b.t AND a.region < b.region GROUP BY 1, 2, 3, 4),
      w AS (SELECT subject, src, dst, max(round(r, 9)) FILTER (half = 0) AS r0, max(round(r, 9)) FILTER (half = 1) AS r1 FROM c GROUP BY 1, 2, 3)
      SELECT subject, count(*) AS n_edges, round(nullif(corr(r0, r1), 'nan'), 6) + 0.0 AS stability FROM w GROUP BY subject""",
    "permute": f"""{_P},{_CONTRAST}, g AS (SELECT DISTINCT subject, subject % 2 AS grp FROM panel),
      k AS (SELECT unnest(range(1, {ROUNDS} + 1)) AS round),
      d AS (SELECT subject, round, row_number() OVER (PARTITION BY round ORDER BY {_draw("subject", "round", "0")}) AS rk FROM g, k),
      chosen AS (SELECT subject, round FROM d WHERE rk <= (SELECT count(*) FROM g WHERE grp = 1)),
      {_group("one", "JOIN chosen USING (subject, round)")},
      {_group("zero", "ANTI JOIN chosen ON chosen.subject = r.subject AND chosen.round = k.round")},
      drawn AS (SELECT src, dst, abs((one.m - zero.m) / sqrt(one.v / one.n + zero.v / zero.n)) AS dt
        FROM one JOIN zero USING (src, dst, round) WHERE one.n > 1 AND zero.n > 1)
      SELECT src, dst, round(t, 6) AS t, count(dt) AS rounds,
        round((1 + count(*) FILTER (dt >= abs(t) * (1 - 1e-9))) / (1 + count(dt)), 6) AS p
      FROM contrast LEFT JOIN drawn USING (src, dst) GROUP BY src, dst, t""",
    "pair_corr": f"{_P} SELECT subject, src, dst, n, round(r, 6) AS r FROM r",
    "sliding_corr": f"""{_P}, p AS (SELECT a.subject, a.region AS src, b.region AS dst, a.t, a.x AS xa, b.x AS xb
        FROM panel a JOIN panel b ON a.subject = b.subject AND a.t = b.t AND a.region < b.region)
      SELECT subject, src, dst, t, round(CASE WHEN count(*) OVER w = {WINDOW} THEN corr(xa, xb) OVER w END, 6) AS r FROM p
      WINDOW w AS (PARTITION BY subject, src, dst ORDER BY t ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)""",
    "granger1": f"{_P},{_GRANGER} SELECT subject, src, dst, n, round(f, 6) AS f FROM granger",
    "pair_direction": f"{_P},{_DIRECTION} SELECT subject, src, dst, n, round(score, 6) AS score FROM direction",
    "pc_skeleton": f"""{_P}, e AS (SELECT * FROM r WHERE n > 3 AND abs(atanh(r)) * sqrt(n - 3) > {ZPC}),
      f AS (SELECT subject, src, dst, r, n FROM r WHERE r IS NOT NULL UNION ALL SELECT subject, dst, src, r, n FROM r WHERE r IS NOT NULL),
      k AS (SELECT subject, src, dst FROM e UNION ALL SELECT subject, dst, src FROM e),
      c AS (SELECT e.subject, e.src, e.dst FROM e
        JOIN f x ON x.subject = e.subject AND x.src = e.src AND x.dst <> e.dst
        JOIN f y ON y.subject = e.subject AND y.src = e.dst AND y.dst = x.dst
        WHERE (EXISTS (SELECT 1 FROM k WHERE k.subject = e.subject AND k.src = e.src AND k.dst = x.dst)
            OR EXISTS (SELECT 1 FROM k WHERE k.subject = e.subject AND k.src = e.dst AND k.dst = x.dst))
          AND CASE WHEN least(e.n, x.n, y.n) <= 4 THEN true ELSE
            abs(atanh((e.r - x.r * y.r) / sqrt((1 - x.r * x.r) * (1 - y.r * y.r)))) * sqrt(least(e.n, x.n, y.n) - 4) <= {ZPC} END)
      SELECT subject, src, dst, round(r, 6) AS r FROM e ANTI JOIN c USING (subject, src, dst)""",
    "edge_contrast": f"""{_P},{_CONTRAST} SELECT src, dst, n1, n0, round(mean1, 6) AS mean1, round(mean0, 6) AS mean0, round(t, 6) AS t
      FROM contrast""",
    "top_regions": f"""{_P},{_CONTRAST}, x AS (SELECT src AS region, abs(t) AS t FROM contrast UNION ALL SELECT dst, abs(t) FROM contrast)
      SELECT region, round(avg(t), 6) AS mean_abs_t, count(*) AS n_edges FROM x GROUP BY region
      ORDER BY avg(t) DESC, region LIMIT {K}""",
    "edge_agreement": f"""{_P},{_GRANGER},{_DIRECTION}, a AS (SELECT subject, src, dst, 1 AS ia FROM granger WHERE f > {F_MIN}),
      b AS (SELECT subject, CASE WHEN score < 0 THEN dst ELSE src END AS src, CASE WHEN score < 0 THEN src ELSE dst END AS dst, 1 AS ib FROM direction)
      SELECT subject, count(*) FILTER (ia = 1 AND ib = 1) AS n_both, count(*) FILTER (ib IS NULL) AS n_only_a,
        count(*) FILTER (ia IS NULL) AS n_only_b, round(count(*) FILTER (ia = 1 AND ib = 1) / count(*), 6) AS jaccard
      FROM a FULL JOIN b USING (subject, src, dst) GROUP BY subject""",
}
