"""Segments found on the supplied tables, their null calibration and the gate between two sets of them. The SQL makes the density
by a cross of points with the kernel's places, and finds peaks, prominences, valleys and bounds by windows and joins, without any of the operators' code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segment as sg
from ..session import written
from . import queries as q
from .queries import DAY, P, peaks, query, rounded

#: Seconds before the first event.
BASE = 1_704_067_200
SHUFFLES = 5
GRID = 600
SEGMENTER = sg.Segmenter(sigma=6, mode="constant", distance=1, fixed=True)


def segments_sql(key: str, segmenter: sg.Segmenter, low: int | None = None, high: int | None = None) -> str:
    """Common tables up to `found` (key, low, high, center, height), from cells (key, p, w). With low and high the grid ends there, and what lies
    beyond is mirrored; else it has no end. Segmenters of distance 1, for larger ones drop neighbours one after the other."""
    sigma, reach, unit = float(segmenter.sigma), int(4 * segmenter.sigma + 0.5), f"(1 / ({float(segmenter.sigma)} * sqrt(2 * pi())))"
    ended = low is not None
    mirrored = f" UNION ALL SELECT {key}, {2 * low - 1} - p, w FROM cells WHERE p < {low + reach} UNION ALL SELECT {key}, {2 * high + 1} - p, w FROM cells WHERE p > {high - reach}" if ended else ""
    inner = f" AND b > {low} AND e < {high}" if ended else ""
    edge = lambda side, at, none: f"CASE WHEN {at} IS NULL AND {none if ended else 'true'} THEN 0 ELSE {side} END"
    return f"""grid AS (SELECT {key}, p, w FROM cells{mirrored}),
taps AS (SELECT i, round(g / sum(g) OVER () * 16777216) / 16777216 AS tap FROM (SELECT i, exp(-0.5 * (i / {sigma}) * (i / {sigma})) AS g FROM (SELECT unnest(range({-reach}, {reach + 1})) AS i))),
dens AS (SELECT {key}, p + i AS p, sum(w * tap) AS d FROM grid, taps {f"WHERE p + i BETWEEN {low} AND {high}" if ended else ""} GROUP BY ALL HAVING sum(w * tap) > 0),
steps AS (SELECT *, CASE WHEN lag(p) OVER o = p - 1 THEN 0 ELSE 1 END AS opens, CASE WHEN lag(p) OVER o = p - 1 AND lag(d) OVER o = d THEN 0 ELSE 1 END AS changes FROM dens WINDOW o AS (PARTITION BY {key} ORDER BY p)),
g AS (SELECT {key}, p, d, sum(opens) OVER o AS island, sum(changes) OVER o AS run FROM steps WINDOW o AS (PARTITION BY {key} ORDER BY p)),
runs AS (SELECT {key}, island, run, min(p) AS b, max(p) AS e, any_value(d) AS d FROM g GROUP BY {key}, island, run),
tops AS (SELECT {key}, island, CAST(floor((b + e) / 2.0) AS BIGINT) AS c, d AS h FROM (SELECT *, coalesce(lag(d) OVER o, 0) AS before, coalesce(lead(d) OVER o, 0) AS after FROM runs WINDOW o AS (PARTITION BY {key}, island ORDER BY b)) WHERE before < d AND after < d AND d >= {segmenter.support - 0.5} * {unit}{inner}),
higher AS (SELECT {key}, island, c, h, max(p) FILTER (p < c AND d > h) AS hl, min(p) FILTER (p > c AND d > h) AS hr, min(p) AS s, max(p) AS z FROM tops JOIN g USING ({key}, island) GROUP BY {key}, island, c, h),
prominent AS (SELECT {key}, island, c, h, s, z FROM (SELECT {key}, island, c, h, s, z, hl, hr, {edge("min(d) FILTER (p > coalesce(hl, s - 1) AND p <= c)", "hl", f"s > {low}")} AS fl, {edge("min(d) FILTER (p >= c AND p < coalesce(hr, z + 1))", "hr", f"z < {high}")} AS fr FROM higher JOIN g USING ({key}, island) GROUP BY {key}, island, c, h, s, z, hl, hr) WHERE h - greatest(fl, fr) >= 0.5 * {unit}),
beside AS (SELECT *, lag(c) OVER o AS cl, lead(c) OVER o AS cr, greatest({segmenter.share} * h, 0.5 * {unit}) AS level FROM prominent WINDOW o AS (PARTITION BY {key}, island ORDER BY c)),
valleys AS (SELECT {key}, island, c, h, level, coalesce(arg_min(p, (d, p)) FILTER (p BETWEEN cl AND c), s) AS vl, coalesce(arg_min(p, (d, p)) FILTER (p BETWEEN c AND cr), z) AS vr FROM beside JOIN g USING ({key}, island) GROUP BY {key}, island, c, h, level, s, z),
found AS (SELECT {key}, coalesce(max(p) FILTER (p BETWEEN vl AND c AND d < level) + 1, vl) AS low, coalesce(min(p) FILTER (p BETWEEN c AND vr AND d < level) - 1, vr) AS high, c AS center, h AS height FROM valleys JOIN g USING ({key}, island) GROUP BY {key}, island, c, h, level, vl, vr)"""


SHIFTED = f"""{P}, base AS (SELECT chrom, tf, score, pos - {BASE} AS pos FROM peaks), lens AS (SELECT chrom, max(pos) + 1 AS len FROM base GROUP BY chrom),
shifted AS (SELECT 0 AS shuffle, chrom, tf, score, pos FROM base UNION ALL SELECT k, chrom, tf, score, (pos + CAST('0x' || substr(md5('7|' || k || '|' || chrom || '|' || tf), 1, 8) AS BIGINT)) % len FROM base JOIN lens USING (chrom), (SELECT unnest(range(1, {SHUFFLES + 1})) AS k)),
pts AS (SELECT *, pos // {GRID} AS p, round(1048576 * (1::DOUBLE / count(*) OVER (PARTITION BY shuffle, chrom, tf ORDER BY pos RANGE BETWEEN {DAY // 4} PRECEDING AND {DAY // 4} FOLLOWING))) / 1048576 AS w FROM shifted),
cells AS (SELECT shuffle, chrom, p, sum(w) AS w FROM pts GROUP BY ALL)"""
ELEMENTS = f"""{SHIFTED}, {segments_sql("shuffle, chrom", SEGMENTER)},
elements AS (SELECT f.shuffle, f.chrom, low, high, center, high - low + 1 AS width, round(height, 9) AS height, count(*) AS n_peaks, count(DISTINCT tf) AS n_supporting, count(DISTINCT tf) FILTER (score >= 50) AS n_assigned
  FROM found f JOIN pts ON pts.shuffle = f.shuffle AND pts.chrom = f.chrom AND pts.p BETWEEN low AND high GROUP BY f.shuffle, f.chrom, low, high, center, height HAVING count(DISTINCT tf) >= 2)"""


def _redetected(spark, sf):
    points = peaks(spark, sf).select("chrom", "tf", "score", (F.col("pos") - BASE).alias("pos"))
    return sg.redetected(points, "chrom", "tf", SHUFFLES, 7, min_score=50, floor=0, reach=DAY // 4, tile=2_000, grid=GRID, segmenter=SEGMENTER)


@query(f"WITH {ELEMENTS} SELECT * FROM elements")
def redetected_elements(spark, sf):
    """Elements of every user's events, and those found anew in each of five circular shuffles."""
    return rounded(_redetected(spark, sf), 9, "height")


@query(f"""WITH {ELEMENTS}, floors AS (SELECT f AS floor, k AS shuffle FROM (SELECT unnest(range(1, 6)) AS f), (SELECT unnest(range(0, {SHUFFLES + 1})) AS k)),
n AS (SELECT floor, floors.shuffle, count(n_assigned) AS n FROM floors LEFT JOIN elements e ON e.shuffle = floors.shuffle AND n_assigned >= floor GROUP BY 1, 2)
SELECT floor, max(n) FILTER (shuffle = 0) AS observed, round(avg(n) FILTER (shuffle > 0), 6) AS null_mean, round(stddev_samp(n) FILTER (shuffle > 0), 6) AS null_sd, round(avg(n) FILTER (shuffle > 0) / nullif(max(n) FILTER (shuffle = 0), 0), 6) AS fdr FROM n GROUP BY floor""")
def redetection_null(spark, sf):
    """How many elements of at least each support are found, against how many chance alone would let be found."""
    return rounded(sg.redetection_fdr(_redetected(spark, sf), SHUFFLES, 1, 5), 6, "null_mean", "null_sd", "fdr")


MODULES = f"""{P}, near AS (SELECT anchor_id, tf, score, CAST(floor((CASE WHEN strand = '+' THEN pos - anchor ELSE anchor - pos END) / 60.0) AS BIGINT) AS p FROM peaks JOIN anchors ON peaks.chrom = anchors.chrom AND pos BETWEEN anchor - 90000 AND anchor + 90000),
pts AS (SELECT *, round(1048576 * (1::DOUBLE / count(*) OVER (PARTITION BY anchor_id, tf))) / 1048576 AS w FROM near WHERE abs(p) <= 1500), cells AS (SELECT anchor_id, p, sum(w) AS w FROM pts GROUP BY ALL)"""


@query(f"""WITH {MODULES}, {segments_sql("anchor_id", sg.Segmenter(sigma=20, distance=1), -1500, 1500)},
m AS (SELECT f.anchor_id, low, high, center, high - low + 1 AS width, round(height, 9) AS height, count(*) AS n_peaks, count(DISTINCT tf) AS n_supporting, count(DISTINCT tf) FILTER (score >= 50) AS n_assigned
  FROM found f JOIN pts ON pts.anchor_id = f.anchor_id AND pts.p BETWEEN low AND high GROUP BY f.anchor_id, low, high, center, height HAVING count(DISTINCT tf) >= 2)
SELECT *, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY center) - 1 AS INTEGER) AS local_idx FROM m""")
def anchor_segments(spark, sf):
    """Modules around every purchase, on a grid that ends 1,500 minutes away and mirrors there."""
    found = sg.anchor_modules(q.anchored_points(spark, sf), "anchor_id", "tf", min_score=50, segmenter=sg.Segmenter(sigma=20, distance=1, fixed=True))
    return rounded(found, 9, "height")


@query(f"""WITH {ELEMENTS}, el AS (SELECT chrom, low, high, center FROM elements WHERE shuffle = 0), mo AS (SELECT (chrom * 100000 + row_number() OVER (PARTITION BY chrom ORDER BY center)) AS module_id, chrom, low, high, center, n_assigned FROM elements WHERE shuffle = 1),
d AS (SELECT module_id, n_assigned, min(abs(mo.center - el.center)) AS d, coalesce(bool_or(mo.low <= el.high AND el.low <= mo.high), false) AS o FROM mo LEFT JOIN el USING (chrom) GROUP BY 1, 2)
SELECT CASE WHEN n_assigned >= 3 THEN 'at floor' ELSE 'below' END AS support, count(*) AS n, round(avg(CASE WHEN coalesce(d <= 10, false) OR o THEN 1.0 ELSE 0.0 END), 6) AS recovered, median(d) AS median_distance FROM d GROUP BY 1""")
def recovery_gate(spark, sf):
    """Which of the first shuffle's elements the observed ones recover, by support: the share that chance recovers."""
    found = written(_redetected(spark, sf), "elements")
    own = found.filter("shuffle = 0").select("chrom", "low", "high", "center")
    other = found.filter("shuffle = 1").select(F.struct("chrom", "center").alias("module_id"), "chrom", "low", "high", "center", "n_assigned")
    return rounded(sg.gate(own, other, "chrom", 10, 3, tile=1_000), 6, "recovered")
