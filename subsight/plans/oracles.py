"""The same queries as plain SQL for DuckDB, to check the results against.

Written apart from the operators: bands are joined by range, retention is a
self-join, windows run over whole tables. Speed does not matter here.
"""

from __future__ import annotations

import re
from statistics import NormalDist

from subsight import constants as C
from subsight.functions.hashing import SEED


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _uniform(*salt) -> str:
    tail = "".join(f":{s}" for s in (*salt, SEED))
    return f"(CAST('0x' || substr(md5(CAST(subid AS VARCHAR) || '{tail}'), 1, 8) AS BIGINT) / 4294967296e0)"


_BANDS = ", ".join(
    f"({i}, TIMESTAMP '{low} 00:00:00', TIMESTAMP '{high} 00:00:00')"
    for i, (low, high) in enumerate(zip(["1900-01-01", *C.TIER_UPPER_BOUNDS], C.TIER_UPPER_BOUNDS))
)
_CHANNEL_ROWS = ", ".join(f"('{c}')" for c in C.PAID_CHANNELS)
_SPEND_ROWS = " UNION ALL ".join(
    f"SELECT period_idx AS tier, '{c}' AS channel, \"{c}\" AS spend FROM f_ads WHERE period_idx <> 9"
    for c in C.PAID_CHANNELS
)
_PROFILE_ROWS = " UNION ALL ".join(
    f"SELECT variant, '{c}' AS dimension, CAST({'\"' + c + '\"'} AS VARCHAR) AS value FROM variants"
    for c in C.PROFILE_COLUMNS
)
_COUNTER_SUMS = ", ".join(
    f"CAST(SUM({c}) AS BIGINT) AS sum_{c}, AVG({c}) AS avg_{c}" for c in C.ACTIVITY_COUNTERS
)
_RATIOS = ", ".join(
    f"sum_{c} / NULLIF({'active_days' if c in C.PER_ACTIVE_DAY else 'duration'}, 0) AS {c}_per_duration"
    for c in C.ACTIVITY_COUNTERS
)

# Shared parts; each may use the ones above it.
VIEWS = {
    "f_subscribers": """
SELECT c_custkey AS subid,
  CASE WHEN c_custkey % 97 = 0 THEN NULL
       ELSE TIMESTAMP '2019-07-01 00:00:00' + INTERVAL '1' DAY * CAST((c_custkey * 7919) % 275 AS INT) END AS account_creation_date,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(NULL AS DOUBLE) WHEN c_custkey % 3 = 0 THEN CAST(0 AS DOUBLE)
       ELSE CAST(0.1 AS DOUBLE) * (1 + c_nationkey % 4) END AS join_fee,
  (CASE WHEN c_custkey % 3 = 0 THEN c_acctbal > 4200 ELSE c_acctbal > 5000 END) AS paid_TF,
  (c_acctbal > 5000 AND c_custkey % 11 = 0) AS refund_after_trial_TF,
  (c_acctbal <= 4000) AS cancel_before_trial_end,
  (c_nationkey % 6 = 0) AS retarget_TF,
  (c_custkey % 19 = 0) AS initial_credit_card_declined,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_nationkey % 2 = 0 THEN 'iOS' ELSE 'Android' END AS op_sys,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE lower(c_mktsegment) END AS intended_use,
  (c_nationkey % 5 < 2) AS male_TF,
  CASE c_nationkey % 3 WHEN 0 THEN 'plan_a' WHEN 1 THEN 'plan_b' ELSE 'plan_c' END AS plan_type,
  CASE c_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'card' WHEN 2 THEN 'wallet' ELSE 'store' END AS payment_type,
  CASE CAST((c_custkey * 31) % 16 AS INT) WHEN 0 THEN 'facebook' WHEN 1 THEN 'email' WHEN 2 THEN 'search' WHEN 3 THEN 'brand sem intent google'
    WHEN 4 THEN 'affiliate' WHEN 5 THEN 'email_blast' WHEN 6 THEN 'pinterest' WHEN 7 THEN 'referral' WHEN 8 THEN 'youtube' WHEN 9 THEN 'display'
    WHEN 10 THEN 'bing' WHEN 11 THEN 'organic' WHEN 12 THEN 'google_organic' WHEN 13 THEN 'internal' WHEN 14 THEN 'facebook' ELSE 'unmapped' END AS attribution_technical,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'survey' END AS attribution_survey,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(18 + c_nationkey AS DOUBLE) END AS age,
  CAST(1 AS INT) AS months_per_bill_period,
  'eng' AS language,
  CAST(4.5 + c_nationkey % 3 AS DOUBLE) AS monthly_price,
  CAST(3.5 + c_nationkey % 3 AS DOUBLE) AS discount_price,
  CASE WHEN c_custkey % 23 = 0 THEN CAST(NULL AS DOUBLE) ELSE c_acctbal / 1000 END AS revenue_net,
  TIMESTAMP '2024-01-10 00:00:00' + INTERVAL '1' DAY * CAST(c_custkey % 10 AS INT) AS trial_end_date
FROM customer""",
    "f_engagement": """
SELECT user_id AS subid, CAST(ts AS DATE) AS date, CASE WHEN day(ts) <= 14 THEN 0 ELSE 1 END AS payment_period,
  CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS app_opens,
  CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS cust_service_mssgs,
  CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS num_videos_completed,
  CAST(SUM(CASE WHEN event_type = 'click' AND value > 20 THEN 1 ELSE 0 END) AS BIGINT) AS num_videos_more_than_30_seconds,
  CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS num_videos_rated,
  CAST(SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS num_series_started
FROM events
GROUP BY user_id, CAST(ts AS DATE), CASE WHEN day(ts) <= 14 THEN 0 ELSE 1 END""",
    "f_customer": """
SELECT o.o_custkey AS subid, s.account_creation_date,
  CAST(ROW_NUMBER() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) - 1 AS INT) AS payment_period,
  o.o_orderpriority AS billing_channel,
  (NOT s.cancel_before_trial_end) AS trial_completed_TF,
  CAST(o.o_orderkey % 15 AS INT) AS num_trial_days
FROM orders o JOIN f_subscribers s ON s.subid = o.o_custkey""",
    "f_ads": """
SELECT CAST(n_nationkey AS INT) AS period_idx,
  CAST(1000 + n_nationkey * 37 AS DOUBLE) AS facebook,
  CAST(1250 + n_nationkey * 74 AS DOUBLE) AS email,
  CAST(1500 + n_nationkey * 111 AS DOUBLE) AS search,
  CAST(1750 + n_nationkey * 148 AS DOUBLE) AS "brand sem intent google",
  CAST(2000 + n_nationkey * 185 AS DOUBLE) AS affiliate,
  CAST(2250 + n_nationkey * 222 AS DOUBLE) AS email_blast,
  CAST(2500 + n_nationkey * 259 AS DOUBLE) AS pinterest,
  CAST(2750 + n_nationkey * 296 AS DOUBLE) AS referral
FROM nation WHERE n_nationkey < 10""",
    "bands": f"SELECT CAST(t AS INT) AS tier, lo, hi FROM (VALUES {_BANDS}) v(t, lo, hi)",
    "paid_channels": f"SELECT channel FROM (VALUES {_CHANNEL_ROWS}) v(channel)",
    "tiered": """SELECT s.*, b.tier FROM f_subscribers s
LEFT JOIN bands b ON s.account_creation_date > b.lo AND s.account_creation_date <= b.hi""",
    "tiered_customers": """SELECT b.tier, c.subid FROM f_customer c
JOIN bands b ON c.account_creation_date > b.lo AND c.account_creation_date <= b.hi""",
    "variants": """SELECT *, CASE WHEN join_fee > 0 THEN 'A' ELSE 'B' END AS variant
FROM f_subscribers WHERE join_fee IS NOT NULL""",
    "profile_rows": _PROFILE_ROWS,
    "ab": """SELECT COUNT(*) FILTER (variant = 'A') AS n0, COUNT(*) FILTER (variant = 'B') AS n1,
  AVG(CASE WHEN paid_TF THEN 1e0 ELSE 0e0 END) FILTER (variant = 'A') AS p0,
  AVG(CASE WHEN paid_TF THEN 1e0 ELSE 0e0 END) FILTER (variant = 'B') AS p1 FROM variants""",
    "trials": f"""SELECT trial, COUNT(*) AS n, COUNT(*) FILTER (paid_TF) AS conversions,
  COUNT(*) FILTER (paid_TF) / COUNT(*) AS p_sample FROM (
  SELECT trial, paid_TF, ROW_NUMBER() OVER (PARTITION BY trial
    ORDER BY md5(CAST(subid AS VARCHAR) || ':{SEED}:' || CAST(trial AS VARCHAR)), subid) AS rn
  FROM variants, generate_series(1, {C.TRIALS}) g(trial) WHERE variant = 'B') WHERE rn <= {C.SAMPLE_SIZE}
GROUP BY trial""",
    "scored_trials": f"""SELECT t.*, (t.p_sample - ab.p0) / sqrt(ab.p0 * (1 - ab.p0) / t.n) AS z,
  (t.p_sample - ab.p0) / sqrt(ab.p0 * (1 - ab.p0) / t.n) >= {C.Z_CRITICAL}e0 AS reject FROM trials t, ab""",
    "sprt_drawn": f"""SELECT paid_TF, ROW_NUMBER() OVER (
  ORDER BY md5(CAST(subid AS VARCHAR) || ':{SEED}'), subid) AS step FROM variants WHERE variant = 'B'""",
    "sprt_all": """SELECT step,
  CAST(SUM(CASE WHEN paid_TF THEN 1 ELSE 0 END) OVER (ORDER BY step) AS BIGINT) * ln(p1 / p0)
  + CAST(SUM(CASE WHEN NOT paid_TF THEN 1 ELSE 0 END) OVER (ORDER BY step) AS BIGINT)
    * ln((1 - p1) / (1 - p0)) AS log_ratio FROM sprt_drawn, ab""",
    "acquired": """SELECT tier, attribution_technical AS channel, COUNT(*) AS n,
  COUNT(*) FILTER (paid_TF) AS n_paid FROM tiered
WHERE tier IS NOT NULL AND attribution_technical IS NOT NULL GROUP BY tier, attribution_technical""",
    "signups": """SELECT b.tier, COUNT(DISTINCT c.subid) AS total_signups FROM bands b
LEFT JOIN f_customer c ON c.account_creation_date > b.lo AND c.account_creation_date <= b.hi GROUP BY b.tier""",
    "share": """SELECT s.tier, s.total_signups, CAST(COALESCE(SUM(a.n), 0) AS BIGINT) AS known_signups,
  COALESCE(SUM(a.n), 0) / NULLIF(s.total_signups, 0) AS known_share
FROM signups s LEFT JOIN (SELECT * FROM acquired WHERE channel IN (SELECT channel FROM paid_channels)) a
  ON a.tier = s.tier GROUP BY s.tier, s.total_signups""",
    "spend_rows": _SPEND_ROWS,
    "scaled": """SELECT p.tier, p.channel, p.spend * s.known_share AS spend
FROM spend_rows p LEFT JOIN share s ON s.tier = p.tier""",
    "cells": """SELECT s.tier, s.channel, s.spend / NULLIF(a.n, 0) AS cost, s.spend / NULLIF(a.n_paid, 0) AS cost_paid
FROM scaled s LEFT JOIN acquired a ON a.tier = s.tier AND a.channel = s.channel""",
    "eng_totals": f"""SELECT subid, {_COUNTER_SUMS}, COUNT(DISTINCT date) AS active_days,
  MAX(date) AS max_day, MIN(date) AS min_day FROM f_engagement WHERE payment_period = 0 GROUP BY subid""",
    "eng_features": f"""SELECT *, active_days / NULLIF(duration, 0) AS active_per_dur, {_RATIOS} FROM (
  SELECT *, CAST(date_diff('day', min_day, max_day) + 1 AS INT) AS duration FROM eng_totals)""",
    "engaged": "SELECT * FROM f_subscribers WHERE subid IN (SELECT subid FROM f_engagement)",
    "merged": f"""SELECT e.*, f.* EXCLUDE (subid),
  CAST(CASE WHEN e.paid_TF AND NOT e.refund_after_trial_TF THEN 0 ELSE 1 END AS INT) AS churn,
  {_uniform('split').replace('subid', 'e.subid')} < {C.TEST_SHARE} AS is_test, b.tier
FROM engaged e JOIN eng_features f ON f.subid = e.subid
LEFT JOIN bands b ON e.account_creation_date > b.lo AND e.account_creation_date <= b.hi""",
    "channel_ranks": """SELECT attribution_technical AS feature, AVG(churn) AS rate, SUM(churn) / SUM(SUM(churn)) OVER () AS importance
FROM merged WHERE attribution_technical IS NOT NULL GROUP BY 1""",
    "halves": f"""SELECT *, ROW_NUMBER() OVER (ORDER BY md5(CAST(subid AS VARCHAR) || ':split:{SEED}'), subid)
  <= ceil({C.TEST_SHARE}e0 * COUNT(*) OVER ()) AS held_out FROM merged""",
    "scores": """SELECT subid, churn, prob, CAST(CASE WHEN prob > 0.5e0 THEN 1 ELSE 0 END AS INT) AS prediction FROM (
  SELECT subid, churn, ((subid * 37) % 60 + CASE WHEN cancel_before_trial_end THEN 40 ELSE 0 END) / 100e0 AS prob
  FROM merged WHERE is_test)""",
    "cm": """SELECT COUNT(*) FILTER (churn = 1 AND prediction = 1) AS tp, COUNT(*) FILTER (churn = 0 AND prediction = 1) AS fp,
  COUNT(*) FILTER (churn = 1 AND prediction = 0) AS fn, COUNT(*) FILTER (churn = 0 AND prediction = 0) AS tn FROM scores""",
    "per_class": """SELECT '0' AS row_label, tn AS hit, fn AS wrong, fp AS missed FROM cm
UNION ALL SELECT '1', tp, fp, fn FROM cm""",
    "class_rows": """SELECT row_label, COALESCE(hit / NULLIF(hit + wrong, 0), 0) AS p,
  COALESCE(hit / NULLIF(hit + missed, 0), 0) AS r,
  COALESCE(2 * hit / NULLIF(2 * hit + wrong + missed, 0), 0) AS f, hit + missed AS support FROM per_class""",
    "folded": f"""SELECT *, CASE WHEN attribution_technical IN {_in(C.PAID_CHANNELS)} THEN attribution_technical
  WHEN attribution_technical IN ('youtube', 'podcast', 'twitter') THEN 'facebook'
  WHEN attribution_technical IN ('display', 'influencer', 'samsung', 'criteo') THEN 'affiliate'
  WHEN attribution_technical IN ('brand sem intent bing', 'bing') THEN 'brand sem intent google'
  WHEN attribution_technical IN {_in(C.ORGANIC_CHANNELS)} THEN 'organic' END AS cac_channel FROM f_subscribers""",
    "costed": """SELECT m.*, CASE WHEN f.cac_channel = 'organic' THEN 0e0 ELSE c.cost END AS CAC_i
FROM merged m JOIN folded f ON f.subid = m.subid
LEFT JOIN cells c ON c.tier = m.tier AND c.channel = f.cac_channel""",
    "valued": f"""SELECT c.*, s.prob AS prob_churn,
  p.payment * {1 + C.DISCOUNT_RATE}e0 / ({1 + C.DISCOUNT_RATE}e0 - 1e0 + s.prob) - c.CAC_i AS CLV_i
FROM costed c LEFT JOIN scores s ON s.subid = c.subid, (SELECT AVG(discount_price) AS payment FROM merged) p""",
}


def _imputed(source: str) -> str:
    """SQL for ``source`` with both category columns filled by their own frequencies, through alias tables."""
    tables, joins, filled = [], [], []
    for name in C.IMPUTED_COLUMNS:
        a, coin = f"alias_{name}", f"(CAST('0x' || substr(md5(CAST(s.subid AS VARCHAR) || ':{name}:coin:{SEED}'), 1, 8) AS BIGINT) / 4294967296e0)"
        tables.append(f"""
    w_{name} AS (SELECT category, n * k AS mass, total, greatest(total - n * k, 0) AS lacks, greatest(n * k - total, 0) AS spare, md5(category) AS h
      FROM (SELECT {name} AS category, CAST(COUNT(*) AS HUGEINT) AS n, COUNT(*) OVER () AS k, CAST(SUM(COUNT(*)) OVER () AS HUGEINT) AS total
        FROM {source} WHERE {name} IS NOT NULL GROUP BY 1)),
    l_{name} AS (SELECT *, SUM(lacks) OVER (ORDER BY h) AS d, SUM(spare) OVER (ORDER BY h) AS e, ROW_NUMBER() OVER (ORDER BY h) - 1 AS slot,
      COUNT(*) OVER () AS k FROM w_{name}),
    v_{name} AS (SELECT *, LEAD(category) OVER (ORDER BY h) AS next FROM l_{name} WHERE lacks = 0),
    {a} AS (SELECT x.slot, x.k, x.category, x.mass / x.total AS kept, v.category AS other
        FROM l_{name} x JOIN v_{name} v ON v.e - v.spare <= x.d - x.lacks AND x.d - x.lacks < v.e WHERE x.lacks > 0
      UNION ALL SELECT v.slot, v.k, v.category, (v.total - COALESCE(x.d - v.e, 0)) / v.total, v.next
        FROM v_{name} v LEFT JOIN l_{name} x ON x.lacks > 0 AND x.d - x.lacks < v.e AND v.e <= x.d)""")
        joins.append(f"LEFT JOIN {a} ON {a}.slot = floor({_uniform(name).replace('subid', 's.subid')} * {a}.k)")
        filled.append(f"COALESCE(s.{name}, CASE WHEN {coin} < {a}.kept THEN {a}.category ELSE {a}.other END) AS {name}")
    return f"""SELECT * FROM (WITH {','.join(tables)}
  SELECT s.* EXCLUDE ({', '.join(C.IMPUTED_COLUMNS)}), {', '.join(filled)} FROM {source} s {' '.join(joins)})"""


VIEWS["engaged_filled"] = _imputed("engaged")
VIEWS["filled_values"] = """SELECT v.* EXCLUDE (intended_use, op_sys), e.intended_use, e.op_sys
FROM valued v JOIN engaged_filled e ON e.subid = v.subid"""

_Z_ALPHA = NormalDist().inv_cdf(1 - C.ALPHA / 2)
_CROSSED = f"(log_ratio <= {C.SPRT_LOWER}e0 OR log_ratio >= {C.SPRT_UPPER}e0)"
_TIMES = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


def _pivot(keys: str, names: list, column: str, value: str, source: str, alias: str = "{}") -> str:
    cells = ", ".join(
        f"MAX(CASE WHEN {column} = {name!r} THEN {value} END) AS \"{alias.format(name)}\"" for name in names
    )
    return f"SELECT {keys}, {cells} FROM {source} GROUP BY {keys}"


def _edges(low: str, high: str, number: str) -> str:
    bins = C.HISTOGRAM_BINS
    return f"CASE WHEN {number} = {bins} THEN {high} ELSE {low} + ({number}) * (({high} - {low}) / {bins}) END"


def _histogram(ends: str) -> str:
    last = C.HISTOGRAM_BINS - 1
    return f"""SELECT CAST(bin AS INT) AS bin, ROUND(bin_start, 6) AS bin_start, ROUND(bin_end, 6) AS bin_end,
  COUNT(CLV_i) AS n FROM (
  SELECT bin, {_edges('low', 'high', 'bin')} AS bin_start, {_edges('low', 'high', 'bin + 1')} AS bin_end
  FROM ({ends}), generate_series(0, {last}) g(bin)) b
LEFT JOIN valued v ON v.CLV_i >= bin_start AND (v.CLV_i < bin_end OR (bin = {last} AND v.CLV_i <= bin_end))
GROUP BY bin, bin_start, bin_end"""


def _histogram_by(group: str, source: str) -> str:
    last = C.HISTOGRAM_BINS - 1
    return f"""SELECT b.{group}, CAST(bin AS INT) AS bin, ROUND(bin_start, 6) AS bin_start, COUNT(v.CLV_i) AS n,
  ROUND(COUNT(v.CLV_i) / (total * ((high - low) / {C.HISTOGRAM_BINS})), 6) AS density FROM (
  SELECT *, {_edges('low', 'high', 'bin')} AS bin_start, {_edges('low', 'high', 'bin + 1')} AS bin_end FROM (
    SELECT {group}, total, CASE WHEN l = h THEN l - 0.5e0 ELSE l END AS low,
      CASE WHEN l = h THEN h + 0.5e0 ELSE h END AS high FROM (
      SELECT {group}, COUNT(*) AS total, MIN(CLV_i) AS l, MAX(CLV_i) AS h FROM {source}
      WHERE {group} IS NOT NULL AND CLV_i IS NOT NULL GROUP BY {group})), generate_series(0, {last}) g(bin)) b
LEFT JOIN {source} v ON v.{group} = b.{group} AND v.CLV_i >= bin_start
  AND (v.CLV_i < bin_end OR (bin = {last} AND v.CLV_i <= bin_end))
GROUP BY b.{group}, bin, bin_start, total, high, low"""


def _kde(group: str | None) -> str:
    points = C.DENSITY_POINTS
    key, known = (f"{group}, ", f" AND {group} IS NOT NULL") if group else ("", "")
    by = f" GROUP BY {group}" if group else ""
    same = f" AND v.{group} = g.{group}" if group else ""
    out = f"g.{group}, " if group else ""
    return f"""SELECT {out}CAST(point AS INT) AS point, ROUND(x, 6) AS x,
  ROUND(SUM(exp(-0.5e0 * ((x - v.CLV_i) / h) * ((x - v.CLV_i) / h))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM (SELECT *, start + point * step AS x FROM (
  SELECT {key}n, h, lo - 3 * h AS start, ((hi + 3 * h) - (lo - 3 * h)) / {points - 1} AS step FROM (
    SELECT {key}COUNT(*) AS n, stddev_samp(CLV_i) * pow(COUNT(*), -0.2e0) AS h, MIN(CLV_i) AS lo, MAX(CLV_i) AS hi
    FROM valued WHERE CLV_i IS NOT NULL{known}{by}) WHERE h > 0), generate_series(0, {points - 1}) s(point)) g
JOIN valued v ON v.CLV_i IS NOT NULL{same} GROUP BY {out}point, x, n, h"""


def _kde_binned(group: str | None) -> str:
    points, fine = C.DENSITY_POINTS, 64
    key, known = (f"{group}, ", f" AND {group} IS NOT NULL") if group else ("", "")
    by = f" GROUP BY {group}" if group else ""
    same = f" AND b.{group} = g.{group}" if group else ""
    mine = f" AND v.{group} = f.{group}" if group else ""
    out, held = (f"g.{group}, ", f"f.{group}, ") if group else ("", "")
    return f"""SELECT * FROM (WITH f AS (SELECT * FROM (SELECT {key}COUNT(*) AS n, stddev_samp(CLV_i) * pow(COUNT(*), -0.2e0) AS h,
    MIN(CLV_i) AS lo, MAX(CLV_i) AS hi FROM valued WHERE CLV_i IS NOT NULL{known}{by}) WHERE h > 0),
b AS (SELECT {held}floor((CLV_i - lo) / (h / {fine})) AS bin, COUNT(*) AS many,
    SUM((CLV_i - lo) / (h / {fine}) - floor((CLV_i - lo) / (h / {fine}))) AS beyond
  FROM f JOIN valued v ON CLV_i IS NOT NULL{mine} GROUP BY ALL),
g AS (SELECT *, lo - 3 * h + point * (((hi + 3 * h) - (lo - 3 * h)) / {points - 1}) AS x FROM f, generate_series(0, {points - 1}) s(point))
SELECT {out}CAST(point AS INT) AS point, ROUND(x, 6) AS x, ROUND(SUM(
    (many - beyond) * exp(-0.5e0 * pow((x - lo - bin * h / {fine}) / h, 2))
    + beyond * exp(-0.5e0 * pow((x - lo - (bin + 1) * h / {fine}) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM g JOIN b ON true{same} GROUP BY {out}point, x, n, h)"""


def _cost(column: str) -> str:
    return f"""SELECT tier, channel, ROUND({column}, 6) AS cost FROM cells
UNION ALL SELECT NULL, channel, ROUND(AVG({column}), 6) FROM cells GROUP BY channel"""


def _shape(name: str, view: str, cols: list[str]) -> str:
    return f"""SELECT '{name}' AS table_name, COUNT(*) AS n_rows, CAST({len(cols)} AS INT) AS n_columns,
  '{",".join(cols)}' AS column_names FROM {view}"""


def _tables() -> dict[str, list[str]]:
    from subsight.schemas import TABLES

    return {name: TABLES[name].fieldNames() for name in ("subscribers", "engagement", "customer", "spend")}


_RETENTION = f"""SELECT c.tier, c.payment_period, c.n_alive, c.n_alive / z.n_alive * 100 AS retention
FROM cohorts c LEFT JOIN cohorts z ON z.tier = c.tier AND z.payment_period = 0
WHERE c.payment_period BETWEEN 0 AND {C.LAST_COHORT_PERIOD}"""
VIEWS["cohorts"] = """SELECT b.tier, c.payment_period, COUNT(*) AS n_alive FROM f_customer c
JOIN bands b ON c.account_creation_date > b.lo AND c.account_creation_date <= b.hi
GROUP BY b.tier, c.payment_period"""
VIEWS["retained"] = _RETENTION

_PERIODS = list(range(C.LAST_COHORT_PERIOD + 1))
_SHAPE_VIEWS = {"subscribers": "f_subscribers", "engagement": "f_engagement", "customer": "f_customer", "spend": "f_ads"}
_KEPT = """subid, strftime(account_creation_date, '%Y-%m-%d %H:%M:%S') AS account_creation_date, paid_TF,
  refund_after_trial_TF, cancel_before_trial_end, retarget_TF, op_sys, intended_use, male_TF, plan_type,
  attribution_technical, discount_price, ROUND(revenue_net, 6) AS revenue_net,
  strftime(trial_end_date, '%Y-%m-%d %H:%M:%S') AS trial_end_date"""
_DAYS = "CAST(max_day AS VARCHAR) AS max_day, CAST(min_day AS VARCHAR) AS min_day"
_FEATURES = ", ".join(f"ROUND({c}, 6) AS {c}" for c in C.NUMERIC_FEATURES)
_ONE_HOT = " UNION ALL ".join(
    f"""SELECT m.subid, '{c}_' || k.v AS feature, CAST(CASE WHEN m.{c} = k.v THEN 1 ELSE 0 END AS INT) AS value
FROM merged m, (SELECT DISTINCT {c} AS v FROM merged WHERE {c} IS NOT NULL) k"""
    for c in C.CATEGORICAL_FEATURES
    if c != "male_TF"
)
_SCALED = ", ".join(
    f"ROUND(CASE WHEN m.{c} IS NULL THEN NULL ELSE COALESCE((m.{c} - r.{c}_lo) / NULLIF(r.{c}_hi - r.{c}_lo, 0), 0) END, 6) AS {c}"
    for c in C.NUMERIC_FEATURES
)
_SCALE_ENDS = ", ".join(f"MIN({c}) AS {c}_lo, MAX({c}) AS {c}_hi" for c in C.NUMERIC_FEATURES)
_NULL_SHARES = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, ROUND(AVG(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) * 100, 6) AS null_percent FROM engaged"
    for c in _tables()["subscribers"]
)

BODIES = {
    # scans
    "scan_subscribers": "SELECT * REPLACE (strftime(account_creation_date, '%Y-%m-%d %H:%M:%S') AS account_creation_date,"
    " strftime(trial_end_date, '%Y-%m-%d %H:%M:%S') AS trial_end_date, ROUND(join_fee, 6) AS join_fee,"
    " ROUND(revenue_net, 6) AS revenue_net) FROM f_subscribers",
    "scan_ads": "SELECT * FROM f_ads",
    "table_shapes": " UNION ALL ".join(_shape(n, _SHAPE_VIEWS[n], cols) for n, cols in _tables().items()),
    "engagement_preview": "SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM f_engagement"
    " ORDER BY f_engagement.subid, f_engagement.date, f_engagement.payment_period LIMIT 5",
    # filters and projections
    "ab_variants": "SELECT subid, ROUND(join_fee, 6) AS join_fee, variant FROM variants",
    "paid_subscribers": "SELECT subid, plan_type, discount_price FROM f_subscribers WHERE paid_TF",
    "tier_assign": "SELECT subid, tier FROM tiered",
    "tier_assign_range_join": "SELECT subid, tier FROM tiered",
    "band_lookup": """SELECT c_custkey, MIN_BY(p_partkey, {'h': lo + p_size * 10, 'k': p_partkey}) AS band
FROM customer LEFT JOIN (SELECT *, CAST(p_partkey * 7919 % 12000 - 1500 AS DOUBLE) AS lo FROM part) ON c_acctbal > lo
  AND c_acctbal <= lo + p_size * 10 GROUP BY c_custkey""",
    "null_share_by_column": _NULL_SHARES,
    "audit_activity_after_trial": f"SELECT subid, CAST(max_day AS VARCHAR) AS max_day, {_TIMES.format('trial_end_date')} FROM merged"
    " WHERE max_day > trial_end_date",
    "churn_label": "SELECT subid, paid_TF, refund_after_trial_TF, churn FROM merged",
    # A/B test
    "scope_counts": """SELECT COUNT(DISTINCT subid) AS total_users,
  COUNT(*) FILTER (join_fee IS NULL) AS null_fee_rows, COUNT(join_fee) AS focus_rows,
  COUNT(DISTINCT subid) FILTER (join_fee > 0) AS users_a, COUNT(DISTINCT subid) FILTER (join_fee <= 0) AS users_b,
  COUNT(DISTINCT subid) FILTER (join_fee > 0) + COUNT(DISTINCT subid) FILTER (join_fee <= 0) AS users_in_test
FROM f_subscribers""",
    "approx_users_by_tier": """SELECT tier, users, users > 0 AS within_error FROM (
  SELECT tier, COUNT(DISTINCT subid) AS users FROM tiered_customers GROUP BY tier
  UNION ALL SELECT NULL, COUNT(DISTINCT subid) FROM tiered_customers)""",
    "approx_revenue_percentiles": f"""SELECT plan_type, share, COUNT(*) AS n, COUNT(*) > 0 AS within_error
FROM f_subscribers, (SELECT unnest([{', '.join(f'{p}e0' for p in C.PERCENTILES)}]) AS share)
WHERE revenue_net IS NOT NULL GROUP BY plan_type, share""",
    "join_fee_counts": "SELECT ROUND(join_fee, 6) AS join_fee, COUNT(*) AS n FROM f_subscribers"
    " WHERE join_fee IS NOT NULL GROUP BY f_subscribers.join_fee",
    "variant_profile": """SELECT p.variant, dimension, value, COUNT(*) AS n, ROUND(COUNT(*) / any_value(t.n) * 100, 6) AS percent
FROM profile_rows p JOIN (SELECT variant, COUNT(*) AS n FROM variants GROUP BY variant) t ON t.variant = p.variant
WHERE value IS NOT NULL GROUP BY p.variant, dimension, value""",
    "ab_conversion": """SELECT variant, COUNT(*) AS n_rows, COUNT(*) FILTER (paid_TF) AS conversions,
  ROUND(COUNT(*) FILTER (paid_TF) / COUNT(*), 6) AS rate FROM variants GROUP BY variant""",
    "ab_sample_size": f"""SELECT ROUND(p0, 6) AS p0, ROUND(p1, 6) AS p1, ROUND(p1 - p0, 6) AS delta,
  ROUND({_Z_ALPHA!r}e0, 6) AS z_alpha,
  ROUND(pow({_Z_ALPHA!r}e0 * sqrt(2 * ((p0 + p1) / 2) * (1 - (p0 + p1) / 2))
    + {C.POWER_QUANTILE}e0 * sqrt(p0 * (1 - p0) + p1 * (1 - p1)), 2) / NULLIF(pow(p1 - p0, 2), 0), 6) AS sample_size FROM ab""",
    "ab_z_one_sample": "SELECT ROUND(p0, 6) AS p0, ROUND(p1, 6) AS p1, n1,"
    " ROUND((p1 - p0) / sqrt(p0 * (1 - p0) / n1), 6) AS z FROM ab",
    "ab_z_two_sample": """SELECT n0, n1, ROUND(p, 6) AS pooled_rate,
  ROUND((p1 - p0) / sqrt(p * (1 - p) * (1e0 / n1 + 1e0 / n0)), 6) AS z
FROM (SELECT *, (p1 * n1 + p0 * n0) / (n0 + n1) AS p FROM ab)""",
    "sample_n": f"""SELECT subid, paid_TF, sample_rank FROM (SELECT subid, paid_TF, ROW_NUMBER() OVER (
  ORDER BY md5(CAST(subid AS VARCHAR) || ':{SEED}'), subid) AS sample_rank FROM f_subscribers) WHERE sample_rank <= 1000""",
    "ztest_trials": "SELECT CAST(trial AS INT) AS trial, n, conversions, ROUND(p_sample, 6) AS p_sample,"
    " ROUND(z, 6) AS z, reject FROM scored_trials",
    "ztest_decisions": "SELECT COUNT(*) FILTER (reject) AS reject_null,"
    " COUNT(*) FILTER (NOT COALESCE(reject, false)) AS accept_null FROM scored_trials",
    "sprt_decision": f"""SELECT step, ROUND(log_ratio, 6) AS log_ratio,
  CASE WHEN log_ratio >= {C.SPRT_UPPER}e0 THEN 'reject' WHEN log_ratio <= {C.SPRT_LOWER}e0 THEN 'accept' ELSE 'undecided' END AS decision
FROM sprt_all WHERE step = (SELECT COALESCE(MIN(step) FILTER {_CROSSED}, MAX(step)) FROM sprt_all
  WHERE step <= {C.SPRT_SAMPLE})""",
    "sprt_trace": f"""SELECT step, ROUND(log_ratio, 6) AS log_ratio FROM sprt_all WHERE step <= (
  SELECT COALESCE(MIN(step) FILTER {_CROSSED}, {C.SAMPLE_SIZE}) FROM sprt_all WHERE step <= {C.SAMPLE_SIZE})""",
    # acquisition cost
    "account_date_range": """SELECT strftime(MIN(account_creation_date), '%Y-%m-%d %H:%M:%S') AS first,
  strftime(MAX(account_creation_date), '%Y-%m-%d %H:%M:%S') AS last FROM f_subscribers""",
    "signups_by_tier": "SELECT * FROM signups",
    "acquisition_by_tier_channel": "SELECT tier, channel, n FROM acquired",
    "acquisition_paid": "SELECT tier, channel, n_paid AS n FROM acquired WHERE n_paid > 0",
    "acquisition_wide": _pivot("tier", C.PAID_CHANNELS, "channel", "n", "acquired"),
    "known_share": "SELECT tier, total_signups, known_signups, ROUND(known_share, 6) AS known_share FROM share",
    "cac_scaled_spend": "SELECT tier, channel, ROUND(spend, 6) AS spend FROM scaled",
    "cac_by_tier_channel": _cost("cost"),
    "cac_by_tier_channel_paid": _cost("cost_paid"),
    "cac_wide": _pivot(
        "row_label, tier",
        C.PAID_CHANNELS,
        "channel",
        "cost",
        f"(SELECT *, COALESCE('tier' || CAST(tier AS VARCHAR), 'mean') AS row_label FROM ({_cost('cost')}))",
    ),
    # cohorts
    "cohort_counts": "SELECT * FROM cohorts",
    "cohort_counts_wide": """SELECT tier,
  '{' || string_agg('"period_' || payment_period || '":' || n_alive, ',' ORDER BY payment_period) || '}' AS counts
FROM cohorts GROUP BY tier""",
    "cohort_retention": "SELECT tier, payment_period, n_alive, ROUND(retention, 6) AS retention FROM retained",
    "cohort_retention_wide": _pivot(
        "tier", _PERIODS, "payment_period", "round_even(retention, 1)", "retained", "period_{}"
    ),
    # engagement and validation
    "billing_channel_counts": "SELECT billing_channel, COUNT(*) AS n FROM f_customer"
    " WHERE billing_channel IS NOT NULL GROUP BY billing_channel",
    "engagement_scope": "SELECT COUNT(DISTINCT subid) AS users,"
    " COUNT(DISTINCT subid) FILTER (payment_period = 0) AS trial_users FROM f_engagement",
    "engagement_agg": "SELECT * REPLACE ("
    + ", ".join(f"ROUND(avg_{c}, 6) AS avg_{c}" for c in C.ACTIVITY_COUNTERS)
    + ", CAST(max_day AS VARCHAR) AS max_day, CAST(min_day AS VARCHAR) AS min_day) FROM eng_totals",
    "engagement_features": f"SELECT subid, active_days, duration, {_DAYS}, {_FEATURES} FROM eng_features",
    "engaged_subscribers": "SELECT subid, plan_type, op_sys FROM engaged",
    "impute_by_frequency": _imputed("(SELECT subid, intended_use, op_sys FROM f_subscribers)"),
    "subscriber_features": f"SELECT {_KEPT}, active_days, duration, {_DAYS}, {_FEATURES}, churn FROM ("
    "SELECT m.* EXCLUDE (intended_use, op_sys), e.intended_use, e.op_sys FROM merged m JOIN engaged_filled e ON e.subid = m.subid)",
    "validation_join": "SELECT c.subid, c.trial_completed_TF, c.num_trial_days, e.cancel_before_trial_end"
    " FROM f_customer c JOIN engaged e ON e.subid = c.subid",
    "trial_vs_cancel": "SELECT trial_completed_TF, cancel_before_trial_end, COUNT(*) AS n"
    " FROM f_customer c JOIN engaged e ON e.subid = c.subid GROUP BY 1, 2",
    "trial_days": "SELECT trial_completed_TF, num_trial_days, COUNT(*) AS n"
    " FROM f_customer c JOIN engaged e ON e.subid = c.subid GROUP BY 1, 2",
    "cancel_vs_paid": "SELECT cancel_before_trial_end, paid_TF, COUNT(*) AS n FROM merged GROUP BY 1, 2",
    "paid_refund_counts": "SELECT refund_after_trial_TF, COUNT(*) AS n FROM merged"
    " WHERE paid_TF AND refund_after_trial_TF IS NOT NULL GROUP BY 1",
    "refund_revenue_audit": """SELECT refund_after_trial_TF, COUNT(*) FILTER (revenue_net IS NULL) AS null_revenue_rows,
  COUNT(DISTINCT subid) FILTER (revenue_net <= 0) AS non_positive_users,
  COUNT(DISTINCT subid) FILTER (revenue_net > 0) AS positive_users
FROM merged WHERE paid_TF AND refund_after_trial_TF IS NOT NULL GROUP BY 1""",
    "churn_counts": "SELECT churn, COUNT(*) AS n FROM merged GROUP BY churn",
    "channel_values": "SELECT DISTINCT attribution_technical FROM merged WHERE attribution_technical IS NOT NULL",
    # preparation
    "train_test_counts": "SELECT held_out AS is_test, COUNT(*) AS n_rows, CAST(SUM(churn) AS BIGINT) AS churned"
    " FROM halves GROUP BY 1",
    "fold_counts": f"""SELECT CAST(place % {C.FOLDS} AS INT) AS fold, churn, COUNT(*) AS n_rows FROM (
  SELECT churn, ROW_NUMBER() OVER (PARTITION BY churn ORDER BY md5(CAST(subid AS VARCHAR) || ':fold:{SEED}'), subid) - 1 AS place
  FROM halves WHERE NOT held_out) GROUP BY 1, 2""",
    "one_hot": _ONE_HOT
    + " UNION ALL SELECT subid, 'male_TF', CAST(CASE WHEN male_TF THEN 1 ELSE 0 END AS INT) FROM merged",
    "one_hot_cells": " UNION ALL ".join(
        f"SELECT subid, '{c}_' || {c} AS feature, CAST(1 AS INT) AS value FROM merged WHERE {c} IS NOT NULL"
        for c in C.CATEGORICAL_FEATURES
        if c != "male_TF"
    )
    + " UNION ALL SELECT subid, 'male_TF', CAST(1 AS INT) FROM merged WHERE male_TF",
    "minmax_scaled": f"SELECT m.subid, {_SCALED} FROM merged m, (SELECT {_SCALE_ENDS} FROM halves WHERE NOT held_out) r",
    # evaluation
    "confusion_matrix": """SELECT CAST(l AS INT) AS label, CAST(p AS INT) AS predicted, COUNT(s.subid) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(l, p) LEFT JOIN scores s ON s.churn = l AND s.prediction = p GROUP BY 1, 2""",
    "binary_metrics": """SELECT ROUND((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
  ROUND(COALESCE(tp / NULLIF(tp + fn, 0), 0), 6) AS recall, ROUND(COALESCE(tp / NULLIF(tp + fp, 0), 0), 6) AS precision,
  ROUND(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM cm""",
    "classification_report": """SELECT row_label, ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(f, 6) AS f1, support FROM class_rows
UNION ALL SELECT 'accuracy', ROUND((tp + tn) / (tp + tn + fp + fn), 6), ROUND((tp + tn) / (tp + tn + fp + fn), 6),
  ROUND((tp + tn) / (tp + tn + fp + fn), 6), tp + tn + fp + fn FROM cm
UNION ALL SELECT 'macro avg', ROUND(AVG(p), 6), ROUND(AVG(r), 6), ROUND(AVG(f), 6), CAST(SUM(support) AS BIGINT) FROM class_rows
UNION ALL SELECT 'weighted avg', ROUND(SUM(p * support) / SUM(support), 6), ROUND(SUM(r * support) / SUM(support), 6),
  ROUND(SUM(f * support) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM class_rows""",
    "roc_curve": """SELECT ROUND(t.prob, 6) AS threshold,
  ROUND(COUNT(*) FILTER (s.churn = 0) / NULLIF((SELECT COUNT(*) FROM scores WHERE churn = 0), 0), 6) AS fpr,
  ROUND(COUNT(*) FILTER (s.churn = 1) / NULLIF((SELECT COUNT(*) FROM scores WHERE churn = 1), 0), 6) AS tpr
FROM (SELECT DISTINCT prob FROM scores) t JOIN scores s ON s.prob >= t.prob GROUP BY t.prob
UNION ALL SELECT NULL, 0e0, 0e0""",
    "roc_corners": """SELECT ROUND(prob, 6) AS threshold, ROUND(fp / n, 6) AS fpr, ROUND(tp / p, 6) AS tpr FROM (
  SELECT *, SUM(pos) OVER d AS tp, SUM(neg) OVER d AS fp, SUM(pos) OVER () AS p, SUM(neg) OVER () AS n,
    LAG(prob) OVER d AS before, LEAD(pos) OVER d AS next_pos, LEAD(neg) OVER d AS next_neg FROM (
    SELECT prob, COUNT(*) FILTER (churn = 1) AS pos, COUNT(*) FILTER (churn = 0) AS neg FROM scores GROUP BY prob)
  WINDOW d AS (ORDER BY prob DESC))
WHERE before IS NULL OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg
UNION ALL SELECT NULL, 0e0, 0e0""",
    "auc": """SELECT ROUND(SUM(CASE WHEN p.prob > n.prob THEN 1e0 WHEN p.prob = n.prob THEN 0.5e0 ELSE 0e0 END) / COUNT(*), 6) AS auc
FROM scores p, scores n WHERE p.churn = 1 AND n.churn = 0""",
    # lifetime value
    "tier_counts": "SELECT tier, COUNT(*) AS n FROM merged WHERE tier IS NOT NULL GROUP BY tier",
    "channel_fold": "SELECT subid, attribution_technical, cac_channel FROM folded",
    "cac_per_subscriber": "SELECT subid, tier, attribution_technical, ROUND(CAC_i, 6) AS CAC_i FROM costed",
    "cac_null_channels": "SELECT attribution_technical, COUNT(*) AS n FROM costed"
    " WHERE CAC_i IS NULL AND attribution_technical IS NOT NULL GROUP BY 1",
    "top_channels": "SELECT feature, ROUND(importance, 6) AS importance FROM channel_ranks"
    " ORDER BY channel_ranks.importance DESC, feature LIMIT 5",
    "voted_channels": "SELECT feature, ROUND(votes, 6) AS votes FROM"
    " (SELECT feature, importance + CASE WHEN rate > 0.5e0 THEN 1 ELSE 0 END AS votes FROM channel_ranks) v"
    " ORDER BY v.votes DESC, feature LIMIT 5",
    "plan_price_counts": "SELECT plan_type, discount_price, COUNT(*) AS n FROM merged GROUP BY 1, 2",
    "clv_per_subscriber": "SELECT subid, tier, ROUND(CAC_i, 6) AS CAC_i, ROUND(prob_churn, 6) AS prob_churn,"
    " ROUND(CLV_i, 6) AS CLV_i FROM valued",
    "clv_summary": "SELECT COUNT(CLV_i) AS n, ROUND(AVG(CLV_i), 6) AS mean, ROUND(MIN(CLV_i), 6) AS min,"
    " ROUND(MAX(CLV_i), 6) AS max, ROUND(median(CLV_i), 6) AS median FROM valued",
    "churn_by_channel": f"""SELECT attribution_technical AS channel, CAST(SUM(churn) AS BIGINT) AS churned,
  COUNT(*) AS n_rows, ROUND(SUM(churn) / COUNT(*), 6) AS churn_rate FROM merged
WHERE attribution_technical IN {_in(C.PAID_CHANNELS)} GROUP BY 1""",
    "churn_by_channel_group": f"""SELECT CASE WHEN attribution_technical IN {_in(C.CHANNEL_GROUPS['group_1'])}
  THEN 'group_1' ELSE 'group_2' END AS channel_group, CAST(SUM(churn) AS BIGINT) AS churned,
  COUNT(*) AS n_rows, ROUND(SUM(churn) / COUNT(*), 6) AS churn_rate FROM merged
WHERE attribution_technical IN {_in(C.PAID_CHANNELS)} GROUP BY 1""",
    # distributions
    "clv_hist_fixed": _histogram(
        f"SELECT {C.CLV_PLOT_RANGE[0]}e0 AS low, {C.CLV_PLOT_RANGE[1]}e0 AS high"
    ),
    "clv_hist": _histogram("SELECT MIN(CLV_i) AS low, MAX(CLV_i) AS high FROM valued"),
    "clv_hist_by_tier": _histogram_by("tier", "valued"),
    "clv_hist_by_intended_use": _histogram_by("intended_use", "filled_values"),
    "clv_hist_by_op_sys": _histogram_by("op_sys", "filled_values"),
    "clv_kde": _kde(None),
    "clv_kde_by_gender": _kde("male_TF"),
    "clv_kde_binned": _kde_binned(None),
    "clv_kde_binned_by_gender": _kde_binned("male_TF"),
    "clv_kde_by_churn": _kde("churn"),
}


def _used(text: str) -> set[str]:
    return {name for name in VIEWS if re.search(rf"\b{name}\b", text)}


def oracle(body: str) -> str:
    """A query with the shared parts it needs in front."""
    needed: set[str] = set()
    todo = _used(body)
    while todo:
        name = todo.pop()
        needed.add(name)
        todo |= _used(VIEWS[name]) - needed
    parts = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in _in_order(needed))
    return f"WITH {parts}\n{body}" if parts else body


def _in_order(names: set[str]) -> list[str]:
    """Each part after the parts it uses."""
    done: list[str] = []

    def add(name: str) -> None:
        for part in sorted(_used(VIEWS[name]) - {name}):
            if part not in done:
                add(part)
        if name not in done:
            done.append(name)

    for name in sorted(names):
        add(name)
    return done


# A table written to a file and read again is the same table.
BODIES["cac_csv_roundtrip"] = BODIES["cac_wide"]
BODIES["read_subscribers"] = BODIES["scan_subscribers"]
BODIES["read_spend_sheet"] = BODIES["scan_ads"]
BODIES["read_table_shapes"] = BODIES["table_shapes"]
BODIES["clv_from_files"] = BODIES["clv_per_subscriber"]

ORACLES = {name: oracle(body) for name, body in BODIES.items()}
