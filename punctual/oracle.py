"""DuckDB SQL for every registered query, written from the definitions and not from the Spark code."""

from __future__ import annotations

# Report labels, channel names and codes in the SQL below are those the reports must show.

_FIXTURE = """
WITH b AS (
  SELECT CAST(l_orderkey AS BIGINT) AS ok, CAST(l_partkey AS BIGINT) AS pk,
         CAST(l_suppkey AS BIGINT) AS sk, CAST(l_quantity AS INT) AS q,
         CAST(l_shipdate AS DATE) AS d, l_linenumber AS ln, row_number() OVER () AS row_ord
  FROM lineitem),
m AS (
  SELECT *, CAST(360 + (pk % 8) * 75 + (sk % 3) * 5 AS INT) AS wf,
            CAST(360 + (pk % 8) * 75 + (sk % 3) * 5 + 60 AS INT) AS wu,
            CAST(360 + (pk % 8) * 75 + 20 + (ok % 4) * 5 AS INT) AS pl,
            CAST(360 + (pk % 8) * 75 - 25 + q * 3 + (ok % 7) AS INT) AS ac
  FROM b),
t AS (
  SELECT *, printf('%02d:%02d', wf // 60, wf % 60) AS wf_s, printf('%02d:%02d', wu // 60, wu % 60) AS wu_s,
            printf('%02d:%02d', pl // 60, pl % 60) AS pl_s, printf('%02d:%02d', ac // 60, ac % 60) AS ac_s,
            printf('%02d:%02d', (ac + 10 + q) // 60, (ac + 10 + q) % 60) AS ad_s
  FROM m),
o AS (
  SELECT CAST(d AS VARCHAR) AS date_dos, CAST(770000 + sk % 4 AS VARCHAR) AS cnr_tour,
    CASE ok % 6 WHEN 0 THEN 'Z41102' WHEN 1 THEN 'Z41103' WHEN 2 THEN 'Z41104'
                WHEN 3 THEN 'Z41105' WHEN 4 THEN 'Z41108' ELSE 'Z49999' END AS cnr_cust,
    CAST(3 + ok % 4 AS VARCHAR) AS rfx_activity, CAST(ok % 100 AS VARCHAR) AS rfx_year,
    CAST(pk % 100 AS VARCHAR) AS rfx_preparation,
    CASE WHEN ok % 61 = 0 THEN NULL ELSE 'ST' || CAST(pk % 8 AS VARCHAR) END AS nm_short_unload,
    wf_s AS win_from,
    CASE WHEN ok % 53 = 0 THEN NULL ELSE wu_s END AS win_until,
    CASE WHEN ok % 59 = 0 THEN NULL ELSE pl_s END AS planned,
    CASE WHEN ok % 47 = 0 THEN NULL ELSE '05:30' END AS p_depart,
    CAST(10 + pk % 25 AS VARCHAR) AS duration_p,
    CASE WHEN ok % 41 = 0 THEN NULL WHEN ok % 43 = 0 THEN 'n/a' WHEN ok % 67 = 0 THEN '' ELSE ac_s END AS actual,
    CASE WHEN ok % 37 = 0 THEN NULL ELSE ad_s END AS a_depart,
    CASE WHEN ok % 31 = 0 THEN NULL WHEN ok % 29 = 0 THEN 'x' ELSE CAST(5 + q AS VARCHAR) END AS duration_a,
    'SITE' || CAST(sk % 5 AS VARCHAR) AS site,
    CASE ok % 9 WHEN 0 THEN 'late_dispatch' WHEN 1 THEN 'early_dispatch' WHEN 2 THEN 'last_minute_change'
                WHEN 3 THEN 'wms_tms_mismatch' WHEN 4 THEN 'insufficient_stock' WHEN 5 THEN 'picking_delay'
                WHEN 6 THEN 'other_code' WHEN 7 THEN '' ELSE NULL END AS reason,
    CAST(ok AS VARCHAR) || '-' || CAST(ln AS VARCHAR) AS uid, row_ord
  FROM t)"""

_ORDER_COLUMNS = """date_dos, cnr_tour, cnr_cust, rfx_activity, rfx_year, rfx_preparation, nm_short_unload,
  win_from, win_until, planned, p_depart, duration_p, actual, a_depart, duration_a"""


def _ts(clock: str) -> str:
    return f"try_strptime(date_dos || ' ' || {clock}, ['%Y-%m-%d %H:%M', '%Y-%m-%d %H:%M:%S'])"


def _num(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+(\\.[0-9]*)?') THEN try_cast(trim({c}) AS DOUBLE) END"


def _fmt(c: str) -> str:
    return f"coalesce({c}, '')"


def _min_between(a: str, b: str) -> str:
    return f"(epoch({b}) - epoch({a})) / 60.0::DOUBLE"


def _pct(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) * 100.0::DOUBLE ELSE 0.0::DOUBLE END"


def _pct2(n: str, d: str) -> str:
    return f"round_even({_pct(n, d)}, 2)"


def _sum6(x: str) -> str:
    """Sums and means of fractions, rounded because the order of addition is not fixed."""
    return f"round_even({x}, 6)"


# ---------------------------------------------------------------- per order, per delivery, per route
_FLAGS = f"""{_FIXTURE},
c AS (SELECT *, {_ts('win_from')} AS win_from_ts, {_ts('win_until')} AS win_until_ts,
             {_ts('actual')} AS actual_ts, {_ts('planned')} AS planned_ts, {_ts('a_depart')} AS a_depart_ts,
             {_num('duration_a')} AS dur_a, {_num('duration_p')} AS dur_p
      FROM o),
f AS (SELECT *, coalesce(actual_ts BETWEEN win_from_ts AND win_until_ts, false) AS jit_s1_order,
             coalesce(actual_ts <= win_until_ts, false) AS jit_s2_order FROM c)"""

_DELIVERIES = f"""{_FLAGS},
dl AS (
  SELECT date_dos, cnr_tour, nm_short_unload, count(cnr_cust) AS orders,
    arg_min(win_from, row_ord) FILTER (WHERE win_from IS NOT NULL) AS win_from,
    arg_min(win_until, row_ord) FILTER (WHERE win_until IS NOT NULL) AS win_until,
    arg_min(planned, row_ord) FILTER (WHERE planned IS NOT NULL) AS first_planned,
    arg_min(actual, row_ord) FILTER (WHERE actual IS NOT NULL) AS first_actual,
    bool_or(jit_s1_order) AS jit_s1_delivery, bool_or(jit_s2_order) AS jit_s2_delivery,
    min(planned_ts) AS first_planned_ts
  FROM f WHERE date_dos IS NOT NULL AND cnr_tour IS NOT NULL AND nm_short_unload IS NOT NULL
  GROUP BY ALL)"""

_GRADE = "CASE WHEN NOT {s2} THEN 'root' WHEN {s1} THEN 'ok' ELSE 'late' END"


def _app() -> dict[str, str]:
    return {
        "scan_orders": f"{_FIXTURE} SELECT {_ORDER_COLUMNS} FROM o",
        "orders_preview": f"{_FIXTURE} SELECT {_ORDER_COLUMNS} FROM o ORDER BY row_ord LIMIT 500",
        "route_options": f"{_FIXTURE} SELECT DISTINCT cnr_tour FROM o WHERE cnr_tour IS NOT NULL",
        # The raw file has no code for one customer, and clocks and days come back in one form.
        "ingest_orders": f"""{_FIXTURE}
SELECT date_dos, cnr_tour, CASE WHEN cnr_cust = 'Z49999' THEN 'nan' ELSE cnr_cust END AS cnr_cust,
  rfx_activity, rfx_year, rfx_preparation, nm_short_unload, win_from, win_until, planned, p_depart, duration_p,
  CASE WHEN actual NOT IN ('n/a', '') THEN actual END AS actual, a_depart, duration_a FROM o""",
        "stop_order_flags": f"""{_FLAGS}
SELECT {_ORDER_COLUMNS}, win_from_ts, win_until_ts, actual_ts, planned_ts, jit_s1_order, jit_s2_order FROM f""",
        "stop_deliveries": f"{_DELIVERIES} SELECT * FROM dl",
        "routes_overview": f"""{_DELIVERIES},
ro AS (SELECT date_dos, cnr_tour, count(*) AS orders, count_if(jit_s1_order) AS jit_s1_ord,
              count_if(jit_s2_order) AS jit_s2_ord FROM f GROUP BY ALL),
rd AS (SELECT date_dos, cnr_tour, count(*) AS deliveries, count_if(jit_s1_delivery) AS s1,
              count_if(jit_s2_delivery) AS s2 FROM dl GROUP BY ALL),
r AS (SELECT ro.*, coalesce(deliveries, 0) AS deliveries, coalesce(s1, 0) AS jit_s1_del, coalesce(s2, 0) AS jit_s2_del
      FROM ro LEFT JOIN rd USING (date_dos, cnr_tour)),
p AS (SELECT *, {_pct('jit_s1_del', 'deliveries')} AS jit_s1_del_pct, {_pct('jit_s2_del', 'deliveries')} AS jit_s2_del_pct,
             {_pct('jit_s1_ord', 'orders')} AS jit_s1_ord_pct, {_pct('jit_s2_ord', 'orders')} AS jit_s2_ord_pct FROM r)
SELECT *, CASE WHEN jit_s2_del_pct >= 95 THEN 'good' WHEN jit_s2_del_pct >= 93 THEN 'mid' ELSE 'bad' END AS route_grade
FROM p""",
        "route_detail_header": f"""{_FLAGS}
SELECT date_dos, cnr_tour, count(*) AS orders, {_pct('count_if(jit_s1_order)', 'count(*)')} AS s1_ord_pct,
  {_pct('count_if(jit_s2_order)', 'count(*)')} AS s2_ord_pct FROM f GROUP BY ALL""",
        "route_detail_orders": f"""{_FLAGS}
SELECT date_dos, cnr_tour, nm_short_unload, rfx_activity, rfx_year, rfx_preparation, {_fmt('win_from')} AS win_from,
  {_fmt('win_until')} AS win_until, {_fmt('planned')} AS planned, {_fmt('actual')} AS actual, jit_s1_order, jit_s2_order,
  {_GRADE.format(s1='jit_s1_order', s2='jit_s2_order')} AS row_grade FROM f""",
        "route_detail_deliveries": f"""{_DELIVERIES}
SELECT date_dos, cnr_tour, nm_short_unload, orders, {_fmt('win_from')} AS win_from, {_fmt('win_until')} AS win_until,
  {_fmt('first_planned')} AS first_planned, {_fmt('first_actual')} AS first_actual, jit_s1_delivery, jit_s2_delivery,
  {_GRADE.format(s1='jit_s1_delivery', s2='jit_s2_delivery')} AS row_grade FROM dl""",
    }


# ---------------------------------------------------------------- waits
_WAITS = f"""{_FLAGS},
w AS (SELECT * FROM f WHERE dur_a IS NOT NULL AND nm_short_unload IS NOT NULL),
wd AS (SELECT rfx_activity, date_dos, cnr_tour, nm_short_unload, avg(dur_a) AS avg_wait_min FROM w GROUP BY ALL)"""


def _waits() -> dict[str, str]:
    return {
        "waits_by_customer": f"""{_WAITS}
SELECT rfx_activity, count(*) AS deliveries, count(DISTINCT nm_short_unload) AS leverpunten,
  {_sum6('sum(avg_wait_min)')} AS total_wait_min, {_sum6('avg(avg_wait_min)')} AS avg_wait_per_delivery
FROM wd GROUP BY ALL""",
        "waits_by_store": f"""{_WAITS}
SELECT rfx_activity, nm_short_unload, count(*) AS deliveries, {_sum6('sum(avg_wait_min)')} AS total_wait_min
FROM wd GROUP BY ALL""",
        "waits_by_delivery": f"""{_WAITS} SELECT * FROM wd""",
        "waits_store_orders": f"""{_WAITS}
SELECT rfx_activity, nm_short_unload, date_dos, cnr_tour, cnr_cust, {_fmt('win_from')} AS win_from,
  {_fmt('win_until')} AS win_until, {_fmt('planned')} AS planned, {_fmt('actual')} AS actual,
  {_fmt('a_depart')} AS a_depart, dur_a AS duration_a_min FROM w""",
    }


# ---------------------------------------------------------------- outside
_OUTSIDE = f"""{_FLAGS},
s0 AS (
  SELECT date_dos, cnr_tour, nm_short_unload, arg_min(rfx_activity, row_ord) AS rfx_activity,
    min(actual_ts) AS actual_ts, arg_min(win_until_ts, row_ord) FILTER (WHERE win_until_ts IS NOT NULL) AS win_until_ts,
    min(planned_ts) AS planned_ts,
    coalesce(arg_min(actual, row_ord) FILTER (WHERE actual IS NOT NULL), '') AS actual,
    coalesce(arg_min(win_until, row_ord) FILTER (WHERE win_until IS NOT NULL), '') AS win_until,
    coalesce(arg_min(planned, row_ord) FILTER (WHERE planned IS NOT NULL), '') AS planned,
    count(cnr_cust) AS orders
  FROM f WHERE nm_short_unload IS NOT NULL GROUP BY ALL),
s AS (
  SELECT *, CASE WHEN actual_ts IS NULL OR win_until_ts IS NULL THEN NULL
                 WHEN actual_ts <= win_until_ts THEN 0.0::DOUBLE
                 ELSE {_min_between('win_until_ts', 'actual_ts')} END AS late_minutes,
            (actual_ts IS NULL OR win_until_ts IS NULL OR actual_ts > win_until_ts) AS outside_s2
  FROM s0)"""


def _outside() -> dict[str, str]:
    buckets = [
        ("0_15", "late_minutes <= 15"), ("15_30", "late_minutes > 15 AND late_minutes <= 30"),
        ("30_45", "late_minutes > 30 AND late_minutes <= 45"), ("45_60", "late_minutes > 45 AND late_minutes <= 60"),
        ("60_plus", "late_minutes > 60"),
    ]
    counts = ", ".join(f"count(*) FILTER (WHERE outside_s2 AND {cond}) AS cnt_{tag}" for tag, cond in buckets)
    shares = ", ".join(f"{_pct(f'cnt_{tag}', 'total_deliveries')} AS pct_{tag}" for tag, _ in buckets)
    cumul = ", ".join(
        f"huidige_jit_pct + ({' + '.join(f'pct_{t}' for t, _ in buckets[: i + 1])}) AS jit_pct_cumul_{tag}"
        for i, (tag, _) in enumerate(buckets)
    )
    return {
        "outside_stops": f"{_OUTSIDE} SELECT * FROM s",
        "outside_points": f"{_OUTSIDE} SELECT * FROM s WHERE outside_s2",
        "outside_daily": f"""{_OUTSIDE}
SELECT date_dos, count(DISTINCT nm_short_unload) AS leverpunten, count_if(outside_s2) AS leverpunten_outside,
  {_pct('count_if(outside_s2)', 'count(DISTINCT nm_short_unload)')} AS outside_pct FROM s GROUP BY ALL""",
        "outside_buckets_daily": f"""{_OUTSIDE},
g AS (SELECT date_dos, count(*) AS total_deliveries, count_if(outside_s2) AS totaal_buiten_jit, {counts},
             count_if(outside_s2 AND late_minutes IS NULL) AS "unknown" FROM s GROUP BY ALL),
h AS (SELECT *, {_pct('(total_deliveries - totaal_buiten_jit)', 'total_deliveries')} AS huidige_jit_pct, {shares}
      FROM g WHERE totaal_buiten_jit > 0)
SELECT *, {cumul} FROM h""",
    }


# ---------------------------------------------------------------- rca
_RCA_CLOCKS = ("planned", "actual", "a_depart", "win_until")


def _rca_stops(keys: str) -> str:
    """The first stored order of each stop, picked by rank and not by aggregate."""
    return f"""{_FLAGS},
k AS (SELECT * REPLACE (coalesce(nm_short_unload, 'nan') AS nm_short_unload),
             row_number() OVER (PARTITION BY {keys} ORDER BY row_ord) AS rk,
             count(*) OVER (PARTITION BY {keys}) AS orders FROM f),
rs0 AS (SELECT date_dos, cnr_tour, rfx_activity, nm_short_unload, planned_ts, actual_ts, a_depart_ts,
               {', '.join(f"{_fmt(c)} AS {c}" for c in _RCA_CLOCKS)}, dur_a AS wait_min,
               CASE WHEN actual_ts > win_until_ts THEN {_min_between('win_until_ts', 'actual_ts')}
                    WHEN actual_ts <= win_until_ts THEN 0.0::DOUBLE END AS late_min, orders
        FROM k WHERE rk = 1),
rs AS (SELECT *, CASE WHEN late_min IS NULL THEN 'unknown' WHEN late_min > 60 THEN '60+' WHEN late_min > 30 THEN '30–60'
                      WHEN late_min > 15 THEN '15–30' WHEN late_min > 0 THEN '0–15' ELSE '0' END AS late_bucket FROM rs0)"""


_RCA = _rca_stops("date_dos, cnr_tour, rfx_activity, coalesce(nm_short_unload, 'nan')")
_RCA_SEQUENCE = f"""{_RCA},
q0 AS (SELECT *, lag(a_depart_ts) OVER w AS prev_a_depart, lag(planned_ts) OVER w AS prev_planned FROM rs
       WINDOW w AS (PARTITION BY date_dos, cnr_tour ORDER BY planned_ts NULLS LAST, nm_short_unload, rfx_activity)),
sq AS (SELECT *, {_min_between('prev_a_depart', 'actual_ts')} AS transit_actual_min,
              {_min_between('prev_planned', 'planned_ts')} AS transit_planned_min,
              {_min_between('prev_a_depart', 'actual_ts')} - {_min_between('prev_planned', 'planned_ts')} AS transit_delay_min,
              {_min_between('prev_planned', 'prev_a_depart')} AS late_departure_proxy_min FROM q0)"""


def _rca() -> dict[str, str]:
    return {
        "rca_stops": f"{_RCA} SELECT * FROM rs",
        "rca_stop_sequence": f"{_RCA_SEQUENCE} SELECT * FROM sq",
        "rca_route_decomposition": f"""{_RCA_SEQUENCE}
SELECT date_dos, cnr_tour, rfx_activity, count(*) AS stops,
  round_even(coalesce(sum(wait_min), 0), 2) AS total_wait_min, round_even(coalesce(sum(late_min), 0), 2) AS total_late_min,
  round_even(coalesce(sum(late_departure_proxy_min), 0), 2) AS sum_late_depart_proxy_min,
  round_even(coalesce(sum(transit_delay_min), 0), 2) AS sum_transit_delay_min
FROM sq WHERE prev_a_depart IS NOT NULL AND prev_planned IS NOT NULL GROUP BY ALL""",
        "rca_late_buckets": f"""{_RCA}
SELECT date_dos, rfx_activity, late_bucket, count(DISTINCT nm_short_unload) AS leverpunten FROM rs GROUP BY ALL""",
        "rca_customer_day": f"""{_RCA}
SELECT date_dos, rfx_activity, count(DISTINCT nm_short_unload) AS leverpunten, count(DISTINCT cnr_tour) AS routes,
  coalesce(sum(wait_min), 0) AS total_wait_min, coalesce(sum(late_min), 0) AS total_late_min FROM rs GROUP BY ALL""",
        "rca_detail": f"""{_RCA}
SELECT date_dos, rfx_activity, cnr_tour, nm_short_unload, orders, planned, actual, a_depart, win_until, wait_min, late_min
FROM rs""",
    }


# ---------------------------------------------------------------- transport
_TRANSPORT = f"""{_FLAGS},
ts0 AS (
  SELECT date_dos, cnr_tour, nm_short_unload, arg_min(rfx_activity, row_ord) AS rfx_activity,
    min(planned_ts) AS planned_ts, min(actual_ts) AS actual_ts, min(a_depart_ts) AS a_depart_ts,
    coalesce(arg_min(planned, row_ord) FILTER (WHERE planned IS NOT NULL), '') AS planned,
    coalesce(arg_min(actual, row_ord) FILTER (WHERE actual IS NOT NULL), '') AS actual,
    coalesce(arg_min(a_depart, row_ord) FILTER (WHERE a_depart IS NOT NULL), '') AS a_depart,
    arg_min(duration_p, row_ord) FILTER (WHERE duration_p IS NOT NULL) AS first_p,
    arg_min(duration_a, row_ord) FILTER (WHERE duration_a IS NOT NULL) AS first_a,
    count(cnr_cust) AS orders
  FROM f WHERE nm_short_unload IS NOT NULL GROUP BY ALL),
ts1 AS (SELECT *, {_num('first_p')} AS planned_block_min,
               coalesce({_num('first_a')}, {_min_between('actual_ts', 'a_depart_ts')}) AS actual_block_min FROM ts0),
st AS (SELECT * EXCLUDE (first_p, first_a), {_min_between('planned_ts', 'actual_ts')} AS arrival_delta_min,
              actual_block_min - planned_block_min AS delta_block_min,
              row_number() OVER (PARTITION BY date_dos, cnr_tour ORDER BY planned_ts NULLS LAST, nm_short_unload) AS planned_pos,
              row_number() OVER (PARTITION BY date_dos, cnr_tour ORDER BY actual_ts NULLS LAST, nm_short_unload) AS actual_pos
       FROM ts1),
sp AS (SELECT *, actual_pos - planned_pos AS seq_delta FROM st),
dp AS (SELECT date_dos, cnr_tour, arg_min(rfx_activity, row_ord) AS rfx_activity,
              arg_min(p_depart, row_ord) FILTER (WHERE p_depart IS NOT NULL) AS p1,
              arg_min(a_depart, row_ord) FILTER (WHERE a_depart IS NOT NULL) AS a1 FROM f GROUP BY ALL),
dd AS (SELECT date_dos, cnr_tour, rfx_activity, {_min_between(_ts('p1'), _ts('a1'))} AS dep_delay_min FROM dp)"""


def _transport() -> dict[str, str]:
    return {
        "transport_stops": f"{_TRANSPORT} SELECT * FROM sp",
        "transport_routes": f"""{_TRANSPORT},
r AS (SELECT date_dos, cnr_tour, count(*) AS n, count_if(seq_delta <> 0) AS mism, max(abs(seq_delta)) AS shift,
             sum(planned_block_min) AS p, sum(actual_block_min) AS a FROM sp GROUP BY ALL)
SELECT date_dos, cnr_tour, rfx_activity, coalesce(n, 0) AS leverpunten, coalesce(mism, 0) AS seq_mismatch_cnt,
  coalesce(shift, 0) AS max_abs_seq_delta, dep_delay_min, coalesce(p, 0) AS planned_block_total_min,
  coalesce(a, 0) AS actual_block_total_min, coalesce(a, 0) - coalesce(p, 0) AS delta_block_total_min
FROM dd LEFT JOIN r USING (date_dos, cnr_tour)""",
        "transport_sequence": f"""{_TRANSPORT}
SELECT date_dos, cnr_tour, nm_short_unload, planned, actual, planned_pos, actual_pos, seq_delta, orders FROM sp""",
        "transport_departure": f"{_TRANSPORT} SELECT date_dos, cnr_tour, dep_delay_min FROM dd",
        "transport_blocks": f"""{_TRANSPORT}
SELECT date_dos, cnr_tour, nm_short_unload, planned, actual, a_depart, planned_block_min, actual_block_min,
  delta_block_min, arrival_delta_min, orders FROM sp""",
    }


# ---------------------------------------------------------------- window report
def _window_base(tolerance: int) -> str:
    slack = f"INTERVAL {tolerance} MINUTE"
    channel = """CASE cnr_cust WHEN 'Z41102' THEN 'express' WHEN 'Z41103' THEN 'hyper' WHEN 'Z41104' THEN 'partner'
      WHEN 'Z41105' THEN 'Super / MKTI' WHEN 'Z41108' THEN 'B2B' ELSE 'Overig' END"""
    return f"""{_FLAGS},
v AS (SELECT * REPLACE (CAST(date_dos AS DATE) AS date_dos, coalesce(nm_short_unload, 'nan') AS nm_short_unload),
             (win_from_ts IS NOT NULL AND win_until_ts IS NOT NULL AND actual_ts IS NOT NULL) AS valid
      FROM f WHERE rfx_activity IN ('4', '5')),
wo AS (SELECT *, valid AND actual_ts >= win_from_ts - {slack} AND actual_ts <= win_until_ts + {slack} AS order_jit_s1,
              valid AND actual_ts <= win_until_ts + {slack} AS order_jit_s2, {channel} AS kanaal,
              dur_a - dur_p AS extra FROM v),
wd AS (SELECT date_dos, cnr_tour, cnr_cust, nm_short_unload, win_from, win_until, count(*) AS orders_total,
              count_if(order_jit_s1) AS orders_jit_s1, count_if(order_jit_s2) AS orders_jit_s2,
              bool_or(order_jit_s1) AS any_jit_s1, bool_or(order_jit_s2) AS any_jit_s2,
              arg_min(rfx_activity, row_ord) AS rfx_activity, arg_min(kanaal, row_ord) AS kanaal,
              bool_or(order_jit_s1) AS delivery_jit_s1, bool_or(order_jit_s2) AS delivery_jit_s2
       FROM wo WHERE date_dos IS NOT NULL AND win_from IS NOT NULL AND win_until IS NOT NULL GROUP BY
         date_dos, cnr_tour, cnr_cust, nm_short_unload, win_from, win_until),
lt AS (SELECT *, CASE WHEN extra > 30 THEN 'Ernstige wachttijd >30 min' WHEN extra > 10 THEN 'Matige wachttijd 10–30 min'
                      WHEN extra >= 0 THEN 'Lichte wachttijd 0–10 min' WHEN extra < 0 THEN 'Geen extra wachttijd / vroeger weg'
                      ELSE 'Onbekend / ontbrekende wachttijd' END AS rootcause_bucket FROM wo WHERE NOT order_jit_s2)"""


def _window(tolerance: int) -> dict[str, str]:
    base = _window_base(tolerance)
    n3 = """count(*) AS leveringen_totaal, count_if(delivery_jit_s1) AS leveringen_jit_s1,
  count_if(delivery_jit_s2) AS leveringen_jit_s2"""
    rates = f"""{_pct2('count_if(delivery_jit_s1)', 'count(*)')} AS jit_pct_lev_s1,
  {_pct2('count_if(delivery_jit_s2)', 'count(*)')} AS jit_pct_lev_s2"""
    route_order = """date_dos, cnr_tour, cnr_cust, rfx_activity, kanaal, nm_short_unload, win_from, win_until,
  planned, actual, order_jit_s1, order_jit_s2"""
    return {
        "window_orders": f"""{base}
SELECT date_dos, cnr_tour, cnr_cust, nm_short_unload, win_from, win_until, rfx_activity, rfx_year, rfx_preparation,
  duration_p, duration_a, planned, actual, win_from_ts, win_until_ts, planned_ts, actual_ts, order_jit_s1, order_jit_s2,
  kanaal FROM wo""",
        "window_deliveries": f"{base} SELECT * FROM wd",
        "window_summary": f"""{base},
a AS (SELECT count(*) AS totaal_orders, count_if(order_jit_s1) AS jit_orders_s1, count_if(order_jit_s2) AS jit_orders_s2 FROM wo),
d2 AS (SELECT count(*) AS totaal_leveringen, count_if(delivery_jit_s1) AS jit_leveringen_s1,
              count_if(delivery_jit_s2) AS jit_leveringen_s2 FROM wd)
SELECT *, {_pct2('jit_orders_s1', 'totaal_orders')} AS jit_pct_orders_s1, {_pct2('jit_orders_s2', 'totaal_orders')} AS jit_pct_orders_s2,
  {_pct2('jit_leveringen_s1', 'totaal_leveringen')} AS jit_pct_leveringen_s1,
  {_pct2('jit_leveringen_s2', 'totaal_leveringen')} AS jit_pct_leveringen_s2
FROM a, d2 WHERE totaal_leveringen > 0""",
        "window_daily_overview": f"""{base},
dv AS (SELECT date_dos, {n3} FROM wd GROUP BY date_dos),
ov AS (SELECT date_dos, count(*) AS orders_totaal, count_if(order_jit_s1) AS orders_jit_s1,
              count_if(order_jit_s2) AS orders_jit_s2 FROM wo WHERE date_dos IS NOT NULL GROUP BY date_dos),
j AS (SELECT date_dos, coalesce(leveringen_totaal, 0) AS leveringen_totaal, coalesce(leveringen_jit_s1, 0) AS leveringen_jit_s1,
             coalesce(leveringen_jit_s2, 0) AS leveringen_jit_s2, coalesce(orders_totaal, 0) AS orders_totaal,
             coalesce(orders_jit_s1, 0) AS orders_jit_s1, coalesce(orders_jit_s2, 0) AS orders_jit_s2
      FROM dv FULL JOIN ov USING (date_dos))
SELECT *, {_pct2('leveringen_jit_s1', 'leveringen_totaal')} AS jit_pct_lev_s1,
  {_pct2('leveringen_jit_s2', 'leveringen_totaal')} AS jit_pct_lev_s2,
  {_pct2('orders_jit_s1', 'orders_totaal')} AS jit_pct_ord_s1, {_pct2('orders_jit_s2', 'orders_totaal')} AS jit_pct_ord_s2
FROM j""",
        "window_by_activity": f"{base} SELECT rfx_activity, {n3}, {rates} FROM wd GROUP BY rfx_activity",
        "window_by_channel": f"{base} SELECT kanaal, {n3}, {rates} FROM wd GROUP BY kanaal",
        "window_bottom_routes": f"""{base}
SELECT date_dos, cnr_tour, count(*) AS leveringen_totaal, count_if(delivery_jit_s2) AS leveringen_jit_s2,
  {_pct2('count_if(delivery_jit_s2)', 'count(*)')} AS jit_pct_lev_s2
FROM wd GROUP BY date_dos, cnr_tour ORDER BY jit_pct_lev_s2, date_dos, cnr_tour LIMIT 10""",
        "window_impact_stores": f"""{base}
SELECT nm_short_unload AS winkelpunt, count(*) AS leveringen_totaal, count_if(NOT delivery_jit_s2) AS non_jit_leveringen,
  {_pct2('count_if(NOT delivery_jit_s2)', 'count(*)')} AS non_jit_pct
FROM wd GROUP BY nm_short_unload ORDER BY non_jit_leveringen DESC, non_jit_pct DESC, winkelpunt LIMIT 15""",
        "window_wait_buckets": f"""{base}
SELECT rootcause_bucket, count(*) AS aantal, {_pct2('count(*)', '(SELECT count(*) FROM lt)')} AS aandeel_pct
FROM lt GROUP BY rootcause_bucket""",
        "window_wait_by_store": f"""{base}
SELECT nm_short_unload, count(*) AS late_orders, round_even(avg(dur_p), 1) AS avg_duration_p_min,
  round_even(avg(dur_a), 1) AS avg_duration_a_min, round_even(avg(extra), 1) AS avg_extra_wachttijd_min
FROM lt GROUP BY nm_short_unload ORDER BY late_orders DESC, avg_extra_wachttijd_min DESC NULLS LAST, nm_short_unload LIMIT 15""",
        "window_route_detail_orders": f"{base} SELECT {route_order} FROM wo WHERE date_dos IS NOT NULL",
        "window_route_detail_deliveries": f"""{base}
SELECT date_dos, cnr_tour, cnr_cust, kanaal, nm_short_unload, win_from, win_until, orders_total, orders_jit_s1,
  orders_jit_s2, delivery_jit_s1, delivery_jit_s2 FROM wd""",
    }


# ---------------------------------------------------------------- kpi, root causes, deliveries table
_KPI_COLUMNS = """uid, cnr_tour, cnr_cust, nm_short_unload, customer, site, planned_time, actual_time, date_dos,
  raw_planned, raw_actual, reason"""


def _kpi_base(tolerance: int) -> str:
    return f"""{_FIXTURE},
kd AS (SELECT *, cnr_cust AS customer, planned AS raw_planned, actual AS raw_actual, {_ts('planned')} AS planned_time,
              {_ts('actual')} AS actual_time FROM o),
kr AS (SELECT *, coalesce(actual_time <= planned_time + INTERVAL {tolerance} MINUTE, false) AS on_time FROM kd)"""


_PARETO = f"""{_kpi_base(0)},
lk AS (SELECT * FROM kr WHERE NOT on_time),
pa AS (SELECT CASE reason WHEN 'late_dispatch' THEN 'Transport/Dispatch' WHEN 'early_dispatch' THEN 'Transport/Dispatch'
              WHEN 'last_minute_change' THEN 'Customer/Order Mgmt' WHEN 'wms_tms_mismatch' THEN 'IT/Integration'
              WHEN 'insufficient_stock' THEN 'Inventory' WHEN 'picking_delay' THEN 'Operations/Picking'
              WHEN 'other_code' THEN 'Other' ELSE 'Unknown' END AS reason_bucket, count(*) AS "count",
              {_pct2('count(*)', '(SELECT count(*) FROM lk)')} AS share_pct FROM lk GROUP BY 1)"""

_DELIVERY_COLUMNS = """uid, cnr_tour, cnr_cust, nm_short_unload, customer, site, planned_time, actual_time, date_dos,
  raw_planned, raw_actual, payload_json, created_at, updated_at"""

_DELIVERY_TABLE = f"""{_FIXTURE},
dt AS (SELECT uid, cnr_tour, cnr_cust, nm_short_unload, cnr_cust AS customer, site, date_dos || ' ' || planned AS planned_time,
              date_dos || ' ' || actual AS actual_time, date_dos, planned AS raw_planned, actual AS raw_actual,
              CAST(NULL AS VARCHAR) AS payload_json, CAST(NULL AS VARCHAR) AS updated_at, reason, row_ord FROM o)"""


def _kpi(tolerance: int) -> dict[str, str]:
    base = _kpi_base(tolerance)
    return {
        "kpi_rows": f"{base} SELECT {_KPI_COLUMNS}, on_time FROM kr",
        "kpi_overall": f"""{base} SELECT count(*) AS orders, count_if(on_time) AS on_time,
  {_pct2('count_if(on_time)', 'count(*)')} AS kpi_pct FROM kr""",
        "kpi_by_group": f"""{base} SELECT customer, site, count(*) AS orders,
  {_pct2('count_if(on_time)', 'count(*)')} AS kpi_pct FROM kr GROUP BY customer, site""",
    }


def _causes() -> dict[str, str]:
    lift = {"Transport/Dispatch": 1.0, "Customer/Order Mgmt": 0.7, "IT/Integration": 0.4, "Inventory": 0.6,
            "Operations/Picking": 0.5, "Other": 0.3, "Unknown": 0.2}
    action = {"Transport/Dispatch": "Herbekijk cut-off tijden en herkalibreer transportplanning",
              "Customer/Order Mgmt": "Herzie order lock-time afspraken met klant",
              "IT/Integration": "Controleer WMS–TMS interfaces en corrigeer mapping",
              "Inventory": "Stockparameters en replenishment-cycli bijstellen",
              "Operations/Picking": "Capaciteitsplanning en pick-sequentie optimaliseren",
              "Other": "Voer Gemba-walk en 5-Why analyse uit",
              "Unknown": "Label data verbeteren en exceptions registreren"}
    owner = {"Transport/Dispatch": "Transport", "Customer/Order Mgmt": "Account Mgmt", "IT/Integration": "IT",
             "Inventory": "Supply Chain", "Operations/Picking": "Operations", "Other": "Quality",
             "Unknown": "Process Excellence"}
    rows = ", ".join(f"('{k}', CAST({lift[k]} AS DOUBLE), '{action[k]}', '{owner[k]}')" for k in lift)
    known = "'Z41102', 'Z41103', 'Z41104', 'Z41105', 'Z41108'"
    return {
        "root_cause_pareto": f"{_PARETO} SELECT * FROM pa",
        "root_cause_segments": f"""{_PARETO},
sg AS (SELECT * FROM lk WHERE nm_short_unload IS NOT NULL)
SELECT customer, site, cnr_tour, nm_short_unload, count(*) AS "count",
  {_pct2('count(*)', '(SELECT count(*) FROM sg)')} AS share_pct FROM sg GROUP BY ALL""",
        "action_plan": f"""{_PARETO},
kp AS (SELECT {_pct2('count_if(on_time)', 'count(*)')} AS pct FROM kr),
rc(cluster, lift, act, owner) AS (VALUES {rows})
SELECT reason_bucket AS oorzaak_cluster,
  round_even(least(greatest(0.0::DOUBLE, 97.0::DOUBLE - pct), lift * share_pct / 10.0::DOUBLE), 2) AS impact_pct_pts,
  act AS aanbevolen_maatregel, owner AS verantwoordelijke, '2024-01-15' AS deadline
FROM pa JOIN rc ON cluster = reason_bucket, kp""",
        "route_delay_clusters": f"""{_kpi_base(0)},
y AS (SELECT cnr_tour || '-' || date_dos AS cnr_tour, planned_time, row_ord,
             {_min_between('planned_time', 'actual_time')} AS delay FROM kr),
z AS (SELECT cnr_tour, count(*) AS stops,
             first(delay ORDER BY planned_time, row_ord) FILTER (WHERE delay IS NOT NULL) AS start_delay,
             last(delay ORDER BY planned_time, row_ord) FILTER (WHERE delay IS NOT NULL) AS end_delay,
             avg(delay) AS avg_delay, max(delay) AS max_delay FROM y GROUP BY cnr_tour)
SELECT *, CASE WHEN start_delay > 10 THEN 'Planning/Dispatch'
               WHEN start_delay <= 10 AND max_delay > 15 THEN 'Sequencing / Route design'
               ELSE 'Stable / On time' END AS root_cause_cluster FROM z""",
        "customer_labels": f"""{_DELIVERY_TABLE}
SELECT uid, customer, site, date_dos, CASE customer WHEN 'Z41102' THEN 'express' WHEN 'Z41103' THEN 'hyper'
  WHEN 'Z41104' THEN 'partner' WHEN 'Z41105' THEN 'Super / MKTI' WHEN 'Z41108' THEN 'B2B' ELSE '' END AS customer_label
FROM dt""",
        "allowed_customers": f"{_DELIVERY_TABLE} SELECT uid, customer, site, date_dos FROM dt WHERE customer IN ({known})",
        # Table = first rows of the days before 1996; batch = all rows, so its first rows of other uids are added.
        "append_deliveries": f"""{_DELIVERY_TABLE},
old AS (SELECT *, '2024-01-01 00:00:00' AS created_at FROM dt WHERE date_dos < '1996-01-01'
        QUALIFY row_number() OVER (PARTITION BY uid ORDER BY row_ord) = 1),
new AS (SELECT *, '2024-01-02 00:00:00' AS created_at FROM dt WHERE uid NOT IN (SELECT uid FROM old)
        QUALIFY row_number() OVER (PARTITION BY uid ORDER BY row_ord) = 1)
SELECT {_DELIVERY_COLUMNS} FROM old UNION ALL SELECT {_DELIVERY_COLUMNS} FROM new""",
        "scan_deliveries": f"""{_DELIVERY_TABLE}
SELECT uid, customer, site, date_dos, planned_time, actual_time FROM dt WHERE date_dos >= '1992-01-01' AND date_dos < '2000-01-01'""",
    }


def _where(sql: str, condition: str) -> str:
    """The same query over the orders that meet a condition."""
    before, after = sql.split("o AS (\n", 1)
    body, rest = after.split("  FROM t)", 1)
    return f"{before}o_all AS (\n{body}  FROM t),\no AS (SELECT * FROM o_all WHERE {condition}){rest}"


#: Conditions of the filtered registrations, by the suffix of their names.
FILTERED = {
    "routes_overview_in_range": ("routes_overview", "date_dos BETWEEN '1994-01-01' AND '1995-12-31' AND rfx_activity = '4'"),
    "stop_deliveries_of_tour": ("stop_deliveries", "date_dos >= '1995-01-01' AND date_dos <= '1995-06-30' AND cnr_tour = '770001'"),
    "scan_orders_of_activity": ("scan_orders", "rfx_activity = '4'"),
    "transport_routes_in_range": ("transport_routes", "date_dos >= '1994-01-01' AND date_dos <= '1995-12-31'"),
    "transport_stops_of_activity": ("transport_stops", "rfx_activity = '5'"),
    "rca_route_decomposition_in_range": ("rca_route_decomposition", "date_dos >= '1994-01-01' AND rfx_activity = '4'"),
    "rca_customer_day_in_range": ("rca_customer_day", "date_dos >= '1994-01-01' AND date_dos <= '1995-12-31'"),
}


#: The orders over more shops and tours, with missing keys.
_WIDE = {
    "date_dos": "CASE WHEN CAST(rfx_year AS INT) % 19 = 0 THEN NULL ELSE date_dos END",
    "cnr_tour": "CASE WHEN CAST(rfx_year AS INT) % 13 = 0 THEN NULL ELSE cnr_tour || '-' || CAST(CAST(rfx_preparation AS INT) % 25 AS VARCHAR) END",
    "nm_short_unload": "CASE WHEN CAST(rfx_year AS INT) % 17 = 0 THEN NULL ELSE 'W' || CAST(CAST(rfx_preparation AS INT) % 40 AS VARCHAR) END",
    "rfx_activity": "CASE WHEN CAST(rfx_year AS INT) % 23 = 0 THEN NULL ELSE rfx_activity END",
}


def _wide(sql: str, needed: tuple[str, ...], named: tuple[str, ...]) -> str:
    """The same query over these; orders without a ``needed`` key are left out, a missing ``named`` key is the text ``nan``."""
    before, after = sql.split("o AS (\n", 1)
    body, rest = after.split("  FROM t)", 1)
    columns = {**_WIDE} | {c: f"coalesce({_WIDE[c]}, 'nan')" for c in named}
    replaced = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    kept = " AND ".join([f"{c} IS NOT NULL" for c in needed] or ["true"])
    return (
        f"{before}o_all AS (\n{body}  FROM t),\no_wide AS (SELECT * REPLACE ({replaced}) FROM o_all),\n"
        f"o AS (SELECT * FROM o_wide WHERE {kept}){rest}"
    )


def _in_order(sql: str, order: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM ({sql})"


_ROUTE = ("date_dos", "cnr_tour")
_RCA_KEYS = ("date_dos", "cnr_tour", "rfx_activity", "nm_short_unload")
#: Keys that must be there, keys whose absence is a group, and the order of the result, by query.
WIDE = {
    "stop_deliveries": ((), (), None),
    "outside_stops": ((*_ROUTE, "nm_short_unload"), (), None),
    "transport_stops": (_ROUTE, (), None),
    "rca_stops": ((), _RCA_KEYS, None),
    "rca_late_buckets": ((), _RCA_KEYS, None),
    "window_summary": ((), ("cnr_tour",), None),
    "waits_by_delivery": (_RCA_KEYS, (), None),
    "routes_overview": (_ROUTE, (), "date_dos, cnr_tour"),
    "outside_daily": ((*_ROUTE, "nm_short_unload"), (), "date_dos"),
    "rca_customer_day": ((), _RCA_KEYS, "date_dos, total_wait_min DESC, rfx_activity"),
    "rca_route_decomposition": (
        (), _RCA_KEYS, "sum_late_depart_proxy_min DESC, sum_transit_delay_min DESC, date_dos, cnr_tour, rfx_activity"
    ),
    "transport_routes": (_ROUTE, (), "date_dos, delta_block_total_min DESC, cnr_tour"),
    "route_options": ((), (), "cnr_tour"),
    "window_daily_overview": ((), ("cnr_tour",), "date_dos"),
    "window_by_channel": ((), ("cnr_tour",), "leveringen_totaal DESC, kanaal"),
    "window_bottom_routes": ((), ("cnr_tour",), "jit_pct_lev_s2, date_dos, cnr_tour"),
    "window_impact_stores": ((), ("cnr_tour",), "non_jit_leveringen DESC, non_jit_pct DESC, winkelpunt"),
    "window_wait_by_store": ((), ("cnr_tour",), "late_orders DESC, avg_extra_wachttijd_min DESC NULLS LAST, nm_short_unload"),
    "window_wait_buckets": ((), ("cnr_tour",), "aantal DESC, rootcause_bucket"),
}


def _of_one(plain: dict[str, str]) -> dict[str, str]:
    """Details of one shop or route, with the place of each line."""
    route = "date_dos = '1998-08-24' AND cnr_tour = '770002'"

    def lines(name: str, order: str, condition: str) -> str:
        head, columns = plain[name].rsplit("SELECT ", 1)
        columns, source = columns.rsplit(" FROM ", 1)
        table = source.split()[0]
        return f"{head}SELECT {columns}, row_number() OVER (ORDER BY {order}) AS place FROM {table} WHERE {condition}"

    return {
        "waits_store_orders_of_store": lines(
            "waits_store_orders", "w.date_dos, w.cnr_tour, w.planned_ts NULLS LAST, w.actual NULLS LAST, w.row_ord",
            "rfx_activity = '4' AND nm_short_unload = 'ST3'",
        ),
        "window_route_detail_orders_of_route": lines("window_route_detail_orders", "nm_short_unload, actual NULLS LAST, row_ord", route),
        "window_route_detail_deliveries_of_route": lines("window_route_detail_deliveries", "nm_short_unload, win_from, cnr_cust, win_until", route),
        "route_detail_orders_of_route": lines("route_detail_orders", "f.planned_ts NULLS LAST, f.nm_short_unload NULLS LAST, f.row_ord", route),
        "transport_sequence_of_route": lines("transport_sequence", "planned_pos", route),
    }


def oracle_sql() -> dict[str, str]:
    out = {**_app(), **_waits(), **_outside(), **_rca(), **_transport(), **_window(0), **_kpi(0), **_causes()}
    for name, sql in {**_window(15), **_kpi(15)}.items():
        out[f"{name}_tol15"] = sql
    for name, (plain, condition) in FILTERED.items():
        out[name] = _where(out[plain], condition)
    for name, (needed, named, order) in WIDE.items():
        sql = _wide(out[name], needed, named)
        out[f"{name}_wide"] = _in_order(sql, order) if order else sql
    # A route's activity is that of its first order, also if that has none.
    out["transport_routes_wide"] = out["transport_routes_wide"].replace(
        "dp AS (SELECT date_dos, cnr_tour, arg_min(", "dp AS (SELECT date_dos, cnr_tour, arg_min_null("
    )
    out |= _of_one(out)
    out["ingest_orders_from_files"] = out["ingest_orders"]
    # Without actual durations in the file, the wait is the time between arrival and departure.
    out["rca_stops_without_durations"] = out["rca_stops"].replace("dur_a AS wait_min", f"{_min_between('actual_ts', 'a_depart_ts')} AS wait_min")
    return out
