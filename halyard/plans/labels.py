"""Queries over the raw feed: alignment, canonical reports, consensus, scale, labels and confirmation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.scalars import market_timestamp, profit_state, stock6, stock_lenient, stock_strict
from halyard.operators import canonical, consensus, labels
from halyard.operators.calendar import align_to_session, session_after_months, session_offset, session_on_or_after
from halyard.session import materialize, shared
from halyard.sources.sinks import source_signature
from halyard.sources.tables import table

COVERAGE_START, COVERAGE_END = "2021-06-01", "2025-12-31"


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_reports", *canonical.NEEDED)


def _day(c: str):
    return F.date_format(c, "yyyyMMdd").cast("int").alias(c)


def calendar_align(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_reports", "ID", "CREATE_DATE").distinct().withColumn("ts", market_timestamp("CREATE_DATE"))
    return align_to_session(rows, "ts", table(spark, folder, "calendar")).select("ID", "CREATE_DATE", _day("available_date"))


def next_trading_day(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "report_fy_labels", "publish_date").distinct()
    cal = table(spark, folder, "calendar")
    out = session_on_or_after(days, F.col("publish_date"), cal, "on_or_after")
    out = session_after_months(out, "publish_date", 3, cal, "after_3m")
    return out.select(_day("publish_date"), _day("on_or_after"), _day("after_3m"))


def label_end_dates(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "report_fy_labels", "available_date").distinct()
    return session_offset(days, "available_date", 5, table(spark, folder, "calendar"), "end_5d").select(_day("available_date"), _day("end_5d"))


def stock_code_norm(spark: SparkSession, folder: str) -> DataFrame:
    codes = table(spark, folder, "raw_reports", "STOCK_CODE").distinct()
    return codes.select("STOCK_CODE", stock6("STOCK_CODE").alias("any_notation"), stock_lenient("STOCK_CODE").alias("lenient"), stock_strict("STOCK_CODE").alias("strict"))


def _parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return canonical.canonicalize(_raw(spark, folder), table(spark, folder, "calendar"))


def canonical_reports(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder)[0].select("report_id", "stock_code", "org_id", "title", F.length("text").alias("n_text"), _day("publish_date"), _day("available_date"), F.size(F.from_json("source_report_ids", "array<string>")).alias("n_sources"))


def report_fy_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder)[1].select("report_id", "fy", "stock_code", "forecast_horizon", F.round("forecast_new", 4).alias("forecast_new"), "forecast_conflict", "n_source_rows", F.size("forecast_values").alias("n_values"))


def org_daily(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.org_daily(_parts(spark, folder)[1]).select("stock_code", "fy", "org_id", _day("available_date"), F.round("forecast", 4).alias("forecast"), _day("publish_date"))


def _held(spark: SparkSession, folder: str, name: str, build) -> list[DataFrame]:
    """Tables many queries start from, built once for the state of the source tables they come from."""
    state = tuple(json.dumps(source_signature(spark, f"{folder}/{t}.parquet"), sort_keys=True) for t in ("raw_reports", "calendar", "actuals"))
    return shared(spark, (name, state), build)


def _history(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    def build() -> list[DataFrame]:
        report_fy = materialize(_parts(spark, folder)[1], "report-fy")
        return [report_fy, materialize(canonical.org_daily(report_fy), "org-daily")]

    return tuple(_held(spark, folder, "history", build))


def _consensus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    report_fy, daily = _history(spark, folder)
    (rows,) = _held(spark, folder, "consensus", lambda: [materialize(consensus.pre_consensus(report_fy, daily, COVERAGE_START), "consensus")])
    return rows, daily


def pre_consensus(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = _consensus(spark, folder)
    return rows.select("report_id", "fy", F.round("consensus_pre", 4).alias("consensus_pre"), F.round("mad_pre_abs", 4).alias("mad_pre_abs"), "n_org_pre", "history_window_complete", "pre_invalid_reason")


def _scaled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows, daily = _consensus(spark, folder)
    return consensus.with_scale(rows), daily


def scale_floor(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = _consensus(spark, folder)
    return consensus.scale_floors(rows).select(_day("month"), "forecast_horizon", "scale_reference", "scale_sample_count", F.round("scale_floor", 4).alias("scale_floor"))


def profit_states(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = _scaled(spark, folder)
    return rows.select("report_id", "fy", "pre_state", F.round("scale_t", 4).alias("scale_t"), F.round("dispersion_pre", 6).alias("dispersion_pre"), "pre_label_valid", "pre_label_invalid_reason")


def normalize_actuals(spark: SparkSession, folder: str) -> DataFrame:
    return labels.normalized_actuals(table(spark, folder, "actuals")).select("stock_code", "fy", "actual_np", _day("actual_publish_date"), _day("actual_known_date"), "source_id")


def first_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "actuals", "stock_code", "fy", "actual_np", "actual_known_date", "actual_publish_date", "source_id").where("actual_known_date is not null")
    clean, _ = labels.first_disclosures(rows)
    return clean.select("stock_code", "fy", "actual_np", "n_source", "n_first", "later_revisions")


def first_disclosure_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "actuals", "stock_code", "fy", "actual_np", "actual_known_date", "actual_publish_date", "source_id").where("actual_known_date is not null")
    return labels.first_disclosures(rows)[1].select("stock_code", "fy", "source_id", "actual_np")


def _labelled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    scaled, daily = _scaled(spark, folder)
    (rows,) = _held(spark, folder, "labelled", lambda: [materialize(labels.with_actuals(scaled, labels.normalized_actuals(table(spark, folder, "actuals"))), "labelled")])
    return rows, daily


def residual_edge(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = _labelled(spark, folder)
    return rows.select(
        "report_id", "fy", "residual_valid", "actual_invalid_reason", F.round("residual_signed_raw", 6).alias("residual_signed_raw"), F.round("edge", 6).alias("edge"), "days_to_actual", "profit_transition"
    )


def _confirmed(spark: SparkSession, folder: str) -> DataFrame:
    rows, daily = _labelled(spark, folder)
    # written once: a filter on the labels would otherwise be pushed into, and repeat, the array expressions
    (out,) = _held(spark, folder, "confirmed", lambda: [materialize(labels.confirmations(rows, daily, table(spark, folder, "calendar"), COVERAGE_END), "confirmed")])
    return out


def confirmation(spark: SparkSession, folder: str) -> DataFrame:
    r = lambda c: F.round(c, 5).alias(c)
    return _confirmed(spark, folder).select("report_id", "fy", "confirmation_months", "peer_panel", "n_org_pre", "n_org_future", "n_peer_updates", "n_org_entries", "n_org_exits", "invalid_reason", r("progress"), r("delta_log_dispersion"), r("sample_weight"), "confirmation_probe_valid")


def coverage_audit(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = _labelled(spark, folder)
    rows = rows.withColumn("report_year", F.year("available_date"))
    audit = labels.coverage_audit(rows, "residual", "residual_valid", "actual_invalid_reason", ["report_year", "forecast_horizon"])
    return audit.withColumn("rate", F.round("rate", 8))


QUERIES = {
    "calendar_align": calendar_align,
    "next_trading_day": next_trading_day,
    "label_end_dates": label_end_dates,
    "stock_code_norm": stock_code_norm,
    "canonical_reports": canonical_reports,
    "report_fy_summary": report_fy_summary,
    "org_daily": org_daily,
    "pre_consensus": pre_consensus,
    "scale_floor": scale_floor,
    "profit_state": profit_states,
    "normalize_actuals": normalize_actuals,
    "first_disclosure": first_disclosure,
    "first_disclosure_conflicts": first_disclosure_conflicts,
    "residual_edge": residual_edge,
    "confirmation": confirmation,
    "coverage_audit": coverage_audit,
}

_TS = "coalesce(try_strptime(trim(CREATE_DATE), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(CREATE_DATE), '%Y/%m/%d %H:%M'))"
_CODE = r"""CASE WHEN regexp_extract(translate(STOCK_CODE, '０１２３４５６７８９', '0123456789'), '^\s*(?:[A-Za-z]{2}\.?)?(\d{1,6})(?:\.[A-Za-z0]{1,2})?\s*$', 1) <> ''
  THEN lpad(regexp_extract(translate(STOCK_CODE, '０１２３４５６７８９', '0123456789'), '^\s*(?:[A-Za-z]{2}\.?)?(\d{1,6})(?:\.[A-Za-z0]{1,2})?\s*$', 1), 6, '0') END"""
_TRIM = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"


def _i(c: str) -> str:
    return f"CAST(strftime({c}, '%Y%m%d') AS INT)"


_CAL = "cal AS (SELECT DISTINCT date AS d FROM calendar)"
_ALIGN = """CASE WHEN {ts} IS NULL THEN NULL
  WHEN CAST({ts} AS DATE) IN (SELECT d FROM cal) AND CAST({ts} AS TIME) <= TIME '14:57:00' THEN CAST({ts} AS DATE)
  ELSE (SELECT min(d) FROM cal WHERE d > CAST({ts} AS DATE)) END"""
_NORM = f"""
WITH {_CAL},
days AS (SELECT day, (SELECT min(d) FROM cal WHERE d > day) AS nxt, (SELECT min(d) FROM cal WHERE d >= day) AS onafter
  FROM (SELECT CAST(unnest(generate_series(DATE '2019-01-01', DATE '2027-12-31', INTERVAL 1 DAY)) AS DATE) AS day)),
n0 AS (SELECT {_CODE} AS stock_code, {_TRIM.format('ORGAN_NAME')} AS org_id, {_TRIM.format('AUTHOR_NAME')} AS author_name, {_TRIM.format('TITLE')} AS title,
  {_TRIM.format('CONTENT')} AS content, {_TS} AS ts, CAST(REPORT_YEAR AS INT) AS fy, FORECAST_NP * 10000.0 AS forecast, {_TRIM.format('ID')} AS source_id FROM raw_reports),
n1 AS (SELECT n0.*, CAST(ts AS DATE) AS publish_date,
  CASE WHEN days.onafter = days.day AND CAST(ts AS TIME) <= TIME '14:57:00' THEN days.day ELSE days.nxt END AS available_date
  FROM n0 LEFT JOIN days ON days.day = CAST(ts AS DATE)),
n2 AS (SELECT *, sha256(stock_code || '|' || org_id || '|' || author_name || '|' || CAST(epoch_us(ts) * 1000 AS VARCHAR) || '|' || title) AS report_id,
  CAST(fy - year(available_date) AS INT) AS forecast_horizon FROM n1
  WHERE regexp_full_match(stock_code, '[0-9]{{6}}') AND org_id <> '' AND available_date IS NOT NULL AND fy IS NOT NULL AND forecast IS NOT NULL),
rows_ AS (SELECT * FROM n2 WHERE forecast_horizon IN (0, 1, 2))"""
_FY = (
    _NORM
    + """,
f0 AS (SELECT report_id, fy, arg_min(struct_pack(s := stock_code, o := org_id, p := publish_date, a := available_date, h := forecast_horizon, f := forecast), row(ts, source_id, forecast)) AS b,
  min(forecast) AS lo, max(forecast) AS hi, count(*) AS n, count(DISTINCT forecast) AS nv FROM rows_ GROUP BY 1, 2),
fy_ AS (SELECT report_id, fy, b.s AS stock_code, b.o AS org_id, b.p AS publish_date, b.a AS available_date, b.h AS forecast_horizon, n, nv,
  CAST(greatest(abs(hi - b.f), abs(lo - b.f)) > 1e-6 + 1e-9 * abs(b.f) AS INT) AS forecast_conflict,
  CASE WHEN NOT greatest(abs(hi - b.f), abs(lo - b.f)) > 1e-6 + 1e-9 * abs(b.f) THEN b.f END AS forecast_new FROM f0),
daily AS (SELECT stock_code, fy, org_id, available_date, median(forecast_new) AS forecast, max(publish_date) AS publish_date
  FROM fy_ WHERE forecast_conflict = 0 AND forecast_new IS NOT NULL GROUP BY 1, 2, 3, 4)"""
)
_PRE = (
    _FY
    + f""",
ask AS (SELECT DISTINCT stock_code, fy, org_id, available_date FROM fy_),
lat AS (SELECT q.stock_code, q.fy, q.org_id, q.available_date, e.org_id AS peer, arg_max(struct_pack(p := e.publish_date, f := e.forecast), e.available_date) AS l
  FROM ask q JOIN daily e ON e.stock_code = q.stock_code AND e.fy = q.fy AND e.org_id <> q.org_id AND e.available_date < q.available_date
  GROUP BY 1, 2, 3, 4, 5),
con AS (SELECT stock_code, fy, org_id, available_date, median(l.f) AS consensus_pre, mad(l.f) AS mad_pre_abs, count(*) AS n_org_pre
  FROM lat WHERE date_diff('day', l.p, available_date) <= 180 GROUP BY 1, 2, 3, 4),
pre AS (SELECT f.*, consensus_pre, mad_pre_abs, CAST(coalesce(n_org_pre, 0) AS INT) AS n_org_pre,
  CAST(f.available_date - 180 >= DATE '{COVERAGE_START}' AS INT) AS history_window_complete,
  CASE WHEN forecast_conflict = 1 THEN 'conflicting_report_forecast' WHEN NOT f.available_date - 180 >= DATE '{COVERAGE_START}' THEN 'left_censored'
       WHEN coalesce(n_org_pre, 0) < 3 THEN 'insufficient_pre_peers' END AS pre_invalid_reason
  FROM fy_ f LEFT JOIN con USING (stock_code, fy, org_id, available_date))"""
)
_SCALE = (
    _PRE
    + """,
ref AS (SELECT date_trunc('month', available_date) AS m, forecast_horizon, abs(consensus_pre) AS a FROM pre WHERE pre_invalid_reason IS NULL AND consensus_pre IS NOT NULL),
want AS (SELECT DISTINCT date_trunc('month', available_date) AS month, forecast_horizon FROM pre),
same AS (SELECT w.month, w.forecast_horizon, median(a) AS ms, count(*) AS ns FROM want w JOIN ref r ON r.forecast_horizon = w.forecast_horizon
  AND r.m < w.month AND r.m >= w.month - INTERVAL 12 MONTH GROUP BY 1, 2),
pool AS (SELECT w.month, median(a) AS mp, count(*) AS np FROM (SELECT DISTINCT month FROM want) w JOIN ref r ON r.m < w.month AND r.m >= w.month - INTERVAL 12 MONTH GROUP BY 1),
floors AS (SELECT w.month, w.forecast_horizon, CASE WHEN ns >= 20 THEN 'same_horizon' WHEN np >= 20 THEN 'pooled' ELSE 'none' END AS scale_reference,
  CAST(CASE WHEN ns >= 20 THEN ns ELSE coalesce(np, 0) END AS BIGINT) AS scale_sample_count,
  CASE WHEN ns >= 20 THEN greatest(0.01 * ms, 1e-6) WHEN np >= 20 THEN greatest(0.01 * mp, 1e-6) END AS scale_floor
  FROM want w LEFT JOIN same USING (month, forecast_horizon) LEFT JOIN pool USING (month)),
sc0 AS (SELECT p.*, scale_floor, CASE WHEN consensus_pre IS NOT NULL AND scale_floor IS NOT NULL THEN greatest(abs(consensus_pre), scale_floor) END AS scale_t
  FROM pre p LEFT JOIN floors f ON f.month = date_trunc('month', p.available_date) AND f.forecast_horizon = p.forecast_horizon),
sc AS (SELECT *, 1.4826 * mad_pre_abs / scale_t AS dispersion_pre,
  CASE WHEN scale_floor IS NULL THEN NULL WHEN abs(consensus_pre) <= scale_floor THEN 'near_zero' WHEN consensus_pre > 0 THEN 'profit' WHEN consensus_pre < 0 THEN 'loss' END AS pre_state,
  coalesce(pre_invalid_reason, CASE WHEN scale_t IS NULL THEN 'insufficient_scale_history' END) AS pre_label_invalid_reason FROM sc0)"""
)
_ACT = """act AS (SELECT * FROM (SELECT stock_code, fy, actual_np * coalesce(unit_multiplier, 1.0) AS actual_np, coalesce(actual_publish_date, actual_known_date) AS actual_publish_date,
  least(actual_known_date, actual_publish_date) AS actual_known_date, source_id,
  row_number() OVER (PARTITION BY stock_code, fy ORDER BY coalesce(actual_publish_date, actual_known_date), source_id, actual_np * coalesce(unit_multiplier, 1.0)) AS rn
  FROM actuals WHERE coalesce(currency, 'CNY') = 'CNY' AND actual_np IS NOT NULL AND least(actual_known_date, actual_publish_date) IS NOT NULL) WHERE rn = 1)"""
_LAB = (
    _SCALE
    + ",\n"
    + _ACT
    + """,
l0 AS (SELECT s.*, a.actual_np, a.actual_known_date, coalesce(pre_label_invalid_reason, CASE WHEN a.actual_np IS NULL THEN 'actual_missing'
    WHEN s.available_date >= a.actual_known_date THEN 'report_not_before_actual_known_date' END) AS actual_invalid_reason
  FROM sc s LEFT JOIN act a ON a.stock_code = s.stock_code AND a.fy = s.fy),
lab AS (SELECT *, CAST(actual_invalid_reason IS NULL AS INT) AS residual_valid,
  CASE WHEN actual_invalid_reason IS NULL THEN (actual_np - forecast_new) / scale_t END AS residual_signed_raw,
  CASE WHEN actual_invalid_reason IS NULL THEN abs(actual_np - consensus_pre) / scale_t - abs(actual_np - forecast_new) / scale_t END AS edge,
  CASE WHEN actual_invalid_reason IS NULL THEN CAST(date_diff('day', available_date, actual_known_date) AS INT) END AS days_to_actual,
  CASE WHEN actual_invalid_reason IS NULL THEN pre_state || '_to_' || CASE WHEN abs(actual_np) <= scale_floor THEN 'near_zero' WHEN actual_np > 0 THEN 'profit' WHEN actual_np < 0 THEN 'loss' END END AS profit_transition
  FROM l0)"""
)
_CONF = (
    _LAB
    + f""",
rm AS (SELECT l.*, m AS confirmation_months, d.onafter AS target_date, row_number() OVER () AS rid FROM lab l CROSS JOIN (SELECT unnest([1, 3]) AS m)
  LEFT JOIN days d ON d.day = CAST(l.available_date + to_months(CAST(m AS INT)) AS DATE)),
ev AS (SELECT q.rid, q.available_date AS start, q.target_date AS target, e.org_id AS org,
   arg_max(struct_pack(a := e.available_date, p := e.publish_date, f := e.forecast), e.available_date) FILTER (WHERE e.available_date < q.available_date) AS pr0,
   arg_max(struct_pack(a := e.available_date, p := e.publish_date, f := e.forecast), e.available_date) FILTER (WHERE e.available_date <= q.target_date) AS la
   FROM rm q JOIN daily e ON e.stock_code = q.stock_code AND e.fy = q.fy AND e.org_id <> q.org_id GROUP BY 1, 2, 3, 4),
ev1 AS (SELECT *, CASE WHEN date_diff('day', pr0.p, start) <= 180 THEN pr0 END AS pr FROM ev),
ev2 AS (SELECT *, pr IS NOT NULL AND la.a > start AS upd, CASE WHEN la.a = start THEN pr ELSE la END AS mk0 FROM ev1),
ev3 AS (SELECT *, CASE WHEN date_diff('day', mk0.p, target) <= 180 THEN mk0 END AS mk FROM ev2),
pan AS (
  SELECT rid, 'fixed' AS peer_panel, pr.f AS b, CASE WHEN upd THEN la.f ELSE pr.f END AS a, 0 AS en, 0 AS ex, upd FROM ev3 WHERE pr IS NOT NULL
  UNION ALL SELECT rid, 'market', pr.f, mk.f, CAST(mk IS NOT NULL AND pr IS NULL AS INT), CAST(pr IS NOT NULL AND mk IS NULL AS INT), upd FROM ev3
  UNION ALL SELECT rid, 'active', pr.f, la.f, 0, 0, upd FROM ev3 WHERE upd),
ag AS (SELECT rid, peer_panel, count(b) AS n_pre, count(a) AS n_fut, sum(en) AS en, sum(ex) AS ex, median(b) AS cb, median(a) AS ca, mad(b) AS mb, mad(a) AS ma FROM pan GROUP BY 1, 2),
up AS (SELECT rid, count(*) FILTER (WHERE upd) AS n_up FROM ev3 GROUP BY 1),
c0 AS (SELECT r.*, p.peer_panel, coalesce(n_pre, 0) AS np_, coalesce(n_fut, 0) AS nf_, coalesce(en, 0) AS en_, coalesce(ex, 0) AS ex_, coalesce(n_up, 0) AS nu_, cb, ca, 1.4826 * mb / scale_t AS db, 1.4826 * ma / scale_t AS df_,
  CASE WHEN p.peer_panel = 'active' THEN 2 ELSE 3 END AS least_
  FROM rm r CROSS JOIN (SELECT unnest(['fixed', 'market', 'active']) AS peer_panel) p LEFT JOIN ag USING (rid, peer_panel) LEFT JOIN up USING (rid)),
c1 AS (SELECT *, CASE WHEN pre_label_invalid_reason IS NOT NULL THEN pre_label_invalid_reason
   WHEN target_date IS NULL OR target_date > DATE '{COVERAGE_END}' THEN 'right_censored' WHEN target_date >= actual_known_date THEN 'crosses_actual_disclosure'
   WHEN np_ < least_ OR nf_ < least_ THEN CASE WHEN peer_panel = 'active' THEN 'insufficient_active_peers' ELSE 'insufficient_future_peers' END
   WHEN abs(forecast_new - cb) <= greatest(0.01, 0.5 * db) * scale_t THEN 'report_inline_with_consensus' END AS invalid_reason FROM c0)"""
)
ORACLE = {
    "calendar_align": f"WITH {_CAL}, x AS (SELECT DISTINCT ID, CREATE_DATE, {_TS} AS ts FROM raw_reports), days AS (SELECT DISTINCT CAST(ts AS DATE) AS day, (SELECT min(d) FROM cal WHERE d > CAST(ts AS DATE)) AS nxt FROM x WHERE ts IS NOT NULL) "
    f"SELECT ID, CREATE_DATE, {_i('CASE WHEN cal.d IS NOT NULL AND CAST(ts AS TIME) <= TIME ' + chr(39) + '14:57:00' + chr(39) + ' THEN cal.d ELSE days.nxt END')} AS available_date FROM x LEFT JOIN days ON days.day = CAST(ts AS DATE) LEFT JOIN cal ON cal.d = CAST(ts AS DATE)",
    "next_trading_day": f"WITH {_CAL}, x AS (SELECT DISTINCT publish_date AS p FROM report_fy_labels) SELECT {_i('p')} AS publish_date, {_i('(SELECT min(d) FROM cal WHERE d >= p)')} AS on_or_after, "
    f"{_i('(SELECT min(d) FROM cal WHERE d >= CAST(p + INTERVAL 3 MONTH AS DATE))')} AS after_3m FROM x",
    "label_end_dates": f"WITH o AS (SELECT d, row_number() OVER (ORDER BY d) AS r FROM (SELECT DISTINCT date AS d FROM calendar)), x AS (SELECT DISTINCT available_date AS a FROM report_fy_labels) "
    f"SELECT {_i('a')} AS available_date, {_i('o2.d')} AS end_5d FROM x LEFT JOIN o o1 ON o1.d = a LEFT JOIN o o2 ON o2.r = o1.r + 5",
    "stock_code_norm": f"""SELECT STOCK_CODE, {_CODE} AS any_notation,
  CASE WHEN length(b) >= 6 THEN b ELSE lpad(b, 6, '0') END AS lenient, nullif(regexp_extract(upper(trim(STOCK_CODE)), '^([0-9]{{6}})(?:\\.(?:SH|SZ|BJ))?$', 1), '') AS strict
  FROM (SELECT DISTINCT STOCK_CODE, regexp_replace({_TRIM.format('STOCK_CODE')}, '\\..*$', '') AS b FROM raw_reports)""",
    "canonical_reports": _NORM
    + f""",
g AS (SELECT report_id, arg_min(struct_pack(s := stock_code, o := org_id, t := title, c := content, p := publish_date, a := available_date), row(-length(content), source_id)) AS b, count(DISTINCT source_id) AS n FROM rows_ GROUP BY 1)
SELECT report_id, b.s AS stock_code, b.o AS org_id, b.t AS title, CAST(CASE WHEN b.c <> '' THEN length(b.t || '。' || b.c) ELSE length(b.t) END AS INT) AS n_text,
  {_i('b.p')} AS publish_date, {_i('b.a')} AS available_date, CAST(n AS INT) AS n_sources FROM g""",
    "report_fy_summary": _FY + "SELECT report_id, fy, stock_code, forecast_horizon, round(forecast_new, 4) AS forecast_new, forecast_conflict, CAST(n AS INT) AS n_source_rows, CAST(nv AS INT) AS n_values FROM fy_",
    "org_daily": _FY + f"SELECT stock_code, fy, org_id, {_i('available_date')} AS available_date, round(forecast, 4) AS forecast, {_i('publish_date')} AS publish_date FROM daily",
    "pre_consensus": _PRE + "SELECT report_id, fy, round(consensus_pre, 4) AS consensus_pre, round(mad_pre_abs, 4) AS mad_pre_abs, n_org_pre, history_window_complete, pre_invalid_reason FROM pre",
    "scale_floor": _SCALE + f"SELECT {_i('month')} AS month, forecast_horizon, scale_reference, scale_sample_count, round(scale_floor, 4) AS scale_floor FROM floors",
    "profit_state": _SCALE + "SELECT report_id, fy, pre_state, round(scale_t, 4) AS scale_t, round(dispersion_pre, 6) AS dispersion_pre, CAST(pre_label_invalid_reason IS NULL AS INT) AS pre_label_valid, pre_label_invalid_reason FROM sc",
    "normalize_actuals": f"WITH {_ACT} SELECT stock_code, fy, actual_np, {_i('actual_publish_date')} AS actual_publish_date, {_i('actual_known_date')} AS actual_known_date, source_id FROM act",
    "first_disclosure": """WITH a AS (SELECT *, min(actual_known_date) OVER k AS fk, count(*) OVER k AS n_source FROM actuals WHERE actual_known_date IS NOT NULL WINDOW k AS (PARTITION BY stock_code, fy)),
g AS (SELECT stock_code, fy, n_source, arg_min(actual_np, row(coalesce(actual_publish_date, DATE '1900-01-01'), source_id, actual_np)) AS actual_np, min(actual_np) AS lo, max(actual_np) AS hi, count(*) AS n_first FROM a WHERE actual_known_date = fk GROUP BY 1, 2, 3)
SELECT stock_code, fy, actual_np, n_source, n_first, n_source - n_first AS later_revisions FROM g WHERE NOT hi - lo > 0.01 + 1e-10 * abs(actual_np)""",
    "first_disclosure_conflicts": """WITH a AS (SELECT *, min(actual_known_date) OVER (PARTITION BY stock_code, fy) AS fk FROM actuals WHERE actual_known_date IS NOT NULL),
g AS (SELECT stock_code, fy, max(actual_np) - min(actual_np) > 0.01 + 1e-10 * abs(arg_min(actual_np, row(coalesce(actual_publish_date, DATE '1900-01-01'), source_id, actual_np))) AS bad FROM a WHERE actual_known_date = fk GROUP BY 1, 2)
SELECT stock_code, fy, source_id, actual_np FROM a JOIN g USING (stock_code, fy) WHERE bad AND actual_known_date = fk""",
    "residual_edge": _LAB + "SELECT report_id, fy, residual_valid, actual_invalid_reason, round(residual_signed_raw, 6) AS residual_signed_raw, round(edge, 6) AS edge, days_to_actual, profit_transition FROM lab",
    "confirmation": _CONF
    + """SELECT report_id, fy, CAST(confirmation_months AS INT) AS confirmation_months, peer_panel, CAST(np_ AS INT) AS n_org_pre, CAST(nf_ AS INT) AS n_org_future, CAST(nu_ AS INT) AS n_peer_updates,
  CAST(en_ AS INT) AS n_org_entries, CAST(ex_ AS INT) AS n_org_exits, invalid_reason, round(CASE WHEN invalid_reason IS NULL THEN (ca - cb) / (forecast_new - cb) END, 5) + 0.0 AS progress,
  round(CASE WHEN invalid_reason IS NULL THEN ln((df_ + 1e-6) / (db + 1e-6)) END, 5) AS delta_log_dispersion,
  round(CASE WHEN invalid_reason IS NULL AND nu_ > 0 THEN sqrt(least(1, ln(1 + np_) / ln(11)) * least(1, ln(1 + nu_) / ln(4))) ELSE 0 END, 5) AS sample_weight,
  CAST(invalid_reason IS NULL AND (peer_panel = 'active' OR nu_ >= 2) AS INT) AS confirmation_probe_valid FROM c1""",
    "coverage_audit": _LAB
    + """, t AS (SELECT CAST(year(available_date) AS INT) AS report_year, forecast_horizon, CASE WHEN residual_valid = 1 THEN 'valid' ELSE 'invalid' END AS status, actual_invalid_reason AS reason FROM lab)
SELECT 'residual' AS label, report_year, forecast_horizon, status, reason, count(*) AS "count", CAST(sum(count(*)) OVER (PARTITION BY report_year, forecast_horizon) AS BIGINT) AS total_count,
  round(count(*) / sum(count(*)) OVER (PARTITION BY report_year, forecast_horizon), 8) AS rate FROM t GROUP BY 2, 3, 4, 5""",
}
