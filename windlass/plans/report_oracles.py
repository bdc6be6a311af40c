"""DuckDB oracles for the scenario report and the dashboard, generated from
the same figure / panel parameters as the Spark plans."""

from __future__ import annotations

from .report import CSV_NAMES, DECIMALS, REPORT_COLUMNS, TEST_PANELS, TEST_SOURCES, Source
from .ts_oracles import LOOKBACK, SAMPLES_CTE, rate_cte, resample_cte

_LABEL = {"pod": "pod", "phase": "phase", "topic": "'orders'"}


def _label(k: str) -> str:
    return _LABEL.get(k, "''")


def pred(src: Source, alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    conds = [f"{a}metric = '{src.metric}'"]
    for k, v in src.eq.items():
        conds.append(f"{a if k in ('pod', 'phase') else ''}{_label(k)} = '{v}'")
    for k, v in src.ne.items():
        conds.append(f"{a if k in ('pod', 'phase') else ''}{_label(k)} <> '{v}'")
    for k, v in src.regex.items():
        conds.append(f"regexp_full_match({a if k in ('pod', 'phase') else ''}{_label(k)}, '{v}')")
    return "(" + " AND ".join(conds) + ")"


def _first(sub: str, func: str) -> str:
    return (f"(SELECT v FROM (SELECT phase, pod, {func}(value) AS v FROM {sub} "
            f"GROUP BY phase, pod) ORDER BY phase, pod LIMIT 1)")


def _inst(src: Source) -> str:
    return (f"(SELECT phase, pod, arg_max(value, ts_ms) AS value FROM S, P "
            f"WHERE {pred(src, 'S')} AND ts_ms > at_ms - {LOOKBACK} AND ts_ms <= at_ms "
            f"GROUP BY phase, pod)")


def report_sql(label: str = "events-derived") -> str:
    src = TEST_SOURCES
    ctes = []
    res_names = {}

    def res(key):
        if key not in res_names:
            name = f"RS_{key}"
            res_names[key] = name
            ctes.append(resample_cte(name, pred=pred(src[key])))
        return res_names[key]

    figs = {}
    figs["base_throughput"] = _first(res("base_throughput"), "max")
    figs["peak_target"] = _first(res("current_throughput"), "max")
    figs["send_rate_peak"] = _first(res("send_rate"), "max")
    figs["send_rate_avg"] = _first(res("send_rate"), "avg")
    figs["messages_produced"] = f"(SELECT value FROM {_inst(src['messages_produced'])} ORDER BY phase, pod LIMIT 1)"
    figs["errors"] = f"(SELECT value FROM {_inst(src['errors'])} ORDER BY phase, pod LIMIT 1)"
    figs["error_rate_peak"] = _first(res("error_rate"), "max")
    figs["latency_avg_ms"] = _first(res("latency"), "avg")
    figs["latency_peak_ms"] = _first(res("latency"), "max")
    ctes.append(rate_cte("RT_in", pred(src["broker_inbound"], "S"), 60_000))
    figs["broker_inbound_peak"] = "(SELECT max(v) FROM (SELECT step, sum(value) AS v FROM RT_in GROUP BY step))"
    lag = res("consumer_lag")
    figs["consumer_lag_peak"] = f"(SELECT max(v) FROM (SELECT step, sum(value) AS v FROM {lag} GROUP BY step))"
    figs["consumer_lag_now"] = f"(SELECT sum(value) FROM {_inst(src['consumer_lag'])})"
    ctes.append(rate_cte("RT_rec", pred(src["records_in"], "S"), 30_000))
    figs["records_peak"] = "(SELECT max(v) FROM (SELECT step, sum(value) AS v FROM RT_rec GROUP BY step))"
    figs["records_avg"] = "(SELECT avg(v) FROM (SELECT step, sum(value) AS v FROM RT_rec GROUP BY step))"
    bp = res("backpressure")
    figs["backpressure_max_pct"] = f"(SELECT max(v) * 100.0::DOUBLE FROM (SELECT step, avg(value) AS v FROM {bp} GROUP BY step))"
    figs["backpressure_avg_pct"] = f"(SELECT avg(v) * 100.0::DOUBLE FROM (SELECT step, avg(value) AS v FROM {bp} GROUP BY step))"
    figs["checkpoint_max_ms"] = _first(res("checkpoint"), "max")
    figs["checkpoint_avg_ms"] = _first(res("checkpoint"), "avg")
    rd = res("ready")
    ready = (f"(SELECT GRID.step, coalesce(c, 0.0) AS v FROM GRID LEFT JOIN "
             f"(SELECT step, CAST(count(value) AS DOUBLE) AS c FROM {rd} WHERE value = 1 GROUP BY step) "
             f"USING (step))")
    figs["workers_min"] = f"(SELECT min(v) FROM {ready})"
    figs["workers_max"] = f"(SELECT max(v) FROM {ready})"
    figs["workers_now"] = f"(SELECT CAST(count(*) AS DOUBLE) FROM {_inst(src['ready'])} WHERE value = 1)"

    cols = []
    for c in REPORT_COLUMNS[3:]:
        cols.append(f"round_even(CAST({figs[c]} AS DOUBLE), {DECIMALS.get(c, 0)}) AS {c}")
    return ("WITH " + SAMPLES_CTE + "".join(ctes) + "\nSELECT "
            "strftime(epoch_ms((SELECT at_ms FROM P)), '%Y-%m-%d %H:%M:%S') || ' UTC' AS timestamp, "
            f"'{label}' AS label, CAST((SELECT range_ms FROM P) // 60000 AS INT) AS duration_min,\n  " + ",\n  ".join(cols))


def _full(a: str = "") -> str:
    """A test series' identity; the labels are pod, phase and topic."""
    return f"""'{{"phase":"' || {a}phase || '","pod":"' || {a}pod || '","topic":"orders"}}'"""


def _one(k: str) -> str:
    return f"""'{{"{k}":"' || {k} || '"}}'"""


def panels_sql() -> str:
    ctes, parts = [], []
    for i, p in enumerate(TEST_PANELS):
        r = f"PN{i}"
        scale = repr(float(p.scale))
        if p.kind in ("sum_rate", "rate_by_pod"):
            ctes.append(rate_cte(r, pred(p.source, "S"), p.window_ms))
        else:
            ctes.append(resample_cte(r, pred=pred(p.source)))
        if p.kind == "gauge":
            body = f"SELECT step, {_full()} AS series, pod AS legend, value FROM {r}"
        elif p.kind == "minus_time":
            body = f"SELECT step, {_full()} AS series, pod AS legend, value - CAST(step AS DOUBLE) * 1.0::DOUBLE AS value FROM {r}"
        elif p.kind == "diff":
            o = f"PO{i}"
            ctes.append(resample_cte(o, pred=pred(p.other)))
            body = (f"SELECT a.step, {_full('a.')} AS series, a.pod AS legend, a.value - b.value AS value FROM {r} a "
                    f"JOIN {o} b ON a.pod = b.pod AND a.phase = b.phase AND a.step = b.step")
        elif p.kind in ("sum_rate", "sum"):
            body = f"SELECT step, '{{}}' AS series, '' AS legend, sum(value) AS value FROM {r} GROUP BY step"
        elif p.kind in ("rate_by_pod", "sum_by_pod"):
            body = f"SELECT step, {_one('pod')} AS series, pod AS legend, sum(value) AS value FROM {r} GROUP BY step, pod"
        elif p.kind == "avg_pct":
            body = f"SELECT step, '{{}}' AS series, '' AS legend, avg(value) * 100.0::DOUBLE AS value FROM {r} GROUP BY step"
        elif p.kind == "count_by_phase":
            body = (f"SELECT step, {_one('phase')} AS series, phase AS legend, CAST(count(value) AS DOUBLE) AS value "
                    f"FROM {r} GROUP BY step, phase")
        elif p.kind == "ready":
            body = (f"SELECT GRID.step, '{{}}' AS series, '' AS legend, coalesce(c, 0.0) AS value FROM GRID LEFT JOIN "
                    f"(SELECT step, CAST(count(value) AS DOUBLE) AS c FROM {r} WHERE value = 1 "
                    f"GROUP BY step) USING (step)")
        else:
            raise ValueError(p.kind)
        parts.append(f"SELECT '{p.name}' AS panel, step, series, legend, "
                     f"round(value * {scale}::DOUBLE, 6) AS value FROM ({body})")
    return "WITH " + SAMPLES_CTE + "".join(ctes) + "\n" + "\nUNION ALL\n".join(parts)


def status_sql() -> str:
    """Last value, mean, band and text of each series of the panels."""
    def choose(column, pick):
        cases = [f"WHEN panel = '{p.name}' THEN {pick(p)}" for p in TEST_PANELS if getattr(p, column)]
        return "CASE " + " ".join(cases) + " END"
    band = lambda p: "CASE " + " ".join(
        f"WHEN last_value >= {lo}::DOUBLE THEN '{c}'" for lo, c in reversed(p.bands) if lo is not None) + \
        f" ELSE '{p.bands[0][1]}' END"
    text = lambda p: "CASE " + " ".join(
        f"WHEN last_value = {v}::DOUBLE THEN '{t}'" for v, t in p.mapping) + " END"
    means = ", ".join(f"'{p.name}'" for p in TEST_PANELS if "mean" in p.calcs)
    return f"""WITH V AS ({panels_sql()}),
L AS (SELECT panel, series, legend, arg_max(value, step) AS last_value, round(avg(value), 4) AS m
      FROM V WHERE value IS NOT NULL GROUP BY panel, series, legend)
SELECT panel, series, legend, last_value, CASE WHEN panel IN ({means}) THEN m END AS mean,
       {choose("bands", band)} AS status, {choose("mapping", text)} AS text FROM L"""


ORACLES = {
    "scenario_report": report_sql(),
    "report_csv_row": "WITH R AS (" + report_sql() + ") SELECT timestamp, label, CAST(duration_min AS VARCHAR) AS "
                      "duration_min, " + ", ".join(
                          f"""coalesce(printf('%.{DECIMALS.get(c, 0)}f', {c}), 'N/A') AS {CSV_NAMES.get(c, c)}"""
                          for c in REPORT_COLUMNS[3:]) + " FROM R",
    "dashboard_panels": panels_sql(),
    "panel_status": status_sql(),
}

ORACLES["report_csv_sink"] = ORACLES["report_csv_row"]
