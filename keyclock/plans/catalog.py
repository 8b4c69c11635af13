"""The registered queries and, for each that SQL can say, the same question in plain SQL over the same tables.

All of them replay whole tables. Queries on ``events`` use the key ``k`` and the arrivals of a scenario.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyclock.functions import assigners as A
from keyclock.functions.timeunits import MAX_WM, MIN_WM, floor_div
from keyclock.model import key_by
from keyclock.operators import counts, joins, multisource, rolling, sessions, watermark
from keyclock.operators import windows as W
from keyclock.operators.aggregates import Aggregate, aggregate_firings
from keyclock.operators.scan import Fold, running
from keyclock.plans import reports
from keyclock.plans.scenarios import HOUR, SCENARIOS, all_scenarios, arriving_events, replay
from keyclock.sources import logs
from keyclock.sources.replay import SideOutputs, declare, shared_folder, transform
from keyclock.strategy import WatermarkStrategy
from keyclock.streaming.process import KeyedProcessFunction, process_keyed
from keyclock.streaming.triggers import CONTINUE, FIRE, EventTimeTrigger, TriggeredWindows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

S = WatermarkStrategy
CLOCK = S.bounded(1000)


def cents():
    """Money as whole cents, so that sums do not depend on the order of addition."""
    return F.round(F.col("value") * 100).cast("bigint")


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


# --- SQL pieces -------------------------------------------------------------------------------------------------------

MIN_SQL = f"CAST({MIN_WM} AS BIGINT)"
_JITTER = f"(event_id * 40503 % 65537) * {HOUR} // 65537"
_DELAYED = {
    "ordered": "false",
    "global5": "event_id * 48271 % 65537 < 3277",
    "global50": "event_id * 48271 % 65537 < 32768",
    "median20": "k BETWEEN 8 AND 11",
    "median50": "k BETWEEN 5 AND 14",
    "random20": "k IN (1, 6, 13, 17)",
    "random50": "k IN (0, 1, 3, 6, 8, 11, 13, 14, 17, 18)",
}


def sql_rows(scenario: str = "median50") -> str:
    """CTE ``r``: events with k, t_ms, arrival."""
    return f"""base AS (SELECT *, user_id % 20 AS k, epoch_us(ts) // 1000 AS t_ms, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
r AS (SELECT *, t_ms + CASE WHEN {_DELAYED[scenario]} THEN {12 * HOUR} + {_JITTER} ELSE 0 END AS arrival FROM base)"""


def sql_clock(cand: str = "t_ms - 1001", part: str = "PARTITION BY k", scenario: str = "median50", src: str | None = None) -> str:
    """CTEs ``r`` and ``c``: rows with ``cand`` and the clock ``wm`` before them."""
    return f"""{src or sql_rows(scenario)},
c0 AS (SELECT *, {cand} AS cand FROM r),
c AS (SELECT *, max(cand) OVER ({part} ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM c0)"""


def sql_steps(keys: str = "k, ") -> str:
    return f"p AS (SELECT {keys}arrival AS \"at\", wm AS before, cand AS pwm FROM c WHERE cand IS NOT NULL AND (wm IS NULL OR cand > wm))"


def sql_windows(size: int, slide: int | None = None) -> str:
    """CTE ``w``: one row per (row, window)."""
    slide = slide or size
    return f"""w AS (SELECT c.*, t_ms - t_ms % {slide} - o.i * {slide} AS window_start, t_ms - t_ms % {slide} - o.i * {slide} + {size} AS window_end
FROM c, range(0, {-(-size // slide)}) o(i) WHERE t_ms - t_ms % {slide} - o.i * {slide} + {size} > t_ms)"""


def sql_firings(prefix: str, on: str = "g.k = p.k AND ", aggs: str = "count(*) AS elements", names: str = "elements", group: str = "k") -> str:
    return f"""WITH {prefix},
g AS (SELECT {group}, window_start, window_end, {aggs} FROM w WHERE wm IS NULL OR wm < window_end - 1 GROUP BY {group}, window_start, window_end),
f AS (SELECT g.*, coalesce(p.pwm, {MAX_WM}) AS wm, p.at AS fired_at FROM g ASOF LEFT JOIN p ON {on}g.window_end - 1 <= p.pwm)"""


def _firing_sql(cand="t_ms - 1001", scope="key", size=HOUR, slide=None, scenario="median50", aggs="count(*) AS elements", names="elements") -> str:
    part, keys, on = ("PARTITION BY k", "k, ", "g.k = p.k AND ") if scope == "key" else ("", "", "")
    prefix = ",\n".join([sql_clock(cand, part, scenario), sql_steps(keys), sql_windows(size, slide)])
    return sql_firings(prefix, on, aggs, names) + f"\nSELECT k, window_start, window_end, {names}, wm, fired_at FROM f"


def _fired(df, *names):
    return df.select("k", "window_start", "window_end", *(names or ("elements",)), "wm", "fired_at")


# --- firings ----------------------------------------------------------------------------------------------------------


@query(
    "keyed_window_firings",
    _firing_sql().replace(
        "SELECT k, window_start, window_end, elements, wm, fired_at FROM f",
        'SELECT window_start AS "W_S", wm AS "Watermark", k AS "W_K", window_end AS "W_E", elements AS "Elements" FROM f',
    ),
)
def keyed_window_firings(spark, sf_dir):
    fired = W.window_firings(replay(spark, sf_dir), CLOCK, A.tumbling(HOUR))
    return fired.select(
        F.col("window_start").alias("W_S"),
        F.col("wm").alias("Watermark"),
        F.col("k").alias("W_K"),
        F.col("window_end").alias("W_E"),
        F.col("elements").alias("Elements"),
    )


@query("stream_window_firings", _firing_sql(scope="stream"))
def stream_window_firings(spark, sf_dir):
    return _fired(W.window_firings(replay(spark, sf_dir), CLOCK.with_scope("stream"), A.tumbling(HOUR)))


@query("monotonous_firings", _firing_sql(cand="t_ms - 1"))
def monotonous_firings(spark, sf_dir):
    return _fired(W.window_firings(replay(spark, sf_dir), S.monotonous(), A.tumbling(HOUR)))


_BATCH = f"""WITH {sql_rows()}
SELECT k, t_ms - t_ms % {HOUR} AS window_start, t_ms - t_ms % {HOUR} + {HOUR} AS window_end, count(*) AS elements"""


@query("no_watermark_firings", _BATCH + f", {MAX_WM} AS wm FROM r GROUP BY 1, 2, 3")
def no_watermark_firings(spark, sf_dir):
    fired = W.window_firings(replay(spark, sf_dir), S.none(), A.tumbling(HOUR), lateness_ms=HOUR)
    return fired.select("k", "window_start", "window_end", "elements", "wm")


@query("batch_mode_windows", _BATCH + ", CAST(sum(cents) AS BIGINT) AS cents FROM r GROUP BY 1, 2, 3")
def batch_mode_windows(spark, sf_dir):
    return W.window_aggregate(replay(spark, sf_dir), A.tumbling(HOUR), F.count("*").alias("elements"), F.sum(cents()).alias("cents"))


@query("custom_generator_firings", _firing_sql(cand="CASE WHEN event_type = 'signup' THEN t_ms - 1 END"))
def custom_generator_firings(spark, sf_dir):
    marks = S.generator(F.when(F.col("event_type") == "signup", F.col("t_ms") - 1))
    return _fired(W.window_firings(replay(spark, sf_dir), marks, A.tumbling(HOUR)))


@query("timestamp_assigner_firings", _firing_sql().replace("epoch_us(ts) // 1000 AS t_ms", "epoch_us(ts) // 1000 - 1800000 AS t_ms"
       ).replace("t_ms + CASE", "t_ms + 1800000 + CASE"))
def timestamp_assigner_firings(spark, sf_dir):
    """The event time is an expression of the row (half an hour before the recorded time)."""
    early = CLOCK.with_timestamp(F.col("t_ms") - 1_800_000)
    return _fired(W.window_firings(replay(spark, sf_dir), early, A.tumbling(HOUR)))


_TICK = 6 * HOUR


def _tick_sql(scope="key", scenario="median50"):
    part, keys, on, pk = ("PARTITION BY k", "k, ", "g.k = p.k AND ", "a.k = b.k AND ") if scope == "key" else ("", "", "", "")
    group = "k, tick" if scope == "key" else "tick"
    return f"""WITH {sql_rows(scenario)},
r2 AS (SELECT *, arrival // {_TICK} AS tick FROM r),
tk AS (SELECT {group}, max(t_ms - 1001) AS cand FROM r2 GROUP BY {group}),
tw AS (SELECT *, max(cand) OVER ({part} ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM tk),
c AS (SELECT r2.*, tw.wm FROM r2 JOIN tw USING ({group})),
p AS (SELECT {keys}(tick + 1) * {_TICK} AS "at", wm AS before, cand AS pwm FROM tw WHERE wm IS NULL OR cand > wm)"""


@query(
    "tick_firings",
    sql_firings(_tick_sql()[5:] + ",\n" + sql_windows(HOUR)) + "\nSELECT k, window_start, window_end, elements, wm, fired_at FROM f",
)
def tick_firings(spark, sf_dir):
    return _fired(W.window_firings(replay(spark, sf_dir), CLOCK.every_tick(_TICK), A.tumbling(HOUR)))


@query(
    "tick_stream_firings",
    sql_firings(_tick_sql("stream")[5:] + ",\n" + sql_windows(HOUR), on="") + "\nSELECT k, window_start, window_end, elements, wm, fired_at FROM f",
)
def tick_stream_firings(spark, sf_dir):
    return _fired(W.window_firings(replay(spark, sf_dir), CLOCK.with_scope("stream").every_tick(_TICK), A.tumbling(HOUR)))


@query("sliding_firings", _firing_sql(size=6 * HOUR, slide=2 * HOUR, scenario="global50"))
def sliding_firings(spark, sf_dir):
    return _fired(W.window_firings(replay(spark, sf_dir, "global50"), CLOCK, A.sliding(6 * HOUR, 2 * HOUR)))


@query(
    "tumbling_aggregate",
    _firing_sql(
        aggs="count(*) AS elements, CAST(sum(cents) AS BIGINT) AS cents, min(cents) AS lowest, max(cents) AS highest",
        names="elements, cents, lowest, highest",
    ),
)
def tumbling_aggregate(spark, sf_dir):
    measures = [W.count(), W.total("cents", cents()), W.smallest("lowest", cents()), W.largest("highest", cents())]
    fired = W.window_firings(replay(spark, sf_dir), CLOCK, A.tumbling(HOUR), measures)
    return _fired(fired, "elements", "cents", "lowest", "highest")


@query(
    "custom_assigner_windows",
    sql_firings(
        ",\n".join(
            [
                sql_clock(),
                sql_steps(),
                f"""w AS (SELECT *, t_ms - t_ms % {24 * HOUR} AS window_start, t_ms - t_ms % {24 * HOUR} + {24 * HOUR} AS window_end FROM c
UNION ALL SELECT *, t_ms - t_ms % {5 * HOUR} AS window_start, t_ms - t_ms % {5 * HOUR} + {5 * HOUR} AS window_end FROM c WHERE event_type = 'click')""",
            ]
        )
    )
    + "\nSELECT k, window_start, window_end, elements, wm, fired_at FROM f",
)
def custom_assigner_windows(spark, sf_dir):
    """Every row in its day, clicks also in windows of five hours."""

    def span(ts, size):
        start = ts - F.pmod(ts, F.lit(size).cast("bigint"))
        return F.struct(start.alias("window_start"), (start + size).alias("window_end"))

    def assign(ts):
        day, short = span(ts, 24 * HOUR), span(ts, 5 * HOUR)
        return F.when(F.col("event_type") == "click", F.array(day, short)).otherwise(F.array(day))

    return _fired(W.window_firings(replay(spark, sf_dir), CLOCK, A.custom(assign)))


@query(
    "processing_time_windows",
    f"""WITH {sql_rows()}
SELECT k, arrival - arrival % {HOUR} AS window_start, arrival - arrival % {HOUR} + {HOUR} AS window_end, count(*) AS elements FROM r GROUP BY 1, 2, 3""",
)
def processing_time_windows(spark, sf_dir):
    return W.window_aggregate(replay(spark, sf_dir), A.processing_tumbling(HOUR), F.count("*").alias("elements"))


@query(
    "processing_time_sliding",
    f"""WITH {sql_rows()}
SELECT k, s AS window_start, s + {3 * HOUR} AS window_end, count(*) AS elements
FROM (SELECT k, arrival - arrival % {HOUR} - o.i * {HOUR} AS s FROM r, range(0, 3) o(i)) GROUP BY 1, 2, 3""",
)
def processing_time_sliding(spark, sf_dir):
    return W.window_aggregate(replay(spark, sf_dir), A.processing_sliding(3 * HOUR, HOUR), W.count())


@query(
    "global_window_agg",
    f"WITH {sql_rows()} SELECT k, count(*) AS elements, CAST(sum(cents) AS BIGINT) AS cents, max(t_ms) AS newest FROM r GROUP BY k",
)
def global_window_agg(spark, sf_dir):
    return W.global_window(replay(spark, sf_dir), F.count("*").alias("elements"), F.sum(cents()).alias("cents"), F.max("t_ms").alias("newest"))


@query(
    "nested_key_windows",
    f"""WITH {sql_rows()}
SELECT event_type AS who_kind, t_ms - t_ms % {HOUR} AS window_start, t_ms - t_ms % {HOUR} + {HOUR} AS window_end, count(*) AS elements FROM r GROUP BY 1, 2, 3""",
)
def nested_key_windows(spark, sf_dir):
    """Keyed by a path inside a struct."""
    df = arriving_events(spark, sf_dir).select("event_id", "t_ms", "arrival", F.struct(F.col("event_type").alias("kind"), "k").alias("who"))
    ks = key_by(df, "who.kind", ts="t_ms", arrival="arrival", tie="event_id")
    return W.window_aggregate(ks, A.tumbling(HOUR), F.count("*").alias("elements"))


# --- clocks -----------------------------------------------------------------------------------------------------------


@query(
    "assigned_watermarks",
    f"""WITH {sql_clock()}
SELECT event_id, k, coalesce(wm, {MIN_SQL}) AS wm_before, greatest(coalesce(wm, {MIN_SQL}), cand) AS wm_after FROM c""",
)
def assigned_watermarks(spark, sf_dir):
    return watermark.assign_watermarks(replay(spark, sf_dir), CLOCK).select("event_id", "k", "wm_before", "wm_after")


@query(
    "watermarks_assigned_again",
    f"""WITH {sql_clock("t_ms - 60001")}
SELECT event_id, k, coalesce(wm, {MIN_SQL}) AS wm_before, greatest(coalesce(wm, {MIN_SQL}), cand) AS wm_after FROM c""",
)
def watermarks_assigned_again(spark, sf_dir):
    """A second assignment starts anew: nothing of the first clock, which was ahead of it, is inherited."""
    ks = replay(spark, sf_dir)
    first = ks.with_df(watermark.assign_watermarks(ks, S.monotonous()))
    return watermark.assign_watermarks(first, S.bounded(60_000)).select("event_id", "k", "wm_before", "wm_after")


@query(
    "assigned_watermarks_stream",
    f"""WITH {sql_clock(part="")}
SELECT event_id, k, coalesce(wm, {MIN_SQL}) AS wm_before, greatest(coalesce(wm, {MIN_SQL}), cand) AS wm_after FROM c""",
)
def assigned_watermarks_stream(spark, sf_dir):
    rows = watermark.assign_watermarks(replay(spark, sf_dir), CLOCK.with_scope("stream"))
    return rows.select("event_id", "k", "wm_before", "wm_after")


@query(
    "assigned_watermarks_tick",
    _tick_sql() + f" SELECT event_id, k, coalesce(wm, {MIN_SQL}) AS wm_before FROM c",
)
def assigned_watermarks_tick(spark, sf_dir):
    rows = watermark.assign_watermarks(replay(spark, sf_dir), CLOCK.every_tick(_TICK))
    return rows.select("event_id", "k", "wm_before")


@query(
    "watermark_progress_keyed",
    f"WITH {sql_clock()}, {sql_steps()} SELECT k, \"at\" AS arrival, coalesce(before, {MIN_SQL}) AS wm_before, pwm AS wm FROM p",
)
def watermark_progress_keyed(spark, sf_dir):
    return watermark.watermark_progress(replay(spark, sf_dir), CLOCK)


@query("watermark_progress_tick", _tick_sql() + f" SELECT k, \"at\" AS arrival, coalesce(before, {MIN_SQL}) AS wm_before, pwm AS wm FROM p")
def watermark_progress_tick(spark, sf_dir):
    return watermark.watermark_progress(replay(spark, sf_dir), CLOCK.every_tick(_TICK))


@query("final_watermarks", f"WITH {sql_rows()} SELECT k, max(t_ms) - 1001 AS wm FROM r GROUP BY k")
def final_watermarks(spark, sf_dir):
    return watermark.final_watermarks(replay(spark, sf_dir), CLOCK)


_IDLE = 8 * HOUR
_IDLE_SQL = f"""WITH {sql_rows()},
n AS (SELECT k, arrival, lead(arrival) OVER (PARTITION BY k ORDER BY arrival, event_id) AS nxt FROM r),
i AS (SELECT k, arrival + {_IDLE} AS "at", 'idle' AS status FROM n WHERE nxt IS NULL OR nxt - arrival > {_IDLE}
UNION ALL SELECT k, nxt AS "at", 'active' AS status FROM n WHERE nxt - arrival > {_IDLE})"""


@query("idleness_events", _IDLE_SQL + ' SELECT k, "at", status FROM i')
def idleness_events(spark, sf_dir):
    return watermark.idleness_events(replay(spark, sf_dir), _IDLE)


@query(
    "status_log",
    _IDLE_SQL
    + f""",
c AS (SELECT *, t_ms - 1001 AS cand, max(t_ms - 1001) OVER (PARTITION BY k ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM r)
SELECT k, "at", status, CAST(NULL AS BIGINT) AS wm FROM i
UNION ALL SELECT k, arrival, 'watermark', cand FROM c WHERE wm IS NULL OR cand > wm""",
)
def status_log(spark, sf_dir):
    return watermark.status_log(replay(spark, sf_dir), CLOCK.with_idleness(_IDLE))


def _source_sql(scenario: str) -> str:
    return f"""WITH RECURSIVE {sql_rows(scenario)},
tk AS (SELECT event_id % 4 AS source, arrival // {HOUR} AS tick, max(t_ms - 1001) AS cand, max(arrival) AS la FROM r GROUP BY 1, 2),
span AS (SELECT min(tick) AS lo, max(tick) AS hi FROM tk),
ticks AS (SELECT unnest(range(lo, hi + 1)) AS tick, lo, hi FROM span),
grid AS (SELECT s.source, t.tick, t.lo, tk.cand, tk.la FROM ticks t JOIN (SELECT DISTINCT source FROM tk) s ON true
LEFT JOIN tk ON tk.source = s.source AND tk.tick = t.tick),
g AS (SELECT source, tick, lo, max(cand) OVER w AS wm, max(la) OVER w AS la FROM grid WINDOW w AS (PARTITION BY source ORDER BY tick))"""


@query(
    "watermark_progress_sources",
    _source_sql("median50")
    + f""",
m AS (SELECT tick, min(coalesce(wm, {MIN_SQL})) AS m FROM g GROUP BY tick),
o AS (SELECT *, max(m) OVER (ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)
SELECT tick, (tick + 1) * {HOUR} AS arrival, m AS wm FROM o WHERE m > coalesce(before, {MIN_SQL})""",
)
def watermark_progress_sources(spark, sf_dir):
    ks = replay(spark, sf_dir)
    ks = ks.with_df(ks.df.withColumn("source", F.col("event_id") % 4))
    return multisource.combine_sources(ks, CLOCK.every_tick(HOUR), "source")


_QUIET = 2 * HOUR


@query(
    "watermark_progress_idle_sources",
    _source_sql("median50")
    + f""",
st AS (SELECT tick, source, coalesce(wm, {MIN_SQL}) AS wm, (tick + 1) * {HOUR} - coalesce(la, lo * {HOUR}) > {_QUIET} AS idle FROM g),
pv AS (SELECT *, coalesce(lag(idle) OVER (PARTITION BY source ORDER BY tick), false) AS was FROM st),
ar AS (SELECT tick, coalesce(list(wm) FILTER (WHERE NOT idle), []) AS act, coalesce(list(wm) FILTER (WHERE NOT was), []) AS fresh, max(wm) AS top FROM pv GROUP BY tick),
f(tick, o) AS (SELECT min(tick) - 1, {MIN_SQL} FROM ar
UNION ALL SELECT ar.tick, greatest(f.o, CASE WHEN len(act) > 0 THEN coalesce(list_min(list_filter(act, lambda x: x >= f.o)), f.o)
WHEN list_contains(fresh, f.o) THEN top ELSE f.o END) FROM f JOIN ar ON ar.tick = f.tick + 1),
l AS (SELECT tick, o, lag(o) OVER (ORDER BY tick) AS before FROM f)
SELECT tick, (tick + 1) * {HOUR} AS arrival, o AS wm FROM l WHERE o > before""",
)
def watermark_progress_idle_sources(spark, sf_dir):
    ks = replay(spark, sf_dir)
    ks = ks.with_df(ks.df.withColumn("source", F.col("event_id") % 4))
    return multisource.combine_sources(ks, CLOCK.every_tick(HOUR).with_idleness(_QUIET), "source")


@query(
    "alignment_report",
    _source_sql("global5")
    + f""",
h AS (SELECT source, tick, wm FROM g WHERE wm IS NOT NULL),
m AS (SELECT tick, min(wm) AS group_wm FROM h GROUP BY tick)
SELECT 'sensors' AS "group", source, tick, wm, group_wm, wm - group_wm > {HOUR} AS paused FROM h JOIN m USING (tick)""",
)
def alignment_report(spark, sf_dir):
    ks = replay(spark, sf_dir, "global5")
    ks = ks.with_df(ks.df.withColumn("source", F.col("event_id") % 4))
    return multisource.alignment_report(ks, CLOCK.with_alignment("sensors", HOUR, HOUR), "source")


@query(
    "alignment_changes",
    _source_sql("global5")
    + f""",
h AS (SELECT source, tick, wm FROM g WHERE wm IS NOT NULL),
m AS (SELECT tick, min(wm) AS group_wm FROM h GROUP BY tick),
p AS (SELECT source, tick, wm, group_wm, wm - group_wm > {HOUR} AS paused FROM h JOIN m USING (tick)),
l AS (SELECT *, lag(paused) OVER (PARTITION BY source ORDER BY tick) AS was FROM p)
SELECT 'sensors' AS "group", source, tick, wm, group_wm, paused FROM l WHERE paused <> coalesce(was, false)""",
)
def alignment_changes(spark, sf_dir):
    """When a source that runs ahead is paused, and when it is let go."""
    ks = replay(spark, sf_dir, "global5")
    ks = ks.with_df(ks.df.withColumn("source", F.col("event_id") % 4))
    return multisource.alignment_changes(ks, CLOCK.with_alignment("sensors", HOUR, HOUR), "source")


# --- lateness ---------------------------------------------------------------------------------------------------------

_LATE = 2 * HOUR
_STATUS = f"""CASE WHEN wm IS NOT NULL AND wm >= window_end - 1 + {_LATE} THEN 'late'
WHEN wm IS NOT NULL AND wm >= window_end - 1 THEN 'allowed' ELSE 'on_time' END"""
_CLASSIFIED = ",\n".join(
    [sql_clock(scenario="global50"), sql_steps(), sql_windows(6 * HOUR, 2 * HOUR), f"x AS (SELECT *, {_STATUS} AS window_status FROM w)"]
)


def _late_case(spark, sf_dir):
    return replay(spark, sf_dir, "global50"), CLOCK, A.sliding(6 * HOUR, 2 * HOUR)


@query(
    "lateness_classes",
    f"""WITH {_CLASSIFIED}
SELECT event_id, k, window_start, window_end, window_status, coalesce(wm, {MIN_SQL}) AS wm_before,
bool_and(window_status = 'late') OVER (PARTITION BY event_id) AND coalesce(t_ms + {_LATE} <= wm, false) AS element_late FROM x""",
)
def lateness_classes(spark, sf_dir):
    rows = W.classify_lateness(*_late_case(spark, sf_dir), _LATE)
    return rows.select("event_id", "k", "window_start", "window_end", "window_status", "wm_before", "element_late")


_REFIRE = f"""WITH {_CLASSIFIED},
g AS (SELECT k, window_start, window_end, count(*) AS elements, CAST(sum(cents) AS BIGINT) AS cents FROM x WHERE window_status = 'on_time' GROUP BY 1, 2, 3),
f AS (SELECT g.*, coalesce(p.pwm, {MAX_WM}) AS wm, p.at AS fired_at FROM g ASOF LEFT JOIN p ON g.k = p.k AND g.window_end - 1 <= p.pwm),
a AS (SELECT x.k, x.window_start, x.window_end, x.wm, x.arrival, x.cents AS own, coalesce(g.elements, 0) AS base, coalesce(g.cents, 0) AS cbase,
row_number() OVER w AS rn, sum(x.cents) OVER w AS cs FROM x LEFT JOIN g ON x.k = g.k AND x.window_start = g.window_start AND x.window_end = g.window_end
WHERE window_status = 'allowed' WINDOW w AS (PARTITION BY x.k, x.window_start, x.window_end ORDER BY arrival, event_id))
SELECT k, window_start, window_end, 1 AS firing_no, elements, cents, wm, fired_at, window_end - 1 AS result_ts FROM f
UNION ALL SELECT k, window_start, window_end, rn + CASE WHEN base > 0 THEN 1 ELSE 0 END, """


@query("allowed_lateness_refirings", _REFIRE + "base + rn, CAST(cbase + cs AS BIGINT), wm, arrival, window_end - 1 FROM a")
def allowed_lateness_refirings(spark, sf_dir):
    measures = [W.count(), W.total("cents", cents())]
    return W.window_firings(*_late_case(spark, sf_dir), measures, lateness_ms=_LATE)


@query("purging_refirings", _REFIRE + "1, own, wm, arrival, window_end - 1 FROM a")
def purging_refirings(spark, sf_dir):
    measures = [W.count(), W.total("cents", cents())]
    return W.window_firings(*_late_case(spark, sf_dir), measures, lateness_ms=_LATE, purging=True)


_AVERAGED = f"""WITH {_CLASSIFIED},
z AS (SELECT *, row_number() OVER (PARTITION BY k, window_start, window_end, window_status ORDER BY arrival, event_id) AS rn FROM x WHERE window_status <> 'late'),
y AS (SELECT *, CASE WHEN window_status = 'allowed' THEN rn ELSE 0 END AS step FROM z),
v AS (SELECT DISTINCT k, window_start, window_end, step, CASE WHEN step > 0 THEN wm END AS wm, CASE WHEN step > 0 THEN arrival END AS at FROM y),
o AS (SELECT v.k, v.window_start, v.window_end, v.step, any_value(v.wm) AS own_wm, any_value(v.at) AS own_at, count(*) AS elements, avg(y.value) AS mean,
arg_min(y.event_id, (y.cents, y.event_id)) AS cheapest, arg_max(y.event_id, (y.cents, y.event_id)) AS dearest
FROM v JOIN y ON v.k = y.k AND v.window_start = y.window_start AND v.window_end = y.window_end AND y.step <= v.step GROUP BY 1, 2, 3, 4)
SELECT o.k, o.window_start, o.window_end, row_number() OVER (PARTITION BY o.k, o.window_start, o.window_end ORDER BY o.step) AS firing_no, elements,
round(mean, 6) AS mean, cheapest, dearest, CASE WHEN step > 0 THEN own_wm ELSE coalesce(p.pwm, {MAX_WM}) END AS wm, CASE WHEN step > 0 THEN own_at ELSE p.at END AS fired_at
FROM o ASOF LEFT JOIN p ON o.k = p.k AND o.window_end - 1 <= p.pwm"""


@query("averages_in_refirings", _AVERAGED)
def averages_in_refirings(spark, sf_dir):
    """Averages, and the rows of least and most money, continued by late rows."""
    measures = [
        W.count(),
        W.average("mean", F.col("value")),
        W.value_of_smallest("cheapest", F.col("event_id"), cents()),
        W.value_of_largest("dearest", F.col("event_id"), cents()),
    ]
    fired = W.window_firings(*_late_case(spark, sf_dir), measures, lateness_ms=_LATE)
    return fired.withColumn("mean", F.round("mean", 6)).drop("result_ts")


_ELEMENT_LATE = f"t_ms - t_ms % {HOUR} + {HOUR} - 1 + {_LATE} <= wm"


@query("late_rows", f"WITH {sql_clock(scenario='global50')} SELECT event_id, k, t_ms, wm AS wm_before FROM c WHERE {_ELEMENT_LATE}")
def late_rows(spark, sf_dir):
    late = W.late_rows(replay(spark, sf_dir, "global50"), CLOCK, A.tumbling(HOUR), _LATE)
    return late.select("event_id", "k", "t_ms", "wm_before")


@query(
    "late_rows_with_gaps",
    f"""WITH {sql_clock(scenario='global50')}
SELECT event_id, k FROM c WHERE coalesce(t_ms <= wm, false) AND (t_ms % {3 * HOUR} >= {HOUR} OR t_ms - t_ms % {3 * HOUR} + {HOUR} - 1 <= wm)""",
)
def late_rows_with_gaps(spark, sf_dir):
    """Windows of one hour every three hours: a row between windows is late once its own time has passed."""
    return W.late_rows(replay(spark, sf_dir, "global50"), CLOCK, A.sliding(HOUR, 3 * HOUR)).select("event_id", "k")


@query(
    "late_counts",
    f"""WITH {sql_clock(scenario='global50')}
SELECT k, count(*) AS total, count(*) FILTER (WHERE {_ELEMENT_LATE}) AS late, count(*) - count(*) FILTER (WHERE {_ELEMENT_LATE}) AS kept FROM c GROUP BY k""",
)
def late_counts(spark, sf_dir):
    return W.late_counts(replay(spark, sf_dir, "global50"), CLOCK, A.tumbling(HOUR), _LATE)


# --- counts and sessions ----------------------------------------------------------------------------------------------

_NUMBERED = f"WITH {sql_rows()}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY arrival, event_id) AS n FROM r)"


@query(
    "count_tumbling",
    _NUMBERED + " SELECT k, (n - 1) // 10 AS window_no, count(*) AS elements, CAST(sum(cents) AS BIGINT) AS cents FROM n GROUP BY 1, 2 HAVING count(*) = 10",
)
def count_tumbling(spark, sf_dir):
    return counts.count_windows(replay(spark, sf_dir), 10, F.sum(cents()).alias("cents"))


@query(
    "count_sliding",
    _NUMBERED
    + """, s AS (SELECT k, n, count(*) OVER w AS elements, sum(cents) OVER w AS cents FROM n WINDOW w AS (PARTITION BY k ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT k, n // 4 - 1 AS window_no, elements, CAST(cents AS BIGINT) AS cents FROM s WHERE n % 4 = 0""",
)
def count_sliding(spark, sf_dir):
    return counts.sliding_count_windows(replay(spark, sf_dir), 10, 4, W.total("cents", cents()))


_TRIGGERED = f"""WITH {sql_clock()}, {sql_windows(24 * HOUR)},
a AS (SELECT k, window_start, window_end, cents, row_number() OVER v AS n, sum(cents) OVER v AS so_far FROM w WHERE wm IS NULL OR wm < window_end - 1
WINDOW v AS (PARTITION BY k, window_start ORDER BY arrival, event_id))"""


@query(
    "count_trigger",
    _TRIGGERED + " SELECT k, window_start, window_end, n // 5 AS firing_no, n AS elements, CAST(so_far AS BIGINT) AS cents FROM a WHERE n % 5 = 0",
)
def count_trigger(spark, sf_dir):
    measures = [W.count(), W.total("cents", cents())]
    return counts.count_triggered(replay(spark, sf_dir), CLOCK, A.tumbling(24 * HOUR), 5, measures)


@query(
    "count_trigger_purging",
    _TRIGGERED
    + """ SELECT k, window_start, window_end, (n - 1) // 5 + 1 AS firing_no, count(*) AS elements, CAST(sum(cents) AS BIGINT) AS cents
FROM a GROUP BY 1, 2, 3, 4 HAVING count(*) = 5""",
)
def count_trigger_purging(spark, sf_dir):
    measures = [W.count(), W.total("cents", cents())]
    return counts.count_triggered(replay(spark, sf_dir), CLOCK, A.tumbling(24 * HOUR), 5, measures, purging=True)


_GAP = HOUR


@query(
    "session_batch",
    f"""WITH {sql_rows()},
a AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER v <= {_GAP} THEN 0 ELSE 1 END AS opens FROM r WINDOW v AS (PARTITION BY k ORDER BY t_ms, event_id)),
b AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY t_ms, event_id) AS sid FROM a)
SELECT k, min(t_ms) AS window_start, max(t_ms) + {_GAP} AS window_end, count(*) AS elements, CAST(sum(cents) AS BIGINT) AS cents FROM b GROUP BY k, sid""",
)
def session_batch(spark, sf_dir):
    return sessions.sessions(replay(spark, sf_dir), _GAP, [W.count(), W.total("cents", cents())])


#: (cents, id) as one number
_PAIR = 1_000_000_000_000


def _sql_sessions(late: int, bound: int = 1000) -> str:
    """CTE ``s``: a row per step of every key, with the live sessions after it (``live``: from, to, n, cents, least (cents, id), fired) and
    what the step let out (``fired``: sessions the clock passed, ``again``: a session fired once more, ``refused``). A last step without a
    row ends each key."""
    touching = "[x for x in lv if x.a <= t + {g} AND x.z >= t]".format(g=_GAP)
    kind = "STRUCT(a BIGINT, z BIGINT, n BIGINT, s BIGINT, lo BIGINT, f BOOLEAN)"
    return f"""{sql_rows("global50")},
q AS (SELECT k, t_ms AS t, event_id AS id, cents AS c, row_number() OVER o AS n, max(t_ms - {bound + 1}) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm
FROM r WINDOW o AS (PARTITION BY k ORDER BY arrival, event_id)
UNION ALL SELECT k, NULL, NULL, NULL, count(*) + 1, max(t_ms) - {bound + 1} FROM r GROUP BY k),
s(k, n, id, wm, live, fired, again, refused) AS (
SELECT DISTINCT k, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS {kind}[]),
CAST([] AS {kind}[]), CAST(NULL AS {kind}), false FROM r
UNION ALL
SELECT k, n, id, wm, CASE WHEN t IS NULL OR refused THEN lv ELSE list_append([x for x in lv if NOT (x.a <= t + {_GAP} AND x.z >= t)], m) END,
fired, CASE WHEN t IS NOT NULL AND NOT refused AND m.f AND wm >= m.z - 1 THEN m END, t IS NOT NULL AND refused
FROM (SELECT *, coalesce(wm >= m0.z - 1 + {late}, false) AS refused,
{{'a': m0.a, 'z': m0.z, 'n': m0.n, 's': m0.s, 'lo': m0.lo, 'f': coalesce(wm >= m0.z - 1, false) OR m0.f}} AS m
FROM (SELECT *, {{'a': least(t, list_min([x.a for x in tc])), 'z': greatest(t + {_GAP}, list_max([x.z for x in tc])), 'n': 1 + CAST(coalesce(list_sum([x.n for x in tc]), 0) AS BIGINT),
's': c + CAST(coalesce(list_sum([x.s for x in tc]), 0) AS BIGINT), 'lo': least(c * {_PAIR} + id, list_min([x.lo for x in tc])),
'f': len(tc) = 1 AND coalesce(tc[1].f AND tc[1].a <= t AND tc[1].z >= t + {_GAP}, false)}} AS m0
FROM (SELECT *, {touching} AS tc
FROM (SELECT q.k, q.n, q.t, q.id, q.c, q.wm, [x for x in s.live if NOT x.f AND coalesce(q.wm >= x.z - 1, false)] AS fired,
[{{'a': x.a, 'z': x.z, 'n': x.n, 's': x.s, 'lo': x.lo, 'f': x.f OR coalesce(q.wm >= x.z - 1, false)}} for x in s.live if NOT coalesce(q.wm >= x.z - 1 + {late}, false)] AS lv
FROM s JOIN q ON q.k = s.k AND q.n = s.n + 1)))))"""


_SESSION_ROWS = f"""WITH RECURSIVE {_sql_sessions(HOUR)},
o AS (SELECT k, wm, false AS refired, unnest(fired) AS x FROM s
UNION ALL SELECT k, wm, true, again FROM s WHERE again IS NOT NULL
UNION ALL SELECT k, {MAX_WM}, false, unnest([x for x in live if NOT x.f]) FROM (SELECT *, max(n) OVER (PARTITION BY k) AS last FROM s) WHERE n = last)"""


@query("session_keyed", _SESSION_ROWS + " SELECT k, x.a AS window_start, x.z AS window_end, x.n AS elements, CAST(wm AS BIGINT) AS wm, refired FROM o")
def session_keyed(spark, sf_dir):
    return sessions.session_firings(replay(spark, sf_dir, "global50"), CLOCK, _GAP, lateness_ms=HOUR)


@query("session_keyed_late", f"WITH RECURSIVE {_sql_sessions(HOUR)} SELECT k, id AS tie FROM s WHERE refused")
def session_keyed_late(spark, sf_dir):
    return sessions.session_firings(replay(spark, sf_dir, "global50"), CLOCK, _GAP, lateness_ms=HOUR, late=True)


@query(
    "session_measures",
    _SESSION_ROWS
    + f""" SELECT k, x.a AS window_start, x.z AS window_end, x.n AS elements, x.s AS cents, round(x.s / x.n, 6) AS mean,
(x.lo % {_PAIR} + {_PAIR}) % {_PAIR} AS cheapest, CAST(wm AS BIGINT) AS wm, refired FROM o""",
)
def session_measures(spark, sf_dir):
    """Sums, averages and the rows of least money in sessions against a clock: bridged sessions put them together."""
    measures = [W.count(), W.total("cents", cents()), W.average("mean", cents()), W.value_of_smallest("cheapest", F.col("event_id"), cents())]
    fired = sessions.session_firings(replay(spark, sf_dir, "global50"), CLOCK, _GAP, HOUR, measures=measures)
    return fired.withColumn("mean", F.round("mean", 6))


# --- user code --------------------------------------------------------------------------------------------------------

_PANE_SQL = ",\n".join([sql_clock(), sql_steps(), sql_windows(6 * HOUR)])


@query(
    "window_process_elements",
    sql_firings(_PANE_SQL)
    + """ SELECT w.k, w.window_start, w.window_end, row_number() OVER (PARTITION BY w.k, w.window_start ORDER BY arrival, event_id) AS position, event_id, f.elements, f.wm, f.fired_at
FROM w JOIN f ON w.k = f.k AND w.window_start = f.window_start WHERE w.wm IS NULL OR w.wm < w.window_end - 1""",
)
def window_process_elements(spark, sf_dir):
    """What a window function sees: all elements of the pane, in order, with the clock that fired it."""
    ks = replay(spark, sf_dir)
    ks = ks.with_df(ks.df.select("k", "t_ms", "arrival", "event_id"))
    rows = W.pane_rows(ks, CLOCK, A.tumbling(6 * HOUR))
    return rows.select("k", "window_start", "window_end", "position", "event_id", "elements", "wm", "fired_at")


def _swing(window, rows):
    last, moved = None, 0
    for r in rows:
        moved += 0 if last is None else abs(r["cents"] - last)
        last = r["cents"]
    yield {"k": window["k"], "result_ts": window["window_end"] - 1, "swing": moved}


@query(
    "window_process_function",
    sql_firings(_PANE_SQL)
    + """, d AS (SELECT k, window_end, abs(cents - lag(cents) OVER (PARTITION BY k, window_start ORDER BY arrival, event_id)) AS step FROM w WHERE wm IS NULL OR wm < window_end - 1)
SELECT k, window_end - 1 AS result_ts, CAST(coalesce(sum(step), 0) AS BIGINT) AS swing FROM d GROUP BY k, window_end""",
)
def window_process_function(spark, sf_dir):
    """User code per window: how far the value moved from element to element."""
    ks = _cents(replay(spark, sf_dir))
    ks = ks.with_df(ks.df.select("k", "t_ms", "arrival", "event_id", "cents"))
    shape = T.StructType([T.StructField(n, T.LongType()) for n in ("k", "result_ts", "swing")])
    return W.window_process(ks, CLOCK, A.tumbling(6 * HOUR), _swing, shape)


class Scatter(Aggregate):
    """How many, and how far they lie apart: count times the sum of squares less the square of the sum, in whole numbers."""

    def __init__(self):
        long = T.LongType()
        super().__init__(
            T.StructType([T.StructField(n, long) for n in ("n", "total", "squares")]),
            T.StructType([T.StructField(n, long) for n in ("elements", "scatter")]),
        )

    def add(self, acc, row):
        c, acc = row["cents"], acc or {"n": 0, "total": 0, "squares": 0}
        return {"n": acc["n"] + 1, "total": acc["total"] + c, "squares": acc["squares"] + c * c}

    def merge(self, a, b):
        return {n: a[n] + b[n] for n in a}

    def result(self, acc):
        return {"elements": acc["n"], "scatter": acc["n"] * acc["squares"] - acc["total"] ** 2}


_SCATTER = "CAST(count(*) * sum(cents * cents) - sum(cents) * sum(cents) AS BIGINT) AS scatter"


def _scatter_rows(spark, sf_dir):
    ks = _cents(replay(spark, sf_dir, "global50"))
    return ks.with_df(ks.df.select("k", "t_ms", "arrival", "event_id", "cents"))


@query(
    "own_merge_firings",
    _firing_sql(size=6 * HOUR, slide=2 * HOUR, scenario="global50", aggs=f"count(*) AS elements, {_SCATTER}", names="elements, scatter"),
)
def own_merge_firings(spark, sf_dir):
    """An aggregate written by the user, merged by a function of its own, in windows that overlap."""
    fired = aggregate_firings(_scatter_rows(spark, sf_dir), CLOCK, A.sliding(6 * HOUR, 2 * HOUR), Scatter())
    return _fired(fired, "elements", "scatter")


@query(
    "own_merge_refirings",
    _AVERAGED[: _AVERAGED.index("o AS (")]
    + f"""o AS (SELECT v.k, v.window_start, v.window_end, v.step, any_value(v.wm) AS own_wm, any_value(v.at) AS own_at, count(*) AS elements, {_SCATTER.replace("cents", "y.cents")}
FROM v JOIN y ON v.k = y.k AND v.window_start = y.window_start AND v.window_end = y.window_end AND y.step <= v.step GROUP BY 1, 2, 3, 4)
SELECT o.k, o.window_start, o.window_end, row_number() OVER (PARTITION BY o.k, o.window_start, o.window_end ORDER BY o.step) AS firing_no, elements, scatter,
CASE WHEN step > 0 THEN own_wm ELSE coalesce(p.pwm, {MAX_WM}) END AS wm, CASE WHEN step > 0 THEN own_at ELSE p.at END AS fired_at
FROM o ASOF LEFT JOIN p ON o.k = p.k AND o.window_end - 1 <= p.pwm""",
)
def own_merge_refirings(spark, sf_dir):
    """The same, continued by late rows."""
    _, clock, assigner = _late_case(spark, sf_dir)
    return aggregate_firings(_scatter_rows(spark, sf_dir), clock, assigner, Scatter(), _LATE).drop("result_ts")


class DayReport(KeyedProcessFunction):
    """A timer at the end of every row's day; when the user's clock gets there, report the rows seen so far."""

    def process(self, row, ctx):
        ctx.state["seen"] = ctx.state.get("seen", 0) + 1
        ctx.register_event_timer(row["t_ms"] - row["t_ms"] % (24 * HOUR) + 24 * HOUR)

    def on_timer(self, timestamp, ctx):
        ctx.output(user_id=ctx.key[0], day_end=timestamp, seen=ctx.state["seen"], wm=ctx.current_watermark)


@query(
    "process_function",
    f"""WITH {sql_clock(part="PARTITION BY user_id", scenario="global50")},
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arrival, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total,
t_ms - t_ms % {24 * HOUR} + {24 * HOUR} AS day_end FROM c),
p AS (SELECT user_id, n AS hit, cand AS pwm FROM n WHERE wm IS NULL OR cand > wm),
punctual AS (SELECT n.user_id, n.day_end, p.hit, p.pwm FROM n ASOF LEFT JOIN p ON n.user_id = p.user_id AND n.day_end <= p.pwm WHERE n.wm IS NULL OR n.wm < n.day_end),
overdue AS (SELECT n.user_id, n.day_end, p.hit, p.pwm FROM n ASOF LEFT JOIN p ON n.user_id = p.user_id AND n.n <= p.hit WHERE n.wm >= n.day_end),
f AS (SELECT DISTINCT * FROM (SELECT * FROM punctual UNION ALL SELECT * FROM overdue))
SELECT f.user_id, f.day_end, coalesce(f.hit, t.total) AS seen, coalesce(f.pwm, {MAX_WM}) AS wm FROM f JOIN (SELECT DISTINCT user_id, total FROM n) t USING (user_id)""",
)
def process_function(spark, sf_dir):
    """State and timers per user, driven by the user's own clock."""
    ks = replay(spark, sf_dir, "global50", "user_id")
    ks = ks.with_df(ks.df.select("user_id", "t_ms", "arrival", "event_id"))
    shape = T.StructType([T.StructField(n, T.LongType()) for n in ("user_id", "day_end", "seen", "wm")])
    return process_keyed(ks, CLOCK, DayReport(), shape).drop("tag")


class EarlyOnPurchase(EventTimeTrigger):
    """An early look at the window with every purchase, and the usual firing at its end."""

    def on_element(self, row, ctx):
        return FIRE if super().on_element(row, ctx) == FIRE or row["event_type"] == "purchase" else CONTINUE


def _day(ts):
    return [(ts - ts % (24 * HOUR), ts - ts % (24 * HOUR) + 24 * HOUR)]


def _count_up(acc, row):
    return (acc or 0) + 1


def _day_result(acc, ctx):
    return {"user_id": ctx.key[0], "window_start": ctx.window[0], "elements": acc, "wm": ctx.current_watermark}


@query(
    "user_trigger_windows",
    f"""WITH {sql_clock(part="PARTITION BY user_id", scenario="global50")}, {sql_steps("user_id, ")}, {sql_windows(24 * HOUR)},
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY arrival, event_id) AS n FROM w WHERE wm IS NULL OR wm < window_end - 1),
g AS (SELECT user_id, window_start, window_end, count(*) AS elements FROM a GROUP BY 1, 2, 3)
SELECT user_id, window_start, n AS elements, coalesce(wm, {MIN_SQL}) AS wm FROM a WHERE event_type = 'purchase'
UNION ALL SELECT g.user_id, window_start, elements, coalesce(p.pwm, {MAX_WM}) FROM g ASOF LEFT JOIN p ON g.user_id = p.user_id AND g.window_end - 1 <= p.pwm""",
)
def user_trigger_windows(spark, sf_dir):
    """A trigger written by the user, over daily windows per user."""
    ks = replay(spark, sf_dir, "global50", "user_id")
    ks = ks.with_df(ks.df.select("user_id", "t_ms", "arrival", "event_id", "event_type"))
    shape = T.StructType([T.StructField(n, T.LongType()) for n in ("user_id", "window_start", "elements", "wm")])
    return process_keyed(ks, CLOCK, TriggeredWindows(_day, EarlyOnPurchase(), _count_up, _day_result, "t_ms"), shape).drop("tag")


class LatestClick:
    """A clock of one's own that speaks at the end of a tick: just before the latest click so far."""

    def __init__(self):
        self.top = None

    def on_event(self, row, key, ts, out):
        if row["event_type"] == "click":
            self.top = ts if self.top is None else max(self.top, ts)

    def on_periodic_emit(self, out):
        if self.top is not None:
            out.emit(self.top - 1)


@query(
    "generator_class_ticks",
    sql_firings(_tick_sql()[5:].replace("max(t_ms - 1001) AS cand", "max(CASE WHEN event_type = 'click' THEN t_ms - 1 END) AS cand").replace(
        "WHERE wm IS NULL OR cand > wm", "WHERE cand IS NOT NULL AND (wm IS NULL OR cand > wm)") + ",\n" + sql_windows(HOUR))
    + "\nSELECT k, window_start, window_end, elements, wm, fired_at FROM f",
)
def generator_class_ticks(spark, sf_dir):
    """A generator class whose periodic callback runs once a tick."""
    ks = replay(spark, sf_dir)
    ks = ks.with_df(ks.df.select("k", "t_ms", "arrival", "event_id", "event_type"))
    return _fired(W.window_firings(ks, S.generator(LatestClick).every_tick(_TICK), A.tumbling(HOUR)))


class EveryTenth:
    """A clock of one's own: after every tenth row of a key, the largest time so far."""

    def __init__(self):
        self.rows, self.top = 0, None

    def on_event(self, row, key, ts, out):
        self.rows += 1
        self.top = ts if self.top is None else max(self.top, ts)

    def on_periodic_emit(self, out):
        if self.rows % 10 == 0:
            out.emit(self.top)


@query(
    "generator_class_firings",
    sql_firings(
        ",\n".join(
            [
                sql_rows(),
                """n AS (SELECT *, row_number() OVER v AS n, max(t_ms) OVER v AS top FROM r WINDOW v AS (PARTITION BY user_id ORDER BY arrival, event_id)),
c0 AS (SELECT *, CASE WHEN n % 10 = 0 THEN top END AS cand FROM n),
c AS (SELECT *, max(cand) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM c0)""",
                sql_steps("user_id, "),
                sql_windows(24 * HOUR),
            ]
        ),
        on="g.user_id = p.user_id AND ",
        group="user_id",
    )
    + " SELECT user_id, window_start, window_end, elements, wm, fired_at FROM f",
)
def generator_class_firings(spark, sf_dir):
    """Windows under a clock written in Python."""
    ks = replay(spark, sf_dir, "median50", "user_id")
    ks = ks.with_df(ks.df.select("user_id", "t_ms", "arrival", "event_id"))
    fired = W.window_firings(ks, S.generator(EveryTenth), A.tumbling(24 * HOUR))
    return fired.select("user_id", "window_start", "window_end", "elements", "wm", "fired_at")


# --- rolling ----------------------------------------------------------------------------------------------------------

_SO_FAR = "(PARTITION BY k ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _cents(ks):
    return ks.with_df(ks.df.withColumn("cents", cents()))


for _kind in ("sum", "min", "max"):
    QUERIES[f"rolling_{_kind}"] = lambda spark, sf_dir, kind=_kind: rolling.rolling(_cents(replay(spark, sf_dir)), kind, "cents")
    ORACLE[f"rolling_{_kind}"] = (
        f"WITH {sql_rows()} SELECT k, arrival, event_id, cents, CAST({_kind}(cents) OVER {_SO_FAR} AS BIGINT) AS running FROM r"
    )
    if _kind == "sum":
        continue
    for _tie in ("first", "last"):
        QUERIES[f"rolling_{_kind}_by_{_tie}"] = lambda spark, sf_dir, kind=_kind, tie=_tie: _rolling_by(spark, sf_dir, kind, tie)
        ORACLE[f"rolling_{_kind}_by_{_tie}"] = f"""WITH {sql_rows()}, q AS (SELECT *, cents // 500 AS price, row_number() OVER (PARTITION BY k ORDER BY arrival, event_id) AS rn FROM r),
b AS (SELECT *, {_kind}(price) OVER {_SO_FAR} AS best FROM q),
h AS (SELECT *, {'lag(best)' if _tie == 'first' else 'CAST(NULL AS BIGINT)'} {'OVER (PARTITION BY k ORDER BY rn)' if _tie == 'first' else ''} AS old FROM b),
m AS (SELECT *, CASE WHEN price = best AND (old IS NULL OR old <> best) THEN rn END AS hit FROM h),
z AS (SELECT *, max(hit) OVER {_SO_FAR} AS at FROM m)
SELECT z.k, z.arrival, z.event_id, q.event_id AS best_id, q.price AS best_price FROM z JOIN q ON q.k = z.k AND q.rn = z.at"""


def _rolling_by(spark, sf_dir, kind, tie):
    ks = _cents(replay(spark, sf_dir))
    ks = ks.with_df(ks.df.withColumn("price", floor_div("cents", 500)))
    best = rolling.rolling_by(ks, kind, "price", tie, ["event_id", "price"])
    return best.select("k", "arrival", "event_id", F.col("best.event_id").alias("best_id"), F.col("best.price").alias("best_price"))


@query(
    "rolling_reduce",
    f"""WITH {sql_rows()} SELECT k, event_id, CAST(sum(cents * cents) OVER {_SO_FAR} AS BIGINT) AS squares, max(length(event_type)) OVER {_SO_FAR} AS longest,
count(*) OVER {_SO_FAR} AS seen FROM r""",
)
def rolling_reduce(spark, sf_dir):
    ks = _cents(replay(spark, sf_dir))
    folds = [
        Fold("squares", "sum", F.col("cents") * F.col("cents")),
        Fold("longest", "max", F.length("event_type").cast("bigint")),
        Fold("seen", "sum", F.lit(1).cast("bigint")),
    ]
    return rolling.rolling_reduce(ks, *folds).select("k", "event_id", "squares", "longest", "seen")


@query(
    "latest_state",
    f"""WITH {sql_rows()}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY arrival DESC, event_id DESC) AS n FROM r)
SELECT k, event_id, event_type, t_ms FROM n WHERE n = 1""",
)
def latest_state(spark, sf_dir):
    return rolling.latest_state(replay(spark, sf_dir), "event_id", "event_type", "t_ms")


@query("reduced_state", f"WITH {sql_rows()} SELECT k, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n FROM r GROUP BY k")
def reduced_state(spark, sf_dir):
    return rolling.reduced_state(_cents(replay(spark, sf_dir)), F.sum("cents").alias("cents"), F.count("*").alias("n"))


# --- joins ------------------------------------------------------------------------------------------------------------


def _two_streams(spark, sf_dir, scenario="median50", key="k"):
    ks = replay(spark, sf_dir, scenario, key)
    slim = ks.df.select(key, "t_ms", "arrival", "event_id", "event_type")
    return [ks.with_df(slim.where(F.col("event_type") == t).drop("event_type")) for t in ("click", "purchase")]


def _join_sql(near: str) -> str:
    return f"""WITH {sql_rows()}, l AS (SELECT * FROM r WHERE event_type = 'click'), q AS (SELECT * FROM r WHERE event_type = 'purchase')
SELECT l.k, l.event_id AS left_id, q.event_id AS right_id FROM l JOIN q ON l.k = q.k AND {near}"""


def _pairs(joined):
    return joined.select("k", F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id"))


@query("interval_join", _join_sql(f"q.t_ms BETWEEN l.t_ms - {HOUR} AND l.t_ms + {HOUR}"))
def interval_join(spark, sf_dir):
    left, right = _two_streams(spark, sf_dir)
    return _pairs(joins.interval_join(left, right, -HOUR, HOUR).joined)


_DAY_JOIN = """WITH l AS (SELECT o_orderkey, o_custkey, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS t FROM orders)
SELECT a.o_custkey, a.o_orderkey AS left_id, b.o_orderkey AS right_id FROM l a JOIN l b ON a.o_custkey = b.o_custkey AND b.t > a.t AND b.t < a.t + 2592000000"""


@query("interval_join_exclusive", _DAY_JOIN)
def interval_join_exclusive(spark, sf_dir):
    """Orders of the same customer within the next thirty days, neither end included."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    ks = key_by(orders, "o_custkey", ts="o_orderdate", tie="o_orderkey")
    pairs = joins.interval_join(ks, ks, 0, 30 * 24 * HOUR, lower_exclusive=True, upper_exclusive=True).joined
    return pairs.select("o_custkey", F.col("left.o_orderkey").alias("left_id"), F.col("right.o_orderkey").alias("right_id"))


_PAIR_CLOCK = f"""WITH {sql_rows('global50')},
u AS (SELECT * FROM r WHERE event_type IN ('click', 'purchase')),
v AS (SELECT *, max(CASE WHEN event_type = 'click' THEN t_ms - 1001 END) OVER s AS wl, max(CASE WHEN event_type = 'purchase' THEN t_ms - 1001 END) OVER s AS wr
FROM u WINDOW s AS (PARTITION BY k ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, wl IS NOT NULL AND wr IS NOT NULL AND t_ms < least(wl, wr) AS late FROM v)"""


def _late_join(spark, sf_dir):
    left, right = _two_streams(spark, sf_dir, "global50")
    return joins.interval_join(left, right, -HOUR, HOUR, strategy=CLOCK)


@query(
    "interval_join_in_time",
    _PAIR_CLOCK
    + f""" SELECT l.k, l.event_id AS left_id, q.event_id AS right_id FROM z l JOIN z q ON l.k = q.k AND q.t_ms BETWEEN l.t_ms - {HOUR} AND l.t_ms + {HOUR}
WHERE l.event_type = 'click' AND q.event_type = 'purchase' AND NOT l.late AND NOT q.late""",
)
def interval_join_in_time(spark, sf_dir):
    return _pairs(_late_join(spark, sf_dir).joined)


@query("interval_join_late_left", _PAIR_CLOCK + " SELECT k, event_id, t_ms FROM z WHERE late AND event_type = 'click'")
def interval_join_late_left(spark, sf_dir):
    return _late_join(spark, sf_dir).late_left.select("k", "event_id", "t_ms")


@query("interval_join_late_right", _PAIR_CLOCK + " SELECT k, event_id, t_ms FROM z WHERE late AND event_type = 'purchase'")
def interval_join_late_right(spark, sf_dir):
    return _late_join(spark, sf_dir).late_right.select("k", "event_id", "t_ms")


@query(
    "connected_streams",
    _PAIR_CLOCK.replace("PARTITION BY k ", "PARTITION BY user_id ")
    + f""" SELECT CAST(NULL AS VARCHAR) AS tag, l.event_id AS left_id, q.event_id AS right_id FROM z l JOIN z q ON l.user_id = q.user_id
AND q.t_ms BETWEEN l.t_ms - {24 * HOUR} AND l.t_ms + {24 * HOUR} WHERE l.event_type = 'click' AND q.event_type = 'purchase' AND NOT l.late AND NOT q.late
UNION ALL SELECT 'late_left', event_id, NULL FROM z WHERE late AND event_type = 'click'
UNION ALL SELECT 'late_right', NULL, event_id FROM z WHERE late AND event_type = 'purchase'""",
)
def connected_streams(spark, sf_dir):
    """Two streams with a clock per user and side: the pairs within a day, and the late rows of either."""
    left, right = [key_by(s.df, "user_id", ts="t_ms", arrival="arrival", tie="event_id") for s in _two_streams(spark, sf_dir, "global50", "user_id")]
    join = joins.interval_join(left, right, -24 * HOUR, 24 * HOUR, strategy=CLOCK)
    nothing = F.lit(None).cast("bigint")

    def ids(df, tag, one, two):
        return df.select(F.lit(tag).cast("string").alias("tag"), one.alias("left_id"), two.alias("right_id"))

    pairs = ids(join.joined, None, F.col("left.event_id"), F.col("right.event_id"))
    late = ids(join.late_left, "late_left", F.col("event_id"), nothing).unionByName(ids(join.late_right, "late_right", nothing, F.col("event_id")))
    return pairs.unionByName(late)


class LatestOther(KeyedProcessFunction):
    """A function of two inputs: every left row with the latest right one that came before it, and how many there were."""

    def process(self, row, ctx):
        if row["side"] == "right":
            ctx.state["seen"] = ctx.state.get("seen", 0) + 1
            ctx.state["latest"] = row["event_id"]
        else:
            ctx.output(event_id=row["event_id"], latest=ctx.state.get("latest"), seen=ctx.state.get("seen", 0))


@query(
    "connected_latest",
    f"""WITH {sql_rows("global50")}, z AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER w AS seen,
last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS latest FROM r
WINDOW w AS (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, latest, seen FROM z WHERE event_type = 'click'""",
)
def connected_latest(spark, sf_dir):
    left, right = [key_by(s.df, "user_id", ts="t_ms", arrival="arrival", tie="event_id") for s in _two_streams(spark, sf_dir, "global50", "user_id")]
    shape = T.StructType([T.StructField(n, T.LongType()) for n in ("event_id", "latest", "seen")])
    return process_keyed(joins.connect(left, right), CLOCK, LatestOther(), shape).drop("tag")


@query(
    "union_streams",
    f"WITH {sql_rows()} SELECT k, event_id, t_ms FROM r WHERE event_type IN ('click', 'purchase')",
)
def union_streams(spark, sf_dir):
    return joins.union(*_two_streams(spark, sf_dir)).df.select("k", "event_id", "t_ms")


@query(
    "broadcast_rules",
    f"""WITH {sql_rows()}, rules AS (SELECT n_nationkey % 20 AS k, max(n_regionkey) AS min_level FROM nation GROUP BY 1)
SELECT r.k, count(*) AS hits FROM r JOIN rules USING (k) WHERE r.cents >= rules.min_level * 1000 GROUP BY r.k""",
)
def broadcast_rules(spark, sf_dir):
    """A small stream of thresholds known to every key."""
    rules = (
        spark.read.parquet(f"{sf_dir}/nation.parquet")
        .groupBy((F.col("n_nationkey") % 20).cast("bigint").alias("k"))
        .agg(F.max("n_regionkey").alias("min_level"))
    )
    ks = _cents(replay(spark, sf_dir))
    joined = joins.join_rules(ks.df.select("k", "cents"), rules, ["k"])
    return joined.where(F.col("cents") >= F.col("min_level") * 1000).groupBy("k").agg(F.count("*").alias("hits"))


# --- projection, side outputs -----------------------------------------------------------------------------------------


@query(
    "declared_transform",
    "SELECT event_id, CAST(value * 2 AS DOUBLE) AS doubled, upper(event_type) AS kind FROM events WHERE value > 10",
)
def declared_transform(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = transform(df, where=F.col("value") > 10, doubled=F.col("value") * 2, kind=F.upper("event_type"))
    shape = T.StructType(
        [T.StructField("event_id", T.LongType()), T.StructField("doubled", T.DoubleType()), T.StructField("kind", T.StringType())]
    )
    return declare(df, shape)


@query(
    "side_output",
    f"WITH {sql_clock(scenario='global50')}, {sql_windows(HOUR)} SELECT event_id, k FROM w WHERE wm >= window_end - 1",
)
def side_output(spark, sf_dir):
    rows = W.classify_lateness(replay(spark, sf_dir, "global50"), CLOCK, A.tumbling(HOUR))
    return SideOutputs(rows.select("event_id", "k", F.col("window_status").alias("tag"))).get("late")


# --- reports ----------------------------------------------------------------------------------------------------------

_ALL = "base AS (SELECT *, user_id % 20 AS k, epoch_us(ts) // 1000 AS t_ms FROM events), r AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS experiment, event_id, k, t_ms, t_ms + CASE WHEN {_DELAYED[s]} THEN {12 * HOUR} + {_JITTER} ELSE 0 END AS arrival FROM base"
    for s in SCENARIOS
) + ")"


def _all_sql(part: str) -> str:
    return ",\n".join([sql_clock(part=part, src=_ALL), sql_windows(HOUR)])


def _both_clocks(spark, sf_dir):
    """Keyed runs, and stream-level runs: there the experiment is what has one clock."""
    ks = all_scenarios(spark, sf_dir)
    per_experiment = all_scenarios(spark, sf_dir, "experiment")
    return ks, per_experiment


@query(
    "accuracy_report",
    f"""WITH {_all_sql('PARTITION BY experiment, k')} SELECT experiment, count(*) AS processed_elements FROM w WHERE wm IS NULL OR wm < window_end - 1 GROUP BY experiment""",
)
def accuracy_report(spark, sf_dir):
    ks, _ = _both_clocks(spark, sf_dir)
    return reports.accuracy_report(W.window_firings(ks, CLOCK, A.tumbling(HOUR)))


def _loss_sql(part):
    return f"""WITH {_all_sql(part)},
s AS (SELECT experiment, count(*) AS total, count(*) FILTER (WHERE wm >= window_end - 1) AS late FROM w GROUP BY experiment)
SELECT experiment, total, late, round(1 - late / total, 6) AS accuracy, round(late / total, 6) AS loss FROM s"""


@query("loss_report", _loss_sql("PARTITION BY experiment, k"))
def loss_report(spark, sf_dir):
    ks, _ = _both_clocks(spark, sf_dir)
    return reports.loss_report(W.late_counts(ks, CLOCK, A.tumbling(HOUR)))


@query("loss_report_stream", _loss_sql("PARTITION BY experiment"))
def loss_report_stream(spark, sf_dir):
    _, runs = _both_clocks(spark, sf_dir)
    return reports.loss_report(W.late_counts(runs, CLOCK, A.tumbling(HOUR)))


_NS = 1_000_000


def _end_log(spark, sf_dir, strategy=CLOCK):
    """Firings as END records; the wall clock is the arrival that moved the watermark plus a fixed skew per key and hour.

    Firings at the end of input have the last watermark there is and no wall clock."""
    fired = W.window_firings(replay(spark, sf_dir), strategy, A.tumbling(HOUR))
    hour = floor_div("window_start", HOUR)
    slow = F.when(hour % 97 == 0, 60_000).otherwise(0)
    clock = (F.col("fired_at") + (F.col("k") % 7) * (hour % 1000 + 1) + slow) * _NS
    return fired.select(F.lit("END").alias("type"), F.col("wm").alias("watermark"), F.col("k").alias("key"), clock.alias("system_time"))


def _start_log(spark, sf_dir):
    steps = watermark.watermark_progress(replay(spark, sf_dir), CLOCK)
    return steps.select(
        F.lit("START").alias("type"), F.col("wm").alias("watermark"), F.col("k").alias("key"), (F.col("arrival") * _NS).alias("system_time")
    )


def _stream_logs(spark, sf_dir):
    slow = CLOCK.with_scope("stream")
    start = watermark.watermark_progress(replay(spark, sf_dir), slow).select(
        F.col("wm").alias("watermark"), (F.col("arrival") * _NS).alias("system_time")
    )
    return start, _end_log(spark, sf_dir, slow).select("watermark", "system_time")


_SKEW = f"(k % 7) * (window_start // {HOUR} % 1000 + 1) + CASE WHEN window_start // {HOUR} % 97 = 0 THEN 60000 ELSE 0 END"
_END = f"e AS (SELECT wm AS watermark, k AS key, (fired_at + {_SKEW}) * {_NS} AS system_time FROM f)"
_KEYED_LATENCY = (
    sql_firings(",\n".join([sql_clock(), sql_steps(), sql_windows(HOUR)]))
    + f""", {_END},
lk AS (SELECT s.watermark, s.key, (e.t - s.t) / 1e9 AS latency FROM (SELECT pwm AS watermark, k AS key, min("at") * {_NS} AS t FROM p GROUP BY 1, 2) s
JOIN (SELECT watermark, key, max(system_time) AS t FROM e GROUP BY 1, 2) e ON s.watermark = e.watermark AND s.key = e.key),
env AS (SELECT watermark, max(latency) AS max_latency, min(latency) AS min_latency FROM lk GROUP BY 1)"""
)
_STREAM_LATENCY = (
    sql_firings(",\n".join([sql_clock(part=""), sql_steps(""), sql_windows(HOUR)]), on="")
    + f""", {_END},
ls AS (SELECT p.pwm AS watermark, p.at * {_NS} AS system_time, (e.t - p.at * {_NS}) / 1e9 AS latency FROM p
JOIN (SELECT watermark, max(system_time) AS t FROM e GROUP BY 1) e ON p.pwm = e.watermark)"""
)


@query(
    "window_end_log",
    sql_firings(",\n".join([sql_clock(), sql_steps(), sql_windows(HOUR)])) + f""", {_END} SELECT 'END' AS type, watermark, key, system_time FROM e""",
)
def window_end_log(spark, sf_dir):
    return _end_log(spark, sf_dir)


def _latency_keyed(spark, sf_dir):
    return reports.latency_keyed(_start_log(spark, sf_dir), _end_log(spark, sf_dir).where("system_time is not null"))


@query("latency_keyed", _KEYED_LATENCY + " SELECT watermark, key, round(latency, 6) AS latency FROM lk")
def latency_keyed(spark, sf_dir):
    return _latency_keyed(spark, sf_dir).withColumn("latency", F.round("latency", 6))


@query(
    "latency_envelope",
    _KEYED_LATENCY + " SELECT watermark, round(max_latency, 6) AS max_latency, round(min_latency, 6) AS min_latency FROM env",
)
def latency_envelope(spark, sf_dir):
    env = reports.latency_envelope(_latency_keyed(spark, sf_dir))
    return env.select("watermark", F.round("max_latency", 6).alias("max_latency"), F.round("min_latency", 6).alias("min_latency"))


@query("latency_stream", _STREAM_LATENCY + " SELECT watermark, system_time, round(latency, 6) AS latency FROM ls")
def latency_stream(spark, sf_dir):
    return reports.latency_stream(*_stream_logs(spark, sf_dir)).withColumn("latency", F.round("latency", 6))


def _summary_sql(name: str, x: str, table: str) -> str:
    return f"""SELECT '{name}' AS series, round(max({x}), 6) AS max, round(min({x}), 6) AS min, round(avg({x}), 6) AS avg, round(quantile_cont({x}, 0.9), 6) AS p90,
round(quantile_cont({x}, 0.95), 6) AS p95, round(quantile_cont({x}, 0.99), 6) AS p99 FROM {table}"""


@query(
    "latency_summary",
    _KEYED_LATENCY + " " + _summary_sql("max_latency", "max_latency", "env") + " UNION ALL " + _summary_sql("min_latency", "min_latency", "env"),
)
def latency_summary(spark, sf_dir):
    env = reports.latency_envelope(_latency_keyed(spark, sf_dir))
    both = F.inline(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("latency")) for c in ("max_latency", "min_latency")]))
    return reports.latency_summary(env.select(both), "latency", "series")


@query("latency_summary_stream", _STREAM_LATENCY + " " + _summary_sql("stream", "latency", "ls").replace("'stream' AS series, ", ""))
def latency_summary_stream(spark, sf_dir):
    return reports.latency_summary(reports.latency_stream(*_stream_logs(spark, sf_dir)))


@query(
    "latency_outliers",
    _KEYED_LATENCY
    + """, b AS (SELECT quantile_cont(max_latency, 0.25) AS q1, quantile_cont(max_latency, 0.75) AS q3 FROM env)
SELECT watermark, round(max_latency, 6) AS max_latency FROM env, b WHERE max_latency < q1 - 1.5 * (q3 - q1) OR max_latency > q3 + 1.5 * (q3 - q1)""",
)
def latency_outliers(spark, sf_dir):
    env = reports.latency_envelope(_latency_keyed(spark, sf_dir))
    return reports.latency_outliers(env, "max_latency").select("watermark", F.round("max_latency", 6).alias("max_latency"))


@query(
    "latency_series",
    f"""SELECT * FROM ({_STREAM_LATENCY} SELECT watermark, 'stream' AS series, round(latency, 6) AS value FROM ls)
UNION ALL SELECT * FROM ({_KEYED_LATENCY} SELECT watermark, 'keyed_max', round(max_latency, 6) FROM env
UNION ALL SELECT watermark, 'keyed_min', round(min_latency, 6) FROM env)""",
)
def latency_series(spark, sf_dir):
    stream = reports.latency_stream(*_stream_logs(spark, sf_dir))
    series = reports.latency_series(stream, reports.latency_envelope(_latency_keyed(spark, sf_dir)))
    return series.withColumn("value", F.round("value", 6))


def _state_sql(part: str, keys: str, on: str) -> str:
    return f"""{sql_clock(part=part)},
{sql_steps(keys)},
{sql_windows(HOUR)},
g AS (SELECT k, window_start, window_end, count(*) AS n FROM w WHERE wm IS NULL OR wm < window_end - 1 + {_LATE} GROUP BY 1, 2, 3),
f AS (SELECT g.*, p.at AS fired_at FROM g ASOF LEFT JOIN p ON {on}g.window_end - 1 + {_LATE} <= p.pwm),
d AS (SELECT k, arrival // {HOUR} AS t, 1 AS d FROM w WHERE wm IS NULL OR wm < window_end - 1 + {_LATE}
UNION ALL SELECT k, fired_at // {HOUR}, -n FROM f WHERE fired_at IS NOT NULL),
s AS (SELECT k, t, sum(d) AS d FROM d GROUP BY 1, 2),
tl AS (SELECT k, t * {HOUR} AS ts, CAST(sum(d) OVER (PARTITION BY k ORDER BY t) AS BIGINT) AS size FROM s)"""


def _timeline(spark, sf_dir, scope="key"):
    return reports.state_timeline(replay(spark, sf_dir), CLOCK.with_scope(scope), A.tumbling(HOUR), HOUR, _LATE)


_KEYED_STATE = _state_sql("PARTITION BY k", "k, ", "g.k = p.k AND ")


@query("state_size_timeline", f"WITH {_KEYED_STATE} SELECT k, ts, size FROM tl")
def state_size_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir)


@query("state_size", f"WITH {_KEYED_STATE} SELECT ts, CAST(sum(size) AS BIGINT) AS size FROM tl GROUP BY ts")
def state_size(spark, sf_dir):
    return reports.state_size(_timeline(spark, sf_dir))


_LIMIT = 1_705_500_000_000


@query(
    "state_diff",
    f"""WITH a AS (SELECT ts, CAST(sum(size) AS BIGINT) AS size FROM (WITH {_KEYED_STATE} SELECT * FROM tl) GROUP BY ts),
b AS (SELECT ts, CAST(sum(size) AS BIGINT) AS size FROM (WITH {_state_sql("", "", "")} SELECT * FROM tl) GROUP BY ts)
SELECT ts, coalesce(a.size, 0) AS size_keyed, coalesce(b.size, 0) AS size_stream, coalesce(a.size, 0) - coalesce(b.size, 0) AS difference
FROM a FULL JOIN b USING (ts) WHERE ts <= {_LIMIT}""",
)
def state_diff(spark, sf_dir):
    keyed, stream = reports.state_size(_timeline(spark, sf_dir)), reports.state_size(_timeline(spark, sf_dir, "stream"))
    return reports.state_diff(keyed, stream, limit=_LIMIT)


# --- log columns ------------------------------------------------------------------------------------------------------

_LOG_NAME = "CASE WHEN event_id % 2 = 0 THEN 'keyed' ELSE 'base' END"
_LOG_ROLE = "CASE WHEN event_id % 3 = 0 THEN 'start' ELSE 'end' END"


@query(
    "experiment_labels",
    f"""WITH l AS (SELECT event_id, {_LOG_NAME} AS clock, {_LOG_ROLE} AS role, (user_id % 20) || 'median' AS scenario, CAST(1 << (event_id % 4 + 1) AS INTEGER) AS cores FROM events)
SELECT event_id, role, clock || '_' || scenario || '_' || cores || 'c' AS experiment, clock, scenario, cores FROM l""",
)
def experiment_labels(spark, sf_dir):
    """Experiment, role, clock, scenario and cores from file names of both habits."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    clock, role = F.expr(_LOG_NAME), F.expr(_LOG_ROLE)
    scenario = F.concat((F.col("user_id") % 20).cast("string"), F.lit("median"))
    cores = F.concat(F.expr("shiftleft(1, cast(event_id % 4 + 1 as int))").cast("string"), F.lit("c"))
    name = F.when(F.col("event_id") % 2 == 0, F.concat_ws("_", clock, scenario, role, cores)).otherwise(
        F.concat_ws("_", clock, scenario, cores, role, F.lit("latency"))
    )
    return logs.label_experiments(events.select("event_id", name.alias("name"))).drop("name")


@query(
    "system_times",
    f"""WITH {sql_rows()}, l AS (SELECT event_id, arrival * {_NS} + event_id % 1000 AS system_time FROM r)
SELECT event_id, system_time, system_time // 1000 AS micros, row_number() OVER (ORDER BY system_time, event_id) AS place FROM l""",
)
def system_times(spark, sf_dir):
    """Wall-clock nanoseconds as timestamps, and every record's place in their order."""
    ks = replay(spark, sf_dir)
    log = ks.df.select("event_id", (F.col("arrival") * _NS + F.col("event_id") % 1000).alias("system_time"))
    times = logs.with_system_timestamp(log).withColumn("micros", F.unix_micros("system_timestamp")).drop("system_timestamp")
    order = [F.col("system_time"), F.col("event_id")]
    cut = floor_div("system_time", ks.bucket_ms * _NS)
    return running(times.withColumn("log", F.lit(0)), ["log"], order, cut, [Fold("place", "sum", F.lit(1).cast("bigint"))]).drop("log")


def _logged(spark, directory, schema, both):
    """START and END records written as CSV files, one experiment per folder, and read again."""
    for role, df in both.items():
        name = f"keyed_50median_{role}_4c" if "key" in df.columns else f"base_50median_4c_{role}_latency"
        logs.write_logs(df.withColumn("type", F.lit(role.upper())), directory, name, schema)
    return logs.label_experiments(logs.read_logs(spark, f"{directory}/*", schema, by_folder=True))


@query("csv_latency_keyed", _KEYED_LATENCY + " SELECT 'keyed_50median_4c' AS experiment, '50median' AS scenario, watermark, key, round(latency, 6) AS latency FROM lk")
def csv_latency_keyed(spark, sf_dir):
    """Keyed logs through CSV files whose names tell experiment and role."""
    end = _end_log(spark, sf_dir).where("system_time is not null")
    read = _logged(spark, shared_folder(spark), logs.KEYED_LATENCY, {"start": _start_log(spark, sf_dir), "end": end})
    start, end = [read.where((F.col("role") == role) & (F.col("type") == role.upper())) for role in ("start", "end")]
    latency = reports.latency_keyed(start, end, "experiment", "scenario")
    return latency.withColumn("latency", F.round("latency", 6))


@query(
    "csv_latency_stream",
    _STREAM_LATENCY + " SELECT 'base_50median_4c' AS experiment, watermark, system_time, round(latency, 6) AS latency, row_number() OVER (ORDER BY system_time, watermark) AS place FROM ls",
)
def csv_latency_stream(spark, sf_dir):
    """Stream-level logs through CSV files, in the order of their wall clock."""
    start, end = _stream_logs(spark, sf_dir)
    read = _logged(spark, shared_folder(spark), logs.STREAM_LATENCY, {"start": start, "end": end.where("system_time is not null")})
    latency = reports.latency_stream(*[read.where(F.col("role") == role) for role in ("start", "end")], "experiment")
    order = [F.col("system_time"), F.col("watermark")]
    cut = floor_div("system_time", 24 * HOUR * _NS)
    placed = running(latency, ["experiment"], order, cut, [Fold("place", "sum", F.lit(1).cast("bigint"))])
    return placed.withColumn("latency", F.round("latency", 6)).orderBy(*order)


_SIZES = f"""SELECT k, t_ms // {HOUR} AS ts, count(*) AS size_keyed, count(*) FILTER (cents % 2 = 0) AS size_stream FROM r GROUP BY 1, 2"""


@query(
    "state_diff_exempt",
    f"""WITH {sql_rows()}, s AS ({_SIZES})
SELECT k, ts, size_keyed, size_stream, size_keyed - size_stream AS difference FROM s WHERE ts <= 473592 OR k = 3""",
)
def state_diff_exempt(spark, sf_dir):
    """The time limit of the state comparison, with one key that is exempt from it."""
    rows = replay(spark, sf_dir).df.groupBy("k", floor_div("t_ms", HOUR).alias("ts"))
    pairs = rows.agg(F.count("*").alias("size_keyed"), F.count(F.when(cents() % 2 == 0, 1)).alias("size_stream"))
    return reports.state_pair_diff(pairs, "k", limit=473_592, exempt=("k", 3))


_BIG = 1 << 53


class LatestPayload(KeyedProcessFunction):
    """Every row's place in its key and the latest payload that is not null."""

    def process(self, row, ctx):
        ctx.state["n"] = ctx.state.get("n", 0) + 1
        if row["payload"] is not None:
            ctx.state["payload"] = row["payload"]
        ctx.output(key=ctx.key[0], event_id=row["event_id"], n=ctx.state["n"], payload=ctx.state.get("payload"))


def _big_numbers(spark, sf_dir):
    ks = replay(spark, sf_dir)
    df = ks.df.select("event_id", "t_ms", "arrival", F.when(F.col("k") != 3, F.col("k") + _BIG).alias("key"))
    return ks.with_df(df.withColumn("payload", F.when(F.col("event_id") % 7 != 0, F.col("event_id") + _BIG))).key_by("key")


_BIG_SQL = f"""{sql_rows()}, b AS (SELECT event_id, t_ms, arrival, CASE WHEN k <> 3 THEN k + {_BIG} END AS key,
CASE WHEN event_id % 7 <> 0 THEN event_id + {_BIG} END AS payload FROM r)"""


@query(
    "exact_numbers_process",
    f"""WITH {_BIG_SQL} SELECT key, event_id, row_number() OVER w AS n, last_value(payload IGNORE NULLS) OVER w AS payload FROM b
WINDOW w AS (PARTITION BY key ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def exact_numbers_process(spark, sf_dir):
    """Whole numbers beyond the exact range of doubles, as key and as payload, next to nulls."""
    shape = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "event_id", "n", "payload")])
    return process_keyed(_big_numbers(spark, sf_dir), CLOCK, LatestPayload(), shape).drop("tag")


def _payload_range(window, rows):
    found = [r["payload"] for r in rows if r["payload"] is not None]
    yield {"key": window["key"], "window_start": window["window_start"], "low": min(found, default=None), "high": max(found, default=None)}


@query(
    "exact_numbers_panes",
    f"""WITH {_BIG_SQL}, c AS (SELECT *, max(t_ms - 1001) OVER (PARTITION BY key ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM b)
SELECT key, t_ms - t_ms % {6 * HOUR} AS window_start, min(payload) AS low, max(payload) AS high FROM c
WHERE wm IS NULL OR wm < t_ms - t_ms % {6 * HOUR} + {6 * HOUR} - 1 GROUP BY 1, 2""",
)
def exact_numbers_panes(spark, sf_dir):
    """The same through a window function."""
    shape = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "window_start", "low", "high")])
    return W.window_process(_big_numbers(spark, sf_dir), CLOCK, A.tumbling(6 * HOUR), _payload_range, shape)
