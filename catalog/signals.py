"""Normalisation, transforms, smoothing, interpolation and filters."""

import math

from pyspark.sql import functions as F

from catalog.base import EVENT_SQL, TAP_SQL, TAPS, antenna_rows, event_rows, per_tap, pick_sql, query, r, snapshots, timed_snapshots
from kartograf.functions import arrays
from kartograf.operators import series
from kartograf.operators import snapshots as S
from kartograf.plans import jobs


@query("iq_to_abs", f"WITH {TAP_SQL} SELECT id, antenna, tap, ROUND(sqrt(re*re+im*im), 6) + 0.0 AS v FROM tap")
def iq_to_abs(spark, d):
    item = S.iq_to_abs(snapshots(spark, d).select("id", F.col("cir").alias("inputs")))
    rows = item.select("id", F.posexplode(F.col("inputs")[0]).alias("antenna", "v"))
    return per_tap(rows, "v")


@query("iq_keep", f"""WITH {TAP_SQL} SELECT id, CAST(c AS INT) AS channel, antenna, tap,
ROUND(CASE c WHEN 0 THEN re WHEN 1 THEN im ELSE sqrt(re*re+im*im) END, 6) + 0.0 AS v FROM tap, range(3) rc(c)""")
def iq_keep(spark, d):
    item = S.iq_to_abs(snapshots(spark, d).select("id", F.col("cir").alias("inputs")), keep_iq=True)
    rows = item.select("id", F.posexplode("inputs").alias("channel", "c")).select("id", "channel", F.posexplode("c").alias("antenna", "v"))
    return rows.select("id", "channel", "antenna", F.posexplode("v").alias("tap", "v")).select("id", "channel", "antenna", "tap", r("v").alias("v"))


_FACTOR_SQL = {
    ("unit", "self"): "sqrt(sum(m*m) OVER (PARTITION BY id, antenna))",
    ("unit", "set"): "sqrt(sum(m*m) OVER (PARTITION BY id))",
    ("max", "self"): "max(m) OVER (PARTITION BY id, antenna)",
    ("max", "set"): "max(m) OVER (PARTITION BY id)",
    ("max", "antenna"): "max(m) OVER (PARTITION BY antenna)",
    ("max", "full"): "max(m) OVER ()",
}


def _norm(norm, span):
    sql = f"""WITH {TAP_SQL}, m AS (SELECT *, sqrt(re*re+im*im) AS m FROM tap), f AS (SELECT *, {_FACTOR_SQL[norm, span]} AS f FROM m)
SELECT id, antenna, tap, ROUND(re/nullif(f, 0), 6) + 0.0 AS re, ROUND(im/nullif(f, 0), 6) + 0.0 AS im FROM f"""

    @query(f"norm_{norm}_{span}", sql)
    def run(spark, d):
        return per_tap(S.normalize(antenna_rows(spark, d), norm, span), "re", "im")


for _pair in _FACTOR_SQL:
    _norm(*_pair)


def _dft(name, bins):
    sql = f"""WITH {TAP_SQL} SELECT id, antenna, CAST(k AS INT) AS tap,
ROUND(sum(CASE WHEN tap < {bins} THEN re*cos(2*pi()*k*tap/{bins}) + im*sin(2*pi()*k*tap/{bins}) ELSE 0 END)/sqrt({bins}), 6) + 0.0 AS re,
ROUND(sum(CASE WHEN tap < {bins} THEN im*cos(2*pi()*k*tap/{bins}) - re*sin(2*pi()*k*tap/{bins}) ELSE 0 END)/sqrt({bins}), 6) + 0.0 AS im
FROM tap, range({bins}) rk(k) GROUP BY ALL"""

    @query(name, sql)
    def run(spark, d):
        item = S.time_to_frequency(snapshots(spark, d).select("id", F.col("cir").alias("inputs")), TAPS, bins)
        both = F.arrays_zip(F.col("inputs")[0].alias("re"), F.col("inputs")[1].alias("im"))
        rows = item.select("id", F.posexplode(both).alias("antenna", "z")).select("id", "antenna", "z.re", "z.im")
        return per_tap(rows, "re", "im")


_dft("cir_to_cfr", 8)
_dft("cir_to_cfr_padded", 12)
_dft("cir_to_cfr_cut", 6)


@query("delay_alignment", f"""WITH {TAP_SQL},
f AS (SELECT id, antenna, k, CASE WHEN k < 4 THEN k ELSE k - 8 END/8.0 AS fr, any_value(CASE WHEN valid THEN toa END)/2.0 AS delay,
  sum(re*cos(2*pi()*k*tap/8) + im*sin(2*pi()*k*tap/8)) AS fre, sum(im*cos(2*pi()*k*tap/8) - re*sin(2*pi()*k*tap/8)) AS fim
  FROM tap, range(8) rk(k) GROUP BY id, antenna, k),
g AS (SELECT *, fre*cos(2*pi()*fr*delay) + fim*sin(2*pi()*fr*delay) AS gre, fim*cos(2*pi()*fr*delay) - fre*sin(2*pi()*fr*delay) AS gim FROM f)
SELECT id, antenna, CAST(t AS INT) AS tap, ROUND(sum(gre*cos(2*pi()*k*t/8) - gim*sin(2*pi()*k*t/8))/8, 6) + 0.0 AS re,
  ROUND(sum(gim*cos(2*pi()*k*t/8) + gre*sin(2*pi()*k*t/8))/8, 6) + 0.0 AS im
FROM g, range(8) rt(t) WHERE delay IS NOT NULL GROUP BY id, antenna, t""")
def delay_alignment(spark, d):
    a = antenna_rows(spark, d).withColumn("toa", S.blank_invalid(F.col("toa"), F.col("valid")))
    return per_tap(S.align_to_toa(a, 2.0, TAPS).filter(F.col("toa").isNotNull()), "re", "im")


_W = ", ".join(str(w) for w in arrays.signature_weights(TAPS))
SIGNATURE_SQL = f"""{TAP_SQL}, en AS (SELECT *, re*re+im*im AS p, sum(re*re+im*im) OVER (PARTITION BY id, antenna) AS total FROM tap),
sig AS (SELECT id, antenna, any_value(valid) AS valid, sum(p/CASE WHEN total = 0 THEN 1 ELSE total END*[{_W}][tap+1])/12 AS s FROM en GROUP BY id, antenna)"""


@query("signature_scalar", f"WITH {SIGNATURE_SQL} SELECT id, antenna, ROUND(s, 8) + 0.0 AS s FROM sig")
def signature_scalar(spark, d):
    a = antenna_rows(spark, d)
    return a.select("id", "antenna", r(arrays.signature(F.col("re"), F.col("im"), TAPS), 8).alias("s"))


@query("random_antenna_mask", f"""WITH {TAP_SQL}, a AS (SELECT id, antenna, valid FROM tap WHERE tap = 0),
l AS (SELECT id, list(antenna ORDER BY antenna) FILTER (valid) AS places, list(valid ORDER BY antenna) AS mask FROM a GROUP BY id),
n AS (SELECT *, len(places) AS n FROM l),
q AS (SELECT *, CASE WHEN n > 2 THEN list_transform(range(0, n - 2), lambda m: places[{pick_sql('id*64 + m', 5, 'n')} + 1]) END AS draws FROM n)
SELECT id, CAST(k AS INT) AS antenna, mask[k+1] AND NOT coalesce(list_contains(draws, k), false) AS valid FROM q, range(4) rk(k)""")
def random_antenna_mask(spark, d):
    item = snapshots(spark, d).select("id", F.col("cir").alias("inputs"), "valid_mask")
    thin = S.drop_antennas_to(item, 2, 5)
    return thin.select("id", F.posexplode("valid_mask").alias("antenna", "valid"))


# --- series ---------------------------------------------------------------------------------------------

SEGMENT_SQL = f"""{EVENT_SQL}, b AS (SELECT *, row_number() OVER w - 1 AS pos, CASE WHEN ts - lag(ts) OVER w > 12 THEN 1 ELSE 0 END AS brk
  FROM ev WINDOW w AS (PARTITION BY antenna ORDER BY id)),
seg AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY antenna ORDER BY id) AS BIGINT) AS seg FROM b)"""


@query("gap_segments", f"WITH {SEGMENT_SQL} SELECT id, antenna, pos, seg, min(pos) OVER s AS seg_start, count(*) OVER s AS seg_len FROM seg WINDOW s AS (PARTITION BY antenna, seg)")
def gap_segments(spark, d):
    from kartograf.operators.ordering import with_segments
    rows = with_segments(event_rows(spark, d).select("id", "ts", "antenna"), "id", "ts", 12.0, ["antenna"])
    return rows.select("id", "antenna", "pos", "seg", "seg_start", "seg_len")


_POLAR_SQL = """pol AS (SELECT *, sqrt(re0*re0+im0*im0) AS m0, sqrt(re1*re1+im1*im1) AS m1, atan2(im0, re0) AS p0, atan2(im1, re1) AS p1 FROM {source})"""
_OUT = "ROUND({m}*cos({p}), 6) + 0.0 AS {re}, ROUND({m}*sin({p}), 6) + 0.0 AS {im}"


def _rows_out(df):
    """Two complex taps per row as plain columns."""
    at = lambda c, t: r(F.get(F.col(c), F.lit(t)))
    return df.select("id", "antenna", "valid", at("re", 0).alias("re0"), at("im", 0).alias("im0"),
                     at("re", 1).alias("re1"), at("im", 1).alias("im1"))


def _kernel(name, mag, phase, mode, least, honor):
    """Weights per offset as SQL: sum over the footprint of weight x value over weight."""
    ok = "valid" if honor else "true"

    def avg(expr, k):
        before, after = series.footprint(k)
        frame = f"ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING"
        if mode == "mean":
            return f"avg(CASE WHEN {ok} THEN {expr} END) OVER (PARTITION BY antenna, seg ORDER BY id {frame})"
        w = series.kernel_weights(k, mode)
        part = "OVER (PARTITION BY antenna, seg ORDER BY id)"

        def term(value, o):
            return f"coalesce(lead(CASE WHEN {ok} THEN {value} END, {o}) {part}, 0)" if o >= 0 else \
                f"coalesce(lag(CASE WHEN {ok} THEN {value} END, {-o}) {part}, 0)"

        up = " + ".join(f"{x}*{term(expr, o - before)}" for o, x in enumerate(w))
        down = " + ".join(f"{x}*{term('1', o - before)}" for o, x in enumerate(w))
        return f"({up})/nullif({down}, 0)"

    def count(k):
        before, after = series.footprint(k)
        return (f"count(CASE WHEN {ok} THEN 1 END) OVER (PARTITION BY antenna, seg ORDER BY id "
                f"ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)")

    sql = f"""WITH {SEGMENT_SQL}, {_POLAR_SQL.format(source='seg')},
w AS (SELECT id, antenna, least({count(mag)}, {count(phase)}) >= {least} AS valid, {avg('m0', mag)} AS a0, {avg('m1', mag)} AS a1,
  atan2({avg('sin(p0)', phase)}, {avg('cos(p0)', phase)}) AS q0, atan2({avg('sin(p1)', phase)}, {avg('cos(p1)', phase)}) AS q1 FROM pol)
SELECT id, antenna, valid, {_OUT.format(m='a0', p='q0', re='re0', im='im0')}, {_OUT.format(m='a1', p='q1', re='re1', im='im1')} FROM w"""

    @query(name, sql)
    def run(spark, d):
        return _rows_out(series.kernel_moving_average(event_rows(spark, d).drop("toa"), 2, mag, phase, mode, least, 12.0, honor))


_kernel("kernel_average", 10, 10, "mean", 1, True)
_kernel("kernel_average_phase", 5, 8, "mean", 3, True)
_kernel("kernel_average_unmasked", 4, 4, "mean", 1, False)
_kernel("kernel_exponential", 6, 6, "exponential", 1, True)


@query("kernel_average_single", f"""WITH {SEGMENT_SQL}, w AS (SELECT id, antenna, count(CASE WHEN valid THEN 1 END) OVER f >= 2 AS valid,
  ROUND(avg(CASE WHEN valid THEN re0 END) OVER f, 6) + 0.0 AS re0, ROUND(avg(CASE WHEN valid THEN re1 END) OVER f, 6) + 0.0 AS re1 FROM seg
  WINDOW f AS (PARTITION BY antenna, seg ORDER BY id ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING)) SELECT * FROM w""")
def kernel_average_single(spark, d):
    out = series.kernel_moving_average(event_rows(spark, d).drop("toa", "im"), 2, 6, min_valid_samples=2, max_time_diff=12.0)
    return out.select("id", "antenna", "valid", r(F.col("re")[0]).alias("re0"), r(F.col("re")[1]).alias("re1"))


def _temporal(name, mode):
    hm, hp = math.ceil(8 * 1.0 * 1.15) // 2, math.ceil(3 * 1.0 * 1.15) // 2

    def avg(expr, h, window):
        if mode == "normal":
            return f"avg(CASE WHEN valid THEN {expr} END) OVER (PARTITION BY antenna ORDER BY id ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
        alpha = 2.0 / (window + 1.0)
        part = "OVER (PARTITION BY antenna ORDER BY id)"

        def term(value, o):
            return f"coalesce(lag(CASE WHEN valid THEN {value} END, {o}) {part}, 0)" if o >= 0 else \
                f"coalesce(lead(CASE WHEN valid THEN {value} END, {-o}) {part}, 0)"

        up = " + ".join(f"{math.exp(-alpha * abs(o))}*{term(expr, o)}" for o in range(-h, h + 1))
        down = " + ".join(f"{math.exp(-alpha * abs(o))}*{term('1', o)}" for o in range(-h, h + 1))
        return f"({up})/nullif({down}, 0)"

    sql = f"""WITH {EVENT_SQL}, {_POLAR_SQL.format(source='ev')},
w AS (SELECT id, antenna, valid, {avg('m0', hm, 8.0)} AS a0, {avg('m1', hm, 8.0)} AS a1,
  atan2({avg('sin(p0)', hp, 3.0)}, {avg('cos(p0)', hp, 3.0)}) AS q0, atan2({avg('sin(p1)', hp, 3.0)}, {avg('cos(p1)', hp, 3.0)}) AS q1 FROM pol),
o AS (SELECT id, antenna, valid, {_OUT.format(m='a0', p='q0', re='re0', im='im0')}, {_OUT.format(m='a1', p='q1', re='re1', im='im1')} FROM w)
SELECT id, antenna, valid, CASE WHEN valid THEN re0 END AS re0, CASE WHEN valid THEN im0 END AS im0,
  CASE WHEN valid THEN re1 END AS re1, CASE WHEN valid THEN im1 END AS im1 FROM o"""

    @query(name, sql)
    def run(spark, d):
        return _rows_out(series.temporal_moving_average(event_rows(spark, d).drop("toa"), 2, 8.0, 3.0, mode, sampling_frequency=1.0))


_temporal("temporal_average", "normal")
_temporal("temporal_exponential", "exponential")

INTERPOLATE_SQL = """kn AS (SELECT *, last_value(CASE WHEN toa IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS pa, last_value(toa IGNORE NULLS) OVER w AS va,
  first_value(CASE WHEN toa IS NOT NULL THEN pos END IGNORE NULLS) OVER v AS pb, first_value(toa IGNORE NULLS) OVER v AS vb FROM seg
  WINDOW w AS (PARTITION BY antenna, seg ORDER BY pos ROWS UNBOUNDED PRECEDING),
         v AS (PARTITION BY antenna, seg ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
itp AS (SELECT id, antenna, seg, pos, CASE WHEN toa IS NOT NULL THEN toa WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va
  ELSE va + (vb - va)*(pos - pa)/(pb - pa) END AS toa FROM kn)"""


@query("interpolate_missing", f"WITH {SEGMENT_SQL}, {INTERPOLATE_SQL} SELECT id, antenna, seg, ROUND(toa, 6) + 0.0 AS toa FROM itp")
def interpolate_missing(spark, d):
    from kartograf.operators.ordering import with_segments
    rows = with_segments(event_rows(spark, d).select("id", "ts", "antenna", "toa"), "id", "ts", 12.0, ["antenna"])
    return series.interpolate(rows, "toa", ["antenna", "seg"]).select("id", "antenna", "seg", r("toa").alias("toa"))


def _filter(name, kind, k):
    before, after = series.footprint(k) if kind == "mean" else (k // 2, (k - 1) // 2)
    pick = "avg(v)" if kind == "mean" else f"list_sort(list(v))[{k // 2 + 1}]"
    sql = f"""WITH {SEGMENT_SQL}, {INTERPOLATE_SQL}, z AS (SELECT *, pos - min(pos) OVER s AS q, count(*) OVER s AS n FROM itp WINDOW s AS (PARTITION BY antenna, seg)),
pad AS (SELECT z.id, z.antenna, z.seg, z.q + o AS at, ((z.q + o) % (2*z.n) + 2*z.n) % (2*z.n) AS m, z.n FROM z, range({-before}, {after + 1}) ro(o)),
got AS (SELECT p.id, p.antenna, p.seg, y.toa AS v FROM pad p JOIN z y ON y.antenna = p.antenna AND y.seg = p.seg
  AND y.q = CASE WHEN p.m < p.n THEN p.m ELSE 2*p.n - 1 - p.m END)
SELECT id, antenna, ROUND(CASE WHEN count(v) > 0 THEN {pick} END, 6) + 0.0 AS toa FROM got GROUP BY id, antenna, seg"""

    @query(name, sql)
    def run(spark, d):
        rows = event_rows(spark, d).select("id", "ts", "antenna", "toa")
        return series.tdoa_filter(rows, k, 12.0, kind).select("id", "antenna", r("toa").alias("toa"))


_filter("arrival_mean_filter", "mean", 10)
_filter("arrival_median_filter", "median", 10)
_filter("arrival_median_filter_odd", "median", 7)


@query("cumulative_displacement", """SELECT event_id AS id, ROUND((epoch_us(ts)/1e6 - first_value(epoch_us(ts)/1e6) OVER (ORDER BY event_id))*1.2345678, 3) + 0.0 AS displacement FROM events""")
def cumulative_displacement(spark, d):
    from catalog.base import seconds, table
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), seconds().alias("ts"))
    return series.cumulative_displacement(rows, 1.2345678).select("id", r("displacement", 3).alias("displacement"))


@query("acceleration_loss", """WITH e AS (SELECT event_id, epoch_us(ts)/1e6/3600 AS t, value AS x, CAST(user_id AS DOUBLE) AS y, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events),
s AS (SELECT * FROM e WHERE p >= 3 AND (p - 3) % 10 = 0),
v AS (SELECT *, t - lag(t) OVER w AS d1, lead(t) OVER w - t AS d2, x - lag(x) OVER w AS x1, lead(x) OVER w - x AS x2, y - lag(y) OVER w AS y1, lead(y) OVER w - y AS y2
  FROM s WINDOW w AS (ORDER BY event_id)),
a AS (SELECT pow((x2/d2 - x1/d1)/d1, 2) + pow((y2/d2 - y1/d1)/d1, 2) AS q FROM v WHERE d1 > 1e-8 AND d2 > 1e-8)
SELECT ROUND(avg(q/1.7)/1e9, 6) + 0.0 AS loss FROM a""")
def acceleration_loss(spark, d):
    from catalog.base import seconds, table
    from kartograf.operators.losses import acceleration_loss as loss
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), (seconds() / 3600).alias("ts"),
                                            F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    return loss(series.accelerations(rows, 10, 3)).select(r(F.col("loss") / 1e9).alias("loss"))


@query("prepare_training", f"""WITH {TAP_SQL}, m AS (SELECT *, sqrt(re*re+im*im) AS m, atan2(im, re) AS ph FROM tap),
s AS (SELECT id, antenna, tap, avg(m) OVER w AS m, atan2(avg(sin(ph)) OVER w, avg(cos(ph)) OVER w) AS ph FROM m
  WINDOW w AS (PARTITION BY antenna, tap ORDER BY id ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING))
SELECT id, antenna, tap, ROUND(m/sqrt(sum(m*m) OVER (PARTITION BY id, antenna)), 6) + 0.0 AS v FROM s""")
def prepare_training(spark, d):
    """The whole preparation of training items: smooth, normalise, fill, magnitude."""
    long = jobs.prepare(timed_snapshots(spark, d).drop("toa"), "kernel_moving_average",
                        {"kernel_size_mag": 4, "max_time_diff": None}, "unit", "self")
    item = jobs.training_items(long, [{"augmentation_name": "IQToAbs", "augmentation_params": {"keep_iq": False}}])
    rows = item.select("id", F.posexplode(F.col("inputs")[0]).alias("antenna", "v"))
    return per_tap(rows, "v")
