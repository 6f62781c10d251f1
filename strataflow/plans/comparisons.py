"""Queries that compare groups and distributions, follow time courses, and summarise clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.common import table
from strataflow.operators import clusters as K
from strataflow.operators import compare as C
from strataflow.operators import temporal as T
from strataflow.plans.queries import register


def _round(df, n=6):
    return df.withColumns({c: F.round(c, n) for c, t in df.dtypes if t == "double"})


def _items(s, d, *columns):
    return table(s, d, "lineitem", *columns)


def _events(s, d):
    return table(s, d, "events", "event_id", "ts", "user_id", "event_type", "value")


def _control():
    return F.col("l_linestatus") == "F"


def _test():
    return F.col("l_linestatus") == "O"


_SIDES = ("l_returnflag", "l_linestatus", "l_extendedprice")


def _sides(s, d):
    return _items(s, d, *_SIDES)


_STEPS = """WITH k AS (SELECT l_returnflag AS g, l_extendedprice AS v, count(*) FILTER (WHERE l_linestatus = 'F') AS a, count(*) FILTER (WHERE l_linestatus = 'O') AS b FROM lineitem GROUP BY ALL),
f AS (SELECT g, v, lead(v) OVER w AS nx, sum(a) OVER w / sum(a) OVER (PARTITION BY g)::DOUBLE AS c, sum(b) OVER w / sum(b) OVER (PARTITION BY g)::DOUBLE AS t FROM k WINDOW w AS (PARTITION BY g ORDER BY v))"""
register("ks_two_sample", lambda s, d: _round(C.ks(_sides(s, d), ["l_returnflag"], "l_extendedprice", _control(), _test())), f"{_STEPS} SELECT g AS l_returnflag, round(max(abs(c - t)), 6) AS d FROM f GROUP BY 1")
register("overton", lambda s, d: _round(C.overton(_sides(s, d), ["l_returnflag"], "l_extendedprice", _control(), _test())), f"{_STEPS} SELECT g AS l_returnflag, round(100 * greatest(0, max(c - t)), 6) AS percent FROM f GROUP BY 1")
register("wasserstein", lambda s, d: _round(C.wasserstein(_sides(s, d), ["l_returnflag"], "l_extendedprice", _control(), _test()), 4), f"{_STEPS} SELECT g AS l_returnflag, round(sum(abs(c - t) * (nx - v)), 4) AS distance FROM f GROUP BY 1")
register(
    "jensen_shannon",
    lambda s, d: _round(C.jensen_shannon(_sides(s, d), "l_extendedprice", 0.0, 100000.0, 32, _control(), _test()), 8),
    """WITH h AS (SELECT greatest(0, least(31, floor(l_extendedprice / 100000 * 32))) AS bin, count(*) FILTER (WHERE l_linestatus = 'F') AS a, count(*) FILTER (WHERE l_linestatus = 'O') AS b FROM lineitem GROUP BY 1),
r AS (SELECT a / sum(a) OVER ()::DOUBLE AS p, b / sum(b) OVER ()::DOUBLE AS q, (p + q) / 2 AS m FROM h)
SELECT round((sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END)) / 2, 8) AS divergence FROM r""",
)
register(
    "probability_bins",
    lambda s, d: _round(C.probability_bins(_sides(s, d), "l_extendedprice", 32, _control(), _test())),
    """WITH c AS (SELECT quantile_cont(l_extendedprice, [k / 32 FOR k IN range(1, 32)]) AS cuts FROM lineitem WHERE l_linestatus = 'F'),
h AS (SELECT len(list_filter(cuts, lambda x: x < l_extendedprice)) AS bin, count(*) FILTER (WHERE l_linestatus = 'F') AS a, count(*) FILTER (WHERE l_linestatus = 'O') AS b FROM lineitem, c GROUP BY 1),
r AS (SELECT a / sum(a) OVER ()::DOUBLE AS c, b / sum(b) OVER ()::DOUBLE AS s, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM h),
x AS (SELECT sum(CASE WHEN c + s > 0 THEN pow(c - s, 2) / (c + s) ELSE 0 END) AS chi2, least(max(na), max(nb))::DOUBLE AS k, 100 * sum(greatest(0, s - c)) AS positive FROM r)
SELECT round(chi2, 6) AS chi2, round(greatest(0, (chi2 - 32 / k) / (sqrt(32::DOUBLE) / k)), 6) AS t, round(positive, 6) AS positive FROM x""",
)

_MOM = "WITH m AS (SELECT l_returnflag AS g, l_linestatus AS s, count(l_extendedprice)::DOUBLE AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), w AS (SELECT g, max(n) FILTER (WHERE s = 'F') AS n1, max(n) FILTER (WHERE s = 'O') AS n2, max(m) FILTER (WHERE s = 'F') AS m1, max(m) FILTER (WHERE s = 'O') AS m2, max(v) FILTER (WHERE s = 'F') AS v1, max(v) FILTER (WHERE s = 'O') AS v2 FROM m GROUP BY 1)"
register(
    "two_sample_tests",
    lambda s, d: _round(C.two_sample(_sides(s, d), ["l_returnflag"], "l_linestatus", "l_extendedprice", "F", "O")),
    _MOM + """ SELECT g AS l_returnflag, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS welch_t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 6) AS welch_df,
round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS student_t, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS cohens_d, round(m1 / m2, 6) AS fold_change FROM w""",
)
register(
    "paired_t",
    lambda s, d: _round(C.paired(_items(s, d, "l_suppkey", "l_linestatus", "l_extendedprice"), "l_suppkey", "l_linestatus", "l_extendedprice", "F", "O")),
    "WITH p AS (SELECT l_suppkey, avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F') - avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS d FROM lineitem GROUP BY 1) SELECT count(d) AS pairs, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS paired_t FROM p WHERE d IS NOT NULL",
)
register(
    "anova_f",
    lambda s, d: _round(C.anova(_sides(s, d), [], "l_returnflag", "l_extendedprice")),
    "WITH m AS (SELECT l_returnflag, count(*)::DOUBLE AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1), g AS (SELECT sum(n * m) / sum(n) AS x, sum(n) AS t, count(*) AS k FROM m) SELECT max(k) - 1 AS df_between, CAST(max(t) - max(k) AS BIGINT) AS df_within, round(sum(n * pow(m - x, 2)) / (max(k) - 1) / (sum((n - 1) * v) / (max(t) - max(k))), 6) AS f FROM m, g",
)
register(
    "welch_anova",
    lambda s, d: _round(C.welch_anova(_sides(s, d), "l_returnflag", "l_extendedprice")),
    "WITH m AS (SELECT count(*)::DOUBLE AS n, avg(l_extendedprice) AS m, n / var_samp(l_extendedprice) AS w FROM lineitem GROUP BY l_returnflag), g AS (SELECT sum(w) AS sw, sum(w * m) / sum(w) AS x, count(*)::DOUBLE AS k FROM m), r AS (SELECT max(k) AS k, sum(w * pow(m - x, 2)) / (max(k) - 1) AS b, sum(pow(1 - w / sw, 2) / (n - 1)) AS l FROM m, g) SELECT round(b / (1 + 2 * (k - 2) / (k * k - 1) * l), 6) AS f, CAST(k - 1 AS BIGINT) AS df_between, round((k * k - 1) / (3 * l), 6) AS df_within FROM r",
)
_RANK = "WITH r AS (SELECT l_returnflag AS g, l_linestatus AS s, l_quantity AS v, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY l_returnflag, l_quantity)::DOUBLE AS tie FROM lineitem)"
register(
    "mann_whitney_u",
    lambda s, d: _round(C.mann_whitney(_items(s, d, "l_returnflag", "l_linestatus", "l_quantity"), ["l_returnflag"], "l_linestatus", "l_quantity", "F", "O")),
    _RANK + ", x AS (SELECT g, sum(rk) FILTER (WHERE s = 'F') AS r, count(*) FILTER (WHERE s = 'F')::DOUBLE AS m, count(*) FILTER (WHERE s = 'O')::DOUBLE AS k, sum(tie * tie - 1) AS tt FROM r GROUP BY 1), u AS (SELECT *, r - m * (m + 1) / 2 AS u FROM x WHERE m > 0) SELECT g AS l_returnflag, round(u, 6) AS u, round((u - m * k / 2 - sign(u - m * k / 2) * 0.5) / nullif(sqrt(m * k / 12 * (m + k + 1 - tt / ((m + k) * (m + k - 1)))), 0), 6) AS z FROM u",
)
register(
    "kruskal_wallis",
    lambda s, d: _round(C.kruskal(_items(s, d, "l_returnflag", "l_quantity"), "l_returnflag", "l_quantity")),
    "WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY l_quantity)::DOUBLE AS tie FROM lineitem), x AS (SELECT g, sum(rk) AS r, count(*)::DOUBLE AS n, sum(tie * tie - 1) AS tt FROM r GROUP BY 1), y AS (SELECT sum(n) AS n, sum(r * r / n) AS q, sum(tt) AS tt, count(*) AS k FROM x) SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tt / (n * n * n - n)), 6) AS h, k - 1 AS df FROM y",
)
register("pearson", lambda s, d: _round(C.correlation(_items(s, d, "l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice"), 8), "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS pearson FROM lineitem GROUP BY 1")
register("contingency", lambda s, d: C.contingency(_items(s, d, "l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus"), "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2")
register(
    "association",
    lambda s, d: _round(C.association(table(s, d, "orders", "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority")),
    "WITH k AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS o FROM orders GROUP BY 1, 2), r AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb, sum(o) OVER () AS n FROM k), x AS (SELECT max(n) * (sum(o * o / (ra * cb)) - 1) AS chi2, count(DISTINCT a) AS r, count(DISTINCT b) AS c, max(n) AS n FROM r) SELECT round(chi2, 6) AS chi2, (r - 1) * (c - 1) AS df, round(sqrt(chi2 / (n * (least(r, c) - 1))), 6) AS cramers_v FROM x",
)


def _family(s, d):
    """Per supplier the share of large orders as a stand-in p value of a family of tests."""
    shares = _items(s, d, "l_suppkey", "l_quantity").groupBy("l_suppkey").agg((F.count_if(F.col("l_quantity") > 48) / F.count("*")).alias("p"), F.lit(1).alias("one"))
    return C.adjusted(shares.drop("one"), "p")


register(
    "adjusted_p",
    lambda s, d: _round(_family(s, d).groupBy("p").agg(F.max("bh").alias("bh"), F.min("holm").alias("holm"), F.count("*").alias("n")), 8),
    "WITH t AS (SELECT l_suppkey, count(*) FILTER (WHERE l_quantity > 48) / count(*)::DOUBLE AS p FROM lineitem GROUP BY 1), k AS (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM t), a AS (SELECT p, least(1, min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS bh, least(1, max(p * (n - k + 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)) AS holm FROM k) SELECT round(p, 8) AS p, round(max(bh), 8) AS bh, round(min(holm), 8) AS holm, count(*) AS n FROM a GROUP BY a.p",
)

_WIDTH = 21600.0
_BINS = "WITH b AS (SELECT event_type, CAST(floor(epoch_us(ts) / 1e6 / 21600) AS BIGINT) AS bin, count(value) AS n, CASE WHEN count(value) >= 10 THEN quantile_cont(value, 0.5) END AS median, CASE WHEN count(value) >= 10 THEN avg(value) END AS mean FROM events GROUP BY 1, 2)"
register("time_bins", lambda s, d: _round(T.bins(_events(s, d), ["event_type"], "ts", "value", _WIDTH)), f"{_BINS} SELECT event_type, bin, n, round(median, 6) AS median, round(mean, 6) AS mean FROM b")
register("smooth_bins", lambda s, d: _round(T.smoothed(T.bins(_events(s, d), ["event_type"], "ts", "value", _WIDTH), ["event_type"], "mean", 2).select("event_type", "bin", "smooth")), f"{_BINS} SELECT event_type, bin, round(CASE WHEN mean IS NOT NULL THEN (SELECT avg(o.mean) FROM b o WHERE o.event_type = b.event_type AND abs(o.bin - b.bin) <= 2) END, 6) AS smooth FROM b")
_MEDIANS = """, e AS (SELECT *, min(bin) OVER (PARTITION BY event_type) AS f, max(bin) OVER (PARTITION BY event_type) AS l FROM b),
m AS (SELECT e.event_type, e.bin, e.f, e.l, e.mean, (SELECT median(o.mean) FROM b o WHERE o.event_type = e.event_type AND abs(o.bin - e.bin) <= least(2, e.bin - e.f, e.l - e.bin)) AS m FROM e),
t AS (SELECT *, lead(m) OVER w AS n1, lead(m, 2) OVER w AS n2, lag(m) OVER w AS p1, lag(m, 2) OVER w AS p2 FROM m WINDOW w AS (PARTITION BY event_type ORDER BY bin))
SELECT event_type, bin, round(CASE WHEN bin = f AND f < l AND mean + n1 + n2 IS NOT NULL THEN list_sort([mean, n1, 3 * n1 - 2 * n2])[2] WHEN bin = l AND f < l AND mean + p1 + p2 IS NOT NULL THEN list_sort([mean, p1, 3 * p1 - 2 * p2])[2] ELSE m END, 6) AS running_median FROM t"""
register("running_median", lambda s, d: _round(T.running_median(T.bins(_events(s, d), ["event_type"], "ts", "value", _WIDTH), ["event_type"], "mean", 2).select("event_type", "bin", "running_median")), _BINS + _MEDIANS)
register("box_smooth", lambda s, d: _round(T.box_smoothed(T.bins(_events(s, d), ["event_type"], "ts", "value", _WIDTH), ["event_type"], "mean", 7).select("event_type", "bin", "smooth")), f"{_BINS} SELECT event_type, bin, round((SELECT avg(o.mean) FROM b o WHERE o.event_type = b.event_type AND abs(o.bin - b.bin) <= 3), 6) AS smooth FROM b")


def _aligned(s, d):
    """Daily curves shifted so that each type's first high reading is 0."""
    events = _events(s, d)
    origin = events.where("value > 450").groupBy("event_type").agg(F.floor(F.min(T.seconds("ts")) / _WIDTH).alias("origin"))
    return T.aligned(T.bins(events, ["event_type"], "ts", "value", _WIDTH), ["event_type"], origin, "origin").select("event_type", "offset", "median")


register("aligned_curves", lambda s, d: _round(_aligned(s, d)), f"{_BINS}, o AS (SELECT event_type, CAST(floor(min(epoch_us(ts)) / 1e6 / 21600) AS BIGINT) AS z FROM events WHERE value > 450 GROUP BY 1) SELECT event_type, bin - z AS offset, round(median, 6) AS median FROM b JOIN o USING (event_type)")
register("area_under_bins", lambda s, d: _round(T.auc(T.bins(_events(s, d), ["event_type"], "ts", "value", _WIDTH), ["event_type"], "mean", 6.0), 4), f"{_BINS}, s AS (SELECT event_type, (bin - lag(bin) OVER w) * 6 * (mean + lag(mean) OVER w) / 2 AS a FROM b WHERE mean IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY bin)) SELECT event_type, round(sum(a), 4) AS area FROM s GROUP BY 1")
register(
    "response",
    lambda s, d: _round(T.response(T.bins(_events(s, d), ["event_type"], "ts", "value", _WIDTH), ["event_type"], "mean", 8)),
    f"{_BINS}, k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bin) AS k FROM b WHERE mean IS NOT NULL), r AS (SELECT event_type, avg(mean) FILTER (WHERE k <= 8) AS baseline, max(mean) FILTER (WHERE k > 8) AS peak FROM k GROUP BY 1) SELECT event_type, round(baseline, 6) AS baseline, round(peak, 6) AS peak, (SELECT min(bin) FROM k WHERE k.event_type = r.event_type AND k.k > 8 AND k.mean = r.peak) AS peak_bin, round(peak - baseline, 6) AS rise, (SELECT min(bin) FROM k WHERE k.event_type = r.event_type AND k.k > 8 AND k.mean >= baseline + (peak - baseline) / 2) AS half_bin, (SELECT round(count(*) FILTER (WHERE k.mean >= baseline + (peak - baseline) / 2) / count(*)::DOUBLE, 6) FROM k WHERE k.event_type = r.event_type AND k.k > 8) AS responding FROM r",
)
_GAPS = "WITH t AS (SELECT DISTINCT event_type, epoch_us(ts) / 1e6 AS t FROM events), g AS (SELECT event_type, t, t - lag(t) OVER (PARTITION BY event_type ORDER BY t) AS gap FROM t)"
register("longest_gap", lambda s, d: _round(T.longest_gap(_events(s, d), ["event_type"], "ts"), 4), f"{_GAPS} SELECT event_type, round(max(gap), 4) AS gap, round(quantile_cont(gap, 0.5), 4) AS typical FROM g WHERE gap IS NOT NULL GROUP BY 1")
register("pauses", lambda s, d: _round(T.pauses(_events(s, d), ["user_id"], "ts", 2.0, 3.0), 4),
    """WITH t AS (SELECT DISTINCT user_id, epoch_us(ts) / 1e6 AS e FROM events), g AS (SELECT user_id, lag(e) OVER (PARTITION BY user_id ORDER BY e) AS s, e FROM t), k AS (SELECT user_id, s, e, e - s AS gap FROM g WHERE s IS NOT NULL),
m AS (SELECT user_id, quantile_cont(gap, 0.5) AS typical, min(s) AS t0, max(e) AS t1 FROM k GROUP BY 1)
SELECT user_id, round(s, 4) AS start, round(e, 4) AS "end", round(gap, 4) AS gap FROM k JOIN m USING (user_id) WHERE gap >= greatest(2.0, 3.0 * typical) AND s >= t0 + (t1 - t0) / 10 AND e <= t1 - (t1 - t0) / 10 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, s) = 1""")
_DRIFT = "WITH e AS (SELECT *, epoch_us(l_shipdate) / 1e6 AS t, min(epoch_us(l_shipdate) / 1e6) OVER (PARTITION BY l_returnflag) AS a, max(epoch_us(l_shipdate) / 1e6) OVER (PARTITION BY l_returnflag) AS b FROM lineitem), p AS (SELECT l_returnflag, CAST(least(19, floor((t - a) / (b - a) * 20)) AS INT) AS part, l_quantity, l_extendedprice FROM e) SELECT l_returnflag, part, 'l_quantity' AS channel, round(quantile_cont(l_quantity, 0.5), 6) AS median FROM p GROUP BY 1, 2 UNION ALL SELECT l_returnflag, part, 'l_extendedprice', round(quantile_cont(l_extendedprice, 0.5), 6) FROM p GROUP BY 1, 2"
register("drift_medians", lambda s, d: _round(T.drift(_items(s, d, "l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_shipdate", ["l_quantity", "l_extendedprice"])),
    _DRIFT)
register("theil_sen", lambda s, d: _round(T.theil_sen(T.drift(_items(s, d, "l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_shipdate", ["l_quantity", "l_extendedprice"]), ["l_returnflag", "channel"]), 4),
    f"WITH d AS ({_DRIFT.replace('round(', '(').replace(', 6)', ')')}) SELECT a.l_returnflag, a.channel, round(quantile_cont((b.median - a.median) / (b.part - a.part), 0.5), 4) AS slope FROM d a JOIN d b ON a.l_returnflag = b.l_returnflag AND a.channel = b.channel AND a.part < b.part GROUP BY 1, 2")
register("drift_fold", lambda s, d: _round(T.fold_change(T.drift(_items(s, d, "l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_shipdate", ["l_quantity", "l_extendedprice"]), ["l_returnflag", "channel"])),
    f"WITH d AS ({_DRIFT.replace('round(', '(').replace(', 6)', ')')}) SELECT l_returnflag, channel, round(avg(median) FILTER (WHERE part > 17) / avg(median) FILTER (WHERE part < 2), 6) AS fold FROM d GROUP BY 1, 2")
register(
    "event_rates",
    lambda s, d: _round(T.rates(_events(s, d), ["event_type"], "ts", 3600.0)),
    "WITH s AS (SELECT event_type, CAST(floor(epoch_us(ts) / 1e6 / 3600) AS BIGINT) AS slice, count(*) AS count FROM events GROUP BY 1, 2), m AS (SELECT event_type, quantile_cont(count, 0.5) AS m, 1.4826 * mad(count) AS s FROM s GROUP BY 1) SELECT event_type, slice, count, round(CASE WHEN s <> 0 THEN (count - m) / s END, 6) AS score FROM s JOIN m USING (event_type)".replace("round(CASE WHEN s <> 0 THEN (count - m) / s END", "round(CASE WHEN m.s <> 0 THEN (count - m.m) / m.s END"),
)
register(
    "overlapping_bins",
    lambda s, d: _round(T.overlapping_bins(_events(s, d), ["event_type"], ["ts", "event_id"], "value", 100)),
    "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events), b AS (SELECT event_type, value, k // 50 AS bin FROM r UNION ALL SELECT event_type, value, k // 50 - 1 FROM r WHERE k // 50 > 0) SELECT event_type, bin, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median FROM b GROUP BY 1, 2",
)
_DAILY = "WITH r AS (SELECT event_type, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS bin, avg(value) AS mean FROM events GROUP BY 1, 2)"
register(
    "control_rules",
    lambda s, d: _round(T.control_rules(T.bins(_events(s, d), ["event_type"], "ts", "value", 86400.0, 1).select("event_type", "bin", "mean"), ["event_type"], "bin", "mean")),
    _DAILY + """, k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bin) AS k FROM r), b AS (SELECT event_type, avg(mean) AS m, stddev_samp(mean) AS s FROM k WHERE k <= 20 GROUP BY 1),
z AS (SELECT k.event_type, k.bin, k.mean, (k.mean - b.m) / b.s AS z FROM k JOIN b USING (event_type)),
w AS (SELECT *, lag(z) OVER o AS z1, min(z) OVER o2 AS lo2, max(z) OVER o2 AS hi2, count(*) OVER o2 AS n2, min(z) OVER o4 AS lo4, max(z) OVER o4 AS hi4, count(*) OVER o4 AS n4, min(z) OVER o10 AS lo10, max(z) OVER o10 AS hi10, count(*) OVER o10 AS n10 FROM z
WINDOW o AS (PARTITION BY event_type ORDER BY bin), o2 AS (PARTITION BY event_type ORDER BY bin ROWS 1 PRECEDING), o4 AS (PARTITION BY event_type ORDER BY bin ROWS 3 PRECEDING), o10 AS (PARTITION BY event_type ORDER BY bin ROWS 9 PRECEDING))
SELECT event_type, bin, round(mean, 6) AS mean, round(z, 6) AS z, CASE WHEN abs(z) > 3 THEN '1-3s' WHEN n2 = 2 AND (lo2 > 2 OR hi2 < -2) THEN '2-2s' WHEN ((z > 2 AND z1 < -2) OR (z < -2 AND z1 > 2)) AND abs(z - z1) > 4 THEN 'R-4s' WHEN n4 = 4 AND (lo4 > 1 OR hi4 < -1) THEN '4-1s' WHEN n10 = 10 AND (lo10 > 0 OR hi10 < 0) THEN '10x' WHEN abs(z) > 2 THEN '1-2s' END AS rule FROM w""",
)
def _log(s, d):
    return ["event_type"], ["ts", "event_id"], F.concat_ws("|", F.col("event_id").cast("string"), "event_type")


# The chain by recursion: over the places inside all blocks at once, and over the blocks.
_CHAIN = """WITH RECURSIVE o AS (SELECT event_id, event_type, row_number() OVER w - 1 AS r, (row_number() OVER w - 1) // 1000 AS b, (row_number() OVER w - 1) % 1000 AS k, sha256(event_id || '|' || event_type) AS own FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
d AS (SELECT event_type, b, sha256(string_agg(own, '' ORDER BY r)) AS digest FROM o GROUP BY 1, 2),
h AS (SELECT event_type, CAST(0 AS BIGINT) AS b, '' AS head FROM d WHERE b = 0 UNION ALL SELECT h.event_type, h.b + 1, sha256(h.head || d.digest) FROM h JOIN d ON d.event_type = h.event_type AND d.b = h.b WHERE h.b < 100000),
c AS (SELECT o.event_type, o.b, o.k, o.event_id, sha256(h.head || o.own) AS link FROM o JOIN h USING (event_type, b) WHERE k = 0 UNION ALL SELECT o.event_type, o.b, o.k, o.event_id, sha256(c.link || o.own) FROM c JOIN o ON o.event_type = c.event_type AND o.b = c.b AND o.k = c.k + 1)
SELECT event_id, link FROM c"""
register("hash_chain", lambda s, d: T.chained(_events(s, d), *_log(s, d)).select("event_id", "link"), _CHAIN)
register("hash_chain_verified", lambda s, d: T.verified(T.chained(_events(s, d), *_log(s, d)), *_log(s, d)), "SELECT event_type, count(*) AS entries, CAST(0 AS BIGINT) AS broken, CAST(NULL AS BIGINT) AS first_broken FROM events GROUP BY 1")


def _time_corrected(s, d):
    high = _events(s, d).where("value > 150")
    knots = high.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg((100 / F.avg("value")).alias("factor"))
    return T.corrected(_events(s, d), ["event_type"], "ts", "value", knots, "day", "factor").groupBy("event_type").agg(F.round(F.avg("corrected"), 6).alias("corrected"))


register(
    "time_corrected",
    _time_corrected,
    """WITH k AS (SELECT event_type, epoch_us(date_trunc('day', ts)) / 1e6 AS t, 100 / avg(value) AS f FROM events WHERE value > 150 GROUP BY 1, 2), e AS (SELECT event_type, value, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type IN (SELECT event_type FROM k)),
p AS (SELECT e.*, k.t AS t0, k.f AS f0 FROM e ASOF LEFT JOIN k ON e.event_type = k.event_type AND e.t >= k.t), n AS (SELECT p.*, k.t AS t1, k.f AS f1 FROM p ASOF LEFT JOIN k ON p.event_type = k.event_type AND p.t < k.t)
SELECT event_type, round(avg(value * CASE WHEN t0 IS NULL THEN f1 WHEN t1 IS NULL THEN f0 ELSE f0 + (t - t0) / (t1 - t0) * (f1 - f0) END), 6) AS corrected FROM n GROUP BY 1""",
)
register("sessions", lambda s, d: _events(s, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n"),
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
register("sliding_windows", lambda s, d: _events(s, d).groupBy("event_type", F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select("event_type", F.col("w.start").alias("start"), "n", "mean"),
    "WITH e AS (SELECT event_type, value, to_timestamp(floor(epoch_us(ts) / 1e6 / 21600) * 21600 - o)::TIMESTAMP AS start FROM events, (VALUES (0), (21600)) v(o)) SELECT event_type, start, count(*) AS n, round(avg(value), 6) AS mean FROM e GROUP BY 1, 2")


def _vectors(s, d):
    return table(s, d, "embeddings", "vec_id", "embedding", "label")


_KNN = "WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), n AS (SELECT query, vec_id AS neighbour, list_distance(q.e::DOUBLE[], embedding::DOUBLE[]) AS distance FROM q JOIN embeddings ON vec_id <> query), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM n)"


def _nearest(s, d, k):
    v = _vectors(s, d)
    return K.nearest(v, v.where(F.col("vec_id") % 100 == 0), k)


register("knn_exact", lambda s, d: _round(_nearest(s, d, 10)), f"{_KNN} SELECT query, neighbour, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10")
_approximate = lambda s, d: K.nearest_approximately(_vectors(s, d), _vectors(s, d).where(F.col("vec_id") % 100 == 0), 10)
register("knn_approximate", lambda s, d: _round(_approximate(s, d)))
register("knn_recall", lambda s, d: K.recall(_approximate(s, d), _nearest(s, d, 10)))
register("shared_neighbours", lambda s, d: _round(K.shared_neighbour_graph(_nearest(s, d, 15))),
    f"{_KNN}, k AS (SELECT * FROM r WHERE rank <= 15), e AS (SELECT a.query AS x, a.neighbour AS y FROM k a WHERE a.neighbour IN (SELECT query FROM k)), w AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM e), l AS (SELECT query, list(neighbour) AS near FROM k GROUP BY 1) SELECT w.a, w.b, round(len(list_intersect(p.near, q.near)) / len(list_distinct(p.near || q.near))::DOUBLE, 6) AS weight FROM w JOIN l p ON p.query = w.a JOIN l q ON q.query = w.b")
register("knn_agreement", lambda s, d: _round(K.neighbour_agreement(_nearest(s, d, 15), _vectors(s, d))),
    f"{_KNN}, l AS (SELECT r.query, a.label AS own, b.label AS other, count(*) AS n FROM r JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = neighbour WHERE rank <= 15 GROUP BY ALL) SELECT query, round(sum(CASE WHEN own = other THEN n ELSE 0 END) / sum(n), 6) AS agreement, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM l GROUP BY 1")
register("centroids", lambda s, d: _round(K.centroids(_vectors(s, d), "label")), "SELECT label, coordinate, round(avg(x), 6) AS value FROM (SELECT label, unnest(range(len(embedding)))::INT AS coordinate, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
register("nearest_centroid", lambda s, d: _round(K.nearest_centroid(_vectors(s, d), "label")),
    "WITH c AS (SELECT label, list(v ORDER BY k) AS c FROM (SELECT label, k, avg(x) AS v FROM (SELECT label, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1), n AS (SELECT vec_id, c.label AS nearest, list_distance(embedding::DOUBLE[], c.c) AS distance FROM embeddings, c) SELECT vec_id, nearest, round(distance, 6) AS distance FROM n QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) = 1")
register("cluster_summary", lambda s, d: _round(K.summaries(_vectors(s, d), "label")),
    """WITH x AS (SELECT label, unnest(range(len(embedding)))::INT AS coordinate, unnest(embedding)::DOUBLE AS v FROM embeddings), w AS (SELECT coordinate, sum(v) AS s, count(*) AS n FROM x GROUP BY 1)
SELECT label, coordinate, count(*) AS n, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(avg(v), 6) AS mean, round((any_value(w.s) - sum(v)) / (any_value(w.n) - count(*)), 6) AS rest FROM x JOIN w USING (coordinate) GROUP BY 1, 2""")
register("cluster_abundance", lambda s, d: _round(K.abundance(_items(s, d, "l_returnflag", "l_linenumber"), "l_returnflag", "l_linenumber")), "SELECT l_returnflag, l_linenumber, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS percent FROM lineitem GROUP BY 1, 2")
register("partition_agreement", lambda s, d: _round(K.agreement(_items(s, d, "l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus"), 8),
    "WITH k AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(n) AS n FROM k GROUP BY 1), c AS (SELECT b, sum(n) AS n FROM k GROUP BY 1), x AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS l, sum(n) AS n FROM k), y AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS l FROM r), z AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS l FROM c) SELECT round((x.s - y.s * z.s / (x.n * (x.n - 1) / 2)) / ((y.s + z.s) / 2 - y.s * z.s / (x.n * (x.n - 1) / 2)), 8) AS ari, round(((ln(x.n) - y.l / x.n) + (ln(x.n) - z.l / x.n) - (ln(x.n) - x.l / x.n)) / sqrt((ln(x.n) - y.l / x.n) * (ln(x.n) - z.l / x.n)), 8) AS nmi FROM x, y, z")
register("kmeans", lambda s, d: K.kmeans(_vectors(s, d), 10))
register("pca", lambda s, d: K.principal(_vectors(s, d), 3))
register("som_map", lambda s, d: K.self_organising_map(_vectors(s, d), 6, 6))
