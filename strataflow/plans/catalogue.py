"""Queries of names, layouts, frequencies and quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.common import first_delivery, table
from strataflow.functions import scales
from strataflow.functions import strings as X
from strataflow.operators import assays as A
from strataflow.operators import designs as D
from strataflow.operators import gates as G
from strataflow.operators import joins as J
from strataflow.operators import quality as Q
from strataflow.operators import statistics as S
from strataflow.operators import temporal as T
from strataflow.plans.assays import _S, _control, _samples, _test, _valid
from strataflow.plans.comparisons import _items, _round
from strataflow.plans.populations import TREE, _B, _D, _X
from strataflow.plans.queries import LAYOUTS, register

_PRICE = ("l_returnflag", "l_quantity", "l_extendedprice")

# --- frequencies and limits -----------------------------------------------------------------------------------------------


def _frequencies(s, d):
    events = _items(s, d, "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return G.frequencies(events, TREE, "l_returnflag", of="dear", beads="taxed", bead_total=50000.0, volume=F.sum("l_discount"), dilution=F.max(F.col("l_quantity") / 10))


def _frequencies_sql():
    where = {"big": _B, "dear": _D, "cut": f"{_D} AND l_discount >= 0.05", "taxed": _X}
    base = {g.name: ((next(h for h in TREE if h.name == g.parent).parent) if g.parent else None) for g in TREE}
    rows = [(g.name, base[g.name]) for g in TREE if g.name in where]
    one = lambda name, above: (
        f"SELECT l_returnflag, '{name}' AS population, round(100.0 * count(*) FILTER (WHERE {where[name]}) / nullif({f'count(*) FILTER (WHERE {where[above]})' if above else 'count(*)'}, 0), 6) AS percent_grandparent, "
        f"round(100.0 * count(*) FILTER (WHERE {where[name]}) / nullif(count(*) FILTER (WHERE {_D}), 0), 6) AS percent_of, round(count(*) FILTER (WHERE {where[name]}) / sum(l_discount) * max(l_quantity / 10), 6) AS concentration, "
        f"round(count(*) FILTER (WHERE {where[name]}) * 50000.0 / nullif(count(*) FILTER (WHERE {_X}), 0) / sum(l_discount), 6) AS absolute FROM lineitem GROUP BY 1"
    )
    return " UNION ALL ".join(one(*r) for r in rows), [r[0] for r in rows]


_FREQUENCIES = _frequencies_sql()
register("population_frequencies", lambda s, d: _round(_frequencies(s, d).where(F.col("population").isin(*_FREQUENCIES[1]))), _FREQUENCIES[0])
register("dilutions", lambda s, d: _items(s, d, "l_linenumber").groupBy("l_linenumber").count().select(X.dilution(F.concat(F.lit("1:"), F.col("l_linenumber").cast("string"))).alias("dilution"), "count"),
    "SELECT CAST(l_linenumber AS DOUBLE) AS dilution, count(*) AS count FROM lineitem GROUP BY 1")
register("events_needed", lambda s, d: _items(s, d, "l_returnflag", "l_discount").groupBy("l_returnflag").agg(S.events_needed(100 * F.avg("l_discount")).alias("needed")),
    "SELECT l_returnflag, CAST(ceil(pow(100 / (100 * avg(l_discount)), 2)) AS BIGINT) AS needed FROM lineitem GROUP BY 1")
register("rank_limits", lambda s, d: _round(S.rank_limits(_items(s, d, *_PRICE), "l_extendedprice", F.col("l_returnflag") == "A"), 4),
    """WITH r AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) AS k, count(*) OVER () AS n FROM lineitem WHERE l_returnflag = 'A'), t AS (SELECT max(n) AS n, max(n) * 0.95::DOUBLE + 0.5 AS r FROM r),
e AS (SELECT n, r, (SELECT x FROM r WHERE k = least(floor(t.r), t.n)) AS a, (SELECT x FROM r WHERE k = least(ceil(t.r), t.n)) AS b FROM t) SELECT round(a + (b - a) * (r - floor(r)), 4) AS lob, n AS blanks FROM e""")
register("quantification_limit", lambda s, d: S.quantification_limit(_items(s, d, "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", 30.0),
    "WITH c AS (SELECT l_quantity AS q, 100 * stddev_samp(l_extendedprice) / abs(avg(l_extendedprice)) AS cv FROM lineitem GROUP BY 1) SELECT min(q) FILTER (WHERE q > coalesce((SELECT max(q) FROM c WHERE NOT coalesce(cv <= 30, false)), -1)) AS loq FROM c")
_FILLED = "WITH h AS (SELECT l_returnflag, CAST(greatest(0, least(59, floor(l_extendedprice / 120000 * 60))) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2), f AS (SELECT g.l_returnflag, CAST(b.bin AS INT) AS bin, coalesce(h.n, 0) AS count FROM (SELECT DISTINCT l_returnflag FROM lineitem) g CROSS JOIN range(60) b(bin) LEFT JOIN h ON h.l_returnflag = g.l_returnflag AND h.bin = b.bin), s AS (SELECT *, avg(count) OVER (PARTITION BY l_returnflag ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM f)"
_filled = lambda s, d: S.filled_histogram(_items(s, d, *_PRICE), ["l_returnflag"], "l_extendedprice", 0.0, 120000.0, 60, 2)
register("filled_histogram", lambda s, d: _round(_filled(s, d)), f"{_FILLED} SELECT l_returnflag, bin, count, round(smooth, 6) AS smooth FROM s")
register("density_peaks", lambda s, d: _round(S.density_peaks(_filled(s, d), ["l_returnflag"])),
    f"""{_FILLED}, n AS (SELECT *, smooth IS DISTINCT FROM lag(smooth) OVER (PARTITION BY l_returnflag ORDER BY bin) AS fresh, max(smooth) OVER (PARTITION BY l_returnflag) AS top FROM s), p AS (SELECT l_returnflag, bin, smooth AS height, top, lag(smooth) OVER w AS a, lead(smooth) OVER w AS b FROM n WHERE fresh WINDOW w AS (PARTITION BY l_returnflag ORDER BY bin))
SELECT l_returnflag, bin, round(height, 6) AS height, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY height DESC, bin) AS INT) AS rank FROM p WHERE height > coalesce(a, -1) AND height > coalesce(b, -1) AND height >= 0.05 * top AND height > 0""")
register("bandwidths", lambda s, d: _round(S.bandwidths(_items(s, d, *_PRICE), ["l_returnflag"], "l_extendedprice"), 4),
    "WITH b AS (SELECT l_returnflag, count(*)::DOUBLE AS n, stddev_samp(l_extendedprice) AS s, (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) / 1.34 AS h FROM lineitem GROUP BY 1) SELECT l_returnflag, round(0.9 * least(s, h) * pow(n, -0.2), 4) AS silverman, round(1.06 * s * pow(n, -0.2), 4) AS scott, round(0.9 * least(s, h) * pow(n, -0.2), 4) AS nrd0 FROM b")
register("event_densities", lambda s, d: S.event_densities(_items(s, d, *_PRICE), "l_quantity", "l_extendedprice", (0.0, 50.0), (0.0, 100000.0), 20).groupBy("l_returnflag").agg(F.min("density").alias("least"), F.max("density").alias("most"), F.sum("density").alias("total")),
    "WITH c AS (SELECT l_returnflag, count(*) OVER (PARTITION BY CAST(greatest(0, least(19, floor(l_quantity / 50 * 20))) AS INT), CAST(greatest(0, least(19, floor(l_extendedprice / 100000 * 20))) AS INT)) AS k FROM lineitem) SELECT l_returnflag, min(k) AS least, max(k) AS most, CAST(sum(k) AS BIGINT) AS total FROM c GROUP BY 1")
_HIGH, _LOW = "l_quantity >= 45", "l_quantity <= 5"
register("robust_z_prime", lambda s, d: _round(A.robust_z_prime(_items(s, d, *_PRICE), ["l_returnflag"], "l_extendedprice", F.expr(_HIGH), F.expr(_LOW))),
    f"SELECT l_returnflag, round(1 - 3 * 1.4826 * (mad(l_extendedprice) FILTER (WHERE {_HIGH}) + mad(l_extendedprice) FILTER (WHERE {_LOW})) / abs(median(l_extendedprice) FILTER (WHERE {_HIGH}) - median(l_extendedprice) FILTER (WHERE {_LOW})), 6) AS z_prime FROM lineitem GROUP BY 1")

# --- scales and names -----------------------------------------------------------------------------------------------------
_SHARE = "count(*) FILTER (WHERE l_quantity >= 40) / count(*)::DOUBLE"
register("share_scales", lambda s, d: _items(s, d, "l_suppkey", "l_quantity").groupBy("l_suppkey").agg((F.count_if(F.col("l_quantity") >= 40) / F.count("*")).alias("p")).select("l_suppkey", F.round(scales.logit(F.col("p")), 6).alias("logit"), F.round(scales.logit(F.col("p"), 0.25), 6).alias("kept"), F.round(scales.arcsine_root(F.col("p")), 6).alias("arcsine")),
    f"SELECT l_suppkey, round(ln(p / (1 - p)), 6) AS logit, round(ln(greatest(0.25, least(0.75, p)) / (1 - greatest(0.25, least(0.75, p)))), 6) AS kept, round(asin(sqrt(p)), 6) AS arcsine FROM (SELECT l_suppkey, {_SHARE} AS p FROM lineitem GROUP BY 1)")
register("bounded_scale", lambda s, d: _round(table(s, d, "customer", "c_mktsegment", "c_acctbal").groupBy("c_mktsegment").agg(F.avg(scales.bounded_scale(scales.arcsinh(150.0, 10000.0), 0.1, 0.9)(F.col("c_acctbal"))).alias("mean"))),
    "WITH k AS (SELECT c_mktsegment, (asinh(c_acctbal / 150) + 1) / (asinh(10000 / 150.0) + 1) AS y FROM customer) SELECT c_mktsegment, round(avg(greatest(0.1, least(0.9, y))), 6) AS mean FROM k GROUP BY 1")
_KIND = "CASE WHEN regexp_matches(n, '^TIME\\b') THEN 'time' WHEN regexp_matches(n, '\\b[FS]SC\\b|\\b[FS]SC-') THEN 'scatter' WHEN regexp_matches(n, '^[A-Z]{1,2}[0-9]{2,3}DI\\b') THEN 'mass' ELSE 'fluorescence' END"
_CHANNELS = f"SELECT technology, upper(concat_ws(' ', c.name, c.label)) AS n, c FROM (SELECT technology, unnest(channels) AS c FROM {_S}) WHERE c IS NOT NULL"
_channels = lambda s, d: _samples(s, d, "technology", "channels").select("sample_id", "technology", F.explode("channels").alias("c")).where("c IS NOT NULL")
register("channel_scales", lambda s, d: _channels(s, d).withColumn("kind", X.channel_kind(F.col("c.name"), F.col("c.label"))).withColumn("scale", scales.default_scale(F.col("kind"), F.col("technology"))).groupBy("technology", "kind", "scale").count(),
    f"WITH k AS (SELECT technology, {_KIND} AS kind FROM ({_CHANNELS})) SELECT technology, kind, CASE WHEN kind IN ('time', 'scatter') THEN 'linear' WHEN technology = 'mass' THEN 'arcsinh' ELSE 'logicle' END AS scale, count(*) AS count FROM k GROUP BY ALL")
_MARKER = "nullif(trim(regexp_replace(c.label, '(?i)[ _:-]+(FITC|PE|APC|BV[0-9]+|BUV[0-9]+|AF[0-9]+|PerCP|Alexa).*$', '')), '')"
register("markers", lambda s, d: _channels(s, d).groupBy(X.marker(F.col("c.label")).alias("marker")).agg(F.count_distinct("sample_id").alias("samples")).where("marker IS NOT NULL"),
    f"SELECT {_MARKER} AS marker, count(DISTINCT sample_id) AS samples FROM (SELECT sample_id, unnest(channels) AS c FROM {_S}) WHERE {_MARKER} IS NOT NULL GROUP BY 1")
register("channel_matches", lambda s, d: J.matched(_channels(s, d).where("c.name IS NOT NULL").select(F.col("c.name").alias("name")).distinct(), table(s, d, "detectors", "channel").select(F.col("channel").alias("name")).distinct(), "name", [F.col("name"), F.upper("name"), X.normalised(F.col("name"))]),
    f"WITH w AS (SELECT DISTINCT c.name AS name FROM (SELECT unnest(channels) AS c FROM {_S}) WHERE c.name IS NOT NULL), k AS (SELECT DISTINCT channel AS m FROM detectors), n AS (SELECT name, regexp_replace(lower(regexp_replace(name, '\\.[A-Za-z0-9]{{1,4}}$', '')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS x FROM w), l AS (SELECT m, regexp_replace(lower(regexp_replace(m, '\\.[A-Za-z0-9]{{1,4}}$', '')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS x FROM k) SELECT w.name AS wanted, coalesce((SELECT min(m) FROM k WHERE m = w.name), (SELECT min(m) FROM k WHERE upper(m) = upper(w.name)), (SELECT min(m) FROM l WHERE l.x = (SELECT min(x) FROM n WHERE n.name = w.name))) AS match FROM w")
register("detector_names", lambda s, d: _channels(s, d).select(X.detector(F.col("c.name")).alias("t")).where("t IS NOT NULL").groupBy("t.laser", "t.number", "t.measure", "t.order").count(),
    f"SELECT regexp_extract(n, p, 1) AS laser, CAST(regexp_extract(n, p, 2) AS INT) AS number, nullif(regexp_extract(n, p, 3), '') AS measure, CASE regexp_extract(n, p, 1) WHEN 'UV' THEN 355 WHEN 'V' THEN 405 WHEN 'B' THEN 488 WHEN 'YG' THEN 561 WHEN 'R' THEN 640 ELSE 808 END * 100 + CAST(regexp_extract(n, p, 2) AS INT) AS \"order\", count(*) AS count FROM (SELECT c.name AS n, '^(UV|IR|YG|V|B|R)([0-9]{{1,2}})(?:-([AHW]))?$' AS p FROM (SELECT unnest(channels) AS c FROM {_S})) WHERE regexp_matches(n, p) GROUP BY ALL")
register("name_amounts", lambda s, d: _valid(s, d).where("sample IS NOT NULL").select(X.amount(F.concat_ws("_", "sample", F.concat(F.col("dose").cast("int").cast("string"), F.lit("nM")))).alias("a")).where("a IS NOT NULL").groupBy("a.value", "a.unit").count(), None)


def _common_units(s, d):
    """The unit that most doses of a file have, and each dose in it."""
    rows = _valid(s, d).where("dose IS NOT NULL AND unit IS NOT NULL")
    units = rows.groupBy("file_name", "unit").count().groupBy("file_name").agg(F.max_by("unit", F.struct("count", "unit")).alias("common"))
    return units.groupBy("common").agg(F.count("*").alias("files"))


register("common_units", _common_units,
    LAYOUTS + ", k AS (SELECT file_name, g[7] AS unit, count(*) AS n FROM v WHERE reason IS NULL AND g[6] <> '' AND g[7] <> '' GROUP BY ALL), m AS (SELECT file_name, unit FROM k QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY n DESC, unit DESC) = 1) SELECT unit AS common, count(*) AS files FROM m GROUP BY 1")

# --- joins ----------------------------------------------------------------------------------------------------------------
register("groups_by_field", lambda s, d: J.by_field(_samples(s, d, "diagnostics"), F.col("diagnostics"), "sample_id").groupBy("group").agg(F.count("*").alias("samples")),
    f"SELECT g AS \"group\", count(*) AS samples FROM (SELECT DISTINCT sample_id, unnest(diagnostics) AS g FROM {_S}) WHERE g IS NOT NULL GROUP BY 1")


def _placed(s, d):
    wells = _samples(s, d, "keywords").select("sample_id", X.well(F.col("keywords")["WELL ID"]).alias("w")).where("w IS NOT NULL").select("sample_id", F.col("w.row").alias("well_row"), F.col("w.column").alias("well_column"))
    layout = _valid(s, d).select("well_row", "well_column").distinct()
    return J.with_layout(wells, layout, ["well_row", "well_column"]).groupBy("status").count()


register("layout_join", _placed,
    LAYOUTS + f", y AS (SELECT DISTINCT CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM v WHERE reason IS NULL), s AS (SELECT ascii(w) - 64 AS r, CAST(w[2:] AS INT) AS c FROM (SELECT keywords['WELL ID'] AS w FROM {_S}) WHERE w IS NOT NULL), j AS (SELECT CASE WHEN s.r IS NULL THEN 'unused' WHEN y.r IS NULL THEN 'unplaced' ELSE 'matched' END AS status FROM s FULL JOIN y ON s.r = y.r AND s.c = y.c) SELECT status, count(*) AS count FROM j GROUP BY 1")
register("latest_samples", lambda s, d: J.latest(table(s, d, "samples", "instrument_id", "acquired_at", "sample_id", "role"), ["instrument_id"], "acquired_at", "sample_id").select("instrument_id", "sample_id", "role"),
    "SELECT instrument_id, sample_id, role FROM samples WHERE acquired_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY acquired_at DESC, sample_id DESC) = 1")
_CLASSES = ["A", "N", "R"]
_class_rows = lambda s, d: J.class_table(_items(s, d, "l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag", _CLASSES)
register("class_table", _class_rows, "SELECT l_orderkey, " + ", ".join(f"CAST(max(CASE WHEN l_returnflag = '{c}' THEN 1 ELSE 0 END) AS INT) AS \"{c}\"" for c in _CLASSES) + " FROM lineitem GROUP BY 1")
register("class_members", lambda s, d: J.classes_of(_class_rows(s, d), "l_orderkey", _CLASSES).select("l_orderkey", "class"), "SELECT DISTINCT l_orderkey, l_returnflag AS class FROM lineitem")
register("split_samples", lambda s, d: J.split_samples(_items(s, d, "l_returnflag", "l_quantity"), "items", "l_returnflag").groupBy("sample").agg(F.count("*").alias("n")), "SELECT 'items ' || l_returnflag AS sample, count(*) AS n FROM lineitem GROUP BY 1")


def _concatenated(s, d):
    parts = {f: _items(s, d, "l_orderkey", "l_quantity", *extra).where(F.col("l_returnflag") == f) for f, extra in (("A", ["l_returnflag", "l_tax"]), ("R", ["l_returnflag"]))}
    return J.concatenated(parts, "l_orderkey").groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"), F.max("source_event").alias("last"))


register("concatenated", _concatenated, "SELECT l_returnflag AS sample_id, count(*) AS n, sum(l_quantity) AS total, max(l_orderkey) AS last FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
register("count_differences", lambda s, d: J.count_differences(*[_items(s, d, "l_suppkey", "l_linestatus").where(F.col("l_linestatus") == x).groupBy("l_suppkey").count() for x in "FO"], ["l_suppkey"], "count"),
    "SELECT l_suppkey, count(*) FILTER (WHERE l_linestatus = 'F') AS before, count(*) FILTER (WHERE l_linestatus = 'O') AS after, count(*) FILTER (WHERE l_linestatus = 'O') - count(*) FILTER (WHERE l_linestatus = 'F') AS difference FROM lineitem GROUP BY 1")


def _rules():
    return {"heavy": {"a": F.col("quantity") >= 25.5, "b": F.col("price") >= 38000}, "light": {"a": F.col("quantity") < 25.5, "b": F.col("price") < 38000}, "taxed": {"a": F.col("tax") >= 0.04}}



register("ranked_rules", lambda s, d: _round(D.ranked_rules(_items(s, d, "l_suppkey", "l_quantity", "l_extendedprice", "l_tax").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"), F.avg("l_tax").alias("tax")), "l_suppkey", _rules())),
    "WITH m AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_extendedprice) AS p, avg(l_tax) AS t FROM lineitem GROUP BY 1), r AS (SELECT l_suppkey, 'heavy' AS rule, ((q >= 25.5)::INT + (p >= 38000)::INT) / 2.0::DOUBLE AS score FROM m UNION ALL SELECT l_suppkey, 'light', ((q < 25.5)::INT + (p < 38000)::INT) / 2.0::DOUBLE FROM m UNION ALL SELECT l_suppkey, 'taxed', (t >= 0.04)::INT::DOUBLE FROM m) SELECT l_suppkey, rule, round(score, 6) AS score FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, rule) = 1")
register("sampled_share", lambda s, d: A.sampled_share(_items(s, d, "l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"], 0.1).groupBy("l_returnflag").count())

# --- quality --------------------------------------------------------------------------------------------------------------
_Q = "(SELECT DISTINCT ON (reading_id) * FROM qc_readings)"


def _readings(s, d):
    q = first_delivery(table(s, d, "qc_readings", "reading_id", "instrument_id", "model", "channel", "bin_start", "value", "event_count"), "reading_id")
    return J.with_dimension(q, table(s, d, "detectors", "model", "channel", "range_min", "range_max"), ["model", "channel"])




def _checks():
    return {"missing": F.col("value").isNull(), "margin": (F.col("value") <= F.col("range_min")) | (F.col("value") >= F.col("range_max")), "sparse": F.col("event_count") < 100}


_CHECKS = ("missing", "margin", "sparse")
_CHECKS_SQL = {"missing": "(value IS NULL)", "margin": "coalesce(value <= range_min OR value >= range_max, false)", "sparse": "coalesce(event_count < 100, false)"}
_SUM = " + ".join(f"{c}::INT" for c in _CHECKS_SQL.values())
_SUMMARY = (
    "SELECT instrument_id, count(*) AS n, "
    + ", ".join(f"100.0 * count(*) FILTER (WHERE {c}) / count(*) AS {k}_percent, 100.0 * count(*) FILTER (WHERE {c} AND {_SUM} = 1) / count(*) AS {k}_only" for k, c in _CHECKS_SQL.items())
    + f", 100.0 * count(*) FILTER (WHERE {_SUM} > 0) / count(*) AS flagged, 100 - 100.0 * count(*) FILTER (WHERE {_SUM} > 0) / count(*) AS score FROM {_Q} q JOIN detectors t ON q.model = t.model AND q.channel = t.channel GROUP BY 1"
)
_rounded = ", ".join(f"round({c}, 6) AS {c}" for c in [f"{k}_{x}" for k in _CHECKS for x in ("percent", "only")] + ["flagged", "score"])
register("qc_summary", lambda s, d: _round(Q.summary(_readings(s, d), ["instrument_id"], _checks())), f"SELECT instrument_id, n, {_rounded} FROM ({_SUMMARY})")
register("qc_findings", lambda s, d: _round(Q.findings(Q.summary(_readings(s, d), ["instrument_id"], _checks()), ["instrument_id"], list(_CHECKS), 0.5)),
    "WITH s AS (" + _SUMMARY + "), l AS (" + " UNION ALL ".join(f"SELECT instrument_id, '{k}' AS \"check\", {k}_percent AS percent FROM s" for k in _CHECKS) + ') SELECT instrument_id, "check", round(percent, 6) AS percent, CAST(row_number() OVER (PARTITION BY instrument_id ORDER BY percent DESC, "check") AS INT) AS rank FROM l WHERE percent > 0.5')
_BIN = "WITH b AS (SELECT event_type, CAST(floor(epoch_us(ts) / 1e6 / 21600) AS BIGINT) AS bin, CASE WHEN count(value) >= 10 THEN quantile_cont(value, 0.5) END AS v FROM events GROUP BY 1, 2), m AS (SELECT event_type, median(v) AS m, 1.4826 * mad(v) AS s FROM b GROUP BY 1), o AS (SELECT b.event_type, bin, v, coalesce(abs(v - m) > 2 * s, false) AS outlier FROM b JOIN m USING (event_type))"
_outliers = lambda s, d: Q.bin_outliers(T.bins(table(s, d, "events", "event_type", "ts", "value"), ["event_type"], "ts", "value", 21600.0), ["event_type"], "median", 2.0)
register("qc_bins", lambda s, d: _outliers(s, d).select("event_type", "bin", "outlier"), f"{_BIN} SELECT event_type, bin, outlier FROM o")
register("qc_runs", lambda s, d: Q.long_runs(_outliers(s, d), ["event_type"], "outlier", 5).select("event_type", "bin", "removed"),
    f"{_BIN}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bin) - row_number() OVER (PARTITION BY event_type, outlier ORDER BY bin) AS run FROM o) SELECT event_type, bin, outlier OR count(*) OVER (PARTITION BY event_type, outlier, run) < 5 AS removed FROM r")
register("review_order", lambda s, d: _round(Q.review_order(_items(s, d, "l_suppkey", "l_returnflag", "l_extendedprice").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_extendedprice").alias("mean")), ["l_returnflag"], "mean").select("l_returnflag", "l_suppkey", "score"), 5),
    "WITH a AS (SELECT l_returnflag, l_suppkey, avg(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2), m AS (SELECT l_returnflag, median(x) AS m, 1.4826 * mad(x) AS s FROM a GROUP BY 1) SELECT a.l_returnflag, l_suppkey, round(CASE WHEN s <> 0 THEN abs(x - m) / s END, 5) AS score FROM a JOIN m USING (l_returnflag)")
