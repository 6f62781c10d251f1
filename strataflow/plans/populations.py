"""Queries on regions, populations, scales, corrections and statistics of channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.common import table
from strataflow.functions import scales
from strataflow.operators import compensation as comp
from strataflow.operators import gates as G
from strataflow.operators import ordered
from strataflow.operators import statistics as S
from strataflow.plans.queries import register

CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _items(s, d, *more):
    return table(s, d, "lineitem", "l_returnflag", *CHANNELS, *more)


def _count(gate):
    """Members of one gate per sample."""
    return lambda s, d: _items(s, d).groupBy("l_returnflag").agg(F.count_if(G.expressions([gate], "l_returnflag")[gate.name]).alias("n"))


def _sql_count(where):
    return f"SELECT l_returnflag, count(*) FILTER (WHERE {where}) AS n FROM lineitem GROUP BY 1"


RECT = G.Gate("rect", "rectangle", ("l_quantity", "l_discount"), {"min": [10.0, 0.02], "max": [30.0, None]})
register("gate_rectangle", _count(RECT), _sql_count("l_quantity >= 10 AND l_quantity < 30 AND l_discount >= 0.02"))
register("gate_range", _count(G.Gate("range", "rectangle", ("l_extendedprice",), {"min": [20000.0], "max": [None]})), _sql_count("l_extendedprice >= 20000"))
register("gate_split_high", _count(G.Gate("high", "split", ("l_quantity",), {"at": 25.0, "side": "high"})), _sql_count("l_quantity >= 25"))
register("gate_split_low", _count(G.Gate("low", "split", ("l_quantity",), {"at": 25.0, "side": "low"})), _sql_count("l_quantity < 25"))
register("gate_nd_rectangle", _count(G.Gate("nd", "rectangle", tuple(CHANNELS), {"min": [5.0, 5000.0, 0.0, 0.01], "max": [45.0, 60000.0, 0.08, 0.07]})), _sql_count("l_quantity >= 5 AND l_quantity < 45 AND l_extendedprice >= 5000 AND l_extendedprice < 60000 AND l_discount >= 0 AND l_discount < 0.08 AND l_tax >= 0.01 AND l_tax < 0.07"))
register("gate_category", _count(G.Gate("cat", "category", ("l_quantity",), {"values": [1, 7, 13]})), _sql_count("round(l_quantity) IN (1, 7, 13)"))

QUAD = G.quadrants("q", ("l_quantity", "l_extendedprice"), (25.0, 30000.0))
_Q = {"++": ("l_quantity >= 25", "l_extendedprice >= 30000"), "+-": ("l_quantity >= 25", "l_extendedprice < 30000"), "-+": ("l_quantity < 25", "l_extendedprice >= 30000"), "--": ("l_quantity < 25", "l_extendedprice < 30000")}
_TREE_SQL = "SELECT l_returnflag, population, n AS count, round(CASE WHEN p > 0 THEN 100.0 * n / p END, 6) AS percent_parent, round(CASE WHEN a > 0 THEN 100.0 * n / a END, 6) AS percent_total FROM ({})"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("percent_parent", "percent_total")})


def _tree_sql(rows):
    """rows: (name, predicate, parent predicate)."""
    return _TREE_SQL.format(" UNION ALL ".join(f"SELECT l_returnflag, '{n}' AS population, count(*) FILTER (WHERE {w}) AS n, count(*) FILTER (WHERE {p}) AS p, count(*) AS a FROM lineitem GROUP BY 1" for n, w, p in rows))


register("gate_quadrant", lambda s, d: _rounded(G.summary(_items(s, d), QUAD, "l_returnflag")), _tree_sql([(f"q{k}", " AND ".join(v), "true") for k, v in _Q.items()]))

VERTICES = [(5.0, 2000.0), (40.0, 8000.0), (48.0, 90000.0), (20.0, 40000.0), (22.0, 20000.0)]


def _polygon_sql(x, y, vs):
    edge, cross = [], []
    for (ax, ay), (bx, by) in zip(vs, vs[1:] + vs[:1]):
        edge.append(f"((({x} - {ax}) * {by - ay} - ({y} - {ay}) * {bx - ax}) = 0 AND {x} BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND {y} BETWEEN {min(ay, by)} AND {max(ay, by)})")
        if ay != by:
            cross.append(f"CASE WHEN ({ay} > {y}) <> ({by} > {y}) AND {x} < CAST({(bx - ax) / (by - ay)!r} AS DOUBLE) * ({y} - {ay}) + {ax} THEN 1 ELSE 0 END")
    return f"(({' OR '.join(edge)}) OR ({' + '.join(cross)}) % 2 = 1)"


register("gate_polygon", _count(G.Gate("poly", "polygon", ("l_quantity", "l_extendedprice"), {"vertices": VERTICES})), _sql_count(_polygon_sql("l_quantity", "l_extendedprice", VERTICES)))
register("gate_ellipse", _count(G.Gate("ell", "ellipse", ("l_quantity", "l_discount"), {"center": [25.0, 0.05], "inverse": [[0.01, -0.5], [-0.5, 900.0]], "distance": 1.0})), _sql_count("(l_quantity - 25) * (l_quantity - 25) * 0.01 + 2 * (l_quantity - 25) * (l_discount - 0.05) * -0.5 + (l_discount - 0.05) * (l_discount - 0.05) * 900 <= 1"))
register("gate_ellipsoid", _count(G.Gate("ed", "ellipsoid", ("l_quantity", "l_discount", "l_tax"), {"center": [25.0, 0.05, 0.04], "inverse": [[0.01, 0, 0], [0, 900.0, 0], [0, 0, 1000.0]], "distance": 1.5})), _sql_count("(l_quantity - 25) * (l_quantity - 25) * 0.01 + (l_discount - 0.05) * (l_discount - 0.05) * 900 + (l_tax - 0.04) * (l_tax - 0.04) * 1000 <= 2.25"))
register("gate_override", _count(G.Gate("ov", "rectangle", ("l_quantity",), {"min": [10.0], "max": [20.0]}, overrides={"A": {"min": [5.0], "max": [15.0]}, "R": {"min": [30.0], "max": [None]}})), _sql_count("CASE l_returnflag WHEN 'A' THEN l_quantity >= 5 AND l_quantity < 15 WHEN 'R' THEN l_quantity >= 30 ELSE l_quantity >= 10 AND l_quantity < 20 END"))
register("gate_scoped", _count(G.Gate("sc", "rectangle", ("l_quantity",), {"min": [10.0], "max": [20.0]}, scope=("A", "N"))), _sql_count("l_returnflag IN ('A', 'N') AND l_quantity >= 10 AND l_quantity < 20"))
register("gate_on_scale", _count(G.Gate("lg", "rectangle", ("l_extendedprice",), {"min": [0.6], "max": [0.9]}, scales=(scales.log(1.0, 1e6),))), _sql_count("log10(l_extendedprice) / 6 >= 0.6 AND log10(l_extendedprice) / 6 < 0.9"))

TREE = [
    G.Gate("big", "rectangle", ("l_quantity",), {"min": [20.0], "max": [None]}),
    G.Gate("dear", "rectangle", ("l_extendedprice",), {"min": [40000.0], "max": [None]}, "big"),
    G.Gate("cut", "rectangle", ("l_discount",), {"min": [0.05], "max": [None]}, "dear"),
    G.Gate("taxed", "rectangle", ("l_tax",), {"min": [0.04], "max": [None]}, "big"),
    G.Gate("both", "and", parent="big", operands=("dear", "taxed")),
    G.Gate("either", "or", parent="big", operands=("dear", "taxed")),
    G.Gate("neither", "not", parent="big", operands=("dear", "taxed")),
]
_B = "l_quantity >= 20"
_D, _X = f"{_B} AND l_extendedprice >= 40000", f"{_B} AND l_tax >= 0.04"
register(
    "gate_tree_summary",
    lambda s, d: _rounded(G.summary(_items(s, d), TREE, "l_returnflag")),
    _tree_sql([("big", _B, "true"), ("dear", _D, _B), ("cut", f"{_D} AND l_discount >= 0.05", _D), ("taxed", _X, _B), ("both", f"{_D} AND {_X}", _B), ("either", f"({_D}) OR ({_X})", _B), ("neither", f"{_B} AND NOT (({_D}) OR ({_X}))", _B)]),
)
_OFFSETS = (-0.02, -0.01, -0.005, 0.0, 0.005, 0.01, 0.02)
register(
    "gate_robustness",
    lambda s, d: G.robustness(_items(s, d), lambda o: F.col("l_extendedprice") / 100000 >= F.lit(0.4 + o), "l_returnflag").withColumn("percent", F.round("percent", 6)),
    " UNION ALL ".join(f"SELECT l_returnflag, CAST({o!r} AS DOUBLE) AS \"offset\", round(100.0 * count(*) FILTER (WHERE l_extendedprice / 100000 >= CAST({0.4 + o!r} AS DOUBLE)) / count(*), 6) AS percent FROM lineitem GROUP BY 1" for o in _OFFSETS),
)


def _flags(s, d):
    return G.populations(table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", *CHANNELS), TREE, "l_returnflag")


def _ids(s, d, name):
    return _flags(s, d).where(f"pop_{name}").select("l_orderkey", "l_linenumber")


_PICK = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE {}"
register("set_union", lambda s, d: _ids(s, d, "dear").union(_ids(s, d, "taxed")).distinct(), f"{_PICK.format(_D)} UNION {_PICK.format(_X)}")
register("set_intersect", lambda s, d: _ids(s, d, "dear").intersect(_ids(s, d, "taxed")), f"{_PICK.format(_D)} INTERSECT {_PICK.format(_X)}")
register("set_except", lambda s, d: _ids(s, d, "big").exceptAll(_ids(s, d, "dear")), f"{_PICK.format(_B)} EXCEPT ALL {_PICK.format(_D)}")


def _scaled(scale, channel):
    def run(s, d):
        df = table(s, d, "customer", "c_mktsegment", "c_acctbal").withColumn("y", scale(F.col(channel)))
        return df.groupBy("c_mktsegment").agg(F.round(F.min("y"), 8).alias("low"), F.round(F.max("y"), 8).alias("high"), F.round(F.avg("y"), 8).alias("mean"))

    return run


def _scaled_sql(y):
    return f"SELECT c_mktsegment, round(min(y), 8) AS low, round(max(y), 8) AS high, round(avg(y), 8) AS mean FROM (SELECT c_mktsegment, {y} AS y FROM customer) GROUP BY 1"


_ASINH = "sign({0}) * ln(abs({0}) + sqrt({0} * {0} + 1))"
register("scale_linear", _scaled(scales.linear(-1000.0, 10000.0), "c_acctbal"), _scaled_sql("(c_acctbal + 1000) / 11000"))
register("scale_arcsinh", _scaled(scales.arcsinh(150.0, 10000.0, -1000.0), "c_acctbal"), _scaled_sql(f"({_ASINH.format('(c_acctbal / 150)')} - asinh(-1000 / 150.0::DOUBLE)) / (asinh(10000 / 150.0::DOUBLE) - asinh(-1000 / 150.0::DOUBLE))"))
register("scale_fasinh", _scaled(scales.fasinh(10000.0, 4.0, 0.5), "c_acctbal"), _scaled_sql(f"({_ASINH.format('(c_acctbal * (exp(4 * ln(10::DOUBLE)) - exp(-4 * ln(10::DOUBLE))) / 2 / 10000)')} + 0.5 * ln(10::DOUBLE)) / (4.5 * ln(10::DOUBLE))"))
register("scale_log", lambda s, d: _items(s, d).withColumn("y", scales.log(1.0, 1e6)(F.col("l_extendedprice"))).groupBy("l_returnflag").agg(F.round(F.min("y"), 8).alias("low"), F.round(F.max("y"), 8).alias("high"), F.round(F.avg("y"), 8).alias("mean")), "SELECT l_returnflag, round(min(y), 8) AS low, round(max(y), 8) AS high, round(avg(y), 8) AS mean FROM (SELECT l_returnflag, log10(l_extendedprice) / 6 AS y FROM lineitem) GROUP BY 1")
register("scale_logicle", _scaled(scales.logicle(10000.0, 0.5, 4.5, 0.5), "c_acctbal"))
register("scale_hyperlog", _scaled(scales.hyperlog(10000.0, 0.5, 4.5, 0.5), "c_acctbal"))
register("scale_biex", _scaled(scales.biex(top=10000.0, width=-10.0), "c_acctbal"))
register(
    "scale_logicle_width",
    lambda s, d: ordered.quantiles(table(s, d, "customer"), ["c_mktsegment"], {"x": F.when(F.col("c_acctbal") < 0, F.col("c_acctbal"))}, [0.05]).select("c_mktsegment", F.round(scales.logicle_width(F.col("q_x")[0], 262144.0), 8).alias("w")),
    "SELECT c_mktsegment, round(CASE WHEN r IS NULL THEN 0.25 ELSE greatest(0, least((4.5 - log10(262144 / abs(r))) / 2, 2)) END, 8) AS w FROM (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.05) FILTER (WHERE c_acctbal < 0) AS r FROM customer GROUP BY 1)",
)

SPILL = [[1.0, 0.1, 0.0], [0.05, 1.0, 0.02], [0.0, 0.2, 1.0]]
TRIPLE = ["l_quantity", "l_discount", "l_tax"]
SPECTRA = {"dye_a": [1.0, 0.2, 0.05], "dye_b": [0.1, 1.0, 0.3]}


def _means(df, names):
    return df.groupBy("l_returnflag").agg(*[F.round(F.avg(n), 8).alias(n) for n in names])


def _linear_sql(weights):
    """weights: name -> weights over TRIPLE."""
    cols = ", ".join(f"round(avg({' + '.join(f'{c} * CAST({float(w)!r} AS DOUBLE)' for c, w in zip(TRIPLE, ws))}), 8) AS {n}" for n, ws in weights.items())
    return f"SELECT l_returnflag, {cols} FROM lineitem GROUP BY 1"


def _weights():
    import numpy as np

    inverse = np.linalg.inv(np.array(SPILL))
    s = np.array(list(SPECTRA.values()))
    ols = s.T @ np.linalg.inv(s @ s.T)
    return {f"{c}_comp": inverse[:, j] for j, c in enumerate(TRIPLE)}, {n: ols[:, k] for k, n in enumerate(SPECTRA)}


def _residual_sql():
    ols = _weights()[1]
    x = {n: "(" + " + ".join(f"{c} * CAST({float(w)!r} AS DOUBLE)" for c, w in zip(TRIPLE, ws)) + ")" for n, ws in ols.items()}
    off = " + ".join(f"pow({c} - " + " - ".join(f"{x[n]} * {SPECTRA[n][k]}" for n in SPECTRA) + ", 2)" for k, c in enumerate(TRIPLE))
    return f"SELECT l_returnflag, round(avg(sqrt({off}) / sqrt({' + '.join(f'{c} * {c}' for c in TRIPLE)})), 6) AS residual FROM lineitem GROUP BY 1"


register("compensation_apply", lambda s, d: _means(comp.compensated(_items(s, d), TRIPLE, SPILL), [f"{c}_comp" for c in TRIPLE]), _linear_sql(_weights()[0]))
register("unmix_ols", lambda s, d: _means(comp.unmixed(_items(s, d), TRIPLE, SPECTRA), list(SPECTRA)), _linear_sql(_weights()[1]))
register("unmix_nonnegative", lambda s, d: _means(comp.unmixed_nonnegative(_items(s, d), TRIPLE, SPECTRA), list(SPECTRA)))
register("unmix_residual", lambda s, d: comp.unmixed(_items(s, d), TRIPLE, SPECTRA).withColumn("r", comp.residual(TRIPLE, SPECTRA)).groupBy("l_returnflag").agg(F.round(F.avg("r"), 6).alias("residual")),
    _residual_sql())
register("ratio_channel", lambda s, d: _items(s, d).withColumn("r", comp.ratio_channel(F.col("l_extendedprice"), F.col("l_quantity"), 2.0, 100.0, 0.5)).groupBy("l_returnflag").agg(F.round(F.avg("r"), 6).alias("ratio")), "SELECT l_returnflag, round(avg(2 * (l_extendedprice - 100) / (l_quantity - 0.5)), 6) AS ratio FROM lineitem GROUP BY 1")
register("calibrated_channel", lambda s, d: table(s, d, "customer").withColumn("y", comp.calibrated(F.col("c_acctbal"), 1.1, 0.5)).groupBy("c_mktsegment").agg(F.round(F.avg("y"), 6).alias("calibrated")), "SELECT c_mktsegment, round(avg(sign(c_acctbal) * exp(0.5) * pow(abs(c_acctbal), 1.1)), 6) AS calibrated FROM customer GROUP BY 1")
register(
    "formula_channel",
    lambda s, d: _items(s, d).withColumn("y", F.expr("sqrt(l_quantity) * ln(l_extendedprice) + greatest(l_discount, l_tax) - pow(l_tax, 2)")).groupBy("l_returnflag").agg(F.round(F.avg("y"), 8).alias("formula")),
    "SELECT l_returnflag, round(avg(sqrt(l_quantity) * ln(l_extendedprice) + greatest(l_discount, l_tax) - pow(l_tax, 2)), 8) AS formula FROM lineitem GROUP BY 1",
)

STATS = ["count", "median", "mean", "geomean", "sd", "rsd", "cv", "rcv", "min", "max", "robust_sd"]


def _describe(s, d):
    df = S.describe(_items(s, d), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_tax"], STATS)
    return df.withColumns({k: F.round(k, 6) for k in STATS})


def _describe_sql(channel):
    x = channel
    q = lambda p: f"quantile_cont({x}, {p})"
    rsd = f"({q(0.8413)} - {q(0.1587)}) / 2"
    parts = {"count": f"count({x})::DOUBLE", "median": q(0.5), "mean": f"avg({x})", "geomean": f"exp(avg(ln({x})) FILTER (WHERE {x} > 0))", "sd": f"stddev_samp({x})", "rsd": rsd, "cv": f"100 * stddev_samp({x}) / abs(avg({x}))", "rcv": f"100 * {rsd} / abs({q(0.5)})", "min": f"min({x})", "max": f"max({x})", "robust_sd": f"{q(0.8413)} - {q(0.5)}"}
    return f"SELECT l_returnflag, '{x}' AS channel, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in parts.items()).replace("avg(ln(l_tax))", "avg(CASE WHEN l_tax > 0 THEN ln(l_tax) END)") + " FROM lineitem GROUP BY 1"


register("stats_describe", _describe, " UNION ALL ".join(_describe_sql(c) for c in ("l_quantity", "l_extendedprice", "l_tax")))
register("stats_percentiles", lambda s, d: S.percentiles(_items(s, d), ["l_returnflag"], "l_extendedprice", [1, 5, 25, 75, 95, 99]).select("l_returnflag", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in (1, 5, 25, 75, 95, 99)]), "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 6) AS p{p}" for p in (1, 5, 25, 75, 95, 99)) + " FROM lineitem GROUP BY 1")
register("stats_positive", lambda s, d: _items(s, d).groupBy("l_returnflag").agg(F.round(S.positive(F.col("l_extendedprice"), 40000.0), 6).alias("positive")), "SELECT l_returnflag, round(100.0 * count(*) FILTER (WHERE l_extendedprice >= 40000) / count(l_extendedprice), 6) AS positive FROM lineitem GROUP BY 1")
register("stats_mad", lambda s, d: S.mad(_items(s, d), ["l_returnflag"], "l_extendedprice").withColumn("mad", F.round("mad", 6)), "SELECT l_returnflag, round(mad(l_extendedprice), 6) AS mad FROM lineitem GROUP BY 1")
register(
    "stats_mode",
    lambda s, d: S.mode(_items(s, d), ["l_returnflag"], "l_extendedprice").withColumn("mode", F.round("mode", 4)),
    """WITH e AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.005) AS lo, quantile_cont(l_extendedprice, 0.995) AS hi FROM lineitem GROUP BY 1),
b AS (SELECT l_returnflag, lo, hi, least(CAST(floor((l_extendedprice - lo) / (hi - lo) * 256) AS BIGINT), 255) AS bin, count(*) AS n FROM lineitem JOIN e USING (l_returnflag) WHERE l_extendedprice BETWEEN lo AND hi GROUP BY ALL)
SELECT l_returnflag, round(lo + (bin + 0.5) * (hi - lo) / 256, 4) AS mode FROM b QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, bin) = 1""",
)
register(
    "stain_index",
    lambda s, d: S.stain_index(_items(s, d), ["l_returnflag"], "l_extendedprice", F.col("l_quantity") >= 25).withColumn("stain_index", F.round("stain_index", 6)),
    "SELECT l_returnflag, round((quantile_cont(l_extendedprice, 0.5) FILTER (WHERE l_quantity >= 25) - quantile_cont(l_extendedprice, 0.5) FILTER (WHERE l_quantity < 25)) / (2 * (quantile_cont(l_extendedprice, 0.8413) FILTER (WHERE l_quantity < 25) - quantile_cont(l_extendedprice, 0.1587) FILTER (WHERE l_quantity < 25)) / 2), 6) AS stain_index FROM lineitem GROUP BY 1",
)


def _wilson(s, d):
    n, k = F.count("*"), F.count_if(F.col("l_quantity") >= 40)
    t = _items(s, d).groupBy("l_returnflag").agg(k.alias("k"), n.alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return t.select("l_returnflag", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"), F.round(100 / F.sqrt("k"), 6).alias("count_cv"))


_Z = S.Z95
register("wilson_interval", _wilson, f"""SELECT l_returnflag, round((p + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4.0 * n * n))) / (1 + {_Z} * {_Z} / n), 8) AS low,
round((p + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4.0 * n * n))) / (1 + {_Z} * {_Z} / n), 8) AS high, round(100 / sqrt(k), 6) AS count_cv
FROM (SELECT l_returnflag, count(*) FILTER (WHERE l_quantity >= 40)::DOUBLE AS k, count(*)::DOUBLE AS n, k / n AS p FROM lineitem GROUP BY 1)""")
register(
    "detection_limits",
    lambda s, d: S.detection_limits(_items(s, d, "l_linestatus"), "l_linestatus", "l_extendedprice", F.col("l_returnflag") == "N").select(F.round("lob", 4).alias("lob"), F.round("lod", 4).alias("lod")),
    """WITH b AS (SELECT avg(l_extendedprice) + 1.645 * stddev_samp(l_extendedprice) AS lob FROM lineitem WHERE l_returnflag = 'N'),
g AS (SELECT count(*) AS n, var_samp(l_extendedprice) AS v FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_linestatus)
SELECT round(lob, 4) AS lob, round(lob + 1.645 * (SELECT sqrt(sum((n - 1) * v) / sum(n - 1)) FROM g), 4) AS lod FROM b""",
)
register("histogram_1d", lambda s, d: S.histogram(_items(s, d), ["l_returnflag"], "l_extendedprice", 1000.0, 80000.0, 40), "SELECT l_returnflag, CAST(greatest(0, least(39, floor((l_extendedprice - 1000) / 79000 * 40))) AS INT) AS bin, count(*) AS count FROM lineitem GROUP BY 1, 2")
register("histogram_2d", lambda s, d: S.histogram2d(_items(s, d), "l_quantity", "l_extendedprice", (0.0, 50.0), (0.0, 100000.0), 20), "SELECT CAST(greatest(0, least(19, floor(l_quantity / 50 * 20))) AS INT) AS x_bin, CAST(greatest(0, least(19, floor(l_extendedprice / 100000 * 20))) AS INT) AS y_bin, count(*) AS count FROM lineitem GROUP BY 1, 2")
register(
    "density_levels",
    lambda s, d: S.density_levels(S.histogram2d(_items(s, d), "l_quantity", "l_extendedprice", (0.0, 50.0), (0.0, 100000.0), 20), [0.25, 0.5, 0.9]),
    "WITH c AS (SELECT count(*) AS count FROM lineitem GROUP BY CAST(greatest(0, least(19, floor(l_quantity / 50 * 20))) AS INT), CAST(greatest(0, least(19, floor(l_extendedprice / 100000 * 20))) AS INT)), r AS (SELECT count, sum(count) OVER (ORDER BY count DESC RANGE UNBOUNDED PRECEDING) / sum(count) OVER () AS held FROM c) " + " UNION ALL ".join(f"SELECT CAST({f} AS DOUBLE) AS fraction, max(count) FILTER (WHERE held >= {f}) AS level FROM r" for f in (0.25, 0.5, 0.9)),
)
register(
    "table_pivot",
    lambda s, d: S.percentiles(table(s, d, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [50]).groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.max("p50"), 4)),
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5) FILTER (WHERE l_linestatus = 'F'), 4) AS \"F\", round(quantile_cont(l_extendedprice, 0.5) FILTER (WHERE l_linestatus = 'O'), 4) AS \"O\" FROM lineitem GROUP BY 1",
)
# The single-stain controls are the samples A and R; N is none and takes no part.
register(
    "spillover_medians",
    lambda s, d: comp.spillover(_items(s, d).withColumn("own", F.when(F.col("l_returnflag") == "A", "l_quantity").when(F.col("l_returnflag") == "R", "l_extendedprice")), "own", F.col("l_quantity") >= 25, ["l_quantity", "l_extendedprice"]).withColumn("spill", F.round("spill", 8)),
    """WITH m AS (SELECT CASE l_returnflag WHEN 'A' THEN 'l_quantity' ELSE 'l_extendedprice' END AS own,
quantile_cont(l_quantity, 0.5) FILTER (WHERE l_quantity >= 25) - quantile_cont(l_quantity, 0.5) FILTER (WHERE l_quantity < 25) AS q,
quantile_cont(l_extendedprice, 0.5) FILTER (WHERE l_quantity >= 25) - quantile_cont(l_extendedprice, 0.5) FILTER (WHERE l_quantity < 25) AS p FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1)
SELECT own, 'l_quantity' AS channel, round(q / CASE own WHEN 'l_quantity' THEN q ELSE p END, 8) AS spill FROM m UNION ALL SELECT own, 'l_extendedprice', round(p / CASE own WHEN 'l_quantity' THEN q ELSE p END, 8) FROM m""",
)
