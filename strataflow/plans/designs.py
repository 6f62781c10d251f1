"""Queries of designs, exact tests, models and batch diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions import special
from strataflow.operators import designs as D
from strataflow.plans.comparisons import _items, _round
from strataflow.plans.queries import register

_PRICE = ("l_returnflag", "l_linestatus", "l_extendedprice")


def _sided(s, d):
    return _items(s, d, "l_suppkey", "l_returnflag", "l_extendedprice")


register("one_sample_t", lambda s, d: _round(D.one_sample(_items(s, d, *_PRICE), ["l_returnflag"], "l_extendedprice", 38000.0)),
    "SELECT l_returnflag, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice) / sqrt(count(*)), 6) AS se, round((avg(l_extendedprice) - 38000) / (stddev_samp(l_extendedprice) / sqrt(count(*))), 6) AS t, count(*) - 1 AS df FROM lineitem GROUP BY 1")
register("mean_intervals", lambda s, d: _round(D.with_interval(D.one_sample(_items(s, d, *_PRICE), ["l_returnflag"], "l_extendedprice"), "mean", "se", "df"), 4))
_PAIRS = "WITH p AS (SELECT l_suppkey, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS a, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem GROUP BY 1 HAVING a IS NOT NULL AND b IS NOT NULL)"
_SIGNED = f"""{_PAIRS}, d AS (SELECT abs(a - b) AS m, a > b AS up FROM p WHERE a <> b), r AS (SELECT *, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY m)::DOUBLE AS t FROM d),
w AS (SELECT sum(CASE WHEN up THEN r ELSE 0 END) AS w, count(*)::DOUBLE AS n, sum(t * t - 1) AS tie FROM r)"""
register("signed_rank", lambda s, d: _round(D.signed_rank(D.pairs_of(_sided(s, d), "l_suppkey", "l_returnflag", "l_extendedprice", ["A", "R"]))),
    f"{_SIGNED} SELECT round(w, 6) AS w, CAST(n AS BIGINT) AS pairs, round((w - n * (n + 1) / 4 - sign(w - n * (n + 1) / 4) * 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48), 6) AS z FROM w")
register("matched_pairs", lambda s, d: _round(D.pairs_of(_sided(s, d), "l_suppkey", "l_returnflag", "l_extendedprice", ["A", "N", "R"])),
    "SELECT * FROM (SELECT l_suppkey, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 6) AS x0, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N'), 6) AS x1, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 6) AS x2 FROM lineitem GROUP BY 1) WHERE x0 + x1 + x2 IS NOT NULL")
register("mann_whitney_exact", lambda s, d: _round(D.mann_whitney_p(_items(s, d, "l_partkey", "l_linestatus", "l_extendedprice"), ["l_partkey"], "l_linestatus", "l_extendedprice", "F", "O"), 8))
_FISHER = """WITH c AS (SELECT l_suppkey, count(*) FILTER (WHERE l_quantity >= 25 AND l_linestatus = 'F') AS a, count(*) FILTER (WHERE l_quantity >= 25 AND l_linestatus <> 'F') AS b, count(*) FILTER (WHERE l_quantity < 25 AND l_linestatus = 'F') AS c, count(*) FILTER (WHERE l_quantity < 25 AND l_linestatus <> 'F') AS d FROM lineitem GROUP BY 1),
k AS (SELECT *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS k FROM c),
l AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) AS g FROM k),
h AS (SELECT *, max(CASE WHEN k = a THEN g END) OVER (PARTITION BY l_suppkey) AS o FROM l)
SELECT l_suppkey, a AS "both", b AS "first", c AS "second", d AS "none", round(a * d / nullif(b * c, 0)::DOUBLE, 6) AS odds, round(least(1, sum(exp(g)) FILTER (WHERE g <= o + 1e-7)), 6) AS p FROM h GROUP BY ALL"""
register("fisher_exact", lambda s, d: _round(D.fisher(_items(s, d, "l_suppkey", "l_quantity", "l_linestatus"), ["l_suppkey"], F.col("l_quantity") >= 25, F.col("l_linestatus") == "F")), _FISHER)
_LEVELS = "WITH m AS (SELECT l_returnflag AS g, count(*)::DOUBLE AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1)"
register("level_pairs", lambda s, d: _round(D.level_pairs(_items(s, d, *_PRICE), "l_returnflag", "l_extendedprice"), 4),
    f"{_LEVELS} SELECT a.g AS a, b.g AS b, round(a.m - b.m, 4) AS difference, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 4) AS t, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 4) AS df FROM m a JOIN m b ON a.g < b.g")
register("post_hoc", lambda s, d: _round(D.post_hoc(_items(s, d, *_PRICE), "l_returnflag", "l_extendedprice"), 6))
register("design_several", lambda s, d: _round(D.analysed(_items(s, d, *_PRICE), "l_returnflag", "l_extendedprice"), 4),
    f"""{_LEVELS}, w AS (SELECT *, n / v AS w FROM m), t AS (SELECT sum(w) AS sw, sum(w * m) / sum(w) AS grand, count(*) AS k FROM w),
f AS (SELECT sum(w * (m - grand) * (m - grand)) / (any_value(k) - 1) / (1 + 2 * (any_value(k) - 2) / (any_value(k) * any_value(k) - 1.0) * sum((1 - w / sw) * (1 - w / sw) / (n - 1))) AS f FROM w, t),
r AS (SELECT l_returnflag, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY l_extendedprice)::DOUBLE AS t FROM lineitem),
s AS (SELECT l_returnflag, sum(r) AS r, count(*)::DOUBLE AS n, sum(t * t - 1) AS tie FROM r GROUP BY 1),
h AS (SELECT (12 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - sum(tie) / (pow(sum(n), 3) - sum(n))) AS h FROM s)
SELECT 'several' AS design, 'welch anova' AS test, round(f, 4) AS statistic FROM f UNION ALL SELECT 'several', 'kruskal-wallis', round(h, 4) FROM h""")
register("design_paired", lambda s, d: _round(D.analysed(_sided(s, d).where("l_returnflag <> 'N'"), "l_returnflag", "l_extendedprice", "l_suppkey"), 4),
    f"{_SIGNED} SELECT 'paired two' AS design, 'wilcoxon' AS test, round(w, 4) AS statistic FROM w UNION ALL SELECT 'paired two', 'paired t', round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 4) FROM p")
register("block_anova", lambda s, d: _round(D.block_anova(_sided(s, d), "l_suppkey", "l_returnflag", "l_extendedprice", ["A", "N", "R"]), 4),
    """WITH m AS (SELECT l_suppkey AS b, l_returnflag AS g, avg(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2), c AS (SELECT * FROM m WHERE b IN (SELECT b FROM m GROUP BY b HAVING count(*) = 3)),
e AS (SELECT x, avg(x) OVER () AS z, avg(x) OVER (PARTITION BY g) AS gm, avg(x) OVER (PARTITION BY b) AS bm FROM c), t AS (SELECT count(*) / 3 AS n, sum(pow(gm - z, 2)) AS between_, sum(pow(x - gm - bm + z, 2)) AS error FROM e)
SELECT round(between_ / 2 / (error / (2 * (n - 1))), 4) AS f, 2 AS df, CAST(2 * (n - 1) AS BIGINT) AS df_error FROM t""")


def _model(s, d):
    items = D.design_matrix(_items(s, d, "l_returnflag", "l_quantity", "l_tax", "l_extendedprice"), {"l_returnflag": ["A", "N", "R"]}, ["l_quantity"])
    return items, ["intercept", "l_quantity", "l_tax"]


register("linear_model", lambda s, d: _round(D.linear_model(*_model(s, d), "l_extendedprice", ["l_returnflag"]).select("l_returnflag", "term", "coefficient", "se"), 3),
    """WITH m AS (SELECT l_returnflag AS g, count(*)::DOUBLE AS n, avg(l_quantity) AS a, avg(l_tax) AS b, avg(l_extendedprice) AS y, covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_tax, l_tax) AS bb, covar_pop(l_quantity, l_tax) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_tax, l_extendedprice) AS byy, covar_pop(l_extendedprice, l_extendedprice) AS yy FROM lineitem GROUP BY 1),
c AS (SELECT *, aa * bb - ab * ab AS q, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS ca, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS cb FROM m), e AS (SELECT *, n * (yy - ca * ay - cb * byy) / (n - 3) AS v FROM c)
SELECT g AS l_returnflag, 'l_quantity' AS term, round(ca, 3) AS coefficient, round(sqrt(v * bb / q / n), 3) AS se FROM e UNION ALL SELECT g, 'l_tax', round(cb, 3), round(sqrt(v * aa / q / n), 3) FROM e
UNION ALL SELECT g, 'intercept', round(y - ca * a - cb * b, 3), round(sqrt(v * (1 / n + (a * a * bb - 2 * a * b * ab + b * b * aa) / q / n)), 3) FROM e""")
register("design_matrix", lambda s, d: _model(s, d)[0].agg(*[F.sum(c).alias(c) for c in ("intercept", "l_returnflag_N", "l_returnflag_R", "l_quantity")]),
    "SELECT count(*)::DOUBLE AS intercept, count(*) FILTER (WHERE l_returnflag = 'N')::DOUBLE AS \"l_returnflag_N\", count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE AS \"l_returnflag_R\", sum(l_quantity) AS l_quantity FROM lineitem")


def _abundance(s, d):
    counts = _items(s, d, "l_suppkey", "l_linenumber", "l_linestatus").groupBy("l_suppkey", "l_linenumber", "l_linestatus").count()
    totals = counts.groupBy("l_suppkey", "l_linestatus").agg(F.sum("count").alias("total"))
    return counts.join(totals, ["l_suppkey", "l_linestatus"])


register("differential_abundance", lambda s, d: _round(D.differential_abundance(_abundance(s, d), "l_linenumber", F.col("l_linestatus") == "O", "count", "total")),
    """WITH c AS (SELECT l_suppkey, l_linenumber, l_linestatus = 'O' AS o, count(*)::DOUBLE AS k FROM lineitem GROUP BY ALL), t AS (SELECT *, sum(k) OVER (PARTITION BY l_suppkey, o) AS n FROM c),
p AS (SELECT *, sum(k) OVER (PARTITION BY l_linenumber, o) / sum(n) OVER (PARTITION BY l_linenumber, o) AS p, sum(n) OVER (PARTITION BY l_linenumber, o) AS tt FROM t),
f AS (SELECT l_linenumber, count(*) AS samples, sum(pow(k - n * p, 2) / (n * p * (1 - p))) AS x, max(p) FILTER (WHERE o) AS p1, max(p) FILTER (WHERE NOT o) AS p0, max(tt) FILTER (WHERE o) AS t1, max(tt) FILTER (WHERE NOT o) AS t0 FROM p GROUP BY 1),
e AS (SELECT *, ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)) AS b, greatest(1, x / (samples - 2)) AS s FROM f)
SELECT l_linenumber, samples, round(b, 6) AS log_odds, round(s, 6) AS dispersion, round(sqrt(s * (1 / (t1 * p1 * (1 - p1)) + 1 / (t0 * p0 * (1 - p0)))), 6) AS se, round(b / sqrt(s * (1 / (t1 * p1 * (1 - p1)) + 1 / (t0 * p0 * (1 - p0)))), 6) AS z FROM e""")
register("batch_to_pooled", lambda s, d: _round(D.to_pooled(_items(s, d, "l_suppkey", "l_extendedprice"), "l_suppkey", "l_extendedprice")),
    """WITH k AS (SELECT l_suppkey, l_extendedprice AS x, count(*) AS k FROM lineitem GROUP BY 1, 2), a AS (SELECT x, sum(k) AS a, sum(sum(k)) OVER (ORDER BY x) AS ca, sum(sum(k)) OVER ()::DOUBLE AS n FROM k GROUP BY 1),
b AS (SELECT *, sum(k) OVER (PARTITION BY l_suppkey ORDER BY x) AS cb, sum(k) OVER (PARTITION BY l_suppkey)::DOUBLE AS nb FROM k)
SELECT l_suppkey, round(max(greatest(abs(cb / nb - ca / n), abs((cb - k) / nb - (ca - a) / n))), 6) AS d, CAST(max(nb) AS BIGINT) AS n FROM b JOIN a USING (x) GROUP BY 1""")
register("binomial_intervals", lambda s, d: _round(_items(s, d, "l_returnflag", "l_quantity").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") >= 50).alias("k"), F.count("*").alias("n")).select("l_returnflag", "k", *[special.column(special._vector(lambda k, n, i=i: special.binomial_interval(int(k), int(n))[i]))(F.col("k"), F.col("n")).alias(c) for i, c in enumerate(("low", "high"))]), 6))
