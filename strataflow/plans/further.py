"""More queries: subtraction, ranks, regressions, wide tables, alternative specifications, graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataflow.common import table
from strataflow.operators import clusters as K
from strataflow.operators import compare as C
from strataflow.operators import gates as G
from strataflow.operators import ordered
from strataflow.operators import statistics as S
from strataflow.plans.comparisons import _KNN, _STEPS, _control, _items, _round, _sides, _test, _vectors
from strataflow.plans.populations import TREE, _B, _D, _X
from strataflow.plans.queries import register

register("sed", lambda s, d: _round(C.sed(_sides(s, d), ["l_returnflag"], "l_extendedprice", _control(), _test())),
    f"""{_STEPS}, d AS (SELECT g, v AS dx, c AS dc, t AS dt FROM f QUALIFY row_number() OVER (PARTITION BY g ORDER BY c - t DESC, v) = 1),
e AS (SELECT f.g, f.c AS c2, f.t AS t2 FROM f JOIN d USING (g) WHERE f.v <= dx AND dc > 0 AND dt > 0 QUALIFY row_number() OVER (PARTITION BY f.g ORDER BY f.c / dc - f.t / dt DESC, f.v) = 1)
SELECT g AS l_returnflag, round(100 * least(1, greatest(0, (dc - dt) / nullif(dc, 0) + (coalesce(c2, 0) * dt - dc * coalesce(t2, 0)) / nullif(dc * dc, 0))), 6) AS percent FROM d LEFT JOIN e USING (g)""")
register("rank_average", lambda s, d: ordered.average_ranks(_items(s, d, "l_returnflag", "l_linestatus", "l_quantity"), ["l_returnflag"], "l_quantity", "l_linestatus").select("l_returnflag", "l_linestatus", "l_quantity", "n", "ties", "rank"),
    "WITH r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rank, count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS ties FROM lineitem) SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n, ties, rank FROM r GROUP BY ALL")
register("spearman", lambda s, d: _round(C.spearman(_items(s, d, "l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice"), 8),
    "WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem) SELECT l_returnflag, round(corr(a, b), 8) AS spearman FROM r GROUP BY 1")
register("friedman", lambda s, d: _round(C.friedman(_items(s, d, "l_suppkey", "l_returnflag", "l_extendedprice"), "l_suppkey", "l_returnflag", "l_extendedprice", ["A", "N", "R"])),
    "WITH m AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2), r AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS k, rank() OVER (PARTITION BY l_suppkey ORDER BY m) + (count(*) OVER (PARTITION BY l_suppkey, m) - 1) / 2.0::DOUBLE AS rk FROM m), s AS (SELECT l_returnflag, sum(rk) AS r, count(*)::DOUBLE AS n FROM r WHERE k = 3 GROUP BY 1) SELECT round(12 / (max(n) * 12) * sum(r * r) - 12 * max(n), 6) AS chi2, 2 AS df FROM s")
register("regression", lambda s, d: _round(C.regression(_items(s, d, "l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice"), 4),
    "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2 FROM lineitem GROUP BY 1")
register("bootstrap_mean", lambda s, d: _round(C.bootstrap_mean(_items(s, d, "l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_returnflag"], ["l_orderkey", "l_linenumber"], "l_extendedprice"), 4))


def _wide(s, d):
    events = _items(s, d, "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    flags = G.expressions(TREE, "l_returnflag")
    counts = events.groupBy("l_returnflag").agg(F.count_if(flags["dear"]).alias("dear_count"), F.avg(F.when(flags["taxed"], F.col("l_extendedprice"))).alias("taxed_mean"), (100 * F.count_if(flags["cut"]) / F.count("*")).alias("cut_percent"))
    middle = ordered.quantiles(events, ["l_returnflag"], {"x": F.when(flags["big"], F.col("l_extendedprice"))}, [0.5])
    return counts.join(middle, "l_returnflag").select("l_returnflag", "dear_count", "taxed_mean", "cut_percent", F.col("q_x")[0].alias("big_median"))


register("table_wide", lambda s, d: _round(_wide(s, d)),
    f"SELECT l_returnflag, count(*) FILTER (WHERE {_D}) AS dear_count, round(avg(l_extendedprice) FILTER (WHERE {_X}), 6) AS taxed_mean, round(100.0 * count(*) FILTER (WHERE {_D} AND l_discount >= 0.05) / count(*), 6) AS cut_percent, round(quantile_cont(l_extendedprice, 0.5) FILTER (WHERE {_B}), 6) AS big_median FROM lineitem GROUP BY 1")


def _status(s, d):
    """Each reading against the limits of blank and detection."""
    items = _items(s, d, "l_linestatus", "l_returnflag", "l_extendedprice")
    limits = S.detection_limits(items, "l_linestatus", "l_extendedprice", F.col("l_returnflag") == "N")
    kind = F.when(F.col("l_extendedprice") <= F.col("lob"), "not detected").when(F.col("l_extendedprice") < F.col("lod"), "detected").otherwise("quantifiable")
    return items.crossJoin(F.broadcast(limits)).groupBy("l_returnflag", kind.alias("status")).count()  # one row of limits


register("limit_status", _status,
    """WITH b AS (SELECT avg(l_extendedprice) + 1.645 * stddev_samp(l_extendedprice) AS lob FROM lineitem WHERE l_returnflag = 'N'), g AS (SELECT count(*) AS n, var_samp(l_extendedprice) AS v FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_linestatus),
l AS (SELECT lob, lob + 1.645 * (SELECT sqrt(sum((n - 1) * v) / sum(n - 1)) FROM g) AS lod FROM b)
SELECT l_returnflag, CASE WHEN l_extendedprice <= lob THEN 'not detected' WHEN l_extendedprice < lod THEN 'detected' ELSE 'quantifiable' END AS status, count(*) AS count FROM lineitem, l GROUP BY 1, 2""")

_SPECS = [(p, q) for p in (30000.0, 40000.0, 50000.0) for q in (10.0, 20.0)]
register("alternative_specifications", lambda s, d: _items(s, d, "l_returnflag", "l_quantity", "l_extendedprice").groupBy("l_returnflag").agg(*[F.count_if((F.col("l_extendedprice") >= p) & (F.col("l_quantity") >= q)).alias(f"n{k}") for k, (p, q) in enumerate(_SPECS)]).select("l_returnflag", F.inline(F.array(*[F.struct(F.lit(p).alias("price"), F.lit(q).alias("quantity"), F.col(f"n{k}").alias("n")) for k, (p, q) in enumerate(_SPECS)]))),
    " UNION ALL ".join(f"SELECT l_returnflag, CAST({p} AS DOUBLE) AS price, CAST({q} AS DOUBLE) AS quantity, count(*) FILTER (WHERE l_extendedprice >= {p} AND l_quantity >= {q}) AS n FROM lineitem GROUP BY 1" for p, q in _SPECS))
register("state_medians", lambda s, d: _round(ordered.quantiles(_items(s, d, "l_returnflag", "l_linenumber", "l_extendedprice"), ["l_returnflag", "l_linenumber"], {"x": F.asinh(F.col("l_extendedprice") / 5)}, [0.5]).select("l_returnflag", "l_linenumber", F.col("n_x").alias("cells"), F.col("q_x")[0].alias("median")), 8),
    "SELECT l_returnflag, l_linenumber, count(l_extendedprice) AS cells, round(quantile_cont(asinh(l_extendedprice / 5), 0.5), 8) AS median FROM lineitem GROUP BY 1, 2")


def _curve(s, d):
    """A smoothed density: histogram counts under a Gaussian over the neighbouring bins."""
    bins = S.histogram(_items(s, d, "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", 0.0, 100000.0, 100)
    a, b = bins.alias("a"), bins.select("l_returnflag", F.col("bin").alias("other"), F.col("count").alias("n")).alias("b")
    near = a.join(b, "l_returnflag").where(F.abs(F.col("bin") - F.col("other")) <= 6)
    w = F.exp(-F.pow(F.col("bin") - F.col("other"), 2) / 8)
    return near.groupBy("l_returnflag", "bin").agg((F.sum(w * F.col("n"))).alias("density"))


register("density_curve", lambda s, d: _round(_curve(s, d)),
    "WITH h AS (SELECT l_returnflag, CAST(greatest(0, least(99, floor(l_extendedprice / 100000 * 100))) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT a.l_returnflag, a.bin, round(sum(exp(-pow(a.bin - b.bin, 2) / 8) * b.n), 6) AS density FROM h a JOIN h b ON a.l_returnflag = b.l_returnflag AND abs(a.bin - b.bin) <= 6 GROUP BY 1, 2")
register("knn_preserved", lambda s, d: _round(K.preserved(_vectors(s, d), _vectors(s, d).where(F.col("vec_id") % 100 == 0), F.slice("embedding", 1, 8), 10)),
    f"{_KNN}, p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding[1:8]::DOUBLE[], b.embedding[1:8]::DOUBLE[]), b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT r.query, round(count(p.neighbour) / 10.0::DOUBLE, 6) AS preserved FROM r LEFT JOIN p ON r.query = p.query AND r.neighbour = p.neighbour AND p.k <= 10 WHERE rank <= 10 GROUP BY 1")
register("cluster_enrichment", lambda s, d: _round(K.enrichment(_vectors(s, d), "label")),
    "WITH l AS (SELECT label, unnest(range(len(embedding)))::INT AS coordinate, unnest(embedding)::DOUBLE AS x FROM embeddings), w AS (SELECT coordinate, avg(x) AS m, stddev_samp(x) AS s FROM l GROUP BY 1) SELECT label, coordinate, round((avg(x) - any_value(m)) / any_value(s), 6) AS score FROM l JOIN w USING (coordinate) GROUP BY 1, 2")
register("layout_unpivot", lambda s, d: table(s, d, "part", "p_brand", "p_size").groupBy("p_brand").pivot("p_size", list(range(1, 51))).count().unpivot(["p_brand"], [str(k) for k in range(1, 51)], "size", "n").where("n IS NOT NULL"),
    "SELECT p_brand, CAST(p_size AS VARCHAR) AS size, count(*) AS n FROM part GROUP BY 1, 2")
register("graph_components", lambda s, d: K.components(table(s, d, "documents", "rev_id", "parent_rev_id").where("parent_rev_id IS NOT NULL"), "rev_id", "parent_rev_id"),
    "WITH RECURSIVE e AS (SELECT DISTINCT rev_id AS a, parent_rev_id AS b FROM documents WHERE parent_rev_id IS NOT NULL), n AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT u AS node, u AS c FROM n UNION SELECT n.v, r.c FROM r JOIN n ON n.u = r.node WHERE r.c < n.v) SELECT node, min(c) AS component FROM r GROUP BY 1")
register("revision_gaps", lambda s, d: table(s, d, "documents", "page_id", "rev_ts").groupBy("page_id", F.to_date("rev_ts").alias("day")).agg(F.count("*").alias("n")).withColumn("since", F.datediff("day", F.lag("day").over(Window.partitionBy("page_id").orderBy("day")))).where("since IS NOT NULL").groupBy("since").agg(F.count("*").alias("pages"), F.sum("n").alias("revisions")),
    "WITH k AS (SELECT page_id, CAST(rev_ts AS DATE) AS day, count(*) AS n FROM documents GROUP BY 1, 2), g AS (SELECT n, CAST(day - lag(day) OVER (PARTITION BY page_id ORDER BY day) AS INT) AS since FROM k) SELECT since, count(*) AS pages, CAST(sum(n) AS BIGINT) AS revisions FROM g WHERE since IS NOT NULL GROUP BY 1")
