"""Operators and functions against brute force, known values and round trips."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.functions import scales, special
from strataflow.functions import strings as X
from strataflow.operators import assays as A
from strataflow.operators import clusters as K
from strataflow.operators import compare as C
from strataflow.operators import gates as G
from strataflow.operators import joins as J
from strataflow.operators import ordered as O
from strataflow.operators import statistics as S
from strataflow.operators import temporal as T
from strataflow.sources import delimited, gatingml
from strataflow.sources.fcs import FcsSource, KeywordSource, acquisition, fcs_bytes, read_text, spillover

NAN, INF = float("nan"), float("inf")


def test_gates_drop_missing_values_and_keep_edges(spark):
    df = spark.createDataFrame([("s", 0.0, 0.0), ("s", 1.0, 0.5), ("s", NAN, 0.5), ("s", None, 0.5), ("s", INF, 0.5), ("s", -INF, 0.5), ("t", 0.5, 0.5)], "sample string, x double, y double")
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    gates = [
        G.Gate("r", "rectangle", ("x",), {"min": [0.0], "max": [1.0]}), G.Gate("high", "split", ("x",), {"at": 0.5, "side": "high"}), G.Gate("low", "split", ("x",), {"at": 0.5, "side": "low"}),
        G.Gate("p", "polygon", ("x", "y"), {"vertices": square}), G.Gate("e", "ellipse", ("x", "y"), {"center": [0.0, 0.0], "inverse": [[1.0, 0.0], [0.0, 0.0]], "distance": 1.0}),
        G.Gate("none", "and"), G.Gate("all", "not"), G.Gate("scoped", "rectangle", ("x",), {"min": [None], "max": [None]}, scope=("t",)),
    ]
    got = {name: [getattr(r, f"pop_{name}") for r in G.populations(df, gates, "sample").collect()] for name in [g.name for g in gates]}
    assert got["r"] == [True, False, False, False, False, False, True]
    assert got["high"] == [False, True, False, False, False, False, True] and got["low"] == [True, False, False, False, False, True, False]
    assert got["p"] == [True, True, False, False, False, False, True] and got["e"] == [True, True, False, False, False, False, True]
    assert not any(got["none"]) and all(got["all"]) and got["scoped"] == [None] * 6 + [True]
    with pytest.raises(ValueError):
        G.expressions([G.Gate("a", "and", operands=("b",)), G.Gate("b", "or", operands=("a",))])
    rows = {r.population: r for r in G.summary(df.limit(0).unionByName(df.where("sample = 't'")), gates[:2], "sample").collect()}
    assert rows["r"]["count"] == 1 and rows["r"].percent_parent == 100.0
    assert G.summary(df.limit(0), gates, "sample").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_quantiles_and_ranks_against_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.round(np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.pareto(0.5, 500)]), 2)
    groups = rng.choice(["a", "a", "a", "b", None], len(values)).tolist()
    df = spark.createDataFrame([(g, float(v)) for g, v in zip(groups, values)] + [("c", None), (None, None)], "g string, v double")
    probabilities = [0.0, 0.1587, 0.5, 0.9, 1.0]
    for r in O.quantiles(df, ["g"], {"v": F.col("v"), "w": -F.col("v")}, probabilities).collect():
        own = values[[g == r.g for g in groups]]
        if r.g == "c":
            assert (r.n_v, r.q_v) == (0, None)
        else:
            assert r.n_v == len(own) and np.allclose(r.q_v, np.quantile(own, probabilities)) and np.allclose(r.q_w, np.quantile(-own, probabilities))
    kept = [(g, v) for g, v in zip(groups, values) if g == "a"]
    ranks = {r.v: r["rank"] for r in O.average_ranks(df.where("g = 'a'"), [], "v", "g").collect()}
    own = np.array([v for _, v in kept])
    for v in rng.choice(own, 20):
        assert ranks[v] == (own < v).sum() + ((own == v).sum() + 1) / 2
    assert O.quantiles(df.limit(0), ["g"], {"v": F.col("v")}, [0.5]).count() == 0


def test_statistics_ignore_what_is_not_finite(spark):
    df = spark.createDataFrame([("g", x) for x in (1.0, 2.0, 4.0, None, NAN, INF, -INF)] + [("h", None)], "g string, v double")
    got = {r.g: r for r in S.describe(df, ["g"], ["v"], ["count", "median", "mean", "sd", "geomean"]).collect()}
    assert (got["g"]["count"], got["g"].median, round(got["g"].geomean, 9)) == (3.0, 2.0, 2.0) and got["h"]["count"] == 0 and got["h"].median is None
    assert S.mad(df.where("g = 'g'"), ["g"], "v").first().mad == 1.0
    assert C.ks(df.limit(0), ["g"], "v", F.lit(True), F.lit(True)).count() == 0


def test_as_of_and_spans_against_loops(spark):
    rng = np.random.default_rng(3)
    start = dt.datetime(2020, 1, 1)
    left = [(k, "ab"[k % 2], start + dt.timedelta(minutes=int(m))) for k, m in enumerate(rng.integers(0, 9000, 120))]
    right = [("ab"[k % 2], start + dt.timedelta(minutes=int(m)), float(m)) for k, m in enumerate(rng.choice(9000, 25, replace=False))]
    a, b = spark.createDataFrame(left, "id long, g string, t timestamp"), spark.createDataFrame(right, "g string, t timestamp, v double")
    want = {k: max(((t2, v) for h, t2, v in right if h == g and t2 <= t), default=(None, None))[1] for k, g, t in left}
    assert {r.id: r.v for r in J.as_of(a, b, ["g"], "t", "v").collect()} == want
    spans = b.selectExpr("g", "v AS span", "t AS start", "t + INTERVAL 90 MINUTES AS end")
    got = {(r.id, r.span) for r in J.within(a, spans, ["g"], "t", "start", "end", 1800).collect()}
    assert got == {(k, v) for k, g, t in left for h, t2, v in right if h == g and t2 <= t < t2 + dt.timedelta(minutes=90)}
    gaps = {(r.g, r.gap) for r in T.longest_gap(a, ["g"], "t").collect()}
    for g, gap in gaps:
        times = sorted({t for _, h, t in left if h == g})
        assert gap == max((y - x).total_seconds() for x, y in zip(times, times[1:]))


def test_adjusted_p_spreads_a_family(spark):
    """Against a loop, with ties, groups and null; and the tests of one family do not end in one task."""
    ps = [round(float(x), 3) for x in np.random.default_rng(8).random(1500) ** 2]
    n, order = len(ps), sorted(ps)
    want, low, high = {}, 1.0, 0.0
    for k in range(n, 0, -1):
        low = min(low, order[k - 1] * n / k)
        want[order[k - 1]] = [low, 0]
    for k in range(1, n + 1):
        high = max(high, order[k - 1] * (n - k + 1))
        want[order[k - 1]][1] = min(1.0, high)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = C.adjusted(spark.createDataFrame([(k, x) for k, x in enumerate(ps)], "id long, p double").repartition(4), "p")
        assert df.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    twice = spark.createDataFrame([(g, x) for g in (None, 1) for x in [*ps, None]], "g long, p double")
    for rows, size in ((df, n), (C.adjusted(twice, "p", ["g"]), 2 * n + 2)):
        got = rows.collect()
        assert len(got) == size
        for r in got:
            assert (r.bh is None and r.holm is None) if r.p is None else (r.bh, r.holm) == pytest.approx(tuple(want[r.p]))


def test_components_of_long_paths(spark):
    """Paths whose ids don't rise along the chain are one component each, however long they are."""
    falling = [1, *range(1000, 1, -1)]
    shuffled = (10_000 + np.random.default_rng(3).permutation(5000)).tolist()
    edges = [e for p in (falling, shuffled) for e in zip(p, p[1:])] + [(5, None)]
    got = {r.node: r.component for r in K.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == dict.fromkeys(falling, 1) | dict.fromkeys(shuffled, 10_000)


def test_components_and_neighbours_against_loops(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 140)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in K.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    points = rng.normal(size=(80, 5))
    df = spark.createDataFrame([(k, p.tolist(), k % 3) for k, p in enumerate(points)] + [(99, None, 0)], "vec_id long, embedding array<double>, label int")
    near = {}
    for r in K.nearest(df, df.where("vec_id % 10 = 0"), 4).collect():
        near.setdefault(r.query, []).append((r["rank"], r.neighbour))
    for q, found in near.items():
        d = np.linalg.norm(points - points[q], axis=1)
        d[q] = np.inf
        assert [n for _, n in sorted(found)] == np.argsort(d, kind="stable")[:4].tolist()


def test_sampling_is_exact_and_repeatable(spark):
    df = spark.range(5000).selectExpr("id", "IF(id % 10 < 8, 'hot', 'cold') AS g").unionByName(spark.createDataFrame([(9999, "one")], "id long, g string"))
    a, b = (sorted(map(tuple, A.sampled(df.repartition(n), ["g"], ["id"], 30, seed=4).collect())) for n in (2, 7))
    assert a == b and {g: sum(x[1] == g for x in a) for g in ("hot", "cold", "one")} == {"hot": 30, "cold": 30, "one": 1}


def test_scales_solve_their_equations():
    x = np.array([-5000.0, -3.0, 0.0, 1.0, 250.0, 1e5, 262144.0, NAN])
    y = scales.logicle_values(x)
    a, b, c, d, f, x1 = scales._logicle_constants(262144.0, 0.5, 4.5, 0.0)
    up = np.maximum(y, 2 * x1 - y)
    back = a * np.exp(b * up) - f - c * np.exp(-d * up)
    assert np.allclose(np.where(y >= x1, back, -back)[:-1], x[:-1], rtol=1e-9, atol=1e-6) and math.isnan(y[-1]) and abs(y[6] - 1) < 1e-9
    assert np.all(np.diff(y[:-1]) > 0) and np.all(np.diff(scales.hyperlog_values(x[:-1])) > 0) and abs(scales.hyperlog_values(np.array([262144.0]))[0] - 1) < 1e-9
    value, position = scales.biex_table()
    assert np.all(np.diff(value) > 0) and position[0] == 0 and position[-1] == 1


def test_distribution_functions_at_known_points():
    assert abs(special.student_two_sided(2.228138852, 10) - 0.05) < 1e-8 and abs(special.chi_square_upper(3.841458821, 1) - 0.05) < 1e-8
    assert abs(special.f_upper(4.102821, 2, 10) - 0.05) < 1e-6 and abs(special.normal_two_sided(1.959963985) - 0.05) < 1e-8
    assert np.allclose(special.poisson_interval(10), (4.795389, 18.390356), atol=1e-5) and special.poisson_interval(0)[0] == 0
    assert np.allclose(special.binomial_interval(3, 20), (0.032071, 0.378927), atol=1e-5) and special.binomial_interval(20, 20)[1] == 1
    assert abs(special.kolmogorov_upper(1.3581) - 0.05) < 1e-4


def test_strings(spark):
    df = spark.createDataFrame([(x,) for x in ("A1", "b-07", "AF48", "R02C03", "x", None)], "t string").select(X.well(F.col("t")).alias("w")).select("w", X.well_name(F.col("w.row"), F.col("w.column")).alias("n"))
    assert [(r.w and (r.w.row, r.w.column), r.n) for r in df.collect()] == [((1, 1), "A01"), ((2, 7), "B07"), ((32, 48), "AF48"), ((2, 3), "B03"), (None, None), (None, None)]
    q = spark.createDataFrame([("10 nM",), ("2,5 mL",), ("x",), (None,)], "t string").select(X.quantity(F.col("t")).alias("q"))
    assert [r.q and (r.q.value, r.q.unit) for r in q.collect()] == [(10.0, "nM"), (2.5, "mL"), None, None]
    names = spark.createDataFrame([("a10",), ("a2",), ("A1",)], "t string").orderBy(X.natural_key(F.col("t")))
    assert [r.t for r in names.collect()] == ["A1", "a2", "a10"]


def test_curve_fit_recovers_parameters():
    x = np.geomspace(0.01, 100, 14)
    b, low, high, mid, rest = A.fit_curve(x, A.log_logistic(x, 1.3, 5.0, 90.0, 2.0), np.ones(14))
    assert np.allclose((b, low, high, mid), (1.3, 5.0, 90.0, 2.0), rtol=1e-3) and rest < 1e-6


def test_fcs_files(spark, tmp_path):
    data = np.array([[1.5, -2.0], [3.0, 4.0], [5.0, 6.0]], "<f4")
    (tmp_path / "a.fcs").write_bytes(fcs_bytes(["X/Y", "Z"], data))
    words = "$MODE/L/$DATATYPE/I/$BYTEORD/4,3,2,1/$PAR/2/$TOT/2/$P1N/Z/$P1B/16/$P1E/4,1/$P1R/1024/$P2N/T/$P2B/32/$P2E/0,0/$P2R/100/$P2G/2.0/$BEGINDATA/512/"
    body = np.array([(0, 10), (512, 20)], [("z", ">u2"), ("t", ">u4")]).tobytes()
    (tmp_path / "b.fcs").write_bytes((f"FCS3.0    {58:>8}{58 + len(words):>8}{512:>8}{600:>8}{0:>8}{0:>8}/{words}").encode().ljust(512) + body)
    spark.dataSource.register(FcsSource)
    both = spark.read.format("fcs").load(str(tmp_path))
    assert both.columns == ["sample", "event", "Z"]
    assert [r.Z for r in both.orderBy("sample", "event").collect()] == [-2.0, 4.0, 6.0, 1.0, 100.0]
    one = spark.read.format("fcs").option("rows", 2).load(str(tmp_path / "a.fcs"))
    assert one.rdd.getNumPartitions() == 2 and [tuple(r)[2:] for r in one.orderBy("event").collect()] == [(1.5, -2.0), (3.0, 4.0), (5.0, 6.0)]
    second = spark.read.format("fcs").load(str(tmp_path / "b.fcs"))
    assert [r["T"] for r in second.orderBy("event").collect()] == [5.0, 10.0]
    assert read_text(b"|A|1||2|B||C|x|") == {"A": "1|2", "B|C": "x"}


def test_fcs_text_segments():
    """Delimiters inside values are doubled; writers that leave values empty are told by the parameters' keywords."""
    assert read_text(b"/A/x///B/y/") == {"A": "x/", "B": "y"}
    assert read_text(b"/A/x//y/B/2/") == {"A": "x/y", "B": "2"}
    assert read_text(b"/A/x////y/B/2/") == {"A": "x//y", "B": "2"}
    words = read_text(b"/$BYTEORD/1,2,3,4/$PAR/1/$TOT/1/$P1N/X/$P1S//$P1B/32/$P1R/1024/$P1E/0,0/")
    assert (words["$P1S"], words["$P1B"], words["$P1N"]) == ("", "32", "X")
    assert read_text(b"") == {}


def _fcs_file(words: str, body: bytes, start: int = 512, extra: str = "") -> bytes:
    return (f"FCS3.0    {58:>8}{57 + len(words):>8}{start:>8}{start + len(body) - 1:>8}{0:>8}{0:>8}{words}{extra}").encode().ljust(start) + body


def test_fcs_layouts(spark, tmp_path):
    """Several data sets, packed and ASCII values, masked integers, floats that hold decades, supplemental text."""
    head = "/$MODE/L/$BYTEORD/4,3,2,1/$BEGINDATA/512/"
    one = _fcs_file(head + "$DATATYPE/F/$PAR/1/$TOT/2/$P1N/X/$P1B/32/$P1R/10/$NEXTDATA/600/", np.array([1.5, 2.5], ">f4").tobytes())
    two = _fcs_file(head + "$DATATYPE/F/$PAR/1/$TOT/1/$P1N/X/$P1B/32/$P1R/10/$NEXTDATA/0/", np.array([7.5], ">f4").tobytes())
    bits = "".join(f"{a:010b}{b:06b}" for a, b in [(1000, 63), (5, 2), (1023, 0)])
    packed = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
    stext = "/$P1S/second/X Y/z/"
    files = {
        "many": one.ljust(600) + two,
        "packed": _fcs_file(head + "$DATATYPE/I/$PAR/2/$TOT/3/$P1N/X/$P1B/10/$P1R/1024/$P2N/Y/$P2B/6/$P2R/64/", packed),
        "ascii": _fcs_file(head + "$DATATYPE/A/$PAR/2/$TOT/2/$P1N/X/$P1B/3/$P1R/1000/$P2N/Y/$P2B/4/$P2R/10000/", b" 12 345 99 345"),
        "free": _fcs_file(head + "$DATATYPE/A/$PAR/2/$TOT/2/$P1N/X/$P1B/*/$P1R/1000/$P2N/Y/$P2B/*/$P2R/1000/", b"1 2, 3\n4"),
        "masked": _fcs_file(head + "$DATATYPE/I/$PAR/1/$TOT/2/$P1N/X/$P1B/16/$P1R/1000/", np.array([1 << 12 | 5, 900], ">u2").tobytes()),
        "decades": _fcs_file(head + "$DATATYPE/F/$PAR/2/$TOT/2/$P1N/X/$P1B/32/$P1R/10000/$P1E/4,1/$P1G/2/$P2N/Y/$P2B/32/$P2R/9/$P2E/4,1/", np.array([[2, 50], [3, 1]], ">f4").tobytes()),
        "more": _fcs_file(head + "$DATATYPE/F/$PAR/1/$TOT/1/$P1N/X/$P1B/32/$P1R/9/$BEGINSTEXT/400/$ENDSTEXT/418/", np.array([3], ">f4").tobytes()),
    }
    files["more"] = files["more"][:400] + stext.encode() + files["more"][419:]
    spark.dataSource.register(FcsSource)
    spark.dataSource.register(KeywordSource)
    got = {}
    for name, data in files.items():
        (tmp_path / f"{name}.fcs").write_bytes(data)
        df = spark.read.format("fcs").option("rows", 8).load(str(tmp_path / f"{name}.fcs"))
        got[name] = [tuple(r) for r in df.orderBy("sample", "event").collect()]
    assert got["many"] == [("many.fcs", 0, 1.5), ("many.fcs", 1, 2.5), ("many.fcs#2", 0, 7.5)]
    assert [r[2:] for r in got["packed"]] == [(1000.0, 63.0), (5.0, 2.0), (1023.0, 0.0)]
    assert [r[2:] for r in got["ascii"]] == [(12.0, 345.0), (99.0, 345.0)]
    assert [r[2:] for r in got["free"]] == [(1.0, 2.0), (3.0, 4.0)]
    assert [r[2:] for r in got["masked"]] == [(5.0,), (900.0,)]
    assert [r[2:] for r in got["decades"]] == [(50.0, 50.0), (500.0, 1.0)]
    words = {(r.sample, r.keyword): r.value for r in spark.read.format("fcs_keywords").load(str(tmp_path)).collect()}
    assert words["more.fcs", "X Y"] == "z" and words["more.fcs", "$P1S"] == "second" and words["many.fcs#2", "$TOT"] == "1"


def test_spillover_keywords(spark):
    rows = [("a", "SPILL", "2,X,Y,1,0.1,0.2,1"), ("a", "$COMP", "1,Z,9"), ("b", "$SPILLOVER", "2,X,Y,1,0.1"), ("c", "SPILLOVER", "1,X,no"), ("d", "$CYT", "Aurora"), ("e", None, None)]
    df = spark.createDataFrame(rows, "sample string, keyword string, value string")
    assert {tuple(r) for r in spillover(df).collect()} == {("a", "X", "X", 1.0), ("a", "X", "Y", 0.1), ("a", "Y", "X", 0.2), ("a", "Y", "Y", 1.0)}
    assert {r.sample: r.technology for r in acquisition(df).collect()}["d"] == "spectral"


def test_gating_documents_round_trip():
    gates = [G.Gate("r", "rectangle", ("x", "y"), {"min": [0.0, None], "max": [None, 5.0]}), G.Gate("p", "polygon", ("x", "y"), {"vertices": [(0.0, 0.0), (1.0, 0.0), (0.5, 2.0)]}, "r"), G.Gate("b", "or", parent="r", operands=("p", "r"))]
    assert gatingml.read(gatingml.write(gates)) == gates
    e = G.Gate("e", "ellipsoid", ("x", "y"), {"center": [1.0, 2.0], "inverse": [[2.0, 0.0], [0.0, 4.0]], "distance": 1.5})
    (back,) = gatingml.read(gatingml.write([e]))
    assert np.allclose(back.geometry["inverse"], e.geometry["inverse"]) and abs(back.geometry["distance"] - 1.5) < 1e-12


def test_delimited_dialects(spark, tmp_path):
    (tmp_path / "e.csv").write_text("FSC;SSC;name\n1,5;2;a\n3,25;;b\nx;4;c\n")
    assert delimited.sniff(["a,b", "1,2", "3,4"]) == delimited.Dialect(",", False, True) and delimited.sniff([]) == delimited.Dialect(",", False, False)
    assert [tuple(r) for r in delimited.read_events(spark, str(tmp_path / "e.csv")).collect()] == [(1.5, 2.0, "a"), (3.25, None, "b"), (None, 4.0, "c")]


def test_running_record_over_batches(spark, tmp_path):
    from strataflow.streaming import folder

    rng = np.random.default_rng(2)
    values = rng.normal(10, 2, 90)
    for k in range(3):
        spark.createDataFrame([("ab"[i % 2], float(v)) for i, v in enumerate(values[k * 30 : k * 30 + 30])], "g string, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    stream = folder.parquet_stream(spark, str(tmp_path), "t", per_trigger=1)
    got = {}
    query = folder.running_record(stream, "g", "v").writeStream.outputMode("update").foreachBatch(lambda b, _: got.update({r.g: r for r in b.collect()})).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    for i, g in enumerate("ab"):
        own = np.concatenate([values[k * 30 : k * 30 + 30][i::2] for k in range(3)])
        assert got[g].n == len(own) and abs(got[g].mean - own.mean()) < 1e-9 and abs(got[g].variance - own.var(ddof=1)) < 1e-9
