"""Designs, exact tests, models, quality checks and names against known values and brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.functions import scales, special
from strataflow.functions import strings as X
from strataflow.operators import assays as A
from strataflow.operators import clusters as K
from strataflow.operators import compare as C
from strataflow.operators import designs as D
from strataflow.operators import joins as J
from strataflow.operators import ordered as O
from strataflow.operators import quality as Q
from strataflow.operators import statistics as S
from strataflow.operators import temporal as T
from strataflow.sources import delimited
from strataflow.streaming import folder

NAN, INF = float("nan"), float("inf")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_distributions_at_known_points():
    assert special.student_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert special.student_quantile(0.025, 3) == pytest.approx(-3.182446, abs=1e-5)
    assert special.student_quantile(0.5, 7) == 0 and special.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-5)
    assert special.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-9) and special.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-9)
    assert special.chi_square_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and special.f_upper(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)


@pytest.mark.parametrize("n,m", [(3, 4), (5, 5), (1, 6)])
def test_exact_u_against_all_draws(n, m):
    ranks = range(1, n + m + 1)
    us = [sum(c) - n * (n + 1) / 2 for c in itertools.combinations(ranks, n)]
    for u in range(n * m + 1):
        low, high = sum(x <= u for x in us) / len(us), sum(x >= u for x in us) / len(us)
        assert D._exact_u(u, n, m) == pytest.approx(min(1.0, 2 * min(low, high)))


def test_mann_whitney_takes_the_exact_p_without_ties_only(spark):
    rows = [("a", "x", float(v)) for v in (1, 2, 4)] + [("a", "y", float(v)) for v in (3, 5, 6, 7)] + [("b", "x", 1.0), ("b", "x", 2.0), ("b", "y", 2.0), ("b", "y", 3.0), (None, "x", 1.0), (None, "y", NAN)]
    got = {r.k: r for r in D.mann_whitney_p(frame(spark, rows, "k string, g string, v double"), ["k"], "g", "v", "x", "y").collect()}
    assert got["a"].u == 1.0 and got["a"].p == pytest.approx(4 / 35) and got["b"].p == pytest.approx(float(special.normal_two_sided(1.0 / math.sqrt(4 / 12 * (5 - 6 / 12)))), abs=1e-6)
    assert (got[None].n, got[None].m) == (1, 0)


def test_fisher_and_signed_rank(spark):
    cells = [(True, True)] * 1 + [(True, False)] * 9 + [(False, True)] * 11 + [(False, False)] * 3 + [(None, True)]
    r = D.fisher(frame(spark, cells, "a boolean, b boolean"), [], F.col("a"), F.col("b")).first()
    assert r.p == pytest.approx(0.002759, abs=1e-6) and (r["both"], r["first"], r["second"], r["none"]) == (1, 9, 11, 3)
    x = [(k, "a", float(v)) for k, v in enumerate([125, 115, 130, 140, 140, 115, 140, 125, 140, 135])] + [(k, "b", float(v)) for k, v in enumerate([110, 122, 125, 120, 140, 124, 123, 137, 135, 145])] + [(77, "a", 1.0), (None, "a", 1.0)]
    r = D.signed_rank(D.pairs_of(frame(spark, x, "k int, g string, v double"), "k", "g", "v", ["a", "b"])).first()
    assert (r.w, r.pairs) == (27.0, 9)


def test_single_rows_and_empty_groups(spark):
    """Groups of one row, of equal values and none at all give null statistics, not errors."""
    for rows in ([("a", "x", 1.0)], [("a", "x", 1.0), ("a", "y", 1.0)], [("a", "x", 1.0), ("a", "y", 1.0), ("a", "z", 2.0)], [(None, None, None)], []):
        df = frame(spark, rows, "key string, g string, v double")
        results = [C.two_sample(df, ["key"], "g", "v", "x", "y"), C.anova(df, ["key"], "g", "v"), C.welch_anova(df, "g", "v"), C.mann_whitney(df, ["key"], "g", "v", "x", "y"), C.kruskal(df, "g", "v"), C.friedman(df, "key", "g", "v", ["x", "y"])]
        results += [D.one_sample(df, ["key"], "v"), D.level_pairs(df, "g", "v"), D.block_anova(df, "key", "g", "v", ["x", "y"]), D.fisher(df, ["key"], F.col("g") == "x", F.col("v") > 0), D.to_pooled(df, "key", "v"), D.signed_rank(D.pairs_of(df, "key", "g", "v", ["x", "y"]))]
        results += [S.rank_limits(df, "v", F.lit(True)), S.bandwidths(df, ["key"], "v"), A.robust_z_prime(df, ["key"], "v", F.col("g") == "x", F.col("g") == "y"), S.mode(df, ["key"], "v"), D.linear_model(df.withColumn("one", F.lit(1.0)), ["one"], "v", ["key"])]
        for r in results:
            r.collect()


def test_design_choice_and_post_hoc(spark):
    rng = np.random.default_rng(2)
    rows = [(g, k, float(v)) for j, g in enumerate("pqr") for k, v in enumerate(rng.normal(j, 1, 12))] + [(None, 1, 2.0), ("p", 99, NAN)]
    df = frame(spark, rows, "g string, k int, v double")
    assert [r.design for r in D.analysed(df, "g", "v").collect()] == ["several"] * 2
    assert {r.test for r in D.analysed(df.where("g <> 'r'"), "g", "v").collect()} == {"welch", "mann-whitney"}
    assert {r.test for r in D.analysed(df, "g", "v", "k").collect()} == {"block anova", "friedman"}
    with pytest.raises(ValueError):
        D.analysed(df.where("g = 'p'"), "g", "v")
    got = {(r.a, r.b): r for r in D.post_hoc(df, "g", "v").collect()}
    assert set(got) == {("p", "q"), ("p", "r"), ("q", "r")} and all(r.p <= r.bh <= r.holm + 1e-12 for r in got.values()) and got["p", "r"].p < 0.01


def test_linear_model_against_numpy(spark):
    rng = np.random.default_rng(4)
    x, z = rng.normal(size=200), rng.normal(size=200) * 1e4
    y = 3 + 2 * x - 0.001 * z + rng.normal(size=200)
    rows = [("a" if k % 2 else None, 1.0, float(p), float(q), float(2 * p), float(r)) for k, (p, q, r) in enumerate(zip(x, z, y))] + [("a", 1.0, NAN, 0.0, 0.0, 1.0)]
    got = {(r.k, r.term): r for r in D.linear_model(frame(spark, rows, "k string, one double, x double, z double, twice double, y double"), ["one", "x", "z", "twice"], "y", ["k"]).collect()}
    for k, own in (("a", np.arange(200) % 2 == 1), (None, np.arange(200) % 2 == 0)):
        m = np.column_stack([np.ones(own.sum()), x[own], z[own]])
        b, rest, *_ = np.linalg.lstsq(m, y[own], rcond=None)
        se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * rest[0] / (own.sum() - 3))
        for t, v, e in zip(("one", "x", "z"), b, se):
            assert got[k, t].coefficient == pytest.approx(v, rel=1e-6) and got[k, t].se == pytest.approx(e, rel=1e-6)
        assert got[k, "twice"].coefficient is None


def test_batches_against_pooled(spark):
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(size=70).round(1), "b": rng.normal(0.5, 2, size=50).round(1), None: rng.normal(size=9).round(1)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("a", NAN)]
    pooled = np.concatenate(list(values.values()))
    for r in D.to_pooled(frame(spark, rows, "k string, v double"), "k", "v").collect():
        own = values[r.k]
        want = max(abs((own <= v).mean() - (pooled <= v).mean()) for v in pooled)
        assert r.d == pytest.approx(want) and r.n == len(own)


def test_statistics_leave_out_what_is_not_finite(spark):
    """Ranks and cumulative distributions, with null as a group."""
    rows = [(k, s, v) for k in ("a", None) for s, v in [("c", 1.0), ("c", 2.0), ("t", 3.0), ("t", NAN), ("c", INF), ("t", None)]]
    df = frame(spark, rows, "k string, s string, v double")
    assert {(r.k, r.d) for r in C.ks(df, ["k"], "v", F.col("s") == "c", F.col("s") == "t").collect()} == {("a", 1.0), (None, 1.0)}
    assert sorted(r["rank"] for r in O.average_ranks(df, ["k"], "v", "s").collect()) == [1.0, 1.0, 2.0, 2.0, 3.0, 3.0]


def test_buckets_follow_the_number_of_values(spark, monkeypatch):
    """More distinct values than the coarse buckets hold: they are parted further, and sums and quantiles stay exact."""
    monkeypatch.setattr(O, "TARGET", 5)
    rng = np.random.default_rng(6)
    values = np.unique(np.concatenate([rng.normal(size=3000), rng.pareto(0.7, 2000)]).round(6))
    df = frame(spark, [("g", float(v)) for v in values], "k string, v double")
    counted = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    assert O.bucketed(counted, ["k"], "v").select("bucket").distinct().count() > 2 * O.BUCKETS
    got = {r.v: r.cum_n for r in O.cumulative(counted, ["k"], "v", ["n"]).collect()}
    assert [got[v] for v in sorted(got)] == list(range(1, len(values) + 1))
    probabilities = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    assert np.allclose(O.quantiles(df, ["k"], {"v": F.col("v")}, probabilities).first().q_v, np.quantile(values, probabilities))


@pytest.mark.parametrize("size", [1, 2, 7, 40_000])
def test_quantiles_of_any_size(spark, size):
    rng = np.random.default_rng(size)
    values = np.where(rng.random(size) < 0.3, 0.5, rng.pareto(0.4, size))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probabilities = [0.0, 0.001, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.999, 1.0]
    for some in (probabilities, [0.37]):
        assert np.allclose(O.quantiles(df, [], {"v": F.col("v")}, some).first().q_v, np.quantile(values, some))


def test_smoothing_goes_by_bin_index(spark):
    """Missing bins are no neighbours; medians at the ends follow Tukey's rule."""
    df = frame(spark, [("g", 1, 1.0), ("g", 2, 5.0), ("g", 50, 9.0), (None, 1, 2.0), (None, 2, None)], "k string, bin long, v double")
    got = {(r.k, r.bin): r.smooth for r in T.smoothed(df, ["k"], "v", 1).collect()}
    assert got == {("g", 1): 3.0, ("g", 2): 3.0, ("g", 50): 9.0, (None, 1): 2.0, (None, 2): None}
    line = frame(spark, [(k, float(k)) for k in range(12)], "bin long, v double")
    assert [r.running_median for r in T.running_median(line, [], "v", 2).orderBy("bin").collect()] == [float(k) for k in range(12)]
    spiked = frame(spark, [(k, v) for k, v in enumerate([0.0, 1.0, 90.0, 3.0, 4.0, 5.0])], "bin long, v double")
    assert [r.running_median for r in T.running_median(spiked, [], "v", 1).orderBy("bin").collect()] == [0.0, 1.0, 3.0, 4.0, 4.0, 4.0]


def test_chain_breaks_where_it_was_touched(spark, monkeypatch):
    monkeypatch.setattr(T, "LINKS", 4)
    rows = [(g, f"2020-01-{1 + k // 5:02d} 00:00:{k % 60:02d}", k, f"e{k}") for g in ("a", None) for k in range(23)]
    df = frame(spark, rows, "g string, ts string, k int, what string").withColumn("ts", F.col("ts").cast("timestamp"))
    args = ["g"], ["ts", "k"], F.col("what")
    log = T.chained(df, *args).cache()
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    own, head, want = [sha(f"e{k}") for k in range(23)], "", []
    for b in range(0, 23, 4):
        link = head
        for o in own[b : b + 4]:
            link = sha(link + o)
            want.append(link)
        head = sha(head + sha("".join(own[b : b + 4])))
    assert [r.link for r in log.where("g = 'a'").orderBy("row").collect()] == want
    check = lambda d: {r.g: (r.entries, r.broken > 0, r.first_broken) for r in T.verified(d, *args).collect()}
    assert check(log) == {"a": (23, False, None), None: (23, False, None)}
    assert check(log.where("NOT (g <=> 'a' AND k = 7)"))["a"] == (22, True, 7)
    assert check(log.where("NOT (g <=> 'a' AND to_date(ts) = DATE'2020-01-02')"))["a"][1:] == (True, 5)
    assert check(log.withColumn("what", F.when((F.col("k") == 22) & (F.col("g") == "a"), "x").otherwise(F.col("what"))))["a"] == (23, True, 22)
    assert T.chained(df.limit(0), *args).count() == 0


def test_outlying_slices_against_the_plain_test():
    """The walk over sorted values takes the same values as finding median and MAD anew each time."""
    rng = np.random.default_rng(8)
    for _ in range(20):
        x = np.concatenate([rng.poisson(100, 60), rng.integers(150, 400, rng.integers(0, 5))]).astype(float)
        left, taken, last = list(range(len(x))), [], 0
        for k in range(int(len(x) * 0.2)):
            v = x[left]
            middle = np.median(v)
            spread = 1.4826 * np.median(np.abs(v - middle))
            if spread == 0:
                break
            far = max(left, key=lambda i: abs(x[i] - middle))
            n = len(left)
            t = float(special.student_quantile(1 - 0.01 / (2 * n), n - 2))
            score = abs(x[far] - middle) / spread
            taken.append(x[far])
            left.remove(far)
            if score > t * (n - 1) / math.sqrt((n - 2 + t * t) * n):
                last = k + 1
        assert sorted(x[A._extremes(x, 0.2, 0.01)]) == sorted(taken[:last])


def test_quality(spark):
    rows = [("s", True, False), ("s", True, True), ("s", False, None), ("s", None, False), ("t", False, False)]
    df = frame(spark, rows, "k string, a boolean, b boolean")
    got = {r.k: r for r in Q.summary(df, ["k"], {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert (got["s"].a_percent, got["s"].a_only, got["s"].b_percent, got["s"].b_only, got["s"].flagged, got["s"].score) == (50.0, 25.0, 25.0, 0.0, 50.0, 50.0) and got["t"].score == 100.0
    assert [(r.k, r.check, r["rank"]) for r in Q.findings(Q.summary(df, ["k"], {"a": F.col("a"), "b": F.col("b")}), ["k"], ["a", "b"]).orderBy("rank").collect()] == [("s", "a", 1), ("s", "b", 2)]
    bins = frame(spark, [(None, k, v) for k, v in enumerate([1.0, 1.1, 0.9, 1.0, 50.0, 1.0, NAN, 1.05])], "k string, bin long, v double")
    flagged = Q.bin_outliers(bins, ["k"], "v")
    assert [r.bin for r in flagged.where("outlier").collect()] == [4]
    assert sorted(r.bin for r in Q.long_runs(flagged, ["k"], "outlier", 4).where("removed").collect()) == [4, 5, 6, 7]


def test_names(spark):
    read = lambda c, *texts: [tuple(r.x) if isinstance(r.x, tuple) else r.x for r in frame(spark, [(t,) for t in texts], "t string").select(c(F.col("t")).alias("x")).collect()]
    assert read(X.dilution, "1:10", "2,5", "1 : 4", "0", "x", None) == [10.0, 2.5, 4.0, None, None, None]
    assert read(X.amount, "CD3_0.5ug.fcs", "run 450 V", "10nM_2ul", "none") == [(0.5, "ug"), (450.0, "v"), (2.0, "ul"), None]
    assert read(X.detector, "YG3-A", "UV12", "B1-H", "FSC-A") == [("YG", 3, "A", 56103), ("UV", 12, None, 35512), ("B", 1, "H", 48801), None]
    assert read(lambda c: X.channel_kind(c, F.lit(None).cast("string")), "Time", "FSC-A", "Er168Di", "FITC-A") == ["time", "scatter", "mass", "fluorescence"]
    assert read(X.marker, "CD4 BV421", "CD19-PE-Cy7", "CD3", " ") == ["CD4", "CD19", "CD3", None]
    logit = frame(spark, [(0.0,), (0.5,), (1.0,), (None,)], "p double").select(scales.logit(F.col("p")).alias("l"), scales.logit(F.col("p"), 0.1).alias("e"), scales.arcsine_root(F.col("p")).alias("a")).collect()
    assert [r.l for r in logit] == [-INF, 0.0, INF, None] and logit[2].e == pytest.approx(math.log(9)) and logit[2].a == pytest.approx(math.pi / 2)


def test_joins(spark):
    a = frame(spark, [(1, 1, 1), (2, 9, 9)], "s int, row int, column int")
    layout = frame(spark, [(1, 1, "x"), (1, 1, "x"), (2, 2, "y")], "row int, column int, what string")
    assert {(r.s, r.what, r.status) for r in J.with_layout(a, layout, ["row", "column"]).collect()} == {(1, "x", "matched"), (2, None, "unplaced"), (None, "y", "unused")}
    entries = frame(spark, [("d", 1, "a"), ("d", 3, "b"), ("d", 3, "c"), (None, 2, "z"), ("e", None, "q")], "dye string, at int, name string")
    assert {(r.dye, r.name) for r in J.latest(entries, ["dye"], "at", "name").collect()} == {("d", "c"), (None, "z")}
    labels = frame(spark, [(1, "A", 0.9), (1, "B", 0.1), (2, "B", 0.5)], "e int, c string, p double")
    wide = J.class_table(labels, "e", "c", ["A", "B"], "p")
    assert {(r.e, r.A, r.B) for r in wide.collect()} == {(1, 0.9, 0.1), (2, 0.0, 0.5)}
    assert {tuple(r) for r in J.classes_of(wide, "e", ["A", "B"]).collect()} == {(1, "A", 0.9), (2, "B", 0.5)}
    got = J.count_differences(labels.groupBy("c").count(), frame(spark, [("B", 9), ("D", 1)], "c string, count long"), ["c"], "count").collect()
    assert [(r.c, r.difference) for r in got] == [("B", 7), ("A", -1), ("D", 1)]


def test_limits_and_peaks(spark):
    df = frame(spark, [(float(k), "b") for k in range(1, 21)] + [(99.0, "x"), (NAN, "b")], "v double, g string")
    assert S.rank_limits(df, "v", F.col("g") == "b").first().lob == pytest.approx(19.5)
    assert S.rank_limits(df.where("g = 'x'"), "v", F.col("g") == "x").first().lob == 99.0
    levels = frame(spark, [(lv, lv * (1 + s)) for lv, spread in ((1.0, 0.5), (2.0, 0.05), (4.0, 0.3), (8.0, 0.02), (16.0, 0.01)) for s in (-spread, 0.0, spread)], "level double, v double")
    assert S.quantification_limit(levels, "level", "v", 20.0).first().loq == 8.0
    filled = S.filled_histogram(frame(spark, [(x,) for x in [0.5] * 3 + [4.5] * 9 + [5.5] * 9 + [9.5]], "v double"), [], "v", 0.0, 10.0, 10)
    assert [(r.bin, r.height) for r in S.density_peaks(filled, []).orderBy("rank").collect()] == [(4, 9.0), (0, 3.0), (9, 1.0)]


def test_approximate_neighbours_recall(spark):
    """Every row is indexed, and the recall against the exact search is at least 0.9, also with a third of the rows equal."""
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(12, 16)) * 3
    points = np.concatenate([middles[rng.integers(0, 12, 1400)] + rng.normal(size=(1400, 16)), np.repeat(middles[:1], 700, axis=0)])
    df = frame(spark, [(k, [float(x) for x in p]) for k, p in enumerate(points)] + [(9999, None)], "vec_id long, embedding array<float>").cache()
    queries = df.where("vec_id % 50 = 0")
    exact = K.nearest(df, queries, 10).cache()
    f = points.astype(np.float32).astype(float)
    for q in (0, 350, 1400):
        d = np.sqrt(((f - f[q]) ** 2).sum(axis=1))
        d[q] = INF
        want = sorted(range(len(f)), key=lambda i: (d[i], i))[:10]
        assert [r.neighbour for r in exact.where(F.col("query") == q).orderBy("rank").collect()] == want
    found = K.recall(K.nearest_approximately(df, queries, 10), exact).agg(F.avg("recall")).first()[0]
    assert found >= 0.9


def test_types_come_from_all_rows(spark, tmp_path):
    """A column whose first lines are texts and most of whose cells are numbers; a dialect that the first lines do not show."""
    (tmp_path / "e.csv").write_text("a;b\n" + "x;1\n" * 250 + "\n".join(f"{k},5;2" for k in range(600)) + "\n")
    rows = delimited.read_events(spark, str(tmp_path / "e.csv"))
    assert dict(rows.dtypes) == {"a": "double", "b": "double"} and rows.where("a IS NULL").count() == 250 and rows.agg(F.max("a")).first()[0] == 599.5


def test_landed_files_and_late_rows(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for name, text in (("a", "1234"), ("b", "12"), ("c", "")):
        (tmp_path / "f" / f"{name}.txt").write_text(text)
    now = folder.listing(spark, str(tmp_path / "f"))
    before = spark.createDataFrame(now.collect(), now.schema)
    assert before.count() == 2  # Spark lists no empty file
    (tmp_path / "f" / "b.txt").write_text("123456")
    done = folder.complete(before, folder.listing(spark, str(tmp_path / "f")))
    assert [r.path[-5:] for r in done.collect()] == ["a.txt"] and folder.complete(before, before, F.lit(3)).count() == 1
    # Three batches: rows behind the watermark of those before are dropped.
    at = str(tmp_path / "t" / "x.parquet")
    for k, (day, hours) in enumerate((("2020-01-02", range(0, 20)), ("2020-01-04", range(0, 2)), ("2020-01-01", range(0, 3)))):
        rows = [(f"{day} {h:02d}:00:00", "k", 1.0) for h in hours]
        spark.createDataFrame(rows, "ts string, g string, v double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(at)
        import time

        time.sleep(1.1)
    closed = folder.run_once(folder.windowed(folder.parquet_stream(spark, str(tmp_path / "t"), "x", 1), "ts", "g", "v", "6 hours"))
    got = {(r.w.start.day, r.w.start.hour): r.n for r in closed.collect()}
    assert got == {(2, 0): 6, (2, 6): 6, (2, 12): 6, (2, 18): 2}
    later = folder.parquet_stream(spark, str(tmp_path / "t"), "x", since="2100-01-01 00:00:00")
    assert folder.run_once(later.groupBy("g").agg(F.count("*").alias("n")), "complete").count() == 0
