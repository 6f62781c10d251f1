"""Queries on plates, names, codes, sampling, joins, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataflow.common import checkpoint_folder, first_delivery, table
from strataflow.functions import special
from strataflow.functions import strings as X
from strataflow.operators import assays as A
from strataflow.operators import compare as C
from strataflow.operators import joins as J
from strataflow.operators import rejects
from strataflow.operators import temporal as T
from strataflow.plans.comparisons import _control, _round, _test
from strataflow.plans.queries import LAYOUTS, register
from strataflow.sources.fcs import FcsSource, KeywordSource, acquisition
from strataflow.streaming import folder as stream


def _items(s, d, *columns):
    return table(s, d, "lineitem", *columns)


def _samples(s, d, *columns):
    return first_delivery(table(s, d, "samples", "sample_id", *columns), "sample_id")


_S = "(SELECT DISTINCT ON (sample_id) * FROM samples)"

register("well_parse", lambda s, d: _samples(s, d, "keywords").select("sample_id", X.well(F.col("keywords")["WELL ID"]).alias("w")).where("w IS NOT NULL").select("sample_id", "w.row", "w.column", X.well_name(F.col("w.row"), F.col("w.column")).alias("name")),
    f"SELECT sample_id, ascii(w) - 64 AS row, w[2:]::INT AS column, w[1:1] || lpad(CAST(w[2:]::INT AS VARCHAR), 2, '0') AS name FROM (SELECT sample_id, keywords['WELL ID'] AS w FROM {_S}) WHERE w IS NOT NULL")
register("acquired_at", lambda s, d: _samples(s, d, "keywords").select("sample_id", X.acquired(F.col("keywords")["$DATE"], F.col("keywords")["$BTIM"]).alias("acquired")).where("acquired IS NOT NULL"),
    f"SELECT sample_id, try_strptime(keywords['$DATE'] || ' ' || keywords['$BTIM'], '%d-%b-%Y %H:%M:%S') AS acquired FROM {_S} WHERE keywords['$DATE'] IS NOT NULL AND keywords['$BTIM'] IS NOT NULL")
register("deidentified", lambda s, d: _samples(s, d, "keywords").select("sample_id", F.map_filter("keywords", lambda k, v: k.isin("$CYT", "$DATE", "$BTIM", "WELL ID")).alias("kept")).where("kept IS NOT NULL").select("sample_id", F.explode("kept").alias("keyword", "value")),
    f"SELECT sample_id, e.key AS keyword, e.value AS value FROM (SELECT sample_id, unnest(map_entries(keywords)) AS e FROM {_S}) WHERE e.key IN ('$CYT', '$DATE', '$BTIM', 'WELL ID')")
register("channel_presence", lambda s, d: _samples(s, d, "channels", "technology").select("sample_id", "technology", F.explode("channels").alias("c")).where("c IS NOT NULL").groupBy("technology", F.col("c.name").alias("channel"), F.col("c.type").alias("type")).agg(F.count_distinct("sample_id").alias("samples")),
    f"SELECT technology, c.name AS channel, c.type AS type, count(DISTINCT sample_id) AS samples FROM (SELECT sample_id, technology, unnest(channels) AS c FROM {_S}) WHERE c IS NOT NULL GROUP BY ALL")
register("readings_with_samples", lambda s, d: _round(J.with_dimension(first_delivery(table(s, d, "qc_readings", "reading_id", "sample_id", "value"), "reading_id"), _samples(s, d, "role", "stain"), ["sample_id"]).groupBy("role").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), 4),
    f"SELECT role, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT DISTINCT ON (reading_id) * FROM qc_readings) q JOIN (SELECT sample_id, role FROM {_S}) USING (sample_id) GROUP BY 1")
register("natural_order", lambda s, d: _samples(s, d, "file_name").select("sample_id", X.natural_key(F.col("file_name")).alias("key")),
    f"SELECT sample_id, array_to_string(list_transform(regexp_extract_all(lower(file_name), '\\d+|\\D+'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(regexp_replace(p, '^0+(.)', '\\1'), 12, '0') ELSE p END), '') AS key FROM {_S}")
register("sample_roles", lambda s, d: _samples(s, d, "name").groupBy(X.role(F.col("name")).alias("guess")).count(),
    f"SELECT CASE WHEN regexp_matches(lower(name), 'unstained|\\bus\\b') THEN 'unstained' WHEN regexp_matches(lower(name), '\\bfmo\\b') THEN 'fmo' WHEN regexp_matches(lower(name), 'single|\\bcomp') THEN 'single stain' WHEN regexp_matches(lower(name), 'bead|rainbow') THEN 'beads' WHEN regexp_matches(lower(name), 'blank|vehicle|dmso|\\bneg') THEN 'control' ELSE 'sample' END AS guess, count(*) AS count FROM {_S} GROUP BY 1")
register("name_matches", lambda s, d: J.matched(table(s, d, "supplier").select(F.concat(F.lit("Maker of "), F.col("s_name")).alias("name")).unionByName(table(s, d, "supplier").select(F.upper("s_name").alias("name"))), table(s, d, "supplier").select(F.col("s_name").alias("name")), "name", [F.col("name"), F.lower("name"), X.normalised(F.regexp_replace("name", "^Maker of ", ""))]),
    "WITH k AS (SELECT s_name AS name, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS n FROM supplier), w AS (SELECT 'Maker of ' || s_name AS wanted, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS n FROM supplier UNION ALL SELECT upper(s_name), lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) FROM supplier) SELECT wanted, min(name) AS match FROM w JOIN k USING (n) GROUP BY ALL")
register("plate_duplicates", lambda s, d: J.duplicates(rejects.valid_rows(table(s, d, "layout_lines", "line_id", "file_name", "line_no", "raw")), ["file_name", "plate", "well_row", "well_column"]),
    LAYOUTS + "SELECT file_name, g[1] AS plate, CAST(r AS INT) AS well_row, CAST(c AS INT) AS well_column, count(*) AS count FROM v WHERE reason IS NULL GROUP BY ALL HAVING count(*) > 1")
SIZES = range(1, 51)
register("plate_map", lambda s, d: table(s, d, "part").groupBy("p_brand").pivot("p_size", list(SIZES)).count().fillna(0),
    "SELECT p_brand, " + ", ".join(f"count(*) FILTER (WHERE p_size = {k}) AS \"{k}\"" for k in SIZES) + " FROM part GROUP BY 1")


def _valid(s, d):
    return rejects.valid_rows(table(s, d, "layout_lines", "line_id", "file_name", "line_no", "raw"))


register("doses", lambda s, d: _valid(s, d).where("dose IS NOT NULL AND unit IS NOT NULL").select("line_id", X.quantity(F.concat_ws(" ", F.col("dose").cast("string"), "unit")).alias("q")).where("q IS NOT NULL").select("line_id", "q.value", "q.unit", F.round(F.log10(F.when(F.col("q.base") > 0, F.col("q.base"))), 6).alias("log_base")),
    LAYOUTS + """, z AS (SELECT line_id, CAST(replace(g[6], ',', '.') AS DOUBLE) AS value, g[7] AS unit FROM v WHERE reason IS NULL AND g[6] <> '' AND regexp_full_match(g[7], '[A-Za-zµ%/]+')),
p AS (SELECT *, CASE WHEN length(unit) > 1 THEN CASE unit[1] WHEN 'p' THEN -12 WHEN 'n' THEN -9 WHEN 'µ' THEN -6 WHEN 'u' THEN -6 WHEN 'm' THEN -3 WHEN 'k' THEN 3 ELSE 0 END ELSE 0 END AS e FROM z)
SELECT line_id, value, unit, CASE WHEN value > 0 THEN round(log10(value * pow(10.0, e)), 6) END AS log_base FROM p""")
_HIGH, _LOW = "l_quantity >= 45", "l_quantity <= 5"
register("z_prime", lambda s, d: _round(A.z_prime(_items(s, d, "l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", F.expr(_HIGH), F.expr(_LOW))),
    f"SELECT l_returnflag, round(1 - 3 * (stddev_samp(l_extendedprice) FILTER (WHERE {_HIGH}) + stddev_samp(l_extendedprice) FILTER (WHERE {_LOW})) / abs(avg(l_extendedprice) FILTER (WHERE {_HIGH}) - avg(l_extendedprice) FILTER (WHERE {_LOW})), 6) AS z_prime FROM lineitem GROUP BY 1")
register("proliferation", lambda s, d: _round(A.proliferation(_items(s, d, "l_returnflag", "l_linenumber").withColumn("g", F.col("l_linenumber") - 1), ["l_returnflag"], "g")),
    "WITH k AS (SELECT l_returnflag, l_linenumber - 1 AS g, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT *, n / pow(2, g) AS p FROM k) SELECT l_returnflag, round(sum(g * p) / sum(p), 6) AS division, round(sum(g * p) / sum(p) FILTER (WHERE g > 0), 6) AS proliferation, round(sum(n) / sum(p), 6) AS expansion, round(sum(n) FILTER (WHERE g > 0) / sum(p) FILTER (WHERE g > 0), 6) AS replication, round(100 * sum(p) FILTER (WHERE g > 0) / sum(p), 6) AS divided FROM p GROUP BY 1")


def _codes(s, d):
    v = table(s, d, "embeddings", "vec_id", "embedding")
    return A.codes(v, [F.col("embedding")[k].cast("double") for k in range(64)], 3, [str(k + 1) for k in range(64)])


register("codes", lambda s, d: _round(_codes(s, d).select("vec_id", "code", "separation")),
    "WITH x AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM x) SELECT vec_id, string_agg(i::VARCHAR, '+' ORDER BY i) FILTER (WHERE k <= 3) AS code, round(max(v) FILTER (WHERE k = 3) - max(v) FILTER (WHERE k = 4), 6) AS separation FROM r GROUP BY 1")
register("quantile_normalised", lambda s, d: _round(A.quantile_normalised(_items(s, d, "l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice").groupBy("l_returnflag").agg(F.avg("normalised").alias("mean"), F.min("normalised").alias("least"), F.max("normalised").alias("most")), 4),
    """WITH k AS (SELECT l_returnflag, unnest(range(1, 32)) AS k, unnest(quantile_cont(l_extendedprice, [x / 32.0 FOR x IN range(1, 32)])) AS q FROM lineitem GROUP BY 1), g AS (SELECT k, avg(q) AS g FROM k GROUP BY 1),
b AS (SELECT l_returnflag, k, q, g, lead(q) OVER w AS q2, lead(g) OVER w AS g2, lag(q) OVER w AS q0 FROM k JOIN g USING (k) WINDOW w AS (PARTITION BY l_returnflag ORDER BY k)),
m AS (SELECT i.l_returnflag, CASE WHEN b.k IS NULL THEN x + f.g - f.q WHEN b.q2 IS NULL THEN x + b.g - b.q ELSE b.g + (x - b.q) / (b.q2 - b.q) * (b.g2 - b.g) END AS y FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem) i JOIN b f ON f.l_returnflag = i.l_returnflag AND f.k = 1 LEFT JOIN b ON b.l_returnflag = i.l_returnflag AND x >= b.q AND (b.q2 IS NULL OR x < b.q2))
SELECT l_returnflag, round(avg(y), 4) AS mean, round(min(y), 4) AS least, round(max(y), 4) AS most FROM m GROUP BY 1""")
register("dose_response", lambda s, d: _round(A.dose_response(_items(s, d, "l_returnflag", "l_quantity", "l_extendedprice"), "l_returnflag", "l_quantity", "l_extendedprice"), 3))
register("outlying_slices", lambda s, d: A.outlying_slices(T.rates(table(s, d, "events"), ["event_type"], "ts", 3600.0), "event_type"))
register("sampled", lambda s, d: A.sampled(_items(s, d, "l_returnflag", "l_orderkey", "l_linenumber"), ["l_returnflag"], ["l_orderkey", "l_linenumber"], 100))
register("quotas", lambda s, d: A.quotas(table(s, d, "events", "event_type"), "event_type", 1000, 4000),
    "WITH c AS (SELECT event_type, count(*) AS count, least(count(*), 1000) AS want FROM events GROUP BY 1), w AS (SELECT sum(want) AS w FROM c) SELECT event_type, count, CAST(CASE WHEN w <= 4000 THEN want ELSE floor(want * 4000 / w) END AS BIGINT) AS quota FROM c, w")
_MARGIN = "SELECT DISTINCT ON (reading_id) q.*, t.range_min, t.range_max FROM qc_readings q JOIN detectors t ON q.model = t.model AND q.channel = t.channel"
register("margin_events", lambda s, d: _round(J.with_dimension(first_delivery(table(s, d, "qc_readings", "reading_id", "model", "channel", "value"), "reading_id"), table(s, d, "detectors", "model", "channel", "range_min", "range_max"), ["model", "channel"]).groupBy("model", "channel").agg(F.count_if(F.col("value") <= F.col("range_min") + 0.01 * (F.col("range_max") - F.col("range_min"))).alias("low"), F.count_if(F.col("value") >= F.col("range_max") - 0.01 * (F.col("range_max") - F.col("range_min"))).alias("high"), F.count("value").alias("n"))),
    f"SELECT model, channel, count(*) FILTER (WHERE value <= range_min + 0.01 * (range_max - range_min)) AS low, count(*) FILTER (WHERE value >= range_max - 0.01 * (range_max - range_min)) AS high, count(value) AS n FROM ({_MARGIN}) GROUP BY 1, 2")
register("as_of", lambda s, d: _round(J.as_of(table(s, d, "events", "event_id", "event_type", "ts").where("event_type <> 'view'").withColumn("one", F.lit(1)), table(s, d, "events", "event_type", "ts", "value").where("event_type = 'view'").withColumn("one", F.lit(1)).drop("event_type"), ["one"], "ts", "value").select("event_id", "value")),
    "SELECT a.event_id, round(b.value, 6) AS value FROM (SELECT * FROM events WHERE event_type <> 'view') a ASOF LEFT JOIN (SELECT ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1) b ON a.ts >= b.ts")


def _spans(s, d):
    big = table(s, d, "events", "event_id", "user_id", "ts", "value").where("value > 450")
    return big.select("user_id", F.col("event_id").alias("span"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 5 HOURS")).alias("end"))


register("within_spans", lambda s, d: J.within(table(s, d, "events", "event_id", "user_id", "ts"), _spans(s, d), ["user_id"], "ts", "start", "end", 3600).groupBy("span").agg(F.count("*").alias("n")),
    "SELECT b.event_id AS span, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts >= b.ts AND a.ts < b.ts + INTERVAL 5 HOUR WHERE b.value > 450 GROUP BY 1")


def _snapshots(s, d):
    """Two deliveries of the samples that overlap: what arrived in the first 14 days of a month, and what arrived from its 8th day on."""
    own = table(s, d, "samples", "sample_id", "event_count", "role", "received_at")
    return first_delivery(own.where(F.dayofmonth("received_at") <= 14), "sample_id"), first_delivery(own.where(F.dayofmonth("received_at") >= 8), "sample_id")


register("snapshot_differences", lambda s, d: J.differences(*_snapshots(s, d), ["sample_id"], ["event_count", "role"], 1e-12),
    """WITH a AS (SELECT DISTINCT ON (sample_id) * FROM samples WHERE day(received_at) <= 14), b AS (SELECT DISTINCT ON (sample_id) * FROM samples WHERE day(received_at) >= 8)
SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, CASE WHEN a.sample_id IS NULL THEN 'added' WHEN b.sample_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.sample_id = b.sample_id WHERE a.sample_id IS NULL OR b.sample_id IS NULL OR a.event_count IS DISTINCT FROM b.event_count OR a.role IS DISTINCT FROM b.role""")
register("content_store", lambda s, d: table(s, d, "result_files", "file_id", "content").groupBy(F.sha2("content", 256).alias("sha")).agg(F.min("file_id").alias("file_id"), F.max(F.length("content")).cast("long").alias("size")),
    "SELECT sha256(content) AS sha, min(file_id) AS file_id, max(length(content)) AS size FROM result_files GROUP BY 1")


def _test_p(s, d):
    t = C.two_sample(_items(s, d, "l_returnflag", "l_linestatus", "l_extendedprice"), ["l_returnflag"], "l_linestatus", "l_extendedprice", "F", "O")
    return _round(t.select("l_returnflag", "welch_t", special.column(special.student_two_sided)(F.col("welch_t"), F.col("welch_df")).alias("p")), 8)


register("welch_p", _test_p)
register("ks_p", lambda s, d: _round(C.ks(_items(s, d, "l_returnflag", "l_linestatus", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", _control(), _test()).where("d IS NOT NULL").join(_items(s, d, "l_returnflag", "l_linestatus").groupBy("l_returnflag").agg(F.count_if(_control()).alias("n"), F.count_if(_test()).alias("m")), "l_returnflag").select("l_returnflag", "d", special.column(special.kolmogorov_upper)(F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m"))) * F.col("d")).alias("p")), 8))
register("poisson_intervals", lambda s, d: _round(_items(s, d, "l_returnflag", "l_quantity").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") >= 50).alias("n")).select("l_returnflag", "n", special.column(special._vector(lambda n: special.poisson_interval(int(n))[0]))(F.col("n")).alias("low"), special.column(special._vector(lambda n: special.poisson_interval(int(n))[1]))(F.col("n")).alias("high")), 4))


def _fcs_files(s, d):
    """Events written as FCS files to the shared folder."""
    s.dataSource.register(FcsSource)
    s.dataSource.register(KeywordSource)
    path = f"{checkpoint_folder(s)}/fcs-{uuid.uuid4().hex}"
    _items(s, d, "l_quantity", "l_discount", "l_tax").write.format("fcs").mode("append").save(path)
    return path


def _fcs(s, d):
    """Counts and means per channel of events that were written as FCS files and read back."""
    df = s.read.format("fcs").load(_fcs_files(s, d))
    return df.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])


register("fcs_round_trip", _fcs, "SELECT count(*) AS n, round(avg(l_quantity::FLOAT::DOUBLE), 6) AS l_quantity, round(avg(l_discount::FLOAT::DOUBLE), 6) AS l_discount, round(avg(l_tax::FLOAT::DOUBLE), 6) AS l_tax FROM lineitem")
register("fcs_acquisition", lambda s, d: acquisition(s.read.format("fcs_keywords").load(_fcs_files(s, d))).groupBy("technology", "channels").agg(F.sum("events").alias("events")),
    "SELECT 'conventional' AS technology, 3 AS channels, count(*) AS events FROM lineitem")
_TECHNOLOGY = "CASE WHEN regexp_matches(lower(cyt), 'cytof|helios|dvs') THEN 'mass' WHEN regexp_matches(lower(cyt), 'aurora|northern lights|id7000|spectral') THEN 'spectral' ELSE 'conventional' END"
register("sample_acquisition", lambda s, d: acquisition(_samples(s, d, "keywords").select("sample_id", F.explode("keywords").alias("keyword", "value")), "sample_id").groupBy("instrument", "technology").agg(F.count("*").alias("samples"), F.count("date").alias("dated")),
    f"WITH k AS (SELECT sample_id, nullif(trim(keywords['$CYT']), '') AS cyt, nullif(trim(keywords['$DATE']), '') AS date FROM {_S} WHERE cardinality(keywords) > 0) SELECT cyt AS instrument, {_TECHNOLOGY} AS technology, count(*) AS samples, count(date) AS dated FROM k GROUP BY ALL")
register("stream_counts", lambda s, d: stream.run_once(stream.parquet_stream(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")), "complete"),
    "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
register("stream_windows", lambda s, d: stream.run_once(stream.windowed(stream.parquet_stream(s, d, "events"), "ts", "event_type", "value", "6 hours"), "complete").select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total")),
    "SELECT to_timestamp(floor(epoch_us(ts) / 1e6 / 21600) * 21600)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
# Only windows that the watermark has closed come out in append mode: those that end an hour or more before the newest event.
register("stream_closed_windows", lambda s, d: stream.run_once(stream.windowed(stream.parquet_stream(s, d, "events"), "ts", "event_type", "value", "6 hours"), "append").select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total")),
    "SELECT to_timestamp(floor(epoch_us(ts) / 1e6 / 21600) * 21600)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
register("stream_file_checks", lambda s, d: stream.run_once(stream.file_checks(stream.parquet_stream(s, d, "events"), ["value"]), "complete").drop("file"),
    "SELECT count(*) AS n, count(*) - count(value) AS value_missing, min(value) AS value_least, max(value) AS value_most FROM events")
register("stream_records", lambda s, d: stream.run_once(stream.running_record(stream.parquet_stream(s, d, "events"), "event_type", "value"), "update").groupBy("event_type").agg(F.max("n").alias("n"), F.round(F.max_by("mean", "n"), 6).alias("mean"), F.round(F.max_by("variance", "n"), 4).alias("variance")),
    "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance FROM events GROUP BY 1")
register("landed_files", lambda s, d: stream.complete(stream.listing(s, d, "*.parquet"), stream.listing(s, d, "*.parquet")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")))
