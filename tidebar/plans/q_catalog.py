"""Queries: versioned scans, sinks, registries, selection, search and contributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import bars as B
from tidebar.operators import indicators as I
from tidebar.operators import labels as L
from tidebar.operators import rolling as R
from tidebar.operators import search as H
from tidebar.operators import validation as V
from tidebar.operators.filters import drop_constant, feature_columns
from tidebar.plans.q_indicators import W
from tidebar.plans.q_structure import BASE, base
from tidebar.plans.q_trading import LABELLED
from tidebar.plans.registry import bars_sql, query
from tidebar.session import scratch
from tidebar.sources import archives, ingest, pages
from tidebar.sources.tables import table


@query("s2_versioned_scan", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    """The first version of a table that there is; holdout data is refused."""
    return ingest.versioned(spark, [f"{d}/events_v3.parquet", f"{d}/events_v2.parquet", f"{d}/events.parquet"]).groupBy("event_type").agg(F.count("*").alias("n"))


_WANTED = ["l_orderkey", "l_quantity", "l_no_such", "l_shipdate", "label"]


@query("s4_schema_probe", f"SELECT w AS feature, w NOT IN (SELECT column_name FROM (DESCRIBE lineitem)) AS missing FROM (SELECT unnest({_WANTED!r}) AS w)")
def _(spark, d):
    """Which wanted columns a table lacks, from its schema alone."""
    missing = ingest.missing_columns(table(spark, d, "lineitem"), _WANTED)
    return spark.createDataFrame([(c, c in missing) for c in _WANTED], "feature string, missing boolean")


_MONTHS = f"WITH {bars_sql('1 hour')} SELECT strftime(ts, '%Y-%m') AS ym, count(*) AS n, sum(volume) AS volume, max(close) AS top FROM bars WHERE strftime(ts, '%Y-%m') >= '2024-01' GROUP BY 1"


@query("s15_month_sink", _MONTHS, "volume top")
def _(spark, d):
    """Bars written as zstd by month and read back with the months pruned."""
    path = scratch(spark, "months")
    ingest.write_bars(B.bars_of_events(spark, d, "1h", numbered=False), path, by_month=True)
    return spark.read.parquet(path).filter("ym >= '2024-01'").groupBy(F.col("ym").cast("string").alias("ym")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.max("close").alias("top"))


@query("s18_array_cache", f"WITH {bars_sql('1 hour', chr(39) + 'ALL' + chr(39))} SELECT bar_idx AS at, close / (close + open) AS value FROM bars", "value")
def _(spark, d):
    """An array of scores, cached and checked for its length."""
    path, b = scratch(spark, "array"), B.bars_of_events(spark, d, "1h", None)
    ingest.write_array(b.withColumn("p", F.col("close") / (F.col("close") + F.col("open"))), path, "bar_idx", "p")
    return ingest.read_array(spark, path, b.count())


_UPSERT = """WITH old AS (SELECT user_id % 10 AS id, sum(value) AS score, 'old' AS status FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), new AS (SELECT user_id % 10 AS id, sum(value) AS score, 'new' AS status FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type = 'click' GROUP BY 1)
SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new"""


@query("s17_registry_upsert", _UPSERT, "score")
def _(spark, d):
    """Rows of a registry replaced by those of the same id."""
    e = table(spark, d, "events")
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    rows = lambda cond, status: e.filter(cond).groupBy((F.col("user_id") % 10).alias("id")).agg(F.sum("value").alias("score")).withColumn("status", F.lit(status))
    return ingest.upsert(rows(F.col("ts") < cut, "old"), rows((F.col("ts") >= cut) & (F.col("event_type") == "click"), "new"), "id")


@query("s20_metadata", "SELECT count(*) AS rows, min(ts) AS first, max(ts) AS last, CAST((SELECT count(*) FROM (DESCRIBE events)) AS BIGINT) AS columns FROM events")
def _(spark, d):
    """Ranges and counts of a table."""
    return ingest.description(table(spark, d, "events"))


_ARCHIVED = ["open", "high", "low", "close", "volume"]


@query("s9_archive_scan", f"WITH {bars_sql('1 hour')} SELECT series_id, ts, {', '.join(_ARCHIVED)} FROM bars", " ".join(_ARCHIVED))
def _(spark, d):
    """Bars in monthly archives with checksums, verified and read back by the archive source."""
    path, b = scratch(spark, "archives"), B.bars_of_events(spark, d, "1h", numbered=False)
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    lines = b.select(F.concat("series_id", F.lit("-1h")).alias("prefix"), F.date_format("ts", "yyyy-MM").alias("month"), millis.alias("place"), F.concat_ws(",", millis, *(F.col(c).cast("string") for c in _ARCHIVED)).alias("line"))
    archives.write(lines, path, header="open_time," + ",".join(_ARCHIVED))
    archives.register(spark)
    found = spark.read.format("archives").option("path", path).load()
    parsed = ingest.parse_lines(found.select("archive", "line"), "t string, " + ", ".join(f"{c} string" for c in _ARCHIVED), keep=("archive",))
    at = ingest.to_millis("t")
    series = F.regexp_extract("archive", r"^(.+)-1h-", 1).alias("series_id")
    return parsed.filter(at.isNotNull()).select(series, F.timestamp_millis(at).cast("timestamp_ntz").alias("ts"), *(F.expr(f"try_cast({c} AS double)").alias(c) for c in _ARCHIVED))


@query("s12_paged_history", "SELECT user_id, count(*) AS n, sum(value) AS total, max(event_id) AS last FROM events GROUP BY 1", "total")
def _(spark, d):
    """Events in pages of 500, read once each by a stream over the paged source."""
    folder, out, state = scratch(spark, "pages"), scratch(spark, "history"), scratch(spark, "offsets")
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 500).alias("page"), F.col("event_id").alias("place"), F.to_json(F.struct("event_id", "user_id", "value")).alias("payload"))
    first = e.agg(F.min("page")).first()[0] or 0
    pages.write(e.withColumn("page", F.col("page") - first), folder)
    pages.register(spark)
    stream = spark.readStream.format("pages").options(path=folder, rate="2000", tasks="8").load().writeStream.format("parquet").option("checkpointLocation", state).option("path", out).start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    x = spark.read.schema(pages.SCHEMA).parquet(out).select(F.from_json("payload", "event_id long, user_id long, value double").alias("e")).select("e.*")
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("event_id").alias("last"))


_FEATURES = ["close", "high", "low", "open", "taker_buy", "trade_count", "volume"]


@query("f4_feature_selection", f"WITH {bars_sql('1 hour')} " + " UNION ALL ".join(f"SELECT '{c}' AS feature FROM bars HAVING count(DISTINCT {c}) > 1" for c in _FEATURES))
def _(spark, d):
    """Numeric columns that are no meta data or labels and aren't constant."""
    b = B.bars_of_events(spark, d, "1h").withColumns({"meta_x": F.lit(1), "label_y": F.col("close"), "constant": F.lit(3.0), "nothing": F.lit(None).cast("double")})
    kept = drop_constant(b, feature_columns(b, exclude=("bar_idx",)))
    return spark.createDataFrame([(c,) for c in kept], "feature string")


_NAMED = "CASE WHEN event_id % 10 = 0 THEN event_type ELSE 'label_' || CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END || '_hit_' || (1 + event_id % 3) || 'r_' || (12 * (1 + user_id % 4)) || 'c' END"
_PARSED = f"""WITH e AS (SELECT {_NAMED} AS label, value FROM events), p AS (SELECT *, nullif(regexp_extract(label, '^label_(long|short)_hit_([0-9]+)r_([0-9]+)c$', 1), '') AS direction, CAST(nullif(regexp_extract(label, '^label_(long|short)_hit_([0-9]+)r_([0-9]+)c$', 2), '') AS INTEGER) AS ratio,
CAST(nullif(regexp_extract(label, '^label_(long|short)_hit_([0-9]+)r_([0-9]+)c$', 3), '') AS INTEGER) AS horizon FROM e) SELECT label, direction, ratio, horizon, horizon = 24 AS aligned, count(*) AS n, sum(value) AS total FROM p GROUP BY ALL"""


@query("l10_label_names", _PARSED, "total")
def _(spark, d):
    """Results by what their labels' names say, and whether an embargo of 24 bars fits."""
    e = table(spark, d, "events").select(F.expr(_NAMED).alias("label"), "value")
    return L.parsed(e, "label", 24).groupBy("label", "direction", "ratio", "horizon", "aligned").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


_DIGESTS = """SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS rows, bit_xor(('0x' || substr(sha256(event_id || '|' || user_id || '|' || props), 1, 15))::BIGINT) AS digest FROM events GROUP BY 1, 2"""


@query("s9_part_digests", _DIGESTS)
def _(spark, d):
    """Digests of a table's parts that don't depend on the order of rows (S9, hash functions of 2.7)."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return ingest.digests(e, ["event_type", "day"], ["event_id", "user_id", "props"])


_SAFE = """SELECT user_id, CASE WHEN min(value) < 0.5 THEN 'failed' ELSE 'done' END AS status, CASE WHEN min(value) < 0.5 THEN 2 ELSE 1 END AS attempts, CASE WHEN min(value) < 0.5 THEN 'ValueError: too small' END AS error, CASE WHEN min(value) >= 0.5 THEN sum(value) END AS total FROM events GROUP BY 1"""


@query("v19_safe_runs", _SAFE, "total")
def _(spark, d):
    """Runs by group that may fail: each is tried again and then recorded, and the others go on."""

    def run(own):  # noqa: ANN001, ANN202
        if own["value"].min() < 0.5:
            raise ValueError("too small")
        return {"total": float(own["value"].sum())}

    return H.run_groups(table(spark, d, "events").select("user_id", "value"), ["user_id"], run, "total double")


_TOP = f"""WITH {bars_sql()}, x AS (SELECT *, list({{'v': floor(volume / 20), 'c': close, 'i': bar_idx}}) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS past FROM bars), y AS (SELECT *, list_sort(list_transform(past, lambda s: {{'a': -s.v, 'b': abs(s.c - close), 'c': s.i}}))[1:3] AS top FROM x)
SELECT series_id, ts, top[1].c AS first, top[2].c AS second, top[3].c AS third FROM y"""


@query("w22_top_levels", _TOP)
def _(spark, d):
    """The best three of a bar's active set, by score and then distance."""
    past = F.collect_list(F.struct(F.floor(F.col("volume") / 20).alias("v"), F.col("close").alias("c"), F.col("bar_idx").alias("i"))).over(B.rows(-20, -1))
    x = B.bars_of_events(spark, d).withColumn("past", past)
    x = x.withColumn("top", R.top_k(F.col("past"), 3, lambda s: s["v"], lambda s: F.abs(s["c"] - F.col("close"))))
    return x.select("series_id", "ts", *(F.get("top", F.lit(k))["i"].alias(n) for k, n in enumerate(("first", "second", "third"))))


_STEPS = "steps AS (SELECT user_id % 12 AS trial, CAST(dayofmonth(ts) % 6 AS BIGINT) AS step, avg(value) AS value FROM events GROUP BY 1, 2)"
_PRUNED = f"""WITH {_STEPS}, b AS (SELECT *, max(value) OVER (PARTITION BY trial ORDER BY step) AS best FROM steps), m AS (SELECT *, median(best) OVER w AS med, count(best) OVER w AS seen FROM b WINDOW w AS (PARTITION BY step ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT trial, min(CASE WHEN seen >= 3 AND best < med THEN step END) AS pruned_at FROM m GROUP BY 1) SELECT trial, pruned_at, max_by(best, step) AS best, count(*) AS steps FROM m JOIN e USING (trial) WHERE pruned_at IS NULL OR step <= pruned_at GROUP BY 1, 2"""


@query("v17_median_pruner", _PRUNED, "best")
def _(spark, d):
    """Trials that the median of those before them ends early."""
    steps = table(spark, d, "events").groupBy((F.col("user_id") % 12).alias("trial"), (F.dayofmonth("ts") % 6).cast("long").alias("step")).agg(F.avg("value").alias("value"))
    return H.median_pruned(steps)


_PROPOSED = """WITH runs AS (SELECT user_id AS option, CASE WHEN value < 5 THEN 'failed' WHEN value > 60 THEN 'done' ELSE 'open' END AS status FROM events), s AS (SELECT option, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM runs GROUP BY 1), o AS (SELECT DISTINCT c_custkey AS option FROM customer UNION SELECT DISTINCT user_id FROM events)
SELECT option, coalesce(failed, 0) AS failed FROM o LEFT JOIN s USING (option) WHERE coalesce(done, 0) = 0 AND coalesce(failed, 0) < 2"""


@query("v18_proposals", _PROPOSED)
def _(spark, d):
    """Options that are neither finished nor failed twice."""
    e = table(spark, d, "events")
    status = F.when(F.col("value") < 5, "failed").when(F.col("value") > 60, "done").otherwise("open")
    options = table(spark, d, "customer").select(F.col("c_custkey").alias("option")).union(e.select("user_id")).distinct()
    return H.proposals(options, e.select(F.col("user_id").alias("option"), status.alias("status")), "option")


_TIERS = """WITH f AS (SELECT DISTINCT 'f' || (user_id % 40) AS feature, CASE WHEN user_id % 40 < 10 THEN 'tier1' WHEN user_id % 40 < 25 THEN 'tier2' ELSE 'tier3' END AS tier FROM events) SELECT feature FROM f WHERE tier <> 'tier3'"""


@query("v20_tiers", _TIERS)
def _(spark, d):
    """The features that tiers leave in."""
    k = F.col("user_id") % 40
    f = table(spark, d, "events").select(F.concat(F.lit("f"), k).alias("feature"), F.when(k < 10, "tier1").when(k < 25, "tier2").otherwise("tier3").alias("tier")).distinct()
    return H.active(f.select("feature"), f, ["tier3"])


_SHAP = f"""{LABELLED}, r AS (SELECT series_id, bar_idx, label_long_hit_2r_24c AS y, ln(close / lag(close, 5) OVER ({W})) AS a, ln(close / lag(close, 10) OVER ({W})) AS b FROM labels), obs AS (SELECT * FROM r WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
s AS (SELECT unnest(range(374, n, 400)) AS start, n FROM (SELECT max(bar_idx) + 1 AS n FROM base)), v AS (SELECT row_number() OVER (ORDER BY start) AS fold, start, least(start + 400, n) AS stop, start - 24 - greatest(CAST(floor((start - 24) * 0.1) AS BIGINT), 50) - 24 AS below FROM s),
c AS (SELECT fold, any_value(start) AS start, any_value(stop) AS stop, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM v JOIN obs x ON x.bar_idx < v.below GROUP BY 1),
w AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS wb FROM c), m AS (SELECT fold, avg(abs(wa * (a - ma))) AS a, avg(abs(wb * (b - mb))) AS b FROM w JOIN obs x ON x.bar_idx >= w.start AND x.bar_idx < w.stop GROUP BY 1),
p AS (SELECT fold, 'roc_5' AS feature, a / nullif(a + b, 0) AS share FROM m UNION ALL SELECT fold, 'roc_10', b / nullif(a + b, 0) FROM m) SELECT feature, avg(share) AS share, max_by(share, fold) - min_by(share, fold) AS delta, avg(share) < 0.4 AS prune FROM p GROUP BY 1"""


def _folded(spark, d):  # noqa: ANN001, ANN202
    x = I.momentum(L.triple_barrier(base(spark, d), (24,), (2,)))
    last = base(spark, d).agg(F.max("bar_idx")).first()[0]
    return x, V.folds(0 if last is None else last + 1, 350, 400, 24, 24, least=50)


@query("v13_contributions", _SHAP, "share delta")
def _(spark, d):
    """Walk-forward contributions of features, their changes, and what may be pruned."""
    x, spec = _folded(spark, d)
    return V.prune_list(V.linear_contributions(x, ["roc_5", "roc_10"], "label_long_hit_2r_24c", spec), 0.4)


_ABLATION = _SHAP[: _SHAP.index("m AS (SELECT fold, avg(abs(")] + """e AS (SELECT 'all' AS features, fold, round(wa * (a - ma) + wb * (b - mb), 9) AS score, y FROM w JOIN obs x ON x.bar_idx >= w.start AND x.bar_idx < w.stop UNION ALL SELECT 'reduced', fold, round(ay / aa * (a - ma), 9), y FROM w JOIN obs x ON x.bar_idx >= w.start AND x.bar_idx < w.stop),
k AS (SELECT *, rank() OVER (PARTITION BY features, fold ORDER BY score) + (count(*) OVER (PARTITION BY features, fold, score) - 1) / 2.0 AS r FROM e), u AS (SELECT features, fold, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM k GROUP BY 1, 2)
SELECT features, avg(auc) AS auc, count(auc) AS folds FROM u GROUP BY 1"""


@query("v14_ablation", _ABLATION, "auc")
def _(spark, d):
    """Areas under the ROC curve with all features and retrained without one."""
    x, spec = _folded(spark, d)
    return V.ablation(x, ["roc_5", "roc_10"], ["roc_10"], "label_long_hit_2r_24c", spec)
