"""Queries: tree contributions, parameter search, proposals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebar.operators import bars as B
from tidebar.operators import indicators as I
from tidebar.operators import labels as L
from tidebar.operators import proposals as P
from tidebar.operators import sampler as S
from tidebar.operators import trees as T
from tidebar.operators import validation as V
from tidebar.plans.q_indicators import W
from tidebar.plans.q_structure import base
from tidebar.plans.q_trading import LABELLED
from tidebar.plans.registry import query
from tidebar.sources.tables import table

_FEATURES, _TREES, _BLOCK, _EMBARGO = ["roc_5", "roc_10", "volume"], [(0, 1), (1, 2), (2, 0)], 100, 24
_LABEL = "label_long_hit_2r_24c"


def _tree_sql() -> str:
    """Shapley values by the expectations of all subsets, for trees of two levels."""
    names = ("a", "b", "v")
    cut = " UNION ALL ".join(f"SELECT o.*, {t} AS tree, {names[p]} > m{names[p]} AS bp, {names[q]} > m{names[q]} AS bq, {p} AS p, {q} AS q FROM {{0}} o JOIN means USING (fold)" for t, (p, q) in enumerate(_TREES))
    return f"""{LABELLED}, r AS (SELECT l.series_id, l.bar_idx, l.{_LABEL}::DOUBLE AS y, ln(l.close / lag(l.close, 5) OVER w) AS a, ln(l.close / lag(l.close, 10) OVER w) AS b, b.volume AS v FROM labels l JOIN base b USING (series_id, bar_idx) WINDOW w AS (PARTITION BY l.series_id ORDER BY l.ts)),
obs AS (SELECT * FROM r WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL), train AS (SELECT bar_idx // {_BLOCK} + 1 AS fold, * FROM obs WHERE bar_idx % {_BLOCK} < {_BLOCK - _EMBARGO}), test AS (SELECT bar_idx // {_BLOCK} AS fold, * FROM obs),
means AS (SELECT fold, avg(a) AS ma, avg(b) AS mb, avg(v) AS mv FROM train GROUP BY 1), t1 AS ({cut.format("train")}), leaf AS (SELECT fold, tree, bp, bq, count(*) AS n, avg(y) / {len(_TREES)} AS val FROM t1 GROUP BY ALL),
half AS (SELECT fold, tree, bp, sum(n) AS n, sum(n * val) / sum(n) AS val FROM leaf GROUP BY ALL), root AS (SELECT fold, tree, sum(n) AS n, sum(n * val) / sum(n) AS val FROM half GROUP BY ALL), across AS (SELECT fold, tree, l.bq, sum(h.n * l.val) / any_value(r.n) AS val FROM leaf l JOIN half h USING (fold, tree, bp) JOIN root r USING (fold, tree) GROUP BY ALL),
t2 AS ({cut.format("test")}), e AS (SELECT t2.fold, t2.series_id, t2.bar_idx, p, q, r.val AS v0, coalesce(h.val, 0) AS vp, coalesce(x.val, 0) AS vq, coalesce(l.val, 0) AS vpq FROM t2 JOIN root r USING (fold, tree) LEFT JOIN half h USING (fold, tree, bp) LEFT JOIN across x USING (fold, tree, bq) LEFT JOIN leaf l USING (fold, tree, bp, bq)),
c AS (SELECT fold, series_id, bar_idx, p AS f, ((vp - v0) + (vpq - vq)) / 2 AS phi FROM e UNION ALL SELECT fold, series_id, bar_idx, q, ((vq - v0) + (vpq - vp)) / 2 FROM e), s AS (SELECT fold, series_id, bar_idx, f, abs(sum(phi)) AS v FROM c GROUP BY ALL),
g AS (SELECT fold, f, sum(v) AS s, count(*) AS n FROM s GROUP BY ALL), o AS (SELECT {_FEATURES!r}[f + 1] AS feature, sum(s) / sum(n) AS mean_abs, coalesce(stddev_pop(s / n) / nullif(avg(s / n), 0), 0) AS cv FROM g GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank, mean_abs < 0.01 AND feature <> 'volume' AS prune FROM o"""


@query("v13_tree_contributions", _tree_sql(), "mean_abs cv")
def _(spark, d):
    """Walk-forward contributions in tree ensembles, every block's trees learned from the block before; their ranks, and what may be pruned."""
    x = I.momentum(L.triple_barrier(base(spark, d), (24,), (2,))).filter(" AND ".join(f"{c} IS NOT NULL" for c in (_LABEL, *_FEATURES)))  # NaN stays
    block = F.floor(F.col("bar_idx") / _BLOCK)
    train = x.filter(F.col("bar_idx") % _BLOCK < _BLOCK - _EMBARGO).withColumn("fold", block + 1)
    trees = T.models(T.paths(T.mean_split_nodes(train, "fold", _FEATURES, _TREES, _LABEL), 2), len(_FEATURES))
    return T.summary(T.contributions(x.withColumn("fold", block), trees, "fold", _FEATURES), "fold", _FEATURES, 0.01, ("volume",))


@query("v13_boosted_contributions")
def _(spark, d):
    """Walk-forward contributions in Spark's boosted trees."""
    x = I.momentum(L.triple_barrier(base(spark, d), (24,), (2,))).select("series_id", "bar_idx", *_FEATURES, _LABEL)
    last = B.bars_of_events(spark, d).agg(F.max("bar_idx")).first()[0]
    spec = V.folds(0 if last is None else last + 1, 350, 400, 24, 24, least=50)
    if spec.empty:
        return T.summary(x.limit(0).select(F.lit(0).alias("fold"), F.array(*[F.lit(0.0)] * 3).alias("phi")), "fold", _FEATURES)
    return T.summary(T.boosted_folds(x, _FEATURES, _LABEL, spec, 5)[0], "fold", _FEATURES)


_SPACE = (S.Number("level", 0.0, 100.0), S.Number("pace", 1.0, 10_000.0, log=True), S.Choice("kind", ("a", "b", "c")))
_NEXT, _SEED = (100_000, 100_001), 11


def _sampler_sql() -> str:
    """Both densities in DuckDB's SQL. The draws' uniform numbers are digests of their keys."""
    d = len(_SPACE)
    u = lambda *key: f"((('0x' || substr(sha256(concat_ws(':', {_SEED}, {', '.join(key)})), 1, 13))::BIGINT + 0.5::DOUBLE) / {2**52}::DOUBLE)"
    cdf = lambda z: f"(1 / (1 + exp(-({z}))))"
    number = lambda x, m, h: f"({cdf(f'({x} - {m}) / {h}')} * (1 - {cdf(f'({x} - {m}) / {h}')}) / {h} / ({cdf(f'(1 - {m}) / {h}')} - {cdf(f'-{m} / {h}')}))"
    kernel = lambda m, h: f"{number('c.x1', f'{m}.x1', f'{h}.h1')} * {number('c.x2', f'{m}.x2', f'{h}.h2')} * (CASE WHEN c.x3 = {m}.x3 THEN 1 - {h}.h3 ELSE 0 END + {h}.h3 / 3)"
    width = lambda k: f"greatest(coalesce(stddev_pop(x{k}), 0) * pow(count(*), -1.0::DOUBLE / {d + 4}) / {S.DEVIATION!r}, {S.LEAST_WIDTH})"
    widths = f"count(*) AS n, {width(1)} AS h1, {width(2)} AS h2, 3.0::DOUBLE / (3 + count(*)) AS h3"
    draw = lambda k, key: f"CASE WHEN pick = 0 THEN {u('trial', 'candidate', key, chr(39) + 'u' + chr(39))} ELSE least(1.0, greatest(0.0, g.x{k} + h{k} * ln(q{k} / (1 - q{k})))) END"
    q = lambda k, key: f"{cdf(f'-g.x{k} / h{k}')} + {u('trial', 'candidate', key, chr(39) + 'u' + chr(39))} * ({cdf(f'(1 - g.x{k}) / h{k}')} - {cdf(f'-g.x{k} / h{k}')}) AS q{k}"
    return f"""WITH t AS (SELECT user_id AS trial, least(100, greatest(0, avg(value))) / 100 AS x1, ln(least(10000, count(*))) / ln(10000) AS x2, (user_id % 3)::DOUBLE AS x3, max(value) - min(value) AS value FROM events GROUP BY user_id),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, trial) AS place, least({S.GOOD}, ceil({S.GOOD_SHARE} * count(*) OVER ())) AS n_good FROM t), good AS (SELECT place, x1, x2, x3 FROM r WHERE place <= n_good), other AS (SELECT x1, x2, x3 FROM r WHERE place > n_good),
gh AS (SELECT {widths} FROM good), oh AS (SELECT {widths} FROM other), k AS (SELECT trial, candidate, floor({u('trial', 'candidate', "'component'")} * (n + 1)) AS pick, gh.* FROM (SELECT unnest({list(_NEXT)!r}) AS trial), (SELECT unnest(range({S.CANDIDATES})) AS candidate), gh),
p AS (SELECT k.*, g.x1 AS gx1, g.x2 AS gx2, g.x3 AS gx3, {q(1, "'level'")}, {q(2, "'pace'")} FROM k LEFT JOIN good g ON g.place = pick), c AS (SELECT trial, candidate, {draw(1, "'level'").replace('g.x1', 'gx1')} AS x1, {draw(2, "'pace'").replace('g.x2', 'gx2')} AS x2,
CASE WHEN pick > 0 AND {u('trial', 'candidate', "'kind'", "'u'")} >= h3 THEN gx3 ELSE floor({u('trial', 'candidate', "'kind'", "'v'")} * 3) END AS x3 FROM p),
lg AS (SELECT c.trial, c.candidate, ln((sum({kernel('good', 'gh')}) + 1 / 3.0::DOUBLE) / (any_value(gh.n) + 1)) AS good FROM c, good, gh GROUP BY ALL), lo AS (SELECT c.trial, c.candidate, ln((sum({kernel('other', 'oh')}) + 1 / 3.0::DOUBLE) / (any_value(oh.n) + 1)) AS other FROM c, other, oh GROUP BY ALL)
SELECT trial::BIGINT AS trial, candidate::INTEGER AS candidate, x1 AS level, x2 AS pace, x3 AS kind, good, other, row_number() OVER (PARTITION BY trial ORDER BY round(good - other, 6) DESC, candidate) = 1 AS chosen FROM c JOIN lg USING (trial, candidate) JOIN lo USING (trial, candidate)"""


def _trials_of_users(spark, d):  # noqa: ANN001, ANN202
    e = table(spark, d, "events").groupBy("user_id").agg(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.avg("value"))).alias("level"), F.least(F.lit(10_000.0), F.count("*").cast("double")).alias("pace"), (F.max("value") - F.min("value")).alias("value"))
    params = F.create_map(F.lit("level"), "level", F.lit("pace"), "pace", F.lit("kind"), (F.col("user_id") % 3).cast("double"))
    return e.select(F.col("user_id").cast("long").alias("trial"), F.lit("done").alias("status"), "value", params.alias("params"))


@query("v17_sampler", _sampler_sql(), "level pace kind good other")
def _(spark, d):
    """Candidates for the next trials, drawn from the good trials' density and scored against the others'; users stand for trials."""
    found = S.scored(_trials_of_users(spark, d), _SPACE, _NEXT, _SEED)
    if found is None:
        found = spark.createDataFrame([], "trial long, candidate int, x array<double>, good double, other double, score double")
    best = F.max(F.struct(F.round("score", 6), -F.col("candidate"))).over(Window.partitionBy("trial"))
    return found.select("trial", "candidate", *(F.get("x", F.lit(k)).alias(p.name) for k, p in enumerate(_SPACE)), "good", "other", (F.struct(F.round("score", 6), -F.col("candidate")) == best).alias("chosen"))


_METRICS = {"trades_per_yr": "floor(o_totalprice / 1000) % 180", "oos_auc": "0.7 + o_custkey % 11 / 100.0", "pbo": "o_orderkey % 13 / 200.0", "psr": "0.97 + o_custkey % 4 / 100.0", "sharpe_ann": "floor(o_totalprice / 1000) / 157.0", "win_rate": "0.5 + o_orderkey % 11 / 100.0", "ev_r": "o_custkey % 17 / 20.0", "max_drawdown": "0.1 + o_orderkey % 17 / 100.0"}
_PARAMS = {"ml_threshold": "0.55 + o_custkey % 26 / 100.0", "cooldown_bars": "144.0 + 96 * (o_orderkey % 60)", "kelly_divisor": "20.0 + o_custkey % 31"}


def _registry(spark, d):  # noqa: ANN001, ANN202
    """Orders as experiments."""
    numbers = lambda named: F.map_from_entries(F.array(*(F.struct(F.lit(k), F.expr(f"CAST({v.replace('.0', '.0D')} AS double)")) for k, v in named.items())))
    tier = F.element_at(F.array(*map(F.lit, ("standard", "weekly", "monthly"))), (F.col("o_custkey") % 3 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "P", "FAILED").otherwise("DONE")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"), status.alias("status"), tier.alias("tier"), F.when(F.col("o_totalprice") > 300_000, F.concat(F.lit("q"), F.col("o_custkey"))).alias("question"), (F.col("o_totalprice") > 450_000).alias("passed"), numbers(_PARAMS).alias("params"), numbers(_METRICS).alias("metrics")
    )


def _doubles(sql: str) -> str:
    return sql.replace(" / 100.0", " / 100.0::DOUBLE").replace(" / 200.0", " / 200.0::DOUBLE").replace(" / 157.0", " / 157.0::DOUBLE").replace(" / 20.0", " / 20.0::DOUBLE").replace("144.0", "144.0::DOUBLE").replace("20.0 +", "20.0::DOUBLE +").replace("0.55 +", "0.55::DOUBLE +").replace("0.5 +", "0.5::DOUBLE +")


_REGISTRY_SQL = f"""registry AS (SELECT o_orderkey AS id, o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'DONE' END AS status, ['standard', 'weekly', 'monthly'][o_custkey % 3 + 1] AS tier, CASE WHEN o_totalprice > 300000 THEN 'q' || o_custkey END AS question, o_totalprice > 450000 AS passed,
{', '.join(f'({_doubles(v)})::DOUBLE AS {k}' for k, v in {**_PARAMS, **_METRICS}.items())}, NULL::DOUBLE AS ece FROM orders)"""
_RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{a}', {f'{chr(39)}{p}{chr(39)}' if p else 'NULL'}, {s if s is not None else 'NULL'}::DOUBLE)" for g, a, p, s in P.RULES) + ") r(gate, action, parameter, step))"
_FAILED_SQL = "failed AS (" + " UNION ALL ".join(f"SELECT id, seq, tier, '{g}' AS gate, {m} AS value, {b}::DOUBLE AS bound FROM registry WHERE status = 'DONE' AND NOT coalesce({m} {'>=' if k == 'least' else '<='} {b}, false)" for g, (m, k, b) in P.GATES.items()) + ")"


@query("v18_diagnoses", f"WITH {_REGISTRY_SQL}, {_RULES_SQL}, {_FAILED_SQL} SELECT gate, id, seq, tier, value, bound, abs(value - bound) / bound AS gap, action, parameter, step FROM failed LEFT JOIN rules USING (gate)", "value gap")
def _(spark, d):
    """For every experiment the gates that it fails, and what the rules ask for."""
    return P.diagnoses(_registry(spark, d))


_CHANGED = sorted({r[2] for r in P.RULES if r[2]})
_BOUNDS = {p: (min(P.PARAMETERS[p][1]), max(P.PARAMETERS[p][1])) for p in _CHANGED}
_MUTATIONS = f"""WITH {_REGISTRY_SQL}, {_RULES_SQL}, {_FAILED_SQL}, best AS (SELECT * FROM registry WHERE status = 'DONE' QUALIFY row_number() OVER (PARTITION BY tier ORDER BY sharpe_ann DESC, seq) = 1),
asked AS (SELECT f.tier, f.id, parameter, step, count(DISTINCT gate) AS gates, sum(abs(value - bound) / bound) AS gap FROM failed f JOIN best b USING (id) JOIN rules USING (gate) WHERE parameter IS NOT NULL GROUP BY ALL),
x AS (SELECT a.*, CASE parameter {' '.join(f"WHEN '{p}' THEN round({p}, 6)" for p in _CHANGED)} END AS old, {', '.join(f"round(CASE WHEN parameter = '{p}' THEN least({hi}, greatest({lo}, round({p}, 6) + step)) ELSE {p} END, 6) AS n_{p}" for p, (lo, hi) in _BOUNDS.items())} FROM asked a JOIN best USING (id)),
y AS (SELECT *, CASE parameter {' '.join(f"WHEN '{p}' THEN n_{p}" for p in _CHANGED)} END AS new FROM x) SELECT tier, CAST(row_number() OVER (PARTITION BY tier ORDER BY gates DESC, round(gap, 9) DESC NULLS LAST, parameter, step) AS INTEGER) AS rank, id AS base, parameter, old, new, gates, gap FROM y
WHERE new <> old AND NOT EXISTS (SELECT 1 FROM registry r WHERE r.status = 'DONE' AND r.tier = y.tier AND {' AND '.join(f'round(r.{p}, 6) = n_{p}' for p in _CHANGED)})"""


@query("v18_mutations", _MUTATIONS, "old new gap")
def _(spark, d):
    """Changed settings for the best experiment of each tier, ranked by the failed gates that ask for them."""
    return P.mutations(_registry(spark, d))


_QUESTIONS = f"""WITH {_REGISTRY_SQL}, q AS (SELECT 'q' || c_custkey AS question, c_nationkey AS priority, CASE WHEN c_custkey % 5 = 0 THEN 'needs v3' WHEN c_custkey % 11 = 0 THEN 'needs data' END AS blocked, list_distinct(['f' || c_custkey % 40, 'f' || c_custkey % 3]) AS needs FROM customer),
features AS (SELECT DISTINCT 'f' || user_id % 37 AS feature FROM events), lacking AS (SELECT question FROM (SELECT question, unnest(needs) AS feature FROM q) WHERE feature NOT IN (SELECT feature FROM features)), last AS (SELECT coalesce(max(seq) FILTER (passed), -1) AS last FROM registry WHERE status = 'DONE'), lost AS (SELECT question FROM registry, last WHERE status = 'DONE' AND NOT passed AND seq > last AND question IS NOT NULL GROUP BY 1 HAVING count(*) >= {P.GIVEN_UP})
SELECT row_number() OVER (ORDER BY priority, question) AS rank, question, priority, {P.MINUTES['gpu'] * P.FOLDS}::DOUBLE * (508 - 81 + len(needs)) / 500 AS minutes FROM q WHERE (blocked IS NULL OR contains(blocked, 'v3')) AND question NOT IN (SELECT question FROM registry WHERE question IS NOT NULL) AND question NOT IN (SELECT question FROM lost) AND question NOT IN (SELECT question FROM lacking)"""


@query("v18_open_questions", _QUESTIONS, "minutes")
def _(spark, d):
    """Questions that are neither asked, blocked nor given up, by priority, with the time that they would take."""
    c = F.col("c_custkey")
    blocked = F.when(c % 5 == 0, "needs v3").when(c % 11 == 0, "needs data")
    needs = F.array_distinct(F.array(F.concat(F.lit("f"), c % 40), F.concat(F.lit("f"), c % 3)))
    questions = table(spark, d, "customer").select(F.concat(F.lit("q"), c).alias("question"), F.col("c_nationkey").alias("priority"), blocked.alias("blocked"), needs.alias("needs"))
    features = table(spark, d, "events").select(F.concat(F.lit("f"), F.col("user_id") % 37).alias("feature"))
    return P.open_questions(questions, _registry(spark, d), features, ("v3",), dead=81)
