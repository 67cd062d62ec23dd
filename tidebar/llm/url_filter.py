"""URL filter: host and path rules first, then the ratio of two character language models. DataFrame functions only.

Accepted and rejected URLs (those that rules decide, each distinct one once) each give a Markov model over characters as they stand, with contexts of 0
to ORDER characters; before its first character a URL has start marks, so that all of its characters are scored. Longer contexts fall back on shorter
ones: P_k(c | context) = (count + FALLBACK * P_{k-1}(c | shorter context)) / (context's count + FALLBACK), down to an even spread over ALPHABET.

The models hold what the URLs have: a row for each distinct sequence of ORDER + 1 characters and its endings, joined by shuffles, so they grow with the
corpus. A sequence has at most as many extensions as there are characters, so no key of these joins is hot; the scores are joined to the URLs' sequences,
some of which all URLs share, as one exchange on either side, which adaptive execution can split.

Counts are taken from all decided URLs but for three sixteenths, by a hash of the URL, which calibrate: the cut lies between the two classes' mean
length-normalised ratios, nearer to the one that spreads less. Ratios count to nine places.

A null URL, or one without `://`, has an empty host and path and fits no rule. A null or empty URL has no ratio and is allowed unless a rule decides.
Where there is no accepted or no rejected URL to calibrate by, the cut is 0. Repeated rows are judged alike; page_id may be null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.session import scratch

ORDER = 5
FALLBACK = 4.0
ALPHABET = 256
START = "\x02"
PLACES = 9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules.
RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule], verdict: bool = False) -> Column:
    """The longest rule's name (or verdict) that fits; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.verdict if verdict else r.name)).otherwise(out)
    return out


def sequences(url: Column) -> Column:
    """Each character of the URL with the ORDER characters before it."""
    chars = F.concat(F.array(*(F.lit(START) for _ in range(ORDER))), F.filter(F.split(url, ""), lambda c: c != ""))
    # bound once by a one-element array
    return F.flatten(F.transform(F.array(chars), lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - ORDER, F.lit(1))), lambda i: F.array_join(F.slice(x, i, F.lit(ORDER + 1)), ""))))


def train(urls: DataFrame) -> DataFrame:
    """From distinct (url, good boolean or null): (gram, ratio) of log P(accepted) - log P(rejected) for every sequence that the URLs have. Those with a
    null `good` are not counted; their sequences get ratios by what shorter ones count."""
    spark, folder = urls.sparkSession, scratch(urls.sparkSession, "url-model")
    good = F.col("good")
    whole = urls.select("good", F.explode(sequences(F.col("url"))).alias("gram")).groupBy("gram").agg(F.count_if(good).alias("yes"), F.count_if(~good).alias("no"))
    endings = F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda k: F.substring(F.col("gram"), k, F.lit(ORDER + 1)))
    sums = whole.select(F.explode(endings).alias("gram"), "yes", "no").groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    sums.withColumn("k", F.char_length("gram") - 1).write.parquet(f"{folder}/sums")
    sums, below = spark.read.parquet(f"{folder}/sums"), None
    for k in range(ORDER + 1):
        own = sums.filter(F.col("k") == k).select("gram", "yes", "no", F.substring("gram", 1, k).alias("context"))
        totals = own.groupBy("context").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
        joined = own.join(totals, "context")
        if below is None:
            joined = joined.withColumns({"py": F.lit(1 / ALPHABET), "pn": F.lit(1 / ALPHABET)})
        else:
            joined = joined.withColumn("short", F.substring("gram", 2, k)).join(below.withColumnRenamed("gram", "short"), "short")
        p = lambda seen, of, low: (F.col(seen) + FALLBACK * F.col(low)) / (F.col(of) + FALLBACK)
        joined.select("gram", p("yes", "all_yes", "py").alias("py"), p("no", "all_no", "pn").alias("pn")).write.parquet(f"{folder}/{k}")
        below = spark.read.parquet(f"{folder}/{k}")
    return below.select("gram", (F.log("py") - F.log("pn")).alias("ratio"))


def judge(pages: DataFrame, rules: list[Rule] | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (its name or null), verdict (allow or block) and ratio (null if the URL has no characters) of every page."""
    rules = RULES if rules is None else rules
    spark, folder = pages.sparkSession, scratch(pages.sparkSession, "url-filter")
    own = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"))
    own = own.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "ruled": rule_of(F.col("host"), F.col("path"), rules, verdict=True)})
    distinct = own.filter(F.col("url") != "").groupBy("url").agg((F.first("ruled") == "allow").alias("good"))
    apart = F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin("0", "1", "2")
    distinct.select(F.monotonically_increasing_id().alias("uid"), "url", "good", apart.alias("apart")).write.parquet(f"{folder}/urls")
    urls = spark.read.parquet(f"{folder}/urls")
    model = train(urls.select("url", F.when(~F.col("apart"), F.col("good")).alias("good")))
    each = urls.select("uid", F.explode(sequences(F.col("url"))).alias("gram"))
    ratios = each.join(model, "gram").groupBy("uid").agg(F.round(F.avg("ratio"), PLACES).alias("ratio"))
    urls.join(ratios, "uid").select("url", "good", "apart", "ratio").write.parquet(f"{folder}/scored")
    scored = spark.read.parquet(f"{folder}/scored")
    side = lambda f, good: f(F.when(F.col("good") == good, F.col("ratio")))
    spread = scored.filter("apart and good is not null").agg(side(F.avg, True).alias("my"), side(F.stddev_pop, True).alias("sy"), side(F.avg, False).alias("mn"), side(F.stddev_pop, False).alias("sn")).first()
    cut = 0.0
    if spread.my is not None and spread.mn is not None:
        cut = round((spread.my * (spread.sn + 1e-9) + spread.mn * (spread.sy + 1e-9)) / (spread.sy + spread.sn + 2e-9), PLACES)
    by_ratio = F.when(F.col("ratio") < cut, "block").otherwise("allow")
    return own.join(scored.select("url", "ratio"), "url", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", by_ratio).alias("verdict"), "ratio")


def oracle(table: str = "pages", rules: list[Rule] | None = None) -> str:
    """The same in DuckDB's SQL, without the ratio."""
    rules = RULES if rules is None else rules
    fits = [(f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))", r) for r in sorted(rules, key=lambda r: (len(r.name), r.name), reverse=True)]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in fits) + " END"
    ruled = "CASE " + " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in fits) + " END"
    levels = [f"count{ORDER} AS (SELECT gram, count(*) FILTER (good AND NOT apart) AS yes, count(*) FILTER (NOT good AND NOT apart) AS no FROM grams GROUP BY 1)"]
    levels += [f"count{k} AS (SELECT substr(gram, 2) AS gram, sum(yes) AS yes, sum(no) AS no FROM count{k + 1} GROUP BY 1)" for k in range(ORDER - 1, -1, -1)]
    for k in range(ORDER + 1):
        below = f"SELECT gram, 1.0::DOUBLE / {ALPHABET} AS py, 1.0::DOUBLE / {ALPHABET} AS pn FROM count0" if k == 0 else f"SELECT c.gram, t.py, t.pn FROM count{k} c JOIN table{k - 1} t ON substr(c.gram, 2) = t.gram"
        levels.append(f"""all{k} AS (SELECT substr(gram, 1, {k}) AS context, sum(yes) AS yes, sum(no) AS no FROM count{k} GROUP BY 1),
table{k} AS (SELECT c.gram, (c.yes + {FALLBACK}::DOUBLE * b.py) / (a.yes + {FALLBACK}::DOUBLE) AS py, (c.no + {FALLBACK}::DOUBLE * b.pn) / (a.no + {FALLBACK}::DOUBLE) AS pn FROM count{k} c JOIN ({below}) b USING (gram) JOIN all{k} a ON substr(c.gram, 1, {k}) = a.context)""")
    return f"""WITH hosts AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM {table}),
judged AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM hosts),
urls AS (SELECT DISTINCT url, ruled = 'allow' AS good, substr(md5(url), 1, 1) IN ('0', '1', '2') AS apart, repeat(chr(2), {ORDER}) || url AS padded FROM judged WHERE url <> ''),
grams AS (SELECT url, good, apart, unnest(list_transform(range(1, length(url) + 1), lambda i: substr(padded, i, {ORDER + 1}))) AS gram FROM urls),
{", ".join(levels)},
scored AS (SELECT url, good, apart, round(avg(ln(py) - ln(pn)), {PLACES}) AS ratio FROM grams JOIN table{ORDER} USING (gram) GROUP BY ALL),
spread AS (SELECT avg(ratio) FILTER (good) AS my, stddev_pop(ratio) FILTER (good) + 1e-9 AS sy, avg(ratio) FILTER (NOT good) AS mn, stddev_pop(ratio) FILTER (NOT good) + 1e-9 AS sn FROM scored WHERE apart AND good IS NOT NULL),
cut AS (SELECT coalesce(round((my * sn + mn * sy) / (sy + sn), {PLACES}), 0) AS cut FROM spread)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN ratio < cut THEN 'block' ELSE 'allow' END) AS verdict FROM judged LEFT JOIN (SELECT url, ratio FROM scored) USING (url), cut"""
