"""URL filter in DataFrame operations only: host and path rules, then a classifier.

The classifier is a logistic regression on hashed character n-grams of host and
path. It is trained on a small labelled table of URLs, in its dual form: one
coefficient per labelled URL, moved by gradient steps on the table of common
n-grams of each two of them, all inside one SQL expression. The weights of the
``buckets`` buckets are then summed and go into the scoring expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.llm.shared import written

#: (verdict, host, path): a rule fits its host, the host's subdomains, and paths that begin with its path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
BUCKETS, GRAMS, STEPS, RATE, RIDGE = 16384, (3, 4), 1000, 0.02, 0.001
#: Most labelled URLs that train accepts.
MOST_LABELLED = 1000

# Hosts of the labelled URLs, to be blocked and to be allowed.
BLOCKED_HOSTS = "best-casino casino-bonus online-casino win-casino casino-royal win-big lucky-win poker-bets free-bets bets-online sports-betting cheap-pills pills-online discount-pills cheap-meds pharmacy-pills viagra-shop adult-video adult-chat xxx-adult adult-films porn-x spam-site link-farm spam-farm seo-spam content-farm ads-server ad-track click-track tracking-ads banner-ads free-keygen get-rich-free cheap-replica".split()
ALLOWED_HOSTS = "library museum archive university news garden weather townhall history recipes music science nature school poems maps health travel books forum theatre railway station thinking nation mention hearing thread others within eastern better-bread windmill faraway adventure".split()
# What the labelled URLs have before and after their hosts, in turn, whatever the label.
BEFORE = ["http://", "https://www.", "http://m.", "https://", "http://blog."]
AFTER = [".com/en/15", ".net/fr/402.html", ".org/de/7/", ".com/es/88?page=2", ".net/en/1204#top", ".org/en/36", ".com/", ".net/about"]


def labelled_pairs() -> list[tuple[int, str]]:
    """The labelled URLs; 1 is to be blocked. Both labels have the same surroundings."""
    return [(label, f"{BEFORE[k % len(BEFORE)]}{host}{AFTER[k % len(AFTER)]}") for label, hosts in ((1, BLOCKED_HOSTS), (0, ALLOWED_HOSTS)) for k, host in enumerate(hosts)]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as host and path, and its verdict; null where none fits."""
    rule = verdict = None
    for kind, of, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(prefix)
        rule = (F.when if rule is None else rule.when)(fits, F.lit(of + prefix))
        verdict = (F.when if verdict is None else verdict.when)(fits, F.lit(kind))
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"),) * 2


def buckets_of(host: Column, path: Column, buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS) -> Column:
    """Bucket of every n-gram of ``^host$path``, repeats included."""
    text = F.concat(F.lit("^"), host, F.lit("$"), path)

    def of_length(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.when(F.length(text) >= n, F.transform(places, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.concat(*map(of_length, grams)), lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 7), 16, 10).cast("int") % buckets)


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({y}, '{u}')" for y, u in labelled_pairs())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(label, url)")


def train(labelled: DataFrame, *, buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> tuple[list[float], float]:
    """Bucket weights and bias from a table label, url of at most MOST_LABELLED rows; zeros for none."""
    url = F.col("url")
    rows = labelled.filter("label is not null").select("label", "url").distinct()
    numbered = rows.select((F.row_number().over(_by_url()) - 1).alias("i"), F.col("label").cast("double").alias("y"), buckets_of(host_of(url), path_of(url), buckets, grams).alias("b"))
    numbered = written(numbered, "labelled")
    if (n := numbered.count()) == 0:
        return [0.0] * buckets, 0.0
    if n > MOST_LABELLED:
        raise ValueError(f"{n} labelled URLs; at most {MOST_LABELLED} are trained on")
    counts = numbered.select("i", F.explode("b").alias("b")).groupBy("i", "b").agg(F.count("*").cast("double").alias("c"))
    right = counts.select(F.col("i").alias("j"), "b", F.col("c").alias("d"))
    common = counts.join(right, "b").groupBy("i", "j").agg(F.sum(F.col("c") * F.col("d")).alias("k"))
    lines = common.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "k"))).alias("m")).join(numbered.select("i", "y"), "i")
    state = lines.agg(F.sort_array(F.collect_list(F.struct("i", "y", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.col("m")[j.cast("int")], F.lit(0.0))).alias("k")))).alias("rows"))
    # the last coefficient is the bias; each step moves every coefficient by its own URL's error
    state = state.withColumn("start", F.array_repeat(F.lit(0.0), n + 1))
    logit = f"old[{n}] + aggregate(zip_with(r.k, slice(old, 1, {n}), (x, z) -> x * z), 0D, (t, x) -> t + x)"
    errors = f"transform(rows, r -> r.y - 1 / (1 + exp(-({logit}))))"
    step = f"concat(zip_with(slice(old, 1, {n}), e, (x, d) -> x * {1 - rate * ridge!r}D + {rate!r}D * d), array(old[{n}] + {rate!r}D * aggregate(e, 0D, (t, d) -> t + d)))"
    moved = F.expr(f"aggregate(sequence(1, {steps}), start, (old, s) -> element_at(transform(array({errors}), e -> {step}), 1))")
    solved = written(state.select(moved.alias("a")), "coefficients")
    weights = solved.select(F.posexplode("a").alias("i", "a")).join(counts, "i").groupBy("b").agg(F.sum(F.col("a") * F.col("c")).alias("w"))
    out = [0.0] * buckets
    for r in weights.collect():  # at most a row per bucket
        out[r["b"]] = r["w"]
    return out, solved.select(F.element_at("a", -1)).first()[0]


def _by_url():
    from pyspark.sql import Window

    return Window.orderBy("url", "label")


def block_score(host: Column, path: Column, weights: list[float], bias: float, grams: tuple[int, ...] = GRAMS) -> Column:
    """Logit of blocking."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    return F.aggregate(buckets_of(host, path, len(weights), grams), F.lit(float(bias)), lambda t, b: t + F.get(table, b))


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, *, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score, a row per row of ``pages``.

    A null url, and one without ``://``, has empty host and path and is judged by
    the classifier's bias and the few n-grams of an empty name. Null ids and
    repeated rows are kept; an empty table gives none; further columns are left out.
    """
    weights, bias = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    scored = parts.withColumns({"rule": rule, "ruled": verdict, "score": block_score(F.col("host"), F.col("path"), weights, bias)})
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
