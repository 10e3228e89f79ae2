"""URL judgement: stated host and path rules, then mined token combinations.

URLs that a stated rule fits are labels.  FP-growth mines combinations of URL
tokens that go with the verdict; rules of any length are pruned by support and
confidence alone.  Tokens that the same labelled URLs have are mined as one and
stand for each other in the rules, which are held in an inverted index under their rarest token, which each URL's tokens look
up.  The longest stated rule wins; URLs that none fits get the verdict of the
mined rules: block where a block rule's confidence is above every allow rule's,
else allow.

Results in odd cases: a null url or one without "://" has empty host and path
and no rule; the empty table gives an empty result; with labels of one kind
only, or none, nothing is mined against it and the method allows; repeated rows
are judged each; ties between stated rules can't occur, as rules differ in host
or path and all that fit one url lie along one line of suffixes and prefixes,
ordered by length and then by name.
"""

from __future__ import annotations

from itertools import product

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pages, stored

# The stated rules as host, path and verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Share of labelled URLs that a combination has; share of them with the verdict.
SUPPORT, CONFIDENCE = 0.002, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits."""
    fits = [(h, p, v, ((host == h) | host.endswith("." + h)) & path.startswith(p)) for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))]
    name = verdict = None
    for h, p, v, ok in fits:
        name = F.when(ok, h + p) if name is None else name.when(ok, h + p)
        verdict = F.when(ok, v) if verdict is None else verdict.when(ok, v)
    return (name, verdict) if fits else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, their words and host suffixes; every part of the path, the first, ending and shape of it; query keys and values, fragment and scheme."""

    def marked(kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.concat(F.lit(kind + ":"), x))

    def folded(x: Column) -> Column:
        return F.regexp_replace(x, r"\d+", "0")

    labels = F.split(host, r"\.")
    words = F.flatten(F.transform(labels, lambda x: F.split(x, "-")))
    # from the second label on up to the last but one: the labels themselves have the last one
    starts = F.when(F.size(labels) > 2, F.sequence(F.lit(2), F.size(labels) - 1)).otherwise(F.array().cast("array<int>"))
    suffixes = F.transform(starts, lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), folded)
    ending = F.regexp_extract(path, r"\.([^./]+)$", 1)
    shape = folded(F.regexp_replace(path, r"\p{L}+", "a"))
    pairs = F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    keys = F.transform(pairs, lambda x: F.substring_index(x, "=", 1))
    values = F.transform(F.filter(pairs, lambda x: x.contains("=")), folded)
    fragment = folded(F.regexp_extract(url, r"(?s)#(.*)$", 1))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    every = F.concat(
        marked("host", labels), marked("word", words), marked("suffix", suffixes), marked("path", parts), marked("first", F.slice(parts, 1, 1)), marked("ending", F.array(ending)),
        marked("shape", F.array(shape)), marked("query", keys), marked("value", values), marked("fragment", F.array(fragment)), marked("scheme", F.array(scheme)),
    )
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(every, F.array().cast("array<string>")), lambda x: ~x.rlike("^[a-z]+:$"))))


def mine(labelled: DataFrame) -> list[tuple[tuple[str, ...], str, float]]:
    """Token combinations, verdict and confidence; labelled has tokens and verdict."""
    items = F.concat("tokens", F.array(F.concat(F.lit("verdict="), "verdict")))
    total = labelled.count()
    if not total:
        return []
    # tokens of the same urls are one item, named by the least; SUPPORT bounds how many are frequent
    rows = labelled.withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "verdict", F.explode("tokens").alias("token"))
    prints = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).alias("b"))
    alike: dict[tuple, list[str]] = {}
    for r in prints.where(F.col("n") >= SUPPORT * total).orderBy("token").collect():
        alike.setdefault((r["n"], r["a"], r["b"]), []).append(r["token"])
    if not alike:
        return []
    names = labelled.sparkSession.createDataFrame([(group[0],) for group in alike.values()], "token string")
    found = each.join(F.broadcast(names), "token").groupBy("row", "verdict").agg(F.collect_list("token").alias("tokens"))
    items = F.concat("tokens", F.array(F.concat(F.lit("verdict="), "verdict")))
    # urls of no frequent token have no combination; the share is of all urls
    known = found.select(items.alias("items")).persist()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, SUPPORT * total / known.count()), minConfidence=CONFIDENCE).fit(known)
    mark = F.filter("items", lambda x: x.startswith("verdict="))
    rest = F.array_sort(F.filter("items", lambda x: ~x.startswith("verdict=")))
    split = model.freqItemsets.select(mark.alias("mark"), rest.alias("rest"), "freq")
    alone = split.where("size(mark) = 0").select("rest", F.col("freq").alias("all"))
    rules = split.where("size(mark) = 1 and size(rest) > 0").join(alone, "rest").withColumn("confidence", F.col("freq") / F.col("all")).where(F.col("confidence") >= CONFIDENCE)
    # at most as many as combinations of SUPPORT can be frequent in urls of a few tokens
    mined = [(tuple(r["rest"]), r["mark"][0].removeprefix("verdict="), r["confidence"]) for r in rules.collect()]
    known.unpersist()
    # a rule is dropped where a part of it says the same at least as surely
    kept, under = [], {}
    for tokens, verdict, confidence in sorted(mined, key=lambda r: (len(r[0]), r[0], r[1])):
        own = set(tokens)
        if not any(c >= confidence and part <= own for t in tokens for part, c in under.get((t, verdict), ())):
            kept.append((tokens, verdict, confidence))
            under.setdefault((tokens[0], verdict), []).append((own, confidence))
    groups = {group[0]: group for group in alike.values()}
    return [(tuple(sorted(x)), verdict, confidence) for tokens, verdict, confidence in kept for x in product(*(groups[t] for t in tokens))]


def judge(urls: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict, confidence of each row."""
    spark = urls.sparkSession
    base = urls.select(F.col(id_col), F.col(url_col).alias("__url"))
    base = base.withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))})
    name, verdict = stated_rule(F.col("host"), F.col("path"), rules)
    base = stored(base.withColumns({"rule": name, "stated": verdict, "tokens": url_tokens(F.col("__url"), F.col("host"), F.col("path"))}).drop("__url"), "urls")
    mined = mine(base.where("stated is not null").select("tokens", F.col("stated").alias("verdict")))
    # the inverted index: rarest token to the rules that it begins
    uses: dict[str, int] = {}
    for tokens, _, _ in mined:
        for t in tokens:
            uses[t] = uses.get(t, 0) + 1
    index: dict[str, list] = {}
    for tokens, v, c in mined:
        index.setdefault(min(tokens, key=lambda t: (uses[t], t)), []).append((list(tokens), v, float(c)))
    table = spark.createDataFrame([(k, v) for k, v in sorted(index.items())], "token string, rules array<struct<tokens: array<string>, verdict: string, confidence: double>>")
    # only urls without a stated rule ask the index; distinct token sets ask once
    asking = base.where("stated is null").select("tokens").distinct()
    hits = asking.withColumn("token", F.explode("tokens")).join(F.broadcast(table), "token").withColumn("r", F.explode("rules")).where("size(array_except(r.tokens, tokens)) = 0")
    surest = hits.groupBy("tokens").agg(F.max(F.when(F.col("r.verdict") == "block", F.col("r.confidence"))).alias("block"), F.max(F.when(F.col("r.verdict") == "allow", F.col("r.confidence"))).alias("allow"))
    blocked = F.coalesce(F.col("block"), F.lit(0.0)) > F.coalesce(F.col("allow"), F.lit(0.0))
    mined_verdict = F.when(blocked, "block").otherwise("allow")
    return base.join(surest, "tokens", "left").select(
        id_col, "host", "path", "rule", F.coalesce("stated", mined_verdict).alias("verdict"), F.when(F.col("rule").isNull(), F.greatest("block", "allow")).alias("confidence")
    )


def op6_url_filter(spark, sf_dir):
    return judge(pages(spark, sf_dir))
