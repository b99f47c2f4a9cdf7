"""URL filters: fixed host and path rules, then association rules mined from labelled urls.

FP-growth finds combinations of url tokens that go with the label "bad": at most one token of the host with any
path segments and query keys. A rule stays when it holds in MIN_BAD bad urls, whatever the number of labelled urls, when its
confidence is the share of bad urls plus MIN_GAIN of what is missing to 1, and when a lower bound of it (Wilson, Z deviations) is
above that share, so that chance in few urls makes no rule. A url is matched through an inverted index from token to rule: it
satisfies a rule when all tokens of the rule's antecedent are among its own. Only DataFrame functions and the FP-growth
estimator run.

Defined results: a null url, or one without `://`, has an empty host and path, no rule and verdict allow
unless a mined rule holds for its empty token set (none does). Repeated rows are judged alike; a row with a null
label does not take part in mining; no labelled url, or no rule that survives, leaves every url to the fixed
rules. Other columns pass through; those named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import broadcast_if_small, unused

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

MIN_BAD, MIN_GAIN, Z = 5, 0.5, 3.0
ANY_HOST = "host"  # no token of a url is equal to it
INDEX_ROWS = 1_000_000  # largest inverted index that is broadcast


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The set of tokens of a url: domain suffixes, host labels under the last and their hyphen parts, path segments (digits as #),
    query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.greatest(F.size(labels), F.lit(1))), "."))
    segments = F.filter(F.split(F.regexp_replace(path, r"\d+", "#"), "/"), lambda x: x != "")
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), 1)
    tag = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    under = F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))
    parts = F.concat(under, F.filter(F.flatten(F.transform(under, lambda x: F.split(x, "-"))), lambda x: x != ""))
    out = F.concat(tag("host=", F.filter(suffixes, lambda x: x != "")), tag("label=", parts), tag("path=", segments), tag("key=", query))
    return F.array_sort(F.array_distinct(out))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fixed rule that fits, as a struct of verdict and rule; null where none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        made = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def _of_host(token: Column) -> Column:
    return token.startswith("host") | token.startswith("label=")


def mine(labelled: DataFrame, min_bad: int = MIN_BAD, min_gain: float = MIN_GAIN, z: float = Z) -> DataFrame:
    """labelled (tokens, bad boolean) -> rules (rule_id, antecedent, confidence, lift, support) that predict bad.

    Suffixes, labels and parts of a host imply one another, and with an absolute support every subset of them would be
    frequent. So each url gives one basket per token of its host, and one for any host: the count of a set that holds one of these
    is its count of urls, and sets grow with the number of host tokens. Sets are mined from bad urls alone, which a rule must hold in; the
    urls that hold a set are then counted over all labelled ones."""
    known = labelled.where("bad IS NOT NULL").groupBy("tokens").agg(F.count("*").alias("urls"), F.count_if("bad").alias("bad"))
    urls, bad = known.agg(F.sum("urls"), F.sum("bad")).first()
    if (bad or 0) < min_bad:
        return labelled.sparkSession.createDataFrame([], "rule_id long, antecedent array<string>, confidence double, lift double, support double")
    host = F.explode(F.array_append(F.filter("tokens", _of_host), ANY_HOST)).alias("host")
    baskets = labelled.where("bad").select(F.filter("tokens", lambda x: ~_of_host(x)).alias("rest"), host).select(F.array_append("rest", F.col("host")).alias("items"))
    rows, base = baskets.count(), bad / urls
    least = base + min_gain * (1 - base)
    found = FPGrowth(itemsCol="items", minSupport=(min_bad - 0.5) / rows).fit(baskets).freqItemsets.where(F.exists("items", _of_host))
    sets = found.select(F.array_sort(F.array_remove("items", ANY_HOST)).alias("antecedent")).where(F.size("antecedent") > 0).select(F.xxhash64("antecedent").alias("rule_id"), "antecedent")
    counts = held(known, sets).groupBy("rule_id").agg(F.sum("urls").alias("n"), F.sum("bad").alias("hits"))
    p, n = F.col("hits") / F.col("n"), F.col("n")
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    rules = sets.join(counts, "rule_id").where((F.col("hits") >= min_bad) & (p >= least * (1 - 1e-12)) & (low > base))
    return rules.select("rule_id", "antecedent", p.alias("confidence"), (p / base).alias("lift"), (F.col("hits") / urls).alias("support"))


def held(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """baskets (tokens and others, distinct by tokens) with each rule (rule_id, antecedent) whose tokens they all hold, through token -> rule postings."""
    index = rules.select("rule_id", F.size("antecedent").alias("need"), F.explode("antecedent").alias("token"))
    hits = baskets.select("tokens", F.explode("tokens").alias("token")).join(broadcast_if_small(index, INDEX_ROWS), "token")
    full = hits.groupBy("tokens", "rule_id").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need")
    return baskets.join(full.select("tokens", "rule_id"), "tokens")


def match(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """baskets (tokens), distinct -> those that satisfy at least one rule."""
    return held(baskets, rules).select("tokens").distinct()


def judge(pages: DataFrame, labelled: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule and verdict. labelled (url, bad boolean) are the urls to learn from.

    Urls share few token sets (numbers are folded), so sets are made distinct before they are matched."""
    u = F.col(f"`{url}`")
    out = pages.drop("host", "path", "rule", "verdict")
    columns = [F.col(f"`{c}`") for c in out.columns]
    tokens, fixed, hit = unused(out, "tokens", "fixed", "hit")
    out = out.withColumn("host", host_of(u)).withColumn("path", path_of(u))
    out = out.withColumn(tokens, tokens_of(u, F.col("host"), F.col("path"))).withColumn(fixed, fixed_rule(F.col("host"), F.col("path"), rules))
    known = labelled.select("url", "bad").withColumn("tokens", tokens_of(F.col("url"), host_of(F.col("url")), path_of(F.col("url"))))
    bad = match(out.where(F.col(fixed).isNull()).select(F.col(tokens).alias("tokens")).distinct(), mine(known))
    bad = bad.select(F.col("tokens").alias(tokens), F.lit(True).alias(hit))
    out = out.join(broadcast_if_small(bad, INDEX_ROWS), tokens, "left")
    verdict = F.coalesce(F.col(f"{fixed}.verdict"), F.when(F.col(hit), "block").otherwise("allow"))
    return out.select(*columns, "host", "path", F.col(f"{fixed}.rule").alias("rule"), verdict.alias("verdict"))
