"""URL filters: fixed host and path rules, and association rules mined from labelled pages.

FP-growth finds the token combinations of labelled URLs that go with the class "block";
rules are pruned by support, confidence and by simpler rules that do as well, and matched by
an inverted index from each rule's rarest token to the rule. URLs are matched by their distinct token sets, so a host with
a third of all pages costs as much as any other.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored

# Fixed rules of the contract: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BLOCK = "class=block"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``? #`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct(rule, verdict) of the longest fixed rule that fits the host or a parent domain and leads the path; null where none does."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, lead, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        hit = ((host == name) | host.endswith("." + name)) & path.startswith(lead)
        fits = F.when(hit, F.struct(F.lit(name + lead).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels and the registered name, path segments (digits as #), extension, query keys, fragment."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    segments = F.transform(F.array_remove(F.split(path, "/"), ""), lambda s: F.concat(F.lit("path="), F.regexp_replace(F.regexp_replace(F.lower(s), r"\.[a-z]+$", ""), r"[0-9]+", "#")))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda k: F.concat(F.lit("query="), F.lower(k)))
    part = lambda lead, value: F.when(F.coalesce(value, F.lit("")) != "", F.array(F.concat(F.lit(lead), F.lower(value)))).otherwise(F.array().cast("array<string>"))
    single = F.concat(
        part("scheme=", F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), part("site=", F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)),
        part("ext=", F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)), part("fragment=", F.regexp_extract(url, r"#(.+)$", 1)),
    )
    return F.array_sort(F.array_distinct(F.concat(F.transform(F.array_remove(labels, ""), lambda x: F.concat(F.lit("host="), x)), segments, keys, single)))


def by_rarest(rules: DataFrame) -> DataFrame:
    """The rules with the token that the fewest of them hold, by which they are looked up."""
    each = rules.withColumn("token", F.explode("rule"))
    rarest = each.join(each.groupBy("token").agg(F.count("*").alias("n")), "token").groupBy("rule").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    return rules.join(rarest, "rule")


def mine_rules(urls: DataFrame, min_support: float = 0.0, min_confidence: float = 0.6, min_rows: int = 20) -> DataFrame:
    """rule (token array), n_tokens, confidence, support, from columns url and blocked (boolean).

    All labelled rows take part. A rule must rest on ``min_rows`` blocked rows, however many others there are, and on the share ``min_support``
    of all labelled rows if one is asked for. A rule is left out if a rule on a part of its tokens is as confident. Null labels are left out.
    No labels or no rule: an empty table.

    Two kinds of tokens are left out of FP-growth, which changes no rule: those with too few blocked rows of their own, and those all of whose
    rows are blocked, since no longer rule is more confident.
    """
    spark = urls.sparkSession
    items = stored(urls.filter(F.col("blocked").isNotNull()).select(tokens_of(F.col("url")).alias("tokens"), "blocked"), "labelled")
    rows = items.count()
    least = max(min_rows, math.ceil(min_support * rows), 1)
    none = spark.createDataFrame([], "rule array<string>, n_tokens int, confidence double, support double")
    if rows < least:
        return none
    counts = items.select(F.explode("tokens").alias("token"), "blocked").groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("n_blocked"))
    counts = stored(counts.filter(F.col("n_blocked") >= least), "tokens")
    certain = counts.filter("n_blocked = n").select(F.array("token").alias("rule"), F.lit(1).alias("n_tokens"), F.lit(1.0).alias("confidence"), (F.col("n_blocked") / rows).alias("support"))
    kept = items.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(counts.filter("n_blocked < n").select("token"), "token").groupBy("tokens").agg(F.collect_set("token").alias("kept"))
    sets = stored(items.join(kept, "tokens").select(F.concat("kept", F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items")), "items")
    left = sets.count()
    if left >= least:
        # FP-growth rounds the product of support and rows up; half a row less keeps it at ``least``.
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / left, minConfidence=min_confidence).fit(sets)
        found = model.associationRules.filter((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BLOCK))
        found = found.select(F.array_sort("antecedent").alias("rule"), F.size("antecedent").alias("n_tokens"), "confidence", (F.col("support") * left / rows).alias("support"))
        found = stored(certain.unionByName(found), "rules")
    else:
        found = stored(certain, "rules")
    # A smaller rule inside a larger one shares all its tokens; look up by its rarest, then test containment.
    small, large = by_rarest(found).select(F.col("rule").alias("s"), F.col("confidence").alias("sc"), "token"), found.select("rule", "confidence", F.explode("rule").alias("token"))
    beaten = large.join(small, "token").filter((F.size("s") < F.size("rule")) & (F.size(F.array_except("s", "rule")) == 0) & (F.col("sc") >= F.col("confidence"))).select("rule").distinct()
    return found.join(beaten, "rule", "left_anti")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, mined_rule, confidence: the most confident rule whose tokens are all in the set, for the sets (column tokens) that have one."""
    index = by_rarest(rules).select("rule", "confidence", "token")
    hits = token_sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("rule", "tokens")) == 0)
    best = hits.groupBy("tokens").agg(F.max(F.struct("confidence", "rule")).alias("best"))
    return best.select("tokens", F.array_join("best.rule", " & ").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def url_verdicts(pages: DataFrame, labelled: DataFrame, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule for each row of ``pages`` (page_id, url).

    A fixed rule decides where one fits, else a mined rule blocks, else the page is allowed. A null url or one without ``://`` has
    no host, path or fixed rule. Repeated rows get the same verdict; other columns are not read.
    """
    rules = mine_rules(labelled, **how)
    step = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens_of(F.col("url")).alias("tokens"))
    matched = match_rules(step.select("tokens").distinct(), rules)
    out = step.join(matched, "tokens", "left").withColumn("fixed", fixed_rule(F.col("host"), F.col("path")))
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "mined_rule")
