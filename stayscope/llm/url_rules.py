"""URL filtering: a fixed rule list first, mined association rules for what the list leaves open.

FP-growth finds combinations of URL tokens that go with a label. Rules above a confidence and a
support stay, without those that a shorter rule already covers. They match by an inverted index:
each rule is filed under its rarest token, and the other tokens are then looked for in the URL.
Only DataFrame functions and Spark ML's FP-growth are used.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayscope.sources.staging import stage

from .text import ascii_lower


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for text without ``://``."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, null if none does.

    ``rules``: (verdict, host and path such as ``example.com/en/``). A rule fits its host and all
    subdomains when the URL's path starts with the rule's path. Rules are tried longest first.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, below = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL, each marked by where it stands; no token is null."""
    host, path = url_parts(url)
    labels = F.reverse(F.split(host, r"\."))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda s: s != "")
    marked = F.concat(
        F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x)),
        F.transform(segments, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), x)),
        F.transform(query, lambda x: F.concat(F.lit("query="), F.regexp_extract(x, r"^([^=]*)", 1))),
        F.array(
            F.concat(F.lit("scheme="), ascii_lower(F.regexp_extract(url, r"^(.*?)://", 1))),
            F.concat(F.lit("end="), F.regexp_extract(path, r"(\.[A-Za-z0-9]+|/)?$", 1)),
        ),
    )
    return F.coalesce(F.array_distinct(marked), F.array().cast("array<string>"))


def mine_rules(
    labelled: DataFrame,
    url: str = "url",
    label: str = "label",
    min_support: float = 0.002,
    min_confidence: float = 0.6,
) -> DataFrame:
    """Rules: rule_id, tokens, verdict, confidence, support, key (its rarest token).

    Rows without a URL or label are left out, as they say nothing; repeated rows count each time.
    All labelled rows are mined. ``min_support`` is a share of the rows and so bounds the number
    of rules at every size: a URL has few tokens, and each must be in that share of the URLs. Rules
    have as many tokens as it takes.
    No labelled rows give no rules.
    """
    spark = labelled.sparkSession
    items = (
        labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull())
        .select(
            F.concat(url_tokens(F.col(url)), F.array(F.concat(F.lit("label="), F.col(label)))).alias("items")
        )
    )
    items = stage(items, "url-items")
    empty = "rule_id long, tokens array<string>, verdict string, confidence double, support double, key string"
    if items.isEmpty():
        return spark.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    is_label = lambda x: x.startswith("label=")
    found = (
        model.associationRules.where(
            is_label(F.col("consequent")[0]) & ~F.exists("antecedent", is_label)
        )
        .select(
            F.array_sort("antecedent").alias("tokens"),
            F.substr(F.col("consequent")[0], F.lit(len("label=") + 1)).alias("verdict"),
            "confidence",
            "support",
        )
    )
    found = stage(found, "url-rules")
    # A rule is idle if one of its own parts already gives that verdict at least as surely.
    # Most are idle by a part of one token less; what is left has all rules that can make others idle.
    less = found.select(
        "tokens", "verdict", "confidence", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part")
    )
    parts = found.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("c2"))
    covered = less.join(parts, ["part", "verdict"]).where("c2 >= confidence").select("tokens", "verdict").distinct()
    found = stage(found.join(covered, ["tokens", "verdict"], "left_anti"), "url-rules-left")
    # Parts are looked for under their first token only, so each is met once.
    idle = (
        found.select("tokens", "verdict", "confidence", F.explode("tokens").alias("token"))
        .join(
            found.select(
                F.col("tokens").alias("t2"), "verdict", F.col("confidence").alias("c2"), F.col("tokens")[0].alias("token")
            ),
            ["token", "verdict"],
        )
        .where((F.col("c2") >= F.col("confidence")) & (F.size("t2") < F.size("tokens")))
        .where(F.size(F.array_except("t2", "tokens")) == 0)
        .select("tokens", "verdict")
        .distinct()
    )
    counts = model.freqItemsets.where(F.size("items") == 1).select(
        F.col("items")[0].alias("token"), F.col("freq").alias("n")
    )
    kept = found.join(idle, ["tokens", "verdict"], "left_anti")
    keyed = (
        kept.withColumn("token", F.explode("tokens"))
        .join(counts, "token")
        .groupBy("tokens", "verdict", "confidence", "support")
        .agg(F.min(F.struct("n", "token")).alias("rarest"))
    )
    return keyed.select(
        F.xxhash64("tokens", "verdict").alias("rule_id"),
        "tokens",
        "verdict",
        "confidence",
        "support",
        F.col("rarest")["token"].alias("key"),
    )


def match_rules(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Best rule of every distinct URL that has one: url, verdict, confidence, tokens.

    Repeated URLs are matched once. Of several rules the surest wins, then the better supported
    one, then the smaller verdict and tokens. Null URLs match nothing.
    """
    distinct = urls.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("url")).agg(F.lit(1).alias("one"))
    tokens = distinct.select("url", url_tokens(F.col("url")).alias("has"))
    hits = (
        tokens.select("url", "has", F.explode("has").alias("key"))
        .join(rules, "key")
        .where(F.size(F.array_except("tokens", "has")) == 0)
    )
    best = hits.groupBy("url").agg(
        F.min(F.struct(-F.col("confidence"), -F.col("support"), "verdict", "tokens")).alias("best")
    )
    return best.select(
        "url",
        F.col("best.verdict").alias("verdict"),
        (-F.col("best.col1")).alias("confidence"),
        F.col("best.tokens").alias("tokens"),
    )


def judge_urls(
    pages: DataFrame,
    listed: list[tuple[str, str]],
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Every row's key, host, path, rule, verdict, confidence (of a mined rule) and by.

    ``by`` is list, rule or default. Null and broken URLs have empty host and path, meet no rule and
    get the default. Repeated rows are judged alike. Other columns are not read.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url")).select(
        "page_id", "url", host.alias("host"), path.alias("path")
    )
    rule, says = listed_rule(F.col("host"), F.col("path"), listed)
    rows = rows.select("*", rule.alias("rule"), says.alias("said"))
    mined = match_rules(rows.where(F.col("said").isNull()), rules).select(
        F.col("url").alias("mined_url"), F.col("verdict").alias("mined"), "confidence"
    )
    judged = rows.join(mined, F.col("said").isNull() & (F.col("url") == F.col("mined_url")), "left")
    return judged.select(
        F.col("page_id").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("said", "mined", F.lit(default)).alias("verdict"),
        "confidence",
        F.when(F.col("said").isNotNull(), "list").when(F.col("mined").isNotNull(), "rule").otherwise("default").alias("by"),
    )
