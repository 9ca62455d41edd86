"""URL filtering by association rules, with DataFrame functions only.

Fixed host rules judge part of the pages. Their verdicts are the labels: FP-growth mines which combinations
of URL tokens go with ``allow`` and ``block`` among the judged pages (tokens that always occur together as one, so that
a long URL many pages share is no combinatorial matter), rules are pruned by support and confidence, and pages
without a fixed rule are matched through an inverted index from token to rule.

A null URL, or one without ``://``, has an empty host and path, no tokens, and takes the default verdict, as
does every page no mined rule fits. Repeated rows are judged each on its own; of several mined rules the most
confident wins, then the longer, then the better supported, then ``block``. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loglake.llm.shared import ascii_lower, stored, table

#: Fixed values: (verdict, host, path prefix).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
DEFAULT_VERDICT = "allow"
_LABEL = "verdict="
#: Rows of one token set that are dealt out together, and shares its pages are divided into.
RUN_ROWS = 100_000
SHARES = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty without ``://``."""
    known = F.instr(url, "://") > 0
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(F.when(known, ascii_lower(host)), empty), F.coalesce(F.when(known, path), empty)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fixed rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(prefix))
        name = F.when(fits, rule_host + prefix).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, path words, and how deep the path is (up to 9)."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(ascii_lower(path), r"[^\p{L}]+"), lambda x: x != "")
    depth = F.least(F.size(F.split(path, "/")), F.lit(9)).cast("string")
    return F.array_sort(
        F.array_distinct(
            F.concat(
                F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
                F.transform(words, lambda x: F.concat(F.lit("p:"), x)),
                F.when(host != "", F.array(F.concat(F.lit("depth:"), depth))).otherwise(
                    F.expr("array()").cast("array<string>")
                ),
            )
        )
    )


def token_classes(sets: DataFrame, min_support: float) -> DataFrame:
    """``(token, class, freq)`` of the tokens frequent among ``sets (items, label, n)``.

    Tokens that occur in exactly the same sets are one class, named by its smallest token: they support the same rules, so
    mining them one by one would only list all combinations of them. There are at most as many frequent tokens as a
    URL has tokens on average, divided by ``min_support``.
    """
    rows = sets.agg(F.sum("n")).scalar()
    prints = [F.xxhash64("items", F.lit(i)).cast("decimal(38,0)").alias(f"h{i}") for i in (1, 2)]
    seen = sets.select(F.explode("items").alias("token"), "n", *prints)
    often = seen.groupBy("token").agg(F.sum("n").alias("freq"), F.sum("h1").alias("a"), F.sum("h2").alias("b"))
    same = F.min("token").over(W.partitionBy("a", "b", "freq"))
    return often.filter(F.col("freq") >= F.lit(min_support) * rows).select("token", same.alias("class"), "freq")


def _in_classes(sets: DataFrame, classes: DataFrame, *keys: str) -> DataFrame:
    """``sets`` with ``classes``: the classes of each set's tokens, with how many tokens of each it holds."""
    tokens = sets.select(*keys, F.explode("items").alias("token")).join(F.broadcast(classes.select("token", "class")), "token")
    held = tokens.groupBy(*keys, "class").agg(F.count("*").alias("k"))
    return held.groupBy(*keys).agg(F.collect_list(F.struct("class", "k")).alias("classes"))


def mine_rules(
    sets: DataFrame, classes: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """Association rules ``(rarest, antecedent, confidence, support, mined)`` from distinct ``(items, label, n)``.

    Antecedents are classes of tokens. A rule is posted under its rarest class, so a page meets it only where that occurs.
    """
    described = sets.join(_in_classes(sets, classes, "items", "label"), ["items", "label"], "left")
    names = F.coalesce(F.col("classes.class"), F.expr("array()").cast("array<string>"))
    # Sets count as often as they occur; one that very many pages have is dealt out in runs.
    runs = described.select(
        F.concat(names, F.array(F.concat(F.lit(_LABEL), "label"))).alias("items"), "n",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {RUN_ROWS}"))).alias("run"),
    ).repartition("items", "run")
    times = F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(RUN_ROWS), F.col("n") - F.col("run") * RUN_ROWS))
    rows = runs.select("items", F.explode(times)).select("items")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    consequent = F.get("consequent", F.lit(0))
    rules = model.associationRules.filter(F.startswith(consequent, F.lit(_LABEL))).select(
        "antecedent", "confidence", "support", F.substr(consequent, F.lit(len(_LABEL) + 1)).alias("mined"),
    )
    common = classes.select(F.col("class").alias("token"), "freq").distinct()
    return (
        rules.select("*", F.explode("antecedent").alias("token"))
        .join(F.broadcast(common), "token")
        .groupBy("antecedent", "confidence", "support", "mined")
        .agg(F.min(F.struct("freq", "token"))["token"].alias("rarest"))
    )


def match_rules(sets: DataFrame, classes: DataFrame, rules: DataFrame) -> DataFrame:
    """``(items, mined)``: the best rule for each of the distinct token sets that some rule fits.

    A class fits by any of its tokens, and counts as many tokens as the set holds of it: as its longest rule would.
    """
    described = _in_classes(sets, classes, "items").withColumn("held", F.map_from_entries("classes"))
    fits = F.forall("antecedent", lambda name: F.map_contains_key("held", name))
    size = F.aggregate("antecedent", F.lit(0).cast("bigint"), lambda total, name: total + F.element_at("held", name))
    best = F.max(F.struct("confidence", "size", "support", "mined"))
    return (
        described.select("items", "held", F.explode("classes.class").alias("rarest"))
        .join(rules, "rarest")
        .filter(fits)
        .withColumn("size", size)
        .groupBy("items")
        .agg(best.alias("best"))
        .select("items", F.col("best.mined").alias("mined"))
    )


def judge_urls(
    pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every page.

    Only pages no fixed rule judges look for a mined one; those of one token set do so in several shares.
    """
    host, path = host_and_path(pages["url"])
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, fixed = fixed_rule(F.col("host"), F.col("path"), rules)
    judged = parts.select(
        "*", rule.alias("rule"), fixed.alias("fixed"), url_tokens(F.col("host"), F.col("path")).alias("items"),
        F.pmod(F.xxhash64("page_id"), F.lit(SHARES)).alias("share"),
    )
    known = judged.filter(F.col("fixed").isNotNull())
    sets = stored(known.groupBy("items", F.col("fixed").alias("label")).agg(F.count("*").alias("n")), "url-sets")
    classes = stored(token_classes(sets, min_support), "url-classes")
    mined = stored(mine_rules(sets, classes, min_support, min_confidence), "url-rules")
    open_pages = judged.filter(F.col("fixed").isNull())
    open_sets = stored(open_pages.groupBy("items").agg(F.collect_set("share").alias("shares")), "url-open")
    verdicts = match_rules(open_sets.select("items"), classes, mined).join(open_sets, "items")
    verdicts = verdicts.select("items", "mined", F.explode("shares").alias("share"))
    found = open_pages.join(verdicts, ["items", "share"], "left")
    shown = ["page_id", "host", "path", "rule"]
    return known.select(*shown, F.col("fixed").alias("verdict")).unionByName(
        found.select(*shown, F.coalesce("mined", F.lit(DEFAULT_VERDICT)).alias("verdict"))
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
