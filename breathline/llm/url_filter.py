"""URL filter: rules first, then a tree of path templates per host judged by smoothed purity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breathline.llm.skew import lookup
from breathline.llm.storage import materialise

#: Weight of the share of allowed urls over all hosts in a template's purity.
PRIOR = 4.0
#: Confidence of the Hoeffding test that keeps two branches apart.
ALPHA = 0.05
#: A place in a path is variable from FEW values on if it has a value for every other url, and with more than MANY values in any case.
FEW, MANY = 8, 1000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host lower-cased; both empty for a null url or one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule of ``rules`` (verdict, 'host/path'); null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        on, under = rule.split("/", 1)
        fits = ((host == on) | host.endswith("." + on)) & path.startswith("/" + under)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row of ``pages`` (page_id, url).

    Urls that a rule fits are labelled by it. The tree of a host grows by one place of the
    path a level, to any depth. A place with many different values becomes a wildcard;
    else labelled sibling branches, in the order of their share of allowed urls, are merged
    with the one before unless Hoeffding's bound keeps them apart. Unlabelled siblings join
    them if FEW or more labelled ones are a single branch, for then the place tells nothing;
    else they are a branch of their own. A template's purity is its share of allowed urls,
    smoothed by the share over all hosts; a wildcard without labels has that of the
    template above it, another branch without labels none. A url without rule is blocked
    if its template has a purity below one half.

    Null urls and those without ``://`` have an empty host and path and are allowed when no
    label says otherwise; without any labelled url everything is allowed. Rows are never
    merged: repeated rows, and rows with equal or null ids, are judged alike by their url.
    Other columns are ignored; an empty table gives no rows; long urls are read whole.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), said.alias("said"))
    rows = materialise(rows.withColumn("leaf", F.concat_ws("/", "host", F.array_join(_segments(F.col("path")), "/"))), "urls")
    total = rows.count()
    leaves = rows.groupBy("leaf").agg(F.first("host").alias("host"), F.first(_segments(F.col("path"))).alias("t"), F.count(F.lit(1)).alias("n"), F.count("said").alias("labelled"), F.count_if(F.col("said") == "allow").alias("good"))
    state = materialise(leaves.withColumn("template", F.col("host")), "leaves")
    sums = state.agg(F.sum("labelled").alias("n"), F.sum("good").alias("good")).first()
    base = (sums.good + 0.5) / (sums.n + 1) if sums.n else 0.5
    state = state.withColumn("purity", F.lit(None).cast("double"))
    done, level = None, 0
    while True:
        ended = state.filter(F.size("t") <= level)
        done = ended if done is None else done.unionByName(ended)
        going = state.filter(F.size("t") > level).withColumn("seg", F.element_at("t", level + 1))
        if not going.limit(1).count():
            break
        state = materialise(_deeper(going, base), "level")
        level += 1
    tree = materialise(done.select("leaf", "n", "purity", "template"), "tree")
    judged = lookup(rows, tree, "leaf", "n", total)
    verdict = F.coalesce("said", F.when(F.col("purity") < 0.5, "block").otherwise("allow"))  # no purity, no evidence
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def _deeper(going: DataFrame, base: float) -> DataFrame:
    """``going`` with its templates and purities one place deeper; ``seg`` is the value of that place."""
    values = materialise(going.groupBy("template", "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good")), "values")
    places = values.groupBy("template").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("urls"))
    places = places.select("template", ((F.col("k") > MANY) | ((F.col("k") >= FEW) & (2 * F.col("k") >= F.col("urls")))).alias("variable"))
    values = values.join(places, "template")
    # At most MANY siblings of a place are compared: those of variable places are one wildcard.
    share = F.col("good") / F.col("labelled")
    by_share = Window.partitionBy("template").orderBy("share", "seg")
    named = values.filter("not variable and labelled > 0").withColumn("share", share)
    bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / F.sqrt("labelled") + 1 / F.sqrt(F.lag("labelled").over(by_share)))
    apart = F.coalesce((F.col("share") - F.lag("share").over(by_share)) > bound, F.lit(False)).cast("int")
    named = named.withColumn("__apart", apart).withColumn("group", F.sum("__apart").over(by_share.rowsBetween(Window.unboundedPreceding, 0)).cast("string"))
    plain = named.groupBy("template").agg(F.count(F.lit(1)).alias("siblings"), F.max("group").alias("last")).select("template", ((F.col("siblings") >= FEW) & (F.col("last") == "0")).alias("plain"))
    rest = values.filter("variable or labelled = 0").join(plain, "template", "left")
    rest = rest.withColumn("group", F.when(F.col("variable"), "*").when(F.col("plain"), "0").otherwise("?"))
    branches = named.select("template", "seg", "group", "labelled", "good").unionByName(rest.select("template", "seg", "group", "labelled", "good"))
    branches = materialise(branches, "branches")
    purity = branches.groupBy("template", "group").agg(F.sum("labelled").alias("cn"), F.sum("good").alias("cg"), F.min(F.when(F.col("labelled") > 0, F.col("seg"))).alias("name"))
    purity = purity.withColumn("own", F.when(F.col("cn") > 0, (F.col("cg") + PRIOR * base) / (F.col("cn") + PRIOR)))
    found = branches.select("template", "seg", "group").join(purity.select("template", "group", "own", "name"), ["template", "group"])
    out = going.join(found, ["template", "seg"])
    kept = F.coalesce("own", F.when(F.col("group") == "*", F.col("purity")))
    name = F.when(F.col("group").isin("*", "?"), F.col("group")).otherwise(F.col("name"))
    return out.select("leaf", "host", "t", "n", "labelled", "good", F.concat_ws("/", "template", name).alias("template"), kept.alias("purity"))
