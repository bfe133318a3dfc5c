"""URL filtering by association rules.

Given rules decide the URLs that they cover, and label them. FP-growth mines which combinations of URL tokens go with
which verdict; rules of enough support and confidence, none of them implied by a shorter one at least as sure, judge
the other URLs. Tokens that come in the same labelled URLs count as one while rules are mined, since any choice of them makes the same rule. Each
rule is found by its rarest token (an inverted index), once per distinct set of tokens. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import common_join, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict): a rule is a host and the start of a path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
LABEL = "verdict="
#: Rules are sent to every executor up to this number, else joined by a shuffle.
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits (ties: the first in alphabetical order) with its verdict, as a struct; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: each ending of the host at a dot, each word of the host, each segment of the path. A run of digits in the path counts as 0."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    endings = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("end:"), F.array_join(F.slice(parts, i, n), ".")))
    plain = F.regexp_replace(path, "[0-9]+", "0")
    words = F.transform(F.split(host, r"[^\p{L}\p{N}]+"), lambda w: F.concat(F.lit("host:"), w))
    segments = F.transform(F.split(plain, "/"), lambda w: F.concat(F.lit("path:"), w))
    some = F.filter(F.array_distinct(F.concat(endings, words, segments)), lambda t: ~t.isin("end:", "host:", "path:"))
    return F.array_sort(some)


def parsed(df: DataFrame, url: str, rules: list[tuple[str, str]]) -> DataFrame:
    hosts = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    return hosts.withColumn("matched", matched(F.col("host"), F.col("path"), rules))


def merged(labelled: DataFrame, items: str = "items", support: float = 0.005) -> DataFrame:
    """token, name of the tokens that reach the support: those in the same rows have one name, the least of them. Two sums over the rows' 64-bit hashes tell rows apart.

    There are no more than tokens a row over support, whatever the number of rows.
    """
    least = support * labelled.count()
    rows = labelled.select(items, F.monotonically_increasing_id().alias("row"))
    each = rows.select(F.explode(items).alias("token"), F.xxhash64("row").alias("h"), F.xxhash64(F.lit(1), "row").alias("g"))
    spread = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    found = each.groupBy("token").agg(F.count("*").alias("n"), spread("h").alias("h"), spread("g").alias("g")).filter(F.col("n") >= least)
    names = found.groupBy("n", "h", "g").agg(F.min("token").alias("name"))
    return found.join(names, ["n", "h", "g"]).select("token", "name")


def named(sets: DataFrame, names: DataFrame, tokens: str) -> DataFrame:
    """sets, a row for each distinct array of tokens, with named: the distinct names of its tokens, an empty array without any."""
    if names.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        names = F.broadcast(names)
    found = sets.select(tokens, F.explode(tokens).alias("token")).join(names, "token").groupBy(tokens).agg(F.sort_array(F.collect_set("name")).alias("named"))
    return sets.join(found, tokens, "left").withColumn("named", F.coalesce("named", F.array().cast("array<string>")))


def repeated(df: DataFrame, n: str, at_once: int = 1000) -> DataFrame:
    """Each row n times, dealt over the partitions in pieces, so that no task gets all copies of a row."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = df.withColumn("_p", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / at_once)))).repartition(parts)
    return pieces.withColumn("_i", F.explode(F.sequence(F.lit(1), F.least(F.lit(at_once), F.col(n) - F.col("_p") * at_once)))).drop("_p", "_i")


def mine(labelled: DataFrame, items: str = "items", support: float = 0.005, confidence: float = 0.8) -> DataFrame:
    """tokens (array), verdict, confidence, support, lift of the rules whose consequence is a verdict.

    labelled: one array of tokens a row, the label among them. Pruned: rules under either bound, rules that hold no more often
    than the verdict alone does (lift <= 1), and rules with a shorter rule of the same verdict at least as sure. An empty table
    gives no rules.
    """
    n = labelled.count()
    sets = materialize(FPGrowth(itemsCol=items, minSupport=support, minConfidence=confidence).fit(labelled).freqItemsets)
    label = F.filter("items", lambda t: t.startswith(LABEL))
    split = sets.select(F.array_sort(F.filter("items", lambda t: ~t.startswith(LABEL))).alias("tokens"), F.get(label, F.lit(0)).alias("label"), F.size(label).alias("labels"), "freq")
    whole = split.filter("labels = 0").select("tokens", F.col("freq").alias("all"))
    share = split.filter("labels = 1 and size(tokens) = 0").select("label", F.col("freq").alias("marked"))
    both = split.filter("labels = 1 and size(tokens) > 0").join(whole, "tokens").join(F.broadcast(share), "label")  # a row for each verdict
    sure = F.col("freq") / F.col("all")
    rules = both.select("tokens", F.substring("label", len(LABEL) + 1, 1000).alias("verdict"), sure.alias("confidence"), (F.col("freq") / F.lit(n)).alias("support"), (sure * n / F.col("marked")).alias("lift"))
    rules = rules.filter((F.col("lift") > 1) & (F.col("confidence") >= confidence))
    # A rule goes if any shorter one over some of its tokens is as sure. Subsets one token shorter need not be rules themselves, so the best confidence of a set's subsets is carried up by size.
    return materialize(_minimal(rules))


def _minimal(rules: DataFrame) -> DataFrame:
    """rules without those that hold all tokens of a shorter one of the same verdict with at least their confidence. The shorter one is found by its least token."""
    shorter = rules.select("verdict", F.col("tokens").alias("part"), F.col("confidence").alias("other"), F.col("tokens")[0].alias("token"))
    longer = rules.select("verdict", "tokens", "confidence", F.explode("tokens").alias("token"))
    held = (F.size("part") < F.size("tokens")) & (F.col("other") >= F.col("confidence")) & (F.size(F.array_except("part", "tokens")) == 0)
    implied = longer.join(shorter, ["verdict", "token"]).filter(held).select("verdict", "tokens").distinct()
    return rules.join(implied, ["verdict", "tokens"], "left_anti")


def apply_rules(sets: DataFrame, rules: DataFrame, tokens: str = "tokens") -> DataFrame:
    """tokens, found (struct of confidence, support, size, verdict) for each row of sets that a rule fits: the surest, then best supported, then longest rule."""
    own = rules.select(F.col("tokens").alias("needs"), "verdict", "confidence", "support")
    often = own.select(F.explode("needs").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # The token that the fewest rules share stands for the rule in the index.
    ranked = own.withColumn("token", F.explode("needs")).join(often, "token").groupBy("needs", "verdict", "confidence", "support").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    index = ranked.groupBy("token").agg(F.collect_list(F.struct("confidence", "support", F.size("needs").alias("size"), "verdict", "needs")).alias("rules"))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    hits = sets.select(F.col(tokens).alias("set"), F.explode(tokens).alias("token")).join(index, "token")
    fits = F.filter("rules", lambda r: F.size(F.array_except(r["needs"], F.col("set"))) == 0)
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["confidence"].alias("confidence"), r["support"].alias("support"), r["size"].alias("size"), r["verdict"].alias("verdict"))))
    return hits.select("set", best.alias("found")).filter("found is not null").groupBy("set").agg(F.max("found").alias("found")).withColumnRenamed("set", tokens)


def judge(df: DataFrame, url: str = "url", rules: list[tuple[str, str]] = RULES, support: float = 0.005, confidence: float = 0.8, default: str = "allow") -> DataFrame:
    """df's columns besides those of the same names, and host, path, rule, verdict, confidence.

    A given rule that fits decides, the longest first; else the surest mined rule; else default, as for a null url, one
    without `://`, or one with no known token. confidence is the mined rule's, else null. Repeated rows each get their row;
    an empty table gives an empty result.
    """
    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict", "confidence", "matched", "tokens", "found", "n")]
    full = materialize(parsed(df.select(*kept), url, rules).withColumn("tokens", tokens_of(F.col("host"), F.col("path"))))
    covered, open_ = full.filter("matched is not null"), full.filter("matched is null and size(tokens) > 0")
    names = materialize(merged(covered, "tokens", support))
    label = F.concat(F.lit(LABEL), F.col("matched.verdict"))
    known = covered.groupBy("tokens").agg(*(F.sum((label == f"{LABEL}{v}").cast("long")).alias(v) for v in ("allow", "block")))
    weighted = named(known, names, "tokens").select("named", F.explode(F.array(*(F.struct(F.lit(f"{LABEL}{v}").alias("label"), F.col(v).alias("n")) for v in ("allow", "block")))).alias("c"))
    labelled = repeated(weighted.filter("c.n > 0").groupBy("named", "c.label").agg(F.sum("c.n").alias("n")), "n").select(F.concat("named", F.array("label")).alias("items"))
    mined = mine(labelled, "items", support, confidence)
    sets = named(open_.groupBy("tokens").agg(F.count("*").alias("n")), names, "tokens")
    judged = apply_rules(sets.filter("size(named) > 0").select("named").distinct(), mined, "named")
    verdicts = materialize(sets.join(judged, "named", "left").select("tokens", "found", "n"))
    whole = common_join(full.withColumn("tokens", F.when(F.col("matched").isNull() & (F.size("tokens") > 0), F.col("tokens"))), verdicts, "tokens", "n", full.count())
    return whole.select(*kept, "host", "path", F.col("matched.rule").alias("rule"), F.coalesce("matched.verdict", "found.verdict", F.lit(default)).alias("verdict"), F.col("found.confidence").alias("confidence"))


def op2(pages: DataFrame) -> DataFrame:
    """The contract's columns, with the mined rule's confidence: one row for each page, repeated ones too."""
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "confidence")
