"""Document fingerprints from spot signatures, in DataFrame and SQL functions only.

A spot is a common word (an anchor); its signature is the anchor with the chain of CHAIN content words that follow it,
common words skipped. A document's fingerprint is the sorted set of its signatures, each as sixteen hex digits of a digest.
Two fingerprints are compared by the Jaccard similarity of their sets. Near-duplicates are sought within neighbouring
partitions of set length only, since sets whose sizes differ by more than the threshold's factor can't reach it.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CHAIN, DIGITS = 2, 16
#: Rows of a key range, more where there would be more than RANGES of them.
ROWS, RANGES = 1_000, 1 << 20
# Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was we were which with you "
    "au aux avec ce dans de des du elle en est et il la le les leur lui mais ne nous ou par pas pour qui que sa se son sur un une vous "
    "als auf aus bei das dem den der die ein eine einer es für hat ich im ist mit nicht noch sich sie sind und von war wie wird zu zum zur "
    "al como con del el ella ellos era esta este fue han las lo los más mi muy no nos o para pero por se sin su sus también una y ya"
).split()


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def digest(x: Column) -> Column:
    return F.substring(F.md5(x), 1, DIGITS)


def signatures(text: Column, anchors=ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted distinct signature digests, an array.

    A spot near the end has the chain that is left, if a word is. A text without a spot has one signature, of all its words;
    a null text or one without a word has none.
    """
    common = sorted(set(anchors))
    w = words(text)
    # One pass marks the anchors; each then knows how many content words stand before it: its place less the anchors before it.
    pairs = F.transform(F.array(w), lambda w: F.struct(w.alias("w"), F.filter(w, lambda x: ~x.isin(common)).alias("content"), F.when(F.size(w) > 0, F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(common))).otherwise(F.array().cast("array<int>")).alias("spots")))

    def chains(s: Column) -> Column:
        content = lambda k: F.get(s["content"], k)  # noqa: E731  (slice() would copy the whole array each time)
        made = F.transform(s["spots"], lambda i, j: F.when(i - j < F.size(s["content"]), digest(F.concat_ws(" ", F.get(s["w"], i), *[content(i - j + d) for d in range(chain)]))))
        return F.struct(s["w"].alias("w"), F.sort_array(F.array_distinct(F.filter(made, lambda x: x.isNotNull()))).alias("some"))

    def whole(s: Column) -> Column:
        return F.when(F.size(s["some"]) > 0, s["some"]).when(F.size(s["w"]) > 0, F.array(digest(F.array_join(s["w"], " ")))).otherwise(F.array().cast("array<string>"))

    # Each step binds what it uses more than once as the variable of a one-element transform, so that it's computed once.
    return F.coalesce(F.transform(F.transform(pairs, chains), whole)[0], F.array().cast("array<string>"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with the array of signatures; a column of that name is replaced. Rows stay as they are, repeated ones too."""
    return df.withColumn(out, signatures(F.col(text)))


def _above(key: Column, bounds: Column, n: int, strictly: bool) -> Column:
    """How many of n ascending bounds are above the key (or not below it), by binary search."""
    state = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        at = F.get(bounds, middle)
        left = at <= key if strictly else at < key
        return F.when(s["lo"] >= s["hi"], s).otherwise(state(F.when(left, middle + 1).otherwise(s["lo"]), F.when(left, s["hi"]).otherwise(middle)))

    return F.lit(n) - F.aggregate(F.sequence(F.lit(0), F.lit(ceil(log2(n + 1)))), state(F.lit(0), F.lit(n)), halve)["lo"]


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text", rows: int = ROWS, derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with `next`, the struct of the other columns of the next row by descending key; after the last, the first.

    Rows are dealt into ranges of a numeric key of about rows rows each, bounds being approximate quantiles; a key that several quantiles fall on is split among
    their ranges by its rows' order. The first row of a range also goes to the range before it, so each range finds its successors alone. Rows
    with one key are ordered by the MD5 of text, null keys come last; rows alike in both meet in one range. One row alone is its own next. derive adds
    columns once the rows are dealt, so that they aren't shuffled. Bounds and first rows' keys are broadcast: RANGES rows at most.
    """
    spark = df.sparkSession
    n = df.count()
    cuts = min(n // rows, RANGES - 1)
    tie = F.conv(F.substring(F.md5(F.coalesce(F.col(text), F.lit(""))), 1, 15), 16, 10).cast("long")
    own = df.withColumn("tie", tie)
    if cuts:
        share = F.transform(F.sequence(F.lit(1), F.lit(cuts)), lambda i: i / F.lit(cuts + 1.0))
        wanted = spark.range(1).select(share.alias("p")).first()["p"]
        quantiles = F.sort_array(F.percentile_approx(key, wanted, min(100 * (cuts + 1), 1 << 30)))
        bounds = materialize(df.agg(F.coalesce(quantiles, F.array().cast(f"array<{df.schema[key].dataType.simpleString()}>")).alias("bounds")))
        size = len(bounds.first()["bounds"])
        above, upto = (_above(F.col(key), F.col("bounds"), size, strictly) for strictly in (True, False))
        part = F.floor(F.col("tie") / F.lit(float(1 << 60)) * (upto - above + 1))
        place = F.when(F.col(key).isNull(), F.lit(size)).otherwise(F.least(upto, above + part)).cast("int")
        own = own.join(F.broadcast(bounds)).withColumn("range", place).drop("bounds")  # one row
    else:
        own = own.withColumn("range", F.lit(0))
    order = F.struct(F.col(key).alias("key"), (-F.col("tie")).alias("tie"))
    first = materialize(own.groupBy("range").agg(F.max(order).alias("first")))
    around = Window.orderBy("range")  # a row for each range
    last = first.agg(F.max("range").alias("last"))
    heads = first.withColumn("before", F.lag("range").over(around)).join(F.broadcast(last)).select(F.col("range"), "first", F.coalesce("before", "last").alias("before"))
    copies = F.array_compact(F.array(F.struct(F.col("range").alias("to"), F.lit(False).alias("guest")), F.when(order.eqNullSafe(F.col("first")), F.struct(F.col("before").alias("to"), F.lit(True).alias("guest")))))
    dealt = own.join(F.broadcast(heads), "range").withColumn("_c", F.explode(copies)).select(*df.columns, "tie", "_c.to", "_c.guest").repartition("to")
    dealt = derive(dealt) if derive else dealt
    w = Window.partitionBy("to").orderBy("guest", F.desc_nulls_last(key), "tie")
    return dealt.withColumn("next", F.lead(F.struct(*[c for c in dealt.columns if c not in (key, "tie", "to", "guest")])).over(w)).filter(~F.col("guest")).drop("tie", "to", "guest")


def near_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """a, b, likeness of each pair of different fingerprints with a likeness of threshold or more; a and b stand for their least keys.

    Rows of one fingerprint are one class, so copies make no pairs; rows without a word take no part, null keys name nothing. Classes are partitioned by set
    length: partition p has the lengths from threshold^-p on, so a pair lies in one partition or two neighbouring ones. Within those, pairs meet that
    share one of a set's first signatures, the rarest first, enough of them that no pair of the threshold can be missed; then the number of common
    signatures decides. Every pair is a row: a group of m near copies with fingerprints of their own gives up to m^2 / 2.
    """
    base = 1 / threshold
    found = df.select(F.col(key).alias("key"), signatures(F.col(text)).alias("s")).filter(F.size("s") > 0)
    classes = materialize(found.groupBy("s").agg(F.min("key").alias("key")).withColumn("id", F.md5(F.array_join("s", ""))).withColumn("n", F.size("s")))
    each = classes.select("id", "n", F.explode("s").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("often"))
    # Each set's tokens, the rarest first; no more are kept than may not be missed.
    lead = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int") + 1
    ranked = each.join(often, "token").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("often", "token"))).filter(F.col("place") <= lead)
    part = F.floor(F.log(F.col("n")) / F.log(F.lit(base)) + 1e-9).cast("int")
    probe = ranked.filter("often > 1").select("id", "n", "token", part.alias("own"))
    left = probe.select(F.col("id").alias("x"), F.col("n").alias("nx"), "token", F.col("own").alias("px"), F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("part"))
    right = probe.select(F.col("id").alias("y"), F.col("n").alias("ny"), "token", F.col("own").alias("part"))
    small, large = F.least("nx", "ny"), F.greatest("nx", "ny")
    pairs = left.join(right, ["part", "token"]).filter(((F.col("px") < F.col("part")) | (F.col("x") < F.col("y"))) & (small >= F.lit(threshold) * large - 1e-9)).select("x", "y").distinct()
    side = lambda c, s, k: classes.select(F.col("id").alias(c), F.col("s").alias(s), F.col("key").alias(k))
    compared = pairs.join(side("x", "sx", "kx"), "x").join(side("y", "sy", "ky"), "y").withColumn("likeness", likeness(F.col("sx"), F.col("sy")))
    return compared.filter(F.col("likeness") >= threshold - 1e-12).select(F.least("kx", "ky").alias("a"), F.greatest("kx", "ky").alias("b"), "likeness")


def op10(documents: DataFrame) -> DataFrame:
    """The contract's columns: each text's fingerprint beside those of its edited text and of the next document. Null texts count as empty; every row gives one."""
    filled = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(filled, derive=lambda df: fingerprint(df, "text", "f")).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = both.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), F.substring("next.text", F.lit(1), half)))
    marked = fingerprint(edited, "edited", "e")
    return marked.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("f", "").alias("fingerprint"), F.array_join("e", "").alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("next.f")).alias("near_next"),
    )


def _sql() -> str:
    common = ", ".join(f"'{w}'" for w in sorted(set(ANCHORS)))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
n AS (SELECT doc_id, t, lead(t) OVER w nx, first_value(t) OVER w f0 FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, md5(t) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, t, coalesce(nx, f0) x, length(t) n_chars, substr(t, 1, length(t) - length(t) // 2) || substr(coalesce(nx, f0), 1, length(t) // 2) e FROM n),
r AS (SELECT row_number() OVER () r, * FROM e),
u AS (SELECT r, 1 k, t v FROM r UNION ALL SELECT r, 2, e FROM r UNION ALL SELECT r, 3, x FROM r),
w AS (SELECT r, k, list_filter(regexp_split_to_array(lower(v), '[^\\p{{L}}\\p{{N}}]+'), lambda y: y <> '') w FROM u),
c AS (SELECT r, k, w, list_filter(w, lambda y: y NOT IN ({common})) c, list_filter(range(1, len(w) + 1), lambda i: w[i] IN ({common})) a FROM w),
g AS (SELECT r, k, w, list_sort(list_distinct(list_transform(list_filter(range(1, len(a) + 1), lambda j: a[j] - j < len(c)), lambda j: substr(md5(w[a[j]] || ' ' || array_to_string(c[a[j] - j + 1:a[j] - j + {CHAIN}], ' ')), 1, {DIGITS})))) g FROM c),
s AS (SELECT r, k, CASE WHEN len(g) > 0 THEN g WHEN len(w) > 0 THEN [substr(md5(array_to_string(w, ' ')), 1, {DIGITS})] ELSE [] END s FROM g),
p AS (SELECT r.doc_id, r.n_chars, sha256(r.e) edited_sha256, f.s f, e.s e, x.s x FROM r JOIN s f ON f.r = r.r AND f.k = 1 JOIN s e ON e.r = r.r AND e.k = 2 JOIN s x ON x.r = r.r AND x.k = 3)
SELECT doc_id, n_chars, edited_sha256, array_to_string(f, '') fingerprint, array_to_string(e, '') edited_fingerprint,
       CASE WHEN len(f) + len(e) = 0 THEN 1.0 ELSE CAST(len(list_intersect(f, e)) AS DOUBLE) / (len(f) + len(e) - len(list_intersect(f, e))) END near_edited,
       CASE WHEN len(f) + len(x) = 0 THEN 1.0 ELSE CAST(len(list_intersect(f, x)) AS DOUBLE) / (len(f) + len(x) - len(list_intersect(f, x))) END near_next
FROM p"""


OP10_SQL = _sql()
