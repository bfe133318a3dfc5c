"""Operators that make mentions of documents and annotations: filters, routing, joins and indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .corpus import escaped, span_split_tokens
from .ordered import row_number, running_sum

# The entity of mentions without one, and the documents that begin the sections of a token-per-line corpus.
NIL = "--NME--"
SECTIONS = (("1 EU", "train"), ("947testa CRICKET", "dev"), ("1163testb SOCCER", "test"))


def not_nil(df: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Rows with an entity other than NIL; null counts as an entity that is unknown, and stays."""
    return df.filter(~F.col(entity).eqNullSafe(F.lit(NIL)))


def is_valid(tag: Column, anchors: Column) -> Column:
    """No action or negated event, and anchored somewhere."""
    return F.coalesce(~tag.contains("ACT") & ~tag.contains("NEG") & (F.size(anchors) > 0), F.lit(False))


def last_of(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row for each key, the last by seq."""
    return df.groupBy(key).agg(F.max(F.struct(seq, F.struct(*[c for c in df.columns if c not in (key, seq)]).alias("rest"))).alias("l")).select(key, f"l.{seq}", "l.rest.*")


def context(left: str = "left_context", right: str = "right_context") -> Column:
    return F.concat_ws(" ", left, right)


def composite(*parts: str, by: str = "::") -> Column:
    return F.concat_ws(by, *(F.col(p).cast("string") for p in parts))


def pretty(left: str = "left_context", mention: str = "mention", right: str = "right_context", words: int = 10) -> Column:
    """For LaTeX: the mention between the last and the first words, parted by single spaces, of its contexts, escaped. Null contexts count as empty."""
    some = lambda c: F.split(escaped(F.coalesce(F.col(c), F.lit(""))), " ", -1)
    tail = some(left)
    before = F.slice(tail, F.greatest(F.size(tail) - words + 1, F.lit(1)), F.lit(words))
    inner = F.concat(F.lit("\\emph{"), escaped(F.coalesce(F.col(mention), F.lit(""))), F.lit("}"))
    return F.concat_ws(" ", F.lit("\\ldots"), F.array_join(before, " "), inner, F.array_join(F.slice(some(right), F.lit(1), F.lit(words)), " "), F.lit("\\ldots"))


def routed(df: DataFrame, lists: dict[str, DataFrame], key: str = "pmid", column: str = "id") -> DataFrame:
    """df with split: the first of the lists, in their order, that has the key. A key that no list has, null too, makes the query fail."""
    marks = [part.select(F.col(column).alias(key), F.lit(i).alias("_i")) for i, part in enumerate(lists.values())]
    found = marks[0]
    for part in marks[1:]:
        found = found.unionByName(part)
    first = found.groupBy(key).agg(F.min("_i").alias("_i"))
    names = F.array(*(F.lit(n) for n in lists))
    split = F.when(F.col("_i").isNull(), F.raise_error(F.concat(F.lit("in no split: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.get(names, F.col("_i")))
    return df.join(first, key, "left").withColumn("split", split.cast("string")).drop("_i")


def sections(mentions: DataFrame, lines: DataFrame, starts: tuple[tuple[str, str], ...] = SECTIONS) -> DataFrame:
    """mentions (doc_seq, pos, document_id, entity_id, ...) with split and mention_index, its number in its section. A section reaches from its first document to the next one's.

    Documents before all sections are left out. Marks of sections are few; mentions are counted by document, so no section is in one task.
    """
    names = dict(starts)
    docs = lines.select("doc_seq", "document_id").distinct()
    marks = sorted((r["doc_seq"], names[r["document_id"]]) for r in docs.filter(F.col("document_id").isin(*names)).collect())
    split, begin = F.lit(None).cast("string"), F.lit(None).cast("long")
    for at, name in marks:  # as many as sections
        split, begin = F.when(F.col("doc_seq") >= at, F.lit(name)).otherwise(split), F.when(F.col("doc_seq") >= at, F.lit(at)).otherwise(begin)
    own = not_nil(mentions).withColumn("split", split).withColumn("_begin", begin).filter("split is not null")
    each = own.groupBy("_begin", "doc_seq").agg(F.count("*").alias("_n"))
    upto = running_sum(each, "doc_seq", F.col("_n"), "_upto", by=("_begin",)).select("doc_seq", (F.col("_upto") - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("doc_seq").orderBy("pos")) - 1
    return own.join(upto, "doc_seq").withColumn("mention_index", F.col("_before") + place).drop("_before", "_begin")


def event_mentions(files: DataFrame, gold: DataFrame) -> DataFrame:
    """split, topic, file, entity_id (the relation's id), left_context, mention, right_context of XML files: each valid markable of each relation whose first and last token are in gold sentences.

    files and gold as sources.corpora reads them. The mention is all tokens from the first to the last anchor; token ids count from 1. Of markables, tokens and relations with one id
    the last counts. Files without gold sentences give nothing.
    """
    own = files.join(gold, ["topic", "file"])
    relation = F.filter("relations", lambda r, i: ~F.exists(F.slice("relations", i + 2, F.size("relations")), lambda o: o["r_id"] == r["r_id"]))
    member = own.withColumn("r", F.explode(relation)).withColumn("m_id", F.explode("r.m_ids"))
    last = lambda rows, name, value: F.element_at(F.filter(rows, lambda x: x[name] == value), -1)
    marked = member.withColumn("m", F.when(F.exists("markables", lambda x: x["m_id"] == F.col("m_id")), last("markables", "m_id", F.col("m_id")))).filter(is_valid(F.col("m.tag"), F.col("m.t_ids")))
    token = lambda at: last("tokens", "t_id", at)
    found = marked.withColumn("a", token(F.col("m.t_ids")[0])).withColumn("b", token(F.element_at("m.t_ids", -1)))
    inside = found.filter(F.array_contains("sentences", F.col("a.sentence")) & F.array_contains("sentences", F.col("b.sentence")))
    text = F.transform("tokens", lambda t: t["text"])
    first, end = F.col("a.t_id").cast("int") - 1, F.col("b.t_id").cast("int")
    part = lambda start, n: F.array_join(F.slice(text, start, F.greatest(n, F.lit(0))), " ")
    return inside.select("split", "topic", "file", F.col("r.r_id").alias("entity_id"), part(F.lit(1), first).alias("left_context"), part(first + 1, end - first).alias("mention"), part(end + 1, F.size("tokens")).alias("right_context"))


def linked_mentions(links: DataFrame, documents: DataFrame) -> DataFrame:
    """seq, left_context, mention, right_context, entity_id (the label document's title), category, document_id, label_document_id: links with both documents; links to unknown ones give nothing."""
    label = documents.select(F.col("document_id").alias("label_document_id"), F.col("title").alias("entity_id"))
    own = documents.select(F.col("document_id").alias("context_document_id"), "text", "category")
    whole = links.join(label, "label_document_id").join(own, "context_document_id")
    return whole.select("seq", *span_split_tokens(F.col("text"), F.col("start_index"), F.col("end_index")), "entity_id", "category", F.col("context_document_id").alias("document_id"), "label_document_id")


def entity_pages(links: DataFrame, documents: DataFrame) -> DataFrame:
    """A mention for each document that a link labels: its title, before its text without the title's first occurrence. seq is the first such link's."""
    used = links.groupBy(F.col("label_document_id").alias("document_id")).agg(F.min("seq").alias("seq"))
    at = F.expr("instr(text, title)")
    rest = F.when((at > 0) & (F.length("title") > 0), F.concat(F.expr("substring(text, 1, instr(text, title) - 1)"), F.expr("substring(text, instr(text, title) + length(title))"))).otherwise(F.col("text"))
    page = used.join(documents, "document_id")
    return page.select("seq", F.lit("").alias("left_context"), F.col("title").alias("mention"), F.trim(rest).alias("right_context"), F.col("title").alias("entity_id"), "category", "document_id")


def with_pages(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Linked mentions, then entity pages, in the order of categories; mention_index numbers them from 0."""
    both = linked_mentions(links, documents).drop("label_document_id").withColumn("_page", F.lit(0)).unionByName(entity_pages(links, documents).withColumn("_page", F.lit(1)))
    sizes = both.groupBy("category").agg(F.count("*").alias("_n"))
    before = sizes.select("category", (F.sum("_n").over(Window.orderBy("category")) - F.col("_n")).alias("_before"))  # a row for each category
    ahead = both.groupBy("category").agg(F.sum((F.col("_page") == 0).cast("long")).alias("_mentions"))
    ranked = row_number(both, "seq", "_place", ("document_id",), by=("category", "_page"))
    whole = ranked.join(F.broadcast(before.join(ahead, "category")), "category")
    return whole.withColumn("mention_index", F.col("_before") + F.col("_place") + F.when(F.col("_page") == 1, F.col("_mentions")).otherwise(0)).drop("_page", "_place", "_before", "_mentions")


def category_counts(links: DataFrame) -> DataFrame:
    """document_id, count of links that label it, and one for its page."""
    return links.groupBy(F.col("label_document_id").alias("document_id")).agg((F.count("*") + 1).alias("count"))


def samples(df: DataFrame, group: str, value, limit: int = 5, seq: str = "seq", distinct: str | None = None) -> DataFrame:
    """The first limit rows, by seq, of the group with this value; with distinct one of each of that column's values."""
    own = df.filter(F.col(group).eqNullSafe(F.lit(value)))
    if distinct:
        own = own.groupBy(distinct).agg(F.min(F.struct(seq, *[c for c in df.columns if c not in (seq, distinct)])).alias("f")).select(distinct, "f.*")
    return own.orderBy(seq).limit(limit)
