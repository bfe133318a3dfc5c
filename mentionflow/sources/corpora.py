"""Readers of annotated corpora, each to tables of documents, mentions or tokens; joins that make mentions of them are in operators.mentions."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START = "-DOCSTART-"
DOCUMENT = "document_id string, title string, text string"
LINK = "mention_id string, context_document_id string, label_document_id string, start_index int, end_index int"
XML = """topic string, file string, tokens array<struct<t_id: string, sentence: string, number: string, text: string>>,
markables array<struct<tag: string, m_id: string, t_ids: array<string>>>, relations array<struct<r_id: string, m_ids: array<string>>>"""


def docid(header):
    """What stands between the first opening and the last closing bracket; null without them."""
    found = F.regexp_extract(header, r"(?s)\((.*)\)", 1)
    return F.when(header.rlike(r"(?s)\(.*\)"), found)


def token_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_seq, document_id, text, token, tag, entity_id, pos, start, end: a row for each line of a token-per-line corpus, in which a line with -DOCSTART- begins a document.

    doc_seq rises in the order of documents. A token is followed by one space in text, but for the last two lines; a blank line is an empty token. Offsets count
    characters of text. Lines of one field have no tag. Lines before the first document are left out.
    """
    blocks = spark.read.option("lineSep", START).text(path).select(F.regexp_replace("value", "\r", "").alias("value"), F.monotonically_increasing_id().alias("doc_seq"))
    header = F.substring_index("value", "\n", 1)
    lines = F.split(F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), "\n\\z", ""), "\n")
    docs = blocks.filter(F.trim("value") != "").select("doc_seq", docid(header).alias("document_id"), F.transform(lines, lambda x: F.split(F.trim(x), "\t")).alias("cells")).filter("document_id is not null")
    n = F.size("cells")
    pieces = F.transform("cells", lambda c, i: F.concat(c[0], F.when(n - 1 - i > 1, " ").otherwise("")))
    each = docs.select("doc_seq", "document_id", F.array_join(pieces, "").alias("text"), F.posexplode(F.arrays_zip(F.col("cells").alias("c"), pieces.alias("p"))).alias("pos", "x"))
    before = Window.partitionBy("doc_seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("x.p")).over(before), F.lit(0)).cast("int")
    cell = lambda k: F.get(F.col("x.c"), F.lit(k))
    return each.select("doc_seq", "document_id", "text", "pos", cell(0).alias("token"), cell(1).alias("tag"), cell(3).alias("entity_id"), start.alias("start"), (start + F.length(cell(0))).alias("end"))


def token_mentions(lines: DataFrame) -> DataFrame:
    """doc_seq, document_id, pos, entity_id, start, end, left_context, mention, right_context of token_lines(): B begins a mention, I prolongs the latest one."""
    marked = lines.filter("tag in ('B', 'I')").withColumn("part", F.sum((F.col("tag") == "B").cast("int")).over(Window.partitionBy("doc_seq").orderBy("pos")))
    first = F.min(F.struct("pos", "entity_id", "start"))
    spans = marked.filter("part > 0").groupBy("doc_seq", "document_id", "text", "part").agg(first.alias("f"), F.max("end").alias("end"))
    whole = spans.select("doc_seq", "document_id", "f.pos", "f.entity_id", "f.start", "end", "text")
    return whole.select("*", F.expr("substring(text, 1, start)").alias("left_context"), F.expr("substring(text, start + 1, end - start)").alias("mention"), F.expr("substring(text, end + 1)").alias("right_context")).drop("text")


def event_xml(spark: SparkSession, path: str) -> DataFrame:
    """topic, file, tokens, markables, relations of each annotated XML file; topic and file come from a path like 1/1_10.xml. Files that are no XML have null arrays."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                topic, _, file = stem.partition("_")
                try:
                    root = ElementTree.fromstring(bytes(content))
                except ElementTree.ParseError:
                    rows.append((topic, file, None, None, None))
                    continue
                tokens = [{"t_id": t.get("t_id"), "sentence": t.get("sentence"), "number": t.get("number"), "text": t.text or ""} for t in root.iter("token")]
                marks = [{"tag": m.tag, "m_id": m.get("m_id"), "t_ids": [a.get("t_id") for a in m.findall("token_anchor")]} for p in root.iter("Markables") for m in p]
                links = [{"r_id": r.get("r_id"), "m_ids": [a.get("m_id") for a in r]} for p in root.iter("Relations") for r in p]
                rows.append((topic, file, tokens, marks, links))
            yield pd.DataFrame(rows, columns=["topic", "file", "tokens", "markables", "relations"])

    return files.mapInPandas(parse, XML)


def gold_sentences(spark: SparkSession, path: str) -> DataFrame:
    """topic, file, split, sentences: the sentences of each file that are validated, from a CSV file with the columns Topic, File and Sentence Number."""
    from mentionflow.operators.corpus import topic_split

    rows = spark.read.schema("`Topic` string, `File` string, `Sentence Number` string").option("header", True).option("enforceSchema", False).csv(path)
    found = rows.groupBy(F.col("Topic").alias("topic"), F.col("File").alias("file")).agg(F.collect_set("Sentence Number").alias("sentences"))
    return found.withColumn("split", topic_split(F.col("topic").try_cast("int"))).select("topic", "file", "split", "sentences")


def page_documents(spark: SparkSession, path: str) -> DataFrame:
    """document_id, title, text, category of a directory of JSON lines; category is the file's name without its ending."""
    from .readers import json_directory

    return json_directory(spark, path, DOCUMENT)


def page_links(spark: SparkSession, path: str) -> DataFrame:
    """The mentions of such documents: context and label document, first and last token; file is the file's name without its ending, seq rises in its order."""
    from .readers import json_directory

    return json_directory(spark, path, LINK).withColumnRenamed("category", "file").withColumn("seq", F.monotonically_increasing_id())


def metadata(mentions: DataFrame) -> DataFrame:
    """uid (pmid_index), semantic_type, entity_id of the mentions that readers.pubtator() gives."""
    return mentions.select(F.concat_ws("_", "pmid", "mention_index").alias("uid"), F.split("types", ",").alias("semantic_type"), "entity_id")


def dated(documents: DataFrame, dates: DataFrame, key: str = "pmid") -> DataFrame:
    """The documents whose date is known, with date as a timestamp and as dd/MM/yyyy (date_text); dates: key and a date like 2001/02/03 04:05."""
    at = F.try_to_timestamp(F.col("date"), F.lit("yyyy/MM/dd HH:mm"))
    known = dates.select(F.col(key), at.alias("date")).filter("date is not null").groupBy(key).agg(F.min("date").alias("date"))
    return documents.drop("date").join(known, key).withColumn("date_text", F.date_format("date", "dd/MM/yyyy"))
