"""Readers of the corpus formats, each to a DataFrame. Malformed records don't stop a reader; what becomes of them is said below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MENTION = "seq long, uid string, entity_id string, document_id string, mention string, left_context string, right_context string"


def mentions(spark: SparkSession, path: str, schema: str = MENTION) -> DataFrame:
    """JSON lines. Fields that a line lacks are null; a broken line gives a row of nulls."""
    return spark.read.schema(schema).json(path)


def mention_stream(spark: SparkSession, path: str, schema: str = MENTION) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def embeddings_tsv(spark: SparkSession, path: str) -> DataFrame:
    """uid, entity_id, embedding from lines of tab-separated fields; empty lines are left out, what is no number becomes null."""
    cells = F.split(F.rtrim("value"), "\t")
    return spark.read.text(path).filter(F.trim("value") != "").select(cells[0].alias("uid"), cells[1].alias("entity_id"), F.transform(F.slice(cells, F.lit(3), F.greatest(F.size(cells) - 2, F.lit(0))), lambda x: x.try_cast("double")).alias("embedding"))


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """value: runs of lines up to a blank one, without CR. Files whose lines end with CR LF are told apart, so that one folder may have both kinds."""
    parts = lambda sep: spark.read.option("lineSep", sep).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    windows = F.broadcast(parts("\n\n").filter(F.col("value").contains("\r\n")).select("file").distinct())  # a row for each file
    both = parts("\n\n").join(windows, "file", "left_anti").unionByName(parts("\r\n\r\n").join(windows, "file", "left_semi"))
    return both.select(F.regexp_replace("value", "\r", "").alias("value"))


def pubtator(spark: SparkSession, path: str) -> DataFrame:
    """pmid, title, abstract, mention_index, start, end, mention, types, entity_id, and both contexts: a row for each mention.

    Documents are parted by blank lines, any number of them; the last needs none. A bar in a title or abstract stays. Lines of fewer than six fields are left out.
    """
    block = F.split("value", "\n")
    part = lambda kind: F.regexp_replace(F.get(F.filter("lines", lambda x: x.rlike(rf"^[^|\t]*\|{kind}\|")), F.lit(0)), rf"^[^|]*\|{kind}\|", "")
    docs = _blocks(spark, path).filter(F.trim(F.regexp_replace("value", r"\s", "")) != "").select(F.filter(block, lambda x: x != "").alias("lines"))
    whole = docs.select(F.substring_index(F.get("lines", F.lit(0)), "|", 1).alias("pmid"), part("t").alias("title"), part("a").alias("abstract"), F.filter(F.transform("lines", lambda x: F.split(x, "\t")), lambda c: F.size(c) >= 6).alias("cells"))
    each = whole.select("pmid", "title", "abstract", F.posexplode("cells").alias("mention_index", "c"))
    text = F.concat_ws(" ", "title", "abstract")
    spans = each.select("pmid", "title", "abstract", "mention_index", F.col("c")[1].try_cast("int").alias("start"), F.col("c")[2].try_cast("int").alias("end"), F.col("c")[3].alias("mention"), F.col("c")[4].alias("types"), F.col("c")[5].alias("entity_id"), text.alias("_text"))
    return spans.select("*", F.substring("_text", F.lit(1), F.col("start")).alias("left_context"), F.substring(F.col("_text"), F.col("end") + 1, F.length("_text")).alias("right_context")).drop("_text")


def json_directory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a directory's files, with category: the file's name without its ending."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return spark.read.schema(schema).json(path).select("*", F.regexp_replace(name, r"\.[^.]*$", "").alias("category"))


def kilt(spark: SparkSession, path: str) -> DataFrame:
    """uid, entity_id (the first output's answer), mention and both contexts."""
    raw = spark.read.schema("id string, output array<struct<answer: string>>, meta struct<left_context: string, mention: string, right_context: string>").json(path)
    return raw.select(F.col("id").alias("uid"), F.get("output", F.lit(0))["answer"].alias("entity_id"), "meta.mention", "meta.left_context", "meta.right_context")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """entity, count, idx from lines of entity,count; the entity may hold commas. idx counts lines in order, as one file has them."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("idx", "line"))
    return lines.select(F.regexp_extract("line", r"^(.*),\s*\d+\s*$", 1).alias("entity"), F.regexp_extract("line", r",\s*(\d+)\s*$", 1).try_cast("long").alias("count"), F.col("idx").cast("long").alias("idx"))


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """true_id, pred_id, seq from lines of two fields parted by a comma, spaces around them dropped. seq is the third field if there is one, else it numbers the lines in their order."""
    from mentionflow.operators.ordered import row_number

    read = spark.read.schema("true_id string, pred_id string, seq long").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    numbered = row_number(read.withColumn("_at", F.monotonically_increasing_id()), "_at", "_n")
    return numbered.select("true_id", "pred_id", F.coalesce("seq", F.col("_n")).cast("long").alias("seq"))


def numbered_mentions(spark: SparkSession, path: str, schema: str = MENTION) -> DataFrame:
    """mentions() with seq from 0 in the order of lines where the lines have none."""
    from mentionflow.operators.ordered import row_number

    read = row_number(mentions(spark, path, schema).withColumn("_at", F.monotonically_increasing_id()), "_at", "_n")
    return read.withColumn("seq", F.coalesce("seq", F.col("_n")).cast("long")).drop("_at", "_n")


def model(spark: SparkSession, path: str) -> DataFrame:
    """A model table that writers.model() has written, such as a vectoriser's vocabulary."""
    return spark.read.parquet(path)


def dendrogram(spark: SparkSession, path: str) -> DataFrame:
    """uid, parent, label from a tab-separated tree, in any order of lines; None is null."""
    return spark.read.schema("uid string, parent string, label string").option("sep", "\t").option("nullValue", "None").csv(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''").distinct()
