"""The opN_ queries over a data folder's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, jaccard, language, licences, maxent, packing, spotsigs, topk, toxicity, url_rules
from .common import table

#: The tokenizer files, by the name that public_tokenizers.path() takes.
RANK_FILE, WORD_FILE = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.op3(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.op9(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": lambda s, d: language.op1(table(s, d, "documents")),
    "op2_url_rules": lambda s, d: url_rules.op2(table(s, d, "pages")),
    "op3_byte_bpe": op3,
    "op4_licences": lambda s, d: licences.op4(table(s, d, "documents")),
    "op5_topk": lambda s, d: topk.op5(table(s, d, "embeddings")),
    "op6_toxicity": lambda s, d: toxicity.op6(table(s, d, "documents"), table(s, d, "labels")),
    "op7_maxent": lambda s, d: maxent.op7(table(s, d, "documents")),
    "op8_jaccard": lambda s, d: jaccard.op8(table(s, d, "documents")),
    "op9_packing": op9,
    "op10_spotsigs": lambda s, d: spotsigs.op10(table(s, d, "documents")),
}
ORACLE_SQL = {"op4_licences": licences.op4_sql(), "op5_topk": topk.OP5_SQL, "op10_spotsigs": spotsigs.OP10_SQL}
