"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landcompare.llm import (
    conversations,
    decontamination,
    licenses,
    linetemplates,
    neighbours,
    quality,
    sentencepieces,
    setjoin,
    simhash,
    spelling,
    tokencounts,
    toxicity,
    urlfilter,
)

QUERIES = {
    "op1_quality": quality.query,
    "op2_decontamination": decontamination.query,
    "op3_neighbours": neighbours.query,
    "op4_url_filter": urlfilter.query,
    "op5_sentencepiece": sentencepieces.query,
    "op6_simhash": simhash.query,
    "op7_line_templates": linetemplates.query,
    "op8_toxicity": toxicity.query,
    "op9_token_counts": tokencounts.query,
    "op10_licenses": licenses.query,
    "op11_conversation_repair": conversations.query,
    "op12_spelling": spelling.query,
    "op13_set_join": setjoin.query,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": urlfilter.SQL, "op10_licenses": licenses.SQL, "op11_conversation_repair": conversations.SQL, "op12_spelling": spelling.SQL, "op13_set_join": setjoin.SQL}
