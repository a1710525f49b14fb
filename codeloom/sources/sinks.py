"""Results as JSON: lines in files, and answers to questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a line; NULLs are written."""
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def is_success(status: Column, result: Column) -> Column:
    return (status == "completed") & result.isNotNull()


def responses(answers: DataFrame) -> DataFrame:
    """(request_id, success, response) of answers(request_id, status, query_type, answer, confidence, sources, follow_ups, error, processing_time_ms, tokens_used, created_at).

    response is the JSON object; its result is null where the answer is. sources are structs with file_path, start_line, end_line, entity_name,
    entity_type and relevance.
    """
    result = F.when(F.col("answer").isNotNull(), F.struct("answer", "sources", "confidence", F.col("follow_ups").alias("follow_up_questions")))
    time = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    whole = F.struct("request_id", "status", "query_type", result.alias("result"), "error", "processing_time_ms", "tokens_used", time.alias("created_at"))
    return answers.select("request_id", is_success(F.col("status"), F.col("answer")).alias("success"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("response"))
