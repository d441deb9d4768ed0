"""Call logs: request and response rows, their correlation, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import redact, truncated


def correlate(turns: DataFrame) -> DataFrame:
    """Each user turn as a request with the assistant turn that follows it, if there is one."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    rows = turns.withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)}).filter("role = 'user'")
    response = F.when(F.col("next_role") == "assistant", F.col("next_text"))
    return rows.select("conv_id", "turn", F.char_length("text").cast("long").alias("request_chars"), F.char_length(response).cast("long").alias("response_chars"))


def join_calls(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their responses by call_id; a request without one stays."""
    return requests.join(responses.withColumnsRenamed({c: f"response_{c}" for c in responses.columns if c != "call_id"}), "call_id", "left")


def call_summary(turns: DataFrame) -> DataFrame:
    """Lengths of a conversation's system, user and assistant texts."""
    of = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.char_length("text"))), F.lit(0)).cast("long")
    return turns.groupBy("conv_id").agg(of("system").alias("system_chars"), of("user").alias("user_chars"), of("assistant").alias("response_chars"))


def request_row(call_type: Column, provider: Column, url: Column, body: Column) -> Column:
    """The JSON of a request-log row, secrets masked."""
    return F.to_json(F.struct(F.lit("request").alias("type"), call_type.alias("call_type"), provider.alias("provider"), F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("call_id"), url.alias("url"), redact(body).alias("request")))


def response_row(call_id: Column, call_type: Column, provider: Column, url: Column, status: Column, ms: Column, body: Column) -> Column:
    return F.to_json(F.struct(F.lit("response").alias("type"), call_type.alias("call_type"), provider.alias("provider"), call_id.alias("call_id"), url.alias("url"), status.alias("status_code"), F.round(ms, 1).alias("duration_ms"), truncated(body).alias("response")))


def error_row(context: Column, error: Column) -> Column:
    return F.to_json(F.struct(F.lit("error").alias("type"), context.alias("context"), error.alias("error")), {"ignoreNullFields": "false"})


def append_log(rows: DataFrame, path: str) -> None:
    """Rows with a column `line`, as lines after those that are there."""
    rows.select(F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "line")).write.mode("append").text(path)
