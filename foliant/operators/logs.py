"""Model-call logs and question history."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T


def _round_half_up(c):
    return F.floor(c + 0.5)


def query(calls: DataFrame, start_ms: int | None = None, end_ms: int | None = None, status: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    rows = calls
    if start_ms is not None:
        rows = rows.where(F.col("request_ms") >= start_ms)
    if end_ms is not None:
        rows = rows.where(F.col("request_ms") <= end_ms)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    return rows.orderBy(F.desc("request_ms"), "request_id").offset(offset).limit(limit)


def records(params: DataFrame) -> DataFrame:
    """Nested call-log records of flat parameters (request_id, request_ms, response_ms, duration, model, max_tokens,
    prompt_length, status, status_code, content, prompt_tokens, completion_tokens, total_tokens, error_message, error_code,
    retry_count): a missing or zero duration is the time between request and response, content becomes its length,
    counts default to 0, and usage and error are null where nothing of them was given."""
    c = F.col
    zero = lambda n: F.coalesce(c(n), F.lit(0))
    used = F.coalesce(*[c(n).cast("long") for n in ("prompt_tokens", "completion_tokens", "total_tokens")]).isNotNull()
    return params.select(
        F.coalesce("request_id", F.uuid()).alias("requestId"),
        F.struct(c("request_ms").alias("request"), c("response_ms").alias("response"), F.coalesce(F.nullif(c("duration"), F.lit(0)), F.nullif(c("response_ms"), F.lit(0)) - F.nullif(c("request_ms"), F.lit(0))).alias("duration")).alias("timestamp"),
        F.struct(c("model").alias("model"), c("max_tokens").alias("maxTokens"), c("prompt_length").alias("promptLength")).alias("request"),
        F.struct(c("status").alias("status"), c("status_code").alias("statusCode"), F.coalesce(F.length("content"), F.lit(0)).alias("contentLength")).alias("response"),
        F.when(used, F.struct(zero("prompt_tokens").alias("promptTokens"), zero("completion_tokens").alias("completionTokens"), zero("total_tokens").alias("totalTokens"))).alias("tokenUsage"),
        F.when(c("error_message").isNotNull() | c("error_code").isNotNull(), F.struct(c("error_message").alias("message"), c("error_code").alias("code"))).alias("error"),
        zero("retry_count").alias("retryCount"),
    )


def stats(calls: DataFrame, newest: int | None = None) -> DataFrame:
    """One row; without calls all zeros and no success rate. ``newest``: of the newest so many calls only."""
    if newest is not None:
        calls = calls.orderBy(F.desc("request_ms"), "request_id").limit(newest)
    n, good = F.count("*"), F.count_if(F.col("status") == "success")
    return calls.agg(
        n.alias("total_calls"), good.alias("success_count"), F.count_if(F.col("status") == "error").alias("error_count"),
        F.when(n > 0, _round_half_up(100 * good / F.nullif(n, F.lit(0)))).alias("success_rate"), F.coalesce(_round_half_up(F.avg("duration")), F.lit(0)).alias("avg_duration"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(_round_half_up(F.sum("total_tokens") / F.nullif(F.count("total_tokens"), F.lit(0))), F.lit(0)).alias("avg_tokens"),
    )


def retained(calls: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Rows of day files not older than ``days`` before ``as_of``."""
    return calls.where(F.to_date(F.timestamp_millis("request_ms")) >= F.date_sub(F.lit(as_of).cast("date"), days))


def drop_old_days(spark: SparkSession, path: str, as_of: str, days: int = 30) -> list[str]:
    """Remove the day folders (``date=...``) of a log that are older than ``days`` before ``as_of``; returns their names. Kept days
    are neither read nor written, and folders whose name is no date stay."""
    first = date.fromisoformat(as_of) - timedelta(days=days)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store, gone = at.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for status in store.listStatus(at):  # a folder a day
        name = status.getPath().getName()
        day = re.fullmatch(r"date=(\d{4}-\d\d-\d\d)", name)
        if day and date.fromisoformat(day[1]) < first:
            store.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def batch_outcome(outcomes: DataFrame, skip_blank: bool = False) -> DataFrame:
    """One row over (content, answer, error): total, processed, success and failed. Documents without content fail without
    being processed, or with ``skip_blank``, as when summaries are made, count in the total alone."""
    blank = T.is_blank(F.col("content"))
    good = ~blank & F.col("error").isNull() & F.col("answer").isNotNull()
    return outcomes.agg(F.count("*").alias("total"), F.count_if(~blank).alias("processed"), F.count_if(good).alias("success"), F.count_if(~good & ~blank if skip_blank else ~good).alias("failed"))


def newest_answers(history: DataFrame, most: int = 50) -> DataFrame:
    """(user_id, place, question, preview): the newest entries per user, incomplete ones ignored."""
    whole = history.where("question is not null and question <> '' and answer is not null and answer <> ''")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at"), "question"))
    preview = F.when(F.length("answer") > 100, F.concat(F.substring("answer", 1, 100), F.lit("..."))).otherwise(F.col("answer"))
    return whole.select("user_id", place.alias("place"), "question", preview.alias("preview")).where(F.col("place") <= most)
