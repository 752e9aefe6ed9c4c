"""URL filters: host and path rules, and for other URLs a character language-model ratio.

Two smoothed variable-order Markov models over bytes, one of accepted and one of rejected URLs, back off from contexts of
four bytes down to none (Witten-Bell). Their counts are a Spark table of all the five-byte grams of all URLs, which grows with
them; shorter grams are its sums, and every order is joined with the one below it. A URL's score is the mean over its
bytes after ``://`` (all bytes of one without it) of log p(rejected) - log p(accepted). The threshold is a quantile of
held-out accepted URLs' scores.

URLs are scored once however often they are repeated, in blocks of about ``BLOCK_URLS``: a block sends each of its distinct
grams once and gets their log-ratios back, so a gram that all URLs hold costs a row a block.

Null URLs have an empty host and path, match no rule and are allowed; URLs without ``://`` have an empty host and path
too and are judged by the method. A URL without text scores 0, which counts as not above the threshold, and so does
every URL where one class has none to learn from. Repeated rows are judged alike. Extra columns stay; an input column
that is named like an added one gets ``_input`` behind its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.io import rename_clashing, settle

ORDER = 5
BLOCK_URLS = 5000
ADDED = ["url_host", "url_path", "url_rule", "url_score", "url_verdict"]
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the query's contract: (rule, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _AZ, _az), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, ties by rule text; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams(urls: list) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ``ORDER``-byte grams that end at each byte of the URLs, end to end, and the URLs' lengths. Before a
    URL stand zero bytes. A code is a 1 and then the gram's bytes, so grams of every length have codes of their own."""
    raw = []
    for u in urls:
        head, mark, tail = (u or "").partition("://")
        raw.append((tail if mark else head).encode("utf-8", "replace"))
    size = np.array([len(x) for x in raw], np.int64)
    held = np.frombuffer(b"".join(bytes(ORDER - 1) + x for x in raw), np.uint8).astype(np.int64)
    code = np.full(len(held), 1 << (8 * ORDER), np.int64)
    for k in range(min(ORDER, len(held))):
        code[k:] += held[: len(held) - k] << (8 * k)
    keep = np.ones(len(held), bool)
    first = np.cumsum(size + ORDER - 1) - size - (ORDER - 1)
    for k in range(ORDER - 1):
        keep[first + k] = False
    return code[keep], size


def in_blocks(urls: DataFrame) -> DataFrame:
    """``urls`` (url, rejected, n) with a ``block`` number for every ``BLOCK_URLS`` rows of a task."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            block = (TaskContext.get().partitionId() << 32) + (seen + np.arange(b.num_rows)) // BLOCK_URLS
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block)], [*b.schema.names, "block"])

    return settle(urls.select("url", "rejected", "n").mapInArrow(number, "url string, rejected boolean, n long, block long"), "urls")


def block_grams(blocks: DataFrame) -> DataFrame:
    """(block, code, accepted, rejected): the distinct grams of each block, with their counts in accepted and in rejected
    URLs; grams of other URLs alone have zeros."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, size = grams(b.column("url").to_pylist())
            n, block = b.column("n").to_numpy(zero_copy_only=False), b.column("block").to_numpy(zero_copy_only=False)
            mark = np.array([-1 if m is None else int(m) for m in b.column("rejected").to_pylist()], np.int64)
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((code, block[row]))
            code, row = code[order], row[order]
            new = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(block[row], prepend=-1) != 0))
            sums = [np.add.reduceat(np.where(mark[row] == k, n[row], 0), new) if len(new) else np.zeros(0, np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(block[row][new]), pa.array(code[new]), *map(pa.array, sums)], ["block", "code", "accepted", "rejected"])

    return settle(blocks.mapInArrow(count, "block long, code long, accepted long, rejected long"), "grams")


def log_ratios(counts: DataFrame) -> DataFrame:
    """(code, ratio): log p(rejected) - log p(accepted) of the last byte of each gram after the bytes before it.

    Witten-Bell from order 0 up: a context that a class has seen gives way to the shorter one in proportion to its number
    of distinct continuations; one that it has not seen gives way altogether. A context has at most 256 continuations and
    a gram at most 256 longer ones, so neither the windows nor the joins have hot keys."""
    levels = [counts.groupBy("code").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))]
    for n in range(ORDER - 1, 0, -1):
        shorter = F.col("code").bitwiseAND((1 << (8 * n)) - 1) + F.lit(1 << (8 * n))
        levels.append(levels[-1].groupBy(shorter.alias("code")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    known = None
    for n, level in enumerate(reversed(levels), 1):
        w = Window.partitionBy(F.shiftright("code", 8))
        rows = level.select("code", *[e for c in ("a", "r") for e in (F.col(c), F.sum(c).over(w).alias(f"t{c}"), F.count_if(F.col(c) > 0).over(w).alias(f"k{c}"))])
        if known is None:
            rows = rows.withColumns({"pa": F.lit(1 / 256), "pr": F.lit(1 / 256)})
        else:
            shorter = F.col("code").bitwiseAND((1 << (8 * (n - 1))) - 1) + F.lit(1 << (8 * (n - 1)))
            rows = rows.withColumn("shorter", shorter).join(known.withColumnRenamed("code", "shorter"), "shorter")
        p = {f"p{c}": F.when(F.col(f"t{c}") > 0, (F.col(c) + F.col(f"k{c}") * F.col(f"p{c}")) / (F.col(f"t{c}") + F.col(f"k{c}"))).otherwise(F.col(f"p{c}")) for c in ("a", "r")}
        known = rows.withColumns(p).select("code", "pa", "pr")
    return known.select("code", (F.log("pr") - F.log("pa")).alias("ratio"))


def score(urls: DataFrame) -> DataFrame:
    """(url, score) of every distinct URL of ``urls`` (url, rejected boolean), learnt from those with a label."""
    blocks = in_blocks(urls.where("url is not null").groupBy("url", "rejected").agg(F.count("*").alias("n")))
    held = block_grams(blocks)
    seen = held.agg(F.sum("accepted"), F.sum("rejected")).first()
    if not seen[0] or not seen[1]:
        return blocks.select("url").distinct().withColumn("score", F.lit(0.0))
    ratios = held.select("block", "code").join(log_ratios(held), "code")

    def add_up(rows: pd.DataFrame, ratios: pd.DataFrame) -> pd.DataFrame:
        code, size = grams(rows["url"].tolist())
        ratios = ratios.sort_values("code")
        value = ratios["ratio"].to_numpy()[np.searchsorted(ratios["code"].to_numpy(), code)] if len(code) else np.zeros(0)
        sums = np.bincount(np.repeat(np.arange(len(size)), size), value, len(size))
        return pd.DataFrame({"url": rows["url"], "score": sums / np.maximum(size, 1)})

    scored = blocks.select("url", "block").groupBy("block").cogroup(ratios.groupBy("block")).applyInPandas(add_up, "url string, score double")
    return settle(scored.distinct(), "scores")


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str]] | None = None, accepted_loss: float = 0.02) -> DataFrame:
    """Adds url_host, url_path, url_rule, url_score and url_verdict to ``pages``.

    URLs that a rule decides train the models, but for a fifth (by crc32 of the URL), whose accepted
    ones set the threshold: the score that a share ``accepted_loss`` of them exceeds, 0 at least."""
    rules = RULES if rules is None else rules
    pages = rename_clashing(pages, ADDED)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, verdict = matching_rule(host, path, rules)
    held = F.crc32(url) % 5 == 0
    scores = score(pages.select(F.col(url).alias("url"), F.when(~held, verdict == "block").alias("rejected")))
    checked = pages.where(verdict == "allow").where(held).select(F.col(url).alias("url")).join(scores, "url")
    level = checked.agg(F.expr(f"percentile_approx(score, {1 - accepted_loss}, 10000)")).first()[0]
    by_method = F.when(F.col("url_score") > max(0.0, level or 0.0), "block").otherwise("allow")
    joined = pages.join(scores.select(F.col("url").alias("_scored"), F.col("score").alias("url_score")), F.col(url) == F.col("_scored"), "left").drop("_scored")
    judged = joined.withColumns({"url_score": F.coalesce("url_score", F.lit(0.0)), "url_host": host, "url_path": path, "url_rule": rule})
    return judged.withColumn("url_verdict", F.coalesce(verdict, by_method)).select(*pages.columns, *ADDED)
