"""From retrieved documents to prompts and audited answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

#: Fixed values of the search log: why the fallback was taken, and why it was not.
FALLBACK_REASON, PRIMARY_REASON = "FTS5返回空结果", "FTS5返回有效结果"
HALF, STEP, MOST = 400, 5, 1600
BEFORE, AFTER, BETWEEN = "...前文省略...\n", "\n...后文省略...", "\n\n---\n\n"


def best_snippet(content: str | None, keywords: list[str]) -> str:
    """At most two windows with the most keyword occurrences; the start of the text where there are none.

    A keyword that cannot overlap itself is counted by prefix sums over all windows at once."""
    content = content or ""
    if not content or not keywords:
        return content[: 2 * HALF]
    low = content.lower()
    at = np.arange(0, len(low), STEP)
    start, end = np.maximum(at - HALF, 0), np.minimum(at + HALF, len(low))
    score = np.zeros(len(at), np.int64)
    for word in (k.lower() for k in keywords):
        if not word:
            continue
        found, k = [], low.find(word)
        while k >= 0:
            found.append(k)
            k = low.find(word, k + 1)
        places, n = np.array(found, np.int64), len(word)
        if len(places) < 2 or np.diff(places).min() >= n:
            score += np.maximum(np.searchsorted(places, end - n, "right") - np.searchsorted(places, start), 0)
        else:
            score += [low.count(word, a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    order = np.lexsort((at, -score))
    used: list[tuple[int, int]] = []
    for k in order[score[order] > 0].tolist():
        a, b = max(int(at[k]) - HALF, 0), min(int(at[k]) + HALF, len(content))
        if all(b <= x or a >= y for x, y in used) and sum(y - x for x, y in used) + b - a <= MOST:
            used.append((a, b))
            if len(used) == 2:
                break
    if not used:
        return content[: 2 * HALF]
    return BETWEEN.join(BEFORE * (a > 0) + content[a:b] + AFTER * (b < len(content)) for a, b in used)


def _snippets(content: pd.Series, keywords: pd.Series) -> pd.Series:
    return pd.Series([best_snippet(c, [] if k is None else list(k)) for c, k in zip(content, keywords, strict=True)])


def snippet(content: Column, keywords: Column) -> Column:
    return F.pandas_udf(_snippets, "string")(content, keywords)


def with_snippets(refs: DataFrame) -> DataFrame:
    """``refs`` with ``snippet``, the best ones of each text for its question."""
    # the explode keeps the keywords a column of their own, as an argument of the Python function has to be
    words = refs.withColumn("_words", F.explode(F.array(T.question_keywords(F.col("question")))))
    return words.withColumn("snippet", snippet(F.col("text"), F.col("_words"))).drop("_words")


def references(hits: DataFrame, docs: DataFrame, questions: DataFrame, shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(question_id, question, i, id, title, name, text): the non-blank documents of each question, numbered again. ``shape`` adds
    columns where a text is at hand and stands for it from then on: only what it added is sent to the question, and ``text`` is not."""
    body = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.nullif(F.col("abstract"), F.lit("")), F.lit(""))
    texts = docs.select("id", "title", T.display_name(F.col("file_path"), F.col("title")).alias("name"), body.alias("text")).where(~T.is_blank(F.col("text")))
    held = hits.select("question_id", "id", "place").join(questions.select("question_id", "question"), "question_id").join(texts, "id")
    if shape:
        held = shape(held).drop("text")
    i = F.row_number().over(Window.partitionBy("question_id").orderBy("place", "id"))
    return held.select("question_id", "question", i.alias("i"), "id", "title", "name", *[c for c in held.columns if c not in ("question_id", "question", "id", "place", "title", "name")])


def with_cuts(refs: DataFrame, limit: int = 500) -> DataFrame:
    """``refs`` with ``cut``, the start of each text."""
    return refs.withColumn("cut", T.cut_with_dots(F.col("text"), limit))


def prompts(refs: DataFrame, limit: int = 500) -> DataFrame:
    """(question_id, prompt, doc_list): reference blocks in order, then the question. ``refs`` may bring their ``cut``."""
    refs = refs if "cut" in refs.columns else with_cuts(refs, limit)
    block = F.concat(F.lit("[文档"), F.col("i").cast("string"), F.lit("]\n标题："), "title", F.lit("\n内容："), "cut", F.lit("\n"))
    line = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), "title")
    own = refs.select("question_id", "question", F.struct("i", block.alias("block"), line.alias("line")).alias("r"))
    lists = own.groupBy("question_id", "question").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    blocks, lines = F.array_join(F.transform("rs", lambda r: r["block"]), "\n"), F.array_join(F.transform("rs", lambda r: r["line"]), "\n")
    return lists.select("question_id", F.concat(F.lit("参考资料：\n"), blocks, F.lit("\n\n问题："), "question").alias("prompt"), lines.alias("doc_list"))


def map_prompts(df: DataFrame, fn: Callable[[list[str]], list[str]], prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """``df`` with ``fn``'s answers to its prompts, batch by batch; the number of partitions bounds parallel calls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{answer: fn(b[prompt].tolist())})

    return df.mapInPandas(run, f"{df._jdf.schema().toDDL()}, {answer} string")


#: What is asked of a model about one document.
TASKS = {
    "summarize": "请为以下文档内容生成一个简短的摘要（100-200字）\n{content}",
    "keywords": "请从以下文档内容中提取5-10个关键词，用逗号分隔\n{content}",
    "tags": "请为以下文档内容生成3-5个主题标签，用逗号分隔，标签应简洁且具有代表性：\n{content}",
}
#: Words in a question that ask for a summary, and for a detail.
SUMMARY_WORDS = ["全文", "总结", "概述", "大意", "主旨", "核心", "主要观点", "主要讲了什么", "整体"]
DETAIL_WORDS = ["哪里", "哪个章节", "第几章", "具体", "详细说明", "具体是", "具体讲", "怎么实现"]
NO_DOCUMENTS = "（无可用文档）"
#: A template for small local models; any text with these places in it can take its stead.
LOCAL_TEMPLATE = "# 参考文档清单\n{docsList}\n\n# 参考文档正文\n{referenceDocs}\n\n# 用户问题\n{question}\n\n## 总结\n\n## 详细解释\n\n## 意义补充\n{extra}\n"
SUMMARY_NOTE, DETAIL_NOTE = "\n# 特殊指令\n重点关注整体结构、核心主题和主要观点。", "\n# 特殊指令\n重点关注精确内容、章节定位和具体论述。"


def fill(template: str, **values: Column) -> Column:
    """``template`` with the first ``{name}`` of each value replaced by it, literally; values are not searched for places."""
    parts, rest = [], template
    for name in sorted((n for n in values if f"{{{n}}}" in template), key=lambda n: template.index(f"{{{n}}}")):
        before, _, rest = rest.partition(f"{{{name}}}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def task_prompt(task: str, content: Column) -> Column:
    return fill(TASKS[task], content=T.truncate_for_model(content))


def local_prompt(question: Column, references: Column, doc_list: Column, template: str = LOCAL_TEMPLATE, summary_note: str = SUMMARY_NOTE, detail_note: str = DETAIL_NOTE) -> Column:
    """Prompt for a local model: with the list of documents, and a note where the question asks for a summary or,
    failing that, for a detail."""
    asks = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: question.contains(w))
    note = F.when(asks(SUMMARY_WORDS), summary_note).when(asks(DETAIL_WORDS), detail_note).otherwise("")
    return fill(template, docsList=F.coalesce(F.nullif(doc_list, F.lit("")), F.lit(NO_DOCUMENTS)), referenceDocs=references, question=question, extra=note)


def local_prompts(refs: DataFrame, **options: str) -> DataFrame:
    """(question_id, prompt) from ``references``, with the best snippets of each document as its text; they may bring their ``snippet``."""
    block = F.concat(F.lit("[文档"), F.col("i").cast("string"), F.lit("]\n标题："), "title", F.lit("\n内容："), "snippet", F.lit("\n"))
    own = (refs if "snippet" in refs.columns else with_snippets(refs)).select("question_id", "question", F.struct("i", block.alias("block"), F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), "title").alias("line")).alias("r"))
    lists = own.groupBy("question_id", "question").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    joined = lambda f: F.array_join(F.transform("rs", lambda r: r[f]), "\n")
    return lists.select("question_id", local_prompt(F.col("question"), joined("block"), joined("line"), **options).alias("prompt"))


DOCUMENT_INFO = "array<struct<index: int, id: bigint, title: string, contentLength: int, filePath: string>>"
#: Fields of an audit event, after question_id and step.
EVENT = (
    "action string, query string, algorithm string, startTime bigint, durationMs bigint, error string, resultCount int, resultIds array<bigint>, "
    f"strategy string, usedAlgorithm string, fallbackReason string, sourceAlgorithm string, finalCount int, documentInfo {DOCUMENT_INFO}"
)


def search_audit(questions: DataFrame, hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(question_id, step and the fields of ``EVENT``) of every question that is not blank: START and COMPLETE of each algorithm
    tried, STRATEGY where one found something, FINAL with the documents that have content. Fields that an action does not have
    are null. ``hits`` as of ``retrieve``; results are those it kept, at most its k.

    ``questions`` may bring when a search began (start_fts, start_like, epoch ms), how long it took (ms_fts, ms_like) and how it
    failed (error_fts, error_like); what is not given is null, and a search that failed has no results."""
    given = [F.col(n) if n in questions.columns else F.lit(None).cast("string" if n.startswith("error") else "bigint").alias(n) for n in ("start_fts", "start_like", "ms_fts", "ms_like", "error_fts", "error_like")]
    asked = questions.where(~T.is_blank(F.col("question"))).select("question_id", F.col("question").alias("query"), *given)
    kept = hits.groupBy("question_id").agg(F.max("strategy").alias("found"), F.max("algorithm").alias("used"), F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"))
    body = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.nullif(F.col("abstract"), F.lit("")), F.lit(""))
    held = docs.select("id", "title", "file_path", body.alias("text")).where(~T.is_blank(F.col("text"))).select("id", "title", "file_path", F.length("text").alias("chars"))
    whole = hits.join(held, "id").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "title", "chars", "file_path"))).alias("whole"))
    info = F.transform("whole", lambda x, i: F.struct((i + 1).alias("index"), x["id"].alias("id"), x["title"].alias("title"), x["chars"].alias("contentLength"), x["file_path"].alias("filePath")))
    none = F.array().cast("array<bigint>")
    base = asked.join(kept, "question_id", "left").join(whole, "question_id", "left").select("*", F.coalesce(info.cast(DOCUMENT_INFO), F.array().cast(DOCUMENT_INFO)).alias("info"), (F.col("found") == "primary").alias("_first")).drop("whole")
    base = base.withColumns({"ids": F.coalesce("ids", none), "missed": ~F.coalesce("_first", F.lit(False)), "used": F.coalesce("used", F.lit("NONE"))}).drop("_first")
    kinds = dict(x.split(" ", 1) for x in EVENT.replace(DOCUMENT_INFO, "@").split(", "))

    def event(step: int, action: str, when: Column | None = None, **fields) -> Column:
        values = {"action": F.lit(action)} | fields
        e = F.struct(F.lit(step).alias("step"), *[values.get(n, F.lit(None)).cast(DOCUMENT_INFO if kind == "@" else kind).alias(n) for n, kind in kinds.items()])
        return e if when is None else F.when(when, e)

    c = F.col
    done = lambda ids, family: {"query": c("query"), "durationMs": c(f"ms_{family}"), "error": c(f"error_{family}"), "resultCount": F.size(ids), "resultIds": ids}
    events = F.array(
        event(1, "START", algorithm=F.lit("FTS5"), query=c("query"), startTime=c("start_fts")),
        event(2, "COMPLETE", algorithm=F.lit("FTS5"), **done(F.when(c("missed"), none).otherwise(c("ids")), "fts")),
        event(3, "START", c("missed"), algorithm=F.lit("LIKE"), query=c("query"), startTime=c("start_like")),
        event(4, "COMPLETE", c("missed"), algorithm=F.lit("LIKE"), **done(c("ids"), "like")),
        event(5, "STRATEGY", c("found").isNotNull(), strategy=F.when(c("missed"), "FALLBACK").otherwise("PRIMARY"), usedAlgorithm=c("used"), fallbackReason=F.when(c("missed"), FALLBACK_REASON).otherwise(PRIMARY_REASON)),
        event(6, "FINAL", sourceAlgorithm=c("used"), finalCount=F.size("info"), documentInfo=c("info")),
    )
    return base.select("question_id", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("question_id", "e.*")
