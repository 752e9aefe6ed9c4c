"""Search: weighted substring search, hit counts, and batch retrieval by BM25 with a substring fallback.

Retrieval takes many questions at once: full-text hits come from an inverted index (``fulltext``), and questions without any are
matched by the 2-grams of what they ask for. Neither questions nor documents are collected or broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import fulltext
from foliant.sources.scratch import settle

FIELDS = ["title", "author", "abstract", "content"]
#: Questions that ask for one part, in a row of candidates.
ASKERS = 1000
#: Fixed values of the search log: what a fallback is called when it counts hits, and when it scores places.
COUNTED, SCORED = "CHINESE_LIKE", "LIKE"


def _holds(field: str, word) -> F.Column:
    return F.coalesce(T.ascii_fold(F.col(field)).contains(T.ascii_fold(word)), F.lit(False))


def like_score(docs: DataFrame, words: list[str]) -> DataFrame:
    """Documents holding any of ``words``, scored by where the first one stands."""
    if not words:
        return docs.limit(0).withColumn("search_score", F.lit(0))
    any_of = F.lit(False)
    for w in words:
        for f in FIELDS:
            any_of = any_of | _holds(f, F.lit(w))
    first = F.lit(words[0])
    score = F.when(F.col("title") == first, 100).when(T.ascii_fold(F.col("title")).startswith(T.ascii_fold(first)), 80).when(_holds("title", first), 60).when(_holds("author", first), 40).when(_holds("abstract", first), 20).when(_holds("content", first), 10).otherwise(0)
    return docs.where(any_of).withColumn("search_score", score)


def hit_count(docs: DataFrame, words: list[str]) -> DataFrame:
    """Documents by the number of words (two characters and more) found in title, abstract or content."""
    n = F.lit(0)
    for w in words:
        if len(w) >= 2:
            n = n + (_holds("title", F.lit(w)) | _holds("abstract", F.lit(w)) | _holds("content", F.lit(w))).cast("int")
    return docs.withColumn("hit_count", n).where("hit_count > 0")


def bm25(docs: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(question_id, id, rank, late): each question's k best documents by BM25 over title and content, best
    (most negative) rank first, ties by id. Rows of one id count as documents of their own."""
    index = fulltext.build(docs)
    hits = fulltext.search(index, questions, k)
    index.discard()
    return hits.withColumn("late", F.lit(0).cast("long"))


def answered(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id) of questions that have full-text hits; no document is scored for it."""
    index = fulltext.build(docs)
    found = settle(fulltext.answered(index, questions), "answered")
    index.discard()
    return found


def top(hits: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy("rank", "late", "id")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def asked_parts(questions: DataFrame, mode: str = "hits") -> DataFrame:
    """(question_id, counted, place, raw, part): what a question is matched by: its keywords, or the white-space parts of one
    without any; ``part`` is folded. ``counted``: documents rank by the number of parts they hold, else by where the first part stands."""
    words = T.question_keywords(F.col("question"))
    pieces = F.array_distinct(F.filter(F.split(T.js_trim(F.col("question")), T.BLANKS), lambda p: p != ""))
    own = T.let(words, lambda ws: F.struct((F.size(ws) > 0).alias("worded"), F.when(F.size(ws) > 0, ws).otherwise(pieces).alias("parts")))
    counted = F.col("o.worded") & F.lit(mode == "hits")
    rows = questions.select("question_id", own.alias("o")).select("question_id", counted.alias("counted"), F.posexplode("o.parts").alias("place", "raw"))
    return rows.withColumn("part", T.ascii_fold(F.col("raw")))


def grams_of(text: F.Column) -> F.Column:
    """Distinct pairs of neighbouring characters and single characters of a text; what is left of characters beyond the
    basic plane may add some that the text does not hold."""
    pairs = F.array_distinct(F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit("(?s)(?=(..))"), 1))
    return T.let(pairs, lambda gs: F.array_distinct(F.concat(gs, F.transform(gs, lambda g: F.substring(g, 1, 1)))))


def _own_grams(part: F.Column) -> F.Column:
    return F.when(F.length(part) == 1, F.array(part)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(part) - 1), lambda i: F.substring(part, i, 2))))


def candidates(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, part): documents that hold a part's rarest 2-gram in any field; parts with a gram that no document holds have none."""
    grams = settle(parts.select("part").distinct().select("part", F.explode(_own_grams(F.col("part"))).alias("gram")), "asked-grams")
    whole = F.concat_ws("\n", *[T.ascii_fold(F.coalesce(f, F.lit(""))) for f in FIELDS])
    held = docs.select(F.col("id").cast("long").alias("id"), F.explode(grams_of(whole)).alias("gram")).join(grams.select("gram").distinct(), "gram")
    held = settle(held, "held-grams")
    df = held.groupBy("gram").agg(F.count("*").alias("df"))
    rarest = grams.join(df, "gram", "left").groupBy("part").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"), F.count_if(F.col("df").isNull()).alias("unheld")).where("unheld = 0")
    return held.join(rarest.select("gram", "part"), "gram").select("id", "part")


def substring_hits(docs: DataFrame, questions: DataFrame, k: int = 5, mode: str = "hits") -> DataFrame:
    """(question_id, id, rank, late, algorithm): each question's k best documents by substring, newest first among equals.

    A question with keywords ranks documents by how many of them title, abstract or content hold (``mode`` "hits"), or like one
    without keywords (``mode`` "score"): documents that hold any part in any field, ranked by where the first part stands.
    Documents are found by an equi-join on 2-grams and looked at once per part and ``ASKERS`` questions; tasks cut to the k
    best of a question before rows of hits are shuffled. Rows of one id are one document."""
    asked = settle(asked_parts(questions, mode), "asked-parts")
    sizes = asked.groupBy("part").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("chunks"))
    askers = asked.join(sizes, "part").groupBy("part", F.pmod(F.xxhash64("question_id"), "chunks").alias("chunk"))
    askers = askers.agg(F.collect_list(F.struct("question_id", "counted", "place", "raw")).alias("askers"))  # about ASKERS
    found = candidates(docs, asked).join(askers, "part").select("id", "part", "askers")
    folded = [T.ascii_fold(F.coalesce(f, F.lit(""))).alias(f) for f in FIELDS]
    texts = docs.select(F.col("id").cast("long").alias("id"), (-F.unix_micros("updated_at")).alias("late"), F.coalesce("title", F.lit("")).alias("exact"), *folded)
    inside = lambda f: F.col(f).contains(F.col("part"))
    met = found.join(texts, "id").select("id", "late", "part", "askers", "exact", (inside("title") | inside("abstract") | inside("content")).alias("body"), inside("author").alias("author"), F.when(F.col("title").startswith(F.col("part")), 80).when(inside("title"), 60).when(inside("author"), 40).when(inside("abstract"), 20).when(inside("content"), 10).otherwise(0).alias("points"))
    each = met.where("body or author").select("id", "late", "part", "body", "exact", "points", F.explode("askers").alias("a")).where("body or not a.counted")
    points = F.when(F.col("a.place") > 0, 0).when(F.col("exact") == F.col("a.raw"), 100).otherwise(F.col("points"))
    sums = each.groupBy(F.col("a.question_id").alias("question_id"), "id").agg(F.first("a.counted").alias("counted"), F.size(F.collect_set("part")).alias("n"), F.max(points).alias("points"), F.min("late").alias("late"))
    rank = F.when(F.col("counted"), -F.col("n")).otherwise(-F.col("points")).cast("double")
    ranked = sums.select("question_id", "id", rank.alias("rank"), "late", F.when(F.col("counted"), COUNTED).otherwise(SCORED).alias("algorithm"))
    return top(ranked, k).drop("place")


def without_hits(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions that are not blank and have no row in ``hits``."""
    return questions.where(~T.is_blank(F.col("question"))).join(hits.select("question_id").distinct(), "question_id", "left_anti")


def retrieve(docs: DataFrame, questions: DataFrame, k: int = 5, mode: str = "hits") -> DataFrame:
    """(question_id, id, rank, late, place, strategy, algorithm): full-text hits, and for questions without any the fallback
    in its ``mode``: "hits" as for a local model, "score" as for a remote one."""
    primary = settle(bm25(docs, questions, k).withColumn("algorithm", F.lit("FTS5")), "primary")
    fallback = substring_hits(docs, without_hits(questions, primary), k, mode).withColumn("strategy", F.lit("fallback"))
    # written, as callers read it more than once and the fallback reads every document
    return settle(top(primary.withColumn("strategy", F.lit("primary")).unionByName(fallback), k), "retrieved")
