"""Keyword graphs of documents: candidates, top keywords, co-occurrence, nodes and statistics."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

HAN = r"[\x{4e00}-\x{9fa5}]"
BOUNDARY = r"[\x{3000}-\x{303f}\x{ff00}-\x{ffef}\s\w\p{Punct}·…—“”‘’]"


def candidate_terms(docs: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """(id, word, freq, first): Han 2- to 4-grams at word boundaries and English words of three letters
    and more, counted per document; ``first`` orders them by first use, Han before English.

    ``docs`` is (id, text). A Han word below four characters counts if its first occurrence in the text
    has a boundary before or after it. Only a run's neighbours can be one, so runs of Han characters travel with
    the characters beside them and the text itself does not.

    Texts, which are smaller than the rows of their terms, are dealt by id; counting, and whatever groups or joins by id
    after it, needs no other shuffle. The number of partitions is the session's, as texts are small beside what is made of them."""
    docs = docs.select("id", "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    stop = F.array(*[F.lit(w) for w in stop_words or []]).cast("array<string>")
    text = F.coalesce(F.col("text"), F.lit(""))
    run = F.lit(rf"(?s)(?:(?<=(.))|(?<!.))({HAN}{{2,}})(?=(.)|$)")
    runs = F.arrays_zip(*[F.regexp_extract_all(text, run, k).alias(n) for k, n in ((1, "before"), (2, "segment"), (3, "after"))])
    seg = docs.select("id", F.posexplode(runs).alias("s", "r")).select("id", "s", "r.before", "r.segment", "r.after")
    sized = seg.select("*", F.explode(F.sequence(F.lit(2), F.least(F.lit(4), F.length("segment")))).alias("n"))
    grams = sized.select("id", "s", "n", "before", "after", F.length("segment").alias("size"), F.posexplode(F.transform(F.sequence(F.lit(1), F.length("segment") - F.col("n") + 1), lambda i: F.substring(F.col("segment"), i, F.col("n")))).alias("p", "word"))
    edge = lambda c: (F.col(c) == "") | F.col(c).rlike(BOUNDARY)
    bounded = ((F.col("p") == 0) & edge("before")) | ((F.col("p") + F.col("n") == F.col("size")) & edge("after"))
    han = grams.groupBy("id", "word").agg(F.count("*").alias("freq"), F.min(F.struct(F.lit(0).alias("kind"), "s", "n", "p", bounded.alias("edge"))).alias("f"))
    han = han.where((F.length("word") == 4) | F.col("f.edge")).select("id", "word", "freq", F.struct("f.kind", "f.s", "f.n", "f.p").alias("first"))
    en = docs.select("id", F.posexplode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), 0)).alias("p", "word"))
    en = en.groupBy("id", "word").agg(F.count("*").alias("freq"), F.min(F.struct(F.lit(1).alias("kind"), F.lit(0).alias("s"), F.lit(0).alias("n"), "p")).alias("first"))
    return han.unionByName(en).where(~F.array_contains(stop, F.col("word")))


def graph_keywords(candidates: DataFrame, top_n: int = 12) -> DataFrame:
    """(id, place, word, freq): greedy choice by score, dropping words that overlap a chosen one: contained
    in a longer one, or alike in six tenths of the shorter one's characters at the start or end."""
    han = F.col("word").rlike(HAN)
    weight = F.when(han & (F.length("word") == 3), 1.2).when(han & (F.length("word") >= 4), 1.5).otherwise(1.0)
    scored = candidates.where((F.col("freq") >= 2) | (F.length("word") >= 3)).withColumn("score", F.col("freq") * weight)
    lists = scored.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "first", "word", "freq"))).alias("ks"))
    chosen = F.expr(f"""
        aggregate(ks, cast(array() as array<struct<word: string, freq: bigint>>), (acc, k) ->
          if(size(acc) >= {top_n} or exists(acc, a -> (length(a.word) > length(k.word) and contains(a.word, k.word))
              or left(a.word, cast(ceil(0.6 * least(length(a.word), length(k.word))) as int)) = left(k.word, cast(ceil(0.6 * least(length(a.word), length(k.word))) as int))
              or right(a.word, cast(ceil(0.6 * least(length(a.word), length(k.word))) as int)) = right(k.word, cast(ceil(0.6 * least(length(a.word), length(k.word))) as int))),
            acc, array_append(acc, named_struct('word', k.word, 'freq', k.freq))))""")
    return lists.select("id", F.posexplode(chosen).alias("place", "k")).select("id", (F.col("place") + 1).alias("place"), "k.word", "k.freq")


CHOSEN = "array<struct<word: string, freq: bigint>>"
_RUN, _WORD = re.compile("[\u4e00-\u9fa5]{2,}"), re.compile("[a-z]{3,}")
_EDGE = re.compile(rf"[\u3000-\u303f\uff00-\uffef\s\w{re.escape(string.punctuation)}·…—“”‘’]", re.ASCII)


def choose(text: str, stop: frozenset[str], top_n: int) -> list[tuple[str, int]]:
    """The (word, freq) that ``graph_keywords`` of ``candidate_terms`` chooses of one text, in order."""
    freq: dict[str, int] = {}
    first: dict[str, tuple] = {}
    edged = set()
    for s, run in enumerate(_RUN.finditer(text)):
        segment, end = run.group(), run.end()
        sides = [run.start() == 0 or _EDGE.match(text[run.start() - 1]), end == len(text) or _EDGE.match(text[end])]
        for n in range(2, min(4, len(segment)) + 1):
            for p in range(len(segment) - n + 1):
                word = segment[p : p + n]
                freq[word] = freq.get(word, 0) + 1
                if word not in first:
                    first[word] = (0, s, n, p)
                    if n == 4 or (p == 0 and sides[0]) or (p + n == len(segment) and sides[1]):
                        edged.add(word)
    freq = {w: n for w, n in freq.items() if w in edged}
    for p, word in enumerate(_WORD.findall(text.lower())):
        freq[word] = freq.get(word, 0) + 1
        first.setdefault(word, (1, 0, 0, p))
    weight = lambda w: 1.0 if first[w][0] else {3: 1.2, 4: 1.5}.get(len(w), 1.0)
    ranked = sorted((-n * weight(w), first[w], w) for w, n in freq.items() if w not in stop and (n >= 2 or len(w) >= 3))
    chosen: list[str] = []
    for _, _, word in ranked:
        if len(chosen) == top_n:
            break
        for a in chosen:
            t = -(-6 * min(len(a), len(word)) // 10)
            if (len(a) > len(word) and word in a) or a[:t] == word[:t] or a[-t:] == word[-t:]:
                break
        else:
            chosen.append(word)
    return [(w, freq[w]) for w in chosen]


def with_keywords(docs: DataFrame, stop_words: list[str] | None = None, top_n: int = 12) -> DataFrame:
    """``docs`` (id, text, ...) with ``ks``, the keywords of each text's graph. All is done in a document's row: neither texts
    nor their words are shuffled. The choice goes word by word, which row functions can't do without copying the list at each."""
    stop = frozenset(stop_words or [])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("word", pa.string()), ("freq", pa.int64())]))
        for b in batches:
            found = [[{"word": w, "freq": n} for w, n in choose(t or "", stop, top_n)] for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*b.schema.names, "ks"])

    return docs.mapInArrow(run, f"{docs._jdf.schema().toDDL()}, ks {CHOSEN}")


def keyword_rows(chosen: DataFrame) -> DataFrame:
    """(id, place, word, freq) of ``with_keywords``."""
    return chosen.select("id", F.posexplode("ks").alias("place", "k")).select("id", (F.col("place") + 1).alias("place"), "k.word", "k.freq")


WORD_BITS = 62


def row_pairs(held: DataFrame) -> DataFrame:
    """(id, source, target, weight) of rows (id, text, ws), ws the sorted words to pair: sentences of a text that hold both.

    Each word gets a bitmap of the sentences that hold it, in longs of ``WORD_BITS`` sentences; a pair's weight is the number of common
    bits. No sentence is a row, and nothing is shuffled."""
    held = held.where(F.size("ws") > 1).select("id", "ws", F.explode(F.array(T.sentences(F.col("text")))).alias("ss"))
    starts = F.when(F.size("ss") > 0, F.sequence(F.lit(1), F.size("ss"), F.lit(WORD_BITS))).otherwise(F.array().cast("array<int>"))
    bit = lambda s, k: F.when(F.contains(s, k), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    bits = lambda w: F.transform(starts, lambda a: F.aggregate(F.slice("ss", a, WORD_BITS), F.lit(0).cast("long"), lambda acc, s: acc * 2 + bit(s, w)))
    maps = held.select("id", F.explode(F.array(F.transform("ws", lambda w: F.struct(w.alias("w"), bits(w).alias("b"))))).alias("ms"))
    maps = maps.select("id", F.explode(F.array(F.filter("ms", lambda m: F.exists(m["b"], lambda x: x != 0)))).alias("ms"))
    both = lambda a, b: F.aggregate(F.zip_with(a["b"], b["b"], lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, x: n + x)
    pairs = F.flatten(F.transform("ms", lambda a, i: F.transform(F.slice("ms", i + 2, F.size("ms")), lambda b: F.struct(a["w"].alias("source"), b["w"].alias("target"), both(a, b).cast("long").alias("weight")))))
    return maps.select("id", F.explode(pairs).alias("p")).where("p.weight > 0").select("id", "p.source", "p.target", "p.weight")


def cooccurrence(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """``row_pairs`` of texts whose keywords (id, word) lie in a table of their own; both are dealt by id."""
    # few bytes of text stand for much work, so partitions are the session's and not merged by size
    texts, keywords = (x.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id") for x in (docs.select("id", "text"), keywords))
    return row_pairs(texts.join(keywords.groupBy("id").agg(F.array_sort(F.collect_list("word")).alias("ws")), "id"))


def nodes(keywords: DataFrame, docs: DataFrame) -> DataFrame:
    """Keyword nodes with weights scaled to 0.3..1, and a centre node for a document with a title."""
    most = F.max("freq").over(Window.partitionBy("id"))
    words = keywords.select("id", F.col("word").alias("node"), F.col("word").alias("label"), F.lit("keyword").alias("type"), F.col("freq").alias("weight"), (0.3 + 0.7 * F.col("freq") / most).alias("normalized_weight"))
    top = keywords.groupBy("id").agg(F.max("freq").alias("most"))
    centre = docs.where(~T.is_blank(F.col("title"))).join(top, "id").select("id", F.lit("__doc_center__").alias("node"), T.cut_with_dots(F.col("title"), 12).alias("label"), F.lit("document").alias("type"), (F.col("most") + 2).alias("weight"), F.lit(1.0).alias("normalized_weight"))
    return words.unionByName(centre)


def links(keywords: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, source, target, weight, type): the centre of a document with a title to each of its keywords, and
    the co-occurring ``pairs``."""
    titled = docs.where(~T.is_blank(F.col("title"))).select("id")
    centre = keywords.join(titled, "id", "left_semi").select("id", F.lit("__doc_center__").alias("source"), F.col("word").alias("target"), F.col("freq").alias("weight"), F.lit("keyword-link").alias("type"))
    return centre.unionByName(pairs.select("id", "source", "target", "weight", F.lit("cooccurrence").alias("type")))


def stats(docs: DataFrame, keywords: DataFrame, links: DataFrame) -> DataFrame:
    k = keywords.groupBy("id").agg(F.count("*").alias("keywords"))
    e = links.groupBy("id").agg(F.count("*").alias("edges"))
    out = docs.select("id", F.size(T.sentences(F.col("text"))).alias("sentences"), T.is_blank(F.col("title")).alias("bare")).join(k, "id", "left").join(e, "id", "left")
    n, m = F.coalesce("keywords", F.lit(0)), F.coalesce("edges", F.lit(0))
    return out.select("id", n.alias("keyword_count"), m.alias("cooccurrence_edges"), (m + F.when(F.col("bare"), 0).otherwise(n)).alias("edge_count"), F.when(n > 0, F.col("sentences")).otherwise(0).alias("sentence_count"))
