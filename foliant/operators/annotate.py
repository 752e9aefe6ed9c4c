"""Keywords, tags and categories of documents from a lexicon.

A lexicon is a parameter: rows (cat_name, kw_ord, keyword) and (cat_name, tag_ord, tag). One of up to ``MAX_ENTRIES``
goes into the plan as literals, after a check of its size; a larger one meets the documents by an equi-join on 2-grams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.sources.scratch import settle

MAX_ENTRIES = 5000
OTHER = "其他"


def corpus_lexicon(docs: DataFrame, per_category: int = 25) -> tuple[DataFrame, DataFrame]:
    """A lexicon of a corpus: languages are categories, their most used words of five letters and more
    are keywords, and the first three of these are tags. The corpus is read once; every task cuts its counts
    to the ``per_category`` best before they meet."""
    words = docs.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0)).alias("keyword"))
    counts = words.groupBy("lang", "keyword").agg(F.count("*").alias("n"))
    top = counts.withColumn("kw_ord", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "keyword"))).where(F.col("kw_ord") <= per_category)
    keywords = settle(top.select(F.col("lang").alias("cat_name"), "kw_ord", "keyword"), "lexicon")
    return keywords, keywords.where("kw_ord <= 3").select("cat_name", F.col("kw_ord").alias("tag_ord"), F.col("keyword").alias("tag"))


def annotate(docs: DataFrame, keywords: DataFrame, tags: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with lexicon_keywords (first 15 distinct), scores per category, lexicon_tags (first 8),
    category, secondary and confidence. No shuffle: one scan with the lexicon as literals."""
    rows, tag_rows = keywords.limit(MAX_ENTRIES + 1).collect(), tags.limit(MAX_ENTRIES + 1).collect()
    if max(len(rows), len(tag_rows)) > MAX_ENTRIES:
        return _annotate_joined(docs, keywords, tags, text)
    rows = sorted((r["cat_name"], r["kw_ord"], r["keyword"]) for r in rows)
    cats = list(dict.fromkeys(r[0] for r in rows))
    own_tags = {c: [c] for c in cats}
    for r in sorted(tag_rows, key=lambda r: (r["cat_name"], r["tag_ord"])):
        own_tags.setdefault(r["cat_name"], []).append(r["tag"])
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    array = lambda xs: "array(" + ", ".join(map(q, xs)) + ")" if xs else "cast(array() as array<string>)"
    # the explode keeps the lower-cased text from being computed again for every keyword
    out = docs.withColumn("_low", F.explode(F.array(F.lower(F.coalesce(text, F.lit(""))))))
    hits = {c: F.expr(f"filter({array([k.lower() for n, _, k in rows if n == c])}, k -> contains(_low, k))") for c in cats}
    out = out.withColumn("_hits", F.explode(F.array(F.struct(*[h.alias(f"c{i}") for i, h in enumerate(hits.values())])))) if cats else out.withColumn("_hits", F.lit(None))
    parts = [F.col(f"_hits.c{i}") for i in range(len(cats))]
    all_hits = F.concat(*parts) if cats else F.array().cast("array<string>")
    scores = F.array(*[F.struct(F.size(p).alias("score"), F.lit(i).alias("ord"), F.lit(c).alias("name"), F.expr(array(own_tags[c])).alias("tags")) for i, (c, p) in enumerate(zip(cats, parts, strict=True))])
    ranked = F.array_sort(F.filter(scores, lambda s: s["score"] > 0), lambda a, b: F.when(a["score"] != b["score"], b["score"] - a["score"]).otherwise(a["ord"] - b["ord"]))
    out = out.withColumn("lexicon_keywords", F.slice(F.array_distinct(F.transform(all_hits, lambda k: F.trim(F.substring_index(k, "/", 1)))), 1, 15)).withColumn("_rank", F.explode(F.array(ranked)))
    return _summarised(out).drop("_low", "_hits", "_rank")


def _annotate_joined(docs: DataFrame, keywords: DataFrame, tags: DataFrame, text: str) -> DataFrame:
    """``annotate`` with a lexicon of any size: documents meet entries by their first two characters, and by one for shorter
    entries; a document's hits come together in its row, so they must fit one. ``docs`` has unique ids."""
    from foliant.operators.search import grams_of

    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    entries = keywords.select("cat_name", "kw_ord", "keyword", F.lower("keyword").alias("low")).withColumn("gram", F.substring("low", 1, 2))
    met = docs.select("id", F.explode(grams_of(low)).alias("gram")).join(entries, "gram").select("id", "cat_name", "kw_ord", "low")
    met = met.join(docs.select("id", low.alias("whole")), "id").where(F.col("whole").contains(F.col("low"))).drop("whole")
    own_tags = tags.groupBy("cat_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("tag_ord", "tag"))), lambda t: t["tag"]).alias("tags"))
    per = met.groupBy("id", "cat_name").agg(F.count("*").alias("score"), F.array_sort(F.collect_list(F.struct("kw_ord", "low"))).alias("hits")).join(own_tags, "cat_name", "left")
    per = per.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("cat_name", F.col("score").cast("int").alias("score"), "hits", F.concat(F.array("cat_name"), F.coalesce("tags", F.array().cast("array<string>"))).alias("tags")))).alias("_cats"))
    out = docs.join(per, "id", "left").withColumn("_cats", F.coalesce("_cats", F.array().cast(per.schema["_cats"].dataType)))
    hits = F.flatten(F.transform("_cats", lambda c: F.transform(c["hits"], lambda h: F.trim(F.substring_index(h["low"], "/", 1)))))
    ranked = F.transform(F.array_sort(F.transform("_cats", lambda c: F.struct((-c["score"]).alias("neg"), c["cat_name"].alias("name"), c["score"].alias("score"), c["tags"].alias("tags")))), lambda c: F.struct(c["name"].alias("name"), c["score"].alias("score"), c["tags"].alias("tags")))
    out = out.withColumns({"lexicon_keywords": F.slice(F.array_distinct(hits), 1, 15), "_rank": ranked})
    return _summarised(out).drop("_cats", "_rank")


def _summarised(out: DataFrame) -> DataFrame:
    """Tags, category, secondary ones, confidence and scores from ``_rank``, the categories hit, best first."""
    total, first = F.aggregate("_rank", F.lit(0), lambda a, s: a + s["score"]), F.get("_rank", F.lit(0))
    return out.withColumns({
        "lexicon_tags": F.slice(F.array_distinct(F.flatten(F.transform(F.slice("_rank", 1, 5), lambda s: s["tags"]))), 1, 8),
        "category": F.coalesce(first["name"], F.lit(OTHER)),
        "secondary": F.transform(F.slice("_rank", 2, 2), lambda s: s["name"]),
        "confidence": F.when(total > 0, F.floor(F.lit(100.0) * first["score"] / total + 0.5)).otherwise(0).cast("int"),
        "category_scores": F.transform("_rank", lambda s: F.struct(s["name"].alias("name"), s["score"].alias("score"))),
    })


def category_totals(annotated: DataFrame) -> DataFrame:
    return annotated.select(F.explode("category_scores").alias("s")).groupBy(F.col("s.name").alias("category")).agg(F.sum("s.score").alias("hits"), F.count("*").alias("n_docs"))


def _pairs(lists: DataFrame) -> DataFrame:
    """(k1, k2, weight): the pairs of each row's sorted ``ks``, counted. Pairs are made inside the row, all of them."""
    pairs = F.flatten(F.transform("ks", lambda a, i: F.transform(F.slice("ks", i + 2, F.size("ks")), lambda b: F.struct(a.alias("k1"), b.alias("k2")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.k1", "p.k2").agg(F.count("*").alias("weight"))


def corpus_graph(bridge: DataFrame) -> DataFrame:
    """(k1, k2, weight): keyword pairs that share a document."""
    return _pairs(bridge.groupBy("document_id").agg(F.array_sort(F.collect_set("value")).alias("ks")))


PARAGRAPHS = rf"\n{T.BLANK}*\n"


def paragraph_keywords(docs: DataFrame, bridge: DataFrame, between: str = PARAGRAPHS) -> DataFrame:
    """(document_id, paragraph, ks): which of a document's keywords (bridge: document_id, value) each of its paragraphs
    holds, by substring in any case, sorted; paragraphs are parted by the pattern ``between``, blank lines by default, and numbered from 0. ``docs`` is (id, text)."""
    words = bridge.groupBy("document_id").agg(F.array_sort(F.collect_set("value")).alias("words"))
    parts = F.split(F.lower(F.coalesce("text", F.lit(""))), between)
    held = docs.join(words, docs["id"] == words["document_id"]).select("document_id", "words", F.posexplode(parts).alias("paragraph", "part"))
    return held.select("document_id", "paragraph", F.filter("words", lambda w: F.col("part").contains(F.lower(w))).alias("ks"))


def paragraph_graph(docs: DataFrame, bridge: DataFrame, between: str = PARAGRAPHS) -> DataFrame:
    """(k1, k2, weight): keyword pairs that share a paragraph, by number of such paragraphs."""
    return _pairs(paragraph_keywords(docs, bridge, between).where(F.size("ks") > 1))


def corpus_graph_nodes(bridge: DataFrame, keywords: DataFrame) -> DataFrame:
    """(node, category, n_docs): the keywords of a corpus graph, each with its discipline, the first lexicon
    category that lists it (``OTHER`` for none), and the number of its documents."""
    counts = bridge.groupBy(F.col("value").alias("node")).agg(F.countDistinct("document_id").alias("n_docs"))
    first = keywords.groupBy(F.lower("keyword").alias("k")).agg(F.min_by("cat_name", F.struct("cat_name", "kw_ord")).alias("category"))
    return counts.join(first, F.lower("node") == F.col("k"), "left").select("node", F.coalesce("category", F.lit(OTHER)).alias("category"), "n_docs")
