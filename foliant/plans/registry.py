"""Registered queries of the document library, and their SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import annotate, catalog, context, graph, logs, search
from foliant.operators.numbering import numbered
from foliant.sources import library as L
from foliant.sources.scratch import settle, shared_dir
from foliant.streaming import sync

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
LIB, ASKED, LISTED, CALLS = L.LIBRARY_SQL, L.QUESTIONS_SQL, L.LISTING_SQL, L.CALLS_SQL


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return L.documents(spark, sf)


def _given(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- listings -----------------------------------------------------------------------------------


@query(f"WITH {LIB} SELECT file_type, count(*) AS n FROM lib GROUP BY file_type")
def file_types(spark, sf):
    return _docs(spark, sf).groupBy("file_type").agg(F.count("*").alias("n"))


@query(f"WITH {LIB} SELECT id, regexp_extract(file_path, '([^/]+)\\.[^.]*$', 1) AS title, regexp_extract(file_path, '[^/]+$') AS name FROM lib")
def titles(spark, sf):
    return _docs(spark, sf).select("id", T.title_of(F.col("file_path")).alias("title"), T.display_name(F.col("file_path"), F.col("title")).alias("name"))


@query(f"WITH {LIB} SELECT id, title FROM lib WHERE favorite = 1")
def favorites(spark, sf):
    return _docs(spark, sf).where("favorite = 1").orderBy(F.desc("updated_at"), "id").select("id", "title")


@query(f"WITH {LIB} SELECT id, strftime(last_viewed, '%Y-%m-%d %H:%M') AS viewed FROM lib WHERE last_viewed IS NOT NULL")
def recent(spark, sf):
    return _docs(spark, sf).where("last_viewed is not null").orderBy(F.desc("last_viewed"), "id").select("id", F.date_format("last_viewed", "yyyy-MM-dd HH:mm").alias("viewed"))


@query(f"WITH {LIB} SELECT id FROM lib WHERE trim(coalesce(content, ''), ' ' || chr(10) || chr(9)) <> '' AND (abstract IS NULL OR trim(abstract) = '')")
def needs_summary(spark, sf):
    return _docs(spark, sf).where(~T.is_blank(F.col("content")) & T.is_blank(F.col("abstract"))).select("id")


@query(f"WITH {LIB} SELECT id FROM lib WHERE NOT starts_with(lower(file_path), '/lib/src1/')")
def outside_path(spark, sf):
    return catalog.outside_path(_docs(spark, sf), "/Lib/SRC1/").select("id")


@query(f"WITH {LIB} SELECT id, title FROM lib ORDER BY updated_at DESC, id LIMIT 15 OFFSET 30")
def page_all(spark, sf):
    return catalog.page(_docs(spark, sf), 30, 15).select("id", "title")


@query(f"WITH {LIB}, n AS (SELECT id, title, row_number() OVER (ORDER BY updated_at DESC, id) - 1 AS number FROM lib) SELECT number // 15 AS page, number, id, title FROM n")
def page_directory(spark, sf):
    directory = settle(catalog.page_directory(_docs(spark, sf).select("id", "title", "updated_at")), "directory")
    return directory.select(F.expr("number div 15").alias("page"), "number", "id", "title")


@query(f"WITH {LIB} SELECT id, title FROM lib ORDER BY updated_at DESC, id LIMIT 15 OFFSET (SELECT (count(*) // 30) * 15 FROM lib)")
def page_deep(spark, sf):
    """The page in the middle of the library, read from its directory."""
    directory = settle(catalog.page_directory(_docs(spark, sf).select("id", "title", "updated_at")), "directory")
    return catalog.page_of(directory, directory.count() // 30).select("id", "title")


@query(f"WITH {LIB} SELECT count(*) AS total, count(*) FILTER (WHERE content <> '') AS with_content, count(*) FILTER (WHERE abstract <> '') AS with_abstract, count(*) FILTER (WHERE regexp_matches(lower(concat_ws(' ', title, content)), '[\\p{{L}}\\p{{N}}]')) AS indexed, (SELECT count(DISTINCT source) FROM documents) AS n_tags FROM lib")
def library_health(spark, sf):
    return catalog.health(_docs(spark, sf), _docs(spark, sf).select(F.col("author").alias("value")))


@query(f"WITH {LIB} SELECT id, title, favorite FROM lib WHERE id IN (7, 42, 100)")
def point_lookup(spark, sf):
    return catalog.by_ids(_docs(spark, sf), [42, 7, 100]).select("id", "title", "favorite")


@query(f"WITH {LIB} SELECT id, title FROM lib ORDER BY updated_at DESC, id LIMIT 25")
def loaded_pages(spark, sf):
    docs = _docs(spark, sf)
    return catalog.loaded_pages(catalog.page(docs, 0, 15), catalog.page(docs, 10, 15)).select("id", "title")


@query("SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY source")
def stored_files(spark, sf):
    """The given texts written as text files, a folder a source, then listed and read as files."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    _given(spark, sf, "documents").select("text", "source").write.option("maxRecordsPerFile", 500).partitionBy("source").text(path)
    held = L.listing(spark, path).join(L.contents(spark, path), "file_path")
    source = F.regexp_extract("file_path", "/source=([^/]+)/", 1)
    return held.groupBy(source.alias("source")).agg(F.sum("file_size").alias("bytes"), F.sum(F.length("content")).cast("long").alias("chars"))


# --- substring search ---------------------------------------------------------------------------


def _like(words: list[str]) -> str:
    any_of = " OR ".join(f"contains(lower(coalesce({f}, '')), '{w}')" for w in words for f in search.FIELDS)
    first = words[0]
    return f"""CASE WHEN title = '{first}' THEN 100 WHEN starts_with(lower(title), '{first}') THEN 80 WHEN contains(lower(title), '{first}') THEN 60 WHEN contains(lower(author), '{first}') THEN 40
      WHEN contains(lower(coalesce(abstract, '')), '{first}') THEN 20 WHEN contains(lower(content), '{first}') THEN 10 ELSE 0 END AS search_score FROM lib WHERE {any_of}"""


@query(f"WITH {LIB} SELECT id, {_like(['the', 'nicht'])}")
def like_score_search(spark, sf):
    return search.like_score(_docs(spark, sf), ["the", "nicht"]).select("id", "search_score")


@query(f"WITH {LIB} SELECT id, search_score FROM (SELECT id, updated_at, {_like(['the'])}) ORDER BY search_score DESC, updated_at DESC, id LIMIT 15")
def search_page(spark, sf):
    return search.like_score(_docs(spark, sf), ["the"]).orderBy(F.desc("search_score"), F.desc("updated_at"), "id").limit(15).select("id", "search_score")


@query(f"""WITH {LIB}, h AS (SELECT id, {' + '.join(f"CAST(contains(lower(title), '{w}') OR contains(lower(coalesce(abstract, '')), '{w}') OR contains(lower(content), '{w}') AS INTEGER)" for w in ('nicht', 'the', 'que'))} AS hit_count FROM lib)
  SELECT * FROM h WHERE hit_count > 0""")
def hit_count_search(spark, sf):
    return search.hit_count(_docs(spark, sf), ["nicht", "the", "que", "x"]).select("id", "hit_count")


# --- lexicon ------------------------------------------------------------------------------------

LEX = """lw AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS keyword FROM documents),
lexicon AS (SELECT * FROM (SELECT lang, keyword, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, keyword) AS kw_ord FROM lw GROUP BY lang, keyword) WHERE kw_ord <= 25),
cats AS (SELECT lang, row_number() OVER (ORDER BY lang) AS ord FROM (SELECT DISTINCT lang FROM lexicon)),
hits AS (SELECT d.doc_id AS id, c.ord, l.lang, l.kw_ord, l.keyword FROM documents d JOIN lexicon l ON contains(lower(d.text), l.keyword) JOIN cats c ON c.lang = l.lang),
scores AS (SELECT id, lang, ord, count(*) AS score FROM hits GROUP BY id, lang, ord),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS r, sum(score) OVER (PARTITION BY id) AS total FROM scores)"""


def _lexicon(spark, sf):
    """(keywords, tags) of the given documents; reads the corpus once."""
    return annotate.corpus_lexicon(_given(spark, sf, "documents"))


def _annotated(spark, sf, lexicon=None):
    docs = _given(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return annotate.annotate(docs, *(lexicon or _lexicon(spark, sf)))


_FIRST15 = "SELECT id, keyword, row_number() OVER (PARTITION BY id ORDER BY o) AS r FROM (SELECT id, keyword, min(ord * 1000 + kw_ord) AS o FROM hits GROUP BY id, keyword)"


@query(f"WITH {LEX}, k AS (SELECT id, string_agg(keyword, '|' ORDER BY r) AS keywords FROM ({_FIRST15}) WHERE r <= 15 GROUP BY id) SELECT doc_id AS id, coalesce(keywords, '') AS keywords FROM documents LEFT JOIN k ON id = doc_id")
def lexicon_keywords(spark, sf):
    return _annotated(spark, sf).select("id", F.array_join("lexicon_keywords", "|").alias("keywords"))


@query(f"""WITH {LEX}, tags AS (SELECT lang, 0 AS t, lang AS tag FROM cats UNION ALL SELECT lang, kw_ord, keyword FROM lexicon WHERE kw_ord <= 3),
  own AS (SELECT id, tag, min(r * 100 + t) AS o FROM ranked JOIN tags USING (lang) WHERE r <= 5 GROUP BY id, tag),
  k AS (SELECT id, string_agg(tag, '|' ORDER BY o) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS n FROM own) WHERE n <= 8 GROUP BY id)
  SELECT doc_id AS id, coalesce(tags, '') AS tags FROM documents LEFT JOIN k ON id = doc_id""")
def lexicon_tags(spark, sf):
    return _annotated(spark, sf).select("id", F.array_join("lexicon_tags", "|").alias("tags"))


@query(f"""WITH {LEX}, k AS (SELECT id, max(lang) FILTER (WHERE r = 1) AS category, string_agg(lang, '|' ORDER BY r) FILTER (WHERE r IN (2, 3)) AS secondary,
  CAST(floor(100.0 * max(score) / max(total) + 0.5) AS INTEGER) AS confidence FROM ranked GROUP BY id)
  SELECT doc_id AS id, coalesce(category, '{annotate.OTHER}') AS category, coalesce(secondary, '') AS secondary, coalesce(confidence, 0) AS confidence FROM documents LEFT JOIN k ON id = doc_id""")
def categorize(spark, sf):
    return _annotated(spark, sf).select("id", "category", F.array_join("secondary", "|").alias("secondary"), "confidence")


@query(f"WITH {LEX} SELECT lang AS category, CAST(sum(score) AS BIGINT) AS hits, count(*) AS n_docs FROM scores GROUP BY lang")
def category_totals(spark, sf):
    return annotate.category_totals(_annotated(spark, sf))


# --- relations ----------------------------------------------------------------------------------

BRIDGE = f"{LEX}, bridge AS (SELECT id AS document_id, keyword AS value FROM ({_FIRST15}) WHERE r <= 15)"


def _bridge(spark, sf, lexicon=None):
    return _annotated(spark, sf, lexicon).select(F.col("id").alias("document_id"), F.explode("lexicon_keywords").alias("value"))


@query(f"WITH {BRIDGE}, {LIB} SELECT id, coalesce(ks, '') AS keywords FROM lib LEFT JOIN (SELECT document_id, string_agg(value, '|' ORDER BY value) AS ks FROM bridge GROUP BY document_id) ON document_id = id")
def with_relations(spark, sf):
    return catalog.with_relations(_docs(spark, sf), _bridge(spark, sf), "keywords").select("id", F.array_join("keywords", "|").alias("keywords"))


@query(f"WITH {BRIDGE}, {LIB} SELECT id, title, coalesce(ks, '') AS keywords FROM lib LEFT JOIN (SELECT document_id, string_agg(value, '|' ORDER BY value) AS ks FROM bridge GROUP BY document_id) ON document_id = id")
def all_newest_first(spark, sf):
    rows = catalog.with_relations(_docs(spark, sf), _bridge(spark, sf), "keywords").orderBy(F.desc("updated_at"), "id")
    return rows.select("id", "title", F.array_join("keywords", "|").alias("keywords"))


_TAG = "(SELECT keyword FROM lexicon WHERE lang = 'en' AND kw_ord = 1)"


def _lexicon_word(keywords, lang: str, place: int) -> str:
    found = keywords.where((F.col("cat_name") == lang) & (F.col("kw_ord") == place)).first()
    return found["keyword"] if found else ""


@query(f"WITH {BRIDGE}, {LIB} SELECT id, title FROM lib WHERE id IN (SELECT document_id FROM bridge WHERE value = {_TAG})")
def by_tag(spark, sf):
    lexicon = _lexicon(spark, sf)
    return catalog.with_any(_docs(spark, sf), _bridge(spark, sf, lexicon), _lexicon_word(lexicon[0], "en", 1)).orderBy(F.desc("updated_at"), "id").select("id", "title")


@query(f"""WITH {BRIDGE}, {LIB}, wanted AS (SELECT keyword FROM lexicon WHERE lang = 'en' AND kw_ord IN (1, 2))
  SELECT id, title FROM lib WHERE id IN (SELECT document_id FROM bridge WHERE value IN (SELECT keyword FROM wanted) GROUP BY document_id HAVING count(DISTINCT value) = 2)""")
def by_all_tags(spark, sf):
    lexicon = _lexicon(spark, sf)
    words = [_lexicon_word(lexicon[0], "en", k) for k in (1, 2)]
    return catalog.with_all(_docs(spark, sf), _bridge(spark, sf, lexicon), words).select("id", "title")


@query(f"WITH {BRIDGE} SELECT DISTINCT keyword AS value FROM lexicon WHERE keyword NOT IN (SELECT value FROM bridge WHERE document_id % 4 = 0)")
def orphans(spark, sf):
    lexicon = _lexicon(spark, sf)
    keywords = lexicon[0]
    kept = catalog.cascade_delete(_docs(spark, sf), _bridge(spark, sf, lexicon), _docs(spark, sf).where("id % 4 <> 0").select("id"))[1]
    return catalog.orphans(keywords.select(F.col("keyword").alias("value")).distinct(), kept)


@query(f"WITH {BRIDGE} SELECT document_id, value FROM bridge WHERE document_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1')")
def cascade_delete(spark, sf):
    docs = _docs(spark, sf)
    return catalog.cascade_delete(docs, _bridge(spark, sf), docs.where("author = 'src1'").select("id"))[1]


@query(f"WITH {BRIDGE} SELECT a.value AS k1, b.value AS k2, count(*) AS weight FROM bridge a JOIN bridge b ON a.document_id = b.document_id AND a.value < b.value GROUP BY ALL")
def corpus_keyword_graph(spark, sf):
    return annotate.corpus_graph(_bridge(spark, sf))


@query(f"""WITH {BRIDGE}, parts AS (SELECT doc_id AS document_id, unnest(ps) AS part, unnest(range(len(ps))) AS paragraph FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS ps FROM documents)),
  held AS (SELECT document_id, paragraph, value FROM parts JOIN bridge USING (document_id) WHERE contains(part, lower(value)))
  SELECT a.value AS k1, b.value AS k2, count(*) AS weight FROM held a JOIN held b ON a.document_id = b.document_id AND a.paragraph = b.paragraph AND a.value < b.value GROUP BY ALL""")
def paragraph_keyword_graph(spark, sf):
    return annotate.paragraph_graph(_given(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), _bridge(spark, sf), "\n")


@query(f"WITH {BRIDGE} SELECT value, count(*) AS n_docs FROM bridge GROUP BY value")
def keyword_list(spark, sf):
    return _bridge(spark, sf).groupBy("value").agg(F.count("*").alias("n_docs")).orderBy("value")


@query(f"""WITH {BRIDGE}, even AS (SELECT DISTINCT value FROM bridge WHERE document_id % 2 = 0), known AS (SELECT value, row_number() OVER (ORDER BY value) * 3 AS id FROM even),
  fresh AS (SELECT DISTINCT value FROM bridge WHERE value NOT IN (FROM even)) SELECT id, value FROM known UNION ALL SELECT 3 * (SELECT count(*) FROM even) + row_number() OVER (ORDER BY value), value FROM fresh""")
def dictionary_upsert(spark, sf):
    bridge = _bridge(spark, sf)
    known = numbered(bridge.where("document_id % 2 = 0").select("value").distinct(), "value").select((F.col("number") * 3 + 3).alias("id"), "value")
    once = settle(catalog.add_to_dictionary(known, bridge.select("value")), "dictionary")
    return catalog.add_to_dictionary(once, bridge.select("value"))


_NEW = "SELECT document_id, upper(value) AS value FROM bridge WHERE document_id % 5 = 0"


def _new_pairs(bridge):
    return bridge.where("document_id % 5 = 0").select("document_id", F.upper("value").alias("value"))


@query(f"WITH {BRIDGE} SELECT document_id, value FROM bridge UNION {_NEW}")
def bridge_add(spark, sf):
    bridge = _bridge(spark, sf)
    return catalog.add_to_bridge(bridge, _new_pairs(bridge))


@query(f"WITH {BRIDGE} SELECT document_id, value FROM bridge WHERE document_id % 5 <> 0 UNION {_NEW}")
def bridge_replace(spark, sf):
    bridge, changed = _bridge(spark, sf), _docs(spark, sf).where("id % 5 = 0").select("id")
    return catalog.replace_in_bridge(bridge, _new_pairs(bridge), changed)


@query(f"""WITH {BRIDGE} SELECT value AS node, coalesce(min_lang, '{annotate.OTHER}') AS category, count(DISTINCT document_id) AS n_docs FROM bridge
  LEFT JOIN (SELECT keyword, min(lang) AS min_lang FROM lexicon GROUP BY keyword) ON keyword = value GROUP BY ALL""")
def corpus_graph_nodes(spark, sf):
    lexicon = _lexicon(spark, sf)
    return annotate.corpus_graph_nodes(_bridge(spark, sf, lexicon), lexicon[0])


# --- sync ---------------------------------------------------------------------------------------

DIFF = f"""{LIB}, {LISTED}, diff AS (SELECT coalesce(l.file_path, d.file_path) AS file_path,
  CASE WHEN d.file_path IS NULL THEN 'new' WHEN l.file_path IS NULL THEN 'deleted' WHEN d.file_mtime IS NOT NULL AND (l.file_mtime <> d.file_mtime OR l.file_size IS DISTINCT FROM d.file_size) THEN 'modified' ELSE 'existing' END AS status,
  d.file_mtime IS NULL AS no_mtime FROM listing l FULL JOIN lib d ON l.file_path = d.file_path)"""


@query(f"WITH {DIFF} SELECT file_path, status, status = 'existing' AND no_mtime AS back_fill FROM diff")
def sync_diff(spark, sf):
    return catalog.sync_diff(L.library_listing(spark, sf), _docs(spark, sf))


@query(f"WITH {DIFF} SELECT status, count(*) AS n FROM diff GROUP BY status")
def sync_summary(spark, sf):
    return catalog.sync_diff(L.library_listing(spark, sf), _docs(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


def _read_files(spark, sf):
    """What a parse of the listed files gave: the given texts, but for PDFs whose text layer the gate refuses."""
    docs = _docs(spark, sf)
    listing = L.library_listing(spark, sf)
    texts = docs.select("file_path", F.concat("content", F.lit("!")).alias("content"), (F.col("id") % 4).alias("pages"))
    pages = _given(spark, sf, "pages").select(F.concat(F.lit("/lib/new/page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), F.col("html").alias("content"), F.lit(1).alias("pages"))
    rows = listing.join(texts.unionByName(pages), "file_path")
    refused = (T.extension(F.col("file_path")) == "pdf") & (T.pdf_gate(F.col("content"), F.col("pages")) != "ok")
    gate = F.when(refused, T.pdf_gate(F.col("content"), F.col("pages")))
    return rows.select("file_path", T.title_of(F.col("file_path")).alias("title"), "content", T.file_type(F.col("file_path")).alias("file_type"), "file_mtime", "file_size", gate.alias("error"))


_HEAD = "trim(content, ' ' || chr(10))"
READ = f"""texts AS (SELECT file_path, content || '!' AS content, id % 4 AS pages FROM lib UNION ALL SELECT '/lib/new/page_' || page_id || '.html', html, 1 FROM pages),
  readable AS (SELECT file_path, regexp_extract(file_path, '([^/]+)\\.[^.]*$', 1) AS title, content, file_mtime, file_size,
    CASE WHEN file_path LIKE '%.pdf' THEN CASE WHEN length({_HEAD}) = 0 THEN 'image' WHEN length({_HEAD}) < 100 AND (coalesce(nullif(pages, 0), 1) > 1 OR length({_HEAD}) < 20) THEN 'encrypted' END END AS error
    FROM listing JOIN texts USING (file_path))"""


@query(f"""WITH {DIFF}, {READ}, d AS (SELECT * FROM diff LEFT JOIN readable USING (file_path))
  SELECT id, coalesce(CASE WHEN status = 'modified' AND error IS NULL THEN d.title END, lib.title) AS title, md5(coalesce(CASE WHEN status = 'modified' AND error IS NULL THEN d.content END, lib.content)) AS content,
    CASE WHEN error IS NULL AND (status = 'modified' OR no_mtime) THEN d.file_mtime ELSE lib.file_mtime END AS file_mtime, favorite, error IS NULL AND (status = 'modified' OR no_mtime) AS touched
  FROM lib JOIN d USING (file_path) WHERE status <> 'deleted'
  UNION ALL SELECT NULL, title, md5(content), file_mtime, 0, true FROM d WHERE status = 'new' AND error IS NULL""")
def sync_apply(spark, sf):
    docs, read, now = _docs(spark, sf), _read_files(spark, sf), F.lit("2030-01-01").cast("timestamp")
    diff = catalog.sync_diff(L.library_listing(spark, sf), docs)
    out = catalog.apply_sync(docs, diff, read.where("error is null").drop("error"), now)
    path = f"{shared_dir(spark)}/library-{uuid.uuid4().hex}"
    L.write_snapshot({"documents": out}, path)
    kept = spark.read.parquet(f"{path}/documents")
    new = F.col("file_path").startswith("/lib/new/")
    return kept.select(F.when(~new, F.col("id")).alias("id"), "title", F.md5("content").alias("content"), "file_mtime", "favorite", (F.col("updated_at") == now).alias("touched"))


@query(f"""WITH {DIFF}, {BRIDGE}, {READ}, d AS (SELECT * FROM diff LEFT JOIN readable USING (file_path)),
  gone AS (SELECT id FROM lib JOIN diff USING (file_path) WHERE status = 'deleted'), left_over AS (SELECT DISTINCT value FROM bridge WHERE document_id NOT IN (SELECT id FROM gone)),
  sources AS (SELECT DISTINCT author FROM lib WHERE id NOT IN (SELECT id FROM gone))
  SELECT count(*) FILTER (WHERE status <> 'deleted') AS total_scanned, count(*) FILTER (WHERE status = 'new' AND error IS NULL) AS new_files, count(*) FILTER (WHERE status = 'existing' AND error IS NULL) AS existing_files,
    count(*) FILTER (WHERE status = 'modified' AND error IS NULL) AS modified_files, count(*) FILTER (WHERE status = 'deleted') AS deleted_files, count(error) AS n_errors, count(error) AS pdf_failures,
    (SELECT count(DISTINCT author) FROM lib WHERE author NOT IN (FROM sources)) AS cleaned_tags, (SELECT count(DISTINCT value) FROM bridge WHERE value NOT IN (FROM left_over)) AS cleaned_keywords
  FROM (SELECT status, CASE WHEN status IN ('new', 'modified') THEN error END AS error FROM d)""")
def scan_report(spark, sf):
    docs, bridge = _docs(spark, sf), _bridge(spark, sf)
    diff = catalog.sync_diff(L.library_listing(spark, sf), docs)
    parsed = diff.where("status in ('new', 'modified')").select("file_path")
    failures = _read_files(spark, sf).where("error is not null").join(parsed, "file_path", "left_semi").select("file_path", "error")
    gone = docs.join(diff.where("status = 'deleted'"), "file_path", "left_semi").select("id")
    authors = docs.select(F.col("id").alias("document_id"), F.col("author").alias("value"))
    cleaned = []
    for pairs in (authors, bridge):
        kept = catalog.cascade_delete(docs, pairs, gone)[1]
        cleaned.append(catalog.orphans(pairs.select("value").distinct(), kept))
    return catalog.scan_report(diff, failures, *cleaned)


@query(f"""WITH {LIB}, {LISTED}, every AS (SELECT file_path, file_mtime, file_size, false AS gone FROM listing UNION ALL SELECT file_path, file_mtime, file_size, false FROM lib WHERE file_mtime IS NOT NULL
  UNION ALL SELECT file_path, file_mtime + 2, file_size, true FROM lib WHERE id % 17 = 0 AND file_mtime IS NOT NULL UNION ALL SELECT file_path, file_mtime + id % 5, file_size, false FROM lib WHERE id % 34 = 0 AND file_mtime IS NOT NULL)
  SELECT file_path, file_mtime, file_size FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY file_mtime DESC, file_size DESC, gone DESC) AS r FROM every) WHERE r = 1 AND NOT gone""")
def listing_stream(spark, sf):
    """Stored and listed rows, deletions and rows that come late or bring a file back, in several batches and a restart between."""
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = _docs(spark, sf).where("file_mtime is not null")
    known = docs.select("file_path", "file_mtime", "file_size", F.lit(False).alias("gone"))
    deleted = docs.where("id % 17 = 0").select("file_path", (F.col("file_mtime") + 2).alias("file_mtime"), "file_size", F.lit(True).alias("gone"))
    again = docs.where("id % 34 = 0").select("file_path", (F.col("file_mtime") + F.col("id") % 5).alias("file_mtime"), "file_size", F.lit(False).alias("gone"))
    for steps in ([("a", deleted), ("b", L.library_listing(spark, sf).withColumn("gone", F.lit(False)))], [("c", known), ("d", again)]):
        for name, rows in steps:
            sync.put(rows, f"{where}/in/part={name}")
        stream = spark.readStream.schema(sync.SCHEMA + ", part string").option("maxFilesPerTrigger", 3).parquet(f"{where}/in")
        sync.start(stream.drop("part"), f"{where}/table", f"{where}/checkpoint", shards=8).awaitTermination()
    return sync.current(spark, f"{where}/table")


@query(f"""WITH {LIB} SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE abstract END AS abstract, CASE WHEN id % 3 = 0 THEN title || '!' ELSE title END AS title,
  strftime(CASE WHEN id % 3 = 0 THEN TIMESTAMP '2030-01-01' ELSE updated_at END, '%Y-%m-%d %H:%M') AS updated FROM lib""")
def partial_update(spark, sf):
    docs = _docs(spark, sf)
    some = docs.where("id % 2 = 0 or id % 3 = 0")
    changes = some.select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit("abstract"), F.lit("title"))).otherwise(F.array().cast("array<string>")).alias("set_fields"), F.lit("").alias("abstract"), F.concat("title", F.lit("!")).alias("title"))
    out = catalog.partial_update(docs, changes, F.lit("2030-01-01").cast("timestamp"))
    return out.select("id", "abstract", "title", F.date_format("updated_at", "yyyy-MM-dd HH:mm").alias("updated"))


@query(f"""WITH {LIB}, t AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id)
  SELECT id, CASE WHEN n % 2 = 1 THEN 1 - favorite ELSE favorite END AS favorite, n IS NOT NULL AS touched FROM lib LEFT JOIN t ON user_id = id""")
def toggle_favorites(spark, sf):
    toggles = _given(spark, sf, "events").where("event_type = 'click'").select(F.col("user_id").alias("id"))
    out = catalog.toggle_favorites(_docs(spark, sf), toggles, F.lit("2030-01-01").cast("timestamp"))
    return out.select("id", "favorite", (F.col("updated_at") == F.lit("2030-01-01").cast("timestamp")).alias("touched"))


_PDF = "SELECT doc_id, text, doc_id % 4 AS pages FROM documents"
_GATE = "CASE WHEN length(trim(text, ' ' || chr(10))) = 0 THEN 'image' WHEN length(trim(text, ' ' || chr(10))) < 100 AND (coalesce(nullif(pages, 0), 1) > 1 OR length(trim(text, ' ' || chr(10))) < 20) THEN 'encrypted' ELSE 'ok' END"


@query(f"WITH p AS ({_PDF}) SELECT doc_id, {_GATE} AS gate FROM p")
def pdf_gate(spark, sf):
    rows = _given(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % 4).alias("pages"))
    return rows.select("doc_id", T.pdf_gate(F.col("text"), F.col("pages")).alias("gate"))


@query(f"""WITH {LIB}, p AS (SELECT 'doc_' || doc_id || '.' || ['pdf', 'md', 'exe', 'htm', 'pdf'][doc_id % 5 + 1] AS file_name, text, pages FROM ({_PDF})),
  held AS (SELECT regexp_extract(file_path, '[^/]+$') AS name FROM lib)
  SELECT file_name, CASE WHEN file_name IN (SELECT name FROM held) THEN 'exists' WHEN file_name LIKE '%.exe' THEN 'type' WHEN file_name LIKE '%.pdf' AND {_GATE} <> 'ok' THEN {_GATE} ELSE 'accept' END AS reason FROM p""")
def upload_admission(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("pdf", "md", "exe", "htm", "pdf")])
    rows = _given(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), F.get(kinds, (F.col("doc_id") % 5).cast("int"))).alias("file_name"), "text", (F.col("doc_id") % 4).alias("pages"))
    return catalog.upload_admission(rows, _docs(spark, sf)).select("file_name", "reason")


# --- retrieval ----------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
KW = f"""{ASKED}, qw AS (SELECT question_id, list_filter(list_concat(list_filter(regexp_extract_all(lower(question), '[a-z]+'), lambda w: length(w) >= 2),
    list_transform(range(1, greatest(length(rest), 1)), lambda i: substring(rest, i, 2))), lambda w: NOT list_contains({_STOP}, w)) AS ws FROM (SELECT *, regexp_replace(question, '[a-zA-Z0-9\\s]', '', 'g') AS rest FROM questions)),
  qk AS (SELECT question_id, kw, min(o) AS o FROM (SELECT question_id, unnest(ws) AS kw, unnest(range(len(ws))) AS o FROM qw) GROUP BY question_id, kw)"""


@query(f"WITH {KW} SELECT question_id, coalesce(string_agg(kw, '|' ORDER BY o), '') AS keywords FROM questions LEFT JOIN qk USING (question_id) GROUP BY question_id")
def question_keywords(spark, sf):
    return L.questions(spark, sf).select("question_id", F.array_join(T.question_keywords(F.col("question")), "|").alias("keywords"))


@query(f"""WITH {KW} SELECT question_id, CASE WHEN trim(any_value(question)) = '' THEN '' WHEN count(kw) > 0 THEN string_agg('"' || replace(kw, '"', '""') || '"', ' OR ' ORDER BY o) ELSE '"' || trim(any_value(question)) || '"' END AS fts
  FROM questions LEFT JOIN qk USING (question_id) GROUP BY question_id""")
def fts_query_text(spark, sf):
    return L.questions(spark, sf).select("question_id", T.fts_query(F.col("question")).alias("fts"))


_TOKENS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
BM = f"""{LIB}, {KW}, asked AS (SELECT question_id, token, count(*) AS times FROM (SELECT question_id, {_TOKENS.format('kw')}[1] AS token FROM qk) WHERE token IS NOT NULL GROUP BY question_id, token),
  tk AS (SELECT id, {_TOKENS.format('title')} AS tt, {_TOKENS.format('content')} AS tc FROM lib),
  st AS (SELECT count(*) AS n, avg(len(tt) + len(tc)) AS mean FROM tk),
  po AS (SELECT token, id, size, count(*) AS tf FROM (SELECT id, len(tt) + len(tc) AS size, unnest(list_concat(tt, tc)) AS token FROM tk) GROUP BY token, id, size),
  df AS (SELECT token, count(*) AS df FROM po GROUP BY token),
  ph AS (SELECT question_id, {_TOKENS.format('question')} AS ps FROM questions WHERE question_id NOT IN (SELECT question_id FROM qk)),
  pf AS (SELECT question_id, id, len(tt) + len(tc) AS size, len(list_filter(range(1, len(tt) + 1), lambda i: tt[i:i + len(ps) - 1] = ps)) + len(list_filter(range(1, len(tc) + 1), lambda i: tc[i:i + len(ps) - 1] = ps)) AS tf
    FROM ph JOIN tk ON len(ps) > 0 AND list_has_any(list_concat(tt, tc), ps)),
  found AS (SELECT question_id, id, times, df, tf, size FROM asked JOIN df USING (token) JOIN po USING (token)
    UNION ALL SELECT question_id, id, 1, count(*) OVER (PARTITION BY question_id), tf, size FROM pf WHERE tf > 0),
  primary_hits AS (SELECT question_id, id, round(-sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS rank
    FROM found, st GROUP BY question_id, id)"""
_PLACE = "row_number() OVER (PARTITION BY question_id ORDER BY rank, id) AS place"


@query(f"WITH {BM} SELECT * FROM (SELECT question_id, id, rank, {_PLACE} FROM primary_hits) WHERE place <= 5")
def bm25_top5(spark, sf):
    return search.top(search.bm25(_docs(spark, sf), L.questions(spark, sf))).select("question_id", "id", "rank", "place")


@query(f"WITH {BM} SELECT question_id FROM questions WHERE trim(question) <> '' AND question_id NOT IN (SELECT question_id FROM primary_hits)")
def fallback_questions(spark, sf):
    asked = L.questions(spark, sf)
    return search.without_hits(asked, search.answered(_docs(spark, sf), asked)).select("question_id")


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIRST = _FOLD.format("parts[1]")


def _retrieved(mode: str) -> str:
    """The cascade: full text, then hit counts for questions with keywords (``hits``) or places of the first word (``score``)."""
    counted = mode == "hits"
    own = "(SELECT list(kw ORDER BY o) FROM qk WHERE qk.question_id = questions.question_id)"
    return f"""{BM}, missed AS (SELECT question_id, coalesce({own}, list_filter(regexp_split_to_array(trim(question), '\\s+'), lambda p: p <> '')) AS parts, {own} IS NOT NULL AND {counted} AS counted FROM questions WHERE trim(question) <> '' AND question_id NOT IN (SELECT question_id FROM primary_hits)),
  low AS (SELECT id, updated_at, title AS exact, {', '.join(_FOLD.format(f"coalesce({f}, '')") + ' AS ' + f for f in search.FIELDS)} FROM lib),
  worded AS (SELECT question_id, id, updated_at, CAST(-len(list_filter(parts, lambda p: contains(concat_ws(chr(10), title, abstract, content), {_FOLD.format('p')}))) AS DOUBLE) AS rank FROM missed, low WHERE counted),
  plain AS (SELECT question_id, id, updated_at, CAST(-CASE WHEN exact = parts[1] THEN 100 WHEN starts_with(title, {_FIRST}) THEN 80 WHEN contains(title, {_FIRST}) THEN 60 WHEN contains(author, {_FIRST}) THEN 40 WHEN contains(abstract, {_FIRST}) THEN 20 WHEN contains(content, {_FIRST}) THEN 10 ELSE 0 END AS DOUBLE) AS rank
    FROM missed JOIN low ON NOT counted AND len(list_filter(parts, lambda p: contains(concat_ws(chr(10), title, author, abstract, content), {_FOLD.format('p')}))) > 0),
  every AS (SELECT question_id, id, rank, 0 AS late, 'primary' AS strategy, 'FTS5' AS algorithm FROM primary_hits UNION ALL SELECT question_id, id, rank, -epoch_us(updated_at), 'fallback', 'CHINESE_LIKE' FROM worded WHERE rank < 0
    UNION ALL SELECT question_id, id, rank, -epoch_us(updated_at), 'fallback', 'LIKE' FROM plain),
  hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank, late, id) AS place FROM every) WHERE place <= 5)"""


RETRIEVED = _retrieved("hits")


@query(f"WITH {RETRIEVED} SELECT question_id, id, rank, place, strategy, algorithm FROM hits")
def retrieve(spark, sf):
    return search.retrieve(_docs(spark, sf), L.questions(spark, sf)).select("question_id", "id", "rank", "place", "strategy", "algorithm")


@query(f"WITH {_retrieved('score')} SELECT question_id, id, rank, place, strategy, algorithm FROM hits")
def retrieve_scored(spark, sf):
    return search.retrieve(_docs(spark, sf), L.questions(spark, sf), mode="score").select("question_id", "id", "rank", "place", "strategy", "algorithm")


@query(None)
def snippets(spark, sf):
    docs, asked = _docs(spark, sf), L.questions(spark, sf)
    refs = context.references(search.retrieve(docs, asked), docs, asked, context.with_snippets)
    return refs.select("question_id", "i", "id", "snippet")


@query(f"WITH {LIB} SELECT id, CASE WHEN length(content) > 4000 THEN left(content, 4000) || chr(10) || chr(10) || '[注：已使用文档前 4000 字，共 ' || length(content) || ' 字]' ELSE content END AS prompt FROM lib")
def summary_prompts(spark, sf):
    return _docs(spark, sf).select("id", T.truncate_for_model(F.col("content")).alias("prompt"))


_SHORT = "CASE WHEN length(content) > 4000 THEN left(content, 4000) || chr(10) || chr(10) || '[注：已使用文档前 4000 字，共 ' || length(content) || ' 字]' ELSE content END"


@query(f"WITH {LIB}, t(task, head) AS (VALUES {', '.join(f"('{k}', '{v.removesuffix(chr(10) + '{content}')}')" for k, v in context.TASKS.items())}) SELECT id, task, md5(head || chr(10) || {_SHORT}) AS prompt FROM lib, t WHERE trim(content) <> ''")
def task_prompts(spark, sf):
    docs = _docs(spark, sf).where(~T.is_blank(F.col("content")))
    prompts = F.array(*[F.struct(F.lit(t).alias("task"), F.md5(context.task_prompt(t, F.col("content"))).alias("prompt")) for t in context.TASKS])
    return docs.select("id", F.explode(prompts).alias("p")).select("id", "p.task", "p.prompt")


@query(f"WITH {LIB} SELECT count(*) AS total, count(*) FILTER (WHERE trim(c) <> '') AS processed, count(*) FILTER (WHERE trim(c) <> '' AND id % 9 <> 0) AS success, count(*) FILTER (WHERE trim(c) = '' OR id % 9 = 0) AS failed FROM (SELECT id, CASE WHEN id % 10 = 3 THEN '' ELSE content END AS c FROM lib)")
def batch_outcome(spark, sf):
    docs = _docs(spark, sf).select("id", F.when(F.col("id") % 10 != 3, F.col("content")).otherwise("").alias("content"))
    asked = docs.select("id", "content", F.concat(F.col("id").cast("string"), F.lit(" "), "content").alias("prompt"))
    answered = context.map_prompts(asked, lambda ps: [None if int(p.split(" ", 1)[0]) % 9 == 0 else p[::-1] for p in ps])
    return logs.batch_outcome(answered.withColumn("error", F.when(F.col("answer").isNull(), "refused")))


@query(f"WITH {LIB} SELECT count(*) AS total, count(*) FILTER (WHERE trim(c) <> '') AS processed, count(*) FILTER (WHERE trim(c) <> '' AND id % 9 <> 0) AS success, count(*) FILTER (WHERE trim(c) <> '' AND id % 9 = 0) AS failed FROM (SELECT id, CASE WHEN id % 10 = 3 THEN '' ELSE content END AS c FROM lib)")
def summary_outcome(spark, sf):
    """Summaries asked for documents with content alone: the others are skipped."""
    docs = _docs(spark, sf).select("id", F.when(F.col("id") % 10 != 3, F.col("content")).otherwise("").alias("content"))
    asked = docs.select("id", "content", context.task_prompt("summarize", F.col("content")).alias("prompt"), (F.col("id") % 9 == 0).alias("refused"))
    answered = context.map_prompts(asked.where(~T.is_blank(F.col("content"))), lambda ps: [p[-10:] for p in ps]).unionByName(asked.where(T.is_blank(F.col("content"))).withColumn("answer", F.lit(None).cast("string")))
    return logs.batch_outcome(answered.withColumn("error", F.when(F.col("refused"), "refused")), skip_blank=True)


@query(f"""WITH {RETRIEVED} SELECT question_id, '参考资料：' || chr(10) || string_agg('[文档' || place || ']' || chr(10) || '标题：' || title || chr(10) || '内容：' || CASE WHEN length(content) > 500 THEN left(content, 500) || '...' ELSE content END || chr(10), chr(10) ORDER BY place)
    || chr(10) || chr(10) || '问题：' || any_value(question) AS prompt, string_agg('[' || place || '] ' || title, chr(10) ORDER BY place) AS doc_list FROM hits JOIN lib USING (id) JOIN questions USING (question_id) GROUP BY question_id""")
def qa_prompts(spark, sf):
    docs, asked = _docs(spark, sf), L.questions(spark, sf)
    return context.prompts(context.references(search.retrieve(docs, asked), docs, asked, context.with_cuts))


@query(None)
def local_prompts(spark, sf):
    docs, asked = _docs(spark, sf), L.questions(spark, sf)
    return context.local_prompts(context.references(search.retrieve(docs, asked), docs, asked, context.with_snippets))


AUDIT = f"""{RETRIEVED}, n AS (SELECT question_id, max(strategy) AS found, max(algorithm) AS algorithm, string_agg(hits.id, '|' ORDER BY place) AS ids, count(*) AS n,
    string_agg(place || ' ' || hits.id || ' ' || title || ' ' || length(content) || ' ' || file_path, chr(10) ORDER BY place) AS info FROM hits JOIN lib ON lib.id = hits.id GROUP BY question_id),
  b AS (SELECT question_id, question AS query, found, coalesce(ids, '') AS ids, coalesce(n, 0) AS n, coalesce(info, '') AS info, coalesce(found <> 'primary', true) AS missed, coalesce(algorithm, 'NONE') AS used FROM questions LEFT JOIN n USING (question_id) WHERE trim(question) <> ''),
  events AS (SELECT question_id, 1 AS step, 'START' AS action, query, 'FTS5' AS algorithm, question_id + 5 AS start_time, NULL AS duration_ms, NULL AS n, NULL AS ids, NULL AS strategy, NULL AS used, NULL AS reason, NULL AS info FROM b
    UNION ALL SELECT question_id, 2, 'COMPLETE', query, 'FTS5', NULL, 7, CASE WHEN missed THEN 0 ELSE n END, CASE WHEN missed THEN '' ELSE ids END, NULL, NULL, NULL, NULL FROM b
    UNION ALL SELECT question_id, 3, 'START', query, 'LIKE', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM b WHERE missed UNION ALL SELECT question_id, 4, 'COMPLETE', query, 'LIKE', NULL, NULL, n, ids, NULL, NULL, NULL, NULL FROM b WHERE missed
    UNION ALL SELECT question_id, 5, 'STRATEGY', NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN missed THEN 'FALLBACK' ELSE 'PRIMARY' END, used, CASE WHEN missed THEN 'FTS5返回空结果' ELSE 'FTS5返回有效结果' END, NULL FROM b WHERE found IS NOT NULL
    UNION ALL SELECT question_id, 6, 'FINAL', NULL, NULL, NULL, NULL, n, NULL, NULL, used, NULL, info FROM b)"""


def _audited(spark, sf):
    docs, asked = _docs(spark, sf), L.questions(spark, sf)
    timed = asked.withColumns({"start_fts": F.col("question_id") + 5, "ms_fts": F.lit(7).cast("long")})
    return context.search_audit(timed, search.retrieve(docs, asked), docs)


@query(f"WITH {AUDIT} SELECT question_id, step, action, query, algorithm, CAST(start_time AS BIGINT) AS start_time, CAST(duration_ms AS BIGINT) AS duration_ms, CAST(n AS BIGINT) AS n, ids, strategy, used, reason, info FROM events")
def search_audit(spark, sf):
    info = F.array_join(F.transform("documentInfo", lambda d: F.concat_ws(" ", d["index"], d["id"], d["title"], d["contentLength"], d["filePath"])), "\n")
    return _audited(spark, sf).select("question_id", "step", "action", "query", "algorithm", F.col("startTime").alias("start_time"), F.col("durationMs").alias("duration_ms"), F.coalesce("resultCount", "finalCount").cast("long").alias("n"), F.array_join("resultIds", "|").alias("ids"), "strategy", F.coalesce("usedAlgorithm", "sourceAlgorithm").alias("used"), F.col("fallbackReason").alias("reason"), info.alias("info"))


@query(f"WITH {AUDIT} SELECT CAST(question_id AS VARCHAR) AS search_id, action, query, algorithm, CAST(CASE WHEN action = 'COMPLETE' THEN n END AS BIGINT) AS result_count, CAST(CASE WHEN action = 'FINAL' THEN n END AS BIGINT) AS n_documents FROM events")
def search_log(spark, sf):
    """The audit written as log lines and read back."""
    rows = _audited(spark, sf).withColumns({"ts": F.lit("2024-05-01").cast("timestamp"), "searchId": F.col("question_id").cast("string")}).drop("question_id", "step")
    path = f"{shared_dir(spark)}/search-log-{uuid.uuid4().hex}"
    L.search_log_lines(rows).write.text(path)
    back = L.search_log(spark, path).where("ts = timestamp '2024-05-01'")
    return back.select(F.col("event.searchId").alias("search_id"), "event.action", "event.query", "event.algorithm", F.col("event.resultCount").cast("long").alias("result_count"), F.size("event.documentInfo").cast("long").alias("n_documents"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> ''), '|') AS items FROM documents")
def parse_list_output(spark, sf):
    return _given(spark, sf, "documents").select("doc_id", F.array_join(T.model_list(F.col("text")), "|").alias("items"))



@query("SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 3 THEN NULL ELSE trim(text, ' ' || chr(10)) END AS answer FROM conversations WHERE role = 'assistant'")
def parse_response(spark, sf):
    rows = _given(spark, sf, "conversations").where("role = 'assistant'")
    k, t = (F.col("conv_id") + F.col("turn")) % 4, F.col("text")
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices")))
    raw = F.when(k == 0, chat).when(k == 1, F.to_json(F.struct(F.struct(t.alias("text")).alias("output")))).when(k == 2, F.to_json(F.struct(t.alias("text")))).otherwise(F.to_json(F.struct(F.struct(t.alias("message")).alias("error"))))
    return rows.select("conv_id", "turn", T.answer_text(raw).alias("answer"))


@query("SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'format' WHEN 1 THEN 'json' WHEN 2 THEN 'api: ' || text WHEN 3 THEN 'format' END AS error, CASE (conv_id + turn) % 5 WHEN 4 THEN trim(text, ' ' || chr(10)) END AS answer FROM conversations WHERE role = 'assistant'")
def response_errors(spark, sf):
    rows = _given(spark, sf, "conversations").where("role = 'assistant'")
    k, t = (F.col("conv_id") + F.col("turn")) % 5, F.col("text")
    output = F.to_json(F.struct(F.struct(t.alias("text")).alias("output")))
    raw = F.when(k == 0, F.to_json(F.struct(t.alias("result")))).when(k == 1, F.concat(F.lit("<html>"), t)).when(k == 2, F.to_json(F.struct(F.struct(t.alias("message")).alias("error")))).when(k == 3, F.to_json(F.struct(t.alias("text")))).otherwise(output)
    got = T.answer(raw, output_only=True)
    return rows.select("conv_id", "turn", got["error"].alias("error"), got["text"].alias("answer"))


_CITED = "chr(10) || '[1] ' || conv_id || '.md' || chr(10) || '[2] b.txt'"


@query(f"""SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN text || chr(10) || chr(10) || '## {T.CITATION_TITLE}' || {_CITED} ELSE text || chr(10) || '## {T.CITATION_TITLE}' || {_CITED} || chr(10) || chr(10) || '## end' END AS answer
  FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN rtrim(text, ' ' || chr(10)) ELSE text END AS text FROM conversations WHERE role = 'assistant')""")
def enforce_citations(spark, sf):
    rows = _given(spark, sf, "conversations").where("role = 'assistant'")
    answer = F.when(F.col("turn") % 4 == 1, F.col("text")).otherwise(F.concat("text", F.lit(f"\n## {T.CITATION_TITLE}：\nold\n## end")))
    names = F.array(F.concat(F.col("conv_id").cast("string"), F.lit(".md")), F.lit("b.txt"))
    return rows.select("conv_id", "turn", T.enforce_citations(answer, names).alias("answer"))


# --- graph --------------------------------------------------------------------------------------


def _graph_text(spark, sf):
    docs = _docs(spark, sf)
    return docs.select("id", "title", F.when(~T.is_blank(F.col("content")), F.col("content")).otherwise(F.col("abstract")).alias("text"))


SENT = "s AS (SELECT doc_id AS id, list_filter(list_transform(regexp_split_to_array(text, '[。！？；\\n\\r.!?;]+'), lambda x: trim(x, ' ' || chr(9))), lambda x: length(x) >= 4) AS ss FROM documents)"


@query(f"WITH {SENT} SELECT id, len(ss) AS n, array_to_string(ss, '|') AS sentences FROM s")
def sentences(spark, sf):
    s = T.sentences(F.col("text"))
    return _graph_text(spark, sf).select("id", F.size(s).alias("n"), F.array_join(s, "|").alias("sentences"))


CAND = "c AS (SELECT id, word, count(*) AS freq, min(o) AS first FROM (SELECT doc_id AS id, unnest(ws) AS word, unnest(range(len(ws))) AS o FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS ws FROM documents)) GROUP BY id, word)"


@query(f"WITH {CAND} SELECT id, word, freq FROM c")
def candidate_terms(spark, sf):
    return graph.candidate_terms(_graph_text(spark, sf)).select("id", "word", "freq")


_T = "CAST(ceil(0.6 * least(length(a.word), length(one[1].word))) AS INTEGER)"
GK = f"""{CAND}, lists AS (SELECT id, list({{'word': word, 'freq': freq}} ORDER BY freq DESC, first) AS ks FROM c GROUP BY id),
  chosen AS (SELECT id, list_reduce(list_transform(ks, lambda k: [k]), lambda acc, one: CASE WHEN len(acc) >= 12 OR len(list_filter(acc, lambda a: (length(a.word) > length(one[1].word) AND contains(a.word, one[1].word))
      OR left(a.word, {_T}) = left(one[1].word, {_T}) OR right(a.word, {_T}) = right(one[1].word, {_T}))) > 0 THEN acc ELSE list_concat(acc, one) END) AS ks FROM lists),
  gk AS (SELECT id, unnest(range(1, len(ks) + 1)) AS place, unnest(ks).word AS word, unnest(ks).freq AS freq FROM chosen)"""


def _graph(spark, sf):
    """The texts with their keywords, and the keywords' rows."""
    chosen = graph.with_keywords(_graph_text(spark, sf))
    return chosen, graph.keyword_rows(chosen)


def _pairs(chosen):
    return graph.row_pairs(chosen.select("id", "text", F.array_sort(F.transform("ks", lambda k: k["word"])).alias("ws")))


@query(f"WITH {GK} SELECT id, place, word, freq FROM gk")
def graph_keywords(spark, sf):
    return graph.graph_keywords(graph.candidate_terms(_graph_text(spark, sf)))


@query(f"WITH {GK} SELECT id, place, word, freq FROM gk")
def graph_row_keywords(spark, sf):
    return _graph(spark, sf)[1]


LINKS = f"{GK}, {SENT}, u AS (SELECT id, unnest(ss) AS x FROM s), links AS (SELECT a.id, a.word AS source, b.word AS target, count(*) AS weight FROM gk a JOIN gk b ON a.id = b.id AND a.word < b.word JOIN u ON u.id = a.id AND contains(x, a.word) AND contains(x, b.word) GROUP BY ALL)"


@query(f"WITH {LINKS} SELECT * FROM links")
def graph_links(spark, sf):
    return _pairs(_graph(spark, sf)[0])


@query(f"""WITH {LINKS}, {LIB} SELECT id, source, target, weight, 'cooccurrence' AS type FROM links
  UNION ALL SELECT id, '__doc_center__', word, freq, 'keyword-link' FROM gk JOIN lib USING (id) WHERE trim(title) <> ''""")
def graph_all_links(spark, sf):
    docs, words = _graph(spark, sf)
    return graph.links(words, docs.drop("ks"), _pairs(docs))


@query(f"""WITH {GK}, {LIB}, m AS (SELECT id, max(freq) AS most FROM gk GROUP BY id)
  SELECT id, word AS node, word AS label, 'keyword' AS type, freq AS weight, 0.3::DOUBLE + 0.7::DOUBLE * freq / most AS normalized_weight FROM gk JOIN m USING (id)
  UNION ALL SELECT id, '__doc_center__', CASE WHEN length(title) > 12 THEN left(title, 12) || '...' ELSE title END, 'document', most + 2, 1.0::DOUBLE FROM m JOIN lib USING (id) WHERE trim(title) <> ''""")
def graph_nodes(spark, sf):
    docs, words = _graph(spark, sf)
    return graph.nodes(words, docs.drop("ks"))


@query(f"""WITH {LINKS}, {LIB}, k AS (SELECT id, count(*) AS n FROM gk GROUP BY id), e AS (SELECT id, count(*) AS m FROM links GROUP BY id)
  SELECT id, coalesce(n, 0) AS keyword_count, coalesce(m, 0) AS cooccurrence_edges, coalesce(m, 0) + CASE WHEN trim(title) = '' THEN 0 ELSE coalesce(n, 0) END AS edge_count, CASE WHEN n > 0 THEN len(ss) ELSE 0 END AS sentence_count
  FROM lib JOIN s USING (id) LEFT JOIN k USING (id) LEFT JOIN e USING (id)""")
def graph_stats(spark, sf):
    docs, words = _graph(spark, sf)
    return graph.stats(docs.drop("ks"), words, _pairs(docs))


# --- logs and texts -----------------------------------------------------------------------------


@query(f"WITH {CALLS} SELECT request_id, request_ms, status FROM calls WHERE request_ms >= 1704067200000 AND status = 'success' ORDER BY request_ms DESC, request_id LIMIT 100 OFFSET 20")
def log_query(spark, sf):
    return logs.query(L.calls(spark, sf), start_ms=1704067200000, status="success", offset=20, limit=100).select("request_id", "request_ms", "status")


@query(f"""WITH {CALLS} SELECT count(*) AS total_calls, count(*) FILTER (WHERE status = 'success') AS success_count, count(*) FILTER (WHERE status = 'error') AS error_count,
  CAST(floor(100.0 * count(*) FILTER (WHERE status = 'success') / count(*) + 0.5) AS BIGINT) AS success_rate, CAST(floor(avg(duration) + 0.5) AS BIGINT) AS avg_duration, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  CAST(floor(sum(total_tokens) / count(total_tokens) + 0.5) AS BIGINT) AS avg_tokens FROM calls""")
def log_stats(spark, sf):
    return logs.stats(L.calls(spark, sf))


@query(f"""WITH {CALLS}, c AS (SELECT * FROM calls ORDER BY request_ms DESC, request_id LIMIT 10000) SELECT count(*) AS total_calls, count(*) FILTER (WHERE status = 'success') AS success_count, count(*) FILTER (WHERE status = 'error') AS error_count,
  CAST(floor(100.0 * count(*) FILTER (WHERE status = 'success') / count(*) + 0.5) AS BIGINT) AS success_rate, CAST(floor(avg(duration) + 0.5) AS BIGINT) AS avg_duration, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  CAST(floor(sum(total_tokens) / count(total_tokens) + 0.5) AS BIGINT) AS avg_tokens FROM c""")
def log_stats_newest(spark, sf):
    return logs.stats(L.calls(spark, sf), newest=10_000)


def _params(spark, sf):
    """The given events as flat parameters of call-log records."""
    calls, null = L.calls(spark, sf), F.lit(None)
    i = F.col("request_id")
    failed = F.col("status") == "error"
    return calls.select(
        i.cast("string").alias("request_id"), "request_ms", F.when(i % 5 != 0, F.col("request_ms") + i % 1000).alias("response_ms"), F.when(i % 3 == 0, i % 100).cast("long").alias("duration"), F.lit("m").alias("model"), (i % 7 * 100).cast("int").alias("max_tokens"), (i % 50).cast("int").alias("prompt_length"),
        "status", F.when(failed, 500).otherwise(200).alias("status_code"), F.when(~failed, F.repeat(F.lit("x"), (i % 9).cast("int"))).alias("content"), null.cast("long").alias("prompt_tokens"), F.when(i % 4 == 1, i % 11).cast("long").alias("completion_tokens"), F.col("total_tokens"),
        F.when(failed, F.lit("bad")).alias("error_message"), F.when(failed & (i % 2 == 0), "E").alias("error_code"), F.when(i % 6 == 0, 2).alias("retry_count"),
    )


@query(f"""WITH {CALLS} SELECT CAST(request_id AS VARCHAR) AS request_id, coalesce(nullif(CASE WHEN request_id % 3 = 0 THEN request_id % 100 END, 0), CASE WHEN request_id % 5 <> 0 THEN request_id % 1000 END) AS duration,
  CASE WHEN status = 'error' THEN 0 ELSE request_id % 9 END AS content_length, CASE WHEN total_tokens IS NOT NULL OR request_id % 4 = 1 THEN coalesce(total_tokens, 0) END AS total_tokens, CASE WHEN total_tokens IS NOT NULL OR request_id % 4 = 1 THEN CASE WHEN request_id % 4 = 1 THEN request_id % 11 ELSE 0 END END AS completion_tokens,
  CASE WHEN status = 'error' THEN 'bad' END AS error_message, CASE WHEN status = 'error' AND request_id % 2 = 0 THEN 'E' END AS error_code, CASE WHEN request_id % 6 = 0 THEN 2 ELSE 0 END AS retry_count FROM calls""")
def call_log(spark, sf):
    """Records built from flat parameters, appended to a log of day folders and read back, every day of it."""
    path = f"{shared_dir(spark)}/call-log-{uuid.uuid4().hex}"
    L.append_call_log(logs.records(_params(spark, sf)), path, "gzip")
    back = L.call_log(spark, path)
    return back.select(F.col("requestId").alias("request_id"), "timestamp.duration", F.col("response.contentLength").cast("long").alias("content_length"), F.col("tokenUsage.totalTokens").alias("total_tokens"), F.col("tokenUsage.completionTokens").alias("completion_tokens"), F.col("error.message").alias("error_message"), F.col("error.code").alias("error_code"), F.col("retryCount").alias("retry_count"))


_ERRORS = [("ECONNRESET", None, None), (None, 401, None), (None, 429, None), (None, 404, None), (None, 503, None), (None, None, "SSL handshake"), (None, None, "Request timeout"), (None, None, "invalid key"), ("ODD", None, "getaddrinfo failed"), (None, None, "other")]


def _sql_value(v) -> str:
    return "NULL" if v is None else repr(v)


_BY_MESSAGE = " ".join(f"WHEN {' OR '.join(f"contains(lower(coalesce(message, '')), '{p}')" for p in ps)} THEN '{k}'" for k, ps in T.ERROR_PHRASES)
_CLASSIFIED = f"""errors AS (SELECT e.* FROM events JOIN (VALUES {', '.join(f"({k}, {', '.join(map(_sql_value, e))})" for k, e in enumerate(_ERRORS))}) e(k, code, status, message) ON event_id % 10 = k WHERE event_type = 'error'),
  classified AS (SELECT CASE {' '.join(f"WHEN code = '{c}' THEN '{k}'" for c, k in T.ERROR_CODES.items())} WHEN status IN (401, 403) THEN 'authentication' WHEN status = 429 THEN 'rate_limit' WHEN status BETWEEN 400 AND 499 THEN 'http_status' WHEN status >= 500 THEN 'api_error' {_BY_MESSAGE} ELSE 'unknown' END AS type FROM errors)"""


@query(f"""WITH {_CLASSIFIED} SELECT type, type IN ({', '.join(map(repr, T.NETWORK))}) AS network, type IN ({', '.join(map(repr, T.RETRYABLE))}) AS retryable, count(*) AS n FROM classified GROUP BY 1""")
def error_types(spark, sf):
    pick = lambda j, kind: F.get(F.array(*[F.lit(e[j]).cast(kind) for e in _ERRORS]), (F.col("event_id") % 10).cast("int"))
    rows = _given(spark, sf, "events").where("event_type = 'error'")
    counts = rows.select(T.error_type(pick(0, "string"), pick(1, "int"), pick(2, "string")).alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    return counts.select("type", T.is_network_error(F.col("type")).alias("network"), T.is_retryable(F.col("type")).alias("retryable"), "n")


@query(f"WITH {CALLS} SELECT CAST(strftime(make_timestamp(request_ms * 1000), '%Y%m%d') AS BIGINT) AS day, count(*) AS n FROM calls WHERE CAST(make_timestamp(request_ms * 1000) AS DATE) >= DATE '2024-01-31' - 10 GROUP BY 1")
def log_retention(spark, sf):
    kept = logs.retained(L.calls(spark, sf), "2024-01-31", 10)
    return kept.groupBy(F.date_format(F.timestamp_millis("request_ms"), "yyyyMMdd").cast("long").alias("day")).agg(F.count("*").alias("n"))


def _re2(pattern: str) -> str:
    return re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", pattern).replace("'", "''")


def _cleaned(column: str) -> str:
    out = f"coalesce({column}, '')"
    for pattern, to in T.CLEANING:
        to = "chr(10) || chr(10)" if to == "\n\n" else "chr(10)" if to == "\n" else "'" + to.replace("$1", "\\1") + "'"
        out = f"regexp_replace({out}, '{_re2(pattern)}', {to}, 'g')"
    return f"regexp_replace({out}, '{_re2(T.ENDS)}', '', 'g')"


@query(f"SELECT page_id, {_cleaned('html')} AS clean FROM pages")
def clean_text(spark, sf):
    return _given(spark, sf, "pages").select("page_id", T.clean_text(F.col("html")).alias("clean"))


_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array({_ESCAPED}, '\\n\\s*\\n'), lambda p: trim(p, ' ' || chr(10))), lambda p: p <> ''),
  lambda p: '<p>' || replace(p, chr(10), '<br/>') || '</p>'), '') AS html FROM documents""")
def text_to_html(spark, sf):
    return _given(spark, sf, "documents").select("doc_id", T.text_to_html(F.col("text")).alias("html"))


@query("SELECT doc_id, regexp_replace(text, '(The|the|THE|tHe|thE|THe|tHE|ThE)', '<span class=\"highlight-keyword\">\\1</span>', 'g') AS html FROM documents")
def highlight(spark, sf):
    return _given(spark, sf, "documents").select("doc_id", T.highlight(F.col("text"), F.lit("thE")).alias("html"))


@query("""WITH h AS (SELECT conv_id % 10 AS user_id, text AS question, lead(text) OVER w AS answer, lead(role) OVER w AS next_role, role, conv_id * 100 + turn AS asked FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  p AS (SELECT user_id, question, answer, row_number() OVER (PARTITION BY user_id ORDER BY asked DESC, question) AS place FROM h WHERE role = 'user' AND next_role = 'assistant' AND question <> '' AND answer <> '')
  SELECT user_id, place, question, CASE WHEN length(answer) > 100 THEN left(answer, 100) || '...' ELSE answer END AS preview FROM p WHERE place <= 50""")
def qa_history(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _given(spark, sf, "conversations").withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)}).where("role = 'user' and next_role = 'assistant'")
    return logs.newest_answers(rows.select((F.col("conv_id") % 10).alias("user_id"), F.col("text").alias("question"), "answer", (F.col("conv_id") * 100 + F.col("turn")).alias("at")))


FLAGSHIP = bm25_top5
