"""Library tables from files, logs and the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.sources.scratch import settle

SUPPORTED = [".pdf", ".md", ".doc", ".docx", ".txt", ".html"]
CALL_LOG = (
    "requestId string, timestamp struct<request: long, response: long, duration: long>, request struct<model: string, maxTokens: int, promptLength: int>, "
    "response struct<status: string, statusCode: int, contentLength: int>, tokenUsage struct<promptTokens: long, completionTokens: long, totalTokens: long>, "
    "error struct<message: string, code: string>, retryCount int"
)


ENTRIES = "path string, folder boolean, file_mtime long, file_size long"


def open_at(folder: str) -> tuple[str, str]:
    """(what a path in the store is put behind to name it again, the folder's path in its store)."""
    from pyarrow import fs

    path = fs.FileSystem.from_uri(folder)[1] if "://" in folder or folder.startswith("file:") else folder.rstrip("/") or "/"
    return ("" if "://" not in folder or folder.startswith("file:") else folder[: folder.index(path)]), path


def store_of(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root + "/")[0] if root else fs.LocalFileSystem()


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """(path, folder, file_mtime, file_size) of everything below a folder, hidden names too. Folders are listed in tasks, a round for
    each level of depth, and each round's entries are written; folders that can't be read are skipped."""
    root, top = open_at(folder)

    def expand(batches):
        import pyarrow as pa
        from pyarrow import fs

        store = store_of(root)
        for b in batches:
            for at in b.column(0).to_pylist():
                try:
                    found = store.get_file_info(fs.FileSelector(at))
                except OSError:
                    continue
                own = [f for f in found if f.type in (fs.FileType.File, fs.FileType.Directory)]
                columns = [pa.array([f.path for f in own], pa.string()), pa.array([f.type == fs.FileType.Directory for f in own], pa.bool_()), pa.array([f.mtime_ns // 1_000_000 if f.mtime_ns is not None else None for f in own], pa.int64()), pa.array([f.size for f in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ENTRIES.split(", ")])

    found, frontier = spark.createDataFrame([], ENTRIES), spark.createDataFrame([(top,)], "path string")
    while not frontier.isEmpty():
        level = settle(frontier.repartition("path").mapInArrow(expand, ENTRIES), "entries")
        found, frontier = found.unionByName(level), level.where("folder").select("path")
    return found.withColumn("path", F.concat(F.lit(root), "path"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, file_mtime, file_size) of supported files below a folder, in any case of their names; contents are not read."""
    files = walk(spark, folder).where(~F.col("folder"))
    kept = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(SUPPORTED))
    return kept.select(F.col("path").alias("file_path"), "file_mtime", "file_size")


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, content) of text files, broken UTF-8 replaced; a file that can't be read has no row. Only so many bytes are
    in a task's memory as its longest file has."""
    root, _ = open_at(folder)

    def read(batches):
        import pyarrow as pa

        store = store_of(root)
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    with store.open_input_stream(path[len(root) :]) as f:
                        held = f.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([held], pa.binary())], ["file_path", "raw"])

    texts = listing(spark, folder).where(F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1)).isin(".md", ".txt", ".html"))
    read_ = texts.select("file_path").repartition("file_path").mapInArrow(read, "file_path string, raw binary")
    return read_.select("file_path", F.make_valid_utf8(F.col("raw").cast("string")).alias("content"))


def call_log(spark: SparkSession, path: str) -> DataFrame:
    """Model-call log; blank and malformed lines are dropped."""
    return spark.read.schema(CALL_LOG).option("mode", "DROPMALFORMED").json(path)


def append_call_log(entries: DataFrame, path: str, compression: str = "none") -> None:
    """One folder a day, by request time; a log may hold files of several compressions."""
    day = F.to_date(F.timestamp_millis(F.col("timestamp.request")))
    entries.withColumn("date", day).write.mode("append").partitionBy("date").json(path, compression=compression)


def replace_days(entries: DataFrame, path: str) -> None:
    """Write the days that ``entries`` hold anew, each as one; other days keep their files."""
    day = F.to_date(F.timestamp_millis(F.col("timestamp.request")))
    entries.withColumn("date", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").json(path)


def search_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, event) of lines ``[time] {json}``."""
    event = (
        "searchId string, action string, algorithm string, query string, startTime long, resultCount int, durationMs long, error string, resultIds array<long>, strategy string, usedAlgorithm string, "
        "fallbackReason string, finalCount int, sourceAlgorithm string, documentInfo array<struct<index: int, id: long, title: string, contentLength: int, filePath: string>>"
    )
    line = spark.read.text(path).select(F.regexp_extract("value", r"^\[([^\]]+)\]", 1).alias("at"), F.regexp_extract("value", r"^\[[^\]]+\] (\{.*)$", 1).alias("json"))
    return line.where("json <> ''").select(F.try_to_timestamp("at").alias("ts"), F.from_json("json", event).alias("event"))


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Write the library's tables (documents, dictionaries, bridges) as one snapshot, a subfolder each. A
    snapshot that is read while the next one is made needs another folder."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def search_log_lines(events: DataFrame) -> DataFrame:
    """(value): lines ``[time] {json}`` of events (ts and any other columns), to be written as text."""
    names = [c for c in events.columns if c != "ts"]
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return events.select(F.concat(F.lit("["), at, F.lit("] "), F.to_json(F.struct(*names))).alias("value"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given documents in the library's shape; same expressions as ``LIBRARY_SQL``."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(x) for x in ("md", "txt", "html", "pdf", "doc", "docx")])
    path = F.concat(F.lit("/lib/"), "source", F.lit("/doc_"), i.cast("string"), F.lit("."), F.get(kinds, (i % 6).cast("int")))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=i.cast("int"))
    return d.select(
        i.alias("id"), F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"), F.col("source").alias("author"), (2000 + i % 25).cast("int").alias("year"),
        F.when(i % 3 == 0, F.substring("text", 1, 150)).when(i % 3 == 1, "").alias("abstract"), F.col("text").alias("content"), path.alias("file_path"), T.file_type(path).alias("file_type"),
        at.alias("updated_at"), (i % 7 == 0).cast("int").alias("favorite"), F.when(i % 5 == 0, at + F.expr("interval 1 day")).alias("last_viewed"),
        F.when(i % 11 != 0, i * 1000).alias("file_mtime"), F.col("n_chars").alias("file_size"),
    )


LIBRARY_SQL = """lib AS (SELECT doc_id AS id, left(string_split(text, chr(10))[1], 60) AS title, source AS author, CAST(2000 + doc_id % 25 AS INTEGER) AS year,
  CASE doc_id % 3 WHEN 0 THEN left(text, 150) WHEN 1 THEN '' END AS abstract, text AS content,
  '/lib/' || source || '/doc_' || doc_id || '.' || ['md','txt','html','pdf','doc','docx'][doc_id % 6 + 1] AS file_path,
  ['markdown','text','html','pdf','doc','docx'][doc_id % 6 + 1] AS file_type,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS updated_at, CAST(doc_id % 7 = 0 AS INTEGER) AS favorite,
  CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' + to_minutes(doc_id) END AS last_viewed,
  CASE WHEN doc_id % 11 <> 0 THEN doc_id * 1000 END AS file_mtime, n_chars AS file_size FROM documents)"""


def library_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later listing of the library: some files gone, some changed, and a new one per page."""
    docs = documents(spark, sf_dir)
    old = docs.where("id % 13 <> 0").select("file_path", F.when(F.col("id") % 4 == 0, F.coalesce("file_mtime", F.lit(0)) + 1).otherwise(F.coalesce("file_mtime", F.col("id") * 1000)).alias("file_mtime"), "file_size")
    new = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("/lib/new/page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), (F.col("page_id") * 1000).alias("file_mtime"), F.length("html").cast("long").alias("file_size"))
    return old.unionByName(new)


LISTING_SQL = """listing AS (SELECT file_path, CASE WHEN id % 4 = 0 THEN coalesce(file_mtime, 0) + 1 ELSE coalesce(file_mtime, id * 1000) END AS file_mtime, file_size FROM lib WHERE id % 13 <> 0
  UNION ALL SELECT '/lib/new/page_' || page_id || '.html', page_id * 1000, length(html) FROM pages)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    fixed = spark.createDataFrame([(-1, "2024 7"), (-2, "what is the"), (-3, "  "), (-4, "hanedb lyabl ousandt"), (-5, "什么是智慧城市？")], asked.schema)
    return asked.unionByName(fixed)


QUESTIONS_SQL = """questions AS (SELECT conv_id * 1000 + turn AS question_id, text AS question FROM conversations WHERE role = 'user'
  UNION ALL VALUES (-1, '2024 7'), (-2, 'what is the'), (-3, '  '), (-4, 'hanedb lyabl ousandt'), (-5, '什么是智慧城市？'))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given events as a model-call log."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    failed = F.col("event_type") == "error"
    return e.select(F.col("event_id").alias("request_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("request_ms"), F.when(F.col("event_type") != "view", F.col("value")).alias("duration"), F.when(failed, "error").otherwise("success").alias("status"), F.when(F.col("event_type") != "signup", F.get_json_object("props", "$.k").cast("long")).alias("total_tokens"), "event_type")


CALLS_SQL = """calls AS (SELECT event_id AS request_id, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS request_ms, CASE WHEN event_type <> 'view' THEN value END AS duration,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, CASE WHEN event_type <> 'signup' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS total_tokens, event_type FROM events)"""
