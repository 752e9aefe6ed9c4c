"""Listings, relations and row updates of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.numbering import numbered

NULL_WHEN_EMPTY = ["author", "abstract", "content", "file_path", "file_type"]
NULL_WHEN_FALSY = ["year", "last_viewed"]


def page(docs: DataFrame, offset: int, limit: int, where: Column | None = None) -> DataFrame:
    """One page, newest first; many or deep pages are read from a ``page_directory``."""
    rows = docs if where is None else docs.where(where)
    return rows.orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit)


def page_directory(docs: DataFrame) -> DataFrame:
    """``docs`` with ``number``, each one's place newest first, from 0. Numbers come from a range sort and counts per task, so rows
    of a page lie together in one or two tasks' files once it is written, for any page to be read without sorting again."""
    return numbered(docs, F.desc("updated_at"), "id")


def page_of(directory: DataFrame, page: int, size: int = 15) -> DataFrame:
    """A page of a ``page_directory``, however deep: a range of numbers, which files' statistics answer."""
    return directory.where((F.col("number") >= page * size) & (F.col("number") < (page + 1) * size)).orderBy("number")


def outside_path(docs: DataFrame, base: str) -> DataFrame:
    """Documents with a path not below ``base``, whose own separator counts; an empty base selects none."""
    separator = "\\" if "\\" in base and "/" not in base else "/"
    base = base.rstrip("/\\")
    if not base:
        return docs.limit(0)
    return docs.where(F.col("file_path").isNotNull() & ~F.lower("file_path").startswith(base.lower() + separator))


def by_ids(docs: DataFrame, ids: list[int]) -> DataFrame:
    """Documents with one of ``ids``; the filter reaches the scan."""
    return docs.where(F.col("id").isin(ids))


def loaded_pages(*pages: DataFrame) -> DataFrame:
    """Pages read one after another, each document once though pages may overlap."""
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["id"])


def health(docs: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """One row: documents, those with content, abstract and anything to index; with a (value) dictionary, its size."""
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    indexed = F.size(T.fold_tokens(F.concat_ws(" ", "title", "content"))) > 0
    out = docs.agg(F.count("*").alias("total"), F.count_if(filled("content")).alias("with_content"), F.count_if(filled("abstract")).alias("with_abstract"), F.count_if(indexed).alias("indexed"))
    return out if tags is None else out.join(F.broadcast(tags.agg(F.countDistinct("value").alias("n_tags"))), F.lit(True))  # one row


def with_relations(docs: DataFrame, bridge: DataFrame, name: str) -> DataFrame:
    """``docs`` with the sorted array of their ``bridge`` (document_id, value) values, [] when none."""
    lists = bridge.groupBy("document_id").agg(F.array_sort(F.collect_set("value")).alias(name))
    out = docs.join(lists, docs["id"] == lists["document_id"], "left").drop("document_id")
    return out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def with_any(docs: DataFrame, bridge: DataFrame, value: str) -> DataFrame:
    return docs.join(bridge.where(F.col("value") == value), docs["id"] == F.col("document_id"), "left_semi")


def with_all(docs: DataFrame, bridge: DataFrame, values: list[str]) -> DataFrame:
    held = bridge.where(F.col("value").isin(values)).groupBy("document_id").agg(F.countDistinct("value").alias("n")).where(F.col("n") == len(set(values)))
    return docs.join(held, docs["id"] == held["document_id"], "left_semi")


def add_to_dictionary(known: DataFrame, values: DataFrame) -> DataFrame:
    """(id, value) with the unknown non-blank values added, in their order, numbered on from the greatest id without gaps.
    Numbers come from counts per task, not from one task; known ids stay, so a second upsert changes nothing."""
    new = values.select(T.js_trim(F.col("value")).alias("value")).where("value <> ''").distinct().join(known.select("value"), "value", "left_anti")
    last = known.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    return known.unionByName(numbered(new, "value").select((F.col("number") + last + 1).alias("id"), "value"))


def add_to_bridge(bridge: DataFrame, new: DataFrame) -> DataFrame:
    """``bridge`` (document_id, value) with the new pairs that it does not hold, as a model's analysis adds them."""
    return bridge.unionByName(new).distinct()


def replace_in_bridge(bridge: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    """``bridge`` with the pairs of the documents ``ids`` (id) replaced by ``new``, as after a changed file."""
    gone = ids.select(F.col("id").alias("gone")).distinct()
    return bridge.join(gone, bridge["document_id"] == gone["gone"], "left_anti").unionByName(new).distinct()


def orphans(values: DataFrame, bridge: DataFrame) -> DataFrame:
    return values.join(bridge, "value", "left_anti")


def cascade_delete(docs: DataFrame, bridge: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select(F.col("id").alias("gone")).distinct()
    return docs.join(gone, docs["id"] == gone["gone"], "left_anti"), bridge.join(gone, bridge["document_id"] == gone["gone"], "left_anti")


def partial_update(docs: DataFrame, changes: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    """Apply ``changes`` (id, set_fields, new values): only named fields change, '' (for the year: 0) becomes null
    where the library stores no empty value, and updated_at moves only when something was supplied.
    Of several changes for one id the one with the greatest ``order`` counts, by default the greatest row."""
    fields = [c for c in changes.columns if c not in ("id", "set_fields", order)]
    row = F.struct("set_fields", *fields)
    changes = changes.groupBy("id").agg(F.max_by(row, F.struct(order, row) if order else row).alias("row")).select("id", "row.*")
    new = changes.select(F.col("id").alias("n_id"), "set_fields", *[F.col(f).alias(f"n_{f}") for f in fields])
    out = docs.join(new, docs["id"] == F.col("n_id"), "left")
    for f in fields:
        falsy = F.col(f"n_{f}").cast("string").isin("", "0")
        value = F.nullif(F.col(f"n_{f}"), F.lit("")) if f in NULL_WHEN_EMPTY else F.when(~falsy, F.col(f"n_{f}")) if f in NULL_WHEN_FALSY else F.coalesce(F.col(f"n_{f}"), F.lit(0)) if f == "favorite" else F.col(f"n_{f}")
        out = out.withColumn(f, F.when(F.array_contains("set_fields", f), value).otherwise(F.col(f)))
    return out.withColumn("updated_at", F.when(F.size("set_fields") > 0, now).otherwise(F.col("updated_at"))).select(*docs.columns)


def toggle_favorites(docs: DataFrame, toggles: DataFrame, now: Column) -> DataFrame:
    """A document toggled an odd number of times changes; any number touches updated_at."""
    n = toggles.groupBy(F.col("id").alias("t_id")).agg(F.count("*").alias("times"))
    out = docs.join(n, docs["id"] == n["t_id"], "left")
    flipped = F.when(F.coalesce("favorite", F.lit(0)) == 0, 1).otherwise(0)
    return out.withColumn("favorite", F.when(F.col("times") % 2 == 1, flipped).otherwise(F.col("favorite"))).withColumn("updated_at", F.when(F.col("times").isNotNull(), now).otherwise(F.col("updated_at"))).select(*docs.columns)


def upload_admission(uploads: DataFrame, docs: DataFrame) -> DataFrame:
    """``uploads`` (file_name, text, pages) with the first rule that rejects each, or 'accept'."""
    held = docs.select(T.basename(F.col("file_path")).alias("held")).distinct()
    ext = T.extension(F.col("file_name"))
    gate = T.pdf_gate(F.col("text"), F.col("pages"))
    reason = F.when(F.col("held").isNotNull(), "exists").when(~ext.isin("pdf", "md", "markdown", "doc", "docx", "txt", "html", "htm"), "type").when((ext == "pdf") & (gate != "ok"), gate).otherwise("accept")
    return uploads.join(held, uploads["file_name"] == held["held"], "left").withColumn("reason", reason).drop("held")


def sync_diff(listing: DataFrame, docs: DataFrame, check_modified: bool = True) -> DataFrame:
    """(file_path, status, back_fill) of a full outer join on the path, a row per path: new, modified, existing or deleted. Documents
    without a path have no file and take no part. Of several documents of one path the one with the greatest id counts, of several
    listed rows the newest."""
    a = listing.where("file_path is not null").groupBy(F.col("file_path").alias("l_path")).agg(F.max(F.struct("file_mtime", "file_size")).alias("l"))
    b = docs.where("file_path is not null").groupBy(F.col("file_path").alias("d_path")).agg(F.max_by(F.struct("file_mtime", "file_size"), "id").alias("d"))
    changed = F.col("l.file_mtime").isNotNull() & F.col("d.file_mtime").isNotNull() & ((F.col("l.file_mtime") != F.col("d.file_mtime")) | ~F.col("l.file_size").eqNullSafe(F.col("d.file_size"))) & F.lit(check_modified)
    status = F.when(F.col("d_path").isNull(), "new").when(F.col("l_path").isNull(), "deleted").when(changed, "modified").otherwise("existing")
    out = a.join(b, F.col("l_path") == F.col("d_path"), "full").select(F.coalesce("l_path", "d_path").alias("file_path"), status.alias("status"), F.col("d.file_mtime").isNull().alias("no_mtime"))
    return out.select("file_path", "status", ((F.col("status") == "existing") & F.col("no_mtime")).alias("back_fill"))


def apply_sync(docs: DataFrame, diff: DataFrame, read: DataFrame, now: Column) -> DataFrame:
    """The library after a sync: rows of deleted files go, those of modified ones take what was ``read``
    (file_path, title, content, file_type, file_mtime, file_size) and keep the rest, existing ones without sync
    metadata take mtime and size alone, new files become rows, and documents without a path stay as they are. Ids of new rows are
    hashes of their path; of several rows of ``read`` for one path the greatest counts.
    A file that could not be read has no row in ``read``: a modified one stays as it was, a new one is left out."""
    taken = ["title", "content", "file_type", "file_mtime", "file_size"]
    read = read.where("file_path is not null").groupBy("file_path").agg(F.max(F.struct(*taken)).alias("r")).select("file_path", "r.*")
    got = read.select(F.col("file_path").alias("r_path"), *[F.col(c).alias(f"r_{c}") for c in taken])
    kept = docs.join(diff.where("status <> 'new'").select("file_path", "status", "back_fill"), "file_path", "left")
    kept = kept.where("file_path is null or status <> 'deleted'")
    kept = kept.join(got, F.col("file_path") == F.col("r_path"), "left")
    whole = (F.col("status") == "modified") & F.col("r_path").isNotNull()
    meta = whole | (F.col("back_fill") & F.col("r_path").isNotNull())
    for c in taken:
        value = F.nullif(F.col(f"r_{c}"), F.lit("")) if c in NULL_WHEN_EMPTY else F.col(f"r_{c}")
        kept = kept.withColumn(c, F.when(F.coalesce(meta, F.lit(False)) if c.startswith("file_m") or c == "file_size" else F.coalesce(whole, F.lit(False)), value).otherwise(F.col(c)))
    kept = kept.withColumn("updated_at", F.when(meta, now).otherwise(F.col("updated_at"))).select(*docs.columns)
    new = diff.where("status = 'new'").select("file_path").join(read, "file_path")
    fresh = {"id": F.xxhash64("file_path"), "updated_at": now, "favorite": F.lit(0), **{c: F.nullif(F.col(c), F.lit("")) if c in NULL_WHEN_EMPTY else F.col(c) for c in ("file_path", *taken)}}
    return kept.unionByName(new.select(*[fresh.get(c, F.lit(None)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]))


def scan_report(diff: DataFrame, failures: DataFrame, cleaned_tags: DataFrame, cleaned_keywords: DataFrame) -> DataFrame:
    """One row about a sync: counts by outcome, and what was cleaned up. ``failures`` (file_path, error) are
    files that could not be read; they count as errors alone, and as PDF failures where the error says so."""
    of = lambda s: F.count_if((F.col("status") == s) & F.col("error").isNull())
    seen = diff.join(failures, "file_path", "left").agg(
        F.count_if(F.col("status") != "deleted").alias("total_scanned"), of("new").alias("new_files"), of("existing").alias("existing_files"), of("modified").alias("modified_files"),
        F.count_if(F.col("status") == "deleted").alias("deleted_files"), F.count("error").alias("n_errors"), F.count_if(F.col("error").isin("image", "encrypted")).alias("pdf_failures"),
    )
    for name, values in (("cleaned_tags", cleaned_tags), ("cleaned_keywords", cleaned_keywords)):
        seen = seen.join(F.broadcast(values.agg(F.count("*").alias(name))), F.lit(True))  # one row
    return seen
