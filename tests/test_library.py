"""Registered queries against their SQL, and literal cases for text the given tables do not hold."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import annotate, catalog, context, fulltext, graph, logs, search
from foliant.plans import registry
from foliant.sources import library, snapshots
from foliant.streaming import sync

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "documents", "pages", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", list(registry.ORACLE))
def test_query_matches_sql(spark, con, name):
    want = con.sql(registry.ORACLE[name])
    assert plain(registry.QUERIES[name](spark, SF).select(*want.columns).collect()) == plain(want.fetchall())


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("question, want", [(None, []), ("  ", []), ("What is Deep-Learning?", ["deep", "learning", "-?"]), ("什么是智慧城市", ["么是", "是智", "智慧", "慧城", "城市"]), ("2024 7", []), ("AI ai a", ["ai"])])
def test_question_keywords(spark, question, want):
    assert value(spark, T.question_keywords(F.lit(question).cast("string"))) == want


@pytest.mark.parametrize("question, want", [(None, ""), (" ", ""), ("the", '"the"'), ("cats dogs", '"cats" OR "dogs"'), ('2 "3"', '"' * 6), ("42", '"42"')])
def test_fts_query(spark, question, want):
    assert value(spark, T.fts_query(F.lit(question).cast("string"))) == want


@pytest.mark.parametrize("text, pages, want", [(" ", 1, "image"), ("x" * 15, 1, "encrypted"), ("x" * 50, 1, "ok"), ("x" * 50, 2, "encrypted"), ("x" * 200, 9, "ok"), (None, None, "image"), ("x" * 50, 0, "ok")])
def test_pdf_gate(spark, text, pages, want):
    assert value(spark, T.pdf_gate(F.lit(text).cast("string"), F.lit(pages).cast("int"))) == want


@pytest.mark.parametrize("answer, want", [("a\n## 引用来源\nold\n## b", "a\n## 引用来源\n[1] x.md\n[2] y\n\n## b"), ("## 引用来源：\nold", "## 引用来源\n[1] x.md\n[2] y\n"), ("a  \n", "a\n\n## 引用来源\n[1] x.md\n[2] y")])
def test_citations(spark, answer, want):
    assert value(spark, T.enforce_citations(F.lit(answer), F.array(F.lit("x.md"), F.lit("y")))) == want
    assert value(spark, T.enforce_citations(F.lit(answer), F.array().cast("array<string>"))) == answer


def test_texts(spark):
    assert value(spark, T.clean_text(F.lit("# Title\n- **bold** `code` [a](b)\n\n\n\n<i>x</i>  y"))) == "Title\nbold code a\n\nx y"
    assert value(spark, T.text_to_html(F.lit("a<b\n\n 'c'\nd"))) == "<p>a&lt;b</p><p>&#39;c&#39;<br/>d</p>"
    assert value(spark, T.highlight(F.lit("A+a"), F.lit("a+"))) == '<span class="highlight-keyword">A+</span>a'
    assert value(spark, T.model_list(F.lit("a，b、 c ,,"))) == ["a", "b", "c"]
    assert value(spark, T.answer_text(F.lit('{"output": {"text": " hi "}}'))) == "hi" and value(spark, T.answer_text(F.lit("oops"))) is None
    assert value(spark, T.title_of(F.lit("/a/b.c.md"))) == "b.c" and value(spark, T.title_of(F.lit("/a/.md"))) == ".md"


def test_lexicon_on_chinese(spark):
    words = spark.createDataFrame([("计算机", 1, "CI/CD"), ("计算机", 2, "网络安全"), ("计算机", 3, "网络安全"), ("社会", 1, "城市"), ("社会", 2, "城市")], "cat_name string, kw_ord int, keyword string")
    tags = spark.createDataFrame([("计算机", 1, "编程")], "cat_name string, tag_ord int, tag string")
    docs = spark.createDataFrame([(1, "城市的网络安全和ci/cd"), (2, "无"), (3, None)], "id long, text string")
    got = {r["id"]: r for r in annotate.annotate(docs, words, tags).collect()}
    assert got[1]["category"] == "计算机" and got[1]["confidence"] == 60 and got[1]["secondary"] == ["社会"]
    assert got[1]["lexicon_keywords"][-1] == "网络安全" or "ci" in got[1]["lexicon_keywords"]
    assert got[1]["lexicon_tags"] == ["计算机", "编程", "社会"] and got[2]["category"] == got[3]["category"] == annotate.OTHER


def test_candidates_on_chinese(spark):
    docs = spark.createDataFrame([(1, "智慧城市。智慧城市建设 Smart smart"), (2, None)], "id long, text string")
    got = {r["word"]: r["freq"] for r in graph.candidate_terms(docs, ["建设"]).collect()}
    assert got["智慧城市"] == 2 and got["智慧"] == 2 and got["smart"] == 2 and "建设" not in got and "慧城" not in got
    words = [r["word"] for r in graph.graph_keywords(graph.candidate_terms(docs)).orderBy("place").collect()]
    assert words[0] == "智慧城市" and "智慧" not in words and "smart" in words


def test_retrieval_cascade(spark):
    docs = spark.createDataFrame(
        [(1, "建设", "x", None, "我国的智慧城市建设"), (2, "b", "智慧", None, "关于城市"), (3, "c", "智慧", "", "无关"), (4, "d", "y", None, "in 2024 7 came"), (5, "2024", "y", None, "7 in 2024"), (6, "e", "是", None, "z"), (7, "g", "y", None, "论城市"), (8, "Is", "是", None, "X"), (9, "智慧城市建设", None, None, None)],
        "id long, title string, author string, abstract string, content string",
    ).withColumn("updated_at", F.timestamp_seconds("id"))
    asked = spark.createDataFrame([(1, "什么是智慧城市"), (2, "2024 7"), (3, "是"), (4, None), (5, "是　is"), (6, "什么是智慧城市？")], "question_id long, question string")
    got = {}
    for r in search.retrieve(docs, asked).orderBy("question_id", "place").collect():
        assert r["algorithm"] == {"primary": "FTS5"}.get(r["strategy"], "LIKE" if r["question_id"] in (2, 3, 5) else "CHINESE_LIKE")
        got.setdefault(r["question_id"], []).append((r["id"], r["strategy"], r["rank"]))
    assert got[1] == [(9, "fallback", -3), (1, "fallback", -3), (7, "fallback", -1), (2, "fallback", -1)]  # by the number of 2-grams, then newest first; authors do not count
    assert [r[:2] for r in got[2]] == [(4, "primary")]  # as a phrase, not across title and content
    assert got[3] == [(8, "fallback", -40), (6, "fallback", -40)]  # by the place of the text itself, newest first
    assert {r[0] for r in got[5]} == {8, 6} and 4 not in got
    assert [r[0] for r in got[6]] == [9, 1, 7, 2]


def test_search_in_blocks_and_batches(spark, monkeypatch):
    docs, asked = library.documents(spark, SF), library.questions(spark, SF)
    columns = ("question_id", "id", "rank", "place", "strategy", "algorithm")
    whole = sorted(map(tuple, search.retrieve(docs, asked).select(*columns).collect()))
    index = fulltext.build(docs.unionByName(docs.limit(0)), 7)
    hits = sorted((r["question_id"], r["id"], r["rank"]) for r in fulltext.search(index, asked).collect())
    assert hits == [r[:3] for r in whole if r[4] == "primary"]
    monkeypatch.setattr(search, "ASKERS", 2)
    few = asked.limit(20)
    rows = lambda: sorted(map(tuple, search.substring_hits(docs, few).collect()))
    split = rows()
    monkeypatch.undo()
    assert split == rows()


def brute_bm25(docs, terms, k):
    sizes = [len(d) for d in docs]
    mean, out = sum(sizes) / len(docs), []
    idf = {t: max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6) for t in terms for df in [sum(t in x for x in docs)]}
    for i, d in enumerate(docs):
        s = 0.0
        for t in terms:
            tf = d.count(t)
            s += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[i] / mean))
        if any(t in d for t in terms):
            out.append((-round(s, 6), i))
    return sorted(out)[:k]


def test_bounds_spare_most_documents_a_score(spark):
    rng = np.random.default_rng(3)
    words = [["the", "of", "in"][rng.integers(3)] if rng.random() < 0.5 else f"w{letters(rng.zipf(1.3) % 4000)}" for _ in range(40 * 3000)]
    docs = [words[40 * k : 40 * k + 40] for k in range(3000)]
    asked = [[f"w{letters(j)}" for j in rng.integers(20, 1500, 3)] for _ in range(40)]
    rows = spark.createDataFrame([(i, "", " ".join(d)) for i, d in enumerate(docs)], "id long, title string, content string").repartition(3, "id")
    questions = spark.createDataFrame([(q, " ".join(t)) for q, t in enumerate(asked)], "question_id long, question string")
    index = fulltext.build(rows, 20)
    got = {}
    for r in fulltext.search(index, questions).orderBy("question_id", "rank", "id").collect():
        got.setdefault(r["question_id"], []).append((r["rank"], r["id"]))
    want = {q: brute_bm25(docs, list(dict.fromkeys(t)), 5) for q, t in enumerate(asked)}
    assert got == {q: own for q, own in want.items() if own}
    found = fulltext.weigh(index, fulltext.asked_terms(questions))
    seen = fulltext.seeds(found)
    least = spark.createDataFrame([(q, -own[-1][0]) for q, own in want.items() if len(own) == 5], "question_id long, least double")
    assert (fulltext.surviving(found, least, seen).count() + seen.count()) * 20 < 0.1 * len(docs) * len(asked)


def test_blocks_are_scored_where_they_lie(spark):
    docs, asked = library.documents(spark, SF), library.questions(spark, SF)
    index = fulltext.build(docs, 20)
    assert len(index.files) > 9 and not list((Path(index.folder)).glob("*.parquet"))
    found = fulltext.weigh(index, fulltext.asked_terms(asked))
    chunk = next(found.chunks())
    scored = fulltext.score(index, index.files, spark.sparkContext.broadcast(chunk), np.zeros(len(chunk.ids)), found.mean, 5)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()  # neither blocks nor questions are shuffled
    index.discard()
    assert not Path(index.folder).exists()


@pytest.mark.parametrize("shape", [context.with_snippets, context.with_cuts])
def test_whole_texts_are_not_sent_to_questions(spark, shape):
    docs = library.documents(spark, SF)
    asked = library.questions(spark, SF).limit(30)
    hits = asked.select("question_id", (F.abs(F.hash("question")) % 5).cast("long").alias("id"), F.lit(1).alias("place"))
    made = "snippet" if shape is context.with_snippets else "cut"
    refs = context.references(hits, docs, asked, shape)
    assert "text" not in refs.columns
    want = shape(context.references(hits, docs, asked)).select("question_id", "i", "id", "title", "name", made)
    assert plain(refs.select(*want.columns).collect()) == plain(want.collect())
    node = refs._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Window":
        node = node.children().apply(0)
    sent = node.children().apply(0).output().mkString(" ")  # what is dealt out by question
    assert made in sent and "text#" not in sent


def test_fallback_questions_need_no_scores(spark, con, monkeypatch):
    def refuse(*args):
        raise AssertionError("scored")

    monkeypatch.setattr(fulltext, "search", refuse)
    got = registry.QUERIES["fallback_questions"](spark, SF).collect()
    assert plain(got) == plain(con.sql(registry.ORACLE["fallback_questions"]).fetchall()) and got


def test_questions_in_chunks_find_the_same(spark, monkeypatch):
    docs, asked = library.documents(spark, SF), library.questions(spark, SF)
    index = fulltext.build(docs, 15)
    rows = lambda: sorted(map(tuple, fulltext.search(index, asked).collect()))
    whole = rows()
    monkeypatch.setattr(fulltext, "CHUNK_TERMS", 300)
    monkeypatch.setattr(fulltext, "GROWTH", 2)
    monkeypatch.setattr(fulltext, "MOST_DENSE", 3)
    assert rows() == whole and len(whole) > 50


def letters(n):
    return "".join(chr(97 + int(d)) for d in str(n))


def brute_fallback(docs, question, mode, k=5):
    fold = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    words = question["words"]
    parts = words or question["text"].split()
    out = []
    for d in docs:
        title, author, abstract, content = (fold(d[f]) for f in ("title", "author", "abstract", "content"))
        if words and mode == "hits":
            rank = -sum(any(fold(w) in x for x in (title, abstract, content)) for w in words)
            hit = rank < 0
        else:
            hit = any(fold(p) in x for p in parts for x in (title, author, abstract, content))
            first = fold(parts[0])
            rank = -next((s for s, yes in zip((100, 80, 60, 40, 20, 10), ((d["title"] or "") == parts[0], title.startswith(first), first in title, first in author, first in abstract, first in content), strict=True) if yes), 0)
        if hit:
            out.append((rank, -d["at"], d["id"]))
    return [(r, i) for r, _, i in sorted(out)[:k]]


@pytest.mark.parametrize("mode", ["hits", "score"])
def test_fallback_against_brute_force(spark, mode):
    rng = np.random.default_rng(11)
    text = lambda n: "".join(rng.choice(list("智慧城市建设 aAbBéÉ\U0001f600"), n))
    docs = [{"id": k, "title": text(6), "author": text(3), "abstract": text(8) if k % 3 else None, "content": text(30), "at": int(rng.integers(9))} for k in range(150)]
    docs += [{"id": 150, "title": "建设", "author": "", "abstract": "", "content": "", "at": 3}, {"id": 151, "title": None, "author": None, "abstract": None, "content": None, "at": 3}]
    asked = [text(int(rng.integers(1, 9))) for _ in range(25)] + ["7", "2024 7", "建设", "是 A", "智"]
    rows = spark.createDataFrame([tuple(d.values()) for d in docs], "id long, title string, author string, abstract string, content string, at long").withColumn("updated_at", F.timestamp_seconds("at"))
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id long, question string")
    words = {r["question_id"]: r["w"] for r in questions.select("question_id", T.question_keywords(F.col("question")).alias("w")).collect()}
    got = {}
    for r in search.substring_hits(rows, questions, mode=mode).orderBy("question_id", "rank", "late", "id").collect():
        got.setdefault(r["question_id"], []).append((r["rank"], r["id"]))
    want = {q: brute_fallback(docs, {"words": words[q], "text": t}, mode) for q, t in enumerate(asked) if words[q] or t.split()}
    assert got == {q: own for q, own in want.items() if own}


def test_search_without_documents_or_questions(spark):
    docs, asked = library.documents(spark, SF), library.questions(spark, SF)
    assert search.retrieve(docs.limit(0), asked).count() == 0 and search.retrieve(docs, asked.limit(0)).count() == 0


def brute_snippet(content, words):
    best = []
    for pos in range(0, len(content), 5):
        window = content[max(0, pos - 400) : pos + 400].lower()
        score = sum(window.count(w) for w in words)
        if score:
            best.append((-score, pos))
    return sorted(best)


def test_snippets():
    body = "x" * 900 + " key key " + "y" * 2000 + " key " + "z" * 900
    got = context.best_snippet(body, ["KEY", "yyyyaa"])
    first = brute_snippet(body, ["key", "yyyyaa"])[0][1]
    assert got.startswith(context.BEFORE + body[first - 400 : first + 400]) and got.count(context.BETWEEN) == 1
    assert context.best_snippet("abc" * 400, []) == ("abc" * 400)[:800] and context.best_snippet("abc", ["q"]) == "abc" and context.best_snippet(None, ["q"]) == ""
    assert "aaaa" in context.best_snippet("b" * 1000 + "aaaaa" + "b" * 1000, ["aa"])


def test_updates_and_metamorphic(spark):
    docs = library.documents(spark, SF)
    same = docs.select("file_path", F.coalesce("file_mtime", F.lit(0)).alias("file_mtime"), "file_size")
    assert {r["status"] for r in catalog.sync_diff(same, docs).select("status").distinct().collect()} == {"existing"}
    twice = docs.select("id").unionByName(docs.select("id"))
    assert catalog.toggle_favorites(docs, twice, F.current_timestamp()).select("id", "favorite").exceptAll(docs.select("id", "favorite")).count() == 0
    pages = [r["id"] for k in range(0, 60, 20) for r in catalog.page(docs, k, 20).collect()]
    assert pages == [r["id"] for r in catalog.page(docs, 0, 60).collect()]
    assert catalog.outside_path(docs, "/").count() in (0, docs.count()) and catalog.outside_path(docs, "").count() == 0


def test_files_and_logs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("été".encode() + b"\xff")
    (tmp_path / "sub/b.TXT").write_text("b")
    (tmp_path / "c.exe").write_text("c")
    assert sorted(r["file_path"].rsplit("/")[-1] for r in library.listing(spark, str(tmp_path)).collect()) == ["a.md", "b.TXT"]
    assert {r["file_path"].rsplit("/")[-1]: r["content"] for r in library.contents(spark, str(tmp_path)).collect()} == {"a.md": "été�", "b.TXT": "b"}
    log = tmp_path / "calls.jsonl"
    log.write_text('{"requestId": "1", "timestamp": {"request": 1704067200000}, "response": {"status": "success"}}\n\nbroken\n')
    calls = library.call_log(spark, str(log))
    assert [r["requestId"] for r in calls.collect()] == ["1"]
    library.append_call_log(calls, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["date"].isoformat() == "2024-01-01"
    (tmp_path / "s.log").write_text('[2024-01-01T00:00:00.000Z] {"action": "START", "query": "q"}\nnoise\n')
    assert library.search_log(spark, str(tmp_path / "s.log")).first()["event"]["action"] == "START"
    assert logs.stats(library.calls(spark, SF).limit(0)).first()["total_calls"] == 0


def test_model_calls(spark):
    got = context.map_prompts(spark.createDataFrame([(1, "a")], "id long, prompt string"), lambda ps: [p.upper() for p in ps])
    assert got.first()["answer"] == "A"


def test_streaming_sync(spark, tmp_path):
    source, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))

    def run(rows, checkpoint=check, **options):
        if rows:
            spark.createDataFrame(rows, sync.SCHEMA).coalesce(1).write.mode("append").parquet(source)
        sync.start(spark.readStream.schema(sync.SCHEMA).parquet(source), table, checkpoint, shards=16, **options).awaitTermination()
        return sorted(map(tuple, sync.current(spark, table).collect()))

    assert run([("a", 1, 1, False), ("b", 1, 1, None), ("a", 3, 2, False), (None, 1, 1, False)]) == [("a", 3, 2), ("b", 1, 1)]
    first = snapshots.manifest(spark, table)
    assert run([("a", 2, 9, False), ("c", 1, 1, False), ("b", 1, 1, True)]) == [("a", 3, 2), ("c", 1, 1)]  # late, new, deleted
    assert run([("b", 0, 5, False), ("c", 4, 4, True), ("c", 5, 5, False)]) == [("a", 3, 2), ("c", 5, 5)]  # behind its tombstone, brought back
    # shards without changes keep their files
    parts = lambda m: m.tables[sync.TABLE]["parts"]
    now, names = parts(snapshots.manifest(spark, table)), {r[0]: str(r[1]) for r in spark.createDataFrame([("a",), ("b",), ("c",)], "p string").select("p", snapshots.shard("p", 16)).collect()}
    assert names["a"] not in (names["b"], names["c"]) and now[names["a"]] == parts(first)[names["a"]]
    # a lost checkpoint is refused, or repaired: rows that are read again change nothing
    with pytest.raises(sync.LostCheckpoint):
        run([], str(tmp_path / "other"))
    assert ("a", 3, 2) in run([("d", 1, 1, False)], str(tmp_path / "other"), repair=True) and ("c", 5, 5) in run([], str(tmp_path / "other"))


def test_listing_rows_lie_in_few_files(spark, tmp_path):
    rows = spark.range(400, numPartitions=40).select(F.concat(F.lit("p"), "id").alias("file_path"), F.col("id").alias("file_mtime"), F.lit(1).cast("long").alias("file_size"), F.lit(False).alias("gone"))
    sync.put(rows, str(tmp_path / "in"))
    assert len(list((tmp_path / "in").glob("part-*"))) < 10 and spark.read.parquet(str(tmp_path / "in")).count() == 400


def test_snapshots_switch_at_once(spark, tmp_path):
    folder = str(tmp_path / "library")
    docs = spark.range(20).select("id", F.concat(F.lit("t"), "id").alias("title"))
    words = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, value string")
    commit = snapshots.Commit(spark, folder)
    commit.put("documents", docs, "id", 4)
    commit.put("document_keywords", words, "document_id", 4)
    assert snapshots.manifest(spark, folder).version == 0 and commit.done() == 1
    before = snapshots.manifest(spark, folder)
    # a run that dies between its tables leaves the snapshot before
    dead = snapshots.Commit(spark, folder)
    dead.put("documents", docs.limit(0), "id", 4)
    assert snapshots.read(spark, folder, "documents").count() == 20
    assert snapshots.upsert(spark, folder, "documents", spark.createDataFrame([(3, "new"), (77, "more")], "id long, title string"), "id") == 2
    with pytest.raises(RuntimeError):
        dead.done()
    got = {r["id"]: r["title"] for r in snapshots.read(spark, folder, "documents").collect()}
    assert got == {k: f"t{k}" for k in range(20)} | {3: "new", 77: "more"} and snapshots.read(spark, folder, "document_keywords").count() == 2
    after, touched = snapshots.manifest(spark, folder), {r[0] for r in spark.createDataFrame([(3,), (77,)], "id long").select(snapshots.shard("id", 4)).collect()}
    same = {k for k in before.tables["documents"]["parts"] if after.tables["documents"]["parts"][k] == before.tables["documents"]["parts"][k]}
    assert same == {k for k in before.tables["documents"]["parts"] if int(k) not in touched}
    assert snapshots.read(spark, folder, "documents", before).where("id = 3").first()["title"] == "t3"


def test_hidden_and_mixed_case_files_are_listed_and_read(spark, tmp_path):
    names = ["_n.md", ".h.md", "_sub/e.md", ".git2/f.md", "c.Md", "g.hTml", "deep/er/x.TXT", "p.PDF", "no.exe", "_SUCCESS", "plain"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    (tmp_path / "shut").mkdir()
    (tmp_path / "shut/y.md").write_text("y")
    (tmp_path / "shut").chmod(0)
    try:
        listed = {r["file_path"]: r["file_size"] for r in library.listing(spark, str(tmp_path)).collect()}
        read = {r["file_path"]: r["content"] for r in library.contents(spark, f"file://{tmp_path}").collect()}
    finally:
        (tmp_path / "shut").chmod(0o755)
    want = {str(tmp_path / n): len(n) for n in names[:8]}
    assert {p: n for p, n in listed.items() if "/shut/" not in p} == want
    assert {p: c for p, c in read.items() if "/shut/" not in p} == {str(tmp_path / n): n for n in names[:7]}
    assert library.listing(spark, str(tmp_path / "missing")).count() == 0


def test_sync_leaves_documents_without_path_alone(spark):
    docs = library.documents(spark, SF).where("id < 6").withColumn("file_path", F.when(F.col("id") == 0, None).when(F.col("id").isin(1, 2), "/lib/same.md").otherwise(F.col("file_path")))
    listing = spark.createDataFrame([("/lib/same.md", 99, 9), ("/lib/same.md", 98, 9), (None, 1, 1)], "file_path string, file_mtime long, file_size long")
    diff = {r["file_path"]: r["status"] for r in catalog.sync_diff(listing, docs).collect()}
    assert len(diff) == 4 and None not in diff and diff["/lib/same.md"] == "modified" and sorted(diff.values()) == ["deleted"] * 3 + ["modified"]
    read = listing.select("file_path", F.lit("T").alias("title"), F.lit("c").alias("content"), F.lit("text").alias("file_type"), "file_mtime", "file_size")
    got = sorted((r["id"], r["title"]) for r in catalog.apply_sync(docs, catalog.sync_diff(listing, docs), read, F.current_timestamp()).collect())
    assert [r[0] for r in got] == [0, 1, 2] and got[1][1] == got[2][1] == "T" and got[0][1] != "T"


def test_no_pair_is_left_out(spark):
    words = sorted(f"w{letters(k)}x" for k in range(150))
    docs = spark.createDataFrame([(1, " ".join(words))], "id long, text string")
    keys = spark.createDataFrame([(1, w) for w in words], "id long, word string")
    pairs = graph.cooccurrence(docs, keys)
    want = {(a, b): 1 for i, a in enumerate(words) for b in words[i + 1 :]}
    assert {(r["source"], r["target"]): r["weight"] for r in pairs.collect()} == want and len(want) == 11_175
    many = spark.range(1505).select(F.lit(1).alias("document_id"), F.format_string("k%05d", "id").alias("value"))
    assert annotate.corpus_graph(many).count() == 1505 * 1504 // 2
    long = spark.createDataFrame([(1, ". ".join(f"the {'cat' if k % 2 else 'dog'} {'sun' if k % 3 else 'moon'}" for k in range(200)))], "id long, text string")
    got = {(r["source"], r["target"]): r["weight"] for r in graph.cooccurrence(long, spark.createDataFrame([(1, w) for w in ("cat", "dog", "sun", "moon")], "id long, word string")).collect()}
    assert got == {("cat", "sun"): 67, ("dog", "sun"): 66, ("cat", "moon"): 33, ("dog", "moon"): 34}


def test_large_lexicons_are_joined(spark, monkeypatch):
    docs = library.documents(spark, SF).select("id", F.col("content").alias("text")).withColumn("lang", F.when(F.col("id") % 2 == 0, "x").otherwise("y"))
    lexicon = annotate.corpus_lexicon(docs)
    columns = ["id", "lexicon_keywords", "lexicon_tags", "category", "secondary", "confidence"]
    small = sorted(map(str, annotate.annotate(docs, *lexicon).select(*columns).collect()))
    monkeypatch.setattr(annotate, "MAX_ENTRIES", 10)
    assert sorted(map(str, annotate.annotate(docs, *lexicon).select(*columns).collect())) == small


def test_accents_and_blanks_beyond_latin1(spark):
    fold = lambda s: value(spark, T.fold_tokens(F.lit(s)))
    assert fold("Łódź Šimon ŐÚ e\u0301clair éclair Œuvre") == ["łodz", "simon", "ou", "eclair", "eclair", "œuvre"]
    assert fold("ế Ελλάδα") == ["ế", "ελλάδα"]
    assert value(spark, T.text_to_html(F.lit("a\n\u3000\nb"))) == "<p>a</p><p>b</p>"
    assert value(spark, T.enforce_citations(F.lit("a\n## 引用来源：\u3000\nold"), F.array(F.lit("x")))) == "a\n## 引用来源\n[1] x\n"


def test_paragraphs(spark):
    docs = spark.createDataFrame([(1, "A sun, a Moon\n\u3000\nsun\n\nmoon stars SUN"), (2, None)], "id long, text string")
    bridge = spark.createDataFrame([(1, w) for w in ("Sun", "moon", "stars")] + [(2, "sun")], "document_id long, value string")
    assert {(r["k1"], r["k2"]): r["weight"] for r in annotate.paragraph_graph(docs, bridge).collect()} == {("Sun", "moon"): 2, ("Sun", "stars"): 1, ("moon", "stars"): 1}


def test_audit_events_are_whole(spark):
    docs = library.documents(spark, SF).where("id < 3")
    asked = spark.createDataFrame([(1, "q one", 5, 7, "boom"), (2, "q two", None, None, None), (3, " ", 1, 1, None)], "question_id long, question string, start_fts long, ms_fts long, error_fts string")
    hits = spark.createDataFrame([(2, 2, 1, "primary", "FTS5"), (2, 0, 2, "primary", "FTS5"), (1, 1, 1, "fallback", "LIKE")], "question_id long, id long, place int, strategy string, algorithm string")
    got = {}
    for r in context.search_audit(asked, hits, docs).orderBy("question_id", "step").collect():
        got.setdefault(r["question_id"], []).append(r)
    assert [r["step"] for r in got[1]] == [1, 2, 3, 4, 5, 6] and [r["step"] for r in got[2]] == [1, 2, 5, 6] and 3 not in got
    assert got[1][0]["startTime"] == 5 and got[1][1]["error"] == "boom" and got[1][1]["resultIds"] == [] and got[1][1]["durationMs"] == 7 and got[1][3]["resultIds"] == [1]
    assert (got[1][4]["usedAlgorithm"], got[1][4]["fallbackReason"]) == ("LIKE", "FTS5返回空结果") and got[2][2]["fallbackReason"] == "FTS5返回有效结果"
    assert [(d["index"], d["id"]) for d in got[2][3]["documentInfo"]] == [(1, 2), (2, 0)] and got[2][3]["documentInfo"][0]["filePath"] and got[2][3]["finalCount"] == 2


def test_paths_outside_a_base(spark):
    docs = spark.createDataFrame([(1, r"C:\Users\a.md"), (2, r"C:\Users_other\b.md"), (3, "/lib/a"), (4, "/lib_other/b"), (5, None), (6, r"c:\USERS\x\y.md")], "id long, file_path string")
    ids = lambda base: sorted(r["id"] for r in catalog.outside_path(docs, base).collect())
    assert ids(r"C:\Users") == ids("C:\\Users\\") == [2, 3, 4] and ids("/LIB/") == [1, 2, 4, 6]


def test_updates_take_one_change_and_drop_falsy_values(spark):
    docs = library.documents(spark, SF).where("id in (5, 10)")
    changes = spark.createDataFrame([(5, ["year", "title"], 0, "first", 1), (5, ["year", "title"], 0, "second", 2), (5, ["year"], 1999, "third", 0)], "id long, set_fields array<string>, year int, title string, at long")
    got = {r["id"]: r for r in catalog.partial_update(docs, changes, F.current_timestamp(), "at").collect()}
    assert len(got) == 2 and got[5]["year"] is None and got[5]["title"] == "second" and got[10]["year"] == 2010
    viewed = spark.createDataFrame([(10, ["last_viewed"])], "id long, set_fields array<string>").withColumn("last_viewed", F.lit(None).cast("timestamp"))
    assert catalog.partial_update(docs, viewed, F.current_timestamp()).where("id = 10 and last_viewed is null").count() == 1


def test_white_space_and_case_beyond_ascii(spark):
    assert value(spark, T.question_keywords(F.lit("智慧\u3000城市"))) == ["智慧", "慧城", "城市"]
    assert value(spark, T.highlight(F.lit("École école"), F.lit("ÉCOLE"))).count("highlight-keyword") == 2


def test_sync_is_applied(spark):
    now = F.lit("2030-01-01").cast("timestamp")
    docs = library.documents(spark, SF).where("id in (4, 11, 13, 20, 21)")
    listing = docs.where("id <> 13").select("file_path", F.when(F.col("id").isin(4, 20), F.col("file_mtime") + 1).otherwise(F.coalesce("file_mtime", F.lit(77))).alias("file_mtime"), "file_size")
    listing = listing.unionByName(spark.createDataFrame([("/new/a.md", 1, 1), ("/new/bad.pdf", 1, 1)], listing.schema))
    broken = docs.where("id = 20").first()["file_path"]
    read = listing.where(~F.col("file_path").isin(broken, "/new/bad.pdf")).select("file_path", F.lit("T").alias("title"), F.lit("").alias("content"), F.lit("text").alias("file_type"), "file_mtime", "file_size")
    old = {r["id"]: r for r in docs.collect()}
    got = {r["id"] if not r["file_path"].startswith("/new") else r["file_path"]: r for r in catalog.apply_sync(docs, catalog.sync_diff(listing, docs), read, now).collect()}
    assert set(got) == {4, 11, 20, 21, "/new/a.md"}
    assert got[4]["title"] == "T" and got[4]["content"] is None and got[4]["file_mtime"] == 4001 and got[4]["favorite"] == old[4]["favorite"]
    assert got[11]["file_mtime"] == 77 and got[11]["title"] == old[11]["title"] and got[20] == old[20] and got[21] == old[21]
    assert got["/new/a.md"]["favorite"] == 0 and got["/new/a.md"]["author"] is None


def test_local_prompts(spark):
    ask = lambda q, docs="[1] a": value(spark, context.local_prompt(F.lit(q), F.lit("$& {question} body"), F.lit(docs)))
    plain = ask("哪里不好 {docsList}")
    assert "$& {question} body" in plain and "哪里不好 {docsList}" in plain and "[1] a" in plain and context.DETAIL_NOTE in plain
    assert context.SUMMARY_NOTE in ask("具体总结") and context.DETAIL_NOTE not in ask("具体总结") and "特殊指令" not in ask("hi")
    assert context.NO_DOCUMENTS in ask("hi", "")
    assert value(spark, context.task_prompt("tags", F.lit("{content}"))).endswith("\n{content}")


def test_responses(spark):
    got = lambda raw, **o: tuple(value(spark, T.answer(F.lit(raw), **o)))
    assert got('{"choices": [{"message": {"content": " a "}}]}') == ("a", None) and got('{"text": "b"}') == ("b", None)
    assert got('{"text": "b"}', output_only=True) == (None, "format") and got('{"output": {"text": "c"}}', output_only=True) == ("c", None)
    assert got('{"error": {"message": "no"}}') == (None, "api: no") and got("<html>") == (None, "json") and got("{}") == (None, "format")


def test_han_words_at_the_ends_of_runs(spark):
    docs = spark.createDataFrame([(1, "中国"), (2, "é中国人é中国"), (3, "中国人民，民主"), (4, "a中国")], "id long, text string")
    got = {(r["id"], r["word"]): r["freq"] for r in graph.candidate_terms(docs).collect()}
    assert got[(1, "中国")] == 1 and (2, "中国") not in got and got[(3, "中国")] == 1 and (3, "国人") not in got and got[(3, "人民")] == 1 and got[(3, "民主")] == 1 and got[(4, "中国")] == 1


def test_keywords_chosen_in_the_row_are_those_of_the_tables(spark):
    rng = np.random.default_rng(5)
    parts = ["智慧城市", "城市建设", "，", "。", " ", "abc", "abcd", "Smart", "é", "a", "1", "中国人民", "\n", "人", "İx"]
    docs = spark.createDataFrame([(k, "".join(rng.choice(parts, int(rng.integers(0, 30))))) for k in range(120)] + [(500, None), (501, "")], "id long, text string")
    for stop in ([], ["城市", "abc"]):
        want = sorted(map(tuple, graph.graph_keywords(graph.candidate_terms(docs, stop), 7).collect()))
        chosen = graph.with_keywords(docs, stop, 7)
        assert sorted(map(tuple, graph.keyword_rows(chosen).collect())) == want


def test_kept_days_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "log")
    entry = "named_struct('request', cast(19723 + id as bigint) * 86400000, 'response', null, 'duration', null) as timestamp"
    library.append_call_log(spark.range(5).selectExpr("cast(id as string) as requestId", entry), path)  # from 2024-01-01
    files = lambda: {str(p.relative_to(path)) for p in (tmp_path / "log").rglob("*.json")}
    before = files()
    assert logs.drop_old_days(spark, path, "2024-01-05", 2) == ["date=2024-01-01", "date=2024-01-02"]
    kept = files()
    assert kept == {f for f in before if f[:15] > "date=2024-01-02"} and library.call_log(spark, path).count() == 3
    library.replace_days(spark.range(3, 4).selectExpr("'new' as requestId", entry), path)
    assert {f for f in files() if "date=2024-01-04" not in f} == {f for f in kept if "date=2024-01-04" not in f}
    assert sorted(r["requestId"] for r in library.call_log(spark, path).collect()) == ["2", "4", "new"]


def test_call_log_gives_back_every_call(spark, tmp_path):
    ts = "case event_id % 4 when 0 then ts when 1 then ts - interval 20 days when 2 then ts - interval 130 years end"
    duckdb.sql(f"copy (select * replace ({ts} as ts) from '{SF}/events.parquet') to '{tmp_path}/events.parquet'")
    given = sorted(str(x) for (x,) in duckdb.sql(f"select event_id from '{SF}/events.parquet'").fetchall())
    assert sorted(r["request_id"] for r in registry.QUERIES["call_log"](spark, str(tmp_path)).collect()) == given
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert sorted(r[0] for r in c.sql(f"select request_id from ({registry.ORACLE['call_log']})").fetchall()) == given


def test_compressed_files_join_a_plain_log(spark, tmp_path):
    path = str(tmp_path / "log")
    entry = "named_struct('request', cast(19723 + id % 3 as bigint) * 86400000, 'response', null, 'duration', null) as timestamp"
    library.append_call_log(spark.range(6).selectExpr("cast(id as string) as requestId", entry), path)
    library.append_call_log(spark.range(6, 12).selectExpr("cast(id as string) as requestId", entry), path, "gzip")
    assert len(list((tmp_path / "log/date=2024-01-01").glob("*.json"))) and len(list((tmp_path / "log/date=2024-01-01").glob("*.json.gz")))
    assert sorted(int(r["requestId"]) for r in library.call_log(spark, path).collect()) == list(range(12))


@pytest.mark.parametrize("name", ["snippets", "local_prompts"])
def test_queries_without_sql(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    docs = {r["id"]: r["content"] for r in library.documents(spark, SF).collect()}
    asked = {r["question_id"]: r["w"] for r in library.questions(spark, SF).select("question_id", T.question_keywords(F.col("question")).alias("w")).collect()}
    assert len(rows) > 50
    for r in rows[:20] if name == "snippets" else []:
        best, body = brute_snippet(docs[r["id"]], [w.lower() for w in asked[r["question_id"]]]), docs[r["id"]]
        first = best[0][1] if best else 400
        assert body[max(first - 400, 0) : first + 400] in r["snippet"]
