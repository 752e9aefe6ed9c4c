"""The corpus pipeline, stage by stage, against brute force on the rows that each stage was given."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from test_text_ops import brute_components, brute_lines

import corpus_pipeline
from foliant.llm import crf, queries, toxicity
from foliant.llm.textblocks import blocks

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def sha256_of(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(model, texts):
    out = []
    for t in texts:
        batch = pa.RecordBatch.from_arrays([pa.array([t], pa.large_string())], ["text"])
        raw = [crf.raw_quality(model.weights, model.moves, *crf.line_features(d, at)) for _, _, d, at in blocks(batch, "text")]
        out.append(float(1 / (1 + np.exp(-(model.scale * raw[0][0] + model.shift)))))
    return out


def test_stages_match_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, given = spark.read.parquet(f"{SF}/documents.parquet"), {}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        given[name] = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    names = given["toxicity"].columns
    assert all(d.columns == names for d in given.values())

    rows = rows_of(given["toxicity"])
    toxic = toxicity.scores(toxicity.fit(given["toxicity"], labels), [t for _, t in rows], {})
    rows = [r for r, s in zip(rows, toxic, strict=True) if s < toxicity.THRESHOLD]
    assert sorted(rows_of(given["quality_classifier"])) == sorted(rows)

    good = quality(crf.fit(given["quality_classifier"], labels), [t for _, t in rows])
    rows = [r for r, s in zip(rows, good, strict=True) if s >= crf.THRESHOLD]
    assert 0 < len(rows) < len(toxic) and sorted(rows_of(given["line_dedup"])) == sorted(rows)

    cut = rows_of(given["minhash_near_dedup"])
    texts = {(n[0], n[3]) for n in brute_lines(rows)}
    assert {(i, sha256_of(t)) for i, t in cut} == texts and len(cut) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in given["minhash_near_dedup"].collect())

    groups = brute_components(cut)
    left = rows_of(given["best_fit_packing"])
    assert sorted(left) == sorted(r for r in cut if groups[r[0]][1] == r[0])

    library, want = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json")), []
    for i, t in left:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k // 2048, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())) for k in range(0, len(ids), 2048) for own in [ids[k : k + 2048]]]
    assert sorted(tuple(r)[:5] for r in docs.collect()) == sorted(want)


def test_pipeline_keeps_clean_documents(spark):
    """At sf0.01, with few labelled toxic documents: most toxic ones go, nearly all clean ones stay, and rows come out."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    marked = labels.join(docs.select("doc_id"), "doc_id").collect()
    clean, toxic = ({r["doc_id"] for r in marked if r["toxic"] == k} for k in (0, 1))
    assert len(kept & clean) >= 0.95 * len(clean) and len(kept & toxic) <= 0.4 * len(toxic)
    good = {r["doc_id"] for r in marked if r["quality"] == 1}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_poor(spark, docs, sf).select("doc_id").collect()}
    assert len(kept & good) >= 0.95 * len(good)
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() > 600


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing names; and empty tables."""
    base = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows = [*base, base[0], (None, base[1][1]), (9001, None), (9002, ""), (9003, "word " * 80_000), (9004, "line one of many\n" * 20), (9005, "\n\n")]
    docs = spark.createDataFrame([(i, t, None if k % 3 else "en", "clash", k, 0.5, None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, kept_text string, n_lines int, score double, n_chars long")
    labels = spark.read.parquet(f"{SF}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int"), allowMissingColumns=True)
    for name, d, marks in (("odd", docs, labels), ("none", docs.limit(0), labels), ("unlabelled", docs, labels.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        given = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, given, f"{tmp_path}/{name}").write.parquet(f"{tmp_path}/{name}/{stage_name}")
            given = spark.read.parquet(f"{tmp_path}/{name}/{stage_name}")
            assert given.columns == docs.columns and [f.dataType for f in given.schema] == [f.dataType for f in docs.schema]
        packed = corpus_pipeline.pack(spark, given, f"{tmp_path}/{name}").collect()
        assert len({r["doc_id"] for r in packed}) == given.select("doc_id").distinct().count()
        assert (len(packed) == 0) == (name == "none")
