"""Operators on texts against brute force, and their edge cases."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.llm import crf, labelled, line_dedup, minhash, packing, quality_rules, queries, sp_codec, toxicity
from foliant.llm.components import components

SF = "/root/testdata/sf0.001"
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
COPY = " ".join(f"word{k}" for k in range(60))
EDGE = [
    (1, None, "a"), (2, "", "a"), (3, "one two", "b"), (4, "one two", None), (5, COPY, "b"), (6, COPY.upper(), "b"), (7, COPY + " tail", "c"),
    (8, "same line of text\nother\r\n\nsame line of text", "c"), (9, " SAME line of text\t\nmine", "c"), (10, "é" * 9 + "\nÉtude über alles, ja\n" + "x" * 50_000, "d"), (10, "é" * 9, "d"), (None, "same line of text", "e"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 7.0) for i, t, s in rows], "doc_id long, text string, source string, score string, length double")


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark, EDGE)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lower(text):
    return text.translate({k: k + 32 for k in range(65, 91)})


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WHITE.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_group(n, seed=3):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(120)]
    out = []
    for k in range(n):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 9)):
            words[at] = f"x{rng.integers(0, 10**6)}"
        out.append((1000 + k, " ".join(words)))
    return out


def boilerplate(n, seed=11):
    """Texts that share about two thirds of a common passage: far from links, but many meet in tables."""
    rng = np.random.default_rng(seed)
    base = [f"b{k}" for k in range(100)]
    return [(5000 + k, " ".join(w for a in range(0, 100, 20) for w in (base[a : a + 20] if rng.random() < 0.75 else [f"u{k}x{a + j}" for j in range(20)]))) for k in range(n)]


def test_candidates_hold_pairs_near_the_threshold(spark):
    """Pairs at Jaccard 0.75 to 0.8 share a table, each pair by itself."""
    rows, pairs = [], 600
    for k in range(pairs):
        words = [f"p{k}w{j}" for j in range(104)]
        other = [*words[:90], *[f"q{k}w{j}" for j in range(14)]]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = minhash.signatures(docs).select(F.col("doc_id").alias("rep"), "slots")
    edges, _ = minhash.candidate_edges(signed)
    assert edges.where("b = a - 1 and a % 2 = 1").select("a").distinct().count() >= pairs - 3


@pytest.mark.parametrize(("block", "shingles"), [(256, 1_000_000), (16, 1_000_000), (256, 2000)])
def test_boilerplate_links_match_all_pairs(spark, block, shingles, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
    rows = boilerplate(150) + near_group(60, 5)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


@pytest.mark.parametrize(("seed", "block"), [(3, minhash.BLOCK), (4, 16)])
def test_near_duplicates_match_all_pairs(spark, corpus, seed, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = [(r["doc_id"], r["text"]) for r in corpus.limit(150).collect()] + near_group(320, seed)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_edges(spark, edge):
    got = {(r["doc_id"], r["component_id"], r["n_shingles"]) for r in minhash.near_duplicates(edge).collect()}
    assert {(1, 1, 0), (2, 2, 0), (3, 3, 1), (4, 3, 1), (5, 5, 56), (6, 5, 56), (7, 5, 57), (None, None, 1)} <= got
    kept = minhash.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "5", "8", "9", "10", "10", "None"])


def brute_lines(rows):
    held = {}
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect()), key=str)


def test_line_dedup_matches_brute_force(spark, edge, corpus):
    assert digest(line_dedup.dedup(edge)) == brute_lines([(i, t) for i, t, _ in EDGE])
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    assert digest(line_dedup.dedup(corpus)) == brute_lines(rows)
    assert "score" in line_dedup.dedup(edge).columns


def test_line_dedup_is_reversible(spark, corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]
    one, two = [r for r in rows if r[0] % 3], [r for r in rows if not r[0] % 3]
    as_df = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    state = line_dedup.insert(line_dedup.insert(None, as_df(one)), as_df(two))
    assert digest(line_dedup.rewrite(as_df(rows), line_dedup.resolve(state))) == brute_lines(rows)
    state = line_dedup.delete(state, as_df(two))
    assert digest(line_dedup.rewrite(as_df(one), line_dedup.resolve(state))) == brute_lines(one)


def filter_keys(state):
    """Shared keys by the exact counts, and whether their shard's filter holds each."""
    tables = {r["shard"]: line_dedup.CuckooFilter(np.frombuffer(r["table"], np.uint16).reshape(-1, line_dedup.SLOTS)) for r in state.filters.collect()}
    keyed = line_dedup._shared(state.counts).select("key", line_dedup._shard_column(state.shards).alias("shard")).collect()
    return [bool(tables[r["shard"]].contains(line_dedup._as_words([bytes(r["key"])]))[0]) for r in keyed], sum(int((t.table > 0).sum()) for t in tables.values())


@pytest.mark.parametrize(("keys", "references"), [(16, 50), (1 << 16, 1 << 20)])
def test_line_dedup_changes_filters_in_place(spark, corpus, keys, references, monkeypatch):
    """Small shards that fill up and are dealt anew, and one large shard: same lines, and filters hold the shared keys alone."""
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", keys)
    monkeypatch.setattr(line_dedup, "REFERENCES_PER_PART", references)
    rows = [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]
    as_df = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    state, held = None, []
    for k in range(4):
        part = [r for r in rows if r[0] % 4 == k] + held[:3]  # a few rows come twice
        state, held = line_dedup.insert(state, as_df(part)), held + [r for r in rows if r[0] % 4 == k]
        inside, prints = filter_keys(state)
        assert all(inside) and prints == len(inside)
    assert digest(line_dedup.rewrite(as_df(rows), line_dedup.resolve(state))) == brute_lines(rows)
    state = line_dedup.delete(state, as_df([r for r in rows if r[0] % 4 == 1]))
    inside, prints = filter_keys(state)
    left = [r for r in rows if r[0] % 4 != 1]
    assert all(inside) and prints == len(inside)
    assert digest(line_dedup.rewrite(as_df(left), line_dedup.resolve(state))) == brute_lines(left)


def test_line_dedup_keeps_clashing_columns(spark):
    rows = [(1, "a line that repeats", 7, "x"), (2, "a line that repeats\nmine", 8, "y"), (None, None, 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_lines int, Kept_Text string")
    got = line_dedup.dedup(docs)
    assert got.columns == ["doc_id", *line_dedup.ADDED, "n_lines_input", "Kept_Text_input"]
    assert sorted((r["n_lines_input"], r["kept_text"], r["Kept_Text_input"], r["n_dropped"]) for r in got.collect()) == [(7, "a line that repeats", "x", 0), (8, "mine", "y", 1), (9, "", "z", 0)]
    same = line_dedup.drop_repeated_lines(docs)
    assert same.columns == docs.columns and same.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted(map(tuple, same.where("doc_id is not null").collect())) == [(1, "a line that repeats", 7, "x"), (2, "mine", 8, "y")]


def test_cuckoo_filter_has_no_false_negatives():
    keys = np.random.default_rng(1).integers(0, 2**63, (3000, 2)).astype(np.uint64)
    held = line_dedup.CuckooFilter.sized(2000)
    assert held.insert(keys[:2000]) and held.contains(keys[:2000]).all()
    assert held.contains(keys[2000:]).mean() < 0.02
    held.delete(keys[:1000])
    assert held.contains(keys[1000:2000]).all() and held.contains(keys[:1000]).mean() < 0.02


def test_quality_rules_on_edges(spark, edge):
    got = quality_rules.with_ledger(edge)
    assert got.count() == len(EDGE) and set(edge.columns) <= set(got.columns)
    by = {(r["doc_id"], r["text"]): r for r in got.collect()}
    assert by[(1, None)]["q_n_words"] == 0 and by[(8, EDGE[7][1])]["q_n_dup_lines"] == 1
    text = "a b c d e f g h i a b c d e f g h z"
    row = quality_rules.with_ledger(frame(spark, [(1, text, "s")])).first()
    assert row["q_n_repeat_words"] == 16
    row = quality_rules.with_ledger(frame(spark, [(1, "a " * 12, "s")])).first()
    assert row["q_n_repeat_words"] == 12


def test_ablations_match_counts(spark, corpus):
    ledger = quality_rules.with_ledger(corpus).cache()
    rows = [r["q_failed_bits"] for r in ledger.collect()]
    mask = quality_rules.mask_of(quality_rules.POLICIES["v2"])
    for r in quality_rules.ablations(ledger, "v2").collect():
        bit = quality_rules.mask_of([r["rule"]])
        assert r["only_this"] == sum(1 for b in rows if b & mask == bit)
        assert r["failed"] == sum(1 for b in rows if b & bit) and r["kept_without"] == sum(1 for b in rows if not b & mask & ~bit)


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_packing_is_a_partition_into_sequences(spark, corpus):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    extra = [(9001, None), (9002, ""), (9003, "It's 3 DÉJÀ-vu... <|endoftext|> ǅ ẞ fi\u0301n a\u00a0b"), (9004, "x y " * 3000), (9004, "z"), (9005, "Tail, more. end.,. ...!! a*b*** #$%&x ?!"), (9006, "\u0130stanbul \u0149a \u017ft \u01c5.,"), (9007, "a\tb\r\nc  "), (9008, "don't we'll, you're. 'tis x's,"), (9009, "<|x <|startoftext|> a"), (9010, "A\u030a \u212b x\u0301. <|"), (9011, "<|endoftext|>"), (9012, "q " * 60_000)]
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()] + extra
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    library = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k // 2048, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())) for k in range(0, len(ids), 2048) for own in [ids[k : k + 2048]]]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 2048
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 2048) * 1.02 + 1


def test_plan_keeps_every_count():
    rng = np.random.default_rng(2)
    histogram = {int(k): int(n) for k, n in zip(rng.integers(1, 65, 40), rng.integers(1, 200, 40), strict=True)}
    slots = packing.plan(histogram, 64)
    load = {}
    for length in histogram:
        ranks = sorted(r for n, first, number, _, _ in slots if n == length for r in range(first, first + number))
        assert ranks == list(range(histogram[length]))
    for n, _, number, sequence, offset in slots:
        for s in range(sequence, sequence + number):
            load.setdefault(s, []).append((offset, n))
    for own in load.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 64


def test_sentencepiece_matches_library(spark, corpus):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(r["doc_id"], r["text"]) for r in corpus.limit(40).collect()] + [(9001, None), (9002, ""), (9003, " a  b\t\u2581 \U0001f600 中文 e\u0301\n\n")]
    for r in sp_codec.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, with_output=True).collect():
        text = dict(rows)[r["doc_id"]] or ""
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["decoded"] == library.decode(ids) and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["spans_cover"], text
        raw, spans = text.encode(), np.array(r["spans"]).reshape(-1, 2)
        pieces = [library.id_to_piece(i) for i in ids]
        for p, (a, b) in list(zip(pieces, spans, strict=True))[2:-1]:
            assert p.startswith("<0x") or raw[a:b].decode() == p.replace("\u2581", " ") or "\u2581" in text


def _piece(text, kind):
    body = b"\x0a" + bytes([len(text.encode())]) + text.encode() + b"\x15\x00\x00\x00\x00\x18" + bytes([kind])
    return b"\x0a" + bytes([len(body)]) + body


@pytest.mark.parametrize("squeeze", [True, False])
def test_models_with_a_character_map_match_the_library(squeeze):
    """The library's own compiled map and user-defined symbols, on the given pieces."""
    import sentencepiece

    made = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    with open(queries.tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        given = f.read()
    own = b"".join(field for number, _, field in sp_codec._fields(given) if number != 3)
    model = own + _piece("\ufb01\u2460", 4) + _piece("<keep>", 4) + made.serialized_model_proto()
    codec, library = sp_codec.Codec.of(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    assert len(codec.spec.char_map) > 100_000 and len(codec.spec.kept) == 2
    rng = np.random.default_rng(5)
    parts = ["\uff76\uff9e", "\u2460", " ", "  ", "x", "\ufb01", "e\u0301", "\ufb01\u2460", "<keep>", "\u3000", "\t", "\n", "\U0001f600", "\u4e2d", "Abc", "\u00ad", "\u2581", ".", "\u1e9b\u0323"]
    texts = ["", " ", "a", "  \uff76\uff9e\u2460  x \ufb01 e\u0301 "] + ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(300)]
    ids, spans = codec.encode([t.encode() for t in texts])
    for t, i, s in zip(texts, ids, spans, strict=True):
        assert i == library.encode(t, add_bos=True, add_eos=True), repr(t)
        assert len(s) == len(i) and (s[:, 0] <= s[:, 1]).all() and (s[1:, 0] == s[:-1, 1]).all() and (not len(t) or s[-1, 1] == len(t.encode()))
    _, spans = codec.encode(["q <keep>\uff76\uff9ez".encode()])
    cut = ["q <keep>\uff76\uff9ez".encode()[a:b] for a, b in spans[0]]
    assert b"<keep>" in cut


def test_spans_of_unknown_pieces():
    """A model without bytes to fall back on: unknown characters have spans too."""
    pieces = _piece("<unk>", 2) + _piece("<s>", 3) + _piece("</s>", 3) + b"".join(_piece(p, 1) for p in ("\u2581", "a", "b", "ab"))
    trainer = b"\x12\x02\x18\x02"  # byte pairs
    codec = sp_codec.Codec.of(pieces + trainer + b"\x1a\x0c\x0a\x08identity\x20\x00")
    raw = "ab\u4e2d\u6587 b\u00e9".encode()
    ids, spans = codec.encode([raw])
    assert 0 in ids[0] and b"".join(raw[a:b] for a, b in spans[0]) == raw
    assert raw[slice(*spans[0][ids[0].index(0)])].decode() in ("\u4e2d", "\u4e2d\u6587")


def test_longest_prefix_normalisation_keeps_sources():
    spec = sp_codec.Spec({b"a": b"A", b"ab": b"xyz", "é".encode(): b"e"}, True, True, True)
    text, places = sp_codec.normalise("ab  é a".encode(), spec)
    assert text.decode() == "▁xyz▁e▁A"
    assert places.tolist() == [0] * 3 + [0, 0, 0] + [2] * 3 + [4] + [6] * 3 + [7] + [8]


def test_classifiers_hold_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for query, label, least in ((queries.op3_toxicity, "toxic", 0.95), (queries.op9_quality_classifier, "quality", 0.98)):
        rows = query(spark, sf).where("held_out").join(labels, "doc_id").select("predicted", label, "score").collect()
        assert len(rows) > 300 and all(0 <= r["score"] <= 1 for r in rows)
        assert sum(r["predicted"] == r[label] for r in rows) / len(rows) > least


@pytest.mark.parametrize(("sf", "caught", "false_alarms"), [("sf0.001", 0.5, 0.15), ("sf0.01", 0.6, 0.05), ("sf0.1", 0.9, 0.03)])
def test_toxicity_separates_at_every_size(spark, sf, caught, false_alarms):
    sf = f"/root/testdata/{sf}"
    rows = queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    by = {y: [r for r in rows if r["toxic"] == y] for y in (0, 1)}
    assert len({r["score"] for r in rows}) > len(rows) / 2
    assert np.mean([r["predicted"] for r in by[1]]) >= caught and np.mean([r["predicted"] for r in by[0]]) <= false_alarms
    assert np.median([r["score"] for r in by[1]]) > np.quantile([r["score"] for r in by[0]], 0.8)


def test_toxicity_scores_match_brute_force(spark, corpus):
    """Scores of the stored model, n-gram by n-gram in plain Python."""
    rows = [(r["doc_id"], r["text"]) for r in corpus.limit(60).collect()] + [(9001, None), (9002, ""), (9003, "a a a " * 50 + "x" * 200), (9004, "Ünïcode IDIOT idiot!")]
    model = toxicity.fit(corpus, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", toxicity.score_column(spark, model)("text")).collect()}
    mask, k = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def bucket(h):
        return ((h ^ (h >> 29)) * k & mask) >> (64 - toxicity.BITS)

    def logit(word):
        w, found = b"<" + word + b">", []
        for n in (3, 4, 5):
            for a in range(len(w) - n + 1):
                h = n
                for c in w[a : a + n]:
                    h = (h * k + c + 1) & mask
                found.append(bucket(h))
        found.append(bucket(sum((c + 1) * pow(k, a + 1, 1 << 64) for a, c in enumerate(w)) & mask))
        return float(np.mean([model.values[b] for b in found]))

    for i, text in rows:
        words = toxicity.words_of(text)
        means = [sum(map(logit, words[a : a + 2])) / 2 + model.bias for a in range(0, len(words), 2)] or [model.bias]
        z = model.scale * np.log(np.sum(np.exp(means))) + model.spread * np.log(len(means)) + model.shift
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-4


def test_calibration_keeps_its_bounds():
    rng = np.random.default_rng(6)
    for _ in range(30):
        x, y = rng.normal(0, 2, (25, 2)), (rng.random(25) < 0.3).astype(float)
        scale, spread, shift = toxicity.calibrate(x, y)
        p = 1 / (1 + np.exp(-(x @ [scale, spread] + shift)))
        assert scale >= 0 >= spread and abs(p.mean() - y.mean()) < 0.02 + 1e-3 / max(y.mean(), 1e-3)


def test_sample_passes_over_documents_beyond_the_budget(spark):
    rows = [(k, "long " * 400 if k % 10 == 0 else "short text") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    got = labelled.sample(docs, labels, "toxic", 4, 2, max_chars=8000)
    assert got["text"].str.len().sum() <= 8000 and got["y"].value_counts().min() > 40


def test_crf_tells_lines_of_bad_documents_apart():
    p = np.array([0.9, 0.8, 0.2, 0.9, 0.7, 0.1])
    assert crf.line_marks(np.array([1, 0, 0]), p, np.array([0, 1, 4, 6])).tolist() == [1, 1, 0, 1, 1, 0]
    assert crf.line_marks(np.array([0]), p[:2], np.array([0, 2])).tolist() == [1, 0]
    assert crf.moves_of(np.array([1.0, 1, 0, 1, 1, 0]), np.array([0, 1, 4, 6])).tolist() == [[0, 1], [2, 0]]


def test_classifiers_edges(spark, edge):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 11)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (toxicity, crf):
        for own in (labels, labels.limit(0)):
            model = module.fit(edge, own)
            scores = [r[0] for r in edge.select(module.score_column(spark, model)("text")).collect()]
            assert len(scores) == len(EDGE) and all(0 <= s <= 1 for s in scores)
    assert toxicity.drop_toxic(edge, labels).columns == edge.columns and crf.drop_poor(edge, labels).columns == edge.columns


def test_toxicity_reads_unspaced_text_to_its_end():
    rng = np.random.default_rng(3)
    line = lambda: "".join(chr(0x4E00 + c) for c in rng.permutation(96))
    toxic = "".join(chr(0x6000 + c) for c in range(12))
    model = toxicity.train(pd.DataFrame([(line() + (toxic if k % 2 else "") + line(), k % 2) for k in range(200)], columns=["text", "y"]))
    clean = [line() + line() for _ in range(5)]
    assert max(toxicity.scores(model, clean, {})) < 0.3 < 0.7 < min(toxicity.scores(model, [t + toxic for t in clean], {}))
    for n in (1, 63, 64, 65, 112, 113, 1000):
        text = "".join(rng.choice(list("abcdefgh"), n))
        pieces = toxicity.words_of(text)
        assert max(map(len, pieces)) <= toxicity.PIECE and {text[k : k + 5].encode() for k in range(n - 4)} == {p[k : k + 5] for p in pieces for k in range(len(p) - 4)}
    assert toxicity.words_of("x" * 64 + " y") == [b"x" * 64, b"y"]


def test_crf_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    emit, moves = rng.normal(0, 2, 6), rng.normal(0, 1, (2, 2))
    got, expected = crf.marginals(emit, moves, np.array([0, 4, 6]))
    want, pairs = np.zeros(6), np.zeros((2, 2))
    for a, b in ((0, 4), (4, 6)):
        total, p, m = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(2 ** (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            w = np.exp(sum(emit[a + k] * y[k] for k in range(b - a)) + sum(moves[i, j] for i, j in zip(y, y[1:], strict=False)))
            total += w
            p += w * np.array(y)
            for i, j in zip(y, y[1:], strict=False):
                m[i, j] += w
        want[a:b], pairs = p / total, pairs + m / total
    assert np.allclose(got, want) and np.allclose(expected, pairs)


def test_crf_document_scores_match_enumeration(spark, corpus):
    """Every labelling of the lines of short documents, by the fitted weights: marginals weighted by line length."""
    model = crf.fit(corpus, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect() if r["text"].count("\n") < 9][:40] + [(9001, None), (9002, ""), (9003, "A!!\n\nB %%%\nplain words here")]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", crf.score_column(spark, model)("text")).collect()}
    assert abs(model.moves[0, 1]) > 1e-3 and len({round(v, 6) for v in got.values()}) > 10
    for i, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        x, size, _ = crf.line_features(raw, np.array([0, len(raw)]))
        emit, n = np.clip(x @ model.weights, -30, 30), len(size)
        total, good = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            p = np.exp(sum(e for e, k in zip(emit, y, strict=True) if k) + sum(model.moves[a, b] for a, b in zip(y, y[1:], strict=False)) - np.maximum(emit, 0).sum())
            total, good = total + p, good + p * np.array(y)
        quality = (good / total * size).sum() / size.sum()
        assert abs(got[i] - 1 / (1 + np.exp(-(model.scale * quality + model.shift)))) < 1e-6


def test_components_of_chains_and_stars(spark):
    """Long chains, stars, loose pairs and loops; edges of earlier rounds are removed from the shared folder."""
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{100 + k: 100 for k in range(40)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(spark, edge):
    none = edge.limit(0)
    assert minhash.near_duplicates(none).count() == 0 and line_dedup.dedup(none).count() == 0
    assert packing.pack(none, queries.tokenizer_file("word_bpe_49k.json")).count() == 0
    assert sp_codec.encode(none, queries.tokenizer_file("piece_bpe_32k.model")).count() == 0
    assert quality_rules.with_ledger(none).count() == 0


def test_ledger_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 999, "mine", "x", "y")], "doc_id long, text string, Q_n_words long, q_words string, q_words_ string, q_lines string")
    got = quality_rules.with_ledger(df)
    row = got.first()
    assert row["q_n_words"] == 3 and row["Q_n_words_input"] == 999 and (row["q_words"], row["q_words_"], row["q_lines"]) == ("mine", "x", "y")
    assert got.columns == ["doc_id", "text", "Q_n_words_input", "q_words", "q_words_", "q_lines", *[c for c in got.columns if c in quality_rules.ADDED]]


def test_sentencepiece_of_a_very_long_text(spark):
    long = "word é 漢字  \n" * 4_000_000  # over 50 MB
    rows = spark.createDataFrame([(1, long), (2, "a"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sp_codec.encode(rows, queries.tokenizer_file("piece_bpe_32k.model")).collect()}
    assert got[1]["n_bytes"] == len(long.encode()) and got[1]["spans_cover"] and got[1]["n_tokens"] > 10_000_000 and got[3]["n_tokens"] == 2
