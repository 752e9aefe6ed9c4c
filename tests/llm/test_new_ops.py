"""Exact top-k, whitening and the conversation trie against brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from foliant.llm import queries, topk, trie, whiten

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>"


def plain(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_exact_top_k"])
def test_new_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("embeddings", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLE[name])
    assert plain(queries.QUERIES[name](spark, SF).select(*want.columns).collect()) == plain(want.fetchall())


def brute_top(rows, k, every, scale=256):
    """{query: [(vec_id, score)]} in Python integers."""
    x = {i: [int(np.floor(scale * float(c))) for c in v] for i, v in rows}
    dot = lambda a, b: max(-topk.LIMIT, min(topk.LIMIT, sum(p * q for p, q in zip(a, b, strict=True))))
    return {q: sorted(((i, dot(v, x[q])) for i, v in x.items() if i != q and len(v) == len(x[q])), key=lambda r: (-r[1], r[0]))[:k] for q in x if q % every == 0}


def top_lists(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([x[0] for x in sorted(own)] == list(range(1, len(own) + 1)) for own in got.values())
    return {q: [x[1:] for x in sorted(own)] for q, own in got.items()}


def test_top_k_with_ties_copies_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 200)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(4)
    rows = [(int(k), (rng.integers(-3, 4, 4) / 256).tolist()) for k in rng.permutation(300)]  # many different vectors tie
    rows += [(k, [2 / 256, 1 / 256, 0.0, 0.0]) for k in range(300, 400)] + [(k, rng.normal(0, 3, 2).tolist()) for k in range(400, 430)] + [(500, [0.0] * 4), (550, []), (560, [])]
    got = top_lists(topk.top_k(spark.createDataFrame(rows, VECTORS), "vec_id % 10 = 0", bins=8))
    want = brute_top(rows, 5, 10)
    assert got == {q: own for q, own in want.items() if own}


def test_top_k_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [0.5, -0.001]), (50, [1.5e8, -1.5e8]), (51, [1.7e8, 1.2e8]), (100, None), (101, [None, 1.0]), (102, [nan, 1.0]), (103, [inf, 1.0]), (104, [1e30, 1.0]), (None, [1.0, 1.0]), (0, [1.0, 2.0]), (-50, [-1.0, -1.0]), (7, [1e14, 1e14])]
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS + ", query_id string")
    kept = dict((i, v) for i, v in rows if i in (0, 1, 50, 51, -50, 7))
    assert top_lists(topk.top_k(df)) == brute_top(kept.items(), 5, 50)
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 50")).count() == 0


def brute_trie(rows):
    """Nodes of the rebuilt conversations in plain Python, as sorted tuples."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + ts[h:]
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = sum(len(q) == len(p) + 1 for q in below)
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].split()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_conversations(rng, n):
    texts = ["a b", "c", "", "d e f", None, "<|x|>  y"]
    rows = []
    for c in rng.permutation(n).tolist():
        for turn in range(rng.integers(0, 6)):
            rows.append((c, turn if rng.random() < 0.9 else None, ["user", "assistant", None][rng.integers(3) if rng.random() < 0.2 else turn % 2], texts[min(rng.geometric(0.6) - 1, 5)]))
    long = [(k % 2, f"turn {k}") for k in range(40)]
    rows += [(c, k, "user" if r else "assistant", t) for c in (1001, 1003, 1007) for k, (r, t) in enumerate(long)] + [(1003, 40, "user", "more")]
    return rows + [(None, 0, "user", "lost"), (-7, 1, "user", "a b"), (-7, 1, "user", "a b"), (-20, 0, "user", "a b"), (-20, 1, "user", "z")]


@pytest.mark.parametrize("seed, most, block", [(1, 5, 4), (2, 40, 7), (3, 10_000, 1024)])
def test_trie_against_brute_force(spark, monkeypatch, seed, most, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = random_conversations(np.random.default_rng(seed), 120)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, place string")
    c = trie.F.col("conv_id")
    got = trie.prefix_trie(*trie.share_heads(trie.ordered_turns(df), c - c % 20, trie.F.crc32(c.cast("string")) % 4), most)
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_without_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    c = trie.F.col("conv_id")
    assert trie.prefix_trie(*trie.share_heads(trie.ordered_turns(df), c, trie.F.lit(0))).count() == 0


def test_digests_of_many_ids_go_piece_by_piece(spark):
    ids = np.random.default_rng(5).permutation(2000).tolist()
    df = spark.createDataFrame([(1, 2, c) for c in ids] + [(1, 3, 7)], "key_a long, key_b long, conv_id long")
    got = {r["key_b"]: r["ends_sha256"] for r in trie.digests(df, 37).collect()}
    assert got == {2: hashlib.sha256(",".join(map(str, range(2000))).encode()).hexdigest(), 3: hashlib.sha256(b"7").hexdigest()}


def brute_whitening(rows, k=4, scale=256):
    """{length: (n, deviations by x, eigenvalues, eigenvectors, trace, means)} by exact sums and a library's eigenvectors."""
    by = {}
    for _, v in rows:
        x = tuple(int(np.floor(scale * float(c))) for c in v)
        by.setdefault(len(x), set()).add(x)
    out = {}
    for d, xs in by.items():
        n, sums = len(xs), [sum(c) for c in zip(*xs, strict=True)]
        exact = {x: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for x in xs}
        mean = np.array([s / n for s in sums])
        y = np.array(sorted(xs), float) - mean
        v = y.T @ y / n
        values, axes = np.linalg.eigh(v)
        keep = [j for j in np.argsort(-values)[:k] if values[j] > 1e-12 * max(values.max(), 1e-300)]
        out[d] = (n, exact, values[keep], axes[:, keep].T, np.trace(v), mean)
    return out


def check_whitening(rows, got, tolerance=1e-9):
    want, seen = brute_whitening(rows), {}
    vector = {}
    for i, v in rows:
        vector.setdefault(i, []).append(tuple(int(np.floor(256 * float(c))) for c in v))
    for r in got:
        xs = vector[r["vec_id"]]
        n, exact, values, axes, trace, mean = want[len(xs[0])]
        assert r["n"] == n and r["deviation"] in [exact[x] if exact[x] < 1 << 63 else None for x in xs] and 0 <= r["identity_error"] <= 1e-4
        j = r["component"] - 1
        assert abs(r["explained"] / (values[j] / trace) - 1) < 1e-9
        seen.setdefault((len(xs[0]), j), []).append((r["whitened"], [float((np.array(x) - mean) @ axes[j] / np.sqrt(values[j])) for x in xs]))
    for pairs in seen.values():
        assert any(all(min(abs(a - sign * b) for b in bs) < tolerance * max(1.0, abs(a)) for a, bs in pairs) for sign in (1, -1))
    assert len(got) == sum(len(want[len(v)][2]) for _, v in rows)


def test_whitening_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op12_embedding_whitening(spark, SF).collect()
    assert len(got) == 4 * len(rows)
    check_whitening(rows, got, 1e-6)


def test_whitening_of_copies_lengths_and_low_rank(spark, monkeypatch):
    monkeypatch.setattr(whiten, "SCATTER_CELLS", 30)
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(0, [3, 1, 0.5, 0.2, 0.1]).tolist()) for k in range(200)] + [(k, [1.0, 2.0, 3.0, 4.0, 5.0]) for k in range(200, 320)]
    rows += [(400 + k, [float(k), 2.0 * k, 0.0]) for k in range(20)] + [(500, [1.0, 2.0]), (500, [1.0, 2.0])] + [(600 + k, [float(k % 7)]) for k in range(30)] + [(7, rows[7][1])]
    rows += [(700 + k, [1e15 * k, 3e14 * (k % 3), 1.0, 0.0]) for k in range(9)]
    got = whiten.whiten(spark.createDataFrame([(*r, 1) for r in rows], VECTORS + ", n int")).collect()
    check_whitening(rows, got)
    assert {r["component"] for r in got if 400 <= r["vec_id"] < 420} == {1} and not [r for r in got if r["vec_id"] == 500]


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [0.1 * k, (k * k % 11) / 3, -0.001]) for k in range(12)] + [(None, [0.5, 0.5, -0.0])]
    bad = [(20, None), (21, [None, 1.0, 1.0]), (22, [nan, 1.0, 1.0]), (23, [inf, 1.0, 1.0]), (24, []), (25, [1e300, 0.0, 0.0])]
    check_whitening(rows, whiten.whiten(spark.createDataFrame(rows + bad, VECTORS)).collect())
    assert whiten.whiten(spark.createDataFrame(bad, VECTORS)).count() == 0 and whiten.whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_factorization_against_a_library():
    rng = np.random.default_rng(7)
    for n, rank in ((1, 1), (2, 2), (7, 3), (64, 64), (33, 20)):
        b = rng.normal(0, 1, (n, rank)) * 10.0 ** rng.uniform(-2, 2, rank)
        v = b @ b.T
        values, axes = whiten.factorize(v, n)
        want = np.sort(np.linalg.eigvalsh(v))[::-1][: len(values)]
        assert len(values) <= n and np.allclose(values[: min(rank, 4)], want[: min(rank, 4)], rtol=1e-12)
        assert np.allclose(axes @ axes.T, np.eye(len(axes)), atol=1e-7) and np.allclose(v @ axes[0], values[0] * axes[0], atol=1e-10 * values[0])
