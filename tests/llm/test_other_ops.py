"""URL filters, nearest neighbours and chat formatting."""

import hashlib
import zlib

import numpy as np
import pytest

from foliant.llm import ann, chat, queries, url_lm

SF = "/root/testdata/sf0.01"


def test_url_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "http://foo.net", "https://foo.net/", "http://example.com/de/1", "http://xexample.com/de/1", "ftp://b.org/fr/", "no scheme", None, "", "http://h?x://y/z", "a://b://c/d", "http://net/é"]
    rows = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["url_host"], r["url_path"], r["url_rule"], r["url_verdict"]) for r in url_lm.judge(rows).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][:3] == ("foo.net", "", None) and got[2] == ("foo.net", "/", "net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2] is None and got[5][2:] == ("org/fr/", "allow")
    assert got[6][:3] == ("", "", None) and got[7] == ("", "", None, "allow") and got[9][:2] == ("h", "") and got[10][:2] == ("b:", "//c/d")
    assert url_lm.judge(rows.limit(0)).count() == 0


def test_url_model_tells_classes_apart(spark):
    rng = np.random.default_rng(1)
    good = [f"http://{'lane'[rng.integers(4) :]}garden{rng.integers(99)}.example/news/{rng.integers(999)}" for _ in range(300)]
    bad = [f"http://xxx{rng.integers(99)}casino-win.example/zzq/{rng.integers(999)}" for _ in range(300)]
    rows = [(u, False if k < 200 else None, 0) for k, u in enumerate(good)] + [(u, True if k < 200 else None, 1) for k, u in enumerate(bad)]
    y = {u: k for u, mark, k in rows if mark is None}
    got = [(y[r["url"]], r["score"]) for r in url_lm.score(spark.createDataFrame([r[:2] for r in rows], "url string, rejected boolean")).collect() if r["url"] in y]
    assert max(s for k, s in got if not k) < min(s for k, s in got if k)


def brute_url_scores(rows):
    """Witten-Bell in plain Python: {url: score}."""
    text = lambda u: bytes(4) + (u.partition("://")[2] if "://" in u else u).encode()
    counts = [{}, {}]
    for u, rejected in rows:
        if u is not None and rejected is not None:
            t = text(u)
            for at in range(4, len(t)):
                for n in range(5):
                    follow = counts[rejected].setdefault(t[at - n : at], {})
                    follow[t[at]] = follow.get(t[at], 0) + 1

    def p(k, t, at):
        back = 1 / 256
        for n in range(5):
            if follow := counts[k].get(t[at - n : at]):
                back = (follow.get(t[at], 0) + len(follow) * back) / (sum(follow.values()) + len(follow))
        return back

    return {u: float(np.mean([np.log(p(1, t, at) / p(0, t, at)) for at in range(4, len(t))] or [0.0])) for u, _ in rows if u is not None for t in [text(u)]}


def test_url_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(url_lm, "BLOCK_URLS", 7)
    rng = np.random.default_rng(3)
    words = ["shop", "news", "12", "97", "привет", "мир", "é", "a", "", "x" * 3000]
    rows = [(f"http://{'.'.join(rng.choice(words, 2))}/{rng.choice(words)}?{rng.integers(50)}", [False, True, None][rng.integers(3)]) for _ in range(120)]
    rows += [("http://", None), ("", None), (None, True), ("no scheme here", None), ("http://shop.12/", True)] + [("http://hot.example/", False)] * 40
    rows = [(u, dict(rows)[u]) for u, _ in rows]
    want = brute_url_scores(rows)
    got = {r["url"]: r["score"] for r in url_lm.score(spark.createDataFrame(rows, "url string, rejected boolean")).collect()}
    assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-9 for u in want)


def test_urls_of_other_scripts_and_digits_are_told_apart(spark):
    rows = [(f"http://site.example/{w}/{k}", r) for k in range(30) for w, r in (("кот", False), ("пёс", True), ("17", False), ("84", True))]
    asked = [("http://site.example/кот/x", None), ("http://site.example/пёс/x", None), ("http://site.example/17/x", None), ("http://site.example/84/x", None)]
    got = {r["url"]: r["score"] for r in url_lm.score(spark.createDataFrame(rows + asked, "url string, rejected boolean")).collect()}
    low, high, few, many = (got[u] for u, _ in asked)
    assert low < 0 < high and few < 0 < many


def test_url_filter_keeps_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "http://a.org/fr/", "mine", 2.0)] * 3 + [(2, None, None, None)], "page_id long, url string, URL_Host string, url_score double")
    got = url_lm.judge(rows)
    assert got.columns == ["page_id", "url", "URL_Host_input", "url_score_input", *url_lm.ADDED]
    assert sorted((r["page_id"], r["url_host"], r["URL_Host_input"], r["url_verdict"]) for r in got.collect() if r["page_id"] == 1) == [(1, "a.org", "mine", "allow")] * 3


def test_url_query_against_brute_force(spark):
    rows = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()]
    got = {r["page_id"]: r for r in queries.op1_url_filter(spark, SF).collect()}
    assert len(got) == len(rows)
    verdict = {u: got[i]["verdict"] for i, u in rows if got[i]["rule"]}
    held = {u for u in verdict if zlib.crc32(u.encode()) % 5 == 0}
    want = brute_url_scores([(u, None if u in held or u not in verdict else verdict[u] == "block") for _, u in rows])
    assert all(abs(got[i]["score"] - want[u]) < 1e-9 for i, u in rows)
    accepted = sorted(want[u] for _, u in rows if u in held and verdict[u] == "allow")
    level = max(0.0, accepted[int(np.ceil(0.98 * len(accepted))) - 1])
    assert all(got[i]["verdict"] == ("block" if want[u] > level else "allow") for i, u in rows if not got[i]["rule"])


def brute(rows, k=20):
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in range(len(ids)):
        if ids[q] % 20 == 0:
            s = (m * m[q]).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
            out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = brute(rows), {}
    for r in queries.op4_nearest_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    found = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert found >= 0.9


def test_ties_between_different_vectors_go_by_id(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k), rng.integers(-2, 3, 6).astype(float).tolist()) for k in rng.permutation(900)]
    rows = [r for r in rows if any(r[1])]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least_visits=10**6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: [(v, s) for _, v, s in sorted(own)] for q, own in got.items()} == {q: [(v, float(s)) for v, s in own] for q, own in brute(rows).items()}


def test_each_length_is_searched_by_itself(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(0, 1, 3 if k % 3 else 5).tolist()) for k in range(200)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    want = {q: v for n in (3, 5) for q, v in brute([r for r in rows if len(r[1]) == n]).items()}
    assert {q: [own[k] for k in sorted(own)] for q, own in got.items()} == {q: [v for v, _ in own] for q, own in want.items()}


def test_recall_on_queries_that_did_not_calibrate(spark, monkeypatch):
    """Many leaves on clustered vectors: visits prune, and recall holds on the other queries."""
    monkeypatch.setattr(ann, "PROBES", 40)
    monkeypatch.setattr(ann, "LEAF_ROWS", 60)
    rng = np.random.default_rng(10)
    centres = rng.normal(0, 1, (60, 16))
    m = centres[rng.integers(0, 60, 6000)] + rng.normal(0, 0.15, (6000, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(m)]
    got, visited = {}, []
    calibrate = ann.calibrate
    monkeypatch.setattr(ann, "calibrate", lambda tree, *rest: visited.append((tree.leaves, calibrate(tree, *rest))) or visited[-1][1])
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {q: {v for v, _ in own} for q, own in brute(rows).items()}
    assert sum(len(got[q] & want[q]) for q in want) / sum(map(len, want.values())) >= 0.93
    assert visited[0][0] > 50 and visited[0][1] < visited[0][0] / 3


def test_neighbours_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [1.0, 2.0, 0.5]) for k in range(60)] + [(k, rng.normal(0, 1, 3).tolist()) for k in range(60, 90)]
    bad = [(100, None), (120, [0.0, 0.0, 0.0]), (140, [float("nan"), 1.0, 1.0]), (160, [None, 1.0, 1.0]), (180, [float("inf"), 1.0, 1.0]), (200, [1.0]), (None, [1.0, 1.0, 1.0]), (0, [1.0, 2.0, 0.5])]
    got = {}
    for r in ann.search(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute([(i, np.array(v, np.float32)) for i, v in rows])
    assert got.keys() == want.keys()
    for q, own in got.items():
        assert [v for _, v, _ in sorted(own)] == [v for v, _ in want[q]] and np.allclose([s for _, _, s in sorted(own)], [s for _, s in want[q]], rtol=1e-14)
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")).count() == 1


def test_chat_round_trip(spark):
    tricky = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", tricky), (1, 2, "assistant", "<\\|im_end|>\n<\\\\|x"), (2, 0, None, None), (2, 0, "user", "<|"), (None, 0, "assistant", "é\U0001f600"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 0, "system", "")]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    key = lambda r: (r[1], r[2] or "\0", r[3] or "\0")
    for conv in (1, 2, 3, None):
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(turns) and row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert row["formatted_chars"] == len(chat.chat_markup([(chat.escape(r), chat.escape(t)) for r, t in turns]))


def test_escaping_is_reversible_and_hides_controls():
    for text in ("<|", "<\\|", "<\\\\|<|", "a<|b|>", "<", "|", "\\", "<|im_start|>x<|im_end|>"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_rewriting_templates_are_found():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert chat.rewrites_at(chat.chat_markup, turns) is None
    last_only = lambda ts: "".join(f"[{r}]{t if k == len(ts) - 1 else ''}" for k, (r, t) in enumerate(ts))
    assert chat.rewrites_at(last_only, turns) == 1
    with pytest.raises(chat.HistoryRewritten):
        list(chat.format_turns(iter(turns), last_only))


def test_long_conversations_render_whole_prefixes(spark):
    turns = [("user" if k % 2 == 0 else "assistant", f"text {k}") for k in range(20)]
    numbered = lambda ts: "<tools>" + "".join(f"[{k} {r}]{t}\n" for k, (r, t) in enumerate(ts))
    spans = list(chat.format_turns(iter(turns), numbered))
    assert "".join(s for s, _, _ in spans) == numbered(turns) and [s[a:b] for s, a, b in spans] == [t for _, t in turns]
    late = lambda ts: "".join(f"[{r}]{t if k or len(ts) < 15 else '-'}" for k, (r, t) in enumerate(ts))
    with pytest.raises(chat.HistoryRewritten):
        list(chat.format_turns(iter(turns), late))
    with pytest.raises(chat.HistoryRewritten):
        r = chat.Renderer(lambda ts: "".join(f"[{k} {r}]{t}" for k, (r, t) in enumerate(ts)), additive=True)
        [r.add(*t) for t in turns]
    rows = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for template in (numbered, chat.chat_markup):
        got = chat.render_conversations(rows, template).orderBy("place").collect()
        assert "".join(r["span"] for r in got) == template(turns) and [r["span"][r["text_begin"] : r["text_end"]] for r in got] == [t for _, t in turns]


def test_templates_wrongly_declared_additive_are_found(monkeypatch):
    turns = [("user" if k % 2 == 0 else "assistant", f"text {k}") for k in range(60)]
    odd = lambda ts: "".join(f"{'=' if k and k % 2 == 0 else ''}[{r}]{t}" for k, (r, t) in enumerate(ts))
    late = lambda ts: "".join(f"{'=' if k == 50 else ''}[{r}]{t}" for k, (r, t) in enumerate(ts))
    for template in (odd, late):
        assert "=" in "".join(s for s, _, _ in chat.format_turns(iter(turns), template))
        r = chat.Renderer(template, additive=True)
        with pytest.raises(chat.HistoryRewritten):
            [r.add(*t) for t in turns]
            r.close()
    monkeypatch.setattr(chat, "WHOLE_CHARS", 200)
    spans = list(chat.format_turns(iter(turns)))
    assert "".join(s for s, _, _ in spans) == chat.chat_markup(turns)


def test_empty_tables(spark):
    rows = lambda schema: spark.createDataFrame([], schema)
    assert url_lm.judge(rows("page_id long, url string")).count() == 0 and chat.format_conversations(rows("conv_id long, turn long, role string, text string")).count() == 0
    assert ann.search(rows("vec_id long, embedding array<float>")).count() == 0
