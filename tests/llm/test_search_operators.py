"""Decontamination, Jaccard join, quality, URL filter, top-k and the pipeline, beside brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from logwarden.llm import components, decontaminate, jaccard_join, quality, top_k, url_filter

from .helpers import corpus, groups_of, prose, shingles


def test_contained_items_match_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(prose(rng, n))) for i, n in enumerate((6, 9, 12, 20, 35, 60, 90))] + [(20, None), (21, ""), (22, "a b"), (23, "Just Three Words")]
    docs = [(i, " ".join(prose(rng, rng.randrange(3, 900)))) for i in range(40)]
    for i, (_, text) in enumerate(items[:7]):
        words = text.split()
        docs.append((100 + i, " ".join(prose(rng, 3000) + [w.upper() for w in words] + prose(rng, 3000))))
        docs.append((200 + i, " ".join(prose(rng, 500) + words[: int(len(words) * 0.6)] + prose(rng, 50))))
    docs += [(300, None), (301, ""), (302, "just three  words"), (303, "x just three words"), (304, items[3][1]), (304, items[3][1])]
    got = decontaminate.find_contained(
        spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, item long"), spark.createDataFrame(items, "item_id long, text string")
    )
    want = []
    for d, t in docs:
        for i, q in items:
            s = shingles(q)
            if s and len(s & shingles(t)) >= 0.8 * len(s):
                want.append((d, i, len(s & shingles(t)), len(s)))
    assert sorted((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got.collect()) == sorted(want)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contained(spark.createDataFrame(docs, "doc_id long, text string"), empty).count() == 0
    clean = decontaminate.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {w[0] for w in want}


@pytest.mark.parametrize("hot, stars, few", [(jaccard_join.HOT, 6, 4), (1, 2, 0)])
def test_similar_documents_match_brute_force(spark, monkeypatch, hot, stars, few):
    monkeypatch.setattr(jaccard_join, "STARS", stars)
    monkeypatch.setattr(jaccard_join, "FEW", few)
    docs = corpus()
    frame = spark.createDataFrame([(k, t, "x", 0) for k, t in docs], "doc_id long, text string, node string, comp int").repartition(3)
    got = jaccard_join.similar_documents(frame, hot=hot).collect()
    assert {r.doc_id: r.component_id for r in got} == groups_of(docs) and len(got) == len(docs)
    assert {r.doc_id: r.n_shingles for r in got} == {k: len(shingles(t)) for k, t in docs}


def test_similar_documents_odd_rows(spark):
    text = "a b c d e f g h"
    rows = [(5, text), (5, text), (3, text), (None, text), (7, "other words entirely here now"), (7, text), (9, None)]
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted([(5, 3), (5, 3), (3, 3), (None, None), (7, 7), (7, 3), (9, 9)], key=repr)
    assert jaccard_join.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_jaccard_stage_removes_rows_not_doc_ids(spark):
    text, other = "a b c d e f g h", "other words entirely here now"
    rows = [(5, text), (5, text), (3, text), (None, text), (None, text), (7, other), (7, text), (9, None), (9, None)]
    rows += [(11, "one more of its own kind"), (11, "one more of its own kind"), (12, "x y z x y z x"), (12, "X y z x y z x"), (1, "first of two groups"), (1, "third text of it")]
    rows += [(2, "first of two groups"), (2, "third text of it")]
    frame = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    got = corpus_pipeline.jaccard_stage(spark, frame, "")
    assert got.columns == frame.columns
    left = sorted(((r.doc_id, (r.text or "").lower()) for r in got.collect()), key=repr)
    want = [(None, text), (None, text), (3, text), (7, other), (9, ""), (11, rows[9][1]), (12, rows[11][1]), (1, rows[13][1]), (1, rows[14][1])]
    assert left == sorted(want, key=repr)
    once = frame.where("doc_id = 3 OR doc_id = 12").dropDuplicates(["doc_id"])
    assert corpus_pipeline.jaccard_stage(spark, once, "").count() == 2


def test_components_of_a_path_and_a_star(spark):
    path, star = [(i + 1, i) for i in range(40)], [(100, 100 + i) for i in range(30)]
    got = components.components(spark.createDataFrame([*path, *star, (7, 7)], "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_quality_learns_junk(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(w + rng.choice("!?#%") * 3 if i % 3 == 0 else w for w in prose(rng, rng.randrange(4, 300)))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), "x") for i, _ in docs] + [(1, 1, "x"), (None, 1, "x"), (2, None, "x")], "doc_id long, quality int, y string")
    frame = spark.createDataFrame([(k, t, 3) for k, t in docs] + [(900, None, 3), (901, "", 3)], "doc_id long, text string, score int")
    model = quality.fit(frame, labels)
    got = {r.doc_id: r.score for r in quality.scores(frame, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i, _ in docs]) > 0.97
    assert quality.keep_good(frame, model).columns == frame.columns
    assert 0 <= quality.fit(frame, labels.limit(0)).score(pa.array(["a", None]))[0] <= 1
    assert quality.scores(frame.limit(0), model).count() == 0


def test_quality_fits_on_one_row_a_key(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(prose(rng, 20))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int")
    used = []
    monkeypatch.setattr(quality, "fit_bags", lambda x, bags, y: used.append((x.tolist(), y.tolist())))
    held = {r.doc_id for r in labels.where(quality.held_out("doc_id")).collect()}
    often = next(i for i, _ in docs if i not in held)
    for more in ([], [docs[often]] * 500, [(often, docs[often][1])] + [(often, f"w{i}") for i in range(50)]):
        quality.fit(spark.createDataFrame(docs + more, "doc_id long, text string").repartition(3), labels)
    assert used[0] == used[1] and len(used[2][1]) == len(used[0][1]) == 60 - len(held)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, bags, y = rng.standard_normal((7, quality.WIDTH)), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    shapes = {"E": (quality.WIDTH, 4), "e": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "b": (1,)}
    w = {k: rng.standard_normal(s) * 0.2 for k, s in shapes.items()}

    def loss():
        h = np.tanh(x @ w["E"] + w["e"])
        a = quality._softmax((np.tanh(h @ w["V"]) * quality._sigmoid(h @ w["U"])) @ w["w"], bags, 3)
        p = quality._sigmoid(quality._sums(h * a[:, None], bags, 3) @ w["c"] + w["b"])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = quality._gradients(w, x, bags, y, np.ones(3))
    for k in shapes:
        at = tuple(0 for _ in shapes[k])
        w[k][at] += 1e-5
        up = loss()
        w[k][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - grads[k][at]) < 1e-4
        w[k][at] += 1e-5


def glob_regex(glob: str) -> str:
    return "(?s)" + re.escape(glob).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")


def test_automaton_matches_regular_expressions():
    rng = random.Random(6)
    globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "?"]) for _ in range(rng.randrange(1, 14))).replace("***", "**") for _ in range(60)]
    urls = ["".join(rng.choice("ab/.") for _ in range(rng.randrange(0, 16))) for _ in range(300)] + ["", "a" * 2000]
    got = url_filter.Automaton([url_filter.glob_tokens(g) for g in globs]).matches(pa.array(urls))
    want = [[re.fullmatch(glob_regex(g), u) is not None for g in globs] for u in urls]
    assert got.tolist() == want


def test_urls_are_judged(spark):
    rows = [
        (1, "https://WWW.Example.org/es/x?q"), (2, "http://example.org/en/12"), (3, "http://notexample.org/es/"), (4, "http://a.com/fr/#x"), (5, "http://a.com/de/"),
        (6, None), (7, "no scheme"), (8, "http://x.org"), (9, "http://my.ads.net/x"), (10, "http://x.net/a.exe"), (10, "http://x.net/a.exe"), (11, "http://evil.net/example.org/es/"),
    ]
    got = url_filter.judge_urls(spark.createDataFrame([(k, u, "h") for k, u in rows], "page_id long, url string, host string")).collect()
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got} == {
        (1, "www.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"), (3, "notexample.org", "/es/", "org/", "allow"),
        (4, "a.com", "/fr/", "com/fr/", "allow"), (5, "a.com", "/de/", "com/de/", "block"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "x.org", "", None, "allow"), (9, "my.ads.net", "/x", None, "block"), (10, "x.net", "/a.exe", None, "block"),
        (11, "evil.net", "/example.org/es/", None, "allow"),
    }
    assert len(got) == len(rows)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.standard_normal((500, 8)) * 0.3)]
    vectors += [(600 + i, vectors[0][1]) for i in range(15)] + [(700, [0.5]), (800, [0.25]), (900, [1e12] * 8), (901, [float("nan")] * 8), (902, None), (903, [None] * 8)]
    frame = top_k.quantized(spark.createDataFrame([(k, v, 1) for k, v in vectors], "vec_id long, embedding array<double>, rank int").repartition(4))
    got = top_k.top_k(frame, frame.where("key % 100 = 0")).collect()
    whole = {k: np.floor(1024 * np.array(v)).astype(np.int64) for k, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (k for k in whole if k % 100 == 0):
        scored = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q and len(v) == len(whole[q]))[:10]
        want |= {(q, i + 1, k, -s) for i, (s, k) in enumerate(scored)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert top_k.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_top_k_of_a_repeated_query_id_does_not_depend_on_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [i, 20 - i]) for i in range(20)], "key long, v array<bigint>")
    queries = spark.createDataFrame([(100, [1, 0]), (100, [0, 1]), (100, [0, 1]), (101, [1, 1])], "key long, v array<bigint>")
    got = []
    for size in (top_k.QUERY_BYTES, 1):
        monkeypatch.setattr(top_k, "QUERY_BYTES", size)
        got.append(sorted(map(tuple, top_k.top_k(vectors, queries, 4).collect())))
    assert got[0] == got[1] == [(100, 1, 0, 20), (100, 2, 1, 19), (100, 3, 19, 19), (100, 4, 2, 18)] + [(101, i + 1, i, 20) for i in range(4)]


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, t, "en", "s", len(t or "")) for i, t in corpus()]
    item = " ".join(prose(rng, 30, 10**6))
    docs += [(600, " ".join(prose(rng, 50)) + " " + item, "en", "s", 0), (601, " ".join(w + "###" for w in prose(rng, 90)), "en", "s", 0)]
    docs += [(1000 + i, " ".join(w + "%%%" if i % 2 else w for w in prose(rng, 90)), "en", "s", 0) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1000 + i, 1 - i % 2, 0) for i in range(120)] + [(i, 1, 0) for i, *_ in docs[:60]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns == frame.columns
        if name == "ngram_jaccard_join":
            groups = groups_of([(r.doc_id, r.text) for r in frame.collect()])
            assert {r.doc_id for r in after.collect()} == set(groups.values())
        frame = after
        kept.append({r.doc_id for r in after.collect()})
    assert 601 not in kept[0] and 600 in kept[2] and 600 not in kept[3] and 503 in kept[0] | {503}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == kept[3]
