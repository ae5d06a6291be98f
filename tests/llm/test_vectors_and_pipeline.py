"""Vector operators against brute force, and the pipeline stage by stage."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowline.llm import ann, components, langid, minhash, neardup_vec
from flowline.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double, key string, cid long"


def vectors(seed=0, n=400, dim=16, groups=6):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    for g in range(groups):  # groups of near vectors
        v[g * 20 : g * 20 + 12] = v[g * 20] + 0.02 * rng.standard_normal((12, dim))
    v[300:340] = v[300]  # copies
    v[340:360] *= 1e-20
    rows = [(i, [float(np.float32(x)) for x in v[i]], int(i // 20 % 3) if i < 300 or i >= 340 else 1) for i in range(n)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * dim, 1), (1003, [None] + [1.0] * (dim - 1), 1), (1004, [float("nan")] * dim, 1), (1005, [float("inf")] + [1.0] * (dim - 1), 1), (1006, rows[0][1], None), (1007, [1.0, 2.0], 1), (1008, [2.0, 4.0], 1), rows[5], (None, rows[0][1], 0), (None, None, None)]
    return [(*r, 1, 0.5, "k", 7) for r in rows]


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.fixture(scope="module")
def rows():
    return vectors()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize(("window", "block"), [(128, 512), (3, 8), (128, 3)])
def test_links_equal_brute_force(frame, rows, monkeypatch, window, block):
    monkeypatch.setattr(neardup_vec, "WINDOW", window)
    monkeypatch.setattr(neardup_vec, "BLOCK", block)
    own = [(i, np.array(v, dtype=float), lab) if good(v) and lab is not None else (i, None, None) for i, v, lab, *_ in rows]
    unit = [None if v is None else (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for _, v, _ in own]
    n, up = [0] * len(own), list(range(len(own)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            if own[a][1] is not None and own[b][1] is not None and own[a][2] == own[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                n[a] += 1
                n[b] += 1
                up[root(a)] = root(b)
    low = defaultdict(list)
    for i, r in enumerate(own):
        low[root(i)].append(r[0])
    want = Counter()
    for i, r in enumerate(own):
        ids = [x for x in low[root(i)] if x is not None]
        component = min(ids) if ids else None
        want[r[0], n[i], component, True if component is None else r[0] == component if r[0] is not None else True] += 1
    got = Counter(map(tuple, neardup_vec.link_vectors(frame).collect()))
    known = lambda c: Counter({k: v for k, v in c.items() if k[0] is not None})
    assert known(got) == known(want) and got.total() == want.total()


def stars(groups, copies, dim=64, cosine=0.983, seed=3):
    """Groups of a centre and copies that are near it, but not near each other."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal((groups, 1, dim)))
    away = rng.standard_normal((groups, copies, dim))
    away = unit(away - (away * centre).sum(axis=-1, keepdims=True) * centre)
    return np.concatenate([centre, cosine * centre + np.sqrt(1 - cosine**2) * away], axis=1)


def test_star_groups_are_one_component_each(spark):
    """Partners of a centre that aren't partners of each other: every verified pair counts, not two a vector."""
    v = stars(30, 99)
    n = [int((u @ u.T >= 0.98).sum()) - 100 for u in v]
    data = [(int(i), x.tolist(), 1) for i, x in zip(np.random.default_rng(0).permutation(3000), v.reshape(3000, 64), strict=True)]
    got = neardup_vec.link_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()
    ids = np.array([d[0] for d in data]).reshape(30, 100)
    component, links = {r.vec_id: r.component_id for r in got}, {r.vec_id: r.n_links for r in got}
    for own, want in zip(ids.tolist(), n, strict=True):
        assert {component[i] for i in own} == {min(own)}
        assert sum(links[i] for i in own) == want


def neighbours(rows, top=20):
    """Brute force: of each query its exact neighbours among the vectors of its dimension."""
    entries, want = [(i, v) for i, v, *_ in rows if good(v) and i is not None], {}
    for q, v in sorted({i: v for i, v in entries if i % 20 == 0}.items()):
        found = []
        for i, w in entries:
            if i != q and len(v) == len(w):
                s = 0.0
                for x, y in zip(v, w, strict=True):
                    s += x * y
                found.append((-s, i))
        want[q] = [(i, -s) for s, i in sorted(found)[:top]]
    return want


def searched(frame, **how):
    got = defaultdict(list)
    for r in ann.search(frame, F.col("vec_id") % 20 == 0, **how).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_one_large_star(spark):
    """A hub with more partners than windows hold, which are no partners of each other."""
    v = stars(1, 2500)[0]
    rows = [(int(i), x.tolist(), 1) for i, x in enumerate(v)]
    got = neardup_vec.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    close = v @ v.T >= 0.98
    assert {r.component_id for r in got} == {0}
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate((close.sum(axis=1) - 1).tolist()))


def test_overlapping_stars(spark):
    """Linked centres in one component, each with more partners than windows hold: all belong to it, not the first one's only."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    aside = lambda c, cosine, n: cosine * c + np.sqrt(1 - cosine**2) * unit((a := rng.standard_normal((n, len(c)))) - (a @ c)[:, None] * c)
    centres = [unit(rng.standard_normal(64))]
    for _ in range(2):
        centres.append(aside(centres[-1], 0.985, 1)[0])
    v = np.concatenate([[c, *aside(c, 0.983, 1500)] for c in centres] + [unit(rng.standard_normal((500, 64)))])
    close = v @ v.T >= 0.98
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    got = neardup_vec.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate((close.sum(axis=1) - 1).tolist()))
    assert {r.vec_id for r in got if r.component_id == 0} == set(range(3 * 1501))
    assert all(r.component_id == r.vec_id for r in got if r.vec_id >= 3 * 1501)


def test_dense_cluster_needs_no_products(spark, monkeypatch):
    """Vectors in the core of a large component are counted, not multiplied."""
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    v = centre + 0.002 * rng.standard_normal((700, 16))
    monkeypatch.setattr(neardup_vec, "BLOCK", 64)
    rows = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = neardup_vec.link_vectors(rows).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(699, 0)}


def test_passes_grow_with_the_label():
    passes = [neardup_vec.passes_of(n) for n in (0, 1, 100, 10_000, 1_000_000, 10**8)]
    assert passes == sorted(passes) and passes[0] >= 4 and passes[-1] > 2 * passes[2]


def test_search_that_visits_all_equals_brute_force(spark, frame, rows):
    """Asked for all neighbours of all queries, the index visits what it takes, and ranks exactly; other dimensions among themselves."""
    more = [(2000, [1.0, 2.0]), (2001, [3.0, 1.0]), (2002, [1.0]), (2020, [5.0, -1.0]), (2040, [2.0])]
    both = frame.select("vec_id", "embedding").union(spark.createDataFrame(more, "vec_id long, embedding array<float>"))
    assert searched(both, recall=1.0, picked=10_000) == {q: v for q, v in neighbours([*rows, *more]).items() if v}


def test_search_prunes_and_finds(frame, rows):
    want, got = neighbours(rows), searched(frame, recall=0.95)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in v}) / len(v) for q, v in want.items() if v]
    assert np.mean(hits) >= 0.9
    exact = {q: dict(v) for q, v in neighbours(rows, top=10_000).items()}
    assert all(exact[q][i] == s for q, own in got.items() for i, s in own)


def test_split_cells_and_shards(frame, monkeypatch):
    whole = sorted(map(tuple, ann.search(frame, F.col("vec_id") % 20 == 0).collect()))
    monkeypatch.setattr(ann, "LEAST_SHARD", 7)
    monkeypatch.setattr(ann, "QUERIES", 5)
    assert sorted(map(tuple, ann.search(frame, F.col("vec_id") % 20 == 0).collect())) == whole


def recalls(rows, got):
    data = rows.collect()
    ids, v = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data])
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        s[q] = -np.inf
        yield len(got[ids[q]] & set(ids[np.argsort(-s)[:20]].tolist())) / 20


def test_recall_on_random_vectors(spark, small):
    rows = table(spark, small.replace("0.001", "0.1"), "embeddings")
    got = defaultdict(set)
    for r in ann.search(rows, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    assert np.mean(list(recalls(rows, got))) >= 0.9


def test_clustered_vectors_visit_few_entries(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((80, 32))
    v = np.repeat(centres, 50, axis=0) + 0.1 * rng.standard_normal((4000, 32))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index, entries = ann.build(rows.selectExpr("vec_id", "embedding v"), 32)
    queries = rows.where("vec_id % 20 = 0").selectExpr("vec_id", "embedding v")
    assert ann.reach(index, entries, queries, 20, 0.95, 64) < 0.2 * 4000
    got = defaultdict(set)
    for r in ann.search(rows, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    assert np.mean(list(recalls(rows, got))) >= 0.9


def test_walk_visits_pairs_in_order():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.normal(size=7), rng.normal(size=7)
        counts = rng.integers(0, 4, (7, 7))
        cells = ann.walk(a, b, counts, 20)
        every = sorted(((a[c // 7] + b[c % 7], c) for c in range(49) if counts[c // 7, c % 7]), reverse=True)
        assert cells == [c for _, c in every[: len(cells)]]
        held = [counts[c // 7, c % 7] for c in cells]
        assert sum(held) >= min(20, counts.sum()) and sum(held[:-1]) < 20


def test_empty_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert not ann.search(empty, F.col("vec_id") % 20 == 0).collect()
    assert not neardup_vec.link_vectors(empty).collect()


def test_components_of_paths_stars_and_rings(spark):
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300)]
    links = [x if rng.random() < 0.5 else x[::-1] for x in links]
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {200 + i: 200 for i in range(9)}


# --- pipeline ---


def test_pipeline_by_stage(spark, small):
    docs = table(spark, small, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, small).cache()
        assert docs.columns == before.columns, name
        kept.append(docs.collect())
    original = {r.doc_id: r for r in table(spark, small, "documents").collect()}
    named, unique, clean, mixed = kept
    model = langid.train(table(spark, small, "documents").where(~langid.held_out(F.col("doc_id"))))
    want = {i for i, r in original.items() if (p := model.predict([r.text]))[0][0] != "und" and p[1][0] >= 0.5}
    assert {r.doc_id for r in named} == want and len(named) >= 0.95 * len(original)
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(named, docs.schema)).collect()}
    assert sorted(r.doc_id for r in unique) == sorted(d for d, c in classes.items() if d == c)
    assert {r.doc_id for r in clean} == {r.doc_id for r in unique}
    assert all(r.n_chars == len(r.text) and "AKIA" not in r.text for r in clean)
    copies = Counter(r.doc_id for r in mixed)
    assert copies.keys() <= {r.doc_id for r in clean} and max(copies.values()) <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert Counter((r.doc_id) for r in last if r.piece == 0) == copies
    used = defaultdict(list)
    for r in last:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_pipeline_of_odd_rows(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, None, None, None, 0, "x"), (2, "", "en", "a", 0, "x"), (3, text, "en", "a", 0, "x"), (3, text, "en", "a", 0, "x"), (None, text, None, None, None, None), (4, 'token = "abcdefgh12345678"', "en", "a", 0, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "unused")
            docs = out
        assert docs.count() >= 0 and "sequence_id" in docs.columns
    where = str(tmp_path / "t")
    spark.createDataFrame(rows, schema).write.parquet(f"{where}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, where).collect()} <= {3, 4, None}


def test_pipeline_keeps_columns_of_any_name(spark):
    """Columns named like those that stages use stay, with their values."""
    extra = ["score", "Lang_Pred", "__copies", "__once", "__row", "copies", "size", "label", "key", "th", "band", "n"]
    text = "the quick brown fox jumps over the lazy dog while the old man and the sea are calm today in many ways"
    rows = [(i, f"{text} {i} " * 3, "en", "a", 0, *(float(i * 100 + k) for k in range(len(extra)))) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} double" for c in extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "unused").cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra], name
        got = docs.collect()
        assert got and all(tuple(r)[5:] == rows[r.doc_id][5:] for r in got), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "unused").count() >= len(got)


def test_digest_is_that_of_the_words():
    a, b = minhash.whole_word_hashes(["The  quick\tfox", "the quick FOX"])
    assert hashlib.sha256(a.tobytes()).digest() == hashlib.sha256(b.tobytes()).digest()
