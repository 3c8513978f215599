"""Operators 3, 5 and 6 and the pipeline against brute force, on every kind of row."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from cuewright.llm import catalog, components, minhash, neighbors, topk


def groups(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def shingles(text, size):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split() if text else []
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def corpus(seed=2):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(draw.choice([5, 30, 120]))]
        texts.append(" ".join(base))
        for _ in range(draw.choice([1, 3, 25])):
            copy = base[:]
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(common + [word() for _ in range(80)]) for _ in range(40)]  # a passage that many share
    return texts + ["", " \n", "One Two", "one two", "one\ttwo", "x"]


def test_near_duplicates(spark):
    texts = corpus()
    sets = [shingles(t, 4) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    expected = groups(len(texts), links)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    got = {r.doc_id: r for r in minhash.near_duplicates(df, shingle=4).collect()}
    assert [got[i].component_id for i in range(len(texts))] == expected
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_a_hot_group(spark, monkeypatch):
    """Near copies around one text, many of them too far from it: every link is found, over several blocks of a bucket, by any of the passes."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "HUBS", 1)
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghijk") for _ in range(6))
    base = [word() for _ in range(90)]
    texts = [" ".join(base)]
    for _ in range(150):
        copy = base[:]
        for _ in range(draw.choice([1, 2, 3, 3, 4, 4])):
            copy[draw.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    for at in draw.sample(range(1, 150), 30):  # near copies of copies
        copy = texts[at].split()
        copy[draw.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    sets = [shingles(t, 4) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    expected = groups(len(texts), links)
    assert len(set(expected)) > 20 and Counter(expected).most_common(1)[0][1] > 40
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=4).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_shingle_sets():
    found = [None, "", " ", "One", "one TWO\tthree  four\nfive", " lead and trail \n", "É é İ x y z", "a" * 3000 + " b c d e", "x\u00a0y z w v u"]
    for size in (1, 3, 4):
        sets = minhash.shingle_sets(pa.array(found), size)
        for text, hashes in zip(found, sets, strict=True):
            assert len(hashes) == len(shingles_of_bytes(text, size)) and (hashes == minhash.shingle_set(text, size)).all() and (np.diff(hashes.astype(float)) >= 0).all()


def test_slices_of_batches():
    """What reads texts from a slice of a batch gives the same as from a copy."""
    from cuewright.llm import byte_bpe, secrets, words

    draw = random.Random(3)
    texts = pa.array(["".join(draw.choice("aB éß\n日x") for _ in range(draw.randint(0, 60))) for _ in range(400)] + [None])
    encoder = byte_bpe.worker_encoder(catalog.BYTE_VOCABULARY, catalog.public_tokenizers.PATTERN)[0]
    for start, n in ((0, 100), (100, 150), (399, 2)):
        cut, copy = texts.slice(start, n), pa.array(texts.slice(start, n).to_pylist(), pa.string())
        assert all((a == b).all() for a, b in zip(minhash.shingle_sets(cut, 2), minhash.shingle_sets(copy, 2), strict=True))
        for a, b in zip(byte_bpe.encoded(cut, encoder), byte_bpe.encoded(copy, encoder), strict=True):
            assert a.tolist() == b.tolist()
        filled = pa.array([x or "" for x in copy.to_pylist()])
        assert [x.tolist() if hasattr(x, "tolist") else x for x in words.words_of(cut.fill_null(""))] == [x.tolist() if hasattr(x, "tolist") else x for x in words.words_of(filled)]
        assert secrets.tokens_of(cut.fill_null("")).start.tolist() == secrets.tokens_of(filled).start.tolist()


def shingles_of_bytes(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_near_duplicates_of_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, None), (None, None), (8, ""), (None, "only here with no id at all")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter([(5, 5, True), (5, 5, True), (None, 5, False), (7, 7, True), (None, None, True), (8, 8, True), (None, None, False)])
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_registers_estimate_similarity():
    draw = np.random.default_rng(0)
    errors = []
    for _ in range(200):
        pool = draw.integers(0, 2**64, 1500, dtype=np.uint64)
        a, b = np.unique(pool[:1200]), np.unique(pool[300:])
        errors.append(float(minhash.estimates(minhash.registers(a), minhash.registers(b))) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    draw = random.Random(1)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    expected = groups(600, pairs)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: expected[n] for n in {x for p in pairs for x in p if p[0] != p[1]}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_search_equals_sql(spark):
    assert oracle.differences(spark, catalog.queries()["op3_topk"], catalog.oracle_sql()["op3_topk"]) == []


def test_search_blocks():
    draw = np.random.default_rng(0)
    for _ in range(150):
        n, d, k = draw.integers(1, 60), draw.integers(1, 70), draw.integers(1, 7)
        table, ids = draw.integers(-4, 5, (d, n)) * draw.choice([1, 1 << 40]), draw.permutation(2 * n)[:n]
        queries, asked = table[:, :7], ids[:7]
        got = {}
        for q, v, s in zip(*topk.best(asked, queries, ids, table, k)):
            got.setdefault(q, []).append((-s, v))
        for j, q in enumerate(asked.tolist()):
            exact = sorted((-sum(int(a) * int(b) for a, b in zip(queries[:, j], table[:, m])), int(ids[m])) for m in range(n) if ids[m] != q)[:k]
            if all(abs(s) < 2**63 for s, _ in exact):
                assert got.get(q, []) == exact


def test_search_block_by_block():
    """With the floors of earlier blocks, the k best of all blocks come out of those of each; ties stay."""
    draw = np.random.default_rng(1)
    for scale, size in ((3, 40), (300, 300), (1 << 40, 40)):
        table, ids, k = draw.integers(-scale, scale + 1, (50, 4 * size)), draw.permutation(8 * size)[: 4 * size], 5
        queries, asked = table[:, ::9], ids[::9]
        floors, got = topk.Floors(asked, k), []
        for at in range(0, 4 * size, size):
            found = topk.best(asked, queries, ids[at : at + size], table[:, at : at + size], k, floors.of())
            floors.add(found)
            got += zip(*found)
        exact = queries.T.astype(object) @ table.astype(object)
        for i, q in enumerate(asked.tolist()):
            want = sorted((-s, v) for s, v in zip(exact[i].tolist(), ids.tolist()) if v != q)[:k]
            assert sorted((-s, v) for x, v, s in got if x == q)[:k] == want
        assert len(got) < len(asked) * k * 4


def test_search_broadcasts_no_copies(spark):
    """The planner does not count the copies of the query blocks, so it took gigabytes of them for small enough to broadcast."""
    df = spark.range(50).selectExpr("id AS vec_id", "array(id / 50.0D, 1.0D) AS embedding")
    plan = topk.search(df, df.filter("vec_id % 5 = 0"), k=5)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_repeated_rows_leave_room(spark):
    """Ten copies of the best row take one place; large blocks of numbers beyond double precision are searched by bounds, too."""
    rows = [(7, [1.0, 1.0])] * 10 + [(8, [0.9, 1.0]), (9, [0.8, 1.0]), (10, [0.5, 0.5]), (0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, df.filter("vec_id = 0"), k=5).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 7, 512 * 256), (2, 8, 230 * 256 + 65536), (3, 9, 204 * 256 + 65536), (4, 10, 65536)]


def test_search_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = topk.search(df, df.filter("vec_id IN (0, 3)"), k=5).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 6, 65536), (0, 2, 1, 32768)]
    assert topk.search(df.limit(0), df).collect() == [] and topk.search(df, df.limit(0)).collect() == []


def test_search_among_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), *[(1, [0.9, 0.1])] * 20, (1, [0.9, 0.1, 0.0]), *((i, [0.9 - i / 100, 0.1]) for i in range(2, 9))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = topk.search(df, df.filter("vec_id = 0"), k=5).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


def vectors(seed=0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(60, 16))
    rows = [c + draw.normal(size=16) * 0.05 for c in centres for _ in range(int(draw.choice([1, 1, 2, 30])))]
    return [r.astype(np.float32).tolist() for r in rows] + [rows[0].astype(np.float32).tolist()] * 3 + [draw.normal(size=16).astype(np.float32).tolist() for _ in range(300)]


def test_neighbours(spark):
    found = vectors()
    table = np.array(found, dtype=np.float64)
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    linked = table @ table.T >= 0.9
    np.fill_diagonal(linked, False)
    expected = groups(len(found), [(int(a), int(b)) for a, b in zip(*np.nonzero(linked))])
    report = {}
    df = spark.createDataFrame(list(enumerate(found)), "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    got = {r.vec_id: r for r in neighbors.near_duplicates(df, report=report).collect()}
    assert [got[i].n_links for i in range(len(found))] == linked.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(found))] == expected
    assert report["recall"] >= 0.999 and report["audited"] > 0


def test_neighbours_of_full_lists(spark, monkeypatch):
    """Two groups of near copies whose links to each other are in no list of the nearest, nor seen by the audit."""
    monkeypatch.setattr(neighbors, "AUDITED", 0)
    draw = np.random.default_rng(4)
    pairs = np.zeros((600, 64))
    pairs[:300, 0], pairs[300:, :2] = 1, [0.95, np.sqrt(1 - 0.95**2)]
    pairs += draw.normal(size=pairs.shape) * 0.008
    found = pairs.astype(np.float32).tolist()
    table = np.array(found, dtype=np.float64)
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    linked = table @ table.T >= 0.9
    np.fill_diagonal(linked, False)
    nearest = np.argsort(-(table @ table.T), axis=1)[:, 1 : neighbors.NEIGHBOURS + 1]
    assert linked[:300, 300:].all() and not ((nearest < 300) != (np.arange(600) < 300)[:, None]).any()
    df = spark.createDataFrame(list(enumerate(found)), "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in neighbors.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(600)] == linked.sum(axis=1).tolist()
    assert {r.component_id for r in got.values()} == {0}
    # Without any component to start from, the exact comparison joins the rest.
    digests = spark.createDataFrame([(i, 1, i, bytes(bytearray(np.array(v, "<f4").tobytes()))) for i, v in enumerate(found)], "node long, times long, component long, vector binary")
    exact = neighbors.linked_everywhere(digests, "<f4", 0.9)
    assert {r.node: r.links for r in exact.filter("links IS NOT NULL").collect()} == dict(enumerate(linked.sum(axis=1).tolist()))
    reached = components.components(exact.filter("links IS NULL"), "node", "other").collect()
    assert len(reached) == 600 and {r.component for r in reached} == {0}


def test_recall_of_small_groups(spark):
    """One hot group that is found does not hide that the links of all others were missed."""
    hot = [(a, b) for a in range(4) for b in range(1000) if a != b]
    truth = spark.createDataFrame([*hot, (2000, 2001), (2010, 2011)], "a long, b long")
    reached = spark.createDataFrame([(i, 0) for i in range(1000)] + [(2000, 2000), (2001, 2000)], "node long, component long")
    assert neighbors.recall_of(truth, reached) == 0.5
    assert neighbors.recall_of(truth.filter("a < 2010"), reached) == 1.0


def test_neighbours_of_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (None, [5.0, 0.1]), (7, [1e300, 1e299]), (8, [-1.0, 0.0])]
    got = neighbors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter(
        [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (None, 4, 1, False), (7, 4, 1, False), (8, 0, 8, True)]
    )
    assert neighbors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


COLUMNS = list(corpus_pipeline.COLUMNS)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet")
    extra = [(9001, None, "en", "s", 0), (9002, "12 34", "en", "s", 5), (9003, "the and of password=abcdef123 the", None, None, 30), (None, None, None, None, None)]
    extra.append((9004, " ".join(r.text for r in docs.filter("lang = 'en'").orderBy("doc_id").limit(60).collect()) + " token: f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "en", "s", 0))  # very long
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("n_tokens", F.lit(1))
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, oracle.DATA).persist()
        assert kept.columns == COLUMNS
        seen[name] = {r.doc_id: r for r in kept.collect()}
    assert not {9001, 9002, None} & set(seen["language"]) and len(seen["language"]) >= docs.count() - 4
    texts = {i: r.text for i, r in seen["language"].items()}
    ids = sorted(texts)
    sets = [shingles(texts[i], 5) for i in ids]
    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    links = [(i, j) for i, s in enumerate(sets) for j, n in Counter(j for x in s for j in index[x] if j < i).items() if 100 * n >= 80 * len(s | sets[j])]
    assert set(seen["near_duplicates"]) == {ids[g] for g in groups(len(ids), links)}
    assert set(seen["without_secrets"]) == set(seen["near_duplicates"])
    assert seen["without_secrets"][9003].text == "the and of [SECRET] the" and seen["without_secrets"][9004].text.endswith(" [SECRET]")
    assert set(seen["mixture"]) <= set(seen["without_secrets"])
    out = corpus_pipeline.STAGES[-1][1](spark, kept, oracle.DATA)
    assert out.count() == kept.count() and out.filter("NOT round_trip").count() == 0


def test_documents_without_id_stay(spark):
    base = [f"word{i}" for i in range(60)]
    near, other = " ".join(base), " ".join([*base[:59], "else"])
    texts = [(None, "only here with no id at all"), (None, near), (None, other), (4, near), (None, "x y z group"), (None, "x y z group"), (None, None), (None, " "), (7, "a b c d e f"), (7, "quite something else"), (5, "a b c d e f"), (5, "a b c d e f")]
    schema = spark.read.parquet(f"{oracle.DATA}/documents.parquet").select(*COLUMNS).schema
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts], schema)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, oracle.DATA).collect())
    assert got == Counter([(None, "only here with no id at all"), (4, near), (None, "x y z group"), (None, None), (None, " "), (7, "quite something else"), (5, "a b c d e f")])


def test_language_stage_rejects_noise(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet")
    draw = random.Random(5)
    noise = [" ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 9))) for _ in range(60)) for _ in range(5)]
    rows = spark.createDataFrame([(9000 + i, text, None, None, len(text)) for i, text in enumerate(noise)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(rows), oracle.DATA).collect()}
    assert not kept & set(range(9000, 9005))
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}


@pytest.mark.parametrize("k", range(5))
def test_stages_of_nothing(spark, k):
    empty = spark.read.parquet(f"{oracle.DATA}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, empty, oracle.DATA).collect() == []
