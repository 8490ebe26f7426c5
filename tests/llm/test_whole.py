"""Places where a cheaper rule would lose results: large buckets, dense regions, borders between tasks."""

import numpy as np

import corpus_pipeline
from lexiloom.llm import embed_dedup, media, near_dup


def template_docs(n=600, pairs=60, core=400, own=50):
    """Documents that share runs of words at a similarity of about 0.8, and some with a near copy of their own."""
    r = np.random.default_rng(11)
    base = [f"core{i}" for i in range(core)]
    rows = [(i, " ".join(base + [f"own{i}x{k}" for k in range(own)])) for i in range(n)]
    for i in range(pairs):
        doc = int(r.integers(n // pairs)) + i * (n // pairs)
        rows.append((n + i, rows[doc][1].replace(f"own{doc}x{own - 1}", "last")))
    return rows


def test_near_dup_large_bucket(spark):
    rows = template_docs()
    sets = {i: set(near_dup.shingle_hashes(t).tolist()) for i, t in rows}
    first = {}
    for i, t in rows[600:]:
        j = next(j for j, u in rows[:600] if u.rsplit(" ", 1)[0] == t.rsplit(" ", 1)[0])
        assert 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
        first[i] = j
    assert 100 * len(sets[0] & sets[1]) < 85 * len(sets[0] | sets[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(df, bands=5, rows=1, block=100).collect()}
    assert got == {i: first.get(i, i) for i, _ in rows}


def test_pipeline_joins_at_80(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:90] + [f"v{i}" for i in range(10)]))]
    a, b = (set(near_dup.shingle_hashes(t).tolist()) for _, t in rows)
    assert 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()] == [1]


def components_of(vectors, labels):
    x = np.array(vectors)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    hit = (x @ x.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    least = np.arange(len(x))
    while True:
        now = np.where(hit, least[None, :], len(x)).min(axis=1)
        if (now == least).all():
            return {i: (int(hit[i].sum()) - 1, int(c)) for i, c in enumerate(least)}
        least = now


def check_vectors(spark, vectors, labels, **options):
    df = spark.createDataFrame([(i, [float(e) for e in v], int(k)) for i, (v, k) in enumerate(zip(vectors, labels))], "vec_id long, embedding array<double>, label int")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in embed_dedup.embedding_components(df, **options).collect()}
    assert got == components_of(vectors, labels)


def test_embeddings_dense_region(spark):
    r = np.random.default_rng(2)
    centre = r.standard_normal(64)
    near = [centre + 0.42 * r.standard_normal(64) for _ in range(1500)]
    near += [near[i] + 0.3 * r.standard_normal(64) for i in range(0, 300, 5)]
    check_vectors(spark, near, [0] * len(near), window=8)


def test_embeddings_across_borders(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((600, 64))
    vectors = [c + s * 0.15 * r.standard_normal(64) for c in centres for s in (0, 1)]
    check_vectors(spark, vectors, [i // 30 for i in range(len(vectors))])


def test_media_short_texts_differ(spark):
    r = np.random.default_rng(4)
    rows = [(i, "".join("abcdefghij klm"[k] for k in r.integers(0, 14, 300))) for i in range(20)]
    got = media.media_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(len(r["codes"]) > 0 for r in got)
    assert len({(tuple(r["times"]), tuple(r["codes"])) for r in got}) == len(rows)
