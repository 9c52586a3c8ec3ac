import numpy as np
import pytest
from pyspark.sql import functions as F

from textshield.functions.vectors import distance
from textshield.operators import retrieval as rt
from textshield.operators.embedding import embed
from textshield.operators.evaluation import evaluate
from textshield.operators.models import model_of
from textshield.operators.nearest import Nearest, Planes, ProbedNearest, Rows
from textshield.plans.corpus import build_collection
from textshield.sources.collections import load_collection

rng = np.random.default_rng(7)


def frame(spark, rows, key="id", kind="long"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{key} {kind}, embedding array<float>")


def brute(queries, chunks, k, metric, exclude_self=False):
    out = set()
    for qi, q in queries:
        scored = []
        for ci, c in chunks:
            if exclude_self and qi == ci:
                continue
            if metric == "l2":
                d = sum((a - b) * (a - b) for a, b in zip(q, c))
            elif metric == "ip":
                d = 1 - sum(a * b for a, b in zip(q, c))
            else:
                n = np.sqrt(sum(a * a for a in q)) * np.sqrt(sum(a * a for a in c))
                d = 1 - (sum(a * b for a, b in zip(q, c)) / n if n else 0.0)
            scored.append((round(d, 10) + 0.0, ci))
        out |= {(qi, r + 1, ci) for r, (_, ci) in enumerate(sorted(scored)[:k])}
    return out


def ranked(df):
    return {(r.query_id, r.rank, r.chunk_id) for r in df.collect()}


def small_vectors(n, dim=6, values=4):
    """Small whole numbers, so that many distances are equal."""
    return [(i, rng.integers(-values, values, dim).astype(np.float32).astype(float)) for i in range(n)]


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_matches_brute_force_on_every_path(spark, metric):
    q, c = small_vectors(17), small_vectors(150)
    c[3] = (3, np.zeros(6))
    want = brute(q, c, 4, metric)
    queries, chunks = frame(spark, q), frame(spark, c)
    for partitions in (1, 4, 37):
        found = rt.topk(queries, chunks.repartition(partitions), 4, metric.upper(), query_id="id", chunk_id="id")
        assert ranked(found) == want
    for query_bytes in (100, 300, 600):
        blocks = rt.topk(queries, chunks.repartition(5), 4, metric, query_id="id", chunk_id="id", query_bytes=query_bytes)
        assert ranked(blocks) == want


def test_self_is_excluded_and_ids_may_be_strings(spark):
    c = [(f"c{i:03d}", v) for i, v in small_vectors(60)]
    df = frame(spark, c, kind="string")
    for options in ({}, {"query_bytes": 900}):
        found = rt.topk(df, df, 3, "l2", query_id="id", chunk_id="id", exclude_self=True, **options)
        assert ranked(found) == brute(c, c, 3, "l2", exclude_self=True)


def test_a_third_of_all_rows_are_copies(spark):
    same = np.array([1.0, 2.0, 3.0])
    c = [(i, same if i % 3 == 0 else rng.normal(size=3).astype(np.float32).astype(float)) for i in range(3000)]
    q = [(10_000, same), (0, same)]
    found = rt.topk(frame(spark, q), frame(spark, c).repartition(5), 4, "l2", query_id="id", chunk_id="id", exclude_self=True)
    assert ranked(found) == {(10_000, r + 1, 3 * r) for r in range(4)} | {(0, r, 3 * r) for r in range(1, 5)}


def test_running_result_does_not_depend_on_batches():
    q = rng.normal(size=(5, 8))
    c = np.repeat(rng.normal(size=(40, 8)), 25, axis=0)
    ids = rng.permutation(1000)
    results = []
    for size in (1, 7, 100, 1000):
        nearest = Nearest(np.arange(5), q, 6, "cosine", False)
        for i in range(0, 1000, size):
            nearest.add(ids[i:i + size], c[i:i + size])
        results.append(list(zip(nearest.q.tolist(), nearest.ids.tolist(), nearest.d.tolist())))
    assert all(r == results[0] for r in results)


def test_many_blocks_take_few_passes(spark, monkeypatch):
    """Blocks that fit a pass together share it; shares beyond it have passes of their own."""
    q, c = small_vectors(40), small_vectors(90)
    scans, scan = [], rt._scan
    monkeypatch.setattr(rt, "_scan", lambda table, *a: scans.append(len(set(table["block"].to_pylist()))) or scan(table, *a))
    for pass_bytes, passes in ((1 << 20, 1), (1000, 3)):
        scans.clear()
        found = rt.topk(frame(spark, q), frame(spark, c).repartition(3), 4, "l2", query_id="id", chunk_id="id", query_bytes=200, pass_bytes=pass_bytes)
        assert ranked(found) == brute(q, c, 4, "l2")
        assert len(scans) == passes and min(scans) > 1


def test_queries_of_one_id_are_ranked_by_block(spark):
    """Equal queries in blocks of their own have k hits each, however many blocks a pass takes."""
    q, c = small_vectors(12), small_vectors(40)
    twice = frame(spark, q + q).coalesce(1)
    results = []
    for pass_bytes in (1, 1 << 20):
        found = rt.topk(twice, frame(spark, c), 3, "l2", query_id="id", chunk_id="id", query_bytes=300, pass_bytes=pass_bytes)
        results.append(sorted(found.collect()))
    assert results[0] == results[1] and len(results[0]) > 12 * 3


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("size", [1.0, 1e-12, 1e5, 1e20])
def test_single_precision_loses_no_neighbour(metric, size):
    """Rows that differ beyond single precision, in magnitudes that it holds and that it does not."""
    base = rng.normal(size=16)
    c = (base + 1e-9 * rng.normal(size=(400, 16))) * size
    q = np.concatenate([c[:20], rng.normal(size=(20, 16)) * size])
    nearest = Nearest(np.arange(40), q, 5, metric, True)
    nearest.add(np.arange(400), c)
    for i in range(40):
        d = nearest._exact(np.full(400, i), np.arange(400), Rows(np.arange(400), c, metric))
        want = [j for j in np.lexsort((np.arange(400), d)) if j != i][:5]
        assert nearest.ids[nearest.q == i].tolist() == want


def test_a_probe_of_most_buckets_is_one_product(monkeypatch):
    q = rng.normal(size=(60, 8))
    c = rng.normal(size=(900, 8))
    planes = Planes(rt.hyperplanes(6, 8), np.zeros(6))
    near, calls = ProbedNearest._near, []
    monkeypatch.setattr(ProbedNearest, "_near", lambda self, *a: calls.append(1) or near(self, *a))
    found = {}
    for wide in (4, 0):
        monkeypatch.setattr("textshield.operators.nearest.WIDE", wide)
        calls.clear()
        nearest = ProbedNearest(np.arange(60), q, 5, "cosine", True, planes, 40)
        nearest.add(np.arange(900), c)
        found[wide] = (nearest.q.tolist(), nearest.ids.tolist(), nearest.d.tolist())
        assert (len(calls) == 1) == (wide == 4)
    assert found[4] == found[0]


def test_kernel_and_column_agree(spark):
    c = [(i, rng.normal(size=16).astype(np.float32).astype(float)) for i in range(30)]
    df = frame(spark, c)
    for metric in ("l2", "ip", "cosine"):
        hits = rt.topk(df, df, 3, metric, query_id="id", chunk_id="id")
        a = df.select(F.col("id").alias("query_id"), F.col("embedding").alias("a"))
        b = df.select(F.col("id").alias("chunk_id"), F.col("embedding").alias("b"))
        both = hits.join(a, "query_id").join(b, "chunk_id")
        assert both.where(F.abs(F.round(distance(F.col("a"), F.col("b"), metric), 10) - F.col("distance")) > 1e-9).count() == 0


def test_edges(spark):
    c = frame(spark, small_vectors(3))
    none = c.where("id < 0")
    assert rt.topk(c, none, 2, query_id="id", chunk_id="id").count() == 0
    assert rt.topk(none, c, 2, query_id="id", chunk_id="id").count() == 0
    assert rt.topk(c, c, 10, query_id="id", chunk_id="id").count() == 9
    missing = c.union(spark.createDataFrame([(9, None)], c.schema))
    assert rt.topk(missing, missing, 10, query_id="id", chunk_id="id").count() == 9
    scored = rt.topk(c, c, 1, query_id="id", chunk_id="id", relevance=lambda d: 1 - d)
    assert {r.score for r in scored.collect()} == {1.0}
    mixed = c.union(spark.createDataFrame([(9, [1.0])], c.schema))
    with pytest.raises(Exception, match="one length"):
        rt.topk(c, mixed, 1, query_id="id", chunk_id="id").collect()


def test_blocks_of_queries_pass_over_chunks_that_stay(spark):
    """Chunks are scanned once a block, and the plan has no copy of them for each block."""
    c = frame(spark, small_vectors(50)).repartition(4)
    assert rt.query_size(c.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))) == (50, 50 * (6 * 8 + 8))
    text = c.selectExpr("repeat('x', 10) AS query_id", "embedding AS vector")
    assert rt.query_size(text) == (50, 50 * (6 * 8 + 40))
    hits = rt.topk(c, c, 2, query_id="id", chunk_id="id", query_bytes=700)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FlatMapCoGroups" not in plan and hits.count() == 100


def test_levels_pass_on_k_hits(spark):
    """Hits of many tasks are merged in groups first; every level ranks before it shuffles."""
    hits = spark.createDataFrame([(q, c, float((7 * c) % 50)) for q in range(3) for c in range(50)], "query_id long, chunk_id long, distance double").repartition(20)
    found = rt._ranked(hits, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4 and plan.count("Exchange hashpartitioning(query_id") == 2
    want = sorted((float((7 * c) % 50), c) for c in range(50))[:4]
    assert ranked(found) == {(q, r + 1, c) for q in range(3) for r, (_, c) in enumerate(want)}


def pairs(hits):
    return {(q, c) for q, _, c in ranked(hits)}


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_recall_of_an_index_on_clusters(spark, metric):
    centres = rng.normal(size=(60, 24)) + (5.0 if metric == "l2" else 0.0)
    c = [(i, (centres[i % 60] + 0.15 * rng.normal(size=24)).astype(np.float32).astype(float)) for i in range(3000)]
    df, ask = frame(spark, c), dict(query_id="id", exclude_self=True)
    exact = pairs(rt.topk(df, df, 5, metric, chunk_id="id", **ask))
    index = rt.build_index(df, metric, chunk_id="id", bucket_rows=30)
    assert index.planes.bits == 7 and index.probes < 64
    found = pairs(rt.search_index(df, index, 5, **ask))
    assert len(found & exact) / len(exact) >= 0.9


def test_recall_of_an_index_on_the_given_vectors(spark):
    """These are hardly clustered, so many buckets are probed, but recall holds."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ask = dict(query_id="vec_id", chunk_id="vec_id", exclude_self=True)
    exact = pairs(rt.topk(v, v, 5, "cosine", **ask))
    found = pairs(rt.approx_topk(v, v, 5, "cosine", bucket_rows=32, **ask))
    assert len(exact) == 10_000 and len(found & exact) / len(exact) >= 0.9


def test_all_probes_are_exact(spark):
    c = small_vectors(200)
    df, ask = frame(spark, c).repartition(3), dict(query_id="id", exclude_self=True)
    index = rt.build_index(df, "cosine", chunk_id="id", bucket_rows=10, probes=1.0)
    assert index.probes == 1 << index.planes.bits == 32
    assert ranked(rt.search_index(df, index, 3, **ask)) == brute(c, c, 3, "cosine", exclude_self=True)


def test_stored_index(spark, tmp_path):
    """Buckets that no query probes are not read, and a bucket with half of all chunks is in several files."""
    same = np.array([1.0, 2.0, 3.0, -1.0])
    c = [(f"c{i:04d}", same if i % 2 else rng.normal(size=4).astype(np.float32).astype(float)) for i in range(2000)]
    df = frame(spark, c, kind="string")
    built = rt.build_index(df, "cosine", chunk_id="id", bucket_rows=100, probes=2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that the small table has several files
    stored = rt.write_index(built, str(tmp_path / "index"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert stored.probes == 2 and stored.metric == "cosine" and (stored.planes.normals == built.planes.normals).all()
    sizes = {r.bucket: (r.n, r.files) for r in stored.rows.select("bucket", F.col("_metadata.file_name").alias("f")).groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("f").alias("files")).collect()}
    assert sum(n for n, _ in sizes.values()) == 2000 and max(sizes.values())[0] >= 1000 and max(sizes.values())[1] > 1
    q = frame(spark, [("q", same)], kind="string")
    for index in (built, stored, rt.read_index(spark, str(tmp_path / "index"))):
        assert ranked(rt.search_index(q, index, 3, query_id="id")) == {("q", r + 1, f"c{2 * r + 1:04d}") for r in range(3)}
    assert len(rt._probed(q.select(F.col("embedding").alias("vector")), stored.planes, 2)) == 2


def test_index_edges(spark):
    c = frame(spark, small_vectors(3))
    none = c.where("id < 0")
    assert rt.approx_topk(c, none, 2, query_id="id", chunk_id="id").count() == 0
    assert rt.approx_topk(none, c, 2, query_id="id", chunk_id="id").count() == 0
    odd = c.union(spark.createDataFrame([(8, None), (9, [float("nan")] * 6)], c.schema))
    assert rt.approx_topk(c, odd, 9, query_id="id", chunk_id="id").count() == 9
    assert [rt.index_bits(n) for n in (0, 1, 256, 257, 10_000, 10**9)] == [0, 0, 0, 1, 6, 10]
    with pytest.raises(ValueError, match="cosine or l2"):
        rt.build_index(c, "ip", chunk_id="id")


def test_context_and_enrich(spark):
    chunks = spark.createDataFrame([(1, "one", [1.0, 0.0]), (2, "two", [0.8, 0.6]), (3, "three", [0.0, 1.0])], "chunk_id long, text string, embedding array<float>")
    prompts = spark.createDataFrame([(7, "q", [1.0, 0.0]), (8, "lost", None)], "prompt_id long, prompt string, embedding array<float>")
    found = rt.retrieve(prompts, chunks, 2, "cosine", query_id="prompt_id").collect()
    assert [(r.query_id, r.context, r.n_docs) for r in found] == [(7, "[Document 1]\none\n\n[Document 2]\ntwo\n", 2)]
    rows = {r.prompt_id: r for r in rt.enrich(prompts, chunks, 2, "cosine").collect()}
    assert rows[7].documents == ["one", "two"] and "one\n\ntwo\n\nQUERY:\nq\n" in rows[7].enriched_prompt
    assert rows[8].enriched_prompt is None
    empty = rt.enrich(prompts, chunks.where("chunk_id < 0"), 2).collect()
    assert all(r.enriched_prompt is None for r in empty) and len(empty) == 2


def test_metadata_filter_reaches_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = rt.metadata_filter(docs, lang="en", source=["src1", "src2"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "In(source, [src1,src2])" in plan


def test_partial_limit_before_the_shuffle(spark):
    c = frame(spark, small_vectors(20))
    plan = rt.topk(c, c, 3, query_id="id", chunk_id="id")._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan.split("Exchange")[1] and "CartesianProduct" not in plan and "NestedLoop" not in plan


def pushed(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PushedFilters"):].split("ReadSchema")[0]


def test_ranges_on_shredded_metadata_reach_the_scan(spark, tmp_path):
    rows = [(1, {"year": "1999", "kind": "a"}), (2, {"year": "2005", "kind": "b"}), (3, {"year": "soon", "kind": "abc"}), (4, {}), (5, None)]
    chunks = rt.shred_metadata(spark.createDataFrame(rows, "chunk_id long, metadata map<string,string>"), {"year": "int", "kind": "string"})
    assert {r.chunk_id: (r.year, r.kind) for r in chunks.collect()} == {1: (1999, "a"), 2: (2005, "b"), 3: (None, "abc"), 4: (None, None), 5: (None, None)}
    chunks.write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    ids = lambda **wanted: {r.chunk_id for r in rt.metadata_filter(stored, **wanted).collect()}
    assert ids(year={"ge": 2000}) == {2} and ids(year={"gt": 1998, "le": 2005}) == {1, 2} and ids(kind={"prefix": "a"}) == {1, 3}
    assert ids(kind=["a", "b"], year={"lt": 2000}) == {1} and ids(year={"null": True}) == {3, 4, 5} and ids(year={"null": False, "ne": 1999}) == {2}
    assert ids(kind="abc") == {3}
    filters = pushed(rt.metadata_filter(stored, year={"ge": 2000, "lt": 2010}))
    assert "GreaterThanOrEqual(year,2000)" in filters and "LessThan(year,2010)" in filters
    assert "StringStartsWith(kind,a)" in pushed(rt.metadata_filter(stored, kind={"prefix": "a"}))
    for wrong in ({"none": 1}, {"year": {"about": 3}}):
        with pytest.raises(ValueError, match="no column none|unknown comparison"):
            rt.metadata_filter(stored, **wrong)


def test_vectors_of_another_model_are_refused(spark, tmp_path):
    """The model of a collection goes with its vectors, through selections and joins, and every search refuses another one."""
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue bird")], "doc_id long, text string")
    build_collection(docs, str(tmp_path), "c")
    chunks = load_collection(spark, str(tmp_path), "c")
    assert model_of(chunks, "embedding") == model_of(chunks.where("chunk_ix = 0").select("chunk_id", "embedding").join(chunks.select("chunk_id", "text"), "chunk_id"), "embedding") == "word-hash-64"
    ask = spark.createDataFrame([(1, "fish", "red fish")], "idx long, prompt string, response string")
    other = embed(ask, lambda: lambda texts: [[1.0] * 64 for _ in texts], text="prompt", model_id="another")
    mine = embed(ask, text="prompt")
    assert rt.topk(mine, chunks, 1, query_id="idx").count() == 1
    assert rt.enrich(mine, chunks, 1, prompt_id="idx").first().documents == ["red fish"]
    index = rt.build_index(chunks, "cosine")
    searches = [
        lambda q: rt.topk(q, chunks, 1, query_id="idx"), lambda q: rt.retrieve(q, chunks, 1, query_id="idx"), lambda q: rt.enrich(q, chunks, 1, prompt_id="idx"),
        lambda q: rt.approx_topk(q, chunks, 1, query_id="idx"), lambda q: rt.search_index(q, index, 1, query_id="idx"), lambda q: evaluate(q, chunks, 1)]
    for search in searches:
        with pytest.raises(ValueError, match="embedded by word-hash-64, queries by another"):
            search(other)
        assert search(mine).count() == 1
    # a vector that names no model is taken as it is
    assert rt.topk(mine.withColumn("embedding", F.transform("embedding", lambda x: x + 0)), chunks, 1, query_id="idx").count() == 1


def test_texts_of_many_hits(spark, monkeypatch):
    """A long list of hits meets only texts that were hit, and a popular text in shares; the result is the plain join."""
    monkeypatch.setattr(rt, "POPULAR_HITS", 50)
    monkeypatch.setattr(rt, "HIT_BITS", 1 << 15)
    texts = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(500)], "id string, text string")
    hits = spark.createDataFrame([(q, r + 1, f"c{(q * q * r) % 97}", 0.5) for q in range(300) for r in range(3)], "query_id long, rank int, chunk_id string, distance double")
    got = rt.with_chunks(hits, texts, "id", ["text"], None)
    want = {(q, r + 1, f"text {(q * q * r) % 97}") for q in range(300) for r in range(3)}
    rows = [(r.query_id, r.rank, r.text) for r in got.collect()]
    assert set(rows) == want and len(rows) == 900
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bitmap_construct_agg") == 1
    kept = rt._hit_chunks(texts.withColumnRenamed("id", "chunk_id"), hits).count()
    assert 97 <= kept + 60 and kept < 200
    same = rt.with_chunks(hits, texts, "id", ["text"], 900)
    assert sorted((r.query_id, r.rank, r.text) for r in same.collect()) == sorted(rows)
    assert rt.with_chunks(hits.where("false"), texts, "id", ["text"], None).count() == 0
