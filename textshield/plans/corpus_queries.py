"""Registered queries: chunks, vectors and collections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textshield.fixed_values import CHUNK_OVERLAP, CHUNK_SIZE, SPACE
from textshield.functions.vectors import distance, l2_normalize
from textshield.operators import embedding as emb
from textshield.operators.chunking import assign_ids, chunk_language, chunk_recursive, chunk_window, corpus_stats
from textshield.operators.retrieval import metadata_filter, shred_metadata, topk
from textshield.operators.upserts import fill_metadata, update, upsert
from textshield.plans import fragments as sql
from textshield.plans.corpus import build_collection, collection_chunks
from textshield.plans.registry import Tables, query
from textshield.session import shared_dir
from textshield.sources.collections import collection_count, load_collection, write_changes
from textshield.streaming.streams import build_incremental

STRIDE = CHUNK_SIZE - CHUNK_OVERLAP
WINDOWS = f"""c AS (SELECT doc_id, lang, i::INT AS chunk_ix, substr(text, i::INT * {STRIDE} + 1, {CHUNK_SIZE}) AS chunk FROM
  (SELECT doc_id, lang, text, unnest(range(greatest(length(text) - {CHUNK_OVERLAP + 1}, 0) // {STRIDE} + 1)) AS i FROM documents WHERE length(text) > 0))"""


def windows(t: Tables):
    return chunk_window(t.documents.select("doc_id", "lang", "text"))


@query("chunk_window", f"WITH {WINDOWS} SELECT doc_id, chunk_ix, chunk FROM c")
def window_chunks(t: Tables):
    return windows(t).select("doc_id", "chunk_ix", "chunk")


@query("chunk_ids", f"""WITH {WINDOWS} SELECT doc_id, chunk_ix, sha256('["corpus","' || doc_id || '","' || chunk_ix || '"]') AS chunk_id FROM c""")
def chunk_ids(t: Tables):
    return assign_ids(windows(t), "corpus").select("doc_id", "chunk_ix", "chunk_id")


@query("corpus_stats", f"""WITH {WINDOWS} SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT sum(length(text))::BIGINT FROM documents) AS total_chars,
  count(*) AS n_chunks, sum(length(chunk))::BIGINT AS chunk_chars FROM c""")
def statistics(t: Tables):
    return corpus_stats(t.documents, windows(t))


@query("chunk_recursive")
def recursive(t: Tables):
    return chunk_recursive(t.documents.select("doc_id", "text"))


@query("chunk_language")
def language_chunks(t: Tables):
    return chunk_recursive(t.pages.select("page_id", "html"), language="html", text="html")


@query("collection_count", f"WITH {WINDOWS} SELECT lang, count(*) AS n_chunks FROM c GROUP BY lang")
def count_by_language(t: Tables):
    return collection_count(windows(t), "lang")


def components(df, key: str):
    return df.select(key, F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 6) + 0.0)


def _parts(name: str, key: str) -> str:
    return f"SELECT k AS {key}, (unnest(range(len(e))))::INT AS dim, round(unnest(e), 6) + 0.0 AS value FROM {name}"


@query("hash_embed", f"WITH {sql.hashed('documents', 'doc_id', 'text', 'h')} {_parts('h', 'doc_id')}")
def document_vectors(t: Tables):
    return components(emb.hash_embed(t.documents), "doc_id")


@query("embed_queries", f"""WITH p AS (SELECT conv_id || ':' || turn AS prompt_id, text AS query FROM conversations WHERE role = 'user'),
{sql.hashed('p', 'prompt_id', 'query', 'h')} {_parts('h', 'prompt_id')}""")
def query_vectors(t: Tables):
    users = t.conversations.where("role = 'user'")
    asked = users.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("prompt_id"), F.col("text").alias("query"))
    return components(emb.embed_queries(asked), "prompt_id")


# Vectors of a label as the tokens of one item; a token is attended when its first component is positive.
# Documents without a vector make items without attended tokens out of their own vectors.
TOKENS = """tok AS (SELECT label::BIGINT AS item_id, vec_id AS pos, CASE WHEN embedding[1] > 0 AND label <> 3 THEN 1 ELSE 0 END AS mask, embedding::DOUBLE[] AS vec FROM embeddings),
x AS (SELECT item_id, mask, unnest(range(len(vec))) AS d, unnest(vec) AS v FROM tok),
s AS (SELECT item_id, d, sum(v * mask) AS v FROM x GROUP BY ALL), n AS (SELECT item_id, sum(mask)::DOUBLE AS n FROM tok GROUP BY 1)"""
UNIT = "u AS (SELECT item_id, sqrt(sum(m * m)) AS norm FROM p GROUP BY 1)"


def tokens(t: Tables):
    mask = F.when((F.get("embedding", F.lit(0)) > 0) & (F.col("label") != 3), 1).otherwise(0)
    return t.embeddings.select(F.col("label").cast("long").alias("item_id"), F.col("vec_id").alias("pos"), mask.alias("mask"), F.col("embedding").alias("vec"))


@query("pool_mean", f"""WITH {TOKENS}, p AS (SELECT s.item_id, d, v / greatest(n, 1e-9) AS m FROM s JOIN n USING (item_id)), {UNIT}
SELECT item_id, d::INT AS dim, round(m / greatest(norm, 1e-12), 6) + 0.0 AS value FROM p JOIN u USING (item_id)""")
def mean_pooled(t: Tables):
    return components(emb.pool_mean(tokens(t)), "item_id")


@query("pool_average", f"""WITH {TOKENS}, p AS (SELECT s.item_id, d, v / n AS m FROM s JOIN n USING (item_id) WHERE n > 0), {UNIT}
SELECT item_id, d::INT AS dim, round(m / greatest(norm, 1e-12), 6) + 0.0 AS value FROM p JOIN u USING (item_id)
UNION ALL SELECT item_id, -1, NULL FROM n WHERE n = 0""")
def average_pooled(t: Tables):
    pooled = emb.pool_average(tokens(t)).select("item_id", F.posexplode_outer("embedding").alias("dim", "value"))
    return pooled.select("item_id", F.coalesce("dim", F.lit(-1)).alias("dim"), (F.round("value", 6) + 0.0).alias("value"))


@query("pool_last", """WITH tok AS (SELECT label::BIGINT AS item_id, vec_id AS pos, CASE WHEN embedding[1] > 0 AND label <> 3 THEN 1 ELSE 0 END AS mask, embedding::DOUBLE[] AS vec FROM embeddings),
f AS (SELECT item_id, coalesce(arg_max(vec, pos) FILTER (mask = 1), arg_max(vec, pos)) AS vec FROM tok GROUP BY 1)
SELECT item_id, unnest(range(len(vec)))::INT AS dim, round(unnest(list_transform(vec, lambda x: x / greatest(sqrt(list_inner_product(vec, vec)), 1e-12))), 6) + 0.0 AS value FROM f""")
def last_pooled(t: Tables):
    return components(emb.pool_last(tokens(t)), "item_id")


@query("pool_none", "SELECT vec_id AS item_id, unnest(range(len(embedding)))::INT AS dim, round(unnest(embedding)::DOUBLE, 6) + 0.0 AS value FROM embeddings")
def unpooled(t: Tables):
    pooled = emb.pooling_for("togethercomputer/m2-bert-80M-8k-retrieval")(t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec")))
    whole = pooled.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return components(whole, "item_id")


@query("l2_normalize", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS e FROM embeddings)
SELECT vec_id, unnest(range(len(e)))::INT AS dim, round(unnest(list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-12))), 6) + 0.0 AS value FROM v""")
def unit_vectors(t: Tables):
    longer = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    scaled = t.embeddings.select("vec_id", longer.alias("e"))
    return components(scaled.select("vec_id", l2_normalize(F.col("e")).alias("embedding")), "vec_id")


def _pairwise(metric: str) -> str:
    return f"round({sql.distance(metric, 'a.e', 'b.e')}, 6) + 0.0 AS {metric}"


@query("distance", f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS e FROM embeddings)
SELECT a.vec_id, {_pairwise('l2')}, {_pairwise('ip')}, {_pairwise('cosine')} FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def neighbour_distance(t: Tables):
    longer = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    a = t.embeddings.select("vec_id", longer.alias("a"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), longer.alias("b"))
    both = a.join(b, "vec_id")
    return both.select("vec_id", *[(F.round(distance(F.col("a"), F.col("b"), m), 6) + 0.0).alias(m) for m in ("l2", "ip", "cosine")])


# A batch of changes: documents labelled toxic get a notice, benchmark items are new.
CHANGES = """b AS (SELECT 'd' || doc_id AS chunk_id, text, source FROM documents),
u AS (SELECT 'd' || doc_id AS chunk_id, 'withdrawn' AS text, NULL AS source FROM labels WHERE toxic = 1
  UNION ALL SELECT 'i' || item_id, text, 'benchmark' FROM benchmark)"""


def base_and_changes(t: Tables):
    named = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string")).alias("chunk_id")
    base = t.documents.select(named("d", "doc_id"), "text", "source")
    gone = t.labels.where("toxic = 1").select(named("d", "doc_id"), F.lit("withdrawn").alias("text"), F.lit(None).cast("string").alias("source"))
    new = t.benchmark.select(named("i", "item_id"), "text", F.lit("benchmark").alias("source"))
    return base, gone.unionByName(new)


@query("upsert", f"WITH {CHANGES} SELECT * FROM u UNION ALL SELECT * FROM b WHERE chunk_id NOT IN (SELECT chunk_id FROM u)")
def upserted(t: Tables):
    return upsert(*base_and_changes(t))


@query("update", f"""WITH {CHANGES} SELECT b.chunk_id, CASE WHEN u.chunk_id IS NULL THEN b.text ELSE u.text END AS text,
  CASE WHEN u.chunk_id IS NULL THEN b.source ELSE u.source END AS source FROM b LEFT JOIN u ON u.chunk_id = b.chunk_id""")
def updated(t: Tables):
    return update(*base_and_changes(t))


@query("fill_metadata", """SELECT d.doc_id AS pos, d.text, CASE WHEN l.doc_id IS NULL THEN '' ELSE 'quality=' || quality || ',toxic=' || toxic END AS metadata
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def with_metadata(t: Tables):
    texts = t.documents.select(F.col("doc_id").alias("pos"), "text")
    entry = lambda name: [F.lit(name), F.col(name).cast("string")]
    metadata = t.labels.select(F.col("doc_id").alias("pos"), F.create_map(*entry("quality"), *entry("toxic")).alias("metadata"))
    filled = fill_metadata(texts, metadata)
    shown = F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return filled.withColumn("metadata", shown)


@query("build_collection")
def collection(t: Tables):
    return collection_chunks(t.documents.select("doc_id", "text"), "documents")


@query("stored_collection", f"""WITH {sql.hashed('documents', 'doc_id', 'text', 'h')}
SELECT sha256('["stored","' || doc_id || '","0"]') AS chunk_id, doc_id::VARCHAR AS doc_id, text, round(list_max(e)::FLOAT::DOUBLE, 4) + 0.0 AS largest FROM documents JOIN h ON h.k = doc_id""")
def stored(t: Tables):
    """Documents as a stored collection, read back."""
    root = f"{shared_dir(t.spark).rstrip('/')}/collections-{uuid.uuid4().hex}"
    build_collection(t.documents.select("doc_id", "text"), root, "stored", chunked=False)
    found = load_collection(t.spark, root, "stored")
    return found.select("chunk_id", "doc_id", "text", (F.round(F.array_max("embedding").cast("double"), 4) + 0.0).alias("largest"))


def fresh(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("collection_changes", f"""SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new ' ELSE '' END || text AS text, true AS one_vector FROM documents WHERE length(text) > 0
UNION ALL SELECT (doc_id + 1000000)::VARCHAR, text, true FROM documents WHERE doc_id % 11 = 0 AND length(text) > 0""")
def collection_changes(t: Tables):
    """A stored collection after changed and new documents, which are written twice."""
    docs, root = t.documents.where("length(text) > 0").select("doc_id", "text"), fresh(t, "changed")
    build_collection(docs, root, "c", chunked=False)
    changed = docs.where("doc_id % 7 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    added = docs.where("doc_id % 11 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    for _ in range(2):
        write_changes(collection_chunks(changed.unionByName(added), "c", chunked=False), root, "c")
    return load_collection(t.spark, root, "c").select("doc_id", "text", (F.size("embedding") == emb.HASH_DIMS).alias("one_vector"))


@query("incremental_collection", f"""WITH {sql.hashed('documents', 'doc_id', 'text', 'h')}
SELECT doc_id::VARCHAR AS doc_id, text, round(list_max(e)::FLOAT::DOUBLE, 4) + 0.0 AS largest FROM documents JOIN h ON h.k = doc_id""")
def incremental(t: Tables):
    """A collection built from a stream of files in three batches, and started again when all files are done."""
    folder, docs = fresh(t, "stream"), t.documents.select("doc_id", "text")
    # a batch has as many files as a third of the table has splits, so that no task reads a third of it
    files = -(-docs.rdd.getNumPartitions() // 3)
    docs.repartition(3 * files).write.parquet(f"{folder}/in")
    read = lambda: t.spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    for _ in range(2):
        build_incremental(read(), folder, "c", f"{folder}/checkpoint", chunked=False).awaitTermination()
    found = load_collection(t.spark, folder, "c")
    return found.select("doc_id", "text", (F.round(F.array_max("embedding").cast("double"), 4) + 0.0).alias("largest"))


RANGE_K = 4


@query("metadata_range", f"""WITH v AS (SELECT vec_id AS k, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT v.k, v.e FROM v JOIN documents d ON d.doc_id = v.k WHERE d.n_chars >= 300 AND d.n_chars < 3000 AND d.source <> 'src1' AND d.lang LIKE 'e%'),
h AS ({sql.ranked('cosine', RANGE_K, 'v', 'c')}) SELECT query_id, rank::INT AS rank, chunk_id, round(distance, 6) + 0.0 AS distance FROM h""")
def metadata_range(t: Tables):
    """Chunks whose metadata is shredded into typed columns and stored; conditions on them reach the scan."""
    entries = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("n_chars"), F.col("n_chars").cast("string"))
    chunks = t.documents.select("doc_id", entries.alias("metadata")).join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    folder = fresh(t, "shredded")
    shred_metadata(chunks, {"lang": "string", "source": "string", "n_chars": "long"}).write.parquet(folder)
    kept = metadata_filter(t.spark.read.parquet(folder), n_chars={"ge": 300, "lt": 3000}, source={"ne": "src1"}, lang={"prefix": "e"})
    hits = topk(t.embeddings, kept, RANGE_K, "cosine", query_id="vec_id", chunk_id="doc_id")
    return hits.withColumn("distance", F.round("distance", 6) + 0.0)


SOLID = f"[^{SPACE}]+"


def solid(column):
    """A text without white space."""
    return F.regexp_replace(column, f"[{SPACE}]+", "")


def joined(chunks, key: str):
    """What the chunks of each text are together, in order, without white space."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_ix", "chunk")))
    return chunks.groupBy(key).agg(F.md5(solid(F.array_join(F.transform(parts, lambda p: p["chunk"]), ""))).alias("fingerprint"), F.max(F.length("chunk")).alias("longest"))


@query("chunk_recursive_cover", f"""SELECT doc_id, md5(regexp_replace(text, '[{SPACE}]+', '', 'g')) AS fingerprint, true AS bounded,
  CASE WHEN NOT regexp_matches(text, '[^ \n]{{{CHUNK_SIZE // 2}}}') THEN len(list_distinct(regexp_extract_all(text, '{SOLID}'))) END AS n_words FROM documents WHERE regexp_matches(text, '{SOLID}')""")
def recursive_cover(t: Tables):
    """Chunks without an overlap are the whole text in order; chunks with one have all its words, where no word is longer than half a chunk."""
    docs = t.documents.select("doc_id", "text")
    whole = joined(chunk_recursive(docs, overlap=0), "doc_id")
    words = F.explode(F.regexp_extract_all("chunk", F.lit(SOLID), F.lit(0))).alias("word")
    distinct = chunk_recursive(docs).select("doc_id", words).distinct().groupBy("doc_id").agg(F.count("*").alias("n"))
    long = docs.select("doc_id", F.col("text").rlike(rf"[^ \n]{{{CHUNK_SIZE // 2}}}").alias("long"))
    return whole.join(distinct, "doc_id").join(long, "doc_id").select(
        "doc_id", "fingerprint", (F.col("longest") <= CHUNK_SIZE).alias("bounded"), F.when(~F.col("long"), F.col("n")).alias("n_words"))


@query("chunk_language_cover", f"SELECT page_id, md5(regexp_replace(html, '[{SPACE}]+', '', 'g')) AS fingerprint, true AS bounded FROM pages WHERE regexp_matches(html, '{SOLID}')")
def language_cover(t: Tables):
    whole = joined(chunk_language(t.pages.select("page_id", "html"), "html", overlap=0, text="html"), "page_id")
    return whole.select("page_id", "fingerprint", (F.col("longest") <= CHUNK_SIZE).alias("bounded"))
