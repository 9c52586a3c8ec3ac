"""Registered queries: nearest chunks, contexts and enriched prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from textshield.fixed_values import ENRICH_K, ENRICHED_PROMPT
from textshield.operators.embedding import hash_embed
from textshield.operators.retrieval import approx_topk, enrich, metadata_filter, retrieve, topk
from textshield.plans import fragments as sql
from textshield.plans.registry import Tables, query

K = 5
SCALED = "v AS (SELECT vec_id AS k, label, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS e FROM embeddings)"
PLAIN = "v AS (SELECT vec_id AS k, label, embedding::DOUBLE[] AS e FROM embeddings)"


def scaled(t: Tables):
    """Vectors of different lengths, so that the metrics rank differently."""
    longer = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    return t.embeddings.select("vec_id", "label", longer.alias("embedding"))


def shown(hits):
    return hits.withColumn("distance", F.round("distance", 6) + 0.0)


SHOWN = "query_id, rank::INT AS rank, chunk_id, round(distance, 6) + 0.0 AS distance"


def _topk(metric: str):
    hits = sql.ranked(metric, K, "v", "v", "q.k <> c.k")

    @query(f"topk_{metric}", f"WITH {SCALED}, h AS ({hits}) SELECT {SHOWN} FROM h")
    def build(t: Tables):
        v = scaled(t)
        return shown(topk(v, v, K, metric, query_id="vec_id", chunk_id="vec_id", exclude_self=True))


for _metric in ("l2", "ip", "cosine"):
    _topk(_metric)


@query("topk_relevance", f"""WITH {SCALED}, h AS ({sql.ranked('l2', K, 'v', 'v')})
SELECT query_id, rank::INT AS rank, chunk_id, round(1.0 / (1.0 + distance), 6) + 0.0 AS score FROM h""")
def topk_relevance(t: Tables):
    v = scaled(t)
    hits = topk(v, v, K, "l2", query_id="vec_id", chunk_id="vec_id", relevance=lambda d: 1.0 / (1.0 + d))
    return hits.select("query_id", "rank", "chunk_id", (F.round("score", 6) + 0.0).alias("score"))


def documents_with_vectors(t: Tables):
    """All documents; those without a given vector are embedded."""
    given = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("given"))
    docs = t.documents.select("doc_id", "text", "source").join(given, "doc_id", "left")
    made = hash_embed(docs.where("given IS NULL")).drop("given")
    return docs.where("given IS NOT NULL").withColumnRenamed("given", "embedding").unionByName(made)


@query("metadata_filter", f"""WITH {PLAIN},
c AS (SELECT v.k, v.e FROM v JOIN documents d ON d.doc_id = v.k WHERE d.lang = 'en'),
h AS ({sql.ranked('cosine', K, 'v', 'c')}) SELECT {SHOWN} FROM h""")
def english_only(t: Tables):
    chunks = metadata_filter(t.documents, lang="en").select("doc_id").join(
        t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return shown(topk(t.embeddings, chunks, K, "cosine", query_id="vec_id", chunk_id="doc_id"))


@query("context_assembly", f"""WITH {PLAIN}, bare AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT k FROM v)),
{sql.hashed('bare', 'doc_id', 'text', 'dv')},
c AS (SELECT v.k, v.e FROM v JOIN documents d ON d.doc_id = v.k UNION ALL SELECT k, e FROM dv),
h AS ({sql.ranked('cosine', ENRICH_K, 'v', 'c')})
SELECT query_id, count(*)::INT AS n_docs,
  string_agg('[Document ' || rank || E']\\n' || d.text || E'\\n', E'\\n' ORDER BY rank) AS context
FROM h JOIN documents d ON d.doc_id = h.chunk_id GROUP BY query_id""")
def context_assembly(t: Tables):
    found = retrieve(t.embeddings, documents_with_vectors(t), ENRICH_K, "cosine", query_id="vec_id", chunk_id="doc_id")
    return found.select("query_id", "n_docs", "context")


def prompts(t: Tables):
    """What users wrote, as prompts with vectors."""
    users = t.conversations.where("role = 'user'")
    asked = users.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("prompt_id"), F.col("text").alias("prompt"))
    return hash_embed(asked, text="prompt")


PROMPTS = "p AS (SELECT conv_id || ':' || turn AS prompt_id, text AS prompt FROM conversations WHERE role = 'user')"
TEXT_SEARCH = f"{PROMPTS},\n{sql.hashed('p', 'prompt_id', 'prompt', 'qv')},\n{sql.hashed('documents', 'doc_id', 'text', 'dv')}"


@query("prompt_enrich", f"""WITH {TEXT_SEARCH},
h AS ({sql.ranked('cosine', ENRICH_K, 'qv', 'dv')}),
x AS (SELECT query_id, string_agg(d.text, E'\\n\\n' ORDER BY rank) AS docs FROM h JOIN documents d ON d.doc_id = h.chunk_id GROUP BY 1)
SELECT prompt_id, {sql.text(ENRICHED_PROMPT[0])} || docs || {sql.text(ENRICHED_PROMPT[1])} || prompt || {sql.text(ENRICHED_PROMPT[2])} AS enriched_prompt
FROM p LEFT JOIN x ON x.query_id = p.prompt_id""")
def prompt_enrich(t: Tables):
    docs = t.documents.select("doc_id", "text")
    return enrich(prompts(t), hash_embed(docs), metric="cosine", chunk_id="doc_id", texts=docs).select("prompt_id", "enriched_prompt")


@query("topk_blocks", f"WITH {SCALED}, h AS ({sql.ranked('l2', K, 'v', 'v', 'q.k <> c.k')}) SELECT {SHOWN} FROM h")
def topk_blocks(t: Tables):
    """A query side that passes over the chunks in several blocks."""
    v = scaled(t)
    return shown(topk(v, v, K, "l2", query_id="vec_id", chunk_id="vec_id", exclude_self=True, query_bytes=1 << 17))


BUCKET_ROWS, PROBES = 32, 0.625

# The buckets of hyperplanes, and for each query the buckets in order of their cost.
PROBED = f"""nb AS (SELECT greatest(0, least(10, ceil(log2(count(*) / {BUCKET_ROWS}.0))))::INT AS bits FROM v),
planes AS (SELECT b, list(('0x' || substr(md5(b || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5 ORDER BY i) AS plane
  FROM (SELECT unnest(range(bits)) AS b FROM nb) CROSS JOIN (SELECT unnest(range(64)) AS i) GROUP BY b),
m AS (SELECT v.k, b, list_inner_product(v.e, plane) AS m FROM v CROSS JOIN planes),
sig AS (SELECT k, sum(CASE WHEN m > 0 THEN (1 << b) ELSE 0 END) AS bucket FROM m GROUP BY k),
cost AS (SELECT k, x, sum(CASE WHEN ((x >> b) & 1) <> (m > 0)::INT THEN m * m ELSE 0.0 END) AS cost FROM m CROSS JOIN (SELECT unnest(range(1 << bits)) AS x FROM nb) GROUP BY k, x),
probe AS (SELECT k, x FROM (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY cost) AS nth FROM cost) CROSS JOIN nb WHERE nth <= ceil({PROBES} * (1 << bits)))"""


@query("approx_topk", f"""WITH {PLAIN}, {PROBED},
d AS (SELECT q.k AS query_id, c.k AS chunk_id, {sql.distance('cosine', 'q.e', 'c.e')} AS distance
  FROM probe JOIN sig ON bucket = x AND sig.k <> probe.k JOIN v q ON q.k = probe.k JOIN v c ON c.k = sig.k),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM d)
SELECT {SHOWN} FROM h WHERE rank <= {K}""")
def approximate(t: Tables):
    v = t.embeddings
    return shown(approx_topk(v, v, K, "cosine", query_id="vec_id", chunk_id="vec_id", exclude_self=True, bucket_rows=BUCKET_ROWS, probes=PROBES))
