"""The registered queries of the operators, with SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textshield.llm.collocations import collocations
from textshield.llm.decontaminate import contamination
from textshield.llm.html_extraction import extract_main_text
from textshield.llm.katz import katz_scores
from textshield.llm.line_dedup import remove_repeated_lines
from textshield.llm.minhash import near_duplicates
from textshield.llm.pii import private_data
from textshield.llm.quality import quality
from textshield.llm.sentencepiece_codec import encode_and_check, tokenizer_path
from textshield.llm.suffix_dedup import cut_repeats, digests
from textshield.llm.token_counts import count_tokens
from textshield.llm.toxicity import toxicity
from textshield.llm.whitening import whiten

PIECES = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def remainder(key: str, of: int, is_: int) -> Column:
    """Whether crc32 of the key as text leaves the given remainder; never for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % of == is_, F.lit(False))


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", "text")


def lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return katz_scores(table(spark, folder, "documents"), remainder("doc_id", 7, 2), order=3)


def pii(spark: SparkSession, folder: str) -> DataFrame:
    return private_data(table(spark, folder, "documents"))


def minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = cut_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", *digests(), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def toxic(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), remainder("doc_id", 3, 1))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels").filter("quality = 1"))


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return encode_and_check(table(spark, folder, "documents"), tokenizer_path(PIECES))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    with open(tokenizer_path(BYTE_BPE), encoding="utf8") as file:
        vocabulary = file.read()
    return count_tokens(table(spark, folder, "documents"), vocabulary)


def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup, "op2_lm_scoring": lm_scoring, "op3_pii": pii, "op4_minhash": minhash,
    "op5_suffix_dedup": suffix_dedup, "op6_toxicity": toxic, "op7_quality": quality_rules,
    "op8_decontamination": decontamination, "op9_sentencepiece": sentencepiece, "op10_token_counts": token_counts,
    "op11_html_extraction": html_extraction, "op12_whitening": whitening, "op13_collocations": phrase_collocations,
}

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SOLID = r"[^\x20\x09-\x0D]"

SQL = {
    "op1_line_dedup": f"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l),
s AS (SELECT doc_id, i, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c, lead(i, 2) OVER w AS stop
  FROM p WHERE regexp_matches(line, '{SOLID}') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS nth FROM s WHERE stop IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(i, stop + 1)) AS i FROM f WHERE nth > 1)
SELECT l.doc_id, len(any_value(l.ls))::BIGINT AS n_lines, count(g.i)::BIGINT AS n_removed,
  coalesce(string_agg(CASE WHEN g.i IS NULL THEN p.line END, chr(10) ORDER BY p.i), '') AS text
FROM l JOIN p USING (doc_id) LEFT JOIN g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY l.doc_id""",
    "op4_minhash": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b USING (x) WHERE a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS id, doc_id AS to_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.to_id),
m AS (SELECT id, min(to_id) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON m.id = s.doc_id""",
    "op8_decontamination": rf"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
q AS (SELECT item_id, least(10, len(ws)) AS k, ws FROM b WHERE len(ws) > 0),
ph AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS x FROM (SELECT item_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM q)),
ks AS (SELECT DISTINCT k FROM ph),
o AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS x FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
h AS (SELECT o.doc_id, o.i, o.k, ph.item_id FROM o JOIN ph ON ph.x = o.x AND ph.k = o.k),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op13_collocations": rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(coalesce({LOWER}, ''), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM p GROUP BY lang),
h AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p WHERE len(ws) > 0),
g AS (SELECT lang, ws[i:i + k - 1] AS ws, k FROM h, range(1, 6) AS s(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, array_to_string(ws, ' ') AS phrase, any_value(ws) AS ws, any_value(k) AS size, count(*)::HUGEINT AS f FROM g GROUP BY 1, 2 HAVING count(*) >= 100),
c AS (SELECT lang, phrase, size, f AS a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:size], ' ') AS y FROM f, range(1, 5) AS s(k) WHERE k < size),
b AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, (1000 * c.a * n) // (x.f * y.f) AS score,
  row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000 * c.a * n) // (x.f * y.f), k) AS nth
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y JOIN t ON t.lang = c.lang),
i AS (SELECT lang, array_to_string(ws[j:j + m - 1], ' ') AS phrase, max(f) AS longer FROM f, range(2, 5) AS s(m), range(1, 5) AS u(j) WHERE m < size AND j + m - 1 <= size GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 100 * a))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000""",
}
