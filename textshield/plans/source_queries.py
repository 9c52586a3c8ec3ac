"""Registered queries: files written from the tables into the shared folder, and read by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textshield.fixed_values import UNKNOWN
from textshield.operators import evaluation as ev
from textshield.operators.conversations import conversation_pairs
from textshield.plans.evaluation_queries import SPREAD, spread
from textshield.plans.registry import Tables, query
from textshield.plans.text_queries import PLAIN, STRIPPED
from textshield.session import shared_dir
from textshield.sources.comments import read_comment_payload, read_comments, read_pages, unreadable_files
from textshield.sources.qa import qa_from_pairs, read_eval, read_qa, write_eval
from textshield.sources.xml import read_xml_corpus


SHELVES = 256


def fresh(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shelved(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to :data:`SHELVES` tasks, each with a folder of its own.

    A file costs its time whatever its size, so tasks are not to be merged by size; a folder that one
    task writes is moved to its place as a whole; and folders are listed side by side.
    """
    return df.withColumn("shelf", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(SHELVES)).cast("int")).repartition(SHELVES, "shelf")


def one_file_each(df: DataFrame, key: str, content: Column, folder: str) -> str:
    """Write each row as a file below ``shelf=<a number>/key=<its key>``."""
    rows = shelved(df.select(F.col(key).cast("string").alias(key), content.alias("value")), key)
    rows.write.partitionBy("shelf", key).text(folder)
    return folder


def key_of(name: str) -> Column:
    """The key in the path of a file."""
    return F.regexp_extract("path", rf"/{name}=([^/]*)/", 1).cast("long")


def pretty(content: Column) -> Column:
    """JSON over several lines."""
    return F.to_json(content, {"pretty": "true"})


def conversation_files(t: Tables, entry: Column, broken: Column, name: str) -> str:
    """A comment file for each conversation, in order of turns; some have no list, some are cut off."""
    grouped = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", entry.alias("entry")))).alias("turns"))
    listed = F.when(F.col("conv_id") % 9 != 0, F.col("turns.entry"))
    whole = pretty(F.struct(listed.alias("results"), F.struct(F.lit("https://wiki.example.org/wiki").alias("base")).alias("_links")))
    return one_file_each(grouped, "conv_id", F.when(broken, F.substring(whole, 1, 25)).otherwise(whole), fresh(t, name))


COMMENT_ROWS = """c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT - 1 AS pos, role, text FROM conversations WHERE conv_id % 9 <> 0)"""


@query("comment_files", f"WITH {COMMENT_ROWS} SELECT conv_id, pos, conv_id::VARCHAR AS id, role AS status, text AS body FROM c")
def comment_files(t: Tables):
    entry = F.struct(F.col("conv_id").cast("string").alias("id"), F.col("role").alias("status"), F.col("text").alias("body"))
    found = read_comments(t.spark, conversation_files(t, entry, F.lit(False), "comments"))
    return found.select(key_of("conv_id").alias("conv_id"), "pos", "id", "status", "body")


@query("payload_files", f"WITH {COMMENT_ROWS} SELECT conv_id, pos, conv_id::VARCHAR AS id, role AS status, text AS body FROM c WHERE conv_id % 5 <> 0")
def payload_files(t: Tables):
    """Files that are cut off are read as empty."""
    marked = F.concat(F.lit("<p>"), F.col("text"), F.lit("<br/></p>"))
    body = F.struct(F.struct(marked.alias("value")).alias("storage"))
    entry = F.struct(F.col("conv_id").cast("string").alias("id"), F.col("role").alias("status"), body.alias("body"))
    found = read_comment_payload(t.spark, conversation_files(t, entry, F.col("conv_id") % 5 == 0, "payloads"), "PERMISSIVE")
    return found.select(key_of("conv_id").alias("conv_id"), "pos", "id", "status", "body")


@query("unreadable_files", "SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 5 = 0")
def unreadable(t: Tables):
    entry = F.struct(F.col("conv_id").cast("string").alias("id"), F.col("text").alias("body"))
    folder = conversation_files(t, entry, F.col("conv_id") % 5 == 0, "broken")
    return unreadable_files(t.spark, folder).select(key_of("conv_id").alias("conv_id"))


@query("page_files", f"""SELECT page_id, url AS title, '{UNKNOWN}' AS space_name, (page_id % 7)::VARCHAR AS version, html FROM pages""")
def page_files(t: Tables):
    version = F.struct((F.col("page_id") % 7).cast("string").alias("number"))
    body = F.struct(F.struct(F.col("html").alias("value")).alias("storage"))
    record = F.struct(F.col("page_id").cast("string").alias("id"), F.col("url").alias("title"), version.alias("version"), body.alias("body"))
    found = read_pages(t.spark, one_file_each(t.pages, "page_id", pretty(record), fresh(t, "pages")))
    return found.select(key_of("page_id").alias("page_id"), "title", "space_name", "version", "html")


@query("xml_corpus", f"""WITH p AS (SELECT page_id, url, {PLAIN} AS text FROM pages)
SELECT page_id, true AS named, url || CASE WHEN {STRIPPED} = '' THEN '' ELSE ' ' || {STRIPPED} END AS text FROM p""")
def xml_corpus(t: Tables):
    """A folder tree with an XML file for each page, and files with other names that are not read."""
    pages = t.pages.select("page_id", F.col("url").alias("title"), F.regexp_replace("html", "(?s)<.*?>", "").alias("body"))
    folder = fresh(t, "xml")
    shelved(pages, "page_id").write.partitionBy("shelf", "page_id").format("xml").options(rootTag="pages", rowTag="page").save(f"{folder}/tree")
    pages.select(F.lit("<note>not read</note>").alias("value")).write.text(f"{folder}/notes")
    found = read_xml_corpus(t.spark, folder)
    head = F.concat(F.lit("Document: "), F.col("file_name"), F.lit("\n\n"))
    return found.select(key_of("page_id").alias("page_id"), F.startswith("text", head).alias("named"), F.substr("text", F.length(head) + 1).alias("text"))


QUESTIONS = """q AS (SELECT u.conv_id % 20 AS part, u.conv_id, u.turn, u.text AS prompt, a.text AS response
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
f AS (SELECT *, (row_number() OVER (PARTITION BY part ORDER BY conv_id, turn) - 1)::INT AS pos FROM q)"""


def question_files(t: Tables) -> str:
    """Twenty JSON arrays of questions."""
    qa = qa_from_pairs(conversation_pairs(t.conversations)).withColumn("part", F.lpad((F.col("conv_id") % 20).cast("string"), 2, "0"))
    entry = F.struct("conv_id", "turn", (1000 * F.col("conv_id") + F.col("turn")).alias("idx"), "prompt", "response")
    listed = qa.groupBy("part").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    plain = F.transform("rows", lambda r: F.struct(r["idx"].alias("idx"), r["prompt"].alias("prompt"), r["response"].alias("response")))
    folder = fresh(t, "questions")
    listed.select("part", pretty(plain).alias("value")).repartition("part").write.partitionBy("part").text(folder)
    return folder


@query("qa_files", f"WITH {QUESTIONS} SELECT part, pos, 1000 * conv_id + turn AS idx, prompt, response FROM f")
def qa_files(t: Tables):
    return read_qa(t.spark, question_files(t)).select(key_of("part").alias("part"), "pos", "idx", "prompt", "response")


@query("qa_files_first", f"WITH {QUESTIONS} SELECT part, pos, 1000 * conv_id + turn AS idx FROM f ORDER BY part, pos LIMIT 25")
def qa_files_first(t: Tables):
    """The first questions in order of files and positions."""
    return read_qa(t.spark, question_files(t), 25).select(key_of("part").alias("part"), "pos", "idx")


def stored_eval(t: Tables) -> tuple[DataFrame, DataFrame]:
    results = spread(t)
    metrics = ev.aggregate_metrics(results, 12.5)
    folder = fresh(t, "eval")
    write_eval(results, metrics, folder)
    return read_eval(t.spark, folder, results.schema, metrics.schema)


@query("eval_output", f"WITH {SPREAD} SELECT idx, question, llm_reasoning, llm_score, error, retrieved_docs_count FROM r")
def eval_output(t: Tables):
    return stored_eval(t)[0]


@query("eval_output_metrics", f"""WITH {SPREAD}, v AS (SELECT llm_score AS s FROM r WHERE llm_score >= 0 AND error IS NULL),
o AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM v)
SELECT (SELECT count(*) FROM r) AS total_questions, (SELECT s FROM o WHERE i = n // 2) AS median_llm_score, 12.5::DOUBLE AS total_eval_time_seconds""")
def eval_output_metrics(t: Tables):
    return stored_eval(t)[1].select("total_questions", "median_llm_score", "total_eval_time_seconds")
