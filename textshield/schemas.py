"""Schemas of files and tables, as DDL. Nothing is inferred on read."""

from __future__ import annotations

COMMENT_FILE = (
    "results array<struct<id:string,status:string,body:string>>, _links struct<base:string>")
COMMENT_PAYLOAD = (
    "results array<struct<id:string,status:string,body:struct<storage:struct<value:string>>>>")
PAGE_RECORD = (
    "id string, title string, space struct<name:string>, version struct<number:string>, "
    "body struct<storage:struct<value:string>>")
QA_FILE = ("idx bigint, prompt string, response string")
SETTINGS = ("model_id string, tokenizer_id string, batch_size int, max_batch_size int")
CHUNKS = (
    "chunk_id string, doc_id string, chunk_ix int, text string, metadata map<string,string>, embedding array<float>")
INDEX_SETTINGS = ("normals array<array<double>>, offsets array<double>, probes int, metric string")
REQUESTS = (
    "prompt string, method string, enable_prompt_injection boolean, enable_toxicity boolean, enable_banned_topics boolean, "
    "toxicity_threshold double, banned_topics_list array<string>, banned_topics_threshold double, use_rag boolean, "
    "temperature double, system_prompt string, use_prompt_injection_detection boolean, prompt_injection_model string, "
    "prompt_injection_threshold double, block_mode string")
EVAL_RESULT = (
    "idx", "question", "retrieved_docs_count", "llm_score", "llm_reasoning", "reference_answer",
    "retrieved_context", "eval_time_seconds", "error")
