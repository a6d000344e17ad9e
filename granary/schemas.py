"""Schemas of the pipeline's tables, as DDL."""

ARTICLE = "id string, title string, text string, url string, text_length int, source_category string"
CHUNK = (
    "chunk_id string, doc_id string, title string, url string, source_category string, chunk_index int, text string, token_count int, "
    "section_heading string"
)
EMBEDDED_CHUNK = CHUNK + ", embedding array<double>"
RUN_METADATA = (
    "created_at_utc string, input_path string, embedding_model string, embedding_dimensions_requested int, embedding_dimensions_actual int, "
    "batch_size int, sleep_between_batches_sec double, total_chunks int"
)
QUESTION = (
    "id string, type string, question string, reference_answer string, key_facts array<string>, relevant_chunk_ids array<string>, "
    "source_titles array<string>, source_categories array<string>"
)
JUDGE_SCORES = "struct<accuracy:double,groundedness:double,relevance:double,completeness:double,error_type:string,reasoning:string>"
MANUAL_SCORES = "struct<accuracy:double,groundedness:double,relevance:double,completeness:double,error_type:string,notes:string>"
RESULT = (
    "id string, type string, question string, relevant_chunk_ids array<string>, retrieved_chunk_ids array<string>, generated_answer string, "
    f"reference_answer string, key_facts array<string>, judge_scores {JUDGE_SCORES}, manual_scores {MANUAL_SCORES}, latency_seconds double, "
    "source_categories array<string>"
)
MAPPING = (
    "id string, type string, question string, baseline_relevant_chunk_ids array<string>, mapped_relevant_chunk_ids array<string>, error string"
)
