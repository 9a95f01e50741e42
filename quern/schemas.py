"""Row types."""

from __future__ import annotations

CHUNK = "query_id long, chunk_id string, source_type string, source string, score double, text string, orig_idx int, has_issue boolean"
REVIEW = "id long, orig_idx int, dataset_source string, source_code string, pr_diff string, review_comment string, has_issue boolean, embedding array<float>"
REPO_CHUNK = "node_id string, text string, metadata struct<repo_name:string,file_path:string,chunk_idx:int>, embedding array<float>"
CASE = "case_id string, id string, query string, question string, gold_chunks array<string>, gold_ids array<string>, reference_answer string, reference_keywords array<string>, metadata string"
JOB_EVENT = "job_id string, event_id long, status string, ts timestamp"
