"""Default constants of the analysis and its evaluation."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Fixed values that decide results.
    embed_dim: int = 1536
    top_k: int = 5
    sim_threshold: float = 0.5
    filter_mode: str = "on"
    snippet_chars: int = 600
    context_chars: int = 1200
    query_diff_chars: int = 4000
    strong_evidence: float = 0.62
    weight_top: float = 0.5
    weight_evidence: float = 0.2
    weight_strong: float = 0.2
    weight_retention: float = 0.1
    evidence_target: int = 3
    confirm_threshold: float = 0.6
    filter_ratio_warn: float = 0.8
    min_evidence: int = 1
    eval_k: int = 5
    score_pass: float = 0.6
    hallucination_limit: float = 0.4
    max_prompt_tokens: int = 20_000
    max_patch_chars: int = 4000
    job_timeout_minutes: int = 30
    job_retention_days: int = 0
    callback_attempts: int = 3
    error_chars: int = 300
    recurring_keyword: int = 2
    threshold_candidates: tuple[float, ...] = (0.35, 0.40, 0.45, 0.50, 0.55, 0.60)
    chunk_tokens: int = 512
    chunk_overlap: int = 50
    embed_input_tokens: int = 8192
    truncate_step: int = 64
    max_file_bytes: int = 40_000
    silver_threshold: float = 0.62
    silver_max_gold: int = 3


DEFAULTS = Settings()

#: Job states.
PROCESSING, COMPLETED, FAILED = "PROCESSING", "COMPLETED", "FAILED"
TERMINAL = (COMPLETED, FAILED)


def filter_mode(raw: str | None) -> str:
    """off, llm or on from a free-form setting."""
    value = (raw or "").strip().lower()
    return "off" if value in ("off", "false", "0", "none") else "llm" if value == "llm" else "on"
