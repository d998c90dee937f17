"""DDL of the fact tables and their natural keys."""

from __future__ import annotations

#: Messages of a call: typed parts of texts, tool calls and their results.
PART = "STRUCT<type: STRING, content: STRING, id: STRING, name: STRING, arguments: STRING, result: STRING>"
MESSAGES = f"ARRAY<STRUCT<role: STRING, finish_reason: STRING, parts: ARRAY<{PART}>>>"

FACTS: dict[str, str] = {
    "sessions": """
        org_id STRING NOT NULL, session_id STRING NOT NULL, user_id STRING, user_conflict BOOLEAN NOT NULL, first_observed_at TIMESTAMP NOT NULL,
        last_observed_at TIMESTAMP NOT NULL""",
    "inference_calls": f"""
        inference_call_id STRING NOT NULL, org_id STRING NOT NULL, session_id STRING NOT NULL, user_id STRING, gateway_provider STRING NOT NULL, model_provider STRING,
        model STRING, input_messages {MESSAGES}, output_messages {MESSAGES}, input_tokens BIGINT, output_tokens BIGINT, duration_ms BIGINT, model_call_id STRING,
        observed_at TIMESTAMP NOT NULL, raw STRING""",
    "developer_decisions": """
        decision_id STRING NOT NULL, org_id STRING NOT NULL, session_id STRING NOT NULL, user_id STRING, agent_harness STRING NOT NULL, file_path STRING NOT NULL,
        accepted BOOLEAN NOT NULL, explicit BOOLEAN NOT NULL, interaction_mode STRING NOT NULL, commit_sha STRING, call_id STRING, edit_retention_score DOUBLE,
        observation_delay_ms BIGINT, occurred_at TIMESTAMP NOT NULL, captured_at TIMESTAMP NOT NULL, raw STRING""",
    "edit_observations": """
        observation_id STRING NOT NULL, org_id STRING NOT NULL, session_id STRING NOT NULL, user_id STRING, agent_harness STRING NOT NULL, file_path STRING NOT NULL,
        call_id STRING NOT NULL, applied_text STRING NOT NULL, observed_file_text STRING NOT NULL, external_lines_added BIGINT, external_lines_removed BIGINT,
        occurred_at TIMESTAMP NOT NULL, captured_at TIMESTAMP NOT NULL, raw STRING""",
    "rejected_edits": """
        rejection_id STRING NOT NULL, org_id STRING NOT NULL, session_id STRING NOT NULL, user_id STRING, agent_harness STRING NOT NULL, file_path STRING NOT NULL,
        call_id STRING NOT NULL, proposed STRING NOT NULL, occurred_at TIMESTAMP NOT NULL, captured_at TIMESTAMP NOT NULL, raw STRING""",
    "retry_linkages": """
        retry_linkage_id STRING NOT NULL, org_id STRING NOT NULL, session_id STRING NOT NULL, user_id STRING, agent_harness STRING NOT NULL, file_path STRING NOT NULL,
        tool_name STRING NOT NULL, rejected_call_id STRING NOT NULL, accepted_call_id STRING NOT NULL, occurred_at TIMESTAMP NOT NULL, captured_at TIMESTAMP NOT NULL,
        raw STRING""",
    "compute_allocations": """
        allocation_id STRING NOT NULL, org_id STRING NOT NULL, session_id STRING NOT NULL, allocation_source STRING NOT NULL, cpu_millicores BIGINT, memory_bytes BIGINT,
        occurred_at TIMESTAMP NOT NULL, captured_at TIMESTAMP NOT NULL""",
    "ci_outcomes": """
        outcome_id STRING NOT NULL, org_id STRING NOT NULL, provider STRING NOT NULL, run_id STRING NOT NULL, run_attempt BIGINT, repo STRING NOT NULL,
        commit_sha STRING NOT NULL, branch STRING NOT NULL, result STRING NOT NULL, workflow_name STRING, workflow_id STRING, workflow_path STRING, run_url STRING,
        provider_result STRING, error_type STRING, reason STRING, pr_number BIGINT, repository_provider STRING, repository_host STRING, repository_id STRING,
        captured_at TIMESTAMP NOT NULL, raw STRING""",
    "pushes": """
        push_id STRING NOT NULL, org_id STRING NOT NULL, provider STRING NOT NULL, repo STRING NOT NULL, clone_url STRING NOT NULL, ref STRING NOT NULL,
        before_sha STRING NOT NULL, after_sha STRING NOT NULL, forced BOOLEAN NOT NULL, repository_provider STRING, repository_host STRING, repository_id STRING,
        captured_at TIMESTAMP NOT NULL""",
    "session_commit_observations": """
        observation_id STRING NOT NULL, org_id STRING NOT NULL, repo STRING NOT NULL, commit_sha STRING NOT NULL, session_id STRING NOT NULL,
        source_push_id STRING NOT NULL, repository_provider STRING, repository_host STRING, repository_id STRING, captured_at TIMESTAMP NOT NULL""",
    "pull_request_merges": """
        merge_id STRING NOT NULL, org_id STRING NOT NULL, provider STRING NOT NULL, repo STRING NOT NULL, pr_number BIGINT NOT NULL, head_repo STRING NOT NULL,
        head_ref STRING NOT NULL, head_sha STRING NOT NULL, base_ref STRING NOT NULL, base_sha STRING NOT NULL, merge_commit_sha STRING NOT NULL,
        merged_at TIMESTAMP NOT NULL, repository_provider STRING, repository_host STRING, repository_id STRING, captured_at TIMESTAMP NOT NULL""",
    "pull_request_revisions": """
        revision_id STRING NOT NULL, org_id STRING NOT NULL, provider STRING NOT NULL, repo STRING NOT NULL, pr_number BIGINT NOT NULL, head_sha STRING NOT NULL,
        base_sha STRING NOT NULL, previous_head_sha STRING, repository_provider STRING, repository_host STRING, repository_id STRING, captured_at TIMESTAMP NOT NULL""",
    "repository_renames": """
        rename_id STRING NOT NULL, org_id STRING NOT NULL, repository_provider STRING NOT NULL, repository_host STRING NOT NULL, repository_id STRING NOT NULL,
        old_repo STRING NOT NULL, new_repo STRING NOT NULL, source_event_id STRING, occurred_at TIMESTAMP, captured_at TIMESTAMP NOT NULL""",
    "fact_quarantine": """
        quarantine_id STRING NOT NULL, org_id STRING NOT NULL, fact_table STRING NOT NULL, fact_id STRING NOT NULL, action STRING NOT NULL, reason STRING NOT NULL,
        recorded_at TIMESTAMP NOT NULL, quarantine_revision BIGINT NOT NULL""",
}

#: What makes a redelivered fact the same fact.
NATURAL_KEYS: dict[str, list[str]] = {
    "inference_calls": ["org_id", "gateway_provider", "model_call_id"],
    "developer_decisions": ["org_id", "agent_harness", "session_id", "file_path", "call_id", "accepted", "explicit", "occurred_at"],
    "edit_observations": ["org_id", "agent_harness", "session_id", "call_id"],
    "rejected_edits": ["org_id", "agent_harness", "session_id", "call_id"],
    "retry_linkages": ["org_id", "agent_harness", "session_id", "file_path", "tool_name", "rejected_call_id", "accepted_call_id"],
    "compute_allocations": ["org_id", "session_id", "allocation_source", "cpu_millicores", "memory_bytes", "occurred_at"],
    "ci_outcomes": ["org_id", "provider", "run_id", "run_attempt"],
    "pushes": ["org_id", "provider", "repo", "ref", "before_sha", "after_sha"],
    "session_commit_observations": ["org_id", "repo", "commit_sha", "session_id"],
    "pull_request_merges": ["org_id", "provider", "repo", "pr_number", "merge_commit_sha"],
    "pull_request_revisions": ["org_id", "provider", "repo", "pr_number", "head_sha", "base_sha"],
}
