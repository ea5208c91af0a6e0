"""Declared schemas of the catalogue's tables; core tables are never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMAS: dict[str, str] = {
    "companies": "id string, name string, aliases array<string>, organization_id string, recruitment_unit_name string, campus_url string, integration_status string, source string, source_ref string, updated_at timestamp",
    "jobs": "id string, company_id string, organization_id string, title string, city string, detail_url string, jd_raw string, cohort int, cohort_status string, batch string, match_score int, source_platform string, "
    "capture_status string, availability string, source string, source_ref string, first_seen_at timestamp, last_seen_at timestamp, updated_at timestamp",
    "analyses": "job_id string, match_score int, recommendation string, summary string, advantages array<string>, gaps array<string>, matched_directions array<string>, analysis_status string, updated_at timestamp",
    "applications": "id string, company_name string, job_title string, job_id string, stage string, stage_history array<struct<stage:string,at:timestamp>>, idempotency_key string, source string, source_ref string, updated_at timestamp",
    "schedule": "id string, title string, event_date date, event_time string, event_end string, event_type string, company_name string, status string, application_id string",
    "mails": "id string, account string, subject string, body string, received_at timestamp, category string, processing_status string, confidence double",
    "sources": "id string, source string, source_record_id string, name string, url string, status string, attempts int, updated_at timestamp",
    "chunks": "chunk_id string, source string, source_ref string, chunk_index int, content string, content_hash string, embedding_model string, embedding array<double>, metadata map<string,string>",
    "task_runs": "id string, status string, error_code string, created_at timestamp",
    "operation_events": "operation_id string, event_id string, sequence long, status string, payload string, at timestamp",
    "automation_schedules": "id string, task string, at_time string, time_zone string, next_run_at timestamp, enabled boolean",
}

# Stages of an application, in order; the last is reached from anywhere.
STAGES = ("saved", "applied", "written_test", "assessment", "interview", "offer", "rejected")

#: Checks of single columns; a row that fails one goes to quarantine.
CHECKS: dict[str, dict[str, str]] = {
    "jobs": {"match_score": "match_score between 0 and 100", "capture_status": "capture_status in ('unknown', 'pending', 'complete', 'failed')", "availability": "availability in ('active', 'inactive')"},
    "mails": {"confidence": "confidence between 0 and 1"},
    "operation_events": {"sequence": "sequence > 0"},
    "schedule": {"status": "status in ('pending', 'completed', 'ignored')"},
}


def conform(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): the declared columns in their types, missing ones null; unknown columns are an error.

    A value that can't be cast or breaks its check sends the row, with the names of such columns, to quarantine.
    """
    declared = rows.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    if unknown := set(rows.columns) - set(declared.names):
        raise ValueError(f"columns not declared for {name}: {sorted(unknown)}")
    kinds = {f.name: f.dataType for f in declared}
    checks = CHECKS.get(name, {})
    plain = lambda k: k.simpleString().split("<")[0] not in ("array", "map", "struct")
    cast = {c: (F.col(c).try_cast(k) if plain(k) else F.col(c).cast(k)) if c in rows.columns else F.lit(None).cast(k) for c, k in kinds.items()}
    typed = rows.select(*(v.alias(c) for c, v in cast.items()), *(F.col(c).alias(f"_raw_{c}") for c in rows.columns))
    bad = [F.when(F.col(f"_raw_{c}").isNotNull() & F.col(c).isNull(), F.lit(c)) for c in rows.columns]
    bad += [F.when(~F.coalesce(F.expr(rule), F.lit(True)), F.lit(c)) for c, rule in checks.items()]
    marked = typed.withColumn("rejected", F.array_distinct(F.array_compact(F.array(*bad))))
    return marked.where("size(rejected) = 0").select(*kinds), marked.where("size(rejected) > 0").select(*kinds, "rejected")
