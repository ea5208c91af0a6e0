"""The query surface over a small catalogue."""

from datetime import date, datetime

import pytest

from siftwell.api import Catalog
from siftwell.functions.text import hashed_vector
from siftwell.schemas import SCHEMAS, conform


def rows(spark, name, *records):
    schema = spark.createDataFrame([], SCHEMAS[name]).schema
    return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in records], schema)


@pytest.fixture(scope="module")
def catalog(spark):
    t = datetime(2026, 9, 1)
    job = lambda i, company="c1", **k: {"id": i, "company_id": company, "title": f"Engineer {i}", "cohort": 2027, "cohort_status": "Confirmed", "batch": "formal", "detail_url": "https://x.mokahr.com/1", "capture_status": "complete", "first_seen_at": t} | k
    return Catalog(
        {
            "companies": rows(spark, "companies", {"id": "c1", "name": "Alpha", "aliases": ["A1"], "organization_id": "o1", "integration_status": "connected"}, {"id": "c2", "name": "alpha ", "campus_url": "u"}, {"id": "c3", "name": "100% Beta", "integration_status": "pending"}),
            "jobs": rows(spark, "jobs", job("j1", match_score=0), job("j2", match_score=90, city="Köln"), job("j3", "c2"), job("j4", "c3", match_score=75, title="Data_ops"), job("j5", "c3", source_ref="inactive:1"), job("j6", "c3", cohort=2026, match_score=99), job("j7", "missing", match_score=65, detail_url="z")),
            "analyses": rows(spark, "analyses", {"job_id": "j2", "match_score": 80, "analysis_status": "failed"}, {"job_id": "j3", "match_score": 71, "analysis_status": "complete"}, {"job_id": "j1", "match_score": 5, "analysis_status": "direction_out"}),
            "applications": rows(spark, "applications", {"id": "a1", "company_name": "Alpha", "job_title": "Engineer", "job_id": "j4", "stage": "applied", "updated_at": t}, {"id": "a2", "company_name": "Alpha Two", "job_title": "x", "job_id": "j4", "stage": "interview", "updated_at": datetime(2026, 9, 2)}, {"id": "a3", "company_name": "Beta", "job_title": "Eng", "stage": "rejected", "updated_at": t}),
            "schedule": rows(spark, "schedule", {"id": "s1", "event_date": date(2026, 9, 3), "event_time": "10:00", "event_end": "12:00", "status": "pending"}, {"id": "s2", "event_date": date(2026, 9, 3), "event_time": "11:30", "status": "pending"}, {"id": "s3", "event_date": date(2026, 9, 3), "status": "pending"}),
            "mails": rows(spark, "mails", {"id": "m1", "received_at": datetime(2026, 9, 3, 23), "category": "interview", "body": "token: abc"}, {"id": "m2", "received_at": datetime(2026, 9, 4), "category": "offer"}),
            "sources": rows(spark, "sources", {"id": "x1", "name": "S", "status": "unusable"}, {"id": "x2", "name": "S2", "status": "ready"}),
            "chunks": rows(spark, "chunks", *({"chunk_id": str(i), "content": c, "embedding": hashed_vector(c), "metadata": {"domain": d}} for i, (c, d) in enumerate([("stream joins in spark", "eng"), ("cooking rice", "eng"), ("spark joins", "other")]))),
            "task_runs": rows(spark, "task_runs", {"id": "t1", "status": "failed", "created_at": t}),
        }
    )


def ids(df):
    return [r.id for r in df.collect()]


def test_search_and_browse_differ(catalog):
    assert ids(catalog.search_jobs().rows) == ["j6", "j2", "j4", "j7", "j1", "j3"]
    assert ids(catalog.search_jobs(query="alpha").rows) == ["j2", "j1", "j3"] and ids(catalog.search_jobs(query="data_ops").rows) == ["j4"]
    assert ids(catalog.search_jobs(query="d%s").rows) == ["j4"] and catalog.browse_jobs(query="d%s").total == 0
    assert ids(catalog.browse_jobs(query="100% b").rows) == ["j4"]
    page = catalog.browse_jobs()
    assert ids(page.rows) == ["j4", "j3", "j7", "j1", "j2"] and page.total == 5
    assert {r.id: r.score for r in page.rows.collect()} == {"j4": 75, "j3": 71, "j7": 65, "j1": None, "j2": None}
    assert {r.id: r.application_stage for r in page.rows.collect()}["j4"] == "interview"
    assert ids(catalog.browse_jobs(company="O1").rows) == ["j3", "j1", "j2"]  # one organization under two companies
    assert ids(catalog.browse_jobs(evaluation="excluded").rows) == ["j1"] and ids(catalog.browse_jobs(score_band="medium").rows) == ["j7"]
    assert ids(catalog.browse_jobs(platform_name="moka", sort="company", limit=2).rows) == ["j4", "j1"]
    facet = page.facets["companies"].collect()
    assert [(r.key, r.n, r.best_title) for r in facet] == [("c3", 1, "Data_ops"), ("o1", 3, "Engineer j3"), ("missing", 1, "Engineer j7")]
    assert ids(page.facets["featured"]) == ["j4", "j3"]
    with pytest.raises(ValueError):
        catalog.browse_jobs(limit=0)


def test_applications_and_schedule(catalog):
    page = catalog.search_applications(query="alpha", stages=["interview"])
    assert ids(page.rows) == ["a2"] and {r.stage: (r.n, r.total, r.unfiltered) for r in page.facets["stages"].collect()} == {"applied": (1, 2, 3), "interview": (1, 2, 3)}
    with pytest.raises(ValueError):
        catalog.search_applications(stage="nope")
    window = catalog.schedule_window(date(2026, 9, 1), date(2026, 9, 9))
    assert ids(window["events"]) == ["s1", "s2", "s3"] and [(r.first_id, r.second_id) for r in window["overlaps"].collect()] == [("s1", "s2")]
    assert ids(catalog.recruitment_mail_search(received_to=date(2026, 9, 3)).rows) == ["m1"]
    assert catalog.recruitment_mail_detail("m1").first().body == "token=[REDACTED:secret]"
    assert ids(catalog.source_list().rows) == ["x2"] and ids(catalog.source_list(status="unusable").rows) == ["x1"]
    assert [r.failed for r in catalog.operational_report(date(2026, 8, 31), date(2026, 9, 2)).orderBy("day").collect()] == [0, 1, 0]


def test_tools(catalog):
    assert catalog.tool("search_jobs", query="alpha").status == "SUCCESS"
    assert catalog.tool("search_jobs", query="nowhere").status == "NO_RESULTS"
    assert catalog.tool("application_query", name="Alpha").status == "AMBIGUOUS"
    assert catalog.tool("search_jobs", limit=0).status == "FAILURE" and catalog.tool("automation_schedule_list").status == "FAILURE"
    found = catalog.knowledge_search("spark joins", "eng")
    assert [r.chunk_id for r in found["citations"].collect()] == ["0"] and found["answer"].first().answerable
    assert catalog.tool("knowledge_search", query="zzz", domain="eng").status == "NO_RESULTS"
    assert catalog.company_coverage("a1").facets["counts"].first().connected == 1
    assert {r.id: r.active_jobs for r in catalog.list_companies().collect()} == {"c1": 2, "c2": 1, "c3": 2}


def test_conform(spark):
    raw = spark.createDataFrame([("1", "50", "complete"), ("2", "101", "complete"), ("3", "x", "odd"), ("4", None, None)], "id string, match_score string, capture_status string")
    good, bad = conform(raw, "jobs")
    assert ids(good.orderBy("id")) == ["1", "4"] and {r.id: set(r.rejected) for r in bad.collect()} == {"2": {"match_score"}, "3": {"match_score", "capture_status"}}
    with pytest.raises(ValueError):
        conform(raw.withColumn("zz", raw.id), "jobs")
