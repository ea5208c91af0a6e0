"""The read-only query surface over a catalogue: searches, pages, facets, reports, retrieval.

Every method is lazy where it returns a DataFrame; a ``Page`` counts when ``total`` is asked. ``tool`` runs a method by the name of
the tool and wraps its answer in a status.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as tf
from siftwell.operators import facets, joins, predicates, ranking, reports, retrieval
from siftwell.schemas import STAGES

# Platforms by what source or address contain, in order.
PLATFORMS = (
    (("moka",), ("mokahr.com",), "Moka"), (("beisen",), ("zhiye.com",), "北森"), (("feishu", "lark"), ("feishu.cn", "mioffice"), "飞书"),
    (("hotjob",), ("hotjob.cn",), "Hotjob"), (("moseeker",), (), "Moseeker"), (("ourats",), (), "OurATS"),
)
OWN_SITE = "自建"
TRACKS = {"early_batch": "early", "formal": "formal", "internship": "internship"}
EXCLUDED = ("direction_out", "doctorate_only", "internship", "cohort_unconfirmed")


@dataclass
class Page:
    """One page of a total order and what it is a page of."""

    matches: DataFrame
    rows: DataFrame
    limit: int
    offset: int
    facets: dict[str, DataFrame] = field(default_factory=dict)

    @cached_property
    def total(self) -> int:
        return self.matches.count()


@dataclass
class Answer:
    status: str  # SUCCESS, NO_RESULTS, AMBIGUOUS or FAILURE
    data: object = None
    error: str | None = None


def platform(source: str = "source_platform", url: str = "detail_url") -> Column:
    s, u = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    out = F.lit(OWN_SITE)
    for names, hosts, label in reversed(PLATFORMS):
        hit = F.lit(False)
        for n in names:
            hit = hit | F.contains(s, F.lit(n))
        for h in hosts:
            hit = hit | F.contains(u, F.lit(h))
        out = F.when(hit, label).otherwise(out)
    return out


def day_or_time(column: str, value: date | datetime | None, lower: bool) -> Column | None:
    """Bounds by the day for dates and exactly for times; both ends belong to the range."""
    if value is None:
        return None
    at = F.lit(value.isoformat()).cast("timestamp")
    if isinstance(value, datetime):
        return F.col(column) >= at if lower else F.col(column) <= at
    return F.col(column) >= at if lower else F.col(column) < at + F.expr("INTERVAL 1 DAY")


def _checked(limit: int, offset: int, most: int | None = None) -> None:
    if limit < 1 or offset < 0 or (most and limit > most):
        raise ValueError("limit must be positive" + (f" and at most {most}" if most else "") + ", offset not negative")


@dataclass
class Catalog:
    """Tables by the names of ``siftwell.schemas.SCHEMAS``; only those that a method reads must be there."""

    tables: Mapping[str, DataFrame]
    inactive: str = "inactive:"

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("tables", {})
        if name in tables:
            return tables[name]
        raise AttributeError(name)

    def active_jobs(self) -> DataFrame:
        return self.jobs.where(F.col("source_ref").isNull() | ~F.startswith("source_ref", F.lit(self.inactive)))

    def search_jobs(
        self, query: str | None = None, company: str | None = None, cohort: int | None = None, cohort_status: str | None = None, recruitment_track: str | None = None,
        first_seen_on: date | None = None, batches: Sequence[str] | None = None, min_score: int | None = None, limit: int = 50, offset: int = 0,
    ) -> Page:
        """Text is a LIKE pattern here, company a part of id or name; the raw job score filters and sorts."""
        _checked(limit, offset)
        rows = self.active_jobs()
        query, company = (query or "").strip().lower(), (company or "").strip().lower()
        name = F.lit(None).cast("string")
        if query or company:  # the join is needed only for text
            rows = rows.join(self.companies.select(F.col("id").alias("company_id"), F.col("name").alias("_company")), "company_id", "left")
            name = F.col("_company")
        like = lambda c, text: F.coalesce(F.lower(c).like(f"%{text}%"), F.lit(False))
        batches = (TRACKS[recruitment_track.lower()],) if (recruitment_track or "").lower() in TRACKS else batches
        keep = predicates.all_of(
            like("title", query) | like(F.coalesce("city", F.lit("")), query) | like(F.coalesce(name, "company_id"), query) if query else None,
            like("company_id", company) | like(F.coalesce(name, F.lit("")), company) if company else None,
            F.col("cohort") == cohort if cohort is not None else None,
            F.lower("cohort_status") == cohort_status.lower() if cohort_status else None,
            F.to_date("first_seen_at") == F.lit(first_seen_on.isoformat()).cast("date") if first_seen_on else None,
            F.col("batch").isin(*batches) if batches else None,
            F.col("match_score") >= min_score if min_score is not None else None,
        )
        rows = rows.where(keep).drop("_company")
        order = [F.desc_nulls_last("match_score"), F.desc_nulls_last("first_seen_at"), F.col("id")]
        return Page(rows, ranking.page(rows, order, offset, limit), limit, offset)

    def browse_rows(self) -> DataFrame:
        """Jobs in scope with company, analysis, effective score and platform."""
        company = self.companies.select(F.col("id").alias("company_id"), F.col("name").alias("_name"), F.col("organization_id").alias("_org"), "recruitment_unit_name", "campus_url")
        analysis = self.analyses.select("job_id", F.col("match_score").alias("analysis_score"), "analysis_status", "recommendation", "summary", "advantages", "gaps", "matched_directions")
        rows = joins.enrich(self.jobs.where(predicates.browse_base(inactive=self.inactive)), company, analysis)
        name = F.coalesce(F.nullif("_name", F.lit("")), "company_id")
        # companies of one name share an organization
        canonical = ranking.first_per_key(
            self.companies.where("organization_id <> ''").select(F.lower(F.trim("name")).alias("_key"), F.col("organization_id").alias("_canonical")), ["_key"], [F.col("_canonical")]
        )
        rows = rows.withColumns({"company_name": name, "_key": F.lower(F.trim(name))}).join(canonical, "_key", "left")
        organization = F.coalesce(F.nullif("_org", F.lit("")), "_canonical", "organization_id")
        rows = rows.withColumns({"organization": organization, "score": joins.effective_score("match_score", "analysis_score", "analysis_status"), "platform": platform()})
        return rows.drop("_name", "_org", "_key", "_canonical")

    def browse_jobs(
        self, query: str | None = None, company: str | None = None, categories: Sequence[tuple[str, str]] = (), category: str | None = None, platform_name: str | None = None,
        evaluation: str | None = None, score_band: str | None = None, first_seen_on: date | None = None, sort: str = "score", limit: int = 50, offset: int = 0, include_summary: bool = True,
    ) -> Page:
        """Literal text; the company by id, name or organization; facets and statistics of the scope, not of the filters."""
        _checked(limit, offset)
        scope = self.browse_rows().withColumn("category", predicates.first_matching("title", categories, "other"))
        if first_seen_on:
            scope = scope.where(F.to_date("first_seen_at") == F.lit(first_seen_on.isoformat()).cast("date"))
        score, status, company = F.col("score"), F.col("analysis_status"), (company or "").strip().lower()
        kinds = {
            "scored": score.isNotNull(), "unscored": score.isNull(), "pending": (status == "eligible") & score.isNull() & (F.col("capture_status") == "complete"),
            "jd_incomplete": status == "jd_incomplete", "excluded": status.isin(*EXCLUDED),
        }
        keep = predicates.all_of(
            predicates.text_contains((query or "").strip(), "company_name", "title", "city"),
            (F.lower("company_id") == company) | (F.lower("company_name") == company) | F.coalesce(F.lower("organization") == company, F.lit(False)) if company else None,
            F.col("category") == category if category else None,
            F.lower("platform") == platform_name.strip().lower() if (platform_name or "").strip() else None,
            kinds.get(evaluation) if evaluation else None,
            predicates.score_band("score") == score_band if score_band else None,
        )
        rows = scope.where(keep)
        newest, highest, name, title = F.desc_nulls_last("first_seen_at"), F.desc_nulls_last("score"), F.lower("company_name"), F.lower("title")
        order = {"newest": [newest, highest, name, title], "company": [name, title, newest]}.get(sort, [highest, newest, name, title])
        page = ranking.page(rows, [*order, F.col("id")], offset, limit)
        more = {}
        if include_summary:
            featured = ranking.page(scope.where(score >= 70), [F.desc("score"), newest, name, F.col("id")], 0, 10)
            more = {"stats": facets.browse_stats(scope), "companies": self.company_facet(scope), "platforms": scope.agg(F.array_sort(F.collect_set("platform")).alias("platforms")), "featured": self.with_stage(featured)}
        return Page(rows, self.with_stage(page), limit, offset, more)

    @staticmethod
    def company_facet(scope: DataFrame) -> DataFrame:
        """By organization, else company; in the order of the facet: mean (null last), count, name."""
        keyed = scope.withColumn("key", F.coalesce("organization", "company_id"))
        base = facets.company_facet(keyed, "key", "company_id", "score", "title", "id")
        more = keyed.groupBy("key").agg(F.min_by("company_name", "id").alias("name"), F.min_by("campus_url", F.when(F.coalesce("campus_url", F.lit("")) != "", F.col("id"))).alias("campus_url"), F.count_distinct("recruitment_unit_name").alias("recruitment_units"))
        return base.join(more, "key").orderBy(F.desc_nulls_last("mean"), F.desc("n"), F.lower("name"))

    def with_stage(self, rows: DataFrame) -> DataFrame:
        if "applications" not in self.tables:
            return rows
        history = self.applications.where("job_id is not null").withColumnRenamed("id", "_application").withColumnRenamed("job_id", "id")
        return joins.latest_lookup(rows, history, "id", [F.desc_nulls_last("updated_at"), F.col("_application")], "stage", "application_stage")

    def job_detail(self, job_id: str) -> DataFrame:
        return self.jobs.where(F.col("id") == job_id).join(self.analyses.withColumnRenamed("job_id", "id").withColumnRenamed("match_score", "analysis_score").drop("updated_at"), "id", "left")

    def list_companies(self) -> DataFrame:
        """Companies with the number of their active jobs."""
        counts = self.active_jobs().groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("active_jobs"))
        return self.companies.join(counts, "id", "left").withColumn("active_jobs", F.coalesce("active_jobs", F.lit(0))).orderBy("name", "id")

    def company_coverage(self, company_name: str | None = None, integration_status: str | None = None, limit: int = 100, offset: int = 0) -> Page:
        _checked(limit, offset)
        name = (company_name or "").lower()
        named = (F.lower("name") == name) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a) == name)
        rows = self.companies.where(predicates.all_of(named if name else None, F.lower("integration_status") == integration_status.lower() if integration_status else None))
        connected = F.count_if(F.lower("integration_status") == "connected")
        return Page(rows, ranking.page(rows, [F.col("name"), F.col("id")], offset, limit), limit, offset, {"counts": rows.agg(F.count("*").alias("total"), connected.alias("connected"), (F.count("*") - connected).alias("not_connected"))})

    def search_applications(self, query: str | None = None, stage: str | None = None, stages: Sequence[str] | None = None, limit: int = 50, offset: int = 0) -> Page:
        _checked(limit, offset)
        if stage is not None and stages is not None:
            raise ValueError("stage and stages cannot be combined")
        wanted = [stage] if stage is not None else stages
        text = query.strip().lower() if query else ""
        hit = (F.contains(F.lower("company_name"), F.lit(text)) | F.contains(F.lower("job_title"), F.lit(text))) if text else None
        rows = self.applications if hit is None else self.applications.where(hit)
        if wanted is not None:
            rows = rows.where(F.col("stage").isin(*facets.known_stages([w.strip() for w in wanted], set(STAGES))))
        return Page(rows, ranking.page(rows, [F.desc("updated_at"), F.col("id")], offset, limit), limit, offset, {"stages": facets.stage_counts(self.applications, hit, "stage")})

    def application_query(self, name: str, column: str = "company_name") -> DataFrame:
        return facets.named_query(self.applications.where(~F.col("stage").isin("rejected")), column, name)

    def today_schedule(self, on_date: date | None = None) -> DataFrame:
        rows = self.schedule if on_date is None else self.schedule.where(F.col("event_date") == F.lit(on_date.isoformat()).cast("date"))
        return rows.orderBy(F.asc_nulls_last("event_date"), F.asc_nulls_last("event_time"), "id")

    def schedule_window(self, first: date, last: date) -> dict[str, DataFrame]:
        """Pending events of some days and their overlaps; events without an end last an hour."""
        rows = self.schedule.where((F.col("status") == "pending") & F.col("event_date").between(F.lit(first.isoformat()).cast("date"), F.lit(last.isoformat()).cast("date")))
        at = lambda c: F.try_to_timestamp(F.concat_ws(" ", F.col("event_date").cast("string"), c), F.lit("yyyy-MM-dd HH:mm"))
        timed = rows.withColumns({"_s": at("event_time"), "_e": F.coalesce(at("event_end"), at("event_time") + F.expr("INTERVAL 1 HOUR"))}).where("_s is not null")
        return {"events": rows.orderBy(F.asc_nulls_last("event_date"), F.asc_nulls_last("event_time"), "id"), "overlaps": joins.overlapping_pairs(timed, "id", "_s", "_e", "event_date")}

    def recruitment_mail_search(
        self, received_from: date | datetime | None = None, received_to: date | datetime | None = None, category: str | None = None, categories: Sequence[str] | None = None,
        status: str | None = None, limit: int = 100, offset: int = 0,
    ) -> Page:
        _checked(limit, offset, 1000)
        if category is not None and categories is not None:
            raise ValueError("category and categories cannot be combined")
        kinds = [category] if category is not None else categories
        keep = predicates.all_of(day_or_time("received_at", received_from, True), day_or_time("received_at", received_to, False), F.col("category").isin(*kinds) if kinds is not None else None, F.col("processing_status") == status if status else None)
        rows = self.mails.where(keep)
        return Page(rows, ranking.page(rows, [F.desc("received_at"), F.desc("id")], offset, limit), limit, offset)

    def recruitment_mail_detail(self, mail_id: str) -> DataFrame:
        return self.mails.where(F.col("id") == mail_id).withColumn("body", tf.redact("body"))

    def source_list(self, text: str | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> Page:
        """Unusable sources stay hidden unless they are asked for."""
        _checked(limit, offset)
        shown = F.col("status") == status if status else F.coalesce(F.col("status") != "unusable", F.lit(True))
        rows = self.sources.where(predicates.all_of(predicates.like_any(text, "name", "url", "source"), shown))
        return Page(rows, ranking.page(rows, [F.col("name"), F.col("id")], offset, limit), limit, offset)

    def crawler_acceptance(self, observed: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
        """Observed jobs with the first reason to reject them; a later row of an id is a duplicate."""
        rows = facets.numbered(observed, ["id"], [F.col(c) for c in observed.columns if c != "id"])
        return rows.withColumn("reason", predicates.first_failing([("invalid_id", F.coalesce(F.col("id"), F.lit("")) != ""), ("duplicate_id", F.col("n") == 1), *rules])).drop("n")

    def knowledge_search(self, query: str, domain: str, top_k: int = 5, threshold: float = 0.2) -> dict[str, DataFrame]:
        """Hybrid retrieval within a domain's chunks: accepted chunks, best first, and whether there was an answer."""
        chunks = self.chunks.where(facets.has_pairs(F.col("metadata"), {"domain": domain}))
        asked = chunks.sparkSession.createDataFrame([(0, query)], "query_id long, query string")
        lexical = retrieval.lexical_scores(asked, chunks, "query_id", "query", "chunk_id", "content").select(F.col("doc_id").alias("chunk_id"), "lexical")
        vector = F.array(*map(F.lit, tf.hashed_vector(query)))
        scored = chunks.join(lexical, "chunk_id", "left").withColumns({"lexical": F.coalesce("lexical", F.lit(0.0)), "_q": vector})
        scored = scored.withColumn("cosine", retrieval.cosine("embedding", "_q")).withColumn("score", retrieval.hybrid("lexical", "cosine")).drop("_q")
        best = scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), F.desc("lexical"), F.desc("cosine"), "chunk_id").limit(top_k)
        return {"citations": best, "answer": best.agg((F.count("*") > 0).alias("answerable"))}

    def operational_report(self, first: date, last: date) -> DataFrame:
        """Tasks by day with failures, zero days included."""
        rows = self.task_runs.withColumn("ts", F.col("created_at").cast("timestamp_ntz"))
        return reports.daily_outcomes(rows, "ts", F.coalesce(F.col("status") == "failed", F.lit(False)), first, last)

    def automation_schedule_list(self) -> DataFrame:
        return self.automation_schedules.where("enabled").orderBy("next_run_at", "id")

    def browser_operation_status(self, operation_id: str, after: int = 0, limit: int = 100) -> DataFrame:
        """Events of an operation after a cursor."""
        return self.operation_events.where((F.col("operation_id") == operation_id) & (F.col("sequence") > after)).orderBy("sequence").limit(limit)

    def capabilities(self) -> list[str]:
        """Tools whose tables are there."""
        return sorted(name for name, needs in TOOLS.items() if all(t in self.tables for t in needs))

    def tool(self, name: str, /, **arguments) -> Answer:
        """A tool by name: its data, or no results, or several candidates, or what went wrong."""
        if name not in self.capabilities():
            return Answer("FAILURE", error=f"no tool {name} with these tables")
        try:
            data = getattr(self, name)(**arguments)
            first = data.rows if isinstance(data, Page) else next(iter(data.values())) if isinstance(data, dict) else data
            if isinstance(first, DataFrame):
                head = first.limit(2).collect()
                if not head:
                    return Answer("NO_RESULTS", data)
                if name == "application_query" and head[0].status == "ambiguous":
                    return Answer("AMBIGUOUS", data)
            return Answer("SUCCESS", data)
        except (ValueError, TypeError) as wrong:
            return Answer("FAILURE", error=str(wrong))


#: Read-only tools and the tables that they read.
TOOLS: dict[str, tuple[str, ...]] = {
    "capabilities": (), "search_jobs": ("jobs", "companies"), "browse_jobs": ("jobs", "companies", "analyses"), "job_detail": ("jobs", "analyses"), "list_companies": ("jobs", "companies"),
    "company_coverage": ("companies",), "search_applications": ("applications",), "application_query": ("applications",), "today_schedule": ("schedule",), "schedule_window": ("schedule",),
    "recruitment_mail_search": ("mails",), "recruitment_mail_detail": ("mails",), "source_list": ("sources",), "crawler_acceptance": (), "knowledge_search": ("chunks",),
    "operational_report": ("task_runs",), "automation_schedule_list": ("automation_schedules",), "browser_operation_status": ("operation_events",),
}
