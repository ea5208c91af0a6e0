"""Golden cases of the operators on tiny tables."""

import hashlib
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as tf
from siftwell.operators import facets, graph, identity, joins, predicates, ranking, reconcile, reports, resolution, retrieval, schedules, scoring


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


# state of presence over successive snapshots


STATE = "id long, scope long, status string, missing_runs int, missing_since timestamp_ntz, last_missing_at timestamp_ntz"
RUNS = "scope long, observed_at timestamp_ntz, complete boolean"


def test_presence_over_snapshots(spark):
    state = table(spark, [(1, 1, "active", 0, None, None), (2, 1, "active", 0, None, None), (3, 2, "active", 0, None, None)], STATE)
    steps = [(datetime(2024, 1, 1), [1], True), (datetime(2024, 1, 1), [1], True), (datetime(2024, 1, 3), [1], True), (datetime(2024, 1, 4), [1], False), (datetime(2024, 1, 5), [1], True), (datetime(2024, 1, 6), [1], True), (datetime(2024, 1, 7), [1, 2], True)]
    seen_status = []
    for at, seen, complete in steps:
        out = reconcile.reconcile_presence(state, table(spark, [(s,) for s in seen], "id long"), table(spark, [(1, at, complete)], RUNS), "id", "scope", grace_runs=1)
        rows = {r.id: r for r in out.collect()}
        seen_status.append((rows[2].status, rows[2].missing_runs, rows[2].action))
        assert (rows[1].status, rows[3].action) == ("active", "unchanged")
        state = table(spark, [(r.id, r.scope, r.status, r.missing_runs, r.missing_since, r.last_missing_at) for r in rows.values()], STATE)
    assert seen_status == [
        ("missing", 1, "missing"), ("missing", 1, "missing"), ("missing", 2, "missing"), ("missing", 2, "unchanged"), ("inactive", 3, "inactivated"), ("inactive", 3, "unchanged"), ("active", 0, "restored")
    ]


def test_merge_rules(spark):
    schema = "id long, name string, score long, version long"
    old = table(spark, [(1, "a", 5, 2), (2, "b", None, 2), (4, "d", 9, 9)], schema)
    new = table(spark, [(1, "A", None, 3), (2, "B", 0, 1), (3, "C", 7, 1)], schema)
    got = reconcile.merge(old, new, "id", {"score": F.coalesce("new.score", "old.score")}, fixed=("name",), guard=F.col("new.version") > F.col("old.version"))
    assert {tuple(r) for r in got.collect()} == {(1, "a", 5, 3, "updated"), (2, "b", None, 2, "guarded"), (3, "C", 7, 1, "inserted"), (4, "d", 9, 9, "kept")}
    again = reconcile.merge(got.drop("action"), new, "id", {"score": F.coalesce("new.score", "old.score")}, fixed=("name",), guard=F.col("new.version") > F.col("old.version"))
    assert {tuple(r)[:4] for r in again.collect()} == {tuple(r)[:4] for r in got.collect()}


# predicates and facets


def test_base_predicate_keeps_null_references(spark):
    rows = table(spark, [(1, 2027, "Confirmed", "early", None), (2, 2027, "confirmed", "formal", "inactive:x"), (3, 2027, None, "formal", "r"), (4, 2026, "confirmed", "formal", "r"), (5, 2027, "CONFIRMED", "formal", "r")], "id long, cohort int, cohort_status string, batch string, source_ref string")
    assert [r.id for r in rows.where(predicates.browse_base()).orderBy("id").collect()] == [1, 5]


def test_text_is_literal_or_pattern(spark):
    rows = table(spark, [("100% x_y",), ("100 xzy",), (None,)], "t string")
    assert rows.where(predicates.text_contains("0% X_", "t")).count() == 1
    assert rows.where(predicates.like_any("x_y", "t")).count() == 2


@pytest.mark.parametrize(("score", "band"), [(0, "low"), (59, "low"), (60, "medium"), (69, "medium"), (70, "high"), (100, "high"), (None, None)])
def test_score_bands(spark, score, band):
    assert table(spark, [(score,)], "s int").select(predicates.score_band("s").alias("b")).first().b == band


def test_effective_score_and_facet(spark):
    rows = table(spark, [(1, "o", 0, 9, ""), (2, "o", None, 9, "complete"), (3, "o", 80, 9, "failed"), (4, "o", None, None, None), (5, "o", 9, None, None)], "id long, org string, a int, b int, st string")
    scored = rows.withColumn("score", joins.effective_score("a", "b", "st"))
    assert [r.score for r in scored.orderBy("id").collect()] == [0, 9, None, None, 9]
    f = facets.company_facet(scored.withColumn("title", F.concat(F.lit("t"), "id")), "org", "id", "score", "title", "id").first()
    assert (f.n, f.mean, f.best, f.units, f.best_title) == (5, 6.0, 9, 5, "t2")
    with pytest.raises(ValueError):
        facets.known_stages(["x"], {"y"})


def test_duplicates_that_conflict_all_go(spark):
    rows = table(spark, [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None), (3, None), (4, None), (4, "")], "k long, v string")
    kept, gone = identity.resolve_duplicates(rows, "k", ["v"])
    assert {(r.k, r.copies) for r in kept.collect()} == {(1, 2), (3, 2)} and {r.k for r in gone.collect()} == {2, 4}


def test_margin_and_pages(spark):
    rows = table(spark, [("x", 1, 0.9), ("x", 2, 0.9), ("y", 3, 0.5)], "k string, id long, s double")
    best = {r.k: (r.id, r.margin) for r in ranking.with_margin(rows, ["k"], "s", [F.col("id")]).collect()}
    assert best == {"x": (1, 0.0), "y": (3, 0.5)}
    assert [r.id for r in ranking.page(rows, [F.desc("s"), F.col("id")], 1, 1).collect()] == [2]


# graph


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500, 500), (None, 3), (200, 201), (201, 202), (202, 203), (203, 204)]
    label = {x: x for e in edges if None not in e for x in e}
    for _ in label:
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in graph.connected_components(table(spark, edges, "a long, b long")).collect()}
    assert got == label
    again = graph.connected_components(table(spark, list(got.items()), "a long, b long"))
    assert {r.node: r.component for r in again.collect()} == got
    assert graph.connected_components(table(spark, [], "a long, b long")).count() == 0


# joins


def test_multi_key_match(spark):
    schema = "id long, url string, native string, company string"
    left = table(spark, [(1, "u1", None, "c"), (2, "u1", "n2", "c"), (3, None, "", "c"), (4, "u1", None, "d")], schema)
    right = table(spark, [(10, "u1", None, "c"), (20, "x", "n2", "c")], schema)
    got = {r.left_id: (r.status, r.right_id) for r in joins.multi_key_match(left, right, "id", "id", ["url", "native"], same="company").collect()}
    assert got == {1: ("matched", 10), 2: ("ambiguous", None), 3: ("new", None), 4: ("new", None)}


def test_intervals(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    points = table(spark, [(1, at(3)), (2, at(5)), (3, at(2))], "p long, t timestamp_ntz")
    spans = table(spark, [(7, at(2), at(5))], "i long, s timestamp_ntz, e timestamp_ntz")
    assert {r.p for r in joins.points_in_intervals(points, spans, "t", "s", "e", 3600).collect()} == {1, 3}
    own = table(spark, [(1, "g", at(1), at(4)), (2, "g", at(4), at(6)), (3, "g", at(3), at(5)), (4, "h", at(1), at(9))], "id long, g string, s timestamp_ntz, e timestamp_ntz")
    assert {(r.first_id, r.second_id, r.overlap_start.hour, r.overlap_end.hour) for r in joins.overlapping_pairs(own, "id", "s", "e", "g").collect()} == {(1, 3, 3, 4), (2, 3, 4, 5)}


def test_compare_with_nulls(spark):
    a, b = table(spark, [(1, "x"), (2, None), (3, "y")], "k long, v string"), table(spark, [(1, "x"), (2, "z"), (4, None)], "k long, v string")
    assert {r.k: r.change for r in joins.compare(a, b, "k", "v").collect()} == {1: "same", 2: "changed", 3: "removed", 4: "added"}


# text


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://www.A.com:443/x/?b=2&a=1&utm_source=q&ref=z#top", "https://a.com/x?a=1&b=2#top"),
        ("http://a.com:8080", "http://a.com:8080/"),
        ("https://a.com/#/job/1?spm=1&Id=3", "https://a.com/#/job/1?id=3"),
        ("ftp://a.com", ""),
        ("nonsense", ""),
        ("https://a.com:x/", ""),
    ],
)
def test_identity_url(url, want):
    assert tf.identity_url(url) == want


def test_html_text():
    text, links, active = tf.read_html("<h1>A&amp;B</h1><script>x<y</script><p>one<br>two  three</p><!-- c --><a href='/z'>z</a><a>n</a>")
    assert (text, links, active) == ("A&B\n\none\ntwo three\nzn", ["/z"], True)


def test_redaction_is_idempotent(spark):
    raw = "password: hunter2, mail a.b@c.org tel 13812345678 id 11010519900307234X key sk-abcdefghijkl"
    df = table(spark, [(raw,)], "t string").select(tf.redact("t").alias("a")).select("a", tf.redact("a").alias("b"))
    r = df.first()
    assert r.a == "password=[REDACTED:secret], mail [REDACTED:email] tel [REDACTED:phone] id [REDACTED:national_id] key [REDACTED:token]"
    assert r.b.count("REDACTED") == 5


def test_chunks_cover_and_fit():
    text = "\n\n".join("word " * n for n in (10, 150, 3, 500, 1))
    parts = tf.split_chunks(text, 300, 40)
    assert all(0 < len(p) <= 300 for p in parts) and parts[1].startswith(parts[0][-40:].strip()[:5])
    assert tf.split_chunks("  \r\n ") == [] and tf.split_chunks("a\n\nb") == ["a\n\nb"]


def test_hashed_vector():
    v = tf.hashed_vector("Alpha beta")
    h = lambda f: int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big") % 64
    assert abs(sum(x * x for x in v) - 1) < 1e-12 and v[h("token:alpha")] > 0 and v[h("gram:bet")] > 0
    assert tf.hashed_vector("!!") == [0.0] * 64


def test_hashed_embedding_of_a_column(spark):
    texts = ["Alpha beta", None, "", "gamma"]
    got = table(spark, list(enumerate(texts)), "id long, text string").select("id", tf.hashed_embedding("text").alias("v")).collect()
    assert {r.id: r.v for r in got} == {i: None if t is None else tf.hashed_vector(t) for i, t in enumerate(texts)}
    assert table(spark, [(0, None)], "id long, text string").select(tf.hashed_embedding("text").alias("v")).collect() == [(None,)]


# scores, retrieval, reports


def test_capped_score(spark):
    c = lambda parts, level, direct, missing: scoring.capped_score([F.lit(p) for p in parts], F.lit(level), F.lit(direct), F.lit(missing))
    cases = [((60, 50), "direct", 2, 0, 100), ((60, 35), "direct", 1, 0, 89), ((60, 35), "partial", 3, 0, 89), ((60, 35), "direct", 0, 0, 79), ((60, 35), "direct", 2, 1, 84), ((60, 35), "direct", 2, 2, 74), ((60, 35), "direct", 2, 5, 64), ((60, 35), "none", 2, 0, 49)]
    for parts, level, direct, missing, want in cases:
        assert one(spark, c(parts, level, direct, missing), z=1) == want


def test_lexical_cosine_grounding(spark):
    q = table(spark, [(1, "red red apple"), (2, "zzz")], "q long, t string")
    d = table(spark, [(5, "a red apple, red!"), (6, "RED"), (7, None)], "d long, t string")
    lex = {(r.query_id, r.doc_id): r.lexical for r in retrieval.lexical_scores(q, d, "q", "t", "d", "t").collect()}
    assert lex == {(1, 5): 1.0, (1, 6): pytest.approx(1 / 3)}
    v = table(spark, [([1.0, 0.0], [0.0, 0.0], [-2.0, 0.0])], "a array<double>, b array<double>, c array<double>")
    assert tuple(v.select(retrieval.cosine("a", "b"), retrieval.cosine("a", "c")).first()) == (0.0, -1.0)
    with pytest.raises(Exception, match="differ in length"):
        table(spark, [([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(retrieval.cosine("a", "b")).collect()
    found = table(spark, [(1, 5, 0.2, 1), (1, 6, 0.19, 2)], "query_id long, doc_id long, score double, rank int")
    got = {r.query_id: (r.evidence, r.refused) for r in retrieval.grounded(table(spark, [(1,), (2,)], "query_id long"), found).collect()}
    assert got == {1: ([5], False), 2: ([], True)}


def test_metrics_and_changes(spark):
    cases = table(spark, [([1, 2], [1], True), ([], [], False), ([3], [4], True)], "relevant array<long>, cited array<long>, answered boolean")
    r = reports.retrieval_metrics(cases).first()
    assert (r.recall, r.precision, r.refusal_accuracy, r.cases) == (0.25, 0.5, 1.0, 3)
    a, b = table(spark, [("x", 10), ("y", 10)], "k string, n long"), table(spark, [("x", 5), ("y", 9), ("z", 1)], "k string, n long")
    assert {r.k for r in reports.quantity_changes(a, b, "k", "n").collect()} == {"x", "z"}


def test_tiers_and_reciprocity(spark):
    pairs = table(spark, [(1, 10, 0), (1, 11, 1), (2, 10, 1), (2, 11, 1), (3, 12, 9)], "l long, r long, t int")
    got = {r.l: (r.tier, r.r, r.status) for r in resolution.tiered_match([pairs.where("t = 0"), pairs.where("t = 1")], "l", "r").collect()}
    assert got == {1: (0, 10, "unique"), 2: (1, None, "ambiguous")}
    assert [tuple(r) for r in resolution.reciprocal(pairs, "l", "r").collect()] == [(3, 12)]


def test_schedules(spark):
    plans = table(spark, [(1, "2024-01-01", "2024-01-09"), (2, "2024-01-05", "2024-01-09")], "id long, a string, b string").select("id", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    done = table(spark, [(1, "2024-01-03")], "id long, d string").select("id", F.to_date("d").alias("day"))
    got = {r.id: (str(r.claimed), r.skipped) for r in schedules.due_occurrences(plans, done, "id", "a", "b", F.lit("2024-01-04").cast("date")).collect()}
    assert got == {1: ("2024-01-04", 2)}


def row_of(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_hostile_pages(spark):
    rows = spark.createDataFrame([(1, "<![foo[x]]>hi"), (2, None), (3, "<p>fine</p>")], "id long, html string")
    got = {r.id: r.h for r in rows.select("id", tf.html_text("html").alias("h")).collect()}
    assert (got[1].text, got[1].links, got[1].active) == ("", [], True) and got[2].text is None and got[3].text == "fine"


def test_hmac_as_the_library(spark):
    import hashlib
    import hmac

    for key in (b"", b"k", b"x" * 64, b"y" * 200):
        for message in ("", "text", "é" * 500):
            assert row_of(spark, tf.hmac_sha256(key, F.lit(message))).c0 == hmac.new(key, message.encode(), hashlib.sha256).hexdigest()


def test_alignment_of_domains(spark):
    def holds(sender="a.org", path="A.org.", **more):
        r = {"authserv_id": "mx", "method": "spf", "result": "pass", "aligned": True, "identity_domain": "a.ORG"} | more
        item = F.struct(*(F.lit(v).alias(k) for k, v in r.items()))
        return row_of(spark, resolution.aligned_authentication(F.array(item), F.lit(sender), F.lit(path))).c0

    assert holds() and holds(method="dkim", identity_domain="b.org")
    assert not any((holds(authserv_id=""), holds(result="fail"), holds(aligned=False), holds(identity_domain="b.org"), holds(sender="b.org"), holds(path="org"), holds(path=None), holds(method="dmarc"), holds(authserv_id=None)))
    assert not row_of(spark, resolution.aligned_authentication(F.lit(None).cast("array<struct<authserv_id:string,method:string,result:string,aligned:boolean,identity_domain:string>>"), F.lit("a.b"), F.lit("a.b"))).c0


def test_provenance_and_facts(spark):
    why = lambda digest, quotes: row_of(spark, resolution.provenance_error(F.lit(digest), F.lit("d"), F.array(*map(F.lit, quotes)), [F.lit("a  subject"), F.lit("some\nbody text")])).c0
    assert why("d", ["some body", "a subject "]) is None and why("x", ["some body"]) == "content_digest_mismatch" and why("d", ["subject some"]) == "evidence_quote_not_found" and why(None, []) == "content_digest_mismatch"
    agree = lambda a, b: row_of(spark, resolution.facts_agree(resolution.stated_facts(F.lit(a)), resolution.stated_facts(F.lit(b)))).c0
    assert agree("27届-Data engineer (Berlin)", "2027-Data engineer") and not agree("27届-C", "2026-C") and not agree("C (Berlin)", "C (Paris)")
    assert agree("C [choice 1]", "C") and not agree("C [choice 1]", "C [choice 2]") and not agree("C", "D") and not agree("27届-", "27届-")


def test_spans(spark):
    spans = lambda text, part: [tuple(s) for s in row_of(spark, resolution.evidence_spans(F.lit(text), F.lit(part))).c0]
    assert spans("aaa", "aa") == [(0, 2), (1, 3)] and spans("xＡＢ ab", "AB") == [(1, 3)] and spans("a.b\\E", ".b\\E") == [(1, 5)] and spans("abc", "") == [] and spans("abc", "d") == [] and spans("", "d") == []


def test_equal_names(spark):
    keys = ["acme", "acmeltd", "acmeinc", "co", "coltd", "redring", "hotring", "", "zed"]
    names = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {tuple(r) for r in resolution.equal_names(names, "k", [("redring", "hotring")]).collect()}
    want = {(a, b) for a in keys[:3] for b in keys[:3] if a != b} | {("redring", "hotring"), ("hotring", "redring")}
    assert got == want


def test_components_by_hand(spark):
    import random

    from siftwell.operators.graph import connected_components

    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1060)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5, None), (7000, 7000)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in list(label)}


def test_refreshed_index(spark):
    from siftwell.operators import retrieval

    mark = F.sha2("text", 256)
    old = spark.createDataFrame([(1, "same"), (2, "before"), (3, "gone")], "id long, text string")
    new = spark.createDataFrame([(1, "same"), (2, "after"), (4, "added")], "id long, text string")
    index = retrieval.chunk_table(old, "id", "text").join(old.select(F.col("id").alias("doc"), mark.alias("mark")), "doc")
    got = retrieval.refresh_index(index, new, "id", "text", mark)
    assert sorted((r.doc, r.chunk) for r in got.collect()) == [(1, "same"), (2, "after"), (4, "added")]
    again = retrieval.chunk_table(new, "id", "text").select("doc", "chunk_id").collect()
    assert sorted(map(tuple, got.select("doc", "chunk_id").collect())) == sorted(map(tuple, again))


def test_leases_end_without_an_event(spark):
    from siftwell.operators import schedules as sc

    rows = [("2026-01-01 00:00:00", None, 1), ("2026-01-01 00:00:00", "2026-01-01 00:00:10", 1), (None, None, 0), ("2026-01-01 00:00:00", None, 5)]
    df = spark.createDataFrame(rows, "s string, e string, n int").select(F.col("s").cast("timestamp").alias("s"), F.col("e").cast("timestamp").alias("e"), "n")
    at = lambda t: [r[0] for r in df.select(sc.leased_state(F.col("s"), F.col("e"), F.col("n"), F.lit(f"2026-01-01 00:0{t}").cast("timestamp"))).collect()]
    assert at("2:59") == ["running", "ready", "ready", "running"]
    assert at("3:00") == ["waiting", "ready", "ready", "exhausted"]
    assert at("4:00")[0] == "ready" and at("1:09")[1] == "waiting"


def test_lost_acknowledgements_bring_the_missing_ranges(spark):
    import random

    from siftwell.operators import schedules as sc

    rng = random.Random(1)
    sent = [(d, s) for d in "abc" for s in range(1, 200)]
    acked = [x for x in sent if x[0] != "c" and rng.random() < 0.7]
    want = []
    for d, s in sent:
        if (d, s) not in acked and not (d == "b" and s <= 50):
            if want and want[-1][0] == d and want[-1][2] == s - 1:
                want[-1] = (d, want[-1][1], s, want[-1][3] + 1)
            else:
                want.append((d, s, s, 1))
    frames = [spark.createDataFrame(x, "d string, seq long") for x in (sent + sent[:9], acked)]
    cursors = spark.createDataFrame([("b", 50)], "d string, cursor long")
    for block in (7, 1000):
        assert sorted(map(tuple, sc.unacknowledged_ranges(*frames, "d", "seq", cursors, block).collect())) == sorted(want)
