"""Golden cases of campaign years and status assertions."""

import pytest
from pyspark.sql import functions as F

from siftwell.operators import assertions as a

YEARS = [
    ("2027 campus recruitment", [2027]),
    ("Campus  Recruitment\n2026 and 2027", [2026, 2027]),
    ("27届校园招聘", [2027]),
    ("27 校园招聘", []),  # two digits need the class mark
    ("5-27届校园招聘", []),
    ("7月27届校招", []),
    ("© 2026 campus recruitment", []),
    ("©    2026 campus recruitment", []),
    ("(c) 2026 campus recruitment", [2026]),
    ("2026年5月 校园招聘", []),
    ("2026-05 campus recruitment", []),
    ("2026 / 5 campus recruitment", []),
    ("2026年 校园招聘", [2026]),
    ("2025校招生 2026", []),  # not a campaign
    ("12026 campus recruitment 20271", []),
    ("2025" + "x" * 24 + "new grad", [2025]),
    ("2025" + "x" * 25 + "new grad", []),
    ("new graduate" + "x" * 24 + "2025", [2025]),
    ("new graduate" + "x" * 25 + "2025", []),
    ("2027 NEWGRAD 27届 2027", [2027]),
    ("no year at all, campus recruitment", []),
    ("", []), (None, []),
]


def test_campaign_years(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(YEARS)], "i int, t string")
    got = {r.i: [x.year for x in r.y] for r in df.select("i", a.campaign_years("t").alias("y")).collect()}
    for i, (text, want) in enumerate(YEARS):
        assert got[i] == want, text


def test_campaign_context(spark):
    text = "a" * 60 + " 2027 campus  recruitment " + "b" * 60
    (found,) = spark.range(1).select(a.campaign_years(F.lit(text)).alias("y")).first().y
    flat = " ".join(text.split())
    at = flat.index("2027")
    assert found.context == flat[at - 40 : at + 4 + 45]


LABELS = [
    ("面试中", "interview"), ("已获得offer，无需笔试", "offer"), ("笔试未通过", "rejected"), ("尚未安排面试", None), ("面试未安排", None),
    ("如果通过面试", None), ("即将进入笔试", None), ("2026-09-01 投递简历", "applied"), ("2026-13-41 投递简历", None), ("官网投递", None),
    ("HR 面", "hr"), ("流程已结束", "rejected"), ("已撤回", "withdrawn"), ("Interview not scheduled", None), ("You will receive an offer", None),
    ("not offered an interview", None), ("Rejected.", "rejected"), ("offer 2026.01.02", "offer"), ("hello", None), ("", None), (None, None),
    ("didn't get the offer; interview on 2026-01-02", "interview"),
]


def test_labels(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LABELS)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", a.label_status("t").alias("s")).collect()}
    for i, (text, want) in enumerate(LABELS):
        assert got[i] == want, text


RECORDS = [
    ("2026-09-01 投递简历\n面试中", ("interview", "面试中")),
    ("2026-09-01 投递简历", ("applied", "投递简历")),
    ("投递", None),  # neither dated nor a success
    ("投递成功", ("applied", "投递成功")),
    ("面试中\noffer", None),  # contradict each other
    ("面试中，一面", ("interview", "一面")),
    ("2026-09-01 投递简历\n尚未安排面试", None),  # in doubt
    ("2026-09-41 投递简历", None),
    ("内推投递\n笔试中", ("written", "笔试中")),
    ("流程已结束", ("rejected", "流程已结束")),
    ("nothing here", None), ("", None), (None, None),
]


def test_records(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RECORDS)], "i int, t string")
    got = {r.i: r.s and tuple(r.s) for r in df.select("i", a.literal_status("t").alias("s")).collect()}
    for i, (text, want) in enumerate(RECORDS):
        assert got[i] == want, text


GATE = a.RoleGate("manager|sales", "technical product", "engineer|developer", "programming|code")
SIGNALS = [("robotics", "arm", "robot arm|robotics"), ("robotics", "ROS", r"(?<![A-Za-z])ROS(?![A-Za-z])"), ("cpp", "C++", r"C\+\+")]
BONUS, HEADINGS = "bonus points|preferred qualifications", "responsibilities|requirements"
POSTINGS = [
    ("Engineer", "Requirements: C++ and robotics", [("robotics", "arm", "body"), ("cpp", "C++", "body")]),
    ("Engineer", "Requirements: C++. Preferred qualifications: robotics, ROS", [("cpp", "C++", "body")]),
    ("Engineer", "Bonus points: C++\n Requirements: ROS\nbonus points robot arm", [("robotics", "ROS", "body")]),
    ("Engineer", "bonus points a bonus points b ROS responsibilities C++", [("cpp", "C++", "body")]),
    ("Robotics engineer", "bonus points: robotics", [("robotics", "arm", "title")]),
    ("Sales manager", "C++ programming", []),
    ("Technical product manager", "C++ code", [("cpp", "C++", "body")]),
    ("Assistant", "ROS at work", []),  # no technical word
    ("Assistant", "ROS and programming", [("robotics", "ROS", "body")]),
    ("Engineer", "CROSS", []), (None, None, []), ("", "", []),
]


def test_directions(spark):
    df = spark.createDataFrame([(i, t, b) for i, (t, b, _) in enumerate(POSTINGS)], "i int, t string, b string")
    got = {r.i: r.d for r in df.select("i", a.directions("t", "b", SIGNALS, GATE, BONUS, HEADINGS).alias("d")).collect()}
    for i, (t, b, want) in enumerate(POSTINGS):
        assert [(x.direction, x.signal, x.source) for x in got[i]] == want, (t, b)
    assert got[0][0].excerpt == "quirements: C++ and robotics"
    long = "word " * 50_000
    row = df.limit(1).select(a.directions(F.lit("Engineer"), F.lit(f"bonus points {long} requirements C++"), SIGNALS, GATE, BONUS, HEADINGS).alias("d")).first()
    assert [x.signal for x in row.d] == ["C++"]


@pytest.mark.parametrize("text", ["x" * 100_000, "2027 campus recruitment " * 2000, "面试中。" * 5000])
def test_long_texts(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(a.campaign_years("t").alias("y"), a.literal_status("t").alias("s")).first()
    assert [y.year for y in row.y] == ([2027] if "2027" in text else [])
    assert (row.s is None) == ("面试" not in text)
