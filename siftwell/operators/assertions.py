"""What a text states: campaign years near markers, and the one status that labels assert. Column functions, no Python."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name a recruitment campaign, in compacted text.
CAMPAIGN = "春招|秋招|校招(?!生)|校园招聘|校园招募|应届生招聘|毕业生招聘|campus recruitment|new ?grad(?:uate)?"


def compacted(text: Column) -> Column:
    """White space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}\x1C-\x1F\x85]+", " "))


def campaign_years(text: Column | str, marker: str = CAMPAIGN, class_mark: str = "届", reach: int = 24) -> Column:
    """Array of (year, context) of the years that belong to a campaign, in their order, each once.

    A year (20yy, or yy before ``class_mark``) counts if a marker begins or ends within ``reach`` characters of it. It doesn't after a ©, as
    part of a longer number, as the beginning of a date (a month or a day follows), nor, of two digits, inside one. The context
    is the first place's, 40 characters before and 45 behind the year. ``marker`` needs a bounded length.
    """
    flat = compacted(F.col(text) if isinstance(text, str) else text)
    two = rf"(?<![-/.月])[12]\d(?= ?(?:{class_mark}))"
    date = r" ?(?:年? ?\d{1,2} ?月|[-/.] ?\d{1,2})"
    near = rf"(?:(?=.{{0,{reach}}}(?:{marker}))|(?<=(?:{marker}).{{0,{reach}}}20\d\d)|(?<=(?:{marker}).{{0,{reach}}}[12]\d))"
    year = rf"(?i)(?<!\d)(?<!©.{{0,3}})(20\d\d|{two})(?!\d)(?!{date}){near}"
    once = F.struct(flat.alias("flat"), F.split(F.regexp_replace(flat, year, "\x01$1\x02"), "\x01").alias("pieces"))
    found = F.get(F.transform(F.array(once), lambda o: F.when(F.size(o["pieces"]) > 1, _places(o["flat"], o["pieces"]))), F.lit(0))
    return F.coalesce(found, F.array().cast("array<struct<year:int,context:string>>"))


def _places(flat: Column, pieces: Column) -> Column:
    """(year, context) from the parts of a text that was cut ahead of each year, whose digits end with a mark."""
    rest = F.slice(pieces, 2, F.size(pieces) - 1)
    sizes = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.length(F.replace(p, F.lit("\x02"), F.lit(""))))
    starts = F.aggregate(sizes, F.array().cast("array<int>"), lambda s, n: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + n)))
    digits = F.transform(rest, lambda p: F.substring_index(p, "\x02", 1))
    found = F.transform(
        F.arrays_zip(digits.alias("d"), starts.alias("at")),
        lambda f: F.struct(
            F.when(F.length(f["d"]) == 2, f["d"].cast("int") + 2000).otherwise(f["d"].cast("int")).alias("year"),
            F.substring(flat, F.greatest(f["at"] - 40, F.lit(0)) + 1, F.least(f["at"], F.lit(40)) + F.length(f["d"]) + 45).alias("context"),
        ),
    )
    none = F.array().cast("array<struct<year:int,context:string>>")
    return F.aggregate(found, none, lambda s, f: F.when(F.exists(s, lambda x: x["year"] == f["year"]), s).otherwise(F.concat(s, F.array(f))))


@dataclass(frozen=True)
class StatusWords:
    """Patterns of a language of status labels. ``stages`` are tried in order; ``submitted`` names the stage that an old label may prove."""

    stages: Sequence[tuple[str, str]]
    condition: str
    negation: str
    denial: str
    future: str
    badge: str
    submitted: str = "applied"


# The words of status labels, in the order in which they are tried.
STATUS_WORDS = StatusWords(
    stages=(
        ("withdrawn", "已撤回|撤回成功|已取消申请|withdrawn"),
        ("rejected", "淘汰|不合适|未通过|暂不匹配|不匹配|流程(?:已)?(?:终止|结束)|申请终止|拒绝|rejected|unsuccessful"),
        ("offer", "offer|已录用|拟录用|录用通知|待入职|已入职|签约"),
        ("hr", r"hr\s*面|人力面|终面|终试|洽谈"),
        ("interview", "面试|初试|复试|一面|二面|三面|interview"),
        ("written", r"笔试|机试|编程测试|在线考试|written\s*test|coding\s*test"),
        ("applied", r"筛选|初筛|简历复筛|简历评估|待评估|评估中|投递|申请成功|已申请|处理中|待处理|等待处理|测评|screening|submitted|under\s*review"),
    ),
    condition=r"如果|假如|倘若|一旦|或许|可能|若(?:通过|完成|进入|获得)|(?:尚|暂|仍|还)未通过|\b(?:if|unless|provided\s+that|assuming)\b",
    negation=r"尚未|暂未|仍未|还未|并未|从未|未曾|未能|未(?!通过)|无需|无须|毋须|不需要|不必|不用|免于|没有|并无|暂无|尚无|不会|不予|不再|不(?:安排|进行|提供|发放|获得|参加|邀请)|\b(?:not|no|never|without|cannot)\b|n't\b",
    denial=r"尚未|暂未|未安排|未开始|未进行|未获得|未发放|未收到|不需要|无需|取消|\b(?:not|never|no\s+longer)\b|n't\b|\b(?:will|would|might|could)\b",
    future=r"即将|计划|预计|拟于|后续|下一步|将(?:会)?|\b(?:will|would|might|could)\b|\bmay\s+(?:be|enter|receive|get|have)\b",
    badge="官网(?:主)?投递|内推(?:投递)?|投递渠道|投递来源",
)
DATE = r"20\d{2}[年./-]\s?\d{1,2}[月./-]\s?\d{1,2}日?(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?"


def _stated_day(clause: Column) -> Column:
    """The day that a clause states; '' if none. One that doesn't exist is null."""
    found = F.regexp_extract(clause, rf"({DATE})", 1)
    day = F.regexp_replace(F.regexp_extract(found, r"^(20\d{2}.\s?\d{1,2}.\s?\d{1,2})", 1), r"[^\d]+", "-")
    return F.when(found == "", "").otherwise(F.try_to_date(day, "yyyy-M-d").cast("string"))


def label_status(label: Column | str, words: StatusWords = STATUS_WORDS) -> Column:
    """The stage that a label asserts, or null: negated, conditional and future labels, channel badges and impossible dates state nothing.

    Negation reaches over its clause only, so a stage that another clause excuses from stays: the first clause that asserts one decides.
    """
    own = F.col(label) if isinstance(label, str) else label
    stated = F.transform(clauses(own), lambda c: clause_status(c, words)["status"])
    return F.get(F.filter(stated, lambda s: s.isNotNull()), F.lit(0))


def clauses(text: Column) -> Column:
    """Parts between punctuation marks and line ends; a full stop inside a number is none."""
    parts = F.split(text, r"[，。；;,!?！？\n\r]+|(?<!\d)\.|\.(?!\d)")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def clause_status(clause: Column, words: StatusWords) -> Column:
    """Struct of status (null: asserts none), label (without its date) and dated."""
    day = _stated_day(clause)
    bare = F.trim(F.regexp_replace(clause, rf"^(?:{DATE})\s*|\s*(?:{DATE})$", ""))
    stage = F.lit(None).cast("string")
    target = F.lit(None).cast("string")
    for name, pattern in reversed(list(words.stages)):
        hit = bare.rlike(f"(?i){pattern}")
        unsure = [f"(?:{words.negation}).*(?:{pattern})", f"(?:{pattern}).*(?:{words.denial})", f"(?:{words.future}).*(?:{pattern})"]
        open_ = bare.rlike("(?i)" + "|".join(f"(?:{u})" for u in unsure))
        stage = F.when(hit, F.when(~open_, name)).otherwise(stage)
        target = F.when(hit, name).otherwise(target)
    closed = day.isNotNull() & ~bare.rlike(f"(?i)(?:{words.condition})") & ~bare.rlike(f"(?i)^(?:{words.badge})$")
    return F.struct(F.when(closed, stage).alias("status"), bare.alias("label"), (F.coalesce(day, F.lit("")) != "").alias("dated"), target.alias("about"))


def literal_status(text: Column | str, words: StatusWords = STATUS_WORDS) -> Column:
    """Struct (status, label) that all assertions of a record's text agree on, or null.

    A submission is only the beginning: any other stage outweighs it, and it counts by itself only with a date or as a success. Different other stages
    contradict each other, and a clause that speaks of a stage without asserting it leaves room for doubt: both give null.
    """
    own = F.col(text) if isinstance(text, str) else text
    all_ = F.transform(clauses(own), lambda c: clause_status(c, words))
    later = F.filter(all_, lambda a: a["status"].isNotNull() & (a["status"] != words.submitted))
    proof = F.filter(all_, lambda a: (a["status"] == words.submitted) & (a["dated"] | a["label"].rlike("(?i)成功|success")))
    doubt = F.exists(all_, lambda a: a["status"].isNull() & a["about"].isNotNull() & ~a["label"].rlike(f"(?i)^(?:{words.badge})$"))
    kinds = F.size(F.array_distinct(F.transform(later, lambda a: a["status"])))
    last = F.coalesce(F.when(kinds == 1, F.try_element_at(later, F.lit(-1))), F.when(kinds == 0, F.try_element_at(proof, F.lit(-1))))
    return F.when(F.coalesce(doubt, F.lit(False)) | last.isNull(), None).otherwise(F.struct(last["status"].alias("status"), last["label"].alias("label")))


@dataclass(frozen=True)
class RoleGate:
    """Patterns of titles and texts that decide whether a posting is a technical role at all."""

    barred: str
    barred_unless: str
    title: str
    body: str


def without_sections(text: Column | str, begins: str, ends: str) -> Column:
    """The text without the sections under headings that match ``begins``, each up to the next heading of ``ends`` or the end."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, rf"(?is)(?:{begins})\s*[:：]?(?:(?!{ends}).)*+", " ")


def directions(title: Column | str, body: Column | str, signals: Sequence[tuple[str, str, str]], gate: RoleGate, bonus: str, headings: str, around: int = 20) -> Column:
    """Array of (direction, signal, source, excerpt), one for each of ``signals`` (direction, signal, pattern) that holds, in their order.

    What stands in a bonus section doesn't count. A signal is looked for in the title, then in the body; the excerpt is what matched with up to
    ``around`` characters on either side. Behind the gate: a barred title that nothing excuses, or a posting without any technical word, has none.
    """
    own = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    once = F.struct(compacted(own(title)).alias("title"), compacted(without_sections(own(body), bonus, headings)).alias("body"))

    def found(o: Column) -> Column:
        barred = o["title"].rlike(f"(?i){gate.barred}") & ~o["title"].rlike(f"(?i){gate.barred_unless}")
        technical = o["title"].rlike(f"(?i){gate.title}") | o["body"].rlike(f"(?i){gate.body}")
        hits = []
        for direction, signal, pattern in signals:
            source = F.when(o["title"].rlike(f"(?i){pattern}"), "title").when(o["body"].rlike(f"(?i){pattern}"), "body")
            text = F.when(o["title"].rlike(f"(?i){pattern}"), o["title"]).otherwise(o["body"])
            excerpt = F.regexp_extract(text, rf"(?i).{{0,{around}}}(?:{pattern}).{{0,{around}}}", 0)
            hit = F.struct(F.lit(direction).alias("direction"), F.lit(signal).alias("signal"), source.alias("source"), excerpt.alias("excerpt"))
            hits.append(F.when(source.isNotNull(), hit))
        return F.when(technical & ~barred, F.array_compact(F.array(*hits)))

    none = F.array().cast("array<struct<direction:string,signal:string,source:string,excerpt:string>>")
    return F.coalesce(F.get(F.transform(F.array(once), found), F.lit(0)), none)
