"""Records and the entries of the pages that show them: matched in tiers, from both sides, with a reason for every record that has none.

``records``: page, record, title. ``entries``: page, entry, record_id (which record it names itself; may be null), title and context (may be
null or empty). All joins are equi-joins on a page and an id, a title key or a title's rarest word; no pair of a page is formed otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOT_MATCHED, AMBIGUOUS, MISMATCH = "status_entry_not_matched", "status_entry_ambiguous", "target_job_mismatch"
#: Confidence of each tier.
TIERS = {"record_id": 0.99, "unique_title": 0.95, "unique_page": 0.95, "unique_context": 0.90}


def key(text: Column | str) -> Column:
    """Words of letters and digits, lower case, one space between and around them."""
    own = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"[^\p{L}\p{N}+#]+", " "))
    return F.concat(F.lit(" "), own, F.lit(" "))


def _words(k: Column | str) -> Column:
    return F.filter(F.array_distinct(F.split(F.trim(k), " ")), lambda w: w != "")


def _in_context(records: DataFrame, entries: DataFrame) -> DataFrame:
    """(page, record, entry) where the record's title stands in the entry's context. They meet by the longest word of the title."""
    own = records.where("key <> '  '").withColumn("word", F.element_at(F.sort_array(F.transform(_words("key"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), False), 1)["w"])
    words = entries.select("page", "entry", "context_key", F.explode(_words("context_key")).alias("word"))
    return own.join(words, ["page", "word"]).where(F.contains("context_key", F.col("key"))).select("page", "record", "entry")


def _sides(pairs: DataFrame) -> DataFrame:
    """For each pair's record the number of its entries and one of them, and of that one the number of its records."""
    n_records = pairs.groupBy("page", "entry").agg(F.count("*").alias("n_records"))
    of = pairs.groupBy("page", "record").agg(F.count("*").alias("n_entries"), F.min("entry").alias("entry"))
    return of.join(n_records, ["page", "entry"])


def match_entries(records: DataFrame, entries: DataFrame) -> DataFrame:
    """page, record, entry, method, confidence, reason: one row a record; entry, method and confidence are null where there is a reason.

    1. *record_id*: the entry that names the record. Its own title, if it has one, must be this record's alone on the page; so must the titles
       in its context, if there are any.
    2. *unique_title*: among entries without an id, the one with the record's title, which no other record has.
    3. *unique_page*: the only record and the only entry, which names and titles nothing.
    4. *unique_context*: among entries without an id, the one whose context holds the record's title, and no other record's.

    A tier that finds more than one entry, or one that another record claims too, ends with a reason. An empty page key is a page.
    """
    rec = records.select("page", "record", key("title").alias("key"))
    ent = entries.select("page", "entry", "record_id", key("title").alias("title_key"), key("context").alias("context_key"))
    open_ = ent.where("record_id is null")
    titles = rec.withColumnRenamed("key", "title_key").where("title_key <> '  '")
    by_title = titles.join(ent, ["page", "title_key"]).select("page", "record", "entry")
    context = _in_context(rec, ent)
    in_open = open_.select("page", "entry")

    # what an entry that names a record says of it besides
    told = lambda pairs, name: pairs.groupBy("page", "entry").agg(F.count("*").alias(f"n_{name}"), F.min("record").alias(f"{name}_of"))
    named = ent.where("record_id is not null").join(told(by_title, "title"), ["page", "entry"], "left").join(told(context, "context"), ["page", "entry"], "left")
    agrees = lambda name: (F.col(f"n_{name}") == 1) & (F.col(f"{name}_of") == F.col("record_id"))
    fits = (F.col("title_key").eqNullSafe("  ") | F.coalesce(agrees("title"), F.lit(False))) & (F.col("n_context").isNull() | agrees("context"))
    by_id = named.groupBy("page", F.col("record_id").alias("record")).agg(F.count("*").alias("id_n"), F.min("entry").alias("id_entry"), F.bool_and(fits).alias("id_fits"))

    sides = lambda pairs, p: _sides(pairs.join(in_open, ["page", "entry"], "left_semi")).select("page", "record", F.col("n_entries").alias(f"{p}_n"), F.col("entry").alias(f"{p}_entry"), F.col("n_records").alias(f"{p}_by"))
    size = rec.groupBy("page").agg(F.count("*").alias("n_rec"))
    shown = ent.groupBy("page").agg(F.count("*").alias("n_ent"), F.count_if(F.col("record_id").isNull() & (F.col("title_key") == "  ")).alias("bare"), F.min("entry").alias("one"))
    own = rec.join(by_id, ["page", "record"], "left").join(sides(by_title, "title"), ["page", "record"], "left").join(sides(context, "context"), ["page", "record"], "left")
    own = own.join(size, "page", "left").join(shown, "page", "left")

    only_page = (F.col("n_rec") == 1) & (F.col("n_ent") == 1) & (F.col("bare") == 1)
    done = (
        F.when(F.col("id_n") > 1, AMBIGUOUS).when(F.col("id_n") == 1, F.when(F.col("id_fits"), "record_id").otherwise(MISMATCH))
        .when(F.col("title_n") > 1, AMBIGUOUS).when(F.col("title_n") == 1, F.when(F.col("title_by") == 1, "unique_title").otherwise(MISMATCH))
        .when(only_page, "unique_page")
        .when(F.col("context_n") > 1, AMBIGUOUS).when(F.col("context_n") == 1, F.when(F.col("context_by") == 1, "unique_context").otherwise(MISMATCH))
        .otherwise(NOT_MATCHED)
    )
    entry = F.when(F.col("d") == "record_id", F.col("id_entry")).when(F.col("d") == "unique_title", F.col("title_entry")).when(F.col("d") == "unique_page", F.col("one")).when(F.col("d") == "unique_context", F.col("context_entry"))
    sure = F.create_map(*(F.lit(x) for t in TIERS.items() for x in t))
    known = F.col("d").isin(*TIERS)
    return own.withColumn("d", done).select(
        "page", "record", entry.alias("entry"), F.when(known, F.col("d")).alias("method"), F.try_element_at(sure, F.col("d")).alias("confidence"), F.when(~known, F.col("d")).alias("reason")
    )


def balanced_sample(rows: DataFrame, key_col: str, groups: str, tags: str, weight: str, order: list[str], quota: int) -> list[tuple[str, str]]:
    """(group, key) in the order of choice: up to ``quota`` rows for each of the ordered groups, tags covered as widely as may be.

    The group that is least filled chooses next (then the one with the fewest rows left, then the first in ``order``), of its unused rows the one that adds
    most new tags, then one that is in this group alone, then the heaviest, then the smallest key. Rows of one group that have the same tags and
    are alone there or not differ in weight and key only, so of these the first quota * groups suffice, however large the table: only they
    and the groups' counts come to the driver.
    """
    most = quota * len(order)
    kinds = rows.select(F.col(key_col).cast("string").alias("key"), F.array_sort(F.array_intersect(groups, F.array(*map(F.lit, order)))).alias("groups"), F.array_sort(F.array_distinct(tags)).alias("tags"), F.col(weight).alias("weight"))
    each = kinds.select("*", F.explode("groups").alias("group"))
    best = Window.partitionBy("group", "tags", F.size("groups") == 1).orderBy(F.desc("weight"), "key")
    few = each.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most)
    left = {r.group: r["count"] for r in each.groupBy("group").count().collect()}
    found = {r.key: r for r in few.select("key", "groups", "tags", "weight").distinct().collect()}
    chosen: list[tuple[str, str]] = []
    filled, covered = dict.fromkeys(order, 0), set()
    while True:
        free = [g for g in order if filled[g] < quota and left.get(g, 0) > 0]
        if not free:
            return chosen
        group = min(free, key=lambda g: (filled[g], left[g], order.index(g)))
        pick = min((r for r in found.values() if group in r.groups), key=lambda r: (-len(set(r.tags) - covered), len(r.groups) != 1, -r.weight, r.key))
        chosen.append((group, pick.key))
        covered.update(pick.tags)
        filled[group] += 1
        for g in found.pop(pick.key).groups:
            left[g] -= 1
