"""Groups of contacts: by domain, by message subject and by event; their scores, members and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..files import written
from ..functions.dates import day
from ..functions.text import clean_subject, domain
from .order import dealt, join_dealt, numbered, paged


def organisational(contacts: DataFrame) -> DataFrame:
    """Contacts with a domain that is not a mailbox provider's, and that domain."""
    return contacts.withColumn("domain", domain(F.col("email"))).where((F.col("domain") != "") & ~F.col("domain").isin(rules.PERSONAL_DOMAINS))


def domain_groups(contacts: DataFrame, least: int = 2) -> DataFrame:
    """domain, size, total and members (largest total first)."""
    rows = organisational(contacts).withColumn("total", F.col("received") + F.col("sent"))
    groups = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("size"), F.sum("total").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("t"), "email"))).alias("m"))
    return groups.where(F.col("size") >= least).select(F.col("domain").alias("label"), "size", "total", F.transform("m", lambda x: x["email"]).alias("members"))


def message_members(mails: DataFrame, me: str) -> DataFrame:
    """(label, member) of all recipients and senders of messages that share sender and subject with one of mine."""
    mine = mails.where((F.col("subject") != "") & ((F.col("from") == me) | (F.col("to") == me))).select("from", "subject").distinct()
    rows = mails.join(mine, ["from", "subject"], "left_semi").select(clean_subject(F.col("subject")).alias("label"), F.explode(F.array("from", "to")).alias("member"))
    member = F.lower(F.trim("member"))
    return rows.where("label <> ''").select("label", member.alias("member")).where((F.col("member") != "") & (F.col("member") != me)).distinct()


def event_people(events: DataFrame, me: str) -> DataFrame:
    """(uid, member) of all series, each once, as a table in the shared folder."""
    people = events.select("uid", F.explode("attendees").alias("a")).select("uid", F.lower(F.trim("a.email")).alias("member"))
    people = written(people.where((F.col("member") != "") & (F.col("member") != me)))
    return written(dealt(people, people.count(), "uid", "member").distinct())


def event_series(events: DataFrame, me: str) -> tuple[DataFrame, DataFrame]:
    """Series with at least two members: (uid, base, date, first_id), and (uid, member) of all. The latter is written to the shared folder."""
    series = events.groupBy("uid").agg(
        F.min("event_id").alias("first_id"), F.min_by(F.trim("summary"), F.when(F.trim("summary") != "", F.col("event_id"))).alias("title"), F.min("dtstart").alias("dtstart")
    )
    members = event_people(events, me)
    sizes = members.groupBy("uid").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    kept = series.join(sizes, "uid", "left_semi")
    return kept.select("uid", F.coalesce("title", F.lit("(untitled event)")).alias("base"), day(F.col("dtstart")).alias("date"), "first_id"), members


#: What labels add to a title: a date or a number.
_ADDED = r"(?s)^(.*) (?:— (\d{4}-\d{2}-\d{2})|\(([1-9]\d{0,8})\))$"


def _contested(series: DataFrame) -> DataFrame:
    """Titles that are also what another title with a date or number reads: base, date, n, child, child_id (who first has it as title).

    A label that ends in a number or a date comes from one title only, so no two titles with additions read alike.
    """
    titles = series.groupBy("base").agg(F.min("first_id").alias("child_id"))
    part = lambda k: F.regexp_extract("base", _ADDED, k)
    told = titles.select(part(1).alias("stem"), part(2).alias("added_date"), part(3).try_cast("int").alias("n"), F.col("base").alias("child"), "child_id")
    told = told.where("stem <> '' and (added_date <> '' or n >= 2)")
    return told.join(titles.select(F.col("base").alias("stem")), "stem", "left_semi").withColumnRenamed("stem", "title")


def _labelled(series: DataFrame, contested: DataFrame | None = None) -> DataFrame:
    """series(uid, base, date, first_id, taken) with labels; taken: another title's label reads like this title before it has a series.

    The first series of a title has it, the first further one of a date the title with the date, the others the title
    with the next free number. A contested name is free for the title with the addition until its child's first series.
    """
    firsts = series.groupBy("base").agg(F.min("first_id").alias("first_of_base"))
    series = series.join(firsts, "base").withColumn("leads", ~F.col("taken") & (F.col("first_id") == F.col("first_of_base"))).drop("first_of_base")
    dated = series.where(~F.col("leads") & (F.col("date") != "")).groupBy("base", "date").agg(F.min("first_id").alias("first_of_date"))
    if contested is not None:
        until = contested.where("added_date <> ''").select(F.col("title").alias("base"), F.col("added_date").alias("date"), "child_id")
        dated = dated.join(until, ["base", "date"], "left").where("child_id is null or first_of_date < child_id").drop("child_id")
    series = series.join(dated, ["base", "date"], "left")
    label = F.when(F.col("leads"), F.col("base")).when(F.col("first_id") == F.col("first_of_date"), F.concat("base", F.lit(" — "), "date"))
    series = written(series.select("uid", "base", "first_id", label.alias("label")))
    rest = numbered(series.where("label is null"), ["base"], [F.col("first_id")], "r")
    if contested is None:
        number = F.col("r") + 1
    else:
        # Numbers ascend, so one is passed over if it is gone when the series whose turn it is has come: when fewer
        # series than come before it stand before the child's first one.
        numbers = contested.where("n is not null").select(F.col("title").alias("base"), F.col("n").cast("bigint").alias("n"), "child_id")
        ahead = numbers.join(rest.select("base", "first_id"), "base", "left").groupBy("base", "n").agg(F.count_if(F.col("first_id") < F.col("child_id")).alias("before"))
        turns = ahead.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("n", "before"))).alias("turns"))
        start = F.array().cast("array<bigint>")
        # Of each number passed over: from which place on a series has one number more.
        step = lambda gone, t: F.when(t["n"] - 1 - F.size(gone) > t["before"], F.array_append(gone, t["n"] - 1 - F.size(gone))).otherwise(gone)
        rest = rest.join(turns.select("base", F.aggregate("turns", start, step).alias("gone")), "base", "left")
        number = F.col("r") + 1 + F.size(F.filter(F.coalesce("gone", start), lambda g: g <= F.col("r")))
    rest = rest.select("uid", "base", F.concat("base", F.lit(" ("), number.cast("string"), F.lit(")")).alias("label"))
    return series.where("label is not null").select("uid", "base", "label").unionByName(rest)


def event_labels(series: DataFrame) -> DataFrame:
    """uid and label of event_series(): each the first name that no earlier series has: title, title with date, title with number.

    Titles that read like another title's label form chains, "X", "X (2)", "X (2) (2)", which are resolved from their
    roots on, one step for all chains at a time; all other titles are labelled in one step.
    """
    series = written(series.select("uid", "base", "date", "first_id"))
    contested = written(_contested(series))
    none, some = F.lit(False), F.lit(True)
    if contested.isEmpty():
        return _labelled(series.withColumn("taken", none)).select("uid", "label")
    tangled = contested.select(F.explode(F.array("title", "child")).alias("base")).distinct()
    children = contested.select(F.col("child").alias("base"))
    parts = [_labelled(series.join(tangled, "base", "left_anti").withColumn("taken", none)).select("uid", "label")]
    turn = tangled.join(children, "base", "left_anti").withColumn("taken", none)
    while not turn.isEmpty():
        own = written(_labelled(series.join(turn, "base"), contested))
        parts.append(own.select("uid", "label"))
        coming = contested.join(turn.select(F.col("base").alias("title")), "title", "left_semi").select(F.col("child").alias("base"))
        gone = own.select(F.col("label").alias("base")).distinct().withColumn("had", some)
        turn = written(coming.join(gone, "base", "left").select("base", F.coalesce("had", none).alias("taken")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def event_members(events: DataFrame, me: str, labels: bool = True) -> DataFrame:
    """(label, member, uid) of series with at least two members besides me; without labels (uid, member) alone."""
    if not labels:
        people = event_people(events, me)
        sizes = _sizes(people, "uid").where("size >= 2")
        return written(join_dealt(people, sizes, "uid", "size", people.count()).select("uid", "member"))
    series, members = event_series(events, me)
    return members.join(event_labels(series), "uid").select("label", "member", "uid")


def gather(members: DataFrame, least: int = 2) -> DataFrame:
    """label, size and sorted members of groups of at least so many."""
    groups = members.groupBy("label").agg(F.sort_array(F.collect_set("member")).alias("members"))
    return groups.withColumn("size", F.size("members").cast("bigint")).where(F.col("size") >= least)


def _each_once(members: DataFrame) -> tuple[DataFrame, int]:
    """(label, member), each once, and the number of rows that they come from. Large groups are split over tasks."""
    rows = members.select("label", "member")
    total = rows.count()
    return dealt(rows, total, "label", "member").distinct(), total


def _sizes(rows: DataFrame, key: str = "label") -> DataFrame:
    """key and size; rows of a key that many have are added up before they meet."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"))


def group_scores(members: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Groups with MIN_GROUP visible members: count, score, received, sent, domains; the best first."""
    rows, total = _each_once(members)
    facts = nodes.select(F.lower("email").alias("member"), "score", "received", "sent").join(_sizes(rows, "member"), "member")
    joined = join_dealt(rows, facts, "member", "size", total).withColumn("domain", domain(F.col("member")))
    sums = [F.sum(c).alias(c) for c in ("score", "received", "sent")]
    parts = dealt(joined, total, "label", "domain").groupBy("label", "domain").agg(F.count(F.lit(1)).alias("members"), *sums)
    groups = dealt(parts, total, "label").groupBy("label").agg(F.sum("members").alias("members"), *sums, F.count("domain").alias("domains"))
    groups = groups.where(F.col("members") >= rules.MIN_GROUP).orderBy(F.desc("score"), "label")
    return groups.limit(limit) if limit else groups


def co_members(members: DataFrame, email: str, least: int = rules.MIN_GROUP) -> DataFrame:
    """Contacts that share a group with one contact: label of the largest shared group, and how many."""
    rows, total = _each_once(members)
    own = rows.where(F.col("member") == email).select("label").join(_sizes(rows).where(F.col("size") >= least), "label")
    shared = join_dealt(rows, own, "label", "size", total).where(F.col("member") != email)
    return shared.groupBy("member").agg(F.count(F.lit(1)).alias("shared"), F.min_by("label", F.struct(-F.col("size"), F.col("label"))).alias("largest"))


def ring_edges(members: DataFrame, most: int = rules.MAX_ROPE) -> DataFrame:
    """label, a, b: edges of a ring through the members of groups of 2 to `most` members, in order; two members have one edge.

    members(label, member) may hold groups of any size: larger ones are counted, but never gathered.
    """
    rows, total = _each_once(members)
    group = Window.partitionBy("label").orderBy("member")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    few = join_dealt(rows, _sizes(rows), "label", "size", total).where(F.col("size").between(2, most))
    linked = few.select("label", "size", F.col("member").alias("a"), F.lead("member").over(group).alias("next"), F.first("member").over(whole).alias("first"))
    return linked.where("next is not null or size > 2").select("label", "a", F.coalesce("next", "first").alias("b"))


def rope_edges(groups: DataFrame, most: int = rules.MAX_ROPE) -> DataFrame:
    """ring_edges() of groups that have been gathered."""
    return ring_edges(groups.where(F.size("members") <= most).select("label", F.explode("members").alias("member")), most)


def domain_members(contacts: DataFrame) -> DataFrame:
    """(label, member) of the organisations' contacts."""
    return organisational(contacts).select(F.col("domain").alias("label"), F.lower("email").alias("member"))


def member_pages(members: DataFrame, least: int = 2, size: int = 10_000) -> DataFrame:
    """label, size, page, members: groups of at least so many as rows of at most `size` members, in order."""
    rows = members.select("label", "member").distinct()
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return paged(rows.join(sizes.select("label"), "label", "left_semi"), "label", "member", size).join(sizes, "label").select("label", "size", "page", F.col("values").alias("members"))
