"""The analytic surface: tables in, one call for each view of the data.

Workspace holds the tables of an analysis; each method returns a DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import EngineConfig
from ..files import written
from ..functions.rrule import parse_rule
from ..operators import calendar as cal
from ..operators import curation, graph, groups, ranking, stats
from ..sources.calendar import parse_events, read_ics
from ..sources.mail import exchanges, mails, parse_messages, read_mbox
from . import reports


@dataclass
class Workspace:
    config: EngineConfig
    mails: DataFrame
    contacts: DataFrame
    filtered: DataFrame
    events: DataFrame | None = None
    attendees: DataFrame | None = None
    decisions: DataFrame | None = None

    def _kept(self) -> DataFrame:
        return curation.effective(self.contacts, self.filtered, self.decisions) if self.decisions is not None else self.filtered

    def contacts_view(self) -> DataFrame:
        return stats.filtered_contacts(self.contacts, self._kept())

    def all_contacts(self) -> DataFrame:
        kept = self._kept().select("email", F.lit(True).alias("shown"))
        listed = self.contacts.withColumn("total", F.col("received") + F.col("sent")).join(kept, "email", "left")
        return listed.withColumn("excluded", F.col("shown").isNull()).drop("shown").orderBy(F.desc("total"), "email")

    def excluded_contacts(self) -> DataFrame:
        return stats.excluded_contacts(self.contacts, self._kept())

    def spam_stats(self) -> DataFrame:
        return stats.spam_stats(self.contacts, self._kept())

    def scored(self) -> DataFrame:
        return ranking.composite(self.contacts_view(), self.config.coefficients)

    def graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes, links and totals."""
        scored = self.scored()
        return graph.nodes(scored, self.config), graph.links(scored), graph.graph_stats(scored)

    def domains(self) -> DataFrame:
        return groups.domain_groups(self.contacts_view())

    def message_groups(self) -> DataFrame:
        return groups.gather(groups.message_members(self.mails, self.config.me))

    def calendar_graph(self) -> DataFrame | None:
        return cal.calendar_graph(self.attendees) if self.attendees is not None else None

    def calendar_stats(self) -> dict[str, DataFrame] | None:
        if self.attendees is None:
            return None
        return {
            "totals": cal.calendar_totals(self.events, self.attendees),
            "top_by_score": cal.calendar_graph(self.attendees).limit(1),
            "top_by_meetings": self.attendees.orderBy(F.desc("total_events_count"), "email").limit(1),
            "top_org": cal.top_organisation(self.attendees),
        }

    def counters(self) -> DataFrame:
        """counter, n: rows of mail and contacts; masters, occurrences and rules that are not expanded of calendars."""
        rows = F.count(F.lit(1)).cast("bigint")
        parts = [df.agg(rows.alias("n")).select(F.lit(name).alias("counter"), "n") for name, df in (("mails", self.mails), ("contacts", self.contacts), ("candidates", self.filtered))]
        if self.events is not None:
            unsupported = (F.col("occurrence_idx") == 0) & (F.col("rrule") != "") & parse_rule(F.col("rrule"))["reason"].isNotNull()
            counts = self.events.agg(F.count_if(F.col("occurrence_idx") == 0).alias("masters"), F.count_if(F.col("occurrence_idx") > 0).alias("occurrences"), F.count_if(unsupported).alias("unsupported_rules"))
            parts.append(counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, counts.columns)), F.array(*counts.columns))).alias("counter", "n")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def node_detail(self, email: str) -> DataFrame:
        """One contact with its mail score and, where it has one, its calendar score and counts."""
        wanted = email.strip().lower()
        mail = self.scored().where(F.lower("email") == wanted).select(F.lower("email").alias("email"), "name", "received", "sent", "meetings", F.col("score").alias("mail_score"), "rankings")
        if self.attendees is None:
            return mail.withColumn("calendar_score", F.lit(None).cast("double"))
        side = self.calendar_graph().where(F.lower("email") == wanted)
        side = side.select(F.lower("email").alias("email"), F.col("score").alias("calendar_score"), "total_events_count", "organized_events_count", "acceptance_rate")
        return mail.join(side, "email", "full_outer")

    def event_groups(self) -> DataFrame | None:
        return groups.gather(groups.event_members(self.events, self.config.me)) if self.events is not None else None

    def members(self, kind: str) -> DataFrame:
        """(label, member) of the groups of a kind: domain, message or event."""
        if kind == "domain":
            return groups.domain_members(self.contacts_view())
        if kind == "message":
            return groups.message_members(self.mails, self.config.me)
        if kind != "event":
            raise ValueError(f"no groups of the kind {kind}")
        if self.events is None:
            return self.mails.where("false").select(F.lit("").alias("label"), F.lit("").alias("member"))
        return groups.event_members(self.events, self.config.me).select("label", "member")

    def group_scores(self, kind: str, limit: int | None = None) -> DataFrame:
        """Groups by the summed score of their visible members, the best first."""
        return groups.group_scores(self.members(kind), self.scored(), limit)

    def group_members(self, kind: str, size: int = 10_000) -> DataFrame:
        """Members of all groups, in rows of at most `size`."""
        return groups.member_pages(self.members(kind), size=size)

    def group_links(self, kind: str) -> DataFrame:
        """Rings through the members of the groups that are drawn."""
        return groups.ring_edges(self.members(kind))

    def shared_groups(self, kind: str, email: str) -> DataFrame:
        """Contacts that share groups with one contact."""
        return groups.co_members(self.members(kind), email.strip().lower())

    def event_pages(self, size: int = 10_000) -> DataFrame | None:
        """Events of each attendee, in rows of at most `size`."""
        return cal.event_pages(self.events, self.config.me, size) if self.events is not None else None

    def write_reports(self, path: str) -> None:
        """Ranking files of the shown contacts."""
        reports.write_reports(self.contacts_view(), path, self.config.coefficients)

    def overall(self) -> tuple[DataFrame, DataFrame]:
        """The merged top contacts, and the links among them."""
        scored = self.scored()
        calendar = self.calendar_graph()
        side = calendar.select("email", "name", "score") if calendar is not None else scored.where("false").select("email", "name", "score")
        top = ranking.overall(scored.select("email", "name", "received", "sent", "score"), side, self.config.top_n)
        return top, graph.visible_links(graph.links(scored), top)

    def statistics(self) -> tuple[DataFrame, DataFrame]:
        contacts = self.contacts_view()
        return graph.overview(contacts, self.spam_stats()), graph.leaders(contacts, self.domains(), self.message_groups())

    def mark(self, email: str, action: str, ts: int) -> Workspace:
        """A workspace with one more decision."""
        row = curation.decide(self.contacts.sparkSession, email, action, ts)
        log = row if self.decisions is None else self.decisions.unionByName(row)
        return Workspace(self.config, self.mails, self.contacts, self.filtered, self.events, self.attendees, log)


def load(spark: SparkSession, config: EngineConfig, mbox: str | list[str] | None = None, ics: str | list[str] | None = None, classes: DataFrame | None = None) -> Workspace:
    """Reads archives and calendars, and derives all tables; either may be missing.

    Files are parsed once: messages, contacts, events and attendees are written to the shared folder, and views read
    them there. save() and reopen() keep them beyond the application.
    """
    parsed = written(parse_messages(read_mbox(spark, mbox))) if mbox else spark.createDataFrame([], schemas.PARSED)
    contacts = written(stats.candidates(stats.contact_metrics(stats.contact_stats(exchanges(parsed, config.me)))))
    events = attendees = None
    if ics:
        masters = cal.expand_events(parse_events(read_ics(spark, ics)), config.now, config.lookback_days, config.max_occurrences)
        # Ids sort by file, place in the file and occurrence.
        at = [F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("event_pos", 19), ("occurrence_idx", 6))]
        events = written(masters.withColumn("event_id", F.concat_ws("#", "source_path", *at)))
        attendees = written(cal.link_contacts(cal.attendee_stats(events, config.me, lists=False), contacts))
    return Workspace(config, mails(parsed), contacts, stats.verified(contacts, classes), events, attendees)


TABLES = ("mails", "contacts", "filtered", "events", "attendees", "decisions")


def save(workspace: Workspace, path: str, mode: str = "overwrite") -> None:
    """All tables as Parquet."""
    for name in TABLES:
        if (df := getattr(workspace, name)) is not None:
            df.write.mode(mode).parquet(f"{path}/{name}")


def reopen(spark: SparkSession, config: EngineConfig, path: str) -> Workspace:
    """The workspace that save() wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {name for name in TABLES if files.exists(spark._jvm.org.apache.hadoop.fs.Path(where, name))}
    return Workspace(config, **{name: spark.read.parquet(f"{path}/{name}") if name in there else None for name in TABLES})
