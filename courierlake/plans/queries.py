"""Named queries over the adapter views, each with the DuckDB SQL that has to give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..config import EngineConfig
from ..functions import dates, ics, rrule, text
from ..operators import calendar as cal
from ..operators import classify, curation, graph, groups, ranking, stats
from ..sources.calendar import parse_events, read_ics
from ..sources.mail import parse_messages, read_mbox
from . import reports
from .adapters import ME, NOW, calendar, calendar_files, duck, exchanges, mail_archive, threads

CONFIG = EngineConfig(me=ME, now=NOW)
_FOUND: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- contacts ----------------------------------------------------------------------------------------------


def _alternatives(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def _rule_sql(words: list[str]) -> str:
    whole, inside = [w for w in words if not set(w) & set("-_.")], [w for w in words if set(w) & set("-_.")]
    out = f"regexp_matches(split_part(email, '@', 1), '(^|[._+-])({_alternatives(whole)})([._+-]|$)')"
    return f"({out} or regexp_matches(split_part(email, '@', 1), '{_alternatives(inside)}'))" if inside else f"({out})"


_RATE = "case when first_ts >= last_ts or (last_ts - first_ts) / 86400.0 / 30.44 < 1 then cast({x} as double) else floor({x} / ((last_ts - first_ts) / 86400.0 / 30.44) * 100 + 0.5) / 100 end"
_CTE = f"""
with x as ({duck("mail")}),
stats as (
  select contact as email, coalesce(arg_min(name, msg_pos) filter (where name <> ''), '') as name, count(*) filter (where dir = 'received') as received,
    count(*) filter (where dir = 'sent') as sent, min(date) as first_ts, max(date) as last_ts, cast(sum(chars) as bigint) as total_chars,
    count(*) as email_count, count(*) filter (where is_meeting) as meetings
  from x group by contact),
metrics as (
  select email, case when name = '' then split_part(email, '@', 1) else name end as name, received, sent,
    {_RATE.format(x="sent")} as sent_per_month, {_RATE.format(x="received")} as received_per_month,
    floor(total_chars / email_count * 100 + 0.5) / 100 as average_chars,
    case when last_ts > first_ts then floor((last_ts - first_ts) / 86400.0 * 100 + 0.5) / 100 else 0.0 end as duration, meetings
  from stats),
flags as (
  select *, {_rule_sql(rules.NOREPLY)} as is_noreply, {_rule_sql(rules.AUTOMATED)} as is_automated, {_rule_sql(rules.MARKETING)} as is_marketing,
    received = 0 or sent = 0 as is_one_way, regexp_matches(split_part(email, '@', 2), '(^|\\.)({_alternatives(rules.BLOCKED_DOMAINS)})$') as is_blocked_domain,
    (strlen(name) > 3 and name = upper(name) and regexp_matches(name, '[A-Za-z]'))
      or length(regexp_replace(name, '[A-Za-z0-9 ]', '', 'g')) > 0.5 * length(regexp_replace(name, '[^A-Za-z]', '', 'g')) as is_suspicious_name
  from metrics),
reasons as (
  select *, case when is_noreply then 'noreply' when is_automated then 'automated' when is_marketing then 'marketing' when is_one_way then 'one_way'
    when is_blocked_domain then 'blocked_domain' when is_suspicious_name then 'suspicious_name' end as spam_reason
  from flags),
cand as (select email, name, received, sent, sent_per_month, received_per_month, average_chars, duration, meetings, spam_reason is null as not_spam from reasons),
kept as (select * from cand where not_spam and (meetings % 7) <> 3),
filtered as (select *, received + sent as total from kept),
live as (select *, case when duration <= 0 or duration / 30.44 < 1 then cast(sent as double) else sent / (duration / 30.44) end as sent_pm,
  case when duration <= 0 or duration / 30.44 < 1 then cast(received as double) else received / (duration / 30.44) end as received_pm from filtered),
scored as (
  select *, rank() over (order by sent desc) as rank_sent, rank() over (order by received desc) as rank_received,
    greatest(0, count(*) over () - rank() over (order by sent desc) + 1) * cast(1.0 as double) as points_sent,
    greatest(0, count(*) over () - rank() over (order by received desc) + 1) * cast(0.2 as double) as points_received,
    case when sum(meetings) over () > 0 then meetings / sum(meetings) over () * 300 else 0.0 end as bonus
  from filtered),
online as (select *, points_sent + points_received + bonus as score from scored)
"""


def _stats(spark, sf_dir):
    return stats.contact_stats(exchanges(spark, sf_dir))


def _cand(spark, sf_dir):
    return stats.candidates(stats.contact_metrics(_stats(spark, sf_dir)))


def _kept(contacts):
    """Some candidates fail a second look, so that all tables differ."""
    classes = contacts.select("email", F.when(F.col("meetings") % 7 == 3, F.lit(0)).otherwise(F.lit(2)).alias("cls"))
    return stats.verified(contacts, classes)


def _filtered(spark, sf_dir):
    contacts = _cand(spark, sf_dir)
    return stats.filtered_contacts(contacts, _kept(contacts))


def _online(spark, sf_dir):
    return ranking.composite(_filtered(spark, sf_dir))


@query(f"{_CTE} select * from stats")
def contact_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


@query(f"{_CTE} select * from metrics")
def contact_metrics(spark, sf_dir):
    return stats.contact_metrics(_stats(spark, sf_dir))


@query(f"{_CTE} select email, is_noreply, is_automated, is_marketing, is_one_way, is_blocked_domain, is_suspicious_name, spam_reason from reasons")
def spam_flags(spark, sf_dir):
    flagged = stats.with_spam_rules(stats.contact_metrics(_stats(spark, sf_dir)))
    return flagged.select("email", *[c for c in flagged.columns if c.startswith("is_")], "spam_reason")


@query(f"{_CTE} select * from cand")
def candidates(spark, sf_dir):
    return _cand(spark, sf_dir)


@query(f"{_CTE} select email, total, true as not_clear from filtered")
def filtered_contacts(spark, sf_dir):
    return _filtered(spark, sf_dir).select("email", "total", "not_clear")


@query(f"{_CTE} select email, received + sent as total from cand where not_spam and email not in (select email from kept)")
def excluded_contacts(spark, sf_dir):
    contacts = _cand(spark, sf_dir)
    return stats.excluded_contacts(contacts, _kept(contacts)).select("email", "total")


@query(f"{_CTE} select email from cand where email not in (select email from kept)")
def excluded_emails(spark, sf_dir):
    contacts = _cand(spark, sf_dir)
    return stats.excluded_contacts(contacts, _kept(contacts), candidates_only=False).select("email")


@query(f"{_CTE} select count(*) as excluded_count, cast(coalesce(sum(received + sent), 0) as bigint) as excluded_total from cand where email not in (select email from kept)")
def spam_stats(spark, sf_dir):
    contacts = _cand(spark, sf_dir)
    return stats.spam_stats(contacts, _kept(contacts))


_VALUE = {"sent": "sent", "sent_per_month": "sent_pm", "received": "received", "received_per_month": "received_pm", "duration": "duration", "email_length": "average_chars"}


def _ranking_query(metric: str):
    def run(spark, sf_dir):
        return ranking.metric_ranking(_filtered(spark, sf_dir), metric)

    run.__name__ = f"rank_{metric}"
    query(f"{_CTE} select rank() over (order by round(cast({_VALUE[metric]} as double), 9) desc) as rank, name, email, cast({_VALUE[metric]} as double) as value from live")(run)


for _metric in ranking.METRICS:
    _ranking_query(_metric)


@query(f"{_CTE} select rank() over (order by sent desc) || '. ' || name || ' ' || email || ' ' || sent as line from filtered")
def ranking_text(spark, sf_dir):
    return ranking.ranking_lines(ranking.metric_ranking(_filtered(spark, sf_dir), "sent"), whole=True)


@query(f"{_CTE} select email, rank_sent, rank_received, points_sent + points_received as score, rank() over (order by round(points_sent + points_received, 9) desc) as rank from online")
def composite_offline(spark, sf_dir):
    scored = ranking.composite(_filtered(spark, sf_dir), meetings=False)
    return ranking.competition_ranks(scored, "score").select("email", "rank_sent", "rank_received", "score", "rank")


def _reports_sql() -> str:
    report = "select '{m}_ranking' as report, rank() over (order by round(cast({v} as double), 9) desc) as rank, 0 as nth, email, name, {shown} as shown from live"
    shown = {m: v if m in reports.WHOLE else f"printf('%.2f', cast({v} as double))" for m, v in _VALUE.items()}
    rows = " union all ".join(report.format(m=m, v=v, shown=f"cast({shown[m]} as varchar)") for m, v in _VALUE.items())
    told = "printf('%s:#%d (%.1f), %s:#%d (%.1f)', 'sent', rank_sent, points_sent, 'received', rank_received, points_received)"
    head = "', '".join(reports.header_lines(rules.COEFFICIENTS, "%n"))
    return f"""{_CTE}, m as ({rows}), off as (select *, points_sent + points_received as points from online),
head as (select unnest(['{head}']) as text, generate_subscripts(['{head}'], 1) as nth)
select report, rank, nth, email, rank || '. ' || name || ' ' || email || ' ' || shown as line from m
union all select 'composite_ranking', rank() over (order by round(points, 9) desc), 0, email,
  rank() over (order by round(points, 9) desc) || '. ' || name || ' ' || email || ' | score: ' || printf('%.1f', points) || ' | ' || {told} from off
union all select 'composite_ranking', 0, cast(nth as integer), '', replace(text, '%n', (select cast(count(*) as varchar) from filtered)) from head"""


@query(_reports_sql())
def ranking_reports(spark, sf_dir):
    return reports.report_lines(_filtered(spark, sf_dir))


@query(f"{_CTE} select email, rank_sent, rank_received, score from online")
def composite_online(spark, sf_dir):
    return _online(spark, sf_dir).select("email", "rank_sent", "rank_received", "score")


@query(f"{_CTE} select 'me' as id, true as is_center, 0 as received, 0 as sent, 999999999.0::double as score union all select email, false, received, sent, score from online")
def graph_nodes(spark, sf_dir):
    return graph.nodes(_online(spark, sf_dir), CONFIG).select("id", "is_center", "received", "sent", "score")


@query(f"{_CTE} select email as source, 'me' as target, 'received' as type, received as weight from filtered where received > 0 union all select 'me', email, 'sent', sent from filtered where sent > 0")
def graph_links(spark, sf_dir):
    return graph.links(_filtered(spark, sf_dir))


@query(f"{_CTE} select count(*) as total_contacts, cast(sum(received) as bigint) as total_received, cast(sum(sent) as bigint) as total_sent from filtered")
def graph_stats(spark, sf_dir):
    return graph.graph_stats(_filtered(spark, sf_dir))


_PERSONAL = ", ".join(f"'{d}'" for d in rules.PERSONAL_DOMAINS)
_DOMAINS = f"""{_CTE}, doms as (select split_part(email, '@', 2) as label, count(*) as size, cast(sum(total) as bigint) as total, list(email order by total desc, email) as members
  from filtered where split_part(email, '@', 2) not in ({_PERSONAL}) group by 1 having count(*) >= 2)"""


@query(f"{_DOMAINS} select * from doms")
def domain_groups(spark, sf_dir):
    return groups.domain_groups(_filtered(spark, sf_dir))


@query(f"{_DOMAINS} select label, size from doms order by size desc, label limit 5")
def top5_domains(spark, sf_dir):
    return groups.domain_groups(_filtered(spark, sf_dir)).select("label", "size").orderBy(F.desc("size"), "label").limit(5)


@query(f"{_CTE} select email, score from online order by score desc, email limit 50")
def contact_limit(spark, sf_dir):
    return graph.limited(_online(spark, sf_dir)).select("email", "score")


@query(f"{_CTE}, o as (select *, (row_number() over (order by score desc, email) - 1) % 8 as color from online) select email, color, rank() over (order by score desc) as place from o where contains(lower(name), 'user 1') or contains(lower(email), 'user 1')")
def panel_places(spark, sf_dir):
    return ranking.panel_places(_online(spark, sf_dir), "User 1").select("email", "color", "place")


@query(f"""{_CTE} select email, 11.0::double + score / max(score) over () * 19 as radius, received / (received + sent) as received_ratio,
  cast(floor(received * 100 / (received + sent) + 0.5) as bigint) as received_percent from online""")
def node_radius(spark, sf_dir):
    return graph.node_sizes(_online(spark, sf_dir))


_SPAM = "spam as (select count(*) as excluded_count, cast(coalesce(sum(received + sent), 0) as bigint) as excluded_total from cand where email not in (select email from kept)), tot as (select count(*) as n, sum(received) as r, sum(sent) as s from filtered)"


@query(f"""{_CTE}, {_SPAM} select n as total_contacts, cast(r + s as bigint) as exchanged, floor(s / r * 100 + 0.5) / 100 as sent_per_received, floor((r + s) / n * 10 + 0.5) / 10 as mails_per_contact,
  floor(excluded_total / (r + s + excluded_total) * 1000 + 0.5) / 10 as spam_percent from spam, tot""")
def stats_overview(spark, sf_dir):
    contacts = _cand(spark, sf_dir)
    kept = _kept(contacts)
    return graph.overview(stats.filtered_contacts(contacts, kept), stats.spam_stats(contacts, kept))


@query(f"""{_CTE}, log as (
  select email, case when received % 3 = 0 then 'clear' when received % 3 = 1 then 'not_human' else 'restore' end as action, not_spam from cand where sent % 2 = 0),
eff as (select * from log where action <> 'restore' or not_spam)
select coalesce(k.email, e.email) as email, coalesce(e.action, '') = '' as not_clear from kept k full join eff e using (email)
where (k.email is not null or e.action = 'restore') and coalesce(e.action, '') <> 'not_human'""")
def curation_effective(spark, sf_dir):
    contacts = _cand(spark, sf_dir)
    action = F.when(F.col("received") % 3 == 0, F.lit("clear")).when(F.col("received") % 3 == 1, F.lit("not_human")).otherwise(F.lit("restore"))
    early = contacts.where("sent % 2 = 0").select("email", F.lit("clear").alias("action"), F.lit(1).cast("bigint").alias("ts"))
    late = contacts.where("sent % 2 = 0").select("email", action.alias("action"), F.lit(2).cast("bigint").alias("ts"))
    # A restore that has no effect leaves the earlier decision, clear; as the rules reject such contacts, they are not in
    # the table anyway, and the SQL needs the later decisions only.
    return curation.effective(contacts, _kept(contacts), early.unionByName(late))


@query(f"""{_CTE}, v as (select email, unnest([0, 1, 2, 3]) as k, received, sent from cand), votes as (select email, case when received % 3 = 0 then 0 when received % 3 = 1 then 1 else (sent + k) % 2 end as vote from v)
select email, cast(case when min(vote) = max(vote) then min(vote) else 2 end as integer) as cls from votes group by email""")
def vote_unanimous(spark, sf_dir):
    votes = _cand(spark, sf_dir).select("email", "received", "sent", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("vote_no"))
    vote = F.when(F.col("received") % 3 == 0, F.lit(0)).when(F.col("received") % 3 == 1, F.lit(1)).otherwise((F.col("sent") + F.col("vote_no")) % 2)
    return classify.unanimous(votes.select("email", "vote_no", vote.cast("int").alias("vote")))


@query(f"{_CTE}, c as (select email, received % 4 as cls from cand where not_spam and received % 4 < 3) select email, coalesce(cls, 2) <> 1 as not_clear from cand left join c using (email) where not_spam and coalesce(cls, 2) <> 0")
def classification_fill(spark, sf_dir):
    contacts = _cand(spark, sf_dir)
    return stats.verified(contacts, contacts.where("not_spam and received % 4 < 3").select("email", (F.col("received") % 4).alias("cls")))


# ---- messages ----------------------------------------------------------------------------------------------

_THREADS = f"""with t as ({duck("thread")}), mine as (select distinct "from", subject from t where "from" = '{ME}' or "to" = '{ME}'),
rel as (select t.*, trim(regexp_replace(subject, '^(Re:|Fwd:)\\s*', '', 'i')) as label from t join mine using ("from", subject)),
mem as (select distinct label, member from (select label, "from" as member from rel union all select label, "to" from rel) where member <> '{ME}'),
grp as (select label, list(member order by member) as members, count(*) as size from mem group by label having count(*) >= 2)"""


def _message_members(spark, sf_dir):
    return groups.message_members(threads(spark, sf_dir), ME)


@query(f"{_THREADS} select * from grp")
def message_groups(spark, sf_dir):
    return groups.gather(_message_members(spark, sf_dir))


@query(f"{_THREADS} select label, size, page, members[page * 10 + 1 : page * 10 + 10] as members from (select *, unnest(range(0, (size + 9) // 10)) as page from grp)")
def message_group_pages(spark, sf_dir):
    return groups.member_pages(_message_members(spark, sf_dir), size=10)


@query(f"{_THREADS} select floor(avg(size) * 10 + 0.5) / 10 as avg_size, count(*) as groups from grp where size >= 3")
def avg_group_size(spark, sf_dir):
    big = groups.gather(_message_members(spark, sf_dir), rules.MIN_GROUP)
    return big.agg((F.floor(F.avg("size") * 10 + 0.5) / 10).alias("avg_size"), F.count(F.lit(1)).alias("groups"))


@query(f"{_DOMAINS}, {_THREADS.removeprefix('with ')} , w as (select 'received' as kind, email as name, received as value, row_number() over (order by received desc, email) as k from filtered union all select 'sent', email, sent, row_number() over (order by sent desc, email) from filtered union all select 'domain', label, total, row_number() over (order by total desc, label) from doms union all select 'message_group', label, size, row_number() over (order by size desc, label) from grp) select kind, name, cast(value as bigint) as value from w where k = 1")
def stats_argmax(spark, sf_dir):
    contacts = _filtered(spark, sf_dir)
    return graph.leaders(contacts, groups.domain_groups(contacts), groups.gather(_message_members(spark, sf_dir)))


_SUBJECT = "case turn % 6 when 0 then concat('Re: ', role) when 1 then concat('RE:Re: ', role) when 2 then concat('fwd:', role, ' ') when 3 then concat('Reply: ', role) when 4 then concat(role, ' Re: x') else 'Fwd: ' end"


@query(rf"select conv_id, turn, trim(regexp_replace({_SUBJECT}, '^(Re:|Fwd:)\s*', '', 'i')) as subject from conversations")
def subject_cleaning(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean_subject(F.expr(_SUBJECT)).alias("subject"))


@query("""with m as (select conv_id, turn, role, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') as plain from conversations)
select lower('r' || conv_id || '@mail.example') as from_email, 'The ' || role as from_name, 'Thread ' || conv_id || '/' || turn as subject, 1700000000 + conv_id * 3600 + turn * 60 as date,
  list_sort(case when turn % 2 = 0 then ['t' || turn || '@x.example', 's1@corp1.example', 'c' || conv_id || '@x.example'] else ['t' || turn || '@x.example', 's1@corp1.example'] end) as recipients,
  sha256(case when starts_with(plain, 'From ') then '>' || plain else plain end || chr(10)) as body from m""")
def mbox_scan(spark, sf_dir):
    """Conversations written as an mbox archive, read and parsed again."""
    mail = parse_messages(read_mbox(spark, mail_archive(spark, sf_dir)))
    people = F.array_sort(F.transform("to", lambda r: r["email"]))
    return mail.select("from_email", "from_name", "subject", "date", people.alias("recipients"), F.sha2("content", 256).alias("body"))


@query("""select 'c' || c_custkey as uid, 'Visit, ' || c_name as summary, case when c_custkey % 2 = 0 then 'alarm' else 'none' end as description, 1690000000 + c_custkey * 600 as dtstart,
  'c' || c_custkey || '@corp.example' as organizer_email, c_name as organizer_name, 'n' || c_nationkey || '@x.example' as attendee, 'A: b' as attendee_name, 'ACCEPTED' as partstat from customer""")
def ics_scan(spark, sf_dir):
    """Customers written as calendar files, read and parsed again."""
    events = parse_events(read_ics(spark, calendar_files(spark, sf_dir)))
    rows = events.select("uid", "summary", "description", "dtstart", "organizer_email", "organizer_name", F.explode("attendees").alias("a"))
    return rows.select("uid", "summary", "description", "dtstart", "organizer_email", "organizer_name", F.col("a.email").alias("attendee"), F.col("a.name").alias("attendee_name"), "a.partstat")


# ---- calendar ----------------------------------------------------------------------------------------------

_CAL = f"""with ev as ({duck("event")}), at0 as ({duck("attendee")}),
atd as (select *, row_number() over (partition by event_id order by pos, email, name, partstat) as ord from at0),
e as (select ev.*, coalesce(n, 0) as n, mine from ev left join (select event_id, count(*) as n, arg_min(partstat, ord) filter (where email = '{ME}') as mine from atd group by event_id) using (event_id)),
r as (select e.*, atd.email, atd.name, atd.ord, atd.email = organizer_email as organized,
  upper(trim(case when atd.email = organizer_email then mine else partstat end)) as answer from e join atd using (event_id) where atd.email <> '{ME}'),
s as (select email, coalesce(arg_min(name, event_id * 100 + ord) filter (where name <> ''), '') as name, count(*) filter (where organized) as organized_events_count,
  count(*) filter (where not organized) as invited_events_count, count(*) as total_events_count, list(event_id order by event_id) as event_ids,
  sum(dtend - dtstart) / count(dtend - dtstart) as avg_duration_seconds, sum(n) / count(n) as avg_attendee_count,
  count(*) filter (where answer = 'ACCEPTED') as accepted_count, count(*) filter (where answer = 'DECLINED') as declined_count from r group by email),
a as (select *, case when accepted_count + declined_count > 0 then accepted_count / (accepted_count + declined_count) end as acceptance_rate from s),
g as (select *, avg_duration_seconds / avg_attendee_count * total_events_count as score, case when name = '' then split_part(email, '@', 1) else name end as shown from a
  where avg_duration_seconds is not null and avg_attendee_count > 0),
ser as (select uid, min(event_id) as first_id, arg_min(trim(summary), event_id) filter (where trim(summary) <> '') as title, min(dtstart) as dtstart from e group by uid),
mem as (select distinct uid, email as member from r),
sized as (select uid, list(member order by member) as members, count(*) as size from mem group by uid having count(*) >= 2)"""


def _attendees(spark, sf_dir):
    return cal.attendee_stats(calendar(spark, sf_dir), ME)


@query(f"{_CAL} select * from a")
def attendee_stats(spark, sf_dir):
    return _attendees(spark, sf_dir)


@query(f"{_CAL} select email, page, event_ids[page * 20 + 1 : page * 20 + 20] as event_ids from (select email, event_ids, unnest(range(0, (len(event_ids) + 19) // 20)) as page from a)")
def attendee_event_pages(spark, sf_dir):
    return cal.event_pages(calendar(spark, sf_dir), ME, size=20)


@query(f"{_CAL} select a.email, case when su.s_suppkey is null then a.name else s_name end as name, case when su.s_suppkey is null then null else a.email end as contact_email from a left join supplier su on a.email = concat('s', cast(s_suppkey as varchar), '@corp2.example')")
def attendee_link(spark, sf_dir):
    contacts = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@corp2.example")).alias("email"), F.col("s_name").alias("name"))
    return cal.link_contacts(_attendees(spark, sf_dir), contacts).select("email", "name", "contact_email")


@query(f"{_CAL} select email, shown as name, score from g")
def calendar_graph(spark, sf_dir):
    return cal.calendar_graph(_attendees(spark, sf_dir)).select("email", "name", "score")


@query(f"{_CAL} select email, organized_events_count as received, greatest(0, total_events_count - organized_events_count) as sent from g")
def calendar_as_graph(spark, sf_dir):
    return cal.as_graph(cal.calendar_graph(_attendees(spark, sf_dir))).select("email", "received", "sent")


@query(f"{_CAL} select count(*) as total_meetings, coalesce(sum(dtend - dtstart) / count(dtend - dtstart), 0.0) as avg_seconds, (select count(*) from a) as unique_attendees from e")
def calendar_totals(spark, sf_dir):
    return cal.calendar_totals(calendar(spark, sf_dir), _attendees(spark, sf_dir))


@query(f"{_CAL} select email, score from g order by score desc, email limit 1")
def top_by_score(spark, sf_dir):
    return cal.calendar_graph(_attendees(spark, sf_dir)).select("email", "score").limit(1)


@query(f"{_CAL} select email, total_events_count from a order by total_events_count desc, email limit 1")
def top_by_meetings(spark, sf_dir):
    return _attendees(spark, sf_dir).select("email", "total_events_count").orderBy(F.desc("total_events_count"), "email").limit(1)


@query(f"{_CAL} select split_part(email, '@', 2) as domain, cast(sum(total_events_count) as bigint) as meetings from a where split_part(email, '@', 2) not in ({_PERSONAL}) group by 1 order by 2 desc, 1 limit 1")
def top_org(spark, sf_dir):
    return cal.top_organisation(_attendees(spark, sf_dir))


@query(f"{_CAL} select uid, coalesce(title, '(untitled event)') as base, size, members from sized join ser using (uid)")
def event_groups(spark, sf_dir):
    series, members = groups.event_series(calendar(spark, sf_dir), ME)
    grouped = members.groupBy("uid").agg(F.sort_array(F.collect_set("member")).alias("members"))
    return grouped.join(series, "uid").select("uid", "base", F.size("members").cast("bigint").alias("size"), "members")


@query(f"""{_CAL}, b as (select uid, first_id, coalesce(title, '(untitled event)') as base, strftime(make_timestamp(dtstart * 1000000), '%Y-%m-%d') as d from sized join ser using (uid)),
n as (select *, row_number() over (partition by base order by first_id) as nth from b),
m as (select *, sum(case when nth > 1 then 1 else 0 end) over (partition by base, d order by first_id) as nd from n),
l as (select *, case when nth = 1 then base when nd = 1 then base || ' — ' || d end as lab from m)
select uid, coalesce(lab, base || ' (' || (row_number() over (partition by base order by lab is null desc, first_id) + 1) || ')') as label from l""")
def event_group_labels(spark, sf_dir):
    return groups.event_members(calendar(spark, sf_dir), ME).select("uid", "label").distinct()


@query(f"""{_CAL}, nodes as (select email, floor(score) as score, organized_events_count as received, greatest(0, total_events_count - organized_events_count) as sent from g),
j as (select uid as label, member, nodes.* from mem join nodes on mem.member = nodes.email)
select label, count(*) as members, sum(score) as score, cast(sum(received) as bigint) as received, cast(sum(sent) as bigint) as sent, count(distinct split_part(member, '@', 2)) as domains
from j group by label having count(*) >= 3 order by 3 desc, label limit 20""")
def group_scores(spark, sf_dir):
    nodes = cal.as_graph(cal.calendar_graph(_attendees(spark, sf_dir))).withColumn("score", F.floor("score").cast("double"))
    members = groups.event_members(calendar(spark, sf_dir), ME, labels=False).select(F.col("uid").alias("label"), "member")
    return groups.group_scores(members, nodes, 20)


@query(f"{_CAL} select count(*) as groups from (select uid from mem group by uid having count(*) >= 3)")
def qualifying_groups(spark, sf_dir):
    members = groups.event_members(calendar(spark, sf_dir), ME, labels=False).select(F.col("uid").alias("label"), "member")
    return groups.gather(members, rules.MIN_GROUP).agg(F.count(F.lit(1)).alias("groups"))


@query(f"""{_CAL}, sz as (select uid, count(*) as size from mem group by uid having count(*) >= 3), own as (select uid, size from sz join mem using (uid) where member = 's2@corp2.example')
select member, count(*) as shared, (list(uid order by size desc, uid))[1] as largest from mem join own using (uid) where member <> 's2@corp2.example' group by member""")
def co_membership(spark, sf_dir):
    members = groups.event_members(calendar(spark, sf_dir), ME, labels=False).select(F.col("uid").alias("label"), "member")
    return groups.co_members(members, "s2@corp2.example")


@query(f"""{_CAL}, small as (select uid, members, size from sized where size <= 8), i as (select uid, members, size, unnest(range(0, case when size = 2 then 1 else size end)) as i from small)
select uid as label, members[i + 1] as a, members[(i + 1) % size + 1] as b from i""")
def rope_edges(spark, sf_dir):
    members = groups.event_members(calendar(spark, sf_dir), ME, labels=False).select(F.col("uid").alias("label"), "member")
    return groups.ring_edges(members)


_OVERALL = f"""{_CTE}, {_CAL.removeprefix("with ")},
mp as (select email, name, received, sent, row_number() over (order by score desc, email) as rk from online),
cal1 as (select replace(email, 's', 'u') as email, shown as name, score from g),
cp as (select email, name, row_number() over (order by score desc, email) as rk from cal1),
u as (select coalesce(mp.email, cp.email) as email, coalesce(mp.name, cp.name) as name, coalesce(received, 0) as received, coalesce(sent, 0) as sent, mp.rk as mail_rank, cp.rk as calendar_rank,
  case when mp.rk <= 150 then 302 - 2 * mp.rk else 0 end * 1.0::double as mail_points, coalesce(case when cp.rk <= 150 then 302 - 2 * cp.rk else 0 end, 0) * 0.5::double as calendar_points
  from mp full join cp on mp.email = cp.email)
"""


@query(f"{_OVERALL} select *, mail_points + calendar_points as total_points from u where mail_points + calendar_points > 0 order by mail_points + calendar_points desc, email limit 150")
def overall_borda(spark, sf_dir):
    calendar_side = cal.calendar_graph(_attendees(spark, sf_dir)).select(F.replace("email", F.lit("s"), F.lit("u")).alias("email"), "name", "score")
    return ranking.overall(_online(spark, sf_dir).select("email", "name", "received", "sent", "score"), calendar_side)


@query(f"{_CTE}, top as (select email from online order by score desc, email limit 20) select email as source, 'me' as target, 'received' as type, received as weight from filtered where received > 0 and email in (select email from top) union all select 'me', email, 'sent', sent from filtered where sent > 0 and email in (select email from top)")
def overall_links(spark, sf_dir):
    scored = _online(spark, sf_dir)
    return graph.visible_links(graph.links(scored), graph.limited(scored, 20))


# ---- recurrence --------------------------------------------------------------------------------------------

_RULE = "select o_orderkey as k, cast(floor(epoch(o_orderdate)) as bigint) as s, 1 + o_orderkey % 3 as step, 1 + o_orderkey % 12 as cnt from orders"
_CUT = "s + 86400 * 400"


def _ruled(spark, sf_dir, freq: str, extra: str = ""):
    orders = _read(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "unix_timestamp(o_orderdate) as s", f"concat('FREQ={freq};INTERVAL=', 1 + o_orderkey % 3, ';COUNT=', 1 + o_orderkey % 12, '{extra}') as rule")
    # The rule is a column of its own, so that it is parsed once a row.
    orders = cal.spread(orders).select("k", "s", rrule.parse_rule(F.col("rule")).alias("rule"))
    found = rrule.occurrences(F.col("rule"), F.col("s"), F.col("s") + 86400 * 400)
    return orders.select("k", F.posexplode(found).alias("pos", "ts")).select("k", (F.col("pos") + 1).cast("bigint").alias("idx"), "ts")


@query(f"with r as ({_RULE}), o as (select k, unnest(generate_series(s, least({_CUT}, s + 86400 * step * (cnt - 1)), 86400 * step)) as ts from r) select k, row_number() over (partition by k order by ts) as idx, ts from o")
def rrule_daily(spark, sf_dir):
    return _ruled(spark, sf_dir, "DAILY")


@query(f"""with r as ({_RULE}), d as (select k, s, step, cnt, unnest(generate_series(s, {_CUT}, 86400)) as ts from r),
o as (select k, cnt, ts, row_number() over (partition by k order by ts) as idx from d where (ts // 604800 - s // 604800) % step = 0 and ((ts // 86400) + 3) % 7 in (0, 2)) select k, idx, ts from o where idx <= cnt""")
def rrule_weekly(spark, sf_dir):
    return _ruled(spark, sf_dir, "WEEKLY", ";BYDAY=MO,WE")


@query(f"""with recursive r as ({_RULE}), m as (select k, s, step, cnt, 1 as idx, s as ts from r union all
select k, s, step, cnt, idx + 1, cast(epoch(make_timestamp(ts * 1000000) + to_months(cast(step as integer))) as bigint) from m where idx < cnt and cast(epoch(make_timestamp(ts * 1000000) + to_months(cast(step as integer))) as bigint) <= {_CUT})
select k, cast(idx as bigint) as idx, ts from m""")
def rrule_monthly(spark, sf_dir):
    return _ruled(spark, sf_dir, "MONTHLY")


@query(f"""with ev as ({duck("event")}), w as (select event_id, dtstart, dtend, event_id % 4 = 0 as rec from ev), lim as (select {NOW} - 730 * 86400 as lo, {NOW} as hi),
occ as (select event_id, dtend - dtstart as span, unnest(generate_series(dtstart, least({NOW}, dtstart + 86400 * 30 * 9), 86400 * 30)) as ts from w where rec),
num as (select *, row_number() over (partition by event_id order by ts) as idx from occ)
select event_id, 0 as occurrence_idx, dtstart, dtend from w, lim where rec or dtstart between lo and hi
union all select event_id, idx, ts, ts + coalesce(span, 0) from num, lim where ts >= lo""")
def event_occurrences(spark, sf_dir):
    events = calendar_events(spark, sf_dir)
    return cal.expand_events(events, NOW).select("event_id", "occurrence_idx", "dtstart", "dtend")


def calendar_events(spark, sf_dir):
    events = calendar(spark, sf_dir)
    return events.select("event_id", "dtstart", "dtend", F.when(F.col("event_id") % 4 == 0, F.lit("FREQ=DAILY;INTERVAL=30;COUNT=10")).otherwise(F.lit("")).alias("rrule"))


# ---- texts -------------------------------------------------------------------------------------------------

_MEETING = "|".join(w.replace(".", r"\.") for w in rules.SCHEDULING_HOSTS + rules.MEETING_PHRASES)


@query(f"select doc_id, length(text) as chars, regexp_matches(lower(text), '{_MEETING}') as is_meeting from documents")
def meeting_flag(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars"), text.is_meeting(F.lit(""), F.col("text")).alias("is_meeting"))


_PARSED = r"""trim(lower(regexp_extract(line, '(\S*@\S*)', 1)), '<>"'',;()')"""


@query(f"""with l as (select c_custkey, case c_custkey % 3 when 0 then '"' || c_name || '" <' || 'C' || c_custkey || '@Mail.Example>' when 1 then 'c' || c_custkey || '@mail.example' else c_name || ' (no address)' end as line from customer),
e as (select c_custkey, line, {_PARSED} as email from l)
select c_custkey, email, case when c_custkey % 3 = 0 then trim(trim(split_part(line, '<', 1)), '" ''') else split_part(email, '@', 1) end as name from e where contains(email, '@')""")
def address_parse(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('"'), "c_name", F.lit('" <C'), key, F.lit("@Mail.Example>"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("c"), key, F.lit("@mail.example"))).otherwise(F.concat("c_name", F.lit(" (no address)")))
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.explode(text.recipients(line)).alias("r"))
    return rows.select("c_custkey", "r.email", "r.name")


@query("select o_orderkey, cast(floor(epoch(o_orderdate)) as bigint) as full_ts, cast(floor(epoch(date_trunc('day', o_orderdate))) as bigint) as day_ts, cast(null as bigint) as bad from orders")
def ics_dates(spark, sf_dir):
    stamp = F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'")
    return _read(spark, sf_dir, "orders").select("o_orderkey", dates.ics_date(stamp).alias("full_ts"), dates.ics_date(F.substring(stamp, 1, 8)).alias("day_ts"), dates.ics_date(F.lit("2024-01-01")).alias("bad"))


@query("""select s_suppkey, case s_suppkey % 4 when 2 then 'X-A' else 'ATTENDEE' end as name, case s_suppkey % 4 when 0 then s_name when 1 then 'second' when 3 then s_name || ';' end as cn,
  's' || s_suppkey || '@x.example' as email, case s_suppkey % 4 when 1 then 'CHAIR' else '' end as role from supplier""")
def ics_property(spark, sf_dir):
    key, kind = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 4
    line = (
        F.when(kind == 0, F.concat(F.lit('ATTENDEE;CN="'), "s_name", F.lit('";X="a:b":MAILTO:S'), key, F.lit("@X.example")))
        .when(kind == 1, F.concat(F.lit("ATTENDEE;CN=first;ROLE=CHAIR;CN=second:mailto: s"), key, F.lit("@x.EXAMPLE ")))
        .when(kind == 2, F.concat(F.lit("X-A:S"), key, F.lit("@x.example")))
        .otherwise(F.concat(F.lit("ATTENDEE;X=y;CN="), "s_name", F.lit('%;ROLE=:s'), key, F.lit("@x.example")))
    )
    name = F.regexp_replace(ics.parameter(line, "CN"), "%", ";")
    return _read(spark, sf_dir, "supplier").select("s_suppkey", ics.property_name(line).alias("name"), name.alias("cn"), F.trim(ics.attendee(line)["email"]).alias("email"), ics.attendee(line)["role"].alias("role"))


@query(r"""select p_partkey, case p_partkey % 4 when 0 then p_name || chr(10) || 'a,b;c\d\n' when 1 then p_name || '\' || chr(10) || '\\' when 2 then ',' || p_name || '\x\' else chr(10) || chr(10) || p_name end as plain from part""")
def text_unescape(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    raw = (
        F.when(kind == 0, F.concat("p_name", F.lit("\\na\\,b\\;c\\d\\\\n")))
        .when(kind == 1, F.concat("p_name", F.lit("\\\\\\n\\\\\\\\")))
        .when(kind == 2, F.concat(F.lit("\\,"), "p_name", F.lit("\\x\\")))
        .otherwise(F.concat(F.lit("\\N\\n"), "p_name"))
    )
    return _read(spark, sf_dir, "part").select("p_partkey", ics.unescape(raw).alias("plain"))


@query("select o_orderkey, cast(floor(epoch(o_orderdate)) as bigint) - 7200 as ts from orders")
def mail_dates(spark, sf_dir):
    shown = F.concat(F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss"), F.lit(" +0200 (CEST)"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", dates.mail_date(shown).alias("ts"))


@query("""with m as (select *, cast(floor(o_orderkey * 7 / 60 + 0.5) as bigint) as minutes from orders)
select o_orderkey, case when length(o_orderpriority) > 12 then substring(o_orderpriority, 1, 10) || '...' else o_orderpriority end as label,
  case when minutes >= 60 then (minutes // 60) || 'h ' || (minutes % 60) || 'm' else minutes || 'm' end as duration from m""")
def labels(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.label(F.col("o_orderpriority"), 12, 10, "...").alias("label"), text.format_duration(F.col("o_orderkey") * 7).alias("duration"))


@query("""select s_suppkey, case s_suppkey % 4 when 2 then s_name || s_name || ' x' when 3 then 'Ж' || s_name || '=?utf-8?X?a?=' else s_name end as name, 'A' || s_name || '!' as body from supplier""")
def mime_decode(spark, sf_dir):
    """Encoded words of several kinds and quoted-printable bodies made of supplier names, decoded again."""
    from ..functions.mime import decode_header, decode_quoted_printable

    kind, name = F.col("s_suppkey") % 4, F.col("s_name")
    b = lambda charset, raw: F.concat(F.lit(f"=?{charset}?B?"), F.base64(raw), F.lit("?="))
    word = (
        F.when(kind == 0, b("utf-8", name.cast("binary")))
        .when(kind == 1, F.concat(F.lit("=?ISO-8859-1?q?"), F.replace(F.replace(name, F.lit(" "), F.lit("_")), F.lit("#"), F.lit("=23")), F.lit("?=")))
        .when(kind == 2, F.concat(b("utf-8", name.cast("binary")), F.lit(" \t"), b("Latin1", name.cast("binary")), F.lit(" x")))
        .otherwise(F.concat(b("windows-1251", F.concat(F.unhex(F.lit("C6")), name.cast("binary"))), F.lit("=?utf-8?X?a?=")))
    )
    return _read(spark, sf_dir, "supplier").select("s_suppkey", decode_header(word).alias("name"), F.decode(decode_quoted_printable(F.concat(F.lit("=41"), name, F.lit("=\n!")).cast("binary")), "UTF-8").alias("body"))


@query("select doc_id, coalesce(text, '') || chr(10) as content from documents")
def multipart_text(spark, sf_dir):
    """Texts of documents wrapped as the plain part of multipart bodies, some of them nested, unwrapped again."""
    from ..functions.mime import body_text

    docs = _read(spark, sf_dir, "documents")
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    html = F.lit("--b\nContent-Type: text/html\n\n<p>x</p>\n")
    nested = F.concat(F.lit('--b\nContent-Type: multipart/mixed; boundary="in"\n\n--in\n'), plain, F.lit("--in--\n"))
    body = F.concat(html, F.when(F.col("doc_id") % 3 == 0, nested).otherwise(F.concat(F.lit("--b\n"), plain)), F.lit("--b--\n")).cast("binary")
    return docs.select("doc_id", body_text(body, F.lit('multipart/alternative; boundary="b"'), F.lit("7bit")).alias("content"))


def queries() -> dict:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
