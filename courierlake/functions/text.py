"""Column functions on addresses, names, subjects and texts: built-in expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def any_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def local_part(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def domain(email: Column) -> Column:
    return F.lower(F.split_part(email, F.lit("@"), F.lit(2)))


def round2(x: Column) -> Column:
    """Two decimals, halves of the scaled binary value up."""
    return F.floor(x * 100 + 0.5) / 100


def per_month(total: Column, days: Column) -> Column:
    """total by month of 30.44 days; spans below a month count as one."""
    months = days / F.lit(rules.DAYS_PER_MONTH)
    return F.when((days <= 0) | (months < 1), total.cast("double")).otherwise(total / months)


def sender_parts(text: Column) -> Column:
    """struct(email, name) of "Name <address>"; null without an address.

    The address is the first blank-separated word with an @, stripped of brackets, quotes and the like; the
    name what precedes the first <, or the local part.
    """
    trimmed = F.trim(text)
    email = F.lower(F.btrim(F.regexp_extract(trimmed, r"(?U)(\S*@\S*)", 1), F.lit("<>\"',;()")))
    shown = F.btrim(F.trim(F.split_part(trimmed, F.lit("<"), F.lit(1))), F.lit("\"' "))
    name = F.when(~F.contains(trimmed, F.lit("<")) | (shown == "") | (F.lower(shown) == email), local_part(email)).otherwise(shown)
    return F.when(F.contains(email, F.lit("@")), F.struct(email.alias("email"), name.alias("name")))


def recipients(text: Column) -> Column:
    """array of sender_parts() of the comma-separated pieces; commas inside quotes split as well."""
    pieces = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(F.transform(pieces, sender_parts), lambda x: x.isNotNull())


def clean_subject(subject: Column) -> Column:
    """Without one leading Re: or Fwd:."""
    return F.trim(F.regexp_replace(subject, r"(?iU)^(Re:|Fwd:)\s*", ""))


def is_meeting(subject: Column, content: Column) -> Column:
    """Whether a scheduling host or a phrase of calendar mail occurs in subject or content."""
    pattern = any_of(rules.SCHEDULING_HOSTS + rules.MEETING_PHRASES)
    return F.lower(F.coalesce(subject, F.lit(""))).rlike(pattern) | F.lower(F.coalesce(content, F.lit(""))).rlike(pattern)


def matches_patterns(local: Column, patterns: list[str]) -> Column:
    """Patterns with - _ . match anywhere, others as a whole token between . _ - and +."""
    whole = [p for p in patterns if not re.search(r"[-_.]", p)]
    inside = [p for p in patterns if re.search(r"[-_.]", p)]
    tokens = F.arrays_overlap(F.split(local, r"[._+-]"), F.array(*[F.lit(p) for p in whole])) if whole else F.lit(False)
    return tokens | (local.rlike(any_of(inside)) if inside else F.lit(False))


def suspicious_name(name: Column) -> Column:
    """All upper case beyond three bytes, more than half as many marks as letters, or a phrase of automated senders."""
    shown = F.trim(F.coalesce(name, F.lit("")))
    letters = F.length(F.regexp_replace(shown, r"[^\p{IsAlphabetic}]", ""))
    marks = F.length(F.regexp_replace(shown, r"(?U)[\p{IsAlphabetic}\p{N}\s]", ""))
    loud = (F.octet_length(shown) > 3) & (shown == F.upper(shown)) & (letters > 0)
    noisy = (letters > 0) & (marks / F.greatest(letters, F.lit(1)) > 0.5)
    return (shown != "") & (loud | noisy | F.lower(shown).rlike(any_of(rules.NAME_PHRASES)))


def spam_rules(email: Column, name: Column, received: Column, sent: Column) -> dict[str, Column]:
    """The six rules, by name, in the order in which they are tried."""
    local = F.lower(local_part(email))
    return {
        "noreply": matches_patterns(local, rules.NOREPLY),
        "automated": matches_patterns(local, rules.AUTOMATED),
        "marketing": matches_patterns(local, rules.MARKETING),
        "one_way": (received == 0) | (sent == 0),
        "blocked_domain": domain(email).rlike(rf"(^|\.)({any_of(rules.BLOCKED_DOMAINS)})$"),
        "suspicious_name": suspicious_name(name),
    }


def label(text: Column, longest: int, shown: int, mark: str) -> Column:
    """Texts beyond the longest length are cut and marked."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, shown), F.lit(mark))).otherwise(text)


def format_duration(seconds: Column) -> Column:
    """Xh Ym, Ym, or a dash for null."""
    minutes = F.floor(seconds / 60 + 0.5)
    hours = F.floor(minutes / 60)
    return F.when(seconds.isNull(), F.lit("—")).when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m"))).otherwise(F.concat(minutes.cast("string"), F.lit("m")))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 100 / whole + 0.5)).otherwise(F.lit(0)).cast("bigint")


def blend_colors(colors: Column) -> Column:
    """Mean of #rrggbb colours, channel by channel."""

    def channel(at: int) -> Column:
        total = F.aggregate(colors, F.lit(0).cast("double"), lambda s, c: s + F.conv(F.substring(c, at, 2), 16, 10).cast("double"))
        return F.lpad(F.lower(F.hex(F.floor(total / F.size(colors) + 0.5).cast("bigint"))), 2, "0")

    return F.concat(F.lit("#"), channel(2), channel(4), channel(6))
