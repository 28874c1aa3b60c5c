"""Mail archives (mbox) as tables of messages and of one row per recipient."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..files import written
from ..functions.dates import mail_date
from ..functions.mime import body_text, decode_header, decode_headers
from ..functions.text import is_meeting, recipients, sender_parts


def _messages(content: bytes) -> Iterator[tuple[list[dict], bytes]]:
    """Headers and body of each message in lines, of which the last ends with the content.

    A line starting "From " ends a body, never a header block; lines that are not UTF-8 are dropped.
    """
    headers: list[dict] | None = None
    body: list[bytes] | None = None
    for raw in content.split(b"\n"):
        raw = raw.removesuffix(b"\r")
        try:
            line = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if line.startswith("From ") and (headers is None or body is not None):
            if headers is not None:
                yield headers, b"".join(body)
            headers, body = [], None
        elif headers is not None and body is None:
            if not line:
                body = []
            elif line[0] in " \t":
                if headers:
                    headers[-1]["value"] += " " + line.strip()
            elif ":" in line:
                name, value = line.split(":", 1)
                headers.append({"name": name.strip().lower(), "value": value.strip()})
        elif body is not None:
            body.append(raw + b"\n")
    if headers is not None:
        yield headers, b"".join(body or [])


def _flagged(narrow: DataFrame, splits: DataFrame) -> DataFrame:
    """file, block and the rows of pieces that begin no message, for splits of files that may have such pieces.

    The reader is an automaton: it seeks a first message, is in a header block or in a body. A piece whose first line
    can be read leaves it in a body if the piece has an empty line, else in the header block, wherever it was before;
    any other piece can only end a header block. So a run of pieces is summed up by its last readable piece and the last
    other one with an empty line, and runs compose by taking the later of each: splits are summed up first, then put
    together along the file, and the pieces of each split start from what the splits before it have left.
    """
    at = [F.col("block"), F.col("row")]
    rows = narrow.join(splits.where("odd > 0").select("file").distinct(), "file", "left_semi").join(splits.select("file", "block", "first_row"), ["file", "block"])
    opens = F.col("known") & (F.col("marked") | (F.col("block") > 0) | (F.col("row") > F.col("first_row")))
    rows = rows.withColumn("opens", opens).withColumn("opened", F.when(F.col("opens"), F.struct(*at, "ended"))).withColumn("closed", F.when(~F.col("opens") & F.col("ended"), F.struct(*at)))
    summed = rows.groupBy("file", "block").agg(F.max("opened").alias("opened"), F.max("closed").alias("closed"))
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    left = summed.select("file", "block", F.max("opened").over(along).alias("left_opened"), F.max("closed").over(along).alias("left_closed"))
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    told = rows.withColumn("opened", F.max("opened").over(inside)).withColumn("closed", F.max("closed").over(inside)).join(left, ["file", "block"])
    opened, closed = F.coalesce("opened", "left_opened"), F.greatest("closed", "left_closed")
    told = told.select("file", "block", "row", "opens", opened.alias("opened"), closed.alias("closed"))
    in_headers = F.col("opened").isNotNull() & ~F.col("opened.ended") & (F.col("closed").isNull() | (F.col("closed") < F.struct("opened.block", "opened.row")))
    return told.where(~F.col("opens") | in_headers).groupBy("file", "block").agg(F.array_sort(F.collect_list("row")).alias("apart"))


def read_mbox(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per message: source_file, msg_pos (0, 1, 2 along the file), headers (folded lines joined), body.

    Spark splits the files, however long, into pieces at lines that start "From ". Nearly all pieces are a message.
    The others - such a line inside a header block, or one that is not UTF-8 and counts as absent - belong to the
    message before them: they are found from a narrow table of flags, split by split (see _flagged), and only their
    messages are put together by a shuffle. A table with one row for each split says where its numbers begin and which
    of its pieces belong to messages of several; so numbers do not depend on how Spark splits the files.
    """
    text = spark.read.option("lineSep", "\nFrom ").text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    narrow = pieces.select(
        "file",
        "block",
        "row",
        F.rlike("value", F.lit(r"(?s)\n\r?(?:\n|\z)")).alias("ended"),
        F.is_valid_utf8(F.substring_index("value", "\n", 1)).alias("known"),
        F.startswith("value", F.lit("From ")).alias("marked"),
    )
    splits = narrow.groupBy("file", "block").agg(
        F.min("row").alias("first_row"),
        F.max("row").alias("last_row"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("ended") | ~F.col("known")).alias("odd"),
        F.min_by("marked", "row").alias("marked"),
    )
    splits = written(splits)
    # What precedes the first message is none.
    noise = F.when((F.col("block") == 0) & ~F.col("marked"), F.array("first_row")).otherwise(F.array().cast("array<bigint>"))
    splits = splits.join(_flagged(narrow, splits), ["file", "block"], "left").withColumn("apart", F.coalesce("apart", noise))
    along = Window.partitionBy("file").orderBy("block")
    starts = F.col("n") - F.size("apart")
    upto = F.sum(starts).over(along)
    splits = splits.select(
        F.col("file").alias("of"),
        F.col("block").alias("split"),
        "first_row",
        F.when(F.lead("block").over(along).isNull(), F.col("last_row")).alias("end_row"),
        (upto - starts).alias("before"),
        "apart",
        # The last message goes on in the next split.
        F.when(F.lead(F.get("apart", F.lit(0)) == F.col("first_row")).over(along), upto - 1).alias("goes_on"),
    )
    nth = lambda row, apart: F.col("before") + row - F.col("first_row") - apart
    several = F.transform("apart", lambda row, k: nth(row, k + 1))
    placed = pieces.join(splits, (F.col("file") == F.col("of")) & (F.col("block") == F.col("split")))
    placed = placed.withColumn("at", nth(F.col("row"), F.size(F.filter("apart", lambda r: r <= F.col("row")))))
    placed = placed.withColumn("part", F.coalesce(F.array_contains(several, F.col("at")), F.lit(False)) | F.coalesce(F.col("at") == F.col("goes_on"), F.lit(False)))
    first = (F.col("block") == 0) & (F.col("row") == F.col("first_row"))
    content = F.when(first, F.col("value")).otherwise(F.concat(F.lit("From "), "value"))
    ends = F.coalesce(F.col("row") == F.col("end_row"), F.lit(False))
    placed = placed.where("at >= 0").select("file", "at", "block", "row", content.alias("content"), ends.alias("ends"), "part")
    joined = placed.where("part").groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("block", "row", "content"))).alias("parts"), F.max("ends").alias("ends"))
    joined = joined.select("file", "at", F.array_join(F.transform("parts", lambda x: x["content"]), "\n").alias("content"), "ends")
    whole = placed.where("not part").select("file", "at", "content", "ends").unionByName(joined)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, at, content, ends in zip(batch["file"], batch["at"], batch["content"], batch["ends"], strict=True):
                # Only the last line break of a file ends a line; the others are gone with the separator.
                raw = bytes(content).removesuffix(b"\n") if ends else bytes(content)
                rows += [(file, at, *m) for m in _messages(raw)]
            yield pd.DataFrame(rows, columns=["source_file", "msg_pos", "headers", "body"])

    return whole.select("file", "at", F.col("content").cast("binary").alias("content"), "ends").mapInPandas(parse, schemas.MESSAGES)


def parse_messages(messages: DataFrame) -> DataFrame:
    """source_file, msg_pos, from_email, from_name, to (array of struct(email, name)), subject, date, content, chars, is_meeting."""

    def last(name: str):
        return F.try_element_at(F.filter("headers", lambda h: h["name"] == name), F.lit(-1))["value"]

    def values(*names: str):
        return F.transform(F.filter("headers", lambda h: h["name"].isin(*names)), lambda h: h["value"])

    # A From that names nobody leaves what an earlier one said.
    senders = F.filter(F.transform(decode_headers(values("from")), sender_parts), lambda x: x.isNotNull())
    decoded = messages.select(
        "source_file",
        "msg_pos",
        F.try_element_at(senders, F.lit(-1)).alias("sender"),
        values("to", "cc").alias("to_raw"),
        F.trim(decode_header(F.coalesce(last("subject"), F.lit("")))).alias("subject"),
        mail_date(last("date")).alias("date"),
        body_text(F.col("body"), last("content-type"), last("content-transfer-encoding")).alias("content"),
    )
    to = recipients(decode_header(F.array_join("to_raw", ", ")))
    return decoded.select(
        "source_file",
        "msg_pos",
        F.coalesce("sender.email", F.lit("")).alias("from_email"),
        F.coalesce("sender.name", F.lit("")).alias("from_name"),
        to.alias("to"),
        "subject",
        "date",
        "content",
        F.length("content").cast("bigint").alias("chars"),
        is_meeting(F.col("subject"), F.col("content")).alias("is_meeting"),
    )


def mails(parsed: DataFrame) -> DataFrame:
    """One row per message and recipient other than the sender; source_file and msg_pos name the message."""
    rows = parsed.select("source_file", "msg_pos", "from_email", "from_name", "subject", "content", "date", F.posexplode("to").alias("rcpt_idx", "r"))
    return rows.where("r.email <> from_email").select(
        "msg_pos", "rcpt_idx", F.col("from_email").alias("from"), "from_name", F.col("r.email").alias("to"), F.col("r.name").alias("to_name"), "subject", "content", "date", "source_file"
    )


def exchanges(parsed: DataFrame, me: str) -> DataFrame:
    """One row per message and correspondent: contact, name, dir (sent or received), date, chars, is_meeting, source_file, msg_pos, rcpt_idx."""
    people = lambda email, name, i: F.struct(email.alias("contact"), name.alias("name"), i.cast("int").alias("rcpt_idx"))
    sent = F.filter(F.transform("to", lambda r, i: people(r["email"], r["name"], i)), lambda p: p["contact"] != me)
    got = F.array(people(F.col("from_email"), F.col("from_name"), F.lit(0)))
    own = F.col("from_email") == me
    rows = parsed.where("from_email <> ''").select("*", own.alias("own"), F.explode(F.when(own, sent).otherwise(got)).alias("p"))
    return rows.select("p.contact", "p.name", F.when(F.col("own"), F.lit("sent")).otherwise(F.lit("received")).alias("dir"), "date", "chars", "is_meeting", "source_file", "msg_pos", "p.rcpt_idx")
