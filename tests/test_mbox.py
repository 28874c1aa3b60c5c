"""Mail archives, split anywhere, against a reader that goes line by line."""

import random

import pytest

from courierlake.sources.mail import read_mbox


def sequential(raw):
    """Headers' names and bodies of the messages, in one pass over the lines."""
    lines = raw.split(b"\n")
    if not lines[-1]:
        lines.pop()
    state, out = "seek", []
    for line in lines:
        line = line.removesuffix(b"\r")
        try:
            text = line.decode()
        except UnicodeDecodeError:
            continue
        if state != "headers" and text.startswith("From "):
            state = "headers"
            out.append(([], bytearray()))
        elif state == "headers":
            if not text:
                state = "body"
            elif text[0] in " \t":
                if out[-1][0]:
                    out[-1][0][-1][1] += " " + text.strip()
            elif ":" in text:
                name, value = text.split(":", 1)
                out[-1][0].append([name.strip().lower(), value.strip()])
        elif state == "body":
            out[-1][1].extend(line + b"\n")
    return [([tuple(h) for h in heads], bytes(body)) for heads, body in out]


def archive(r, messages):
    ends = r.choice([b"\n", b"\n", b"\r\n"])
    out = [r.choice([b"", b"noise: x", b"\xff noise", b"From\tnobody"])] if r.random() < 0.4 else []
    for k in range(messages):
        out.append(r.choice([b"From a@x y"] * 6 + [b"From \xff\xfe x", b"From : y", b"From "]))
        out += [r.choice([b"Subject: s%d" % k, b"To: a,\n b", b"From b: c", b"X-Y: \xff", b"bare", b" folded"]) for _ in range(r.randint(0, 4))]
        if r.random() < 0.85:
            out.append(b"")
            out += [r.choice([b"text %d" % k, b"", b">From z", b"\xff\xff", b"From", b" From me", b"last \r"]) for _ in range(r.randint(0, 5))]
    return ends.join(out) + r.choice([b"", ends, ends + ends])


@pytest.mark.parametrize("split", [60, 10_000])
def test_archives(spark, tmp_path, split):
    r = random.Random(split)
    made = {f"{k:02d}.mbox": archive(r, r.choice([1, 3, 40])) for k in range(14)}
    made |= {"empty.mbox": b"", "none.mbox": b"no message\n", "one.mbox": b"From a\n\nyo\r\n", "open.mbox": b"From a\n\nhi", "head.mbox": b"From a\nTo: b"}
    for name, raw in made.items():
        (tmp_path / name).write_bytes(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = read_mbox(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {}
    for m in got:
        found.setdefault(m["source_file"].rsplit("/", 1)[1], {})[m["msg_pos"]] = ([tuple(h) for h in m["headers"]], bytes(m["body"]))
    for name, raw in made.items():
        assert found.get(name, {}) == dict(enumerate(sequential(raw))), (name, raw)
    assert len(got) == sum(map(len, found.values()))
