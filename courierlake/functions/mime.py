"""MIME words, transfer encodings, character sets and multipart bodies, as Arrow-batched functions."""

from __future__ import annotations

import base64
import binascii
import codecs
import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, StringType

from .. import rules

_B64 = re.compile(r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\Z")
_WORD = re.compile(r"=\?([^?]*)\?([^?]*)\?(.*?)\?=", re.S)
_HEX = re.compile(rb"=(?:\r?\n|([0-9A-Fa-f]{2}))")
MAX_DEPTH = 5


def strict_base64(text: str) -> bytes | None:
    return base64.b64decode(text) if _B64.match(text) else None


def charset_text(data: bytes, charset: str) -> str:
    """Text of bytes; unknown sets count as UTF-8, malformed bytes become U+FFFD, a byte order mark decides."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(codec, "replace")
    codec = rules.CHARSETS.get(charset.lower(), "utf-8")
    # The five bytes of windows-1252 without a character stand for control characters.
    return data.decode(codec, "as_control" if codec == "cp1252" else "replace")


codecs.register_error("as_control", lambda e: ("".join(map(chr, e.object[e.start : e.end])), e.end))


def header_quoted(text: str) -> bytes:
    """Q encoding: _ is a blank, pairs after = that are not hexadecimal are dropped."""
    out, i = bytearray(), 0
    while i < len(text):
        if text[i] == "=":
            pair = text[i + 1 : i + 3]
            if re.fullmatch(r"[+]?[0-9A-Fa-f]+", pair) and len(pair) == 2:
                out.append(int(pair, 16))
            i += 3
        else:
            out += b" " if text[i] == "_" else bytes([ord(text[i]) & 255])
            i += 1
    return bytes(out)


def body_quoted(data: bytes) -> bytes:
    return _HEX.sub(lambda m: bytes([int(m[1], 16)]) if m[1] else b"", data)


def header_text(text: str) -> str:
    """Header with its encoded words decoded; blanks between two decoded words go, undecodable words stay."""
    out, at, decoded = [], 0, False
    while (start := text.find("=?", at)) >= 0:
        between = text[at:start]
        word = _WORD.match(text, start)
        blank = decoded and not between.strip(" \t")
        if not word:
            out.append(between)
            # Without the end of its data nothing more is decoded; without its parts only these two characters stay.
            whole = text.count("?", start + 2) >= 2
            out.append(text[start:] if whole else "=?")
            at, decoded = (len(text) if whole else start + 2), False
            continue
        how = word[2].upper()
        data = strict_base64(word[3]) if how == "B" else header_quoted(word[3]) if how == "Q" else None
        if not (blank and data is not None):
            out.append(between)
        out.append(charset_text(data, word[1]) if data is not None else word[0])
        at, decoded = word.end(), data is not None
    return "".join(out) + text[at:]


def content_type(value: str) -> tuple[str, str, str]:
    """MIME type, charset and boundary of a Content-Type header."""
    kind, *rest = value.split(";")
    found = {"charset": "", "boundary": ""}
    for p in rest:
        key, eq, v = p.partition("=")
        if eq and key.strip().lower() in found:
            found[key.strip().lower()] = v.strip().strip('"')
    return kind.strip().lower(), found["charset"].lower(), found["boundary"]


def transfer_decoded(data: bytes, encoding: str) -> bytes:
    if encoding == "base64":
        try:
            return base64.b64decode(b"".join(data.split()), validate=True)
        except binascii.Error:
            return data
    return body_quoted(data) if encoding == "quoted-printable" else data


def split_parts(body: bytes, boundary: str) -> list[bytes]:
    """Parts between delimiter lines; what follows the last delimiter only counts if the closing one is there."""
    mark, parts, now = b"--" + boundary.encode(), [], None
    for line in body.splitlines(keepends=True):
        if line.startswith(mark):
            if now is not None:
                parts.append(b"".join(now))
            now = None if line.startswith(mark + b"--") else []
            if line.startswith(mark + b"--"):
                break
        elif now is not None:
            now.append(line)
    return parts


def part_headers(part: bytes) -> tuple[dict[str, str], bytes]:
    """Lower-cased headers (folded lines joined, repeated ones by a comma) and body; no blank line, no body."""
    head, gap, body = re.match(rb"(?s)(.*?)(\r?\n\r?\n|\Z)(.*)", part if not part.startswith((b"\n", b"\r\n")) else b"\n" + part).groups()
    headers: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
        elif ":" in line:
            key, value = line.split(":", 1)
            last = key.strip().lower()
            headers[last] = f"{headers[last]}, {value.strip()}" if last in headers else value.strip()
    return headers, body if gap else b""


def plain_text(body: bytes, kind: str, encoding: str, charset: str, boundary: str, depth: int = 0) -> str:
    """Text of a body: text/plain, or the first such part of a multipart body; nothing for other types."""
    if depth > MAX_DEPTH:
        return ""
    kind = kind or "text/plain"
    if kind.startswith("multipart/"):
        nested = []
        for part in split_parts(body, boundary) if boundary else []:
            headers, inner = part_headers(part)
            sub, sub_charset, sub_boundary = content_type(headers.get("content-type", ""))
            how = headers.get("content-transfer-encoding", "").strip().lower()
            if sub in ("", "text/plain"):
                if text := plain_text(inner, sub, how, sub_charset, sub_boundary, depth + 1):
                    return text
            elif sub.startswith("multipart/"):
                nested.append((inner, sub, how, sub_charset, sub_boundary))
        return next((t for x in nested if (t := plain_text(*x, depth + 1))), "")
    return charset_text(transfer_decoded(body, encoding), charset) if kind == "text/plain" else ""


@pandas_udf(StringType())
def decode_header(text: pd.Series) -> pd.Series:
    return text.map(lambda t: header_text(t) if isinstance(t, str) else "")


@pandas_udf(ArrayType(StringType()))
def decode_headers(texts: pd.Series) -> pd.Series:
    return texts.map(lambda ts: [header_text(t) for t in ts] if ts is not None else [])


@pandas_udf(StringType())
def body_text(body: pd.Series, kind: pd.Series, encoding: pd.Series) -> pd.Series:
    """Text of message bodies, given the raw Content-Type and Content-Transfer-Encoding headers."""

    def one(b, k, e) -> str:
        mime, charset, boundary = content_type(k or "")
        return plain_text(bytes(b or b""), mime, (e or "").strip().lower(), charset, boundary)

    return pd.Series([one(*x) for x in zip(body, kind, encoding, strict=True)])


@pandas_udf(BinaryType())
def decode_quoted_printable(body: pd.Series) -> pd.Series:
    return body.map(lambda b: body_quoted(bytes(b)) if b is not None else None)


@pandas_udf(StringType())
def decode_bytes(body: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([charset_text(bytes(b), c or "") if b is not None else None for b, c in zip(body, charset, strict=True)])
