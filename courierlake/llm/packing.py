"""Bounded-space online packing of tokenised documents into training windows.

Every partition tokenises its documents and keeps a fixed number of open windows. A document's tokens fill
whole windows first; the rest goes to the open window that it fills best. When none has room and no further
window may be opened, the fullest is topped up with the head of the piece and emitted. Windows still open at
the end of a partition - at most OPEN_WINDOWS - are merged in groups of MERGE_PARTITIONS partitions, again
into full windows; what then remains of a group, less than one window, is cut at powers of two, where no
padding is needed. Memory per task: the open windows, the merge group of bounded size, one text with its ids, and a
cache of token ids by word, bounded in bytes and emptied with the task. Added tokens of the vocabulary (<|endoftext|>) in a text have their
own ids. A sequence is due where the earliest of its documents is.

Defined cases: null text counts as empty and yields the separator alone; ids may be null or repeated and are
carried along, null beside numbers of 64 bits too; texts of any length are cut into whole windows; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

OPEN_WINDOWS = 16
MERGE_PARTITIONS = 64
#: Of the cached words and their ids, with what Python needs for each.
CACHE_BYTES, _ENTRY = 96 << 20, 160
_SPACE_RUN = re.compile(r"\s | \s|^\s|\s\Z")


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the added tokens of a JSON vocabulary; for a rank file, of the JSON file of the same name beside it, which has to be there."""
    own = os.path.splitext(path)[0] + ".json"
    with open(own, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    unlike = [t["content"] for t in found if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if unlike:
        raise ValueError(f"added tokens that take more than their own characters: {unlike}")
    return {t["content"]: t["id"] for t in found}


class WordTokenizer:
    """Token ids of texts as little-endian unsigned 32-bit bytes, by a public vocabulary file.

    added: tokens with ids of their own wherever they stand in a text; without them these are ordinary characters.

    A single blank between two other characters always starts a new token of these vocabularies, so the words
    between such blanks are encoded once and kept in a cache. Texts with other runs of blanks are encoded whole.
    """

    def __init__(self, path: str, pattern: str | None = None, added: dict[str, int] | None = None):
        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._encode = tiktoken.Encoding("words", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            starts = {i for token, i in ranks.items() if token[:1] == b" "}
            size = len(ranks)
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            self._encode = lambda text: own.encode(text, add_special_tokens=False).ids
            vocabulary = own.get_vocab(with_added_tokens=False)
            starts = {i for token, i in vocabulary.items() if token[:1] == "Ġ"}
            size = len(vocabulary)
        self._starts = np.zeros(size + 1, bool)
        self._starts[list(starts)] = True
        self._cache: dict[str, bytes] = {}
        self._held = 0
        self._added = {t: np.array([i], "<u4").tobytes() for t, i in (added or {}).items()}
        # Of the tokens that start at one place the longest counts.
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")").split

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self._added):
            # The parts alternate: text, added token, text, ...
            return b"".join(self._added[x] if i % 2 else self._plain(x) for i, x in enumerate(self._split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _SPACE_RUN.search(text):
            return np.array(self._encode(text), "<u4").tobytes()
        first, *words = text.split(" ")
        head = np.array(self._encode(first), "<u4").tobytes()
        try:
            return head + b"".join(map(self._cache.__getitem__, words))
        except KeyError:
            self._learn(list({w for w in words if w not in self._cache}))
            out = head + b"".join(map(self._cache.__getitem__, words))
        if self._held > CACHE_BYTES:
            self.forget()
        return out

    def forget(self) -> None:
        """Empties the cache."""
        self._cache.clear()
        self._held = 0

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self._encode(" " + " ".join(words)), "<u4")
        cuts = np.flatnonzero(self._starts[ids]).tolist() + [len(ids)]
        raw = ids.tobytes()
        self._cache.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(words, cuts[:-1], cuts[1:], strict=True))
        self._held += len(raw) + sum(map(len, words)) + _ENTRY * len(words)


_loaded: dict[tuple, WordTokenizer] = {}


def tokenizer_of(path: str, added: dict[str, int] | None = None) -> WordTokenizer:
    """The tokenizer of a file with given added tokens, or its own, loaded once in each worker process."""
    added = added_tokens(path) if added is None else added
    key = (path, tuple(added.items()))
    if key not in _loaded:
        _loaded[key] = WordTokenizer(path, added=added)
    return _loaded[key]


class OpenWindows:
    """The open windows of one partition; place() returns the pieces of windows that it completed."""

    def __init__(self, size: int, limit: int, first_id: int):
        self.size, self.limit, self._next = size, limit, first_id
        self.open: list[list] = []  # [filled, pieces]

    def _close(self, pieces: list) -> list:
        at, out, due = 0, [], min(p[5] for p in pieces)
        for p in pieces:
            out.append((*p[:5], self._next, at, due))
            at += p[2]
        self._next += 1
        return out

    def place(self, doc, ids: bytes, total: int, start: int = 0, due: int = 0) -> list:
        done, left, at = [], len(ids) // 4, 0
        while left:
            if left >= self.size:
                take, slot = self.size, None
            else:
                fitting = [w for w in self.open if self.size - w[0] >= left]
                if fitting:
                    slot, take = max(fitting, key=lambda w: w[0]), left
                elif len(self.open) < self.limit:
                    slot, take = [0, []], left
                    self.open.append(slot)
                else:
                    slot = max(self.open, key=lambda w: w[0])
                    take = self.size - slot[0]
            piece = (doc, start, take, ids[at : at + 4 * take], total, due)
            at, start, left = at + 4 * take, start + take, left - take
            if slot is None:
                done += self._close([piece])
                continue
            slot[0] += take
            slot[1].append(piece)
            if slot[0] == self.size:
                self.open.remove(slot)
                done += self._close(slot[1])
        return done

    def leftovers(self) -> list:
        return [x for w in self.open for x in self._close(w[1])]


def _fields(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("due", pa.int64()), ("part", pa.int32()), ("open", pa.bool_())])


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, separator: int = 0, digests: dict[str, Column] | None = None, due: Column | None = None
) -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id, offset, due.

    tokenizer: path of a vocabulary file, present on every executor; added tokens come from the JSON file, itself or
    beside the rank file, read on the driver; without it the call fails. digests: columns computed from the column ids (little-endian unsigned 32-bit), kept in its
    place. due: when a row of docs is due (bigint); the column due of a piece is the smallest of its sequence.
    """
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = f"doc {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, due bigint, part int, open boolean"
    end = np.array([separator], "<u4").tobytes()
    # Read once, here, so that all executors give a text the same ids.
    added = added_tokens(tokenizer)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words, windows, rows, held, fields = None, OpenWindows(size, OPEN_WINDOWS, part << 33), [], 0, None

        def batch(rows: list, still_open: bool) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=False)] + [pa.array([part] * len(rows), pa.int32()), pa.array([still_open] * len(rows), pa.bool_())], schema=fields)

        for b in batches:
            words = words or tokenizer_of(tokenizer, added)
            fields = fields or _fields(b.schema.field(0).type)
            for doc, text, when in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                ids = words.encode(text.as_py() or "") + end
                rows += windows.place(doc, ids, len(ids) // 4, due=when)
                held += len(ids)
                if held > 8 << 20 and rows:
                    yield batch(rows, False)
                    rows, held = [], 0
        if words:
            # The worker process stays, and what it held would be missing in later stages.
            words.forget()
        if rows:
            yield batch(rows, False)
        if rows := windows.leftovers():
            yield batch(rows, True)

    def merge(table: pa.Table) -> pa.Table:
        """Fills windows with the open pieces of a group, in order; cuts the last at powers of two."""
        part = table["part"][0].as_py()
        windows = OpenWindows(size, 1, (1 << 62) + (part // MERGE_PARTITIONS << 33))
        rows = []
        names = ["doc", "ids", "doc_tokens", "start", "due"]
        # Ids stay what Arrow has: no number becomes a float because another is null.
        for doc, ids, total, start, when in zip(*(c.to_pylist() for c in table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).select(names).columns), strict=True):
            rows += windows.place(doc, ids, total, start, when)
        for pieces in [w[1] for w in windows.open]:
            tail = sum(p[2] for p in pieces)
            while tail:
                room, now, later = 1 << tail.bit_length() - 1, [], []
                tail -= room
                for doc, start, n, ids, total, when in pieces:
                    k = min(n, room)
                    room -= k
                    if k:
                        now.append((doc, start, k, ids[: 4 * k], total, when))
                    if n > k:
                        later.append((doc, start + k, n - k, ids[4 * k :], total, when))
                rows += windows._close(now)
                pieces = later
        fields = _fields(table.schema.field("doc").type)
        columns = [*zip(*rows, strict=True), [part] * len(rows), [False] * len(rows)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    when = F.lit(0) if due is None else due
    packed = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), when.cast("bigint").alias("due")).mapInArrow(pack, schema)
    digests = digests or {"ids": F.col("ids")}
    columns = ["doc", "start", "length", *[c.alias(n) for n, c in digests.items()], "doc_tokens", "sequence_id", "offset", "due"]
    packed = materialize(packed.select(*columns, "open", "part", F.when(F.col("open"), F.col("ids")).alias("__ids")), "packed")
    open_pieces = packed.where("open").select("doc", "start", "length", F.col("__ids").alias("ids"), "doc_tokens", "sequence_id", "offset", "due", "part", "open")
    merged = open_pieces.groupBy(F.expr(f"part div {MERGE_PARTITIONS}").alias("g")).applyInArrow(merge, schema).select(*columns)
    out = packed.where("not open").select("doc", "start", "length", *digests, "doc_tokens", "sequence_id", "offset", "due").unionByName(merged)
    out = out.withColumnRenamed("doc", id_col)
    return out if due is not None else out.drop("due")
