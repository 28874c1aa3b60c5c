"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import base64
import hashlib
import random
import re
import shutil
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from courierlake.llm import jaccard_join, language, licenses, media, mixing, packing, substring_dedup, toxicity, url_filter, webp
from courierlake.llm.components import connected_components
from courierlake.llm.exact_dedup import drop_exact_copies, exact_groups

#: The last columns clash with names that operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, id string, uid string, size string, key string, body string, kept string, host string, rows string"
EXTRA = ("x",) * 8
rng = random.Random(7)
VOCABULARY = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, every, seed):
    r, words = random.Random(seed), text.split(" ")
    return " ".join(r.choice(VOCABULARY).upper() if i % every == every // 2 else w for i, w in enumerate(words))


def fixture_rows():
    base, passage = prose(300, 1), prose(60, 2)
    texts = [None, "", "  \t\n ", "one", "one two three", base, base, base, edited(base, 100, 3), edited(base, 60, 4), edited(base, 15, 5), base.upper()]
    texts += [prose(120, 10 + k) + " " + passage + " " + prose(50, 90 + k) for k in range(6)]
    texts += ["a" * 700, "ab" * 500, prose(9000, 77), prose(40, 5) + "  double  blanks\n\n" + "éü漢字 " * 30, "one two three", "One TWO three"]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "s1", "s2", "s2"][i % 4], *EXTRA) for i, t in enumerate(texts)]
    # Repeated rows, a null id, an id with two texts.
    return [*rows, rows[9], rows[1], (None, base, "en", "s1", *EXTRA), (None, None, "en", "s1", *EXTRA), (3, prose(80, 6), "en", "s2", *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "d.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


# ---- repeated substrings -----------------------------------------------------------------------------------


def test_repeats(docs, empty):
    rows = fixture_rows()
    bodies = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    want = []
    for r, b in zip(rows, bodies, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((r[0], len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = substring_dedup.span_digests(substring_dedup.remove_repeats(docs)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("chunk, held", [(1 << 17, 1_500_000), (997, 50)])
def test_repeats_across_chunks(spark, monkeypatch, chunk, held):
    """Texts beyond one chunk, and tasks that combine in several portions."""
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    monkeypatch.setattr(substring_dedup, "HELD", held)
    long, passage = prose(30_000, 31), prose(70, 32)
    texts = [long, prose(200, 33) + passage + prose(90, 34), long[60_000:61_500], passage + " " + prose(30, 35), prose(400, 36), long[-300:] + prose(40, 37), "z" * 2500]
    rows = list(enumerate(texts))
    bodies = [t.encode() for t in texts]
    seen = Counter(hash(b[i : i + 200]) for b in bodies for i in range(len(b) - 199))
    want = []
    for k, b in enumerate(bodies):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[hash(b[i : i + 200])] > 1:
                gone[i : i + 200] = True
        want.append((k, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    if chunk < 1000:
        # Tasks run in processes of their own, where the constants are the module's: the steps themselves are compared.
        x = np.frombuffer(bodies[0], np.uint8)
        parts = list(substring_dedup._choose(iter([substring_dedup.pa.RecordBatch.from_pydict({"uid": np.array([7]), "body": substring_dedup.pa.array([bodies[0]], "binary")})])))
        start, count, _, kind = substring_dedup._unpacked(np.concatenate([p.column("at").to_numpy() for p in parts]))
        covered = np.zeros(len(x) - 199, bool)
        for s, c, k in zip(start, count, kind, strict=True):
            covered[s : s + c] = True
        assert covered.all() and len(parts) > 1
        return
    got = substring_dedup.span_digests(substring_dedup.remove_repeats(docs)).collect()
    assert sorted(map(tuple, got)) == want


def test_chosen_positions_cover_each_window_once():
    x = np.frombuffer((prose(400, 3) + "z" * 300 + prose(50, 4)).encode(), np.uint8)
    key, stretch, first, count, off = substring_dedup.chosen_positions(x)
    assert (first[1:] == first[:-1] + count[:-1]).all() and first[0] == 0 and first[-1] + count[-1] == len(x) - 199
    assert ((off >= 0) & (off <= 100) & (off - count + 1 >= 0)).all()


# ---- mixing ------------------------------------------------------------------------------------------------


def test_mix(docs, empty):
    rows = fixture_rows()
    size = Counter()
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight, target, open_ = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, set(names)
    while True:
        rest = sum(size.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * size[s]}
        if not above:
            break
        target |= {s: 3 * size[s] for s in above}
        open_ -= above
    target |= share
    mixed = mixing.mix_documents(docs).collect()
    taken = Counter()
    by_source = {r["source_size"]: r["target"] for r in mixed}
    for s in names:
        assert by_source[size[s]] == pytest.approx(target[s])
    for r in mixed:
        assert 0 <= r["taken"] <= 3 * r["size"] and sum(p["words"] for p in r["positions"]) == r["taken"]
        assert all(0 <= p["position"] <= 1 for p in r["positions"])
        taken[r["source_size"]] += r["taken"]
    assert all(abs(taken[size[s]] - target[s]) <= 1 for s in names)
    again = mixing.mix_documents(docs.repartition(5)).select("doc_id", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix_documents(docs).select("doc_id", "taken").collect())
    assert mixing.mix_documents(empty).count() == 0


def test_rows_without_an_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rows = [(None if k % 2 else k, prose(1 + k % 9, k), "a" if k % 3 else None) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mixing.mix_documents(docs).collect()
    assert len(mixed) == 600
    taken, target = Counter(), {}
    for r in mixed:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = mixing.mix_documents(docs.repartition(7)).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))


def test_many_rows_equal_the_sql(spark):
    """More rows than one bucket holds."""
    import duckdb

    from courierlake.llm import queries

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    found = con.execute(queries.MIX_SQL)
    names = [d[0] for d in found.description]
    got = queries.op2_mix_sources(spark, sf).select(*names).collect()
    assert len(got) > 2 * mixing.BUCKET_ROWS and sorted(map(str, map(tuple, got))) == sorted(map(str, found.fetchall()))


def test_stream_repeats_and_cuts_documents(docs, empty):
    stream = mixing.mixed_rows(docs)
    assert stream.columns == docs.columns
    words = stream.select(F.sum(mixing.words_in("text"))).first()[0]
    assert words == sum(r["taken"] for r in mixing.mix_documents(docs).collect())
    assert mixing.mixed_rows(empty).count() == 0


def test_schedule_is_inverted(spark):
    plan = ((1.0, 3.0), (0.0, 1.0))
    at = [r[0] for r in spark.range(5).select(mixing.training_position(F.col("id") / 4, F.lit(0), plan)).collect()]
    assert at == pytest.approx([0, 0.5, 2 / 3, 5 / 6, 1])
    assert spark.range(1).select(mixing.training_position(F.lit(0.5), F.lit(1), plan)).first()[0] == pytest.approx(0.75)


# ---- exact copies ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [128, 4])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(docs, empty, keep, bits):
    members = defaultdict(list)
    for r in fixture_rows():
        members[r[1] or ""].append(r[0])
    want = []
    for text, ids in members.items():
        known = [i for i in ids if i is not None]
        best = {"min": min, "max": max}[keep](known) if known else None
        want += [(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    got = exact_groups(docs, keep=keep, hash_bits=bits).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert exact_groups(empty, keep=keep).count() == 0


def test_survivors_keep_their_columns(docs, empty):
    kept = drop_exact_copies(docs, keep="max")
    assert kept.columns == docs.columns
    assert sorted(str(r["text"] or "") for r in kept.collect()) == sorted({r[1] or "" for r in fixture_rows()})
    assert drop_exact_copies(empty).count() == 0


# ---- media -------------------------------------------------------------------------------------------------

TRANSFORMS = [(), ((webp.SUBTRACT_GREEN,),), ((webp.CROSS_COLOUR, 0xE01525),), ((webp.PREDICTOR, 11), (webp.CROSS_COLOUR, 0x123456), (webp.SUBTRACT_GREEN,)), ((webp.PALETTE,),), ((webp.PALETTE,), (webp.PREDICTOR, 5))]
TRANSFORMS += [((webp.PREDICTOR, m),) for m in range(14)]


@pytest.mark.parametrize("colours", [1, 2, 3, 12, 200, 1 << 32])
@pytest.mark.parametrize("cache, references", [(0, False), (6, False), (0, True), (3, True)])
def test_webp_round_trip(colours, cache, references):
    r = np.random.default_rng(colours)
    width, height = 37, 21
    table = r.integers(0, 1 << 32, min(colours, 5000), dtype=np.uint32)
    pixels = np.repeat(table[r.integers(0, len(table), 400)], 2)[: width * height]
    for how in TRANSFORMS:
        if len(np.unique(pixels)) > 256 and (webp.PALETTE,) in how:
            continue
        w, h, back = webp.decode(webp.encode(pixels, width, height, how, cache, references))
        assert (w, h) == (width, height) and (back == pixels).all(), how


def test_webp_of_another_encoder():
    # The lossless image of one pixel by which browsers are commonly asked whether they read the format.
    raw = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    width, height, pixels = webp.decode(raw)
    assert (width, height, len(pixels)) == (1, 1, 1)


@pytest.mark.parametrize("longest", [7, 15])
def test_code_lengths_are_complete(longest):
    r = np.random.default_rng(longest)
    for k in range(200):
        counts = np.zeros(280, int)
        n = int(r.integers(2, 100))
        counts[r.choice(280, n, replace=False)] = np.maximum(1, r.pareto(0.3, n)).clip(1, 1e12).astype(int) if k % 2 else 1
        lengths = webp.code_lengths(counts, longest)
        assert (lengths[counts > 0] > 0).all() and (lengths[counts == 0] == 0).all() and lengths.max() <= longest
        assert sum(2.0 ** -lengths[counts > 0]) == 1
        codes = webp.canonical_codes(lengths)
        assert len({(int(c), int(n)) for c, n in zip(codes, lengths) if n}) == n


def test_stored_form_follows_the_pixels():
    """References, cache, palette and transforms are all chosen for some payload, and all are read back."""
    r, used = np.random.default_rng(1), set()
    near = np.cumsum(r.integers(0, 3, (40, 144, 4)), axis=1).astype(np.uint8)
    green = r.integers(0, 256, (40, 144, 1)) + np.zeros((1, 1, 4), int)
    green[..., 3] = 255
    many = r.integers(0, 256, (900, 4)).astype(np.uint8)[r.integers(0, 900, 5760)]
    for payload in [many.tobytes(), b"", b"abcd" * 5000, b"one two three. " * 900, prose(900, 1).encode(), bytes(range(256)) * 90, near.tobytes(), green.astype(np.uint8).tobytes(), ("x" + prose(40, 3)).encode() * 40]:
        form = []
        step, webp.encode = webp.encode, lambda *a, **k: form.append(k) or step(*a, **k)
        try:
            stored = media.store_bytes(payload)
        finally:
            webp.encode = step
        used |= {"references" if form[0].get("references") else "", "cache" if form[0].get("cache_bits") else "", *(t[0] for t in form[0].get("transforms", ()))}
        assert media.read_pixels(stored)[2][: len(payload)] == payload
    assert used >= {"", "references", "cache", webp.PALETTE} and used & {webp.PREDICTOR, webp.SUBTRACT_GREEN, webp.CROSS_COLOUR}


def test_images_read_together_equal_each_alone(monkeypatch):
    r = np.random.default_rng(6)
    files = []
    for k in range(60):
        width, height = int(r.integers(1, 40)), int(r.integers(1, 30))
        pixels = r.integers(0, [2, 300, 1 << 32][k % 3], width * height, dtype=np.uint64).astype(np.uint32)
        how = [(), ((webp.SUBTRACT_GREEN,),), ((webp.PREDICTOR, 1),), ((webp.PREDICTOR, 11), (webp.CROSS_COLOUR, 0x123456))][k % 4]
        files.append(webp.encode(pixels, width, height, how, [0, 0, 4][k % 3], k % 5 == 0))
    for alone in (1, 24, 1000):
        monkeypatch.setattr(webp, "ALONE", alone)
        for (w, h, x), f in zip(webp.decode_many(files), files, strict=True):
            assert (w, h) == webp.decode(f)[:2] and (x == webp.decode(f)[2]).all()
    assert webp.decode_many([]) == []
    with pytest.raises(ValueError):
        webp.decode_many([*files[:2], files[1][:40] + bytes(2)])


def test_webp_damage():
    good = webp.encode(np.arange(500, dtype=np.uint32) * 77777, 50, 10)
    with pytest.raises(ValueError):
        webp.decode(b"GIF8" + good[4:])
    with pytest.raises(ValueError):
        webp.decode(good[:60])


def test_media(docs, empty):
    stored = media.decode_media(media.encode_media(docs.select("doc_id", F.col("text").cast("binary").alias("b")), "doc_id", "b"))
    got = sorted((str(r["doc_id"]), r["n_bytes"], bytes(r["pixels"])) for r in stored.collect())
    want = []
    for r in fixture_rows():
        b = (r[1] or "").encode()
        want.append((str(r[0]), len(b), b + b"\xff" * (-len(b) % 576 or (0 if b else 576))))
    assert got == sorted(want)
    assert stored.where("feature is null").count() == 0
    assert media.decode_media(media.encode_media(empty.select("doc_id", F.col("text").cast("binary").alias("b")), "doc_id", "b")).count() == 0


def test_large_payload_takes_several_images():
    data = bytes(range(256)) * 40_000
    step, media.MAX_ROWS = media.MAX_ROWS, 1000
    try:
        stored = media.store_bytes(data)
    finally:
        media.MAX_ROWS = step
    assert stored.count(b"WEBPVP8L") > 1
    assert media.read_pixels(stored)[2][: len(data)] == data


# ---- packing -----------------------------------------------------------------------------------------------


def vocabulary(kind):
    public = pytest.importorskip("public_tokenizers")
    return public.path(f"byte_bpe_50k.{kind}")


def test_tokens_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(vocabulary("json"))
    own.encode_special_tokens = True
    texts = [r[1] or "" for r in fixture_rows()] + [" a", "a ", "a  b", "it's 'x' don't", "a\n b", "x <|endoftext|> y", "1 22 333\t4", "\u00a0a b\u2003c", "end\n"]
    for kind in ("tiktoken", "json"):
        words = packing.WordTokenizer(vocabulary(kind))
        for t in [*texts, *texts]:
            assert np.frombuffer(words.encode(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, (kind, t)


def test_ids_of_all_documents_equal_the_plain_call():
    """The rank file, as the query uses it, against the JSON file called plainly, on every text of a table."""
    import duckdb

    own = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary("json"))
    words = packing.tokenizer_of(vocabulary("tiktoken"))
    texts = [t for (t,) in duckdb.sql("select coalesce(text, '') from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    assert len(texts) >= 1000
    for t in [*texts, *(t[:200] + "<|endoftext|> " + t[200:400] for t in texts[:200]), *(t.replace(". ", ".  \n ") for t in texts[:100])]:
        assert np.frombuffer(words.encode(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["tiktoken", "json"])
def test_packed_ids_have_added_tokens(spark, kind):
    own = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary("json"))
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|> b  c", "it's <|endoftext|>\n\n x y", "<|endoftext|", "<<|endoftext|>>", prose(40, 9) + "<|endoftext|>" + prose(40, 10)]
    want = {i: own.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert want[0] == [87, 220, 50256, 331, 0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = defaultdict(list)
    for p in packing.pack_documents(docs, vocabulary(kind), size=16).orderBy("doc_id", "start").collect():
        assert p["doc_tokens"] == len(want[p["doc_id"]])
        got[p["doc_id"]] += np.frombuffer(p["ids"], "<u4").tolist()
    assert got == want


def test_packing_keeps_ids_whole(spark, tmp_path):
    """A null id beside numbers that no double holds; the vocabulary's added tokens have to be there."""
    ids = [9007199254740993, None, 9007199254740995, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id bigint, text string").coalesce(1)
    got = packing.pack_documents(df, vocabulary("tiktoken"), size=64).collect()
    assert {r["doc_id"] for r in got} == set(ids)
    named = packing.pack_documents(df.selectExpr("struct(doc_id as a) as doc_id", "text"), vocabulary("tiktoken"), size=64).collect()
    assert {r["doc_id"]["a"] for r in named} == set(ids)
    shutil.copy(vocabulary("tiktoken"), tmp_path / "alone.tiktoken")
    with pytest.raises(FileNotFoundError):
        packing.pack_documents(df, str(tmp_path / "alone.tiktoken"))


def test_packing_merges_groups_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGE_PARTITIONS", 4)
    texts = [prose(1 + k % 23, k) for k in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(11)
    pieces = packing.pack_documents(docs, vocabulary("json"), size=64, due=F.col("doc_id") + 7).collect()
    filled, found = defaultdict(list), defaultdict(int)
    for p in pieces:
        filled[p["sequence_id"]].append(p)
        found[p["doc_id"]] += p["length"]
    words = packing.WordTokenizer(vocabulary("json"))
    assert found == {i: len(words.encode(t)) // 4 + 1 for i, t in enumerate(texts)}
    padded = 0
    for parts in filled.values():
        total = sum(p["length"] for p in parts)
        assert sorted(p["offset"] for p in parts) == [0, *np.cumsum([p["length"] for p in sorted(parts, key=lambda p: p["offset"])])[:-1].tolist()]
        assert {p["due"] for p in parts} <= {min(q["doc_id"] for q in parts) + 7, *range(7, 157)} and len({p["due"] for p in parts}) == 1
        padded += total not in (64, 32, 16, 8, 4, 2, 1)
    assert not padded and "due" not in packing.pack_documents(docs, vocabulary("json")).columns


def test_long_texts_pack_in_linear_time():
    import time

    took = []
    for n in (400_000, 1_600_000):
        windows, ids, began = packing.OpenWindows(1024, 16, 0), bytes(4 * n), time.process_time()
        pieces = windows.place(1, ids, n)
        took.append(time.process_time() - began)
        assert sum(len(p[3]) for p in pieces) == 4 * (n // 1024 * 1024)
    assert took[1] < 12 * max(took[0], 0.002)


def test_workers_keep_no_words_after_packing(spark):
    docs = spark.createDataFrame([(i, prose(200, i)) for i in range(40)], "doc_id bigint, text string").repartition(4)
    assert packing.pack_documents(docs, vocabulary("tiktoken")).count() > 0

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(w._cache) for w in packing._loaded.values())], pa.int64())], names=["n"])

    assert spark.range(0, 64, 1, 8).mapInArrow(held, "n bigint").agg(F.max("n")).first()[0] == 0


def test_word_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)
    words = packing.WordTokenizer(vocabulary("json"))
    for k in range(40):
        words.encode(prose(30, k) + " " + "".join(VOCABULARY)[k : k + 900])
        assert words._held <= 20_000 and sum(len(w) + len(i) for w, i in words._cache.items()) <= words._held


@pytest.mark.parametrize("size", [1024, 64])
def test_packing(docs, empty, size):
    words = packing.WordTokenizer(vocabulary("tiktoken"))
    pieces = packing.pack_documents(docs.where("doc_id is not null and doc_id <> 3 and doc_id <> 9 and doc_id <> 1"), vocabulary("tiktoken"), size=size).collect()
    ids = {r[0]: words.encode(r[1] or "") + bytes(4) for r in fixture_rows() if r[0] not in (None, 3, 9, 1)}
    found, filled = defaultdict(dict), defaultdict(list)
    for p in pieces:
        found[p["doc_id"]][p["start"]] = p
        filled[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(found) == set(ids)
    for doc, parts in found.items():
        at, raw = 0, b""
        for start in sorted(parts):
            p = parts[start]
            assert start == at and p["doc_tokens"] == len(ids[doc]) // 4 and len(p["ids"]) == 4 * p["length"]
            at, raw = at + p["length"], raw + bytes(p["ids"])
        assert raw == ids[doc]
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size and (at == size or at & (at - 1) == 0)
    assert packing.pack_documents(docs, vocabulary("tiktoken"), digests={"crc": F.crc32("ids")}).columns == ["doc_id", "start", "length", "crc", "doc_tokens", "sequence_id", "offset"]
    assert packing.pack_documents(empty, vocabulary("tiktoken")).count() == 0


# ---- similar documents -------------------------------------------------------------------------------------


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(sets):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def check_components(rows, result):
    """rows: (id, text); compares sizes and the smallest ids of components."""
    sets = shingle_sets([t for _, t in rows])
    comps = brute_components(sets)
    low = defaultdict(list)
    for (i, _), c in zip(rows, comps, strict=True):
        low[c] += [i] if i is not None else []
    want = sorted((str(i), len(s), str(min(low[c]) if low[c] else None)) for (i, _), s, c in zip(rows, sets, comps, strict=True))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in result.collect()) == want


def test_similar_documents(docs, empty):
    check_components([(r[0], r[1]) for r in fixture_rows()], jaccard_join.similar_documents(docs))
    assert jaccard_join.similar_documents(empty).count() == 0


def test_blocks_and_buckets_take_little_memory():
    texts = [b" ".join(b"%d" % (k * 7919 + i) for i in range(500)) for k in range(1200)] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], names=["uid", "body"])
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        asked = []
        for row in jaccard_join._blocks(1, 5, jaccard_join.HOT)(iter([batch])):
            asked.append(row)
        shingles = sum(len(r["shingles"]) // 6 for b in asked for r in b.to_pylist())
        assert shingles == 2400 * 496
        assert tracemalloc.get_traced_memory()[1] - before < 55 * shingles
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        counts = [r for b in jaccard_join._count(iter(asked)) for r in b.to_pylist() if r["kind"] == jaccard_join.ANSWER]
        assert tracemalloc.get_traced_memory()[1] - before < 65 * shingles
    finally:
        tracemalloc.stop()
    assert [len(r["shingles"]) // 6 for r in counts] == [shingles] and min(np.frombuffer(counts[0]["numbers"], "<i4")) >= 2


@pytest.mark.parametrize("least", [2, 3, 64])
def test_frequent_values(least):
    r = np.random.default_rng(least)
    for n in (0, 1, least, 1000):
        h = r.integers(0, 1 + n // 3, n).astype(np.uint64)
        found = jaccard_join.frequent_values(h, least)
        assert found.tolist() == sorted(x for x, k in Counter(h.tolist()).items() if k >= least)
        assert jaccard_join.among(h, found).tolist() == [x in set(found.tolist()) for x in h.tolist()]


@pytest.mark.parametrize("frequent", [jaccard_join.HOT, 8])
def test_similar_documents_of_a_large_group(spark, frequent):
    base, other = prose(90, 50), prose(90, 51)
    texts = [edited(base, 20 + k % 50, k) for k in range(60)] + [edited(other, 12 + k % 30, k) for k in range(40)] + [base[: 300 + 4 * k] for k in range(30)] + [prose(60, 500 + k) for k in range(20)]
    rows = list(enumerate(texts))
    check_components(rows, jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), frequent=frequent))


def test_words_that_a_polynomial_confuses(spark):
    # Complementary Thue-Morse words collide in every polynomial hash modulo a power of two.
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = list(enumerate([one, other, one, f"{prose(40, 1)} {one}", f"{prose(40, 1)} {other} {prose(9, 2)}", f"{prose(40, 1)} {one} {prose(9, 2)}"]))
    check_components(rows, jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")))


def test_tokens_may_collide(spark, monkeypatch):
    # Tokens of six bits: nearly all shingles share one, in documents too; sizes, classes and links stay right.
    monkeypatch.setattr(jaccard_join, "_MASK", np.uint64(63))
    base = prose(60, 50)
    rows = list(enumerate([edited(base, 9 + k, k) for k in range(12)] + [prose(50, 900 + k) for k in range(12)] + [base, base.upper(), "a b", None, "a b c d e f"]))
    raw = [(t or "").encode() for _, t in rows]
    ends = np.cumsum([0] + [len(b) for b in raw])
    batch = jaccard_join.pa.RecordBatch.from_arrays([jaccard_join.pa.array([i for i, _ in rows], "int64"), jaccard_join.pa.array(raw, "binary")], names=["uid", "body"])
    asked = list(jaccard_join._blocks(2, 5, 8)(iter([batch])))
    done = list(jaccard_join._prefixes(75)(jaccard_join._count(iter(asked))))
    docs = [r for b in done for r in b.to_pylist()]
    sets = shingle_sets([t for _, t in rows])
    assert [len(sets[r["uid"]]) for r in docs] == [r["n"] for r in docs] and len(docs) == len(rows)
    by = {r["uid"]: r for r in docs if r["prefix"]}
    assert by[24]["key"] == by[25]["key"] and len({r["key"] for r in by.values()}) == len({frozenset(sets[u]) for u in by})
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = ({t["token"] for t in by[k]["prefix"]} for k in (i, j))
                assert x & y
    assert len(ends) == len(rows) + 1


@pytest.mark.parametrize("split, ids", [(4, 500_000), (2, 0)])
def test_frequent_tokens_and_leaders_are_split(spark, monkeypatch, split, ids):
    monkeypatch.setattr(jaccard_join, "SPLIT", split)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", ids)
    monkeypatch.setattr(jaccard_join, "LEADER_ROUNDS", 1)
    base, other = prose(90, 50), prose(90, 51)
    rows = list(enumerate([edited(base, 12 + k % 40, k) for k in range(30)] + [edited(other, 12 + k % 30, k) for k in range(20)] + [base[: 300 + 9 * k] for k in range(15)] + [prose(60, 500 + k) for k in range(9)]))
    check_components(rows, jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)))


def test_long_texts_link(spark):
    # Beyond the bytes that are hashed at once.
    base = prose(400_000, 5)
    rows = [(1, base), (2, base + " x y z"), (3, prose(400_000, 6)), (4, base[: len(base) // 2])]
    check_components(rows, jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")))


def test_shingles_do_not_cross_texts():
    texts = ["a b c d e f", "a b", "", "x", "a b c d e f", "A B C D E f"]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0] + [len(b) for b in raw])
    h, of = jaccard_join.shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), ends)
    by = [set(h[of == k].tolist()) for k in range(len(texts))]
    assert [len(b) for b in by] == [2, 1, 0, 1, 2, 2] and by[0] == by[4] == by[5] and not by[0] & by[1]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 9), (9, 8), (7, 7), (None, 3), (11, None), (None, None), (2, 1), (9, 8)]
    got = {(r["node"], r["comp"]) for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(k, 1) for k in range(1, 7)} | {(k, 8) for k in (8, 9, 10)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- toxicity ----------------------------------------------------------------------------------------------


def toxic_rows():
    rows = []
    for k in range(600):
        bad = k % 8 == 0
        words = prose(40, 1000 + k).split()
        if bad:
            words[3:3] = ["idiot", "pathetic"] if k % 16 else ["blarg" + VOCABULARY[k % 50], "blargle"]
        rows.append((k, " ".join(words), int(bad)))
    return rows


def test_toxicity(spark, empty):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, *EXTRA[:1]) for i, t, _ in rows] + [(9001, None, "x"), (9002, "", "x"), (None, "you pathetic idiot", "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9001, None), (5, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == 603 and all(0 <= r["score"] <= 1 for r in got.values())
    out = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == rows[i][2] for i in out) >= 0.97 * len(out)
    assert got[None]["predicted"] == 1 and got[9001]["predicted"] == got[9002]["predicted"] == 0
    # Labels of the held-out fold are not used.
    flipped = spark.createDataFrame([(i, 1 - y if i in out else y) for i, _, y in rows] + [(None, 1), (9001, None), (5, 0)], "doc_id bigint, toxic int")
    assert toxicity.fit_toxicity(docs, flipped) == model
    bare = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, bare).collect()}[None] == 1
    assert toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.fit_toxicity(empty, labels).weights


def test_label_model_finds_the_good_voter():
    r = np.random.default_rng(3)
    y = r.random(4000) < 0.2
    good, copy = y & (r.random(4000) < 0.8), None
    copy = good.copy()
    noise = r.random(4000) < 0.15
    other = y & (r.random(4000) < 0.6)
    votes = np.stack([good, copy, noise, other], 1).astype(float)
    q, rates, groups = toxicity.label_model(votes, None, prior=0.2)
    ratio = rates[1] / rates[0]
    assert ratio[0] > 5 * ratio[2] and groups[0] > groups[2]
    assert ((q > 0.5) == y).mean() > 0.93


def test_label_model_equals_plain_em():
    r = np.random.default_rng(9)
    y = r.random(300) < 0.2
    votes = np.stack([y & (r.random(300) < 0.7), r.random(300) < 0.1, y & (r.random(300) < 0.4), np.zeros(300, bool), y ^ (r.random(300) < 0.03)], 1).astype(float)
    got, rates, _ = toxicity.label_model(votes, 4, prior=0.2, rounds=25, correlate=False)
    n, m = votes.shape
    mean = [min(max(sum(votes[:, j]) / n, 1e-6), 1 - 1e-6) for j in range(m)]
    q = [0.95 if v[4] else 0.02 for v in votes]
    for _ in range(25):
        new = []
        fire = [[0.0] * m, [0.0] * m]
        for j in range(m):
            for c in (0, 1):
                weight = [x if c else 1 - x for x in q]
                strength, towards = (toxicity.REPUTE, (0.02, 0.95)[c]) if j == 4 else (toxicity.SMOOTHING, mean[j])
                fire[c][j] = (sum(w * v[j] for w, v in zip(weight, votes)) + strength * towards) / (sum(weight) + strength)
            fire[0][j] = min(fire[0][j], fire[1][j])
        p = (sum(q) + 5 * 0.2) / (n + 5)
        silent = [not any(v[:4]) for v in votes]
        none = [(sum((x if c else 1 - x) for x, z in zip(q, silent) if z) + toxicity.SMOOTHING * sum(silent) / n) / (sum(x if c else 1 - x for x in q) + toxicity.SMOOTHING) for c in (0, 1)]
        for v, nothing in zip(votes, silent):
            one, zero = p * (none[1] if nothing else 1), (1 - p) * (none[0] if nothing else 1)
            for j in [4] if nothing else range(m):
                one *= fire[1][j] if v[j] else 1 - fire[1][j]
                zero *= fire[0][j] if v[j] else 1 - fire[0][j]
            new.append(one / (one + zero))
        q = new
    assert np.allclose(got, q, atol=1e-6) and np.allclose(rates, fire, atol=1e-6)
    assert max(rates[:, 3]) < 1e-6


def test_few_labels_do_not_collapse(spark):
    # Nine toxic rows among seventy, most of the lexicon silent: their posteriors stay with their labels.
    rows = [(i, t, y) for i, t, y in toxic_rows() if zlib.crc32(str(i).encode()) % 4 != 2][:70]
    rest = [(i, t, y) for i, t, y in toxic_rows() if i not in {x[0] for x in rows}]
    docs = spark.createDataFrame(toxic_rows(), "doc_id bigint, text string, y int")
    model = toxicity.fit_toxicity(docs.drop("y"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs.drop("y"), model).collect()}
    assert sum(got[i] for i, t, y in rest if y and "pathetic" in t) >= 0.9 * sum(y for _, t, y in rest if "pathetic" in t)
    assert sum(got[i] for i, _, y in rest if not y) <= 0.03 * sum(not y for _, _, y in rest)


def test_repeated_labelled_rows_are_learned_once(spark):
    rows = toxic_rows()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    once = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    assert toxicity.fit_toxicity(once.unionByName(once).unionByName(once), labels) == toxicity.fit_toxicity(once, labels)


def test_toxicity_workers_take_few_rows_at_a_time(spark):
    batch = pa.RecordBatch.from_pydict({"a": list(range(1001))})
    parts = list(toxicity.slices(iter([batch, batch.slice(0, 0)])))
    assert [x for p in parts for x in p["a"].to_pylist()] == list(range(1001))
    assert max(p.num_rows for p in parts) <= toxicity.SLICE_ROWS
    # Carried texts are sent once, and found wherever they stand.
    model = toxicity.ToxicityModel(-2.0, {"idiot": 4.0})
    docs = spark.createDataFrame([(1, "you idiot", "x"), (2, None, "idiot")], "doc_id bigint, Text string, text_ string")
    kept = toxicity.score_toxicity(docs, model, carry="score")
    assert "AS text" not in kept._jdf.queryExecution().analyzed().toString()
    plain = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert [tuple(r) for r in kept.orderBy("doc_id").collect()] == [(1, "you idiot", "x", plain[1]), (2, None, "idiot", plain[2])]
    assert plain[1] > 0.8 > 0.2 > plain[2]


# ---- URLs --------------------------------------------------------------------------------------------------


def judge(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return (host, path, *(best or (None, "allow")))


URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/7x?y#z", "https://a.example.com/en/8", "http://b.net/de/", "http://b.net/de", "http://example.net/de/81", "http://x.org/es/1",
    "http://notexample.com/en/", "http://com/en/", "x://a.com/en/?://b", "http://a.b.c.d.e.f.g.com/en/" + "y" * 5000, "http://a.com#/en/", "http://a.com/en/", "http://a.com/en/", "http://üñí.com/en/ü", "//a.com/en/",
]
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_urls(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    pages = spark.createDataFrame([(i % 17, u, "x", "y") for i, u in enumerate(URLS)], "page_id int, url string, host string, rule string").repartition(3)
    rules = url_filter.rule_table(spark, RULES)
    got = [tuple(r) for r in url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=str) == sorted(((i % 17, *judge(u, RULES)) for i, u in enumerate(URLS)), key=str)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


# ---- languages ---------------------------------------------------------------------------------------------


def tongue(k, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(("abcde", "fghij", "klmno")[k]) for _ in range(r.randint(2, 6))) for _ in range(n))


def test_languages(spark, empty):
    rows = [(i, tongue(i % 3, 30, i), ["aa", "ff", "kk"][i % 3], "x") for i in range(90)]
    rows += [(900, None, "aa", "x"), (901, "12 34 !!", None, "x"), (902, tongue(0, 200, 5) + " " + tongue(1, 200, 6), None, "x"), (None, tongue(1, 9, 7), None, "x"), (3, tongue(0, 30, 3), "aa", "x"), (904, "", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string").repartition(3)
    model = language.fit_languages(docs.where("doc_id % 5 <> 1"))
    got = {r["doc_id"]: r for r in language.predict_languages(docs, model).collect()}
    assert all(got[i]["lang_pred"] == r[2] for i, r in enumerate(rows[:90]))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 904))
    assert {x["lang"] for x in got[902]["languages"]} == {"aa", "ff"} and abs(got[902]["score"] - 0.5) < 0.1
    assert got[None]["lang_pred"] == "ff"
    none = language.fit_languages(empty)
    assert {r["lang_pred"] for r in language.predict_languages(docs, none).collect()} == {"und"}
    assert language.predict_languages(empty, model).count() == 0


def test_texts_without_a_letter_have_no_language(spark):
    rows = [(i, tongue(i % 2, 30, i), ["aa", "ff"][i % 2]) for i in range(40)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    texts = ["\u0301\u0308 \u0300", "12\u0301", "\u20dd", "a\u0301", "\u4e00", "x" * 300_000]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()}
    assert [got[k] for k in range(3)] == ["und"] * 3 and all(got[k] in ("aa", "ff") for k in range(3, 6))


def plain_em(table, counts, members, steps=4000):
    """Proportions and log likelihood of one set of languages, one step after the other."""
    pi = {k: 1 / len(members) for k in members}
    for _ in range(steps):
        fresh = dict.fromkeys(members, 0.0)
        for g, n in enumerate(counts):
            mixed = sum(pi[k] * table[g][k] for k in members)
            for k in members:
                fresh[k] += n * pi[k] * table[g][k] / mixed
        pi = {k: v / sum(counts) for k, v in fresh.items()}
    return pi, sum(n * np.log(sum(pi[k] * table[g][k] for k in members)) for g, n in enumerate(counts) if n)


def test_mixtures_equal_plain_em_over_growing_sets():
    r = np.random.default_rng(5)

    for trial in range(6):
        table = r.random((24, 3)) ** 3 + 0.01
        table /= table.sum(0)
        truth = [[1, 0, 0], [0.6, 0.4, 0], [0.4, 0.3, 0.3], [0, 0.5, 0.5], [0, 1, 0], [0.8, 0.1, 0.1]][trial]
        counts = np.round(6000 * (table @ truth)).astype(int)
        cost = language.PENALTY * np.log(counts.sum())
        # Every single language, and sets along the proportions of the mixture of all.
        every, _ = plain_em(table.tolist(), counts.tolist(), (0, 1, 2), 600)
        order = sorted(every, key=lambda k: -every[k])
        sets = [(0,), (1,), (2,), tuple(order[:2]), tuple(order)]
        best = max(((lambda pi, fit: (fit / 4 - len(m) * cost, m, pi))(*plain_em(table.tolist(), counts.tolist(), m, 600)) for m in sets), key=lambda x: x[0])
        seen = np.flatnonzero(counts)
        got, sizes = language.infer_mixtures(language.LanguageModel(("a", "b", "c"), table.astype(np.float32)), [seen], [counts[seen]])
        # Its own penalised likelihood is as good as that of the best of these.
        value = float((counts[seen] * np.log(table[seen] @ got[0].astype(float))).sum()) / 4 - sizes[0] * cost
        assert value >= best[0] - 0.1 and sizes[0] == np.count_nonzero(got[0])
        assert abs(got[0].sum() - 1) < 1e-4 and got[0].argmax() == max(best[2], key=best[2].get)


def test_languages_mix_more_than_four(spark):
    letters = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]

    def words(k, n, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice(letters[k]) for _ in range(r.randint(2, 6))) for _ in range(n))

    rows = [(i, words(i % 6, 60, i), letters[i % 6]) for i in range(90)]
    docs = spark.createDataFrame([*rows, *((900 + m, " ".join(words(k, 300, 70 + k) for k in range(m)), None) for m in range(2, 7))], "doc_id int, text string, lang string")
    got = {r["doc_id"]: r for r in language.predict_languages(docs, language.fit_languages(docs)).where("doc_id >= 900").collect()}
    for m in range(2, 7):
        assert {x["lang"] for x in got[900 + m]["languages"]} == set(letters[:m])
        assert all(abs(x["proportion"] - 1 / m) < 0.05 for x in got[900 + m]["languages"])


def test_mixtures_are_fitted_to_the_end():
    r = np.random.default_rng(3)
    base = r.random(400) + 0.1
    table = np.stack([base * (1 + 0.5 * r.random(400)) for _ in range(3)], 1)
    table /= table.sum(0)
    counts = np.round(400_000 * (table @ [0.7, 0.3, 0])).astype(int)
    model = language.LanguageModel(("a", "b", "c"), table.astype(np.float32))
    got, sizes = language.infer_mixtures(model, [np.arange(400)], [counts])
    fits = [(counts * np.log(table[:, 0] * w + table[:, 1] * (1 - w))).sum() for w in np.linspace(0, 1, 1001)]
    assert sizes[0] == 2
    assert (counts * np.log(table @ got[0])).sum() > max(fits) - 5
    assert abs(got[0][0] - np.argmax(fits) / 1000) < 0.02


# ---- licences ----------------------------------------------------------------------------------------------


def brute_license(text, templates, threshold=0.8):
    cut = lambda x: re.findall("[a-z0-9]+", x.lower())
    pairs = lambda x: set(zip(cut(x), cut(x)[1:], strict=False))
    text = text or ""
    best = (0.0, None)
    for unit in {text, *text.split("\n"), *text.split("\n\n")}:
        for name in sorted(templates, reverse=True):
            a, b = pairs(unit), pairs(templates[name])
            score = 2.0 * len(a & b) / (len(a) + len(b)) if a and b else 0.0
            if score >= threshold and (score, name) != best and (score > best[0] or score == best[0] and name < best[1]):
                best = (score, name)
    return best[1], best[0]


def test_licenses(spark, docs, empty):
    mit = licenses.TEMPLATES["mit-notice"]
    wrapped = "\n".join(" ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9))
    texts = [None, "", "one", "ALL rights, reserved!", "x\n\n" + wrapped + "\n\nmore words here", wrapped.replace("merge", "mix"), prose(50, 3) + "\nReleased under the MIT License.", "all rights\nreserved", mit + " " + prose(20, 4), mit + " " + prose(900, 4), "the the the the " * 900, "\n\n\n"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[6])]
    got = licenses.scan_licenses(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id int, text string, license string, score string").repartition(3)).collect()
    want = [(i, *brute_license(t, licenses.TEMPLATES)) for i, t in rows]
    assert sorted(((r["doc_id"], r["license"], r["score"]) for r in got), key=str) == sorted(want, key=str)
    spans = {r["doc_id"]: [(m["license"], m["first_line"], m["last_line"]) for m in r["matches"]] for r in got}
    assert spans[4][0] == ("mit-notice", 2, 2 + wrapped.count("\n")) and spans[0] == []
    assert licenses.scan_licenses(docs, templates={}).where("license is not null").count() == 0
    assert licenses.scan_licenses(empty).count() == 0


def brute_runs(words, template, threshold=0.8):
    """The best score over all runs of words."""
    want, best = set(zip(template, template[1:], strict=False)), 0.0
    for i in range(len(words)):
        for j in range(i + 2, len(words) + 1):
            own = set(zip(words[i:j], words[i + 1 : j], strict=False))
            best = max(best, 2.0 * len(own & want) / (len(own) + len(want)))
    return best if best >= threshold else 0.0


def test_best_runs_equal_brute_force():
    r = random.Random(11)
    hits = 0
    for _ in range(300):
        words = [r.choice("abcd") for _ in range(r.randint(0, 24))]
        template = [r.choice("abcd") for _ in range(r.randint(2, 9))]
        got = licenses.scan_windows(" ".join(words), licenses.Templates({"t": " ".join(template)}, 0.8))
        assert (got[0][0] if got else 0.0) == brute_runs(words, template)
        hits += bool(got)
    assert 50 < hits < 250


def test_notices_anywhere_in_a_text(spark, tmp_path):
    from courierlake.llm import queries

    full = licenses.full_texts()
    texts = licenses.TEMPLATES | full
    gpl, apache, mit, bsd = (texts[n] for n in ("gpl-3.0", "apache-2.0-notice", "mit-text", "bsd-3-clause"))
    wrap = lambda x, mark, end="\n": end.join(mark + " ".join(x.split()[i : i + 9]) for i in range(0, len(x.split()), 9))
    cases = [
        ("gpl-3.0", gpl + " " + prose(12, 5)),
        ("gpl-3.0", prose(300, 5) + " " + gpl + " " + prose(300, 6)),
        ("apache-2.0-notice", "#!/bin/sh\n#\n" + wrap(apache, "# ") + "\n#\n" + prose(200, 7)),
        ("mit-text", "/*\n * Copyright 2020 A B\n *\n" + wrap(mit, " * ") + "\n */\n" + prose(900, 8)),
        ("mit-text", "The MIT License\r\n\r\n" + wrap(mit, "", "\r\n") + "\r\n\r\n" + prose(90, 9)),
        ("bsd-3-clause", prose(9, 1) + "\n" + wrap(bsd, "// ") + " " + prose(40, 2)),
        ("gpl-3.0-text", full["gpl-3.0-text"]),
        ("apache-2.0-text", prose(50, 3) + full["apache-2.0-text"].replace("\n", "\r\n")),
        (None, prose(2000, 4)),
        (None, None),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id int, text string").repartition(3)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs, templates=texts, windows=True).collect()}
    for i, (name, _) in enumerate(cases):
        assert got[i]["license"] == name and got[i]["score"] == (1.0 if name else 0.0), (i, got[i])
    assert (got[2]["matches"][0]["first_line"], got[2]["matches"][0]["last_line"]) == (2, 2 + wrap(apache, "# ").count("\n"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: (r["license"], r["score"]) for r in queries.op9_license_scan(spark, str(tmp_path)).collect()} == {i: (r["license"], r["score"]) for i, r in got.items()}
