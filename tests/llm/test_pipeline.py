"""The pipeline on the smallest table, stage by stage against what each stage promises."""

import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from courierlake.llm.shared import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, before = docs.collect(), docs
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == before.columns
        kept = docs.collect()
        if name == "toxicity":
            assert 0.8 * len(rows) <= len(kept) < len(rows)
        if name == "exact_dedup":
            assert sorted(r["text"] for r in kept) == sorted({r["text"] for r in rows})
        if name == "ngram_jaccard_join":
            sets = [set(zip(*[re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]).split()[k:] for k in range(5)], strict=False)) for r in kept]
            for i, a in enumerate(sets):
                assert not any(a and b and 100 * len(a & b) >= 75 * len(a | b) for b in sets[:i])
        rows = kept
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() > 0 and packed.where("length < 1 or length > 1024").count() == 0


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, uid string, score string, __uid string, __take string, size string"


def odd_rows():
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    long = " ".join(f"w{k % 977}x{k}" for k in range(40_000))
    texts = [None, "", " \t", base, base, base + " more", base.replace("ten", "TEN"), "short", long, long + " end", "x" * 5000]
    rows = [(k, t, "en", ["a", "b", None][k % 3], 1, "u", "s", "i", "t", "z") for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "no id here", "en", "a", 1, "u", "s", "i", "t", "z"), (None, "no id here", "en", "a", 1, "u", "s", "i", "t", "z"), (4, "same id, other text", "en", "b", 1, "u", "s", "i", "t", "z")]


def labelled(spark, folder):
    spark.createDataFrame([(3, 0), (4, 0), (None, 1), (77, 1)], "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_odd_rows_pass_through_all_stages(spark, tmp_path):
    from courierlake.llm.shared import materialize

    labelled(spark, tmp_path)
    docs = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
        kept[name] = docs.collect()
        assert all(tuple(r)[4:] == (1, "u", "s", "i", "t", "z") for r in kept[name])
    assert len(kept["toxicity"]) == len(odd_rows())
    texts = [r["text"] or "" for r in kept["exact_dedup"]]
    assert sorted(texts) == sorted({r[1] or "" for r in odd_rows()})
    near = [r["text"] or "" for r in kept["ngram_jaccard_join"]]
    assert sum(t.startswith("one two") for t in near) == 1 and sum(t.startswith("w0x0 ") for t in near) == 1
    assert set(near) >= {"", " \t", "short", "no id here", "same id, other text"}
    packed = pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.count() and packed.where("length < 1 or length > 1024").isEmpty()
    assert pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_empty_tables_pass_through_all_stages(spark, tmp_path):
    labelled(spark, tmp_path)
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).isEmpty()
    assert pipeline.run(spark, str(tmp_path)).isEmpty()


def test_packing_keeps_the_training_order(spark, tmp_path):
    """Sequences are due in the order in which the mixing stage wrote their documents, however many files there are."""
    texts = [(k, " ".join([f"word{k}"] * 300), "en", "a", 1) for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/d")
    read = spark.read.parquet(f"{tmp_path}/d")
    places = [r["p"] for r in read.select("doc_id", pipeline.place_in_files(read).alias("p")).orderBy("doc_id").collect()]
    assert places == sorted(places) and len(set(places)) == 60
    pieces = pipeline.pack(spark, read, "").collect()
    first = {}
    for p in pieces:
        first.setdefault(p["sequence_id"], []).append(p)
    due = [p["due"] for p in pieces]
    assert due == sorted(due)
    assert all({p["due"] for p in parts} == {min(places[p["doc_id"]] for p in parts)} for parts in first.values())
