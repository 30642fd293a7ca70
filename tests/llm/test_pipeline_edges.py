import corpus_pipeline
import pytest
from tidemill.llm import license_scan, scratch, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone_doc_id long, bad_doc_id long, label string, h long, component long"
EXTRA = (1, 2, "label", 3, 4)


def tables(spark, path, docs, labels=(), items=()):
    d = f"file://{path}"
    spark.createDataFrame([(*r, *EXTRA) for r in docs], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_empty_tables(spark, tmp_path):
    d = tables(spark, tmp_path, [])
    frame = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, d)
        assert out.columns == frame.columns and out.count() == 0
    assert corpus_pipeline.run(spark, d).count() == 0
    assert simhash.similar_documents(frame).count() == 0 and simhash.keep_one_of_each(frame).count() == 0


def test_repeated_rows_nulls_and_clashing_names(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    docs = [(1, "a text of its own with some words in it", "en", "s", 40)] * 3 + [(2, "", None, None, 0), (3, None, None, None, None), (None, item, "en", "s", 5), (None, "nobody knows my id", "en", "s", 5), (4, long, "en", "s", 9), (5, long + " pwd: xK9#vQ2!mZ7$", "en", "s", 9), (6, f"so it goes {item} and on", "en", "s", 1)]
    d = tables(spark, tmp_path, docs, [(1, 1, 0), (None, 1, 1), (2, 0, None)], [(1, item), (2, None)])
    frame = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = scratch.materialize(stage(spark, frame, d), name)
        assert [f.name for f in frame.schema] == [x.split()[0] for x in SCHEMA.split(", ")]
        kept[name] = frame.collect()
        assert all((r["gone_doc_id"], r["bad_doc_id"], r["label"], r["h"], r["component"]) == EXTRA for r in kept[name])
    assert len(kept["toxicity"]) == len(docs)
    ids = sorted(str(r["doc_id"]) for r in kept["simhash_near_dedup"])
    assert ids == sorted(["1", "1", "1", "2", "None", "None", "4", "6"])  # rows of one id are one document; 3 is as empty as 2, and 5 nearly 4
    clean = kept["benchmark_decontamination"]
    assert not any(item in (r["text"] or "") for r in clean) and sorted(str(r["doc_id"]) for r in clean) == ["1", "1", "1", "2", "4", "None"]
    assert len(kept["secret_scans"]) == len(clean)
    packed = corpus_pipeline.run(spark, d).collect()
    assert sorted({str(r["doc_id"]) for r in packed}) == ["1", "2", "4", "None"] and sum(r["doc_id"] == 1 for r in packed) == 3


def test_very_long_text_is_masked_to_its_end(spark):
    text = "word " * 400_000 + "pwd: xK9#vQ2!mZ7$Lw8"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    [r] = corpus_pipeline.mask_secrets(spark, df, "").collect()
    assert r["text"] == "word " * 400_000 + "pwd: [secret]"


def test_scratch_refuses_a_machine_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_root(Session())


def test_notices_have_places_of_their_own():
    text = "x Released under the MIT License. Licensed under the Apache License, Version 2.0.\n"
    got = [text[r["notice_start"] : r["notice_end"]] for r in license_scan.scan(text)]
    assert got == ["Released under the MIT License", "Licensed under the Apache License, Version 2.0"]
