import zlib

from pyspark.sql import functions as F
from test_jaccard import brute_components
from test_text_rules import brute_language, brute_removal
from test_tokens_and_packing import check_packing

import corpus_pipeline
from threadloom.llm.langid import fit
from threadloom.llm.repetition import judged, measure


def test_every_stage_on_what_the_one_before_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in kept.collect()}
        kept = corpus_pipeline.written(stage(spark, kept, sf_dir), "test-stage")
        after = {r.doc_id: r for r in kept.collect()}
        assert kept.columns == columns
        assert set(after) <= set(before)
        if name == "quality rules":
            want = {r.doc_id for r in judged(measure(docs)).where("kept").collect()}
            assert set(after) == want
        elif name == "language ID":
            profile = fit(spark.createDataFrame([(r.text, r.lang) for i, r in before.items() if zlib.crc32(str(i).encode()) % 5], "text string, lang string"))
            assert set(after) == {i for i, r in before.items() if not brute_language(profile, r.text)[2]}
            assert len(after) > 0.97 * len(before)
        elif name == "n-gram Jaccard join":
            least = brute_components([(i, r.text) for i, r in before.items()])
            assert set(after) == {c for _, _, c in least}
        else:
            for i, n, removed, sha in brute_removal([(i, r.text) for i, r in before.items()]):
                text = after[i].text
                assert (text == before[i].text) == (removed == 0)
                assert after[i].n_chars == (len(text) if removed else before[i].n_chars)
                if removed:
                    assert len(text.split()) == n - removed
                    assert kept.where(F.col("doc_id") == i).select(F.sha2("text", 256)).first()[0] == sha
    texts = {r.doc_id: [r.text] for r in kept.collect()}
    rows = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
    check_packing(rows, texts, 1024)
    assert {(r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {(r.doc_id, r.piece, r.length) for r in rows}


def test_odd_documents_pass_through(spark):
    rows = [(None, "no id at all but enough words to stay in the corpus " * 1, "en", None, None), (1, None, None, "s", 0), (2, "", "en", "s", 0), (3, "short", "en", "s", 5), (4, " ".join(f"w{i}" for i in range(4000)), None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns
    clash = docs.where("doc_id IS NULL OR doc_id = 4")
    names = ["_id", "_key", "_at", "n_words", "n_removed", "kept_sha256", "score", "lang_pred", "rejected", "key", "component"]
    for n in names:
        clash = clash.withColumn(n, F.lit(n))
    clash = clash.unionByName(clash.withColumn("text", F.concat("text", F.lit(" and a few more words behind"))).withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, clash, "")
        assert got.columns == clash.columns
        rows = got.collect()
        assert (rows or name == "language ID") and all(r[n] == n for r in rows for n in names), name  # no row here has an id and a label, so no language is learnt
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_any_column_names_pass_through(spark):
    rows = [(i, f"document {i} " + " ".join(f"word{(i * 7 + j) % 97}" for j in range(40)), "en", f"s{i}", i, i * 2, f"q{i}", [i]) for i in range(6)] + [(6, "document 0 " + " ".join(f"word{j % 97}" for j in range(40)), "en", "s", 0, 1, "again", [0])]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", "a.b", "c`d e", "Text.x"])
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, kept, ""), "test-names") if name != "language ID" else corpus_pipeline.keep_confident(kept, fit(kept.select("text", "lang")))
        assert kept.columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").columns == docs.columns
    assert {(r["doc_id"], r["a.b"], r["c`d e"], tuple(r["Text.x"])) for r in kept.collect()} <= {(r[0], r[5], r[6], tuple(r[7])) for r in rows}
    assert kept.count() >= 6
    assert corpus_pipeline.STAGES[-1][1](spark, kept, "").count() == kept.count()
