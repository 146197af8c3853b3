import numpy as np
import public_tokenizers
from common import corpus, documents
from pyspark.sql import functions as F

import corpus_pipeline
from rayscape.llm import bpe, registry


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    texts = corpus()
    docs = documents(spark, [*texts, "here token=abcdef123456 ends", texts[9], None], [*range(len(texts)), 900, 901, None])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
    rows = {r.doc_id: r for r in now.collect()}
    assert 901 not in rows and 9 in rows and None in rows and rows[900].text == "here [SECRET] ends"
    assert rows[900].n_chars == len("here [SECRET] ends")
    cleaned, packed = corpus_pipeline.run_all(spark, str(tmp_path))
    packed, cleaned = packed.collect(), {r.doc_id: r.text for r in cleaned.collect()}
    assert {r.doc_id for r in packed} == set(rows) and cleaned == {k: r.text for k, r in rows.items()}
    assert decoded(packed) == {k: v or "" for k, v in cleaned.items()}


def decoded(packed):
    tok = bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in sorted(packed, key=lambda r: r.piece):
        pieces.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert all(ids[-1] == 2 for ids in pieces.values())
    return {k: tok.decode(ids[:-1]) for k, ids in pieces.items()}


def folder(spark, tmp_path, docs, name):
    path = f"{tmp_path}/{name}"
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Empty tables, long runs of white space, and columns whose names also stand in results."""
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, documents(spark, []), "empty")).count() == 0
    texts = [" " * 3_000_000, "\n" * 1_000_000 + "x", "y " * 200_000, None, ""]
    docs = documents(spark, texts).withColumns({"score": F.lit(1.0), "redacted": F.lit("r"), "kept_text": F.lit("k"), "ids": F.lit("i"), "key": F.lit(3), "row": F.lit("w"), "component_id": F.lit(9)})
    cleaned, packed = corpus_pipeline.run_all(spark, folder(spark, tmp_path, docs, "odd"))
    assert cleaned.columns == docs.columns and cleaned.select("key", "row", "ids").distinct().collect() == [(3, "w", "i")]
    assert decoded(packed.collect()) == {0: texts[0], 1: texts[1], 2: "", 3: "", 4: ""}


def test_unlike_texts_that_share_an_id(spark, tmp_path):
    """Both stay, and so does a copy's first one; equal rows become one."""
    a, b = "a b c d e f g h", "p q r s t u v w"
    docs = documents(spark, [a, b, a, b, b, None, None], [4, 4, 7, 9, None, None, None])
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in out) == [(0, ""), (0, ""), (4, a), (4, b)]


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 11))
