"""The pipeline's stages, each on what the one before it kept."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers

from maskwright.llm import byte_bpe


def test_pipeline(spark, tmp_path):
    draw = random.Random(3)
    text = lambda: " ".join(f"w{draw.randrange(300)}" for _ in range(80))
    clean = [text() for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(clean)]
    rows += [(100 + i, f"{text()} blorg snarf", "en", "s0", 1) for i in range(30)]  # toxic
    rows += [(200, clean[1].upper(), "en", "s0", 1), (201, clean[2] + " more", "en", None, 1), (202, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(100 <= i < 200)) for i in [*range(40), *range(100, 120)]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    expected = [
        {r[0] for r in rows} - set(range(100, 130)),
        {r[0] for r in rows} - set(range(100, 130)) - {1},
        {r[0] for r in rows} - set(range(100, 130)) - {1, 201},
    ]
    now = docs
    for (_, stage), ids in zip(corpus_pipeline.STAGES, expected, strict=False):
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns
        assert sorted(r.doc_id for r in now.select("doc_id").collect()) == sorted(ids)
    mix = corpus_pipeline.mixed(spark, now, str(tmp_path)).cache()
    assert mix.columns == docs.columns and {r.doc_id for r in mix.collect()} <= expected[2]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        codec = byte_bpe.Codec(file.read(), public_tokenizers.PATTERN)
    want = sorted((r.doc_id, hashlib.sha256(codec.encode(r.text or "")).hexdigest()) for r in mix.collect())
    got = corpus_pipeline.encoded(spark, mix, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in got) == want
    assert all(hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 for r in got)
