"""What idle Python workers keep in memory after an operator's tasks have ended."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.llm import byte_bpe, near_dedup
from maskwright.llm import common as C


def remembered():
    """This process's vocabularies, and the words, parts and stretches that it remembers."""
    codecs = byte_bpe._codecs.values()
    return len(codecs), len(near_dedup._hashes) + sum(len(c.parts) + len(c.stretches) for c in codecs)


def in_workers(spark):
    """What ``remembered`` says in the workers that Spark keeps, by process."""

    def run(batches):
        import os

        from tests.llm.test_worker_memory import remembered

        for batch in batches:
            codecs, entries = remembered()
            yield pa.record_batch([pa.array([n] * batch.num_rows, pa.int64()) for n in (os.getpid(), codecs, entries)], ["pid", "codecs", "entries"])

    rows = spark.range(0, 8, 1, 8).mapInArrow(run, "pid bigint, codecs bigint, entries bigint")
    return {r.pid: (r.codecs, r.entries) for r in rows.collect()}


@pytest.fixture
def texts(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(60))) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)


def test_encoding_leaves_vocabularies_only(spark, texts):
    import public_tokenizers

    out = byte_bpe.encode_documents(texts, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)
    assert out.agg(F.sum("n_tokens")).first()[0] > 400 * 60
    found = in_workers(spark)
    assert any(codecs for codecs, _ in found.values())  # they are the workers that encoded
    assert all(entries == 0 for _, entries in found.values())


def test_near_copies_leave_no_words(spark, texts):
    assert near_dedup.near_groups(texts, width=2).filter("kept").count() == 400
    assert all(entries == 0 for _, entries in in_workers(spark).values())


def test_memories_are_emptied_when_a_task_ends_early_or_fails():
    batch, calls = pa.record_batch([pa.array([1])], ["x"]), []
    task = C.leaving_nothing(lambda batches: (b for b in batches), lambda: calls.append(1))
    early = task(iter([batch, batch]))
    assert next(early) is batch and not calls
    early.close()
    assert calls == [1]

    def broken(batches):
        yield from batches
        raise ValueError

    with pytest.raises(ValueError):
        list(C.leaving_nothing(broken, lambda: calls.append(2))(iter([batch])))
    assert calls == [1, 2]
