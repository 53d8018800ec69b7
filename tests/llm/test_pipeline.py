"""Every stage against what it is to do, on what the stage before it kept."""

from collections import Counter

import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.conftest import SCHEMA
from tests.llm.test_mixing_and_pii import base
from tests.llm.test_repeats import grouped
from veleta.llm import mixing
from veleta.llm import quality_model as M
from veleta.llm.common import BATCH_LIMIT

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input of the pipeline and the output of each stage, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs[-1], SF).write.parquet(str(folder / str(i)))
        docs.append(spark.read.parquet(str(folder / str(i))))
    return docs


def test_order_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "near-dedup", "pii", "source mixing", "best-fit packing"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_classifier_drops_what_it_rejects(spark, stages):
    scores = M.quality_scores(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(r.doc_id for r in scores if r.predicted)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    assert len(good & kept) >= 0.97 * len(good)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == [i for i, _, _, kept in sorted(grouped(rows, 80)) if kept]


def test_rows_without_ids_and_repeated_rows_are_thinned(spark):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:90], "other", *words[91:]]  # 191 of 201 shingles
    rows = [(None, " ".join(words), "en", "s", 1), (None, " ".join(near), "en", "s", 2), (7, " ".join(words), "en", "s", 3), (7, " ".join(words), "en", "s", 3)]
    rows += [(None, f"alone {i} " * 3, None, None, None) for i in range(3)] + [(None, None, None, None, None)] * 2
    docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", row INT")
    kept = pipeline.thin(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(7, " ".join(words)), *[(None, f"alone {i} " * 3) for i in range(3)], (None, None), (None, None)], key=repr)


def test_no_personal_data_is_left(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    for r in stages[3].collect():
        assert not base(r.text)
        if not base(before[r.doc_id].text):
            assert r.text == before[r.doc_id].text
        assert r.n_chars == len(r.text)


def test_documents_come_as_often_as_the_mix_takes_them(stages):
    copies = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect() if r.copies}
    assert Counter(r.doc_id for r in stages[4].collect()) == copies


def test_all_tokens_are_packed(stages):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for r in stages[4].collect():
        want[r.doc_id] += len(t.encode(r.text or "", add_special_tokens=False).ids) + 1
    got, used = Counter(), Counter()
    for r in stages[5].collect():
        got[r.doc_id] += r.length
        used[r.sequence_id] += r.length
    assert got == want and max(used.values()) <= 1024


def test_odd_rows_pass_all_stages(spark):
    rows = [(1, None, None, None, None), (None, "the of and " * 30, None, None, 3), (2, "", "en", "s", 0), (3, "a@b.org " * 3, "en", "s", 0), (3, "a@b.org " * 3, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for part in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES[1:]:
            part = stage(spark, part, SF)
        part.count()


@pytest.mark.parametrize("stage", [pipeline.classify, pipeline.thin, pipeline.mask, pipeline.pack])
def test_texts_reach_python_in_small_batches(spark, stage):
    @F.pandas_udf("long")
    def batch_bytes(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    rows = [(i, f"{i} word " * 4000, "en", "s", 0) for i in range(400)]  # 15 MB of texts
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    largest = lambda: docs.select(batch_bytes("text").alias("n")).agg(F.max("n")).first()[0]
    before = spark.conf.get(BATCH_LIMIT, None)
    try:
        spark.conf.unset(BATCH_LIMIT)
        stage(spark, docs.limit(3), SF).count()
        assert largest() < 5_000_000
        spark.conf.set(BATCH_LIMIT, "1m")  # a limit of the session's own stays
        stage(spark, docs.limit(3), SF).count()
        assert largest() < 1_200_000
    finally:
        spark.conf.unset(BATCH_LIMIT) if before is None else spark.conf.set(BATCH_LIMIT, before)
