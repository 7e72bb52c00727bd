"""The pipeline: each stage on what the one before kept."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import random

import pytest

import corpus_pipeline
from gablework.llm.bpe import codec
from gablework.llm.secret_scan import spans_of


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("lo", "mi", "ra", "tu", "pe") for b in ("ken", "dor", "vas", "li") for c in ("a", "el", "on", "is", "um")]
    texts = [" ".join(rng.choices(words, k=rng.randint(40, 120))) for _ in range(500)]
    toxic = [i % 5 == 0 for i in range(500)]
    for i in range(0, 500, 5):
        t = texts[i].split()
        for _ in range(4):
            t[rng.randrange(len(t))] = rng.choice(["grobble", "snarvik"])
        texts[i] = " ".join(t)
    texts[2] = texts[1]
    texts[4] = texts[3].replace(texts[3].split()[5], "other", 1)
    texts[6] += " password=abcdefghijkl0"
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(x)) for i, x in enumerate(toxic)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scan", "source_mix", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{corpus}/{name}"
        stage(spark, docs, corpus).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.toPandas()
        assert name == "byte_bpe" or docs.columns == columns
    toxic = {i for i in range(0, 500, 5)}
    assert set(seen["toxicity"]["doc_id"]) == set(range(500)) - toxic
    assert set(seen["toxicity"]["doc_id"]) - set(seen["simhash_near_dedup"]["doc_id"]) == {2, 4}
    assert not any(spans_of(t) for t in seen["secret_scan"]["text"]) and "password=[SECRET]" in " ".join(seen["secret_scan"]["text"])
    sizes = seen["secret_scan"]["text"].str.split().str.len()
    assert abs(seen["source_mix"]["text"].str.split().str.len().sum() - 1.5 * sizes.sum()) <= 4
    assert seen["source_mix"]["doc_id"].value_counts().max() <= 2 and seen["byte_bpe"]["whole"].all()
    bpe = codec(__import__("public_tokenizers").path("byte_bpe_multi_50k.tiktoken"))
    assert [len(x) // 4 for x in bpe.encode(list(seen["source_mix"]["text"]))] == list(seen["byte_bpe"]["n_tokens"])


def test_run(spark, corpus):
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, corpus).count() > 400


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
