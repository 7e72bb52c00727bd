"""The whole pipeline against plain Python, DuckDB and the rank library."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import base64
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import public_tokenizers
import tiktoken

import corpus_pipeline
from gablework.llm import mixing, toxicity
from gablework.llm.secret_scan import redacted, spans_of

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("lo", "mi", "ra", "tu", "pe") for b in ("ken", "dor", "vas", "li") for c in ("a", "el", "on", "is", "um")]
    texts = [" ".join(rng.choices(words, k=rng.randint(30, 90))) for _ in range(300)]
    for i in range(0, 300, 6):
        t = texts[i].split()
        for _ in range(4):
            t[rng.randrange(len(t))] = rng.choice(["grobble", "snarvik", "grobbla"])
        texts[i] = " ".join(t)
    for i in range(1, 300, 6):  # copies near and exact, chains of them too
        t = texts[i].split()
        t[rng.randrange(len(t))] = "other"
        texts[i + 1] = " ".join(t)
        t[rng.randrange(len(t))] = "another"
        texts[i + 2] = " ".join(t) if i % 12 == 1 else texts[i]
    texts[5], texts[11], texts[17] = "", None, "key: AKIA" + "Q" * 18 + ' db_pwd = "Zk8#pQ2!vR7x" ' + texts[23]
    return [(i, t, "en", rng.choice(["a", "a", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]


def jaccard_keeps(rows):
    """Ids that stay: the smallest of each component of shingle sets at 0.8 or more."""
    def shingles(text):
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
        return frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if sets[i] == sets[j] or union and 5 * len(sets[i] & sets[j]) >= 4 * union:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i]


def test_run_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(r[0], 1, int(r[0] % 6 == 0)) for r in rows], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    model = toxicity.train(spark.createDataFrame(rows, DOCS), labels)
    clean = [r for r in rows if model.score(r[1] or "") < 0.7]
    assert 45 <= len(rows) - len(clean) <= 52
    kept = [(i, t and redacted(t, spans_of(t)), lang, source, n) for i, t, lang, source, n in jaccard_keeps(clean)]
    assert len(kept) < len(clean) - 60 and "AKIA" not in str(kept) and "vR7x" not in str(kept)
    documents = pd.DataFrame(kept, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841  DuckDB reads it by its name
    taken = duckdb.sql(mixing.MIX_SQL).fetchdf().set_index("doc_id")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for i, text, *_ in kept:
        size, words = int(taken.loc[i, "size"]), int(taken.loc[i, "taken"])
        parts = [text or ""] * (words // size if size else 1)
        if size and words % size:
            parts.append("".join(re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+", text)[: words % size]))
        expected.update((i, *library.encode_ordinary(p)) for p in parts)
    assert Counter((int(i), *map(int, ids)) for i, ids in zip(got["doc_id"], got["ids"], strict=True)) == expected
    assert got["whole"].all() and (got["n_tokens"] == got["ids"].map(len)).all()
