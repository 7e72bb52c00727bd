"""What misspellings of a toxic term are worth."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from gablework.llm import toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def learned(spark, toxic_every):
    rng, docs, labels = random.Random(7), [], []
    words = [f"{a}{b}{c}" for a in ("lo", "mi", "ra", "tu") for b in ("ken", "dor", "vas") for c in ("a", "el", "on", "is")]
    for i in range(600):
        t, toxic = rng.choices(words, k=30), i % toxic_every == 0
        if toxic:
            t[3], t[9] = "grobble", "snarvik"
        elif i % 4 == 1:
            t[5] = "grabble"  # one edit from a term
        text = " ".join(t)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(toxic)))
    return toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_one_innocent_neighbour_turns_off_only_itself(spark):
    model = learned(spark, 6)
    assert model.innocent == {"grabble"} and model.evidence(model.hits("a grabble stood")) == 0
    assert model.evidence(model.hits("a grobbla stood")) > 0 and model.evidence(model.hits("a grobble stood")) > model.evidence(model.hits("a grobbla stood"))


def test_unseen_misspellings_count_in_a_balanced_sample(spark):
    model = learned(spark, 2)
    exact, near = model.terms["snarvik"]
    assert near == toxicity.Settings().near * exact > 0 and model.evidence(model.hits("a snarvix stood")) > 0
