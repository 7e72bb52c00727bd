"""The text operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gablework.llm import bpe, mixing, pseudo_likelihood, quality, range_codec, registry, secret_scan, simhash, token_store, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RANKS, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))


def frame(spark, texts, source="s", first=0, sources=None):
    rows = [(first + i, t, "en", sources[i] if sources else source, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls, empty and very long texts, repeats, a null id, and columns that clash with the operators' own."""
    rows = frame(spark, ["a b c d e", None, "", "   \n\t ", LONG, "a b c d e", "ü ñ 中文 \U0001f600 token"])
    more = rows.unionByName(spark.createDataFrame([(0, "a b c d e", "en", None, 9), (None, "no id", None, None, None)], DOCS))
    for name in ("score", "node", "rank", "key", "size", "row", "n", "in_text", "position", "f0", "ids", "tie"):
        more = more.selectExpr("*", f"'x' as {name}")
    return more


def none(spark):
    return spark.createDataFrame([], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


# SimHash


def brute_print(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode())
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, p in prints:
        for b, q in prints:
            if (p ^ q).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i, _ in prints}


def varied(n, seed=3):
    rng, words = random.Random(seed), [f"word{i}" for i in range(400)]
    base = [rng.choices(words, k=rng.randint(60, 300)) for _ in range(n // 4)]
    out = [list(rng.choice(base)) for _ in range(n)]
    for t in out[n // 4 :]:
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice(words).upper()
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("tile", [4096, 4], ids=["inline", "tiled"])
def test_simhash_equals_brute_force(spark, tile):
    texts = [*varied(160), "", None, "one", "One", "x y z"]
    rows = simhash.simhash_groups(frame(spark, texts), simhash.Scheme(tile=tile)).collect()
    prints = [(i, brute_print(t, 4)) for i, t in enumerate(texts)]
    assert {r.doc_id: r.f0 % 2**64 for r in rows} == dict(prints)
    assert {r.doc_id: r.component_id for r in rows} == brute_components(prints)


def test_longer_keys_for_more_nodes(spark):
    sizes = [simhash.EXACT.of_size(n) for n in (10, 10**9, 10**11, 10**14)]
    assert [(s.blocks, s.equal) for s in sizes][0] == (7, 3) and sizes[3].equal > sizes[2].equal > 3
    assert all(s.blocks - s.equal == 4 == s.max_bits for s in sizes)
    texts = varied(120)
    rows = simhash.simhash_groups(frame(spark, texts), sizes[2]).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute_components([(i, brute_print(t, 4)) for i, t in enumerate(texts)])


def test_simhash_awkward(spark):
    rows = simhash.simhash_groups(awkward(spark)).collect()
    of = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and of[1].f0 == of[2].f0 == of[3].f0 == 0 and of[5].component_id == 0
    assert simhash.simhash_groups(none(spark)).count() == 0


def test_kept_documents(spark):
    texts = varied(80)
    exact = [*texts[:20], *texts[:20]]
    kept = simhash.kept_documents(frame(spark, exact))
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert set(ids) <= set(range(20)) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = [" ".join(random.Random(i).choices([f"v{j}" for j in range(5000)], k=120)) for i in range(40)]
    near = [" ".join(["changed", *t.split()[1:]]) for t in clean[:10]]
    left = {r.doc_id for r in simhash.kept_documents(frame(spark, [*clean, *near])).select("doc_id").collect()}
    assert left >= set(range(40)) and len(left & set(range(40, 50))) <= 1
    rows = simhash.kept_documents(awkward(spark))
    assert rows.columns == awkward(spark).columns and rows.where("doc_id is null").count() == 1 and rows.where("doc_id = 0").count() == 1
    assert simhash.kept_documents(none(spark)).count() == 0


# mixing


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in range(400)]
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in texts]
    docs = frame(spark, texts, sources=sources)
    rows = mixing.taken_by_document(docs).toPandas()
    assert len(rows) == 400 and (rows["taken"] <= 2 * rows["size"]).all() and rows["position"].dropna().between(0, 1).all()
    rows["source"] = [sources[i] or "" for i in rows["doc_id"]]
    for _, own in rows.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 1 and own["target"].iloc[0] <= 2 * own["source_size"].iloc[0]
    assert rows.groupby("source")["target"].first().sum() == pytest.approx(1.5 * rows["size"].sum())
    again = mixing.taken_by_document(docs.repartition(7)).toPandas()
    assert rows.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    mixed = mixing.mixed_documents(docs).withColumn("w", mixing.words_of(mixing.F.col("text"))).toPandas()
    assert mixed.groupby(mixed["source"].fillna(""))["w"].sum().to_dict() == rows.groupby("source")["taken"].sum().to_dict()


def test_mix_awkward(spark):
    rows = mixing.taken_by_document(awkward(spark))
    assert rows.count() == 9
    assert mixing.mixed_documents(awkward(spark)).columns == awkward(spark).columns
    assert mixing.taken_by_document(none(spark)).count() == mixing.mixed_documents(none(spark)).count() == 0
    assert mixing.taken_by_document(frame(spark, [None, ""])).agg({"taken": "sum"}).first()[0] == 0


# byte-level BPE


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aab  \n\t'st.,=- 0é中  ᠎\x1c\x85"), st.characters(codec="utf-8")), max_size=80))
def test_bpe_equals_tiktoken(reference, text):
    own = bpe.codec(RANKS)
    (ids,) = own.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text) and own.decode_bytes(ids) == text.encode()


def test_bpe_query_rows(spark, reference):
    docs = awkward(spark)
    rows = bpe.digests(docs, RANKS).collect()
    texts = [r.text or "" for r in docs.select("text").collect()]
    for r, t in zip(rows, texts, strict=True):
        ids = np.array(reference.encode_ordinary(t), dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    encoded = bpe.encoded(docs, RANKS)
    assert [r.text for r in bpe.decoded(encoded, RANKS).collect()] == texts and encoded.where("not whole").count() == 0
    assert bpe.encoded(none(spark), RANKS).count() == bpe.digests(none(spark), RANKS).count() == 0


def test_bpe_split_characters_and_offsets():
    own = bpe.codec(RANKS)
    (ids,) = own.encode(["\U0001f9ff"])
    assert len(ids) > 4 and own.decode(ids) == "\U0001f9ff" and "�" in own.decode(ids[:4])
    ((tokens, offsets),) = own.encode_with_offsets(["ab cd"])
    assert len(tokens) == len(offsets) and offsets[-1][1] == 5


# token store


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 9), max_size=300), st.integers(1, 3))
def test_codec_round_trip(ids, times):
    assert range_codec.unpack(range_codec.pack(np.array(ids * times, dtype=np.int64))).tolist() == ids * times


def test_codec_blocks_and_damage():
    ids = np.random.default_rng(0).zipf(1.4, 3 * range_codec.BLOCK + 17) % 50_000
    packed = range_codec.pack(ids)
    assert (range_codec.unpack(packed) == ids).all() and len(packed) < 2 * len(ids)
    broken = bytearray(packed)
    broken[-40] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        range_codec.unpack(bytes(broken))
    with pytest.raises(ValueError):
        range_codec.unpack(b"XXXX" + packed[4:])
    for beyond in (-1, 2**32):
        with pytest.raises(ValueError):
            range_codec.pack(np.array([beyond]))


def test_store_rows(spark):
    texts = [*varied(30), "", None, LONG]
    rows = token_store.stored_documents(frame(spark, texts), JSON).orderBy("doc_id").collect()
    plain, start = Tokenizer.from_file(JSON), 0
    for r, t in zip(rows, texts, strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_store_awkward(spark, tmp_path):
    rows = token_store.stored_documents(awkward(spark), JSON).collect()
    assert len(rows) == 9 and sorted(r.start for r in rows)[0] == 0 and next(r for r in rows if r.doc_id is None).start == 0
    assert token_store.stored_documents(none(spark), JSON).count() == 0
    path = "file://" + str(tmp_path / "store")
    token_store.write_store(frame(spark, ["a b", "c"]), JSON, path)
    assert [r.ids[-1] for r in token_store.read_ids(spark, path).collect()] == [0, 0]


# secrets


def brute_base(text):
    kinds = {
        "assign": (r"(?a:([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    }
    found = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, (kind, (pattern, ok)) in enumerate(kinds.items()) for m in re.finditer(pattern, text) if ok(m)]
    return ",".join(x for *_, x in sorted(found))


PARTS = ["password", "Token", "API_KEY", "apikey", "ſecret", "toKen", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "x", "\n", "é", "secret=abc", "/+_-."]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30))
def test_base_spans(parts):
    text = "".join(parts)
    assert secret_scan.joined([s for s in secret_scan.spans_of(text) if s.kind != "literal"]) == brute_base(text)


@pytest.mark.parametrize(
    "text, secret",
    [
        ('db_pwd = "Zk8#pQ2!vR7x"', "Zk8#pQ2!vR7x"),
        ('K = "q9X-7bT_4mLpQ2"\nclient_credentials = K', "q9X-7bT_4mLpQ2"),
        ('aws.private_key: "u8T" + "4kW9" + "zQ1mX7"', 'u8T" + "4kW9" + "zQ1mX7'),
        ("auth_key => 'G7h2Kq90sLmZ'", "G7h2Kq90sLmZ"),
    ],
)
def test_lexer_finds(text, secret):
    spans = [s for s in secret_scan.spans_of(text) if s.kind == "literal"]
    assert [text[s.start : s.end] for s in spans] == [secret] and secret not in secret_scan.redacted(text, spans)


@pytest.mark.parametrize("text", ['color = "Zk8#pQ2!vR7x"', "db_pwd = 'changeme-example'", "the key: it was here", "ratio 3:4", 'password = ""', "a" * 50_000 + ":" * 2_000])
def test_lexer_leaves(text):
    assert [s for s in secret_scan.spans_of(text) if s.kind == "literal"] == []


def test_lexer_is_linear():
    import time

    began = time.time()
    assert secret_scan.spans_of("a=" * 100_000) == [] and len(secret_scan.spans_of("password=" * 20_000)) == 1
    assert time.time() - began < 20


def test_scan_rows(spark):
    docs = awkward(spark)
    rows = secret_scan.scanned(docs).collect()
    assert len(rows) == 9 and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if not r.spans)
    clean = secret_scan.redacted_documents(frame(spark, ["é password=abcdefghijkl0 tail", "plain", None])).collect()
    assert clean[0].text == "é password=[SECRET] tail" and clean[0].n_chars == len(clean[0].text) and clean[1].text == "plain" and clean[2].text is None
    assert secret_scan.redacted_documents(docs).columns == docs.columns
    assert secret_scan.scanned(none(spark)).count() == secret_scan.redacted_documents(none(spark)).count() == 0


# toxicity


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=10), min_size=1, max_size=6), st.text("abcd", max_size=12))
def test_automaton_equals_distance(terms, word):
    near = [(d, t) for t in set(terms) if (d := brute_distance(word, t)) <= toxicity.edits_of(t)]
    assert toxicity.LexiconAutomaton(terms).match(word) == min(near, default=None)


def abuse(spark, n=600):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("lo", "mi", "ra", "tu") for b in ("ken", "dor", "vas") for c in ("a", "el", "on", "is")]
    bad = ["grobble", "snarvik", "flozzard"]
    texts, rows = [], []
    for i in range(n):
        t, toxic = rng.choices(words, k=rng.randint(20, 60)), i % 6 == 0
        for _ in range(3 * toxic):
            t[rng.randrange(len(t))] = rng.choice(bad)
        texts.append(" ".join(t))
        rows.append((i, 1, int(toxic)))
    return frame(spark, texts), labels_of(spark, rows)


def test_toxicity_held_out(spark):
    docs, labels = abuse(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.scored(docs, model).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.97
    assert [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]] == got["held_out"].tolist()
    assert model.score("you are a grobbel and a snarvic, grobble snarvik") > model.score("lokena dor") and 0 <= model.score("") < 0.5
    assert model.score("grobble snarvik") > model.score('he said "grobble snarvik" was the word')
    kept = toxicity.clean_documents(docs, model)
    assert kept.count() == got["predicted"].eq(0).sum() and kept.columns == docs.columns


def test_toxicity_awkward(spark):
    blank = toxicity.train(awkward(spark), labels_of(spark, []))
    rows = toxicity.scored(awkward(spark), blank).collect()
    assert len(rows) == 9 and all(r.predicted == 0 for r in rows) and not next(r for r in rows if r.doc_id is None).held_out
    assert toxicity.scored(none(spark), blank).count() == 0


# quality


def test_quality_held_out(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("stone", "river", "light", "garden") for b in ("s", "ing", "ed", "like", "")]
    good = [" ".join(rng.choices(words, k=rng.randint(30, 90))) + "." for _ in range(300)]
    bad = [" ".join(rng.choice(["$$$", "%%%", "&&&"]) + w for w in rng.choices(words, k=rng.randint(30, 90))) for _ in range(150)]
    labels = labels_of(spark, [(i, int(i < 300), 0) for i in range(450)])
    docs = frame(spark, [*good, *bad])
    model = quality.train(docs, labels)
    got = quality.scored(docs, model).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95 and got["score"].between(0, 1).all()
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]] == got["held_out"].tolist()
    again = quality.scored(docs.repartition(5), quality.train(docs.repartition(5), labels)).toPandas()
    assert np.allclose(got.sort_values("doc_id")["score"], again.sort_values("doc_id")["score"])


def test_features_are_compressed_sizes():
    import zstandard

    rng = random.Random(3)
    text = " ".join(rng.choices(["stone", "river", "light", "ü"], k=900))
    model = quality.Model(b"stone river light " * 40, b"$$$ %%% &&& " * 40, None, 0.5, quality.Settings())
    options = {"level": 3, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    data, expected = text.encode(), []
    for size in (1024, 8192):
        g, b = (sum(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **options).compress(data[i : i + size])) for i in range(0, len(data), size)) for d in (model.good, model.bad))
        expected += [(b - g) / (b + g), (b - g) / (len(data) + 16)]
    expected.append(len(zstandard.ZstdCompressor(**options).compress(data)) / (len(data) + 16))
    assert model.features(text) == pytest.approx(expected) and expected[0] > 0


def test_samples_are_bounded_whatever_repeats(spark):
    from gablework.llm.labelled import labelled_sample

    docs = frame(spark, [f"t{i}" for i in range(300)]).unionByName(spark.createDataFrame([(7, f"again{i}", "en", "s", 1) for i in range(200)], DOCS))
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(300)] + [(7, 1, 0)] * 50)
    got = labelled_sample(docs, labels, "quality", mixing.F.lit(True), 100).collect()
    assert 60 <= len(got) <= 100 and len({(r.doc_id, r.y) for r in got}) == len(got)
    assert labelled_sample(docs, labels, "quality", mixing.F.lit(True), 1000).where("doc_id = 7").select("text").collect() == [("again0",)]


def test_quality_awkward(spark):
    model = quality.train(awkward(spark), labels_of(spark, [(0, 1, 0), (1, None, None)]))
    rows = quality.scored(awkward(spark), model).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert quality.scored(none(spark), model).count() == 0


# pseudo-likelihood


def brute_likelihood(model, texts, text):
    """The sum over all tokens of ln p(class) + ln p(word in class), and for words in buckets ln of their share of the bucket."""
    network, vocabulary = model.network, model.vocabulary
    v, n, w = network.values, network.settings.classes, network.settings.window
    counts = Counter(t for x in texts for t in re.findall(r"\w+|[^\w\s]", x.lower()))
    totals = Counter()
    for word, k in counts.items():
        if vocabulary[word] >= vocabulary.first:
            totals[vocabulary[word]] += k
    tokens, total = re.findall(r"\w+|[^\w\s]", text.lower()), 0.0
    ids = [vocabulary[t] for t in tokens]
    for at, (token, target) in enumerate(zip(tokens, ids, strict=True)):
        h = np.zeros(network.settings.width)
        for place, o in enumerate([*range(-w, 0), *range(1, w + 1)]):
            h += v["embed"][ids[at + o] if 0 <= at + o < len(ids) else network.settings.vocabulary] * v["place"][place]
        h = np.tanh(h)
        for z, k in ((h @ v["class"] + v["class_bias"], target // n), (h @ v["word"][target // n] + v["word_bias"][target // n], target % n)):
            total += z[k] - np.log(np.exp(z).sum())
        if target >= vocabulary.first:
            total += np.log(counts[token] / totals[target])
    return len(ids), total


def rare_and_common():
    rng = random.Random(8)
    return [t + " " + " ".join(f"rare{min(int(rng.paretovariate(0.4)), 5000)}" for _ in range(60)) for t in varied(80)] + ["", None]


@pytest.mark.parametrize("lookup", [4_000_000, 10], ids=["looked up", "joined"])
def test_scores_equal_brute_force(spark, lookup):
    texts = rare_and_common()
    docs = frame(spark, texts)
    own = pseudo_likelihood.Settings(classes=8, buckets=8, lookup=lookup)
    model, rows = pseudo_likelihood.learned(docs, own)
    assert (model.shares.table is None) == (lookup > 10) and len(model.vocabulary) == 56
    got = {r.doc_id: r for r in pseudo_likelihood.scored_numbers(rows, model).collect()}
    assert len(got) == 82
    again = {r.doc_id: r.log_likelihood for r in pseudo_likelihood.scored(docs, model).collect()}
    for i in (0, 7, 33, 79, 80):
        n, total = brute_likelihood(model, [t or "" for t in texts], texts[i])
        assert got[i].n_tokens == n and got[i].log_likelihood == pytest.approx(total, rel=1e-4) == again[i]
        if lookup > 10:
            assert pseudo_likelihood.document_score(texts[i], model) == (n, pytest.approx(total, rel=1e-4))


def test_probabilities_of_all_words_sum_to_one(spark):
    texts = rare_and_common()[:20]
    model = pseudo_likelihood.train(frame(spark, texts), pseudo_likelihood.Settings(classes=8, buckets=8))
    words = sorted({t for x in texts for t in x.lower().split()})
    before, after = "word1 word2", "word3 word4"
    total = 0.0
    network, vocabulary, shares = model.network, model.vocabulary, model.shares
    for w in words:
        ids = vocabulary.ids(f"{before} {w} {after}")
        p = network.log_probabilities(network.contexts(ids)[2:3], ids[2:3])[0]
        if ids[2] >= vocabulary.first:
            p += shares.log_counts([w])[0] - shares.totals[ids[2] - vocabulary.first]
        total += np.exp(p)
    used = {vocabulary[w] for w in words}
    ids = vocabulary.ids(f"{before} x {after}")
    unused = sum(np.exp(network.log_probabilities(network.contexts(ids)[2:3], np.array([k], dtype=np.int32))[0]) for k in set(range(64)) - used)
    assert total + unused == pytest.approx(1.0, abs=1e-4)


def test_words_that_stand_twice_are_likelier(spark):
    texts = [f"the cat sat on the {a}{b}" for a in ("mat", "hat", "rug") for b in "abcdefgh"] + [f"the cat sat on the mat{b}" for b in "abcdefgh"]
    model = pseudo_likelihood.train(frame(spark, texts), pseudo_likelihood.Settings(classes=4, buckets=8, warm_docs=5))
    assert model.shares.log_counts(["math", "hatb", "unknown"]).tolist() == pytest.approx([np.log(2), 0, 0])


def test_training_helps_and_reruns_agree(spark):
    docs = frame(spark, [" ".join(["the cat sat on the mat and the dog ran"] * 6)] * 40)
    trained = pseudo_likelihood.train(docs)
    fresh = pseudo_likelihood.Model(trained.vocabulary, pseudo_likelihood.Network.fresh(pseudo_likelihood.Settings()), trained.shares)
    text = "the cat sat on the mat"
    assert pseudo_likelihood.document_score(text, trained)[1] > pseudo_likelihood.document_score(text, fresh)[1]
    a, b = (pseudo_likelihood.corpus_scores(d).first().log_likelihood for d in (docs, docs.coalesce(docs.rdd.getNumPartitions())))
    assert a == b


def test_likelihood_awkward(spark):
    rows = pseudo_likelihood.corpus_scores(awkward(spark)).collect()
    assert len(rows) == 9 and next(r for r in rows if r.doc_id == 1).mean_log_probability is None
    assert pseudo_likelihood.corpus_scores(none(spark)).count() == 0
    assert pseudo_likelihood.scored(none(spark), pseudo_likelihood.train(awkward(spark))).count() == 0


def test_registry_names():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] + ["pipeline"] and set(registry.oracle_sql()) <= set(names)
