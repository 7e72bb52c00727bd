"""Documents scored by masked pseudo-likelihood under a bidirectional window network.

All words are counted over all documents. The network knows the commonest, and buckets by ending for the rest. It adds up
the embeddings of the words on either side, each scaled by its place, and predicts the masked word in two steps, its
class and the word in it; a rarer word is then drawn from its bucket by its count in the corpus, so the probabilities of
all words of the corpus sum to one. It is trained in numpy: a warm start on a bounded sample, then every partition
trains on its own documents from there, every position masked in turn, and the partitions' parameters are
averaged by what they saw. A document's score is the sum of the log-probabilities of all its tokens, each given its
neighbours.

Documents become numbers in the pass that trains, and are scored from those. The counts of rarer words are looked up in
an array where they are few enough to be sent to every worker, else joined.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablework.llm.common import batches, column_of, small_batches, text_batches, texts_of, written

_TOKEN = re.compile(r"\w+|[^\w\s]")
#: Tokens that a worker holds, four bytes each, before it gives the counts of their words, and before it looks their words up.
_COUNTED, _HELD = 8_000_000, 2_000_000


@dataclass(frozen=True)
class Settings:
    """classes: of the vocabulary, as many words in each. buckets: of the vocabulary, for rarer words by ending. window: words to either side. width: of an embedding. masked: share of the positions that a pass trains on. rate: of learning. batch: positions of a step. warm_docs: documents of the warm start, at most. lookup: rarer words that stand more than once whose counts are sent to every worker, at most; beyond, counts are joined. spread: decimals (binary) that averages keep, so that their order doesn't matter."""

    classes: int = 32
    buckets: int = 96
    window: int = 2
    width: int = 16
    masked: float = 1.0
    rate: float = 0.15
    batch: int = 4096
    warm_docs: int = 400
    warm_passes: int = 4
    lookup: int = 4_000_000
    spread: int = 24
    seed: int = 11

    @property
    def vocabulary(self) -> int:
        return self.classes * self.classes


class Endings(dict):
    """The bucket of each ending; made when it is first asked for."""

    def __init__(self, first: int, buckets: int):
        self.first, self.buckets = first, buckets

    def __missing__(self, ending: str) -> int:
        if len(self) > 100_000:
            self.clear()
        at = self[ending] = self.first + zlib.crc32(ending.encode("utf-8", "surrogatepass")) % self.buckets
        return at


class Vocabulary(dict):
    """The id of each word; of an unknown one, its ending's bucket."""

    def __init__(self, words: list[str], settings: Settings):
        super().__init__({w: i for i, w in enumerate(words)})
        self.first, self.buckets = settings.vocabulary - settings.buckets, settings.buckets
        self.endings = Endings(self.first, self.buckets)

    def __missing__(self, word: str) -> int:
        return self.endings[word[-2:]]

    def __reduce__(self):
        return _vocabulary, (list(self), self.first, self.buckets)

    def ids(self, text: str) -> np.ndarray:
        return self.numbered(text)[0]

    def numbered(self, text: str) -> tuple[np.ndarray, list[str]]:
        """The id of each token, and the tokens that stand in buckets, in order."""
        tokens = _TOKEN.findall(text.lower())
        ids = np.fromiter(map(self.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        return ids, [tokens[i] for i in np.flatnonzero(ids >= self.first).tolist()]


def _vocabulary(words: list[str], first: int, buckets: int) -> Vocabulary:
    out = Vocabulary.__new__(Vocabulary)
    dict.__init__(out, {w: i for i, w in enumerate(words)})
    out.first, out.buckets, out.endings = first, buckets, Endings(first, buckets)
    return out


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point: 0 white space, 1 of a word, 2 a token by itself, as _TOKEN has them."""
    return np.fromiter((0 if c.isspace() else 1 if c.isalnum() or c == "_" else 2 for c in map(chr, range(sys.maxunicode + 1))), dtype=np.uint8, count=sys.maxunicode + 1)


def _tokens(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """What _TOKEN finds in the lower-cased texts, one after the other, and of each text how many tokens."""
    low = [t.lower() for t in texts]
    chars = np.frombuffer("\n".join(low).encode("utf-32-le"), dtype="<u4")
    kinds = _kinds().take(chars)
    starts = kinds == 1
    starts[1:] &= kinds[:-1] != 1
    at = np.flatnonzero(starts | (kinds == 2))
    counts = np.diff(np.searchsorted(at, np.cumsum([len(x) + 1 for x in low])), prepend=0)
    shown = kinds > 0  # without white space the tokens' bytes adjoin, as an Arrow column has them
    widths = shown.astype(np.int8)
    for first in (0x80, 0x800, 0x10000):
        widths += shown & (chars >= first)
    ends = np.cumsum(widths, dtype=np.int64)
    offsets = np.append(ends[at] - widths[at], ends[-1:] if len(ends) else 0)
    data = chars[shown].tobytes().decode("utf-32-le").encode()
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode(), counts


def count_words(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows (word, n) over all documents."""

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(held: list[pa.DictionaryArray]) -> Iterator[pa.RecordBatch]:
            tokens = pa.chunked_array(held).unify_dictionaries()
            words = tokens.chunk(0).dictionary.cast(pa.string())
            counts = sum(np.bincount(x.indices, minlength=len(words)) for x in tokens.chunks)
            yield from pa.table({"word": words, "n": counts}).to_batches(100_000)

        held, size = [], 0
        for batch in text_batches(rows):
            held.append(_tokens(texts_of(batch))[0])
            size += len(held[-1])
            if size > _COUNTED:
                yield from given(held)
                held, size = [], 0
        if held:
            yield from given(held)

    return docs.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Network:
    """The parameters: embeddings (the last row is the text's edge), a scale for each place of the window, classes, words in their classes."""

    settings: Settings
    values: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(settings: Settings) -> Network:
        s, rng = settings, np.random.default_rng(settings.seed)
        normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, dtype=np.float32)
        return Network(s, {"embed": normal(s.vocabulary + 1, s.width), "place": np.ones((2 * s.window, s.width), dtype=np.float32), "class": normal(s.width, s.classes), "class_bias": zero(s.classes), "word": normal(s.classes, s.width, s.classes), "word_bias": zero(s.classes, s.classes)})

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.values.values()])

    def filled(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for name, v in self.values.items():
            out[name] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return Network(self.settings, out)

    def contexts(self, ids: np.ndarray) -> np.ndarray:
        """For each position the ids of its neighbours, left to right; of the edge beyond the text."""
        w, edge = self.settings.window, self.settings.vocabulary
        padded = np.concatenate([np.full(w, edge, np.int32), ids, np.full(w, edge, np.int32)])
        return np.stack([padded[o : o + len(ids)] for o in (*range(w), *range(w + 1, 2 * w + 1))]).T

    def _hidden(self, contexts: np.ndarray) -> np.ndarray:
        """The hidden values of each position, and a last column of ones, which meets the biases."""
        v = self.values
        h = np.take(v["embed"] * v["place"][0], contexts[:, 0], axis=0)
        for o in range(1, contexts.shape[1]):
            h += np.take(v["embed"] * v["place"][o], contexts[:, o], axis=0)
        out = np.ones((len(h), h.shape[1] + 1), dtype=h.dtype)
        np.tanh(h, out=out[:, :-1])
        return out

    def _weights(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights with their biases as the last row, of the classes and of the words; whether no logit can pass 60, as a hidden value is 1 at most."""
        v = self.values
        of, within = np.vstack([v["class"], v["class_bias"]]), np.concatenate([v["word"], v["word_bias"][:, None]], axis=1)
        return of, within, max(np.abs(of).sum(axis=0).max(), np.abs(within).sum(axis=1).max()) < 60

    @staticmethod
    def _sorted(contexts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of the positions by id, and both in it."""
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        return order, np.take(contexts.T, order, axis=1).T, ids[order]

    def _logits(self, h: np.ndarray, of: np.ndarray, weights: tuple[np.ndarray, np.ndarray, bool]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """Of positions in the order of their classes: logits of the classes, of the words in the own class, and where each class stands. Each row is less its maximum where it might overflow."""
        n, (classes, words, small) = self.settings.classes, weights
        ends = np.searchsorted(of, np.arange(n + 1))
        at = [(k, slice(ends[k], ends[k + 1])) for k in range(n) if ends[k] < ends[k + 1]]
        z = h @ classes
        y = np.empty_like(z)
        for k, rows in at:
            np.matmul(h[rows], words[k], out=y[rows])
        if not small:
            z -= z.max(axis=1, keepdims=True)
            y -= y.max(axis=1, keepdims=True)
        return z, y, at

    def log_probabilities(self, contexts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """ln p(id | its neighbours) of each position."""
        order, contexts, ids = self._sorted(contexts, ids)
        of, within = np.divmod(ids, self.settings.classes)
        z, y, _ = self._logits(self._hidden(contexts), of, self._weights())
        out = np.empty(len(ids))
        out[order] = self._chosen(z, of).astype(np.float64) + self._chosen(y, within)
        return out

    @staticmethod
    def _chosen(z: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The log-softmax of each row at its own column."""
        own = z[np.arange(len(z)), at]
        return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], dtype=z.dtype))

    @staticmethod
    def _errors(z: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The softmax of each row, less one at its own column, over the number of rows."""
        np.exp(z, out=z)
        z *= (1 / (len(z) * (z @ np.ones(z.shape[1], dtype=z.dtype))))[:, None]
        z[np.arange(len(z)), at] -= 1 / len(z)
        return z

    def learn(self, contexts: np.ndarray, ids: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        """One Adagrad step on the positions."""
        v, s = self.values, self.settings
        _, contexts, ids = self._sorted(contexts, ids)
        of, within = np.divmod(ids, s.classes)
        h, weights = self._hidden(contexts), self._weights()
        z, y, at = self._logits(h, of, weights)
        d, e = self._errors(z, of), self._errors(y, within)
        classes = h.T @ d
        words = np.zeros_like(weights[1])
        back = d @ v["class"].T
        for k, rows in at:
            np.matmul(h[rows].T, e[rows], out=words[k])
            back[rows] += e[rows] @ v["word"][k].T
        back *= 1 - h[:, :-1] ** 2
        # the sum of back over the positions at which each word stands in each place, from which both gradients follow
        sums = np.empty((contexts.shape[1], s.width, s.vocabulary + 1), dtype=back.dtype)
        columns = np.ascontiguousarray(back.T)
        for o, place in enumerate(contexts.T.astype(np.intp)):
            for c, column in enumerate(columns):
                sums[o, c] = np.bincount(place, weights=column, minlength=s.vocabulary + 1)
        grads = {"class": classes[:-1], "class_bias": classes[-1], "word": words[:, :-1], "word_bias": words[:, -1]}
        grads |= {"place": np.einsum("ocv,vc->oc", sums, v["embed"]), "embed": np.einsum("ocv,oc->vc", sums, v["place"])}
        for name, g in grads.items():
            squares[name] += g * g
            v[name] -= s.rate * g / (np.sqrt(squares[name]) + 1e-6)

    def train(self, texts_ids: Iterator[np.ndarray], rng: np.random.Generator) -> int:
        """Learns from a share of each text's positions; the number of positions learned from."""
        trainer = Trainer(self, rng)
        for ids in texts_ids:
            trainer.feed(ids)
        return trainer.finish()


class Trainer:
    """Steps of a network on texts that come one by one."""

    def __init__(self, network: Network, rng: np.random.Generator):
        self.network, self.rng = network, rng
        self.squares = {k: np.full_like(v, 1e-6) for k, v in network.values.items()}
        self.contexts, self.targets, self.held, self.seen = [], [], 0, 0

    def feed(self, ids: np.ndarray) -> None:
        s = self.network.settings
        contexts = self.network.contexts(ids)
        if s.masked < 1:
            at = np.flatnonzero(self.rng.random(len(ids)) < s.masked)
            contexts, ids = contexts[at], ids[at]
        if len(ids):
            self.contexts.append(contexts.T)
            self.targets.append(ids)
            self.held += len(ids)
        if self.held >= s.batch:
            self._learn()

    def _learn(self) -> None:
        c, t, batch = np.concatenate(self.contexts, axis=1).T, np.concatenate(self.targets), self.network.settings.batch
        for i in range(0, self.held, batch):
            self.network.learn(c[i : i + batch], t[i : i + batch], self.squares)
        self.seen, self.contexts, self.targets, self.held = self.seen + self.held, [], [], 0

    def finish(self) -> int:
        if self.held:
            self._learn()
        return self.seen


@dataclass
class Shares:
    """What tells a bucket's words apart. totals: ln of each bucket's tokens. hashes (ascending), logs: ln of the count of each word that stands more than once; every other counts once. None where they are too many to hold: then table has them as rows (h, n)."""

    totals: np.ndarray
    hashes: np.ndarray | None
    logs: np.ndarray | None
    table: DataFrame | None = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def log_counts(self, words: list[str]) -> np.ndarray:
        """ln of each word's count in the corpus; 0 of a word that it doesn't have."""
        h = hashes_of(words)
        if not len(self.hashes):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.logs[at], 0.0)


def hashes_of(words: list[str]) -> np.ndarray:
    """As xxhash64() of Spark SQL."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), dtype=np.uint64, count=len(words)).view(np.int64)


def _looked_up(held: list[tuple[pa.DictionaryArray, np.ndarray]], vocabulary: Vocabulary, shares: Shares) -> Iterator[tuple[list[np.ndarray], list[float], list[np.ndarray | None]]]:
    """For each of _tokens(): of each text the ids of its tokens, the sum of its rarer words' ln counts, and their hashes where the counts aren't held. A word is looked up once for all of them, not at each place where it stands."""
    tokens = pa.chunked_array([x for x, _ in held]).unify_dictionaries()
    words, known = tokens.chunk(0).dictionary.to_numpy(zero_copy_only=False).tolist(), shares.hashes is not None
    ids = np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int32, count=len(words))
    rare = np.flatnonzero(ids >= vocabulary.first)
    rare_words, values = [words[i] for i in rare.tolist()], np.zeros(len(ids), dtype=np.float64 if known else np.int64)
    values[rare] = shares.log_counts(rare_words) if known else hashes_of(rare_words)
    for chunk, (_, counts) in zip(tokens.chunks, held, strict=True):
        places = chunk.indices.to_numpy()
        each = [places[e - n : e] for e, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True)]
        numbers = [ids[x] for x in each]
        if known:
            yield numbers, [float(values[x].sum()) for x in each], [None] * len(each)
        else:
            yield numbers, [0.0] * len(each), [values[x[i >= vocabulary.first]] for x, i in zip(each, numbers, strict=True)]


@dataclass
class Model:
    vocabulary: Vocabulary
    network: Network
    shares: Shares


def _shares(counts: DataFrame, vocabulary: Vocabulary, settings: Settings) -> Shares:
    """counts: rows (word, n) of all words."""
    spark = counts.sparkSession
    known = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    rare = counts.join(F.broadcast(known), "word", "left_anti")
    bucket = F.pmod(F.crc32(F.encode(F.right("word", F.lit(2)), "utf-8")), F.lit(settings.buckets)).cast("int")
    totals = np.zeros(settings.buckets)
    for r in rare.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect():
        totals[r["bucket"]] = np.log(r["n"])
    often = written(rare.where("n > 1").groupBy(F.xxhash64("word").alias("h")).agg(F.sum("n").alias("n")), "often")
    if often.count() > settings.lookup:
        return Shares(totals, None, None, often)
    rows = often.toArrow()
    h, n = rows["h"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(h)
    return Shares(totals, h[order], np.log(n[order]).astype(np.float32))


#: Rows of a numbered document (kind 0) and of a partition's learned parameters (kind 1).
_NUMBERED = "kind int, doc_id long, part int, seq long, ids binary, log_counts double, rare array<long>, at long, value long"


def _rows(kind: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"kind": pa.int32(), "doc_id": pa.int64(), "part": pa.int32(), "seq": pa.int64(), "ids": pa.binary(), "log_counts": pa.float64(), "rare": pa.list_(pa.int64()), "at": pa.int64(), "value": pa.int64()}
    columns |= {"kind": np.full(n, kind, dtype=np.int32)}
    return pa.RecordBatch.from_arrays([pa.array(columns[k], type=t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))


def _numbered(vocabulary: Vocabulary, shares: Shares, trained: Network | None, scale: float, seed: int):
    """Documents as ids; with a network, also what it learns from them, as whole numbers times the positions seen."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        own = trained and trained.filled(trained.flat())
        trainer = own and Trainer(own, np.random.default_rng(seed))

        def numbered(doc_ids: list[pa.Array], held: list) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            for own_ids, (ids, logs, rare) in zip(doc_ids, _looked_up(held, vocabulary, shares), strict=True):
                for x in ids if trainer else ():
                    trainer.feed(x)
                n = len(ids)
                yield _rows(0, doc_id=own_ids, part=np.full(n, part, dtype=np.int32), seq=np.arange(seq, seq + n), ids=[x.astype("<u2").tobytes() for x in ids], log_counts=logs, rare=rare)
                seq += n

        doc_ids, held, size = [], [], 0
        for batch in text_batches(parts):
            tokens = _tokens(texts_of(batch))
            doc_ids.append(column_of(batch, "doc_id"))
            held.append(tokens)
            size += len(tokens[0])
            if size > _HELD:
                yield from numbered(doc_ids, held)
                doc_ids, held, size = [], [], 0
        if held:
            yield from numbered(doc_ids, held)
        if trainer and (seen := trainer.finish()):
            moved = np.round((own.flat() - trained.flat()).astype(np.float64) * scale).astype(np.int64)
            yield _rows(1, at=np.arange(len(moved) + 1), value=np.append(moved * seen, seen))

    return run


def _ids_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def learned(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of all documents, and the documents as numbers, as scored_numbers() takes them."""
    s = settings
    docs = _ids_of(docs, id_col, text_col)
    counts = written(count_words(docs, s), "words")
    words = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(s.vocabulary - s.buckets).collect()]
    vocabulary, network = Vocabulary(words, s), Network.fresh(s)
    shares = _shares(counts, vocabulary, s)
    n = docs.count()
    mark = F.pmod(F.xxhash64("doc_id", F.lit("warm")), F.lit(1_000_000))
    picked = docs.where("doc_id is not null").withColumn("mark", mark).where(F.col("mark") < int(1_000_000 * min(1.0, 2 * s.warm_docs / max(1, n))))
    warm = [vocabulary.ids(r["text"] or "") for r in picked.orderBy("mark", "doc_id", "text").limit(s.warm_docs).toLocalIterator()]
    rng = np.random.default_rng(s.seed)
    for _ in range(s.warm_passes):
        network.train(iter(warm), rng)
    start, scale = network.flat(), float(1 << s.spread)
    rows = written(docs.mapInArrow(_numbered(vocabulary, shares, network, scale, s.seed), _NUMBERED), "numbered")
    total = rows.where("kind = 1").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).select("at", F.col("value").cast("double").alias("value"))
    sums = np.zeros(len(start) + 1)
    for r in total.collect():
        sums[r["at"]] = r["value"]
    if sums[-1]:
        network = network.filled(start + sums[:-1] / sums[-1] / scale)
    return Model(vocabulary, network, shares), rows.where("kind = 0")


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of all documents."""
    return learned(docs, settings)[0]


#: Positions that are scored at once; bounds memory.
_SCORED = 20_000


def _network_sums(model: Model, texts: list[np.ndarray]) -> list[float]:
    """Of each text the sum of its tokens' log-probabilities, those in buckets as if each bucket were one word of its total."""
    network, first = model.network, model.vocabulary.first
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    sums, at, i = [0.0] * len(texts), 0, 0
    while i < len(texts):  # texts are put together up to so many positions; a longer one is cut, not its neighbours
        j, size = i, 0
        while j < len(texts) and (size == 0 or size + lengths[j] <= _SCORED):
            size += lengths[j]
            j += 1
        if size:
            ids, contexts = np.concatenate(texts[i:j]), np.concatenate([network.contexts(x) for x in texts[i:j]])
            values = np.concatenate([network.log_probabilities(contexts[k : k + _SCORED], ids[k : k + _SCORED]) for k in range(0, size, _SCORED)])
            rare = np.flatnonzero(ids >= first)
            values[rare] -= model.shares.totals[ids[rare] - first]
            ends = np.cumsum(lengths[i:j])
            sums[i:j] = [float(values[e - n : e].sum()) for e, n in zip(ends, lengths[i:j], strict=True)]
        i = j
    return sums


def document_score(text: str, model: Model) -> tuple[int, float]:
    """Tokens of a whole text and the sum of their log-probabilities, each given its neighbours; of a model whose counts are held."""
    ids, rare = model.vocabulary.numbered(text)
    return len(ids), _network_sums(model, [ids])[0] + float(model.shares.log_counts(rare).sum()) if len(ids) else 0.0


def scored_numbers(rows: DataFrame, model: Model) -> DataFrame:
    """The scores of numbered documents."""
    if model.shares.table is not None:
        each = rows.select("part", "seq", F.explode("rare").alias("h")).groupBy("part", "seq", "h").agg(F.count("*").alias("times"))
        found = each.join(model.shares.table.hint("merge"), "h").groupBy("part", "seq").agg(F.sum(F.col("times") * F.log("n")).alias("found"))
        found = written(found, "log-counts")
        rows = rows.drop("log_counts").join(found.hint("merge"), ["part", "seq"], "left").withColumn("log_counts", F.coalesce("found", F.lit(0.0)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            for start in range(0, batch.num_rows, 512):
                piece = batch.slice(start, 512)
                texts = [np.frombuffer(x, dtype="<u2").astype(np.int32) for x in column_of(piece, "ids").to_pylist()]
                sums = np.array(_network_sums(model, texts)) + column_of(piece, "log_counts").to_numpy()
                counts = np.array([len(x) for x in texts], dtype=np.int64)
                sums = np.where(counts > 0, sums, 0.0)
                means = [float(v / n) if n else None for v, n in zip(sums, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([column_of(piece, "doc_id"), pa.array(counts), pa.array(sums), pa.array(means, type=pa.float64())], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_probability"])

    return rows.select("doc_id", "ids", "log_counts").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_probability double")


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, log_likelihood, mean_log_probability), one for each row of docs.

    Of the whole text; a text of no tokens (null or empty) has the sum 0 and no mean. A word that the model's corpus
    doesn't have counts as one that stands there once. Null and repeated ids come out as they came in; an empty table
    gives no rows; other columns aren't read.
    """
    rows = _ids_of(docs, id_col, text_col).mapInArrow(_numbered(model.vocabulary, model.shares, None, 1.0, 0), _NUMBERED)
    return scored_numbers(written(rows, "numbered"), model)


def corpus_scores(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """scored() of the documents by the model that they make: each text is read twice, to count words and to number them."""
    model, rows = learned(docs, settings)
    return scored_numbers(rows, model)
