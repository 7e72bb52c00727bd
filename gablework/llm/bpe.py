"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file becomes a tokenizer by the byte-to-character table of byte-level BPE: every byte is written as one
printable character, and each rank's token is a merge of the two shorter tokens it is made of. Encoding splits a text
before single spaces, where the split pattern always splits, and asks the library only for pieces that aren't in a
bounded cache. Decoding goes from ids to bytes by the table and joins bytes before it reads characters, so
characters that tokens split come back whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablework.llm.common import column_of, small_batches, text_batches, texts_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that a worker keeps, at most.
CACHE_PIECES = 400_000
#: Pieces up to this length stay when the cache is full.
SHORT_PIECE_CHARS = 9
#: Longer pieces aren't kept.
CACHE_PIECE_CHARS = 64

#: A space before one of these might join it in one white-space match, so the text isn't split there.
_ODD = re.compile("[ ](?=[\\s\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff]|$)")


def byte_characters() -> list[str]:
    """The character for each byte: itself where it is printable and no space, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer_of_ranks(ranks: dict[bytes, int]):
    """A tokenizer of the library that merges as the ranks do."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    shown = byte_characters()
    written_as = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                merges.append((rank, cut, written_as[left], written_as[right]))
    merges.sort()
    model = models.BPE(vocab={written_as[t]: r for t, r in ranks.items()}, merges=[(a, b) for _, _, a, b in merges], ignore_merges=True)
    out = Tokenizer(model)
    out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    out.decoder = decoders.ByteLevel()
    return out


def pieces(text: str) -> list[str]:
    """The text in pieces that the split pattern never joins; joined they are the text."""
    if not text:
        return []
    first, *rest = text.split(" ")
    if not _ODD.search(text):
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
    out = [first]
    for x in rest:
        if x and not _ODD.match(" " + x):
            out.append(" " + x)
        else:
            out[-1] += " " + x
    return out if out[0] else out[1:]


#: Bytes that a space joins no white space with: not white space, and not the first byte of any that _ODD knows (some others with them).
_PLAIN = np.ones(256, dtype=bool)
_PLAIN[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = False


#: Kinds of bytes: 1 letters, 2 digits, 3 the apostrophe, 4 other marks; 0 all else. A letter of two bytes from 0xC3 on has its second counted as one.
_KIND = np.zeros(256, dtype=np.uint8)
for _b in range(0x21, 0x7F):
    _KIND[_b] = 1 if chr(_b).isalpha() else 2 if chr(_b).isdigit() else 3 if _b == 0x27 else 4
#: Whether the pattern of byte-level BPE always parts a byte from the next, by kind (five a row): no match holds two kinds, but that an apostrophe takes letters.
_PARTS = np.array([[0, 0, 0, 0, 0], [0, 0, 1, 1, 1], [0, 1, 0, 1, 1], [0, 0, 1, 0, 0], [0, 1, 1, 0, 0]], dtype=bool).ravel()


def cut(texts: list[str], by_kind: bool = False) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The texts' pieces, one text's after the other, and of each text how many; as pieces() has them, or some of those put together. By kind also letters, digits and marks are parted where the pattern parts them."""
    parts = [t.encode() for t in texts]
    data, sizes = np.frombuffer(b"".join(parts), dtype=np.uint8), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes)
    starts = data == 0x20
    starts[:-1] &= _PLAIN.take(data[1:])
    starts[ends[sizes > 0] - 1] = False
    if by_kind and len(data):
        kinds = _KIND.take(data)
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        kinds[second] = (data[second] & 0xDF) != 0x97  # all but the signs of multiplication and division
        starts[1:] |= _PARTS.take(kinds[:-1] * 5 + kinds[1:])
    starts[(ends - sizes)[sizes > 0]] = True
    at = np.flatnonzero(starts)
    column = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)])
    return column.dictionary_encode(), np.diff(np.searchsorted(at, ends), prepend=0)


#: A space and letters that every version of the pattern knows; and how many of those are encoded as one text.
_WORD, JOINED_WORDS = r"\A [A-Za-zÀ-ÖØ-öø-ɏ]+\z", 200


def _taken(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of flat that start and count so, one after the other."""
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    at += np.arange(len(at))
    return flat.take(at)


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer):
        self.tokenizer, self.cache = tokenizer, {}
        #: The pieces that each() knows by number; their ids, one piece's after the other; of each where they start and how many.
        self.known, self.flat = {}, np.zeros(0, dtype="<u4")
        self.starts, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _ids(self, fresh: list[str]) -> Iterator[tuple[str, bytes]]:
        for p, e in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            ids = e.ids
            yield p, struct.pack(f"<{len(ids)}I", *ids)

    def _asked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of the texts, one after the other, and of each text how many."""
        own = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, dtype="<u4"), *own]), np.fromiter(map(len, own), dtype=np.int64, count=len(own))

    def _fresh(self, fresh: list[str], sizes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As each(), of pieces that aren't known: the words among them in texts of many, whose ids are parted where their bytes reach the words' ends."""
        column = pa.array(fresh, type=pa.large_string())
        is_word = np.zeros(len(fresh), dtype=bool) if sizes is None else pc.match_substring_regex(column, _WORD).to_numpy(zero_copy_only=False)
        words = list(compress(fresh, is_word))
        flat, counts = self._asked(list(compress(fresh, ~is_word)))
        if words:
            ids, _ = self._asked(["".join(words[i : i + JOINED_WORDS]) for i in range(0, len(words), JOINED_WORDS)])
            reached = np.cumsum(sizes[ids])
            wanted = np.cumsum(pc.binary_length(column).to_numpy()[is_word])
            ends = np.searchsorted(reached, wanted) + 1
            if not np.array_equal(reached.take(ends - 1, mode="clip"), wanted):
                raise ValueError("the tokenizer joins words that its pattern parts")
            flat, counts = np.concatenate([flat, ids]), np.concatenate([counts, np.diff(ends, prepend=0)])
        order = np.argsort(is_word, kind="stable")
        starts, own = np.empty(len(fresh), dtype=np.int64), np.empty(len(fresh), dtype=np.int64)
        starts[order], own[order] = np.cumsum(counts) - counts, counts
        return flat, starts, own

    def each(self, different: list[str], sizes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces that are all different: an array, and of each piece where its ids start there and how many they are. With the bytes of each id, words are encoded together."""
        if len(self.known) > CACHE_PIECES:  # short pieces are the frequent ones
            kept = {p: n for p, n in self.known.items() if len(p) <= SHORT_PIECE_CHARS}
            at = np.array(list(kept.values()) if len(kept) < CACHE_PIECES // 2 else [], dtype=np.int64)
            self.known = dict(zip(kept, range(len(at)), strict=False))
            self.flat, self.counts = _taken(self.flat, self.starts[at], self.counts[at]), self.counts[at]
            self.starts = np.cumsum(self.counts) - self.counts
        at = np.fromiter(map(self.known.get, different, repeat(-1)), dtype=np.int64, count=len(different))
        new = np.flatnonzero(at < 0)
        fresh = [different[i] for i in new.tolist()]
        flat, starts, counts = self._fresh(fresh, sizes)
        at[new] = len(self.counts) + np.arange(len(new))
        out = np.concatenate([self.flat, flat]), np.concatenate([self.starts, starts + len(self.flat)])[at], np.concatenate([self.counts, counts])[at]
        kept = np.fromiter(map(len, fresh), dtype=np.int64, count=len(fresh)) <= CACHE_PIECE_CHARS
        self.known.update(zip(compress(fresh, kept), range(len(self.counts), len(self.counts) + len(fresh)), strict=False))
        self.flat, self.counts = np.concatenate([self.flat, _taken(flat, starts[kept], counts[kept])]), np.concatenate([self.counts, counts[kept]])
        self.starts = np.cumsum(self.counts) - self.counts
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        parts, cache = [pieces(t) for t in texts], self.cache
        if len(cache) > CACHE_PIECES:  # short pieces are the frequent ones
            kept = {p: ids for p, ids in cache.items() if len(p) <= SHORT_PIECE_CHARS}
            cache.clear()
            if len(kept) < CACHE_PIECES // 2:
                cache.update(kept)
        found = dict(self._ids([p for p in set().union(*parts) if p not in cache]))
        cache.update(found)
        of = cache.__getitem__
        out = [b"".join(map(of, part)) for part in parts]
        for p in found:
            if len(p) > CACHE_PIECE_CHARS:
                del cache[p]
        return out


@dataclass
class ByteBpe:
    """A byte-level BPE: path of a rank file (.tiktoken) or of a tokenizer file (.json). Built once in each worker."""

    path: str
    _made: dict = field(default_factory=dict, repr=False)

    def _tokenizer(self):
        if "t" not in self._made:
            if self.path.endswith(".json"):
                from tokenizers import Tokenizer

                self._made["t"] = Tokenizer.from_file(self.path)
            else:
                self._made["t"] = tokenizer_of_ranks(read_ranks(self.path))
        return self._made["t"]

    def _encoder(self) -> PieceEncoder:
        if "e" not in self._made:
            self._made["e"] = PieceEncoder(self._tokenizer())
        return self._made["e"]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self._encoder().encode(texts)

    def _added(self) -> list[str] | None:
        """The tokens that are found before the text is split; None if the tokenizer splits otherwise than by the pattern of byte-level BPE, or one of these is words alone."""
        if "a" not in self._made:
            from tokenizers import pre_tokenizers

            own = self._tokenizer()
            added = [x.content for x in own.get_added_tokens_decoder().values()]
            usual = own.normalizer is None and isinstance(own.pre_tokenizer, pre_tokenizers.ByteLevel) and own.pre_tokenizer.use_regex and not own.pre_tokenizer.add_prefix_space
            self._made["a"] = added if usual and not any(x.replace(" ", "a").isalpha() for x in added) else None
        return self._made["a"]

    def _sizes(self) -> np.ndarray:
        """The bytes of each id."""
        if "l" not in self._made:
            self._made["l"] = np.array([len(x) for x in self._bytes_by_id()], dtype=np.int64)
        return self._made["l"]

    def cut(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """cut(), by kind unless the tokenizer splits by another pattern or a text holds one of its added tokens."""
        added = self._added()
        return cut(texts, added is not None and not any(a in t for a in added for t in texts))

    def encode_cut(self, held: list[tuple[pa.DictionaryArray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of cut(): the ids of all its texts, one after the other, and of each text how many. A piece is looked up once for all of them, not at each place where it stands."""
        pieces = pa.chunked_array([x for x, _ in held]).unify_dictionaries()
        flat, starts, sizes = self._encoder().each(pieces.chunk(0).dictionary.to_numpy(zero_copy_only=False).tolist(), None if self._added() is None else self._sizes())
        for chunk, (_, counts) in zip(pieces.chunks, held, strict=True):
            at = chunk.indices.to_numpy()
            n = sizes.take(at)
            ends = np.append(0, np.cumsum(n))
            yield _taken(flat, starts.take(at), n), np.diff(ends[np.cumsum(counts)], prepend=0)

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and the (start, end) of each in characters; tokens that share a character both have its place."""
        return [(e.ids, e.offsets) for e in self._tokenizer().encode_batch(texts, add_special_tokens=False)]

    def spans(self, text: str, ids: bytes) -> np.ndarray:
        """(start, end) in characters of each id of a text; ids that hold parts of one character all have its place."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        if not len(data):
            return np.zeros((0, 2), dtype=np.int32)
        own = np.cumsum((data & 0xC0) != 0x80) - 1  # the character that each byte is of
        size = self._sizes()[np.frombuffer(ids, dtype="<u4")]
        end = np.cumsum(size)
        return np.stack([own[end - size], own[end - 1] + 1], axis=1).astype(np.int32)

    def _bytes_by_id(self) -> list[bytes]:
        if "b" not in self._made:
            back = {c: b for b, c in enumerate(byte_characters())}
            vocab = self._tokenizer().get_vocab(with_added_tokens=True)
            table = [b""] * (max(vocab.values()) + 1)
            for token, i in vocab.items():
                table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
            self._made["b"] = table
        return self._made["b"]

    def decode_bytes(self, ids: bytes) -> bytes:
        """The bytes that ids (little-endian unsigned 32-bit integers) stand for."""
        table = self._bytes_by_id()
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])

    def decode(self, ids: bytes) -> str:
        """The text of any run of ids; a character that the run holds only a part of becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids array<int>, whole boolean), one for each row of docs: the ids of the whole text, and whether they decode to its bytes. With offsets, also spans array<struct<start,end>>: the characters that each id stands for.

    A null text counts as empty and has no ids. Null and repeated ids come out as they came in; an empty table gives
    no rows; other columns aren't read. Texts of any length are taken whole.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in text_batches(rows):
            texts = texts_of(batch)
            ids = bpe.encode(texts)
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").view(np.int32))
            counts = [len(x) // 4 for x in ids]
            same = [bpe.decode_bytes(x) == t.encode() for x, t in zip(ids, texts, strict=True)]
            ends = pa.array(np.cumsum([0, *counts]), type=pa.int32())
            columns = [column_of(batch, "doc_id"), pa.array(counts, type=pa.int64()), pa.ListArray.from_arrays(ends, flat), pa.array(same)]
            if offsets:
                at = np.concatenate([bpe.spans(t, x) for x, t in zip(ids, texts, strict=True)] or [np.zeros((0, 2), dtype=np.int32)])
                columns.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], names=["start", "end"])))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids", "whole", *(["spans"] if offsets else [])]
    schema = "doc_id long, n_tokens long, ids array<int>, whole boolean" + (", spans array<struct<start:int,end:int>>" if offsets else "")
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids): the inverse of encoded(); null ids give an empty text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in text_batches(rows):
            texts = [bpe.decode(np.asarray(x or [], dtype="<u4").tobytes()) for x in column_of(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded(), without the ids leaving the worker."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in text_batches(rows):
            ids = bpe.encode(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(batch, "doc_id"),
                    pa.array([len(x) // 4 for x in ids], type=pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(bpe.decode_bytes(x)).hexdigest() for x in ids]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
