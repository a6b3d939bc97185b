"""BPE encoding by a depth-first walk over a trie of distinct words.

A word's encoding is known from the *last token* of each of its prefixes: the encoding of a
prefix ends in the one token that (a) is a suffix of the prefix and (b) may stand after the last
token of what is left of it. "May stand after" is a property of two tokens, found by undoing
merges from the boundary outwards. Distinct words are put in sorted order, which is their trie in
depth-first order: where two neighbours share a prefix, the states on that path are kept and only
the new branch is computed. Words then read their tokens backwards from the states.

Texts are cut at white space first; a memo from chunk to ids, bounded in entries, carries over
between batches of a worker, so that the trie gets only words not met lately.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stevedore.llm.common import slices

_SUFFIX = "</w>"
#: Stands for the end of a word in a path; no byte-level character.
_END = "\n"
#: Latin letters up to U+017F, where lower-casing and NFC act on single characters.
_LATIN = "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "L")
_DIGITS = "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "N")
#: Texts with anything else go through the tokenizer's own normalizer and word splitter.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-ſ‐-‧€]")
_WORD = re.compile(rf"[{_LATIN}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|[^\s{_LATIN}{_DIGITS}]+")
_SPACE = re.compile(r"\s")
_CUT = 1 << 20
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _byte_chars() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class TrieBpe:
    """Encoder for a ``tokenizers`` file of kind BPE with word ends (NFC, one-space, lower case)."""

    def __init__(self, path: str, most_words: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _SUFFIX or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError(f"{path} is no lower-casing BPE with word ends")
        vocab = model["vocab"]
        self.path, self.most_words, self._library = path, most_words, None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(map(tuple, model["merges"])):
            whole = vocab[a + b]
            if whole in self.rank:
                raise ValueError(f"{path}: two merges make one token")
            self.rank[whole], self.parts[whole], self.pair[vocab[a], vocab[b]] = r, (vocab[a], vocab[b]), r
        #: Whether a token's own characters are encoded as that token; whether two tokens may be neighbours.
        self.alone = {t: t not in self.parts or self._may_follow(*self.parts[t], self.rank[t]) for t in vocab.values()}
        self.adjacent: dict[int, bool] = {}
        self.suffixes = ahocorasick.Automaton()
        for t, i in vocab.items():
            t = t.removesuffix(_SUFFIX) + _END if t.endswith(_SUFFIX) else t
            self.suffixes.add_word(t, (i, len(t)))
        self.suffixes.make_automaton()
        self.stand_in = _byte_chars()
        #: The memo, and the one that it followed: what is met again moves on, the rest goes with the next change.
        self.chunks: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def _may_follow(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether BPE leaves ``a b`` as two tokens (until the merge ranked ``before``): undo the later of the two merges beside the
        boundary, again and again; at no time may a merge across it have come first. Of equal ranks,
        the left one is applied first."""
        rank, before = self.rank, len(self.pair) if before is None else before
        while True:
            if self.pair.get((a, b), before) < before:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra > rb:
                before, a = ra, self.parts[a][1]
            elif rb >= 0:
                before, b = rb + 1, self.parts[b][0]
            else:
                return True

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of each distinct word (byte-level characters), in depth-first order of their trie.

        ``token[d]`` and ``length[d]`` are the state of the node at depth ``d`` of the current path; the
        word's end is a node of its own. The automaton lists the tokens that end at each node.
        """
        token, length, before, adjacent = [0], [0], "", self.adjacent
        matches, alone, known, may_follow = self.suffixes.iter, self.alone, self.adjacent.get, self._may_follow
        for word in sorted(set(words)):
            path = word + _END
            shared, most = 0, min(len(before), len(token) - 1)
            while shared < most and path[shared] == before[shared]:
                shared += 1
            del token[shared + 1 :], length[shared + 1 :]
            done = shared
            for end, (t, n) in matches(path):
                if end < done:
                    continue
                if n > end:
                    fits = alone[t]
                elif (fits := known(pair := token[end + 1 - n] << 17 | t)) is None:
                    fits = adjacent[pair] = may_follow(token[end + 1 - n], t)
                if fits:
                    token.append(t)
                    length.append(n)
                    done = end + 1
            at, ids = len(path), []
            if done != at:
                raise ValueError(f"{word!r} has a character without a token")
            while at:
                ids.append(token[at])
                at -= length[at]
            before = path
            yield word, ids[::-1]

    def _spelt(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(map(self.stand_in.__getitem__, word.encode()))

    def _recall(self, chunks: Iterable[str]) -> None:
        known, earlier = self.chunks, self.earlier
        if earlier:
            known.update((c, earlier[c]) for c in chunks if c not in known and c in earlier)

    def _learn(self, words: set[str]) -> None:
        """Put the ids of words into the memo. A word by itself is a chunk of one word."""
        spelt = {self._spelt(w): w for w in words if w not in self.chunks}
        for word, ids in self.encode_words(list(spelt)):
            self.chunks[spelt[word]] = _as_bytes(ids)

    def _library_words(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        plain = self._library.normalizer.normalize_str(text)
        return [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(plain)]

    @staticmethod
    def _pieces(text: str) -> Iterator[str]:
        """Long texts in parts cut at white space, so that their word lists stay small."""
        start = 0
        while len(text) - start > _CUT and (m := _SPACE.search(text, start + _CUT)):
            yield text[start : m.start()]
            start = m.start()
        yield text[start:] if start else text

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; null counts as empty."""
        if len(self.chunks) > self.most_words // 2:
            self.chunks, self.earlier = {}, self.chunks
        if len(self.adjacent) > 2 * self.most_words:
            self.adjacent.clear()
        plain: list[str] = []
        plan: list[list[bytes | int]] = []  # of each text: ids, or the numbers of plain parts
        for text in texts:
            plan.append(row := [])
            for i, part in enumerate(self.split_special.split(text) if text and "<|" in text else [text or ""]):
                if i % 2:
                    row.append(np.array(self.special[part], "<u4").tobytes())
                elif _UNUSUAL.search(part):
                    row.append(self._encode_spelt(self._library_words(part)))
                else:
                    for piece in self._pieces(part):
                        row.append(len(plain))
                        plain.append(piece)
        done: list[bytes] = []
        group: list[str] = []
        size = 0
        for piece in plain:
            if size > 4 * _CUT:
                done += self._encode_plain(group)
                group, size = [], 0
            group.append(piece)
            size += len(piece)
        done += self._encode_plain(group)
        whole = lambda x: x if isinstance(x, bytes) else done[x]
        return [whole(row[0]) if len(row) == 1 else b"".join(map(whole, row)) for row in plan]

    def _encode_plain(self, parts: list[str]) -> list[bytes]:
        """Ids of parts without unusual characters. Each distinct chunk is looked up once; the ids of all are then
        gathered by arrays."""
        blobs = [part.lower().replace("\x85", " ").replace("\xa0", " ").encode() for part in parts]
        raw = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
        inside = ~_IS_SPACE[raw]
        starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
        letters = raw[inside]
        offsets = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, len(letters)).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        chunks, code = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(zero_copy_only=False)
        self._recall(chunks)
        known = self.chunks
        if missing := {c: _WORD.findall(c) for c in chunks if c not in known}:
            each = {w for ws in missing.values() for w in ws}
            self._recall(each)
            self._learn(each)
            for chunk, ws in missing.items():
                if chunk not in known:
                    known[chunk] = b"".join([known[w] for w in ws])
        found = [known[c] for c in chunks]
        ids, lengths = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, n = np.cumsum(lengths) - lengths, lengths[code]
        ends = np.cumsum(n)
        gathered = ids[np.repeat(first[code] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        # Where each part's words begin among all words, and its ids among all ids.
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) + 1
        word = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
        at = (4 * np.concatenate(([0], ends))[word]).tolist()
        return [gathered[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _encode_spelt(self, words: list[str]) -> bytes:
        """Ids of words in byte-level characters, as the library's splitter gives them."""
        ids = {w: _as_bytes(x) for w, x in self.encode_words(words)}
        return b"".join(map(ids.__getitem__, words))

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens joined by one space."""
        return " ".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=1)
def encoder(path: str) -> TrieBpe:
    """One encoder for each worker process and file."""
    return TrieBpe(path)


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)])


def encode_decode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Append each row's token ids and the text they decode to.

    Null texts count as empty: no ids, an empty text. Rows keep their other columns and order within
    a partition; no shuffle. Repeated rows are encoded alike. A column already named as one of the
    outputs raises ValueError: pass other names.
    """
    if clash := {ids.lower(), decoded.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} exist; name the outputs otherwise")
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in slices(batches, text):
            blobs = bpe.encode_batch(batch.column(text).to_pylist())
            lists = [np.frombuffer(b, "<u4").astype(np.int32) for b in blobs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32())), pa.array([bpe.decode(x.tolist()) for x in lists])], names=[*batch.schema.names, ids, decoded])

    return docs.mapInArrow(run, schema)


def encode_digest(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``encode_decode``.

    The digests are taken inside the task: ids and decoded texts of a corpus are several times its
    size and needn't leave the worker.
    """
    from hashlib import sha256

    schema = T.StructType([docs.schema[doc_id], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, digits = encoder(path), [str(i) for i in range(1 << 16)]
        for batch in slices(batches, text):
            n, a, b = [], [], []
            for blob in bpe.encode_batch(batch.column(text).to_pylist()):
                ids = np.frombuffer(blob, "<u4").tolist()
                n.append(len(ids))
                a.append(sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                b.append(sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[doc_id, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(doc_id, text).mapInArrow(run, schema)
