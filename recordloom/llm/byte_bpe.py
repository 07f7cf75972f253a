"""Byte-level BPE by corpus-level merge replay.

The distinct words of a block of texts are laid out in one array of tokens. An inverted index leads
from the rank of a token pair to all its positions; ranks are taken in ascending order, a merge
is applied to all its positions at once, and only the pairs that touch a merged token are looked
up again. A word is encoded once per block, and frequent words once per task.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from recordloom.llm.blocks import parts

#: Characters of text whose words are merged together, and words a task remembers.
BLOCK_CHARS = 24_000_000
REMEMBERED = 300_000
LONGEST_REMEMBERED = 64
#: Bytes of text a task takes at a time; a worker's memory goes by them and by what it remembers.
PART_BYTES = 8_000_000

_NONE = np.int64(2**62)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, at the place of their ids."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


#: A space beside other white space, and a space that has none on either side.
_BESIDE, _LONE = re.compile(r" \s|\s "), re.compile(r"(?<!\s) (?!\s)")


def _pieces(text: str) -> list[str]:
    """The text cut at its lone spaces; runs of white space of any kinds stay whole inside a piece."""
    return _LONE.split(text) if _BESIDE.search(text) else text.split(" ")


class Codec:
    """Encodes and decodes with the ranks of ``tokens`` and the word pattern ``pattern``."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.tokens = tokens
        self.words = regex.compile(pattern)
        ranks = {token: rank for rank, token in enumerate(tokens)}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.size = len(tokens)
        pairs = {}
        for rank, token in enumerate(tokens):
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], _NONE)
        self.ranks = np.append(np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order], _NONE)
        self.known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers; words are not empty.

        In a vocabulary made by merging, a new pair never ranks below the merge that made it,
        so the ranks can be replayed in order for all words together.
        """
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        token = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(token)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[np.append(0, ends[:-1])] = -1
        rank = np.full(n, _NONE)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self._rank(token[inner], token[inner + 1])
        alive = np.ones(n, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(places: np.ndarray) -> None:
            found = rank[places]
            places, found = places[found < _NONE], found[found < _NONE]
            if not len(places):
                return
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for value, part in zip(found[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                if value in index:
                    index[value].append(part)
                else:
                    index[value] = [part]
                    heapq.heappush(queue, value)

        enter(inner)
        while queue:
            current = heapq.heappop(queue)
            parts = index.pop(current)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[(rank[at] == current) & alive[at]]
            if not len(at):
                continue
            if len(at) > 1:
                chained = before[at[1:]] == at[:-1]
                if chained.any():  # in a run of overlapping pairs every second one, from the left
                    starts = np.flatnonzero(np.append(True, ~chained))
                    run = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
                    at = at[run % 2 == 0]
            gone = after[at]
            follower = after[gone]
            token[at] = current
            after[at] = follower
            held = follower >= 0
            before[follower[held]] = at[held]
            alive[gone] = False
            rank[gone] = _NONE
            rank[at[~held]] = _NONE
            touched = np.concatenate([at[held], before[at]])
            touched = touched[touched >= 0]
            if len(touched):
                touched = np.unique(touched)
                rank[touched] = self._rank(token[touched], token[after[touched]])
                enter(touched)
        left = np.add.reduceat(alive, np.append(0, ends[:-1]), dtype=np.int64)
        ids = token[alive].astype("<u4").tobytes()
        stops = (np.cumsum(left) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, words merged a block of texts at a time."""
        at = 0
        while at < len(texts):
            size, stop = 0, at
            while stop < len(texts) and (size < BLOCK_CHARS or stop == at):
                size += len(texts[stop])
                stop += 1
            yield from self._block(texts[at:stop])
            at = stop

    def _block(self, texts: list[str]) -> Iterator[bytes]:
        """A word of the pattern never reaches over a space without white space beside it, only up to it from the right.

        Texts can thus be cut there, and each distinct piece is matched once.
        """
        known = self.known
        heads: set[str] = set()
        fresh: set[str] = set()
        for text in texts:
            head, *rest = _pieces(text)
            heads.add(head)
            fresh.update([piece for piece in set(rest) if piece not in known])
        of_head = {piece: self.words.findall(piece) for piece in heads}
        of_piece = {piece: self.words.findall(" " + piece) for piece in fresh}
        words = list({word for split in (of_head, of_piece) for found in split.values() for word in found})
        ids = dict(zip(words, self.replay([word.encode() for word in words]), strict=True)) if words else {}
        first = {piece: b"".join([ids[word] for word in found]) for piece, found in of_head.items()}
        for piece, found in of_piece.items():
            known[piece] = b"".join([ids[word] for word in found])
        for text in texts:
            head, *rest = _pieces(text)
            yield first[head] + b"".join([known[piece] for piece in rest])
        for piece in fresh:
            if len(piece) > LONGEST_REMEMBERED:
                del known[piece]
        for piece in list(known)[REMEMBERED:]:  # frequent pieces come early and stay
            del known[piece]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_CODECS: dict[int, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """One codec per worker and broadcast, built where the first task needs it."""
    key = hash((id(shared), pattern))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value, pattern)
    return _CODECS[key]


def _mapped(docs: DataFrame, keep: list[str], text: str, path: str, pattern: str, schema: str, make) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in (part for whole in batches for part in parts(whole, len(keep), PART_BYTES)):
            texts = [x or "" for x in batch.column(len(keep)).to_pylist()]
            made = make(codec, texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made.values()], names=[*keep, *made])

    kinds = dict(docs.dtypes)
    kept = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{kept}, {schema}")


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` (default ``doc_id``), ``n_tokens`` and ``ids`` of every whole text.

    A null text is empty and has no ids; repeated rows are encoded each; other columns are not
    read. ``path`` names a rank file on the driver; it is small and sent to the executors.
    """

    def make(codec: Codec, texts: list[str]) -> dict[str, pa.Array]:
        ids = list(codec.encode_all(texts))
        flat = np.frombuffer(b"".join(ids), dtype="<i4")
        sizes = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
        offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        return {"n_tokens": pa.array(sizes), "ids": pa.ListArray.from_arrays(offsets, pa.array(flat))}

    return _mapped(docs, keep or ["doc_id"], text, path, pattern, "n_tokens bigint, ids array<int>", make)


def decode(encoded: DataFrame, path: str, keep: list[str] | None = None, ids: str = "ids") -> DataFrame:
    """Columns ``keep`` and ``bytes``, what the ids stand for; null ids give no bytes."""
    keep = keep or ["doc_id"]
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            made = [b"".join([tokens[i] for i in x or ()]) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(made, pa.binary())], names=[*keep, "bytes"])

    kinds = dict(encoded.dtypes)
    kept = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return encoded.select(*keep, ids).mapInArrow(run, f"{kept}, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``n_tokens`` and SHA-256 of the ids (little-endian, 32 bits) and of the bytes they decode to."""

    def make(codec: Codec, texts: list[str]) -> dict[str, pa.Array]:
        counts, of_ids, of_bytes = [], [], []
        for ids in codec.encode_all(texts):
            counts.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return {
            "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string())
        }

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, keep or ["doc_id"], text, path, pattern, schema, make)
