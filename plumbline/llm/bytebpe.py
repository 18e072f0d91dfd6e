"""Operator 12: byte-level BPE by backtracking, and decoding.

A text is cut into the matches of the vocabulary's pattern, and each match is encoded alone. Its bytes
are mapped to Latin-1 letters, one each, so that an Aho-Corasick pass over letters finds the longest
token that begins at every byte. Encoding goes from the left with the longest tokens. Two neighbouring
tokens are compatible if merging their bytes anew gives these two again; a sequence of tokens is what
the merges give if and only if each neighbouring pair is compatible, so it is enough to check pairs.
The verdict on a pair is found by undoing the last merges at the border, and remembered. Where no
compatible token fits, the last one is taken back for the next shorter; a byte per position remembers
dead ends, so no position is tried twice and time grows with the length of the match.

The matches of a batch of texts are reduced to the distinct ones, which are encoded once; each Python
worker keeps frequent ones. The ids of the texts are then gathered from them, all at once.

Null text is empty and has no ids; a null doc_id is kept; repeated rows give repeated results; an empty
table gives no rows; other columns are not read by `encode` and kept by `decode`. Bytes that are no
UTF-8 cannot come out of texts, but decoding any ids gives their bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SLICE, Kept, gather, small_batches, text_of

KEPT_MATCHES = 150_000  # in each of two generations
KEPT_PAIRS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from lines of base64 and id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Merges:
    """A vocabulary in which an id is also the rank of the merge that makes the token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.id = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        if any(chr(b) not in self.id for b in range(256)):
            raise ValueError("needs a token for every byte")
        size = max(self.id.values()) + 1
        self.letters = [""] * size
        for letters, token in self.id.items():
            self.letters[token] = letters
        self.length = [len(letters) for letters in self.letters]
        #: when a token comes into being: single bytes before all merges
        self.made = [-1 if len(letters) == 1 else token for token, letters in enumerate(self.letters)]
        self.longest = ahocorasick.Automaton()
        for letters, token in self.id.items():
            self.longest.add_word(letters, token)
        self.longest.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.prefix: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.size = size

    def merge(self, letters: str) -> tuple[list[str], tuple[str, str] | None]:
        """What plain merging leaves of a short run of letters, and the pair merged last."""
        parts, last = list(letters), None
        while len(parts) > 1:
            joined = [self.id.get(a + b, self.size) for a, b in zip(parts, parts[1:])]
            lowest = min(joined)
            if lowest == self.size:
                break
            i = joined.index(lowest)
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def undo(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, or if merging never makes it."""
        if token not in self.halves:
            parts, last = self.merge(self.letters[token])
            self.halves[token] = (self.id[last[0]], self.id[last[1]]) if last and len(parts) == 1 else None
        return self.halves[token]

    def reachable(self, token: int) -> bool:
        return self.made[token] < 0 or self.undo(token) is not None

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives the two again.

        Backwards through the merges that made the two: at each time the border has one token on either
        side, until the later of them came into being. Had their union a lower rank, or the same and
        stood further left, it would have been merged before.
        """
        made, letters = self.made, self.letters
        until, leftmost = self.size, False
        while True:
            union = self.id.get(letters[left] + letters[right])
            if union is not None and (union < until or (union == until and leftmost)):
                return False
            if made[left] < 0 and made[right] < 0:
                return True
            if made[left] > made[right]:
                until, leftmost = made[left], False
                left = self.undo(left)[1]
            else:
                until, leftmost = made[right], True
                right = self.undo(right)[0]

    def fits(self, left: int, right: int) -> bool:
        """Whether `right` may follow `left`, also kept in `pairs`; -1 stands for the beginning."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        known = self.reachable(right) and (left < 0 or self.stays_apart(left, right))
        self.pairs[left * self.size + right] = known
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix, -1 if there is none."""
        known = self.prefix.get(token)
        if known is None:
            letters = self.letters[token]
            known = next((self.id[letters[:n]] for n in range(len(letters) - 1, 0, -1) if letters[:n] in self.id), -1)
            self.prefix[token] = known
        return known

    def encode(self, raw: bytes) -> list[int]:
        """Ids of the bytes of one match."""
        text = raw.decode("latin-1")
        whole = self.id.get(text)
        if whole is not None:
            return [whole]
        n, length, size, pairs = len(text), self.length, self.size, self.pairs
        first = [0] * n
        for end, token in self.longest.iter(text):
            first[end + 1 - length[token]] = token  # of those that begin there, longer ones end later
        dead = bytearray(n + 1)
        tokens, last, at, token = [], -1, 0, first[0]
        while True:
            after = at + length[token]
            if not dead[after]:
                fit = pairs.get(last * size + token)
                if fit or (fit is None and self.fits(last, token)):
                    tokens.append(token)
                    if after == n:
                        return tokens
                    last, at, token = token, after, first[after]
                    continue
            token = self.shorter(token)
            while token < 0:  # nothing fits here after what is before
                dead[at] = 1
                token = tokens.pop()
                at -= length[token]
                last = tokens[-1] if tokens else -1
                token = self.shorter(token)


class Decoder:
    """Bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of each run of ids, the runs given by their n + 1 offsets."""
        joined, ends = gather(self.flat, self.first, self.size, ids)
        bounds = np.concatenate([[0], ends])[offsets].astype("<i4")
        return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(joined)])


class TextEncoder:
    """Ids of texts, by the distinct matches of a pattern."""

    def __init__(self, path: str, pattern: str):
        self.merges = Merges(read_ranks(path))
        self.find = regex.compile(pattern).findall
        self.matches = Kept(lambda match: np.array(self.merges.encode(match.encode()), "<i4").tobytes(), KEPT_MATCHES)

    def encode_all(self, texts: list[str]) -> pa.Array:
        """A list of ids per text."""
        found, n_matches = [], [0]
        for text in texts:
            found += self.find(text)
            n_matches.append(len(found))
        coded = pa.array(found, pa.string()).dictionary_encode()
        known = [self.matches[m] for m in coded.dictionary.to_pylist()]
        n = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, ends = gather(np.frombuffer(b"".join(known), "<i4"), np.cumsum(n) - n, n, coded.indices.to_numpy())
        bounds = np.concatenate([[0], ends])[n_matches]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder per vocabulary and Python worker."""
    return TextEncoder(path, pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    """One decoder per vocabulary file and Python worker."""
    return Decoder(read_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids (an array) of every whole text, by the ranks file at `path` and its pattern.

    If asked for, also `decoded`, the bytes that the ids give, from the same Python worker.
    """
    names = ["doc_id", "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path, pattern)
        for batch in small_batches(batches, SLICE // 4):  # matches are Python strings
            ids = one.encode_all(batch["text"].to_pylist())
            columns = [batch["doc_id"], ids]
            if decoded:
                columns.append(decoder(path).decode_all(ids.values.to_numpy(), ids.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "doc_id bigint, ids array<int>" + ", decoded binary" * decoded
    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(run, kinds)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds the decoded bytes; other columns are kept, null ids give null."""

    @F.arrow_udf("binary")
    def decoded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = decoder(path)
        for part in parts:
            found = []
            for some in small_batches([pa.record_batch([part], names=["ids"])], SLICE):
                lists = some["ids"]
                offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                raw = one.decode_all(lists.flatten().to_numpy(zero_copy_only=False), offsets)
                found.append(pc.if_else(lists.is_valid(), raw, pa.scalar(None, pa.binary())))
            yield pa.concat_arrays(found) if found else pa.array([], pa.binary())

    return encoded.withColumn("decoded", decoded("ids"))
