"""Operator 8: SentencePiece BPE by backtracking, and decoding.

A text is cut where no merge can cross: before a space that follows something else, and between two
characters that no piece holds side by side. A part is encoded from the left with the longest pieces, found by one
Aho-Corasick pass. Two neighbouring pieces are accepted if merging them anew would not choose another
pair across their border; this is found by undoing their merges from the last one backwards. Where no
piece fits, the last one is taken back for a shorter, and a bit per position remembers dead ends, so
no position is tried twice. Each distinct word of a batch is encoded once, and frequent ones once per
Python worker.

Null text is empty; a null doc_id is kept; repeated rows give repeated results; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SLICE, Kept, gather, small_batches, text_of

SPACE = "▁"
KEPT_WORDS = 300_000  # in each of two generations
KEPT_PAIRS = 200_000


class Pieces:
    """Pieces and byte fallback of a SentencePiece model: all that decoding needs."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.control = {i for i in every if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        special = self.control | {self.unknown, *self.byte.values()}
        self.piece = {i: sp.id_to_piece(i) for i in every if i not in special}
        self.bytes = [b""] * len(every)
        for i, p in self.piece.items():
            self.bytes[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.bytes[self.unknown] = " ⁇ ".encode()
        self.is_byte = {*self.byte.values()}
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.first = np.cumsum(self.size) - self.size
        codecs.register_error("each_byte", _each_byte)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: invalid bytes become U+FFFD each, one leading space goes."""
        return self.decode_all([np.array(ids, "<u4").tobytes()])[0]

    def decode_all(self, packed: list[bytes]) -> list[str]:
        """The texts of little-endian unsigned 32-bit ids."""
        ids = np.frombuffer(b"".join(packed), "<u4")
        joined, ends = gather(self.flat, self.first, self.size, ids)
        ends = np.concatenate([[0], ends])
        found, at, raw = [], 0, joined.tobytes()
        for one in packed:
            i, to = at, at + len(one) // 4
            while i < to and ids[i] in self.control:
                i += 1
            start, end = int(ends[at]), int(ends[to])
            if i < to and raw[start : start + 1] == b" " and ids[i] not in self.is_byte and ids[i] != self.unknown:
                start += 1
            try:
                found.append(raw[start:end].decode())
            except UnicodeDecodeError:
                found.append(raw[start:end].decode(errors="each_byte"))
            at = to
        return found


class PieceModel(Pieces):
    """Merge order and backtracking of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        super().__init__(path)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: sp.get_score(i) for p, i in self.id.items() if len(p) > 1}
        runs = [p for p in self.score if not p.strip(SPACE)]
        words = [p for p in self.score if p.strip(SPACE)]
        lowest = min((self.score[p] for p in words), default=0.0)
        if len(self.byte) != 256 or any(SPACE in p[1:] for p in words) or any(self.score[p] >= lowest for p in runs):
            raise ValueError("needs byte fallback, spaces only in front of pieces, and runs of spaces merged last")
        if len({self.score[p] for p in words}) < len(words) or {*"".join(words)} - {*self.id}:
            raise ValueError("needs distinct scores, and a piece for each character of a piece")
        order = sorted(words, key=lambda p: -self.score[p])
        self.rank = {i: -1 for i in self.piece} | {self.id[p]: n for n, p in enumerate(order)}
        self.length = [len(self.piece.get(i, "")) for i in range(len(self.bytes))]
        self.found = ahocorasick.Automaton()
        for p in [*words, *(p for p in self.id if len(p) == 1)]:
            self.found.add_word(p, self.id[p])
        self.found.make_automaton()
        self.beside = {p[i : i + 2] for p in words for i in range(len(p) - 1)}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.prefix: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def merge(self, text: str) -> list[tuple[str, str, str]]:
        """Plain merging, best score first, then leftmost: (piece, its left half, its right half)."""
        nodes = [(c, c, "") for c in text]
        after = [*range(1, len(nodes)), -1]
        before = list(range(-1, len(nodes) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.score.get(nodes[i][0] + nodes[j][0])) is not None:
                heapq.heappush(queue, (-s, i, j, nodes[i][0] + nodes[j][0]))

        for i in range(len(nodes) - 1):
            offer(i, i + 1)
        gone = [False] * len(nodes)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if gone[i] or gone[j] or after[i] != j or nodes[i][0] + nodes[j][0] != both:
                continue
            nodes[i], gone[j], after[i] = (both, nodes[i][0], nodes[j][0]), True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [n for n, g in zip(nodes, gone) if not g]

    def split(self, token: int) -> tuple[int, int] | None:
        """The pair that merges into a longer piece, or None if its own text merges otherwise."""
        if token not in self.halves:
            nodes = self.merge(self.piece[token])
            self.halves[token] = (self.id[nodes[0][1]], self.id[nodes[0][2]]) if len(nodes) == 1 else None
        return self.halves[token]

    def usable(self, token: int) -> bool:
        return self.rank[token] < 0 or self.split(token) is not None

    def compatible(self, left: int | None, right: int) -> bool:
        """Whether merging the two pieces' characters gives just these two; None: at the beginning."""
        if len(self.fits) >= KEPT_PAIRS:
            self.fits.clear()
        known = self.usable(right) and (left is None or self._compatible(left, right))
        self.fits[left, right] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        until, from_right = len(self.rank), False
        while True:
            joined = self.id.get(self.piece[left] + self.piece[right])
            if joined is not None:
                rank = self.rank[joined]
                if rank < until or (from_right and rank == until):
                    return False
            if self.rank[left] > self.rank[right]:
                until, from_right = self.rank[left], False
                left = self.split(left)[1]
            elif self.rank[right] >= 0:
                until, from_right = self.rank[right], True
                right = self.split(right)[0]
            else:
                return True

    def shorter(self, token: int) -> int | None:
        """The longest piece that is a proper prefix."""
        if token not in self.prefix:
            p = self.piece[token]
            self.prefix[token] = next((self.id[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id), None)
        return self.prefix[token]

    def backtrack(self, part: str) -> list[int]:
        """Ids of a part made of known characters, without a space after its first character."""
        length, fits, n = self.length, self.fits, len(part)
        longest = [0] * n
        for at, token in self.found.iter(part):
            longest[at - length[token] + 1] = token  # longer ones end later
        dead = bytearray(n + 1)
        tokens: list[int] = []
        last, at, token = None, 0, longest[0]
        while True:
            following = at + length[token]
            if not dead[following]:
                fit = fits.get((last, token))
                if fit or (fit is None and self.compatible(last, token)):
                    tokens.append(token)
                    if following == n:
                        return tokens
                    last, at, token = token, following, longest[following]
                    continue
            token = self.shorter(token)
            while token is None:
                dead[at] = 1
                token = tokens.pop()
                at -= length[token]
                last = tokens[-1] if tokens else None
                token = self.shorter(token)

    def part(self, part: str) -> list[int]:
        """Ids of spaces, if any, and what follows up to the next space."""
        rest = part.lstrip(SPACE)
        spaces = len(part) - len(rest)
        if not rest:
            return [self.id[p] for p, _, _ in self.merge(part)]
        if spaces > 1:
            ids = self.part(SPACE + rest)
            alone = ids[0] == self.id[SPACE]
            run = [self.id[p] for p, _, _ in self.merge(SPACE * (spaces if alone else spaces - 1))]
            return run + ids[alone:]
        ids, start = [], 0
        for at in range(1, len(part) + 1):
            if part[at - 1 : at + 1] not in self.beside or at == len(part):
                ids += self.whole(part[start:at])
                start = at
        return ids

    def whole(self, part: str) -> list[int]:
        """Ids of a part without cuts."""
        known = self.id.get(part)
        if known is not None:
            return [known] if self.usable(known) else self.backtrack(part)
        if len(part) == 1:
            return [self.byte[b] for b in part.encode()]
        return self.backtrack(part)


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


class PartEncoder:
    """Ids as little-endian unsigned 32-bit integers, with the begin and end ids."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.model.begin, self.model.end))
        self.words = Kept(lambda word: np.array(self.model.part(SPACE + word), "<u4").tobytes(), KEPT_WORDS)

    def _spaced(self, text: str) -> bytes:
        """Ids of a text with runs of spaces."""
        parts = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE))
        return b"".join(
            self.words[p[1:]] if SPACE not in p[1:] and p[0] == SPACE else np.array(self.model.part(p), "<u4").tobytes() for p in parts
        )

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; in all of them together a distinct word is looked up once."""
        found, plain = [self.begin + self.end] * len(texts), []
        for i, text in enumerate(texts.to_pylist()):
            if SPACE in text or "  " in text or text[:1] == " " or text[-1:] == " ":
                found[i] = self.begin + self._spaced(text) + self.end
            elif text:
                plain.append(i)
        if not plain:
            return found
        if len(plain) < len(texts):
            texts = texts.take(pa.array(plain))
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        known = [self.words[w] for w in coded.dictionary.to_pylist()]
        n = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, ends = gather(np.frombuffer(b"".join(known), "<u4"), np.cumsum(n) - n, n, coded.indices.to_numpy())
        packed = ids.tobytes()
        bounds = (4 * np.concatenate([[0], ends])[split.offsets.to_numpy()]).tolist()
        for i, a, b in zip(plain, bounds, bounds[1:]):
            found[i] = self.begin + packed[a:b] + self.end
        return found

    def decode(self, packed: bytes) -> str:
        return self.model.decode_all([packed])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> PartEncoder:
    """One encoder per model file and Python worker."""
    return PartEncoder(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Pieces:
    """One decoder per model file and Python worker."""
    return Pieces(path)


def encode(docs: DataFrame, model: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32 bits, with begin and end) of every whole text.

    If asked for, also `decoded`, the text that the ids give, from the same Python worker.
    """
    names = ["doc_id", "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(model)
        for batch in small_batches(batches, SLICE // 2):
            ids = one.encode_all(batch["text"])
            columns = [batch["doc_id"], pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(one.model.decode_all(ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "doc_id bigint, ids binary" + ", decoded string" * decoded
    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(run, kinds)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Adds the decoded text; other columns are kept."""

    @F.arrow_udf("string")
    def decoded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = decoder(model)
        for part in parts:
            found = []
            for some in small_batches([pa.record_batch([part], names=["ids"])], SLICE):
                ids = some["ids"].to_pylist()
                texts = iter(one.decode_all([i for i in ids if i is not None]))
                found.append(pa.array([None if i is None else next(texts) for i in ids], pa.string()))
            yield pa.concat_arrays(found) if found else pa.array([], pa.string())

    return encoded.withColumn("decoded", decoded("ids"))
