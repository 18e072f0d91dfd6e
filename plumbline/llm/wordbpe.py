"""Token ids of whole texts by a byte-level word BPE of the tokenizers library, with words kept.

The pre-tokenizer of such a vocabulary never joins two sides of white space, so a text is the
concatenation of its chunks between white space, and a chunk that of its words. A batch of texts is
reduced to its distinct chunks and these to their distinct words, whose ids each Python worker keeps;
the ids of the texts are gathered from them, all at once. That holds for texts of plain letters, in
which NFC changes nothing and Python's, Arrow's and the library's character classes agree; any other
text, and one that may hold a special token, is given to the library whole.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from plumbline.llm.common import Kept, gather

KEPT = 250_000  # words in each of two generations
#: outside printable ASCII and precomposed Latin letters, or the beginning of a special token
OTHER = re.compile(r"[^\t\n\x20-\x7e¡-įı-ž]|<\|")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids as little-endian unsigned 32-bit integers: of texts from their chunks, of chunks from their words."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.by_chunk = kinds == ["NFC", "Replace", "Lowercase"] and len(splits) == 1
        self.find = regex.compile(splits[0]["pattern"]["Regex"] + r"|\n").findall if self.by_chunk else None
        self.letters = byte_letters()
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.words = Kept(self._word, KEPT)

    def _word(self, word: str) -> bytes:
        if word == "\n":
            return b""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.packed[token.id] for token in self.tokenize(shown)])

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all distinct chunks and where each chunk's end."""
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), "\n")[0].as_py()
        words = pa.array(self.find(line + "\n"), pa.string()).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        known = [self.words[w] for w in distinct]
        n = np.fromiter(map(len, known), np.int64, len(known)) // 4
        code = words.indices.to_numpy()
        ids, ends = gather(np.frombuffer(b"".join(known), "<u4"), np.cumsum(n) - n, n, code)
        return ids, ends[code == distinct.index("\n")]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; in all of them together a distinct chunk or word is looked up once."""
        found = [b""] * len(texts)
        plain = []
        for i, text in enumerate(texts.to_pylist()):
            if self.by_chunk and not OTHER.search(text):
                plain.append(i)
            else:
                found[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not plain:
            return found
        if len(plain) < len(texts):
            texts = texts.take(pa.array(plain))
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = split.flatten().dictionary_encode()
        ids, ends = self._chunks(coded.dictionary)
        n = np.diff(ends, prepend=0)
        ids, ends = gather(ids, ends - n, n, coded.indices.to_numpy())
        packed = ids.tobytes()
        bounds = (4 * np.concatenate([[0], ends])[split.offsets.to_numpy()]).tolist()
        for i, a, b in zip(plain, bounds, bounds[1:]):
            found[i] = packed[a:b]
        return found


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per vocabulary file and Python worker."""
    return WordEncoder(path)
