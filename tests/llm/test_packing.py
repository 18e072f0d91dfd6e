import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from plumbline.llm import binpacking, packing, queries, wordbpe
from plumbline.llm.wordbpe import WordEncoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4")


def fewest(sizes, capacity):
    """The fewest bins by exhaustive search."""
    items = sorted(sizes, reverse=True)

    def place(i, rooms, best):
        if len(rooms) >= best:
            return best
        if i == len(items):
            return len(rooms)
        for r in {*rooms}:
            if r >= items[i]:
                left = list(rooms)
                left.remove(r)
                best = min(best, place(i + 1, [*left, r - items[i]], best))
        return min(best, place(i + 1, [*rooms, capacity - items[i]], best))

    return place(0, [], len(items) + 1)


def check_bins(bins, sizes, capacity):
    used = Counter()
    for n, filling in bins:
        assert n > 0 and sum(s * k for s, k in filling) <= capacity
        for s, k in filling:
            used[s] += n * k
    assert used == Counter(sizes)


def test_plan_is_the_fewest_bins_on_small_cases():
    rng = random.Random(1)
    for _ in range(150):
        sizes = [rng.randint(5, 40) for _ in range(rng.randint(1, 9))]
        bins = binpacking.plan(dict(Counter(sizes)), 50)
        check_bins(bins, sizes, 50)
        assert sum(n for n, _ in bins) == fewest(sizes, 50)


def test_bin_completion_beats_best_fit_decreasing():
    gained = 0
    rng = random.Random(2)
    for _ in range(300):
        sizes = dict(Counter(rng.randint(10, 60) for _ in range(24)))
        first = sum(n for n, _ in binpacking.best_fit(sizes, 100))
        bins = binpacking.plan(sizes, 100)
        check_bins(bins, list(Counter(sizes).elements()), 100)
        assert binpacking.lower_bound(sizes, 100) <= sum(n for n, _ in bins) <= first
        gained += sum(n for n, _ in bins) < first
    assert gained


def test_bin_completion_of_many_distinct_sizes_beats_best_fit_decreasing():
    rng = random.Random(5)
    sizes = Counter(rng.randint(300, 2300) for _ in range(300_000))
    assert len(sizes) > 2000
    first = sum(n for n, _ in binpacking.best_fit(sizes, 4096))
    bins = binpacking.plan(dict(sizes), 4096)
    check_bins(bins, sizes, 4096)
    assert binpacking.lower_bound(sizes, 4096) <= sum(n for n, _ in bins) < first


def test_best_fit_of_counts_equals_one_by_one():
    rng = random.Random(3)
    for _ in range(100):
        sizes = Counter(rng.randint(1, 30) for _ in range(60))
        rooms = []
        for s in sorted(sizes.elements(), reverse=True):
            fitting = [r for r in rooms if r >= s]
            if fitting:
                rooms.remove(min(fitting))
                rooms.append(min(fitting) - s)
            else:
                rooms.append(40 - s)
        got = sorted(40 - sum(s * k for s, k in f) for n, f in binpacking.best_fit(dict(sizes), 40) for _ in range(n))
        assert got == sorted(rooms)


def test_dominated_fillings():
    assert binpacking.dominated(((3, 2),), 10, [6])  # 6 in place of 3 + 3
    assert binpacking.dominated(((3, 1),), 10, [7])  # 7 fits beside it
    assert not binpacking.dominated(((6, 1), (4, 1)), 10, [3, 5])
    assert not binpacking.dominated(((6, 1),), 6, [6])


def test_plan_refuses_wrong_sizes_and_takes_none():
    assert binpacking.plan({}, 10) == []
    for bad in (0, 11):
        with pytest.raises(ValueError):
            binpacking.plan({bad: 1}, 10)


def check_pieces(rows, wanted, capacity):
    """Rows against the ids of each document; places without gaps or overlaps."""
    pieces = sorted((r["doc_id"] is not None, r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = sorted(
        (d is not None, d, i, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes()))
        for d, ids in wanted
        for i, at in enumerate(range(0, len(ids), capacity))
    )
    assert pieces == want
    order = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for _, group in itertools.groupby(order, key=lambda x: x[0]):
        end = 0
        for _, offset, length in group:
            assert offset == end
            end += length
        assert end <= capacity


def test_query_on_documents(spark, docs_dir, texts, library):
    rows = queries.op1_best_fit_packing(spark, docs_dir).collect()
    wanted = [(d, np.append(ids_of(library, t), 1).astype("<u4")) for d, t in texts]
    check_pieces(rows, wanted, 4096)
    total = sum(len(w) for _, w in wanted)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 4096) + 1


def test_odd_rows_small_sequences(odd, odd_rows, library, none):
    rows = packing.pack_documents(odd, VOCABULARY, 1, 64).collect()
    check_pieces([r for r in rows], [(r[0], np.append(ids_of(library, r[1] or ""), 1).astype("<u4")) for r in odd_rows], 64)
    assert packing.pack_documents(none, VOCABULARY).count() == 0


def test_pack_other_items(spark):
    lengths = [3] * 500 + [7] * 100 + [10] * 5
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "k int, length bigint").repartition(5, "length")
    rows = packing.pack(packing.number(items), 10).collect()
    assert sorted(r["k"] for r in rows) == list(range(len(lengths)))
    assert len({r["sequence_id"] for r in rows}) == 5 + 100 + -(-400 // 3)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


@pytest.mark.parametrize("kept", [250_000, 5])
def test_words_equal_the_library(library, texts, kept, monkeypatch):
    monkeypatch.setattr(wordbpe, "KEPT", kept)
    words = WordEncoder(VOCABULARY)
    alphabet = ["a", "Don't", "'ll", "é", "É", "é", " ", "\n", "\x1f", "\x85", "ß", "İ", "ſ", "½", "12", "<|endoftext|>", "🎉", "日本", "--", "_"]
    rng = random.Random(4)
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for text in [*made, *(t for _, t in texts)]:
        assert words.encode(text) == ids_of(library, text).tobytes(), text


def test_plain_letters_are_lowered_and_split_alike():
    """Arrow and Python agree on every character that goes the short way."""
    plain = [c for c in map(chr, range(0x110000)) if not (0xD800 <= ord(c) < 0xE000) and not wordbpe.OTHER.search(c)]
    assert pc.utf8_lower(pa.array(plain)).to_pylist() == [c.lower() for c in plain]
    assert [c for c in plain if pc.ascii_split_whitespace(pa.array([f"a{c}b"]))[0].as_py() != [f"a{c}b"]] == [c for c in plain if c.isspace()]


def test_batches_equal_single_texts(library, texts):
    mixed = [t for _, t in texts] + ["", " ", "日本", "a  b", "\n", "<|endoftext|> x"]
    assert WordEncoder(VOCABULARY).encode_all(pa.array(mixed)) == [ids_of(library, t).tobytes() for t in mixed]
    assert WordEncoder(VOCABULARY).encode_all(pa.array([], pa.string())) == []
