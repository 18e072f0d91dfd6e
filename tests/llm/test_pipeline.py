import sys

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_packing import check_pieces, ids_of
from tokenizers import Tokenizer

import __spark_entry__
from plumbline.llm import crf, languageid, private, sharding, simhash


def test_stages_against_plain_python(spark, docs_dir, docs):
    """Each stage on all its predecessor kept."""
    rows = docs.collect()
    field = crf.train(languageid.training_sample(docs))
    found = field.predict([r["text"] or "" for r in rows])
    kept = [r for r, (lang, score) in zip(rows, found) if lang and score > corpus_pipeline.SURE]
    prints = [(r["doc_id"], simhash.fingerprint(r["text"], corpus_pipeline.WORDS)) for r in kept]
    group = {d: d for d, _ in prints}
    for _ in prints:  # smallest id reachable
        before = dict(group)
        for d, p in prints:
            group[d] = min(group[e] for e, q in prints if (p ^ q).bit_count() <= corpus_pipeline.BITS)
        if group == before:
            break
    single = [r for r in kept if group[r["doc_id"]] == r["doc_id"]]
    stage = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, docs_dir)
        assert stage.columns == docs.columns, name
        if name == "language_id":
            assert {r["doc_id"] for r in stage.collect()} == {r["doc_id"] for r in kept}
        if name == "near_dedup":
            assert sorted(r["doc_id"] for r in stage.collect()) == sorted(r["doc_id"] for r in single)
    assert 0 < len(single) < len(kept)
    masked = {r["doc_id"]: (private.mask(r["text"]), len(private.mask(r["text"]))) for r in single}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in stage.collect()} == masked
    out = corpus_pipeline.run(spark, docs_dir).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = [(d, np.append(ids_of(library, t), 1).astype("<u4")) for d, (t, _) in masked.items()]
    check_pieces(out, wanted, corpus_pipeline.SEQUENCE)


def test_odd_rows_and_empty_table(spark, odd, none, docs_dir):
    for docs in (odd, none):
        for _, function in corpus_pipeline.STAGES[:-1]:
            docs = function(spark, docs, docs_dir)
            assert docs.columns == odd.columns
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, docs_dir).collect()
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}


def test_columns_with_our_own_names_keep_their_values(spark):
    names = ["__found", "__lang", "__score", "__id", "__hash", "__once", "__first", "__index", "__origin", "__at", "row", "lang_pred", "hash"]
    text = "the quick brown fox and the dog went over to the other side of the water"
    rows = [(i, f"{text} {i % 2}", "en", "s", 3, *(f"{n}{i}" for n in names)) for i in range(4)] + [(9, "1 2", None, None, 3, *names)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    named = corpus_pipeline.language_id(spark, docs, "")
    assert sorted(map(tuple, named.collect())) == rows[:4] and named.columns == docs.columns
    single = corpus_pipeline.near_dedup(spark, named, "")
    assert single.columns == docs.columns and {tuple(r) for r in single.collect()} <= set(rows[:4])
    sharded = sharding.shard(docs, "doc_id", 3)
    assert sharded.columns == [*docs.columns, "shard", "slot", "grown_shard"]
    assert sorted(tuple(r)[:-3] for r in sharded.collect()) == rows


def test_entry_lists_every_operator(monkeypatch):
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert not any(n.startswith("op") for n in __spark_entry__.queries())
