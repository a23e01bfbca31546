"""Token counts and compressed shards next to the tokenizer on whole texts."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chalkline.llm import repair
from chalkline.llm.pieces import PieceTable, resolve
from chalkline.llm.token_counts import with_token_counts

ODD = [
    None, "", " ", "  ", "a  b", "a   b", " a", "b ", "x\n y", "x\n \n y", "x\n <|endoftext|> y", "<|endoftext|>", "I'm 'll's",
    "naïve É ß 漢字 🙂", "tab\t \tspace", "x" * 5000, "word " * 30000, "1 22  333  4",
]
TOKENIZER = Tokenizer.from_file(resolve("byte_bpe_50k.json"))


def whole(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, -1) for i, t in enumerate(ODD)] + [(None, "no id", 0), (3, "  ", 1), (3, "  ", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")


def test_counts_equal_whole_texts(spark, docs):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in with_token_counts(docs).collect())
    want = sorted(
        (i or -1, len((t or "").encode()), len(whole(t)), len(whole(t)) > 1024)
        for i, t, _ in (tuple(r) for r in docs.collect())
    )
    assert got == want


def test_sentencepiece_counts(spark, docs):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=resolve("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in with_token_counts(docs.where("doc_id < 12 AND doc_id <> 3"), "piece_bpe_32k.model").collect()}
    assert got == {i: len(model.encode(ODD[i] or "")) for i in range(12) if i != 3}


def test_counts_of_an_empty_table(spark, docs):
    out = with_token_counts(docs.limit(0))
    assert out.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"] and out.count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab.,'é1<|>", max_size=40), max_size=5))
def test_pieces_equal_whole_texts(texts):
    table = PIECES
    assert [x.tolist() for x in table.ids(texts)] == [whole(t) for t in texts]
    assert table.counts(texts) == [len(whole(t)) for t in texts]


PIECES = PieceTable("byte_bpe_50k.json", bound=50)  # small, so that it also forgets


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=300), st.data())
def test_compression_is_reversible(ids, data):
    base = 6
    ids = np.array(ids, np.int64)
    symbols, rules, lengths = repair.compress(ids, base, rounds=5, per_round=3, least=2)
    assert repair.expand(symbols, rules, base).tolist() == ids.tolist()
    assert [len(repair.expand(np.array([base + i]), rules, base)) for i in range(len(rules))] == lengths.tolist()
    assert len(symbols) <= len(ids)


def test_random_access():
    rng = np.random.default_rng(1)
    documents = [rng.integers(0, 4, n).astype(np.int32) for n in (1, 500, 1, 3000, 40)]
    shard = repair.Shard(repair.pack(documents, 50257))
    flat = np.concatenate(documents)
    assert len(shard.symbols) < 0.6 * len(flat)
    assert [shard.document(k).tolist() for k in range(5)] == [d.tolist() for d in documents]
    for a, b in rng.integers(0, len(flat), (50, 2)):
        assert shard.ids(a, b).tolist() == flat[a:b].tolist()


def test_shards_round_trip(spark, docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    repair.write_shards(docs, path, shard_tokens=40)
    rows = repair.read_documents(spark, path).collect()
    assert len(rows) == docs.count() and spark.read.parquet(path).count() > 3
    rows.sort(key=lambda r: (r.start, r.n_tokens))
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda i: -1 if i is None else i)
    texts = dict(enumerate(ODD)) | {None: "no id"}
    at = 0
    for r in rows:
        ids = np.array([*whole(texts[r.doc_id]), 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_shards_of_an_empty_table(spark, docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    repair.write_shards(docs.limit(0), path)
    assert repair.read_documents(spark, path).count() == 0


def test_words_are_encoded_without_marks_between_and_looked_up_once(monkeypatch):
    """New words go to the tokenizer with their spaces only, a word of several texts is looked up once, ids are those of whole texts."""
    pieces = PieceTable("byte_bpe_50k.json")
    sent, looked = [], []
    learned, codes_of = pieces._joined, pieces._codes_of
    monkeypatch.setattr(pieces, "_joined", lambda between, words, *mark: (sent.append((between, words)), learned(between, words, *mark))[1])
    monkeypatch.setattr(pieces, "_codes_of", lambda words: (looked.extend(words), codes_of(words))[1])
    texts = ["one two two's 100%", "one two\nthree Ġa Ġ", " two  x", "", " ", "end\n", "\n in", "y" * 300 + " two"]
    assert [x.tolist() for x in pieces.ids(texts)] == [pieces.whole(t) for t in texts]
    assert looked.count("two") == 1
    assert {w for between, words in sent if between == " " for w in words} >= {"two", "two's", "100%", "two\nthree", "Ġa", "Ġ"}


def test_a_shard_is_expanded_rule_by_rule():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 9, 5000), np.zeros(4000, np.int64), np.arange(50), np.zeros(0, np.int64)):
        symbols, rules, lengths = repair.compress(ids, 50)
        assert np.array_equal(repair.expand_all(symbols, rules, lengths, 50), ids)
        assert np.array_equal(repair.Shard(repair.pack([ids], 50)).all_ids(), ids)


def test_words_are_looked_up_once_and_encoded_without_threads(monkeypatch):
    """A batch asks the dictionary once for each word it knows, and a task leaves the library's threads alone."""
    import os

    class Asked(dict):
        asked = 0

        def get(self, *a):
            Asked.asked += 1
            return super().get(*a)

    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    table = PieceTable("byte_bpe_50k.json")
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    known, new = [f"w{i}x" for i in range(900)], ["other", "y" * 300]
    table._codes_of(known)
    table.code = Asked(table.code)
    codes = table._codes_of([*known, *new, "other"])
    assert Asked.asked <= len(known) + 2 * 3
    assert codes[:900].tolist() == [table.code[w] for w in known]
    assert codes[900] == codes[902] == table.code["other"] and codes[901] == -1
