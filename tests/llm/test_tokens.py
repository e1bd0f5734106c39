import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from repovitals.llm import token_count, token_huffman
from repovitals.llm.common import lean, new_path
from repovitals.llm.tokens import _encoders, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ODD = [None, "", "a  b", " a", "a ", "\n", "a\nb", "a\n\nb", "don't do", "x<|endoftext|>y z", "é ü\tß", "a\x1cb c", "日本 語", "a\xa0b c", "' s 's", "x 2²", "word " * 3000, "a" * 20000]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab Z1'.\n\t\xa0éß日\x1c²ª<|>")), max_size=30))
def test_cached_ids_and_counts_are_the_library_s(text):
    coder, plain = encoder(PATH), PLAIN
    ids = plain.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids
    assert coder.count(text) == len(ids)


def test_package_merge_is_optimal_within_its_limit():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    free = token_huffman.code_lengths(counts, 16)
    assert (counts * free).sum() <= (counts * token_huffman.code_lengths(counts, 5)).sum()
    for limit in (4, 5, 16):
        n = token_huffman.code_lengths(counts, limit)
        assert n.max() <= limit and n[0] == 0 and abs((0.5 ** n[n > 0].astype(float)).sum() - 1) < 1e-12


def test_round_trip_of_files(spark):
    plain = PLAIN
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(ODD)] + [(5, "twice", "x"), (5, "twice", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    path = new_path(spark, "test")
    token_huffman.write(docs, path, PATH)
    got = token_huffman.read(spark, path).collect()
    got.sort(key=lambda r: r["start"])
    assert len(got) == len(rows)
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    want: dict = {}
    for d, t, _ in rows:
        want.setdefault(d, []).append((plain.encode(t, add_special_tokens=False).ids if t else []) + [0])
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids"] in want[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = new_path(spark, "test")
    token_huffman.write(docs, path, PATH)
    assert token_huffman.read(spark, path).count() == 0
    assert token_count.token_counts(docs, PATH).count() == 0


def test_counts(spark):
    plain = PLAIN
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_count.token_counts(docs, PATH).collect()}
    for i, t in enumerate(ODD):
        n = len(plain.encode(t, add_special_tokens=False).ids) if t else 0
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 1024)


def test_sentencepiece_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(0, "Some words"), (1, None), (2, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(docs, path).collect()} == {0: len(model.encode("Some words")), 1: 0, 2: 0}


def test_tasks_of_other_operators_let_the_tokenizer_s_cache_go():
    encoder(PATH).codes("some words to keep")
    task = lean(lambda batches: (x + 1 for x in batches))
    assert _encoders and list(task([1, 2])) == [2, 3] and not _encoders
    assert np.frombuffer(encoder(PATH).encode("a b"), "<u4").tolist() == PLAIN.encode("a b", add_special_tokens=False).ids


def test_the_library_s_own_cache_of_words_is_not_used(monkeypatch):
    """Pieces are asked for once, so the library would keep words in vain."""
    from repovitals.llm.tokens import Encoder

    sizes = []

    class Model:
        tokenize = None

        def _resize_cache(self, n):
            sizes.append(n)

    class Spied:
        def __init__(self, inner):
            self.inner, self.model = inner, Model()

        def __getattr__(self, name):
            return getattr(self.inner, name)

    class Library:
        @staticmethod
        def from_file(path):
            return Spied(Tokenizer.from_file(path))

    monkeypatch.setattr("repovitals.llm.tokens.Tokenizer", Library)
    Encoder(PATH)
    assert sizes == [0]


def test_the_library_is_asked_for_a_word_once_whatever_marks_come_after_it():
    from repovitals.llm.tokens import Encoder

    coder, asked = Encoder(PATH), []
    ask = coder.tokenize
    coder.tokenize = lambda x: asked.append(x) or ask(x)
    coder.pieces.limit = 16
    text = "a word*** word!!! word). wörd%% wörd 12%% 12\nWord?!\nWörd -- x_ ** don' d'' ª.. 5², é'a"
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids
    assert asked.count("Ġword") == asked.count("Ġ12") == asked.count("ĠwÃ¶rd") == 1
    assert len(coder.pieces.marks) <= 2


def test_the_driver_keeps_no_tokenizer_once_it_has_the_size(spark):
    path = new_path(spark, "test")
    token_huffman.write(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), path, PATH)
    assert not _encoders
