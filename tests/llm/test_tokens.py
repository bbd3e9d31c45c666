import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from hourloom.llm import rans, tokens, words
from plain_llm import odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK + 17_000])
def test_coder_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n) - 1, 5000).astype(np.uint16)
    coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=5001) if n else np.ones(5001, int)))
    blocks = coder.encode(ids)
    assert (coder.decode(blocks) == ids).all()
    assert (np.concatenate([coder.decode([b]) for b in blocks] or [ids]) == ids).all()


def test_coder_is_near_entropy_and_checks():
    ids = np.random.default_rng(1).integers(0, 50, 200_000) ** 2 % 77
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    coder = rans.Coder(rans.frequencies(counts))
    blocks = coder.encode(ids)
    assert sum(map(len, blocks)) * 8 / len(ids) < -(p * np.log2(p)).sum() * 1.06
    with pytest.raises(ValueError):
        coder.decode([blocks[0][:-4] + b"\0\1\2\3"])
    with pytest.raises(ValueError):
        coder.encode(np.array([len(counts) - 1 + (counts[-1] > 0)]) * 0 + int(np.flatnonzero(counts == 0)[0]))


def test_words_encode_as_whole_texts():
    own, plain = words.WordEncoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    letters = list("aZÉéßÄσΣİıſKÅǅñÑ'’.,;!?0189 \t\n\x1c\x85é한<|>_-#&ªºµ÷× ́") + ["'s", "'ll", "<|endoftext|>", "don't", "THE"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(5000)] + ["x" * 500, "a." * 200]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, own.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_small_memory(monkeypatch):
    monkeypatch.setattr(words, "KEPT_WORDS", 3)
    monkeypatch.setattr(words, "KEPT_PARTS", 3)
    own, plain = words.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for text in ("one two three. four five", "five six two, " + "y" * 90, "one two"):
        assert np.frombuffer(own.encode([text])[0], own.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_signs_behind_a_word_make_no_new_words(monkeypatch):
    made, word = [], words.WordEncoder._word
    monkeypatch.setattr(words.WordEncoder, "_word", lambda self, w: (made.append(w), word(self, w))[1])
    own, plain = words.WordEncoder(PATH), Tokenizer.from_file(PATH)
    names = ["".join(p) for p in itertools.product("abc", repeat=3)]
    text = " ".join(n + s for s in ("", ".", ",", "!?", "...") for n in names)
    assert np.frombuffer(own.encode([text])[0], own.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(made) == len(names) + 4


def test_arrow_texts_nulls_and_special_tokens():
    own, plain = words.WordEncoder(PATH), Tokenizer.from_file(PATH)
    texts = ["skip", "one,two. Three!", None, "", "  \n", "a<|endoftext|>b, c", "end<|ENDOFTEXT|>.", "x\x1dy, z", "Don't a.b's."]
    column = pa.array(texts, pa.large_string())
    for rows, part in ((texts, pa.array(texts)), (texts[1:], column.slice(1)), ([], column.slice(0, 0)), ([None], pa.array([None], pa.string()))):
        assert [np.frombuffer(i, own.dtype).tolist() for i in own.encode(part)] == [
            plain.encode(t or "", add_special_tokens=False).ids for t in rows]


@pytest.mark.parametrize("container", [100, 1 << 20])
def test_files_hold_all_ids_in_order(spark, tmp_path, monkeypatch, container):
    monkeypatch.setattr(tokens, "CONTAINER_IDS", container)
    docs, plain = odd_documents(spark), Tokenizer.from_file(PATH)
    path = str(tmp_path / "t")
    tokens.write_token_files(docs, path, PATH, 1)
    rows = sorted(tokens.read_token_files(spark, path).collect(), key=lambda r: r.start)
    texts = docs.select("doc_id", "text").collect()
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in texts)
    assert [-1 if r.doc_id is None else r.doc_id for r in rows] == ids
    assert sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == sorted(
        (t.doc_id or -1, plain.encode(t.text or "", add_special_tokens=False).ids + [1]) for t in texts)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    sums = {(r.start, r.ids_crc32) for r in tokens.read_token_files(spark, path, digest=True).collect()}
    assert sums == {(r.start, zlib.crc32(r.ids)) for r in rows}


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tokens.write_token_files(odd_documents(spark).limit(0), path, PATH, 1)
    assert tokens.read_token_files(spark, path).count() == 0
