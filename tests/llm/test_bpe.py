"""Token counts against the library that the file is for."""

from __future__ import annotations

import itertools
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from oracle import DATA
from tokenizers import Tokenizer

from stowage.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  ", "\n\n x\t\ty\r\n", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endof", "don't we'll I'M 'S", "123 4567x ２３", "日本語のテキスト", "é é ß ﬁ", "👩‍👩‍👧 🏽", "  x", "\x00\x01\x7f", "a" * 5000, "ab" * 3000, "." * 3000, " " * 3000, "!?" * 999, "İİ ǅ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def definition():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def test_every_document(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = bpe.op4_heap_bpe(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 512)


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_odd_texts(library, definition, text):
    assert bpe.Counter(definition).text(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_nulls_empty_tables_and_extra_columns(documents, definition):
    df = documents([(1, None), (2, ""), (3, "a b")]).selectExpr("*", "5 as n_tokens", "6 as n_bytes")
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in bpe.count_tokens(df, definition).collect()} == {1: (0, 0, False), 2: (0, 0, False), 3: (3, 2, False)}
    assert bpe.count_tokens(documents([]), definition).count() == 0


def test_other_kinds_of_files_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError, match="byte-level"):
        bpe.Counter(f.read())


def test_many_texts_at_a_time(spark, library, definition, monkeypatch):
    """Rounds over arrays give what the library gives, whatever is remembered, and make far fewer steps than merges."""
    monkeypatch.setattr(bpe, "KEPT", 50)
    monkeypatch.setattr(bpe, "TEXTS", 2000)
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 7)
    texts = [None, *ODD, *(r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()), "aaaa " + "ab" * 40 + " \n b", "x isn't can't, o'clock' it's. ''s a,b a, é, f) (g) 'll 's, x_ 5% ab5, \x7f a\x7f, a,\x7f", " ".join("é" * i for i in range(1, 80))]
    expected = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    own = bpe.Many(definition)
    for _ in range(2):
        assert own.texts(pa.array(texts)) == expected


def test_new_words_are_merged_together(definition, monkeypatch):
    rounds, own, words = [], bpe.Many(definition), [f"{a}{b}{c}ing" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    work = own.rounds
    monkeypatch.setattr(own, "rounds", lambda symbols, lengths: rounds.append(len(lengths)) or work(symbols, lengths))
    monkeypatch.setattr(own, "piece", lambda text: 1 / 0)
    own.learn(set(words))
    assert rounds == [len(words)]
    assert own.known == {w: bpe.Counter(definition).word(w) for w in words}


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_that_no_training_gives(seed):
    """A merge may make a symbol of pairs with lower ranks, so equal pairs of a piece merge one after the other."""
    rng = random.Random(seed)
    made = ["a", "b", "c"]
    merges = []
    while len(merges) < 60:
        x, y = rng.choice(made), rng.choice(made)
        if len(x + y) < 9 and (x, y) not in merges:
            merges.append((x, y))
            made.append(x + y)
    rng.shuffle(merges)
    definition = json.dumps({"model": {"type": "BPE", "merges": merges}, "pre_tokenizer": {"type": "ByteLevel"}})
    words = ["".join(rng.choices("abc", k=rng.randint(1, 40))) for _ in range(300)]
    one = bpe.Counter(definition)
    assert bpe.Many(definition).merged(words) == [one.piece(w) for w in words]


def test_no_word_is_looked_at_by_itself(spark, definition, monkeypatch):
    """Texts are cut, and new pieces merged, in arrays; a regular expression or a heap for each word is too slow."""
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    expected = [bpe.Counter(definition).text(t) for t in texts[:50]]
    own = bpe.Many(definition)
    for name in ("find", "learn", "piece", "word", "text"):
        monkeypatch.setattr(own, name, lambda *_: 1 / 0)
    assert own.texts(pa.array(texts))[:50] == expected


def test_cuts_are_those_of_the_expression(definition):
    """All short texts of some characters, and random longer ones, with others before and behind them."""
    rng, own, find = random.Random(4), bpe.Many(definition), regex.compile(bpe.PIECES).findall
    odd = [" ", " ", "\n", "\t", "'", "'", *"stmdrevl", "S", "a", "é", "数", "😀", "\u0301", "1", "²", "٣", "!", "\u00a0", "\u2003", "\u3000", "\x1c", "\x85", "\u200b", "\x00", "×", "ª"]
    texts = ["".join(t) for n in (1, 2, 3) for t in itertools.product(odd[1:], repeat=n)]
    texts += ["".join(rng.choices(odd, k=rng.randint(4, 40))) for _ in range(5000)]
    rng.shuffle(texts)
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(d) for d in data])
    at = own.cut(np.frombuffer(b"".join(data), np.uint8), ends - [len(d) for d in data]).tolist()
    whole = b"".join(data)
    assert [whole[a:b].decode() for a, b in itertools.pairwise([*at, len(whole)])] == [p for t in texts for p in find(t)]


def test_slices_nulls_and_special_strings(library, definition, monkeypatch):
    monkeypatch.setattr(bpe, "TEXTS", 30)
    texts = [None, "", *ODD, None, "a <|endoftext|>", "<|endoftext|> \u00a0 x\u2003y", "", None]
    expected = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    own = bpe.Many(definition)
    for kind in (pa.string(), pa.large_string()):
        for lo, hi in ((0, len(texts)), (3, 20), (5, 5), (0, 2), (len(texts) - 2, len(texts))):
            assert own.texts(pa.array(texts, kind).slice(lo, hi - lo)) == expected[lo:hi]
    assert own.texts(pa.nulls(2)) == [0, 0]
