"""Token counts against the library, and the classes of characters that the split rests on."""

import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", None, " ", "a", "it's  we'll 'S 's", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endof", "x\x1cy\x1d \x85z​　q", "\n\n\n a\r\n\t", "né 😀 ÄÖ ß 12½ ²", "日本語 テスト한국어", "=" * 5000,
    "ab" * 4000, "hello world " * 2000, "࢏ new letter", "é ́", "﻿", "\x00\x01", "don't’s",
]


def test_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in enumerate(ODD)] + [(0, "again", 1, 1), (None, "no id", 1, 1)], "doc_id long, text string, n_tokens long, n_bytes long")
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.count_tokens(docs, words=["hello world"]).collect()}
    want = set()
    for i, t, *_ in docs.collect():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.add((i, len((t or "").encode()), n, n > 512))
    assert got == want
    assert tokencount.count_tokens(docs.limit(0)).collect() == []


def test_long_texts_go_piece_by_piece(monkeypatch):
    monkeypatch.setattr(tokencount, "PIECE", 10)
    monkeypatch.setattr(tokencount, "CACHE", 5)
    counter, library = tokencount.Counter(PATH, tokencount.newer_characters()), Tokenizer.from_file(PATH)
    for t in ODD:
        assert counter.count(t) == len(library.encode(t or "", add_special_tokens=False).ids), t


def test_the_table_is_exact():
    table = tokencount.LengthTable({b"a": 1, b"ab": 2, "é".encode(): 3} | {str(i).encode(): i % 9 for i in range(1000)})
    assert [table.find(w) for w in (b"a", b"ab", "é".encode(), b"998", b"b", b"", b"1000")] == [1, 2, 3, 8, -1, -1, -1]
    built = tokencount.frequent_lengths(PATH, ["zyzzyvas abc"])
    assert built.find(b" the") == 1 and built.find(b"zyzzyvas") > 1 and len(built.lengths) > 49_000


def test_every_character_has_the_library_s_class():
    newer, split = tokencount.newer_characters(), Tokenizer.from_file(PATH).pre_tokenizer
    for at in range(0, sys.maxunicode + 1, 4096):
        chars = [chr(c) for c in range(at, at + 4096) if not 0xD800 <= c < 0xE000 and chr(c) not in newer]
        text = "\n".join(f"a{c}1{c}!{c}" for c in chars)
        assert [text[a:b] for _, (a, b) in split.pre_tokenize_str(text)] == tokencount.PRETOKEN.findall(text)


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokencount.Counter(public_tokenizers.path("word_bpe_49k.json"), frozenset())
