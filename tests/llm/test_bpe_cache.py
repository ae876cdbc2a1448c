"""A task's words are merged once, not again and again behind a cache that was emptied, and the cache stays small."""

import tracemalloc

import public_tokenizers

from corpusloom.llm import bpe


def test_words_of_a_task_are_merged_once(monkeypatch):
    lexicon = bpe.Lexicon(public_tokenizers.path("word_bpe_49k.json"))
    count, merged = [], lexicon.merged
    monkeypatch.setattr(lexicon, "merged", lambda raw: count.append(raw) or merged(raw))
    encoder = bpe.Encoder(lexicon)
    names = ["".join(chr(97 + n // 26**i % 26) for i in range(4)) for n in range(60_000)]
    text = " ".join(f"q{n}x, {n}xq" for n in names)
    tracemalloc.start()
    first = encoder.encode(text)
    held = tracemalloc.get_traced_memory()[0] - first.itemsize * len(first) - sum(map(len, count))
    tracemalloc.stop()
    assert len(count) == len(set(count)) > 110_000
    assert held < 400 * len(encoder.words)  # with the words counted here
    assert encoder.encode(text) == first and len(count) == len(set(count))
