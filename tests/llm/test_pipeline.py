"""The stages in a row against the same stages by brute force."""

import hashlib

import corpus_pipeline
from corpusloom.llm import bpe
from corpusloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    from test_dedup import leaks, near_groups, repeats

    import public_tokenizers

    rows = sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").collect())
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    rows = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    kept = near_groups(rows)
    rows = [(i, t) for i, t in rows if kept[i][2]]
    left = repeats(rows)
    rows = [(i, t if not left[i][2] else left[i][3].decode("utf-8", "ignore")) for i, t in rows]
    rows = [(i, t) for i, t in rows if t]
    bad = leaks(rows, items)
    encoder = bpe.Encoder(bpe.Lexicon(public_tokenizers.path("word_bpe_49k.json")))
    want = {i: hashlib.sha256(encoder.encode(t).tobytes()).hexdigest() for i, t in rows if not bad[i][4]}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_the_columns(spark):
    d = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d.where("doc_id < 40"), SF).columns == d.columns
