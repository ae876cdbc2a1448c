"""Near-duplicate links at a size where bands, sketches and bitmaps all play: none may be lost against exact sets of all pairs that share a shingle."""

import re
from collections import Counter, defaultdict

from corpusloom.llm import minhash

SF = "/root/testdata/sf0.01"


def test_no_link_is_lost(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sets, where = {}, defaultdict(list)
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(5, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
        for x in sets[i]:
            where[x].append(i)
    both = Counter()
    for ids in where.values():
        both.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    share = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in both.items() if 100 * n >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in share:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["doc_id"]: r for r in minhash.op2_minhash(spark, SF).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i, _ in docs}
    lost = [p for p in share if got[p[0]]["component_id"] != got[p[1]]["component_id"]]
    assert len(share) > 100 and not lost
