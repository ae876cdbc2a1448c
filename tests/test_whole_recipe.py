"""The learned queries take the whole recipe, and written scores leave a model as it is."""

import pytest
from corpusloom import queries_retrieval
from corpusloom.operators import boost
from test_boost import FEATURES, candidates, table


@pytest.mark.parametrize("query", ["learned_ranking", "learned_gate"])
def test_queries_fit_the_whole_recipe(spark, monkeypatch, query):
    taken = []
    rows = table(spark, candidates(10)).selectExpr("*", "1 + int(substr(chunk_id, 2)) AS bm25_rank", "14 - int(substr(chunk_id, 2)) AS dense_rank")

    def fit(rows, features, recipe=boost.Recipe()):
        taken.append(recipe)
        return boost.Model(tuple(features), ((),) * len(features), ())

    monkeypatch.setattr(boost, "fit", fit)
    monkeypatch.setattr(queries_retrieval, "fusion_features", lambda spark, d: rows)
    assert getattr(queries_retrieval, query)(spark, "").count() > 0
    assert taken == [boost.Recipe()] and taken[0].trees == 200


@pytest.mark.parametrize(("kept", "few"), [(2, 64), (3, 0)])
def test_written_scores_leave_the_model(spark, monkeypatch, kept, few):
    rows = table(spark, candidates())
    recipe = boost.Recipe(trees=5, rate=0.3, leaves=5, least_rows=8)
    want = boost.fit(rows, FEATURES, recipe)
    for name, value in (("KEPT", kept), ("FEW", few), ("ROWS", 60)):
        monkeypatch.setattr(boost, name, value)
    assert boost.fit(rows, FEATURES, recipe) == want
