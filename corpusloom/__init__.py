"""corpusloom: a DataFrame-first engine for document corpora, retrieval and evaluation."""
