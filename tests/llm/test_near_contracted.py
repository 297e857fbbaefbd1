"""Near copies whose bands have many leads."""

import random

from lattica.llm import near_dedup


def test_components_are_not_joined_anew_by_all_edges(spark, monkeypatch):
    """The second search for components starts from a link a node of what the first one found, and finds the same class."""
    r, seen = random.Random(4), []
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:k], "x" + str(i), *base[k + 1 :]]) for i, k in enumerate(r.choices(range(200), k=60))] + ["something else altogether in five words and more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = near_dedup.connected_components
    monkeypatch.setattr(near_dedup, "connected_components", lambda edges: seen.append(edges.count()) or whole(edges))
    out = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs).collect()}
    assert out == {**dict.fromkeys(range(60), 0), 60: 60}
    assert seen[0] > 100 and seen[1] < seen[0]
