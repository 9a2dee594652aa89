"""Components: rounds only while edges are no stars."""

import random

from fluxtide.llm import graph


def rounds(monkeypatch, spark, edges):
    made = []
    whole = graph.written
    monkeypatch.setattr(graph, "written", lambda df: made.append(1) or whole(df))
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    monkeypatch.undo()
    return found, len(made) - 1


def test_stars_take_no_round(spark, monkeypatch):
    found, n = rounds(monkeypatch, spark, [(1, 5), (6, 1), (2, 9), (3, 3)])
    assert found == {5: 1, 6: 1, 9: 2} and n == 0
    assert rounds(monkeypatch, spark, []) == ({}, 0)


def test_components_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    path = [(i, i + 1) for i in range(100, 140)]
    edges = path + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, 200 + i) for i in range(1, 30)]
    label = list(range(300))
    for u, v in edges:
        label = [min(label[u], label[v]) if x in (label[u], label[v]) else x for x in label]
    found, n = rounds(monkeypatch, spark, edges)
    assert found == {i: x for i, x in enumerate(label) if x != i} and n < 8
