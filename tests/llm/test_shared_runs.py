"""Shared passages of the suffix operator against brute force over word runs."""

import random

from fluxtide.llm import suffix

SCHEMA = "doc_id long, text string, lang string, H string"


def test_passages_of_51_words_are_found(spark):
    rng = random.Random(7)
    own = lambda n: [f"{rng.choice('abcdefghijk')}{rng.randrange(400)}" for _ in range(n)]
    passages, texts = [own(51), own(50), own(24), own(300)], []
    for p in passages:
        for _ in range(3):
            text = own(rng.randrange(120)) + p + own(rng.randrange(120))
            texts.append(rng.choice((" ", "\n", "\t ")).join(text))
    texts += [" ".join(own(400)) for _ in range(20)] + [None, "", " \n", "a b", " ".join(own(51)), texts[0].upper()]
    texts += [" ".join(["x"] * 60), " ".join(["y"] * 60)] + ["z " * 5000] * 2
    docs = spark.createDataFrame([(i, t, "en", "h") for i, t in enumerate(texts)] + [(None, texts[0], "en", "h")], SCHEMA).repartition(4)
    words = [(t or "").lower().split() for t in texts]
    found = {r["doc_id"]: r["n_shared_runs"] for r in suffix.shared_runs(docs).collect()}

    def shared(n):
        runs = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in [*words, words[0]]]
        return {i for i in range(len(words)) if any(runs[i] & r for j, r in enumerate(runs) if j != i)}

    assert len(shared(51)) >= 9 and shared(51) <= set(found) - {None} <= shared(25)
    assert None in found and min(found.values()) > 0
    assert suffix.shared_runs(docs.limit(0)).count() == 0


def test_a_long_text_is_read_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 64)
    rng = random.Random(8)
    p = [f"p{rng.randrange(99)}" for _ in range(51)]
    for at in range(0, 130, 13):
        a, b = ([f"{k}{rng.randrange(9999)}" for _ in range(300)] for k in "ab")
        a[at : at + 51], b[200 - at : 251 - at] = p, p
        found = suffix.shared_runs(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id int, text string"))
        assert {r["doc_id"] for r in found.collect()} == {1, 2}
        if at == 26:
            break
