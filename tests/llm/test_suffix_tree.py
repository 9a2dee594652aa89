"""The suffix tree's scores against a tree of dictionaries, and its long contexts."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fluxtide.llm import pst

OTHER, END, BEGIN = "<other>", "<end>", "<begin>"


def words(text):
    return (text or "").lower().split()


def brute_scores(train, texts, s):
    """log10 probabilities by contexts kept as tuples."""
    d = s.discount
    c = Counter(w for t in train for w in words(t))
    n_tokens, n_ends = sum(c.values()) + len(train), len(train)
    known = {w for w, n in c.items() if n >= max(1.0, s.p_word * n_tokens)}
    often = {w for w in known if c[w] >= s.p_symbol * n_tokens}
    symbol = lambda w: w if w in often else OTHER
    kinds, other = len(c) + 1, sum(c[w] for w in c if w not in often)
    root = {w: (c[w] + 1) / (n_tokens + len(often) + 2) for w in often} | {OTHER: (other + 1) / (n_tokens + len(often) + 2), END: (n_ends + 1) / (n_tokens + len(often) + 2)}
    line = lambda t: [symbol(w) for w in words(t)] + [END]
    levels = []  # of {context: (rest, {symbol: share})}

    def chance(before, x, upto):
        p = root[x]
        for k in range(1, upto + 1):
            state = levels[k - 1].get(tuple(before[-k:])) if len(before) >= k else None
            if state and state[0] < 1.0:
                p = state[1].get(x, 0.0) + state[0] * p
        return p

    contexts = {(x,) for x in [*often, OTHER, END, BEGIN]}
    for length in range(1, s.order + 1):
        follow = defaultdict(Counter)
        for t in train:
            seq = [BEGIN, *line(t)]
            for i in range(1, len(seq)):
                ctx = tuple(seq[max(0, i - length) : i])
                if len(ctx) == length and ctx in contexts:
                    follow[ctx][seq[i]] += 1
        level, longer = {}, set()
        for ctx in contexts:
            seen, total = follow[ctx], sum(follow[ctx].values())
            kept = {x: n for x, n in seen.items() if n >= max(2.0, s.p_emit * n_tokens)}
            share = {x: (n - d) / total for x, n in kept.items()}
            rest = 1.0 - sum(share.values())
            below = {x: chance(ctx[1:], x, length - 1) for x in kept}
            own = {x: share[x] + rest * below[x] for x in kept}
            far = sum(own[x] * math.log(own[x] / below[x]) for x in kept) + (rest * math.log(max(rest, 1e-12)) * (1 - min(sum(below.values()), 1)) if rest > 0 else 0)
            level[ctx] = (rest, share) if total and far >= s.divergence else (1.0, {})
            longer |= {(*ctx, x) for x, n in kept.items() if n >= s.p_context * n_tokens and x != END}
        levels.append(level)
        contexts = {x for x in longer if x[1:] in level}
        if not contexts:
            break

    # Long contexts: the words before a place, counted in the training texts.
    deep = defaultdict(Counter)
    for t in train:
        w, x = words(t), line(t)
        for i in range(s.deep, len(x)):
            deep[tuple(w[i - s.deep : i])][x[i]] += 1
    out = []
    for t in texts:
        w, x, score, n_deep = words(t), line(t), 0.0, 0
        for i, sym in enumerate(x):
            before = [BEGIN, *x[:i]]
            p = chance(before, sym, len(levels))
            seen = deep.get(tuple(w[i - s.deep : i])) if i >= s.deep else None
            if seen and sum(seen.values()) >= s.deep_least:
                total = sum(seen.values())
                share, rest = {k: (n - d) / total for k, n in seen.items()}, d * len(seen) / total
                below = {k: chance(before, k, len(levels)) for k in seen}
                far = sum((share[k] + rest * below[k]) * math.log((share[k] + rest * below[k]) / below[k]) for k in seen) + rest * math.log(rest) * max(1 - sum(below.values()), 0)
                if far >= s.divergence:
                    p, n_deep = share.get(sym, 0.0) + rest * p, n_deep + 1
            score += math.log10(p)
            if sym == OTHER:
                score += math.log10((c[w[i]] + 1) / (other + (kinds - len(often) - 1) + 1))
        out.append((score, n_deep))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    base = [" ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.choice((3, 9, 40)))) for _ in range(12)]
    rows = [r.choice(base) + " " + " ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(12))) for _ in range(n)]
    return rows + ["", None, "ax", rows[0], rows[0].upper()]


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_equal_a_tree_of_dictionaries(spark, seed):
    s = pst.Settings(p_word=1e-3, p_symbol=4e-3, p_context=4e-3, p_emit=1e-3, divergence=0.02, deep=4, deep_share=1)
    rows = corpus(seed)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in pst.score(d, settings=s, split=F.col("doc_id") % 5 == 2).collect()}
    want = brute_scores([t for i, t in enumerate(rows) if i % 5 != 2], rows, s)
    assert sum(n for _, n in want) > 100
    for i, (score, n_deep) in enumerate(want):
        assert got[i]["n_deep"] == n_deep and got[i]["score"] == pytest.approx(score, abs=1e-7), i


def test_long_contexts_are_those_of_the_words():
    import numpy as np

    rng = np.random.default_rng(1)
    each = rng.integers(0, 5, 400).astype(np.uint64)
    begun = np.concatenate([np.arange(250), np.arange(150)])
    s = pst.Settings(deep=3, deep_share=1)
    at, ctx = pst.long_contexts(each, begun, s)
    assert at.tolist() == [i for i in range(400) if begun[i] >= 3]
    spelt = {}
    for i, h in zip(at.tolist(), ctx.tolist()):
        assert spelt.setdefault(h, tuple(each[i - 3 : i].tolist())) == tuple(each[i - 3 : i].tolist())
    assert len(spelt) == len({tuple(each[i - 3 : i].tolist()) for i in at.tolist()})
    some = set(pst.long_contexts(each, begun, pst.Settings(deep=3, deep_share=4))[0].tolist())
    assert some < set(at.tolist()) and len({h for i, h in zip(at.tolist(), ctx.tolist()) if i in some}) < len(spelt)
    assert len(pst.long_contexts(each[:2], begun[:2], s)[0]) == 0


def test_what_is_learned_grows_with_the_corpus(spark):
    """Texts that occur twice among many have long contexts, others none; twice as many such
    texts give twice as many states.  Relative frequencies are those of a large corpus, where two
    occurrences are too few for the short levels."""
    r = random.Random(3)
    fresh = lambda: " ".join(f"v{r.randrange(20_000)}" for _ in range(60))
    made = {}
    for n in (40, 80):
        twice = [fresh() for _ in range(n)]
        rows = [*twice, *twice, *[fresh() for _ in range(4 * n)]]
        d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
        got = pst.score(d, settings=pst.Settings(p_context=1e-2, p_emit=1e-2, deep_share=4), split=F.lit(False)).toPandas().sort_values("doc_id")
        made[n] = got["n_deep"][: 2 * n].sum()
        assert (got["n_deep"][2 * n :] == 0).all() and (got["n_deep"][: 2 * n] > 0).mean() > 0.95
        each = (got["score"] - got["base_score"]) / got["n_tokens"]
        assert each[: 2 * n].mean() > each[2 * n :].mean() + 0.2
    assert 1.7 < made[80] / made[40] < 2.3


def test_every_repeated_long_context_is_a_state(spark, monkeypatch):
    """By default no long context is left out: in texts that occur twice every place after the
    first six words is scored from one, in however many segments and blocks."""
    monkeypatch.setattr(pst, "SEGMENT", 50)
    r = random.Random(5)
    fresh = lambda: " ".join(f"v{r.randrange(20_000)}" for _ in range(40))
    twice = [fresh() for _ in range(30)]
    rows = [*twice, *twice, *[fresh() for _ in range(90)]]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["n_deep"] for x in pst.score(d, settings=pst.Settings(p_context=1e-2, p_emit=1e-2), split=F.lit(False)).collect()}
    assert [got[i] for i in range(60)] == [35] * 60 and all(got[i] == 0 for i in range(60, 150))


def test_only_contexts_that_may_repeat_move_whole(spark):
    """Texts that occur twice move all their places with a long context, the others next to none;
    stored texts are not shuffled for it."""
    r = random.Random(7)
    fresh = lambda: " ".join(f"v{r.randrange(20_000)}" for _ in range(40))
    twice = [fresh() for _ in range(30)]
    rows = [*twice, *twice, *[fresh() for _ in range(240)]]
    d = spark.createDataFrame([(t, i % 90 == 89) for i, t in enumerate(rows)], "text string, held_out boolean").repartition(4)
    s = pst.Settings(p_context=1e-2, p_emit=1e-2)
    tree = pst.dictionary(d, pst.written(pst.word_counts(d)), s)
    coded = pst.encoded(d.withColumn("id", F.lit(0)), tree).withColumn("row", F.monotonically_increasing_id())
    coded = pst.written_by(coded.withColumn("block", F.col("row") - F.col("nth")), "block")
    coded = pst.hashed(coded)
    marked = pst.marked_places(coded, tree, s)
    assert marked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    sent = pst.deep_places(coded, pst.written(marked), tree, s).select(F.sum(F.length("ctx")) / 6).first()[0]
    assert 60 * 35 <= sent <= 60 * 35 + 0.1 * 240 * 35


def test_packed_numbers():
    import numpy as np

    numbers = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**32, 2**63 - 1, 2**63, 2**64 - 1, 5], np.uint64)
    packed, begun = pst.varints(numbers)
    assert pst.numbers_of(packed).tolist() == numbers.tolist()
    assert np.diff(begun).tolist() == [1, 1, 1, 2, 2, 2, 3, 5, 9, 10, 10, 1]
    assert pst.numbers_of(packed[begun[3] : begun[7]]).tolist() == numbers[3:7].tolist()
    assert len(pst.numbers_of(pst.varints(numbers[:0])[0])) == 0


def test_places_of_keys():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 5, 3000):
        keys = np.unique(rng.integers(0, 1 << 40, n))
        wanted = np.concatenate([rng.choice(keys, 5 * n), rng.integers(-1, 1 << 40, 5 * n), keys + 1, [-1, 0]])
        at = {k: i for i, k in enumerate(keys.tolist())}
        assert pst._place(keys, wanted).tolist() == [at.get(x, -1) for x in wanted.tolist()]


def test_words_of_texts_with_blanks_at_their_ends():
    import pyarrow as pa

    texts = ["", "  a B\tc  ", None, "\x0b\x0cÄx\x1c \x85 É z\r\n", " ", "a", "q\x1fr"]
    for kind in (pa.string(), pa.large_string()):
        got, edges = pst._words(pa.array(["zz", *texts, "yy"], kind).slice(1, len(texts)))
        got = got.to_pylist()
        assert [got[i:j] for i, j in zip(edges, edges[1:])] == [(t or "").encode().lower().split() for t in texts]
