"""Merkle manifests, periodic runs and exact groups against brute force: small tables with
nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables; and the
registered queries over a given table."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluxtide.llm import exact, merkle, periods, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def make_text(n, of=("The", "of", "plan", "ÉTÉ", "x1", "tree,")):
    return "".join(rng.choice(of) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n))


BASE = [make_text(60) for _ in range(5)]
PERIODIC = " ".join(["a b c d e"] * 9)
ROWS = [(i, rng.choice(BASE) if i % 3 else make_text(20), rng.choice(["en", "de", None, "é", ""]), rng.choice(["a", None]), i) for i in range(90)]
ROWS += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \n\t ", "en", "b", 0), (103, "one", "fr", "b", 3), (104, make_text(30000), "en", "c", 9), (5, ROWS[5][1], ROWS[5][2], ROWS[5][3], 5), (None, BASE[0], "en", "a", 1), (None, None, None, None, None), (None, None, None, None, None), (105, PERIODIC + " tail", "en", None, 1), (106, "w " * 700, "en", None, 1), (107, BASE[1].replace("\n", " \n "), "en", "a", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()
    return d.withColumns({c: F.lit(7) for c in ("id", "run", "place", "key", "sha", "n_bytes", "tree", "pos", "n", "leaf", "block", "levels", "up", "root", "keep_id", "kept", "start", "address", "_sha", "_at")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def low(t):
    return None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# --- 11 ----------------------------------------------------------------------------------


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, i):
    for level in levels[:-1]:
        r = i - i % 8
        yield "".join(level[r:i]), "".join(level[i + 1 : r + 8])
        i //= 8


def brute_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(part, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t))))
    place = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))
    langs = sorted({r["lang"] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    groups = {g: sorted((r for r in rows if r["lang"] == g), key=place) for g in langs}
    trees = {g: levels_of([leaf(r, r["text"]) for r in groups[g]]) for g in langs}
    top = levels_of([trees[g][-1][0] for g in langs])
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            proof = [*siblings(trees[g], i), *siblings(top, k)]
            forged = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            node = leaf(r, low(r["text"]) if forged else r["text"])
            for a, b in proof:
                node = sha(a + node + b)
            yield r["doc_id"], trees[g][0][i], trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), node, node == top[-1][0]


def manifest_rows(df):
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    out = merkle.verify(merkle.manifest(df, tampered={"text": merkle.lower_ascii(F.col("text"))}, where=third))
    return [tuple(r) for r in out.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def test_manifest_of_odd_rows(docs):
    same(manifest_rows(docs), brute_manifest(docs.collect()))


def test_manifest_over_several_stages(spark, monkeypatch):
    """Blocks of 8 leaves, so that 700 documents take four stages."""
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = spark.range(700).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.when(F.col("id") % 50 == 0, "few").when(F.col("id") > 10, "many").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    same(manifest_rows(rows), brute_manifest(rows.collect()))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 512, 513])
def test_manifest_of_one_group(spark, n):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("A").alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    same(manifest_rows(rows), brute_manifest(rows.collect()))


def test_manifest_of_an_empty_table(empty):
    assert manifest_rows(empty) == []


# --- 12 ----------------------------------------------------------------------------------


def brute_runs(w):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(12, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((a, n, p) for (a, n), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text, plant=True):
    w = WORDS.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if plant and doc_id is not None and h % 10 == 0 and n:
        a, p = (h // 10) % n, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for a, m, p in runs for i in range(a + p, a + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (doc_id, len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4), sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_brute_force():
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 8)):
            n, k = rng.choice([0, 1, 11, 12, 30, 100, 250]), rng.choice([1, 2, 3, 40])
            t = [rng.randrange(k) for _ in range(n)]
            if n > 12 and rng.random() < 0.5:
                p, a = rng.randint(1, n // 2), rng.randrange(n)
                for i in range(a + p, n):
                    t[i] = t[i - p]
            texts.append(np.array(t, np.int64))
        for t, runs in zip(texts, periods.find_runs(texts)):
            assert [tuple(r) for r in runs.tolist()] == brute_runs(t.tolist())


def test_grammar_extensions_both_ways():
    for n, k in ((50, 2), (3000, 3), (3000, 1)):
        s = np.append(np.random.default_rng(n).integers(0, k, n), k)
        g = periods.Grammar(s)
        i = np.arange(0, n - 1, 7)
        j = np.minimum(i + 1 + i % 40, n)
        word = s.tolist()

        def agree(a, b):
            m = 0
            while b + m < len(word) and word[a + m] == word[b + m]:
                m += 1
            return m

        assert g.lce(i, j).tolist() == [agree(a, b) for a, b in zip(i.tolist(), j.tolist())]
        word = word[::-1]
        assert g.reversed().lce(i, j).tolist() == [agree(a, b) for a, b in zip(i.tolist(), j.tolist())]
        assert len(g.symbols[-1]) <= periods.TOP


def test_run_digests_of_odd_rows(docs, empty):
    rows = [r for r in docs.collect() if len(r["text"] or "") < 50_000]
    got = {repr(tuple(r)) for r in periods.run_digests(docs, change=periods.planted).collect()}
    assert {repr(brute_digest(r["doc_id"], r["text"])) for r in rows} <= got
    assert periods.run_digests(docs).count() == len(ROWS) and periods.run_digests(empty).collect() == []
    plain = {r["doc_id"]: r for r in periods.periodic_runs(docs).collect() if r["doc_id"] is not None}
    assert [tuple(x) for x in plain[105]["runs"]] == [(0, 45, 5)] and plain[105]["collapsed"] == "a b c d e tail"
    assert [tuple(x) for x in plain[106]["runs"]] == [(0, 700, 1)] and plain[106]["collapsed"] == "w"
    assert plain[100]["runs"] == [] and plain[102]["collapsed"] == ""


def test_run_query_over_a_given_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    few = [r for r in rows if len(WORDS.findall(r["text"] or "")) <= 3000]
    got = {r["doc_id"]: tuple(r) for r in queries.op12_recompression_runs(spark, SF).collect()}
    assert len(got) == len(rows) and all(got[r["doc_id"]] == brute_digest(r["doc_id"], r["text"]) for r in few)


# --- 13 ----------------------------------------------------------------------------------


def brute_groups(rows):
    text = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
    groups = {}
    for r in rows:
        groups.setdefault(text(r), []).append(r["doc_id"])
    best = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(r["doc_id"], best[text(r)], len(groups[text(r)]), sha(text(r))) for r in rows]


@pytest.mark.parametrize("fan", [2, 16])
def test_groups_of_odd_rows(docs, empty, fan, monkeypatch):
    monkeypatch.setattr(exact, "RUN_ROWS", 7)
    got = exact.duplicate_groups(docs, fan=fan).collect()
    want = brute_groups(docs.collect())
    same([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], want)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({x[3] for x in want}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact.duplicate_groups(empty, fan=fan).collect() == []


def test_first_of_each_group_stays(docs, empty):
    out = exact.keep_first(docs)
    assert out.columns == docs.columns and out.count() == len({x[3] for x in brute_groups(docs.collect())})
    assert exact.keep_first(empty).collect() == []


def test_merge_verifies_equal_keys():
    """Rows of one 64-bit key with other digests stay apart; equal ones are counted."""

    def run(rows):
        k, s, i, c = map(np.array, zip(*rows))
        return exact.Rows(k.astype(np.int64), np.stack([s.astype(np.uint64)] * 4, 1), np.full(len(k), 9), i.astype(np.int64), i.astype(np.int64), c.astype(np.int64)).ordered().collapsed()

    out = exact.merge([run([(1, 5, 30, 2), (4, 5, 8, 1)]), run([(1, 6, 20, 1), (1, 5, 10, 1)]), run([(4, 5, 3, 4), (9, 1, 1, 1)])])
    assert list(zip(out.key.tolist(), out.sha[:, 0].tolist(), out.id.tolist(), out.count.tolist())) == [(1, 5, 10, 3), (1, 6, 20, 1), (4, 5, 3, 5), (9, 1, 1, 1)]


def test_many_runs_of_one_text_stay_small(spark):
    """Two thirds of the rows are one text: each round hands on one row a run of it."""
    d = spark.range(4000).repartition(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), "id")).otherwise("same").alias("text"))
    rows = exact._digested(d, "doc_id", "text")
    first = exact._runs(rows, 4, 3)
    sizes = [len(exact._read(pa.record_batch([pa.array([c], pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(r)], names=first.columns))[0]) for r in first.collect()]
    assert sum(sizes) < 4000 / 3 + 2 * 40 + 1
    got = {(r["keep_id"], r["group_size"]) for r in exact.duplicate_groups(d, fan=4).collect() if r["group_size"] > 1}
    assert got == {(1, 4000 - 1334)}
