"""Repeated passages, hard negatives and tokenizer alignment against plain loops, on fixtures and on whole sf0.01 tables."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthloom.llm import alignment, negatives, phrases
from monthloom.llm.registered import PIECE_TOKENIZER, TOKENIZER, QUERIES

SF = "/root/testdata/sf0.01"


def _passages_brute(rows: list[tuple], width: int = 13) -> dict:
    first: dict[tuple, int] = {}
    for doc_id, text in rows:
        words = phrases.split_words(text)
        if doc_id is None:
            continue
        for s in range(len(words) - width + 1):
            key = tuple(words[s : s + width])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = {}
    for doc_id, text in rows:
        words = phrases.split_words(text)
        removed = [False] * len(words)
        if doc_id is not None:
            for s in range(len(words) - width + 1):
                if first[tuple(words[s : s + width])] < doc_id:
                    removed[s : s + width] = [True] * width
        kept = " ".join(w for w, r in zip(words, removed) if not r)
        out[doc_id] = (len(words), sum(removed), hashlib.sha256(kept.encode()).hexdigest())
    return out


def _prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "Delta", "eps,", "zeta."]) for _ in range(n))


def test_passages_against_brute_force_on_edge_cases(spark):
    shared = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, None), (2, ""), (3, " \t\r\n "), (4, "a b c"), (5, "pre " + shared + " post"), (6, shared),
        (7, "x\x1cy " + shared[:60]), (8, _prose(1, 5000) + "\n\n" + shared), (9, shared), (9, shared),
        (None, shared), (10, "A " * 30), (11, "A\tA\nA " * 10), (12, _prose(1, 5000)[:4000]), (13, "é漢 😀 " * 20),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit(5)).withColumn("h1", F.lit("x"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in phrases.repeated_passages(df, width=13).collect()}
    assert got == _passages_brute(rows)
    assert len(phrases.repeated_passages(df, width=13).collect()) == len(rows)


def test_passages_with_small_shards_and_groups(spark):
    rows = [(i, _prose(i % 3, 300) + " " + _prose(100 + i, 50)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = phrases.repeated_passages(df, width=13, shard_bytes=2000, group_bytes=3000, salts=3).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == _passages_brute(rows)


def test_passages_of_equal_ids_and_different_texts(spark):
    shared = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "a " + shared), (1, "b " + shared), (2, "c " + shared[:90]), (2, "d\u00a0d\x0b" + shared), (None, shared), (None, None)]
    got = phrases.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = Counter((r[0], *_passages_brute([(1, "a " + shared), r])[r[0]]) for r in rows[2:4]) + Counter(
        (r[0], *_passages_brute([r])[r[0]]) for r in rows[:2] + rows[4:]
    )
    assert Counter(tuple(r) for r in got) == want


def test_equal_windows_have_equal_anchors_and_few_windows_are_candidates():
    reader = phrases.Reader()
    texts = [" ".join(f"{t}{i}" for i in range(400)) + " " + " ".join(f"s{i}" for i in range(30)) for t in "ab"]
    words = reader.words([t.encode() for t in texts])
    first, text = words.windows(13)
    anchors = words.anchors(13, first)
    assert len(first) == 2 * 418 and len(np.unique(anchors)) < 0.4 * len(anchors)
    both = np.isin(anchors, np.intersect1d(anchors[text == 0], anchors[text == 1]))
    shared = first - words.bounds[text] >= 400
    # Up to 7 windows before the shared words lie half in them and may have an anchor of theirs.
    assert both[shared].all() and shared.sum() == 36 and both.sum() <= 36 + 2 * 7


def test_passages_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert phrases.repeated_passages(df).collect() == []


def test_registered_passages_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op11_phrase_automata"](spark, SF).collect()}
    want = _passages_brute(docs)
    assert got == want
    assert sum(v[1] > 0 for v in want.values()) > 10


def _negatives_brute(rows: list[tuple], scale: int = 256, top: int = 5) -> list[tuple]:
    clean = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        row = (vec_id, label, [math.floor(scale * float(x)) for x in vector])
        same = [c for c in clean if c[0] == vec_id]
        if not same:
            clean.append(row)
        elif row[1:] < same[0][1:]:
            clean[clean.index(same[0])] = row
    out = []
    for a_id, a_label, a_q in clean:
        if a_id % 100:
            continue
        dot = lambda q: sum(x * y for x, y in zip(q, a_q))
        same = sorted(((-dot(q), v) for v, lab, q in clean if lab == a_label and v != a_id))[:top]
        for neg_ps, p_id in same:
            ps = -neg_ps
            found = sorted((-dot(q), v) for v, lab, q in clean if lab != a_label and 80 * ps <= 100 * dot(q) <= 100 * ps)[:top]
            out += [(a_id, p_id, rank + 1, v, ps, -ns) for rank, (ns, v) in enumerate(found)]
    return sorted(out)


def test_registered_negatives_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_triangle_negatives"](spark, SF).collect())
    want = _negatives_brute(rows)
    assert got == want and len(want) > 0


def test_negatives_edge_cases_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-0.5, 0.25, 0.5, 0.0]) for _ in range(3)], r.randrange(3)) for i in range(0, 1400, 7)]
    rows += [(100, [0.1, 0.2, 0.3], 1), (200, [0.1, None, 0.3], 1), (300, [float("nan"), 0.0, 0.0], 2), (400, None, 1)]
    rows += [(500, [0.0, 0.0, 0.0], 2), (600, [1.0, 1.0, 1.0], None), (700, [0.5, 0.5, 0.5], 0), (700, [0.5, 0.5, 0.5], 0)]
    rows += [(800, [-1.0, -2.0, 0.0], 3), (900, [1e-9, -1e-9, 0.0], 3), (1000, [0.25, 0.25, 0.25], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    relabelled = df.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    got = negatives.hard_negatives(relabelled, F.col("vec_id") % 100 == 0, anchor_block=2, row_block=16, chunk=3)
    assert sorted(tuple(x) for x in got.collect()) == _negatives_brute(rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert negatives.hard_negatives(empty, F.col("vec_id") % 100 == 0).collect() == []


def test_score_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-300, 300, (20, 16)), rng.integers(-300, 300, (50, 16))
    a[0] = 0
    refs = rng.standard_normal((8, 16))
    refs /= np.linalg.norm(refs, axis=1, keepdims=True)

    def stored(m):
        n = np.linalg.norm(m.astype(float), axis=1)
        return n, np.arccos(np.clip((m @ refs.T) / np.where(n > 0, n, 1)[:, None], -1, 1))

    low, high = negatives.score_bounds(*stored(a), *stored(b))
    exact = a @ b.T
    assert (low <= exact).all() and (exact <= high).all()


def _groups_brute(a_end: np.ndarray, b_end: np.ndarray) -> list[tuple]:
    groups, i, j, start = [], 0, 0, (0, 0)
    while i < len(a_end):
        if a_end[i] == b_end[j]:
            groups.append((start[0], i + 1, start[1], j + 1))
            i, j = i + 1, j + 1
            start = (i, j)
        elif a_end[i] < b_end[j]:
            i += 1
        else:
            j += 1
    return groups


def test_diagonal_skipping_equals_plain_merge():
    rng = random.Random(3)
    for _ in range(500):
        cuts = sorted(rng.sample(range(1, 60), rng.randrange(1, 30)))
        total = 60
        a = sorted(set(c for c in cuts if rng.random() < 0.8) | {total})
        b = sorted(set(c for c in cuts if rng.random() < 0.8) | set(rng.sample(range(1, 60), 3)) | {total})
        a_end, b_end = np.array(a), np.array(b)
        assert alignment.aligned_groups(a_end, b_end) == _groups_brute(a_end, b_end)


def _alignment_brute(pair: alignment.Pair, rows: list[tuple]) -> dict:
    per_row, holders = [], Counter()
    for doc_id, text in rows:
        a, b = pair.tokens([text])[0]
        a_bytes = [pair.a_bytes[x] for x in a.tolist()]
        b_bytes = [pair.b_bytes[x] for x in b.tolist()]
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        a_start, b_start = a_end - [len(x) for x in a_bytes], b_end - [len(x) for x in b_bytes]
        links = Counter()
        for x in range(len(a)):
            first, last = np.searchsorted(b_end, a_start[x], "right"), np.searchsorted(b_start, a_end[x], "left")
            links.update((int(a[x]), int(b[y])) for y in range(first, last))
        groups = _groups_brute(a_end, b_end) if len(a) else []
        text_ = ";".join(
            ",".join(map(str, a[g[0] : g[1]].tolist())) + "|" + ",".join(map(str, b[g[2] : g[3]].tolist())) for g in groups
        )
        per_row.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(text_.encode()).hexdigest() if groups else ""))
    for doc_id, links in {(r[0], r[5]): r[4] for r in per_row if r[0] is not None}.items():
        holders.update(set(links))
    best = Counter()
    for (x, _), c in holders.items():
        best[x] = max(best[x], c)
    out = {}
    for doc_id, n_a, n_b, n_groups, links, sha in per_row:
        known = doc_id is not None
        n_best = sum(m for (x, y), m in links.items() if holders[(x, y)] == best[x]) if known else 0
        total = sum(m * holders[p] for p, m in links.items()) if known else 0
        out[(doc_id, sha)] = (n_a, n_b, n_groups, sum(links.values()), n_best, total)
    return out


def _got(df) -> dict:
    return {
        (r["doc_id"], r["groups_sha256"]): (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"])
        for r in df.collect()
    }


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(TOKENIZER, PIECE_TOKENIZER)


def test_alignment_edge_cases_against_brute_force(spark, pair):
    rows = [
        (1, None), (2, ""), (3, "Hello world"), (4, "Hello world"), (4, "Hello world"), (5, "  two  blanks\tand tab"),
        (6, "<|endoftext|> <s> </s> plain"), (7, "é漢😀 \u0001 x" * 50), (None, "Hello there"), (8, "the cat " * 3000),
        (9, "don't we'll 1234567 3.14"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = alignment.alignment_counts(df, TOKENIZER, PIECE_TOKENIZER, salts=3)
    assert _got(got) == _alignment_brute(pair, rows)
    assert got.count() == len(rows)


def test_registered_alignment_against_brute_force(spark, pair):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = _got(QUERIES["op13_diagonal_alignment"](spark, SF))
    assert got == _alignment_brute(pair, rows)
    assert sum(v[4] > 0 for v in got.values()) > 100


def test_maxscore_blocks_equal_brute_force_on_signed_low_dimensions():
    from monthloom.llm.topk import Postings

    rng = np.random.default_rng(11)
    for case in range(3000):
        dims, n, k = int(rng.integers(1, 7)), int(rng.integers(1, 40)), int(rng.integers(1, 12))
        vectors = rng.integers(-5, 6, (n, dims))
        ids = rng.permutation(1000)[:n].astype(np.int64)
        query = rng.integers(-5, 6, dims)
        own = int(ids[0]) if case % 3 == 0 else -1
        scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for start in range(0, n, 7):
            block = Postings(ids[start : start + 7], vectors[start : start + 7])
            scores, found = block.best(query, own, k, scores, found)
        everyone = sorted((-int(v @ query), int(i)) for i, v in zip(ids, vectors) if i != own)[:k]
        assert list(zip((-scores).tolist(), found.tolist())) == everyone, case


def test_alignment_of_a_slice_equals_its_texts_alone(pair):
    texts = [None, "Hello world", "", "é漢😀 \u0001 x", "  two  blanks\tand tab", "don't we'll 1234567 3.14", "Hello world", None]
    tokens = pair.tokens(texts)
    numbers, digests, (offsets, a, b, m) = alignment.align_slice(pair, tokens)
    for i, text in enumerate(texts):
        one, digest, (_, *links) = alignment.align_slice(pair, [tokens[i]])
        assert numbers[i].tolist() == one[0].tolist() and digests[i] == digest[0] and (digests[i] != "") == bool(len(tokens[i][0]))
        assert [x[offsets[i] : offsets[i + 1]].tolist() for x in (a, b, m)] == [x.tolist() for x in links]
        assert _alignment_brute(pair, [(1, text)])[(1, digests[i])][:4] == tuple(numbers[i].tolist())
    assert alignment.align_slice(pair, [])[1] == []


def test_alignment_asks_the_library_when_looked_up_pieces_spell_something_else(pair, monkeypatch):
    want = pair.tokens(["Hello world, again"])[0][0].tolist()
    monkeypatch.setattr(pair.pieces, "encode", lambda texts: [np.array([5, 6], "<u4").tobytes() for _ in texts])
    assert pair.tokens(["Hello world, again"])[0][0].tolist() == want and len(want) > 2
