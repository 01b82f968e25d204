"""Exact, near and substring duplicates and their edge cases against direct loops."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import exact_dedup, near_dedup, substring_dedup
from tidemark.llm.textwords import text_slices, words_of

EDGES = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a"), (4, " \n\t"), (5, "x" * 300_000), (6, "ü é\x0bß"), (7, "a")]


def vocabulary(seed, n=4000):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def test_words_and_slices():
    texts = ["", "one  two\nthree", None, "\x1cfour five ", "eightchr ninechars_"]
    w = words_of(pa.array(texts, pa.string()))
    got = [[w.data[a:b].tobytes().decode() for a, b, r in zip(w.start, w.end, w.row) if r == k] for k in range(5)]
    assert got == [[], ["one", "two", "three"], [], ["\x1cfour five"], ["eightchr", "ninechars_"]]
    assert len(set(w.hash.tolist())) == 6
    batch = pa.RecordBatch.from_arrays([pa.array(["ab"] * 10 + ["c" * 50])], ["t"])
    assert [s.num_rows for s in text_slices([batch], "t", 8)] == [4, 4, 2, 1]


def test_exact_duplicates(docs):
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs(EDGES)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1, sha("")] == (2, 2, False) and got[2, sha("")] == (2, 2, True)
    assert got[7, sha("a")] == (7, 4, True) and got[None, sha("a")] == (7, 4, False) and got[3, sha("a")] == (7, 4, False)
    assert got[5, sha("x" * 300_000)] == (5, 1, True)
    assert exact_dedup.exact_duplicates(docs([])).collect() == []


def test_full_filter_changes_nothing(docs, monkeypatch):
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    monkeypatch.setattr(exact_dedup, "MIN_BITS", 64)
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 64)
    monkeypatch.setattr(exact_dedup, "CHUNKS", 8)
    monkeypatch.setattr(exact_dedup, "HELD_SLOTS", 100)
    got = exact_dedup.exact_duplicates(docs(rows)).collect()
    assert len(got) == 1000 and sum(r.kept for r in got) == 700 and sum(r.group_size == 2 for r in got) == 600


def removed(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = text.split()
        hit = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                hit[k : k + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(hit), " ".join(x for x, h in zip(w, hit) if not h))
    return out


@pytest.mark.parametrize("hot", [2, 256])
def test_substrings_against_a_direct_loop(docs, hot):
    rng, words = random.Random(3), vocabulary(1)
    passages = [" ".join(rng.choices(words, k=rng.randint(20, 60))) for _ in range(5)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choices(words[:60], k=rng.randint(0, 50))) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, rng.choice(passages))
        rows.append((i, "\n".join(parts)))
    rows += [(200, rows[3][1]), (201, "same " * 90), (202, "one two three " * 30), (203, "same " * 25), (204, passages[0])]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.without_repeats(docs(rows), hot=hot).collect()}
    assert got == removed(rows, 20)


def test_substring_edges(docs):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [*EDGES, (8, text), (8, text), (None, text), (9, text + " more")]
    got = {}
    for r in substring_dedup.without_repeats(docs(rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert got[8] == [(30, 0)] * 2 and (30, 30) in got[None] and got[9] == [(31, 30)] and got[1] == [(0, 0)] and got[7] == [(1, 0)]
    assert substring_dedup.without_repeats(docs([])).collect() == []


def test_near_duplicates_against_all_pairs(docs):
    rng, words = random.Random(5), vocabulary(2)
    rows, n = [], 0
    for size in (1,) * 30 + (2,) * 10 + (6, 25):
        base = rng.choices(words, k=rng.randint(40, 90))
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, "few words here"), (n + 2, "few words  here"), (n + 3, "other words here")]
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs(rows)).collect()}
    assert got == {i: find(i) for i in sets}


def test_only_rows_that_may_meet_are_kept_for_buckets_and_features(docs, monkeypatch):
    words, rng = vocabulary(9), random.Random(9)
    rows = [(k, " ".join(rng.choices(words, k=60))) for k in range(200)]
    rows += [(200 + k, f"{rows[k][1]} more") for k in range(5)]
    pinned, passed = {}, []
    pin, chosen = near_dedup.pin, near_dedup.rows_in_plane

    def counted(df, label, **given):
        out = pin(df, label, **given)
        pinned[label] = out.count()
        return out

    def filtered(*given):
        out = chosen(*given)
        passed.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "pin", counted)
    monkeypatch.setattr(near_dedup, "rows_in_plane", filtered)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs(rows)).collect()}
    assert got == {i: i if i < 200 else i - 200 for i, _ in rows}
    assert pinned["sketches"] == 205 and 0 < pinned["meeting"] < 400  # of 205 x 32
    assert 10 <= passed[0] < 30


def test_near_duplicate_edges(docs):
    got = near_dedup.near_duplicates(docs(EDGES)).collect()
    assert len(got) == len(EDGES)
    assert {(r.doc_id, r.class_id) for r in got if r.doc_id in (1, 2, 4)} == {(1, 1), (2, 1), (4, 4)}
    assert {(r.doc_id, r.class_id, r.class_size) for r in got if r.text_key == got[[x.doc_id for x in got].index(7)].text_key} == {(3, 3, 4), (None, 3, 4), (7, 3, 4)}
    assert near_dedup.near_duplicates(docs([])).collect() == []


def test_pairs_of_plain_similarity_become_candidates():
    # Texts of 27 shingles that share 24, plain similarity 0.8; the shared ones are those of a group with a third of all rows.
    rng = np.random.default_rng(4)
    n, plain, weighted = 400, 0, 0
    for seed in (11, 12):
        sets, weights = [], []
        for _ in range(n):
            shared, a, b = np.split(rng.choice(1 << 32, 30, replace=False).astype(np.uint32), [24, 27])
            for own in (a, b):
                one = np.concatenate([shared, own])
                order = np.argsort(one)
                sets.append(one[order])
                weights.append(np.concatenate([np.full(24, 0.35), np.ones(3)])[order])
        x = near_dedup.both_sketches(np.repeat(np.arange(2 * n), 27), np.concatenate(sets), np.concatenate(weights).astype(np.float32), 2 * n, seed)
        a, b = x[::2], x[1::2]
        meets = (near_dedup.bands_of(a) == near_dedup.bands_of(b)).any(1)
        plain += (meets & (near_dedup.agreement(a, b) >= near_dedup.MIN_AGREEMENT)).sum()
        weighted += ((a == b)[:, : near_dedup.SAMPLES].mean(1) >= near_dedup.MIN_AGREEMENT).sum()
        assert abs((a == b)[:, near_dedup.SAMPLES :].mean() - 0.8) < 0.02
    print(f"pairs: {2 * n}, candidates: {plain}, by weighted samples alone: {weighted}")
    assert plain == 2 * n and weighted < 0.8 * 2 * n


def test_sketches_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    shingle = np.sort(rng.choice(1 << 32, 600, replace=False).astype(np.uint32))
    weight = rng.random(600).astype(np.float32) + 0.2
    a, b = np.arange(0, 450), np.arange(150, 600)
    row = np.concatenate([np.zeros(450, np.int64), np.ones(450, np.int64)])
    both = np.concatenate([a, b])
    truth = weight[150:450].sum() / weight.sum()
    shares = [(lambda s: (s[0] == s[1]).mean())(near_dedup.sketches(row, shingle[both], weight[both], 2, seed)) for seed in range(12)]
    assert abs(np.mean(shares) - truth) < 0.05
