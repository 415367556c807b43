"""Runs of words against brute force."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from geoloom.llm import runs
from tests.llm.test_operators import WORD, all_docs, odd_docs


def runs_by_hand(t):
    found = {}
    for q in range(1, len(t) // 4 + 1):
        i = 0
        while i + q < len(t):
            s = i
            while i + q < len(t) and t[i] == t[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q) and i > s:
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def row_by_hand(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = runs_by_hand(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def strings(k):
    rng = random.Random(k)
    for _ in range(3000):
        t = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(1, 50))]
        if rng.random() < 0.6:
            t = t[: rng.randint(0, 10)] + t[: rng.randint(1, 6)] * rng.randint(2, 7) + t[: rng.randint(0, 8)]
        yield t * rng.randint(1, 4) + [9] + t if rng.random() < 0.3 else t


def test_next_smaller_suffixes():
    for t in strings(1):
        after, common = runs.next_smaller(t)
        n = len(t)
        assert after == [next((j for j in range(i + 1, n) if t[j:] < t[i:]), n) for i in range(n)]
        for i, (j, c) in enumerate(zip(after, common, strict=True)):
            assert t[i : i + c] == t[j : j + c] and (j + c == n or t[i + c] != t[j + c])


def test_runs_equal_brute_force():
    for t in strings(2):
        want = runs_by_hand(t)
        assert runs.runs_of(t, max(t) + 1) == want
        assert runs.document_runs([str(x) for x in t]) == want


@pytest.mark.parametrize("factor", [1, 2**21, 2**30])
def test_stretches_lose_no_run(factor):
    for t in list(strings(3))[:500]:
        ranges = runs.stretches(np.array(t, np.int64) * factor)
        assert all(any(a <= s and s + m <= b for a, b in ranges) for s, m, _ in runs_by_hand(t))


def test_time_is_linear():
    def seconds(n):
        took = []
        for t in ([0] * n, [0, 1] * (n // 2), ([0, 0, 1, 0, 1] * 40 + [2]) * (n // 201), list(range(n // 100)) * 100):
            began = time.process_time()
            runs.runs_of(t, max(t) + 1)
            took.append(time.process_time() - began)
        return sum(took)

    assert seconds(200_000) < 8 * seconds(50_000) + 0.2


def test_audit(spark, sf_dir):
    for docs in (all_docs(spark, sf_dir), odd_docs(spark)):
        rows = runs.run_audit(docs).collect()
        key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
        assert sorted(map(tuple, rows), key=key) == sorted((row_by_hand(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert runs.run_audit(odd_docs(spark).limit(0)).count() == 0


def test_collapsed():
    words = "so it goes on and on and on and on and on and no".split()
    found = runs.document_runs(words)
    assert found == [(3, 10, 2)]
    assert " ".join(runs.collapsed(words, found)) == "so it goes on and no"
