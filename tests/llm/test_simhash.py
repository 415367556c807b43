"""SimHash groups against brute force, large lists and odd inputs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from geoloom.llm import simhash
from tests.llm.test_operators import WORD, all_docs, odd_docs


def print_by_hand(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints):
    """The smallest member of each one's group; prints: {id: fingerprint}."""
    ids, head = sorted(prints), {}
    for start in ids:
        if start in head:
            continue
        head[start], open_ = start, [start]
        while open_:
            x = open_.pop()
            for y in ids:
                if y not in head and (prints[x] ^ prints[y]).bit_count() <= 3:
                    head[y] = start
                    open_.append(y)
    return head


def test_fingerprints_by_hand():
    for text in ("", "one", "one Two", "Ä b c d e", "a a a a b", "x " * 70_000 + "y", " \n\t", "naïve 東京 🙂 end"):
        assert simhash.fingerprint(text.encode()) == print_by_hand(text)


def test_spark_hashes_equal(spark):
    row = spark.sql("SELECT xxhash64('ein zwei drei') AS h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"ein zwei drei", 42)


def test_groups(spark, sf_dir):
    docs = all_docs(spark, sf_dir)
    prints = {r.doc_id: print_by_hand(r.text or "") for r in docs.collect()}
    heads = groups_of(prints)
    rows = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id, r.kept) for r in rows} == {i: (f"{p:016x}", heads[i], heads[i] == i) for i, p in prints.items()}


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    blank = [r for r in rows if r.fingerprint == "0" * 16]
    assert sorted(r.doc_id or 0 for r in blank) == [0, 4, 5, 6] and {r.component_id for r in blank} == {4} and {r.n_equal for r in blank} == {4}
    assert {(r.fingerprint, r.component_id) for r in rows if r.doc_id in (7, 8)} == {(f"{print_by_hand('two words'):016x}", 7)}
    assert all((r.component_id is None) <= (r.doc_id is None) for r in rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    nameless = docs.where("doc_id is null").select("doc_id", "text")
    assert {r.component_id for r in simhash.near_duplicates(nameless).collect()} == {None}


def planted(n):
    """Chance fingerprints, and clusters whose members differ from a centre, or from one another in chains, by few bits."""
    rng = random.Random(5)
    found = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(6):
        x = centre = rng.getrandbits(64)
        for _ in range(n // 12):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            x ^= sum(1 << b for b in rng.sample(range(64), 3))
            found |= {centre ^ flips, x}
    return sorted(found)


@pytest.mark.parametrize("limit", [2, 40, simhash.LISTED])
def test_lists_hold_every_near_pair(spark, limit):
    prints = planted(600)
    rows = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "print long")
    lists = simhash.candidate_lists(rows, limit).groupBy(*simhash.LIST).agg(F.collect_list("print").alias("p")).collect()
    if limit > 2:
        assert max(len(r.p) for r in lists) <= 3 * limit
    together = {(a % 2**64, b % 2**64) for r in lists for a in r.p for b in r.p if a % 2**64 < b % 2**64}
    near = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 3}
    assert near and near <= together
    # Links of the lists join what near pairs join.
    keys = np.concatenate([[[i, 0, 0]] * len(r.p) for i, r in enumerate(lists)])
    members = np.concatenate([np.array(r.p, np.int64) for r in lists]).view(np.uint64)
    links = {(int(a) % 2**64, int(b) % 2**64) for a, b in simhash.list_links(keys, members)}
    assert {tuple(sorted(x)) for x in links} <= near
    head = {p: p for p in prints}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in links:
        head[max(root(a), root(b))] = min(root(a), root(b))
    assert all(root(a) == root(b) for a, b in near)


def test_shared_bytes():
    rng = np.random.default_rng(3)
    x, y = (rng.integers(0, 2**63, 2000, dtype=np.uint64) for _ in range(2))
    y = np.where(rng.random(2000) < 0.5, x ^ (np.uint64(255) << (np.uint64(8) * rng.integers(0, 8, 2000).astype(np.uint64))), y)
    byte = lambda v: v.view(np.uint8).reshape(-1, 8)
    assert (simhash.shared_bytes(x, y) == (byte(x) == byte(y)).sum(axis=1)).all()


def test_one_large_list_gives_few_links():
    centre = np.uint64(0x0123456789ABCDEF)
    members = centre ^ np.array([0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i in range(64) for j in range(i))], np.uint64)
    links = simhash.list_links(np.zeros((len(members), 3), np.int64), members)
    assert len(links) == len(members) - 1


def test_words_are_as_stated():
    text = "a\x0bb\x0cc\xa0d\x1ce"
    assert re.split(r"[\x20\x09-\x0D]+", text) == WORD.findall(text)
    assert simhash.fingerprint(text.encode()) == print_by_hand(text)
