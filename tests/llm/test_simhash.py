"""SimHash near duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash
from llm_tables import prose
from pyspark.sql import functions as F

from aquifer.llm import simhash
from aquifer.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text: str | None) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(fps: list[int], ids: list[int | None]) -> list[int | None]:
    """The smallest id in each row's class, by comparing all pairs."""
    arr = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= 2):
            root[find(i)] = find(i + 1 + int(j))
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(fps))]


def held(got, rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted((str(i), f"{fp:016x}", str(c)) for (i, _), fp, c in zip(rows, fps, brute_components(fps, [i for i, _ in rows])))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got.collect()) == want


def test_query_on_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    held(QUERIES["op11_simhash_segments"](spark, SF), rows)


def test_edges_and_clashing_columns(spark, edge_docs):
    docs = edge_docs.withColumns({c: F.lit("x") for c in ("fp", "fingerprint", "component_id", "c", "v", "least", "point")})
    held(simhash.join(docs), [(r.doc_id, r.text) for r in edge_docs.collect()])


def test_empty_table(spark, no_docs):
    out = simhash.join(no_docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


def test_large_groups_of_near_and_exact_copies(spark):
    rng = random.Random(5)
    base = prose(1, 400).split()
    near = []
    for k in range(500):
        words = list(base)
        words[rng.randrange(len(words))] = f"other{k}"
        near.append(" ".join(words))
    texts = near + [prose(2, 50)] * 400 + [None] * 200 + [prose(100 + k, 60) for k in range(100)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    held(simhash.join(spark.createDataFrame(rows, "doc_id long, text string"), crowd=8), rows)


@pytest.mark.parametrize("crowd", [2, 8, 10_000])
def test_links_connect_as_all_pairs_do(spark, crowd):
    """Chains and dense balls: the grid with either embedding gives the same classes as all pairs."""
    rng = random.Random(crowd)
    fps = {0, 2 ** 64 - 1, 2 ** 63}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(30):
            fps.add(x)
            for _ in range(rng.choice((1, 2, 2, 3))):
                x ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    fps = sorted(fps)
    signed = [x - (x >> 63 << 64) for x in fps]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = [(r.a, r.b) for r in simhash.links(distinct, crowd=crowd).collect()]
    assert all((a ^ b & (2 ** 64 - 1)).bit_count() <= 2 or ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2 for a, b in got)
    label = {x: x for x in signed}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in got:
        label[find(a)] = find(b)
    want = brute_components(fps, list(range(len(fps))))
    groups = {}
    for x, c in zip(signed, want):
        groups.setdefault(find(x), set()).add(c)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))
