"""Operators that lay out, encode, join and search whole tables, against brute force and exact round trips."""

import collections
import heapq
import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aquifer.llm import huffman, jaccard_join, mixing, neighbours, packing, tokens
from aquifer.llm.graph import components
from llm_tables import DOCS, TOKENIZERS, prose, words

BYTES, WORDS = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/word_bpe_49k.json"


def library_ids(path, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [np.array([*e.ids, end], np.uint32) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path,drops", [(BYTES, False), (WORDS, True)])
def test_cached_encoder_equals_the_library(path, drops):
    texts = ["a  b   c\n\n d    e　x\n", " x", "x ", "", "don't  'S\x1c y\n \n", "Σας ΣΑΣ İ  1234 é́é", "we're 12ab3",
             "été ÉTÉ\nab—c «d» …\n!", "\n", "\x00 a b", "é x\xa0 y", "<|endoftext|> z", words(1, 500)]
    coder = tokens.Encoder(path, drops, limit=50)
    for _ in range(2):
        got = [np.frombuffer(x, np.uint32) for x in coder.encode([t.encode() for t in texts])]
        assert all((a == b[:-1]).all() and len(a) + 1 == len(b) for a, b in zip(got, library_ids(path, texts, 0)))


@pytest.mark.parametrize("path,drops", [(BYTES, False), (WORDS, True)])
def test_plain_chunks_are_joined_and_equal_the_library(path, drops):
    plain = [c for c in map(chr, range(33, 0x3000)) if not tokens.NOT_PLAIN.search(c)]
    texts = [s.replace("?", c) for c in plain for s in (
        "?", "a?", "?a", "1?1", "-?-", "'?", "?'S", "a?. b,?c", " ?\n?,", "e?\u0301")]
    rng = np.random.default_rng(4)
    parts = [*"aeKLST09.,'-!<=h \n\t", "ß", "É", "İ", "ſ", "×", "½", "ª", "…", "»", "\u0301", "\u0331", "\u0338", "\u0341", "中",
             "σ", "Σ", "Ж", "’", "\x00", "\x01", "\x7f", "\u00ad", "'ll", "don't", " The", "tion", "\ue000", "\U000f0061", "</w>"]
    texts += ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(4000)]
    coder = tokens.Encoder(path, drops)
    asked = []
    coder.library = lambda chunks: [asked.extend(chunks), tokens.Encoder.library(coder, chunks)][1]
    got = coder.encode([t.encode() for t in texts])
    want = library_ids(path, texts, 0)
    assert [t for t, a, b in zip(texts, got, want) if a != b[:-1].tobytes()] == []
    asked.clear()  # new words of plain characters do not go through the whole tokenizer
    many = [words(k, 400) + ", Häuschen. l'été?" for k in range(5)]
    fresh = tokens.Encoder(path, drops)
    fresh.library = coder.library
    assert [x for x in fresh.encode([t.encode() for t in many])] == [x[:-1].tobytes() for x in library_ids(path, many, 0)]
    assert asked == []


@pytest.mark.parametrize("drops", [False, True])
def test_a_file_with_other_rules_goes_through_the_library(tmp_path, drops):
    spec = json.loads(open(WORDS if drops else BYTES, encoding="utf-8").read())
    if drops:  # digits stay together
        spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]+"
    else:
        spec["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    coder = tokens.Encoder(str(path), drops)
    texts = ["The year 1984, don't.", words(3, 200)]
    assert coder.joined is None
    assert coder.encode([t.encode() for t in texts]) == [x[:-1].tobytes() for x in library_ids(str(path), texts, 0)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=400), min_size=1, max_size=12), st.integers(9, 14))
def test_huffman_block_round_trip(documents, limit):
    counts = np.array([len(d) for d in documents], np.int64)
    ids = np.array([x for d in documents for x in d], np.int64)
    seen = np.bincount(ids, minlength=301) if len(ids) else np.zeros(301, np.int64)
    lengths = huffman.code_lengths(seen, limit)
    assert lengths.max() <= limit and (lengths > 0).sum() == (seen > 0).sum()
    payload, offsets = huffman.encode_block(ids, counts, lengths, huffman.canonical_codes(lengths))
    assert (huffman.decode_block(payload, counts, offsets, huffman.decode_table(lengths)) == ids).all()


def test_huffman_lengths_are_optimal_within_the_limit():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 0])
    free = huffman.code_lengths(counts, 30)
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:  # plain Huffman: the merged weights add up to the cost
        merged = heapq.heappop(heap) + heapq.heappop(heap)
        cost += merged
        heapq.heappush(heap, merged)
    assert (counts * free).sum() == cost and free[-1] == 0
    tight = huffman.code_lengths(counts, 4)
    assert tight.max() == 4 and sum(2.0 ** -int(x) for x in tight if x) <= 1
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_huffman_files_round_trip(edge_docs, no_docs):
    rows = edge_docs.where("doc_id is not null").collect()
    want = sorted((r.doc_id, x.tobytes()) for r, x in zip(rows, library_ids(BYTES, [r.text for r in rows], 0)))
    got = huffman.round_trip(edge_docs, BYTES, ids_per_shard=9000).collect()
    assert len(got) == edge_docs.count()
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda i: -1 if i is None else i)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted(
        (i, len(x) // 4, zlib.crc32(x)) for i, x in want)
    assert huffman.round_trip(no_docs, BYTES).count() == 0


def check_pieces(pieces, ids, length):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, own in by_doc.items():
        x, at = ids[doc], 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(x)
            assert p.ids_crc32 == zlib.crc32(x[p.start:p.start + p.length].tobytes())
            at += p.length
        assert at == len(x)
    assert set(by_doc) == set(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == length or at & (at - 1) == 0
    return by_sequence


def test_packing_fills_windows_to_proportion(spark):
    rows = [(i, words(i, 30 + i % 90), "xx", "abc"[i % 3] if i % 7 else None, 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    ids = dict(zip((r[0] for r in rows), library_ids(WORDS, [r[1] for r in rows], 1)))
    pieces = packing.pack(docs, WORDS, length=512).collect()
    sequences = check_pieces(pieces, ids, 512)
    share = collections.Counter()
    for p in pieces:
        share[p.source] += p.length / sum(map(len, ids.values()))
    full = [s for s in sequences.values() if sum(p.length for p in s) == 512]
    assert len(full) > 20
    for s in full:
        for source, part in share.items():
            assert abs(sum(p.length for p in s if p.source == source) - 512 * part) <= 5
    weighted = check_pieces(packing.pack(docs, WORDS, length=512, weights={"a": 3.0, "b": 1.0, "c": 1.0, None: 1.0}).collect(), ids, 512)
    first = weighted[0]
    assert abs(sum(p.length for p in first if p.source == "a") - 256) <= 5


def test_packing_edges(spark, edge_docs, no_docs):
    unique = edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = unique.collect()
    ids = dict(zip((r.doc_id for r in rows), library_ids(WORDS, [r.text for r in rows], 1)))
    check_pieces(packing.pack(unique, WORDS).collect(), ids, 2048)
    total = sum(map(len, library_ids(WORDS, [r.text for r in edge_docs.collect()], 1)))
    assert sum(p.length for p in packing.pack(edge_docs, WORDS, most_queues=2).collect()) == total
    assert packing.pack(no_docs, WORDS).count() == 0


def brute_components(rows):
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets[key] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_jaccard_join_against_brute_force(spark):
    """Groups of copies that differ by a few words: chains, stars, and pairs just above and below the threshold."""
    rng = np.random.default_rng(3)
    rows, key = [], 0
    passage = words(77, 40)
    for g in range(12):
        base = words(500 + g, 60 + 25 * g, 5000).split()
        for copy in range(1 + g * 2):
            text = list(base)
            for _ in range(rng.integers(0, 1 + g)):
                text[rng.integers(len(text))] = f"x{rng.integers(10**6)}"
            if copy % 5 == 4:
                text = text[:len(text) * 4 // 5]
            rows.append((key, " ".join(text) + (" " + passage if g % 3 == 0 else "")))
            key += 1
    rows += [(key + i, words(900 + i, 30, 5000) + " " + passage) for i in range(25)]
    rows += [(900, "a b"), (901, "A B"), (902, None), (903, ""), (904, " \n"), (905, "a b c")]
    docs = spark.createDataFrame([(k, t, "x", "s", 0) for k, t in rows], DOCS).repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_edges(edge_docs, no_docs):
    got = collections.defaultdict(list)
    for r in jaccard_join.join(edge_docs).collect():
        got[r.doc_id].append(r.component_id)
    assert got[1] == [1] and got[2] == [1, 1] and got[3] == [1] and got[4] == [4] and got[5] == [5] and got[6] == [6]
    assert jaccard_join.join(no_docs).count() == 0


def test_jaccard_pairs_are_compared_from_packed_texts(spark):
    """What is stored and dealt out for a class takes fewer bytes than its shingles' hashes, and decides as they do."""
    base = [prose(40 + i, 400).split() for i in range(6)]
    rows = [(2 * i + k, " ".join(b[:400 - 50 * (i % 3)]).upper() if k else " ".join(b))
            for i, b in enumerate(base) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    profiled, _ = jaccard_join.profile(docs, "doc_id", "text")
    of = {r.key: (r.cls, r.n) for r in profiled.collect()}
    classes = profiled.select("cls", profiled.key.alias("named"))
    pairs = spark.createDataFrame([(of[2 * i][0], of[2 * i + 1][0]) for i in range(6)], "a long, b long")
    sets = jaccard_join.sets_of(docs, "doc_id", "text", pairs, classes, 75, 2)
    n = dict(of.values())
    for r in sets.collect():
        assert sum(len(x) for x in r if isinstance(x, (bytes, bytearray))) < 8 * n[r.cls]
    got = {(r.a, r.b) for r in jaccard_join.linked(pairs, sets, 75, 2).collect()}
    assert got == {(r.a, r.b) for i, r in enumerate(pairs.collect()) if i % 3 < 2}  # 300 of 400 words: below 75 %


def test_components_of_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(40))


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([centres[rng.integers(40, size=1500)] + rng.normal(0, 0.15, (1500, 16)), rng.normal(size=(500, 16))])
    x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[100].tolist()) for i in range(150)]
    odd = [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] + [1.0] * 15), (9300, [1.0, 2.0]), (None, [1.0] * 16),
           (9400, [float("inf")] + [1.0] * 15), (9500, [None] + [1.0] * 15), (100, x[100].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    assert set(got) == {i for i, _ in rows if i % 100 == 0}
    ids, all_ = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hit = 0
    for q, found in got.items():
        far = np.sqrt(((all_ - all_[ids == q][0]) ** 2).sum(1))
        want = sorted((f, i) for f, i in zip(far.tolist(), ids.tolist()) if i != q)[:10]
        assert len(found) == 10 and found == sorted(found) and len({i for _, i in found}) == 10
        exact = dict(zip(ids.tolist(), far.tolist()))
        assert all(s == pytest.approx(exact[i], abs=1e-9) for s, i in found)
        hit += len({i for _, i in found} & {i for _, i in want})
    assert hit >= 0.9 * 10 * len(got)


def test_neighbours_in_one_crowded_bucket(spark):
    """A third of the rows are close but different: their bucket is cut into cells, and queries into blocks, and nothing is lost."""
    rng = np.random.default_rng(6)
    x = np.concatenate([5 + rng.normal(0, 1e-3, (300, 8)), rng.normal(0, 4, (600, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    plain = neighbours.nearest(df, every=3, part_rows=8192).orderBy("query_id", "rank").collect()
    cut = neighbours.nearest(df, every=3, part_rows=16).orderBy("query_id", "rank").collect()
    assert cut == plain and len(cut) == 3000
    for q in range(0, 300, 30):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((f, i) for i, f in enumerate(far.tolist()) if i != q)[:10]
        assert [r.vec_id for r in cut if r.query_id == q] == [i for _, i in want]


def test_neighbours_with_few_rows(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [5.0, 5.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(100, 1, 1), (100, 2, 3), (100, 3, 2)]
    assert neighbours.nearest(df.limit(0)).count() == 0 and neighbours.nearest(df.where("vec_id = 100")).count() == 0


def brute_targets(sizes, weights, share=1.5, cap=2.0):
    names = list(sizes)
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        w = sum(weights[n] for n in open_)
        over = {n for n in open_ if weights[n] * left / w > cap * sizes[n]} if w else set()
        if not over:
            target |= {n: weights[n] * left / w for n in open_}
            break
        for n in over:
            target[n] = cap * sizes[n]
            left -= target[n]
        open_ -= over
    return target


def test_mixing_against_brute_force(spark, edge_docs, no_docs):
    rows = [(i, words(i, 10 + i * 37 % 400), "xx", ["a", "b", "é", "Z", None][i * i % 5], 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    want = brute_targets(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    got = mixing.plan(docs, ["doc_id", "source"], shard_words=5000).collect()
    again = mixing.plan(docs.repartition(9), ["doc_id", "source"], shard_words=5000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 64 for s in sizes)
    mixed = mixing.mixed(docs, shard_words=5000)
    assert mixed.columns == docs.columns
    out = collections.Counter()
    for r in mixed.collect():
        out[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert dict(out) == {r.doc_id: r.taken for r in got if r.taken}
    assert mixing.plan(edge_docs).count() == edge_docs.count() and mixing.plan(no_docs).count() == 0
    odd = mixing.mixed(edge_docs)
    assert odd.columns == edge_docs.columns and odd.count() > 0 and mixing.mixed(no_docs).count() == 0


def test_sainte_lague_takes_the_highest_quotients(spark):
    rng = np.random.default_rng(8)
    for seats in (0, 1, 7, 100, 1001):
        votes = [float(v) for v in rng.integers(1, 5000, 9)] + [0.0]
        rows = [(k, v, 10**6, seats) for k, v in enumerate(votes)]
        got = mixing.sainte_lague(spark.createDataFrame(rows, "u int, votes double, cap long, seats long"), [], ["u"])
        quotients = sorted(((v / (2 * k - 1), -u) for u, v in enumerate(votes) for k in range(1, seats + 1) if v), reverse=True)
        want = collections.Counter(-u for _, u in quotients[:seats])
        assert {r.u: r.quota for r in got.collect()} == {u: want[u] for u in range(10)}
