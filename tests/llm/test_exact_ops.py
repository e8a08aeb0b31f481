"""Sharding, packing and SimHash groups against brute force."""

import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import packing, sharding, simhash_dedup
from tidemark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, part int, n long, shard int, ids string"

TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "two words",
    "Three little words",
    "three  LITTLE\nwords",
    "the cat sat on the mat and the cat sat on the rug",
    "the cat sat on the mat and the cat sat on the rug",
    "ÉCOLE été naïve 日本語 text é  x  y",
    "<|endoftext|> it's we'll 123 a1b2 ... !!",
    "x" * 5000,
    "word " * 9000,
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, 9, 1, "clash") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    rows = list(enumerate(TEXTS))
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(3, 300))) for _ in range(30)]
    for k, t in enumerate(base):
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        rows += [(100 + 3 * k, t), (101 + 3 * k, t), (102 + 3 * k, " ".join(words))]
    return [*rows, (None, "no id here at all"), (3, "one")]


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_rows_of_a_hot_fingerprint(spark, cases, monkeypatch):
    """Most rows share one fingerprint, and there are too many facts for a broadcast: the groups are the same."""
    from functools import partial

    rows = [*cases, *((10_000 + k, None if k % 2 else " ") for k in range(400))]
    want = {tuple(r) for r in simhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    monkeypatch.setattr(simhash_dedup, "split_join", partial(simhash_dedup.split_join, most=0))
    found = simhash_dedup.near_duplicates(docs(spark, rows)).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(rows)


def test_simhash_groups_match_brute_force(spark, cases):
    got = {(r[0], r[1] % (1 << 64)): r[2] for r in simhash_dedup.near_duplicates(docs(spark, cases)).collect()}
    fps = [(i, brute_fingerprint(t)) for i, t in cases]
    roots = brute_components([f for _, f in fps])
    least = {}
    for i, f in fps:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    assert got == {(i, f): least.get(roots[f]) for i, f in fps}


def test_fingerprint_does_not_depend_on_block_size(monkeypatch):
    text = " ".join(str(i * 7919 % 1000) for i in range(1000))
    whole = simhash_dedup.fingerprint(text.encode())
    monkeypatch.setattr(simhash_dedup, "BLOCK", 7)
    assert simhash_dedup.fingerprint(text.encode()) == whole == brute_fingerprint(text)


@pytest.mark.parametrize("radius,wide", [(2, 256), (2, 3), (1, 256), (1, 3), (0, 256), (3, 256), (3, 3), (6, 2)])
def test_links_connect_all_pairs_within_the_radius(spark, radius, wide):
    rng = random.Random(radius * 10 + wide)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(20):
            x = centre
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, wide).collect()
    unsigned = [(a % (1 << 64), b % (1 << 64)) for a, b in got]
    assert all((a ^ b).bit_count() <= radius for a, b in unsigned)
    seen = {x: {x} for x in fps}
    for a, b in unsigned:
        if seen[a] is not seen[b]:
            seen[a] |= seen[b]
            for x in seen[b]:
                seen[x] = seen[a]
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius:
                assert seen[a] is seen[b]


@pytest.mark.parametrize("n", [1, 50, 10**4, 10**7, 10**10])
def test_plan_obeys_the_pigeonhole(n):
    rng = np.random.default_rng(0)
    bits = (rng.random((500, 64)) < rng.random(64)).astype(float)
    both = (bits.T @ bits) * n / 500
    for m in range(1, 5):
        parts = simhash_dedup.group_bits(n, both, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        _, thresholds = simhash_dedup.allocate(n, both, parts, 2)
        assert sum(thresholds) == 2 - m + 1


def test_a_path_of_links_is_one_component(spark):
    from tidemark.llm.common import components

    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


def test_shards_are_a_permutation(spark, cases):
    text = F.coalesce("text", F.lit(""))
    rows = docs(spark, [*cases, *[(7, "copy")] * 3000]).select(
        "doc_id", F.octet_length(text).alias("size"), F.crc32(text.cast("binary")).alias("crc")
    )
    first = sharding.shard(rows.repartition(5), ["doc_id", "size", "crc"], 16).collect()
    again = sharding.shard(rows.repartition(2, "size"), ["doc_id", "size", "crc"], 16).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    n = rows.count()
    assert len(first) == n
    assert Counter((r["doc_id"], r["size"], r["crc"]) for r in first) == Counter(map(tuple, rows.collect()))
    slots = {}
    for r in first:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert (r["shard"], r["slot"]) == sharding.place(r["row_number"], n, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000])
def test_every_size_is_permuted(n):
    assert sorted(s + 16 * k for s, k in (sharding.place(i, n) for i in range(n))) == list(range(n))


def test_empty_tables(spark):
    none = docs(spark, [])
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert sharding.shard(none, ["doc_id"]).count() == 0
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_packing_cuts_one_stream(spark, cases):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    length = 512
    pieces = packing.pack(docs(spark, cases).repartition(3), tokenizer_path(), length, keep_ids=True).collect()
    by_text = Counter()
    for i, t in cases:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        by_text[i, struct.pack(f"<{len(ids)}I", *ids)] += 1
    pieces.sort(key=lambda r: (r["sequence_id"], r["offset"]))
    at, stream, starts = 0, b"", []
    for r in pieces:
        assert (r["sequence_id"], r["offset"]) == (at // length, at % length)
        assert 0 < r["length"] <= length - r["offset"]
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        if r["start"] == 0:
            starts.append((r["doc_id"], b"", r["doc_tokens"]))
        i, ids, n = starts[-1]
        assert (i, len(ids) // 4, n) == (r["doc_id"], r["start"], r["doc_tokens"])
        starts[-1] = (i, ids + r["ids"], n)
        at += r["length"]
    assert Counter((i, ids) for i, ids, _ in starts) == by_text
    assert all(len(ids) == 4 * n for _, ids, n in starts)


@pytest.mark.parametrize("seed", range(3))
def test_chunk_cache_equals_the_tokenizer(seed):
    from tokenizers import Tokenizer

    tokenizer, chunks = Tokenizer.from_file(tokenizer_path()), packing._Chunks(tokenizer_path())
    rng = random.Random(seed)
    alphabet = "abcXYZHhITt\u0331\u0307'sSt0189 \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 éÉéİΣΑΣ日.,!?#<|endoftext|>ͅ각"
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert packing.token_bytes(text.encode(), chunks) == struct.pack(f"<{len(ids)}I", *ids), repr(text)
