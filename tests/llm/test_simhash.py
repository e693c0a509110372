import random

import numpy as np
import pytest
import xxhash

from claimlens.llm.components import components
from claimlens.llm.gray_index import GrayIndex, gray_rank
from claimlens.llm.simhash import fingerprint_links, fingerprints, keep_one, simhash_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, most=3):
    codes = sorted(set(codes))
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= most:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {c: find(c) for c in codes}


def clusters(seed, n):
    rng = random.Random(seed)
    codes = [rng.getrandbits(64) for _ in range(n // 10)] + [0, 2**64 - 1, 1, 7, 15, 1 << 63]
    while len(codes) < n:
        c = rng.choice(codes[-5:] if rng.random() < 0.5 else codes)
        for _ in range(rng.randint(1, 6)):
            c ^= 1 << rng.randrange(64)
        codes.append(c)
    return sorted(set(codes))


@pytest.mark.parametrize("lead,most", [(16, 3), (0, 5), (8, 7)])
def test_index_finds_all_pairs(lead, most):
    codes = np.array(clusters(lead, 700), np.uint64)
    codes = codes[np.argsort(gray_rank(codes))]
    got = {(int(a), int(b)) for q, c in GrayIndex(codes).search(codes, most, lead, np.arange(len(codes))) for a, b in zip(q, c)}
    want = set()
    for i in range(len(codes)):
        differ = codes[i] ^ codes[i + 1 :]
        near = np.bitwise_count(differ) <= most
        near &= differ >> np.uint64(64 - lead) == 0 if lead else True
        want |= {(i, int(i + 1 + j)) for j in np.flatnonzero(near)}
    assert got == want and want


@pytest.mark.parametrize("parts", ["1", "4", "40"])
def test_links_connect_what_brute_force_connects(spark, parts):
    codes = clusters(5, 900)
    codes += [0x1234 << 48 | 0x55 << 20 | i for i in range(300)]  # one block with a quarter of all codes
    signed = sorted({c - (1 << 64) if c >> 63 else c for c in codes})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(c,) for c in signed], "fp long")
        links = [(r.a, r.b) for r in fingerprint_links(df).collect()]
        assert all(bin((a ^ b) & (2**64 - 1)).count("1") > 0 for a, b in links) and len(links) < 20 * len(signed)
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain_components(signed)
    assert {c: got.get(c, c) for c in signed} == want
    assert sum(c != r for c, r in want.items()) > 300


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, 1000 + i) for i in range(200)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*path, *star, (3, 3), (100, 101)], "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7} | {1000 + i: 7 for i in range(200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = ["A b C d e f", "a B c D\x0be\tf", "", None, " \t", "one", "one two", "É é ü", "x y z " * 400, "long " + "w" * 9000]


def test_fingerprints():
    assert [int(f) for f in fingerprints([(t or "").encode() for t in TEXTS])] == [plain_fingerprint(t) for t in TEXTS]


def test_components_of_documents(spark, make_docs):
    rng = random.Random(1)
    base = " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) + str(rng.randrange(50)) for _ in range(400))
    rows = [(50 - i, t) for i, t in enumerate(TEXTS)] + [(100, base), (90, base + " x"), (95, "y " + base), (90, base), (None, base), (None, "alone here")]
    docs = make_docs(rows, extra=True)
    got = sorted((str(r.doc_id), r.fp, r.component_id) for r in simhash_components(docs).collect())
    codes = {t: plain_fingerprint(t) for _, t in rows}
    root = plain_components(codes.values())
    ids = {}
    for d, t in rows:
        ids.setdefault(root[codes[t]], []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    want = sorted((str(d), codes[t] - (1 << 64) if codes[t] >> 63 else codes[t], least[root[codes[t]]]) for d, t in rows)
    assert got == want
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d in least.values())
    assert simhash_components(make_docs([])).count() == 0 and keep_one(make_docs([])).count() == 0
