import hashlib
import random
import re
import struct

import pytest
import xxhash

from claimlens.llm import order_minhash as om
from claimlens.llm.order_minhash import fingerprints

TOKEN = re.compile("[^\x20\x09-\x0d]{1,16}")


def edited_of(rows):
    """Edited texts, and which row follows, by the definition; equal rows count once."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))
    out = {}
    for k, (d, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)]
        half = len(text) // 2
        out[d, order[k][1]] = (text[: len(text) - half] + (after[1] or "")[:half], after)
    return out


def test_edited_texts_and_fingerprints(spark, make_docs):
    rng = random.Random(6)
    words = [rng.choice(["the", "of", "日本語", "é", "x" * 90, "a"]) + str(rng.randrange(30)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i * 13 % 997, text(rng.randint(0, 120))) for i in range(120)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "one two"), (2005, "one two"), (2006, "n " * 3000), (2007, "日" * 5000), (None, text(50)), (2008, "\U0001f600a" * 30)]
    docs = make_docs(rows + [rows[5], rows[5]], extra=True)
    got = fingerprints(docs, 20_000).collect()
    assert len(got) == len(rows) + 2
    want, by_id = edited_of(rows), {r.doc_id: r for r in got}
    # fingerprints of the edited texts on their own
    alone = {r.doc_id: r.fingerprint for r in fingerprints(make_docs([(k, e) for k, (e, _) in enumerate(want.values())])).collect()}
    texts = {}
    for k, ((d, own), (edited, after)) in enumerate(want.items()):
        r = by_id[d]
        assert r.n_chars == len(own or "") and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.edited_fingerprint == alone[k]
        assert texts.setdefault(own or "", r.fingerprint) == r.fingerprint
        other = by_id[after[0]].fingerprint
        for value, x, y in ((r.near_edited, r.fingerprint, r.edited_fingerprint), (r.near_next, r.fingerprint, other)):
            cut = [(x[i : i + 4], y[i : i + 4]) for i in range(0, len(x), 4)]
            some = sum(a != "0000" or b != "0000" for a, b in cut)
            assert abs(value - (sum(a == b != "0000" for a, b in cut) / some if some else 1)) < 1e-12
    assert len(set(texts.values())) > 0.9 * len(texts)
    long = [r for r in got if r.n_chars > 300 and r.doc_id is not None and r.doc_id < 2000]
    assert sum(r.near_edited for r in long) > 4 * sum(r.near_next for r in long) > 0 or all(r.near_next == 0 for r in long)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(*values):
    """Hash of whole numbers one after the other: each starts from the hash of those before."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v), seed).intdigest()
    return signed(seed)


def plain_fingerprint(text):
    """All 64 pairs, component by component."""
    tokens = [p for t in re.split("[\x20\x09-\x0d]+", text or "") if t for p in (re.findall("(?s).{1,16}", t) if len(t.encode()) > 64 else [t])]
    hashes = [signed(xxhash.xxh64(t.encode(), 42).intdigest()) for t in tokens]
    hashes += [0] * (3 - len(hashes)) if 0 < len(hashes) < 3 else []
    seen, ranges, low = {}, {}, (1 << 30) - 1
    for place in range(len(hashes) - 2):
        kmer = chained(*hashes[place : place + 3])
        seen[kmer] = seen.get(kmer, 0) + 1
        drawn = chained(kmer, seen[kmer])
        ranges[drawn % 128] = min(ranges.get(drawn % 128, 1 << 64), drawn & ~low | place)
    codes = []
    for c, order in enumerate(om._orders()):
        pair = [ranges[r] for r in order if r in ranges][:2] if not {2 * c, 2 * c + 1} <= ranges.keys() else [ranges[2 * c], ranges[2 * c + 1]]
        pair = [x >> 30 for x in sorted(pair, key=lambda x: x & low)]
        codes.append(chained(*pair) % 65535 + 1 if pair else 0)
    return "".join("".join(f"{codes[4 * w + n]:04x}" for n in (3, 2, 1, 0)) for w in range(16))


def test_signature_equals_the_pairs_written_out(make_docs):
    rng = random.Random(11)
    words = ["the", "of", "日本語", "é", "x" * 90, "ÿ" * 40, "a"] + [f"w{i}" for i in range(60)]
    rows = [(i, rng.choice([" ", "\n\t", "  "]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 9, 30, 200])))) for i in range(80)] + [(90, None), (91, " \n ")]
    got = {r.doc_id: r for r in fingerprints(make_docs(rows)).collect()}
    edited = {d: e for (d, _), (e, _) in edited_of(rows).items()}
    for d, text in rows:
        assert got[d].fingerprint == plain_fingerprint(text), text
        assert got[d].edited_fingerprint == plain_fingerprint(edited[d])


def test_order_matters(make_docs):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(600)]
    parts = [words[i : i + 30] for i in range(0, 600, 30)]
    rng.shuffle(parts)
    moved = [w for p in parts for w in p]
    swapped = words.copy()
    swapped[300] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(moved)), (3, " ".join(words)), (4, " ".join(swapped)), (5, " ".join(words))]
    got = {r.doc_id: r for r in fingerprints(make_docs(rows)).collect()}
    assert got[1].fingerprint == got[3].fingerprint == got[5].fingerprint and got[5].near_next == 1.0
    assert got[3].near_next > 0.9  # one word changed
    assert 0.2 < got[1].near_next < 0.8  # nearly the same k-mers in another order


def test_numbers_tell_repeats_apart(make_docs):
    rows = [(1, "a b c " * 50), (2, "a b c " * 400), (3, "a b c " * 50)]
    got = {r.doc_id: r for r in fingerprints(make_docs(rows)).collect()}
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint


@pytest.mark.parametrize("n", [10, 20, 60, 100])
def test_order_of_short_texts(make_docs, n):
    """Two blocks that change places leave nearly all k-mers, but not their order; one changed word leaves both."""
    rows = []
    for k in range(30):
        words = [f"w{k}x{i}" for i in range(n)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(words[n // 2 :] + words[: n // 2])), (3 * k + 2, " ".join(words[n // 2 :] + words[: n // 2 - 1] + ["z"]))]
    got = {r.doc_id: r for r in fingerprints(make_docs(rows)).collect()}
    moved, changed = (sum(got[3 * k + j].near_next for k in range(30)) / 30 for j in (0, 1))
    assert moved < 0.6 and changed > moved
    singles = sum(r.fingerprint.count("0000") > 6 for r in got.values())
    assert singles == 0  # every component is filled


def test_repeats_fill_all_components(make_docs):
    rows = [(1, "a b c " * 50), (2, "a b c " * 51), (3, "one two three four five")]
    got = {r.doc_id: r for r in fingerprints(make_docs(rows)).collect()}
    cut = [got[1].fingerprint[i : i + 4] for i in range(0, 256, 4)]
    assert "0000" not in cut and len(set(cut)) > 30 and got[1].near_next > 0.8


def test_empty(make_docs):
    assert fingerprints(make_docs([])).count() == 0
    one = fingerprints(make_docs([(1, "ab cd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and one.near_next == 1.0
    assert om.K == 3


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_nothing_leaves_the_jvm(spark, sf):
    from claimlens.llm.common import read_table

    plan = fingerprints(read_table(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
