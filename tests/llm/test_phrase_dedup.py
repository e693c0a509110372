import random

import numpy as np
import pytest

from claimlens.llm import phrases
from claimlens.llm.phrase_dedup import dedup_spans
from claimlens.llm.phrases import parse


def plain(rows):
    """Kept bytes and spans per row, straight from the definition."""
    first = {}
    raw = [((d if d is not None else 10**9), (t or "").encode()) for d, t in rows]
    for d, t in raw:
        for x in range(len(t) - 49):
            s = t[x : x + 50]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in raw:
        gone = np.zeros(len(t) + 2, bool)
        for x in range(len(t) - 49):
            if first[t[x : x + 50]] < d:
                gone[x + 1 : x + 51] = True
        edge = np.flatnonzero(np.diff(gone.astype(int)))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append((d, len(t), spans, bytes(b for b, g in zip(t, gone[1:]) if not g)))
    return sorted(out)


def some_rows(seed, n=150):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "the ", "ç", "of", "日本", "x" * 9, "- ", "\n"])
    text = lambda k: "".join(word() for _ in range(k))
    pool = [text(rng.randint(5, 60)) for _ in range(12)] + ["-" * 200, "ab" * 90]
    rows = []
    for i in range(n):
        pieces = [rng.choice(pool) if rng.random() < 0.5 else text(rng.randint(0, 30)) for _ in range(rng.randint(0, 6))]
        rows.append((i * 37 % 1009, "".join(pieces)))
    rows += [(i + 2000, pool[i % 5] + text(3)) for i in range(60)]  # one passage with many different ends
    return rows + [(5000, None), (5001, ""), (5002, "q" * 49), (5003, "q" * 50), (5004, "q" * 50), (7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1]), (None, "z" * 60), (None, "z" * 60)]


@pytest.mark.parametrize("segment", [phrases.SEGMENT, 1000, 64])
def test_every_window_lies_in_one_phrase(segment):
    texts = [(t or "").encode() for _, t in some_rows(1)]
    at = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    p = parse(data, at, segment=segment)
    cover, want = np.zeros(len(data), int), np.zeros(len(data), int)
    for a, b in zip(p.first, p.last):
        cover[a : b + 1] += 1
    for a, b in zip(at[:-1], at[1:]):
        want[a : max(a, b - 49)] = 1
    assert np.array_equal(cover, want)
    triggers = {}
    for a, b, t in zip(p.first, p.last, p.trigger):
        for x in range(a, b + 1):
            triggers.setdefault(bytes(data[x : x + 50]), set()).add(int(t))
    assert all(len(t) == 1 for t in triggers.values())


@pytest.mark.parametrize("seed,block", [(1, 300), (2, 2000), (3, 1 << 20)])
def test_against_definition(make_docs, seed, block):
    rows = some_rows(seed)
    got = dedup_spans(make_docs(rows, extra=True), block).collect()
    have = sorted((10**9 if r.doc_id is None else r.doc_id, r.n_bytes, [(s.begin, s.end) for s in r.spans], bytes(r.kept)) for r in got)
    assert have == plain(rows)
    assert sum(len(r.spans) > 1 for r in got) > 20


def test_empty(make_docs):
    assert dedup_spans(make_docs([])).count() == 0
    assert [bytes(r.kept) for r in dedup_spans(make_docs([(1, None)])).collect()] == [b""]
