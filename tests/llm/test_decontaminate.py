import random
from collections import Counter

from claimlens.llm.decontaminate import contaminated, without_contaminated


def grams(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(docs, items):
    """Best similarity of any window of an item's length, for all documents and items."""
    found = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            v = (item or "").lower().split()
            if not v or not w:
                continue
            k = min(5, len(v))
            if len(w) < k:
                continue
            want = grams(v, k)
            for at in range(max(1, len(w) - len(v) + 1)):
                own = grams(w[at : at + len(v)], k)
                same = sum((own & want).values())
                score = same / (sum(own.values()) + sum(want.values()) - same)
                if score >= 0.8 and score > found.get((d, i), (0, 0))[0]:
                    found[d, i] = (score, at)
    return found


def test_against_all_windows(spark, make_docs):
    rng = random.Random(3)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randrange(9))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 60)))) for i in range(12)]
    items += [(20, "tiny one"), (21, "Solo"), (22, None), (23, " "), (24, "r r r r r r r r r r"), (25, items[0][1])]
    docs = []
    for d in range(60):
        words = [word() for _ in range(rng.randint(0, 80))]
        if d % 3 == 0:
            own = rng.choice(items[:12])[1].split()
            if d % 2:
                own[0] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() for w in own]
        docs.append((d, "\n".join(words)))
    docs += [(100, None), (101, ""), (102, "x tiny  one y"), (103, "solo"), (104, "r " * 300), (105, "r r r r"), (3, docs[3][1]), (3, items[5][1]), (None, items[2][1])]
    bench = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, k string, n int")
    table = make_docs(docs, extra=True)
    got = contaminated(table, bench).collect()
    want = brute(docs, items)
    best = {}
    for r in got:
        best[r.doc_id, r.item_id] = max(best.get((r.doc_id, r.item_id), (0, 0)), (r.similarity, -r.start))
    assert set(best) == set(want) and len(want) > 20
    assert all(abs(best[k][0] - want[k][0]) < 1e-12 for k in want)
    kept = without_contaminated(table, bench)
    assert kept.columns == table.columns
    bad = {d for d, _ in want} - {3}
    assert sorted(str(r.doc_id) for r in kept.collect() if r.doc_id != 3) == sorted(str(d) for d, _ in docs if d not in bad and d != 3)
    assert not any(r.doc_id == 3 and r.text == items[5][1] for r in kept.collect())


def test_long_texts_and_ties(spark, make_docs):
    """A text of 60,000 words is one row like others; of windows as alike the first counts."""
    rng = random.Random(5)
    item = " ".join(f"i{k}" for k in range(30))
    filler = lambda n: " ".join(f"f{rng.randrange(5000)}" for _ in range(n))
    docs = [(1, f"{filler(40_000)} {item} {filler(20_000)} {item}"), (2, filler(60_000)), (3, f"{item} {item}"), (4, f"x {item.replace('i3 ', 'y ')} {item.replace('i9 ', 'z ')}")]
    bench = spark.createDataFrame([(7, item), (8, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in contaminated(make_docs(docs), bench).collect()}
    want = brute(docs[2:], [(7, item)])
    assert set(got) == {(d, i) for d in ({1, 3} | {d for d, _ in want}) for i in (7, 8)}
    assert got[1, 7] == got[1, 8] == (40_000, 1.0) and got[3, 7] == (0, 1.0)
    assert all(got[d, 7] == (at, score) for (d, _), (score, at) in want.items())
    assert sorted(r.doc_id for r in without_contaminated(make_docs(docs), bench).collect()) == sorted({1, 2, 3, 4} - {d for d, _ in got})


def test_empty(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(make_docs([(1, "a b c")]), none).count() == 0
    assert without_contaminated(make_docs([(1, "a b c"), (2, None)]), none).count() == 2
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contaminated(make_docs([]), one).count() == 0
