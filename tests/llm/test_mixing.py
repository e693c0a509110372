import re

from claimlens.llm import mixing
from claimlens.llm.mixing import mix_sources, mixture

WORD = re.compile("[^\x20\x09-\x0d]+")


def water_level(sizes, weights=(5, 2, 1), most=3):
    """Targets by the rounds of the definition: share by weight, cap, reshare the excess."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target | capped
        capped |= {s: most * sizes[s] for s in over}


def test_targets_and_taken(make_docs):
    rows = [(i, "w " * (i % 7 * 3) + "é\x0bz", ["a", "b", "c", "d", None, "Z"][i % 6] if i % 3 else "a") for i in range(300)]
    rows += [(900, None, "a"), (901, "", "empty"), (902, " \t", "empty"), (7, "again", "b"), (7, "again", "b"), (None, "no id", "c")]
    docs = make_docs(rows, extra=True)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(WORD.findall(r[1] or ""))
    want = water_level(sizes)
    for source in sizes:
        mine = [g for g in got if g.source == source]
        assert all(g.source_size == sizes[source] and abs(g.target - want[source]) < 1e-6 for g in mine)
        assert sum(g.taken for g in mine) == int(want[source] + 1e-9)
        assert all(0 <= g.taken <= 3 * g.size for g in mine)
        assert max(g.taken // g.size for g in mine if g.size) - min(g.taken // g.size for g in mine if g.size) <= 1 if sizes[source] else True
    again = mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixture_has_the_words_it_takes(make_docs):
    docs = make_docs([(i, f"a{i} b c d e", "s" if i % 9 else "t") for i in range(60)], extra=True)
    taken = {(r.doc_id): r.taken for r in mix_sources(docs).collect()}
    out = mixture(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert words == {k: v for k, v in taken.items() if v}


def test_a_very_long_text_is_cut_at_the_budget(make_docs):
    """One text has nearly all words of its source: whole epochs and the words that still fit are taken."""
    rows = [(1, "long " * 300_000, "a"), (2, "one two", "a"), (3, "w " * 50_000, "b"), (4, "w " * 1000, "c")]
    docs = make_docs(rows)
    want = water_level({"a": 300_002, "b": 50_000, "c": 1000})
    got = {r.doc_id: r for r in mix_sources(docs).collect()}
    assert got[1].taken + got[2].taken == int(want["a"] + 1e-9) and got[3].taken == int(want["b"] + 1e-9) and got[4].taken == 3000 == want["c"]
    words = {}
    for r in mixture(docs).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert words == {d: r.taken for d, r in got.items() if r.taken}


def test_empty(make_docs):
    assert mix_sources(make_docs([])).count() == 0
    assert mixture(make_docs([(1, None), (2, "")])).count() == 0
    assert mixing.WEIGHTS == (5, 2, 1)
