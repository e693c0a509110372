from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from claimlens.llm import decontaminate, language
from claimlens.llm.common import read_table
from claimlens.llm.queries import tokenizer_file
from claimlens.session import stage
from .test_decontaminate import brute
from .test_mixing import WORD, water_level
from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    outs = []
    for name, apply in cp.STAGES:
        docs = stage(apply(spark, docs, SF), f"test-{name}")
        outs.append(docs)
    source = read_table(spark, SF, "documents").collect()
    columns = list(source[0].asDict())
    assert all(o.columns == columns for o in outs[:-1])

    known = outs[0].collect()
    lost = {r.doc_id for r in source} - {r.doc_id for r in known}
    assert all(not any(c.isalpha() for c in r.text or "") for r in source if r.doc_id in lost)

    codes = {r.doc_id: plain_fingerprint(r.text) for r in known}
    root = plain_components(codes.values())
    keep = {}
    for d in sorted(codes):
        keep.setdefault(root[codes[d]], d)
    unique = outs[1].collect()
    assert sorted(r.doc_id for r in unique) == sorted(keep.values())

    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    bad = {d for d, _ in brute([(r.doc_id, r.text) for r in unique], items)}
    clean = outs[2].collect()
    assert sorted(r.doc_id for r in clean) == sorted({r.doc_id for r in unique} - bad)

    sizes = Counter()
    for r in clean:
        sizes[r.source] += len(WORD.findall(r.text))
    taken = Counter()
    mixed = outs[3].collect()
    for r in mixed:
        taken[r.source] += len(WORD.findall(r.text))
    want = water_level(sizes)
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)
    words = {r.doc_id: WORD.findall(r.text) for r in clean}
    assert all(words[r.doc_id][: len(WORD.findall(r.text))] == WORD.findall(r.text) for r in mixed)
    assert all(n <= 4 for n in Counter(r.doc_id for r in mixed).values())

    library = Tokenizer.from_file(tokenizer_file(cp.TOKENIZER))
    got = sorted(outs[4].collect(), key=lambda r: r.start)
    want = sorted((r.doc_id, library.encode(r.text, add_special_tokens=False).ids + [2]) for r in mixed)
    assert sorted((r.doc_id, r.ids) for r in got) == want
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in mixed)
    assert [r.start for r in got] == [sum(g.n_tokens for g in got[:i]) for i in range(len(got))]


def test_odd_rows(spark, tmp_path, make_docs):
    text = "the and of that with this from they have been were"
    docs = make_docs([(1, None), (2, ""), (None, text + " one two three"), (3, text), (3, text), (4, "12 34"), (5, text + " x" * 50_000)])
    for name, apply in cp.STAGES:
        docs = stage(apply(spark, docs, SF), f"odd-{name}")
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} <= {None, 3, 5}
    docs = make_docs([])
    for name, apply in cp.STAGES:
        docs = stage(apply(spark, docs, SF), f"none-{name}")
    assert docs.count() == 0


def test_run_is_the_stages(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids"] and got.count() > 100
    assert cp.ORACLE_SQL is None and language.LEAST_POSTERIOR == 0.5 and decontaminate.SIMILARITY == 0.8


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_are_named(name):
    assert name
