"""License scans against a comparison of every block with every template."""

import inspect
import math
import random

import pytest

from claimlens.llm import license_scan as ls

BY_LABEL = {}
for _label, _text in ls.TEMPLATES:
    BY_LABEL.setdefault(_label, _text)


def brute(text, templates=ls.TEMPLATES, threshold=ls.THRESHOLD):
    """(n_words, places, blocks) by definition."""
    words = ls.words_of(text or "")
    places = sorted(((i, label) for phrase, label in ls.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()))
    half, blocks = max(len(ls.words_of(t)) for _, t in templates), {}
    for t, (label, template) in enumerate(templates):
        wanted = set(ls.shingles_of(template))
        for b in range(len(words) // half + 1):
            at = [i for i in range(b * half, (b + 2) * half) if len(words[i : i + 5]) == 5 and " ".join(words[i : i + 5]) in wanted]
            held = {" ".join(words[i : i + 5]) for i in at}
            if len(held) >= math.ceil(threshold * len(wanted) - 1e-9):
                key = (t, at[0], at[-1] + 5, label)
                blocks[key] = max(blocks.get(key, 0), len(held) / len(wanted))
    return len(words), [p[0] for p in places], sorted((s, e, label, c) for (_, s, e, label), c in blocks.items())


def scanned(spark, make, rows, **settings):
    found = ls.scan(make(rows, settings.pop("extra", False)), **settings).collect()
    return sorted(((r["doc_id"], r["n_words"], [p["start"] for p in r["places"]], [tuple(b) for b in r["blocks"]]) for r in found), key=str)


def expected(rows, **settings):
    return sorted(((i, *brute(text, **settings)) for i, text in rows), key=str)


def cut(text, share, seed):
    """The words of a text with some replaced."""
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), int(len(words) * share)):
        words[i] = "zebra"
    return " ".join(words)


def test_every_template_is_found_in_other_text(spark, make_docs):
    noise = "the of and to in that for you may this with " * 12
    rows = [(t, noise + text + " " + noise) for t, (_, text) in enumerate(ls.TEMPLATES)]
    found = {r[0]: {b[2] for b in r[3]} for r in scanned(spark, make_docs, rows)}
    assert all(label in found[t] for t, (label, _) in enumerate(ls.TEMPLATES))


def test_like_brute_force(spark, make_docs):
    rng = random.Random(3)
    parts = [text for _, text in ls.TEMPLATES] + ["MIT License", "apache\nlicense", "GNU General  Public-License", "mit. license", "permission license mit", "ß license É"]
    rows = []
    for i in range(120):
        chosen = [cut(p, rng.choice([0, 0, 0.02, 0.05, 0.3]), i) for p in rng.sample(parts, rng.randint(0, 4))]
        rows.append((i, (" " * rng.randint(1, 3)).join([*chosen, "word " * rng.randint(0, 300)] if i % 2 else ["word " * rng.randint(0, 300), *chosen])))
    assert scanned(spark, make_docs, rows) == expected(rows)


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
def test_threshold_is_exact(spark, make_docs, threshold):
    """Templates that share most tokens, and texts that hold each share of one: the filters lose no pair at the edge."""
    words = [f"t{i}" for i in range(24)]
    templates = (("long", " ".join(words)), ("head", " ".join(words[:14])), ("tail", " ".join(words[9:])))
    rows = [(k, " ".join(words[:k] + ["gap"] + words[k + 1 :])) for k in range(24)] + [(100 + k, " ".join(words[k:])) for k in range(24)]
    rows += [(200, " ".join(words * 40)), (201, " ".join(words[:14] * 30 + words[9:] * 30))]
    assert scanned(spark, make_docs, rows, templates=templates, threshold=threshold) == expected(rows, templates=templates, threshold=threshold)


def test_nulls_empty_long_repeats_and_clashing_names(spark, make_docs):
    long = "lorem " * 60_000 + BY_LABEL["apache"] + " ipsum" * 40_000 + " MIT License"
    rows = [(1, None), (2, ""), (3, "..."), (4, BY_LABEL["isc"]), (4, BY_LABEL["isc"]), (None, "mit license"), (None, None), (5, long), (6, "MIT MIT license license"),
            (7, (BY_LABEL["cc-by-nc"] + "\n") * 50)]
    assert scanned(spark, make_docs, rows, extra=True) == expected(rows)


def test_empty_table(spark, make_docs):
    assert scanned(spark, make_docs, []) == []


def test_only_a_to_z_are_lowered(spark, make_docs):
    rows = [(1, "MIT LİCENSE mit License K"), (2, "MİT license")]
    assert scanned(spark, make_docs, rows) == expected(rows)


def test_short_templates_are_refused():
    with pytest.raises(ValueError):
        ls.shingles_of("MIT License")


def test_main_path_is_native(spark, make_docs):
    plan = ls.scan(make_docs([(1, BY_LABEL["mit"])]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD"))
    assert "import numpy" not in inspect.getsource(ls)
