import random
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from claimlens.llm import token_counts as tc
from claimlens.llm.queries import tokenizer_file

SIGNS = ["a", "s", "t", "'", "'s", "'re", "'ll", "'v", " ", "  ", "\n", "\t", "1", "²", "!", "é", "日", " ", "　", "<|endoftext|>", "<|endof", "text|>", "👍", "\x1c", "\x85", "d", "l", "e", "́", "m", "​", "Ⅷ"]


@pytest.fixture(scope="module")
def tokenizer():
    return Path(tokenizer_file("byte_bpe_50k.json")).read_text()


def counts(counter, texts):
    raw = [t.encode() for t in texts]
    return counter.count(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)).tolist()


@pytest.mark.parametrize("remembered", [20, 10**6])
def test_random_signs(tokenizer, remembered):
    rng, library = random.Random(1), Tokenizer.from_str(tokenizer)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [" " * 999, "'" * 500, "x" * 3000, ""]
    counter = tc.TokenCounter(tokenizer, remembered)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        assert counts(counter, part) == [len(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]


def test_every_kind_of_character(tokenizer):
    texts = [f"x{chr(c)}x {chr(c)} 1{chr(c)}" for c in [*range(1, 0x3000), *range(0x3000, 0x110000, 101)] if not 0xD800 <= c < 0xE000]
    library = Tokenizer.from_str(tokenizer)
    assert counts(tc.TokenCounter(tokenizer), texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_newer_characters_in_every_context(tokenizer):
    """Code points that Python's tables may not know: all that a scan of both finds odd, and a sample of the rest."""
    import unicodedata

    odd = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"]
    known = tc.kinds()
    odd = [c for c in odd if known[c] != tc.OTHER] + odd[::997] + [0x1C89, 0xA7CB, 0xA7DA]
    texts = [t for c in odd for t in (f"{chr(c)}'ll{chr(c)}x", f" {chr(c)}x1", f"a{chr(c)}1{chr(c)}!{chr(c)}  {chr(c)}")]
    library = Tokenizer.from_str(tokenizer)
    assert counts(tc.TokenCounter(tokenizer), texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("chunk", [1, 2, 7, 128])
def test_chunks_do_not_matter(chunk):
    rng = random.Random(2)
    text = "".join(rng.choice(SIGNS) for _ in range(2000))
    codes, resets = np.array([ord(c) for c in text], np.uint32), np.array([0, 500, 501, 1999])
    want = tc.piece_starts(codes, resets, len(codes) + 1)
    assert np.array_equal(tc.piece_starts(codes, resets, chunk), want) and set(resets) <= set(want.tolist())


def test_table(spark, make_docs, tokenizer):
    rows = [(1, "Hello world's end"), (2, None), (3, ""), (None, "no id"), (1, "Hello world's end"), (4, "a b " * 400), (5, "long" * 100_000)]
    got = tc.token_counts(make_docs(rows, extra=True), tokenizer).collect()
    library = Tokenizer.from_str(tokenizer)
    want = []
    for i, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((str(i), len((text or "").encode()), n, n > 512))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(want)
    assert tc.token_counts(make_docs([]), tokenizer).count() == 0
