import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from claimlens.llm import token_files as tf
from claimlens.llm.queries import tokenizer_file
from claimlens.session import scratch_path

TEXTS = ["Hello, world! it's", "", None, "<|endoftext|>x <|startoftext|> y<|endoftext|>", "Ça  va bien　 ?", "é ΣΑΣ ΑΣ", "a\x1cb\x1fc\x0bd\x85e", "日本語のテキスト 👍🏽 12345", "x" * 5000, "don't ́ 'LL we'Re", "<|EndOfText|> A", "İI İ ſK"]


@pytest.fixture(scope="module")
def tokenizer():
    return Path(tokenizer_file("word_bpe_49k.json")).read_text()


@pytest.mark.parametrize("remembered", [3, 1000])
def test_words_one_by_one_are_the_text(tokenizer, remembered):
    t, encoder = Tokenizer.from_str(tokenizer), tf.WordEncoder(tokenizer, remembered)
    for _ in range(2):
        raw = [(x or "").encode() for x in TEXTS]
        ids, at = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64), 2)
        got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        assert got == [t.encode(x or "", add_special_tokens=False).ids + [2] for x in TEXTS]


def thue_morse(n):
    """A word of a and b, and its complement: every polynomial hash modulo a power of two takes the two for one from 1024 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_words_of_one_hash_keep_their_own_ids(tokenizer, n):
    one, two = thue_morse(n)
    t = Tokenizer.from_str(tokenizer)
    for batches in ([[one, two]], [[one], [two], [two, one]], [[f"{two} {one} x", f"{one}, {two}!", two]]):
        encoder = tf.WordEncoder(tokenizer)
        for texts in batches:
            raw = [x.encode() for x in texts]
            ids, at = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64), 2)
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]


def test_files_round_trip(spark, make_docs, tokenizer):
    rows = [(i * 7 % 101, TEXTS[i % len(TEXTS)]) for i in range(101)] + [(5, "again"), (5, "again"), (None, "last")]
    path = scratch_path(spark, "tokens")
    tf.write_token_files(make_docs(rows, extra=True).repartition(6), path, tokenizer)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids) for r in tf.token_spans(spark, path).collect())
    assert len(got) == len(rows) and got[0][0] == 0 and got[-1][1] is None
    assert all(b[0] == a[0] + a[2] for a, b in zip(got, got[1:])) and all(len(g[3]) == g[2] for g in got)
    assert [g[1] for g in got[:-1]] == sorted(r[0] for r in rows if r[0] is not None)
    t = Tokenizer.from_str(tokenizer)
    for _, doc, _, ids in got:
        texts = [x for i, x in rows if i == doc]
        assert ids in [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]
    for r in tf.with_crc32(tf.token_spans(spark, path)).collect():
        ids = next(g[3] for g in got if g[0] == r.start)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    files = sorted(Path(path.removeprefix("file:")).glob("*.parquet"))
    meta = next(m for m in (pq.ParquetFile(f).metadata for f in files) if m.num_rows)
    encodings = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in encodings["doc_id"].encodings and encodings["doc_id"].has_column_index
    assert any("DICTIONARY" in e for c, x in encodings.items() if c.startswith("ids") for e in x.encodings)


def test_empty(spark, make_docs, tokenizer):
    path = scratch_path(spark, "tokens")
    tf.write_token_files(make_docs([]), path, tokenizer)
    assert tf.with_crc32(tf.token_spans(spark, path)).count() == 0
