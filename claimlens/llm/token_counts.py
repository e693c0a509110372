"""Token counts of byte-level BPE with a compiled finite-state transducer.

The tokenizer cuts a text into pieces and encodes each piece on its own. The rules of the cut are compiled into a
deterministic transducer over kinds of characters: eight states, and for each transition whether a piece begins there.
Crossing from one piece to the next emits the number of tokens of the piece that ended; that annotation is filled in
the first time a piece is met, by the tokenizer itself.

All texts of a batch are one string with resets between them. It is dealt into chunks; every chunk runs from all eight
states at once, which gives its state map; maps are composed by a parallel prefix scan, which gives the state that each
chunk begins in; then all chunks run again from there. No chunk waits for the one before, however long a text is.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import by_bytes, utf8

LIMIT = 512
CHUNK = 128
BATCH_BYTES = 2 << 20
# Pieces whose counts a Python worker remembers, twice over. It changes time and memory, not results.
REMEMBERED = 600_000

# Kinds of characters, then symbols: what the rules look at, up to two characters ahead.
LETTER, NUMBER, OTHER, QUOTE, BLANK, SPACE = range(6)
SYMBOLS = ("letter", "number", "other", "quote2", "quote3", "blank,text", "blank", "space,text", "space")
STATES = ("letters", "numbers", "others", "blank", "spaces", "done", "one more", "two more")
RESET = len(SYMBOLS)


_LEADS = "a1!"  # a letter, a number, and neither: what joins with one of them is of its kind


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Kind of every code point, as the library's cut has it: Python's tables may be older or newer than the library's.

    A first guess is verified for whole runs of code points at once: the cut keeps a run with its lead in one piece if all of
    it is of the lead's kind. Runs that fall apart are halved; a single code point that joins with no lead is white space.
    """
    import unicodedata

    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    out = np.full(0x110000, OTHER, np.uint8)
    guess = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        guess[c] = LETTER if major == "L" else NUMBER if major == "N" else OTHER
    edges = np.flatnonzero(np.r_[True, guess[1:] != guess[:-1]]).tolist()
    runs = []  # first, end, kind to be tried
    for a, b in zip(edges, [*edges[1:], 0x110000]):
        for x, y in ((a, min(b, 0xD800)), (max(a, 0xE000), b)):  # without surrogates
            runs += [(k, min(k + 4096, y), int(guess[a])) for k in range(x, y, 4096)]
    while runs:
        text, at = [], [0]
        for a, b, kind in runs:
            text.append(_LEADS[kind] + "".join(map(chr, range(a, b))) + "\n")
            at.append(at[-1] + b - a + 2)
        ends = {begin: end for _, (begin, end) in cut("".join(text))}
        again = []
        for (a, b, kind), begin in zip(runs, at):
            if ends.get(begin, 0) >= begin + b - a + 1:
                out[a:b] = kind
            elif b - a > 1:
                again += [(a, (a + b) // 2, kind), ((a + b) // 2, b, kind)]
            elif kind != guess[a] and kind == (guess[a] + 2) % 3:
                out[a] = SPACE
            else:
                again.append((a, b, (kind + 1) % 3))
        runs = again
    out[ord("'")], out[ord(" ")] = QUOTE, BLANK
    return out


def _step(state: str, symbol: str) -> tuple[str, bool]:
    """Next state, and whether a piece begins with this character."""
    if state in ("one more", "two more"):
        return ("done" if state == "one more" else "one more"), False
    kind, _, ahead = symbol.partition(",")
    if kind in ("blank", "space"):
        if not ahead:
            return "spaces", state != "spaces"
        return ("blank" if kind == "blank" else "done"), True
    run = {"letter": "letters", "number": "numbers"}.get(kind, "others")
    if state in (run, "blank"):
        return run, False
    return {"quote2": "one more", "quote3": "two more"}.get(kind, run), True


def compile_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Tables over symbol * 8 + state: next state, and whether a piece begins. Symbols from RESET on begin a text."""
    n = len(STATES)
    move, begins = np.zeros(2 * RESET * n, np.uint8), np.zeros(2 * RESET * n, bool)
    for s, symbol in enumerate(SYMBOLS):
        for q, state in enumerate(STATES):
            for at, origin in ((s * n + q, state), ((s + RESET) * n + q, "done")):
                after, begins[at] = _step(origin, symbol)
                move[at] = STATES.index(after)
    return move, begins


MOVE, BEGINS = compile_transducer()


def symbols(codes: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Symbol of every code point; ``resets`` are the places where texts begin."""
    kind, n = kinds()[codes], len(codes)
    first = np.zeros(n + 1, bool)
    first[resets[resets < n]], first[n] = True, True
    space = kind >= BLANK
    text_ahead = np.r_[~space[1:], False] & ~first[1:]
    out = np.array([0, 1, 2, 2, 6, 8], np.uint8)[kind]
    out[space & text_ahead] -= 1
    at = np.flatnonzero((kind == QUOTE) & text_ahead)
    one = codes[at + 1]
    out[at[np.isin(one, [ord(c) for c in "stmd"])]] = SYMBOLS.index("quote2")
    at, one = at[:0] if n < 3 else at[(at + 2 < n)], one if n < 3 else one[(at + 2 < n)]
    if len(at):
        two = codes[at + 2]
        pair = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        out[at[pair & ~first[at + 2]]] = SYMBOLS.index("quote3")
    out[first[:-1]] += RESET
    return out


def state_maps(rows: np.ndarray) -> np.ndarray:
    """State after each chunk by the state before it: ``rows`` is (place in chunk, chunk), the result (state, chunk)."""
    n = len(STATES)
    maps = np.repeat(np.arange(n, dtype=np.uint8)[:, None], rows.shape[1], axis=1)
    for row in rows:
        maps = MOVE.take(row * n + maps)
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """State before each chunk, from the map of each: maps of neighbours are composed over doubling distances."""
    total, step, n = maps.copy(), 1, maps.shape[1]
    while step < n:
        total[:, step:] = np.take_along_axis(total[:, step:], total[:, :-step], axis=0)
        step *= 2
    return np.r_[STATES.index("done"), total[STATES.index("done"), :-1]].astype(np.uint8)


def piece_starts(codes: np.ndarray, resets: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Places where the pieces of all texts begin."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.zeros(-(-n // chunk) * chunk, np.uint8)
    padded[:n] = symbols(codes, resets)
    rows = np.ascontiguousarray(padded.reshape(-1, chunk).T)
    state = prefix_scan(state_maps(rows))
    at = np.empty_like(rows)
    for j, row in enumerate(rows):
        at[j] = row * len(STATES) + state
        state = MOVE.take(at[j])
    return np.flatnonzero(BEGINS.take(at).T.ravel()[:n])


class TokenCounter:
    """Numbers of tokens of whole texts, for tokenizers of byte-level BPE with the usual rules of the cut."""

    def __init__(self, text: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
        from tokenizers import Tokenizer

        spec = json.loads(text)
        cut = spec["pre_tokenizer"] or {}
        if cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("compiled for byte-level BPE without normalizer and prefix blank only")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        own = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in own)) if own else None
        self.tokenizer, self.remembered = Tokenizer.from_str(text), remembered
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _emitted(self, pieces: list[str]) -> np.ndarray:
        young = self.young
        counts = [young.get(p, -1) for p in pieces]
        if -1 in counts:
            if len(young) > self.remembered:
                self.old, self.young = young, {}
                young = self.young
            missing = {p for p in pieces if p not in young}
            known = {p: self.old[p] for p in missing if p in self.old}
            new = list(missing - known.keys())
            young |= known
            young |= {p: len(e.ids) for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))}
            counts = [young[p] for p in pieces]
        return np.array(counts, np.int64)

    def count(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens of each of the texts that lie in ``data`` (UTF-8) between the n + 1 offsets ``at``."""
        raw, counts = data.tobytes(), np.zeros(len(at) - 1, np.int64)
        bounds, inside = [at[:-1]], []
        if self.special:
            for found in self.special.finditer(raw):
                owner = np.searchsorted(at, found.start(), "right") - 1
                if found.end() <= at[owner + 1]:
                    inside.append(found.span())
                    counts[owner] += 1
        bounds = np.unique(np.r_[at[:-1], np.array(inside, np.int64).ravel()])
        place = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        text = raw.decode()
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = piece_starts(codes, place[bounds])
        if inside:  # nothing is emitted for pieces inside an added token
            a, b = place[np.array(inside)].T
            drop = np.searchsorted(a, starts, "right") - 1
            ends = np.r_[starts[1:], len(codes)]
            keep = (drop < 0) | (starts >= b[np.maximum(drop, 0)])
            starts, ends = starts[keep], ends[keep]
        else:
            ends = np.r_[starts[1:], len(codes)]
        if len(starts):
            owner = np.searchsorted(place[at], starts, "right") - 1
            for k in range(0, len(starts), 1 << 18):
                part = slice(k, k + (1 << 18))
                emitted = self._emitted([text[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist())])
                counts += np.bincount(owner[part], weights=emitted, minlength=len(counts)).astype(np.int64)
        return counts


_counters: dict[str, TokenCounter] = {}


def _counter(text: str) -> TokenCounter:
    key = md5(text.encode()).hexdigest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = TokenCounter(text)
    return _counters[key]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of (doc_id, text); ``tokenizer`` is the JSON text of its file.

    No tokens are added at the ends; strings of added tokens inside a text count as one token, as by default. A null
    text is an empty one and has no tokens; null and repeated doc_ids stay rows of their own; an empty table stays
    empty; other columns are ignored. A text is never cut; one longer than a batch is a batch of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            data, at = utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(counter.count(data, at))], names=schema.names)

    counted = docs.select("doc_id", "text").mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
