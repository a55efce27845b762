"""Quality rules over repetition, from suffix arrays.

The words of a run of documents are numbered and sorted as one suffix array by
prefix doubling.  A sentinel after each document keeps repeats inside it: only
suffixes of one document share a first rank, and only positions whose rank is
still shared are sorted again.  The ranks of each round then give the longest
common prefix of neighbouring suffixes; where repeats are so long that the rounds
would take much memory, Kasai's algorithm finds the same from the last ranks.  An interval of the array whose
neighbours share at least L words is a maximal repeated substring, so the union
of the spans of all intervals is, at each position, the larger of the prefixes
it shares with its two neighbours.

A document fails where it is short (``MIN_WORDS``), where 3-word windows found
twice cover more than half of it, or, by the method, where repeats of at least
``REPEAT_WORDS`` words cover more than ``MOST_COVERED`` of it, or where its
longest repeat is over ``MOST_REPEAT`` of it.

Edge cases: null has no words (and fails as short); repeated rows each get the
same verdict; an empty table gives an empty result; long texts are taken whole,
in runs of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

MIN_WORDS = 50
WINDOW = 3
#: A document fails where 100 * n_repeat_words > MOST_WINDOWS * n_words.
MOST_WINDOWS = 50
REPEAT_WORDS = 10
MOST_COVERED = 0.3
MOST_REPEAT = 0.2
SYMBOLS = "#*$%&|<>"
#: Characters whose documents share one suffix array.
RUN_CHARS = 1 << 20
#: Rounds of doubling whose ranks are kept: repeats of up to 2 ** ROUNDS words.
ROUNDS = 10
_SPACE = " \t\n\x0b\x0c\r"

FIELDS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "covered_words": pa.int64(),
    "longest_repeat": pa.int64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
}
KIND = "struct<" + ",".join(f"{k}:{'boolean' if v == pa.bool_() else 'long'}" for k, v in FIELDS.items()) + ">"


def suffix_keys(tokens: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One number for each document and word, so that no two documents have one in common.

    ``tokens`` are word numbers, -1 after each document; ``doc`` numbers the documents.
    """
    return doc.astype(np.int64) * (int(tokens.max(initial=0)) + 2) + tokens + 1


def suffix_ranks(key: np.ndarray) -> list[np.ndarray]:
    """The ranks of all suffixes by their first 1, 2, 4, ... tokens; only the last ranks where there are over ``ROUNDS``.

    A rank is the place of the first suffix that starts alike.  The last array has no ties.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int32)
    rank[order] = _starts(key[order])
    levels, width = [rank], 1
    active = order[_tied(rank[order])]
    while len(active):
        # A tied suffix can't reach past its sentinel, so active + width stays inside.
        first = rank[active].astype(np.int64)
        pair = first * (n + 1) + rank[active + width]
        by = np.argsort(pair, kind="stable")
        active, pair, first = active[by], pair[by], first[by]
        begin = np.r_[True, first[1:] != first[:-1]]
        place = np.arange(len(active)) - np.maximum.accumulate(np.where(begin, np.arange(len(active)), 0))
        new = np.r_[True, pair[1:] != pair[:-1]]
        rank = rank.copy()
        rank[active] = first + np.maximum.accumulate(np.where(new, np.arange(len(active)), 0)) - (np.arange(len(active)) - place)
        levels = [*levels, rank] if 0 < len(levels) < ROUNDS else []
        width *= 2
        active = active[_tied(rank[active])]
    return levels or [rank]


def _neighbours(key: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Kasai: the tokens that each suffix of the array shares with the one before it; one array beside its arguments."""
    shared = np.zeros(len(key), np.int64)
    keys, before, h = key.tolist(), np.empty(len(key), np.int64), 0
    before[order[1:]], before[order[:1]] = order[:-1], -1
    for i, j in enumerate(before.tolist()):
        if j < 0:
            h = 0
            continue
        # The sentinels differ, so that no run passes the end of a document.
        while keys[i + h] == keys[j + h]:
            h += 1
        shared[i] = h
        h = max(h - 1, 0)
    return shared[order[1:]]


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    new = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]] if len(sorted_keys) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(sorted_keys)), 0)) if len(sorted_keys) else np.zeros(0, np.int64)


def _tied(sorted_ranks: np.ndarray) -> np.ndarray:
    if len(sorted_ranks) < 2:
        return np.zeros(len(sorted_ranks), bool)
    same = sorted_ranks[1:] == sorted_ranks[:-1]
    return np.r_[same, False] | np.r_[False, same]


def repeat_lengths(tokens: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position the length of the longest repeat that starts there."""
    key = suffix_keys(tokens, doc)
    levels = suffix_ranks(key)
    n = len(tokens)
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    # Longest common prefixes of neighbours, from the widest round to the narrowest.
    left, right = order[:-1], order[1:]
    shared = np.zeros(n - 1 if n else 0, np.int64)
    live = np.flatnonzero(key[left] == key[right]) if n else np.zeros(0, np.int64)
    if len(levels) == 1 and len(live):
        return _longest(left, right, _neighbours(key, order, levels[0]), n)
    a, b, got = left[live].copy(), right[live].copy(), np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (a < n) & (b < n)
        same[same] = levels[k][a[same]] == levels[k][b[same]]
        step = same.astype(np.int64) << k
        a, b, got = a + step, b + step, got + step
    shared[live] = got
    return _longest(left, right, shared, n)


def _longest(left: np.ndarray, right: np.ndarray, shared: np.ndarray, n: int) -> np.ndarray:
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, left, shared)
    np.maximum.at(longest, right, shared)
    return longest


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie inside one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The columns of ``FIELDS`` for a run of texts."""
    words = [t.encode().split() if t else [] for t in texts]  # on bytes, split() takes the six ASCII blanks
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1  # where the sentinels stand
    total = int(sizes.sum()) + len(words)
    tokens = np.full(total, -1, np.int64)
    inside = np.ones(total, bool)
    inside[ends] = False
    flat = pa.array([w for ws in words for w in ws], pa.binary())
    tokens[inside] = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(words)), sizes + 1)
    longest = repeat_lengths(tokens, doc)

    def per_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=x, minlength=len(words)).astype(np.int64)

    at = np.flatnonzero(longest >= WINDOW)
    windows = per_doc(_covered(at, np.full(len(at), WINDOW), total))
    at = np.flatnonzero(longest >= REPEAT_WORDS)
    covered = per_doc(_covered(at, longest[at], total))
    most = np.zeros(len(words), np.int64)
    np.maximum.at(most, doc, longest)
    symbols = np.array([sum(map(t.count, SYMBOLS)) if t else 0 for t in texts], np.int64)
    base = (sizes < MIN_WORDS) | (100 * windows > MOST_WINDOWS * sizes)
    kept = ~base & (covered <= MOST_COVERED * sizes) & ~((most >= REPEAT_WORDS) & (most > MOST_REPEAT * sizes))
    return {
        "n_words": sizes,
        "word_chars": np.array([len(t) - sum(map(t.count, _SPACE)) if t else 0 for t in texts], np.int64),
        "n_symbols": symbols,
        "n_dup_lines": np.array([_dup_lines(t) if t else 0 for t in texts], np.int64),
        "n_repeat_words": windows,
        "covered_words": covered,
        "longest_repeat": most,
        "base_failed": base,
        "kept": kept,
    }


def _measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import pyarrow.compute as pc

    from tessera.llm.token_counts import runs

    for texts in batches:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        found = [measure(texts.slice(a, b - a).to_pylist()) for a, b in runs(sizes, RUN_CHARS)]
        columns = [pa.array(np.concatenate([x[k] for x in found]) if found else [], v) for k, v in FIELDS.items()]
        yield pa.StructArray.from_arrays(columns, names=list(FIELDS))


def with_quality(docs: DataFrame, name: str = "__quality") -> DataFrame:
    """``docs`` with a struct of all measures and the verdict."""
    return docs.withColumn(name, F.arrow_udf(_measure, KIND)("text"))


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, every measure, base_failed and kept, for each row."""
    return with_quality(docs.select("doc_id", "text")).select("doc_id", "__quality.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, with the same columns."""
    return with_quality(docs).filter("__quality.kept").drop("__quality")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))
