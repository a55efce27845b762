"""Near-duplicate detection by Order MinHash, verified by banded alignment.

Words are runs between blanks, lower-cased.  Two texts are near-duplicates where
their edit similarity, 1 - (words inserted, deleted or replaced) / (words of the
longer), is at least ``SIMILARITY``.  A text's k-mers are its runs of five words,
each labelled with its occurrence number, so that all are distinct.  A sketch takes
the ``TAKEN`` least k-mers under one hash and keeps them in text order: two texts
agree on it about as often as that many k-mers of their union are shared, in the
same order.  Words replaced at random leave a pair at similarity 0.85 with 0.3 of
its k-mers in common, so ``SKETCHES`` sketches of few k-mers find it nearly always.

1. Equal texts (by 128-bit digest) form a class, stood for by its smallest doc_id.
2. Sketches of representatives are grouped into buckets.  Each representative is
   first paired with the smallest id in any of its buckets, one pair each.
3. Pairs are verified by a banded alignment of their words: texts at the threshold
   lie within a fifth of their length of the diagonal.  Pairs whose lengths or bags
   of words can't reach the threshold are put aside without one.
4. Verified pairs give components.  Buckets whose members lie in several are open.
   In open buckets of up to ``PAIRWISE`` members every pair of different components
   is verified; in larger ones each member is first paired with one more member of the
   bucket, another one in each bucket.
5. Members of large buckets that are still open are told apart exactly.  An edit touches
   two of a text's pairs of neighbouring words, so a text of whose pairs no other
   component holds three fifths has no near-duplicate there; most that only share a
   passage go by that.  The others meet by their rarest words.  Near-duplicates share
   all but a fifth of the longer one's words, so in any fixed order of the words they
   share ``SHARED`` among the first fifth and ``SHARED`` more of each.  All pairs that
   do are verified while they lie in different components, each text's most alike first.

So every pair of texts that share a bucket, of any size, is in one component, verified,
or told apart by a bound that no near-duplicates miss.  A pair shares a bucket with a
probability, as with any sketch; the tests measure it, at each similarity.

Edge cases: a null text is an empty one, and all empty ones are copies; a text of
under five words is one k-mer, so it only meets its equals up to case and blanks;
rows that share a doc_id are one document (repeated rows give one row each, with one
class); rows without a doc_id are in no class; an empty table gives an empty result;
long texts are taken whole; ties don't matter, as the smallest id stands for a class;
no bucket, class or component is ever gathered in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_cut, join_groups, table, trim_memory

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 48
#: k-mers in each sketch.
TAKEN = 2
#: Members of a bucket among whom all pairs of different components are verified; those of larger ones meet by rare words.
PAIRWISE = 24
#: Rare words that a pair of members of large buckets has to share.
SHARED = 4
#: Texts that tell how rare words are, and counters for it.  They only order the words: any order finds the same pairs.
COUNTED, COUNTERS = 20_000, 1 << 20
#: Texts for each part of a word's texts that are looked at together, and parts at most.
PART_TEXTS, PARTS = 4_096, 16
#: Rounds that put aside texts without enough pairs of words in other components; each leaves fewer for the next.
ROUNDS = 2
#: Bits for each word, and in all, that tell which runs of words several components hold.  Runs that share a bit are kept.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Parts that these bits are gathered in.
SLICES = 64
#: Candidates whose ids are broadcast to pick their texts; beyond, the texts are shuffled to them.
BROADCAST_IDS = 1_000_000
SEED = 20_240_101
#: Values of a text's hash table held at once.
RANKS_AT_ONCE = 1 << 18
#: The first band of an alignment, in words; doubled until the threshold is decided.
BAND = 32
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 32-bit hash of each word."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").lower().split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)).astype(np.uint32)


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """The hashes of all runs of n words, in order."""
    count = max(len(words) - n + 1, 0)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        h = _mix(words.astype(np.uint64) + _U(1))
        for i in range(n):
            out *= _U(0xD6E8FEB86659FD93)
            out += h[i : i + count]
        return _mix(out)


def shingles(words: np.ndarray) -> np.ndarray:
    """The hashes of runs of five words, in order; of all words where there are fewer."""
    return _runs(words, max(min(SHINGLE, len(words)), 1))


def labelled(s: np.ndarray) -> np.ndarray:
    """Each shingle mixed with how often it occurred before."""
    t = np.sort(s)
    if not (t[1:] == t[:-1]).any():
        return s
    order = np.argsort(s, kind="stable")
    new = np.r_[True, t[1:] != t[:-1]]
    at = np.arange(len(t))
    count = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(s)
    with np.errstate(over="ignore"):
        out[order] = np.where(count > 0, _mix(t + _U(0x9E3779B97F4A7C15) * count.astype(np.uint64)), t)
    return out


def sketches(texts: list[np.ndarray], taken: int = TAKEN) -> list[np.ndarray]:
    """Each text's sketches, as distinct 64-bit keys: the ``taken`` least k-mers under each hash, in text order."""
    from xxhash import xxh3_64_intdigest

    keys = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(SEED + taken))
    turn, odd = keys.astype(np.uint32)[:, None], ((keys >> _U(32)).astype(np.uint32) | np.uint32(1))[:, None]
    every = _runs(np.concatenate([np.zeros(0, np.uint32), *texts]), SHINGLE)
    begin, picked, short = 0, [], {}
    for i, words in enumerate(texts):
        s = labelled(every[begin : begin + len(words) - SHINGLE + 1]) if len(words) >= SHINGLE else shingles(words)
        begin += len(words)
        if len(s) > taken:
            picked.append(s[_least(s.astype(np.uint32), turn, odd, taken)])
        else:
            short[i] = s  # all of a short text, under any hash
    out = []
    with np.errstate(over="ignore"):
        got = np.full((len(picked), SKETCHES), _U(taken))
        if picked:
            whole = np.stack(picked)
            for j in range(taken):
                got = _mix(got * _U(5) + whole[:, :, j])
        got = iter(_mix(got ^ keys))
        for i in range(len(texts)):
            out.append(next(got) if i not in short else np.array([xxh3_64_intdigest(short[i].tobytes(), taken)], np.uint64))
    return out


def _least(low: np.ndarray, turn: np.ndarray, odd: np.ndarray, taken: int) -> np.ndarray:
    """For each hash the places of the ``taken`` least of ``low``, in order."""
    least = np.empty((len(turn), taken), np.int64)
    step = max(1, RANKS_AT_ONCE // len(low))
    for at in range(0, len(turn), step):
        # Multiply-shift orders the k-mers anew for each hash; they are mixed already.
        ranks = (low ^ turn[at : at + step]) * odd[at : at + step]
        ranks ^= ranks >> np.uint32(16)
        some = least[at : at + step]
        for j in range(taken):
            some[:, j] = ranks.argmin(axis=1)
            ranks[np.arange(len(ranks)), some[:, j]] = np.uint32(0xFFFFFFFF)
    least.sort(axis=1)
    return least


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        texts = [text.as_py() or "" for text in batch.column(1)]
        hashes, words = [xxh3_128_digest(t) for t in texts], [word_hashes(t) for t in texts]
        sizes, keys = list(map(len, words)), [k.view(np.int64) for k in sketches(words)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n", "keys"])
    trim_memory()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [word_hashes(t.as_py()).view(np.int32) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["id", "words"])
    trim_memory()


def packed_words(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, words) of some documents, written; rows that share a doc_id are one document."""
    few = ids.count() <= BROADCAST_IDS
    some = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["id"], "left_semi")
    rows = cut(some.select("doc_id", "text").mapInArrow(_packed, "id long, words array<int>"), "words")
    return rows if rows.count() == ids.count() else cut(rows.groupBy("id").agg(F.first("words").alias("words")), "words")


def _arrays(column: pa.Array) -> list[np.ndarray]:
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _allowed(n: int) -> int:
    """Edits that a text of n words may be away from one that isn't longer."""
    return int((1 - SIMILARITY) * n + 1e-9)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for words in _arrays(batch.column(0)):
            seen[np.unique(labelled(_runs(words.view(np.uint32), 1)) % _U(COUNTERS))] += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["counter", "n"])


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the run of n words that ends in each word, repeated ones numbered."""
    return labelled(_runs(np.concatenate([np.zeros(n - 1, np.uint32), words.view(np.uint32)]), n))


def _by_text(texts: DataFrame) -> DataFrame:
    """``texts`` (id, words), each its own component where it has none yet."""
    return texts.select("id", "words", "component" if "component" in texts.columns else F.col("id").alias("component"))


class Several:
    """Which runs of n words texts (id, words, component) of several components hold; some others pass for such, too."""

    def __init__(self, texts: DataFrame, n: int) -> None:
        total = texts.agg(F.sum(F.size("words"))).first()[0] or 0
        self.n, self.bits = n, min(max((BITS_EACH * total - 1).bit_length(), 16), MOST_BITS.bit_length() - 1)
        bits = self.bits
        each = (1 << bits) // SLICES

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [_grams(w, n) >> _U(64 - bits) for w in _arrays(batch.column(1))]
                at, of = np.concatenate([np.zeros(0, _U), *found]), np.repeat(batch.column(2).to_numpy(), [len(f) for f in found])
                order = np.lexsort((of, at))
                at, of = at[order].astype(np.int32), of[order]
                new = np.r_[True, (at[1:] != at[:-1]) | (of[1:] != of[:-1])][: len(at)]
                at, of = at[new], of[new]
                ends = np.searchsorted(at, np.arange(SLICES + 1) * each)
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (at, of)]
                yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), *lists], names=["slice", "at", "component"]).filter(pa.array(np.diff(ends) > 0))
            trim_memory()

        def gathered(rows: pa.Table) -> pa.Table:
            at, of = (np.concatenate([c.flatten().to_numpy() for c in rows[k].chunks]) for k in ("at", "component"))
            order = np.lexsort((of, at))
            at, of = at[order], of[order]
            held = np.zeros(each, bool)
            held[at[1:][(at[1:] == at[:-1]) & (of[1:] != of[:-1])] % each] = True
            return pa.table({"slice": rows["slice"][:1], "held": pa.array([zlib.compress(np.packbits(held).tobytes(), 1)], pa.binary())})

        rows = texts.select("id", "words", "component").mapInArrow(places, "slice int, at array<int>, component array<long>")
        # At most MOST_BITS in all come to the driver.
        found = {r["slice"]: r["held"] for r in rows.groupBy("slice").applyInArrow(gathered, "slice int, held binary").collect()}
        none = zlib.compress(bytes(each // 8), 1)
        self.held = [found.get(i, none) for i in range(SLICES)]

    def __getstate__(self) -> tuple:
        return self.n, self.bits, self.held

    def __setstate__(self, state: tuple) -> None:
        self.n, self.bits, self.held = state
        self.map = np.frombuffer(b"".join(map(zlib.decompress, self.held)), np.uint8)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Which of some runs these are."""
        at = grams >> _U(64 - self.bits)
        return (self.map[at >> _U(3)] >> (_U(7) - (at & _U(7))).astype(np.uint8) & 1).astype(bool)


def plausible(texts: DataFrame) -> DataFrame:
    """The texts (id, words, component) that may have a near-duplicate in another component: all that do, and few others.

    Of the pairs of neighbouring words of the longer text, each edit changes two at most; so the shorter one has three fifths, too.
    """
    for _ in range(ROUNDS):
        shared = texts.sparkSession.sparkContext.broadcast(Several(texts, 2))

        def enough(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = [int(shared.value.of(_grams(w, 2)).sum()) >= (1 - 2 * (1 - SIMILARITY)) * len(w) - 1e-9 for w in _arrays(batch.column(1))]
                yield batch.filter(pa.array(good, pa.bool_()))
            trim_memory()

        texts = cut(texts.select("id", "words", "component").mapInArrow(enough, "id long, words array<int>, component long"), "plausible")
    return texts


def rare_words(texts: DataFrame) -> DataFrame:
    """(id, n, rare) of texts (id, words): those of the first of their words, the rarest before others, repeated ones numbered, that other components have."""
    texts = _by_text(texts)
    some = texts.orderBy(F.xxhash64("id"), "id").limit(COUNTED).select("words")
    found = some.mapInArrow(_counted, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int32)
    counts[found["counter"].to_numpy()] = found["n"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast((counts, Several(texts, 1)))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, several = shared.value
        for batch in batches:
            words, rare = _arrays(batch.column(1)), []
            for w in words:
                t = _grams(w, 1)
                t = t[np.lexsort((t, counts[t % _U(COUNTERS)]))[: _allowed(len(w)) + SHARED]]
                rare.append(t[several.of(t)].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, words)), pa.int32()), pa.array(rare, pa.list_(pa.int64()))], names=["id", "n", "rare"])
        trim_memory()

    return cut(texts.select("id", "words").mapInArrow(rarest, "id long, n int, rare array<long>"), "rare")


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of each text with those of larger components that it shares enough rare words with, and which of them shares most."""
    for batch in batches:
        ones, others, firsts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        met, at = batch.column(4).values, batch.column(4).offsets.to_numpy()
        ids, ns, sizes, comps = (met.field(k).to_numpy() for k in ("id", "n", "size", "component"))
        mine = (batch.column(i).to_pylist() for i in range(4))
        for x, n, size, comp, i, j in zip(*mine, at[:-1], at[1:], strict=True):
            larger = (sizes[i:j] > size) | (sizes[i:j] == size) & (comps[i:j] > comp)
            y, first, shared = np.unique(ids[i:j][larger], return_index=True, return_counts=True)
            m = ns[i:j][larger][first]
            good = (np.minimum(m, n) >= SIMILARITY * np.maximum(m, n) - 1e-9) & (shared >= np.minimum(SHARED, np.maximum(m, n)))
            y, shared = y[good], shared[good]
            ones.append(np.full(len(y), x))
            others.append(y)
            firsts.append(np.arange(len(y)) == (shared.argmax() if len(y) else 0))
        x, y = np.concatenate(ones), np.concatenate(others)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.concatenate(firsts))], names=["a", "b", "best"])
    trim_memory()


def meetings(rare: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, best) of different components among texts (id, n, rare) that may reach the threshold; the best ones first join components.

    A word's texts are gathered in parts, and asked for by those of all its components but the largest.
    """
    placed = cut(rare.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"))
    placed = cut(join_groups(placed, sizes, "component").repartition("id"), "placed")
    rows = cut(placed.select("id", "n", "size", "component", F.explode("rare").alias("word")), "rows")
    of, parts = F.struct("size", "component"), min(placed.count() // PART_TEXTS + 1, PARTS)
    there = rows.groupBy("word", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.max(of).alias("top"), F.min(of).alias("low"), F.collect_list(F.struct("id", "n", "size", "component")).alias("met"))
    there = there if parts > 1 else there.filter("low < top")
    met = rows.join(cut(there.drop("low"), "there"), "word").filter(of < F.col("top")).groupBy("id", "n", "size", "component", "part").agg(F.flatten(F.collect_list("met")).alias("met"))
    return met.select("id", "n", "size", "component", "met").mapInArrow(_meeting, "a long, b long, best boolean")


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edit distance of two sequences where it is at most ``most``, else None.

    Myers' bit vectors over a band of 2 * band + 1 diagonals: bit t of a column j
    stands for row j - band + t, so the band moves down by one bit a column.  Cells
    outside count as one worse than their neighbour inside, which no alignment within
    the band needs.  The score is read along the diagonal that ends in the last cell.
    """
    if len(a) < len(b):
        a, b = b, a
    k = min(len(a), len(b))
    apart = a[:k] != b[:k]
    head = int(apart.argmax()) if apart.any() else k
    a, b = a[head:], b[head:]
    k = min(len(a), len(b))
    apart = a[len(a) - k :][::-1] != b[len(b) - k :][::-1]
    tail = int(apart.argmax()) if apart.any() else k
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    more = len(a) - len(b)
    if more > most:
        return None
    if not b:
        return more
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    band = min(max(BAND, more), most)
    while True:
        found = _banded(places, b, more, band)
        if found is not None or band == most:
            return found
        band = min(2 * band, most)


def _banded(places: dict[int, int], b: list[int], more: int, band: int) -> int | None:
    """The distance where it is at most ``band``, else None; ``places`` has the rows of each word as bits."""
    width = 2 * band + 1
    every, top, read = (1 << width) - 1, 1 << (width - 1), 1 << (band + more)
    up, down, score, shift = ((1 << band) - 1) << (band + 1), 0, more, -band
    for w in b:
        equal = places.get(w, 0)
        equal = (equal >> shift if shift >= 0 else equal << -shift) & every
        shift += 1
        up, down = up >> 1 | top, down >> 1
        free = ((((equal & up) + up) ^ up) | equal | down) & every
        if not free & read:
            score += 1
            if score > band:
                return None
        worse = (down | ~(free | up)) & every
        better = free & up
        worse = (worse << 1 | 1) & every
        better = (better << 1) & every
        up, down = better | (~(free | worse) & every), worse & free
    return score


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the edit similarity of two sequences of words reaches the threshold."""
    longer = max(len(a), len(b))
    most = int((1 - SIMILARITY) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    # Every kept word is in both texts, as often.
    at = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    left, right = np.bincount(at[: len(a)], minlength=longer), np.bincount(at[len(a) :], minlength=longer)
    k = min(len(left), len(right))
    if int(np.minimum(left[:k], right[:k]).sum()) < longer - most:
        return False
    return edits_within(a, b, most) is not None


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [similar(x, y) for x, y in zip(_arrays(batch.column(2)), _arrays(batch.column(3)), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
    trim_memory()


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of representatives whose texts reach the threshold."""
    left = texts.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    right = texts.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "wa", "wb")
    return cut(joined.mapInArrow(_verified, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in ``links`` (a, b) the smallest id it is connected to.

    Every node takes the least id of its neighbourhood, then that one's; nodes with the
    same are one from then on, and what is left of the links between them goes on until
    none is.  So links become few after a round, and no round looks at all of them again.
    """
    edges = cut(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).filter("x <> y").distinct(), "edges")
    labels = None
    while True:
        up = edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("c"))
        up = cut(up.join(up.select(F.col("x").alias("c"), F.col("c").alias("component")), "c").select(F.col("x").alias("id"), "component"), "up")
        if labels is None:
            labels = up
        else:
            labels = labels.join(up.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        one, two = (up.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "xy")
        left = cut(edges.join(one, "x").join(two, "y").filter("cx <> cy").select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct(), "edges")
        drop_cut(edges)
        edges = left
        if not edges.limit(1).count():
            return cut(labels, "labels")


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after some more links: only components that these join are looked at again."""
    one, two = (labels.select(F.col("id").alias(x), F.col("component").alias(c)) for x, c in (("a", "ca"), ("b", "cb")))
    ends = cut(links.join(one, "a", "left").join(two, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "ends")
    met = ends.filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    moved = components(met).select(F.col("id").alias("component"), F.col("component").alias("to"))
    new = ends.select(F.explode(F.array(F.struct("a", "ca"), F.struct(F.col("b").alias("a"), F.col("cb").alias("ca")))).alias("e")).select(F.col("e.a").alias("id"), F.col("e.ca").alias("component")).filter("id = component").distinct()
    every = labels.union(new.join(labels, "id", "left_anti"))
    return cut(every.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")


def _may(n: Column, m: Column) -> Column:
    """Whether texts of n and m words can reach the threshold."""
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m) - 1e-9


def _bucketed(members: DataFrame) -> DataFrame:
    """(key, id, n, first, m) of all members (id, n, key) of shared buckets, written: the bucket's smallest id with its length, and its size."""
    one = F.struct("id", "n")
    buckets = members.groupBy("key").agg(F.min(one).alias("first"), F.max("id").alias("last"), F.count("*").alias("m")).filter("first.id < last").drop("last")
    return cut(join_groups(members, buckets, "key").filter("first is not null"), "buckets")


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets whose members lie in several components, with their component, written."""
    placed = cut(shared.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    rows = cut(placed.join(cut(several, "several"), "key", "left_semi"), "open")
    drop_cut(placed)
    return rows


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends lie in different components."""
    one, two = (labels.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    return pairs.join(one, "a", "left").join(two, "b", "left").filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def _within(rows: DataFrame) -> DataFrame:
    """All pairs of different components within buckets of at most ``PAIRWISE`` members."""
    groups = rows.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("id", "n", "component"))).alias("x"))
    partners = lambda p, i: F.transform(
        F.filter(F.slice("x", i + F.lit(2), F.lit(PAIRWISE)), lambda q: (q["component"] != p["component"]) & _may(q["n"], p["n"])), lambda q: F.struct(p["id"].alias("a"), q["id"].alias("b"))
    )
    return groups.select(F.explode(F.flatten(F.transform("x", partners))).alias("p")).select("p.a", "p.b")


def _to_first(shared: DataFrame) -> DataFrame:
    """Each member paired with the smallest id in any of its buckets that it may link to, one pair each."""
    some = shared.filter((F.col("id") != F.col("first.id")) & _may(F.col("n"), F.col("first.n")))
    return some.groupBy("id").agg(F.min("first.id").alias("a")).select("a", F.col("id").alias("b"))


def _to_one(rows: DataFrame) -> DataFrame:
    """Each member paired with one member of its bucket, drawn by a hash, where it may link."""
    hubs = rows.groupBy("key").agg(F.min_by(F.struct("id", "n", "component"), F.xxhash64("key", "id")).alias("hub"))
    pairs = rows.join(cut(hubs, "hubs"), "key").filter((F.col("hub.component") != F.col("component")) & _may(F.col("hub.n"), F.col("n")))
    return pairs.select(*_pair(F.col("id"), F.col("hub.id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, copy_of (its class's smallest doc_id), class_id (its component's), n_links (verified partners of the class)."""
    docs = docs.select("doc_id", "text")
    rows = cut(docs.filter("doc_id is not null").mapInArrow(_digests, "doc_id long, text_hash binary, n int, keys array<long>"), "sketches")
    copies = rows.groupBy("text_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    classes = cut(join_groups(rows, copies, "text_hash").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "n", "keys"), "classes")
    drop_cut(rows)

    members = classes.filter("doc_id = rep").select(F.col("rep").alias("id"), "n", F.explode("keys").alias("key"))
    shared = _bucketed(members)
    texts = packed_words(docs, cut(shared.select("id").distinct(), "candidates"))
    tried = cut(_to_first(shared), "pairs")
    links = verify(tried, texts)
    labels = components(links)

    def more(pairs: DataFrame) -> None:
        nonlocal tried, links, labels
        pairs = cut(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.limit(1).count():
            found = verify(pairs, texts)
            tried, links, labels = tried.union(pairs), links.union(found), joined_components(labels, found)

    left = _open(shared, labels)
    more(_within(left.filter(F.col("m") <= PAIRWISE)).union(_to_one(left.filter(F.col("m") > PAIRWISE))))
    drop_cut(left)
    left = _open(shared.filter(F.col("m") > PAIRWISE), labels)
    again = cut(left.select("id").distinct(), "again")
    drop_cut(left)
    drop_cut(shared)
    if again.limit(1).count():
        large = texts.join(again, "id", "left_semi").join(labels, "id", "left")
        large = plausible(cut(large.select("id", "words", F.coalesce("component", "id").alias("component")), "large"))
        met = cut(meetings(rare_words(large), labels), "met")
        more(met.filter("best").select("a", "b"))
        more(_apart(met.filter("not best").select("a", "b"), labels))
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    found = labels.join(ends, "id", "left").select(F.col("id").alias("rep"), "component", "n_links")
    out = join_groups(classes.select("doc_id", "rep"), found, "rep")
    # The result rests on two written tables; the others go.
    for table_done in (texts, tried, links, labels):
        drop_cut(table_done)
    return out.select("doc_id", F.col("rep").alias("copy_of"), F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates, that of the smallest doc_id; rows without a doc_id stay."""
    found = cut(near_duplicates(docs), "classes")
    gone = found.filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == F.col("__gone"), "left_anti")
    if found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        kept = kept.filter("doc_id is null").union(kept.filter("doc_id is not null").dropDuplicates(["doc_id"]))
    return kept


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
