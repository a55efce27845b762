"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine.

1. A bounded sample of labelled rows outside the held-out fold: the ``MAX_TOXIC``
   toxic and ``MAX_CLEAN`` clean ones with the least hash of their id.
2. Terms: all words of the sample.  Inverse
   document frequencies count every document of the corpus.
3. The examples' vectors, in an inverted index by blocks of alike examples.  Rarer
   terms add up by their postings.  For the common ones, which nearly every text
   has, each block keeps its maximum of every term: where a block's best sum so far
   and its maxima together stay below the k-th best cosine of examples already
   known, no example in it can be among the k best, and it is passed over.  The
   others are multiplied as matrices in single precision; whatever that leaves open
   about the k best is computed again in double, so they are exact.
4. The neighbours vote by cosine and class weight; a logistic curve, fitted on
   the examples' votes without themselves, turns the vote, and the number of
   telling terms in the text, into a probability.  Telling terms are far more
   frequent in toxic examples (lift and chi-square), at most ``MAX_TERMS``; they
   have no part in the cosine.  The neighbours' ids and cosines are the evidence.

The index is bounded by the sample, whatever the corpus, and is broadcast.
A word that no example has is no term.  A text without any term has no
neighbours: it gets the (smoothed) toxic share of such examples.

Edge cases: a null text is an empty one; without toxic and clean examples every
score is the smoothed share of toxic ones; repeated rows each give a row; ties
in cosine go to the example of the smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, fold_crc, table

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
MAX_TOXIC, MAX_CLEAN, MAX_TERMS = 4_000, 8_000, 2_000
#: A telling term: in at least so many toxic rows, so much likelier in them, with such a chi-square.
LEAST_TOXIC, LEAST_SHARE, LIFT, CHI_SQUARE = 3, 0.004, 5.0, 25.0
NEIGHBOURS, BLOCK = 15, 64
#: Groups of alike examples that lie side by side, and rounds that find them.
CLUSTERS, ROUNDS = 24, 6
#: Texts whose blocks are multiplied together.
TOGETHER = 64
#: A term in more than one of so many examples counts as common.
DENSE = 16
_WORD = re.compile(r"\w+")
#: ASCII in lower case, and blanks for all that is in no word.
_ASCII = bytes(ord(chr(i).lower()) if i < 128 and _WORD.match(chr(i)) else 32 for i in range(256))


def words(text: str | None) -> list[str]:
    """The terms of a text: its words, in lower case."""
    if not text:
        return []
    if text.isascii():  # the same words, sooner
        return text.encode().translate(_ASCII).decode().split()
    return _WORD.findall(text.lower())


def _fold(terms: list[str]) -> bytes:
    return zlib.compress("\n".join(terms).encode(), 1)


def _unfold(data: bytes) -> dict[str, int]:
    found = zlib.decompress(data).decode()
    return {t: i for i, t in enumerate(found.split("\n"))} if found else {}


class Terms:
    """Term numbers; broadcast as one compressed text, and built once per worker."""

    def __init__(self, terms: list[str]) -> None:
        self.numbers = {t: i for i, t in enumerate(terms)}

    def __getstate__(self) -> bytes:
        return _fold(list(self.numbers))

    def __setstate__(self, data: bytes) -> None:
        self.numbers = _unfold(data)


@dataclass
class Index:
    """Unit vectors of the examples over all their terms, most frequent terms first.

    ``starts``, ``numbers`` and ``counts`` hold the examples' terms one after the
    other.  Only these travel; weights and postings are built where they are used.
    """

    terms: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    telling: np.ndarray
    starts: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray
    curve: tuple[float, float, float] = (1.0, 0.0, 0.0)
    empty_score: float = 0.5
    k: int = NEIGHBOURS

    def __post_init__(self) -> None:
        n = len(self.ids)
        of = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.starts))
        self.unit = (1 + np.log(self.counts)) * self.idf[self.numbers]
        self.unit /= np.sqrt(np.bincount(of, self.unit * self.unit, n))[of]
        order = np.argsort(self.numbers, kind="stable")
        self.posts = np.searchsorted(self.numbers[order], np.arange(len(self.idf) + 1))
        # Terms of many examples are multiplied as a matrix, the others by their postings.
        self.dense = int((np.diff(self.posts) > n / DENSE).sum())
        self.matrix = np.zeros((self.dense, n), np.float32)
        common = order[: self.posts[self.dense]]
        self.matrix[self.numbers[common], of[common]] = self.unit[common]
        self.edges = np.arange(0, n, BLOCK)
        self.most = np.maximum.reduceat(self.matrix, self.edges, axis=1) if n else np.zeros((self.dense, 0), np.float32)
        rare = order[self.posts[self.dense] :]
        self.posts = self.posts - len(common)
        self.members, self.parts = of[rare].astype(np.intp), self.unit[rare]
        self.query = np.zeros(len(self.idf))

    def __getstate__(self) -> dict:
        """The parts that the others follow from, compressed; within an example, terms as differences."""
        gaps = np.diff(self.numbers, prepend=np.int32(0))
        packed = {"numbers": zlib.compress(gaps.astype(np.int32).tobytes(), 1), "counts": zlib.compress(self.counts.astype(np.int32).tobytes(), 1), "terms": _fold(list(self.terms))}
        return {f.name: getattr(self, f.name) for f in fields(self)} | packed

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.numbers = np.cumsum(np.frombuffer(zlib.decompress(state["numbers"]), np.int32), dtype=np.int32)
        self.counts = np.frombuffer(zlib.decompress(state["counts"]), np.int32)
        self.terms = _unfold(state["terms"])
        self.__post_init__()

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit weights of a text."""
        found = Counter(words(text))
        terms = np.fromiter(map(self.terms.get, found, repeat(-1)), np.int64, len(found))
        counts = np.fromiter(found.values(), float, len(found))
        known = terms >= 0
        return self.weigh(terms[known], counts[known])

    def weigh(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[terms]
        return terms, w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, terms: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above zero, and their cosines; exact."""
        return next(self.search([(terms, weights)], [without]))

    def search(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of many vectors."""
        for begin in range(0, len(vectors), BLOCK):
            some = vectors[begin : begin + BLOCK]
            near = self._near(some, without[begin : begin + BLOCK] if without else [-1] * len(some))
            for (terms, weights), cosines in zip(some, near, strict=True):
                yield self._best(terms, weights, cosines)

    def _near(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int]) -> np.ndarray:
        """The cosines of some vectors to all examples, common terms in single precision; -1 where a block is passed over."""
        n = len(self.ids)
        common, near = np.zeros((len(vectors), self.dense), np.float32), np.zeros((len(vectors), n))
        for i, (terms, weights) in enumerate(vectors):
            low = terms < self.dense
            common[i, terms[low]] = weights[low]
            if not low.all():
                begin = self.posts[terms[~low]]
                sizes = self.posts[terms[~low] + 1] - begin
                ends = np.cumsum(sizes)
                at = np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1])
                near[i] = np.bincount(self.members[at], self.parts[at] * np.repeat(weights[~low], sizes), n)
            if without[i] >= 0:
                near[i, without[i]] = -9
        if not n or not self.dense:
            return near
        bound = np.maximum.reduceat(near, self.edges, axis=1) + common @ self.most
        first = bound.argmax(axis=1)
        # The k-th best cosine of the most promising block is a floor for the k-th best of all.
        floor = np.full(len(vectors), -9.0)
        for i, b in enumerate(first.tolist()):
            at = slice(b * BLOCK, min((b + 1) * BLOCK, n))
            if at.stop - at.start >= self.k:
                floor[i] = np.partition(near[i, at] + common[i] @ self.matrix[:, at], -self.k)[-self.k] - self.slack
        alive = bound >= floor[:, None]
        # Texts that are nearest to the same blocks leave the same ones to multiply.
        order = np.argsort(first, kind="stable")
        for begin in range(0, len(order), TOGETHER):
            group = order[begin : begin + TOGETHER]
            left = alive[group].any(axis=0)
            change = [0, *(np.flatnonzero(left[1:] != left[:-1]) + 1).tolist(), len(left)]
            for one, two in zip(change[:-1], change[1:], strict=True):
                at = slice(one * BLOCK, two * BLOCK)
                if left[one]:
                    near[group, at] += common[group] @ self.matrix[:, at]
                else:
                    near[group, at] = -1
        return near

    @property
    def slack(self) -> float:
        """Twice what single precision can be off by."""
        return 2 * (self.dense + 8) * 2.0**-23

    def _best(self, terms: np.ndarray, weights: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(near)
        # What single precision can't tell from the k-th best is computed again in double.
        least = np.partition(near, n - self.k)[n - self.k] - self.slack if n > self.k else 0.0
        at = np.flatnonzero(near >= least) if least > 0 else np.flatnonzero(near > 0)
        if not len(at):
            return at, np.zeros(0)
        self.query[terms] = weights
        begin, end = self.starts[at], self.starts[at + 1]
        spans = [slice(a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        products = np.concatenate([self.unit[s] for s in spans]) * self.query[np.concatenate([self.numbers[s] for s in spans])]
        self.query[terms] = 0
        cosine = np.add.reduceat(products, np.r_[0, np.cumsum(end - begin)[:-1]])
        by = np.lexsort((self.ids[at], -cosine))[: self.k]
        return at[by], cosine[by]

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """The log odds of toxic neighbours, by cosine and class weight, smoothed by half a neighbour on either side."""
        w = cosine * self.weight[at]
        share = float((w * self.toxic[at]).sum() / w.sum())
        return float(np.log((share * len(at) + 0.5) / ((1 - share) * len(at) + 0.5)))

    def evidence(self, terms: np.ndarray, at: np.ndarray, cosine: np.ndarray) -> tuple[float, float]:
        """What the calibration sees: the vote, and the number of telling terms."""
        return self.vote(at, cosine), float(np.log1p(np.count_nonzero(self.telling[terms])))

    def score(self, texts: Iterable[str | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """The probability of each text and its evidence."""
        vectors = [self.vector(t) for t in texts]
        for (terms, _), (at, cosine) in zip(vectors, self.search(vectors), strict=True):
            if not len(at):
                yield self.empty_score, at, cosine
                continue
            a, s, b = self.curve
            vote, telling = self.evidence(terms, at, cosine)
            yield float(1 / (1 + np.exp(-(a * vote + s * telling + b)))), self.ids[at], cosine


def arranged(examples: list[tuple[int, int, np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """An order of the examples in which alike ones follow each other: by the nearest of a few centres over their common terms."""
    n = len(examples)
    if n <= BLOCK:
        return np.arange(n)
    seen = np.bincount(np.concatenate([e[2] for e in examples]), minlength=len(idf))
    rows = np.zeros((n, int((seen > n / DENSE).sum())), np.float32)
    for i, (_, _, terms, counts) in enumerate(examples):
        low = terms < rows.shape[1]
        rows[i, terms[low]] = (1 + np.log(counts[low])) * idf[terms[low]]
    rows /= np.maximum(np.sqrt((rows * rows).sum(axis=1)), 1e-9)[:, None]
    centres = rows[np.linspace(0, n - 1, CLUSTERS).astype(int)]
    for _ in range(ROUNDS):
        of = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[of == c].sum(axis=0) if (of == c).any() else centres[c] for c in range(CLUSTERS)])
        centres = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1)), 1e-9)[:, None]
    return np.lexsort(([e[0] for e in examples], (rows @ centres.T).argmax(axis=1)))


def build_index(terms: list[str], idf: np.ndarray, telling: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], weights: tuple[float, float], k: int = NEIGHBOURS) -> Index:
    """The index of (doc_id, toxic, term numbers in order, counts) with the class weights (clean, toxic), and its calibration."""
    some = [e for e in examples if len(e[2])]
    some = [some[i] for i in arranged(some, idf)]
    toxic = np.array([e[1] for e in some], float)
    join = lambda j: np.concatenate([np.zeros(0, np.int32), *(e[j] for e in some)]).astype(np.int32)
    starts = np.cumsum([0, *(len(e[2]) for e in some)])
    index = Index({t: i for i, t in enumerate(terms)}, idf, np.array([e[0] for e in some], np.int64), toxic, np.where(toxic > 0, weights[1], weights[0]), telling, starts, join(2), join(3), k=k)
    # Calibration: every example's vote without itself.
    x, y, w = [], [], []
    for begin in range(0, len(some), BLOCK):
        which = range(begin, min(begin + BLOCK, len(some)))
        vectors = [(index.numbers[s], index.unit[s]) for s in (slice(starts[i], starts[i + 1]) for i in which)]
        for i, (at, cosine) in zip(which, index.search(vectors, list(which)), strict=True):
            if len(at):
                x.append(index.evidence(vectors[i - begin][0], at, cosine))
                y.append(some[i][1])
                w.append(weights[some[i][1]])
    blank = [weights[e[1]] * np.array([e[1], 1.0]) for e in examples if not len(e[2])]
    share = np.array([1.0, 2.0]) + sum(blank, np.zeros(2))
    index.empty_score = float(share[0] / share[1])
    if x:
        index.curve = platt(np.array(x), np.array(y, float), np.array(w))
    return index


def platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Slopes and intercept of a weighted logistic curve, slightly shrunk, by Newton steps; no slope is below zero."""
    design = np.c_[x, np.ones(len(x))]
    free = [0, 1, 2]
    while True:
        d, beta = design[:, free], np.zeros(len(free))
        ridge = np.diag([1e-3] * (len(free) - 1) + [1e-6]) * w.sum() / len(w)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(d @ beta, -30, 30)))
            gradient = d.T @ (w * (p - y)) + ridge @ beta
            hessian = (d * (w * p * (1 - p))[:, None]).T @ d + ridge + 1e-9 * np.eye(len(free))
            beta -= np.clip(np.linalg.solve(hessian, gradient), -5, 5)
        low = [i for i, b in zip(free[:-1], beta, strict=False) if b < 0]
        if not low:
            out = dict(zip(free, beta, strict=True))
            return tuple(float(out.get(i, 0.0)) for i in range(3))
        free = [i for i in free if i not in low]


def _sample(labels: DataFrame, toxic: int, most: int) -> DataFrame:
    rows = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("y"))
    rows = rows.filter((F.col("y") > 0.5) if toxic else (F.col("y") < 0.5)).filter(fold_crc("doc_id", FOLDS) != HELD_OUT)
    return rows.select("doc_id", F.lit(toxic).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter[tuple[str, int]] = Counter()
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            seen.update((w, toxic) for w in set(words(text.as_py())))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["term", "toxic", "n"])


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Index:
    """The index of a corpus's labelled rows."""
    labels = labels.select("doc_id", "toxic")
    totals = labels.filter("toxic is not null and doc_id is not null").filter(fold_crc("doc_id", FOLDS) != HELD_OUT).agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("toxic") <= 0).alias("c")).first()
    # At most max_toxic + max_clean rows: safe to broadcast, so that the texts stay where they are.
    chosen = _sample(labels, 1, max_toxic).union(_sample(labels, 0, max_clean))
    sampled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), "doc_id")
    # Copies of one text count once, or all of a copied text's words would look telling.
    sampled = cut(sampled.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")), "examples")
    n = {r["toxic"]: r["count"] for r in sampled.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        index = build_index([], np.zeros(0), np.zeros(0, bool), [], (1.0, 1.0))
        index.empty_score = (totals["t"] + 1) / (totals["t"] + totals["c"] + 2)
        return index
    counts = sampled.select("text", "toxic").mapInArrow(_term_rows, "term string, toxic int, n long").groupBy("term").agg(F.sum(F.col("n") * F.col("toxic")).alias("a"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    total = n_toxic + n_clean
    chi = total * F.pow(a * (n_clean - b) - b * (n_toxic - a), F.lit(2)) / ((a + b) * (total - a - b + 1e-9) * n_toxic * n_clean)
    good = (a >= max(LEAST_TOXIC, LEAST_SHARE * n_toxic)) & (a / n_toxic > LIFT * (b + 0.5) / n_clean) & (F.col("chi") >= CHI_SQUARE)
    # All terms of a bounded sample; the most frequent have the least numbers.
    found = counts.withColumn("chi", chi).select("term", (F.col("a") + F.col("b")).alias("n"), F.when(good, F.col("chi")).alias("chi")).toArrow()
    found = sorted(zip(found["term"].to_pylist(), found["n"].to_pylist(), found["chi"].to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
    terms = [r[0] for r in found]
    telling = np.zeros(len(terms), bool)
    telling[[i for _, _, i in sorted((-r[2], r[0], i) for i, r in enumerate(found) if r[2] is not None)[:MAX_TERMS]]] = True
    del found
    shared = docs.sparkSession.sparkContext.broadcast(Terms(terms))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value.numbers
        seen, rows = np.zeros(len(lookup), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            found: Counter[str] = Counter()
            for text in batch.column(0):
                found.update(set(words(text.as_py())))
            terms = np.fromiter(map(lookup.get, found, repeat(-1)), np.int64, len(found))
            known = terms >= 0
            seen[terms[known]] += np.fromiter(found.values(), np.int64, len(found))[known]
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1], pa.int32()), pa.array(np.r_[seen[at], rows], pa.int64())], names=["term", "n"])

    df = docs.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(len(terms) + 1)
    seen[df["term"].to_numpy()] = df["n"].to_numpy()
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value.numbers
        for batch in batches:
            found = [sorted(Counter(lookup[w] for w in words(t.as_py())).items()) for t in batch.column(0)]
            packed = [[np.array([x[j] for x in c], np.int32).tobytes() for c in found] for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary())], names=["doc_id", "toxic", "terms", "counts"])

    rows = sorted(sampled.mapInArrow(vectors, "doc_id long, toxic int, terms binary, counts binary").collect())
    shared.unpersist()
    examples = [(r["doc_id"], r["toxic"], np.frombuffer(r["terms"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in rows]
    return build_index(terms, idf, telling, examples, (totals["c"] / n_clean, totals["t"] / n_toxic))


def score_toxicity(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, held_out, score, predicted, and the evidence: neighbours and their cosines."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        for texts in batches:
            found = list(index.score(t.as_py() for t in texts))
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1].tolist() for f in found], pa.list_(pa.int64())), pa.array([f[2].tolist() for f in found], pa.list_(pa.float64()))], names=["score", "neighbours", "cosines"])

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    scored = docs.select("doc_id", F.arrow_udf(score, "struct<score:double,neighbours:array<long>,cosines:array<double>>")("text").alias("s"))
    return scored.select("doc_id", F.coalesce(fold_crc("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "s.score", (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"), "s.neighbours", "s.cosines")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
