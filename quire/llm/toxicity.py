"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of itself and its character n-grams, in hashed buckets; a bag is the mean of its words, and a
softmax over two classes reads it. A misspelling shares most n-grams with the word it stands for. A document's bag is the worst
SHARE of its words, LEAST words at least: an average over all words drowns a few, and a text is toxic by how many such words it
has for its length, where one may well stand there by chance. Training does the same: after a first epoch on whole texts, each step
takes the words that now score highest.

As the softmax is linear in the mean, all that scoring needs is one number a bucket and a bias.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.batches import map_arrow
from quire.llm.wordhash import slices

BUCKETS = 1 << 17
DIM = 16
#: The share of a text's words that make its bag, and how many it has at least.
SHARE, LEAST = 0.05, 6
#: Longer texts are read in stretches of so many words, each half of the next; the worst one's bag counts.
STRETCH = 256
#: The classifier is fitted on at most this many labelled documents of each class, those with the smallest hash of their id,
#: and on at most this many words of each class: where a class has more, its longest documents give only some of their passages of PASSAGE words.
SAMPLE_PER_CLASS = 1200
SAMPLE_WORDS = 800_000
PASSAGE = 32
#: Passes over the sample, and the fewest steps: a small sample is passed more often.
EPOCHS, STEPS = 8, 300
BATCH_ROWS = 512
CACHED_WORDS = 300_000
#: Longer words are read in pieces, so that a few n-grams of a long one aren't drowned.
LONGEST = 64
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¿¡…“”‘’«»"


def words_of(text: str) -> list[str]:
    """The words of a text in lower case. One of more than LONGEST characters stands as pieces, each after a space, that have all its n-grams."""
    found = text.lower().split()
    if not found or max(map(len, found)) <= LONGEST:
        return found
    out = []
    for token in found:
        w = token.strip(_PUNCTUATION) or token
        if len(w) <= LONGEST:
            out.append(token)
            continue
        w = f"<{w}>"
        out.extend(" " + w[i : i + LONGEST] for i in range(0, len(w) - 4, LONGEST - 4))
    return out


def subwords(token: str) -> list[int]:
    """Buckets of a word and its character n-grams of 3 to 5, with < and > at its ends; a piece of a long word has its own ends."""
    w = token[1:] if token[0] == " " else f"<{token.strip(_PUNCTUATION) or token}>"
    grams = {w} | {w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)}
    return [zlib.crc32(g.encode("utf-8", "replace")) & (BUCKETS - 1) for g in grams]


def word_level(sizes: list[int], bound: int) -> int:
    """The most words that each text may give, so that all together give bound at most."""
    left, rest = bound, sorted(sizes)
    for k, n in enumerate(rest):
        if n * (len(rest) - k) > left:
            return left // (len(rest) - k)
        left -= n
    return max(rest, default=0)


def passages(words: list[str], most: int, seed: int) -> list[str]:
    """At most so many words: all of a short text, else passages of PASSAGE words that the seed picks, in their order."""
    if len(words) <= most:
        return words
    starts = np.arange(0, len(words), PASSAGE)
    picked = np.sort(np.random.default_rng(seed).permutation(starts)[: -(-most // PASSAGE) + 1])
    return [w for a in picked.tolist() for w in words[a : a + PASSAGE]][:most]


def sampled(rows: Iterable[tuple[str, int]], most: int, bound: int) -> tuple[list[list[str]], list[int]]:
    """(words of texts, classes) in the order of rows: the first texts of each class, at most so many, and all their words up to bound.

    Where a class has more words, level by level its longest texts give passages only, so no text pushes others out.
    """
    kept: dict[int, list[list[str]]] = {0: [], 1: []}
    held, order, same = {0: 0, 1: 0}, [], {}

    def fit(y: int) -> None:
        level = word_level([len(t) for t in kept[y]], bound)
        kept[y] = [passages(t, level, k) for k, t in enumerate(kept[y])]
        held[y] = sum(map(len, kept[y]))

    for text, y in rows:
        if len(kept[y]) == most:
            continue
        order.append((y, len(kept[y])))
        kept[y].append([same.setdefault(w, w) for w in passages(words_of(text), bound, len(kept[y]))])
        held[y] += len(kept[y][-1])
        if held[y] > 2 * bound:  # so memory stays bounded
            fit(y)
    for y in kept:
        if held[y] > bound:
            fit(y)
    return [kept[y][k] for y, k in order], [y for y, _ in order]


def _misspelt(word: str, rng: np.random.Generator) -> str:
    if len(word) < 4:
        return word
    i, kind = int(rng.integers(1, len(word) - 1)), int(rng.integers(4))
    if kind == 0:
        return word[:i] + word[i] + word[i:]
    if kind == 1:
        return word[:i] + word[i + 1 :]
    if kind == 2:
        return word[:i] + word[i + 1] + word[i] + word[i + 2 :]
    return word[:i] + "013457*@$"[int(rng.integers(9))] + word[i + 1 :]


class _Types:
    """Words as numbers, each with its buckets."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.sizes, self.buckets = array("i"), array("i")

    def of(self, word: str) -> int:
        got = self.ids.get(word)
        if got is None:
            got = self.ids[word] = len(self.sizes)
            found = subwords(word)
            self.sizes.append(len(found))
            self.buckets.extend(found)
        return got

    def csr(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([[0], np.cumsum(self.sizes)]), np.array(self.buckets, np.int32)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one after another."""
    begin = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return begin + np.arange(int(sizes.sum()))


def train(texts: list[str] | list[list[str]], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(one number a bucket, bias) from texts or their words: the logit of a bag is the bias and the mean over its words of the means of their buckets."""
    rng = np.random.default_rng(seed)
    types, docs = _Types(), []
    for t in texts:
        docs.append(np.array([types.of(w) for w in (words_of(t) if isinstance(t, str) else t)], np.int32))
    plain = len(types.sizes)
    other = np.arange(plain, dtype=np.int32)
    for w, i in list(types.ids.items()):
        other[i] = types.of(_misspelt(w, rng))
    ptr, bucket = types.csr()
    y = np.array(labels)
    keep = np.flatnonzero([len(d) > 0 for d in docs])
    if not len(keep) or len(set(y[keep].tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), -30.0
    E = (rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32)
    Wt = (rng.standard_normal((DIM, 2)) * 0.3).astype(np.float32)
    b = np.zeros(2, np.float32)
    gE, gW, gb = np.full((BUCKETS, 1), 1e-6, np.float32), np.full_like(Wt, 1e-6), np.full_like(b, 1e-6)
    rate = 0.15

    def word_scores() -> np.ndarray:
        s = (E @ (Wt[:, 1] - Wt[:, 0]))[bucket]
        return np.add.reduceat(s, ptr[:-1]) / np.diff(ptr)

    for epoch in range(max(epochs, -(-STEPS // -(-len(keep) // 64)))):
        scores = word_scores() if epoch else None
        order = keep[rng.permutation(len(keep))]
        for k in range(0, len(order), 64):
            chosen = order[k : k + 64]
            bags = [docs[d][worst(scores[docs[d]])] if epoch else docs[d] for d in chosen]
            words = np.concatenate(bags)
            swapped = rng.random(len(words)) < 0.25
            words = np.where(swapped, other[words], words)
            size = np.array([len(x) for x in bags])
            seen, at = np.unique(words, return_inverse=True)
            n_sub = ptr[seen + 1] - ptr[seen]
            sub = bucket[_spans(ptr[seen], n_sub)]
            edge = np.concatenate([[0], np.cumsum(n_sub)[:-1]])
            vec = np.add.reduceat(E[sub], edge, axis=0) / n_sub[:, None]
            doc_edge = np.concatenate([[0], np.cumsum(size)[:-1]])
            h = np.add.reduceat(vec[at], doc_edge, axis=0) / size[:, None]
            z = h @ Wt + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p.copy()
            g[np.arange(len(chosen)), y[chosen]] -= 1
            g /= len(chosen)
            dW, db, dh = h.T @ g, g.sum(0), (g @ Wt.T) / size[:, None]
            by_doc = np.repeat(np.arange(len(chosen)), size)
            dvec = np.zeros_like(vec)
            np.add.at(dvec, at, dh[by_doc].astype(np.float32))
            dsub = np.repeat(dvec / n_sub[:, None], n_sub, axis=0)
            rows, back = np.unique(sub, return_inverse=True)
            dE = np.zeros((len(rows), DIM), np.float32)
            np.add.at(dE, back, dsub.astype(np.float32))
            gE[rows, 0] += (dE**2).mean(1)
            E[rows] -= rate * dE / np.sqrt(gE[rows])
            gW += dW**2
            Wt -= rate * dW / np.sqrt(gW)
            gb += db**2
            b -= rate * db / np.sqrt(gb)
    return (E @ (Wt[:, 1] - Wt[:, 0])).astype(np.float32), float(b[1] - b[0])


def _most(n: int) -> int:
    """How many of n words make a bag."""
    return max(LEAST, -(-int(1000 * SHARE) * n // 1000))


def worst(v: np.ndarray) -> np.ndarray:
    """Which words make the bag of a text whose words have these numbers, from the one that adds least."""
    if len(v) > STRETCH:
        start = _starts(len(v))
        means = np.sort(np.lib.stride_tricks.sliding_window_view(v, STRETCH)[start], axis=1)[:, -_most(STRETCH) :].mean(1)
        a = int(start[np.argmax(means)])
        return a + worst(v[a : a + STRETCH])
    n = _most(len(v))
    return np.argsort(v, kind="stable")[-n:]


def _starts(n: int) -> np.ndarray:
    """Where stretches begin: every half STRETCH, and the last one ends with the text."""
    return np.append(np.arange(0, n - STRETCH, STRETCH // 2), n - STRETCH)


def bag_mean(v: np.ndarray) -> float:
    return float(v[worst(v)].mean())


class _Scores(dict):
    """A word's mean, worked out once while it is kept."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > CACHED_WORDS:
            self.clear()
        w = self.weights
        got = subwords(word)
        self[word] = out = sum([w[i] for i in got]) / len(got)
        return out


def _fit(most: int):
    """Rows (text, class) in their order to one row: what train() makes of their sample, the numbers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t.as_py(), y.as_py()) for whole in batches for batch in slices(whole, 0, BATCH_ROWS) for t, y in zip(batch.column(0), batch.column(1), strict=True))
        texts, ys = sampled(rows, most, SAMPLE_WORDS)
        if texts:
            weights, bias = train(texts, ys)
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"])

    return run


def _fitted(rows: DataFrame, sample: int) -> tuple[bytes, float]:
    """(float32 numbers a bucket as bytes, bias), fitted in one task on the bounded sample: the driver holds neither texts nor what training needs."""
    ordered = rows.repartition(1).sortWithinPartitions("_h", "_i", "_t").select("_t", "_y")
    got = map_arrow(ordered, _fit(sample), "weights binary, bias double").collect()
    return (bytes(got[0].weights), got[0].bias) if got else (bytes(4 * BUCKETS), -30.0)


def _scorer(shared, bias: float):
    """(id, held_out, text, *others) to (id, held_out, score, predicted, *others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Scores(np.frombuffer(shared.value, np.float32).astype(np.float64).tolist())
        for batch in (part for whole in batches for part in slices(whole, 2, BATCH_ROWS)):
            out = []
            for t in batch.column(2).to_pylist():
                v = np.array(list(map(words.__getitem__, words_of(t))), np.float64) if t else np.zeros(0)
                out.append(float(1 / (1 + np.exp(-np.clip(bag_mean(v) + bias, -40, 40)))) if len(v) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32()), *batch.columns[3:]], names=["id", "held_out", "score", "predicted", *batch.schema.names[3:]])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row of docs; score is the probability of class 1.

    Only labels of rows whose crc32 of the id as text doesn't leave 0 when divided by 5 are learned from; labels other than 0
    and 1 are ignored, and of several labels of a document the largest counts. A null or blank text has no evidence
    and the score 0. Without labels of both classes all scores are near 0. A row with a null id isn't held out and isn't learned from.
    Other columns are ignored. Training starts from a fixed seed and a sample in a fixed order, so reruns agree.
    """
    scored = _scored(docs, labels, id_col, text_col, label_col, sample, [])
    return scored.withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted toxic: each is judged by its own text, so neither shared nor null ids matter. No shuffle of texts."""
    carried = [F.col(c).alias(f"_{k}") for k, c in enumerate(docs.columns)]
    kept = _scored(docs, labels, id_col, text_col, label_col, sample, carried).filter("predicted = 0")
    return kept.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, carried: list[Column]) -> DataFrame:
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    order = [F.xxhash64(id_col), F.col(id_col)]
    chosen = known.filter("_y = 0").orderBy(*order).limit(sample).unionByName(known.filter("_y = 1").orderBy(*order).limit(sample))
    found = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("_t")).join(chosen, id_col)
    rows = found.select("_t", "_y", F.xxhash64(id_col).alias("_h"), F.col(id_col).alias("_i"))
    weights, bias = _fitted(rows, sample)
    shared = spark.sparkContext.broadcast(weights)  # BUCKETS numbers, whatever the input
    out = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("t"), *carried)
    fields = [out.schema["id"], *StructType.fromDDL("held_out boolean, score double, predicted int"), *out.schema.fields[3:]]
    return map_arrow(out, _scorer(shared, bias), StructType(fields))
