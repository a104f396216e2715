"""Language identification by rank-order profiles.

A profile is the list of the most frequent n-grams of a language in order of frequency. A document is given the language
whose profile is nearest to its own list by out-of-place distance: the sum, over the document's n-grams, of how far apart the
two ranks are, PROFILE for one that the language's list lacks.

N-grams are of one to four bytes of UTF-8 with A-Z lower-cased; ASCII bytes that are no letters part words, and an n-gram
may begin or end with one blank for that but never spans two words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.batches import map_arrow
from quire.llm.wordhash import buffers, slices

PROFILE = 400
#: Profiles are fitted on at most this many documents a language, those with the smallest hash of their id.
SAMPLE_PER_LANGUAGE = 600
#: Up to so many languages the sample's ids are broadcast.
MOST_LANGUAGES = 500
BATCH_ROWS = 1024
UNKNOWN = "und"

_MAP = np.full(256, 32, np.uint8)
_MAP[65:91] = np.arange(97, 123)
_MAP[97:123] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)
_BITS = 35


def gram_counts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of one text, as numbers with n in the upper bits, and how often each occurs."""
    x = _MAP[raw]
    blank = x == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    x = np.concatenate([[32], x[keep], [32]]).astype(np.uint32)
    blank = x == 32
    if blank[0] and len(x) > 1 and blank[1]:
        x, blank = x[1:], blank[1:]
    codes, counts = [], []
    run, inside = x, np.ones(len(x), bool)
    for n in range(1, 5):
        if n > 1:
            run = run[:-1] << np.uint32(8) | x[n - 1 :]
            if n > 2:
                inside = inside[:-1] & ~blank[n - 2 : len(x) - 1]
            else:
                inside = inside[:-1]
        if not len(run):
            break
        valid = np.sort(run[inside] if n > 2 else run[~blank] if n == 1 else run)
        if not len(valid):
            continue
        at = np.flatnonzero(np.concatenate([[True], valid[1:] != valid[:-1]]))
        codes.append(valid[at].astype(np.uint64) | np.uint64(n) << np.uint64(32))
        counts.append(np.diff(np.append(at, len(valid))).astype(np.uint64))
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(codes), np.concatenate(counts)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order; ties go to the smaller number."""
    top = np.uint64((1 << _BITS) - 1)
    key = counts << np.uint64(_BITS) | (top - codes)
    if len(key) > most:
        key = np.partition(key, len(key) - most)[len(key) - most :]
    return top - (np.sort(key)[::-1] & top)


def _has_letter(raw: np.ndarray) -> bool:
    mapped = _MAP[raw]
    if ((mapped >= 97) & (mapped < 123)).any():
        return True
    return bool((mapped >= 128).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "ignore"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): one row a language and n-gram of a batch."""
    for batch in (part for whole in batches for part in slices(whole, 1, BATCH_ROWS)):
        raw, at = buffers(batch.column(1))
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            got = [gram_counts(raw[at[i] : at[i + 1]]) for i, x in enumerate(langs) if x == lang]
            codes, where = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            total = np.bincount(where, weights=np.concatenate([g[1] for g in got]).astype(float), minlength=len(codes))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(total.astype(np.int64))], names=["lang", "gram", "n"])


def fit_profiles(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held_out: F.Column, most: int = PROFILE, sample: int = SAMPLE_PER_LANGUAGE) -> dict[str, list[int]]:
    """The ranked n-grams of each language; most x languages numbers reach the driver."""
    known = docs.filter(~held_out & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    # The smallest hashes are looked for among about four times as many rows as are wanted; a language without so many has all its rows looked at.
    sizes = known.groupBy(F.col(lang_col).alias("__lang")).agg(F.count("*").alias("__n"))
    n_languages = sizes.count()
    small = F.broadcast(sizes) if n_languages <= MOST_LANGUAGES else sizes
    near = known.select(id_col, lang_col).join(small, F.col(lang_col) == F.col("__lang"))
    near = near.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30) <= F.lit(4.0 * sample) / F.col("__n"))
    order = W.partitionBy(lang_col).orderBy(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)), F.xxhash64(id_col), id_col)
    chosen = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample).select(id_col).distinct()
    # At most sample ids a language go to all tasks, so no text is shuffled.
    texts = known.join(F.broadcast(chosen) if n_languages <= MOST_LANGUAGES else chosen, id_col, "left_semi").select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    counts = map_arrow(texts, _counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for r in sorted(counts.withColumn("r", rank).filter(F.col("r") <= most).collect(), key=lambda r: (r.lang, r.r)):
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


def _predictor(profiles: dict[str, list[int]], most: int):
    names = sorted(profiles)
    union = np.unique(np.concatenate([np.array(profiles[x], np.uint64) for x in names])) if names else np.zeros(0, np.uint64)
    ranks = np.full((len(union) + 1, max(1, len(names))), most, np.int32)
    for j, x in enumerate(names):
        ranks[np.searchsorted(union, np.array(profiles[x], np.uint64)), j] = np.arange(len(profiles[x]))

    def one(raw: np.ndarray) -> tuple[str, float]:
        if not names or not _has_letter(raw):
            return UNKNOWN, 0.0
        grams = ranked(*gram_counts(raw), most)
        at = np.searchsorted(union, grams)
        at[at == len(union)] = 0
        at[union[at] != grams] = len(union)
        theirs = ranks[at]
        apart = np.where(theirs == most, most, np.abs(theirs - np.arange(len(grams), dtype=np.int32)[:, None])).sum(0)
        best = int(np.argmin(apart))
        return names[best], float(1.0 - apart[best] / (most * max(1, len(grams))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, BATCH_ROWS)):
            raw, at = buffers(batch.column(2))
            got = [one(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = PROFILE, sample: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(id_col, held_out, lang_pred, score) of every row.

    Rows whose crc32 of the id as text leaves 0 when divided by 5 are held out: nothing is learned from them. A prediction
    depends on the text alone. score is 1 less the distance over the largest possible distance. A null text, or one without a
    letter, is `und` with score 0, as is every row if nothing could be learned. Ties between languages go to the first by code
    point. A row with a null id isn't held out and isn't learned from. Other columns are ignored.
    """
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    profiles = fit_profiles(docs, id_col, text_col, lang_col, held_out, most, sample)
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = map_arrow(rows, _predictor(profiles, most), f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
