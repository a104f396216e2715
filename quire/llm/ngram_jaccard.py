"""N-gram Jaccard join by multiple-global-order filtering.

Two texts link when the Jaccard similarity of their sets of word shingles reaches a threshold. A set's prefix under a
global order is its first n - ceil(t n) + 1 shingles; two linked sets share a prefix shingle under *every* order. So a
pair is a candidate only if it shares a prefix shingle under each of several orders, and only candidates are verified, on
their whole sets. All orders put frequent shingles last (a count sketch of fixed size over all documents tells which) and
break ties by different hashes.

Groups of copies are never expanded into pairs:
  1. equal sets collapse to the row with the smallest id;
  2. the first shingle under each of several hash orders is a bucket; every member is verified against one hub of the bucket,
     which links most of a large group with a number of pairs that is linear in its size;
  3. prefix postings whose members all lie in one component need no further pair. In the others, what lies outside the
     bucket's largest component meets the rest of the bucket; those pairs pass the other orders' filters, then verification.
Step 3 looks at every pair that could still join two components, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.batches import map_arrow
from quire.llm.components import connected_components
from quire.llm.scratch import FEW, FEW_TASKS, Scratch
from quire.llm.wordhash import mix, shingle_hashes, slices, word_hashes

SKETCH_BITS = 20
SKETCH_BLOCK = 4096
HUB_ORDERS, HUBS = 8, 2
#: 64-bit words of the short parities that travel with postings, and of those that meet pairs; how many of its document's first tokens a posting remembers.
PARITY_WORDS, WIDE_WORDS, EARLIER = 8, 16, 8
#: The further global orders; the postings are under order 0.
ORDERS = (1, 2)
#: Bit maps tell early which rows a later join can drop; they have 16 cells a row, within these powers of 2. A full map only lets more through.
MAP_BITS = (17, 27)
#: Texts are worked on so many rows and about so many bytes at a time.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, 1, BATCH_ROWS, BATCH_BYTES)


def _salted(h: np.ndarray, order: int) -> np.ndarray:
    return mix(h ^ np.uint64((0x9E3779B97F4A7C15 * (order + 1)) & (2**64 - 1)))


def _prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _prefix(h: np.ndarray, order: int, weight: np.ndarray, num: int, den: int) -> np.ndarray:
    """The prefix of a set under one global order: by class of frequency, then by a hash of the order's own."""
    p = _prefix_length(len(h), num, den)
    rank = _salted(h, order) >> np.uint64(6) | weight[h >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(58)
    if p < len(h):
        kept = np.argpartition(rank, p - 1)[:p]
        h, rank = h[kept], rank[kept]
    return h[np.argsort(rank)]


def _short_parity(h: np.ndarray, words: int) -> list[int]:
    """For each of 64 cells a word, whether an odd number of shingles fall there, as signed words; the halves of a longer one xor to one half as long."""
    cells = np.bincount(_salted(h, 400) & np.uint64(64 * words - 1), minlength=64 * words) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64).tolist()


def _in_reach(na: str, nb: str, a: str, b: str, num: int, den: int, words: int = PARITY_WORDS) -> F.Column:
    """Whether sizes and short parities let two sets reach the threshold: no pair that does is lost."""
    word = lambda j: F.bit_count(F.get(a, F.lit(j)).bitwiseXOR(F.get(b, F.lit(j))))
    differing = sum((word(j) for j in range(1, words)), word(0))
    most = F.least(F.col(na), F.col(nb), F.floor((F.col(na) + F.col(nb) - differing) / 2))
    return den * most >= num * (F.col(na) + F.col(nb) - most)


def _profile(k: int):
    """A row per document (kind 0) and the task's share of the count sketch (kind 1).

    A document's row has a fingerprint of its set, the hash of its first shingle under each hub order, and its short parity.
    """
    names = ["kind", "id", "n", "f1", "f2", "first", "parity", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in parts(batches):
            sets = shingle_hashes(*word_hashes(batch.column(1)), k)
            if sets:
                sketch += np.bincount(np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), minlength=1 << SKETCH_BITS)
            one = [int(np.bitwise_xor.reduce(mix(h))) if len(h) else 0 for h in sets]
            two = [int(np.add.reduce(_salted(h, 77))) if len(h) else 0 for h in sets]
            orders = np.arange(HUB_ORDERS, dtype=np.uint64)
            first = [mix(np.array([_salted(h, 100 + j).min() for j in range(HUB_ORDERS)]) + orders).astype(np.int64).tolist() if len(h) else None for h in sets]
            signed = lambda xs: pa.array(np.array(xs, np.uint64).astype(np.int64))
            size = len(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(size, np.int32)), batch.column(0), pa.array([len(h) for h in sets], pa.int64()), signed(one), signed(two), pa.array(first, pa.list_(pa.int64())), pa.array([_short_parity(h, WIDE_WORDS) for h in sets], pa.list_(pa.int64())), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())],
                names=names,
            )
        if sketch.any():
            blocks = sketch.reshape(-1, SKETCH_BLOCK)
            b = len(blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(b, np.int32)), pa.nulls(b, pa.int64()), pa.nulls(b, pa.int64()), pa.nulls(b, pa.int64()), pa.nulls(b, pa.int64()), pa.nulls(b, pa.list_(pa.int64())), pa.nulls(b, pa.list_(pa.int64())), pa.array(np.arange(b, dtype=np.int32)), pa.array([x.astype(np.int32).tobytes() for x in blocks], pa.binary())],
                names=names,
            )

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the sketch blocks of a partition, so that one row a block and partition goes on."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            kind = np.int32 if len(x) == 4 * SKETCH_BLOCK else np.int64
            total[k] = total.get(k, 0) + np.frombuffer(x, kind).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def _cells(values: np.ndarray, bits: int) -> np.ndarray:
    return mix(values.astype(np.int64).view(np.uint64) + np.uint64(1)) >> np.uint64(64 - bits)


def _may_hold(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = _cells(values, len(bits).bit_length() + 2)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _marked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << size, bool)
        for batch in batches:
            bits[_cells(np.asarray(batch.column(0)), size)] = True
        blocks = np.packbits(bits, bitorder="little").reshape(-1, SKETCH_BLOCK)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([blocks[i].tobytes() for i in used], pa.binary())], names=["block", "bits"])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[k] = total.get(k, 0) | np.frombuffer(x, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "bits"])


def _bit_map(values: DataFrame, count: int) -> np.ndarray:
    """A bit for each cell that one of the longs falls into: at most 2 ** 27 bits, whatever the input."""
    schema = "block int, bits binary"
    size = min(MAP_BITS[1], max(MAP_BITS[0], (16 * count).bit_length()))
    out = np.zeros((1 << size) // 8, np.uint8)
    marked = map_arrow(values, _marked(size), schema)
    if count > FEW:
        marked = map_arrow(marked.repartition(16, "block"), _united, schema)
    for r in marked.toLocalIterator():
        out[r.block * SKETCH_BLOCK : (r.block + 1) * SKETCH_BLOCK] |= np.frombuffer(r.bits, np.uint8)
    return out


def _hits(bits):
    """A row for each prefix token that may join two components, with the number of the set's shingles from it on, in order, and the
    document's first few such tokens as far as they stand before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                lists = batch.column(4)
                values, at = np.asarray(lists.values), np.asarray(lists.offsets)
                owner = np.repeat(np.arange(len(lists)), np.diff(at))
                values = values[at[0] : at[-1]]
                rest = np.asarray(batch.column(1))[owner] - (np.arange(len(owner)) - (at[:-1] - at[0])[owner])
                hit = _may_hold(bits.value, values)
                owner, values, rest = owner[hit], values[hit], rest[hit]
                first = np.searchsorted(owner, np.arange(len(lists) + 1))
                n = np.minimum(np.arange(len(owner)) - first[owner], EARLIER)
                begin = np.concatenate([[0], np.cumsum(n)])
                source = np.repeat(first[owner] - begin[:-1], n) + np.arange(int(begin[-1]))
                earlier = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values[source]))
                owner = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*[batch.column(j).take(owner) for j in range(4)], pa.array(values), pa.array(rest.astype(np.int32)), earlier], names=["id", "n", "comp", "parity", "token", "rest", "earlier"])

    return run


def _weights(sketch: DataFrame) -> np.ndarray:
    """A class of frequency for each cell: how often the mean is doubled. 2 ** SKETCH_BITS bytes, whatever the input."""
    schema = "block int, counts binary"
    summed = map_arrow(map_arrow(sketch, _sum_blocks, schema).repartition(16, "block"), _sum_blocks, schema)
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in summed.toLocalIterator():  # 2 ** SKETCH_BITS counts in all
        out[r.block * SKETCH_BLOCK : (r.block + 1) * SKETCH_BLOCK] += np.frombuffer(r.counts, np.int64)
    high = np.log2(np.maximum(1, out / max(1.0, out.mean())))
    return np.minimum(63, np.floor(2 * high)).astype(np.uint8)


def _chosen(batch: pa.RecordBatch, ids: np.ndarray | None) -> pa.RecordBatch:
    """The rows whose id may be among those in a bit map."""
    return batch if ids is None else batch.filter(pa.array(_may_hold(ids, np.asarray(batch.column(0)))))


def _postings(k: int, num: int, den: int, weight):
    """(id, n, parity, p0): the prefix of each set under the first order, and its short parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = shingle_hashes(*word_hashes(batch.column(1)), k)
            got = [_prefix(h, 0, weight.value, num, den) if len(h) else h for h in sets]
            at = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            values = (np.concatenate(got) if got else np.zeros(0, np.uint64)).astype(np.int64)
            parity = pa.array([_short_parity(h, PARITY_WORDS) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in sets], pa.int64()), parity, pa.ListArray.from_arrays(pa.array(at), pa.array(values))], names=["id", "n", "parity", "p0"])

    return run


def _parity(h: np.ndarray) -> bytes:
    """For each of about 4 n cells, whether an odd number of the set's shingles fall there."""
    size = max(64, 1 << (4 * len(h) - 1).bit_length())
    return np.packbits(np.bincount(_salted(h, 300) & np.uint64(size - 1), minlength=size).astype(np.uint8) & 1).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """A lower bound of how many shingles two sets don't share: the cells in which their parities differ."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):  # the lower half of a cell number's range, and the upper, fall together
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _filters(k: int, num: int, den: int, weight, ids):
    """(id, n, f1, f2, ..., parity): prefixes under the further orders, cut to 32 bits, and the parities. Cut hashes can only let more pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            batch = _chosen(batch, ids.value)
            sets = shingle_hashes(*word_hashes(batch.column(1)), k)
            arrays, names = [batch.column(0), pa.array([len(h) for h in sets], pa.int64())], ["id", "n"]
            for j in ORDERS:
                arrays.append(pa.array([np.unique(_prefix(h, j, weight.value, num, den).astype(np.uint32)).tobytes() if len(h) else b"" for h in sets], pa.binary()))
                names.append(f"f{j}")
            arrays.append(pa.array([_parity(h) if len(h) else b"" for h in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "parity"])

    return run


def _sets(k: int, ids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            batch = _chosen(batch, ids.value)
            sets = shingle_hashes(*word_hashes(batch.column(1)), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in sets], pa.binary())], names=["id", "tokens"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _passes(num: int, den: int):
    """Pairs that share a prefix token under every further order and whose parities leave the threshold in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            apart = np.array([_apart(x, y) for x, y in zip(cols["xparity"], cols["yparity"], strict=True)], np.int64)
            total = np.array(cols["xn"], np.int64) + np.array(cols["yn"], np.int64)
            most = (total - apart) // 2
            ok = den * most >= num * (total - most)
            for j in ORDERS:
                for i in np.flatnonzero(ok).tolist():
                    ok[i] = _common(np.frombuffer(cols[f"x{j}"][i], np.uint32), np.frombuffer(cols[f"y{j}"][i], np.uint32)) > 0
            out = [batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "ca", "cb")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(apart)], names=["a", "b", "ca", "cb", "apart"]).filter(pa.array(ok))

    return run


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = _common(a, b)
                ok.append(den * both >= num * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v")))


def _few(df: DataFrame, count: int) -> DataFrame:
    """A small table in a few tasks, so that its joins are cheap."""
    return df.coalesce(FEW_TASKS) if count <= FEW else df


def _between(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The links as edges between the components of their ends."""
    return pairs.join(links, ["a", "b"], "left_semi").select(F.col("ca").alias("a"), F.col("cb").alias("b"))


class _Join:
    """What the steps of one join share."""

    def __init__(self, texts: DataFrame, k: int, num: int, den: int, weight, scratch: Scratch):
        self.texts, self.k, self.num, self.den, self.weight, self.scratch = texts, k, num, den, weight, scratch
        self.spark = texts.sparkSession

    def chosen(self, pairs: DataFrame, count: int):
        return self.spark.sparkContext.broadcast(_bit_map(_ends(pairs), 2 * count))

    def filtered(self, pairs: DataFrame, count: int) -> DataFrame:
        """(a, b, ca, cb, apart): the pairs that pass all filters."""
        kinds = ", ".join(f"f{j} binary" for j in ORDERS)
        records = map_arrow(self.texts, _filters(self.k, self.num, self.den, self.weight, self.chosen(pairs, count)), f"id long, n long, {kinds}, parity binary")
        side = lambda end, s: records.select(F.col("id").alias(end), F.col("n").alias(f"{s}n"), *[F.col(f"f{j}").alias(f"{s}{j}") for j in ORDERS], F.col("parity").alias(f"{s}parity"))
        return map_arrow(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b"), _passes(self.num, self.den), "a long, b long, ca long, cb long, apart long")

    def verified(self, pairs: DataFrame, count: int) -> DataFrame:
        """(a, b): the pairs that reach the threshold, on their whole sets."""
        sets = map_arrow(self.texts, _sets(self.k, self.chosen(pairs, count)), "id long, tokens binary")
        x, y = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
        return map_arrow(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y"), _verified(self.num, self.den), "a long, b long")


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of every row: links are pairs with Jaccard similarity >= num / den.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a set holds the distinct k-word shingles, or the whole sequence
    where a text has fewer words. A null or blank text has an empty set (n_shingles 0) and links with nothing: its
    component is its own id. Rows that share an id are one node, with the links of each of its texts. A row with a null id
    links with nothing and has a null component. Other columns are ignored. Empty tables give empty results.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard", docs)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = "kind int, id long, n long, f1 long, f2 long, first array<long>, parity array<long>, block int, counts binary"
    profile = scratch.save(map_arrow(texts, _profile(k), schema), "profile")
    rows = profile.filter("kind = 0")
    weight = spark.sparkContext.broadcast(_weights(profile.filter("kind = 1").select("block", "counts")))
    texts = texts.filter("id is not null")
    full = rows.filter("n > 0 and id is not null")

    # 1. Equal sets: the smallest id stands for all.
    rep = full.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    classes = scratch.save(full.select("id", "n", "f1", "f2").join(rep, ["n", "f1", "f2"]).select("id", "rep"), "classes")
    copies = classes.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    reps = classes.filter("id = rep").select("id").distinct()

    # 2. Hubs: a few buckets a document, one pair a member.
    join = _Join(texts, k, num, den, weight, scratch)
    bucket = full.select("id", F.explode("first").alias("token")).join(reps, "id", "left_semi")
    held = bucket.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1")
    member = bucket.join(held, "token")
    # A document in many well-filled buckets has little of its own: a good hub.
    central = member.groupBy("id").agg(F.sum(F.log("c")).alias("central"), F.collect_list("token").alias("tokens"))
    half = F.zip_with(F.slice("parity", 1, PARITY_WORDS), F.slice("parity", PARITY_WORDS + 1, PARITY_WORDS), lambda x, y: x.bitwiseXOR(y))
    shared = scratch.save(central.join(full.select("id", "n", half.alias("parity")), "id").select("id", "n", "parity", "central", F.explode("tokens").alias("token")), "shared")
    order = W.partitionBy("token").orderBy(F.desc("central"), F.xxhash64("id"), "id")
    hubs = shared.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= HUBS)
    hubs = hubs.select("token", F.col("id").alias("hub"), F.col("n").alias("nh"), F.col("parity").alias("hparity"))
    near = shared.join(hubs, "token").filter((F.col("id") != F.col("hub")) & _in_reach("n", "nh", "parity", "hparity", num, den))
    pairs = near.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct().select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
    pairs, count = scratch.counted(pairs, "hubs")
    passed, count = scratch.counted(join.filtered(pairs, count), "hub_passed", count)
    component = connected_components(join.verified(passed, count).unionByName(copies), scratch, "cc1_")

    # 3. All that could still join two components.
    labels = reps.join(component, "id", "left").select("id", F.coalesce("component", "id").alias("comp"))
    one = map_arrow(texts, _postings(k, num, den, weight), "id long, n long, parity array<long>, p0 array<long>").filter("n > 0")
    prefixes = scratch.save(one.join(labels, "id").select("id", "n", "comp", "parity", "p0"), "prefixes")
    tokens = prefixes.select("comp", F.explode("p0").alias("token"))
    mixed = tokens.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    mixed, count = scratch.counted(mixed, "mixed")
    bits = spark.sparkContext.broadcast(_bit_map(mixed, count))
    postings = map_arrow(prefixes, _hits(bits), "id long, n long, comp long, parity array<long>, token long, rest int, earlier array<long>").withColumn("n", F.col("n").cast("int"))
    live = scratch.save(postings, "live")
    scratch.drop("prefixes", "mixed")
    # What the bit map let through beside the mixed tokens has one component and goes here.
    counts = live.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token")
    largest = counts.agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1").drop("comps")
    live = live.join(largest, "token")
    left = live.filter("comp <> top").select("token", F.col("id").alias("i"), F.col("n").alias("ni"), F.col("comp").alias("ci"), F.col("parity").alias("pi"), F.col("rest").alias("ri"), F.col("earlier").alias("ei"))
    right = live.select("token", F.col("id").alias("j"), F.col("n").alias("nj"), F.col("comp").alias("cj"), F.col("parity").alias("pj"), F.col("rest").alias("rj"), F.col("earlier").alias("ej"), (F.col("comp") == F.col("top")).alias("dominant"))
    # A pair that shares several tokens is made at the first of them, as far as the postings remember.
    # At the first that they share, all else they share comes later in both orders; what then is left must reach the threshold.
    enough = F.least("ri", "rj").cast("long") * (num + den) >= (F.col("ni").cast("long") + F.col("nj")) * num
    fits = (F.col("ci") != F.col("cj")) & enough & ~F.arrays_overlap("ei", "ej") & (F.col("dominant") | (F.col("i") < F.col("j"))) & _in_reach("ni", "nj", "pi", "pj", num, den)
    found = left.join(right, (left["token"] == right["token"]) & fits)
    swap = F.col("i") > F.col("j")
    end = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    found = found.select(end("i", "j").alias("a"), end("j", "i").alias("b"), end("ci", "cj").alias("ca"), end("cj", "ci").alias("cb"))
    wide = full.select("id", "n", "parity")
    side = lambda end, s: wide.select(F.col("id").alias(end), F.col("n").alias(f"n{s}"), F.col("parity").alias(f"p{s}"))
    near = found.distinct().join(side("a", "x"), "a").join(side("b", "y"), "b").filter(_in_reach("nx", "ny", "px", "py", num, den, WIDE_WORDS))
    pairs, count = scratch.counted(near.select("a", "b", "ca", "cb"), "pairs")
    passed, count = scratch.counted(join.filtered(pairs, count), "passed", count)
    scratch.drop("live", "shared", "hubs", "hub_passed", "pairs")
    # Components are merged by links between them, in a graph whose nodes are the components so far. Of the pairs that would join
    # the same two the closest goes first; what it joins, the others need not.
    closest = F.min_by(F.struct("a", "b", "ca", "cb"), F.struct("apart", "a", "b")).alias("p")
    best, n_best = scratch.counted(_few(passed, count).groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(closest).select("p.*"), "best", count)
    joined = scratch.save(join.verified(best, n_best), "joined", n_best)
    merged = connected_components(_between(best, joined), scratch, "cc2_")
    now = _few(merged, n_best).select(F.col("id").alias("v"), "component")
    rest = _few(passed, count).join(now.withColumnsRenamed({"v": "ca", "component": "xa"}), "ca", "left").join(now.withColumnsRenamed({"v": "cb", "component": "xb"}), "cb", "left")
    rest = rest.filter(F.coalesce("xa", "ca") != F.coalesce("xb", "cb")).join(_few(best, n_best), ["a", "b"], "left_anti").select("a", "b", "ca", "cb")
    rest, count = scratch.counted(rest, "rest", count)
    if count:
        more = scratch.save(join.verified(rest, count), "more", count)
        merged = connected_components(_between(best, joined).unionByName(_between(rest, more)), scratch, "cc3_")
    final = component.join(merged.select(F.col("id").alias("component"), F.col("component").alias("m")), "component", "left").select("id", F.coalesce("m", "component").alias("component"))
    # A component of one document has no row of its own so far.
    final = final.unionByName(merged.join(component, "id", "left_anti"))
    scratch.drop("passed", "best", "rest", "joined", "more")
    out = rows.select("id", F.col("n").alias("n_shingles")).join(final, "id", "left")
    return scratch.bounded(out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id")))
