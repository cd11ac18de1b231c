"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

A document's set is its distinct word shingles (64-bit hashes of them). One permutation hash splits the hash range into
BANDS * ROWS bins; a bin's value is its smallest member, an empty bin borrows from a bin drawn by a 2-universal sequence
that depends on nothing but the empty bin's number. Each band of ROWS bins is one bucket key.

Equal sets first become one class, so copies cost one row in all later steps. Buckets of several classes propose a star:
edges from a centre (the smallest id) to the others, linear in the bucket's size. Proposed edges are confirmed on the full sets. As a
star misses links between two of its leaves, further rounds take new centres, up to CENTRES a bucket, in buckets whose
members are not yet in one component, until no bucket is left: every pair that shares a bucket is either confirmed,
refuted or inside one component. Centres come from outside a bucket's largest component, since each open pair has an end
there. Set sizes and parity sketches refute most pairs without their texts: a sketch holds the parity of each of CELLS
cells' member counts, so two sketches never differ in more cells than the sets differ in members. Components come from min-label propagation with pointer jumping; every round is written to the shared
folder, which cuts lineage and survives lost executors.

At similarity 0.85 a pair shares no bucket with probability (1 - 0.85^6)^28 < 2e-6.

Defined results: lower case means A-Z only; null, empty and blank texts have the empty set, are linked with nothing and
kept; with fewer words than a shingle the whole sequence is the one shingle; each row is returned, repeated ones alike; where rows share an
id but not a text, the set with the smallest digest stands for the id in comparisons and all of them go with it; a row without an id goes with
the rows of its text, and is kept if none of them has an id; a very long text is one set in one task; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import Scratch, bounded_batches, checked_broadcast, gathered, own_worker, word_hashes

SHINGLE, BANDS, ROWS = 5, 28, 6
BINS = BANDS * ROWS
#: Similarity in hundredths from which documents are linked.
LINKED = 85
#: Centres that a bucket may take in the second round; each round after it may take GROWTH times as many, so rounds are few.
CENTRES, GROWTH = 64, 8
#: Members of a bucket that are compared with its centres in one place.
PART = 256
#: Cells of a parity sketch, and the longs that hold them.
CELLS = 512
LONGS = CELLS // 64
#: Bytes of texts whose words are told apart together.
GATHERED = 4 << 20
#: Ids up to which the set of documents with candidate edges is broadcast (8 bytes each).
MOST_IDS = 1_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(6364136223846793005)
_PROBES = 48


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_EDGES = np.array([(b << 64) // BINS for b in range(BINS)], np.uint64)
_DRAWS = (_mixed(np.arange(BINS, dtype=np.uint64)[:, None] * _M + np.arange(1, _PROBES + 1, dtype=np.uint64)[None, :] * _STEP) % np.uint64(BINS)).astype(np.int64)
_BAND = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _M)


def shingle_sets(texts: pa.Array | list[bytes | None], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, counts = word_hashes(pa.array(texts, pa.binary()) if isinstance(texts, list) else texts)
    total = len(h)
    n = max(0, total - k + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(k):
        rolled = rolled * _STEP + h[i : i + n]
    rolled = _mixed(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            # Sorting and dropping repeats by hand: numpy's unique() does the same with more passes.
            s = np.sort(rolled[at : at + c - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s if keep.all() else s[keep])
        elif c:
            short = np.uint64(c)
            for x in h[at : at + c]:
                short = np.uint64((int(short) * int(_STEP) + int(x)) & (2**64 - 1))
            out.append(_mixed(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def bucket_keys(s: np.ndarray) -> np.ndarray:
    """One bucket key a band of a non-empty sorted set."""
    at = np.searchsorted(s, _EDGES)
    ends = np.append(at[1:], len(s))
    full = at < ends
    values = s[np.minimum(at, len(s) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        hit = full[_DRAWS[empty]]
        donor = _DRAWS[empty, hit.argmax(1)]
        lost = np.flatnonzero(~hit.any(1))
        if len(lost):  # very few members: the next full bin in the circle
            filled = np.flatnonzero(full)
            donor[lost] = filled[np.searchsorted(filled, empty[lost]) % len(filled)]
        values[empty] = values[donor]
    keys = _BAND.copy()
    for row in values.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _STEP + row)
    return keys.view(np.int64)


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """The parities of the cells' member counts, as longs."""
    odd = np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SIGNATURES = "doc_id long, n_shingles long, digest binary, keys array<long>, sketch array<long>"


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("minhash")
        for batch in gathered(batches, GATHERED):
            sets = shingle_sets(batch.column(1))
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            keys = [bucket_keys(s) if len(s) else None for s in sets]
            sketches = [parity_sketch(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "keys", "sketch"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, SIGNATURES)


def linked(a: np.ndarray, b: np.ndarray, hundredths: int = LINKED) -> bool:
    if min(len(a), len(b)) * 100 < hundredths * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= hundredths * (len(a) + len(b) - common)


def confirm(pairs: DataFrame, texts: DataFrame, hundredths: int = LINKED) -> DataFrame:
    """(a, b, linked) for pairs (a, b), on the full sets; texts has (doc_id, text) once an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("minhash")
        last, left = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts_a = batch.column(2)
            sets, verdicts = shingle_sets(batch.column(3)), []
            for i, x in enumerate(a):
                if x != last:
                    last, left = x, shingle_sets(texts_a.slice(i, 1))[0]
                verdicts.append(linked(left, sets[i], hundredths))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(verdicts)], names=["a", "b", "linked"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.hint("merge").join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")


def components(scratch: Scratch, edges: DataFrame, tag: str) -> DataFrame:
    """(doc, comp) for every end of an edge (a, b): comp is the smallest id reachable.

    Hash-to-min with pointer jumping: each round every node takes the least label among its own, its neighbours' and its
    label's label. Rows are bounded by ends plus edges in every round.
    """
    both = scratch.keep(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), f"{tag}-ends")
    labels = scratch.keep(both.groupBy(F.col("x").alias("doc")).agg(F.min(F.least("x", "y")).alias("comp")), f"{tag}-labels-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.select(F.col("doc").alias("y"), F.col("comp")), "y").groupBy(F.col("x").alias("doc")).agg(F.min("comp").alias("near"))
        jump = labels.select(F.col("doc").alias("comp"), F.col("comp").alias("far"))
        new = labels.join(near, "doc").join(jump, "comp", "left")
        new = new.select("doc", F.col("comp").alias("was"), F.least("comp", "near", F.coalesce("far", "comp")).alias("comp"))
        new = scratch.keep(new, f"{tag}-labels-{k}")
        done = new.where("was <> comp").isEmpty()
        labels = new.select("doc", "comp")
        scratch.drop(f"{tag}-labels-{k - 1}")
        if done:
            scratch.drop(f"{tag}-ends")
            return labels


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hundredths: int = LINKED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    bounded_batches(spark)
    scratch = Scratch(spark, "minhash")
    sig = scratch.keep(signatures(docs, id_col, text_col), "signatures")
    full = sig.where("n_shingles > 0")
    classes = scratch.keep(full.groupBy("digest").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "classes")
    # Where rows of one id have different sets, one set stands for the id: that of the smallest digest.
    several_sets = scratch.keep(full.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first <> last").select("doc_id", "first"), "several-sets")
    n_several = several_sets.count()
    if n_several:
        full = full.join(several_sets, "doc_id", "left").where("first is null or first = digest").drop("first")
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), F.col("digest").alias("rep_digest")), "doc_id")
    rows = reps.where("digest = rep_digest").select(F.explode(F.array_distinct("keys")).alias("bucket"), F.col("doc_id").alias("doc"), F.col("n_shingles").alias("size")).distinct()
    # Buckets of one class go: counted before the shuffle, so hot buckets are one row a task.
    several = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("doc", "size")).alias("c")).where("n > 1").select("bucket", F.col("c.doc").alias("centre"), F.col("c.size").alias("centre_size"))
    members = scratch.keep(rows.join(several, "bucket"), "members")
    pairs = members.where("doc <> centre").where(_sizes_allow("size", "centre_size", hundredths)).select(F.col("centre").alias("a"), F.col("doc").alias("b")).distinct()
    pairs = scratch.keep(pairs, "pairs-0")
    ids = scratch.keep(members.select(F.col("doc").alias("doc_id")).distinct(), "ids")
    n_ids = ids.count()
    component = None
    if n_ids:
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        texts = source.join(checked_broadcast(ids, n_ids, MOST_IDS), "doc_id", "left_semi")
        if n_several:
            texts = _with_first_set(texts, several_sets)
        texts = scratch.keep(texts.dropDuplicates(["doc_id"]), "texts")
        sketches = full.select(F.col("doc_id").alias("doc"), "sketch").join(checked_broadcast(ids.withColumnRenamed("doc_id", "doc"), n_ids, MOST_IDS), "doc", "left_semi").dropDuplicates(["doc"])
        component = _link(scratch, members, pairs, texts, scratch.keep(sketches, "sketches"), hundredths)
        scratch.drop("texts", "sketches", "members", "pairs-0", "ids")
    out = sig.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    if component is not None:
        out = out.join(component.withColumnRenamed("doc", "rep"), "rep", "left")
    else:
        out = out.withColumn("comp", F.lit(None).cast("long"))
    own = F.coalesce("comp", "rep", "doc_id")
    # A row without an id is kept if no row with one has its text.
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"))


def _with_first_set(texts: DataFrame, several_sets: DataFrame) -> DataFrame:
    """Of texts that share an id those whose set stands for it; few ids, whose digests are worked out again."""
    both = texts.join(several_sets, "doc_id", "left")
    again = both.where("first is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("minhash")
        for batch in batches:
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in shingle_sets(batch.column(1))]
            keep = pa.array([d == f for d, f in zip(digests, batch.column(2).to_pylist(), strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    return both.where("first is null").select("doc_id", "text").unionByName(again.select("doc_id", "text", "first").mapInArrow(run, "doc_id long, text string"))


def _sizes_allow(a: str, b: str, hundredths: int):
    """Whether two set sizes leave room for a link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * hundredths


def _sketches_allow(a: str, b: str, sum_of_sizes, hundredths: int):
    """Whether two parity sketches leave room for a link: the cells they differ in bound the sets' difference from below."""
    differ = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(LONGS)), F.lit(0))
    return differ * (100 + hundredths) <= sum_of_sizes * (100 - hundredths)


def _merged(scratch: Scratch, labels: DataFrame | None, links: DataFrame, tag: str) -> DataFrame:
    """labels (doc, comp) with new links (a, b) taken in: components of the labels that the links join, not of all edges again."""
    if labels is None:
        return components(scratch, links, tag)
    a, b = (labels.select(F.col("doc").alias(x), F.col("comp").alias(f"c{x}")) for x in ("a", "b"))
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(scratch, scratch.keep(ends.where("a <> b").distinct(), f"{tag}-joined"), tag).select(F.col("doc").alias("comp"), F.col("comp").alias("into"))
    fresh = links.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(labels, "doc", "left_anti").select("doc", F.col("doc").alias("comp"))
    both = labels.select("doc", "comp").unionByName(fresh).join(joined, "comp", "left")
    return scratch.keep(both.select("doc", F.coalesce("into", "comp").alias("comp")), f"{tag}-merged")


def _link(scratch: Scratch, members: DataFrame, pairs: DataFrame, texts: DataFrame, sketches: DataFrame, hundredths: int) -> DataFrame | None:
    """Rounds of stars until every bucket's members are in one component or compared."""
    centres = members.select("bucket", F.col("centre").alias("doc")).distinct()
    members = members.select("bucket", "doc", "size")
    seen, labels, k = None, None, 0
    while True:
        verdicts = scratch.keep(confirm(pairs, texts, hundredths), f"verdicts-{k}")
        seen = verdicts if seen is None else seen.unionByName(verdicts)
        found = verdicts.where("linked").select("a", "b")
        if not found.isEmpty():
            labels = _merged(scratch, labels, found, f"round-{k}")
        k += 1
        at = members.join(labels, "doc", "left").withColumn("comp", F.coalesce("comp", "doc")) if labels is not None else members.withColumn("comp", F.col("doc"))
        at = at.join(centres, ["bucket", "doc"], "left_anti")
        by_comp = at.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        alive = by_comp.groupBy("bucket").agg(F.count("*").alias("comps"), F.sum("n").alias("rows"), F.max(F.struct("n", "comp")).alias("most"))
        # A bucket's members are dealt over as many parts as it has PART members; its centres go to each of them.
        alive = scratch.keep(alive.where("comps > 1").select("bucket", F.col("most.comp").alias("most"), F.ceil(F.col("rows") / PART).cast("int").alias("parts")), f"alive-{k}")
        at = scratch.keep(at.join(checked_broadcast(alive, alive.count(), MOST_IDS), "bucket").select("bucket", "doc", "size", "comp", "most", "parts", F.pmod(F.xxhash64("doc", F.lit("part")), "parts").cast("int").alias("part")), f"open-{k}")
        if at.isEmpty():
            return labels
        draws = CENTRES * GROWTH ** (k - 1)
        outside = at.where("comp <> most").groupBy("bucket", F.pmod(F.xxhash64("doc"), F.lit(draws)).alias("draw")).agg(F.min(F.struct("doc", "comp", "size", "parts")).alias("c"))
        new = scratch.keep(outside.select("bucket", F.col("c.doc").alias("centre"), F.col("c.comp").alias("centre_comp"), F.col("c.size").alias("centre_size"), F.col("c.parts").alias("parts")), f"centres-{k}")
        sketched = new.join(sketches.select(F.col("doc").alias("centre"), F.col("sketch").alias("centre_sketch")), "centre")
        sketched = sketched.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        # Refuted inside the join: what it emits is close to the links.
        edges = at.join(sketches, "doc").join(sketched, ["bucket", "part"]).where("doc <> centre and comp <> centre_comp").where(_sizes_allow("size", "centre_size", hundredths))
        edges = edges.where(_sketches_allow("sketch", "centre_sketch", F.col("size") + F.col("centre_size"), hundredths))
        edges = edges.select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct()
        pairs = scratch.keep(edges.join(seen, ["a", "b"], "left_anti"), f"pairs-{k}")
        centres = scratch.keep(centres.unionByName(new.select("bucket", F.col("centre").alias("doc"))), f"all-centres-{k}")
        members = at.select("bucket", "doc", "size")
