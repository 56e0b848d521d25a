"""Near-duplicates by b-bit MinHash: banded candidates, estimates from packed low bits, exact confirmation.

A document's set is its distinct word shingles. Equal sets become one node at once, so groups of copies of any size cost no
more than one text. Every node gets 128 minima; four in a row make a band, and equal bands make candidates. At a
similarity of 0.8, 32 bands miss a pair with probability 5e-8. Of each minimum four bits are kept: 64 bytes a node, in
which a pair's agreement is counted with a few bit operations and corrected for chance collisions.

Within a bucket no pairs are listed. In a round, one leader of each bucket is compared with the members outside its component, and each
member confirms only the leader that it resembles most; confirmed links join components. Rounds are linear in the bucket rows
and collapse groups of near copies; the first leaders are the nodes with the most company, as an original has among its
copies. What is left are buckets of several components; there members of different components are compared inside
one join, whose condition is the estimate and then the full sets, so that only links come out of it. Hence no link is
lost but by the two stated error probabilities.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .graph import components
from .words import SMALL_CHUNK_BYTES, Words, text_chunks, unused, window_hashes

MINIMA, ROWS, BITS = 128, 4, 4
BANDS = MINIMA // ROWS
PARTS = MINIMA * BITS // 64
ROUNDS = 2
# The estimate's standard deviation at 0.8 is 0.037; five of them below, a link is kept out once in 3 million.
MARGIN = 0.18
SHINGLE, PERCENT = 5, 80

_RANDOM = np.random.default_rng(20240229)
_FACTOR = _RANDOM.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSET = _RANDOM.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
SIGNATURE = [f"s{i}" for i in range(PARTS)]


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased; fewer words than a shingle are one."""
    words = Words([t.lower() for t in texts])
    hashes = words.hashes()
    sets = []
    for begin, end in zip(words.first[:-1], words.first[1:]):
        own = hashes[begin:end]
        if len(own):
            found = np.sort(window_hashes(own, min(size, len(own))))
            sets.append(found[np.append(True, found[1:] != found[:-1])])
        else:
            sets.append(own)
    return sets


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the hash functions."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        values = _FACTOR[:, None] * low[None, at : at + 2048] + _OFFSET[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def packed_bits(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima in 64-bit words; the minima are the last axis."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(*least.shape[:-1], PARTS, -1)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=-1, dtype=np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A hash of each band's minima and its number, for one row of minima per set."""
    rows = least.astype(np.uint64).reshape(len(least), BANDS, ROWS)
    number = np.broadcast_to(np.arange(BANDS, dtype=np.uint64)[:, None], (len(least), BANDS, 1))
    return window_hashes(np.moveaxis(np.concatenate([rows, number], axis=-1), -1, 0), ROWS + 1)[0]


def sketches(documents: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, packed signature and band keys of each row (no node without words)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def sketch(batches):
        for rows, texts in text_chunks(batches, limit=SMALL_CHUNK_BYTES):
            sets = shingle_sets(texts, shingle)
            none = np.array([len(s) == 0 for s in sets], dtype=bool)
            least = np.stack([minima(s) for s in sets])
            keys, bits = band_keys(least).view(np.int64), packed_bits(least).view(np.int64)
            bands = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32(), mask=np.append(none, False)),
                pa.array(keys.ravel()),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                    bands,
                    *[pa.array(bits[:, i], mask=none) for i in range(PARTS)],
                ],
                names=["doc_id", "text_hash", "n_shingles", "node", "bands", *SIGNATURE],
            )

    parts = ", ".join(f"{s} long" for s in SIGNATURE)
    return documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        sketch, f"doc_id {kind}, text_hash long, n_shingles long, node long, bands array<long>, {parts}"
    )


def estimate(left: list[Column], right: list[Column]) -> Column:
    """Similarity from the packed bits: the share of equal minima, corrected for equal bits by chance."""
    ones = F.lit(int("1" * (64 // BITS), 1 << BITS))

    def unequal(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        either = reduce(lambda p, q: p.bitwiseOR(q), [F.shiftrightunsigned(x, k) for k in range(1, BITS)], x)
        return F.bit_count(either.bitwiseAND(ones))

    share = 1 - reduce(add, [unequal(a, b) for a, b in zip(left, right)]) / MINIMA
    chance = 2.0**-BITS
    return (share - chance) / (1 - chance)


def _likely(a: str, b: str, percent: int) -> Column:
    """Whether a pair's sizes and estimate allow a link."""
    sizes = F.least(f"{a}n", f"{b}n") * 100 >= F.greatest(f"{a}n", f"{b}n") * percent
    parts = [[F.col(f"{side}{s}") for s in SIGNATURE] for side in (a, b)]
    return sizes & (estimate(*parts) >= percent / 100 - MARGIN)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(both * 100 >= (F.size("x") + F.size("y") - both) * percent)
        .select("a", "b")
    )


def _candidate_sets(documents: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """The full sets of some nodes, from the whole text of the document that stands for each."""

    def cut(batches):
        for _, texts in text_chunks(batches, limit=SMALL_CHUNK_BYTES):
            sets = shingle_sets(texts, shingle)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([node_of(s) for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["node", "shingles"],
            )

    texts = documents.join(nodes.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    made = texts.mapInArrow(cut, "node long, shingles array<long>")
    # Ids may be given to several texts: only the nodes asked for, each once.
    return made.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def link_documents(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, n_copies, kept.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. component_id is the smallest doc_id reachable.
    Null and empty texts and texts without words have no shingles and are linked with nothing; so are rows with a null doc_id, which get a
    null component_id and are kept. Repeated rows each get their row. Only doc_id and text are read.
    n_copies is the number of rows with the same set.
    """
    source = documents.select("doc_id", "text")
    all_sketches = materialize(sketches(source, shingle), "sketches")
    found = all_sketches.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    nodes = found.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))
    nodes = materialize(nodes, "nodes")
    # One row of a set stands for it; equal rows of one id and set are the same.
    single = found.join(nodes.drop("n_copies"), ["node", "doc_id"], "left_semi").dropDuplicates(["node"])
    single = materialize(single.withColumnRenamed("n_shingles", "n"), "single")
    rows = single.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    met = materialize(rows.join(shared, "bucket").select("bucket", "node", "size"), "met")
    company = met.groupBy("node").agg(F.sum("size").alias("company"))
    members = (
        met.select("bucket", "node")
        .join(single.select("node", "n", *SIGNATURE).join(company, "node"), "node")
        .select("bucket", "node", "n", "company", *SIGNATURE)
    )
    members = materialize(members, "members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    sets = materialize(_candidate_sets(source, wanted, shingle), "sets")

    links, root = None, None
    for turn in range(ROUNDS + 1):
        if root is None:
            active = members.withColumn("root", F.col("node"))
        else:
            active = members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if turn < ROUNDS:
            fresh = _confirm(_star(active, turn, percent), sets, percent)
        else:
            fresh = _rest(active, sets, percent)
        fresh = materialize(fresh, "links")
        links = fresh if links is None else links.union(fresh)
        root = components(links)
    total = nodes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = total.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    placed = total.join(smallest, "root").select("node", "component_id", "n_copies")
    linked = found.select("doc_id", "text_hash", "n_shingles", "node").join(placed, "node").drop("node")
    alone = all_sketches.filter(F.col("node").isNull() | F.col("doc_id").isNull()).select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.col("doc_id").alias("component_id"),
        F.lit(1).cast("long").alias("n_copies"),
    )
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _star(active: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each node the likeliest of its buckets' leaders in other components: at most one pair a node."""
    names = ["node", "root", "n", *SIGNATURE]
    order = F.struct("company", "node") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)), "node")
    lead = (
        active.groupBy("bucket")
        .agg(
            F.max_by(F.struct(*names), order).alias("l"),
            F.min("root").alias("_first"),
            F.max("root").alias("_last"),
        )
        .filter("_first <> _last")
        .select("bucket", *[F.col(f"l.{c}").alias(f"l_{c}") for c in names])
    )
    mine = active.select("bucket", *[F.col(c).alias(f"m_{c}") for c in names])
    met = mine.join(lead, "bucket").filter((F.col("m_root") != F.col("l_root")) & _likely("m_", "l_", percent))
    alike = estimate([F.col(f"m_{s}") for s in SIGNATURE], [F.col(f"l_{s}") for s in SIGNATURE])
    best = met.groupBy("m_node").agg(F.max_by("l_node", F.struct(alike, "l_node")).alias("l_node"))
    return best.select(F.least("m_node", "l_node").alias("a"), F.greatest("m_node", "l_node").alias("b")).distinct()


def _rest(active: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links between different components that still share a bucket.

    First the rows that have a likely partner at all are kept. A pair meets in every bucket that it shares, often in many;
    the full sets are compared in one of them, and only the rows of such buckets get their sets.
    """
    names = ["node", "root", "n", *SIGNATURE]
    several = active.groupBy("bucket").agg(F.min("root").alias("_a"), F.max("root").alias("_b"))
    still = active.join(several.filter("_a <> _b").select("bucket"), "bucket", "left_semi")
    still = materialize(still.select("bucket", *names), "unsettled")

    def side(rows: DataFrame, prefix: str, *more: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("bucket", *names, *more)])

    likely = (
        (F.col("m_bucket") == F.col("l_bucket"))
        & (F.col("m_root") != F.col("l_root"))
        & _likely("m_", "l_", percent)
    )
    kept = side(still, "m_").join(side(still, "l_"), likely, "left_semi")
    kept = materialize(kept.select(*[F.col(f"m_{c}").alias(c) for c in ("bucket", *names)]), "partners")
    # A likely pair keeps its rows in all the buckets that it shares, so both see the same ones.
    buckets = kept.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))
    kept = kept.join(buckets, "node")
    here = likely & _meet_here("m_", "l_")
    kept = side(kept, "m_", "buckets").join(side(kept, "l_", "buckets"), here, "left_semi")
    kept = kept.select(*[F.col(f"m_{c}").alias(c) for c in ("bucket", *names, "buckets")])
    kept = materialize(kept.join(sets, "node"), "likely")
    both = F.size(F.array_intersect("m_shingles", "l_shingles"))
    linked = both * 100 >= (F.col("m_n") + F.col("l_n") - both) * percent
    pairs = side(kept, "m_", "buckets", "shingles").join(
        side(kept, "l_", "buckets", "shingles"),
        (F.col("m_node") < F.col("l_node")) & here & linked,
    )
    return pairs.select(F.col("m_node").alias("a"), F.col("l_node").alias("b")).distinct()


def _meet_here(a: str, b: str) -> Column:
    """Whether this is the one among a pair's common buckets in which its full sets are compared."""
    return F.col(f"{a}bucket") == F.array_min(F.array_intersect(f"{a}buckets", f"{b}buckets"))


def drop_near_duplicates(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id.

    Rows of one id and one text count as one document. Rows with a null doc_id all stay. All columns are returned.
    """
    placed = link_documents(documents, shingle, percent)
    chosen = placed.filter(F.col("kept") & F.col("doc_id").isNotNull())
    chosen = chosen.select("doc_id", F.coalesce("text_hash", F.lit(0)).alias("text_hash"))
    text_hash = unused(documents, "_text_hash")
    marked = documents.withColumn(text_hash, F.coalesce(F.xxhash64("text"), F.lit(0)))
    same = (marked["doc_id"] == chosen["doc_id"]) & (marked[text_hash] == chosen["text_hash"])
    return (
        marked.join(chosen, same, "left_semi")
        .dropDuplicates(["doc_id", text_hash])
        .unionByName(marked.filter(F.col("doc_id").isNull()))
        .drop(text_hash)
    )
