"""Substring dedup with repeated-phrase automata.

1. Every window of 13 words is hashed, and the hashes meet in shards. A shard finds the windows that several documents
   hold, the smallest document of each (its owner) and the blocks of documents that hold it.
2. Owners turn those windows into text: consecutive ones become a passage, one for each block that needs it.
3. Each block of documents compiles an Aho-Corasick automaton of its passages and streams all its documents through it.
   The automaton holds every seventh run of seven words of a passage: any 13 words in a row contain one of them. From each hit
   the passage is compared word for word in both directions, and 13 equal words or more are an occurrence.

So hashes only nominate and the texts themselves decide. A collision of hashes can at most hide a repeated window from
step 2, with a probability of 2^-56 for a given pair of windows. Windows travel as 7 bytes each; a shard and a block are of bounded size,
since their numbers follow the input; a window that very many documents hold is one entry per block and not per document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, inside, text_chunks, window_hashes

WINDOW = 13
ATOM = WINDOW // 2 + 1
BLOCK_BYTES = 4 << 20
_LOW = np.uint64((1 << 56) - 1)


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, count: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(pa.decompress(data, count * kind.itemsize, codec="zstd", asbytes=True), dtype=kind)


def _seven(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _from_seven(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 7, 8), dtype=np.uint8)
    wide[:, :7] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 7)
    return wide.view("<u8").ravel()


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _key(low: np.ndarray, shard) -> np.ndarray:
    return (low & _LOW) | (np.asarray(shard).astype(np.uint64) << np.uint64(56))


def _window_shards(documents: DataFrame, shards: int, window: int) -> DataFrame:
    """Rows (shard, windows, ids, counts, n_ids): the window hashes of some documents, in document order."""

    def cut(batches):
        for rows, texts in text_chunks(batches):
            words = Words(texts)
            hashes = window_hashes(words.hashes(), window)
            start = np.flatnonzero(inside(words.first, window)[: len(hashes)])
            hashes = hashes[start]
            document = words.text_of()[start]
            shard = _shard(hashes, shards)
            order = np.argsort(shard, kind="stable")
            hashes, document, shard = hashes[order], document[order], shard[order]
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            edges = np.searchsorted(shard, np.arange(shards + 1))
            out = []
            for s in np.flatnonzero(np.diff(edges)):
                own = document[edges[s] : edges[s + 1]]
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                counts = np.diff(np.concatenate((first, [len(own)])))
                some = ids[own[first]]
                out.append(
                    (
                        int(s),
                        _seven(hashes[edges[s] : edges[s + 1]]),
                        _pack(np.diff(some, prepend=np.int64(0))),
                        _pack(counts.astype(np.uint32)),
                        len(some),
                    )
                )
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*out)], names=["shard", "windows", "ids", "counts", "n_ids"]
                )

    return documents.mapInArrow(cut, "shard long, windows binary, ids binary, counts binary, n_ids long")


def _recurring(windows: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, shard, windows, owners, n, dests, counts, n_dests): what the documents of a block own.

    ``counts`` says for each window how many blocks need it, ``dests`` lists them.
    """

    def find(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        low = np.concatenate([_from_seven(x) for x in table.column("windows").to_pylist()])
        ids = []
        for packed, counts, n in zip(
            table.column("ids").to_pylist(), table.column("counts").to_pylist(), table.column("n_ids").to_pylist()
        ):
            ids.append(np.repeat(np.cumsum(_unpack(packed, n, np.int64)), _unpack(counts, n, np.uint32)))
        ids = np.concatenate(ids)
        order = np.argsort(low)
        low, ids = low[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        owner = np.minimum.reduceat(ids, first)
        shared = np.maximum.reduceat(ids, first) > owner
        size = np.diff(np.concatenate((first, [len(low)])))
        group = np.repeat(np.arange(len(first)), size)
        take = np.repeat(shared, size) & (ids != np.repeat(owner, size))
        pair = np.unique(np.stack([group[take], _block(ids[take], blocks)]), axis=1) if take.any() else np.zeros((2, 0), int)
        needed = np.flatnonzero(shared)
        counts = np.bincount(pair[0], minlength=len(first))[needed]
        home = _block(owner[needed], blocks)
        by_home = np.argsort(home, kind="stable")
        needed, counts, home = needed[by_home], counts[by_home], home[by_home]
        # The blocks of one window stand together in ``pair``; take them in the new order.
        begin = np.searchsorted(pair[0], needed)
        dests = pair[1][np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        ends = np.cumsum(counts)
        out = []
        edge = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1]))) if len(home) else []
        for a, b in zip(edge, [*edge[1:], len(home)]):
            rows = needed[a:b]
            d = dests[ends[a] - counts[a] : ends[b - 1]]
            out.append(
                (
                    int(home[a]), shard, _seven(low[first[rows]]), _pack(owner[rows]), len(rows),
                    _pack(d.astype(np.int64)), _pack(counts[a:b].astype(np.uint32)), len(d),
                )
            )
        names = ["block", "shard", "windows", "owners", "n", "dests", "counts", "n_dests"]
        if not out:
            return pa.table({n: pa.array([], _RECURRING[n]) for n in names})
        return pa.table({n: pa.array(c, _RECURRING[n]) for n, c in zip(names, zip(*out))})

    return windows.groupBy("shard").applyInArrow(
        find,
        "block long, shard long, windows binary, owners binary, n long, dests binary, counts binary, n_dests long",
    )


# The block of an id; ids in steps fill all blocks, and no product leaves 64 bits.
_PRIME, _FACTOR = 2**31 - 1, 1_103_515_245


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    return np.mod(ids, _PRIME) * _FACTOR % _PRIME % blocks


_RECURRING = {
    "block": pa.int64(), "shard": pa.int64(), "windows": pa.binary(), "owners": pa.binary(), "n": pa.int64(),
    "dests": pa.binary(), "counts": pa.binary(), "n_dests": pa.int64(),
}


def _passages(blocks_of_documents: DataFrame, recurring: DataFrame, shards: int, window: int) -> DataFrame:
    """Rows (dest, owner, passage): text of the recurring windows, consecutive ones together."""

    def write(documents: pa.Table, wanted: pa.Table) -> pa.Table:
        dest_out, owner_out, passage_out = [], [], []
        if wanted.num_rows and documents.num_rows:
            keys, owners, counts, dests = [], [], [], []
            for r in wanted.to_pylist():
                keys.append(_key(_from_seven(r["windows"]), r["shard"]))
                owners.append(_unpack(r["owners"], r["n"], np.int64))
                counts.append(_unpack(r["counts"], r["n"], np.uint32).astype(np.int64))
                dests.append(_unpack(r["dests"], r["n_dests"], np.int64))
            keys, owners, counts, dests = map(np.concatenate, (keys, owners, counts, dests))
            begin = np.cumsum(counts) - counts
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            found = np.zeros(len(keys), dtype=bool)
            for rows, texts in text_chunks(documents.combine_chunks().to_batches()):
                words = Words(texts)
                hashes = window_hashes(words.hashes(), window)
                start = np.flatnonzero(inside(words.first, window)[: len(hashes)])
                own = _key(hashes[start], _shard(hashes[start], shards))
                ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
                place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == own)
                hit = hit[ids[words.text_of()[start[hit]]] == owners[order[place[hit]]]]
                hit = hit[np.unique(place[hit], return_index=True)[1]]
                hit = hit[~found[place[hit]]]
                found[place[hit]] = True
                entry = order[place[hit]]
                at = np.repeat(start[hit], counts[entry])
                many = counts[entry]
                to = dests[np.repeat(begin[entry] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                by = np.lexsort((at, to))
                at, to = at[by], to[by]
                text = words.text_of()[at]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (to[1:] != to[:-1]) | (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
                edge = np.flatnonzero(new)
                for a, b in zip(edge, [*edge[1:], len(at)]):
                    span = range(at[a], at[b - 1] + window)
                    dest_out.append(int(to[a]))
                    owner_out.append(int(ids[text[a]]))
                    passage_out.append(b" ".join([words.joined[words.start[w] : words.end[w]] for w in span]))
        return pa.table(
            {
                "dest": pa.array(dest_out, pa.int64()),
                "owner": pa.array(owner_out, pa.int64()),
                "passage": pa.array(passage_out, pa.binary()),
            }
        )

    return (
        blocks_of_documents.groupBy("block")
        .cogroup(recurring.groupBy("block"))
        .applyInArrow(write, "dest long, owner long, passage binary")
    )


class PassageAutomaton:
    """Finds the occurrences of passages in a text given as its words."""

    def __init__(self, passages: list[tuple[int, bytes]], window: int = WINDOW):
        import ahocorasick

        self.window, self.atom = window, window // 2 + 1
        self.owners = [o for o, _ in passages]
        self.words = [p.split() for _, p in passages]
        atoms: dict[str, list[tuple[int, int]]] = {}
        for i, words in enumerate(self.words):
            for o in range(0, len(words) - self.atom + 1, self.atom):
                run = b" ".join(words[o : o + self.atom])
                atoms.setdefault(f" {run.decode('latin-1')} ", []).append((i, o))
        self.automaton = ahocorasick.Automaton()
        for run, places in atoms.items():
            self.automaton.add_word(run, (len(run), places))
        if atoms:
            self.automaton.make_automaton()
        self.empty = not atoms

    def covered(self, document: int, words: list[bytes]) -> np.ndarray:
        """Which words lie in an occurrence that a smaller document owns."""
        change = np.zeros(len(words) + 1, dtype=np.int64)
        if self.empty or len(words) < self.window:
            return change[:-1] > 0
        text = f" {b' '.join(words).decode('latin-1')} "
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        at = np.cumsum(sizes) - sizes
        reached: dict[tuple[int, int], int] = {}
        for last, (length, places) in self.automaton.iter(text):
            here = -1
            for i, o in places:
                if self.owners[i] >= document:
                    continue
                if here < 0:
                    here = int(np.searchsorted(at, last + 1 - length))
                if reached.get((i, here - o), 0) >= here + self.atom:
                    continue
                passage = self.words[i]
                a, b, n = here, here + self.atom, o + self.atom
                while a > 0 and o > 0 and words[a - 1] == passage[o - 1]:
                    a, o = a - 1, o - 1
                while b < len(words) and n < len(passage) and words[b] == passage[n]:
                    b, n = b + 1, n + 1
                reached[(i, a - o)] = b
                if b - a >= self.window:
                    change[a] += 1
                    change[b] -= 1
        return np.cumsum(change[:-1]) > 0


def remove_repeated_passages(
    documents: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of each row.

    A word goes if a window of ``window`` words covers it whose words also stand in a row in a document with a smaller id. Windows are
    judged on the input. Ids are integers. A null or empty text has no words. A null id is neither smaller nor larger: such rows
    stay whole and remove nothing. Rows of one id do not remove each other's words. Other columns are not read.
    """
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(tasks, math.ceil(size / BLOCK_BYTES))
    identified = source.filter(F.col("doc_id").isNotNull())
    home = F.pmod("doc_id", F.lit(_PRIME)) * _FACTOR % _PRIME % blocks
    placed = identified.withColumn("block", home.cast("long"))
    recurring = _recurring(_window_shards(identified, blocks, window), blocks)
    passages = _passages(placed, recurring, blocks, window)

    def judged(ids, texts, automaton) -> dict:
        n_words, n_removed, kept = [], [], []
        for i, t in zip(ids.to_pylist(), texts):
            words = (t or b"").split()
            gone = automaton.covered(i, words) if automaton else np.zeros(len(words), dtype=bool)
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            if n_removed[-1]:
                words = [words[w] for w in np.flatnonzero(~gone)]
            kept.append(b" ".join(words))
        return {
            "doc_id": ids,
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        }

    def locate(rows: pa.Table, known: pa.Table) -> pa.Table:
        automaton = PassageAutomaton(
            list(zip(known.column("owner").to_pylist(), known.column("passage").to_pylist())), window
        )
        texts = rows.column("text").cast(pa.binary()).to_pylist()
        return pa.table(judged(rows.column("doc_id"), texts, automaton))

    def whole(batches):
        for rows, texts in text_chunks(batches):
            yield pa.RecordBatch.from_pydict(judged(rows.column("doc_id"), texts, None))

    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    cleaned = placed.groupBy("block").cogroup(passages.groupBy("dest")).applyInArrow(locate, schema)
    return cleaned.unionByName(source.filter(F.col("doc_id").isNull()).mapInArrow(whole, schema))
