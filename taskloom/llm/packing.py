"""Cost-balanced packing of documents into sequences of bounded length.

The cost of a document of n tokens in a sequence is ``linear * n + quadratic * n * n``: the work of the layers and of
attention within the document. Documents are taken by descending cost and go to the sequence of lowest cost that
still has room. A group's sequences have exactly as much room as the group has tokens: full ones, and for the
rest lengths that are powers of two. So nothing is padded, and only what fits nowhere whole is cut.

A group is some millions of consecutive tokens of one input partition: packing needs no shuffle, a task holds
one group, and a partition that is redone gives the same sequences.
"""

from __future__ import annotations

import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import PreTokens, Remembered
from .words import text_chunks

CAPACITY = 4096
GROUP_TOKENS = 1 << 21
HELD_WORDS, HELD_PIECES = 1_200_000, 200_000


def sequence_lengths(total: int, capacity: int) -> list[int]:
    """Room for exactly ``total`` tokens: full sequences, then powers of two."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(
    lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / CAPACITY
) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths."""
    room = np.array(sequence_lengths(sum(lengths), capacity), dtype=np.int64)
    used = np.zeros(len(room), dtype=np.int64)
    cost = np.zeros(len(room))
    most = int(room[0]) if len(room) else 0
    queue = []
    for document, length in enumerate(lengths):
        for start in range(0, length, most or 1):
            queue.append((-min(most, length - start), document, start))
    heapq.heapify(queue)
    pieces = []
    while queue:
        size, document, start = heapq.heappop(queue)
        length = -size
        fits = room - used >= length
        if fits.any():
            best = int(np.where(fits, cost, np.inf).argmin())
        else:
            best = int((room - used).argmax())
            left = length - int(room[best] - used[best])
            length -= left
            heapq.heappush(queue, (-left, document, start + length))
        pieces.append((document, start, length, best, int(used[best])))
        used[best] += length
        cost[best] += linear * length + quadratic * length * length
    return pieces


def pack_documents(
    documents: DataFrame,
    path: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Each document's ids and ``end_id``, cut and placed in sequences of at most ``capacity``.

    One row per piece: doc_id, start (ids of its document before it), length, doc_tokens, sequence_id, offset in the
    sequence, sequence_length, and ids as packed little-endian 32-bit numbers. A null or empty text is the
    end id alone. Rows with null or repeated ids are packed like any other; other columns are not read.
    An empty table gives no rows.
    """
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def place(batches):
        splitter = PreTokens(path)
        pieces_of = Remembered(lambda p: array("I", splitter.ids(p)).tobytes(), HELD_PIECES)
        # No pre-token reaches over white space, so a text's ids are those of its words in a row.
        words = Remembered(lambda w: splitter.word(w, pieces_of), HELD_WORDS)
        task, sequences = TaskContext.get().partitionId(), 0

        def encoded(texts: list[bytes]) -> list[bytes]:
            special = [splitter.has_special(t) for t in texts]
            units, first = splitter.units([b"" if s else t for t, s in zip(texts, special)])
            pieces = words.of(units.dictionary.to_pylist())
            size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
            begin = np.cumsum(size) - size
            unit = units.indices.to_numpy()
            after = np.concatenate(([0], np.cumsum(size[unit])))
            at = np.repeat(begin[unit] - after[:-1], size[unit]) + np.arange(after[-1])
            found = np.frombuffer(b"".join(pieces), dtype="<u4")[at]
            edge = after[first]
            return [
                (b"".join(words.of(t.split())) if s else found[x:y].tobytes()) + end
                for t, s, x, y in zip(texts, special, edge[:-1], edge[1:])
            ]

        def packed(ids, held):
            nonlocal sequences
            lengths = [len(x) // 4 for x in held]
            rooms = sequence_lengths(sum(lengths), capacity)
            pieces = pack(lengths, capacity)
            pieces.sort(key=lambda p: (p[3], p[4]))
            base = (task << 36) | sequences
            sequences += len(rooms)
            for at in range(0, len(pieces), 4096):
                some = pieces[at : at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[d] for d, *_ in some], ids_type),
                        pa.array([p[1] for p in some], pa.int64()),
                        pa.array([p[2] for p in some], pa.int64()),
                        pa.array([lengths[p[0]] for p in some], pa.int64()),
                        pa.array([base + p[3] for p in some], pa.int64()),
                        pa.array([p[4] for p in some], pa.int64()),
                        pa.array([rooms[p[3]] for p in some], pa.int64()),
                        pa.array([held[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in some], pa.binary()),
                    ],
                    names=names,
                )

        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length", "ids"]
        ids, held, total, ids_type = [], [], 0, None
        for rows, texts in text_chunks(batches):
            ids_type = rows.column("doc_id").type
            for i, one in zip(rows.column("doc_id").to_pylist(), encoded(texts)):
                ids.append(i)
                held.append(one)
                total += len(one) // 4
                if total >= group_tokens:
                    yield from packed(ids, held)
                    ids, held, total = [], [], 0
        if held:
            yield from packed(ids, held)

    return source.mapInArrow(
        place,
        f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, "
        "sequence_length long, ids binary",
    )
