"""Benchmark decontamination by template windows.

Texts are canonicalised word by word: numbers, units after a number and names become typed placeholders, other words are
lower-cased and lose punctuation at their ends. Windows of the canonical words are hashed and joined to those of
the benchmark, which finds questions that were copied with other numbers or names. Every window also has a literal form,
of all its words in lower case without types, so that plain copies match in any case and however few literal words
they have. A window's first word has no word before it to tell its type; where that matters it is taken both ways.

A changed window has to be consistent with the other windows of its placement: every value of a slot in the item must
stand for one value in the document. Windows that touch a value which stands for several do not count, unless
nothing is changed in them.

Document windows meet the benchmark in two steps. A bit filter sized by the number of benchmark windows, at most 128 MB, is sent
to the tasks and drops nearly all windows that cannot match; the rest goes through a shuffled hash join with the
exact windows. The filter only saves work: with a benchmark of any size the result is the join's.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .words import SMALL_CHUNK_BYTES, Words, mix, text_chunks, unused

WINDOW = 13
# Literal words in a typed window of a longer item, and in an item that is one window.
LEAST_LITERALS, LEAST_IN_WHOLE = 6, 3
# Items of fewer words are found as they are and where they stand alone.
LEAST_WORDS = 5
# The filter has some 32 bits for each benchmark window, from 2 MB to 128 MB.
LEAST_BITS, MOST_BITS = 24, 30

# Units that make a typed slot after a number.
UNITS = frozenset(
    b"mm cm m km in inch inches ft feet yd mi mile miles mg g kg t oz lb lbs pound pounds ml cl l liter liters litre "
    b"litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    b"hz khz mhz ghz w kw mw kwh v a k c f % $ usd eur gbp dollar dollars euro euros cent cents kb mb gb tb km/h mph".split()
)
NUMBER, UNIT, NAME, WORD = 1, 2, 3, 0
NUMBER_BIT, UNIT_BIT, NAME_BIT, END_BIT = 1, 2, 4, 8

_NUMBER = re.compile(rb"[-+$]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
_EDGE = b"".join(bytes([c]) for c in range(33, 127) if not bytes([c]).isalnum())
_ENDS = (b".", b"!", b"?", b":", b"|", b'"', b")")


class Canonical:
    """Type and 64-bit hash of words; what was seen is kept, up to a bound."""

    HELD = 600_000

    def __init__(self):
        self._clear()

    def _clear(self):
        self.code: dict[bytes, int] = {}
        self.traits = np.zeros((1024, 4), dtype=bool)
        self.values = np.zeros((1024, 2), dtype=np.uint64)

    def _add(self, words: list[bytes]) -> None:
        at = len(self.code)
        while at + len(words) > len(self.values):
            self.traits = np.concatenate([self.traits, np.zeros_like(self.traits)])
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        traits, values, empty = [], [], []
        for i, word in enumerate(words):
            core = word if word.isalpha() else word.strip(_EDGE)
            lower = core.lower()
            trait = UNIT_BIT if lower in UNITS or word in UNITS else 0
            first = core[:1]
            # A number begins with a digit, a name with no lower-case letter.
            if first.isdigit() and _NUMBER.fullmatch(word.strip(b"\"'()[]{}<>;,.!?")):
                trait |= NUMBER_BIT
            if len(core) > 1 and not first.islower() and core.decode(errors="replace").istitle():
                trait |= NAME_BIT
            if core is not word and word.endswith(_ENDS):
                trait |= END_BIT
            traits.append(trait)
            values.append(lower or word)
            if not lower:
                empty.append(at + i)
        bits = np.array(traits, dtype=np.uint8)[:, None]
        self.traits[at : at + len(words)] = bits & [NUMBER_BIT, UNIT_BIT, NAME_BIT, END_BIT]
        # Words of punctuation alone have one value, but are told apart in literal windows.
        self.values[at : at + len(words)] = Words([b" ".join(values)]).hashes()[:, None]
        self.values[empty, 0] = 0
        self.code.update(zip(words, range(at, at + len(words))))

    def codes(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(self.code) > self.HELD:
                self._clear()
            new = list(set(words).difference(self.code))
            if new:
                self._add(new)
            return np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))


class CanonicalWords:
    """The words of some texts in a row, typed.

    kind and other: types, also as first words (-1: no other one); value and exact: hashes for typed and literal
    windows; opens: whether a word begins a text, line or sentence; first[i]:first[i + 1] are the words of text i.
    """

    def __init__(self, texts: list[bytes], canonical: Canonical):
        words = Words(texts)
        codes = canonical.codes(words.joined[:-8].split())
        number, unit, named, ends = canonical.traits[codes].T
        n = len(codes)
        starts_text = np.zeros(n + 1, dtype=bool)
        starts_text[words.first] = True
        starts_text = starts_text[:n]
        after_end = np.concatenate(([True], ends[:-1])) if n else ends
        breaks = np.cumsum(words.buffer[: words.start[-1] + 1] == 10) if n else words.buffer[:0]
        broken = np.ones(n, dtype=bool)
        broken[1:] = breaks[words.start[1:]] > breaks[words.end[:-1] - 1]
        begins = starts_text | after_end
        beside = np.zeros(n, dtype=bool)
        beside[1:] = number[:-1] & ~starts_text[1:]
        kind = np.where(
            number, NUMBER, np.where(unit & beside, UNIT, np.where(named & ~begins, NAME, WORD))
        )
        self.kind = kind
        self.other = np.where((kind == UNIT) | (kind == NAME), WORD, np.where(named & (kind == WORD), NAME, -1))
        self.value, self.exact = canonical.values[codes].T
        self.opens = begins | broken
        self.first = words.first

    def forms(self, sizes: list[int], longest: int):
        """Yields (size, starts, hashes, types of the first words) of the windows within one text; -1 marks the literal form.

        Whole items (sizes below ``longest``) need fewer literal words in their typed form than windows of longer ones.
        Of fewer than LEAST_WORDS words there is only the literal form, and only where they stand alone: a text, line
        or sentence of their own. Any other literal window counts wherever it is.
        """
        kind, n_words = self.kind, len(self.kind)
        literal = kind == WORD
        typed = np.where(literal, self.value, kind.astype(np.uint64))
        total = np.concatenate(([0], np.cumsum(literal)))
        text_end = np.repeat(self.first[1:], np.diff(self.first))
        closes = np.concatenate((self.opens[1:], [True]))
        tails, wholes = rolling(typed[1:]), rolling(self.exact)
        tail = np.zeros(0, dtype=np.uint64)
        for size in range(1, max(sizes, default=0) + 1):
            n = n_words - size + 1
            if n <= 0:
                return
            whole = next(wholes)
            if size in sizes:
                at = np.flatnonzero(np.arange(size, n_words + 1) <= text_end[:n])
                if size < LEAST_WORDS:
                    alone = at[self.opens[at] & closes[at + size - 1]]
                    yield size, alone, _literal(whole[alone], size), np.full(len(alone), -1)
                else:
                    least = LEAST_LITERALS if size == longest else LEAST_IN_WHOLE
                    enough = total[size:] - total[1 : n + 1] - least
                    for start, first in ((at, kind[at]), (at[self.other[at] >= 0], self.other[at[self.other[at] >= 0]])):
                        good = enough[start] + (first == WORD) >= 0
                        start, first = start[good], first[good]
                        head = np.where(first == WORD, self.value[start], first.astype(np.uint64))
                        yield size, start, mix(mix(tail[start]) + mix(head) + np.uint64(size)), first
                    yield size, at, _literal(whole[at], size), np.full(len(at), -1)
            tail = next(tails)


def rolling(values: np.ndarray):
    """Yields for one word, two, and so on a hash of the run from each place."""
    run = values.copy()
    size = 1
    while True:
        yield run
        size += 1
        run = run[: max(0, len(values) - size + 1)] * np.uint64(0x9E3779B97F4A7C15) + values[size - 1 :]


def _literal(run: np.ndarray, size: int) -> np.ndarray:
    return mix(mix(run) + np.uint64(size | 1 << 32))


def _may_match(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - (8 * len(table)).bit_length() + 1)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8) & 1) > 0


def _windows(rows: DataFrame, sizes: list[int], own_size: bool, bits=None) -> DataFrame:
    """Windows of rows (key, text): hash of each form, start, and hashes of the typed words in order.

    With ``own_size`` a text shorter than the longest size is one window of its own size; else
    every size is taken from every text. ``row`` tells input rows apart.
    """
    longest = max(sizes)

    def cut(batches):
        canonical, task, number = Canonical(), TaskContext.get().partitionId(), 0
        table = bits.value if bits is not None else None
        for chunk, texts in text_chunks(batches, limit=SMALL_CHUNK_BYTES):
            of, row, start, template, slots = [], [], [], [], []
            words = CanonicalWords(texts, canonical)
            count = np.diff(words.first)
            text_of = np.repeat(np.arange(len(texts)), count)
            for size, starts, hashes, firsts in words.forms(sizes, longest):
                if own_size:
                    some = np.minimum(count[text_of[starts]], longest) == size
                else:
                    some = _may_match(table, hashes)
                some = np.flatnonzero(some)
                for p, h, first in zip(starts[some].tolist(), hashes[some].view(np.int64).tolist(), firsts[some].tolist()):
                    typed = words.kind[p : p + size] != WORD
                    typed[0] = first != WORD
                    of.append(text_of[p])
                    row.append((task << 36) | (number + int(text_of[p])))
                    start.append(p - int(words.first[text_of[p]]))
                    template.append(h)
                    slots.append(words.value[p : p + size][typed & (first >= 0)].view(np.int64))
            number += len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("key").take(pa.array(of, pa.int64())),
                    pa.array(row, pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(template, pa.int64()),
                    pa.array(slots, pa.list_(pa.int64())),
                ],
                names=["key", "row", "start", "template", "slots"],
            )

    kind_of_key = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(
        cut, f"key {kind_of_key}, row long, start long, template long, slots array<long>"
    )


def _filter(windows: DataFrame) -> np.ndarray:
    """The bit filter; Spark puts its 64-bit parts together."""
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * windows.count()).bit_length()))
    place = windows.select(F.shiftrightunsigned("template", 64 - bits).alias("place"))
    parts = place.groupBy(F.shiftright("place", 6).alias("part")).agg(
        F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits")
    )
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for r in parts.toLocalIterator():
        table[r.part] = r.bits & 0xFFFFFFFFFFFFFFFF
    return table.view(np.uint8)


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Pairs (doc_key, item_key) whose texts share a consistent template window.

    n_windows is the most consistent windows of one placement of the item in the document, n_changed the slots whose value
    differs there at least: 0 for a plain copy. Items of fewer words than the window count if all their words match;
    items of under 5 words only where they are a text, line or sentence of their own, with no other values. Null and empty texts match nothing, repeated rows of one key are one pair (of
    the most windows), a null key is a key like others, and other columns are not read.
    """
    items = benchmark.select(F.col(item_key).alias("key"), F.col(text).alias("text"))
    rows = documents.select(F.col(doc_key).alias("key"), F.col(text).alias("text"))
    # At most ``window`` sizes, so this is a bounded read.
    size = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    found = {r[0] for r in items.select(F.least(size, F.lit(window)).alias("n")).distinct().collect()}
    sizes = sorted(n for n in found | {window} if n)
    wanted = _windows(items, sizes, own_size=True).select(
        "template",
        F.col("key").alias(item_key),
        F.col("row").alias("_item"),
        F.col("start").alias("_from"),
        F.col("slots").alias("_theirs"),
    )
    bits = documents.sparkSession.sparkContext.broadcast(_filter(wanted))
    met = _windows(rows, sizes, own_size=False, bits=bits).join(wanted, "template")
    pairs = F.arrays_zip(F.col("_theirs").alias("a"), F.col("slots").alias("b"))
    placed = (
        met.groupBy(F.col("key").alias(doc_key), "row", item_key, "_item", (F.col("start") - F.col("_from")).alias("_shift"))
        # A placement has no more windows than the item has words, in three forms.
        .agg(F.collect_set(F.struct("start", pairs.alias("pairs"))).alias("_met"))
        .withColumn("_values", F.array_sort(F.array_distinct(F.flatten("_met.pairs"))["a"]))
        .withColumn("_several", F.filter("_values", lambda v, i: (i > 0) & (F.get("_values", i - 1) == v)))
        .withColumn(
            "_good",
            F.filter(
                "_met",
                lambda m: F.forall(m["pairs"], lambda p: p["a"] == p["b"])
                | ~F.arrays_overlap(m["pairs"]["a"], F.col("_several")),
            ),
        )
        .filter(F.size("_good") > 0)
    )
    changed = F.filter(F.array_distinct(F.flatten("_good.pairs")), lambda p: p["a"] != p["b"])
    return placed.groupBy(doc_key, item_key).agg(
        F.max(F.size(F.array_distinct("_good.start")).cast("long")).alias("n_windows"),
        F.min(F.size(changed).cast("long")).alias("n_changed"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text shares no consistent template window with an item; texts decide, not ids.

    The digests found are written first, so that their true size decides whether the documents have to be shuffled.
    """
    digest, name = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))), unused(documents, "_digest")
    texts = documents.select(digest.alias("digest"), F.col(text).alias("text"))
    items = benchmark.select("item_id", "text")
    leaked = find_contamination(texts, items, doc_key="digest").select(F.col("digest").alias(name)).distinct()
    leaked = materialize(leaked, "leaked")
    return documents.withColumn(name, digest).join(leaked, name, "left_anti").select(*documents.columns)
