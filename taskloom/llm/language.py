"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. For each place of the codewords a binary classifier says on which side
a text lies, from its hashed character n-grams. Decoding compares a text's margins with every codeword: each place adds a logistic
loss weighted by its margin, and the codeword of least loss wins. A text is decoded in parts of some words, since sums
over a long text make any small lead certain; its score is the mean probability of the best language over its parts, and
a text is ambiguous if that is below three quarters, as in texts of several languages.

The classifiers come from one table of sums, (language, bin, count), which all training rows fill through partial
aggregation; it has at most languages x bins rows whatever the input, so the driver may read it. Applying the
model is one pass without a shuffle; the model's size is bins x places.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import SMALL_CHUNK_BYTES, text_chunks

BINS = 1 << 13
GRAMS = (2, 3, 4)
UNKNOWN = "und"
PART_BYTES = 30
AMBIGUOUS_BELOW = 0.75
# Languages learned at most: the driver holds BINS counts for each.
MOST_LANGUAGES = 2048
# Parts whose evidence is looked up at once, which bounds memory on long texts.
PARTS_AT_ONCE = 512

_OTHER = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letters_of(text: str) -> str:
    """The letters of a text in lower case, runs of anything else as one space."""
    letters = _OTHER.sub(" ", text.lower()).strip()
    # Number characters beyond the decimal ones are words to regular expressions, but no letters.
    if not letters.replace(" ", "").isalpha():
        letters = " ".join("".join(c if c.isalpha() else " " for c in letters).split())
    return letters


def _grams(text: bytes, bins: int) -> list[np.ndarray]:
    """Per size, the bins of a text's n-grams in order; empty without letters."""
    letters = letters_of(text.decode())
    if not letters:
        return []
    data = np.frombuffer(f" {letters} ".encode(), dtype=np.uint8).astype(np.uint64)
    shift, found, value = np.uint64(64 - (bins.bit_length() - 1)), [], data
    for n in range(2, max(GRAMS) + 1):
        value = (value[:-1] << np.uint64(8)) | data[n - 1 :]
        if not value.size:
            break
        if n in GRAMS:
            found.append((((value + np.uint64(n << 56)) * _MIX) >> shift).astype(np.int64))
    return found


def gram_bins(text: bytes, bins: int = BINS) -> np.ndarray:
    """Bins of a text's n-grams over its letters, words parted by one space; empty without letters."""
    return np.concatenate([np.zeros(0, dtype=np.int64), *_grams(text, bins)])


def part_sums(text: bytes, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Evidence of the parts of a text, of about PART_BYTES each; a row per part, no rows without letters."""
    grams = _grams(text, bins)
    if not grams:
        return np.zeros((0, weights.shape[1]))
    size = len(grams[0]) + 1
    parts = max(1, round(size / PART_BYTES))
    start = np.arange(parts + 1) * size // parts
    sums = np.zeros((parts, weights.shape[1]))
    for of_size in grams:
        for low in range(0, parts, PARTS_AT_ONCE):
            high = min(low + PARTS_AT_ONCE, parts)
            some = weights[of_size[start[low] : start[high]]]
            sums[low:high] += np.add.reduceat(some, start[low:high] - start[low])
    return sums


def codewords(languages: int) -> np.ndarray:
    """Rows of +1 and -1, one per language: all distinct splits of few languages, else random ones.

    Of the random tables that a fixed seed gives, the one whose nearest rows are farthest apart is taken.
    """
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 6:
        splits = np.arange(1, 1 << (languages - 1))
        return np.where(splits >> np.arange(languages)[:, None] & 1, 1.0, -1.0)
    places, random = 10 * int(np.ceil(np.log2(languages))), np.random.default_rng(7)
    best, most = None, -1.0
    for _ in range(40):
        table = random.choice([-1.0, 1.0], (languages, places))
        table = table[:, np.abs(table.sum(axis=0)) < languages]
        near = (table @ table.T - 2 * places * np.eye(languages)).max()
        if (table.shape[1] - near) / 2 > most:
            best, most = table, (table.shape[1] - near) / 2
    return best


@dataclass
class LanguageModel:
    """Codewords, and for each bin the evidence on every place; ``clip`` bounds the sum on a place."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    clip: float = 40.0

    def predict(self, sums: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and mean probability of the best language of texts, whose rows in ``sums`` begin at ``first``."""
        if len(self.languages) == 1:
            return np.zeros(len(first), dtype=np.int64), np.ones(len(first))
        margin = np.clip(sums, -self.clip, self.clip)
        loss = np.zeros((len(sums), len(self.code)))
        for place in range(self.code.shape[1]):
            loss += np.logaddexp(0.0, -margin[:, place, None] * self.code[None, :, place])
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        share = np.add.reduceat(share, first) / np.diff([*first, len(sums)])[:, None]
        best = share.argmax(axis=1)
        return best, share[np.arange(len(best)), best]


def fit_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", bins: int = BINS) -> LanguageModel:
    """Learn from all rows with a language and a letter; languages weigh the same however many rows they have.

    More than MOST_LANGUAGES different ones are an error, as the model would outgrow the driver and the tasks.
    """
    labelled = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for rows, texts in text_chunks(batches):
            for t, name in zip(texts, rows.column("lang").to_pylist()):
                if name not in sums:
                    sums[name] = np.zeros(bins, dtype=np.int64)
                sums[name] += np.bincount(gram_bins(t, bins), minlength=bins)
        for name, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([name] * len(some)), "bin": pa.array(some), "n": pa.array(total[some])}
            )

    table = (
        labelled.mapInArrow(count, "lang string, bin long, n long")
        .groupBy("lang", "bin")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    languages = sorted({r.lang for r in table})
    place = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((len(languages), bins))
    for r in table:
        counts[place[r.lang], r.bin] = r.n
    share = counts + 0.5
    share /= share.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((bins, code.shape[1]))
    if len(languages) > 1:
        for b in range(code.shape[1]):
            above, below = share[code[:, b] > 0], share[code[:, b] < 0]
            weights[:, b] = np.log(above.mean(axis=0)) - np.log(below.mean(axis=0))
    return LanguageModel(languages, code, weights)


def identify_languages(
    documents: DataFrame, model: LanguageModel, text: str = "text", bins: int = BINS
) -> DataFrame:
    """Add lang_pred, score (0 to 1) and ambiguous to each row, from its whole text alone.

    Without a letter (null and empty texts included), or with nothing learned, a row is ``und`` with score 0 and not
    ambiguous. Columns of these names are replaced, others pass through. Equal texts get equal results.
    """
    made = ("lang_pred", "score", "ambiguous")
    source = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c not in made])
    # Plain values only: a broadcast object's class would have to be installed on the executors.
    learned = (model.languages, model.code, model.weights, model.clip)
    shared = documents.sparkSession.sparkContext.broadcast(learned)

    def apply(batches):
        known = LanguageModel(*shared.value)
        for rows, texts in text_chunks(batches, text, SMALL_CHUNK_BYTES):
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for at in range(0, len(texts), 256):
                if not known.languages:
                    continue
                sums = [part_sums(t, known.weights, bins) for t in texts[at : at + 256]]
                some = [i for i, x in enumerate(sums) if len(x)]
                if not some:
                    continue
                sizes = [len(sums[i]) for i in some]
                best, score = known.predict(np.concatenate([sums[i] for i in some]), np.cumsum([0, *sizes[:-1]]))
                for i, b, s in zip(some, best, score):
                    names[at + i], scores[at + i] = known.languages[b], s
            unsure = [n != UNKNOWN and s < AMBIGUOUS_BELOW for n, s in zip(names, scores)]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(names), pa.array(scores), pa.array(unsure)],
                names=[*rows.schema.names, *made],
            )

    schema = _widened(source, "lang_pred string, score double, ambiguous boolean")
    return source.mapInArrow(apply, schema)


def _widened(source: DataFrame, more: str) -> T.StructType:
    return T.StructType(source.schema.fields + T.StructType.fromDDL(more).fields)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: CRC-32 of the id's text, modulo 3, is 1. Never so for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
