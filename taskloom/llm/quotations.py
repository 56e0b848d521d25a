"""Quotation linking: conversations in reply order, without their quotes.

Lines that begin with ``>`` are quoted, once per mark. Runs of lines of one level are passages. Normalised passages and normalised
originals (whole messages, paragraphs, lines) are hashed, and passages join the originals of their hash: the latest earlier
message of the same conversation, or else the first message that has it in the smallest other conversation. The linked message of the
outermost level that a message quotes is what it replies to; without a link that is the message before it.

"The latest one before" is found in slices of turns: a window inside a slice, and a table with one row per slice for what lies before.
So one conversation or one common line may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize

SLICE = 256

_QUOTE = re.compile(r"^((?:\s*>)+)\s?(.*)$")


def normalised_hash(text: str) -> int | None:
    """Hash of a text's letters and digits in lower case, words parted by one space; None without any."""
    plain = " ".join(re.findall(r"\w+", text.casefold()))
    if not plain:
        return None
    return int.from_bytes(hashlib.blake2b(plain.encode(), digest_size=8).digest(), "little", signed=True)


def units(lines: list[str]) -> list[int]:
    """Hashes of the whole, of its paragraphs and of its lines, in this order, each once."""
    paragraphs = re.split(r"\n\s*\n", "\n".join(lines))
    found = (normalised_hash(x) for x in ["\n".join(lines), *paragraphs, *lines])
    return list(dict.fromkeys(h for h in found if h is not None))


def _attributes(line: str) -> bool:
    """Whether a line says who wrote what follows."""
    line = line.strip()
    return line.startswith("On ") and line.endswith(" wrote:") and len(line) > len("On  wrote:")


def _following(lines: list[str]) -> list[str]:
    """For each line the next one that is not blank, or an empty one."""
    found, following = [], ""
    for line in reversed(lines):
        found.append(following)
        following = line if line.strip() else following
    return found[::-1]


def parse_message(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """The text without quotes and attribution lines, and the quoted passages as (level, lines)."""
    body: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    lines, level_before = (text or "").split("\n"), 0
    for line, following in zip(lines, _following(lines)):
        m = _QUOTE.match(line)
        if m:
            level = m[1].count(">")
            if level != level_before:
                passages.append((level, []))
            passages[-1][1].append(m[2])
            level_before = level
            continue
        level_before = 0
        if not (_attributes(line) and _QUOTE.match(following)):
            body.append(line)
    return ("\n".join(body).strip("\n") if passages else text or ""), passages


_PASSAGES = pa.list_(pa.struct([("level", pa.int32()), ("units", pa.list_(pa.int64()))]))


def _parsed(messages: DataFrame) -> DataFrame:
    def parse(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            row, body, count, passages, own = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                row.append((task << 36) | number)
                number += 1
                plain, quoted = parse_message(text)
                body.append(plain)
                count.append(len(quoted))
                passages.append([{"level": n, "units": units(lines)} for n, lines in quoted])
                own.append(units(plain.split("\n")))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row, pa.int64()),
                    *[batch.column(c) for c in ("conv_id", "turn")],
                    pa.array(body, pa.string()),
                    pa.array(count, pa.int64()),
                    pa.array(passages, _PASSAGES),
                    pa.array(own, pa.list_(pa.int64())),
                ],
                names=["row", "conv_id", "turn", "body", "n_quotes", "passages", "units"],
            )

    kind = messages.schema["conv_id"].dataType.simpleString()
    return messages.mapInArrow(
        parse,
        f"row long, conv_id {kind}, turn long, body string, n_quotes long, "
        "passages array<struct<level: int, units: array<long>>>, units array<long>",
    )


def latest_before(rows: DataFrame, keys: list[str], at: str, marked: str, into: str) -> DataFrame:
    """Add the largest ``at`` of marked rows with the same keys that is below the row's own."""
    sliced = rows.withColumn("_slice", F.floor(F.col(at) / SLICE))
    mark = F.when(F.col(marked), F.col(at))
    near = Window.partitionBy(*keys, "_slice").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    far = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy(*keys, "_slice").agg(F.max(mark).alias("_most"))
    slices = slices.select(*keys, "_slice", F.max("_most").over(far).alias("_far"))
    return (
        sliced.withColumn("_near", F.max(mark).over(near))
        .join(slices, [*keys, "_slice"])
        .withColumn(into, F.coalesce("_near", "_far"))
        .drop("_near", "_far", "_slice")
    )


def link_quotations(
    messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", text: str = "text"
) -> DataFrame:
    """One row per message: conv_id, turn, body, n_quotes, n_linked, parent_turn, quoted_conv_id, quoted_turn, reply_path.

    ``body`` is the text without quotes. Ordering a conversation by ``reply_path`` puts every message behind the one it replies to, and
    the branches of one message in the order in which they began; the path has two numbers per branch and the turn. quoted_* is
    the message that the outermost passage was found in, of whatever conversation. A null or empty text has an
    empty body. Rows with a null conv_id or turn are returned unlinked with a null path. Repeated rows each
    get their row; messages of one turn count as one place. Only the three columns are read.
    """
    source = messages.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(text).alias("text")
    )
    parsed = materialize(_parsed(source), "messages")
    placed = parsed.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    links = materialize(_links(placed), "quotations")

    turns = placed.select("conv_id", "turn").distinct().withColumn("_is", F.lit(True))
    before = latest_before(turns, ["conv_id"], "turn", "_is", "previous").select("conv_id", "turn", "previous")
    replies = (
        placed.select("row", "conv_id", "turn")
        .join(before, ["conv_id", "turn"])
        .join(links, "row", "left")
        .withColumn("parent_turn", F.coalesce("parent_turn", "previous"))
    )
    replies = materialize(replies, "replies")
    paths = _paths(replies)
    return (
        parsed.select("row", "conv_id", "turn", "body", "n_quotes")
        .join(replies.drop("conv_id", "turn", "previous"), "row", "left")
        .join(paths.withColumnRenamed("turn", "_turn").withColumnRenamed("conv_id", "_conv"), (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
        .select(
            "conv_id", "turn", "body", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
            "parent_turn", "quoted_conv_id", "quoted_turn", "reply_path",
        )
    )


def _links(placed: DataFrame) -> DataFrame:
    """Per message with a linked passage: n_linked, parent_turn (same conversation), quoted_conv_id, quoted_turn."""
    outermost = F.array_min("passages.level").alias("outermost")
    passages = placed.select("row", "conv_id", "turn", outermost, F.posexplode("passages").alias("passage", "_p"))
    asked = passages.select(
        "row", "conv_id", "turn", "passage", (F.col("_p.level") == F.col("outermost")).alias("outer"),
        F.posexplode("_p.units").alias("rank", "unit"),
    )
    asked = materialize(asked, "passages")
    own = placed.select("conv_id", "turn", F.explode("units").alias("unit"))
    own = own.join(asked.select("unit").distinct(), "unit", "left_semi").distinct()
    rows = asked.withColumn("_original", F.lit(False)).unionByName(
        own.withColumn("_original", F.lit(True)), allowMissingColumns=True
    )
    near = latest_before(rows, ["conv_id", "unit"], "turn", "_original", "found").filter(~F.col("_original"))
    # The two smallest conversations of a unit, so that one of them is another one than the asking.
    ranked = Window.partitionBy("unit").orderBy("conv_id")
    smallest = (
        own.groupBy("unit", "conv_id").agg(F.min("turn").alias("turn"))
        .withColumn("_rank", F.row_number().over(ranked))
        .filter("_rank <= 2")
        .groupBy(F.col("unit").alias("_unit"))
        .agg(F.min(F.struct("conv_id", "turn")).alias("_first"), F.max(F.struct("conv_id", "turn")).alias("_second"))
    )
    other = F.when(F.col("_first.conv_id") != F.col("conv_id"), F.col("_first")).when(
        F.col("_second.conv_id") != F.col("conv_id"), F.col("_second")
    )
    both = (
        near.join(smallest, F.col("unit") == F.col("_unit"), "left")
        .withColumn("_other", other)
        .select(
            "row", "conv_id", "turn", "passage", "outer", "rank",
            F.coalesce("found", "_other.turn").alias("to_turn"),
            F.when(F.col("found").isNotNull(), F.col("conv_id")).otherwise(F.col("_other.conv_id")).alias("to_conv"),
            F.col("found").isNull().alias("elsewhere"),
        )
    )
    # One link per passage: the same conversation first, then the longest part.
    best = (
        both.filter(F.col("to_turn").isNotNull())
        .groupBy("row", "passage")
        .agg(F.min(F.struct("elsewhere", "rank", "outer", "to_conv", "to_turn")).alias("l"))
    )
    outer = F.when(F.col("l.outer"), F.struct(~F.col("l.elsewhere"), "l.to_turn", "l.to_conv"))
    return best.groupBy("row").agg(
        F.count("*").alias("n_linked"),
        F.max(F.when(~F.col("l.elsewhere") & F.col("l.outer"), F.col("l.to_turn"))).alias("parent_turn"),
        F.max(outer)["to_conv"].alias("quoted_conv_id"),
        F.max(outer)["to_turn"].alias("quoted_turn"),
    )


def _paths(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_path). A branch starts where a reply does not follow its parent directly.

    A branch's prefix is that of the branch that it leaves, with the place and the own first turn. Prefixes are put together by
    doubling, so the rounds are the logarithm of the deepest nesting.
    """
    turns = replies.groupBy("conv_id", "turn").agg(
        F.max("parent_turn").alias("parent"), F.max("previous").alias("previous")
    )
    turns = turns.withColumn("starts", F.col("parent").isNotNull() & (F.col("parent") != F.col("previous")))
    turns = latest_before(turns, ["conv_id"], "turn", "starts", "_branch")
    turns = turns.withColumn("branch", F.when(F.col("starts"), F.col("turn")).otherwise(F.col("_branch")))
    turns = materialize(turns.select("conv_id", "turn", "parent", "starts", "branch"), "turns")
    place_of = turns.select("conv_id", F.col("turn").alias("_at"), F.col("branch").alias("above"))
    branches = (
        turns.filter("starts")
        .join(place_of.withColumnRenamed("conv_id", "_c"), (F.col("conv_id") == F.col("_c")) & (F.col("parent") == F.col("_at")), "left")
        .select("conv_id", F.col("turn").alias("branch"), "above", F.array("parent", "turn").alias("prefix"))
    )
    branches = materialize(branches, "branches")
    while not branches.filter(F.col("above").isNotNull()).isEmpty():
        upper = branches.select(
            F.col("conv_id").alias("_c"), F.col("branch").alias("_b"), F.col("above").alias("_above"), F.col("prefix").alias("_prefix")
        )
        branches = (
            branches.join(upper, (F.col("conv_id") == F.col("_c")) & (F.col("above") == F.col("_b")), "left")
            .select("conv_id", "branch", F.col("_above").alias("above"), F.when(F.col("_prefix").isNotNull(), F.concat("_prefix", "prefix")).otherwise(F.col("prefix")).alias("prefix"))
        )
        branches = materialize(branches, "branches")
    known = branches.select(F.col("conv_id").alias("_c"), F.col("branch").alias("_b"), "prefix")
    return turns.join(known, (F.col("conv_id") == F.col("_c")) & (F.col("branch") == F.col("_b")), "left").select(
        "conv_id", "turn", F.concat(F.coalesce("prefix", F.array().cast("array<long>")), F.array("turn")).alias("reply_path")
    )
