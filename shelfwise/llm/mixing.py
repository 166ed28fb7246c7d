"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of documents. While all sources last, block j of a source with weight w may not start
before slot floor(j / w) and has to be done by slot ceil((j + 1) / w). A source that runs out leaves the mix and the
weights of those left are scaled up to one, so that the bounds of later blocks follow the new weights. Taking the
eligible block with the earliest deadline fills every slot, every block has its slot, and no source is ever a whole
block away from its share. Weights are exact rationals; nothing is rounded to a period. Sources of weight zero come
when all others have run out, in proportion to their supply. Of very many sources those alike in supply and weight are one
class, whose members get the same bounds and follow one another; each of them still has its own share.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.session import drop, fits, partitions, settle

BLOCK = 16
#: Slots of a period of ``shares``; twice the sources if those are more. A schedule has no period.
PERIOD = 1_000
#: Sources that are held one by one; of more, classes of those alike are held.
MAX_SOURCES = 100_000
#: Members of a class in one row of a timetable.
ROW_MEMBERS = 65_536
#: Blocks whose slots are broadcast; beyond, the same join shuffles.
BROADCAST_BLOCKS = 500_000
#: Documents of a source are numbered in so many separate runs.
RUNS = 256


def shares(weights: Mapping[str, float], period: int | None = None) -> dict[str, int]:
    """Slots a period of each source: at least one, largest remainders first, ``period`` together."""
    period = max(PERIOD, 2 * len(weights)) if period is None else period
    total = sum(weights.values())
    if not weights or total <= 0 or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    if len(weights) > period:
        raise ValueError(f"more than {period} sources")
    spare = period - len(weights)
    exact = {s: spare * w / total for s, w in weights.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def _phases(blocks: Mapping[str, int], weights: Mapping[str, float], members: Mapping[str, int]) -> tuple[dict[str, int], list[tuple[int, int, int, int]]]:
    """Weights as integers, and a row for each class of sources in the order in which they run out: blocks and weight of a
    member, the blocks of all that ran out before and the weights of all that are left."""
    exact = {s: Fraction(str(weights[s])) for s in blocks}  # 0.1 is a tenth
    if not exact or min(exact.values()) <= 0:
        raise ValueError("weights must be positive")
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    done, left, rows = 0, sum(whole[s] * members[s] for s in blocks), []
    for s in sorted(blocks, key=lambda s: (Fraction(blocks[s], whole[s]), s)):
        rows.append((blocks[s], whole[s], done, left))
        done, left = done + blocks[s] * members[s], left - whole[s] * members[s]
    return whole, rows


def timetable(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of all blocks by slot, earliest deadline first; sources whose weight is
    zero or not given come last.

    Memory grows with the sources, not with the blocks.
    """
    for row in runs(blocks, weights, dict.fromkeys(blocks, 1)):
        yield row[:5]


def runs(blocks: Mapping[str, int], weights: Mapping[str, float], members: Mapping[str, int]) -> Iterator[tuple[str, int, int, int, int, int, int]]:
    """(class, block, release, deadline, slot, member, count): a timetable of classes of sources that have the same blocks and
    the same weight. From ``slot`` on ``count`` members, from ``member`` on, have that block of theirs one after another.

    Memory grows with the classes, steps with the blocks of one member of each.
    """
    given = {s: weights.get(s, 0) for s in blocks}
    if min(given.values(), default=0) < 0:
        raise ValueError("weights must not be negative")
    mixed = {s: n for s, n in blocks.items() if given[s] > 0}
    rest = {s: n for s, n in blocks.items() if given[s] == 0 and n > 0}
    if mixed:
        yield from _mixed(mixed, given, members)
    if rest:
        start = sum(n * members[s] for s, n in mixed.items())
        for s, j, release, deadline, slot, member, count in _mixed(rest, rest, members):
            yield s, j, start + release, start + deadline, start + slot, member, count


def _mixed(blocks: Mapping[str, int], weights: Mapping[str, float], members: Mapping[str, int]) -> Iterator[tuple[str, int, int, int, int, int, int]]:
    """The timetable of classes with positive weights."""
    whole, rows = _phases(blocks, weights, members)
    phase = dict.fromkeys(blocks, 0)

    def bound(s: str, j: int) -> tuple[int, int]:
        """Floor and ceiling of the time at which a member of ``s`` has had ``j`` blocks if slots were shared out evenly."""
        w, p = whole[s], phase[s]
        while j * rows[p][1] > rows[p][0] * w:
            p += 1
        phase[s] = p
        q, rest = divmod(rows[p][3] * j, w)
        return rows[p][2] + q, rows[p][2] + q + (rest > 0)

    waiting = [(0, s, 0) for s in sorted(blocks) if blocks[s]]  # release, class, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int, int]] = []  # deadline, class, block, release, members that had it
    slot, slots = 0, sum(n * members[s] for s, n in blocks.items())
    while slot < slots:
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            after, deadline = bound(s, j + 1)
            heapq.heappush(ready, (deadline, s, j, release, 0))
            if j + 1 < blocks[s]:
                heapq.heappush(waiting, (after, s, j + 1))
        deadline, s, j, release, had = heapq.heappop(ready)
        count = min(members[s] - had, ROW_MEMBERS, waiting[0][0] - slot if waiting else slots)
        if deadline < slot + count:
            raise AssertionError("a deadline is missed")
        yield s, j, release, deadline, slot, had, count
        if had + count < members[s]:
            heapq.heappush(ready, (deadline, s, j, release, had + count))
        slot += count


def one_period(share: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """The timetable of ``share`` blocks a source, weighted by ``share``."""
    return list(timetable(share, share))


def supply(docs: DataFrame) -> DataFrame:
    """(s, n): documents of each source; a null source counts as the empty name."""
    return docs.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.count("*").alias("n"))


def labelled(docs: DataFrame, weights: Mapping[str, float] | None, power: float, most: int = MAX_SOURCES) -> tuple[DataFrame | None, dict[str, int], dict[str, float], dict[str, int]]:
    """(label and member of each source, documents and weight of a member of each label, members of each label).

    A label is a source; no table is needed then. Of more than ``most`` sources a label is a class of all those that have
    the same number of documents and the same weight, and they are its members.
    """
    spark = docs.sparkSession
    counts = supply(docs)
    if weights is None:
        counts = counts.withColumn("w", F.lit(0.0))  # it goes by the supply
    else:
        given = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "s string, w double")
        counts = counts.join(given, "s", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    counts = settle(counts, "sources")
    if fits(counts, most):
        found = counts.collect()
        drop(counts)
        names, members = {r: r.s for r in found}, dict.fromkeys((r.s for r in found), 1)
        sources = None
    else:
        label = F.concat_ws(":", "n", "w").alias("label")
        found = counts.groupBy(label, "n", "w").agg(F.count("*").alias("members")).collect()
        names, members = {r: r.label for r in found}, {r.label: r.members for r in found}
        sources = ranked(counts.select(F.col("s").alias("source"), label), "label", "source").withColumnRenamed("n", "member")
    supplied = {names[r]: r.n for r in found}
    if weights is None:
        return sources, supplied, tempered(supplied, power), members
    return sources, supplied, {names[r]: weights.get(r.s, 0) if sources is None else r.w for r in found}, members


def tempered(counts: Mapping[str, int], power: float = 0.5) -> dict[str, float]:
    """Weights that lift small sources: shares of the supply to a power."""
    return {s: n**power for s, n in counts.items()}


def ranked(rows: DataFrame, of: str, by: str, more: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``n``, each one's number within ``of``, from 0, in an order that mixes ``by``, and with what ``more`` has
    of each ``of``.

    They are numbered in runs by hash, whose counts are summed up, so an ``of`` with a third of all rows is
    still the work of many tasks.
    """
    rows = rows.withColumn("h", F.xxhash64(by)).withColumn("run", F.shiftright(F.col("h"), 56).cast("int") + RUNS // 2)
    sizes = rows.groupBy(of, "run").agg(F.count("*").alias("size"))
    offset = sizes.withColumn("before", F.sum("size").over(Window.partitionBy(of).orderBy("run").rowsBetween(Window.unboundedPreceding, -1))).drop("size")
    offset = offset.join(more, of) if more is not None else offset
    inside = rows.withColumn("k", F.row_number().over(Window.partitionBy(of, "run").orderBy("h", by)) - 1)
    return inside.join(offset, [of, "run"]).withColumn("n", F.coalesce("before", F.lit(0)) + F.col("k")).drop("h", "run", "k", "before")


def schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, power: float = 0.5, most: int = MAX_SOURCES) -> DataFrame:
    """Every document's place in the mix.

    Columns: doc_id, source, block (of its source, from 0), release and deadline (slots), slot, position (over
    all slots, in documents) and in_mix: whether all sources are still in the mix at that slot. Later slots
    are shared by the sources that are left, in proportion to their weights. Without ``weights``, sources weigh by
    their supply to ``power``; sources that given ``weights`` lack, or give zero, come after all others. A null source
    counts as the empty name, other columns are ignored; every row gets a place, repeated rows one each.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    sources, counts, given, members = labelled(docs, weights, power, most)
    if not counts:
        return spark.createDataFrame([], "doc_id long, source string, block long, release long, deadline long, slot long, position long, in_mix boolean")
    blocks = {s: -(-n // block) for s, n in counts.items()}
    mixed = {s: n for s, n in blocks.items() if given[s] > 0}
    size, weight, _, total = _phases(mixed, given, members)[1][0] if mixed else (0, 1, 0, 0)
    horizon = total * size // weight  # the first source runs out here
    rows = ranked(docs, "source", "doc_id", sources).withColumn("block", F.expr(f"n div {block}"))
    table = _table(spark, blocks, given, members)
    if sources is None:
        rows, table, keys = rows.withColumn("label", F.col("source")), table.drop("member", "count"), ["label", "block"]
    else:
        keys = ["label", "block", "member"]
        table = table.repartition(partitions(spark)).select("*", F.posexplode(F.sequence(F.lit(0), F.col("count").cast("int") - 1)))
        table = table.select("label", "block", "release", "deadline", (F.col("slot") + F.col("pos")).alias("slot"), (F.col("member") + F.col("pos")).alias("member"))
    few = sum(n * members[s] for s, n in blocks.items()) <= BROADCAST_BLOCKS
    placed = rows.join(F.broadcast(table) if few else table, keys)
    return placed.select("doc_id", "source", "block", "release", "deadline", "slot", (F.col("slot") * block + F.col("n") % block).alias("position"), (F.col("slot") < horizon).alias("in_mix"))


def _table(spark: SparkSession, blocks: Mapping[str, int], weights: Mapping[str, float], members: Mapping[str, int]) -> DataFrame:
    """The timetable as rows, written by one task as it goes: a sixteenth as many steps as there are documents, fewer where
    classes have several members."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                steps = runs(blocks, weights, members)
                while part := list(itertools.islice(steps, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*part, strict=True)], ["label", "block", "release", "deadline", "slot", "member", "count"])

    return spark.range(0, 1, 1, 1).mapInArrow(write, "label string, block long, release long, deadline long, slot long, member long, count long")
