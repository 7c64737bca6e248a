"""Conversations in reply order, linked by what their messages quote.

A message's lines carry quote levels (one for each > before them). Consecutive lines
of a level are a passage; passages and their lines are normalised and hashed. So is
each run of words of the messages' own texts that is as long as some quote in the
conversation, so that any part of a message is found, however its lines are wrapped.
Quotes find the message that first wrote the passage by a join on conversation and
hash; a message answers the one from which it quotes most at the shallowest level that
is found. What quotes nothing that is found answers the turn before it, the one with
the next smaller number.

So the messages of a conversation are a tree, and their order is that of reading it:
each message is followed by what answers it, the earliest answer and all below it
first. Runs of messages that answer each the one before are chains; a chain's place
follows from a ranking of the list that walks around the tree of chains, by doubling
of pointers, in rounds that grow with the logarithm of the chains.

Originals are aggregated to one row per conversation and hash before the join, so
that a passage that very many messages hold costs a row for each quote, not a row for
each pair. A conversation is never gathered in one place: turns are sorted by ranges,
and what one range needs of those before it is a row for each range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, settle
from .shingles import mixed

QUOTED = re.compile(r"^((?:[ \t]?>)+)[ \t]?(.*)$")
#: A line that says who wrote what is quoted below it.
ATTRIBUTION = re.compile(r"^(?:(?:On|Am|Le|El)\b.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\s*:|-{2,} ?Original Message ?-{2,}|\S.{0,80}\b(?:wrote|schrieb|a écrit|escribió)\s*:)\s*$", re.I)
#: Parts into which the messages of a conversation are dealt when they are told the lengths of its quotes.
PARTS = 64
#: Base of the words' polynomial hash, odd, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def normalised(text: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", "", text.lower()).split())


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)]), dtype=np.uint64)[:n]


def runs(words: list[str], sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, the hashes of all runs of so many words."""
    n = len(words)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(BASE, n), dtype=np.uint64)])
    back = _powers(INVERSE, n)
    for size in sizes:
        if 0 < size <= n:
            yield size, mixed((total[size:] - total[:-size]) * back[: n - size + 1] + np.uint64(size)).view(np.int64)


def _quote(level: int, text: str, weight: int) -> dict:
    words = normalised(text).split()
    ((size, found),) = runs(words, [len(words)])
    return {"level": level, "hash": int(found[0]), "weight": weight, "size": size}


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes and attributions, and the quoted passages with their levels."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    open_level = 0
    for line in (text or "").split("\n"):
        m = QUOTED.match(line)
        level = m[1].count(">") if m else 0
        if level:
            while own and not own[-1].strip():
                own.pop()
            if own and ATTRIBUTION.match(own[-1].strip()):
                own.pop()
            body = m[2]
            if ATTRIBUTION.match(body.strip()):
                open_level = 0
                continue
            if open_level == level:
                passages[-1][1].append(body)
            else:
                passages.append((level, [body]))
        else:
            own.append(line)
        open_level = level
    return "\n".join(own).strip(), [(level, "\n".join(lines)) for level, lines in passages if normalised("\n".join(lines))]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, levels, quotes = [], [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            own, passages = parse(text)
            texts.append(None if text is None else own)
            levels.append(max((level for level, _ in passages), default=0))
            found = []
            for level, passage in passages:
                lines = [x for x in passage.split("\n") if normalised(x)]
                found.append(_quote(level, passage, 2 * len(passage)))
                if len(lines) > 1:
                    found += [_quote(level, x, len(x)) for x in lines]
            quotes.append(found)
        struct = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("weight", pa.int64()), ("size", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(levels, pa.int32()), pa.array(quotes, struct)],
            names=["conv_id", "turn", "role", "text", "levels", "quotes"],
        )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turn, hash) of the distinct runs of words of each own text, of the sizes in its last column."""
    for batch in batches:
        for conv, turn, text, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for _, found in runs(normalised(text).split(), sizes):
                found = np.unique(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), conv)), pa.array(np.full(len(found), turn)), pa.array(found)], names=["conv_id", "turn", "hash"])


def _sorted(df: DataFrame, *order: str) -> DataFrame:
    """df, settled in ranges of that order, with the number `part` of each row's range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


def _before(ranges: DataFrame, order: list[str], value: Column) -> DataFrame:
    """What _sorted gave, with `before`: value in the row before, whatever its range, or null in the first."""
    with_value = ranges.withColumn("value", value)
    last = with_value.groupBy("part").agg(F.max_by("value", F.struct(*order)).alias("last"))
    # a row for each range, which are as many as the shuffle partitions
    carried = last.select("part", F.lag("last").over(Window.orderBy("part")).alias("carried"))
    here = with_value.withColumn("before", F.lag("value").over(Window.partitionBy("part").orderBy(*order)))
    return here.join(carried, "part").withColumn("before", F.coalesce("before", "carried")).drop("carried", "value")


def _chains(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, k, chain): the place k of each turn in its conversation, and that of the first turn of its chain; replies are sorted and say which turn opens one."""
    own = Window.partitionBy("part", "conv_id").orderBy("turn")
    local = replies.withColumn("i", F.row_number().over(own) - 1)
    local = local.withColumn("at", F.max(F.when(F.col("opens"), F.col("i"))).over(own))
    by_part = local.groupBy("part", "conv_id").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    by_part = by_part.withColumn("carried", F.max(F.col("first") + F.col("last")).over(earlier)).select("part", "conv_id", "first", "carried")
    placed = local.join(by_part, ["part", "conv_id"])
    return placed.select("conv_id", "turn", (F.col("first") + F.col("i")).alias("k"), F.coalesce(F.col("first") + F.col("at"), "carried").alias("chain"), "reply_to", "quoted", "n_linked")


def _places(turns: DataFrame) -> DataFrame:
    """(conv_id, chain, start, deep): where each chain that is not the first of a conversation with others stands, and how deep."""
    lengths = turns.groupBy("conv_id", "chain").agg(F.count("*").alias("n"))
    opened = turns.where("k = chain and reply_to is not null").select("conv_id", "chain", F.col("reply_to").alias("turn"))
    up = turns.select("conv_id", "turn", F.col("k").alias("at"), F.col("chain").alias("up"))
    # a chain that answers a later message of its parent comes first, since what it answers is followed by the rest of the parent
    under = opened.join(up, ["conv_id", "turn"]).select("conv_id", "chain", "up", (-F.col("at")).alias("by"))
    ranges = _sorted(under, "conv_id", "up", "by", "chain")
    children = settle(_before(ranges, ["conv_id", "up", "by", "chain"], F.struct("conv_id", "up", "chain")))
    release(ranges)
    some = children.select("conv_id").distinct()
    chains = lengths.join(some, "conv_id", "left_semi").join(children.select("conv_id", "chain", "up", "by"), ["conv_id", "chain"], "left")
    # elements of the list: 2k enters the chain k, 2k + 1 leaves it; n counts turns and step the depth that a chain adds
    step = F.coalesce(1 - F.col("by") - F.col("up"), F.lit(0))
    sibling = (F.col("before.conv_id") == F.col("conv_id")) & (F.col("before.up") == F.col("up"))
    after = F.when(F.coalesce(sibling, F.lit(False)), 2 * F.col("before.chain") + 1).otherwise(2 * F.col("up"))
    pointers = children.select("conv_id", after.alias("e"), (2 * F.col("chain")).alias("to"))
    enter = chains.select("conv_id", (2 * F.col("chain")).alias("e"), F.col("n").alias("w"), step.alias("d"), (2 * F.col("chain") + 1).alias("rest"))
    leave = chains.select("conv_id", (2 * F.col("chain") + 1).alias("e"), F.lit(0).cast("long").alias("w"), (-step).alias("d"), (2 * F.col("up") + 1).alias("rest"))
    current = settle(enter.unionByName(leave).join(pointers, ["conv_id", "e"], "left").select("conv_id", "e", "w", "d", F.coalesce("to", "rest").alias("next"), F.col("d").alias("own")))
    while not current.where("next is not null").isEmpty():
        ahead = current.select("conv_id", F.col("e").alias("next"), F.col("w").alias("w2"), F.col("d").alias("d2"), F.col("next").alias("next2"))
        joined = current.join(ahead, ["conv_id", "next"], "left")
        more = joined.select("conv_id", "e", (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.col("next2").alias("next"), "own")
        before, current = current, settle(more)
        release(before)
    total = current.where("e = 0").select("conv_id", F.col("w").alias("total"))
    found = current.where("e % 2 = 0").join(total, "conv_id")
    out = settle(found.select("conv_id", F.expr("e div 2").alias("chain"), (F.col("total") - F.col("w")).alias("start"), (F.col("own") - F.col("d")).alias("deep")))
    release(current, children)
    return out


def link(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text (without quotes), levels, n_quotes, n_linked, reply_to, quoted, depth, position.

    levels is the deepest quote level; n_quotes counts the passages and lines that are
    looked up and n_linked those found in an earlier turn; reply_to is the turn that the
    message answers (null for the first one), quoted says that a quote found it, depth
    counts the answers from the first message to it, and position is its place in the
    conversation's reply order, from 0. A passage that several messages hold is the
    first one's; of equally good originals the latest counts. Turns may have gaps. A
    null text stays null and quotes nothing; an empty one stays empty; very long ones are
    read whole. A message with a null conversation or turn links with nothing and has no
    position. Repeated rows stay and have the same links and place. An empty table gives
    no rows. Other columns are not read.
    """
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    schema = "conv_id long, turn long, role string, text string, levels int, quotes array<struct<level:int,hash:long,weight:long,size:int>>"
    parsed = settle(rows.mapInArrow(_parsed, schema))
    quotes = parsed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.hash", "q.weight", "q.size").distinct()
    wanted = quotes.select("conv_id", "hash").distinct()
    sizes = quotes.groupBy("conv_id").agg(F.sort_array(F.collect_set("size")).alias("sizes")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    told = parsed.where("text is not null and conv_id is not null and turn is not null").withColumn("part", F.pmod("turn", F.lit(PARTS)).cast("int")).join(sizes, ["conv_id", "part"])
    originals = told.select("conv_id", "turn", "text", "sizes").mapInArrow(_runs, "conv_id long, turn long, hash long")
    first = originals.join(wanted, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    found = quotes.join(first, ["conv_id", "hash"]).where("original < turn")
    weighed = found.groupBy("conv_id", "turn", "original").agg(F.min("level").alias("level"), F.sum("weight").alias("weight"), F.count("*").alias("n"))
    best = weighed.groupBy("conv_id", "turn").agg(F.max_by("original", F.struct((-F.col("level")).alias("l"), "weight", "original")).alias("by_quote"), F.sum("n").alias("n_linked"))

    ranges = _sorted(parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct(), "conv_id", "turn")
    prior = F.when(F.col("before.conv_id") == F.col("conv_id"), F.col("before.turn"))
    turns = _before(ranges, ["conv_id", "turn"], F.struct("conv_id", "turn")).withColumn("prior", prior).drop("before").join(best, ["conv_id", "turn"], "left")
    reply_to = F.coalesce("by_quote", "prior")
    replies = turns.select("part", "conv_id", "turn", reply_to.alias("reply_to"), F.col("by_quote").isNotNull().alias("quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), (F.col("prior").isNull() | (reply_to != F.col("prior"))).alias("opens"))
    chained = settle(_chains(replies))
    release(ranges)
    places = _places(chained)
    ordered = chained.join(places, ["conv_id", "chain"], "left").select(
        "conv_id", "turn", "reply_to", "quoted", "n_linked", *[(F.coalesce(x, F.lit(0)) + F.col("k") - F.col("chain")).cast("long").alias(name) for x, name in (("deep", "depth"), ("start", "position"))]
    )
    done = settle(parsed.join(ordered, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "levels", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to", F.coalesce("quoted", F.lit(False)).alias("quoted"), "depth", "position",
    ))
    release(parsed, chained, places)
    return done
