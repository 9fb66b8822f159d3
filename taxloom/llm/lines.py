"""Line deduplication by a fixed-depth tree of log templates."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.llm.common import cut, discard, shuffle_partitions, stored

DEPTH = 3
HELD_LINES = 2000
BROADCAST_ROWS = 100_000
SIMILARITY = 0.7
MIN_DOCS = 10
LONG_WORDS = 50
WILD = "<*>"
BITS = 24


def templates(lines: list[str], similarity: float = SIMILARITY) -> list[int]:
    """For masked lines of one token count, each with its number of the template it belongs to: that of its first line.

    A line joins the template with which it shares most tokens, if that is ``similarity`` of all of them (wildcards
    don't count; ties: the older one), and where they differ the template gets a wildcard; else it starts a template.
    """
    codes: dict[str, int] = {WILD: 0}
    rows = np.array([[codes.setdefault(t, len(codes)) for t in line.split(" ")] for line in lines], np.int64)
    need = similarity * rows.shape[1]
    known = np.empty_like(rows)
    heads: list[int] = []
    out = []
    for i, row in enumerate(rows):
        n = len(heads)
        best = -1
        if n:
            same = ((known[:n] == row) & (row != 0)).sum(axis=1)
            best = int(same.argmax())
            if same[best] < need:
                best = -1
        if best < 0:
            known[n] = row
            heads.append(i)
            out.append(i)
        else:
            known[best][known[best] != row] = 0
            out.append(heads[best])
    return out


class Parser:
    """:func:`templates` for the lines of a leaf of any size, one by one; only the templates are held.

    Of a line that a template takes, at most ``miss`` tokens differ. With positions dealt to ``miss + 1`` groups, one
    group at least agrees in full, so only templates with an equal group are compared; the result is the same.
    """

    def __init__(self, width: int, similarity: float):
        self.need = similarity * width
        self.groups = width - max(0, math.ceil(self.need)) + 1
        self.codes: dict[str, int] = {WILD: 0}
        self.known = np.empty((64, width), np.int32)
        self.n = 0
        self.at: dict[tuple[int, bytes], list[int]] = {}

    def add(self, line: str) -> int:
        """The number of the line's template."""
        row = np.array([self.codes.setdefault(t, len(self.codes)) for t in line.split(" ")], np.int32)
        keys = [(g, part.tobytes()) for g in range(self.groups) if (part := row[g :: self.groups]).all()]
        near = sorted(set().union(*(self.at.get(k, ()) for k in keys)))
        if near:
            same = ((self.known[near] == row) & (row != 0)).sum(axis=1)
            at = int(same.argmax())
            if same[at] >= self.need:
                best = near[at]
                self.known[best][self.known[best] != row] = 0
                return best
        if self.n == len(self.known):
            self.known = np.concatenate([self.known, np.empty_like(self.known)])
        self.known[self.n] = row
        for k in keys:
            self.at.setdefault(k, []).append(self.n)
        self.n += 1
        return self.n - 1


def _assigned(masked: DataFrame, similarity: float) -> DataFrame:
    """(leaf, masked hash, template) for distinct masked lines (leaf, m, line), streaming through each leaf in order.

    A leaf of more than ``HELD_LINES`` lines goes through a :class:`Parser`, with the same result.
    """

    def parse(batches):
        leaf, held, parser, heads = None, [], None, []

        def flush():
            if parser:
                found = []
                for m, line in held:
                    t = parser.add(line)
                    if t == len(heads):
                        heads.append(m)
                    found.append(heads[t])
            else:
                found = [held[i][0] for i in (templates([x for _, x in held], similarity) if len(held) > 1 else [0])]
            return pa.RecordBatch.from_arrays(
                [pa.array([leaf] * len(held), pa.int64()), pa.array([m for m, _ in held], pa.int64()), pa.array(found, pa.int64())], names=["leaf", "m", "template"]
            )

        done, size = [], 0
        for batch in batches:
            for key, m, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != leaf or len(held) > HELD_LINES:
                    if key == leaf and not parser:
                        parser = Parser(line.count(" ") + 1, similarity)
                    if held:
                        done.append(flush())
                        size += len(held)
                        if size >= 4096:
                            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                            done, size = [], 0
                    if key != leaf:
                        leaf, parser, heads = key, None, []
                    held = []
                held.append((m, line))
        if held:
            done.append(flush())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]

    n = shuffle_partitions(masked.sparkSession)
    ordered = masked.select("leaf", "m", "line").repartition(n, "leaf").sortWithinPartitions("leaf", "line")
    return ordered.mapInArrow(parse, "leaf long, m long, template long")


def _leaf(line: Column, depth: int) -> Column:
    """The tree's leaf: the number of tokens and the first ``depth`` of them."""
    tokens = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.xxhash64(tokens, F.substring_index(line, " ", depth))


def _prepared(text: Column, depth: int, long_words: int) -> Column:
    """The text's lines as structs (line, leaf, full): single spaces, tokens that hold a digit masked, and the tree's leaf.

    ``full`` is the hash of a line of ``long_words`` tokens or more as it is without the mask, else null.

    Spaces and digits are looked for in the whole text first, as most texts need neither step. A token is only tried
    from its start and nothing is given back, so long ones take linear time.
    """
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in ("  ", "\t", "\r", "\f", "\v")])
    spaced = F.when(odd, F.regexp_replace(text, r"[^\S\n]+", " ")).otherwise(text)
    masked = F.when(text.rlike("[0-9]"), F.regexp_replace(spaced, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", WILD)).otherwise(spaced)
    both = F.zip_with(F.split(masked, "\n"), F.split(spaced, "\n"), lambda x, y: F.struct(F.trim(x).alias("line"), F.trim(y).alias("own")))

    def full(x: Column) -> Column:
        return F.when(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) >= long_words - 1, F.xxhash64(x))

    return F.transform(both, lambda x: F.struct(x["line"].alias("line"), _leaf(x["line"], depth).alias("leaf"), full(x["own"]).alias("full")))


def _in_bitmap(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """The lines whose leaf may be among the leaves, by a bitmap of 2**BITS hash slots: 2 MiB, however many leaves."""
    slot = F.pmod("leaf", F.lit(1 << BITS)) + 1
    bitmap = leaves.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast(at div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    there = lines.withColumn("bucket", F.bitmap_bucket_number(slot)).withColumn("at", at).join(F.broadcast(bitmap), "bucket")
    return there.filter(F.getbit(byte, F.expr("cast(at % 8 as int)")) == 1).select(*lines.columns)


def drop_recurring_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS
) -> DataFrame:
    """Drop lines whose template recurs in ``min_docs`` documents or more; the document with the smallest id keeps them.

    A line of ``long_words`` tokens or more says enough by itself: if it stands in two documents or more, word for word
    and digit for digit, it goes in all but the one with the smallest id.

    A line's tokens are its runs of other than white space; tokens with a digit are variable and masked. The tree has
    a level for the number of tokens and one for each of the first ``depth`` tokens. Within a leaf, lines that share
    ``similarity`` of their tokens have one template, whatever the leaf's size. Leaves that occur in one document only
    can't recur; their lines go no further.

    Returns id, ``n_lines``, ``n_dropped``, ``text`` (the lines that stay, joined by newlines) and, unchanged, all
    other columns but ones with those names.

    Blank lines stay. Null text stays null with 0 lines. Rows that repeat an id are one document as to recurrence.
    Rows with a null id keep all their lines and count for no template. A text of which nothing stays becomes empty.
    """
    own = [id_col.lower(), text_col.lower(), "n_lines", "n_dropped"]
    rest = [c for c in docs.columns if c.lower() not in own]
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")).alias("rest")
    ).withColumn("mark", F.xxhash64("text"))
    exploded = rows.filter("id is not null and text is not null").select("id", "mark", F.posexplode(_prepared(F.col("text"), depth, long_words)).alias("pos", "x"))
    lines = exploded.select("id", "mark", "pos", "x.line", "x.leaf", "x.full").filter("line != ''")
    shared = cut(lines.groupBy("leaf").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a != b").select("leaf"))
    again = stored(_in_bitmap(lines, shared).join(shared, "leaf").withColumn("m", F.xxhash64("line")), "lines")

    masked = again.groupBy("leaf", "m").agg(F.first("line").alias("line"))
    found = cut(_assigned(masked, similarity).select("m", F.xxhash64("leaf", "template").alias("template")))

    by_template = again.select("id", "mark", "pos", "m").join(found, "m").select("id", "mark", "pos", "template", F.lit(int(min_docs)).alias("least"))
    in_full = again.filter("full is not null").select("id", "mark", "pos", F.xxhash64("full", F.lit("full")).alias("template"), F.lit(min(2, int(min_docs))).alias("least"))
    used = cut(by_template.unionByName(in_full))
    discard(again)
    users = used.select("template", "least", "id").distinct().groupBy("template", "least").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    recurring = cut(users.filter("n >= least").select("template", "least", "first"))  # by itself, so that a join with a hot template can be split
    few = recurring.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = used.join(F.broadcast(recurring) if few else recurring, ["template", "least"])
    dropped = met.filter("id > first").groupBy("id", "mark").agg(F.collect_set("pos").alias("gone"))

    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.coalesce("gone", F.array().cast("array<int>"))), lambda i: F.get(F.col("parts"), i))
    out = rows.join(dropped, ["id", "mark"], "left").withColumn("parts", F.split("text", "\n"))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("parts")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(text_col),
        *[F.col("rest")[c].alias(c) for c in rest],
    )
