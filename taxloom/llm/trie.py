"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours, in descending depth."""

from __future__ import annotations

import dataclasses
import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxloom.llm.common import BROADCAST_ROWS, cut, give_back, prefix_sums, shuffle_partitions

WIDTH = 16
SPAN = 256
ROWS = 50_000
CHUNK = 4096
WORD = r"[^ \t\n\x0B\f\r]+"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

#: What a partition's forest gives: finished nodes; ``open`` ones, which go on in other partitions; and with ``ids`` pieces of open nodes' ends.
NODE = "name binary, above binary, grp binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, shared long, upto_above long, ends_sha256 string, open boolean, part long, chunk long, ids string"


_KINDS = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
ARROW_NODE = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in NODE.split(", ")])


def _name(*parts: Column) -> Column:
    """The first 128 bits of the SHA-256 of what the parts give together."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 2 * WIDTH))


def numbered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, name, words, upto): every turn's place from 1, a digest of (role, text), its words and those up to it.

    Turns are in order of turn (null first), then role, then the digest, so equal places have a fixed order; null role or
    text is empty, and rows that are repeated are turns of their own. Rows without a conversation take no part. One
    range partitioning numbers all turns, so that a conversation with very many of them is not one task.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        _name(F.length(role).cast("string"), F.lit(":"), role, text).alias("name"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    summed = cut(prefix_sums(rows, ["conv_id", "turn", "role", "name"], "words").select("conv_id", "name", "words", "before", "index"))
    firsts = summed.groupBy("conv_id").agg(F.min("index").alias("first"), F.min("before").alias("start"))
    return summed.join(firsts, "conv_id").select("conv_id", (F.col("index") - F.col("first") + 1).alias("depth"), "name", "words", (F.col("before") - F.col("start") + F.col("words")).alias("upto"))


def spliced(turns: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Give conversations the opening of their block's first one: (turns, conversations).

    With h the unsigned CRC-32 of the decimal id modulo ``most``, a conversation's first h turns are replaced by the first h turns of
    conversation ``id - id % block`` (all, if it has fewer; none, if there is none). A conversation that is left
    without turns stays among the conversations (conv_id, n_turns).
    """
    head = turns.filter(F.col("depth") < most)
    sizes = turns.groupBy("conv_id").agg(F.max("depth").alias("n"))
    heads = head.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "name", "words", "upto"))).alias("head"))  # of most - 1 turns at most
    own = sizes.join(heads, "conv_id").withColumn("h", F.crc32(F.col("conv_id").cast("string")) % most).withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    base = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("opening"))
    upto = lambda a: F.coalesce(F.get(a, F.size(a) - 1).getField("upto"), F.lit(0))
    taken = F.slice(F.coalesce("opening", F.expr("array()")), 1, F.col("h").cast("int"))
    plan = own.join(base, "base", "left").withColumn("opening", taken).withColumn("lost", F.slice("head", 1, F.col("h").cast("int")))
    plan = cut(plan.select("conv_id", "n", "h", "opening", F.size("opening").cast("long").alias("kept"), (upto(F.col("opening")) - upto(F.col("lost"))).alias("shift")))
    opened = plan.select("conv_id", F.explode("opening").alias("t")).select("conv_id", "t.*")
    rest = turns.join(plan.select("conv_id", "h", "kept", "shift"), "conv_id").filter("depth > h")
    rest = rest.select("conv_id", (F.col("depth") - F.col("h") + F.col("kept")).alias("depth"), "name", "words", (F.col("upto") + F.col("shift")).alias("upto"))
    return opened.unionByName(rest), plan.select("conv_id", (F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))


@dataclasses.dataclass(slots=True)
class _Component:
    """Rows first to last; the node at depth ``low`` has ``kids`` children, every node above it up to the parent one."""

    low: int
    first: int
    last: int
    n: int
    least: int
    shared: int
    leaves: int
    kids: int


class _Forest:
    """The trie of one partition's sorted rows, as far as the partition can tell.

    A row is a conversation or a contracted group: its key of names, the words up to each depth, and what it counts for.
    Every row begins as a component of its own that reaches down to its last turn. Edges between neighbours are taken
    by descending common prefix; a merge at depth d makes the branching node of depth d. The depths between that node and
    a component's own lowest one have the component's members each, and are its chain.

    A node has the same members as a component: their number, smallest id and leaves are sums over rows, and what prefix
    sharing saves below it is the sum of the words in its edges' common prefixes, less for every member but one the words
    above the node. All of these add up across partitions, so a node that may go on beyond the partition's first or last row
    is given out as an open part, named by its prefix.
    """

    def __init__(self, rows: list[dict], offset: int, before: int, after: int) -> None:
        self.rows, self.offset, self.before, self.after = rows, offset, before, after
        self.out: list[tuple] = []
        self.names: dict[tuple[bool, int], bytes] = {}
        n = len(rows)
        self.meets = [before, *(self._common(rows[i - 1], rows[i]) for i in range(1, n)), after]
        self.root = list(range(n))
        self.parts: dict[int, _Component] = {}
        for i, r in enumerate(rows):
            low = len(r["key"]) // WIDTH
            leaves = r["leaves"] if r["goes_on"] else int(low > self.meets[i + 1])
            self.parts[i] = _Component(low, i, i, r["n"], r["least"], r["shared"], leaves, r["kids"])

    @staticmethod
    def _common(a: dict, b: dict) -> int:
        """Turns that two rows share from the start; -1 if they are of different groups."""
        if a["grp"] != b["grp"]:
            return -1
        x, y = a["key"], b["key"]
        low, high = 0, min(len(x), len(y)) // WIDTH
        while low < high:
            mid = (low + high + 1) // 2
            if x[: mid * WIDTH] == y[: mid * WIDTH]:
                low = mid
            else:
                high = mid - 1
        return low

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def _open(self, c: _Component, depth: int) -> bytes | None:
        """The name of a component's node at a depth, if it goes on before the first row or after the last one."""
        left = c.first == 0 and depth <= self.before
        if not left and not (c.last == len(self.rows) - 1 and depth <= self.after):
            return None
        if (left, depth) not in self.names:
            r = self.rows[0 if left else -1]
            self.names[left, depth] = hashlib.sha256(r["grp"] + r["key"][: depth * WIDTH]).digest()[:WIDTH]
        return self.names[left, depth]

    def _emit(self, c: _Component, depth: int, parent: _Component | None) -> None:
        """Give out the node of a component at a depth; where its parent is open, with the parent's name for its id."""
        name, above = self._open(c, depth), parent and self._open(parent, depth - 1)
        up = None if parent is None or above else parent.least
        if depth == 1 and self.offset:  # the parent ends the level above
            above, up = None, self.rows[c.first]["up"]
        upto, kids, shared, ids = self.rows[c.first]["upto"], 1, c.shared, []
        if depth == c.low:
            kids = c.kids
            for i in range(c.first, c.last + 1):
                r = self.rows[i]
                if r["goes_on"] or len(r["key"]) != depth * WIDTH:
                    break
                ids.append(str(r["least"]))
        if c.first == 0 and depth <= self.before:  # the edge to the partition before
            shared += upto[self.before]
            kids -= self.before > depth
        for k in range(0, len(ids) if name else 0, CHUNK):
            self.out.append((name, *[None] * 11, True, self.rows[0]["part"], k // CHUNK, ",".join(ids[k : k + CHUNK])))
        ends = None if name else hashlib.sha256(",".join(ids).encode()).hexdigest() if ids else EMPTY_SHA256
        self.out.append((name, above, None if depth else self.rows[c.first]["grp"], self.offset + depth, c.least, up, c.n, kids, c.leaves, shared, upto[depth - 1] if depth else 0, ends, name is not None, None, None, None))

    def _rise(self, i: int, depth: int, waiting: list) -> _Component:
        """Give out a component's chain above a depth and bring it there; the chain's topmost node waits for its parent."""
        c = self.parts[i]
        if c.low == depth:
            return c
        for d in range(c.low, depth + 1, -1):
            self._emit(c, d, c)
        waiting.append((i, c))
        return dataclasses.replace(c, low=depth, kids=1)

    def nodes(self) -> list[tuple]:
        edges: dict[int, list[int]] = {0: []}
        for i in range(1, len(self.rows)):
            if self.meets[i] >= 0:
                edges.setdefault(self.meets[i], []).append(i)
        for depth in sorted(edges, reverse=True):
            waiting: list[tuple[int, _Component]] = []
            for i in edges[depth]:
                a, b = self._find(i - 1), self._find(i)
                x, y = self._rise(a, depth, waiting), self._rise(b, depth, waiting)
                shared = x.shared + y.shared + self.rows[i]["upto"][depth]
                if x.last - x.first < y.last - y.first:
                    a, b = b, a
                self.root[b] = a
                del self.parts[b]
                self.parts[a] = _Component(depth, x.first, y.last, x.n + y.n, min(x.least, y.least), shared, x.leaves + y.leaves, x.kids + y.kids)
            if depth == 0:
                for i in list(self.parts):
                    self.parts[i] = self._rise(i, 0, waiting)
            for i, c in waiting:
                self._emit(c, depth + 1, self.parts[self._find(i)])
        for c in self.parts.values():
            self._emit(c, 0, None)
        return self.out


def _grown(offset: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nodes of one partition's forest; all its rows, some tens of thousands, are in memory."""
        rows: list[dict] = []
        for b in batches:
            rows += b.to_pylist()
        if rows:
            out = _Forest(rows, offset, rows[0]["before"], rows[0]["after"]).nodes()
            del rows
            for k in range(0, len(out), 10_000):
                columns = zip(*out[k : k + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW_NODE, strict=True)], schema=ARROW_NODE)
            del out
        give_back()

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every name's ids, piece after piece as they come in order; a hash has to see them one after the other."""
    name, hashed, out = None, None, []
    for b in batches:
        for key, ids in zip(b.column("name").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if key != name:
                if hashed:
                    out.append((name, hashed.hexdigest()))
                name, hashed = key, hashlib.sha256(ids.encode())
            else:
                hashed.update(f",{ids}".encode())
    if hashed:
        out.append((name, hashed.hexdigest()))
    yield pa.RecordBatch.from_pydict({"name": pa.array([n for n, _ in out], pa.binary()), "ends": pa.array([e for _, e in out], pa.string())})


def _shared_from_start(a: str, b: str) -> str:
    """SQL: turns that the rows a and b share from the start, -1 where there is no such row or it is of another group."""
    part = "substring({0}.key, (i - 1) * {1} + 1, {1})"
    least = f"cast(least(octet_length({a}.key), octet_length({b}.key)) div {WIDTH} as int)"
    differ = f"filter(sequence(1, {least}), i -> {part.format(a, WIDTH)} <> {part.format(b, WIDTH)})"
    return f"case when {a}.grp is null or {b}.grp is null or {a}.grp <> {b}.grp then -1 when {least} = 0 then 0 else coalesce(try_element_at({differ}, 1) - 1, {least}) end"


def _level_nodes(rows: DataFrame, offset: int, parts: int) -> DataFrame:
    """All nodes of one level's tries, the levels' tops at depth ``offset`` among them.

    Rows are sorted and range partitioned by (group, key), so a large group of equal conversations is cut as well. Every
    partition grows its own forest; what is open in several is added up by name. A partition has one open node for each turn
    of its first and last row at most.
    """
    order = ["grp", "key", "goes_on", "least"]
    placed = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    at = Window.orderBy("part")
    ends = placed.groupBy("part").agg(F.min(F.struct("grp", "key")).alias("low"), F.max(F.struct("grp", "key")).alias("high"))  # a row for each partition
    ends = ends.withColumns({"last": F.lag("high").over(at), "next": F.lead("low").over(at)})
    bounds = ends.select("part", F.expr(_shared_from_start("last", "low")).alias("before"), F.expr(_shared_from_start("high", "next")).alias("after"))
    grown = cut(placed.join(F.broadcast(bounds), "part").mapInArrow(_grown(offset), NODE))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "shared")]
    opened = grown.filter("open and ids is null").groupBy("name", "depth")
    opened = opened.agg(F.max("above").alias("above"), F.max("grp").alias("grp"), F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), *sums, F.max("upto_above").alias("upto_above"))
    pieces = grown.filter("ids is not null").select("name", "part", "chunk", "ids")
    ended = pieces.repartition("name").sortWithinPartitions("name", "part", "chunk").mapInArrow(_digest, "name binary, ends string")
    opened = cut(opened.join(ended, "name", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY_SHA256))).drop("ends"))
    found = grown.filter("not open").select(*opened.columns).unionByName(opened)
    few = opened.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    parents = opened.select(F.col("name").alias("above"), F.col("conv_id").alias("up"))
    found = found.join(F.broadcast(parents) if few else parents, "above", "left")
    return found.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")).drop("up", "above", "name")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, span: int = SPAN, parts: int | None = None) -> DataFrame:
    """The nodes of the prefix trie of conversations, given as :func:`numbered_turns` gives them.

    ``conversations`` (conv_id, n_turns) also names those without turns; by default there are none. Returns per node,
    the root included: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. Without conversations there is no root either.

    A conversation is taken in levels of ``span`` turns, so that no row holds more than that of it, however long it is.
    The first level has all conversations; the next one has those that share a level in full, in a group for each such
    prefix. The deepest level's tries are built first and contracted to a row of the level above. What one conversation
    alone has below the levels it shares is a chain of nodes that needs no trie.
    """
    if conversations is None:
        conversations = turns.groupBy("conv_id").agg(F.max("depth").alias("n_turns"))
    conversations = cut(conversations)
    place = F.expr(f"(depth - 1) div {span}").alias("level")
    held = F.sort_array(F.collect_list(F.struct("depth", "name", "words", "upto"))).alias("held")  # of span turns at most
    upto = F.concat(F.array(F.col("held")[0]["upto"] - F.col("held")[0]["words"]), F.transform("held", lambda t: t["upto"]))
    key = F.unhex(F.array_join(F.transform("held", lambda t: F.hex(t["name"])), ""))
    pieces = cut(turns.groupBy("conv_id", place).agg(held).select("conv_id", "level", key.alias("key"), upto.alias("upto")))
    top = conversations.join(pieces.filter("level = 0").drop("level"), "conv_id", "left")
    rows = top.select("conv_id", "n_turns", F.unhex(F.lit("")).alias("grp"), F.lit(None).cast("long").alias("up"), F.coalesce("key", F.unhex(F.lit(""))).alias("key"), F.coalesce("upto", F.array(F.lit(0).cast("long"))).alias("upto"))
    levels, chains = [], []
    while True:
        offset = span * len(levels)
        rows = cut(rows.withColumn("goes_on", F.col("n_turns") > offset + span).withColumn("to", F.when(F.octet_length("key") == span * WIDTH, _name(F.col("grp"), F.col("key")))))
        levels.append(rows)
        full = rows.filter("to is not null").groupBy("to").agg(F.min("conv_id").alias("up"), F.count(F.lit(1)).alias("n"), F.max("goes_on").alias("more"))
        shared = cut(full.filter("n > 1 and more").select(F.col("to").alias("grp"), "up"))
        going = rows.filter("goes_on").select("conv_id", "n_turns", F.col("to").alias("grp"))
        chains.append(going.join(shared, "grp", "left_anti").select("conv_id", F.lit(offset + span).alias("from")))
        if shared.isEmpty():
            break
        rows = going.join(shared, "grp").join(pieces.filter(F.col("level") == len(levels)).drop("level"), "conv_id")
    if parts is None:
        parts = max(shuffle_partitions(turns.sparkSession), math.ceil(conversations.count() / ROWS))

    found, below = [], None
    for level in reversed(range(len(levels))):
        rows, offset = levels[level], span * level
        alone = rows.select("grp", "key", "upto", "goes_on", F.col("conv_id").alias("least"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("shared"), F.col("goes_on").cast("long").alias("leaves"), F.col("goes_on").cast("long").alias("kids"), "up", "to")
        if below is not None:
            tops = below.select(F.col("grp").alias("to"), "least", "n", "shared", "leaves", "kids")
            where = alone.filter("goes_on").groupBy("to").agg(*[F.any_value(c).alias(c) for c in ("grp", "key", "upto", "goes_on", "up")])
            alone = alone.join(tops.select(F.col("to").alias("gone")), F.expr("goes_on and to = gone"), "left_anti").unionByName(where.join(tops, "to"))
        nodes = _level_nodes(alone.drop("to"), offset, parts)
        if level:
            nodes = cut(nodes)
            below = nodes.filter(F.col("depth") == offset).select("grp", F.col("conv_id").alias("least"), F.col("n_convs").alias("n"), "shared", F.col("n_leaves").alias("leaves"), F.col("n_children").alias("kids"))
            nodes = nodes.filter(F.col("depth") > offset)
        found.append(nodes.drop("grp"))
    result = reduce(DataFrame.unionByName, found)
    saved = F.col("shared") - (F.col("n_convs") - 1) * F.col("upto_above")
    result = result.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), "ends_sha256")
    chain = turns.join(reduce(DataFrame.unionByName, chains), "conv_id").filter(F.col("depth") > F.col("from")).join(conversations, "conv_id")
    last, own = F.col("depth") == F.col("n_turns"), F.col("conv_id")
    one = F.lit(1).cast("long")
    ends = F.when(last, F.sha2(own.cast("string"), 256)).otherwise(EMPTY_SHA256)
    return result.unionByName(chain.select("conv_id", "depth", own.alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), ends.alias("ends_sha256")))
