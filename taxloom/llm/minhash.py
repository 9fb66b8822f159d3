"""Near-duplicate documents: MinHash bands, signature and set verification, connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxloom.llm.common import cut, discard, stored, tidy
from taxloom.llm.components import components
from taxloom.llm.shingles import Minima, shingle_set

BANDS, ROWS = 40, 5
SLACK = 0.15
BLOCK = 2048
BLOCK_SHINGLES = 1 << 21


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """(id, n_shingles, class, low, sig, keys): the set's 128-bit digest, size, minima's low bytes and bucket keys."""
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches):
        minima = Minima(BANDS, ROWS)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, len(texts), 256):
                classes, sizes, sigs, keys = [], [], [], []
                for text in texts[at : at + 256]:
                    hashes = shingle_set(text.as_py(), words)
                    sizes.append(len(hashes))
                    if not len(hashes):
                        classes.append(None)
                        sigs.append(None)
                        keys.append(None)
                        continue
                    low = minima(hashes)
                    classes.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    sigs.append((low & 255).astype(np.uint8).tobytes())
                    keys.append(minima.keys(low))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[at : at + 256],
                        pa.array(sizes, pa.int64()),
                        pa.array(classes, pa.binary()),
                        pa.array(sigs, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["id", "n_shingles", "class", "sig", "keys"],
                )

    return docs.mapInArrow(sign, f"id {kind}, n_shingles long, class binary, sig binary, keys array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()

    def gather(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, len(texts), 256):
                sets = [shingle_set(x.as_py(), words).view(np.int64) for x in texts[at : at + 256]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 256], pa.array(sets, pa.list_(pa.int64()))], names=["id", "hashes"])

    return docs.mapInArrow(gather, f"id {kind}, hashes array<long>")


def _likely(sigs: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree nearly as often as similar sets' do."""
    kind = pairs.schema["a"].dataType.simpleString()

    def keep(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            good = (x == y).mean(axis=1) >= least
            yield batch.filter(pa.array(good)).select([0, 1])

    left = sigs.select(F.col("id").alias("a"), F.col("sig").alias("x"))
    right = sigs.select(F.col("id").alias("b"), F.col("sig").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(keep, f"a {kind}, b {kind}").distinct()


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have percent of the union in common; as edges (u, v)."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.filter(f"100L * common >= {percent}L * (n + m - common)").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _labelled(rows: DataFrame, found: DataFrame, id_col: str, name: str) -> DataFrame:
    """rows with the component of id_col."""
    known = found.select(F.col("id").alias(id_col), F.col("component").alias("found"))
    return rows.join(known, id_col, "left").withColumn(name, F.coalesce("found", id_col)).drop("found")


def _rest(labelled: DataFrame, found: DataFrame, sigs: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Confirmed links (u, v) between different components that meet in a bucket, other than with its smallest id.

    Most buckets are one component by now and go. Documents that the others connect come together once, in blocks of
    about ``BLOCK`` documents and ``BLOCK_SHINGLES`` shingles at most: a group is two blocks, compares signatures of documents of different components, confirms likely pairs on the full
    sets, and hands on a forest of links: fewer than it has documents, however many pairs are similar.
    """
    kind = labelled.schema["id"].dataType.simpleString()
    mixed = (
        labelled.groupBy("key")
        .agg(F.min(F.least("component", "low_component")).alias("c1"), F.max(F.greatest("component", "low_component")).alias("c2"), F.count(F.lit(1)).alias("n"))
        .filter("c1 != c2 and n > 1")
    )
    near = cut(labelled.join(mixed.select("key"), "key", "left_semi").select(F.col("id").alias("u"), F.col("low").alias("v")).distinct())
    nodes = near.select(F.col("u").alias("id")).unionByName(near.select(F.col("v").alias("id"))).distinct()
    grouped = cut(_labelled(_labelled(nodes, found, "id", "component"), components(near), "id", "family"))
    sized = grouped.join(sets.select("id", F.size("hashes").alias("n")), "id")
    sizes = sized.groupBy("family").agg(F.expr(f"int(ceil(greatest(count(1) / {BLOCK}, sum(n) / {BLOCK_SHINGLES})))").alias("blocks"))
    blocked = (
        grouped.join(sizes, "family")
        .withColumn("own", F.expr("int(pmod(xxhash64(id), blocks))"))
        .join(sigs, "id")
        .join(sets, "id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", "id", "component", "own", "sig", "hashes", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    )

    def meet(group):
        group = group.sort_values("id", kind="stable")
        sig = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(len(group), -1)
        ids, own, hashes = group["id"].to_numpy(), group["own"].to_numpy(), list(group["hashes"])
        part = pd.factorize(group["component"])[0]
        same = group["p"].iat[0] == group["q"].iat[0]
        out = []
        for i in range(len(ids) - 1):
            there = np.flatnonzero((part[i + 1 :] != part[i]) & (same | (own[i + 1 :] != own[i]))) + i + 1
            if not len(there):
                continue
            alike = (sig[there] == sig[i]).mean(axis=1)
            likely = alike >= least
            for j in there[likely][np.argsort(-alike[likely], kind="stable")]:
                if part[j] != part[i]:
                    common = len(np.intersect1d(hashes[i], hashes[j], assume_unique=True))
                    if 100 * common >= percent * (len(hashes[i]) + len(hashes[j]) - common):
                        out.append((ids[i], ids[j]))
                        part[part == part[j]] = part[i]
        return pd.DataFrame(out, columns=["u", "v"])

    return blocked.groupBy("family", "p", "q").applyInPandas(meet, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group the documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Words are runs of other than ASCII white space, A to Z lower-cased; a document's set is that of its shingles of
    ``words`` words, or the whole sequence if it has fewer. Equal sets are one class, which one document stands for.
    200 universal hash minima are cut into 40 bands of 5; a pair with similarity 0.8 shares no bucket with a chance of
    1e-7. In each bucket every member meets the smallest one: first each document one candidate, then those candidates
    that it isn't yet linked with through the first, then, for buckets that still hold several components, all others. A
    candidate pair's signatures must agree nearly as often as the threshold (within 0.15, five standard deviations),
    and then the link is confirmed on the full sets. Pairs within a component are not listed, so a group of n near
    copies costs n links, not n squared. Components come from alternating large-star and small-star.

    Returns id, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept`` (whether it is the row's id).

    Null, empty and blank texts have an empty set and are linked with nothing. Rows with a null id are linked with
    nothing either; their component is null and they are kept. Rows that repeat an id are documents of that name, each
    with its own text. Other columns are ignored; an empty table gives an empty result.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stored(_signatures(narrow, words), "signatures")
    real = signed.filter("id is not null and class is not null")
    classes = cut(real.groupBy("class").agg(F.min("id").alias("rep")))
    reps = real.join(classes.withColumnRenamed("rep", "id"), ["class", "id"]).select("id", "sig", "keys")
    banded = reps.select("id", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high")
    members = cut(banded.join(buckets, "key").filter("id != low").select("key", "id", "low"))
    ids = cut(members.select("id").unionByName(members.select(F.col("low").alias("id"))).distinct())
    sigs = reps.join(ids, "id", "left_semi").select("id", "sig").distinct()
    sets = stored(_sets(narrow.join(ids, "id", "left_semi"), words), "sets")
    least = percent / 100 - SLACK

    first = members.groupBy(F.col("id").alias("a")).agg(F.min("low").alias("b"))
    edges = cut(_confirmed(sets, _likely(sigs, first, least), percent))
    linked = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))  # one for each id

    labelled = _labelled(_labelled(members, linked, "id", "component"), linked, "low", "low_component")
    more = labelled.filter("component != low_component").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    found = components(edges.unionByName(_confirmed(sets, _likely(sigs, more, least), percent)))

    labelled = _labelled(_labelled(members, found, "id", "component"), found, "low", "low_component")
    stars = found.select(F.col("id").alias("u"), F.col("component").alias("v"))
    found = cut(components(stars.unionByName(_rest(labelled, found, sigs, sets, least, percent))))
    discard(sets)
    tidy(docs.sparkSession)

    named = _labelled(classes, found, "rep", "component_id").select("class", "component_id")
    rows = signed.select("id", "n_shingles", "class")
    linked = rows.filter("id is not null and class is not null").join(named, "class").select("id", "n_shingles", "component_id")
    alone = rows.filter("id is null or class is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
