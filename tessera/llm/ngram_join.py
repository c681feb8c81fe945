"""N-gram Jaccard join over a token-group matrix.

Documents are sets of word shingles; two link when intersection / union reaches a threshold, and a
component is what links connect. All links are found, none is sampled:

1. Documents with equal sets are one class (a 128-bit signature), and only classes are compared.
2. A count sketch of fixed size over the shingles of all documents gives one order, rare shingles first.
   Linked classes share a shingle among the first n - ceil(t n) + 1 of their n, and at least m among the
   first n - ceil(t n) + m (prefix filter), so a class that shares fewer than m of these with others is
   done; m is 8 % of its shingles.
3. The others fall into groups by a min-hash. Each group keeps the union of its members' shingles; a
   class is looked up in the matrix of groups and shingles, the overlap with a group's union bounds that
   with each member, and only groups whose bound qualifies are opened and compared exactly.
4. Across the components so found, a class that shares a prefix shingle with another component is a query
   against it: again the union is the bound, and only qualifying groups are opened.

Large groups are dealt out in chunks of bounded size, each with the group's first class in it (step 3) or
with its part of the queries (step 4). A component needs no more links than connect it, so a class isn't
compared with the rest of a group it is linked to already.

Null and empty texts have no shingles and link with nothing: each is its own component. Repeated rows
count as copies. A component is named by its smallest doc_id; null ids are passed over there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import checkpointed, lean, slices, text_blocks, utf8_buffers
from ._words import gram_hashes, mix, words_of
from .components import connected

SKETCH_BITS, SKETCH_PARTS = 22, 16
#: Most classes in a chunk of a group, and shingles that they hold together.
CHUNK_CLASSES, CHUNK_SHINGLES = 128, 200_000
#: Bits of the filter that tells a scan which classes' sets are wanted; when it is full it only saves less.
FILTER_BITS = 1 << 25
#: Share of a class's shingles by which its prefix is longer than needed for one shared shingle.
EXTRA, EXTRA_OF = 2, 25
_C = [np.uint64(x) for x in (0x8F14E45FCEEA167A, 0x45C48CCE2E2D7FBD, 0xD3D9446802A44259)]


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    for i, j in text_blocks(off):
        words = words_of(data[off[i] : off[j]], off[i : j + 1] - off[i], "spaced")
        grams, first = words.grams(k), words.first
        for d in range(j - i):
            a, z = int(first[d]), int(first[d + 1])
            if z - a >= k:
                yield np.unique(grams[a : z - k + 1])
            else:
                yield gram_hashes(words.hashes[a:z], z - a) if z > a else np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> bytes:
    return np.array([mix(s ^ _C[0]).sum() + np.uint64(len(s)), mix(s ^ _C[1]).sum()], ">u8").tobytes()


def prefix_length(n: int, num: int, den: int) -> int:
    """n - ceil(n num / den) + 1."""
    return n - -(-n * num // den) + 1


def linked(both: int, a: int, b: int, num: int, den: int) -> bool:
    return den * both >= num * (a + b - both)


def packed(counts: np.ndarray) -> bytes:
    """The counts that aren't zero and the steps between their places, byte by byte of equal weight: a task of few shingles sends little."""
    at = np.flatnonzero(counts).astype(np.uint32)
    kinds = np.diff(at, prepend=np.uint32(0)), counts[at].astype(np.uint64)
    return zlib.compress(b"".join(x.view(np.uint8).reshape(len(at), x.itemsize).T.tobytes() for x in kinds), 1)


def unpacked(data: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    m = len(raw) // 12
    out = np.zeros(size, np.int64)
    at = np.cumsum(np.ascontiguousarray(raw[: 4 * m].reshape(4, m).T).view(np.uint32).ravel(), dtype=np.int64)
    out[at] = np.ascontiguousarray(raw[4 * m :].reshape(8, m).T).view(np.int64).ravel()
    return out


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, sig, key) for each row, sig null for empty sets; and (part, counts), the parts of each task's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        names = ["doc_id", "n", "sig", "key", "part", "counts"]
        kind = None
        for b in slices(batches):
            kind = b.column(0).type
            n, sig, key = [], [], []
            for s in shingle_sets(*utf8_buffers(b.column(1)), k):
                n.append(len(s))
                sig.append(signature(s) if len(s) else None)
                key.append(int(mix(s ^ _C[2]).min().astype(np.int64)) if len(s) else None)
                at = s >> np.uint64(64 - SKETCH_BITS)  # in order, as s is
                sketch[at] += 1  # once for each distinct place
                np.add.at(sketch, at[1:][at[1:] == at[:-1]], 1)
            m = len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(key, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if kind is not None:
            parts = [packed(p) for p in np.split(sketch, SKETCH_PARTS)]
            m = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array(range(m), pa.int32()), pa.array(parts, pa.binary())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").alias("t")).mapInArrow(lean(run), f"doc_id {kind}, n long, sig binary, key long, part int, counts binary")


def _sketch(scanned: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches, of fixed size."""
    parts = scanned.filter(F.col("part").isNotNull()).select("part", "counts")
    size = (1 << SKETCH_BITS) // SKETCH_PARTS

    def total(table: pa.Table) -> pa.Table:
        counts = sum(unpacked(x.as_py(), size) for x in table.column("counts"))
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([packed(counts)], pa.binary())})

    salted = parts.groupBy("part", (F.spark_partition_id() % 64).alias("s")).applyInArrow(total, "part int, counts binary")
    rows = salted.groupBy("part").applyInArrow(total, "part int, counts binary").collect()  # SKETCH_PARTS rows
    out = np.zeros((SKETCH_PARTS, size), np.int64)
    for r in rows:
        out[r["part"]] = unpacked(r["counts"], size)
    return np.minimum(out.reshape(-1), (1 << 32) - 1).astype(np.uint32)


def _prefixes(docs: DataFrame, k: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """(sig, cid, prefix) of each class: its rarest shingles, rarest first. cid is the first half of the signature."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = shared.value, set()
        for b in slices(batches):
            sig, prefix = [], []
            for s in shingle_sets(*utf8_buffers(b.column(0)), k):
                if len(s):
                    g = signature(s)
                    if g in seen:
                        continue
                    seen.add(g)
                    sig.append(g)
                    order = np.argsort(count[s >> np.uint64(64 - SKETCH_BITS)], kind="stable")
                    prefix.append(s[order[: prefix_length(len(s), num, den) + max(1, EXTRA * len(s) // EXTRA_OF) - 1]].astype(np.int64))
            cid = np.frombuffer(b"".join(sig), ">i8")[::2].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(cid), pa.array(prefix, pa.list_(pa.int64()))], names=["sig", "cid", "prefix"])

    rows = docs.select(F.col("text").alias("t")).mapInArrow(lean(run), "sig binary, cid long, prefix array<bigint>")
    return rows.groupBy("sig").agg(F.first("cid").alias("cid"), F.first("prefix").alias("prefix")).select("cid", "prefix")


def _filter_bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys % np.uint64(FILTER_BITS)).astype(np.int64), ((keys >> np.uint64(32)) * np.uint64(2654435761) % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter(sigs: DataFrame) -> bytes:
    """A Bloom filter of signatures, of fixed size: each task packs its own, and they are joined by bitwise or."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        some = False
        for b in batches:
            if b.num_rows:
                some = True
                keys = np.frombuffer(b"".join(b.column(0).to_pylist()), ">u8")[::2].astype(np.uint64)
                for at in _filter_bits(keys):
                    bits[at] = True
        if some:
            parts = [p.tobytes() for p in np.split(np.packbits(bits), 16)]
            yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array(parts, pa.binary())], names=["part", "bits"])

    def join(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")])
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    packed = sigs.select("sig").coalesce(24).mapInArrow(lean(pack), "part int, bits binary")
    got = {r["part"]: r["bits"] for r in packed.groupBy("part").applyInArrow(join, "part int, bits binary").collect()}
    return b"".join(got.get(p, bytes(FILTER_BITS // 128)) for p in range(16))


def _wanted_sets(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """(sig, n, shingles as bytes) of the wanted classes."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(shared.value, np.uint8), set()
        for b in slices(batches):
            sig, n, sets = [], [], []
            for s in shingle_sets(*utf8_buffers(b.column(0)), k):
                if len(s):
                    g = signature(s)
                    if g not in seen and all(bits[at[0] >> 3] >> (7 - (at[0] & 7)) & 1 for at in _filter_bits(np.frombuffer(g, ">u8")[:1].astype(np.uint64))):
                        seen.add(g)
                        sig.append(g)
                        n.append(len(s))
                        sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(n, pa.int64()), pa.array(sets, pa.binary())], names=["sig", "n", "shingles"])

    rows = docs.select(F.col("text").alias("t")).mapInArrow(lean(run), "sig binary, n long, shingles binary")
    return rows.join(wanted.select("sig"), "sig", "left_semi").groupBy("sig").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))


def group_links(sigs: list[bytes], sets: list[np.ndarray], num: int, den: int) -> list[tuple[bytes, bytes]]:
    """Links that connect what is connected among these sets, by the token-group matrix."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sigs[i]))
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    ids = [flat[cuts[i] : cuts[i + 1]] for i in range(len(sets))]
    matrix = np.zeros((min(8, len(sets)), len(vocabulary)), np.uint8)
    groups: list[list[int]] = []
    mask = np.zeros(len(vocabulary), bool)
    links = []
    for i in order:
        n = len(sets[i])
        mask[ids[i]] = True
        joined = []
        if groups:
            bound = matrix[: len(groups), ids[i]].sum(1, dtype=np.int64)
            for g in np.flatnonzero((den * bound >= num * n) & np.array([bool(m) for m in groups])):
                for j in groups[g]:
                    if den * len(sets[j]) >= num * n and linked(int(mask[ids[j]].sum()), n, len(sets[j]), num, den):
                        links.append((sigs[i], sigs[j]))
                        joined.append(int(g))
                        break
        mask[ids[i]] = False
        if not joined:
            if len(groups) == len(matrix):
                matrix = np.concatenate([matrix, np.zeros_like(matrix)])
            groups.append([i])
            matrix[len(groups) - 1, ids[i]] = 1
        else:
            g = joined[0]
            for h in joined[1:]:
                matrix[g] |= matrix[h]
                matrix[h] = 0
                groups[g] += groups[h]
                groups[h] = []
            groups[g].append(i)
            matrix[g, ids[i]] = 1
    return links


def query_links(queries: list[tuple[bytes, np.ndarray]], members: list[tuple[bytes, np.ndarray]], num: int, den: int) -> list[tuple[bytes, bytes]]:
    """A link for each query that has one with a member; the members' union is the bound."""
    union = np.unique(np.concatenate([s for _, s in members]))
    members = sorted(members, key=lambda m: (len(m[1]), m[0]))
    sizes = [len(s) for _, s in members]
    links = []
    for sig, s in queries:
        n = len(s)
        at = np.minimum(np.searchsorted(union, s), len(union) - 1)
        if den * int((union[at] == s).sum()) < num * n:
            continue
        for (g, m), size in zip(members, sizes):
            if den * size >= num * n and den * n >= num * size and linked(len(np.intersect1d(s, m, assume_unique=True)), n, size, num, den):
                links.append((sig, g))
                break
    return links


def _chunks(n: str, shingles: str):
    return F.greatest(F.lit(1), F.ceil(F.col(n) / CHUNK_CLASSES), F.ceil(F.col(shingles) / CHUNK_SHINGLES)).cast("int")


def _inside_groups(sets: DataFrame, keys: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) inside the groups of equal keys."""
    rows = sets.join(keys, "sig")
    groups = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min("sig").alias("hub")).filter("m > 1").withColumn("chunks", _chunks("m", "total"))
    rows = rows.join(groups.select("key", "chunks", "hub"), "key")
    own = F.pmod(F.xxhash64("sig"), F.col("chunks").cast("long"))
    where = F.when(F.col("sig") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).otherwise(F.array(own))
    rows = rows.select("key", F.explode(where).alias("chunk"), "sig", "shingles")

    def links(table: pa.Table) -> pa.Table:
        found = group_links(table.column("sig").to_pylist(), [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")], num, den)
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return rows.groupBy("key", "chunk").applyInArrow(links, "a binary, b binary")


def _across(sets: DataFrame, shared: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between components that share prefix shingles; shared: (token, sig, n, place).

    What stands before the first shared shingle of a linked pair, on either side, the other side lacks: so the
    places of that shingle add up to (1 - t) / (1 + t) of both sizes at most, and other rows needn't meet.
    """
    labelled = sets.select("sig", "n").join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    sizes = labelled.groupBy("comp").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    labelled = checkpointed(labelled.join(sizes, "comp"))
    rows = shared.join(labelled.select("sig", "comp", "size"), "sig")
    groups = rows.groupBy("token", "comp", "size").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("place").alias("first"))
    several = groups.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1")
    groups = groups.join(several, "token", "left_semi").select("token", F.col("comp").alias("g"), F.col("size").alias("g_size"), "low", "high", "first")
    apart = (F.col("size") < F.col("g_size")) | ((F.col("size") == F.col("g_size")) & (F.col("comp") < F.col("g")))
    fits = (den * F.col("high") >= num * F.col("n")) & (den * F.col("n") >= num * F.col("low"))
    near = (F.col("place") + F.col("first")) * (num + den) <= (den - num) * (F.col("n") + F.col("high"))
    queries = checkpointed(rows.join(groups, "token").filter(apart & fits & near).select("sig", "g").distinct())
    asked = queries.groupBy("g").agg(F.count("*").alias("asked")).withColumn("salts", F.ceil(F.col("asked") / (4 * CHUNK_CLASSES)).cast("int"))
    asked = asked.join(sizes.withColumnRenamed("comp", "g"), "g").select("g", "salts", _chunks("size", "total").alias("chunks"))
    numbers = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = lambda c: F.pmod(F.xxhash64("sig"), F.col(c).cast("long")).cast("int")
    left = queries.join(asked, "g").select("g", F.explode(numbers("chunks")).alias("chunk"), own("salts").alias("salt"), "sig").withColumn("member", F.lit(False))
    right = labelled.join(asked, labelled["comp"] == asked["g"]).select("g", own("chunks").alias("chunk"), F.explode(numbers("salts")).alias("salt"), "sig").withColumn("member", F.lit(True))
    both = left.unionByName(right).join(sets.select("sig", "shingles"), "sig")

    def links(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("sig").to_pylist(), [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")], table.column("member").to_pylist()))
        members, queries = [(a, s) for a, s, m in rows if m], [(a, s) for a, s, m in rows if not m]
        found = query_links(queries, members, num, den) if members and queries else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return both.groupBy("g", "chunk", "salt").applyInArrow(links, "a binary, b binary")


def components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs; texts link at intersection / union >= num / den."""
    docs = docs.select("doc_id", "text")
    scanned = checkpointed(_scan(docs, k))
    rows = scanned.filter(F.col("part").isNull())
    classes = checkpointed(rows.filter(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("key").alias("key")))
    sizes = rows.filter(F.col("sig").isNotNull()).select("sig", "n").distinct()
    sizes = sizes.withColumn("cid", F.conv(F.hex(F.substring("sig", 1, 8)), 16, -10).cast("long")).withColumn("need", F.greatest(F.lit(1), F.floor(F.col("n") * EXTRA / EXTRA_OF)))
    sizes = sizes.withColumn("plain", F.col("n") - F.floor((F.col("n") * num + (den - 1)) / den) + 1)
    tokens = _prefixes(docs, k, num, den, _sketch(scanned)).select("cid", F.posexplode("prefix").alias("place", "token"))
    several = Window.partitionBy("token")
    found = tokens.withColumn("low", F.min("cid").over(several)).withColumn("high", F.max("cid").over(several)).filter("low < high")
    found = checkpointed(found.select("token", "cid", "place"))
    hits = found.groupBy("cid").agg(F.count("*").alias("hits"))
    wanted = checkpointed(sizes.join(hits, "cid").filter(F.col("hits") >= F.col("need")).select("sig", "n", "cid", "plain"))
    shared = found.join(wanted, "cid").filter(F.col("place") < F.col("plain")).select("token", "sig", "n", "place")
    sets = checkpointed(_wanted_sets(docs, k, wanted.select("sig")))
    inside = checkpointed(_inside_groups(sets, classes.select("sig", "key"), num, den))
    labels = connected(inside)
    across = checkpointed(_across(sets, shared, labels, num, den))
    if not across.isEmpty():
        labels = connected(inside.unionByName(across))
    named = classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = checkpointed(named.join(names, "comp").select("sig", "copies", "component_id"))
    total = named.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    hot = named.filter(1000 * F.col("copies") >= max(total, 1_000)).select("sig", "component_id")  # at most 1000 classes
    known, out = rows.filter(F.col("sig").isNotNull()), ("doc_id", F.col("n").alias("n_shingles"), "component_id")
    result = known.join(F.broadcast(hot), "sig").select(*out)
    rest = known.join(F.broadcast(hot.select("sig")), "sig", "left_anti").join(named.select("sig", "component_id"), "sig").select(*out)
    alone = rows.filter(F.col("sig").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return result.unionByName(rest).unionByName(alone)


def first_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that name their component; rows that repeat an id and a text count once, rows without an id stay.

    Of different texts under one id all stay that no document with a smaller id is linked to, or that share their id with such a text.
    """
    kept = components(docs, k, num, den).filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.filter(F.col("doc_id").isNull()))
