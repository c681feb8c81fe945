"""Benchmark decontamination with suffix arrays of the training texts.

Words are runs of 0-9, a-z and characters beyond ASCII, after A-Z are lower-cased. Test items (benchmark
texts) are cut into windows of WINDOW words; a shorter item is one window. The training texts are read in
shards; of each shard the suffixes that start as some window does are sorted (its suffix array, cut to
those that can match), and every test suffix is looked up by binary search. Suffixes that start no window
can't hold a match that counts, so they aren't sorted. From the places of its windows
the longest verbatim matches of each item follow, as runs along a diagonal. Words are compared by 64-bit
hashes.

The test set is taken in blocks of bounded size, each sent to all executors and run over all documents in a
pass of its own without a shuffle, so any size of test set works. Null and empty texts have no words and
no matches; null item ids are called "null"; repeated rows of docs each get a row, repeated items count
once. Extra columns stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import lean, text_blocks, utf8_buffers
from ._words import gram_hashes, words_of

WINDOW = 10
#: Bytes of test texts in a block that is broadcast; its windows take some ten times as much.
BLOCK_BYTES = 4 << 20
_HEAD = 3
_FILTER_BITS = 22
_MATCHES = "array<struct<item_id:string,doc_start:int,item_start:int,n_words:int>>"
_SPANS = "array<struct<first:int,last:int>>"


class Windows:
    """The windows of a block of test items, ready for look-up."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window, self.names = window, [str(i) for i, _ in items]
        raw = [(t or "").encode("utf-8", "replace") for _, t in items]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        words = words_of(np.frombuffer(b"".join(raw), np.uint8), off, "letters")
        n = np.diff(words.first)
        self.vocabulary, ids = np.unique(words.hashes, return_inverse=True)
        count = np.where(n > window, n - window + 1, np.minimum(n, 1))  # windows of each item
        item = np.repeat(np.arange(len(items)), count).astype(np.int32)
        offset = (np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        at, size = words.first[item] + offset, np.minimum(n[item], window)
        keys = np.zeros((len(at), window), ">u4")  # numbers of the words from 1, 0 behind a shorter item
        for k in range(window):
            inside = k < size
            keys[inside, k] = ids[at[inside] + k] + 1
        flat = keys.view(f"S{4 * window}").reshape(-1) if len(keys) else np.zeros(0, f"S{4 * window}")
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        new = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
        #: the distinct windows in order, their sizes, and where each one's places begin in item and offset
        self.keys, self.size, self.first = flat[new], size[order][new].astype(np.int16), np.r_[new, len(flat)]
        self.item, self.offset = item[order], offset[order]
        self.heads = {}
        for g in range(1, _HEAD + 1):
            own = at[np.minimum(size, _HEAD) == g]
            if len(own):
                self.heads[g] = np.unique(gram_hashes(words.hashes, g)[own])
        self._quick: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_quick": {}}

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Places from which the first words are those of some window."""
        found = []
        for g, heads in self.heads.items():
            if g not in self._quick:
                self._quick[g] = np.zeros(1 << _FILTER_BITS, bool)
                self._quick[g][heads >> np.uint64(64 - _FILTER_BITS)] = True
            grams = gram_hashes(hashes, g)
            at = np.flatnonzero(self._quick[g][grams >> np.uint64(64 - _FILTER_BITS)])
            k = np.searchsorted(heads, grams[at])
            found.append(at[heads[np.minimum(k, len(heads) - 1)] == grams[at]])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def suffix_array(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, sorted keys) of a shard's suffixes that can match; a key is the numbers of the first words, 0 beyond a text or the vocabulary."""
        at = self.candidates(hashes)
        ends = first[np.searchsorted(first, at, "right")]
        keys = np.zeros((len(at), self.window), ">u4")
        for k in range(self.window):
            p = at + k
            ok = p < ends
            h = hashes[p[ok]]
            i = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            keys[ok, k] = np.where(self.vocabulary[i] == h, i + 1, 0)
        flat = np.ascontiguousarray(keys).view(f"S{4 * self.window}").reshape(-1)
        order = np.argsort(flat, kind="stable")
        return at[order], flat[order]

    def find(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, number of the window) of every occurrence of a window in the shard."""
        at, keys = self.suffix_array(hashes, first)
        if not len(at):
            z = np.zeros(0, np.int64)
            return z, z, z
        short = self.size < self.window
        above = self.keys.copy()
        if short.any():
            above[short] = [bytes(k)[: 4 * int(z)].ljust(4 * int(z), b"\0").ljust(4 * self.window, b"\xff") for k, z in zip(self.keys[short], self.size[short])]
        low, high = np.searchsorted(keys, self.keys, "left"), np.searchsorted(keys, above, "right")
        n = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(n)), n)
        place = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return at[place], self.size[which].astype(np.int64), which


def _longest(windows: Windows, base: int, places: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int]]:
    """The longest match of each item with one text, from its windows' (place, length, number); the first of equals."""
    runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for p, size, which in sorted(places):
        own = slice(windows.first[which], windows.first[which + 1])
        for item, q in zip(windows.item[own].tolist(), windows.offset[own].tolist()):
            runs.setdefault((item, p - q), []).append((p, size))
    best: dict[str, tuple[int, int, int]] = {}
    for (item, diagonal), found in runs.items():
        a = z = None
        for p, size in [*found, (1 << 60, 0)]:
            if a is not None and p == z[0] + 1:
                z = (p, size)
                continue
            if a is not None:
                got = (z[0] + z[1] - a, a - base, a - diagonal)
                name = windows.names[item]
                if name not in best or (-got[0], got[1], got[2]) < (-best[name][0], best[name][1], best[name][2]):
                    best[name] = got
            a, z = p, (p, size)
    return [(name, d, q, n) for name, (n, d, q) in sorted(best.items())]


def _search(windows: Windows, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[list[dict]], list[list[dict]]]:
    """n_words, hit spans and longest matches of every text."""
    counts, spans, matches = [], [], []
    for i, j in text_blocks(off):
        words = words_of(data[off[i] : off[j]], off[i : j + 1] - off[i], "letters")
        counts.append(np.diff(words.first))
        place, size, which = windows.find(words.hashes, words.first)
        owner = np.searchsorted(words.first, place, "right") - 1
        order = np.lexsort((place, owner))
        place, size, which, owner = place[order], size[order], which[order], owner[order]
        cuts = np.searchsorted(owner, np.arange(j - i + 1))
        for k in range(j - i):
            a, z = cuts[k], cuts[k + 1]
            if a == z:
                spans.append([])
                matches.append([])
                continue
            base, own = int(words.first[k]), []
            for p, n in zip((place[a:z] - base).tolist(), size[a:z].tolist()):
                if own and p <= own[-1]["last"] + 1:
                    own[-1]["last"] = max(own[-1]["last"], p + n - 1)
                else:
                    own.append({"first": p, "last": p + n - 1})
            spans.append(own)
            found = _longest(windows, base, list(zip(place[a:z].tolist(), size[a:z].tolist(), which[a:z].tolist())))
            matches.append([{"item_id": n, "doc_start": d, "item_start": q, "n_words": w} for n, d, q, w in found])
    return np.concatenate(counts) if counts else np.zeros(0, np.int64), spans, matches


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """(item id as text, text) of the test items, block after block."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), "text").filter(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    n = max(1, math.ceil(size / block_bytes))
    for b in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        yield sorted((r["id"], r["text"]) for r in part.collect())  # about block_bytes


def with_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", keep_text: bool = True, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, tuple[str, str, str]]:
    """docs with three more columns, and their names: the number of words, the hit spans (words from 0, merged within a block of the test set) and the longest match of each item.

    The columns are called __n_words, __spans and __matches, with more underlines where docs has such a column.
    """
    sc, first, blocks = docs.sparkSession.sparkContext, True, list_ahead(_blocks(benchmark, block_bytes))
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    names = f"{prefix}n_words", f"{prefix}spans", f"{prefix}matches"
    for items, last in blocks:
        shared = sc.broadcast(Windows(items, window))
        if first:
            docs = docs.select("*", F.lit(0).cast("long").alias(names[0]), F.array().cast(_SPANS).alias(names[1]), F.array().cast(_MATCHES).alias(names[2]))
        drop = last and not keep_text
        out = [f for f in docs.schema.fields if not (drop and f.name == text_col)]
        schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in out)
        docs = docs.mapInArrow(lean(_pass(shared, text_col, drop, first, names)), schema)
        first = False
    return docs, names


def list_ahead(blocks: Iterator) -> Iterator[tuple[object, bool]]:
    """Each of some things, and whether it is the last."""
    held = next(blocks)
    for x in blocks:
        yield held, False
        held = x
    yield held, True


def _pass(shared, text_col: str, drop: bool, first: bool, added: tuple[str, str, str]):
    kinds = (pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(pa.struct([("item_id", pa.string()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("n_words", pa.int32())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            found = [*_search(shared.value, *utf8_buffers(b.column(names.index(text_col))))]
            if not first:
                for k in (1, 2):
                    found[k] = [x + y for x, y in zip(b.column(names.index(added[k])).to_pylist(), found[k], strict=True)]
            new = {c: pa.array(v, kind) for c, v, kind in zip(added, found, kinds, strict=True)}
            kept = [c for c in names if not (drop and c == text_col)]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(names.index(c)) for c in kept], names=kept)

    return run


def n_hit(spans: str):
    """Column: the number of words in any of the spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["last"] + 1).alias("end"), (a["n"] + F.greatest(F.lit(0), s["last"] + 1 - F.greatest(a["end"], s["first"]))).alias("n"))
    return F.aggregate(F.array_sort(F.col(spans)), start, step)["n"].cast("long")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and matches for every row."""
    rows, (words, spans, matches) = with_matches(docs.select("doc_id", "text"), benchmark, window, keep_text=False)
    items = F.array_sort(F.array_distinct(F.col(matches)["item_id"]))
    rows = rows.select("doc_id", F.col(words).alias("n_words"), n_hit(spans).alias("n_hit"), items.alias("items"), F.col(matches).alias("matches"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "matches")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a match, all columns as they were."""
    rows, (_, spans, _) = with_matches(docs, benchmark, window)
    return rows.filter(F.size(spans) == 0).drop(*(c for c in rows.columns if c not in docs.columns))
