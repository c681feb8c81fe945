"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is merged by a score-ordered agenda of adjacent symbol pairs: the pair with the best score is
merged first, the leftmost among equals, and the pairs that the merge makes join the agenda. The agendas of
many chunks advance side by side, as the rows of a matrix. Pieces hold
a space mark only at their start, so texts fall into chunks that never merge with each other; every
distinct chunk is merged once a worker, and each newly merged chunk is checked against the sentencepiece
library, batch by batch, as is the first whole text of every batch. A difference raises an error. Texts are
decoded from their ids.

Null text is encoded as the empty text: no ids, an empty decoding. Nothing is truncated.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from collections.abc import Iterator
from itertools import pairwise
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import lean, slices

SPACE = "▁"
#: Entries of a worker's chunk cache and characters in them; half of them are the older ones, dropped first.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 8 << 20
#: Longest part merged without a heap, and the widths by which chunks up to it are merged side by side.
SHORT = 40
WIDTHS = (0, 6, 9, 13, 20, SHORT)
NONE = float("-inf")
_BYTE_TEXT = [chr(v) if v < 128 else None for v in range(256)]
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encodes and decodes with the vocabulary of a BPE model file."""

    def __init__(self, model_file: str, cache_entries: int = CACHE_ENTRIES):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(model_file, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with identity normalisation, dummy prefix and byte fallback is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.piece: list[str] = []
        self.byte_of: dict[int, int] = {}
        self.unknown, self.silent = 0, set()
        for i, p in enumerate(proto.pieces):
            self.piece.append(p.piece)
            if p.type == 1:
                self.id[p.piece], self.score[p.piece] = i, p.score
            elif p.type == 6:
                self.byte_of[int(p.piece[3:5], 16)] = i
            elif p.type == 3:
                self.silent.add(i)
            elif p.type == 2:
                self.unknown = i
            else:
                raise ValueError("user-defined and unused pieces aren't handled")
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece holds a space mark inside")
        self.value_of = {i: v for v, i in self.byte_of.items()}
        #: What an id stands for by itself, under its decimal number; bytes beyond ASCII stand for nothing alone.
        self.plain_of = {str(i): p.replace(SPACE, " ") for p, i in self.id.items()} | {str(i): _BYTE_TEXT[v] for v, i in self.byte_of.items() if v < 128}
        self.pairs = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        joint: dict[str, set[str]] = {}
        for x, y in self.pairs:
            joint.setdefault(y, set()).add(x)
        self.text_of = [str(i) for i in range(len(self.piece))]
        #: Symbols by code point (-1: no piece of one character), and what two of them merge into, sorted by both.
        self.symbol_of = np.full(sys.maxunicode + 1, -1, np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        self.blank = len(self.piece)
        merges = sorted((self._key(self.id[p[:k]], self.id[p[k:]]), self.score[p], i) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id)
        self.merge_key = np.array([k for k, _, _ in merges] + [np.iinfo(np.int64).max], np.int64)
        self.merge_score = np.array([x for _, x, _ in merges] + [NONE], np.float32)
        self.merge_into = np.array([i for _, _, i in merges] + [0], np.int32)
        marks = {c for p in self.id for c in p if not c.isalpha() and not c.isdecimal()} - {SPACE}
        while odd := {c for c in marks if joint.get(c, set()) - marks - {SPACE}}:
            marks -= odd
        lone = "" if any("\n" in p for p in self.id) else "\n"
        m = "".join(re.escape(c) for c in sorted(marks) if c.isascii())  # a short class is quick to match
        #: Marks follow only marks and spaces within a piece, so a chunk ends before a mark that follows something else.
        self._chunks = re.compile(f"{SPACE}*[{m}]*[^{SPACE}{m}{lone}]+|{SPACE}*[{m}]+|{SPACE}+" + (f"|{lone}" if lone else "")).findall
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.cache_entries, self.chars = cache_entries, 0

    def merge(self, text: str) -> list[int]:
        """Ids of a text without a dummy prefix, spaces already marked, by the agenda of adjacent pairs."""
        symbols = self._merge_short(text) if len(text) <= SHORT else self._merge_long(text)
        ids = [*map(self.id.get, symbols)]
        if None in ids:
            return [v for x, i in zip(symbols, ids, strict=True) for v in ([i] if i is not None else [self.byte_of[b] for b in x.encode()])]
        return ids

    def _merge_short(self, text: str) -> list[str]:
        """The agenda as a list beside the symbols: its best entry is taken until none is left."""
        score, symbols = self.score.get, list(text)
        agenda = [score(a + b, NONE) for a, b in zip(text, text[1:])]
        while agenda:
            best = max(agenda)
            if best == NONE:
                break
            i = agenda.index(best)
            symbols[i] = x = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score(x + symbols[i + 1], NONE)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + x, NONE)
        return symbols

    def _merge_long(self, text: str) -> list[str]:
        """The agenda as a heap over linked symbols; entries made stale by a merge are passed over."""
        n = len(text)
        symbol: list[str | None] = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        score = self.score
        agenda = [(-score[text[i : i + 2]], i, i + 1, 2) for i in range(n - 1) if text[i : i + 2] in score]
        heapq.heapify(agenda)

        def meet(i: int, j: int) -> None:
            s = score.get(symbol[i] + symbol[j])
            if s is not None:
                heapq.heappush(agenda, (-s, i, j, len(symbol[i]) + len(symbol[j])))

        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            a, b = symbol[i], symbol[j]
            if a is None or b is None or len(a) + len(b) != size:
                continue
            symbol[i], symbol[j] = a + b, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                meet(i, k)
            if before[i] >= 0:
                meet(before[i], i)
        return [x for x in symbol if x is not None]

    def _key(self, a, b):
        return a * (self.blank + 1) + b

    def _meet(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of the merge of each two symbols, and its symbol; NONE where they don't merge."""
        key = self._key(a, b)
        at = self.merge_key.searchsorted(key)
        return np.where(self.merge_key[at] == key, self.merge_score[at], np.float32(NONE)), self.merge_into[at]

    def _merge_rows(self, s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The agendas of many rows of symbols side by side: each step takes the best entry of every row. Rows begin and end with blanks; (rows, their symbols) come as they are finished."""
        rows = np.arange(len(s))
        score, into = self._meet(s[:, :-1], s[:, 1:])
        while rows.size:
            at, r = score.argmax(1), np.arange(rows.size)
            done = score[r, at] == NONE
            if done.any():
                yield rows[done], s[done]
                go = ~done
                rows, s, score, into, at = rows[go], s[go], score[go], into[go], at[go]
                r = r[: rows.size]
            s[r, at] = into[r, at]
            columns = np.arange(s.shape[1])
            less = (rows.size, columns.size - 1)
            s = s[columns != at[:, None] + 1].reshape(less)
            stay, less = columns[:-1] != at[:, None], (rows.size, columns.size - 2)
            score, into = score[stay].reshape(less), into[stay].reshape(less)
            for k in (at - 1, at):
                score[r, k], into[r, k] = self._meet(s[r, k], s[r, k + 1])

    def _new_all(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks; long ones, and those with a character that is no piece, are merged each on its own."""
        out: list[list[int]] = [[]] * len(chunks)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbols = self.symbol_of[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        first = size.cumsum() - size
        plain = (size <= SHORT) & (np.minimum.reduceat(symbols, first) >= 0)
        for i in np.flatnonzero(~plain).tolist():
            out[i] = self._new(chunks[i])
        for low, high in pairwise(WIDTHS):
            some = np.flatnonzero(plain & (size > low) & (size <= high))
            if not some.size:
                continue
            columns = np.arange(size[some].max())
            s = np.full((some.size, columns.size + 2), self.blank, np.int64)
            s[:, 1:-1] = np.where(columns < size[some, None], symbols[np.minimum(first[some, None] + columns, symbols.size - 1)], self.blank)
            for rows, merged in self._merge_rows(s):
                n = (merged != self.blank).sum(1)
                for i, k, ids in zip(some[rows].tolist(), n.tolist(), merged[:, 1:].tolist(), strict=True):
                    out[i] = ids[:k]
        return out

    def _new(self, chunk: str) -> list[int]:
        """Ids of a chunk, cut between characters that stand together in no piece."""
        cuts = [k for k, p in enumerate(map(add, chunk, chunk[1:]), 1) if p not in self.pairs]
        if not cuts:
            return self.merge(chunk)
        edges = [0, *cuts, len(chunk)]
        return [i for a, z in zip(edges, edges[1:]) for i in self.merge(chunk[a:z])]

    def _fill(self, chunks: set[str]) -> None:
        """Put chunks in the cache: from its older half, else merged and checked against the library."""
        if len(self.new) + len(chunks) > self.cache_entries // 2 or self.chars > CACHE_CHARS // 2:
            self.old, self.new, self.chars = self.new, {}, 0
        self.chars += sum(map(len, chunks))
        old, todo, text_of = self.old, [], self.text_of
        for c in chunks:
            ids = old.get(c)
            if ids is None:
                todo.append(c)
            else:
                self.new[c] = ids
        head = len(self.library.encode("\n"))
        for start in range(0, len(todo), 20_000):
            block = todo[start : start + 20_000]
            want = self.library.encode(["\n" + c for c in block], num_threads=1)
            for c, got, ids in zip(block, self._new_all(block), want, strict=True):
                if got != ids[head:]:
                    raise AssertionError(f"the agenda and the library differ on {c!r}: {got} and {ids[head:]}")
                self.new[c] = ",".join([text_of[i] for i in got])

    def _plain(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            v = self.value_of.get(i)
            if v is not None:
                run.append(v)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.piece[i])
        if run:
            out.append(_utf8(run))
        return "".join(out).replace(SPACE, " ")

    def chunks(self, text: str) -> list[str]:
        return self._chunks(SPACE + text.replace(" ", SPACE)) if text else []

    def _joined(self, texts: list[str]) -> Iterator[tuple[str, list[str]]]:
        """For each text its ids, joined by commas, and its chunks; chunks that the cache lacks are merged block by block."""
        for block in _blocks(texts):
            split = [self.chunks(x) for x in block]
            present = set().union(*split)
            missing = present - self.new.keys()
            if len(missing) + len(self.new) > self.cache_entries // 2 or missing and self.chars > CACHE_CHARS // 2:
                missing = present
            if missing:
                self._fill(missing)
            ids_of = self.new.__getitem__
            for chunks in split:
                yield ",".join(map(ids_of, chunks)), chunks

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [list(map(int, ids.split(","))) if ids else [] for ids, _ in self._joined(texts)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space of the dummy prefix."""
        out = self._plain(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return out[1:] if first is not None and self.piece[first].startswith(SPACE) else out

    def decode_joined(self, ids: str) -> str:
        """decode of ids that are joined by commas."""
        if not ids:
            return ""
        try:
            out = "".join(map(self.plain_of.__getitem__, ids.split(",")))
        except KeyError:  # bytes beyond ASCII, or ids of no ordinary piece
            return self.decode([*map(int, ids.split(","))])
        return out[1:] if out[0] == " " else out

    def check_whole(self, text: str, ids: str, decoded: str) -> None:
        """Raise where the library encodes or decodes a whole text otherwise."""
        want = self.library.encode(text)
        if ",".join(map(str, want)) != ids or self.library.decode(want) != decoded:
            raise AssertionError(f"the agenda and the library differ on a text of {len(text)} characters")

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Counts of ids, digests of the ids and of the decoded texts."""
        n_tokens, ids_sha, text_sha = [], [], []
        for ids, _ in self._joined(texts):
            plain = self.decode_joined(ids)
            n_tokens.append(ids.count(",") + 1 if ids else 0)
            ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
            text_sha.append(hashlib.sha256(plain.encode()).hexdigest())
        return n_tokens, ids_sha, text_sha


def _blocks(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts of about `most` characters together."""
    block, size = [], 0
    for x in texts:
        block.append(x)
        size += len(x)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _utf8(run: bytearray) -> str:
    """Bytes as text; each byte that isn't part of a valid character becomes U+FFFD."""
    out, k = [], 0
    while k < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(run[k : k + size]).decode())
                k += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


def _forgetful(run):
    """The same function over batches; the cache is dropped when a task ends, so that idle workers are small. Most of its hits come from the same task."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for c in _codecs.values():
                c.new, c.old, c.chars = {}, {}, 0

    return lean(wrapped)


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """One codec, with its cache, for each model file and process."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_digests(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_tokens, ids_sha256 and decoded_sha256.

    Repeated rows each get a row. model_file None: the public 32k vocabulary, found on each worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file or default_model())
        for b in slices(batches):
            texts = [x or "" for x in b.column(1).to_pylist()]
            c.check_whole(first := texts[0], ids := next(c._joined([first]))[0], c.decode_joined(ids))  # one whole text a batch
            n, ids, text = c.digests(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_forgetful(run), f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)


def encoded(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: its id, token_ids, n_tokens, and round_trip: whether the ids decode to the text (space marks as spaces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file or default_model())
        for part in slices(batches):
            texts = [x or "" for x in part.column(1).to_pylist()]
            ids = c.encode_all(texts)
            same = [c.decode(i) == x.replace(SPACE, " ") for x, i in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(same, pa.bool_())], names=["id", "token_ids", "n_tokens", "round_trip"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_forgetful(run), f"id {kind}, token_ids array<int>, n_tokens long, round_trip boolean").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, model_file: str | None = None, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """docs with an array of ids; a column of that name is replaced."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        c = codec(model_file or default_model())
        return texts.map(lambda x: c.encode(x or ""))

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decode(rows: DataFrame, model_file: str | None = None, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids give an empty text."""

    @F.pandas_udf("string")
    def text(ids):
        c = codec(model_file or default_model())
        return ids.map(lambda x: c.decode([int(i) for i in x]) if x is not None else "")

    return rows.withColumn(text_col, text(F.col(ids_col)))
