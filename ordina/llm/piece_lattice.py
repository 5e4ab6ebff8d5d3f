"""SentencePiece (byte-pair) encoding and decoding by suffix-array matching.

The distinct units of a batch (a run of spaces and the non-spaces after it; no piece crosses
into a later space) are concatenated and indexed by a suffix array. Every piece of the
vocabulary is found by binary search; the suffixes in its range are its occurrences, the edges
of a lattice. Edges are sorted by where they end and relaxed from the left: for byte-pair
encoding a prefix of a unit has exactly one last piece, namely the edge whose piece may
follow the last piece of the prefix before it. Two pieces may stand side by side if
undoing their merges, latest first, shows no merge across the border that would have come
earlier; that is exact, and needs no more than the merge tree of each piece.

Characters that no piece holds become byte pieces. Decoding joins the pieces' bytes.

Defined cases: null gives null; an empty text has no ids. U+2581 counts as a space, as in the
library, and so decodes to one. Equal scores are taken as ordered by id, except in runs of spaces, which
are merged exactly as the library does. Texts are whole, however long.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordina.llm._store import pick
from ordina.llm._text import LEAD, IdCache, buffers, parts, runs

MARK = "\u2581"
#: Units longer than this are relaxed one by one, shorter ones all together.
TOGETHER = 64
NO_SPACE = np.zeros(256, bool)
NO_SPACE[0x20] = True


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def merged(symbols: list[str], score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Byte-pair merges by score, leftmost first among equals: the symbols left, and the last merge."""
    n = len(symbols)
    symbols, right, left = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
    queue: list[tuple[float, int, int, str]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and (s := score.get(symbols[a] + symbols[b])) is not None:
            heapq.heappush(queue, (-s, a, b, symbols[a] + symbols[b]))

    for k in range(n - 1):
        offer(k, k + 1)
    last = None
    while queue:
        _, a, b, whole = heapq.heappop(queue)
        if not symbols[a] or not symbols[b] or symbols[a] + symbols[b] != whole or right[a] != b:
            continue
        last = symbols[a], symbols[b]
        symbols[a], symbols[b] = whole, ""
        right[a] = right[b]
        if right[b] >= 0:
            left[right[b]] = a
        offer(left[a], a)
        offer(a, right[a])
    return [s for s in symbols if s], last


@dataclass(frozen=True)
class Vocabulary:
    """Plain arrays, shipped to the executors. Ids from `unknown` on don't exist; unknown stands for any other character."""

    pieces: list[bytes]  # by id, spaces as 0x20; byte pieces as their byte
    byte_id: np.ndarray  # 256 ids
    space_score: dict[str, float]  # of runs of spaces
    space_id: dict[str, int]
    id: np.ndarray  # of the pieces that may occur, by their bytes
    text: list[bytes]
    time: np.ndarray  # by id: -1 for single characters, else the order of merges
    left: np.ndarray
    right: np.ndarray
    pair: np.ndarray  # sorted left * size + right of all merges
    pair_time: np.ndarray

    @property
    def unknown(self) -> int:
        return len(self.pieces)

    @cached_property
    def widest(self) -> int:
        return max(len(t) for t in self.text)

    @cached_property
    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest 8 bytes with which each piece may begin, as big-endian numbers."""
        low, high = (np.frombuffer(b"".join(t[:8].ljust(8, fill) for t in self.text), ">u8").astype(np.uint64) for fill in (b"\0", b"\xff"))
        return low, high


def load(path: str | None = None) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
    size = model.get_piece_size()
    raw, score, byte_id, pieces = {}, {}, np.zeros(256, np.int32), []
    for k in range(size):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            byte = int(piece[3:5], 16)
            byte_id[byte] = k
            pieces.append(bytes([byte]))
            continue
        plain = not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k))
        pieces.append(piece.replace(MARK, " ").encode() if plain else b"")
        if plain:
            raw[piece.replace(MARK, " ")], score[piece.replace(MARK, " ")] = k, model.get_score(k)
    spaces = {p for p in raw if len(p) > 1 and not p.strip(" ")}
    words = {p: s for p, s in score.items() if p not in spaces}
    if any(" " in p[1:] for p in words):
        raise ValueError("a piece holds a space after other characters: units would not be independent")
    time, left, right = np.full(size + 1, -1, np.int64), np.full(size + 1, size, np.int64), np.full(size + 1, size, np.int64)
    merges = sorted((p for p in words if len(p) > 1), key=lambda p: (-words[p], raw[p]))
    found = [p for p in words if len(p) == 1]
    for order, piece in enumerate(merges):
        whole, last = merged(list(piece), words)
        if whole == [piece] and last[0] in raw and last[1] in raw:
            found.append(piece)
            time[raw[piece]], left[raw[piece]], right[raw[piece]] = order, raw[last[0]], raw[last[1]]
    own = np.flatnonzero(time >= 0)
    pair = left[own] * (size + 1) + right[own]
    order = np.argsort(pair)
    found.sort(key=lambda p: p.encode())
    return Vocabulary(pieces, byte_id, {p: score[p] for p in spaces}, {p: raw[p] for p in spaces | {" "}}, np.array([raw[p] for p in found]), [p.encode() for p in found], time, left, right, pair[order], time[own][order])


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.cache = IdCache(self.units)
        self._runs: dict[int, list[int]] = {}
        self._may: dict[tuple[int, int], bool] = {}

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b can stand side by side."""
        v, size = self.v, self.v.unknown + 1
        fine = np.ones(len(a), bool)
        at, x, y, limit = np.arange(len(a)), a.copy(), b.copy(), np.full(len(a), 1 << 40)
        while len(at):
            key = x * size + y
            k = np.searchsorted(v.pair, key)
            k[k == len(v.pair)] = 0
            crossed = (v.pair[k] == key) & (v.pair_time[k] < limit)
            fine[at[crossed]] = False
            tx, ty = v.time[x], v.time[y]
            on = ~crossed & (np.maximum(tx, ty) >= 0)
            first = tx > ty
            limit = np.where(first, tx, ty + 1)[on]
            x, y, at = np.where(first, v.right[x], x)[on], np.where(first, y, v.left[y])[on], at[on]
        return fine

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and piece of every occurrence of a piece in the text, from the suffix array of the text."""
        v, n = self.v, len(text)
        padded = np.concatenate([text, np.zeros(v.widest + 16, np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").ravel().astype(np.uint64)
        _, rank = np.unique(eight, return_inverse=True)
        width = 8
        while width < v.widest:
            pair = rank.astype(np.uint64) << np.uint64(32)
            pair[:-width] |= rank[width:].astype(np.uint64)
            _, rank = np.unique(pair, return_inverse=True)
            width *= 2
        suffix = np.argsort(rank[:n], kind="stable")
        head = eight[suffix]
        low, high = v.keys
        begin, end = np.searchsorted(head, low, "left"), np.searchsorted(head, high, "right")
        size = np.array([len(t) for t in v.text])
        for k in np.flatnonzero((size > 8) & (end > begin)).tolist():  # further bytes, eight at a time
            a, b, piece = begin[k], end[k], v.text[k]
            for j in range(8, len(piece), 8):
                rest = eight[np.minimum(suffix[a:b] + j, len(eight) - 1)]
                part = piece[j : j + 8]
                a, b = a + np.searchsorted(rest, np.uint64(int.from_bytes(part.ljust(8, b"\0")))), a + np.searchsorted(rest, np.uint64(int.from_bytes(part.ljust(8, b"\xff"))), "right")
            begin[k], end[k] = a, b
        count = np.maximum(end - begin, 0)
        return suffix[runs(begin, count)], np.repeat(np.arange(len(v.text)), count)

    def relax(self, cores: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat pieces (or unknown) of each core, and where they begin in the cores joined by one byte."""
        v = self.v
        text = np.frombuffer(b"\0".join(cores) + b"\0", np.uint8)
        size = np.array([len(c) for c in cores])
        start = np.cumsum(size + 1) - size - 1
        inside = np.ones(len(text), bool)
        inside[start + size] = False
        position, found = self.edges(text)
        piece, length = v.id[found], np.array([len(t) for t in v.text])[found]
        single = np.zeros(len(text), bool)
        single[position[v.time[piece] < 0]] = True
        strange = np.flatnonzero(LEAD[text] & inside & ~single)
        if len(strange):
            lead = text[strange]
            position, piece = np.concatenate([position, strange]), np.concatenate([piece, np.full(len(strange), v.unknown)])
            length = np.concatenate([length, 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)])
        end = position + length
        core = np.repeat(np.arange(len(cores)), size + 1)[position]
        last, back = np.full(len(text) + 1, -1), np.full(len(text) + 1, -1)
        together = size[core] <= TOGETHER
        depth = end - start[core]
        order = np.flatnonzero(together)
        order = order[np.argsort(depth[order], kind="stable")]
        for group in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else ():
            p, t = position[group], piece[group]
            fine = p == start[core[group]]
            some = np.flatnonzero(~fine)
            fine[some] = self.may_follow(last[p[some]], t[some])
            last[end[group[fine]]], back[end[group[fine]]] = t[fine], p[fine]
        order = np.flatnonzero(~together)
        order = order[np.argsort(end[order], kind="stable")]
        first = set(start.tolist())
        if len(self._may) > 500_000:
            self._may.clear()
        for p, t, e in zip(position[order].tolist(), piece[order].tolist(), end[order].tolist(), strict=True):
            if p not in first:
                pair = int(last[p]), t
                if pair not in self._may:
                    self._may[pair] = bool(self.may_follow(np.array(pair[:1]), np.array(pair[1:]))[0])
                if not self._may[pair]:
                    continue
            last[e], back[e] = t, p
        begins = np.full(len(text) + 1, -1)
        at = start + size
        at = at[size > 0]
        while len(at):
            begins[back[at]] = last[at]
            at = back[at]
            at = at[back[at] >= 0]
        where = np.flatnonzero(begins >= 0)
        return begins[where], where

    def spaces(self, n: int) -> list[int]:
        if n not in self._runs:
            self._runs[n] = [self.v.space_id[s] for s in merged([" "] * n, self.v.space_score)[0]]
        return self._runs[n]

    def units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units (spaces, then others)."""
        v = self.v
        lead = [len(u) - len(u.lstrip(b" ")) for u in units]
        cores = [b" " + u[n:] if n < len(u) else b"" for u, n in zip(units, lead, strict=True)]
        pieces, where = self.relax(cores)
        size = np.array([len(c) for c in cores])
        start = np.cumsum(size + 1) - size - 1
        count = np.diff(np.append(np.searchsorted(where, start), len(where)))
        # unknown characters become their bytes
        raw = np.frombuffer(b"\0".join(cores) + b"\0", np.uint8)
        strange = pieces == v.unknown
        width = np.where(strange, 1 + (raw[where] >= 0xC0) + (raw[where] >= 0xE0) + (raw[where] >= 0xF0), 1)
        flat = np.repeat(pieces, width)
        if strange.any():
            flat[np.repeat(strange, width)] = v.byte_id[raw[runs(where[strange], width[strange])]]
            count = np.add.reduceat(np.append(width, 0), np.minimum(np.cumsum(count) - count, len(width))) * (count > 0)
        flat, count = flat.astype(np.int32), count.astype(np.int64)
        odd = [k for k, (n, c) in enumerate(zip(lead, cores, strict=True)) if n > 1 or not c]
        if odd:
            each = np.split(flat, np.cumsum(count)[:-1])
            for k in odd:
                own, n = each[k], lead[k]
                if len(own) and own[0] != v.space_id[" "]:
                    each[k] = np.concatenate([self.spaces(n - 1), own])
                else:
                    each[k] = np.concatenate([self.spaces(n), own[1:]])
            count = np.array([len(e) for e in each], np.int64)
            flat = np.concatenate(each).astype(np.int32)
        return flat, count

    def encode(self, texts: pa.Array) -> pa.Array:
        none = texts.is_null()
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for text in parts(texts):
            _, end = text.words(NO_SPACE)
            # a unit ends where its last word does; spaces at the end of a text are a unit too
            edge = text.off[1:][np.diff(text.off) > 0]
            end = np.union1d(end, edge)
            begin = np.concatenate([[0], end[:-1]]) if len(end) else end
            place, n = self.cache.look_up(text, begin, end)
            flat.append(self.cache.flat[runs(place, n)])
            total = np.concatenate([[0], np.cumsum(n)])
            at = np.searchsorted(end, text.off, "right")
            counts.append(np.diff(total[at]))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(none.to_numpy(zero_copy_only=False), False)) if none.null_count or pc.any(none).as_py() else pa.array(offsets), pa.array(np.concatenate(flat)))


_encoder: list[Encoder] = []


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder, with its cache, for a worker's life."""
    if not _encoder or _encoder[0].v is not vocabulary:
        _encoder[:] = [Encoder(vocabulary)]
    return _encoder[0]


def decode_ids(ids: pa.Array, v: Vocabulary) -> pa.Array:
    """Texts of lists of ids; bytes that aren't UTF-8 become U+FFFD."""
    size = np.array([len(p) for p in v.pieces])
    start = np.cumsum(size) - size
    table = np.frombuffer(b"".join(v.pieces), np.uint8)
    flat = ids.flatten().to_numpy()
    n = np.diff(np.concatenate([[0], np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy())]))
    out, at, k, total = [], 0, 0, np.concatenate([[0], np.cumsum(n)])
    while k < len(n):
        j = max(k + 1, int(np.searchsorted(total, total[k] + (1 << 19), "right")) - 1)
        part = flat[total[k] : total[j]]
        raw = table[runs(start[part], size[part])].tobytes()
        ends = np.concatenate([[0], np.cumsum(size[part])])[total[k : j + 1] - total[k]]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            # the encoder put a space before the text
            out.append(raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace"))
        k = j
    return pa.array([None if m else t for t, m in zip(out, ids.is_null().to_pylist(), strict=True)], pa.string())


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or load())
    ids = F.arrow_udf(lambda texts: encoder(shared.value).encode(texts), T.ArrayType(T.IntegerType(), False)).asNondeterministic()
    return pick(docs, doc_id=id, text=text).withColumn("ids", ids("text"))


def decode(rows: DataFrame, vocabulary: Vocabulary | None = None, ids: str = "ids") -> DataFrame:
    """rows with the column decoded."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary or load())
    return rows.withColumn("decoded", F.arrow_udf(lambda x: decode_ids(x, shared.value), T.StringType())(ids))


def _crc(ids: pa.Array) -> pa.Array:
    raw = ids.flatten().to_numpy().astype("<u4").tobytes()
    ends = np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy())
    return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.int64())


def digest(docs: DataFrame, vocabulary: Vocabulary | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned ids), decoded_chars, round_trip: every text encoded, its ids decoded, and both compared."""
    vocabulary = vocabulary or load()
    rows = decode(encode(docs, vocabulary, id, text), vocabulary)
    same = F.col("decoded") == F.replace("text", F.lit(MARK), F.lit(" "))
    return rows.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.arrow_udf(_crc, T.LongType())("ids").alias("ids_crc32"), F.coalesce(F.length("decoded"), F.lit(0)).cast("long").alias("decoded_chars"), F.coalesce(same, F.lit(True)).alias("round_trip"))
