"""Unigram pieces: a double-array trie with log scores, Viterbi encoding and decoding.

A text is encoded as its most likely sequence of pieces. Spaces are written as the marker U+2581, one is
put in front, and a character that no piece covers falls back to the pieces of its UTF-8 bytes, at a
score ``UNKNOWN_PENALTY`` below the lowest one. Of equal scores the path whose last piece is longest
wins, at every position.

No piece holds a marker after another character, and none crosses a character that only bytes can
write, so the best path falls apart at those places. The parts between them recur, so a worker
solves each distinct one once, many at a time: the trie is walked for all of them by array steps.

The vocabulary is given by its pieces in order of frequency. Its file holds merge ranks and not
probabilities, so the log score of a rank follows Zipf's law, in steps of 1/1024; sums are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.registry import query, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10 * 1024
_LOW = np.int64(-(1 << 60))
_CACHE = 250_000


def load_pieces(path: str = MODEL) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces, their scores in 1/1024 and the ids of the 256 byte pieces; control pieces score nothing."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    usable = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(size)]
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    rank = np.cumsum(usable)
    scores = np.where(usable, np.round(-1024 * np.log(rank + 1.0)), 0).astype(np.int64)
    return [p if u else "" for p, u in zip(pieces, usable)], scores, byte_ids


def double_array(pieces: list[str]) -> dict[str, np.ndarray]:
    """Trie over code points in two arrays: the child of ``node`` by ``code`` is at base[node] + code.

    ``check`` names each slot's parent, ``value`` the piece that ends there, or -1. Codes go by frequency,
    so that children lie close together.
    """
    counts: dict[str, int] = {}
    for c in "".join(pieces):
        counts[c] = counts.get(c, 0) + 1
    letters = sorted(counts, key=lambda c: (-counts[c], c))
    code_of = {c: i for i, c in enumerate(letters, 1)}
    tree: list[dict[int, int]] = [{}]
    ends = {}
    for number, piece in enumerate(pieces):
        at = 0
        for c in piece:
            at = tree[at].setdefault(code_of[c], len(tree))
            if at == len(tree):
                tree.append({})
        if piece:
            ends[at] = number
    room = 2 * len(tree) + 2 * len(letters) + 8192
    base, check, value = (np.full(room, fill, np.int64) for fill in (0, -1, -1))
    place, taken, free = {0: 0}, np.zeros(room, bool), 1
    taken[0] = True
    for node in range(len(tree)):
        here = place.pop(node)
        value[here] = ends.get(node, -1)
        if not tree[node]:
            continue
        children = np.array(sorted(tree[node]), np.int64)
        start, found = max(free, int(children[0])), np.empty(0, np.int64)
        while not len(found):
            offers = start + np.flatnonzero(~taken[start:start + 512]) - children[0]
            found = offers[~taken[offers[:, None] + children].any(axis=1)]
            start += 512
        slots = int(found[0]) + children
        base[here], taken[slots], check[slots] = int(found[0]), True, here
        place.update(zip((tree[node][int(c)] for c in children), slots.tolist()))
        while taken[free]:
            free += 1
    return {"letters": np.array([ord(c) for c in letters], np.int64), "base": base, "check": check, "value": value}


def part_pattern(pieces: list[str]) -> re.Pattern:
    """Parts of a marked text that no piece crosses."""
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("pieces with a marker after another character are not supported")
    inside = "".join(re.escape(c) for c in sorted({c for p in pieces for c in p} - {MARK}))
    return re.compile(f"{MARK}*[{inside}]+|{MARK}+|." if inside else f"{MARK}+|.", re.DOTALL)


class Unigram:
    """Encodes and decodes with one vocabulary; ``encode`` and ``decode`` are inverse for any text."""

    def __init__(self, pieces: list[str], scores: np.ndarray, byte_ids: np.ndarray,
                 trie: dict[str, np.ndarray] | None = None):
        self.scores, self.byte_ids = scores, byte_ids
        self.trie = trie or double_array(pieces)
        self.codes = np.zeros(0x110000, np.int32)
        self.codes[self.trie["letters"]] = np.arange(1, len(self.trie["letters"]) + 1)
        used = [s for s, p in zip(scores, pieces) if p]
        self.unknown = int(min(used, default=0)) - UNKNOWN_PENALTY
        self.longest = max(map(len, pieces), default=1)
        self.parts = part_pattern(pieces)
        data = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            data[i] = bytes([b])
        self.widths = np.array([len(d) for d in data], np.int64)
        self.bytes = np.frombuffer(b"".join(data), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.widths)[:-1]])
        self.cache: dict[str, bytes] = {}

    def solve(self, parts: list[str]) -> list[bytes]:
        """Best piece ids (int32) of each part, all parts at once; parts of like length share the steps."""
        out = [b""] * len(parts)
        order = sorted(range(len(parts)), key=lambda k: len(parts[k]))
        start = 0
        while start < len(order):
            stop, longest = start + 1, len(parts[order[start]])
            while stop < len(order) and len(parts[order[stop]]) <= longest + 2 and stop - start < 20_000:
                stop += 1
            chosen = order[start:stop]
            for k, ids in zip(chosen, self._solve([parts[k] for k in chosen])):
                out[k] = ids
            start = stop
        return out

    def _solve(self, parts: list[str]) -> list[bytes]:
        n, sizes = len(parts), np.array([len(p) for p in parts])
        width = int(sizes.max())
        points = np.frombuffer("".join(p.ljust(width, "\0") for p in parts).encode("utf-32-le"), np.uint32)
        codes = self.codes[points].reshape(n, width)
        base, check, value = self.trie["base"], self.trie["check"], self.trie["value"]
        best = np.full((n, width + 1), _LOW)
        best[:, 0] = 0
        back = np.zeros((n, width + 1), np.int32)
        piece = np.full((n, width + 1), -1, np.int32)
        for at in range(width):
            # A character by itself, for where no one-character piece exists.
            rows = np.flatnonzero(sizes > at)
            single = np.zeros(len(rows), bool)
            live, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for length in range(1, min(self.longest, width - at) + 1):
                who = rows[live]
                code = codes[who, at + length - 1]
                there = np.minimum(base[node] + code, len(check) - 1)
                ok = (code > 0) & (check[there] == node) & (sizes[who] >= at + length)
                live, node, who = live[ok], there[ok], who[ok]
                if not len(live):
                    break
                number = value[node]
                hit = number >= 0
                if length == 1:
                    single[live[hit]] = True
                self._reach(best, back, piece, who[hit], at, at + length, self.scores[number[hit]], number[hit])
            lone = rows[~single]
            self._reach(best, back, piece, lone, at, at + 1, np.full(len(lone), self.unknown), np.full(len(lone), -1))
        return self._paths(parts, sizes, back, piece)

    @staticmethod
    def _reach(best, back, piece, rows, start, end, gain, number):
        total = best[rows, start] + gain
        better = total > best[rows, end]  # starts come in rising order, so of equals the longest last piece stays
        rows = rows[better]
        best[rows, end], back[rows, end], piece[rows, end] = total[better], start, number[better]

    def _paths(self, parts: list[str], sizes: np.ndarray, back: np.ndarray, piece: np.ndarray) -> list[bytes]:
        """Follow the best paths from their ends, all at once; pieces are filled in from the right."""
        n, width = len(parts), back.shape[1] - 1
        ids, begins = np.zeros((n, width), np.int32), np.zeros((n, width), np.int32)
        at, rows, step = sizes.copy(), np.arange(n), width
        count = np.zeros(n, np.int64)
        while len(rows):
            step -= 1
            ids[rows, step] = piece[rows, at[rows]]
            begins[rows, step] = at[rows] = back[rows, at[rows]]
            count[rows] += 1
            rows = rows[at[rows] > 0]
        out = []
        for k, strange in enumerate((ids < 0).any(axis=1).tolist()):
            own = ids[k, width - count[k]:]
            if strange:
                edges = [*begins[k, width - count[k]:].tolist(), len(parts[k])]
                pieces = [[i] if i >= 0 else self.byte_ids[list(parts[k][a:b].encode())]
                          for i, a, b in zip(own.tolist(), edges, edges[1:])]
                own = np.concatenate(pieces).astype(np.int32)
            out.append(own.tobytes())
        return out

    def split(self, text: str) -> list[str]:
        return self.parts.findall((" " + text).replace(" ", MARK)) if text else []

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(t) for t in texts]
        if len(self.cache) > _CACHE:
            self.cache.clear()
        new = list({p for parts in split for p in parts} - self.cache.keys())
        self.cache.update(zip(new, self.solve(new)))
        return [np.frombuffer(b"".join(map(self.cache.__getitem__, parts)), np.int32) for parts in split]

    def decode(self, ids: np.ndarray) -> str:
        """Pieces to bytes, markers to spaces, without the space in front."""
        widths = self.widths[ids]
        if not widths.sum():
            return ""
        first = np.repeat(self.starts[ids] - np.concatenate([[0], np.cumsum(widths)[:-1]]), widths)
        raw = self.bytes[first + np.arange(len(first))].tobytes()
        return raw[1:].decode(errors="replace") if raw[:1] == b" " else raw.decode(errors="replace")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per document: doc_id, n_tokens, token_ids, round_trip (decoding gives the text again).

    Null and empty texts have no tokens and decode to the empty text. A text that holds the marker
    itself is encoded like one with a space there, as its decoded form, and is the one case without a
    round trip. Whole texts are encoded where they lie, without a shuffle; repeated rows give equal
    rows. Only the id and the text are read.
    """
    vocabulary = load_pieces(model)
    shared = docs.sparkSession.sparkContext.broadcast((*vocabulary, double_array(vocabulary[0])))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Unigram(*shared.value)
        for batch in batches:
            for part in _slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = coder.encode_all(texts)
                same = [coder.decode(i) == t for i, t in zip(ids, texts)]
                sizes = np.array([len(i) for i in ids], np.int32)
                flat = np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes.astype(np.int64)), lists, pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "token_ids", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        encode, f"doc_id {kind}, n_tokens long, token_ids array<int>, round_trip boolean")


def _slices(batch: pa.RecordBatch, letters: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text each, whole rows only."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    cut = np.cumsum(size) // letters
    edges = np.flatnonzero(np.diff(cut, prepend=-1))
    for start, end in zip(edges, [*edges[1:], len(size)]):
        yield batch.slice(start, end - start)


@query("op1_sentencepiece")
def op1_sentencepiece(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"))
