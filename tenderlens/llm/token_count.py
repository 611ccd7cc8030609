"""Token counts by a Viterbi pass that carries only the best score and the number of pieces.

An Aho-Corasick automaton of the vocabulary finds all pieces that end at a position, longest first; the
first of equal scores is kept, as the encoder does, so the counts are those of the encoder. A character
without a piece counts its UTF-8 bytes. Distinct parts are counted once per worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.registry import query, table
from tenderlens.llm.unigram import MARK, MODEL, UNKNOWN_PENALTY, load_pieces, part_pattern

_CACHE = 1_000_000


class Counter:
    """Number of pieces and best score of a text; ``seen`` remembers both per part."""

    def __init__(self, pieces: list[str], scores: np.ndarray):
        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(pieces, scores.tolist()):
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = int(min((s for s, p in zip(scores, pieces) if p), default=0)) - UNKNOWN_PENALTY
        self.parts = part_pattern(pieces)
        self.seen: dict[str, tuple[int, int]] = {}

    def part(self, part: str) -> tuple[int, int]:
        best: list[int | None] = [0] + [None] * len(part)
        count = [0] * (len(part) + 1)
        found: list[list[tuple[int, int]]] = [[] for _ in part]
        for end, match in self.automaton.iter(part):
            found[end].append(match)
        for end, matches in enumerate(found, 1):
            top = None
            for length, score in matches:
                total = best[end - length] + score
                if top is None or total > top:
                    top, count[end] = total, count[end - length] + 1
            if not matches or matches[-1][0] > 1:
                total = best[end - 1] + self.unknown
                if top is None or total > top:
                    top, count[end] = total, count[end - 1] + len(part[end - 1].encode())
            best[end] = top
        return count[-1], best[-1]

    def text(self, text: str) -> tuple[int, int]:
        if not text:
            return 0, 0
        if len(self.seen) > _CACHE:
            self.seen.clear()
        seen, pieces, score = self.seen, 0, 0
        for part in self.parts.findall((" " + text).replace(" ", MARK)):
            known = seen.get(part)
            if known is None:
                known = seen[part] = self.part(part)
            pieces += known[0]
            score += known[1]
        return pieces, score


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per document: doc_id, n_tokens, log_score of the best segmentation.

    Null and empty texts have 0 tokens and score 0. Whole texts are counted where they lie, without a
    shuffle; repeated rows give equal rows. Only the id and the text are read.
    """
    pieces, scores, _ = load_pieces(model)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, scores))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for batch in batches:
            both = [counter.text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in both], pa.int64()),
                 pa.array([s / 1024 for _, s in both], pa.float64())], ["doc_id", "n_tokens", "log_score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        count, f"doc_id {kind}, n_tokens long, log_score double")


@query("op9_token_count")
def op9_token_count(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
