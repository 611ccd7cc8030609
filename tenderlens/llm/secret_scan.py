"""Secret scan by inferred credential grammars.

Patterns find labelled credentials (assignments, access keys, hex digests). From a bounded sample of
each kind a probabilistic automaton is inferred: a prefix tree of the values whose states are merged
where their outgoing frequencies do not differ significantly (Hoeffding bound), which generalises the
values to a format. Ordinary long tokens are described by how often a class of characters follows another,
counted over all candidates but those in a credential format. Every candidate token of every text is then scored: how much likelier is it under the best credential format than under the
ordinary one? Those beyond a threshold are added to what the patterns found.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.registry import query, table, text_or_empty

MAX_TRAIN = 400            # values a kind that a grammar is inferred from, those with the smallest hash
MIN_SCORE = 14.0           # nats by which a candidate must be likelier under a credential format
# What counts as a labelled credential, in the order of the kinds.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

# Characters by class; a class is one symbol of the grammars, its characters are equally likely.
_CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}
_CLASS_OF = {c: name for name, chars in _CLASSES.items() for c in chars}
_WITHIN = {name: -math.log(len(chars)) for name, chars in _CLASSES.items()}
_ANY = -math.log(70)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the labelled credentials, leftmost and without overlap per kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, spans: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Long tokens that touch no labelled credential; ``spans`` are in order of their starts."""
    at = reach = 0
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= m.start():
            yield m.start(), m.end(), m[0]


def infer(values: list[str], alpha: float = 0.05) -> list[dict]:
    """Automaton as a list of states: symbol -> (next state, log probability), "" -> (-1, log P(end)).

    States of the prefix tree are merged in breadth-first order with the first settled state they are
    compatible with; a merge folds the subtrees together.
    """
    children: list[dict[str, int]] = [{}]
    arcs: list[dict[str, int]] = [{}]
    ends, total = [0], [0]
    for value in sorted(values):
        at = 0
        total[0] += 1
        for c in value:
            symbol = _CLASS_OF.get(c, c)
            following = children[at].get(symbol)
            if following is None:
                following = children[at][symbol] = len(children)
                children.append({})
                arcs.append({})
                ends.append(0)
                total.append(0)
            arcs[at][symbol] = arcs[at].get(symbol, 0) + 1
            at = following
            total[at] += 1
        ends[at] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differs(a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(one: int, two: int) -> bool:
        todo, seen = [(one, two)], {(one, two)}
        while todo:
            a, b = todo.pop()
            if differs(ends[a], total[a], ends[b], total[b]):
                return False
            for symbol in children[a].keys() | children[b].keys():
                if differs(arcs[a].get(symbol, 0), total[a], arcs[b].get(symbol, 0), total[b]):
                    return False
                if symbol in children[a] and symbol in children[b]:
                    pair = children[a][symbol], children[b][symbol]
                    if pair[0] != pair[1] and pair not in seen:
                        seen.add(pair)
                        todo.append(pair)
        return True

    def fold(into: int, what: int) -> None:
        todo = [(into, what)]
        while todo:
            a, b = todo.pop()
            ends[a] += ends[b]
            total[a] += total[b]
            for symbol, following in children[b].items():
                arcs[a][symbol] = arcs[a].get(symbol, 0) + arcs[b][symbol]
                if symbol in children[a]:
                    if children[a][symbol] != following:
                        todo.append((children[a][symbol], following))
                else:
                    children[a][symbol] = following

    settled, border = [0], [(0, s) for s in sorted(children[0])]
    while border:
        parent, symbol = border.pop(0)
        state = children[parent][symbol]
        if state in settled:
            continue
        twin = next((r for r in settled if compatible(r, state)), None)
        if twin is None:
            settled.append(state)
            border += [(state, s) for s in sorted(children[state])]
        else:
            children[parent][symbol] = twin
            fold(twin, state)
            border += [(twin, s) for s in sorted(children[twin]) if (twin, s) not in border and children[twin][s] not in settled]
    number = {state: i for i, state in enumerate(settled)}
    out = []
    for state in settled:
        whole = total[state] + 1e-9
        row = {s: (number[children[state][s]], math.log(n / whole)) for s, n in arcs[state].items()}
        row[""] = (-1, math.log(max(ends[state], 1e-3) / whole))
        out.append(row)
    return out


def likelihood(automaton: list[dict], value: str) -> float:
    """Log probability of a value; one that takes a step the automaton has not seen is impossible."""
    state, score = 0, 0.0
    for c in value:
        symbol = _CLASS_OF.get(c, c)
        step = automaton[state].get(symbol)
        if step is None:
            return -math.inf
        state = step[0]
        score += step[1] + _WITHIN.get(symbol, 0.0)
    return score + automaton[state][""][1]


def format_score(grammars: dict[str, list[dict]], value: str) -> float:
    """Nats by which the value is likelier under the best credential grammar than otherwise.

    Otherwise means as an ordinary token or as characters drawn at random, whichever is likelier.
    """
    credential = max((likelihood(g, value) for kind, g in grammars.items() if kind != "ordinary"), default=-math.inf)
    ordinary = likelihood(grammars["ordinary"], value) if "ordinary" in grammars else -math.inf
    return credential - max(ordinary, len(value) * _ANY)


def chain(counts: dict[tuple[str, str], int]) -> list[dict]:
    """Automaton with a state for each symbol before, from (symbol before, symbol) -> count.

    "" stands for the start and the end. Every step counts once more than seen, so none is impossible.
    """
    symbols = [*_CLASSES, *"+/_=-"]
    out = []
    for before in ("", *symbols):
        row = {s: counts.get((before, s), 0) + 1 for s in ("", *symbols)}
        whole = sum(row.values())
        out.append({s: (symbols.index(s) + 1 if s else -1, math.log(n / whole)) for s, n in row.items()})
    return out


def ordinary_grammar(docs: DataFrame, grammars: dict[str, list[dict]], text_col: str = "text",
                     min_score: float = MIN_SCORE) -> list[dict] | None:
    """Steps of all candidates but those that a credential grammar tells from random characters.

    However often an unlabelled credential of a known format occurs, its format does not become ordinary.
    None if there are no other candidates.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammars)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammars, counts, steps = shared.value, Counter(), {}
        for frame in batches:
            for text in frame["text"]:
                for _, _, value in candidates(text, base_spans(text)):
                    own = steps.get(value)
                    if own is None:
                        if len(steps) > 100_000:
                            steps.clear()
                        symbols = ["", *(_CLASS_OF.get(c, c) for c in value), ""]
                        accepted = format_score(grammars, value) >= min_score
                        own = steps[value] = () if accepted else tuple(zip(symbols, symbols[1:]))
                    counts.update(own)
        yield pd.DataFrame([(*step, n) for step, n in counts.items()], columns=["before", "symbol", "n"])

    found = docs.select(text_or_empty(text_col).alias("text")).mapInPandas(count, "before string, symbol string, n long")
    rows = found.groupBy("before", "symbol").agg(F.sum("n").alias("n")).collect()
    return chain({(r["before"], r["symbol"]): r["n"] for r in rows}) if rows else None


def learn_grammars(docs: DataFrame, text_col: str = "text", max_train: int = MAX_TRAIN) -> dict[str, list[dict]]:
    """Grammars by kind from the ``max_train`` distinct labelled values of each kind with the smallest hash,
    and the ordinary one from all other tokens.

    Every task reads all its texts and sends on no more than that many values a kind.
    """
    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, list] = {}
        known: set[tuple[str, str]] = set()

        def offer(kind: str, value: str) -> None:
            heap = kept.setdefault(kind, [])
            rank = -(xxhash.xxh3_64_intdigest(value.encode()) >> 1)
            if (len(heap) < max_train or rank > heap[0][0]) and (kind, value) not in known:
                known.add((kind, value))
                (heapq.heappush if len(heap) < max_train else heapq.heappushpop)(heap, (rank, value))

        for frame in batches:
            for text in frame["text"]:
                for _, kind, _, value in base_spans(text):
                    offer(KINDS[kind], value)
        rows = [(kind, -rank, value) for kind, heap in kept.items() for rank, value in heap]
        yield pd.DataFrame(rows, columns=["kind", "rank", "value"])

    values = docs.select(text_or_empty(text_col).alias("text")).mapInPandas(sample, "kind string, rank long, value string")
    values = values.distinct().persist()
    try:
        grammars = {}
        for kind in KINDS[:3]:
            rows = values.filter(F.col("kind") == kind).orderBy("rank", "value").limit(max_train).collect()
            if rows:
                grammars[kind] = infer([r["value"] for r in rows])
    finally:
        values.unpersist()
    ordinary = ordinary_grammar(docs, grammars, text_col)
    return grammars | {"ordinary": ordinary} if ordinary else grammars


def scan_secrets(docs: DataFrame, grammars: dict[str, list[dict]], id_col: str = "doc_id", text_col: str = "text",
                 min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document with ``found``: array of (kind, start, end, score), by start and kind.

    Positions count code points, ends are exclusive. Kind ``format`` marks what only the grammars found;
    their score is the likelihood ratio, that of a labelled credential is null. Null and empty texts give
    an empty array. Whole texts are scanned where they lie; repeated rows give equal rows; only the id and
    the text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammars)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammars, scores = shared.value, {}
        for frame in batches:
            out = []
            for text in frame["text"]:
                spans = base_spans(text)
                found = [(start, number, end, None) for start, number, end, _ in spans]
                for start, end, value in candidates(text, spans):
                    score = scores.get(value)
                    if score is None:
                        if len(scores) > 500_000:
                            scores.clear()
                        score = scores[value] = format_score(grammars, value)
                    if score >= min_score:
                        found.append((start, 3, end, score))
                out.append([{"kind": KINDS[n], "start": s, "end": e, "score": x} for s, n, e, x in
                            sorted(found, key=lambda f: f[:2])])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "found": out})

    plain = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return plain.mapInPandas(scan, f"doc_id {kind}, found array<struct<kind:string,start:int,end:int,score:double>>")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the labelled spans and all spans as text."""
    labelled = F.filter("found", lambda x: x["kind"] != "format")
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[of(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(shown(labelled), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"),
        of("format").alias("n_format"))


@query("op7_secret_grammar")
def op7_secret_grammar(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return span_digest(scan_secrets(docs, learn_grammars(docs)))
