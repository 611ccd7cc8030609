"""Conversation structure repair: the cheapest edits, and of equally cheap ones the first audit.

A conversation should read ``(s?(ua)+)?`` in role initials. The automaton of that pattern has four
states; every row is kept, reroled or deleted, and a turn may be inserted before it. A dynamic program
over the rows carries, per state, the lowest cost and a persistent audit: a node that links to
the audit it extends, so all states share their common prefixes. Equal costs are settled by the audits: binary lifting over ancestors
with rolling hashes finds the longest common prefix, whose equality is verified letter by letter
(once per pair of nodes), and the letter after it decides.

One row's edits form a token (``D``, ``IK``, ``IR``, ``K`` or ``R``; no more than one insertion pays before a row, and none
before a deletion, which may as well come first). No token starts another, so audits of the
same rows are compared token by token, and a stretch of rows can be solved by itself: for each pair of
states, lowest cost and first audit, and the rank of these audits among each other. Ranks are the letters
when stretches are put together. So a conversation may be of any length: rows are
range-partitioned in their order, a conversation that lies in several slices gives one such table for each
slice, and only these meet, no more than two a slice.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.registry import query, settled_table, table
from tenderlens.session import materialise

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
TOKENS = ["D", "IK", "IR", "K", "R"]                        # in ASCII order
RIGHT_PAIRS = ("su", "ua", "au")
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
STRETCH = 1024
_PRIME = (1 << 61) - 1
_BASE = 1_000_003
# What comes next: the turn to insert, and the turn to rerole to, without and with an insertion before.
_PLAIN = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_LETTER = {USER: "u", ASSISTANT: "a"}
CLOSING = {EMPTY: "", ASSISTANT: "", USER: "a", SYSTEM: "ua"}     # turns to insert at the end


class Audit:
    """A persistent list of letters: ``up[k]`` is the ancestor 2**k letters before."""

    __slots__ = ("up", "letter", "depth", "code", "twin", "note")

    def __init__(self, before: Audit | None, letter: int, note: object = None):
        self.letter, self.note, self.twin = letter, note, None
        if before is None:
            self.up, self.depth, self.code = [], 0, 0
            return
        self.depth, self.code = before.depth + 1, (before.code * _BASE + letter + 1) % _PRIME
        up, k = [before], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = up

    def notes(self) -> list:
        found, node = [], self
        while node.depth:
            found.append(node.note)
            node = node.up[0]
        return found[::-1]


def _known(node: Audit) -> Audit:
    while node.twin is not None:
        node = node.twin
    return node


def spells_same(a: Audit, b: Audit) -> bool:
    """Whether two audits of equal depth have the same letters; verified pairs are remembered."""
    seen = []
    while a is not b:
        a, b = _known(a), _known(b)
        if a is b or not a.depth:
            break
        if a.letter != b.letter:
            return False
        seen.append((a, b))
        a, b = a.up[0], b.up[0]
    for x, y in seen:
        x, y = _known(x), _known(y)
        if x is not y:
            x.twin = y
    return True


def compare(a: Audit, b: Audit) -> int:
    """Order of two audits of equal depth: -1, 0 or 1."""
    if a is b or (a.code == b.code and spells_same(a, b)):
        return 0
    x, y = a, b
    if a.code != b.code:
        for k in range(len(x.up) - 1, -1, -1):
            if k < len(x.up) and x.up[k].code != y.up[k].code:
                x, y = x.up[k], y.up[k]
        if not spells_same(x.up[0], y.up[0]):
            a, b, x = x.up[0], y.up[0], None    # a collision: the difference lies further up
    else:
        x = None
    if x is None:       # equal hashes of different audits: letter by letter
        while a.depth:
            if a.letter != b.letter:
                x, y = a, b
            a, b = a.up[0], b.up[0]
    return -1 if x.letter < y.letter else 1


def _better(new: tuple[int, Audit], old: tuple[int, Audit] | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and compare(new[1], old[1]) < 0)


@functools.lru_cache(maxsize=None)
def moves(initial: str, gone: bool, cut_off: bool) -> tuple[tuple[tuple[int, int, int, str], ...], ...]:
    """For each state: (next state, cost, token, edits) of what can be done with a row.

    Edits are D, K, U or A (reroled to user or assistant), after u or a for an inserted turn.
    """
    found = []
    for state in STATES:
        ways = [(state, DELETE, 0, "D")]
        if not gone:
            more = CUT_OFF * cut_off
            kept = _KEPT.get(initial, {})
            added = _PLAIN[state]
            if state in kept:
                ways.append((kept[state], more, 3, "K"))
            if added in kept:
                ways.append((kept[added], INSERT + more, 1, _LETTER[added] + "K"))
            ways.append((added, REROLE + more, 4, _LETTER[added].upper()))
            after = _PLAIN[added]
            ways.append((after, INSERT + REROLE + more, 2, _LETTER[added] + _LETTER[after].upper()))
        found.append(tuple(ways))
    return tuple(found)


class Stretch:
    """Best ways through some rows, for each pair of states: cost, edits of each row, and rank."""

    def __init__(self, rows: list[tuple[str, bool, bool, int]], starts=STATES):
        """``rows``: (role initial, must go, cut off, copies); all copies but the first must go."""
        self.best: dict[tuple[int, int], tuple[int, Audit]] = {}
        for start in starts:
            now = {start: (0, Audit(None, 0))}
            for initial, gone, cut_off, copies in rows:
                then: dict[int, tuple[int, Audit]] = {}
                ways = moves(initial, gone, cut_off)
                for state, (cost, audit) in now.items():
                    for after, price, token, edits in ways[state]:
                        old = then.get(after)
                        if old is not None and cost + price > old[0]:
                            continue
                        node = Audit(audit, token, edits)
                        if _better((cost + price, node), old):
                            then[after] = (cost + price, node)
                again = DELETE * (copies - 1)
                now = {s: (c + again, a) for s, (c, a) in then.items()} if again else then
            for end, found in now.items():
                self.best[start, end] = found
        self.rank = ranks({pair: audit for pair, (_, audit) in self.best.items()})

    def edits(self, start: int, end: int) -> list[str]:
        return self.best[start, end][1].notes()


def ranks(audits: dict) -> dict:
    """Place of each audit in their order, equal ones sharing theirs."""
    order = sorted(audits, key=functools.cmp_to_key(lambda a, b: compare(audits[a], audits[b])))
    found, place = {}, 0
    for before, key in zip([None, *order], order):
        place += before is not None and compare(audits[before], audits[key]) != 0
        found[key] = place
    return found


class Chain:
    """Stretches one after the other: the same program with ranks as letters."""

    def __init__(self, stretches: list, starts=STATES):
        self.best: dict[tuple[int, int], tuple[int, Audit]] = {}
        for start in starts:
            now = {start: (0, Audit(None, 0))}
            for costs, rank in stretches:
                then: dict[int, tuple[int, Audit]] = {}
                for (a, b), price in costs.items():
                    if a in now:
                        cost = now[a][0] + price
                        new = (cost, Audit(now[a][1], rank[a, b], (a, b)))
                        if _better(new, then.get(b)):
                            then[b] = new
                now = then
            for end, found in now.items():
                self.best[start, end] = found
        self.rank = ranks({pair: audit for pair, (_, audit) in self.best.items()})

    def costs(self) -> dict:
        return {pair: cost for pair, (cost, _) in self.best.items()}

    def end(self) -> int:
        """The best last state of a whole conversation, turns inserted at its end included."""
        done: tuple[int, Audit] | None = None
        state = EMPTY
        for (start, end), (cost, audit) in sorted(self.best.items()):
            if start == EMPTY:
                # The audits differ before the insertions at the end, so these cannot decide.
                new = (cost + INSERT * len(CLOSING[end]), audit)
                if _better(new, done):
                    done, state = new, end
        return state


class Piece:
    """The rows of one conversation in one slice."""

    def __init__(self, rows: list[tuple[str, bool, bool, int]], starts=STATES):
        self.rows = rows
        cuts = range(0, len(rows), STRETCH)
        self.stretches = [Stretch(rows[at:at + STRETCH], starts if at == 0 else STATES) for at in cuts]
        self.chain = Chain([({p: c for p, (c, _) in s.best.items()}, s.rank) for s in self.stretches], starts)

    def edits(self, start: int, end: int) -> list[str]:
        path = self.chain.best[start, end][1].notes()
        return [edit for s, (a, b) in zip(self.stretches, path) for edit in s.edits(a, b)]

    def illegal(self, before: str | None) -> int:
        """Adjacent rows whose initials are no right pair, the one before the piece included."""
        bad = 0
        for initial, _, _, copies in self.rows:
            bad += before is not None and before + initial not in RIGHT_PAIRS
            bad += (copies - 1) * (initial + initial not in RIGHT_PAIRS)
            before = initial
        return bad


def audit_of(edits: list[str], rows: list[tuple[str, bool, bool, int]]) -> str:
    plain = str.maketrans("uaUA", "IIRR")
    return "".join(e.translate(plain) + "D" * (r[3] - 1) for e, r in zip(edits, rows))


_ROW = ["initial", "gone", "cut_off", "copies"]


def _conversations(batches, columns: list[str]):
    """(number in the slice, conversation, values of ``columns`` per row) of a slice in its order."""
    number, current, rows = -1, None, []
    for batch in batches:
        values = zip(*(batch.column(c).to_pylist() for c in ("conv_id", *columns)))
        for conv, *row in values:
            if not rows or conv != current:
                if rows:
                    yield number, current, rows
                number, current, rows = number + 1, conv, []
            rows.append(row)
    if rows:
        yield number, current, rows


def _ends_of_slices(batches):
    """What the first and the last conversation of a slice are by themselves: only these may go on outside."""
    held = None

    def summary(conv, rows):
        piece = Piece([tuple(r[1:]) for r in rows])
        pairs = sorted(piece.chain.best)
        return {"conv_id": conv, "slice": rows[0][0], "initial": piece.rows[-1][0],
                "start": [a for a, _ in pairs], "end": [b for _, b in pairs],
                "cost": [piece.chain.best[p][0] for p in pairs], "rank": [piece.chain.rank[p] for p in pairs]}

    found = []
    for number, conv, rows in _conversations(batches, ["slice", *_ROW]):
        if number == 0:
            found.append(summary(conv, rows))
        held = (number, conv, rows)
    if held and held[0] > 0:
        found.append(summary(*held[1:]))
    return found


def _settled_ends(ends: DataFrame, conv_type: str) -> dict:
    """(slice, conversation) -> (start, end, initial before, is last): at most two a slice."""
    def meet(table_: pa.Table) -> pa.Table:
        rows = sorted(table_.to_pylist(), key=lambda r: r["slice"])
        parts = [({(a, b): c for a, b, c in zip(r["start"], r["end"], r["cost"])},
                  {(a, b): k for a, b, k in zip(r["start"], r["end"], r["rank"])}) for r in rows]
        chain = Chain(parts, (EMPTY,))
        path = chain.best[EMPTY, chain.end()][1].notes()
        return pa.table({
            "conv_id": table_.column("conv_id"), "slice": pa.array([r["slice"] for r in rows], pa.int32()),
            "start": pa.array([a for a, _ in path], pa.int32()), "end": pa.array([b for _, b in path], pa.int32()),
            "before": pa.array([None, *(r["initial"] for r in rows[:-1])], pa.string()),
            "is_last": [k == len(rows) - 1 for k in range(len(rows))]})

    met = ends.groupBy("conv_id").applyInArrow(
        meet, f"conv_id {conv_type}, slice int, start int, end int, before string, is_last boolean")
    return {(r["slice"], r["conv_id"]): (r["start"], r["end"], r["before"], r["is_last"]) for r in met.collect()}


def damaged_free(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(" "))


def repair_plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits per different row, figures per conversation) of rows conv_id, turn, role, text, digest.

    Rows are in order of turn (nulls first), then digest; equal rows count by their number.
    """
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    turn_type = rows.schema["turn"].dataType.simpleString()
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    narrow = rows.groupBy(
        "conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"),
        (~last.isin("", ".", "!", "?")).alias("cut_off")).agg(F.count(F.lit(1)).alias("copies"))
    # Where the same role and text came before: only those that come more than once are looked up.
    firsts = narrow.groupBy("conv_id", "digest").agg(
        F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").select(
        F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), F.col("first.turn").alias("_first"), F.lit(True).alias("_known"))
    known = (F.col("conv_id").eqNullSafe(F.col("_conv"))) & (F.col("digest") == F.col("_digest"))
    again = F.col("_known").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first"))
    judged = narrow.join(firsts, known, "left").withColumn("again", again).select(
        "conv_id", "turn", "digest", "initial", "blank", (F.col("again") & ~F.col("blank")).alias("again"),
        (F.col("cut_off") & ~F.col("again")).alias("cut_off"),
        (F.col("blank") | F.col("again")).alias("gone"), "copies")

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest")]
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settled = materialise(judged.repartitionByRange(slices, *order).sortWithinPartitions(*order)
                          .withColumn("slice", F.spark_partition_id()))

    def ends(batches):
        for r in _ends_of_slices(batches):
            yield pa.RecordBatch.from_pylist([r], schema=_END.with_metadata(None).insert(0, pa.field("conv_id", conv_arrow)))

    conv_arrow = _arrow_type(conv_type)
    chosen = _settled_ends(settled.select("conv_id", "slice", *_ROW).mapInArrow(
        ends, f"conv_id {conv_type}, slice int, initial string, start array<int>, end array<int>, cost array<long>, rank array<int>"),
        conv_type)
    shared = rows.sparkSession.sparkContext.broadcast(chosen)      # at most two entries a slice

    def solve(batches):
        done: list[dict] = []
        for _, conv, found in _conversations(batches, ["slice", *_ROW, "turn", "digest"]):
            at, plain = found[0][0], [tuple(r[1:5]) for r in found]
            start, end, before, is_last = shared.value.get((at, conv), (EMPTY, None, None, True))
            piece = Piece(plain, (start,))
            end = piece.chain.end() if end is None else end
            edits = piece.edits(start, end)
            closing = CLOSING[end] if is_last else ""
            done.append({"conv_id": conv, "slice": at, "turn": None, "digest": None, "edits": None,
                         "illegal": piece.illegal(before), "audit": audit_of(edits, plain) + "I" * len(closing),
                         "cost": piece.chain.best[start, end][0] + INSERT * len(closing)})
            for k, (row, edit) in enumerate(zip(found, edits)):
                whole = edit + (closing if k == len(edits) - 1 else "")
                if whole != "D":
                    done.append({"conv_id": conv, "slice": at, "turn": row[5], "digest": row[6], "edits": whole,
                                 "illegal": None, "audit": None, "cost": None})
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pylist(done, schema=solved_schema)
                done = []
        yield pa.RecordBatch.from_pylist(done, schema=solved_schema)

    solved_schema = pa.schema([("conv_id", conv_arrow), ("slice", pa.int32()), ("turn", _arrow_type(turn_type)),
                               ("digest", pa.binary()), ("edits", pa.string()), ("illegal", pa.int64()),
                               ("audit", pa.string()), ("cost", pa.int64())])
    solved = settled_table(settled.mapInArrow(
        solve, f"conv_id {conv_type}, slice int, turn {turn_type}, digest binary, edits string, illegal long, audit string, cost long"))

    def times(flag: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(flag), F.col("copies"))), F.lit(0))

    # The copies of a row repeat it; a blank row's copies are blank all the same.
    repeats = F.coalesce(F.sum(F.when(~F.col("blank"), F.col("copies") - 1)), F.lit(0))
    first_again = F.coalesce(F.sum(F.col("again").cast("bigint")), F.lit(0))
    faults = settled.groupBy("conv_id").agg(
        times("blank").alias("blank"), (repeats + first_again).alias("duplicate"),
        F.coalesce(F.sum(F.col("cut_off").cast("bigint")), F.lit(0)).alias("truncated"))
    turns = settled.filter("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    per_slice = solved.filter("edits IS NULL")
    texts = per_slice.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice", "audit"))), lambda s: s["audit"]), "").alias("audit"))
    figures = faults.unionByName(turns, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    figures = figures.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in figures.columns if c != "conv_id"])
    return solved.filter("edits IS NOT NULL").select("conv_id", "turn", "digest", "edits"), figures


_END = pa.schema([("slice", pa.int32()), ("initial", pa.string()), ("start", pa.list_(pa.int32())),
                  ("end", pa.list_(pa.int32())), ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int32()))])


def _arrow_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}[name]


def with_digest(rows: DataFrame) -> DataFrame:
    """Missing roles and texts as one space, and a digest of both."""
    plain = rows.select("conv_id", "turn", damaged_free("role").alias("role"), damaged_free("text").alias("text"))
    both = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return plain.withColumn("digest", F.unhex(F.sha2(both, 256)))


def repaired_rows(rows: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, digest, text, role, edits) of the rows that stay, with turns to insert around them.

    ``edits`` has K (kept), U or A (now user or assistant), and u or a where an empty turn is inserted.
    """
    keyed = with_digest(rows)
    plan = repair_plan(keyed)[0] if plan is None else plan
    plan = plan.select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "turn", "digest")], "edits")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv_id", "turn")]
    return keyed.join(plan, same[0] & same[1] & (F.col("digest") == F.col("_digest"))).select(
        "conv_id", "turn", "digest", "role", "text", "edits")


def _hash_rows(conv_arrow: pa.DataType):
    """SHA-256 over the rows of each conversation as they stream by; nothing of them is kept."""
    def turns(role: str, text: str, edits: str):
        for edit in edits:
            if edit in "ua":
                yield {"u": "user:", "a": "assistant:"}[edit]
            elif edit != "D":
                yield {"K": role, "U": "user", "A": "assistant"}[edit] + ":" + text

    def run(batches):
        current, digest, last = None, None, None
        for batch in batches:
            done = []
            for conv, turn, key, role, text, edits in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or conv != current:
                    if digest is not None:
                        done.append({"conv_id": current, "sha": digest.hexdigest()})
                    current, digest, last, empty = conv, hashlib.sha256(), None, True
                if (turn, key) == last:     # a copy, deleted
                    continue
                last = (turn, key)
                for line in turns(role, text, edits):
                    digest.update(("" if empty else "\n").encode() + line.encode())
                    empty = False
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": current, "sha": digest.hexdigest()}], schema=schema)

    schema = pa.schema([("conv_id", conv_arrow), ("sha", pa.string())])
    return run


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows of a conversation are in order of turn, nulls first; rows with one turn are in order of the digest
    of role and text, and equal rows stand side by side (all but the first are duplicates). A missing role
    or text counts as one space; a row whose role is empty has no initial and cannot be kept. A missing
    conv_id is a conversation like any other. ``ids`` names conversations that must be in the result even
    without rows: zeros, an empty audit, the hash of nothing. Texts of any length are only hashed and looked at from the end. Other columns are ignored; an empty table gives no rows.

    The hash reads a conversation's rows one after the other, as SHA-256 must: a stream through one task with nothing
    held in memory. All else of a long conversation is shared out over slices.
    """
    keyed = with_digest(rows)
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    plan, figures = repair_plan(keyed)
    lines = repaired_rows(rows, plan).select("conv_id", "turn", "digest", "role", "text", "edits")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "digest")]
    hashes = lines.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
        _hash_rows(_arrow_type(conv_type)), f"conv_id {conv_type}, sha string")
    parts = figures.unionByName(hashes, allowMissingColumns=True).unionByName(
        (rows if ids is None else ids).select("conv_id").distinct(), allowMissingColumns=True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256(b"").hexdigest()
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias(n) for n in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.lit(nothing)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by a hash of ``conv_id:turn``."""
    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    marked = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    return marked.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


_ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8),
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM (SELECT unnest(range(256)) AS i))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
dealt AS (SELECT *, xor(4294967295, list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT)) % 20 AS kind FROM keyed, crc),
rows_ AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM dealt WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text), copy) AS n,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM rows_),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS before FROM placed),
judged AS MATERIALIZED (SELECT conv_id, turn, n, role, text, left(role, 1) AS initial, final = '' AS blank, final <> '' AND before AS again,
    final NOT IN ('', '.', '!', '?') AND NOT before AS cut_off,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1) AS prior FROM seen),
ins(a, b, i, lines) AS (VALUES ('E', 'E', '', []), ('E', 'U', 'I', ['user:']), ('E', 'A', 'II', ['user:', 'assistant:']),
    ('S', 'S', '', []), ('S', 'U', 'I', ['user:']), ('S', 'A', 'II', ['user:', 'assistant:']),
    ('U', 'U', '', []), ('U', 'A', 'I', ['assistant:']), ('U', 'U', 'II', ['assistant:', 'user:']),
    ('A', 'A', '', []), ('A', 'U', 'I', ['user:']), ('A', 'A', 'II', ['user:', 'assistant:'])),
keeps(a, r, b) AS (VALUES ('E', 's', 'S'), ('E', 'u', 'U'), ('S', 'u', 'U'), ('U', 'a', 'A'), ('A', 'u', 'U')),
roles(a, r, b) AS (VALUES ('E', 'user', 'U'), ('S', 'user', 'U'), ('U', 'assistant', 'A'), ('A', 'user', 'U')),
ways AS MATERIALIZED (
    SELECT j.conv_id, n, i.a, i.b, 5 * length(i) + 2 AS price, i || 'D' AS audit, i.lines AS lines FROM judged j, ins i
    UNION ALL SELECT j.conv_id, n, i.a, k.b, 5 * length(i) + 5 * cut_off::INT, i || 'K', list_append(i.lines, role || ':' || text)
        FROM judged j, ins i, keeps k WHERE i.b = k.a AND k.r = initial AND NOT blank AND NOT again
    UNION ALL SELECT j.conv_id, n, i.a, k.b, 5 * length(i) + 1 + 5 * cut_off::INT, i || 'R', list_append(i.lines, k.r || ':' || text)
        FROM judged j, ins i, roles k WHERE i.b = k.a AND NOT blank AND NOT again),
best AS (
    SELECT conv_id, 0::BIGINT AS n, 'E' AS state, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS way
    FROM (SELECT DISTINCT conv_id FROM judged)
    UNION ALL
    SELECT s.conv_id, w.n, w.b, min({'cost': s.way.cost + w.price, 'audit': s.way.audit || w.audit, 'lines': s.way.lines || w.lines})
    FROM best s JOIN ways w ON s.conv_id = w.conv_id AND w.n = s.n + 1 AND s.state = w.a GROUP BY s.conv_id, w.n, w.b),
ended AS (SELECT s.conv_id, min({'cost': way.cost + 5 * length(i), 'audit': way.audit || i, 'lines': way.lines || ins.lines}) AS way
    FROM best s JOIN (SELECT conv_id, max(n) AS n FROM judged GROUP BY conv_id) m ON s.conv_id = m.conv_id AND s.n = m.n
    JOIN ins ON ins.a = s.state WHERE ins.b IN ('E', 'A') GROUP BY s.conv_id),
faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
    count_if(again) AS duplicate, count_if(cut_off) AS truncated,
    count_if(n > 1 AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.cost, 0)::BIGINT AS cost,
    coalesce(way.audit, '') AS audit, sha256(coalesce(array_to_string(way.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ended USING (conv_id) LEFT JOIN faults USING (conv_id)
"""


@query("op11_audit_repair", _ORACLE)
def op11_audit_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return repair_conversations(damaged(rows), rows)
