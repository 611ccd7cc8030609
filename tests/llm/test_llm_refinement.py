"""Turn repair, pivot clustering and repeated byte strings against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlens.llm import pivot_clusters, suffix_dedup, turn_repair

# --- turn repair ---------------------------------------------------------------------------

RIGHT = re.compile(r"(s?(ua)+)?")


def plain_repair(rows):
    """Cheapest audit by trying everything, for a few rows (role, text) in their order."""
    seen, judged = set(), []
    for role, text in rows:
        final = text.rstrip("\x20\t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not final else "duplicate" if (role, text) in seen else "truncated" if final not in ".!?" else ""
        seen.add((role, text))
        judged.append((role, text, fault))
    inserts = [(n, seq) for n in range(3) for seq in itertools.product(["user", "assistant"], repeat=n)]
    best = None

    def walk(at, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        for n, added in inserts:
            now = out + [(r, "") for r in added]
            mark, price = audit + "I" * n, cost + 5 * n
            if at == len(judged):
                if RIGHT.fullmatch("".join(r[:1] or "-" for r, _ in now)):
                    best = min(best or (price, mark, now), (price, mark, now), key=lambda b: b[:2])
                continue
            role, text, fault = judged[at]
            walk(at + 1, price + 2, mark + "D", now)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                walk(at + 1, price + more, mark + "K", now + [(role, text)])
                for other in ("user", "assistant"):
                    walk(at + 1, price + more + 1, mark + "R", now + [(other, text)])

    walk(0, 0, "", [])
    faults = [f for _, _, f in judged]
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(judged)]
    return {"blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": best[0], "audit": best[1],
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()}


def stable(rows):
    """The documented order of rows (turn, role, text)."""
    def key(r):
        text = f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()
        return (r[0] is not None, r[0] or 0, hashlib.sha256(text).digest())
    return sorted(rows, key=key)


def test_repair_against_brute_force(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", "us"]
    rows, want = [], {}
    for conv in range(60):
        some = [(rng.choice([None, 0, 1, 2, 3, 5]), rng.choices(roles, [5, 5, 2, 1, 1, 1])[0],
                 rng.choice(["a.", "b?", "c!", "cut", "", " \n", "a. ", "long " * 2000 + "."])) for _ in range(rng.randrange(1, 6))]
        rows += [(conv, *r) for r in some]
        ordered = stable(some)
        turns = {t for t, _, _ in some if t is not None}
        want[conv] = plain_repair([r[1:] for r in ordered]) | {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0}
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, edits string, slice int")
    got = {r.conv_id: r.asDict() for r in turn_repair.repair_conversations(df.repartition(5)).collect()}
    assert got.keys() == want.keys()
    for conv, facts in want.items():
        assert {k: got[conv][k] for k in facts} == facts, conv


def test_repair_of_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "q."), (None, 2, "assistant", "a."), (7, 1, "user", "q."), (7, 1, "user", "q.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ids = df.select("conv_id").unionByName(spark.createDataFrame([(9,)], "conv_id long"))
    got = {r.conv_id: r for r in turn_repair.repair_conversations(df, ids).collect()}
    assert got[None].audit == "DKK" and got[None].blank == 1 and got[None].gaps == 0
    assert got[7].audit == "DD" and got[7].duplicate == 1
    assert (got[9].audit, got[9].cost, got[9].repaired_sha256) == ("", 0, hashlib.sha256(b"").hexdigest())
    assert turn_repair.repair_conversations(df.filter("false")).count() == 0


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 5])
def test_long_conversation_over_slices(spark, monkeypatch, prime):
    """One conversation in many stretches and slices equals one program over all rows, also if hashes collide."""
    monkeypatch.setattr(turn_repair, "STRETCH", 7)
    monkeypatch.setattr(turn_repair, "_PRIME", prime)
    rng = random.Random(prime)
    rows = [(1, t, rng.choice(["user", "user", "assistant", "system", "tool"]), rng.choice(["yes.", "no", f"{t}.", ""]))
            for t in range(400)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for c in (0, 2) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in turn_repair.repair_conversations(df).collect()}

    seen, states = set(), {"E": (0, "", ())}
    step = {("E", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U", ("E", "s"): "S"}
    keep = lambda old, new: new if old is None or new[:2] < old[:2] else old

    def inserted(states):
        for _ in range(2):
            for s, (cost, audit, out) in list(states.items()):
                for r in ("user", "assistant"):
                    if (s, r[0]) in step:
                        to = step[s, r[0]]
                        states[to] = keep(states.get(to), (cost + 5, audit + "I", out + (r + ":",)))
        return states

    for _, _, role, text in rows[:400]:
        final, gone, then = text[-1:], not text or (role, text) in seen, {}
        seen.add((role, text))
        for s, (cost, audit, out) in inserted(states).items():
            then[s] = keep(then.get(s), (cost + 2, audit + "D", out))
            more = 5 * (final not in ".!?")
            for r, price, mark in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                if not gone and (s, r[:1]) in step and (r[:1] != "s" or mark == "K"):
                    to = step[s, r[:1]]
                    then[to] = keep(then.get(to), (cost + price + more, audit + mark, out + (f"{r}:{text}",)))
        states = then
    cost, audit, out = min((v for s, v in inserted(states).items() if s in "EA"), key=lambda v: v[:2])
    assert (got[1].cost, got[1].audit) == (cost, audit)
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(out).encode()).hexdigest()
    assert got[0].audit == got[2].audit == "KKKKKK"


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 3])
def test_compare_is_the_order_of_the_letters(monkeypatch, prime):
    monkeypatch.setattr(turn_repair, "_PRIME", prime)
    rng = random.Random(1)
    for _ in range(200):
        n, made = rng.randrange(1, 20), []
        for _ in range(2):
            letters = [rng.choice([0, 0, 0, 1]) for _ in range(n)]
            node = turn_repair.Audit(None, 0)
            for letter in letters:
                node = turn_repair.Audit(node, letter)
            made.append((letters, node))
        (x, a), (y, b) = made
        assert turn_repair.compare(a, b) == (x > y) - (x < y)
        assert turn_repair.compare(b, a) == (y > x) - (y < x)


# --- pivot clustering ------------------------------------------------------------------------


def plain_clusters(vectors, clusters, rounds, width):
    used = [(i, np.floor(np.array(v, np.float64) * 1024).astype(np.int64)) for i, v in vectors
            if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "")
    centres = [v for _, v in sorted(used, key=lambda p: (digest(p[0]), p[1].tolist()))[:clusters]]
    nearest = lambda v: min((int(((v - c) ** 2).sum()), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in used]
        for k in range(len(centres)):
            mine = [v for (_, v), a in zip(used, at) if a == k]
            if mine:
                centres[k] = np.sum(mine, axis=0) // len(mine)
    found = [(i, *nearest(v)) for i, v in used]
    inertia = {k: sum(d for _, d, a in found if a == k) for k in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), sha[k]) for i, d, k in found), key=str)


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(4)
    spots = rng.normal(size=(6, 8))
    vectors = [(i, (spots[i % 6] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(150)]
    vectors += [(i, [0.5] * 8) for i in range(200, 230)] + [(3, [0.25] * 8), (3, [0.25] * 8), (None, [0.1] * 8)]
    vectors += [(300, None), (301, []), (302, [1.0] * 7), (303, [None] + [1.0] * 7), (304, [float("nan")] * 8), (305, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in vectors], "vec_id long, embedding array<float>, cluster string, apex int")
    for clusters, rounds in ((5, 4), (8, 0), (2, 2)):
        got = pivot_clusters.centroid_clusters(df.repartition(4), clusters, rounds, width=8, pivots=5).collect()
        assert sorted(map(tuple, got), key=str) == plain_clusters(vectors, clusters, rounds, 8)
    few = df.filter("vec_id IN (200, 3, 304)")
    got = pivot_clusters.centroid_clusters(few, 8, 3, width=8).collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters([v for v in vectors if v[0] in (200, 3, 304)], 8, 3, 8)
    assert pivot_clusters.centroid_clusters(df.filter("false"), width=8).count() == 0
    huge = spark.createDataFrame([(1, [1e9] * 8)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="within a long"):
        pivot_clusters.centroid_clusters(huge, width=8).collect()


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(7)
    rows = rng.integers(-900, 900, (400, 16)) // 4 + np.repeat(rng.integers(-4000, 4000, (8, 16)), 50, axis=0)
    simplex = pivot_clusters.Simplex(rows[::7], 12)
    apexes, centres = simplex.apexes(rows).astype(np.float32).astype(float), rows[::50]
    for centre, peak in zip(centres, simplex.apexes(centres)):
        low, high = pivot_clusters.bounds(apexes, peak)
        exact = pivot_clusters.squared(rows, centre)
        assert (low <= exact).all() and (exact <= high).all()
    best, distance, compared = pivot_clusters.nearest(rows, apexes, centres, simplex.apexes(centres))
    every = np.stack([pivot_clusters.squared(rows, c) for c in centres], 1)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert compared < 0.5 * every.size


def test_pivots_in_one_plane():
    flat = np.zeros((20, 6), np.int64)
    flat[:, 0] = np.arange(20) * 100
    simplex = pivot_clusters.Simplex(flat, 6)
    assert len(simplex.pivots) == 2
    best, _, _ = pivot_clusters.nearest(flat, simplex.apexes(flat), flat[[3, 15]], simplex.apexes(flat[[3, 15]]))
    assert best.tolist() == [0] * 10 + [1] * 10     # 900 lies in the middle: the smaller number


# --- repeated byte strings ---------------------------------------------------------------------


def plain_cut(texts, window):
    places = {}
    for n, text in enumerate(texts):
        for p in range(len(text) - window + 1):
            places.setdefault(text[p:p + window], []).append((n, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for n, p in found:
                gone[n][p:p + window] = True
    out = []
    for text, marks in zip(texts, gone):
        kept = bytes(b for b, m in zip(text, marks) if not m)
        out.append((len(text), int(marks.sum()), int((np.diff(marks.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def odd_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, base = prose(12), prose(90)
    texts = [None, "", "a", "a" * 300, "ab" * 100, "a" * 19, "a" * 20, "b" * 20, "漢字" * 40, base, base, base]
    texts += [prose(rng.randrange(60)) + shared[:rng.randrange(len(shared))] + prose(20) for _ in range(40)]
    for _ in range(25):
        at = rng.randrange(len(base) - 10)
        texts.append(base[:at] + word() + base[at + rng.randrange(10):])
    texts.append(base + shared + base + prose(10))
    return texts


@pytest.mark.parametrize("window,gram,block,chunk", [(20, 4, 4, 1 << 16), (33, 8, 5, 100), (16, 16, 1, 37)])
def test_cut_against_brute_force(spark, monkeypatch, window, gram, block, chunk):
    monkeypatch.setattr(suffix_dedup, "_CHUNK", chunk)
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)],
                               "doc_id long, text string, tag string, low int, spots string").repartition(6)
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(df, window=window, gram=gram, block=block).collect()}
    want = plain_cut([(t or "").encode() for t in texts], window)
    assert got == dict(enumerate(want))


def test_cut_of_long_repeated_and_missing_rows(spark):
    long = "all work and no play makes a long text. " * 20_000
    rows = [(1, long), (None, "short"), (None, "short"), (2, None), (2, "unlike " + "".join(map(chr, range(200, 900))))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect()))
    size = len(rows[4][1].encode())
    assert got == [(0, 5, 0, 0), (0, 5, 0, 0), (1, 800_000, 800_000, 1), (2, 0, 0, 0), (2, size, 0, 0)]
    assert suffix_dedup.remove_repeats(df.filter("false")).count() == 0
    spans = suffix_dedup.cut_repeats(df).select(F.col("spans")[0]["end"], F.length("kept_text")).collect()
    assert [tuple(r) for r in spans] == [(800_000, 0)]


def test_copies_are_cut_alike_wherever_they_lie(spark, monkeypatch):
    """Copies across a border of the pieces named at once used to be cut in two ways, which ended in an error."""
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 64)
    rng = random.Random(5)
    for _ in range(3):
        text = "".join(rng.choices("abcdefgh", k=700))
        docs = [text, "".join(rng.choices("abcdefgh", k=13)), text]
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1)
        got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(df, window=20, gram=4, block=4).collect()}
        assert got == dict(enumerate(plain_cut([t.encode() for t in docs], 20)))


def test_cuts_depend_on_the_text_alone(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 64)
    rng = np.random.default_rng(1)
    text = rng.integers(97, 105, 150).astype(np.uint8)
    seen = set()
    for before in range(0, 90, 7):
        data = np.concatenate([rng.integers(97, 105, before).astype(np.uint8), text, text[:33]])
        text_of = np.repeat(np.arange(3, dtype=np.int32), [before, len(text), 33])
        own, low, at, high, _, whole = suffix_dedup.anchors(data, text_of, 20, 4)
        seen.add(tuple((int(a) - before, int(b) - before, int(c) - before, int(w))
                       for o, a, b, c, w in zip(own, low, at, high, whole) if o == 1))
    assert len(seen) == 1
