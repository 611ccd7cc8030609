"""Encoding, counting, quality rules, secrets and toxicity."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tenderlens.llm import quality_lines, secret_scan, token_count, toxicity, unigram

WORDS = re.compile("[^\x20\x09-\x0d]+")


def best_path(text, pieces, scores, byte_ids, unknown):
    """Plain Viterbi over the whole text."""
    marked = ("▁" + text.replace(" ", "▁")) if text else ""
    known = {p: i for i, p in enumerate(pieces) if p}
    best = [(0, 0, 0)] + [None] * len(marked)
    for at in range(len(marked)):
        for end in range(at + 1, min(len(marked), at + 16) + 1):
            i = known.get(marked[at:end])
            if i is None and (end > at + 1):
                continue
            total = best[at][0] + (unknown if i is None else int(scores[i]))
            if best[end] is None or total > best[end][0]:
                best[end] = (total, at, i)
    ids, at = [], len(marked)
    while at:
        _, start, i = best[at]
        ids += [int(byte_ids[b]) for b in reversed(marked[start:at].encode())] if i is None else [i]
        at = start
    return ids[::-1]


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.load_pieces()


@pytest.fixture(scope="module")
def coder(vocabulary):
    return unigram.Unigram(*vocabulary)


def test_encoder_against_plain_viterbi(vocabulary, coder):
    draw = random.Random(2)
    letters = "etaoin shrdlu  \n\tÉüñ漢🙂.!▁ABC"
    texts = ["", " ", "  a", "a ", "a\n\nb"] + ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(300)]
    counter = token_count.Counter(*vocabulary[:2])
    for text, ids in zip(texts, coder.encode_all(texts)):
        want = best_path(text, *vocabulary, coder.unknown)
        assert ids.tolist() == want
        assert counter.text(text)[0] == len(want)
        assert coder.decode(ids) == text.replace("▁", " ")


def test_double_array(vocabulary):
    trie = unigram.double_array(vocabulary[0])
    codes = {chr(c): i for i, c in enumerate(trie["letters"].tolist(), 1)}
    for number, piece in enumerate(vocabulary[0]):
        if not piece:
            continue
        node = 0
        for c in piece:
            following = int(trie["base"][node]) + codes[c]
            assert trie["check"][following] == node
            node = following
        assert trie["value"][node] == number


def test_encode_and_count_odd_rows(odd_docs, no_docs):
    coded = unigram.encode_documents(odd_docs).collect()
    counted = {(r.doc_id, r.n_tokens) for r in token_count.count_tokens(odd_docs).collect()}
    assert len(coded) == odd_docs.count() and counted == {(r.doc_id, r.n_tokens) for r in coded}
    assert all(r.round_trip == (r.doc_id != 8) and r.n_tokens == len(r.token_ids) for r in coded)  # row 8 holds the marker
    assert unigram.encode_documents(no_docs).count() == token_count.count_tokens(no_docs).count() == 0


def test_menu_lines_of_any_length(spark):
    """A repeated group would overflow the stack; both patterns agree on what a menu line is."""
    lines = ["home " * 1_000_000, "| " * 1_000_000, "home | about us» contact us", "homemenu", "contact us about", "about usual", "homes",
             "log in·log out", "", "us", "home " * 1000 + "stead", " \t back\x0b", "about ush", "contact us help"]
    df = spark.createDataFrame([(i, x + "\nplain words that stay here") for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.n_bad_lines for r in quality_lines.line_first_rules(df).collect()}
    assert got[0] == got[1] == 1
    short = {i: x for i, x in enumerate(lines) if 0 < len(x) < 10_000}
    assert {i: got[i] for i in short} == {
        i: int(bool(re.search(quality_lines.MENU_LINE, x.lower())) or x.startswith("home |")) for i, x in short.items()}


def test_quality_rules_on_odd_rows(spark, odd_docs, no_docs):
    for r in quality_lines.line_first_rules(odd_docs).join(odd_docs.select("doc_id", "text"), "doc_id").collect():
        words = WORDS.findall(r.text or "")
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(words) < 500 else None
        assert r.n_words == len(words) or r.doc_id in (0, 3, None)
        if hit is not None and r.n_words == len(words):
            assert r.n_repeat_words == len(hit) and r.word_chars == sum(map(len, words))
        assert not (r.base_failed and r.kept)
    assert quality_lines.line_first_rules(no_docs).count() == 0
    menu = "Home | About | Contact | Login\n"
    prose = "This is a sentence with enough words in it to stay.\n"
    rows = [(1, prose * 1 + menu), (2, prose + menu * 6), (3, "so** it** goes** on** and** on** for** ever** and** ever**")]
    got = {r.doc_id: r for r in quality_lines.line_first_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].n_bad_lines == 1 and got[1].clean_text == prose.strip()
    assert not got[2].kept and not got[3].kept and not got[3].base_failed


def test_base_spans():
    text = 'x password: "abc" token=abcdef secret key: zzz API_KEY = k-1.2/3= AKIA' + "A" * 16 + " AKIA12 " + "ab" * 12 + "g" + "0" * 23
    found = [(secret_scan.KINDS[k], text[s:e]) for s, k, e, _ in secret_scan.base_spans(text)]
    assert found == [("assign", "token=abcdef"), ("assign", "API_KEY = k-1.2/3="), ("access", "AKIA" + "A" * 16), ("hex", "ab" * 12)]


def test_grammars_find_the_format(spark):
    draw = random.Random(3)
    hexes = ["".join(draw.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    keys = ["sk-" + "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24)) for _ in range(60)]
    prose = ["".join(draw.choice("etaoinshrdlu") for _ in range(18)) for _ in range(300)]
    rows = [(i, f"{prose[i]} value {h} secret={k}") for i, (h, k) in enumerate(zip(hexes, keys))]
    rows += [(100 + i, w) for i, w in enumerate(prose)]
    new = "sk-" + "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    rows += [(900, f"here is {new} alone"), (901, "0123456789abcdef0123"), (902, None), (903, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    grammars = secret_scan.learn_grammars(docs)
    assert set(grammars) == {"assign", "hex", "ordinary"} and all(len(g) < 60 for g in grammars.values())
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.found] for r in secret_scan.scan_secrets(docs, grammars).collect()}
    assert got[900] == [("format", 8, 8 + len(new))] and got[901] == [("format", 0, 20)]
    assert got[902] == got[903] == [] and all(got[100 + i] == [] for i in range(300))
    assert all(len(got[i]) == 2 for i in range(60))


def test_many_bare_keys_stay_credentials(spark):
    """A source full of bare keys of a labelled format does not make the format ordinary."""
    draw = random.Random(8)
    key = lambda: "".join(draw.choice("0123456789ABCDEF") for _ in range(32))
    word = lambda: "".join(draw.choice("etaoinshrdlucmfwyp") for _ in range(draw.randrange(16, 24)))
    rows = [(i, f"secret={key()}") for i in range(300)] + [(1000 + i, f"dump {key()}") for i in range(600)]
    rows += [(2000 + i, f"prose {word()}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = secret_scan.scan_secrets(docs, secret_scan.learn_grammars(docs)).collect()
    bare = {r.doc_id: [x.kind for x in r.found] for r in found if r.doc_id >= 1000}
    assert all(kinds == (["format"] if i < 2000 else []) for i, kinds in bare.items())


def test_secrets_on_odd_rows(odd_docs, no_docs):
    assert secret_scan.learn_grammars(no_docs) == {}
    got = secret_scan.span_digest(secret_scan.scan_secrets(odd_docs, secret_scan.learn_grammars(odd_docs))).collect()
    assert len(got) == odd_docs.count()
    assert {(r.n_assign, r.n_access, r.n_hex) for r in got if r.doc_id == 12} == {(1, 1, 1)}
    assert secret_scan.scan_secrets(no_docs, {}).count() == 0


def toxic_rows(n=600):
    draw = random.Random(4)
    plain, bad = [f"word{i}" for i in range(200)], ["zorp", "blarg", "fnord"]
    groups, rows = ["muslim", "christian", "women", "men"], []
    for i in range(n):
        words = [draw.choice(plain) for _ in range(40)]
        label = int(draw.random() < 0.3)
        if label:
            words[draw.randrange(40)] = draw.choice(bad)
        if draw.random() < (0.8 if label else 0.1):  # groups are mostly named in toxic texts
            words[draw.randrange(40)] = draw.choice(groups[:1] if label else groups)
        rows.append((i, " ".join(words) + ".", label))
    return rows


def test_toxicity_is_learned_and_does_not_lean_on_identity(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    truth = {i: y for i, _, y in rows}
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    marked = toxicity.training_rows(docs, labels).select("doc_id", "text", "label")
    gaps = []
    for penalty in (0.0, 10.0):
        scorer = toxicity.Scorer(*toxicity.learn(marked, penalty=penalty))
        a, b = scorer.score(["the muslim neighbour reads word1 word2", "the christian neighbour reads word1 word2"])
        gaps.append(abs(a - b))
    assert gaps[1] < 0.5 * gaps[0] and gaps[1] < 0.02


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 1), (7, 0, None), (None, 1, 1)], "doc_id long, toxic int, score int")
    got = toxicity.toxicity_scores(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity_scores(no_docs, labels.filter("false")).count() == 0
    assert toxicity.drop_toxic(odd_docs, labels.filter("toxic = 0")).columns == odd_docs.columns


def test_swapped_terms():
    assert toxicity.swapped("Women and muslim men.") == "men and christian nonbinary."
    assert toxicity.swapped("nobody is named") is None


def test_candidates_touch_no_labelled_span():
    rng = random.Random(3)
    parts = ["password=abcdefgh1234", "AKIA" + "A1" * 9, "deadbeef" * 4, "word", "x" * 20, "token: Zz9" + "q" * 20,
             "secret=" + "ab12" * 8 + ".tail" * 4, "A" * 18 + "/" + "b" * 9]
    for _ in range(500):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "\n", "=", "-"]) for _ in range(rng.randrange(12)))
        spans = secret_scan.base_spans(text)
        want = [m[0] for m in secret_scan.CANDIDATE.finditer(text)
                if all(m.end() <= start or m.start() >= end for start, _, end, _ in spans)]
        assert [value for _, _, value in secret_scan.candidates(text, spans)] == want
