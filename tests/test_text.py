import datetime as dt
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.functions.dictionary import TERMS
from tenderlens.operators import articles as art
from tenderlens.operators import phrases as ph
from tenderlens.operators import sections as sec
from tenderlens.workload import QUERIES, news


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression).first()[0]


@pytest.mark.parametrize("text, want", [
    ("U.S. trade", "america. trade"), ("the U.S.A. now", "the americaA. now"), ("usa", "america"),
    ("give us time", "give america time"), ("u s", "america"), ("abus", "abus"), ("éus", "éus"),
])
def test_country(spark, text, want):
    assert one(spark, text, tx.normalize_country("t")) == want


def test_parentheses_and_sentences(spark):
    assert one(spark, "a (b c) d (e", tx.strip_parentheses("t")) == "a  d (e"
    assert one(spark, "One. Two!  Three?\nFour 3.5", tx.split_sentences("t")) == ["One.", "Two!", "Three?", "Four 3.5"]


@pytest.mark.parametrize("word, base", [
    ("policies", "policy"), ("churches", "church"), ("wishes", "wish"), ("taxes", "tax"),
    ("women", "woman"), ("tariffs", "tariff"), ("congress", "congress"), ("census", "census"),
    ("crisis", "crisis"), ("tax", "tax"),
])
def test_noun_endings(spark, word, base):
    assert one(spark, word, tx.lemmatize(F.array("t")))[0] == base


def test_lemma_maps(spark):
    small = {"geese": "goose"}
    large = {**small, **{f"w{i}": f"b{i}" for i in range(600)}}
    for lemmas in (small, large):
        words = one(spark, "geese taxes w7", tx.lemmatize(F.split("t", " "), lemmas))
        assert words[:2] == ["goose", "tax"]
    assert words[2] == "b7"


def test_clean_document(spark):
    text = "The U.S. raised Taxes (again). It was a 5 percent rise! And the.   By Ann Writer"
    stop = ["the", "it", "was", "a", "and", "by"]
    # 'U.S. raised' ends a sentence after the abbreviation, as the sentence rule knows none.
    assert one(spark, text, tx.clean_tokens("t", stop)) == ["america", "raised", "tax", "5", "percent", "rise"]
    assert one(spark, "only one sentence", tx.clean_document("t", stop)) == ""
    assert one(spark, "", tx.clean_document("t", stop)) == ""


def test_default_stopwords(spark):
    words = tx.default_stopwords()
    assert {"the", "und", "los", "avec"} <= set(words)


@pytest.mark.parametrize("text, term, n", [("aaaa", "aa", 2), ("syntax tax", "tax", 2), ("arkansas", "kansas", 1), ("", "x", 0)])
def test_occurrences(spark, text, term, n):
    assert one(spark, text, tx.occurrences("t", term)) == n


def test_whole_words(spark):
    assert one(spark, "tax tax syntax tax", tx.whole_word_occurrences("t", "tax")) == 3
    assert one(spark, "new york new york", tx.whole_word_occurrences("t", "new york")) == 2


@pytest.mark.parametrize("text, fiscal, tariff", [
    ("american tax cuts", True, False), ("only america", False, False), ("new tariffs", False, True),
    ("tariffs of kansas", True, True), ("medicare and borrowing", False, False),
])
def test_classification(spark, text, fiscal, tariff):
    assert one(spark, text, art.is_fiscal("t", TERMS)) is fiscal
    assert one(spark, text, art.has_tariff("t", TERMS)) is tariff


def test_shared_terms_weigh_twice(spark):
    docs = spark.createDataFrame([(1, "x x y")], "id long, t string")
    hits = {r["category"]: r["hits"] for r in art.count_terms(docs, "id", "t", {"a": ["x"], "b": ["x", "y"]}).collect()}
    assert hits == {"a": 4, "b": 5}


def test_dictionary_in_base_form(spark):
    base = art.lemmatize_dictionary(spark)
    assert base["tax"] == ["tax cut", "tax increase", "tax rate", "tax", "tax legislation", "income tax"]
    assert list(base) == list(TERMS)


@pytest.mark.parametrize("line, want", [
    ("publication date:  au g 9, 2025", dt.date(2025, 8, 9)), ("publication date: sep 1 0, 2025", dt.date(2025, 9, 10)),
    ("publication date: aug 9, 20 25", dt.date(2025, 8, 9)), ("publication date: soon", None), ("date: aug 9, 2025", None),
    ("publication date: feb 31, 2025", None),
])
def test_broken_dates(spark, line, want):
    assert one(spark, f"title: x\n{line}\nend: y", sec.parse_broken_date("t")) == want


@pytest.mark.parametrize("line, want", [
    ("proquest document id: 123", "123"), ("proquestdocument id: 1 2 3", "123"), ("proquestdocumentid:77", "77"),
    ("proquest documentid: 5", "5"), ("document id: 9", None),
])
def test_article_ids(spark, line, want):
    assert one(spark, f"a: b\n{line}\nc", sec.parse_article_id("t")) == want


# --- sections against a line-by-line reading ----------------------------------------------

def read_line_by_line(lines):
    """What a reader with two open books would note down."""
    number, found = 0, {}
    pages = {"article": None, "details": None}
    for line in (x.lower() for x in lines):
        if line == "full text":
            number += 1
            pages["article"] = pages["article"] or []
        elif line == "details" and pages["article"] is not None:
            found[number, "article"] = "".join(x + " " for x in pages["article"])
            pages["article"], pages["details"] = None, pages["details"] or []
        else:
            if pages["article"] is not None:
                pages["article"].append(line)
            if pages["details"] is not None:
                if line == "links":
                    found[number, "details"] = "".join(x + "\n" for x in pages["details"])
                    pages["details"] = None
                else:
                    pages["details"].append(line)
    return {n: (text, found.get((n, "details"))) for (n, kind), text in found.items() if kind == "article"}


def sections_of(spark, files, block_lines):
    rows = [(f, i // block_lines, i, line) for f, lines in files.items() for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "file string, block long, line_no long, line string")
    found = {}
    for r in sec.extract_sections(df).collect():
        found.setdefault(r["file"], {})[r["number"]] = (r["article"], r["details"])
    return found


def test_sections_match_reading(spark):
    rng = random.Random(11)
    kinds = ["Full Text", "Details", "Links", "a", "b", "c", ""]
    files = {f"f{i}": [rng.choice(kinds) for _ in range(rng.randrange(5, 90))] for i in range(40)}
    files["empty"] = ["nothing here", "at all"]
    want = {f: r for f, r in ((f, read_line_by_line(x)) for f, x in files.items()) if r}
    for block_lines in (3, 1000):
        assert sections_of(spark, files, block_lines) == want


def test_sections_golden(spark):
    lines = ["before", "Full Text", "One", "two", "DETAILS", "k: v", "Links", "between", "Full text", "x",
             "full text", "y", "details", "never closed"]
    assert sections_of(spark, {"f": lines}, 4) == {"f": {1: ("one two ", "k: v\n"), 3: ("x y ", None)}}


def test_article_table_first_wins_per_file(spark):
    def article(body, number):
        return ["Full Text", body, "Details", "Publication date: Aug 9, 2025", f"ProQuest document ID: {number}", "Links"]
    lines = article("American tax cuts grow. Jane Writer", 7) + article("Nothing. Jane Writer", 7)
    rows = [(f, 0, i, x) for f in ("a", "b") for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "file string, block long, line_no long, line string")
    got = sorted(tuple(r) for r in art.build_article_table(df).collect())
    assert got == [(f, "7", dt.date(2025, 8, 9), True, False) for f in ("a", "b")]


# --- phrases -----------------------------------------------------------------------------

DOCS = [["tax", "cut", "now"], [], ["5", "tax"], ["cut"], ["2024"], ["now", "tax", "cut", "now", "tax", "cut"]]


def brute(streams, sizes=(1, 2, 3)):
    counts = {}
    for words in streams:
        for n in sizes:
            for i in range(len(words) - n + 1):
                phrase = " ".join(words[i:i + n])
                counts[phrase] = counts.get(phrase, 0) + 1
    return counts


def test_sections_are_dealt_by_block(spark):
    """A task used to sort a share of all lines that grew with the input; it now sorts a few blocks."""
    lines = ["head", "Full Text", "a b", "Details", "Publication date: Au g 9, 2025", "Links"]
    rows = [("f", block, n, line) for block in range(40) for n, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "file string, block long, line_no long, line string").repartition(3)
    found = sec.extract_sections(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 40" in plan
    assert sorted((r["number"], r["article"]) for r in found.collect()) == [(n, "a b ") for n in range(1, 41)]


@pytest.mark.parametrize("stitched", [False, True])
def test_ngrams(spark, stitched):
    rng = random.Random(2)
    many = DOCS + [[rng.choice("abc") for _ in range(rng.randrange(4))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(many)), "id long, tokens array<string>")
    letters = [[t for t in d if t.isalpha()] for d in many]
    streams = [list(itertools.chain(*letters))] if stitched else letters
    got = ph.ngram_counts(df, "tokens", stitch_order=["id"] if stitched else None)
    assert {r["phrase"]: r["count"] for r in got.collect()} == brute(streams)


def test_top_ngrams_break_ties_by_phrase(spark):
    df = spark.createDataFrame([(["b", "a", "c", "c"],)], "tokens array<string>")
    top = ph.top_ngrams(ph.ngram_counts(df, "tokens", (1,)), 2).collect()
    assert [tuple(r) for r in top] == [("c", 2), ("a", 1)]


@pytest.mark.parametrize("stitch", [None, ["doc"]])
@pytest.mark.parametrize("k, buckets", [(1, 64), (7, 64), (30, 4096), (10_000, 64)])
def test_sketch_finds_the_most_frequent(spark, stitch, k, buckets):
    from collections import Counter
    rng = random.Random(2)
    words = [chr(97 + i) * (i % 3 + 1) for i in range(20)]
    docs = [(i, rng.choices(words, [2 ** (i % 7) for i in range(20)], k=rng.randrange(12))) for i in range(80)]
    docs += [(100, ["x1", "", "a", "b"]), (101, None), (102, []), (102, ["z"])]
    df = spark.createDataFrame(docs, "doc int, t array<string>")
    grams = ph.Grams(df, "t", stitch_order=stitch)
    got = ph.top_ngrams(ph.frequent_ngrams(grams, k, buckets), k).collect()
    clean = [[w for w in d or [] if w.isalpha()] for _, d in docs]
    streams = clean if stitch is None else [[w for d in clean for w in d]]
    if stitch:      # documents 102 may come in either order; both are checked against the plain count
        plain = ph.ngram_counts(df, "t", stitch_order=stitch)
        assert sum(r["count"] for r in plain.collect()) == sum(max(0, len(streams[0]) - n + 1) for n in (1, 2, 3))
    want = Counter(" ".join(s[i:i + n]) for s in streams for n in (1, 2, 3) for i in range(len(s) - n + 1))
    best = sorted(want.items(), key=lambda p: (-p[1], p[0]))[:k]
    assert [tuple(r) for r in got] == best


def test_sketch_shuffles_few_grams(spark):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    docs = [(i, [words[(i * 7 + j * j * (i % 5 + 1) + j * i) % 400] if j % 3 else words[j % 9] for j in range(200)]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc int, t array<string>")
    grams = ph.Grams(df, "t")
    everything = grams.rows().count()
    kept = ph.frequent_ngrams(grams, 5)
    plain = ph.ngram_counts(df, "t")
    assert [tuple(r) for r in ph.top_ngrams(kept, 5).collect()] == [tuple(r) for r in ph.top_ngrams(plain, 5).collect()]
    assert kept.count() < 0.05 * everything


def test_counts_combine_in_short_tasks(spark, monkeypatch, tmp_path):
    """However long the scan's splits: a task that combines more n-grams than it can hold spills them all."""
    monkeypatch.setattr(ph, "PIECE_BYTES", 100)
    monkeypatch.setattr(ph, "PIECE_TOKENS", 20)
    words = ["alpha", "beta", "x1", "gamma", "america"]
    rows = [(i if i % 3 else None, "".join(f"{words[(i * j) % 5]} " for j in range(12)) + "end. Last one. ") for i in range(20)]
    rows += [(50, None), (51, ""), rows[1]]
    spark.createDataFrame(rows, "doc_id int, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    size = sum(len(text or "") for _, text in rows)
    dealt = ph.in_pieces(docs, "text")
    assert docs.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() == -(-size // 100)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, docs.collect()))
    assert ph.in_pieces(docs.limit(0), "text").count() == 0
    tokens = docs.select("doc_id", tx.clean_tokens("text", ["the"]).alias("t"))
    stream = ph.Grams(tokens, "t", stitch_order=["doc_id"], deal=True)
    n = -(-sum(len([w for w in r["t"] or [] if w.isalpha()]) for r in tokens.collect()) // 20)
    assert stream.sequences.rdd.getNumPartitions() == n > 1
    clean = [[w for w in r["t"] or [] if w.isalpha()] for r in tokens.collect()]
    got = {r["phrase"]: r["count"] for r in news._counts(spark, str(tmp_path)).collect()}
    assert got == brute(clean)
    folded = {(r["words"], r["count"]): r["n_phrases"] for r in news._fold(ph.ngram_counts(tokens, "t")).collect()}
    assert folded == Counter((len(p.split(" ")), k) for p, k in brute(clean).items())
    for name, deals in (("distinct_phrases", 1), ("ngram_counts_stitched", 1)):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") == deals, name


def test_long_texts_and_odd_marks(spark):
    rows = [(0, "Cats: dogs. " * 50_000), (1, "no end"), (2, "Only (one). "), (3, "One. Two? (x. y) Three! the"), (4, "::: . . ! ? "), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "i int, text string")
    got = {r["i"]: r["t"] for r in df.select("i", tx.clean_tokens("text", ["the"]).alias("t")).collect()}
    assert got[0] == ["cat", "dog"] * 49_999 and got[1] == got[2] == got[4] == got[6] == [] and got[5] is None
    assert got[3] == ["one", "two"]


@pytest.mark.parametrize("whole", [False, True])
def test_ten_thousand_terms(spark, whole):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    terms = [t for t in dict.fromkeys(letters(rng.randrange(1, 9)).strip() for _ in range(30_000)) if t and "  " not in t][:10_000]
    dictionary = {"even": terms[::2] + terms[:3], "odd": terms[1::2], "all": terms, "none": ["zzz"]}
    docs = [(i, " ".join(letters(rng.randrange(400)).split())) for i in range(30)] + [(90, None), (91, ""), (92, "aaaa aa a")]
    got = {(r["i"], r["category"]): r["hits"] for r in art.count_terms(
        spark.createDataFrame(docs, "i int, t string"), "i", "t", dictionary, whole_word=whole).collect()}
    want = {}
    for i, t in docs:
        for category, listed in dictionary.items():
            for term in dict.fromkeys(listed):
                times = sum(x.count(term) for x in dictionary.values())
                spaced = f" {(t or '').replace(' ', '  ')} "
                n = spaced.count(f" {term.replace(' ', '  ')} ") if whole else (t or "").count(term)
                if n:
                    want[i, category] = want.get((i, category), 0) + n * times
    assert got == want


def test_texts_are_passed_over_once(spark):
    df = spark.createDataFrame([("tariff on america", 1), (None, 2), ("cut tax in ohio", 3)], "t string, i int")
    once = art.classify(df, "t", TERMS, one_pass=True)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("hits(t") == 1
    assert sorted(map(str, once.collect())) == sorted(map(str, art.classify(df, "t", TERMS).collect()))
