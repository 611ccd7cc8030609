"""Queries over documents: clean-up, classification, phrases, indices and the comparison page."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderlens.functions import text as tx
from tenderlens.functions.dictionary import COUNTRY_CATEGORY, TARIFF_CATEGORY, TERMS
from tenderlens.operators import aggregates as agg
from tenderlens.operators import articles as art
from tenderlens.operators import correlation as corr
from tenderlens.operators import filters as flt
from tenderlens.operators import phrases as ph
from tenderlens.operators import policy_index as idx
from tenderlens.operators import ranking, reshape, rolling, sections
from tenderlens.workload import views as v
from tenderlens.workload.market import matrix_sql, r_sql
from tenderlens.workload.registry import near, nears, query, rounded, settled
from tenderlens.workload.views import TEST_STOPWORDS, TEST_TERMS, using

INDICES = ["fiscal_policy_index", "tariff_fiscal_index", "non_tariff_fiscal_index"]
# Metrics offered next to the indices, in menu order.
METRICS = ["bid_to_cover_ratio", "primary_dealer_share", "fima_share", "soma_accepted_millions",
           "ten_year_yield", "two_year_yield", "five_year_yield", "thirty_year_yield",
           "total_accepted_millions", "avg_offering_millions", "yield_spread",
           "direct_bidder_share", "indirect_bidder_share", "fima_accepted_millions", "soma_share"]
MATRIX = [*INDICES, "bid_to_cover_ratio", "avg_high_yield", "fima_share", "soma_share"]

# --- the clean-up as SQL -----------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in TEST_STOPWORDS)
_PLAIN = r"regexp_replace(replace(text, chr(1), ' '), '\([^)]*\)', '', 'g')"
_MARKED = rf"regexp_replace({_PLAIN}, '([.!?])\s+', '\1' || chr(1), 'g')"
# RE2 knows only ASCII word borders, so accented letters stand in as '_' before the country rule;
# the token rule drops both alike.
_ACCENTS = r"regexp_replace({0}, '[^\x00-\x7F]', '_', 'g')"
_COUNTRY = r"regexp_replace({0}, '(?i)\b(?:u\.?\s*s\.?|usa|u\.?\s*s\.?\s*a\.?)\b', 'america', 'g')"


def _noun(t: str) -> str:
    endings = " ".join(f"WHEN ends_with({t}, '{e}') THEN left({t}, -{len(e)}) || '{b}'"
                       for e, b in tx.NOUN_ENDINGS)
    kept = " ".join(f"WHEN ends_with({t}, '{e}') THEN {t}" for e in tx.KEPT_ENDINGS)
    return f"CASE {endings} {kept} WHEN ends_with({t}, 's') THEN left({t}, -1) ELSE {t} END"


def _tokens(source: str) -> str:
    return (f"list_filter(string_split(regexp_replace(lower({source}), '[^a-z0-9]+', ' ', 'g'), ' '), "
            "lambda t: t <> '')")


_CLEAN = {
    "marked": rf"""SELECT doc_id, source, regexp_replace(lower({_COUNTRY.format(_ACCENTS.format(_MARKED))}),
        '[^a-z0-9\x01]+', ' ', 'g') AS body FROM documents""",
    "kept": f"""SELECT doc_id, source, list_filter(list_transform(string_split(body, chr(1)), lambda s:
        list_filter(string_split(s, ' '), lambda t: t <> '' AND t NOT IN ({_STOP}))), lambda w: len(w) > 0)
        AS sentences FROM marked""",
    "clean": f"""SELECT doc_id, source, coalesce(list_transform(flatten(sentences[1:len(sentences) - 1]),
        lambda t: {_noun('t')}), []) AS tokens FROM kept""",
}


def _clean_tokens(docs):
    return docs.withColumn("tokens", tx.clean_tokens("text", TEST_STOPWORDS))


def _docs(spark, sf):
    return v.table(spark, sf, "documents")


# --- single steps ------------------------------------------------------------------------


@query("strip_parentheses", r"""SELECT doc_id, md5(regexp_replace(text, '\([^)]*\)', '', 'g')) AS digest
    FROM documents""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(tx.strip_parentheses("text")).alias("digest"))


@query("split_sentences", r"""SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, md5(s[1]) AS first_digest,
    md5(array_to_string(s, chr(2))) AS digest FROM (
    SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)""")
def _(spark, sf):
    return _docs(spark, sf).withColumn("s", tx.split_sentences("text")).select(
        "doc_id", F.size("s").alias("sentences"), F.md5(F.col("s")[0]).alias("first_digest"),
        F.md5(F.array_join("s", "\u0002")).alias("digest"))


_HTML_COUNTRY = _COUNTRY.format(_ACCENTS.format("html"))


@query("normalize_country", f"""SELECT page_id, CAST(length(c) AS INTEGER) AS n_chars,
    CAST((length(c) - length(replace(c, 'america', ''))) / 7 AS BIGINT) AS mentions
    FROM (SELECT page_id, {_HTML_COUNTRY} AS c FROM pages)""")
def _(spark, sf):
    named = v.table(spark, sf, "pages").withColumn("c", tx.normalize_country("html"))
    return named.select("page_id", F.length("c").alias("n_chars"), tx.occurrences("c", "america").alias("mentions"))


@query("normalize_tokens", f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens,
    md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)""")
def _(spark, sf):
    return _docs(spark, sf).withColumn("t", tx.normalize_tokens("text")).select(
        "doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("remove_stopwords", f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens,
    md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id,
    list_filter({_tokens('text')}, lambda t: t NOT IN ({_STOP})) AS t FROM documents)""")
def _(spark, sf):
    kept = tx.remove_stopwords(tx.normalize_tokens("text"), TEST_STOPWORDS)
    return _docs(spark, sf).withColumn("t", kept).select(
        "doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


TEST_LEMMAS = {"the": "article", "of": "preposition", "thion": "thio", "les": "le", "des": "de", "was": "be"}
_LEMMA = " ".join(f"WHEN token = '{word}' THEN '{base}'" for word, base in TEST_LEMMAS.items())


@query("lemmatize_map", f"""SELECT token, CASE {_LEMMA} ELSE {_noun('token')} END AS base, count(*) AS n FROM (
    SELECT unnest({_tokens('text')}) AS token FROM documents) GROUP BY token""")
def _(spark, sf):
    words = _docs(spark, sf).select(F.explode(tx.normalize_tokens("text")).alias("token"))
    counted = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("token", tx.lemmatize(F.array("token"), TEST_LEMMAS)[0].alias("base"), "n")


@query("lemmatize", f"""SELECT token, {_noun('token')} AS base, count(*) AS n FROM (
    SELECT unnest({_tokens('text')}) AS token FROM documents) GROUP BY token""")
def _(spark, sf):
    words = _docs(spark, sf).select(F.explode(tx.normalize_tokens("text")).alias("token"))
    counted = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("token", tx.lemmatize(F.array("token"))[0].alias("base"), "n")


@query("clean_document", using("", """SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens,
    md5(array_to_string(tokens, ' ')) AS digest FROM clean""", **_CLEAN))
def _(spark, sf):
    return _clean_tokens(_docs(spark, sf)).select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


# --- dumps, sections, article table ------------------------------------------------------

BLOCK_DOCS = 10_000


def dump_parts(spark, sf):
    """Documents as parts of text dumps, with scattered blanks in the details."""
    date = F.date_format("date", "MMM d, yyyy")
    broken = F.concat(F.substring(date, 1, 2), F.lit(" "), F.substring(date, 3, 100))
    return _docs(spark, sf).select(
        "doc_id", F.col("source").alias("file"),
        F.date_add(F.lit("1995-01-01").cast("date"), ((F.col("doc_id") % 250) * 9).cast("int")).alias("date"),
        "text").select(
        "doc_id", "file",
        F.concat(
            F.array(F.lit("page header"), F.lit("Full Text")), F.split("text", "\n"),
            F.array(F.lit("Details"), F.lit("subject: news"),
                    F.concat(F.lit("Publication date: "), broken),
                    F.concat(F.lit("ProQuest documentID: "), F.col("doc_id").cast("string")),
                    F.lit("Links"), F.lit("page footer"))).alias("lines"))


def dump_lines(spark, sf):
    return dump_parts(spark, sf).select(
        "file", F.floor(F.col("doc_id") / BLOCK_DOCS).alias("block"), "doc_id",
        F.posexplode("lines").alias("pos", "line")).select(
        "file", "block", F.struct("doc_id", "pos").alias("line_no"), "line")


@query("extract_sections", """SELECT source AS file,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number,
    md5(lower(replace(text, chr(10), ' ')) || ' ') AS article_digest, CAST(doc_id AS VARCHAR) AS article_id,
    DATE '1995-01-01' + CAST((doc_id % 250) * 9 AS INT) AS date FROM documents""")
def _(spark, sf):
    return sections.extract_sections(dump_lines(spark, sf)).select(
        "file", "number", F.md5("article").alias("article_digest"),
        sections.parse_article_id("details").alias("article_id"),
        sections.parse_broken_date("details").alias("date"))


def _hits(category: str) -> str:
    return v.hits_sql(category)


_FLAGS = f"""({' + '.join(f"CAST({_hits(c)} > 0 AS INT)" for c in TEST_TERMS)}) >= 2
    AND {_hits('america')} > 0 AS is_fiscal_article, {_hits('tariffs_trade')} > 0 AS has_tariff"""


@query("article_table", using("", f"""SELECT file, article_id, date, {_FLAGS} FROM (
    SELECT source AS file, CAST(doc_id AS VARCHAR) AS article_id,
    DATE '1995-01-01' + CAST((doc_id % 250) * 9 AS INT) AS date,
    array_to_string(tokens, ' ') AS text FROM clean)""", **_CLEAN))
def _(spark, sf):
    return art.build_article_table(dump_lines(spark, sf), TEST_TERMS, TEST_STOPWORDS).select(
        "file", "article_id", "date", "is_fiscal_article", "has_tariff")


@query("dedupe_first", """SELECT source, digest, min(doc_id) AS doc_id,
    arg_min(lang, doc_id) AS lang FROM (SELECT source, md5(text) AS digest, doc_id, lang FROM documents)
    GROUP BY source, digest""")
def _(spark, sf):
    docs = _docs(spark, sf).select("source", F.md5("text").alias("digest"), "doc_id", "lang")
    return sections.dedupe_first(docs, ["source", "digest"], "doc_id")


# --- dictionary --------------------------------------------------------------------------


@query("count_terms", using("articles", " UNION ALL ".join(
    f"SELECT article_id, '{c}' AS category, {_hits(c)} AS hits FROM articles WHERE {_hits(c)} > 0"
    for c in TEST_TERMS)))
def _(spark, sf):
    return art.count_terms(v.articles(spark, sf), "article_id", "text", TEST_TERMS)


@query("count_terms_whole_word", using("", """SELECT doc_id, term, count(*) AS n FROM (
    SELECT doc_id, unnest(tokens) AS term FROM clean) WHERE term IN ('ing', 'ion') GROUP BY ALL""",
                                       **_CLEAN))
def _(spark, sf):
    docs = _docs(spark, sf).select("doc_id", tx.clean_document("text", TEST_STOPWORDS).alias("text"))
    return art.count_terms(docs, "doc_id", "text", {"ing": ["ing"], "ion": ["ion"]}, whole_word=True).select(
        "doc_id", F.col("category").alias("term"), F.col("hits").alias("n"))


@query("classify_articles", using("flagged", "SELECT article_id, date, is_fiscal_article, has_tariff FROM flagged"))
def _(spark, sf):
    return v.flagged_articles(spark, sf)


# --- phrases -----------------------------------------------------------------------------

_GRAMS = {
    **_CLEAN,
    "letters": """SELECT doc_id, list_filter(tokens, lambda t: regexp_full_match(t, '[A-Za-z]+')) AS t FROM clean""",
    "grams": """SELECT unnest(t) AS phrase, 1 AS words FROM letters
        UNION ALL SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])), 2 FROM letters
        UNION ALL SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])), 3 FROM letters""",
    "counts": "SELECT phrase, count(*) AS \"count\" FROM grams GROUP BY phrase",
}
_STREAM = {
    **_CLEAN,
    "stream": """SELECT token, lead(token) OVER w AS second, lead(token, 2) OVER w AS third FROM (
        SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT doc_id,
        list_filter(tokens, lambda t: regexp_full_match(t, '[A-Za-z]+')) AS t FROM clean))
        WINDOW w AS (ORDER BY doc_id, i)""",
    "counts": """SELECT phrase, count(*) AS \"count\" FROM (SELECT token AS phrase FROM stream
        UNION ALL SELECT token || ' ' || second FROM stream WHERE second IS NOT NULL
        UNION ALL SELECT token || ' ' || second || ' ' || third FROM stream WHERE third IS NOT NULL) GROUP BY phrase""",
}


def _sql(body: str, views: dict[str, str]) -> str:
    return using("", body, **views)


# The counts of all phrases, folded to how many phrases of n words occur k times.
_FOLDED = """SELECT CAST(len(string_split(phrase, ' ')) AS INTEGER) AS words, "count", count(*) AS n_phrases
    FROM counts GROUP BY ALL"""


def _fold(counts):
    blanks = F.octet_length("phrase") - F.octet_length(F.replace("phrase", F.lit(" "), F.lit("")))
    return counts.groupBy((blanks + 1).alias("words"), "count").agg(F.count(F.lit(1)).alias("n_phrases"))


def _counts(spark, sf, stitched=False):
    docs = _docs(spark, sf).select("doc_id", "text")
    tokens = _clean_tokens(docs if stitched else ph.in_pieces(docs, "text"))
    return ph.ngram_counts(tokens, "tokens", stitch_order=["doc_id"] if stitched else None)


def _top(spark, sf, stitched=False):
    docs = _clean_tokens(_docs(spark, sf).select("doc_id", "text"))
    grams = ph.Grams(docs, "tokens", stitch_order=["doc_id"] if stitched else None, settle=stitched)
    return ph.top_ngrams(ph.frequent_ngrams(grams))


@query("unigram_counts", _sql('SELECT phrase, count(*) AS "count" FROM grams WHERE words = 1 GROUP BY phrase', _GRAMS))
def _(spark, sf):
    return ph.ngram_counts(_clean_tokens(_docs(spark, sf)), "tokens", (1,))


@query("ngram_counts", _sql(_FOLDED, _GRAMS))
def _(spark, sf):
    return _fold(_counts(spark, sf))


@query("ngram_counts_stitched", _sql(_FOLDED, _STREAM))
def _(spark, sf):
    return _fold(_counts(spark, sf, stitched=True))


@query("top_ngrams", _sql('SELECT phrase, "count" FROM counts ORDER BY "count" DESC, phrase LIMIT 500', _GRAMS))
def _(spark, sf):
    return _top(spark, sf)


@query("top_ngrams_stitched", _sql('SELECT phrase, "count" FROM counts ORDER BY "count" DESC, phrase LIMIT 500', _STREAM))
def _(spark, sf):
    return _top(spark, sf, stitched=True)


@query("distinct_phrases", _sql("SELECT count(*) AS n_phrases FROM counts", _GRAMS))
def _(spark, sf):
    return ph.distinct_phrases(_counts(spark, sf))


@query("top_phrases", _sql('SELECT phrase, "count" FROM counts ORDER BY "count" DESC, phrase LIMIT 50', _GRAMS))
def _(spark, sf):
    return ranking.top_phrases(_counts(spark, sf))


@query("phrase_stats", _sql("""SELECT count(*) AS n_phrases, arg_min(phrase, (-"count", phrase)) AS top_phrase,
    max("count") AS top_count FROM counts""", _GRAMS))
def _(spark, sf):
    return ranking.phrase_stats(_counts(spark, sf))


# --- indices -----------------------------------------------------------------------------


@query("daily_article_counts", using("article_days", "SELECT * FROM article_days"))
def _(spark, sf):
    return idx.daily_article_counts(v.flagged_articles(spark, sf))


_RATES = list(idx.RATES)


@query("normalized_index", using("index_daily", f"""SELECT date, total_articles, fiscal_articles,
    tariff_fiscal_articles, non_tariff_fiscal_articles, {nears(*_RATES, *INDICES, digits=8)} FROM index_daily"""))
def _(spark, sf):
    return settled(v.index_daily(spark, sf), 8)


@query("normalized_index_v1", using(
    "flagged", """SELECT date, is_fiscal_article, total_articles, rate,
    round_even(rate / nullif((SELECT avg(rate) FROM rated1), 0) * 100, 4) AS fiscal_policy_index FROM rated1""",
    rated1="""SELECT date, CAST(sum(CAST(is_fiscal_article AS INT)) AS BIGINT) AS is_fiscal_article,
    count(*) AS total_articles, round_even(sum(CAST(is_fiscal_article AS INT)) * 1.0::DOUBLE / count(*), 4) AS rate
    FROM flagged GROUP BY date"""))
def _(spark, sf):
    return idx.normalized_index_v1(v.flagged_articles(spark, sf))


@query("overall_share", using("article_days", """SELECT CAST(sum(fiscal_articles) AS BIGINT) AS fiscal_articles,
    CAST(sum(tariff_fiscal_articles) AS BIGINT) AS tariff_articles,
    CAST(sum(total_articles) AS BIGINT) AS total_articles,
    round_even(sum(fiscal_articles)::DOUBLE / sum(total_articles)::DOUBLE * 100, 2) AS fiscal_share_pct
    FROM article_days"""))
def _(spark, sf):
    return idx.overall_share(idx.daily_article_counts(v.flagged_articles(spark, sf)))


@query("index_kpis", using("index_daily", """SELECT CAST(coalesce(sum(total_articles), 0) AS BIGINT) AS total_articles,
    round(avg(rate) * 100, 8) AS avg_fiscal_rate_pct, round(arg_max(fiscal_policy_index, date), 8) AS latest_index,
    round(avg(tariff_rate) * 100, 8) AS avg_tariff_rate_pct FROM index_daily"""))
def _(spark, sf):
    return rounded(agg.index_kpis(v.index_daily(spark, sf)), 8)


@query("avg_articles_by_kind", using("article_days", """SELECT 'Tariff' AS "type",
    round(avg(tariff_fiscal_articles), 8) AS average_articles FROM article_days
    UNION ALL SELECT 'Non-Tariff', round(avg(non_tariff_fiscal_articles), 8) FROM article_days"""))
def _(spark, sf):
    return rounded(agg.avg_articles_by_kind(idx.daily_article_counts(v.flagged_articles(spark, sf))), 8)


def _over(column: str, rows: int) -> str:
    return f"avg({column}) OVER (ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def _smooth_sql(rows: int) -> str:
    return using("index_daily", "SELECT date, " + ", ".join(
        f"{near(_over(c, rows), 8)} AS {c}_smooth" for c in INDICES) + " FROM index_daily")


for _rows in (7, 30, 90):
    @query(f"smooth_index_{_rows}", _smooth_sql(_rows))
    def _(spark, sf, rows=_rows):
        smoothed = rolling.smooth(v.index_daily(spark, sf), INDICES, rows=rows)
        return settled(smoothed.select("date", *[f"{c}_smooth" for c in INDICES]), 8)


@query("rolling_mean_strict", using("index_daily", """SELECT date, CASE WHEN row_number() OVER (ORDER BY date) >= 7
    THEN """ + near(_over("fiscal_policy_index", 7), 8) + """ END AS fiscal_policy_index_avg FROM index_daily"""))
def _(spark, sf):
    averaged = rolling.rolling_mean_strict(v.index_daily(spark, sf), ["fiscal_policy_index"])
    return settled(averaged.select("date", "fiscal_policy_index_avg"), 8)


# --- comparison of auctions and indices --------------------------------------------------


@query("daily_join", using("daily", f"""SELECT date, auction_count, total_articles,
    {nears('bid_to_cover_ratio', *INDICES, digits=8)} FROM daily"""))
def _(spark, sf):
    return settled(v.daily(spark, sf).select(
        "date", "auction_count", "total_articles", "bid_to_cover_ratio", *INDICES), 8)


@query("smooth_comparison", using("daily", "SELECT date, " + ", ".join(
    f"{near(_over(c, 30), 8)} AS {c}_smooth" for c in [*INDICES, *METRICS]) + " FROM daily"))
def _(spark, sf):
    smoothed = rolling.smooth(v.daily(spark, sf), [*INDICES, *METRICS], rows=30)
    return settled(smoothed.select("date", *[f"{c}_smooth" for c in [*INDICES, *METRICS]]), 8)


_PAIRS = " UNION ALL ".join(
    f"SELECT '{x}' AS index_name, '{y}' AS metric, {r_sql(x, y, 12)} AS r, "
    f"count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS n_obs FROM daily"
    for x in INDICES for y in METRICS)


@query("corr_pairs", using("daily", f"""SELECT index_name, metric, round(r, 4) AS r,
    CASE WHEN abs(r) > 0.5 THEN 'Strong' WHEN abs(r) > 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength,
    CASE WHEN r > 0 THEN 'Positive' ELSE 'Negative' END AS direction, n_obs FROM ({_PAIRS}) WHERE n_obs >= 10"""))
def _(spark, sf):
    return corr.corr_pairs(v.daily(spark, sf), INDICES, METRICS)


@query("corr_matrix", using("daily", matrix_sql("daily", MATRIX)))
def _(spark, sf):
    return rounded(corr.corr_matrix(v.daily(spark, sf), MATRIX))


@query("policy_correlations", using("daily", f"""SELECT {r_sql('fiscal_policy_index', 'bid_to_cover_ratio')} AS index_btc,
    {r_sql('fiscal_policy_index', 'avg_high_yield')} AS index_yield,
    {r_sql('tariff_fiscal_index', 'bid_to_cover_ratio')} AS tariff_btc,
    CASE WHEN count(*) FILTER (WHERE fiscal_policy_index IS NOT NULL AND fima_share IS NOT NULL) > 10
    THEN {r_sql('fiscal_policy_index', 'fima_share')} END AS index_fima FROM daily"""))
def _(spark, sf):
    return rounded(corr.policy_correlations(v.daily(spark, sf)))


@query("ols_trendline", using("daily", """SELECT round(regr_slope(bid_to_cover_ratio, fiscal_policy_index), 6) AS slope,
    round(regr_intercept(bid_to_cover_ratio, fiscal_policy_index), 6) AS intercept,
    round(regr_r2(bid_to_cover_ratio, fiscal_policy_index), 6) AS r2,
    CAST(regr_count(bid_to_cover_ratio, fiscal_policy_index) AS BIGINT) AS n_obs FROM daily"""))
def _(spark, sf):
    return rounded(corr.ols_trendline(v.daily(spark, sf), "fiscal_policy_index", "bid_to_cover_ratio"))


@query("correlation_labels", using("daily", f"""SELECT metric,
    CASE WHEN abs(r) > 0.5 THEN 'Strong' WHEN abs(r) > 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength,
    CASE WHEN r > 0 THEN 'Positive' ELSE 'Negative' END AS direction
    FROM ({_PAIRS}) WHERE index_name = 'fiscal_policy_index' AND n_obs >= 10"""))
def _(spark, sf):
    return corr.corr_pairs(v.daily(spark, sf), ["fiscal_policy_index"], METRICS).select(
        "metric", "strength", "direction")


_SHOWN = ["bid_to_cover_ratio", "primary_dealer_share", "fima_share"]


@query("dual_series", using("daily", " UNION ALL ".join(
    f"SELECT date, '{c}' AS series, {near(_over(c, 30), 8)} AS \"value\", '{axis}' AS axis FROM daily"
    for axis, cs in (("left", INDICES[:2]), ("right", _SHOWN)) for c in cs)))
def _(spark, sf):
    smoothed = rolling.smooth(v.daily(spark, sf), [*INDICES[:2], *_SHOWN], rows=30)
    return settled(reshape.dual_series(smoothed, INDICES[:2], _SHOWN, "_smooth"), 8)


@query("rate_series", using("index_daily", "SELECT date, round(rate, 8) AS rate FROM index_daily ORDER BY date"))
def _(spark, sf):
    return rounded(v.index_daily(spark, sf).select("date", "rate"), 8).orderBy("date")


@query("scatter_index_btc", using("daily", """SELECT date, """ + near("fiscal_policy_index", 8) + """ AS x, """
    + near("bid_to_cover_ratio", 8) + """ AS y FROM daily"""))
def _(spark, sf):
    return settled(reshape.scatter_pairs(v.daily(spark, sf), "fiscal_policy_index", "bid_to_cover_ratio", ("date",)), 8)


@query("export_projection", using("daily", f"""SELECT date, {nears('fiscal_policy_index', *_SHOWN, digits=8)} FROM daily"""))
def _(spark, sf):
    chosen = ["date", "fiscal_policy_index", *_SHOWN, "no_such_column"]
    return settled(reshape.export_projection(v.daily(spark, sf), chosen), 8)


@query("recent_rows", using("index_daily", """SELECT date, total_articles, fiscal_articles, tariff_fiscal_articles,
    round(fiscal_policy_index, 8) AS fiscal_policy_index FROM index_daily ORDER BY date DESC LIMIT 20"""))
def _(spark, sf):
    columns = ["date", "total_articles", "fiscal_articles", "tariff_fiscal_articles", "fiscal_policy_index"]
    return rounded(ranking.recent_rows(v.index_daily(spark, sf), columns), 8)


@query("comparison_window", using("daily", """SELECT date, round(fiscal_policy_index, 8) AS fiscal_policy_index FROM daily
    WHERE date >= DATE '1997-01-01' AND date < DATE '1999-01-01'"""))
def _(spark, sf):
    window = flt.date_window(v.daily(spark, sf), "date", "1997-01-01", "1998-12-31")
    return rounded(window.select("date", "fiscal_policy_index"), 8)


# --- the default dictionary --------------------------------------------------------------

# Real terms, planted in front of the invented prose of the documents.
_PLANTED = ("U.S. tariffs rose again. ", "The U.S. budget deficits and taxes grew. ", "Trade policies changed. ", "")
_PLANT = " ".join(f"WHEN {i} THEN '{words}'" for i, words in enumerate(_PLANTED))
_DEFAULT = {
    "documents_planted": f"SELECT doc_id, source, CASE doc_id % 4 {_PLANT} END || text AS text FROM documents",
    "marked": _CLEAN["marked"].replace("FROM documents", "FROM documents_planted"),
    "kept": _CLEAN["kept"], "clean": _CLEAN["clean"],
    "terms": "SELECT category, array_to_string(list_transform(string_split(term, ' '), lambda t: " + _noun("t")
             + "), ' ') AS term FROM (VALUES " + ", ".join(
                 f"('{category}', '{term}')" for category, terms in TERMS.items() for term in terms) + ") AS t(category, term)",
}


@query("classify_default", _sql(f"""SELECT doc_id,
    count(DISTINCT category) >= 2 AND coalesce(bool_or(category = '{COUNTRY_CATEGORY}'), FALSE) AS is_fiscal_article,
    coalesce(bool_or(category = '{TARIFF_CATEGORY}'), FALSE) AS has_tariff
    FROM (SELECT doc_id, array_to_string(tokens, ' ') AS cleaned FROM clean) LEFT JOIN terms ON contains(cleaned, term)
    GROUP BY doc_id""", _DEFAULT))
def _(spark, sf):
    """The default dictionary in base form, on documents in which some of its terms are planted."""
    k = F.col("doc_id") % 4
    planted = F.when(k == 0, _PLANTED[0]).when(k == 1, _PLANTED[1]).when(k == 2, _PLANTED[2]).otherwise(_PLANTED[3])
    docs = _docs(spark, sf).select("doc_id", F.concat(planted, F.col("text")).alias("text"))
    cleaned = docs.select("doc_id", tx.clean_document("text", TEST_STOPWORDS).alias("text"))
    return art.classify(cleaned, "text", art.lemmatize_dictionary(spark)).drop("text")
