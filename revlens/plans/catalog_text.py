"""Registered queries: reading, projections, filters, joins, set ops, text cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.porter import stem_sql
from ..functions.words import ENGLISH_STOP_WORDS
from ..operators import relational as R
from ..operators import vocab as V
from . import common as C
from . import sqltext as S
from .registry import register

CORPUS = "WITH " + S.CORPUS_CTE + " "


# --- 2.1 sources -----------------------------------------------------------------

@register("read_corpus", CORPUS + "SELECT doc_id, text, genre, title, review_type, descriptor FROM corpus")
def read_corpus(spark, d):
    return C.corpus(spark, d).select("doc_id", "text", "genre", "title", "review_type", "descriptor")


@register("to_documents", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def to_documents(spark, d):
    return R.to_documents(C.docs(spark, d))


_PROFILE_COLS = [("doc_id", "bigint"), ("text", "string"), ("genre", "string"), ("title", "string"),
                 ("review_type", "string"), ("descriptor", "string")]


@register("profile_table", CORPUS + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, {i} AS position, count({c}) AS non_null FROM corpus"
    for i, (c, t) in enumerate(_PROFILE_COLS)))
def profile_table(spark, d):
    df = C.corpus(spark, d).select(*[c for c, _ in _PROFILE_COLS])
    return R.profile_table(df)


@register("peek", CORPUS + "SELECT doc_id, descriptor FROM corpus ORDER BY descriptor LIMIT 5")
def peek(spark, d):
    return R.top_k(C.corpus(spark, d).select("doc_id", "descriptor"), 5, [F.col("descriptor")])


# --- 2.2 projections and filters -------------------------------------------------

@register("descriptor", CORPUS + "SELECT doc_id, descriptor FROM corpus")
def descriptor(spark, d):
    return C.corpus(spark, d).select("doc_id", "descriptor")


@register("sort_by_descriptor", CORPUS + "SELECT descriptor, doc_id FROM corpus ORDER BY descriptor")
def sort_by_descriptor(spark, d):
    return C.corpus(spark, d).select("descriptor", "doc_id").orderBy("descriptor")


@register("filter_by_descriptor", CORPUS + """
, targets AS (SELECT descriptor FROM corpus WHERE doc_id IN (SELECT min(doc_id) FROM corpus GROUP BY title))
SELECT doc_id, descriptor, text FROM corpus WHERE descriptor IN (SELECT descriptor FROM targets)""")
def filter_by_descriptor(spark, d):
    c = C.corpus(spark, d)
    return R.filter_in(c, "descriptor", C.target_ids(spark, d)).select("doc_id", "descriptor", "text")


@register("subset_by_genre", CORPUS + """
SELECT doc_id, 'target' AS subset FROM corpus WHERE genre = 'en'
UNION ALL SELECT doc_id, 'rest' AS subset FROM corpus WHERE genre IS DISTINCT FROM 'en'""")
def subset_by_genre(spark, d):
    c = C.corpus(spark, d)
    a, b = R.subset_by_value(c, "genre", "en")
    return (a.select("doc_id", F.lit("target").alias("subset"))
            .unionByName(b.select("doc_id", F.lit("rest").alias("subset"))))


@register("add_flags", CORPUS + """
SELECT doc_id,
       coalesce(doc_id IN (SELECT doc_id FROM corpus WHERE title = 'src3'), false) AS is_title,
       coalesce(doc_id IN (SELECT doc_id FROM corpus WHERE genre = 'de'), false) AS is_genre
FROM corpus""")
def add_flags(spark, d):
    c = C.corpus(spark, d)
    flags = {"is_title": c.where(F.col("title") == "src3").select("doc_id"),
             "is_genre": c.where(F.col("genre") == "de").select("doc_id")}
    return R.add_flags(c.select("doc_id"), flags)


@register("filter_title", CORPUS + "SELECT doc_id, descriptor FROM corpus WHERE title = 'src7'")
def filter_title(spark, d):
    return C.corpus(spark, d).where(F.col("title") == "src7").select("doc_id", "descriptor")


@register("sentiment_label", CORPUS + """
SELECT doc_id, CASE WHEN split_part(lower(review_type), ' ', 1) = 'negative' THEN 0 ELSE 1 END AS label
FROM corpus""")
def sentiment_label(spark, d):
    c = C.corpus(spark, d)
    return c.select("doc_id", R.sentiment_label(F.col("review_type")).alias("label"))


@register("separate_target", CORPUS + "SELECT doc_id, descriptor, genre AS target FROM corpus")
def separate_target(spark, d):
    return R.separate_target(C.corpus(spark, d), "genre").select("doc_id", "descriptor", "target")


@register("text_variants", CORPUS + f"""
SELECT doc_id,
       CASE WHEN split_part(lower(review_type), ' ', 1) = 'negative' THEN 0 ELSE 1 END AS label,
       {S.join_tokens(S.clean_doc('text'))} AS processed_text,
       {S.strip_lower('text')} AS raw_text,
       {S.clean_non_ascii(S.strip_lower('text'))} AS raw_text_cleaned
FROM corpus""")
def text_variants(spark, d):
    c = C.corpus(spark, d)
    return c.select("doc_id", R.sentiment_label(F.col("review_type")).alias("label"),
                    T.join_tokens(T.clean_doc("text")).alias("processed_text"),
                    T.strip_lower("text").alias("raw_text"),
                    T.clean_non_ascii(T.strip_lower("text")).alias("raw_text_cleaned"))


# --- 2.3 joins -------------------------------------------------------------------

@register("lookup_join", CORPUS + f"""
SELECT c.descriptor, c.title, CAST(len({S.tokenize(S.normalize('d.text'))}) AS BIGINT) AS n_tokens
FROM documents d JOIN corpus c ON d.doc_id = c.doc_id""")
def lookup_join(spark, d):
    toks = C.docs(spark, d).select("doc_id", F.size(T.tokenize_words(T.normalize_text("text")))
                                   .cast("bigint").alias("n_tokens"))
    dim = C.corpus(spark, d)
    return R.lookup_join(toks, dim, "doc_id", ["descriptor", "title"]).select("descriptor", "title", "n_tokens")


@register("semi_join_ids", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_ids(spark, d):
    ids = C.fixtures.load_table(spark, d, "labels").where("quality = 1").select("doc_id")
    docs = C.fixtures.load_table(spark, d, "documents").select("doc_id", "source")
    return R.filter_in(docs, "doc_id", ids)


@register("anti_join_ids", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def anti_join_ids(spark, d):
    ids = C.fixtures.load_table(spark, d, "labels").where("quality = 1").select("doc_id")
    docs = C.fixtures.load_table(spark, d, "documents").select("doc_id", "source")
    return R.filter_not_in(docs, "doc_id", ids)


@register("align_by_position", CORPUS + f"""
SELECT doc_id, s.pos AS sent_id, s.sentence, CAST(len({S.words_of('s.sentence')}) AS BIGINT) AS n_words
FROM corpus, LATERAL (SELECT generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS sentence
                      FROM (SELECT {S.sentences('text')} AS x)) s""")
def align_by_position(spark, d):
    # parallel arrays (sentences, their word counts) zipped into rows
    c = C.docs(spark, d).select("doc_id", T.sentences("text").alias("s"))
    c = c.select("doc_id", F.arrays_zip(F.col("s").alias("sentence"),
                                        F.transform("s", lambda x: F.size(T.words_of(x)).cast("bigint")).alias("n_words")).alias("z"))
    return T.posexplode_rows(c, ["doc_id"], F.col("z"), "sent_id", "r").select(
        "doc_id", "sent_id", "r.sentence", "r.n_words")


# --- 2.7 set operations ----------------------------------------------------------

@register("union_distinct", "SELECT source AS key, lang AS grp FROM documents UNION SELECT source, lang FROM documents WHERE n_chars > 1000")
def union_distinct(spark, d):
    docs = C.fixtures.load_table(spark, d, "documents")
    a = docs.select(F.col("source").alias("key"), F.col("lang").alias("grp"))
    b = docs.where("n_chars > 1000").select(F.col("source").alias("key"), F.col("lang").alias("grp"))
    return R.union_distinct(a, b)


@register("stopword_union", "SELECT w AS word FROM (SELECT unnest(" + S.list_lit(ENGLISH_STOP_WORDS) + ") AS w "
          "UNION SELECT ' ' UNION SELECT '' "
          "UNION SELECT DISTINCT unnest(" + S.tokenize(S.normalize('text')) + ") FROM benchmark)")
def stopword_union(spark, d):
    # the library list, the two blank tokens and a second, user-supplied word
    # list (here: the words of the benchmark table)
    a = spark.createDataFrame([(w,) for w in ENGLISH_STOP_WORDS] + [(" ",), ("",)], "word string")
    bench = C.fixtures.load_table(spark, d, "benchmark")
    c = T.explode_rows(bench, [], T.tokenize_words(T.normalize_text("text")), "word")
    return R.union_distinct(a, c)


@register("append_rows", "SELECT 'documents' AS src, item AS id, text FROM (SELECT doc_id AS item, coalesce(text,'') AS text FROM documents) "
          "UNION ALL SELECT 'benchmark', item_id, text FROM benchmark")
def append_rows(spark, d):
    a = C.docs(spark, d).select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), "text")
    b = C.fixtures.load_table(spark, d, "benchmark").select(F.lit("benchmark").alias("src"),
                                                            F.col("item_id").alias("id"), "text")
    return a.unionByName(b)


# --- 2.8 text functions --------------------------------------------------------------

@register("remove_punctuation", "SELECT doc_id, regexp_replace(coalesce(text,''), '[^a-zA-Z]', ' ', 'g') AS out FROM documents")
def remove_punctuation(spark, d):
    return C.docs(spark, d).select("doc_id", T.remove_punctuation("text").alias("out"))


@register("lower_case", "SELECT doc_id, lower(coalesce(text,'')) AS out FROM documents")
def lower_case(spark, d):
    return C.docs(spark, d).select("doc_id", T.lower_case("text").alias("out"))


@register("remove_tags", f"SELECT page_id, regexp_replace({S.escape_brackets('html')}, '&lt;/?.*?&gt;', ' &lt;&gt; ', 'g') AS out FROM pages")
def remove_tags(spark, d):
    pages = C.fixtures.load_table(spark, d, "pages")
    return pages.select("page_id", T.remove_tags(T.escape_html_brackets("html")).alias("out"))


@register("collapse_non_letters", "SELECT doc_id, regexp_replace(lower(regexp_replace(coalesce(text,''), '[^a-zA-Z]', ' ', 'g')), '(\\d|\\W)+', ' ', 'g') AS out FROM documents")
def collapse_non_letters(spark, d):
    return C.docs(spark, d).select(
        "doc_id", T.collapse_non_letters(T.lower_case(T.remove_punctuation("text"))).alias("out"))


@register("normalize_text", f"SELECT doc_id, {S.normalize_stepwise_ascii("coalesce(text,'')")} AS out FROM documents")
def normalize_text(spark, d):
    return C.docs(spark, d).select("doc_id", T.normalize_text("text").alias("out"))


@register("tokenize_words", f"SELECT doc_id, {S.join_tokens(S.tokenize(S.normalize('text')))} AS tokens, "
          f"CAST(len({S.tokenize(S.normalize('text'))}) AS BIGINT) AS n_tokens FROM documents")
def tokenize_words(spark, d):
    t = C.docs(spark, d).select("doc_id", T.tokenize_words(T.normalize_text("text")).alias("t"))
    return t.select("doc_id", T.join_tokens("t").alias("tokens"), F.size("t").cast("bigint").alias("n_tokens"))


@register("remove_stop_words", f"SELECT doc_id, {S.join_tokens(S.remove_stop(S.tokenize(S.normalize('text'))))} AS tokens FROM documents")
def remove_stop_words(spark, d):
    return C.plain_tokens(spark, d).select("doc_id", T.join_tokens("tokens").alias("tokens"))


@register("join_tokens", f"SELECT doc_id, {S.join_tokens(S.tokenize(S.normalize('text')))} AS joined FROM documents")
def join_tokens(spark, d):
    return C.docs(spark, d).select("doc_id", T.join_tokens(T.tokenize_words(T.normalize_text("text"))).alias("joined"))


@register("clean_doc", f"SELECT doc_id, {S.join_tokens(S.clean_doc('text'))} AS tokens, "
          f"CAST(len({S.clean_doc('text')}) AS BIGINT) AS n_tokens FROM documents")
def clean_doc(spark, d):
    t = C.docs(spark, d).select("doc_id", T.clean_doc("text").alias("t"))
    return t.select("doc_id", T.join_tokens("t").alias("tokens"), F.size("t").cast("bigint").alias("n_tokens"))


@register("strip_lower", f"SELECT conv_id, turn, {S.strip_lower('text')} AS out FROM conversations")
def strip_lower(spark, d):
    conv = C.fixtures.load_table(spark, d, "conversations")
    return conv.select("conv_id", "turn", T.strip_lower("text").alias("out"))


@register("clean_non_ascii", f"SELECT doc_id, {S.clean_non_ascii(S.strip_lower('text'))} AS out FROM documents")
def clean_non_ascii(spark, d):
    return C.docs(spark, d).select("doc_id", T.clean_non_ascii(T.strip_lower("text")).alias("out"))


@register("sentences", f"""
SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent_id, unnest(s) AS sentence
FROM (SELECT doc_id, {S.sentences("coalesce(text,'')")} AS s FROM documents)""")
def sentences(spark, d):
    return T.posexplode_rows(C.docs(spark, d), ["doc_id"], T.sentences("text"), "sent_id", "sentence")


@register("flatten_sentences", CORPUS + f"""
SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent_id, unnest(s) AS sentence
FROM (SELECT doc_id, {S.sentences('text')} AS s FROM corpus WHERE title = 'src7')""")
def flatten_sentences(spark, d):
    one = C.corpus(spark, d).where(F.col("title") == "src7")
    return T.posexplode_rows(one, ["doc_id"], T.sentences("text"), "sent_id", "sentence")


@register("lower_words", f"""
SELECT doc_id, array_to_string(list_transform({S.words_of("coalesce(text,'')")}, lambda w: lower(w)), ' ') AS words FROM documents""")
def lower_words(spark, d):
    return C.docs(spark, d).select("doc_id", F.array_join(T.lower_words(T.words_of("text")), " ").alias("words"))


@register("distinct_tokens", f"SELECT DISTINCT unnest({S.tokenize(S.normalize('text'))}) AS token FROM documents")
def distinct_tokens(spark, d):
    return V.distinct_tokens(V.tokenize(C.docs(spark, d)))


def _lemma_sql() -> str:
    from ..functions.words import NOUN_DETACHMENTS
    cands = ["SELECT token, token AS cand, 0 AS ord FROM vocab"]
    for i, (suf, rep) in enumerate(NOUN_DETACHMENTS, start=1):
        cands.append(f"SELECT token, substr(token, 1, length(token) - {len(suf)}) || {S.q(rep)} AS cand, {i} AS ord "
                     f"FROM vocab WHERE suffix(token, {S.q(suf)})")
    return (f"WITH vocab AS (SELECT DISTINCT unnest({S.tokenize(S.normalize('text'))}) AS token FROM documents), "
            f"cands AS ({' UNION ALL '.join(cands)}), "
            "kept AS (SELECT * FROM cands WHERE cand IN (SELECT token FROM vocab)), "
            "best AS (SELECT token, arg_min(cand, (length(cand), ord)) AS lemma FROM kept GROUP BY token) "
            "SELECT v.token, coalesce(b.lemma, v.token) AS lemma FROM vocab v LEFT JOIN best b ON v.token = b.token")


@register("lemmatize", _lemma_sql())
def lemmatize(spark, d):
    vocab = V.distinct_tokens(V.tokenize(C.docs(spark, d)))
    return V.lemma_map(vocab)


_VOCAB = f"vocab AS (SELECT DISTINCT unnest({S.tokenize(S.normalize('text'))}) AS token FROM documents)"


@register("stem", f"WITH {_VOCAB}, {stem_sql('vocab', 'token')} SELECT word AS token, stem FROM porter")
def stem(spark, d):
    """Porter stems of the corpus vocabulary."""
    vocab = V.distinct_tokens(V.tokenize(C.docs(spark, d)))
    return V.stem_map(vocab)


#: (token, term): lemma, then null for a stop word, else the lemma's stem
CLEAN_MAP_CTE = (_lemma_sql().replace("SELECT v.token, coalesce", ", lemmas AS (SELECT v.token, coalesce") + "), "
                 + stem_sql("lemmas", "lemma") + ", clean_map AS (SELECT l.token, CASE WHEN list_contains("
                 + S.list_lit(sorted(set(ENGLISH_STOP_WORDS))) + ", l.lemma) THEN NULL ELSE p.stem END AS term "
                 "FROM lemmas l JOIN porter p ON p.word = l.lemma)")


@register("clean_tokens", CLEAN_MAP_CTE + f""", occ AS (SELECT doc_id, pos, toks[pos] AS token FROM (
   SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS pos FROM (SELECT doc_id, {S.tokenize(S.normalize("coalesce(text, '')"))} AS toks FROM documents))),
clean_kept AS (SELECT o.doc_id, string_agg(m.term, ' ' ORDER BY o.pos) AS tokens FROM occ o JOIN clean_map m ON m.token = o.token
   WHERE m.term IS NOT NULL GROUP BY o.doc_id)
SELECT d.doc_id, coalesce(k.tokens, '') AS tokens FROM documents d LEFT JOIN clean_kept k ON k.doc_id = d.doc_id""")
def clean_tokens(spark, d):
    t = V.clean_tokens(C.docs(spark, d))
    return t.select("doc_id", T.join_tokens("tokens").alias("tokens"))


@register("vocab_join", f"""WITH tr AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
   WHERE substr(md5('1:' || CAST(doc_id AS VARCHAR)), 1, 8) < 'cccccccc'),
te AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
   WHERE substr(md5('1:' || CAST(doc_id AS VARCHAR)), 1, 8) >= 'cccccccc'),
dict AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS term_id FROM (SELECT DISTINCT unnest({S.tokenize(S.normalize('text'))}) AS token FROM tr)),
occ AS (SELECT doc_id, unnest({S.tokenize(S.normalize('text'))}) AS token FROM te)
SELECT o.doc_id, CAST(d.term_id AS BIGINT) AS term_id, count(*) AS n FROM occ o JOIN dict d ON o.token = d.token GROUP BY o.doc_id, d.term_id""")
def vocab_join(spark, d):
    """Token -> dictionary id for held-out reviews (dictionary from the train part,
    ids in sorted order by a distributed running count); unknown tokens dropped."""
    from ..operators import split as SP
    from ..operators.metrics import running_sums
    toks = SP.split_train_test(V.tokenize(C.docs(spark, d)), "doc_id", 0.8, seed=1)
    vocab = V.distinct_tokens(toks.where("split = 'train'")).withColumn("one", F.lit(1)).withColumn("_g", F.lit(0))
    ids = running_sums(vocab, ["_g"], [F.col("token")], ["one"]).select(
        F.col("token").alias("term"), (F.col("cum_one") - 1).alias("term_id"))
    bow = V.bag_of_words(toks.where("split = 'test'"))
    return bow.join(ids, "term").select("doc_id", F.col("term_id").cast("bigint").alias("term_id"), "n")


_ABBREVIATIONS = f"""WITH w AS (SELECT doc_id, pos, ws[pos] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM (
    SELECT doc_id, string_split_regex(coalesce(text, ''), '[{S.WS_CLASS}]+') AS ws FROM documents)) WHERE ws[pos] <> ''),
b AS (SELECT doc_id, pos, word, lower(regexp_extract(word, '{V.PERIOD_WORD}', 1)) AS body FROM w),
words AS (SELECT doc_id, pos, word, CASE WHEN body <> '' THEN regexp_replace(body, '\\.$', '') END AS type, suffix(body, '.') AS period FROM b),
g AS (SELECT type, count(*) AS n, CAST(sum(CASE WHEN period THEN 1 ELSE 0 END) AS BIGINT) AS n_period, length(replace(type, '.', '')) AS letters
      FROM words WHERE type IS NOT NULL GROUP BY type),
p AS (SELECT least(greatest(sum(n_period) / sum(n), 1e-9), 1 - 1e-9) AS p FROM g),
scored AS (SELECT type, n, n_period, round(2 * (n_period * (ln({V.WITH_PERIOD}) - ln(p)) + (n - n_period) * (ln(1 - {V.WITH_PERIOD}) - ln(1 - p)))
      * (length(type) - letters + 1) * exp(-letters - (n - n_period) * ln(letters::DOUBLE)), 9) AS score FROM g, p),
abbr AS (SELECT * FROM scored WHERE n_period > 0 AND score >= {V.ABBREVIATION}) """


@register("abbreviations", _ABBREVIATIONS + "SELECT type, n, n_period, round(score, 6) AS score FROM abbr")
def abbreviations(spark, d):
    """Words that the corpus itself shows to be abbreviations."""
    found = V.abbreviations(V.sentence_words(C.docs(spark, d)))
    return found.withColumn("score", F.round("score", 6))


@register("learned_sentences", _ABBREVIATIONS + f""", ends AS (SELECT w.doc_id, w.pos, w.word,
   CASE WHEN regexp_matches(w.word, '{V.SENTENCE_END.replace("'", "''")}') AND NOT (coalesce(w.period, FALSE) AND (a.type IS NOT NULL OR length(w.type) = 1))
        THEN 1 ELSE 0 END AS e FROM words w LEFT JOIN abbr a ON a.type = w.type),
ids AS (SELECT doc_id, pos, word, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_id FROM ends)
SELECT doc_id, CAST(sent_id AS BIGINT) AS sent_id, string_agg(word, ' ' ORDER BY pos) AS sentence FROM ids GROUP BY doc_id, sent_id""")
def learned_sentences(spark, d):
    """Sentences that do not end at abbreviations or initials."""
    words = C.materialize(V.sentence_words(C.docs(spark, d)))
    return V.learned_sentences(words, V.abbreviations(words)).withColumn("sent_id", F.col("sent_id").cast("bigint"))
