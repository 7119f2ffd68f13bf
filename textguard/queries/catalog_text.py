"""Queries over text: normalisation, lists, rules, verdicts, policy, context."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.operators import aim, cascade, context, normalize, passages, phrase_index, phrases, policy, rules, tier0
from textguard.operators import verdict_store as store
from textguard.operators.model_scorer import BatchScorer
from textguard.plans import activity as A
from textguard.plans import evaluate, traces
from textguard.queries import frames
from textguard.queries import oracle_text as O
from textguard.queries.registry import query
from textguard.sources import sinks


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return frames.text_table(spark, sf, "documents", "doc_id", "text")


def normal_docs(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return normalize.normalize(docs(spark, sf), keep=[*keep] or None)


def normal_messages(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize(frames.messages(spark, sf))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return tier0.tier0_verdict(frames.messages_in_context(spark, sf),
                               keep=["msg_id", "conv_id", "seq", "role", "ts", "text", "squashed"])


def local(spark: SparkSession, sf: str) -> DataFrame:
    return cascade.local_verdict(verdicts(spark, sf))


def rounded(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def cats(name: str = "categories"):
    return F.array_join(name, ",").alias("categories")


DOC_BASE = f"WITH {O.DOCS}"
DOC_PLAIN = f"{DOC_BASE}, {O.plain_ctes('docs')}"
DOC_NORM = f"{DOC_BASE}, {O.norm_ctes('docs')}"
MSG_NORM = f"WITH {O.MESSAGES}, {O.norm_ctes('msg')}"
MSG_T0 = f"WITH {O.MESSAGES}, {O.tier0_ctes('msg', context=True)}"
MSG_LOCAL = f"WITH {O.MESSAGES}, {O.local_ctes('msg', context=True)}"

# ------------------------------------------------------------------ normalisation


@query("strip_invisible", f"SELECT doc_id, md5(translate(text, {O.q(T.INVISIBLE)}, '')) AS digest FROM documents")
def strip_invisible(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.strip_invisible(F.col("text"))).alias("digest"))


@query("fold_unicode", "SELECT doc_id, md5(lower(strip_accents(text))) AS digest FROM documents")
def fold_unicode(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.fold_unicode(F.col("text"))).alias("digest"))


@query("fold_confusables", f"SELECT page_id, md5(translate(html, {O.q(''.join(T.CONFUSABLES))}, {O.q(''.join(T.CONFUSABLES.values()))})) AS digest FROM pages")
def fold_confusables(spark, sf):
    return frames.table(spark, sf, "pages").select("page_id", F.md5(T.fold_confusables(F.col("html"))).alias("digest"))


@query("resolve_masks", f"""{DOC_BASE}, {O.MASKV}, folded AS (SELECT id, lower(strip_accents(text)) AS f FROM docs), {O.mask_ctes()}
SELECT doc_id, count(*) AS masked, count(m.r) AS resolved, string_agg(m.r, ' ' ORDER BY k) AS words FROM (
    SELECT id AS doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT id, string_split(f, ' ') AS ws FROM folded)) c
LEFT JOIN maskmap m ON m.w = c.w WHERE regexp_matches(c.w, '[*#%_]') GROUP BY doc_id""")
def resolve_masks(spark, sf):
    df = docs(spark, sf).withColumn("f", T.fold_unicode(F.col("text"))).withColumn("r", normalize.resolve_masks("f"))
    pairs = F.expr("filter(arrays_zip(split(f, ' '), split(r, ' ')), p -> p.`0` RLIKE '[*#%_]')")
    df = df.select("doc_id", pairs.alias("ps")).filter(F.size("ps") > 0)
    hits = F.expr("filter(ps, p -> p.`0` != p.`1`).`1`")
    return df.select("doc_id", F.size("ps").cast("bigint").alias("masked"), F.size(hits).cast("bigint").alias("resolved"),
                     F.when(F.size(hits) > 0, F.array_join(hits, " ")).alias("words"))


@query("fold_leet", f"{DOC_BASE}, b AS MATERIALIZED (SELECT id, string_split(lower(text), '') AS cs FROM docs) SELECT id AS doc_id, md5({O.leet('cs')}) AS digest FROM b")
def fold_leet(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.fold_leet(F.lower("text"))).alias("digest"))


@query("collapse_space", f"SELECT doc_id, md5({O.space('text')}) AS digest FROM documents")
def collapse_space(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.collapse_space(F.col("text"))).alias("digest"))


@query("collapse_runs", f"""WITH b AS MATERIALIZED (SELECT doc_id, string_split(text, '') AS cs FROM documents)
SELECT doc_id, md5({O.char_runs('cs', 2)}) AS two, md5({O.char_runs('cs', 1)}) AS one FROM b""")
def collapse_runs(spark, sf):
    c = F.col("text")
    return docs(spark, sf).select("doc_id", F.md5(T.collapse_runs(c, 2)).alias("two"), F.md5(T.collapse_runs(c, 1)).alias("one"))


@query("squash", f"""WITH b AS MATERIALIZED (SELECT doc_id, string_split({O.bare('lower(text)')}, '') AS cs FROM documents)
SELECT doc_id, md5({O.char_runs('cs', 1)}) AS key FROM b""")
def squash(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.squash(F.lower("text"))).alias("key"))


@query("tokenize", f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, {O.tokens('lower(text)')} AS t FROM documents)""")
def tokenize(spark, sf):
    df = docs(spark, sf).select("doc_id", T.tokenize(F.lower("text")).alias("t"))
    return df.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("long_run_flag", f"""SELECT doc_id, count(*) AS long_runs FROM (SELECT doc_id, unnest({O.tokens('lower(text)')}) AS w FROM documents)
WHERE w <> {O.runs('w', 2)} GROUP BY doc_id""")
def long_run_flag(spark, sf):
    df = docs(spark, sf).withColumn("t", F.filter(T.tokenize(F.lower("text")), T.long_run_flag))
    return df.filter(F.size("t") > 0).select("doc_id", F.size("t").cast("bigint").alias("long_runs"))


def corpus_words(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct tokens of the documents with the number of documents they are in."""
    tokens = docs(spark, sf).select("doc_id", F.explode(F.array_distinct(T.tokenize(F.lower("text")))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n_docs"))


def corpus_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Words that more than one document uses stand in for a dictionary."""
    return corpus_words(spark, sf).filter("n_docs >= 2").select(F.col("token").alias("term"))


WORDS = f"""cw AS (SELECT w AS token, count(DISTINCT doc_id) AS n_docs
    FROM (SELECT doc_id, unnest({O.tokens('lower(text)')}) AS w FROM documents) GROUP BY w),
dict AS (SELECT token AS term FROM cw WHERE n_docs >= 2)"""


def real_sql(word: str) -> str:
    """Whether a word or one of its stems is in dict."""
    tests = [f"{word} IN (SELECT term FROM dict)"]
    for s in normalize.SUFFIXES:
        stem = f"left({word}, length({word}) - {len(s)})"
        fits = f"ends_with({word}, '{s}') AND length({word}) > {len(s) + 2}"
        tests.append(f"({fits} AND ({stem} IN (SELECT term FROM dict) OR {stem} || 'e' IN (SELECT term FROM dict)"
                     f" OR (right({stem}, 1) = left(right({stem}, 2), 1) AND left({stem}, length({stem}) - 1) IN (SELECT term FROM dict))))")
    return "(" + " OR ".join(tests) + ")"


TARGETS = f"target(word) AS (SELECT unnest({O.arr(normalize.typo_targets())}))"
KEYS = f"keys(a, near) AS (SELECT * FROM {O.values(normalize.adjacency().items())})"


def typo_sql(source: str) -> str:
    """typo_fixes(w, fixed) by comparing each word with each target of its length and first letter."""
    return f"""{TARGETS}, {KEYS},
cand AS (SELECT t.w, g.word, list_filter(range(1, length(t.w) + 1), lambda i: t.w[i] <> g.word[i]) AS d
    FROM (SELECT DISTINCT w FROM {source} WHERE length(w) >= 5 AND regexp_full_match(w, '\\p{{L}}+')) t
    JOIN target g ON length(g.word) = length(t.w) AND g.word[1] = t.w[1]),
near AS (SELECT w, word FROM cand JOIN keys ON a = word[d[1]] WHERE len(d) = 1 AND contains(keys.near, w[d[1]])
    UNION ALL SELECT w, word FROM cand WHERE len(d) = 2 AND d[2] = d[1] + 1 AND w[d[1]] = word[d[2]] AND w[d[2]] = word[d[1]]),
typo_fixes AS (SELECT w, min(word) AS fixed FROM near WHERE NOT {real_sql('w')} GROUP BY w)"""


def stems_sql(source: str, word: str) -> str:
    """stems(word, stem): the word itself and every stem it may be an inflection of."""
    parts = [f"SELECT {word}, {word} AS stem FROM {source}"]
    for s in normalize.SUFFIXES:
        stem = f"left({word}, length({word}) - {len(s)})"
        fits = f"ends_with({word}, '{s}') AND length({word}) > {len(s) + 2}"
        parts += [f"SELECT {word}, {stem} FROM {source} WHERE {fits}", f"SELECT {word}, {stem} || 'e' FROM {source} WHERE {fits}",
                  f"SELECT {word}, left({stem}, length({stem}) - 1) FROM {source} WHERE {fits} AND right({stem}, 1) = left(right({stem}, 2), 1)"]
    return "stems AS (" + " UNION ".join(parts) + ")"


@query("is_real_word", f"""WITH {WORDS}, {stems_sql('cw', 'token')}, found AS (SELECT DISTINCT token FROM stems SEMI JOIN dict ON dict.term = stems.stem)
SELECT cw.token, found.token IS NOT NULL AS is_real FROM cw LEFT JOIN found ON found.token = cw.token""")
def is_real_word(spark, sf):
    words = corpus_words(spark, sf)
    return normalize.is_real_word(words.select("token"), corpus_dictionary(spark, sf))


# Words from the lists, run together with one slip each, stand in for typing errors.
SLIPS = """slips AS (SELECT DISTINCT w FROM (
    SELECT token AS w FROM cw
    UNION ALL SELECT left(word, k) || chr((97 + (n_docs + k) % 26)::INTEGER) || substr(word, k + 2) FROM cw, (SELECT unnest({words}) AS word) t, unnest(range(1, length(word))) AS u(k)
        WHERE length(token) = length(word) AND token[1] = word[1])
    WHERE w <> '')""".replace("{words}", O.arr(normalize.typo_targets()))


def slip_words(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus' words, and misspelt list words: a corpus word picks the list word of its length
    and first letter, and its document count picks the wrong letter."""
    words = corpus_words(spark, sf)
    target = spark.createDataFrame([(w,) for w in normalize.typo_targets()], "word string")
    made = words.join(F.broadcast(target), F.expr("length(token) = length(word) AND left(token, 1) = left(word, 1)")).select(
        "word", "n_docs", F.explode(F.expr("sequence(1, length(word) - 1)")).alias("k")).select(F.expr(
            "concat(left(word, k), char(97 + (n_docs + k) % 26), substring(word, k + 2))").alias("token"))
    return words.select("token").union(made).distinct()


@query("typo_fix", f"WITH {WORDS}, {SLIPS}, {typo_sql('slips')} SELECT w AS token, fixed FROM typo_fixes")
def typo_fix(spark, sf):
    return normalize.typo_fix(slip_words(spark, sf), corpus_dictionary(spark, sf)).select("token", "fixed")


@query("canonicalize", f"""WITH {WORDS}, {SLIPS}, {typo_sql('slips')}, {O.ALIAS}, {O.VOCAB}, {O.canon_map('cm', 'slips', True)}
SELECT w AS token, c AS canonical FROM cm""")
def canonicalize(spark, sf):
    typos = normalize.surviving_typos(spark, corpus_dictionary(spark, sf))
    return normalize.canonicalize(slip_words(spark, sf), typos)


@query("join_singles", f"{DOC_NORM} SELECT id AS doc_id, md5(cjoined) AS joined, len(jtokens)::BIGINT AS n FROM n WHERE cjoined <> ctext")
def join_singles(spark, sf):
    df = normal_docs(spark, sf, "ctext", "cjoined").filter("cjoined != ctext")
    return df.select("doc_id", F.md5("cjoined").alias("joined"), F.size(F.split(F.trim("cjoined"), " ")).cast("bigint").alias("n"))


@query("padded_forms", f"{DOC_NORM} SELECT id AS doc_id, length(ctext) AS ctext_len, length(cjoined) AS cjoined_len, md5(ctext) AS digest FROM n")
def padded_forms(spark, sf):
    return normal_docs(spark, sf, "ctext", "cjoined").select("doc_id", F.char_length("ctext").cast("bigint").alias("ctext_len"),
                                         F.char_length("cjoined").cast("bigint").alias("cjoined_len"), F.md5("ctext").alias("digest"))


NORMAL = """md5(plain) AS plain, md5(destretched) AS destretched, md5(squashed) AS squashed, len(tokens)::BIGINT AS n_tokens,
    md5(ctext) AS ctext, md5(cjoined) AS cjoined"""


@query("normalize", f"{DOC_NORM} SELECT id AS doc_id, {NORMAL} FROM n")
def normalize_docs(spark, sf):
    return normal_docs(spark, sf).select(
        "doc_id", F.md5("plain").alias("plain"), F.md5("destretched").alias("destretched"), F.md5("squashed").alias("squashed"),
        F.size("tokens").cast("bigint").alias("n_tokens"), F.md5("ctext").alias("ctext"), F.md5("cjoined").alias("cjoined"))


@query("passage_window", r"""WITH s AS (SELECT doc_id, text, length(text) AS n FROM documents),
p AS (SELECT doc_id, text, u.k AS passage, u.k * 640 AS start FROM s, unnest(range(0, CASE WHEN n <= 1500 THEN 1 ELSE (n - 1500 + 639) // 640 + 1 END)) AS u(k))
SELECT doc_id, passage, start, md5(CASE WHEN start > 0 AND NOT regexp_matches(substr(text, start, 1), '\s')
    THEN regexp_replace(substr(text, start + 1, 1500), '^\S+', '') ELSE substr(text, start + 1, 1500) END) AS digest FROM p""")
def passage_window(spark, sf):
    return normalize.passage_window(docs(spark, sf)).select(
        "doc_id", F.col("passage").cast("bigint").alias("passage"), F.col("start").cast("bigint").alias("start"),
        F.md5("passage_text").alias("digest"))


PASSAGE_LEX = f"""least((0.30e0 * least(len(list_intersect(ws, {O.arr(O.L.DEGRADING_WORDS)})), 3) + 0.18e0 * least(len(list_intersect(ws, {O.arr(O.L.STRONG_PROFANITY + O.L.MILD_PROFANITY)})), 3)
    + 0.45e0 * least(len(list_intersect(ws, {O.arr(O.L.SLURS)})), 2)) * CASE WHEN list_has_any(ws, {O.arr(O.L.SECOND_PERSON)}) THEN 1.5e0 ELSE 0.6e0 END, 0.99e0)"""


@query("best_passage", rf"""WITH s AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, text, u.k * 640 AS start FROM s, unnest(range(0, CASE WHEN n <= 1500 THEN 1 ELSE (n - 1500 + 639) // 640 + 1 END)) AS u(k)),
w AS (SELECT doc_id, start, CASE WHEN start > 0 AND NOT regexp_matches(substr(text, start, 1), '\s')
    THEN regexp_replace(substr(text, start + 1, 1500), '^\S+', '') ELSE substr(text, start + 1, 1500) END AS passage FROM p),
t AS (SELECT doc_id, start, {O.tokens('lower(passage)')} AS ws FROM w),
j AS (SELECT doc_id, start, round({PASSAGE_LEX}, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round({PASSAGE_LEX}, 6) DESC, start) AS k,
    count(*) OVER (PARTITION BY doc_id) AS passages FROM t)
SELECT doc_id, start, score, passages FROM j WHERE k = 1""")
def best_passage(spark, sf):
    """The passage of each document with the highest word score; the words are taken as they are written."""
    def worded(windows):
        df = windows.withColumn("word_set", T.tokenize(F.lower("passage_text")))
        return phrases.lexical_fallback_score(df, "score").withColumn("score", F.round("score", 6))

    return passages.best_passage(docs(spark, sf), "doc_id", score_fn=worded).withColumn("start", F.col("start").cast("bigint"))


@query("salted_digest", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN sha256(c_name || ':' || (100000 + c_custkey)::VARCHAR) END AS digest FROM customer")
def salted_digest(spark, sf):
    df = frames.table(spark, sf, "customer").withColumn("salt", F.expr("if(c_custkey % 5 = 0, null, c_name)"))
    return df.select("c_custkey", T.salted_digest(F.expr("cast(100000 + c_custkey AS string)"), F.col("salt")).alias("digest"))


MARKUP = r"regexp_replace(regexp_replace(regexp_replace(html, 'https?://\S+', ' ', 'g'), '@\w+', ' ', 'g'), '&[a-z]+;|&#\d+;', ' ', 'g')"


@query("clean_corpus", f"""WITH src AS (SELECT page_id AS id, replace({MARKUP}, 'RT ', ' ') AS text FROM pages), {O.plain_ctes('src')}
SELECT id AS page_id, length(plain) AS n_chars, md5(plain) AS digest FROM plain_t""")
def clean_corpus(spark, sf):
    from textguard.plans.corpus import clean_corpus as clean
    df = clean(frames.table(spark, sf, "pages"), "html")
    return df.select("page_id", F.char_length("clean").cast("bigint").alias("n_chars"), F.md5("clean").alias("digest"))


LABELLED = "benchmark_text || CASE item_id % 4 WHEN 0 THEN ', Search Suggestion' WHEN 1 THEN ' - Google Search, link' WHEN 2 THEN ', heading, button' ELSE '' END"


@query("strip_ui_labels", f"""SELECT item_id, trim(regexp_replace(trim({LABELLED}), '(?i)(?:\\s*(?:{'|'.join(T.LABEL_SUFFIXES)}))+\\s*$', '')) AS stripped
FROM (SELECT item_id, text AS benchmark_text FROM benchmark)""")
def strip_ui_labels(spark, sf):
    df = frames.table(spark, sf, "benchmark").withColumnRenamed("text", "benchmark_text")
    return df.select("item_id", T.strip_ui_labels(F.expr(LABELLED)).alias("stripped"))


# ------------------------------------------------------------------ lists
LEX = f"lex(term, list, kind) AS (SELECT * FROM {O.values(phrases.lexicon_rows())})"


@query("lexicon_table", f"""WITH {LEX}, cw AS (SELECT unnest({O.tokens('lower(text)')}) AS w FROM documents),
used AS (SELECT w, count(*) AS n FROM cw GROUP BY w)
SELECT list, kind, count(*) AS terms, count(n) AS terms_used, coalesce(sum(n), 0)::BIGINT AS uses FROM lex LEFT JOIN used ON used.w = lex.term GROUP BY list, kind""")
def lexicon_table(spark, sf):
    lexicon = phrases.lexicon_table(spark)
    listed = F.broadcast(lexicon.select(F.col("term").alias("w")).distinct())
    used = docs(spark, sf).select(F.explode(T.tokenize(F.lower("text"))).alias("w")).join(listed, "w").groupBy("w").agg(F.count("*").alias("n"))
    return (lexicon.join(used, F.col("term") == F.col("w"), "left").groupBy("list", "kind")
            .agg(F.count("*").alias("terms"), F.count("n").alias("terms_used"), F.coalesce(F.sum("n"), F.lit(0)).alias("uses")))


@query("word_hits", f"""{DOC_NORM}, {LEX}
SELECT DISTINCT ct.id AS doc_id, list, term FROM ct JOIN lex ON lex.term = ct.c WHERE kind = 'word'""")
def word_hits(spark, sf):
    return phrases.word_hits(normal_docs(spark, sf, "canonical"), "doc_id", phrases.lexicon_table(spark))


@query("phrase_hits", f"{MSG_NORM}, {O.PHRASES} SELECT id AS msg_id, list, count(*) AS n, string_agg(phrase, '|' ORDER BY ord) AS phrases FROM ph GROUP BY id, list")
def phrase_hits(spark, sf):
    df = phrases.exclusion_score(phrases.phrase_hits(phrases.addressing(phrases.with_found(normal_messages(spark, sf)))))
    lists = ", ".join(f"struct('{name}' AS list, {name}_hits AS hits)" for name in phrases.PHRASE_LISTS)
    long = df.select("msg_id", F.explode(F.expr(f"filter(array({lists}), l -> size(l.hits) > 0)")).alias("l"))
    return long.select("msg_id", "l.list", F.size("l.hits").cast("bigint").alias("n"), F.array_join("l.hits", "|").alias("phrases"))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    df = normal_messages(spark, sf).withColumns({"context_size": F.lit(0), "context_words": F.expr("cast(array() AS array<array<string>>)")})
    return tier0.features(df)


MSG_SIG = f"WITH {O.MESSAGES}, " + ",\n".join([O.norm_ctes("msg"), O.PHRASES, O.rule_ctes(), O.AIM, O.SIGNALS])


def listed(name: str) -> str:
    return f"array_to_string(list_sort({name}), ',')"


@query("phrase_index", f"""WITH b AS (SELECT {O.tokens('lower(text)')} AS ws FROM benchmark),
phr AS (SELECT DISTINCT array_to_string(ws[u.k:u.k + 3], ' ') AS phrase FROM b, unnest(range(1, len(ws) + 1, 4)) AS u(k)),
d AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT doc_id, {O.tokens('lower(text)')} AS ws FROM documents)),
g AS (SELECT doc_id, w AS a, w || ' ' || lead(w, 1) OVER o AS b, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS c,
    w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS d FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
grams AS (SELECT doc_id, a AS phrase FROM g UNION SELECT doc_id, b FROM g UNION SELECT doc_id, c FROM g UNION SELECT doc_id, d FROM g)
SELECT doc_id, 'benchmark' AS list, phrase FROM grams JOIN phr USING (phrase)""")
def phrase_index_query(spark, sf):
    """Pieces of four words of the benchmark, looked for in the documents."""
    worded = T.tokenize(F.lower("text"))
    pieces = F.expr("transform(sequence(0, (size(ws) - 1) div 4), k -> array_join(slice(ws, k * 4 + 1, 4), ' '))")
    listed = frames.table(spark, sf, "benchmark").select(worded.alias("ws")).filter("size(ws) > 0").select(F.explode(pieces).alias("phrase")).distinct()
    listed = listed.select(F.lit("benchmark").alias("list"), "phrase", F.lit(False).alias("evasive"), T.padded(F.split("phrase", " ")).alias("needle"))
    texts = docs(spark, sf).select("doc_id", T.padded_words(F.lower("text")).alias("ctext"))
    return phrase_index.phrase_matches(texts, listed, "doc_id", frames.folder(spark, "phrase_index"), joined=None)


@query("content_score", f"""{MSG_SIG} SELECT msg_id, round(content_score, 6) AS content_score, content_category FROM sig3 WHERE content_score > 0""")
def content_score(spark, sf):
    return signals(spark, sf).filter("content_score > 0").select("msg_id", *rounded("content_score"), "content_category")


@query("slur_score", f"{MSG_SIG} SELECT msg_id, {listed('slur_words')} AS words, round(slur_score, 6) AS slur_score FROM sig3 WHERE slur_score > 0")
def slur_score(spark, sf):
    return signals(spark, sf).filter("slur_score > 0").select("msg_id", F.array_join("slur_words", ",").alias("words"), *rounded("slur_score"))


@query("distress_hits", f"{MSG_SIG} SELECT msg_id, self_harm_n, distress_n FROM sig3 WHERE distress")
def distress_hits(spark, sf):
    return signals(spark, sf).filter("distress").select("msg_id", F.size("self_harm_hits").cast("bigint").alias("self_harm_n"),
                                                        F.size("distress_hits").cast("bigint").alias("distress_n"))


def _list_score(name: str, hits: str):
    sql = f"{MSG_SIG} SELECT msg_id, {hits}_n AS n, round({name}, 6) AS {name} FROM sig3 WHERE {name} > 0"

    @query(name, sql)
    def run(spark, sf):
        return signals(spark, sf).filter(f"{name} > 0").select("msg_id", F.size(f"{hits}_hits").cast("bigint").alias("n"), *rounded(name))


_list_score("exclusion_score", "exclusion")
_list_score("backhanded_score", "pointed")
_list_score("mockery_score", "mockery")


@query("lexical_fallback_score", f"{DOC_NORM}, {O.L10} SELECT id AS doc_id, round(model_score, 6) AS model_score FROM l10")
def lexical_fallback_score(spark, sf):
    return cascade.lexical_scorer(normal_docs(spark, sf, *normalize.LEXICAL)).select("doc_id", *rounded("model_score"))


# ------------------------------------------------------------------ rules
@query("rule_hits", f"""WITH {O.MESSAGES}, {O.norm_ctes('msg')}, {O.rule_ctes()}
SELECT id AS msg_id, hit AS rule, hard = 1 AS hard, score, cats AS categories FROM rh JOIN rul USING (ord)""")
def rule_hits(spark, sf):
    return rules.rule_table(rules.rule_hits(normal_messages(spark, sf)), "msg_id")


@query("first_person_guard", f"""WITH {O.MESSAGES}, {O.norm_ctes('msg')}, {O.rule_ctes()},
free AS ({' UNION ALL '.join(f"SELECT id, '{r[1]}' AS rule FROM n WHERE regexp_matches(ctext, {O.q(' (?:' + rules.fill(r[4]) + ') ')}) OR regexp_matches(cjoined, {O.q(' (?:' + rules.fill(r[4]) + ') ')})" for r in O.B.RULES if r[5])})
SELECT free.id AS msg_id, rule, hit IS NULL AS guarded FROM free LEFT JOIN (SELECT id, hit FROM rh JOIN rul USING (ord)) h
    ON h.id = free.id AND h.hit = 'rule:' || free.rule""")
def first_person_guard(spark, sf):
    df = rules.rule_hits(normal_messages(spark, sf))
    tests = ", ".join(
        f"if(ctext RLIKE {rules.quote(p)} OR cjoined RLIKE {rules.quote(p)}, '{name}', null)"
        for name, p in ((r[1], rules.whole_words(rules.fill(r[4]))) for r in O.B.RULES if r[5]))
    free = df.select("msg_id", F.col("rules.hit").alias("hits"), F.explode(F.expr(f"array_compact(array({tests}))")).alias("rule"))
    return free.select("msg_id", "rule", F.expr("NOT array_contains(hits, concat('rule:', rule))").alias("guarded"))


@query("bare_command", f"{MSG_NORM} SELECT id AS msg_id, ctext FROM n WHERE len(canonical) BETWEEN 1 AND 3 AND canonical[1] IN ('die', 'rot', 'kys')")
def bare_command(spark, sf):
    return rules.bare_command(normal_messages(spark, sf)).filter("bare_command").select("msg_id", "ctext")


@query("insult_aim", f"WITH {O.MESSAGES}, {O.norm_ctes('msg')}, {O.AIM} SELECT id AS msg_id, i AS pos, w AS word, aim FROM aims")
def insult_aim(spark, sf):
    df = aim.insult_aim(phrases.with_found(normal_messages(spark, sf)))
    return df.select("msg_id", F.explode("aims").alias("a")).select("msg_id", F.col("a.pos").cast("bigint").alias("pos"), "a.word", "a.aim")


@query("insult_aim_documents", f"{DOC_NORM}, {O.AIM} SELECT id AS doc_id, aim, count(*) AS n FROM aims GROUP BY id, aim")
def insult_aim_documents(spark, sf):
    df = aim.insult_aim(phrases.with_found(normal_docs(spark, sf, "canonical")))
    return df.select("doc_id", F.explode("aims.aim").alias("aim")).groupBy("doc_id", "aim").agg(F.count("*").alias("n"))


@query("insult_only", f"WITH {O.MESSAGES}, {O.norm_ctes('msg')}, {O.AIM} SELECT n.id AS msg_id, coalesce(insult_only, false) AS insult_only FROM n LEFT JOIN who USING (id)")
def insult_only(spark, sf):
    return aim.insult_only(normal_messages(spark, sf)).select("msg_id", "insult_only")


@query("insult_score", f"{MSG_SIG} SELECT msg_id, strong_n, mild_n, third_n, round(insult_score, 6) AS insult_score, insult_aimed FROM sig3 WHERE insults_n > 0")
def insult_score(spark, sf):
    return signals(spark, sf).filter("size(aims) > 0").select(
        "msg_id", *[F.col(c).cast("bigint").alias(c) for c in ("strong_n", "mild_n", "third_n")], *rounded("insult_score"), "insult_aimed")


@query("quote_damping", f"{MSG_T0} SELECT msg_id, round(score, 6) AS score, round(confidence, 6) AS confidence FROM t0 WHERE quoted")
def quote_damping(spark, sf):
    return verdicts(spark, sf).filter("quoted").select("msg_id", *rounded("score", "confidence"))


@query("affection_softener", f"{MSG_T0} SELECT msg_id, round(score, 6) AS score FROM t0 WHERE affectionate")
def affection_softener(spark, sf):
    return verdicts(spark, sf).filter("affectionate").select("msg_id", *rounded("score"))


@query("ambiguity_score", f"{MSG_T0} SELECT msg_id, round(ambiguity, 6) AS ambiguity FROM t0")
def ambiguity_score(spark, sf):
    return verdicts(spark, sf).select("msg_id", *rounded("ambiguity"))


@query("self_directed", f"{MSG_T0} SELECT msg_id, distress, self_directed, round(score, 6) AS score FROM t0 WHERE distress")
def self_directed(spark, sf):
    return verdicts(spark, sf).filter("distress").select("msg_id", "distress", "self_directed", *rounded("score"))


VERDICT_SQL = f"msg_id, round(score, 6) AS score, {O.level('score')} AS level, round(confidence, 6) AS confidence, {O.CATS} AS categories, addressed, trivial"


@query("tier0_verdict", f"{MSG_T0} SELECT {VERDICT_SQL}, distress, self_directed FROM t0")
def tier0_verdict(spark, sf):
    return verdicts(spark, sf).select("msg_id", *rounded("score"), "level", *rounded("confidence"), cats(), "addressed", "trivial",
                                      "distress", "self_directed")


@query("tier0_documents", f"WITH {O.DOCS}, {O.tier0_ctes('docs')} SELECT id AS doc_id, round(score, 6) AS score, {O.level('score')} AS level, {O.CATS} AS categories FROM t0")
def tier0_documents(spark, sf):
    return tier0.tier0_verdict(docs(spark, sf)).select("doc_id", *rounded("score"), "level", cats())


@query("trivial_gate", f"{MSG_T0} SELECT trivial, count(*) AS n FROM t0 GROUP BY trivial")
def trivial_gate(spark, sf):
    return verdicts(spark, sf).groupBy("trivial").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ cascade
SURE = "least(least(1e0, abs(model_score - 0.5e0) * 2e0), 0.5e0)"


@query("tier1_score", f"""{MSG_NORM}, {O.L10} SELECT id AS msg_id, round(model_score, 6) AS model_score, round({SURE}, 6) AS model_confidence,
    {O.level('model_score')} AS model_level, CASE WHEN model_score >= 0.5e0 THEN 'insult' END AS model_category FROM l10""")
def tier1_score(spark, sf):
    return cascade.tier1_score(normal_messages(spark, sf)).select("msg_id", *rounded("model_score", "model_confidence"), "model_level", "model_category")


LOCAL_SQL = f"{VERDICT_SQL}, round(model_score, 6) AS model_score, tier"


@query("local_verdict", f"{MSG_LOCAL} SELECT {LOCAL_SQL} FROM local")
def local_verdict(spark, sf):
    return local(spark, sf).select("msg_id", *rounded("score"), "level", *rounded("confidence"), cats(), "addressed", "trivial",
                                   *rounded("model_score"), "tier")


# A stand-in for a transformer's probability: from the message's key, so both engines agree.
PSEUDO = "((msg_id * 7919) % 1000) / 1000e0"
DECIDED = "(self_directed OR trivial OR score >= 0.85e0)"


def pseudo_scorer(df: DataFrame) -> DataFrame:
    return df.withColumn("model_score", F.expr(PSEUDO))


def transformer_local(spark, sf, reachable: bool) -> DataFrame:
    return cascade.local_verdict(verdicts(spark, sf), pseudo_scorer, transformer=True, reachable=reachable, lexical=False)


SUSPECT = f"""sus AS (SELECT * EXCLUDE (mm), CASE WHEN {DECIDED} THEN 0e0 ELSE mm END AS model_score, NOT {DECIDED} AND NOT affectionate AND NOT quoted
    AND addressed AND mm >= 0.90e0 AND score < 0.62e0 AS suspect FROM (SELECT *, {PSEUDO} AS mm FROM t0)),
susc AS (SELECT * REPLACE (CASE WHEN {DECIDED} THEN confidence ELSE greatest(confidence, least(1e0, abs(model_score - 0.5e0) * 2e0) * 0.8e0) END AS confidence) FROM sus)"""


@query("offline_fallback", f"""{MSG_T0}, {SUSPECT}, fb AS (SELECT * REPLACE (CASE WHEN suspect AND model_score >= 0.98e0 THEN greatest(score, 0.5e0) ELSE score END AS score,
    CASE WHEN suspect AND model_score >= 0.98e0 AND len(categories) = 0 THEN ['insult'] ELSE categories END AS categories),
    CASE WHEN suspect AND model_score >= 0.98e0 THEN 'on_device' ELSE 'rules' END AS tier FROM susc)
SELECT msg_id, round(score, 6) AS score, {O.level('score')} AS level, round(confidence, 6) AS confidence, {O.CATS} AS categories, tier FROM fb""")
def offline_fallback(spark, sf):
    return transformer_local(spark, sf, False).select("msg_id", *rounded("score"), "level", *rounded("confidence"), cats(), "tier")


# A stand-in for a trained model: what it makes of each word as it is written.
MODEL_WORDS = {"loser": 0.55, "idiot": 0.5, "stupid": 0.45, "dumb": 0.4, "trash": 0.4, "ugly": 0.35, "clown": 0.35, "hate": 0.25, "bitch": 0.6, "asshole": 0.6, "you": 0.2, "your": 0.15}


def word_model():
    import numpy as np

    def model(texts):
        return np.array([min(0.99, 0.05 + sum(MODEL_WORDS.get(w, 0.0) for w in set(t.lower().split(" ")))) for t in texts])

    return model


def model_words_sql(text: str) -> str:
    weights = ", ".join(f"({O.q(w)}, {p}e0)" for w, p in MODEL_WORDS.items())
    return f"least(0.99e0, 0.05e0 + coalesce((SELECT sum(p) FROM (VALUES {weights}) AS mw(w, p) WHERE list_contains(string_split(lower({text}), ' '), mw.w)), 0e0))"


@query("model_second_look", f"""{MSG_T0}, tr AS (SELECT t0.*, {DECIDED} AS decided, trim(text) AS bare FROM t0),
lk AS (SELECT *, NOT decided AND bare <> '' AS one, NOT decided AND regexp_matches(bare, '[*#%@$0134578]') AND plain <> lower(bare) AS two FROM tr),
ms AS (SELECT *, CASE WHEN one THEN {model_words_sql('bare')} ELSE 0e0 END AS s1, CASE WHEN two THEN {model_words_sql('plain')} ELSE 0e0 END AS s2 FROM lk),
mm AS (SELECT *, greatest(s1, s2) AS m FROM ms),
fb AS (SELECT *, NOT decided AND NOT affectionate AND NOT quoted AND addressed AND m >= 0.90e0 AND score < 0.62e0 AND m >= 0.98e0 AS sure_model FROM mm)
SELECT msg_id, one::INT + two::INT AS looks, round(m, 6) AS model_score, round(CASE WHEN sure_model THEN greatest(score, 0.5e0) ELSE score END, 6) AS score,
    CASE WHEN sure_model THEN 'on_device' ELSE 'rules' END AS tier FROM fb""")
def model_second_look(spark, sf):
    """The cascade with a model in batches: rows nobody has decided are read, disguised ones twice."""
    df = cascade.local_verdict(verdicts(spark, sf), BatchScorer(word_model), transformer=True, lexical=False)
    return df.select("msg_id", "looks", *rounded("model_score", "score"), "tier")


@query("cover_policy", f"""{MSG_T0}, {SUSPECT}, pol(sensitivity, threshold, floor) AS (VALUES ('light', 0.80e0, 0.70e0), ('balanced', 0.62e0, 0.35e0), ('attentive', 0.45e0, 0.35e0))
SELECT msg_id, sensitivity, NOT self_directed AND ((score >= floor AND score >= threshold) OR (suspect AND model_score >= 0.98e0 AND sensitivity <> 'light')) AS covered
FROM susc, pol""")
def cover_policy(spark, sf):
    return policy.cover_policy(transformer_local(spark, sf, True)).select("msg_id", "sensitivity", "covered")


GATE = """(NOT self_directed AND NOT trivial AND score < 0.85e0 AND ((NOT list_has_any(categories, ['profanity', 'explicit']) AND score > 0.30e0 AND score < 0.80e0)
    OR ambiguity >= 0.42e0 OR (addressed AND model_score >= 0.90e0)))"""


@query("escalation_gate", f"{MSG_LOCAL} SELECT msg_id, {GATE} AS escalated FROM local")
def escalation_gate(spark, sf):
    return local(spark, sf).select("msg_id", F.expr(cascade.escalation_gate()).alias("escalated"))


# A stand-in reviewer answers two messages in three.
REVIEW_COLUMNS = {
    "r_score": "(msg_id % 11) / 10e0", "r_confidence": "0.5e0 + (msg_id % 5) / 10e0", "r_latency_ms": "400e0 + msg_id % 100",
    "r_rationale": "concat('case ', cast(msg_id % 3 AS {str}))", "r_self_directed": "msg_id % 11 = 0",
}


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    df = frames.messages(spark, sf).select("msg_id").filter("msg_id % 3 != 0")
    return df.select("msg_id", *[F.expr(e.replace("{str}", "string")).alias(n) for n, e in REVIEW_COLUMNS.items()],
                     F.expr("if(msg_id % 4 = 0, cast(array() AS array<string>), array('exclusion'))").alias("r_categories"))


REVIEW_SQL = "rev AS (SELECT msg_id, " + ", ".join(f"{e.replace('{str}', 'VARCHAR')} AS {n}" for n, e in REVIEW_COLUMNS.items()) + \
    ", CASE WHEN msg_id % 4 = 0 THEN [] ELSE ['exclusion'] END AS r_categories FROM msg WHERE msg_id % 3 <> 0)"

BANNED = "list_has_any(categories, ['profanity', 'explicit'])"


def merge_sql(review: str) -> str:
    return f"""mr AS (SELECT l.*, r.r_score IS NOT NULL AS reviewed, r.* EXCLUDE (msg_id) FROM local l LEFT JOIN {review} r ON r.msg_id = l.msg_id),
merged AS (SELECT * REPLACE (
    CASE WHEN NOT reviewed THEN score WHEN score >= 0.85e0 OR {BANNED} THEN greatest(r_score, score) ELSE r_score END AS score,
    CASE WHEN NOT reviewed OR len(r_categories) = 0 THEN categories WHEN {BANNED} THEN list_sort(list_distinct(r_categories || categories)) ELSE r_categories END AS categories,
    CASE WHEN reviewed THEN r_confidence ELSE confidence END AS confidence, CASE WHEN reviewed THEN 'context' ELSE tier END AS tier,
    CASE WHEN reviewed THEN r_self_directed ELSE self_directed END AS self_directed,
    CASE WHEN reviewed THEN r_self_directed ELSE distress END AS distress),
    score AS local_score, self_directed AS local_self, CASE WHEN reviewed THEN r_rationale END AS rationale, 1e0 + CASE WHEN reviewed THEN r_latency_ms ELSE 0e0 END AS latency_ms FROM mr)"""


MERGED_SQL = f"msg_id, round(score, 6) AS score, {O.level('score')} AS level, round(confidence, 6) AS confidence, {O.CATS} AS categories, tier, rationale, latency_ms"


@query("merge_review", f"{MSG_LOCAL}, {REVIEW_SQL}, {merge_sql('rev')} SELECT {MERGED_SQL} FROM merged")
def merge_review(spark, sf):
    df = local(spark, sf).withColumn("latency_ms", F.lit(1.0))
    return cascade.merge_review(df, reviews(spark, sf), "msg_id").select(
        "msg_id", *rounded("score"), "level", *rounded("confidence"), cats(), "tier", "rationale", "latency_ms")


@query("cascade_route", f"""{MSG_LOCAL}, {REVIEW_SQL}, asked AS (SELECT rev.* FROM rev JOIN local USING (msg_id) WHERE {GATE}), {merge_sql('asked')}
SELECT {MERGED_SQL}, CASE WHEN local_self THEN 'T0 self-directed' WHEN trivial THEN 'T0 clear' WHEN local_score >= 0.85e0 THEN 'T0 decisive'
    WHEN reviewed THEN 'T2 reviewer' WHEN msg_id IN (SELECT msg_id FROM local WHERE {GATE}) THEN 'T1 (context unavailable)' ELSE 'T1 fallback' END AS source FROM merged""")
def cascade_route(spark, sf):
    df = local(spark, sf).withColumn("latency_ms", F.lit(1.0))
    return cascade.cascade_route(df, reviews(spark, sf), "msg_id").select(
        "msg_id", *rounded("score"), "level", *rounded("confidence"), cats(), "tier", "rationale", "latency_ms", "source")


def score_once(df: DataFrame) -> DataFrame:
    return cascade.lexical_scorer(normalize.normalize(df, keep=normalize.LEXICAL)).select("text_key", "text", "model_score")


@query("cached_verdict", f"{DOC_NORM}, {O.L10} SELECT id AS doc_id, round(model_score, 6) AS model_score FROM l10")
def cached_verdict(spark, sf):
    df = docs(spark, sf).withColumn("text_key", F.sha2("text", 256))
    return cascade.cached_verdict(df, "text_key", "text", score_once, row_id="doc_id").select("doc_id", *rounded("model_score"))


# W1's lines, as the store's key sees them.
STORE_LINES = "array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), '|')"


@query("verdict_store", f"""{MSG_NORM}, {O.L10}, lines AS (SELECT msg_id, role, text, coalesce({STORE_LINES}, '') AS lines FROM msg)
SELECT msg_id, round(model_score, 6) AS model_score, EXISTS (SELECT 1 FROM lines b WHERE b.role = 'user' AND b.text = a.text AND b.lines = a.lines) AS from_store
FROM lines a JOIN l10 ON l10.id = a.msg_id""")
def verdict_store(spark, sf):
    """A first run over the users' messages, a second one over all: what the first has scored is not scored again."""
    path = frames.folder(spark, "verdicts")
    df = store.with_key(context.context_window(frames.messages(spark, sf), order="seq")).select("msg_id", "role", "text", "verdict_key")

    def score(rows: DataFrame) -> DataFrame:
        return cascade.lexical_scorer(normalize.normalize(rows, keep=normalize.LEXICAL)).select("verdict_key", "model_score")

    def run(rows: DataFrame, version: int) -> DataFrame:
        return store.cached(rows, path, version, score, ["model_score"], "msg_id", keep=["text"])

    run(df.filter("role = 'user'"), 1)
    return run(df, 2).select("msg_id", *rounded("model_score"), "from_store")


@query("trace_hook", f"""{MSG_LOCAL}, {REVIEW_SQL}, asked AS (SELECT rev.* FROM rev JOIN local USING (msg_id) WHERE {GATE}), {merge_sql('asked')}
SELECT tier, count(*) AS n, sum(latency_ms) AS latency_sum, round(avg(latency_ms), 6) AS latency_avg, count(*) FILTER (reviewed AND tier = 'context') AS escalated,
    round(count(*) / sum(count(*)) OVER (), 9) AS share FROM merged GROUP BY tier""")
def trace_hook(spark, sf):
    """Every message's trace written; the telemetry is what was observed on the way."""
    routed = cascade.cascade_route(local(spark, sf).withColumn("latency_ms", F.lit(1.0)), reviews(spark, sf), "msg_id")
    found = traces.write_traces(traces.trace_rows(routed, "msg_id", "ts"), frames.folder(spark, "traces"))
    return found.withColumns({"latency_avg": F.round("latency_avg", 6), "share": F.round("share", 9)})


# Fragments: the message, the message without labels, and its comma-separated parts.
FRAGMENTS = rf"""
whole AS (SELECT msg_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS whole FROM msg),
strip AS (SELECT msg_id, whole, trim(regexp_replace(trim(whole), '(?i)(?:\s*(?:{'|'.join(T.LABEL_SUFFIXES)}))+\s*$', '')) AS stripped FROM whole
    WHERE length(whole) BETWEEN 2 AND 2000),
cands AS (SELECT msg_id, list_filter([stripped] || CASE WHEN contains(whole, ', ') THEN list_transform(string_split(whole, ', '), lambda p: trim(p)) ELSE [] END,
    lambda p: length(p) >= 2) AS more, whole FROM strip),
frag0 AS (SELECT msg_id, unnest([whole] || more) AS text, unnest(range(0, len(more) + 1)) AS pos FROM cands),
frag AS (SELECT row_number() OVER (ORDER BY msg_id, pos) AS id, * FROM (SELECT msg_id, text, min(pos) AS pos FROM frag0 GROUP BY msg_id, text))"""


@query("fragment_best", f"""WITH {O.MESSAGES}, {FRAGMENTS}, {O.local_ctes('frag')}
SELECT msg_id, max(round(score, 6)) AS score, arg_max(text, score * 1000000 + pos) AS fragment FROM local WHERE {O.held('balanced')} GROUP BY msg_id""")
def fragment_best(spark, sf):
    return cascade.fragment_best(frames.messages(spark, sf), "msg_id").select("msg_id", *rounded("score"), "fragment")


@query("group_rejoin", f"""WITH {O.MESSAGES}, {FRAGMENTS}, {O.local_ctes('frag')},
covered AS (SELECT DISTINCT msg_id FROM local WHERE {O.held('balanced')}),
grp2 AS (SELECT conv_id * 100000 + seq // 100000 AS gid, count(*) AS c, sum(length(t) + 1) AS chars, string_agg(t, ' ' ORDER BY seq) AS joined,
        bool_or(msg_id IN (SELECT msg_id FROM covered)) AS any_covered
    FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM msg) WHERE length(t) BETWEEN 2 AND 2000 GROUP BY 1),
rejoined AS (SELECT gid AS id, gid, joined AS text FROM grp2 WHERE c >= 2 AND chars - 1 <= 2000 AND NOT any_covered)
SELECT * FROM (WITH {O.local_ctes('rejoined')}
SELECT gid, md5(text) AS digest, length(text) AS chars, round(score, 6) AS score, {O.held('balanced')} AS held FROM local)""")
def group_rejoin(spark, sf):
    """Every group that is read as one text, with the score of that text and whether it is held."""
    msgs = frames.messages(spark, sf).withColumn("gid", F.expr("conv_id * 100000 + seq div 100000"))
    whole = cascade.group_rejoin(msgs, cascade.fragment_best(msgs, "msg_id"), "msg_id", "gid", "seq", every=True)
    return whole.select("gid", F.md5("joined").alias("digest"), F.char_length("joined").cast("bigint").alias("chars"), *rounded("score"), "held")


@query("group_rejoin_scored")
def group_rejoin_scored(spark, sf):
    msgs = frames.messages(spark, sf).withColumn("gid", F.expr("conv_id * 100000 + seq div 100000"))
    return cascade.group_rejoin(msgs, cascade.fragment_best(msgs, "msg_id"), "msg_id", "gid", "seq").select("gid", *rounded("score"))


# Conversation turns with a carrier behind each sentence, as one text per turn.
TURN_TEXT = rf"""
tparts AS (SELECT conv_id * 100000 + turn AS turn_id, pos, s || ' ' || c || '. ' AS p
    FROM (SELECT *, ({O.arr(frames.CARRIERS)})[(conv_id * 13 + turn * 7 + pos // 4) % {len(frames.CARRIERS)} + 1] AS c FROM sent)),
whole_t AS (SELECT turn_id, string_agg(p, '' ORDER BY pos) AS whole FROM tparts GROUP BY turn_id),
sparts AS (SELECT turn_id, whole, list_filter(string_split(regexp_replace(whole, '([.!?]\s+)', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS parts FROM whole_t),
sents AS (SELECT turn_id * 100000 + u.k - 1 AS id, turn_id, u.k - 1 AS pos, parts[u.k] AS text FROM sparts, unnest(range(1, len(parts) + 1)) AS u(k) WHERE len(parts) > 1)"""


def turn_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation turn with a carrier line behind every sentence."""
    n = len(frames.CARRIERS)
    part = (rf"concat(regexp_replace(s, r'^\s+|\s+$', ''), ' ', get({frames.words(frames.CARRIERS)},"
            f" cast((conv_id * 13 + turn * 7 + i div 4) % {n} AS int)), '. ')")
    turns = frames.table(spark, sf, "conversations").withColumn("parts", T.sentences(F.col("text")))
    return turns.select(F.expr("conv_id * 100000 + turn").alias("turn_id"), F.expr(f"array_join(transform(parts, (s, i) -> {part}), '')").alias("whole_text"))


@query("offending_span", f"""WITH {O.MESSAGES}, {TURN_TEXT}, {O.local_ctes('sents')},
hot AS (SELECT turn_id, min(pos) AS lo, max(pos) AS hi FROM local WHERE {O.held('balanced')} GROUP BY turn_id)
SELECT turn_id, CASE WHEN lo IS NULL THEN trim(whole) ELSE trim(array_to_string(parts[lo + 1:hi + 1], '')) END AS span, lo IS NOT NULL AS narrowed
FROM sparts LEFT JOIN hot USING (turn_id)""")
def offending_span(spark, sf):
    return cascade.offending_span(turn_texts(spark, sf), "turn_id", "whole_text")


@query("span_redact", """WITH w AS (SELECT doc_id, text, list_filter(string_split(text, ' '), lambda x: x <> '')[1] AS span FROM documents)
SELECT doc_id, md5(CASE WHEN span IS NULL OR NOT contains(text, span) THEN text ELSE
    left(text, length(text) - length(string_split(text, span)[-1]) - length(span)) || '[removed]' || string_split(text, span)[-1] END) AS digest FROM w""")
def span_redact(spark, sf):
    df = docs(spark, sf).withColumn("span", F.expr("coalesce(get(filter(split(text, ' '), x -> x != ''), 0), '')"))
    return df.select("doc_id", F.md5(cascade.span_redact("text", "span", "'[removed]'")).alias("digest"))


PAIRS_SQL = r"""
pairs AS (SELECT u.conv_id * 100000 + u.turn AS id, u.conv_id, u.turn, u.text AS original, CASE (u.turn + u.conv_id) % 5 WHEN 0 THEN '"' || u.text || '"'
        WHEN 1 THEN 'I''m sorry, but ' || u.text WHEN 2 THEN 'you are such an idiot ' || u.text ELSE a.text END AS rewrite
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
cleaned AS (SELECT *, CASE WHEN length(r) > 1 AND starts_with(r, '"') AND ends_with(r, '"') THEN substr(r, 2, length(r) - 2) ELSE r END AS clean
    FROM (SELECT *, regexp_replace(rewrite, '^\s+|\s+$', '', 'g') AS r FROM pairs))"""


def rewrite_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant turn after them; some are made refusals, quotes or insults."""
    conv = frames.table(spark, sf, "conversations")
    a = conv.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = conv.filter("role = 'user'").join(a, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.col("text").alias("original"), F.expr("""CASE (turn + conv_id) % 5
        WHEN 0 THEN concat('"', text, '"') WHEN 1 THEN concat("I'm sorry, but ", text) WHEN 2 THEN concat('you are such an idiot ', text)
        ELSE answer END""").alias("rewrite"))


@query("rewrite_filter", f"""WITH {PAIRS_SQL}, {O.local_ctes('cleaned', 'clean').replace('contains(text,', 'contains(clean,')}
SELECT conv_id, turn, (clean <> '' AND NOT starts_with(lower(clean), 'none') AND NOT ({O.REFUSED})
    AND length(clean) <= greatest(length(original) * 3, length(original) + 80)) AS usable,
    round(score, 6) AS score, usable AND NOT {O.held('balanced')} AS accepted FROM local""")
def rewrite_filter(spark, sf):
    return cascade.rewrite_filter(rewrite_pairs(spark, sf)).select("conv_id", "turn", "usable", *rounded("score"), "accepted")


# ------------------------------------------------------------------ policy
@query("level_bucket", f"WITH s AS (SELECT event_id, least(value / 50e0, 1e0) AS score FROM events) SELECT event_id, {O.level('score')} AS level FROM s")
def level_bucket(spark, sf):
    return frames.activity(spark, sf).select("event_id", policy.level_bucket("score").alias("level"))


@query("severity_label", """SELECT event_id, CASE WHEN s < 0.55e0 THEN 'Sharp' WHEN s < 0.78e0 THEN 'Harsh' ELSE 'Cruel' END AS severity
FROM (SELECT event_id, least(greatest((value - 5) / 50e0, 0e0), 1e0) AS s FROM events)""")
def severity_label(spark, sf):
    df = frames.table(spark, sf, "events").withColumn("raw", F.expr("(value - 5) / 50e0"))
    return df.select("event_id", policy.severity_label("raw").alias("severity"))


HELD3 = "pol(sensitivity, threshold, floor) AS (VALUES ('light', 0.80e0, 0.70e0), ('balanced', 0.62e0, 0.35e0), ('attentive', 0.45e0, 0.35e0))"


@query("hold_policy", f"{MSG_LOCAL}, {HELD3} SELECT msg_id, sensitivity, NOT self_directed AND score >= floor AND score >= threshold AS held FROM local, pol")
def hold_policy(spark, sf):
    return policy.hold_policy(local(spark, sf)).select("msg_id", "sensitivity", "held")


@query("policy_table", f"""WITH s AS (SELECT event_id, least(value / 50e0, 1e0) AS score FROM events),
e AS (SELECT event_id, score, CASE {O.level('score')} WHEN 'harmful' THEN 2 WHEN 'borderline' THEN 1 ELSE 0 END AS lv FROM s)
SELECT event_id, n_name AS sensitivity, score >= 0.3e0 + n_nationkey / 50e0 AND lv >= n_nationkey % 3 AS held FROM e, nation""")
def policy_from_a_table(spark, sf):
    """Scores under a policy that is a table: each nation has a threshold and a least level of its own."""
    profiles = frames.table(spark, sf, "nation").selectExpr("n_name AS sensitivity", "0.3e0 + n_nationkey / 50e0 AS threshold", "n_nationkey % 3 AS minimum_level")
    scored = frames.activity(spark, sf).withColumns({"level": F.expr(tier0.level_of("score")), "self_directed": F.lit(False)})
    return policy.hold_policy(scored, profiles).select("event_id", "sensitivity", "held")


@query("offer_policy", f"{MSG_T0} SELECT msg_id, self_directed AS incoming_too FROM t0 WHERE distress")
def offer_policy(spark, sf):
    return policy.offer_policy(verdicts(spark, sf)).select("msg_id", F.col("self_directed").alias("incoming_too"))


@query("primary_category", f"{MSG_T0} SELECT msg_id, {O.PRIMARY} AS primary_category FROM t0 WHERE len(categories) > 0")
def primary_category(spark, sf):
    return verdicts(spark, sf).filter("size(categories) > 0").select("msg_id", policy.primary_category().alias("primary_category"))


@query("reason_text", f"{MSG_T0} SELECT msg_id, coalesce(CASE WHEN msg_id % 9 = 0 THEN 'reviewed by hand' END, {O.REASON}) AS reason FROM t0")
def reason_text(spark, sf):
    df = verdicts(spark, sf).withColumn("rationale", F.expr("CASE msg_id % 9 WHEN 0 THEN 'reviewed by hand' WHEN 1 THEN '' END"))
    return policy.reason_text(df).select("msg_id", "reason")


@query("expectation_met", f"""{MSG_LOCAL} SELECT msg_id, expect, CASE expect WHEN 'hold' THEN held WHEN 'pass' THEN NOT held WHEN 'offer' THEN NOT held AND distress ELSE false END AS met
FROM (SELECT *, {O.held('balanced')} AS held, CASE msg_id % 4 WHEN 0 THEN 'hold' WHEN 1 THEN 'pass' WHEN 2 THEN 'offer' ELSE 'other' END AS expect FROM local)""")
def expectation_met(spark, sf):
    df = local(spark, sf).withColumn("held", F.expr(policy.held("balanced"))).withColumn(
        "expect", F.expr("CASE msg_id % 4 WHEN 0 THEN 'hold' WHEN 1 THEN 'pass' WHEN 2 THEN 'offer' ELSE 'other' END"))
    return df.select("msg_id", "expect", policy.expectation_met().alias("met"))


@query("metadata_projection", f"""{MSG_LOCAL} SELECT msg_id, CASE WHEN {O.held('balanced')} THEN 'caught' ELSE 'passed' END AS kind, length(text) AS text_length,
    round(score, 6) AS score, CASE WHEN score > 0 THEN CASE WHEN score < 0.55e0 THEN 'Sharp' WHEN score < 0.78e0 THEN 'Harsh' ELSE 'Cruel' END END AS severity FROM local""")
def metadata_projection(spark, sf):
    df = local(spark, sf).withColumns({"kind": F.expr(f"if({policy.held('balanced')}, 'caught', 'passed')"), "install_id": F.col("msg_id")})
    return A.metadata_projection(df).select(F.col("install_id").alias("msg_id"), "kind", F.col("text_length").cast("bigint").alias("text_length"),
                                            *rounded("score"), "severity")


# ------------------------------------------------------------------ context
@query("conversation_source", r"""WITH l AS (SELECT conv_id, seq, trim(text) AS line FROM msg WHERE length(trim(text)) BETWEEN 2 AND 500),
f AS (SELECT conv_id, line, min(seq) AS seq FROM l GROUP BY conv_id, line),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS k FROM f)
SELECT conv_id, seq, line FROM r WHERE k <= 12""".replace("WITH l", f"WITH {O.MESSAGES}, l"))
def conversation_source(spark, sf):
    return context.conversation_source(frames.messages(spark, sf), order="seq")


W1_SQL = "coalesce(array_to_string(list({x}) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), '|'), '')"


@query("context_window", f"WITH {O.MESSAGES} SELECT msg_id, md5({W1_SQL.format(x='text', n=12)}) AS context FROM msg")
def context_window(spark, sf):
    df = context.context_window(frames.messages(spark, sf), order="seq")
    return df.select("msg_id", F.md5(F.array_join("context", "|")).alias("context"))


@query("rewrite_context", f"WITH {O.MESSAGES} SELECT msg_id, md5({W1_SQL.format(x='left(text, 300)', n=8)}) AS context FROM msg")
def rewrite_context(spark, sf):
    df = context.rewrite_context(frames.messages(spark, sf), order="seq")
    return df.select("msg_id", F.md5(F.array_join("rewrite_context", "|")).alias("context"))


@query("pile_on", f"{MSG_NORM}, {O.PILE} SELECT id AS msg_id, echoes, round(CASE WHEN echoes >= 2 THEN least(0.58e0 + 0.10e0 * echoes, 0.82e0) ELSE 0e0 END, 6) AS pile_on_score FROM pile")
def pile_on(spark, sf):
    raw = frames.messages(spark, sf)
    return tier0.pile_on_score(context.with_context(normalize.normalize(raw), "conv_id", "seq", source=raw)).select("msg_id", F.col("echoes").cast("bigint").alias("echoes"), *rounded("pile_on_score"))


@query("review_requests", f"""WITH {O.MESSAGES}, c AS (SELECT msg_id, text, list(text) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS ctx FROM msg)
SELECT msg_id, md5(CASE WHEN ctx IS NULL OR len(ctx) = 0 THEN 'CONVERSATION: (none available)' || chr(10) || chr(10) ELSE 'CONVERSATION (oldest first):' || chr(10)
    || array_to_string(list_transform(ctx, lambda l: '- ' || left(l, 400) || chr(10)), '') || chr(10) END || 'DRAFT the writer is about to send:' || chr(10) || left(text, 2000)) AS digest FROM c""")
def review_requests(spark, sf):
    df = context.context_window(frames.messages(spark, sf), order="seq")
    return sinks.review_requests(df, "msg_id").select("msg_id", F.md5("prompt").alias("digest"))


# ------------------------------------------------------------------ summaries and evaluation
@query("conversation_summary", f"""{MSG_LOCAL}, h AS (SELECT *, {O.held('balanced')} AS held, {O.held('attentive')} AS covered FROM local),
cc AS (SELECT conv_id, role, string_agg(DISTINCT c, ',' ORDER BY c) AS categories FROM (SELECT conv_id, role, unnest(categories) AS c FROM h) GROUP BY ALL)
SELECT h.conv_id, h.role, count(*) AS messages, count(*) FILTER (held) AS held, count(*) FILTER (covered) AS covered, round(max(score), 6) AS max_score,
    coalesce(any_value(cc.categories), '') AS categories FROM h LEFT JOIN cc ON cc.conv_id = h.conv_id AND cc.role = h.role GROUP BY h.conv_id, h.role""")
def conversation_summary(spark, sf):
    from textguard.plans.rollups import conversation_summary as summary
    df = local(spark, sf).withColumns({"held": F.expr(policy.held("balanced")), "covered": F.expr(policy.held("attentive"))})
    return summary(df).withColumn("max_score", F.round("max_score", 6))


@query("category_mix", f"{MSG_LOCAL} SELECT {O.level('score')} AS level, tier, c AS category, count(*) AS n FROM (SELECT score, tier, unnest(categories) AS c FROM local) GROUP BY ALL")
def category_mix(spark, sf):
    from textguard.plans.rollups import category_mix as mix
    return mix(local(spark, sf), "level", "tier")


@query("doc_toxicity_eval", f"""{DOC_NORM}, {O.L10}
SELECT {O.level('model_score')} AS level, toxic, count(*) AS docs, round(avg(model_score), 6) AS avg_score FROM l10 JOIN labels ON labels.doc_id = l10.id GROUP BY 1, 2""")
def doc_toxicity_eval(spark, sf):
    return evaluate.doc_toxicity_eval(docs(spark, sf), frames.table(spark, sf, "labels"))


@query("evaluate_classifier", f"""{DOC_NORM}, {O.L10}, e AS (SELECT toxic AS a, CASE WHEN model_score > 0 THEN 1 ELSE 0 END AS p FROM l10 JOIN labels ON labels.doc_id = l10.id)
SELECT count(*) FILTER (a = 1 AND p = 1) AS tp, count(*) FILTER (a = 0 AND p = 1) AS fp, count(*) FILTER (a = 1 AND p = 0) AS fn, count(*) FILTER (a = 0 AND p = 0) AS tn,
    round(count(*) FILTER (a = p) / count(*)::DOUBLE, 4) AS accuracy FROM e""")
def evaluate_classifier(spark, sf):
    labels = frames.table(spark, sf, "labels")
    scores = evaluate.document_scores(evaluate.labelled(docs(spark, sf), labels)).join(labels, "doc_id")
    return evaluate.evaluate_classifier(scores.select(F.col("toxic").alias("actual"), F.expr("if(model_score > 0, 1, 0)").alias("predicted")))


@query("verdict_parity", f"""{DOC_NORM}, {O.L10}, raw AS (SELECT id, text FROM docs),
pl AS (SELECT id, model_score AS a FROM l10), lw AS (SELECT n.id, CASE WHEN len(tokens) = 0 THEN 0e0 ELSE least((0.30e0 * least(len(list_intersect(tokens, {O.arr(O.L.DEGRADING_WORDS)})), 3)
    + 0.18e0 * least(len(list_intersect(tokens, {O.arr(O.L.STRONG_PROFANITY + O.L.MILD_PROFANITY)})), 3) + 0.45e0 * least(len(list_intersect(tokens, {O.arr(O.L.SLURS)})), 2))
    * CASE WHEN list_has_any(tokens, {O.arr(O.L.SECOND_PERSON)}) THEN 1.5e0 ELSE 0.6e0 END, 0.99e0) END AS b FROM n)
SELECT count(*) AS n, round(max(abs(a - b)), 6) AS max_diff, count(*) FILTER (abs(a - b) > 0.02) AS over_tolerance, 0::BIGINT AS unmatched,
    round(max(abs(a - b)), 6) <= 0.02 AS passed FROM pl JOIN lw USING (id)""")
def verdict_parity(spark, sf):
    """The score over all word forms against the score over plain tokens only. Texts are normalised once; what the two sides are joined from is scores."""
    full = cascade.lexical_scorer(normal_docs(spark, sf, *normalize.LEXICAL)).withColumn("word_set", F.col("tokens"))
    scores = phrase_index.stored(phrases.lexical_fallback_score(full, "plain_score").select("doc_id", "model_score", "plain_score"), frames.folder(spark, "parity"))
    return evaluate.verdict_parity(*[scores.select("doc_id", F.col(c).alias("score")) for c in ("model_score", "plain_score")], "doc_id")


# Punctuation, ASCII symbols, ideographs and the characters that are dropped, spelled out.
IDEOGRAPHS = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{2F800}-\x{2FA1F}"


@query("token_lengths", rf"""SELECT doc_id, len(t)::BIGINT AS n_tokens, len(t) > 64 AS over_budget FROM (
SELECT doc_id, regexp_extract_all(lower(strip_accents(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{{Cf}}\p{{Co}}\x{{FFFD}}]', '', 'g'))),
    '[\p{{P}}$+<=>^`|~{IDEOGRAPHS}]|[^ \t\n\r\p{{Zs}}\p{{P}}$+<=>^`|~{IDEOGRAPHS}]+') AS t FROM documents)""")
def token_lengths(spark, sf):
    df = evaluate.token_lengths(docs(spark, sf), "doc_id")
    return df.select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), "over_budget")


GOLDEN_SUITES = "CASE conv_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'hold' ELSE 'levels' END"


def golden(spark: SparkSession, sf: str) -> DataFrame:
    """Every message as a regression case; what is expected of it follows from its carrier."""
    df = frames.messages(spark, sf)
    sensitivity = "CASE seq % 3 WHEN 0 THEN 'light' WHEN 1 THEN 'balanced' ELSE 'attentive' END"
    return df.select(F.col("msg_id").alias("case_id"), F.expr(GOLDEN_SUITES).alias("suite"), F.expr(sensitivity).alias("sensitivity"), "text",
                     F.expr("if(text LIKE '%you%', 'hold', 'pass')").alias("expect"))


@query("regression_suite", f"""WITH {O.MESSAGES}, {O.local_ctes('msg')}, {HELD3}
SELECT suite, count(*) AS cases, count(*) FILTER (CASE expect WHEN 'hold' THEN held ELSE NOT held END) AS met FROM (
    SELECT {GOLDEN_SUITES} AS suite, CASE WHEN text LIKE '%you%' THEN 'hold' ELSE 'pass' END AS expect, NOT self_directed AND score >= floor AND score >= threshold AS held
    FROM local JOIN pol ON pol.sensitivity = CASE seq % 3 WHEN 0 THEN 'light' WHEN 1 THEN 'balanced' ELSE 'attentive' END) GROUP BY suite""")
def regression_suite(spark, sf):
    return evaluate.regression_suite(golden(spark, sf))


@query("fixture_replay", f"""{MSG_LOCAL} SELECT msg_id, expect, {O.held('balanced')} AS held, distress, round(score, 6) AS score,
    CASE expect WHEN 'hold' THEN {O.held('balanced')} WHEN 'pass' THEN NOT {O.held('balanced')} ELSE NOT {O.held('balanced')} AND distress END AS met
FROM (SELECT *, CASE WHEN distress THEN 'offer' WHEN seq % 2 = 0 THEN 'hold' ELSE 'pass' END AS expect FROM local)""")
def fixture_replay(spark, sf):
    """Messages with their context as raw lines, replayed as fixtures."""
    df = context.context_window(frames.messages(spark, sf), order="seq")
    fixtures = df.select(F.col("msg_id").alias("id"), "context", F.col("text").alias("draft"), F.lit("").alias("expect"), "seq")
    replay = evaluate.fixture_replay(fixtures.drop("seq"), path=frames.folder(spark, "fixtures"))
    marked = replay.withColumn("expect", F.expr("CASE WHEN distress THEN 'offer' WHEN id % 1000000 % 2 = 0 THEN 'hold' ELSE 'pass' END"))
    return marked.select(F.col("id").alias("msg_id"), "expect", "held", "distress", *rounded("score"), policy.expectation_met().alias("met"))


