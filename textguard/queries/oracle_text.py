"""SQL twins of the text operators, in DuckDB's dialect.

They share the fixed word lists with the library and nothing else: tokens are rows, runs are
islands, and the aim walk is a join, where the library uses array expressions.
"""

from __future__ import annotations

from textguard import lexicon as L
from textguard import rulebook as B
from textguard.functions import text as T
from textguard.operators import aim, phrases, rules
from textguard.operators import normalize as N
from textguard.operators.cascade import REFUSALS
from textguard.operators.policy import CATEGORY_ORDER, DEFAULT_REASON, REASONS, SENSITIVITIES
from textguard.queries.frames import CARRIERS, DAY


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in dict.fromkeys(values)) + "]"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


# ------------------------------------------------------------------ sources
DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"

MESSAGES = rf"""
turns AS (SELECT conv_id, turn, role,
    list_filter(string_split(regexp_replace(text, '([.!?]\s+)', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS parts
    FROM conversations),
sent AS (SELECT conv_id, turn, role, u.k - 1 AS pos, regexp_replace(parts[u.k], '^\s+|\s+$', '', 'g') AS s
    FROM turns, unnest(range(1, len(parts) + 1)) AS u(k)),
msg AS (SELECT conv_id * 10000000000 + turn * 100000 + pos AS id, conv_id * 10000000000 + turn * 100000 + pos AS msg_id, conv_id,
    turn * 100000 + pos AS seq, role,
    timestamp '{DAY} 00:00:00' + to_seconds(conv_id * 600 + turn * 60 + pos * 5) AS ts,
    CASE pos % 3 WHEN 0 THEN c || ' ' || s WHEN 1 THEN s || ' ' || c ELSE s || ', ' || c END AS text
    FROM (SELECT *, ({arr(CARRIERS)})[(conv_id * 13 + turn * 7 + pos // 4) % {len(CARRIERS)} + 1] AS c FROM sent))"""


# ------------------------------------------------------------------ characters
def fold(col: str) -> str:
    """N1-N3 of a column."""
    conf = f"translate({{x}}, {q(''.join(T.CONFUSABLES))}, {q(''.join(T.CONFUSABLES.values()))})"
    inv = f"translate({col}, {q(T.INVISIBLE)}, '')"
    return (f"CASE WHEN strlen({col}) = length({col}) THEN lower({col}) ELSE "
            + conf.replace("{x}", f"lower(strip_accents({inv}))") + " END")


LEET_SET = "".join(T.LEET)


def leet(chars: str) -> str:
    """N5 over a list of characters."""
    touch = rf"[\p{{L}}{LEET_SET}]"
    near = f"(coalesce(regexp_matches({chars}[i - 1], {q(touch)}), false) OR coalesce(regexp_matches({chars}[i + 1], {q(touch)}), false))"
    return (f"array_to_string(list_transform({chars}, lambda c, i: CASE WHEN contains({q(LEET_SET)}, c) AND {near}"
            f" THEN translate(c, {q(LEET_SET)}, {q(''.join(T.LEET.values()))}) ELSE c END), '')")


def space(col: str) -> str:
    return rf"trim(regexp_replace({col}, '[ \t\n\r]+', ' ', 'g'))"


def runs(col: str, keep: int) -> str:
    """N7 of a short text through the list of its characters."""
    return char_runs(f"string_split({col}, '')", keep)


def char_runs(chars: str, keep: int) -> str:
    """N7 over a column that holds the list of characters."""
    same = " AND ".join(f"coalesce({chars}[i - {k}] = c, false)" for k in range(1, keep + 1))
    return f"array_to_string(list_filter({chars}, lambda c, i: NOT ({same})), '')"


def tokens(col: str) -> str:
    return rf"list_filter(regexp_split_to_array(replace({col}, '''', ''), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def bare(col: str) -> str:
    return rf"regexp_replace({col}, '[^\p{{L}}\p{{N}}]', '', 'g')"


# ------------------------------------------------------------------ words
ALIAS = f"alias_of(s, t) AS (SELECT * FROM {values(L.ALIASES.items())})"
VOCAB = f"vocab(term) AS (SELECT unnest({arr(N.vocabulary())}))"
MASKV = f"maskv(term) AS (SELECT unnest({arr(N.mask_vocabulary())}))"


def mask_ctes(source: str = "folded") -> str:
    """Distinct masked words and what they resolve to: maskmap(w, r)."""
    pat = r"regexp_replace(core, '([.\\+?^$(){}|\[\]&-])', '\\\1', 'g')"
    pat = rf"regexp_replace({pat}, '[*#%_]([*#%_]+)', chr(1) || '\1', 'g')"
    pat = rf"regexp_replace({pat}, '(^|[^*#%_' || chr(1) || '])([*#%_])', '\1' || chr(2), 'g')"
    pat = f"replace(replace({pat}, chr(1), '[a-z]{{0,2}}'), chr(2), '[a-z]{{1,2}}')"
    pat = f"regexp_replace({pat}, '[*#%_]', '[a-z]', 'g')"
    return rf"""
masked AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(f, ' ')) AS w FROM {source} WHERE regexp_matches(f, '[*#%_]'))
    WHERE regexp_matches(w, '[*#%_]')),
cores AS (SELECT w, regexp_replace(w, '^[^\p{{L}}\p{{M}}*#%_]+|[^\p{{L}}\p{{M}}*#%_]+$', '', 'g') AS core FROM masked),
pats AS (SELECT w, core, regexp_extract(core, '^([^*#%_]*)', 1) AS head, regexp_extract(core, '([^*#%_]*)$', 1) AS tail,
    {pat} AS pat FROM cores WHERE regexp_matches(core, '\p{{L}}') AND length(core) >= 2),
maskmap AS (SELECT w, replace(w, core, min(lpad(length(term)::VARCHAR, 3, '0') || term)[4:]) AS r
    FROM pats JOIN maskv ON starts_with(term, head) AND ends_with(term, tail)
    WHERE regexp_full_match(term, pat) GROUP BY w, core)"""


def canon_map(name: str, source: str, typos: bool = False) -> str:
    """name(w, two, one, c) for the distinct words of ``source(w)``."""
    typo = "ty.fixed," if typos else ""
    typo_join = "LEFT JOIN typo_fixes ty ON ty.w = d.w" if typos else ""
    return f"""
{name}_d AS (SELECT w, {runs('w', 2)} AS two, {runs('w', 1)} AS one FROM (SELECT DISTINCT w FROM {source})),
{name} AS (SELECT d.w, two, one, coalesce(a0.t, v0.term, CASE WHEN length(d.w) <= 2 THEN d.w END, {typo}
        a2.t, v2.term, a1.t, v1.term, d.w) AS c
    FROM {name}_d d LEFT JOIN alias_of a0 ON a0.s = d.w LEFT JOIN vocab v0 ON v0.term = d.w {typo_join}
    LEFT JOIN alias_of a2 ON a2.s = two LEFT JOIN vocab v2 ON v2.term = two
    LEFT JOIN alias_of a1 ON a1.s = one LEFT JOIN vocab v1 ON v1.term = one)"""


def plain_ctes(source: str, text: str = "text") -> str:
    """plain_t(id, text, plain) from a CTE with id and text."""
    return f"""{MASKV},
folded AS (SELECT *, {fold(text)} AS f FROM {source}),
{mask_ctes()},
chunks AS (SELECT id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k
    FROM (SELECT id, string_split(f, ' ') AS ws FROM folded WHERE regexp_matches(f, '[*#%_]'))),
unmasked AS (SELECT c.id, string_agg(coalesce(m.r, c.w), ' ' ORDER BY c.k) AS f
    FROM chunks c LEFT JOIN maskmap m ON m.w = c.w GROUP BY c.id),
charlists AS MATERIALIZED (SELECT d.* EXCLUDE (f), string_split(coalesce(u.f, d.f), '') AS chars FROM folded d LEFT JOIN unmasked u ON u.id = d.id),
plain_t AS (SELECT * EXCLUDE (chars), {space(leet('chars'))} AS plain FROM charlists)"""


def norm_ctes(source: str, text: str = "text", typos: bool = False) -> str:
    """n(id, ..., plain, destretched, squashed, tokens, canonical, ctext, cjoined, jtokens)."""
    return f"""{plain_ctes(source, text)}, {ALIAS}, {VOCAB},
bare_t AS MATERIALIZED (SELECT *, string_split(plain, '') AS pc, string_split({bare('plain')}, '') AS lc FROM plain_t),
base AS MATERIALIZED (SELECT * EXCLUDE (pc, lc), {char_runs('pc', 2)} AS destretched, {char_runs('lc', 1)} AS squashed, {tokens('plain')} AS tokens FROM bare_t),
tok AS (SELECT b.id, u.k AS pos, b.tokens[u.k] AS w FROM base b, unnest(range(1, len(b.tokens) + 1)) AS u(k)),
{canon_map('cm', 'tok', typos)},
ct AS (SELECT id, pos, c, regexp_full_match(c, '\\p{{L}}') AS single FROM tok JOIN cm USING (w)),
isl AS (SELECT *, CASE WHEN single THEN pos - row_number() OVER (PARTITION BY id, single ORDER BY pos) ELSE -pos END AS g FROM ct),
grp AS (SELECT id, single, g, min(pos) AS pos, count(*) AS n, string_agg(c, '' ORDER BY pos) AS w, string_agg(c, ' ' ORDER BY pos) AS spaced
    FROM isl GROUP BY id, single, g),
{canon_map('gm', "(SELECT w FROM grp WHERE single AND n >= 2)", typos)},
glued AS (SELECT g.id, g.pos, CASE WHEN single AND (n >= 3 OR (n = 2 AND (g.w IN (SELECT term FROM vocab) OR g.w IN (SELECT s FROM alias_of))))
    THEN gm.c ELSE spaced END AS t FROM grp g LEFT JOIN gm ON gm.w = g.w),
cagg AS (SELECT id, list(c ORDER BY pos) AS canonical FROM ct GROUP BY id),
jagg AS (SELECT id, string_agg(t, ' ' ORDER BY pos) AS j FROM glued GROUP BY id),
n AS (SELECT b.*, coalesce(c.canonical, []) AS canonical, ' ' || coalesce(array_to_string(c.canonical, ' '), '') || ' ' AS ctext,
    ' ' || coalesce(j.j, '') || ' ' AS cjoined, CASE WHEN j.j IS NULL THEN [] ELSE string_split(j.j, ' ') END AS jtokens
    FROM base b LEFT JOIN cagg c ON c.id = b.id LEFT JOIN jagg j ON j.id = b.id)"""


L10 = f"""
ws AS (SELECT id, list(DISTINCT w) AS ws FROM (
    SELECT id, w FROM tok
    UNION ALL SELECT id, unnest({tokens('destretched')}) FROM base WHERE destretched <> plain
    UNION ALL SELECT id, one FROM tok JOIN cm USING (w) WHERE two <> w) GROUP BY id),
l10 AS (SELECT n.id, CASE WHEN ws IS NULL THEN 0e0 ELSE least(
    (0.30e0 * least(len(list_intersect(ws, {arr(L.DEGRADING_WORDS)})), 3)
     + 0.18e0 * least(len(list_intersect(ws, {arr(L.STRONG_PROFANITY + L.MILD_PROFANITY)})), 3)
     + 0.45e0 * least(len(list_intersect(ws, {arr(L.SLURS)})), 2))
    * CASE WHEN list_has_any(ws, {arr(L.SECOND_PERSON)}) THEN 1.5e0 ELSE 0.6e0 END, 0.99e0) END AS model_score
    FROM n LEFT JOIN ws USING (id))"""


def level(score: str) -> str:
    return f"CASE WHEN {score} >= 0.70e0 THEN 'harmful' WHEN {score} >= 0.35e0 THEN 'borderline' ELSE 'clear' END"


# ------------------------------------------------------------------ phrases
def phrase_rows():
    return [(name, i, p, phrases.needle(p), 1 if name in phrases.EVASIVE else 0)
            for name, terms in phrases.PHRASE_LISTS.items() for i, p in enumerate(terms)]


PHRASES = f"""
phr(list, ord, phrase, needle, evasive) AS (SELECT * FROM {values(phrase_rows())}),
ph AS (SELECT id, list, ord, phrase FROM n JOIN phr ON contains(ctext, needle) OR (evasive = 1 AND contains(cjoined, needle))
    WHERE NOT (list = 'exclusion' AND phrase LIKE '%asked' AND regexp_matches(ctext, ' asked (?:me|us|him|her|them|to|for|about) '))),
pc AS (SELECT id, {', '.join(f"count(*) FILTER (list = '{name}') AS {name}_n" for name in phrases.PHRASE_LISTS)} FROM ph GROUP BY id)"""


# ------------------------------------------------------------------ rules
def rule_test(pattern: str, name: str, form: str) -> str:
    """Whether one rule matches one padded form, without look-around."""
    filled = rules.fill(pattern)
    if name == "you're dead":
        ahead = "to|weight|serious|tired|wrong|on|last|meat|ass|set|center|end|ahead|right|inside|asleep"
        form = f"regexp_replace({form}, ' dead ({ahead})', ' dead-\\1', 'g')"
        filled = filled.replace(f"(?! (?:{ahead}))", "")
    elif name in ("kill you", "fuck you"):
        form = f"regexp_replace({form}, ' know', '-know', 'g')"
        filled = filled.replace("(?! know)", "")
    elif name == "you suck":
        verb, rest = filled.split("(?! at)|")
        glued = f"regexp_replace({form}, ' at', '-at', 'g')"
        return f"(regexp_matches({glued}, {q(' (?:' + verb + ') ')}) OR regexp_matches({form}, {q(' (?:' + rest + ') ')}))"
    return f"regexp_matches({form}, {q(' (?:' + filled + ') ')})"


# Each word of each form with the words from it on and the three and four words before it.
AHEAD = """
ahead AS MATERIALIZED (SELECT id, form, string_agg(w, ' ') OVER (PARTITION BY id, form ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) || ' ' AS words,
    list(w) OVER (PARTITION BY id, form ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS three,
    list(w) OVER (PARTITION BY id, form ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS four
    FROM (SELECT id, 'c' AS form, pos, c AS w FROM ct UNION ALL
          SELECT id, 'j', unnest(range(1, len(jtokens) + 1)), unnest(jtokens) FROM n WHERE cjoined <> ctext))"""


def rule_ctes() -> str:
    """rh(id, ord): every rule hit; rul(ord, hit, hard, score, cats): what it means."""
    tests, meaning = [], []
    for i, (family, name, score, cats, pattern, guarded) in enumerate(B.RULES):
        kind = "phrase" if family == "harassment" else "rule"
        meaning.append((i, f"{kind}:{name}", 1 if kind == "rule" else 0, f"{score}e0", ",".join(cats)))
        if guarded:
            starts = q("^(?:" + rules.fill(pattern) + ") ")
            tests.append(f"SELECT DISTINCT id, {i} AS ord FROM ahead WHERE regexp_matches(words, {starts})"
                         f" AND NOT coalesce(list_has_any(three, {arr(rules.WRITER_BEFORE)}), false)")
        else:
            tests.append(f"SELECT id, {i} AS ord FROM n WHERE {rule_test(pattern, name, 'ctext')}"
                         f" OR (cjoined <> ctext AND {rule_test(pattern, name, 'cjoined')})")
    rows = ", ".join(f"({i}, {q(h)}, {hd}, {s}, {q(c)})" for i, h, hd, s, c in meaning)
    return f"{AHEAD},\nrul(ord, hit, hard, score, cats) AS (SELECT * FROM (VALUES {rows})),\nrh AS ({' UNION ALL '.join(tests)})"


QUOTING = f"regexp_matches(ctext, {q(' (?:' + '|'.join(f'(?:{p})' for p in B.REPORTING) + ') ')})"


def affection_test() -> str:
    emoji = " OR ".join(f"contains(text, {q(e)})" for e in L.AFFECTION_EMOJI)
    marks = q("^(?:" + B.AFFECTION + ") ")
    return (f"({emoji} OR n.id IN (SELECT id FROM ahead WHERE form = 'c' AND regexp_matches(words, {marks})"
            f" AND NOT coalesce(list_has_any(four, {arr(L.LOVE_NEGATORS)}), false)))")


# ------------------------------------------------------------------ aim
INS = arr(aim.INSULTS)
PROF = arr(aim.PROFANITY)
POSS = arr(aim.POSSESSIVES)

AIM = f"""
cpos AS (SELECT id, pos, c AS w, lag(c) OVER (PARTITION BY id ORDER BY pos) AS prev, lead(c) OVER (PARTITION BY id ORDER BY pos) AS nxt,
    count(*) OVER (PARTITION BY id) AS len FROM ct),
ins AS (SELECT id, pos AS i, w, nxt, len FROM cpos WHERE list_contains({INS}, w)),
walk AS (SELECT a.id, a.i, b.pos AS j, CASE
        WHEN list_contains({arr(L.NEGATIONS)}, b.w) THEN 'none'
        WHEN list_contains({POSS}, b.w) THEN CASE WHEN b.w = 'your' AND a.i - b.pos <= 2 AND list_contains({arr(L.INSULT_ADJECTIVES)}, a.w)
            AND a.nxt IS NOT NULL AND NOT list_contains({arr([*aim.INSULTS, *aim.PROFANITY, *L.FUNCTION_WORDS])}, a.nxt) THEN 'none' ELSE 'second' END
        WHEN list_contains({arr(L.AIM_SECOND)}, b.w) THEN 'second'
        WHEN list_contains({arr(L.BODY_WORDS)}, b.w) AND coalesce(list_contains({POSS}, b.prev), false) THEN 'family'
        WHEN list_contains({arr(L.FAMILY_WORDS)}, b.w) THEN CASE WHEN coalesce(list_contains({POSS}, b.prev), false) THEN 'family' ELSE 'third' END
        WHEN list_contains({arr(L.AIM_FIRST)}, b.w) THEN 'first'
        WHEN list_contains({arr(L.AIM_THIRD)}, b.w) THEN 'third'
        WHEN b.w IN ('what', 'such', 'how') THEN 'vocative'
        WHEN NOT list_contains({arr([*L.FILLER_WORDS, *aim.INSULTS, *aim.PROFANITY])}, b.w) THEN 'stop' END AS verdict
    FROM ins a JOIN cpos b ON b.id = a.id AND b.pos BETWEEN a.i - {aim.STEPS} AND a.i - 1),
stops AS (SELECT id, i, arg_max(verdict, j) AS verdict FROM walk WHERE verdict IS NOT NULL GROUP BY id, i),
aims AS (SELECT a.id, a.i, a.w, CASE WHEN coalesce(s.verdict, 'stop') <> 'stop' THEN s.verdict
        WHEN coalesce(list_contains({arr(L.AIM_SECOND)}, a.nxt), false) THEN 'second'
        WHEN a.i = a.len AND a.i > 1 AND list_contains({arr(L.PERSON_INSULTS)}, a.w) THEN 'vocative' ELSE 'none' END AS aim
    FROM ins a LEFT JOIN stops s ON s.id = a.id AND s.i = a.i),
who AS (SELECT id, bool_or(list_contains({arr([*L.AIM_SECOND, 'your'])}, w)) AS second, bool_or(list_contains({arr(L.AIM_FIRST)}, w)) AS first,
    bool_or(list_contains({arr(phrases.PRONOUNS)}, w)) AS third,
    count(*) <= 6 AND bool_and(list_contains({arr([*aim.INSULTS, *aim.PROFANITY, *L.INSULT_ONLY_FILLERS, *L.SLURS])}, w)) AS insult_only,
    count(*) FILTER (list_contains({arr(L.EVALUATIVE_WORDS)}, w)) AS judging
    FROM cpos GROUP BY id),
landed AS (SELECT a.id, a.i, a.w, list_contains({arr(L.MILD_INSULTS)}, a.w) AS mild, CASE
        WHEN aim = 'vocative' AND first AND NOT second THEN 'first'
        WHEN aim = 'vocative' AND third AND NOT second THEN 'third'
        WHEN aim = 'vocative' THEN 'second'
        WHEN aim = 'none' AND insult_only AND NOT first THEN 'second' ELSE aim END AS aim
    FROM aims a JOIN who USING (id)),
land AS (SELECT id, count(*) AS n, count(*) FILTER (aim IN ('second', 'family') AND NOT mild) AS strong_n,
    count(*) FILTER (aim IN ('second', 'family') AND mild) AS mild_n, count(*) FILTER (aim = 'third') AS third_n,
    count(*) FILTER (aim = 'third' AND NOT mild) AS third_strong FROM landed GROUP BY id)"""

WARM = " OR ".join([f"contains(ctext, {q(m)})" for m in L.WARM_MARKERS] + [f"contains(plain, {q(e)})" for e in aim.WARM_EMOJI])

SIGNALS = f"""
sig AS (SELECT n.*, coalesce(w.second, false) AS second, coalesce(w.first, false) AS first, coalesce(w.insult_only, false) AS insult_only,
    coalesce(w.judging, 0) AS judging, ({WARM}) AS warm, coalesce(l.n, 0) AS insults_n, coalesce(l.strong_n, 0) AS strong_n,
    coalesce(l.mild_n, 0) AS mild_n, coalesce(l.third_n, 0) AS third_n, coalesce(l.third_strong, 0) AS third_strong,
    {', '.join(f'coalesce(p.{name}_n, 0) AS {name}_n' for name in phrases.PHRASE_LISTS)},
    list_distinct(canonical || jtokens) AS words,
    {QUOTING} AS quoting, {affection_test()} AS affection,
    len(canonical) BETWEEN 1 AND 3 AND canonical[1] IN ('die', 'rot', 'kys') AS bare_command
    FROM n LEFT JOIN who w USING (id) LEFT JOIN land l USING (id) LEFT JOIN pc p USING (id)),
sig2 AS (SELECT *, list_intersect(words, {arr(L.SLURS)}) AS slur_words,
    list_filter(list_intersect(words, {arr(L.EXPLICIT_WORDS)}), lambda w: NOT (w = 'cum' AND list_contains(words, 'laude'))) AS explicit_words,
    list_intersect(words, {arr(L.STRONG_PROFANITY)}) AS strong_words, list_intersect(words, {arr(L.MILD_PROFANITY)}) AS mild_words
    FROM sig),
sig3 AS (SELECT *,
    CASE WHEN len(slur_words) = 0 THEN 0e0 WHEN len(list_filter(slur_words, lambda w: NOT list_contains({arr(L.SOFT_SLURS)}, w))) = 0
        THEN CASE WHEN second THEN 0.72e0 ELSE 0.30e0 END WHEN second THEN 0.95e0 ELSE 0.86e0 END AS slur_score,
    CASE WHEN len(explicit_words) + explicit_phrase_n > 0 THEN 0.97e0 WHEN len(strong_words) > 0 THEN 0.86e0
        WHEN len(mild_words) > 0 THEN 0.66e0 ELSE 0e0 END AS content_score,
    CASE WHEN len(explicit_words) + explicit_phrase_n > 0 THEN 'explicit'
        WHEN len(strong_words) + len(mild_words) > 0 THEN 'profanity' END AS content_category,
    CASE WHEN exclusion_n = 0 THEN 0e0 ELSE least(0.55e0 + 0.08e0 * least(exclusion_n - 1, 2) + CASE WHEN second THEN 0.07e0 ELSE 0e0 END, 0.80e0) END AS exclusion_score,
    CASE WHEN pointed_n = 0 THEN 0e0 ELSE least(0.48e0 + 0.08e0 * least(pointed_n - 1, 2), 0.64e0) END AS backhanded_score,
    CASE WHEN mockery_n = 0 THEN 0e0 ELSE least(0.36e0 + 0.08e0 * least(mockery_n - 1, 3), 0.6e0) END AS mockery_score,
    CASE WHEN insults_n = 0 THEN 0e0 ELSE greatest(
        CASE WHEN strong_n > 0 THEN least(0.80e0 + least(strong_n + mild_n - 1, 2) * 0.06e0, 0.92e0)
             WHEN mild_n > 0 THEN least(CASE WHEN warm THEN 0.50e0 ELSE 0.63e0 END + least(mild_n - 1, 2) * 0.06e0, CASE WHEN warm THEN 0.6e0 ELSE 0.72e0 END)
             ELSE 0e0 END,
        CASE WHEN third_n = 0 THEN 0e0 WHEN third_strong > 0 THEN 0.64e0 ELSE 0.40e0 END,
        CASE WHEN strong_n + mild_n + third_n = 0 THEN 0.15e0 ELSE 0e0 END) END AS insult_score,
    strong_n + mild_n > 0 OR (insult_only AND NOT first) AS insult_aimed,
    self_harm_n + distress_n > 0 AS distress
    FROM sig2)"""

# W3 over msg ids: needs conv_id and seq on n.
PILE = """
pw AS (SELECT id, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS rn,
    list_distinct(list_filter(tokens, lambda w: length(w) > 2)) AS lw FROM n),
echo AS (SELECT a.id, count(*) FILTER (len(a.lw) > 0 AND len(b.lw) > 0 AND len(list_intersect(a.lw, b.lw)) /
        nullif(len(list_distinct(a.lw || b.lw)), 0)::DOUBLE >= 0.45e0) AS echoes
    FROM pw a JOIN pw b ON b.conv_id = a.conv_id AND b.rn BETWEEN a.rn - 6 AND a.rn - 1 GROUP BY a.id),
pile AS (SELECT pw.id, least(pw.rn - 1, 12) AS context_size, CASE WHEN pw.rn > 2 THEN coalesce(echoes, 0) ELSE 0 END AS echoes
    FROM pw LEFT JOIN echo USING (id))"""
NO_PILE = "pile AS (SELECT id, 0 AS context_size, 0 AS echoes FROM n)"

COMPOSE = f"""
rr AS (SELECT id, max(CASE WHEN hard = 1 THEN score END) AS hard, max(CASE WHEN hard = 0 THEN score END) AS soft, max(least(0.97e0, score)) AS sure,
    count(*) AS n, string_agg(cats, ',') AS cats, bool_and(hit = 'phrase:shut up') AS only_shut_up, string_agg(hit, '|' ORDER BY ord) AS hit_names
    FROM rh JOIN rul USING (ord) GROUP BY id),
v1 AS (SELECT s.*, p.context_size, p.echoes, CASE WHEN p.echoes >= 2 THEN least(0.58e0 + 0.10e0 * p.echoes, 0.82e0) ELSE 0e0 END AS pile_on_score,
    coalesce(r.n, 0) AS rules_n, r.cats AS rule_cats, coalesce(r.only_shut_up, true) AS only_shut_up, r.sure AS rule_sure,
    greatest(coalesce(r.hard, 0e0), CASE WHEN bare_command THEN 0.92e0 ELSE 0e0 END, slur_score) AS hard, coalesce(r.soft, 0e0) AS rule_soft
    FROM sig3 s JOIN pile p USING (id) LEFT JOIN rr r USING (id)),
v2 AS (SELECT *, greatest(rule_soft, insult_score, exclusion_score, backhanded_score, mockery_score, pile_on_score) AS soft_raw FROM v1),
v3 AS (SELECT *, soft_raw >= 0.45e0 AND rules_n = 0 AND NOT bare_command AND affection AS affectionate FROM v2),
v4 AS (SELECT *, CASE WHEN affectionate THEN greatest(soft_raw - 0.30e0, 0.3e0) ELSE soft_raw END AS soft FROM v3),
v5 AS (SELECT *, quoting AND greatest(hard, soft) > 0 AS quoted FROM v4),
v6 AS (SELECT *, greatest(CASE WHEN quoted THEN greatest(hard, soft) * 0.4e0 ELSE greatest(hard, soft) END, content_score) AS raw_score,
    second OR rules_n > 0 OR bare_command OR insult_aimed AS addressed,
    rules_n > 0 OR bare_command OR len(slur_words) > 0 OR insults_n > 0 OR content_score > 0 OR exclusion_n > 0 OR pointed_n > 0
        OR mockery_n > 0 OR pile_on_score > 0 OR affectionate OR quoted AS any_hit,
    (rules_n = 0 OR only_shut_up) AND NOT bare_command AND len(slur_words) = 0 AND insults_n = 0
        AND (content_score = 0 OR content_score = 0.86e0) AND exclusion_n = 0 AND pointed_n = 0 AND mockery_n = 0 AND pile_on_score = 0
        AND NOT affectionate AND NOT quoted AND NOT distress AS weak_only,
    list_sort(list_distinct(list_filter(string_split(coalesce(rule_cats, ''), ',') || [
        CASE WHEN bare_command THEN 'harassment' END, CASE WHEN bare_command THEN 'threat' END,
        CASE WHEN len(slur_words) > 0 THEN 'slur' END, CASE WHEN strong_n + mild_n + third_n > 0 THEN 'insult' END, content_category,
        CASE WHEN exclusion_n > 0 THEN 'exclusion' END, CASE WHEN pointed_n > 0 THEN 'backhanded' END,
        CASE WHEN mockery_n > 0 THEN 'sarcasm' END, CASE WHEN pile_on_score > 0 THEN 'pileOn' END], lambda c: c IS NOT NULL AND c <> ''))) AS categories,
    greatest(0.45e0, coalesce(rule_sure, 0e0), CASE WHEN len(slur_words) > 0 THEN 0.9e0 ELSE 0e0 END, CASE WHEN insult_score >= 0.5e0 THEN 0.8e0 ELSE 0e0 END,
        CASE WHEN content_score > 0 THEN 0.95e0 ELSE 0e0 END, CASE WHEN exclusion_n > 0 THEN 0.6e0 ELSE 0e0 END,
        CASE WHEN pile_on_score > 0 THEN 0.70e0 ELSE 0e0 END) AS sure
    FROM v5),
v7 AS (SELECT *, CASE WHEN len(canonical) = 0 OR raw_score >= 0.85e0 THEN 0e0 ELSE least(CASE WHEN second THEN 0.22e0 ELSE 0e0 END + least(0.30e0, 0.16e0 * sarcasm_n)
    + least(0.22e0, 0.12e0 * judging) + CASE WHEN pointed_n + backhanded_n > 0 THEN 0.30e0 ELSE 0e0 END
    + CASE WHEN exclusion_n > 0 THEN 0.18e0 ELSE 0e0 END + CASE WHEN mockery_n > 0 THEN 0.18e0 ELSE 0e0 END + least(0.40e0, 0.22e0 * veiled_n)
    + CASE WHEN context_size > 0 THEN 0.08e0 ELSE 0e0 END + CASE WHEN context_size >= 2 THEN 0.06e0 ELSE 0e0 END
    + CASE WHEN ends_with(plain, '...') OR contains(plain, ' lol') THEN 0.10e0 ELSE 0e0 END, 1e0) END AS ambiguity,
    distress AND first AND NOT second AS self_directed FROM v6),
v8 AS (SELECT *, raw_score < 0.2e0 AND NOT any_hit AND NOT second AND ambiguity < 0.15e0 AND len(canonical) <= 40 AND NOT addressed AS trivial,
    self_directed AND NOT list_has_any(categories, ['threat', 'slur', 'explicit']) AS own_pain FROM v7),
t0 AS (SELECT *, CASE WHEN own_pain THEN least(raw_score, 0.15e0) ELSE raw_score END AS score,
    CASE WHEN len(canonical) = 0 THEN 1e0 WHEN own_pain THEN 0.9e0 WHEN quoted THEN least(sure, 0.5e0) ELSE sure END AS confidence FROM v8)"""


def tier0_ctes(source: str = "msg", text: str = "text", context: bool = False) -> str:
    """t0: the rule tier's verdict over a CTE with id and text (and conv_id, seq for context)."""
    return ",\n".join([norm_ctes(source, text), PHRASES, rule_ctes(), AIM, SIGNALS, PILE if context else NO_PILE, COMPOSE])


LOCAL = f"""
lv1 AS (SELECT t0.*, self_directed OR trivial OR score >= 0.85e0 AS decided, l10.model_score AS m FROM t0 JOIN l10 USING (id)),
lv2 AS (SELECT * EXCLUDE (m), CASE WHEN decided THEN 0e0 ELSE m END AS model_score, NOT decided AND NOT affectionate AND NOT quoted
    AND addressed AND m >= 0.90e0 AND NOT weak_only AND score >= 0.35e0 AND score < 0.66e0 AS pushed FROM lv1),
lv3 AS (SELECT *, least(least(1e0, abs(model_score - 0.5e0) * 2e0), 0.5e0) AS model_sure FROM lv2),
local AS (SELECT * REPLACE (CASE WHEN pushed THEN 0.66e0 ELSE score END AS score,
    CASE WHEN decided THEN confidence WHEN pushed THEN greatest(confidence, model_sure) ELSE greatest(confidence, model_sure * 0.8e0) END AS confidence,
    CASE WHEN pushed AND len(categories) = 0 THEN ['insult'] ELSE categories END AS categories),
    CASE WHEN pushed THEN 'on_device' ELSE 'rules' END AS tier FROM lv3)"""


def local_ctes(source: str = "msg", text: str = "text", context: bool = False) -> str:
    return ",\n".join([tier0_ctes(source, text, context), L10, LOCAL])


def held(sensitivity: str, score: str = "score") -> str:
    _, threshold, minimum = next(s for s in SENSITIVITIES if s[0] == sensitivity)
    floor = "0.70e0" if minimum == 2 else "0.35e0"
    return f"(NOT self_directed AND {score} >= {floor} AND {score} >= {threshold}e0)"


CATS = "array_to_string(categories, ',')"
PRIMARY = f"list_filter({arr(CATEGORY_ORDER)}, lambda c: list_contains(categories, c))[1]"
REASON = ("CASE " + " ".join(f"WHEN {PRIMARY} = {q(c)} THEN {q(t)}" for c, t in REASONS.items())
          + f" WHEN {PRIMARY} IS NOT NULL THEN {q(DEFAULT_REASON)} END")
REFUSED = " OR ".join(f"contains(lower(clean), {q(r)})" for r in REFUSALS)
