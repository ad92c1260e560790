"""SQL that says the same as registered queries, for DuckDB.

DuckDB has no NFKC, so the compatibility forms are replaced by rule: single characters by a translation
built from the Unicode tables, the common longer ones by replacement.
"""

from __future__ import annotations

import string
import unicodedata

from pageloom.functions.text import PROMPT_HEAD, REFUSALS, normalize_phrase
from pageloom.operators.chunking import ABBREVIATIONS
from pageloom.operators.validation import ANSWERABLE, LONGEST_SENTENCE, SPLITS, TAGS, UNANSWERABLE

SPACES = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def nfkc(column: str) -> str:
    """A string column in NFKC, for characters of the first plane below the ideographs and the width forms."""
    single, long = {}, {}
    for point in (*range(0xA0, 0x3400), *range(0xFB00, 0xFB07), *range(0xFE30, 0xFF00), *range(0xFF00, 0xFFF0)):
        char = chr(point)
        plain = unicodedata.normalize("NFKC", char)
        if plain != char and unicodedata.decomposition(char).startswith("<"):
            (single if len(plain) == 1 else long)[char] = plain
    sql = f"translate({column}, {_quote(''.join(single))}, {_quote(''.join(single.values()))})"
    for char in "ﬀﬁﬂﬃﬄﬅﬆ℃℉…‥ำ№™":
        sql = f"replace({sql}, {_quote(char)}, {_quote(unicodedata.normalize('NFKC', char))})"
    return f"nfc_normalize({sql})"


def collapse(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '{SPACES}+', ' ', 'g'))"


def clean(column: str) -> str:
    joined = f"regexp_replace({nfkc(column)}, '([A-Za-z])[-\\x{{AD}}]{SPACES}*\\n{SPACES}*([a-z])', '\\1\\2', 'g')"
    return collapse(f"regexp_replace({joined}, '[\\x00-\\x08\\x0e-\\x1f\\x7f\\x{{AD}}\\x{{200B}}\\x{{FEFF}}]', '', 'g')")


def normal(column: str) -> str:
    """normalize_answer; articles are dropped word by word because \\b knows ASCII only."""
    bare = collapse(f"translate(lower({column}), {_quote(string.punctuation)}, '')")
    return f"array_to_string(list_filter(string_split({bare}, ' '), lambda t: t NOT IN ('a', 'an', 'the', '')), ' ')"


def tokens(column: str) -> str:
    return f"list_filter(string_split({normal(column)}, ' '), lambda t: t <> '')"


def packed(name: str, key: str, lists: str, overlap: int, size: int = 1000) -> str:
    """CTE ``name`` (key, k, first, stop): runs of a list's units of at most ``size`` characters, each beginning within the ``overlap`` of the one before.

    ``lists`` is a table of the key, the units ``u`` and ``e``, the lengths of all beginnings with a blank after each unit.
    """
    stop = f"coalesce(list_min(list_filter(range({{0}} + 1, len(u)), lambda i: e[i + 2] - e[{{0}} + 1] - 1 > {size})), len(u))".format
    begin = f"coalesce(list_min(list_filter(range(first, stop), lambda s: e[stop + 1] - e[s + 1] - 1 <= {overlap} AND e[stop + 2] - e[s + 1] - 1 <= {size})), stop)"
    return f"""{name} AS (SELECT {key}, u, e, 0 AS k, 0::BIGINT AS first, {stop('0')} AS stop FROM {lists} UNION ALL
        SELECT {key}, u, e, k + 1, n, {stop('n')} FROM (SELECT *, {begin} AS n FROM {name} WHERE stop < len(u)))"""


def wrapped(name: str, size: int = 1000) -> str:
    """CTE ``name`` (page_id, sentence_index, k, line, rest): lines from 1 of sentences above the size, cut between words; a longer word fills its line and is cut."""
    last = f"({size} - strpos(reverse(left(rest, {size})), ' ') + 1) * (strpos(left(rest, {size}), ' ') > 0)::INT"
    cut = f"CASE WHEN length(rest) <= {size} THEN length(rest) WHEN substr(rest, {size + 1}, 1) = ' ' OR length(regexp_extract(substr(rest, {last} + 1), '^[^ ]*')) > {size} THEN {size} ELSE {last} END"
    return f"""{name} AS (SELECT page_id, sentence_index, 0 AS k, '' AS line, sentence AS rest FROM sentences WHERE length(sentence) > {size}
        UNION ALL SELECT page_id, sentence_index, k + 1, rtrim(left(rest, cut)), ltrim(substr(rest, cut + 1)) FROM (SELECT *, ({cut})::INT AS cut FROM {name} WHERE rest <> ''))"""


LENGTHS = "list_transform(range(len(u) + 1), lambda i: coalesce(list_sum(list_transform(u[:i], lambda x: length(x) + 1)), 0))"


def embedded(name: str, key: str, rows: str) -> str:
    """CTE ``name`` (key, b, v): the non-zero numbers of the hashed vectors of ``rows`` (key, text), of unit length in single precision and again in double."""
    return f"""{name}_w AS (SELECT {key}, ('0x' || left(md5(w), 8))::UBIGINT AS code FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {rows})),
        {name}_c AS (SELECT {key}, code % 256 AS b, sum(CASE WHEN code >= 2147483648 THEN 1 ELSE -1 END) AS c FROM {name}_w GROUP BY ALL HAVING c <> 0),
        {name}_f AS (SELECT {key}, b, (sign(c) * ln(1 + abs(c)) / sqrt(sum(ln(1 + abs(c)) ** 2) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS v FROM {name}_c),
        {name} AS (SELECT {key}, b, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM {name}_f)"""


def split(prefix: str, key: str, rows: str) -> str:
    """CTE ``prefix`` (key, sentence_index, sentence) of the sentences of ``rows`` (key, t): split at boundaries, pieces after an abbreviation joined again."""
    abbreviations = ", ".join(map(_quote, ABBREVIATIONS))
    return f"""{prefix}_x AS (SELECT *, string_split(regexp_replace(t, '([.!?]["''”’)\\]]?) +(["''“‘(\\[]?[A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM {rows} WHERE t <> ''),
        {prefix}_y AS (SELECT {key}, generate_subscripts(l, 1) AS i, unnest(l) AS piece FROM {prefix}_x),
        {prefix}_z AS (SELECT *, lower(ltrim(regexp_extract(piece, '([^ ]+)\\.$', 1), '"''“‘([')) AS w FROM {prefix}_y),
        {prefix}_a AS (SELECT *, coalesce(lag(piece LIKE '%.' AND (w IN ({abbreviations}) OR regexp_matches(w, '^(\\p{{Nd}}+|\\p{{L}})$'))) OVER (PARTITION BY {key} ORDER BY i), FALSE) AS goes_on FROM {prefix}_z),
        {prefix}_b AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY i) AS k FROM {prefix}_a),
        {prefix} AS (SELECT {key}, (k - 1)::INT AS sentence_index, string_agg(piece, ' ' ORDER BY i) AS sentence FROM {prefix}_b GROUP BY {key}, k)"""


def evaluated(searched: str, passages: str, refused: str, holds) -> str:
    """A whole run with the stand-in embedder and reader, from CTEs of the searched index and the passages."""
    words = lambda text: f"list_distinct(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'))"
    return f"""WITH RECURSIVE {passages}, {searched},
        re AS (SELECT p.id, p.passage_index, ck.position, ck.chunk_id, ck.chunk_index FROM p JOIN ck ON ck.file = p.file AND ck.page = p.page AND passage <> '' AND contains(ck.text, passage)),
        mk AS (SELECT p.id, p.passage_index, min(rank) AS rank FROM p LEFT JOIN (SELECT re.id, re.passage_index, rk.rank FROM re JOIN rk ON rk.id = re.id AND rk.position = re.position) h ON h.id = p.id AND h.passage_index = p.passage_index GROUP BY ALL),
        me AS (SELECT id, bool_and(rank IS NOT NULL) AS retrieved, bool_or(coalesce(rank <= 5, FALSE)) AS hit FROM mk GROUP BY id),
        go AS (SELECT p.id, p.passage_index, b.position FROM p LEFT JOIN (SELECT id, passage_index, arg_min(position, (chunk_index, chunk_id, position)) AS position FROM re GROUP BY ALL) b USING (id, passage_index)),
        gf AS (SELECT id, bool_or(position IS NULL) AS failed FROM go GROUP BY id),
        ct AS (SELECT go.id, 'gold_context' AS mode, position, min(passage_index) AS place FROM go JOIN gf USING (id) WHERE NOT failed GROUP BY ALL UNION ALL SELECT id, 'retrieved_context', position, rank FROM rk),
        tk AS (SELECT id, question, answerable, category, answers, coalesce(list_items, []) AS list_items, unnest(CASE WHEN answerable THEN ['gold_context', 'retrieved_context'] ELSE ['retrieved_context'] END) AS mode FROM questions),
        us AS (SELECT DISTINCT position, text AS t FROM ck WHERE position IN (SELECT position FROM ct)), {split('cs', 'position', 'us')}, sw AS (SELECT *, {words('sentence')} AS ws FROM cs), qw AS (SELECT id, {words('question')} AS ws FROM questions),
        sr AS (SELECT ct.id, ct.mode, sentence, len(list_filter(qw.ws, lambda x: list_contains(sw.ws, x))) AS score, place, sentence_index FROM ct JOIN qw USING (id) JOIN sw USING (position)),
        be AS (SELECT id, mode, arg_min(array_to_string(string_split(sentence, ' ')[:30], ' '), (-score, place, sentence_index)) AS prediction FROM sr WHERE score > 0 GROUP BY ALL),
        r0 AS (SELECT tk.*, be.prediction, NOT EXISTS (SELECT 1 FROM ct WHERE ct.id = tk.id AND ct.mode = tk.mode) AS failed FROM tk LEFT JOIN be USING (id, mode)),
        r1 AS (SELECT *, NOT failed AND {refused} AS declined, CASE WHEN {refused} THEN '' ELSE {normal('prediction')} END AS n FROM r0),
        r2 AS (SELECT *, CASE WHEN NOT failed AND answerable THEN CASE WHEN category = 'list' THEN len(list_items) > 0 AND len(list_filter(list_items, lambda a: {holds(normal('a'), 'n')})) = len(list_items)
            ELSE list_bool_or(list_transform(answers, lambda a: {holds(normal('a'), 'n')})) END END AS correct FROM r1),
        pu AS (SELECT p.id, bool_and(EXISTS (SELECT 1 FROM re JOIN ct ON ct.id = re.id AND ct.mode = 'retrieved_context' JOIN ck ON ck.position = ct.position AND ck.chunk_id = re.chunk_id WHERE re.id = p.id AND re.passage_index = p.passage_index)) AS used FROM p GROUP BY p.id),
        j AS (SELECT q.id, q.answerable, tp.top >= 0.3 AS supported, me.hit, coalesce(me.retrieved, TRUE) AS retrieved, coalesce(pu.used, TRUE) AS used, f.failed, f.declined, f.correct, g2.id IS NOT NULL AND NOT g2.failed AS gold_there, g2.correct AS gold_correct
            FROM questions q JOIN (SELECT id, max(score) AS top FROM rk GROUP BY id) tp ON tp.id = q.id JOIN r2 f ON f.id = q.id AND f.mode = 'retrieved_context' LEFT JOIN r2 g2 ON g2.id = q.id AND g2.mode = 'gold_context' LEFT JOIN me ON me.id = q.id LEFT JOIN pu ON pu.id = q.id),
        o AS (SELECT *, CASE WHEN NOT supported THEN 'refused_by_router' WHEN failed THEN 'error' WHEN declined THEN 'refused_by_reader' ELSE 'answered' END AS outcome FROM j),
        d AS (SELECT *, CASE WHEN outcome = 'error' THEN NULL WHEN outcome = 'answered' THEN answerable AND coalesce(correct, FALSE) ELSE NOT answerable END AS "right" FROM o)
        SELECT id, CASE WHEN supported THEN 'supported' ELSE 'below_threshold' END AS status, CASE WHEN answerable THEN hit END AS hit_any_at_5, outcome, CASE WHEN outcome = 'error' THEN 'error' WHEN NOT answerable THEN CASE WHEN outcome = 'answered' THEN 'false_accept' ELSE outcome END
        WHEN "right" THEN 'correct' WHEN NOT retrieved THEN 'retrieval_miss' WHEN NOT supported THEN 'router_reject' WHEN NOT used THEN 'context_dropped' WHEN NOT gold_there THEN 'error' WHEN coalesce(gold_correct, FALSE) THEN 'reader_distracted' ELSE 'reader_error' END AS diagnosis FROM d"""


def problems(passages: str, pages: str, pieces: str) -> str:
    """The rules of the dataset as SQL."""
    known = lambda values: ", ".join(map(_quote, values))
    listed = "'[''' || array_to_string({0}, ''', ''') || ''']'".format
    quoted = "'''' || coalesce({0}::VARCHAR, 'None') || ''''".format
    kept = lambda *pairs: "list_filter([" + ", ".join(f"CASE WHEN {test} THEN {message} END" for test, message in pairs) + "], lambda x: x IS NOT NULL)"
    clean_list = lambda column: f"list_transform({column}, lambda x: {clean('coalesce(x, chr(32))')})"
    blank = lambda column: f"regexp_replace({column}, '{SPACES}', '', 'g') = ''"
    one = kept(
        ("n > 1", "'evidence occurs ' || n || ' times in the corpus, so retrieval hits would be ambiguous: ' || " + quoted("passage")),
        ("held = 0", "'evidence spans more than one sentence: ' || " + quoted("passage")),
        (f"shortest > {LONGEST_SENTENCE}", f"'evidence is in a sentence longer than {LONGEST_SENTENCE} characters: ' || " + quoted("passage")),
    )
    head = kept(
        (blank("coalesce(question, '')"), "'question is empty'"),
        (f"split IS NULL OR split NOT IN ({known(SPLITS)})", "'unknown split ' || " + quoted("split")),
        ("len(odd) > 0", "'unknown failure tags ' || " + listed("odd")),
        ("len(list_distinct(failure_tags)) < len(failure_tags)", "'repeated failure tags'"),
    )
    refusing = kept(
        ("answerable IS DISTINCT FROM FALSE", "'category ' || category || ' requires answerable=false'"),
        ("len(answers) + len(evidence) + len(list_items) > 0", "'unanswerable questions must have no answers, evidence or list_items'"),
    )
    middle = kept(
        ("answerable IS DISTINCT FROM TRUE", "'category ' || category || ' requires answerable=true'"),
        (f"len(answers) = 0 OR list_bool_or(list_transform(answers, lambda x: {blank('x')}))", "'answerable questions need non-empty answers'"),
        ("len(evidence) = 0", "'answerable questions need evidence'"),
    )
    tail = kept(
        ("category = 'yes_no' AND NOT (len(answers) = 1 AND coalesce(answers[1] IN ('yes', 'no'), FALSE))", "'yes_no answers must be [\"yes\"] or [\"no\"]'"),
        ("category <> 'yes_no' AND len(answers) > 0 AND NOT list_contains(failure_tags, 'requires_reasoning') AND NOT contains(together, lower(clean_answers[1]))", "'first answer ' || " + quoted("answers[1]") + " || ' does not appear in the evidence'"),
        ("category = 'list' AND len(list_items) < 2", "'list questions need at least two list_items'"),
        ("category = 'list' AND len(missing) > 0", "'list_items not in the evidence: ' || " + listed("missing")),
        ("category <> 'list' AND len(list_items) > 0", "'only list questions may have list_items'"),
        ("category = 'multi_section' AND len(evidence) < 2", "'multi_section questions need at least two evidence passages'"),
    )
    strip = f"lower(regexp_replace(question, '^{SPACES}+|{SPACES}+$', '', 'g'))"
    return f"""WITH {passages}, {pages}, {pieces}, d AS (SELECT DISTINCT passage FROM p WHERE passage <> ''),
        oc AS (SELECT passage, sum((length(t) - length(replace(t, passage, ''))) // length(passage))::BIGINT AS n FROM d JOIN g ON contains(t, passage) GROUP BY passage),
        hs AS (SELECT p.id, p.passage_index, count(sentence) AS held, min(length(sentence)) AS shortest FROM p JOIN g USING (file, page) JOIN sentences s ON s.page_id = g.page_id AND contains(sentence, passage) GROUP BY ALL),
        pm AS (SELECT p.id, p.passage_index, CASE WHEN k.file IS NULL THEN ['evidence source ' || {quoted('p.file')} || ' is not in the corpus'] WHEN g.t IS NULL THEN [p.file || ' has no page ' || coalesce(p.page::VARCHAR, 'None')]
            WHEN coalesce(p.passage, '') = '' THEN ['evidence text is empty'] WHEN NOT contains(g.t, p.passage) THEN ['evidence not found on ' || p.file || ' page ' || p.page || ': ' || {quoted('p.passage')}]
            ELSE {one.replace('passage', 'p.passage').replace('held = 0', 'coalesce(held, 0) = 0')} END AS m
            FROM p LEFT JOIN (SELECT DISTINCT file FROM g) k ON k.file = p.file LEFT JOIN g ON g.file = p.file AND g.page = p.page LEFT JOIN oc ON oc.passage = p.passage LEFT JOIN hs ON hs.id = p.id AND hs.passage_index = p.passage_index),
        em AS (SELECT id, flatten(list(m ORDER BY passage_index)) AS em FROM pm GROUP BY id),
        q0 AS (SELECT * REPLACE (coalesce(answers, []) AS answers, coalesce(evidence, []) AS evidence, coalesce(failure_tags, []) AS failure_tags, coalesce(list_items, []) AS list_items) FROM questions),
        q1 AS (SELECT *, list_sort(list_distinct(list_filter(failure_tags, lambda x: x NOT IN ({known(TAGS)})))) AS odd, lower(array_to_string({clean_list("list_transform(evidence, lambda y: y.text)")}, ' ')) AS together,
            {clean_list('answers')} AS clean_answers, {clean_list('list_items')} AS clean_items FROM q0),
        q2 AS (SELECT *, list_filter(clean_items, lambda x: NOT contains(together, lower(x))) AS missing FROM q1),
        q3 AS (SELECT q2.id, CASE WHEN category IN ({known(UNANSWERABLE)}) THEN list_concat({head}, {refusing}) WHEN category IS NULL OR category NOT IN ({known(ANSWERABLE)}) THEN list_concat({head}, ['unknown category ' || {quoted('category')}])
            ELSE list_concat(list_concat({head}, {middle}), list_concat(coalesce(em, []), {tail})) END AS m FROM q2 LEFT JOIN em ON em.id = q2.id)
        SELECT 0 AS part, id, 0 AS ordinal, id || ': duplicate id' AS message FROM questions GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 1, NULL, 0, 'duplicate question ''' || {strip} || '''' FROM questions WHERE question IS NOT NULL GROUP BY {strip} HAVING count(*) > 1
        UNION ALL SELECT 2, id, (generate_subscripts(m, 1) - 1)::INT, id || ': ' || unnest(m) FROM q3"""


def statements() -> dict[str, str]:
    """SQL by query name."""
    name = "regexp_extract({0}, '[^/]*$')".format
    refusals = ", ".join(_quote(normalize_phrase(x)) for x in REFUSALS)
    records = "r AS (SELECT DISTINCT * FROM reader_records)"
    refused = f"(prediction IS NULL OR {normal('prediction')} = '' OR {normal('prediction')} IN ({refusals}))"
    holds = "({0} <> '' AND contains(' ' || {1} || ' ', ' ' || {0} || ' '))".format
    scored = f"""{records}, s AS (SELECT r.*, q.answerable, q.category, q.answers, q.list_items, r.error IS NULL AND {refused} AS declines,
        CASE WHEN {refused} THEN '' ELSE {normal('prediction')} END AS p FROM r JOIN questions q ON q.id = r.question_id),
        m AS (SELECT s.* EXCLUDE (token_f1, refused), declines AS refused,
        CASE WHEN error IS NULL AND answerable THEN list_bool_or(list_transform(answers, lambda a: {normal('a')} = p)) END AS exact_match,
        CASE WHEN error IS NULL AND answerable THEN list_bool_or(list_transform(answers, lambda a: {holds(normal('a'), 'p')})) END AS answer_containment,
        CASE WHEN error IS NULL AND answerable AND category = 'list' AND len(list_items) > 0 THEN len(list_filter(list_items, lambda a: {holds(normal('a'), 'p')})) / len(list_items)::DOUBLE END AS list_item_recall,
        list_filter(string_split(p, ' '), lambda t: t <> '') AS pt FROM s),
        f AS (SELECT m.*, CASE WHEN error IS NULL AND answerable THEN list_max(list_transform(list_transform(answers, lambda a: {tokens('a')}), lambda a: CASE WHEN len(a) = 0 AND len(pt) = 0 THEN 1.0 WHEN len(a) = 0 OR len(pt) = 0 THEN 0.0
            ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(pt), lambda t: least(len(list_filter(pt, lambda x: x = t)), len(list_filter(a, lambda x: x = t))))), 0) / (len(a) + len(pt)) END)) END AS answer_f1,
        CASE WHEN error IS NULL AND answerable THEN CASE WHEN category = 'list' THEN list_item_recall = 1.0 ELSE answer_containment END END AS correct FROM m)"""
    passages = f"""e AS (SELECT id, generate_subscripts(evidence, 1) - 1 AS passage_index, unnest(evidence) AS e FROM questions),
        p AS (SELECT id, passage_index::INT AS passage_index, e.source AS file, e.page AS page, {clean('e.text')} AS passage FROM e)"""
    pages = f"g AS (SELECT page_id, source, {name('source')} AS file, page_number AS page, {clean('text')} AS t FROM page_data)"
    chunks = f"c AS (SELECT chunk_row_id, chunk_id, chunk_index, {name('source')} AS file, page_number AS page, {clean('text')} AS t FROM document_chunks)"
    pieces = f"{split('st', 'page_id', 'g')}, sentences AS (SELECT page_id, file, page, t, sentence_index, sentence FROM st JOIN g USING (page_id))"
    chunked = f"""{pieces}, {wrapped('lr')},
        un AS (SELECT page_id, sentence_index, 0 AS k, sentence AS unit FROM sentences WHERE length(sentence) <= 1000 UNION ALL SELECT page_id, sentence_index, k, line FROM lr WHERE k > 0),
        ul AS (SELECT page_id, list(unit ORDER BY sentence_index, k) AS u FROM un GROUP BY page_id), ue AS (SELECT *, {LENGTHS} AS e FROM ul), {packed('cr', 'page_id', 'ue', 200)},
        ch AS (SELECT g.page_id, source, file, page, k AS chunk_index, file || ':p' || page || ':c' || k AS chunk_id, array_to_string(u[first + 1:stop], ' ') AS text FROM cr JOIN g USING (page_id))"""
    searched = f"""{chunked}, ck AS (SELECT *, row_number() OVER (ORDER BY page_id, chunk_index) AS position FROM ch), qt AS (SELECT id, question AS text FROM questions), {embedded('cv', 'position', 'ck')}, {embedded('qv', 'id', 'qt')},
        sc AS (SELECT qv.id, cv.position, round(sum(qv.v * cv.v), 12) AS score FROM qv JOIN cv USING (b) GROUP BY ALL),
        rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, position) AS rank, max(score) OVER (PARTITION BY id) AS top FROM sc QUALIFY rank <= 5), rr AS (SELECT rk.*, ck.* EXCLUDE (position) FROM rk JOIN ck USING (position))"""
    located = f"""{searched}, mr AS (SELECT p.id, p.passage_index, min(rank) AS rank FROM p LEFT JOIN rr ON rr.id = p.id AND rr.file = p.file AND rr.page = p.page AND passage <> '' AND contains(rr.text, passage) GROUP BY ALL),
        mt AS (SELECT id, array_to_string(list(coalesce(rank::VARCHAR, '-') ORDER BY passage_index), ',') AS ranks, {", ".join(f"bool_{how}(coalesce(rank <= {k}, FALSE)) AS hit_{kind}_at_{k}" for k in (1, 3, 5) for kind, how in (("any", "or"), ("all", "and")))}, coalesce(1.0 / min(rank), 0.0) AS rr FROM mr GROUP BY id)"""
    latest = f"g AS (SELECT max(page_id) AS page_id, {name('source')} AS file, page_number AS page, {clean("arg_max(coalesce(text, ''), page_id)")} AS t FROM page_data GROUP BY 2, 3)"
    ranked = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM v),
        s AS (SELECT q.vec_id AS query, n.vec_id AS position, q.label AS wanted, n.label AS got, list_dot_product(q.v, n.v) AS score FROM n JOIN n q ON q.vec_id % 20 = 0 AND q.vec_id <> n.vec_id),
        o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, position) AS rank FROM s)"""
    return {
        "chunk_pages": f"WITH RECURSIVE {pages}, {chunked} SELECT source, page AS page_number, page_id, chunk_index, text, chunk_id FROM ch",
        "chunk_counts": f"WITH RECURSIVE {pages}, {chunked} SELECT file, count(*) AS chunks, count(DISTINCT page) AS pages, max(length(text))::INT AS longest FROM ch GROUP BY file",
        "flagship": f"WITH RECURSIVE {pages}, {searched} SELECT id, CASE WHEN top >= 0.3 THEN 'supported' ELSE 'below_threshold' END AS status, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM rr",
        "question_routes": f"""WITH RECURSIVE {pages}, {searched} SELECT id, CASE WHEN top >= 0.3 THEN 'supported' ELSE 'below_threshold' END AS status, top >= 0.3 AS supported,
            'Top similarity ' || printf('%.3f', top) || CASE WHEN top >= 0.3 THEN ' meets the threshold of 0.300.' ELSE ' is below the threshold of 0.300, so the documents most likely do not cover this question.' END AS reason FROM rr WHERE rank = 1""",
        "retrieval_records": f"WITH RECURSIVE {pages}, {passages}, {located} SELECT * EXCLUDE (rr), round(rr, 6) AS reciprocal_rank FROM mt",
        "mean_reciprocal_ranks": f"WITH RECURSIVE {pages}, {passages}, {located} SELECT split, category, count(*) AS n, round(avg(mt.rr), 6) AS mrr FROM mt JOIN questions q USING (id) WHERE answerable GROUP BY ALL",
        "gold_prompts": f"""WITH {passages}, {chunks}, h AS (SELECT id, passage_index, arg_min(chunk_row_id, (chunk_index, chunk_row_id)) AS chunk FROM p JOIN c USING (file, page) WHERE passage <> '' AND contains(t, passage) GROUP BY ALL),
            o AS (SELECT p.id, p.passage_index, chunk FROM p LEFT JOIN h USING (id, passage_index)), d AS (SELECT id, chunk, min(passage_index) AS i FROM o GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS place FROM d),
            x AS (SELECT n.id, bool_or(n.chunk IS NULL) AS failed, string_agg('[' || place || '] ' || t, chr(10) || chr(10) ORDER BY place) AS context FROM n LEFT JOIN c ON c.chunk_row_id = n.chunk GROUP BY n.id)
            SELECT id, {_quote(PROMPT_HEAD)} || context || chr(10) || chr(10) || 'Question: ' || regexp_replace(question, '^{SPACES}+|{SPACES}+$', '', 'g') || chr(10) || 'Answer:' AS prompt FROM x JOIN questions USING (id) WHERE NOT failed""",
        "evaluation_run": evaluated(f"g AS (SELECT max(page_id) AS page_id, source, {name('source')} AS file, page_number AS page, {clean('arg_max(text, page_id)')} AS t FROM page_data WHERE text IS NOT NULL GROUP BY source, page_number), "
            + searched.replace("ORDER BY page_id, chunk_index) AS position", "ORDER BY source, page, chunk_index) AS position"), passages, refused, holds),
        "split_counts": "SELECT split, count(*) AS n FROM questions GROUP BY split",
        "dataset_problems": problems(passages, latest, pieces),
        "clean_pages": f"SELECT page_id, {clean('text')} AS clean FROM page_data",
        "page_sentences": f"WITH {pages}, {pieces} SELECT page_id, sentence_index, sentence FROM sentences",
        "chunk_ids": f"SELECT chunk_row_id, {name('source')} || ':p' || page_number || ':c' || chunk_index AS made_id FROM document_chunks",
        "normalized_predictions": f"WITH {records} SELECT question_id, reader, mode, {normal('prediction')} AS normalized, coalesce(len({tokens('prediction')}), 0)::INT AS n_tokens FROM r",
        "answer_metrics": f"WITH {scored} SELECT question_id, reader, mode, finished_at, exact_match, round(answer_f1, 6) AS answer_f1, answer_containment, round(list_item_recall, 6) AS list_item_recall, correct FROM f",
        "refusals": f"""WITH {records} SELECT question_id, reader, mode, finished_at, {refused} AS declines,
            lower(trim(regexp_replace(prediction, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'))) IN ('', 'not available', 'unanswerable') AS not_available FROM r""",
        "lexical_support": f"""WITH {records}, k AS (SELECT r.*, {tokens('prediction')} AS w, list_distinct(flatten(list_transform(list_filter(list_transform(q.evidence, lambda x: x.text), lambda x: x IS NOT NULL), lambda x: {tokens('x')}))) AS known
            FROM r JOIN questions q ON q.id = r.question_id WHERE prediction IS NOT NULL)
            SELECT question_id, reader, mode, finished_at, CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda t: list_contains(known, t))) / len(w)::DOUBLE, 6) END AS support FROM k""",
        "error_rates": f"""WITH {scored} SELECT reader, mode, round(avg(refused::INT), 6) AS refusal_rate, round(avg(refused::INT) FILTER (answerable), 6) AS false_refusal_rate,
            round(avg((NOT refused)::INT) FILTER (NOT answerable), 6) AS false_accept_rate FROM f WHERE error IS NULL GROUP BY ALL""",
        "auroc": f"""WITH {records}, j AS (SELECT r.mode, confidence, answerable FROM r JOIN questions q ON q.id = r.question_id WHERE confidence IS NOT NULL AND NOT isnan(confidence) AND answerable IS NOT NULL)
            SELECT a.mode, round(avg(CASE WHEN a.confidence > b.confidence THEN 1.0 WHEN a.confidence = b.confidence THEN 0.5 ELSE 0.0 END), 6) AS auroc FROM j a JOIN j b ON a.mode = b.mode AND a.answerable AND NOT b.answerable GROUP BY a.mode""",
        "correct_by_category": f"WITH {scored} SELECT category, reader, mode, count(*) AS n, round(avg(correct::INT), 6) AS correct_rate FROM f WHERE error IS NULL AND answerable GROUP BY ALL",
        "vector_top_k": f"WITH {ranked} SELECT query, position, round(score, 5) AS score, rank::INT AS rank FROM o WHERE rank <= 5",
        "vector_routes": f"WITH {ranked} SELECT query, CASE WHEN score >= 0.5 THEN 'supported' ELSE 'below_threshold' END AS status, score >= 0.5 AS supported, round(score, 5) AS top_score FROM o WHERE rank = 1",
        "label_retrieval": f"""WITH {ranked}, h AS (SELECT query, min(rank) FILTER (wanted = got AND rank <= 5) AS best FROM o GROUP BY query)
            SELECT query AS id, coalesce(best <= 1, FALSE) AS hit_any_at_1, coalesce(best <= 3, FALSE) AS hit_any_at_3, coalesce(best <= 5, FALSE) AS hit_any_at_5, round(coalesce(1.0 / best, 0.0), 6) AS reciprocal_rank FROM h""",
        "best_spans": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: (x * 10)::FLOAT::DOUBLE) AS s, list_transform(list_concat(embedding[18:], embedding[:17]), lambda x: (x * 10)::FLOAT::DOUBLE) AS e FROM embeddings),
            x AS (SELECT vec_id, list_transform(s, lambda y: exp(y - list_max(s))) AS s, list_transform(e, lambda y: exp(y - list_max(e))) AS e FROM v),
            n AS (SELECT vec_id, list_transform(s, lambda y: y / list_sum(s)) AS s, list_transform(e, lambda y: y / list_sum(e)) AS e FROM x),
            u AS (SELECT vec_id, s[1] * e[1] AS none, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS p FROM n), w AS (SELECT vec_id, generate_subscripts(e, 1) - 1 AS j, unnest(e) AS p FROM n),
            c AS (SELECT u.vec_id, none, i, j, u.p * w.p AS score, row_number() OVER (PARTITION BY u.vec_id ORDER BY u.p * w.p DESC, i, j) AS k FROM u JOIN w ON u.vec_id = w.vec_id AND i >= 1 AND j >= i AND j <= i + 7)
            SELECT vec_id, i::INT AS start_token, j::INT AS end_token, round(score, 6) AS score FROM c WHERE k = 1 AND score > none""",
        "evidence_chunks": f"WITH {passages}, {chunks} SELECT id, passage_index, chunk_row_id FROM p JOIN c USING (file, page) WHERE passage <> '' AND contains(t, passage)",
        "gold_contexts": f"""WITH {passages}, {chunks}, h AS (SELECT id, passage_index, arg_min(chunk_id, (chunk_index, chunk_id)) AS chunk FROM p JOIN c USING (file, page) WHERE passage <> '' AND contains(t, passage) GROUP BY ALL),
            o AS (SELECT p.id, p.passage_index, chunk FROM p LEFT JOIN h USING (id, passage_index)), d AS (SELECT id, chunk, min(passage_index) AS i FROM o GROUP BY ALL)
            SELECT id, CASE WHEN bool_or(chunk IS NULL) THEN NULL ELSE string_agg(chunk, ',' ORDER BY i) END AS context, bool_or(chunk IS NULL) AS failed FROM d GROUP BY id""",
        "evidence_pages": f"""WITH {passages}, {pages}, k AS (SELECT DISTINCT file FROM g), j AS (SELECT p.id, p.passage_index, max(passage) AS passage, bool_or(k.file IS NOT NULL) AS known, bool_or(g.page_id IS NOT NULL) AS there,
            count(*) FILTER (contains(g.t, passage)) AS scans FROM p LEFT JOIN k ON k.file = p.file LEFT JOIN g ON g.file = p.file AND g.page = p.page GROUP BY p.id, p.passage_index)
            SELECT id, passage_index, CASE WHEN NOT known THEN 'unknown source' WHEN NOT there THEN 'no such page' WHEN coalesce(passage, '') = '' THEN 'no text' WHEN scans = 0 THEN 'not on page' ELSE 'found' END AS state, scans FROM j""",
        "evidence_occurrences": f"""WITH {passages}, {pages}, d AS (SELECT DISTINCT passage FROM p WHERE passage <> '')
            SELECT passage, coalesce(sum((length(t) - length(replace(t, passage, ''))) // length(passage)), 0)::BIGINT AS occurrences FROM d LEFT JOIN g ON contains(t, passage) GROUP BY passage""",
        "evidence_sentences": f"""WITH {passages}, {pages}, {pieces}, h AS (SELECT id, passage_index, passage, page_id FROM p JOIN g USING (file, page) WHERE passage <> '' AND contains(t, passage))
            SELECT id, passage_index, min(length(sentence))::INT AS shortest FROM h LEFT JOIN sentences s ON s.page_id = h.page_id AND contains(sentence, passage) GROUP BY id, passage_index""",
        "duplicate_questions": f"SELECT lower(regexp_replace(question, '^{SPACES}+|{SPACES}+$', '', 'g')) AS question, count(*) AS n FROM questions WHERE question IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "duplicate_chunk_ids": "SELECT chunk_id AS id, count(*) AS n FROM document_chunks GROUP BY chunk_id HAVING count(*) > 1",
        "category_counts": "SELECT category, split, count(*) AS n FROM questions GROUP BY ALL",
        "tag_counts": "SELECT tag, count(*) AS n FROM (SELECT unnest(failure_tags) AS tag FROM questions) GROUP BY tag",
        "dataset_totals": "SELECT count(*) AS questions, count(*) FILTER (answerable) AS answerable, count(*) FILTER (NOT answerable) AS unanswerable FROM questions",
        "unread_questions": """WITH m AS (SELECT id AS question_id, unnest(CASE WHEN answerable THEN ['gold_context', 'retrieved_context'] ELSE ['retrieved_context'] END) AS mode, split FROM questions),
            w AS (SELECT question_id, split, mode, unnest(['extractive', 'generative']) AS reader FROM m)
            SELECT question_id, split, reader, mode FROM w WHERE NOT EXISTS (SELECT 1 FROM reader_records r WHERE r.question_id = w.question_id AND r.reader = w.reader AND r.mode = w.mode)""",
        "token_windows": """WITH n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n\\t]+'), lambda x: x <> '')) AS n FROM documents),
            w AS (SELECT doc_id, n, unnest(range(CASE WHEN n <= 96 THEN 1 ELSE 1 + ceil((n - 96) / 64.0)::BIGINT END)) AS i FROM n)
            SELECT doc_id, i::INT AS "window", (i * 64)::INT AS start_token, least(i * 64 + 96, n)::INT AS end_token FROM w""",
        "packed_prompts": f"""WITH c AS (SELECT source, page_number, chunk_index, chunk_row_id, {clean('text')} AS t FROM document_chunks WHERE text IS NOT NULL),
            o AS (SELECT *, row_number() OVER w AS place, sum(len(string_split(t, ' '))) OVER (w ROWS UNBOUNDED PRECEDING) AS cost FROM c WHERE t <> '' WINDOW w AS (PARTITION BY source, page_number ORDER BY chunk_index, chunk_row_id))
            SELECT source, page_number, count(*)::INT AS chunks, string_agg('[' || place || '] ' || t, chr(10) || chr(10) ORDER BY place) AS context FROM o WHERE cost <= 200 GROUP BY source, page_number""",
        "reader_outcomes": f"""WITH {scored}, {passages}, {chunks},
            t AS (SELECT question_id, reader, mode, arg_min({{'refused': refused, 'correct': correct, 'error': error}}, (finished_at, received_at, coalesce(prediction, ''))) AS r FROM f GROUP BY ALL),
            su AS (SELECT DISTINCT id FROM p WHERE EXISTS (SELECT 1 FROM c WHERE c.file = p.file AND c.page = p.page)),
            re AS (SELECT id, bool_and(EXISTS (SELECT 1 FROM c WHERE c.file = p.file AND c.page = p.page AND passage <> '' AND contains(t, passage))) AS retrieved FROM p GROUP BY id),
            ev AS (SELECT id AS question_id, answerable, unnest(['extractive', 'generative']) AS reader FROM questions),
            j AS (SELECT ev.*, a.r AS found, b.r AS gold, su.id IS NOT NULL AS supported, coalesce(re.retrieved, TRUE) AS retrieved FROM ev LEFT JOIN t a ON a.question_id = ev.question_id AND a.reader = ev.reader AND a.mode = 'retrieved_context'
            LEFT JOIN t b ON b.question_id = ev.question_id AND b.reader = ev.reader AND b.mode = 'gold_context' LEFT JOIN su ON su.id = ev.question_id LEFT JOIN re ON re.id = ev.question_id),
            o AS (SELECT *, CASE WHEN NOT supported THEN 'refused_by_router' WHEN found IS NULL OR found.error IS NOT NULL THEN 'error' WHEN found.refused THEN 'refused_by_reader' ELSE 'answered' END AS outcome FROM j),
            d AS (SELECT *, CASE WHEN outcome = 'error' THEN NULL WHEN outcome = 'answered' THEN answerable AND coalesce(found.correct, FALSE) ELSE NOT answerable END AS "right" FROM o)
            SELECT question_id, reader, outcome, "right", CASE WHEN outcome = 'error' THEN 'error' WHEN NOT answerable THEN CASE WHEN outcome = 'answered' THEN 'false_accept' ELSE outcome END WHEN "right" THEN 'correct'
            WHEN NOT retrieved THEN 'retrieval_miss' WHEN NOT supported THEN 'router_reject' WHEN gold IS NULL OR gold.error IS NOT NULL THEN 'error' WHEN coalesce(gold.correct, FALSE) THEN 'reader_distracted' ELSE 'reader_error' END AS diagnosis FROM d""",
    }
