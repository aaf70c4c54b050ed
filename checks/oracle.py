"""The same queries in DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

from plainspeak.functions import fixed_values as V

from .tables import STOP_LIST_SIZE, VECTOR_SIZE

_WS = V.WHITESPACE_CLASS
_BREAKS = r"[ \t\n\x{0B}\f\r]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _norm(e: str) -> str:
    for pattern, new in ((V.MENTION, ""), (V.HASHTAG, r"\1"), (V.URL, ""), (V.EMAIL, ""), (" +", " ")):
        e = f"regexp_replace({e}, {_text(pattern)}, '{new}', 'g')"
    return f"lower(trim({e}))"


# Fixed values, written out here so that the SQL doesn't depend on the code it checks.
_EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]"


def _emoji(e: str) -> str:
    return f"regexp_replace({e}, '{_EMOJI}', '', 'g')"


def _words(e: str) -> str:
    return f"list_filter(string_split_regex({e}, '[{_WS}]+'), lambda w: w <> '')"


def _vocabulary_words(e: str) -> str:
    marks = V.VOCABULARY_SEPARATORS.replace("\t", "").replace("\n", "")
    return (
        f"list_filter(string_split(translate({e}, {_text(marks)} || chr(9) || chr(10), "
        f"repeat(' ', {len(marks) + 2})), ' '), lambda w: w <> '')"
    )


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _r6(e: str) -> str:
    return f"round({e}, 6) + 0.0"


def _name(code: str) -> str:
    return f"CASE {code} WHEN 0 THEN 'Clean' WHEN 1 THEN 'Offensive' WHEN 2 THEN 'Hate' ELSE CAST({code} AS VARCHAR) END"


def _capitals(code: str) -> str:
    return f"CASE {code} WHEN 0 THEN 'CLEAN' WHEN 1 THEN 'OFFENSIVE' WHEN 2 THEN 'HATE' ELSE CAST({code} AS VARCHAR) END"


COMMENTS = """comments AS (
  SELECT d.doc_id, d.n_chars, epoch_us(e.ts) AS micros, epoch_us(e.ts) / 1e6 AS "timestamp",
         CAST(e.user_id AS VARCHAR) AS "user", d.text AS comment, e.ts AS event_time
  FROM documents d JOIN events e ON d.doc_id = e.event_id)"""

_SCORES = "(n_chars % 7 + 1) / 16.0::DOUBLE AS s0, (doc_id % 7 + 1) / 16.0::DOUBLE AS s1"
_BEST = (
    "CASE WHEN s0 >= s1 AND s0 >= 1 - s0 - s1 THEN 0 WHEN s1 >= 1 - s0 - s1 THEN 1 ELSE 2 END"
)
SCORED = f"""{COMMENTS}, scored AS (
  SELECT *, CAST({_BEST} AS INTEGER) AS prediction FROM (SELECT *, {_SCORES} FROM comments))"""

LABELS = """class_labels AS (
  SELECT doc_id, CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS label_id FROM labels)"""

JUDGED = f"""{LABELS}, judged AS (
  SELECT doc_id, label_id, s0, s1, 1 - s0 - s1 AS s2, CAST({_BEST} AS INTEGER) AS prediction
  FROM (SELECT doc_id, label_id, {_SCORES} FROM class_labels JOIN documents USING (doc_id)))"""

STOP = f"""stop_list AS (
  SELECT word FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM benchmark)
  WHERE word <> '' GROUP BY word ORDER BY count(*) DESC, word LIMIT {STOP_LIST_SIZE}),
stop_row AS (SELECT list(word) AS stops FROM stop_list)"""


def _without_stop(e: str) -> str:
    return (
        f"array_to_string(list_filter({_words(e)}, "
        "lambda w: NOT list_contains(stops, w)), ' ')"
    )


NORMAL = f"""normal AS (
  SELECT doc_id, norm FROM (SELECT doc_id, {_norm('text')} AS norm FROM documents) WHERE norm <> '')"""

CORPUS = f"""{STOP}, {NORMAL}, corpus AS (
  SELECT doc_id, lower({_emoji(_without_stop('norm'))}) AS text_clean FROM normal, stop_row)"""


def _tokens(source: str, key: str, text: str) -> str:
    return f"""SELECT {key}, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT {key}, {_vocabulary_words(text)} AS w FROM {source})"""


def _vocabulary(name: str, tokens: str, key: str) -> str:
    return f"""{name} AS (
  SELECT word, n, row_number() OVER (ORDER BY n DESC, first_doc, first_pos) AS idx FROM (
    SELECT word, count(*) AS n, min({key}) AS first_doc, arg_min(pos, ({key}, pos)) AS first_pos
    FROM {tokens} GROUP BY word))"""


VOCABULARY = f"""{CORPUS}, tokens AS ({_tokens('corpus', 'doc_id', 'text_clean')}),
{_vocabulary('vocabulary', 'tokens', 'doc_id')}"""

VECTORS = f"""bench_tokens AS ({_tokens('benchmark', 'item_id', 'text')}),
{_vocabulary('bench_words', 'bench_tokens', 'item_id')}, vectors AS (
  SELECT b.word, e.embedding AS vec FROM bench_words b JOIN embeddings e ON b.idx = e.vec_id + 1)"""


def _encode(source: str) -> str:
    """Last 100 known ids per document, zeros in front; ``known`` holds doc_id, pos, idx."""
    return f"""
SELECT d.doc_id, array_to_string(
  list_concat(list_transform(range(100 - len(ids)), lambda x: 0), ids), ',') AS encoded
FROM (
  SELECT s.doc_id, coalesce(k.ids, []) AS ids FROM {source} s LEFT JOIN (
    SELECT doc_id, list(idx ORDER BY pos) AS ids FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS back FROM known)
    WHERE back <= 100 GROUP BY doc_id) k USING (doc_id)) d"""


LABELLED = f"""{LABELS}, labelled AS (
  SELECT doc_id, label_id, CASE WHEN doc_id % 10 < 8 THEN 'Train' WHEN doc_id % 10 = 8 THEN 'Dev'
         ELSE 'Test' END AS "set" FROM class_labels)"""

_PAIRS = """words AS (SELECT doc_id, w FROM (SELECT doc_id, {words} AS w FROM {source})),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words),
nexts AS (SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM placed),
counts AS (SELECT word, count(*) AS n FROM placed GROUP BY word),
pairs AS (SELECT word AS a, nxt AS b, count(*) AS n FROM nexts WHERE nxt IS NOT NULL GROUP BY ALL),
lexicon AS (
  SELECT * FROM (
    SELECT a, b, p.n, (p.n - 5)::DOUBLE * (SELECT sum(n) FROM counts)::DOUBLE
           / (x.n::DOUBLE * y.n::DOUBLE) AS score
    FROM pairs p JOIN counts x ON x.word = a JOIN counts y ON y.word = b WHERE p.n >= 5)
  WHERE score > 10)"""

PHRASES = f"{CORPUS}, {_PAIRS.format(words=_words('text_clean'), source='corpus')}"
NORMAL_PHRASES = f"{STOP}, {NORMAL}, {_PAIRS.format(words=_words('norm'), source='normal')}"

_JOINED = """linked AS (
  SELECT x.doc_id, x.pos, x.word, x.nxt, l.a IS NOT NULL AS linked
  FROM nexts x LEFT JOIN lexicon l ON l.a = x.word AND l.b = x.nxt),
runs AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id, linked ORDER BY pos) AS run FROM linked),
numbered AS (
  SELECT *, linked AND row_number() OVER (PARTITION BY doc_id, linked, run ORDER BY pos) % 2 = 1 AS joined
  FROM runs),
pieces AS (
  SELECT doc_id, pos, CASE WHEN joined THEN word || '_' || nxt ELSE word END AS piece,
    coalesce(lag(joined) OVER (PARTITION BY doc_id ORDER BY pos), false) AS taken FROM numbered),
texts AS (SELECT doc_id, string_agg(piece, ' ' ORDER BY pos) AS joined_text FROM pieces WHERE NOT taken GROUP BY doc_id)"""

_LINKS = r"""linked AS (
  SELECT page_id, CASE WHEN starts_with(href, '/') AND NOT starts_with(href, '//')
         THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href ELSE href END AS link
  FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)),
link_ids AS (
  SELECT DISTINCT page_id, id FROM (
    SELECT page_id, split_part(split_part(link, '/', 4), '?', 1) AS id FROM linked)
  WHERE id <> '' AND id <> 'profile.php')"""

_EVENT_LABELS = f"""{LABELS}, live AS (
  SELECT e.ts, CAST(e.user_id AS VARCHAR) AS "user", e.event_type AS comment,
         coalesce(l.label_id, 0) AS prediction
  FROM events e LEFT JOIN class_labels l ON e.event_id = l.doc_id)"""


def _word_cloud(source: str, text: str) -> str:
    clean = f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_{_WS}]', '', 'g')"
    return f"""SELECT w AS text, count(*) AS size FROM (SELECT unnest({_words(clean)}) AS w FROM {source})
GROUP BY w ORDER BY size DESC, w LIMIT 20"""


def _f1_parts() -> str:
    return ", ".join(
        f"count(*) FILTER (label_id = {c} AND prediction = {c}) AS h{c}, "
        f"count(*) FILTER (label_id = {c}) AS t{c}, count(*) FILTER (prediction = {c}) AS p{c}"
        for c in (0, 1, 2)
    )


_F1 = " + ".join(
    f"(CASE WHEN t{c} + p{c} > 0 THEN 2.0::DOUBLE * h{c} / (t{c} + p{c}) ELSE 0 END)" for c in (0, 1, 2)
)
_CLASSES = " + ".join(f"(t{c} + p{c} > 0)::INT" for c in (0, 1, 2))

# Multinomial naive Bayes on term weights, smoothing 1: fitted on Train and Dev, applied to Test.
_BAYES = rf"""{CORPUS}, {LABELLED}, data AS (
  SELECT c.doc_id, c.text_clean, l.label_id, l."set" = 'Test' AS test
  FROM corpus c JOIN labelled l USING (doc_id) WHERE c.text_clean <> ''),
terms AS (
  SELECT doc_id, label_id, test, unnest(CASE WHEN t <> '' THEN string_split_regex(t, '{_BREAKS}') ELSE [] END) AS term
  FROM (SELECT *, rtrim(text_clean, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM data)),
tf AS (SELECT doc_id, label_id, test, term, count(*) AS tf FROM terms GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(*) FROM data WHERE NOT test) + 1)::DOUBLE / (count(*) + 1)) AS idf
  FROM tf WHERE NOT test GROUP BY term),
sums AS (SELECT label_id, term, sum(tf * idf) AS w FROM tf JOIN idf USING (term) WHERE NOT test GROUP BY ALL),
classes AS (
  SELECT label_id, ln(n + 1) - ln(sum(n) OVER () + count(*) OVER ()) AS prior, ln(total + (SELECT count(*) FROM idf)) AS denom
  FROM (SELECT label_id, count(*) AS n FROM data WHERE NOT test GROUP BY label_id)
  JOIN (SELECT label_id, sum(w) AS total FROM sums GROUP BY label_id) USING (label_id)),
likelihood AS (
  SELECT t.doc_id, c.label_id, sum(t.tf * i.idf * (ln(coalesce(s.w, 0) + 1) - c.denom)) AS ll
  FROM tf t JOIN idf i USING (term) CROSS JOIN classes c
  LEFT JOIN sums s ON s.term = t.term AND s.label_id = c.label_id WHERE t.test GROUP BY ALL)
SELECT d.doc_id, d.label_id, CAST(arg_max(c.label_id, c.prior + coalesce(k.ll, 0)) AS INTEGER) AS prediction
FROM data d CROSS JOIN classes c LEFT JOIN likelihood k ON k.doc_id = d.doc_id AND k.label_id = c.label_id
WHERE d.test GROUP BY ALL"""

ORACLE = {
    "model_nb": f"WITH {_BAYES}",
    "comments_projection": f"""WITH {COMMENTS}
SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN NULL ELSE "timestamp" END AS "timestamp", "user", comment
FROM comments""",
    "clean_nonempty": f"WITH {NORMAL} SELECT doc_id FROM normal",
    "nonblank_guard": f"""WITH {COMMENTS}
SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE "user" END AS "user",
  {_strip('comment')} AS comment FROM comments) WHERE "user" <> '' AND comment <> ''""",
    "label_validity": rf"""WITH {LABELS}
SELECT doc_id, CAST(trim(label_id) AS INTEGER) AS label_id FROM (
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '1.0' WHEN 1 THEN 'x' WHEN 2 THEN ' ' || label_id || ' '
    WHEN 3 THEN CAST(label_id + 1 AS VARCHAR) ELSE CAST(label_id AS VARCHAR) END AS label_id FROM class_labels)
WHERE regexp_matches(label_id, '^\s*[012]\s*$')""",
    "label_names": f"""SELECT doc_id, code, {_name('code')} AS name, {_capitals('code')} AS capitals
FROM (SELECT doc_id, quality + 2 * toxic AS code FROM labels)""",
    "label_status": f"""SELECT doc_id, label,
  CASE label WHEN 'Clean' THEN 'green' WHEN 'Offensive' THEN 'orange' WHEN 'Hate' THEN 'red' END AS status
FROM (SELECT doc_id, {_name('code')} AS label FROM (SELECT doc_id, quality + 2 * toxic AS code FROM labels))""",
    "time_labels": f"""WITH {SCORED}
SELECT doc_id, {_name('prediction')} AS label, strftime(event_time, '%H:%M %d-%m-%Y') AS date_time,
  strftime(event_time, '%d-%m-%Y') AS date, strftime(event_time, '%H:%M:%S') AS time FROM scored""",
    "clean_comments": f"WITH {NORMAL} SELECT doc_id, norm AS comment_norm FROM normal",
    "emoji_strip": f"""SELECT doc_id, {_emoji('marked')} AS text FROM (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0
    THEN chr(128512) || chr(128512) || text || chr(128640) || ' ' || chr(129315) ELSE text END AS marked
  FROM documents)""",
    "stopword_filter": f"WITH {STOP} SELECT doc_id, {_without_stop('text')} AS text FROM documents, stop_row",
    "stopword_join": f"""WITH stops AS (SELECT DISTINCT unnest({_words('text')}) AS word FROM benchmark),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, {_words('text')} AS w FROM documents)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM placed
  WHERE word NOT IN (SELECT word FROM stops) GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.text, '') AS text FROM documents d LEFT JOIN kept k USING (doc_id)""",
    "preprocess": f"WITH {CORPUS} SELECT doc_id, text_clean FROM corpus",
    "vocab_rank": f"WITH {VOCABULARY} SELECT word, n, idx FROM vocabulary",
    "encode_pad": f"""WITH {VOCABULARY}, known AS (
  SELECT t.doc_id, t.pos, v.idx FROM tokens t JOIN vocabulary v USING (word)) {_encode('corpus')}""",
    "encode_unknown": f"""WITH {VECTORS}, tokens AS ({_tokens('documents', 'doc_id', 'text')}), known AS (
  SELECT t.doc_id, t.pos, v.idx FROM tokens t JOIN bench_words v USING (word)) {_encode('documents')}""",
    "one_hot_label": f"""WITH {LABELS} SELECT doc_id, label_id,
  CASE label_id WHEN 0 THEN '1,0,0' WHEN 1 THEN '0,1,0' ELSE '0,0,1' END AS one_hot FROM class_labels""",
    "embedding_matrix": f"""WITH {VOCABULARY}, {VECTORS}
SELECT v.idx, v.word, array_to_string(list_transform(
  coalesce(x.vec, list_transform(range({VECTOR_SIZE}), lambda i: 0::FLOAT)),
  lambda f: CAST(round(f::DOUBLE * 1000000) AS BIGINT)), ',') AS vec
FROM vocabulary v LEFT JOIN vectors x ON v.word = x.word AND v.idx < 10000
UNION ALL SELECT 0, NULL, array_to_string(list_transform(range({VECTOR_SIZE}), lambda i: 0), ',')""",
    "pooled_vectors": f"""WITH {VOCABULARY}, {VECTORS}, counted AS (
  SELECT t.doc_id, CASE WHEN v.idx < 10000 THEN v.word END AS word, count(*) AS times
  FROM tokens t JOIN vocabulary v USING (word) GROUP BY ALL),
spread AS (
  SELECT c.doc_id, d.dim, c.times, coalesce(x.vec[d.dim + 1], 0)::DOUBLE AS f
  FROM counted c LEFT JOIN vectors x USING (word) CROSS JOIN range({VECTOR_SIZE}) d(dim)),
pooled AS (SELECT doc_id, dim, sum(times) AS n, sum(times * f) / sum(times) AS mean, max(f) AS max
  FROM spread GROUP BY ALL)
SELECT c.doc_id, CAST(coalesce(p.n, 0) AS BIGINT) AS n_words, CAST(d.dim AS INTEGER) AS dim,
  {_r6('coalesce(p.mean, 0)')} AS mean, {_r6('coalesce(p.max, 0)')} AS max
FROM corpus c CROSS JOIN range({VECTOR_SIZE}) d(dim) LEFT JOIN pooled p ON p.doc_id = c.doc_id AND p.dim = d.dim""",
    "tfidf": rf"""WITH {CORPUS}, terms AS (
  SELECT doc_id, unnest(CASE WHEN t <> '' THEN string_split_regex(t, '{_BREAKS}')
    WHEN text_clean = '' THEN [''] ELSE [] END) AS term
  FROM (SELECT doc_id, text_clean, rtrim(text_clean, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
        FROM corpus)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc_id, term, tf, {_r6('tf * ln(((SELECT count(*) FROM corpus) + 1)::DOUBLE / (df + 1))')} AS tfidf
FROM tf JOIN df USING (term)""",
    "phrase_lexicon": f"WITH {PHRASES} SELECT a, b, n, {_r6('score')} AS score FROM lexicon",
    "phrase_join": f"""WITH {PHRASES}, {_JOINED}
SELECT c.doc_id, coalesce(t.joined_text, '') AS text_clean FROM corpus c LEFT JOIN texts t USING (doc_id)""",
    "preprocess_phrases": f"""WITH {NORMAL_PHRASES}, {_JOINED}, whole AS (
  SELECT c.doc_id, coalesce(t.joined_text, '') AS joined FROM normal c LEFT JOIN texts t USING (doc_id))
SELECT doc_id, lower({_emoji(_without_stop('joined'))}) AS text_clean FROM whole, stop_row""",
    "argmax_label": f"SELECT doc_id, CAST({_BEST} AS INTEGER) AS prediction FROM (SELECT doc_id, {_SCORES} FROM documents)",
    "scored_comments": f'WITH {SCORED} SELECT "timestamp", "user", comment, prediction FROM scored',
    "label_counts": f"WITH {SCORED} SELECT {_name('prediction')} AS label, count(*) AS n FROM scored GROUP BY prediction",
    "label_counters": f"""WITH {SCORED} SELECT count(*) FILTER (prediction = 0) AS count_clean,
  count(*) FILTER (prediction = 1) AS count_offensive, count(*) FILTER (prediction = 2) AS count_hate FROM scored""",
    "distinct_users": f"""WITH {SCORED}
SELECT count(DISTINCT "user") + max(("user" IS NULL)::INT) AS count_user FROM scored""",
    "label_by_minute": f"""WITH {SCORED}
SELECT CAST(date_trunc('minute', event_time) AS TIMESTAMP) AS minute, count(*) FILTER (prediction = 0) AS clean,
  count(*) FILTER (prediction = 1) AS offensive, count(*) FILTER (prediction = 2) AS hate,
  strftime(date_trunc('minute', event_time), '%H:%M %d-%m-%Y') AS date_time
FROM scored GROUP BY date_trunc('minute', event_time)""",
    "recent_comments": f"""WITH {SCORED}
SELECT strftime(event_time, '%d-%m-%Y') AS "Date", strftime(event_time, '%H:%M:%S') AS "Time",
  "user" AS "User", comment AS "Comment", {_name('prediction')} AS "Prediction"
FROM (SELECT * FROM scored ORDER BY "timestamp" DESC, "user" DESC, comment DESC LIMIT 10)""",
    "top_words": _word_cloud("documents", "text"),
    "split_label_counts": f"""WITH {LABELLED}
SELECT {_capitals('label_id')} AS label_id, "set", count(*) AS counter FROM labelled GROUP BY label_id, "set" """,
    "resplit_label_counts": f"""WITH {LABELLED}
SELECT {_capitals('label_id')} AS label_id, CASE "set" WHEN 'Dev' THEN 'Train' ELSE "set" END AS "set",
  count(*) AS counter FROM labelled GROUP BY ALL""",
    "split_row_counts": f"""WITH {CORPUS}, {LABELLED}
SELECT "set", count(*) AS n FROM labelled JOIN corpus USING (doc_id) WHERE text_clean <> '' GROUP BY "set" """,
    "train_dev_union": f"""WITH {LABELS}
SELECT text AS free_text, label_id FROM documents JOIN class_labels USING (doc_id)
UNION ALL SELECT text, CASE WHEN role = 'user' THEN 0 ELSE 1 END FROM conversations""",
    "unseen_ids": f"""WITH {_LINKS}
SELECT DISTINCT id FROM link_ids WHERE id NOT IN (SELECT unnest({_words('text')}) FROM benchmark)""",
    "intake_cap": f"""WITH {COMMENTS} SELECT doc_id, "timestamp", "user", comment FROM comments ORDER BY doc_id LIMIT 100""",
    "confusion_matrix": f"""WITH {JUDGED}
SELECT CAST(c.label_id AS INTEGER) AS label_id, count(*) FILTER (j.prediction = 0) AS predicted_0,
  count(*) FILTER (j.prediction = 1) AS predicted_1, count(*) FILTER (j.prediction = 2) AS predicted_2
FROM range(3) c(label_id) LEFT JOIN judged j ON j.label_id = c.label_id GROUP BY c.label_id""",
    "accuracy": f"WITH {JUDGED} SELECT {_r6('avg((label_id = prediction)::INT)')} AS accuracy FROM judged",
    "f1_micro": f"""WITH {JUDGED}, t AS (SELECT {_f1_parts()} FROM judged)
SELECT {_r6('2.0::DOUBLE * (h0 + h1 + h2) / (t0 + t1 + t2 + p0 + p1 + p2)')} AS f1_micro FROM t""",
    "f1_macro": f"""WITH {JUDGED}, t AS (SELECT {_f1_parts()} FROM judged)
SELECT {_r6(f'({_F1}) / ({_CLASSES})')} AS f1_macro FROM t""",
    "log_loss": f"""WITH {JUDGED}
SELECT {_r6('avg(-ln(greatest(CASE label_id WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END, 1e-7)))')} AS loss,
  {_r6('avg((label_id = prediction)::INT)')} AS accuracy FROM judged""",
    "link_ids": f"WITH {_LINKS} SELECT page_id, id FROM link_ids",
    "page_blocks": rf"""SELECT DISTINCT page_id, block FROM (
  SELECT page_id, {_strip('raw')} AS block FROM (
    SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1)) AS raw FROM pages))
WHERE block <> ''""",
    "stream_append": f'WITH {COMMENTS} SELECT doc_id, "timestamp", "user", comment FROM comments',
    "stream_clean": f"""WITH {CORPUS}
SELECT c.doc_id, n.norm AS comment_norm, c.text_clean AS comment_clean, c.text_clean = '' AS is_blank_clean
FROM corpus c JOIN normal n USING (doc_id) JOIN events e ON e.event_id = c.doc_id""",
    "stream_label_counts": f"WITH {_EVENT_LABELS} SELECT {_name('prediction')} AS label, count(*) AS n FROM live GROUP BY prediction",
    "stream_label_by_minute": f"""WITH {_EVENT_LABELS}
SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, count(*) FILTER (prediction = 0) AS clean,
  count(*) FILTER (prediction = 1) AS offensive, count(*) FILTER (prediction = 2) AS hate
FROM live GROUP BY date_trunc('minute', ts)""",
    "users_by_range": """WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS d, user_id FROM events WHERE ts IS NOT NULL)
SELECT CAST(d - i::INT AS DATE) AS first_day, count(DISTINCT user_id) + max((user_id IS NULL)::INT) AS count_user, true AS near
FROM days, range(7) AS t(i) GROUP BY 1""",
    "top_words_sketch": f"""WITH {COMMENTS}
SELECT text, size, true AS within FROM ({_word_cloud('comments', 'comment')})""",
    "stream_bad_records": """SELECT CASE WHEN event_id % 50 <> 7 THEN event_id END AS event_id,
  CASE WHEN event_id % 50 <> 7 THEN CAST(user_id AS VARCHAR) END AS "user", CASE WHEN event_id % 50 <> 7 THEN event_type END AS comment,
  CASE WHEN event_id % 50 = 7 THEN '{"event_id": ' || event_id END AS line, true AS inbox_empty FROM events""",
    "stream_progress": "SELECT count(*) AS rows, true AS several FROM events",
    "id_log_bucketed": f"""WITH {_LINKS}
SELECT id, min(CASE WHEN page_id % 3 < 2 THEN 0 ELSE 1 END) = 1 AS is_new FROM link_ids GROUP BY id""",
    "stream_timeline": f"""WITH {LABELS}, span AS (SELECT min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM events),
live AS (
  SELECT e.event_id, e.ts, date_trunc('minute', e.ts) AS minute, coalesce(l.label_id, 0) AS prediction,
    (4 * (epoch_us(e.ts) - first)) // (last - first + 1) + (e.event_id % 10 = 3)::INT AS part
  FROM events e CROSS JOIN span LEFT JOIN class_labels l ON e.event_id = l.doc_id),
newest AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM live GROUP BY part),
judged AS (
  SELECT live.*, coalesce(minute + INTERVAL 1 MINUTE <= newest - INTERVAL 3 DAY, false) AS late
  FROM live JOIN newest USING (part)),
told AS (
  SELECT 'in time' AS kind, NULL::BIGINT AS event_id, minute, prediction FROM judged WHERE NOT late
  UNION ALL SELECT 'all', NULL, minute, prediction FROM judged
  UNION ALL SELECT 'late', event_id, minute, prediction FROM judged WHERE late)
SELECT kind, event_id, CAST(minute AS TIMESTAMP) AS minute, count(*) FILTER (prediction = 0) AS clean,
  count(*) FILTER (prediction = 1) AS offensive, count(*) FILTER (prediction = 2) AS hate
FROM told GROUP BY kind, event_id, minute""",
    "stream_users": """SELECT count(DISTINCT user_id) + max((user_id IS NULL)::INT) AS count_user, true AS near FROM events""",
    **{
        key: f"""WITH {CORPUS}, {LABELLED}
SELECT '{name}' AS model, count(*) AS test_rows, count(*) AS in_classes, true AS beats_commonest,
  true AS same_after_loading, true AS finite_loss
FROM labelled JOIN corpus USING (doc_id) WHERE text_clean <> '' AND "set" = 'Test'"""
        for key, name in {
            "model_lr": "logistic_regression", "model_dt": "decision_tree",
            "model_rf": "random_forest", "model_mlp": "word_vectors",
        }.items()
    },
    "model_epochs": f"""WITH {CORPUS}, {LABELLED}
SELECT count(*) AS dev_rows, 3 AS epochs, true AS same_after_stop, true AS best_is_least
FROM labelled JOIN corpus USING (doc_id) WHERE text_clean <> '' AND "set" = 'Dev'""",
    "model_array": f"""WITH {VOCABULARY}, {LABELLED}, ending AS (
  SELECT t.doc_id, v.idx FROM tokens t JOIN vocabulary v USING (word)
  QUALIFY row_number() OVER (PARTITION BY t.doc_id ORDER BY t.pos DESC) <= 100),
weights AS (
  SELECT idx, 1000 * count(*) FILTER (label_id = 0) // count(*) AS w0,
    1000 * count(*) FILTER (label_id = 1) // count(*) AS w1, 1000 * count(*) FILTER (label_id = 2) // count(*) AS w2
  FROM ending JOIN labelled USING (doc_id) WHERE "set" = 'Train' AND idx < 10000 GROUP BY idx),
summed AS (
  SELECT c.doc_id, coalesce(sum(w0), 0) AS s0, coalesce(sum(w1), 0) AS s1, coalesce(sum(w2), 0) AS s2
  FROM corpus c LEFT JOIN ending e ON c.doc_id = e.doc_id LEFT JOIN weights w ON e.idx = w.idx GROUP BY c.doc_id)
SELECT doc_id, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS prediction,
  s0 || ',' || s1 || ',' || s2 AS scores FROM summed""",
    "csv_corpus": """SELECT 'say "a, b"' || chr(10) || text AS free_text,
  CASE WHEN doc_id % 5 < 3 THEN CAST(doc_id % 5 AS INTEGER) END AS label_id FROM documents""",
    "stop_word_file": f"SELECT DISTINCT unnest({_words('text')}) AS word FROM benchmark",
    "vector_file": """SELECT 'w' || vec_id AS word, array_to_string(list_transform(embedding,
  lambda f: CAST(round(f::DOUBLE * 1000000) AS BIGINT)), ',') AS vec FROM embeddings""",
    "id_log": f"""WITH {_LINKS}
SELECT DISTINCT id FROM link_ids WHERE id NOT IN (SELECT id FROM link_ids WHERE page_id % 3 < 2)""",
    "first_ids": f"WITH {_LINKS} SELECT DISTINCT id FROM link_ids ORDER BY id LIMIT 100",
    "json_sink": f"""WITH {COMMENTS} SELECT "user", comment, (micros // 1000000) || '.' ||
  lpad(CAST(micros % 1000000 AS VARCHAR), 6, '0') AS "timestamp" FROM comments""",
    "json_source": f'WITH {COMMENTS} SELECT "timestamp", "user", comment FROM comments',
    "fitted_tables": f"WITH {VECTORS} SELECT word, n, idx FROM bench_words",
    "post_ids": "SELECT page_id, CAST(page_id AS VARCHAR) AS id FROM pages",
    "comment_links": """SELECT page_id, page_id || '_' || page_id * 7 AS token, CAST(page_id AS VARCHAR) AS post,
  CAST(page_id * 7 AS VARCHAR) AS number FROM pages""",
    "stream_dedup": f'WITH {_EVENT_LABELS} SELECT DISTINCT "user", comment FROM live',
    "stream_snapshot": f"""WITH {SCORED}, cleaned AS (SELECT *, {_norm('comment')} AS norm FROM scored),
label_rows AS (SELECT {_name('prediction')} AS label, count(*) AS n FROM cleaned GROUP BY prediction),
word_rows AS ({_word_cloud('cleaned', 'norm')})
SELECT 'labels' AS panel, CAST(to_json(list({{'label': label, 'n': n}} ORDER BY n DESC, label)) AS VARCHAR) AS records FROM label_rows
UNION ALL SELECT 'counters', CAST(to_json([{{'count_clean': count(*) FILTER (prediction = 0),
  'count_offensive': count(*) FILTER (prediction = 1), 'count_hate': count(*) FILTER (prediction = 2),
  'count_user': count(DISTINCT "user")}}]) AS VARCHAR) FROM cleaned
UNION ALL SELECT 'minutes', CAST(to_json(list({{'date_time': strftime(minute, '%H:%M %d-%m-%Y'), 'clean': c0, 'offensive': c1, 'hate': c2}} ORDER BY minute)) AS VARCHAR)
FROM (SELECT date_trunc('minute', event_time) AS minute, count(*) FILTER (prediction = 0) AS c0, count(*) FILTER (prediction = 1) AS c1,
  count(*) FILTER (prediction = 2) AS c2 FROM cleaned GROUP BY ALL)
UNION ALL SELECT 'recent', CAST(to_json(list({{'date': strftime(event_time, '%d-%m-%Y'), 'time': strftime(event_time, '%H:%M:%S'),
  'user': "user", 'comment': norm, 'label': {_name('prediction')}}} ORDER BY "timestamp", "user", norm)) AS VARCHAR)
FROM (SELECT * FROM cleaned ORDER BY "timestamp" DESC, "user" DESC, norm DESC LIMIT 10)
UNION ALL SELECT 'words', CAST(to_json(list({{'text': text, 'size': size}} ORDER BY size DESC, text)) AS VARCHAR) FROM word_rows""",
}
