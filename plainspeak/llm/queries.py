"""The registered corpus queries, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, exact, language, mixing, neighbours, packing, page_text, pii, prefix_trie, quality, repeats, secret_scan, simhash
from .common import table

QUERIES = {}
ORACLE = {}

#: Target mix of the given sources. What isn't listed weighs 1 beside its siblings.
MIX_WEIGHTS = {
    ("crawl",): 0.4,
    ("books",): 0.3,
    ("reference",): 0.2,
    ("forum",): 0.1,
    ("crawl", "en"): 4.0,
    ("crawl", "de"): 2.0,
    ("books", "en"): 2.0,
}
#: Share of all tokens that the mix takes.
MIX_SHARE = 0.8


def domain_of(source: str) -> Column:
    """The domain of a source: src0 is the crawl, the others go by their number."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"^src([0-9]{1,9})$", 1)
    n = F.when(number != "", number.cast("long"))
    return (
        F.when(n == 0, "crawl").when(n % 3 == 0, "books").when(n % 3 == 1, "reference").otherwise("forum")
    )


def query(function):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, folder)

    run.__name__ = function.__name__
    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return run


@query
def op1_quality(spark, folder):
    """A quality score for every document, learned from labels that aren't held out."""
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


@query
def op2_simhash(spark, folder):
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op3_pii(spark, folder):
    """Personal data of every document: counts and digest of plain identifiers, all spans."""
    return pii.find_personal_data(table(spark, folder, "documents"))


@query
def op4_packing(spark, folder):
    """The place of every piece of every document."""
    return packing.pack(table(spark, folder, "documents"))


@query
def op5_html(spark, folder):
    """Main text of every page."""
    return page_text.extract(table(spark, folder, "pages"))


@query
def op6_neighbours(spark, folder):
    """The ten nearest vectors of every row whose id is divisible by 100."""
    return neighbours.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op7_mixing(spark, folder):
    """Documents by epoch, mixed to target weights; small sources are seen twice at most."""
    return mixing.mix(table(spark, folder, "documents"), domain_of("source"), MIX_WEIGHTS, MIX_SHARE, max_epochs=2)


@query
def op9_language(spark, folder):
    """Language of every page, the text model learned from documents."""
    languages, model = language.fit(table(spark, folder, "documents"))
    return language.identify(table(spark, folder, "pages"), languages, model)


def _of_rule(k: int):
    return lambda span: span["k"] == k


@query
def op8_secrets(spark, folder):
    """Secrets of every document: counts and digest of the base kinds, all spans."""
    found = secret_scan.find_secrets(table(spark, folder, "documents"))
    all_of = F.col("found")
    base = F.filter(all_of, lambda s: s["k"] < len(secret_scan.BASE))
    return found.select(
        "doc_id",
        *[
            F.size(F.filter(all_of, _of_rule(k))).cast("long").alias(f"n_{r.kind}")
            for k, r in enumerate(secret_scan.BASE)
        ],
        F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
        secret_scan.written(all_of).alias("spans"),
    )


def _spans_sql() -> str:
    """Each rule by splitting the text at its matches: a match starts after all gaps and matches before it."""
    rules = []
    for k, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        pattern = pattern.replace("(?i)(", "(?i:(").replace(")(?-i)", "))")
        rules.append(
            f"""
  SELECT doc_id, {k} AS k, '{rule.kind}' AS kind,
         list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT
           + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS place,
         length(hits[i]) AS size
  FROM (
    SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits,
           regexp_extract_all(t, '{pattern}', {rule.group}) AS parts,
           unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
  ) WHERE length(parts[i]) >= {rule.least}"""
        )
    return "\n  UNION ALL".join(rules)


ORACLE["op8_secrets"] = f"""
WITH found AS ({_spans_sql()}
),
written AS (
  SELECT doc_id,
         count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2,
         string_agg(kind || ':' || place || ':' || (place + size), ',' ORDER BY place, k) FILTER (WHERE k < {len(secret_scan.BASE)}) AS base,
         string_agg(kind || ':' || place || ':' || (place + size), ',' ORDER BY place, k) AS spans
  FROM found GROUP BY doc_id
)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN written USING (doc_id)
"""


@query
def op10_exact_dedup(spark, folder):
    """The row that stays for every document."""
    found = exact.exact_duplicates(table(spark, folder, "documents"))
    return found.withColumnRenamed("digest", "text_sha256")


ORACLE["op10_exact_dedup"] = r"""
WITH rows AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept,
       sha256(content) AS text_sha256
FROM rows
WINDOW same AS (PARTITION BY content)
"""


@query
def op11_repeats(spark, folder):
    """Words of every document that stay when repeated passages are removed."""
    return repeats.remove_repeats(table(spark, folder, "documents"))


@query
def op12_prefix_trie(spark, folder):
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


ORACLE["op12_prefix_trie"] = """
WITH RECURSIVE crc AS (
  SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS s, 0 AS step, 4294967295::BIGINT AS r
  FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT c, s, step + 1,
         CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (
    SELECT c, s, step, CASE WHEN step % 8 = 0 THEN xor(r, ascii(s[step // 8 + 1])::BIGINT) ELSE r END AS x
    FROM crc WHERE step < 8 * length(s)
  )
),
convs AS (SELECT c, c - c % 100 AS base, xor(r, 4294967295) % 6 AS h FROM crc WHERE step = 8 * length(s)),
own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
),
turns AS (
  SELECT convs.c, 0 AS part, k, role, text FROM convs JOIN own ON own.c = convs.base AND k <= h
  UNION ALL
  SELECT convs.c, 1, k, role, text FROM convs JOIN own ON own.c = convs.c AND k > h
),
rows AS (
  SELECT c, text, row_number() OVER w AS d, list({r: role, t: text}) OVER w AS node
  FROM turns WINDOW w AS (PARTITION BY c ORDER BY part, k ROWS UNBOUNDED PRECEDING)
  UNION ALL
  SELECT c, '', 0, [] FROM convs
),
places AS (SELECT c, d, text, min(c) OVER (PARTITION BY node, d) AS conv, max(d) OVER (PARTITION BY c) AS n FROM rows),
nodes AS (
  SELECT d, conv, count(*) AS n_convs, max(length(text)) AS chars,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends
  FROM places GROUP BY d, conv
),
edges AS (
  SELECT DISTINCT b.d, b.conv, a.conv AS up FROM places AS a JOIN places AS b ON a.c = b.c AND a.d + 1 = b.d
),
under AS (
  SELECT DISTINCT a.d AS ad, a.conv AS aconv, b.d, b.conv FROM places AS a JOIN places AS b ON a.c = b.c AND a.d <= b.d
),
kids AS (SELECT d - 1 AS d, up AS conv, count(*) AS n FROM edges GROUP BY ALL),
sums AS (
  SELECT ad AS d, aconv AS conv, sum((n_convs - 1) * chars)::BIGINT AS saved,
         count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM under JOIN nodes USING (d, conv) LEFT JOIN kids USING (d, conv) GROUP BY ad, aconv
)
SELECT conv AS conv_id, d AS depth, up AS parent_conv_id, n_convs, coalesce(kids.n, 0) AS n_children,
       leaves AS n_leaves, saved AS saved_tokens, ends AS ends_sha256
FROM nodes JOIN sums USING (d, conv) LEFT JOIN kids USING (d, conv) LEFT JOIN edges USING (d, conv)
"""


@query
def op13_collocations(spark, folder):
    """The 2,000 best phrases of each language."""
    return collocations.collocations(table(spark, folder, "documents"))


ORACLE["op13_collocations"] = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w
  FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
  )
),
words AS (
  SELECT lang, one, lead(one) OVER place AS two, lead(one, 2) OVER place AS three
  FROM (
    SELECT lang, piece, unnest(w) AS one, generate_subscripts(w, 1) AS i
    FROM (SELECT lang, w, row_number() OVER () AS piece FROM pieces WHERE len(w) > 0)
  ) WINDOW place AS (PARTITION BY piece ORDER BY i)
),
grams AS (
  SELECT lang, 1 AS size, one AS phrase FROM words
  UNION ALL
  SELECT lang, 2, one || ' ' || two FROM words WHERE two IS NOT NULL
  UNION ALL
  SELECT lang, 3, one || ' ' || two || ' ' || three FROM words WHERE three IS NOT NULL
),
counts AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND a >= 10),
parts AS MATERIALIZED (
  SELECT lang, phrase, size, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
),
cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, k, x.a AS l, y.a AS r,
         (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM parts AS c
  JOIN counts AS x ON x.lang = c.lang AND x.phrase = c.head
  JOIN counts AS y ON y.lang = c.lang AND y.phrase = c.rest
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, phrase, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE size = 3)
  GROUP BY ALL
),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM lowest LEFT JOIN around USING (lang, phrase) WHERE size = 3 OR most IS NULL OR 100 * most < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
