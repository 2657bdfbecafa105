"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.llm import ann, embed_dedup, fim, language, licenses, lm, mixing, near_dedup, packing, prefix_trie, secrets, warc, wrapper

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` as ``name`` with the SQL that must give the same rows."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS_SQL = """
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x20\\x09-\\x0D]+') AS w FROM documents
"""


@query(
    "op2_minhash_near_dedup",
    f"""
    WITH RECURSIVE words AS ({WORDS_SQL}),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
               ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
    rows_of AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets),
    links AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM rows_of a JOIN rows_of b ON a.h = b.h AND a.doc_id <> b.doc_id
              GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
    reach AS (SELECT doc_id, doc_id AS other FROM documents
              UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON r.other = l.u)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.least AS component_id, s.doc_id = c.least AS kept
    FROM sets s JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY 1) c USING (doc_id)
    """,
)
def op2(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    return packing.packing_report(table(spark, sf_dir, "documents"), vocabulary())


@query("op3_nearest_neighbours")
def op3(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(rows, rows.where("vec_id % 20 = 0"))


@query(
    "op5_warc_round_trip",
    """
    WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    digests AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM bodies),
    firsts AS (SELECT d, max(page_id) AS target FROM digests WHERE n >= 1000 GROUP BY d)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, g.d AS payload_digest,
           CASE WHEN n >= 1000 AND target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND target <> page_id THEN target END AS refers_to
    FROM digests g LEFT JOIN firsts USING (d)
    """,
)
def op5(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op6_maxent_lm_scores")
def op6(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query(
    "op7_embedding_near_dedup",
    """
    WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM vectors a JOIN vectors b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
    reach AS (SELECT vec_id, vec_id AS other FROM embeddings
              UNION SELECT r.vec_id, l.v FROM reach r JOIN links l ON r.other = l.u),
    least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1),
    counts AS (SELECT u AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM least LEFT JOIN counts USING (vec_id)
    """,
)
def op7(spark, sf_dir):
    return embed_dedup.near_embeddings(table(spark, sf_dir, "embeddings"))


@query("op4_mix_sources")
def op4(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query("op8_secret_scan")
def op8(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@query("op9_language_id")
def op9(spark, sf_dir):
    """Documents and pages: a row of ``documents`` has ``doc_id``, one of ``pages`` ``page_id``."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language.fit_languages(docs, "doc_id", "text", "lang")
    found = language.identify(docs, model, "doc_id", F.col("text"), F.col("lang"), host=F.col("source"))
    return found.unionByName(language.identify_pages(pages, model), allowMissingColumns=True)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULES_SQL = ", ".join(
    f"CASE WHEN regexp_matches(line, {_quoted(pattern)}) THEN {_quoted(name)} END" for name, pattern in licenses.rule_patterns().items()
)
_KNOWN_SQL = "MAP {" + ", ".join(f"{_quoted(words)}: {_quoted(name)}" for name, words in licenses.SENTENCES.items()) + "}"


@query(
    "op10_license_scan",
    f"""
    WITH pieces AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), {_quoted(licenses.SENTENCE_END)})) AS s,
                           generate_subscripts(regexp_split_to_array(coalesce(text, ''), {_quoted(licenses.SENTENCE_END)}), 1) AS i FROM documents),
    named AS (SELECT doc_id, i, {_KNOWN_SQL}[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))] AS name FROM pieces),
    found AS (SELECT doc_id, coalesce(string_agg(name, ' ' ORDER BY i), '') AS sentence_ids, count(name) AS n_sentences
              FROM named GROUP BY doc_id),
    lines AS (SELECT *, ' ' || sentence_ids || ' ' AS line FROM found)
    SELECT doc_id, sentence_ids, n_sentences,
           array_to_string([n FOR n IN [{_RULES_SQL}] IF n IS NOT NULL], ',') AS licenses FROM lines
    """,
)
def op10(spark, sf_dir):
    return licenses.find_licenses(table(spark, sf_dir, "documents"), wrapped=True)


# unsigned CRC-32 of a text of ASCII characters
_CRC_SQL = """
    xor(list_reduce([4294967295::BIGINT] || [ascii(s[i])::BIGINT FOR i IN range(1, length(s) + 1)],
        lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT FOR k IN range(8)], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)
"""


@query(
    "op11_conversation_prefix_trie",
    f"""
    WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
                 FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT c, c - c % 100 AS base, {_CRC_SQL} % 6 AS h FROM (SELECT DISTINCT c, c::VARCHAR AS s FROM own)),
    turns AS (SELECT v.c, o.pos, 0 AS part, r, x FROM convs v JOIN own o ON o.c = v.base AND o.pos <= v.h
              UNION ALL SELECT v.c, o.pos, 1, r, x FROM convs v JOIN own o ON o.c = v.c AND o.pos > v.h),
    lists AS (SELECT c, list(md5(r) || md5(x) ORDER BY part, pos) AS l, list(length(x) ORDER BY part, pos) AS n FROM turns GROUP BY c),
    whole AS (SELECT c, coalesce(l, []) AS l, n FROM convs LEFT JOIN lists USING (c)),
    steps AS (SELECT c, l, n, unnest(range(0, len(l) + 1)) AS depth FROM whole),
    paths AS MATERIALIZED (SELECT c, depth, md5(array_to_string(l[1:depth], '')) AS k, md5(array_to_string(l[1:depth - 1], '')) AS up,
                CASE WHEN depth = 0 THEN 0 ELSE n[depth] END AS chars, depth = len(l) AS ended FROM steps),
    nodes AS MATERIALIZED (SELECT k, depth, CASE WHEN depth > 0 THEN any_value(up) END AS up, min(c) AS conv_id, count(*) AS n_convs,
                any_value(chars) AS chars, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '') AS ends FROM paths GROUP BY k, depth),
    kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
    sums AS (SELECT p.k, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((v.n_convs - 1) * v.chars)::BIGINT AS saved_tokens
             FROM nodes v JOIN paths p ON p.c = v.conv_id AND p.depth <= v.depth LEFT JOIN kids ON kids.k = v.k GROUP BY p.k)
    SELECT a.conv_id, a.depth, b.conv_id AS parent_conv_id, a.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens,
           sha256(a.ends) AS ends_sha256
    FROM nodes a JOIN sums USING (k) LEFT JOIN nodes b ON b.k = a.up LEFT JOIN kids ON kids.k = a.k
    """,
)
def op11(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query(
    "op12_fill_in_middle",
    """
    WITH given AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    units AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
                ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
              FROM given),
    cuts AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM units),
    parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                     WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cuts)
    SELECT doc_id, len(u) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM parts
    """,
)
def op12(spark, sf_dir):
    return fim.fim_report(table(spark, sf_dir, "documents"))


# The main text of the given pages is what lies in their article element, which is plain enough for patterns there.
@query(
    "op13_html_extraction",
    r"""
    WITH inner_html AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
    bare AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '</?(p|h1|br)>', ' ', 'g') AS t FROM inner_html),
    read AS (SELECT page_id, url, replace(regexp_replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'),
                    '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), chr(160), ' ') AS t FROM bare),
    shown AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM read)
    SELECT page_id, url, text, length(text) AS n_chars FROM shown
    """,
)
def op13(spark, sf_dir):
    return wrapper.extraction_report(table(spark, sf_dir, "pages"))
