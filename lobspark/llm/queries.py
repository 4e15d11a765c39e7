"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.llm.collocations import collocations
from lobspark.llm.common import table
from lobspark.llm.embeddings import near_vectors
from lobspark.llm.hostrules import host_rules
from lobspark.llm.html import extract
from lobspark.llm.langid import held_out, language_id
from lobspark.llm.licenses import license_scan, template_regex
from lobspark.llm.media import document_media
from lobspark.llm.merkle import document_manifest
from lobspark.llm.nbest import encode_digests
from lobspark.llm.packing import pack
from lobspark.llm.simhash import simhash_dedup
from lobspark.llm.substring import substring_dedup
from lobspark.llm.suffix import suffix_dedup
from lobspark.llm.wordings import WORDINGS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents")).select("row.doc_id", "fingerprint", "component_id")


@query(
    "op2_suffix_array",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) x FROM documents),
    n AS (SELECT doc_id, x, length(x) // 2 AS n_bytes FROM d),
    w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, x, unnest(range(0, greatest(n_bytes - 199, 0))) AS i FROM n)),
    r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
    c AS (SELECT doc_id, i, i + 200 AS j, max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w JOIN r USING (k)),
    s AS (SELECT doc_id, i, j, sum(CASE WHEN before IS NULL OR i > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
    m AS (SELECT doc_id, run, min(i) AS a, max(j) AS b FROM s GROUP BY ALL),
    g AS (SELECT doc_id, list(a ORDER BY a) AS la, list(b ORDER BY a) AS lb, sum(b - a) AS removed, count(*) AS spans FROM m GROUP BY doc_id)
    SELECT n.doc_id, n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
           CASE WHEN la IS NULL THEN sha256(unhex(x))
                ELSE sha256(unhex(list_aggregate(list_transform(range(0, len(la) + 1), lambda q: substr(x, 2 * (CASE WHEN q = 0 THEN 0 ELSE lb[q] END) + 1, 2 * ((CASE WHEN q = len(la) THEN n_bytes ELSE la[q + 1] END) - (CASE WHEN q = 0 THEN 0 ELSE lb[q] END)))), 'string_agg', ''))) END AS kept_sha256
    FROM n LEFT JOIN g USING (doc_id)
    """,
)
def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query(
    "op3_substring",
    r"""
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    k AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 49, 0))) AS i FROM d)),
    f AS (SELECT k, min(doc_id) AS first_id FROM k GROUP BY k),
    c AS (SELECT k.doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN f USING (k) WHERE k.doc_id > first_id),
    u AS (SELECT doc_id, list(DISTINCT p) AS gone FROM c GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
           sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE (SELECT coalesce(list(w[q + 1] ORDER BY q), []) FROM (SELECT unnest(range(0, len(w))) AS q) WHERE NOT list_contains(gone, q)) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN u USING (doc_id)
    """,
)
def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents")).select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


@query("op7_nbest_pieces")
def op7_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents")).select("row.doc_id", "n_chars", "n_pieces", "best_score", "n_found", "last_score", "ids_crc32", "nbest_crc32", "round_trip")


@query("op8_media_sequences")
def op8_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"))


@query(
    "op9_embedding_dedup",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, e, CASE WHEN e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN sqrt(list_dot_product(e, e)) END AS n
      FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
    r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
    k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
    """,
)
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


WORDING_SQL = ", ".join(f"CASE WHEN regexp_matches(j, '{template_regex(t)}') THEN '{label}' END" for label, t in WORDINGS)


@query(
    "op10_license_scan",
    r"""
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j,
                 list_filter(range(0, len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by') AS cc,
                 list_filter(range(0, len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl,
                 list_filter(range(0, len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved') AS res FROM d),
    m AS (SELECT *, list_concat(cc, list_concat(gpl, res)) AS every,
                 list_filter([CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(res) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS base,
                 list_filter([CASE WHEN regexp_matches(j, ' under the (terms of the )?mit license ') THEN 'mit' END,
                              CASE WHEN contains(j, ' licensed under the apache license ') THEN 'apache' END,
                              CASE WHEN regexp_matches(j, ' licensed under ((a|the) )?(creative commons )?cc by nc ') THEN 'cc-by-nc' END,
                              CASE WHEN regexp_matches(j, ' licensed under ((a|the) )?(creative commons )?cc by sa ') THEN 'cc-by-sa' END,
                              CASE WHEN regexp_matches(j, ' licensed under the gnu ((lesser|affero) )?general public license ') THEN 'gnu-gpl' END,
                              CASE WHEN regexp_matches(j, ' under the bsd ([23] )?(clause )?license ') THEN 'bsd' END,
                              /*wordings*/], lambda x: x IS NOT NULL) AS more FROM p)
    SELECT doc_id, len(w)::BIGINT AS n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT AS first_word, list_max(every)::BIGINT AS last_word,
           array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, more))), ',') AS labels,
           CASE WHEN len(more) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
    FROM m
    """.replace("/*wordings*/", WORDING_SQL),
)
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query(
    "op11_host_rules",
    r"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d))),
    r AS (SELECT doc_id, sum(least(3, coalesce(i - before, 3)))::BIGINT AS n_repeat_words FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g WHERE c > 1) GROUP BY doc_id),
    m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                 len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
          FROM d LEFT JOIN r USING (doc_id)),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words AS f2, 10 * n_dup_lines > 3 * n_lines AS f3,
                 n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words) AS f4 FROM m),
    h AS (SELECT source, 'base' AS rule, count(*) AS n, sum(base_failed::INT) AS k FROM f GROUP BY source UNION ALL SELECT source, 'symbols', count(*), sum(f2::INT) FROM f GROUP BY source
          UNION ALL SELECT source, 'lines', count(*), sum(f3::INT) FROM f GROUP BY source UNION ALL SELECT source, 'word_length', count(*), sum(f4::INT) FROM f GROUP BY source),
    p AS (SELECT rule, coalesce(avg(k / n::DOUBLE) FILTER (WHERE n > 1), sum(k)::DOUBLE / sum(n)) AS m1, avg((k / n::DOUBLE) * ((k - 1) / (n - 1)::DOUBLE)) FILTER (WHERE n > 1) AS m2 FROM h GROUP BY rule),
    s AS (SELECT source, rule, n, k, m1, CASE WHEN m2 > m1 * m1 THEN (m1 - m2) / (m2 - m1 * m1) END AS strength FROM h JOIN p USING (rule)),
    v AS (SELECT source, rule, CASE WHEN strength IS NULL THEN m1 ELSE (k + m1 * strength) / (n + strength) END AS rate FROM s),
    b AS (SELECT source, max(CASE WHEN rule = 'base' THEN rate END) AS r1, max(CASE WHEN rule = 'symbols' THEN rate END) AS r2, max(CASE WHEN rule = 'lines' THEN rate END) AS r3, max(CASE WHEN rule = 'word_length' THEN rate END) AS r4 FROM v GROUP BY source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR r1 > 0.8 OR (r2 > 0.3 AND f2) OR (r3 > 0.3 AND f3) OR (r4 > 0.3 AND f4)) AS kept,
           CASE WHEN r1 > 0.8 THEN 'rejected' WHEN greatest(r1, r2, r3, r4) > 0.3 THEN 'doubtful' ELSE 'trusted' END AS host_verdict
    FROM f JOIN b ON f.source IS NOT DISTINCT FROM b.source
    """,
)
def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents")).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_verdict")


@query(
    "op12_merkle_manifest",
    r"""
    WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
    x AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda y: ascii(y)::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 5 = 0 AS hit
          FROM documents, tab),
    y AS (SELECT doc_id, source, hit, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                 coalesce(strlen(text) || ':' || text, '-') AS t, coalesce(strlen(low) || ':' || low, '-') AS u FROM x),
    l AS (SELECT doc_id, source, coalesce('+' || source, '') AS g, sha256(head || t) AS leaf, sha256(head || CASE WHEN hit THEN u ELSE t END) AS now,
                 row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(head || t)) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM y),
    a(g, lev, pos, n, d) AS (SELECT g, 0, pos, n, leaf FROM l UNION ALL SELECT g, lev + 1, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM a WHERE n > 1 GROUP BY g, lev, pos // 16, n),
    r AS (SELECT g, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
    b(lev, pos, n, d) AS (SELECT 0, pos, n, subroot FROM r UNION ALL SELECT lev + 1, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM b WHERE n > 1 GROUP BY lev, pos // 16, n),
    sa AS (SELECT p.g, p.lev, p.pos, coalesce(string_agg(q.d, '' ORDER BY q.pos) FILTER (q.pos < p.pos), '') AS lft, coalesce(string_agg(q.d, '' ORDER BY q.pos) FILTER (q.pos > p.pos), '') AS rgt
           FROM a p JOIN a q ON p.g = q.g AND p.lev = q.lev AND p.pos // 16 = q.pos // 16 WHERE p.n > 1 GROUP BY ALL),
    sb AS (SELECT p.lev, p.pos, coalesce(string_agg(q.d, '' ORDER BY q.pos) FILTER (q.pos < p.pos), '') AS lft, coalesce(string_agg(q.d, '' ORDER BY q.pos) FILTER (q.pos > p.pos), '') AS rgt
           FROM b p JOIN b q ON p.lev = q.lev AND p.pos // 16 = q.pos // 16 WHERE p.n > 1 GROUP BY ALL),
    fa(doc_id, g, leaf, lev, pos, n, d, seen) AS (SELECT doc_id, g, leaf, 0, pos, n, now, '' FROM l
       UNION ALL SELECT fa.doc_id, fa.g, leaf, fa.lev + 1, fa.pos // 16, (n + 15) // 16, sha256(lft || d || rgt), seen || lft || rgt FROM fa JOIN sa ON fa.g = sa.g AND fa.lev = sa.lev AND fa.pos = sa.pos WHERE n > 1),
    fb(doc_id, g, leaf, lev, pos, n, d, seen) AS (SELECT doc_id, fa.g, leaf, 0, r.pos, r.n, d, seen FROM fa JOIN r USING (g) WHERE fa.n = 1
       UNION ALL SELECT doc_id, g, leaf, fb.lev + 1, fb.pos // 16, (n + 15) // 16, sha256(lft || d || rgt), seen || lft || rgt FROM fb JOIN sb ON fb.lev = sb.lev AND fb.pos = sb.pos WHERE n > 1)
    SELECT doc_id, leaf, subroot, (SELECT d FROM b WHERE n = 1) AS root, sha256(seen) AS proof_sha256, d AS folded_root, d = (SELECT d FROM b WHERE n = 1) AS verified FROM fb JOIN r USING (g) WHERE fb.n = 1
    """,
)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(table(spark, sf_dir, "documents")).select("row.doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query(
    "op13_collocations",
    r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
    o AS (SELECT lang, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
    f AS (SELECT lang, k, w[i : i + k - 1] AS w, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 100),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
    c AS (SELECT lang, phrase, k, w, f AS a, unnest(range(1, k)) AS j FROM f WHERE k > 1),
    s AS (SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, j, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
          FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1 : c.k], ' ') JOIN n ON n.lang = c.lang),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS q FROM s) WHERE q = 1),
    i AS (SELECT lang, array_to_string(w[q : q + size - 1], ' ') AS phrase, max(f) AS longer
          FROM (SELECT lang, w, k, f, size, unnest(range(1, k - size + 2)) AS q FROM (SELECT lang, w, k, f, unnest(range(2, k)) AS size FROM f WHERE k > 2)) GROUP BY ALL)
    SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
                   FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR longer < a) WHERE rank <= 2000
    """,
)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
