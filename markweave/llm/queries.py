"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from markweave.llm import divergence, embedding_dedup, line_dedup, mixing, packing, pii, prefix_trie, quality, secrets, sharding, simhash, suffix_dedup, token_scan
from markweave.llm.common import read_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs)


def _op3_sql() -> str:
    q, period, block = mixing.quotas(mixing.WEIGHTS, mixing.REST, mixing.PERIOD), mixing.PERIOD, mixing.BLOCK
    quota = f"[{', '.join(str(n) for _, n in q)}]"
    due = f"""list_transform(range(1, {len(q) + 1}), lambda i: CASE WHEN done[i] * {period} // {quota}[i] <= t
              THEN ((done[i] + 1) * {period} + {quota}[i] - 1) // {quota}[i] ELSE {10 * period * period} END)"""
    values = ", ".join(f"('{name}', {i})" for i, (name, _) in enumerate(q[:-1]))
    return f"""
    WITH RECURSIVE edf(t, done, class, k) AS (
      SELECT 0, list_transform(range(1, {len(q) + 1}), lambda i: 0), -1, -1
      UNION ALL
      SELECT t + 1, list_transform(range(1, {len(q) + 1}), lambda i: done[i] + (i = p)::INT), p - 1, done[p]
      FROM (SELECT t, done, list_position({due}, list_min({due})) AS p FROM edf WHERE t < {period})
    ), plan AS (SELECT class, k, t - 1 AS slot FROM edf WHERE t > 0),
    quota AS (SELECT class, count(*) AS q FROM plan GROUP BY class),
    named(source, class) AS (VALUES {values}),
    ranked AS (
      SELECT d.doc_id, d.source, coalesce(n.class, {len(q) - 1}) AS class,
             row_number() OVER (PARTITION BY coalesce(n.class, {len(q) - 1})
               ORDER BY md5(coalesce(d.doc_id::VARCHAR, '') || '#{mixing.SEED}'), d.doc_id) - 1 AS r
      FROM documents d LEFT JOIN named n ON d.source = n.source)
    SELECT doc_id, source, r.class::INT AS mix_class, (r // {block})::BIGINT AS mix_block,
           ((r // {block}) // q * {period} + slot)::BIGINT AS mix_slot, (r % {block})::BIGINT AS mix_offset
    FROM ranked r JOIN quota USING (class) JOIN plan p ON p.class = r.class AND p.k = (r // {block}) % q"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.judge(docs).drop("source", "doc_key", "places")


_WS = r"[\x20\x09-\x0D]+"
_OP7_SQL = f"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '') AS w, t FROM d),
    win AS (SELECT doc_id, unnest(range(1, len(w) - {quality.RUN - 2})) AS i, w FROM w WHERE len(w) >= {quality.RUN}),
    grams AS (SELECT doc_id, i, list_aggregate(w[i:i + {quality.RUN - 1}], 'string_agg', ' ') AS g FROM win),
    spots AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    runs AS (SELECT doc_id, sum(least({quality.RUN}, coalesce(nxt - i, {quality.RUN}))) AS n
             FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM spots) GROUP BY doc_id),
    lines AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS x FROM d),
    worded AS (SELECT * FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
    dups AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM worded GROUP BY doc_id),
    keyed AS (SELECT doc_id, source, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(32) || chr(9) || chr(11) || chr(12) || chr(13),
                'abcdefghijklmnopqrstuvwxyz') AS k FROM worded),
    freq AS (SELECT source, k, min(doc_id) AS first_doc FROM keyed GROUP BY source, k
             HAVING count(DISTINCT doc_id) > {quality.LINE_DOCS} AND count(DISTINCT doc_id) >
               {quality.LINE_SHARE}::DOUBLE * (SELECT count(DISTINCT e.doc_id) FROM d e WHERE e.source = keyed.source)),
    gone AS (SELECT doc_id, sum(len(k)) AS n FROM keyed JOIN freq USING (source, k) WHERE doc_id <> first_doc GROUP BY doc_id),
    c AS (SELECT doc_id, len(w.w)::BIGINT AS n_words,
            len(regexp_replace(t, '{_WS}', '', 'g'))::BIGINT AS word_chars,
            len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(runs.n, 0)::BIGINT AS n_repeat_words,
            coalesce(gone.n, 0)::BIGINT AS n_removed_chars
          FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN gone USING (doc_id)),
    f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
    SELECT *, NOT base_failed AND word_chars - n_removed_chars >= {quality.LEFT_SHARE}::DOUBLE * word_chars AS kept FROM f"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read_table(spark, sf_dir, "documents"))


def _op6_sql() -> str:
    def found(i: int, r: secrets.Rule) -> str:
        rx = r.regex.replace("'", "''")
        return f"""SELECT doc_id, r, {i} AS n, list_transform(range(1, len(m) + 1), lambda i: struct_pack(
              s := (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT,
              z := length(m[i]), ok := length(g[i]) >= {r.least})) AS spans
            FROM (SELECT doc_id, r, regexp_split_to_array(t, '{rx}') AS p, regexp_extract_all(t, '{rx}', 0) AS m,
                         regexp_extract_all(t, '{rx}', {r.group}) AS g FROM d)"""

    kinds = "[" + ", ".join(f"'{r.kind}'" for r in secrets.RULES) + "]"
    base = ", ".join(str(i) for i, r in enumerate(secrets.RULES) if r.base)
    text = f"{kinds}[n + 1] || ':' || s || ':' || (s + z)"
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
    f AS ({' UNION ALL '.join(found(i, r) for i, r in enumerate(secrets.RULES))}),
    x AS (SELECT r, n, u.s AS s, u.z AS z FROM (SELECT r, n, unnest(spans) AS u FROM f) WHERE u.ok),
    a AS (SELECT r, {', '.join(f"count(*) FILTER (n = {i}) AS n_{k.kind}" for i, k in enumerate(secrets.RULES) if k.base)},
            string_agg({text}, ',' ORDER BY s, n) AS spans,
            string_agg({text}, ',' ORDER BY s, n) FILTER (n IN ({base})) AS base FROM x GROUP BY r)
    SELECT doc_id, {', '.join(f"coalesce(n_{k.kind}, 0)::BIGINT AS n_{k.kind}" for k in secrets.RULES if k.base)},
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a USING (r)"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(read_table(spark, sf_dir, "documents"))


_OP4_SQL = r"""
    WITH l AS (SELECT doc_id, i, x, translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
               FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
                            unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
    s AS (SELECT k, min(doc_id) AS first_doc FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1)
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
    FROM (SELECT l.*, s.k IS NOT NULL AND doc_id <> first_doc AS lost FROM l LEFT JOIN s USING (k)) GROUP BY doc_id"""


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"))


_OP8_SQL = f"""
    WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.v, b.v) >= {embedding_dedup.COSINE}),
    r(v, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.v, l.b FROM r JOIN l ON r.w = l.a),
    c AS (SELECT v, min(w) AS component_id FROM r GROUP BY v)
    SELECT v AS vec_id, (SELECT count(*) FROM l WHERE l.a = c.v)::BIGINT AS n_links, component_id,
           v = component_id AS kept FROM c"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read_table(spark, sf_dir, "documents"))


def _inside(at: str) -> str:
    """Whether the byte at a place is not the first one of its code point."""
    return f"substr(x, 2 * ({at}) + 1, 1) IN ('8', '9', 'A', 'B')"


def _steps(at: str, sign: str) -> str:
    """Bytes from a place to the end of its code point (sign +), or to its begin (-)."""
    return f"CASE WHEN NOT {_inside(at)} THEN 0 WHEN NOT {_inside(f'{at} {sign} 1')} THEN 1 WHEN NOT {_inside(f'{at} {sign} 2')} THEN 2 ELSE 3 END"


_OP10_SQL = f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
    w AS (SELECT r, i, md5(substr(x, 2 * i + 1, {2 * suffix_dedup.LENGTH})) AS m FROM
          (SELECT r, x, unnest(range(0, len(x) // 2 - {suffix_dedup.LENGTH - 1})) AS i FROM d WHERE len(x) >= {2 * suffix_dedup.LENGTH})),
    hit AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
    isle AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM
             (SELECT r, i, (i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -9999) > {suffix_dedup.LENGTH})::INT AS fresh FROM hit)),
    span AS (SELECT r, min(i) AS s, max(i) + {suffix_dedup.LENGTH} AS e FROM isle GROUP BY r, g),
    wide AS (SELECT r, x, s, e, s - ({_steps('s', '-')}) AS ps, e + ({_steps('e', '+')}) AS pe FROM span JOIN d USING (r)),
    kept AS (SELECT r, x, s, e, ps, pe, coalesce(lag(e) OVER o, 0) AS p, coalesce(lag(pe) OVER o, 0) AS pp FROM wide WINDOW o AS (PARTITION BY r ORDER BY s)),
    head AS (SELECT r, count(*) AS n, sum(e - s) AS b, max(e) AS last, max(pe) AS plast,
               string_agg(s || ':' || e, ',' ORDER BY s) AS removed,
               string_agg(substr(x, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) AS h,
               string_agg(substr(x, 2 * pp + 1, greatest(0, 2 * (ps - pp))), '' ORDER BY s) AS t FROM kept GROUP BY r)
    SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(b, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
           sha256(unhex(coalesce(h || substr(x, 2 * last + 1), x))) AS kept_sha256,
           (len(x) // 2 - coalesce(b, 0))::BIGINT AS n_kept, coalesce(removed, '') AS removed,
           decode(unhex(coalesce(t || substr(x, 2 * plast + 1), x))) AS kept_text
    FROM d LEFT JOIN head USING (r)"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.document_tokens(read_table(spark, sf_dir, "documents"))


#: Conversations take their first turns from the first one of each 20 ids.
FAMILY = 20


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"), FAMILY).drop("digest")


# crc32 by its bits, as DuckDB has no function for it.
_OP11_SQL = f"""
    WITH t AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, ''))
                 ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
               FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    k AS (SELECT conv_id, l, conv_id - conv_id % {FAMILY} AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda s, c: list_reduce(list_prepend(xor(s, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 4 AS h FROM t),
    c AS (SELECT k.conv_id, list_concat(coalesce(f.l[1:k.h], []), k.l[k.h + 1:]) AS l FROM k LEFT JOIN t f ON f.conv_id = k.b),
    p AS (SELECT conv_id, l[1:d] AS p, d, d = len(l) AS last, l FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM c)),
    n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256,
            CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].x, '[^\x20\x09-\x0D]+')) END AS words FROM p GROUP BY p, d),
    up AS (SELECT u.p[1:a] AS p, u.d, a, u.n_convs, u.words, NOT EXISTS (SELECT 1 FROM n v WHERE v.d = u.d + 1 AND v.p[1:u.d] = u.p) AS leaf
           FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM n) u),
    s AS (SELECT p, a, count(*) FILTER (d = a + 1) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM up GROUP BY p, a)
    SELECT n.conv_id, n.d::BIGINT AS depth, f.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, s.n_children::BIGINT AS n_children,
           s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
    FROM n JOIN s ON s.p = n.p AND s.a = n.d LEFT JOIN n f ON f.d = n.d - 1 AND f.p = n.p[1:n.d - 1]"""


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def _op13_sql() -> str:
    def p(n: str, total: str) -> str:
        return f"(1 + ({divergence.SCALE}::HUGEINT * ({n} + {divergence.PRIOR})) // ({total} + {divergence.PRIOR} * v))::BIGINT"

    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    w AS (SELECT r, lang, source, unnest(w) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
    l AS (SELECT lang, sum(lang_n) AS lang_total, count(*) AS v FROM k GROUP BY lang),
    n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
    g AS (SELECT DISTINCT lang, source FROM d),
    t AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY lang, source),
    p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, {p('coalesce(n.n, 0)', 'coalesce(t.total, 0)')} AS p, {p('k.lang_n', 'l.lang_total')} AS q
          FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n USING (lang, source, term) LEFT JOIN t USING (lang, source)),
    pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x) WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}"""


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_sharding": op2_sharding,
    "op3_source_mixing": op3_source_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_pii": op12_pii,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE_SQL = {
    "op3_source_mixing": _op3_sql(),
    "op4_line_dedup": _OP4_SQL,
    "op6_secret_scan": _op6_sql(),
    "op7_quality_rules": _OP7_SQL,
    "op8_embedding_near_dedup": _OP8_SQL,
    "op10_suffix_dedup": _OP10_SQL,
    "op11_prefix_trie": _OP11_SQL,
    "op13_source_divergence": _op13_sql(),
}
