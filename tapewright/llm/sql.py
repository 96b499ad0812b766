"""SQL with the results of the registered queries, where SQL can express them."""

SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = r"""
WITH d AS (
  SELECT doc_id, source, text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
           WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS total
  FROM s),
r AS (
  SELECT *,
         total - coalesce(sum(cap) OVER (ORDER BY cap / w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW
                                         EXCLUDE GROUP), 0) AS left_,
         sum(w) OVER (ORDER BY cap / w DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_w
  FROM w),
c AS (SELECT *, left_ * w / open_w >= cap AS capped FROM r),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap
              ELSE (total - (SELECT coalesce(sum(cap), 0) FROM c WHERE capped)) * w
                   / (SELECT sum(w) FROM c WHERE NOT capped) END AS target
  FROM c),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS lim,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       greatest(0, least(size, lim - ahead)) + greatest(0, least(size, lim - ahead - source_size)) AS taken,
       CASE WHEN size > 0 AND ahead < lim THEN ahead / target END AS position
FROM p
"""

OP4 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM documents),
keyed AS (
  SELECT doc_id, k, line,
         translate(trim(line, {SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
kept AS (
  SELECT doc_id, k, line, shared.key IS NULL OR keeper = doc_id AS stays
  FROM keyed LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (stays), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""

OP3 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest
  FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> p.page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""

CONTROL = (
    "<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>",
    "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|user|>", "<|assistant|>", "<|system|>",
)
#: One backslash more for each control string, or escaped control string, of a text.
ESCAPES = " + ".join(
    rf"length(regexp_extract_all(text, '{c[0] if c[0] != '[' else chr(92) + '['}{chr(92) * 2}*"
    + "".join(chr(92) + x if x in "|[]" else x for x in c[1:])
    + "'))"
    for c in CONTROL
)
OP9 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn|>' || role || chr(10) || text || '<|end|>' || chr(10)) + {ESCAPES}) AS BIGINT)
         AS formatted_chars
FROM t GROUP BY conv_id
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d),
k AS (SELECT rid, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM s),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
gone AS (
  SELECT DISTINCT rid, i + j AS i
  FROM (SELECT rid, i FROM k JOIN f USING (k) WHERE first < doc_id), (SELECT unnest(range(13)) AS j)),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (
  SELECT rid, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS text
  FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (
  SELECT lang, term, count(*)::HUGEINT AS c FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + v.v) AS p,
         1 + (1000000000::HUGEINT * (kept.c + 1)) // (v.n + v.v) AS lang_p
  FROM g JOIN kept USING (lang) JOIN v USING (lang)
  LEFT JOIN n USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
both_ AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pair.value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - lang_p) * (p - lang_p) // lang_p AS BIGINT)
  FROM p WHERE c > 0 AND p > lang_p)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM both_ QUALIFY part = 'pair' OR rank <= 200
"""


def op13(k: int = 40, rounds: int = 5) -> str:
    """One step of SQL per round: place the vectors, then move the centroids."""
    place = """a{r} AS MATERIALIZED (
  SELECT rid, k, d FROM (
    SELECT rid, k, sum((x - y) * (x - y)) AS d FROM v JOIN c{r} USING (i) GROUP BY rid, k)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1),
"""
    move = """m{r} AS (SELECT k, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} JOIN v USING (rid) GROUP BY k, i),
c{n} AS MATERIALIZED (
  SELECT k, i, coalesce((s - ((s % n) + n) % n) // n, y)::BIGINT AS y FROM c{r} LEFT JOIN m{r} USING (k, i)),
"""
    steps = "".join(place.format(r=r) + move.format(r=r, n=r + 1) for r in range(rounds))
    return f"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = 64),
u AS (SELECT rid, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM e),
ok AS (SELECT rid FROM u GROUP BY rid HAVING count(*) FILTER (isfinite(x)) = 64),
v AS MATERIALIZED (SELECT rid, i, floor(256 * x)::BIGINT AS x FROM u SEMI JOIN ok USING (rid)),
whole AS (SELECT rid, list(x ORDER BY i) AS v FROM v GROUP BY rid),
f AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, 'null')), v) - 1 AS k, rid
  FROM e JOIN whole USING (rid) QUALIFY k < {k}),
c0 AS MATERIALIZED (SELECT k, i, x AS y FROM f JOIN v USING (rid)),
{steps}{place.format(r=rounds)}
h AS (SELECT k, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       centroid_sha256
FROM a{rounds} JOIN e USING (rid) JOIN h USING (k)
"""


ORACLES: dict[str, str] = {
    "op2_mixing": OP2,
    "op3_warc_zip": OP3,
    "op4_line_dedup": OP4,
    "op9_chat_formatting": OP9,
    "op11_substring_dedup": OP11,
    "op12_source_divergence": OP12,
    "op13_centroid_clustering": op13(),
}
