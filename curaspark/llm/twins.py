"""SQL twins of the training-data queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS s FROM w)
), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_have AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM both_have JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id, doc_id AS from_id FROM documents
  UNION SELECT links.b, reach.from_id FROM reach JOIN links ON links.a = reach.doc_id
)
SELECT reach.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(from_id)::BIGINT AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.doc_id GROUP BY reach.doc_id
"""

_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS from_id FROM embeddings
  UNION SELECT links.b, reach.from_id FROM reach JOIN links ON links.a = reach.vec_id
), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(from_id)::BIGINT AS component_id, vec_id = min(from_id) AS kept
FROM reach LEFT JOIN degree ON degree.a = vec_id GROUP BY vec_id
"""

# The control strings, and a backslash behind the first letter of each; backslashes are doubled first.
_CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in _CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), said AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learnt,
    sum(24 + length({_escaped("replace(role, chr(10), '')")}) + 2 * (length(role) - length(replace(role, chr(10), ''))) + length({_escaped("text")}))::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM said
"""

def _crc(source: str, column: str) -> str:
    """Recursive tables that give (k, crc) of the texts in ``column`` of ``source``: a step takes one byte off, in eight shifts."""
    bit = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END"
    shifts = "SELECT k, rest, {c} AS c FROM ({inner})"
    inner = "SELECT k, rest[3:] AS rest, xor(c, ('0x' || rest[1:2])::UBIGINT) AS c FROM crc_walk WHERE rest <> ''"
    for _ in range(8):
        inner = shifts.format(c=bit, inner=inner)
    return f"""crc_walk(k, rest, c) AS (
  SELECT {column}, hex(encode({column})), 4294967295::UBIGINT FROM {source} UNION ALL {inner}
), crcs AS (SELECT k, xor(c, 4294967295::UBIGINT) AS crc FROM crc_walk WHERE rest = '')"""


_RESAMPLING = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS row_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents
), b AS (
  SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS k
  FROM benchmark
), u AS (SELECT row_id, unnest(words) AS k FROM w),
known AS (SELECT k FROM u UNION SELECT k FROM b),
{_crc("known", "k")},
buckets AS (SELECT k, (crc % 10000)::BIGINT AS bucket FROM crcs),
sd AS (SELECT bucket, count(*) AS s FROM u JOIN buckets USING (k) GROUP BY bucket),
td AS (SELECT bucket, count(*) AS t FROM b JOIN buckets USING (k) GROUP BY bucket),
gain AS (
  SELECT i.range AS bucket, floor(1000.0 * ln(((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM sd)::DOUBLE + 10000))
    / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM td)::DOUBLE + 10000))))::BIGINT AS gain
  FROM range(10000) i LEFT JOIN sd ON sd.bucket = i.range LEFT JOIN td ON td.bucket = i.range
), sums AS (SELECT row_id, sum(gain)::BIGINT AS total FROM u JOIN buckets USING (k) JOIN gain USING (bucket) GROUP BY row_id),
scored AS (
  SELECT doc_id, row_id, len(words)::BIGINT AS n_features, CASE WHEN len(words) = 0 THEN 0 ELSE (total - ((total % len(words)) + len(words)) % len(words)) // len(words) END::BIGINT AS weight,
    floor(-1000.0 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::UBIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS noise
  FROM w LEFT JOIN sums USING (row_id)
), placed AS (
  SELECT *, weight + noise AS score, n_features >= 20 AS fit,
    row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features) AS place,
    10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS draw
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= draw THEN place END::BIGINT AS rank FROM placed
"""

_TRIE = f"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS place, role, text FROM said
), ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS k FROM own),
{_crc("ids", "k")},
conv AS (SELECT conv_id, conv_id - conv_id % 5 AS base, (crc % 9)::BIGINT AS h FROM ids JOIN crcs USING (k)),
rebuilt AS (
  SELECT c.conv_id, o.place, 0 AS part, o.role, o.text FROM conv c JOIN own o ON o.conv_id = c.base AND o.place <= c.h
  UNION ALL SELECT c.conv_id, o.place, 1, o.role, o.text FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.place > c.h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS d, length(role) || ':' || role || text AS t, strlen(text) AS bytes FROM rebuilt
), chain AS (
  SELECT conv_id, 0::BIGINT AS d, '' AS prefix, ''::VARCHAR AS up, 0::BIGINT AS bytes FROM conv
  UNION ALL SELECT c.conv_id, t.d, md5(c.prefix || md5(t.t)), c.prefix, t.bytes FROM chain c JOIN turns t ON t.conv_id = c.conv_id AND t.d = c.d + 1
), node AS (
  SELECT prefix, any_value(d) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes FROM chain GROUP BY prefix
), lens AS (SELECT conv_id, max(d) AS d FROM chain GROUP BY conv_id),
ends AS (SELECT prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM chain JOIN lens USING (conv_id, d) GROUP BY prefix),
kids AS (SELECT up AS prefix, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY up),
-- a node's smallest member passes all nodes above it
above AS (SELECT c.prefix, x.prefix AS leaf, (x.n - 1) * x.bytes AS saved, k.n_children IS NULL AS childless
  FROM node x LEFT JOIN kids k ON k.prefix = x.prefix JOIN chain c ON c.conv_id = x.conv_id AND c.d <= x.depth),
under AS (SELECT prefix, count(*) FILTER (childless) AS n_leaves, sum(saved) AS saved FROM above GROUP BY prefix)
SELECT node.conv_id, node.depth, p.conv_id AS parent_conv_id, node.n::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN under USING (prefix) LEFT JOIN kids USING (prefix) LEFT JOIN ends USING (prefix) LEFT JOIN node p ON p.prefix = node.up AND node.depth > 0
"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": _JACCARD, "op7_reply_trees": _CHAT, "op9_hamming_index": _VECTORS, "op11_plane_resampling": _RESAMPLING,
    "op12_prefix_trie": _TRIE,
}
