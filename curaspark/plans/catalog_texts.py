"""Registered queries over prompt texts and metadata, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.functions import meta as M
from curaspark.functions import paths as P
from curaspark.functions import text as X
from curaspark.operators import agg as A
from curaspark.operators import cluster as C
from curaspark.operators import relate as R
from curaspark.operators import search as S
from curaspark.operators.textpairs import text_pairs as join_texts
from curaspark.plans.catalog_vectors import scan_sql
from curaspark.plans.tables import table
from curaspark.scale import spread


def _doc(spark, folder) -> DataFrame:
    return table(spark, folder, "documents")


def _turns(spark, folder) -> DataFrame:
    """Every conversation turn next to the following turn."""
    conv = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    # a turn of a long conversation must not drag the whole conversation into one task
    return spread(conv.join(nxt, ["conv_id", "turn"]).withColumn("turn_key", F.concat_ws("/", "conv_id", "turn")), "turn_key").drop("turn_key")


# ------------------------------------------------------------------ similarity


def text_pairs(spark, folder):
    """Documents as positive and their source as negative prompt."""
    return join_texts(_doc(spark, folder), "doc_id", "text", "source").rows().select("i", "j", F.round("score", 6).alias("score"), "n_i", "n_j")


def text_groups(spark, folder):
    pairs = join_texts(_doc(spark, folder), "doc_id", "text", "source")
    return C.greedy_groups(pairs).select(F.col("id").alias("doc_id"), "group_id", F.round("score", 6).alias("score"))


def text_duplicates(spark, folder):
    pairs = join_texts(_doc(spark, folder), "doc_id", "text", "source")
    return C.duplicates(pairs, 0.95, at_least=True).select("i", "j", F.round("score", 6).alias("score"))


def text_search(spark, folder):
    out = S.search_text_exact(_doc(spark, folder), "doc_id", "text", "source", ["license", "hand"], ["zebra"], 0.85, None)
    return out.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def text_similarity(spark, folder):
    """Whole text score of a turn and the next one."""
    return _turns(spark, folder).select("conv_id", "turn", F.round(X.text_similarity("text", "next_text"), 6).alias("score"))


def fuzzy_words(spark, folder):
    a, b = X.words(X.strip(F.lower("text"))), X.words(X.strip(F.lower("next_text")))
    return _turns(spark, folder).select("conv_id", "turn", F.round(X.fuzzy_word_similarity(a, b), 6).alias("score"))


def edit_distance(spark, folder):
    return _turns(spark, folder).select("conv_id", "turn", F.levenshtein("text", "next_text").alias("distance"))


def related_turns(spark, folder):
    """Whether a turn and the next are related as prompts; the turns of a conversation share their negative side."""
    neg = F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))
    rel = R.is_related("prompts", {"pos": F.col("text"), "neg": neg}, {"pos": F.col("next_text"), "neg": neg})
    return _turns(spark, folder).select("conv_id", "turn", rel.cast("int").alias("related"))


# ------------------------------------------------------------------ prompt rules and text functions


def prompt_rule(spark, folder):
    doc = _doc(spark, folder)
    test = X.prompt_match("text", "source", ["the", "und"], ["src1"])
    return doc.filter(test).select("doc_id", "source")


def prompt_blacklist(spark, folder):
    return _doc(spark, folder).filter(X.prompt_condition("text", ["license", "password", "http"])).select("doc_id", "lang")


def search_terms(spark, folder):
    """Comma terms of whole texts: how many, and the first and last."""
    doc = _doc(spark, folder).select("doc_id", X.search_terms("text").alias("t"))
    return doc.select("doc_id", F.size("t").alias("n_terms"), F.try_element_at("t", F.lit(1)).alias("first_term"), F.try_element_at("t", F.lit(-1)).alias("last_term"))


def escaped_terms(spark, folder):
    """Escaping the commas of a text and splitting it again gives back the one term."""
    doc = _doc(spark, folder)
    joined = X.join_escaped(F.array(F.col("text"), F.col("source")))
    parts = X.split_escaped(joined)
    return doc.select("doc_id", F.size(parts).alias("n_parts"), F.md5(F.element_at(parts, 1)).alias("first_md5"), F.element_at(parts, 2).alias("second"))


def prompt_text(spark, folder):
    """Emphasis stripping, truncation, middle truncation and the strategy cascade."""
    doc = _doc(spark, folder)
    loud = F.concat(F.lit("style BREAK ("), F.col("text"), F.lit(":1.2) [x] <lora:a:0.5>"))
    return doc.select(
        "doc_id", F.md5(X.strip_emphasis(loud)).alias("plain_md5"), F.length(X.truncate_prompt("text")).alias("n_short"),
        P.truncate_middle("text", 40).alias("middle"),
        F.md5(X.prompt_cascade(F.lit("  "), F.when(F.col("lang") == "en", F.col("text")), F.col("source"))).alias("prompt_md5"),
    )


def random_prompt(spark, folder):
    """Reproducible random document with text, emphasis removed."""
    doc = _doc(spark, folder).filter(X.strip("text") != "")
    key = F.md5(F.concat(F.lit("7-"), F.col("doc_id").cast("string")))
    return doc.orderBy(key).limit(1).select("doc_id", F.md5(X.strip_emphasis("text")).alias("prompt_md5"))


def size_text(spark, folder):
    """Three spellings of a size read back."""
    part = table(spark, folder, "part")
    w, h = F.col("p_size").cast("string"), F.floor("p_retailprice").cast("string")
    text = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(w, F.lit(" x "), h)).when(F.col("p_partkey") % 4 == 1, F.concat(w, F.lit(", "), h))
        .when(F.col("p_partkey") % 4 == 2, F.concat(w, F.lit("  "), h)).otherwise(F.col("p_name"))
    )
    return part.select("p_partkey", X.parse_size(text).alias("s")).select("p_partkey", F.col("s.w").alias("w"), F.col("s.h").alias("h"))


def rotation_labels(spark, folder):
    part = table(spark, folder, "part")
    label = F.concat((F.col("p_size") * 30).cast("string"), F.lit("_cw"))
    return part.select("p_partkey", X.rotation_degrees(label).alias("degrees"))


def frame_limits(spark, folder):
    li = table(spark, folder, "lineitem")
    cap = X.frame_cap((F.col("l_quantity") * 100).cast("bigint"), F.lit(25.0), F.lit(None).cast("double"), 120.0, F.col("l_extendedprice") / 100, 500.0)
    return li.select("l_orderkey", "l_linenumber", cap.alias("frames"))


# ------------------------------------------------------------------ equality and identity


def duplicate_docs(spark, folder):
    doc = _doc(spark, folder)
    return R.identical_content(doc, doc, "doc_id", "text").filter("n_a > 1").select(F.col("first_a").alias("doc_id"), F.col("n_a").alias("n_docs"))


def duplicate_docs_loose(spark, folder):
    """Equal up to case and white space, across English and the other languages' labels."""
    doc = _doc(spark, folder)
    out = R.identical_content(doc.filter("lang = 'en'"), doc, "doc_id", "text", normalise=True)
    return out.select(F.col("first_a").alias("doc_id"), "n_a", "n_b")


def set_fingerprint(spark, folder):
    return A.set_id(_doc(spark, folder).select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path")))


# ------------------------------------------------------------------ metadata


def json_props(spark, folder):
    ev = table(spark, folder, "events")
    return ev.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), M.pretty(F.from_json("props", "k bigint")).alias("pretty"))


def workflow_inputs(spark, folder):
    """Node inputs by id and class, and the related pointer, of a graph built per part."""
    g = _graphs(spark, folder)
    return g.select(
        "p_partkey", M.node_input_by_id("graph", "3", "lora_name").alias("by_id"), M.node_input_by_class("graph", "CLIPTextEncode", "text").alias("by_class"),
        M.related_pointer("graph").alias("related"),
    )


def _graphs(spark, folder) -> DataFrame:
    """A workflow graph per part: checkpoint or UNET, two encoders, LoRA, reference node, sampler."""
    part = table(spark, folder, "part")
    text = (
        '{"1":{"class_type":"CheckpointLoaderSimple","inputs":{"ckpt_name":"@brand.safetensors"}},'
        '"2":{"class_type":"UNETLoader","inputs":{"unet_name":"@type.v1.sft"}},'
        '"3":{"class_type":"LoraLoader","inputs":{"lora_name":"lora_@size.pt","strength_model":@odd,"strength_clip":0}},'
        '"4":{"class_type":"CLIPTextEncode","inputs":{"text":"@name"}},'
        '"5":{"class_type":"CLIPTextEncode","inputs":{"text":["8",0]}},'
        '"6":{"class_type":"ReferenceLatent","inputs":{"conditioning":["4",0]}},'
        '"7":{"class_type":"KSampler","inputs":{"positive":["6",0],"negative":["5",0]}},'
        '"8":{"class_type":"Text","inputs":{"value":"no @type"}},'
        '"9":{"class_type":"LoadImage","inputs":{"image":"/lib/@name.png"}}}'
    )
    graph = F.lit(text)
    fields = {"@brand": F.col("p_brand"), "@type": F.col("p_type"), "@size": F.col("p_size").cast("string"), "@name": F.col("p_name"),
              "@odd": (F.col("p_size") % 2).cast("string")}
    for mark, value in fields.items():
        graph = F.replace(graph, F.lit(mark), value)
    return part.select("p_partkey", graph.alias("graph"))


def workflow_models(spark, folder):
    out = M.workflow_models(_graphs(spark, folder), "p_partkey", "graph")
    return out.select("p_partkey", F.array_join("models", "|").alias("models"), F.array_join("loras", "|").alias("loras"))


def workflow_prompts(spark, folder):
    return M.workflow_prompts(_graphs(spark, folder), "p_partkey", "graph")


def params_text(spark, folder):
    """Parameter text blocks built around whole documents."""
    doc = _doc(spark, folder)
    block = F.concat(
        F.col("text"), F.lit(" <lora:style-"), F.col("lang"), F.lit(":0.8> tail <lora:b:1>\nNegative prompt: bad, "), F.col("source"),
        F.lit("\nSteps: 20, Sampler: Euler a, CFG scale: 7, Seed: "), F.col("doc_id").cast("string"),
        F.lit(", Size: 512x768, Model hash: abc, Model: model_"), F.col("lang"), F.lit(", Denoising strength: 0.5, Version: v1"),
    )
    out = M.parse_params_text(doc.select("doc_id", block.alias("block")), "block")
    return out.select("doc_id", F.md5("positive").alias("positive_md5"), "negative", "steps", "seed", "size", "model", F.array_join("loras", "|").alias("loras"))


def tag_lists(spark, folder):
    doc = _doc(spark, folder)
    tags = M.tags(F.to_json(F.array("lang", "source")))
    return doc.select("doc_id", F.size(tags).alias("n_tags"), F.element_at(tags, 2).alias("second"))


QUERIES = {f.__name__: f for f in (
    text_pairs, text_groups, text_duplicates, text_search, text_similarity, fuzzy_words, edit_distance, related_turns, prompt_rule,
    prompt_blacklist, search_terms, escaped_terms, prompt_text, random_prompt, size_text, rotation_labels, frame_limits, duplicate_docs,
    duplicate_docs_loose, set_fingerprint, json_props, workflow_inputs, workflow_models, workflow_prompts, params_text, tag_lists,
)}


# DuckDB measures edit distances in bytes: for them every letter outside ASCII is exchanged for a control code of its own
_CODES = "||".join(f"chr({c})" for c in [*range(1, 9), *range(14, 32)])


def _alphabet(source: str, text: str) -> str:
    return f"""alphabet AS (SELECT string_agg(c, '' ORDER BY c) AS letters FROM (
  SELECT DISTINCT unnest(list_concat(string_split({text}, ''), string_split(lower({text}), ''))) AS c FROM {source}) WHERE ord(c) > 127)"""


def _letters(t: str) -> str:
    return f"translate({t}, (SELECT coalesce(letters, '') FROM alphabet), {_CODES})"


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


_TURNS = f"""{_alphabet('conversations', 'text')},
turns AS (
  SELECT a.conv_id, a.turn, a.text AS ta, b.text AS tb FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),"""


def _words(src: str, key: str, text: str) -> str:
    return f"SELECT DISTINCT {key}, unnest(regexp_split_to_array({_strip(f'lower({text})')}, '[\\s\\p{{Z}}]+')) AS w FROM {src}"


def _pieces(text: str) -> str:
    return f"list_concat(string_split({text}, ','), list_concat(string_split({text}, chr(10)), string_split({text}, chr(13) || chr(10))))"


_LADDER = f"""low AS (SELECT conv_id, turn, ta = '' OR tb = '' AS empty, {_strip('lower(ta)')} AS a, {_strip('lower(tb)')} AS b FROM turns),
ea AS (SELECT DISTINCT conv_id, turn, {_strip('x')} AS e FROM (SELECT conv_id, turn, unnest({_pieces('a')}) AS x FROM low) WHERE {_strip('x')} <> ''),
eb AS (SELECT DISTINCT conv_id, turn, {_strip('x')} AS e FROM (SELECT conv_id, turn, unnest({_pieces('b')}) AS x FROM low) WHERE {_strip('x')} <> ''),
cnt AS (
  SELECT l.*, (SELECT count(*) FROM ea WHERE ea.conv_id = l.conv_id AND ea.turn = l.turn) AS na,
    (SELECT count(*) FROM eb WHERE eb.conv_id = l.conv_id AND eb.turn = l.turn) AS nb,
    (SELECT count(*) FROM ea JOIN eb USING (conv_id, turn, e) WHERE ea.conv_id = l.conv_id AND ea.turn = l.turn) AS k FROM low l)"""
_FUZZY = f"""wa AS ({_words('turns', 'conv_id, turn', 'ta')}), wb AS ({_words('turns', 'conv_id, turn', 'tb')}),
wx AS (SELECT *, {_letters('w')} AS l FROM wa WHERE w <> ''), wy AS (SELECT *, {_letters('w')} AS l FROM wb WHERE w <> ''),
ex AS (SELECT conv_id, turn, w FROM wx JOIN wy USING (conv_id, turn, w)),
pr AS (SELECT wx.conv_id, wx.turn, wx.w AS x, wy.w AS y, wx.l AS lx, wy.l AS ly, contains(wx.w, wy.w) OR contains(wy.w, wx.w) AS sub FROM wx JOIN wy USING (conv_id, turn)
  WHERE wx.w <> wy.w AND length(wx.w) >= 3 AND length(wy.w) >= 3),
fs AS (SELECT conv_id, turn, count(*) FILTER (sub) AS s, count(*) FILTER (NOT sub AND levenshtein(lx, ly) <= 2
    AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.conv_id = pr.conv_id AND ex.turn = pr.turn AND ex.w IN (pr.x, pr.y))) AS f FROM pr GROUP BY 1, 2),
ne AS (SELECT conv_id, turn, count(*) AS e FROM ex GROUP BY 1, 2),
nu AS (SELECT conv_id, turn, count(*) AS u FROM (SELECT conv_id, turn, w FROM wx UNION SELECT conv_id, turn, w FROM wy) GROUP BY 1, 2),
fuzzy AS (SELECT conv_id, turn, (coalesce(e, 0) + 0.8 * coalesce(s, 0) + 0.6 * coalesce(f, 0)) / u::DOUBLE AS fs
  FROM nu LEFT JOIN ne USING (conv_id, turn) LEFT JOIN fs USING (conv_id, turn))"""
_WHOLE = f"{_TURNS} {_LADDER}, {_FUZZY}"
_LADDER_SCORE = """CASE WHEN empty THEN 0.0 WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.9
  WHEN k >= 2 THEN least(0.95, k / (na + nb - k)::DOUBLE * 1.3) WHEN k = 1 THEN k / (na + nb - k)::DOUBLE ELSE least(0.7, coalesce(fs, 0.0)) END"""

_DOC_PAIRS = f"""base AS (SELECT doc_id, {_strip('lower(text)')} AS a, lower(source) AS n, text = '' AS empty FROM documents),
cls AS (SELECT a, n, min(doc_id) AS c, count(*) AS k FROM base WHERE NOT empty GROUP BY a, n),
txt AS (SELECT a, min(c) AS t FROM cls GROUP BY a),
el AS (SELECT DISTINCT t, {_strip('x')} AS e FROM (SELECT t, unnest({_pieces('a')}) AS x FROM txt) WHERE {_strip('x')} <> ''),
ne AS (SELECT t, count(*) AS m FROM el GROUP BY t),
com AS (SELECT p.t AS x, q.t AS y, count(*) AS k FROM el p JOIN el q ON p.e = q.e AND p.t < q.t GROUP BY 1, 2),
jac AS (SELECT x, y, CASE WHEN k >= 2 THEN least(0.95, k / (p.m + q.m - k)::DOUBLE * 1.3) ELSE k / (p.m + q.m - k)::DOUBLE END AS s
  FROM com JOIN ne p ON p.t = x JOIN ne q ON q.t = y),
inside AS (SELECT p.t AS x, q.t AS y FROM txt p JOIN txt q ON p.t < q.t AND (contains(p.a, q.a) OR contains(q.a, p.a))),
pos AS (
  SELECT x, y, 0.9 AS s FROM inside UNION ALL
  SELECT x, y, s FROM jac WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.x = jac.x AND i.y = jac.y) UNION ALL
  SELECT t, t, 1.0 FROM txt),
sided AS (
  SELECT least(p.c, q.c) AS i, greatest(p.c, q.c) AS j, s, p.n AS n1, q.n AS n2, p.k AS k1, q.k AS k2, p.c AS c1
  FROM pos JOIN txt tp ON tp.t = x JOIN txt tq ON tq.t = y JOIN cls p ON p.a = tp.a JOIN cls q ON q.a = tq.a WHERE x <> y OR p.c < q.c),
scored AS (
  SELECT i, j, CASE WHEN c1 = i THEN k1 ELSE k2 END AS n_i, CASE WHEN c1 = i THEN k2 ELSE k1 END AS n_j,
    round(0.7 * s + 0.3 * CASE WHEN n1 = n2 THEN 1.0 WHEN contains(n1, n2) OR contains(n2, n1) THEN 0.9
      WHEN levenshtein(n1, n2) <= 2 THEN 0.3 ELSE 0.0 END, 9) AS score FROM sided
  UNION ALL SELECT c, c, k, k, 1.0 FROM cls WHERE k > 1),
hits AS (SELECT i, j, round(score, 6) AS score, n_i, n_j FROM scored WHERE score >= 0.85)"""

ORACLES = {
    "text_pairs": f"WITH {_DOC_PAIRS} SELECT * FROM hits",
    "text_groups": f"""WITH RECURSIVE {_DOC_PAIRS},
      own AS (SELECT doc_id AS id, c FROM base JOIN cls USING (a, n) WHERE NOT empty),
      each AS (
        SELECT least(p.id, q.id) AS i, greatest(p.id, q.id) AS j, score AS s FROM hits JOIN own p ON p.c = hits.i JOIN own q ON q.c = hits.j
        WHERE hits.i <> hits.j OR p.id < q.id),
      {scan_sql("SELECT i, j, s FROM each")}
      SELECT id AS doc_id, group_id, round(score, 6) AS score FROM scanned""",
    "text_duplicates": f"WITH {_DOC_PAIRS} SELECT i, j, score FROM hits WHERE score >= 0.95",
    "text_search": f"""WITH {_alphabet('documents', 'text')},
      low AS (SELECT doc_id, {_strip('lower(text)')} AS a, lower(source) AS n, text = '' AS empty FROM documents),
      w AS ({_words('documents', 'doc_id', 'text')}),
      fz AS (SELECT doc_id, least(0.7, (0.8 * count(*) FILTER (length(w) >= 3 AND contains('zebra', w)) +
          0.6 * count(*) FILTER (length(w) >= 3 AND NOT contains('zebra', w) AND levenshtein({_letters('w')}, 'zebra') <= 2)) / (count(*) + 1)) AS s
        FROM w WHERE w <> '' GROUP BY doc_id),
      sc AS (SELECT doc_id, CASE WHEN a IN ('license', 'hand') THEN 1.0 WHEN contains(a, 'license') OR contains(a, 'hand') THEN 0.9 ELSE 0.0 END
          - 0.5 * CASE WHEN contains(a, 'zebra') THEN 0.9 ELSE fz.s END AS score FROM low LEFT JOIN fz USING (doc_id) WHERE NOT empty)
      SELECT doc_id, round(score, 6) AS score FROM sc WHERE round(score, 9) >= 0.85""",
    "text_similarity": f"WITH {_WHOLE} SELECT conv_id, turn, round({_LADDER_SCORE}, 6)::DOUBLE AS score FROM cnt LEFT JOIN fuzzy USING (conv_id, turn)",
    "related_turns": f"""WITH {_WHOLE} SELECT conv_id, turn, CASE WHEN 0.7 * ({_LADDER_SCORE}) + 0.3 > 0.8 THEN 1 ELSE 0 END::INT AS related
      FROM cnt LEFT JOIN fuzzy USING (conv_id, turn)""",
    "fuzzy_words": f"WITH {_TURNS} {_FUZZY} SELECT conv_id, turn, round(fs, 6)::DOUBLE AS score FROM fuzzy",
    "edit_distance": f"WITH {_TURNS} x AS (SELECT 1) SELECT conv_id, turn, levenshtein({_letters('ta')}, {_letters('tb')})::INT AS distance FROM turns",
    "prompt_rule": """SELECT doc_id, source FROM documents WHERE text IS NOT NULL
      AND (contains(lower(text), 'the') OR contains(lower(text), 'und')) AND contains(lower(source), 'src1')""",
    "prompt_blacklist": """SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'password') OR contains(lower(text), 'http')""",
    "search_terms": f"""WITH t AS (SELECT doc_id, [{_strip('x')} FOR x IN string_split(text, ',') IF {_strip('x')} <> ''] AS t FROM documents)
      SELECT doc_id, len(t)::INT AS n_terms, t[1] AS first_term, t[-1] AS last_term FROM t""",
    "escaped_terms": "SELECT doc_id, 2::INT AS n_parts, md5(text) AS first_md5, source AS second FROM documents",
    "prompt_text": """WITH loud AS (SELECT doc_id, substr('style BREAK (' || text || ':1.2) [x] <lora:a:0.5>', 13) AS t, text, lang, source FROM documents),
      cut AS (SELECT *, regexp_replace(regexp_replace(translate(t, '()[]', ''), ':[0-9]*\\.[0-9]+', '', 'g'), '<[^>]*>', '', 'g') AS p FROM loud)
      SELECT doc_id, md5(p) AS plain_md5, CASE WHEN length(text) > 2000 THEN 2003 ELSE length(text) END::INT AS n_short,
        CASE WHEN length(text) <= 40 THEN text ELSE left(text, 18) || '...' || right(text, 21) END AS middle,
        md5(CASE WHEN lang = 'en' AND trim(text) <> '' THEN text ELSE source END) AS prompt_md5 FROM cut""",
    "random_prompt": f"""SELECT doc_id, md5(regexp_replace(regexp_replace(translate(CASE WHEN contains(text, 'BREAK') THEN substr(text, instr(text, 'BREAK') + 6) ELSE text END, '()[]', ''),
        ':[0-9]*\\.[0-9]+', '', 'g'), '<[^>]*>', '', 'g')) AS prompt_md5
      FROM documents WHERE {_strip('text')} <> '' ORDER BY md5('7-' || doc_id) LIMIT 1""",
    "size_text": """SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_size END::BIGINT AS w, CASE WHEN p_partkey % 4 < 3 THEN floor(p_retailprice) END::BIGINT AS h FROM part""",
    "rotation_labels": "SELECT p_partkey, CASE WHEN (p_size * 30) % 90 = 0 THEN (p_size * 30) % 360 END::INT AS degrees FROM part",
    "frame_limits": """WITH f AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 100 AS BIGINT) AS n, l_extendedprice / 100 AS mb FROM lineitem),
      s AS (SELECT *, CASE WHEN mb > 500 THEN greatest(30.0, 120.0 * 500 / mb) ELSE 120.0 END AS sec FROM f)
      SELECT l_orderkey, l_linenumber, CASE WHEN n <= 0 OR n / 25.0 <= sec THEN n ELSE greatest(1, floor(25.0 * sec)) END::BIGINT AS frames FROM s""",
    "duplicate_docs": "SELECT min(doc_id) AS doc_id, count(*) AS n_docs FROM documents GROUP BY text HAVING count(*) > 1",
    "duplicate_docs_loose": """WITH k AS (SELECT doc_id, lang, regexp_replace(lower(trim(text, ' ')), '\\s+', ' ', 'g') AS t FROM documents)
      SELECT min(doc_id) FILTER (lang = 'en') AS doc_id, count(*) FILTER (lang = 'en') AS n_a, count(*) AS n_b FROM k GROUP BY t HAVING count(*) FILTER (lang = 'en') > 0""",
    "set_fingerprint": """WITH p AS (SELECT DISTINCT md5(source || '/' || doc_id) AS h FROM documents),
      f AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT) AS s, bit_xor(('0x' || substr(h, 17, 15))::BIGINT) AS x FROM p)
      SELECT n, sha256(n || ':' || s || ':' || x) AS set_id FROM f""",
    "json_props": """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '{' || chr(10) || '  "k" : ' || json_extract_string(props, '$.k') || chr(10) || '}' AS pretty FROM events""",
    "workflow_inputs": "SELECT p_partkey, 'lora_' || p_size || '.pt' AS by_id, p_name AS by_class, '/lib/' || p_name || '.png' AS related FROM part",
    "workflow_models": """SELECT p_partkey, p_brand || '|' || p_type || '.v1' AS models, CASE WHEN p_size % 2 = 1 THEN 'lora_' || p_size ELSE '' END AS loras FROM part""",
    "workflow_prompts": "SELECT p_partkey, p_name AS positive, 'no ' || p_type AS negative FROM part",
    "params_text": f"""SELECT doc_id, md5({_strip("text || ' '")}) AS positive_md5, 'bad, ' || source AS negative, '20' AS steps, doc_id::VARCHAR AS seed, '512x768' AS size,
      'model_' || lang AS model, 'style-' || lang || '|b' AS loras FROM documents""",
    "tag_lists": "SELECT doc_id, 2::INT AS n_tags, source AS second FROM documents",
}
