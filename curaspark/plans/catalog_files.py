"""Registered queries over paths, listings, orders and file relations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.functions import paths as P
from curaspark.functions import text as X
from curaspark.operators import agg as A
from curaspark.operators import filters as L
from curaspark.operators import history as H
from curaspark.operators import order as O
from curaspark.operators import relate as R
from curaspark.operators import search as S
from curaspark.plans.tables import MEDIA_SQL, media, table
from curaspark.session import checkpoint, ensure_checkpoint_dir
from curaspark.sources import media as M
from curaspark.sources import sinks as K


def _pages(spark, folder) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"))


def _part(spark, folder) -> DataFrame:
    """Parts as items with dimensions and names."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), "p_name", F.col("p_size").cast("bigint").alias("width"), F.floor(F.col("p_retailprice") / 100).cast("bigint").alias("height"),
        F.array("p_brand", "p_type").alias("models"), F.array("p_name").alias("loras"),
    )


# ------------------------------------------------------------------ names and listings


def path_parts(spark, folder):
    return _pages(spark, folder).select(
        "page_id", P.basename("path").alias("name"), P.stem("path").alias("stem"), P.ext("path").alias("ext"), P.dirname("path").alias("dir"),
        F.array_join(P.relative_tail("path"), "/").alias("tail"),
    )


def media_types(spark, folder):
    on = P.media_type("path", ["video", "gif"])
    return _pages(spark, folder).select(on.alias("media_type")).groupBy("media_type").agg(F.count(F.lit(1)).alias("n_files"))


def count_by_ext(spark, folder):
    return A.count_by_ext(_pages(spark, folder))


def path_filter(spark, folder):
    return _pages(spark, folder).filter(P.path_filter("path", "/en/;/fr/;!blog")).select("page_id", "path")


def scan_filter(spark, folder):
    """Glob listing: html files and names starting with 1, without names containing a 7."""
    return M.scan_filtered(_pages(spark, folder), "*.html;1;!*7*").select("page_id", "path")


def scan_filter_regex(spark, folder):
    return M.scan_filtered(_pages(spark, folder), "/en/[0-9]+$;spam;!shop", "list").select("page_id", "path")


def file_list_scan(spark, folder):
    """JSON path lists per directory, opened again."""
    lists = _pages(spark, folder).select(F.to_json(F.array("path", F.concat("path", F.lit(".bak")))).alias("value"))
    opened = lists.select(F.explode(F.from_json("value", "array<string>")).alias("path"))
    return M.has_extension(opened, [".bak"]).groupBy(P.dirname("path").alias("dir")).agg(F.count(F.lit(1)).alias("n_files"))


def filename_contains(spark, folder):
    return _pages(spark, folder).filter(P.filename_contains("path", ["HTML", "50"])).select("page_id", "path")


def rename_candidates(spark, folder):
    """Image files outside excluded names that do not carry a 12-digit hexadecimal name yet."""
    m = media(spark, folder)
    keep = M.has_extension(m, M.IMAGE_EXTENSIONS).filter(P.scan_filter("path", "!*_2*") & ~P.stem("path").rlike("^[0-9a-f]{12}$"))
    return keep.select("id", "path")


def base_stem_groups(spark, folder):
    return media(spark, folder).groupBy(P.base_stem("path").alias("base_stem")).agg(F.count(F.lit(1)).alias("n_files"), F.min("id").alias("first_id"))


def stem_functions(spark, folder):
    """Base stem, tail, variant stripping and suffix tests of part names written as file names."""
    part = table(spark, folder, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), F.col("p_brand"), F.lit("_"), F.lower("p_type"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    rows = part.select("p_partkey", name.alias("path"))
    s = P.stem("path")
    return rows.select(
        "p_partkey", P.base_stem("path").alias("base_stem"), P.variant_tail("path").alias("tail"), P.strip_variant(s).alias("cut"),
        P.strip_variant(s, strict=True).alias("strict_cut"), P.suffix_matches(s, ["_economy", "small"]).cast("int").alias("known"),
    )


def stem_overflow(spark, folder):
    return A.stem_overflow(media(spark, folder), limit=3)


def stem_prefix_matches(spark, folder):
    m = media(spark, folder)
    queries = m.filter(F.col("path").startswith("/lib/work/")).select(P.base_stem("path").alias("base_stem"))
    return R.stem_matches(queries, m).select("base_stem", "path")


# ------------------------------------------------------------------ filters


def size_filter(spark, folder):
    tree = L.SizeFilter(min_size=(5, 9), max_size=(40, 15), exact_size=(20, 12), size_tolerance=15)
    return L.apply_filter(_part(spark, folder), tree).select("id", "width", "height")


def model_filter(spark, folder):
    tree = L.ModelFilter(["brand#1", "RED"], "include", match_any=False)
    return L.apply_filter(_part(spark, folder), tree).select("id", "p_name")


def filter_tree(spark, folder):
    tree = L.FilterGroup("or", [
        L.FilterGroup("and", [L.SizeFilter(min_size=(10, 0)), L.ModelFilter(["brand#2"], "exclude"), L.SizeFilter()]),
        L.FilterGroup("not", [L.SizeFilter(max_size=(45, 100)), L.ModelFilter(["economy"], match_any=True, include_loras=False)]),
    ])
    tree = L.filter_from_dict(L.filter_to_dict(tree))
    return L.apply_filter(_part(spark, folder), tree, keep=F.col("id") == 3).select("id", "width")


def key_sets(spark, folder):
    """Union, intersection and difference of three selections."""
    p = _part(spark, folder)
    a, b, c = p.filter("width > 30"), p.filter("height > 10"), p.filter("p_name like 'red%'")
    tag = lambda df, n: df.select("id").withColumn("op", F.lit(n))
    return tag(L.union_keys("id", b, c), "union").unionByName(tag(L.intersect_keys("id", a, c), "intersect")).unionByName(tag(L.except_keys(a, "id", b, c), "except"))


def resolution_tests(spark, folder):
    w, h = F.col("width"), F.col("height")
    return _part(spark, folder).select(
        "id", L.higher_than(w, h, 20, 0).cast("int").alias("higher"), L.lower_than(w, h, 30, 10, inclusive=True).cast("int").alias("lower"),
        L.equal_size(w, h, 11, 9).cast("int").alias("equal"),
    )


def dimension_search(spark, folder):
    return L.search_by_dimension(_part(spark, folder), 20, 10, aspect=True, tolerance=0.05).select("id", "match")


def dimension_map(spark, folder):
    return A.dimension_map(_part(spark, folder), "id")


def size_search(spark, folder):
    return S.search_size(_part(spark, folder), "id", "width", "height", (22, 10), 5, 0.3, None).select("id", F.round("score", 6).alias("score"))


def size_pairs(spark, folder):
    p = _part(spark, folder).select("id", F.col("width").alias("w"), F.col("height").alias("h"))
    return S.size_matches(p, p, 2).select("qid", "id", "nq", "ni", F.round("score", 6).alias("score"))


def profile_sets(spark, folder):
    """Directories with the same set of languages, ignoring order and repeats."""
    doc = table(spark, folder, "documents")
    langs = doc.groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("langs"))  # few languages
    return langs.select("source", L.same_set("langs", F.array(*[F.lit(x) for x in ("de", "en", "fr", "es", "en")])).cast("int").alias("same"))


# ------------------------------------------------------------------ orders


def natural_sort(spark, folder):
    cust = table(spark, folder, "customer")
    path = F.concat(F.regexp_replace("c_name", "#0*", " "), F.lit(".png"))
    return O.positions(cust.select(path.alias("path"), "c_custkey"), "name").select("c_custkey", "path", "pos")


def sort_positions(spark, folder):
    """Display positions of one media table in six orders."""
    m = checkpoint(media(spark, folder))
    out = None
    for by, desc in (("type", False), ("size", True), ("name_length", False), ("pixels", True), ("suffix", False), ("full_path", True)):
        part = O.positions(m, by, desc).select("id", F.lit(by).alias("by"), "pos")
        out = part if out is None else out.unionByName(part)
    return out


def sort_by_origin(spark, folder):
    m = checkpoint(media(spark, folder))
    org = R.origins(m).select(F.col("basename").alias("_b"), "origin")
    joined = m.join(org, P.basename("path") == F.col("_b"))
    return O.positions(joined, "related").select("id", "origin", "pos")


def find_cascade(spark, folder):
    m = O.positions(checkpoint(media(spark, folder)), "full_path")
    m = checkpoint(m)
    out = None
    for text in ("/lib/pool/img000000003.png", "img000000005.png", "IMG00000001", "0007_edit", "nothing"):
        part = O.find(m, text).withColumn("asked", F.lit(text))
        out = part if out is None else out.unionByName(part)
    return out.select("asked", "path", "pos", "stage")


def closest_items(spark, folder):
    m = checkpoint(O.positions(media(spark, folder), "full_path"))
    parts = [
        O.closest(m, 700, F.col("width")).select(F.lit("width").alias("by"), "path", "pos"),
        O.closest(m, 950, F.col("height")).select(F.lit("height").alias("by"), "path", "pos"),
        O.closest(m, 9, F.col("size")).select(F.lit("size").alias("by"), "path", "pos"),
        O.closest(m, 17, F.length(P.basename("path"))).select(F.lit("name_length").alias("by"), "path", "pos"),
        O.first_equal(m, P.variant_tail("path"), F.lit("_edit")).select(F.lit("suffix").alias("by"), "path", "pos"),
        O.first_equal(m, P.ext("path"), F.lit(".png")).select(F.lit("type").alias("by"), "path", "pos"),
    ]
    named = checkpoint(O.positions(media(spark, folder), "name"))
    parts.append(O.closest_by_name(named, "img000000010a.png").select(F.lit("name").alias("by"), "path", "pos"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def series_and_nth(spark, folder):
    m = checkpoint(O.positions(media(spark, folder), "name"))
    series = O.select_series(m, F.col("id") == 40, F.col("id") == 20)
    return series.select("id", "pos").unionByName(O.nth(m, 5).select("id", "pos"))


def random_sample(spark, folder):
    m = media(spark, folder)
    return O.sample_one(m, 11).select("id", "path")


def first_rows(spark, folder):
    return O.cap(media(spark, folder), 25).select("id", "path")


def gathered_order(spark, folder):
    """Documents gathered from their sources, every source in its own order."""
    doc = table(spark, folder, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("source").alias("base_dir"),
        F.col("n_chars").alias("size"), F.lit("2024-01-01").cast("timestamp").alias("mtime"), "doc_id",
    )
    prefs = doc.select("base_dir").distinct().select(
        "base_dir", F.when(F.col("base_dir") == "src1", "size").when(F.col("base_dir") == "src2", "full_path").otherwise("name").alias("sort_by"),
        F.col("base_dir").isin("src1", "src3").alias("descending"),
    )
    return M.gather_sorted(doc, prefs).select("doc_id", "base_dir", "pos")


# ------------------------------------------------------------------ relations


def _split(spark, folder):
    m = checkpoint(media(spark, folder))
    return m.filter(F.col("path").startswith("/lib/pool/")), m.filter(~F.col("path").startswith("/lib/pool/"))


def sources_with_downstream(spark, folder):
    return R.sources_with_downstream(*_split(spark, folder))


def downstream_files(spark, folder):
    return R.downstream_files(*_split(spark, folder))


def unrelated_files(spark, folder):
    return R.unrelated_files(checkpoint(media(spark, folder))).select("id", "path")


def downstream_of(spark, folder):
    sources, other = _split(spark, folder)
    return R.downstream_of(sources, other)


def downstream_union(spark, folder):
    m = checkpoint(media(spark, folder)).withColumn("base_dir", P.dirname("path"))
    roots = m.select("base_dir").distinct().withColumn("root_pos", F.when(F.col("base_dir") == "/lib/target", 0).when(F.col("base_dir") == "/lib/work", 1).otherwise(2))
    return R.downstream_union(m.filter(F.col("base_dir") == "/lib/pool"), m, roots)


def resolved_pointers(spark, folder):
    m = checkpoint(media(spark, folder))
    return R.resolve_related(m.filter("related_path is not null"), m, ["/lib/target", "/lib/work"]).select("id", "resolved_path", F.col("found").cast("int").alias("found"))


def redo_parameters(spark, folder):
    m = checkpoint(media(spark, folder))
    return R.redo_params(m, m, ["/lib/target"])


def origin_names(spark, folder):
    return R.origins(media(spark, folder))


def origin_chains(spark, folder):
    """Long pointer chains: every part points at the part with a third of its key."""
    part = table(spark, folder, "part")
    k = F.col("p_partkey")
    chain = part.select(
        F.concat(F.lit("p"), k.cast("string"), F.lit(".png")).alias("path"),
        F.when(k > 2, F.concat(F.lit("p"), F.floor(k / 3).cast("string"), F.lit(".png"))).alias("related_path"),
    )
    return R.origins(chain)


def generate_gate(spark, folder):
    m = checkpoint(media(spark, folder))
    return R.should_generate(m, m.filter(~F.col("path").startswith("/lib/target/")), "_edit", 1).select("path", "n_downstream", F.col("generate").cast("int").alias("generate"))


# ------------------------------------------------------------------ names, mappings, stores


def dedupe_names(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", F.concat("p_name", F.lit(".png")).alias("name"))
    held = table(spark, folder, "nation").select(F.concat(F.lit("red ring"), F.when(F.col("n_nationkey") > 0, F.concat(F.lit("_"), F.col("n_nationkey").cast("string"))).otherwise(""), F.lit(".png")).alias("name")).filter("name in ('red ring.png', 'red ring_2.png', 'red ring_5.png')")
    return H.free_names(part, "name", [F.col("p_partkey")], held).select("p_partkey", "name", "final_name")


def sibling_paths(spark, folder):
    m = checkpoint(media(spark, folder))
    return H.unique_sibling(m.select("id", "path"), "path", "_edit", m).select("id", "free_path")


def mapping_overlay(spark, folder):
    part = table(spark, folder, "part")
    old = part.filter("p_size < 30").select("p_brand", "p_partkey", F.concat(F.lit("old "), F.col("p_name")).alias("new_name"))
    new = part.filter("p_size > 20").select("p_brand", "p_partkey", F.concat(F.lit("new "), F.col("p_name")).alias("new_name"))
    return H.merge_mapping(old, new, ["p_brand", "p_partkey"])


def review_pairs(spark, folder):
    m = media(spark, folder).select("id", P.dirname("path").alias("dir"), P.basename("path").alias("name"))
    mapping = m.filter("id % 3 = 0 and dir = '/lib/work'").select("dir", "name")
    return H.review_rows(m, mapping, ["dir", "name"]).select("id", "name")


def import_marks(spark, folder):
    m = media(spark, folder)
    listed = m.filter("id % 2 = 0").select(P.basename("path").alias("name")).unionByName(m.filter("id % 5 = 0").select(F.concat(F.lit("gone "), P.basename("path")).alias("name")))
    return K.import_marks(m, listed).select("name", "n_found", "path")


def result_checkpoint(spark, folder):
    """A result saved with its input list, loaded for the same inputs and refused for others."""
    m = media(spark, folder)
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/result-{spark.sparkContext.applicationId}-{abs(hash(folder))}"
    K.save_result(m.select("path", "size"), m, place)
    same = K.load_result(spark, m, place)
    other = K.load_result(spark, m.filter("id > 0"), place)
    return same.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("total_size")).withColumn("refused", F.lit(int(other is None)))


QUERIES = {f.__name__: f for f in (
    path_parts, media_types, count_by_ext, path_filter, scan_filter, scan_filter_regex, file_list_scan, filename_contains, rename_candidates,
    base_stem_groups, stem_functions, stem_overflow, stem_prefix_matches, size_filter, model_filter, filter_tree, key_sets, resolution_tests,
    dimension_search, dimension_map, size_search, size_pairs, profile_sets, natural_sort, sort_positions, sort_by_origin, find_cascade,
    closest_items, series_and_nth, random_sample, first_rows, gathered_order, sources_with_downstream, downstream_files, unrelated_files,
    downstream_of, downstream_union, resolved_pointers, redo_parameters, origin_names, origin_chains, generate_gate, dedupe_names,
    sibling_paths, mapping_overlay, review_pairs, import_marks, result_checkpoint,
)}

_PAGES = "page AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages), named AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM page)"
_M = f"WITH RECURSIVE {MEDIA_SQL}"
_ITEM = "item AS (SELECT p_partkey AS id, p_name, p_brand, p_type, p_size::BIGINT AS w, floor(p_retailprice / 100)::BIGINT AS h FROM part)"
_REL = """ AS (related_path = s.path)"""


def _linked(src: str, other: str) -> str:
    """Rows (s, o) of source and derived file: by pointer, by long basename, by letter-only variant stem."""
    return f"""SELECT s.path AS s, o.path AS o FROM {src} s JOIN {other} o ON
      o.related_path = s.path OR (length(o.rname) > 10 AND o.rname = s.name)
      OR (regexp_matches(o.stem, '^.+_[A-Za-z]{{1,8}}$') AND regexp_replace(o.stem, '_[A-Za-z]{{1,8}}$', '') = s.stem)"""


_TWO = f"{_M}, pool AS (SELECT * FROM parts_of WHERE dir = '/lib/pool'), rest AS (SELECT * FROM parts_of WHERE dir <> '/lib/pool')"
_POS = f"{_M}, pos AS (SELECT *, row_number() OVER (ORDER BY lower(path), path) - 1 AS pos, CASE WHEN strpos(stem, '_') > 0 THEN substr(stem, strpos(stem, '_')) ELSE '' END AS tail FROM parts_of)"
_NAMEPOS = "row_number() OVER (ORDER BY split_part(replace(stem, 'img', ''), '_', 1)::INT, CASE WHEN strpos(stem, '_') = 0 THEN '.' ELSE substr(stem, strpos(stem, '_')) END, path) - 1"

ORACLES = {
    "path_parts": f"""WITH {_PAGES}, cut AS (SELECT page_id, name, CASE WHEN regexp_matches(name, '^\\.*[^.].*\\.[^.]*$') THEN regexp_extract(name, '(\\.[^.]*)$', 1) ELSE '' END AS ext,
        regexp_replace(path, '/[^/]*$', '') AS dir FROM named)
      SELECT page_id, name, left(name, length(name) - length(ext)) AS stem, ext, dir,
        array_to_string([x FOR x IN string_split(lower(dir), '/') IF x <> ''][-2:], '/') AS tail FROM cut""",
    "media_types": f"""WITH {_PAGES} SELECT CASE WHEN regexp_matches(lower(path), '\\.html?$|\\.pdf$|\\.svg$') THEN 'unconfigured' WHEN lower(path) LIKE '%.gif' THEN 'gif' ELSE 'image' END AS media_type,
      count(*) AS n_files FROM page GROUP BY 1""",
    "count_by_ext": f"""WITH {_PAGES}, e AS (SELECT CASE WHEN regexp_matches(name, '^\\.*[^.].*\\.[^.]*$') THEN lower(regexp_extract(name, '(\\.[^.]*)$', 1)) ELSE '(no extension)' END AS ext,
        regexp_replace(path, '/[^/]*$', '') AS dir FROM named)
      SELECT ext, count(*) AS n_files FROM e GROUP BY ext UNION ALL SELECT '__total', count(*) FROM e UNION ALL SELECT '__subdirectories', count(DISTINCT dir) FROM e""",
    "path_filter": f"WITH {_PAGES} SELECT page_id, path FROM page WHERE (contains(path, '/en/') OR contains(path, '/fr/')) AND NOT contains(path, 'blog')",
    "scan_filter": f"WITH {_PAGES} SELECT page_id, path FROM named WHERE (name LIKE '%.html' OR name LIKE '1%') AND name NOT LIKE '%7%'",
    "scan_filter_regex": f"WITH {_PAGES} SELECT page_id, path FROM page WHERE (regexp_matches(path, '/en/[0-9]+$') OR contains(path, 'spam')) AND NOT contains(path, 'shop')",
    "file_list_scan": f"WITH {_PAGES} SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS n_files FROM named WHERE name <> '' GROUP BY 1",
    "filename_contains": f"WITH {_PAGES} SELECT page_id, path FROM named WHERE contains(lower(name), 'html') OR contains(name, '50')",
    "rename_candidates": f"{_M} SELECT id, path FROM parts_of WHERE name NOT LIKE '%\\_2%' ESCAPE '\\'",
    "base_stem_groups": f"{_M} SELECT base AS base_stem, count(*) AS n_files, min(id) AS first_id FROM parts_of GROUP BY base",
    "stem_functions": """WITH s AS (SELECT p_partkey, replace(p_name, ' ', '_') || '-' || p_brand || '_' || lower(p_type) || '_' || p_partkey AS s FROM part),
      p AS (SELECT *, regexp_extract(s, '^([^_\\-. ]*)', 1) AS a, regexp_extract(s, '^[^_\\-. ]*[_\\-. ]+([^_\\-. ]*)', 1) AS b, regexp_extract(s, '^[^_\\-. ]*[_\\-. ]+[^_\\-. ]*[_\\-. ]+([^_\\-. ]*)', 1) AS c FROM s),
      q AS (SELECT *, CASE WHEN length(b) <= 4 THEN CASE WHEN length(a) >= 3 THEN a ELSE s END WHEN length(a || '_' || b) >= 10 THEN a || '_' || b
        WHEN length(c) > 4 THEN a || '_' || b || '-' || c ELSE a || '_' || b END AS base_stem FROM p)
      SELECT p_partkey, base_stem, substr(s, length(base_stem) + 1) AS tail, regexp_replace(s, '_[A-Za-z0-9]{1,8}$', '') AS cut, NULL::VARCHAR AS strict_cut,
        CASE WHEN regexp_matches(s, '_(economy|small)_[0-9]+$') THEN 1 ELSE 0 END AS known FROM q""",
    "stem_overflow": f"{_M} SELECT base AS base_stem, count(*) AS n_files, count(*) > 3 AS overflow FROM parts_of GROUP BY base",
    "stem_prefix_matches": f"{_M} SELECT DISTINCT q.base AS base_stem, f.path FROM parts_of q JOIN parts_of f ON q.dir = '/lib/work' AND f.base = q.base",
    "size_filter": f"WITH {_ITEM} SELECT id, w AS width, h AS height FROM item WHERE abs(w - 20) <= 15 AND abs(h - 12) <= 15 AND w >= 5 AND h >= 9 AND w <= 40 AND h <= 15",
    "model_filter": "SELECT p_partkey AS id, p_name FROM part WHERE lower(p_brand) LIKE '%brand#1%' AND (lower(p_name) LIKE '%red%' OR lower(p_type) LIKE '%red%')",
    "filter_tree": f"""WITH {_ITEM} SELECT id, w AS width FROM item WHERE id = 3 OR (w >= 10 AND h >= 0 AND lower(p_brand) NOT LIKE '%brand#2%')
      OR NOT ((w <= 45 AND h <= 100) OR lower(p_type) LIKE '%economy%')""",
    "key_sets": f"""WITH {_ITEM} SELECT id, 'union' AS op FROM item WHERE h > 10 OR p_name LIKE 'red%' UNION ALL SELECT id, 'intersect' FROM item WHERE w > 30 AND p_name LIKE 'red%'
      UNION ALL SELECT id, 'except' FROM item WHERE w > 30 AND NOT h > 10 AND p_name NOT LIKE 'red%'""",
    "resolution_tests": f"WITH {_ITEM} SELECT id, (w > 20)::INT AS higher, (w <= 30 AND h <= 10)::INT AS lower, (w = 11 AND h = 9)::INT AS equal FROM item",
    "dimension_search": f"WITH {_ITEM}, m AS (SELECT id, CASE WHEN w = 20 AND h = 10 THEN 'exact' WHEN h > 0 AND abs(w / h - 2.0) <= 0.05 THEN 'ratio' END AS match FROM item) SELECT * FROM m WHERE match IS NOT NULL",
    "dimension_map": f"""WITH {_ITEM} SELECT w, h, w // gcd(w, h) AS rw, h // gcd(w, h) AS rh, count(*) AS n_items, min(id) AS first_id, max(id) AS last_id FROM item WHERE w > 0 AND h > 0 GROUP BY w, h""",
    "size_search": f"""WITH {_ITEM}, s AS (SELECT id, ((1 - abs(w - 22) / 5.0) + (1 - abs(h - 10) / 5.0)) / 2 AS score FROM item WHERE abs(w - 22) <= 5 AND abs(h - 10) <= 5)
      SELECT id, round(score, 6)::DOUBLE AS score FROM s WHERE score >= 0.3""",
    "size_pairs": f"""WITH {_ITEM}, c AS (SELECT w, h, min(id) AS id, count(*) AS n FROM item GROUP BY w, h)
      SELECT a.id AS qid, b.id, a.n AS nq, b.n AS ni, round(((1 - abs(a.w - b.w) / 2.0) + (1 - abs(a.h - b.h) / 2.0)) / 2, 6)::DOUBLE AS score
      FROM c a JOIN c b ON abs(a.w - b.w) <= 2 AND abs(a.h - b.h) <= 2""",
    "profile_sets": "SELECT source, (list_sort(list(DISTINCT lang)) = ['de', 'en', 'es', 'fr'])::INT AS same FROM documents GROUP BY source",
    "natural_sort": """SELECT c_custkey, regexp_replace(c_name, '#0*', ' ') || '.png' AS path,
      row_number() OVER (ORDER BY CASE WHEN c_custkey = 0 THEN 1000000000 ELSE c_custkey END) - 1 AS pos FROM customer""",
    "sort_positions": f"""{_M}, t AS (SELECT *, CASE WHEN strpos(stem, '_') > 0 THEN substr(stem, strpos(stem, '_')) ELSE '' END AS tail FROM parts_of)
      SELECT id, 'type' AS by, row_number() OVER (ORDER BY lower(path), path) - 1 AS pos FROM t UNION ALL
      SELECT id, 'size', row_number() OVER (ORDER BY size DESC, lower(path) DESC, path) - 1 FROM t UNION ALL
      SELECT id, 'name_length', row_number() OVER (ORDER BY length(name), lower(path), path) - 1 FROM t UNION ALL
      SELECT id, 'pixels', row_number() OVER (ORDER BY width * height DESC, lower(path) DESC, path) - 1 FROM t UNION ALL
      SELECT id, 'suffix', row_number() OVER (ORDER BY tail, name, path) - 1 FROM t UNION ALL
      SELECT id, 'full_path', row_number() OVER (ORDER BY lower(path) DESC, path) - 1 FROM t""",
    "sort_by_origin": f"""{_M}, o AS (SELECT *, base || '.png' AS origin FROM parts_of) SELECT id, origin, row_number() OVER (ORDER BY origin, name, path) - 1 AS pos FROM o""",
    "find_cascade": f"""{_POS}, q AS (SELECT unnest(['/lib/pool/img000000003.png', 'img000000005.png', 'IMG00000001', '0007_edit', 'nothing']) AS asked),
      m AS (SELECT asked, path, pos, CASE WHEN path = asked THEN 1 WHEN name = asked THEN 2 WHEN starts_with(lower(name), lower(asked)) THEN 3 WHEN contains(lower(name), lower(asked)) THEN 4 END AS stage FROM q, pos)
      SELECT asked, path, pos, stage FROM m WHERE stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asked ORDER BY stage, pos) = 1""",
    "closest_items": f"""{_POS}, npos AS (SELECT path, stem, {_NAMEPOS} AS pos FROM parts_of)
      SELECT * FROM (SELECT 'width' AS by, path, pos FROM pos ORDER BY abs(width - 700), pos LIMIT 1) UNION ALL
      SELECT * FROM (SELECT 'height' AS by, path, pos FROM pos ORDER BY abs(height - 950), pos LIMIT 1) UNION ALL
      SELECT * FROM (SELECT 'size' AS by, path, pos FROM pos ORDER BY abs(size - 9), pos LIMIT 1) UNION ALL
      SELECT * FROM (SELECT 'name_length' AS by, path, pos FROM pos ORDER BY abs(length(name) - 17), pos LIMIT 1) UNION ALL
      SELECT * FROM (SELECT 'suffix' AS by, path, pos FROM pos WHERE tail = '_edit' ORDER BY pos LIMIT 1) UNION ALL
      SELECT * FROM (SELECT 'type' AS by, path, pos FROM pos ORDER BY pos LIMIT 1) UNION ALL
      SELECT * FROM (SELECT 'name' AS by, path, pos FROM npos WHERE split_part(replace(stem, 'img', ''), '_', 1)::INT > 10 ORDER BY pos LIMIT 1)""",
    "series_and_nth": f"""{_M}, npos AS (SELECT id, {_NAMEPOS} AS pos FROM parts_of)
      SELECT id, pos FROM npos WHERE pos BETWEEN (SELECT min(pos) FROM npos WHERE id IN (20, 40)) AND (SELECT max(pos) FROM npos WHERE id IN (20, 40))
      UNION ALL SELECT id, pos FROM npos WHERE pos = 4""",
    "random_sample": f"{_M} SELECT id, path FROM media ORDER BY md5(path || ':11'), path LIMIT 1",
    "dedupe_names": """WITH w AS (SELECT p_partkey, p_name || '.png' AS name FROM part),
      held AS (SELECT 'red ring' || CASE WHEN n_nationkey > 0 THEN '_' || n_nationkey ELSE '' END || '.png' AS name FROM nation WHERE n_nationkey IN (0, 2, 5)),
      taken AS (SELECT name FROM w UNION SELECT name FROM held),
      r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) - 1 + (name IN (SELECT name FROM held))::INT AS n FROM w),
      most AS (SELECT name, max(n) + (SELECT count(*) FROM held) + 1 AS k FROM r GROUP BY name),
      free AS (SELECT name, k, regexp_replace(name, '[.]png$', '') || '_' || k || '.png' AS other FROM (SELECT name, unnest(range(1, k + 1)) AS k FROM most)),
      cand AS (SELECT name, other, row_number() OVER (PARTITION BY name ORDER BY k) AS n FROM free WHERE other NOT IN (SELECT name FROM taken))
      SELECT p_partkey, r.name, CASE WHEN r.n = 0 THEN r.name ELSE other END AS final_name FROM r LEFT JOIN cand ON cand.name = r.name AND cand.n = r.n""",
    "first_rows": f"{_M} SELECT id, path FROM media ORDER BY path LIMIT 25",
    "gathered_order": """SELECT doc_id, source AS base_dir, row_number() OVER (ORDER BY source,
        CASE WHEN source = 'src1' THEN -n_chars ELSE 0 END, CASE WHEN source = 'src1' THEN '' END, CASE WHEN source = 'src2' THEN source || '/' || doc_id || '.txt' END,
        CASE WHEN source = 'src3' THEN -doc_id WHEN source IN ('src1', 'src2') THEN 0 ELSE doc_id END,
        CASE WHEN source = 'src1' THEN source || '/' || doc_id || '.txt' END DESC) - 1 AS pos FROM documents""",
    "sources_with_downstream": f"{_TWO} SELECT DISTINCT s AS path FROM ({_linked('pool', 'rest')})",
    "downstream_files": f"{_TWO} SELECT DISTINCT o AS path FROM ({_linked('pool', 'rest')})",
    "unrelated_files": f"{_M}, link AS ({_linked('parts_of', 'parts_of')}) SELECT id, path FROM parts_of WHERE path NOT IN (SELECT s FROM link) AND path NOT IN (SELECT o FROM link)",
    "downstream_of": f"{_TWO} SELECT DISTINCT s.path AS source, o.path FROM pool s JOIN rest o ON o.related_path = s.path OR (length(o.rname) > 10 AND o.rname = s.name)",
    "downstream_union": f"""{_M}, f AS (SELECT DISTINCT o.dir, o.path FROM parts_of s JOIN parts_of o ON s.dir = '/lib/pool' AND s.path <> o.path AND (o.related_path = s.path OR (length(o.rname) > 10 AND o.rname = s.name)))
      SELECT r.dir AS base_dir, (SELECT count(*) FROM f WHERE f.dir = r.dir) AS n_new FROM (SELECT DISTINCT dir FROM parts_of) r""",
    "resolved_pointers": f"""{_M}, r AS (SELECT a.id, a.path, a.related_path, e.path AS exact, b.path AS beside,
        (SELECT c.path FROM parts_of c WHERE c.name = a.rname AND c.dir IN ('/lib/target', '/lib/work') AND c.path <> a.path ORDER BY c.dir, c.path LIMIT 1) AS other
        FROM parts_of a LEFT JOIN parts_of e ON e.path = a.related_path
        LEFT JOIN parts_of b ON b.path = a.dir || '/' || a.rname AND a.dir = '/lib/pool' AND b.path <> a.path WHERE a.related_path IS NOT NULL)
      SELECT id, coalesce(exact, beside, other, related_path) AS resolved_path, (coalesce(exact, beside, other) IS NOT NULL)::INT AS found FROM r""",
    "redo_parameters": f"""{_M}, r AS (SELECT a.*, (SELECT c.path FROM parts_of c WHERE a.related_path IS NOT NULL AND (c.path = a.related_path OR (c.name = a.rname AND c.dir = '/lib/target'))
          ORDER BY c.path <> a.related_path LIMIT 1) AS hit,
        (SELECT min(c.path) FROM parts_of c WHERE c.dir = a.dir AND c.stem = a.base AND c.path <> a.path HAVING count(*) = 1) AS seed FROM parts_of a)
      SELECT path, coalesce(hit, seed, related_path) AS source_path, substr(stem, length(base) + 1) AS edit_suffix FROM r
      WHERE stem <> base AND coalesce(hit, seed, related_path) IS NOT NULL AND NOT regexp_matches(substr(stem, length(base) + 1), '^[_ ]*[0-9]+$')""",
    "origin_names": f"{_M} SELECT DISTINCT name AS basename, base || '.png' AS origin FROM parts_of",
    "origin_chains": """WITH RECURSIVE c AS (SELECT p_partkey AS k, p_partkey AS r FROM part UNION ALL SELECT k, r // 3 FROM c WHERE r > 2)
      SELECT 'p' || k || '.png' AS basename, 'p' || min(r) || '.png' AS origin FROM c GROUP BY k""",
    "generate_gate": f"""{_M}, ent AS (SELECT * FROM parts_of WHERE dir <> '/lib/target'),
      cnt AS (SELECT a.path, count(e.path) AS n FROM parts_of a LEFT JOIN ent e ON
          (e.related_path = a.path OR (length(e.rname) > 10 AND e.rname = a.name) OR (length(e.stem) > length(a.stem) AND starts_with(e.stem, a.stem) AND substr(e.stem, length(a.stem) + 1, 1) = '_'))
          AND (regexp_matches(e.stem, '_(e|ed|edi|edit)$') OR regexp_matches(e.stem, '_[0-9]+$')) GROUP BY a.path)
      SELECT c.path, c.n AS n_downstream, (c.n < 1 AND NOT EXISTS (SELECT 1 FROM ent e WHERE e.path = a.related_path OR (length(a.rname) > 10 AND e.name = a.rname)))::INT AS generate
      FROM cnt c JOIN parts_of a USING (path)""",
    "sibling_paths": f"""{_M}, w AS (SELECT id, path, dir, stem, dir || '/' || stem || '_edit' AS s FROM parts_of)
      SELECT id, CASE WHEN s || '.png' IN (SELECT path FROM media) THEN s || '_1.png' ELSE s || '.png' END AS free_path FROM w""",
    "mapping_overlay": """SELECT p_brand, p_partkey, CASE WHEN p_size > 20 THEN 'new ' ELSE 'old ' END || p_name AS new_name FROM part""",
    "review_pairs": f"{_M} SELECT id, name FROM parts_of WHERE id % 3 = 0 AND dir = '/lib/work'",
    "import_marks": f"""{_M}, q AS (SELECT DISTINCT name FROM parts_of WHERE id % 2 = 0 UNION SELECT 'gone ' || name FROM parts_of WHERE id % 5 = 0)
      SELECT q.name, count(p.path) AS n_found, min(p.path) AS path FROM q LEFT JOIN parts_of p ON p.name = q.name GROUP BY q.name""",
    "result_checkpoint": f"{_M} SELECT count(*) AS n_rows, sum(size)::BIGINT AS total_size, 1 AS refused FROM media",
}
