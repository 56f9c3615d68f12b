"""Relations between files: stems, related-file pointers, origins and generation gates.

Media tables have ``path`` and, where pointers matter, ``related_path``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions import paths as P
from curaspark.scale import chase_parents
from curaspark.session import checkpoint

# Fixed value: basenames must be longer than this to relate files on their own.
MIN_NAME = 10


def _lengths(df: DataFrame, text: Column) -> list[int]:
    """Distinct text lengths; file names are bounded, so this is a short list."""
    return sorted(r[0] for r in df.select(F.length(text)).distinct().collect() if r[0])


def _prefixes(df: DataFrame, text: Column, lengths: list[int], name: str, proper: bool = False) -> DataFrame:
    """One row per prefix of ``text`` whose length occurs among the keys."""
    room = F.length(text) - 1 if proper else F.length(text)
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= room)
    return df.withColumn("_k", F.explode(sizes)).withColumn(name, F.left(text, F.col("_k"))).drop("_k")


def stem_matches(queries: DataFrame, files: DataFrame, base: str = "base_stem", path: str = "path", more: Sequence[str] = ()) -> DataFrame:
    """Files whose stem starts with a base stem at a boundary: (base_stem, path, more...).

    A prefix join: every file stem is cut to the lengths the base stems have and joined by equality.
    """
    keys = queries.select(F.col(base).alias("base_stem")).filter(F.col("base_stem") != "").distinct()
    cut = _prefixes(files.select(path, *more).withColumn("_stem", P.stem(path)), F.col("_stem"), _lengths(keys, F.col("base_stem")), "base_stem")
    return cut.join(keys, "base_stem").filter(P.boundary_ok("_stem", "base_stem")).select("base_stem", path, *more)


def _strict_prefix(df: DataFrame) -> DataFrame:
    return df.select(
        P.strip_variant(P.stem("path"), strict=True).alias("k_stem"), F.lower(P.ext("path")).alias("k_ext")
    ).filter("k_stem is not null").distinct()


def _named_related(df: DataFrame) -> Column:
    return F.when(F.length(P.basename("related_path")) > MIN_NAME, P.basename("related_path"))


def sources_with_downstream(sources: DataFrame, other: DataFrame) -> DataFrame:
    """Sources some file of ``other`` points at, by path, by long basename, or by variant stem."""
    src = sources.select("path").withColumn("k_name", P.basename("path")).withColumn("k_stem", P.stem("path")).withColumn(
        "k_ext", F.lower(P.ext("path"))
    )
    exact = other.filter("related_path is not null").select(F.col("related_path").alias("path")).distinct()
    named = other.select(_named_related(other).alias("k_name")).filter("k_name is not null").distinct()
    hits = (
        src.join(exact, "path", "left_semi").select("path")
        .unionByName(src.join(named, "k_name", "left_semi").select("path"))
        .unionByName(src.join(_strict_prefix(other), ["k_stem", "k_ext"], "left_semi").select("path"))
    )
    return hits.distinct()


def downstream_files(sources: DataFrame, other: DataFrame) -> DataFrame:
    """Files of ``other`` that derive from any source."""
    cand = other.select(
        "path", "related_path", _named_related(other).alias("k_name"),
        P.strip_variant(P.stem("path"), strict=True).alias("k_stem"), F.lower(P.ext("path")).alias("k_ext"),
    )
    by_path = sources.select(F.col("path").alias("related_path")).distinct()
    by_name = sources.select(P.basename("path").alias("k_name")).filter(F.length("k_name") > MIN_NAME).distinct()
    by_stem = sources.select(P.stem("path").alias("k_stem"), F.lower(P.ext("path")).alias("k_ext")).distinct()
    hits = (
        cand.join(by_path, "related_path", "left_semi").select("path")
        .unionByName(cand.join(by_name, "k_name", "left_semi").select("path"))
        .unionByName(cand.join(by_stem, ["k_stem", "k_ext"], "left_semi").select("path"))
    )
    return hits.distinct()


def unrelated_files(media: DataFrame) -> DataFrame:
    """Files without a relation to another file of the same set, in either direction."""
    linked = sources_with_downstream(media, media).unionByName(downstream_files(media, media)).distinct()
    return media.join(linked, "path", "left_anti")


def downstream_of(sources: DataFrame, other: DataFrame) -> DataFrame:
    """(source, path) for files pointing at a source by path or by long basename, the source itself excluded."""
    src = sources.select(F.col("path").alias("source"), P.basename("path").alias("k_name"))
    cand = other.select("path", "related_path", _named_related(other).alias("k_name")).filter("related_path is not null")
    by_path = cand.join(src.select("source"), F.col("related_path") == F.col("source")).select("source", "path")
    by_name = cand.join(src, "k_name").select("source", "path")
    return by_path.unionByName(by_name).filter(F.col("source") != F.col("path")).distinct()


def downstream_union(sources: DataFrame, other: DataFrame, roots: DataFrame) -> DataFrame:
    """New downstream files per root: each file counts for the first root (by root_pos) containing it."""
    found = downstream_of(sources, other).select("path").distinct()
    owned = found.join(other.select("path", "base_dir"), "path").join(roots, "base_dir")
    first = owned.groupBy("path").agg(F.min(F.struct("root_pos", "base_dir")).alias("r"))
    counts = first.groupBy(F.col("r.base_dir").alias("base_dir")).agg(F.count(F.lit(1)).alias("n_new"))
    return roots.join(counts, "base_dir", "left").select("base_dir", F.coalesce("n_new", F.lit(0)).cast("bigint").alias("n_new"))


# ------------------------------------------------------------------ pointer resolution


def resolve_related(df: DataFrame, files: DataFrame, extra_dirs: list[str] | None = None) -> DataFrame:
    """Add (resolved_path, found) to rows with a related pointer.

    The exact path; else the same name beside the file when the last directory names agree; else
    the same name in the extra directories (first directory, then first path); else unresolved.
    """
    known = files.select(F.col("path").alias("_known")).distinct()
    pointer = F.nullif(F.col("related_path"), F.lit(""))
    rows = df.withColumn("_ptr", pointer)
    n = F.least(F.size(P.relative_tail("path")), F.size(P.relative_tail("_ptr")))

    def tail(c: str) -> Column:
        parts = P.relative_tail(c)
        return F.slice(parts, F.size(parts) - n + 1, n)

    agree = (n > 0) & (tail("path") == tail("_ptr")) & F.contains("_ptr", F.lit("/"))
    beside = F.concat_ws("/", P.dirname("path"), P.basename("_ptr"))
    rows = rows.withColumn("_beside", F.when(agree & (beside != F.col("path")), beside))
    rows = rows.join(known.withColumnRenamed("_known", "_exact"), F.col("_ptr") == F.col("_exact"), "left")
    rows = rows.join(known.withColumnRenamed("_known", "_alias"), F.col("_beside") == F.col("_alias"), "left")
    resolved = F.coalesce("_exact", "_alias")
    if extra_dirs:
        place = F.coalesce(
            *[F.when(F.startswith("path", F.lit(d.rstrip("/") + "/")), F.lit(i)) for i, d in enumerate(extra_dirs)]
        )
        # two first choices are enough: one of them differs from the asking file
        named = files.select("path", place.alias("_o")).filter("_o is not null").groupBy(P.basename("path").alias("_nm")).agg(
            F.min(F.struct("_o", "path")).alias("_c1"), F.min_by(F.struct("_o", "path"), F.struct("_o", "path")).alias("_c0")
        )
        second = (
            files.select("path", place.alias("_o")).filter("_o is not null").withColumn("_nm", P.basename("path"))
            .join(named.select("_nm", F.col("_c1.path").alias("_p1")), "_nm")
            .filter(F.col("path") != F.col("_p1")).groupBy("_nm").agg(F.min(F.struct("_o", "path")).alias("_c2"))
        )
        both = named.select("_nm", "_c1").join(second, "_nm", "left")
        rows = rows.join(both, P.basename("_ptr") == F.col("_nm"), "left")
        other = F.when(F.col("_c1.path") != F.col("path"), F.col("_c1.path")).otherwise(F.col("_c2.path"))
        resolved = F.coalesce(resolved, other)
    return rows.select(
        *df.columns,
        F.coalesce(resolved, F.col("_ptr")).alias("resolved_path"),
        (F.col("_ptr").isNotNull() & resolved.isNotNull()).alias("found"),
    )


def redo_params(df: DataFrame, files: DataFrame, extra_dirs: list[str] | None = None) -> DataFrame:
    """Rows that can be redone as an edit: (path, source_path, edit_suffix).

    The source is the resolved pointer, else the only file of the same directory named exactly as
    the base stem, else the unverified pointer. The name must end in a variant suffix that is not a number.
    """
    resolved = resolve_related(df, files, extra_dirs).withColumn("_dir", P.dirname("path")).withColumn("_base", P.base_stem("path"))
    seeds = files.select("path").withColumn("_dir", P.dirname("path")).withColumn("_base", P.stem("path")).groupBy("_dir", "_base").agg(
        F.count(F.lit(1)).alias("_n"), F.min("path").alias("_seed"), F.max("path").alias("_seed2")
    )
    own = P.stem("path") == F.col("_base")
    joined = resolved.join(seeds, ["_dir", "_base"], "left")
    # the asking file itself does not count as its source
    others = F.col("_n") - own.cast("int")
    single = F.when(others == 1, F.when(F.col("_seed") != F.col("path"), F.col("_seed")).otherwise(F.col("_seed2")))
    source = F.when(F.col("found"), F.col("resolved_path")).otherwise(F.coalesce(single, F.col("resolved_path")))
    rows = joined.select("path", source.alias("source_path")).filter("source_path is not null")
    stem, head = P.stem("path"), P.strip_variant(P.stem("path"))
    src = P.stem("source_path")
    suffix = F.when(
        F.startswith(F.lower(stem), F.lower(src)), F.substring(stem, F.length(src) + 1, F.length(stem))
    ).otherwise(F.substring(stem, F.length(head) + 1, F.length(stem)))
    return rows.filter(head.isNotNull()).select("path", "source_path", suffix.alias("edit_suffix")).filter(
        ~P.suffix_is_numeric("edit_suffix")
    )


# ------------------------------------------------------------------ origins


def origins(media: DataFrame) -> DataFrame:
    """(basename, origin): root of the pointer chain of every basename in the set.

    A pointer to a name inside the set is followed, one that leaves the set ends the chain with
    that name; without a pointer a ``_variant`` tail is stripped when that yields a name of the
    set. A chain that runs into a cycle ends at the first name it meets twice (for a cycle closed
    by a stripped tail, at the name before it).
    """
    pointer = F.nullif(F.col("related_path"), F.lit(""))
    named = media.select(P.basename("path").alias("basename"), "path", pointer.alias("_ptr"))
    entries = named.groupBy("basename").agg(F.max_by("_ptr", "path").alias("_ptr"))
    entries = entries.withColumn("_rel", P.basename("_ptr")).withColumn(
        "_cut", F.concat(P.strip_variant(P.stem("basename")), P.ext("basename"))
    )
    known = entries.select(F.col("basename").alias("_k"))
    want = F.coalesce("_rel", "_cut")
    edges = checkpoint(
        entries.withColumn("_want", want)
        .join(known, F.col("_want") == F.col("_k"), "left")
        .select(
            F.col("basename").alias("node"),
            F.when(F.col("_k") != F.col("basename"), F.col("_k")).alias("up"),
            F.col("_rel").isNull().alias("by_stem"),
            # value of a chain that ends here
            F.coalesce("_rel", "basename").alias("value"),
        )
    )
    parents = edges.select("node", F.coalesce("up", "node").alias("parent"))
    roots, cyclic = chase_parents_with_cycles(parents)
    if cyclic is not None:
        entry = cyclic.select(F.col("node").alias("_c"))
        cut = parents.join(entry, F.col("node") == F.col("_c"), "left").select(
            "node", F.when(F.col("_c").isNotNull(), F.col("node")).otherwise(F.col("parent")).alias("parent")
        )
        roots = chase_parents(cut)
        # name before the entry point, when the cycle is closed there by a stripped tail
        closing = (
            edges.join(entry, F.col("node") == F.col("_c")).select(
                F.col("up").alias("_entry"), F.when(F.col("by_stem"), F.col("node")).otherwise(F.col("up")).alias("_value")
            )
        )
        ends = edges.select(F.col("node").alias("root"), "value").join(closing, F.col("root") == F.col("_entry"), "left").select(
            "root", F.coalesce("_value", "value").alias("value")
        )
    else:
        ends = edges.select(F.col("node").alias("root"), "value")
    return roots.join(ends, "root").select(F.col("node").alias("basename"), F.col("value").alias("origin"))


def chase_parents_with_cycles(parents: DataFrame, hops: int = 3) -> tuple[DataFrame | None, DataFrame | None]:
    """Like chase_parents, but returns (roots, None) or, when cycles exist, (None, nodes on cycles).

    After enough rounds every open pointer has walked further than there are open nodes, so it
    points at a cycle node and every cycle node is pointed at.
    """
    current = checkpoint(parents.withColumn("_done", F.col("node") == F.col("parent")))
    reach = 1
    while True:
        pending = current.filter(~F.col("_done"))
        n = pending.count()
        if n == 0:
            return current.select("node", F.col("parent").alias("root")), None
        if reach > n:
            return None, pending.select(F.col("parent").alias("node")).distinct()
        target = current.select(F.col("node").alias("_t"), F.col("parent").alias("_tp"), F.col("_done").alias("_td"))
        moved = pending
        for _ in range(hops):
            moved = moved.join(target, F.col("parent") == F.col("_t")).select(
                "node", F.col("_tp").alias("parent"), F.col("_td").alias("_done")
            )
        current = checkpoint(current.filter("_done").unionByName(moved))
        reach *= hops + 1


# ------------------------------------------------------------------ generation gate


def should_generate(df: DataFrame, entries: DataFrame, suffix: str, threshold: int = 1) -> DataFrame:
    """Add ``generate``: whether a derived file with ``suffix`` is still wanted per row.

    False when the row's own source is among ``entries`` (path, related_path); else true while
    fewer than ``threshold`` derivatives with a known suffix exist (see downstream_counts).
    """
    n = F.col("n_downstream")[0]
    return downstream_counts(df, entries, [suffix]).select(
        "path", n.alias("n_downstream"), (~F.col("own_source") & (n < threshold)).alias("generate")
    )


def downstream_counts(df: DataFrame, entries: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """(path, own_source, n_downstream): derivatives per row, one number for each suffix, in one pass.

    ``own_source`` tells whether the row's own source is among ``entries`` (path, related_path). A derivative points at
    the row by path or long basename, or continues its stem after a non-alphanumeric with the same
    extension. Derivatives are counted per key before the join, so no pair of files is ever built.
    """
    rows = df.select("path", "related_path").withColumn("k_name", P.basename("path")).withColumn("k_stem", F.lower(P.stem("path"))).withColumn(
        "k_ext", F.lower(P.ext("path"))
    )
    ent = entries.select("path", "related_path")
    # the row's own source
    by_path = ent.select(F.col("path").alias("related_path")).distinct().withColumn("_s1", F.lit(True))
    by_name = ent.select(P.basename("path").alias("_rname")).filter(F.length("_rname") > MIN_NAME).distinct().withColumn("_s2", F.lit(True))
    rows = rows.withColumn("_rname", P.basename("related_path")).join(by_path, "related_path", "left").join(by_name, "_rname", "left")

    kinds = F.array(*[F.coalesce(P.known_suffix(P.stem("path"), [x]), F.lit(False)) for x in suffixes])
    cand = ent.select(
        F.col("related_path").alias("rel"), P.basename("related_path").alias("rname"),
        P.stem("path").alias("stem"), F.lower(P.ext("path")).alias("k_ext"), kinds.alias("_kinds"),
    ).filter(F.array_contains("_kinds", True))
    counts = F.array(*[F.count_if(F.col("_kinds")[i]) for i in range(len(suffixes))])
    pointed = cand.filter("rel is not null")
    n_path = pointed.groupBy(F.col("rel").alias("path")).agg(counts.alias("_n1"))
    n_name = pointed.filter(F.length("rname") > MIN_NAME).groupBy(F.col("rname").alias("k_name")).agg(counts.alias("_n2"))
    cut = _prefixes(cand, F.col("stem"), _lengths(rows, F.col("k_stem")), "_pre", proper=True)
    nxt = F.substring(F.col("stem"), F.length("_pre") + 1, F.lit(1))
    cut = cut.filter(~nxt.rlike(r"^[\p{L}\p{N}]")).withColumn("k_stem", F.lower("_pre"))
    n_stem = cut.groupBy("k_stem", "k_ext").agg(counts.alias("_n3"))
    # stem derivatives that were already counted through their pointer
    again_path = cut.filter("rel is not null").groupBy("k_stem", "k_ext", F.col("rel").alias("path")).agg(counts.alias("_n4"))
    again_name = cut.filter(F.length("rname") > MIN_NAME).groupBy("k_stem", "k_ext", F.col("rname").alias("k_name")).agg(counts.alias("_n5"))
    counted = (
        rows.join(n_path, "path", "left").join(n_name, "k_name", "left").join(n_stem, ["k_stem", "k_ext"], "left")
        .join(again_path, ["k_stem", "k_ext", "path"], "left").join(again_name, ["k_stem", "k_ext", "k_name"], "left")
    )

    long_name = F.length("k_name") > MIN_NAME

    def total(i: int) -> Column:
        n1, n2, n3, n4, n5 = (F.coalesce(F.get(f"_n{k}", F.lit(i)), F.lit(0)) for k in range(1, 6))
        # with a long basename the name count already includes the exact pointers
        return F.when(long_name, n2 - n5).otherwise(n1 - n4) + n3

    own_source = F.coalesce("_s1", F.lit(False)) | F.coalesce("_s2", F.lit(False))
    totals = F.array(*[total(i).cast("bigint") for i in range(len(suffixes))])
    return counted.select("path", own_source.alias("own_source"), totals.alias("n_downstream"))


# ------------------------------------------------------------------ equality


def identical_content(a: DataFrame, b: DataFrame, ident: str, content: str, normalise: bool = False) -> DataFrame:
    """Classes of equal content over two tables: (digest, n_a, n_b, first_a, first_b).

    ``normalise`` ignores case and white-space differences. Counting per digest on both sides keeps
    a digest shared by very many rows from producing all its pairs.
    """
    text = F.col(content)
    if normalise:
        text = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    key = F.sha2(text.cast("binary"), 256)

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(key.alias("digest")).agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.min(ident).alias(f"first_{tag}"))

    return side(a, "a").join(side(b, "b"), "digest")


def is_related(mode: str, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two items count as related in a compare mode."""
    from curaspark.functions import text as X
    from curaspark.functions import vec as V
    from curaspark.operators.pairs import set_similarity

    if mode == "embedding":
        return V.cosine(a["vec"], b["vec"]) > 0.8
    if mode == "prompts":
        none_a, none_b = a["pos"].isNull() & a["neg"].isNull(), b["pos"].isNull() & b["neg"].isNull()
        score = X.text_similarity(a["pos"], b["pos"]) * 0.7 + X.text_similarity(a["neg"], b["neg"]) * 0.3
        return F.when(none_a & none_b, True).when(none_a | none_b, False).otherwise(score > 0.8)
    if mode == "models":
        return set_similarity(a["models"], a["loras"], b["models"], b["loras"]) > 0.7
    if mode == "size":
        return F.coalesce((a["w"] == b["w"]) & (a["h"] == b["h"]), F.lit(False))
    return F.lit(False)
