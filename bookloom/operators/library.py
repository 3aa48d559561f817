"""The library table: import, duplicates, names, search, patches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bookloom.operators.scale import first_rows, ranked, salted_join
from bookloom.session import cut_lineage


def only_type(files: DataFrame, path: str, exts: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with one of the extensions, the ignored rest)."""
    ok = F.coalesce(F.col(path).rlike(r"(?i)\.(?:" + "|".join(exts) + ")$"), F.lit(False))
    return files.where(ok), files.where(~ok)


def missing_inputs(wanted: DataFrame, existing: DataFrame, on: str) -> DataFrame:
    return wanted.join(existing.select(on).distinct(), on, "left_anti")


def search(books: DataFrame, text: str, columns: Sequence[str] = ("title", "author", "file")) -> DataFrame:
    """Case-insensitive substring over the columns; a blank query finds everything."""
    needle = (text or "").strip().lower()
    if not needle:
        return books
    return books.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(needle)
                                                   for c in map(F.col, columns)]))


def with_fingerprint(files: DataFrame, content: str = "content") -> DataFrame:
    """Length and SHA-256 instead of the content. Every file is read and hashed once: the short rows are kept, and all later
    steps work on them."""
    others = [c for c in files.columns if c != content]
    return cut_lineage(files.select(*others, F.octet_length(content).cast("long").alias("size"),
                                    F.sha2(F.col(content).cast("binary"), 256).alias("digest")))


def name_rank(name: Column) -> Column:
    """Names without a number suffix first, then the shorter ones."""
    return F.when(name.rlike(r"_\d+$"), 100000).otherwise(0) + F.length(name)


def dedup_by_content(files: DataFrame, name: str, pos: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed with the kept name) over files with size and digest. The keeper per content is a partial
    aggregate, so any number of copies of one content costs one row per task."""
    best = files.groupBy("size", "digest").agg(F.min(F.struct(name_rank(F.col(name)).alias("r"), F.col(pos).alias("p"),
                                                              F.col(name).alias("kept"))).alias("b"))
    best = best.select("size", "digest", F.col("b.p").alias("_kept_pos"), F.col("b.kept").alias("kept"))
    marked = salted_join(files, best, ["size", "digest"], "inner")
    return (marked.where(F.col(pos) == F.col("_kept_pos")).drop("_kept_pos", "kept"),
            marked.where(F.col(pos) != F.col("_kept_pos")).drop("_kept_pos"))


def import_new(incoming: DataFrame, library: DataFrame, name: str = "file", pos: str = "pos") -> DataFrame:
    """incoming rows with action skip (content already there, `existing` names it) or import. Among incoming
    copies of one content only the first is imported, the others are skipped for it."""
    have = library.groupBy("size", "digest").agg(F.min(name).alias("_lib"))
    first = incoming.groupBy("size", "digest").agg(F.min(F.struct(pos, name)).alias("_first"))
    known = first.join(have, ["size", "digest"], "left").select(
        "size", "digest", F.col("_lib"), F.col(f"_first.{pos}").alias("_fp"), F.col(f"_first.{name}").alias("_fn"))
    out = salted_join(incoming, known, ["size", "digest"], "left")
    old = F.when(F.col("_lib").isNotNull(), F.col("_lib")).when(F.col(pos) != F.col("_fp"), F.col("_fn"))
    return out.withColumn("existing", old).withColumn("action", F.when(old.isNotNull(), "skip").otherwise("import")) \
              .drop("_lib", "_fp", "_fn")


def assign_unique_names(rows: DataFrame, base: str, ext: str, order: Sequence[Column], taken: DataFrame) -> DataFrame:
    """A file name nobody else has: base+ext, else base_1+ext, base_2+ext, ... skipping the taken names.

    A name that is claimed by another base (a real file called base_1) counts as taken. The k-th row of a base gets
    the k-th free number, found by ranking rows and free numbers instead of probing one by one.
    """
    rows = rows.withColumn("_ext", F.col(ext))
    claimed = taken.select(F.col(taken.columns[0]).alias("name")).distinct()
    own = rows.select(F.concat(base, ext).alias("name")).distinct()
    n = ranked(rows, [base, ext], order, "_k")
    # numbers used up by taken names of this base, and by other bases that look like base_number
    used = claimed.select("name", F.lit(True).alias("lib")).unionByName(own.select("name", F.lit(False).alias("lib")))
    pat = r"^(.*?)(?:_([0-9]{1,9}))?(\.[^.]*)$"
    parts = used.select("lib", F.regexp_extract("name", pat, 1).alias("b"), F.regexp_extract("name", pat, 2).alias("num"),
                        F.regexp_extract("name", pat, 3).alias("e"), "name")
    numbered = parts.where((F.col("num") != "") & ~F.col("num").startswith("0")) \
                    .select("b", "e", F.col("num").cast("long").alias("num"))
    plain = parts.where("lib").select(F.regexp_extract("name", r"^(.*?)(\.[^.]*)$", 1).alias("b"), "e", F.lit(0).cast("long").alias("num"))
    blocked = numbered.unionByName(plain).distinct()
    ranks = ranked(blocked, ["b", "e"], [F.col("num")], "_r")
    # free numbers before the r-th blocked number: num - (r - 1); row k takes k-1 + (blocked with that count <= k-1)
    steps = ranks.select(F.col("b").alias(base), F.col("e").alias(ext), (F.col("num") - F.col("_r") + 1).alias("_free_before"))
    need = n.select(base, ext, "_k", F.lit(1).alias("_is_row")).unionByName(
        steps.select(base, ext, (F.col("_free_before") + 1).alias("_k"), F.lit(0).alias("_is_row")))
    order_all = ranked(need, [base, ext], [F.col("_k"), F.col("_is_row")], "_pos")
    shift = order_all.where("_is_row = 1").select(base, ext, "_k", (F.col("_pos") - F.col("_k")).alias("_shift"))
    out = n.join(shift, [base, ext, "_k"])
    number = F.col("_k") - 1 + F.col("_shift")
    return out.withColumn("name", F.concat(base, F.when(number > 0, F.concat(F.lit("_"), number.cast("string"))).otherwise(F.lit("")), ext)) \
              .drop("_k", "_shift", "_ext")


def patch_metadata(books: DataFrame, patches: DataFrame, on: str, fields: Sequence[str]) -> DataFrame:
    """Non-null patch fields replace the book's; of several patches for a book the last (by `ord`) counts."""
    p = first_rows(patches, [on], [F.col("ord").desc()]).select(on, *[F.col(f).alias(f"_p_{f}") for f in fields])
    out = books.join(p, on, "left")
    return out.select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in fields else F.col(c) for c in books.columns])


def delete_rows(books: DataFrame, paths: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(remaining library, report (path, status deleted/failed))."""
    gone = paths.select(on).distinct()
    report = gone.join(books.select(on).distinct().withColumn("_in", F.lit(True)), on, "left") \
                 .select(on, F.when(F.col("_in"), "deleted").otherwise("failed").alias("status"))
    return books.join(gone, on, "left_anti"), report


def small_cover_upgrade(best: DataFrame, candidates: DataFrame, on: str = "query_id", limit_px: int = 200, tries: int = 3) -> DataFrame:
    """A cover with a long side below limit_px is replaced by the largest of up to three other covers of the same
    title and a compatible author, taken in order and only until one is large enough."""
    b = best.select(on, F.col("title").alias("_t"), F.col("author").alias("_a"), F.col("cover").alias("_c"), F.col("px").alias("_px"))
    pool = candidates.join(b, on).where(
        (F.col("_px") < limit_px) & (F.col("title") == F.col("_t")) & (F.coalesce("cover", F.lit("")) != "") & (F.col("cover") != F.col("_c"))
        & ((F.coalesce("_a", F.lit("")) == "") | (F.coalesce("author", F.lit("")) == "") | (F.col("author") == F.col("_a"))))
    top = first_rows(pool, [on], [F.col("pos")], tries, "_try").groupBy(on).agg(
        F.array_sort(F.collect_list(F.struct("_try", "px", "cover"))).alias("v"))  # at most `tries` per query
    state = F.struct(F.lit(0).alias("px"), F.lit("").alias("cover"))
    taken = F.aggregate("v", state, lambda s, x: F.when((s["px"] < limit_px) & (x["px"] > s["px"]),
                        F.struct(x["px"].alias("px"), x["cover"].alias("cover"))).otherwise(s))
    out = best.join(top.select(on, taken.alias("_up")), on, "left")
    better = F.coalesce(F.col("_up.px") > F.col("px"), F.lit(False))
    return out.withColumn("cover", F.when(better, F.col("_up.cover")).otherwise(F.col("cover"))) \
              .withColumn("px", F.when(better, F.col("_up.px")).otherwise(F.col("px"))).drop("_up")


def read_position(events: DataFrame, on: str, ts: str, fields: Sequence[str]) -> DataFrame:
    """Latest row per key."""
    return first_rows(events.select(on, ts, *fields), [on], [F.col(ts).desc(), *[F.col(f).desc() for f in fields]])
