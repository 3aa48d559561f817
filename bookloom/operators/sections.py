"""Search inside texts and ids found in several places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from bookloom.functions.lines import split_lines
from bookloom.functions.text import volume_tag
from bookloom.operators.scale import first_rows


def full_text_search(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", around: int = 20) -> DataFrame:
    """One row per line that contains the query (any case): place, excerpt, number of the hit and hits in the document."""
    needle = query.lower()
    lines = F.transform(split_lines(text), lambda x, i: F.struct((i + 1).alias("line_no"), F.instr(F.lower(x), needle).alias("place"), x.alias("line")))
    d = docs.where(F.lower(text).contains(needle)).select(key, F.filter(lines, lambda r: r["place"] > 0).alias("_h"))
    d = d.select(key, F.size("_h").alias("total"), F.posexplode("_h").alias("n", "h"))
    start = F.greatest(F.col("h.place") - around, F.lit(1))
    return d.select(key, "h.line_no", "h.place", F.substring("h.line", start, F.col("h.place") - start + len(query) + around).alias("excerpt"),
                    (F.col("n") + 1).alias("ordinal"), "total")


def category_ids(books: DataFrame, categories: str, pages: DataFrame, html: str, patterns: Sequence[str]) -> DataFrame:
    """Distinct ids from nested category objects and from patterns in pages."""
    ids = books.select(F.explode(categories).alias("c")).select(F.col("c.categoryId").cast("string").alias("id"))
    for p in patterns:
        ids = ids.unionByName(pages.select(F.explode(F.regexp_extract_all(html, F.lit(p), F.lit(1))).alias("id")))
    return ids.where(F.coalesce("id", F.lit("")) != "").distinct().orderBy("id")


def volume_tags(volumes: DataFrame, on: str, order: str, name: str) -> DataFrame:
    """(on, tag) of each book: the names of up to three volumes, or the word for the whole book. Volumes are counted; of a book with
    more than three no name is gathered beyond the fourth, which decides."""
    size = volumes.groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    heads = first_rows(volumes, [on], [F.col(order)], 4).groupBy(on).agg(F.array_sort(F.collect_list(F.struct(order, name))).alias("_v"))
    names = F.transform("_v", lambda x: x[name])
    return size.join(heads, on).select(on, F.when(F.col("_n") > 3, volume_tag(F.slice(names, 1, 4))).otherwise(volume_tag(names)).alias("tag"))
