"""Readers: text files of unknown encoding, rank boards, archives, images, log lines."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bookloom import constants as K
from bookloom.functions.pyudf import decode_declared, decode_ladder, jpeg_webp_size
from bookloom.functions.text import media_kind, nonempty, png_gif_size
from bookloom.operators.segment import read_list

UTF8_MARK, REPLACED = "\ufeff", "\ufffd"


def read_text_corpus(spark: SparkSession, path: str, ladder=K.CODEC_LADDER) -> DataFrame:
    """(path, modified, text, encoding, lossy) of every file below path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return decode_corpus(raw.select("path", F.col("modificationTime").alias("modified"), "content"), "content", ladder)


def decode_corpus(raw: DataFrame, content: str = "content", ladder=K.CODEC_LADDER) -> DataFrame:
    """Bytes to text by byte order mark, then the first codec that fits. Valid UTF-8 is settled in the JVM; only other bytes
    reach the helper."""
    text = F.col(content).cast("string")
    marked = text.startswith(UTF8_MARK)
    sure = F.is_valid_utf8(text) & (marked | F.lit(next(iter(ladder), None) == "utf-8"))
    plain = F.struct(F.regexp_replace(text, f"^{UTF8_MARK}+", "").alias("text"), F.when(marked, "utf-8-sig").otherwise("utf-8").alias("encoding"),
                     (marked & text.contains(REPLACED)).alias("lossy"))
    return raw.withColumn("_d", F.when(sure, plain).otherwise(decode_ladder(F.when(~sure, F.col(content)), ladder))).select(
        *[c for c in raw.columns if c != content], "_d.text", "_d.encoding", "_d.lossy")


def decode_strict(raw: DataFrame, content: str, content_type: str) -> DataFrame:
    """Page bytes to text by the declared charset, UTF-8, GB18030. Pages that are UTF-8, or ASCII, as they say or by default, are
    settled in the JVM."""
    declared = nonempty(F.lower(F.regexp_extract(content_type, r"(?i)charset=([\w-]+)", 1)))
    text = F.col(content).cast("string")
    fits = declared.isNull() | declared.isin("utf-8", "utf8") | (declared.isin("ascii", "us-ascii") & ~text.rlike(r"[^\x00-\x7F]"))
    sure = F.is_valid_utf8(text) & fits & ~text.contains(REPLACED)
    plain = F.struct(text.alias("text"), F.coalesce(declared, F.lit("utf-8")).alias("encoding"), F.lit(False).alias("lossy"))
    return raw.withColumn("_d", F.when(sure, plain).otherwise(decode_declared(F.when(~sure, F.col(content)), declared))).select(
        *[c for c in raw.columns if c != content], "_d.text", "_d.encoding", "_d.lossy")


def read_title_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct titles of list files with the place (file, line) each occurs at first."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    return read_list(files)


def load_phrase_tables(dictionary: DataFrame, max_entries: int = 2_000_000) -> list[list[dict[str, str]]]:
    """Phrase tables for phrase_convert from rows (group, dict, key, value). A dictionary is a fixed resource of a language;
    one that is larger than max_entries is refused, not cut."""
    rows = dictionary.select("group", "dict", "key", "value").limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        raise ValueError(f"more than {max_entries} phrases; join the text with the dictionary instead")
    tables: dict[int, dict[int, dict[str, str]]] = {}
    for group, part, key, value in rows:
        tables.setdefault(group, {}).setdefault(part, {})[key] = value
    return [[d for _, d in sorted(parts.items())] for _, parts in sorted(tables.items())]


def read_rank_snapshots(spark: SparkSession, paths, schema: str, mapping: dict[str, Column], multi_line: bool = True) -> DataFrame:
    """Rank boards {date, books: [...]} to pool rows: books exploded in order, fields mapped by expressions over `b`."""
    boards = spark.read.schema(schema).option("multiLine", multi_line).json(paths)
    d = boards.select(*[c for c in boards.columns if c != "books"], F.posexplode("books").alias("pos", "b"))
    return d.select(*[c for c in boards.columns if c != "books"], (F.col("pos") + 1).alias("pos"), *[e.alias(n) for n, e in mapping.items()])


def _tag(xml: str, name: str) -> str:
    m = re.search(rf"<(?:dc:)?{name}\b[^>]*>(.*?)</(?:dc:)?{name}>", xml, re.S | re.I)
    return re.sub(r"<[^>]+>", "", m.group(1)).strip() if m else ""


def _cover_href(opf: str) -> str | None:
    items = [dict(re.findall(r'([\w:-]+)\s*=\s*"([^"]*)"', it)) for it in re.findall(r"<item\b[^>]*>", opf, re.I)]
    by_property = [i["href"] for i in items if "cover-image" in i.get("properties", "") and i.get("href")]
    named = re.search(r'<meta\b[^>]*name\s*=\s*"cover"[^>]*content\s*=\s*"([^"]+)"', opf, re.I)
    by_id = [i["href"] for i in items if named and i.get("id") == named.group(1) and i.get("href")]
    by_name = [i["href"] for i in items if i.get("href", "").lower().endswith(K.COVER_EXT) and "cover" in i["href"].lower()]
    return next(iter(by_property + by_id + by_name), None)


EPUB_COLUMNS = ["ok", "title", "author", "description", "language", "cover_href"]


def _epub_row(raw) -> tuple:
    try:
        with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
            names = z.namelist()
            container = z.read("META-INF/container.xml").decode("utf-8", "ignore") if "META-INF/container.xml" in names else ""
            found = re.search(r'full-path\s*=\s*"([^"]+)"', container)
            opf_path = found.group(1) if found else next((n for n in names if n.lower().endswith(".opf")), None)
            if not opf_path:
                return False, "", "", "", "", None
            opf = z.read(opf_path).decode("utf-8", "ignore")
    except (zipfile.BadZipFile, KeyError, OSError, TypeError, NotImplementedError, RuntimeError):
        return False, "", "", "", "", None
    href = _cover_href(opf)
    cover = posixpath.normpath(posixpath.join(posixpath.dirname(opf_path), href)) if href else None
    return (True, *[_tag(opf, t) for t in ("title", "creator", "description", "language")], cover)


def epub_metadata(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, ok, title, author, description, language, cover_href) of archives; a broken one gives ok = false."""
    key_type = dict(files.dtypes)[key]

    def run(batches: Iterable[pd.DataFrame]):
        for b in batches:
            yield pd.concat([b[[key]].reset_index(drop=True),
                             pd.DataFrame([_epub_row(v) for v in b[content]], columns=EPUB_COLUMNS)], axis=1)
    return files.select(key, content).mapInPandas(
        run, f"{key} {key_type}, ok boolean, title string, author string, description string, language string, cover_href string")


def read_epub_metadata(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(path)
    return raw.select("path", "length", "modificationTime").join(epub_metadata(raw.select("path", "content")), "path")


def media_probe(files: DataFrame, content: str = "content") -> DataFrame:
    """kind, bytes, width, height. PNG and GIF sizes come from the header bytes; only JPEG and WebP need a helper."""
    d = files.withColumn("kind", media_kind(content)).withColumn("bytes", F.octet_length(content).cast("long"))
    d = d.withColumn("_a", png_gif_size(content)).withColumn("_b", jpeg_webp_size(F.col(content)))
    return d.select(*[c for c in files.columns if c != content], "kind", "bytes", F.coalesce("_a.width", "_b.width").alias("width"),
                    F.coalesce("_a.height", "_b.height").alias("height"))


def parse_event_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """`[time] TAG payload` and `@@TAG {json}` lines to (time, tag, payload, is_json, data); other lines are dropped."""
    stamped, marked = r"(?s)^\[([^\]]+)\] (\S+) ?(.*)$", r"(?s)^\s*@@(\S+)\s+(.*?)\s*$"
    c = F.col(line)
    tag = F.when(c.rlike(stamped), F.regexp_extract(c, stamped, 2)).when(c.rlike(marked), F.regexp_extract(c, marked, 1))
    payload = F.when(c.rlike(stamped), F.regexp_extract(c, stamped, 3)).otherwise(F.regexp_extract(c, marked, 2))
    d = lines.withColumn("time", nonempty(F.regexp_extract(c, stamped, 1))).withColumn("tag", tag).withColumn("payload", payload)
    data = F.try_parse_json("payload")
    return d.where(F.col("tag").isNotNull()).withColumn("is_json", data.isNotNull()).withColumn("data", data).drop(line)


def last_result(log: DataFrame, job: str, order: str, tag: str = "RESULT") -> DataFrame:
    """The payload of the last line with the tag, per job."""
    return log.where((F.col("tag") == tag) & F.col("is_json")).groupBy(job).agg(F.max_by("payload", order).alias("result"))
