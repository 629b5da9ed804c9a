"""Snippet extraction, placeholder text, and links between chunks and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import schema
from doclake.functions import code
from doclake.functions.patterns import blocks, column, cut, let

#: Width of the position buckets of the overlap join; about one chunk.
BUCKET_WIDTH = 4096


def snippet_array(text, doc, patterns: tuple[str, ...] = ("fence", "inline")) -> Column:
    """Snippets of a text with ids and previews, as an array."""

    def record(s: Column) -> Column:
        fields = ["content", "snippet_type", "start_pos", "end_pos", "line_count", "char_count", "original"]
        return F.struct(
            schema.snippet_id(column(doc), s["start_pos"], s["snippet_type"]).alias("snippet_id"),
            *[s[f].alias(f) for f in fields],
            code.preview(s["content"]).alias("preview"),
        )

    return F.transform(code.snippets(text, patterns), record)


def extract_snippets(
    df: DataFrame,
    text: str = "content",
    keys: tuple[str, ...] = ("doc_id",),
    patterns: tuple[str, ...] = ("fence", "inline"),
) -> DataFrame:
    """One row per snippet: fenced blocks first, then inline code, each in text order. No shuffle."""
    found = df.select(*keys, F.posexplode(snippet_array(text, keys[-1], patterns)).alias("ordinal", "_s"))
    return found.select(*keys, "ordinal", "_s.*")


def placeholder_text(text, snippets, mode: str = "exact") -> Column:
    """The text with every snippet replaced by its placeholder.

    "exact" splices by offset: the outermost match wins and anything overlapping it stays inside. "compat" replaces
    the first occurrence of each match, last snippet first, so identical snippets swap ids and a fence whose inside
    was already replaced stays in the text.
    """
    schema.check_choice(mode, ("exact", "compat"), "mode")
    text, snippets = column(text), column(snippets)
    span = lambda s: F.struct(
        s["start_pos"].alias("start"),
        s["end_pos"].alias("end"),
        s["original"].alias("original"),
        code.placeholder(s["content"], s["snippet_id"], s["preview"]).alias("mark"),
    )
    ordered = F.array_sort(F.transform(snippets, span))
    if mode == "compat":

        def swap(t: Column, s: Column) -> Column:
            def at(p: Column) -> Column:
                rest = F.substring(t, p + F.length(s["original"]), F.lit(2**31 - 1))
                return F.when(p > 0, F.concat(F.left(t, p - 1), s["mark"], rest)).otherwise(t)

            return let(F.position(s["original"], t), at)

        return F.aggregate(F.reverse(ordered), text, swap)

    kind = "struct<start:int,end:int,original:string,mark:string>"
    seed = F.struct(F.lit(0).alias("until"), F.array().cast(f"array<{kind}>").alias("kept"))

    def keep(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["until"]
        return F.struct(
            F.when(free, s["end"]).otherwise(acc["until"]).alias("until"),
            F.when(free, F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"]).alias("kept"),
        )

    def splice(kept: Column, pieces: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            begin = F.when(i > 0, F.get(kept, i - 1)["end"]).otherwise(0)
            return F.concat(cut(pieces, begin, s["start"]), s["mark"])

        tail = cut(pieces, F.try_element_at(kept, F.lit(-1))["end"], F.length(text))
        whole = F.concat(F.array_join(F.transform(kept, piece), ""), tail)
        return F.when(F.size(kept) > 0, whole).otherwise(text)

    def spliced(kept: Column) -> Column:
        return let(blocks(F.when(F.size(kept) > 0, text)), lambda pieces: splice(kept, pieces))

    return let(F.aggregate(ordered, seed, keep, lambda acc: acc["kept"]), spliced)


def cleaned_content(df: DataFrame, text: str = "content", doc: str = "doc_id", mode: str = "exact") -> DataFrame:
    """Adds ``cleaned_content`` and the ``snippets`` array it refers to."""
    with_snippets = df.withColumn("snippets", snippet_array(text, doc))
    return with_snippets.withColumn("cleaned_content", placeholder_text(text, "snippets", mode))


def placeholder_spans(content) -> Column:
    """Spans of the placeholders of a cleaned text; ``inner`` is the snippet id."""
    return code.matches(content, code.PLACEHOLDER, 1)


def links_within(spans: Column, char_start: Column, char_end: Column) -> Column:
    """Ids of the placeholders that a span of the cleaned text touches, in order."""
    hit = F.filter(spans, lambda s: (s["start_pos"] < char_end) & (s["end_pos"] > char_start))
    return F.array_distinct(F.transform(hit, lambda s: s["inner"]))


def link_snippets(chunks: DataFrame, snippets: DataFrame, width: int = BUCKET_WIDTH) -> DataFrame:
    """Chunks with the ids of all snippets of the same document whose span overlaps theirs (ends inclusive).

    Both sides are spread over position buckets, so a long document is many small joins, and a pair is reported only
    in the first bucket both cover.
    """

    def spread(df: DataFrame, start: str, end: str, *cols: Column) -> DataFrame:
        lo = F.coalesce(F.col(start), F.lit(0)).alias("lo")
        hi = F.coalesce(F.col(end), F.lit(0)).alias("hi")
        base = df.select("doc_id", *cols, lo, hi)
        buckets = F.sequence(F.floor(F.col("lo") / width), F.greatest(F.floor(F.col("hi") / width), F.floor(F.col("lo") / width)))
        return base.withColumn("bucket", F.explode(buckets))

    left = spread(chunks, "char_start", "char_end", F.col("chunk_id")).alias("c")
    right = spread(snippets, "start_pos", "end_pos", F.col("snippet_id"), F.col("start_pos").alias("pos")).alias("s")
    overlap = (F.col("c.lo") <= F.col("s.hi")) & (F.col("c.hi") >= F.col("s.lo"))
    first = F.col("c.bucket") == F.greatest(F.floor(F.col("c.lo") / width), F.floor(F.col("s.lo") / width))
    same = (F.col("c.doc_id") == F.col("s.doc_id")) & (F.col("c.bucket") == F.col("s.bucket"))
    pairs = left.join(right, same & overlap & first).select("c.chunk_id", "s.pos", "s.snippet_id")
    linked = pairs.groupBy("chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "snippet_id")))["snippet_id"].alias("code_snippet_ids")
    )
    none = F.array().cast("array<string>")
    return (
        chunks.drop("code_snippet_ids")
        .join(linked, "chunk_id", "left")
        .withColumn("code_snippet_ids", F.coalesce("code_snippet_ids", none))
    )


def snippets_of(snippets: DataFrame, doc_id) -> DataFrame:
    """Snippets of one document in text order."""
    return snippets.where(F.col("doc_id") == doc_id).orderBy("start_pos", "snippet_type")
