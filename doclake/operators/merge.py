"""Merging contexts: which documents, which ids, which chunks and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import schema
from doclake.functions.patterns import let
from doclake.operators.relations import first_per_key

# Fixed value: what precedes a snippet id in a placeholder.
MARK = "snippet_id="
#: An id ends at the bracket that closes its placeholder, or at white space.
MARKED = MARK + r"([^\]\s]+)"


def _source_order(sources: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("context_id")).cast("int")


def merge_union(documents: DataFrame, sources: list[str]) -> DataFrame:
    """All documents of the sources, with the position of their source."""
    return documents.where(F.col("context_id").isin(sources)).withColumn("src_order", _source_order(sources))


def merge_intersection(documents: DataFrame, sources: list[str]) -> DataFrame:
    """Documents of the first source whose URL occurs in every other source."""
    if not sources:
        return merge_union(documents, sources)
    first, others = sources[0], list(dict.fromkeys(s for s in sources[1:] if s != sources[0]))
    own = merge_union(documents, [first])
    if len(sources) > 1:
        own = own.where(F.col("url").isNotNull())
    if not others:
        return own
    # One pass for any number of sources; both aggregations combine before the shuffle.
    seen = documents.where(F.col("context_id").isin(others)).select("url", "context_id").distinct()
    common = seen.groupBy("url").agg(F.count("*").alias("_n")).where(F.col("_n") == len(others)).select("url")
    return own.join(common, "url", "left_semi").select(*own.columns)


def dedupe_by_url(documents: DataFrame) -> DataFrame:
    """First document of every URL, by source order, then id; documents without a URL form one group."""
    return first_per_key(documents, ["url"], [F.col("src_order"), F.col("doc_id")])


def collect_documents(documents: DataFrame, sources: list[str], mode: str = "union") -> DataFrame:
    schema.check_choice(mode, schema.MERGE_MODES, "mode")
    pick = merge_union if mode == "union" else merge_intersection
    return dedupe_by_url(pick(documents, sources))


def map_to_target(merged: DataFrame, target_documents: DataFrame, target: str | Column) -> DataFrame:
    """Merged documents with the id they get in the target: an existing document's own id, else a new one."""
    target = F.lit(target) if isinstance(target, str) else target
    known = target_documents.select("url", F.col("doc_id").alias("existing_id"))
    mapped = merged.join(known, "url", "left")
    fresh = schema.document_id(target, F.col("url"))
    return mapped.withColumn("new_doc_id", F.coalesce("existing_id", fresh)).withColumn(
        "is_new", F.col("existing_id").isNull()
    )


def documents_to_insert(mapped: DataFrame, target: str | Column, columns: list[str]) -> DataFrame:
    target = F.lit(target) if isinstance(target, str) else target
    fresh = mapped.where("is_new").withColumn("doc_id", F.col("new_doc_id")).withColumn("context_id", target)
    return fresh.select(*columns)


def id_map(mapped: DataFrame) -> DataFrame:
    return mapped.select("doc_id", "new_doc_id")


def copy_snippets(ids: DataFrame, snippets: DataFrame, target_snippets: DataFrame, target: str | Column) -> DataFrame:
    """Snippets of the merged documents under their new ids; those already in the target are left out."""
    target = F.lit(target) if isinstance(target, str) else target
    moved = snippets.join(ids, "doc_id").withColumn("old_snippet_id", F.col("snippet_id"))
    moved = moved.withColumn("doc_id", F.col("new_doc_id")).withColumn("context_id", target).drop("new_doc_id")
    moved = moved.withColumn("snippet_id", schema.snippet_id("doc_id", "start_pos", "snippet_type"))
    key = ["doc_id", "start_pos", "snippet_type"]
    return moved.join(target_snippets.select(*key), key, "left_anti")


def snippet_id_pairs(ids: DataFrame, snippets: DataFrame) -> DataFrame:
    """doc_id, old_id and new_id of the snippets of the old documents."""
    new_id = schema.snippet_id("new_doc_id", "start_pos", "snippet_type")
    pairs = snippets.select("doc_id", F.col("snippet_id").alias("old_id"), "start_pos", "snippet_type").join(ids, "doc_id")
    return pairs.groupBy("doc_id", "old_id").agg(F.min(new_id).alias("new_id"))


def _names(text: str, links: str | None) -> tuple[Column, Column]:
    """Snippet ids in the placeholders of a text, and in an array of links."""
    none = F.array().cast("array<string>")
    marked = F.coalesce(F.regexp_extract_all(text, F.lit(MARKED), F.lit(1)), none)
    return marked, none if links is None else F.coalesce(links, none)


def new_names(
    df: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "content", links: str | None = None
) -> DataFrame:
    """Per row that names snippets its keys and ``_ids``: what each place names from now on. No text is shuffled."""
    named = df.select(*keys, F.posexplode(F.concat(*_names(text, links))).alias("_at", "old_id"))
    return named.join(pairs, ["doc_id", "old_id"], "left").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_at", F.coalesce("new_id", "old_id").alias("id"))))["id"].alias("_ids")
    )


def renamed(df: DataFrame, text: str = "content", links: str | None = None) -> DataFrame:
    """``df`` with the ids of ``_ids`` (NULL: none named) in its placeholders and links."""
    marked, linked = _names(text, links)
    piece = lambda gap, i: F.concat(gap, F.coalesce(F.concat(F.lit(MARK), F.get("_ids", i)), F.lit("")))
    gaps = F.split(text, MARKED, -1)
    n = F.size(marked)
    body = let(gaps, lambda g: F.concat(
        F.array_join(F.transform(F.slice(g, F.lit(1), F.size(g) - 1), piece), ""), F.element_at(g, -1)
    ))
    changed = {text: F.when(F.col(text).isNotNull() & F.col("_ids").isNotNull() & (n > 0), body).otherwise(F.col(text))}
    if links is not None:
        own = F.slice("_ids", n + 1, F.size(linked))
        changed[links] = F.when(F.col(links).isNotNull() & F.col("_ids").isNotNull(), own).otherwise(F.col(links))
    return df.withColumns(changed).drop("_ids")


def remap_snippets(
    df: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "content", links: str | None = None
) -> DataFrame:
    """``df`` with old snippet ids replaced by the new ones, in the placeholders of a text and in an array of links.

    The text is split at its placeholders once. The ids between the pieces are mapped by a join on (document, id) and go
    back by position, so the work grows with the text, and no row meets pairs it does not name. Ids without a pair, and
    texts that are NULL, stay as they are; rows that name no snippet are not joined. ``keys`` name a row and begin with doc_id.
    """
    names = F.size(F.concat(*_names(text, links)))
    some = df.where(names > 0).join(new_names(df, pairs, keys, text, links), list(keys), "left")
    return renamed(some, text, links).unionByName(df.where(names == 0))


def _by_chunk(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join on (document, chunk index), in which a missing index equals another."""
    other = right.withColumnsRenamed({"doc_id": "_doc", "chunk_index": "_index"})
    same = (F.col("doc_id") == F.col("_doc")) & F.col("chunk_index").eqNullSafe(F.col("_index"))
    return left.join(other, same, how).drop("_doc", "_index")


def copy_chunks(
    ids: DataFrame,
    chunks: DataFrame,
    target_chunks: DataFrame,
    target: str | Column,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Chunks of the merged documents under their new ids; a (document, index) the target already has is skipped."""
    target = F.lit(target) if isinstance(target, str) else target
    # Which chunks move, and what they name, is settled on keys; the chunks themselves are joined once.
    key = ["doc_id", "chunk_index"]
    had = target_chunks.select(F.col("doc_id").alias("new_doc_id"), "chunk_index")
    wanted = chunks.select(*key).distinct().join(ids, "doc_id").join(had, ["new_doc_id", "chunk_index"], "left_anti")
    if pairs is None:
        moved = _by_chunk(chunks, wanted)
    else:
        names = new_names(chunks, pairs, ("doc_id", "chunk_index"), links="code_snippet_ids")
        moved = renamed(_by_chunk(chunks, _by_chunk(wanted, names, "left")), links="code_snippet_ids")
    moved = moved.withColumn("doc_id", F.col("new_doc_id")).withColumn("context_id", target).drop("new_doc_id")
    return moved.withColumn("chunk_id", schema.chunk_id("doc_id", "chunk_index")).select(*chunks.columns)
