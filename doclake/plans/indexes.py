"""Indexes of a stored context: postings for full text, cells for the vectors of chunks and of snippets.

An index is written beside the corpus tables, under the version of the corpus it was built from, and is there from the moment
its own small mark is. Searches use the newest one that still fits: vectors written later are scanned beside the cells, and
documents replaced later are left out of them; postings are used while the context has not changed, as document frequencies
and mean length belong to all of its texts. Otherwise the tables are scanned, with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.operators import blockmax
from doclake.operators import fulltext as FT
from doclake.operators.cells import Cells, build_cells
from doclake.operators.hybrid import merge_hits
from doclake.operators.vector_search import CHUNK_COLUMNS, LIMIT, SEARCH_MIN_SIMILARITY, ranked, with_document
from doclake.sources.corpus import Corpus

ID_OF = {"chunks": "chunk_id", "code_snippets": "snippet_id"}


def _home(corpus: Corpus, context: str, kind: str) -> str:
    return f"{corpus.path}/_indexes/{kind}/{context}"


def _mark(corpus: Corpus, home: str, version: int) -> None:
    ready = corpus.spark.createDataFrame([(version, 1)], "version long, ready int").coalesce(1)
    ready.write.mode("append").partitionBy("version").parquet(f"{home}/ready")


def _newest(corpus: Corpus, home: str) -> int | None:
    """The version of the newest whole index."""
    path = corpus.spark._jvm.org.apache.hadoop.fs.Path(f"{home}/ready")
    system = path.getFileSystem(corpus.spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    names = [s.getPath().getName() for s in system.listStatus(path)]
    return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=None)


def index_text(
    corpus: Corpus, name: str, stemming: bool = False, buckets: int = FT.TERM_BUCKETS, table: str = "chunks"
) -> None:
    """Write the posting blocks of a context's chunks or snippets and their statistics."""
    context, version = corpus.context_id(name), corpus.version()
    items = corpus.read(table, context)
    home = _home(corpus, context, f"text-{table}-{'stemmed' if stemming else 'plain'}")
    place = f"{home}/version={version}"
    how = {"stemming": F.lit(stemming), "buckets": F.lit(buckets)}
    FT.text_statistics(items, stemming=stemming).withColumns(how).write.mode("overwrite").parquet(f"{place}/statistics")
    statistics = corpus.spark.read.parquet(f"{place}/statistics").first()
    blocks = blockmax.text_blocks(items, statistics, ID_OF[table], stemming=stemming, buckets=buckets)
    blockmax.write_blocks(blocks, f"{place}/blocks")
    _mark(corpus, home, version)


def index_vectors(corpus: Corpus, name: str, cells: int | None = None, table: str = "chunks", **training) -> None:
    """Write the vectors of a context's chunks or snippets by cell, and the table of cells."""
    context, version = corpus.context_id(name), corpus.version()
    home = _home(corpus, context, f"vectors-{table}")
    items = corpus.read(table, context).select(ID_OF[table], "doc_id", "embedding")
    build_cells(items, f"{home}/version={version}", cells, **training)
    _mark(corpus, home, version)


def vector_index(corpus: Corpus, context: str, table: str = "chunks"):
    """The cells of a context, vectors that are newer, and documents replaced since; None if there is no index that fits."""
    home = _home(corpus, context, f"vectors-{table}")
    version = _newest(corpus, home)
    if version is None:
        return None
    without = corpus.replaced(table, context, version)
    if without is None:
        return None
    also = corpus.read(table, context, since=version).select(ID_OF[table], "embedding")
    return Cells(corpus.spark, f"{home}/version={version}"), also, without


def vector_hits(
    corpus: Corpus, context: str, query: Sequence[float], limit: int, min_similarity: float, table: str = "chunks"
) -> tuple[DataFrame, float] | None:
    """The hits of an exact search through the cells and the share of indexed vectors read; None without an index."""
    found = vector_index(corpus, context, table)
    if found is None:
        return None
    cells, also, without = found
    return cells.search(query, limit, min_similarity, ID_OF[table], also, without)


def text_hits(
    corpus: Corpus, context: str, query: str, limit: int, stemming: bool = False, table: str = "chunks"
) -> DataFrame | None:
    """Hits by the context's postings; None without postings of the context as it is."""
    home = _home(corpus, context, f"text-{table}-{'stemmed' if stemming else 'plain'}")
    version = _newest(corpus, home)
    if version is None:
        return None
    replaced = corpus.replaced(table, context, version)
    if replaced is None or not replaced.isEmpty() or not corpus.read(table, context, since=version).isEmpty():
        return None
    blocks = corpus.spark.read.parquet(f"{home}/version={version}/blocks")
    statistics = corpus.spark.read.parquet(f"{home}/version={version}/statistics").first()
    return blockmax.block_search(
        blocks, statistics, query, limit, ID_OF[table], stemming=statistics["stemming"], buckets=statistics["buckets"]
    )[0]


def indexed_search(
    corpus: Corpus,
    name: str,
    query: str,
    vector: Sequence[float] | None = None,
    limit: int = LIMIT,
    min_similarity: float = SEARCH_MIN_SIMILARITY,
    stemming: bool = False,
) -> DataFrame:
    """Search through the indexes: full text without a vector, hybrid with one; an index that does not fit is an error.

    The indexes give ids; texts are read for the ``limit`` best only.
    """
    context = corpus.context_id(name)
    wanted = limit if vector is None else 2 * limit
    hits = text_hits(corpus, context, query, wanted, stemming)
    near = None if vector is None else vector_hits(corpus, context, vector, wanted, min_similarity)
    if hits is None or (vector is not None and near is None):
        raise ValueError(f"context {name!r} has no index of its present state")
    if near is not None:
        hits = merge_hits(near[0], hits, limit)
    return with_fields(corpus, context, hits, limit)


def with_fields(corpus: Corpus, context: str, hits: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` chunk hits with their texts and documents, which are looked for in their buckets only."""
    rows = hits.collect()
    # Rows from the driver count as a table of any size: without the hint all texts would be shuffled to meet them.
    few = F.broadcast(corpus.spark.createDataFrame(rows, hits.schema))
    chunks = corpus.read("chunks", context).select("chunk_id", "doc_id", *CHUNK_COLUMNS)
    met = chunks.join(few, "chunk_id")
    detailed = ranked(met, limit).collect()
    owners = sorted({r["doc_id"] for r in detailed})
    kinds = met.schema
    found = corpus.spark.createDataFrame(detailed, kinds)
    return ranked(with_document(found, corpus.read("documents", context, owners)), limit)
