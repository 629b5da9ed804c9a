"""The stored corpus: Parquet tables partitioned by context, by a hash bucket of the document, and by version.

Nothing stored is ever changed. A write appends rows under a version of its own, appends to ``changes`` which documents (or
chunks, or whole contexts) gave up what they had before that version, and last appends its version to ``commits``: this one
small file makes the write visible, in all tables at once. A write that stops before leaves rows that no reader counts. A
reader lists the commits, then the files, and takes of each document the rows that no later version has replaced, so readers
write nothing, and frames that are already planned keep the files they listed.

An upsert of one per cent of the documents writes one per cent of the rows and their ids. What is read besides the rows is the
list of versions and the ids that were ever replaced; ``compact`` writes a context anew under one version, after which its
older versions no longer count. One writer at a time is assumed.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake import schema
from doclake.operators import contexts as ctx_ops
from doclake.operators import documents as doc_ops
from doclake.session import discard, shared_dir

#: Tables whose rows belong to documents.
CHILDREN = ("documents", "raw_documents", "chunks", "code_snippets")
#: Up to so many buckets, each task writes the rows it has: at most this number of files of every context it meets.
FEW_BUCKETS = 8


class Corpus:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._open: int | None = None

    # Storage -----------------------------------------------------------------------------------------------------

    def location(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _exists(self, location: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(location)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _keys(self, table: str) -> list[str]:
        return ["bucket"] if table in ("contexts", "job_events") else ["context_id", "bucket"]

    def _owner(self, table: str) -> str:
        return {"contexts": "context_id", "job_events": "job_id"}.get(table, "doc_id")

    def _bucketed(self, table: str, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self._owner(table)), F.lit(self.buckets)).cast("int"))

    def _load(self, table: str, folders: list[str] | None) -> DataFrame:
        """All rows ever written to the table, or to the listed partition folders of it."""
        columns, home = f"{schema.TABLES[table]}, bucket int, version long", self.location(table)
        paths = [home] if folders is None else [f"{home}/{f}" for f in folders]
        if folders is None and not self._exists(home):
            paths = []
        if not paths:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).option("basePath", home).parquet(*paths)

    def _seen(self) -> list[int]:
        """The versions that count: those committed, one folder each, and the one being written."""
        home = self.spark._jvm.org.apache.hadoop.fs.Path(self.location("commits"))
        fs = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(home)] if fs.exists(home) else []
        done = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
        return sorted(done if self._open is None else [*done, self._open])

    def _levels(self, table: str) -> list[tuple[str, list[str]]]:
        """The kinds of change that end rows of a table, and the columns that tell which rows."""
        levels = [("context", ["context_id"])]
        if table in CHILDREN:
            levels += [("document", ["context_id", "doc_id"]), (table, ["context_id", "doc_id"])]
        if table == "contexts":
            levels.append((table, ["context_id", "context_id"]))
        return levels + ([("chunk", ["context_id", "doc_id", "chunk_index"])] if table == "chunks" else [])

    def _live(self, table: str, rows: DataFrame, seen: list[int]) -> DataFrame:
        """The rows of the versions that count which no later one has replaced."""
        live = rows.where(F.col("version").isin(seen))
        for of, columns in self._levels(table):
            home = f"{self.location('changes')}/of={of}"
            if self._exists(home):
                changes = self.spark.read.schema("context_id string, key string, version long").parquet(home)
                until = changes.where(F.col("version").isin(seen))
                until = until.groupBy("context_id", "key").agg(F.max("version").alias("_until"))
                key = F.concat_ws(":", *columns[1:]) if len(columns) > 1 else F.lit("")
                named = until.select(F.col("context_id").alias("_context"), F.col("key").alias("_key"), "_until")
                same = (live["context_id"] == named["_context"]) & (key == named["_key"])
                live = live.join(named, same, "left").where("_until is null or version >= _until")
                live = live.drop("_context", "_key", "_until")
        return live

    def read(
        self,
        table: str,
        context_id: str | list[str] | None = None,
        doc_ids: list[str] | None = None,
        since: int | None = None,
    ) -> DataFrame:
        """A table, one or more contexts of it (then only their folders are listed), or a few documents of them.

        Listed documents are looked for in their buckets only. ``since`` leaves rows of versions after that one.
        """
        # Versions first: of a write that ends in between, the files may be listed already, but its version is not.
        seen = self._seen()
        if context_id is None:
            rows = self._load(table, None)
        else:
            wanted = [context_id] if isinstance(context_id, str) else list(dict.fromkeys(context_id))
            if "context_id" in self._keys(table):
                folders = [f"context_id={c}" for c in wanted]
                rows = self._load(table, [f for f in folders if self._exists(f"{self.location(table)}/{f}")])
            else:
                rows = self._load(table, None).where(F.col("context_id").isin(wanted))
        if doc_ids is not None:
            places = [F.pmod(F.xxhash64(F.lit(d)), F.lit(self.buckets)).cast("int") for d in doc_ids]
            rows = rows.where(F.col("bucket").isin(places) & F.col("doc_id").isin(list(doc_ids)))
        if since is not None:
            rows = rows.where(F.col("version") > since)
        return self._live(table, rows, seen).drop("bucket", "version")

    def version(self) -> int:
        """The newest version that counts."""
        return max(self._seen(), default=0)

    def replaced(self, table: str, context_id: str, since: int) -> DataFrame | None:
        """Documents (doc_id) of a context that lost rows of the table after a version.

        NULL if more than whole documents was replaced: the context itself, or single chunks.
        """
        seen = [v for v in self._seen() if v > since]
        gone = self.spark.createDataFrame([], "doc_id string")
        for of, _ in self._levels(table):
            home = f"{self.location('changes')}/of={of}"
            if seen and self._exists(home):
                changes = self.spark.read.schema("context_id string, key string, version long").parquet(home)
                mine = changes.where(F.col("version").isin(seen) & (F.col("context_id") == context_id))
                if of in ("context", "chunk"):
                    if not mine.isEmpty():
                        return None
                else:
                    gone = gone.unionByName(mine.select(F.col("key").alias("doc_id")))
        return gone.distinct()

    def _conform(self, table: str, df: DataFrame) -> DataFrame:
        """Columns in table order and type; absent ones are NULL."""
        empty = self.spark.createDataFrame([], schema.TABLES[table]).schema
        return df.select(
            *[
                (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in empty.fields
            ]
        )

    # Writing -----------------------------------------------------------------------------------------------------

    @contextmanager
    def change(self) -> Iterator[int]:
        """Writes inside become visible together when the outermost block ends, or not at all."""
        if self._open is not None:
            yield self._open
            return
        newest = max(self._seen(), default=0)
        # The clock keeps versions of writes that stopped from being taken again.
        self._open = max(time.time_ns(), newest + 1)
        try:
            yield self._open
            self._commit(self._open)
        finally:
            self._open = None

    def _commit(self, version: int) -> None:
        row = self.spark.createDataFrame([(version, datetime.now())], "version long, at timestamp")
        # One folder with one file, put in place by one rename.
        row.coalesce(1).write.mode("append").partitionBy("version").parquet(self.location("commits"))

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows; nothing is replaced."""
        with self.change() as version:
            keys = [*self._keys(table), "version"]
            rows = self._bucketed(table, self._conform(table, df)).withColumn("version", F.lit(version))
            if table == "documents":
                rows = rows.withColumns({name: size() for name, size in schema.DOCUMENT_SIZES.items()})
            # AQE splits large and merges small write partitions, whatever the skew of contexts and buckets. With few
            # buckets a task writes few files of a context anyway, and the rows are not shuffled for it.
            spread = rows if self.buckets <= FEW_BUCKETS else rows.hint("rebalance", *[F.col(k) for k in keys[:-1]])
            # The writer sorts by partition anyway; sorting on by owner lets look-ups by id skip row groups.
            ordered = spread.sortWithinPartitions(*keys, self._owner(table))
            ordered.write.mode("append").partitionBy(*keys).parquet(self.location(table))

    def _replace(self, of: str, keys: DataFrame) -> None:
        """Note that the rows of ``keys`` (context_id, key) before the open version are replaced."""
        with self.change() as version:
            rows = keys.select(F.lit(of).alias("of"), "context_id", F.col("key").cast("string"), F.lit(version).alias("version"))
            rows.write.mode("append").partitionBy("of", "version").parquet(self.location("changes"))

    def _stored_ids(self, table: str, doc_ids: DataFrame) -> DataFrame:
        """Those of the documents (context_id, doc_id) that the table has rows of; only ids are read."""
        seen = self._seen()
        listed = self._bucketed(table, doc_ids.select("context_id", "doc_id")).distinct()
        # Context and bucket are part of the key, so folders that hold none of the documents are left out while running.
        rows = self._load(table, None).join(listed, ["context_id", "bucket", "doc_id"], "left_semi")
        return self._live(table, rows, seen).select("context_id", "doc_id").distinct()

    def replace_documents(self, table: str, rows: DataFrame, doc_ids: DataFrame) -> None:
        """Rows of the listed documents (context_id, doc_id) give way to ``rows``; all other rows stay.

        ``rows`` and ``doc_ids`` should come from written tables; they are read more than once.
        """
        with self.change():
            if self._exists(self.location(table)):
                self._replace(table, self._stored_ids(table, doc_ids).withColumnRenamed("doc_id", "key"))
            self.append(table, rows)

    def replace_whole(self, tables: dict[str, DataFrame]) -> None:
        """The documents of ``tables["documents"]`` give up all they had, in every table, for the given rows.

        As in an upsert the source type stays. The frames should come from written tables.
        """
        with self.change():
            documents = tables["documents"]
            if self._exists(self.location("documents")):
                merged = self._with_old_type(documents)
                self._replace("document", self._stored_ids("documents", documents).withColumnRenamed("doc_id", "key"))
                tables = {**tables, "documents": merged}
            for table, rows in tables.items():
                self.append(table, rows)

    def _with_old_type(self, rows: DataFrame) -> DataFrame:
        """Rows for the documents table with the source type of the stored document, where there is one."""
        old = self._live("documents", self._load("documents", None), self._seen())
        old = old.select("context_id", "bucket", "doc_id", F.col("source_type").alias("_old_type"))
        placed = self._bucketed("documents", self._conform("documents", rows))
        kept = placed.join(old, ["context_id", "bucket", "doc_id"], "left")
        return kept.withColumn("source_type", F.coalesce("_old_type", "source_type"))

    # Contexts ----------------------------------------------------------------------------------------------------

    def register(self, df: DataFrame, now: datetime | None = None) -> DataFrame:
        """Add contexts (name, description, embedding_model); a taken or invalid name is an error."""
        outcome = ctx_ops.register_contexts(self.read("contexts"), df, now)
        bad = outcome.where(F.col("status") != "created").select("name", "status").limit(5).collect()
        if bad:
            raise ValueError("contexts not registered: " + ", ".join(f"{r['name']} ({r['status']})" for r in bad))
        self.append("contexts", outcome.drop("status"))
        return outcome

    def context_id(self, name: str) -> str:
        row = self.read("contexts").where(F.col("name") == name).select("context_id").first()
        if row is None:
            raise ValueError(f"context {name!r} not found")
        return row["context_id"]

    def has_context(self, name: str) -> bool:
        return self.read("contexts").where(F.col("name") == name).limit(1).count() > 0

    def embedding_model(self, name: str) -> str | None:
        return self.read("contexts").where(F.col("name") == name).select("embedding_model").first()[0]

    def update_context(self, name: str, now: datetime | None = None, **values) -> None:
        """Set fields of a context's row; ``updated_at`` becomes ``now``."""
        row = self.read("contexts").where(F.col("name") == name).first()
        if row is None:
            raise ValueError(f"context {name!r} not found")
        fields = {**row.asDict(), "updated_at": now or datetime.now(), **values}
        new = self.spark.createDataFrame([tuple(fields.values())], schema.TABLES["contexts"])
        with self.change():
            self._replace("contexts", new.select("context_id", F.col("context_id").alias("key")))
            self.append("contexts", new)

    def use_model(self, name: str, model: str) -> None:
        """Record the model whose vectors a context holds; a context that has chunks of another one is an error."""
        known = self.embedding_model(name)
        if known == model:
            return
        if not self.read("chunks", self.context_id(name)).isEmpty():
            raise ValueError(f"context {name!r} holds vectors of {known!r}, not of {model!r}")
        self.update_context(name, embedding_model=model)

    def list_contexts(self, name: str | None = None) -> DataFrame:
        return ctx_ops.list_contexts(self.read("contexts"), self.read("documents"), name)

    def delete_context(self, name: str) -> None:
        """Drop a context with its documents, raw texts, chunks, snippets and job events: one row that ends them all."""
        gone = [(self.context_id(name), "")]
        self._replace("context", self.spark.createDataFrame(gone, "context_id string, key string"))

    def compact(self, name: str) -> None:
        """Write what a context holds under one new version; its older versions and changes no longer count."""
        cid = self.context_id(name)
        tables = {t: self.read(t, cid) for t in schema.TABLES}
        with self.change():
            self.delete_context(name)
            for table, rows in tables.items():
                self.append(table, rows)

    # Documents ---------------------------------------------------------------------------------------------------

    def upsert_documents(self, df: DataFrame) -> None:
        """Upsert rows (context_id, url, title, content, metadata, source_type, indexed_at).

        Everything is replaced but the id and the source type.
        """
        with self._written(doc_ops.latest_documents(df)) as rows:
            self.replace_documents("documents", self._with_old_type(rows), rows)

    def upsert_raw(self, df: DataFrame) -> None:
        with self._written(doc_ops.latest_raw(df)) as rows:
            self.replace_documents("raw_documents", rows, rows)

    def upsert_chunks(self, df: DataFrame) -> None:
        """Upsert chunks on (document, chunk index)."""
        with self._written(doc_ops.latest_chunks(df)) as rows, self.change():
            key = F.concat_ws(":", "doc_id", "chunk_index").alias("key")
            self._replace("chunk", rows.select("context_id", key))
            self.append("chunks", rows)

    @contextmanager
    def _written(self, df: DataFrame) -> Iterator[DataFrame]:
        """``df`` as a table in the scratch folder, for writes that read their rows more than once."""
        path = shared_dir(self.spark, "upsert")
        df.write.parquet(path)
        try:
            yield self.spark.read.schema(df.schema).parquet(path)
        finally:
            discard(self.spark, path)

    def delete_documents(self, name: str, ids: DataFrame) -> int:
        """Delete documents of a context by id, with their children; the number deleted."""
        cid = self.context_id(name)
        gone = ids.select(F.col(ids.columns[0]).cast("string").alias("doc_id"), F.lit(cid).alias("context_id"))
        deleted = doc_ops.deleted_count(self.read("documents", cid), cid, gone.select("doc_id")).first()["deleted"]
        self._replace("document", self._stored_ids("documents", gone).withColumnRenamed("doc_id", "key"))
        return deleted

    def statistics(self) -> DataFrame:
        return ctx_ops.corpus_stats(
            self.read("contexts"), self.read("documents"), self.read("chunks"), self.read("code_snippets")
        )

    def refresh_counts(self, name: str) -> None:
        """Count each document's chunks again; only documents whose total was another are written."""
        cid = self.context_id(name)
        documents = self.read("documents", cid)
        counts = doc_ops.with_chunk_counts(documents.select("context_id", "doc_id"), self.read("chunks", cid))
        old = documents.select("doc_id", F.col("chunk_count").alias("_old"))
        with self._written(counts.join(old, "doc_id").where("not chunk_count <=> _old").drop("_old")) as wrong:
            new = documents.drop("chunk_count").join(wrong.select("doc_id", "chunk_count"), "doc_id")
            self.replace_documents("documents", new, wrong)
