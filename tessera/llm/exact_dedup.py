"""Exact dedup against immutable snapshots.

A snapshot keeps one row for each distinct digest, in a table bucketed and sorted by digest, and for
each bucket a static binary-fuse filter. An incoming batch is first grouped by digest for itself; the
filters screen its digests; what they let through joins the snapshot's exact buckets, which are read
in place: only the batch moves. Groups of more than one row are then checked byte by byte. Rows, not
filters, decide: a false positive only costs a lookup.

Sizes: a bucket holds about `BUCKET_ROWS` digests, and their number follows the snapshot, so each
filter is a few hundred kilobytes at any scale. Copies are combined before every shuffle, so a group
that holds a third of all rows sends one row from each task; groups of over 1 / HOT_SHARE of the rows,
fewer than that many, are sent to the rows instead of the rows to them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import fuse_filter
from tessera.llm.shared import materialize, scratch_root

BUCKET_ROWS, HOT_SHARE, LEAST_HOT, BROADCAST_ROWS = 250_000, 100_000, 100, 1_000_000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@dataclass(frozen=True)
class Snapshot:
    """groups: digest, keep_id, n; bucketed by digest. filters: bucket, filter."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def digests(docs: DataFrame, id_col: str, text_col: str, digest=sha256) -> DataFrame:
    """One row for each row: doc_id, digest. Null texts count as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), digest(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """digest, keep_id (the largest id), n (rows)."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def _keyed(groups: DataFrame, buckets: int) -> DataFrame:
    """Spark's own bucket numbers, and a 64-bit key for the filters."""
    return groups.withColumn("key", F.xxhash64("digest")).withColumn("bucket", F.pmod(F.hash("digest"), F.lit(buckets)))


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """`df` as a table bucketed by digest in the shared folder; the catalog names it only while it is read in."""
    name = f"tessera_snapshot_{uuid.uuid4().hex}"
    spread = df.repartition(buckets, "digest").write.bucketBy(buckets, "digest").sortBy("digest")
    spread.option("path", f"{scratch_root(df.sparkSession)}/{name}").saveAsTable(name)
    found = df.sparkSession.table(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # its files stay: it has a path of its own
    return found


def take_snapshot(rows: DataFrame) -> Snapshot:
    """Freezes digest rows: writes their groups in buckets, and a filter for each bucket."""
    groups = materialize(grouped(rows), "groups")
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups.count() // BUCKET_ROWS))

    def build(part: pa.Table) -> pa.Table:
        keys = part.column("key").to_numpy().view(np.uint64)
        return pa.table({"bucket": part.column("bucket").slice(0, 1), "filter": pa.array([fuse_filter.build(keys)], pa.binary())})

    filters = _keyed(groups, buckets).select("bucket", "key").groupBy("bucket").applyInArrow(build, "bucket int, filter binary")
    return Snapshot(_bucketed(groups, buckets), materialize(filters, "filters"), buckets)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """groups with a column `maybe`: false if the snapshot surely lacks the digest."""
    keyed = _keyed(groups, snapshot.buckets)
    schema = "digest string, keep_id {}, n long, maybe boolean".format(dict(groups.dtypes)["keep_id"])

    def probe(batch: pa.Table, filters: pa.Table) -> pa.Table:
        maybe = np.zeros(batch.num_rows, bool)
        if batch.num_rows:
            keys = batch.column("key").to_numpy().view(np.uint64)
            for blob in filters.column("filter").to_pylist():
                maybe |= fuse_filter.contains(blob, keys)
        return batch.select(["digest", "keep_id", "n"]).append_column("maybe", pa.array(maybe))

    return keyed.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInArrow(probe, schema)


def merge(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The batch's groups, with what the snapshot has of them: digest, keep_id, n, known (whether it has any).

    Untouched groups of the snapshot aren't among them, and the snapshot isn't shuffled.
    """
    screened = materialize(screen(grouped(batch), snapshot), "screened")
    old = snapshot.groups.select("digest", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n"))
    met = screened.filter("maybe").join(old, "digest", "left")
    changed = met.select("digest", F.greatest("keep_id", "old_id").alias("keep_id"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"), F.col("old_n").isNotNull().alias("known"))
    return changed.unionByName(screened.filter("not maybe").select("digest", "keep_id", "n", F.lit(False).alias("known")))


def _joined(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Rows with their group's columns: hot groups go to the rows, and the others' rows to their group."""
    hot = materialize(groups.filter(F.col("n") > max(LEAST_HOT, total // HOT_SHARE)), "hot")
    if hot.isEmpty():
        return rows.join(groups, "digest")
    warm = groups.filter(F.col("n") <= max(LEAST_HOT, total // HOT_SHARE))
    return rows.join(F.broadcast(hot), "digest").unionByName(rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(warm, "digest"))


def exact_dedup(docs: DataFrame, in_snapshot: Column, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, digest.

    Rows for which `in_snapshot` (an expression of `id_col`) holds are the older, immutable snapshot;
    the others are the incoming batch. Texts are equal if their bytes are; null counts as empty. The
    largest id of a group stays (a null id is the smallest). Where that row itself is repeated, with
    the same id and text, one of the repeats stays. No rows give no rows; other columns of `docs` are
    not read, so their names don't matter.
    """
    rows = digests(docs, id_col, text_col, digest)
    older = F.coalesce(in_snapshot, F.lit(False))
    rows = materialize(rows.withColumn(id_col, F.col("doc_id")).withColumn("__older", older).select("doc_id", "digest", F.col("__older").alias("older")), "digests")  # in_snapshot may name the id as in docs
    fields, total = ["doc_id", "digest"], rows.count()
    snapshot = take_snapshot(rows.filter("older").select(fields))
    touched = materialize(merge(rows.filter("not older").select(fields), snapshot), "touched")
    # The snapshot's groups as they are now: those that the batch has met, and the others.
    met = touched.filter("known").select("digest", F.col("keep_id").alias("new_id"), F.col("n").alias("new_n"))
    now = snapshot.groups.join(met, "digest", "left").select("digest", F.coalesce("new_id", "keep_id").alias("keep_id"), F.coalesce("new_n", "n").alias("n"))
    merged = materialize(now.unionByName(touched.filter("not known").select("digest", "keep_id", "n")), "merged")

    # Byte check: the rows of one digest in groups of more than one must have one text. Where such
    # digests are few, their keys go to the texts, and other texts aren't shuffled.
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest(text).alias("digest"))
    several = materialize(merged.filter("n > 1").select("digest", F.xxhash64("digest").alias("key")), "several")
    if several.count() <= BROADCAST_ROWS:
        texts_of = texts.withColumn("key", F.xxhash64("digest")).join(F.broadcast(several.select("key").distinct()), "key", "left_semi").drop("key")
    else:
        texts_of = texts.join(several.select("digest"), "digest", "left_semi")
    variants = texts_of.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    checked = materialize(variants.groupBy("digest").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1"), "collisions")
    out = ["doc_id", "keep_id", "group_size", "kept", "digest"]
    rows = rows.select(fields)
    answer = _numbered(_joined(rows, merged.withColumnRenamed("n", "group_size").withColumn("n", F.col("group_size")), total), out)
    if checked.isEmpty():
        return answer
    collided = checked.select("digest")
    by_text = variants.join(collided, "digest", "left_semi").withColumnRenamed("n", "group_size")
    odd = texts.join(collided, "digest", "left_semi").join(by_text, ["digest", "text"])
    return answer.join(collided, "digest", "left_anti").select(out).unionByName(_numbered(odd, out, "text"))


def _numbered(joined: DataFrame, out: list[str], *more: str) -> DataFrame:
    """Rows of the largest id of their group are kept; where that very row is repeated, one of the repeats is."""
    largest = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    by = ["doc_id", "digest", *more]
    twice = materialize(joined.filter(largest).groupBy(*by).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "repeats")
    if twice.isEmpty():
        return joined.withColumn("kept", largest).select(out)
    # Repeated keepers are taken out and put in again, numbered.
    named = twice.select(*[F.col(c).alias(f"__{c}") for c in by])
    same = lambda: [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    plain = joined.join(named, same(), "left_anti").withColumn("kept", largest).select(out)
    first = joined.join(named, same(), "left_semi").dropDuplicates(by).join(twice.select(*[F.col(c).alias(f"__{c}") for c in by], "copies"), same())
    row = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return plain.unionByName(first.withColumn("row_no", row).withColumn("kept", F.col("row_no") == 1).select(out))


def surviving(docs: DataFrame, in_snapshot: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Of rows that repeat an id and a text, any one stays. Texts are shuffled only where very many rows
    go, or some row is repeated.
    """
    decided = materialize(exact_dedup(docs, in_snapshot, id_col, text_col), "decided")
    repeats = decided.filter((~F.col("kept")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    goes = materialize(decided.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "digest").distinct(), "goes")
    marked = docs.withColumn("__tessera_digest", sha256(F.coalesce(F.col(text_col), F.lit(""))))
    gone = goes.withColumnsRenamed({"doc_id": "__tessera_id", "digest": "__tessera_gone"})
    gone = F.broadcast(gone) if goes.count() <= BROADCAST_ROWS else gone
    stays = marked.join(gone, (marked["__tessera_digest"] == gone["__tessera_gone"]) & marked[id_col].eqNullSafe(gone["__tessera_id"]), "left_anti")
    if not repeats.isEmpty():
        stays = stays.dropDuplicates([id_col, "__tessera_digest"])
    return stays.select(docs.columns)
