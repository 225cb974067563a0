"""Packs of lake objects: written by a compaction's plan, read by ranges; shadow copies put in place.

folder/pack-<bin_id>.bin holds a bin's contents one after the other; folder/manifest lists the packs
and is written last. A task that runs again writes the same bytes under the same name, by a name of its
own first, so a lost executor leaves no half pack that a reader could take for a whole one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST = "bin_id string, pack string, pack_hash string, bytes long, entries long, sound boolean"


def write_packs(plan: DataFrame, contents: DataFrame, folder: str) -> DataFrame:
    """The manifest (bin_id, pack, pack_hash, bytes, entries, sound) of the packs written for a
    plan(lake_id, bin_id, position, logical_offset) of compaction_plan() from contents(lake_id, content).

    Bins are dealt by id and streamed in order of position, an Arrow batch at a time, so neither a
    pack nor a bin is held whole. sound is false where an entry has no content or isn't at the
    offset that the plan gives it; such a pack must not be used. A bin stays within the plan's limits.
    """
    rows = plan.filter("bin_id IS NOT NULL").select("lake_id", "bin_id", "position", "logical_offset").join(contents.select("lake_id", "content"), "lake_id", "left")
    rows = rows.repartition("bin_id").sortWithinPartitions("bin_id", "position").select("bin_id", "position", "logical_offset", "content")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        now, temp, out, told = None, None, None, None

        def close():
            out.close()
            fs.move(temp, f"{root}/pack-{now}.bin")
            return pa.RecordBatch.from_pydict({"bin_id": [now], "pack": [f"pack-{now}.bin"], "pack_hash": [told["hash"].hexdigest()], "bytes": [told["bytes"]], "entries": [told["entries"]], "sound": [told["sound"]]})

        for b in batches:
            for name, position, offset, content in zip(*(b.column(i) for i in range(4)), strict=True):
                if name.as_py() != now:
                    if out is not None:
                        yield close()
                    now, temp, told = name.as_py(), f"{root}/.{uuid.uuid4().hex}", {"hash": hashlib.sha256(), "bytes": 0, "entries": 0, "sound": True}
                    out = fs.open_output_stream(temp, compression=None)
                data = content.as_py()
                told["sound"] &= data is not None and offset.as_py() == told["bytes"] and position.as_py() == told["entries"] + 1
                out.write(data or b"")
                told["hash"].update(data or b"")
                told["bytes"], told["entries"] = told["bytes"] + len(data or b""), told["entries"] + 1
        if out is not None:
            yield close()

    spark = plan.sparkSession
    rows.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_packed(entries: DataFrame, folder: str, most_open: int = 16 << 20) -> DataFrame:
    """entries(lake_id, pack, logical_offset, size_bytes) with their content, read by range; null
    where the pack is absent or too short. Rows are dealt by pack and read in order of offset; about
    most_open bytes are held at a time."""
    rows = entries.select("lake_id", "pack", "logical_offset", "size_bytes").repartition("pack").sortWithinPartitions("pack", "logical_offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        now, file, ids, found, held = None, None, [], [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["lake_id", "content"])
        for b in batches:
            for row in b.to_pylist():
                if row["pack"] != now:
                    if file is not None:
                        file.close()
                    now, file = row["pack"], None
                    if now is not None and fs.get_file_info(f"{root}/{now}").type == pyarrow.fs.FileType.File:
                        file = fs.open_input_file(f"{root}/{now}")
                data = None
                if file is not None and row["logical_offset"] + row["size_bytes"] <= file.size():
                    file.seek(row["logical_offset"])
                    data = file.read(row["size_bytes"])
                ids.append(row["lake_id"]), found.append(data)
                held += len(data or b"") + 64
                if held > most_open:
                    yield made()
                    ids, found, held = [], [], 0
        if file is not None:
            file.close()
        if ids:
            yield made()

    return rows.mapInArrow(read, "lake_id string, content binary")


def compact(catalogue: DataFrame, plan: DataFrame, contents: DataFrame, folder: str) -> DataFrame:
    """What compaction makes of a catalogue(lake_id, content_hash, size_bytes, ...): lake_id, pack,
    logical_offset, size_bytes and outcome of each planned entry.

    Packs are written, then every entry is read back by its range and hashed: COMPACTED, or
    VERIFY_FAILED where a byte differs; where one entry of a pack fails, all stay as they are
    (PACK_FAILED).
    """
    packs = write_packs(plan, contents, folder)
    rows = plan.filter("bin_id IS NOT NULL").select("lake_id", "bin_id", "logical_offset").join(catalogue.select("lake_id", "content_hash", "size_bytes"), "lake_id")
    rows = rows.join(packs.select("bin_id", "pack", "sound"), "bin_id", "left")
    back = read_packed(rows, folder).select("lake_id", F.sha2("content", 256).alias("_h"))
    ok = F.coalesce(F.col("sound") & (F.col("_h") == F.col("content_hash")), F.lit(False))
    rows = rows.join(back, "lake_id", "left").withColumn("_ok", ok)
    whole = rows.groupBy("bin_id").agg(F.min("_ok").alias("_whole"))  # a row a pack
    outcome = F.when(~F.col("_ok"), "VERIFY_FAILED").when(~F.col("_whole"), "PACK_FAILED").otherwise("COMPACTED")
    return rows.join(whole, "bin_id").select("lake_id", "pack", "logical_offset", "size_bytes", outcome.alias("outcome"))


def cutover(plan: DataFrame, copied: DataFrame, current: DataFrame) -> tuple[str, DataFrame]:
    """(state, catalogue) after a shadow rebuild is put in place: CUTOVER and the entries of current(lake_id,
    locator, previous_locator, content_hash, state, version) with the planned ones' locators
    moved, or REFERENCE_GATE_FAILED and current as it was, if one entry has no good copy or was changed since.

    plan: lake_id, locator, content_hash. copied: lake_id, shadow_locator, content_hash.
    """
    c = copied.select("lake_id", "shadow_locator", F.col("content_hash").alias("_c"))
    now = current.select("lake_id", F.col("locator").alias("_l"), F.col("content_hash").alias("_h"), "state")
    rows = plan.select("lake_id", "locator", "content_hash").join(c, "lake_id", "left").join(now, "lake_id", "left")
    ready = (F.col("_c") == F.col("content_hash")) & F.col("shadow_locator").isNotNull() & (F.col("_l") == F.col("locator")) & (F.col("_h") == F.col("content_hash")) & F.col("state").isin("VERIFIED", "COMPACTED", "COLD")
    if plan.isEmpty() or not rows.filter(~F.coalesce(ready, F.lit(False))).isEmpty():
        return "REFERENCE_GATE_FAILED", current
    return "CUTOVER", _moved(current, c.join(plan.select("lake_id"), "lake_id", "left_semi").select("lake_id", F.col("shadow_locator").alias("_to")))


def rollback(plan: DataFrame, copied: DataFrame, current: DataFrame) -> tuple[str, DataFrame]:
    """(state, catalogue) after a cutover is taken back: ROLLED_BACK, or ROLLBACK_GATE_FAILED if a planned
    entry isn't at its shadow copy with the planned locator before it."""
    c = copied.select("lake_id", "shadow_locator")
    rows = plan.select("lake_id", "locator").join(c, "lake_id", "left").join(current.select("lake_id", F.col("locator").alias("_l"), "previous_locator"), "lake_id", "left")
    ready = (F.col("_l") == F.col("shadow_locator")) & (F.col("previous_locator") == F.col("locator"))
    if plan.isEmpty() or not rows.filter(~F.coalesce(ready, F.lit(False))).isEmpty():
        return "ROLLBACK_GATE_FAILED", current
    return "ROLLED_BACK", _moved(current, plan.select("lake_id", F.col("locator").alias("_to")))


def _moved(current: DataFrame, to: DataFrame) -> DataFrame:
    """current with the locators of `to`(lake_id, _to), those before them kept and versions raised."""
    rows, there = current.join(to.dropDuplicates(["lake_id"]), "lake_id", "left"), F.col("_to").isNotNull()
    new = {"locator": F.coalesce("_to", "locator"), "previous_locator": F.when(there, F.col("locator")).otherwise(F.col("previous_locator")), "version": F.when(there, F.col("version") + 1).otherwise(F.col("version"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in current.columns])
