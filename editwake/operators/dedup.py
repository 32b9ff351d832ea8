"""Exactly one copy of each message that was delivered at least once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editwake import session
from editwake.functions.columns import free_name, uuid_key

#: Identifiers a shard holds at most on average; beyond that all shards are split in two.
SHARD_IDS = 250_000
#: Parts of about equal size that are merged into one.
MERGE_PARTS = 8
BROADCAST_ROWS = 200_000
_DICT, _SEEN = "shard int, version int, ids binary", "shard int, version int, bits binary"
_FIRST, _REPEATED = "arrival bigint", "id binary, arrival bigint, n bigint"
_OUT = pa.schema([
    ("kind", pa.string()), ("shard", pa.int32()), ("version", pa.int32()), ("ids", pa.binary()), ("bits", pa.binary()), ("id", pa.binary()), ("arrival", pa.int64()), ("n", pa.int64()),
])
_OUT_DDL = "kind string, shard int, version int, ids binary, bits binary, id binary, arrival bigint, n bigint"


def pack_ids(ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.record_batch([ids], names=["id"])
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def unpack_ids(data: bytes | None) -> pa.Array:
    if not data:
        return pa.array([], pa.binary())
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def pack_bits(bits: np.ndarray) -> bytes:
    """A seen-bitmap: its length, then its compressed bytes."""
    return len(bits).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(np.packbits(bits).tobytes())


def unpack_bits(data: bytes | None) -> np.ndarray:
    if not data:
        return np.zeros(0, bool)
    n = int.from_bytes(data[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=n // 8 + 1)
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def encode(ids: pa.Array, known: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of ids, equal exactly where the ids are, and the dictionary with the new ones at its end."""
    codes = pc.index_in(ids, value_set=known)
    fresh = pc.unique(ids.filter(pc.is_null(codes)))
    if len(fresh):
        known = pa.concat_arrays([known, fresh]) if len(known) else fresh
        codes = pc.index_in(ids, value_set=known)
    return codes.to_numpy(zero_copy_only=False).astype(np.int64), known


def first_unseen(codes: np.ndarray, arrivals: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Positions of the earliest arrival of each code whose bit isn't set."""
    order = np.lexsort((arrivals, codes))
    c = codes[order]
    firsts = order[np.r_[True, c[1:] != c[:-1]]] if len(c) else order
    return firsts[~seen[codes[firsts]]]


def _parts(state: pa.Table, column: str) -> list[bytes]:
    """The blobs of a shard in the order in which they were written."""
    kept = state.filter(pc.is_valid(state.column(column)))
    return kept.sort_by("version").column(column).to_pylist()


def _dictionary(state: pa.Table) -> pa.Array:
    known = [unpack_ids(x) for x in _parts(state, "ids")]
    return pa.concat_arrays(known) if known else pa.array([], pa.binary())


def _union(state: pa.Table, size: int) -> np.ndarray:
    """All bitmaps of a shard, each over the first codes only, united; codes beyond have no bit yet."""
    seen = np.zeros(size, bool)
    for x in _parts(state, "bits"):
        bits = unpack_bits(x)
        seen[: len(bits)] |= bits
    return seen


def _rows(shard: int, version: int, ids: pa.Array | None = None, bits: np.ndarray | None = None) -> list[pa.Table]:
    out = []
    for kind, blob in (("dict", None if ids is None else pack_ids(ids)), ("seen", None if bits is None else pack_bits(bits))):
        if blob is not None:
            both = {"ids": blob if kind == "dict" else None, "bits": blob if kind == "seen" else None}
            out.append(pa.Table.from_pylist([{"kind": kind, "shard": shard, "version": version, **both}], schema=_OUT))
    return out


def _results(kind: str, ids: pa.Array | None, arrivals: np.ndarray, numbers: np.ndarray | None = None, missing: np.ndarray | None = None) -> pa.Table:
    """Rows of a step's result."""
    size = len(arrivals)
    columns = {
        "kind": pa.array([kind] * size, pa.string()), "id": ids, "n": None if numbers is None else pa.array(numbers, pa.int64()),
        "arrival": pa.array(arrivals, pa.int64(), mask=missing),
    }
    return pa.Table.from_arrays([columns.get(f.name) if columns.get(f.name) is not None else pa.nulls(size, f.type) for f in _OUT], schema=_OUT)


def _take(version: int):
    def shard(rows: pa.Table, state: pa.Table) -> pa.Table:
        number = (rows if rows.num_rows else state).column("shard")[0].as_py()
        ids = rows.column("id").combine_chunks() if rows.num_rows else pa.array([], pa.binary())
        if not len(ids):
            return _OUT.empty_table()
        old = _dictionary(state)
        codes, known = encode(ids, old)
        seen = _union(state, len(known))
        arrivals = rows.column("arrival").to_numpy()
        kept = first_unseen(codes, arrivals, seen)
        first_of = np.zeros(len(known), np.int64)
        first_of[codes[kept]] = arrivals[kept]
        deliveries = np.bincount(codes, rows.column("n").to_numpy(), len(known))
        here = np.unique(codes)
        again = here[(deliveries[here] > 1) | seen[here]]
        new_bits = np.zeros(len(known), bool)
        new_bits[codes[kept]] = True
        parts = _rows(number, version, known.slice(len(old)) if len(known) > len(old) else None, new_bits if len(kept) else None)
        parts.append(_results("first", None, arrivals[kept]))
        parts.append(_results("repeated", known.take(pa.array(again, pa.int64())), first_of[again], deliveries[again].astype(np.int64), seen[again]))
        return pa.concat_tables(parts)

    return shard


def _merge(version: int):
    def shard(state: pa.Table) -> pa.Table:
        known = _dictionary(state)
        # A merged part keeps codes and places: later parts go on counting where its dictionary ends.
        return pa.concat_tables(_rows(state.column("shard")[0].as_py(), version, known if len(known) else None))

    return shard


def _unite(version: int):
    def shard(state: pa.Table) -> pa.Table:
        size = max((int.from_bytes(x[:8], "little") for x in _parts(state, "bits")), default=0)
        return pa.concat_tables(_rows(state.column("shard")[0].as_py(), version, None, _union(state, size)))

    return shard


def _rebuild(version: int):
    def shard(rows: pa.Table) -> pa.Table:
        bits = rows.column("seen").to_numpy(zero_copy_only=False).astype(bool)
        return pa.concat_tables(_rows(rows.column("shard")[0].as_py(), version, rows.column("id").combine_chunks(), bits))

    return shard


def _spread(shard_states: pa.Table) -> pa.Table:
    known = _dictionary(shard_states)
    return pa.table({"id": known, "seen": pa.array(_union(shard_states, len(known)))})


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within an Arrow batch as one row: its earliest arrival and their number."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by("id", use_threads=False).aggregate([("arrival", "min"), ("id", "count")])
        table = table.rename_columns(["id", "arrival", "n"])
        yield from table.to_batches()


class SeenStore:
    """Identifiers already taken: per shard an exact dictionary, and compressed bitmaps over its codes.

    The dictionary only says which code an identifier has; that it was taken, its bit says. Both grow by parts: a step
    adds the identifiers it met for the first time, and the bits it set; nothing is written again. A step first publishes
    its dictionary parts and then, by a second mark, unites its bits with the others. Killed before either mark it leaves
    the store as it was; killed between them it leaves identifiers that are known and not seen, which the step run again
    then takes. Of parts of about equal size MERGE_PARTS are merged into one, so that each identifier is rewritten as
    often as its logarithm; where shards hold more than SHARD_IDS on average, they are split, so a shard's memory is
    bounded. Parts that no mark names any more are removed, except those the last two marks name.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        said = session.published(spark, self.path)
        self.mark, self.meta = said[0] if said else 0, json.loads(said[1]) if said else {}
        self.meta.setdefault("shards", shards)
        for name, start in (("version", 0), ("steps", 0), ("dict", []), ("seen", []), ("results", {})):
            self.meta.setdefault(name, start)

    @property
    def shards(self) -> int:
        return self.meta["shards"]

    @property
    def steps(self) -> int:
        """Steps taken so far."""
        return self.meta["steps"]

    def _publish(self, **changed) -> None:
        before = self.meta
        meta = before | changed
        session.publish(self.spark, self.path, self.mark + 1, json.dumps(meta))
        self.mark, self.meta = self.mark + 1, meta
        named = {(kind, v) for m in (before, meta) for kind in ("dict", "seen") for v, _ in m[kind]}
        was = {(kind, v) for kind in ("dict", "seen") for v, _ in getattr(self, "_older", before)[kind]}
        for kind, v in was - named:
            session.remove(self.spark, f"{self.path}/v{v}/kind={kind}")
        self._older = before

    def _read(self, versions: list[int], kind: str, schema: str) -> DataFrame:
        paths = [p for p in (f"{self.path}/v{v}/kind={kind}" for v in versions) if session.exists(self.spark, p)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def state(self) -> DataFrame:
        """All parts: shard, version, ids (a part of the dictionary) or bits (a bitmap)."""
        ids = self._read([v for v, _ in self.meta["dict"]], "dict", _DICT).withColumn("bits", F.lit(None).cast("binary"))
        bits = self._read([v for v, _ in self.meta["seen"]], "seen", _SEEN).withColumn("ids", F.lit(None).cast("binary"))
        return ids.unionByName(bits).select("shard", "version", "ids", "bits")

    def identifiers(self) -> DataFrame:
        """(id, seen) of everything in the dictionary."""
        session.ship(self.spark)
        return self.state().groupBy("shard").applyInArrow(_spread, "id binary, seen boolean")

    def kept(self, step: int | None = None) -> DataFrame:
        """(arrival): the first arrivals of a step (default: the last one)."""
        return self._read([self.meta["results"].get(str(step or self.steps), 0)], "first", _FIRST)

    def repeated(self, step: int | None = None) -> DataFrame:
        """(id, arrival): identifiers that a step delivered again, with their first arrival in it, NULL where seen before."""
        return self._read([self.meta["results"].get(str(step or self.steps), 0)], "repeated", _REPEATED)

    def _write(self, out: DataFrame, version: int) -> None:
        folder = f"{self.path}/v{version}"
        session.remove(self.spark, folder)  # what a step that died half-way left
        out.write.partitionBy("kind").parquet(folder)

    def _make_room(self, coming: int) -> None:
        """Splits the shards until they hold the identifiers known and `coming` more; merges parts of about equal size."""
        known = sum(n for _, n in self.meta["dict"])
        shards = self.shards
        while known + coming > shards * SHARD_IDS:
            shards *= 2
        version = self.meta["version"] + 1
        if shards != self.shards and known:
            rows = self.identifiers().withColumn("shard", _shard_of(F.col("id"), shards))
            self._write(rows.groupBy("shard").applyInArrow(_rebuild(version), _OUT_DDL), version)
            self._publish(shards=shards, version=version, dict=[[version, known]], seen=[[version, known]])
        elif shards != self.shards:
            self._publish(shards=shards)
        for kind, schema, how in (("dict", _DICT, _merge), ("seen", _SEEN, _unite)):
            tail = self.meta[kind][-MERGE_PARTS:]
            if len(tail) == MERGE_PARTS and tail[0][1] <= MERGE_PARTS * max(1, tail[-1][1]):
                version = self.meta["version"] + 1
                other = "bits" if kind == "dict" else "ids"
                parts = self._read([v for v, _ in tail], kind, schema).withColumn(other, F.lit(None).cast("binary")).select("shard", "version", "ids", "bits")
                self._write(parts.groupBy("shard").applyInArrow(how(version), _OUT_DDL), version)
                self._publish(version=version, **{kind: [*self.meta[kind][:-MERGE_PARTS], [version, sum(n for _, n in tail)]]})

    def take(self, batch: DataFrame, rows: int | None = None, keep_results: int | None = None) -> int:
        """Takes a batch (id BINARY, arrival BIGINT), no NULL in it; returns the step's number, for kept() and repeated().

        Copies are combined where they lie, Arrow batch by Arrow batch, before the one shuffle to their shard, so an
        identifier that fills a third of the rows puts one row in ten thousand into its shard. `rows` is the number of
        rows where it is known. With keep_results only the results of the last so many steps stay.
        """
        session.ship(self.spark)
        self._make_room(batch.count() if rows is None else rows)
        version = self.meta["version"] + 1
        combined = batch.select("id", "arrival").mapInArrow(_combined, "id binary, arrival bigint, n bigint")
        sharded = combined.withColumn("shard", _shard_of(F.col("id"), self.shards)).select("shard", "id", "arrival", "n")
        self._write(sharded.groupBy("shard").cogroup(self.state().groupBy("shard")).applyInArrow(_take(version), _OUT_DDL), version)
        fresh = self._read([version], "first", _FIRST).count()
        self._publish(version=version, dict=[*self.meta["dict"], [version, fresh]])
        step = self.steps + 1
        results = self.meta["results"] | {str(step): version}
        if keep_results:
            for old in [s for s in results if int(s) <= step - keep_results]:
                for kind in ("first", "repeated"):
                    session.remove(self.spark, f"{self.path}/v{results[old]}/kind={kind}")
                del results[old]
        self._publish(steps=step, seen=[*self.meta["seen"], [version, fresh]], results=results)
        return step


def _shard_of(identifier, shards: int):
    return F.pmod(F.xxhash64(identifier), F.lit(shards)).cast("int")


class Deliveries:
    """A table taken by a store in steps: equal ranges of the arrival number, one after another, as deliveries come.

    Rows without an identifier, and rows without an arrival number, have no identity; they are neither first nor repeated.
    """

    def __init__(self, df: DataFrame, identifier: str, order: str, batches: int, store: SeenStore | None) -> None:
        self.df, self.order, self.batches = df, order, batches
        spark = df.sparkSession
        self.key, self.step = free_name(df, "id"), free_name(df, "step")
        self.keyed = df.withColumn(self.key, F.when(F.col(order).isNotNull(), uuid_key(F.col(identifier).cast("string"))))
        low, high, self.rows = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
        self.low, self.span = low or 0, (high - low + 1) if low is not None else 1
        self.store = store or SeenStore(spark, session.scratch(spark, "seen"), max(8, -(-self.rows // SHARD_IDS)))
        self.taken: list[tuple[int, int]] = []
        for k in range(batches if low is not None else 0):
            start, end = self.low + self.span * k // batches, self.low + self.span * (k + 1) // batches
            if start < end:
                rows = self.keyed.where(F.col(self.key).isNotNull() & F.col(order).between(start, end - 1))
                rows = rows.select(F.col(self.key).alias("id"), F.col(order).cast("bigint").alias("arrival"))
                self.taken.append((k, self.store.take(rows, -(-self.rows // batches))))

    def firsts(self) -> DataFrame:
        """Arrival numbers of the first deliveries."""
        kept = self.df.sparkSession.createDataFrame([], _FIRST)
        for _, step in self.taken:
            kept = kept.unionByName(self.store.kept(step))
        return kept.select(F.col("arrival").alias(self.order))

    def _repeated(self) -> DataFrame:
        found = self.df.sparkSession.createDataFrame([], f"{_REPEATED}, _ew_k int")
        for k, step in self.taken:
            found = found.unionByName(self.store.repeated(step).withColumn("_ew_k", F.lit(k)))
        return found.select(F.col("id").alias("_ew_i"), "_ew_k", F.col("arrival").alias("_ew_first"), F.col("n").alias("_ew_n"), F.lit(True).alias("_ew_again"))

    def marked(self) -> DataFrame:
        """All rows with surplus: whether an earlier row, or a row taken before, has the identifier.

        Only rows of repeated identifiers have to meet these, so the table isn't shuffled where they are few: their number
        is counted, and up to BROADCAST_ROWS of them are broadcast. Beyond, those with more than a hundred-thousandth of
        all rows each, which can't be many, are broadcast and the rest, none of them large, is joined by a shuffle.
        """
        again = self._repeated()
        step = F.expr(f"((`{self.order}` - {self.low} + 1) * {self.batches} - 1) div {self.span}").cast("int")
        rows = self.keyed.withColumn(self.step, step)
        on = (F.col(self.key) == F.col("_ew_i")) & (F.col(self.step) == F.col("_ew_k"))
        if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            met = rows.join(F.broadcast(again), on, "left")
        else:
            many = F.broadcast(again.where(F.col("_ew_n") * 100_000 >= self.rows))
            heavy, light = rows.join(many, on), rows.join(many, on, "left_anti")
            met = heavy.unionByName(light.join(again.where(F.col("_ew_n") * 100_000 < self.rows), on, "left"))
        surplus = F.coalesce(F.col("_ew_again") & (F.col("_ew_first").isNull() | (F.col(self.order) > F.col("_ew_first"))), F.lit(False))
        return met.select(*[F.col(f"`{c}`") for c in self.df.columns], surplus.alias("_ew_surplus"))


def first_arrivals(
    df: DataFrame, identifier: str = "event_id", order: str = "seq", batches: int = 2, store: SeenStore | None = None
) -> DataFrame:
    """Arrival numbers (column `order`) of the first delivery of each identifier not taken before, over `batches` steps.

    What one step has seen the next one knows by its bitmaps. Without a store a new one is used, so that all of df is the
    whole history. Rows without an identifier or arrival number aren't in the result. Rows that share both count as one
    arrival. An empty table has no first arrival.
    """
    return Deliveries(df, identifier, order, batches, store).firsts()


def surplus(df: DataFrame, identifier: str = "event_id", order: str = "seq", batches: int = 2, store: SeenStore | None = None) -> DataFrame:
    """Rows of df that repeat an identifier delivered before. Rows without identity are never surplus."""
    return Deliveries(df, identifier, order, batches, store).marked().where("_ew_surplus").drop("_ew_surplus")


def deduplicated(df: DataFrame, identifier: str = "event_id", order: str = "seq", batches: int = 2, store: SeenStore | None = None) -> DataFrame:
    """Each row once, as first delivered, all columns as they were; rows without an identifier or arrival number all stay."""
    return Deliveries(df, identifier, order, batches, store).marked().where("not _ew_surplus").drop("_ew_surplus")
