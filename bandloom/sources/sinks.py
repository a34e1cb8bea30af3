"""Writers: checked first, one table per kind, partitioned by session."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.bits import packet_name
from ..operators.products import exactly_sized, retain, size_violations, sized, slice_violations
from ..operators.sessions import manifest
from .tables import ContractError, with_terms

LAYOUT_VERSION = 3
#: Kinds whose rows need a finite value somewhere; the others keep every row.
RETAINED = {"spectra": "data", "tr_spectra": "data"}
#: Fixed layouts: the columns that each kind must have, and the order of its rows inside a session.
LAYOUTS = {
    "spectra": (("session_id", "orig_idx", "product", "data"), ("orig_idx", "product")), "tr_spectra": (("session_id", "orig_idx", "data"), ("orig_idx",)),
    "zoom": (("session_id", "pfb_index", "component", "data"), ("pfb_index", "component")), "grimm": (("session_id", "unique_packet_id", "data"), ("unique_packet_id",)),
    "waveform": (("session_id", "channel", "data"), ("channel",)), "calibrator": (("session_id", "packet", "channel", "data"), ("packet", "channel")),
    "telemetry": (("session_id", "t", "channel", "value"), ("t", "channel")), "interpolated": (("session_id", "orig_idx", "channel", "value"), ("orig_idx", "channel")),
    "invariants": (("session_id", "key", "value"), ("key",)), "constants": (("session_id", "key", "value"), ("key",)), "housekeeping": (("session_id", "type", "raw_seconds"), ("type", "raw_seconds")),
}
#: Fixed fields of each housekeeping type; other types keep the base columns.
HOUSEKEEPING = {0: ("time",), 1: ("adc_min", "adc_max", "adc_mean", "adc_rms", "actual_gain"), 2: ("time", "ok"), 3: ("checksum", "weight_ndx")}
HK_BASE = ("session_id", "unique_packet_id", "version", "errors", "raw_seconds")


def save(df: DataFrame, folder: str, kind: str, order: list[str] | None = None, slices: int = 1, name: str | None = None, counted: Observation | None = None, apart: bool = True, **provenance: str) -> DataFrame:
    """Write one kind and return the rows as written. Spectra with wrong bit slices are refused before anything is created;
    ``slices`` files a session keep a session that holds most rows from landing in one task. ``provenance`` is said on every
    row and in the metadata of ``data``. The folder is named by the kind, or by ``name``; the tasks that write tell
    ``counted`` their rows. Not ``apart``, a file holds many sessions, one after the other, and their ids as a column, so that
    many small sessions cost their rows and not a folder each."""
    if kind == "spectra" and "actual_bitslice" in df.columns and not slice_violations(df, "actual_bitslice").isEmpty():
        raise ContractError("bit slices must be 16 whole numbers from 0 to 31")
    if kind in RETAINED and dict(df.dtypes).get(RETAINED[kind], "").startswith("array<") and "array<array" not in dict(df.dtypes)[RETAINED[kind]]:
        df = retain(df, RETAINED[kind])
    df = df.withColumns({k: F.lit(v) for k, v in {"layout_version": LAYOUT_VERSION, **provenance}.items()})
    if provenance and "data" in df.columns:
        df = with_terms(df, "data", **provenance)
    dealt = df.repartition(F.col("session_id"), F.pmod(F.xxhash64(*[c for c in df.columns if not dict(df.dtypes)[c].startswith("map")]), F.lit(slices)))
    if order:
        dealt = dealt.sortWithinPartitions("session_id", *order)
    if counted is not None:
        # Behind the shuffle: a task that writes is counted once, one that is repeated for a lost executor is not.
        dealt = dealt.observe(counted, F.count(F.lit(1)).alias("rows"))
    path = "/".join(filter(None, [folder, kind if name is None else name]))
    (dealt.write.partitionBy("session_id") if apart else dealt.write).parquet(path)
    return dealt


def save_kind(df: DataFrame, folder: str, kind: str, slices: int = 1, name: str | None = None, counted: Observation | None = None, apart: bool = True, **provenance: str) -> DataFrame:
    """Write one kind in its own layout; a kind or column that the layout does not know or lacks is refused first."""
    if kind not in LAYOUTS:
        raise ContractError(f"no such kind: {kind!r}")
    need, order = LAYOUTS[kind]
    lacking = [c for c in need if c not in df.columns]
    if lacking:
        raise ContractError(f"{kind} lacks {lacking}")
    return save(df, folder, kind, list(order), slices, name, counted, apart, **provenance)


def housekeeping_table(hk: DataFrame, type_id: int, channels: list[str] | None = None) -> DataFrame:
    """Rows (base columns, type, fields map<string,double>) of one type as columns, by time. Missing numbers are 0, missing
    channels of type 2 null."""
    rows = hk.filter(F.col("type") == type_id)
    at: dict[str, Column] = {f: F.coalesce(F.element_at("fields", f), F.lit(0.0)) for f in HOUSEKEEPING.get(type_id, ())}
    if type_id == 2:
        at |= {c: F.element_at("fields", c) for c in channels or []}
    return rows.select(*HK_BASE, *[c.alias(n) for n, c in at.items()]).orderBy("session_id", "raw_seconds")


def telemetry_channels(hk: DataFrame, prefix: str = "telemetry") -> list[str]:
    """Names of the dynamic channels over all rows, in the order of their first packets and places there; there are as many as
    an instrument has sensors."""
    row = F.struct("session_id", "unique_packet_id")
    keys = hk.select(row.alias("row"), F.posexplode(F.map_keys(F.map_filter("fields", lambda k, _: k.startswith(prefix)))).alias("place", "k"))
    return [r["k"] for r in keys.groupBy("k").agg(F.min(F.struct("row", "place")).alias("first")).orderBy("first", "k").collect()]


def metadata_columns(df: DataFrame, flat: list[str], vectors: dict[str, int], exact: dict[str, int] | None = None, packet: str = "meta", base: str = "base") -> DataFrame:
    """Fields of the packet's struct, or of the base struct where the packet lacks them, matched without regard to case;
    vectors are cut or padded to their width. Those in ``exact`` must have it with finite values only: all rows are looked
    at first, and any that has not raises before anything is made of them."""

    def pick(name: str) -> Column:
        found = []
        for struct in (packet, base):
            names = {f.name.lower(): f.name for f in df.schema[struct].dataType.fields} if struct in df.columns else {}
            if name.lower() in names:
                found.append(F.col(f"{struct}.{names[name.lower()]}"))
        return F.coalesce(*found) if found else F.lit(None)

    wrong = size_violations(df, {n: (pick(n), w) for n, w in exact.items()}).collect() if exact else []
    if wrong:
        raise ContractError("; ".join(f"{r['n']} rows without exactly {exact[r['name']]} finite values in {r['name']}" for r in wrong))
    return df.withColumns({**{n: pick(n) for n in flat}, **{n: sized(pick(n), w) for n, w in vectors.items()}, **{n: exactly_sized(pick(n), w) for n, w in (exact or {}).items()}})


def write_packets(packets: DataFrame, folder: str, keys: list[str], apart: bool = True) -> None:
    """Packets with their file names, NNNNN_XXXX.bin in the order of each session, partitioned by session. Not ``apart``, a file
    holds many sessions, one after the other, and their keys as columns: for so many sessions that a folder each is too much."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    named = packets.withColumn("_i", F.row_number().over(w.orderBy("unique_packet_id", "seq", "pkt_idx")) - 1).withColumn("_n", F.count("*").over(w))
    named = named.withColumn("file", packet_name(F.col("_i"), F.col("appid"), F.col("_n"))).drop("_i", "_n")
    (named.write.partitionBy(*keys) if apart else named.sortWithinPartitions(*keys, "unique_packet_id", "seq", "pkt_idx").write).parquet(f"{folder}/packets")


def write_manifest(summary: DataFrame, path: str) -> None:
    manifest(summary).write.text(path)


def write_banks(banks: DataFrame, folder: str) -> None:
    """Write stream_id, bank, content as bank files, <stream>/<bank>/FFFFFFFE below ``folder``. A file appears whole or not at
    all, and a task that runs again writes the same one."""
    from .banks import BANK_FILE
    from .ranges import located

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = located(folder)
        for batch in batches:
            for r in batch.itertuples(index=False):
                place = f"{top}/{r.stream_id}/{r.bank}"
                system.create_dir(place, recursive=True)
                part = f"{place}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(bytes(r.content))
                system.move(part, f"{place}/{BANK_FILE}")
            yield pd.DataFrame({"n": [len(batch)]})

    banks.select("stream_id", "bank", "content").mapInPandas(put, "n long").write.format("noop").mode("overwrite").save()


def write_packed_banks(banks: DataFrame, folder: str) -> None:
    """Write stream_id, bank, content as a few large files below ``folder``/bytes and a table of them, ``folder``/index
    (stream_id, bank, at, path, start, size): ``size`` bytes of a bank, from its byte ``at`` on, stand at ``start`` of the file
    ``path``. Banks of a few bytes then cost their bytes and not a file each. A task writes a file of its own, and what the
    index, which is committed as a whole, does not name is not there."""
    from .ranges import INDEX, located

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = located(folder)
        name, start = uuid.uuid4().hex, 0
        system.create_dir(f"{top}/bytes", recursive=True)
        with system.open_output_stream(f"{top}/bytes/{name}") as f:
            for batch in batches:
                starts, sizes = [], []
                for content in batch["content"].to_pylist():
                    f.write(content or b"")
                    starts.append(start)
                    sizes.append(len(content or b""))
                    start += sizes[-1]
                n = len(batch)
                yield pa.RecordBatch.from_arrays([batch["stream_id"], batch["bank"], pa.array([0] * n, pa.int64()), pa.array([f"{folder}/bytes/{name}"] * n), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["stream_id", "bank", "at", "path", "start", "size"])

    banks.select("stream_id", "bank", "content").mapInArrow(put, INDEX).write.parquet(f"{folder}/index")
