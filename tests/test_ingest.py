"""Commits of several kinds, and the ingest of banks as one call."""

import json
import os

import pytest
from pyspark.sql import functions as F

from bandloom.plans import ingest as plans
from bandloom.sources import banks, commits, ingest, sinks
from bandloom.sources.tables import ContractError

SAYS = {"units": "SDU", "representation": "gain_model_input_sdu"}


def of_every_kind(spark):
    """A small table for each layout, the session's id looking like a number."""
    out = {}
    for kind, (columns, _) in sinks.LAYOUTS.items():
        of = {"session_id": F.lit("007"), "data": F.array(F.lit(1.5)), "value": F.lit(2.5), "channel": F.lit("c"), "key": F.lit("k"), "component": F.lit("re")}
        out[kind] = spark.range(3).select(*[of.get(c, F.col("id")).alias(c) for c in columns], *([F.lit(31).alias("bit_slice")] if kind == "spectra" else []))
    return out


def test_all_layouts_in_one_commit(spark, tmp_path):
    out = str(tmp_path)
    with commits.Commit(spark, out, "first") as c:
        for kind, df in of_every_kind(spark).items():
            c.save_kind(df, kind, **SAYS)
    assert set(c.rows) == set(sinks.LAYOUTS) and set(c.rows.values()) == {3}
    for kind, df in of_every_kind(spark).items():
        got = commits.read_kind(spark, out, kind)
        assert sorted(map(str, got.select(*df.columns).collect())) == sorted(map(str, df.collect())), kind


def test_a_failure_leaves_nothing(spark, tmp_path):
    out, kinds = str(tmp_path), of_every_kind(spark)
    broken = kinds["telemetry"].withColumn("value", F.raise_error(F.lit("injected")).cast("double"))
    with pytest.raises(Exception, match="injected"), commits.Commit(spark, out, "bad") as c:
        c.save_kind(kinds["zoom"], "zoom")
        c.save_kind(broken, "telemetry")
    assert commits.records(out) == [] and not any(d.startswith("commit_id") for _, ds, _ in os.walk(out) for d in ds)
    with pytest.raises(ContractError):
        commits.read_kind(spark, out, "zoom")


def test_a_name_is_committed_again(spark, tmp_path):
    out, df = str(tmp_path), of_every_kind(spark)["zoom"]
    for n in (1, 2):
        with commits.Commit(spark, out, "same") as c:
            c.save_kind(df.filter(F.col("pfb_index") < n), "zoom")
    with commits.Commit(spark, out, "other") as c:
        c.save_kind(df.withColumn("more", F.lit(1)), "zoom")
    got = commits.read_kind(spark, out, "zoom")
    assert got.count() == 5 and got.filter("more is null").count() == 2
    # The data of the commit that was replaced are nobody's.
    assert commits.sweep(out) == 1 and commits.sweep(out) == 0 and commits.read_kind(spark, out, "zoom").count() == 5


def test_many_sessions_share_files_and_older_commits_are_read(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    rows = spark.range(300).select(F.format_string("%03d", "id").alias("session_id"), F.col("id").alias("t"), F.lit("c").alias("channel"), F.lit(1.0).alias("value"))
    with commits.Commit(spark, out, "new") as c:
        c.save_kind(rows, "telemetry")
    assert sum(f.endswith(".parquet") for _, _, fs in os.walk(out) for f in fs) <= 4
    # A commit of before: a folder a session, and a record that says nothing of it.
    save = sinks.save_kind
    monkeypatch.setattr(sinks, "save_kind", lambda *a, apart, **more: save(*a, apart=True, **more))
    with commits.Commit(spark, out, "old") as c:
        c.save_kind(rows.limit(3).withColumn("more", F.lit(1)), "telemetry")
    record = tmp_path / commits.RECORDS / "old.json"
    record.write_text(json.dumps({k: v for k, v in json.loads(record.read_text()).items() if k != "apart"}))
    got = commits.read_kind(spark, out, "telemetry")
    assert got.count() == 303 and got.filter("more = 1").count() == 3 and got.filter("session_id = '007'").count() == 1


def test_what_is_refused(spark, tmp_path):
    df = of_every_kind(spark)["zoom"]
    for bad in ("", "a/b", ".hidden", "_x"):
        with pytest.raises(ContractError):
            commits.Commit(spark, str(tmp_path), bad)
    with pytest.raises(ContractError), commits.Commit(spark, str(tmp_path), "twice") as c:
        c.save_kind(df, "zoom")
        c.save_kind(df, "zoom")
    for name, kind in (("a", "int"), ("b", "string")):
        with commits.Commit(spark, str(tmp_path), name) as c:
            c.save_kind(df.withColumn("more", F.lit(1).cast(kind)), "zoom")
    with pytest.raises(ContractError):
        commits.read_kind(spark, str(tmp_path), "zoom")


def test_empty_kinds(spark, tmp_path):
    with commits.Commit(spark, str(tmp_path), "none") as c:
        c.save_kind(of_every_kind(spark)["grimm"].filter("unique_packet_id < 0"), "grimm")
        c.table(spark.range(0), "rejects", {"a": F.col("id") > 1})
    assert c.rows == {"grimm": 0, "rejects": 0} and c.counts["rejects"] == {"a": 0}
    got = commits.read_kind(spark, str(tmp_path), "grimm")
    assert got.count() == 0 and "session_id" in got.columns


def frame(appid, body, flags=3, good=True):
    head = appid.to_bytes(2, "big") + (flags << 14).to_bytes(2, "big") + (len(body) - 1).to_bytes(2, "big")
    return banks.SYNC + head + body + (banks.crc16(head + body) ^ (not good)).to_bytes(2, "big")


def science(appid, uid, text, **more):
    body = (b"" if uid is None else uid.to_bytes(4, "little")) + text.encode()
    return frame(appid, bytes(b for i in range(0, len(body) - 1, 2) for b in (body[i + 1], body[i])) + body[len(body) // 2 * 2 :], **more)


def test_every_reason_and_a_session_over_banks(spark, tmp_path):
    b05 = [
        science(plans.DERIVED, None, '{"k": 1}'), science(plans.HELLO, 10, '{"k": 22}'.ljust(10)), science(plans.DERIVED, None, '{"k": 3}'), science(plans.SPECTRA, 11, '{"k": 44}', good=False),
        science(plans.SPECTRA, 12, "odd"), science(plans.DROPPED, 13, '{"k": 5}'), science(plans.UNKNOWN, 14, '{"k": 6}'), science(plans.SPECTRA, 15, '{"k": 13}'.ljust(10)), science(plans.SPECTRA, 16, "open", flags=1 - 1),
    ]
    b06 = [science(plans.SPECTRA, 5, '{"k": 7}'), science(plans.HELLO, 20, '{"k": 8}'), science(plans.SPECTRA, 21, '{"k": 9}')]
    b01 = [frame(plans.TELEMETRY, t.to_bytes(4, "little") + b'{"k": 1}') for t in (4, 12, 25)]
    rows = [("s", "b05", b"".join(b05)), ("s", "b06", b"".join(b06)), ("s", "b01", b"".join(b01)), ("lone", "b01", b01[0])]
    sinks.write_banks(spark.createDataFrame(rows, "stream_id string, bank string, content binary"), str(tmp_path / "in"))
    out = str(tmp_path / "out")
    done = ingest.ingest(spark, str(tmp_path / "in"), out, plans.formats(spark), "day", range_bytes=40)
    told = {k: v for k, v in done.counts["rejects"].items() if v}
    assert told == {"crc": 1, "odd": 1, "open": 1, "dropped": 1, "no uid": 1, "unknown appid": 1, "decode": 1, "no session": 1}
    assert done.rows["rejects"] == 8 == commits.read_kind(spark, out, "rejects").count()
    at = lambda kind: sorted((r[0], r[1]) for r in commits.read_kind(spark, out, kind).selectExpr("session_id", "data[0]" if kind in ("tr_spectra", "waveform") else "value").collect())
    # In the order of uids 5 stands before the first hello: a session without a start, as its own.
    assert at("constants") == [("s.00001", 22.0), ("s.00002", 8.0)] and at("waveform") == [("s.00001", 3.0)]
    assert at("tr_spectra") == [("s.00000", 7.0), ("s.00002", 9.0)]
    assert sorted(r.session_id for r in commits.read_kind(spark, out, "telemetry").collect()) == ["s.00000", "s.00001", "s.00002"]
    said = {r.session_id: json.loads(r.manifest) for r in commits.read_kind(spark, out, "manifests").collect()}
    assert [said[k].get("start") for k in sorted(said)] == [None, 10.0, 20.0] and said["s.00001"]["hi"] == 20.0 and "hi" not in said["s.00002"]
