from datetime import datetime, timedelta

from packs import pack_of

from tessera.streaming import translate as streaming


def test_stream(spark, tmp_path):
    t0 = datetime(2022, 1, 1)
    schema = "pack_id string, stream_id string, pos bigint, code int, arrived_at timestamp"
    rows = [("pack-test", "s", 0, 0, t0), ("pack-test", "s", 0, 0, t0 + timedelta(minutes=1)), ("pack-test", "s", 1, 7, t0 + timedelta(minutes=5)), ("pack-test", "s", 2, 99, t0 + timedelta(hours=2))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "codes"))
    codes = streaming.read_codes(spark, str(tmp_path / "codes"), schema)
    pack = pack_of(spark, aliases={7: 1})
    out = streaming.translate_stream(codes, pack.header, pack.symbols, pack.codebook, pack.aliases)
    got = sorted((r["pos"], r["state"], r["english"]) for r in streaming.run_available(out, "glosses").collect())
    assert got == [(0, "ok", "Symbol for north."), (0, "ok", "Symbol for north."), (1, "aliased", "Symbol for south."), (2, "unknown", "[undecodable: no symbol for code 99]")]
    assert streaming.run_available(streaming.deduplicated(codes), "once").count() == 3
    counted = streaming.run_available(streaming.counts_by_window(codes, late="1 minute"), "counts").collect()
    assert {(r["begin"].hour, r["code"], r["n"]) for r in counted} >= {(0, 0, 2), (0, 7, 1)}
