import datetime as dt
import glob

from lakewatch.operators import config, exports
from lakewatch.sources import corpus
from tests.conftest import SF

SMALL = SF.replace("0.01", "0.001")


def test_csv_files_begin_with_a_byte_order_mark_and_are_read_again(spark, tmp_path):
    import csv

    docs, sources = corpus.corpus(spark, SMALL), corpus.sources(spark, SMALL)
    rows = exports.csv_export(docs, sources)
    assert rows.columns == ["doc_id", "uf", "tipo", "tier", "relevancia", "data_pub", "fonte", "titulo", "url", "resumo", "resumo_completo", "pontos_chave", "assuntos_relacionados"]
    exports.write_csv(rows.coalesce(2), str(tmp_path / "out"))
    found = []
    for name in glob.glob(str(tmp_path / "out/*.csv")):
        with open(name, "rb") as f:
            assert f.read(3) == b"\xef\xbb\xbf"
        with open(name, encoding="utf-8-sig", newline="") as f:
            found += list(csv.DictReader(f))
    want = sorted(tuple(r) for r in rows.collect())
    assert len(found) == len(want) and sorted(r["doc_id"] for r in found) == sorted(r[0] for r in want)
    assert len(exports.json_export(docs, sources).columns) == len(exports.digest_items(docs, sources).columns) == 18


def test_iso_times(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5),), (dt.datetime(2024, 1, 2, 3, 4, 5, 60),), (None,)], "t timestamp")
    assert [r[0] for r in rows.select(exports.iso(F.col("t"))).collect()] == ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000060+00:00", None]


def test_mutes_by_commands(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0, 1, "save", "UF=SP 7d"), (t0, 2, "save", "tag=x 1w"), (t0 + dt.timedelta(days=1), 3, "delete", "tag=x"), (t0, 4, "save", "tipo=lei 1y"), (t0, 5, "save", "uf=RJ 7d"), (t0, 6, "save", "UF=MG soon"), (t0, 7, "save", None), (t0 + dt.timedelta(days=90), 8, "delete", "tipo=lei")]
    commands = spark.createDataFrame(rows, "ts timestamp, seq long, verb string, text string")
    at = lambda d: [r.key for r in config.active_mutes(commands, t0 + dt.timedelta(days=d)).collect()]
    assert at(0.5) == ["UF=SP", "tag=x", "tipo=lei"] and at(2) == ["UF=SP", "tipo=lei"] and at(8) == ["tipo=lei"] and at(100) == []
    assert sorted(r.seq for r in config.mute_commands(commands)[1].collect()) == [5, 6, 7]
