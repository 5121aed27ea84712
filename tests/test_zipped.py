import io
import os
import subprocess
import sys
import zipfile

from lakewatch.sources import payloads, zipped
from tests.conftest import ROOT

FIELDS = ["IdDocumento", "Natureza", "NroLegislativo", "AnoLegislativo", "Ementa", "DtEntradaSistema", "DtPublicacao"]


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name.replace("_", "."), text)
    return out.getvalue()


def record(k, kind="PL", day="2024-01-05"):
    return f"<propositura><IdDocumento>{k}</IdDocumento><Natureza>{kind}</Natureza><NroLegislativo>{k}</NroLegislativo><AnoLegislativo>2024</AnoLegislativo><Ementa>imposto &amp; <b>taxa</b> {k}</Ementa><DtEntradaSistema>{day}</DtEntradaSistema></propositura>"


def test_records_filters_and_quarantine(spark, tmp_path):
    whole = "<r>" + "".join(record(k, "PL" if k % 2 else "REQ", f"2024-01-{k:02d}") for k in range(1, 21)) + "</r>"
    (tmp_path / "a.zip").write_bytes(archive(x_xml=whole, y_XML="<r>" + record(99) + "</r>", z_txt="no"))
    (tmp_path / "b.zip").write_bytes(b"no archive")
    (tmp_path / "c.zip").write_bytes(archive(x_xml="<r>" + record(50) + "<propositura><Id"))
    (tmp_path / "d.zip").write_bytes(archive())
    land = zipped.landed(spark, str(tmp_path))
    rows, bad = zipped.zipped_records(land, "propositura", FIELDS)
    got = {(r.source_id, r.IdDocumento): r for r in rows.collect()}
    assert set(got) == {("a", str(k)) for k in [*range(1, 21), 99]} | {("c", "50")}
    assert got["a", "3"].Ementa == "imposto & taxa 3" and got["a", "3"].DtPublicacao is None
    assert sorted(r.source_id for r in bad.collect()) == ["b", "c"]
    few, _ = zipped.zipped_records(land, "propositura", FIELDS, {"Natureza": ["PL"]}, ("DtEntradaSistema", "2024-01-11"))
    assert {r.IdDocumento for r in few.where("source_id = 'a'").collect()} == {"11", "13", "15", "17", "19"}
    assert zipped.zipped_records(land, "propositura", FIELDS, max_items=4)[0].count() == 4
    items = payloads.map_xml(rows, "alesp", "alesp", "2024-01-31", keywords=["imposto"], kinds=["PL"])
    assert items.count() == 12 and items.where("titulo = 'PL 3/2024'").count() == 1


def test_a_large_archive_is_read_in_little_memory():
    script = f"""
import resource, sys; sys.path.insert(0, {ROOT!r})
from tests.test_zipped import FIELDS, archive, record
from lakewatch.sources import zipped
one = "".join(record(k) for k in range(3000))
import io, zipfile
out = io.BytesIO()
with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("x.xml", "w") as f:
    f.write(b"<r>")
    for _ in range(100):
        f.write(one.encode())
    f.write(b"</r>")
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(1 for _ in zipped.records(out.getvalue(), "propositura", FIELDS))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    n, mb = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, env=os.environ).stdout.split()[-2:]
    assert int(n) == 300_000 and int(mb) < 100
