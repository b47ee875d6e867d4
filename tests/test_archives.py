"""Archives that can't be read do not stop the others."""

import io
import zipfile

import pytest

from tabulens.sources import archive


def zipped(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_large_archives_are_not_unpacked(monkeypatch):
    large = zipped({"zeros": b"\0" * (2 << 20)})
    assert len(archive.members(large)) == 1
    monkeypatch.setattr(archive, "MOST_BYTES", 1 << 20)
    with pytest.raises(ValueError, match="too large"):
        archive.members(large)


def test_bad_archives(spark):
    good = zipped({"a.txt": "some text"})
    damaged = bytearray(zipped({"a.txt": "some text that is long enough " * 20}))
    damaged[40:50] = b"\xff" * 10  # within the compressed data
    locked = bytearray(good)
    locked[6] |= 1  # the flag of an encrypted member, in both of its headers
    locked[good.index(b"PK\x01\x02") + 8] |= 1
    odd = bytearray(good)
    odd[8] = odd[good.index(b"PK\x01\x02") + 10] = 97  # a method that is not known
    rows = [("good", good), ("damaged", bytes(damaged)), ("locked", bytes(locked)), ("odd", bytes(odd)), ("none", b""), ("last", good)]
    got = {r["project_id"]: r for r in archive.unpack(spark.createDataFrame(rows, "project_id string, content binary")).collect()}
    assert {k for k, r in got.items() if r["error"] is None} == {"good", "last"} and len(got) == len(rows)
    assert all(r["path"] is None for r in got.values() if r["error"])
