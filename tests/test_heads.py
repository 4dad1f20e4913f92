"""First bytes of real files."""

from __future__ import annotations

import pytest

from inkledger.sources import heads, images


def test_heads_of_nested_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(heads, "FILES_PER_TASK", 3)
    content = {"a.tif": b"II*\0" + b"x" * 5000, "b.tif": b"", "c.png": b"\x89PNG\r\n\x1a\n!", "d.jpg": b"\xff\xd8",
               "deep/e.tif": b"MM\0*rest of it, and more", "deep/er/f.tif": b"not an image at all", "g.bmp": b"BM"}
    for name, data in content.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r["path"]: (r["length"], bytes(r["content"])) for r in heads.file_heads(spark, str(tmp_path)).collect()}
    assert rows == {f"{tmp_path}/{name}": (len(data), data[:16]) for name, data in content.items()}
    probed = {r["path"].removeprefix(f"{tmp_path}/"): r["readable"] for r in images.probe_images(spark, str(tmp_path)).collect()}
    assert probed == {"a.tif": True, "b.tif": False, "c.png": True, "d.jpg": False, "deep/e.tif": True,
                      "deep/er/f.tif": False, "g.bmp": True}


def test_empty_and_missing_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert heads.file_heads(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        heads.file_heads(spark, str(tmp_path / "gone")).count()
