"""op9's shards under attempts that are lost, doubled or older."""

from __future__ import annotations

import zlib

import pytest

pytest.importorskip("ledgerlake.llm")

from pyarrow import fs as pafs

from ledgerlake.llm import materialise


class Strict:
    """A store whose renames don't replace, in which another attempt may be first."""

    def __init__(self, before_move=None):
        self.local, self.before_move = pafs.LocalFileSystem(), before_move

    def __getattr__(self, name):
        return getattr(self.local, name)

    def move(self, a, b):
        if self.before_move:
            self.before_move, first = None, self.before_move
            first()
        if self.local.get_file_info(b).is_file:
            raise FileExistsError(b)
        self.local.move(a, b)


def test_publish(tmp_path):
    path, temp = tmp_path / "shard", tmp_path / "temp"
    for fs in (pafs.LocalFileSystem(), Strict()):
        path.unlink(missing_ok=True)
        for raw in (b"one", b"one", b"two, of a newer run"):
            materialise.publish(fs, str(temp), str(path), raw)
            assert path.read_bytes() == raw and not temp.exists()
    path.unlink()
    materialise.publish(Strict(lambda: path.write_bytes(b"same")), str(temp), str(path), b"same")
    assert path.read_bytes() == b"same"
    with pytest.raises(OSError):
        materialise.publish(pafs.LocalFileSystem(), str(temp), str(tmp_path / "missing" / "shard"), b"x")


def test_written_twice_into_one_folder(spark, tmp_path):
    """A second run over other texts replaces the shards; nothing but shards is left."""
    for text in ("a few words ", "other words, and more of them "):
        docs = spark.createDataFrame([(i, text * 40) for i in range(30)], "doc_id long, text string")
        slots = materialise.write(docs, str(tmp_path / "out"), seq_len=64, shard_size=8)
        found = {r["slot"]: r["ids_crc32"] for r in slots.collect()}
        got = [zlib.crc32(x.tobytes()) for x in materialise.read_slots(str(tmp_path / "out"), 0, len(found), seq_len=64, shard_size=8)]
        assert got == [found[i] for i in range(len(found))]
        assert all(x.name.startswith("shard-") for x in (tmp_path / "out").iterdir())
