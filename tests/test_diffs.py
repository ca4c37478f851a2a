"""Diffs in files against a plain reading of the whole file, at every split size."""

import io
import random

import pytest

from weft.sources import diffs


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


LOOKS_RAW = b":100644 100644 aa bb M"
LOOKS_COUNTS = b"3\t4\tx"


def _raw(rng, n):
    out = []
    for i in range(n):
        names = [rng.choice([b"a/b", b"x", LOOKS_RAW, LOOKS_RAW[:-1] + b"R100", LOOKS_COUNTS, b"p" * rng.randrange(1, 60), "é 😀".encode()]) for _ in range(2)]
        s = rng.choice(["A", "D", "M", "T", "R90", "C100"])
        paths = names if s[0] in "RC" else names[:1]
        out.append((b":100644 100755 %040x %040x %s" % (i, i + 1, s.encode()), paths))
    return out


def _counts(rng, n):
    out = []
    for i in range(n):
        names = [rng.choice([b"a\tb", b"x", LOOKS_COUNTS, b"-\t-\t", b"0\t0\t" + LOOKS_RAW]) for _ in range(2)]
        head = rng.choice([b"-\t-\t", b"%d\t%d\t" % (i, 2 * i)])
        out.append((head, names) if rng.random() < 0.5 else (head + names[0], []))
    return out


def _bytes(rows):
    return b"".join(b"".join(x + b"\0" for x in [head, *paths]) for head, paths in rows)


@pytest.mark.parametrize("form, make", [("raw", _raw), ("counts", _counts)])
def test_any_split_gives_the_same_records(form, make, monkeypatch):
    monkeypatch.setattr(diffs, "_LOOK_BACK", 16)
    monkeypatch.setattr(diffs, "_READ", 37)
    rng = random.Random(5)
    for n in (0, 1, 2, 40):
        rows = make(rng, n)
        data = _bytes(rows)
        for size in [*range(1, 30), 64, 100, 1000, len(data) + 1]:
            got = [r for at in range(0, len(data), size) for r in diffs.records(_File(data), form, at, at + size)]
            assert [(h, p) for _, h, p in got] == rows
            assert all(data[at:].startswith(h) for at, h, _ in got)


def test_paths_that_look_like_records_throughout(monkeypatch):
    monkeypatch.setattr(diffs, "_LOOK_BACK", 16)
    rows = [(LOOKS_RAW, [LOOKS_RAW])] * 50
    data = _bytes(rows)
    for size in (7, 23, 24, 500):
        assert [(h, p) for at in range(0, len(data), size) for _, h, p in diffs.records(_File(data), "raw", at, at + size)] == rows


@pytest.mark.parametrize("data", [b"x\0", LOOKS_RAW + b"\0", LOOKS_RAW + b"\0a", LOOKS_RAW + b"\0\0", LOOKS_RAW + b"\0a\0b\0"])
def test_malformed_files_are_refused(data):
    with pytest.raises(ValueError, match="malformed"):
        list(diffs.records(_File(data), "raw", 0, len(data)))


def test_source_prunes_and_joins(spark, tmp_path):
    raw, counts = tmp_path / "raw", tmp_path / "counts"
    for d in (raw / "cs_id=7", counts / "cs_id=7", raw / "_temporary"):
        d.mkdir(parents=True)
    head = lambda s: b":100644 100644 aa bb " + s
    (raw / "cs_id=7" / "part-0.txt").write_bytes(_bytes([(head(b"M"), [b"a"]), (head(b"R50"), [b"b", "ü/c".encode()])]))
    (raw / "cs_id=7" / "part-1.txt").write_bytes(_bytes([(head(b"D"), [b"../d"])]))
    (raw / "8.raw").write_bytes(_bytes([(head(b"A"), [b"a"])]))
    (raw / "9.raw").write_bytes(b"")
    (raw / "_temporary" / "x").write_bytes(b"no record")
    (counts / "cs_id=7" / "part-0.txt").write_bytes(_bytes([(b"1\t2\ta", []), (b"-\t-\t", [b"b", "ü/c".encode()])]))
    for size in (1, 5, 1 << 20):
        got = {(r.cs_id, r.old_path, r.new_path): (r.status, r.score, r.added, r.deleted, r.safe) for r in diffs.read_changes(spark, str(raw), str(counts), size).collect()}
        assert got == {
            ("7", "a", "a"): ("M", None, 1, 2, True), ("7", "b", "ü/c"): ("R", 50, 0, 0, True), ("7", "../d", None): ("D", None, 0, 0, False), ("8", None, "a"): ("A", None, 0, 0, True),
        }
    (raw / "bad.raw").write_bytes(b"no record\0")
    some = diffs.read_diffs(spark, str(raw), "raw", 5, changeSets="7,8")  # the bad file isn't read
    assert sorted(r.new_path or "" for r in some.collect()) == ["", "a", "a", "ü/c"]
    assert sorted(r.cs_id for r in some.where("cs_id = '7'").union(some.where("cs_id = '8'")).collect()) == ["7", "7", "7", "8"]
    assert some.count() == 4 and some.where("status = 'R'").count() == 1
    assert [r.old_path for r in diffs.read_diffs(spark, str(raw), changeSets="7", statuses="R,T").collect()] == ["b"]
    assert diffs.read_diffs(spark, str(raw), changeSets="none").count() == 0
    with pytest.raises(Exception, match="bad.raw"):
        diffs.read_diffs(spark, str(raw)).collect()
