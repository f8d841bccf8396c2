import gzip
import random

import model
import numpy as np
import pytest
import zstandard

from braidlog.operators.sinks import FrameWriter
from braidlog.plans.days import merge
from braidlog.sources import reader as R
from braidlog.sources.lines import scan_any


def lines_of(data: bytes) -> list[bytes]:
    out = data.split(b"\n")
    return out if out[-1] else out[:-1]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranges_give_every_line_once(tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    data = b"\n".join(bytes(rng.choices(b"ab\r\0", k=rng.choice([0, 0, 1, 3, 40, 900]))) for _ in range(400)) + rng.choice([b"", b"\n", b"\n\n"])
    monkeypatch.setattr(R, "BATCH", 300)
    monkeypatch.setattr(R, "CHUNK", 97)
    cuts = sorted(rng.randrange(len(data) + 1) for _ in range(25))
    pack = zstandard.ZstdCompressor().compress
    frames = [(pack(x), len(x)) for x in (data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True))]
    files = {
        "plain": data,
        "one.zst": pack(data),
        "frames.zst": b"".join(f for f, _ in frames),
        "table.zst": b"".join(f for f, _ in frames) + R.seek_table([(len(f), n) for f, n in frames]),
        "members.gz": gzip.compress(data[:500]) + gzip.compress(data[500:]) + b"\0" * 20,
    }
    assert zstandard.ZstdDecompressor().stream_reader(files["table.zst"], read_across_frames=True).read() == data
    for name, stored in files.items():
        (tmp_path / name).write_bytes(stored)
        for step in (64, 1000, 1 << 30):
            ranges = R.ranges(0, f"file:{tmp_path}/{name}", step)
            assert (len(ranges) > 5) == (name in ("plain", "table.zst") and step < 1000) or step == 1000
            got = [bytes(body[a:b]) for r in ranges for body, at in R.pieces(r) for a, b in zip(at[:-1], at[1:], strict=True)]
            assert got == lines_of(data), (name, step)


def test_keys_equal_the_model():
    rng = random.Random(3)
    stems = ["2026-05-15T00:00:31", "0000-00-00T00:00:00", "9999-99-99T99:99:99", "2026-05-15 00:00:31", "2026-05-15T00:00:3", ""]
    lines = [(s + t).encode() for s in stems for t in ("", "Z", ".5", ".5Z", ".", ".1234567890", ".123456789", "xyz", ".5.5", ".000000001")]
    rng.shuffle(lines)
    body, offsets = np.frombuffer(b"".join(lines), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in lines])))
    found, seconds, fraction = R.keys_of(body, offsets)
    for line, ok, a, b in zip(lines, found, seconds, fraction, strict=True):
        want = model.key(line)
        assert ok == (want is not None)
        if ok:
            assert f"{a:014d}{b:09d}" == "".join(c for c in want if c.isdigit())
    most = R.running(seconds, fraction, (0, 5))
    so_far = (0, 5)
    for a, b, *got in zip(seconds, fraction, *most, strict=True):
        so_far = max(so_far, (a, b))
        assert tuple(got) == so_far


def test_numbers_and_keys_carry_over_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "RANGE", 700)
    rows = [f"2026-05-15T00:00:{random.Random(i).randrange(60):02d} line {i}" if i % 3 else f"  more of {i}" for i in range(300)]
    (tmp_path / "a.gz").write_bytes("\n".join(rows).encode())  # plain, whatever its name says
    out = R.whole_files(*R.read_lines(spark, [f"file:{tmp_path}/a.gz"], keys=True))
    got = {r["line_no"]: (bytes(r["line"]).decode(), r["seconds"]) for r in out.collect()}
    most, want = 0, {}
    for i, line in enumerate(rows, 1):
        most = max(most, int("".join(c for c in line[:19] if c.isdigit())) if line[0] != " " else 0)
        want[i] = (line, most)
    assert got == want
    assert out.rdd.getNumPartitions() > 5


@pytest.mark.parametrize("cut", ["zst", "gz"])
def test_data_that_ends_early_names_the_file(spark, tmp_path, cut):
    data = random.Random(1).randbytes(90_000)
    packed = gzip.compress(data) if cut == "gz" else zstandard.ZstdCompressor().compress(data)
    (tmp_path / "short.log").write_bytes(packed[:40_000])
    with pytest.raises(Exception, match="short.log"):
        scan_any(spark, [str(tmp_path / "short.log")]).count()


def test_one_file_of_equal_timestamps_and_several_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stamp = "2026-05-15T00:00:00Z"
    for n in range(3):
        (tmp_path / "in" / f"debug.log-20260515-n{n}.gz").write_bytes(gzip.compress("".join(f"{stamp} {n} {i}\n" for i in range(50)).encode()))
    (tmp_path / "in" / "debug.log-20260516-only.gz").write_bytes(gzip.compress("".join(f"2026-05-16T00:{i % 60:02d}:00Z {i}\n" for i in range(5000)).encode()))
    seen = {}
    for level, jobs, days in ((1, 1, 1), (1, 5, 2), (9, 3, 0)):
        merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), level=level, jobs=jobs, days_at_once=days, check=True, frame=2000)
        for day in ("20260515", "20260516"):
            with open(tmp_path / "out" / f"debug.log-{day}.zst", "rb") as f:
                data = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
            assert seen.setdefault(day, data) == data
    assert seen["20260515"].decode().splitlines() == [f"n{n} {stamp} {n} {i}" for n in range(3) for i in range(50)]
    want = model.merge([("only", [f"2026-05-16T00:{i % 60:02d}:00Z {i}".encode() for i in range(5000)])])
    assert seen["20260516"].splitlines() == want


def test_a_writer_that_fails_leaves_nothing_and_the_next_run_recovers(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"debug.log-20260515-n{n}.gz").write_bytes(gzip.compress("".join(f"2026-05-15T00:00:{i % 60:02d}Z {i}\n" for i in range(500)).encode()))
    plain = FrameWriter.commit
    monkeypatch.setattr("braidlog.operators.sinks.published", None)
    monkeypatch.setattr("braidlog.plans.days.published", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), level=1)
    assert list((tmp_path / "out").iterdir()) == [] and FrameWriter.commit is plain
    monkeypatch.undo()
    (tmp_path / "out" / "debug.log-20260515.zst.123-dead.tmp").write_bytes(b"left by a killed run")
    assert merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), level=1, check=True).ok


def test_frames_hold_whole_lines_of_one_key(tmp_path):
    import pyarrow as pa
    from braidlog.operators.sinks import frames

    rng = random.Random(5)
    rows = sorted((rng.choice("abc"), i, bytes(rng.choices(b"xyz", k=rng.randrange(30))) + b"\n") for i in range(500))
    cuts = [0, 7, 7, 120, 499, 500]
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows[a:b]], type=pa.string()), pa.array([x for _, _, x in rows[a:b]], type=pa.binary())], names=["key", "line"]) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = list(frames(iter(batches), "plain", 0, 200))
    assert all(size == len(data) and data.endswith(b"\n") for _, data, size in out)
    assert max(size for _, _, size in out) < 230
    for key in "abc":
        assert b"".join(d for k, d, _ in out if k == key) == b"".join(x for k, _, x in rows if k == key)
