import gzip
import random

import model
import pytest
import zstandard

from braidlog.cli import main
from braidlog.plans.days import merge, split
from braidlog.plans.templates import per_node
from braidlog.sources.lines import discover, scan, scan_any
from braidlog.streaming.accumulate import accumulate, fold_batch, merge_new_days


def unpacked(path):
    with open(path, "rb") as f:
        return zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()


def put(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(gzip.compress(data))


def random_folder(folder, seed, days=("20260515", "20260516")):
    rng = random.Random(seed)
    shapes = [b"2026-05-15T00:%02d:%02dZ plain", b"2026-05-15T00:%02d:%02d.5Z frac", b"\tcontinuation %d %d", b"no stamp %d %d\r", b"nul \0 %d %d", b"\xff\xfe\x80 %d %d", b" 2026-05-15T00:%02d:%02d indented", b"9999-99-99T99:%02d:%02d odd", b"2026-05-15T00:%02d:%02d.1234567890 bad"]
    files = {}
    for day in days:
        for n in range(rng.randrange(2, 5)):
            lines = [rng.choice(shapes) % (rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(40))]
            name = f"node-{n}.é" if n else "a"
            files[day, name] = lines
            put(folder, f"debug.log-{day}-{name}.gz", b"\n".join(lines) + (b"\n" if lines and rng.random() < 0.5 else b""))
    return files


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_check_split_round_trip(spark, tmp_path, seed):
    files = random_folder(tmp_path / "in", seed)
    report = merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), level=3, check=True, days_at_once=2, frame=300)
    assert report.ok and {(d, n): lines for d, n, _, lines in report.files} == {k: len(v) for k, v in files.items()}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["debug.log-20260515.zst", "debug.log-20260516.zst"]
    for day in ("20260515", "20260516"):
        own = sorted((f"debug.log-{d}-{n}.gz".encode(), n, lines) for (d, n), lines in files.items() if d == day)
        want = model.merge([(n, lines) for _, n, lines in own])
        assert unpacked(tmp_path / "out" / f"debug.log-{day}.zst") == b"".join(x + b"\n" for x in want)
        split(spark, str(tmp_path / "out" / f"debug.log-{day}.zst"), str(tmp_path / "back"))
    for (day, node), lines in files.items():
        path = tmp_path / "back" / f"debug.log-{day}-{node}.gz"
        assert gzip.decompress(path.read_bytes()) == b"".join(x + b"\n" for x in lines) if lines else not path.exists()


def test_discovery_and_pruning(spark, tmp_path):
    for name in ("debug.log-20260515-n1.gz", "debug.log-20260516-n-2.x.gz", "debug.log--n.gz", "debug.log-20260515-.gz", "debug.log-20260515-n1.zst", "other.gz"):
        put(tmp_path / "in", name, b"2026-05-15T00:00:00 x\n")
    found = discover(spark, str(tmp_path / "in"))
    assert [(f.date, f.node, f.reader) for f in found] == [("20260515", "n1", 0), ("20260516", "n-2.x", 0)]
    report = merge(spark, str(tmp_path / "in"), str(tmp_path / "none"), before="20260101")
    assert not report.days and not (tmp_path / "none").exists()
    seen = []
    merge_new_days(spark, str(tmp_path / "in"), str(tmp_path / "out"), today="20260516", level=1, after=[seen.append])
    assert seen == [["debug.log-20260515.zst"]]
    put(tmp_path / "in", "debug.log-20260515-a b.gz", b"x\n")
    with pytest.raises(ValueError, match="space"):
        discover(spark, str(tmp_path / "in"))
    with pytest.raises(FileNotFoundError):
        merge(spark, str(tmp_path / "out"), None)


def test_sources(spark, tmp_path):
    data = [b"one\r", b"", b"\0two", b"\xff", b"x" * 300_000, b"last"]
    text = b"\n".join(data)
    half = len(text) // 2
    (tmp_path / "multi.gz").write_bytes(gzip.compress(text[:half]) + gzip.compress(text[half:]))
    pack = zstandard.ZstdCompressor().compress
    (tmp_path / "multi.zst").write_bytes(pack(text[:half]) + pack(text[half:]))
    (tmp_path / "plain.log").write_bytes(text)
    (tmp_path / "misnamed.gz").write_bytes(text)
    (tmp_path / "bare").write_bytes(pack(text))
    (tmp_path / "empty.log").write_bytes(b"")
    rows = scan_any(spark, [str(p) for p in tmp_path.iterdir()]).collect()
    for name in ("multi.gz", "multi.zst", "plain.log", "misnamed.gz", "bare"):
        assert [bytes(r["line"]) for r in sorted(rows, key=lambda r: r["line_no"]) if r["file"] == name] == data, name
    (tmp_path / "cut.gz").write_bytes(gzip.compress(bytes(random.Random(1).randbytes(90_000)))[:40_000])
    with pytest.raises(Exception, match="cut.gz"):
        scan(spark, [str(tmp_path / "cut.gz")]).count()


def test_failed_merges_leave_nothing(spark, tmp_path):
    put(tmp_path / "in", "debug.log-20260515-n1.gz", b"2026-05-15T00:00:00 x\n")
    broken = gzip.compress(random.Random(1).randbytes(90_000))[:40_000]
    (tmp_path / "in" / "debug.log-20260515-n2.gz").write_bytes(broken)
    with pytest.raises(Exception, match="n2"):
        merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), level=1)
    assert [p.name for p in (tmp_path / "out").iterdir() if "zst" in p.name] == []
    (tmp_path / "debug.log-20260517.zst").write_bytes(zstandard.ZstdCompressor().compress(b"../evil x\nn1 y\n"))
    with pytest.raises(ValueError, match="evil"):
        split(spark, str(tmp_path / "debug.log-20260517.zst"), str(tmp_path / "split"))
    assert [p.name for p in (tmp_path / "split").iterdir() if p.name.endswith(".gz")] == []
    (tmp_path / "debug.log-20260518.zst").write_bytes(zstandard.ZstdCompressor().compress(b"n1 y\nnospace\n"))
    with pytest.raises(Exception, match="without a node: 2"):
        split(spark, str(tmp_path / "debug.log-20260518.zst"), str(tmp_path / "split"))


LINES = "".join(f"n{1 + i % 2} 2026-05-15T00:00:{i:02d}Z [net] ping peer={i}\n" for i in range(6)) + "n1 2026-05-15T00:01:00Z tip height=5\n"


def test_command_line(spark, tmp_path, capsys):
    log = tmp_path / "debug.log-20260515.zst"
    log.write_bytes(zstandard.ZstdCompressor().compress(LINES.encode()))
    state = str(tmp_path / "state")
    for times in (1, 2):
        args = ["templates", str(log), "--save-state", state, "--json"] + (["--load-state", state] if times == 2 else [])
        assert main(args, spark) == 0
        out = capsys.readouterr().out.splitlines()
        assert out[1] == f'{{"category":"net","count":{6 * times},"first_seen":"2026-05-15T00:00:00Z","template":"ping <PEER>"}}' and len(out) == 2
    assert main(["templates"], spark) == 0 and capsys.readouterr().out == ""
    assert main(["templates", str(log), "--per-node", str(tmp_path / "r"), "--load-state", state], spark) == 1
    assert "templates:" in capsys.readouterr().err
    assert main(["templates", str(log), "--per-node", str(tmp_path / "r")], spark) == 0
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if not p.name.startswith(".")) == ["n1.txt", "n2.txt"]
    assert (tmp_path / "r" / "n2.txt").read_text() == "=== net ===\n     3 ping <PEER>\n"
    assert main(["split", str(log), "-o", str(tmp_path / "s")], spark) == 0
    assert main(["merge", str(tmp_path / "s"), "-o", str(tmp_path / "m"), "-l", "3", "--check"], spark) == 0
    assert capsys.readouterr().out.splitlines()[-1] == "check: 2/2 files round-trip identical"
    (tmp_path / "debug.log-20260516.zst").write_bytes(zstandard.ZstdCompressor().compress(b" 2026-05-15T00:00:00Z lead\nnode-less\n"))
    assert [p.rsplit("/", 1)[1] for p in per_node(spark, str(tmp_path / "debug.log-20260516.zst"), str(tmp_path / "u"))] == ["_unknown.txt"]


def test_accumulation_is_exactly_once(spark, tmp_path):
    from braidlog.sources.catalogue import load

    logs, state = tmp_path / "logs", str(tmp_path / "state")
    put(logs, "debug.log-1.gz", LINES.encode())
    total = lambda: sum(int(r["count"]) for r in load(spark, state).clusters.collect())
    for expected in (7, 7):
        accumulate(spark, str(logs), state, str(tmp_path / "ck"))
        assert total() == expected
    put(logs, "debug.log-2.gz", LINES.encode())
    accumulate(spark, str(logs), state, str(tmp_path / "ck"))
    assert total() == 14
    batch = load(spark, state).batch
    assert not fold_batch(spark, state, [str(logs / "debug.log-2.gz")], batch, 4, 0.5) and total() == 14


def test_accumulation_over_folders_and_files_with_reports(spark, tmp_path):
    from braidlog.sources.catalogue import load

    state, taken = str(tmp_path / "state"), []
    total = lambda: sum(int(r["count"]) for r in load(spark, state).clusters.collect())
    for name in ("a", "b"):
        put(tmp_path / name, "debug.log-1.gz", LINES.encode())  # the same name in two folders is two logs
    put(tmp_path / "a", "other.log", b"not one\n")
    (tmp_path / "single").write_bytes(LINES.encode())
    inputs = [str(tmp_path / x) for x in ("a", "b", "single", "none")]
    run = lambda inputs, **o: accumulate(spark, inputs, state, str(tmp_path / "ck"), on_batch=lambda _, paths: taken.extend(paths), **o)
    run(inputs, files_at_once=2, report=str(tmp_path / "report.json"), json_report=True)
    assert total() == 21 and len(taken) == len(set(taken)) == 3
    assert (tmp_path / "report.json").read_text().splitlines()[1].startswith('{"category":"net","count":18,')
    put(tmp_path / "none", "debug.log-2.gz", LINES.encode())
    run(inputs[2:], node_folder=str(tmp_path / "nodes"))
    run(inputs)
    assert total() == 28 and len(taken) == len(set(taken)) == 4
    assert (tmp_path / "nodes" / "n2.txt").read_text() == "=== net ===\n     3 ping <PEER>\n"


def test_days_are_merged_once(spark, tmp_path):
    for day in ("20260515", "20260516", "20260517"):
        put(tmp_path / "in", f"debug.log-{day}-n1.gz", f"2026-05-15T00:00:00Z {day}\n".encode())
    run = lambda: merge_new_days(spark, str(tmp_path / "in"), str(tmp_path / "out"), today="20260517", level=1, after=[seen.append]).days
    seen = []
    assert run() == ["debug.log-20260515.zst", "debug.log-20260516.zst"]
    assert run() == []
    put(tmp_path / "in", "debug.log-20260515-n1.gz", b"2026-05-15T00:00:00Z changed and longer\n")
    assert run() == ["debug.log-20260515.zst"] and b"changed" in unpacked(tmp_path / "out" / "debug.log-20260515.zst")
    put(tmp_path / "in", "debug.log-20260516-n2.gz", b"2026-05-15T00:00:00Z new\n")
    assert run() == ["debug.log-20260516.zst"]
    (tmp_path / "out" / "debug.log-20260516.zst").unlink()
    assert run() == ["debug.log-20260516.zst"] and run() == []
    assert len(seen) == 4


@pytest.mark.parametrize("jobs", [1, 3])
def test_jobs_do_not_change_contents(spark, tmp_path, jobs):
    for n in range(2):
        put(tmp_path / "in", f"debug.log-20260515-n{n}.gz", "".join(f"2026-05-15T00:{i // 60:02d}:{i % 60:02d} line {i} of {n}\n" for i in range(n, 400, 2)).encode())
    merge(spark, str(tmp_path / "in"), str(tmp_path / f"out{jobs}"), level=1, jobs=jobs, frame=900)
    lines = unpacked(tmp_path / f"out{jobs}" / "debug.log-20260515.zst").splitlines()
    assert lines == [f"n{i % 2} 2026-05-15T00:{i // 60:02d}:{i % 60:02d} line {i} of {i % 2}".encode() for i in range(400)]
    assert sorted(p.name for p in (tmp_path / f"out{jobs}").iterdir() if not p.name.startswith(".")) == ["debug.log-20260515.zst"]


def test_replace_takes_the_place_of_a_file(spark, tmp_path):
    from braidlog.sources.storage import Storage

    (tmp_path / "a").write_text("new")
    (tmp_path / "b").write_text("old")
    at = spark._jvm.org.apache.hadoop.fs.Path
    Storage(spark).replace(at(f"file://{tmp_path}/a"), at(f"file://{tmp_path}/b"))
    assert (tmp_path / "b").read_text() == "new" and not (tmp_path / "a").exists()
