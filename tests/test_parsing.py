import random
import re

import model
import pytest
from pyspark.sql import functions as F

from braidlog.functions import lines as L
from braidlog.functions.text import catalogue_string, report_string, state_float
from braidlog.functions.tokens import rendered, with_slots, with_tokens

HASH = "0a" * 32
GOLDEN = {
    "received: inv (37 bytes) peer=12": "received : inv ( <BYTES> ) <PEER>",
    f"got inv: wtx {HASH}  have peer=3": "got inv : wtx <HASH> have <PEER>",
    f"new best={HASH} height=9 progress=0.99": "new best = <HASH> <HEIGHT> progress = <FLOAT>",
    "- Connect 2 transactions: 1.5ms (0.75ms/tx)": "- Connect <INT> transactions : <DUR> ( <DUR> / tx )",
    f"1 Selected {'a' * 52}.b32.i2p:0 from tried": "<INT> Selected <I2P:PORT> from tried",
    "us=[2001:db8::1]:8333, x": "us = <IPv6:PORT> , x",
    "[2001:db8::1]:99999": "[ <IPv6> ] :99999",
    "abc[::1]:8333": "abc [ <IPv6> ] :8333",
    "(peer=9) peer=9)": "( peer = <INT> ) peer=9)",
    "1:2 12:30:45 :1::2 dead::beef 1e5 1234567d 5 bytes bytes": "1:2 12:30:45 <IPv6> <IPv6> 1e5 <DUR> <BYTES> bytes",
    f"{'AB' * 32} 0x1f 12345678 1234567a 5μs 300.1.1.1 001.2.3.4:070000": f"{'AB' * 32} <HEX> <INT> <HEX> <DUR> 300.1.1.1 001.2.3.4:070000",
    "": "",
}


def random_contents(n, seed):
    rng = random.Random(seed)
    bits = ["peer=", "height=", "bytes", "[", "]", "[::1]:8333", "[::1]:70000", "::", ":", ",", "=", "(", ")", "'", "/", "1", "42", "-7", "0.5", "e+3", "ms", "μs", "10.0.0.1", ":8333", "fe80", "dead", "beef",
            "a" * 16, ".onion", "b" * 52, ".b32.i2p", "bc1", "qpzry9x8", "0x", "f" * 8, "c" * 64, " ", "  ", "\t", "\x0b", "\x85", "é", "word", HASH, "2" * 30, "Z" * 26]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(n)] + list(GOLDEN)


def test_tokens_equal_the_model(spark):
    contents = random_contents(3000, 1)
    df = with_slots(with_tokens(spark.createDataFrame([(c,) for c in contents], "content string")))
    for r in df.withColumn("shown", rendered(F.col("slots"))).collect():
        want = model.tokens(r["content"])
        assert [(t["kind"], t["text"]) for t in r["tokens"]] == want, r["content"]
        assert tuple(r["slots"]) == model.slots(r["content"]) and r["shown"] == model.rendered(model.slots(r["content"]))
        assert all(t["text"] for t in r["tokens"])
        if r["content"] in GOLDEN:
            assert r["shown"] == GOLDEN[r["content"]]


def test_users_can_add_recognizers(spark):
    df = with_tokens(spark.createDataFrame([("id #12 x",)], "content string"), recognizers=[("TAG", lambda a: a.startswith("#"))])
    assert [t["kind"] for t in df.first()["tokens"]] == [None, "TAG", None]


CASES = {
    "2026-05-15T00:00:01Z [net] hello\r\n": ("2026-05-15T00:00:01Z", None, "net", "hello"),
    "2026-05-15T00:00:01Z [msghand] [net] hello": ("2026-05-15T00:00:01Z", "msghand", "net", "hello"),
    "2026-05-15T00:00:01Z [a] [b] [c] x": ("2026-05-15T00:00:01Z", "a", "b", "[c] x"),
    "2026-05-15T00:00:01Z [] x": ("2026-05-15T00:00:01Z", None, "", "x"),
    "2026-05-15T00:00:01Z [::1]:80 [net] x": ("2026-05-15T00:00:01Z", None, None, "[::1]:80 [net] x"),
    "2026-05-15T00:00:01Z [a b] x": ("2026-05-15T00:00:01Z", None, None, "[a b] x"),
    "2026-05-15T00:00:01Z [net": ("2026-05-15T00:00:01Z", None, None, "[net"),
    "2026-": ("2026-", None, None, ""),
    "\tat frame 2026-05-15T00:00:00": (None, None, None, "\tat frame 2026-05-15T00:00:00"),
    "2026-05-15T00:00:01Z\x0b\u3000 [n] \u00a0 x  ": ("2026-05-15T00:00:01Z\x0b\u3000", None, "n", "x  "),
    "": (None, None, None, ""),
}


def test_line_shapes(spark):
    df = L.with_parsed(spark.createDataFrame([(c,) for c in CASES], "line string"), "line")
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == CASES


def test_timestamp_keys_equal_the_model(spark):
    rng = random.Random(2)
    stems = ["2026-05-15T00:00:31", "0000-00-00T00:00:00", "9999-99-99T99:99:99", "2026-02-29T12:00:60", "2026-05-15 00:00:31", "2026-05-15T00:00:3"]
    lines = [s + t for s in stems for t in ("", "Z", ".5", ".5Z", ".", ".1234567890", ".123456789", "xyz", " rest", ".5.5")] + ["x" * rng.randrange(30) for _ in range(20)]
    out = spark.createDataFrame([(x,) for x in lines], "line string").select("line", L.timestamp_key(F.col("line")).alias("k"), L.looks_stamped(F.col("line")).alias("s"))
    for r in out.collect():
        assert r["k"] == model.key(r["line"].encode()) and r["s"] == bool(re.match("[0-9]{4}-", r["line"]))


def test_invalid_bytes_are_replaced(spark):
    raw = [b"ok \xff\xfe\x80 end", b"\xe2\x82", b"\xf0\x9f\x98", "é".encode()]
    out = spark.createDataFrame([(bytearray(b),) for b in raw], "line binary").select(L.decoded(F.col("line")).alias("t")).collect()
    assert [r["t"] for r in out] == [b.decode(errors="replace") for b in raw]


def test_json_text(spark):
    text = 'a"b\\c\nd\re\tf\bg\fh\x01\x1f é'
    got = spark.createDataFrame([(text,), (None,)], "t string").select(report_string(F.col("t")).alias("j"), catalogue_string(F.col("t")).alias("c")).collect()
    assert got[0]["j"] == '"a\\"b\\\\c\\nd\\re\\tf\\u0008g\\u000ch\\u0001\\u001f é"' and got[1]["j"] == "null"
    assert got[1]["c"] == "null" and got[0]["c"] == '"a\\"b\\\\c\\nd\\re\\tf\\bg\\fh\\u0001\\u001f é"'
    assert [state_float(x) for x in (0.5, 1.0, 1e-7, 1.5e-9, 1e22, 123456789.25, 2.5e20)] == ["0.5", "1.0", "0.0000001", "0.0000000015", "10000000000000000000000.0", "123456789.25", "250000000000000000000.0"]
    with pytest.raises(ValueError):
        state_float(float("inf"))


LONG = "".join(map(chr, range(32))) + "no control in a long text " * 60_000


def _linear(spark, string, short):
    import time

    began = time.time()
    got = spark.createDataFrame([(LONG,)], "t string").select(string(F.col("t")).alias("j")).first()["j"]
    assert got == '"' + "".join(short.get(c) or (f"\\u{ord(c):04x}" if ord(c) < 32 else c) for c in LONG) + '"'
    assert time.time() - began < 30


def test_report_strings_of_long_texts_take_linear_time(spark):
    _linear(spark, report_string, {"\n": "\\n", "\r": "\\r", "\t": "\\t"})


def test_catalogue_strings_of_long_texts_take_linear_time(spark):
    _linear(spark, catalogue_string, {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"})
