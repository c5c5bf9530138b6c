import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests import golden
from timberline.functions.mask import DEFAULT, DEFAULT_SLOTS, LINEAR, BadBundle, Bundle, Slot, mask, matches, pieces, register, slot_uses, spans

CASES = [
    ("at 2026-09-19T10:00:00Z done", "at <VAR:TS> done"),
    ("Jun 14 15:16:01 combo up", "<VAR:TS> combo up"),
    ("id 123e4567-e89b-12d3-a456-426614174000", "id <VAR:UUID>"),
    ("from 00:1b:44:11:3a:b7", "from <VAR:MAC>"),
    ("addr fe80::1%eth0 up", "addr <VAR:IP6> up"),
    ("peer 10.0.0.9 port 22", "peer <VAR:IP4> port <VAR:NUM>"),
    ("get http://a.b/c?d=1 now", "get <VAR:URL> now"),
    ("mail x.y@example.com sent", "mail <VAR:EMAIL> sent"),
    ("rhost=n219076184117.netvigator.com user", "rhost=<VAR:HOST> user"),
    ("disk /dev/sda1 and nvme0n1p2", "disk <VAR:DEV> and <VAR:DEV>"),
    ("open /var/log/messages", "open <VAR:PATH>"),
    ("lone /tmp stays", "lone /tmp stays"),
    ("ptr 0xdeadbeef", "ptr <VAR:HEX>"),
    ("took 15ms for 10 kB", "took <VAR:DUR> for <VAR:SIZE>"),
    ("sshd[1234]: code 7 EXT4-fs", "sshd<VAR:PID>: code <VAR:NUM> EXT4-fs"),
    ("kept <VAR:NUM> and 5", "kept <VAR:NUM> and <VAR:NUM>"),
    ("", ""),
    ("line\n\x01 two", "line\n\x01 two"),
]


def test_slots(spark):
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(CASES)], "k int, raw string, want string").select("*", mask(F.col("raw")).alias("got"))
    for row in df.collect():
        assert row.got == row.want, row.raw
    assert df.filter(mask(F.col("got")) != F.col("got")).isEmpty()


@pytest.mark.skipif(not golden.masked(), reason="no golden files here")
def test_golden_pairs(spark):
    pairs = golden.masked()
    assert len(pairs) > 5000
    df = spark.createDataFrame(pairs, "raw string, want string")
    assert df.filter(mask(F.col("raw")) != F.col("want")).count() == 0


def test_matches_spans_and_pieces(spark):
    df = spark.createDataFrame([("é from 10.0.0.9 took 5ms <VAR:NUM>",), (None,)], "raw string")
    row = df.select(matches(F.col("raw")).alias("m"), spans(F.col("raw")).alias("s")).first()
    assert [tuple(x) for x in row.m] == [("IP4", "10.0.0.9"), ("DUR", "5ms")]
    assert [(x.name, x.start, x.end) for x in row.s] == [("IP4", 8, 16), ("DUR", 22, 25)]
    t = spark.createDataFrame([("a <VAR:NUM> b <VAR:IP4> <VAR:NUM>",)], "t string")
    assert [tuple(u) for u in t.select(slot_uses(F.col("t")).alias("u")).first().u] == [("NUM", 2), ("IP4", 1)]
    assert "".join(p.text if p.slot is None else f"<VAR:{p.slot}>" for p in t.select(pieces(F.col("t")).alias("p")).first().p) == "a <VAR:NUM> b <VAR:IP4> <VAR:NUM>"


def test_sql_function(spark):
    register(spark)
    assert spark.sql("SELECT mask_line('sshd[5]: from 10.0.0.1') AS m, template_id('x') AS i").first().m == "sshd<VAR:PID>: from <VAR:IP4>"


@pytest.mark.parametrize(
    "kind, text",
    [
        ("toml", "version = "),
        ("version", 'version = 2\n[[slot]]\nname="A"\npattern="a"'),
        ("empty", "version = 1"),
        ("name", 'version = 1\n[[slot]]\nname="a"\npattern="a"'),
        ("reserved", 'version = 1\n[[slot]]\nname="MASKED"\npattern="a"'),
        ("duplicate", 'version = 1\n[[slot]]\nname="A"\npattern="a"\n[[slot]]\nname="A"\npattern="b"'),
        ("regex", 'version = 1\n[[slot]]\nname="A"\npattern="("'),
        ("group", 'version = 1\n[[slot]]\nname="A"\npattern="(a)"'),
        ("size", 'version = 1\n[[slot]]\nname="A"\npattern="' + "a" * (1 << 20) + 'b"'),
    ],
)
def test_bad_bundles(kind, text):
    with pytest.raises(BadBundle) as x:
        Bundle.parse(text)
    assert x.value.kind == kind


def test_bundle_round_trip():
    again = Bundle.parse(DEFAULT.to_toml())
    assert again.slots == DEFAULT.slots and again.hash == DEFAULT.hash
    assert Bundle.parse(Bundle((Slot("Q", "it's \"x\""),)).to_toml()).slots[0].pattern == "it's \"x\""


# Characters that make long runs, many boundaries and near misses of the slots whose patterns are run in another form.
RUNS = {
    "HOST": ["a", "b-", "-", ".", "com", "de", ".com", "..", "x1", "é", "_", " ", "1", "ca", "-com."],
    "EMAIL": ["a", "@", "b.", "-", "com", "%", "+", "_", " ", ".x", "é", "a@b.co"],
    "URL": ["a", "http", "://", "+", ".", "-", "1", " ", "x", "é", "A", "::", "/"],
    "PATH": ["/", "a", ".", "_", "-", " ", "é", "b1", "//"],
}


@pytest.mark.parametrize("flag", ["(?U)", ""])
def test_patterns_run_in_another_form_find_the_same(spark, flag):
    rng = random.Random(1)
    slots = dict(DEFAULT_SLOTS)
    rows = []
    for name, parts in RUNS.items():
        dense = [p for p in parts if p != " "]
        rows += [(name, "".join(rng.choice(rng.choice([parts, dense])) for _ in range(rng.choice([4, 20, 60, 220])))) for _ in range(1500)]
    every = sum(RUNS.values(), ["2024-01-01T00:00:00", "::1", "1.2.3.4", "0xff", "[12]", "5 ms", "<VAR:X>", "deadbeef01", "/dev/sda"])
    rows += [("", "".join(rng.choice(every) for _ in range(rng.choice([5, 20, 90])))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "slot string, line string").cache()
    for name in RUNS:
        own = df.filter(F.col("slot") == name)
        assert own.filter(F.regexp_replace("line", flag + slots[name], "#") != F.regexp_replace("line", flag + LINEAR[slots[name]], "#")).count() == 0
        assert own.filter(F.col("line").rlike(slots[name])).count() > 300
    written = DEFAULT.start + "(?:" + "|".join(["(<VAR:[A-Z][A-Z0-9_]*>)", *(f"({s.pattern})" for s in DEFAULT.slots)]) + ")"
    plain = F.when(F.lit(True), F.regexp_replace("line", flag + written, DEFAULT.separated))
    run = F.when(F.contains("line", F.lit("@")) | F.contains("line", F.lit("://")), F.regexp_replace("line", flag + DEFAULT.grouped, DEFAULT.separated)).otherwise(F.regexp_replace("line", flag + DEFAULT.lean, DEFAULT.separated))
    assert df.filter(plain != run).count() == 0


LONG = {
    "ab." * 21_000 + "com": "<VAR:HOST>", "/ab" * 20_000: "<VAR:PATH>", "http://" + "a/" * 32_000: "<VAR:URL>", "a" * 64_000 + "@b.co": "<VAR:EMAIL>", "1" * 64_000: "<VAR:HEX>",
    "ab1" * 21_000: "<VAR:HEX>", "/dev/" + "a" * 64_000: "<VAR:DEV>", "a-" * 32_000: None, "a." * 32_000: None, "a-b." * 16_000 + "@x": None, "a@" * 32_000: None, "a+" * 32_000: None,
    "1 " * 32_000: "<VAR:NUM> " * 32_000, "12:" * 21_000: "", "1." * 32_000: "", "1:" * 32_000: "", "[1]" * 20_000: "<VAR:PID>" * 20_000, "fe80::" * 10_000: "", "5ms" * 20_000: None, "a.com." * 10_000: "<VAR:HOST>.",
}


def test_lines_of_64_kib_in_a_new_process():
    """A cold JVM has the least stack to spare; time is in proportion to the line."""
    code = f"""
import sys, time
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from tests.test_mask import LONG
from timberline.functions.mask import mask
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for line, want in LONG.items():
    began = time.time()
    got = spark.createDataFrame([(line,)], "raw string").select(mask(F.col("raw")).alias("m")).first().m
    assert want == "" or got == (line if want is None else want), line[:20]
    assert time.time() - began < 20, line[:20]
big = "a-b." * 250_000
began = time.time()
assert spark.createDataFrame([(big,)], "raw string").select(mask(F.col("raw")).alias("m")).first().m == big and time.time() - began < 60
print("all masked")
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert "all masked" in run.stdout, run.stderr[-2000:]


def test_spans_cut_what_masking_replaces(spark):
    """Byte offsets on lines of many scripts, with separators, and of thousands of matches."""
    rng = random.Random(3)
    parts = ["10.0.0.9", " ", "é日", "5ms", "🎉", "<VAR:NUM>", "\x01", "\x04", "/a/b", "x", "٣", "http://é.com/日", "[12]", "\x04\x05"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["7 é " * 1500, "", "\x01"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)] + [(-1, None)], "k int, raw string")
    for r in df.select("k", "raw", spans(F.col("raw")).alias("s"), mask(F.col("raw")).alias("m")).collect():
        if r.raw is None:
            assert r.s is None
            continue
        raw, out, at = r.raw.encode(), b"", 0
        for x in r.s:
            assert raw[x.start : x.end].decode() == x.value and x.start >= at
            out += raw[at : x.start] + f"<VAR:{x.name}>".encode()
            at = x.end
        assert (out + raw[at:]).decode() == r.m
