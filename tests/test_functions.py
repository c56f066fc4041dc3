import hashlib
import random

import pytest
from pyspark.sql import functions as F

from faultlens.functions import hardware, logs, stack, symbols, text


def one(spark, column, **values):
    """The value of a column expression over one row."""
    kinds = {str: "string", int: "int", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_trailers(spark):
    body = "x\n\nFixes: 1A2b3c4 (\"t\")\nfixes: deadbeef00\nNot Fixes: aaaaaaa\nReported-by:  A B <a@b>\nCloses: https://x/1\nLink: http://y/2 tail"
    assert one(spark, text.fixes(F.col("b")), b=body) == ["1a2b3c4", "deadbeef00"]
    assert one(spark, text.reported_by(F.col("b")), b=body) == ["A B <a@b>"]
    assert one(spark, text.trailer_urls(F.col("b"), "Closes"), b=body) == ["https://x/1"]
    assert one(spark, text.fixes(F.col("b")), b=None) == []


@pytest.mark.parametrize(
    "body,kind,tag,best",
    [
        ("mainline inclusion\nfrom v6\ncommit aaaaaaa1\n\n---\n", "backport", "mainline", "aaaaaaa1"),
        ("stable inclusion\ncommit bbbbbbb1\n---\n[ Upstream commit ccccccc1 ]", "backport", "stable", "ccccccc1"),
        ("stable inclusion\ncommit bbbbbbb1\n", "backport", "stable", "bbbbbbb1"),
        ("vendor inclusion\ncommit ddddddd1\n", "native", "vendor", None),
        ("---\nmainline inclusion\ncommit aaaaaaa1\n", "no_header", None, None),
        ("Merge pull request !5\n\nmainline inclusion\ncommit aaaaaaa1\n", "merge", None, None),
        ("", "no_header", None, None),
    ],
)
def test_inclusion(spark, body, kind, tag, best):
    got = one(spark, text.inclusion(F.col("b")), b=body)
    assert (got["kind"], got["tag"], got["best"]) == (kind, tag, best)


def test_subsystem_is_the_common_prefix(spark):
    rng = random.Random(3)
    cases = [[], ["Makefile"], ["net/ipv4/a.c", "net/ipv6/b.c"], ["net/a.c"], ["a/b/c/d/e.c"]]
    cases += [["/".join(rng.choice(["a", "ab", "b"]) for _ in range(rng.randint(1, 5))) + "/x.c" for _ in range(rng.randint(1, 4))] for _ in range(60)]

    def plain(files):
        dirs = [f.rsplit("/", 1)[0] + "/" for f in files if "/" in f]
        if not dirs:
            return None
        prefix = dirs[0]
        while not all(x.startswith(prefix) for x in dirs):
            prefix = prefix[:-1]
        return "/".join(prefix.rstrip("/").split("/")[:3]) or None

    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, f array<string>")
    got = {r["i"]: r["s"] for r in df.select("i", text.subsystem(F.col("f")).alias("s")).collect()}
    assert got == {i: plain(c) for i, c in enumerate(cases)}


def test_ids_and_keywords(spark):
    assert one(spark, text.clean_message_id(F.col("b")), b="<a.b@c.d>),") == "a.b@c.d"
    assert one(spark, text.clean_message_id(F.col("b")), b="no at") is None
    assert one(spark, text.clean_keywords(F.col("b")), b="\"One\" two 'one' x TWO three") == ["One", "two", "three"]
    assert one(spark, text.keywords(F.col("b")), b="How does the OOM killer work for my app") == ["oom", "killer", "work", "app"]
    assert one(spark, text.merge_hashes(F.col("a"), F.col("b")), a=["aaaaaaaaaaaa1"], b=["aaaaaaaaaaaa2", "bbbbbbbbbbbb", "bbbbbbbbbbbb9"]) == ["aaaaaaaaaaaa1", "bbbbbbbbbbbb"]
    assert one(spark, text.version_label(F.col("b")), b="on v5.10 box") == "LTS-5.10"
    assert one(spark, text.mapped(F.col("b"), text.STATUS), b="Assigned") == "in_progress"
    assert one(spark, text.timestamp_or_null(F.col("b")), b=" ") is None
    assert one(spark, text.fix_hashes(F.col("u"), F.col("b")), u=["https://g/c/abcdef1234", "https://x"], b="fixed in 1234567 by commit abcdef1234") == ["1234567", "abcdef1234"]


def test_symbols(spark):
    cases = {
        "static int tcp_send_mss(struct sock *sk)": ("tcp_send_mss", "function"), "#define FOO(x) 1": ("FOO", "macro"), "struct nla_policy ifla_policy[X] = {": ("ifla_policy", "struct"),
        "if (x == y)": (None, "unknown"), "obj = 3": (None, "unknown"), "return foo_bar == 3": ("foo_bar", "unknown"), "": (None, "unknown"),
    }
    for context, expected in cases.items():
        got = one(spark, symbols.symbol(F.col("c")), c=context)
        assert (got["symbol"], got["kind"]) == expected, context
    diff = "diff --git a/net/x.c b/net/x.c\n@@ -1,2 +3,4 @@ int do_one(void)\n+a\n@@ -9 +9 @@ int do_one(void)\ndiff --git a/m.h b/m.h\n@@ -1 +1 @@ #define TWO 2\n"
    df = spark.createDataFrame([("a", diff), ("b", "no diff"), ("c", None)], "hash string, diff string")
    got = sorted(tuple(r) for r in symbols.diff_symbols(df, "hash", "diff").collect())
    assert got == [("a", "m.h", "TWO", "macro"), ("a", "net/x.c", "do_one", "function"), ("b", "__NONE__", "__NONE__", "sentinel"), ("c", "__NONE__", "__NONE__", "sentinel")]


TRACE = "[   12.345678] Call Trace:\n[   12.345679]  <TASK>\n[   12.345680]  devinet_ioctl+0x12/0x90\n[   12.345681]  inet_ioctl+0x1/0x2 [mod]\n[   12.345682]  mutex_lock+0x3/0x4\n[   12.345683]  sock_do_ioctl+0x9/0x9 net/socket.c:100\n"


def test_stack_signature(spark):
    sign = lambda t: one(spark, stack.signature(F.col("t")), t=t)
    expected = hashlib.sha256(b"devinet_ioctl|inet_ioctl|sock_do_ioctl").hexdigest()[:32]
    assert sign(TRACE) == expected == sign(TRACE.replace("0x12", "0xffff").replace("12.3456", "99.0"))
    assert sign(TRACE.replace("inet_ioctl+", "other_fn+", 2)) != expected
    assert sign("too little here") == "" and sign("") == ""


def plain_trace(text):
    lines = text.splitlines()
    frames = [i for i, line in enumerate(lines) if "+0x" in line]
    best, k = None, 0
    while k < len(frames):
        own = [f for j, f in enumerate(frames[k:]) if f - frames[k] - j <= 3]
        closed = len(lines) - frames[k] - len(frames[k:]) > 3
        end = frames[k] + len(own) - 1 if closed else len(lines)
        if best is None or len(own) > best[0]:
            best = (len(own), frames[k], end)
        k += len(own)
    return "\n".join(lines[best[1] : best[2]]) if best and best[0] >= 3 else None


def test_trace_in_free_text(spark):
    texts = ["Hello\nsome text\n" + TRACE + "bye\n\n\n\n\nmore", "foo+0x1/0x2\nbar+0x1/0x2", "", "\n", "aa+0x1\r\nbb+0x2\x0bcc+0x3"]
    rng = random.Random(3)
    texts += ["\n".join(rng.choice(["word", "", f"fn_{i}+0x{i}/0x9", f"fn_{i}+0x{i}/0x9"]) for i in range(rng.randint(1, 40))) for _ in range(300)]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").select("i", stack.extract_trace(F.col("t")).alias("b")).collect()
    assert {r["i"]: r["b"] for r in rows} == {-1: None} | {i: plain_trace(t) for i, t in enumerate(texts)}


def test_log_events():
    kinds = lambda log: [(e["kind"], e["metadata"].get("pid")) for e in logs.events(log)]
    assert kinds("BUG: KASAN: use-after-free in foo\nCall Trace:\n") == [("bug", None)]
    assert kinds("Out of memory: Kill process 12 (java) score 9 or sacrifice child") == [("oom", "12")]
    assert kinds("[ 1.0] oom-kill:constraint=CONSTRAINT_NONE,nodemask=x,task=mysqld,pid=77,uid=0") == [("oom", "77")]
    assert kinds("Kernel panic - not syncing: VFS\n\nwatchdog: BUG: soft lockup - CPU#3 stuck for 22s") == [("panic", None), ("softlockup", None)]
    assert kinds("BUG: unable to handle\nOops: 0002 [#1]") == [("oops", None)]
    assert kinds("") == kinds(None) == kinds("all is well") == []
    log = "WARNING: CPU: 1\nCall Trace:\n [<ffffffff81>] foo+0x1/0x2\n"
    assert logs.events("WARNING: x\nCall Trace:\n  <ffffffff81> foo+0x1/0x2\n", strict=True)[0]["call_trace"] == ["foo+0x1/0x2"] == logs.events(log)[0]["call_trace"]
    assert logs.call_trace("x\nCall Trace:\n[ 1.0]  a_b+0x1/0x2\n\nc_d+0x1/0x2") == ["a_b+0x1/0x2"]


def test_triage(spark):
    assert one(spark, logs.fault_kind(F.col("k")), k=["warn", "oom", "bug"]) == "oom" and one(spark, logs.fault_kind(F.col("k")), k=["?"]) == "generic"
    assert one(spark, logs.input_type(F.col("k")), k="BUG: x") == "dmesg" and one(spark, logs.input_type(F.col("k")), k="why?") == "question"
    got = one(spark, logs.release(F.col("k")), k="Linux 5.10.0-153.oe2203sp3.x86_64 #1")
    assert (got["full"], got["base"], got["tag"]) == ("5.10.0-153.oe2203sp3.x86_64", "5.10", "LTS-5.10")
    assert one(spark, logs.labels(F.col("k"), logs.STORAGE), k="nvme0: I/O 5 timeout, resetting controller\nBuffer I/O error on dev sda") == ["nvme_timeout", "buffer_io_error"]
    tags = one(spark, logs.domain_tags(F.col("a"), F.col("b")), a="tcp: fix deadlock", b="rcu_sched self-detected stall")
    assert {(t["domain"], t["confidence"]) for t in tags} == {("deadlock", 0.8), ("network", 0.8), ("rcu_stall", 0.6)}


def test_hardware(spark):
    flags = lambda v: [f["letter"] for f in one(spark, hardware.taint(F.col("v")), v=v)]
    assert flags("4112") == ["M", "O"] and flags("G B Z") == ["G", "B", "Z"] and flags("0") == []
    assert one(spark, hardware.taint_letters(F.col("v")), v="CPU: 1 Tainted: G   W  5.10") == ["G", "W"]
    m = one(spark, hardware.mci_status(F.col("v")), v="0xbe00000000800400")
    assert m["valid"] and m["uncorrected"] and m["fatal"] and m["severity"] == "fatal" and m["error_code"] == 0x400
    assert not one(spark, hardware.mci_status(F.col("v")), v="7f")["valid"]
    log = "Hardware event. This is not a software error.\nMCE 0\nCPU 3 BANK 7\nADDR 1f00\nSTATUS 8c00004000010090 MCGSTATUS 0\n\nnoise"
    assert [(e["cpu"], e["bank"], e["status"], e["addr"]) for e in one(spark, hardware.mcelog(F.col("v")), v=log)] == [(3, 7, "8c00004000010090", "1f00")]
    e = one(spark, hardware.event_log(F.col("v")), v="1 | 01/02/2024 | 10:00:00 | Memory #0x01 | Uncorrectable ECC | Asserted")
    assert (e["severity"], e["sensor"]) == ("Critical", "Memory #0x01")
    inv = one(spark, hardware.inventory(F.col("v")), v="Memory Device\n\tSize: 16 GB\n\tType: DDR4\n\nMemory Device\n\tSize: No Module Installed\n")
    assert inv == [{"_title": "Memory Device", "Size": "16 GB", "Type": "DDR4"}]
    f = one(spark, hardware.decoded_frame(F.col("v")), v=" foo_bar+0x12/0x34 (kernel/x.c:99)")
    assert (f["function"], f["offset"], f["file"], f["line"]) == ("foo_bar", "0x12", "kernel/x.c", 99)
    assert one(spark, hardware.device_major(F.col("v"), F.lit("block")), v=253)["dynamic"]


def test_stemmer(spark):
    from faultlens.functions.stem import stem, stemmed

    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "operator": "oper", "electrical": "electr", "goodness": "good", "adoption": "adopt", "rate": "rate", "cease": "ceas", "roll": "roll", "generalizations": "gener"}
    assert {w: stem(w) for w in pairs} == pairs
    assert one(spark, stemmed("t"), t=["locked", "locking", "lück", "x1"]) == ["lock", "lock", "lück", "x1"]
