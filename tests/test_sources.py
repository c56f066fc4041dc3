from pyspark.sql import functions as F

from faultlens.operators import upsert
from faultlens.sources import readers
from faultlens.streaming import events


def test_commit_log(spark, tmp_path):
    one = "\0".join(["a" * 40, "A U", "a@u", "2024-01-02T03:04:05", "net: x", "body text\nmore\n\nnet/x.c\nMakefile\n"])
    two = "\0".join(["junk\n" + "b" * 40, "B", "b@u", "not a date", "y", "no files here at all"])
    (tmp_path / "log").write_text("\x01".join([one, two, ""]))
    got = {r["hash"][0]: r for r in readers.commit_log(spark, str(tmp_path / "log")).collect()}
    assert got["a"]["files"] == ["net/x.c", "Makefile"] and got["a"]["body"] == "body text\nmore" and got["a"]["date"].hour == 3
    assert got["b"]["date"] is None and got["b"]["files"] == [] and got["b"]["body"] == "no files here at all"


def test_mailbox(spark, tmp_path):
    box = "From x\nMessage-ID: <a@b>\nFrom: P <p@q>\nDate: Tue, 02 Jan 2024 03:04:05 +0100\nSubject: [PATCH] z\nReferences: <r1@x> <r2@x>\nIn-Reply-To: <r2@x>\n\nhello\nFrom y\nSubject: no id\n\ntext\n"
    (tmp_path / "m.mbox").write_text(box)
    (r,) = readers.mailbox(spark, str(tmp_path / "m.mbox")).collect()
    assert (r["message_id"], r["in_reply_to"], r["refs"], r["body"].strip(), r["date"].hour) == ("a@b", "r2@x", ["r1@x", "r2@x"], "hello", 2)


def test_mailboxes_in_parts(spark, tmp_path):
    import random

    from faultlens.sources import splittable

    rng, raw = random.Random(3), {}
    for name in ("a", "b", "c"):
        mails = []
        for i in range(60):
            body = ("\n" + "".join(rng.choice(["word ", "\n", "From here\n", ">From\n", "caf\u00e9 ", "\nFro"]) for _ in range(rng.randrange(80)))).replace("\nFrom ", "\n>From ")[1:]
            mails.append(f"From x {i}\nMessage-ID: <{name}{i}@h>\nContent-Type: text/plain; charset=iso-8859-1\nSubject: s\n\n{body}\n".encode("latin-1"))
        raw[name] = mails
        (tmp_path / f"{name}.mbox").write_bytes(b"".join(mails))
    (tmp_path / "d.mbox").write_bytes(b"")
    (tmp_path / "e.mbox").write_bytes(b"no start line\n\nFrom y\nMessage-ID: <e@h>\n\nlast, without a line end")
    splittable.register(spark)
    want = sorted(m for mails in raw.values() for m in mails) + [b"From y\nMessage-ID: <e@h>\n\nlast, without a line end", b"no start line\n\n"]
    for size in (1, 7, 1000, 1024, 1 << 25):
        reader = splittable.MailboxReader(str(tmp_path), size)
        got = [row for part in reader.partitions() for row in reader.read(part)]
        assert sorted(r[2] for r in got) == want and len({r[:2] for r in got}) == len(got)
        assert all((tmp_path / f).read_bytes()[p : p + len(m)] == m for f, p, m in got)
    whole, parts = (sorted(tuple(r) for r in readers.mailbox(spark, str(tmp_path), n).select("message_id", "body").collect()) for n in (1 << 25, 1000))
    assert whole == parts and len(whole) == 181 and any("caf\u00e9" in b for _, b in whole)


def test_dated_logs(spark, tmp_path):
    from faultlens.sources import splittable

    for day in range(1, 6):
        folder = tmp_path / f"date=2024-01-0{day}"
        folder.mkdir()
        for part in range(2):
            lines = [f'{{"ts":"2024-01-0{day}T{h:02d}","level":"{"ERROR" if h % 3 == 0 else "INFO"}","module":"m","trace_id":"t","message":"msg {h}"}}' for h in range(part, 24, 2)]
            (folder / f"p{part}.json").write_text("\n".join([*lines, "not json", "[1]"]) + "\n")
    reader = splittable.DatedLogReader(str(tmp_path), from_date="2024-01-04")
    assert len(reader.partitions()) == 4 and {day for p in reader.partitions() for _, day in p.uris} == {"2024-01-04", "2024-01-05"}
    reader = splittable.DatedLogReader(str(tmp_path), 10, least=2, pattern="^msg")
    (part,) = reader.partitions()
    assert [r[0] for r in reader.read(part)] == [f"2024-01-0{d}T{h:02d}" for d, h in [(5, h) for h in range(21, -1, -3)] + [(4, 21), (4, 18)]]
    assert len(reader.opened) == 4  # the three older folders were not opened
    splittable.register(spark)
    logs = spark.read.format("dated_logs").load(str(tmp_path))
    assert logs.where((F.col("date") >= "2024-01-04") & (F.col("level") == "ERROR")).count() == 16 and logs.count() == 120
    newest = readers.json_logs(spark, str(tmp_path), since="2024-01-05T10", limit=3)
    assert [r["ts"] for r in newest.collect()] == ["2024-01-05T23", "2024-01-05T22", "2024-01-05T21"]
    every = readers.json_logs(spark, str(tmp_path), since="2024-01-03", level=2, trace_id="t", pattern="msg [1-9]$")
    assert [r["ts"] for r in readers.json_logs(spark, str(tmp_path), "2024-01-03", 2, "t", "msg [1-9]$", 100).collect()] == sorted((r["ts"] for r in every.collect()), reverse=True)


def test_maintainers(spark, tmp_path):
    (tmp_path / "M").write_text("List\n\nNET\nM:\tA <a@x>\nS:\tMaintained\nF:\tnet/\nX:\tnet/old/\n\nNET\nM:\tB <b@x>\nF:\tinclude/net/\n\ntext only\n")
    (r,) = readers.maintainers(spark, str(tmp_path / "M")).collect()
    assert (r["name"], r["status"], r["people"], r["files"], r["excluded"]) == ("NET", "Maintained", ["A <a@x>", "B <b@x>"], ["include/net/", "net/"], ["net/old/"])


def test_cve_logs_and_quarantine(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"id":"CVE-1","descriptions":[{"lang":"es","value":"n"},{"lang":"en","value":"y"}],"metrics":{"cvssMetricV30":[{"cvssData":{"baseScore":7.5}}]},"references":[{"url":"u","tags":["t"]}]}\n')
    (r,) = readers.cve_records(spark, str(tmp_path / "c.json")).collect()
    assert (r["cve_id"], r["description"], float(r["score"])) == ("CVE-1", "y", 7.5)
    logs = spark.createDataFrame([("2024-01-0%dT00" % d, lv, "m", "t", "msg", "2024-01-0%d" % d) for d in (1, 5) for lv in ("INFO", "ERROR")], "ts string, level string, module string, trace_id string, message string, date string")
    logs.write.partitionBy("date").json(str(tmp_path / "logs"))
    got = readers.json_logs(spark, str(tmp_path / "logs"), since="2024-01-03", level=2).collect()
    assert [(r["ts"], r["level"]) for r in got] == [("2024-01-05T00", "ERROR")]
    good = readers.quarantine(spark.range(5), F.col("id") > 3, "too big", str(tmp_path / "q"))
    assert good.count() == 4 and spark.read.json(str(tmp_path / "q")).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 9}:30:00", "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"), df.schema)
    events.run_once(events.windowed_counts(stream, "ts", "kind", late="1 day"), str(tmp_path / "out"), str(tmp_path / "cp"), mode="append")
    late = spark.createDataFrame([(99, "2024-01-05 00:00:00", "a")], "id int, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    events.run_once(events.windowed_counts(events.event_stream(spark, str(tmp_path / "in"), df.schema), "ts", "kind", late="1 day"), str(tmp_path / "out"), str(tmp_path / "cp"), mode="append")
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in events.windowed_counts(df, "ts", "kind").collect())


def test_quarantine_replay_and_rebuild(spark, tmp_path):
    place = str(tmp_path / "q")
    for start in (0, 10, 20):
        readers.quarantine(spark.range(start, start + 5).withColumn("name", F.concat(F.lit("n"), "id")), F.col("id") % 2 == 0, "even", place)
    readers.quarantine(spark.range(99, 100).withColumn("name", F.lit("x")), F.lit(None).cast("boolean"), "other", place)
    got = [tuple(r) for r in readers.replay(spark, place, "id long, name string", reason="even", most=5).collect()]
    assert got == [(20, "n20"), (22, "n22"), (24, "n24"), (10, "n10"), (12, "n12")]
    folder = str(tmp_path / "derived")
    assert upsert.rebuilt(spark.range(9), folder).count() == 9 and upsert.rebuilt(spark.range(3), folder).count() == 3
