"""Log files read by byte ranges: line numbers, offsets and tail hashes are those of the whole files."""

import hashlib
import random

from pyspark.sql import functions as F

from ledgerloom.sources import files, logs

RANGE = "spark.sql.files.maxPartitionBytes"


def written(tmp_path):
    rng, made = random.Random(4), {}
    texts = {
        "a.jsonl": "".join(f"{{\"n\":{i},\"t\":\"{'é' * rng.randint(0, 40)}\"}}\n" for i in range(700)),
        "b.jsonl": "\n".join("x" * rng.choice([0, 1, 3, 200, 3000]) for _ in range(120)) + "end",
        "c.jsonl": "one line\r\n\r\nthree\r\n",
        "d.jsonl": "no line end",
        "e.jsonl": "y" * 9000 + "\n" + "z" * 5000,
        "f.jsonl": "q" * 4095 + "\n",
        "g.jsonl": "\n\n\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
        made[name] = text.encode()
    return made


def test_lines_by_ranges(spark, tmp_path):
    made = written(tmp_path)
    want = set()
    for name, raw in made.items():
        at = 0
        pieces = raw.split(b"\n")
        for i, line in enumerate(pieces[:-1] if not pieces[-1] else pieces):
            want.add((name, i + 1, at, line.decode()))
            at += len(line) + 1
    before = spark.conf.get(RANGE)
    for size in ("97", "4096", "128m"):
        spark.conf.set(RANGE, size)
        rows = logs.lines(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("file", "/"), -1))
        got = [tuple(r) for r in rows.collect()]
        assert len(got) == len(want) and set(got) == want
    spark.conf.set(RANGE, "97")
    assert logs.ranged(spark, str(tmp_path)).filter("file like '%a.jsonl'").select("range_").distinct().count() > 100
    spark.conf.set(RANGE, before)


def test_tail_hashes(spark, tmp_path):
    made = written(tmp_path)
    before = spark.conf.get(RANGE)
    for size in ("97", "1000", "128m"):
        spark.conf.set(RANGE, size)
        got = {r["path"].rpartition("/")[2]: (r["length"], r["tail_hash"]) for r in logs.file_listing(spark, str(tmp_path)).collect()}
        assert got == {n: (len(raw), hashlib.sha1(raw[-4096:]).hexdigest()[:16]) for n, raw in made.items()}
    spark.conf.set(RANGE, before)
    cursors = spark.createDataFrame([(r["path"], r["length"], r["tail_hash"]) for r in logs.file_listing(spark, str(tmp_path)).collect()], "path string, length bigint, tail_hash string")
    (tmp_path / "a.jsonl").write_bytes(made["a.jsonl"] + b"more\n")
    (tmp_path / "d.jsonl").write_bytes(b"no line enD")
    (tmp_path / "n.jsonl").write_bytes(b"new\n")
    changed = files.changed_files(logs.file_listing(spark, str(tmp_path)), cursors)
    assert {r["path"].rpartition("/")[2] for r in changed.collect()} == {"a.jsonl", "d.jsonl", "n.jsonl"}
