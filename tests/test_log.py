"""The log-structured table, the Python data sources, the splitter as a table function, and session state."""

import hashlib
import random
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from policyloom.operators import segment
from policyloom.sources import reader
from policyloom.sources.log import LogTable
from policyloom.streaming import sessions

ROWS, HEADS = "k string, n int, text string", "k string, content_hash string"


def put(log, spark, content, batch=None):
    """``content`` gives each key its texts, or None to remove it."""
    new = spark.createDataFrame([(k, n, t) for k, texts in content.items() for n, t in enumerate(texts or [])], ROWS)
    heads = spark.createDataFrame([(k, None if t is None else str(t)) for k, t in content.items()], HEADS)
    return log.put(new, heads, batch)


def test_log_equals_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    log = LogTable(spark, str(tmp_path / "log"), key="k", fan=3, small_rows=2, bucket_rows=5)
    assert log.read() is None and log.heads() is None
    now, written, levels = {}, {}, set()
    for step in range(1, 8):
        content = {f"k{rng.randrange(9)}": rng.choice([None, [], [f"s{step}"], [f"s{step}", "more", "more"]]) for _ in range(5)}
        assert put(log, spark, content)
        now |= content
        written |= dict.fromkeys(content, step)
        levels |= {s.level for s in log.state()[2]}
        if step in (3, 7):
            expected = [(k, n, t) for k, texts in now.items() for n, t in enumerate(texts or [])]
            assert rows(log.read(), "k", "n", "text") == sorted(expected, key=repr)
            some = spark.createDataFrame([("k1",), ("k5",), ("k5",), ("none",)], "k string")
            assert rows(log.read(some), "k", "n", "text") == sorted((r for r in expected if r[0] in ("k1", "k5")), key=repr)
            assert rows(log.heads()) == sorted(((k, str(t)) for k, t in now.items() if t is not None), key=repr)
            assert {r.k: r.v for r in log.read(version="v").collect()} == {k: written[k] for k, t in now.items() if t}
    assert len(log.state()[2]) < 6 and max(levels) > 0
    before = rows(log.read())
    assert log.vacuum() > 0 and rows(log.read()) == before
    assert len(list((tmp_path / "log" / "data").iterdir())) == len(log.state()[2])
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_batch_is_written_once_and_alone(spark, tmp_path):
    log = LogTable(spark, str(tmp_path / "log"), key="k", fan=9)
    assert put(log, spark, {f"k{i}": ["x"] * 3 for i in range(50)}, 0)
    size = lambda: {p for p in (tmp_path / "log" / "data").rglob("*.parquet")}
    first = size()
    assert put(log, spark, {"k1": ["changed"]}, 1)
    added = [s for s in log.state()[2] if s.rows == 1]
    assert len(added) == 1 and first <= size()
    assert not put(log, spark, {"k1": ["again"]}, 1)
    assert rows(log.read().where("k = 'k1'"), "text") == [("changed",)]


def test_rows_are_written_once_and_the_last_write_meets_no_heads(spark, tmp_path):
    log = LogTable(spark, str(tmp_path / "log"), key="k", fan=9, bucket_rows=20)
    content = {f"k{i}": ["x"] * 3 for i in range(50)}
    new = spark.createDataFrame([(k, n, t) for k, texts in content.items() for n, t in enumerate(texts)], ROWS)
    heads = spark.createDataFrame([(k, "h") for k in content], HEADS)
    staged = log.stage(new, log.buckets_for(150))
    assert log.read() is None and staged.n == 150 and staged.buckets == 8
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "log" / "data").rglob("*.parquet")}
    assert log.put(staged, heads)
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    assert "Join" not in log.read()._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        log.put(staged, heads)
    # an estimate that is far off only gives other buckets
    assert log.put(new.where("k = 'k1'").withColumn("text", F.lit("y")), heads.where("k = 'k1'"), expect=1000)
    assert log.put(new.limit(0), heads.where("k = 'k2'").withColumn("content_hash", F.lit(None).cast("string")), expect=1000)
    expected = [(k, n, "y" if k == "k1" else t) for k, texts in content.items() for n, t in enumerate(texts) if k != "k2"]
    assert rows(log.read(), "k", "n", "text") == sorted(expected)
    assert rows(log.read(heads.where("k in ('k1', 'k2', 'k3')")), "k", "text") == [("k1", "y")] * 3 + [("k3", "x")] * 3


def test_a_sync_cuts_and_writes_its_chunks_once(spark, tmp_path, monkeypatch):
    from policyloom.plans import analysis

    log = LogTable(spark, str(tmp_path / "log"), key="framework", bucket_rows=5)
    pages = spark.createDataFrame([(d, f"f{d % 3}", 1, "The words of a page. " * 300) for d in range(12)], "doc_id long, framework string, page_number int, text string")
    roles = spark.createDataFrame([(f"f{n}", ["x", "y"]) for n in range(3)], "framework string, roles array<string>")
    sums = spark.createDataFrame([(f"f{n}", "1") for n in range(3)], "name string, checksum string")
    staged, stage = [], LogTable.stage
    monkeypatch.setattr(LogTable, "stage", lambda self, *a: staged.append(a[1]) or stage(self, *a))
    analysis.sync_store(log, pages, sums, roles)
    assert len(staged) == 1 and staged[0] > 1
    stored = log.read()
    assert stored.count() == log.state()[2][0].rows > 24 and stored.select("framework", "role").distinct().count() == 6


def test_yaml_catalog(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(
        "frameworks:\n  - name: \"A: one\"\n    version: 2021\n    roles: [x, y]\n    checksum: null\n  - website: no name\n  - name: B\n    roles: z\n    regions: [Global]\n    other: 1\n")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "d.yml").write_text("- name: C\n")
    (tmp_path / "more" / "empty.yaml").write_text("")
    (tmp_path / "more" / "notes.txt").write_text("- name: D\n")
    one = reader.read_catalog(spark, str(tmp_path / "c.yaml"))
    assert rows(one, "ord", "name", "version", "checksum", "roles", "regions") == [
        (0, "A: one", "2021", None, ["x", "y"], []), (2, "B", None, None, ["z"], ["Global"])]
    assert rows(reader.read_catalog(spark, str(tmp_path)), "name") == [("A: one",), ("B",), ("C",)]
    assert reader.read_catalog(spark, str(tmp_path / "none.yaml")).count() == 0


def test_small_folders_share_a_task(spark, tmp_path):
    for n in range(30):
        (tmp_path / f"d{n:02d}").mkdir()
        (tmp_path / f"d{n:02d}" / "f.txt").write_text(str(n))
    (tmp_path / "own.txt").write_text("own")
    reader.register(spark)
    files = spark.read.format("folder_files").option("partitions", 4).load(str(tmp_path))
    assert files.rdd.getNumPartitions() == 4
    assert sorted(bytes(r.content).decode() for r in files.collect()) == sorted([*map(str, range(30)), "own"])


@pytest.mark.parametrize("depth", [0, 2])
def test_tree_of_files(spark, tmp_path, depth):
    content = {"a.pdf": b"x", "b.txt": b"y", "d/c.pdf": b"", "d/e/f.pdf": b"deep", "d/e/g/h.pdf": b"deeper", "_temporary/z.pdf": b"no", ".hid.pdf": b"no"}
    for name, body in content.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    found = reader.read_tree(spark, str(tmp_path), "*.pdf", depth)
    got = {r.path.removeprefix(str(tmp_path) + "/"): (r.length, bytes(r.content), r.checksum) for r in found.collect()}
    assert got == {n: (len(c), c, hashlib.sha256(c).hexdigest()) for n, c in content.items() if n.endswith("pdf") and not n.startswith(("_", "."))}


def test_sections_through_the_table_function(spark):
    segment.register_split_sections(spark)
    texts = [("d1", 1, "One. " * 30), ("d1", 2, "x" * 90), ("d1", 3, ""), ("d2", 1, "short")]
    sections = spark.createDataFrame([(d, n, t, 1, 3) for d, n, t in texts], "doc_id string, section_no long, text string, low int, high int")
    found = spark.sql("SELECT * FROM split_sections(TABLE(SELECT * FROM {s}) PARTITION BY (doc_id) ORDER BY (section_no), 40, 10)", s=sections)
    frame = sections.withColumn("pages", F.array("low", "high")).withColumn("section_title", F.lit("t"))
    plain = segment.split_sections(frame, 40, 10)
    columns = ("doc_id", "section_no", "chunk_no", "chunk_start", "chunk_end", "page_number")
    assert rows(found, *columns, "chunk_text") == rows(plain, *columns, "text")
    places = {}
    for r in sorted(found.collect(), key=lambda r: (r.doc_id, r.section_no, r.chunk_no)):
        places.setdefault(r.doc_id, []).append(r.position)
    assert all(v == list(range(1, len(v) + 1)) for v in places.values())


def test_sessions_keep_every_turn(spark, tmp_path):
    """More naming turns than any cap, then late ones that cut runs; a batch twin says what holds."""
    schema = "conv_id string, turn int, text string"
    rng = random.Random(5)
    early = [("a", t, rng.choice(["alpha", "beta", "none"])) for t in range(0, 600, 2)]
    late = [("a", t, rng.choice(["alpha", "beta", "gamma", "none"])) for t in range(1, 600, 6)] + [("b", 1, "none")]
    names = {"alpha": "A", "beta": "B", "gamma": "C"}
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for wave in (early, late):
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(source)
        found = sessions.active_dimensions(
            spark.readStream.schema(schema).parquet(source), aliases={"A": ("alpha",), "B": ("beta",), "C": ("gamma",)})
        found.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = {(r.conv_id, r.turn): r.active_dimension for r in spark.read.schema(found.schema).parquet(target).collect()}
    expected = {}
    for known, asked in ((early, early), (early + late, late)):
        for c, t, _ in asked:
            before = [names[x] for d, u, x in sorted(known) if d == c and u < t and x in names]
            expected[c, t] = before[-1] if before else None
    assert got == expected


def test_idle_sessions_are_forgotten(spark, tmp_path):
    schema = "conv_id string, turn int, text string"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*wave):
        spark.createDataFrame(list(wave), schema).coalesce(1).write.mode("append").parquet(source)

    def wait(n):
        for _ in range(80):
            time.sleep(0.5)
            got = {(r.conv_id, r.turn): r.active_dimension for r in spark.read.schema(found.schema).parquet(target).collect()} if (tmp_path / "out").exists() else {}
            if len(got) >= n:
                return got
        raise AssertionError(got)

    arrive(("a", 1, "alpha"))
    found = sessions.active_dimensions(spark.readStream.schema(schema).parquet(source), aliases={"A": ("alpha",)}, idle_ms=2000, ttl_ms=10**9)
    query = found.writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        wait(1)
        time.sleep(6)
        arrive(("a", 2, "none"), ("b", 1, "alpha"))
        assert wait(3) == {("a", 1): None, ("a", 2): None, ("b", 1): None}
    finally:
        query.stop()
