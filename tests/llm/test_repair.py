"""Conversation repair, filter audit and archives against plain versions."""

import base64
import hashlib
import itertools
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest
from plain import empty_documents, odd_documents
from pyspark.sql import functions as F

from policyloom.llm import dialogue, warc
from policyloom.llm.audit import audit_filters, document_failures
from policyloom.llm.dialogue import RepairSettings, damage, repair_conversations
from policyloom.llm.queries import QUERIES
from policyloom.llm.warc import WarcSettings, read_archives, record_bytes, row_of, with_payloads, write_archives

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- conversations


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Counts, cost, audit and repaired lines of one conversation, by trying all edits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]

    def onward(state, initial):
        return {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(initial, {}).get(state)

    @cache
    def best(i, state, inserted):
        found = []
        if inserted < 4:
            turn = "a" if state == 2 else "u"
            cost, audit, lines = best(i, onward(state, turn), inserted + 1)
            found.append((cost + 5, "I" + audit, ({"u": "user", "a": "assistant"}[turn] + ":", *lines)))
        if i == len(rows):
            if state in (0, 3):
                found.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            found.append((cost + 2, "D" + audit, lines))
            if faults[i] not in ("b", "d"):
                more = 5 if faults[i] == "t" else 0
                for edit, price, initial, name in (("K", 0, initials[i], role), ("R", 1, "u", "user"), ("R", 1, "a", "assistant")):
                    to = onward(state, initial)
                    if to is not None:
                        cost, audit, lines = best(i + 1, to, 0)
                        found.append((cost + price + more, edit + audit, (f"{name}:{text}", *lines)))
        return min(found) if found else (10**9, "", ())

    cost, audit, lines = best(0, 0, 0)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    count = Counter(faults)
    return gaps, count["b"], count["d"], count["t"], illegal, cost, audit, lines


def random_rows(seed, conversations=40):
    rng, out = random.Random(seed), []
    for conv in [*range(conversations), None]:
        for turn in range(rng.choice([1, 2, 4, 9, 30])):
            turn = rng.choice([turn, turn, turn, turn + 3, None])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None, "u", "aide"])
            text = rng.choice(["Yes.", "No!", "Why?", "and then", "", " \n", "a.\t", None, "more \x85", "x", f"t{turn}.", f"n{rng.random()}", f"n{rng.random()}."])
            out.append((conv, turn, role, text))
    return out


def check_repair(spark, rows, settings):
    table = spark.createDataFrame(
        [(*r, 1, "x", k) for k, r in enumerate(rows)], "conv_id long, turn long, role string, text string, chunk int, conv string, place int"
    )
    repair = repair_conversations(table, settings)
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((conv, turn, " " if role is None else role, " " if text is None else text))
    expected = {c: plain_repair(g) for c, g in groups.items()}
    assert {r.conv_id: tuple(r)[1:] for r in repair.summary().collect()} == {c: e[:-1] for c, e in expected.items()}
    lines = defaultdict(list)
    for r in sorted(repair.repaired().collect(), key=lambda r: (r.chunk, r.step)):
        lines[r.conv_id].append((f"{r.role}:{r.text}", r.edit, r.turn))
    assert {c: tuple(x[0] for x in v) for c, v in lines.items()} == {c: e[-1] for c, e in expected.items() if e[-1]}
    assert all("".join(x[1] for x in v) == expected[c][-2].replace("D", "") for c, v in lines.items())
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.hashes().collect()}
    assert hashes == {c: hashlib.sha256("\n".join(e[-1]).encode()).hexdigest() for c, e in expected.items() if e[-1]}


@pytest.mark.parametrize(("seed", "settings"), [
    (1, RepairSettings()), (2, RepairSettings(chunk_bits=1)), (3, RepairSettings(chunk_bits=2, block=2)), (4, RepairSettings(chunk_bits=0, block=3)),
])
def test_repair_equals_a_plain_search(spark, seed, settings):
    check_repair(spark, random_rows(seed), settings)


def test_one_long_conversation_over_many_chunks(spark):
    rng = random.Random(9)
    roles = ["user", "assistant"]
    rows = [(5, k, roles[k % 2] if rng.random() < 0.9 else rng.choice([*roles, "system", "tool"]), f"Turn {k}{rng.choice(['.', '.', '.', ''])}") for k in range(300)]
    # edits that no row settles: truncated rows of another role, and equal rows
    rows += [(6, 0, "user", "Hello.")] + [(6, k, "tool", f"cut {k}") for k in range(1, 90)] + [(6, 90, "assistant", "Yes.")]
    rows += [(7, 3, "user", "Same.")] * 120 + [(7, None, "system", "Be kind.")]
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        check_repair(spark, rows, RepairSettings(chunk_bits=2, block=5))
    finally:
        sys.setrecursionlimit(limit)


def test_vectors_become_one_up_to_a_constant():
    costs = dialogue.Costs()
    codes = bytes([1, 2] * 3)
    ends = {costs.through(codes, costs.level(dialogue._closed(e))[0])[0] for e in ([0, 9, 9, 9], [9, 0, 9, 9], [9, 9, 0, 9], [9, 9, 9, 0])}
    assert len(ends) < 4
    assert len(costs.steps) < 60


def test_damage(spark):
    rows = random_rows(5, 200)
    found = damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert Counter(map(tuple, found)) == Counter(plain_damage(rows))


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    groups = defaultdict(list)
    for r in plain_damage(rows):
        groups[r[0]].append(r)
    found = {r.conv_id: r for r in QUERIES["op11_conversation_repair"](spark, DATA).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv, r in found.items():
        *numbers, audit, lines = plain_repair(groups[conv])
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == [*numbers, audit]
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_repair_of_lost_and_no_conversations(spark, tmp_path):
    schema = "conv_id string, turn int, role string, text string"
    lost = next(k for k in range(999) if zlib.crc32(f"c:{k}".encode()) % 20 == 0)
    kept = next(k for k in range(999) if zlib.crc32(f" :{k}".encode()) % 20 > 4)
    spark.createDataFrame([("c", lost, "user", "Hi."), (None, kept, "user", "Hi.")], schema).write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert found == {"c": (0, 0, 0, 0, 0, 0, "", nothing), None: (0, 0, 0, 0, 0, 2, "D", nothing)}
    empty = repair_conversations(spark.createDataFrame([], schema))
    assert (empty.summary().count(), empty.repaired().count(), empty.hashes().count()) == (0, 0, 0)


# --- filters


def plain_audit(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    fails, out = defaultdict(list), []
    for i, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        f = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and least[text] < i,
        }
        fails[source or ""].append(({k for k, v in f.items() if v}, i is not None and i in good, i is not None and i in toxic))
    for part, rows in fails.items():
        shapley, own = Counter(), []
        for order in itertools.permutations("ABCDE"):
            before = set()
            for step, c in enumerate(order, 1):
                here = [r for r in rows if c in r[0] and not r[0] & before]
                late = sum(1 for r in rows if c in r[0] and r[0] & before)
                before.add(c)
                kept = sum(1 for r in rows if not r[0] & before)
                shapley[c] += len(here)
                own.append((part, "".join(order), step, kept, len(here), late, sum(r[0] == {c} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here), c))
        out += [(*r[:-1], shapley[r[-1]]) for r in own]
    return out


def test_audit_equals_a_plain_count(spark):
    labels = [(7, 1, 0), (9, 0, 1), (9, 1, None), (9, None, 0), (None, 1, 1), (3, 1, 1), (1, None, None), (99, 1, 1)]
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    docs = odd_documents(spark)
    more = [(None, "ABC $ word", None), (4, "ABC $ word", ""), (4, "ABC $ word", "a"), (30, None, "b"), (31, "", "a"), (2, "ABC $ word", "a")]
    docs = docs.select("doc_id", "text", "source", "key", "row").union(spark.createDataFrame([(*r, None, 0) for r in more], "doc_id long, text string, source string, key string, row long"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    found = audit_filters(document_failures(docs, marks))
    assert Counter(map(tuple, found.collect())) == Counter(plain_audit(rows, labels))
    assert audit_filters(document_failures(empty_documents(spark), marks)).count() == 0
    none = audit_filters(document_failures(docs, marks.limit(0)))
    assert none.agg(F.sum("good_lost")).first()[0] == 0


def test_shapley_values_share_all_that_is_removed(spark):
    found = QUERIES["op12_filter_audit"](spark, DATA)
    for r in found.where("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("shapley").alias("s"), F.sum("removed").alias("r")).collect():
        assert r.s == math.factorial(5) * r.r


# --- archives

PAGES = "page_id long, url string, html string, first string, digest int, salt int"


def plain_pages(rows, least=0):
    smallest = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= least:
            smallest[data] = min(i, smallest.get(data, i))
    out = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        first = smallest.get(data)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        refers = None if first is None or first == i else first
        out[i, len(data), digest, "revisit" if refers is not None else "response", refers] += 1
    return out


def odd_pages():
    inner = record_bytes("9", "http://in", b"payload of a payload", "X" * 32, None, 20, "2000-01-01T00:00:00Z").decode()
    false = ["\r\n\r\nWARC/1.1\r\nContent-Length: %d\r\n\r\n" % n for n in (0, 5, 10**17)]
    pages = [
        (5, "http://a/\r\nx y", "same"), (3, None, "same"), (9, "http://b", "same"), (9, "http://b", "same"), (None, "http://c", "same"),
        (1, "http://d", None), (2, "", ""), (4, "http://e", "ünï€\x00"), (6, "u" * 200_000, inner), (7, "http://f", "\r\n\r\n" + inner * 3),
        (8, "http://g", "x" * 70_000 + "".join(false) + inner), (10, "http://h", "WARC/1.1\r\n"), (11, "http://i", "\r\n\r\n" + inner[:-9]),
        (-12, "http://j", "y" * 300_000), (None, "http://k", "alone"), (None, "http://l", "alone"), (13, "http://m", "\r\n\r\nWARC/1.1\r\n" + "a: b\r\n" * 20_000),
    ]
    return pages + [(100 + k, f"http://n/{k}", inner * (k % 4) + str(k % 17)) for k in range(120)]


@pytest.mark.parametrize("settings", [
    WarcSettings(), WarcSettings(least_bytes=5, archive_bytes=2000, block_bytes=512), WarcSettings(archive_bytes=100_000, block_bytes=300),
])
def test_archives_give_back_every_page(spark, tmp_path, settings):
    rows = odd_pages()
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], PAGES).repartition(3)
    archives = write_archives(table, str(tmp_path), settings=settings)
    records = read_archives(archives, settings).collect()
    assert all(r.intact for r in records)
    found = Counter()
    for r in records:
        found[tuple(x and int(x) for x in (row_of(r.record_id),)) + (r.payload_bytes, r.payload_digest, r.type, r.refers_to and int(row_of(r.refers_to)))] += 1
    assert found == plain_pages(rows, settings.least_bytes)
    whole = with_payloads(read_archives(archives, settings)).collect()
    assert Counter(bytes(r.payload) for r in whole) == Counter((html or "").encode() for _, _, html in rows)
    assert sum(r.records for r in archives.collect()) == len(rows)


def test_magic_in_payloads_is_a_candidate_that_no_chain_reaches(spark, tmp_path):
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in odd_pages()], PAGES)
    archive = write_archives(table.coalesce(1), str(tmp_path)).first()
    found = next(iter(warc._links(1 << 30)(iter([__import__("pandas").DataFrame({"path": [archive.path], "bytes": [archive.bytes], "begin": [0]})]))))
    assert len(found) > archive.records
    with open(archive.path, "rb") as f:
        data = f.read()
    assert data.count(b"WARC/1.1\r\n") > len(found)


def test_broken_archives_are_refused(spark, tmp_path):
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in odd_pages()], PAGES)
    archive = write_archives(table.coalesce(1), str(tmp_path / "a")).first()
    with open(archive.path, "rb") as f:
        data = f.read()
    (tmp_path / "cut.warc").write_bytes(data[:-7])
    cut = spark.createDataFrame([(str(tmp_path / "cut.warc"), len(data) - 7)], "path string, bytes long")
    with pytest.raises(Exception, match="no whole record"):
        read_archives(cut).collect()


def test_no_pages_no_archives(spark, tmp_path):
    archives = write_archives(spark.createDataFrame([], PAGES), str(tmp_path))
    assert archives.count() == 0
    assert read_archives(archives).count() == 0
    assert with_payloads(read_archives(archives)).count() == 0
