"""Records across splits: equal to a sequential reader wherever the bytes are cut."""
import csv
import io
import json
import random

import numpy as np
import pyarrow as pa
import pytest

from checkwise.api import KpiStore
from checkwise.operators import records
from checkwise.sources import files


@pytest.fixture
def split_bytes(spark):
    """Sets the size of a split in bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def set_to(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")

    yield set_to
    for n, v in before.items():
        spark.conf.set(n, v)


def _sequential(text):
    return [row for row in csv.reader(io.StringIO(text, newline=""), strict=False)]


def _csv_found(spark, path):
    rows = sorted((r.line_no, r.value) for r in files.read_csv_text(spark, path).collect())
    assert [n for n, _ in rows] == list(range(1, len(rows) + 1))
    return [(_sequential(v) or [[]])[0] for _, v in rows]


def _after(line, quoted):
    """Whether a line of CSV ends inside quotes, byte by byte."""
    state = 2 if quoted else 0
    for c in line:
        if state == 2:
            state = 3 if c == '"' else 2
        elif c == '"' and state in (0, 3):
            state = 2
        else:
            state = 0 if c == "," else 1
    return int(state == 2)


def _ended(text):
    """The text without its last line break if a quote is still open there (the reader never shows that break)."""
    state = 0
    for line in text.split("\n"):
        state = _after(line, state)
    return text.removesuffix("\n") if state else text


def _cut_records(text, cuts, batch):
    """The records of a CSV text whose lines are dealt to splits at ``cuts``, by the functions that run in the tasks."""
    lines = text.split("\n")[:-1] if text.endswith("\n") else text.split("\n")
    split = np.searchsorted(cuts, np.arange(len(lines)), "right")
    maps = [(_after(x, False), _after(x, True)) for x in lines]
    rows = [("f", int(k), x, *m, 0, 0) for x, m, k in zip(lines, maps, split, strict=True)]
    narrow = [("f", int(k), *m, 0, 0) for m, k in zip(maps, split, strict=True)]

    def batches(rows, types):
        return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + batch], strict=True), types, strict=True)],
                                           [str(j) for j in range(len(types))]) for i in range(0, len(rows), batch)]

    narrow_types = [pa.string(), pa.int64(), *[pa.int32()] * 4]
    start, state, number = {}, 0, 0
    for r in (r for b in records._summary(iter(batches(narrow, narrow_types))) for r in b.to_pylist()):
        start[r["block_start"]] = (state, 0, number)
        number += r[f"n{state}"]
        state = r[f"e{state}"]
    wide = [(*r, *start[r[1]]) for r in rows]
    types = [pa.string(), pa.int64(), pa.string(), *[pa.int32()] * 4, pa.int32(), pa.int64(), pa.int64()]
    found = [r for cut in (False, True) for b in records._records(0, "\n", cut)(iter(batches(wide, types))) for r in b.to_pylist()]
    whole = {}
    for r in sorted(found, key=lambda r: (r["block_start"], r["seq"])):
        whole.setdefault(r["record_no"], []).append(r["value"])
    assert sorted(whole) == list(range(1, len(whole) + 1))
    return [(_sequential("\n".join(whole[k])) or [[]])[0] for k in sorted(whole)]


def test_csv_every_cut():
    """Random quoted files, cut into splits anywhere: the same records as a sequential reader's."""
    g = random.Random(3)
    for _ in range(400):
        text = "".join(g.choice('ab,,"""\n\n') for _ in range(g.randrange(1, 60)))
        cuts = sorted(g.randrange(1, 20) for _ in range(g.randrange(0, 12)))
        assert _cut_records(text, cuts, g.randrange(1, 9)) == _sequential(_ended(text))


@pytest.mark.parametrize("seed, sizes", [(1, (3,)), (2, (17,))])
def test_csv_files(spark, tmp_path, split_bytes, seed, sizes):
    g = random.Random(seed)
    text = 'A,B\n"x\ny",1\n\n"a ""q"" b\n\n,c",2\nplain,"",\nab"c,"d"e\n""\n"last\nline"\n' + "".join(
        g.choice('ab,,"""\n\n é') for _ in range(150))
    (tmp_path / "k.csv").write_text(text, newline="")
    for n in sizes:
        split_bytes(n)
        assert _csv_found(spark, str(tmp_path)) == _sequential(_ended(text))


def test_csv_line_maps(spark):
    """A line's map, from either state, against a byte-by-byte automaton."""
    g = random.Random(1)
    lines = ["".join(g.choice('a,"') for _ in range(g.randrange(0, 9))) for _ in range(500)]
    e0, e1, *_ = records.csv_format().maps
    got = spark.createDataFrame([(x,) for x in lines], "value string").select("value", e0.alias("a"), e1.alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(_after(r.value, False), _after(r.value, True)) for r in got]


def test_starts_compose():
    g = random.Random(2)
    for _ in range(200):
        maps = [(g.randrange(2), g.randrange(2)) for _ in range(g.randrange(0, 12))]
        for s in (0, 1):
            want, now = [], s
            for m in maps:
                want.append(now)
                now = m[now]
            e0, e1 = (np.array([m[i] for m in maps], np.int64) for i in (0, 1))
            states, end = records.starts(e0, e1, s)
            assert (states.tolist(), end) == (want, now)


def _value(g, depth=0):
    kind = g.randrange(8 if depth < 3 else 5)
    if kind >= 6:
        return [_value(g, depth + 1) for _ in range(g.randrange(4))]
    if kind == 5:
        return {g.choice("ab,]\"\\") + str(i): _value(g, depth + 1) for i in range(g.randrange(4))}
    return g.choice([1, -2.5, None, True, "", "a,b", '"', "\\", '\\"', "]},{[", "é\n", "x" * 40])


@pytest.mark.parametrize("seed", range(2))
def test_json_array_random(spark, tmp_path, split_bytes, seed):
    g = random.Random(seed)
    elements = [{"k": i, "v": _value(g)} for i in range(12)]
    text = " \n" + json.dumps(elements, indent=g.choice([None, 1]), ensure_ascii=False) + "\n "
    (tmp_path / "h.json").write_text(text)
    for n in (16,):
        split_bytes(n)
        got = [json.loads(r.value) for r in files.read_history_array(spark, str(tmp_path)).collect()]
        assert sorted(got, key=lambda x: x["k"]) == elements


@pytest.mark.parametrize("text, want", [("[]", []), (" [ ] ", []), ("", []), ("[1]", ["1"]), ('["a,b"]', ['"a,b"']),
                                        ("[[1,2],[3]]", ["[1,2]", "[3]"]), ("﻿[{}]", ["{}"])])
def test_json_array_small(spark, tmp_path, split_bytes, text, want):
    (tmp_path / "h.json").write_text(text)
    for n in (1,):
        split_bytes(n)
        assert sorted(r.value for r in files.read_history_array(spark, str(tmp_path)).collect()) == want


def test_one_file_many_tasks(spark, tmp_path, split_bytes):
    """One array in one line is read by many tasks, and equals the JSON Lines result."""
    rows = [{"batch_id": f"B{i}", "date": "2026-04-01", "room": "Pink, \"x\"", "staff_id": "s", "check": "yes", "weight": i % 5,
             "indicator": "Door [1], {2}"} for i in range(500)]
    (tmp_path / "array").mkdir()
    (tmp_path / "lines").mkdir()
    (tmp_path / "array" / "h.json").write_text(json.dumps(rows))
    (tmp_path / "lines" / "h.json").write_text("\n".join(json.dumps(r) for r in rows))
    split_bytes(4096)
    pieces = records.read_pieces(spark, str(tmp_path / "array"), ",")
    assert pieces.rdd.getNumPartitions() > 10
    a, b = KpiStore(spark, str(tmp_path / "a")), KpiStore(spark, str(tmp_path / "b"))
    a.import_history(str(tmp_path / "array"), array=True)
    b.import_history(str(tmp_path / "lines"))
    found = [sorted(tuple(r) for r in s.entries().drop("created_at", "load_id", "id").collect()) for s in (a, b)]
    assert found[0] == found[1] and len(found[0]) == 500


def test_csv_import_with_line_breaks(spark, tmp_path, split_bytes):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "k.csv").write_bytes(
        b"\xef\xbb\xbfDate,Room,Slot,Staff ID,Type,KPI Indicator,Category,Result,Weight\r\n"
        b'4/21/2026,Pink,AM,b,Team,"Door\r\nand ""window"",\nclosed",c,No,2\r\n\r\n'
        b"4/22/2026,Pink,AM,b,Team,Door,c,Yes,1\r\n")
    for n in (7,):
        split_bytes(n)
        r = KpiStore(spark, str(tmp_path / f"s{n}")).import_csv(str(tmp_path / "in"))
        assert sorted((x.entry_date.day, x.indicator_text, x.check_value) for x in r.entries.collect()) == [
            (21, 'Door\r\nand "window",\nclosed', 0), (22, "Door", 1)]
        assert tuple(r.stats.first()) == (2, 0, 0)


def test_csv_maps_on_bytes():
    """The maps that tasks compute are those of a byte-by-byte automaton."""
    g = random.Random(5)
    lines = ["".join(g.choice('a,""é') for _ in range(g.randrange(0, 9))) for _ in range(3000)]
    e0, e1 = records.csv_ends(pa.array(["x", *lines]).slice(1))
    assert list(zip(e0.tolist(), e1.tolist(), strict=True)) == [(_after(x, False), _after(x, True)) for x in lines]


def test_json_array_every_cut():
    """The maps and elements of a JSON array whose pieces are dealt to splits anywhere, by the functions that run in the tasks."""
    g = random.Random(6)
    for _ in range(300):
        elements = [{"k": i, "v": _value(g)} if g.randrange(4) else _value(g) for i in range(g.randrange(8))]
        text = " " + json.dumps(elements, indent=g.choice([None, 1]), ensure_ascii=False) + "\n"
        pieces = text.split("{")
        cuts = sorted(g.randrange(1, 20) for _ in range(g.randrange(0, 6)))
        block = np.searchsorted(cuts, np.arange(len(pieces)), "right")
        size = g.randrange(1, 5)

        def batches(extra, pieces=pieces, block=block, size=size):
            for i in range(0, len(pieces), size):
                here = block[i:i + size].tolist()
                cols = [pa.array(["f"] * len(here)), pa.array(here), pa.array(["{" + x for x in pieces[i:i + size]])]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array([extra[b][j] for b in here]) for j in range(3 if extra else 0))],
                                                 [str(j) for j in range(6 if extra else 3)])

        start, state, depth = {}, 0, 0
        for r in (r for b in records._summary(records._json_mapped(batches(None))) for r in b.to_pylist()):
            start[r["block_start"]] = (state, depth, 0)
            state, depth = r[f"e{state}"], depth + r[f"d{state}"]
        assert (state, depth) == (0, 0)
        inner = [x for b in records._json_elements(False)(batches(start)) for x in b.column(0).to_pylist()]
        edges, joined = [r for b in records._json_elements(True)(batches(start)) for r in b.to_pylist()], []
        for r in sorted(edges, key=lambda r: (r["block_start"], r["seq"])):
            joined = joined + [r["value"]] if not r["open_start"] or not joined else [*joined[:-1], joined[-1] + r["value"]]
        joined[0] = joined[0].strip()[1:]
        joined[-1] = joined[-1].strip()[:-1]
        found = [json.loads(x) for x in [*inner, *joined] if x]
        assert sorted(map(json.dumps, found)) == sorted(map(json.dumps, elements))


def test_maps_are_no_expressions(spark, tmp_path):
    """The scans compute their maps on bytes: as expressions, they cost more than all the rest."""
    (tmp_path / "k").write_text("A,B\n1,2\n")
    inner, _ = records.read_elements(spark, str(tmp_path))
    for df in (files.read_csv_text(spark, str(tmp_path)).select("line_no"), inner):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and not any(x in plan for x in ("split(", "aggregate(", "regexp_replace("))


@pytest.mark.parametrize("text", ["﻿A,B\r\r\n1,2\r\n", '"A\nx",B\n1,2\n', 'A"x,B\n1\n', "A,B"])
def test_header_from_the_first_lines(spark, tmp_path, split_bytes, text):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(text, newline="")
    split_bytes(4)
    lines = files.read_csv_text(spark, str(tmp_path))
    assert files.read_csv_header(spark, str(tmp_path), lines) == files.csv_header(lines)
