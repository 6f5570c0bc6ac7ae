import csv
import io
import itertools

import pandas as pd
import pyarrow as pa
import pytest

from pressgauge.sources import articles, records

TEXT = 'id,t,c\n1,"a\nb",x\n\n2,"say ""hi""\n, ""q"" \n\nend",5" pipe\n3,,"z"tail, "n\n4,"é\n","\n"\n5,"",last'


def expected(text):
    """The records by a plain walk over the characters; Python's reader agrees where the dialects do."""
    out, record, inside, start, at = [], "", False, True, 0
    while at < len(text):
        ch = text[at]
        if inside:
            if ch == '"' and text[at + 1 : at + 2] == '"':
                record, at = record + '""', at + 2
                continue
            inside = ch != '"'
            record += ch
        elif ch == "\n":
            out.append(record)
            record, start = "", True
            at += 1
            continue
        else:
            inside = ch == '"' and start
            start = ch == ","
            record += ch
        at += 1
        if inside:
            start = False
    return [r for r in [*out, record] if r]


def read(spark, path):
    return [r.text for r in records.read_records(spark, str(path)).orderBy("file", "number").collect()]


@pytest.fixture
def ranges(spark):
    """Sets the size of byte ranges; the session's own afterwards."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {name: spark.conf.get(name) for name in names}

    def cut(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield cut
    for name, value in before.items():
        spark.conf.set(name, value)


def test_still_open_at_every_character():
    text = TEXT.replace("\n", "\\")
    for start, stop in itertools.combinations(range(len(text) + 1), 2):
        line = text[start:stop]
        for inside in (False, True):
            # in one line, a newline can only be the end: the walk tells whether it is still inside
            walked = expected('"' * inside + line + "\n|") if not (inside and line.startswith('"')) else None
            if walked is not None:
                assert records.still_open(line.encode(), inside) == (len(walked) == 1 and walked[0].endswith("\n|"))


def in_ranges(data, borders):
    """The three passes by hand over lines dealt to ranges as Spark deals them: a line belongs to the range that holds the
    byte before it; the first range also has the first line."""
    edges = [0, *borders, len(data)]
    starts = [0] + [i + 1 for i, byte in enumerate(data) if byte == 10 and i + 1 < len(data)]
    dealt = [[] for _ in edges[1:]]
    for at in starts:
        k = 0 if at == 0 else next(k for k in range(len(edges) - 1) if edges[k] < at <= edges[k + 1])
        dealt[k].append(data[at:].split(b"\n", 1)[0])
    lines = [(edges[k], line) for k, some in enumerate(dealt) for line in some]
    first = pa.RecordBatch.from_pydict({"path": ["f"] * len(lines), "start": [s for s, _ in lines], "value": [v for _, v in lines]})
    told = [r for batch in records._transfers(iter([first])) for r in batch.to_pylist()]
    by_start = {r.start: r for r in records._chain(pd.DataFrame(told)).itertuples()}
    placed = pa.RecordBatch.from_pydict(
        {
            "file": [0] * len(lines),
            "start": [s for s, _ in lines],
            "inside": [by_start[s].inside for s, _ in lines],
            "first": [by_start[s].first for s, _ in lines],
            "value": [v for _, v in lines],
        }
    )
    found = {}
    for whole in (True, False):
        cut = [r for batch in records._cut(whole)(iter([placed])) for r in batch.to_pylist()]
        for r in sorted(cut, key=lambda r: r["start"]):
            assert not whole or r["number"] not in found
            found[r["number"]] = found[r["number"]] + "\n" + r["text"] if r["number"] in found else r["text"]
    return [found[k] for k in range(len(found))]


def test_borders_at_every_byte():
    data, want = TEXT.encode(), expected(TEXT)
    assert len(want) == 6 and want[2].count("\n") == 3
    for one in range(1, len(data)):
        assert in_ranges(data, [one]) == want, one
        for two in range(one + 1, len(data)):
            assert in_ranges(data, [one, two]) == want, (one, two)
    assert in_ranges(data, list(range(1, len(data)))) == want


def test_small_ranges(spark, tmp_path, ranges):
    path = tmp_path / "one.csv"
    path.write_bytes(TEXT.encode())
    for size in (3, 8, 17):
        ranges(size)
        assert read(spark, path) == expected(TEXT), size


def test_many_ranges_share_one_file(spark, tmp_path, ranges):
    path = tmp_path / "dump.csv"
    buffer = io.StringIO()
    writer = csv.writer(buffer, lineterminator="\n")
    rows = [[str(i), f"t {i}", "word\n" * (i % 7) + '"q"' * (i % 3), "x" * (i % 50)] for i in range(3_000)]
    writer.writerows([["id", "title", "text", "label"], *rows])
    path.write_text(buffer.getvalue())
    ranges(4_000)
    got = articles.read_article_csv(spark, str(path))
    assert records._lines(spark, str(path)).rdd.getNumPartitions() > 30
    read_rows = [r for r in got.collect()]
    assert sorted((r.id, r.title, r.text or "", r.label or "") for r in read_rows) == sorted((a, b, c, d) for a, b, c, d in rows)
    # only pieces of records at borders are shuffled
    placed = articles._read_article_csv(spark, str(path)).orderBy("pos").select("id").collect()
    assert [int(r.id) for r in placed] == list(range(3_000))


def test_line_ends_bytes_files_and_nothing(spark, tmp_path, ranges):
    crlf = tmp_path / "crlf.csv"
    crlf.write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n')
    assert read(spark, crlf) == ["a,b", '1,"x\ny"', "2,z"]
    bad = tmp_path / "bad.csv"
    bad.write_bytes(b'1,\xff\xfe"\n2,"\xc3\n\xa9"\n')
    assert read(spark, bad) == ['1,��"', '2,"�\n�"']
    many = tmp_path / "many"
    many.mkdir()
    (many / "b 1%20+é.csv").write_text('3,"never\nclosed\n4,x\n')
    (many / "a.csv").write_text("1,x\n2,y")
    (many / "c.csv").write_text("")
    for size in (3, 1_000):
        ranges(size)
        assert read(spark, many) == ["1,x", "2,y", '3,"never\nclosed\n4,x']
    assert read(spark, many / "c.csv") == []


def test_parts_of_one_table_are_numbered_through(spark, tmp_path):
    parts = ['title,body\n1,"a\nb"\n2,c\n', "title,body\n", 'title,body\n3,"title,body\n"\n\n4,d\n', 'title,body\n5,"e\n\nf"']
    for n, part in enumerate(parts):
        (tmp_path / f"part-{n:05}.csv").write_text(part)
    for size in ("128m", "9"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            read = articles.read_labelled_csv(spark, str(tmp_path), "s", label="real", text_col="body", one_table=True)
            found = sorted((r.pos, r.headline, r.body) for r in read.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert found == [(1, "1", "a\nb"), (2, "2", "c"), (3, "3", "title,body\n"), (4, "4", "d"), (5, "5", "e\n\nf")]
