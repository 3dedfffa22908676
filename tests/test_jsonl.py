"""JSON lines read by ranges give what reading whole files gives, however files are split."""

import pytest

from corvid.sources import transcripts as R

FILES = {
    "good": b'{"a":1}\n{"a":2}\r\n\n  \n{"a":"\xc3\xa9\xe2\x82\xac and more text"}\n',
    "no_end": b'{"a":1}\n{"a":2}',
    "cut": b'{"a":1}\n{"a":2}\n{"a":',
    "cut_with_end": b'{"a":1}\n{"a":\n',
    "bad_inside": b'{"a":1}\nnope\n{"a":2}\n',
    "bad_and_cut": b'nope\n{"a":2}\n{"a"',
    "only_cut": b'{"a"',
    "blank_after_cut": b'{"a":1}\n{"a"\n  ',
    "bytes": b'{"a":1}\n{"a":"\xff\xfe"}\n{"a":3',
    "no_object": b'{"a":1}\n[1]\n',
    "number_cut": b' {"a":1}\n\t\n12',
    "empty": b"",
    "blank": b"\n\n\r\n",
    "long": b"".join(b'{"a":%d,"t":"%s"}\n' % (i, b"x" * (i * 7 % 90)) for i in range(200)) + b'{"a":200',
    "long_bad": b"".join(b'{"a":%d}\n' % i for i in range(100)) + b"]\n" + b"".join(b'{"a":%d}\n' % i for i in range(100)),
}


@pytest.fixture
def root(tmp_path):
    (tmp_path / "logs" / "deep").mkdir(parents=True)
    for i, (name, value) in enumerate(FILES.items()):
        (tmp_path / "logs" / ("deep" if i % 2 else ".") / f"{name}.jsonl").write_bytes(value)
    return str(tmp_path / "logs")


def plain(result):
    stem = lambda f: f.rsplit("/", 1)[1].split(".")[0]
    records, warned, failed = result
    return sorted((stem(r.file), r.line, r.j) for r in records.selectExpr("file", "line", "to_json(record) AS j").collect()), sorted(stem(r.file) for r in warned.collect()), sorted(stem(r.file) for r in failed.collect())


@pytest.mark.parametrize("size", [1 << 27, 1000, 64, 7])
def test_ranges_equal_whole_files(spark, root, size):
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root, wholetext=True)
    want = plain(R.jsonl_lines(whole.selectExpr("_metadata.file_path AS file", "value")))
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = plain(R.read_jsonl(spark, root))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want
    assert want[1] == ["bytes", "cut", "long", "number_cut", "only_cut"] and want[2] == ["bad_and_cut", "bad_inside", "blank_after_cut", "cut_with_end", "long_bad", "no_object"]


def test_byte_order_mark_and_no_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'\xef\xbb\xbf{"a":1}\n{"a')
    (tmp_path / "b.jsonl").write_bytes(b'\xef\xbb\xbf{"a":1}\n')
    records, warned, failed = plain(R.read_jsonl(spark, str(tmp_path)))
    assert records == [("a", 0, '{"a":1}'), ("b", 0, '{"a":1}')] and warned == ["a"] and failed == []
    assert plain(R.read_jsonl(spark, str(tmp_path), "*.none")) == ([], [], [])
