"""JSON documents that are cut into splits anywhere, and files of any size."""

import hashlib
import json
import random

import pytest

from veriscreen.sources import documents, files, storage

ODD = ["plain", 'quote " and \\ back', "brace } and { and ]", '"}', "\\", "", "é日本", "a}b}c", '\\"}{', "line\nfeed", "}" * 40]


def document(seed, n, indent=None):
    rng = random.Random(seed)
    make = lambda: {"pmid": str(rng.randrange(10**6)), "label": rng.randrange(2), "split": rng.choice(ODD), "n_chunks": rng.randrange(9), "deep": [{"x": rng.choice(ODD)}, [1, {"y": {}}]], "o": {"}": rng.choice(ODD)}}
    own = {"seed": 42, "a}b": "x}y", "ratios": [0.8, 0.1], "summary": {"test": {"n": 1}}, "articles": [make() for _ in range(n)], "other": [{"pmid": "no"}], "last": None}
    return own, json.dumps(own, ensure_ascii=seed % 2 == 0, indent=indent)


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, str(n)) for k in old]
    for k, v in old.items():
        spark.conf.set(k, v)


SCHEMA = "pmid string, label int, split string, n_chunks long"


@pytest.mark.parametrize("seed, size, indent, end", [(1, 97, None, ""), (2, 401, 2, "\n"), (3, 41, None, "\n\n"), (4, 1 << 20, 1, "")])
def test_elements_of_a_document_in_many_splits(spark, tmp_path, small_splits, seed, size, indent, end):
    own, text = document(seed, 8, indent)
    (tmp_path / "d.json").write_text(text + end, encoding="utf-8")
    small_splits(size)
    rows, outlines = documents.array(spark, str(tmp_path / "d.json"), "articles", SCHEMA)
    assert sorted((r.pmid, r.label, r.split, r.n_chunks) for r in rows.collect()) == sorted((a["pmid"], a["label"], a["split"], a["n_chunks"]) for a in own["articles"])
    (outline,) = outlines.values()
    assert outline["seed"] == 42 and outline["a}b"] == "x}y" and outline["last"] is None and outline["articles"] == []
    other, _ = documents.array(spark, str(tmp_path / "d.json"), "other", "pmid string")
    assert [r.pmid for r in other.collect()] == ["no"]
    if size < 400:
        assert rows.sparkSession.read.text(str(tmp_path / "d.json"), lineSep="}").rdd.getNumPartitions() > 5


@pytest.mark.parametrize("text", ['{"articles": [{"pmid": "1"}', '{"articles": [{"pmid": "1}]}', "[]", "", '{"other": []}', '{"articles": 5}', '{"articles": [{"pmid": 1, }]}'])
def test_what_is_no_document_is_refused(spark, tmp_path, text):
    (tmp_path / "d.json").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        rows, outlines = documents.array(spark, str(tmp_path / "d.json"), "articles", "pmid string")
        assert outlines and rows.collect()


def test_documents_are_written_in_order_and_read_again(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), ODD[k % len(ODD)], None) for k in range(500)], "pmid string, split string, note string").repartition(7)
    documents.write(str(tmp_path / "d.json"), {"seed": 1, "name": "é}"}, {"articles": (rows, ["pmid"]), "ids": (rows.limit(3).selectExpr("split as value"), ["value"])})
    found = json.loads((tmp_path / "d.json").read_text(encoding="utf-8"))
    assert found["seed"] == 1 and [a["pmid"] for a in found["articles"]] == sorted(str(k) for k in range(500)) and found["articles"][0].keys() == {"pmid", "split", "note"}
    assert len(found["ids"]) == 3 and set(found["ids"]) <= set(ODD)
    again, _ = documents.array(spark, str(tmp_path / "d.json"), "articles", "pmid string, split string")
    assert sorted(map(tuple, again.drop('path').collect())) == sorted((a["pmid"], a["split"]) for a in found["articles"])
    with pytest.raises(FileExistsError):
        documents.write(str(tmp_path / "d.json"), {}, {"articles": (rows, ["pmid"])})
    documents.write(str(tmp_path / "e.json"), {}, {"articles": (rows.where("false"), ["pmid"]), "b": (rows.where("false"), ["pmid"])})
    assert json.loads((tmp_path / "e.json").read_text()) == {"articles": [], "b": []}


CONTENTS = [b"\n", b"a", b"a\n", b"a\r\nb\r\n", b"\n\n\nx", b"\xff\xfe\x00\n\x80", b"\xef\xbb\xbfbom\n", b"\xef\xbb\xbf", b"\xef\xbb\xbf\n", "é 日\u2028本\n".encode() * 60]


def test_fingerprints_of_files_in_many_splits(spark, tmp_path, small_splits):
    for k, raw in enumerate(CONTENTS):
        (tmp_path / f"f {k}").write_bytes(raw)
    small_splits(64)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.fingerprints(spark, [str(tmp_path)]).collect()}
    assert len(got) == len(CONTENTS)
    for k, raw in enumerate(CONTENTS):
        r = got[f"f {k}"]
        assert (r.size, r.sha256, r.git_sha1) == (len(raw), hashlib.sha256(raw).hexdigest(), hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest())


def test_fingerprints_do_not_read_files_as_cells(spark, tmp_path):
    import gzip

    (tmp_path / "x.gz").write_bytes(gzip.compress(b"packed\n"))
    (tmp_path / "y").write_bytes(b"1\n2")
    raw = (tmp_path / "x.gz").read_bytes()
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in files.fingerprints(spark, [str(tmp_path / "x.gz"), str(tmp_path / "y")]).collect()}
    assert got == {"x.gz": hashlib.sha256(raw).hexdigest(), "y": hashlib.sha256(b"1\n2").hexdigest()}
    assert files._cells(spark, [str(tmp_path)]).inputFiles() == [f"file://{tmp_path}/x.gz"] and files._cells(spark, [str(tmp_path / "y")]).collect() == []


def test_files_are_new_and_whole(spark, tmp_path):
    with_scheme = f"file://{tmp_path}/out"
    out = storage.new_dir(with_scheme)
    storage.write(f"{out}/a.txt", "é\n".encode())
    assert (tmp_path / "out/a.txt").read_text(encoding="utf-8") == "é\n" and storage.read(f"{out}/a.txt") == "é\n".encode() and storage.names(out) == ["a.txt"]
    with pytest.raises(FileExistsError):
        storage.write(f"{out}/a.txt", b"")
    with pytest.raises(FileExistsError):
        storage.new_dir(with_scheme)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.txt"]
    assert storage.qualified(with_scheme) == storage.qualified(str(tmp_path / "out")) and storage.missing([out, f"{out}/b"]) == [f"{out}/b"]
