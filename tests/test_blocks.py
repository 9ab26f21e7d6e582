"""CSV files with quoted newlines in blocks, against the unsplit reader and Python's own."""

import csv
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from gavel.sources import blocks as B
from gavel.sources import readers as R


def table_text(rng, rows, end="\n"):
    pieces = ["a", "b c", "日本", "🙂", '"', '""', "\n", "\n\n", "\r\n", ",", "", '",\n"', "x" * 30]
    made, out = [], io.StringIO(newline="")
    for i in range(rows):
        made.append([str(i), *("".join(rng.choice(pieces) for _ in range(rng.randrange(4))) for _ in range(2))])
    writer = csv.writer(out, lineterminator=end, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    writer.writerows([["id", "te\nxt", "other"], *made])
    return out.getvalue(), made


@pytest.mark.parametrize("block", [4, 5, 6, 7, 11, 64, 1000, 1 << 20])
def test_blocks_find_every_record_once(tmp_path, block):
    """Of every block size, down to a few bytes: counts and bytes of the records, whatever lies at a boundary."""
    rng = random.Random(block)
    for case in range(40):
        text, made = table_text(rng, rng.randrange(0, 12), rng.choice(["\n", "\r\n"]))
        gaps = rng.choice(["", "\n\n", "\r\n"])
        data = rng.choice([b"", B.BOM]) + (gaps + text + gaps).encode()
        data = data.rstrip(b"\r\n") if rng.random() < 0.3 else data
        path = tmp_path / f"{case}.csv"
        path.write_bytes(data)
        parity, found, records = 0, 0, b""
        for number in range(-(-len(data) // block)):
            own = B.Block(str(path), len(data), number, block)
            quotes, even, odd = own.count()
            first, rest = own.records(parity)
            assert bool(first) == bool((even, odd)[parity])
            found, records = found + (even, odd)[parity], records + first + rest
            parity = (parity + quotes) % 2
        assert parity == 0 and found == len(made) + 1
        got = list(csv.reader(io.StringIO(records.decode(), newline="")))
        assert [r for r in got if r] == [["id", "te\nxt", "other"], *made]


def test_one_file_in_many_tasks(spark, tmp_path):
    text, made = table_text(random.Random(1), 400)
    path = tmp_path / "a.csv"
    path.write_bytes(B.BOM + text.encode())
    df = B.read_csv_blocks(spark, str(path), block=512)
    got = df.withColumn("task", F.spark_partition_id()).orderBy("row_index").collect()
    assert df.columns == ["id", "te\nxt", "other", "row_index"] and len({r.task for r in got}) > 10
    assert [[r[0], r[1] or "", r[2] or ""] for r in got] == made and [r.row_index for r in got] == list(range(400))
    # The same rows as the unsplit reader's, with its distinction of empty and missing.
    whole = R.read_csv(spark, str(path))
    assert df.drop("row_index").exceptAll(whole.toDF(*df.columns[:3])).count() == 0 and whole.count() == 400


def test_many_files_folders_and_separators(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-{i}.tsv").write_text("k\tK\t\n" + "".join(f'{i}\t"{j}\n"\t""\n' for j in range(i * 2)))
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / ".part.crc").write_text("x")
    (tmp_path / "empty.tsv").write_text("")
    for path in (str(tmp_path), f"{tmp_path}/*.tsv"):
        got = sorted(tuple(r) for r in B.read_csv_blocks(spark, path, "\t", block=5).collect())
        assert got == sorted((f"{i}", f"{j}\n", "", [0, 0, 2][i] + j) for i in range(3) for j in range(i * 2))
    assert B.read_csv_blocks(spark, str(tmp_path), "\t").columns == ["k0", "K1", "_c2", "row_index"]


@pytest.mark.parametrize("bad", ['a,b\n1,"2\n', 'a,b\n1,5" disk\n2,6" disk\n', "a,b\n1,2,3\n", "a,b\n1\n"])
def test_broken_files_fail(spark, tmp_path, bad):
    path = tmp_path / "a.csv"
    path.write_text(bad)
    with pytest.raises(Exception, match="quotes|olumns|CSV"):
        B.read_csv_blocks(spark, str(path)).collect()


def test_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="another header"):
        B.read_csv_blocks(spark, str(tmp_path)).collect()
    with pytest.raises(FileNotFoundError):
        B.read_csv_blocks(spark, f"{tmp_path}/none.csv")
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "a.csv").write_text("a,b")
    got = B.read_csv_blocks(spark, f"{tmp_path}/only")
    assert got.columns == ["a", "b", "row_index"] and got.count() == 0


def test_compressed_files_are_read_unsplit(spark, tmp_path):
    spark.createDataFrame([("1", "x\ny")], "a string, b string").write.csv(
        str(tmp_path / "z"), header=True, compression="gzip", quoteAll=True, escape='"'
    )
    assert not B.splittable(spark, str(tmp_path / "z"))
    assert [tuple(r) for r in R.read_source(spark, "csv", str(tmp_path / "z")).collect()] == [("1", "x\ny", 0)]


def test_zip_members_are_tasks_and_read_once(spark, tmp_path):
    for name in ("b", "a"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as bundle:
            for subject in ("law", "art", "math"):
                bundle.writestr(f"x/test/{subject}.csv", "question,answer\n" + "".join(f'"{name}\n{subject}{i}",A\n' for i in range(5)))
    df = R.read_subject_zip(spark, str(tmp_path / "*.zip"), "question STRING, answer STRING")
    rows = df.orderBy("row_index").collect()
    want = [(f"{name}\n{subject}{i}", "A", subject, at * 5 + i) for at, (name, subject) in enumerate(
        (n, s) for n in ("a", "b") for s in ("art", "law", "math")) for i in range(5)]
    assert [tuple(r) for r in rows] == want
    assert "MapInPandas" not in df._jdf.queryExecution().executedPlan().toString()  # the rows are stored, not unzipped again


def test_small_pieces_share_tasks(spark, tmp_path):
    """Many small blocks or members are dealt to a bounded number of tasks, large ones have one each."""
    tasks = lambda *of: B.blocks_of(spark, *of).rdd.getNumPartitions()
    assert tasks(5000, 1 << 16) == B.SPREAD and tasks(5000) == 5000 and tasks(7, 10) == 7
    assert tasks(50_000, 1 << 20) == -(-50_000 >> 5)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as bundle:
        for i in range(300):
            bundle.writestr(f"x/test/{i:03}.csv", f"question\n{i}\n{i}b\n")
    df = R.read_subject_zip(spark, str(tmp_path / "*.zip"), "question STRING")
    assert [r.question for r in df.orderBy("row_index").collect()] == [f"{i}{e}" for i in range(300) for e in ("", "b")]
