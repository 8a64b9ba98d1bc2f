"""Loads that end and go on: failures counted by a stream, budgets of a run, landed pages, bounds of archives, digests."""

import hashlib
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.sources import archives, pages
from riskloom.streaming import cursors

RESULTS = "feed string, document string, ts timestamp, ok boolean"


def put(spark, folder, rows):
    df = spark.createDataFrame([(f, d, n, ok) for f, d, n, ok in rows], "feed string, document string, n int, ok boolean")
    df.select("feed", "document", F.timestamp_seconds(F.lit(1700000000) + F.col("n")).alias("ts"), "ok").coalesce(1).write.mode("append").parquet(folder)


def test_failures_survive_a_restart(spark, tmp_path):
    source, kept = str(tmp_path / "in"), {}

    def run():
        stream = cursors.letters_stream(spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).parquet(source))
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: kept.update({(r["feed"], r["document"]): (r["failures"], r["dead"]) for r in df.collect()}))
        query.option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()

    put(spark, source, [("a", "x", 1, False), ("a", "x", 2, False), ("a", "y", 1, False), ("b", "x", 3, True), ("a", "z", 2, False), ("a", "z", 1, True)])
    run()
    assert kept == {("a", "x"): (2, False), ("a", "y"): (1, False), ("b", "x"): (0, False), ("a", "z"): (1, False)}
    put(spark, source, [("a", "x", 5, False), ("a", "y", 6, True), ("b", "x", 7, None)])
    run()  # another query from the same checkpoint
    assert kept[("a", "x")] == (3, True) and kept[("a", "y")] == (0, False) and kept[("b", "x")] == (1, False)
    put(spark, source, [("a", "y", 8, False), ("a", "x", 9, True)])
    run()
    assert kept[("a", "y")] == (1, False) and kept[("a", "x")] == (0, False)
    letters = spark.createDataFrame([("a", "x", 3, True), ("a", "y", 1, False), ("b", "z", 0, None)], "feed string, document string, failures int, dead boolean")
    assert sorted(tuple(r) for r in cursors.letter_counts(letters, "feed").collect()) == [("a", 2, 1), ("b", 0, 0)]


def test_two_runs_do_what_one_does(spark, tmp_path):
    source = str(tmp_path / "in")
    for n in range(5):
        put(spark, source, [("a", f"d{n}", n, True)])
    stream = lambda: spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).parquet(source)

    def run(mark, batches, seconds=None):
        got = []
        over = cursors.run_within(stream(), lambda df, n: got.append((n, [r["document"] for r in df.collect()])), str(tmp_path / mark), batches, seconds)
        return over, got

    assert run("late", 9, -1.0) == (False, [])
    whole, first, second, third = run("one", 99), run("two", 2), run("two", 2), run("two", 2)
    assert whole[0] and not first[0] and not second[0] and third[0]
    assert first[1] + second[1] + third[1] == whole[1] and sorted(d for _, x in whole[1] for d in x) == [f"d{n}" for n in range(5)]
    with pytest.raises(Exception, match="division"):
        cursors.run_within(stream(), lambda df, n: 1 // 0, str(tmp_path / "bad"), 9)


def test_pages(spark, tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()
    page = lambda total, start, ids: json.dumps({"totalResults": total, "startIndex": start, "items": [{"id": i} for i in ids]})
    (folder / "2024-01_0.json").write_text(page(5, 0, [1, 2]))
    (folder / "2024-01_2.json").write_text(page(5, 2, [3, 4]))
    (folder / "2024-01_4.json").write_text(page(5, 4, [5]))
    (folder / "2024-05_0.json").write_text(page(4, 0, [6, 7]))  # its second page is missing
    (folder / "2024-09_0.json").write_text('{"totalResults": 2, "start')
    (folder / "2025-01_0.json").write_text(page(0, 0, []))
    (folder / "note.txt").write_text("no page")
    rows = pages.pages(spark, str(folder), "items")
    known = lambda df: sorted((r["window"], r["place"], json.loads(r["record"])["id"]) for r in df.collect())
    want = [("2024-01", i, i + 1) for i in range(5)] + [("2024-05", 0, 6), ("2024-05", 1, 7)]
    assert known(pages.page_records(rows)) == want
    assert sorted(tuple(r) for r in pages.completeness(rows).collect()) == [("2024-01", 5, 5, 0, True), ("2024-05", 4, 2, 0, False), ("2024-09", None, 0, 1, False), ("2025-01", 0, 0, 0, True)]
    got, sizes = [], []
    stream = pages.page_records(pages.pages(spark, str(folder), "items", stream=True, at_once=2))
    cursors.run_over(stream, lambda df, n: (got.extend(known(df)), sizes.append(n)), str(tmp_path / "mark"))
    assert sorted(got) == want and len(sizes) == 3


def tar(path, files, kind):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz" if kind == "gz" else "w") as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    data = raw.getvalue()
    if kind == "zst":
        import zstandard

        data = zstandard.ZstdCompressor().compress(data)
    path.write_bytes(data)


@pytest.mark.parametrize("kind", ["gz", "zst"])
def test_bounds_of_archives(spark, tmp_path, kind):
    files = [(f"d/{i}.json", b"{}" * 600) for i in range(10)]
    tar(tmp_path / f"a.tar.{kind}", files, kind)
    read = lambda **options: archives.entries(spark, str(tmp_path), kind, **options).collect()
    assert len(read()) == 10 and all(r["error"] is None for r in read())
    few = read(most_entries=4)
    assert [r["error"] for r in few] == [None] * 4 + ["more entries than allowed"]
    small = read(most_bytes=5000)
    assert small[-1]["error"] == "more bytes than allowed" and 0 < len(small) < 6
    (tmp_path / f"a.tar.{kind}").write_bytes((tmp_path / f"a.tar.{kind}").read_bytes()[:60])
    assert read()[-1]["error"]


def test_bounds_of_zips(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(6):
            z.writestr(f"{i}.json", "x" * 1000)
    got = archives.entries(spark, str(tmp_path), "zip", most_bytes=3500).collect()
    assert [r["error"] for r in got] == [None] * 3 + ["more bytes than allowed"]


def test_sidecars(spark):
    digest = lambda t, kind="sha256": hashlib.new(kind, t.encode()).hexdigest()
    docs = spark.createDataFrame([("a.json", "one"), ("b.json", "two"), ("c.json", "three"), ("d.json", "four"), ("e.json", None)], "name string, text string")
    sides = spark.createDataFrame([("a.json.sha256", f"{digest('one').upper()}  a.json\n"), ("b.json.sha256", digest("one")), ("d.json.sha256", digest("no")), ("d.json.sha512", digest("four", "sha512")), ("e.json.sha256", "zz"), ("x.txt", "1")], "name string, text string")
    got = {r["name"]: r["error"] for r in archives.verified(docs, sides).collect()}
    assert got == {"a.json": None, "b.json": "digest differs", "c.json": "no digest", "d.json": None, "e.json": "digest differs"}


def test_texts_of_logs_and_cuts(spark):
    texts = ["abc", "a😀b", "😀😀", "a\nb\x1b[0m\x7f", None, "", "ab😀"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [tuple(r) for r in df.orderBy("i").select(*(text.cut_text(F.col("t"), n).alias(f"c{n}") for n in (1, 2, 3)), text.one_line(F.col("t")).alias("l")).collect()]
    cut = lambda t, n: None if t is None else t.encode("utf-16-le")[: 2 * n].decode("utf-16-le", errors="ignore")
    assert got == [(*(cut(t, n) for n in (1, 2, 3)), None if t is None else "".join(c for c in t if c >= " " and c != "\x7f")) for t in texts]
