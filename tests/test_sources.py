"""Files as sources and sinks: lists, archives, change lists, advisory documents."""

import hashlib
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from riskloom.sources import archives, changes, documents, registries, uploads


def test_uploaded_list(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_bytes("\ufeffPRODUCT_NAME, Version ,usage_text,vendor,install_url\n Foo ,1.0,\"a\nb\",,http://x\n,2,y,v,\nBar,2, z ,  ,\n".encode())
    rows = uploads.read_csv(spark, str(path))
    assert rows.columns == ["PRODUCT_NAME", "Version", "usage_text", "vendor", "install_url"]
    assert not uploads.has_known_header(rows)
    mapping = uploads.guessed_mapping(rows)
    assert mapping == {"product_name": "PRODUCT_NAME", "version": "Version", "usage_text": "usage_text", "vendor": "vendor", "install_url": "install_url"}
    items, problems = uploads.items(rows, mapping)
    assert [tuple(r) for r in items.orderBy("line").collect()] == [(2, "Foo", "1.0", "a\nb", None, "http://x"), (4, "Bar", "2", "z", None, None)]
    assert [tuple(r) for r in problems.collect()] == [(3, ["product_name"])]
    with pytest.raises(ValueError, match="usage_text"):
        uploads.items(rows, mapping | {"usage_text": None})


def test_csv_sink_and_template(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "q", b', None), (2, "日本\nx", "v")], "item int, name string, vendor string")
    uploads.write_csv(rows.orderBy("item"), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    raw = part.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    back = uploads.read_csv(spark, str(part))
    assert sorted(tuple(r) for r in back.collect()) == [("1", 'a "q", b', None), ("2", "日本\nx", "v")]
    (tmp_path / "t.csv").write_text(uploads.template())
    template = uploads.read_csv(spark, str(tmp_path / "t.csv"))
    assert uploads.has_known_header(template) and uploads.items(template)[0].count() == 1


def _zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def _tar(entries, mode):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in entries.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark, tmp_path):
    import zstandard

    docs = {"a/GHSA-1.json": b"{}", "a/PYSEC-2.json": b'{"id": 2}', "MAL-3.json": b"{}", "readme.md": b"x", "big.json": b" " * (archives.LARGEST + 1)}
    files = {"all.zip": _zip(docs), "nested.zip": _zip({"inner.zip": _zip({"n.json": b"1"}), "o.json": b"2"}), "x.tar.gz": _tar(docs, "w:gz"), "y.tar.zst": zstandard.compress(_tar(docs, "w")), "bad.zip": b"PK broken"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    read = lambda name, kind, **o: archives.entries(spark, str(tmp_path / name), kind, **o)
    for name, kind in (("all.zip", "zip"), ("x.tar.gz", "gz"), ("y.tar.zst", "zst")):
        rows = {r["entry"]: (r["size"], r["text"]) for r in read(name, kind).collect()}
        assert rows.keys() == docs.keys() - {"readme.md"} and rows["a/PYSEC-2.json"] == (9, '{"id": 2}') and rows["big.json"] == (archives.LARGEST + 1, None)
    assert {r["entry"] for r in archives.advisory_documents(read("all.zip", "zip")).collect()} == {"a/PYSEC-2.json", "big.json"}
    assert sorted((r["entry"], r["text"]) for r in read("nested.zip", "nested_zip").collect()) == [("n.json", "1"), ("o.json", "2")]
    (bad,) = read("bad.zip", "zip").collect()
    assert bad["error"] and bad["entry"] is None
    sums = spark.createDataFrame([("all.zip", hashlib.sha256(files["all.zip"]).hexdigest().upper()), ("x.tar.gz", "0" * 64)], "archive string, sha256 string")
    assert read("all.zip", "zip", sha256=sums).count() == 4
    assert [r["error"] for r in read("x.tar.gz", "gz", sha256=sums).collect()] == ["digest differs"]


def test_change_lists(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("2024-01-02T00:00:00Z,PyPI/A-1\n2024-01-03T00:00:00Z,PyPI/A-1\n2024-01-01T00:00:00Z,npm/B\n2024-01-05T00:00:00Z,Debian/C\nnever,PyPI/D\n2024-01-05T00:00:00Z,PyPI/..x\n")
    rows = changes.modified_ids(spark, str(tmp_path / "ids.csv"), ["PyPI", "npm"], "2024-01-01T00:00:00Z")
    assert [(r["ts"].day, r["directory"], r["id"]) for r in rows.collect()] == [(3, "PyPI", "A-1")]
    assert changes.modified_ids(spark, str(tmp_path / "ids.csv"), ["PyPI", "npm"]).count() == 2
    (tmp_path / "changes.csv").write_text('"2024/rhsa-2024_9315.json","2024-11-12T09:16:23+00:00"\n"../x.json","2024-11-12T09:16:23+00:00"\n"2024/a_b_c.json","soon"\n')
    assert [(r["path"], r["tracking_id"]) for r in changes.changed_paths(spark, str(tmp_path / "changes.csv")).collect()] == [("2024/rhsa-2024_9315.json", "RHSA-2024:9315")]
    (tmp_path / "feed.json").write_text(json.dumps({"feed": {"entry": [{"id": "x", "content": {"src": "https://h/x.json"}, "updated": "2024-01-02T03:04:05.1Z"}]}}))
    assert [(r["id"], r["url"], r["updated"].hour) for r in changes.feed_entries(spark, str(tmp_path / "feed.json")).collect()] == [("x", "https://h/x.json", 3)]


def frame(spark, docs):
    return spark.createDataFrame([(str(i), json.dumps(d) if d is not None else None) for i, d in enumerate(docs)], "advisory_id string, json string")


def test_catalogue_pages(spark):
    cve = {
        "id": "CVE-1", "published": "2019-10-03T13:15:10.947", "lastModified": "2020-01-01T00:00:00Z", "descriptions": [{"lang": "es", "value": "n"}, {"lang": "en", "value": "d"}],
        "metrics": {"cvssMetricV31": [{"cvssData": {"baseSeverity": "HIGH"}}], "cvssMetricV2": [{"baseSeverity": "LOW", "baseScore": 2.1}]},
        "configurations": [{"nodes": [{"cpeMatch": [{"vulnerable": False, "criteria": "cpe:2.3:o:v:p\\:q:1:*:*:*:*:*:*:*", "versionEndExcluding": "2"}, {"criteria": "junk"}]}]}],
    }
    records, matches = documents.catalogue_records(frame(spark, [{"totalResults": 1, "vulnerabilities": [{"cve": cve}]}, None]))
    (r,) = records.collect()
    assert (r["description"], r["severity"], r["cvss_score"], r["published_at"].year) == ("d", "HIGH", 2.1, 2019)
    (m,) = matches.collect()
    assert (m["part"], m["vendor"], m["product"], m["criteria_version"], m["vulnerable"], m["end_excluding"], m["start_including"]) == ("o", "v", "p\\:q", "1", False, "2", None)


def test_records_of_format_5(spark):
    doc = {"cveMetadata": {"cveId": "CVE-2", "state": "PUBLISHED"}, "containers": {"cna": {"descriptions": [{"lang": "de", "value": "x"}], "metrics": [{"other": 1}, {"cvssV3_1": {"baseScore": 9.8, "baseSeverity": "CRITICAL"}}], "affected": [{"vendor": " ", "versions": []}, {"product": "p", "versions": [{"version": "1", "status": "affected", "lessThan": "2"}]}]}}}
    records, products = documents.records_v5(frame(spark, [doc]))
    (r,) = records.collect()
    assert (r["description"], r["severity"], r["cvss_score"]) == ("x", "CRITICAL", 9.8)
    assert [(p["place"], p["product"]) for p in products.collect()] == [(1, "p")]


def test_advisory_documents(spark):
    doc = {
        "id": "GHSA-aaaa-bbbb-cccc", "modified": "2024-01-02T00:00:00Z", "aliases": ["CVE-9", "CVE-10"], "summary": None, "details": "long", "database_specific": {"severity": "moderate"},
        "affected": [
            {"package": {"ecosystem": "PyPI", "name": "Foo_Bar"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "1.0"}, {"introduced": "2"}, {"introduced": "3"}]}], "versions": ["0.1"]},
            {"package": {"ecosystem": "PyPI", "name": "foo-bar"}, "ranges": [{"type": " ", "events": [{"introduced": "9"}]}, {"type": "GIT", "events": [{"fixed": "x"}, {"introduced": "a"}, {"last_affected": "b"}]}], "versions": ["0.1", "0.2"]},
            {"package": {"ecosystem": "Unknown", "name": "x"}},
        ],
    }
    out = documents.advisories(frame(spark, [doc, {"id": "bad id"}]))
    (head,) = out["advisories"].collect()
    assert (head["cve_id"], head["alias_id"], head["summary"], head["severity"]) == ("CVE-9", None, "long", "MODERATE")
    (package,) = out["packages"].collect()
    assert (package["package_name"], package["name"]) == ("foo-bar", "Foo_Bar")
    assert [(r["range_type"], r["introduced"], r["fixed"], r["last_affected"]) for r in out["ranges"].orderBy("at", "n").collect()] == [("ECOSYSTEM", None, "1.0", None), ("ECOSYSTEM", "3", None, None), ("GIT", "a", None, "b")]
    assert sorted(r["version"] for r in out["versions"].collect()) == ["0.1", "0.2"]


def test_product_tree_and_statuses(spark):
    leaf = lambda i, name="l", **helper: {"product_id": i, "name": name, "product_identification_helper": helper}
    tree = {
        "branches": [
            {"category": "vendor", "name": "V", "branches": [
                {"category": "product_name", "name": "App", "branches": [{"category": "product_version", "name": "1.0", "product": leaf("A1", cpe="c")}, {"category": "architecture", "name": "x", "branches": [{"category": "product_version_range", "name": "<2", "product": leaf("A2")}]}]},
                {"category": "product_name", "name": "OS", "product": leaf("OS")},
                {"category": "product_version", "name": "z", "product": leaf("R", purl="pkg:rpm/redhat/ker%2Bnel@5-1?arch=x")},
                {"category": "product_version", "name": "z", "product": leaf("D", purl="pkg:rpm/redhat/kernel-debuginfo@5")},
            ]},
        ],
        "relationships": [{"product_reference": "R", "relates_to_product_reference": "OS", "full_product_name": {"product_id": "OS:R"}}, {"product_reference": "none", "full_product_name": {"product_id": "X"}}, {"product_reference": "R", "relates_to_product_reference": "OS", "full_product_name": {"product_id": "OS:R2"}}],
    }
    doc = {"product_tree": tree, "vulnerabilities": [{"cve": "CVE-1", "product_status": {"fixed": ["OS:R", "OS:R2", "A1"], "known_affected": ["A2", "gone"]}, "scores": [{"cvss_v3": {"baseScore": 5.0, "baseSeverity": "MEDIUM"}}, {}, {"cvss_v3": {"baseScore": 7.0, "baseSeverity": "HIGH"}}]}, {"product_status": {"fixed": ["A1"]}}]}
    docs = frame(spark, [doc, None, {"product_tree": {}}])
    products = documents.product_trees(docs).persist()
    got = {r["product_id"]: (r["component"], r["version"], r["platform"], r["canonical"]) for r in products.collect()}
    assert got == {"A1": ("App", "1.0", None, "A1"), "A2": ("App", "<2", None, "A2"), "OS": ("OS", None, None, "OS"), "R": ("ker+nel", "5-1", None, "R"), "OS:R": ("ker+nel", "5-1", "OS", "OS:R"), "OS:R2": ("ker+nel", "5-1", "OS", "OS:R")}
    statuses, referenced = documents.product_statuses(docs, products)
    assert sorted((r["canonical"], r["status"], r["score"], r["severity"]) for r in statuses.collect()) == [("A1", "fixed", 7.0, "HIGH"), ("A2", "known_affected", 7.0, "HIGH"), ("OS:R", "fixed", 7.0, "HIGH")]
    assert sorted(r["product_id"] for r in referenced.collect()) == ["A1", "A2", "OS:R"]


def test_registry_bodies(spark):
    xml = "<metadata><versioning><versions><version>1</version><version>2</version></versions></versioning></metadata>"
    row = spark.createDataFrame([(xml, "<!DOCTYPE x>" + xml, "v1\n\n v2 \n", '{"versions": {"1.0": {}, "b": 1}}')], "a string, b string, c string, d string")
    got = row.select(registries.versions_of_metadata(F.col("a")), registries.versions_of_metadata(F.col("b")), registries.versions_of_lines(F.col("c")), registries.versions_of_keys(F.col("d"), "versions"), registries.versions_of_keys(F.col("d"), "none")).first()
    assert list(got) == [["1", "2"], [], ["v1", "v2"], ["1.0", "b"], []]


def test_a_tree_in_pieces_is_one_document(spark):
    leaf = lambda i, n: {"category": "product_name", "name": n, "product": {"product_id": i, "name": n}}
    pieces = [("a", 1, json.dumps({"product_tree": {"branches": [leaf("OS", "Linux"), leaf("P1", "x")]}})), ("a", 2, json.dumps({"product_tree": {"branches": [leaf("OS", "Linux"), leaf("P2", "x"), leaf("P3", "y")]}}))]
    got = documents.product_trees(spark.createDataFrame(pieces, "advisory_id string, n int, json string"), piece_col="n")
    assert sorted(tuple(r) for r in got.select("product_id", "component", "canonical").collect()) == [("OS", "Linux", "OS"), ("P1", "x", "P1"), ("P2", "x", "P1"), ("P3", "y", "P3")]
