"""The corpus pipeline stage by stage: each stage's decisions against a plain count of what it was given."""

import corpus_pipeline
from riskloom.llm import base
from riskloom.llm.queries import read

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    seen = [{r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = base.stored(stage(spark, docs, SF), "test_" + name.replace(" ", "_"))
        assert docs.columns == columns
        rows = docs.select("doc_id", "text").collect()
        seen.append({r["doc_id"]: r["text"] for r in rows})
        assert len(rows) == len(seen[-1])
    given, rated, near, cut, masked = seen
    assert rated.items() <= given.items() and near.items() <= rated.items()
    labels = {r["doc_id"]: r["quality"] for r in read(spark, SF, "labels").collect()}
    good = [i for i in given if labels.get(i) == 1]
    assert sum(i in rated for i in good) >= 0.9 * len(good)
    # Exact copies that came to the second stage: exactly one of each stays.
    plain = lambda t: " ".join((t or "").lower().split())
    for text in {plain(t) for t in rated.values()} - {""}:
        assert sum(plain(t) == text for t in near.values()) <= 1
    # Cutting only takes words away, in order; masking leaves every document.
    for i, t in cut.items():
        words = iter((near[i] or "").split())
        assert all(w in words for w in (t or "").split())
    assert cut.keys() == near.keys() == masked.keys()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    length, ends = dict.fromkeys(masked, 0), {}
    for r in pieces:
        length[r["doc_id"]] += r["length"]
        ends[r["doc_id"]] = r["doc_tokens"]
    assert length == ends


def test_repeated_rows_and_null_ids(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    given = [(1, text(1)), (1, text(1)), (None, text(2)), (5, text(2)), (4, text(2)), (None, text(3)), (None, text(3)), (6, text(4)), (7, ""), (7, ""), (None, None)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    near = base.stored(corpus_pipeline.near_duplicates(spark, docs, SF), "test_near")
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    want = sorted([(1, text(1)), (4, text(2)), (None, text(3)), (6, text(4)), (7, ""), (7, ""), (None, None)], key=key)
    assert sorted((tuple(r) for r in near.collect()), key=key) == want
    assert sorted((tuple(r) for r in corpus_pipeline.substrings(spark, near, SF).collect()), key=key) == want


def test_columns_of_any_name_pass_through(spark):
    docs = read(spark, SF, "documents")
    names = ["score", "spans", "found", "__text", "__id", "__h", "h", "row", "n", "id", "bands", "a.b", "stays", "kind"]
    wide = docs.select("*", *(docs.doc_id.alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        plain = {r["doc_id"]: r["text"] for r in stage(spark, docs, SF).collect()}
        assert {r["doc_id"]: r["text"] for r in out.collect()} == plain, name
        assert all(r["a.b"] == r["doc_id"] == r["score"] for r in out.collect())
    assert corpus_pipeline.pack(spark, wide, SF).count() == corpus_pipeline.pack(spark, docs, SF).count()


def test_empty_and_null(spark):
    empty = read(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
    docs = spark.createDataFrame([(None, None), (1, None), (2, "")], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SF).count() == 3, name


def test_intermediate_tables_go(spark):
    import glob

    folder = base.shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/riskloom/*"))
    settings = {k: spark.conf.get(k, None) for k in (base.ROWS, base.BYTES, base.CLEANUP)}
    corpus_pipeline.run(spark, SF)
    assert {k: spark.conf.get(k, None) for k in settings} == settings
    assert [x.rsplit("/", 1)[1].split("-")[0] for x in set(glob.glob(f"{folder}/riskloom/*")) - before] == ["pipeline"]
