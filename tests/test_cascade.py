"""The fallback cascade: an item for each stage, and that a stage sees only what earlier ones left."""

from riskloom.operators import cascade

ITEMS = "item int, name string, vendor string, version string, declared string, ecosystem string"
ROWS = "id long, vendor string, product string, title string, cpe string"


def row(i, vendor, product, title, target="*", version="1.0"):
    return (i, vendor, product, title, f"cpe:2.3:a:{vendor}:{product}:{version}:*:*:*:*:{target}:*:*")


def test_each_stage_sees_only_the_rest(spark, monkeypatch):
    seen = {}
    for name, module in (("pair_search", cascade.fuzzy), ("fewer_words", cascade), ("_variants", cascade)):
        old = getattr(module, name)
        monkeypatch.setattr(module, name, lambda rows, *rest, old=old, name=name: (seen.__setitem__(name, sorted(r["item"] for r in rows.collect())), old(rows, *rest))[1])
    catalogue = [row(1, "acme", "rocket_launcher", "Acme Rocket Launcher 1.0"), row(2, "acme", "rocket_launcher", "Acme Rocket Launcher 2.0", version="2.0"), row(3, "zed", "q", "Something else"), row(4, "lib", "parser", "Lib Parser", "node.js")]
    catalogue += [row(5, "consortium", "gnuimp", "Consortium gnuimp"), row(6, "fasterxml", "jackson-databind", "FasterXML jackson-databind")]
    further = [row(10, "umbra", "night_owl", "Umbra Night Owl"), row(11, "umbra", "night_owl_pro", "Umbra Night Owl Pro"), row(12, "acme", "rocket_launcher", "Acme Rocket Launcher 3.0")]
    items = [
        (1, "Rocket Launcher", "Acme", "1.0", None, None),  # similar
        (2, "q suite of many long words", "Zed", "1.0", None, None),  # a pair of words, in a name that is not similar
        (3, "Night Owl Deluxe Edition", "Umbra", "1.0", None, None),  # found with two words fewer
        (4, "parser", "Lib", "1.0", None, "npm"),  # the registry's ecosystem opens the gate
        (5, "parser", "Lib", "1.0", None, None),  # nothing opens it
        (6, "com.fasterxml.jackson.core:jackson-databind", None, "1.0", None, None),
        (7, "Unheard Of", "Nobody", "1.0", None, "npm"),
        (8, "Great New Utility In Many Parts", None, "1.0", None, None),  # its initials
        (9, "", None, "1.0", None, None),
    ]
    got = cascade.cascade(spark.createDataFrame(items, ITEMS), spark.createDataFrame(catalogue, ROWS), spark.createDataFrame(further, ROWS)).collect()
    assert sorted((r["item"], r["stage"], r["id"], r["relaxed"]) for r in got) == [(1, 0, 1, False), (2, 1, 3, True), (3, 2, 10, False), (4, 0, 4, False), (6, 0, 6, False), (8, 3, 5, True)]
    # Settled by similar names: 1, 6; a registry match ends the cascade for 4 and 7; by a pair of words: 2; by fewer words: 3.
    assert seen == {"pair_search": [2, 3, 5, 8, 9], "fewer_words": [3, 5, 8, 9], "_variants": [5, 8, 9]}


def test_fewer_words_and_keywords(spark):
    items = spark.createDataFrame([(1, "Night Owl Deluxe Edition", "Umbra", "1", None, None), (2, "one", " ", "1", None, None), (3, "a b", None, "1", None, None), (4, " ", None, "1", None, None)], ITEMS)
    queries = cascade.fewer_words(items)
    assert sorted((r["item"], r["attempt"], r["query"]) for r in queries.collect()) == [(1, 0, "Umbra Night Owl Deluxe Edition"), (1, 1, "Umbra Night Owl Deluxe"), (1, 2, "Umbra Night Owl"), (2, 0, "one"), (3, 0, "a b"), (3, 1, "a")]
    further = [row(i, "umbra", "night_owl", "Umbra the Night Owl") for i in range(30)] + [row(40, "x", "y", "A c"), row(41, "x", "y", "b A"), row(42, "x", "y", None)]
    met = cascade.keyword_rows(queries, spark.createDataFrame(further, ROWS)).collect()
    assert {(r["item"], r["attempt"]) for r in met} == {(1, 2), (3, 0)}
    assert sorted(r["id"] for r in met if r["item"] == 1) == list(range(20)) and [r["id"] for r in met if r["item"] == 3] == [41]


def test_variants_in_order(spark):
    items = spark.createDataFrame([(1, "org.x:data-core-api", None, "1", None, None), (2, "Acme Rocket Launcher", "Acme", "1", None, None), (3, "Very Large Table Engine System", None, "1", None, None)], ITEMS)
    got = [(r["item"], r["place"], r["kind"], r["query"]) for r in cascade.name_variants(items).orderBy("item", "place").collect()]
    assert all(place < 3 for _, place, *_ in got)
    assert [g for g in got if g[0] == 2] == [(2, 0, "bare", "Rocket Launcher"), (2, 1, "expanded", "Acme Rocket Launcher")]
    assert [g[2] for g in got if g[0] == 3] == ["initials", "expanded"] and [g[2] for g in got if g[0] == 1][0] == "artifact"
