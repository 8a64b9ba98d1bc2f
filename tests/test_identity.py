"""The branches of the identity merge, one item each."""

from riskloom.operators import identify

ITEMS = "item string, vendor string, declared string, selected int, selected_confidence double"
REGISTRY = "item string, ecosystem string, package_name string, confirmed boolean, confidence double, verdict string, verdict_confidence double"
POOL = "item string, rn int, cpe string, vendor string, product string, title string, targets array<string>, relaxed boolean"


def candidate(item, rn, product, targets=("*",), relaxed=False, vendor="acme"):
    return (item, rn, f"{vendor}:{product}", vendor, product, "", list(targets), relaxed)


def merged(spark, items, registry=(), pool=(), rescue=None):
    items = [(*i, *[None] * (5 - len(i))) for i in items]
    registry = [(*r, *[None] * (7 - len(r))) for r in registry]
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = identify.merged_identity(df(items, ITEMS), df(registry, REGISTRY), df(pool, POOL), None if rescue is None else df(rescue, POOL))
    return {r["item"]: (r["package_name"], r["cpe"], r["confidence"], r["method"], r["n_candidates"]) for r in out.collect()}


def npm(item, name, confirmed, *verdict):
    return (item, "npm", name, confirmed, 0.95 if confirmed else 0.5, *verdict)


def test_branches(spark):
    items = [("none",), ("both",), ("unconfirmed",), ("gate",), ("gate_stays", None, "node.js"), ("gate_empty",), ("alone",), ("alone_vendor", "acme"), ("blank_vendor", "  "), ("confirmed_vendor", "acme"), ("stranger",), ("relaxed",), ("only",), ("no_package",)]
    registry = [npm("both", "putty", True), npm("unconfirmed", "slack", False), npm("gate", "slack", False), npm("gate_stays", "slack", False), npm("gate_empty", "slack", False)]
    registry += [npm("alone", "gson", False), npm("alone_vendor", "slack", False), npm("blank_vendor", "gson", False), npm("confirmed_vendor", "gson", True), npm("stranger", "django", True), npm("no_package", None, True)]
    pool = [candidate("both", 1, "putty"), candidate("unconfirmed", 1, "putty"), candidate("gate", 1, "slack", ["rust"]), candidate("gate", 2, "web", ["node.js"]), candidate("gate", 3, "openssl"), candidate("gate_stays", 1, "slack", ["node.js"])]
    pool += [candidate("gate_empty", 1, "slack", ["rust"]), candidate("stranger", 1, "crayon"), candidate("relaxed", 1, "x", relaxed=True), candidate("relaxed", 2, "y", relaxed=True), candidate("only", 1, "x"), candidate("no_package", 1, "x")]
    assert merged(spark, items, registry, pool) == {
        "none": (None, None, None, "none", None),
        "both": ("putty", "acme:putty", 0.95, "registry+catalogue", 1),
        "unconfirmed": (None, "acme:putty", 0.6, "catalogue", 1),  # another product is named: the unconfirmed match goes
        "gate": (None, "acme:openssl", 0.6, "catalogue", 3),  # the first one only passed by the match's ecosystem
        "gate_stays": (None, "acme:slack", 0.6, "catalogue", 1),
        "gate_empty": (None, None, None, "none", None),
        "alone": ("gson", None, 0.5, "registry", None),
        "alone_vendor": (None, None, None, "none", None),
        "blank_vendor": ("gson", None, 0.5, "registry", None),
        "confirmed_vendor": ("gson", None, 0.95, "registry", None),
        "stranger": ("django", None, 0.95, "registry", None),  # the candidate does not explain the package
        "relaxed": (None, None, None, "none", None),
        "only": (None, "acme:x", 0.6, "catalogue", 1),
        "no_package": (None, "acme:x", 0.95, "registry+catalogue", 1),
    }


def test_verdicts_and_rescue(spark):
    items = [("second", None, None, 2, 0.8), ("refused", None, None, 0, 0.9), ("invalid", None, None, 7, 0.9), ("relaxed", None, None, 1, 0.7), ("refused_registry", None, None, 0, 0.9), ("matched",), ("rejected",), ("saved", "acme"), ("not_saved",)]
    registry = [npm("refused_registry", "a", True), npm("matched", "gson", True, "matched", 0.7), npm("rejected", "redis", True, "rejected", 0.9), npm("saved", "slack", False), npm("not_saved", "slack", False)]
    pool = [candidate(i, k, f"p{k}") for i in ("second", "refused", "invalid", "refused_registry") for k in (1, 2)] + [candidate("relaxed", 1, "p1", relaxed=True)]
    rescue = [candidate(i, k, f"r{k}") for i in ("saved", "not_saved", "rejected") for k in (2, 1)]
    assert merged(spark, items, registry, pool, rescue) == {
        "second": (None, "acme:p2", 0.8, "arbitrated", 2),
        "refused": (None, None, None, "none", None),
        "invalid": (None, "acme:p1", 0.6, "catalogue", 2),
        "relaxed": (None, "acme:p1", 0.7, "arbitrated", 1),
        "refused_registry": ("a", None, 0.95, "arbitrated", None),
        "matched": ("gson", None, 0.7, "arbitrated", None),
        "rejected": (None, "acme:r1", 0.6, "catalogue", 1),
        "saved": (None, "acme:r1", 0.6, "catalogue", 1),
        "not_saved": ("slack", None, 0.5, "registry", None),
    }


def test_empty(spark):
    assert merged(spark, []) == {}
