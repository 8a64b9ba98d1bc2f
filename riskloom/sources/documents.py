"""Advisory documents in JSON to rows: typed parsing, descriptions, scores, version ranges, product trees."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import cpe, packages, text, times

RECORD_PAGE = """struct<totalResults:int,vulnerabilities:array<struct<cve:struct<id:string,published:string,lastModified:string,
  descriptions:array<struct<lang:string,value:string>>,
  metrics:struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double,baseSeverity:string>>>,
    cvssMetricV30:array<struct<cvssData:struct<baseScore:double,baseSeverity:string>>>,
    cvssMetricV2:array<struct<baseSeverity:string,baseScore:double>>>,
  configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string,versionStartIncluding:string,
    versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>>>>>>>>>>"""
SCORE = "struct<baseScore:double,baseSeverity:string>"
RECORD_V5 = f"""struct<cveMetadata:struct<cveId:string,state:string,datePublished:string,dateUpdated:string>,containers:struct<cna:struct<title:string,
  descriptions:array<struct<lang:string,value:string>>,metrics:array<struct<cvssV4_0:{SCORE},cvssV3_1:{SCORE},cvssV3_0:{SCORE},cvssV2_0:{SCORE}>>,
  affected:array<struct<vendor:string,product:string,packageName:string,versions:array<struct<version:string,status:string,lessThan:string,lessThanOrEqual:string>>>>>>>"""
ADVISORY = """struct<id:string,modified:string,published:string,withdrawn:string,aliases:array<string>,summary:string,details:string,database_specific:struct<severity:string>,
  affected:array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:array<map<string,string>>>>,versions:array<string>>>>"""


def english(descriptions: Column, or_first: bool = False) -> Column:
    """The first English description; the first of all where there is none, if wanted."""
    found = F.try_element_at(F.filter(descriptions, lambda d: d["lang"] == "en"), F.lit(1))["value"]
    return F.coalesce(found, F.when(F.size(F.filter(descriptions, lambda d: d["lang"] == "en")) == 0, F.try_element_at(descriptions, F.lit(1))["value"])) if or_first else found


def _first(metrics: Column, field: str) -> Column:
    return F.try_element_at(metrics[field], F.lit(1))


def severity(metrics: Column) -> Column:
    """The severity of version 3.1, 3.0 or 2, the first that has one."""
    return F.coalesce(_first(metrics, "cvssMetricV31")["cvssData"]["baseSeverity"], _first(metrics, "cvssMetricV30")["cvssData"]["baseSeverity"], _first(metrics, "cvssMetricV2")["baseSeverity"])


def score(metrics: Column) -> Column:
    """The score of version 3.1, 3.0 or 2, the first that has one, whichever gave the severity."""
    return F.coalesce(_first(metrics, "cvssMetricV31")["cvssData"]["baseScore"], _first(metrics, "cvssMetricV30")["cvssData"]["baseScore"], _first(metrics, "cvssMetricV2")["baseScore"])


def catalogue_records(pages: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """(records, matches) of result pages: a record for each vulnerability, a match for each of its catalogue names,
    vulnerable or not. Names that cannot be parsed are left out."""
    rows = pages.select(F.from_json(json_col, RECORD_PAGE).alias("p")).select(F.explode("p.vulnerabilities.cve").alias("c"))
    records = rows.select(
        F.col("c.id").alias("cve_id"), english(F.col("c.descriptions")).alias("description"), severity(F.col("c.metrics")).alias("severity"), score(F.col("c.metrics")).alias("cvss_score"),
        times.lenient(F.col("c.published")).alias("published_at"), times.lenient(F.col("c.lastModified")).alias("last_modified_at"),
    )
    matches = rows.select(F.col("c.id").alias("cve_id"), F.explode("c.configurations").alias("f")).select("cve_id", F.explode("f.nodes").alias("n")).select("cve_id", F.explode("n.cpeMatch").alias("m"))
    name = F.col("m.criteria")
    bounds = [F.col(f"m.version{a}{b}").alias(f"{a.lower()}_{b.lower()}") for a in ("Start", "End") for b in ("Including", "Excluding")]
    matches = matches.select("cve_id", cpe.part(name).alias("part"), cpe.vendor(name).alias("vendor"), cpe.product(name).alias("product"), name.alias("criteria"), cpe.version(name).alias("criteria_version"), F.col("m.vulnerable").alias("vulnerable"), *bounds)
    return records, matches.where("vendor is not null")


def records_v5(docs: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """(records, products) of published records in format 5: the first metric that has any score decides, by the latest
    version of the scoring system."""
    rows = docs.select(F.from_json(json_col, RECORD_V5).alias("d")).where("d.cveMetadata.cveId is not null")
    scores = F.transform("d.containers.cna.metrics", lambda m: F.coalesce(m["cvssV4_0"], m["cvssV3_1"], m["cvssV3_0"], m["cvssV2_0"]))
    first = F.try_element_at(F.filter(scores, lambda s: s.isNotNull()), F.lit(1))
    cna = "d.containers.cna"
    records = rows.select(
        F.col("d.cveMetadata.cveId").alias("cve_id"), F.col("d.cveMetadata.state").alias("state"), F.col(f"{cna}.title").alias("title"), english(F.col(f"{cna}.descriptions"), True).alias("description"),
        first["baseSeverity"].alias("severity"), first["baseScore"].alias("cvss_score"), times.lenient(F.col("d.cveMetadata.datePublished")).alias("published_at"), times.lenient(F.col("d.cveMetadata.dateUpdated")).alias("updated_at"), F.col(f"{cna}.affected").alias("affected"),
    )
    products = rows.select(F.col("d.cveMetadata.cveId").alias("cve_id"), F.posexplode(f"{cna}.affected").alias("place", "a")).select("cve_id", "place", "a.vendor", "a.product", F.col("a.packageName").alias("package_name"), "a.versions")
    some = F.lit(False)
    for c in ("vendor", "product", "package_name"):
        some = some | F.coalesce(F.trim(c) != "", F.lit(False))
    return records, products.where(some)


def first_alias(aliases: Column, prefix: str) -> Column:
    return F.try_element_at(F.filter(aliases, lambda a: a.startswith(prefix)), F.lit(1))


RANGE = "struct<introduced:string,fixed:string,last_affected:string>"


def range_events(events: Column) -> Column:
    """Ranges of a list of events, in order: ``introduced`` opens one ("0": from the beginning) or moves an open one's
    beginning, ``fixed`` and ``last_affected`` close it and do nothing where none is open, other events are passed over;
    what is open at the end has no upper bound."""
    start = F.struct(F.lit(False).alias("open"), F.lit(None).cast("string").alias("low"), F.array().cast(f"array<{RANGE}>").alias("out"))

    def entry(low: Column, fixed: Column, last: Column) -> Column:
        return F.struct(low.alias("introduced"), fixed.cast("string").alias("fixed"), last.cast("string").alias("last_affected"))

    def step(s: Column, e: Column) -> Column:
        none = F.lit(None).cast("string")
        opens, fixes, lasts = (F.map_contains_key(e, k) for k in ("introduced", "fixed", "last_affected"))
        low = F.when(F.try_element_at(e, F.lit("introduced")) != "0", F.try_element_at(e, F.lit("introduced")))
        closed = F.when(fixes, entry(s["low"], F.try_element_at(e, F.lit("fixed")), none)).otherwise(entry(s["low"], none, F.try_element_at(e, F.lit("last_affected"))))
        state = lambda o, lo, out: F.struct(o.alias("open"), lo.alias("low"), out.alias("out"))
        return F.when(opens, state(F.lit(True), low, s["out"])).when((fixes | lasts) & s["open"], state(F.lit(False), none, F.concat(s["out"], F.array(closed)))).otherwise(s)

    def end(s: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.when(s["open"], F.concat(s["out"], F.array(entry(s["low"], none, none)))).otherwise(s["out"])

    return F.aggregate(events, start, step, end)


def advisories(docs: DataFrame, json_col: str = "json") -> dict[str, DataFrame]:
    """Tables advisories, packages, ranges and versions of advisory documents. Entries of one package (by its normalised
    name) are one: ranges one after the other, versions as a set, the first spelling of the name. Unknown ecosystems are
    left out; the severity is in capitals."""
    d = docs.select(F.from_json(json_col, ADVISORY).alias("d")).where(F.col("d.id").rlike(text.OSV_ID))
    heads = d.select(
        F.col("d.id").alias("advisory_id"), first_alias(F.col("d.aliases"), "CVE-").alias("cve_id"), first_alias(F.col("d.aliases"), "GHSA-").alias("alias_id"), F.coalesce("d.summary", F.col("d.details")).alias("summary"),
        F.upper("d.database_specific.severity").alias("severity"), times.strict(F.col("d.published")).alias("published_at"), times.strict(F.col("d.modified")).alias("modified_at"), times.strict(F.col("d.withdrawn")).alias("withdrawn_at"),
    )
    entries = d.select(F.col("d.id").alias("advisory_id"), F.posexplode("d.affected").alias("place", "a"))
    spans = F.transform("a.ranges", lambda r: F.named_struct(F.lit("type"), r["type"], F.lit("spans"), range_events(r["events"]))).alias("ranges")
    entries = entries.select("advisory_id", "place", packages.ecosystem_of_advisory(F.col("a.package.ecosystem")).alias("ecosystem"), F.col("a.package.name").alias("name"), spans, "a.versions").where("ecosystem is not null and name is not null")
    entries = entries.withColumn("package_name", text.package_name(F.col("ecosystem"), F.col("name")))
    from riskloom.operators.dedup import merged_entries

    merged = merged_entries(entries, ["advisory_id", "ecosystem", "package_name"], "name", "place", ["ranges"], ["versions"])
    merged = merged.withColumn("package_id", F.xxhash64("advisory_id", "ecosystem", "package_name"))
    key = ["package_id", "advisory_id", "ecosystem", "package_name"]
    kinds = merged.select("package_id", F.posexplode("ranges").alias("at", "r")).where("trim(r.type) <> ''").select("package_id", "at", F.col("r.type").alias("range_type"), F.posexplode("r.spans").alias("n", "e"))
    return {
        "advisories": heads, "packages": merged.select(*key, "name"),
        "ranges": kinds.select("package_id", "range_type", "at", "n", "e.introduced", "e.fixed", "e.last_affected"),
        "versions": merged.select("package_id", F.explode("versions").alias("version")).where("version is not null").distinct(),
    }


def tree_products(tree: dict) -> Iterator[dict]:
    """The products of one product tree in document order, leaves first, then what relationships name.

    A leaf's name and version come from its package address, else from the nearest product above it and its own version
    branch; debug packages are left out. A relationship needs its component and takes over its platform's name.
    """
    known: dict[str, dict] = {}
    todo = [(b, None) for b in reversed(tree.get("branches") or [])]
    while todo:  # depth first, in order
        branch, above = todo.pop()
        category, name, leaf = branch.get("category"), branch.get("name"), branch.get("product")
        if isinstance(leaf, dict) and leaf.get("product_id") is not None:
            helper = leaf.get("product_identification_helper") or {}
            known[leaf["product_id"]] = {
                "leaf_name": leaf.get("name"), "purl": helper.get("purl"), "cpe": helper.get("cpe"), "platform": None,
                "tree_name": (name if category == "product_name" else above) or leaf.get("name"), "tree_version": name if category in ("product_version", "product_version_range") else None,
            }
        nearest = name if category == "product_name" else above
        todo += [(b, nearest) for b in reversed(branch.get("branches") or [])]
    for r in tree.get("relationships") or []:
        whole = r.get("full_product_name") or {}
        part = known.get(r.get("product_reference"))
        if part is None or whole.get("product_id") is None:
            continue
        helper = whole.get("product_identification_helper") or {}
        base = known.get(r.get("relates_to_product_reference"))
        known[whole["product_id"]] = part | {"cpe": helper.get("cpe", part["cpe"]), "own_purl": helper.get("purl", part["purl"]), "platform_id": r.get("relates_to_product_reference") if base else None}
    for place, (product_id, p) in enumerate(known.items()):
        yield {"place": place, "product_id": product_id, **p}


def product_trees(docs: DataFrame, id_col: str = "advisory_id", json_col: str = "json", piece_col: str | None = None) -> DataFrame:
    """(advisory_id, place, product_id, component, version, platform, cpe, purl, canonical, is_canonical): the products of
    documents ``{"product_tree": ...}``; products that say the same share the first one's id.

    A large document may come in pieces, rows with one id and a number ``piece_col``, each a tree whose relationships name products of
    the piece itself. Pieces follow each other; a product that several have keeps its first place, and the last one's texts. ``place``
    is then a struct of piece and place.
    """
    shape = pa.schema([("advisory_id", pa.string()), ("piece", pa.int64()), ("place", pa.int64()), *((c, pa.string()) for c in ("product_id", "leaf_name", "tree_name", "tree_version", "purl", "own_purl", "cpe", "platform_id"))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, piece, raw in zip(b["advisory_id"].to_pylist(), b["piece"].to_pylist(), b["json"].to_pylist(), strict=True):
                try:
                    tree = json.loads(raw).get("product_tree") or {}
                except (TypeError, ValueError, AttributeError):
                    continue
                rows = [{"advisory_id": key, "piece": piece, **{c: p.get(c) for c in shape.names[2:]}} for p in tree_products(tree)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, shape)

    piece = F.lit(0) if piece_col is None else F.col(piece_col)
    rows = docs.select(F.col(id_col).cast("string").alias("advisory_id"), piece.cast("long").alias("piece"), F.col(json_col).alias("json")).mapInArrow(walk, "advisory_id string, piece long, place long, product_id string, leaf_name string, tree_name string, tree_version string, purl string, own_purl string, cpe string, platform_id string")
    if piece_col is None:
        rows = rows.drop("piece")
    else:
        told = [c for c in shape.names if c not in ("advisory_id", "piece", "place", "product_id")]
        once = rows.groupBy("advisory_id", "product_id").agg(F.min(F.struct("piece", "place")).alias("place"), F.max_by(F.struct(*told), F.struct("piece", "place")).alias("last"))
        rows = once.select("advisory_id", "place", "product_id", *(F.col(f"last.{c}").alias(c) for c in told))
    address = packages.parsed(F.col("purl"))
    rows = rows.withColumns({"component": F.coalesce(address["name"], F.col("tree_name")), "version": F.when(address.isNotNull(), address["version"]).otherwise(F.col("tree_version"))})
    debug = lambda c: F.coalesce(F.lower(c).rlike("-debug(info|source)(-|$)"), F.lit(False))
    rows = rows.where(~debug("component") & ~debug("leaf_name"))
    names = rows.select("advisory_id", F.col("product_id").alias("platform_id"), F.col("component").alias("platform"))
    rows = rows.join(names, ["advisory_id", "platform_id"], "left").withColumn("purl", F.coalesce("own_purl", "purl"))
    same = [F.coalesce(c, F.lit("")) for c in ("component", "version", "platform")]
    first = rows.groupBy("advisory_id", *(s.alias(f"s{i}") for i, s in enumerate(same))).agg(F.min_by("product_id", "place").alias("canonical"))
    rows = rows.select("*", *(s.alias(f"s{i}") for i, s in enumerate(same))).join(first, ["advisory_id", "s0", "s1", "s2"])
    return rows.select("advisory_id", "place", "product_id", "component", "version", "platform", "cpe", "purl", "canonical", (F.col("canonical") == F.col("product_id")).alias("is_canonical"))


STATUS_LISTS = ["fixed", "known_affected", "known_not_affected", "under_investigation"]
STATUSES = "struct<vulnerabilities:array<struct<cve:string,product_status:struct<" + ",".join(f"{s}:array<string>" for s in STATUS_LISTS) + ">,scores:array<struct<cvss_v3:struct<baseScore:double,baseSeverity:string>>>>>>"


def product_statuses(docs: DataFrame, products: DataFrame, id_col: str = "advisory_id", json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """(statuses, referenced): one row of each vulnerability, canonical product and status, with the greatest score; and
    the canonical products that a status names."""
    from riskloom.operators.findings import greatest_score

    v = docs.select(F.col(id_col).cast("string").alias("advisory_id"), F.explode(F.from_json(json_col, STATUSES)["vulnerabilities"]).alias("v")).where("v.cve is not null")
    lists = F.array(*(F.struct(F.lit(s).alias("status"), F.col(f"v.product_status.{s}").alias("ids")) for s in STATUS_LISTS))
    best = greatest_score(F.transform("v.scores", lambda s: F.named_struct(F.lit("score"), s["cvss_v3"]["baseScore"], F.lit("severity"), s["cvss_v3"]["baseSeverity"])))
    rows = v.select("advisory_id", F.col("v.cve").alias("cve_id"), best.alias("best"), F.explode(lists).alias("l")).select("advisory_id", "cve_id", "best.score", "best.severity", "l.status", F.explode("l.ids").alias("product_id"))
    rows = rows.join(products.select("advisory_id", "product_id", "canonical"), ["advisory_id", "product_id"])
    once = rows.groupBy("advisory_id", "cve_id", "canonical", "status").agg(F.max("score").alias("score"), F.max_by("severity", "score").alias("severity"))
    referenced = products.where("is_canonical").join(once.select("advisory_id", F.col("canonical").alias("product_id")), ["advisory_id", "product_id"], "left_semi")
    return once, referenced
