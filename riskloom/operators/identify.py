"""Identification of products: routing to registries, matching, alignment of names, ranking, gates. Column expressions
and joins for all items at once."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import packages, text, versions
from riskloom.operators.dedup import best
from riskloom.session import cut, spread

# Confidences of identifications.
CONFIRMED, UNCONFIRMED, CATALOGUE, TIE, DOWNGRADE, DEEP_SEARCH, HIGH = 0.95, 0.5, 0.6, 0.05, 0.5, 0.85, 0.95
# Targets that scope nothing, and packages' reversed hosts.
NON_SCOPING = ("windows", "macos", "mac_os", "linux", "unix", "android", "iphone_os", "ios", "ipados", "x86", "x64")
REVERSED_HOSTS = ("com", "org", "net", "io", "edu", "gov", "mil", "int", "biz", "info", "name", "ch", "de", "uk", "jp", "cn", "eu", "us")
REGISTRIES = list(packages.ADVISORY_NAME)


def registries(name: Column) -> Column:
    """The registries to ask for a name, by its shape; none for blank names and those with spaces, else all."""
    n = F.trim(name)
    only = lambda x: F.array(F.lit(x))
    none = F.array().cast("array<string>")
    return (
        F.when(name.isNull() | (n == ""), none)
        .when(n.rlike("^@[^/]+/[^/]+$"), only("npm"))
        .when(n.rlike(text.MODULE_PATH), only("go"))
        .when(n.rlike(r"^/[^/\s]+$"), none)
        .when(n.rlike(r"^[^/\s.]+/[^/\s]+$"), only("packagist"))
        .when(n.contains(":"), only("maven"))
        .when(n.rlike(r"\s"), none)
        .otherwise(F.array(*(F.lit(x) for x in REGISTRIES)))
    )


def registry_matches(items: DataFrame, mirror: DataFrame) -> DataFrame:
    """(item, ecosystem, package_name, confirmed, confidence, address): items (item, name, version) in a mirror
    (ecosystem, package_name, versions), which holds names as their ecosystem compares them."""
    asked = items.select("item", "name", "version", F.explode(registries(F.col("name"))).alias("ecosystem"))
    asked = asked.withColumn("package_name", text.package_name(F.col("ecosystem"), F.trim("name")))
    met = asked.join(mirror, ["ecosystem", "package_name"])
    low = F.transform("versions", lambda v: F.lower(v))
    has = F.when(F.col("ecosystem") == "nuget", F.array_contains(low, F.lower("version"))).otherwise(F.array_contains("versions", F.col("version")))
    confirmed = F.coalesce(has, F.lit(False))
    return met.select("item", "ecosystem", "package_name", confirmed.alias("confirmed"), F.when(confirmed, CONFIRMED).otherwise(UNCONFIRMED).alias("confidence"), packages.address(F.col("ecosystem"), F.col("package_name"), F.col("version")).alias("address"))


def best_registry(matches: DataFrame, items: DataFrame) -> DataFrame:
    """One match of each item: the most confident; of near ties the one whose ecosystem the usage text names, if it names
    just one, else the first ecosystem in alphabetical order."""
    group = Window.partitionBy("item")
    rows = matches.join(items.select("item", "usage"), "item").withColumn("top", F.max("confidence").over(group))
    rows = rows.withColumn("near", F.col("top") - F.col("confidence") <= F.lit(TIE) + 1e-9)
    rows = rows.withColumn("named", F.col("near") & packages.speaks_for(F.col("usage"), F.col("ecosystem")))
    rows = rows.withColumn("n_named", F.count_if("named").over(group))
    preferred = F.when((F.col("n_named") == 1) & F.col("named"), 0).otherwise(1)
    return best(rows.withColumn("preferred", preferred), ["item"], F.col("preferred"), -F.col("confidence"), F.col("ecosystem")).select(*matches.columns)


def artifact_order(artifacts: DataFrame) -> DataFrame:
    """Artifacts (item, group_id, artifact_id, n_versions) in the order in which they are tried: group and artifact alike
    first, then those of most versions."""
    order = [F.when(F.col("group_id") == F.col("artifact_id"), 0).otherwise(1).asc(), F.desc("n_versions"), F.asc("group_id"), F.asc("artifact_id")]
    return artifacts.withColumn("rn", F.row_number().over(Window.partitionBy("item").orderBy(*order)))


def first_confirmed(tried: DataFrame, confirmed: str = "confirmed") -> DataFrame:
    """Of each item's artifacts, in order, the first with the version; else the very first, unconfirmed."""
    return best(tried, ["item"], F.when(F.col(confirmed), 0).otherwise(1), F.col("rn"))


class Form(NamedTuple):
    """A normalised text, its words, and its words run together."""

    text: Column
    words: Column
    run: Column


def formed(form: Column | Form) -> Form:
    if isinstance(form, Form):
        return form
    words = text.tokens(form)
    return Form(form, words, F.array_join(words, ""))


def with_forms(rows: DataFrame, **forms: Column) -> tuple[DataFrame, list[Form]]:
    """``rows`` with columns of each form, worked out once a row however many rules look at them."""
    rows = rows.withColumns({f"{k}_form": v for k, v in forms.items()})
    rows = rows.withColumns({f"{k}_words": text.tokens(F.col(f"{k}_form")) for k in forms})
    rows = rows.withColumns({f"{k}_run": F.array_join(f"{k}_words", "") for k in forms})
    return rows, [Form(F.col(f"{k}_form"), F.col(f"{k}_words"), F.col(f"{k}_run")) for k in forms]


def without_forms(rows: DataFrame, *forms: str) -> DataFrame:
    return rows.drop(*(f"{k}_{part}" for k in forms for part in ("form", "words", "run")))


def vendor_explains(vendor: Column | Form, token: Column) -> Column:
    """Whether a word is one of a normalised vendor's, or four letters or more of its words run together."""
    vendor = formed(vendor)
    return (vendor.text != "") & (token != "") & (F.array_contains(vendor.words, token) | ((F.length(token) >= 4) & vendor.run.contains(token)))


def _ends(words: Column) -> Column:
    """Where each word ends in the words run together."""
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.length(F.array_join(F.slice(words, F.lit(1), i), "")))


def aligned_words(query: Column, candidate: Column) -> Column:
    """How many of the candidate's first words spell the query's words, run together; -1 if none do, or the query ends
    inside a word."""
    spelled, whole = F.array_join(query, ""), F.array_join(candidate, "")
    place = F.array_position(_ends(candidate), F.length(spelled))
    return F.when((F.size(query) > 0) & (F.size(candidate) > 0) & whole.startswith(spelled) & (place > 0), place.cast("int")).otherwise(-1)


def _all_explained(words: Column, vendor: Form) -> Column:
    return F.forall(words, lambda w: vendor_explains(vendor, w))


def consumed_words(item_vendor: Form, query: Form, candidate: Form, is_title: bool) -> Column:
    """How many of the candidate's words are used up where the query is spelled: by its first words or, for products and queries of
    several words, by words after those that the item's vendor explains; -1 if it is not."""
    q, c = query.words, candidate.words
    here = aligned_words(q, c)
    if is_title:
        return here
    starts = F.when(F.size(c) > 1, F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    later = F.filter(F.transform(starts, lambda s: F.struct(s.alias("s"), aligned_words(q, F.slice(c, s + 1, F.size(c))).alias("n"))), lambda x: x["n"] > 0)
    later = F.filter(later, lambda x: _all_explained(F.slice(c, F.lit(1), x["s"]), item_vendor))
    return F.when((here <= 0) & (F.size(q) >= 2), F.coalesce(F.try_element_at(later, F.lit(1))["n"], F.lit(-1))).otherwise(here)


def contradicting(item_vendor: Form, cpe_vendor: Form) -> Column:
    """Whether two vendors are both named and neither holds the other or a word that explains it."""
    held = item_vendor.text.contains(cpe_vendor.text) | cpe_vendor.text.contains(item_vendor.text)
    apart = (item_vendor.text != "") & (cpe_vendor.text != "") & ~held
    return apart & ~F.exists(item_vendor.words, lambda w: vendor_explains(cpe_vendor, w)) & ~F.exists(cpe_vendor.words, lambda w: vendor_explains(item_vendor, w))


def explains(item_vendor: Column | Form, query: Column | Form, cpe_vendor: Column | Form, candidate: Column | Form, is_title: bool, strict: bool, consumed: Column | None = None, at: Column | None = None, contradicts: Column | None = None) -> Column:
    """Whether a candidate's product or title explains an item's name (all normalised by ``text.containment_form``).

    Either the name is spelled by the candidate's words, from the first on or, for products, from a later one if the
    item's vendor explains those before; a title must say more than its vendor, and a single-word name leaves only words
    that the item's vendor explains. Or the candidate's words stand in the name, the words before explained by its
    vendor, or by the form of a Java coordinate; a single candidate word at the beginning (if ``strict``), or one whose
    vendor contradicts the item's, wants the words behind explained too.

    ``consumed``, ``at`` and ``contradicts`` are columns of ``consumed_words``, ``text.run_at`` and ``contradicting`` where these
    are there already.
    """
    iv, query, cv, candidate = (formed(x) for x in (item_vendor, query, cpe_vendor, candidate))
    q, c = query.words, candidate.words
    consumed = consumed_words(iv, query, candidate, is_title) if consumed is None else consumed
    spelled = (consumed > 0) & ((consumed > F.size(cv.words)) if is_title else F.lit(True))
    left = F.slice(c, F.greatest(consumed, F.lit(0)) + 1, F.size(c))
    spelled = spelled & ~((F.size(q) == 1) & (iv.text != "") & ~_all_explained(left, iv))
    at = text.run_at(q, c) if at is None else at
    before, behind = F.slice(q, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(q, F.greatest(at, F.lit(1)) + F.size(c), F.size(q))
    contradicts = contradicting(iv, cv) if contradicts is None else contradicts
    tail = text.tokens(F.regexp_extract(query.text, "^[^:]*:(.+)$", 1))
    related = F.exists(tail, lambda a: F.exists(c, lambda b: (a == b) | ((F.length(a) >= 4) & b.contains(a)) | ((F.length(b) >= 4) & a.contains(b))))
    coordinate = (at > 1) & F.try_element_at(q, F.lit(1)).isin(*REVERSED_HOSTS) & ~contradicts & query.text.rlike(r"^[a-z0-9]+(?:\.[a-z0-9]+)+:.+$") & related
    inside = (at > 0) & (coordinate | _all_explained(before, cv))
    wants_behind = (F.lit(strict) & (at == 1) & (F.size(c) == 1)) | ((at == 1) & contradicts)
    inside = inside & (~wants_behind | _all_explained(behind, cv))
    usable = (query.text != "") & (candidate.text != "") & (F.size(q) > 0) & (F.size(c) > 0)
    return F.coalesce(usable & (spelled | inside), F.lit(False))


def contained(slug: Column | Form, wider: Column | Form) -> Column:
    """Whether a slug stands in another one, as a text or by all its words."""
    slug, wider = formed(slug), formed(wider)
    return (slug.text != "") & (wider.text != "") & (wider.text.contains(slug.text) | ((F.size(slug.words) > 0) & (F.size(F.array_except(slug.words, wider.words)) == 0)))


def asked_once(items: DataFrame, said: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first, every): of the items that say the same in the columns ``said`` the least one, and (item, asked), every item with that one.

    What the rules find depends on what an item says alone, so that they look at one of equal items, and all take its candidates.
    """
    first = items.groupBy(*said).agg(F.min("item").alias("item")).select("item", *said)
    same = [F.col(f"every.{c}").eqNullSafe(F.col(f"first.{c}")) for c in said]
    every = items.alias("every").join(first.alias("first"), same).select("every.item", F.col("first.item").alias("asked"))
    return cut(first), every


def explained_candidates(pool: DataFrame) -> DataFrame:
    """Candidates (item, name, item_vendor, vendor, product, title) that explain their item's name, with ``relaxed``.

    The strict rule first, widened by the products of a vendor whose product is exactly the name that contain it; only
    where no candidate passes, the relaxed rule.
    """
    form = text.containment_form
    rows, (query, iv, cv, product, title) = with_forms(spread(pool, "item"), query=form(text.without_host(F.col("name"))), own=form(F.col("item_vendor")), cpe=form(F.col("vendor")), product=form(F.col("product")), title=form(F.col("title")))
    sides = (("product", product, False), ("title", title, True))
    about = {f"{k}_consumed": consumed_words(iv, query, c, is_title) for k, c, is_title in sides} | {f"{k}_at": text.run_at(query.words, c.words) for k, c, _ in sides}
    rows = rows.withColumns(about | {"contradicts": contradicting(iv, cv)})
    by = lambda strict, k, c, is_title: explains(iv, query, cv, c, is_title, strict, F.col(f"{k}_consumed"), F.col(f"{k}_at"), F.col("contradicts"))
    rows = rows.withColumns({f"{name}_ok": by(strict, *sides[0]) | by(strict, *sides[1]) for name, strict in (("strict", True), ("relaxed", False))})
    exact = F.col("strict_ok") & (F.array_join(query.words, " ") == F.array_join(product.words, " ")) & (cv.text != "")
    group = Window.partitionBy("item")
    rows = rows.withColumn("anchors", F.collect_set(F.when(exact, cv.text)).over(group)).withColumn("any_strict", F.max("strict_ok").over(group))
    rescued = F.array_contains("anchors", cv.text) & contained(query, product)
    kept = F.when(F.col("any_strict"), F.col("strict_ok") | rescued).otherwise(F.col("relaxed_ok"))
    rows = without_forms(rows.where(kept).withColumn("relaxed", ~F.col("any_strict")), "query", "own", "cpe", "product", "title")
    return rows.drop("strict_ok", "relaxed_ok", "anchors", "any_strict", *about, "contradicts")


def passes_target(targets: Column, declared: Column, has_registry: Column) -> Column:
    """Whether a candidate's targets allow the item: none, a wildcard or an operating system do, a server plug-in's never
    does, others must hold what the item declares; an item that declares nothing needs a registry match."""
    open_ones = F.exists(targets, lambda t: t.isin("*", "-", *NON_SCOPING))
    return (
        F.when(targets.isNull() | (F.size(targets) == 0), True)
        .when(F.array_contains(targets, "jenkins"), False)
        .when(open_ones, True)
        .when(declared.isNull(), has_registry)
        .otherwise(F.array_contains(targets, declared))
    )


def ranked_candidates(pool: DataFrame, limit: int = 10) -> DataFrame:
    """The candidates of each item in order (``rn``), the first ``limit``.

    ``pool``: item, name, item_vendor, item_version, ecosystem, id, part, vendor, product, targets, max_major,
    cataloged_row_count. Of each vendor and product the least id counts, applications before operating systems. Order:
    the exact product, a target of the item's ecosystem, words of the name left unexplained, coverage of the version, the
    same vendor, no derivative of a sibling, most catalogue rows, the least id.
    """
    form = text.containment_form
    parted = spread(pool, "item").where(F.col("part").isin("a", "o")).withColumn("has_app", F.max(F.col("part") == "a").over(Window.partitionBy("item")))
    once = best(parted.where((F.col("part") == "a") | ~F.col("has_app")), ["item", "vendor", "product"], F.col("id"))
    rows, (query, slug, cv, iv) = with_forms(once, query=form(F.col("name")), slug=form(F.col("product")), cpe=form(F.col("vendor")), own=form(F.col("item_vendor")))
    rows = rows.withColumn("coverage", versions.coverage(F.col("max_major"), F.col("item_version")))
    siblings = F.collect_list(F.struct("id", "slug_form", "slug_words", "slug_run", "cpe_form", "coverage")).over(Window.partitionBy("item"))
    rows = rows.withColumn("siblings", siblings)
    current = F.exists("siblings", lambda s: (s["id"] != F.col("id")) & (s["coverage"] == 0) & (s["cpe_form"] == cv.text) & contained(slug, Form(s["slug_form"], s["slug_words"], s["slug_run"])))
    outranked = (F.col("coverage") == 2) & (cv.text != "") & current
    derived = F.exists("siblings", lambda s: (F.size(s["slug_words"]) > 0) & (F.size(s["slug_words"]) < F.size("slug_words")) & (F.slice("slug_words", F.lit(1), F.size(s["slug_words"])) == s["slug_words"]))
    exact = (F.array_join(query.words, " ") == F.array_join("slug_words", " ")) & ~outranked
    target = F.coalesce(F.array_contains("targets", packages.target_software(F.col("ecosystem"))), F.lit(False))
    unexplained = F.size(F.filter(query.words, lambda w: ~F.array_contains("slug_words", w) & ~vendor_explains(cv, w)))
    agrees = (iv.text != "") & (cv.text != "") & (iv.text.contains(cv.text) | cv.text.contains(iv.text))
    order = {"not_exact": ~exact, "other_target": ~target, "unexplained": unexplained, "coverage": F.col("coverage"), "other_vendor": ~agrees, "derived": derived, "fewer_rows": -F.coalesce("cataloged_row_count", F.lit(0))}
    rows = rows.withColumns({f"by_{k}": v for k, v in order.items()})
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("item").orderBy(*(F.col(f"by_{k}").asc() for k in order), F.asc("id"))))
    return rows.where(F.col("rn") <= limit).select("item", "id", "vendor", "product", "rn", *(f"by_{k}" for k in order))


def cascade(items: DataFrame, stages: list[Callable[[DataFrame], DataFrame]], keys: list[str], left: list[Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Each item's candidates of the first stage that has any, with the stage's place.

    A stage gives the candidates of the items it is asked for, and is asked only for those that earlier stages left without any. So
    an item's candidates are never gathered or sorted to find its first stage. ``left`` gives, for each stage, the items for which it
    has no candidate, where these can be told without making all candidates.
    """
    rows = None
    for i, stage in enumerate(stages):
        found = stage(items)
        rows = found.withColumn("stage", F.lit(i)) if rows is None else rows.unionByName(found.withColumn("stage", F.lit(i)))
        if i + 1 < len(stages):
            items = cut(left[i](items) if left else items.join(found.select(*keys).distinct(), keys, "left_anti"))
    return rows


def merged_identity(items: DataFrame, registry: DataFrame, pool: DataFrame, rescue: DataFrame | None = None) -> DataFrame:
    """(item, ecosystem, package_name, cpe, confidence, method, version_confirmed, n_candidates): what an item is, from its registry match
    and its catalogue candidates.

    ``items``: item, vendor, declared (the target that its address declares), selected (the place of the candidate that an arbiter
    chose, 0 for none, null without a verdict), selected_confidence. ``registry``: at most one match of an item, with ecosystem,
    package_name, confirmed, confidence, verdict (``matched``, ``rejected`` or null), verdict_confidence. ``pool``: item, rn, cpe,
    vendor, product, title, targets, relaxed (found by the relaxed rule); a bounded list for each item. ``rescue``: such rows
    from a search without the registry match.

    1. The arbiter's candidate, else the first; candidates of the relaxed rule only with a verdict.
    2. Without a candidate, a registry match that a verdict rejects, or that is unconfirmed and without a verdict while the item
       names a vendor, goes, and the first rescued candidate comes in.
    3. A registry match is trusted if its version is confirmed or there is no candidate. One that is not takes with it what it
       vouched for: the candidate must pass the gate of targets alone, else the next of the pool that does takes its place.
    4. A candidate beside a trusted match must explain the package's name; else it goes.

    With neither left, an item is not identified (method ``none``).
    """
    fields = ["rn", "cpe", "vendor", "product", "title", "targets"]
    lists = pool.groupBy("item").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pool"), F.bool_or("relaxed").alias("relaxed"))
    matches = registry.select("item", "ecosystem", "package_name", "confirmed", F.col("confidence").alias("registry_confidence"), "verdict", "verdict_confidence")
    rows = items.select("item", F.col("vendor").alias("item_vendor"), "declared", "selected", "selected_confidence").join(matches, "item", "left").join(lists, "item", "left")
    n, has = F.coalesce(F.size("pool"), F.lit(0)), F.col("ecosystem").isNotNull()
    rows = rows.withColumns({"n": F.when(F.col("pool").isNull(), 0).otherwise(n), "relaxed": F.coalesce("relaxed", F.lit(False))})
    named = F.col("selected").between(1, F.col("n")) & ((F.col("n") > 1) | F.col("relaxed"))
    first = F.when((F.col("n") > 0) & ~F.col("relaxed"), F.try_element_at("pool", F.lit(1)))
    refused = (F.col("n") > 1) & (F.col("selected") == 0)
    rows = rows.withColumns({"named": F.coalesce(named, F.lit(False)), "refused": F.coalesce(refused, F.lit(False))})
    rows = rows.withColumn("chosen", F.when(F.col("named"), F.try_element_at("pool", F.col("selected").cast("int"))).when(~F.col("refused"), first))
    alone = has & F.col("chosen").isNull()
    weak = F.col("verdict").isNull() & ~F.col("confirmed") & (F.trim(F.coalesce("item_vendor", F.lit(""))) != "")
    rows = rows.withColumns({"rejected": F.coalesce(alone & ((F.col("verdict") == "rejected") | weak), F.lit(False)), "vouched": F.coalesce(alone & (F.col("verdict") == "matched"), F.lit(False))})
    if rescue is not None:
        saved = best(rescue, ["item"], F.col("rn")).select("item", F.struct(*fields).alias("saved"))
        rows = rows.join(saved, "item", "left").withColumn("chosen", F.when(F.col("rejected"), F.col("saved")).otherwise(F.col("chosen")))
    rows = rows.withColumn("trusted", F.coalesce(has & ~F.col("rejected") & (F.col("confirmed") | F.col("chosen").isNull()), F.lit(False)))
    passes = lambda c: F.coalesce(passes_target(c["targets"], F.col("declared"), F.lit(False)), F.lit(False))
    retried = has & ~F.col("rejected") & ~F.col("trusted") & ~passes(F.col("chosen"))
    others = F.filter("pool", lambda c: (c["rn"] != F.col("chosen")["rn"]) & passes(c))
    rows = rows.withColumn("chosen", F.when(retried, F.try_element_at(others, F.lit(1))).otherwise(F.col("chosen")))
    form = text.containment_form
    name, iv, cv = form(text.last_segment(F.col("package_name"))), form(F.col("item_vendor")), form(F.col("chosen")["vendor"])
    agrees = (name == "") | explains(iv, name, cv, form(F.col("chosen")["product"]), False, True) | explains(iv, name, cv, form(F.col("chosen")["title"]), True, True)
    rows = rows.withColumn("cpe", F.when(~F.col("trusted") | agrees, F.col("chosen")["cpe"]))
    found = F.col("cpe").isNotNull()
    backed = F.when(F.col("trusted"), F.when(F.col("vouched"), F.col("verdict_confidence")).otherwise(F.col("registry_confidence")))
    confidence = F.when(found & F.col("named"), F.col("selected_confidence")).when(found, F.greatest(backed, F.lit(CATALOGUE))).otherwise(backed)
    method = F.when(~F.col("trusted") & ~found, "none").when((F.col("named") & found) | F.col("refused") | (F.col("vouched") & F.col("trusted")), "arbitrated")
    method = method.when(F.col("trusted") & found, "registry+catalogue").when(F.col("trusted"), "registry").otherwise("catalogue")
    of = lambda c: F.when(F.col("trusted"), F.col(c))
    return rows.select("item", of("ecosystem").alias("ecosystem"), of("package_name").alias("package_name"), "cpe", confidence.alias("confidence"), method.alias("method"), of("confirmed").alias("version_confirmed"), F.when(found, F.greatest("n", F.lit(1))).alias("n_candidates"))


def verified(rows: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Identifications of high confidence after a verdict: an incorrect one loses its catalogue name and half its
    confidence, or goes as a whole (``deleted``) if no registry backs it; others stay."""
    asked = (F.col("method") != "none") & F.col("cpe").isNotNull() & (F.col("confidence") >= HIGH)
    wrong = F.coalesce(asked & (F.col(verdict) == "incorrect"), F.lit(False))
    backed = F.col("ecosystem").isNotNull()
    return rows.withColumns({"deleted": wrong & ~backed, "cpe": F.when(~wrong, F.col("cpe")), "confidence": F.when(wrong, F.col("confidence") * DOWNGRADE).otherwise(F.col("confidence")), "verified": F.coalesce(asked & F.col(verdict).isNotNull(), F.lit(False))})


def incomplete_reason(any_succeeded: Column, truncated: Column, n_findings: Column, confidence: Column, searched: Column) -> Column:
    """Why an item's research is not complete: all sources failed, findings were cut off, the identification is too weak
    for a deep search, or what that search said (``searched``); null if it is complete."""
    first = F.when(~any_succeeded, "SOURCES_FAILED").when(truncated, "FINDINGS_TRUNCATED")
    none_found = (n_findings == 0) & any_succeeded
    weak = confidence.isNull() | (confidence <= DEEP_SEARCH)
    return F.when(none_found & weak, "IDENTIFICATION_TOO_WEAK").when(none_found & searched.isNotNull(), searched).otherwise(first)


def bundled_components(components: DataFrame, catalogue: DataFrame, most: int = 10) -> DataFrame:
    """(item, name, version, vendor, product, id) of components (item, place, name, version) that one vendor alone makes
    under exactly this name, for any target or with a scoped name; the first ``most`` sound ones of an item are looked at."""
    sound = components.where((F.trim("name") != "") & (F.trim("version") != "") & (F.length("name") <= 200))
    first = sound.withColumn("rn", F.row_number().over(Window.partitionBy("item").orderBy("place"))).where(F.col("rn") <= most)
    asked = first.withColumn("key", text.bundled_form(text.last_segment(F.col("name"))))
    rows = catalogue.withColumn("key", text.bundled_form(F.col("product"))).groupBy("key").agg(F.min("vendor").alias("vendor"), F.max("vendor").alias("other"), F.min_by("product", "id").alias("product"), F.min("id").alias("id"), F.bool_or(F.array_contains("targets", "*")).alias("wild"))
    met = asked.join(rows.where("vendor = other"), "key").where(F.col("wild") | F.col("name").startswith("@") | F.col("name").contains("/"))
    return met.select("item", "name", "version", "vendor", "product", "id")
